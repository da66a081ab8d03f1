"""A workspace: versioned datasets, and append-only logs that name the version in force.

A version's number is claimed by a marker file that is created only where there is none, so two writers never share one. The version is
written in full before the registry row that points to it is appended, so a reader sees the old version or the new one and never
a mixture. That one append is the whole commit; a claim whose writer is lost leaves a number unused and nothing else.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainwise.contract import Binding, DatasetContract, changed_fields, columns_of, fingerprint
from grainwise.errors import ContractError, GateRefused
from grainwise.functions.exprs import quoted

# The logs of a workspace and the columns of each.
LOGS = {
    "registry": "name string, version int, path string, row_count bigint, source_rows bigint, narrowed string, "
                "fingerprint string, active boolean, at timestamp",
    "contracts": "dataset string, version int, contract string, fingerprint string, columns string, row_count bigint, "
                 "changed string, valid_from timestamp",
    "ledger": "applied_at timestamp, dataset string, plan_id string, action_id string, kind string, column string, "
              "rows_before bigint, rows_after bigint, history_version int, statement string",
    "profiles": "dataset string, version int, row_count bigint, column_count int, fingerprint string, at timestamp",
    "validations": "dataset string, version int, check_id string, outcome string, rows bigint, passed bigint, "
                   "failed bigint, not_checked bigint, at timestamp",
    "analyses": "dataset string, name string, call string, contract_version int, rows_analysed bigint, result_path string, "
                "finding string, at timestamp",
    "gates": "dataset string, version int, contract_version int, drift string, key_holds boolean, repeats bigint, copies bigint, at timestamp",
    "metrics": "dataset string, name string, left_column string, op string, right_column string, judged bigint, "
               "true_rows bigint, status string, at timestamp",
}


@dataclass(frozen=True)
class Workspace:
    spark: SparkSession
    root: str

    # --- logs ---------------------------------------------------------------------------------

    def log(self, name: str) -> DataFrame:
        """Everything ever appended to a log; empty before the first append."""
        path = f"{self.root}/logs/{name}"
        if not self._file_system(path)[0].exists(self._file_system(path)[1]):
            return self.spark.createDataFrame([], LOGS[name])
        return self.spark.read.schema(LOGS[name]).parquet(path)

    def _file_system(self, path: str):
        """The file system of a path, and the path as it knows it."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def claim(self, what: str, after: int) -> int:
        """The first number past `after` that no writer holds. The marker is created, never overwritten, so of two writers one goes on to the next."""
        n = after
        while True:
            n += 1
            fs, marker = self._file_system(f"{self.root}/claims/{what}/{n}")
            try:
                fs.create(marker, False).close()
                return n
            except Py4JJavaError as held:
                if not fs.exists(marker):
                    raise held

    def append(self, name: str, rows: list[dict] | DataFrame) -> None:
        """One append, one file, visible in full or not at all."""
        if not isinstance(rows, DataFrame):
            fields = [part.strip().split(" ")[0] for part in LOGS[name].split(",")]
            rows = self.spark.createDataFrame([[r.get(f) for f in fields] for r in rows], LOGS[name])
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/logs/{name}")

    # --- datasets -----------------------------------------------------------------------------

    def register(self, name: str, df: DataFrame, *, source_rows: int | None = None, narrowed: str | None = None,
                 at: datetime | None = None) -> int:
        """Write `df` as the next version of a dataset and point the registry to it."""
        version = self.claim(f"datasets/{name}", self._last_version(name))
        path = f"{self.root}/datasets/{name}/v={version}"
        df.write.mode("errorifexists").parquet(path)
        rows = self.spark.read.parquet(path).count()  # footers only
        self.append("registry", [{
            "name": name, "version": version, "path": path, "row_count": rows, "source_rows": source_rows or rows,
            "narrowed": narrowed, "fingerprint": fingerprint(columns_of(df.schema)), "active": True,
            "at": at or datetime.now()}])
        return version

    def narrowed_load(self, name: str, source: DataFrame, where: str | None = None, limit: int | None = None) -> int:
        """Load part of a source. The filter reaches the source; the part is stated for good.

        A limit takes the rows of the lowest hash, so every run takes the same ones; repeated rows are alike whichever is taken.
        """
        whole = source.count()
        part = source.where(where) if where else source
        part = part.orderBy(F.xxhash64(*[F.to_json(F.struct(F.col(quoted(c)))) for c in part.columns])).limit(limit) if limit else part
        said = " ".join(s for s in (f"where {where}" if where else "", f"limit {limit}" if limit else "") if s)
        return self.register(name, part, source_rows=whole, narrowed=said or None)

    def unregister(self, name: str) -> None:
        row = self._entry(name)
        self.append("registry", [{**row, "active": False, "at": datetime.now()}])

    def datasets(self) -> DataFrame:
        """The latest registry row of every dataset that is still registered."""
        latest = Window.partitionBy("name").orderBy(F.col("version").desc(), F.col("active").asc())
        return (self.log("registry").withColumn("__rn", F.row_number().over(latest))
                .where((F.col("__rn") == 1) & F.col("active")).drop("__rn"))

    def _last_version(self, name: str) -> int:
        return self.log("registry").where(F.col("name") == name).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _entry(self, name: str) -> dict:
        row = self.datasets().where(F.col("name") == name).first()
        if row is None:
            raise GateRefused(f"no dataset is registered as {name!r}")
        return row.asDict()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The version in force, or an earlier one."""
        if version is None:
            return self.spark.read.parquet(self._entry(name)["path"])
        row = self.log("registry").where((F.col("name") == name) & (F.col("version") == version)).first()
        if row is None:
            raise GateRefused(f"{name} has no version {version}")
        return self.spark.read.parquet(row["path"])

    def history(self, name: str) -> DataFrame:
        """Every version of a dataset, oldest first."""
        return self.log("registry").where((F.col("name") == name) & F.col("active")).select(
            "version", "row_count", "fingerprint", "at", "path").orderBy("version")

    def subset_note(self, name: str) -> str | None:
        """'subset: n of N rows', for a dataset that was loaded in part."""
        e = self._entry(name)
        return f"subset: {e['row_count']} of {e['source_rows']} rows ({e['narrowed']})" if e["narrowed"] else None

    # --- contracts ----------------------------------------------------------------------------

    def confirm(self, contract: DatasetContract, at: datetime | None = None) -> int:
        """Put a contract in force over the dataset's present version.

        An identical contract keeps its version. Unresolved questions are refused.
        """
        if contract.unresolved:
            raise ContractError(f"unresolved: {', '.join(contract.unresolved)}")
        entry = self._entry(contract.dataset)
        df = self.spark.read.parquet(entry["path"])
        contract.check(df.schema)
        text = json.dumps(_plain(contract), sort_keys=True)
        before = self.current_contract(contract.dataset)
        columns = json.dumps(columns_of(df.schema))
        if before and before["contract"] == text and before["columns"] == columns:
            return before["version"]
        changed = [] if before is None else changed_fields(contract_from(before["contract"]), contract)
        version = 1 if before is None else before["version"] + 1
        self.append("contracts", [{
            "dataset": contract.dataset, "version": version, "contract": text, "fingerprint": entry["fingerprint"],
            "columns": columns, "row_count": entry["row_count"], "changed": ", ".join(changed),
            "valid_from": at or datetime.now()}])
        return version

    def contract_history(self, dataset: str | None = None) -> DataFrame:
        """Slowly changing history: each version until the next one begins."""
        log = self.log("contracts")
        log = log.where(F.col("dataset") == dataset) if dataset else log
        order = Window.partitionBy("dataset").orderBy("version")
        return log.withColumn("valid_to", F.lead("valid_from").over(order)).withColumn(
            "is_current", F.col("valid_to").isNull())

    def current_contract(self, dataset: str) -> dict | None:
        row = self.contract_history(dataset).where("is_current").first()
        return row.asDict() if row else None

    def contract(self, dataset: str) -> DatasetContract:
        row = self.current_contract(dataset)
        if row is None:
            raise GateRefused(f"{dataset} has no contract in force")
        columns = tuple(tuple(c) for c in json.loads(row["columns"]))
        from dataclasses import replace
        return replace(contract_from(row["contract"]), binding=Binding(columns, row["row_count"]))


def _plain(contract: DatasetContract) -> dict:
    def readable(v):
        if hasattr(v, "isoformat"):
            return v.isoformat()
        if isinstance(v, dict):
            return {k: readable(x) for k, x in v.items() if k != "binding"}
        if isinstance(v, (list, tuple)):
            return [readable(x) for x in v]
        return v
    return readable(asdict(contract))


def contract_from(text: str) -> DatasetContract:
    """A contract from the text it was stored as."""
    from datetime import date

    from grainwise.contract import Domain, ForeignKey, Measure, Rule, Window as Span
    d = json.loads(text)
    tup = lambda v: tuple(v) if v is not None else None
    window = d["window"] and Span(date.fromisoformat(d["window"]["start"]), date.fromisoformat(d["window"]["end"]))
    measures = tuple(Measure(**{**m, "per": tup(m["per"]), "numerator": tup(m["numerator"]),
                                "denominator": tup(m["denominator"]), "compare": tup(m["compare"])}) for m in d["measures"])
    return DatasetContract(
        dataset=d["dataset"], grain=d["grain"], key=tup(d["key"]), date_column=d["date_column"], window=window or None,
        measures=measures, dimensions=tup(d["dimensions"]), exclusions=tuple(Rule(**r) for r in d["exclusions"]),
        expectations=tuple(Rule(**r) for r in d["expectations"]),
        foreign_keys=tuple(ForeignKey(tup(k["columns"]), k["references"], tup(k["referenced"])) for k in d["foreign_keys"]),
        domains=tuple(Domain(x["column"], tup(x["allowed"])) for x in d["domains"]),
        missing_values=tup(d["missing_values"]), caveats=tup(d["caveats"]), unresolved=tup(d["unresolved"]))
