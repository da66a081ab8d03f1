"""Session settings and the one place lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "grainwise", **conf: str) -> SparkSession:
    """A local session with the settings the operators assume (UTC, ANSI, AQE)."""
    width = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", width)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """`df` written once as a table in the shared folder, and read back from there.

    The lineage ends at files every executor can reach, so a lost executor costs a re-read; the
    work before the cut runs once however often the result is read.
    """
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Values that one task judges, of work that is heavy per value.
TASK_VALUES = 1 << 19


def spread(df: DataFrame, values: int = 0) -> DataFrame:
    """`df` over every core when its scan has fewer splits than that, else as it is.

    One huge row group is one task; work that is heavy per row is worth one exchange then. A table
    with many splits, the usual case on a cluster, is left alone. Splits go by stored bytes, which say little
    of that work; where the number of `values` is known, there are tasks enough for TASK_VALUES each.
    """
    wide = max(df.sparkSession.sparkContext.defaultParallelism, -(-values // TASK_VALUES))
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= wide:
        return df
    return df.repartition(wide)


_SCRATCH: dict[str, str] = {}


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder every executor can reach, under `spark.checkpoint.dir` where that is set.

    Only a local session without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        root = _SCRATCH.setdefault(app, "") or tempfile.mkdtemp(prefix="grainwise-")
        _SCRATCH[app] = root
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
