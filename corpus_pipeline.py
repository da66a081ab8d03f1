"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, contaminated documents go, sources are mixed
to target weights, and the mix is dealt into shards. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Iterable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.llm import entropy, kdtree, simhash, toxicity, winnow
from grainwise.llm.common import ROW, numbered, table
from grainwise.session import cut

#: Bytes of a finished shard.
SHARD_BYTES = 128 << 20

#: Names the stages use beside the documents' own columns.
OWN = (ROW, "__file", "__at", "__number", "__time")

# Decisions come back to the documents by the rows' numbers, which every read of the files gives alike. They grow with the
# documents, so the joins are merge joins at any size.


def _aside(docs: DataFrame, names: Iterable[str]) -> dict[str, str]:
    """Free names for the columns of `docs` that are called like one of `names`."""
    taken, out = {*docs.columns, *names}, {}
    for name in names:
        if name in docs.columns:
            out[name] = name + "_given"
            while out[name] in taken:
                out[name] += "_"
            taken.add(out[name])
    return out


def _clear(stage):
    """`stage` over documents whose own columns may be called like those it adds: they are set aside under other names and come back."""
    @wraps(stage)
    def run_clear(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        away = _aside(docs, OWN)
        out = stage(spark, docs.withColumnsRenamed(away), sf_dir)
        return out.withColumnsRenamed({new: old for old, new in away.items()})
    return run_clear


@_clear
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; null and empty texts stay."""
    rows = numbered(docs)
    found = toxicity.score(rows, table(spark, sf_dir, "labels")).where("predicted = 1")
    return rows.join(found.select(F.col("row").alias(ROW)).hint("merge"), ROW, "left_anti").select(*docs.columns)


@_clear
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, once; of a group without ids, the first row."""
    rows = numbered(docs)
    groups = simhash.near_groups(rows)
    kept = (groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone"))
            .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("x")).select(F.col("x.row").alias(ROW)))
    return rows.join(kept.hint("merge"), ROW, "left_semi").select(*docs.columns)


@_clear
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark window go; null and empty texts stay, as do all where the benchmark is empty."""
    rows = numbered(docs)
    found = winnow.contamination(rows, table(spark, sf_dir, "benchmark")).where("contaminated")
    return rows.join(found.select(F.col("row").alias(ROW)).hint("merge"), ROW, "left_anti").select(*docs.columns)


@_clear
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A null source is a source of its own; of rows alike in everything each is drawn for itself; a text without words is taken once.
    """
    rows = numbered(docs)
    taken = entropy.copies(entropy.word_sizes(rows)).where("copies > 0").select(F.col("row").alias(ROW), "copies")
    times = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return rows.join(taken.hint("merge"), ROW).select(*docs.columns, times.alias("__time")).drop("__time")


@_clear
def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot; a shard holds about SHARD_BYTES.

    Columns of the documents that are called shard or slot are kept as shard_given and slot_given. Null texts have no bytes but
    their row's eight; rows alike in everything are dealt by their number; an empty table gives none.
    """
    rows = numbered(docs.withColumnsRenamed(_aside(docs, ("shard", "slot"))))
    placed = kdtree.document_shards(rows, None, [F.col(ROW).alias("row_id")], target_bytes=SHARD_BYTES)
    return rows.join(placed.select(F.col("row_id").alias(ROW), "shard", "slot").hint("merge"), ROW).drop(ROW)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("entropy_mixing", mix_sources),
    ("kdtree_sharding", deal_shards),
]

#: Learned scores, XXH64 fingerprints and hashed placement are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
