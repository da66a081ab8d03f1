"""Benchmark decontamination by winnowing.

Of every six neighbouring five-word hashes the least is kept, in documents and items alike, so any ten words they
share share a kept hash. Hits are extended to the windows around them and compared word by word, as a join on the
windows' text. Items of fewer than ten words are one window each, found by hashes of their own length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from grainwise.llm.common import F, cut, row_of

WINDOW, GRAM = 10, 5
#: Bits of the map that tells which hashes any item has: its size does not depend on the tables.
MAP_BITS = 26
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def _inverse(n: int) -> np.ndarray:
    """Powers of the base's inverse modulo 2**64."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, pow(int(_BASE), -1, 1 << 64), dtype=np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_TABLE = np.ones(256, dtype=bool)
_TABLE[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


class Spans:
    """Word hashes and byte spans of one text, with no loop over its words."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode().lower()
        data = np.frombuffer(self.raw, dtype=np.uint8)
        inside = _TABLE[data]
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.n = len(self.starts)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(len(data) + 1, _BASE, dtype=np.uint64))
            upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)])))
            words = upto[self.ends] - upto[self.starts]
            back = _inverse(len(data) + 1)
            self.hashes = _mix(words * back[self.starts])

    def grams(self, k: int) -> np.ndarray:
        """A hash of every k neighbouring words."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        out = np.zeros(self.n - k + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = _mix(out * _BASE + self.hashes[j: self.n - k + 1 + j] + np.uint64(j + k))
        return out

    def kept(self) -> np.ndarray:
        """Starts of the winnowed grams: the last least one of every window of WINDOW words."""
        grams = self.grams(GRAM)
        wide = WINDOW - GRAM + 1
        if len(grams) < wide:
            return np.zeros(0, np.int64)
        views = np.lib.stride_tricks.sliding_window_view(grams, wide)
        return np.unique(np.arange(len(views)) + wide - 1 - views[:, ::-1].argmin(axis=1))

    def window(self, at: int, length: int) -> bytes:
        return b" ".join(self.raw[self.starts[i]: self.ends[i]] for i in range(at, at + length))


def _low(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window, item_id) distinct, and (length, place) of the hashes that lead to them; length is WINDOW or less."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, lengths, places = [], [], [], []
            for item, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                s = Spans(text)
                length = min(s.n, WINDOW)
                if not length:
                    continue
                kept = s.grams(GRAM)[s.kept()] if length == WINDOW else s.grams(length)
                ids.append(item.as_py())
                texts.append([s.window(i, length).decode() for i in range(s.n - length + 1)])
                lengths.append(length)
                places.append(_low(kept).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(texts, pa.list_(pa.string())), pa.array(lengths, pa.int32()),
                 pa.array(places, pa.list_(pa.int64()))], ["item_id", "windows", "length", "places"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    made = cut(rows.mapInArrow(run, "item_id string, windows array<string>, length int, places array<long>"))
    return (made.select(F.explode("windows").alias("window"), "item_id").where("item_id is not null").distinct(),
            made.select("length", F.explode("places").alias("place")).distinct())


def _maps(places: DataFrame) -> dict[int, np.ndarray]:
    """For each window length a map of the places taken: at most ten maps of 2**MAP_BITS bits, built from words of them."""
    words = (places.groupBy("length", (F.col("place") / 64).cast("long").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 AS int))")).alias("bits")))
    maps: dict[int, np.ndarray] = {}
    for r in words.toLocalIterator():
        maps.setdefault(r["length"], np.zeros(1 << (MAP_BITS - 6), np.uint64))[r["w"]] = np.uint64(r["bits"] & (2 ** 64 - 1))
    return maps


def candidates(docs: DataFrame, maps: dict[int, np.ndarray]) -> DataFrame:
    """(doc_id, row, n_words, windows): windows are (at, length, text) around every hit of the maps, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    schema = "doc_id long, row long, n_words long, windows array<struct<at:int,length:int,text:string>>"
    kind = pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32()), ("text", pa.string())]))

    def hits(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
        low = _low(hashes)
        return (bits[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1) == 1

    def windows(s: Spans) -> list[tuple[int, int, str]]:
        out = []
        for length, bits in shared.value.items():
            if s.n < length:
                continue
            if length < WINDOW:
                at = np.flatnonzero(hits(s.grams(length), bits))
            else:
                kept = s.kept()
                kept = kept[hits(s.grams(GRAM)[kept], bits)]
                back = np.arange(WINDOW - GRAM + 1)
                at = np.unique(kept[:, None] - back[None, :])
                at = at[(at >= 0) & (at <= s.n - WINDOW)]
            out += [(int(i), length, s.window(i, length).decode()) for i in at]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, found = [], []
            for text in b.column(2).to_pylist():
                s = Spans(text)
                counts.append(s.n)
                found.append([{"at": a, "length": n, "text": t} for a, n, t in windows(s)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(found, kind)],
                                             ["doc_id", "row", "n_words", "windows"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_of(docs).alias("row"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of `docs`.

    A word is hit inside any window of ten item words that the document repeats (an item of fewer words is one
    window). Null and empty texts have no words; items without words or without id match nothing; item ids are
    compared as strings. Items with the same text all count.
    """
    windows, places = item_windows(items)
    seen = cut(candidates(docs, _maps(places)))
    around = seen.where(F.size("windows") > 0).select("row", F.explode("windows").alias("x")).select("row", "x.*")
    known = cut(windows)
    spans = around.join(known.select(F.col("window").alias("text")).distinct(), "text", "left_semi")
    met = cut(spans)
    # Hit words: the spans of a document in order, each counted from where those before it end.
    per = (met.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("at", "length"))).alias("s"))
           .select("row", F.aggregate("s", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, x: F.struct(
               F.greatest(a["end"], x["at"] + x["length"]).alias("end"),
               (a["n"] + F.greatest(F.lit(0), x["at"] + x["length"] - F.greatest(a["end"], x["at"]))).alias("n")))["n"].alias("n_hit")))
    owners = (met.select("row", "text").distinct().join(known.withColumnRenamed("window", "text"), "text")
              .groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    out = seen.select("doc_id", "row", "n_words").join(per, "row", "left").join(owners, "row", "left")
    names = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op9_winnow(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items).drop("row")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT DISTINCT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
