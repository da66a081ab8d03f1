"""Document fingerprints from closed syncmers over words: runs of k words whose least inner run lies at an edge.

Whether a run is chosen depends on its own words alone, so an edit moves only the anchors that touch it.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from grainwise.llm.common import F, Window, bounds_of, place, shuffle_width, whole_text, words_of

K, S = 5, 2


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """`df` with `out`: array of (pos, hash), the closed syncmers of `text` in order.

    Words are compared as they stand. A text of words of which no run is chosen, as one of fewer than k words, has one anchor for
    all of them, so texts with words are alike only where they share some; a text without words, or null, has none.
    """
    inner = k - s + 1
    w, h, at = f"__{out}_w", f"__{out}_h", f"__{out}_at"
    words, run = F.col(w), F.col(h)
    span = lambda i: F.least(*[F.get(run, i + j) for j in range(inner)])
    edge = lambda i: F.get(run, i).eqNullSafe(span(i)) | F.get(run, i + inner - 1).eqNullSafe(span(i))
    tiles = sorted({*range(0, inner, s), inner - 1})
    return (
        df.withColumn(w, words_of(whole_text(text)))
        .withColumn(h, F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + j) for j in range(1, s)])))
        .withColumn(at, F.when(F.size(w) >= k, F.filter(F.sequence(F.lit(0), F.size(w) - k), edge))
                    .otherwise(F.array().cast("array<int>")))
        .withColumn(out, F.when((F.size(w) > 0) & (F.size(at) == 0),
                                F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(words).alias("hash"))))
                    .otherwise(F.transform(F.col(at), lambda i: F.struct(
                        i.alias("pos"), F.xxhash64(*[F.get(run, i + j) for j in tiles]).alias("hash")))))
        .drop(w, h, at)
    )


def likeness(a: Column, b: Column) -> Column:
    """Shared anchors over all anchors of two hash arrays; two empty ones, of texts without words, are alike."""
    all_of = F.size(F.array_union(a, b))
    return F.when(all_of == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / all_of)


def as_text(hashes: Column) -> Column:
    """16 lowercase hex digits for each anchor, in the order of the text."""
    return F.lower(F.array_join(F.transform(hashes, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def following(df: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text) in descending doc_id dealt into `parts` slices: columns doc_id, text, slice, guest, key, tie.

    Each slice also holds, as a guest, the first row of the slice after it (the last slice holds the very
    first), so that the next row of every row is in its own slice. Null ids come last; equal ids are ordered
    by a hash of their text.
    """
    rows = df.select("doc_id", whole_text().alias("text"),
                     F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"))
    bounds = bounds_of(rows, "key", parts)
    rows = rows.withColumn("home", place(F.col("key"), bounds))
    heads = sorted((r["home"], r["m"]) for r in rows.groupBy("home").agg(F.max("key").alias("m")).collect())
    first, host = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for i, (home, top) in enumerate(heads):
        first[home], host[home] = top, heads[(i + 1) % len(heads)][0]
    own = F.struct(F.col("home").alias("slice"), F.lit(0).alias("guest"))
    away = F.struct(F.get(F.lit(host), F.col("home")).alias("slice"), F.lit(1).alias("guest"))
    head = F.get(F.array(*[F.lit(x).cast("long") for x in first]), F.col("home"))
    return (
        rows.withColumn("seat", F.explode(F.when(F.col("key") == head, F.array(own, away)).otherwise(F.array(own))))
        .select("doc_id", "text", "key", F.xxhash64("text").alias("tie"), "seat.slice", "seat.guest")
    )


def edited_pairs(df: DataFrame) -> DataFrame:
    """One row per document: its text, the edited text, their anchors and those of the next document.

    The last third of the code points gives way to the first as many of the next document in descending
    doc_id; the first document follows the last, and a lone document follows itself. The text moves once.
    """
    side = Window.partitionBy("slice").orderBy("guest", F.col("key").desc(), "tie")
    rows = following(df, shuffle_width(df.sparkSession))
    n, gone = F.length("text"), (F.length("text") / 3).cast("int")
    # The guests were made after the tie was set; a text that equals its neighbour's can stand for it.
    rows = rows.withColumn("next_text", F.lead("text").over(side)).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - gone), F.substring("next_text", F.lit(1), gone)))
    rows = with_anchors(with_anchors(rows.drop("next_text"), "text", "anchors"), "edited", "edited_anchors")
    return rows.withColumn("next_anchors", F.lead("anchors").over(side)).where("guest = 0")


def op1_syncmers(df: DataFrame) -> DataFrame:
    hashes = lambda c: F.col(c).getField("hash")
    return edited_pairs(df).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(hashes("anchors")).alias("fingerprint"), as_text(hashes("edited_anchors")).alias("edited_fingerprint"),
        likeness(hashes("anchors"), hashes("edited_anchors")).alias("near_edited"),
        likeness(hashes("anchors"), hashes("next_anchors")).alias("near_next"))
