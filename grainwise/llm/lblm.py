"""A log-bilinear language model trained in numpy by noise-contrastive estimation.

The model predicts a class from the two classes before it: frequent words are classes of their own, other words are
classed by their first bytes. A word's probability is its class's, normalised over all classes, times its share of the class
by discounted counts over all training documents. Contexts are pairs of classes, so their normalisers are one table, made
once by matrix products. Every training document is used: the tasks train on their own splits from the same start and
their parameters are averaged, weighted by tokens. What reaches the driver does not grow with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from grainwise.llm.common import F, cut, remainder

#: Words with a class of their own, classes of other words, and bytes that class them.
WORDS, PREFIXES, PREFIX = 384, 120, 2
#: Words whose counts go to every task; others meet theirs in a join. Both sizes are fixed.
KNOWN = 65_536
DIM, NOISE, BATCH, RATE, EPOCHS = 24, 96, 2048, 0.15, 1
SMOOTH = 0.1
#: Bytes of text whose tokens a task holds at once; a longer text is held by itself.
SLICE = 2 << 20
END = b"\n"


def _encoded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of `texts` and last the end; each token's place among them, an end after each text; the tokens of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten().dictionary_encode()
    codes, many = flat.indices.to_numpy(zero_copy_only=False), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    blank = pc.index(flat.dictionary, "").as_py()
    if blank >= 0:  # what stands before the first and after the last blank
        held = codes != blank
        many = np.bincount(np.repeat(np.arange(len(many)), many)[held], minlength=len(many))
        codes = codes[held]
    distinct = pa.concat_arrays([flat.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
    return distinct, np.insert(codes, np.cumsum(many), len(distinct) - 1), many.astype(np.int64) + 1


def _slices(batch: pa.RecordBatch, text: int, many: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of `batch` in order, in parts of about `many` times SLICE bytes of the column numbered `text`."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // (many * SLICE), prepend=-1))
    for start, end in zip(edges, [*edges[1:], batch.num_rows], strict=True):
        yield batch.slice(int(start), int(end - start))


def token_counts(df: DataFrame) -> DataFrame:
    """(token, c): how often each token occurs in the texts of `df`, one end each included (as a line feed)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _slices(whole, 0, 4)):
            distinct, codes, _ = _encoded(b.column(0))
            c = np.bincount(codes, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([distinct, pa.array(c, pa.int64())], ["token", "c"]).filter(pa.array(c > 0))

    return (df.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token binary, c long")
            .groupBy("token").agg(F.sum("c").alias("c")))


@dataclass
class Vocabulary:
    """Classes: 0 a text's start, then frequent words and the end, then prefixes, and last all other words."""

    words: dict[bytes, int]
    prefixes: dict[bytes, int]
    known: dict[bytes, int]
    unigram: np.ndarray

    @property
    def size(self) -> int:
        return len(self.unigram)

    def of(self, token: bytes) -> int:
        found = self.words.get(token)
        return self.prefixes.get(token[:PREFIX], self.size - 1) if found is None else found

    def classes(self, tokens: pa.Array) -> np.ndarray:
        """The class of each of the binary `tokens`."""
        word = _places(tokens, pa.array([*self.words], pa.binary()))
        prefix = _places(pc.binary_slice(tokens, 0, PREFIX), pa.array([*self.prefixes], pa.binary()))
        held = np.array([*self.words.values(), *self.prefixes.values(), self.size - 1], dtype=np.int16)
        return held[np.where(word >= 0, word, np.where(prefix >= 0, prefix + len(self.words), -1))]


def _places(tokens: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each of `tokens` `among` distinct others, -1 for those that are not there."""
    return pc.fill_null(pc.index_in(tokens, value_set=among), -1).to_numpy(zero_copy_only=False)


def vocabulary_of(counts: DataFrame) -> tuple[Vocabulary, float, np.ndarray, np.ndarray]:
    """The classes, the discount, and the tokens and distinct tokens of every class of words without a class of their own.

    The driver holds KNOWN words and one row for each first two bytes.
    """
    # Counts by the sixteenth of an octave, from the top, as many as hold KNOWN words in all.
    band = F.floor(F.log2("c") * 16).cast("int")
    least, held = 1 << 20, 0
    for b in sorted(counts.groupBy(band.alias("b")).count().collect(), key=lambda r: -r["b"]):
        held += b["count"]
        if held > KNOWN:
            break
        least = b["b"]
    # The end is always known: it has a class of its own.
    top = sorted(counts.where((band >= least) | (F.col("token") == F.lit(END))).collect(), key=lambda r: (-r["c"], bytes(r["token"])))
    known = {bytes(r["token"]): r["c"] for r in top}
    words = {t: i + 1 for i, t in enumerate(dict.fromkeys([END, *[bytes(r["token"]) for r in top[:WORDS]]]))}
    rest = counts.where(~F.col("token").isin([F.lit(t) for t in words])).groupBy(F.substring("token", 1, PREFIX).alias("p")).agg(
        F.sum("c").alias("c"), F.count("*").alias("t"), F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two"))
    by = sorted(rest.collect(), key=lambda r: (-r["c"], bytes(r["p"])))
    prefixes = {bytes(r["p"]): len(words) + 1 + i for i, r in enumerate(by[:PREFIXES])}
    size = len(words) + len(prefixes) + 2
    total, types = np.zeros(size), np.zeros(size)
    for r in by:
        k = prefixes.get(bytes(r["p"]), size - 1)
        total[k] += r["c"]
        types[k] += r["t"]
    uni = total + SMOOTH
    uni[0] = 0.0
    for t, k in words.items():
        uni[k] += known.get(t, 0)
    one, two = sum(r["one"] for r in by), sum(r["two"] for r in by)
    discount = min(0.9, max(0.1, one / (one + 2 * two))) if one else 0.5
    return Vocabulary(words, prefixes, known, uni / uni.sum()), discount, total, types


class Model:
    """score(w | a, b) = (first[a] + second[b]) . out[w] + bias[w], for a class w after classes a, b."""

    def __init__(self, size: int, flat: np.ndarray | None = None, unigram: np.ndarray | None = None):
        self.size = size
        if flat is None:
            r = np.random.default_rng(20)
            flat = np.concatenate([(r.standard_normal(3 * size * DIM) * 0.1), np.log(np.maximum(unigram, 1e-12))]).astype(np.float32)
            flat[-size] = -30.0
        self.flat = flat.astype(np.float32)
        n = size * DIM
        self.first, self.second, self.out = (self.flat[i * n:(i + 1) * n].reshape(size, DIM) for i in range(3))
        self.bias = self.flat[3 * n:]
        self.held = np.empty((BATCH, NOISE), dtype=np.float32)  # the noise's part of a step, written anew by each

    def normalisers(self) -> np.ndarray:
        """log of the sum over all classes of exp(score), for every pair of classes before."""
        out = np.empty((self.size, self.size), dtype=np.float32)
        bias = self.bias.copy()
        bias[0] = -np.inf  # the start is never predicted
        for a in range(self.size):
            s = (self.first[a] + self.second) @ self.out.T + bias
            top = s.max(axis=1)
            out[a] = np.log(np.exp(s - top[:, None]).sum(axis=1)) + top
        return out

    def train(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, unigram: np.ndarray, state: list, rng) -> None:
        """One adaptive step of noise-contrastive estimation on the tokens w after a, b; the noise is shared by the step."""
        noise = rng.choice(self.size, NOISE, p=unigram)
        logq = np.log(NOISE * np.maximum(unigram, 1e-12)).astype(np.float32)
        h = self.first.take(a, axis=0)
        h += self.second.take(b, axis=0)
        q = self.out.take(w, axis=0)
        up = 1 - 1 / (1 + np.exp(-np.clip((h * q).sum(axis=1) + self.bias[w] - logq[w], -30, 30)))
        # -1 / (1 + exp(-clip(scores of the noise))), step by step in one place: that part takes most of the time.
        down = np.matmul(h, self.out[noise].T, out=self.held[:len(a)])
        down += self.bias[noise]
        down -= logq[noise]
        np.clip(down, -30, 30, out=down)
        np.negative(down, out=down)
        np.exp(down, out=down)
        down += 1
        np.divide(-1, down, out=down)
        q *= up[:, None]
        q += down @ self.out[noise]
        grads = [_gathered(a, q, self.size), _gathered(b, q, self.size), _gathered(w, up[:, None] * h, self.size)]
        np.add.at(grads[2], noise, down.T @ h)
        gb = np.bincount(w, up, self.size) + np.bincount(noise, down.sum(axis=0), self.size)
        for x, g, s in zip((self.first, self.second, self.out, self.bias), (*grads, gb.astype(np.float32)), state, strict=True):
            s += g * g
            x += RATE * g / np.sqrt(s)


def _gathered(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    order = np.argsort(at, kind="stable")
    keys = at[order]
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    out = np.zeros((size, rows.shape[1]), dtype=np.float32)
    out[keys[edges]] = np.add.reduceat(rows.take(order, axis=0), edges, axis=0)
    return out


def _classes(each: np.ndarray, codes: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts in a row, each after two starts and with its end; the places of the tokens among them."""
    at = np.arange(len(codes)) + 2 * np.repeat(np.arange(1, len(many) + 1), many)
    ids = np.zeros(len(codes) + 2 * len(many), dtype=np.int16)
    ids[at] = each[codes]
    return ids, at


def fit(df: DataFrame, vocabulary: Vocabulary) -> Model:
    """The model after EPOCHS passes over all texts of `df`, averaged over the tasks after each."""
    size, model = vocabulary.size, Model(vocabulary.size, unigram=vocabulary.unigram)
    rows = df.select(F.col("text").cast("string").alias("text"))
    for epoch in range(EPOCHS):
        shared = df.sparkSession.sparkContext.broadcast((vocabulary, model.flat))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, epoch=epoch) -> Iterator[pa.RecordBatch]:
            vocabulary, flat = shared.value
            own, rng, seen = Model(size, flat.copy()), np.random.default_rng(epoch), 0
            state = [np.full(x.shape, 1.0, np.float32) for x in (own.first, own.second, own.out, own.bias)]
            for b in (part for whole in batches for part in _slices(whole, 0)):
                distinct, codes, many = _encoded(b.column(0))
                ids, at = _classes(vocabulary.classes(distinct), codes, many)
                rng.shuffle(at)
                for i in range(0, len(at), BATCH):
                    t = at[i:i + BATCH]
                    own.train(ids[t - 2], ids[t - 1], ids[t], vocabulary.unigram, state, rng)
                seen += len(at)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own.flat), dtype=np.int32)), pa.array(own.flat.astype(float) * seen),
                                                  pa.array(np.full(len(own.flat), float(seen)))], ["i", "v", "n"])

        mean = (rows.mapInArrow(run, "i int, v double, n double").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).collect())
        if mean:
            flat = model.flat.copy()
            flat[[r["i"] for r in mean]] = [r["v"] for r in mean]
            model = Model(size, flat)
        shared.unpersist()
    return model


def score(df: DataFrame, folds: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of `df`.

    Learned from documents whose crc32(doc_id) modulo `folds` is not 0. A null or empty text is its end alone. A token that
    training never saw has the share its class keeps for such. With nothing to learn from, the end is the only
    class besides unseen words.
    """
    learned = df.where(remainder(F.col("doc_id"), folds) != 0)
    counts = cut(token_counts(learned))
    size = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = size["n"] or 0, size["v"]
    vocabulary, discount, total, types = vocabulary_of(counts)
    model = fit(learned, vocabulary)
    below = math.log10(n + SMOOTH * (v + 1))
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, model.flat, model.normalisers(), total))
    log10 = math.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat, norms, total = shared.value
        own = Model(vocabulary.size, flat)
        log_total = np.log10(np.maximum(total, 1.0))
        # Of each word known to every task: log10 of base and of its share of its class; last, of all others.
        known, c = pa.array([*vocabulary.known], pa.binary()), np.array([*vocabulary.known.values()], dtype=float)
        k = vocabulary.classes(known)
        log_base = np.append(np.log10(c + SMOOTH) - below, 0.0)
        log_share = np.append(np.where(k <= len(vocabulary.words), 0.0, np.log10(np.maximum(c - discount, 1e-9)) - log_total[k]), 0.0)
        for b in (part for whole in batches for part in _slices(whole, 2)):
            distinct, codes, many = _encoded(b.column(2))
            classes, place = vocabulary.classes(distinct), _places(distinct, known)
            ids, at = _classes(classes, codes, many)
            each = np.empty(len(at))
            for i in range(0, len(at), 1 << 12):
                t = at[i:i + (1 << 12)]
                x, y, w = ids[t - 2], ids[t - 1], ids[t]
                h = own.first.take(x, axis=0)
                h += own.second.take(y, axis=0)
                h *= own.out.take(w, axis=0)
                each[i:i + (1 << 12)] = h.sum(axis=1) + own.bias[w] - norms[x, y]
            found, starts = place[codes], np.cumsum(many) - many
            sums = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
            # Each text's words that are not known to every task, with how often it has them.
            rare = np.flatnonzero(found < 0)
            keys, m = np.unique(np.repeat(np.arange(len(many)), many)[rare] * len(distinct) + codes[rare], return_counts=True)
            text, of = np.divmod(keys, len(distinct))
            left = pa.StructArray.from_arrays([distinct.take(pa.array(of)), pa.array(m, pa.int32()), pa.array(classes[of], pa.int32())],
                                              ["token", "m", "k"])
            edges = np.searchsorted(text, np.arange(len(many) + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(many), pa.array(sums((found >= 0).astype(np.int64))), pa.array(sums(log_base[found])),
                 pa.array(sums(each) / log10 + sums(log_share[found])), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), left)],
                ["doc_id", "row", "n_tokens", "known", "base", "model", "rare"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                     F.col("text").cast("string").alias("text"))
    own = cut(rows.mapInArrow(run, "doc_id long, row long, n_tokens long, known long, base double, model double, "
                                   "rare array<struct<token:binary,m:int,k:int>>"))
    met = own.select("row", F.explode("rare").alias("x")).select("row", "x.*").join(counts, "token", "left")
    of = lambda values: F.get(F.lit([float(x) for x in values]), F.col("k"))
    unseen = np.where(types > 0, np.log10(np.maximum(discount * types, 1e-12) / np.maximum(total, 1.0)), 0.0)
    seen = F.log10(F.col("c") - discount) - of(np.log10(np.maximum(total, 1.0)))
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = (met.select("row", F.when(c > 0, F.col("m")).otherwise(0).alias("k"),
                       (F.col("m") * (F.log10(c + SMOOTH) - below)).alias("b"), (F.col("m") * F.when(c > 0, seen).otherwise(of(unseen))).alias("s"))
            .groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s")))
    add = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    return own.drop("rare").join(rest, "row", "left").select(
        "doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), "n_tokens", add("known", "k").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), add("base", "b").alias("base_score"), add("model", "s").alias("score"))


def op7_nce(df: DataFrame) -> DataFrame:
    return score(df)
