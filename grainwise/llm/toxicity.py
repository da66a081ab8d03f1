"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases.

Weights come from labelled rows: how much likelier a word is in toxic texts, counted over all of them. A logistic
curve over the weighted hits turns them into a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from grainwise.llm.common import F, cut, remainder, row_of

#: Words that weigh something before any label is seen.
SEEDS = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "disgusting", "scum", "trash", "imbecile", "bastard",
         "cretin", "vermin", "jerk", "dumbass", "asshole", "bitch", "fuck", "fucking", "shit", "bullshit", "crap", "retard", "slut",
         "whore", "dickhead", "wanker")
#: Phrases in which such a word insults nobody.
EXCEPTIONS = ("trash can", "trash bin", "take out the trash", "clown fish", "circus clown", "pond scum", "sore loser", "jerk chicken")
#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = str.maketrans(dict(zip(
    "а в е ё з и і ї ј к м н о р с т у х ѕ ԁ ԛ ԝ ɡ α β ε ι κ ν ο ρ τ υ χ ω ı 0 1 3 4 5 7 8 l".split(),
    "a b e e e i i i j k m h o p c t y x s d q w g a b e i k v o p t u x w i o i e a s t b i".split(), strict=True)))
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
_SIGN = re.compile(r"[@$!|+](?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[­​-‏⁠﻿̀-ͯ]+")
#: Least documents, evidence (log-odds over its standard error) and lift (log-odds) of a learned word. No number of words
#: is set: a word of less lift weighs less than any seed, and evidence alone, which grows with the labelled rows, lets none in.
LEAST_DOCS, LEAST_Z, LEAST_LIFT = 3, 4.0, 0.5
#: Labelled rows the logistic curve is fitted on, about, chosen by a hash of doc_id; all where there are fewer.
FIT_ROWS = 20_000


def fold(text: str | None) -> str:
    """Lower case, look-alikes and digits as the letters they stand for (l and 1 both as i), hidden characters gone."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower()
        text = _HIDDEN.sub("", unicodedata.normalize("NFD", text))
    return _SIGN.sub(lambda m: _SIGNS[m.group()], text).translate(LOOKALIKES)


def _terms(labelled: DataFrame) -> DataFrame:
    """(term, toxic, clean): in how many texts of either label each folded word occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list[int]] = {}
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for word in set(_WORD.findall(fold(text))):
                    if 3 <= len(word) <= 40:
                        found.setdefault(word, [0, 0])[1 - toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), *[pa.array([x[i] for x in found.values()], pa.int64()) for i in (0, 1)]],
                ["term", "toxic", "clean"])

    return labelled.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Weights by folded word. `labelled` is (toxic 0 or 1, text); all of it is counted. Seeds start with three toxic texts.

    Words are chosen by evidence and by lift, each on its own; no word stands in the way of another.
    """
    every = labelled.agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).first()
    a, b = every["a"] or 0, every["n"] - (every["a"] or 0)
    seeds = [fold(s) for s in SEEDS]
    odds = lambda x, y: math.log((x + .5) / (max(a - x, 0) + .5)) - math.log((y + .5) / (max(b - y, 0) + .5))
    lift = F.log((F.col("toxic") + .5) / (a - F.col("toxic") + .5)) - F.log((F.col("clean") + .5) / (b - F.col("clean") + .5))
    error = F.sqrt(1 / (F.col("toxic") + .5) + 1 / (F.col("clean") + .5))
    terms = _terms(labelled).withColumn("lift", lift).withColumn("z", lift / error)
    strong = (F.col("toxic") >= LEAST_DOCS) & (F.col("z") >= LEAST_Z) & (F.col("lift") >= LEAST_LIFT)
    out = dict.fromkeys(seeds, 2.5)
    for r in terms.where(F.col("term").isin(seeds) | strong).orderBy("term").collect():
        if r["term"] in out:
            out[r["term"]] = min(6.0, max(0.5, odds(r["toxic"] + 3, r["clean"])))
        else:
            out[r["term"]] = min(6.0, r["lift"])
    return out


def hits(df: DataFrame, lexicon: dict[str, float], keep: str = "doc_id") -> DataFrame:
    """(`keep`, weight, words): weighted lexicon hits outside exception phrases, and the number of words, of each row's text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for term, w in lexicon.items():
            machine.add_word(term, (len(term), w))
        for phrase in map(fold, EXCEPTIONS):
            machine.add_word(phrase, (len(phrase), None))
        machine.make_automaton()
        for b in batches:
            weights, counts = [], []
            for text in b.column(1).to_pylist():
                text = fold(text)
                n, found, spared = len(text), [], []
                for end, (length, w) in machine.iter(text):
                    start = end - length + 1
                    if (start == 0 or not text[start - 1].isalnum()) and (end + 1 == n or not text[end + 1].isalnum()):
                        (spared if w is None else found).append((start, end, w))
                if spared:
                    found = [f for f in found if not any(s <= f[0] and f[1] <= e for s, e, _ in spared)]
                weights.append(sum(f[2] for f in found))
                counts.append(len(text.split()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weights, pa.float64()), pa.array(counts, pa.int64())],
                                             [keep, "weight", "words"])

    kind = df.schema[keep].dataType.simpleString()
    return df.select(keep, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{keep} {kind}, weight double, words long")


def _features(weight, words, log, sqrt):
    return [log(1 + weight), weight / sqrt(words + 1.0)]


def fit(rows: list[tuple[float, int, int]]) -> list[float]:
    """Intercept and slopes of the logistic curve, by Newton steps with a small ridge."""
    beta = np.array([-3.0, 1.5, 0.5])
    if len({r[2] for r in rows}) < 2:
        return beta.tolist()
    w, n, y = (np.array(x, dtype=float) for x in zip(*rows, strict=True))
    x = np.column_stack([np.ones(len(w)), *_features(w, n, np.log, np.sqrt)])
    ridge = np.diag([1e-3, 1e-1, 1e-1])
    prior = beta.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ (beta - prior))
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def score(df: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(row, doc_id, held_out, score, predicted), one row per row of `df`; `row` as in row_of.

    Labels are learned from documents whose crc32(doc_id) modulo `folds` is not 0. A document labelled twice counts
    twice; null labels count for nothing. Null and empty texts have no hits and get the curve's value there. Without labels
    the seeds and a fixed curve are used.
    """
    ids = labels.where("toxic is not null").select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("long").alias("toxic"))
    ids = ids.where(remainder(F.col("labelled"), folds) != 0)
    texts = df.select("doc_id", F.col("text").cast("string").alias("text"))
    learned = texts.where(remainder(F.col("doc_id"), folds) != 0).join(ids.hint("merge"), F.col("doc_id") == F.col("labelled"))
    lexicon = learn_lexicon(learned.select("toxic", "text"))
    rows = df.select(F.struct("doc_id", row_of(df).alias("row")).alias("id"), "text")
    found = cut(hits(rows, lexicon, "id").select("id.row", "id.doc_id", "weight", "words"))
    part = FIT_ROWS / max(ids.count(), 1)
    chosen = ids.where(F.pmod(F.xxhash64("labelled"), F.lit(1 << 30)) < int(min(1.0, part) * (1 << 30)))
    sample = found.join(chosen, F.col("doc_id") == F.col("labelled")).select("weight", "words", "toxic").collect()
    beta = fit([tuple(r) for r in sample])
    line = F.lit(beta[0])
    for b, x in zip(beta[1:], _features(F.col("weight"), F.col("words"), F.log, F.sqrt), strict=True):
        line = line + F.lit(b) * x
    p = F.round(1 / (1 + F.exp(-line)), 9)
    return found.select("row", "doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), p.alias("score"),
                        (p >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(df: DataFrame, labels: DataFrame) -> DataFrame:
    return score(df, labels).drop("row")
