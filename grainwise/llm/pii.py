"""Personal data by patterns and by a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field, trained from the small labelled table below, adds spans the patterns miss,
such as phone numbers without a plus sign or addresses written with "(at)". Only words with a digit, an @ or a bracketed
connector next to them may belong to a span; the labels of all others are O, so a text falls into runs of such words that
are decoded by themselves, many at once, and the result is that of decoding the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from grainwise.llm.common import F

KINDS = ("email", "ip", "card", "phone")
#: The small labelled table: spans stand in brackets as [kind:text].
EXAMPLES = """
write to [email:jane.doe (at) example (dot) com] for the papers
my mail is [email:k.lee [at] mail [dot] org] and not the old one
send it to [email:sales(at)firma.de] before noon
reach me under [email:bob_1 (at) post.net] any time
contact [email:a.b@example.com] or the desk
mail [email:x9@mail2.example.com] today please
call [phone:(555) 123-4567] after six
phone [phone:555-123-4567] or come by
tel [phone:030 1234 5678] in the morning
our number is [phone:0151 23456789] as before
fax [phone:(212) 555-0199] is out of order
call me at [phone:212.555.0188] tonight
dial [phone:+1 (743) 555-3824] now
ring [phone:+44 20 7946 0958] for help
the phone [phone:1-800-555-0147] is free
cell [phone:(310) 555 4510] works too
card [card:4111 1111 1111 1111] was charged
the number [card:5500-0000-0000-0004] has expired
pay with [card:4757965300669737] online
visa [card:4316522678525456] is mine
use [card:8646 3083 1055 7563] for it
debit [card:2747332757972694] on file
card no [card:3782 822463 10005] please
from [ip:192.168.1.77] to the server
host [ip:10.0.0.5] answered
login by [ip:203.0.113.9:8080] failed
address [ip:55.148.143.52] is blocked
the node [ip:2001:db8:0:1:1:1:1:1] is up
in 1999 there were 12 of them
chapter 3.14 has 200 pages
on 2024-01-15 at 10:30 it rained
the year 2010 and 2011 were dry
version 2.0.1 and version 3
sold 1,250,000 units in 2020
he paid $19.99 for 3 books
section 12(b) of 1998
token = "2321bac4d15ec8f90433955bf9d3cf61da12" is set
key 24be64439e3e49cf46b2d7c90f3602a3d0b907ff was lost
isbn 978-3-16-148410-0 is the book
order 20231105 and item 4471
score 3-2 in 90 minutes
call at 10 or 11 today
between 1914 and 1918 there was war
pages 100-120 of volume 7
price 10.50 to 12.75 in 2019
room 101 on floor 4
licensed under version 2.0 of 2004
by-nc 4.0 is the license
the @ sign stands alone
@someone said it in 2012
bitcoin at 45,000 and 3 percent
about 60 km/h on route 66
""".strip().splitlines()
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
_AREA = re.compile(r"[0-9@]|[(\[](?:at|dot)[)\]]", re.I)
_TOKEN = re.compile(r"\S+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The other base patterns. A match always begins where a run of digits does, which the look-behind spells out.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CONNECTOR = re.compile(r"[(\[](?:at|dot)[)\]]", re.I)


def _luhn(digits: str) -> bool:
    back = [int(d) for d in reversed(digits)]
    return (sum(back[0::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _on_net(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in address.split("."))


def _refused(found: str, kind: str) -> bool:
    """Whether a pattern has looked at just this text and dropped it: an address of too large parts, a card number that fails its check."""
    return (kind == "ip" and _IP.fullmatch(found) is not None and not _on_net(found)) or (kind == "card" and not _luhn(_digits(found)))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the patterns: leftmost and non-overlapping for each kind, failing matches dropped."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if _on_net(m.group())]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and _luhn(d):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _shape(word: str) -> str:
    kinds = "".join("9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in word[:60])
    return re.sub(r"a+", "a", re.sub(r"9{5,}", lambda m: f"<{min(len(m.group()), 20)}>", kinds))


@lru_cache(maxsize=65_536)
def _features(word: str, before: str, after: str) -> tuple[str, ...]:
    core = word.strip(".,;:!?#&%*$|\"'")
    digits = _digits(core)
    hexed = len(core) > 8 and re.fullmatch(r"[0-9a-f]+", core) is not None and not core.isdigit()
    return ("bias", f"shape={_shape(core)}", f"loose={re.sub('9+', '9', _shape(core))}", f"digits={min(len(digits), 17)}",
            f"at={'@' in core}", f"dots={min(core.count('.'), 4)}", f"colons={min(core.count(':'), 3)}", f"hex={hexed}",
            f"link={bool(_CONNECTOR.search(core))}", f"alpha={core.isalpha()}", f"before={_shape(before)}", f"after={_shape(after)}",
            f"word={before.lower().strip(':')}", f"link_before={bool(_CONNECTOR.search(before))}", f"link_after={bool(_CONNECTOR.search(after))}")


def _runs(text: str) -> list[list[tuple[int, int, tuple[str, ...]]]]:
    """Runs of neighbouring words that may be part of a span, as (start, end, features)."""
    if not _AREA.search(text):
        return []
    words = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    get = lambda i: text[words[i][0]: min(words[i][1], words[i][0] + 200)] if 0 <= i < len(words) else ""
    able, at = set(), 0
    for m in _AREA.finditer(text):
        while words[at][1] <= m.start():
            at += 1
        able.add(at)
        if m.group()[0] in "([":
            able.update(i for i in (at - 1, at + 1) if 0 <= i < len(words))
    out, last = [], -2
    for i in sorted(able):
        item = (*words[i], _features(get(i), get(i - 1), get(i + 1)))
        if i != last + 1:
            out.append([])
        out[-1].append(item)
        last = i
    return out


class Field:
    """A linear-chain conditional random field: weights of features by label, and of label pairs."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, runs: list[list[tuple[str, ...]]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded emission scores (run, place, label) and lengths."""
        lengths = np.array([len(r) for r in runs])
        out = np.zeros((len(runs), lengths.max(), len(LABELS)))
        memo: dict[tuple[str, ...], np.ndarray] = {}
        for i, run in enumerate(runs):
            for t, feats in enumerate(run):
                if feats not in memo:
                    ids = [self.index[f] for f in feats if f in self.index]
                    memo[feats] = self.emit[ids].sum(axis=0)
                out[i, t] = memo[feats]
        return out, lengths

    def decode(self, runs: list[list[tuple[str, ...]]], batch: int = 2048) -> list[np.ndarray]:
        """The likeliest labels of each run, by Viterbi over batches of runs of about equal length."""
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        out: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
        at = 0
        while at < len(order):
            # A batch holds about `batch` x 16 words however long its runs are.
            size = max(1, min(batch, batch * 16 // len(runs[order[min(at + batch, len(order)) - 1]])))
            part = order[at:at + size]
            at += size
            emit, lengths = self.scores([runs[i] for i in part])
            best, back = emit[:, 0] + self.move[-1], []
            best = np.where(_STARTS, best, -1e9)
            ends = [best]
            for t in range(1, emit.shape[1]):
                paths = best[:, :, None] + self.move[None, :-1]
                back.append(paths.argmax(axis=1))
                best = paths.max(axis=1) + emit[:, t]
                ends.append(best)
            for row, i in enumerate(part):
                n = lengths[row]
                path = [int(ends[n - 1][row].argmax())]
                for t in range(n - 2, -1, -1):
                    path.append(int(back[t][row, path[-1]]))
                out[i] = np.array(path[::-1])
        return out


#: An I label follows a B or I of its own kind only, and never comes first.
_STARTS = np.array([not x.startswith("I") for x in LABELS])
_FORBID = np.array([[y.startswith("I") and x[2:] != y[2:] for y in LABELS] for x in LABELS])


def labelled_runs(lines: list[str] = EXAMPLES) -> list[tuple[list[tuple[str, ...]], list[int]]]:
    """The labelled table as runs of features with their labels."""
    out = []
    for line in lines:
        spans, text = [], ""
        for part in re.split(r"(\[(?:email|ip|card|phone):.*?\](?= |$))", line):
            m = re.fullmatch(r"\[(email|ip|card|phone):(.*)\]", part)
            if m:
                spans.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2] if m else part
        for run in _runs(text):
            labels = []
            for start, end, _ in run:
                hit = next((s for s in spans if s[0] < end and start < s[1]), None)
                labels.append(0 if hit is None else LABELS.index(("B-" if start <= hit[0] else "I-") + hit[2]))
            out.append(([f for *_, f in run], labels))
    return out


def train(rows: list[tuple[list[tuple[str, ...]], list[int]]], rounds: int = 150, rate: float = 0.3, ridge: float = 0.02) -> Field:
    """Penalised likelihood by adaptive gradient steps; the gradients come from forward and backward sums."""
    index = {f: i for i, f in enumerate(sorted({f for run, _ in rows for feats in run for f in feats}))}
    n = len(LABELS)
    emit, move = np.zeros((len(index), n)), np.zeros((n + 1, n))
    hold = np.vstack([np.where(_FORBID, -1e9, 0.0), np.where(_STARTS, 0.0, -1e9)])
    se, sm = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    coded = [([[index[f] for f in feats] for feats in run], labels) for run, labels in rows]
    soft = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    for _ in range(rounds):
        ge, gm, m = -ridge * emit, -ridge * move, move + hold
        for run, labels in coded:
            e = np.array([emit[ids].sum(axis=0) for ids in run])
            a, b = [m[-1] + e[0]], [np.zeros(n)]
            for t in range(1, len(run)):
                a.append(soft(a[-1][:, None] + m[:-1], 0) + e[t])
            for t in range(len(run) - 1, 0, -1):
                b.insert(0, soft(m[:-1] + (e[t] + b[0])[None], 1))
            z = soft(a[-1], 0)
            for t, ids in enumerate(run):
                p = np.exp(a[t] + b[t] - z)
                p[labels[t]] -= 1
                np.subtract.at(ge, ids, p[None])
                if t:
                    q = np.exp(a[t - 1][:, None] + m[:-1] + (e[t] + b[t])[None] - z)
                    q[labels[t - 1], labels[t]] -= 1
                    gm[:-1] -= q
                else:
                    gm[-1] -= p
        se += ge ** 2
        sm += gm ** 2
        emit += rate * ge / np.sqrt(se)
        move += rate * gm / np.sqrt(sm)
    return Field(index, emit, move + hold)


def _spans(text: str, run, labels) -> list[tuple[int, int, str]]:
    """Spans of one decoded run, without the marks around them; a span needs a digit or an address."""
    out: list[list] = []
    for (start, end, _), y in zip(run, labels, strict=True):
        kind = LABELS[y][2:]
        # A word with the digits of a whole card is a span of its own.
        if LABELS[y][0] == "B" or (kind == "card" and len(_digits(text[start:end])) >= 13):
            out.append([start, end, kind])
        elif LABELS[y][0] == "I" and out:
            out[-1][1] = end
    clean = []
    for start, end, kind in out:
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while end > start and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        least = {"email": 3, "ip": 7, "card": 13, "phone": 9}[kind]
        if end - start >= least and (kind == "email" or len(_digits(text[start:end])) >= {"ip": 4, "card": 13, "phone": 7}[kind]):
            clean.append((start, end, kind))
    return clean


def all_spans(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """Base spans, and base with added spans, of every text. An added span touches no base span and is nothing a pattern has refused."""
    runs = [_runs(t) for t in texts]
    flat = [[f for *_, f in run] for many in runs for run in many]
    paths = iter(field.decode(flat) if flat else [])
    out = []
    for text, many in zip(texts, runs, strict=True):
        base = base_spans(text) if many else []
        taken = sorted((s, e) for s, e, _ in base)
        starts = [s for s, _ in taken]
        tops = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
        more = []
        for run in many:
            for s, e, kind in _spans(text, run, next(paths)):
                before = int(np.searchsorted(starts, e)) - 1
                if (before < 0 or tops[before] <= s) and not _refused(text[s:e], kind):
                    more.append((s, e, kind))
        out.append((base, base + more))
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def op4_crf(df: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of `df`.

    Counts and digest are of the base spans; `spans` also holds those the field adds. Places are code points of the whole
    text, ends exclusive. Null and empty texts have none. The field is trained on the driver from the table above.
    """
    field = train(labelled_runs())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = all_spans([t or "" for t in b.column(1).to_pylist()], field)
            counts = [pa.array([sum(k == kind for *_, k in base) for base, _ in made], pa.int64()) for kind in KINDS]
            digest = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in made], pa.string())
            spans = pa.array([_joined(every) for _, every in made], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, spans],
                                             ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
