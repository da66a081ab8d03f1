"""Operators against brute force on the smallest tables, and their answers to odd rows."""

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from grainwise.llm import entropy, kdtree, lblm, licenses, lines, pii, queries, simhash, syncmers, toxicity, winnow
from grainwise.llm.common import ROW, numbered

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, slot int"
ODD = [(1, "the idiot and the moron went home today with us all day", "en", "a", 5, "x", 1), (2, None, None, None, None, None, None),
       (3, "", "", "", 0, "", 0), (3, "", "", "", 0, "", 0), (4, "one", "en", None, 3, "y", 2), (None, "null id here", "en", "b", 1, "z", 3),
       (5, "long " * 60_000, "en", "b", 300_000, "q", 4), (6, "é ü 漢字 words\nwith lines\nand more\nlast", "de", "a", 9, "w", 5),
       (7, "é ü 漢字 words\nwith lines\nand more\nlast", "de", "a", 9, "w", 5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def x64(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else (p % (1 << 64)).to_bytes(8, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def anchors(text):
    w = WORD.findall(text)
    if len(w) < 5:
        return [x64(*w)] if w else []
    s = [x64(*w[i:i + 2]) for i in range(len(w) - 1)]
    # A text of words of which no run is chosen has one anchor for all of them.
    return [x64(s[i], s[i + 2], s[i + 3]) for i in range(len(w) - 4) if min(s[i:i + 4]) in (s[i], s[i + 3])] or [x64(*w)]


def like(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op1_matches_brute_force(docs, texts):
    ids = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in syncmers.op1_syncmers(docs).collect()}
    assert set(rows) == set(ids)
    for i, d in enumerate(ids):
        text, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        gone = len(text) // 3
        edited = text[: len(text) - gone] + after[:gone]
        r = rows[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == "".join(f"{a % (1 << 64):016x}" for a in anchors(text))
        assert r["edited_fingerprint"] == "".join(f"{a % (1 << 64):016x}" for a in anchors(edited))
        assert r["near_edited"] == pytest.approx(like(anchors(text), anchors(edited)))
        assert r["near_next"] == pytest.approx(like(anchors(text), anchors(after)))


def test_op1_tells_short_texts_apart(spark):
    texts = {i: " ".join(f"w{i}x{j}" for j in range(5 + i % 2)) for i in range(60)}
    rows = syncmers.op1_syncmers(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert all(r["fingerprint"] for r in rows) and {r["near_next"] for r in rows} == {0.0}
    assert any(min(x64(*w[i:i + 2]) for i in range(4)) not in (x64(*w[:2]), x64(*w[3:5])) for w in (t.split() for t in texts.values()) if len(w) == 5)


def test_op2_near_equal_bytes_and_gapless_slots(docs, texts):
    rows = kdtree.op2_kdtree(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    sums, slots = Counter(), defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sums) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, most = sum(sums.values()) / 24, max(r["size"] for r in rows)
    assert max(sums.values()) - mean <= 2 * most


def test_op2_splits_repeated_rows(spark):
    same = spark.range(4000).selectExpr("1 AS doc_id", "'abcdefgh' AS text", "'a' AS lang", "'a' AS source")
    sums = Counter(r["shard"] for r in kdtree.op2_kdtree(same).collect())
    assert len(sums) == 24 and max(sums.values()) <= 1.1 * 4000 / 24


def test_op3_finds_held_out_toxic_texts(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op3_toxicity"](spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in rows)
    assert right / len(rows) > 0.9


@pytest.mark.parametrize("text", ["you ID10T", "a m0r0n.", "scуm ѕcum", "p@thetic!", "i​diot"])
def test_op3_folds(spark, text):
    lexicon = dict.fromkeys(map(toxicity.fold, toxicity.SEEDS), 1.0)
    df = spark.createDataFrame([(1, text), (2, "put it in the trash can, clownish idiotic")], "doc_id long, text string")
    got = {r["doc_id"]: r["weight"] for r in toxicity.hits(df, lexicon).collect()}
    assert got[1] >= 1 and got[2] == 0


def naive_spans(text):
    """The patterns of the contract, by the regular expression engine alone."""
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    keep = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return sorted(((*m.span(), k) for k, (p, ok) in keep.items() for m in re.finditer(p, text) if ok(m.group())),
                  key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_op4_base_spans(texts):
    tricky = ["a@b.c@d.e x@y", "1.2.3.4.5.6.7.8 256.1.1.1", "4111 1111-1111 1111 4111111111111112", "+1 (743) 555-3824+44 20 7946 0958",
              "..@x.y a@@b.c é@x.yé", "0001.2.3.4", "@a.b", "x@a.b.", "p%q@r-s.t-u..v"]
    for text in [*texts.values(), *tricky]:
        assert pii.base_spans(text) == naive_spans(text)


def test_op4_field_labels_its_table_and_new_text(docs, texts):
    field = pii.train(pii.labelled_runs())
    table = pii.labelled_runs()
    assert sum(list(field.decode([run])[0]) == labels for run, labels in table) >= 0.97 * len(table)
    text = "call (555) 765-4321 or jim (at) host (dot) com; in 2015 we had 33"
    assert [text[s:e] for s, e, _ in pii.all_spans([text], field)[0][1]] == ["(555) 765-4321", "jim (at) host (dot) com"]
    rows = pii.op4_crf(docs).collect()
    for r in rows:
        base = naive_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_op4_adds_nothing_a_pattern_refused_and_minds_no_case():
    field = pii.train(pii.labelled_runs())
    text = "write to [JIM (AT) host (DOT) com] or ip 300.1.1.1, card 4111 1111 1111 1112 and card 4111 1111 1111 1111"
    spans = pii.all_spans([text], field)[0]
    assert [(text[s:e], k) for s, e, k in spans[0]] == [("4111 1111 1111 1111", "card")]
    assert [(text[s:e].lower(), k) for s, e, k in spans[1] if k != "card"] == [("jim (at) host (dot) com", "email")]
    assert not [1 for s, e, k in spans[1] if k == "card" and "1112" in text[s:e]]


def test_op5_finds_every_license_line(spark):
    folder = "/root/testdata/sf0.01"
    found = {(r["doc_id"], r["license"]) for r in queries.QUERIES["op5_licenses"](spark, folder).collect()}
    fold = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    want = {(r["doc_id"], name) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()
            for name, parts in licenses.TEMPLATES.items() if any(f" {fold(p)} " in f" {fold(r['text'])} " for p in parts)}
    assert want and found >= want and len(found - want) <= len(want) // 10


def brute_groups(fps, radius=4):
    ids, top = list(fps), {}
    for i, a in enumerate(ids):
        top.setdefault(a, a)
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                ra, rb = a, b
                while top[ra] != ra:
                    ra = top[ra]
                while top[rb] != rb:
                    rb = top[rb]
                top[max(ra, rb)] = min(ra, rb)
    def root(a):
        while top[a] != a:
            a = top[a]
        return a
    return {a: root(a) for a in ids}


def brute_simhash(text):
    w = re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "")
    w = WORD.findall(w)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_op6_matches_brute_force(docs, texts):
    fps = {d: brute_simhash(t) for d, t in texts.items()}
    want = brute_groups(fps)
    rows = simhash.op6_simhash(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {d: (f"{fps[d]:016x}", want[d]) for d in texts}


def test_op6_links_across_tiles(spark):
    r = np.random.default_rng(3)
    seeds = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {}
    for i in range(400):
        x = int(seeds[i % 40])
        for b in r.integers(0, 64, 3):
            x ^= 1 << int(b)
        fps[i] = x
    uniq = {}
    for i, x in fps.items():
        uniq.setdefault(x, i)
    rows = [(x - (1 << 64) if x >> 63 else x, i) for x, i in uniq.items()]
    edges = simhash.links(spark.createDataFrame(rows, "fp long, node long"), tile=16)
    got = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    want = brute_groups({i: x for x, i in uniq.items()})
    assert {i: got.get(i, i) for i in want} == want


def test_op7_base_counts_and_normalisation(docs, texts, spark):
    rows = {r["doc_id"]: r for r in lblm.op7_nce(docs).collect()}
    tokens = {d: [*WORD.findall(re.sub(r"[A-Z]", lambda m: m.group().lower(), t)), "\n"] for d, t in texts.items()}
    train = Counter(w for d, ts in tokens.items() if zlib.crc32(str(d).encode()) % 10 for w in ts)
    n, v = sum(train.values()), len(train)
    base = model = 0.0
    for d, ts in tokens.items():
        r = rows[d]
        want = sum(np.log10((train[w] + .1) / (n + .1 * (v + 1))) for w in ts)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(train[w] > 0 for w in ts), n)
        assert r["base_score"] == pytest.approx(want, rel=1e-9)
        if r["held_out"]:
            base, model = base + r["base_score"], model + r["score"]
    assert model > base
    counts = lblm.token_counts(docs)
    vocabulary, discount, total, types = lblm.vocabulary_of(counts)
    m = lblm.Model(vocabulary.size, unigram=vocabulary.unigram)
    norms = m.normalisers()
    s = (m.first[3] + m.second[5]) @ m.out.T + m.bias
    assert np.exp(s[1:] - norms[3, 5]).sum() == pytest.approx(1, abs=1e-4)
    # The shares of each class, the unseen one with them, sum to one.
    by = defaultdict(float)
    for r in counts.collect():
        t = bytes(r["token"])
        if t not in vocabulary.words:
            by[vocabulary.of(t)] += (r["c"] - discount) / total[vocabulary.of(t)]
    assert all(x + discount * types[k] / total[k] == pytest.approx(1) for k, x in by.items())


def test_op7_scores_alike_in_slices(spark, odd, monkeypatch):
    whole = {(r["doc_id"], r["n_tokens"]): r["base_score"] for r in lblm.op7_nce(odd).collect()}
    monkeypatch.setattr(lblm, "SLICE", 64)
    parts = lblm.op7_nce(odd).collect()
    assert len(parts) == len(ODD)
    assert all(r["base_score"] == pytest.approx(whole[r["doc_id"], r["n_tokens"]]) for r in parts)


def test_op7_knows_the_end_among_many_words_of_one_count(spark, monkeypatch):
    monkeypatch.setattr(lblm, "KNOWN", 10)
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(1, 4)], "doc_id long, text string")
    vocabulary, *_ = lblm.vocabulary_of(lblm.token_counts(df))
    assert vocabulary.known[lblm.END] == 3
    assert all(r["n_tokens"] == 41 and r["score"] < 0 for r in lblm.op7_nce(df).collect())


def test_op7_tokens_and_classes_match_a_plain_reading(spark):
    texts = [*(f"A{chr(i)}b{chr(i)}" for i in range(256)), None, "", " \n ", " x  É É\u00a0x\u2003x \x00", "tail\n", "漢字 " * 9]
    want = [[*(t or "").encode().lower().split(), lblm.END] for t in texts]
    distinct, codes, many = lblm._encoded(pa.array(["left out", *texts]).slice(1))
    got = [distinct[i].as_py() for i in codes]
    assert many.tolist() == [len(x) for x in want] and got == [x for w in want for x in w]
    assert lblm._encoded(pa.array([], pa.string()))[2].tolist() == []
    v = lblm.Vocabulary({lblm.END: 1, b"x": 2, b"tail": 3}, {b"ab": 4, b"a": 5, "漢".encode()[:2]: 6}, {}, np.ones(8))
    assert v.classes(distinct).tolist() == [v.of(t) for t in distinct.to_pylist()]
    ids, at = lblm._classes(v.classes(distinct), codes, many)
    assert ids.tolist() == [i for w in want for i in (0, 0, *map(v.of, w))] and np.array_equal(at, np.flatnonzero(ids))


def test_op7_trains_with_few_python_calls_for_its_tokens(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{j * j % (97 + i)}" for j in range(2000))) for i in range(50)], "doc_id long, text string")
    vocabulary, *_ = lblm.vocabulary_of(lblm.token_counts(df))

    class Caught:  # keeps what the tasks would run
        sparkSession = spark
        select = groupBy = agg = lambda self, *_: self
        collect = lambda self: []

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    lblm.fit(caught := Caught(), vocabulary)
    batch, calls = pa.RecordBatch.from_pydict({"text": [r["text"] for r in df.collect()]}), Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        out = list(caught.run(iter([batch])))
    finally:
        sys.setprofile(None)
    assert out[0].column("n")[0].as_py() == 50 * 2001
    assert calls["call"] + calls["c_call"] < 50 * 2001 / 4


def test_op8_and_op9_match_their_sql(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        got = queries.QUERIES[name](spark, SMALL)
        want = con.execute(sql).df()[got.columns].sort_values("doc_id").astype(str).values.tolist()
        assert got.toPandas().sort_values("doc_id").astype(str).values.tolist() == want


def test_op9_short_items_and_overlaps(spark, odd):
    docs = spark.createDataFrame([(1, "A B c d e f g h i j k l m"), (2, "x one TWO three y"), (3, None), (4, "b c d e f g h i j")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(10, "a b c d e f g h i j k l"), (11, "one two three"), (12, ""), (None, "x"), (13, None), (14, "a-b,c d e f g h i j")],
                                  "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in winnow.op9_winnow(docs, items).collect()}
    assert got == {1: (13, 12, 2), 2: (5, 3, 1), 3: (0, 0, 0), 4: (9, 0, 0)}


def test_op10_targets_and_copies(docs, texts):
    rows = entropy.op10_entropy(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = {d: len(WORD.findall(t)) for d, t in texts.items()}
    total = Counter()
    for d in texts:
        total[source[d]] += size[d]
    names = sorted(total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, free, left = {}, set(names), 1.5 * sum(total.values())
    while True:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * rate > 2 * total[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * total[s]
            left -= want[s]
        free -= over
    want |= {s: weight[s] * rate for s in free}
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s])
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 40 for s in names)
    assert sorted(entropy.op10_entropy(docs).collect()) == sorted(rows)


OPS = {name: lambda d, lab, bench, q=name: {
    "op1": syncmers.op1_syncmers, "op2": kdtree.op2_kdtree, "op3": lambda x: toxicity.op3_toxicity(x, lab), "op4": pii.op4_crf,
    "op5": licenses.op5_licenses, "op6": simhash.op6_simhash, "op7": lblm.op7_nce, "op8": lines.op8_lines,
    "op9": lambda x: winnow.op9_winnow(x, bench), "op10": entropy.op10_entropy}[q](d)
    for name in ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10")}


@pytest.mark.parametrize("name", OPS)
def test_odd_rows_and_empty_tables(spark, odd, empty, name):
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (None, None), (5, None)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "with lines and more"), (2, None)], "item_id long, text string")
    rows = OPS[name](odd, labels, bench).collect()
    if name != "op5":
        key = lambda x: (x is None, x)
        assert sorted((r["doc_id"] for r in rows), key=key) == sorted((r[0] for r in ODD), key=key)
    assert OPS[name](empty, labels.limit(0), bench.limit(0)).collect() == []


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    cols, before = docs.columns, docs
    for name, stage in p.STAGES[:4]:
        after = p.cut(stage(spark, before, SMALL))
        assert after.columns == cols
        if name == "simhash_near_dedup":
            fps = {r["doc_id"]: brute_simhash(r["text"]) for r in before.collect()}
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(brute_groups(fps).values()))
        if name == "benchmark_decontamination":
            bad = {r["doc_id"] for r in winnow.op9_winnow(before, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect() if r["contaminated"]}
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - bad
        before = after
    last = p.STAGES[4][1](spark, before, SMALL).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(r["doc_id"] for r in before.collect())
    assert len({(r["shard"], r["slot"]) for r in last}) == len(last)


def test_row_numbers_hold_when_a_scan_is_split_otherwise(spark, docs, odd, tmp_path):
    docs.repartition(3).write.parquet(path := str(tmp_path / "docs"))
    least = "spark.sql.files.minPartitionNum"
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    numbers, kept = [], []
    for first, second in (("1", "40"), ("40", "1")):
        spark.conf.set(least, first)
        rows = numbered(spark.read.parquet(path))
        numbers.append({r[ROW]: r["doc_id"] for r in rows.collect()})
        # Decisions made in one read meet the texts of the next.
        cuts = lines.repeated_lines(rows.select("doc_id", "text", F.col(ROW).alias("row")))
        found = {r["row"]: r["doc_id"] for r in cuts.join(rows.select(F.col(ROW).alias("row"), "doc_id"), "row").collect()}
        spark.conf.set(least, second)
        again = {r[ROW]: r["doc_id"] for r in numbered(spark.read.parquet(path)).collect()}
        assert again == numbers[-1] and all(again[r] == d for r, d in found.items())
        kept.append({r["doc_id"]: r["kept_sha256"] for r in lines.op8_lines(spark.read.parquet(path)).collect()})
    spark.conf.unset(least)
    assert numbers[0] == numbers[1] and sorted(numbers[0].values()) == sorted(texts) and kept[0] == kept[1]
    # What is no plain scan of Parquet files is written once.
    for df in (odd, docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("x")), docs.union(docs), docs.where(F.rand(1) < .5)):
        rows = numbered(df)
        assert rows.count() == rows.select(ROW).distinct().count()
        assert "parquet" in rows._jdf.queryExecution().optimizedPlan().toString() and rows.inputFiles() != docs.inputFiles()


def test_op3_keeps_rare_strong_words_beside_many_frequent_ones(spark):
    # 2,400 words in half of the toxic texts and a fifth of the clean ones have more evidence than a rare word of toxic texts alone.
    frequent = {toxicity.fold(f"word{a}{b}{c}") for a in "bcdfgh" for b in "abcdefghijklmnopqrstu" for c in "bcdfghjkmnpqrstuvwxy"}
    assert len(frequent) == 2_400
    many = " ".join(frequent)
    rows = [(1, f"{many if i < 150 else ''} {'zonk' if i < 30 else ''}") for i in range(300)]
    rows += [(0, many if i < 600 else "a pathetic day") for i in range(3_000)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "toxic long, text string").repartition(8))
    assert frequent <= set(lexicon) and lexicon["zonk"] == 6.0
    assert lexicon["pathetic"] == 0.5


def test_op3_lets_no_weak_word_in_for_its_many_texts(spark):
    rows = spark.range(40_000).selectExpr("id % 2 AS toxic", "IF(id % 100 < IF(id % 2 = 1, 53, 47), 'often', 'other') AS text")
    assert "often" not in toxicity.learn_lexicon(rows)


def test_op5_finds_every_template_and_no_other_license(spark):
    given = [(name, part) for name, parts in licenses.TEMPLATES.items() for part in parts]
    rows = [(6 * i + lead, " ".join([f"w{i}x{j}" for j in range(17 + lead)]) + f" {part}" + lead % 2 * " and then some more words of another kind")
            for i, (_, part) in enumerate(given) for lead in range(6)]
    rows += [(-1, "Copyright 2020 A. Author. All Rights Reserved"), (-2, "all the rights were reserved")]
    found = defaultdict(set)
    for r in licenses.op5_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect():
        found[r["doc_id"]].add(r["license"])
    assert {name for name, _ in given} >= {"all-rights-reserved", "lgpl", "agpl-3.0", "gpl-2.0", "bsd-2-clause", "cc-by-4.0", "cc-by-sa-4.0",
                                           "cc0-1.0", "isc", "epl", "unlicense"}
    assert found == {6 * i + lead: {name} for i, (name, _) in enumerate(given) for lead in range(6)} | {-1: {"all-rights-reserved"}}
