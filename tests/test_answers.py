"""Known answers on small frames, and the refusals."""

import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from grainwise.contract import Binding, DatasetContract, Measure, Rule, Window, columns_of, fingerprint
from grainwise.errors import ContractError, NotPossible, ParamsInvalid, TooManyGroups
from grainwise.evidence import caveats, claims, draft, keys, suggest
from grainwise.functions.exprs import count_where
from grainwise.operators import compare, describe, people, time
from grainwise.profiling import column as one
from grainwise.profiling.evidence import gather, name_words
from grainwise.registry import catalogue, reconcile, run
from grainwise.scope import rule_column, scope_for
from grainwise.sources.names import assemble_names, period_columns, target_names


def known(spark):
    """240 rows, ten a month over two years, with a break, a season and a line in them."""
    i = F.col("id")
    month = F.floor(i / 10)
    return spark.range(240).select(
        i, F.to_timestamp(F.make_date((2023 + F.floor(month / 12)).cast("int"), (month % 12 + 1).cast("int"), (i % 10 + 1).cast("int"))).alias("d"),
        (10 + month).cast("double").alias("tr"), F.when(month < 18, 10.0).otherwise(20.0).alias("cp"),
        F.when(month % 12 == 11, 15.0).otherwise(10.0).alias("se"), i.cast("double").alias("x"), (2 * i + 3).cast("double").alias("ypos"),
        (7 - 3 * i).cast("double").alias("yneg"), F.pow(i - 119.5, 2).alias("z0"), F.concat(F.lit("g"), i % 10).alias("g10"),
        F.when(i % 10 < 2, 100.0).otherwise(6.25).alias("par"), F.when(i % 2 == 0, "a").otherwise("b").alias("h"),
        F.when(i % 10 != 0, 1.0).alias("miss"))


def scope(spark, df=None, **changes):
    df = known(spark) if df is None else df
    names = ("tr", "cp", "se", "x", "ypos", "yneg", "z0", "par", "miss")
    fields = dict(dataset="known", grain="one row", key=("id",), date_column="d", measures=tuple(Measure(n, "sum") for n in names),
                  dimensions=("g10", "h"))
    return scope_for(df, DatasetContract(**{**fields, **changes}))


def test_every_analysis_is_registered():
    assert len(catalogue()) == 27
    assert {a.tier for a in catalogue()} == set(range(1, 8))


def test_trend_and_season(spark):
    s = scope(spark)
    rows = run(s, "trend", measure="tr").orderBy("period").collect()
    assert [r["value"] for r in rows] == [100.0 + 10 * m for m in range(24)]
    season = run(s, "seasonality", measure="se").orderBy(F.col("index").desc()).first()
    assert season["position"] == 12
    assert reconcile(s, run(s, "trend", measure="tr")).count() == 24


def test_break_is_found_where_it_is(spark):
    best = run(scope(spark), "changepoint", measure="cp").orderBy(F.abs("difference").desc()).first()
    assert best["split_after"] == "2024-06" and best["difference"] == 100.0 and best["spread_ratio"] is None


def test_correlations(spark):
    s = scope(spark)
    for against, r in (("ypos", 1.0), ("yneg", -1.0), ("z0", 0.0)):
        row = run(s, "correlation", measure="x", against=against).first()
        assert row["pearson"] == pytest.approx(r, abs=1e-9) and row["pairs"] == 240
    steady = s.source.withColumn("z0", F.lit(1.0))
    assert run(scope(spark, steady), "correlation", measure="x", against="z0").first()["pearson"] is None


def test_two_groups_carry_four_fifths(spark):
    rows = run(scope(spark), "pareto", dimension="g10", measure="par").orderBy("rank").collect()
    assert [r["member"] for r in rows if r["reached"]] == ["g0", "g1"]
    assert rows[1]["running_share"] == pytest.approx(0.8)


def test_mix_shift_of_the_example(spark):
    def rows(month, tier, price, n):
        return [(date(2024, month, 1 + i), tier, price) for i in range(n)]
    data = rows(1, "premium", 100.0, 8) + rows(1, "budget", 10.0, 2) + rows(2, "premium", 110.0, 2) + rows(2, "budget", 12.0, 8)
    df = spark.createDataFrame(data, "ts date, tier string, price double")
    s = scope_for(df, DatasetContract(dataset="mix", grain="a row", date_column="ts", measures=(Measure("price", "mean"),), dimensions=("tier",)))
    total = run(s, "mix_shift", measure="price", dimension="tier", period="2024-02", baseline="2024-01").agg(
        *[F.sum(c).alias(c) for c in ("rate", "mix", "interaction", "contribution")]).first()
    assert (total["rate"], total["mix"], total["interaction"]) == (pytest.approx(8.4), pytest.approx(-54.0), pytest.approx(-4.8))
    assert total["contribution"] == pytest.approx(31.6 - 82.0)


def test_an_absent_month_is_blank_and_an_undated_row_is_counted(spark):
    data = [(1, "2016-09-01", 10.0), (2, "2016-10-01", 20.0), (3, "2016-12-01", 30.0), (4, "2017-01-01", 50.0), (5, None, 9.0)]
    df = spark.createDataFrame(data, "id int, t string, amount double").withColumn("ts", F.to_timestamp("t"))
    s = scope_for(df, DatasetContract(dataset="gaps", grain="a row", date_column="ts", measures=(Measure("amount", "sum"),)))
    rows = {r["period"]: r for r in run(s, "trend", measure="amount").collect()}
    assert rows["2016-11"]["value"] is None and rows["2016-11"]["rows"] == 0
    assert rows["2017-01"]["value"] == 50.0 and len(rows) == 5
    assert time.calendar_edges(s).first()["undated"] == 1


def test_scope_buckets_add_back(spark):
    df = known(spark).withColumn("d", F.when(F.col("id") % 7 != 0, F.col("d")))
    s = scope(spark, df, window=Window(date(2023, 3, 1), date(2024, 2, 29)), exclusions=(Rule("miss is null"),))
    c = s.counted()
    assert sum(c[b] for b in ("excluded", "outside_window", "no_date", "unselected", "filtered", "analysed")) == c["rows"] == 240
    assert s.frame.count() == c["analysed"]


def test_last_second_of_a_window_is_inside(spark):
    df = spark.createDataFrame([("2024-12-31 23:59:59",), ("2025-01-01 00:00:00",)], "t string").select(F.to_timestamp("t").alias("ts"))
    s = scope_for(df, DatasetContract(dataset="w", grain="a row", date_column="ts", window=Window(date(2024, 1, 1), date(2024, 12, 31))))
    assert s.counted()["analysed"] == 1


def test_rules_are_one_boolean_over_the_table(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    df.createOrReplaceTempView("other_rows")
    assert df.agg(count_where(rule_column(df, "b = 'x'")).alias("n")).first()["n"] == 1
    for bad in ("a", "a >", "a > (SELECT max(a) FROM other_rows)", "a IN (SELECT a FROM other_rows)", "c = 1", "", "a > 1; SELECT 1", "sum(a) > 1"):
        with pytest.raises(ParamsInvalid):
            rule_column(df, bad)


def test_refusals(spark):
    s = scope(spark)
    none = scope(spark, measures=(Measure("x", "none"),))
    with pytest.raises(NotPossible):
        run(none, "top_n", dimension="g10", measure="x")
    with pytest.raises(ContractError):
        run(s, "top_n", dimension="nope", measure="x")
    with pytest.raises(ParamsInvalid):
        run(s, "trend", measure="x", grain="fortnight")
    with pytest.raises(ParamsInvalid):
        s.where("x < 0")
    with pytest.raises(ParamsInvalid):
        s.groups("g10", ["g99"])
    with pytest.raises(NotPossible):
        run(s, "pareto", dimension="g10", measure="yneg")
    with pytest.raises(NotPossible):
        people.check_entity(scope(spark, dimensions=("id",)), "id")
    wide = scope(spark, dimensions=("id",))
    # Only a table with a column per member has a limit; a test folds any number of groups.
    with pytest.raises(TooManyGroups):
        describe.cross_tab_wide(scope(spark, dimensions=("id", "h")), "h", "id")
    assert run(wide, "hypothesis_test", dimension="id", measure="x").first()["test"] == "kruskal_wallis"


def test_contract_rules(spark):
    schema = known(spark).schema
    good = DatasetContract(dataset="k", grain="a row", key=("id",), date_column="d", measures=(Measure("x", "sum"),), dimensions=("h",))
    good.check(schema)
    for change in (dict(grain=""), dict(key=("zz",)), dict(date_column="h"), dict(measures=(Measure("h", "sum"),)), dict(dimensions=("x",)),
                   dict(measures=(Measure("x"),)), dict(measures=(Measure("q", compare=("x", ">", "h")),))):
        from dataclasses import replace
        with pytest.raises(ContractError):
            replace(good, **change).check(schema)


def test_fingerprint_is_the_schema_not_the_rows():
    a = (("a", "int"), ("b", "string"))
    assert fingerprint(a) == fingerprint(a) != fingerprint(a[::-1]) and len(fingerprint(a)) == 12


def test_distribution_of_whole_numbers(spark):
    nine = spark.range(90).select((F.col("id") % 9 + 1).alias("v"))
    s = scope_for(nine, DatasetContract(dataset="n", grain="a row", measures=(Measure("v", "sum"),)))
    rows = run(s, "distribution", measure="v", bins=4).orderBy("bin").collect()
    assert [(r["lo"], r["hi"], r["rows"]) for r in rows] == [(1, 4, 30), (4, 7, 30), (7, 9, 30)]
    row = run(s, "summary_stats").first()
    assert (row["mean"], row["median"], row["n"]) == (5.0, 5.0, 90)


def test_share_is_blank_when_it_would_lie(spark):
    df = spark.createDataFrame([("a", -5.0), ("b", 10.0)], "g string, v double")
    s = scope_for(df, DatasetContract(dataset="s", grain="a row", measures=(Measure("v", "sum"),), dimensions=("g",)))
    assert [r["share"] for r in run(s, "top_n", dimension="g", measure="v").collect()] == [None, None]
    assert {r["member"]: r["share"] for r in compare.group_compare(s, "g", "v").collect()} == {"a": None, "b": None, None: None}


def test_medians_of_cells_and_margins(spark):
    s = scope(spark, measures=(Measure("mid", "median", column="x"),))
    rows = [(r["g10"], r["h"], r["x"]) for r in s.frame.select("g10", "h", "x").collect()]
    got = {(r["row_member"], r["column_member"], r["is_row_total"], r["is_column_total"]): (r["value"], r["rows"])
           for r in run(s, "cross_tab", rows="g10", columns="h", measure="mid").collect()}
    want = {}
    for g, h, x in rows:
        for key in ((g, h, False, False), (g, None, True, False), (None, h, False, True), (None, None, True, True)):
            want.setdefault(key, []).append(x)
    assert got == {k: (pytest.approx(statistics.median([x for x in v if x is not None])), len(v)) for k, v in want.items()}


@pytest.mark.parametrize("agg, total", [("median", 3.0), ("mean", 3.0), ("sum", 9.0), ("min", 1.0), ("max", 5.0)])
def test_every_aggregate_is_over_finite_values(spark, agg, total):
    odd = [float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([("a", v, "k") for v in [1.0, 3.0, 5.0, *odd]], "g string, v double, h string")
    s = scope_for(df, DatasetContract(dataset="s", grain="a row", measures=(Measure("v", agg),), dimensions=("g", "h")))
    assert {(r["total"], r["median"]) for r in run(s, "group_compare", dimension="g", measure="v").collect()} == {(total, 3.0)}
    assert [r["total"] for r in run(s, "top_n", dimension="g", measure="v").collect()] == [total]
    assert {r["value"] for r in run(s, "cross_tab", rows="g", columns="h", measure="v").collect()} == {total}
    assert run(s, "summary_stats").first()["total"] == total


def test_ranking_shift_places_any_number_of_members(spark):
    start = date(2024, 1, 1)
    rows = [(f"m{i:03d}", start + timedelta(days=40 * side), float((i * 37) % 101 + side * i)) for i in range(120) for side in (0, 1) if (i + side) % 7]
    df = spark.createDataFrame(rows, "g string, d date, v double")
    s = scope_for(df, DatasetContract(dataset="s", grain="a row", measures=(Measure("v", "sum"),), dimensions=("g",), date_column="d"))
    got = {r["member"]: (r["rank_before"], r["rank_after"]) for r in run(
        s, "ranking_shift", dimension="g", measure="v", before_start="2024-01-01", before_end="2024-01-31",
        after_start="2024-02-01", after_end="2024-02-29").collect()}
    place = [{g: n for n, (g, _, _) in enumerate(sorted((r for r in rows if (r[1] > start) == late), key=lambda r: (-r[2], r[0])), 1)}
             for late in (False, True)]
    assert got == {g: (place[0].get(g), place[1].get(g)) for g in {r[0] for r in rows}}


def test_non_finite_values_are_set_aside(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("a", float("inf")), ("a", None)], "g string, v double")
    s = scope_for(df, DatasetContract(dataset="s", grain="a row", measures=(Measure("v", "mean"),), dimensions=("g",)))
    row = run(s, "summary_stats").first()
    assert (row["n"], row["nulls"], row["mean"], row["max"]) == (4, 1, 2.0, 3.0)


def test_a_null_parent_hides_nothing(spark):
    from grainwise.validation.checks import reference
    parent = spark.createDataFrame([("A",), ("B",), (None,)], "k string")
    child = spark.createDataFrame([("A",), ("B",), ("C",), (None,)], "k string")
    row = reference(child, parent, ("k",), ("k",), 0, "p").first()
    assert (row["outcome"], row["failed"], row["not_checked"], row["passed"]) == ("FAIL", 1, 1, 2)
    assert row["evidence"] == ["C x1"]


def test_keys_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    single, pair = keys.verify(df, ["b"]).first(), keys.verify(df, ["a", "b"]).first()
    assert (single["keyed_rows"], single["distinct"], single["null_rows"], single["holds"]) == (1, 1, 2, False)
    assert (pair["keyed_rows"], pair["distinct"], pair["duplicates"]) == (3, 2, 1)
    assert keys.exact_copies(df).first()["copies"] == 1


def test_drift_classes(spark):
    df = spark.createDataFrame([(1, "a")], "id int, g string")
    bound = DatasetContract(dataset="d", grain="a row", dimensions=("g",), binding=Binding(columns_of(df.schema), 1))
    drift = lambda t: draft.schema_drift(bound, t).first()["drift"]
    assert drift(df) == "IDENTICAL" and drift(df.unionAll(df)) == "NEUTRAL"
    assert drift(df.withColumn("n", F.lit(1))) == "ADDITIVE" and drift(df.drop("id")) == "ADDITIVE" and drift(df.drop("g")) == "DESTRUCTIVE"


def test_names():
    assert assemble_names([["Id", "", "Qty", ""], ["a", "b", "b", ""]], join="space", fill=True) == ["Id a", "Id b", "Qty b", "Qty"]
    assert assemble_names([["a", "a", "", "a"]]) == ["a", "a_2", "column_3", "a_3"]
    assert target_names(["% of total", "2024", "", "A b", "a-B"]) == ["pct_of_total", "col_2024", "unnamed", "a_b", "a_b_2"]
    assert period_columns(["region", "Jan", "Feb", "Mar"]) == ["Jan", "Feb", "Mar"] and not period_columns(["a", "b", "Jan"])
    assert "onhand" in name_words("stockOnHand") and "stock" in name_words("stockOnHand")


def test_histogram_edges_are_round():
    assert one.nice_edges(1.5, 198.7, 20)[:3] == [10.0, 20.0, 30.0]
    assert one.nice_edges(17, 17.5, 10)[:2] == [17.05, 17.1] and one.nice_edges(5, 5, 10) == [5]


def test_claims_in_caveats(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (5, None)], "qty int, note string")
    got = {r["caveat"]: r["status"] for r in claims.check_caveats(df, [
        "1 duplicate row", "qty < 2 in 2 rows", "note is 'x' in 3 rows", "note is blank in 1 row", "note is '-' in 4 rows", "all fine"]).collect()}
    assert list(got.values()) == ["agrees", "agrees", "differs", "agrees", "unchecked", "unchecked"]


def test_blanks_are_explained_by_the_value_that_has_them(spark):
    df = spark.range(200).select(F.col("id"), F.when(F.col("id") % 4 == 0, "Store").otherwise("Web").alias("channel"),
                                 F.when(F.col("id") % 4 != 0, F.col("id")).alias("fee"))
    found = caveats.blanks(df, gather(df))
    assert [(b.columns, b.rows, b.explained_by) for b in found] == [(("fee",), 50, ("channel = 'Store'",))]


def test_results_do_not_depend_on_partitioning(spark):
    plain, shuffled = known(spark), known(spark).orderBy(F.rand(3)).repartition(13)
    for name, params in (("top_n", dict(dimension="g10", measure="par")), ("cohort_retention", dict(entity="g10")),
                         ("repeat_behaviour", dict(entity="g10")), ("group_compare", dict(dimension="h", measure="x"))):
        rows = [sorted(map(str, run(scope(spark, df), name, **params).collect())) for df in (plain, shuffled)]
        assert rows[0] == rows[1]
    assert describe.top_n_ties(scope(spark), "g10", "par", 1).first()["tied"] == 2


def test_caveats_are_read_token_by_token(spark):
    from grainwise.evidence import claims
    df = spark.createDataFrame([(1, "F", 2.5), (2, "O", 7.0), (3, None, 9.0)], "k long, `order state` string, price double")
    said = {"price > 2.5 in 2 rows": "comparison", "'order state' is 'F' in 1 row": "quoted", "order state is missing in 1 row": "blank",
            "0 duplicate rows": "duplicates", "k and price are blank in 0 rows": "unchecked", "order state is 'F' or 'O' in 2 rows": "unchecked",
            "prices include tax": "unchecked"}
    for r in claims.check_caveats(df, list(said)).collect():
        assert r["shape"] == said[r["caveat"]], r
        assert r["status"] == ("unchecked" if r["shape"] == "unchecked" else "agrees"), r


def test_a_ratio_that_is_rarely_there_is_found(spark):
    i = F.col("id")
    df = spark.range(20_000).select((i % 97 + 3).cast("double").alias("a"), (i % 89 + 2).cast("double").alias("b"),
                                    F.when(i % 200 == 0, (i % 97 + 3) / (i % 89 + 2)).otherwise(0.0).alias("r"))
    found = suggest.ratio_of(df, ["r"], ["a", "b", "r"])
    assert (found["r"]["label"], found["r"]["rows"], found["r"]["hits"]) == ("a / b", 100, 100)


def test_every_pair_of_columns_is_probed(spark, monkeypatch):
    df = spark.range(400).select(*[(F.floor(F.col("id") / 20) if i == 7 else F.col("id") % 20 if i == 9 else F.floor(F.col("id") / 2) % 50).cast("string").alias(f"c{i}")
                                   for i in range(10)])
    monkeypatch.setattr(keys, "PAIRS_AT_ONCE", 2)
    got = {(r["first"], r["second"]) for r in keys.key_pairs(df).where("is_unique").collect()}
    assert got == {("c7", "c9")}


def test_missing_days_and_the_longest_gap(spark):
    days = [date(2024, 1, d) for d in (1, 2, 5, 6, 11)]
    df = spark.createDataFrame([(d,) for d in days for _ in range(3)] + [(None,)], "d date")
    row = one.date_coverage(df, "d").first()
    assert (row["days_in_span"], row["days_present"], row["days_missing"], row["longest_gap"]) == (11, 5, 6, 4)
