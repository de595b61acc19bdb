"""Table operations on small literal tables: the cases that the queries' SQL doesn't reach."""

import hashlib
import hmac
import math
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import OPERATIONS, aggregates, apply
from tesserae.operators.quality import with_metadata
from tesserae.relation import ORD, PlanError, report, with_order


@pytest.fixture(scope="module")
def unary(spark):
    rows = [(1, 3.0, True, "b", " Alpha ", "2024-01-05"), (2, 1.0, False, "a", "2", "05/01/2024"), (2, 1.0, None, "a", "bad", "05-01-2024"), (4, None, True, "b", None, None), (None, 5.0, False, None, "false", "2024/02/29")]
    df = spark.createDataFrame(rows, "id long, num double, flag boolean, group string, text string, date string")
    return df.withColumn(ORD, F.monotonically_increasing_id())


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def refused(df):
    with pytest.raises(Exception, match="rejected"):
        df.collect()


def test_the_catalogue_is_complete():
    names = list(OPERATIONS)
    assert sum(n.startswith("table.") for n in names) == 71 and sum(n.startswith("geo.") for n in names) == 75


def test_filters_know_null_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, -0.0)], "id long, x double")
    ids = lambda **c: [r.id for r in apply("table.filter", df, column="x", **c).orderBy("id").collect()]
    assert ids(operator=">", value=-5) == [1, 4] and ids(operator="==", value="NaN") == [2] and ids(operator="isnull") == [3]
    assert ids(operator="==", value=0) == [4] and ids(operator="!=", value=1) == [2, 4] and ids(operator="between", value="-1,0.5") == [4]
    big = spark.createDataFrame([(2**53 + 1,), (2**53,)], "n long")
    assert [r.n for r in apply("table.filter", big, column="n", operator="==", value=str(2**53 + 1)).collect()] == [2**53 + 1]
    with pytest.raises(PlanError):
        apply("table.filter", df, column="x", operator=">", value="many")


def test_unknown_names_and_options_are_refused(unary):
    for op, config in [("table.select_columns", {"columns": ["nope"]}), ("table.select_columns", {"columns": []}), ("table.rename", {"renames": [{"old_name": "id", "new_name": "num"}]}), ("table.filter", {"column": "id", "operator": "~"}), ("table.limit", {"n": 1, "more": 2}), ("table.nothing", {})]:
        with pytest.raises(PlanError):
            apply(op, unary, **config)


def test_statistics_of_a_group_without_values(unary):
    out = apply("table.statistics", unary.withColumn("num", F.when(F.col("group") == "b", F.lit(None)).otherwise(F.col("num"))), column="num", group_by="group", stats=["count", "mean"])
    assert rows(out, "group", "num_count", "num_mean") == sorted([("a", 2.0, 1.0), ("a", 2.0, 1.0), ("b", None, None), ("b", None, None), (None, 1.0, 5.0)], key=repr)


def test_aggregates_keep_positions_and_nulls(unary):
    out = apply("table.aggregate", unary, group_by=["group"], aggregations=[{"column": "text", "function": "first", "output": "f"}, {"column": "text", "function": "last", "output": "l"}, {"column": "num", "function": "sum", "output": "s", "skip_null": False}, {"column": "id", "function": "nunique", "output": "n", "skip_null": False}, {"column": "num", "function": "concat", "output": "c"}, {"column": "num", "function": "stddev", "output": "d"}])
    assert rows(out, "group", "f", "l", "s", "n", "c", "d") == sorted([("a", "2", "bad", 2.0, 1, "1,1", 0.0), ("b", " Alpha ", None, None, 2, "3", None), (None, "false", "false", 5.0, 1, "5", None)], key=repr)


def test_window_ranks_with_ties(spark):
    df = with_order(spark.createDataFrame([(k, v) for k, v in enumerate([10.0, 20.0, 20.0, 40.0, None])], "k long, v double"), "k")
    get = lambda f, **c: [r.w for r in apply("table.window_function", df, column="v", function=f, output_column="w", **c).orderBy("k").collect()]
    assert get("percent_rank") == [0, 1 / 3, 1 / 3, 1, None] and get("cume_dist") == [0.25, 0.75, 0.75, 1, None]
    assert get("rank") == [1, 2.5, 2.5, 4, None] and get("dense_rank") == [1, 2, 2, 3, None]
    assert get("cumsum") == [10, 30, 50, 90, None] and get("ntile", buckets=2) == [1, 1, 1, 2, 2] and get("lag") == [None, 10, 20, 20, 40]


def test_windows_without_groups_are_those_of_one_group(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "STRETCH", 16)
    r = random.Random(3)
    rows = [(k, None if r.random() < 0.1 else float(r.randrange(12)), "a") for k in range(300)]
    df = with_order(spark.createDataFrame(rows, "k long, v double, g string").repartition(5), "k")
    for f in sorted(aggregates.FUNCTIONS):
        for more in ({}, {"offset": 3}, {"offset": -2}) if f in ("lag", "lead", "pct_change") else ({},):
            one, all_ = (apply("table.window_function", df, column="v", function=f, output_column="w", **more, **g) for g in ({"group_by": "g"}, {}))
            assert all_.columns == one.columns
            want, got = ([r.w for r in x.orderBy("k").collect()] for x in (one, all_))
            assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(want, got, strict=True)), (f, more)
    for f in ("sum", "mean", "min", "max", "stddev"):
        for window in (1, 4, 40):
            one, all_ = (apply("table.rolling_window", df, column="v", function=f, window=window, output_column="w", **g) for g in ({"group_by": "g"}, {}))
            want, got = ([r.w for r in x.orderBy("k").collect()] for x in (one, all_))
            assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-6) for a, b in zip(want, got, strict=True)), (f, window)


def test_asof_without_keys_is_that_of_one_key(spark):
    r = random.Random(5)
    left = with_order(spark.createDataFrame([(k, None if k % 50 == 7 else float(r.randrange(100)), "a") for k in range(200)], "id long, t double, g string").repartition(3), "id")
    right = with_order(spark.createDataFrame([(k, float(r.choice([r.randrange(100), 20])), "a") for k in range(60)], "n long, t double, g string").repartition(3), "n")
    for direction in ("backward", "forward", "nearest"):
        for more in ({}, {"allow_exact": False}, {"tolerance": 2.0}):
            one, all_ = ({x.id: x.n for x in apply("table.asof_join", left, right, left_on="t", right_on="t", direction=direction, **more, **by).collect()} for by in ({"left_by": ["g"], "right_by": ["g"]}, {}))
            assert one == all_, (direction, more)


def test_fill_runs_over_many_ranges(spark):
    n = 500
    df = with_order(spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 37 == 5, F.col("id").cast("double")).alias("v")).repartition(7), "k")
    for method, want in (("ffill", lambda k: next((float(j) for j in range(k, -1, -1) if j % 37 == 5), None)), ("bfill", lambda k: next((float(j) for j in range(k, n) if j % 37 == 5), None))):
        out = {r.k: r.v for r in apply("table.fill_na", df, column="v", method=method).collect()}
        assert out == {k: want(k) for k in range(n)}
    numbers = {r.k: r.row_number for r in apply("table.add_row_number", df).collect()}
    assert numbers == {k: k + 1 for k in range(n)}
    assert apply("table.add_row_number", df.limit(0)).count() == 0


def test_casts_refuse_what_they_cannot_read(unary):
    refused(apply("table.type_cast", unary, column="text", target_type="float"))
    refused(apply("table.type_cast", unary.where("num = 3").withColumn("num", F.lit(1.5)), column="num", target_type="int"))
    dates = apply("table.type_cast", unary, column="date", target_type="date32")
    assert {str(r.date) for r in dates.collect()} == {"2024-01-05", "None", "2024-02-29"}
    spoken = apply("table.type_cast", unary.select(F.explode(F.array(F.lit("SI"), F.lit("no"), F.lit("1"))).alias("b")), column="b", target_type="bool")
    assert {r.b for r in spoken.collect()} == {True, False}


def test_texts(spark):
    df = spark.createDataFrame([("  Élan  vital-x2 ", "a-b-c"), (None, None)], "t string, s string")
    normal = lambda how: apply("table.text_normalize", df, columns=["t"], operations=how).first().t
    assert normal("full") == "elan vital-x2" and normal("title") == "  Élan  Vital-X2 " and normal("strip_accents") == "  Elan  vital-x2 "
    parts = apply("table.split_column", df, column="s", new_columns=["p", "q"], delimiter="-").collect()
    assert [(r.p, r.q) for r in parts] == [("a", "b-c"), (None, None)]
    named = apply("table.string_extract", df, column="s", pattern=r"(?P<one>\w)-(?P<two>\w)").first()
    assert (named.one, named.two) == ("a", "b")
    with pytest.raises(PlanError):
        apply("table.string_extract", df, column="s", pattern=r"(a)\1")
    assert apply("table.string_pad", df, column="s", width=3, side="left").first().s == "a-b-c"


def test_float_texts_and_hashes(spark, monkeypatch):
    df = spark.createDataFrame([(1.0, "A "), (1e20, None), (0.1, "b")], "x double, t string")
    out = apply("table.concat_columns", apply("table.type_cast", df, column="x", target_type="str"), columns=["x", "t"], output_column="j", separator="|", skip_null=False)
    assert [r.j for r in out.collect()] == ["1|A ", "100000000000000000000|", "0.1|b"]
    md5 = apply("table.md5_hash", df, columns=["t", "x"]).collect()
    assert md5[0].hash == hashlib.md5("a\u001f1".encode()).hexdigest() and md5[1].hash == hashlib.md5("\u001f100000000000000000000".encode()).hexdigest()
    monkeypatch.setenv("A_KEY", "secret")
    signed = apply("table.hmac_sha256", df, columns=["t"], key_env="A_KEY", null_policy="null").collect()
    assert signed[0].hmac == hmac.new(b"secret", b"A ", hashlib.sha256).hexdigest() and signed[1].hmac is None
    with pytest.raises(PlanError):
        apply("table.hmac_sha256", df, columns=["t"], key_env="NO_KEY_HERE")
    refused(apply("table.sha256_hash", df, columns=["t"], null_policy="reject"))
    assert len({r.fingerprint for r in apply("table.stable_fingerprint", df).collect()}) == 3


def test_masks(spark):
    df = spark.createDataFrame([("jane@site.org", "+39 333 1234567", "ABCDEF80A01H501U")], "m string, p string, c string")
    r = apply("table.mask_data", df, maskings=[{"column": "m", "type": "email"}, {"column": "p", "type": "phone"}, {"column": "c", "type": "cf"}]).first()
    assert tuple(r) == ("j***@site.org", "+39******4567", "ABC**********01U")


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-31 10:00:00",)], "d string")
    add = lambda n, u: apply("table.date_add", df, column="d", input_format="%Y-%m-%d %H:%M:%S", amount=n, unit=u, output_column="o").first().o
    assert add(1, "months") == "2024-02-29" and add(-1, "years") == "2023-01-31" and add(2, "weeks") == "2024-02-14"
    zone = lambda t, **c: apply("table.timezone_convert", spark.createDataFrame([(t,)], "d string"), column="d", input_format="%Y-%m-%d %H:%M:%S", source_timezone="Europe/Rome", target_timezone="UTC", output_column="o", **c)
    assert zone("2024-07-01 12:00:00").first().o == "2024-07-01 10:00:00"
    refused(zone("2024-03-31 02:30:00"))
    refused(zone("2024-10-27 02:30:00"))
    refused(apply("table.date_extract", spark.createDataFrame([("no date",)], "d string"), column="d"))


def test_formulas(unary):
    f = lambda text: apply("table.formula", unary, new_column="r", formula=text).orderBy(ORD)
    assert [r.r for r in f("-(num + 1) * 2 / 4").collect()] == [-2.0, -1.0, -1.0, None, -3.0]
    assert f("'n=' + num").first().r == "n=3"
    refused(f("num / (id - id)"))
    for bad in ("num +", "num + flag", "(num", "nope * 2", "num $ 2"):
        with pytest.raises(PlanError):
            f(bad)


def test_expressions(unary):
    e = lambda tree, **c: [r.r for r in apply("table.expression", unary, output_column="r", expression=tree, **c).orderBy(ORD).collect()]
    column = lambda n: {"column": n}
    assert e({"binary": "or", "left": column("flag"), "right": {"unary": "is_null", "operand": column("num")}}) == [True, False, None, True, False]
    assert e({"function": "greatest", "arguments": [column("num"), {"literal": 2}]}) == [3, 2, 2, None, 5]
    assert e({"function": "in", "arguments": [column("group"), {"literal": "a"}, {"literal": None}]}) == [False, True, True, False, None]
    assert e({"function": "substring", "arguments": [column("text"), {"literal": 1}, {"literal": 3}]})[0] == "Alp"
    assert e({"function": "contains", "arguments": [column("text"), {"literal": "alpha"}]})[0] is False
    for bad in ({"binary": "divide", "left": column("num"), "right": {"literal": 0}}, {"function": "nope", "arguments": []}, {"binary": "add", "left": column("text"), "right": column("num")}, {"function": "year", "arguments": []}):
        with pytest.raises(PlanError):
            e(bad)


def test_expressions_divide_by_0_as_asked(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (float("nan"), 0.0), (None, 0.0), (1.0, None), (1.0, 4.0), (1e300, 1e-300)], "a double, b double")
    tree = {"binary": "divide", "left": {"column": "a"}, "right": {"column": "b"}}
    got = [r.r for r in apply("table.expression", df, output_column="r", expression=tree, non_finite="keep").collect()]
    assert str(got) == "[inf, -inf, -inf, nan, nan, None, None, 0.25, inf]"
    for rows in (df.where("b = 0"), df.where("a > 2")):
        with pytest.raises(Exception, match="rejected: evaluation"):
            apply("table.expression", rows, output_column="r", expression=tree).collect()
    with pytest.raises(PlanError):
        apply("table.expression", df, output_column="r", expression=tree, non_finite="drop")


def test_joins_with_null_keys(spark):
    left = spark.createDataFrame([(1, "old"), (2, "same"), (3, "gone"), (None, "n")], "id long, value string")
    right = spark.createDataFrame([(1, "new"), (2, "same"), (4, "added"), (None, "m")], "id long, value string")
    keys = {"left_keys": ["id"], "right_keys": ["id"]}
    assert apply("table.join", left, right, how="outer", **keys).count() == 6
    assert rows(apply("table.anti_join", left, right, **keys), "id") == [(3,), (None,)]
    diff = {r.id: (r._diff_status, r._diff_old_values) for r in apply("table.table_diff", left.dropna(), right.dropna(), compare_columns=["value"], **keys).collect()}
    assert diff == {1: ("MODIFIED", "old"), 3: ("DELETED", ""), 4: ("ADDED", "")}
    refused(apply("table.table_diff", left.dropna().union(left.dropna()), right, **keys))
    refused(apply("table.assert_foreign_key", left, right, **keys))
    refused(apply("table.assert_foreign_key", left.dropna(), right, **keys))
    with pytest.raises(PlanError):
        apply("table.join", left, right, left_keys=["id"], right_keys=["value"])


def test_asof_ties_and_tolerance(spark):
    left = with_order(spark.createDataFrame([(1, 1.0), (2, 4.0), (3, 7.0), (4, float("nan")), (5, None)], "id long, time double"), "id")
    right = with_order(spark.createDataFrame([(1, 2.0, "a"), (2, 6.0, "b"), (3, 6.0, "c"), (4, 9.0, "d")], "n long, time double, label string"), "n")
    get = lambda **c: [r.label for r in apply("table.asof_join", left, right, left_on="time", right_on="time", **c).orderBy("id").collect()]
    assert get() == [None, "a", "c", None, None] and get(direction="forward") == ["a", "b", "d", None, None]
    assert get(direction="nearest") == ["a", "a", "c", None, None] and get(tolerance=1.0) == [None, None, "c", None, None]
    same = with_order(spark.createDataFrame([(1, 6.0)], "id long, time double"), "id")
    assert apply("table.asof_join", same, right, left_on="time", right_on="time").first().label == "c"
    assert apply("table.asof_join", same, right, left_on="time", right_on="time", allow_exact=False).first().label == "a"


def test_fuzzy_metrics(spark):
    a = with_order(spark.createDataFrame([(1, "martha"), (2, "dixon"), (3, "jelly beans")], "id long, k string"), "id")
    b = spark.createDataFrame([("marhta",), ("dicksonx",), ("beans jelly",)], "k string")
    out = {(r.k, r.k_R): r.s for r in apply("table.fuzzy_join", a, b, left_key="k", right_key="k", metric="jaro_winkler", threshold=0.1, blocking="none", score_column="s").collect()}
    assert math.isclose(out["martha", "marhta"], 0.9611, abs_tol=1e-4) and math.isclose(out["dixon", "dicksonx"], 0.8133, abs_tol=1e-4)
    jaccard = apply("table.fuzzy_join", a, b, left_key="k", right_key="k", metric="jaccard", threshold=1.0, blocking="none", how="left").collect()
    assert {r.k: r.k_R for r in jaccard} == {"martha": None, "dixon": None, "jelly beans": "beans jelly"}
    refused(apply("table.fuzzy_join", a, b, left_key="k", right_key="k", metric="jaccard", threshold=1.0, blocking="none", max_candidates=2))


def test_checks(spark, unary):
    refused(apply("table.assert_not_null", unary, columns=["id"]).select("num"))
    refused(apply("table.assert_unique", unary, columns=["id"]))
    refused(apply("table.assert_range", unary.dropna(), column="num", min=2))
    refused(apply("table.assert_regex", unary, column="group", pattern="^[ab]$"))
    assert apply("table.assert_regex", unary, column="group", pattern="^[ab]$", allow_null=True).count() == 5
    refused(apply("table.assert_cardinality", unary, min_rows=6))
    refused(apply("table.assert_cardinality", unary.limit(0), min_rows=1))
    assert apply("table.assert_cardinality", unary, exact_rows=5, max_rows=5).count() == 5
    with pytest.raises(PlanError):
        apply("table.assert_schema", unary, fields=[{"name": "id", "type": "string"}], allow_extra=True)
    with pytest.raises(PlanError):
        apply("table.assert_metadata", with_metadata(unary, owner="x"), expected={"owner": "y"})
    assert report(unary, F.col("id").isNull(), "validation.required_value_missing")["rows"] == 1


def test_reshaping(spark, unary):
    wide = apply("table.pivot", unary, index_col="group", column="id", value_col="num", aggr_func="sum")
    assert set(wide.columns) == {"group", "1", "2", "4"}
    nested = spark.createDataFrame([(1, [1, None]), (2, []), (3, None)], "id long, xs array<long>")
    assert rows(apply("table.explode", nested, column="xs"), "id", "xs") == sorted([(1, 1), (1, None), (2, None), (3, None)], key=repr)
    with pytest.raises(PlanError):
        apply("table.explode", nested, column="xs", empty_policy="drop")
    js = spark.createDataFrame([('{"a": {"b": 1, "c": null}, "d": [1, 2]}',), ('{"d": "x"}',), (None,)], "j string")
    flat = apply("table.flatten_json", js, column="j", max_level=1)
    assert sorted(set(flat.columns) - {"j"}) == ["a.b", "a.c", "d"]
    assert [tuple(r[c] for c in ("a.b", "a.c", "d")) for r in flat.collect()] == [("1", "", "[1,2]"), (None, None, "x"), (None, None, None)]
    refused(apply("table.flatten_json", js.union(spark.createDataFrame([("[1]",)], "j string")), column="j", output_columns=["d"]))
    with pytest.raises(PlanError):
        apply("table.melt", unary, id_columns=["id"], value_columns=["num", "text"])
    mixed = apply("table.melt", unary, id_columns=["id"], value_columns=["num", "text"], type_policy="string")
    assert mixed.count() == 10


def test_sample_is_exact_and_repeatable(spark):
    df = with_order(spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g")), "id")
    a, b = (sorted(r.id for r in apply("table.sample", df, n=50, random_state=1).collect()) for _ in range(2))
    assert a == b and len(a) == 50
    assert apply("table.sample", df, fraction=0.25).count() == 250
    strata = apply("table.sample", df, fraction=0.1, stratify_column="g").groupBy("g").count().collect()
    assert {r["count"] for r in strata} == {33}
