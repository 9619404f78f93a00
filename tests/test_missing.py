"""Missing values, blanks and bad text."""

import pytest
from pyspark.sql import functions as F

from firnline import functions as fn
from firnline.operators import joins, multipart, rows, rules, station, totals
from firnline.operators.summarise import average_repeats, summarise_plots
from firnline.schema import table
from helpers import at, by_key, rows_of, unordered


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_strict_and_skipping_aggregates(spark):
    df = spark.createDataFrame(
        [("full", 1.0), ("full", 3.0), ("gap", 2.0), ("gap", None), ("none", None)],
        table("g:str x:dbl"),
    )
    out = df.groupBy("g").agg(
        fn.strict(F.avg, "x").alias("strict"),
        fn.skip(F.avg, "x").alias("skip"),
        fn.sum_or_zero("x").alias("total"),
        fn.skip(F.max, "x").alias("top"),
    )
    assert unordered(rows_of(out)) == [
        ("full", 2.0, 2.0, 4.0, 3.0),
        ("gap", None, 2.0, 2.0, 2.0),
        ("none", None, None, 0.0, None),
    ]


def test_summary_of_one_row_has_no_sd(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 2, None)], table("p:str n:int d:dbl"))
    out = by_key(summarise_plots(df, ["p"], "d", ["n"]), "p")
    assert (out["a"]["mean_d"], out["a"]["sd_d"], out["a"]["count"]) == (5.0, None, 1)
    assert (out["b"]["mean_d"], out["b"]["med_d"], out["b"]["count"]) == (None, None, 1)


def test_first_row_keeps_a_missing_value(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, None)], table("p:str n:int s:str"))
    assert rows_of(df.groupBy("p").agg(fn.first_by("s", ["n"]))) == [("a", None)]


def test_division_by_zero_is_missing(spark):
    assert one(spark, fn.density(F.lit(5.0), F.lit(0.0), F.lit(1.0), "A")) is None
    assert one(spark, fn.density(F.lit(5.0), F.lit(3.0), F.lit(3.0), "B")) is None
    assert one(spark, fn.density(F.lit(5.0), F.lit(3.0), F.lit(None).cast("double"), "B")) is None
    assert one(spark, fn.density_or_zero(F.lit(0.0), F.lit(0.0))) == 0.0
    with pytest.raises(ValueError):
        fn.density("a", "b", "c", "C")


def test_swe_and_net_mass(spark):
    assert one(spark, fn.swe(F.lit(1630.0))) == pytest.approx(117.651953396722, abs=1e-11)
    assert one(spark, fn.net_mass(F.lit(9810.0), F.lit(8180.0))) == 1630.0
    assert one(spark, fn.net_mass(F.lit(9810.0), F.lit(None).cast("double"))) == 9810.0


@pytest.mark.parametrize(
    "text,number",
    [("12", 12.0), (" 3.50 ", 3.5), ("-1e2", -100.0), (".5", 0.5), ("?", None), ("", None),
     ("NA", None), ("NaN", None), ("Inf", None), ("1d", None), (None, None)],
)
def test_parse_number(spark, text, number):
    assert one(spark, fn.parse_number(F.lit(text).cast("string"))) == number


@pytest.mark.parametrize(
    "text,time",
    [
        ("2021-04-27 13:08:19", at("2021-04-27 13:08:19")),
        ("3/9/2021 9:59", at("2021-03-09 09:59:00")),
        ("12/31/2021 23:05", at("2021-12-31 23:05:00")),
        ("0004-05-20 12:00:00", at("0004-05-20 12:00:00")),
        ("31/31/2021 1:00", None),
        ("soon", None),
        (None, None),
    ],
)
def test_parse_time(spark, text, time):
    assert one(spark, fn.parse_time(F.lit(text).cast("string"))) == time


def test_truncate_goes_toward_zero(spark):
    assert one(spark, fn.truncate(F.lit(-3.9))) == -3
    assert one(spark, fn.truncate(F.lit(1e30))) is None


def test_text_helpers(spark):
    assert one(spark, fn.paste("SR50_", F.lit(None))) == "SR50_NA"
    assert one(spark, fn.digits(F.lit("core -3.b5"))) == "-3.5"
    assert one(spark, fn.core_key(F.lit("Snow scale"))) == "S"
    assert one(spark, fn.core_key(F.lit("Snow scale"), fold=True)) == "s"
    assert one(spark, fn.day_of(F.lit("4/22/2021 9:00"), (3, 1))) == "2"
    direction, distance = fn.decode_position(F.lit("N7.5"))
    assert (one(spark, direction), one(spark, distance)) == ("N", 7.5)
    direction, distance = fn.decode_position(F.lit("Centre"))
    assert (one(spark, direction), one(spark, distance)) == ("Centre", None)


def test_case_when_without_match_is_missing(spark):
    depth = fn.typed_depth(F.lit("Other"), {"Depth": F.lit(1.0), "Density": F.lit(2.0)})
    assert one(spark, depth) is None


FORM = table(
    "plot_id:str cardinal_direction:str multi_core:str t:int depth:dbl core:dbl plug:dbl mass:dbl"
)
META = ["plot_id", "cardinal_direction", "multi_core", "t"]


def resolve(spark, data, **options):
    form = spark.createDataFrame(data, FORM)
    return multipart.resolve_multipart(form, META[:2], META, "A", **options)


def test_parts_that_differ_in_time_repeat_the_core(spark):
    parts = [("p", None, "yes", 1, 200.0, 100.0, 2.0, 500.0), ("p", None, "yes", 2, 210.0, 50.0, None, 400.0)]
    out = resolve(spark, parts)
    assert sorted(rows_of(out, "t", "depth", "core", "plug", "mass")) == [
        (1, 208.0, 150.0, 2.0, 900.0),
        (2, 208.0, 150.0, 2.0, 900.0),
    ]
    first = resolve(spark, parts, metadata="first", order_by=["t"])
    assert rows_of(first, "t", "depth", "mass") == [(1, 208.0, 900.0)]


def test_third_flag_is_dropped_and_missing_flag_is_optional(spark):
    data = [("a", "N", f, 1, 10.0, 1.0, 0.0, 1.0) for f in ("no", None, "maybe")]
    assert unordered(rows_of(resolve(spark, data), "multi_core")) == unordered([(None,), ("no",)])
    assert rows_of(resolve(spark, data, include_unflagged=False), "multi_core") == [("no",)]


def test_bare_ground_core(spark):
    out = resolve(spark, [("a", "N", "no", 1, 4.0, 0.0, 4.0, 0.0)])
    assert rows_of(out, "depth", "swe", "density") == [(0.0, 0.0, None)]


def test_bad_options_are_refused(spark):
    with pytest.raises(ValueError):
        resolve(spark, [], metadata="any")
    with pytest.raises(ValueError):
        resolve(spark, [], metadata="first")


def test_join_matches_missing_keys(spark):
    a = spark.createDataFrame([("p", None), ("p", "N")], table("k:str d:str"))
    b = spark.createDataFrame([("p", None, 1.0), ("p", "S", 2.0)], table("k:str d:str x:dbl"))
    assert unordered(rows_of(joins.natural_left_join(a, b))) == unordered([("p", "N", None), ("p", None, 1.0)])
    plain = joins.left_join(a, b, ["k", "d"], na_matches=False)
    assert unordered(rows_of(plain)) == unordered([("p", "N", None), ("p", None, None)])
    with pytest.raises(ValueError):
        joins.natural_left_join(a.select("k"), b.select("x"))


def test_clashing_names_get_suffixes(spark):
    a = spark.createDataFrame([("p", 1.0)], table("k:str x:dbl"))
    b = spark.createDataFrame([("p", 2.0)], table("k:str x:dbl"))
    out = joins.left_join(a, b, ["k"])
    assert out.columns == ["k", "x_x", "x_y"] and rows_of(out) == [("p", 1.0, 2.0)]


def test_dimension_keeps_rows_without_facts(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], table("k:str x:int"))
    f = spark.createDataFrame([("a", 10), ("a", 11), (None, 12), ("z", 13)], table("k:str x:int"))
    out = joins.dimension_left_join(d, f, ["k"])
    assert out.columns == ["k", "x_x", "x_y"]
    want = [("a", 1, 10), ("a", 1, 11), ("b", 2, None), (None, 3, 12)]
    assert unordered(rows_of(out)) == unordered(want)


def test_keep_and_missing_values(spark):
    df = spark.createDataFrame([("4", 1), ("5", 2), (None, 3)], table("c:str n:int"))
    assert rows_of(rows.keep(df, not_equal={"c": 4}), "n") == [(2,)]
    assert unordered(rows_of(rows.keep(df, not_in={"c": ["4"]}), "n")) == unordered([(2,), (3,)])
    assert rows_of(rows.keep(df, not_null=["c"], equals={"n": 1}), "c") == [("4",)]
    assert rows_of(rows.keep(df, not_equal={"n": "2"}, not_null=["c"]), "n") == [(1,)]
    assert rows.keep(df) is df


def test_time_bound_is_strict(spark):
    df = spark.createDataFrame(
        [(at("2021-05-12 00:00:00"),), (at("2021-05-12 00:00:01"),), (None,)], table("t:time")
    )
    assert rows_of(rows.keep(df, after={"t": "2021-05-12 00:00:00"})) == [(at("2021-05-12 00:00:01"),)]


def test_column_ranges(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert rows.col_range(df, "b:d").columns == ["b", "c", "d"]
    assert rows.col_range(df, "d:b").columns == ["d", "c", "b"]
    assert rows.col_range(df, "c:d", "a", drop=["d"]).columns == ["c", "a"]
    assert rows.drop_cols(df, "a", "c").columns == ["b", "d"]


def test_align_types_absent_columns(spark):
    df = spark.createDataFrame([("1",)], "a string")
    out = rows.align(df, table("a:int b:dbl c:str"), c="set")
    assert out.dtypes == [("a", "int"), ("b", "double"), ("c", "string")]
    assert rows_of(out) == [(1, None, "set")]


def test_slices(spark):
    df = spark.range(1, 401).repartition(7)
    assert rows_of(rows.slice_rows(df, 1, 1, ["id"])) == [(1,)]
    assert unordered(rows_of(rows.slice_rows(df, 95, 130, ["id"]))) == unordered([(i,) for i in range(95, 131)])
    assert unordered(rows_of(rows.slice_rows(df, 293, None, ["id"]))) == unordered([(i,) for i in range(293, 401)])
    assert rows_of(rows.slice_rows(df, 500, None, ["id"])) == []
    with pytest.raises(ValueError):
        rows.slice_rows(df, 1, 2)


@pytest.mark.parametrize("sample", [3, 40, 2000])
def test_slices_past_the_top_rows(spark, monkeypatch, sample):
    monkeypatch.setattr(rows, "TOP_ROWS", 10)
    monkeypatch.setattr(rows, "SAMPLE", sample)
    df = spark.range(1, 401).repartition(7)
    assert unordered(rows_of(rows.slice_rows(df, 400, None, ["id"]))) == [(400,)]
    assert rows_of(rows.slice_rows(df, 401, None, ["id"])) == []
    assert rows_of(rows.slice_rows(df, 200, 199, ["id"])) == []
    assert unordered(rows_of(rows.slice_rows(df, 390, 900, ["id"]))) == unordered([(i,) for i in range(390, 401)])
    assert unordered(rows_of(rows.slice_rows(df, 95, 130, ["id"]))) == unordered([(i,) for i in range(95, 131)])
    assert unordered(rows_of(rows.slice_rows(df, 293, None, ["id"]))) == unordered([(i,) for i in range(293, 401)])


def test_slices_with_ties_and_missing_values_past_the_top_rows(spark, monkeypatch):
    monkeypatch.setattr(rows, "TOP_ROWS", 3)
    monkeypatch.setattr(rows, "SAMPLE", 9)
    values = sorted([(a, b) for a in (None, "", "a", "é") for b in (None, -1.0, 0.0, float("nan"))] * 5,
                    key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] != r[1], r[1] or 0.0))
    df = spark.createDataFrame(values, "a string, b double").repartition(3)
    for lo, hi in ((6, 10), (11, 40), (41, None), (80, 80), (1, 75)):
        got = rows_of(rows.slice_rows(df, lo, hi, ["a", "b"]))
        edges = {str(values[lo - 1]), str(values[min(hi or 80, 80) - 1])}
        want = [v for i, v in enumerate(values, 1) if lo <= i <= (hi or 80) or str(v) in edges]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_slice_tail_with_missing_order_values(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 1), (1, 2), (2, 1)], "a int, b int")
    want = [(None, 2), (1, 1), (1, 2), (2, 1)]
    assert unordered(rows_of(rows.slice_rows(df, 2, None, ["a", "b"]))) == unordered(want)


def test_bind_append_union(spark):
    a = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "n int, s string")
    b = spark.createDataFrame([(30, 3), (10, 1), (20, 2)], "m int, o int")
    bound = rows.bind_cols(a, b, ["n"], ["o"])
    assert unordered(rows_of(bound, "n", "s", "m")) == unordered([(1, "a", 10), (2, "b", 20), (3, "c", 30)])
    assert (9, None) in rows_of(rows.append_row(a, {"n": 9}))
    joined = rows.union_all(a, a.select("s"))
    assert joined.count() == 6 and joined.where("n is null").count() == 3
    assert rows.distinct_rows(joined, "s").count() == 3
    assert rows_of(rows.copy_rows(a, "s", "c", "z").where("s = 'z'")) == [(3, "z")]
    assert [r[0] for r in rows_of(rows.sort_rows(a, ["n"], ["s"]))] == [1, 2, 3]


def test_first_matching_correction_wins(spark):
    df = spark.createDataFrame(
        [("n3", "Depth", 200.0), ("n3", "Density", 200.0), ("cam", None, 100.0), (None, "Depth", 5.0)],
        table("plot:str kind:str depth:dbl"),
    )
    notes = table("rank:int plot:str kind:str offset:dbl")
    some = rows.literal_table(spark, notes, [(1, "n3", "Depth", 10.0), (2, "cam", None, -32.0), (3, "n3", None, 1.0)])
    out = rules.apply_corrections(df, some, ["plot", "kind"], "depth")
    assert unordered(rows_of(out)) == sorted(
        [("n3", "Depth", 210.0), ("n3", "Density", 201.0), ("cam", None, 68.0), (None, "Depth", 5.0)], key=str
    )
    all_first = rows.literal_table(spark, notes, [(1, None, None, 0.5), (2, "n3", "Depth", 10.0)])
    out = rules.apply_corrections(df, all_first, ["plot", "kind"], "depth")
    assert {r[2] for r in rows_of(out)} == {200.5, 100.5, 5.5}


def test_aliases_defaults_and_overrides(spark):
    df = spark.createDataFrame([("a", ""), ("b", None), (None, "S")], table("k:str d:str"))
    names = rows.literal_table(spark, table("old:str new:str"), [("a", "A1")])
    assert {r[0] for r in rows_of(rules.apply_aliases(df, names, "k"))} == {"A1", "b", None}
    assert sorted(r[1] for r in rows_of(rules.default_value(df, "d", "N"))) == ["N", "N", "S"]
    changed = rules.override(df, "d", [(F.col("k") == "b", F.lit("x"))])
    assert {r[1] for r in rows_of(changed)} == {"", "x", "S"}


def test_averaging_repeats_is_strict(spark):
    df = spark.createDataFrame([("p", 1, 10.0, 5.0), ("p", 2, 20.0, None)], table("p:str n:int d:dbl c:dbl"))
    out = average_repeats(df, ["p"], ["d", "c"], ["n"], ["n"])
    assert rows_of(out) == [("p", 1, 15.0, None, 2)]


def test_station_cores_options(spark):
    spec = table("s:str c:str t:int depth:dbl core:dbl plug:dbl mass:dbl rating:dbl")
    df = spark.createDataFrame(
        [("s", "1", 1, 100.0, 50.0, 2.0, 500.0, 5.0), ("s", "1", 2, None, 40.0, None, 300.0, 4.0),
         ("s", "2", 1, None, 1.0, 1.0, 1.0, 1.0), ("s", "3", 1, 0.0, 0.0, 0.0, 0.0, 5.0)],
        spec,
    )
    lax = by_key(station.merge_station_cores(df, ["s", "c"], "t", ["t"]), "c")
    assert set(lax) == {"1", "3"}
    assert (lax["1"]["depth"], lax["1"]["core"], lax["1"]["plug"], lax["1"]["rating"]) == (98.0, 90.0, 2.0, 4.5)
    assert lax["3"]["density"] is None
    zero = by_key(station.merge_station_cores(df, ["s", "c"], "t", ["t"], zero_density=True), "c")
    assert zero["3"]["density"] == 0.0
    hard = by_key(
        station.merge_station_cores(df, ["s", "c"], "t", ["t"], plug_agg="sum", skip_missing=False), "c"
    )
    assert set(hard) == {"3"}  # a missing plug part spoils the depth of core 1


def test_prefix_of_either_form_version(spark):
    df = spark.createDataFrame([(1, 2)], "`Course_Job.Depth` int, other int")
    out = station.normalise_prefix(df, ["Course_Job.", "Course."])
    assert out.columns == ["Depth", "other"]


def test_sensor_without_every_reading_is_left_out(spark):
    df = spark.createDataFrame(
        [("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, None), (None, 1, 5.0)], table("s:str t:int x:dbl")
    )
    out = station.sensor_depth(df, "s", "x", "t", ["t"], "SR50_")
    assert unordered(rows_of(out)) == unordered([(1, "SR50_NA", 5.0), (1, "SR50_a", 15.0)])


def test_totals_and_counts(spark):
    df = spark.createDataFrame(
        [(at("2021-04-22 10:00:00"), "a", 100.0), (at("2021-04-22 11:00:00"), "b", 50.0),
         (at("2021-04-23 10:00:00"), "a", None), (at("2021-04-23 11:00:00"), None, 1.0)],
        table("t:time k:str d:dbl"),
    )
    days = totals.daily_totals(df, "t", "d", "metres")
    assert unordered(rows_of(days)) == unordered([(22, 1.5), (23, None)])
    only = totals.daily_totals(df, "t", "d", "metres", where=F.col("k") == "a")
    assert unordered(rows_of(only)) == unordered([(22, 1.0), (23, None)])
    text = F.date_format("t", "M/d/yyyy")
    both = totals.daily_totals(df.where("d is not null"), text, "d", "metres", day_key=(3, 1))
    assert rows_of(both) == [("2", 1.51)]
    assert rows_of(totals.grand_total(df.where("k = 'b'"), "d", "km", 50.0)) == [(1.0,)]
    assert rows_of(totals.grand_total(df, "d", "km")) == [(None,)]
    assert rows_of(totals.key_count(df, "k")) == [(3,)]
    assert rows_of(totals.check_counts(df, "k", 3, 1)) == [(3, 1, False)]
    assert rows_of(totals.check_counts(df, "k", 3)) == [(3, 0, True)]


def test_period_totals_keep_a_missing_key_apart(spark):
    df = spark.createDataFrame(
        [(1, None, 1, 5.0), (1, None, 2, None), (1, "a", 3, 7.0)], table("f:int area:str t:int d:dbl")
    )
    out = totals.period_totals(df, [["f", "area"], ["f"]], "t", ["t"], {"strict": "d"}, {"skip": "d"})
    assert unordered(rows_of(out)) == sorted(
        [(0, 1, None, 1, None, 5.0), (0, 1, "a", 3, 7.0, 7.0), (1, 1, None, 1, None, 12.0)], key=str
    )
