"""Groups above the row limit take another plan; the answers must not change."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from firnline.operators import multipart, rows, skew
from firnline.operators.complete import complete_template
from firnline.operators.summarise import summarise_plots
from firnline.schema import table
from helpers import bag, rows_of, unordered

LIMIT = 40
SCHEMA = table("k:str sub:str n:long v:dbl w:dbl tag:str")


def skewed(seed=1, count=600):
    """One key holds most rows, one is missing, and one value fills half of the big key."""
    rng = random.Random(seed)
    data = []
    for n in range(count):
        k = rng.choice(["hot"] * 6 + [None] * 2 + ["a", "b", "c", "d"])
        v = 7.0 if k == "hot" and rng.random() < 0.5 else float(rng.randint(0, 400)) / 4
        tag = rng.choice(["x", "y", None, None])
        data.append((k, rng.choice(["p", "q", None]), n, v, rng.random(), tag))
    return data


@pytest.fixture(scope="module")
def data():
    return skewed()


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def test_split_covers_every_row_once(df, data):
    split = skew.split_hot(df, ["k"], LIMIT)
    hot = {r[0] for r in split.hot.select("k").distinct().collect()}
    big = {k for k in {d[0] for d in data} if sum(d[0] == k for d in data) > LIMIT}
    assert hot == big and None in big
    assert split.hot_groups == len(big)
    assert split.hot_rows == split.hot.count()
    assert split.hot.count() + split.cold.count() == len(data)


def test_no_hot_group_keeps_the_direct_plan(df):
    assert skew.split_hot(df, ["k"], 10_000).hot is None


@pytest.mark.parametrize("limit", [1, 7, LIMIT, 10_000])
def test_median_is_exact_at_any_limit(df, data, limit):
    got = {
        r["k"]: (r["med_v"], r["mean_v"], r["count"], r["n"])
        for r in summarise_plots(df, ["k"], "v", ["n"], ["n"], hot_rows=limit).collect()
    }
    for key in {d[0] for d in data}:
        values = [d[3] for d in data if d[0] == key]
        med, mean, count, first = got[key]
        assert med == statistics.median(values)
        assert mean == pytest.approx(statistics.mean(values))
        assert (count, first) == (len(values), min(d[2] for d in data if d[0] == key))


def test_median_of_a_hot_group_with_a_missing_value_is_missing(spark):
    data = [("g", "p", n, None if n == 5 else float(n), 0.0, None) for n in range(100)]
    out = summarise_plots(spark.createDataFrame(data, SCHEMA), ["k"], "v", ["n"], hot_rows=10)
    assert rows_of(out, "med_v", "max_v", "count") == [(None, None, 100)]


def test_median_of_a_hot_group_without_values(spark):
    data = [("g", "p", n, None, 0.0, None) for n in range(50)]
    out = summarise_plots(spark.createDataFrame(data, SCHEMA), ["k"], "v", ["n"], hot_rows=10)
    assert rows_of(out, "k", "med_v", "count") == [("g", None, 50)]


@pytest.mark.parametrize("limit", [1, LIMIT, 10_000])
def test_ordinal_by_key(df, data, limit):
    got = rows_of(rows.with_ordinal(df, ["v", "n"], ["k"], hot_rows=limit), "n", "ordinal")
    want = []
    for key in {d[0] for d in data}:
        mine = sorted((d for d in data if d[0] == key), key=lambda d: (d[3], d[2]))
        want += [(d[2], i) for i, d in enumerate(mine, 1)]
    assert sorted(got) == sorted(want)


def test_ordinal_of_the_whole_table(df, data):
    got = rows_of(rows.with_ordinal(df, ["v", "n"]), "n", "ordinal")
    want = [(d[2], i) for i, d in enumerate(sorted(data, key=lambda d: (d[3], d[2])), 1)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("limit", [1, LIMIT, 10_000])
def test_fill_down(df, data, limit):
    got = rows_of(rows.fill_down(df, ["tag"], ["k"], ["n"], hot_rows=limit), "n", "tag")
    last, want = {}, []
    for k, _, n, _, _, tag in data:
        last[k] = tag if tag is not None else last.get(k)
        want.append((n, last[k]))
    assert unordered(got) == unordered(want)


@pytest.mark.parametrize("metadata", ["distinct", "first"])
def test_multipart_does_not_depend_on_the_limit(spark, data, metadata):
    rng = random.Random(3)
    cores = [
        (k, sub, rng.choice(["yes", "yes", "no", None, "odd"]), n // 7, v, w, n % 3 * 1.0, w * 9)
        for k, sub, n, v, w, _ in data
    ]
    spec = "plot_id:str cardinal_direction:str multi_core:str t:long depth:dbl core:dbl plug:dbl mass:dbl"
    form = spark.createDataFrame(cores, table(spec))
    out = [
        multipart.resolve_multipart(
            form,
            ["plot_id", "cardinal_direction"],
            ["plot_id", "cardinal_direction", "multi_core", "t"],
            "A",
            metadata=metadata,
            order_by=["t", "depth", "core"],
            hot_rows=limit,
        ).select(
            "plot_id",
            "cardinal_direction",
            "multi_core",
            "t",
            *[F.round(c, 6).alias(c) for c in ("depth", "core", "plug", "mass", "swe")],
        )
        for limit in (5, None)
    ]
    assert bag(out[0].columns, out[0].collect()) == bag(out[1].columns, out[1].collect())


def test_completion_does_not_depend_on_the_limit(df):
    template = [("p", 0.0), ("p", 25.0), ("q", 7.0), (None, 7.0), ("z", 1.0)]
    out = [
        complete_template(
            df, "k", ["sub", "v"], template, ["tag", "n"], {"w": 0.0}, ["n"], hot_rows=limit
        )
        for limit in (5, None)
    ]
    assert bag(out[0].columns, out[0].collect()) == bag(out[1].columns, out[1].collect())


def test_results_do_not_depend_on_partitioning(spark, data):
    shuffled = data[:]
    random.Random(9).shuffle(shuffled)
    out = [
        summarise_plots(
            spark.createDataFrame(d, SCHEMA).repartition(p), ["k"], "v", ["n"], ["tag", "sub"], ["w"], 30
        ).withColumn("w", F.round("w", 9)).withColumn("sd_v", F.round("sd_v", 9)).withColumn(
            "mean_v", F.round("mean_v", 9)
        )
        for d, p in ((data, 1), (shuffled, 13))
    ]
    assert bag(out[0].columns, out[0].collect()) == bag(out[1].columns, out[1].collect())


def test_small_groups_are_gathered_before_aggregating(spark):
    many = spark.range(2000).select(
        (F.col("id") / 2).cast("long").alias("g"), "id", F.col("id").cast("double").alias("v")
    )
    plan = _plan(summarise_plots(many, ["g"], "v", ["id"]))
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan


def test_parts_are_merged_with_one_shuffle(spark):
    spec = "plot_id:str cardinal_direction:str multi_core:str t:long depth:dbl core:dbl plug:dbl mass:dbl"
    form = spark.createDataFrame([("a", "N", "yes", 1, 1.0, 1.0, 0.0, 5.0)], table(spec))
    merged = multipart.merge_parts(
        form, ["plot_id", "cardinal_direction"], ["plot_id", "cardinal_direction", "multi_core", "t"]
    )
    assert _plan(merged).count("Exchange") == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
