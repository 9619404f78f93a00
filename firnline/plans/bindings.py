"""The operators bound to the driver's tables, each next to the SQL that must agree with it.

Computed doubles are rounded on both sides, since sums of doubles depend on row order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline import functions as fn
from firnline.operators import coords as coord
from firnline.operators import geo, joins, multipart, reshape, rows, rules, station, totals
from firnline.operators.complete import complete_template
from firnline.operators.summarise import average_repeats, summarise_plots
from firnline.plans.areas import AreaTotals, area_totals
from firnline.plans.sites import append_coords, append_coords_to_summary, site_coordinates
from firnline.plans.trip import Trip, plots_by_flight, run_trip, station_records
from firnline.plans.wide import located_summaries, wide_observations
from firnline.schema import COORD, OBSERVATION, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        ORACLES[name] = sql
        return query

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def whole_price() -> Column:
    """Whole numbers add up the same in any order."""
    return F.floor("l_extendedprice").cast("double")


def null_if(c: str, value: object) -> Column:
    return F.nullif(F.col(c), F.lit(value))


# A total order over lineitem.
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


# ---- summaries ----------------------------------------------------------------------------

STATS = ["mean_{v}", "med_{v}", "max_{v}", "min_{v}", "sd_{v}"]


def stats_sql(v: str) -> str:
    whole = f"case when count(*) = count({v}) then"
    return f"""
      round({whole} avg({v}) end, 6) as mean_{v},
      round({whole} median({v}) end, 6) as med_{v},
      round({whole} max({v}) end, 6) as max_{v},
      round({whole} min({v}) end, 6) as min_{v},
      round({whole} stddev_samp({v}) end, 6) as sd_{v}"""


@register(
    "plot_summary",
    f"""
    with points as (
      select *, nullif(l_discount, 0) as discount_seen from lineitem)
    select l_suppkey,
      first(l_shipdate order by {LINE_ORDER_SQL}) as l_shipdate,
      first(l_returnflag order by {LINE_ORDER_SQL}) as l_returnflag,
      {stats_sql("l_quantity")},
      round(avg(discount_seen), 6) as discount_seen,
      round(avg(l_tax), 6) as l_tax,
      count(*) as count
    from points group by l_suppkey""",
)
def plot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "lineitem").withColumn("discount_seen", null_if("l_discount", 0.0))
    out = summarise_plots(
        points,
        ["l_suppkey"],
        "l_quantity",
        LINE_ORDER,
        ["l_shipdate", "l_returnflag"],
        ["discount_seen", "l_tax"],
    )
    return rounded(out, *[s.format(v="l_quantity") for s in STATS], "discount_seen", "l_tax")


@register(
    "plot_summary_gaps",
    f"""
    with points as (
      select *, nullif(l_quantity, 50) as depth, floor(l_extendedprice) as price from lineitem)
    select l_orderkey,
      first(l_linestatus order by {LINE_ORDER_SQL}) as l_linestatus,
      {stats_sql("depth")},
      round(avg(price), 6) as price,
      count(*) as count
    from points group by l_orderkey""",
)
def plot_summary_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "lineitem").withColumns(
        {"depth": null_if("l_quantity", 50.0), "price": whole_price()}
    )
    out = summarise_plots(points, ["l_orderkey"], "depth", LINE_ORDER, ["l_linestatus"], ["price"])
    return rounded(out, *[s.format(v="depth") for s in STATS], "price")


@register(
    "plot_summary_by_flight",
    f"""
    with points as (
      select *, cast(year(l_shipdate) as integer) as flight, floor(l_extendedprice) as price
      from lineitem)
    select l_suppkey, flight,
      first(strftime(l_shipdate, '%Y-%m-%d %H:%M') order by {LINE_ORDER_SQL}) as plot_datetime,
      {stats_sql("l_quantity")},
      round(avg(price), 6) as price,
      round(avg(l_discount), 6) as l_discount,
      count(*) as count
    from points group by l_suppkey, flight""",
)
def plot_summary_by_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "lineitem").withColumns(
        {
            "flight": F.year("l_shipdate"),
            "plot_datetime": fn.format_time("l_shipdate"),
            "price": whole_price(),
        }
    )
    out = summarise_plots(
        points,
        ["l_suppkey", "flight"],
        "l_quantity",
        LINE_ORDER,
        ["plot_datetime"],
        ["price", "l_discount"],
    )
    return rounded(out, *[s.format(v="l_quantity") for s in STATS], "price", "l_discount")


@register(
    "average_repeats",
    f"""
    select l_suppkey, l_linenumber, l_returnflag,
      first(l_shipdate order by {LINE_ORDER_SQL}) as l_shipdate,
      round(avg(l_quantity), 6) as l_quantity,
      round(avg(floor(l_extendedprice)), 6) as price,
      round(case when count(*) = count(nullif(l_discount, 0)) then avg(l_discount) end, 6) as discount,
      count(*) as count
    from lineitem group by l_suppkey, l_linenumber, l_returnflag""",
)
def average_repeats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "lineitem").withColumns(
        {"discount": null_if("l_discount", 0.0), "price": whole_price()}
    )
    out = average_repeats(
        points,
        ["l_suppkey", "l_linenumber", "l_returnflag"],
        ["l_quantity", "price", "discount"],
        LINE_ORDER,
        ["l_shipdate"],
    )
    return rounded(out, "l_quantity", "price", "discount")


# ---- multi-part cores ---------------------------------------------------------------------

CORE_META = ["plot_id", "cardinal_direction", "multi_core", "survey_time", "plot_type"]
CORE_FORM_SQL = """
    form as (
      select l_orderkey as plot_id,
        cast(nullif(l_linenumber, 7) as varchar) as cardinal_direction,
        case l_returnflag when 'R' then 'yes' when 'A' then 'no' end as multi_core,
        l_shipdate as survey_time, l_linestatus as plot_type, l_partkey as part,
        nullif(l_quantity, 50) as depth, l_tax as core, l_discount as plug,
        l_extendedprice as mass
      from lineitem),
    totals as (
      select plot_id, cardinal_direction, max(depth) as depth, coalesce(sum(core), 0) as core,
        coalesce(sum(plug), 0) as plug, coalesce(sum(mass), 0) as mass
      from form where multi_core = 'yes' group by plot_id, cardinal_direction)"""
WATER = "mass / (3.14159265359 * (2.1 * 2.1))"


def core_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("plot_id"),
        null_if("l_linenumber", 7).cast("string").alias("cardinal_direction"),
        fn.case_when([(flag == "R", F.lit("yes")), (flag == "A", F.lit("no"))]).alias("multi_core"),
        F.col("l_shipdate").alias("survey_time"),
        F.col("l_linestatus").alias("plot_type"),
        F.col("l_partkey").alias("part"),
        null_if("l_quantity", 50.0).alias("depth"),
        F.col("l_tax").alias("core"),
        F.col("l_discount").alias("plug"),
        F.col("l_extendedprice").alias("mass"),
    )


def core_columns_sql(depth: str, under: str) -> str:
    return f"""round({depth}, 6) as depth, round(core, 6) as core, round(plug, 6) as plug,
      round(mass, 4) as mass, round({WATER}, 6) as swe,
      round({WATER} / nullif({under}, 0), 6) as density"""


def rounded_cores(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, "depth", "core", "plug", "swe", "density"), "mass", digits=4)


@register(
    "multipart_distinct",
    f"""
    with {CORE_FORM_SQL},
    meta as (
      select distinct plot_id, cardinal_direction, multi_core, survey_time, plot_type
      from form where multi_core = 'yes'),
    cores as (
      select plot_id, cardinal_direction, multi_core, survey_time, plot_type, depth, core, plug, mass
      from form where multi_core = 'no' or multi_core is null
      union all
      select m.*, t.depth, t.core, t.plug, t.mass
      from meta m left join totals t on m.plot_id = t.plot_id
        and m.cardinal_direction is not distinct from t.cardinal_direction)
    select plot_id, cardinal_direction, multi_core, survey_time, plot_type,
      {core_columns_sql("depth - plug", "depth - plug")}
    from cores""",
)
def multipart_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_cores(
        multipart.resolve_multipart(
            core_form(spark, sf_dir), ["plot_id", "cardinal_direction"], CORE_META, "A"
        )
    )


@register(
    "multipart_first",
    f"""
    with {CORE_FORM_SQL},
    meta as (
      select plot_id, cardinal_direction,
        first(survey_time order by survey_time, part, mass) as survey_time,
        first(plot_type order by survey_time, part, mass) as plot_type
      from form where multi_core = 'yes' group by plot_id, cardinal_direction),
    cores as (
      select plot_id, cardinal_direction, multi_core, survey_time, plot_type, depth, core, plug, mass
      from form where multi_core = 'no'
      union all
      select m.plot_id, m.cardinal_direction, 'yes', m.survey_time, m.plot_type,
        t.depth, t.core, t.plug, t.mass
      from meta m left join totals t on m.plot_id = t.plot_id
        and m.cardinal_direction is not distinct from t.cardinal_direction)
    select plot_id, cardinal_direction, multi_core, survey_time, plot_type,
      {core_columns_sql("depth", "(depth - plug)")}
    from cores""",
)
def multipart_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_cores(
        multipart.resolve_multipart(
            core_form(spark, sf_dir),
            ["plot_id", "cardinal_direction"],
            CORE_META,
            "B",
            metadata="first",
            order_by=["survey_time", "part", "mass"],
            include_unflagged=False,
        )
    )


# ---- stations -----------------------------------------------------------------------------

VISITS_SQL = """
    visits as (
      select event_id, ts as survey_time, cast(user_id % 50 as varchar) as station, user_id,
        substring(event_type, 1, 1) as core_no,
        case when event_id % 211 = 0 then null else value end as depth,
        value / 2 as core, cast(event_id % 7 as double) as plug, value * 10 as mass,
        cast(event_id % 5 as double) as rating
      from events)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    return load(spark, sf_dir, "events").select(
        event,
        F.col("ts").alias("survey_time"),
        (F.col("user_id") % 50).cast("string").alias("station"),
        "user_id",
        fn.core_key("event_type").alias("core_no"),
        F.when(event % 211 != 0, F.col("value")).alias("depth"),
        (F.col("value") / 2).alias("core"),
        (event % 7).cast("double").alias("plug"),
        (F.col("value") * 10).alias("mass"),
        (event % 5).cast("double").alias("rating"),
    )


@register(
    "station_cores",
    f"""
    with {VISITS_SQL},
    cores as (
      select station, core_no, first(survey_time order by survey_time, event_id) as survey_time,
        max(depth) - max(plug) as depth, coalesce(sum(core), 0) as core, max(plug) as plug,
        coalesce(sum(mass), 0) as mass, avg(rating) as rating
      from visits group by station, core_no)
    select station, core_no, survey_time, round(depth, 6) as depth, round(core, 3) as core,
      round(plug, 6) as plug, round(mass, 3) as mass, round(rating, 6) as rating,
      round({WATER}, 4) as swe, round({WATER} / nullif(depth, 0), 4) as density
    from cores where depth is not null""",
)
def station_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = station.merge_station_cores(
        visits(spark, sf_dir), ["station", "core_no"], "survey_time", ["survey_time", "event_id"]
    )
    out = rounded(rounded(out, "depth", "plug", "rating"), "core", "mass", digits=3)
    return rounded(out, "swe", "density", digits=4)


@register(
    "station_cores_strict",
    f"""
    with {VISITS_SQL},
    cores as (
      select user_id, core_no, first(survey_time order by survey_time, event_id) as survey_time,
        max(depth) - case when count(*) = count(nullif(plug, 0)) then sum(plug) end as depth,
        sum(core) as core, case when count(*) = count(nullif(plug, 0)) then sum(plug) end as plug,
        sum(mass) as mass
      from visits group by user_id, core_no)
    select user_id, core_no, survey_time, round(depth, 6) as depth, round(core, 4) as core,
      round(plug, 6) as plug, round(mass, 4) as mass, round({WATER}, 4) as swe,
      round(coalesce({WATER} / nullif(depth, 0), 0), 4) as density
    from cores where depth is not null""",
)
def station_cores_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = visits(spark, sf_dir).withColumn("plug", null_if("plug", 0.0))
    out = station.merge_station_cores(
        gaps,
        ["user_id", "core_no"],
        "survey_time",
        ["survey_time", "event_id"],
        plug_agg="sum",
        skip_missing=False,
        zero_density=True,
        rating=None,
    )
    return rounded(rounded(out, "depth", "plug"), "core", "mass", "swe", "density", digits=4)


@register(
    "sensor_depth",
    f"""
    with {VISITS_SQL}
    select first(survey_time order by survey_time, event_id) as survey_time,
      'SR50_' || coalesce(cast(nullif(user_id, 7) as varchar), 'NA') as plot_id,
      round(avg(depth), 6) as depth
    from visits group by nullif(user_id, 7) having count(*) = count(depth)""",
)
def sensor_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = visits(spark, sf_dir).withColumn("user_id", null_if("user_id", 7))
    out = station.sensor_depth(
        readings, "user_id", "depth", "survey_time", ["survey_time", "event_id"], "SR50_"
    )
    return rounded(out, "depth")


@register(
    "station_observations",
    f"""
    with {VISITS_SQL},
    cores as (
      select station, first(survey_time order by survey_time, event_id) as survey_time,
        max(depth) - max(plug) as depth, coalesce(sum(core), 0) as core, max(plug) as plug,
        coalesce(sum(mass), 0) as mass
      from visits group by station, core_no),
    records as (
      select survey_time, station as plot_id, 'Density' as sample_type, 'yes' as multi_core,
        round(depth, 6) as depth, round(core, 3) as core, round(plug, 6) as plug,
        round(mass, 3) as mass, round({WATER}, 4) as swe,
        round({WATER} / nullif(depth, 0), 4) as density
      from cores where depth is not null
      union all
      select first(survey_time order by survey_time, event_id), 'SR50_' || station, 'Depth', null,
        round(avg(rating), 6), null, null, null, null, null
      from visits group by station)
    select cast(3 as integer) as flight, survey_time, 'Base' as study_area, plot_id,
      'wx_snow_survey' as plot_type, sample_type, multi_core, depth, core, plug, mass, swe, density
    from records""",
)
def station_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = station_records(
        visits(spark, sf_dir),
        "station",
        "core_no",
        "rating",
        ["survey_time", "event_id"],
        {"flight": 3, "study_area": "Base", "plot_type": "wx_snow_survey"},
    )
    # The columns a station record never has are NULL by construction.
    out = rows.drop_cols(out, *COORD.names[1:], "cardinal_direction", "dist_from_centre")
    out = rounded(rounded(out, "depth", "plug"), "core", "mass", digits=3)
    return rounded(out, "swe", "density", digits=4)


# ---- coordinates --------------------------------------------------------------------------


@register(
    "centroids",
    """
    select user_id, round(avg(case when event_id % 197 = 0 then null else value end), 6) as northing,
      round(avg(event_id % 1000), 6) as easting,
      first(event_type order by ts, event_id) as event_type, first(ts order by ts, event_id) as ts
    from events group by user_id""",
)
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coord.centroids(
        stakes(spark, sf_dir),
        "user_id",
        ["northing", "easting"],
        ["event_type", "ts"],
        ["ts", "event_id"],
    )
    return rounded(out, "northing", "easting")


def stakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    return load(spark, sf_dir, "events").withColumns(
        {
            "northing": F.when(event % 197 != 0, F.col("value")),
            "easting": (event % 1000).cast("double"),
        }
    )


@register(
    "coord_export",
    """
    with c as (
      select user_id,
        case when count(*) = count(case when event_id % 197 = 0 then null else value end)
          then avg(value) end as utm_n,
        avg(event_id % 1000) as utm_e, avg(value) as height
      from events group by user_id)
    select cast(user_id as varchar) as sta, round(utm_n, 6) as utm_n, round(utm_e, 6) as utm_e,
      round(height, 6) as height, 'utm10' as utm_z
    from c where utm_n is not null""",
)
def coord_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = coord.centroids(
        stakes(spark, sf_dir), "user_id", ["northing", "easting", "value"], skip_missing=False
    ).withColumn("user_id", F.col("user_id").cast("string"))
    out = coord.coord_export(places, "utm10", "user_id", "northing", "easting", "value")
    return rounded(out, "utm_n", "utm_e", "height")


@register(
    "coord_table",
    """
    select cast(s.s_suppkey as varchar) as plot_id, s.s_acctbal as easting,
      cast(s.s_nationkey as double) as northing, s.s_acctbal / 2 as elev_ellipsoidal,
      c.c_acctbal as lon, cast(c.c_nationkey as double) as lat
    from supplier s left join customer c on s.s_suppkey = c.c_custkey and c.c_custkey % 3 <> 0""",
)
def coord_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coord.coord_table(*coord_sides(spark, sf_dir))


def coord_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    utm = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("station"),
        F.col("s_acctbal").alias("utm_e"),
        F.col("s_nationkey").cast("double").alias("utm_n"),
        (F.col("s_acctbal") / 2).alias("height"),
    )
    seen = load(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 != 0)
    geo_side = seen.select(
        F.col("c_custkey").cast("string").alias("station"),
        F.col("c_acctbal").alias("lon"),
        F.col("c_nationkey").cast("double").alias("lat"),
    )
    return utm, geo_side


SERIES_SQL = """
    e as (select 1 / (2 * 298.257222101::double - 1) as n),
    k as (
      select n, 0.9996 * 6378137.0::double / (1 + n) * (1 + n**2 / 4 + n**4 / 64) as ka,
        2 * sqrt(n) / (1 + n) as ecc,
        n/2 - 2*n**2/3 + 5*n**3/16 + 41*n**4/180 as a1,
        13*n**2/48 - 3*n**3/5 + 557*n**4/1440 as a2,
        61*n**3/240 - 103*n**4/140 as a3, 49561*n**4/161280 as a4,
        n/2 - 2*n**2/3 + 37*n**3/96 - n**4/360 as b1,
        n**2/48 + n**3/15 - 437*n**4/1440 as b2,
        17*n**3/480 - 37*n**4/840 as b3, 4397*n**4/161280 as b4,
        2*n - 2*n**2/3 - 2*n**3 + 116*n**4/45 as d1,
        7*n**2/3 - 8*n**3/5 - 227*n**4/45 as d2,
        56*n**3/15 - 136*n**4/35 as d3, 4279*n**4/630 as d4
      from e)"""


def series_sql(kind: str, outer: str, inner: str) -> str:
    sign = "-" if kind == "b" else "+"
    terms = [f"{sign} {kind}{j} * {outer}({2 * j} * xi) * {inner}({2 * j} * eta)" for j in (1, 2, 3, 4)]
    return " ".join(terms)


@register(
    "utm_forward",
    f"""
    with {SERIES_SQL},
    p as (
      select c_custkey, 10 + c_custkey % 2 as zone,
        radians(49 + (c_custkey % 997) / 1000.0::double) as lat,
        radians(-123 + 6 * (c_custkey % 2) + (c_custkey % 991) / 1000.0::double
          - (6 * (10 + c_custkey % 2) - 183)) as turn
      from customer),
    q as (select *, sinh(atanh(sin(lat)) - ecc * atanh(ecc * sin(lat))) as t from p, k),
    r as (select *, atan2(t, cos(turn)) as xi, atanh(sin(turn) / sqrt(1 + t * t)) as eta from q)
    select c_custkey, round(500000 + ka * (eta {series_sql("a", "cos", "sinh")}), 3) as easting,
      round(ka * (xi {series_sql("a", "sin", "cosh")}), 3) as northing
    from r""",
)
def utm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    places = load(spark, sf_dir, "customer").select(
        c,
        F.concat(F.lit("utm"), (c % 2 + 10).cast("string")).alias("zone"),
        (c % 997 / 1000.0 + 49).alias("lat"),
        (c % 2 * 6 - 123 + c % 991 / 1000.0).alias("lon"),
    )
    out = geo.utm_forward(places, "lat", "lon", geo.zone_number("zone"))
    return rounded(out.select("c_custkey", "easting", "northing"), "easting", "northing", digits=3)


@register(
    "utm_inverse",
    f"""
    with {SERIES_SQL},
    p as (
      select c_custkey, (5400000 + (c_custkey % 9973) * 10 - 0) / ka as xi,
        (300000 + (c_custkey % 9967) * 40 - 500000) / ka as eta
      from customer, k),
    q as (
      select c_custkey, xi {series_sql("b", "sin", "cosh")} as xi0,
        eta {series_sql("b", "cos", "sinh")} as eta0
      from p, k),
    r as (select *, asin(sin(xi0) / cosh(eta0)) as chi from q)
    select c_custkey,
      round(degrees(chi + d1 * sin(2 * chi) + d2 * sin(4 * chi) + d3 * sin(6 * chi)
        + d4 * sin(8 * chi)), 8) as lat,
      round(-123 + degrees(atan2(sinh(eta0), cos(xi0))), 8) as lon
    from r, k""",
)
def utm_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    places = load(spark, sf_dir, "customer").select(
        c, (c % 9967 * 40 + 300000).alias("easting"), (c % 9973 * 10 + 5400000).alias("northing")
    )
    out = geo.utm_inverse(places, "easting", "northing", 10)
    return rounded(out.select("c_custkey", "lat", "lon"), "lat", "lon", digits=8)


# ---- totals -------------------------------------------------------------------------------


@register(
    "daily_totals",
    """
    select cast(day(ts) as integer) as day, round(sum(value) / 100, 6) as total_depth_metre
    from events group by 1""",
)
def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return rounded(
        totals.daily_totals(events, "ts", "value", "total_depth_metre"),
        "total_depth_metre",
    )


@register(
    "daily_totals_filtered",
    """
    select cast(day(ts) as integer) as day,
      round(case when count(*) = count(case when event_id % 97 = 0 then null else value end)
        then sum(value) end / 100, 6) as total_density_metre
    from events where event_type = 'purchase' group by 1""",
)
def daily_totals_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    gaps = events.withColumn("value", F.when(F.col("event_id") % 97 != 0, F.col("value")))
    out = totals.daily_totals(
        gaps, "ts", "value", "total_density_metre", where=F.col("event_type") == "purchase"
    )
    return rounded(out, "total_density_metre")


@register(
    "daily_totals_substring",
    """
    select substring(strftime(ts, '%-m/%-d/%Y'), 3, 2) as day,
      round(sum(value) / 100, 6) as total_depth_metre
    from events group by 1""",
)
def daily_totals_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = fn.format_time("ts", "M/d/yyyy")
    out = totals.daily_totals(
        load(spark, sf_dir, "events"), text, "value", "total_depth_metre", day_key=(3, 2)
    )
    return rounded(out, "total_depth_metre")


@register(
    "period_totals",
    """
    with o as (
      select *, cast(year(o_orderdate) as integer) as flight,
        cast(day(o_orderdate) as integer) as day,
        case when o_orderkey % 5000 = 0 then null else o_totalprice end as depth
      from orders)
    select cast(case when grouping(day) = 0 then 0 else 1 end as integer) as level,
      cast(flight as varchar) as flight, o_orderpriority, cast(day as varchar) as day,
      first(o_orderdate order by o_orderdate, o_orderkey) as date,
      round(case when count(*) = count(depth) then sum(depth) end, 2) as total_depth,
      round(coalesce(sum(depth), 0), 2) as total_swe
    from o
    group by grouping sets ((flight, o_orderpriority, day), (flight, o_orderpriority))""",
)
def period_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(
        F.year("o_orderdate").cast("string").alias("flight"),
        "o_orderpriority",
        F.dayofmonth("o_orderdate").cast("string").alias("day"),
        "o_orderdate",
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5000 != 0, F.col("o_totalprice")).alias("depth"),
    )
    out = totals.period_totals(
        orders,
        [["flight", "o_orderpriority", "day"], ["flight", "o_orderpriority"]],
        "o_orderdate",
        ["o_orderdate", "o_orderkey"],
        {"total_depth": "depth"},
        {"total_swe": "depth"},
    )
    return rounded(out, "total_depth", "total_swe", digits=2)


@register(
    "grand_total", "select round(sum(l_quantity) / 100000, 6) as total_depth_km from lineitem"
)
def grand_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = load(spark, sf_dir, "lineitem")
    return rounded(totals.grand_total(lineitem, "l_quantity", "total_depth_km"), "total_depth_km")


@register(
    "key_count",
    """
    select count(distinct k) + max(case when k is null then 1 else 0 end) as keys
    from (select nullif(l_suppkey, 5) as k from lineitem)""",
)
def key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = load(spark, sf_dir, "lineitem").select(null_if("l_suppkey", 5).alias("k"))
    return totals.key_count(keys, "k")


@register(
    "rows_per_key", "select l_orderkey, count(*) as count from lineitem group by l_orderkey"
)
def rows_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.rows_per_key(load(spark, sf_dir, "lineitem"), ["l_orderkey"])


@register(
    "check_counts",
    """
    with c as (select l_orderkey, count(*) as n from lineitem group by l_orderkey)
    select count(*) as keys, count(*) filter (n <> 4) as odd_keys, count(*) filter (n <> 4) = 0 as ok
    from c""",
)
def check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.check_counts(load(spark, sf_dir, "lineitem"), "l_orderkey", expected_rows=4)


# ---- order --------------------------------------------------------------------------------


@register(
    "ordinal",
    """
    select o_orderkey, o_orderdate, row_number() over (order by o_orderdate, o_orderkey) as ordinal
    from orders""",
)
def ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return rows.with_ordinal(orders, ["o_orderdate", "o_orderkey"])


@register(
    "ordinal_by_key",
    """
    select event_id, user_id,
      row_number() over (partition by user_id order by ts, event_id) as ordinal
    from events""",
)
def ordinal_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return rows.with_ordinal(events, ["ts", "event_id"], ["user_id"]).drop("ts")


SLICE_SQL = """
    select event_id, ts, user_id, event_type, value from (
      select *, row_number() over (order by event_id) as i from events where event_type = 'click')"""


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = rows.keep(load(spark, sf_dir, "events"), equals={"event_type": "click"})
    return events.select("event_id", "ts", "user_id", "event_type", "value")


@register("slice_range", SLICE_SQL + " where i between 95 and 130")
def slice_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.slice_rows(clicks(spark, sf_dir), 95, 130, ["event_id"])


@register("slice_tail", SLICE_SQL + " where i >= 293")
def slice_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.slice_rows(clicks(spark, sf_dir), 293, None, ["event_id"])


@register(
    "bind_cols",
    """
    with a as (select o_orderkey, o_custkey, row_number() over (order by o_orderkey) as i from orders),
    b as (
      select o_totalprice as price, o_orderdate as sold,
        row_number() over (order by o_orderdate, o_orderkey) as i
      from orders)
    select o_orderkey, o_custkey, price, sold from a join b using (i)""",
)
def bind_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    left = orders.select("o_orderkey", "o_custkey")
    right = orders.select(
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("sold"),
        F.col("o_orderkey").alias("tie"),
    )
    return rows.bind_cols(left, right, ["o_orderkey"], ["sold", "tie"]).drop("tie")


@register(
    "fill_down",
    """
    select event_id, user_id,
      round(last_value(case when event_type = 'view' then value end ignore nulls) over w, 6) as value,
      last_value(case when event_id % 3 = 0 then event_type end ignore nulls) over w as event_type
    from events
    window w as (partition by user_id order by event_id rows unbounded preceding)""",
)
def fill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    sparse = load(spark, sf_dir, "events").select(
        event,
        "user_id",
        F.when(F.col("event_type") == "view", F.col("value")).alias("value"),
        F.when(event % 3 == 0, F.col("event_type")).alias("event_type"),
    )
    return rounded(rows.fill_down(sparse, ["value", "event_type"], ["user_id"], ["event_id"]), "value")


@register("sorted", "select o_orderkey, o_orderpriority, o_totalprice from orders")
def sorted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rows.sort_rows(orders, ["o_orderpriority"], ["o_orderkey"])


# ---- completion and reshape ---------------------------------------------------------------

# Seven line numbers (the last one without a distance) by three flags, less one of them.
TEMPLATE = [
    (flag, None if line == 7 else float(line))
    for flag in ("R", "A", "N")
    for line in range(1, 8)
    if (flag, line) != ("N", 3)
]
TEMPLATE_SQL = ", ".join(
    f"('{flag}', cast({'null' if dist is None else dist} as double))" for flag, dist in TEMPLATE
)
COMPLETE_SQL = f"""
    template(direction, dist) as (values {TEMPLATE_SQL}),
    obs as (
      select l_partkey as plot, l_returnflag as direction,
        cast(nullif(l_linenumber, 7) as double) as dist, l_shipdate as seen_at, l_orderkey as ord,
        l_linenumber as line, nullif(l_linestatus, 'O') as kind, nullif(l_quantity, 50) as depth
      from lineitem),
    seen as (
      select o.* from obs o join template t
        on o.direction = t.direction and o.dist is not distinct from t.dist),
    filled as (
      select plot, direction, dist, seen_at,
        last_value(kind ignore nulls) over (
          partition by plot order by seen_at, ord, line, depth nulls first rows unbounded preceding) as kind,
        coalesce(depth, 0) as depth
      from seen),
    carry as (
      select plot, max(seen_at) as seen_at,
        last(kind order by seen_at, ord, line, depth nulls first) filter (kind is not null) as kind
      from seen group by plot),
    gaps as (
      select p.plot, t.direction, t.dist
      from (select distinct plot from obs) p cross join template t
      where not exists (
        select 1 from seen s where s.plot = p.plot and s.direction = t.direction
          and s.dist is not distinct from t.dist)),
    completed as (
      select * from filled
      union all
      select g.plot, g.direction, g.dist, c.seen_at, c.kind, 0
      from gaps g left join carry c on g.plot = c.plot)"""


@register(
    "complete_template",
    f"""
    with {COMPLETE_SQL}
    select plot, direction, dist, seen_at, kind, depth, 'Cardinal' as plot_type from completed""",
)
def complete_template_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completed_plots(spark, sf_dir).drop("ord", "line")


def completed_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = load(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("plot"),
        F.col("l_returnflag").alias("direction"),
        null_if("l_linenumber", 7).cast("double").alias("dist"),
        F.col("l_shipdate").alias("seen_at"),
        F.col("l_orderkey").alias("ord"),
        F.col("l_linenumber").alias("line"),
        null_if("l_linestatus", "O").alias("kind"),
        null_if("l_quantity", 50.0).alias("depth"),
    )
    return complete_template(
        obs,
        "plot",
        ["direction", "dist"],
        TEMPLATE,
        ["seen_at", "kind"],
        {"depth": 0.0},
        ["seen_at", "ord", "line", "depth"],
        {"plot_type": "Cardinal"},
    )


@register(
    "completed_counts",
    f"""
    with {COMPLETE_SQL}
    select plot, count(*) as count, round(avg(depth), 6) as mean_depth from completed group by plot""",
)
def completed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = completed_plots(spark, sf_dir).groupBy("plot").agg(
        F.count(F.lit(1)).alias("count"), F.avg("depth").alias("mean_depth")
    )
    return rounded(counted, "mean_depth")


@register(
    "to_long",
    """
    select l_orderkey, l_linenumber, measure, value from (
      unpivot (
        select l_orderkey, l_linenumber, l_quantity, l_extendedprice,
          nullif(l_discount, 0) as l_discount, l_tax
        from lineitem)
      on l_quantity, l_extendedprice, l_discount, l_tax into name measure value value)
    where value is not null""",
)
def to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = load(spark, sf_dir, "lineitem").withColumn("l_discount", null_if("l_discount", 0.0))
    return reshape.to_long(
        wide, ["l_orderkey", "l_linenumber"], "l_quantity:l_tax", "measure", "value"
    )


@register(
    "stats_long",
    """
    with s as (
      select l_suppkey, round(avg(l_quantity), 6) as mean_depth, median(l_quantity) as med_depth,
        max(l_quantity) as max_depth, min(l_quantity) as min_depth
      from lineitem group by l_suppkey)
    select l_suppkey, "group", value from (
      unpivot s on mean_depth, med_depth, max_depth, min_depth into name "group" value value)""",
)
def stats_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "lineitem").withColumnRenamed("l_quantity", "depth")
    stats = rounded(summarise_plots(points, ["l_suppkey"], "depth", LINE_ORDER), "mean_depth")
    return reshape.to_long(stats, ["l_suppkey"], "mean_depth:min_depth", "group", "value")


# ---- joins --------------------------------------------------------------------------------


@register(
    "coord_join",
    """
    select o_orderkey, o_custkey, o_totalprice, c_acctbal, c_mktsegment
    from orders left join customer on o_custkey = c_custkey and c_mktsegment <> 'BUILDING'""",
)
def coord_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = rows.keep(
        load(spark, sf_dir, "customer"), not_equal={"c_mktsegment": "BUILDING"}
    ).select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    return joins.left_join(orders, customers, ["o_custkey"], na_matches=False)


@register(
    "natural_join",
    """
    with c as (select c_custkey, nullif(c_nationkey, 3) as nationkey, c_acctbal from customer),
    n as (select nullif(n_nationkey, 3) as nationkey, n_name from nation)
    select c_custkey, c.nationkey is null as unplaced, c_acctbal, n_name
    from c left join n on c.nationkey is not distinct from n.nationkey""",
)
def natural_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").select(
        "c_custkey", null_if("c_nationkey", 3).alias("nationkey"), "c_acctbal"
    )
    nations = load(spark, sf_dir, "nation").select(
        null_if("n_nationkey", 3).alias("nationkey"), "n_name"
    )
    joined = joins.natural_left_join(customers, nations)
    return joined.withColumn("unplaced", F.col("nationkey").isNull()).drop("nationkey")


@register(
    "null_key_join",
    """
    with p as (
      select l_orderkey as k, cast(nullif(l_linenumber, 7) as varchar) as d, l_quantity from lineitem),
    t as (select k, d, max(l_quantity) as top, count(*) as n from p group by k, d)
    select p.k, p.d, p.l_quantity, t.top, t.n
    from p left join t on p.k = t.k and p.d is not distinct from t.d""",
)
def null_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        null_if("l_linenumber", 7).cast("string").alias("d"),
        "l_quantity",
    )
    tops = points.groupBy("k", "d").agg(
        F.max("l_quantity").alias("top"), F.count(F.lit(1)).alias("n")
    )
    return joins.left_join(points, tops, ["k", "d"])


@register(
    "suffix_join",
    """
    select s.s_suppkey as k, s.s_acctbal as acctbal_x, s.s_nationkey as nationkey_x,
      c.c_acctbal as acctbal_y, c.c_nationkey as nationkey_y
    from supplier s left join customer c on s.s_suppkey = c.c_custkey""",
)
def suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = rows.rename_select(
        load(spark, sf_dir, "supplier"),
        {"k": "s_suppkey", "acctbal": "s_acctbal", "nationkey": "s_nationkey"},
    )
    right = rows.rename_select(
        load(spark, sf_dir, "customer"),
        {"k": "c_custkey", "acctbal": "c_acctbal", "nationkey": "c_nationkey"},
    )
    return joins.left_join(left, right, ["k"])


@register(
    "dimension_left",
    """
    select c_custkey, c_name, cast(o_orderkey as varchar) as o_orderkey, o_totalprice
    from customer left join orders on c_custkey = o_custkey and o_totalprice > 100000""",
)
def dimension_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = rows.keep(load(spark, sf_dir, "orders"), after={"o_totalprice": 100000.0}).select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        "o_totalprice",
    )
    return joins.dimension_left_join(customers, orders, ["c_custkey"])


# ---- rules --------------------------------------------------------------------------------

# Supplier, flag, offset; the first matching rule wins and an open field matches anything.
RULES = [
    (1, 3, "R", 10.0),
    (2, 3, None, -32.0),
    (3, None, "A", 0.5),
    (4, 5, "A", 100.0),
    (5, 8, None, 7.0),
    (6, None, None, 0.25),
]
RULES_SQL = ", ".join(
    "({}, {}, {}, {})".format(*["null" if v is None else repr(v) for v in rule]) for rule in RULES
)


@register(
    "corrections",
    f"""
    with rule(rank, k, flag, shift) as (values {RULES_SQL})
    select l_orderkey, l_linenumber, l_suppkey, l_returnflag,
      round(l_quantity + coalesce((
        select first(shift order by rank) from rule
        where (k is null or k = l_suppkey) and (flag is null or flag = l_returnflag)), 0), 6) as depth
    from lineitem""",
)
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", F.col("l_quantity").alias("depth")
    )
    notes = rows.literal_table(
        spark, table("rank:int l_suppkey:long l_returnflag:str offset:dbl"), RULES
    )
    return rounded(
        rules.apply_corrections(points, notes, ["l_suppkey", "l_returnflag"], "depth"), "depth"
    )


@register(
    "recompute",
    """
    select l_orderkey, l_linenumber,
      case when l_suppkey = 3 and l_returnflag = 'R' then trunc(l_extendedprice - 2570)
           when l_suppkey = 3 then l_extendedprice / 2
           else l_extendedprice end as mass
    from lineitem""",
)
def recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    mass, here = F.col("mass"), F.col("l_suppkey") == 3
    points = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", F.col("l_extendedprice").alias("mass")
    )
    arms = [
        (here & (F.col("l_returnflag") == "R"), fn.truncate(mass - 2570).cast("double")),
        (here, mass / 2),
    ]
    return rules.override(points, "mass", arms).select("l_orderkey", "l_linenumber", "mass")


@register(
    "aliases",
    """
    with alias(old, new) as (values ('BUILDING', 'HOUSE'), ('MACHINERY', 'MACHINE'), ('NONE', 'X'))
    select c_custkey, coalesce(new, c_mktsegment) as c_mktsegment
    from customer left join alias on c_mktsegment = old""",
)
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = rows.literal_table(
        spark,
        table("old:str new:str"),
        [("BUILDING", "HOUSE"), ("MACHINERY", "MACHINE"), ("NONE", "X")],
    )
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return rules.apply_aliases(customers, names, "c_mktsegment")


@register(
    "copy_rows",
    """
    select c_custkey, c_mktsegment, c_acctbal from customer
    union all
    select c_custkey, 'HOUSE', c_acctbal from customer where c_mktsegment = 'BUILDING'""",
)
def copy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return rows.copy_rows(customers, "c_mktsegment", "BUILDING", "HOUSE")


@register(
    "default_value",
    """
    select l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'N'), 'Q') as direction,
      coalesce(nullif(l_discount, 0.05), 0) as plug
    from lineitem""",
)
def default_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("direction"),
        null_if("l_discount", 0.05).alias("plug"),
    )
    return rules.default_value(rules.default_value(points, "direction", "Q"), "plug", 0.0)


# ---- scalar functions ---------------------------------------------------------------------


@register(
    "typed_depth",
    """
    select l_orderkey, l_linenumber, case l_returnflag when 'R' then l_quantity
      when 'A' then l_extendedprice end as depth
    from lineitem""",
)
def typed_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = fn.typed_depth("l_returnflag", {"R": "l_quantity", "A": "l_extendedprice"})
    lineitem = load(spark, sf_dir, "lineitem")
    return lineitem.select("l_orderkey", "l_linenumber", depth.alias("depth"))


@register(
    "scale_units",
    """
    select c_custkey, round(case c_mktsegment when 'BUILDING' then c_acctbal / 10 else c_acctbal end, 6)
      as swe
    from customer""",
)
def scale_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = fn.scale_units("c_acctbal", "c_mktsegment", {"BUILDING": 10.0})
    return rounded(load(spark, sf_dir, "customer").select("c_custkey", scaled.alias("swe")), "swe")


def snow_columns(spark: SparkSession, sf_dir: str, convention: str, pi: float) -> DataFrame:
    cores = load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("depth"),
        null_if("l_linenumber", 6).cast("double").alias("plug"),
        fn.net_mass("l_extendedprice", null_if("l_tax", 0.0)).alias("mass"),
    )
    out = cores.withColumns(fn.density_columns("depth", "plug", "mass", convention, pi=pi))
    out = out.withColumn("density0", fn.density_or_zero("swe", F.col("depth") - 1))
    return rounded(out, "mass", "swe", "density", "density0", digits=5).drop("plug")


def snow_sql(pi: str, depth: str) -> str:
    return f"""
    with c as (
      select l_orderkey, l_linenumber, l_quantity as depth, nullif(l_linenumber, 6) as plug,
        l_extendedprice - coalesce(nullif(l_tax, 0), 0) as mass
      from lineitem),
    s as (select *, mass / ({pi} * (2.1 * 2.1)) as swe from c)
    select l_orderkey, l_linenumber, {depth} as depth, round(mass, 5) as mass, round(swe, 5) as swe,
      round(swe / nullif(depth - plug, 0), 5) as density,
      round(coalesce(swe / nullif({depth} - 1, 0), 0), 5) as density0
    from s"""


@register("swe_density_a", snow_sql("3.14159265359", "(depth - plug)"))
def swe_density_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snow_columns(spark, sf_dir, "A", fn.PI)


@register("swe_density_b", snow_sql("3.142", "depth"))
def swe_density_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snow_columns(spark, sf_dir, "B", 3.142)


@register(
    "parse_time",
    """
    with t as (
      select o_orderkey, case o_orderkey % 4
        when 0 then strftime(o_orderdate + interval 1 minute * (o_orderkey % 1440), '%-m/%-d/%Y %-H:%M')
        when 1 then strftime(o_orderdate + interval 1 minute * (o_orderkey % 1440), '%Y-%m-%d %H:%M:%S')
        when 2 then '0004-05-06 07:08:09' else 'not a date' end as text
      from orders),
    p as (
      select o_orderkey, coalesce(try_strptime(text, '%Y-%m-%d %H:%M:%S'),
        try_strptime(text, '%m/%d/%Y %H:%M')) as time
      from t),
    v as (select o_orderkey, case when year(time) >= 2000 or o_orderkey % 4 < 2 then time end as time from p)
    select o_orderkey, time, strftime(time, '%Y-%m-%d %H:%M') as minute,
      cast(day(time) as varchar) as day
    from v""",
)
def parse_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    at = F.col("o_orderdate") + F.make_dt_interval(mins=key % 1440)
    text = fn.case_when(
        [
            (key % 4 == 0, fn.format_time(at, "M/d/yyyy H:mm")),
            (key % 4 == 1, fn.format_time(at, "yyyy-MM-dd HH:mm:ss")),
            (key % 4 == 2, F.lit("0004-05-06 07:08:09")),
        ],
        F.lit("not a date"),
    )
    times = load(spark, sf_dir, "orders").select(key, fn.parse_time(text, min_year=1900).alias("time"))
    return times.withColumns(
        {"minute": fn.format_time("time"), "day": fn.day_of("time").cast("string")}
    )


@register(
    "parse_number",
    """
    select p_partkey, try_cast(text as double) as number, trunc(try_cast(text as double)) as whole
    from (
      select p_partkey, case p_partkey % 5 when 0 then '?' when 1 then 'NA' when 2 then ''
        else cast(p_retailprice as varchar) end as text
      from part)""",
)
def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    text = fn.case_when(
        [(key % 5 == 0, F.lit("?")), (key % 5 == 1, F.lit("NA")), (key % 5 == 2, F.lit(""))],
        F.col("p_retailprice").cast("string"),
    )
    number = fn.parse_number(text)
    return load(spark, sf_dir, "part").select(
        key, number.alias("number"), fn.truncate(number).cast("double").alias("whole")
    )


@register(
    "digits",
    """
    select p_partkey, regexp_replace(p_brand, '[^0-9.-]', '', 'g') as brand_no,
      regexp_replace(p_type || '-1.5x', '[^0-9.-]', '', 'g') as type_no
    from part""",
)
def digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(
        "p_partkey",
        fn.digits("p_brand").alias("brand_no"),
        fn.digits(F.concat("p_type", F.lit("-1.5x"))).alias("type_no"),
    )


@register(
    "core_key",
    """
    select p_partkey, substring(p_name, 1, 1) as core, lower(substring(p_brand, 1, 1)) as folded
    from part""",
)
def core_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(
        "p_partkey",
        fn.core_key("p_name").alias("core"),
        fn.core_key("p_brand", fold=True).alias("folded"),
    )


@register(
    "decode_position",
    """
    with p as (
      select p_partkey, case when p_partkey % 17 = 0 then 'Centre'
        else substring('NSEW', cast(p_partkey % 4 + 1 as integer), 1)
          || cast((p_size % 4 + 1) * 2.5 as varchar) end as position
      from part)
    select p_partkey, case when position = 'Centre' then position else substring(position, 1, 1) end
        as direction,
      case when position <> 'Centre' then try_cast(substring(position, 2) as double) end as distance
    from p""",
)
def decode_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    arm = F.element_at(F.array(*[F.lit(c) for c in "NSEW"]), (key % 4 + 1).cast("int"))
    metres = ((F.col("p_size") % 4 + 1) * 2.5).cast("string")
    position = F.when(key % 17 == 0, "Centre").otherwise(F.concat(arm, metres))
    direction, distance = fn.decode_position(position)
    return load(spark, sf_dir, "part").select(
        key, direction.alias("direction"), distance.alias("distance")
    )


# ---- rows and columns ---------------------------------------------------------------------


@register(
    "filters",
    """
    select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate from (
      select *, nullif(o_orderpriority, '5-LOW') as p from orders)
    where o_orderstatus = 'F' and p is not null and o_custkey not in (1, 2, 3)
      and cast(o_custkey as varchar) <> '4' and o_orderdate > timestamp '1995-01-01 00:00:00'""",
)
def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").withColumn(
        "p", null_if("o_orderpriority", "5-LOW")
    )
    kept = rows.keep(
        orders,
        equals={"o_orderstatus": "F"},
        not_null=["p"],
        not_in={"o_custkey": [1, 2, 3]},
        not_equal={"o_custkey": 4},
        after={"o_orderdate": "1995-01-01 00:00:00"},
    )
    return rows.col_range(kept, "o_orderkey:o_orderdate")


@register(
    "filters_null_keys",
    """
    select o_orderkey, k
    from (select o_orderkey, cast(nullif(o_custkey, 5) as varchar) as k from orders)
    where k is null or k not in ('1', '2', '3')""",
)
def filters_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = load(spark, sf_dir, "orders").select(
        "o_orderkey", null_if("o_custkey", 5).cast("string").alias("k")
    )
    return rows.keep(keyed, not_in={"k": ["1", "2", "3"]})


@register(
    "projection",
    """
    select c_acctbal as balance, cast(c_nationkey as double) as nation, c_custkey as id,
      'Custom' as plot_type, cast(null as double) as core
    from customer""",
)
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer")
    picked = rows.col_range(customer, "c_acctbal:c_nationkey", "c_custkey", drop=["c_name"])
    named = rows.rename_select(
        picked, {"balance": "c_acctbal", "nation": "c_nationkey", "id": "c_custkey"}
    )
    numbers = rows.cast_range(named, "balance:nation", "double")
    target = table("balance:dbl nation:dbl id:long plot_type:str core:dbl")
    return rows.align(numbers, target, plot_type="Custom")


@register(
    "cast_range",
    """
    select o_orderkey, try_cast(o_orderstatus as double) as status,
      try_cast(substring(o_orderpriority, 1, 1) as double) as priority
    from orders""",
)
def cast_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderstatus").alias("status"),
        F.substring("o_orderpriority", 1, 1).alias("priority"),
    )
    return rows.cast_range(text, "status:priority", "double")


@register(
    "prefix_select",
    "select l_orderkey, l_linenumber, l_linestatus from lineitem",
)
def prefix_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = load(spark, sf_dir, "lineitem")
    return rows.starts_with(lineitem, "l_orderkey", prefix="l_line")


@register(
    "union_all",
    """
    select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderstatus = 'F'
    union all
    select o_orderkey, o_totalprice, null from orders where o_totalprice > 200000""",
)
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    done = rows.keep(orders, equals={"o_orderstatus": "F"})
    dear = rows.keep(orders, after={"o_totalprice": 200000.0})
    return rows.union_all(
        done.select("o_orderkey", "o_totalprice", "o_orderstatus"),
        dear.select("o_totalprice", "o_orderkey"),
    )


@register(
    "append_row",
    """
    select o_orderkey, o_orderstatus, o_totalprice from orders
    union all select -1, 'X', null""",
)
def append_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rows.append_row(orders, {"o_orderkey": -1, "o_orderstatus": "X"})


@register(
    "distinct_meta", "select distinct o_orderstatus, o_orderpriority, o_custkey from orders"
)
def distinct_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return rows.distinct_rows(orders, "o_orderstatus", "o_orderpriority", "o_custkey")


# ---- whole trip ---------------------------------------------------------------------------

TRIP_SQL = f"""
    {VISITS_SQL},
    coords as (
      select cast(s.s_suppkey as varchar) as plot_id, s.s_acctbal as easting,
        cast(s.s_nationkey as double) as northing, s.s_acctbal / 2 as elev_ellipsoidal,
        c.c_acctbal as lon, cast(c.c_nationkey as double) as lat
      from supplier s left join customer c on s.s_suppkey = c.c_custkey and c.c_custkey % 3 <> 0),
    form as (
      select l_shipdate as survey_time, 'Base' as study_area,
        cast(case l_suppkey when 4 then 2 else l_suppkey end as varchar) as plot_id,
        l_linestatus as plot_type,
        case l_returnflag when 'N' then 'Depth' else 'Density' end as sample_type,
        substring('NSEW', cast(l_orderkey % 5 + 1 as integer), 1) as cardinal_direction,
        cast(nullif(l_linenumber, 7) as double) as dist_from_centre,
        case l_returnflag when 'R' then 'yes' when 'A' then 'no' end as multi_core,
        l_quantity + case when l_suppkey = 3 and l_returnflag = 'N' then 10
          when l_suppkey = 5 then -0.5 else 0 end as depth,
        l_tax as core, coalesce(nullif(l_discount, 0.05), 0) as plug, l_extendedprice as mass
      from lineitem where l_quantity <> 50),
    pieces as (
      select plot_id, cardinal_direction, max(depth) as depth, coalesce(sum(core), 0) as core,
        coalesce(sum(plug), 0) as plug, coalesce(sum(mass), 0) as mass
      from form where multi_core = 'yes' group by plot_id, cardinal_direction),
    meta as (
      select distinct survey_time, study_area, plot_id, plot_type, sample_type, cardinal_direction,
        dist_from_centre, multi_core
      from form where multi_core = 'yes'),
    points as (
      select * from form where multi_core = 'no' or multi_core is null
      union all
      select m.*, p.depth, p.core, p.plug, p.mass
      from meta m left join pieces p on m.plot_id = p.plot_id
        and m.cardinal_direction is not distinct from p.cardinal_direction),
    measured as (
      select survey_time, study_area, plot_id, plot_type, sample_type, cardinal_direction,
        dist_from_centre, multi_core, depth - plug as depth, core, plug, mass,
        {WATER} as swe, {WATER} / nullif(depth - plug, 0) as density
      from points),
    courses as (
      select station, first(survey_time order by survey_time, event_id) as survey_time,
        max(depth) - max(plug) as depth, coalesce(sum(core), 0) as core, max(plug) as plug,
        coalesce(sum(mass), 0) as mass
      from visits group by station, core_no),
    observed as (
      select * from measured
      union all
      select survey_time, 'Base', 'st' || station, 'wx_snow_survey', 'Density', null, null, 'yes', depth,
        core, plug, mass, {WATER}, {WATER} / nullif(depth, 0)
      from courses where depth is not null
      union all
      select first(survey_time order by survey_time, event_id), 'Base', 'SR50_st' || station,
        'wx_snow_survey', 'Depth', null, null, null, avg(rating), null, null, null, null, null
      from visits group by station)"""


def trip(spark: SparkSession, sf_dir: str) -> Trip:
    flag, key = F.col("l_returnflag"), F.col("l_suppkey")
    lineitem = rows.keep(load(spark, sf_dir, "lineitem"), not_equal={"l_quantity": 50.0})
    form = lineitem.select(
        F.col("l_shipdate").alias("survey_time"),
        F.lit("Base").alias("study_area"),
        key.cast("string").alias("plot_id"),
        F.col("l_linestatus").alias("plot_type"),
        F.when(flag == "N", "Depth").otherwise("Density").alias("sample_type"),
        F.substring(F.lit("NSEW"), (F.col("l_orderkey") % 5 + 1).cast("int"), F.lit(1)).alias(
            "cardinal_direction"
        ),
        null_if("l_linenumber", 7).cast("double").alias("dist_from_centre"),
        fn.case_when([(flag == "R", F.lit("yes")), (flag == "A", F.lit("no"))]).alias("multi_core"),
        F.col("l_quantity").alias("depth"),
        F.col("l_tax").alias("core"),
        null_if("l_discount", 0.05).alias("plug"),
        F.col("l_extendedprice").alias("mass"),
    )
    stops = visits(spark, sf_dir).withColumn("station", F.concat(F.lit("st"), "station"))
    return run_trip(
        [form],
        coord.coord_table(*coord_sides(spark, sf_dir)),
        station_records(
            stops,
            "station",
            "core_no",
            "rating",
            ["survey_time", "event_id"],
            {"study_area": "Base", "plot_type": "wx_snow_survey"},
        ),
        rows.literal_table(
            spark,
            table("rank:int plot_id:str sample_type:str offset:dbl"),
            [(1, "3", "Depth", 10.0), (2, "5", None, -0.5)],
        ),
        rows.literal_table(spark, table("old:str new:str"), [("4", "2")]),
    )


@register(
    "run_trip",
    f"""
    with {TRIP_SQL},
    stats as (
      select plot_id,
        min(survey_time) as plot_datetime, 'Base' as study_area,
        first(plot_type order by survey_time, plot_type) as plot_type,
        {stats_sql("depth")},
        round(avg(swe), 4) as swe, round(avg(density), 4) as density, count(*) as count
      from observed group by plot_id)
    select plot_datetime, study_area, plot_id, easting, northing, elev_ellipsoidal, lon, lat,
      plot_type, mean_depth, med_depth, max_depth, min_depth, sd_depth, swe, density, count
    from stats left join coords using (plot_id)""",
)
def run_trip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    plots = trip(spark, sf_dir).plots
    plots = rounded(plots, *[s.format(v="depth") for s in STATS])
    return rounded(plots, "swe", "density", digits=4)


@register(
    "run_trip_observations",
    f"""
    with {TRIP_SQL}
    select survey_time, study_area, plot_id, easting, northing, elev_ellipsoidal, lon, lat,
      plot_type, sample_type, cardinal_direction, dist_from_centre, multi_core,
      round(depth, 6) as depth, round(core, 3) as core, round(plug, 6) as plug,
      round(mass, 2) as mass, round(swe, 3) as swe, round(density, 3) as density
    from observed left join coords using (plot_id)""",
)
def run_trip_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = trip(spark, sf_dir).observations.drop("flight")
    seen = rounded(seen, "depth", "plug")
    return rounded(rounded(seen, "mass", digits=2), "core", "swe", "density", digits=3)


@register(
    "run_trip_daily",
    f"""
    with {TRIP_SQL}
    select cast(day(survey_time) as integer) as day, round(sum(depth) / 100, 6) as total_depth_metre,
      round(sum(depth) filter (sample_type = 'Density') / 100, 6) as total_density_metre
    from observed group by 1""",
)
def run_trip_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = trip(spark, sf_dir)
    both = joins.natural_left_join(days.daily_depth, days.daily_density)
    return rounded(both, "total_depth_metre", "total_density_metre")


COORDS_SQL = """
    coords as (
      select cast(s.s_suppkey as varchar) as plot_id, s.s_acctbal as easting,
        cast(s.s_nationkey as double) as northing, s.s_acctbal / 2 as elev_ellipsoidal,
        c.c_acctbal as lon, cast(c.c_nationkey as double) as lat
      from supplier s left join customer c on s.s_suppkey = c.c_custkey and c.c_custkey % 3 <> 0)"""


def plot_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coord.coord_table(*coord_sides(spark, sf_dir))


@register(
    "plots_by_flight",
    f"""
    with {COORDS_SQL},
    seen as (
      select cast(l_suppkey as varchar) as plot_id, cast(year(l_shipdate) as varchar) as flight,
        l_shipdate as survey_time, l_linestatus as plot_type, l_orderkey as ord, l_linenumber as line,
        l_quantity as depth, {WATER.replace("mass", "l_extendedprice")} as swe,
        {WATER.replace("mass", "l_extendedprice")} / nullif(l_quantity - l_linenumber, 0) as density
      from lineitem where l_suppkey % 10 <> 7),
    located as (select c.*, s.* exclude (plot_id) from coords c left join seen s on c.plot_id = s.plot_id)
    select plot_id, flight,
      first(strftime(survey_time, '%Y-%m-%d %H:%M') order by survey_time, ord, line) as plot_datetime,
      first(plot_type order by survey_time, ord, line) as plot_type,
      {stats_sql("depth")},
      round(avg(easting), 4) as easting, round(avg(lat), 6) as lat,
      round(avg(swe), 4) as swe, round(avg(density), 4) as density, count(*) as count
    from located group by plot_id, flight""",
)
def plots_by_flight_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mass = F.col("l_extendedprice")
    some = load(spark, sf_dir, "lineitem").where(F.col("l_suppkey") % 10 != 7)
    seen = some.select(
        F.col("l_suppkey").cast("string").alias("plot_id"),
        F.year("l_shipdate").cast("string").alias("flight"),
        F.col("l_shipdate").alias("survey_time"),
        F.lit("Base").alias("study_area"),
        F.col("l_linestatus").alias("plot_type"),
        F.col("l_orderkey").alias("ord"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("depth"),
        fn.swe(mass).alias("swe"),
        fn.density(fn.swe(mass), "l_quantity", "l_linenumber", "B").alias("density"),
    )
    out = plots_by_flight(seen, plot_coords(spark, sf_dir), ["survey_time", "ord", "line"])
    out = rounded(out, *[s.format(v="depth") for s in STATS], "lat")
    out = rounded(out, "easting", "swe", "density", digits=4)
    return out.drop("study_area", "northing", "elev_ellipsoidal", "lon")


# ---- wide layout, coordinates and totals of all areas ---------------------------------------


@register(
    "wide_observations",
    f"""
    with {COORDS_SQL},
    wide as (
      select l_shipdate as survey_time, cast(l_suppkey as varchar) as plot_id, l_orderkey as ord,
        l_linestatus as plot_type, l_quantity as "Centre", l_extendedprice as "N10",
        nullif(l_discount, 0) as "N7.5", l_tax as "W2.5"
      from lineitem),
    long as (
      unpivot wide on "Centre", "N10", "N7.5", "W2.5" into name position value depth)
    select 'Coast' as study_area, survey_time, plot_id, easting, lat, plot_type,
      case when position = 'Centre' then position else substring(position, 1, 1) end
        as cardinal_direction,
      case when position <> 'Centre' then try_cast(substring(position, 2) as double) end
        as dist_from_centre, depth
    from long left join coords using (plot_id) where depth is not null""",
)
def wide_observations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = load(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("survey_time"),
        F.col("l_suppkey").cast("string").alias("plot_id"),
        F.col("l_linestatus").alias("plot_type"),
        F.col("l_quantity").alias("Centre"),
        F.col("l_extendedprice").alias("N10"),
        null_if("l_discount", 0.0).alias("N7.5"),
        F.col("l_tax").alias("W2.5"),
    )
    ids = ["survey_time", "plot_id", "plot_type"]
    out = wide_observations(wide, ids, "Centre:W2.5", plot_coords(spark, sf_dir), "Coast")
    return out.select(
        "study_area", *ids, "easting", "lat", "cardinal_direction", "dist_from_centre", "depth"
    )


@register(
    "located_summaries",
    f"""
    with {COORDS_SQL}
    select o_orderdate as plot_datetime, cast(o_custkey % 150 as varchar) as plot_id, easting,
      northing, elev_ellipsoidal, lon, lat, o_orderpriority as plot_type, o_totalprice as mean_depth
    from orders left join coords on cast(o_custkey % 150 as varchar) = coords.plot_id""",
)
def located_summaries_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = load(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("plot_datetime"),
        (F.col("o_custkey") % 150).cast("string").alias("plot_id"),
        F.lit(0.0).alias("lon"),
        F.lit(0.0).alias("lat"),
        F.col("o_orderpriority").alias("plot_type"),
        F.col("o_totalprice").alias("mean_depth"),
    )
    return located_summaries(given, plot_coords(spark, sf_dir), ["lon", "lat"])


@register(
    "append_coords",
    f"""
    with {COORDS_SQL},
    o as (
      select l_orderkey, l_linenumber, cast(l_suppkey as varchar) as plot_id, l_quantity as depth,
        nullif(l_linenumber, 6) as plug, l_extendedprice as mass
      from lineitem)
    select l_orderkey, l_linenumber, plot_id, depth, easting, lat, round({WATER}, 5) as swe,
      round({WATER} / nullif(depth - plug, 0), 5) as density
    from o left join coords using (plot_id)""",
)
def append_coords_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_suppkey").cast("string").alias("plot_id"),
        F.col("l_quantity").alias("depth"),
        null_if("l_linenumber", 6).alias("plug"),
        F.col("l_extendedprice").alias("mass"),
    )
    out = rounded(append_coords(seen, plot_coords(spark, sf_dir)), "swe", "density", digits=5)
    return out.drop("plug", "mass", "northing", "elev_ellipsoidal", "lon")


@register(
    "append_coords_summary",
    f"""
    with {COORDS_SQL},
    s as (
      select cast(o_custkey as varchar) as plot_id, max(o_totalprice) as mean_depth, count(*) as count
      from orders group by o_custkey)
    select plot_id, mean_depth, count, easting, northing, elev_ellipsoidal, lon, lat
    from s left join coords using (plot_id)""",
)
def append_coords_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    summary = load(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").cast("string").alias("plot_id")
    )
    old = summary.agg(
        F.lit(1.0).alias("easting"),
        F.lit(2.0).alias("northing"),
        F.max("o_totalprice").alias("mean_depth"),
        F.count_if(done).alias("count_depth"),
        F.count_if(~done).alias("count_density"),
    )
    return append_coords_to_summary(old, plot_coords(spark, sf_dir))


@register(
    "site_coordinates",
    """
    with stakes as (
      select cast(event_id as varchar) as id,
        case when user_id % 5 = 0 then 'na' else cast(user_id as varchar) end as plot_id,
        value as northing, cast(event_id % 1000 as double) as easting,
        cast(event_id % 77 as double) as elev, ts, event_id, event_type
      from events),
    points as (
      select 's' || s_suppkey as plot_id, s_acctbal as northing, s_acctbal / 2 as easting,
        cast(s_nationkey as double) as elev, s_suppkey
      from supplier where s_suppkey not in (2, 3)),
    notes as (
      select s_name as solution, 'x' as aspect, 'open' as cover, 'camera' as station_type,
        row_number() over (order by s_acctbal, s_suppkey) as i
      from supplier where s_suppkey not in (2, 3)),
    bound as (
      select p.*, n.* from (select *, row_number() over (order by s_suppkey) as i from points) p
        join notes n on p.i = n.i)
    select plot_id, round(avg(northing), 6) as northing, round(avg(easting), 6) as easting,
      round(avg(elev), 6) as elev, first(event_type order by ts, event_id) as solution,
      'south' as aspect, 'forest' as cover, first(id order by ts, event_id) as station_type
    from stakes where plot_id <> 'na' group by plot_id
    union all
    select plot_id, northing, easting, elev, solution, aspect, cover, station_type from bound
    union all
    select 'promoted', round(northing, 6), easting, elev, event_type, 'south', 'forest', id
    from stakes where id = '40'""",
)
def site_coordinates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, user = F.col("event_id"), F.col("user_id")
    stakes_seen = load(spark, sf_dir, "events").select(
        event.cast("string").alias("id"),
        F.when(user % 5 == 0, "na").otherwise(user.cast("string")).alias("plot_id"),
        F.col("value").alias("northing"),
        (event % 1000).cast("double").alias("easting"),
        (event % 77).cast("double").alias("elev"),
        F.col("event_type").alias("solution"),
        F.lit("south").alias("aspect"),
        F.lit("forest").alias("cover"),
        event.cast("string").alias("station_type"),
        "ts",
        event,
    )
    supplier = load(spark, sf_dir, "supplier")
    points = supplier.select(
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("plot_id"),
        F.col("s_acctbal").alias("northing"),
        (F.col("s_acctbal") / 2).alias("easting"),
        F.col("s_nationkey").cast("double").alias("elev"),
        "s_suppkey",
    )
    notes = rows.keep(supplier, not_in={"s_suppkey": [2, 3]}).select(
        F.col("s_name").alias("solution"),
        F.lit("x").alias("aspect"),
        F.lit("open").alias("cover"),
        F.lit("camera").alias("station_type"),
        F.col("s_acctbal").alias("worth"),
        F.col("s_suppkey").alias("note_key"),
    )
    out = site_coordinates(
        stakes_seen,
        points,
        notes,
        ["s2", "s3"],
        ["ts", "event_id"],
        ["s_suppkey"],
        ["worth", "note_key"],
        ("40", "promoted"),
    )
    return rounded(out, "northing", "easting", "elev")


AREA_SQL = """
    s as (
      select cast(year(o_orderdate) as varchar) as flight, o_orderpriority as study_area,
        o_orderdate as survey_time, o_orderkey, day(o_orderdate) as day,
        case when o_orderkey % 3000 = 0 then null else o_totalprice end as depth,
        case when o_orderkey % 7 = 0 then null
          when o_orderpriority = '1-URGENT' then o_totalprice / 10 else o_totalprice end as swe
      from orders)"""
AREA_COLUMNS_SQL = """
      first(survey_time order by survey_time, o_orderkey) as date,
      round(case when count(*) = count(depth) then sum(depth) end, 2) as total_depth,
      round(coalesce(sum(swe), 0), 3) as total_swe"""


def all_areas(spark: SparkSession, sf_dir: str, gap: int = 3000) -> AreaTotals:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    summaries = load(spark, sf_dir, "orders").select(
        F.year("o_orderdate").cast("string").alias("flight"),
        F.col("o_orderpriority").alias("study_area"),
        F.col("o_orderdate").alias("survey_time"),
        key,
        (F.when(key % gap != 0, price) if gap else price).alias("depth"),
        F.when(key % 7 != 0, price).alias("swe"),
    )
    return area_totals(summaries, {"1-URGENT": 10.0}, "1-URGENT", ["survey_time", "o_orderkey"])


@register(
    "area_daily",
    f"""
    with {AREA_SQL}
    select flight, study_area, cast(day as integer) as day, {AREA_COLUMNS_SQL}
    from s where study_area <> '1-URGENT' group by flight, study_area, day""",
)
def area_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = all_areas(spark, sf_dir).daily
    return rounded(rounded(daily, "total_depth", digits=2), "total_swe", digits=3)


@register(
    "area_flights",
    f"with {AREA_SQL} select flight, study_area, {AREA_COLUMNS_SQL} from s group by flight, study_area",
)
def area_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    flights = all_areas(spark, sf_dir).flights
    return rounded(rounded(flights, "total_depth", digits=2), "total_swe", digits=3)


@register(
    "area_total",
    """
    select round(sum(o_totalprice) / 100000, 3) as total_depth_km from orders""",
)
def area_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(all_areas(spark, sf_dir, gap=0).total_km, "total_depth_km", digits=3)
