"""Field-survey cases with known answers, a few rows each, and the whole trip by hand."""

import pytest
from pyspark.sql import functions as F

from firnline.functions import parse_number, parse_time, swe
from firnline.operators import coords, geo, reshape, rows, station, totals
from firnline.operators.complete import complete_template, plot_template
from firnline.operators.multipart import resolve_multipart
from firnline.operators.summarise import summarise_plots
from firnline.plans import trip as trip_plan
from firnline.plans.trip import plot_table, run_trip
from firnline.schema import COORD, OBSERVATION, PLOT_SUMMARY, table
from firnline.staging import stage as write_stage
from helpers import at, by_key, rows_of, unordered

FORM = table(
    "survey_time:time study_area:str plot_id:str plot_type:str sample_type:str "
    "cardinal_direction:str dist_from_centre:dbl multi_core:str depth:dbl core:dbl plug:dbl mass:dbl"
)
# One plot as entered: probes without a flag, single cores, and two cores in two parts each.
PLOT = [
    ("13:08:19", "W", None, 305, None, None, None),
    ("13:09:03", "Centre", "no", 244, 224, 7, 1260),
    ("13:11:29", "W", None, 319, None, None, None),
    ("13:11:58", "W", None, 268, None, None, None),
    ("13:12:20", "N", "no", 244, 214, 0, 1220),
    ("13:14:01", "N", None, 248, None, None, None),
    ("13:14:44", "N", None, 276, None, None, None),
    ("13:15:22", "N", None, 276, None, None, None),
    ("13:19:18", "E", None, 253, None, None, None),
    ("13:20:05", "E", None, 252, None, None, None),
    ("13:20:24", "E", None, 274, None, None, None),
    ("13:24:46", "S", "no", 184, 151, 1, 950),
    ("13:25:45", "S", None, 254, None, None, None),
    ("13:26:06", "S", None, 242, None, None, None),
    ("13:26:34", "S", None, 216, None, None, None),
    ("13:05:31", "W", "yes", 288, 150, 0, 800),
    ("13:06:39", "W", "yes", 200, 132, None, 750),
    ("13:15:59", "E", "yes", 293, 200, 4, 1000),
    ("13:17:27", "E", "yes", 293, 83, None, 630),
]


def plot_form(spark):
    data = [
        (at(f"2021-04-27 {t}"), "North", "10000", "Cardinal 10 m", None, way, None, flag, *map(_dbl, m))
        for t, way, flag, *m in PLOT
    ]
    return spark.createDataFrame(data, FORM)


def _dbl(x):
    return None if x is None else float(x)


def test_split_core_counts_once_per_part(spark):
    """Parts entered at different times repeat the merged core, so the plot has 19 rows."""
    trip = run_trip([plot_form(spark)], spark.createDataFrame([], COORD))
    plot = by_key(trip.plots)["10000"]
    assert plot["count"] == 19
    assert plot["mean_depth"] == pytest.approx(263.210526315789, abs=1e-9)
    assert (plot["med_depth"], plot["max_depth"], plot["min_depth"]) == (268, 319, 183)
    assert plot["sd_depth"] == pytest.approx(32.1447748430068, abs=1e-9)
    assert plot["swe"] == pytest.approx(100.947644500781, abs=1e-9)
    assert plot["density"] == pytest.approx(0.387208749145147, abs=1e-12)
    once = run_trip([plot_form(spark)], spark.createDataFrame([], COORD), metadata="first")
    assert by_key(once.plots)["10000"]["count"] == 17
    assert trip.observations.schema == OBSERVATION
    assert trip.plots.columns == PLOT_SUMMARY.names


def test_each_form_is_scanned_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "form")
    plot_form(spark).write.parquet(path)
    plans = []

    def staged(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write_stage(df)

    monkeypatch.setattr(trip_plan, "write_stage", staged)
    fixes = rows.literal_table(
        spark, table("rank:int plot_id:str sample_type:str offset:dbl"), [(1, "10000", None, 1.0)]
    )
    out = run_trip([spark.read.parquet(path)], spark.createDataFrame([], COORD), rules=fixes)
    plans += [t._jdf.queryExecution().executedPlan().toString() for t in (out.plots, out.daily_depth, out.daily_density)]
    assert sum(p.count(path) for p in plans) == 1
    assert by_key(out.plots)["10000"]["count"] == 19


def test_observation_order_does_not_change_the_first_row(spark):
    form = plot_form(spark).repartition(5)
    plot = by_key(plot_table(run_trip([form], spark.createDataFrame([], COORD)).observations,
                             spark.createDataFrame([], COORD)))
    assert plot["10000"]["plot_datetime"] == at("2021-04-27 13:05:31")


COURSE = [
    ("1a", "431", 406, 2, 1630, 5), ("2a", "442", 403, 2, 1650, 5), ("3a", "344", 307, 0, 640, 4),
    ("3b", "446", 121, 9, 590, 4), ("4a", "267", 192, 0, 597, 5), ("4b", "?", 101, 0, 550, 4),
    ("4c", "403", 47, 8, 140, 4), ("snow scale single density", "402", 331, 0, 1560, 5),
]


def test_snow_course_and_scale(spark):
    visits = spark.createDataFrame(
        [(label, depth, *map(float, rest)) for label, depth, *rest in COURSE],
        "label string, depth string, core double, plug double, mass double, rating double",
    ).withColumns(
        {
            "depth": parse_number("depth"),
            "core_no": F.substring("label", 1, 1),
            "t": parse_time(F.lit("3/9/2021 9:59")),
        }
    )
    out = by_key(
        station.merge_station_cores(visits, ["core_no"], "t", ["label"], "sum", skip_missing=False),
        "core_no",
    )
    assert set(out) == {"1", "2", "3", "4", "s"}
    known = {
        "1": (429, 406, 2, 1630, 117.651953396722, 0.274246977614737),
        "2": (440, 403, 2, 1650, 119.095535646989, 0.270671671924974),
        "3": (437, 428, 9, 1230, 88.7803083913916, 0.203158600437967),
        "4": (395, 340, 8, 1287, 92.8945178046512, 0.235175994442155),
        "s": (402, 331, 0, 1560, 112.599415520789, 0.280098048559177),
    }
    for core, (depth, length, plug, mass, water, density) in known.items():
        row = out[core]
        assert (row["depth"], row["core"], row["plug"], row["mass"]) == (depth, length, plug, mass)
        assert row["swe"] == pytest.approx(water, abs=1e-11)
        assert row["density"] == pytest.approx(density, abs=1e-12)
    course = spark.createDataFrame(
        [(v[0] * 1.0, v[4], v[5], k) for k, v in known.items() if k != "s"], "depth double, swe double, density double, k string"
    ).withColumn("p", F.lit("course"))
    stats = summarise_plots(course, ["p"], "depth", ["k"], (), ["swe", "density"]).first()
    assert (stats["mean_depth"], stats["med_depth"], stats["max_depth"], stats["count"]) == (425.25, 433, 440, 4)
    assert stats["sd_depth"] == pytest.approx(20.69420209, abs=1e-8)
    assert stats["swe"] == pytest.approx(104.6055788, abs=1e-7)
    assert stats["density"] == pytest.approx(0.245813311, abs=1e-9)


def test_bare_ground_has_density_zero_where_asked(spark):
    cores = [("1", 0, 0, 0), ("2", 35, 26, 200), ("3", 18, 14, 50)]
    df = spark.createDataFrame(
        [(k, 1, float(d), float(c), 0.0, float(m)) for k, d, c, m in cores],
        table("k:str t:int depth:dbl core:dbl plug:dbl mass:dbl"),
    )
    out = by_key(
        station.merge_station_cores(df, ["k"], "t", ["t"], zero_density=True, rating=None), "k"
    )
    assert (out["1"]["swe"], out["1"]["density"]) == (0.0, 0.0)
    assert out["2"]["density"] == pytest.approx(0.412452071504723, abs=1e-12)


def test_plot_centroid(spark):
    stakes = [
        ("na", 5504506.96, 329592.287, 1366.28), ("cam", 5504515.995, 329592.7662, 1363.873),
        ("cam", 5504524.725, 329594.3092, 1363.117), ("cam", 5504527.172, 329600.8852, 1362.22),
        ("cam", 5504516.82, 329601.0362, 1362.979), ("cam", 5504520.878, 329606.2522, 1362.194),
    ]
    df = spark.createDataFrame(
        [(p, n, e, z, f"fix{i}", i) for i, (p, n, e, z) in enumerate(stakes)],
        table("plot_id:str northing:dbl easting:dbl elev:dbl solution:str i:int"),
    )
    mean = coords.centroids(
        rows.keep(df, not_equal={"plot_id": "na"}), "plot_id", ["northing", "easting", "elev"], ["solution"], ["i"]
    )
    (plot, north, east, height, solution) = rows_of(mean)[0]
    assert (plot, solution) == ("cam", "fix1")
    assert (north, east, height) == pytest.approx((5504521.118, 329599.0498, 1362.8766), abs=1e-3)
    export = coords.coord_export(mean, "utm10", "plot_id", "northing", "easting", "elev")
    assert export.columns == ["sta", "utm_n", "utm_e", "height", "utm_z"]


# Zone, easting, northing, latitude, longitude of surveyed points.
POINTS = [
    (9, 687709.047, 5576465.258, 50.31037912, -126.36363754),
    (9, 687780.589, 5576288.816, 50.30877118, -126.3627216),
    (10, 330643.330, 5503665.223, 49.66172496, -125.34678424),
    (10, 330745.787, 5503356.824, 49.65898212, -125.34523246),
    (10, 496414.871, 5491036.653, 49.57191005, -123.04958588),
    (10, 496997.882, 5493313.309, 49.59239107, -123.04153964),
]


def test_utm_both_ways(spark):
    df = spark.createDataFrame(
        [(f"UTM{z}", e, n, lat, lon) for z, e, n, lat, lon in POINTS],
        table("zone:str e:dbl n:dbl lat0:dbl lon0:dbl"),
    )
    there = geo.utm_forward(df, "lat0", "lon0", geo.zone_number("zone"))
    back = geo.utm_inverse(there, "e", "n", geo.zone_number("zone"))
    for r in back.collect():
        assert (r["easting"], r["northing"]) == pytest.approx((r["e"], r["n"]), abs=1.5e-3)
        assert (r["lat"], r["lon"]) == pytest.approx((r["lat0"], r["lon0"]), abs=1.2e-8)


def test_utm_south(spark):
    df = spark.createDataFrame([(-33.86, 151.21)], "lat0 double, lon0 double")
    out = geo.utm_forward(df, "lat0", "lon0", 56, south=True)
    back = geo.utm_inverse(out, "easting", "northing", 56, south=True).first()
    assert back["northing"] > 6e6
    assert (back["lat"], back["lon"]) == pytest.approx((-33.86, 151.21), abs=1e-9)


def test_coordinate_table(spark):
    utm = spark.createDataFrame(
        [("a", 1.0, 2.0, 3.0), ("b", 4.0, 5.0, 6.0)], table("station:str utm_e:dbl utm_n:dbl height:dbl")
    )
    geographic = spark.createDataFrame([("a", 49.0, -125.0, 3.0)], table("station:str lat:dbl lon:dbl height:dbl"))
    out = coords.coord_table(utm, geographic)
    assert out.columns == COORD.names
    assert unordered(rows_of(out)) == [("a", 1.0, 2.0, 3.0, -125.0, 49.0), ("b", 4.0, 5.0, 6.0, None, None)]


def test_wide_positions_to_long(spark):
    wide = spark.createDataFrame(
        [("s", 469.0, None, None), ("r", None, 540.0, 555.0)], "plot string, Centre double, `N7.5` double, S10 double"
    )
    long = reshape.to_long(wide, ["plot"], "Centre:S10", "position", "depth")
    assert unordered(rows_of(long)) == unordered(
        [("s", "Centre", 469.0), ("r", "N7.5", 540.0), ("r", "S10", 555.0)]
    )
    assert reshape.to_long(wide, ["plot"], "Centre:S10", "p", "d", drop_null=False).count() == 6


def test_plots_are_completed_to_33_positions(spark):
    assert len(plot_template()) == len(set(plot_template())) == 33
    seen = [
        ("p", "N", 2.5, at("2021-06-16 10:00:00"), "old", 12.0),
        ("p", "N", 2.5, at("2021-06-16 10:05:00"), None, 14.0),
        ("p", "Centre", None, at("2021-06-16 10:10:00"), None, None),
        ("p", "N", 3.0, at("2021-06-16 23:00:00"), "elsewhere", 99.0),
        ("q", "X", 1.0, at("2021-06-16 11:00:00"), "lost", 5.0),
    ]
    df = spark.createDataFrame(seen, table("plot_id:str way:str dist:dbl t:time kind:str depth:dbl"))
    out = complete_template(
        df, "plot_id", ["way", "dist"], plot_template(), ["t", "kind"], {"depth": 0.0}, ["t"],
        {"plot_type": "Cardinal 10 m"},
    )
    counts = {r["plot_id"]: r["count"] for r in totals.rows_per_key(out, ["plot_id"]).collect()}
    assert counts == {"p": 34, "q": 33}  # the repeated point stays twice
    p, q = out.where("plot_id = 'p'"), out.where("plot_id = 'q'")
    assert rows_of(p.agg(F.sum("depth"), F.count_distinct("kind"), F.max("t"))) == [
        (26.0, 1, at("2021-06-16 10:10:00"))
    ]
    assert rows_of(q.agg(F.sum("depth"), F.count("kind"), F.count("t"))) == [(0.0, 0, 0)]
    assert rows_of(out.select("plot_type").distinct()) == [("Cardinal 10 m",)]


def test_whole_trip_by_hand(spark):
    t1, t2, t3 = at("2021-04-22 09:00:00"), at("2021-04-23 10:00:00"), at("2021-04-23 11:00:00")
    form = spark.createDataFrame(
        [
            (t1, "A", "old1", "C", "Depth", "N", 5.0, None, 100.0, None, None, None),
            (t2, "A", "p1", "C", "Density", "S", 5.0, "no", 200.0, 150.0, 10.0, 500.0),
            (t3, "A", "p2", "C", "Density", None, None, "yes", 300.0, 100.0, None, 400.0),
            (t3, "A", "p2", "C", "Density", None, None, "yes", 310.0, 100.0, 5.0, 300.0),
            (t3, "A", "p2", "C", "Depth", "E", 5.0, "maybe", 1.0, None, None, None),
        ],
        FORM,
    )
    sites = spark.createDataFrame([("p1", 1.0, 2.0, 3.0, -4.0, 5.0)], COORD)
    fixes = rows.literal_table(
        spark, table("rank:int plot_id:str sample_type:str offset:dbl"), [(1, "old1", "Depth", 10.0)]
    )
    names = rows.literal_table(spark, table("old:str new:str"), [("old1", "p1")])
    weather = rows.align(
        spark.createDataFrame([("p1", t1, 50.0)], table("plot_id:str survey_time:time depth:dbl")),
        OBSERVATION, sample_type="Depth", plot_type="wx",
    )
    trip = run_trip([form], sites, weather, fixes, names, flight=3, hot_rows=2)
    plots = by_key(trip.plots)
    assert set(plots) == {"p1", "p2"}
    p1, p2 = plots["p1"], plots["p2"]
    assert (p1["mean_depth"], p1["med_depth"], p1["count"], p1["easting"]) == (350 / 3, 110.0, 3, 1.0)
    assert p1["swe"] == pytest.approx(500 / (3.14159265359 * 2.1 * 2.1))
    assert (p2["mean_depth"], p2["count"], p2["easting"], p2["sd_depth"]) == (305.0, 1, None, None)
    assert unordered(rows_of(trip.daily_depth)) == [(22, 1.6), (23, 4.95)]
    assert unordered(rows_of(trip.daily_density)) == [(23, 4.95)]
    assert {r["flight"] for r in trip.observations.collect()} == {3, None}


def test_trip_with_repeats_and_template(spark):
    t = at("2021-06-17 10:00:00")
    form = spark.createDataFrame(
        [
            (t, "A", "p", "C", "Depth", "N", 2.5, None, 10.0, 8.0, 0.0, 100.0),
            (t, "A", "p", "C", "Density", "N", 2.5, "no", 20.0, 12.0, 2.0, 200.0),
            (t, "A", "p", "C", "Density", "W", 5.0, "yes", 30.0, 12.0, 0.0, 200.0),
        ],
        FORM,
    )
    trip = run_trip([form], spark.createDataFrame([], COORD), repeats=True, template=plot_template())
    seen = by_key(trip.observations, "cardinal_direction")
    assert (seen["N"]["depth"], seen["N"]["mass"], seen["W"]["depth"]) == (14.0, 150.0, 30.0)
    plot = by_key(trip.plots)["p"]
    assert plot["count"] == 33 and plot["mean_depth"] == pytest.approx(44 / 33)
    assert plot["swe"] == pytest.approx((150 + 200) / 2 / (3.14159265359 * 2.1 * 2.1))
    assert rows_of(trip.daily_depth) == [(17, 0.44)]


def test_one_area_reports_in_other_units(spark):
    from firnline.functions import scale_units

    df = spark.createDataFrame([("mm", 50.0), ("cm", 5.0), (None, 5.0)], table("area:str swe:dbl"))
    out = df.withColumn("swe", scale_units("swe", "area", {"mm": 10.0}))
    assert {r[1] for r in rows_of(out)} == {5.0}


def test_depth_as_read_with_the_other_density(spark):
    form = spark.createDataFrame(
        [("a", "N", "no", 1, 100.0, 80.0, 10.0, 600.0), ("a", "S", "no", 1, 100.0, 80.0, None, 600.0)],
        table("plot_id:str way:str multi_core:str t:int depth:dbl core:dbl plug:dbl mass:dbl"),
    )
    out = by_key(
        resolve_multipart(form, ["plot_id", "way"], ["plot_id", "way", "multi_core"], "B", pi=3.142), "way"
    )
    water = 600 / (3.142 * (2.1 * 2.1))
    assert out["N"]["depth"] == 100.0 and out["N"]["density"] == pytest.approx(water / 90)
    assert out["S"]["density"] is None and out["S"]["swe"] == pytest.approx(water)
    assert rows_of(spark.range(1).select(swe(F.lit(600.0), pi=3.142))) == [(pytest.approx(water),)]
