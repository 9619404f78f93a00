"""CSV forms in, tables out."""

import os

import pytest
from pyspark.sql import Observation

from firnline.operators import rows
from firnline.schema import table
from firnline.sources import read_folder, read_form, read_versions, write_table
from firnline.sources.forms import FILE_ORDER, numbered, repair_name
from helpers import at, rows_of, unordered

SCHEMA = table("plot_id:str t:time depth:dbl n:int flag:str")
MAPPING = {
    "plot_id": "Plot_ID",
    "t": "Obs.Depth__cm_:timestamp",
    "depth": "Obs.Depth__cm_",
    "n": "Obs.Count",
    "flag": "Obs.Multi",
}
HEADER = "Plot_ID,Obs.Depth__cm_:timestamp,Obs.Depth__cm_,Obs.Count,Obs.Multi"


@pytest.fixture
def write(tmp_path):
    def put(name, text, encoding="utf-8"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_text(text, encoding=encoding)
        return str(path)

    return put


def test_missing_tokens_and_bad_text(spark, write):
    path = write(
        "a.csv",
        f"{HEADER}\n"
        "P1,2021-04-27 13:08:19,305,1,no\n"
        "P2,3/9/2021 9:59,?,2.9,\n"
        'NA,later,NaN,x,""\n'
        '"Site, 1",NA,NA,NA,yes\n',
    )
    out = read_form(spark, path, SCHEMA, MAPPING)
    assert out.dtypes == [(f.name, f.dataType.simpleString()) for f in SCHEMA]
    assert unordered(rows_of(out)) == unordered(
        [
            ("P1", at("2021-04-27 13:08:19"), 305.0, 1, "no"),
            ("P2", at("2021-03-09 09:59:00"), None, 2, None),
            (None, None, None, None, None),
            ("Site, 1", None, None, None, "yes"),
        ]
    )


def test_columns_are_found_by_name_in_each_version(spark, write):
    new = write("new.csv", f"{HEADER}\nP1,NA,1,1,no\n")
    old = write("old.csv", "Flag,Plot,Depth\nyes,P9,9\n")
    out = read_versions(
        spark,
        [(new, MAPPING), (old, {"plot_id": "Plot", "depth": "Depth", "flag": "Flag"})],
        SCHEMA,
    )
    assert unordered(rows_of(out)) == unordered(
        [("P1", None, 1.0, 1, "no"), ("P9", None, 9.0, None, "yes")]
    )


def test_absent_column_is_refused(spark, write):
    path = write("a.csv", "x,y\n1,2\n")
    with pytest.raises(ValueError, match="no column"):
        read_form(spark, path, mapping={"z": "zz"})


def test_byte_order_mark_and_row_name_column(spark, write):
    marked = write("m.csv", "Plot_ID,depth\nP1,2\n", "utf-8-sig")
    assert rows_of(read_form(spark, marked, mapping={"p": "Plot_ID"})) == [("P1",)]
    numbered = write("r.csv", '"","Plot_ID","depth"\n"1","P1",2\n')
    assert read_form(spark, numbered).columns == ["Plot_ID", "depth"]


def test_names_repaired(spark, write):
    path = write("e.csv", "Plot_ID,Elev - Ellipsoid,2nd\nP1,1.5,3\n")
    out = read_form(spark, path, table("Elev...Ellipsoid:dbl"), repair=True)
    assert out.columns == ["Plot_ID", "Elev...Ellipsoid", "X2nd"]
    assert rows_of(rows.rename_select(out, {"e": "Elev...Ellipsoid"})) == [(1.5,)]
    assert repair_name("a b") == "a.b"


def test_repeated_names_are_numbered(spark, write):
    path = write("r.csv", "A-B,A.B,c,c,,\n1,2,3,4,5,6\n")
    out = read_form(spark, path, repair=True)
    assert out.columns == ["A.B", "A.B.1", "c", "c.1", "X", "X.1"]
    assert rows_of(out) == [("1", "2", "3", "4", "5", "6")]
    plain = read_form(spark, path)
    assert plain.columns == ["A-B", "A.B", "c", "c.1", "_c4", "_c5"]
    assert rows_of(plain) == [("1", "2", "3", "4", "5", "6")]
    with pytest.raises(ValueError, match="several columns"):
        read_form(spark, path, mapping={"x": "A.B"}, repair=True)
    assert rows_of(read_form(spark, path, mapping={"x": "A.B.1"}, repair=True)) == [("2",)]
    write("two/x.csv", "a,a\n1,2\n")
    other = write("two/y.csv", "b,a\n1,2\n")
    with pytest.raises(Exception, match="differ in their header|does not conform"):
        read_form(spark, other.replace("y.csv", "")).collect()
    assert numbered(["a", "a", "a.1", "a"]) == ["a", "a.2", "a.1", "a.3"]


def test_lines_before_the_header(spark, write):
    preamble = "".join(f"note {i}, with a comma\n" for i in range(8)) + "\n"
    rows_a = "".join(f"P{i},{i}\n" for i in range(3000))
    one = write("pre/one.csv", preamble + "Plot_ID,depth\n" + rows_a)
    write("pre/two.csv", preamble + "Plot_ID,depth\nnote 1, with a comma\n" + '"Q, 1",?\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = read_form(spark, one, table("depth:int"), skip=9, file_order=True)
        assert unordered(rows_of(out, "Plot_ID", "depth")) == unordered([(f"P{i}", i) for i in range(3000)])
        assert rows_of(rows.slice_rows(out, 2, 3, FILE_ORDER), "depth") == [(1,), (2,)]
        both = read_form(spark, one.replace("one.csv", ""), table("depth:int"), {"p": "Plot_ID", "depth": "depth"}, skip=9)
        assert both.count() == 3002
        assert unordered(rows_of(both.where("depth is null"), "p")) == unordered([("Q, 1",), ("note 1",)])
        bare = read_form(spark, one, header=False, names=["p", "d"], skip=10)
        assert bare.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    write("pre/three.csv", preamble + "Plot,depth\nx,1\n")
    with pytest.raises(ValueError, match="differ in their header"):
        read_form(spark, one.replace("one.csv", ""), skip=9)


def test_folder_of_two_versions(spark, write):
    write("mixed/a.csv", f"{HEADER}\nP1,NA,1,1,no\n")
    write("mixed/b.csv", f"{HEADER}\nP2,NA,2,1,yes\n", "utf-8-sig")
    write("mixed/c.csv", f"{HEADER}\nP3,NA,3,1,yes\n")
    last = write("mixed/d.csv", "Flag,Plot,Depth\nyes,P9,9\n")
    old = {"plot_id": "Plot", "depth": "Depth", "flag": "Flag"}
    folder = last.rpartition("/")[0]
    out = read_folder(spark, folder, [{"plot_id": "Plot"}, old, MAPPING], SCHEMA)
    assert out.dtypes == [(f.name, f.dataType.simpleString()) for f in SCHEMA]
    assert unordered(rows_of(out, "plot_id", "depth", "flag")) == unordered(
        [("P1", 1.0, "no"), ("P2", 2.0, "yes"), ("P3", 3.0, "yes"), ("P9", 9.0, "yes")]
    )
    scans = out._jdf.queryExecution().executedPlan().toString().count("FileScan csv")
    assert scans == 2
    with pytest.raises(ValueError, match="no mapping fits"):
        read_folder(spark, folder, [MAPPING], SCHEMA)


def test_cells_that_do_not_fit_are_counted(spark, write):
    path = write("u.csv", f"{HEADER}\nP1,soon,?,x,no\nP2,NA,NA,2,\nP3,3/9/2021 9:59,,y,1\n")
    seen = Observation("unparsed")
    out = read_form(spark, path, SCHEMA, MAPPING, unparsed=seen)
    assert out.columns == list(MAPPING) and out.count() == 3
    assert seen.get == {"t": 1, "depth": 1, "n": 2}


def test_second_write_replaces_its_flights_only(spark, tmp_path):
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        flights = spark.createDataFrame([("n", 1, 1), ("n", 2, 2), ("s", 1, 3)], "area string, flight int, v int")
        write_table(flights, path, fmt, partition_by=["area", "flight"])
        again = spark.createDataFrame([("n", 2, 20), ("n", 3, 30)], "area string, flight int, v int")
        write_table(again, path, fmt, partition_by=["area", "flight"], replace_parts=True)
        back = spark.read.schema("v int, area string, flight int").option("header", True).format(fmt).load(path)
        assert unordered(rows_of(back, "area", "flight", "v")) == [("n", 1, 1), ("n", 2, 20), ("n", 3, 30), ("s", 1, 3)]
    with pytest.raises(ValueError):
        write_table(flights, path, fmt, replace_parts=True)


def test_file_without_header(spark, write):
    path = write("points.txt", "P1,5504506.96,329592.287\nP2,5504510.1,329583.5\n")
    out = read_form(
        spark, path, table("northing:dbl"), header=False, names=["plot_id", "northing", "easting"]
    )
    assert unordered(rows_of(out, "plot_id", "northing")) == [("P1", 5504506.96), ("P2", 5504510.1)]


def test_rows_come_back_in_file_order(spark, write):
    lines = [f"P{i},{i}" for i in range(5000)]
    path = write("big/one.csv", "Plot_ID,depth\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        out = read_form(spark, path, table("depth:int"), file_order=True).repartition(7)
        cut = rows.slice_rows(out, 95, 130, FILE_ORDER)
        assert unordered(rows_of(cut, "depth")) == unordered([(i,) for i in range(94, 130)])
        tail = rows.slice_rows(out, 4990, None, FILE_ORDER)
        assert unordered(rows_of(tail, "depth")) == unordered([(i,) for i in range(4989, 5000)])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_only_the_columns_used_are_parsed(spark, write):
    path = write("a.csv", f"{HEADER}\nP1,NA,1,1,no\n")
    plan = read_form(spark, path, SCHEMA, {"depth": "Obs.Depth__cm_"})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<Obs.Depth__cm_:string>" in text


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("P1", at("2021-04-27 13:08:19"), 1.5, 3, None), (None, None, None, None, "a,b")], SCHEMA
    )
    path = str(tmp_path / "out")
    write_table(df, path)
    text = "".join(open(f"{path}/{f}").read() for f in os.listdir(path) if f.endswith(".csv"))
    assert "plot_id,t,depth,n,flag" in text and "2021-04-27 13:08:19" in text and "NA" in text
    assert unordered(rows_of(read_form(spark, path, SCHEMA))) == unordered(rows_of(df))


def test_row_numbers_follow_the_order(spark, tmp_path):
    df = spark.createDataFrame([("c", 3.0), ("a", 1.0), ("b", 2.0)], table("plot_id:str depth:dbl"))
    path = str(tmp_path / "numbered")
    write_table(df, path, row_number=True, order_by=["depth"])
    back = spark.read.option("header", True).csv(path)
    assert back.columns[0] == "row"
    assert unordered(rows_of(back)) == [("1", "a", "1.0"), ("2", "b", "2.0"), ("3", "c", "3.0")]


def test_parquet_by_area_and_flight(spark, tmp_path):
    df = spark.range(100).selectExpr(
        "case when id % 3 = 0 then 'n' else 's' end study_area", "int(id % 2) flight", "id"
    )
    path = str(tmp_path / "parts")
    write_table(df, path, "parquet", partition_by=["study_area", "flight"])
    back = spark.read.parquet(path)
    assert back.count() == 100
    pruned = back.where("study_area = 'n' and flight = 1")._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(study_area" in pruned.toString()
    with pytest.raises(ValueError):
        write_table(df, path + "2", "xlsx")
