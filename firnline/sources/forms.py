"""Form exports: CSV text to typed canonical columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from firnline.functions.missing import quoted
from firnline.functions.parse import (
    NULL_TOKENS,
    TIME_FORMATS,
    blank_to_null,
    parse_number,
    parse_time,
)
from firnline.operators.rows import union_all

# Columns that put rows back in file order: file, place of the split, row within it.
FILE_ORDER = ("src_file", "src_block", "src_row")


def repair_name(name: str) -> str:
    """Header text as a plain name: other characters become dots, a leading digit gets an X."""
    fixed = re.sub(r"[^A-Za-z0-9._]", ".", name.lstrip("\ufeff"))
    return "X" + fixed if not fixed or re.match(r"[0-9_]", fixed) else fixed


def numbered(names: Sequence[str]) -> list[str]:
    """Names made unique: the second and later of equal ones get .1, .2 and so on."""
    taken, out = set(names), []
    seen: dict[str, int] = {}
    for name in names:
        unique = name
        if name in seen:
            while unique in taken:
                seen[name] += 1
                unique = f"{name}.{seen[name]}"
        else:
            seen[name] = 0
        taken.add(unique)
        out.append(unique)
    return out


def read_form(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: StructType | None = None,
    mapping: Mapping[str, str] | None = None,
    header: bool = True,
    names: Sequence[str] = (),
    null_tokens: Sequence[str] = NULL_TOKENS,
    time_formats: Sequence[str] = TIME_FORMATS,
    min_year: int | None = None,
    repair: bool = False,
    file_order: bool = False,
    multiline: bool = False,
    encoding: str = "UTF-8",
    skip: int = 0,
    unparsed: Observation | None = None,
) -> DataFrame:
    """Read one form version; each path has a header of its own, whose columns are found by name.

    Files of one path (a folder or a pattern) must agree in their header, or reading fails;
    `read_folder` reads those that do not.

    `mapping` is `{canonical: header name}` and also selects; without it all named columns are
    kept (a leading row-number column has no name and goes). Names that repeat, as they stand or
    once repaired, are numbered; mapping such a name is an error. `schema` gives the type of the
    columns by canonical name, text otherwise. `header=False` takes `names` by position.
    Nothing is inferred: text is read, missing tokens become NULL, and what does not fit its
    type becomes NULL. Only the columns used are parsed. `file_order` adds FILE_ORDER. `skip`
    leaves out so many lines at the start of each file, before the header. `unparsed` holds,
    once the table has been used, how many cells of each typed column had text that did not fit.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    how = _Parsing(schema, null_tokens, time_formats, min_year, repair, file_order, unparsed)
    if not header:
        raw = _lines_read(spark, given, names, skip, encoding) if skip else (
            _reader(spark, multiline, encoding, False).schema(_texts(names)).csv(given)
        )
        return _parsed(raw, list(names), mapping, how)
    tables = []
    for path in given:
        if skip:
            shown = _header_after(spark, path, skip, encoding)
            raw = _lines_read(spark, [path], [f"_c{i}" for i in range(len(shown))], skip + 1, encoding)
        else:
            first = _reader(spark, multiline, encoding, False).csv(path).head()
            shown = list(first) if first else []
            reader = _reader(spark, multiline, encoding, True)
            if len({(c or "").lower() for c in shown}) < len(shown):
                # Spark numbers repeated names itself and then misses them in the header.
                _header_after(spark, path, 0, encoding)
                reader = reader.option("enforceSchema", True)
            raw = reader.csv(path)
        tables.append((raw, shown))
    if unparsed is not None and len(tables) > 1:
        raise ValueError("one path at a time can be counted")
    return union_all(*[_parsed(raw, shown, mapping, how, header=True) for raw, shown in tables])


class _Parsing(NamedTuple):
    schema: StructType | None
    null_tokens: Sequence[str]
    time_formats: Sequence[str]
    min_year: int | None
    repair: bool
    file_order: bool
    unparsed: Observation | None


def _reader(spark: SparkSession, multiline: bool, encoding: str, header: bool) -> DataFrameReader:
    return (
        spark.read.option("encoding", encoding)
        .option("header", header)
        .option("enforceSchema", False)
        .option("multiLine", multiline)
        .option("escape", '"')
    )


def _texts(names: Sequence[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def _parsed(
    raw: DataFrame, header_cells: Sequence[str | None], mapping: Mapping[str, str] | None, how: _Parsing, header: bool = False
) -> DataFrame:
    """The columns of `raw`, whose header has these cells, as typed canonical columns."""
    columns = [c for c in raw.columns if c not in FILE_ORDER]
    cells = [(c or "").lstrip("\ufeff") for c in header_cells]
    plain = [repair_name(c) if how.repair else c.strip() or f"_c{i}" for i, c in enumerate(cells)]
    shown = numbered(plain)
    if mapping is None:
        leading = 1 if header and cells and not cells[0].strip() else 0
        chosen = dict(list(zip(shown, columns, strict=True))[leading:])
    else:
        origin = dict(zip(shown, columns, strict=True))
        absent = [old for old in mapping.values() if old not in origin]
        if absent:
            raise ValueError(f"the form has no column {absent}")
        repeated = [old for old in mapping.values() if plain.count(old) > 1]
        if repeated:
            raise ValueError(f"the form has several columns {repeated}")
        chosen = {new: origin[old] for new, old in mapping.items()}
    kinds = {f.name: f.dataType for f in how.schema} if how.schema else {}
    texts = {n: blank_to_null(quoted(c), how.null_tokens) for n, c in chosen.items()}
    typed = {n: _typed(t, kinds.get(n), how.time_formats, how.min_year) for n, t in texts.items()}
    rows = [t.alias(n) for n, t in typed.items()]
    if how.file_order:
        place = [
            F.col("_metadata.file_path"),
            F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id(),
        ]
        if FILE_ORDER[0] in raw.columns:
            place = [F.col(n) for n in FILE_ORDER]
        rows += [p.alias(n) for p, n in zip(place, FILE_ORDER, strict=True)]
    if how.unparsed is None:
        return raw.select(*rows)
    counted = [n for n in texts if n in kinds and not isinstance(kinds[n], StringType)]
    bad = {f"_bad_{i}": texts[n].isNotNull() & typed[n].isNull() for i, n in enumerate(counted)}
    flagged = raw.select(*rows, *[c.alias(n) for n, c in bad.items()])
    counts = [F.count_if(F.col(b)).alias(n) for b, n in zip(bad, counted, strict=True)]
    if not counts:
        raise ValueError("no column has a type that text could fail to fit")
    return flagged.observe(how.unparsed, *counts).drop(*bad)


def _lines(spark: SparkSession, paths: Sequence[str], encoding: str) -> DataFrame:
    """All lines with their place: file, split and a number that grows in the split."""
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    text = spark.read.option("encoding", encoding).text(list(paths))
    return text.select("value", *[p.alias(n) for p, n in zip(place, FILE_ORDER, strict=True)])


def _starts(lines: DataFrame) -> DataFrame:
    """One row per file: the number of its first line."""
    path, block, row = FILE_ORDER
    return lines.where(F.col(block) == 0).groupBy(F.col(path).alias("_file")).agg(F.min(row).alias("_start"))


def _line_of_file(lines: DataFrame) -> DataFrame:
    """`lines` with `_place`, the place (from 0) of a line in its file; only those of a first split have one."""
    path, block, row = FILE_ORDER
    placed = lines.join(_starts(lines), F.col(path) == F.col("_file"), "left")
    return placed.withColumn("_place", F.when(F.col(block) == 0, F.col(row) - F.col("_start"))).drop("_file", "_start")


def _header_after(spark: SparkSession, path: str, skip: int, encoding: str) -> list[str | None]:
    heads = _line_of_file(_lines(spark, [path], encoding)).where(F.col("_place") == skip)
    found = heads.select("value").distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"files of {path} differ in their header")
    return _cells(spark, found[0].value) if found else []


def _cells(spark: SparkSession, line: str) -> list[str | None]:
    """The cells of one line of CSV."""
    width = line.count(",") + 1
    schema = ", ".join(f"_c{i} string" for i in range(width))
    row = spark.range(1).select(F.from_csv(F.lit(line), schema, {"escape": '"'}).alias("r")).first().r
    cells = list(row)
    while len(cells) > 1 and cells[-1] is None and width > 1:
        cells.pop()
        width -= 1
    return cells


def _lines_read(spark: SparkSession, paths: Sequence[str], names: Sequence[str], skip: int, encoding: str) -> DataFrame:
    """Lines after the first `skip` of each file, as text columns beside FILE_ORDER."""
    lines = _line_of_file(_lines(spark, paths, encoding))
    rest = lines.where((F.coalesce(F.col("_place"), F.lit(skip)) >= skip) & (F.trim("value") != ""))
    schema = ", ".join(f"`{n}` string" for n in names)
    return rest.select(F.from_csv("value", schema, {"escape": '"'}).alias("_row"), *FILE_ORDER).select("_row.*", *FILE_ORDER)


def read_folder(
    spark: SparkSession, path: str, mappings: Sequence[Mapping[str, str]], schema: StructType, encoding: str = "UTF-8",
    **options,
) -> DataFrame:
    """Read a folder of several form versions: files are grouped by their header and each group is
    read in one scan, by the mapping with the most columns of those that its header has in full.

    The census reads the first lines once; the driver gets one path per file, as Spark's own listing does.
    """
    places = _lines(spark, [path], encoding)
    file, block, row = FILE_ORDER
    heads = places.where(F.col(block) == 0).groupBy(file).agg(F.min_by("value", row).alias("header"))
    versions = heads.groupBy("header").agg(F.sort_array(F.collect_list(file)).alias("files")).orderBy("header").collect()
    how = {"null_tokens": NULL_TOKENS, "time_formats": TIME_FORMATS, "min_year": None, "repair": False,
           "file_order": False, "unparsed": None}
    multiline = options.pop("multiline", False)
    unknown = set(options) - set(how)
    if unknown or options.get("unparsed") is not None:
        raise TypeError(f"read_folder does not take {sorted(unknown) or 'unparsed'}")
    parsing = _Parsing(schema, **{**how, **options})
    tables = []
    for version in versions:
        cells = _cells(spark, version.header)
        named = [(c or "").lstrip("\ufeff") for c in cells]
        names = {repair_name(c) if parsing.repair else c.strip() for c in named}
        fitting = [m for m in mappings if set(m.values()) <= names]
        if not fitting:
            raise ValueError(f"no mapping fits the header of {version.files[0]}: {version.header}")
        raw = _reader(spark, multiline, encoding, True).csv(version.files)
        tables.append(_parsed(raw, cells, max(fitting, key=len), parsing, header=True))
    empty = spark.createDataFrame([], schema)
    return union_all(empty, *tables)


def read_versions(
    spark: SparkSession,
    versions: Sequence[tuple[str | Sequence[str], Mapping[str, str]]],
    schema: StructType,
    **options,
) -> DataFrame:
    """Read several form versions, each with its own mapping, into one table."""
    return union_all(*[read_form(spark, p, schema, m, **options) for p, m in versions])


def _typed(text: Column, kind: DataType | None, time_formats: Sequence[str], min_year: int | None) -> Column:
    name = "string" if kind is None else kind.simpleString()
    if name in ("int", "bigint"):
        # Whole numbers are cast as they stand: a double holds only 53 bits of them.
        whole = F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text).try_cast(name))
        return F.coalesce(whole, parse_number(text).try_cast(name))
    if name in ("double", "float"):
        return parse_number(text)
    if name in ("timestamp", "timestamp_ntz"):
        return parse_time(text, time_formats, min_year).cast(name)
    return text if name == "string" else text.try_cast(name)
