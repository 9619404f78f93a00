"""Exact deduplication by Grace hashing.

Records are dealt out by the hash of their content, first over Spark partitions and, where a
partition's distinct contents outgrow the table, by further bits of the hash over spill files,
again and again until each bucket fits. A bucket's table is a Python dict: an open-addressing
table that compares complete contents whenever hashes meet. What is in the table stays there
while the rest is spilled, so each level settles at least one content and the recursion ends.

Spill files are private to a task, lie in the executor's own spill folders as Spark's do, and go
with it; a lost executor only means that the task runs again elsewhere.

Contents found more than `hot_rows` times, or with more than `hot_bytes` in all, are dealt out
further by doc_id, each part settled on its own, and the parts' survivors settled in a second,
small round. So no task sees more of one content than that.

Defined results: a null text counts as empty, and empty texts are copies of each other; a null
doc_id is larger than any other, so it stays only if all ids of its group are null; of rows that
repeat a doc_id and a text one is kept; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.words import squeezed, table
from firnline.staging import stage

TABLE_BYTES = 64 << 20
SLOT_BYTES, RECORD_BYTES = 450, 16  # what a content and a record take in Python beside the content itself
BUCKET_BYTES = 64 << 20
HOT_ROWS = 1000
HOT_BYTES = 16 << 20
FAN_OUT = 16
NO_ID = (1 << 63) - 1  # stands for a null doc_id
OUT_ROWS = 4096

_HEAD = struct.Struct("<qqqqI")
Record = tuple[int, int, int, int, bytes]  # first id, rows, hash, hot, content

_OUT = "doc_id long, keep_id long, group_size long, first boolean, text_sha256 string, hot boolean, h long, content binary"


class _Slot:
    """One content: the records found with it."""

    __slots__ = ("ids", "rows", "h", "hot")

    def __init__(self, h: int, hot: int):
        self.ids, self.rows, self.h, self.hot = array("q"), array("q"), h, hot


def settle(records: Iterable[Record], table_bytes: int, folder: str, depth: int = 0) -> Iterator[tuple[bytes, _Slot]]:
    """Each distinct content with its records."""
    table: dict[bytes, _Slot] = {}
    held, spills = 0, None
    for record in records:
        doc_id, rows, h, hot, content = record
        slot = table.get(content)
        if slot is None:
            if table and held + len(content) + SLOT_BYTES > table_bytes:
                if spills is None:
                    spills = [tempfile.TemporaryFile(dir=folder) for _ in range(FAN_OUT)]
                part = spills[_digit(h, depth)]
                part.write(_HEAD.pack(doc_id, rows, h, hot, len(content)))
                part.write(content)
                continue
            slot = table[content] = _Slot(h, hot)
            held += len(content) + SLOT_BYTES
        held += RECORD_BYTES
        slot.ids.append(doc_id)
        slot.rows.append(rows)
    yield from table.items()
    table.clear()
    for part in spills or ():
        with part:
            part.seek(0)
            yield from settle(_read(part), table_bytes, folder, depth + 1)


def _digit(h: int, depth: int) -> int:
    """Which of the spill files of this depth; other bits than those the shuffle used."""
    mixed = ((h ^ (depth * 0x9E3779B97F4A7C15)) * 0xFF51AFD7ED558CCD) & 0xFFFFFFFFFFFFFFFF
    return mixed >> 60


def _read(part) -> Iterator[Record]:
    while head := part.read(_HEAD.size):
        *rest, length = _HEAD.unpack(head)
        yield (*rest, part.read(length))


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[Record]:
    for batch in batches:
        columns = (batch.column(name) for name in ("doc_id", "rows", "h", "hot", "content"))
        yield from zip(*(column.to_pylist() for column in columns), strict=True)


def _settler(table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        with tempfile.TemporaryDirectory(prefix="grace-", dir=local if os.path.isdir(local) else None) as folder:
            out: list[tuple] = []
            for content, slot in settle(_records(batches), table_bytes, folder):
                digest = hashlib.sha256(content).hexdigest()
                keep, size = min(slot.ids), sum(slot.rows)
                first = True
                for doc_id in slot.ids:
                    stays = first and doc_id == keep
                    first = first and not stays
                    # A hot content goes on to the second round once per part.
                    sent = content if slot.hot and stays else None
                    out.append((doc_id, keep, size, stays, digest, bool(slot.hot), slot.h, sent))
                    if len(out) >= OUT_ROWS or (sent and len(sent) > 1 << 20):
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)

    return run


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("first", pa.bool_()),
     ("text_sha256", pa.string()), ("hot", pa.bool_()), ("h", pa.int64()), ("content", pa.binary())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA, strict=True)], schema=_SCHEMA)


def exact_groups(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES,
    bucket_bytes: int = BUCKET_BYTES, hot_rows: int = HOT_ROWS, hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """One row per row of `df`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of white space is made one space.
    """
    spark = df.sparkSession
    keyed = df.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        squeezed(F.col(text)).alias("content"),
    ).withColumn("h", F.xxhash64("content"))
    sizes = stage(
        keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).alias("bytes"))
    )
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    parts = F.ceil(F.greatest(F.col("n") / hot_rows, F.col("bytes") / hot_bytes)).cast("long")
    hot = stage(
        sizes.where((F.col("n") > 1) & (parts > 1)).select(F.col("h").alias("hot_h"), parts.alias("parts"))
    )
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    dealt = keyed.join(hot, keyed["h"] == hot["hot_h"], "left").select(
        "doc_id", F.lit(1).cast("long").alias("rows"), "h", F.col("parts").isNotNull().cast("long").alias("hot"),
        F.col("content").cast("binary").alias("content"),
        F.coalesce(F.pmod(F.xxhash64("doc_id"), "parts"), F.lit(0)).alias("part"),
    )
    run = _settler(table_bytes)
    first = stage(dealt.repartition(buckets, "h", "part").drop("part").mapInArrow(run, _OUT))
    cold = first.where(~F.col("hot")).select("doc_id", "keep_id", "group_size", "first", "text_sha256")
    survivors = first.where(F.col("content").isNotNull()).select(
        F.col("keep_id").alias("doc_id"), F.col("group_size").alias("rows"), "h", F.lit(0).cast("long").alias("hot"),
        "content",
    )
    merged = survivors.repartition("h").mapInArrow(run, _OUT)
    # One row per part and content: the part's survivor beside the content's.
    merged = merged.select(
        F.col("doc_id").alias("part_keep"), F.col("keep_id").alias("all_keep"),
        F.col("group_size").alias("all_size"), F.col("text_sha256").alias("sha"),
    ).distinct()
    parts_of = first.where("hot")
    settled = parts_of.join(
        merged, (parts_of["keep_id"] == merged["part_keep"]) & (parts_of["text_sha256"] == merged["sha"])
    ).select(
        "doc_id", F.col("all_keep").alias("keep_id"), F.col("all_size").alias("group_size"), "first", "text_sha256"
    )
    null_id = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return cold.unionAll(settled).select(
        null_id("doc_id"), null_id("keep_id"), "group_size",
        (F.col("first") & (F.col("doc_id") == F.col("keep_id"))).alias("kept"), "text_sha256",
    )


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` that stay, with its columns."""
    groups = stage(exact_groups(df, doc_id, text))
    digest = F.sha2(squeezed(F.col(f"_row.`{text}`")), 256)
    rows = df.select(F.struct("*").alias("_row")).withColumns(
        {"_id": F.col(f"_row.`{doc_id}`").cast("long"), "_sha": digest}
    )
    stays = groups.groupBy("doc_id", "text_sha256").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")
    )
    same = lambda other: rows["_id"].eqNullSafe(other["doc_id"]) & (rows["_sha"] == other["text_sha256"])
    gone = stage(stays.where(~F.col("kept")).select("doc_id", "text_sha256"))
    left = rows.join(gone, same(gone), "left_anti")
    repeated = stage(stays.where(F.col("kept") & (F.col("n") > 1)).select("doc_id", "text_sha256"))
    if repeated.limit(1).count():  # rows that repeat an id and a text: one of each
        again = rows.join(repeated, same(repeated), "left_semi").dropDuplicates(["_id", "_sha"])
        left = left.join(repeated, same(repeated), "left_anti").unionAll(again)
    return left.select("_row.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW same AS (PARTITION BY t)"""
