"""Removal of repeated passages by longest-previous-factor arrays over distributed suffixes.

A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller
doc_id. The suffixes that can matter are found and brought together in three exchanges:

1. Anchors. Every window of `length` bytes names the k-gram in it whose hash is smallest. Equal
   windows name equal k-grams at equal offsets, so windows need only be compared where their
   anchors agree. Each batch of documents sends its distinct anchors, about one per 16 bytes, to
   buckets by hash, and gets back those that another document has too.
2. Suffixes. For each shared anchor, the text around it, that is the union of the windows that name
   it, goes to a bucket by the anchor. There the suffixes at all window starts are sorted, equal
   neighbours (a common prefix of `length` bytes) form runs, and within the suffix order the
   previous and the next suffix of a smaller document give the longest previous factor: if it
   reaches `length`, the window starting there is a later copy.
3. Spans. The starts found go back to their documents, where they become removed byte ranges.

Before each exchange a batch settles what it can: equal contexts inside it are represented by the
one of the smallest document, and later ones are marked at once. So a passage in a third of all
documents sends one context per batch, not one per document.

Rows travel as packed arrays, one row per batch and bucket. Texts are read once for the anchors and
shuffled twice, never held longer than a batch; long texts are handled in pieces that overlap.

Defined results: a null text is empty; a null doc_id (or one of 2 ** 62 and above) is larger than any
other, and null ids are ordered among themselves by a hash of their text; rows that repeat a doc_id do not remove each other;
texts shorter than `length` keep everything; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.words import table, whole
from firnline.staging import release, stage

LENGTH = 50
GRAM = 20  # bytes of an anchor
PIECE = 1 << 19  # bytes handled at once
GROUP_BYTES = 24 << 20  # text bytes per group of documents
SLICE_ROWS = 2048  # documents whose anchors are settled together
SORT_WINDOWS = 1 << 18  # suffixes sorted at once, unless one anchor has more
NULLS = 1 << 62  # from here on stand null ids, by the hash of their text

_rng = np.random.default_rng(50)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_MIX = [np.uint64(int(x) | 1) for x in _rng.integers(1, 1 << 63, 8, dtype=np.uint64)]
_IDX = np.uint64((1 << 20) - 1)

# An occurrence of an anchor: its document (id and text hash), the anchor's place, and how far
# before it the first and the last window start that name it.
OCCURRENCE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("h", "<u4"), ("at", "<u4"), ("lo", "u1"), ("hi", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("h", "<u4"), ("start", "<u4"), ("end", "<u4")])


def _pack(records: np.ndarray) -> bytes:
    """Column by column, which compresses better than row by row."""
    return b"".join(np.ascontiguousarray(records[name]).tobytes() for name in records.dtype.names)


def _unpack(parts: Iterable[bytes], dtype: np.dtype) -> np.ndarray:
    found = [np.empty(0, dtype)]
    for data in parts:
        n, at = len(data) // dtype.itemsize, 0
        records = np.empty(n, dtype)
        for name in dtype.names:
            records[name] = np.frombuffer(data, dtype[name], n, at)
            at += n * dtype[name].itemsize
        found.append(records)
    return np.concatenate(found)


def gram_keys(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM = 16 + 4 bytes from each place on."""
    h1 = _BYTE[data]
    h2 = h1[:-1] * _MIX[0] + h1[1:]
    h4 = h2[:-2] * _MIX[1] + h2[2:]
    h8 = h4[:-4] * _MIX[2] + h4[4:]
    h16 = h8[:-8] * _MIX[3] + h8[8:]
    h = h16[:-4] * _MIX[4] + h4[16:]
    h ^= h >> np.uint64(29)
    h *= _MIX[5]
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(data: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the window starts that are valid: key, place, and first and last start of each anchor.

    `data` has fewer than 2 ** 20 bytes; `valid` marks the starts whose window ends in its text.
    """
    empty = np.empty(0, np.int64)
    if len(data) < length or not valid.any():
        return np.empty(0, np.uint64), empty, empty, empty
    keys = gram_keys(data)
    packed = (keys & ~_IDX) | np.arange(len(keys), dtype=np.uint64)
    best = (_sliding_min(packed, length - GRAM + 1) & _IDX).astype(np.int64)
    starts = np.flatnonzero(valid[: len(best)])
    place = best[starts]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    return keys[place[first]], place[first], starts[first], starts[last]


def _pieces(docs: Iterable[tuple[int, int, bytes]], length: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Groups of (doc, h, offset, bytes) of at most PIECE bytes; long texts in overlapping pieces."""
    held, size = [], 0
    for doc, h, raw in docs:
        for at in range(0, max(1, len(raw) - length + 1), PIECE):
            piece = raw[at : at + PIECE + length - 1]
            if len(piece) < length:
                continue
            if size + len(piece) > PIECE and held:
                yield held
                held, size = [], 0
            held.append((doc, h, at, piece))
            size += len(piece)
    if held:
        yield held


def occurrences(docs: Iterable[tuple[int, int, bytes]], length: int) -> np.ndarray:
    found = []
    for group in _pieces(docs, length):
        data = np.frombuffer(b"".join(p[3] for p in group), np.uint8)
        sizes = np.array([len(p[3]) for p in group])
        begin = np.r_[0, np.cumsum(sizes)[:-1]]
        valid = np.ones(len(data), bool)
        for s, n in zip(begin, sizes, strict=True):
            valid[s + n - length + 1 : s + n] = False
        key, place, low, high = anchors(data, valid, length)
        owner = np.searchsorted(begin, place, "right") - 1
        out = np.empty(len(key), OCCURRENCE)
        out["key"] = key
        out["doc"] = np.array([p[0] for p in group])[owner]
        out["h"] = np.array([p[1] for p in group])[owner]
        out["at"] = place - begin[owner] + np.array([p[2] for p in group])[owner]
        out["lo"], out["hi"] = place - low, place - high
        found.append(out)
    return np.concatenate(found) if found else np.empty(0, OCCURRENCE)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def _of_group(doc: np.ndarray, h: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that (doc, h) belongs to; the same as `_group_column`."""
    return h.astype(np.int64) % groups


def _group_column(groups: int):
    return F.col("h") % groups


def _packed(where: np.ndarray, records: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """One row (part, kind, records) per part."""
    if len(records):
        order = np.argsort(where, kind="stable")
        where, records = where[order], records[order]
        cuts = np.flatnonzero(where[1:] != where[:-1]) + 1
        for part, rows in zip(where[np.r_[0, cuts]], np.split(records, cuts), strict=True):
            yield int(part), kind, _pack(rows)


_PACKED = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
_PACKED_DDL = "part long, kind int, data binary"
ASK, KNOWN = 0, 1


def _rows_out(rows: Iterable[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 8 << 20 or len(held) > 4096:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), _PACKED, strict=True)], schema=_PACKED)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), _PACKED, strict=True)], schema=_PACKED)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    yield from zip(*(batch.column(c).to_pylist() for c in ("doc", "h", "content")), strict=True)


def _by_key(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by key and document, the first of each run of a key in it, and whether the run has several documents."""
    order = np.lexsort((records["doc"], records["key"]))
    keys, docs = records["key"][order], records["doc"][order]
    if not len(keys):
        return order, np.empty(0, int), np.empty(0, bool)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    last = np.r_[first[1:], len(keys)] - 1
    return order, first, docs[first] != docs[last]


def _ask(length: int, groups: int):
    """Documents to anchors: those shared inside the batch are known, the others are asked about."""

    def rows(batch):
        records = occurrences(_documents(batch), length)
        order, first, shared = _by_key(records)
        known = np.empty(len(records), bool)
        known[order] = np.repeat(shared, np.diff(np.r_[first, len(records)]))
        yield from _packed(_of_group(records["doc"][known], records["h"][known], groups), records[known], KNOWN)
        # Of a shared anchor only a sign goes out, with no window of its own.
        signs = records[order[first[shared]]]
        signs["lo"], signs["hi"] = 0, 1
        asked = np.concatenate([records[~known], signs])
        yield from _packed(_bucket(asked["key"], groups), asked, ASK)

    def slices(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield from rows(batch.slice(at, SLICE_ROWS))

    return lambda batches: _rows_out(slices(batches))


def _answer(groups: int):
    """Rows of one bucket after the other: the anchors that more than one document has. What is known passes."""

    def run(batches):
        for _, rows in _parts(batches):
            yield from (r for r in rows if r[1] == KNOWN)
            records = _unpack((r[2] for r in rows if r[1] == ASK), OCCURRENCE)
            order, first, shared = _by_key(records)
            hit = records[order[np.repeat(shared, np.diff(np.r_[first, len(records)]))]]
            hit = hit[hit["lo"] >= hit["hi"]]  # without the signs
            yield from _packed(_of_group(hit["doc"], hit["h"], groups), hit, KNOWN)

    return lambda batches: _rows_out(run(batches))


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by part, one part after the other."""
    part, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != part and held:
                yield part, held
                held = []
            part = row[0]
            held.append(row)
    if held:
        yield part, held


def _merged_streams(batches: Iterable[pa.RecordBatch], dtype: np.dtype):
    """Rows (part, kind, data, doc, h, content) sorted by part and kind: each document with its records."""
    part, held, index = None, [], None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "data", "doc", "h")]
        for p, data, doc, h, content in zip(*columns, batch.column("content"), strict=True):
            if p != part:
                part, held, index = p, [], None
            if data is not None:
                held.append(data)
                continue
            if index is None:
                records = _unpack(held, dtype)
                records = records[np.lexsort((records["doc"], records["h"]))]
                # Of the type of what is looked up, or each search would convert the whole column.
                held, index = [], (records, records["h"].astype(np.int64))
            records, hashes = index
            low, high = np.searchsorted(hashes, np.array([h, h + 1], np.int64)).tolist()
            mine = records[low:high]
            yield p, doc, h, content.as_py(), mine[mine["doc"] == doc]


def _contexts(length: int, groups: int):
    """Documents with their shared anchors to contexts, one per distinct context of a group of documents."""
    # 32 bits of an anchor are enough in its bucket: contexts of two anchors that meet are only compared more.
    field = np.dtype([("key", "<u4"), *((n, OCCURRENCE[n]) for n in OCCURRENCE.names[1:])])

    def flush(seen: dict, groups_out: list):
        # seen: context -> [smallest doc, its occurrences]
        records, texts = [], []
        for (_, context), (_, places) in seen.items():
            records += places
            texts += [context] * len(places)
        whole_keys = np.array(records, OCCURRENCE) if records else np.empty(0, OCCURRENCE)
        where = _bucket(whole_keys["key"], groups)
        table = whole_keys.astype(field)  # the low bits of the key
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.diff(where[order])) + 1
        for rows in np.split(order, cuts) if len(order) else ():
            head = table[rows]
            body = b"".join(texts[i] for i in rows)
            yield int(where[rows[0]]), ASK, len(rows).to_bytes(8, "little") + _pack(head) + body
        if groups_out:
            spans = np.array(groups_out, SPAN)
            yield from _packed(_of_group(spans["doc"], spans["h"], groups), spans, KNOWN)

    def run(batches):
        part, seen, later, size = None, {}, [], 0
        for p, doc, h, content, mine in _merged_streams(batches, OCCURRENCE):
            if p != part or size > 8 << 20:
                yield from flush(seen, later)
                part, seen, later, size = p, {}, [], 0
            for key, _, _, at, lo, hi in mine.tolist():
                context = content[at - lo : at - hi + length]
                place = (key, doc, h, at, lo, hi)
                slot = seen.get((lo, context))
                if slot is None:
                    seen[lo, context] = [doc, [place]]
                    size += len(context) + 200
                elif doc == slot[0]:
                    slot[1].append(place)
                elif doc > slot[0]:
                    later.append((doc, h, at - lo, at - hi + length))
                else:  # a smaller document: what stood for the context is a later copy
                    later += [(d, g, a - o, a - i + length) for _, d, g, a, o, i in slot[1]]
                    slot[:] = [doc, [place]]
        yield from flush(seen, later)

    return lambda batches: _rows_out(run(batches)), field


def longest_previous(windows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each suffix, cut at the window's length: whether one of a smaller document has it too.

    `windows` is a matrix of bytes. In suffix order, runs of equal rows are the suffixes with a
    common prefix of full length. The previous (next) suffix of a smaller document shares the full
    length with a suffix exactly if the smallest document before (after) it in its run is smaller.
    """
    n, length = windows.shape
    words = np.zeros((n, -(-length // 8) * 8), np.uint8)
    words[:, :length] = windows
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])  # the suffix array
    sorted_words = words[order]
    new = np.r_[True, (sorted_words[1:] != sorted_words[:-1]).any(axis=1)]  # where the common prefix is shorter
    run = np.cumsum(new) - 1
    _, rank = np.unique(doc[order], return_inverse=True)
    many = np.int64(rank.max() + 1)
    before = np.minimum.accumulate(rank + (run[-1] - run) * many) - (run[-1] - run) * many
    after = np.minimum.accumulate((rank + run * many)[::-1])[::-1] - run * many
    later = np.minimum(before, after) < rank
    out = np.empty(n, bool)
    out[order] = later
    return out


def _settle(length: int, groups: int, field: np.dtype):
    """Contexts of one bucket after the other: the window starts that are later copies."""

    def spans_of(chosen, contexts, entries) -> Iterator[tuple[int, int, int, int]]:
        """`chosen`: contexts that share an anchor with other contexts."""
        counts = np.array([len(contexts[c][1]) - length + 1 for c in chosen])
        data = np.frombuffer(b"".join(contexts[c][1] for c in chosen), np.uint8)
        begin = np.r_[0, np.cumsum(counts + length - 1)[:-1]]
        first = np.r_[0, np.cumsum(counts)[:-1]]
        start = np.repeat(begin - first, counts) + np.arange(counts.sum())
        doc = np.repeat(np.array([contexts[c][2] for c in chosen]), counts)
        later = longest_previous(np.lib.stride_tricks.sliding_window_view(data, length)[start], doc)
        edge = np.zeros(len(later) + 1, bool)  # where a context begins
        edge[np.r_[first, len(later)]] = True
        before, after = np.r_[False, later[:-1]], np.r_[later[1:], False]
        low = np.flatnonzero(later & (edge[:-1] | ~before))
        high = np.flatnonzero(later & (edge[1:] | ~after))
        owner = np.searchsorted(first, low, "right") - 1
        for c, a, b in zip(owner.tolist(), (low - first[owner]).tolist(), (high - first[owner]).tolist(), strict=True):
            for e in contexts[chosen[c]][3]:
                _, d, h, at, lo, _ = entries[e]
                yield d, h, at - lo + a, at - lo + b + length

    def run(batches):
        for _, rows in _parts(batches):
            yield from (r for r in rows if r[1] == KNOWN)
            entries, texts = [], []
            for _, kind, data in rows:
                if kind == KNOWN:
                    continue
                n = int.from_bytes(data[:8], "little")
                head = _unpack([data[8 : 8 + n * field.itemsize]], field)
                sizes = head["lo"].astype(np.int64) - head["hi"] + length
                ends = np.cumsum(sizes)
                body = memoryview(data)[8 + n * field.itemsize :]
                entries += head.tolist()
                texts += [bytes(body[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            found, contexts, by_anchor, index = [], [], {}, {}
            for i, (entry, text) in enumerate(zip(entries, texts, strict=True)):
                key, doc, _, _, lo, _ = entry
                c = index.get((lo, text))
                if c is None:
                    index[lo, text] = len(contexts)
                    by_anchor.setdefault(key, []).append(len(contexts))
                    contexts.append([key, text, doc, [i]])
                    continue
                slot = contexts[c]
                if doc == slot[2]:
                    slot[3].append(i)
                    continue
                gone = [i] if doc > slot[2] else slot[3]
                found += [
                    (d, g, a - o, a - e + length) for _, d, g, a, o, e in (entries[x] for x in gone)
                ]
                if doc < slot[2]:
                    slot[2:] = [doc, [i]]
            chosen, windows = [], 0
            for group in by_anchor.values():
                if len(group) < 2:
                    continue
                chosen += group
                windows += sum(len(contexts[c][1]) - length + 1 for c in group)
                if windows >= SORT_WINDOWS:
                    found += spans_of(chosen, contexts, entries)
                    chosen, windows = [], 0
            if chosen:
                found += spans_of(chosen, contexts, entries)
            spans = np.array(found, SPAN) if found else np.empty(0, SPAN)
            yield from _packed(_of_group(spans["doc"], spans["h"], groups), spans, KNOWN)

    return lambda batches: _rows_out(run(batches))


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Spans as maximal runs, in order."""
    if not len(spans):
        return []
    order = np.argsort(spans["start"], kind="stable")
    start, end = spans["start"][order], np.maximum.accumulate(spans["end"][order])
    new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return list(zip(start[new].tolist(), end[np.r_[new[1:], len(end)] - 1].tolist(), strict=True))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())),
                     ("ends", pa.list_(pa.int64())), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _results(with_text: bool):
    def run(batches):
        held, size = [], 0
        for _, doc, _, content, mine in _merged_streams(batches, SPAN):
            spans = merged(mine)
            at, left = 0, []
            for a, b in spans:
                left.append(content[at:a])
                at = b
            left = b"".join([*left, content[at:]])
            held.append((None if doc >= NULLS else doc, len(content), [a for a, _ in spans], [b for _, b in spans],
                         hashlib.sha256(left).hexdigest(), left if with_text else None))
            size += len(left) if with_text else 100
            if size > 8 << 20 or len(held) >= 4096:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), _RESULT, strict=True)], schema=_RESULT)
                held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), _RESULT, strict=True)], schema=_RESULT)

    return run


def repeated_spans(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = False,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """One row per row of `df`: doc_id, n_bytes, starts and ends of the removed runs, the sha256 of what
    is kept and, if asked for, the kept bytes."""
    if not GRAM < length <= GRAM + 255:
        raise ValueError(f"length must be above {GRAM} and at most {GRAM + 255}")
    spark = df.sparkSession
    content = whole(F.col(text))
    h = F.xxhash64(F.col(doc_id).cast("long"), content)
    docs = df.select(
        F.coalesce(F.col(doc_id).cast("long"), NULLS + F.shiftrightunsigned(h, 33)).alias("doc"),
        h.bitwiseAND(F.lit(0xFFFFFFFF)).alias("h"), content.cast("binary").alias("content"),
    )
    total = docs.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // group_bytes))
    of_doc = docs.select(
        _group_column(groups).alias("part"), F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("data"),
        "doc", "h", "content",
    )

    def beside(packed: DataFrame) -> DataFrame:
        """Documents and the packed rows of their group, the packed rows first."""
        none = lambda kind: F.lit(None).cast(kind)
        rows = packed.select("part", "kind", "data", none("long").alias("doc"), none("long").alias("h"), none("binary").alias("content"))
        return rows.unionAll(of_doc).repartition(groups, "part").sortWithinPartitions("part", "kind")

    def bucketed(packed: DataFrame) -> DataFrame:
        return packed.repartition(groups, "part").sortWithinPartitions("part")

    known = stage(
        bucketed(docs.mapInArrow(_ask(length, groups), _PACKED_DDL)).mapInArrow(_answer(groups), _PACKED_DDL)
    )
    contexts, field = _contexts(length, groups)
    spans = stage(
        bucketed(beside(known).mapInArrow(contexts, _PACKED_DDL)).mapInArrow(_settle(length, groups, field), _PACKED_DDL)
    )
    release(spark, known)
    ddl = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept_sha256 string, kept binary"
    return beside(spans).mapInArrow(_results(with_text), ddl)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    lengths = F.zip_with("ends", "starts", lambda e, s: e - s)
    return found.select(
        "doc_id", "n_bytes", F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"), "kept_sha256",
    )
