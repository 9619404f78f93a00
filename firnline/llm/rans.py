"""Token ids in binary blocks, compressed by a static range asymmetric numeral system.

One frequency table, counted over all tokens and shared by all blocks, is fixed before anything is
encoded. A block is a run of whole documents in doc_id order and needs only that table to be
decoded. Inside a block, token i belongs to lane i mod lanes; all lanes step together, so a step is
a few array operations, and each lane is a coder of its own whose words are interleaved with the
others'. Every CHECKPOINT steps the lanes' states and the place in the word stream are noted, so
decoding can start there; the first of them is where decoding of the block starts. A checksum of
the block is verified before its words are used, and one of the ids after.

Files: a folder with two Parquet tables, `table` (token, frequency) and `blocks`, whose rows hold a
block's bytes, the doc_ids and lengths in it, and its place (part, block). Spark writes and commits
them, so a lost executor leaves nothing half-written, and they may lie in any store that Spark
reaches. A block is never larger than BLOCK tokens and the document that crosses it.

Tokens are found with the tokenizers library, once, and staged in 16 bits where the vocabulary fits:
the frequencies and the blocks are made from the staged ids. White space always ends a token here, and
each distinct word of a slice of texts is looked at once. Words of plain Latin letters, digits and marks
are lower-cased and cut as arrays, as the tokenizer's settings say; the ids of pieces met lately are
remembered, and the library's model gives those of others. Plain words with an apostrophe are cut one at a
time; any other word, and any tokenizer of other settings, takes the library's whole way.
The name of a special token in a text is that token, as by the library's default; none is added to a
text but the end id.

Defined results: a null text is empty and has the end id alone; a null doc_id comes after all
others; documents of equal id are ordered by a hash of their text; repeated rows are documents of
their own; an empty table gives empty files; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.llm.words import table, whole
from firnline.staging import folder, own, release, stage

BITS = 20  # frequencies sum to 2 ** BITS
BLOCK = 1 << 20  # tokens
LANES = 1024
CHECKPOINT = 256  # steps
PART_BYTES = 32 << 20  # packed ids per part
SLICE_BYTES = 4 << 20  # text tokenized at once
MEMO_WORDS = 400_000  # words remembered, and as many again from before
NO_ID = (1 << 63) - 1
END_ID = 2

_LOW = np.uint64(1 << 31)  # states are in [2 ** 31, 2 ** 63)
_WORD = np.uint64(32)
_HEAD = struct.Struct("<4sIIIQQII")  # magic, bits, lanes, checkpoints, tokens, words, crc of the rest, crc of the ids


class Frequencies:
    """The shared table."""

    def __init__(self, tokens: np.ndarray, freq: np.ndarray, bits: int = BITS):
        size = int(tokens.max()) + 1 if len(tokens) else 1
        self.bits = bits
        self.freq = np.zeros(size, np.uint64)
        self.freq[tokens] = freq
        self.start = np.r_[np.uint64(0), np.cumsum(self.freq)[:-1]].astype(np.uint64)
        self.token = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))

    @staticmethod
    def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
        """Counts (all above 0) as frequencies of at least 1 that sum to 2 ** bits."""
        if not len(counts):
            return counts.astype(np.int64)
        if len(counts) > 1 << bits:
            raise ValueError("more distinct tokens than the table has places")
        total = 1 << bits
        freq = np.maximum(1, (counts.astype(np.float64) * (total / counts.sum())).astype(np.int64))
        excess = int(freq.sum()) - total
        for i in np.argsort(-freq, kind="stable"):
            if excess <= 0:
                break
            cut = min(excess, int(freq[i]) // 2)
            freq[i] -= cut
            excess -= cut
        freq[np.argmax(freq)] -= min(excess, 0)
        return freq


def encode_block(ids: np.ndarray, table: Frequencies, lanes: int = LANES, checkpoint: int = CHECKPOINT) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, 1 << max(0, (n // 64).bit_length() - 1)))
    freq, start = table.freq[ids], table.start[ids]
    limit = freq << np.uint64(63 - table.bits)
    state = np.full(lanes, _LOW)
    bits = np.uint64(table.bits)
    words, marks = [], []
    for step in range(-(-n // lanes) - 1, -1, -1):
        at = slice(step * lanes, min(n, (step + 1) * lanes))
        x, f = state[: at.stop - at.start], freq[at]
        over = x >= limit[at]
        words.append((x[over] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(over, x >> _WORD, x)
        q = x // f
        state[: len(x)] = (q << bits) + (x - q * f) + start[at]
        if step % checkpoint == 0:
            marks.append((step, len(words), state.copy()))
    words.reverse()
    before = np.r_[0, np.cumsum([len(w) for w in words])] if words else np.zeros(1, np.int64)
    head = []
    for step, _, saved in reversed(marks):
        head.append(struct.pack("<QQ", step, int(before[step])) + saved.astype("<u8").tobytes())
    body = b"".join(head) + b"".join(w.tobytes() for w in words)
    ids_crc = zlib.crc32(ids.astype("<u4").tobytes())
    return _HEAD.pack(b"RANS", table.bits, lanes, len(marks), n, int(before[-1]), zlib.crc32(body), ids_crc) + body


def decode_block(data: bytes, table: Frequencies, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from checkpoint `first` up to checkpoint `last` (all by default)."""
    magic, bits, lanes, n_marks, n, n_words, crc, ids_crc = _HEAD.unpack_from(data)
    body = memoryview(data)[_HEAD.size :]
    if magic != b"RANS" or bits != table.bits:
        raise ValueError("not a block of this table")
    if zlib.crc32(body) != crc:
        raise ValueError("block is damaged")
    size = 16 + 8 * lanes
    words = np.frombuffer(body, "<u4", n_words, n_marks * size).astype(np.uint64)
    if not n:
        return np.empty(0, np.uint32)
    step, at = struct.unpack_from("<QQ", body, first * size)
    stop = -(-n // lanes) if last is None or last >= n_marks else struct.unpack_from("<Q", body, last * size)[0]
    state = np.frombuffer(body, "<u8", lanes, first * size + 16).astype(np.uint64)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    out = np.empty(min(n, stop * lanes) - step * lanes, np.uint32)
    done = 0
    for now in range(step, stop):
        k = min(n - now * lanes, lanes)
        x = state[:k]
        slot = x & mask
        token = table.token[slot]
        out[done : done + k] = token
        done += k
        x = table.freq[token] * (x >> shift) + slot - table.start[token]
        need = np.flatnonzero(x < _LOW)
        x[need] = (x[need] << _WORD) | words[at : at + len(need)]
        at += len(need)
        state[:k] = x
    if first == 0 and stop == -(-n // lanes) and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("ids do not match their checksum")
    return out


# The settings of a tokenizer that plain words may be cut for.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words of ASCII and of the letters from À to ſ, but for İ, which lower-cases to two characters.
_PLAIN = re.compile("[!-~À-įı-ſ]+")
#: The same cut as _CUT in lower-cased plain words.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")

#: Plain words that are cut as arrays: without apostrophes, which begin pieces of their own, signs among
#: the letters, and the names of special tokens.
_VECTOR = "^[!-&(-;=-~À-ÖØ-öø-įı-ſ]+$"
_DIGIT = 1
#: What a byte of such a word in lower case is: a letter or a part of one, a digit or a mark.
_KIND = np.array([_DIGIT if chr(b).isdigit() else 0 if chr(b).isalpha() else 2 for b in range(128)] + [0] * 128, np.uint8)


def _byte_letters() -> dict[int, int]:
    """The letter that stands for a byte: itself where it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: 256 + i for i, b in enumerate(others)}


class _Recent:
    """Answers to what was asked lately: when full, all but the newer half is forgotten."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: set) -> set:
        """Those of `keys` that are not known; the others are in `new` from now on."""
        unknown = keys.difference(self.new)
        if len(self.new) + len(unknown) > self.most:
            self.new, self.old = {}, self.new
            unknown = keys
        old = self.old
        back = {k: old[k] for k in unknown if k in old}  # not by intersection, which would walk through all of `old`
        self.new.update(back)
        return unknown.difference(back)


class Words:
    """Token ids of words, as little-endian unsigned integers of 16 bits or 32."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.plain = self._settings(path)
        self.letters = _byte_letters()
        self.words, self.pieces = _Recent(MEMO_WORDS), _Recent(MEMO_WORDS)

    @staticmethod
    def _settings(path: str) -> bool:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        names = [t["content"] for t in spec.get("added_tokens", [])]
        return (
            normal == _NORMAL and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"] == {"Regex": _CUT} and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
            and spec["model"]["type"] == "BPE" and all(n.startswith("<|") for n in names)
        )

    def _packed(self, ids: list[int]) -> bytes:
        packed = array("H" if self.type.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _piece(self, piece: str) -> bytes:
        # ASCII letters, digits and marks stand for themselves.
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return self._packed([token.id for token in self.model.tokenize(letters)])

    def _found(self, words: set[bytes]) -> Iterator[tuple[bytes, bytes]]:
        single, cut, whole_way = [], [], []
        for word in words:
            if self.plain and word.isalpha():  # ASCII letters only, for bytes
                single.append((word, word.lower().decode()))
                continue
            text = word.decode()
            if self.plain and _PLAIN.fullmatch(text) and "<|" not in text:
                cut.append((word, _PIECE.findall(text.lower())))
            else:
                whole_way.append((word, text))
        new = self.pieces.missing({piece for _, piece in single}.union(*(pieces for _, pieces in cut)))
        known = self.pieces.new
        known.update((piece, self._piece(piece)) for piece in new)
        for word, piece in single:
            yield word, known[piece]
        for word, pieces in cut:
            yield word, b"".join(map(known.__getitem__, pieces))
        found = self.tokenizer.encode_batch_fast([text for _, text in whole_way], add_special_tokens=False)
        for (word, _), encoding in zip(whole_way, found, strict=True):
            yield word, self._packed(encoding.ids)

    def ids(self, contents: list[bytes]) -> list[bytes]:
        return self.joined(pa.array(contents, pa.binary()), b"").to_pylist()

    def joined(self, contents: pa.Array, end: bytes) -> pa.Array:
        """Of each content the ids of its words, followed by `end`."""
        split = pc.ascii_split_whitespace(contents.cast(pa.string(), safe=False))  # white space around gives empty words
        coded = split.flatten().dictionary_encode()
        found, place = self._of_distinct(coded.dictionary)
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)
        order = np.insert(place[coded.indices.to_numpy(zero_copy_only=False)], ends, len(found))
        found = pa.concat_arrays([found, pa.array([end], pa.binary())])
        return _joined(found.take(pa.array(order)), np.r_[0, ends + np.arange(1, len(ends) + 1)])

    def _of_distinct(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The ids of the words in an order of their own, and each word's place in it."""
        vector = pc.match_substring_regex(words, _VECTOR) if self.plain else pa.array(np.zeros(len(words), bool))
        vector = vector.to_numpy(zero_copy_only=False)
        place = np.empty(len(words), np.int64)
        place[vector] = np.arange(np.count_nonzero(vector))
        place[~vector] = np.arange(np.count_nonzero(vector), len(words))
        others = words.filter(pa.array(~vector)).cast(pa.binary()).to_pylist()
        new = self.words.missing(set(others) - {b""})
        known = self.words.new
        known.update(self._found(new))
        known[b""] = b""
        ids = pa.array(map(known.__getitem__, others), pa.binary())
        return pa.concat_arrays([self._cut(words.filter(pa.array(vector))), ids]), place

    def _cut(self, words: pa.Array) -> pa.Array:
        """The ids of plain words without apostrophes, cut where letters, digits and marks meet."""
        if not len(words):
            return pa.array([], pa.binary())
        lower = pa.concat_arrays([pc.utf8_lower(words)])  # at offset 0
        _, begin, data = lower.buffers()
        begin = np.frombuffer(begin, np.int32, len(lower) + 1)
        kind = _KIND[np.frombuffer(data, np.uint8, begin[-1])]
        starts = np.empty(len(kind), bool)
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        starts[begin[:-1]] = True
        at = np.flatnonzero(starts)
        cuts = np.append(at, begin[-1]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(cuts), data]).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        new = self.pieces.missing(set(pieces))
        known = self.pieces.new
        known.update((piece, self._piece(piece)) for piece in new)
        found = pa.array(map(known.__getitem__, pieces), pa.binary())
        return _joined(found.take(coded.indices), np.searchsorted(at, begin))


def _joined(parts: pa.Array, cuts: np.ndarray) -> pa.Array:
    """Runs of binary values, from each of `cuts` to the next, as one value each; the bytes stay in place."""
    _, offsets, data = parts.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(parts) + 1)[cuts]
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), data])


@lru_cache(maxsize=2)
def load(path: str) -> Words:
    return Words(path)


_IDS_DDL = "doc_id long, h long, row long, width int, ids binary"


def _tokenized(path: str, end_id: int):
    """Rows (doc_id, h, row, content) to their ids, the end id included."""

    def run(batches):
        words = load(path)
        end = words._packed([end_id])

        def made(rows: pa.RecordBatch):
            found = words.joined(rows.column("content"), end)
            width = pa.array(np.full(len(found), words.type.itemsize, np.int32))
            return pa.record_batch([*rows.columns[:3], width, found], names=["doc_id", "h", "row", "width", "ids"])

        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("content")).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.r_[0, np.searchsorted(sizes, np.arange(SLICE_BYTES, sizes[-1], SLICE_BYTES)), batch.num_rows]) if len(sizes) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield made(batch.slice(a, b - a))

    return run


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}").astype("<u4")


def _count():
    def run(batches):
        counts = np.zeros(1 << 10, np.int64)
        for batch in batches:
            widths, ids = batch.column("width").to_pylist(), batch.column("ids").to_pylist()
            if not ids:
                continue
            found = np.bincount(_unpacked(b"".join(ids), widths[0]))
            if len(found) > len(counts):
                counts = np.pad(counts, (0, max(len(found), 2 * len(counts)) - len(counts)))
            counts[: len(found)] += found
        token = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(token, pa.int64()), pa.array(counts[token], pa.int64())], names=["token", "n"])

    return run


_BLOCKS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("n_tokens", pa.int64()),
                     ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])
_BLOCKS_DDL = "part long, block long, n_tokens long, doc_ids array<long>, lengths array<long>, data binary"


def _encode(tokens: list[int], freq: list[int], block: int):
    def run(batches):
        shared = Frequencies(np.array(tokens, np.int64), np.array(freq, np.uint64))
        part = TaskContext.get().partitionId()

        def made(number, held):
            ids = np.concatenate([ids for _, ids in held])
            row = [[part], [number], [len(ids)], [[doc for doc, _ in held]], [[len(x) for _, x in held]],
                   [encode_block(ids, shared)]]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

        number, held, size = 0, [], 0
        for batch in batches:
            for doc, width, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "width", "ids")), strict=True):
                held.append((doc, _unpacked(raw, width)))
                size += len(held[-1][1])
                if size >= block:
                    yield made(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield made(number, held)

    return run


def write_tokens(
    df: DataFrame, out: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
    block: int = BLOCK, part_bytes: int = PART_BYTES,
) -> None:
    """Writes the token ids of all documents, in ascending doc_id order, to the folder `out`."""
    spark = df.sparkSession
    content = whole(F.col(text))
    docs = df.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(content).alias("h"),
        F.monotonically_increasing_id().alias("row"), content.cast("binary").alias("content"),
    )
    ids = stage(docs.select("doc_id", "h", "row", "content").mapInArrow(_tokenized(tokenizer, end_id), _IDS_DDL))
    counted = ids.select("width", "ids").mapInArrow(_count(), "token long, n long")
    # One row per token of the vocabulary, which bounds what the driver gets.
    counts = counted.groupBy("token").agg(F.sum("n").alias("n")).orderBy("token").collect()
    tokens = [r.token for r in counts]
    freq = Frequencies.scaled(np.array([r.n for r in counts], np.int64)).tolist()
    spark.createDataFrame(list(zip(tokens, freq, strict=True)), "token long, frequency long").coalesce(1).write.parquet(f"{out}/table")
    total = ids.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    # The hash and the row number let equal ids be cut apart.
    ordered = ids.repartitionByRange(parts, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")
    blocks = ordered.select("doc_id", "width", "ids").mapInArrow(_encode(tokens, freq, block), _BLOCKS_DDL)
    blocks.write.option("compression", "none").parquet(f"{out}/blocks")
    release(spark, ids)


def _decode(tokens: list[int], freq: list[int], with_ids: bool):
    names = ["part", "block", "doc_id", "offset", "n_tokens", "ids_crc32", "ids"]

    def run(batches):
        shared = Frequencies(np.array(tokens, np.int64), np.array(freq, np.uint64))
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["data"], shared)
                ends = np.cumsum(row["lengths"])
                parts = [ids[e - n : e] for e, n in zip(ends.tolist(), row["lengths"], strict=True)]
                n = len(parts)
                columns = [
                    pa.array([row["part"]] * n, pa.int64()), pa.array([row["block"]] * n, pa.int64()),
                    pa.array([None if d == NO_ID else d for d in row["doc_ids"]], pa.int64()),
                    pa.array(ends - row["lengths"], pa.int64()), pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                    pa.array([p.tolist() for p in parts] if with_ids else [None] * n, pa.list_(pa.int32())),
                ]
                yield pa.record_batch(columns, names=names)

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document, decoded: doc_id, start (ids before it in all), n_tokens, ids_crc32, ids."""
    shared = spark.read.parquet(f"{path}/table").orderBy("token").collect()  # one row per token of the vocabulary
    blocks = spark.read.parquet(f"{path}/blocks")
    decoded = blocks.mapInArrow(
        _decode([r.token for r in shared], [r.frequency for r in shared], with_ids),
        "part long, block long, doc_id long, offset long, n_tokens long, ids_crc32 long, ids array<int>",
    )
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select(  # one row per part
        F.col("part").alias("_p"), F.coalesce(F.sum("n").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("_of_part")
    )
    inside = F.sum("n_tokens").over(earlier(Window.partitionBy("part").orderBy("block")))
    places = sizes.join(parts, F.col("part") == F.col("_p")).select(
        F.col("part").alias("_part"), F.col("block").alias("_block"),
        (F.col("_of_part") + F.coalesce(inside, F.lit(0))).alias("_before"),
    )
    return decoded.join(
        places, (decoded["part"] == places["_part"]) & (decoded["block"] == places["_block"])
    ).select("doc_id", (F.col("_before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "ids")


def vocabulary() -> str:
    """The tokenizer file that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = own(spark, f"{folder(spark)}/tokens-{uuid.uuid4().hex}")
    write_tokens(table(spark, sf_dir, "documents"), out, vocabulary())
    return read_tokens(spark, out, with_ids=False).drop("ids")
