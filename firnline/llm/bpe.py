"""Byte-level BPE with the tiktoken library and a local rank file.

Encoding cuts a text with the splitting pattern and merges each match by the ranks. Texts are
first cut at safe boundaries, places where no match of the pattern can reach across: between a
character that is not white space and white space after it. Every match starts with at most one
space or is white space as a whole, so the pieces give the same matches as the text, and the
library never sees a long text. Short pieces recur, so a worker remembers the ids of a bounded
number of them. A piece that is still long (no such place) is cut by the pattern itself, one match
at a time; a match too long for the library's merge loop is merged here with a heap, in n log n.

Decoding joins the bytes of the ids; a token may be part of a character, so text is only formed
from the whole.

Rows are encoded on their own, in Arrow batches: no shuffle, and no state but the ranks, which a
Python worker loads once. The rank file is read on the executors and must exist at the same path
there.

Defined results: a null text is encoded as an empty one, into no ids; nulls in other columns are
carried; repeated rows are encoded alike; an empty table gives no rows; extra columns are kept
out of the way.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.words import table

#: Bytes of a single match up to which the library merges it.
MATCH_BYTES = 1 << 12
#: Pieces whose ids a worker remembers, and their greatest length.
MEMO_PIECES, MEMO_CHARS = 200_000, 64
# ASCII white space and what follows it, up to the next: a cut falls between a character that is
# no white space and white space, unless the text has other white space, which _OTHER finds.
_PIECE = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_OTHER = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Bpe:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in file if line.strip())}
    return Bpe(ranks, pattern)


class Bpe:
    """An encoding from ranks and the pattern that cuts texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.decimal = {i: str(i) for i in ranks.values()}
        self.memo = _Memo(self)

    def encode(self, text: str, match_bytes: int = MATCH_BYTES) -> list[int]:
        if _OTHER.search(text):
            return self._piece(text, match_bytes)
        pieces = _PIECE.findall(text)
        if match_bytes != MATCH_BYTES:
            return [i for piece in pieces for i in self._piece(piece, match_bytes)]
        return list(chain.from_iterable(map(self.memo.__getitem__, pieces)))

    def _piece(self, text: str, match_bytes: int = MATCH_BYTES) -> list[int]:
        if len(text) <= match_bytes // 4:
            return self.library.encode_ordinary(text)
        return self._matches(text, match_bytes)

    def _matches(self, text: str, match_bytes: int) -> list[int]:
        ids: list[int] = []
        for match in self.pattern.finditer(text):
            raw = match.group().encode()
            if (whole := self.ranks.get(raw)) is not None:
                ids.append(whole)
            elif len(raw) <= match_bytes:
                ids += self.library.encode_ordinary(match.group()) if self._one(match) else merge(raw, self.ranks)
            else:
                ids += merge(raw, self.ranks)
        return ids

    def _one(self, match: regex.Match) -> bool:
        """Whether the match is a match also when it stands alone."""
        alone = self.pattern.match(match.group())
        return alone is not None and alone.end() == len(match.group())

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


class _Memo(dict):
    """Ids of the pieces met so far; forgets all when full, so a worker's memory is bounded."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> list[int]:
        ids = self.bpe._piece(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def merge(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one match, always the lowest rank, leftmost first."""
    n = len(raw)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # neighbours of the part that starts at i
    alive = [True] * n
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(raw[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n and (rank := ranks.get(raw[i : after[after[i]]])) is not None:
            heapq.heappush(heap, (rank, i, after[after[i]]))

    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue
        gone = after[i]
        alive[gone] = False
        after[i] = end
        if end < n:
            before[end] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[raw[i : after[i]]])
        i = after[i]
    return out


def encode_column(df: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """Adds `name`, the token ids of the text, to the columns of `df` (replacing a column of that name)."""

    @F.pandas_udf("array<int>")
    def encode(texts):
        bpe = load(path, pattern)
        return texts.map(lambda t: bpe.encode(t or ""))

    return df.withColumn(name, encode(F.col(text)))


def decode_column(df: DataFrame, path: str, pattern: str, ids: str = "ids", name: str = "bytes") -> DataFrame:
    """Adds `name`, the bytes that the ids stand for."""

    @F.pandas_udf("binary")
    def decode(lists):
        bpe = load(path, pattern)
        return lists.map(lambda ids: bpe.decode([] if ids is None else list(ids)))

    return df.withColumn(name, decode(F.col(ids)))


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        decimal = bpe.decimal
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(decoded_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def token_digests(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every text; returns lengths and digests instead of the ids."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(
        _digests(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def vocabulary() -> tuple[str, str]:
    """The rank file and the pattern that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), *vocabulary())
