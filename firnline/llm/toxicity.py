"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the hashes of its words and of their stems (first characters), of runs of
two and three words, and of pairs of words with one or two others between them, each counted once. FTRL-proximal keeps for every
coordinate a sum of adjusted gradients and a sum of squared ones; the latter give it a learning
rate of its own, and the L1 term leaves all but the telling coordinates at zero. What is left is a
few thousand weights, at most 2 ** HASH_BITS, which go to the executors with the scoring function.

Fitting takes at most TRAIN_ROWS labelled documents, those with the smallest hash of their id; the
bound keeps the fit the same at every corpus size. They are dealt out to SHARDS tasks, each of
which runs over its share in a fixed order, and whose states are averaged after every epoch.
Scoring reads every document, whole.

Defined results: a null or empty text has no features and gets the score of the intercept alone;
labels that are null or have no document are not used; a null doc_id is never held out; several
labels of a document count each; repeated rows get equal scores; without labels all scores are 0.5;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.words import table, whole
from firnline.staging import release, stage

HASH_BITS = 18
TRAIN_ROWS = 20_000
SHARDS = 4
EPOCHS = 5
THRESHOLD = 0.3
MEMO_WORDS = 200_000
STEMS = (4, 5, 6)  # characters; inflected forms share them
ALPHA, BETA, L1, L2 = 0.3, 1.0, 3.0, 0.1

_rng = np.random.default_rng(6)
_MIX = [np.uint64(int(x) | 1) for x in _rng.integers(1, 1 << 63, 8, dtype=np.uint64)]
_PUNCTUATION = b".,;:!?\"'()[]|*#$%&<>-"


class _Words(dict):
    """Numbers of the words met so far, and the hashes of each; forgets all when full.

    Row 0 of `hashes` is the word in lower case without punctuation around it, the others its
    stems: its first STEMS characters.
    """

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros((1 + len(STEMS), MEMO_WORDS), np.uint64)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            raise OverflowError
        at = self[word] = len(self)
        plain = word.strip(_PUNCTUATION).decode("utf-8", "replace")
        for row, part in enumerate([plain, *(plain[:n] + "~" for n in STEMS)]):
            self.hashes[row, at] = xxhash.xxh3_64_intdigest(part)
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        try:
            at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        except OverflowError:
            self.clear()
            if len(set(words)) > MEMO_WORDS:  # one text with more words than are remembered
                half = len(words) // 2
                return np.concatenate([self.of(words[:half]), self.of(words[half:])], axis=1)
            at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.hashes[:, at]


_memo = _Words()


def hashed(text: bytes) -> np.ndarray:
    """The feature numbers of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    all_hashes = _memo.of(words)
    h = all_hashes[0]
    parts = [all_hashes.ravel() * _MIX[0]]
    for i, gap in enumerate((1, 2, 3), 1):  # neighbours, and pairs with one or two words between
        if len(h) > gap:
            parts.append(h[:-gap] * _MIX[i] + h[gap:] * _MIX[0])
    if len(h) > 2:
        parts.append(h[:-2] * _MIX[4] + h[1:-1] * _MIX[5] + h[2:] * _MIX[0])
    x = np.concatenate(parts)
    x ^= x >> np.uint64(31)
    x *= _MIX[6]
    return (x >> np.uint64(64 - HASH_BITS)).astype(np.int64)


class State(NamedTuple):
    """FTRL's sums per coordinate; the last coordinate is the intercept."""

    z: np.ndarray
    n: np.ndarray

    @staticmethod
    def empty() -> State:
        return State(np.zeros((1 << HASH_BITS) + 1), np.zeros((1 << HASH_BITS) + 1))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(self.z), L1)
        l1[-1] = 0.0
        l1 = l1[at]
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """One document: its distinct features."""
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(at), L1)
        l1[-1] = 0.0  # the intercept comes last
        w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
        g = _sigmoid(w.sum()) - label
        root = np.sqrt(n + g * g)
        self.z[at] = z + g - (root - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _epoch(state: State):
    sparse = np.flatnonzero((state.z != 0) | (state.n != 0))
    z, n = state.z[sparse], state.n[sparse]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, mine, rows = None, State.empty(), 0

        def start() -> None:
            mine.z[:], mine.n[:] = 0.0, 0.0
            mine.z[sparse], mine.n[sparse] = z, n

        def result() -> pa.RecordBatch:
            at = np.flatnonzero((mine.z != 0) | (mine.n != 0))
            return pa.record_batch(
                [pa.array([rows]), *(pa.array([x.tobytes()], pa.binary()) for x in (at, mine.z[at], mine.n[at]))],
                names=["rows", "at", "z", "n"],
            )

        intercept = np.array([len(mine.z) - 1])
        for batch in batches:
            for of, label, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "label")), batch.column("content"), strict=True):
                if of != shard:
                    if rows:
                        yield result()
                    shard, rows = of, 0
                    start()
                mine.learn(np.r_[np.unique(hashed(text.as_py())), intercept], label)
                rows += 1
        if rows:
            yield result()

    return run


def fit(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = TRAIN_ROWS, shards: int = SHARDS, epochs: int = EPOCHS,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates, their weights and the intercept; learned from rows that are not held out."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).select(
        F.col(doc_id).alias("_id"), (F.col(label) > 0).cast("int").alias("label"), F.xxhash64(doc_id).alias("place")
    )
    chosen = chosen.orderBy("place", "_id", "label").limit(rows)
    docs = documents.select(F.col(doc_id).alias("_doc"), whole(F.col(text)).cast("binary").alias("content"))
    # `rows` bounds the broadcast.
    examples = docs.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select(
        F.pmod("place", F.lit(shards)).alias("shard"), "place", "label", "content"
    )
    # Texts are several times smaller than their features, which every epoch makes anew.
    examples = stage(examples)
    state = State.empty()
    for _ in range(epochs):
        dealt = examples.repartition(shards, "shard").sortWithinPartitions("shard", "place", "label", F.xxhash64("content"))
        # One row per shard, bounded by the number of coordinates.
        results = dealt.mapInArrow(_epoch(state), "rows long, at binary, z binary, n binary").collect()
        total = sum(r.rows for r in results)
        state = State.empty()
        for r in sorted(results, key=lambda r: (r.rows, bytes(r.z))):
            at = np.frombuffer(r.at, np.int64)
            state.z[at] += np.frombuffer(r.z) * (r.rows / total)
            state.n[at] += np.frombuffer(r.n) * (r.rows / total)
    release(documents.sparkSession, examples)
    weights = state.weights()
    at = np.flatnonzero(weights[:-1])
    return at, weights[at].astype(np.float32), float(weights[-1])


def _scored(at: np.ndarray, weights: np.ndarray, intercept: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << HASH_BITS, np.float32)
        dense[at] = weights
        for batch in batches:
            scores = []
            for content in batch.column("content"):
                found = hashed(content.as_py())
                found = np.unique(found[dense[found] != 0])
                scores.append(_sigmoid(intercept + float(dense[found].sum(dtype=np.float64))))
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(
    documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id and score of every document."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), whole(F.col(text)).cast("binary").alias("content"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_scored(*model), f"doc_id {kind}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
