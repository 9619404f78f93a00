"""Collocations mined from FM-indexes over word ids.

Documents are gathered into shards of one language and some SHARD_WORDS words, without a shuffle.
Each shard gets two Burrows-Wheeler transforms over its word ids, of the text and of the reversed
text. A phrase is an interval in each; a word added on its right narrows the interval of the
reversed text and moves the other by the number of smaller extensions, a word added on its left
does it the other way round. All phrases of one length are extended together, in turn to the right
and to the left, and an interval's size is the phrase's count in the shard.

Counts are summed across shards in two exchanges. First, each shard sends a 64-bit hash and a count
for each of its two-word phrases to buckets by hash, and gets back one bit for each: whether the sum
reaches `min_count`. A hash shared by several phrases can only raise the sum, so nothing frequent is
lost. A longer phrase is extended only while all its word pairs are frequent, which its own count
cannot exceed. Then phrases travel as text, and their sums are exact.

Suffixes are sorted by as many words as the longest phrase has, which is all that intervals of that
depth need. A piece longer than a shard is cut with an overlap, and what lies inside the overlap is
counted once more with a minus sign.

Defined results: a null text is empty; a null language is `und`; repeated rows count each time; ties
of score and count are ordered by the phrase's UTF-8 bytes; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.llm.words import table, whole
from firnline.staging import release, stage

SHARD_WORDS = 1 << 20
MAX_WORDS = 3
MIN_COUNT = 10
INSIDE_PERCENT = 50
TOP = 2000
BUCKET_BYTES = 4 << 20  # text bytes per bucket
BATCH = 1 << 16
#: Groups of a language in each round of the top list; a round passes on `TOP` rows of each group.
TOP_ROUNDS = (256, 16, 1)
NO_LANGUAGE = "und"

_BREAK = re.compile(rb"[.,;:!?\n-\r]+")
_STOP = b"."  # no word contains it
_LEFT, _RIGHT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: bytes) -> list[bytes]:
    """Words of all pieces, A-Z lower-cased, with a stop between pieces."""
    return _BREAK.sub(b" . ", text.lower()).split()


# ---- one shard --------------------------------------------------------------------------------


def _suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols; symbol 0 ends a suffix and differs from every other 0."""
    stops = symbols == 0
    rank = np.where(stops, np.cumsum(stops), symbols.astype(np.int64) + int(stops.sum()))
    order, step = np.argsort(rank, kind="stable"), 1
    while step < depth:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        key = rank * (int(rank.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])
        step *= 2
    return order


class _Transform:
    """A Burrows-Wheeler transform with rank queries."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.bwt = symbols[_suffix_order(symbols, depth) - 1]
        self.span = np.int64(len(symbols) + 1)
        places = np.argsort(self.bwt, kind="stable")
        self._keys = self.bwt[places].astype(np.int64) * self.span + places

    def extended(self, symbol: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Where the interval that starts at `start` starts once `symbol` stands before it: the
        number of smaller symbols and of the same symbol before `start`."""
        return np.searchsorted(self._keys, symbol * self.span + start)


class FMIndex:
    """Both transforms of a shard. `symbols` are word ids from 1 on, 0 between pieces and at both ends."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.left = _Transform(symbols, depth)
        self.right = _Transform(symbols[::-1], depth)
        self.size = int(symbols.max()) + 1
        self._symbols = symbols

    def words(self) -> dict[str, np.ndarray]:
        count = np.bincount(self._symbols, minlength=self.size)
        start = np.cumsum(count) - count
        word = np.flatnonzero(count[1:]) + 1
        return {"words": word[:, None], "count": count[word], "left": start[word], "right": start[word]}

    def extend(self, phrases: dict[str, np.ndarray], to_right: bool) -> dict[str, np.ndarray]:
        """All phrases one word longer than those given, on one side."""
        near, far = ("right", "left") if to_right else ("left", "right")
        index = self.right if to_right else self.left
        count = phrases["count"]
        owner = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(owner)) + np.repeat(phrases[near] - (np.cumsum(count) - count), count)
        found, n = np.unique(owner * self.size + index.bwt[place], return_counts=True)
        owner, symbol = np.divmod(found, self.size)
        before = np.cumsum(n) - n
        before -= before[np.searchsorted(owner, owner)]  # smaller extensions of the same phrase
        word = symbol > 0
        owner, symbol, n, before = owner[word], symbol[word], n[word], before[word]
        both = (phrases["words"][owner], symbol[:, None])
        return {
            "words": np.hstack(both if to_right else both[::-1]), "count": n,
            near: index.extended(symbol, phrases[near][owner]), far: phrases[far][owner] + before,
        }


def _selected(phrases: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {name: column[rows] for name, column in phrases.items()}


def _pair_hashes(pairs: np.ndarray, hashes: np.ndarray, lang: str) -> np.ndarray:
    h = hashes[pairs[:, 0] - 1] * _LEFT + hashes[pairs[:, 1] - 1] * _RIGHT
    h = (h ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))) * _MIX
    return h ^ (h >> np.uint64(32))


def _pairs(index: FMIndex, vocabulary: list[bytes], lang: str, buckets: int):
    """Two-word phrases in the order of (bucket, hash), their hashes and buckets."""
    pairs = index.extend(index.words(), to_right=True)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    h = _pair_hashes(pairs["words"], hashes, lang)
    bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((h, bucket))
    return _selected(pairs, order), h[order], bucket[order]


def _cuts(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])


# ---- Spark ------------------------------------------------------------------------------------

_SHARD = pa.schema([("shard", pa.string()), ("lang", pa.string()), ("sign", pa.int32()),
                    ("vocabulary", pa.binary()), ("symbols", pa.binary())])
_SHARD_DDL = "shard string, lang string, sign int, vocabulary binary, symbols binary"


class _Gathering:
    """Words of one language waiting to be a shard."""

    def __init__(self):
        self.ids: dict[bytes, int] = {_STOP: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        ids = self.ids
        for w in set(words).difference(ids):
            ids[w] = len(ids)
        self.parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))
        self.size += len(words) + 1

    def row(self, lang: str, sign: int) -> pa.RecordBatch | None:
        symbols = np.concatenate([np.zeros(1, np.int32), *self.parts])
        if not symbols.any():
            return None
        symbols = symbols[np.r_[True, (symbols[1:] != 0) | (symbols[:-1] != 0)]]  # one stop in a row
        vocabulary = b" ".join(w for w in self.ids if w != _STOP)
        data = symbols.astype("<i4").tobytes()
        name = xxhash.xxh3_128_hexdigest(data + vocabulary + lang.encode())
        cells = [[name], [lang], [sign], [vocabulary], [data]]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cells, _SHARD, strict=True)], schema=_SHARD)


def _sharded(shard_words: int, depth: int):
    def run(batches):
        held: dict[str, _Gathering] = {}
        overlaps: dict[str, _Gathering] = {}

        def put(to: dict[str, _Gathering], lang: str, words: list[bytes], sign: int):
            shard = to.setdefault(lang, _Gathering())
            shard.add(words)
            if shard.size >= shard_words:
                del to[lang]
                row = shard.row(lang, sign)
                if row is not None:
                    yield row
            while sum(s.size for s in to.values()) > 2 * shard_words:
                lang = max(to, key=lambda name: to[name].size)
                row = to.pop(lang).row(lang, sign)
                if row is not None:
                    yield row

        for batch in batches:
            for lang, content in zip(batch.column("lang").to_pylist(), batch.column("content"), strict=True):
                words = words_of(content.as_py())
                if len(words) <= shard_words:
                    yield from put(held, lang, words, 1)
                    continue
                for at in range(0, len(words), shard_words):
                    end = at + shard_words
                    yield from put(held, lang, words[at : end + depth - 1], 1)
                    if end < len(words):
                        yield from put(overlaps, lang, words[end : end + depth - 1], -1)
        for sign, to in ((1, held), (-1, overlaps)):
            for lang, shard in to.items():
                row = shard.row(lang, sign)
                if row is not None:
                    yield row

    return run


def _loaded(row: dict, depth: int) -> tuple[FMIndex, list[bytes]]:
    return FMIndex(np.frombuffer(row["symbols"], "<i4"), depth), row["vocabulary"].split(b" ")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


_ASK = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
_ASK_DDL = "bucket long, shard long, hashes binary, counts binary"


def _ask(buckets: int, depth: int):
    """Shards to the hashes and counts of their two-word phrases, one row per bucket."""

    def run(batches):
        for row in _rows(batches):
            index, vocabulary = _loaded(row, depth)
            pairs, h, bucket = _pairs(index, vocabulary, row["lang"], buckets)
            if not len(h):
                continue
            first = _cuts(bucket)
            last = np.r_[first[1:], len(h)]
            n = (pairs["count"] * row["sign"]).astype("<i4")
            cells = [
                bucket[first].tolist(), [row["number"]] * len(first),
                [h[a:b].astype("<u8").tobytes() for a, b in zip(first, last, strict=True)],
                [n[a:b].tobytes() for a, b in zip(first, last, strict=True)],
            ]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cells, _ASK, strict=True)], schema=_ASK)

    return run


_MASK_DDL = "shard long, bucket long, mask binary"


def _answer(min_count: int):
    """One bucket after the other: a bit for each hash that was asked about."""

    def settled(rows):
        hashes = [np.frombuffer(r[2], "<u8") for r in rows]
        counts = np.concatenate([np.frombuffer(r[3], "<i4") for r in rows]).astype(np.float64)
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        # Whole numbers below 2 ** 53, so the sums are exact.
        frequent = (np.bincount(place, counts) >= min_count)[place]
        ends = np.cumsum([len(h) for h in hashes])
        masks = [np.packbits(m).tobytes() for m in np.split(frequent, ends[:-1])]
        return pa.record_batch(
            [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
             pa.array(masks, pa.binary())], names=["shard", "bucket", "mask"],
        )

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield settled(held)
                    held = []
                held.append(row)
        if held:
            yield settled(held)

    return run


_PHRASE_DDL = "lang string, phrase string, n_words int, n long"


def _enumerate(buckets: int, depth: int):
    """Shards with the answers to their phrases and counts, as text; the empty phrase counts all words."""

    def texts(phrases: dict[str, np.ndarray], vocabulary: pa.Array) -> pa.Array:
        columns = [vocabulary.take(pa.array(column - 1)) for column in phrases["words"].T]
        joined = columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, b" ")
        return joined.cast(pa.binary()).view(pa.string())

    def run(batches):
        for row in _rows(batches):
            index, words = _loaded(row, depth)
            vocabulary, lang, sign = pa.array(words, pa.binary()), row["lang"], row["sign"]

            def out(phrases, size, vocabulary=vocabulary, lang=lang, sign=sign):
                for at in range(0, len(phrases["count"]), BATCH):
                    some = _selected(phrases, slice(at, at + BATCH))
                    n = len(some["count"])
                    yield pa.record_batch(
                        [pa.array([lang] * n, pa.string()), texts(some, vocabulary),
                         pa.array(np.full(n, size, np.int32)), pa.array(some["count"] * sign, pa.int64())],
                        names=["lang", "phrase", "n_words", "n"],
                    )

            single = index.words()
            total = int(single["count"].sum()) * sign
            yield pa.record_batch(
                [pa.array([lang]), pa.array([""]), pa.array([0], pa.int32()), pa.array([total], pa.int64())],
                names=["lang", "phrase", "n_words", "n"],
            )
            yield from out(single, 1)
            pairs, h, bucket = _pairs(index, words, lang, buckets)
            if not len(h):
                continue
            sizes = np.diff(np.r_[_cuts(bucket), len(h)])
            answers = sorted((m["bucket"], m["mask"]) for m in row["masks"])
            frequent = np.concatenate(
                [np.unpackbits(np.frombuffer(m, np.uint8), count=n) for (_, m), n in zip(answers, sizes, strict=True)]
            ).astype(bool)
            phrases = _selected(pairs, frequent)
            known = np.sort(phrases["words"][:, 0] * index.size + phrases["words"][:, 1])
            for size in range(2, depth + 1):
                yield from out(phrases, size)
                if size == depth or not len(phrases["count"]):
                    break
                to_right = size % 2 == 1
                phrases = index.extend(phrases, to_right)
                new = phrases["words"][:, -2:] if to_right else phrases["words"][:, :2]
                key = new[:, 0] * index.size + new[:, 1]
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                phrases = _selected(phrases, known[at] == key)

    return run


def phrase_counts(
    df: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
    shard_words: int = SHARD_WORDS, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """lang, phrase, n_words, n of every phrase of up to `max_words` words that occurs `min_count`
    times, and for each lang the empty phrase with the number of all words. The table is staged."""
    if max_words < 2:
        raise ValueError("phrases have two words at least")
    spark = df.sparkSession
    docs = df.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), whole(F.col(text)).cast("binary").alias("content")
    )
    total = docs.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    sharded = docs.mapInArrow(_sharded(shard_words, max_words), _SHARD_DDL)
    # Equal shards are shards of their own: the number tells them apart.
    shards = stage(sharded.select(F.monotonically_increasing_id().alias("number"), "*"))
    asked = shards.select("number", "lang", "sign", "vocabulary", "symbols").mapInArrow(_ask(buckets, max_words), _ASK_DDL)
    masks = stage(
        asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(min_count), _MASK_DDL)
    )
    answers = masks.groupBy(F.col("shard").alias("_shard")).agg(F.collect_list(F.struct("bucket", "mask")).alias("masks"))
    ready = shards.join(answers, shards["number"] == answers["_shard"], "left").select(
        "lang", "sign", "vocabulary", "symbols", "masks"
    )
    found = ready.mapInArrow(_enumerate(buckets, max_words), _PHRASE_DDL)
    # A shard has each phrase once, so partial sums before the exchange would not shrink anything.
    sums = (
        found.repartition(buckets, "lang", "phrase").groupBy("lang", "phrase", "n_words").agg(F.sum("n").alias("n"))
        .where((F.col("n") >= min_count) | (F.col("n_words") == 0))
    )
    counts = stage(sums)
    release(spark, shards, masks)
    return counts


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) in exact whole numbers of up to 38 digits."""
    whole_number = lambda c: c.cast("decimal(15,0)")
    return F.call_function(
        "div", F.lit(1_000_000).cast("decimal(7,0)") * (whole_number(a) * whole_number(a)), whole_number(left) * whole_number(right)
    )


def top_by_group(df: DataFrame, group: str, order: list[Column], spread: Column, top: int) -> DataFrame:
    """The first `top` rows of each group with their rank. Groups are cut into parts by `spread`, whose
    first rows meet in fewer parts, so no task gets a whole group."""
    rows = df
    for parts in TOP_ROUNDS:
        part = Window.partitionBy(group, F.pmod(spread, F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(part).cast("long")).where(F.col("rank") <= top)
        if parts > 1:
            rows = rows.drop("rank")
    return rows


def collocations(
    counts: DataFrame, max_words: int = MAX_WORDS, inside_percent: int = INSIDE_PERCENT, top: int = TOP
) -> DataFrame:
    """Ranked phrases of the counts that `phrase_counts` gives: lang, rank, phrase, a, l, r, n, score."""
    words = F.split("phrase", " ")
    known = counts.where("n_words > 0").select("lang", "phrase", "n")
    candidates = counts.where("n_words > 1").select(
        "lang", "phrase", F.col("n_words").alias("_size"), F.col("n").alias("a"), words.alias("_words")
    )

    def part(start: Column, size: Column) -> Column:
        return F.array_join(F.slice("_words", start, size), " ")

    def count_of(rows: DataFrame, of: str, name: str) -> DataFrame:
        found = known.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("n").alias(name))
        return rows.join(found, (F.col("lang") == F.col("_l")) & (F.col(of) == F.col("_p"))).drop("_l", "_p")

    cuts = candidates.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_size") - 1))).select(
        "lang", "phrase", "a", "_k", part(F.lit(1), F.col("_k")).alias("_first"),
        part(F.col("_k") + 1, F.col("_size") - F.col("_k")).alias("_rest"),
    )
    cuts = count_of(count_of(cuts, "_first", "l"), "_rest", "r")
    scored = cuts.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(cut_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "_k", "l", "r")).alias("_cut")
    )
    # Each phrase inside a longer one, with the longer one's count.
    at, size = F.sequence(F.lit(1), F.col("_size") - F.col("_inner") + 1), F.sequence(F.lit(2), F.col("_size") - 1)
    inner = (
        candidates.where("_size > 2").withColumn("_inner", F.explode(size)).withColumn("_at", F.explode(at))
        .groupBy("lang", part(F.col("_at"), F.col("_inner")).alias("_in")).agg(F.max("a").alias("_longer"))
    )
    inner = inner.select(F.col("lang").alias("_l"), "_in", "_longer")
    kept = (
        scored.join(inner, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_in")), "left")
        .where(F.coalesce(100 * F.col("_longer") < inside_percent * F.col("a"), F.lit(True)))
        .select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    best = top_by_group(kept, "lang", order, F.xxhash64("phrase"), top)
    totals = counts.where("n_words = 0").select(F.col("lang").alias("_l"), F.col("n"))
    return best.join(totals, F.col("lang") == F.col("_l")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(phrase_counts(table(spark, sf_dir, "documents")))


OP11_SQL = rf"""
WITH pieces AS MATERIALIZED (
  SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda s: s <> '') AS w FROM (
    SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)),
grams AS MATERIALIZED (
  SELECT lang, g, len(g) AS size, count(*) AS f FROM (
    SELECT lang, w[i:i + k - 1] AS g FROM (
      SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3]) AS k FROM pieces)))
  GROUP BY lang, g),
candidates AS MATERIALIZED (SELECT * FROM grams WHERE size > 1 AND f >= {MIN_COUNT}),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r,
    (1000000::HUGEINT * c.f * c.f // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN grams l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN grams r ON r.lang = c.lang AND r.g = c.g[k + 1:]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, g, max(f) AS f FROM (
    SELECT lang, g[1:2] AS g, f FROM candidates WHERE size = 3 UNION ALL SELECT lang, g[2:3], f FROM candidates WHERE size = 3)
  GROUP BY lang, g),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang)
SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, array_to_string(c.g, ' ')) AS rank,
  array_to_string(c.g, ' ') AS phrase, a, l, r, n, score
FROM lowest c JOIN total USING (lang) LEFT JOIN inside i ON i.lang = c.lang AND i.g = c.g
WHERE i.f IS NULL OR 100 * i.f < {INSIDE_PERCENT} * a
QUALIFY rank <= {TOP}"""
