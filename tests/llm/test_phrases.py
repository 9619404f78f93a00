"""Phrases beside plain counting."""

import re
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from firnline.llm import phrases

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
        if words:
            yield words


def counted(rows, longest):
    """lang -> phrase -> count."""
    found = defaultdict(Counter)
    for lang, text in rows:
        for w in pieces(text):
            for k in range(1, longest + 1):
                found[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return found


def ranked(rows, longest=3, least=10, top=2000):
    for lang, f in counted(rows, longest).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        candidates = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        inside = defaultdict(int)
        for g, c in candidates.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside[g[i : i + k]], c)
        out = []
        for g, a in candidates.items():
            score, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            if 100 * inside[g] < 50 * a:
                out.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, g, left, right) in enumerate(sorted(out)[:top], 1):
            yield lang, rank, g.decode(), -a, left, right, n, -score


def texts(seed=7, n=120):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(12)] + ["Über", "ÜBER", "NEW", "new", "\x00", "a-b"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b"]
    rows = []
    for i in range(n):
        size = int(rng.integers(0, 60))
        pick = rng.zipf(1.5, size) % len(words)
        rows.append((["en", "de", None, "und"][i % 4], "".join(words[p] + marks[int(rng.zipf(2)) % len(marks)] for p in pick)))
    return [*rows, ("en", None), ("en", ""), (None, "new york " * 30), ("fr", "x " * 700 + "y"), ("xx", "solo")]


def frame(spark, rows):
    extra = [(lang, text, "q", 1, "p") for lang, text in rows]
    return spark.createDataFrame(extra, "lang string, text string, phrase string, n long, shard string").repartition(3)


@pytest.mark.parametrize("settings", [{}, {"shard_words": 50}, {"shard_words": 5, "bucket_bytes": 64}])
def test_ranked_phrases(spark, settings):
    rows = texts()
    got = phrases.collocations(phrases.phrase_counts(frame(spark, rows), **settings)).collect()
    assert Counter(tuple(r) for r in got) == Counter(ranked(rows))


@pytest.mark.parametrize("longest", [2, 5])
def test_other_lengths_and_limits(spark, longest):
    rows = texts(3)
    counts = phrases.phrase_counts(frame(spark, rows), min_count=4, max_words=longest, shard_words=40)
    got = phrases.collocations(counts, longest, top=7).collect()
    assert Counter(tuple(r) for r in got) == Counter(ranked(rows, longest, 4, 7))


def test_empty_and_awkward(spark):
    docs = brute.frame(spark, brute.awkward())
    rows = [(r.lang, r.text) for r in docs.collect()]
    got = phrases.collocations(phrases.phrase_counts(docs)).collect()
    assert Counter(tuple(r) for r in got) == Counter(ranked(rows))
    assert phrases.collocations(phrases.phrase_counts(docs.limit(0))).count() == 0
    assert phrases.collocations(phrases.phrase_counts(docs.withColumn("text", F.lit("")))).count() == 0


def test_intervals_are_counts_on_both_sides():
    rng = np.random.default_rng(1)
    symbols = np.concatenate([[0], *[np.r_[rng.integers(1, 6, rng.integers(1, 9)), 0] for _ in range(80)]]).astype(np.int32)
    index = phrases.FMIndex(symbols, 4)
    text = symbols.tolist()
    found = index.words()
    for size, to_right in ((2, False), (3, True), (4, False)):
        found = index.extend(found, to_right)
        plain = Counter(tuple(text[i : i + size]) for i in range(len(text) - size + 1))
        plain = {g: n for g, n in plain.items() if 0 not in g}
        assert dict(zip(map(tuple, found["words"].tolist()), found["count"].tolist(), strict=True)) == plain
        for side in ("left", "right"):  # intervals of one transform do not meet
            spans = sorted(zip(found[side].tolist(), found["count"].tolist(), strict=True))
            assert all(a + n <= b for (a, n), (b, _) in pairwise(spans))


def test_scores_past_64_bits(spark):
    a, left, right = 3 * 10**12, 4 * 10**12, 5 * 10**12 + 1
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert row.select(phrases.cut_score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1000000 * a * a // (left * right)
