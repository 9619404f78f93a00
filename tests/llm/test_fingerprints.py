"""Fingerprints: edited texts beside plain slicing, likeness beside the generalised Jaccard similarity."""

import hashlib
import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import brute
from firnline.llm import fingerprints

SPACES = re.compile(r"[\x20\x09-\x0d]+")


def terms(text):
    return Counter(w for w in SPACES.split(text.lower()) if w)


def generalised_jaccard(a, b):
    most = sum(max(a[k], b[k]) for k in a.keys() | b.keys())
    return sum(min(a[k], b[k]) for k in a.keys() | b.keys()) / most if most else 1.0


def edited(rows):
    """(doc_id, n_chars, sha) of rows whose order is fixed."""
    rows = [(i, t or "") for i, t in rows]
    for at, (i, t) in enumerate(rows):
        half = len(t) // 2
        text = t[: len(t) - half] + rows[(at + 1) % len(rows)][1][:half]
        yield i, len(t), text, hashlib.sha256(text.encode()).hexdigest()


def plain(text, samples):
    """The samples of a text, term by term."""
    def hashed(value, seed=42):
        return xxhash.xxh64_intdigest((value & (1 << 64) - 1).to_bytes(8, "little"), seed)

    def draw(h, which):
        return ((h >> 21 * which) & (1 << 21) - 1) | 1

    out = []
    for k in range(samples):
        best = None
        for word, w in terms(text).items():
            term = xxhash.xxh64_intdigest(word.encode(), 42)
            first = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), hashed(term))
            second = hashed(first)
            u, v = draw(second, 0) * 2.0**-21, draw(first, 0)
            c = 42 * math.log(2) - math.log(draw(first, 1) * draw(first, 2))
            share = v * 2.0**-21
            t = max(1, math.floor((math.log(w) - math.log(u)) / -math.log(u * share))) if w * v >= 1 << 21 else 0
            drawn = hashed(t, hashed(second)) if t else first ^ (first >> 21) ^ (first >> 42)
            a = math.floor(c * v * (u * share) ** t * 2.0**19)
            code = (a << 16) | (drawn & 0xFFFF)
            best = code if best is None else min(best, code)
        out.append(f"{best & 0xFFFF:04x}")
    return "".join(out)


def test_samples_beside_plain_arithmetic(spark):
    rows = [(1, "a a a b c D d"), (2, "one two  three\tone one"), (3, "x " * 1000 + "y"), (4, "é É ß")]
    df = spark.createDataFrame(rows, "row long, text string").repartition("row")
    got = dict(tuple(r) for r in fingerprints.fingerprints(df, "row", "text", 16).collect())
    assert got == {i: plain(t, 16) for i, t in rows}


def test_collision_rate_is_the_generalised_jaccard_similarity():
    a, b = "k k k a b c d e f g h", "k k k k k a b c d x y z"
    one, two = (plain(t, 3000) for t in (a, b))
    rate = sum(one[i : i + 4] == two[i : i + 4] for i in range(0, 12000, 4)) / 3000
    assert abs(rate - generalised_jaccard(terms(a), terms(b))) < 0.03


def test_edited_texts_and_likeness(spark):
    base = [(i, brute.sentence(i % 7, 40 + 13 * i) + " é" * (i % 3)) for i in range(40)]
    rows = [*base, (100, base[3][1]), (101, base[3][1]), (102, None), (103, ""), (104, " \n"), (105, "one"), (106, "ab")]
    df = spark.createDataFrame([(i, t, "x", 5, "y") for i, t in rows], "doc_id long, text string, row string, h long, fingerprint string")
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(df).collect()}
    rows.sort(reverse=True)
    assert len(got) == len(rows)
    off = []
    for at, (i, n, text, sha) in enumerate(edited(rows)):
        own, after = rows[at][1] or "", rows[(at + 1) % len(rows)][1] or ""
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        for near, other in ((r.near_edited, text), (r.near_next, after)):
            if other == own:
                assert near == 1
            off.append(near - generalised_jaccard(terms(own), terms(other)))
    assert abs(sum(off) / len(off)) < 0.06 and max(map(abs, off)) < 0.3  # texts share words, and so draws
    assert got[100].fingerprint == got[101].fingerprint == got[3].fingerprint
    assert got[102].fingerprint == got[103].fingerprint == got[104].fingerprint == ""


def test_ties_nulls_single_and_empty(spark):
    docs = brute.frame(spark, brute.awkward())
    got = fingerprints.edited_fingerprints(docs, samples=4)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    ordered = [(r.doc_id, r.text) for r in rows.orderBy(F.col("doc_id").desc_nulls_last(), "h").collect()]
    want = Counter((i, n, sha) for i, n, _, sha in edited(ordered))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_chars", "edited_sha256").collect()) == want
    assert fingerprints.edited_fingerprints(docs.limit(0), samples=4).count() == 0
    (one,) = fingerprints.edited_fingerprints(docs.where("doc_id = 12"), samples=4).collect()
    assert one.near_next == 1


@pytest.mark.parametrize("n", [1, 2, 5])
def test_every_row_has_one_next(spark, n):
    rows = spark.range(n).select(F.col("id").alias("row"))
    pairs = {r.row: r.next_row for r in fingerprints.with_next(rows, [F.col("row").desc()]).collect()}
    assert pairs == {i: (i - 1) % n for i in range(n)}


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = fingerprints.edited_fingerprints(df, samples=4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_are_dealt_out_once(spark, monkeypatch):
    staged, read = [], []
    stage, stage_by = fingerprints.stage, fingerprints.stage_by
    monkeypatch.setattr(fingerprints, "stage", lambda df: (staged.append(df), stage(df))[1])
    monkeypatch.setattr(fingerprints, "stage_by", lambda df, key: (read.append(stage_by(df, key)), read[-1])[1])
    df = spark.createDataFrame([(i, f"a{i} b c " * 9) for i in range(50)], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(df, samples=4).count() == 50
    assert len(read) == 1 and not any({"text", "edited"} & set(t.columns) for t in staged)
    own = staged[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in own
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("firnline_")]
