"""The pipeline's stages beside brute force, and the queries beside their SQL."""

import os
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from firnline.llm.queries import ORACLES, QUERIES  # noqa: E402
from firnline.staging import stage  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents pages labels benchmark embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    duck.execute(ORACLES[name])
    names = [d[0] for d in duck.description]
    assert sorted(df.columns) == sorted(names)
    got = Counter(tuple(r[c] for c in sorted(names)) for r in df.collect())
    want = Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in duck.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_returns_every_row(spark, duck, name):
    table = "pages" if name.startswith("op9") else "documents"
    assert QUERIES[name](spark, SF_DIR).count() == duck.execute(f"select count(*) from {table}").fetchall()[0][0]


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    steps = dict(corpus_pipeline.STAGES)
    ruled = stage(steps["quality_rules"](spark, docs, SF_DIR))
    assert ruled.columns == docs.columns
    left = [(r.doc_id, r.text, r.source) for r in ruled.collect()]
    assert set(left) < set(rows) and all(len(brute.words(t)) >= 50 for _, t, _ in left)
    unique = stage(steps["exact_dedup"](spark, ruled, SF_DIR))
    keep = {k for _, k, _ in brute.exact(left)}
    assert Counter(r.doc_id for r in unique.collect()) == Counter(keep)
    left = [row for row in left if row[0] in keep]
    apart = stage(steps["near_dedup"](spark, unique, SF_DIR))
    keep = {c for _, _, c in brute.near(left, 5)}
    assert Counter(r.doc_id for r in apart.collect()) == Counter(keep)
    mixed = stage(steps["mixing"](spark, apart, SF_DIR))
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= keep and max(copies.values()) <= 3
    encoded = steps["byte_bpe"](spark, mixed, SF_DIR)
    assert Counter(r.doc_id for r in encoded.collect()) == copies


def test_empty_and_awkward_documents(spark):
    docs = brute.frame(spark, brute.awkward())
    for table in (docs, docs.limit(0)):
        for _, function in corpus_pipeline.STAGES:
            table = stage(function(spark, table, SF_DIR))
        table.count()
