"""Every operator on an awkward table, beside brute force, and on empty tables."""

import hashlib
import random
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from firnline.llm import bpe, chosen_path, components, grace, html_text, mixing, quality, rans, suffix_dedup, toxicity, url_lists  # noqa: E402, E501


@pytest.fixture(scope="module")
def rows():
    return brute.awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return brute.frame(spark, rows)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_quality_metrics(docs, rows):
    got = quality.measure(docs).select("_row.doc_id", "_row.text", "n_words", "word_chars", "n_dup_lines", "n_repeat_words")
    want = []
    for i, t, _ in rows:
        w, lines = brute.words(t), [x for x in (t or "").split("\n") if brute.words(x)]
        want.append((i, t, len(w), sum(map(len, w)), len(lines) - len(set(lines)), brute.repeat_words(t)))
    assert bag(got.collect()) == bag(want)


def test_quality_keeps_columns_and_clean_rows(docs, empty):
    kept = quality.quality_rules(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {5, 6, 7, 8, 9, 17, 18, 20}
    assert quality.quality_rules(empty).count() == 0


@pytest.mark.parametrize("settings", [{}, {"table_bytes": 500, "hot_rows": 1, "hot_bytes": 100, "bucket_bytes": 4096}])
def test_exact_groups(docs, rows, empty, settings):
    got = grace.exact_groups(docs, **settings).collect()
    assert bag((r.doc_id, r.keep_id, r.group_size) for r in got) == bag(brute.exact(rows))
    if not settings:
        kept = Counter(r.text_sha256 for r in got if r.kept)
        assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in got}
        assert grace.exact_groups(empty).count() == 0


def test_exact_dedup_keeps_one_of_each(docs, rows, empty):
    kept = grace.exact_dedup(docs)
    assert kept.columns == docs.columns
    texts = Counter(brute.SPACE.sub(" ", r.text or "") for r in kept.collect())
    assert set(texts.values()) == {1} and len(texts) == len({brute.SPACE.sub(" ", t or "") for _, t, _ in rows})
    assert grace.exact_dedup(empty).count() == 0


def test_spilled_buckets_settle_everything(tmp_path):
    records = [(i, 1, hash(str(i % 90)), 0, str(i % 90).encode() * 20) for i in range(900)]
    found = list(grace.settle(records, 100, str(tmp_path)))
    assert len(found) == 90 and all(len(slot.ids) == 10 for _, slot in found)


def test_metrics_are_bound_once_under_a_filter(docs, rows):
    """A filter is pushed through the projections of the metrics; what they use twice must not be inlined."""
    start = time.perf_counter()
    got = quality.measure(docs).where("n_repeat_words > 5 AND n_words > 3").select("_row.doc_id").collect()
    assert bag(got) == bag((i,) for i, t, _ in rows if brute.repeat_words(t) > 5 and len(brute.words(t)) > 3)
    assert time.perf_counter() - start < 60


@pytest.mark.parametrize("settings", [
    {}, {"node": 2, "depth": 1}, {"node": 2, "depth": 1, "task_node": 3, "task_shingles": 300}, {"task_node": 2, "task_shingles": 1},
])
def test_near_groups(docs, rows, empty, settings):
    got = chosen_path.near_groups(docs, **settings)
    assert bag(got.select("doc_id", "n_shingles", "component_id").collect()) == bag(
        (i, n, c if n else i) for i, n, c in brute.near(rows)
    )
    assert chosen_path.near_groups(empty, **settings).count() == 0


def test_near_groups_with_large_nodes(spark):
    """A family of near copies, far more than a node may hold, and strays near its edge."""
    base = brute.sentence(1, 200).split()
    rows = [(i, " ".join([*base[: 3 * i], f"x{i}", *base[3 * i + 1 :]]), "a") for i in range(40)]
    rows += [(100 + i, " ".join(base[: 180 - 12 * i]), "a") for i in range(8)]
    for settings in ({}, {"task_node": 10}, {"task_node": 10, "task_shingles": 2000}):
        got = chosen_path.near_groups(brute.frame(spark, rows), node=6, depth=2, **settings)
        assert bag(got.select("doc_id", "n_shingles", "component_id").collect()) == bag(brute.near(rows))


def test_nodes_of_one_common_passage_are_branched():
    """Texts that share a passage but are not alike: a node of them is parted, not compared whole."""
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[passage, rng.integers(0, 1 << 62, 120, dtype=np.uint64)]) for _ in range(600)]
    sets += [np.unique(np.r_[s[:-3], rng.integers(0, 1 << 62, 3, dtype=np.uint64)]) for s in sets[:30]]
    sketches = np.array([chosen_path.sketch(s) for s in sets]).astype("<u2")
    compared = []
    node = chosen_path._Node(sketches, np.array([len(s) for s in sets]), 80, 50)
    compare = node._compare
    node._compare = lambda one, others: (compared.append(len(others)), compare(one, others))
    for path in range(8):
        node.search(np.arange(len(sets)), path, 10)
    assert {tuple(sorted(link)) for link in node.links} == {(i, 600 + i) for i in range(30)}
    assert sum(compared) < 8 * 630 * 629 / 2 / 3


@pytest.mark.parametrize("seed", range(3))
def test_links_span_the_components(seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    sets = [np.unique(rng.choice(words, int(rng.integers(25, 40)), replace=False)) for _ in range(40)]
    up = chosen_path._Union(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                up.join(i, j)
    found = chosen_path._Union(len(sets))
    links = list(chosen_path._links(sets, 80))
    for i, j in links:
        found.join(i, j)
    groups = lambda u: Counter(frozenset(k for k in range(40) if u.root(k) == u.root(i)) for i in range(40))
    assert groups(found) == groups(up) and len(links) == 40 - len(groups(up))


def test_texts_of_candidates_are_dealt_out_in_passes(spark):
    rows = [(i, f"{i} snow on the plot") for i in range(40)] + [(None, "no id on this row"), (3, "3 snow on the plot"), (4, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    digest = lambda text: chosen_path._digest(chosen_path.shingle_set(text, 4))
    wanted = list({(digest(text), i) for i, text in rows if i is None or i % 2})
    passes = chosen_path._sets_of(docs, spark.createDataFrame(wanted, "digest binary, rep long"), 4)
    got = [[(bytes(r.digest), bytes(r.shingles)) for r in made.collect()] for made in passes]
    assert len(got) == chosen_path.TEXT_PASSES and max(map(len, got)) < len(wanted) * 0.6
    assert sorted(x for made in got for x in made) == sorted(
        {(digest(t), chosen_path.shingle_set(t, 4).tobytes()) for i, t in rows if i is None or i % 2}
    )


def test_near_dedup_keeps_columns(docs):
    kept = chosen_path.near_dedup(docs, shingle=5)
    assert kept.columns == docs.columns


def test_near_dedup_keeps_one_row_of_each(spark, rows):
    other = brute.sentence(41, 80)
    rows = [*rows, (None, other, "a"), (None, other + " end", "b"), (30, brute.sentence(51, 80), "a"),
            (30, brute.sentence(1, 120) + " end", "a"), (8, brute.sentence(61, 80), "c")]
    component = [c for _, _, c in brute.near([(n, t, s) for n, (_, t, s) in enumerate(rows)], 5)]
    of_text = {t: c for (_, t, _), c in zip(rows, component, strict=True)}
    smallest = {c: brute.smallest([i for (i, _, _), d in zip(rows, component, strict=True) if c == d]) for c in component}
    kept = chosen_path.near_dedup(brute.frame(spark, rows), shingle=5).collect()
    full = [r for r in kept if brute.words(r.text)]
    want = {c for (_, t, _), c in zip(rows, component, strict=True) if brute.words(t)}
    assert Counter(of_text[r.text] for r in full) == Counter(want)
    assert all(r.doc_id == smallest[of_text[r.text]] for r in full)
    assert bag((r.doc_id, r.text) for r in kept if r not in full) == bag((i, t) for i, t, _ in rows if not brute.words(t))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (60, 50), (70, 70)], "a long, b long")
    got = {r.v: r.label for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50, 60: 50, 70: 70}


def test_repeated_spans(docs, rows, empty):
    got = suffix_dedup.repeated_spans(docs, with_text=True).collect()
    want = []
    for i, raw, gone in brute.repeats(rows):
        left = bytes(b for p, b in enumerate(raw) if p not in gone)
        want.append((i, len(raw), len(gone), hashlib.sha256(left).hexdigest(), left))
    assert bag(
        (r.doc_id, r.n_bytes, sum(r.ends) - sum(r.starts), r.kept_sha256, bytes(r.kept)) for r in got
    ) == bag(want)
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_long_texts_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    raw = brute.sentence(4, 400).encode()
    whole = suffix_dedup.occurrences([(1, 1, raw)], 50)
    covered = {p for o in whole.tolist() for p in range(o[3] - o[4], o[3] - o[5] + 1)}
    assert covered == set(range(len(raw) - 49))


def test_longest_previous():
    text = [b"aaaa", b"aaab", b"aaaa", b"aaaa", b"zzzz", b"aaab"]
    later = suffix_dedup.longest_previous(np.array([list(x) for x in text], np.uint8), np.array([3, 1, 2, 2, 0, 1]))
    assert later.tolist() == [True, False, False, False, False, False]


def test_mix_meets_targets(docs, rows, empty):
    plan_docs = mixing._with_key(mixing.sized(docs))
    got = mixing.with_copies(plan_docs, mixing.mix_plan(plan_docs)).collect()
    assert bag((r.doc_id, r.size) for r in got) == bag((i, len(brute.words(t))) for i, t, _ in rows)
    taken, target, largest = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)
    assert abs(sum(target.values()) - sum(len(brute.words(t)) for _, t, _ in rows)) < 1e-3
    again = mixing.with_copies(plan_docs, mixing.mix_plan(plan_docs)).collect()
    assert bag(got) == bag(again)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(empty).count() == 0


def test_multipliers_beside_plain_bisection(spark):
    """The dual's solution beside bisection on the words taken, and every document's copies beside the rates."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(["w"] * int(n)), "abcdefg"[i % 7]) for i, n in enumerate(rng.zipf(1.4, 700) % 400)]
    plan_docs = mixing._with_key(mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    plan = mixing.mix_plan(plan_docs)
    params = {r.source: r for r in plan.collect()}
    got = mixing.with_copies(plan_docs, plan).collect()
    sizes = {s: np.array([len(t.split()) for _, t, x in rows if x == s], float) for s in "abcdefg"}
    for source, z in sizes.items():
        p, mean = params[source], z.mean()
        if not 0 < p.target < 3 * z.sum():
            continue
        low, high = -200.0, 200.0
        for _ in range(200):
            middle = (low + high) / 2
            taken = (z * np.minimum(3, np.exp(np.minimum(50, middle * z / mean)))).sum()
            low, high = (middle, high) if taken < p.target else (low, middle)
        rates = np.minimum(3, np.exp(np.minimum(50, low * z / mean)))
        mine = np.minimum(3, np.exp(np.minimum(50, p._lambda * z / p._mean)))
        assert np.abs(mine - rates).max() < 1e-3
    taken = Counter()
    for r in got:
        assert np.floor(r.rate) <= r.copies <= np.floor(r.rate) + 1
        taken[r.source] += r.copies * r.size
    for source, p in params.items():
        left = [r.size for r in got if r.source == source and 0 < r.size and r.copies == np.floor(r.rate) < r.rate]
        # No document that is left out would bring the source nearer to its target.
        assert all(abs(taken[source] + n - p.target) >= abs(taken[source] - p.target) - 1e-6 for n in left)



def test_targets_are_shared_again(spark):
    sizes = spark.createDataFrame([("0a", "a", 10), ("0b", "b", 100), ("0c", "c", 1000), ("0d", "d", 5)], "_key string, source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # a and d (weights 5) stop at 30 and 15, b (weight 2) at 300; c takes the rest.
    assert got == {"a": 30.0, "b": 300.0, "c": 770.0, "d": 15.0}


def test_bpe_agrees_with_plain_merges(docs, rows, empty):
    path, pattern = bpe.vocabulary()
    found = bpe.load(path, pattern)

    def plain(text):
        out = []
        for match in found.pattern.finditer(text):
            parts = [bytes([b]) for b in match.group().encode()]
            while len(parts) > 1:
                ranked = [(found.ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
                rank, k = min(ranked)
                if rank == 1 << 30:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            out += [found.ranks[p] for p in parts]
        return out

    short = [r for r in rows if len(r[1] or "") < 2000] + [(99, "a　b  c's\n\n x\x1cy 12'll", "a")]
    for _, text, _ in short:
        assert found.encode(text or "") == plain(text or "")
    got = bpe.token_digests(docs, path, pattern).collect()
    want = []
    for i, t, _ in rows:
        ids = found.library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert bag(got) == bag(want)
    encoded = bpe.decode_column(bpe.encode_column(docs.select("doc_id", "text"), path, pattern), path, pattern)
    assert all(bytes(r.bytes).decode() == (r.text or "") for r in encoded.collect())
    assert bpe.token_digests(empty, path, pattern).count() == 0


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 30_000 + "b", "\n" * 9000, "ab" * 9000 + " x"])
def test_bpe_long_matches(text):
    found = bpe.load(*bpe.vocabulary())
    ids = found.encode(text)
    assert found.decode(ids) == text.encode()
    assert bpe.merge(b"the" * 300, found.ranks) == found.library.encode_ordinary("the" * 300)


@pytest.mark.parametrize("n", [0, 1, 5, 64, 1000, 70_000])
def test_blocks_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 500).astype(np.uint32)
    counts = np.bincount(ids) if n else np.ones(1, np.int64)
    tokens = np.flatnonzero(counts)
    shared = rans.Frequencies(tokens, rans.Frequencies.scaled(counts[tokens]).astype(np.uint64))
    data = rans.encode_block(ids, shared, lanes=16, checkpoint=8)
    assert (rans.decode_block(data, shared) == ids).all()
    if n > 500:
        parts = [rans.decode_block(data, shared, k, k + 1) for k in range(rans._HEAD.unpack_from(data)[3])]
        assert len(parts) > 2 and (np.concatenate(parts) == ids).all()
        with pytest.raises(ValueError):
            rans.decode_block(data[:-1] + bytes([data[-1] ^ 1]), shared)


def test_token_files(spark, docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(rans.vocabulary())
    rans.write_tokens(docs, f"{tmp_path}/t", rans.vocabulary(), block=100)
    got = rans.read_tokens(spark, f"{tmp_path}/t").collect()
    want = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _ in rows]
    assert bag((r.doc_id, tuple(r.ids)) for r in got) == bag((i, tuple(ids)) for i, ids in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    order = [brute.id_key(r.doc_id) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    rans.write_tokens(empty, f"{tmp_path}/e", rans.vocabulary())
    assert rans.read_tokens(spark, f"{tmp_path}/e").count() == 0


def test_words_take_the_ids_of_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(rans.vocabulary())
    rng = random.Random(5)
    plain = ["a", "B", "z", "'", "s", "S", "t", "re", "VE", "ll", "0", "9", ".", "-", "é", "É", "ß", "×", "÷", "İ", "ı", "ſ", "ŉ", "Ÿ", "Ø", " ", "\n"]
    odd = ["ẞ", "ǅ", "Σ", "ς", "\u0301", "\u00a0", "\u3000", "\x0b", "\x1c", "\x85", "<|endoftext|>", "<|", "|>", "中", "²", "\x00", "\x7f", "…", "🙂", "ﬁ"]
    texts = ["".join(rng.choices(plain + odd * (i % 2), k=rng.randrange(25))) for i in range(6000)]
    words = rans.Words(rans.vocabulary())
    assert words.plain and words.type == np.dtype("<u2")
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for most in (400_000, 50):  # the second forgets all the time
        words.words, words.pieces = rans._Recent(most), rans._Recent(most)
        got = [raw for at in range(0, 6000, 40) for raw in words.ids([t.encode() for t in texts[at : at + 40]])]
        assert [np.frombuffer(raw, words.type).tolist() for raw in got] == want
    words.plain = False
    assert [np.frombuffer(raw, words.type).tolist() for raw in words.ids([t.encode() for t in texts[:500]])] == want[:500]


def test_plain_words_are_cut_as_arrays(monkeypatch):
    words, asked = rans.Words(rans.vocabulary()), set()
    found = rans.Words._found
    monkeypatch.setattr(rans.Words, "_found", lambda self, new: (asked.update(new), found(self, new))[1])
    texts = ["Snow, snow-depth 12.5cm", "", " \x0bÉtÉ×2\x0c", "it's <b> 雪", "snow (depth)"]
    want = [np.array(e.ids, "<u2").tobytes() for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert words.ids([t.encode() for t in texts]) == want
    assert asked == {w.encode() for w in ("ÉtÉ×2", "it's", "<b>", "雪")}
    assert {"snow", "depth", ",", "-", "cm", "1"} <= set(words.pieces.new) and "snow," not in words.pieces.new


def test_special_tokens_in_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(rans.vocabulary())
    texts = ["end <|endoftext|> of x", "a<|endoftext|>b", "(<|startoftext|>),<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|end", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rans.write_tokens(df, f"{tmp_path}/s", rans.vocabulary())
    got = {r.doc_id: r.ids for r in rans.read_tokens(spark, f"{tmp_path}/s").collect()}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert got[0] == [806, 49407, 539, 343, 2]


def test_toxicity(spark, docs, rows, empty):
    bad = [(1000 + i, brute.sentence(i, 30) + (" vileword here" if i % 3 == 0 else ""), "a") for i in range(400)]
    corpus = brute.frame(spark, rows + bad)
    labels = spark.createDataFrame(
        [(1000 + i, int(i % 3 == 0)) for i in range(400)] + [(None, 1), (5, None), (77777, 1)], "doc_id long, toxic int"
    )
    model = toxicity.fit(corpus, labels)
    scores = toxicity.score(corpus, model).collect()
    assert len(scores) == len(rows) + 400 and all(0 <= r.score <= 1 for r in scores)
    of = {r.doc_id: r.score for r in scores}
    held = [i for i in range(400) if zlib.crc32(str(1000 + i).encode()) % 4 == 2]
    assert all((of[1000 + i] >= 0.3) == (i % 3 == 0) for i in held)
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.fit(corpus, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.5}


def test_sums_beside_a_plain_loop_over_coordinates():
    rng = np.random.default_rng(2)
    state, z, n = toxicity.State.empty(), Counter(), Counter()
    last = len(state.z) - 1

    def weight(i):
        bound = 0.0 if i == last else toxicity.L1
        if abs(z[i]) <= bound:
            return 0.0
        sign = 1.0 if z[i] > 0 else -1.0
        return -(z[i] - sign * bound) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(300):
        at, label = np.r_[np.unique(rng.zipf(1.3, 40) % 200), last], int(rng.random() < 0.3)
        state.learn(at, label)
        old = {i: weight(i) for i in at.tolist()}
        g = 1 / (1 + np.exp(-sum(old.values()))) - label
        for i, w in old.items():
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    assert np.allclose(state.z[[*z]], list(z.values())) and np.allclose(state.n[[*n]], list(n.values()))
    assert np.allclose(state.weights()[[*z]], [weight(i) for i in z]) and 0 < np.count_nonzero(state.weights()) < 201


def test_the_fit_is_repeatable(spark):
    corpus = brute.frame(spark, [(i, brute.sentence(i, 20) + " vile" * (i % 3 == 0), "a") for i in range(120)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    one, two = (toxicity.fit(c, labels) for c in (corpus, corpus.repartition(5)))
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all() and one[2] == two[2]


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="post-%d"><h1>Title &amp; more</h1><p><b>Bold   text<br><p>Second&nbsp;para &lt;x&gt;
line</p><div class="ad">buy now</div><script>var t="</p>";</script><form><p>mail</p></form><ul><li>one<li>two</ul></div>
<aside>side</aside><section class="comments"><p>nice reader comment that is rather long, longer than the article is</p></section>
<footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    want = "Title & more\nBold text\nSecond para <x> line\none\ntwo"
    pages = [(i, f"http://h.example/{i}", PAGE % i) for i in range(4)]
    pages += [(10, None, None), (11, "http://h.example/x", ""), (12, "nonsense", "just <b>text"), (None, "http://h.example/1", PAGE % 9)]
    pages += [(13, "http://h.example/13", "<div>" * 3000 + "deep" + "</p>" * 3)]
    got = html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    of = {r.page_id: r.text for r in got}
    assert len(got) == len(pages) and {of[i] for i in (0, 1, 2, 3, None)} == {want}
    assert (of[10], of[11], of[12], of[13]) == ("", "", "just text", "deep")
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_with_clashing_columns(spark):
    pages = spark.createDataFrame(
        [(1, "http://h.example/1", PAGE % 1, "x", "y", 3, "z")],
        "page_id long, url string, html string, host string, path string, text long, boxes string",
    )
    (row,) = html_text.main_text(pages).collect()
    assert row.text == "Title & more\nBold text\nSecond para <x> line\none\ntwo"


@pytest.mark.parametrize("start", ["<a ", '<p class="a', "<a '", "<!--", "<!", '<a ">', "<", "</a ", "<a b='\">"])
def test_long_broken_markup_takes_linear_time(start):
    begun = time.perf_counter()
    html_text.extract("<p>before " + start * (1_000_000 // len(start)), None)
    assert time.perf_counter() - begun < 10


def test_starts_without_an_end_are_text():
    assert html_text.extract("<p>a < b <c and <d", None) == "a < b <c and <d"
    assert html_text.extract("<p>one <b two <!-- gone", None) == "one <b two"
    assert html_text.extract('<p title="a>one</p><p>two</p>', None) == "one\ntwo"


def test_consensus_outvotes_a_page():
    def page(article, other):
        return f'<body><div class="main-1"><p>{article}</p></div><div class="x"><p>{other}</p></div></body>'

    usual = html_text.Page(page("long " * 50, "short")).choice()[0]
    odd = page("brief article", "a box much longer than the article " * 5)
    assert html_text.extract(odd, usual) == "brief article"
    assert html_text.extract("<body><p>no container of that path</p></body>", usual) == "no container of that path"


def own_text(html):
    return html_text.extract(html, None)


def test_choice_takes_in_the_whole_article():
    long = "body text " * 30
    for inner in ('<div class="body">%s</div>', "<blockquote>%s</blockquote>", "<table><tr><td>%s</table>"):
        want = f"T\n{long.strip()}\nrest of it"
        article = f"<h1>T</h1>{inner % long}<p>rest of it</p>"
        box = '<div class="ad">buy</div><div class="x"><p>unmarked box</p></div>'
        for outer in (f"<article>{article}</article>{box}", f'<div class="post"><div>{article}</div></div>{box}', article):
            for page in (f"<html><body>{outer}</body></html>", f"<body>{outer}"):
                path = html_text.Page(page).choice()[0]
                assert html_text.extract(page, path) == want == own_text(page)
        assert own_text(article) == want


def test_unmarked_lines_around_the_article_stay_out(spark):
    long = "the long body of a real article. " * 30
    wrapped = '<body><div id="page"><div class="top">Site name</div><div class="content"><h1>T%d</h1><div><p>%s</p></div><p>after</p></div><div class="bottom">copyright me</div></div></body>'
    bare = '<body>Skip to<div class="content"><p>%s</p></div>All rights reserved</body>'
    pages = [(i, f"http://one.example/{i}", wrapped % (i, long)) for i in range(4)]
    pages += [(10 + i, f"http://two.example/{i}", bare % long) for i in range(3)]
    got = html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    want = {i: f"T{i}\n{long.strip()}\nafter" for i in range(4)} | {10 + i: long.strip() for i in range(3)}
    assert {r.page_id: r.text for r in got} == want
    both = f'<div class="post"><div><p>{long}</p></div><div><p>{long[:400]}</p></div></div>'
    assert own_text(f"<body>{both}</body>") == f"{long.strip()}\n{long[:400].strip()}"


def test_second_template_keeps_its_article(spark):
    first = '<body><div class="main"><p>%s</p></div><div class="x"><p>%s</p></div></body>'
    second = '<body><div class="main"><p>teaser</p></div><div class="story"><p>%s</p></div></body>'
    long = "a long article of many words " * 20
    pages = [(i, f"http://h.example/{i}", first % (long, "box")) for i in range(5)]
    pages += [(8, "http://h.example/8", first % ("brief", long)), (9, "http://h.example/9", second % long)]
    got = html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {**dict.fromkeys((0, 1, 2, 3, 4, 9), long.strip()), 8: "brief"}


@pytest.mark.parametrize("name", [
    "content no-sidebar", "has-sidebar", "post comments-open", "article-share-enabled", "entry hidden-print", "layout-right-sidebar",
])
def test_properties_are_no_noise(name):
    text = "some text of the article " * 9
    for page in (f'<body><div class="{name}"><p>{text}</div></body>', f'<body><article><div class="{name}"><p>{text}</div></article></body>'):
        assert own_text(page) == text.strip()
    if name != "layout-right-sidebar":
        assert own_text(f'<body><div class="m"><p>{text}<div class="{name}"><p>short</div></div></body>') == f"{text.strip()}\nshort"


def test_marked_elements_with_the_article_stay():
    text = "some text of the article " * 9
    assert own_text(f'<body><div class="banner"><p>{text}<div class="sidebar"><p>side</div></div></body>') == text.strip()
    for name in ("sidebar", "cookie-notice", "related-posts", "nav-mobile", "comments-area"):
        assert own_text(f'<body><div class="m"><p>{text}<div class="{name}"><p>short</div></div></body>') == text.strip()
    assert own_text(f'<body><div class="m"><p>brief article</p></div><div class="comment-list"><p>{"so true " * 6}</div></body>') == "brief article"
    assert own_text(f'<body><div class="discussion"><p>{text}</div></body>') == text.strip()
    post = f'<div class="post"><div class="entry-header"><h1>T</h1></div><div class="b"><p>{text}</div></div>'
    assert own_text(f'<body><a href="#m">Skip</a>{post}</body>') == f"T\n{text.strip()}"


def test_url_lists(spark):
    entries = [
        ("spam", False, "bad.example.com", 10, True), ("spam", False, "bad.example.com", 20, False),
        ("spam", False, "bad.example.com", 40, True), ("ok", True, "bad.example.com/fine", 0, True),
        ("spam", False, "example.org", 5, True), ("spam", False, "example.org", 5, False),
        ("ok", True, "tie.example.net", 0, True), ("spam", False, "tie.example.net", 0, True),
        (None, False, "x.com", 0, True), ("spam", False, None, 0, True), ("spam", False, "x.com", None, True),
    ]
    captures = [
        ("http://bad.example.com/a", 9), ("http://bad.example.com/a", 10), ("https://u@BAD.example.com:8/a?q#f", 19),
        ("http://bad.example.com/a", 20), ("http://www.bad.example.com/", 400), ("http://bad.example.com/fine/x", 12),
        ("http://bad.example.com/finer", 12), ("http://example.org/", 6), ("http://tie.example.net", 3),
        (None, 3), ("http://bad.example.com/a", None), ("no url", 12), ("http://bad.example.com/a", 10),
    ]
    got = url_lists.url_filter(
        spark.createDataFrame([(u, d, "x") for u, d in captures], "url string, day long, blocked string"),
        spark.createDataFrame(entries, "list string, allow boolean, pattern string, day long, added boolean"),
    )
    want = [False, True, True, False, True, False, True, False, False, False, False, False, True]
    assert bag(got.select("_row.url", "_row.day", "blocked").collect()) == bag(
        (*c, w) for c, w in zip(captures, want, strict=True)
    )
    none = got.limit(0)
    assert none.count() == 0
