"""Plain versions of the operators, and an awkward table to hold both against."""

import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

SPACE = re.compile("[\x20\x09-\x0d]+")

# Extra columns bear the names that operators use inside.
SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in [
        ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
        ("n_chars", T.LongType()), ("n_words", T.StringType()), ("kept", T.StringType()), ("size", T.StringType()),
        ("_key", T.StringType()), ("h", T.StringType()), ("part", T.StringType()), ("content", T.StringType()),
        ("digest", T.StringType()), ("_words", T.StringType()), ("copies", T.StringType()), ("label", T.StringType()),
    ]]
)


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def sentence(seed, n):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 997}" for i in range(n))


def awkward():
    """(doc_id, text, source): nulls, empty and long texts, copies, near copies, shared passages, ties."""
    base = sentence(1, 120)
    edited = " ".join([*base.split()[:60], "changed", *base.split()[61:]])
    passage = sentence(5, 40)
    long = sentence(3, 30_000)
    return [
        (1, base, "a"), (2, base.replace(" ", "\n\t "), "a"), (3, base.upper(), "b"), (4, edited, None),
        (5, None, "b"), (6, "", "c"), (7, " \n\t", "c"), (8, "one", "c"), (9, "one two three", None),
        (10, long, "a"), (11, long + " end", "b"), (12, passage + " " + sentence(11, 90), "a"),
        (13, sentence(12, 30) + " " + passage, "b"), (None, base, "a"), (None, sentence(21, 70), None),
        (14, "é" * 60 + " x", "b"), (15, "é" * 60 + " y", "a"), (16, "ab" * 5000, "a"), (17, "# | $ " * 40, "c"),
        (18, "the the the " * 30, "a"), (19, base, "c"), (19, base, "c"), (20, "line\n" * 60, "a"),
        (-4, sentence(31, 55) + "\n" + base, "b"),
    ]


def frame(spark, rows):
    full = [(i, t, "en", s, len(t or ""), *["x"] * 11) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def id_key(i):
    return float("inf") if i is None else i


def smallest(ids):
    return min(ids, key=id_key)


def exact(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    return [(i, smallest(g := groups[SPACE.sub(" ", t or "")]), len(g)) for i, t, _ in rows]


def shingles(text, n):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def near(rows, n=4, percent=80):
    sets = [shingles(t, n) for _, t, _ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    members = defaultdict(list)
    for i, row in enumerate(rows):
        members[root(i)].append(row[0])
    return [(r[0], len(sets[i]), smallest(members[root(i)])) for i, r in enumerate(rows)]


def repeats(rows, length=50):
    """doc_id, bytes and removed byte places of every row."""
    first = {}
    for i, t, _ in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            g = raw[p : p + length]
            first[g] = min(first.get(g, float("inf")), id_key(i))
    out = []
    for i, t, _ in rows:
        raw, gone = (t or "").encode(), set()
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < id_key(i):
                gone.update(range(p, p + length))
        out.append((i, raw, gone))
    return out


def repeat_words(text, n=3):
    w = words(text)
    count = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    return len({k + j for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for j in range(n)})
