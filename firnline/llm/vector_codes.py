"""Product codes of vectors, with codebooks trained by dual-tree Lloyd rounds in whole numbers.

A vector is cut into equal parts, and each part is coded by the nearest entry of its position's
codebook. Rows are gathered once into chunks; for every part position a chunk holds a balanced
tree over its parts, with the bounding box and the sum of each node, and is written to the shared
folder. A round sends the codebooks to the chunks. There, a tree over the entries meets the tree
over the parts: of each pair of nodes the boxes give the least and the greatest distance, a pair
whose least distance is above another's greatest is dropped, and the others are split on both
sides. A node that one entry is left for goes to it whole, by its cached sum; the parts of leaves
that are still open are compared with the entries that are left for them. All bounds and distances
are whole numbers, so pruning never changes a result. Chunks send one sum per entry and dimension,
which Spark adds up; the driver gets the sums of the codebooks, whose size is fixed.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; a
null vec_id is larger than any other, and equal ones are ordered by their vectors; repeated rows are
coded each; with fewer rows than entries the codebook is that small; labels of null go together; an
empty table gives an empty result; other columns are not read. Vectors of unequal length, or of a
length that the number of parts does not divide, are an error, as are components so large that a
distance passes 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.words import table
from firnline.staging import release, stage

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
CHUNK_ROWS = 1 << 14
LEAF = 32
#: Labels with more than one in so many rows are joined by broadcast: there are fewer of them than this.
HOT_LABELS = 1000


class Tree:
    """A balanced tree over points, level by level; node i of a level of m nodes holds the places
    from i * n // m to (i + 1) * n // m of `order`."""

    def __init__(self, order: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.order, self.points, self.low, self.high, self.sums = order, points, low, high, sums

    @staticmethod
    def depth(n: int, leaf: int) -> int:
        return max(0, (max(1, n // leaf) - 1).bit_length())

    @staticmethod
    def edges(n: int, level: int) -> np.ndarray:
        return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level

    @classmethod
    def over(cls, points: np.ndarray, leaf: int) -> Tree:
        n = len(points)
        order, lows, highs, sums = np.arange(n), [], [], []
        for level in range(cls.depth(n, leaf) + 1):
            edges = cls.edges(n, level)
            if level:  # halve the nodes of the level above along their widest dimension
                above = cls.edges(n, level - 1)
                node = np.repeat(np.arange(len(above) - 1), np.diff(above))
                widest = (highs[-1] - lows[-1]).argmax(axis=1)
                order = order[np.lexsort((points[order, widest[node]], node))]
            ordered = points[order]
            lows.append(np.minimum.reduceat(ordered, edges[:-1]))
            highs.append(np.maximum.reduceat(ordered, edges[:-1]))
            sums.append(np.add.reduceat(ordered, edges[:-1]))
        return cls(order, points[order], np.concatenate(lows), np.concatenate(highs), np.concatenate(sums))


def _apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray):
    """Least and greatest squared distances between pairs of boxes."""
    gap = np.maximum(np.maximum(other_low - high, low - other_high), 0)
    reach = np.maximum(other_high - low, high - other_low)
    return (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)


def assign(tree: Tree, entries: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each place of the tree (ties to the lowest), and of each entry the number
    and the sum of its points."""
    n, k = len(tree.points), len(entries)
    depth = Tree.depth(n, leaf)
    chosen = np.empty(n, np.int64)
    counts, sums = np.zeros(k, np.int64), np.zeros_like(entries)
    of_entries = Tree.over(entries, 1)
    entry_depth = Tree.depth(k, 1)
    node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(max(depth, entry_depth) + 1):
        mine, theirs = min(level, depth), min(level, entry_depth)
        first, entry_first = (1 << mine) - 1, (1 << theirs) - 1  # where the level starts in the arrays
        least, most = _apart(
            tree.low[first + node], tree.high[first + node],
            of_entries.low[entry_first + other], of_entries.high[entry_first + other],
        )
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        bound = np.repeat(np.minimum.reduceat(most, starts), np.diff(np.r_[starts, len(node)]))
        left = least <= bound
        node, other = node[left], other[left]
        edges, entry_edges = Tree.edges(n, mine), Tree.edges(k, theirs)
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        alone = np.diff(np.r_[starts, len(node)]) == 1
        alone &= entry_edges[other[starts] + 1] - entry_edges[other[starts]] == 1
        settled, entry = node[starts[alone]], of_entries.order[entry_edges[other[starts[alone]]]]
        sizes = edges[settled + 1] - edges[settled]
        np.add.at(counts, entry, sizes)
        np.add.at(sums, entry, tree.sums[first + settled])
        places = np.repeat(edges[settled] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        chosen[places] = np.repeat(entry, sizes)
        open_pairs = ~np.repeat(alone, np.diff(np.r_[starts, len(node)]))
        node, other = node[open_pairs], other[open_pairs]
        if not len(node):
            return chosen, counts, sums
        if level < max(depth, entry_depth):
            node, other = _children(node, other, level < depth, level < entry_depth, Tree.edges(k, min(level + 1, entry_depth)))
    # Leaves that more than one entry is left for.
    edges, single = Tree.edges(n, depth), of_entries.order[Tree.edges(k, entry_depth)[other]]
    leaves, row = np.unique(node, return_inverse=True)
    possible = np.zeros((len(leaves), k), bool)
    possible[row, single] = True
    sizes = edges[leaves + 1] - edges[leaves]
    places = np.repeat(edges[leaves] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    points, possible = tree.points[places], np.repeat(possible, sizes, axis=0)
    away = np.empty((len(places), k), np.int64)
    for e in range(k):
        gap = points - entries[e]
        away[:, e] = (gap * gap).sum(axis=1)
    away[~possible] = np.iinfo(np.int64).max
    chosen[places] = nearest = away.argmin(axis=1)
    counts += np.bincount(nearest, minlength=k)
    np.add.at(sums, nearest, points)
    return chosen, counts, sums


def _children(node, other, split_node: bool, split_other: bool, entry_edges: np.ndarray):
    """Pairs of children of the pairs, by node; nodes of no entry are left out."""
    if split_node:
        node, other = np.r_[2 * node, 2 * node + 1], np.r_[other, other]
    if split_other:
        node, other = np.r_[node, node], np.r_[2 * other, 2 * other + 1]
        full = entry_edges[other + 1] > entry_edges[other]
        node, other = node[full], other[full]
    order = np.argsort(node, kind="stable")
    return node[order], other[order]


# ---- Spark ------------------------------------------------------------------------------------

_BLOBS = "order points low high sums".split()


def whole_numbers(x: np.ndarray, width: int, scale: int) -> np.ndarray:
    """floor(scale * x), checked for distances over `width` components to fit 64 bits."""
    x = np.floor(x.astype(np.float64) * scale)
    if width * (2 * float(np.abs(x).max()) + 1) ** 2 >= 2.0**63:
        raise ValueError("components are too large for distances of 64 bits")
    return x.astype(np.int64)


def _chunks(width: int, parts: int, scale: int, rows: int, leaf: int):
    """Rows to chunks with their trees."""

    def chunk(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks()
        vectors = whole.column("vector").combine_chunks()
        if (np.diff(vectors.offsets.to_numpy()) != width).any():
            raise ValueError(f"a vector has not {width} components as the first one has")
        x = whole_numbers(vectors.flatten().to_numpy(zero_copy_only=False), width, scale).reshape(-1, width)
        trees = [Tree.over(part, leaf) for part in np.split(x, parts, axis=1)]
        # Boxes and points fit 32 bits: their squares fit 64.
        blobs = [
            b"".join(np.ascontiguousarray(getattr(t, name)).astype("<i8" if name == "sums" else "<i4").tobytes() for t in trees)
            for name in _BLOBS
        ]
        lists = [
            pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), whole.column(c).combine_chunks())
            for c in ("vec_id", "label")
        ]
        return pa.record_batch([*lists, *(pa.array([b], pa.binary()) for b in blobs)], names=["vec_ids", "labels", *_BLOBS])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, rows - n)
                held.append(some)
                n, at = n + some.num_rows, at + some.num_rows
                if n == rows:
                    yield chunk(held)
                    held, n = [], 0
        if held:
            yield chunk(held)

    return run


def _trees(batch: pa.RecordBatch, at: int, width: int, parts: int, leaf: int) -> Iterator[Tree]:
    n = len(batch.column("vec_ids")[at])
    each = width // parts
    nodes = (2 << Tree.depth(n, leaf)) - 1
    shape = {"order": (n,), "points": (n, each), "low": (nodes, each), "high": (nodes, each), "sums": (nodes, each)}
    blobs = {
        name: np.frombuffer(batch.column(name)[at].as_buffer(), "<i8" if name == "sums" else "<i4")
        .astype(np.int64).reshape(parts, *shape[name])
        for name in _BLOBS
    }
    for p in range(parts):
        yield Tree(*(blobs[name][p] for name in _BLOBS))


def _round(codebooks: np.ndarray, leaf: int):
    """Chunks to the counts and sums of each entry: (part, entry, place, n, total)."""
    parts, k, each = codebooks.shape

    def run(batches):
        counts, sums = np.zeros((parts, k), np.int64), np.zeros_like(codebooks)
        for batch in batches:
            for at in range(batch.num_rows):
                for p, tree in enumerate(_trees(batch, at, parts * each, parts, leaf)):
                    _, n, total = assign(tree, codebooks[p], leaf)
                    counts[p] += n
                    sums[p] += total
        part, entry, place = (a.ravel() for a in np.indices(codebooks.shape))
        yield pa.record_batch(
            [pa.array(a.astype(np.int64)) for a in (part, entry, place, np.repeat(counts.ravel(), each), sums.ravel())],
            names=["part", "entry", "place", "n", "total"],
        )

    return run


def _coded(codebooks: np.ndarray, leaf: int):
    """Chunks back to rows, each with its code and its squared distance."""
    parts, k, each = codebooks.shape

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ids, labels = (batch.column(c)[at].values for c in ("vec_ids", "labels"))
                codes, error = np.empty((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, tree in enumerate(_trees(batch, at, parts * each, parts, leaf)):
                    chosen, _, _ = assign(tree, codebooks[p], leaf)
                    codes[tree.order, p] = chosen
                    gap = tree.points - codebooks[p][chosen]
                    error[tree.order] += (gap * gap).sum(axis=1)
                text, size = codes.tobytes().hex(), 2 * parts
                yield pa.record_batch(
                    [ids, labels, pa.array([text[i : i + size] for i in range(0, len(text), size)], pa.string()), pa.array(error)],
                    names=["vec_id", "label", "code", "error"],
                )

    return run


def trained(chunks: DataFrame, codebooks: np.ndarray, rounds: int, leaf: int) -> np.ndarray:
    """Codebooks (part, entry, place) after so many rounds."""
    for _ in range(rounds):
        found = (
            chunks.mapInArrow(_round(codebooks, leaf), "part long, entry long, place long, n long, total long")
            .groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        )
        codebooks = codebooks.copy()
        for row in found.collect():  # one row per component of the codebooks
            if row.n:
                codebooks[row.part, row.entry, row.place] = row.total // row.n
    return codebooks


def with_group_sum(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """`df` with the sum of `value` over equal `group`s, nulls together. Groups with more than a
    thousandth of the rows are fewer than a thousand and are broadcast, so no task gets one whole."""
    sums = stage(df.groupBy(F.col(group).alias("_group")).agg(F.sum(value).alias(name), F.count(F.lit(1)).alias("_n")))
    rows = sums.agg(F.sum("_n")).first()[0] or 0
    hot = sums.where(F.col("_n") > rows // HOT_LABELS).drop("_n").withColumn("_hot", F.lit(True))
    same = F.col(group).eqNullSafe(F.col("_group"))
    marked = df.join(F.broadcast(hot), same, "left")
    rest = marked.where(F.col("_hot").isNull()).drop("_group", name, "_hot")
    found = rest.join(sums.where(F.col("_n") <= rows // HOT_LABELS).drop("_n"), same)
    return marked.where("_hot").drop("_hot").unionByName(found).drop("_group")


def vector_codes(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, chunk_rows: int = CHUNK_ROWS, leaf: int = LEAF,
) -> tuple[DataFrame, np.ndarray]:
    """The kept rows as a staged table (vec_id, label, code, error), and the codebooks (part, entry, place)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    spark = df.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).where(F.col("vector").isNotNull() & F.forall("vector", finite))
    kind = rows.schema["label"].dataType.simpleString()
    ddl = f"vec_id long, label {kind}, code string, error long"
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    if not first:
        return spark.createDataFrame([], ddl), np.empty((parts, 0, 0), np.int64)
    width = len(first[0].vector)
    if not width or width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    if any(len(r.vector) != width for r in first):
        raise ValueError(f"a vector has not {width} components as the first one has")
    start = whole_numbers(np.array([r.vector for r in first]), width, scale)
    codebooks = np.ascontiguousarray(start.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    blobs = ", ".join(f"{name} binary" for name in _BLOBS)
    chunks = stage(
        rows.mapInArrow(_chunks(width, parts, scale, chunk_rows, leaf), f"vec_ids array<long>, labels array<{kind}>, {blobs}")
    )
    codebooks = trained(chunks, codebooks, rounds, leaf)
    coded = stage(chunks.mapInArrow(_coded(codebooks, leaf), ddl))
    release(spark, chunks)
    return coded, codebooks


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    return with_group_sum(coded, "label", "error", "label_error").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _sql() -> str:
    def assigned(name: str, books: str) -> str:
        return f"""{name} AS MATERIALIZED (
  SELECT vec_id, p, k, d FROM (SELECT x.vec_id, x.p, c.k, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d
    FROM x JOIN {books} c ON c.p = x.p AND c.j = x.j GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) = 1)"""

    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(e) // {PARTS}) AS p, (i - 1) % (len(e) // {PARTS}) AS j, e[i] AS x
  FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM v)),
c0 AS MATERIALIZED (
  SELECT x.p, x.j, f.k, x.x FROM x JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v QUALIFY k < {ENTRIES}) f USING (vec_id))"""]
    for r in range(ROUNDS):
        steps.append(assigned(f"a{r}", f"c{r}"))
        steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.p, c.j, c.k, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x
  FROM c{r} c LEFT JOIN (
    SELECT x.p, x.j, a.k, sum(x.x)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} a ON a.vec_id = x.vec_id AND a.p = x.p
    GROUP BY ALL) u ON u.p = c.p AND u.j = c.j AND u.k = c.k)""")
    last = f"c{ROUNDS}"
    steps.append(assigned("a", last))
    return ",\n".join(steps) + f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, k, j)) FROM {last}) AS codebooks_sha256
FROM (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a GROUP BY vec_id)
JOIN v USING (vec_id)"""


OP13_SQL = _sql()
