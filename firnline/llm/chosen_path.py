"""Near-duplicates by a chosen-path set similarity join.

A document's set are its distinct word shingles, as 64-bit hashes; two documents are linked if
their sets' Jaccard similarity reaches the threshold. Equal sets are one class from the start.

Every class gets a sketch of minwise tokens. A tree deals all classes out by one token of the
sketch. A node of up to `task_node` classes is one task's: a node that is still large is branched
again, by tokens that a hash of the node's path chooses, two branches per level so that similar
classes stay together in at least one of them, and small nodes are compared exhaustively by sketch.
A larger node is branched by Spark in the same way. Independent trees are repeated until the chance
of missing a pair at the threshold is below 1 - RECALL.

Branching does not part classes that are truly alike. Where the node's central sketch is near most
of its classes, those are joined to it, and only the others are compared with all. A node of Spark's
of which a pivot shows the same is cut into blocks that share some pivots.

A node gives links that span what its sketches show alike, never all pairs. All trees' links
together give each class one candidate group, and its full set goes once to that group, where every
pair that is not connected yet is compared exactly. Groups with more shingles than one task may hold
are cut into blocks that share pivots; what is outside the largest component after that is compared
with all of the group, block by block.

Defined results: a null text has no words, an empty set and no links, and neither does an empty
one; fewer words than a shingle make one shingle of all; repeated rows are of one class; a null
doc_id is larger than any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.components import components
from firnline.llm.words import table
from firnline.staging import release, stage

PERCENT = 80
TOKENS = 128  # minwise tokens of a sketch
NODE = 400  # classes of a node that are compared exhaustively
TASK_NODE = 20_000  # classes of a node that one task branches
TASK_SHINGLES = 1 << 22  # shingles of a candidate group that one task compares
TEXT_PASSES = 4  # passes in which the texts are dealt out to the classes whose sets are compared
DEPTH = 24
DENSE = 0.75  # share of the central sketch's tokens from which a class is near it
BRANCHES = 2
RECALL = 1 - 1e-7
#: Share of equal tokens below which a pair is not compared in full: over five standard deviations under 0.8.
SKETCH_SHARE = 0.6

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64)
_WORD = [np.uint64(int(x) | 1) for x in _rng.integers(1, 1 << 63, 64, dtype=np.uint64)]
MEMO_WORDS = 300_000


def trees_for(recall: float = RECALL, percent: int = PERCENT) -> int:
    """Trees after which a pair at the threshold is found with this chance, two levels below the root."""
    stay = percent / 100
    found = stay * (1 - (1 - stay) ** BRANCHES) ** 2
    return math.ceil(math.log(1 - recall) / math.log(1 - found))


class _Words(dict):
    """Hashes of the words met so far; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_memo = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))
    take = min(size, len(words))
    out = np.full(len(words) - take + 1, take, np.uint64)
    for j in range(take):
        out = out * _WORD[j % 64] + h[j : len(words) - take + 1 + j]
    return np.unique(_mixed(out))


def sketch(shingles: np.ndarray) -> np.ndarray:
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        low = np.minimum(low, (shingles[at : at + 1024, None] * _A + _B).min(axis=0))
    return (low >> np.uint64(32)).astype("<u4")


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _batches(rows: Iterable[tuple], schema: pa.Schema, every: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= every:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema
    )


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _schema(**fields: pa.DataType) -> pa.Schema:
    return pa.schema(list(fields.items()))


_I, _BIN = pa.int64(), pa.binary()


def _sketches(shingle: int, trees: int):
    schema = _schema(doc_id=_I, n_shingles=_I, digest=_BIN, roots=_BIN, sketch=_BIN)

    def one(doc_id, text):
        s = shingle_set(text, shingle)
        if not len(s):
            return doc_id, 0, None, None, None
        tokens = sketch(s)
        # 16 bits of a token do inside a node; the roots part all classes and need all 32.
        return doc_id, len(s), _digest(s), tokens[:trees].tobytes(), tokens.astype("<u2").tobytes()

    return lambda batches: _batches((one(*row) for row in _rows(batches)), schema, 1024)


def _sets(shingle: int):
    schema = _schema(digest=_BIN, shingles=_BIN)

    def one(wanted, text):
        s = shingle_set(text, shingle)
        return [(wanted, s.tobytes())] if _digest(s) == wanted else []

    return lambda batches: _batches((x for row in _rows(batches) for x in one(*row)), schema, 256)


def _hash(*parts: int) -> int:
    return xxhash.xxh3_64_intdigest(np.array(parts, np.int64).tobytes()) - (1 << 63)


def _roots():
    schema = _schema(tree=pa.int32(), node=_I, digest=_BIN)

    def run(batches):
        for digest, raw in _rows(batches):
            for tree, token in enumerate(np.frombuffer(raw, "<u4").tolist()):
                yield tree, _hash(tree, token), digest

    return lambda batches: _batches(run(batches), schema)


def _branched():
    schema = _schema(tree=pa.int32(), node=_I, digest=_BIN)

    def run(batches):
        for tree, node, digest, raw in _rows(batches):
            tokens = np.frombuffer(raw, "<u2")
            for branch in range(BRANCHES):
                chosen = _hash(node, branch) % TOKENS
                yield tree, _hash(node, branch, int(tokens[chosen])), digest

    return lambda batches: _batches(run(batches), schema)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(j)] = self.root(i)


class _Node:
    """The classes of one node; `union` joins those that their sketches show alike."""

    def __init__(self, sketches: np.ndarray, sizes: np.ndarray, percent: int, small: int):
        self.sketches, self.sizes, self.percent, self.small = sketches, sizes, percent, small
        self.union = _Union(len(sizes))
        self.links: list[tuple[int, int]] = []

    def _compare(self, one: int, others: np.ndarray) -> None:
        near = (self.sketches[others] == self.sketches[one]).sum(axis=1) >= SKETCH_SHARE * TOKENS
        low, high = np.minimum(self.sizes[others], self.sizes[one]), np.maximum(self.sizes[others], self.sizes[one])
        for other in others[near & (100 * low >= self.percent * high)].tolist():
            if self.union.root(one) != self.union.root(other):
                self.union.join(one, other)
                self.links.append((one, other))

    def search(self, members: np.ndarray, path: int, depth: int) -> None:
        if len(members) <= self.small:
            for at in range(len(members) - 1):
                self._compare(int(members[at]), members[at + 1 :])
            return
        sketches = self.sketches[members]
        some = sketches[:: max(1, len(members) // 1000)]
        near = (sketches == np.array([np.bincount(column).argmax() for column in some.T])).mean(axis=1)
        if not depth or 2 * np.count_nonzero(near >= DENSE) > len(members):
            self._dense(members, near)
            return
        for branch in range(BRANCHES):
            self._branch(members, path, branch, depth)

    def _branch(self, members: np.ndarray, path: int, branch: int, depth: int) -> None:
        tokens = self.sketches[members, _hash(path, branch) % TOKENS]
        order = np.argsort(tokens, kind="stable")
        tokens, members = tokens[order], members[order]
        cuts = np.flatnonzero(tokens[1:] != tokens[:-1]) + 1
        for group, token in zip(np.split(members, cuts), tokens[np.r_[0, cuts]].tolist(), strict=True):
            if len(group) > 1 and len({self.union.root(i) for i in group.tolist()}) > 1:
                self.search(group, _hash(path, branch, token), depth - 1)

    def _dense(self, members: np.ndarray, near: np.ndarray) -> None:
        """The most central classes with all, then those outside the largest part with all."""
        for one in members[np.argsort(-near, kind="stable")[:8]].tolist():
            self._compare(one, members[members != one])
        roots = np.array([self.union.root(i) for i in members.tolist()])
        values, counts = np.unique(roots, return_counts=True)
        for one in members[roots != values[counts.argmax()]].tolist():
            self._compare(one, members[members != one])


def _alike(percent: int, small: int, depth: int):
    """Rows (node, digest, n, sketch) sorted by node: links that span what is alike in each node."""
    schema = _schema(a=_BIN, b=_BIN)

    def run(batches):
        for path, rows in groupby(_rows(batches), key=itemgetter(0)):
            member = {row[1]: row for row in rows}
            if len(member) < 2:
                continue
            digests = sorted(member)
            raw = b"".join(member[d][3] for d in digests)
            sketches = np.frombuffer(raw, "<u2").reshape(len(digests), TOKENS)
            sizes = np.array([member[d][2] for d in digests], np.int64)
            node = _Node(sketches, sizes, percent, small)
            node.search(np.arange(len(digests)), path, depth)
            for i, j in node.links:
                yield tuple(sorted((digests[i], digests[j])))

    return lambda batches: _batches(run(batches), schema)


def _links(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of similar sets that span each component. Every set outside the largest component is
    compared with all that it is not connected to; inside it, nothing is left to find."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    mark = np.zeros(int(ids.max()) + 1, np.int32)
    label, done = np.arange(len(sets)), np.zeros(len(sets), bool)
    while True:
        left = np.flatnonzero(~done & (label != np.bincount(label).argmax()))
        if not len(left):
            return
        i = int(left[0])
        done[i] = True
        mine = ids[begin[i] : begin[i] + sizes[i]]
        mark[mine] = 1
        shared = np.add.reduceat(mark[ids], begin)
        mark[mine] = 0
        alike = 100 * shared >= percent * (sizes + sizes[i] - shared)
        for j in np.flatnonzero(alike & (label != label[i])).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                yield i, j


def _confirmed(percent: int):
    """Rows (part, digest, shingles) sorted by part: links that span what is similar in each part."""
    schema = _schema(a=_BIN, b=_BIN)

    def run(batches):
        for _, rows in groupby(_rows(batches), key=itemgetter(0)):
            held = {row[1]: row[2] for row in rows}
            digests = sorted(held)
            sets = [np.frombuffer(held[d], np.uint64) for d in digests]
            for i, j in _links(sets, percent):
                yield digests[i], digests[j]

    return lambda batches: _batches(run(batches), schema)


def _gathered(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key)


def _with_sketch(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    return nodes.join(classes.select("digest", "n", "sketch"), "digest").select("node", "digest", "n", "sketch")


def _alike_links(nodes: DataFrame, classes: DataFrame, percent: int, node: int, depth: int) -> DataFrame:
    return _gathered(_with_sketch(nodes, classes), "node").mapInArrow(_alike(percent, node, depth), "a binary, b binary")


def _near_pivot():
    schema = _schema(node=_I, near=pa.int64())

    def one(node, mine, pivot):
        return node, int((np.frombuffer(mine, "<u2") == np.frombuffer(pivot, "<u2")).mean() >= DENSE)

    return lambda batches: _batches((one(*row) for row in _rows(batches)), schema)


def _dense_nodes(large: DataFrame, classes: DataFrame) -> DataFrame:
    """Of large nodes, those with most classes near a pivot of theirs."""
    pivots = large.groupBy("node").agg(F.min_by("digest", F.xxhash64("digest", "node")).alias("digest"))
    pivots = _with_sketch(pivots, classes).select(F.col("node").alias("_of"), F.col("sketch").alias("_pivot"))
    member = _with_sketch(large, classes)
    beside = member.join(pivots, F.col("node") == F.col("_of")).select("node", "sketch", "_pivot")
    return (
        beside.mapInArrow(_near_pivot(), "node long, near long").groupBy("node").agg(F.avg("near").alias("_share"))
        .where("_share > 0.5").select("node")
    )


def _task_nodes(classes: DataFrame, task_node: int, depth: int) -> tuple[DataFrame, DataFrame | None]:
    """Nodes that a task takes whole, and larger ones that branching does not part: (node, digest, size)."""
    spark, ddl = classes.sparkSession, "tree int, node long, digest binary"
    level = stage(classes.select("digest", "roots").mapInArrow(_roots(), ddl))
    small, dense = [], []
    for at in range(depth + 1):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = stage(level.join(sizes, "node").select("tree", "node", "digest", "size"))
        release(spark, level)
        small.append(sized.where(F.col("size") <= task_node).select("node", "digest"))
        large = sized.where(F.col("size") > task_node)
        if not large.limit(1).count():
            break
        if at == depth:
            dense.append(large.drop("tree"))
            break
        stuck = stage(_dense_nodes(large, classes))
        dense.append(large.join(stuck, "node", "left_semi").drop("tree"))
        more = large.join(stuck, "node", "left_anti")
        level = stage(
            more.join(classes.select("digest", "sketch"), "digest").select("tree", "node", "digest", "sketch")
            .mapInArrow(_branched(), ddl)
        )
    nodes = small[0]
    for more in small[1:]:
        nodes = nodes.unionByName(more)
    if not dense:
        return nodes, None
    left = dense[0]
    for more in dense[1:]:
        left = left.unionByName(more)
    return nodes, left


def _blocks(large: DataFrame) -> DataFrame:
    """Groups (node, digest, size, half) as blocks of about twice `half`, half of them pivots that all blocks share."""
    count = F.ceil(F.col("size") / F.col("half"))
    place = F.pmod(F.xxhash64("digest"), F.lit(1 << 30))
    pivot = place * F.col("size") < F.col("half") * F.lit(1 << 30)
    own = F.array(F.pmod(F.xxhash64("digest", "node"), count))
    return large.select(
        "digest", "node", F.explode(F.when(pivot, F.sequence(F.lit(0), count - 1)).otherwise(own)).alias("_block")
    ).select(F.xxhash64("node", "_block").alias("node"), "digest")


def _stray_blocks(large: DataFrame, labels: DataFrame) -> DataFrame:
    """Block pairs that compare what a group (node, digest, half) has outside its largest component with all of it."""
    member = large.join(labels, large["digest"] == labels["v"], "left").select(
        "node", "digest", "half", F.coalesce("label", "digest").alias("label")
    )
    by_label = member.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
    most = by_label.groupBy("node").agg(F.max(F.struct("n", "label")).alias("_most"), F.sum("n").alias("size"))
    most = most.select(
        F.col("node").alias("_of"), F.col("_most.label").alias("_main"), "size", (F.col("size") - F.col("_most.n")).alias("_strays")
    )
    member = member.join(most.where("_strays > 0"), F.col("node") == F.col("_of")).withColumns(
        {"_members": F.ceil(F.col("size") / F.col("half")), "_parts": F.ceil(F.col("_strays") / F.col("half"))}
    )
    place = F.xxhash64("digest", "node")
    own, stray = F.pmod(place, "_members"), F.pmod(place, "_parts")
    all_rows = member.select(
        "node", "digest", own.alias("_m"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_s")
    )
    strays = member.where(F.col("label") != F.col("_main")).select(
        "node", "digest", F.explode(F.sequence(F.lit(0), F.col("_members") - 1)).alias("_m"), stray.alias("_s")
    )
    return all_rows.unionByName(strays).select(F.xxhash64("node", "_m", "_s").alias("node"), "digest").distinct()


def _candidate_groups(classes: DataFrame, percent: int, node: int, task_node: int, depth: int) -> DataFrame:
    """(v, label): the classes that sketches link with others, by candidate group."""
    nodes, large = _task_nodes(classes, task_node, depth)
    if large is not None:
        large = large.withColumn("half", F.lit(max(1, task_node // 2)).cast("long"))
        nodes = nodes.unionByName(_blocks(large))
    found = stage(_alike_links(nodes, classes, percent, node, depth).distinct())
    groups = components(found)
    if large is not None:
        more = stage(_alike_links(_stray_blocks(large, groups), classes, percent, node, depth).distinct())
        groups = components(found.unionAll(more))
    return groups


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int, passes: int = TEXT_PASSES) -> list[DataFrame]:
    """(digest, shingles) of the classes wanted, from the text of each one's representative.

    The join is by shuffle at every size: how many are wanted grows with the documents. Each pass takes
    the ids of one remainder, so that the shuffle holds no more than its share of all texts at once.
    """
    turn = lambda c: F.pmod(F.xxhash64(c), F.lit(passes))
    wanted = wanted.select("digest", F.col("rep").alias("_rep"))
    made = []
    for at in range(passes):
        here = wanted.where(turn("_rep") == at).hint("merge")
        texts = docs.where(turn("doc_id") == at).join(here, F.col("doc_id").eqNullSafe(F.col("_rep"))).select("digest", "text")
        made.append(stage(texts.mapInArrow(_sets(shingle), "digest binary, shingles binary").dropDuplicates(["digest"])))
    return made


def _confirm(parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    held = parts.join(sets, "digest").select("node", "digest", "shingles")
    return _gathered(held, "node").mapInArrow(_confirmed(percent), "a binary, b binary")


def _exact_labels(groups: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, percent: int, task_shingles: int) -> DataFrame:
    """(v, label) of the classes that have a link on their full sets."""
    member = groups.select(F.col("v").alias("digest"), F.col("label").alias("_group")).join(
        classes.select("digest", "rep", "n"), "digest"
    )
    totals = member.groupBy(F.col("_group").alias("_of")).agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("_all"))
    member = stage(
        member.join(totals, F.col("_group") == F.col("_of")).select(F.xxhash64("_group").alias("node"), "digest", "rep", "n", "size", "_all")
    )
    sets = reduce(DataFrame.unionAll, _sets_of(docs, member, shingle))
    fits = F.col("_all") <= task_shingles
    links = stage(_confirm(member.where(fits).select("node", "digest"), sets, percent))
    large = member.where(~fits)
    if large.limit(1).count():
        # A block holds the shingles of one task at the group's mean size.
        half = F.floor(F.lit(task_shingles) * F.col("size") / (2 * F.col("_all")))
        large = large.select("node", "digest", "size", F.greatest(F.lit(1).cast("long"), half).alias("half"))
        links = links.unionAll(stage(_confirm(_blocks(large), sets, percent)))
        links = links.unionAll(stage(_confirm(_stray_blocks(large, components(links)), sets, percent)))
    labels = components(links)
    release(member.sparkSession, member, sets)
    return labels


def near_groups(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = PERCENT,
    recall: float = RECALL, node: int = NODE, depth: int = DEPTH, task_node: int = TASK_NODE,
    task_shingles: int = TASK_SHINGLES,
) -> DataFrame:
    """One row per row of `df`: doc_id, n_shingles, component_id, kept."""
    trees = trees_for(recall, percent)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stage(
        docs.mapInArrow(_sketches(shingle, trees), "doc_id long, n_shingles long, digest binary, roots binary, sketch binary")
    )
    classes = stage(
        signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"),
            F.first("roots").alias("roots"), F.first("sketch").alias("sketch"),
        )
    )
    groups = _candidate_groups(classes, percent, node, task_node, depth)
    labels = _exact_labels(groups, docs, classes, shingle, percent, task_shingles)
    labelled = classes.select("digest", "rep").join(
        labels.withColumnRenamed("v", "digest"), "digest", "left"
    ).select("digest", "rep", F.coalesce("label", "digest").alias("label"))
    lowest = labelled.groupBy("label").agg(F.min("rep").alias("lowest"))
    of_class = stage(labelled.join(lowest, "label").select(F.col("digest").alias("_class"), "lowest"))
    signed = signed.select("doc_id", "n_shingles", "digest")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("lowest"))
    return (
        signed.join(of_class, signed["digest"] == of_class["_class"], "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """The rows of `df` that stay, with its columns: of each component the one with the smallest doc_id.

    Rows are told apart by a number of their own, so ids may be null or repeat; of equal ids one row stays.
    """
    rows = stage(df.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_n")))
    groups = near_groups(rows.select("_n", F.col(f"_row.`{text}`").alias("_text")), "_n", "_text", shingle)
    ids = rows.select("_n", F.col(f"_row.`{doc_id}`").cast("long").alias("_id"))
    member = stage(groups.join(ids, groups["doc_id"] == ids["_n"]).select("component_id", "_n", "_id"))
    least = F.min(F.struct(F.col("_id").isNull().alias("_last"), "_id", "_n"))
    stays = member.groupBy("component_id").agg(least.alias("_least")).select(F.col("_least._n").alias("_n"))
    gone = stage(member.select("_n").join(stays, "_n", "left_anti"))
    return rows.join(gone, "_n", "left_anti").select("_row.*")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
