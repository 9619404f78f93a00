"""Mixing sources to target weights by entropy balancing.

The mix gives every document a rate between 0 and a cap. Among all rates that meet each source's
word target, those closest to "every document once" in relative entropy are exponential in the
document's size: rate = min(cap, exp(lambda * size / mean size)), with one multiplier per source.
The multipliers minimise a convex dual, one term per document, solved by Newton iterations whose
gradient and curvature are sums over all documents, computed by Spark. Rates become whole copies:
floor(rate) copies, and one more for the documents that come first by a hash until the source's
words are met; what the next document is too long for goes to later ones that still fit.

Everything is built-in expressions. A hot source is only ever summed with partial aggregation:
documents enter the iterations as counts per (source, size), which is all a rate depends on. The
tables per source are small against the documents, but nothing relies on that: they are staged
and joined as Spark sees fit.

Defined results: a null source is a source of its own, last in order; a null text has size 0;
documents of size 0 are never taken; a null doc_id is an id like any other; repeated rows are
documents of their own and, having equal hashes, get equal copies; an empty table gives an empty
mix. A source whose words are all at the cap is taken exactly cap times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.llm.words import n_words_of, table
from firnline.operators.rows import with_ordinal
from firnline.staging import release, stage

CAP = 3
WEIGHTS = (5.0, 2.0, 1.0)
TOLERANCE = 1e-9
MAX_NEWTON = 60
# Rounding: bins of one pass, and passes; 1024 ** 3 places in all.
BINS, PASSES = 1024, 3
# Rounds of giving what is left to documents that still fit.
ROUNDS = 3


def sized(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source and size only; the words of the text are counted here, once."""
    return df.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        n_words_of(F.col(text)).alias("size"),
    )


def _with_key(df: DataFrame) -> DataFrame:
    """Adds `_key`: the source as a join key that is never null and sorts as the source, null last."""
    return df.withColumn("_key", F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: _key, source, source_size, target. `sizes` has _key, source, source_size.

    Sources in code point order get `weights` in turn and share the sum of all sizes. A target
    above cap times its source is cut to that, and what is cut is shared again by weight among the
    others, until none is above.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = stage(with_ordinal(sizes, ["_key"], name="_rank").withColumn("_weight", weight).drop("_rank"))
    most = cap * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0
    while True:
        full = F.col("_weight") * F.lit(share) >= most
        spent, open_weight = ranked.agg(
            F.coalesce(F.sum(F.when(full, most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0)),
        ).first()
        again = (total - spent) / open_weight if open_weight else share
        if again <= share:
            break
        share = again
    return ranked.select(
        "_key", "source", "source_size",
        F.least(F.col("_weight") * F.lit(share), most.cast("double")).alias("target"),
    )


def _rate(z: Column, multiplier: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(multiplier * z, F.lit(50.0))))


def solve(counts: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds `_lambda` and `_mean` to `targets`: the multiplier of each source.

    `counts` has _key, size, _n. Every pass sums the dual's gradient and curvature of all sources
    over all documents; a step that would leave the bracket of the root is replaced by halving it.
    Sources whose target is 0 or the cap keep no multiplier. A source that does not settle is an error.
    """
    n = F.col("_n")
    mean = counts.groupBy("_key").agg((F.sum(F.col("size") * n) / F.sum(n)).alias("_mean"))
    state = stage(
        targets.join(mean, "_key")
        .withColumn("_open", (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size")))
        .withColumns({"_lambda": F.lit(0.0), "_low": F.lit(None).cast("double"), "_high": F.lit(None).cast("double")})
    )
    for _ in range(MAX_NEWTON):
        z = F.try_divide(F.col("size").cast("double"), F.col("_mean"))
        rate = _rate(z, F.col("_lambda"), cap)
        sums = (
            counts.join(state.where("_open").select("_key", "_mean", "_lambda"), "_key")
            .groupBy("_key")
            .agg(
                F.sum(n * F.col("size") * rate).alias("_taken"),
                F.sum(F.when(rate < cap, n * F.col("size") * z * rate).otherwise(0.0)).alias("_slope"),
            )
        )
        gap = F.col("_taken") - F.col("target")
        low = F.when(gap < 0, F.col("_lambda")).otherwise(F.col("_low"))
        high = F.when(gap > 0, F.col("_lambda")).otherwise(F.col("_high"))
        newton = F.col("_lambda") - gap / F.nullif(F.col("_slope"), F.lit(0.0))
        inside = (newton > F.coalesce("_low", newton - 1)) & (newton < F.coalesce("_high", newton + 1))
        # Without a bracket on that side yet, a step goes no further than doubling.
        reach = 2 * F.abs("_lambda") + 4
        fallback = (
            F.when(F.col("_low").isNotNull() & F.col("_high").isNotNull(), (F.col("_low") + F.col("_high")) / 2)
            .when(gap < 0, F.col("_lambda") + reach)
            .otherwise(F.col("_lambda") - reach)
        )
        step = F.when(inside & (F.abs(newton - F.col("_lambda")) <= reach), newton).otherwise(fallback)
        before = state
        state = stage(
            before.join(sums, "_key", "left")
            .withColumns({"_low": low, "_high": high})
            .withColumns(
                {
                    "_open": F.col("_open") & (F.abs(gap) > TOLERANCE * F.col("target")),
                    "_lambda": F.when(
                        F.col("_open") & (F.abs(gap) > TOLERANCE * F.col("target")), step
                    ).otherwise(F.col("_lambda")),
                }
            )
            .select(*before.columns)
        )
        release(before.sparkSession, before)
        if not state.where("_open").limit(1).count():
            break
    else:
        names = [r._key[1:] for r in state.where("_open").limit(5).collect()]
        raise ArithmeticError(f"sources that did not settle in {MAX_NEWTON} passes: {names}")
    # Six decimals, so that the last bits of a sum, which depend on its order, decide nothing.
    return state.select(
        "_key", "source", "source_size", "target", F.round("_mean", 6).alias("_mean"), F.round("_lambda", 6).alias("_lambda")
    )


def _final_rate(cap: int) -> Column:
    """The rate of a document beside the columns of its source."""
    z = F.try_divide(F.col("size").cast("double"), F.col("_mean"))
    return (
        F.when((F.col("size") == 0) | (F.col("target") <= 0), F.lit(0.0))
        .when(F.col("target") >= cap * F.col("source_size"), F.lit(float(cap)))
        .otherwise(_rate(z, F.col("_lambda"), cap))
    )


def _place() -> Column:
    """Where a document stands in the order of getting one copy more: in [-1, 1), below the edge it does."""
    uniform = F.pmod(F.xxhash64("doc_id", "size"), F.lit(1 << 40)) / float(1 << 40)
    return uniform - (F.col("_rate") - F.floor("_rate"))


def _bin(level: int) -> Column:
    return F.floor((F.col("_place") + 1) / 2 * BINS**level).cast("long")


def _edges(movable: DataFrame, left: DataFrame) -> DataFrame:
    """Per source: the bin of `_place` below which all of `movable` fits into `_left` words, and what is left then.

    The bin is found by narrowing: each pass sums the sizes per (source, bin) of the bin found
    before, so a pass never holds more than `BINS` rows of a source.
    """
    found = stage(left.select("_key", "_left", F.lit(0).cast("long").alias("_edge")))
    for level in range(1, PASSES + 1):
        part = (
            movable.withColumn("_bin", _bin(level))
            .join(found.select("_key", "_edge"), "_key")
            .where(F.floor(F.col("_bin") / BINS) == F.col("_edge"))
            .groupBy("_key", "_bin")
            .agg(F.sum("size").alias("_sum"))
        )
        inside = Window.partitionBy("_key").orderBy("_bin")
        crossed = (
            part.withColumn("_through", F.sum("_sum").over(inside))
            .join(found, "_key")
            .groupBy("_key")
            .agg(
                # the last bin that still fits wholly, then the one in which the words are met
                F.max(F.when(F.col("_through") <= F.col("_left"), F.col("_bin"))).alias("_fits"),
                F.max(F.when(F.col("_through") <= F.col("_left"), F.col("_through"))).alias("_spent"),
                F.min(F.when(F.col("_through") > F.col("_left"), F.col("_bin"))).alias("_next"),
            )
        )
        rest = F.col("_left") - F.coalesce("_spent", F.lit(0))
        edge = F.coalesce(F.col("_next"), F.col("_fits") + 1, F.col("_edge") * BINS)
        before = found
        found = stage(before.join(crossed, "_key", "left").select("_key", rest.alias("_left"), edge.alias("_edge")))
        release(before.sparkSession, before)
    return found


def round_up_edges(rated: DataFrame, params: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds `_edges`: per source, ranges of sizes and of bins of `_place`. Documents in both get one copy more.

    The first range has all sizes. What the document at its edge is too long for goes to later
    documents that still fit, and so on for ROUNDS rounds. In the end the one document is added
    that brings the source nearest to its target, if any does.
    """
    movable = rated.where(F.col("_rate") > F.floor("_rate"))
    base = rated.groupBy("_key").agg(F.sum(F.col("size") * F.floor("_rate")).alias("_whole"))
    state = stage(
        params.join(base, "_key", "left").select(
            "_key", (F.col("target") - F.coalesce("_whole", F.lit(0))).alias("_left"),
            F.array().cast("array<struct<low:double,high:double,start:bigint,edge:bigint>>").alias("_edges"),
        )
    )
    endless = F.lit(float("inf"))

    def add(found: DataFrame, low: Column, high: Column, start: Column) -> DataFrame:
        """`found` has _k, _rest and _edge."""
        one = F.struct(
            low.cast("double").alias("low"), high.cast("double").alias("high"), start.cast("long").alias("start"), F.col("_edge").alias("edge")
        )
        more = F.when(F.col("_k").isNotNull(), F.array_append("_edges", one)).otherwise(F.col("_edges"))
        added = state.join(found, F.col("_key") == F.col("_k"), "left")
        return stage(added.select("_key", F.coalesce("_rest", "_left").alias("_left"), more.alias("_edges")))

    for turn in range(ROUNDS):
        limit = F.col("_left") if turn else endless
        waiting = movable.join(state, "_key").where((F.col("size") <= limit) & ~_more()).select("_key", "size", "_place")
        found = _edges(waiting, state)
        before, state = state, add(found.select(F.col("_key").alias("_k"), F.col("_left").alias("_rest"), "_edge"), F.lit(0), limit, F.lit(0))
        release(before.sparkSession, before)
    # Rows of one size in one bin are taken together, as repeated rows must be.
    waiting = movable.join(state, "_key").where((F.col("size") < 2 * F.col("_left")) & ~_more())
    together = waiting.groupBy("_key", "_left", "size", _bin(PASSES).alias("_bin")).agg(F.sum("size").alias("_sum"))
    off = F.abs(F.col("_sum") - F.col("_left"))
    best = together.where(off < F.col("_left")).groupBy(F.col("_key").alias("_k")).agg(
        F.min(F.struct(off.alias("off"), "_bin", "size", (F.col("_left") - F.col("_sum")).alias("rest"))).alias("_best")
    )
    best = best.select("_k", F.col("_best.rest").alias("_rest"), (F.col("_best._bin") + 1).alias("_edge"), F.col("_best.size").alias("_size"))
    before, state = state, add(best, F.col("_size"), F.col("_size"), F.col("_edge") - 1)
    release(before.sparkSession, before)
    return params.join(state.select("_key", "_edges"), "_key", "left")


def _more() -> Column:
    """Whether a document gets one copy more than its rate has whole ones."""
    return F.exists(
        "_edges", lambda e: F.col("size").between(e["low"], e["high"]) & _bin(PASSES).between(e["start"], e["edge"] - 1)
    )


def _rated(docs: DataFrame, params: DataFrame, cap: int) -> DataFrame:
    return docs.join(params, "_key").withColumn("_rate", _final_rate(cap)).withColumn("_place", _place())


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source (`_key`): source_size, target and what decides the copies of its documents.

    `docs` has doc_id, source, size and `_key`.
    """
    counts = stage(docs.groupBy("_key", "source", "size").agg(F.count(F.lit(1)).alias("_n")))
    sizes = counts.groupBy("_key", "source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"))
    params = stage(solve(counts, source_targets(sizes, weights, cap), cap))
    rated = _rated(docs, params.drop("source"), cap).select("_key", "size", "_rate", "_place")
    return stage(round_up_edges(rated, params, cap))


def with_copies(docs: DataFrame, plan: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds source_size, target, rate and copies to `docs` (doc_id, source, size, _key and others)."""
    copies = F.floor("_rate") + F.when((F.col("_rate") > F.floor("_rate")) & _more(), 1).otherwise(0)
    return (
        _rated(docs, plan.drop("source"), cap)
        .withColumn("copies", copies.cast("long"))
        .withColumnRenamed("_rate", "rate")
        .drop("_place", "_edges", "_mean", "_lambda")
    )


def mix(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, cap: int = CAP,
) -> DataFrame:
    """The mixed corpus: each row of `df` as often as the mix takes it, with the columns of `df`."""
    row = df.select(
        F.struct("*").alias("_row"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        n_words_of(F.col(text)).alias("size"),
    )
    docs = _with_key(row)
    plan = mix_plan(stage(docs.drop("_row")), weights, cap)
    repeated = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return (
        with_copies(docs, plan, cap).where(F.col("copies") > 0).select("_row", repeated).select("_row.*")
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stage(_with_key(sized(table(spark, sf_dir, "documents"))))
    mixed = with_copies(docs, mix_plan(docs))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
        "source", "rate", "copies",
    )
