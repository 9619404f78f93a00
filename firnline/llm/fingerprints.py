"""Document fingerprints by consistent weighted sampling, in built-in expressions only.

The terms of a text are its words in lower case, weighted by how often they occur. Of term i with
weight w, sample k draws r and c from Gamma(2, 1) and b uniformly, all by a hash of (i, k), and takes
t = floor(ln w / r + b) and a = c * exp(-r * (t - b + 1)). The sample is the pair (i, t) with the least
a. Two texts draw the same pair with a probability of sum(min(w, w')) / sum(max(w, w')), their
generalised Jaccard similarity, so the share of equal samples estimates it.

The uniform b cuts the gamma number r into two independent exponential ones, r * b = -ln u and
r * (1 - b) = -ln v. So t = floor((ln w - ln u) / r) and a = c * v * (u * v) ** t. While w * v is below
1, as for every term that occurs once, t is 0 and a = c * v, which takes a single logarithm.

A sample is one whole number, a in the high bits and a hash of (i, t) in the low ones, so that a
text's fingerprint is one hash aggregation with a `min` per sample; texts are dealt out by a row
number before, which no group shares, and stay in those buckets: of the edited texts only the part that
the next document gives is shuffled. The fingerprint is the low bits of all samples, in hex.

Defined results: a null text is empty; a text without words has an empty fingerprint, which is fully
like another empty one and not at all like others; null doc_ids come after all others in descending
order; rows of equal doc_id are ordered by a hash of their text; a single row is its own next; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.llm.words import SPACE, table, whole
from firnline.operators.skew import BLOCK, POS, block_sort
from firnline.staging import release, stage, stage_by

SAMPLES = 64
BITS = 16
_U = 21  # bits of a uniform draw
_A_BITS = 40  # binary places of a, which is below 2 ** 6


def _draw(h: Column, which: int) -> Column:
    """The first, second or third uniform draw in a 64-bit hash: an odd number below 2 ** _U."""
    return F.shiftrightunsigned(h, _U * which).bitwiseAND(F.lit((1 << _U) - 1)).bitwiseOR(F.lit(1).cast("long"))


def _sample(term: Column, weight: Column, k: int) -> Column:
    """What sample k sees of a term: the least is drawn."""
    first = F.xxhash64(term, F.lit(k))
    v = _draw(first, 0)
    c = F.lit(2 * _U * math.log(2)) - F.log(_draw(first, 1) * _draw(first, 2))
    # ln w + r * b reaches r where w * v reaches 1: only there t is above 0, and takes logarithms and a further draw.
    none = weight * v < F.lit(1 << _U)
    second = F.xxhash64(first)
    u, share = _draw(second, 0) * F.lit(2.0**-_U), v * F.lit(2.0**-_U)
    t = F.greatest(F.lit(1).cast("long"), F.floor((F.log(weight) - F.log(u)) / -F.log(u * share)))
    # e ** -(r * t) is (u * v) ** t
    a = F.when(none, c * v).otherwise(c * v * F.pow(u * share, t))
    # The low bits of all draws together tell the term; the high ones are small in what is drawn.
    folded = first.bitwiseXOR(F.shiftrightunsigned(first, _U)).bitwiseXOR(F.shiftrightunsigned(first, 2 * _U))
    drawn = F.when(none, folded).otherwise(F.xxhash64(second, t)).bitwiseAND(F.lit((1 << BITS) - 1))
    return F.shiftleft(F.floor(a * F.lit(2.0 ** (_A_BITS - _U))), BITS).bitwiseOR(drawn)


def _weighted_terms(dealt: DataFrame, row: str, text: str) -> DataFrame:
    """(row, term, weight) of texts that are dealt out by row."""
    words = dealt.select(row, F.explode(F.split(F.lower(text), SPACE + "+")).alias("_word")).where("_word != ''")
    counted = words.groupBy(row, F.xxhash64("_word").alias("_term")).agg(F.count(F.lit(1)).alias("_w"))
    return counted


def fingerprints(dealt: DataFrame, row: str, text: str, samples: int = SAMPLES) -> DataFrame:
    """(row, fingerprint) of texts with words; `row` is unique and `dealt` is partitioned by it."""
    terms = _weighted_terms(dealt, row, text)
    drawn = terms.groupBy(row).agg(
        *[F.min(_sample(F.col("_term"), F.col("_w"), k)).alias(f"_{k}") for k in range(samples)]
    )
    digits = BITS // 4
    low = [F.lpad(F.hex(F.col(f"_{k}").bitwiseAND(F.lit((1 << BITS) - 1))), digits, "0") for k in range(samples)]
    return drawn.select(row, F.lower(F.concat(*low)).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints, 0 to 1."""
    digits = BITS // 4
    part = lambda s: F.regexp_extract_all(s, F.lit(f"(.{{{digits}}})"))
    same = F.zip_with(part(a), part(b), lambda x, y: (x == y).cast("int"))
    count = F.aggregate(same, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0)))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(count / F.size(same))


def with_next(rows: DataFrame, order: list[Column]) -> DataFrame:
    """(row, next_row) in the given total order, the first after the last. Sorted blocks are numbered
    apart and joined at their edges, so no task sees the whole table."""
    blocks = block_sort(rows, order).df
    here = Window.partitionBy(BLOCK).orderBy(POS)
    inner = blocks.select(BLOCK, "row", F.lead("row").over(here).alias("_inner"))
    edges = blocks.groupBy(F.col(BLOCK).alias("_b")).agg(F.min_by("row", POS).alias("_first"))
    every = Window.orderBy("_b")  # one row per block
    after = F.coalesce(F.lead("_first").over(every), F.min_by("_first", "_b").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    edges = edges.select("_b", after.alias("_after"))
    return inner.join(edges, F.col(BLOCK) == F.col("_b")).select("row", F.coalesce("_inner", "_after").alias("next_row"))


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Each row's fingerprint, and that of its text with the second half replaced by the start of the
    next document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = df.sparkSession
    content = whole(F.col(text))
    docs = stage_by(
        df.select(
            F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"),
            F.length(content).cast("long").alias("n_chars"), F.xxhash64(content).alias("h"), content.alias("text"),
        ), "row",
    )
    texts = docs.select("row", "text")
    own = stage(fingerprints(texts, "row", "text", samples))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("row")]
    following = stage(with_next(docs.select("row", "doc_id", "h"), order))
    # What the next document gives to each: as many characters as the row replaces, and its fingerprint.
    lengths = docs.select(F.col("row").alias("_r"), F.floor(F.col("n_chars") / 2).alias("_half"))
    wanted = following.join(lengths, F.col("row") == F.col("_r")).select(F.col("row").alias("_to"), F.col("next_row").alias("_from"), "_half")
    given = texts.join(wanted, F.col("row") == F.col("_from")).select(
        "_to", F.substr("text", F.lit(1), F.col("_half").cast("int")).alias("_given")
    )
    prints = own.select(F.col("row").alias("_r"), F.col("fingerprint"))
    next_prints = following.join(prints, F.col("next_row") == F.col("_r")).select(
        F.col("row").alias("_n"), F.col("fingerprint").alias("_next_print")
    )
    chars = F.length("text")
    head = F.substr("text", F.lit(1), (chars - F.floor(chars / 2)).cast("int"))
    # Texts stay where they are dealt; only what is given moves. Edited texts are never written.
    edited = texts.join(given, F.col("row") == F.col("_to")).select("row", F.concat(head, "_given").alias("edited"))
    facts = edited.select(F.col("row").alias("_e"), F.sha2("edited", 256).alias("edited_sha256"))
    changed = fingerprints(edited, "row", "edited", samples)
    changed = changed.select(F.col("row").alias("_c"), F.col("fingerprint").alias("edited_fingerprint"))
    result = stage(
        docs.select("row", "doc_id", "n_chars")
        .join(facts, F.col("row") == F.col("_e"))
        .join(prints, F.col("row") == F.col("_r"), "left")
        .join(next_prints, F.col("row") == F.col("_n"), "left")
        .join(changed, F.col("row") == F.col("_c"), "left")
        .select("doc_id", "n_chars", "edited_sha256",
                *[F.coalesce(c, F.lit("")).alias(c) for c in ("fingerprint", "edited_fingerprint", "_next_print")])
    )
    release(spark, docs, own, following)
    return result.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next_print")).alias("near_next"),
    )


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
