"""Mixing sources to target weights: certain whole copies first, then a Pareto order sample of fixed size in words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .base import checkpoint, space_words, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2


def uniform(key: Column, text: Column) -> Column:
    """A number in (0, 1) from a document's key and text alone, so that reruns agree."""
    mixed = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(mixed, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def measure(size: Column) -> Column:
    """What a document's inclusion probability is proportional to: the bits of its size in words, 1 for an empty one, so
    that long documents are likelier than short ones, but not by their length itself."""
    return F.length(F.bin(size + 1)).cast("long")


def inclusion(classes: DataFrame) -> DataFrame:
    """classes(source, m, words, gap): one row for each measure m that documents of a source have. Adds p, the inclusion
    probability of each of them: proportional to m, 1 where it would pass 1 (a certain copy), and so that the words
    expected are gap. A source has at most 64 rows."""
    down = Window.partitionBy("source").orderBy(F.desc("m"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    weighed = F.col("m") * F.col("words")
    x = classes.withColumn("full", F.coalesce(F.sum("words").over(before), F.lit(0).cast("long"))).withColumn("open", F.sum(weighed).over(whole) - F.coalesce(F.sum(weighed).over(before), F.lit(0).cast("long")))
    # the rate if all classes above this one are certain; the first at which this one isn't holds
    x = x.withColumn("rate", F.when(F.col("open") > 0, (F.col("gap") - F.col("full")) / F.col("open")))
    x = x.withColumn("c", F.max_by("rate", F.when(F.col("rate") * F.col("m") <= 1, F.col("m"))).over(whole))
    p = F.when(F.col("gap") <= 0, F.lit(0.0)).when(F.col("c").isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c") * F.col("m"))))
    return x.select("source", "m", p.alias("p"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """sizes: one row a source (source, source_size). Adds weight and target.

    Sources in code point order, null last, get the weights in turn; together they share `share` times all sizes. A
    target stops at `most` times its source's size and the excess goes to the others by weight, until none is above.
    Each round is one aggregate over the sources; the driver sees three numbers of it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    src = checkpoint(sizes.select("source", "source_size", turn.alias("weight")))
    words = share * (src.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.col("source_size") * most
    level, full = None, -1
    while True:
        below = F.lit(False) if level is None else cap < F.lit(level) * F.col("weight")
        n, capped, free = src.agg(F.sum(below.cast("int")), F.sum(F.when(below, cap)), F.sum(F.when(~below, F.col("weight")))).first()
        if n == full or not free:
            break
        full, level = n, (words - (capped or 0)) / free
    if level is None:
        level = 0.0
    return src.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row for each row of documents (doc_id, source, text): doc_id, source, size, source_size, target, p, copies, taken.

    size counts words between ASCII white space (null text: 0). A source whose target is r times its size takes
    floor(r) certain copies of each document. The words still missing are a Pareto order sample of unequal probabilities:
    p is proportional to measure(size) and 1 where it would pass that (inclusion); documents in the order of
    [u / (1 - u)] / [p / (1 - p)], u a hash of doc_id and text, are taken while their words fit; then the one document
    left that comes nearest to the words still missing, if taking it comes closer. Sizes count in words, so each source
    meets its target to within about one small document. Repeated rows are documents of their own (of rows that repeat a
    doc_id and text, any may be the one taken); an empty table gives no rows; a source of size 0 takes nothing.

    A hot source isn't sorted in one task: sums by slice of the ranking variable (square root of the number of documents)
    find the slice in which the sample ends, and only that slice is put in order.
    """
    sized = documents.select("doc_id", "source", F.size(space_words(F.col("text"))).cast("long").alias("size"), uniform(F.col("doc_id"), F.col("text")).alias("u"), F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("rid"))
    sized = checkpoint(sized.withColumn("m", measure(F.col("size"))))
    n = sized.count()
    slices = 1 << max(4, math.ceil(math.log2(max(n, 1)) / 2))
    classes = checkpoint(sized.groupBy("source", "m").agg(F.sum("size").alias("words")))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("certain", F.least(F.floor(ratio), F.lit(most)).cast("long"))
    plan = checkpoint(plan.withColumn("gap", F.col("target") - F.col("certain") * F.col("source_size")))

    def by_source(left: DataFrame, right: DataFrame, *cols: str) -> DataFrame:
        right = right.select(F.col("source").alias("_source"), *cols)
        return left.join(right, left["source"].eqNullSafe(right["_source"])).drop("_source")

    odds = checkpoint(inclusion(by_source(classes, plan, "gap"))).select(F.col("source").alias("_source"), F.col("m").alias("_m"), "p")
    # the ranking variable of order sampling, and its place between 0 and 1
    pareto = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    q = F.when(F.col("p") >= 1, F.lit(0.0)).when(F.col("p") > 0, pareto).otherwise(F.lit(float(2**60)) + F.col("u"))
    sized = sized.join(odds, sized["source"].eqNullSafe(odds["_source"]) & (sized["m"] == odds["_m"])).drop("_source", "_m", "m").withColumn("q", q)
    sized = checkpoint(sized.withColumn("slice", F.floor(F.col("q") / (1 + F.col("q")) * slices).cast("int")))
    sums = by_source(sized.groupBy("source", "slice").agg(F.sum("size").alias("words")), plan, "gap")
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("cum", F.sum("words").over(upto))
    cut = sums.groupBy("source").agg(F.min(F.when(F.col("cum") > F.col("gap"), F.col("slice"))).alias("cut"), F.coalesce(F.max(F.when(F.col("cum") <= F.col("gap"), F.col("cum"))), F.lit(0)).alias("before"))
    plan = checkpoint(by_source(plan, cut, "cut", "before"))

    place = F.struct("q", "doc_id", "size", "th", "rid")
    last = by_source(sized, plan, "gap", "cut", "before").where(F.col("slice") == F.col("cut")).withColumn("place", place)
    ordered = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    fits = last.withColumn("cum", F.col("before") + F.sum("size").over(ordered)).where(F.col("cum") <= F.col("gap"))
    end = fits.groupBy("source").agg(F.max("place").alias("end"), F.max("cum").alias("reached"))
    end = plan.join(end.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    end = checkpoint(end.withColumn("missing", F.col("gap") - F.coalesce("reached", "before")))

    chosen = F.col("cut").isNull() | (F.col("slice") < F.col("cut")) | ((F.col("slice") == F.col("cut")) & F.coalesce(F.col("place") <= F.col("end"), F.lit(False)))
    every = by_source(sized, end, "source_size", "target", "certain", "gap", "cut", "end", "missing").withColumn("place", place).withColumn("chosen", chosen)
    off = F.abs(F.col("size") - F.col("missing"))
    near = every.where(~F.col("chosen") & (F.col("size") > 0)).groupBy("source").agg(F.min(F.struct(off.alias("off"), F.col("place"), F.col("rid"))).alias("near"), F.max("missing").alias("missing"))
    near = near.where(F.col("near.off") < F.col("missing")).select(F.col("source").alias("_source"), F.col("near.rid").alias("_fill"))
    out = every.join(near, F.col("source").eqNullSafe(F.col("_source")), "left")
    copies = (F.col("certain") + (F.col("chosen") | F.coalesce(F.col("rid") == F.col("_fill"), F.lit(False))).cast("long")).cast("long")
    copies = F.when(F.col("source_size") > 0, F.least(copies, F.lit(most).cast("long"))).otherwise(F.lit(0).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "p", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: {documents} stands for the table, so that the pipeline's SQL can put another in its place.
MIX_SQL = r"""
sized AS (
  SELECT *, length(bin(size + 1)) AS m FROM (
    SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
      (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
    FROM {documents})
), src AS (
  SELECT source, source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)
), tot AS (
  SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS words, sum(w) AS weights FROM src
), lev AS (
  SELECT source, 2 * source_size AS cap, w,
    coalesce(sum(2 * source_size) OVER before, 0) AS capped, weights - coalesce(sum(w) OVER before, 0) AS free, words,
    row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS r
  FROM src, tot WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT coalesce((SELECT arg_min((words - capped::DOUBLE) / free::DOUBLE, r) FROM lev WHERE cap >= (words - capped::DOUBLE) / free::DOUBLE * w), 0) AS l
), plan AS (
  SELECT source, source_size, target, certain, target - certain * source_size AS gap FROM (
    SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 2) ELSE 0 END AS certain
    FROM (SELECT source, source_size, least((2 * source_size)::DOUBLE, l * w) AS target FROM src, level))
), class AS (
  SELECT source, m, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source, m
), rates AS (
  SELECT *, (gap - taken::DOUBLE) / nullif(left_over, 0)::DOUBLE AS rate FROM (
    SELECT c.source, c.m, p.gap, coalesce(sum(words) OVER above, 0) AS taken, sum(c.m * words) OVER (PARTITION BY c.source) - coalesce(sum(c.m * words) OVER above, 0) AS left_over
    FROM class c JOIN plan p ON c.source IS NOT DISTINCT FROM p.source WINDOW above AS (PARTITION BY c.source ORDER BY c.m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
), odds AS (
  SELECT source, m, CASE WHEN gap <= 0 THEN 0.0::DOUBLE WHEN c IS NULL THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, c * m)) END AS p
  FROM (SELECT source, m, gap, arg_max(rate, CASE WHEN rate * m <= 1 THEN m END) OVER (PARTITION BY source) AS c FROM rates)
), ranked AS (
  SELECT s.*, CASE WHEN o.p >= 1 THEN 0.0::DOUBLE WHEN o.p > 0 THEN (u / (1 - u)) / (o.p / (1 - o.p)) ELSE 1152921504606846976.0::DOUBLE + u END AS q
  FROM sized s JOIN odds o ON s.source IS NOT DISTINCT FROM o.source AND s.m = o.m
), ord AS (
  SELECT doc_id, s.source, size, q, source_size, target, certain, gap, sum(size) OVER (PARTITION BY s.source ORDER BY q, doc_id) <= gap AS chosen
  FROM ranked s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), lack AS (
  SELECT source, max(gap) - coalesce(sum(size) FILTER (chosen), 0) AS missing FROM ord GROUP BY source
), fill AS (
  SELECT doc_id FROM (
    SELECT doc_id, abs(size - missing) AS gone, missing, row_number() OVER (PARTITION BY o.source ORDER BY abs(size - missing), q, doc_id) AS r
    FROM ord o JOIN lack l ON o.source IS NOT DISTINCT FROM l.source WHERE NOT chosen AND size > 0)
  WHERE r = 1 AND gone < missing
), mixed AS (
  SELECT doc_id, source, size, source_size, target,
    CASE WHEN source_size > 0 THEN least(certain + CASE WHEN chosen OR doc_id IN (SELECT doc_id FROM fill) THEN 1 ELSE 0 END, 2) ELSE 0 END AS copies
  FROM ord
)
"""

OP5_SQL = "WITH " + MIX_SQL.replace("{documents}", "documents") + "SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM mixed"
