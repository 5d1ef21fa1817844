"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against windows of training tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .base import ascii_lower, beside, checkpoint, split_words, table, written
from .rows import attach

#: Everything but ASCII digits, lower-case letters and non-ASCII characters parts words (after lower-casing A-Z).
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing, and its complement.
NON_WORD_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPANS = "array<struct<s:int,e:int>>"
WINDOW = 13
#: The window set is broadcast up to this many bytes; a larger one is joined by shuffle.
BROADCAST_BYTES = 64_000_000


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), NON_WORD)


def _windows(w: str, n: str) -> Column:
    """Every window of n words as an array; a shorter array, but not an empty one, is one window."""
    return F.expr(f"CASE WHEN size({w}) = 0 THEN array() ELSE transform(sequence(1, greatest(size({w}) - {n} + 1, 1)), i -> slice({w}, i, {n})) END")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each distinct window of the benchmark: gram_hash, gram_len, gram, item_ids (distinct, null items dropped)."""
    items = benchmark.select(F.col("item_id").alias("_item"), words(F.col("text")).alias("_w"))
    grams = items.select("_item", F.explode(_windows("_w", str(window))).alias("gram"))
    return grams.groupBy("gram").agg(F.collect_set("_item").alias("item_ids")).select(
        F.xxhash64("gram").alias("gram_hash"), F.size("gram").alias("gram_len"), "gram", "item_ids"
    )


def _step(n: int) -> int:
    """Distance of the anchors that a window of n words is looked up by: it covers just one position that is a multiple of
    this and has an anchor's (n + 1) // 2 words after it."""
    return n - (n + 1) // 2 + 1


def _anchors(w: str, n: int) -> Column:
    """Hashes of the anchors for windows of n words in an array of words w, in their order."""
    a = (n + 1) // 2
    return F.expr(f"CASE WHEN size({w}) < {n} THEN array() ELSE transform(sequence(1, size({w}) - {a - 1}, {_step(n)}), i -> xxhash64(slice({w}, i, {a}))) END")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of documents (doc_id, text) with what they share with benchmark (item_id, text).

    Adds n_words, n_hit (words inside any occurrence of a benchmark window), spans (array of covered word ranges
    [start, end), 0-based, merged), item_ids (sorted as strings) and contaminated (n_hit > 0 and n_hit * one_in >= n_words).
    An item of fewer words than the window, but not none, is one window. Null and word-free texts have n_words 0 and no
    hits. Rows that repeat a doc_id, or whose doc_id is null, are judged each by its own text. An item of null id hits
    without a name. Other columns of documents are dropped. Empty tables: no rows, or no hits. A very long text is one
    array of words in one row.

    Only built-in functions: documents are cut to words once for all lengths of windows, and the hashes of their anchors
    written; these are looked up in the broadcast set of anchors, and the words of each window about a hit in the
    broadcast set of windows. Beyond `limit` bytes both sets are joined by shuffle: what moves is a hash an anchor, and
    words only where anchors hit.
    """
    spark = documents.sparkSession
    grams = written(benchmark_windows(benchmark, window), "benchmark-windows")
    size = F.sum(F.octet_length(F.concat_ws(" ", "gram")) + 24 * F.size("gram") + 200 + 8 * F.size("item_ids"))
    lengths, held = grams.agg(F.sort_array(F.collect_set("gram_len")), size).first()  # at most `window` lengths
    narrow = lambda df: F.broadcast(df) if (held or 0) <= limit else df
    docs = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"))
    w = docs.select("doc_id", "_row", words(F.col("text")).alias("_w"))
    base = written(w.select("doc_id", "_row", F.size("_w").cast("long").alias("n_words"), *[_anchors("_w", n).alias(f"h{n}") for n in lengths or ()]), "anchors")
    if not lengths:
        hits = spark.createDataFrame([], f"_id long, _key long, _hit long, spans {SPANS}, item_ids array<long>")
    else:
        near = None
        for n in lengths:
            a, step = (n + 1) // 2, _step(n)
            known = grams.where(F.col("gram_len") == n).select(F.explode(F.expr(f"transform(sequence(1, {step}), i -> xxhash64(slice(gram, i, {a})))")).alias("anchor")).distinct()
            part = base.select("doc_id", "_row", F.posexplode(f"h{n}").alias("_i", "anchor")).join(narrow(known), "anchor")
            part = part.select("doc_id", "_row", F.lit(n).alias("n"), (F.col("_i") * step).alias("k"))
            near = part if near is None else near.unionByName(part)
        at = checkpoint(near.groupBy("doc_id", "_row").agg(F.collect_set(F.struct("n", "k")).alias("at")))
        # the words of the windows about each hit; no row that carries a whole text is made for each of them
        first, last = "greatest(x.k - x.n + div(x.n + 1, 2), 0)", "least(x.k, size(_w) - x.n)"
        about = F.expr(f"flatten(transform(at, x -> transform(sequence(cast({first} AS int), cast({last} AS int)), p -> named_struct('_pos', p, '_gram', slice(_w, p + 1, x.n)))))")
        placed = attach(docs, at, "inner").select("doc_id", "_row", words(F.col("text")).alias("_w"), "at").select("doc_id", "_row", F.inline(about))
        placed = placed.withColumn("gram_hash", F.xxhash64("_gram")).withColumn("_len", F.size("_gram"))
        found = placed.join(narrow(grams), "gram_hash").where(F.col("_gram") == F.col("gram"))
        doc = ["_id", "_key"]
        before = Window.partitionBy(*doc).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
        upto = Window.partitionBy(*doc).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
        # rows of one document only meet: their number is bounded by its text
        placed = found.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_key"), F.col("_pos").alias("s"), (F.col("_pos") + F.col("_len")).alias("e"), "item_ids")
        runs = placed.withColumn("_prev", F.max("e").over(before)).withColumn("_new", F.col("_prev").isNull() | (F.col("s") > F.col("_prev")))
        runs = runs.withColumn("_run", F.sum(F.col("_new").cast("int")).over(upto))
        spans = runs.groupBy(*doc, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.collect_set("item_ids").alias("items"))
        hits = spans.groupBy(*doc).agg(
            F.sum((F.col("e") - F.col("s")).cast("long")).alias("_hit"),
            F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"),
            F.array_distinct(F.flatten(F.flatten(F.collect_list("items")))).alias("item_ids"),
        )
    out = base.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_key")), "left")
    n_hit = F.coalesce("_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
        F.array_sort(F.coalesce(F.col("item_ids").cast("array<string>"), F.array().cast("array<string>"))).alias("item_ids"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"), "_row",
    )


def without_spans(text: Column, spans: Column) -> Column:
    """text without the words of spans and what stands between them."""
    parts = F.split(text, ANY_CASE)  # what follows each word, after the head
    raw = F.array_remove(F.split(text, NON_WORD_RAW), "")
    body = F.zip_with(raw, F.slice(parts, F.lit(2), F.size(raw)), lambda w, x: F.concat(w, x))
    # what lies between spans, slice by slice
    start = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["e"]))
    end = F.concat(F.transform(spans, lambda x: x["s"]), F.array(F.size(raw)))
    kept = F.flatten(F.zip_with(start, end, lambda s, e: F.slice(body, s + 1, e - s)))
    return F.concat(F.element_at(parts, 1), F.array_join(kept, ""))


def decontaminate(documents: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """documents, all columns whatever their names, without contaminated ones (remove="documents"), or with every hit
    span cut from the text (remove="spans"; a null text stays null). Clean documents stay as they are, however often a
    row repeats; rows of one doc_id, or of a null one, are judged each by its own text. Very long texts, empty tables: as
    in contamination."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    found = contamination(documents, benchmark, window, one_in).where(F.col("contaminated") if remove == "documents" else F.col("n_hit") > 0)
    found = found.select(F.col("doc_id").alias("id"), F.col("_row").alias("row"), "spans").dropDuplicates(["id", "row"])
    on = lambda left, right: left["id"].eqNullSafe(right["id"]) & (left["row"] == right["row"])
    keys = {"id": F.col("doc_id"), "row": F.xxhash64("doc_id", "text")}
    if remove == "documents":
        return beside(documents, found, on, "left_anti", **keys)
    out = beside(documents, found, on, "left", **keys)
    columns = {c: F.col("whole")[f"c{k}"] for k, c in enumerate(documents.columns)}
    columns["text"] = F.when(F.col("spans").isNull(), columns["text"]).otherwise(without_spans(columns["text"], F.col("spans")))
    return out.select(*[v.alias(c) for c, v in columns.items()])


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


OP1_SQL = r"""
WITH b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, w[i:i + 12] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), pos AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (
    SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d CROSS JOIN (SELECT DISTINCT len(g) AS n FROM win))
), hit AS (
  SELECT doc_id, item_id, i, n FROM pos JOIN win USING (g)
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN items USING (doc_id)
"""
