"""Rows with exact copies and per-row side tables, for operators that read the texts more than once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpoint

#: A side table is broadcast up to so many bytes; beyond it a shuffle joins it.
SIDE_BYTES = 48_000_000
#: Bits of the table by which tasks know most hashes that no other place has: 2^27 bits are 16 MB for any input.
FILTER_BITS = 27


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and _row, a hash of both: rows that repeat doc_id and text have one key and one result."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"))


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, _row, first, n, least, least_row) of rows of keyed docs whose text other rows have too. first: the row of
    the smallest doc_id (then _row), which is least and least_row, stands for all n. Only hashes of texts are shuffled."""
    sums = docs.where(F.col("text").isNotNull()).select("doc_id", "_row", F.md5("text").alias("_md5"), F.octet_length("text").alias("_len"))
    groups = sums.groupBy("_md5", "_len").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "_row")).alias("rep")).where("n > 1")
    groups = checkpoint(groups.select(F.col("_md5").alias("_m"), F.col("_len").alias("_l"), "n", "rep"))  # so that the join can split a large group
    found = sums.join(groups, (F.col("_md5") == F.col("_m")) & (F.col("_len") == F.col("_l")))
    first = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("_row") == F.col("rep._row"))
    return checkpoint(found.select("doc_id", "_row", first.alias("first"), "n", F.col("rep.doc_id").alias("least"), F.col("rep._row").alias("least_row")).distinct())


def small(side: DataFrame, limit: int) -> bool:
    """Are the rows of side, which is materialised, within `limit` bytes?"""
    size = sum((F.octet_length(c) if t in ("binary", "string") else 16 + 8 * F.size(c) if t.startswith("array") else F.lit(8)) for c, t in side.dtypes)
    return (side.agg(F.sum(F.lit(48) + F.coalesce(size, F.lit(48)))).first()[0] or 0) <= limit


def attach(docs: DataFrame, side: DataFrame, how: str = "left", limit: int = SIDE_BYTES) -> DataFrame:
    """Join a side table (doc_id, _row, ...; one row a key, already materialised) to docs: broadcast if its size, which
    is measured first, is within the limit, so that texts stay where they are; else by shuffle."""
    side = side.withColumnRenamed("doc_id", "_id").withColumnRenamed("_row", "_key")
    narrow = small(side, limit)
    on = docs["doc_id"].eqNullSafe(side["_id"]) & (docs["_row"] == side["_key"])
    out = docs.join(F.broadcast(side) if narrow else side, on, how)
    return out if how in ("left_anti", "left_semi") else out.drop("_id", "_key")


def hash_filter(shared: DataFrame, bits: int = FILTER_BITS):
    """A broadcast table of 2^bits bits in which every h of `shared` (h: long) has its bit set.

    It is as large for any input, so it keeps work away but decides nothing: what passes must be judged by those who
    ask. Bits are gathered by machine words, of which the driver sees 2^(bits - 6) at most."""
    slot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    one = F.expr("shiftleft(1L, cast(h & 63L AS int))")
    words = shared.select(F.shiftright(slot, 6).alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    held = np.zeros(1 << (bits - 6), np.uint64)
    held[words.column("w").to_numpy().astype(np.int64)] = words.column("b").to_numpy().astype(np.int64).view(np.uint64)
    return shared.sparkSession.sparkContext.broadcast(held)


def passes(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which hashes (any 64-bit type) have their bit set in a hash_filter."""
    values = values.view(np.uint64)
    return (held[(values >> np.uint64(6)) & np.uint64(len(held) - 1)] >> (values & np.uint64(63)) & np.uint64(1)).astype(bool)


def doubled(codes: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of every window of n codes, by doubling."""
    h, span = codes, 1
    for bit in bin(n)[3:]:
        h = h[: len(h) - span] * np.uint64(pow(base, span, 1 << 64)) + h[span:]
        span *= 2
        if bit == "1":
            h = h[: len(h) - 1] * np.uint64(base) + codes[span : span + len(h) - 1]
            span += 1
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of polynomial hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def slices(batches, rows: int = 128):
    """Batches in parts of a few rows, so that texts are opened a few at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
