"""Exact dedup: a minimal perfect hash over the distinct digests of history, byte-checked lookups, one row of a group stays.

History becomes an index: digests are dealt to buckets by hash, and each bucket is one row with a minimal perfect hash of
its digests (levels of bits: a key whose position no other key of the level takes sets its bit and is done, the others go
on; a key's slot is the rank of its bit). A slot holds the whole digest, the winner's locator and the number of rows. A
lookup computes the slot and compares all 32 bytes there, as the hash sends strangers to some slot as well: members join
the slot's group, the others group by digest among themselves. Both sides are aggregated by digest before they meet, so
that copies, however many, are one row a digest and no bucket is larger than its share of the distinct digests.

Texts are equal when their UTF-8 bytes are (by SHA-256); null counts as empty. Of equal texts the row of the largest
doc_id stays (null lowest); of rows that repeat that doc_id as well, exactly one. An empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table, written

#: Distinct digests of a bucket, on average. One task holds one bucket at once: 4 MB of digests.
BUCKET = 1 << 16
#: Bits of a level for each key it is given.
GAMMA = 2
DIGEST = 32
INDEX = "bucket int, n int, sizes binary, bits binary, digests binary, ids binary, nulls binary, uids binary, counts binary"
GROUPS = "digest binary, keep_id long, keep_uid long, n long, member boolean"


def _position(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each digest (rows of four 64-bit words) in a level of `size` bits; each level mixes other words."""
    h = words[:, level % 4] * np.uint64(0x9E3779B97F4A7C15) + words[:, (level // 4 + 1 + level) % 4] + np.uint64(level * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) % np.uint64(size)


class PerfectHash:
    """A minimal perfect hash of distinct digests: n keys take the slots 0 to n - 1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def of(cls, words: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        while len(words):
            size = max(1, GAMMA * len(words))
            at = _position(words, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            sizes.append(size), bits.append(alone)
            words = words[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of every key; of strangers some slot, or -1."""
        out, left = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + _position(words[left], level, int(size)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.before[at[hit]]
            left = left[~hit]
        return out


def _words(column: pa.Array) -> np.ndarray:
    """A column of digests as rows of four 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, DIGEST // 8)


def _longs(column) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _built(group: pa.Table) -> pa.Table:
    """The index row of one bucket of (bucket, digest, id, uid, n)."""
    group = group.combine_chunks()
    words = _words(group.column("digest"))
    hashed = PerfectHash.of(words)
    slot = hashed.slots(words)
    order = np.empty(len(slot), np.int64)
    order[slot] = np.arange(len(slot))
    ids, uids, counts = (_longs(group.column(c).combine_chunks())[order] for c in ("id", "uid", "n"))
    nulls = group.column("id").is_null().to_numpy()[order]
    parts = [hashed.sizes.tobytes(), np.packbits(hashed.bits).tobytes(), words[order].tobytes(), ids.tobytes(), np.packbits(nulls).tobytes(), uids.tobytes(), counts.tobytes()]
    return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()), "n": pa.array([len(slot)], pa.int32())} | {k: pa.array([v], pa.binary()) for k, v in zip(("sizes", "bits", "digests", "ids", "nulls", "uids", "counts"), parts)})


def _opened(index: pa.Table):
    """(hash, digests, ids, nulls, uids, counts) of an index row; empty ones for no row."""
    if index.num_rows == 0:
        none = np.zeros(0, np.int64)
        return PerfectHash(none, np.zeros(0, bool)), np.zeros((0, DIGEST // 8), np.uint64), none, np.zeros(0, bool), none, none
    row = index.slice(0, 1).to_pylist()[0]
    sizes, n = np.frombuffer(row["sizes"], np.int64), row["n"]
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
    nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=n).astype(bool)
    return PerfectHash(sizes, bits), np.frombuffer(row["digests"], np.uint64).reshape(n, -1), np.frombuffer(row["ids"], np.int64), nulls, np.frombuffer(row["uids"], np.int64), np.frombuffer(row["counts"], np.int64)


def _probed(asked: pa.Table, index: pa.Table) -> pa.Table:
    """Groups of one bucket: slots with what the asked digests add to them, then the digests that no slot holds."""
    hashed, digests, ids, nulls, uids, counts = _opened(index)
    ids, nulls, uids, counts = ids.copy(), nulls.copy(), uids.copy(), counts.copy()
    words = _words(asked.column("digest")) if asked.num_rows else np.zeros((0, DIGEST // 8), np.uint64)
    slot = hashed.slots(words)
    found = slot >= 0
    found[found] = (digests[slot[found]] == words[found]).all(axis=1)  # all bytes: strangers have slots too
    if asked.num_rows:
        new_ids, new_uids, new_counts = (_longs(asked.column(c).combine_chunks()) for c in ("id", "uid", "n"))
        new_nulls = asked.column("id").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        at = slot[found]  # distinct digests, so each slot once
        a, b, x, y = ids[at], new_ids[found], nulls[at], new_nulls[found]
        later = ~y & (x | (b > a) | ((b == a) & (new_uids[found] > uids[at]))) | (x & y & (new_uids[found] > uids[at]))
        ids[at], nulls[at], uids[at] = np.where(later, b, a), np.where(later, y, x), np.where(later, new_uids[found], uids[at])
        counts[at] += new_counts[found]
        words, ids, nulls, uids, counts = words[~found], np.concatenate([ids, new_ids[~found]]), np.concatenate([nulls, new_nulls[~found]]), np.concatenate([uids, new_uids[~found]]), np.concatenate([counts, new_counts[~found]])
    keys = np.ascontiguousarray(np.concatenate([digests, words])).view("V32").ravel()
    return pa.table([pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(ids, mask=nulls), pa.array(uids), pa.array(counts), pa.array(np.arange(len(ids)) < len(digests))], names=["digest", "keep_id", "keep_uid", "n", "member"])


def digested(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The rows of docs, written once: doc_id, digest, a number of its own for each row (uid), and the columns `keep` as
    the struct `whole`, so that no name of theirs can clash."""
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)]) if keep else F.lit(None).cast("boolean")
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("uid"), whole.alias("whole")), "digested")


def winners(rows: DataFrame) -> DataFrame:
    """(digest, id, uid, n): the locator of the row that stays of each distinct digest, and how many rows have it."""
    groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "uid")).alias("w"), F.count("*").alias("n"))
    return groups.select("digest", F.col("w.doc_id").alias("id"), F.col("w.uid").alias("uid"), "n")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def build_index(distinct: DataFrame, buckets: int) -> DataFrame:
    """The index of distinct digests (digest, id, uid, n), one row a bucket, written to the shared folder."""
    return written(distinct.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(_built, INDEX), "digest-index")


def look_up(asked: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """The groups of history and of the asked rows (distinct digests: digest, id, uid, n) together: digest, keep_id,
    keep_uid, n, and member (is the digest in the index)."""
    left = asked.withColumn("bucket", _bucket(buckets)).groupBy("bucket")
    return left.cogroup(index.groupBy("bucket")).applyInArrow(_probed, GROUPS)


def grouped(rows: DataFrame, is_history, bucket_size: int = BUCKET) -> DataFrame:
    """The groups of digested rows: those where is_history holds are indexed, the others ask."""
    history, asked = written(winners(rows.where(is_history)), "history"), written(winners(rows.where(~is_history)), "asked")
    buckets = max(1, math.ceil(max(history.count(), asked.count()) / bucket_size))
    return look_up(asked, build_index(history, buckets), buckets)


def resolve(rows: DataFrame, bucket_size: int = BUCKET, middle: int | None = None) -> DataFrame:
    """Digested rows with keep_id, group_size and kept. History are the rows up to the middle doc_id (about the median
    unless given), the rest and null ids arrive later; the result is the same for any middle. Rows alone in their group
    need no partner, so only groups of copies are joined; the join can split a group of any size."""
    if middle is None:
        middle = rows.agg(F.percentile_approx("doc_id", 0.5, 1000)).first()[0]
    past = F.coalesce(F.col("doc_id") <= F.lit(middle if middle is not None else 0), F.lit(False))
    groups = written(grouped(rows, past, bucket_size).where("n > 1").select(F.col("digest").alias("_digest"), "keep_id", "keep_uid", "n"), "copies")
    out = rows.join(groups, rows["digest"] == groups["_digest"], "left")
    alone = F.col("_digest").isNull()
    return out.select(
        "whole", "doc_id", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
    )


def drop_copies(docs: DataFrame, bucket_size: int = BUCKET) -> DataFrame:
    """docs without the rows whose text a row that stays has too; all columns, of any name."""
    left = resolve(digested(docs, docs.columns), bucket_size).where("kept")
    return left.select(*[F.col("whole")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)])


def drop_known(docs: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """The groups of docs (digest, keep_id, n) whose text no row of an existing index has: what a new delivery adds to
    history. The index is read only; build_index over both sides' winners makes the next one."""
    groups = look_up(winners(digested(docs, [])), index, buckets)
    return groups.where("not member").select("digest", "keep_id", "n")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(digested(table(spark, sf_dir, "documents").select("doc_id", "text"), []))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = """
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  row_number() OVER g = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
