"""Exact top-k search: exhaustive term-at-a-time accumulation over blocks, partition selection and merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .base import table, written

#: Rows of a candidate block and of a query block: what one task holds at once is one score array of both.
CANDIDATES, QUERIES = 4096, 512
SCALE = 64
_LONG = 2**63 - 1


def quantise(vector: list) -> list[int] | None:
    """floor(64 * x) of every component as a whole number; None if the vector is null or has a null or non-finite one."""
    import math

    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(SCALE * float(x)) for x in vector]


def _packed(rows: int):
    """Packs (uid, id, embedding) rows into blocks: ids, lengths and whole numbers as bytes. wide: beyond 32 bits,
    numbers are kept as text."""

    def pack(uid, ids, vectors):
        lens = np.array([len(v) for v in vectors], np.int32)
        flat = [x for v in vectors for x in v]
        wide = any(abs(x) >= 2**31 for x in flat)
        data = ",".join(map(str, flat)).encode() if wide else np.array(flat, np.int32).tobytes()
        return np.array(uid, np.int64).tobytes(), np.array(ids, np.int64).tobytes(), lens.tobytes(), data, wide

    def run(batches):
        uid, ids, vectors, seq = [], [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(pack(uid, ids, vectors), (pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()))], names=["uids", "ids", "lens", "vals", "wide"])

        for batch in batches:
            for u, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                q = quantise(v)
                if q is None or i is None:
                    continue
                uid.append(u), ids.append(i), vectors.append(q)
                if len(ids) == rows:
                    yield out()
                    uid, ids, vectors = [], [], []
        if ids:
            yield out()

    return run


BLOCK = "uids binary, ids binary, lens binary, vals binary, wide boolean"


def _open(uids: bytes, ids: bytes, lens: bytes, vals: bytes, wide: bool) -> tuple:
    """uids, ids and the block as a dense array (object if wide), rows in the order of ids."""
    uids, ids, lens = np.frombuffer(uids, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int32)
    flat = np.array([int(x) for x in vals.split(b",") if x], object) if wide else np.frombuffer(vals, np.int32)
    m = np.zeros((len(ids), int(lens.max(initial=0))), object if wide else np.int64)
    if len(flat):
        m[np.repeat(np.arange(len(ids)), lens), np.concatenate([np.arange(n) for n in lens])] = flat
    order = np.lexsort((uids, ids))
    return uids[order], ids[order], m[order]


def accumulate(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of every query row with every candidate row, term by term: a term's query weights meet its postings."""
    terms = min(q.shape[1], c.shape[1])
    if q.dtype == object or c.dtype == object:
        kind = object
    else:
        bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(terms, 1)
        kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**62 else object
    q, c = q.astype(kind), np.ascontiguousarray(c.T).astype(kind)
    scores = np.zeros((len(q), c.shape[1]), kind)
    product = np.empty_like(scores)
    for t in range(terms):
        rows, postings = np.flatnonzero(q[:, t]), np.flatnonzero(c[t])
        if 2 * len(rows) * len(postings) > scores.size:  # mostly filled: zeros add nothing
            np.multiply(q[:, t, None], c[t], out=product)
            scores += product
        elif len(rows) and len(postings):
            scores[np.ix_(rows, postings)] += q[rows, t, None] * c[t, postings]
    return scores


def select(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores of each row, ties to smaller columns; own[i] is a column left out or -1."""
    n = scores.shape[1]
    if scores.dtype == object or float(np.abs(scores.astype(np.float64)).max(initial=0)) * n >= 2**61:
        rows, cols = [], []
        for i, s in enumerate(scores):
            best = sorted((j for j in range(n) if j != own[i]), key=lambda j: (-s[j], j))[:k]
            rows += [i] * len(best)
            cols += best
        return np.array(rows, np.int64), np.array(cols, np.int64)
    key = scores.astype(np.int64) * n - np.arange(n)  # one number a column, smaller for later ones
    lowest = np.iinfo(np.int64).min
    at = np.flatnonzero(own >= 0)
    key[at, own[at]] = lowest
    best = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), key.shape)
    rows = np.repeat(np.arange(len(key)), best.shape[1])
    cols = best.ravel()
    kept = key[rows, cols] != lowest
    return rows[kept], cols[kept]


def top_k(vectors: DataFrame, query: F.Column = None, k: int = 20) -> DataFrame:
    """For each row of vectors (vec_id, embedding) that `query` holds for: query_id, rank (from 1), vec_id, score.

    Candidates are all rows but the query's own row; scores are inner products of whole numbers (components missing in
    a shorter vector count as zero; beyond 64 bits a score stops at the largest long), ties go to the smaller vec_id. Vectors that are null or hold
    null or non-finite components, and rows without vec_id, take no part. A repeated row is a candidate, and a query, of
    its own. Every query block meets every candidate block once; each meeting gives at most k rows a query.
    """
    query = F.col("vec_id") % 20 == 0 if query is None else query
    # written once: a row has one number in both tables, whatever is computed again
    base = written(vectors.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "vectors")
    c = written(base.mapInArrow(_packed(CANDIDATES), BLOCK), "candidates")
    q = written(base.where(query).mapInArrow(_packed(QUERIES), BLOCK), "queries")
    spark = vectors.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    c = c.repartition(max(1, min(tasks, c.count())))
    q = q.select(*[F.col(x).alias(f"q_{x}") for x in q.columns])

    def search(batches):
        last, opened = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {x: batch.column(x)[i].as_py() for x in batch.schema.names}
                if last != row["uids"]:
                    last, opened = row["uids"], _open(*(row[x] for x in ("uids", "ids", "lens", "vals", "wide")))
                uids, ids, m = opened
                q_uids, q_ids, qm = _open(*(row[f"q_{x}"] for x in ("uids", "ids", "lens", "vals", "wide")))
                column = {u: j for j, u in enumerate(uids.tolist())}
                own = np.array([column.get(u, -1) for u in q_uids.tolist()], np.int64)
                scores = accumulate(qm, m)
                r, at = select(scores, own, k)
                s = [max(-_LONG - 1, min(_LONG, int(x))) for x in scores[r, at]]
                yield pa.RecordBatch.from_arrays([pa.array(q_uids[r]), pa.array(q_ids[r]), pa.array(ids[at]), pa.array(s, pa.int64()), pa.array(uids[at])], names=["q_uid", "query_id", "vec_id", "score", "uid"])

    # a Cartesian product by tasks: nothing is broadcast, and a query block is read where it is needed, not written for each meeting
    found = c.hint("shuffle_replicate_nl").crossJoin(q).mapInArrow(search, "q_uid long, query_id long, vec_id long, score long, uid long")
    order = Window.partitionBy("q_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
