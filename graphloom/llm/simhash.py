"""SimHash near-dedup: fingerprints, pigeonhole blocks, a join on blocks, and a check of the Hamming distance."""

from __future__ import annotations

import gc
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import LOWER, UPPER, beside, checkpoint, table, written
from .components import components
from .rows import SIDE_BYTES, mixed, slices, small

SHINGLE = 5
SEED = 42
BITS = 64
DISTANCE = 3
#: Rows of one cell at most (about): larger groups of one block are compared part against part.
CELL = 4000
#: Sets of at most so many shingles also meet by their lowest hashes.
SMALL = 40
#: Chance that a pair of sets at the least similarity meets nowhere.
MISS = 5e-4
#: Hashes of sets that a part of a loose component holds (a set counts as a thousandth of it at least).
PART = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number: bit b is 1 if it is set in over half of the hashes of the word shingles.

    Words part at ASCII white space, A-Z are lower-cased, repeats count. Fewer words than a shingle: the whole sequence
    is one. Null, empty and blank texts have no shingle and get 0.
    """
    return int(wide_simhash(text, shingle, 1, seed)[0])


def _shingle_hashes(text: str | None, shingle: int, seed: int):
    """Hashes of the word shingles, in parts of bounded size."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= shingle:
        yield np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
        return
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    start, end, h = start[: len(words) - shingle + 1], end[shingle - 1 :], xxhash.xxh64_intdigest
    for k in range(0, len(start), 1 << 15):
        yield np.array([h(joined[a:b], seed) for a, b in zip(start[k : k + (1 << 15)].tolist(), end[k : k + (1 << 15)].tolist())], np.uint64)


def wide_simhash(text: str | None, shingle: int = SHINGLE, words: int = 4, seed: int = SEED) -> np.ndarray:
    """A fingerprint of 64 * words bits: the first 64 are simhash(), the others come from remixed shingle hashes."""
    return _folded(_shingle_hashes(text, shingle, seed), words)


def _remixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes that the bits 64 * k to 64 * k + 63 of a wide fingerprint come from."""
    if not k:
        return h
    x = (h ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _folded(parts, words: int) -> np.ndarray:
    ones, n = np.zeros(64 * words, np.int64), 0
    for h in parts:
        n += len(h)
        for k in range(words):
            x = _remixed(h, k)
            ones[64 * k : 64 * k + 64] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of the words of data, in order. Eight bytes of all words are mixed in at once; the few words
    of more than LONG_WORD bytes are hashed one by one."""
    import xxhash

    held = np.frombuffer(b" " + data + b" " * 8, np.uint8)
    space = _SPACE[held]
    flips = np.flatnonzero(space[1:] != space[:-1])  # in data the byte after
    start, end = flips[::2], flips[1::2]
    size = end - start
    eight = np.ndarray(len(held) - 8, np.uint64, held, 1, (1,))
    h, at = mixed(size.astype(np.uint64) * _BASE), np.arange(len(start))
    for k in range(0, LONG_WORD, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        rest = np.minimum(size[at] - k, 8).astype(np.uint64)
        code = eight[start[at] + k] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * rest))
        h[at] = mixed(mixed(h[at] ^ code) * _BASE)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]], SEED)
    return start, h


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the distinct hashes of the word shingles, ascending, made of the hashes of their words; empty for
    null, empty and blank texts. Words and short texts as in simhash()."""
    held = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    start, w = word_hashes(b" ".join(held).translate(_LOWER))
    first = np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in held])).tolist()

    def of(w, n):
        h = np.zeros(max(0, len(w) - n + 1), np.uint64)
        for k in range(n):
            h = mixed(h * _BASE + w[k : k + len(h)])
        return h

    every, out = of(w, shingle), []
    for a, b in zip(first, first[1:]):
        h = np.sort(every[a : b - shingle + 1] if b - a >= shingle else of(w[a:b], b - a)[: b - a])
        out.append(h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) > 1 else h)
    return out


def set_fingerprints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """The wide fingerprint of each set of hashes, a row of `words` unsigned numbers: as _folded, all sets together.

    Eight bits of a number are counted at once in its eight bytes, for at most 255 hashes, then bytes are added up."""
    out = np.zeros((len(sets), words), np.uint64)
    for i in (i for i, h in enumerate(sets) if len(h) > 1 << 15):
        out[i] = _folded([sets[i][k : k + (1 << 15)] for k in range(0, len(sets[i]), 1 << 15)], words)
    at = [i for i, h in enumerate(sets) if 0 < len(h) <= 1 << 15]
    if not at:
        return out
    size = np.array([len(sets[i]) for i in at])
    h, pieces = np.concatenate([sets[i] for i in at]), -(-size // 255)
    first = np.cumsum(pieces) - pieces
    start = np.repeat(np.cumsum(size) - size - 255 * first, pieces) + 255 * np.arange(pieces.sum())
    ones = np.empty((len(at), words, 8, 8), np.int64)
    for k in range(words):
        x = _remixed(h, k)
        for b in range(8):
            lanes = np.add.reduceat(x >> np.uint64(b) & np.uint64(0x0101010101010101), start)
            ones[:, k, :, b] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    out[at] = np.packbits(2 * ones.reshape(len(at), -1) > size[:, None], axis=1, bitorder="little").view(np.uint64)
    return out


def fingerprints(df: DataFrame, shingle: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp: the fingerprint's 64 bits as a signed long) for every row. Narrow, whole texts."""

    def run(batches):
        for batch in batches:
            fp = np.fromiter((simhash(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_column)


def block_masks(distance: int = DISTANCE, blocks: int | None = None) -> list[int]:
    """Masks of kept bits: of `blocks` blocks any `distance` may differ, so the others agree in at least one choice."""
    blocks = blocks or 2 * distance
    cut = [BITS * k // blocks for k in range(blocks + 1)]
    of = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:])]
    return [sum(of[i] for i in keep) for keep in combinations(range(blocks), blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(key: np.ndarray, bits: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (row of the root, row of the member) that connect, within each run of equal keys, fingerprints (rows
    of unsigned words) at the row's distance or less."""
    n = len(key)
    label, at = np.arange(n), np.arange(n)
    a, b, held = [], [], 0

    def join() -> None:
        if not a:
            return
        i, j = np.concatenate(a), np.concatenate(b)
        a.clear(), b.clear()
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            for x in (label[i], label[j], i, j):
                np.minimum.at(label, x, low)
            while not np.array_equal(jumped := label[label], label):
                label[:] = jumped
            if np.array_equal(before, label):
                return

    d = 0
    while len(at):
        d += 1
        at = at[at + d < n]
        at = at[key[at] == key[at + d]]
        near = at[np.bitwise_count(bits[at] ^ bits[at + d]).sum(axis=1) <= distance[at]]
        if len(near):
            a.append(near), b.append(near + d)
            held += len(near)
            if held > 1_000_000:
                join()
                held = 0
    join()
    member = np.flatnonzero(label != np.arange(n))
    return label[member], member


def links(distinct: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that connect just those that chains of near pairs connect.

    Each fingerprint gets one row for each choice of blocks. Rows that agree on the kept bits meet and are compared; of
    the near pairs of one meeting only a spanning star is passed on, never all pairs. A meeting of more than `cell`
    rows is dealt out: its rows fall into parts by hash and each two parts meet in a cell of their own.
    """
    masks = block_masks(distance)
    keys = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])).alias("choice", "kept"))
    key = F.xxhash64("choice", "kept").bitwiseAND(F.lit((1 << 63) - 1))
    return _dealt_meet(keys.select(key.alias("key"), F.col("fp").alias("node"), F.col("fp").alias("w0")), 1, distance, cell)


def _meet(keys: DataFrame, words: int, distance: int, cell: int | None = None) -> DataFrame:
    """Edges (u, v) of keys (key, node, w0, w1, ...): of the rows with one key a star for each set of near ones.

    Keys of more than `cell` rows aren't compared: their rows come back as they are, with a null v, to be dealt out.
    Rows with a negative key may differ in half as many bits again."""
    names = ["key", "node", *(f"w{k}" for k in range(words))]
    out = ["u", "v", "key", *names[2:]]

    def edges(rows):
        # bitwise_count takes the absolute value of signed numbers
        bits = np.ascontiguousarray(rows[2:].T).view(np.uint64)
        u, v = _forest(rows[0], bits, np.where(rows[0] < 0, distance * 3 // 2, distance))
        return pa.RecordBatch.from_arrays([pa.array(rows[1, u]), pa.array(rows[1, v]), *(pa.nulls(len(u), pa.int64()) for _ in out[2:])], names=out)

    def passed(rows):
        return pa.RecordBatch.from_arrays([pa.array(rows[1]), pa.nulls(rows.shape[1], pa.int64()), pa.array(rows[0]), *map(pa.array, rows[2:])], names=out)

    def judged(rows):
        first = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
        count = np.diff(np.append(first, rows.shape[1]))
        count = np.repeat(count, count)
        if cell and (count > cell).any():
            yield passed(rows[:, count > cell])
        small = (count > 1) & (count <= cell) if cell else count > 1  # lone keys can't link
        if small.any():
            yield edges(rows[:, small])

    def run(batches):
        held, large = np.empty((len(names), 0), np.int64), None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            if large is not None and rows.shape[1]:
                at = np.searchsorted(rows[0], large, "right")
                if at:
                    yield passed(rows[:, :at])
                rows = rows[:, at:]
            held = np.concatenate((held, rows), axis=1)
            if held.shape[1]:
                whole = np.searchsorted(held[0], held[0, -1])
                if whole:
                    yield from judged(held[:, :whole])
                    held = held[:, whole:]
                if cell and held.shape[1] > cell:
                    large = held[0, 0]
                    yield passed(held)
                    held = held[:, :0]
        if held.shape[1]:
            yield from judged(held)

    return keys.select(*names).repartition("key").sortWithinPartitions("key").mapInArrow(run, ", ".join(f"{c} long" for c in out))


def _dealt_meet(keys: DataFrame, words: int, distance: int, cell: int) -> DataFrame:
    """Edges (u, v) as of _meet for keys of any size: rows of a key of more than `cell` rows fall into parts by hash, and
    each two parts meet in a cell of their own."""
    met = written(_meet(keys, words, distance, cell), "met")
    edges, large = met.where("v IS NOT NULL").select("u", "v"), met.where("v IS NULL").select("key", F.col("u").alias("node"), *(f"w{k}" for k in range(words)))
    sizes = checkpoint(large.groupBy("key").count().select(F.col("key").alias("_k"), F.ceil(F.col("count") * 2 / cell).cast("int").alias("parts")))
    if not sizes.isEmpty():
        cells = _cells(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.col("parts"))
        large = large.join(sizes, F.col("key") == F.col("_k")).withColumn("cell", F.explode(cells))
        # the sign of a key stays: it tells the distance
        key = F.when(F.col("key") < 0, F.xxhash64("key", "cell").bitwiseOR(F.lit(-(1 << 63)).cast("long"))).otherwise(F.xxhash64("key", "cell").bitwiseAND(F.lit((1 << 63) - 1)))
        edges = edges.unionByName(_meet(large.withColumn("key", key), words, distance).select("u", "v"))
    return edges


def _cells(part: Column, parts: Column) -> Column:
    """Numbers of the cells in which a part meets each part, itself included."""
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.least(k, part).cast("long") * 1_000_000_000 + F.greatest(k, part))


def near_duplicates(df: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row for each row of df: doc_id, fp (signed long) and component_id, the smallest doc_id that chains of
    fingerprints at Hamming distance `distance` or less reach, itself included.

    Rows with one fingerprint (exact copies, repeated rows, all texts without words) are one node, so a group of copies
    costs no pairs. A null doc_id never is a component_id unless all of its component are null. Empty table: no rows.
    """
    fps = written(fingerprints(df, shingle), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(checkpoint(links(distinct.select("fp"), distance)))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = checkpoint(named.groupBy("root").agg(F.min("rep").alias("component_id")))  # so that the join can split a large component
    classes = named.join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(classes, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def meeting_plan(n: int, least: float, miss: float = MISS, rows: int = 8) -> tuple[int, int]:
    """(bits a key, keys) for n fingerprints: about `rows` unrelated ones share a key at any n, and a pair whose sets
    have a Jaccard of `least` misses every key with a chance of `miss`.

    SimHash bits of two sets differ with the angle between them; the work grows as n to the power 1.2."""
    differ = math.acos(2 * least / (1 + least)) / math.pi
    bits = max(12, round(math.log2(max(n, 1) / rows)))
    return bits, math.ceil(math.log(miss) / math.log1p(-((1 - differ) ** bits)))


def similar_documents(df: DataFrame, shingle: int = SHINGLE, least: float = 0.8, words: int = 4, compared: int = 2, distance: int = 36, miss: float = MISS, part: int = PART) -> DataFrame:
    """As near_duplicates, for pairs of a shingle similarity (Jaccard of the shingle sets) of `least` or more: doc_id and
    component_id.

    SimHash only groups; what links is the similarity itself, counted on whole sets. Fingerprints of 64 * words bits are
    made of the sets (repeats don't count); they meet where they agree in a key of blocks of bits (meeting_plan), and
    are loosely linked, by a star a key, if the first 64 * compared bits differ in `distance` at most: by far more than
    similar sets do (at 0.8 15 % differ, 36 of 128 lie four standard deviations higher). Sets of at most SMALL shingles
    also meet by their lowest hashes, of which two similar ones share one for certain. Then the sets of each loose
    component meet, and every pair in it that is not yet joined is counted exactly; only stars leave the task. A
    component of over `part` hashes is dealt out: each two of its parts meet in a cell of their own.

    Rows with one set of shingles are one node; texts without words are one node. Null texts have no words. Repeated
    rows and rows of one doc_id are compared each by its own text. Empty table: no rows. Very long texts are one set
    each, in one cell's memory at eight bytes a word.
    """
    kind = df.schema["doc_id"].dataType.simpleString()
    cols = [f"w{k}" for k in range(words)]
    sent = cols[:compared]

    def mark(batches):
        import xxhash

        for batch in slices(batches):
            out, first = np.zeros((3 + words, batch.num_rows), np.uint64), []
            found = shingle_sets(batch.column(2).to_pylist(), shingle)
            out[3:] = set_fingerprints(found, words).T
            for i, h in enumerate(found):
                first.append(h[: len(h) - math.ceil(least * len(h) - 1e-9) + 1].view(np.int64) if 0 < len(h) <= SMALL else [])
                if len(h):
                    out[:2, i] = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.uint64)
                    out[2, i] = len(h)
            arrays = [*map(pa.array, out.view(np.int64)), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "t", "s0", "s1", "size", *cols, "first"])

    texts = df.select("doc_id", F.xxhash64("text").alias("t"), "text")
    fps = written(texts.mapInArrow(mark, f"doc_id {kind}, t long, s0 long, s1 long, size long, " + ", ".join(f"{c} long" for c in cols) + ", first array<long>"), "fingerprints")
    rep = F.min(F.struct("doc_id", "t"))
    distinct = fps.groupBy("s0", "s1", "size", *cols).agg(rep.alias("one"), F.first("first").alias("first"), F.min("doc_id").alias("rep"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "shingle-sets")
    nodes = distinct.where("size > 0")  # texts without words are one node
    key_bits, keys = meeting_plan(nodes.count(), least, miss)
    draw = np.random.default_rng(2)
    choice = [np.sort(draw.permutation(64 * words)[:key_bits]) for _ in range(keys)]

    def meet(batches):
        for batch in batches:
            rows = [batch.column(c) for c in ("node", *sent)]
            bits = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols], axis=1)
            bits = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").astype(np.int64)
            for k, at in enumerate(choice):
                key = (bits[:, at] << np.arange(key_bits)).sum(axis=1) | (k << key_bits)
                yield pa.RecordBatch.from_arrays([pa.array(key), *rows], names=["key", "node", *sent])

    met = nodes.select("node", *cols).mapInArrow(meet, ", ".join(f"{c} long" for c in ("key", "node", *sent)))
    lowest = nodes.select(F.explode("first").alias("key"), "node", *sent).withColumn("key", F.col("key").bitwiseOR(F.lit(-(1 << 63)).cast("long")))
    loose = components(checkpoint(_dealt_meet(met.unionByName(lowest), compared, distance, CELL).distinct()))
    _release(df.sparkSession)
    roots = components(checkpoint(_similar(loose, nodes, df, shingle, least, part)))

    named = distinct.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("s0", "s1", "rep", F.coalesce("root", "node").alias("root"))
    smallest = checkpoint(named.groupBy("root").agg(F.min("rep").alias("component_id")))  # so that the join can split a large component
    classes = named.join(smallest, "root").select(F.col("s0").alias("_s0"), F.col("s1").alias("_s1"), "component_id")
    return fps.join(classes, (F.col("s0") == F.col("_s0")) & (F.col("s1") == F.col("_s1"))).select("doc_id", "component_id")


def _release(spark: SparkSession) -> None:
    """Has the driver collect what no plan refers to, so that Spark deletes the shuffles and checkpoints behind it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def alike(sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Edges (i, j) that connect just those of the sets (distinct hashes each) that chains of pairs with a Jaccard of
    `least` or more connect. Pairs already joined aren't counted."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    end = np.cumsum(size)
    begin = end - size
    distinct, member = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label, a, b = np.zeros(len(distinct), bool), np.arange(n), [], []
    for i in range(n - 1):
        fit = np.minimum(size[i], size[i + 1 :]) >= (least - 1e-9) * np.maximum(size[i], size[i + 1 :])
        at = i + 1 + np.flatnonzero(fit & (label[i + 1 :] != label[i]))
        if not len(at):
            continue
        own = member[begin[i] : end[i]]
        mark[own] = True
        hit = mark[np.concatenate([member[begin[j] : end[j]] for j in at])]
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[at]) - size[at])
        mark[own] = False
        for j in at[both >= (least - 1e-9) * (size[i] + size[at] - both)].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                a.append(i), b.append(j)
    return a, b


def _similar(loose: DataFrame, nodes: DataFrame, df: DataFrame, shingle: int, least: float, part: int) -> DataFrame:
    """Edges (u, v) between the nodes of each component of loose (node, root) whose sets are alike, by whole sets, which
    are made anew from the texts of the nodes' representatives."""
    of = loose.withColumnRenamed("node", "_node")
    need = nodes.join(of, F.col("node") == F.col("_node")).select("node", "root", F.greatest("size", F.lit(part // 1000)).alias("weight"), "one.*")
    need = written(need, "loose")
    large = need.groupBy("root").agg(F.sum("weight").alias("whole")).where(F.col("whole") > part).select(F.col("root").alias("_root"), F.ceil(F.col("whole") / part).cast("int").alias("parts"))
    need = need.join(checkpoint(large), F.col("root") == F.col("_root"), "left")
    number = F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(_cells(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.col("parts")))
    cells = F.transform(number, lambda c: F.xxhash64("root", c))
    need = written(need.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "node", cells.alias("cells")), "cells")

    def sets(batches):
        for batch in slices(batches):
            found = shingle_sets(batch.column(0).to_pylist(), shingle)
            for h, node, cells in zip(found, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array([node] * len(cells), pa.int64()), pa.array([h.tobytes()] * len(cells), pa.binary())], names=["cell", "node", "hashes"])

    def judged(batches):
        last, held = None, {}

        def out():
            ids = list(held)
            u, v = alike([np.frombuffer(x, np.uint64) for x in held.values()], least)
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in u], pa.int64()), pa.array([ids[j] for j in v], pa.int64())], names=["u", "v"])

        for batch in batches:
            for cell, node, found in zip(*(batch.column(k) for k in range(3))):
                cell = cell.as_py()
                if cell != last and len(held) > 1:
                    yield out()
                if cell != last:
                    last, held = cell, {}
                held[node.as_py()] = found.as_py()  # a repeated row of one doc_id gives its set once more
        if len(held) > 1:
            yield out()

    own = df.select("doc_id", F.xxhash64("text").alias("t"), "text")
    on = own["doc_id"].eqNullSafe(need["_id"]) & (own["t"] == need["_t"])
    texts = own.join(F.broadcast(need) if small(need, SIDE_BYTES) else need, on).select("text", "node", "cells")
    made = texts.mapInArrow(sets, "cell long, node long, hashes binary")
    return made.repartition("cell").sortWithinPartitions("cell").mapInArrow(judged, "u long, v long")


def keep_one(df: DataFrame, **how) -> DataFrame:
    """df, all columns whatever their names, with the document of the smallest doc_id of each component of
    similar_documents (of rows that repeat a doc_id, all that are that document stay)."""
    found = similar_documents(df, **how).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return beside(df, found.select(F.col("doc_id").alias("id")), lambda left, right: left["id"].eqNullSafe(right["id"]), "left_semi", id=F.col("doc_id"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
