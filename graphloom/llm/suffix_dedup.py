"""Suffix-array dedup by bytes: shard Burrows-Wheeler transforms, merged by interleave refinement, give the repeats."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import checkpoint, table, written
from .bwt import repeated
from .rows import attach, copies, doubled, hash_filter, keyed, mixed, passes, slices

LENGTH = 200
#: Bytes of the grams that route windows: every window goes where the smallest gram hash in it says.
GRAM = 32
BASE = 0x9E3779B97F4A7C15
#: Windows taken at once from a long text, and at most in one segment.
BLOCK, SEGMENT = 1 << 20, 1 << 14
#: Bytes of short texts that are hashed together.
PACK = 1 << 16
#: Bytes of a shard, and of segments (whole groups) whose shards are merged together.
SHARD, BATCH = 1 << 16, 1 << 19
#: Bytes of a group's segments. A larger group is split by more of its windows' smallest grams.
GROUP = 1 << 20


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = f(x[: len(x) - span], x[span:])
        span *= 2
    return f(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    return mixed(doubled(data.astype(np.uint64) + np.uint64(1), gram, BASE))


def minima(h: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The smallest gram hash of each window; equal windows have equal ones."""
    return _slide(h, length - gram + 1, np.minimum)


def _blocks(text: bytes, length: int):
    """(first window, data) of blocks of BLOCK windows that together hold every window once."""
    n = len(text) - length + 1
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(n, 0), BLOCK):
        yield at, data[at : at + min(BLOCK, n - at) + length - 1]


def _stretches(texts: list[bytes], length: int):
    """([(number of the text, its first window here, where that is in data, windows)], data): texts of up to PACK bytes
    together, as many as go into that, longer ones in blocks. Texts without a window are left out."""
    held, size = [], 0

    def out():
        return held, np.frombuffer(b"".join(texts[i] for i, *_ in held), np.uint8)

    for i, text in enumerate(texts):
        n = len(text) - length + 1
        if held and size + len(text) > PACK and n > 0:
            yield out()
            held, size = [], 0
        if len(text) > PACK:
            for at, data in _blocks(text, length):
                yield [(i, at, 0, len(data) - length + 1)], data
        elif n > 0:
            held.append((i, 0, size, n))
            size += len(text)
    if held:
        yield out()


def chosen_grams(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, numbers of their texts) of the grams that are smallest in some window, once for each place."""
    out, of = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for parts, data in _stretches(texts, length):
        h = gram_hashes(data, gram)
        edge = np.zeros(length - gram, np.uint64)
        low = np.concatenate((edge, minima(h, length, gram), edge))
        for _, _, at, n in parts:
            low[len(edge) + at + n : len(edge) + at + n + length - 1] = 0  # these reach into the next text
        chosen = np.flatnonzero(_slide(low, length - gram + 1, np.maximum) == h)
        out.append(h[chosen])
        of.append(np.array([p[0] for p in parts])[np.searchsorted([p[2] for p in parts], chosen, "right") - 1])
    return np.concatenate(out).view(np.int64), np.concatenate(of)


def segments(texts: list[bytes], length: int, gram: int, held: np.ndarray):
    """(number of the text, gram hash, first window, windows) of maximal runs of windows of a text with one smallest gram, if
    that passes held."""
    for parts, data in _stretches(texts, length):
        low = minima(gram_hashes(data, gram), length, gram).view(np.int64)
        cuts = [1 + np.flatnonzero(low[1:] != low[:-1])]
        valid = np.zeros(len(low) + 1, bool)
        for _, _, at, n in parts:
            cuts += [np.arange(at, at + n, SEGMENT), [at + n]]
            valid[at : at + n] = True
        cut = np.unique(np.concatenate(cuts))
        ok = valid[cut[:-1]]
        ok[ok] = passes(low[cut[:-1][ok]], held)
        start, end = cut[:-1][ok], cut[1:][ok]
        part = np.searchsorted([p[2] for p in parts], start, "right") - 1
        for k, m, s, n in zip(part.tolist(), low[start].tolist(), start.tolist(), (end - start).tolist()):
            i, first, at, _ = parts[k]
            yield i, m, first + s - at, n


def narrower(piece: bytes, length: int, gram: int, grams: int):
    """(key, first window, windows) of maximal runs of windows whose `grams` smallest grams are the same. Equal windows
    have equal ones, so what is equal still meets."""
    h = gram_hashes(np.frombuffer(piece, np.uint8), gram)
    width = length - gram + 1
    grams = min(grams, width)
    views = np.lib.stride_tricks.sliding_window_view(h, width)
    key = np.empty(len(views), np.uint64)
    powers = np.cumprod(np.full(grams, BASE, np.uint64))
    for k in range(0, len(views), 4096):
        low = np.sort(views[k : k + 4096], axis=1)[:, :grams]
        key[k : k + 4096] = mixed((low * powers).sum(axis=1))
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    yield from zip(key[cut].view(np.int64).tolist(), cut.tolist(), (np.append(cut[1:], len(key)) - cut).tolist())


def _shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _reach(sides: list[bytes]) -> list[int]:
    """For each string its longest common prefix with any other: with a neighbour in sorted order."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out, before = [0] * len(sides), 0
    for x, y in zip(order, order[1:]):
        common = _shared_prefix(sides[x], sides[y])
        out[x] = max(before, common)
        before = common
    if order:
        out[order[-1]] = before
    return out


def gram_places(groups: list[tuple[int, list[bytes]]], gram: int) -> list[list[np.ndarray]]:
    """Of each group (gram hash m, pieces) the places of m in every piece."""
    pieces = [p for _, held in groups for p in held]
    if not pieces:
        return []
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    end = np.cumsum(size)
    wanted = np.repeat(np.repeat(np.array([m for m, _ in groups], np.int64), [len(held) for _, held in groups]), size)
    at = np.flatnonzero(gram_hashes(np.frombuffer(b"".join(pieces), np.uint8), gram).view(np.int64) == wanted[: end[-1] - gram + 1])
    of = np.searchsorted(end, at, "right")
    whole = at + gram <= end[of]  # else it reaches into the next piece
    at, of = (at - (end - size)[of])[whole], of[whole]
    found = iter(np.split(at, np.searchsorted(of, np.arange(1, len(pieces)))))
    return [[next(found) for _ in held] for _, held in groups]


def trimmed(m: int, pieces: list[bytes], times: list[int], length: int, gram: int, found: list[np.ndarray] | None = None):
    """What of one gram's different segments can hold repeats: (string, times, [(piece, window offset)]). found: the
    gram's places in every piece, if known.

    Where every segment holds the gram once, a repeated window reaches no further left and right of it than the segment
    agrees with another one; what lies beyond is cut off, and strings that are equal then go on as one that weighs as
    much as they do together. Nothing is decided here: that is the merge's."""
    places = []
    for at in found or gram_places([(m, pieces)], gram)[0]:
        if len(at) != 1:
            return [(p, t, [(i, 0)]) for i, (p, t) in enumerate(zip(pieces, times))]
        places.append(int(at[0]))
    right = _reach([p[k:] for p, k in zip(pieces, places)])
    left = _reach([p[:k][::-1] for p, k in zip(pieces, places)])
    found: dict[bytes, list] = {}
    for i, (p, k, t) in enumerate(zip(pieces, places, times)):
        a, b = (k, len(p) - k) if t > 1 else (left[i], right[i])  # a segment with copies shares all of itself
        if a + b >= length:
            entry = found.setdefault(p[k - a : k + b], [0, []])
            entry[0] += t
            entry[1].append((i, k - a))
    return [(s, t, who) for s, (t, who) in found.items()]


def _runs(mask: np.ndarray) -> np.ndarray:
    """(start, end) pairs of the true runs, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge.astype(np.int32)


def _pieces(batches, cut):
    """Segments as rows: of each batch every different one once with its data and how often the batch has it, and a row
    for each place of it.

    cut: batch -> (doc_id, _row, weight, group, first window of the row, the segment's bytes)."""
    import xxhash

    for batch in batches:
        types = [pa.int64(), pa.int64(), pa.int64(), batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        rows: list[list] = [[] for _ in PIECE]
        count: Counter = Counter()
        data: dict = {}
        size = 0

        def out():
            for key, n in count.items():
                for column, x in zip(rows, (*key, None, None, None, n, data[key])):
                    column.append(x)
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names=PIECE)
            for column in rows:
                column.clear()
            count.clear(), data.clear()
            return made

        for d, r, weight, m, start, piece in cut(batch):
            x = xxhash.xxh3_128_intdigest(piece)
            key = (m, (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63))
            if not count[key]:
                data[key] = piece
                size += len(piece)
            count[key] += weight
            for column, v in zip(rows, (*key, d, r, start, None, None)):
                column.append(v)
            if size > 4_000_000:
                yield out()
                size = 0
        yield out()


PIECE = ["m", "a", "b", "doc_id", "_row", "start", "n", "data"]


def repeats(docs: DataFrame, length: int, gram: int, group: int, merge_all: bool = False) -> DataFrame:
    """(doc_id, _row, spans: int32 bytes of start and end pairs) of the bytes of keyed docs (with n, the number of rows that
    each stands for) that a repeated window covers. merge_all: strings that all weigh two or more are merged as well,
    though every interval of theirs does."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"m long, a long, b long, doc_id {kind}, _row long, start int, n long, data binary"

    def encode(t):
        return (t or "").encode("utf-8", "surrogatepass")

    def grams(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found, of = chosen_grams([encode(t) for t in part.column("text").to_pylist()], length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(found), part.column("n").take(pa.array(of))], names=["h", "n"])

    counted = docs.select("text", "n").mapInArrow(grams, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    held = hash_filter(counted.where("n > 1").select("h"))

    def cut(batch):
        for part in slices([batch], 64):
            texts = [encode(t) for t in part.column("text").to_pylist()]
            d, r, n = (part.column(c).to_pylist() for c in ("doc_id", "_row", "n"))
            for i, m, s, k in segments(texts, length, gram, held.value):
                yield d[i], r[i], n[i], m, s, texts[i][s : s + k + length - 1]

    found = written(docs.mapInArrow(lambda batches: _pieces(batches, cut), schema), "segments")
    pieces = found.where("data IS NOT NULL").select("m", "a", "b", "n", "data")
    places = found.where("data IS NULL").select("m", "a", "b", "doc_id", "_row", "start")
    level = 1
    while level < length:
        level *= 2
        # every different segment counts once, however many batches have it
        sizes = pieces.groupBy("m", "a", "b").agg(F.max(F.octet_length("data")).alias("size")).groupBy("m").agg(F.sum("size").alias("size"))
        large = checkpoint(sizes.where(F.col("size") > group).select(F.col("m").alias("_m")))
        if large.isEmpty():
            break
        pieces, places = _split(pieces, places, large, length, gram, level)

    def judge(batches):
        groups, size, last = [], 0, None

        def out():
            strings, times, owner = [], [], []
            found: dict[tuple, np.ndarray] = {}

            def marked(g, who, marks):
                for i, at in who if marks.any() else ():
                    piece = groups[g][1][i]
                    mask = found.setdefault((groups[g][0], *groups[g][3][i]), np.zeros(len(piece) - length + 1, bool))
                    mask[at : at + len(marks)] |= marks

            at = gram_places([x[:2] for x in groups], gram)
            for g, (m, pieces, n, _) in enumerate(groups):
                cut = trimmed(m, pieces, n, length, gram, at[g])
                if not merge_all and all(t > 1 for _, t, _ in cut):  # every interval of theirs weighs two or more: nothing to merge
                    for s, _, who in cut:
                        marked(g, who, np.ones(len(s) - length + 1, bool))
                    continue
                for s, t, who in cut:
                    # a group of one segment that has no gram twice repeats nothing
                    if t > 1 or len(pieces) > 1 or len(np.unique(h := gram_hashes(np.frombuffer(s, np.uint8), gram))) < len(h):
                        strings.append(s), times.append(t), owner.append((g, who))
            for (g, who), marks in zip(owner, repeated(strings, times, length, SHARD) if strings else ()):
                marked(g, who, marks)
            groups.clear()
            rows = [(*key, _runs(mask).tobytes()) for key, mask in found.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)] + [pa.array([r[3] for r in rows], pa.binary())], names=["m", "a", "b", "runs"])

        for batch in batches:
            for m, a, b, n, data in zip(*(batch.column(c).to_pylist() for c in ("m", "a", "b", "n", "data"))):
                if (m, a, b) == last:
                    groups[-1][2][-1] += n
                    continue
                if last is None or m != last[0]:
                    if size > BATCH:
                        yield out()
                        size = 0
                    groups.append((m, [], [], []))
                groups[-1][1].append(data), groups[-1][2].append(n), groups[-1][3].append((a, b))
                size += len(data)
                last = (m, a, b)
        if groups:
            yield out()

    # a segment travels to its group once, however many batches have it
    once = pieces.groupBy("m", "a", "b").agg(F.sum("n").alias("n"), F.first("data").alias("data"))
    judged = once.repartition("m").sortWithinPartitions("m", "a", "b").mapInArrow(judge, "m long, a long, b long, runs binary")
    judged = checkpoint(judged.select(F.col("m").alias("_m"), F.col("a").alias("_a"), F.col("b").alias("_b"), "runs"))  # so that the join can split a segment with many places
    hits = places.join(judged, (F.col("m") == F.col("_m")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).groupBy("doc_id", "_row").agg(F.collect_set(F.struct("start", "runs")).alias("hits"))

    def spans(batches):
        for batch in batches:
            out = []
            for hits in batch.column("hits").to_pylist():
                pairs = np.concatenate([np.frombuffer(x["runs"], np.int32).reshape(-1, 2).astype(np.int64) + x["start"] for x in hits])
                pairs[:, 1] += length - 1
                pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
                reach = np.maximum.accumulate(pairs[:, 1])
                new = np.concatenate(([True], pairs[1:, 0] > reach[:-1]))
                ends = reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(pairs) - 1]))]
                out.append(np.stack((pairs[new, 0], ends), axis=1).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_row"), pa.array(out, pa.binary())], names=["doc_id", "_row", "spans"])

    return hits.mapInArrow(spans, f"doc_id {kind}, _row long, spans binary")


def _split(pieces: DataFrame, places: DataFrame, large: DataFrame, length: int, gram: int, grams: int) -> tuple[DataFrame, DataFrame]:
    """pieces and places with the groups `large` (_m) split by the `grams` smallest grams of their windows."""
    of = F.col("m") == F.col("_m")

    def narrow(batches):
        for batch in batches:
            rows = [[] for _ in range(9)]
            for m, a, b, n, data in zip(*(batch.column(c).to_pylist() for c in ("m", "a", "b", "n", "data"))):
                import xxhash

                for m2, s, k in narrower(data, length, gram, grams):
                    piece = data[s : s + k + length - 1]
                    x = xxhash.xxh3_128_intdigest(piece)
                    for column, v in zip(rows, (m2, (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63), n, piece, m, a, b, s)):
                        column.append(v)
            types = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names=["m", "a", "b", "n", "data", "_pm", "_pa", "_pb", "at"])

    once = pieces.join(large, of, "left_semi").groupBy("m", "a", "b").agg(F.sum("n").alias("n"), F.first("data").alias("data"))
    parts = written(once.mapInArrow(narrow, "m long, a long, b long, n long, data binary, _pm long, _pa long, _pb long, at int"), "parts")
    links = parts.select(*[F.col(c).alias(f"_{c}2") for c in "mab"], "_pm", "_pa", "_pb", "at")
    moved = places.join(links, (F.col("m") == F.col("_pm")) & (F.col("a") == F.col("_pa")) & (F.col("b") == F.col("_pb")))
    moved = moved.select(*[F.col(f"_{c}2").alias(c) for c in "mab"], "doc_id", "_row", (F.col("start") + F.col("at")).alias("start"))
    once = parts.groupBy("m", "a", "b").agg(F.sum("n").alias("n"), F.first("data").alias("data"))
    return (
        written(pieces.join(large, of, "left_anti").unionByName(once), "pieces"),
        written(places.join(large, of, "left_anti").unionByName(moved), "places"),
    )


def repeat_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, merge_all: bool = False) -> DataFrame:
    """For keyed docs the rows that lose bytes: (doc_id, _row, spans: int32 bytes of start and end pairs). Of exact copies
    one row is searched for all of them, and counts as often as there are copies; all get its spans."""
    same = copies(docs)
    more = checkpoint(same.where(~F.col("first")).select("doc_id", "_row"))
    often = checkpoint(same.where("first").select("doc_id", "_row", F.col("n").alias("times")))
    single = attach(attach(docs, more, "left_anti"), often).withColumn("n", F.coalesce("times", F.lit(1).cast("long"))).select("doc_id", "_row", "text", "n")
    spans = checkpoint(repeats(single, length, gram, group, merge_all))
    of = spans.select(F.col("doc_id").alias("_i"), F.col("_row").alias("_r"), "spans")
    rest = same.where(~F.col("first")).join(of, F.col("least").eqNullSafe(F.col("_i")) & (F.col("least_row") == F.col("_r")))
    return checkpoint(spans.unionByName(rest.select("doc_id", "_row", "spans")))


def _cut(text: str | None, spans: bytes | None) -> tuple[bytes, bytes, bytes]:
    """The text's bytes, the removed spans and the bytes that stay."""
    data = (text or "").encode("utf-8", "surrogatepass")
    stay, at = [], 0
    for s, e in np.frombuffer(spans or b"", np.int32).reshape(-1, 2).tolist():
        stay.append(data[at:s])
        at = e
    return data, spans or b"", b"".join([*stay, data[at:]])


def without_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, merge_all: bool = False) -> DataFrame:
    """One row for each row of documents (doc_id, text): doc_id, n_bytes, n_removed, n_spans, spans (int32 bytes of start
    and end pairs of maximal removed runs), kept_sha256, kept (the remaining bytes).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else in documents, the same row
    included; strings are those of the input and never cross rows. Null texts are empty. Repeated rows, also of one
    doc_id, are texts of their own and so repeat each other.

    Windows meet by the smallest gram in them; what only one place has never moves. The different segments of a gram
    are sorted shard by shard, and the shards' transforms merged (bwt.py): its common prefixes and the weights of its
    intervals decide. A gram with more than `group` bytes of segments is split by more of its windows' grams. Exact
    copies are found by hash, one counts for all. An empty table gives no rows; very long texts are cut in blocks.
    """
    docs = keyed(documents)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in slices(batches):
            rows = [_cut(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("text", "spans")))]
            columns = [
                (pa.int64(), [len(a) for a, _, _ in rows]), (pa.int64(), [len(a) - len(c) for a, _, c in rows]), (pa.int64(), [len(b) // 8 for _, b, _ in rows]),
                (pa.binary(), [b for _, b, _ in rows]), (pa.string(), [hashlib.sha256(c).hexdigest() for _, _, c in rows]), (pa.binary(), [c for _, _, c in rows]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for t, x in columns)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"])

    source = attach(docs, repeat_spans(docs, length, gram, group, merge_all)).select("doc_id", "text", "spans")
    return source.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans binary, kept_sha256 string, kept binary")


def drop_repeats(documents: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """documents, all columns, with repeated bytes cut from text as in without_repeats. What a cut leaves of a character
    goes too; documents of which nothing but white space is left go; n_chars, if there, follows the text. Texts that
    lose nothing, null ones included, stay as they are."""
    docs = keyed(documents)
    side = repeat_spans(docs, length, **how)
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(documents.columns)])
    rows = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"), whole.alias("_whole"))

    def cut(batches):
        for batch in slices(batches):
            left = []
            for x in zip(*(batch.column(c).to_pylist() for c in ("text", "spans"))):
                data, _, stay = _cut(*x)
                left.append(None if len(stay) == len(data) else stay.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column("_whole"), pa.array(left, pa.string())], names=["_whole", "_left"])

    kind = rows.schema["_whole"].dataType.simpleString()
    out = attach(rows, side).select("_whole", "text", "spans").mapInArrow(cut, f"_whole {kind}, _left string")
    out = out.where("_left IS NULL OR trim(_left) <> ''")
    columns = []
    for k, c in enumerate(documents.columns):
        old = F.col("_whole")[f"c{k}"]
        new = {"text": F.col("_left"), "n_chars": F.length("_left").cast(documents.schema[c].dataType)}.get(c)
        columns.append((old if new is None else F.when(F.col("_left").isNull(), old).otherwise(new)).alias(c))
    return out.select(*columns)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP3_SQL = r"""WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), blocks AS (
  SELECT r, b, substr(h, 2 * b + 1, 2 * (2048 + 199)) AS p FROM (SELECT r, h, unnest(range(0, n - 199, 2048)) AS b FROM d WHERE n >= 200)
), win AS (
  SELECT r, b + j AS i, md5(substr(p, 2 * j + 1, 400)) AS k FROM (SELECT r, b, p, unnest(range(0, least(2048, len(p) // 2 - 199))) AS j FROM blocks)
), hit AS (
  SELECT r, i FROM win JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) USING (k)
), runs AS (
  SELECT r, g, min(i) AS s, max(i) + 200 AS e FROM (
    SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM (
      SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM hit))
  GROUP BY r, g
), left_over AS (
  SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a, s AS z FROM runs UNION ALL SELECT r, max(e), NULL FROM runs GROUP BY r
), kept AS (
  SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, n) - a)), '' ORDER BY a) AS k FROM left_over JOIN d USING (r) GROUP BY r
), gone AS (
  SELECT r, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)
"""
