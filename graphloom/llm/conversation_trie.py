"""Conversation prefix trie: external merge sort that knows common prefixes, and a stack that emits finished nodes.

A turn becomes a symbol of fixed width (a digest of role and text, and the text's length), so a conversation is a string
of symbols, 32 bytes a turn however long its texts. Strings are dealt to tasks by range of (string, conv_id): a first turn,
or whole conversation, that a third of all share is spread over as many tasks as it fills. Each task sorts runs that carry
the common prefix of neighbours, spills them, and merges them by a loser tree in which prefixes already known to be shared
are never compared again. The merged stream drives the stack of the open path: what the next string doesn't share is
finished and leaves. Only the prefixes of a task's first and last string may go on in other tasks: these leave as partials
that are added up by their key, and a correction of what tasks counted twice runs up the few that do span tasks.

Null ids belong to no conversation; null roles and texts are empty; rows of one turn number go by role, then text (both by
symbol). An empty table gives no node, a conversation without turns is a member of the root. A conversation's symbols must
fit one row (60 million turns).
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table, written

#: Bytes of a symbol: 24 of a digest, 8 of the text's length.
WIDTH = 32
#: Strings and bytes of a run; runs that are merged at once; children after which a node's key goes with each of them.
RUN_ROWS, RUN_BYTES, FAN, WIDE = 8192, 1 << 25, 128, 1 << 16
FAMILY, HEADS = 5, 9
NODE = "kind int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends_sha256 string, ids binary"
FINAL, EDGE, ENDS = 0, 1, 2
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_NONE = hashlib.sha256(b"").hexdigest()
_RUN = pa.schema([("string", pa.binary()), ("conv_id", pa.int64()), ("shared", pa.int64())])


def sequences(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """(conv_id, symbols) of every conversation c, rebuilt: the first h turns of conversation c - c % family, then its own
    after its first h, with h = crc32(c) % heads. heads = 1 leaves conversations as they are."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    symbol = F.concat(F.substring(digest, 1, WIDTH - 8), F.unhex(F.lpad(F.hex(F.octet_length(text)), 16, "0")))
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", symbol.alias("symbol")).alias("t"))
    own = written(turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["symbol"]).alias("own")), "turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = own.select(F.col("conv_id").alias("_base"), F.slice("own", 1, heads).alias("head"))
    whole = own.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")).join(head, F.col("base") == F.col("_base"), "left")
    first = F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), F.col("h"))
    return written(whole.select("conv_id", F.concat(first, F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))).alias("symbols")), "sequences")


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Symbols that a and b share in front, if they share `at`; steps double, so that long prefixes cost little."""
    most, step = min(len(a), len(b)) // WIDTH, 1
    while at < most:
        to = min(most, at + step)
        if a[at * WIDTH : to * WIDTH] == b[at * WIDTH : to * WIDTH]:
            at, step = to, step * 2
        elif to - at == 1:
            break
        else:
            step = max(1, (to - at) // 2)
    return at


def sorted_run(rows: list[tuple[bytes, int]]) -> Iterator[tuple[bytes, int, int]]:
    """Rows in order of string and conv_id, each with what it shares with the one before."""
    rows.sort()
    last = b""
    for string, conv in rows:
        yield string, conv, shared(last, string)
        last = string


def spilled(rows: Iterable[tuple[bytes, int, int]]) -> Iterator[tuple[bytes, int, int]]:
    """Rows of a run by way of a temporary file of the task (without a name: it goes with the task)."""
    file = tempfile.TemporaryFile()
    with pa.ipc.new_stream(file, _RUN) as out:
        held, size = [], 0

        def flush():
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), _RUN.types)], schema=_RUN))

        for row in rows:
            held.append(row)
            size += len(row[0])
            if len(held) == 256 or size > 1 << 20:
                flush()
                held, size = [], 0
        if held:
            flush()

    def read():
        with file:
            file.seek(0)
            for batch in pa.ipc.open_stream(file):
                yield from zip(*(batch.column(k).to_pylist() for k in range(3)))

    return read()


def merged(runs: list[Iterator[tuple[bytes, int, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """The rows of sorted runs in one order, each with what it shares with the one before: a loser tree whose players
    know what they share with the last row that left. The player that shares more is the smaller one without looking;
    if both share as much, symbols from there on decide, and the loser keeps what it shares with the winner."""
    while len(runs) > FAN:
        runs = [spilled(merged(runs[k : k + FAN])) for k in range(0, len(runs), FAN)]
    size = 1 << max(0, len(runs) - 1).bit_length()
    heads = [next(r, None) for r in runs] + [None] * (size - len(runs))
    known = [0] * size
    losers = [0] * size

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        at = shared(a[0], b[0], known[i])
        x, y = a[0][at * WIDTH : (at + 1) * WIDTH], b[0][at * WIDTH : (at + 1) * WIDTH]
        first, last = (i, j) if (x, a[1], i) < (y, b[1], j) else (j, i)
        known[last] = at
        return first, last

    up = list(range(size))
    level = size
    while level > 1:
        level //= 2
        for k in range(level):
            up[k], losers[level + k] = play(up[2 * k], up[2 * k + 1])
    winner = up[0]
    while heads[winner] is not None:
        string, conv, _ = heads[winner]
        yield string, conv, known[winner]
        heads[winner] = next(runs[winner], None)
        known[winner] = heads[winner][2] if heads[winner] is not None else 0
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(losers[node], winner)
            node //= 2


def external_sort(rows: Iterable[tuple[bytes, int]], run_rows: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Rows (string, conv_id) in order, each with what it shares with the one before; runs are spilled once there are two."""
    runs, held, size = [], [], 0
    for row in rows:
        if held and (len(held) >= (run_rows or RUN_ROWS) or size > RUN_BYTES):
            runs.append(spilled(sorted_run(held)))
            held, size = [], 0
        held.append(row)
        size += len(row[0])
    runs.append(sorted_run(held))
    return merged(runs)


class _Open:
    """A node of the open path; what is finished below it is in the sums already."""

    __slots__ = ("low", "convs", "children", "leaves", "saved", "bytes", "ends", "waiting", "key", "edge")

    def __init__(self, size: int):
        self.low, self.convs, self.children, self.leaves, self.saved, self.bytes = None, 0, 0, 0, 0, size
        self.ends, self.waiting, self.key, self.edge = array("q"), [], None, False


def _text(ids: array) -> bytes:
    return ",".join(map(str, ids)).encode()


def nodes_of(stream: Iterator[tuple[bytes, int, int]], wide: int | None = None) -> Iterator[list]:
    """Rows of NODE of a sorted stream: nodes that are finished, the partials of those that other tasks may have too (the
    first and the last path), and the ids that end at these, in blocks. A child waits for its parent's smallest member,
    unless the parent is of the latter kind or has very many children: then it goes with the parent's key."""
    path: list[_Open] = []
    last, limit, ready = b"", wide or WIDE, []

    def close(depth: int) -> None:
        node = path.pop()
        leaf = node.children == 0
        node.leaves += leaf
        node.saved += (node.convs - 1) * node.bytes
        for child in node.waiting:
            if node.key is None:
                child[5] = node.low
            else:
                child[2] = node.key
        ready.extend(node.waiting)
        if path:
            up = path[-1]
            up.children += 1
            up.convs += node.convs
            up.leaves += node.leaves
            up.saved += node.saved
            up.low = node.low if up.low is None else min(up.low, node.low)
        row = [FINAL, node.key, None, node.low, depth, None, node.convs, node.children, node.leaves, node.saved, node.bytes, None, None]
        if node.edge:
            row[0], row[2] = EDGE, path[-1].key if path else None
            ready.append(row)
            for k in range(0, len(node.ends), 1 << 16):
                block = node.ends[k : k + (1 << 16)]
                ready.append([ENDS, node.key, None, block[0], *[None] * 8, block.tobytes()])
            return
        row[11] = hashlib.sha256(_text(node.ends)).hexdigest()
        path[-1].waiting.append(row)
        if len(path[-1].waiting) >= limit:
            if path[-1].key is None:
                path[-1].key = hashlib.sha256(last[: (depth - 1) * WIDTH]).digest()
            for child in path[-1].waiting:
                child[2] = path[-1].key
            ready.extend(path[-1].waiting)
            path[-1].waiting = []

    def keyed() -> None:
        """The open path belongs to other tasks too: keys of all its nodes, in one pass over the last string."""
        running = hashlib.sha256()
        for depth, node in enumerate(path):
            running.update(last[(depth - 1) * WIDTH : depth * WIDTH] if depth else b"")
            node.edge, node.key = True, running.copy().digest()

    first = True
    for string, conv, common in stream:
        if first:
            path.append(_Open(0))
        while len(path) - 1 > common:
            close(len(path) - 1)
        for k in range(common, len(string) // WIDTH):
            path.append(_Open(int.from_bytes(string[(k + 1) * WIDTH - 8 : (k + 1) * WIDTH])))
        last = string
        if first:
            keyed()
            first = False
        top = path[-1]
        top.ends.append(conv)
        top.convs += 1
        top.low = conv if top.low is None else min(top.low, conv)
        if len(ready) >= 4096:
            yield ready
            ready = []
    keyed()
    while path:
        close(len(path) - 1)
        if len(ready) >= 4096:
            yield ready
            ready = []
    yield ready


def _task(run_rows: int | None, wide: int | None):
    types = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string(), pa.binary()]
    names = [c.split()[0] for c in NODE.split(", ")]

    def rows(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield from ((b"".join(s), c) for c, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist()))

    def run(batches):
        for found in nodes_of(external_sort(rows(batches), run_rows), wide):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), types)], names=names)

    return run


def _corrected(batches):
    """What the tasks counted twice below each spanning node (key, parent_key, depth, leaf, saved), itself included."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: -r["depth"])
    leaf, saved = {r["key"]: r["leaf"] for r in rows}, {r["key"]: r["saved"] for r in rows}
    for r in rows:
        if r["parent_key"] in leaf:
            leaf[r["parent_key"]] += leaf[r["key"]]
            saved[r["parent_key"]] += saved[r["key"]]
    yield pa.RecordBatch.from_arrays([pa.array(list(leaf), pa.binary()), pa.array(list(leaf.values()), pa.int64()), pa.array(list(saved.values()), pa.int64())], names=["_key", "more_leaves", "more_saved"])


def _hashed(batches):
    """(key, sha256) of blocks of ids that come sorted by key and first id."""
    at, digest, done = None, None, []
    for batch in batches:
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if key == at:
                digest.update(b",")
            else:
                if at is not None:
                    done.append((at, digest.hexdigest()))
                at, digest = key, hashlib.sha256()
            block = array("q")
            block.frombytes(ids)
            digest.update(_text(block))
        if len(done) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["_key", "sha"])
            done = []
    if at is not None:
        done.append((at, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], names=["_key", "sha"])


def trie(strings: DataFrame, partitions: int | None = None, run_rows: int | None = None, wide: int | None = None) -> DataFrame:
    """The nodes of the trie of (conv_id, symbols), conv_id not null and each once; columns as COLUMNS."""
    dealt = strings.select("conv_id", "symbols")
    dealt = dealt.repartitionByRange(*([partitions] if partitions else []), "symbols", "conv_id")
    out = written(dealt.mapInArrow(_task(run_rows, wide), NODE), "trie")
    # Edges: as many as tasks have turns in their first and last string.
    edge = out.where(F.col("kind") == EDGE).groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("bytes").alias("bytes"), F.count("*").alias("tasks"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"),
    )
    edge = written(edge, "edges")
    again = edge.groupBy(F.col("parent_key").alias("_parent")).agg(F.sum(F.col("tasks") - 1).alias("again"))
    edge = edge.join(again, F.col("key") == F.col("_parent"), "left").withColumn("n_children", F.col("n_children") - F.coalesce("again", F.lit(0))).drop("_parent", "again")
    spans = edge.where("tasks > 1").select("key", "parent_key", "depth", ((F.col("n_children") == 0).cast("long") - F.col("leaf")).alias("leaf"), ((F.col("tasks") - 1) * F.col("bytes")).alias("saved"))
    more = spans.coalesce(1).mapInArrow(_corrected, "_key binary, more_leaves long, more_saved long")
    ends = out.where(F.col("kind") == ENDS).select("key", "conv_id", "ids").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hashed, "_key binary, sha string")
    edge = edge.join(more, F.col("key") == F.col("_key"), "left").drop("_key").join(ends, F.col("key") == F.col("_key"), "left").drop("_key")
    edge = edge.select(
        "key", "parent_key", "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"), F.coalesce("sha", F.lit(_NONE)).alias("ends_sha256"),
    )
    edge = written(edge, "edges-done")
    final = out.where(F.col("kind") == FINAL).select(*edge.columns)
    parents = written(edge.unionByName(final.where(F.col("key").isNotNull())).select(F.col("key").alias("_key"), F.col("conv_id").alias("_conv")), "parents")
    both = final.unionByName(edge).join(parents, F.col("parent_key") == F.col("_key"), "left")
    return both.select(*[F.coalesce("parent_conv_id", "_conv").alias(c) if c == "parent_conv_id" else F.col(c) for c in COLUMNS])


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(sequences(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


OP12_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
), u AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, strlen(text) AS bytes, sha256(strlen(role) || ':' || role || text) AS symbol FROM r
), s AS (SELECT conv_id, list(symbol ORDER BY depth) AS symbols FROM u GROUP BY conv_id
), p AS (
  SELECT c.conv_id, 0 AS depth, '' AS node, NULL AS parent, 0 AS bytes, s.symbols IS NULL AS ends FROM c LEFT JOIN s USING (conv_id)
  UNION ALL SELECT u.conv_id, u.depth, array_to_string(s.symbols[1:u.depth], ''), array_to_string(s.symbols[1:u.depth - 1], ''), u.bytes, u.depth = len(s.symbols)
  FROM u JOIN s USING (conv_id)
), n AS (
  SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
    sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM p GROUP BY node
), k AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent
), b AS (
  SELECT up.node, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE k.parent IS NULL) AS n_leaves
  FROM n JOIN p up ON up.conv_id = n.conv_id AND up.depth <= n.depth LEFT JOIN k ON k.parent = n.node GROUP BY up.node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n m ON m.node = n.parent LEFT JOIN k ON k.parent = n.node JOIN b ON b.node = n.node
"""
