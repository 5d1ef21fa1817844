"""Substring dedup by words: difference-cover anchors find shared passages and are extended word by word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import checkpoint, discard, table, written
from .rows import SIDE_BYTES, attach, copies, doubled, hash_filter, keyed, mixed, passes, small

WINDOW = 50
#: A perfect difference set: every residue modulo PERIOD is a difference of two of these.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
BASE = 0x9E3779B97F4A7C15
#: Word codes that one task keeps; beyond it the store is emptied and filled anew.
KEPT_WORDS = 400_000


def difference_cover(period: int = PERIOD, cover: tuple[int, ...] = COVER) -> np.ndarray:
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError(f"{cover} is no difference cover modulo {period}")
    return np.isin(np.arange(period), cover)


class Coder(dict):
    """64-bit codes of words, each distinct word hashed once while it is kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchor_hashes(codes: np.ndarray, window: int, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the anchors: runs of window - period + 1 words that begin at a cover position.

    Two equal windows at i and j have a shift below the period that takes both to cover positions, and the anchor
    there lies inside both windows."""
    size = window - len(cover) + 1
    if len(codes) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(np.resize(cover, len(codes) - size + 1))
    return mixed(doubled(codes, size, BASE))[at].view(np.int64), at


def _per_text(df: DataFrame, names: list[str], schema: str, make, *extra: str) -> DataFrame:
    """Apply make(state, doc_id list, row list, texts, *extra lists) -> arrays to each batch."""

    def run(batches):
        state = Coder()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out = make(state, *(part.column(c) for c in range(part.num_columns)))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return df.select("doc_id", "_row", "text", *extra).mapInArrow(run, schema)


def _repeat(column: pa.Array, counts: list[int]) -> pa.Array:
    return column.take(pa.array(np.repeat(np.arange(len(column)), counts)))


class Words:
    """The words of a text and the bytes of any run of them, joined by one space."""

    def __init__(self, text: str | None):
        self.words = words_of(text)
        self.joined = b" ".join(self.words)
        self.ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1) - 1

    def run(self, first: int, end: int) -> bytes:
        return self.joined[self.ends[first - 1] + 1 if first else 0 : self.ends[end - 1]]


def extended(own: list[bytes], at: int, other: list[bytes], there: int, size: int) -> tuple[int, int] | None:
    """Words by which an anchor of `size` words at own[at] and other[there] extends to the left and to the right with
    both agreeing; None if the anchors differ."""
    if own[at : at + size] != other[there : there + size]:
        return None
    most = min(at, there)
    left = next((k for k in range(most) if own[at - k - 1] != other[there - k - 1]), most)
    most = min(len(own) - at, len(other) - there) - size
    right = next((k for k in range(most) if own[at + size + k] != other[there + size + k]), most)
    return left, right


def _hashes(rest: DataFrame, window: int, mask: np.ndarray) -> DataFrame:
    """(doc_id, _row, text, h: the hashes of all anchors of a text in their order)."""
    kind = rest.schema["doc_id"].dataType.simpleString()

    def found(coder, ids, rows, texts):
        hashes = [anchor_hashes(coder(words_of(t)), window, mask)[0] for t in texts.to_pylist()]
        return [ids, rows, texts, pa.array(hashes, pa.list_(pa.int64()))]

    return _per_text(rest, ["doc_id", "_row", "text", "h"], f"doc_id {kind}, _row long, text string, h array<long>", found)


def _places(hashes: DataFrame, held, window: int, mask: np.ndarray) -> DataFrame:
    """(h, a, b, doc_id, _row, p, l, r): for each anchor that passes the filter `held` how many words of the text lie left
    and right of it within reach of a window, and 128 bits of all these words."""
    kind = hashes.schema["doc_id"].dataType.simpleString()
    cover, period = np.flatnonzero(mask), len(mask)
    reach = period - 1
    size = window - reach

    def found(_, ids, rows, texts, own):
        import xxhash

        digest, sums, lefts, rights, places = xxhash.xxh3_128_digest, [], [], [], []
        flat, lens = own.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
        index, which = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens), np.repeat(np.arange(len(lens)), lens)
        ok = passes(flat, held.value) if len(flat) else np.zeros(0, bool)
        index, n = index[ok], np.bincount(which[ok], minlength=len(lens))
        at = index // len(cover) * period + cover[index % len(cover)]
        for i, p in zip(np.flatnonzero(n).tolist(), np.split(at, np.cumsum(n[n > 0])[:-1])):
            w = Words(texts[i].as_py())
            left, right = np.minimum(p, reach), np.minimum(len(w.words) - p - size, reach)
            first = p - left
            begin = np.where(first > 0, w.ends[first - 1] + 1, 0)
            end = w.ends[p + size + right - 1]
            sums += [digest(w.joined[x:y]) for x, y in zip(begin.tolist(), end.tolist())]
            lefts.append(left), rights.append(right), places.append(p)
        both = np.frombuffer(b"".join(sums), np.int64).reshape(-1, 2)
        numbers = [pa.array((np.concatenate(x) if x else np.empty(0)).astype(np.int32)) for x in (places, lefts, rights)]
        return [pa.array(flat[ok], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), _repeat(ids, n), _repeat(rows, n), *numbers]

    names = ["h", "a", "b", "doc_id", "_row", "p", "l", "r"]
    return _per_text(hashes, names, f"h long, a long, b long, doc_id {kind}, _row long, p int, l int, r int", found, "h")


KEY = ["h", "doc_id", "_row", "p"]


def _surroundings(docs: DataFrame, ones: DataFrame, size: int) -> DataFrame:
    """(g, h, doc_id, _row, p, l, a, b, ref, words): for anchors (h, doc_id, _row, p, l, r, ref) the words within reach."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    where = checkpoint(ones.groupBy("doc_id", "_row").agg(F.collect_list(F.struct("h", "p", "l", "r", "ref")).alias("at")))
    names = ["g", "h", "doc_id", "_row", "p", "l", "a", "b", "ref", "words"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                w, at = Words(batch.column("text")[i].as_py()), batch.column("at")[i].as_py()
                k, zero = pa.array(np.full(len(at), i)), pa.array(np.zeros(len(at), np.int32))
                h = pa.array([x["h"] for x in at], pa.int64())
                texts = [w.run(x["p"] - x["l"], x["p"] + size + x["r"]) for x in at]
                numbers = [pa.array([x[c] for x in at], pa.int32()) for c in "pl"]
                yield pa.RecordBatch.from_arrays([h, h, batch.column("doc_id").take(k), batch.column("_row").take(k), *numbers, zero, zero, pa.array([x["ref"] for x in at]), pa.array(texts, pa.binary())], names=names)

    source = attach(docs, where, "inner").select("doc_id", "_row", "text", "at")
    return source.mapInArrow(run, f"g long, h long, doc_id {kind}, _row long, p int, l int, a int, b int, ref boolean, words binary")


def _extension(rows: DataFrame, size: int, reach: int) -> DataFrame:
    """For rows beside their group's reference (columns x_*): marks (doc_id, _row, lo, hi: first windows) and the rows'
    next groups (g not null).

    A group's rows agree in a words to the left of the anchor and b to the right. A row that leaves the reference after
    more words can still share windows with rows that leave it at the same place with the same word: with these it
    makes up the next group on that side, as long as a window has room for what they agree in."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["g", "h", "doc_id", "_row", "p", "l", "a", "b", "lo", "hi"]
    kinds = [pa.int64(), pa.int64(), None, pa.int64(), *[pa.int32()] * 6]

    def run(batches):
        import xxhash

        for batch in batches:
            out: list[list] = [[] for _ in names]
            ids = []
            columns = [batch.column(c).to_pylist() for c in ("g", "h", "_row", "p", "l", "a", "b", "words", "x_l", "x_words", "smaller")]
            for i, (g, h, row, p, at, a, b, words, there, x_words, smaller) in enumerate(zip(*columns)):
                own = words.split(b" ")

                def put(g, a, b, lo=None, hi=None):
                    for column, x in zip(out, (g, h, None, row, p, at, a, b, lo, hi)):
                        column.append(x)
                    ids.append(i)

                def group(a, b, seed=0):
                    return xxhash.xxh3_64_intdigest(b" ".join(own[at - a : at + size + b]), seed=(31 * a + b + seed) & (1 << 64) - 1) - (1 << 63)

                met = extended(own, at, x_words.split(b" "), there, size)
                if met is None or met[0] < a or met[1] < b:  # one hash, other words: on with those of the same words
                    put(group(a, b, g + 1), a, b)
                    continue
                left, right = met
                if smaller and left + right >= reach:
                    put(None, None, None, p - min(left, reach), p - (reach - min(right, reach)))
                if left < at and left + 1 + b <= reach:
                    put(group(left + 1, b), left + 1, b)
                if right < len(own) - at - size and a + right + 1 <= reach:
                    put(group(a, right + 1), a, right + 1)
            made = [batch.column("doc_id").take(pa.array(ids, pa.int64())) if t is None else pa.array(x, t) for x, t in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(made, names=names)

    return rows.mapInArrow(run, f"g long, h long, doc_id {kind}, _row long, p int, l int, a int, b int, lo int, hi int")


def _with_reference(rows: DataFrame, group: str) -> DataFrame:
    """The rows of groups of two documents or more, with ref: is it the first row of the group's smallest document?"""
    first = rows.groupBy(F.col(group).alias("_group")).agg(F.min(F.struct("doc_id", "_row", "p")).alias("x"), F.max("doc_id").alias("hi")).where("x.doc_id < hi")
    # materialised, so that the join deals both sides anew and a very frequent anchor can be split
    out = rows.join(checkpoint(first), F.col(group) == F.col("_group"))
    ref = (F.col("doc_id") == F.col("x.doc_id")) & (F.col("_row") == F.col("x._row")) & (F.col("p") == F.col("x.p"))
    return out.select(*rows.columns, ref.alias("ref"))


def shared_windows(docs: DataFrame, rest: DataFrame, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """(doc_id, _row, lo, hi): ranges of first words of rest's windows that also start in a document of a smaller doc_id.

    Anchors that two documents have meet by hash, with 128 bits of the words in reach: of places where these agree only
    those of the smallest doc_id go on, the others lose all windows about them. What goes on is extended word by word
    from the anchor, against the reference of its group (the smallest doc_id), and regroups where it leaves the
    reference, until no group has two documents. A row can leave it at most `period` times; no group is gathered."""
    mask = difference_cover(period, cover)
    reach = period - 1
    size = window - reach
    hashes = written(_hashes(rest, window, mask), "hashes")
    spread = hashes.select("doc_id", F.explode("h").alias("h")).groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    held = hash_filter(spread.where("lo < hi").select("h"))
    places = written(_places(hashes, held, window, mask), "places")
    discard(hashes)
    held.unpersist()
    one = ["h", "a", "b", "l"]
    classes = checkpoint(places.groupBy(*one).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("hi")))
    many = classes.groupBy("h").agg(F.min("least").alias("lo"), F.max("least").alias("up")).where("lo < up").select(F.col("h").alias("_g"))
    classes = classes.select(*[F.col(c).alias(f"_{c}") for c in one], "least", "hi")
    classes = checkpoint(classes.join(checkpoint(many), F.col("_h") == F.col("_g"), "left").withColumn("open", F.col("_g").isNotNull()).where("least < hi OR open"))
    met = written(places.join(classes, [F.col(c) == F.col(f"_{c}") for c in one]).where("least < doc_id OR open").select("h", "doc_id", "_row", "p", "l", "r", (F.col("least") < F.col("doc_id")).alias("later")), "met")
    discard(places, classes)
    marks = [met.where("later").select("doc_id", "_row", (F.col("p") - F.col("l")).alias("lo"), (F.col("p") - F.lit(reach) + F.col("r")).alias("hi"))]
    words = left = written(_surroundings(docs, _with_reference(met.where("NOT later").drop("later").distinct(), "h"), size), "surroundings")
    while True:
        refs = written(left.where("ref").dropDuplicates(["g"]).select(F.col("g").alias("_g"), F.col("doc_id").alias("x_doc"), F.col("l").alias("x_l"), F.col("words").alias("x_words")), "references")
        rows = left.where("NOT ref").join(refs, F.col("g") == F.col("_g")).withColumn("smaller", F.col("x_doc") < F.col("doc_id"))
        out = written(_extension(rows, size, reach), "extended")
        marks.append(out.where("g IS NULL").select("doc_id", "_row", "lo", "hi"))
        following = written(_with_reference(out.where("g IS NOT NULL").drop("lo", "hi").distinct(), "g"), "following")
        discard(refs, *([left] if left is not words else []))
        if following.isEmpty():
            break
        again = F.broadcast(following) if small(following, SIDE_BYTES) else following
        left = written(words.select(*KEY, "words").join(again, KEY), "surroundings")
    found = marks[0]
    for x in marks[1:]:
        found = found.unionByName(x)
    return found


def substring_dedup(documents: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """One row for each row of documents (doc_id, text): doc_id, n_words, n_removed, kept (the text that stays, words
    joined by one space).

    A word goes if a window of `window` consecutive words that covers it also starts in a document of a smaller doc_id;
    windows are those of the input. Words part at ASCII white space and are compared as they are. Null texts have no
    words. Rows that repeat a doc_id are one document for "smaller"; a null doc_id is neither smaller nor larger.
    Exact copies: the row of the smallest doc_id stands for all, the others lose every word if they have a window.
    Other columns aren't read. Empty table: no rows. Very long texts are handled whole, one at a time.
    """
    docs = keyed(documents)
    same = copies(docs)
    later = checkpoint(same.where(F.col("least") < F.col("doc_id")).select("doc_id", "_row"))
    rest = attach(docs, later, "left_anti").where(F.col("doc_id").isNotNull())
    hits = shared_windows(docs, rest, window, period, cover).groupBy("doc_id", "_row").agg(F.collect_set(F.struct("lo", "hi")).alias("at"))
    side = checkpoint(_packed(hits).unionByName(later.select("doc_id", "_row", F.lit(None).cast("binary").alias("starts"), F.lit(True).alias("all"))))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(_, ids, rows, texts, starts, every):
        n, removed, kept = [], [], []
        for t, s, a in zip(texts.to_pylist(), starts.to_pylist(), every.to_pylist()):
            words = words_of(t)
            n.append(len(words))
            if a and len(words) >= window:
                gone = np.ones(len(words), bool)
            elif s:
                lo, hi = np.frombuffer(s, np.int32).reshape(-1, 2).T.astype(np.int64)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, lo, 1)
                np.add.at(change, hi + window, -1)
                gone = np.cumsum(change[:-1]) > 0
            else:
                gone = None
            removed.append(0 if gone is None else int(gone.sum()))
            left = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
            kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
        return [ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]

    return _per_text(attach(docs, side), ["doc_id", "n_words", "n_removed", "kept"], f"doc_id {kind}, n_words long, n_removed long, kept string", cut, "starts", "all")


def _packed(hits: DataFrame) -> DataFrame:
    """Ranges of first words merged and packed (int32 pairs): small, and measurable."""

    def run(batches):
        for batch in batches:
            packed = []
            for x in batch.column("at").to_pylist():
                lo, hi = np.array(sorted((r["lo"], r["hi"]) for r in x), np.int64).T
                reach = np.maximum.accumulate(hi)
                new = np.concatenate(([True], lo[1:] > reach[:-1] + 1))
                packed.append(np.stack((lo[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]), axis=1).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_row"), pa.array(packed, pa.binary()), pa.array([False] * len(packed))], names=["doc_id", "_row", "starts", "all"])

    kind = hits.schema["doc_id"].dataType.simpleString()
    return hits.mapInArrow(run, f"doc_id {kind}, _row long, starts binary, all boolean")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)
), hit AS (
  SELECT r, i FROM win JOIN (SELECT k, min(doc_id) AS least FROM win GROUP BY k) USING (k) WHERE least < doc_id
), runs AS (
  SELECT r, g, min(i) AS s, max(i) + 50 AS e FROM (
    SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM (
      SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit))
  GROUP BY r, g
), left_over AS (
  SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 1) AS a, s AS z FROM runs UNION ALL SELECT r, max(e), NULL FROM runs GROUP BY r
), kept AS (
  SELECT r, array_to_string(flatten(list(w[a:coalesce(z - 1, len(w))] ORDER BY a)), ' ') AS k FROM left_over JOIN d USING (r) GROUP BY r
), gone AS (
  SELECT r, sum(e - s)::BIGINT AS n_removed FROM runs GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, array_to_string(w, ' '))) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)
"""
