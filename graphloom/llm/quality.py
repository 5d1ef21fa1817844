"""Quality classifier by co-training: a view of the text and a view of the page's metadata teach each other."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table, written

#: Bound of the labelled documents that a fit reads. All others take part in co-training.
LABELLED = 4000
#: Hashed word features of the text view, hashed features of the metadata view.
WORDS, META = 1 << 12, 1 << 12
#: Rounds of co-training, and documents that each view hands to the other in a round.
ROUNDS, MOVED = 4, 300
_SIGNS = re.compile(r"[%#$&*|@!=~^<>{}\[\]\\/_+]")


def content_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of the text view: shape of the prose (repetition, signs, case, lengths) and hashed words."""
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = text.split("\n")
    stops = sum(w[-1] in ".!?" for w in words)
    letters = sum(map(str.isalpha, text))
    upper = sum(w.isupper() and len(w) > 1 for w in words) / n
    longest = max(map(len, lines))
    shape = [
        1.0,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        max(pairs.values(), default=0) / max(1, n - 1),
        len(pairs) / max(1, n - 1),
        len(_SIGNS.findall(text)) / n,
        upper,
        min(2.0, stops * 10 / n),
        sum(map(len, words)) / n / 10,
        math.log1p(len(words)) / 10,
        len(set(lines)) / max(1, len(lines)),
        min(2.0, letters / max(1, len(text))),
        sum(map(str.isdigit, words)) / n,
        sum(n for _, n in counts.items() if n > 1) / n,
        math.log1p(len(lines)) / 10,
        math.log1p(longest) / 12,
        longest / max(1, len(text)),
        float(text[-1:] in tuple(".!?")),
    ]
    # each bucket gives steps, so that a linear model can bend
    idx, val = list(range(len(shape))), list(shape)
    for k, x in enumerate(shape[1:], 1):
        idx.append(32 + 16 * k + min(15, int(15 * min(1.0, max(0.0, x)))))
        val.append(1.0)
    hashed = Counter()
    for w, c in counts.items():
        hashed[512 + zlib.crc32(w.lower().strip(".,!?;:").encode("utf-8", "ignore")) % (WORDS - 512)] += c
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in hashed.values())) or 1.0
    idx += hashed.keys()
    val += [2.0 * math.log1p(c) / norm for c in hashed.values()]
    return np.array(idx, np.int32), np.array(val, np.float32)


def page_features(source: str | None, lang: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of the metadata view: where the page is from, its declared language and its recorded size,
    alone and together. It never sees the text."""
    size = "null" if n_chars is None else int(4 * math.log2(max(n_chars, 0) + 1))
    keys = [f"s{source}", f"l{lang}", f"n{size}", f"sl{source}|{lang}", f"sn{source}|{size}", f"ln{lang}|{size}"]
    found = sorted({zlib.crc32(k.encode("utf-8", "ignore")) % (META - 1) + 1 for k in keys})
    return np.array([0, *found], np.int32), np.ones(len(found) + 1, np.float32)


class Logistic:
    """Sparse logistic regression with class weights, trained in numpy, and a calibration line on its scores."""

    def __init__(self, size: int):
        self.w = np.zeros(size, np.float32)
        self.line = (1.0, 0.0)

    def raw(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        n = np.fromiter((len(i) for i, _ in rows), np.int64, len(rows))
        at = np.cumsum(n) - n
        return np.add.reduceat(self.w[np.concatenate([i for i, _ in rows])] * np.concatenate([v for _, v in rows]), at).astype(np.float64)

    def fit(self, rows, y: np.ndarray, weight: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.15, decay: float = 1e-5, seed: int = 5) -> Logistic:
        self.w[:] = 0
        square = np.full(len(self.w), 1e-2, np.float32)
        share = np.array([weight[y == c].sum() for c in (0, 1)])
        balance = np.where(y == 1, 1 / max(share[1], 1e-9), 1 / max(share[0], 1e-9)) * weight * share.sum() / 2
        r = np.random.default_rng(seed)
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for k in range(0, len(order), batch):
                ids = order[k : k + batch]
                part = [rows[i] for i in ids]
                p = 1 / (1 + np.exp(-np.clip(self.raw(part), -30, 30)))
                g = ((p - y[ids]) * balance[ids] / len(ids)).astype(np.float32)
                idx = np.concatenate([i for i, _ in part])
                step = np.concatenate([v * e for (_, v), e in zip(part, g)])
                grad = np.bincount(idx, step, len(self.w)).astype(np.float32) + decay * self.w
                square += grad * grad
                self.w -= rate * grad / np.sqrt(square)
        return self

    def calibrate(self, rows, y: np.ndarray) -> None:
        """Platt's line by Newton steps on held-back rows."""
        s, (a, b) = self.raw(rows), (1.0, 0.0)
        if len(set(y.tolist())) == 2:
            t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
                g, h = p - t, np.maximum(p * (1 - p), 1e-6)
                H = np.array([[(h * s * s).sum() + 1e-3, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-3]])
                da, db = np.linalg.solve(H, [(g * s).sum() + 1e-3 * (a - 1), g.sum()])
                a, b = a - da, b - db
        self.line = (max(float(a), 1e-3), float(b))

    def probability(self, rows) -> np.ndarray:
        a, b = self.line
        return 1 / (1 + np.exp(-np.clip(a * self.raw(rows) + b, -30, 30)))


class CoTrained:
    """Two views and the weight by which their calibrated log odds add up."""

    def __init__(self):
        self.views = (Logistic(WORDS), Logistic(META))
        self.mix = (1.0, 0.0, 0.0)
        self.rounds: list[int] = []

    def fit(self, views, y: np.ndarray, surest=None, rounds: int = ROUNDS, moved: int = MOVED) -> CoTrained:
        """views: feature rows of the labelled documents, one list a view. surest(models, low, high, given) gives for
        each view the `low` unlabelled documents it scores lowest and the `high` it scores highest, as lists of
        (key, label, feature rows of both views), without those whose key is in given.

        Each round both views train on their own labelled set, and each hands the `moved` documents it is surest of (in
        the ratio of the classes) to the OTHER view's set with its label, at half weight. A quarter of the labelled
        documents is held back from both for calibration and for the mix."""
        if not len(y):
            return self
        back = np.arange(len(y)) % 4 == 3
        if len(set(y[~back].tolist())) < 2 or len(set(y[back].tolist())) < 2:
            back[:] = False
        own = [[[v[i] for i in np.flatnonzero(~back)], list(y[~back]), [1.0] * int((~back).sum())] for v in views]
        given: set = set()
        for turn in range(rounds + 1):
            for model, (rows, t, w) in zip(self.views, own):
                model.fit(rows, np.array(t, float), np.array(w))
            if turn == rounds or surest is None:
                break
            share = float(np.mean(y))
            found = surest(self.views, max(1, round(moved * (1 - share))), max(1, round(moved * share)), given)
            now = {key for x in found for key, _, _ in x}
            if not now:
                break
            for k, x in enumerate(found):
                rows, t, w = own[1 - k]
                for _, label, both in x:
                    rows.append(both[1 - k]), t.append(label), w.append(0.5)
            given |= now
            self.rounds.append(len(now))
        held = np.flatnonzero(back) if back.any() else np.arange(len(y))
        for model, v in zip(self.views, views):
            model.calibrate([v[i] for i in held], y[held].astype(float))
        # how much each view's log odds count: a logistic fit of two numbers
        odds = [np.log(p / (1 - p)) for p in (m.probability([v[i] for i in held]).clip(1e-6, 1 - 1e-6) for m, v in zip(self.views, views))]
        x, t = np.stack([*odds, np.ones(len(held))], axis=1), y[held].astype(float)
        beta = np.array([1.0, 0.5, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = np.maximum(p * (1 - p), 1e-6)
            beta = beta - np.linalg.solve((x * h[:, None]).T @ x + np.eye(3) * 0.1, x.T @ (p - t) + 0.1 * (beta - [1.0, 0.5, 0.0]))
        self.mix = tuple(float(b) for b in beta)
        return self

    def score(self, views) -> np.ndarray:
        if not len(views[0]):
            return np.empty(0)
        odds = [np.log(p / (1 - p)) for p in (m.probability(v).clip(1e-9, 1 - 1e-9) for m, v in zip(self.views, views))]
        a, b, c = self.mix
        return 1 / (1 + np.exp(-np.clip(a * odds[0] + b * odds[1] + c, -30, 30)))


def features(documents: DataFrame) -> DataFrame:
    """(rid, doc_id, and the two views' feature rows: indexes ai, bi and values av, bv) of every row of documents
    (doc_id, text, source, lang and, if there, n_chars), from whole texts, written once. Null texts are empty texts."""
    size = F.col("n_chars").cast("long") if "n_chars" in documents.columns else F.lit(None).cast("long")

    def run(batches):
        for batch in batches:
            a = [content_features(t.as_py()) for t in batch.column("text")]
            b = [page_features(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n")))]
            rows = [[i.astype(np.int16).tobytes() for i, _ in a], [v.tobytes() for _, v in a], [i.astype(np.int16).tobytes() for i, _ in b], [v.tobytes() for _, v in b]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.binary()) for x in rows)], names=["doc_id", "ai", "av", "bi", "bv"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    made = documents.select("doc_id", "text", "source", "lang", size.alias("n")).mapInArrow(run, f"doc_id {kind}, ai binary, av binary, bi binary, bv binary")
    return written(made.withColumn("rid", F.monotonically_increasing_id()), "features")


def _open(columns) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(i, np.int16).astype(np.int32), np.frombuffer(v, np.float32)) for i, v in zip(*columns)]


def _both(batch):
    return [_open([batch.column(k + x).to_pylist() for x in "iv"]) for k in "ab"]


def _surest(rows: DataFrame, models, low: int, high: int, given: set) -> list[list[tuple]]:
    """For each view the rows it scores lowest and highest. Every task passes on as many as may be among these, so the
    choice is of all rows, and what the driver gets is bounded by low and high."""
    out_of = np.array(sorted(given), np.int64)  # at most the sample and what the rounds moved

    def best(batches):
        kept: list[tuple] = [() for _ in range(4)]

        def narrowed():
            for k in range(4):
                n = (low, high)[k % 2]
                kept[k] = tuple(sorted(kept[k])[:n])

        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                rid = part.column("rid").to_numpy()
                free = np.flatnonzero(~np.isin(rid, out_of))
                views = _both(part)
                for v, model in enumerate(models):
                    s = model.raw(views[v])
                    for end, (n, sign) in enumerate(((low, 1), (high, -1))):
                        order = free[np.lexsort((rid[free], sign * s[free]))[:n]]
                        kept[2 * v + end] += tuple((float(sign * s[i]), int(rid[i]), *(part.column(c)[int(i)].as_py() for c in ("ai", "av", "bi", "bv"))) for i in order)
                narrowed()
        rows = [(k, *x) for k in range(4) for x in kept[k]]
        types = [pa.int32(), pa.float64(), pa.int64()] + [pa.binary()] * 4
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["k", "s", "rid", "ai", "av", "bi", "bv"])

    found = written(rows.select("rid", "ai", "av", "bi", "bv").mapInArrow(best, "k int, s double, rid long, ai binary, av binary, bi binary, bv binary"), "surest")
    out: list[list[tuple]] = [[], []]
    for k in range(4):
        for r in found.where(F.col("k") == k).orderBy("s", "rid").limit((low, high)[k % 2]).collect():
            out[k // 2].append((r["rid"], float(k % 2), [_open([[r[v + "i"]], [r[v + "v"]]])[0] for v in "ab"]))
    return out


def fit(rows: DataFrame, labels: DataFrame, target: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS, moved: int = MOVED) -> CoTrained:
    """Co-train on features() rows: on the `labelled` documents with the lowest hash of doc_id that have a label, and on
    all other rows as unlabelled. Of labels that repeat a doc_id the highest counts, null ones don't; of rows that repeat
    a labelled doc_id one is used. Without labels all scores are a half."""
    marks = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).alias("_y")).withColumnRenamed("doc_id", "_id")
    known = rows.select("doc_id", "rid").join(marks, F.col("doc_id") == F.col("_id")).groupBy("doc_id", "_y").agg(F.min("rid").alias("rid"))
    take = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).select(F.col("rid").alias("_rid"), "_y")
    chosen = rows.join(F.broadcast(take), F.col("rid") == F.col("_rid")).select("rid", "_y", "ai", "av", "bi", "bv").orderBy(F.xxhash64("doc_id"), "rid").collect()
    model = CoTrained()
    if not chosen:
        return model
    views = [_open([[r[v + x] for r in chosen] for x in "iv"]) for v in "ab"]
    own = {r["rid"] for r in chosen}
    return model.fit(views, np.array([int(r["_y"] > 0) for r in chosen]), lambda models, low, high, given: _surest(rows, models, low, high, given | own), rounds, moved)


def score(rows: DataFrame, model: CoTrained, name: str = "quality_score") -> DataFrame:
    """doc_id, the combined score, and the two views' calibrated scores for every row of features(). Repeated rows give
    repeated rows, an empty table none. Narrow: no shuffle."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                views = _both(part)
                own = [m.probability(v) for m, v in zip(model.views, views)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(views)), pa.array(own[0]), pa.array(own[1])], names=["doc_id", name, "content_score", "page_score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ai", "av", "bi", "bv").mapInArrow(run, f"doc_id {kind}, {name} double, content_score double, page_score double")


def op7_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(table(spark, sf_dir, "documents"))
    scored = score(rows, fit(rows, table(spark, sf_dir, "labels")))
    return scored.withColumn("quality_pred", (F.col("quality_score") >= 0.5).cast("int"))
