"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import table

#: Bound of what a fit reads: labelled documents of each language (all languages, whole texts).
TRAIN_DOCUMENTS = 100
#: A text's bytes go through the network in windows of CORE bytes that are labelled, with EDGE more on either side from
#: which the states of both directions come, so that a cut does not show.
CORE, EDGE = 224, 16
UNKNOWN = "und"


def held_out(key: Column) -> Column:
    """Documents that a fit never sees: crc32 of the id as text is divisible by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def windows(text: bytes, core: int = CORE, edge: int = EDGE) -> list[tuple[int, int, int]]:
    """(start, end, labelled from) of the windows of a text, which label each byte once."""
    n = len(text)
    return [(max(0, k - edge), min(n, k + core + edge), min(k, edge)) for k in range(0, n, core)]


class ByteGRU:
    """Bytes of a text to a label distribution at every byte: a gated recurrent network in both directions.

    Arrays have time first and sequences last. A sequence that is shorter than its batch is padded; the backward state
    is held at zero there. In a cell z and r are gates of the byte and the state h, n = tanh(byte + r * (U h)) and
    h becomes h + z * (n - h)."""

    def __init__(self, classes: int, embed: int = 12, hidden: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)

        def w(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)

        self.hidden, self.classes = hidden, classes
        self.p = {"E": w(256, embed, scale=0.3), "V": w(classes, 2 * hidden, scale=0.2), "c": np.zeros((classes, 1), np.float32)}
        for d in "fb":
            self.p |= {"W" + d: w(embed, 3 * hidden, scale=0.3), "U" + d: w(3 * hidden, hidden, scale=0.25), "b" + d: np.zeros(3 * hidden, np.float32)}

    @staticmethod
    def batch(data: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Bytes (time, sequence) of the sequences of data that begin at start; what lies beyond an end is 0."""
        at = np.arange(int(lens.max(initial=1)))[:, None]
        return np.where(at < lens, data[np.minimum(start + at, len(data) - 1)], 0).astype(np.uint8)

    def _run(self, x: np.ndarray, lens: np.ndarray, d: str, keep: bool = False, out: np.ndarray | None = None):
        """Hidden states (time, state, sequence), written to out if given. Weights carry the signs and factors of
        1 / (1 + exp(-v)) and tanh(v) = 2 / (1 + exp(-2 v)) - 1, so that a step has few passes over its arrays."""
        p, H = self.p, self.hidden
        T, B = x.shape
        scale = np.repeat(np.array([-1, -1, -2], np.float32), H)[:, None]
        table = np.ascontiguousarray((p["E"] @ p["W" + d] + p["b" + d]).T) * scale  # the byte's part of the gates
        U, h, least = p["U" + d] * scale, np.zeros((H, B), np.float32), int(lens.min(initial=T))
        out = np.empty((T, H, B), np.float32) if out is None else out
        saved, a, s, n = {}, np.empty((3 * H, B), np.float32), np.empty((3 * H, B), np.float32), np.empty((H, B), np.float32)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            if keep:
                s, n = np.empty_like(s), np.empty_like(n)
            np.take(table, x[t].astype(np.intp), axis=1, out=a, mode="clip")  # clip: numpy checks no bounds; bytes have none to pass
            np.matmul(U, h, out=s)
            zr, sn, new = s[: 2 * H], s[2 * H :], out[t]
            zr += a[: 2 * H]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:H], zr[H:]
            np.multiply(r, sn, out=n)
            n += a[2 * H :]
            np.exp(n, out=n)
            n += 1
            np.divide(2, n, out=n)
            n -= 1
            if keep:
                saved[t] = (h, z, r, n, sn / -2)
            np.subtract(n, h, out=new)
            new *= z
            new += h
            if d == "b" and t >= least:
                new *= t < lens
            h = new
        return (out, saved) if keep else out

    def probabilities(self, x: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """(time, class, sequence)."""
        h = np.empty((x.shape[0], 2 * self.hidden, x.shape[1]), np.float32)
        self._run(x, lens, "f", out=h[:, : self.hidden])
        self._run(x, lens, "b", out=h[:, self.hidden :])
        s = self.p["V"] @ h
        s += self.p["c"]
        s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=1, keepdims=True)
        return s

    def gradients(self, x: np.ndarray, lens: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Cross-entropy of every position's label, by sequence weight, and its gradients through time."""
        p, H = self.p, self.hidden
        T, B = x.shape
        runs = {d: self._run(x, lens, d, keep=True) for d in "fb"}
        h = np.concatenate((runs["f"][0], runs["b"][0]), axis=1)
        s = p["V"] @ h + p["c"]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        scale = (np.arange(T)[:, None] < lens) * weight
        scale = (scale / max(float(scale.sum()), 1e-9)).astype(np.float32)
        loss = float(-(np.log(s[:, y, np.arange(B)] + 1e-9) * scale).sum())
        ds = s
        ds[:, y, np.arange(B)] -= 1
        ds *= scale[:, None]
        g = {"V": np.einsum("tlb,thb->lh", ds, h, optimize=True), "c": ds.sum(axis=(0, 2))[:, None], "E": np.zeros_like(p["E"])}
        dh_all = p["V"].T @ ds
        order = np.argsort(x, axis=None, kind="stable")
        found, first = np.unique(x.ravel()[order], return_index=True)
        for d, part in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            saved, U = runs[d][1], p["U" + d]
            gU, carry, da = np.zeros_like(U), np.zeros((H, B), np.float32), np.empty((T, B, 3 * H), np.float32)
            for t in range(T - 1, -1, -1) if d == "f" else range(T):
                hp, z, r, n, sn = saved[t]
                dh = dh_all[t, part] + carry
                if d == "b":
                    dh = dh * (t < lens)
                dz, dn = dh * (n - hp) * z * (1 - z), dh * z * (1 - n * n)
                dr = dn * sn * r * (1 - r)
                back = np.concatenate((dz, dr, dn * r))
                gU += back @ hp.T
                carry = dh * (1 - z) + U.T @ back
                da[t] = np.concatenate((dz, dr, dn)).T
            by_byte = np.zeros((256, 3 * H), np.float32)
            by_byte[found] = np.add.reduceat(da.reshape(T * B, 3 * H)[order], first, axis=0)
            g |= {"U" + d: gU, "b" + d: by_byte.sum(axis=0), "W" + d: p["E"].T @ by_byte}
            g["E"] += by_byte @ p["W" + d].T
        return loss, g

    def fit(self, texts: list[bytes], y: np.ndarray, span: int = 64, epochs: int = 2, batch: int = 256, rate: float = 0.02, seed: int = 11, least_steps: int = 240) -> float:
        """Adam over batches of runs of `span` bytes of the texts, classes alike; little text is gone through more often,
        for `least_steps` steps."""
        r = np.random.default_rng(seed)
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = np.cumsum([0, *map(len, texts)])
        start = np.concatenate([np.arange(a, b, span) for a, b in zip(at, at[1:])])
        of = np.repeat(np.arange(len(texts)), [-(-len(t) // span) for t in texts])
        lens, label = np.minimum(span, at[of + 1] - start), y[of]
        weight = (1 / np.maximum(np.bincount(label, lens, self.classes), 1))[label]
        m1, m2, step, loss = {k: 0 for k in self.p}, {k: 0 for k in self.p}, 0, 0.0
        parts = -(-len(start) // batch)
        total = max(epochs * parts, least_steps) if len(start) else 0
        while step < total:
            order = r.permutation(len(start))
            for k in range(0, len(order), batch):
                ids = order[k : k + batch]
                loss, g = self.gradients(self.batch(data, start[ids], lens[ids]), lens[ids], label[ids], weight[ids])
                step += 1
                eta = rate * (1 - 0.95 * min(1.0, step / total))
                norm = max(1.0, np.sqrt(sum(float((v * v).sum()) for v in g.values())))
                for k2, v in g.items():
                    v = v / norm
                    m1[k2] = 0.9 * m1[k2] + 0.1 * v
                    m2[k2] = 0.999 * m2[k2] + 0.001 * v * v
                    self.p[k2] -= (eta * (m1[k2] / (1 - 0.9**step)) / (np.sqrt(m2[k2] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                if step >= total:
                    break
        return loss

    def pooled(self, texts: list[bytes], batch: int = 1024, core: int = CORE, edge: int = EDGE) -> np.ndarray:
        """For each text the sum over all its bytes of the label probabilities."""
        out = np.zeros((len(texts), self.classes))
        cut = [windows(t, core, edge) for t in texts]
        at = np.cumsum([0, *map(len, texts)])
        of = np.repeat(np.arange(len(texts)), list(map(len, cut)))
        if not len(of):
            return out
        rows = np.array([w for c in cut for w in c], np.int64)
        start, lens, lead = rows[:, 0] + at[of], rows[:, 1] - rows[:, 0], rows[:, 2]
        data = np.frombuffer(b"".join(texts), np.uint8)
        order = np.argsort(lens, kind="stable")  # like lengths go together
        for k in range(0, len(order), batch):
            ids = order[k : k + batch]
            p = self.probabilities(self.batch(data, start[ids], lens[ids]), lens[ids])
            t = np.arange(len(p))[:, None]
            held = (t >= lead[ids]) & (t < np.minimum(lead[ids] + core, lens[ids]))
            np.add.at(out, of[ids], np.einsum("tlb,tb->bl", p, held.astype(np.float32)))
        return out


class LanguageModel:
    """Learned languages and their network; labels whole texts."""

    def __init__(self, languages: list[str], net: ByteGRU):
        self.languages, self.net = languages, net

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        import regex

        letter = regex.compile(r"\p{L}").search
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and letter(t)] if self.languages else []
        sums = self.net.pooled([texts[i].encode("utf-8", "ignore") for i in known])
        for i, s in zip(known, sums):
            k = int(s.argmax())
            names[i], scores[i] = self.languages[k], min(1.0, float(s[k] / s.sum()))
        return names, scores


def fit(labelled: DataFrame, documents: int = TRAIN_DOCUMENTS) -> LanguageModel:
    """Fit on labelled (doc_id, text, lang). Bounded: of each language, however many there are, the `documents` documents
    with the lowest hash of doc_id, with their whole texts. Rows without lang, doc_id or text aren't read. Each language
    weighs alike. No such row: a model that knows no language."""
    have = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    have = have.select("lang", F.xxhash64("doc_id").alias("h"), F.xxhash64("doc_id", "text").alias("t"), "text")
    order = Window.partitionBy("lang").orderBy("h", "t")
    ids = have.select("lang", "h", "t").withColumn("k", F.row_number().over(order)).where(F.col("k") <= documents)
    ids = ids.groupBy("lang", "h", "t").agg(F.min("k").alias("k"))  # repeated rows count once
    rows = sorted({(r["lang"], r["k"], r["text"]) for r in have.join(F.broadcast(ids), ["lang", "h", "t"]).collect()})
    languages = sorted({r[0] for r in rows})
    texts = [(languages.index(lang), text.encode("utf-8", "ignore")) for lang, _, text in rows if text]
    if not texts:
        return LanguageModel([], ByteGRU(1))
    net = ByteGRU(len(languages))
    net.fit([t for _, t in texts], np.array([k for k, _ in texts]))
    return LanguageModel(languages, net)


def identify(df: DataFrame, model: LanguageModel, id_columns: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """id columns, lang_pred and score for every row of df, from the whole text alone.

    The network labels every byte of the text; a document's distribution is the mean over its positions, score the
    winner's share (ties: the first language by name). Null texts and texts without letters: `und`, score 0. Repeated
    rows give repeated rows, an empty table none. Very long texts go through the network some windows at a time.
    Narrow: no shuffle.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            at = 0
            while at < batch.num_rows:
                part, size = [], 0
                while at + len(part) < batch.num_rows and size < 2_000_000:
                    part.append(texts[at + len(part)].as_py())
                    size += len(part[-1] or "")
                lang, score = model.predict(part)
                ids = [batch.column(k).slice(at, len(part)) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*(f"c{k}" for k in range(len(ids))), "lang_pred", "score"])
                at += len(part)

    kinds = [df.schema[c].dataType.simpleString() for c in id_columns]
    out = df.select(*id_columns, text_column).mapInArrow(run, ", ".join([f"c{k} {t}" for k, t in enumerate(kinds)] + ["lang_pred string", "score double"]))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(id_columns)], "lang_pred", "score")


def fit_on_rest(documents: DataFrame) -> LanguageModel:
    return fit(documents.where(~held_out(F.col("doc_id"))))


def keep_identified(documents: DataFrame, model: LanguageModel, least: float = 0.4) -> DataFrame:
    """documents, all columns, without those that the model rejects: no letters at all, or no language has `least` of
    the bytes (text in none of the learned languages, or an even mixture)."""
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_whole"), F.col("text").alias("_text"))
    scored = identify(whole, model, ("_whole",), "_text")
    return scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("_whole.*")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit_on_rest(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
