"""Token counts: pieces are counted once for each distinct pre-token and joined to per-document frequencies."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .base import table

#: Fixed values of the vocabulary file: its pre-token pattern, and the characters by which its byte-level alphabet
#: writes bytes (printable ones stand for themselves, the others follow from code point 256 on).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRINTABLE = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
#: Runs of what the vocabulary's patterns take for white space.
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Characters for which the vocabulary's normaliser (canonical composition, white space to one space, lower case) and
#: Python's own lower() and split() agree code point by code point.
PLAIN = r"[\t-\r\x20-\x7e\xa1-\xac\xae-\xff‐-‧‰-⁞€]*"
#: Distinct pre-tokens whose counts one task keeps; beyond it the store is emptied and filled anew.
KEPT_PRE_TOKENS = 1_000_000
#: Documents handled together. Their pre-token table is what a task holds besides the store.
BATCH_BYTES = 4_000_000
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Counts the ids that a word-end BPE vocabulary gives for texts, without making the ids of texts.

    A text is cut at the vocabulary's special strings, which count one each, and at white space, which no pre-token
    spans and across which normalising moves nothing. Each distinct run is normalised and cut to pre-tokens once, the
    pieces of each distinct pre-token are counted once, and a text's count is the sum of frequency times pieces. Runs of
    PLAIN characters are normalised by Python, all others by the vocabulary's own normaliser and pre-tokeniser.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(not t.special or t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError(f"{path}: added tokens that take in what is around them are not supported")
        special = sorted((t.content for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.plain = regex.compile(PLAIN).fullmatch
        self.white = regex.compile(WHITE).split
        self.find = regex.compile(PRE_TOKEN).findall
        others = [b for b in range(256) if b not in set(PRINTABLE)]
        self.alphabet = str.maketrans({b: chr(256 + k) for k, b in enumerate(others)})
        self.runs: dict[str, int] = {}
        self.others: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def _pieces(self, token: str) -> int:
        """token: written in the byte-level alphabet."""
        n = self.pieces.get(token)
        if n is None:
            n = self.pieces[token] = len(self.tokenizer.model.tokenize(token))
        return n

    def _run(self, run: str) -> int:
        return sum(self._pieces(t.encode().decode("latin-1").translate(self.alphabet)) for t in self.find(run))

    def _other(self, run: str) -> int:
        t = self.tokenizer
        return sum(self._pieces(x) for x, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(run)))

    def count(self, texts: list[str | None]) -> list[int]:
        tables: list[tuple[int, Counter, Counter]] = []
        for text in texts:
            parts = self.special.split(text or "") if self.special else [text or ""]
            low, other = Counter(), Counter()
            for part in parts:
                if self.plain(part):
                    low.update(part.lower().split())
                    continue
                for run, n in Counter(self.white(part)).items():
                    if self.plain(run):
                        low[run.lower()] += n if run else 0
                    else:
                        other[run] += n
            tables.append((len(parts) - 1, low, other))
        if len(self.runs) + len(self.others) > KEPT_PRE_TOKENS:
            self.runs.clear(), self.others.clear(), self.pieces.clear()
        for k, (held, make) in enumerate(((self.runs, self._run), (self.others, self._other)), 1):
            for run in {r for x in tables for r in x[k] if r not in held}:
                held[run] = make(run)
        return [special + sum([n * self.runs[r] for r, n in low.items()]) + sum([n * self.others[r] for r, n in other.items()]) for special, low, other in tables]


def token_counts(df: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048) -> DataFrame:
    """One row for each row of df: the id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows give repeated rows, an empty table none. Other columns
    are not read. Narrow: no shuffle; a task holds one batch of texts, or one very long text, and a bounded store of
    piece counts.
    """
    path = path or vocabulary_path()

    def counted(batches):
        counter = PieceCounter(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                part, size = [], 0
                while at + len(part) < len(texts) and size < BATCH_BYTES:
                    part.append(texts[at + len(part)].as_py())
                    size += len(part[-1] or "")
                n = counter.count(part)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array([len((t or "").encode()) for t in part], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["id", "n_bytes", "n_tokens", "over_limit"],
                )
                at += len(part)

    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(id_column, text_column).mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_column)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
