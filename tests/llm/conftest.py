import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Texts with copies, near copies, shared passages, nulls, blanks, odd characters and a long one."""
    r = random.Random(4)
    passage = " ".join(words(r, 70, 10_000))
    texts = [" ".join(words(r, r.randint(1, 200), 10_000)) for _ in range(30)]
    texts[0], texts[2], texts[3] = (" ".join(words(r, 120, 10_000)) for _ in range(3))
    texts += [texts[0], texts[0], texts[3], None, "", "  \n\t ", "!!! 123 ???", "one", "Été à l'école — ÇA VA", "\x00\x01 bytes"]
    long = words(r, 3000, 10_000)
    texts += [" ".join(long), " ".join(long[:2990] + ["changed"] * 10)]
    texts += [" ".join(words(r, 20, 10_000)) + " " + passage + " " + " ".join(words(r, 20, 10_000)) for _ in range(6)]
    texts += ["ing " * 120, "na " * 60 + "batman " * 80, passage, passage + " " + passage]
    base = words(r, 150, 10_000)
    texts += [" ".join(base), " ".join(base[:80] + ["x"] + base[81:]), " ".join(base).upper()]
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


@pytest.fixture(scope="session")
def odd(spark, corpus):
    """Repeated rows, a repeated and a null doc_id, and extra columns whose names the operators use inside."""
    rows = [*corpus[:12], corpus[0], corpus[5], (5, "another text of document five", "en", "s1", 1), (None, corpus[1][1], None, None, None), (None, None, None, None, None)]
    extra = ["_row", "_key", "_id", "h", "all", "spans", "starts", "score", "lang_pred", "fp", "node", "w0", "u", "rid", "slice", "copies", "_whole", "_left", "hashes", "__key", "__row", "__spans", "__id", "id", "row", "whole", "c0", "n", "m", "g", "p", "at", "key", "t", "cell"]
    return spark.createDataFrame([(*r, *["?"] * len(extra)) for r in rows], DOCS + ", " + ", ".join(f"{c} string" for c in extra))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
