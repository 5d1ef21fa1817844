import random

import corpus_pipeline
from graphloom.llm import decontaminate, quality, topk_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def long_documents(spark):
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(120_000)]
    texts = [" ".join(words), " ".join(words[:60_000]), " ".join(words[:-3] + ["x"]), "short text of few words", "x" * 300_000, None, ""]
    return words, spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def test_contamination_and_quality_of_very_long_texts(spark):
    words, docs = long_documents(spark)
    items = [(1, " ".join(words[40_000:40_500])), (2, " ".join(words[70_000:70_013])), (3, "x" * 300_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, [tuple(s) for s in r.spans]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got[0] == (120_000, 513, ["1", "2"], [(40_000, 40_500), (70_000, 70_013)])
    assert got[1] == (60_000, 500, ["1"], [(40_000, 40_500)]) and got[4] == (1, 1, ["3"], [(0, 1)]) and got[3][1] == 0 and got[5] == (0, 0, [], [])
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[1].split() == words[:40_000] + words[40_500:60_000] and cut[4] == "" and cut[5] is None
    rows = quality.features(docs)
    labels = spark.createDataFrame([(0, 1), (1, 1), (3, 0), (4, 0)], "doc_id long, quality int")
    assert quality.score(rows, quality.fit(rows, labels, moved=1)).count() == 7


def test_stages_take_very_long_texts(spark, tmp_path):
    words, docs = long_documents(spark)
    spark.createDataFrame([(1, " ".join(words[100_000:110_000]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert ids[0] == {0, 1, 3, 4} | ({2} & ids[0]) and 2 in ids[0]
    assert ids[1] == {0, 1, 3, 4}  # 2 is a near copy of 0, half of 0 is none
    # 0 loses the half that 1 has too, 1 all of it, 4 repeats itself
    assert ids[2] == {0, 3} and ids[3] == {3} and ids[4] == {3}


def test_long_vectors(spark):
    rows = [(0, [1.0] * 5000), (1, [0.5] * 5000), (2, [-1.0] * 4999), (3, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.rank, r.vec_id): r.score for r in topk_search.top_k(df).collect()}
    assert got == {(1, 1): 64 * 32 * 5000, (2, 3): 0, (3, 2): -64 * 64 * 4999}
