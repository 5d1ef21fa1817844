import corpus_pipeline
from graphloom.llm.queries import ORACLES, QUERIES


def test_every_operator_is_registered():
    import re

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_stages_keep_clean_documents(spark, documents, corpus, tmp_path):
    spark.createDataFrame([(1, corpus[2][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids, before = [], docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert before.columns == docs.columns, name
        ids.append({r.doc_id for r in before.select("doc_id").collect()})
    texts = {r[0]: r[1] for r in corpus}
    blank = {d for d, t in texts.items() if not t or not any(c.isalpha() for c in t)}
    assert ids[0] == set(texts) - blank
    copies = {d for d, t in texts.items() if t and any(t == u for e, u in texts.items() if e < d)}
    assert not ids[1] & copies and 0 in ids[1]
    assert ids[2] <= ids[1] and 2 in ids[2] and 2 not in ids[3]
    assert ids[4] == ids[3]
    alone = {d for d in range(4, 30) if texts[d] not in [u for e, u in texts.items() if e != d]}
    assert alone <= ids[4]


def test_run_gives_a_row_for_each_document_left(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r.taken <= 2 * r.size for r in rows)


def test_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_match_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept of the smallest tables, against the plainest version of it."""
    import duckdb
    from test_dedup import brute_bytes, brute_shingles
    from test_native_and_mix import brute

    from graphloom.llm.mix_sources import MIX_SQL

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
    # near copies: one document of each group
    rows = sorted(kept[0], key=lambda r: r.doc_id)
    sets = [brute_shingles(r.text) for r in rows]
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if label[i] != label[j] and (x == y or (x & y and 5 * len(x & y) >= 4 * len(x | y))):
                low, high = sorted((label[i], label[j]))
                label = [low if z == high else z for z in label]
    assert {r.doc_id for r in kept[1]} == {rows[i].doc_id for i in set(label)}
    # repeated bytes
    rows = sorted(kept[1], key=lambda r: r.doc_id)
    import hashlib

    left = {r.doc_id: r.text for r in kept[2]}
    for r, (n, gone, _, digest) in zip(rows, brute_bytes([r.text for r in rows], 200)):
        if not gone:
            assert left[r.doc_id] == r.text
        elif r.doc_id not in left:
            assert gone > 0.9 * n
        elif "�" not in left[r.doc_id] and len(left[r.doc_id].encode()) == n - gone:
            assert hashlib.sha256(left[r.doc_id].encode()).hexdigest() == digest
        else:  # half a character goes with the rest
            assert n - gone - 8 <= len(left[r.doc_id].encode()) < n - gone
    # contaminated documents
    clean = {d for d, *_, bad in brute([(r.doc_id, r.text) for r in kept[2]], items) if not bad}
    assert {r.doc_id for r in kept[3]} == clean
    # the mix
    c = duckdb.connect()
    c.execute(f"CREATE VIEW left_over AS SELECT * FROM '{tmp_path}/benchmark_decontamination/*.parquet'")
    want = c.execute("WITH " + MIX_SQL.replace("{documents}", "left_over") + "SELECT doc_id, size, source_size, copies FROM mixed ORDER BY doc_id").fetchall()
    assert sorted((r.doc_id, r.size, r.source_size, r.copies) for r in kept[4]) == want
