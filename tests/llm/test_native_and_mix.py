import hashlib
import re

import pytest

from graphloom.llm import decontaminate as dc
from graphloom.llm import mix_sources as mx


def norm(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items, n=13):
    win = {}
    for i, t in items:
        w = norm(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            win.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = norm(t), set(), set()
        for length in {len(g) for g in win}:
            for k in range(len(w) - length + 1):
                if tuple(w[k : k + length]) in win:
                    hit.update(range(k, k + length))
                    found |= win[tuple(w[k : k + length])]
        ids = sorted(map(str, found - {None}))
        out.append((d, len(w), len(hit), tuple(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def items(corpus):
    w = corpus[2][1].split()
    long = next(r[1] for r in corpus if r[1] and len(r[1].split()) == 3000).split()
    return [(1, " ".join(w[:40]).upper()), (2, corpus[45][1]), (3, "one"), (4, None), (5, "..."), (6, " ".join(long[100:113])), (10, " ".join(long[100:113])), (7, " ".join(w[3:8])), (None, "école ça va")]


def test_contamination_matches_brute_force(spark, documents, odd, corpus, empty):
    its = items(corpus)
    bench = spark.createDataFrame(its, "item_id long, text string")
    for df, limit in ((documents, dc.BROADCAST_BYTES), (odd, dc.BROADCAST_BYTES), (documents, 0)):
        got = sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in dc.contamination(df, bench, limit=limit).collect()], key=str)
        assert got == brute([(r.doc_id, r.text) for r in df.collect()], its)
    assert dc.contamination(empty, bench).count() == 0
    none = dc.contamination(documents, bench.limit(0)).collect()
    assert len(none) == len(corpus) and not any(r.n_hit or r.contaminated for r in none)


def test_removal_of_documents_and_spans(spark, documents, corpus, odd):
    bench = spark.createDataFrame(items(corpus), "item_id long, text string")
    bad = {r.doc_id for r in dc.contamination(documents, bench).where("contaminated").collect()}
    assert bad
    left = dc.decontaminate(documents, bench)
    assert left.columns == documents.columns and {r.doc_id for r in left.collect()} == {r[0] for r in corpus} - bad
    for how in ("documents", "spans"):
        own = dc.decontaminate(odd, bench, remove=how)
        assert own.columns == odd.columns and all(r["__key"] == r["__row"] == r["__spans"] == "?" for r in own.collect())
    cut = {r.doc_id: r.text for r in dc.decontaminate(documents, bench, remove="spans").collect()}
    hits = {r.doc_id: r for r in dc.contamination(documents, bench).collect()}
    for d, t, *_ in corpus:
        if not hits[d].n_hit:
            assert cut[d] == t
        else:
            assert len(norm(cut[d])) == hits[d].n_words - hits[d].n_hit
    with pytest.raises(ValueError):
        dc.decontaminate(documents, bench, remove="x")


def test_mixing_meets_targets(spark, documents, odd, empty):
    for df in (documents, odd):
        rows = mx.mix(df).collect()
        assert len(rows) == df.count()
        by = {}
        for r in rows:
            assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
            x = by.setdefault(r.source, [0, 0, r.target, r.source_size, 0])
            x[0] += r.size
            x[1] += r.taken
            x[4] = max(x[4], r.size)
        names = sorted(by, key=lambda s: (s is None, s or ""))
        total = sum(x[0] for x in by.values())
        caps, w = [2 * by[s][0] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))]
        want, free, rest = [None] * len(names), set(range(len(names))), 1.5 * total
        while free:  # water filling
            level = rest / sum(w[i] for i in free)
            full = {i for i in free if caps[i] < level * w[i]}
            for i in full or free:
                want[i] = min(caps[i], level * w[i])
            rest -= sum(want[i] for i in full)
            free = free - full if full else set()
        for s, t in zip(names, want):
            assert by[s][0] == by[s][3] and by[s][2] == pytest.approx(t) and abs(by[s][1] - t) <= by[s][4] / 2 + 1
        assert sorted(map(str, rows)) == sorted(map(str, mx.mix(df.repartition(3)).collect()))
    assert mx.mix(empty).count() == 0
    blank = mx.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert [(r.taken, r.target) for r in blank] == [(0, 0.0)] * 2


def test_digest_of_items(spark, documents, corpus, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items(corpus), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {d: (len(i), hashlib.sha256(",".join(i).encode()).hexdigest()) for d, _, _, i, _ in brute([(r[0], r[1]) for r in corpus], items(corpus))}
    for r in dc.op1_benchmark_decontamination(spark, str(tmp_path)).collect():
        assert (r.n_items, r.items_sha256) == want[r.doc_id]
