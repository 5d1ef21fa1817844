"""Exact dedup, the conversation trie and whitening against brute force, and their SQL where they have it."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from graphloom.llm import conversation_trie as ct
from graphloom.llm import exact_dedup as ed
from graphloom.llm import whitening as wh

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Exact dedup


def brute_groups(rows):
    """(doc_id, keep_id, group_size, sha) of each row, and the kept (doc_id, sha) of each text."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    best = {t: max(ds, key=lambda d: (d is not None, d or 0)) for t, ds in groups.items()}
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in groups}
    return sorted([(d, best[t or ""], len(groups[t or ""]), sha[t or ""]) for d, t in rows], key=str), sorted([(best[t], sha[t]) for t in groups], key=str)


@pytest.mark.parametrize("bucket,middle", [(ed.BUCKET, None), (4, None), (3, -1), (3, 10**9)])
def test_groups_match_brute_force(spark, documents, odd, empty, bucket, middle):
    for df in (documents, odd):
        found = ed.resolve(ed.digested(df.select("doc_id", "text"), []), bucket, middle).collect()
        every, kept = brute_groups([(r.doc_id, r.text) for r in df.collect()])
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in found], key=str) == every
        assert sorted([(r.doc_id, r.digest.hex()) for r in found if r.kept], key=str) == kept  # one of repeated rows
    assert ed.resolve(ed.digested(empty, []), bucket, middle).count() == 0


def test_dropped_copies_keep_columns_and_known_texts(spark, documents, odd, corpus):
    left = ed.drop_copies(odd)
    assert left.columns == odd.columns and all(r["whole"] == r["digest" if "digest" in odd.columns else "h"] == "?" for r in left.collect())
    assert left.count() == len({r.text or "" for r in odd.collect()})
    past = documents.where("doc_id < 20")
    index = ed.build_index(ed.winners(ed.digested(past, [])), 3)
    new = {bytes(r.digest) for r in ed.drop_known(documents, index, 3).collect()}
    known = {r[1] or "" for r in corpus if r[0] < 20}
    assert new == {hashlib.sha256(t.encode()).digest() for t in {r[1] or "" for r in corpus} - known}


def test_slots_are_minimal_and_strangers_are_told_by_their_bytes():
    r = np.random.default_rng(3)
    words = r.integers(0, 2**63, (5000, 4)).astype(np.uint64)
    words[:40, 0] = words[0, 0]  # digests that agree in part
    hashed = ed.PerfectHash.of(words)
    assert sorted(hashed.slots(words).tolist()) == list(range(5000))
    others = r.integers(0, 2**63, (5000, 4)).astype(np.uint64)
    slots = hashed.slots(others)
    assert (slots >= 0).mean() > 0.5  # so comparing the bytes is needed
    assert not any((words[np.argsort(hashed.slots(words))][s] == o).all() for s, o in zip(slots, others) if s >= 0)
    assert ed.PerfectHash.of(words[:0]).slots(words[:3]).tolist() == [-1] * 3


# Conversation trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    below = defaultdict(list)
    for n in members:
        for d in range(len(n) + 1):
            below[n[:d]].append(n)
    children = defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    saved = {n: (len(m) - 1) * (len(n[-1][1].encode()) if n else 0) for n, m in members.items()}
    out = []
    for n, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], sum(children[x] == 0 for x in below[n]), sum(saved[x] for x in below[n]), sha))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, whole string, key string"


def chats():
    r = random.Random(8)
    rows = []
    for c in range(120):
        for t in range(r.choice([1, 2, 3, 9, 14])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", r.choice(["hallo", "ünd", "a", ""]) if t else "hot", "?", "?"))
    rows += [(c, t, "user", f"same {t}", "?", "?") for c in range(200, 260) for t in range(5)]  # copies
    rows += [(300, t, None, f"long {t}", "?", "?") for t in range(400)] + [(301, t, None, f"long {t}", "?", "?") for t in range(380)]
    rows += [(400, None, "system", None, "?", "?"), (400, 3, None, None, "?", "?"), (None, 1, "user", "nobody's", "?", "?"), (403, 1, "user", "one", "?", "?")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts,run,wide", [(1, None, None), (1, 5, 3), (6, 7, 2), (40, 2, 1)])
def test_trie_matches_brute_force(spark, parts, run, wide):
    rows = chats()
    strings = ct.sequences(spark.createDataFrame(rows, TURNS))
    assert rows_of(ct.trie(strings, parts, run, wide)) == brute_trie([r[:4] for r in rows])


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert ct.trie(ct.sequences(spark.createDataFrame([], TURNS))).count() == 0
    bare = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)  # its base is absent, its one turn is left out
    got = rows_of(ct.trie(ct.sequences(spark.createDataFrame([(bare, 0, "user", "x", None, None)], TURNS))))
    assert got == [(bare, 0, None, 1, 0, 1, 0, hashlib.sha256(str(bare).encode()).hexdigest())]


def test_merged_runs_are_sorted_and_know_what_they_share(monkeypatch):
    monkeypatch.setattr(ct, "FAN", 3)
    r = random.Random(2)
    symbols = [bytes([k]) * ct.WIDTH for k in range(3)]
    rows = [(b"".join(r.choices(symbols, k=r.randrange(9))), c) for c in range(700)]
    out = list(ct.external_sort(iter(rows), 11))
    assert [x[:2] for x in out] == sorted(rows)
    assert [x[2] for x in out[1:]] == [ct.shared(a[0], b[0]) for a, b in zip(out, out[1:])]


# Whitening


def brute_white(vectors, top=16):
    """Deviations and whitened values (up to the sign of a component) by row, shares of the trace."""
    rows = [[np.floor(64 * float(c)) + 1e6 for c in v] for v in vectors]
    dims = max(map(len, rows))
    x = np.array([[int(c) for c in v] + [1_000_000] * (dims - len(v)) for v in rows], object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), object)
    n, s = len(fit), fit.sum(axis=0)
    z = np.array((fit * n - s) / n, float)
    values, u = np.linalg.eigh(z.T @ z / n)
    order = [k for k in np.argsort(-values)[:top] if values[k] > 1e-9 * max(values[-1], 1e-300)]
    return n, ((x * n - s) ** 2).sum(axis=1), np.array((x * n - s) / n, float) @ u[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize("rows,dims", [(300, 24), (9, 20)])
def test_whitening_matches_brute_force(spark, rows, dims):
    r = np.random.default_rng(5)
    vectors = (r.normal(0, 1, (rows, dims)) @ r.normal(0, 0.3, (dims, dims))).astype(np.float32).astype(float).tolist()
    data = [(k, v, "?") for k, v in enumerate(vectors)] + [(rows, vectors[0], "?"), (0, vectors[1], "?"), (rows + 1, vectors[2][:5], "?")]
    bad = [(-1, None, "?"), (-2, [1.0] * (dims - 1) + [float("nan")], "?"), (-3, [None] * dims, "?"), (-4, [float("-inf")] * dims, "?")]
    got = wh.whiten(spark.createDataFrame(data + bad, "vec_id long, embedding array<double>, x string")).collect()
    n, dev, white, share = brute_white([d[1] for d in data])
    k = white.shape[1]
    assert len(got) == k * len(data) and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    assert max(r.identity_error for r in got) < 1e-9 and max(abs(r.explained - share[r.component - 1]) for r in got) < 1e-9
    sign = {}
    for i, (vec, *_rest) in enumerate(data):
        own = [r for r in got if r.vec_id == vec and r.deviation == dev[i]]
        assert own
        for r in own:
            assert min(abs(abs(r.whitened) - abs(w[r.component - 1])) for d, w in zip(dev, white) if d == r.deviation) < 1e-7
            if vec not in (0, rows):
                sign.setdefault(r.component, set()).add(bool(r.whitened * white[i][r.component - 1] >= 0) if abs(r.whitened) > 1e-6 else None)
    assert all(len(s - {None}) == 1 for s in sign.values())  # one sign a component


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert wh.whiten(spark.createDataFrame([], schema)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, None), (2, [float("nan")])], schema)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [])], schema)).where("vec_id < 3").count() == 2  # () is (0, 0): one direction
    assert wh.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0])], schema)).count() == 0  # no variance
    far = wh.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (None, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert len(far) == 3 and {r.deviation for r in far if r.vec_id} == {2**63 - 1}


# SQL


@pytest.mark.parametrize("name,query,sql,read", [("op11", ed.op11_exact_dedup, ed.OP11_SQL, "documents"), ("op12", ct.op12_conversation_trie, ct.OP12_SQL, "conversations")])
def test_queries_match_their_sql(spark, name, query, sql, read):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {read} AS SELECT * FROM '{SMALL}/{read}.parquet'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    got = query(spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == sorted(result.fetchall(), key=str)


def test_whitening_query_reads_the_whole_table(spark):
    got = wh.op13_embedding_whitening(spark, SMALL)
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    n, dev, white, share = brute_white([v.embedding for v in vectors])
    by = defaultdict(dict)
    for r in got.collect():
        by[r.vec_id][r.component] = r
    assert sorted(by) == [v.vec_id for v in vectors]
    for v, d, w in zip(vectors, dev, white):
        rows = by[v.vec_id]
        assert len(rows) == 16 and all(r.deviation == d and r.n == n for r in rows.values())
        assert all(abs(abs(r.whitened) - abs(w[c - 1])) < 1e-8 and abs(r.explained - share[c - 1]) < 1e-9 for c, r in rows.items())
