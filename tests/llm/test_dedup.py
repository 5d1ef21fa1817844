import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from graphloom.llm import bwt, components, rows, simhash
from graphloom.llm import substring_dedup as sub
from graphloom.llm import suffix_dedup as suf


def test_merged_transforms_find_repeats():
    r = random.Random(3)
    for _ in range(150):
        al = r.choice([b"ab", b"abc", b"a", bytes(range(245))])
        strings = [bytes(r.choices(al, k=r.randint(0, 40))) for _ in range(r.randint(1, 12))]
        strings += [r.choice(strings) for _ in range(r.randint(0, 3))]
        times, depth = [r.choice([1, 1, 2]) for _ in strings], r.choice([1, 2, 3, 5, 8])
        count = Counter()
        for s, t in zip(strings, times):
            for i in range(len(s) - depth + 1):
                count[s[i : i + depth]] += t
        want = [[count[s[i : i + depth]] >= 2 for i in range(len(s) - depth + 1)] for s in strings]
        assert [x.tolist() for x in bwt.repeated(strings, times, depth, r.choice([5, 20, 60, 1000]))] == want


def test_merge_orders_all_suffixes_and_gives_their_common_prefixes():
    r = random.Random(5)
    for _ in range(100):
        strings = [bytes(r.choices(r.choice([b"ab", b"abc", bytes(range(245))]), k=r.randint(0, 60))) for _ in range(r.randint(1, 9))]
        strings += [r.choice(strings)]
        shards = [bwt.build(strings[k : k + 3], k) for k in range(0, len(strings), 3)]
        string, offset, parted, _ = bwt.merge(shards, 64)
        suffixes = [strings[i][j:] for i, j in zip(string, offset)]
        assert suffixes == sorted(suffixes) and len(suffixes) == sum(map(len, strings))
        common = bwt.common_prefixes(strings, string, offset, parted, 64)
        for k in range(1, len(suffixes)):
            same = [a == b for a, b in zip(suffixes[k], suffixes[k - 1])]
            assert common[k] == (same + [False]).index(False)


def brute_bytes(texts, n):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("how", [{}, {"merge_all": True}, {"group": 1}, {"group": 3000, "length": 60, "gram": 16, "merge_all": True}])
def test_suffix_dedup_matches_brute_force(documents, odd, empty, how, monkeypatch):
    if how:
        monkeypatch.setattr(rows.attach, "__defaults__", ("left", 0))  # side tables by shuffle
    for df in (documents, odd):
        data = df.select("doc_id", "text").collect()
        want = sorted((str(r.doc_id), *x) for r, x in zip(data, brute_bytes([r.text for r in data], how.get("length", 200))))
        got = suf.without_repeats(df, **how).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert suf.without_repeats(empty, **how).count() == 0


def test_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suf, "BLOCK", 300)
    monkeypatch.setattr(suf, "SEGMENT", 50)
    r = random.Random(1)
    a = "".join(r.choices("abcdefgh", k=2500))
    texts = [a, "".join(r.choices("abcdefgh", k=500)) + a[700:1600], "x" * 1200, "ab" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1:] for r in suf.without_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert [tuple(got[i]) for i in range(4)] == brute_bytes(texts, 200)


def test_drop_repeats_keeps_columns(documents, odd):
    for df in (documents, odd):
        assert suf.drop_repeats(df).columns == df.columns
    out = {r.doc_id: r for r in suf.drop_repeats(documents).collect()}
    for r in out.values():
        assert r.text is None or r.n_chars == len(r.text)
    texts = [r.text for r in documents.collect()]
    copies = {r.doc_id for r in documents.collect() if r.text and len(r.text) > 200 and texts.count(r.text) > 1}
    assert copies and not copies & set(out)


def brute_words(data, n):
    first = {}
    split = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in data]
    for d, w in split:
        for k in range(len(w) - n + 1):
            if d is not None:
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if d is not None and first[tuple(w[k : k + n])] < d:
                gone[k : k + n] = [True] * n
        out.append((str(d), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


def test_substring_dedup_matches_brute_force(documents, odd, empty, monkeypatch):
    for df, side in ((documents, sub.attach.__defaults__[1]), (odd, 0)):
        monkeypatch.setattr(rows.attach, "__defaults__", ("left", side))
        want = brute_words([(r.doc_id, r.text) for r in df.collect()], 50)
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in sub.substring_dedup(df).collect())
        assert got == want
    assert sub.substring_dedup(empty).count() == 0


def test_extension_descends_where_rows_leave_the_reference(spark):
    """Texts that share a passage and differ around it in every way: no partner may be lost behind the first."""
    r = random.Random(8)
    core = [f"c{i}" for i in range(24)]
    left, right = [f"l{i}" for i in range(40)], [f"r{i}" for i in range(40)]
    texts = []
    for d in range(60):
        a, b = r.randint(0, 40), r.randint(0, 40)
        own = [f"x{r.randrange(3)}" for _ in range(r.randint(0, 30))]
        texts.append(" ".join([*own, *left[40 - a :], *core, *right[:b], *[f"y{r.randrange(3)}" for _ in range(r.randint(0, 30))]]))
    texts += [" ".join(["a b"] * 60), " ".join(["a b"] * 55 + core + ["a b"] * 40), " ".join(["a b"] * 30 + core + ["a b"] * 40)]
    df = spark.createDataFrame([(d % 50, t) for d, t in enumerate(texts)], "doc_id long, text string")
    want = brute_words([(r.doc_id, r.text) for r in df.collect()], 50)
    assert sum(x[2] for x in want) > 500
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in sub.substring_dedup(df).collect()) == want


def test_difference_cover():
    mask = sub.difference_cover()
    for i in range(31):
        for j in range(31):
            assert any(mask[(i + s) % 31] and mask[(j + s) % 31] for s in range(31))
    with pytest.raises(ValueError):
        sub.difference_cover(31, (1, 2, 3))


def brute_fp(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + n]).encode(), 42) for k in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("cell", [2000, 4])
def test_simhash_components_match_brute_force(spark, documents, cell, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", cell)
    r = random.Random(9)
    rows_ = [(x.doc_id, x.text) for x in documents.collect()]
    fps = {d: brute_fp(t, 3) for d, t in rows_}
    got = {x.doc_id: x for x in simhash.near_duplicates(documents, 3).collect()}
    assert {d: x.fp % (1 << 64) for d, x in got.items()} == fps
    near = [r.getrandbits(64) for _ in range(40)]
    near += [x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for x in near for _ in range(4)]
    near = sorted({x - (1 << 64) if x >> 63 else x for x in near})
    label = {x: x for x in near}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, x in enumerate(near):
        for y in near[:i]:
            if bin((x ^ y) % (1 << 64)).count("1") <= 3 and find(x) != find(y):
                label[max(find(x), find(y))] = min(find(x), find(y))
    edges = simhash.links(spark.createDataFrame([(x,) for x in near], "fp long"), 3, cell)
    got = {x.node: x.root for x in components.components(edges).collect()}
    groups = lambda m: sorted(map(sorted, [[x for x in near if m(x) == k] for k in {m(x) for x in near}]))
    assert groups(lambda x: got.get(x, x)) == groups(find)


def test_near_duplicates_of_odd_tables(odd, empty, documents):
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(empty).count() == 0 and simhash.similar_documents(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = {r.doc_id for r in simhash.keep_one(documents).collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert len({texts[i] for i in ids if texts[i]}) == len([i for i in ids if texts[i]])
    long = [i for i, t in texts.items() if t and len(t.split()) == 3000]
    assert len(ids & set(long)) == 1
    passages = [i for i, t in texts.items() if t and len(t.split()) == 110]
    assert set(passages) <= ids or len(passages) - len(ids & set(passages)) <= 1


def brute_shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("cell,part", [(4000, 1 << 20), (6, 400)])
def test_similar_documents_match_brute_force_on_both_sides(spark, monkeypatch, cell, part):
    """With small limits every meeting and every loose component is dealt out."""
    monkeypatch.setattr(simhash, "CELL", cell)
    r = random.Random(12)
    word, texts = lambda: f"v{r.randrange(10**6)}", []
    for size in [8, 9, 10, 14, 24, 44, 60, 100, 184, 400]:
        for _ in range(6):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for share in (0.7, 0.75, 0.79, 0.8, 0.81, 0.85):  # a changed end of k words changes k shingles of each text
                n = size - 4
                k = max(1, round(n * (1 - share) / (1 + share)))
                texts.append(" ".join(base[:-k] + [word() for _ in range(k)]))
            texts.append(" ".join(base[:-1]))
    for _ in range(6):  # one repeated line rules the words, but not the set
        line, a = [word() for _ in range(6)], [word() for _ in range(90)]
        texts += [" ".join(a + line * 5), " ".join(a + line * 60), " ".join([word() for _ in range(60)] + line * 60), " ".join([word() for _ in range(60)] + line * 60)]
    r.shuffle(texts)
    sets = [brute_shingles(t) for t in texts]
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x & y and near(x, y) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if z == high else z for z in label]
    assert any(4 * len(x | y) == 5 * len(x & y) for i, x in enumerate(sets) for y in sets[:i] if x & y)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(df, part=part).collect()}
    assert got == dict(enumerate(label))


def test_meeting_keys_grow_with_the_table():
    for n in (0, 1000, 10**6, 10**10):
        bits, keys = simhash.meeting_plan(n, 0.8)
        assert n / 2**bits <= 12 and (1 - (1 - 0.1515) ** bits) ** keys <= 1.1 * simhash.MISS


def test_filter_passes_what_it_holds(spark):
    r = np.random.default_rng(1)
    held, other = r.integers(-(2**63), 2**63 - 1, (2, 500), dtype=np.int64)
    table = rows.hash_filter(spark.createDataFrame([(int(x),) for x in held], "h long"), 20).value
    assert rows.passes(held, table).all() and rows.passes(other, table).mean() < 0.02 and len(table) == 1 << 14


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(1000, k) for k in range(100, 160)] + [(7, 7)]
    for size in (None, 7):
        got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long"), size).collect()}
        assert set(got) == {x for e in chain[:-1] for x in e}
    assert len({got[i] for i in range(1, 61)}) == 1 and got[1] != got[1000] and len({got[k] for k in [1000, *range(100, 160)]}) == 1
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_window_hashes_and_cover():
    codes = np.arange(1, 40, dtype=np.uint64)
    for n in (1, 2, 7, 13, 32):
        h = rows.doubled(codes, n, 31)
        want = [sum(int(c) * 31 ** (n - 1 - k) for k, c in enumerate(codes[i : i + n])) % (1 << 64) for i in range(len(codes) - n + 1)]
        assert h.tolist() == want


def test_shingle_sets_are_made_of_all_texts_together(monkeypatch):
    """Sets agree as sets of word sequences do, and no shingle or short word is hashed by a call of its own."""
    calls, digest = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x, seed: (calls.append(x), digest(x, seed))[1])
    r = random.Random(5)
    parts = ["a", "B", "\u00e9", "word", "WORD", "0" * 8, "0" * 9, "q" * 64, "q" * 65, "\ud800", "\x1c", "\u00a0"]
    texts = [None, "", " \n", "a", "a b", "A\tb c d e", "a b c d e f"] + [r.choice(["", " "]).join(r.choice(parts) + r.choice(["", " ", "\n\x0b"]) for _ in range(r.randint(0, 40))) for _ in range(80)]
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    want = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    got = simhash.shingle_sets(texts)
    assert [len(x) for x in got] == [len(x) for x in want] and all((x[1:] > x[:-1]).all() for x in got)
    assert all(len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j]) for i in range(len(texts)) for j in range(i))
    assert len(calls) == sum(len(w) > 64 for ws in words for w in ws)
    alone = [simhash._folded([x], 4) for x in got]
    assert (simhash.set_fingerprints(got, 4) == np.array(alone)).all()


def test_short_texts_are_hashed_together(monkeypatch):
    calls, hashes = [], suf.gram_hashes
    monkeypatch.setattr(suf, "gram_hashes", lambda data, gram: (calls.append(len(data)), hashes(data, gram))[1])
    r = random.Random(6)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 40))) for _ in range(60)]
    held = np.full(4, ~np.uint64(0), np.uint64)
    for length, gram in ((12, 4), (6, 6)):
        calls.clear()
        found, of = suf.chosen_grams(texts, length, gram)
        runs = list(suf.segments(texts, length, gram, held))
        assert len(calls) == 2
        chosen, windows = [], []
        for i, t in enumerate(texts):
            h = hashes(np.frombuffer(t, np.uint8), gram).tolist() if len(t) >= length else []
            low = [min(h[k : k + length - gram + 1]) for k in range(len(t) - length + 1)]
            chosen += [(np.uint64(x).view(np.int64), i) for k, x in enumerate(h) if x in low[max(0, k - length + gram) : k + 1]]
            windows += [(i, np.uint64(x).view(np.int64), k) for k, x in enumerate(low)]
        assert list(zip(found, of)) == chosen
        assert [(i, m, s + k) for i, m, s, n in runs for k in range(n)] == windows
