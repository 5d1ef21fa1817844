import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import html_text, language_id, quality, token_counts, topk_search


def test_pieces_match_the_library(spark, documents, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_counts.vocabulary_path())
    count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    for df in (documents, odd):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), count(r.text), count(r.text) > 2048) for r in df.collect())
        assert sorted((str(r[0]), *r[1:]) for r in token_counts.token_counts(df).collect()) == want
    assert token_counts.token_counts(empty).count() == 0
    r = random.Random(0)
    parts = ["a", "B", "é", "'s", "'LL", " ", "\n", "12", "½", "—", "<|endoftext|>", "<|", "İ", "Σ", "ß", "é", " ", "\x1c", "!?", "漢字", "🙂", "\x85", "²", "\x00"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(3000)]
    assert token_counts.PieceCounter(token_counts.vocabulary_path()).count(texts) == list(map(count, texts))


def test_store_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_PRE_TOKENS", 3)
    c = token_counts.PieceCounter(token_counts.vocabulary_path())
    assert c.count(["one two three", "four five"]) == [3, 2] and c.count(["six seven eight nine"]) == [4]


PAGE = """<html><head><title>x</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><div id="nav"><a href=/>Home</a> <a href=/a>About</a></div>
<div class="cookie-notice"><p>We use cookies to make everything better for you and everyone else around the world.</p></div>%s
<aside><p>Other things that are long enough to look like text but are in a sidebar of the page.</p></aside><form><input><p>Search me</p></form>
<section id="comments"><p>I think this is a very long reader comment that should not be in the text at all, really.</p></section><footer>&copy; 2020</footer></body></html>"""
BODY = "<h2>Title &eacute;</h2><p>First   paragraph with <b>bold</b> and <a href=x>link</a> text &lt;here&gt;, long enough to be seen as text.<p>Second<br>one.<ul><li>a<li>b</ul>"
WANT = "Title é\n\nFirst paragraph with bold and link text <here>, long enough to be seen as text.\n\nSecond one.\n\na\n\nb"


@pytest.mark.parametrize("around", ["<article>%s</article>", "<main>%s</main>", '<div class="wrap"><div class="post">%s</div></div>', "<article><header>%s</header></article>", "<ARTICLE CLASS='entry'>%s"])
def test_article_is_found(around):
    assert html_text.main_text(PAGE % (around % BODY)) == WANT


def test_odd_pages(spark):
    for page, want in [(None, ""), ("", ""), ("plain", "plain"), ("<p>", ""), ("<div class=ad>x", ""), ("<p>1 &lt; 2</p>", "1 < 2"), ("<article></article>", ""), ("<!-- a > b -->t", "t"), ("<p title='a>b'>t", "t")]:
        assert html_text.main_text(page) == want
    for page in ("<p " * 50_000, "<div>" * 20_000 + "x", "</p>" * 20_000, "<a href='" * 20_000, "<!--" * 20_000):
        html_text.main_text(page)  # in linear time
    df = spark.createDataFrame([(1, "u", PAGE % BODY, "z"), (1, "u", None, "z"), (None, None, "<p>é", "z")], "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.n_chars, len(r.text)) for r in html_text.extract(df).collect()) == sorted([("1", len(WANT), len(WANT)), ("1", 0, 0), ("None", 1, 1)])
    assert html_text.extract(df.limit(0)).count() == 0


def test_short_blocks_between_long_ones_are_kept_on_unmarked_pages():
    long = "<p>" + "A long paragraph of prose. " * 6 + "</p>"
    for part, want in [("<ul><li>%s</li><li>%s</li></ul>" % ("a" * 40, "b" * 45), ["a" * 40, "b" * 45]), ("<table><tr><td>x</td><td>y</td></tr></table>", ["x", "y"])]:
        assert html_text.main_text(long + part + long).split("\n\n")[1:-1] == want
    assert html_text.main_text("<p>menu</p><h1>Title</h1><div>" + long + "</div>").split("\n\n")[0] == "Title"


def brute_extract(found):
    """The rule of html_text.stretch for lines (text, link characters, content?, heading?, own block?), written out."""
    texts = [i for i, x in enumerate(found) if x[0]]
    if not texts:
        return []
    total, content = sum(len(found[i][0]) for i in texts), sum(len(found[i][0]) for i in texts if found[i][2])
    marked = content * 2 >= total
    value = {i: (len(t) if c else html_text.NEUTRAL * (len(t) - min(a, len(t)))) if marked else len(t) - min(a, len(t)) for i, (t, a, c, *_) in enumerate(found)}
    lengths = sorted((len(found[i][0]) for i in texts), reverse=True)
    typical = next(n for k, n in enumerate(lengths) if 2 * sum(lengths[: k + 1]) >= total)
    window = {i: value[i] + value.get(i - 1, 0) + value.get(i - 2, 0) for i in value}
    high = [i for i in window if window[i] >= typical / 2] or [max(window, key=lambda i: (window[i], -i))]
    inside = [i for i in range(max(0, high[0] - 2), high[-1] + 1)]
    low = next((i for i in inside if value[i]), inside[-1])
    up = next((i for i in reversed(inside) if found[i][0]), low)
    if marked:
        while (more := [i for i in texts if i < low]) and value[more[-1]] >= 1:
            low = more[-1]
        while (more := [i for i in texts if i > up]) and value[more[0]] >= 1:
            up = more[0]
        return [found[i][0] for i in texts if low <= i <= up and value[i] >= 1]
    at = low
    while (more := [i for i in texts if i < at]) and at - more[-1] <= 3:
        at = more[-1]
        if found[at][3]:
            low = at
            break
    while low and (not found[low - 1][0] or found[low - 1][3]):
        low -= 1
    while (more := [i for i in texts if i > up]) and more[0] - up <= 3 and found[more[0]][4]:
        up = more[0]
    return [found[i][0] for i in texts if low <= i <= up]


def test_extraction_matches_the_rule_written_out(spark):
    r = random.Random(6)

    def line():
        return " ".join(r.choice(["word", "in", "sentence", "a"]) for _ in range(r.choice([1, 2, 5, 40, 80])))

    pages = []
    for _ in range(600):
        parts = []
        for _ in range(r.randint(0, 12)):
            tag = r.choice(["p", "p", "p", "div", "h2", "li", "td"])
            text = line() if r.random() < 0.8 else f'<a href="x">{line()}</a>'
            parts.append(f"<{tag}>{text}</{tag}>" if r.random() < 0.9 else text)
        body = "".join(parts)
        cut = r.randint(0, len(parts))
        if r.random() < 0.4:
            kind = r.choice(["article", "main", "div", "section"])
            body = f"{''.join(parts[:cut])}<{kind}>{''.join(parts[cut:])}</{kind}><footer>{line()}</footer>{line()}"
        pages.append(body)
    pages += [x[0] for x in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    changed = 0
    for page in pages:
        found = html_text.lines(page)
        assert html_text.main_text(page) == "\n\n".join(brute_extract(found)), page
        changed += html_text.main_text(page) != "\n\n".join(x[0] for x in found if x[0])
    assert changed > 300  # without surge and dive every line would stay


def test_pages_without_names_keep_their_text(spark):
    import re
    from collections import Counter

    same = extra = lost = 0
    for page in [x[0] for x in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]:
        bare = re.sub(r"<(/?)(article|nav|footer|header|aside|main|section)\b[^>]*>", r"<\1div>", re.sub(r'\s(class|id|role|itemprop)="[^"]*"', "", page))
        a, b = Counter(html_text.main_text(page).split()), Counter(html_text.main_text(bare).split())
        both = sum((a & b).values())
        same, extra, lost = same + both, extra + sum(b.values()) - both, lost + sum(a.values()) - both
    assert same / (same + extra) >= 0.98 and same / (same + lost) >= 0.98


def test_elements_without_end_tags_keep_the_rest():
    for page in ("<html><head><title>x</title><meta a=b><body><p>text", "<html><head><title>x</title><script>'<p>'</script><p>text", "<svg class=i/><p>text", "<math/><p>text</p>", "<p><svg class=i><p>text", "<select><p>text", "<svg><title>x</title></svg><p>text"):
        assert html_text.main_text(page) == "text", page
    assert html_text.main_text("<p>one <svg><text>x</text></svg>two</p>") == "one two"
    html_text.main_text("<svg>" * 20_000 + "<object>" * 20_000)  # in linear time


def test_gradients_match_finite_differences():
    net = language_id.ByteGRU(3, 4, 5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, start, lens = np.frombuffer(b" ab  xyzzy  q ", np.uint8), np.array([0, 4, 11]), np.array([4, 7, 3])
    x = net.batch(data, start, lens)
    mask, y, w = np.arange(len(x))[:, None] < lens, np.array([0, 2, 1]), np.array([1.0, 2.0, 0.5])
    _, g = net.gradients(x, lens, y, w)
    r = np.random.default_rng(0)
    for name, p in net.p.items():
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in p.shape)
            if name == "E":
                at = (r.choice(x[mask]), at[1])
            old, e = p[at], 1e-3
            p[at] = old + e
            up = net.gradients(x, lens, y, w)[0]
            p[at] = old - e
            down = net.gradients(x, lens, y, w)[0]
            p[at] = old
            assert g[name][at] == pytest.approx((up - down) / (2 * e), rel=0.05, abs=2e-3)


def test_every_byte_is_labelled_as_by_the_network_written_out():
    net = language_id.ByteGRU(3, 4, 5)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def states(text, d):
        h, out = np.zeros(5), []
        for byte in text if d == "f" else text[::-1]:
            a, s = p["E"][byte] @ p["W" + d] + p["b" + d], p["U" + d] @ h
            z, r = 1 / (1 + np.exp(-(a[:5] + s[:5]))), 1 / (1 + np.exp(-(a[5:10] + s[5:10])))
            h = h + z * (np.tanh(a[10:] + r * s[10:]) - h)
            out.append(h)
        return out if d == "f" else out[::-1]

    texts = [b"", b"a", "Straße 12, été!".encode(), bytes(range(1, 120)), b"xy " * 50]
    for core, edge in ((224, 16), (20, 7)):
        want = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            assert sum(min(e - s - lead, core) for s, e, lead in language_id.windows(text, core, edge)) == len(text)
            for k in range(0, len(text), core):
                s = max(0, k - edge)
                piece = text[s : k + core + edge]
                for f, b in list(zip(states(piece, "f"), states(piece, "b")))[k - s :][:core]:
                    o = np.exp(p["V"] @ np.concatenate((f, b)) + p["c"][:, 0])
                    want[i] += o / o.sum()
        assert net.pooled(texts, 3, core, edge) == pytest.approx(want, rel=1e-4)


@pytest.fixture(scope="module")
def tongues(spark):
    r = random.Random(2)
    syllables = {"xx": ["ka", "to", "mi"], "yy": ["brr", "schl", "ung"], "zz": ["ñe", "llo", "ción"]}
    rows = []
    for i in range(150):
        lang = r.choice(list(syllables))
        text = " ".join("".join(r.choices(syllables[lang], k=r.randint(1, 3))) for _ in range(30))
        rows.append((i, text, lang if i % 10 else None, "s", 1))
    rows += [(1000, None, "xx", "s", 0), (1001, "123 !!", "xx", "s", 1), (1002, "", None, "s", 0), (None, "katomi", "xx", "s", 1), (1003, "ka" * 5000, "xx", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")


def test_language_of_held_out_documents(spark, tongues):
    model = language_id.fit_on_rest(tongues)
    got = language_id.identify(tongues, model, ("doc_id", "lang")).withColumn("held", language_id.held_out(F.col("doc_id"))).collect()
    assert len(got) == tongues.count()
    seen = [r for r in got if r.lang and r.doc_id is not None and r.doc_id < 1000 and r.held]
    assert seen and sum(r.lang == r.lang_pred for r in seen) >= 0.95 * len(seen)
    blank = {r.doc_id: r for r in got if r.doc_id in (1000, 1001, 1002)}
    assert all(r.lang_pred == "und" and r.score == 0 for r in blank.values())
    assert all(0 <= r.score <= 1 for r in got)
    kept = language_id.keep_identified(tongues, model)
    assert kept.columns == tongues.columns and not {1000, 1001, 1002} & {r.doc_id for r in kept.collect()}
    assert {r.doc_id for r in kept.collect()} >= {r.doc_id for r in seen}
    none = language_id.fit_on_rest(tongues.limit(0))
    assert {r.lang_pred for r in language_id.identify(tongues, none).collect()} == {"und"}


def test_cotraining_scores_held_out_documents(spark):
    r = random.Random(5)
    rows = []
    for i in range(400):
        good = i % 3 > 0
        w = [f"w{r.randrange(3000)}" for _ in range(80)] if good else [r.choice(["buy", "now", "!!!", "%%%"]) for _ in range(80)]
        rows.append((i, " ".join(w) + ".", "en", "good" if good and i % 2 else "mixed", len(w) * 3))
    docs = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", "en", "x", 0), (None, "text", "en", "x", 4)], "doc_id long, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 400, 2)] + [(5, None), (None, 1)], "doc_id long, quality int")
    own = quality.features(docs)
    model = quality.fit(own, labels, moved=30)
    assert len(model.rounds) == quality.ROUNDS and all(0 < n <= 60 for n in model.rounds)
    got = {x.doc_id: x for x in quality.score(own, model).collect()}
    test = range(1, 400, 2)
    assert sum((got[i].quality_score >= 0.5) == (i % 3 > 0) for i in test) >= 0.97 * len(test)
    assert all(0 <= x.quality_score <= 1 for x in got.values()) and len(got) == 403
    blank = quality.fit(own, labels.limit(0))
    assert quality.score(own, blank).count() == 403 and quality.score(quality.features(docs.limit(0)), model).count() == 0
    assert quality.score(quality.features(docs.drop("n_chars")), model).count() == 403
    # the surest documents are the surest of all
    rows = {r["rid"]: r for r in own.collect()}
    given = set(list(rows)[:40])
    found = quality._surest(own.repartition(5), model.views, 7, 4, given)
    for v, k in enumerate("ab"):
        s = sorted((float(model.views[v].raw(quality._open([[r[k + "i"]], [r[k + "v"]]]))[0]), rid) for rid, r in rows.items() if rid not in given)
        top = sorted((-x, rid) for x, rid in s)[:4]
        assert [(rid, y) for rid, y, _ in found[v]] == [(rid, 0.0) for _, rid in s[:7]] + [(rid, 1.0) for _, rid in top]


def brute_top(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(q, c)), j) for b, (j, c) in enumerate(ok) if b != a)[:k]
            out += [(i, n + 1, j, max(-(2**63), min(2**63 - 1, -v))) for n, (v, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("size,queries", [(4096, 512), (7, 3)])
def test_top_k_matches_brute_force(spark, monkeypatch, size, queries):
    monkeypatch.setattr(topk_search, "CANDIDATES", size)
    monkeypatch.setattr(topk_search, "QUERIES", queries)
    r = random.Random(8)
    rows = [(i, [r.choice([0.0, r.gauss(0, 1)]) for _ in range(6)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")]), (220, [float("inf")]), (240, []), (260, [3.0]), (None, [1.0]), (0, rows[0][1]), (-20, [0.5] * 9), (280, [1.0] * 6), (281, [1.0] * 6)]
    df = spark.createDataFrame([(*x, "?") for x in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    assert sorted(tuple(x) for x in topk_search.top_k(df).collect()) == brute_top([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 20)
    assert topk_search.top_k(df.limit(0)).count() == 0
    wide = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in topk_search.top_k(wide, k=2).orderBy("rank").collect()] == brute_top([(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [1.0, 1.0])], 2)


def test_inline_elements_and_names_of_paragraphs():
    """An inline element never splits its block; inside the article a paragraph isn't furniture for being called related."""
    tail = " more words" * 60
    page = f'<article><p>He said <label>word</label> yes.{tail}</p><p class="related">See also this.</p><p class="ad">Buy.</p><p>Press <button>OK</button>now.{tail}</p></article>'
    assert html_text.main_text(page) == f"He said word yes.{tail}\n\nSee also this.\n\nPress now.{tail}"


def test_top_k_broadcasts_no_block(spark, monkeypatch):
    """A query block for each candidate block, broadcast, grows with the square of the table."""
    monkeypatch.setattr(topk_search, "CANDIDATES", 7)
    monkeypatch.setattr(topk_search, "QUERIES", 2)
    rows = [(i, [float((i * k) % 11 - 5) for k in range(1, 4)]) for i in range(100)]
    found = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    assert sorted(tuple(x) for x in found.collect()) == brute_top(rows, 3)
