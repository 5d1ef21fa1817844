"""HTML extraction by line-block distribution: strip markup to lines, sum text lengths over sliding line windows, find
where they surge and dive, keep the text between."""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

#: Lines a window spans; the part of a page's typical line that a window must reach to surge; on pages that mark their
#: article, what a character outside it counts.
WINDOW, SURGE, NEUTRAL = 3, 0.5, 0.0005
BLANKS = WINDOW + 1
BLANK = ("", 0, 0, False, False)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<raw>script|style|template|noscript|iframe|textarea|title)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/][^<>]*\Z|(?P<text>[^<]+|<)",
    re.S | re.I,
)
#: Dropped up to their end tag; self-closed or without a later end tag they are empty. All that a head can hold is raw
#: or void, so it needs no end.
_CUT = {t: re.compile(rf"</{t}\s*>", re.I) for t in "object svg math canvas video audio select".split()}
_ATTR = re.compile(r"\b(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAMES = re.compile(r"[a-z0-9]+")

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An end tag may be missing: a new element of the kind ends the open one.
_SINGLE = frozenset("p li dt dd tr td th option".split())
_BOILER_TAGS = frozenset("nav footer aside form menu dialog button".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_BOILER_NAMES = frozenset(
    "nav navbar navigation menu menubar topbar header masthead footer sidebar side aside ad ads adv advert adverts advertisement advertising adsense"
    " banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup"
    " login share sharing social comment comments respond reply replies disqus discussion related recommended recommendations breadcrumb breadcrumbs"
    " pagination pager widget widgets copyright legal disclaimer skip toolbar tags taglist hidden".split()
)
#: Elements that are text themselves: inside the article only these names make furniture of them.
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_ADVERT_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors cookie cookies comment comments breadcrumb breadcrumbs hidden".split())
_CONTENT_NAMES = frozenset("article articlebody content main post entry story body maincontent".split())


def _boiler(tag: str, attrs: str, in_content: bool) -> bool:
    """Is the element page furniture: menu, header, footer, sidebar, notice, advert, form, hidden part or comments?"""
    if tag in _BOILER_TAGS or (tag == "header" and not in_content):
        return True
    if not attrs:
        return False
    names: set[str] = set()
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if key == "role" and value in _BOILER_ROLES:
            return True
        if key in ("class", "id"):
            names.update(_NAMES.findall(value))
    if tag in ("html", "body", "article", "main"):
        return bool(names & {"comment", "comments", "ad", "ads", "advert", "related", "sponsored"}) and tag == "article"
    found = names & _BOILER_NAMES
    if in_content:
        found -= {"header", "side", "body", "tags", "legal", "banner"}
        if tag in _TEXT_TAGS:
            found &= _ADVERT_NAMES
    return bool(found) and not (names & _CONTENT_NAMES and found <= {"header", "side", "body"})


def lines(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """The page without markup as lines (text, characters inside links, container: 0 none, 1 main, 2 article, heading?,
    begun by a start tag?).

    Every block is a line; a boundary of blocks adds an empty line, a part of page furniture BLANKS of them."""
    out: list[tuple[str, int, int, bool, bool]] = []
    stack: list[tuple[str, bool, int]] = []  # open element, furniture?, container
    opened: Counter[str] = Counter()
    parts: list[str] = []
    links = 0
    anchor = 0
    boiler = 0
    own = False

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append((text, min(links, len(text)), stack[-1][2] if stack else 0, any(x[0] in _HEADINGS for x in stack[-3:]), own))
            parts.clear()
        links = 0

    def close(k: int) -> None:
        nonlocal boiler
        while len(stack) > k:
            tag, bad, _ = stack.pop()
            opened[tag] -= 1
            if bad:
                boiler -= 1
                if not boiler and tag in _BLOCK:
                    out.extend([BLANK] * BLANKS)

    at, endless = 0, set()
    while m := _TOKEN.search(page, at):
        at = m.end()
        text = m["text"]
        if text is not None or m["cdata"] is not None:
            if not boiler:
                text = text if text is not None else m["cdata"]
                parts.append(text)
                if anchor:
                    links += len(text)
            continue
        if m["raw"] is not None:
            parts.append(" ")
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _CUT:
            parts.append(" ")
            if not m["end"] and not m["attr"].endswith("/") and tag not in endless:
                if end := _CUT[tag].search(page, at):
                    at = end.end()
                else:
                    endless.add(tag)
            continue
        block = tag in _BLOCK
        if m["end"]:
            if block:
                flush()
            elif tag == "a":
                anchor = 0
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    close(k)
                    break
                if not block and stack[k][0] in _BLOCK:
                    break
            if block:
                out.append(BLANK)
                own = False
            continue
        if tag == "br":
            parts.append(" ")
            continue
        held = stack[-1][2] if stack else 0
        if block:
            flush()
            anchor = 0
            # inline elements that are still open, and an open paragraph, end here
            k = len(stack)
            while k and (stack[k - 1][0] not in _BLOCK or stack[k - 1][0] == "p"):
                k -= 1
            if k < len(stack):
                close(k)
            if tag in _SINGLE and stack and stack[-1][0] == tag:
                close(len(stack) - 1)
            out.append(BLANK)
            own = True
            held = stack[-1][2] if stack else 0
        elif tag == "a":
            anchor = 1
        if tag in _VOID or m["attr"].endswith("/"):
            continue
        bad = _boiler(tag, m["attr"], held > 0)
        if block or bad:
            if bad and not boiler and block:  # an inline one leaves its block in one piece
                flush()
                out.extend([BLANK] * BLANKS)
            boiler += bad
            role = 2 if tag == "article" else 1 if tag == "main" or re.search(r"\brole\s*=\s*[\"']?main\b", m["attr"], re.I) else 0
            if re.search(r"\bitemprop\s*=\s*[\"']?articleBody\b", m["attr"], re.I):
                role = 2
            stack.append((tag, bad, max(held, role)))
            opened[tag] += 1
    flush()
    return out


def thresholds(lengths: list[int]) -> float:
    """The surge of a page: SURGE of the length that half of its text reaches or exceeds line by line."""
    half, held = sum(lengths) / 2, 0
    for n in sorted(lengths, reverse=True):
        held += n
        if held >= half:
            return SURGE * n
    return 0.0


def weighted(found: list[tuple]) -> tuple[list[float], bool]:
    """What each line counts, and whether names part content from the rest.

    Names only weigh: furniture counts nothing (its lines are empty); where lines inside an article or main part hold
    half of the text or more, those outside count NEUTRAL of their length; characters of links count outside the article
    not at all."""
    marked = 2 * sum(len(x[0]) for x in found if x[2]) >= sum(len(t) for t, *_ in found) > 0
    if marked:
        return [float(len(t)) if c else NEUTRAL * max(len(t) - a, 0) for t, a, c, *_ in found], True
    return [float(max(len(t) - a, 0)) for t, a, *_ in found], False


def stretch(found: list[tuple], window: int = WINDOW) -> list[int]:
    """The lines of the main text, in order: from where sums over windows of lines surge to where they dive."""
    value, marked = weighted(found)
    surge = thresholds([len(t) for t, *_ in found if t])
    sums, run = [], 0.0
    for i in range(len(value)):
        run = sum(value[max(0, i - window + 1) : i + 1])
        sums.append(run)  # of the window that ends at line i
    high = [i for i, s in enumerate(sums) if s >= surge > 0]
    if not high:
        high = [max(range(len(sums)), key=sums.__getitem__)] if any(t for t, *_ in found) else []
    if not high:
        return []
    first, last = max(0, high[0] - window + 1), high[-1]
    while not value[first] and first < last:
        first += 1
    while not found[last][0] and last > first:
        last -= 1
    text = [i for i, x in enumerate(found) if x[0]]
    before, after = [i for i in text if i < first], [i for i in text if i > last]
    if marked:  # dives where lines count less than one character of the article
        while before and value[before[-1]] >= 1:
            first = before.pop()
        while after and value[after[0]] >= 1:
            last = after.pop(0)
        return [i for i in text if first <= i <= last and value[i] >= 1]
    # what runs up to the first window without a gap, from its last heading on; headings directly before
    k, edge = len(before), first
    while k and edge - before[k - 1] <= window:
        k -= 1
        edge = before[k]
        if found[edge][3]:
            first = edge
            break
    while first and (not found[first - 1][0] or found[first - 1][3]):
        first -= 1
    # lines after the last window that begin with their own block, up to the next gap
    while after and after[0] - last <= window and found[after[0]][4]:
        last = after.pop(0)
    return [i for i in text if first <= i <= last]


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The article of a page: its blocks in page order, joined by two line feeds; "" for null, empty or text-free pages.

    Lengths of lines, weighed by what elements and names say (weighted), are summed over sliding windows. Text surges
    with the first window that reaches the page's threshold (thresholds) and dives after the last; all between is kept,
    with the headings before. Where names mark the article, it dives only where lines count next to nothing. A page on
    which no window surges keeps its highest window. Links count only inside the article."""
    if not page:
        return ""
    found = lines(page)
    return "\n\n".join(found[i][0] for i in stretch(found, window))


def extract(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url"), html_column: str = "html") -> DataFrame:
    """The given columns, text and n_chars (code points) for every row of pages; narrow, one page at a time. Null and
    empty pages give an empty text; repeated rows give repeated rows."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*(f"c{k}" for k in range(len(kept))), "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in columns]
    out = pages.select(*columns, html_column).mapInArrow(run, ", ".join([f"c{k} {t}" for k, t in enumerate(kinds)] + ["text string", "n_chars long"]))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)], "text", "n_chars")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
