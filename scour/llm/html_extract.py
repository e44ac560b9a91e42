"""Main text of web pages: maximum-scoring subsequence over words and tags.

A page is a sequence of words and tags. Words score positive, tags negative,
and Kadane's linear scan finds the contiguous region of largest sum; its blocks
are the text. The weights are log ratios of how often a token occurs inside and
outside the content of labelled pages. A page is its own label where its markup
names the content (``article`` or ``main``); those two tags, which on labelled
pages stand nowhere else, come out with a large positive weight. All labelled
pages are counted (what is taken out beforehand is not): each task sends one row per kind of token, the driver gets a
table of fixed size (the known tags).

Before the scan, elements that are never content are taken out with all they
hold: scripts, styles, forms, navigation, asides, page headers and footers, and
elements that are hidden or whose class, id or role names one of these, an
advert, a notice or reader comments. A word in the class, id or label of an
``article`` or ``main``, or of what holds one, says something of its looks: only
the name of reader comments takes these out.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: element names of the HTML standard, by their role here
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe xmp svg math".split())
DROPPED = RAW | set("head nav footer aside form button select option dialog menu label object "
                    "canvas audio video map noembed noframes".split())
BLOCKS = set("address article aside blockquote body center dd details dir div dl dt fieldset "
             "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
             "menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
INLINE = set("a abbr b bdi bdo big cite code del dfn em font i img ins kbd mark q s samp small "
             "span strike strong sub sup time tt u var br wbr".split())
CONTENT = {"article", "main"}
#: Of what is taken out, elements that are written around whole pages too: they
#: stay where an article or main lies inside.
WRAPPERS = set("form label object map dialog".split())
#: Words in class, id or role that name boilerplate.
NAMED = set("nav navbar navigation menu sidebar aside footer masthead banner ad ads advert "
            "adverts advertisement adsense sponsor sponsored promo promotion cookie cookies consent "
            "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
            "login comment comments commentlist disqus reply replies respond share sharing social "
            "related recommended recommendations breadcrumb breadcrumbs pagination pager widget "
            "widgets toolbar skip search copyright legal disclaimer complementary contentinfo "
            "dialog".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: A class or id that is wholly the name of reader comments.
COMMENTS = re.compile(r"(?:div-)?(?:comments?|commentlist|disqus|repl(?:y|ies)|respond)"
                      r"(?:[-_](?:\d+|list|body|area|section|content|item|thread|wrapper|container|form|respond))*", re.I)
ENDED_BY_NEXT = ("li", "td", "th", "tr", "dd", "dt", "option")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
KINDS = [*sorted(BLOCKS | INLINE), "other"]
#: Smallest size of a weight, and the prior: counts added to either side.
LEAST, PRIOR = 0.02, 5.0
#: The prior weight counts as so many sightings of a token: words count, prose
#: tags hardly, lists and tables a little, links, containers and others more.
SIGHTINGS = 100
PRIOR_WEIGHTS = ({"text": 1.0, "link": 0.1, "a": -1.0}
                 | dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split(), -0.05)
                 | dict.fromkeys("ul ol li dl dt dd table tbody tr td th".split(), -0.25))
#: Largest size of the weight of a word, a tag, and the start or end of content:
#: one rare tag should not outweigh a sentence.
MOST_WORD, MOST_TAG, MOST_CONTENT = 1.0, 3.0, 25.0


def attributes_of(tag: str) -> dict[str, str]:
    """The attributes of a start tag by name; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for key, value in ATTRIBUTE.findall(tag):
        found.setdefault(key.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return found


def named_boilerplate(attributes: str, in_article: bool) -> str:
    """"all" if the element is hidden or its role or reader comments say that it is
    no content, "name" if only a word in its class, id or label does, or ""."""
    found = attributes_of(attributes)
    if found.get("hidden", "until-found").lower() != "until-found" or (
            found.get("aria-hidden", "").strip().lower() == "true"):
        return "all"
    said = ""
    for key in ("role", "class", "id", "aria-label"):
        words = {w.lower() for w in PARTS.findall(found.get(key, ""))}
        if words & NAMED or ("header" in words and not in_article):
            if key == "role" or (key in ("class", "id") and any(
                    COMMENTS.fullmatch(w) for w in found[key].split())):
                return "all"
            said = "name"
    return said


def holds_content(page: str, at: int, name: str, outer: set[str], known: dict[int, bool]) -> bool:
    """Is there an article or main in the element whose start tag ends at ``at``?
    ``known`` keeps the answers for all elements passed on the way."""
    if at in known or name == "p":
        return known.get(at, False)
    open_now = [(name, at)]

    def close(n: str) -> None:
        while open_now:
            m, place = open_now.pop()
            known[place] = False
            if m == n:
                return

    while open_now:
        m = TOKEN.search(page, at)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        n = m[2].lower()
        if m[1]:
            if any(k == n for k, _ in open_now):
                close(n)
            elif n in outer:
                break
            continue
        if n in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(n)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if n in BLOCKS and any(k == "p" for k, _ in open_now):
            close("p")
        if n in ENDED_BY_NEXT and open_now and open_now[-1][0] == n:
            close(n)
        if n in CONTENT and open_now:
            known.update((place, True) for _, place in open_now)
            return True
        if n not in VOID and not m[3].endswith("/") and open_now:
            open_now.append((n, at))
    known.update((place, False) for _, place in open_now)
    return False


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, text, inside labelled content) of what is not taken out: kind is
    "text", "link" (text of a link) or a tag name ("/name": its end)."""
    stack: list[tuple[str, bool]] = []                    # name, taken out
    out = links = inside = articles = at = 0
    end = len(page)
    known: dict[int, bool] = {}

    def close(name: str) -> Iterator[tuple[str, str, bool]]:
        nonlocal out, links, inside, articles
        if not any(n == name for n, _ in stack):
            return
        while stack:
            n, gone = stack.pop()
            out -= gone
            links -= n == "a"
            if not gone and not out:
                yield "/" + n, "", inside > 0
            inside -= n in CONTENT
            articles -= n == "article"
            if n == name:
                return

    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not out:
            yield ("link" if links else "text"), page[at:stop], inside > 0
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            yield from close(name)
            continue
        if name in RAW and not m[3].endswith("/"):        # up to its end tag, unread
            close_at = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close_at.end() if close_at else end
            continue
        if name in BLOCKS and any(n == "p" for n, _ in stack):
            yield from close("p")
        if name in ENDED_BY_NEXT and stack and stack[-1][0] == name:
            yield from close(name)
        if name in VOID:
            if not out:
                yield name, "", inside > 0
            continue
        gone = name in DROPPED or (name == "header" and not articles)
        if name in WRAPPERS and not out and not articles and not m[3].endswith("/"):
            gone = not holds_content(page, at, name, {n for n, _ in stack}, known)
        if not gone and not out and name not in ("html", "body", "main"):
            said = named_boilerplate(m[3], articles > 0)
            gone = said == "all" or (said == "name" and name not in CONTENT and (
                m[3].endswith("/") or not holds_content(page, at, name, {n for n, _ in stack}, known)))
        inside += name in CONTENT
        articles += name == "article"
        if not gone and not out:
            yield name, "", inside > 0
        stack.append((name, gone))
        out += gone
        links += name == "a"
        if m[3].endswith("/"):
            yield from close(name)


def kind_of(name: str) -> str:
    if name in ("text", "link"):
        return name
    bare = name.lstrip("/")
    return name if bare in CONTENT else bare if bare in BLOCKS or bare in INLINE else "other"


def count_tokens(page: str) -> Counter:
    """(kind, inside) counts of a labelled page, of what the scan will see;
    empty for other pages."""
    found: Counter = Counter()
    for name, text, inside in tokens(page):
        if name[0] != "/":
            found[kind_of(name), inside] += len(text.split()) if name in ("text", "link") else 1
    return found if any(i for _, i in found) else Counter()


def weights_from(counts: dict[tuple[str, bool], float]) -> dict[str, float]:
    """Log ratio of the rates inside and outside, words held to [LEAST, MOST_WORD],
    tags to [-MOST_TAG, -LEAST], drawn to PRIOR_WEIGHTS while sightings are few.
    Tags of content are MOST_CONTENT; an end tag weighs as its start tag."""
    inside = sum(c for (_, i), c in counts.items() if i)
    outside = sum(c for (_, i), c in counts.items() if not i)
    out = {}
    for kind in ["text", "link", *KINDS]:
        a, b = counts.get((kind, True), 0), counts.get((kind, False), 0)
        prior = PRIOR_WEIGHTS.get(kind, -LEAST if kind in INLINE else -1.0)
        ratio = math.log((a + PRIOR) / (inside + PRIOR)) - math.log((b + PRIOR) / (outside + PRIOR))
        low, high = (LEAST, MOST_WORD) if kind in ("text", "link") else (-MOST_TAG, -LEAST)
        ratio = max(low, min(high, ratio))
        out[kind] = (ratio * (a + b) + prior * SIGHTINGS) / (a + b + SIGHTINGS)
    for kind in ["article", "main", "/article", "/main"]:
        out[kind] = MOST_CONTENT
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run of largest sum, the first and shortest
    of equal ones; (0, 0) if no run is positive."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def extract_text(page: str, weights: dict[str, float]) -> str:
    """Blocks of the best region, white space folded, joined by line ends."""
    found = list(tokens(page))
    word, link = weights["text"], weights["link"]
    scores = [len(t.split()) * (word if k == "text" else link) if t else
              0.0 if k in ("text", "link") else weights[kind_of(k)]
              for k, t, _ in found]
    start, end = best_region(scores)
    edge = lambda i: found[i][0].lstrip("/") in BLOCKS
    while 0 < start < end and not edge(start) and not edge(start - 1):
        start -= 1                                        # a block is taken whole
    while start < end < len(found) and not edge(end - 1) and not edge(end):
        end += 1
    blocks, parts = [], []
    for k, t, _ in [*found[start:end], ("/p", "", False)]:
        if k in ("text", "link"):
            parts.append(t)
        elif k in ("br", "wbr", "hr", "img"):
            parts.append("" if k in ("wbr", "img") else " ")
        elif k.lstrip("/") in BLOCKS:
            line = " ".join(htmllib.unescape("".join(parts)).split())
            if line:
                blocks.append(line)
            parts = []
    return "\n".join(blocks)


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Token weights from all labelled pages; a row per kind of token comes back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                total.update(count_tokens(page.as_py() or ""))
        rows = sorted(total.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for (k, _), _ in rows], pa.string()),
             pa.array([i for (_, i), _ in rows], pa.bool_()),
             pa.array([n for _, n in rows], pa.int64())], ["kind", "inside", "n"])

    counts = pages.select(F.col(html_col).alias("html")).mapInArrow(
        run, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return weights_from({(r.kind, r.inside): r.n for r in counts.collect()})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """page_id, url, text (empty if none), n_chars of every page.

    Null and empty pages have no text; pages without markup are one block;
    repeated rows come out repeated; other columns are not read; without
    labelled pages the prior weights hold."""
    weights = learn_weights(pages, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = [extract_text(p.as_py() or "", weights) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
