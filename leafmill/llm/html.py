"""HTML extraction by consensus host paths.

Each page's containers are scored by the text that stands in them; the scores are votes for the containers' generalised
tag-class paths, summed per host in Spark. From the winning path a host's pages vote, each with one vote, for the
containers around it, for as long as these add more article text than other text. The path so found says where every page
of the host has its article; pages without that path use their own best container.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stash, tidy, tune

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(>|\Z)|[^<]+|<", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")}

#: Elements that have no end tag. Fixed values of HTML.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())

#: Elements that begin and end a block. Fixed values of HTML.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())

#: Elements whose beginning ends an open paragraph. Fixed values of HTML.
ENDS_P = BLOCKS - frozenset("br td th tr tbody thead tfoot caption option optgroup title head html body".split())

#: What an element's beginning ends of its own kind, up to the list, table or box around it. Fixed values of HTML.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
_BOX = frozenset("ul ol menu dl table select div article section main aside body html".split())

#: Elements that are never article text.
DROPPED = frozenset("head nav footer aside form button select option input menu dialog svg math canvas object audio video map fieldset label script style noscript iframe template textarea title xmp noembed noframes".split())

#: Whole tokens of a class, id or role that mark what isn't article text.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo cookie cookies copyright disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination paywall popup print promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar widget widgets comment-list comments-area comment-respond cookie-banner cookie-consent cookie-notice page-header page-footer related-articles related-posts share-buttons site-footer site-header site-nav skip-link social-links social-share".split())

#: Elements that no class, id or role marks: a page's frame, whose classes tell of its layout, and the text's own lines.
KEPT = frozenset("html body main article h1 h2 h3 h4 h5 h6 p".split())

#: Elements that hold one whole article: a winning path inside one of them stands for all of it.
WHOLE = ("article", "main")

#: Blocks that are lines of a container rather than containers.
_LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th tr tbody thead tfoot br hr summary address".split())

#: Containers inside one another that a path names. What is deeper belongs to the last of them, as in browsers, which bound the depth of their trees too; its text stays.
DEEPEST = 256

_NEXT = frozenset(x for tags in ENDS.values() for x in tags)

_DIGITS = re.compile(r"\d+")


def host_of(url: str | None) -> str:
    _, mark, rest = (url or "").partition("://")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower() if mark else ""


def _attributes(tag: str, text: str, inside: bool) -> tuple[list[str], bool]:
    """The classes, and whether the element is marked as something else than article text. inside: of an article or main element."""
    classes, ids, roles, hidden = [], [], [], False
    for m in _NAMED.finditer(text):
        name, value = m[1].lower(), html.unescape((m[2] or "").strip("\"'"))
        if name in ("class", "id", "role"):
            {"class": classes, "id": ids, "role": roles}[name].extend(value.split())
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
    if hidden or tag in KEPT:
        return classes, hidden
    kinds = {c.lower() for c in classes}
    # An id names a box; on a line, inside a line or on an article's section it is an anchor made of the heading's words.
    if tag not in BLOCKS or tag in _LINES or (inside and (tag == "section" or "section" in kinds)):
        ids = []
    return classes, not MARKS.isdisjoint(kinds.union(map(str.lower, ids), map(str.lower, roles))) or kinds >= {"page", "header"}


def blocks(page: str | None) -> list[tuple[str, str, bool, int, str]]:
    """The page's blocks of text in order: path of the container, path of the whole article around it or '', whether dropped, characters inside links, text."""
    out: list = []
    if not page:
        return out
    # An open element: tag, whether a block, path, path of the whole article around it, whether dropped, the place of the box that holds its paragraphs, containers in its path.
    stack: list = [("", True, "", "", False, 0, 0)]
    texts: list[str] = []
    linked = 0
    # So that no tag searches the whole stack: how many elements of each tag are open, and the places of open boxes, paragraphs, items and cells.
    opened: Counter = Counter()
    stops: list[int] = []

    def close():
        nonlocal texts, linked
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                # A run of text belongs to the box that holds its paragraph.
                _, _, path, whole, *_ = stack[stack[-1][5]]
                out.append((path, whole, stack[-1][4], linked, text))
            texts, linked = [], 0

    def leave(k):
        if any(x[1] or x[4] for x in stack[k:]):
            close()
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]
        while stops and stops[-1] >= k:
            stops.pop()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            token = m[0]
            if token[0] != "<" or len(token) == 1:
                if texts or not token.isspace():
                    texts.append(token)
                    if any(x[0] == "a" for x in stack[-4:]):
                        linked += len(token)
            continue
        if not m[4]:  # a tag that the page's end cuts short
            break
        tag = tag.lower()
        if m[1]:
            if opened[tag]:
                leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            elif tag in BLOCKS:
                close()
            continue
        block = tag in BLOCKS
        if block:
            close()
            if tag in ENDS_P:
                k = next((k for k in reversed(stops) if stack[k][0] == "p" or stack[k][0] in _BOX), 0)
                if stack[k][0] == "p":
                    leave(k)
            if tag in ENDS:
                low = None
                for k in reversed(stops):
                    if stack[k][0] in _BOX:
                        break
                    low = k if stack[k][0] in ENDS[tag] else low
                if low:
                    leave(low)
        if tag in VOID:
            if tag == "br":
                close()
            continue
        top = stack[-1]
        classes, marked = _attributes(tag, m[3], bool(top[3])) if m[3].strip(" /\n") else ([], False)
        path, depth, box = top[2], top[6], block and tag not in _LINES
        if box and depth < DEEPEST:
            path, depth = f"{path}>{tag}" + "".join(f".{c}" for c in sorted({_DIGITS.sub('0', c).replace('>', '_') for c in classes})), depth + 1
        whole = top[3] or (path if tag in WHOLE else "")
        dropped = tag in DROPPED or marked or (tag == "header" and not top[3])
        if dropped:
            close()
        if tag in _END:
            end = _END[tag].search(page, at)
            at = end.end() if end else n
            continue
        if m[3].endswith("/") and not block:
            continue
        if tag == "p" or tag in _BOX or tag in _NEXT:
            stops.append(len(stack))
        stack.append((tag, block, path, whole, top[4] or dropped, len(stack) if box else top[5], depth))
        opened[tag] += 1
    close()
    return out


#: A run of text up to this many characters may be a label as well as a sentence.
_LABEL = 40


def _scores(found: list) -> dict[str, float]:
    scores: dict = defaultdict(float)
    for path, whole, dropped, linked, text in found:
        if not dropped:
            weight = max(0, len(text) - 2 * linked) * (1.0 if len(text) > _LABEL else 0.5) + 5 * sum(map(text.count, ".,;:!?"))
            if weight:
                scores[whole or path] += weight
    total = sum(scores.values())
    return {p: s / total for p, s in scores.items()} if total else {}


def containers(page: str | None) -> dict[str, float]:
    """Scores of a page's containers by generalised path: what their text weighs, links counting against it, as a share of the page's. Dropped containers have none."""
    return _scores(blocks(page))


def _above(path: str) -> list[str]:
    """The paths of the containers around a path, the nearest first."""
    return [path[:k] for k in range(len(path) - 1, -1, -1) if path[k] == ">"]


#: A path that ends with an element that holds one whole article.
_ENDS_WHOLE = rf">({'|'.join(WHOLE)})(\.[^>]*)?$"


def _steps(found: list, path: str) -> dict[tuple[str, str], int]:
    """For a path and the containers around it, by two of them: 1 if the outer one adds more sentences than other text (links, and labels by half), -1 if less; absent if it adds as much or nothing, or the page lacks the inner one.

    What is in an article or main element stands for itself, and none is around it.
    """
    chain = [path, *_above(path)] if path else [path]  # the page itself, '', is around all
    gains, there = [0.0] * len(chain), len(chain)
    closed = set()
    for at, whole, dropped, linked, text in found:
        if dropped:
            continue
        own = whole or at
        if whole:
            closed.add(whole)
        k = next(k for k, c in enumerate(chain) if own == c or own.startswith(f"{c}>"))
        rest = max(0, len(text) - linked)
        gains[k] += (rest if len(text) > _LABEL else -rest / 2) - linked
        there = min(there, k)
    held = list(itertools.accumulate(gains))
    out = {}
    for k in range(there, len(chain)):
        if chain[k] not in closed:
            for j in range(k + 1, len(chain)):
                if gain := held[j] - held[k]:
                    out[chain[k], chain[j]] = 1 if gain > 0 else -1
    return out


def widest(path: str, steps: dict[tuple[str, str], float]) -> str:
    """From a path to the container around it that the most votes are for, the smallest of equal ones, and on from there."""
    while True:
        best, most = None, 0
        for above in _above(path):
            if steps.get((path, above), 0) > most:
                best, most = above, steps[path, above]
        if best is None:
            return path
        path = best


def extract(page: str | None, path: str | None) -> str:
    """The text of the containers at a path and of what is inside them; at the page's own best one if the page lacks the path."""
    every = blocks(page)
    found = [(p, w, t) for p, w, dropped, _, t in every if not dropped]
    inside = [t for p, w, t in found if path and (p == path or p.startswith(f"{path}>") or w == path)]
    if not inside and found:
        own = _scores(every)
        best = max(own, key=lambda k: (own[k], k)) if own else found[0][1] or found[0][0]
        best = widest(best, _steps(every, best))
        inside = [t for p, w, t in found if p == best or p.startswith(f"{best}>") or w == best]
    return " ".join(inside)


def votes(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """The winning path of each host: host, path. A page's votes sum to 1, so no page outweighs another; ties go to the least path. Then a page has one vote for or against each container around the winner."""

    def score(batches):
        import pandas as pd

        for b in batches:
            told: dict = defaultdict(float)
            for u, h in zip(b["url"], b["html"], strict=True):
                host = host_of(u)
                for path, share in _scores(blocks(h)).items():
                    told[host, path] += share
            if told:
                yield pd.DataFrame([(*k, v) for k, v in told.items()], columns=["host", "path", "score"])

    def climb(batches):
        import pandas as pd

        for b in batches:
            told: dict = defaultdict(int)
            for host, path, h in zip(b["host"], b["path"], b["html"], strict=True):
                for (inner, outer), vote in _steps(blocks(h), path).items():
                    told[host, inner, outer] += vote
            if told:
                yield pd.DataFrame([(*k, v) for k, v in told.items()], columns=["host", "path", "above", "score"])

    def widen(batches):
        for b in batches:
            b["path"] = [widest(p, {(s["path"], s["above"]): s["score"] for s in steps}) for p, steps in zip(b["path"], b["steps"], strict=True)]
            yield b[["host", "path"]]

    tune(pages.sparkSession)
    rows = pages.select(F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    summed = rows.mapInPandas(tidy(score), "host string, path string, score double").groupBy("host", "path").agg(F.sum("score").alias("score"))
    winners = stash(summed.groupBy("host").agg(F.min_by("path", F.struct(-F.round("score", 6), F.col("path"))).alias("path")), "host-winners")
    # Only winners that aren't whole articles can be widened; the pages of their hosts are read again, for the containers around the winner alone.
    inner = winners.where(~F.col("path").rlike(_ENDS_WHOLE) & (F.col("path") != ""))
    again = rows.select(_host("url").alias("_host"), "html").join(_small(inner), F.col("_host") == F.col("host")).select("host", "path", "html")
    steps = again.mapInPandas(tidy(climb), "host string, path string, above string, score long").groupBy("host", "path", "above").agg(F.sum("score").alias("score")).where("score > 0")
    steps = steps.groupBy("host").agg(F.collect_list(F.struct("path", "above", "score")).alias("steps"))
    return winners.join(steps, "host", "left").withColumn("steps", F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType))).select("host", "path", "steps").mapInPandas(widen, "host string, path string")


def _host(url: str):
    """As host_of, as a column."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def _small(winners: DataFrame) -> DataFrame:
    return small(winners, 48, F.octet_length("host") + F.octet_length("path"))


def articles(pages: DataFrame, key: str = "page_id", page: str = "html", url: str = "url") -> DataFrame:
    """One row per page: the key, url, and the article's text ('' if none); null pages and URLs count as empty."""
    winners = stash(votes(pages, page, url), "host-paths")
    rows = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"), F.col(page).cast("string").alias("_html"))
    dealt = rows.withColumn("_host", _host("_url")).join(_small(winners), F.col("_host") == F.col("host"), "left").select("_key", "_url", "_html", "path")

    def run(batches):
        for b in batches:
            b["text"] = [extract(h, p) for h, p in zip(b["_html"], b["path"], strict=True)]
            yield b[["_key", "_url", "text"]]

    out = dealt.mapInPandas(tidy(run), f"_key {rows.schema['_key'].dataType.simpleString()}, _url string, text string")
    return out.select(F.col("_key").alias(key), F.col("_url").alias(url), "text")
