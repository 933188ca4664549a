"""Main text of web pages by container paths that the pages of a host agree on.

Each page scores its containers by the text of the blocks in them; sections, divisions, cells and quotations of an article
count for the element that holds it. A container's generalised path (tags with classes and ids, numbers blanked) gets the
page's vote in proportion to its share of the score; votes are summed per host, and every page is extracted again from the
path on which its own share and its host's votes agree most.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import durable, read

#: Bytes of hosts' paths up to which they are broadcast.
BROADCAST_BYTES = 8_000_000
#: Share of a container's text that may be link text for it to be part of the article around its best part.
LINKS = 0.3
#: Characters from which a link in an article is text.
PARAGRAPH = 200

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = {t: re.compile(rf"</{t}\s*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noscript", "template", "svg")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
_CONTAINER = set("article body center dd div main section td blockquote".split())
#: Elements that a start tag of the key ends when they are open.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SKIP = set("nav aside footer form button select dialog menu head object video audio canvas search".split())
#: Parts of a class or id that name furniture, parts that say only where or how it stands, and first parts after which a name
#: describes an element (its layout, topic or state) and doesn't say what it is.
_NOISE = re.compile(
    r"ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|disclaimer|footer|gdpr|masthead|"
    r"menus?|modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo\w*|recommend\w*|related|replies|respond|"
    r"share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widgets?", re.I,
)
_PLACES = set(
    "area articles author bar block body bottom box button buttons container content count form group holder icon icons inner "
    "item items label left link links list message metadata outer overlay panel post posts reply right row section slot stories "
    "text thread title top unit wrap wrapper zone".split()
)
_ABOUT = set("has with without no is not category cat tag topic format layout type status tax term".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar"}
#: Names of elements that hold an article, whose own header belongs to the text.
_NAMED = re.compile(r"\w+[^/]*?[.#](?:article|content|post|entry|story)(?:-(?:body|content|text))?(?=[.#]|$)")
_BODY = re.compile(r"[.#](?:article|content|post|entry|story)(?:-(?:body|content|text))?(?=[.#]|$)|(?:^|/)(?:article|main)(?=[.#/]|$)")
_SPACE = re.compile(r"\s+")
_FORM_END = re.compile(r"</form\s*(?:>|\Z)", re.I)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v[1:-1] if v[:1] in "\"'" and len(v) > 1 else v) for k, v in _ATTR.findall(raw)} if raw.strip("/ \n\t") else {}


@lru_cache(maxsize=8192)
def _furniture(names: str) -> bool:
    """Whether a class or id says that an element is furniture: its last part does, or its first one with only places after it."""
    for name in names.split():
        parts = [p for p in re.split(r"[_-]+", name) if p]
        if not parts or parts[0].lower() in _ABOUT:
            continue
        if _NOISE.fullmatch(parts[-1]) or _NOISE.fullmatch(parts[0]) and all(p.lower() in _PLACES or p.isdigit() for p in parts[1:]):
            return True
    return False


def _noise(tag: str, attrs: dict[str, str], inside: bool, names: bool = True) -> bool:
    """Whether an element is page furniture; headers only outside an element that holds an article. Names say it with ``names``
    alone, and of an article, main, body or element named like one only if it is a reader's comment."""
    if tag in _SKIP or tag == "header" and not inside:
        return True
    if not attrs:
        return False
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    if hidden or attrs.get("role", "").lower() in _ROLES and tag not in ("html", "body", "article", "main"):
        return True
    if not names or tag in ("html", "body", "main"):
        return False
    own = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if tag == "article" or _NAMED.match(_label(tag, attrs)):
        return any(n.lower() in ("comment", "comments", "reply", "comment-body") for n in own.split())
    return _furniture(own)


_CONTROL = re.compile(r"<(?:input(?![^>]*type\s*=\s*[\"']?hidden)|select|textarea|button|label)\b", re.I)
_QUIET = re.compile(r"<(script|style|select|textarea|button|label)\b.*?(?:</\1\s*>|\Z)|<[^>]*>", re.I | re.S)


def _round_page(page: str, at: int) -> bool:
    """Whether the form that begins before ``at`` holds text with some controls, not controls with some text."""
    end = _FORM_END.search(page, at)
    inside = page[at : end.start() if end else len(page)]
    text = len(_SPACE.sub(" ", _QUIET.sub("", inside)).strip())
    return text > 200 and text > 60 * len(_CONTROL.findall(inside))


def _label(tag: str, attrs: dict[str, str]) -> str:
    """Generalised name of an element: tag, sorted classes and id with digits blanked."""
    if not attrs:
        return tag
    names = sorted(set(attrs.get("class", "").split()))
    own = [f".{c}" for c in names] + ([f"#{attrs['id']}"] if attrs.get("id") else [])
    return tag + re.sub(r"\d+", "0", "".join(own))


def blocks(page: str) -> list[tuple[tuple[tuple[str, bool], ...], str, int]]:
    """Text blocks of a page outside its furniture: (open elements as (path, container?), text, length of link text).

    A page that is nothing but furniture by its names is read again by its tags alone.
    """
    return _blocks(page, True) or _blocks(page, False)


def _blocks(page: str, names: bool) -> list[tuple[tuple[tuple[str, bool], ...], str, int]]:
    out: list = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, noise, container
    text: list[str] = []
    links = at = link = 0

    def flush():
        nonlocal links
        if text:
            got = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if got:
                out.append((tuple((p, c) for _, p, _, c in stack), got, links))
            text.clear()
        links = 0

    def close(depth: int):
        flush()
        del stack[depth:]

    for m in _TOKEN.finditer(page):
        start = m.start()
        if start < at:
            continue  # inside raw text
        quiet = bool(stack) and stack[-1][2]
        if start > at and not quiet:
            text.append(page[at:start])
            if link:
                links += start - at
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                link = 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _VOID:
            if tag in ("br", "hr", "img") and not quiet:
                text.append(" ")
            continue
        attrs = _attributes(m[3])
        block = tag in _BLOCK
        if tag == "a":
            link = 1
        inside = bool(stack) and tag == "header" and any(_BODY.search(p) for p in stack[-1][1].split("/"))
        noise = quiet or (not _round_page(page, at) if tag == "form" else _noise(tag, attrs, inside, names))
        if not block and not (noise and not quiet):
            continue  # inline elements don't cut text, unless they are furniture
        if m[3].rstrip().endswith("/") and not block:
            continue
        if block:
            link = 1 if tag == "a" else 0
            flush()
            for i in range(len(stack) - 1, -1, -1):
                t = stack[i][0]
                if t == "p" or t in _ENDS.get(tag, ()):
                    close(i)
                if t in _CONTAINER or t in ("ul", "ol", "table", "dl"):
                    break
            if quiet and noise and not (stack and stack[-1][2]):  # what made it quiet is closed now
                noise = not _round_page(page, at) if tag == "form" else _noise(tag, attrs, inside, names)
        else:
            text.append("")  # an inline advert leaves the block open
            flush()
        path = f"{stack[-1][1]}/{_label(tag, attrs)}" if stack else _label(tag, attrs)
        stack.append((tag, path, noise, tag in _CONTAINER))
    if at < len(page) and not (stack and stack[-1][2]):
        text.append(page[at:])
    flush()
    return out


def _holder(path: tuple[tuple[str, bool], ...]) -> str | None:
    """The outermost article a block lies in, else the outermost element named like one, else main."""
    named = main = None
    for p, _ in path:
        label = p.rsplit("/", 1)[-1]
        if label[:7] == "article" and label[7:8] in ("", ".", "#"):
            return p
        if named is None and _NAMED.match(label):
            named = p
        elif main is None and label[:4] == "main" and label[4:5] in ("", ".", "#"):
            main = p
    return named or main


def _climbed(best: str, found: list) -> str:
    """The ancestor of a container up to which what stands beside it is text and not links: an introduction, a heading."""
    while "/" in best:
        above = best.rsplit("/", 1)[0]
        if above.rsplit("/", 1)[-1].split(".")[0].split("#")[0] == "html":
            break
        inside = [any(p == best for p, _ in path) for path, _, _ in found]
        beside = [(t, n) for (path, t, n), i in zip(found, inside, strict=True) if not i and any(p == above for p, _ in path)]
        if sum(n for _, n in beside) > LINKS * sum(len(t) for t, _ in beside):
            break
        best = above
    return best


def votes(page: str, found: list | None = None) -> dict[str, int]:
    """Thousandths of the page's score by container path.

    A block of an article counts for the element that holds the article. Other blocks count whole for their nearest container
    and 0.4 for the next one; the best of these containers passes its score to the ancestor it is ``_climbed`` to.
    """
    found = blocks(page) if found is None else found
    score: dict[str, float] = {}
    loose: dict[str, float] = {}
    for path, text, links in found:
        weight = max(0, len(text) - 2 * links)
        holder = _holder(path)
        if holder is not None:  # in an article a text as long as a paragraph is none of a menu's links
            score[holder] = score.get(holder, 0.0) + (len(text) if len(text) > PARAGRAPH else weight)
            continue
        for p, part in zip(reversed([p for p, container in path if container][-2:]), (1.0, 0.4)):
            loose[p] = loose.get(p, 0.0) + weight * part
    if loose:
        best = max(loose, key=lambda p: (loose[p], p))
        top = loose.pop(best)
        best = best if score else _climbed(best, found)
        loose[best] = loose.get(best, 0.0) + top
    for p, s in loose.items():
        score[p] = score.get(p, 0.0) + s
    total = sum(score.values())
    return {p: round(1000 * s / total) for p, s in score.items() if s > 0} if total else {}


def extract(page: str, host: dict[str, int]) -> str:
    """Blocks below the path of the largest product of the page's own votes and its host's; a path that only this page votes for
    has its own votes for the host's."""
    found = blocks(page)
    own = votes(page, found)
    if not own:  # nothing but links, or no text
        return " ".join(t for _, t, _ in found)
    best = max(own, key=lambda p: (own[p] * max(own[p], host.get(p, 0)), p))
    inside = [t for path, t, _ in found if any(p == best for p, _ in path)]
    return " ".join(inside if inside else [t for _, t, _ in found])


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page; one row per row.

    Returns page_id, url, text (empty if there is none), n_chars. Null and empty html give an empty text; pages without a
    url share one host; a page that has none of its host's paths is extracted from its own best container; repeated rows
    and null ids stay; other columns are not read. Hosts of any share of the rows only add to sums of votes, which
    batches pre-add. Every path that two pages of a host vote for is kept. If the kept paths are too large to broadcast, pages
    are joined with them by host, a join whose skewed partitions adaptive execution splits.
    """
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), _HOST, 1)).alias("host"),
    )

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums: dict[tuple[str, str], list[int]] = {}
            for host, page in zip(b["host"], b["html"].fillna(""), strict=True):
                for p, n in votes(page).items():
                    got = sums.setdefault((host, p), [0, 0])
                    got[0] += n
                    got[1] += 1
            rows = [(h, p, *x) for (h, p), x in sums.items()]
            yield pd.DataFrame(rows, columns=["host", "path", "votes", "pages"])

    cast = own.select("host", "html").mapInPandas(vote, "host string, path string, votes long, pages long")
    sums = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages")).filter("pages > 1")
    kept = durable(sums.groupBy("host").agg(F.collect_list("path").alias("paths"), F.collect_list("votes").alias("votes")), "paths")
    size = kept.agg(F.sum(F.length("host") + F.aggregate("paths", F.lit(0), lambda a, p: a + F.length(p) + 24))).first()[0] or 0
    joined = own.join(F.broadcast(kept) if size <= BROADCAST_BYTES else kept, "host", "left").select("page_id", "url", "html", "paths", "votes")

    def text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for page, paths, n in zip(b["html"].fillna(""), b["paths"], b["votes"], strict=True):
                got.append(extract(page, dict(zip(paths, n, strict=True)) if paths is not None else {}))
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": got, "n_chars": [len(t) for t in got]})

    return joined.mapInPandas(text, "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    return main_text(read(spark, sf_dir, "pages"))
