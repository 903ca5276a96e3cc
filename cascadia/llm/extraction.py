"""Main text of web pages by tag-path ratios.

A page is a sequence of blocks of text, each with the path of block-level tags from the root to it. For each path, text
length and punctuation per block are aggregated; the ratios are smoothed along the page with a Gaussian kernel, fused
by multiplication and compared with a share of their standard deviation. The paths above it are content; their common
container (or the nearest article or main elements, one or several) is taken whole, less what is boilerplate by its tag, role or whole
class or id, so that short paragraphs, headings and lists of links beside long ones stay. Names of which only a word is
known, and lists that are mostly links, are left out outside that container, or where it is the whole page.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Elements with text that is never content, skipped to their end tag. Those of _TEXT have no tags within: without an
#: end tag they take the rest of the page. Of the others without an end tag only the start tag is skipped.
_TEXT = frozenset("script style textarea iframe title".split())
_RAW = _TEXT | frozenset("noscript template select svg object canvas audio video button annotation annotation-xml".split())
_START, _END = ({t: re.compile(rf"<{slash}{t}(?=[\s/>])[^>]*+>", re.I) for t in _RAW} for slash in ("", "/"))
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|<([a-zA-Z][^\s/>]*+)[^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends open elements of these kinds, up to one of the second.
_ENDS = {t: ({"p"}, {"td", "th", "li", "article", "div", "section", "blockquote", "body"}) for t in _BLOCKS - {"td", "th", "tr", "li", "dd", "dt", "tbody", "thead", "tfoot"}}
_ENDS |= {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"})}
_DROPPED = frozenset("nav header footer aside form menu dialog head search fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_NAMES = re.compile(
    r"^(ads?|adv|advert\w*|adslot|adsense|adbox|sponsor\w*|banner|promo\w*|nav|navbar|navigation|menu|submenu|breadcrumbs?|header|masthead|footer|sidebar|aside|rail|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|comments?|commentlist|disqus|replies|reply|respond|discussion|related|recommended|recirc|widget|toolbar|pagination|pager|copyright|legal|disclaimer|search|form|skip)$"
)
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？；]")
#: Share of the standard deviation of the fused ratios above which a path is content.
THRESHOLD = 0.8
#: Share of the greatest ratio that another path must have to name a container of its own.
SHARE = 0.25
_KERNEL = np.array([0.25, 0.5, 0.25])


#: Elements that names of which a word is known may rule out.
_CONTAINERS = frozenset("div section ul ol dl table tbody tr td li details figure center".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


def _boilerplate(tag: str, attributes: str) -> int:
    """2 for boilerplate, 1 for a container of which only a word of the name is known, else 0."""
    if tag in _DROPPED:
        return 2
    found = 0
    if not attributes.strip():
        return found
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "").lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
        if name == "role" and value.strip() in _ROLES:
            return 2
        if name not in ("class", "id") or tag in ("html", "body", "main") or tag in _HEADINGS:
            continue
        talk = any(w.startswith(("comment", "repl")) for w in re.split(r"[^a-z0-9]+", value))
        # ids of sections and paragraphs are made of their headings
        if tag == "article" and not talk or name == "id" and (tag not in _CONTAINERS or tag == "section" and not talk):
            continue
        if any(map(_NAMES.match, value.split())):
            return 2
        if tag in _CONTAINERS and any(map(_NAMES.match, re.split(r"[^a-z0-9]+", value))):
            found = 1
    return found


def _after(page: str, at: int, tag: str, attributes: str, gone: set[str]) -> int:
    """Where the page goes on after the start tag, ending at at, of an element of _RAW; gone: those known to have no
    end tag from here on."""
    closed = attributes.endswith("/") and not re.search(r"=\s*[^\s\"'>]*/$", attributes)
    if closed and tag not in _TEXT:
        return at
    end = None if tag in gone else _END[tag].search(page, at)
    if end is None:
        gone.add(tag)
        return len(page) if tag in _TEXT and not closed else at
    # browsers ignore the slash here; an end tag of a later element isn't this one's
    return at if closed and _START[tag].search(page, at, end.start()) else end.end()


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int, int]]:
    """(path, text, characters in links, boilerplate as above) of every block with text, in page order."""
    found, stack, pieces = [], [], []  # stack: (tag, name in paths, boilerplate)
    links = anchors = serial = 0

    def close() -> None:
        nonlocal links
        if text := " ".join("".join(pieces).split()):
            found.append((tuple(x[1] for x in stack if x[1]), text, links, stack[-1][2] if stack else 0))
        pieces.clear()
        links = 0

    def pop(to: int) -> None:
        nonlocal anchors
        if any(x[1] for x in stack[to:]):
            close()
        anchors -= sum(x[0] == "a" for x in stack[to:])
        del stack[to:]

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            piece = html.unescape(raw) if "&" in raw else raw
            pieces.append(piece)
            if anchors:
                links += len(piece.strip())

    at, gone = 0, set()
    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[4] or "").lower()
        if tag in _RAW and not m[1]:
            at = _after(page, at, tag, m[3] or "", gone)
            continue
        if m[2] is None or tag in _RAW:
            continue
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag not in _BLOCKS and stack[k][1]:
                    break
            continue
        if tag == "br":
            pieces.append(" ")
        if tag in _BLOCKS:
            if tag in _ENDS:
                kinds, stop = _ENDS[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in kinds:
                        pop(k)
                        break
                    if stack[k][0] in stop:
                        break
            close()
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCKS:
            continue
        above = stack[-1][2] if stack else 0
        if above == 1 and tag in ("article", "main"):
            above = 0
        bad = max(above, _boilerplate(tag, m[3]))
        # containers are told apart, leaves of the same kind are not
        name = ""
        if tag in _BLOCKS:
            serial += 1
            name = f"{tag}#{serial}" if tag in ("article", "main", "div", "section", "td") else tag
        stack.append((tag, name, bad))
        anchors += tag == "a"
    add(page[at:])
    close()
    return found


def _content(seen: list[tuple[tuple[str, ...], str, int, int]]) -> tuple[set[tuple[str, ...]], set[tuple[str, ...]]] | None:
    """The paths of the containers of content, and those of lists that are mostly links; None without content."""
    if not seen:
        return None
    total = defaultdict(lambda: [0, 0, 0, 0])
    for path, text, links, _ in seen:
        t = total[path]
        t[0] += 1
        t[1] += max(0, len(text) - links)
        t[2] += len(_PUNCTUATION.findall(text))
        t[3] += links
    ratio = np.array([[total[p][1] / total[p][0], total[p][2] / total[p][0]] for p, *_ in seen])
    smooth = np.stack([np.convolve(np.pad(ratio[:, i], 1, mode="edge"), _KERNEL, "valid") for i in (0, 1)])
    fused = smooth[0] * (1 + smooth[1])
    best = {}
    for (path, *_), score in zip(seen, fused, strict=True):
        best[path] = max(best.get(path, 0.0), score)
    line = THRESHOLD * fused.std()
    chosen = [p for p, score in best.items() if score >= line and total[p][1] >= total[p][3]]
    if not chosen:
        return None
    top = max(chosen, key=lambda p: total[p][1])
    heavy = [p for p in chosen if best[p] >= SHARE * best[top]]
    named = [p[: k[-1] + 1] for p in heavy if (k := [i for i, name in enumerate(p) if name.split("#")[0] in ("article", "main")])]
    if any(top[: len(p)] == p for p in named):
        roots = set(named)  # several articles of a page are content alike
    else:
        n = next((k for k in range(min(map(len, heavy))) if len({p[k] for p in heavy}) > 1), min(map(len, heavy)))
        roots = {top[: min(n, len(top) - 1)]}
    return roots, {p for p, t in total.items() if t[3] > 0.6 * (t[1] + t[3]) and t[0] > 1}


def main_text(page: str | None) -> str:
    """The main text of one page: its blocks, each with single spaces, joined by blank lines; empty if it has none."""
    if not page:
        return ""
    kept = [x for x in blocks(page) if x[3] < 2]
    found = next(filter(None, (_content([x for x in kept if x[3] <= most]) for most in (0, 1))), None)
    if not found:
        return ""
    roots, lists = found
    inner = any(name.split("#")[0] in _CONTAINERS | {"article", "main"} for root in roots for name in root)
    return "\n\n".join(text for path, text, _, bad in kept if any(path[: len(r)] == r for r in roots) and (inner or not (bad or path in lists)))


def extract(pages):
    """Per page: page_id, url, text, n_chars (code points).

    A null or empty html, and a page without content, give an empty text. Every row of pages is a row of the result,
    repeated ones too; texts have any length; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(x) for x in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(x) for x in text]})

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op1_extraction(spark, sf_dir):
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
