"""HTML extraction by the distribution of text over lines.

The markup is stripped in one forward pass: every block of the page becomes a line. What stands in menus, page headers, footers,
sidebars, notices, adverts, forms, reader comments, scripts and styles leaves no line, so it makes no gap either. Over sliding
windows of lines the lengths are summed. A surge is where that sum rises to SURGE, a dive where it falls below DIVE; the text
lies between a surge and the dive that follows. All such stretches are kept, each from its first to its last long line or heading.

The stretches tell where the article is; what else stands there belongs to it, short lines too. Where the page has article or main
elements, the outermost ones that a stretch lies in are the place, and a stretch outside them is none. Elsewhere it is the
innermost element that holds all stretches, unless that is the whole body; then the stretches alone are kept.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, text_slices, tidied

WINDOW, SURGE, DIVE, LONG = 3, 120, 40, 40

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)|<!--|<[!?]|</")
_TAIL = re.compile(r"[>=]")
_VALUE = re.compile(r"\s*(.?)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_HUGE = re.compile(r"&#0*[0-9]{8,};?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

RAW = frozenset("script style title textarea noscript template iframe svg object select xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button fieldset".split())
FRAME = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()) | BOILERPLATE
SPACED = frozenset(("br", "td", "th", "option"))
#: Blocks that a new one of them ends, unless an element of another kind stands between; dd and dt end each other.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
PASSED = frozenset("div p address li dd dt".split())
#: Cells are places, not lines: a row without blocks is one line.
CELLS = frozenset(("td", "th"))
#: What rows and cells don't reach across is the table.
ROWS = CELLS | {"tr"}
#: Words that mark what isn't the article; a class, id or role does so if it is made of these and of BESIDE alone.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice popup promo promoted promotion related remark remarks replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget contentinfo complementary search".split()
)
BESIDE = frozenset("a area bar block bottom box button buttons container content form global group holder icons inner item items left links list main message news of outer panel posts primary right section secondary side signup site slot text the thread top unit user wrap wrapper".split())
#: Marks of a page's head, which inside an article are the article's own.
HEADS = frozenset(("header", "masthead"))


def _word(value: str) -> str | None:
    """``head`` or ``mark`` if one class, id or role marks what isn't the article."""
    low = value.lower()
    if low in MARKS:
        return "head" if low in HEADS else "mark"
    parts = [x.lower() for x in _PARTS.findall(value)]
    found = [x for x in parts if x in MARKS]
    if not found or len(value) > 100 or any(x not in MARKS and x not in BESIDE and not x.isdigit() for x in parts):
        return None
    return "head" if HEADS.issuperset(found) else "mark"


def _marked(attributes: str) -> str | None:
    low = attributes.lower()
    if "class" not in low and "id" not in low and "role" not in low:
        return None
    best = None
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            for value in (m[2] or m[3] or m[4] or "").split():
                if kind := _word(value):
                    if kind == "mark":
                        return kind
                    best = kind
    return best


def _decoded(text: str) -> str:
    if "&" not in text:
        return text
    # A number of so many digits is no character; the library would refuse to read it.
    text = _HUGE.sub(lambda m: "�" if len(m[0].strip("&#;").lstrip("0")) > 7 else m[0], text) if "&#" in text else text
    return html.unescape(text)


class _Quotes:
    """Where a tag ends: quotes count after an equals sign alone, and one that is never closed is none. Each kind of search fails once."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'>"}

    def end(self, at: int) -> int:
        """The position after the tag, -1 for none."""
        page = self.page
        while True:
            if at > self.last[">"]:
                return -1
            m = _TAIL.search(page, at)
            at = m.end()
            if m[0] == ">":
                return at
            v = _VALUE.match(page, at)
            if v[1] in ("'", '"') and self.last[v[1]] >= v.end():
                at = page.index(v[1], v.end()) + 1


def scan(page: str):
    """(text, name, closing, attributes) of the page's parts in order: either a text, or a tag. Comments and raw elements are left out."""
    quotes, at, n = _Quotes(page), 0, len(page)
    missing: set[str] = set()  # raw elements that are never closed from here on
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            yield page[at:], "", False, ""
            return
        if m.start() > at:
            yield page[at : m.start()], "", False, ""
        if not m[2]:
            close = "-->" if m[0] == "<!--" else ">"
            # an empty comment may be written <!--> or <!--->
            short = close == "-->" and (page.startswith(">", m.end()) or page.startswith("->", m.end()))
            end = page.find(">" if short else close, m.end())
            if end < 0:
                return
            at = end + (1 if short else len(close))
            continue
        end = quotes.end(m.end())
        if end < 0:
            return
        name, closing, tail = m[2].lower(), bool(m[1]), page[m.end() : end - 1]
        at = end
        yield "", name, closing, tail
        if not closing and name in RAW and not (tail.endswith("/") and name == "svg"):
            close = None if name in missing else re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if close is None:
                missing.add(name)
                return
            end = quotes.end(close.end())
            at = end if end >= 0 else n


class _Element:
    __slots__ = ("name", "up", "hides", "mark", "frame", "size", "depth", "heading")

    def __init__(self, name: str, up: _Element | None, hides: bool, mark: bool):
        self.name, self.up, self.hides, self.mark = name, up, hides, mark
        self.size, self.depth = 0, up.depth + 1 if up else 0
        #: Outermost article or main element around, itself included.
        self.frame = up.frame if up and up.frame else self if name in FRAME and not hides else None
        self.heading = name in HEADINGS or bool(up and up.heading)


def blocks(page: str) -> list[tuple[str, _Element]]:
    """Every block's text and the element it stands in, in page order, boilerplate included."""
    out: list[tuple[str, _Element]] = []
    held: list[str] = []
    root = _Element("", None, False, False)
    stack, places = [root], {}  # open elements; per name the places of its own in the stack
    walls = [0]  # places of the open elements that li, dd, dt and tr don't reach across

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((text, stack[-1]))

    def wall(name: str) -> int:
        return (places.get("table") or (0,))[-1] if name in ROWS else walls[-1]

    def cut(to: int) -> None:
        while len(stack) > to:
            gone = stack.pop()
            places[gone.name].pop()
            if walls[-1] == len(stack):
                walls.pop()

    for text, name, closing, tail in scan(page):
        if not name:
            held.append(_decoded(text))
            continue
        if name in SPACED:
            held.append(" ")
        block = name in BLOCKS
        kind = None if closing or name in VOID or name in ("html", "body") else _marked(tail)
        cell = name in CELLS
        if not block and not kind and not cell and not (closing and places.get(name)):
            continue
        if not cell or kind or any(x.hides for x in stack[-1:]):
            flush()
        if closing:
            found = places.get(name)
            if found and (name not in ENDS or found[-1] >= wall(name)):
                cut(found[-1])
            continue
        if name in VOID or name in ("html", "body"):
            continue
        if block and places.get("p"):
            cut(places["p"][-1])
        for other in ENDS.get(name, ()):
            if places.get(other) and places[other][-1] >= max(1, wall(other)):
                cut(places[other][-1])
        up = stack[-1]
        head = kind == "head" or name == "header"
        hides = name in BOILERPLATE or kind == "mark" or (head and not up.frame)
        if name == "main":
            hides = False
        if tail.endswith("/") and not block:
            continue
        places.setdefault(name, []).append(len(stack))
        if name not in PASSED and (block or cell):
            walls.append(len(stack))
        stack.append(_Element(name, up, hides, hides and name not in BOILERPLATE and name != "header"))
    flush()
    return out


def _shown(found: list[tuple[str, _Element]]) -> list[tuple[str, _Element]]:
    """The blocks under no element that hides."""
    known: dict[_Element, bool] = {}
    out = []
    for text, e in found:
        path = []
        while e is not None and e not in known:
            path.append(e)
            e = e.up
        hidden = known[e] if e is not None else False
        for x in reversed(path):
            hidden = known[x] = hidden or x.hides
        if not hidden:
            out.append((text, path[0] if path else e))
    return out


def lines(page: str) -> list[tuple[str, _Element]]:
    """The blocks that may be the article's. If they have neither a surge nor an article or main element, the parts that class words
    alone hide and that hold most of the page's text are shown: a mark on the whole page marks nothing."""
    found = blocks(page)
    got = _shown(found)
    if len(got) < len(found) and not any(e.frame for _, e in got) and not stretches([len(t) for t, _ in got], [e.heading for _, e in got], True):
        total, each = 0, {}
        for t, e in found:
            each[e] = each.get(e, 0) + len(t)
            total += len(t)
        for e in sorted(_closed(each), key=lambda e: -e.depth):
            e.size += each.get(e, 0)
            if e.up is not None:
                e.up.size += e.size
        wide = [e for e in _closed(each) if 2 * e.size > total and e.hides and (e.mark or e.name == "form")]
        for e in wide:
            e.hides = False
        got = _shown(found) if wide else got
    return got


def _closed(some) -> set[_Element]:
    """These elements and all around them."""
    out: set[_Element] = set()
    for e in some:
        while e is not None and e not in out:
            out.add(e)
            e = e.up
    return out


def stretches(sizes: list[int], headings: list[bool], strict: bool = False, window: int = WINDOW) -> list[tuple[int, int]]:
    """Lines [start, end) between each surge and its dive. Without any surge the fullest windows are one, unless ``strict``."""
    n = len(sizes)
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    held = [sums[min(n, i + window)] - sums[i] for i in range(n)]
    most = max(held, default=0)
    if not most or (strict and most < SURGE):
        return []
    surge, dive, long = min(SURGE, most), min(DIVE, most), min(LONG, max(sizes))
    out, i = [], 0
    while i < n:
        if held[i] < surge:
            i += 1
            continue
        j = i
        while j < n and held[j] >= dive:
            j += 1
        end = min(n, j + window - 1)
        a, b = i, end
        while a < b and sizes[a] < long and not headings[a]:
            a += 1
        while a and headings[a - 1]:
            a -= 1
        while b > a and sizes[b - 1] < long:
            b -= 1
        if a < b:
            a = max(a, out[-1][1]) if out else a
            if a < b:
                out.append((a, b))
        i = max(j, i + 1)
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    got = lines(page)
    if not got:
        return ""
    framed = [x for x in got if x[1].frame]
    got = framed or got
    found = stretches([len(t) for t, _ in got], [e.heading for _, e in got])
    inside = [e for a, b in found for _, e in got[a:b]]
    if framed:
        homes = {e.frame for e in inside}
        return "\n\n".join(t for t, e in got if e.frame in homes)
    place = inside[0]
    for e in inside:  # what holds them all
        while place is not e:
            if place.depth >= e.depth:
                place = place.up
            else:
                e = e.up
    if place.up is None:
        return "\n\n".join(t for a, b in found for t, _ in got[a:b])
    within: dict[_Element, bool] = {place: True}
    out = []
    for t, e in got:
        path = []
        while e is not None and e not in within:
            path.append(e)
            e = e.up
        yes = within[e] if e is not None else False
        within.update(dict.fromkeys(path, yes))
        if yes:
            out.append(t)
    return "\n\n".join(out)


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars), one row per page. Null or empty html gives the empty text; null and repeated ids and urls pass
    through; an unclosed element lasts to the end of the one around it, an unclosed tag, comment or script to the end of the page.
    Other columns are ignored, whatever their names. An empty input gives no rows."""
    short_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("_id"), F.col("url").alias("url"), F.col(html_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def work(batches):
        for whole in batches:
            for b in text_slices(whole, "_text"):
                texts = [extract(t) for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_id", "url", "text", "n_chars"])

    return rows.mapInArrow(tidied(work), f"_id {kind}, url string, text string, n_chars bigint").withColumnRenamed("_id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
