import html
import re
import time
from html.parser import HTMLParser

import pytest

from pointfield.llm import html_text as ht


class Plain(HTMLParser):
    """The fixture's article, read another way: the standard parser, a flag, and blocks cut at p, h1 and br's neighbours."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks = False, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.on = True
        elif tag in ("nav", "footer"):
            self.on = False
        if tag in ("p", "h1", "footer"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag == "article":
            self.on = False
        elif tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data

    def text(self):
        return "\n\n".join(t for t in (" ".join(b.split()) for b in self.blocks) if t)


def article(page):
    """The article element's blocks, cut out by the markers of the fixture's pages."""
    a = page[page.find("<article>") + 9 :]
    a = a[: a.find("</article>")] if "</article>" in a else a
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", a.replace("<br>", " ")))
    return "\n\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)


def test_fixture_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in ht.extracted(pages).collect()}
    assert len(got) == pages.count()
    for p in pages.collect():
        want = Plain(p.html).text()
        assert want == article(p.html) and "\n\n" in want
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


A = "Alpha runs over the long meadow and does not stop before the evening, when all the lamps of the village are lit."
B = "Beta is a shorter paragraph, yet it is long enough to be one, and it ends with a full stop."
C = "Gamma closes the text with some words on what came after, on who was there and on what they thought of it."
JUNK = "Subscribe now and get the best stories of the week in your mail, all for nothing at all, today and tomorrow."
HEAD = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>"

# Page shapes and their texts, block by block, written by hand to the contract.
SHAPES = {
    "plain article": (f"{HEAD}<article><h1>T</h1><p>{A}</p><p>x</p><p>{C}</p></article></body></html>", ["T", A, "x", C]),
    "advert between paragraphs of a div": (f"{HEAD}<div><p>{A}</p><div class=advert>{JUNK}</div><p>{B}</p><p>{C}</p></div>", [A, B, C]),
    "aside between paragraphs of a div": (f"{HEAD}<div><p>{A}</p><p>{B}</p><aside><p>{JUNK}</p><p>{JUNK}</p></aside><p>{C}</p></div>", [A, B, C]),
    "form and share box inside a div": (f"{HEAD}<div id=text><h1>T</h1><p>{A}</p><form><p>{JUNK}</p><input></form><p>{B}</p><div class='share-buttons'>Share this</div><p>{C}</p></div>", ["T", A, B, C]),
    "a container that names its sidebar": (f"{HEAD}<div class='container with-sidebar'><p>{A}</p><p>{B}</p></div><div class=sidebar>{JUNK}</div>", [A, B]),
    "related work is a section": (f"{HEAD}<article><p>{A}</p><section id=related-work><h2>Related work</h2><p>{B}</p></section></article>", [A, "Related work", B]),
    "an article header holds the title": (f"{HEAD}<article><div class=article-header><h1>Title</h1></div><p>{A}</p></article>", ["Title", A]),
    "an article header outside an article": (f"{HEAD}<div><div class=article-header><h1>Title</h1></div><p>{A}</p><p>{B}</p></div>", ["Title", A, B]),
    "header element in the article": (f"{HEAD}<header>{JUNK}</header><article><header><h1>Title</h1></header><p>{A}</p></article>", ["Title", A]),
    "formulas are text": (f"{HEAD}<article><p>{A} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", [A + " x=1 holds"]),
    "advert as a paragraph": (f'{HEAD}<article><p>{A}</p><p class="advert">{JUNK}</p><p>{B}</p></article>', [A, B]),
    "advert as an unclosed paragraph": (f'{HEAD}<article><p>{A}<p class="advert">{JUNK}<p>{B}</article>', [A, B]),
    "comments as list items": (f'{HEAD}<article><p>{A}</p><ul><li>one</li><li class="comment">{JUNK}</li><li>two</li></ul></article>', [A, "one", "two"]),
    "comments as unclosed list items": (f'{HEAD}<article><p>{A}</p><ul><li>one<li class="comment">{JUNK}<li>two</ul></article>', [A, "one", "two"]),
    "comments as articles": (f"{HEAD}<article><p>{A}</p></article><section class=comments><article><p>{JUNK}</p></article></section>", [A]),
    "a comment that is an article": (f"{HEAD}<article><p>{A}</p></article><article class=comment><p>{JUNK}</p></article>", [A]),
    "long comments": (f"{HEAD}<div><p>{A}</p><p>{B}</p></div><div id=comments>{f'<p>{JUNK}</p>' * 20}</div>", [A, B]),
    "a widget around the page": (f"{HEAD}<div class=widget><p>{A}</p><p>{B}</p></div><p>Bye</p>", [A, B]),
    "a form around the page": (f"{HEAD}<form id=aspnet><div><p>{A}</p><p>{B}</p></div></form>", [A, B]),
    "menus without marks": (f"{HEAD}<ul><li><a>Home</a><li><a>News</a><li><a>Shop</a></ul><div><p>{A}</p><p>{B}</p></div><ul><li>Help<li>Jobs<li>Imprint<li>Data</ul>", [A, B]),
    "table layout": (f"{HEAD}<table><tr><td><ul><li>Home<li>News<li>Shop</ul><td><p>{A}</p><p>{B}</p></table>", [A, B]),
    "a short last line in a div": (f"{HEAD}<div><h1>T</h1><p>{A}</p><p>{B}</p><p>End.</p></div><div>Imprint</div>", ["T", A, B, "End."]),
    "short items between long paragraphs": (f"{HEAD}<div><p>{A}</p><p>{B}</p><ul><li>a<li>b<li>c<li>d<li>e<li>f</ul><p>{A}</p><p>{C}</p></div>", [A, B, *"abcdef", A, C]),
    "one div a paragraph": (f"{HEAD}<div><div><p>{A}</p></div><div><p>{B}</p></div><div><p>{C}</p></div></div><div>Imprint</div>", [A, B, C]),
    "references": (f"{HEAD}<article><p>{A} &amp; &lt;b&gt; &#65;&#x42; &eacute;&nbsp;x</p></article>", [A + " & <b> AB é x"]),
    "references that a tag cuts": (f"{HEAD}<article><p>{A} &am<b>p;</b></p></article>", [A + " &amp;".replace("&amp;", "&amp;")]),
    "script with markup": (f'{HEAD}<article><p>{A}</p><script>if (a<b) x="</p><p>{JUNK}</p>"</script><p>{B}</p></article>', [A, B]),
    "comment with markup": (f"{HEAD}<article><p>{A}</p><!-- <p>{JUNK}</p> > --><p>{B}</p></article>", [A, B]),
    "quotes that don't balance": (f'{HEAD}<article><p title="x>{A}</p><p>{B}</p></article>', [A, B]),
    "a stray quote in a tag": (f'{HEAD}<article><p "><b>{A}</b></p></article>', [A]),
    "angle brackets in a value": (f'{HEAD}<article><p title="a > b">{A}</p></article>', [A]),
    "less than in text": (f"{HEAD}<article><p>{A} 3 < 4 and 5 <= 6</p></article>", [A + " 3 < 4 and 5 <= 6"]),
    "white space and breaks": (f"{HEAD}<article><p>\n\t{A}<br>x\n\n y </p></article>", [A + " x y"]),
    "table in the article": (f"{HEAD}<article><p>{A}</p><table><tr><th>k<th>v<tr><td>1<td>2</table></article>", [A, "k v", "1 2"]),
    "unclosed article": (f"{HEAD}<article><p>{A}<footer>{JUNK}</footer>", [A]),
    "stray closings": (f"{HEAD}</div></section><article></p><p>{A}</p></span></article>", [A]),
    "main around an article": (f"{HEAD}<main><h1>T</h1><article><p>{A}</p></article></main>", ["T", A]),
    "cookie notice and newsletter": (f"{HEAD}<div class='cookie-notice'>{JUNK}</div><article><p>{A}</p><div class='newsletter-signup'>{JUNK}</div></article>", [A]),
    "roles": (f"{HEAD}<div role=navigation>{JUNK}</div><div role=main><p>{A}</p><p>{B}</p></div><div role=contentinfo>{JUNK}</div>", [A, B]),
    "an article of one line": (f"{HEAD}<article>Short.</article><div>Imprint and other things that fill a long line of text here, for a surge, and still more of it to be sure, as it must be.</div>", ["Short."]),
    "nothing but boilerplate": (f"{HEAD}<nav>Home</nav><footer>x</footer>", []),
    "flat paragraphs": (f"{HEAD}<h1>T</h1><p>{A}</p><p>{B}</p>", ["T", A, B]),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name):
    page, want = SHAPES[name]
    assert ht.extract(page) == "\n\n".join(want)


@pytest.mark.parametrize(
    "page",
    ['<a "' * 250_000, '<a b="' * 160_000, "<a b='\"" * 140_000, "<div>" * 100_000 + "</x>" * 100_000, "<div>" * 50_000 + "<li><section>" + "<div>" * 50_000 + "<li></li>" * 50_000, "<!--" * 250_000, "<script>" * 125_000, "<p class=ad>x" * 80_000, "&#" + "9" * 1_000_000 + ";", "&" * 1_000_000, "<" * 1_000_000, "</" * 500_000, "<svg/>" * 160_000, f"<div class={'ad-' * 300_000}>x", "<x " + "a" * 1_000_000, "<div class=widget>" * 50_000 + A],
    ids=lambda p: p[:12],
)
def test_a_megabyte_of_anything_takes_seconds(page):
    began = time.process_time()
    ht.extract(page)
    ht.extract("<article>" + page + "<p>" + A)
    assert time.process_time() - began < 6


def test_stretches():
    at = lambda sizes: ht.stretches(sizes, [False] * len(sizes))
    assert at([]) == [] and at([0, 0]) == []
    assert at([5, 5, 5, 5, 100, 90, 3, 80, 5, 5, 5, 5, 60, 90, 2]) == [(4, 8), (12, 14)]
    assert at([7, 9]) == [(1, 2)]
    assert ht.stretches([5, 100, 90], [True, False, False]) == [(0, 3)]


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (None, None, "<p>a &nbsp; &#x41;&lt;", "y"), (2, "v", "plain text", "z"), (2, "v", "plain text", "z"), (3, "w", "<p>" + "a b " * 200_000, "z"), (4, "", "<script>never closed", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, _id string")
    got = ht.extracted(df).collect()
    assert sorted(r.text[:10] for r in got) == sorted(["", "", "a A<", "plain text", "plain text", "a b a b a ", ""])
    assert ht.extracted(df.limit(0)).count() == 0
