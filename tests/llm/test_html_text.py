"""HTML extraction: hand-worked layouts, broken markup, and all visible words kept in order."""

import html
import re

import pytest
from pyspark.sql import functions as F

from fieldframe.llm import html_text
from fieldframe.llm.html_text import page_text

CASES = [
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("a<br>b<br/>c", "a\nb\nc"),
    ("<b>bo</b>ld <i>it</i>", "bold it"),
    ("<ul><li>a<li>b</ul>", "- a\n- b"),
    ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
    ("<dl><dt>T<dd>D<dt>U<dd>E</dl>", "T\n    D\nU\n    E"),
    ("<pre>a  b\n  c</pre>", "a  b\n  c"),
    ("<table><tr><td>a<td>long one<tr><td>bbb<td>c</table>", "a    long one\nbbb  c"),
    ("<table><td>x<td>y</table>", "x  y"),
    ("<table><tr><td>1<br>2<td>3</table>", "1  3\n2"),
    ("<table><tr><td colspan=2>w<td>z<tr><td>a<td>b<td>c</table>", "w     z\na  b  c"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
    ("<title>no</title><style>no</style><script>if (a<b) '</p>'</script>yes<!-- no <b> -->", "yes"),
    ("<div hidden>no</div><p style='DISPLAY : none'>no<p>yes<span style=visibility:hidden>no</span>", "yes"),
    ("<details><summary>s</summary>no</details><details open>yes</details>", "s\nyes"),
    ("a &lt;b&gt; &amp;amp; &#233; 3 < 4", "a <b> &amp; é 3 < 4"),
    ("<a href='x>y'>link</a> <img alt='pic'> <input type=hidden value=no>", "link pic"),
    ("<p>cut off <b>here", "cut off here"),
    ("</p>x</div></table>y", "xy"),
    ("<blockquote>q</blockquote>z", "    q\n\nz"),
    ("x<unknown y=1>z</unknown>", "xz"),
    ("<textarea> a </textarea>", " a"),
]


@pytest.mark.parametrize("markup,want", CASES)
def test_layout(markup, want):
    assert page_text(markup) == want


DRAWN = [
    ("<p>so <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> holds", "so x= 1 2 holds"),
    ("<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow>"
     "<annotation encoding=tex>no</annotation><annotation-xml><mi>no</mi></annotation-xml></semantics></math>", "E=m c 2"),
    ("<math display=block><mtable><mtr><mtd>a</mtd><mtd>b</mtd></mtr><mtr><mtd>c</mtd><mtd>d</mtd></mtr></mtable></math>end", "a b\nc d\nend"),
    ("<math><mphantom>no</mphantom><maction><mi>yes</mi><mi>no</mi></maction></math>", "yes"),
    ("<svg><title>no</title><desc>no</desc><metadata>no</metadata><defs><text>no</text></defs><style>no</style>no<g>no"
     "<text x=1>one<tspan>!</tspan><tspan x=2>two</tspan></text><text>three</text></g></svg>", "one! two three"),
    ("<svg><title/><style/><path d='M 1'/><rect width=3 /><text>a &lt; b</text></svg> after", "a < b after"),
    ("<svg><text><![CDATA[c<d>]]></text><foreignObject><p>in</p>side</foreignObject></svg>out", "c<d>\n\nin\n\nside\nout"),
    ("<svg><text display=none>no</text><g visibility=hidden><text>no</text></g><a href=x>no<text>link</text></a></svg>", "link"),
    ("<svg>no<p>the drawing ends here</svg>", "the drawing ends here"),
    ("<svg><td>no<text>t</text></td></svg><table><td><svg><text>in</text></svg><td>cell</table>", "t\n\nin  cell"),
    ("<map name=m><area alt=no><p>choose <a href=x>north</a></map>", "choose north"),
    ("<desc>shown</desc> <metadata>as</metadata> <annotation>unknown</annotation>", "shown as unknown"),
]


@pytest.mark.parametrize("markup,want", DRAWN)
def test_formulas_drawings_and_maps(markup, want):
    """What a browser shows of them is text; titles, definitions, annotations and stray text are not."""
    assert page_text(markup) == want


def test_hostile_drawings_stay_cheap():
    assert page_text("<svg>" + "<g>" * 30_000 + "<text>x").count("x") == 1
    assert page_text("<math>" + "<msup><mi>x" * 10_000).count("x") == 10_000
    assert page_text("<svg><p>x" * 10_000).count("x") == 10_000
    assert page_text("<svg><text>" + "<![CDATA[x" * 10_000).count("x") == 10_000


def test_null_and_odd_input():
    assert page_text(None) is None
    for markup in ("<", "<>", "</", "<!", "<!--", "<a", "<a b='", "&", "&#;", "<table><table>", "<li>", "</td>", "<td>x", "\x00", "<script>", "<xmp></xmp>"):
        assert isinstance(page_text(markup), str)


def test_depth_is_no_limit():
    assert page_text("<div>" * 3000 + "x") == "x"
    assert page_text("<ul><li>" * 300 + "x").strip().endswith("x")


def test_hostile_pages_stay_cheap():
    """Long numbers, tags that never end, deep nesting, wide cells and spans: time and output stay in proportion."""
    digits = "1" * 5000
    assert page_text(f"a &#{digits}; b") == "a \ufffd b"
    assert page_text(f"&#{'0' * 5000}65;") == "A"
    assert page_text(f"<table><tr><td colspan={digits}>x<td>y</table>") == "x  y"
    assert page_text("x <b y " * 30_000).count("<b") == 30_000
    assert page_text("<div>x" * 30_000).count("x") == 30_000
    assert page_text("<b>" * 30_000 + "x" + "</i>" * 30_000) == "x"
    assert len(page_text("<blockquote>x" * 5_000)) < 300 * 5_000
    wide = page_text("<table><tr><td>" + "w" * 100_000 + "<td>z" + "<tr><td>a<td>b" * 1_000 + "</table>")
    assert len(wide) < 500_000 and wide.startswith("w" * 100_000 + "  z\na" + " " * 201 + "b\n")
    assert page_text("<table>" + "<td colspan=1000>x" * 2_000 + "</table>") == "  ".join("x" * 2_000)


def test_all_visible_words_stay_in_order(spark):
    """Against a plainer reading of the test pages: tags and unseen elements cut out."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_text.extract_text(pages).collect():
        plain = re.sub(r"(?is)<(head|script|style)\b.*?</\1>|<!--.*?-->", " ", r.html)
        plain = re.sub(r"</?(?:p|div|br|li|ul|nav|h1|article|footer|body|html|a)\b[^>]*>", " ", plain)
        plain = html.unescape(re.sub(r"<[^>]*>", "", plain)).replace("\xa0", " ")
        words = [w for w in r.text.split() if w != "-"]
        assert words == [w for w in plain.split() if w != "-"]


def test_frame_edges(spark):
    rows = [(1, "<p>a"), (2, None), (2, None), (None, ""), (3, "<p>" + "word " * 100_000)]
    df = spark.createDataFrame(rows, "page_id bigint, html string").withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.html and len(r.html)): r.text for r in html_text.extract_text(df).collect()}
    assert got[1, 4] == "a" and got[2, None] is None and len(got[3, 500_003]) == 499_999
    assert html_text.extract_text(df.limit(0)).count() == 0
    assert html_text.extract_text(df).columns == ["page_id", "html", "text"]


@pytest.mark.parametrize("markup,expected", [
    ("<table><tr><td rowspan=2>A<td>B</tr><tr><td>C</table>", "A  B\n   C"),
    ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f</table>", "a  b  c\nd     e\nf"),
    ("<table><thead><tr><td rowspan=9>A<td>B<tbody><tr><td>C<td>D</table>", "A  B\nC  D"),
    ("<table><tr><td rowspan=2 colspan=2>A<td>B<tr><td>C<tr><td>x<td>y<td>z</table>", "A     B\n      C\nx  y  z"),
    ("<table><tr><td>\u6f22\u5b57<td>b<tr><td>abcd<td>c</table>", "\u6f22\u5b57  b\nabcd  c"),
    ("a<dialog>secret</dialog><dialog open>shown</dialog>", "a\nshown"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no<img alt=no></div>", "yes"),
    ("<style>.h{display:none} p.x, #i {visibility:hidden}</style>a<b class='k h'>no</b><p class=x>no<p>b<i id=i>no</i>", "a\n\nb"),
    ("<style>@media print{.h{display:none}} .g .h{display:none}</style><b class=h>yes</b>", "yes"),
    ("<style>.h{display:none}</style><b class=h style='display:block'>yes</b><b class=h>no", "yes"),
    ("<style>.h{display:none!important}</style>x<b class=h style='display:block'>no</b>", "x"),
    ("<style>@media {</style><style>/* .a{</style><b class=a>yes</b>", "yes"),
    ("<ruby>A<rp>(</rp><rt>b</rt><rp>)</rp></ruby>", "A b"),
    ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<ol><li>a<li value=5>b<li>c</ol>", "1. a\n5. b\n6. c"),
    ("<button>ok</button><meter>5</meter>", "ok 5"),
])
def test_visibility_and_tables(markup, expected):
    assert html_text.page_text(markup) == expected
