"""Styles of texts in pages against a recursive resolver over an XML parser's tree, and broken markup against stated trees."""

import random
import re
import time
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pytest
from docloom.operators import markup
from pyspark.sql import functions as F

SHEET = [".x {color:#abc; font-weight:bold}", "span.x{font-size:9pt}", "div, .y { TEXT-ALIGN : right; font-style:oblique }", "p .y z{background:rgb(1, 300,16)}", "span {mso-font-size:7pt;font-family:'Nikosh'}", ".y{mso-bidi-font-size:5pt;font-size:6pt;mso-font-size:4pt}", ".z{color:red;text-decoration:none}", "em{font-weight:699}", ".w{font-weight:700px;text-decoration:underline dotted}", ".z{}"]
INLINE = ["color:#001122", "font-weight:normal", "font-weight: bold;font-size:1em", "a:b;;c", "text-align:center;text-decoration:underline", "background-color:#FfF", "mso-font-size:3pt"]
TAGS = ["div", "span", "b", "strong", "i", "em", "u", "section", "p", "h1", "h2", "h3", "font"]


def page(r: random.Random) -> str:
    words = iter(range(10_000))

    def attributes() -> str:
        some = {"class": " ".join(r.sample("xyzw", r.randrange(3))), "style": r.choice(INLINE), "color": r.choice(["#0f0", "blue", "rgb(0,9,200)"]), "face": "Arial", "size": r.choice(["1", "7", "9", "-2", "x"]), "align": "CENTER", "bgcolor": "#123456", "lang": r.choice(["en-GB", "bn", "de"]), "title": "<'&\""}
        return "".join(f" {k}={quoteattr(v)}" for k, v in some.items() if r.random() < 0.15)

    def part(depth: int, inside: tuple[str, ...]) -> str:
        out = []
        for _ in range(r.randrange(4)):
            if depth > 7 or r.random() < 0.4:
                out.append(escape(f"w{next(words)} <&> "))
                continue
            inner = {"div", "section", "p", "h1", "h2", "h3"} if "p" in inside or inside[-1:] in (("h1",), ("h2",), ("h3",)) else set()
            tag = r.choice([t for t in TAGS if t not in inner])
            out.append(f"<{tag}{attributes()}>{part(depth + 1, (*inside, tag))}</{tag}>")
        return "".join(out)

    css = "\n".join(r.sample(SHEET, r.randrange(len(SHEET) + 1)))
    return f'<html lang="en"><head><style>{css}</style><title>no text</title></head><body class="x">{part(0, ("body",))}{part(0, ("body",))}</body></html>'


def colour(value):
    value = value.strip()
    if value.startswith("#"):
        return (value[1:] if len(value) != 4 else "".join(c * 2 for c in value[1:])).upper()
    m = re.match(r"rgb\((\d+), ?(\d+), ?(\d+)\)", value)
    return "".join(f"{int(x):02X}" for x in m.groups()) if m else None


def said(body):
    out = {}
    for one in body.split(";"):
        name, colon, value = one.partition(":")
        name, value = name.strip().lower(), value.strip().strip("'")
        if not (colon and name and value):
            continue
        if name in ("font-family", "text-align", "font-size"):
            out[name.replace("-", "_")] = value
        elif name.startswith("mso-"):
            out.setdefault("font_size", value)
        elif name == "font-weight":
            out["is_bold"] = value == "bold" or int(re.match(r"\d*", value)[0] or 0) >= 700
        elif name == "font-style":
            out["is_italic"] = value in ("italic", "oblique")
        elif name == "text-decoration":
            out["is_underline"] = "underline" in value
        elif name in ("color", "background", "background-color"):
            out["color" if name == "color" else "bg_color"] = colour(value)
    return out


def plain(html):
    root = ElementTree.fromstring(html)
    rules, out = {}, []
    for selectors, body in re.findall(r"([^{]+)\{([^}]+)\}", root.find("head/style").text or ""):
        for s in map(str.strip, selectors.split(",")):
            names = [s] + re.findall(r"\.(\w+)", s)[:1]
            for n in names:
                rules.setdefault(n, {}).update(said(body))

    def walk(e, style):
        style = dict(style)
        if e.tag != "body":
            style |= {"is_bold": True} if e.tag in ("b", "strong", "h1", "h2", "h3") else {}
            style |= {"is_italic": True} if e.tag in ("i", "em") else {}
            style |= {"is_underline": True} if e.tag == "u" else {}
            style |= {"h1": {"font_size": "18pt"}, "h2": {"font_size": "16pt"}, "h3": {"font_size": "14pt"}}.get(e.tag, {})
            for c in e.get("class", "").split():
                style |= rules.get(c, {}) | rules.get(f"{e.tag}.{c}", {})
            style |= rules.get(e.tag, {})
            if e.get("face"):
                style["font_family"] = e.get("face")
            if e.get("size") in ("1", "7", "9"):
                style["font_size"] = {"1": "8pt", "7": "36pt", "9": "9pt"}[e.get("size")]
            style |= {"color": colour(e.get("color"))} if e.get("color") else {}
            style |= {"text_align": e.get("align").lower()} if e.get("align") else {}
            style |= {"bg_color": colour(e.get("bgcolor"))} if e.get("bgcolor") else {}
            style |= {"en-GB": {"font_family": "Times New Roman"}, "bn": {"font_family": "SutonnyMJ"}}.get(e.get("lang"), {})
            style |= said(e.get("style", ""))
        show(e.text, e.tag, style)
        for child in e:
            walk(child, style)
            show(child.tail, e.tag, style)

    def show(text, tag, style):
        if text and text.strip():
            out.append((len(out) + 1, tag, text, *(style.get(s) for s in markup.STYLE)))

    walk(root.find("body"), {"font_size": "12pt", "is_bold": False, "is_italic": False, "is_underline": False, "text_align": "left"})
    return out


def test_well_formed_pages_equal_a_recursive_resolver(spark):
    r = random.Random(7)
    pages = {i: page(r) for i in range(300)}
    got = {i: [] for i in pages}
    for row in markup.text_styles(spark.createDataFrame(list(pages.items()), "page long, html string").repartition(8), ["page"], "html").collect():
        got[row.page].append(tuple(row)[1:])
    want = {i: plain(html) for i, html in pages.items()}
    assert sum(map(len, want.values())) > 1000
    for i in pages:
        assert sorted(got[i]) == want[i], pages[i]


@pytest.mark.parametrize(
    ("html", "texts"),
    [
        ("<p>a<p>b", ["a:p", "b:p"]),
        ("<p><b>a<p>b</b>c", ["a:p>b", "b:p>b", "c:p"]),
        ("<ul><li>a<ul><li>b</ul>c<li>d</ul>e", ["a:ul>li", "b:ul>li>ul>li", "c:ul>li", "d:ul>li", "e:"]),
        ("<table><tr><td><b>a<td>b<tr><th>c</table>d", ["a:table>tr>td>b", "b:table>tr>td", "c:table>tr>th", "d:"]),
        ("<b><p>a</b>b</p>c", ["a:b>p", "b:p", "c:"]),
        ("<i><div><u>a</i>b</div>c", ["a:i>div>u", "b:div>u", "c:u"]),
        ("a</b></p></x><br/>b", ["a:", "b:"]),
        ("<span><div>a</span>b</div>c", ["a:span>div", "b:span>div", "c:span"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["a:dl>dt", "b:dl>dd", "c:dl>dt"]),
        ("<h1>a<h2>b</h1>c", ["a:h1", "b:h2", "c:"]),
        ("<a href=1>a<a href=2>b</a>c", ["a:a", "b:a", "c:"]),
        ("<html><head><title>t</title><p>a", ["a:html>p"]),
        ("<p>a<!-- <p>x --><!DOCTYPE x>b<?x?>c< d<3", ["a:p", "b:p", "c< d<3:p"]),
        ("<script>if(a<b)'</p>'</script>a<textarea><b>x", ["a:"]),
        ("<p title='a>b' class=\"x", []),
        ("<p>a<b", ["a:p"]),
        ("a<!-- never", ["a:"]),
        ("<p>&lt;b&gt;&amp &nbsp;&#65;", ["<b>& \xa0A:p"]),
        ("", []),
        ("<", ["<:"]),
    ],
)
def test_broken_pages(html, texts):
    nodes = markup.tree(html)

    def way(n):
        return [] if n is None else [*way(nodes[n]["parent"]), nodes[n]["tag"]]

    assert [f"{n['text']}:{'>'.join(way(n['parent']))}" for n in nodes if n["place"]] == texts
    for n in nodes:
        below = [m["node"] for m in nodes if n["node"] in (m["parent"],)]
        assert n["last"] == max([n["node"], *(nodes[m]["last"] for m in below)])


@pytest.mark.parametrize("piece", ["<p><b>word", "<b>", "<", "<a ", "<p x='", "<!--", "<li>", "</b>", "<title>", "<td><i>", "&amp"])
def test_long_pages_take_linear_time(piece):
    start = time.perf_counter()
    markup.tree(piece * (400_000 // len(piece)))
    assert time.perf_counter() - start < 10


def test_deep_pages_missing_values_and_no_rows(spark):
    rows = [(1, "a", "<div align=right>" + "<div>" * 300 + "deep"), (2, None, None), (None, "b", "<style>p{color:#111}</style><p>x"), (None, "c", ""), (3, None, "<style>p{color:#111}</style><p>y")]
    pages = spark.createDataFrame(rows, "tag_id long, part string, html string").withColumn("node", F.lit(5))
    got = sorted((r.text, r.tag_id, r.part, r.text_align, r.color) for r in markup.text_styles(pages, ["tag_id", "part"], "html").collect())
    assert got == [("deep", 1, "a", "right", None), ("x", None, "b", "left", "111111"), ("y", 3, None, "left", "111111")]
    empty = markup.text_styles(pages.limit(0), ["tag_id", "part"], "html")
    assert empty.count() == 0 and set(markup.STYLE) < set(empty.columns)


def test_a_chain_is_inherited_whole(spark):
    chain = spark.createDataFrame([(1, i, i - 1 if i else None, "top" if i == 0 else "mid" if i == 40 else None) for i in range(100)], "k int, n long, up long, v string")
    got = {r.n: r.v for r in markup.inherited(chain, ["k"], "n", "up", ["v"], 99).collect()}
    assert got == {i: "top" if i < 40 else "mid" for i in range(100)}
