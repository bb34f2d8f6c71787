"""Web pages as tables: a node table, the declarations of style sheets, and the style that each text is shown in.

A page becomes rows of nodes, numbered in document order, with their parent, depth and the last node below them. Rules meet
elements by equality of keys (tag, class, tag.class), so a page with many rules makes no pairs, and what an element doesn't
say it takes from above by doubling: every round reaches twice as far up, so a tree of any depth needs the logarithm of its
depth in rounds, and no page has to fit one task after it has been read.

Reading follows browsers in what changes styles: void elements, raw text, attributes with or without quotes, end tags that
are left out (p, li, dt, dd, rows and cells), end tags of nothing, and formatting elements (b, i, a, font...) that stay open
across blocks and are opened again in the next text. Where an end tag closes a formatting element outside of blocks that are
still open, those blocks are continued behind it as nodes of their own. Text in tables outside of cells stays where it is.

Defined results: a null or empty page has no nodes; a tag that the page's end cuts is dropped, as is all of a comment that
never ends; a ``<`` that starts no tag is text. Pages are known by ``keys``; two rows with the same keys are two pages whose
nodes can't be told apart, so keys must be unique.
"""

from __future__ import annotations

import html as entities
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import storage
from docloom.parse import udfs

# Element names by what they do to the elements that are open.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
CELLS = frozenset("td th caption".split())
PARTS_OF_TABLES = CELLS | frozenset("table tr tbody thead tfoot".split())
WALLS = frozenset("table td th caption button object marquee applet template html".split())
SPECIAL = BLOCKS | WALLS | PARTS_OF_TABLES | frozenset("head body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base link meta noscript script style title template".split())
#: Start tags that end other elements: which, and what they don't reach beyond.
ENDS = {
    "li": (frozenset(("li",)), WALLS | {"ul", "ol"}),
    "dt": (frozenset(("dt", "dd")), WALLS | {"dl"}),
    "dd": (frozenset(("dt", "dd")), WALLS | {"dl"}),
    "option": (frozenset(("option",)), WALLS | {"select"}),
    "td": (CELLS, frozenset(("tr", "table"))),
    "th": (CELLS, frozenset(("tr", "table"))),
    "tr": (frozenset(("tr", "caption")), frozenset(("table",))),
    "tbody": (frozenset(("tbody", "thead", "tfoot", "caption")), frozenset(("table",))),
    "thead": (frozenset(("tbody", "thead", "tfoot", "caption")), frozenset(("table",))),
    "tfoot": (frozenset(("tbody", "thead", "tfoot", "caption")), frozenset(("table",))),
}
#: Equal formatting elements that are opened again at most, as in browsers.
ALIKE = 3

# What a style holds, the styles that elements have by themselves, sizes by number, and the patterns of style sheets.
STYLE = ("font_family", "font_size", "is_bold", "is_italic", "is_underline", "color", "bg_color", "text_align")
BOLD = ("b", "strong", "h1", "h2", "h3", "th")
ITALIC = ("i", "em")
UNDERLINE = ("u",)
TITLE_SIZES = {"h1": "18pt", "h2": "16pt", "h3": "14pt"}
FONT_SIZES = {1: "8pt", 2: "10pt", 3: "12pt", 4: "14pt", 5: "18pt", 6: "24pt", 7: "36pt"}
FONT_OF_LANGUAGE = (("EN", "Times New Roman"), ("BN", "SutonnyMJ"))
FIRST = {"font_size": "12pt", "text_align": "left"}
SAYING = ("style", "lang", "face", "size", "color", "bgcolor", "align")
RULE = r"([^{]+)\{([^}]+)\}"
CLASS_OF_SELECTOR = r"\.([A-Za-z0-9_-]+)"

_SPACE = re.compile(r"[\s/]*")
_NAME = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def tokens(page: str):
    """Texts as ("text", text), start tags as ("start", name, attributes), end tags as ("end", name), and ("gap",) for what stands for nothing."""
    at, shown, n = 0, [], len(page)

    def flush():
        if shown:
            yield "text", entities.unescape("".join(shown))
            shown.clear()

    while at < n:
        less = page.find("<", at)
        if less < 0:
            less = n
        if less > at:
            shown.append(page[at:less])
        at = less
        if at == n:
            break
        tag = _TAG.match(page, at)
        if not tag:
            following = page[at + 1 : at + 2]
            if following not in ("!", "?", "/") or not following:
                shown.append("<")
                at += 1
                continue
            yield from flush()
            end = page.find("-->", at + 2) if page.startswith("<!--", at) else page.find(">", at)
            if end < 0:
                return
            at = end + (3 if page.startswith("-->", end) else 1)
            yield ("gap",)
            continue
        yield from flush()
        name, closing, at = tag[1].lower(), page[at + 1] == "/", tag.end()
        attrs: dict[str, str] = {}
        while True:
            at = _SPACE.match(page, at).end()
            if at >= n:
                return
            if page[at] == ">":
                at += 1
                break
            word = _NAME.match(page, at)
            at = word.end()
            value = ""
            if equals := _EQUALS.match(page, at):
                at = equals.end()
                quote = page[at : at + 1]
                if quote in ('"', "'") and quote:
                    end = page.find(quote, at + 1)
                    if end < 0:
                        return
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare[0], bare.end()
            attrs.setdefault(word[0].lower(), entities.unescape(value))
        if closing:
            yield "end", name
            continue
        yield "start", name, attrs
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            raw = page[at : end.start() if end else n]
            if raw:
                yield "text", entities.unescape(raw) if name in ("title", "textarea") else raw
            yield "end", name
            if not end:
                return
            close = page.find(">", end.end())
            at = n if close < 0 else close + 1
    yield from flush()


class _Tree:
    """The elements that are open, those to be opened again, and the nodes that were made."""

    def __init__(self):
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.held: set[int] = set()
        self.count: dict[str, int] = {}
        #: Formatting elements that no end tag has ended; None where a cell begins.
        self.formatting: list[dict | None] = []
        self.places = 0

    def add(self, tag: str | None, attrs: dict[str, str], text: str | None) -> dict:
        top = self.open[-1] if self.open else None
        number = len(self.nodes)
        node = {"node": number, "parent": top["node"] if top else None, "depth": len(self.open), "last": number, "tag": tag, "within": top["tag"] if top else None, "attrs": attrs, "text": text, "place": None}
        self.nodes.append(node)
        return node

    def push(self, tag: str, attrs: dict[str, str]) -> dict:
        node = self.add(tag, attrs, None)
        self.open.append(node)
        self.held.add(node["node"])
        self.count[tag] = self.count.get(tag, 0) + 1
        return node

    def pop(self) -> dict:
        node = self.open.pop()
        node["last"] = len(self.nodes) - 1
        self.held.discard(node["node"])
        self.count[node["tag"]] -= 1
        if node["tag"] in CELLS:
            while self.formatting and self.formatting.pop() is not None:
                pass
        return node

    def found(self, names, walls) -> int | None:
        """The innermost open element of these names that no wall hides."""
        if not any(self.count.get(name) for name in names):
            return None
        for i in range(len(self.open) - 1, -1, -1):
            tag = self.open[i]["tag"]
            if tag in names:
                return i
            if tag in walls:
                return None
        return None

    def close(self, i: int | None) -> None:
        while i is not None and len(self.open) > i:
            self.pop()

    def reopen(self) -> None:
        """Opens the formatting elements again that were closed with a block."""
        first = len(self.formatting)
        while first and self.formatting[first - 1] is not None and self.formatting[first - 1]["node"] not in self.held:
            first -= 1
        for i in range(first, len(self.formatting)):
            old = self.formatting[i]
            self.formatting[i] = self.push(old["tag"], old["attrs"])

    def remember(self, node: dict) -> None:
        same = []
        for i in range(len(self.formatting) - 1, -1, -1):
            other = self.formatting[i]
            if other is None:
                break
            if other["tag"] == node["tag"] and other["attrs"] == node["attrs"]:
                same.append(i)
        if len(same) >= ALIKE:
            del self.formatting[same[-1]]
        self.formatting.append(node)

    def forget(self, name: str) -> bool:
        """The end of a formatting element; blocks within it that are open go on behind it. False if none of that name is known."""
        at = next((i for i in range(len(self.formatting) - 1, -1, -1) if self.formatting[i] is None or self.formatting[i]["tag"] == name), None)
        if at is None or self.formatting[at] is None:
            return False
        node = self.formatting.pop(at)
        if node["node"] not in self.held:
            return True
        i = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i] is node)
        block = next((j for j in range(i + 1, len(self.open)) if self.open[j]["tag"] in SPECIAL), None)
        going_on = [] if block is None else self.open[block:]
        self.close(i)
        for old in going_on:
            new = self.push(old["tag"], old["attrs"])
            self.formatting = [new if e is old else e for e in self.formatting]
        return True

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if name in ("html", "head", "body") and self.count.get(name):
            return
        if name not in IN_HEAD and self.count.get("head"):
            self.close(self.found({"head"}, ()))
        if name in BLOCKS:
            self.close(self.found({"p"}, WALLS))
        if name in HEADINGS and self.open and self.open[-1]["tag"] in HEADINGS:
            self.pop()
        if name in ENDS:
            self.close(self.found(*ENDS[name]))
        if name not in SPECIAL and name not in IN_HEAD:
            if name == "a" and any(e is not None and e["tag"] == "a" for e in self.formatting):
                self.forget("a")
            self.reopen()
        if name in VOID:
            self.add(name, attrs, None)
            return
        node = self.push(name, attrs)
        if name in FORMATTING:
            self.remember(node)
        elif name in CELLS:
            self.formatting.append(None)

    def end(self, name: str) -> None:
        if name in ("html", "body"):
            return
        if name in FORMATTING and self.forget(name):
            return
        if name in HEADINGS:
            self.close(self.found(HEADINGS, WALLS))
        elif name in PARTS_OF_TABLES:
            self.close(self.found({name}, {"table"}))
        elif name in SPECIAL:
            self.close(self.found({name}, WALLS | {"ul", "ol"} if name == "li" else WALLS))
        else:
            self.close(self.found({name}, SPECIAL))

    def text(self, text: str) -> None:
        top = self.open[-1]["tag"] if self.open else None
        if top not in RAW and text.strip():
            if top == "head":
                self.close(self.found({"head"}, ()))
            self.reopen()
        node = self.add(None, {}, text)
        if text.strip() and top not in RAW:
            node["place"] = self.places = self.places + 1


def tree(page: str) -> list[dict]:
    """The nodes of a page in document order; ``place`` numbers its texts that are shown and not blank."""
    made = _Tree()
    for kind, *rest in tokens(page):
        if kind == "start":
            made.start(*rest)
        elif kind == "end":
            made.end(*rest)
        elif kind == "text":
            made.text(*rest)
    made.close(0)
    for node in made.nodes:
        node["attrs"] = list(node["attrs"].items())
    return made.nodes


_tree = udfs.over_text(tree, "array<struct<node:long,parent:long,depth:int,last:long,tag:string,within:string,attrs:map<string,string>,text:string,place:long>>")


def nodes(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """keys, node, parent, depth, last (of the nodes below it), tag (null for texts), within (the parent's tag), attrs, text, place."""
    return pages.select(*keys, F.inline(_tree(F.col(html))))


def _colour(value: Column) -> Column:
    """Six capital hex digits; empty for what is neither #hex nor rgb(), as such a colour takes back an inherited one."""
    value = F.trim(value)
    digits = F.substring(value, 2, 1_000_000)
    short = F.concat(*(F.repeat(F.substring(digits, i, 1), 2) for i in (1, 2, 3)))
    rgb = r"(?i)rgb\s*\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)"
    parts = [F.hex(F.regexp_extract(value, rgb, i).try_cast("long")) for i in (1, 2, 3)]
    parts = [F.when(F.length(p) < 2, F.concat(F.lit("0"), p)).otherwise(p) for p in parts]
    return F.when(value.startswith("#"), F.upper(F.when(F.length(digits) == 3, short).otherwise(digits))).when(value.rlike(rgb), F.concat(*parts)).when(value.isNotNull(), "")


def declarations(body: Column) -> Column:
    """``name: value; ...`` as array<struct<name,value>>, names in lower case, without those that lack either."""
    def pair(part: Column) -> Column:
        value = F.trim(F.regexp_replace(part, r"(?s)^[^:]*:", ""))
        return F.named_struct(F.lit("name"), F.lower(F.trim(F.regexp_extract(part, r"(?s)^([^:]*):", 1))), F.lit("value"), F.regexp_replace(value, r"^['\"]|['\"]$", ""))

    flat = F.regexp_replace(body, r"\s", " ")
    return F.filter(F.transform(F.filter(F.split(flat, ";"), lambda p: p.contains(":")), pair), lambda d: (d["name"] != "") & (d["value"] != ""))


def with_style(df: DataFrame, body: Column, name: str) -> DataFrame:
    """The rows with the style that declarations state, as a struct; a field is null where they say nothing about it. Declarations are taken apart once a row."""
    said = F.col("said list")

    def of(*names: str, at: int = -1) -> Column:
        return F.try_element_at(F.filter(said, lambda d: d["name"].isin(*names)), F.lit(at))["value"]

    raw = F.struct(
        of("font-family").alias("font_family"),
        F.coalesce(of("font-size"), of("mso-bidi-font-size", "mso-font-size", at=1)).alias("font_size"),
        of("font-weight").alias("weight"),
        of("font-style").alias("slant"),
        of("text-decoration").alias("line"),
        of("color").alias("color"),
        of("background-color", "background").alias("bg_color"),
        of("text-align").alias("text_align"),
    )
    field = F.col("said raw").getField
    weight = field("weight")
    style = F.struct(
        field("font_family").alias("font_family"),
        field("font_size").alias("font_size"),
        ((weight == "bold") | F.coalesce(F.regexp_extract(weight, r"^([+-]?\d+)", 1).try_cast("long") >= 700, F.lit(False))).alias("is_bold"),
        field("slant").isin("italic", "oblique").alias("is_italic"),
        field("line").contains("underline").alias("is_underline"),
        _colour(field("color")).alias("color"),
        _colour(field("bg_color")).alias("bg_color"),
        field("text_align").alias("text_align"),
    )
    return df.withColumn("said list", declarations(body)).withColumn("said raw", F.when(F.size(said) > 0, raw)).withColumn(name, style).drop("said list", "said raw")


def sheet_rules(nodes_: DataFrame, keys: list[str]) -> DataFrame:
    """Every selector of a page's style sheets in order: keys, rule_order, selector, body."""
    sheets = nodes_.filter((F.col("within") == "style") & F.col("text").isNotNull())
    rules = sheets.select(*keys, "node", F.posexplode(F.regexp_extract_all("text", F.lit(RULE), F.lit(0))).alias("rule", "whole"))
    rules = rules.select(*keys, "node", "rule", F.regexp_extract("whole", RULE, 2).alias("body"), F.posexplode(F.split(F.regexp_extract("whole", RULE, 1), ",")).alias("at", "selector"))
    return rules.select(*keys, F.struct("node", "rule", "at").alias("rule_order"), F.regexp_replace("selector", r"^\s+|\s+$", "").alias("selector"), "body")


def _keyed_rules(nodes_: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key of a page that rules are found by: a selector as it is, and the first class that it names. Later rules win."""
    named = F.regexp_extract("selector", CLASS_OF_SELECTOR, 1)
    found = F.array_distinct(F.filter(F.array(F.col("selector"), named), lambda k: k != ""))
    rules = sheet_rules(nodes_, keys).select(*keys, "rule_order", found.alias("rule_keys"), "body")
    rules = with_style(rules, F.col("body"), "said").select(*keys, "rule_order", F.explode("rule_keys").alias("rule_key"), "said")
    rules = rules.filter(reduce(Column.__or__, (F.col(f"said.{s}").isNotNull() for s in STYLE)))
    return rules.groupBy(*keys, "rule_key").agg(*(F.max_by(f"said.{s}", F.when(F.col(f"said.{s}").isNotNull(), F.col("rule_order"))).alias(s) for s in STYLE))


def _stated(elements: DataFrame, keys: list[str], rules: DataFrame) -> DataFrame:
    """What style sheets say about each kind of element (tag and class attribute) of a page: classes in their order, each alone and then with the tag, and the tag last."""
    classes = F.filter(F.split("kind", r"\s+"), lambda c: c != "")
    asked = F.flatten(F.array(F.flatten(F.transform(classes, lambda c: F.array(c, F.concat("tag", F.lit("."), c)))), F.array("tag")))
    kinds = elements.select(*keys, "tag", "kind").distinct()
    asking = kinds.select(*keys, "tag", "kind", F.posexplode(asked).alias("rank", "rule_key"))
    met = _met(asking, rules, keys, ["rule_key"], "inner")
    return met.groupBy(*keys, "tag", "kind").agg(*(F.max_by(s, F.when(F.col(s).isNotNull(), F.col("rank"))).alias(s) for s in STYLE))


def _own(tag: Column, attrs: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """What an element's tag says by itself, and what its attributes say, the style attribute (as the column ``inline``) above the others."""
    by_tag: dict[str, Column] = {
        "font_size": reduce(lambda c, t: c.when(tag == t[0], t[1]), list(TITLE_SIZES.items())[1:], F.when(tag == "h1", TITLE_SIZES["h1"])),
        "is_bold": F.when(tag.isin(*BOLD), True),
        "is_italic": F.when(tag.isin(*ITALIC), True),
        "is_underline": F.when(tag.isin(*UNDERLINE), True),
    }

    def given(name: str) -> Column:
        return F.when(attrs[name] != "", attrs[name])

    size = F.regexp_extract(given("size"), r"^\s*([+-]?\d+)", 1).try_cast("int")
    known = F.create_map(*(F.lit(x) for pair in FONT_SIZES.items() for x in pair))
    language = F.upper(given("lang"))
    of_language = reduce(lambda c, p: c.when(language.contains(p[0]), p[1]), FONT_OF_LANGUAGE[1:], F.when(language.contains(FONT_OF_LANGUAGE[0][0]), FONT_OF_LANGUAGE[0][1]))
    by_attribute = {
        "font_family": F.coalesce(of_language, given("face")),
        "font_size": F.coalesce(F.try_element_at(known, size), F.when(size > 0, F.concat(size.cast("string"), F.lit("pt")))),
        "color": _colour(given("color")),
        "bg_color": _colour(given("bgcolor")),
        "text_align": F.lower(given("align")),
    }
    return by_tag, {s: F.coalesce(F.col(f"inline.{s}"), by_attribute[s]) if s in by_attribute else F.col(f"inline.{s}") for s in STYLE}


def _met(left: DataFrame, right: DataFrame, keys: list[str], on: list[str], how: str) -> DataFrame:
    """A join on keys, of which nulls are equal, and on further columns."""
    other = right.select(*(F.col(c).alias(f"met {c}" if c in (*keys, *on) else c) for c in right.columns))
    same = [F.col(k).eqNullSafe(F.col(f"met {k}")) for k in keys] + [F.col(c) == F.col(f"met {c}") for c in on]
    return left.join(other, reduce(Column.__and__, same), how).drop(*(f"met {c}" for c in (*keys, *on)))


def inherited(df: DataFrame, keys: list[str], node: str, parent: str, columns: list[str], depth: int) -> DataFrame:
    """Every row of a forest with its columns filled from the nearest row above that has a value; ``depth`` bounds the longest way up.

    Doubling: after a round a row knows what it would get from twice as far up, and who stands there. Each round is one join of
    the rows with themselves on (keys, node) and ends in a written table. Rows with nobody left above them stay where they are,
    and those that also have no value give nothing. A parent column named ``next up`` is used up, so it isn't carried along.
    """
    now = storage.table(df.withColumn("next up", F.col(parent)), "inherit")
    for _ in range(max(depth, 0).bit_length()):
        giving = now.filter(reduce(Column.__or__, (F.col(c).isNotNull() for c in ("next up", *columns))))
        above = giving.select(*keys, F.col(node).alias("next up"), F.col("next up").alias("up next"), *(F.col(c).alias(f"up {c} value") for c in columns))
        rest = [c for c in now.columns if c not in columns and c != "next up"]
        further = _met(now.filter(F.col("next up").isNotNull()), above, keys, ["next up"], "left").select(*rest, *(F.coalesce(c, f"up {c} value").alias(c) for c in columns), F.col("up next").alias("next up"))
        before, now = now, storage.table(now.filter(F.col("next up").isNull()).unionByName(further), "inherit")
        storage.drop(before)
    return now.drop("next up")


def text_styles(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """Every text of a page that is shown and not blank, with the style that it is shown in: keys, place, tag, text and the columns of STYLE.

    Rising precedence: what is inherited, the tag, its classes, rules of the tag, attributes, the style attribute. html, head and
    body have no style of their own. A colour that can't be read takes back an inherited one.
    """
    key = [f"key {i}" for i in range(len(keys))]
    with storage.scope() as kept:
        all_nodes = storage.table(nodes(pages.select(*(F.col(k).alias(name) for k, name in zip(keys, key, strict=True)), html), key, html), "nodes")
        silent = ("html", "head", "body")
        elements = all_nodes.filter(~F.col("tag").isin(*silent)).select("*", F.coalesce(F.col("attrs")["class"], F.lit("")).alias("kind"), F.when(~F.col("within").isin(*silent), F.col("parent")).alias("up"))
        stated = _stated(elements, key, _keyed_rules(all_nodes, key)).select(*key, "tag", "kind", F.struct(*STYLE).alias("stated"))
        by_tag, by_attribute = _own(F.col("tag"), F.col("attrs"))
        own = {s: F.coalesce(F.col(f"given.{s}"), F.col(f"stated.{s}"), *([by_tag[s]] if s in by_tag else [])) for s in STYLE}
        said = with_style(elements, F.when(F.col("attrs")["style"] != "", F.col("attrs")["style"]), "inline")
        # most elements have no attribute that says anything: they are not looked into, and attributes are not shuffled
        says = F.arrays_overlap(F.map_keys("attrs"), F.array(*map(F.lit, SAYING)))
        said = said.select(*key, "node", "up", "tag", "kind", F.when(says, F.struct(*(by_attribute[s].alias(s) for s in STYLE))).alias("given"))
        said = _met(said, stated, key, ["tag", "kind"], "left").select(*key, "node", F.col("up").alias("next up"), *(own[s].alias(s) for s in STYLE))
        deepest = elements.agg(F.max(F.when(F.col("up").isNotNull(), F.col("depth"))) - F.min("depth")).first()[0] or 0
        full = inherited(said, key, "node", "next up", list(STYLE), deepest)
        full = full.filter(reduce(Column.__or__, (F.col(s).isNotNull() for s in STYLE)))
        shown = all_nodes.filter(F.col("place").isNotNull()).select(*key, "place", F.col("within").alias("tag"), "text", F.col("parent").alias("node"))
        last: dict[str, Column] = {s: F.col(s) for s in STYLE}
        last |= {s: F.coalesce(last[s], F.lit(False)) for s in ("is_bold", "is_italic", "is_underline")}
        last |= {s: F.when(last[s] != "", last[s]) for s in ("color", "bg_color")}
        last |= {s: F.coalesce(last[s], F.lit(FIRST[s])) for s in FIRST}
        styled = _met(shown, full, key, ["node"], "left").select(*(F.col(name).alias(k) for k, name in zip(keys, key, strict=True)), "place", "tag", "text", *(last[s].alias(s) for s in STYLE))
        out = storage.table(styled, "styled")
        kept.append(out)
    return out
