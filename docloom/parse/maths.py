"""Maths in text: segments, LaTeX to OMML and to field codes, and repairs of what recognition broke."""

from __future__ import annotations

import re
import unicodedata
from xml.sax.saxutils import escape

from docloom.functions.text import SYMBOLS
from docloom.parse.udfs import over_text

DELIMITED = re.compile(r"\$\$(.*?)\$\$|\$([^$]+?)\$|\\\[(.*?)\\\]|\\\((.*?)\\\)", re.S)
BENGALI = re.compile("[\u0980-\u09ff]")
BENGALI_RUN = re.compile("([\u0980-\u09ff]+(?:\\s+[\u0980-\u09ff]+)*)")


def segments(text: str) -> list[dict]:
    """Text and maths in order. Bengali words inside plain maths are text; maths parted by a sign only is joined."""
    parts: list[dict] = []

    def add(kind: str, value: str) -> None:
        if value:
            parts.append({"type": kind, "value": value})

    at = 0
    for m in DELIMITED.finditer(text):
        add("text", text[at : m.start()])
        at, inner = m.end(), next((g for g in m.groups() if g), "")
        if re.search(r"[\^_{}\\]", inner) or not BENGALI.search(inner):
            add("math", inner)
            continue
        for piece in BENGALI_RUN.split(inner):
            if BENGALI.search(piece):
                add("text", f" {piece.strip()} ")
            elif piece.strip():
                add("text" if re.fullmatch(r"\s*[.,;:]+\s*", piece) else "math", piece.strip())
    add("text", text[at:])
    out: list[dict] = []
    for i, p in enumerate(parts):
        glue = p["type"] == "text" and not BENGALI.search(p["value"]) and len(p["value"]) <= 24 and (not p["value"].strip() or re.search(r"[=+\-*/^_<>()\[\]{}\\.,'|!:\d]", p["value"]))
        if glue and out and out[-1]["type"] == "math" and i + 1 < len(parts) and parts[i + 1]["type"] == "math":
            out[-1]["value"] += " " + p["value"].strip()
        elif p["type"] == "math" and out and out[-1]["type"] == "math":
            out[-1]["value"] = " ".join((out[-1]["value"].strip() + " " + p["value"].strip()).split())
        else:
            out.append(dict(p))
    return out


TOKEN = re.compile(r"\\[A-Za-z]+|\\.|[\^_{}]|[0-9.]+|[A-Za-z]|\s+|.", re.S)


class Tree:
    """Recursive descent over a small LaTeX: groups, scripts, fractions, roots, sums; anything else is text."""

    def __init__(self, latex: str) -> None:
        self._tokens = [t for t in TOKEN.findall(latex) if not t.isspace()]
        self._at = 0

    def _peek(self) -> str:
        return self._tokens[self._at] if self._at < len(self._tokens) else ""

    def _next(self) -> str:
        self._at += 1
        return self._tokens[self._at - 1]

    def row(self, stop: str = "") -> list:
        out = []
        while self._peek() and self._peek() != stop:
            out.append(self._scripted(self._atom()))
        if self._peek() == stop and stop:
            self._at += 1
        return out

    def _group(self) -> list:
        if self._peek() == "{":
            self._at += 1
            return self.row("}")
        return [self._atom()] if self._peek() else []

    def _atom(self):
        t = self._next()
        if t == "{":
            return ("row", self.row("}"))
        if t in ("\\frac", "\\dfrac", "\\tfrac"):
            return ("frac", self._group(), self._group())
        if t == "\\sqrt":
            degree = []
            if self._peek() == "[":
                self._at += 1
                degree = self.row("]")
            return ("sqrt", degree, self._group())
        if t in ("\\sum", "\\int", "\\prod"):
            return ("text", {"\\sum": "∑", "\\int": "∫", "\\prod": "∏"}[t])
        if t in ("\\text", "\\mathrm", "\\mbox"):
            return ("row", self._group())
        if t in ("\\left", "\\right"):
            return ("text", "" if self._peek() == "." and self._next() else "")
        return ("text", SYMBOLS.get(t[1:], t[1:]) if t.startswith("\\") else t)

    def _scripted(self, base):
        sub = sup = None
        while self._peek() in ("^", "_"):
            if self._next() == "^":
                sup = self._group()
            else:
                sub = self._group()
        return base if sub is None and sup is None else ("script", base, sub, sup)


def omml(latex: str) -> str:
    """Office maths of a formula."""
    run = lambda t: f"<m:r><m:t>{escape(t)}</m:t></m:r>" if t else ""
    many = lambda xs: "".join(map(one, xs))

    def one(x) -> str:
        kind = x[0]
        if kind == "text":
            return run(x[1])
        if kind == "row":
            return many(x[1])
        if kind == "frac":
            return f"<m:f><m:num>{many(x[1])}</m:num><m:den>{many(x[2])}</m:den></m:f>"
        if kind == "sqrt":
            hide = "" if x[1] else '<m:radPr><m:degHide m:val="1"/></m:radPr>'
            return f"<m:rad>{hide}<m:deg>{many(x[1])}</m:deg><m:e>{many(x[2])}</m:e></m:rad>"
        tag = "sSubSup" if x[2] is not None and x[3] is not None else "sSub" if x[2] is not None else "sSup"
        sub = f"<m:sub>{many(x[2])}</m:sub>" if x[2] is not None else ""
        sup = f"<m:sup>{many(x[3])}</m:sup>" if x[3] is not None else ""
        return f"<m:{tag}><m:e>{one(x[1])}</m:e>{sub}{sup}</m:{tag}>"

    return f"<m:oMath>{many(Tree(latex).row())}</m:oMath>"


def eq_field(latex: str) -> str:
    """The EQ field code of a formula: \\f for fractions, \\r for roots, \\s for scripts."""
    many = lambda xs: "".join(map(one, xs))

    def one(x) -> str:
        kind = x[0]
        if kind == "text":
            return x[1]
        if kind == "row":
            return many(x[1])
        if kind == "frac":
            return f"\\f({many(x[1])},{many(x[2])})"
        if kind == "sqrt":
            return f"\\r({many(x[1])},{many(x[2])})" if x[1] else f"\\r(,{many(x[2])})"
        return one(x[1]) + (f"\\s\\do4({many(x[2])})" if x[2] is not None else "") + (f"\\s\\up6({many(x[3])})" if x[3] is not None else "")

    return "EQ " + many(Tree(latex).row())


def field_of_omml(xml: str) -> str:
    """The EQ field code of office maths: the parts of fractions, roots and scripts by their element names; nothing for XML that can't be read."""
    from xml.etree import ElementTree

    def one(e) -> str:
        tag = e.tag.rpartition("}")[2]
        inner = lambda name: "".join(one(c) for p in e for c in p if p.tag.rpartition("}")[2] == name)
        if tag == "t":
            return e.text or ""
        if tag == "f":
            return f"\\f({inner('num')},{inner('den')})"
        if tag == "rad":
            return f"\\r({inner('deg')},{inner('e')})"
        if tag in ("sSub", "sSup", "sSubSup"):
            sub, sup = inner("sub"), inner("sup")
            return inner("e") + (f"\\s\\do4({sub})" if sub else "") + (f"\\s\\up6({sup})" if sup else "")
        return "" if tag.endswith("Pr") else "".join(map(one, e))

    try:
        return "EQ " + one(ElementTree.fromstring(re.sub("<m:oMath", '<m:oMath xmlns:m="m"', xml, count=1)))
    except ElementTree.ParseError:
        return "EQ "


def rtf_math(xml: str) -> str:
    """RTF maths words of office maths, tag by tag."""
    out = []
    for close, tag, text in re.findall(r"<(/?)m:(\w+)[^>]*?/?>|([^<]+)", xml):
        if text:
            out.append(text)
        elif tag not in ("t", "radPr", "degHide"):
            out.append("}" if close else "{\\m" + tag + " ")
    return "".join(out)


#: Superscripts and subscripts of Unicode.
SUPER, SUB = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿ", "0123456789+-n"), str.maketrans("₀₁₂₃₄₅₆₇₈₉₊₋", "0123456789+-")


def unicode_to_latex(text: str) -> str:
    """Superscript and subscript characters and roots as LaTeX, each formula between dollar signs of its own."""
    text = re.sub("([A-Za-z0-9)])([⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿ]+)", lambda m: f"${m[1]}^{{{m[2].translate(SUPER)}}}$", text)
    text = re.sub("([A-Za-z)])([₀₁₂₃₄₅₆₇₈₉₊₋]+)", lambda m: f"${m[1]}_{{{m[2].translate(SUB)}}}$", text)
    return re.sub(r"√\(?([A-Za-z0-9]+)\)?", r"$\\sqrt{\1}$", text)


def readable(text: str) -> str:
    """Broken LaTeX as text: fractions with a slash, names as characters, braces and dollars gone."""
    text = re.sub(r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", r"\1/\2", text)
    text = re.sub(r"\\sqrt\{([^{}]*)\}", r"√\1", text)
    text = re.sub(r"\\([A-Za-z]+)", lambda m: SYMBOLS.get(m[1], m[1] if len(m[1]) > 2 else ""), text)
    return re.sub(r"[{}$`\\]", "", text)


def bengali_outside(text: str) -> str:
    """Bengali words leave $...$; maths that is empty then goes."""
    def part(m: re.Match) -> str:
        out = "".join(f" {p.strip()} " if BENGALI.search(p) else f"${p.strip()}$" if p.strip() else "" for p in BENGALI_RUN.split(m[1]))
        return out if BENGALI.search(m[1]) and "\\" not in m[1] else m[0] if m[1].strip() else ""

    return re.sub(r"\$([^$\n]*)\$", part, text)


def outside_math(text: str, f) -> str:
    at, out = 0, []
    for m in DELIMITED.finditer(text):
        out += [f(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, f(text[at:])])


def heal(text: str) -> str:
    """Powers of ten, chemical formulae and algebraic powers outside maths become maths."""
    def part(t: str) -> str:
        t = re.sub(r"(\d+(?:\.\d+)?)\s*[x×]\s*10\^?([-−]?\d+)\b", lambda m: f"${m[1]} \\times 10^{{{m[2].replace('−', '-')}}}$", t)
        t = re.sub(r"\b((?:[A-Z][a-z]?\d+)(?:[A-Z][a-z]?\d*)*|(?:[A-Z][a-z]?)+(?:[A-Z][a-z]?\d+)+(?:[A-Z][a-z]?\d*)*)\b", lambda m: "$" + re.sub(r"(\d+)", r"_{\1}", m[1]) + "$", t)
        return re.sub(r"\b([a-z])\^(\d+|\{[^{}]+\})", lambda m: f"${m[1]}^{m[2] if m[2][0] == '{' else '{' + m[2] + '}'}$", t)

    return outside_math(text, part)


def simple_tokens(text: str) -> list[dict]:
    """Runs of a formula without structure: letters are italic, all else upright."""
    return [{"text": t, "italic": t[0].isalpha() and t.isascii()} for t in re.findall(r"[A-Za-z]+|[^A-Za-z]+", text)]


def visual(text: str) -> str:
    """What TeX looks like in width: structure collapses to its visible characters."""
    text = re.sub(r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", lambda m: max(m.groups(), key=len), text)
    return readable(re.sub(r"[\^_]\{?([^{}]*)\}?", r"\1", text)).strip()


def shield(text: str) -> tuple[str, list[str]]:
    """Maths as numbered tokens in private characters, and the list of what stood there."""
    held: list[str] = []

    def keep(m: re.Match) -> str:
        held.append(m[0])
        return f"\ue000{len(held) - 1}\ue001"

    return DELIMITED.sub(keep, text), held


def unshield(text: str, held: list[str]) -> str:
    return re.sub("\ue000(\\d+)\ue001", lambda m: held[int(m[1])], text)


math_segments = over_text(segments, "array<struct<type:string,value:string>>")
to_omml, to_eq_field, to_rtf = over_text(omml, "string"), over_text(eq_field, "string"), over_text(lambda t: rtf_math(omml(t)), "string")
field_of_omml = over_text(field_of_omml, "string")
to_readable, to_visual, healed, bengali_out, from_unicode = (over_text(f, "string") for f in (readable, visual, heal, bengali_outside, unicode_to_latex))
math_tokens = over_text(simple_tokens, "array<struct<text:string,italic:boolean>>")
shielded = over_text(lambda t: dict(zip(("text", "held"), shield(t), strict=True)), "struct<text:string,held:array<string>>")
unshielded = over_text(lambda s: unshield(s["text"], s["held"]), "string")


def trimmed_word(word: str) -> str:
    """A word in its composed form without punctuation and symbols at its ends."""
    mark = lambda c: unicodedata.category(c)[0] in "PS"
    lo, hi = 0, len(word)
    while lo < hi and mark(word[lo]):
        lo += 1
    while hi > lo and mark(word[hi - 1]):
        hi -= 1
    return unicodedata.normalize("NFC", word[lo:hi])


normal_word = over_text(trimmed_word, "string")
