"""Text scalars as column expressions: cleaning, frontmatter, labels, digits and predicates for Bangla papers.

All of them run inside the JVM. Patterns that must equal those of the document formats are stated as text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.calc import to_ascii_digits

# Fixed values of the formats: scripts, labels, grade words, tag shapes.
BENGALI = r"[\x{0980}-\x{09FF}\x{0964}\x{0965}]"
LETTERS = "কখগঘ"
GRADES = {"প্রথম": 1, "দ্বিতীয়": 2, "তৃতীয়": 3, "চতুর্থ": 4, "পঞ্চম": 5, "ষষ্ঠ": 6, "সপ্তম": 7, "অষ্টম": 8, "নবম": 9, "দশম": 10, "একাদশ": 11, "দ্বাদশ": 12, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
FRONT = r"(?s)\A\s*---[^\S\n]*\n(.*?)\n---[^\S\n]*(?:\n|\z)"
FIGURE = r"\[\[FIG:p=(\d+);box=([0-9.,\s]+)\]\]"


def has_bengali(x: Column) -> Column:
    return F.coalesce(x.rlike(BENGALI), F.lit(False))


def compose_nukta(x: Column) -> Column:
    """The three letters with a separate nukta as single characters."""
    for base, whole in (("\u09af", "\u09df"), ("\u09a1", "\u09dc"), ("\u09a2", "\u09dd")):
        x = F.replace(x, F.lit(base + "\u09bc"), F.lit(whole))
    return x


def drop_lone_signs(x: Column) -> Column:
    """Vowel signs without a letter before them."""
    return F.regexp_replace(x, r"(^|[\s(\[{])[\x{09BE}-\x{09CC}\x{09D7}]+", "$1")


def digits(x: Column, to: str = "bangla") -> Column:
    """Digits of one script as those of the other; "keep" changes nothing."""
    from docloom.functions.calc import to_bengali_digits

    return to_bengali_digits(x) if to == "bangla" else to_ascii_digits(x) if to == "english" else x


def strip_artifacts(x: Column) -> Column:
    """Page markers and manifests go; three line feeds or more become two; ends are trimmed."""
    x = F.regexp_replace(x, r"(?im)^[^\S\n]*(?:---|\[)\s*(?:page|পৃষ্ঠা)\s*[-:]?\s*[0-9০-৯]+\s*(?:---|\])[^\S\n]*$", "")
    x = F.regexp_replace(x, r"(?is)<!--\s*MANIFEST.*?-->", "")
    x = F.regexp_replace(x, r"(?im)^[^\S\n]*\[?MANIFEST\b.*$", "")
    return F.btrim(F.regexp_replace(x, r"\n{3,}", "\n\n"), F.lit(" \t\n\r"))


def front(x: Column) -> Column:
    """(fields, body) of a text with a leading frontmatter block; without one, no fields and the whole text."""
    block = F.regexp_extract(x, FRONT, 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda line: line.rlike(r"^\s*[^:\s#][^:]*:"))
    entries = F.transform(pairs, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(p, r"^[^:]*:", "")), r"^[\"']|[\"']$", "").alias("value")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    fields = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))
    return F.struct(F.when(x.rlike(FRONT), fields).otherwise(F.create_map().cast("map<string,string>")).alias("fields"), F.when(x.rlike(FRONT), F.regexp_replace(x, FRONT, "")).otherwise(x).alias("body"))


def upsert_front(x: Column, changes: dict[str, str]) -> Column:
    """A text whose frontmatter has the given keys; other keys keep their order."""
    f = front(x)
    new = F.create_map(*(F.lit(v) for kv in changes.items() for v in kv))
    kept = F.map_filter(f["fields"], lambda k, _: ~k.isin(*changes))
    lines = F.transform(F.map_entries(F.map_concat(kept, new)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), f["body"])


def strip_stray_front(x: Column) -> Column:
    """Metadata blocks in the middle of a text."""
    return F.regexp_replace(x, r"(?m)\n---[^\S\n]*\n(?:[A-Za-z_]+[^\S\n]*:[^\n]*\n)+---[^\S\n]*(?=\n|\z)", "")


def sections(x: Column) -> Column:
    """"cq:3, mcq=10; cq x 2" as a map of counts in which repeated kinds add up."""
    plain = to_ascii_digits(F.regexp_replace(x, r"[\[\]\"']", ""))
    parts = F.filter(F.split(plain, "[,;]"), lambda p: p.rlike(r"(?i)^\s*[a-z_]+\s*[:=x×]\s*\d+"))
    kind = lambda p: F.lower(F.regexp_extract(p, r"(?i)^\s*([a-z_]+?)\s*[:=x×]\s*\d+", 1))
    count = lambda p: F.regexp_extract(p, r"(?i)[:=x×]\s*(\d+)", 1).cast("int")
    kinds = F.array_distinct(F.transform(parts, kind))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.aggregate(F.filter(parts, lambda p: kind(p) == k), F.lit(0), lambda a, p: a + count(p))))


def grade(x: Column) -> Column:
    """Class 1..12 from digits of either script or a grade word; 0 if there is none."""
    plain = to_ascii_digits(compose_nukta(F.lower(F.trim(F.coalesce(x, F.lit(""))))))
    number = F.regexp_extract(plain, r"\d{1,2}", 0)
    n = number.try_cast("int")
    word = F.lit(0)
    for w, g in reversed(GRADES.items()):
        word = F.when(plain.contains(w), g).otherwise(word)
    return F.when(number != "", F.when(n.between(1, 12), n).otherwise(0)).otherwise(word)


def paper_language(x: Column) -> Column:
    """en if there are more than three Latin letters for each Bengali one."""
    latin = F.length(F.regexp_replace(x, "[^A-Za-z]", ""))
    bengali = F.length(F.regexp_replace(x, r"[^\x{0980}-\x{09FF}]", ""))
    return F.when(latin > 3 * bengali, "en").otherwise("bn")


def split_mark(x: Column) -> Column:
    """(text, mark): a trailing mark in either script, bare or in brackets; no mark if there is none."""
    pattern = r"^(.*\S)\s+[\[(]?([0-9০-৯]{1,2})[\])]?\s*$"
    found = x.rlike(pattern)
    return F.struct(F.when(found, F.regexp_extract(x, pattern, 1)).otherwise(F.trim(x)).alias("text"), F.when(found, F.regexp_extract(x, pattern, 2)).otherwise("").alias("mark"))


def roman(x: Column) -> Column:
    """Statement labels that recognition has read as l, 1 or | back as i, ii and iii."""
    x = F.regexp_replace(x, r"(?m)^(\s*)[l1|]{3}[.)](\s)", "$1iii.$2")
    x = F.regexp_replace(x, r"(?m)^(\s*)[l1|]{2}[.)](\s)", "$1ii.$2")
    return F.regexp_replace(x, r"(?m)^(\s*)[l|][.)](\s)", "$1i.$2")


def time_and_marks(x: Column) -> Column:
    """(time, marks) of a line such as "সময়: ২ ঘণ্টা  পূর্ণমান: ১০০"."""
    y = compose_nukta(x)
    return F.struct(F.trim(F.regexp_extract(y, r"সময়\s*[ঃ:\-–]\s*(.*?)\s*(?:পূর্ণমান|মান|$)", 1)).alias("time"), F.regexp_extract(y, r"(?:পূর্ণমান|মান)\s*[ঃ:\-–]\s*([0-9০-৯]+)", 1).alias("marks"))


def difficulty_free(x: Column) -> Column:
    """Bracketed difficulty labels go, with the spaces they leave."""
    x = F.regexp_replace(x, r"(?i)\s*[\[(]\s*(?:সহজ|মাঝারি|মধ্যম|কঠিন|easy|medium|hard)\s*[\])]", "")
    return F.btrim(F.regexp_replace(x, r"[^\S\n]{2,}", " "))


def number_prefix(x: Column) -> Column:
    """"১)", "(১)" or "১।" in front of a question as "১. "."""
    return F.regexp_replace(x, r"^(\s*)\(?([0-9০-৯]{1,3})\s*[.)।]\s*", "$1$2. ")


def sub_prefix(x: Column) -> Column:
    """"(ক)" or "ক)" in front of a part as "ক. "."""
    return F.regexp_replace(x, r"^(\s*)\(?([কখগঘ])\s*[.)।]\s*", "$1$2. ")


def option_tabs(x: Column) -> Column:
    """Option labels after the first one on a line are set behind tabs."""
    return F.regexp_replace(sub_prefix(x), r"\s+\(?([খগঘ])[.)]\s*", "\t$1. ")


def is_english_question(x: Column) -> Column:
    return ~has_bengali(x) & x.rlike(r"[A-Za-z]{2,}") & x.rlike(r"^\s*(?:\(?[0-9]{1,3}|\(?[a-dA-D])\s*[.)]")


def question_paper(x: Column) -> Column:
    """All lines with their number, part and option labels in one form; English questions stay as they are."""
    fixed = lambda line: F.when(is_english_question(line), line).when(line.rlike(r"^\s*\(?[কখগঘ]\s*[.)।]"), option_tabs(line)).otherwise(number_prefix(line))
    return F.array_join(F.transform(F.split(x, "\n", -1), fixed), "\n")


def arrows(x: Column) -> Column:
    """Arrow macros of chemistry as characters."""
    for macro, sign in (("\\longrightarrow", "⟶"), ("\\rightleftharpoons", "⇌"), ("\\leftrightarrow", "↔"), ("\\rightarrow", "→"), ("\\leftarrow", "←"), ("\\Rightarrow", "⇒"), ("\\to", "→")):
        x = F.regexp_replace(x, "\\" + macro + "(?![A-Za-z])", sign)
    return x


def degrees(x: Column) -> Column:
    return F.regexp_replace(x, r"\^\{?\s*(?:\\circ|°|o)\s*\}?", "°")


#: LaTeX names with one character.
SYMBOLS = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ", "phi": "φ", "omega": "ω", "Delta": "Δ", "Sigma": "Σ", "Omega": "Ω", "times": "×", "div": "÷", "pm": "±", "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "ne": "≠", "neq": "≠", "approx": "≈", "infty": "∞", "angle": "∠", "triangle": "△", "perp": "⊥", "parallel": "∥", "therefore": "∴", "because": "∵", "in": "∈", "cup": "∪", "cap": "∩", "subset": "⊂", "cdot": "·", "degree": "°"}


def latex_symbols(x: Column) -> Column:
    """LaTeX names as characters, longest names first."""
    for name in sorted(SYMBOLS, key=len, reverse=True):
        x = F.regexp_replace(x, r"\\" + name + "(?![A-Za-z])", SYMBOLS[name])
    return x


def latex_aliases(x: Column) -> Column:
    """dfrac, tfrac and the like under their plain names; sizing macros go."""
    x = F.regexp_replace(x, r"\\[dtc]frac(?![A-Za-z])", r"\\frac")
    x = F.regexp_replace(x, r"\\(?:left|right|big|Big|bigg|Bigg)(?=[\[\](){}|.\\])", "")
    return F.regexp_replace(x, r"\\(?:displaystyle|textstyle|limits)(?![A-Za-z])\s*", "")


def needs_structure(x: Column) -> Column:
    """Whether a formula has a fraction, root, sum, matrix or nested script."""
    return x.rlike(r"\\(?:frac|sqrt|sum|int|prod|lim|begin|overline|vec|binom)(?![A-Za-z])|[\^_]\{[^}]{2,}\}")


def figures(x: Column) -> Column:
    """[[FIG:p=..;box=..]] tags as (page, box); boxes that aren't four growing numbers of 0..1000 are dropped."""
    tags = F.regexp_extract_all(x, F.lit(FIGURE), F.lit(0))
    parsed = F.transform(tags, lambda t: F.struct(F.regexp_extract(t, FIGURE, 1).cast("int").alias("page"), F.transform(F.split(F.regexp_extract(t, FIGURE, 2), r"\s*,\s*"), lambda v: v.try_cast("double")).alias("box")))
    good = lambda f: (F.size(f["box"]) == 4) & F.forall(f["box"], lambda v: v.isNotNull() & v.between(0, 1000)) & (F.get(f["box"], F.lit(0)) < F.get(f["box"], F.lit(2))) & (F.get(f["box"], F.lit(1)) < F.get(f["box"], F.lit(3)))
    return F.filter(parsed, lambda f: F.coalesce(good(f), F.lit(False)))


ROLE = r"<!--\s*role:([a-z_]+)(?:\s+key=([^\s>]+))?\s*-->"


def roles(x: Column) -> Column:
    tags = F.regexp_extract_all(x, F.lit(ROLE), F.lit(0))
    return F.transform(tags, lambda t: F.struct(F.regexp_extract(t, ROLE, 1).alias("role"), F.nullif(F.regexp_extract(t, ROLE, 2), F.lit("")).alias("key")))


def without_roles(x: Column) -> Column:
    return F.regexp_replace(x, ROLE, "")


def label_value(x: Column) -> Column:
    """"label: value" with a label of at most 40 characters; nulls if it isn't one."""
    pattern = r"^\s*(?:[-*]\s*)?\**([^:ঃ|]{1,40}?)\**\s*[:ঃ]\**\s*(.*?)\s*$"
    ok = x.rlike(pattern)
    return F.struct(F.when(ok, F.regexp_extract(x, pattern, 1)).alias("label"), F.when(ok, F.regexp_extract(x, pattern, 2)).alias("value"))


def leader_fields(x: Column) -> Column:
    """"নাম ........ পিতা ......" as (label, width in leader characters)."""
    field = r"([^.…_:ঃ]+?)\s*[:ঃ]?\s*([.…_]{3,})"
    return F.transform(F.regexp_extract_all(x, F.lit(field), F.lit(0)), lambda m: F.struct(F.trim(F.regexp_extract(m, field, 1)).alias("label"), F.length(F.regexp_extract(m, field, 2)).alias("width")))


def checkboxes(x: Column) -> Column:
    item = r"([☐☑☒□■])\s*([^☐☑☒□■]+)"
    return F.transform(F.regexp_extract_all(x, F.lit(item), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, item, 1).isin("☑", "☒", "■").alias("checked"), F.trim(F.regexp_extract(m, item, 2)).alias("label")))


def cells(x: Column) -> Column:
    """Cells of a pipe row; pipes inside $…$ don't separate."""
    inner = F.regexp_replace(F.trim(x), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|(?=(?:[^$]*\$[^$]*\$)*[^$]*$)", -1), lambda c: F.trim(c))


def tables(x: Column) -> Column:
    """Shapes (rows, cols) of the pipe tables of a text; separator rows don't count."""
    lines = F.split(x, "\n", -1)
    start = F.struct(F.array().cast("array<struct<rows:int,cols:int>>").alias("done"), F.lit(0).alias("r"), F.lit(0).alias("c"))

    def close(a: Column) -> Column:
        return F.when(a["r"] > 0, F.concat(a["done"], F.array(F.struct(a["r"].alias("rows"), a["c"].alias("cols"))))).otherwise(a["done"])

    def step(a: Column, line: Column) -> Column:
        row = line.rlike(r"^\s*\|.*\|\s*$")
        rule = line.rlike(r"^\s*\|[\s:|-]+\|\s*$")
        return F.when(rule, a).when(row, F.struct(a["done"].alias("done"), (a["r"] + 1).alias("r"), F.greatest(a["c"], F.size(cells(line))).alias("c"))).otherwise(F.struct(close(a).alias("done"), F.lit(0).alias("r"), F.lit(0).alias("c")))

    return F.aggregate(lines, start, step, close)


def total_line(x: Column) -> Column:
    pattern = r"^\s*\**(সর্বমোট|মোট|Total|TOTAL|Grand Total)[^0-9০-৯]*([0-9০-৯][0-9০-৯,]*(?:\.[0-9০-৯]+)?)"
    return F.struct(F.regexp_extract(x, pattern, 1).alias("label"), F.regexp_extract(x, pattern, 2).alias("value"))


def audit_note(x: Column) -> Column:
    """(body, note): a trailing note block, from its last heading on."""
    pattern = r"(?s)\A(.*?)\n\s*((?:\*\*|#+\s*)?(?:নোট|মন্তব্য|Audit note|Note)\s*[:ঃ](?:(?!\n\s*(?:\*\*|#+\s*)?(?:নোট|মন্তব্য|Audit note|Note)\s*[:ঃ]).)*)\z"
    found = x.rlike(pattern)
    return F.struct(F.when(found, F.regexp_extract(x, pattern, 1)).otherwise(x).alias("body"), F.when(found, F.trim(F.regexp_extract(x, pattern, 2))).otherwise("").alias("note"))


def nested_paper(x: Column) -> Column:
    """Whether a body has two bracketed numbers or two letters beyond the fourth at the start of lines."""
    lines = F.split(x, "\n", -1)
    return (F.size(F.filter(lines, lambda a: a.rlike(r"^\s*\([0-9০-৯]{1,2}\)"))) >= 2) | (F.size(F.filter(lines, lambda a: a.rlike(r"^\s*\(?[ঙচছজঝঞ]\s*[.)।]"))) >= 2)


def page_range(x: Column, total: Column) -> Column:
    """"1-3,৫" as sorted distinct pages within 1..total."""
    parts = F.filter(F.split(F.regexp_replace(to_ascii_digits(F.translate(x, "–—", "--")), r"\s", ""), ","), lambda p: p.rlike(r"^\d{1,6}(?:-\d{1,6})?$"))
    ends = lambda p: (F.substring_index(p, "-", 1).cast("int"), F.substring_index(p, "-", -1).cast("int"))
    clipped = lambda p: F.when(F.greatest(F.least(*ends(p)), F.lit(1)) <= F.least(F.greatest(*ends(p)), total), F.sequence(F.greatest(F.least(*ends(p)), F.lit(1)), F.least(F.greatest(*ends(p)), total))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, clipped))))


def text_width(x: Column, size: Column, widths: dict[str, float], other: float = 0.55) -> Column:
    """Width in points: the sum of class widths of characters times the size."""
    total, left = F.lit(0.0), x
    for cls, w in widths.items():
        n = F.length(left) - F.length(F.regexp_replace(left, cls, ""))
        total, left = total + n * w, F.regexp_replace(left, cls, "")
    return (total + F.length(left) * other) * size


def wrapped_lines(x: Column, size: Column, width: Column, widths: dict[str, float]) -> Column:
    """Lines that greedy wrapping by words takes."""
    zero = F.struct(F.lit(1).alias("n"), F.lit(0.0).alias("w"))
    space = size * 0.25

    def step(a: Column, word: Column) -> Column:
        w = text_width(word, size, widths)
        fits = (a["w"] == 0) | (a["w"] + space + w <= width)
        return F.struct(F.when(fits, a["n"]).otherwise(a["n"] + 1).alias("n"), F.when(fits & (a["w"] > 0), a["w"] + space + w).otherwise(w).alias("w"))

    return F.aggregate(F.filter(F.split(x, r"\s+"), lambda w: w != ""), zero, step, lambda a: a["n"])


def options_grid(widths: Column, column: Column, gap: float = 6.0) -> Column:
    """The first of 4, 2 and 1 columns in which the widest option fits its slot."""
    widest = F.array_max(widths)
    return F.coalesce(F.get(F.filter(F.array(*(F.lit(n) for n in (4, 2, 1))), lambda n: widest <= column / n - gap), F.lit(0)), F.lit(1))


def is_legacy(x: Column, font: Column) -> Column:
    """Legacy glyph text: a legacy font, else no Bengali letters but glyph characters of that encoding."""
    glyphs = F.length(F.regexp_replace(x, r"[^\x{00A1}-\x{00FF}\x{0192}\x{02C6}\x{2013}-\x{2026}\x{2030}\x{2039}\x{203A}\x{2122}†‡]", ""))
    return F.when(F.coalesce(font, F.lit("")).rlike(r"(?i)sutonny|bijoy|MJ$"), True).when(has_bengali(x), False).otherwise(glyphs >= 2)


def is_english(x: Column, font: Column) -> Column:
    """Plain English: a Latin font or ASCII words without legacy glyphs."""
    return F.when(has_bengali(x), False).when(F.coalesce(font, F.lit("")).rlike(r"(?i)times|arial|calibri|cambria"), True).otherwise(x.rlike(r"^[\x00-\x7F]*$") & x.rlike(r"\b[A-Za-z]{2,}\b"))


def plain_markdown(x: Column) -> Column:
    """Markdown without its marks."""
    for pattern, to in ((r"(?m)^#{1,6}\s+", ""), (r"\*\*(.+?)\*\*", "$1"), (r"(?<!\*)\*([^*\n]+)\*(?!\*)", "$1"), (r"(?m)^\s*[-*]\s+", "• "), (r"(?m)^\s*\|[\s:|-]+\|\s*$\n?", ""), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, to)
    return F.btrim(x, F.lit(" \t\n\r"))


def words(x: Column) -> Column:
    """Comparable words: marks and symbols at their ends trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(x, r"\s+"), lambda w: F.regexp_replace(w, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")), lambda w: w != "")


def bengali_style(numbers: Column, texts: Column, fallback: bool = True) -> Column:
    """Whether a section is numbered in Bengali: as most of its digits are; without digits unless Latin letters are more than ten and twice the Bengali ones."""
    count = lambda xs, p: F.length(F.regexp_replace(F.array_join(xs, ""), f"[^{p}]", ""))
    bn, en = count(numbers, "০-৯"), count(numbers, "0-9")
    letters, latin = count(texts, "\\x{0980}-\\x{09FF}"), count(texts, "A-Za-z")
    return F.when(bn + en > 0, bn >= en).when((latin > 2 * letters) & (latin > 10), False).otherwise(fallback)


#: The names that a frontmatter gives the fields of a header, the first one that is there counts.
HEADER_FIELDS = {"institute": ("institute", "institution", "school"), "location": ("address", "location"), "exam": ("exam", "exam_name"), "time": ("time", "duration"), "marks": ("fullmarks", "full_marks", "marks", "total_marks")}


def paper_header(fields: Column) -> Column:
    """The header of a paper from its frontmatter; class and subject in one line, in the language of both."""
    first = lambda *names: F.coalesce(*(F.nullif(F.try_element_at(fields, F.lit(n)), F.lit("")) for n in names), F.lit(""))
    grade, subject = first("grade", "class"), first("subject")
    both = F.concat(grade, subject)
    english = both.rlike("^[\\x00-\\x7F]*$") & both.rlike("[A-Za-z]")
    named = lambda en, bn, value: F.when(value != "", F.concat(F.when(english, en).otherwise(bn), value))
    line = F.concat_ws("  |  ", named("Class: ", "শ্রেণি: ", grade), named("Subject: ", "বিষয়: ", subject))
    made = {name: first(*aliases) for name, aliases in HEADER_FIELDS.items()}
    return F.struct(*(made[n].alias(n) for n in ("institute", "location", "exam")), line.alias("classAndSubject"), *(made[n].alias(n) for n in ("time", "marks")))
