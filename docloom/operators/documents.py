"""Document-level operators: page lists, layout predicates, checks against the source, envelopes and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text


#: Places of a queue in a run.
QUEUE_RUN = 10_000


def page_sources(queue: DataFrame) -> DataFrame:
    """A queue of files (pos, file, pages) as one row per page, numbered through."""
    # files in runs of neighbours: sums by run are few, and only rows of one run are ordered together
    runs = queue.select("pos", "file", "pages", F.floor(F.col("pos") / QUEUE_RUN).alias("run"))
    sums = runs.groupBy("run").agg(F.sum("pages").alias("n"))
    starts = sums.withColumn("begins", F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    within = F.sum("pages").over(Window.partitionBy("run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("pages")
    placed = runs.withColumn("within", within).join(starts.select("run", "begins"), "run")
    each = placed.select("file", (F.col("begins") + F.col("within")).alias("before"), F.explode(F.when(F.col("pages") > 0, F.sequence(F.lit(1), F.col("pages")))).alias("page_in_file"))
    return each.select((F.col("before") + F.col("page_in_file")).cast("long").alias("page"), "file", "page_in_file")


def columns_of(blocks: DataFrame) -> DataFrame:
    """2 for pages with six or more narrow body blocks, three a side, that outnumber the wide ones; else 1."""
    x0, x1 = F.get("box", F.lit(1)), F.get("box", F.lit(3))
    body = F.col("role").isin("paragraph", "question", "list")
    left, right = body & (x1 <= 560), body & (x0 >= 440)
    counted = blocks.groupBy("doc", "page").agg(F.count_if(left).alias("l"), F.count_if(right & ~left).alias("r"), F.count_if(body & ~left & ~right).alias("w"))
    two = (F.col("l") + F.col("r") >= 6) & (F.least("l", "r") >= 3) & (F.col("l") + F.col("r") > 2 * F.col("w"))
    return counted.select("doc", "page", F.when(two, 2).otherwise(1).alias("columns"))


# Fixed values of captures: roles by block type, those that may stand side by side, and what a rule looks like.
CAPTURE_ROLES = {"title": "title", "heading": "heading", "paragraph": "paragraph", "list_item": "list", "label_value": "label_value", "table": "table", "question": "question", "option_row": "option_row", "signature": "signature", "stamp": "stamp", "footer": "footer", "figure": "figure", "header": "header", "page_number": "page_number", "other": "other", "note": "note", "marginal_note": "note"}
SIDE_ROLES = ("paragraph", "signature", "label_value", "heading", "list")
CAPTURED_RULE = r"^\s*⟦[─\-—_=]×\d+⟧\s*$"


def model_of_capture(blocks: DataFrame) -> DataFrame:
    """Capture blocks (doc, page, idx, type, fs, box, text) as model blocks: (doc, page, idx, role, level, rows, pair, side).

    A table has its pipe rows, without separators; one without rows goes. Text blocks that follow one another and stand beside
    each other in at least half of their height are the two sides of a pair, named by the first one.
    """
    from docloom.functions.calc import y_overlap

    roles = F.create_map(*(F.lit(x) for kv in CAPTURE_ROLES.items() for x in kv))
    role = F.coalesce(F.try_element_at(roles, "type"), F.lit("paragraph"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    cells = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), text.cells)
    rows = F.filter(cells, lambda r: ~F.forall(r, lambda c: c.rlike("^:?-{2,}:?$") | (c == "")) | (F.size(F.filter(r, lambda c: c != "")) == 0))
    b = blocks.withColumn("role", F.when((role == "other") & (F.size(lines) == 1) & F.col("text").rlike(CAPTURED_RULE), "rule").otherwise(role))
    b = b.withColumn("rows", F.when(F.col("role") == "table", rows)).filter("role <> 'table' OR size(rows) > 0")
    b = b.withColumn("level", F.when(F.col("role") == "heading", F.when(F.col("fs").isin("xl", "l"), 1).otherwise(2)))
    w = Window.partitionBy("doc", "page").orderBy("idx")
    at = lambda box, i: F.get(box, F.lit(i))
    after, own = F.lead("box").over(w), F.col("box")
    narrow = lambda box: at(box, 3) - at(box, 1) < 700
    beside = F.col("role").isin(*SIDE_ROLES) & F.lead("role").over(w).isin(*SIDE_ROLES) & (at(own, 3) <= at(after, 1)) & narrow(own) & narrow(after) & (y_overlap(at(own, 0), at(own, 2), at(after, 0), at(after, 2)) >= 0.5)
    b = b.withColumn("beside", F.coalesce(beside, F.lit(False)))
    # in a row of blocks that could all pair with the next one, every second one does
    run = F.sum((~F.col("beside")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("run", F.coalesce(run, F.lit(0)))
    k = F.row_number().over(Window.partitionBy("doc", "page", "run").orderBy("idx"))
    b = b.withColumn("left", F.col("beside") & (k % 2 == 1))
    b = b.withColumn("pair", F.when(F.col("left"), F.col("idx")).when(F.lag("left").over(w), F.lag("idx").over(w)))
    return b.select("doc", "page", "idx", "role", "level", "rows", "pair", F.when(F.col("left"), "left").when(F.col("pair").isNotNull(), "right").alias("side"))


def cut_line(x: Column, role: Column) -> Column:
    """A rule to cut along: scissors or a row of dashes, alone on its line."""
    return role.isin("rule", "cut_line") | x.rlike(r"^\s*(?:[✂✁]\s*)?[-–—_.·•\s]{10,}(?:\s*[✂✁])?\s*$") | x.rlike("^\\s*[✂✁]")


def photo_box(box: Column, x: Column) -> Column:
    """A box of 80..260 by 80..300 in the right half whose text names a photo or is blank."""
    h, w = F.get(box, F.lit(2)) - F.get(box, F.lit(0)), F.get(box, F.lit(3)) - F.get(box, F.lit(1))
    return F.coalesce(w.between(80, 260) & h.between(80, 300) & (F.get(box, F.lit(1)) >= 500) & x.rlike("(?i)^\\s*$|ছবি|photo|পাসপোর্ট"), F.lit(False))


def photo_rows(blocks: DataFrame, share: float = 0.3) -> DataFrame:
    """Left blocks (doc, page, idx, box, text) beside a photo box: (doc, page, photo, idx); of two photos the larger has a block."""
    b = blocks.withColumn("y0", F.get("box", F.lit(0))).withColumn("y1", F.get("box", F.lit(2))).withColumn("x1", F.get("box", F.lit(3))).withColumn("photo", photo_box(F.col("box"), F.col("text")))
    from docloom.functions.calc import y_overlap

    p = b.filter("photo").select("doc", "page", F.col("idx").alias("photo_idx"), F.col("y0").alias("p0"), F.col("y1").alias("p1"), F.get("box", F.lit(1)).alias("px"))
    both = b.filter("NOT photo").join(p, ["doc", "page"]).filter((F.col("x1") <= F.col("px")) & (y_overlap(F.col("y0"), F.col("y1"), F.col("p0"), F.col("p1")) >= share))
    first = F.row_number().over(Window.partitionBy("doc", "page", "idx").orderBy(F.desc(F.col("p1") - F.col("p0")), "photo_idx"))
    return both.withColumn("k", first).filter("k = 1").select("doc", "page", F.col("photo_idx").alias("photo"), "idx")


def mismatches(claimed: DataFrame, measured: DataFrame, keys: list[str], more_only: bool = False) -> DataFrame:
    """Blocks whose claimed number of lines (or rows) is not the measured one; with ``more_only``, is less."""
    both = claimed.select(*keys, F.col("n").alias("claimed")).join(measured.select(*keys, F.col("n").alias("measured")), keys)
    return both.filter(F.col("measured") > F.col("claimed") if more_only else F.col("measured") != F.col("claimed"))


def missing_words(source: DataFrame, output: DataFrame, key: str) -> DataFrame:
    """(key, word, missing): words of the source text that the output has fewer times."""
    count = lambda d, n: d.select(key, F.explode(text.words(F.col("text"))).alias("word")).groupBy(key, "word").agg(F.count("*").alias(n))
    both = count(source, "a").join(count(output, "b"), [key, "word"], "left")
    return both.select(key, "word", (F.col("a") - F.coalesce("b", F.lit(0))).alias("missing")).filter("missing > 0")


def checks(pairs: DataFrame) -> DataFrame:
    """(id, check, ok) for a source and an output text: words kept, tables of the same shapes, no placeholder, one digit script, short tables, headings kept."""
    a, b = F.col("source"), F.col("output")
    shapes = lambda x: F.transform(text.tables(x), lambda t: F.concat_ws("x", t["rows"].cast("string"), t["cols"].cast("string")))
    both = lambda x: x.rlike("[0-9]") & x.rlike("[০-৯]")
    heads = lambda x: F.filter(F.split(x, "\n"), lambda s: s.rlike(r"^#{1,6}\s"))
    rules = {
        "words": F.size(F.array_except(text.words(a), text.words(b))) <= 0,
        "tables": shapes(a) == shapes(b),
        "placeholders": ~b.rlike(r"(?i)\[\[?\s*(?:FIG|B|TODO|placeholder)|লিখুন\]|\{\{"),
        "digits": both(a) | ~both(b),
        "long_tables": F.forall(text.tables(b), lambda t: t["rows"] <= 60),
        "headings": F.size(heads(a)) == F.size(heads(b)),
    }
    return pairs.select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in rules.items()))).alias("c")).select("id", "c.*")


def structure_warnings(body: Column, needs: dict[str, str]) -> Column:
    """Names of the required patterns that a body lacks."""
    return F.filter(F.array(*(F.when(~body.rlike(p), F.lit(n)) for n, p in needs.items())), lambda x: x.isNotNull())


# Fixed values of a paper of two parts: its types, the break, and the lines that tell the parts, each with its letter.
TWO_PARTS = ("EXAM_CQ", "EXAM_MATH")
PART_BREAK = r"(?i)---\s*SECTION_?BREAK:MCQ"
PART_LINES = {
    "q": r"^\s*(?:>\s*)?(?:#{1,6}\s*)?(?:প্রশ্ন[\s\-:ঃ.]*)?[0-9০-৯]+[।.)]",
    "h": r"^(?=.{1,90}$)[#*_\s]*(?:[কখগঘ]\s*[-–—]?\s*(?:বিভাগ|অংশ)\s*[:ঃ\-–—(]?\s*)?(?:বহুনির্বাচন[িী]|নৈর্ব্যক্তিক|(?i:MCQ\b|multiple[\s-]*choice))",
    "o": r"^\s*\(?\s*[কখগঘ]\s*[.)।]\s*\S",
}
#: A question, later the first heading of choices, and eight options below it.
TWO_PART_ORDER = "^[^h]*q[^h]*h(?:[^o]*o){8}"


def promoted(doc_type: Column, x: Column, creative_blocks: Column) -> Column:
    """EXAM_COMBINED for a creative or maths paper with a break, or with creative blocks and a multiple-choice part behind its questions."""
    letter = lambda line: F.coalesce(*(F.when(line.rlike(p), F.lit(k)) for k, p in PART_LINES.items()), F.lit("."))
    order = F.array_join(F.transform(F.split(x, r"\r?\n"), letter), "")
    both = x.rlike(PART_BREAK) | (order.rlike(TWO_PART_ORDER) & (creative_blocks > 0))
    return F.when(doc_type.isin(*TWO_PARTS) & both, "EXAM_COMBINED").otherwise(doc_type)


def envelope(rows: DataFrame, name: str, version: int, columns: list[str], order: str) -> DataFrame:
    """All rows as one JSON document with a format name and version; for exports of a few chosen rows."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*columns).alias("r")))), lambda s: s["r"])
    return rows.agg(F.to_json(F.struct(F.lit(name).alias("format"), F.lit(version).alias("formatVersion"), items.alias("templates"))).alias("json"))


def opened(documents: DataFrame, name: str, version: int, row_type: str, required: str) -> DataFrame:
    """Rows of such JSON documents with their place and whether each is sound; another format or a newer version gives none."""
    t = f"struct<format:string,formatVersion:int,templates:array<{row_type}>>"
    parsed = documents.select(F.from_json("json", t).alias("d")).filter((F.col("d.format") == name) & (F.col("d.formatVersion") <= version))
    each = parsed.select(F.posexplode("d.templates").alias("pos", "r"))
    return each.select("pos", "r.*", (F.coalesce(F.col(f"r.{required}").cast("string"), F.lit("")) != "").alias("sound"))


def fingerprint(parts: DataFrame, key: str) -> DataFrame:
    """SHA-1 over a package's parts (name, content) in order of their names, properties left out."""
    kept = parts.filter(~F.col("name").startswith("docProps/"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", F.sha1(F.col("content").cast("binary")).alias("h")))), lambda s: F.concat(s["name"], F.lit(":"), s["h"])), "\n")
    return kept.groupBy(key).agg(F.sha1(joined.cast("binary")).alias("fingerprint"))


def stale(now: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """What has changed since it was scored."""
    return now.join(scored, [key, "fingerprint"], "left_anti")


def transitions(log: DataFrame, new: DataFrame, keep: int) -> DataFrame:
    """A log (at, source, target) with new entries, the last ``keep`` of it."""
    every = log.unionByName(new)
    return every.orderBy(F.desc("at"), F.desc("source"), F.desc("target")).limit(keep)


def replaced(rows: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Words of a text replaced by a dictionary (word, replacement); entries with both sides only, the longest words first."""
    entries = dictionary.filter("length(trim(word)) > 0 AND length(trim(replacement)) > 0").groupBy("word").agg(F.min("replacement").alias("replacement"))
    table = entries.agg(F.array_sort(F.collect_list(F.struct((-F.length("word")).alias("k"), "word", "replacement"))).alias("dictionary"))
    joined = rows.join(F.broadcast(table))
    return joined.withColumn(column, F.aggregate("dictionary", F.col(column), lambda t, e: F.replace(t, e["word"], e["replacement"]))).drop("dictionary")


def stored(rows: DataFrame) -> DataFrame:
    """Rows under fresh keys."""
    return rows.withColumn("key", F.expr("uuid()"))


def write_status(status: DataFrame, path: str) -> None:
    """Key status as CSV files with a header and a byte order mark in front of it."""
    out = status.select(*(F.col(c).cast("string").alias(("﻿" if i == 0 else "") + c) for i, c in enumerate(status.columns)))
    out.write.option("header", True).option("quoteAll", True).mode("overwrite").csv(path)
