"""Nested values: questions as rows, templates and their filling, model blocks, settings, page plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def questions(papers: DataFrame, key: str, column: str = "paper") -> DataFrame:
    """Questions of parsed papers as rows with their section and place."""
    s = papers.select(key, F.posexplode(F.col(f"{column}.sections")).alias("section", "s"))
    return s.select(key, "section", F.col("s.title").alias("title"), F.posexplode("s.questions").alias("question", "q")).select(key, "section", "title", "question", "q.*")


def rewritten(sections: Column, f) -> Column:
    """Sections whose question, part and option texts have gone through a column function."""
    sub = lambda xs: F.transform(xs, lambda x: x.withField("text", f(x["text"])))
    q = lambda x: x.withField("text", f(x["text"])).withField("subQuestions", sub(x["subQuestions"])).withField("options", sub(x["options"]))
    return F.transform(sections, lambda s: s.withField("title", f(s["title"])).withField("questions", F.transform(s["questions"], q)))


def set_at(xs: Column, index: Column, field: str, value: Column) -> Column:
    """An array of structs with one field of one element replaced."""
    return F.transform(xs, lambda x, i: F.when(i == index, x.withField(field, value)).otherwise(x))


def rectangle(rows: Column) -> Column:
    """Table rows padded with empty cells to the widest."""
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def flat_blocks(docs: DataFrame, key: str, column: str = "blocks") -> DataFrame:
    """Blocks and those of their sides; idx and side_idx give the reading order (sides hold no sides)."""
    b = docs.select(key, F.posexplode(column).alias("idx", "b"))
    own = b.select(key, "idx", F.lit(0).alias("side_idx"), F.lit(None).cast("string").alias("side"), F.col("b.role").alias("role"), F.col("b.text").alias("text"))
    sides = own
    for side in ("left", "right"):
        if f"{side}" in b.select("b.*").columns:
            part = b.select(key, "idx", F.posexplode(f"b.{side}").alias("p", "x"))
            sides = sides.unionByName(part.select(key, "idx", (F.col("p") + (1 if side == "left" else 10_000)).alias("side_idx"), F.lit(side).alias("side"), F.col("x.role").alias("role"), F.col("x.text").alias("text")))
    return sides


def kept_words(blocks: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """(doc, idx, at, word): words with a letter or digit of blocks in those roles; a table's words are those of its cells."""
    body = F.when(F.col("role") == "table", F.array_join(F.transform("rows", lambda r: F.array_join(r, " ")), " ")).otherwise(F.col("text"))
    each = blocks.filter(F.col("role").isin(*roles)).select("doc", "idx", F.posexplode(F.split(F.replace(body, F.lit("**"), F.lit(" ")), r"\s+")).alias("at", "word"))
    return each.filter(F.col("word").rlike(r"[\p{L}\p{N}]"))


def plain_text(blocks: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """(doc, text): the texts of a document's blocks in those roles, in order."""
    held = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return blocks.filter(F.col("role").isin(*roles)).groupBy("doc").agg(F.array_join(F.transform(held, lambda x: x["text"]), "\n").alias("text"))


def slots(items: DataFrame) -> DataFrame:
    """Template slots from items (template, idx, kind, key, text): fixed or variable; an equal slot before makes a twin."""
    w = Window.partitionBy("template", "kind", "key", "text").orderBy("idx")
    ids = items.withColumn("slot_id", F.concat(F.lit("s"), F.col("idx").cast("string")))
    first = F.first("slot_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    fixed = F.col("kind").isin("heading", "rule") | (F.col("kind").isin("para") & F.col("key").isNull() & ~F.col("text").rlike("[_.…]{3,}|[0-9০-৯]"))
    return ids.withColumn("twin_of", F.when((F.col("text") != "") & (first != F.col("slot_id")), first)).withColumn("role", F.when(fixed, "fixed").otherwise("var"))


def filled(slots_: DataFrame, pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Slots with the texts of their parts; twins take what their first slot got; variable slots without a part are blank."""
    texts = pairs.join(parts.select("part_id", F.col("text").alias("new")), "part_id").groupBy("slot_id").agg(F.array_join(F.array_sort(F.collect_list("new")), "\n").alias("new"))
    source = slots_.withColumn("source", F.coalesce("twin_of", "slot_id"))
    out = source.join(texts.withColumnRenamed("slot_id", "source"), "source", "left")
    return out.select("template", "idx", "slot_id", "role", F.coalesce("new", F.when(F.col("role") == "fixed", F.col("text")).otherwise(F.lit(""))).alias("text"))


def filled_table(sample: Column, rows: Column, headers: int = 1) -> Column:
    """Sample rows between header and total replaced by new ones; fewer new ones leave blank rows."""
    width = F.size(F.get(sample, F.lit(0)))
    total = F.filter(F.slice(sample, -1, 1), lambda r: F.get(r, F.lit(0)).rlike("(?i)মোট|total"))
    room = F.size(sample) - headers - F.size(total)
    fit = F.transform(rows, lambda r: F.concat(F.slice(r, 1, width), F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))))
    return F.concat(F.slice(sample, 1, headers), fit, F.array_repeat(F.array_repeat(F.lit(""), width), F.greatest(room - F.size(rows), F.lit(0))), total)


def settings(raw: DataFrame, ranges: dict[str, tuple[float, float, float]], choices: dict[str, tuple[str, ...]]) -> DataFrame:
    """Numbers within their range, else the default (low, high, default); names of a list, else its first."""
    out = raw
    for c, (low, high, default) in ranges.items():
        v = F.col(c).try_cast("double")
        out = out.withColumn(c, F.when(v.between(low, high), v).otherwise(F.lit(float(default))))
    for c, names in choices.items():
        out = out.withColumn(c, F.when(F.lower(F.trim(c)).isin(*names), F.lower(F.trim(c))).otherwise(names[0]))
    return out


def _fill(heights: list[float], first: float, rest: float, gap: float) -> list[list[int]]:
    """Greedy columns: each takes items while they fit; an item that fits nowhere has a column of its own."""
    out: list[list[int]] = [[]]
    used = 0.0
    for i, h in enumerate(heights):
        room = first if len(out) == 1 else rest
        if out[-1] and used + gap + h > room:
            out.append([])
            used = 0.0
        used += h + (gap if out[-1] else 0)
        out[-1].append(i)
    return out


def best_split(heights: list[float], room_left: float, room_right: float) -> int | None:
    """Where to part items into two columns that fit, heights as equal as possible; none if none fits."""
    total, upto, best = sum(heights), 0.0, None
    for k in range(len(heights) + 1):
        if upto <= room_left and total - upto <= room_right:
            d = abs(2 * upto - total)
            if best is None or d < best[0]:
                best = (d, k)
        upto += heights[k] if k < len(heights) else 0
    return best[1] if best else None


def mcq_plan(heights: list[float], column: float, header: float = 0.0, sizes: tuple[float, ...] = (12, 11.5, 11, 10.5, 10), gap: float = 4.0) -> dict:
    """Two-column pages for item heights at the first size; a smaller size is taken only if all then fits one page."""
    def at(size: float) -> list[list[int]]:
        scaled = [h * size / sizes[0] for h in heights]
        return _fill(scaled, column - header, column, gap)

    size = next((s for s in sizes if len(at(s)) <= 2), sizes[0])
    columns = at(size)
    last = len(columns) - len(columns) % 2 if len(columns) % 2 else len(columns) - 2
    items = [i for c in columns[last:] for i in c]
    scaled = [heights[i] * size / sizes[0] for i in items]
    room = column - (header if last == 0 else 0)
    k = best_split(scaled, room, column if last else room) if items else None
    if k is not None:
        columns = [*columns[:last], items[:k], items[k:]]
    return {"size": size, "pages": (len(columns) + 1) // 2, "columns": columns}


def booklet_plan(heights: list[float], column: float, header: float = 0.0, cover: float | None = None, gap: float = 4.0) -> dict:
    """One-column booklet pages; a last column that fits the back cover moves there if four or more columns are used."""
    columns = _fill(heights, column - header, column, gap)
    back: list[int] = []
    if cover is not None and len(columns) >= 4 and sum(heights[i] for i in columns[-1]) + gap * (len(columns[-1]) - 1) <= cover:
        back = columns.pop()
    return {"columns": columns, "back": back, "sheets": -(-len(columns) // 4)}


def plans(items: DataFrame, column: float, header: float = 0.0, kind: str = "mcq") -> DataFrame:
    """(doc, item, column, size) for items (doc, item, height) of each document."""
    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("item")
        p = mcq_plan(df["height"].tolist(), column, header) if kind == "mcq" else booklet_plan(df["height"].tolist(), column, header)
        ids = df["item"].tolist()
        rows = [(df["doc"].iloc[0], ids[i], k, float(p.get("size", 12))) for k, c in enumerate(p["columns"]) for i in c]
        return pd.DataFrame(rows, columns=["doc", "item", "column", "size"])

    return items.groupBy("doc").applyInPandas(one, "doc long, item long, column int, size double")
