"""Ordered analytics: islands, carried values, retention, renumbering, chunk plans.

Every window is partitioned; orderings end in a tie-breaker that the caller names. ``spread`` says how a key's rows are met:
False keeps a key in one window (a document, a page), True deals keys of any size over pieces (``scans``), None lets the largest key decide.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import storage
from docloom.operators import medians, scans

SO_FAR = (Window.unboundedPreceding, 0)


def _ordered(keys: list[str], order: list[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def runs(df: DataFrame, keys: list[str], order: list, changed: Column, name: str = "run", spread: bool | None = False) -> DataFrame:
    """Numbers runs from 1: a row for which ``changed`` holds (nulls count as a start) begins one."""
    return scans.scan(df, keys, order, sums={name: F.coalesce(changed, F.lit(True)).cast("int")}, spread=spread)


def value_runs(df: DataFrame, keys: list[str], order: list, value: str, name: str = "run", spread: bool | None = False) -> DataFrame:
    """Runs of equal values (run-length groups)."""
    spread = scans.hot(df, keys) if spread is None else spread
    met = scans.scan(df, keys, order, lags={"one before": F.lit(1), "value before": F.col(value)}, spread=spread)
    start = F.col("one before").isNull() | ~F.col("value before").eqNullSafe(F.col(value))
    return runs(met.withColumn("run start", start).drop("one before", "value before"), keys, order, F.col("run start"), name, spread).drop("run start")


def islands(df: DataFrame, keys: list[str], at: str, gap: float, least: int = 1, spread: bool | None = False) -> DataFrame:
    """Clusters of positions no further apart than ``gap``: (keys, lo, hi, n) for those of ``least`` rows or more.

    Rows at one position are met as one, so no order among them decides; a row at no position, or at none that a distance can be taken from, is a cluster of its own.
    """
    spread = scans.hot(df, keys) if spread is None else spread
    alone = F.when(~F.coalesce(F.col(at) - F.col(at) <= gap, F.lit(False)), F.monotonically_increasing_id())
    places = df.select(*keys, at, alone.alias("alone")).groupBy(*keys, at, "alone").agg(F.count("*").alias("rows"))
    order = [F.asc_nulls_last(at)]
    met = scans.scan(places, keys, order, lags={"at before": F.col(at)}, spread=spread).withColumn("jump", F.col(at) - F.col("at before") > gap)
    numbered = runs(met, keys, order, F.col("jump"), "run", spread)
    return numbered.groupBy(*keys, "run").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.sum("rows").alias("n")).filter(F.col("n") >= least)


def bands(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive rules as (top, bottom) pairs."""
    return clusters.withColumn("bottom", F.lead("lo").over(_ordered(keys, [F.asc_nulls_last("lo")]))).filter("bottom IS NOT NULL").select(*keys, F.col("hi").alias("top"), "bottom")


def carried(df: DataFrame, keys: list[str], order: list, opens: Column, keeps: Column, value: str, name: str = "owner", spread: bool | None = False) -> DataFrame:
    """The value of the row that opened the current context; a row that neither opens nor keeps one closes it."""
    marked = df.withColumn("opens", opens).withColumn("keeps", keeps)
    heads = F.when(F.coalesce(F.col("opens") | ~F.col("keeps"), F.lit(True)), F.struct("opens", F.col(value).alias("v")))
    met = scans.scan(marked, keys, order, lasts={"head": heads}, spread=spread)
    return met.withColumn(name, F.when(~F.col("opens") & F.col("keeps") & F.col("head.opens"), F.col("head.v"))).drop("opens", "keeps", "head")


def filled(df: DataFrame, keys: list[str], order: list, value: str, spread: bool | None = False) -> DataFrame:
    """Missing values take the last one before them."""
    met = scans.scan(df, keys, order, lasts={"last value": F.col(value)}, spread=spread)
    return met.withColumn(value, F.col("last value")).drop("last value")


def column_kind(box: Column, role: Column) -> Column:
    """wide, left or right from the horizontal extent of a box [y0, x0, y1, x1]; null without a box."""
    x0, x1 = F.get(box, F.lit(1)), F.get(box, F.lit(3))
    w = x1 - x0
    wide = role.isin("side_by_side", "table") | (w >= 600) | ((x0 < 440) & (x1 > 560)) | ((x0 < 500) & (x1 > 500) & (w >= 350))
    left, right = x1 <= 560, x0 >= 440
    sides = F.when(left & right, F.when((x0 + x1) / 2 < 500, "left").otherwise("right")).when(left, "left").when(right, "right").otherwise("wide")
    return F.when(F.coalesce(wide, role.isin("side_by_side", "table")), "wide").when(box.isNull() | (F.size(box) < 4), F.lit(None)).otherwise(sides)


def eligible(box: Column, role: Column, text: Column) -> Column:
    """A block that may stand in a column: running text of 200 or more in width, without leaders."""
    marks = F.length(text) - F.length(F.regexp_replace(text, "[.\\-_–—]", ""))
    leaders = text.rlike(r"\.{5,}|-{5,}|_{5,}") | ((marks >= 10) & (marks > F.length(text) * 0.3))
    return role.isin("paragraph", "question", "list", "list_item", "option_row") & (F.get(box, F.lit(3)) - F.get(box, F.lit(1)) >= 200) & ~leaders


def column_bands(blocks: DataFrame) -> DataFrame:
    """Blocks (doc, page, idx, role, text, box) with the band they belong to and its number of columns.

    A block without a box follows the one before it. Two-column bands must have three eligible blocks and 200
    characters a side, margins where columns have them and sides of similar height, else they count as one.
    """
    keys = ["doc", "page"]
    w = _ordered(keys, ["idx"])
    kind = column_kind(F.col("box"), F.col("role"))
    df = blocks.withColumn("kind", kind)
    df = df.withColumn("y", F.coalesce(F.when(F.col("kind").isNotNull(), F.get("box", F.lit(0)).cast("double")), F.coalesce(F.last(F.when(F.col("kind").isNotNull(), F.get("box", F.lit(0)).cast("double")), ignorenulls=True).over(w), F.lit(0.0)) + 0.0001 * F.row_number().over(w)))
    df = df.withColumn("kind", F.coalesce("kind", F.last("kind", ignorenulls=True).over(w), F.lit("wide"))).withColumn("cols", F.when(F.col("kind") == "wide", 1).otherwise(2))
    df = value_runs(df, keys, ["y", "idx"], "cols", "raw")
    fit = F.coalesce(eligible(F.col("box"), F.col("role"), F.col("text")), F.lit(False))
    chars = F.length(F.regexp_replace("text", r"[\s.\-_–—]", ""))
    each = []
    for side in ("left", "right"):
        mine = lambda x, s=side: F.when(fit & (F.col("kind") == s), x)
        each += [F.count(mine(F.lit(1))).alias(f"{side}_n"), F.sum(mine(chars)).alias(f"{side}_chars"), F.min(mine(F.get("box", F.lit(1)))).alias(f"{side}_x"), (F.max(mine(F.get("box", F.lit(2)))) - F.min(mine(F.get("box", F.lit(0))))).alias(f"{side}_span")]
    facts = df.groupBy(*keys, "raw").agg(*each)
    sound = (F.least("left_n", "right_n") >= 3) & (F.least("left_chars", "right_chars") >= 200) & (F.col("left_x") <= 200) & F.col("right_x").between(440, 650) & (F.least("left_span", "right_span") >= 0.5 * F.greatest("left_span", "right_span"))
    df = df.join(facts.select(*keys, "raw", F.coalesce(sound, F.lit(False)).alias("sound")), [*keys, "raw"])
    df = df.withColumn("cols", F.when((F.col("cols") == 2) & F.col("sound"), 2).otherwise(1))
    df = df.withColumn("place", F.when(F.col("cols") == 1, 0).otherwise((F.col("kind") == "right").cast("int")))
    df = value_runs(df, keys, ["raw", "y", "idx"], "cols", "band")
    return df.withColumn("pos", F.row_number().over(_ordered(keys, ["raw", "place", "y", "idx"]))).select(*keys, "idx", "band", "cols", "kind", "pos")


def newest(df: DataFrame, keys: list[str], order: list, count: int) -> DataFrame:
    """The first ``count`` rows of each key in an order."""
    return df.withColumn("age rank", F.row_number().over(_ordered(keys, order))).filter(F.col("age rank") <= count).drop("age rank")


def retained(df: DataFrame, keys: list[str], at: str, now: Column, seconds: int, count: int, tie: str) -> DataFrame:
    """Rows at most ``seconds`` old, of these the newest ``count`` of each key."""
    fresh = df.filter(F.unix_timestamp(now) - F.unix_timestamp(at) <= seconds)
    return newest(fresh, keys, [F.desc(at), F.desc(tie)], count)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Union by name in which the latest row of each key wins."""
    return newest(old.unionByName(new, allowMissingColumns=True), keys, [F.desc(at), F.desc(tie)], 1)


def patched(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Columns of a patch replace those of its row where they are not null."""
    p = patches.select(key, *(F.col(c).alias(f"patch {c}") for c in patches.columns if c != key))
    joined = rows.join(p, key, "left")
    return joined.select(*(F.coalesce(f"patch {c}", c).alias(c) if c in patches.columns and c != key else F.col(c) for c in rows.columns))


def without_repeats(df: DataFrame, keys: list[str], order: list, kind: str, value: str, quiet: str) -> DataFrame:
    """Drops rows of kind ``quiet`` whose value equals that of the row before, if it is of that kind too."""
    w = _ordered(keys, order)
    same = (F.col(kind) == quiet) & (F.lag(kind).over(w) == quiet) & F.lag(value).over(w).eqNullSafe(F.col(value))
    return df.withColumn("repeat", F.coalesce(same, F.lit(False))).filter(~F.col("repeat")).drop("repeat")


def renumbered(df: DataFrame, keys: list[str], order: list, bengali: Column, keep: Column | None = None, number: str = "num", spread: bool | None = False) -> DataFrame:
    """Questions numbered 1..n per section in the section's digit script; kept numbers stay."""
    from docloom.functions.calc import to_bengali_digits

    n = F.col("row number")
    new = F.when(bengali, to_bengali_digits(n)).otherwise(n.cast("string"))
    counted = scans.scan(df, keys, order, sums={"row number": F.lit(1)}, spread=spread)
    return counted.withColumn(number, new if keep is None else F.when(keep, F.col(number)).otherwise(new)).drop("row number")


def continued(df: DataFrame, keys: list[str], order: str, head: str, columns: list[str], glue: str = " ", spread: bool | None = False) -> DataFrame:
    """Rows with a blank head column are joined to the row before them, column by column."""
    numbered = runs(df, keys, [order], F.coalesce(F.trim(head), F.lit("")) != "", "row", spread)
    joined = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))), lambda s: s["v"]), glue).alias(c) for c in columns]
    return numbered.groupBy(*keys, "row").agg(*joined)


def serial_merges(df: DataFrame, keys: list[str], order: str, serial: str, second: str, spread: bool | None = False) -> DataFrame:
    """restart or continue for the serial column: a serial cell followed by rows without one but with a second cell."""
    is_serial = F.coalesce(F.trim(serial), F.lit("")).rlike("^[0-9০-৯]+[.)।]?$")
    follows = (F.coalesce(F.trim(serial), F.lit("")) == "") & (F.coalesce(F.trim(second), F.lit("")) != "")
    spread = scans.hot(df, keys) if spread is None else spread
    numbered = runs(df.withColumn("is serial", is_serial), keys, [order], F.col("is serial"), "group", spread).withColumn("follows", follows)
    # of the rows that matter, a serial cell begins a merge if the next one follows; one that follows goes on with it if a serial cell came before
    met = scans.scan(numbered.filter("`is serial` OR follows"), keys, [F.desc(order)], lags={"next follows": F.col("follows")}, spread=spread)
    named = met.withColumn("vmerge", F.when(F.col("is serial") & F.col("next follows"), "restart").when(F.col("follows") & (F.col("group") > 0), "continue"))
    rest = numbered.filter("NOT (`is serial` OR follows)").withColumn("vmerge", F.lit(None).cast("string"))
    return named.drop("next follows").unionByName(rest).drop("is serial", "follows")


def leading(df: DataFrame, keys: list[str], order: list, holds: Column, spread: bool | None = False) -> DataFrame:
    """The longest prefix of each key for whose rows a condition holds."""
    failed = F.when(F.coalesce(holds, F.lit(False)), 0).otherwise(1)
    return scans.scan(df, keys, order, sums={"so far": failed}, spread=spread).filter(F.col("so far") == 0).drop("so far")


def merged_runs(df: DataFrame, keys: list[str], order: str, styles: list[str], text: str, spread: bool | None = False) -> DataFrame:
    """Neighbouring runs of the same style become one; their texts are joined in order."""
    numbered = value_runs(df.withColumn("style", F.to_json(F.struct(*styles))), keys, [order], "style", "run", spread)
    return numbered.groupBy(*keys, "run").agg(*(F.first(s).alias(s) for s in styles), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("v")))), lambda s: s["v"]), "").alias(text))


def merged_chunks(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Chunk texts in order: the first frontmatter stays, other chunks lose theirs; failed (null) chunks leave a mark."""
    w = _ordered(keys, [order])
    front = r"(?s)^\s*---[^\S\n]*\n.*?\n---[^\S\n]*(?:\n|$)"
    body = F.when(F.row_number().over(w) == 1, F.col(text)).otherwise(F.regexp_replace(text, front, ""))
    marked = df.withColumn("body", F.coalesce(body, F.concat(F.lit("[chunk "), F.col(order).cast("string"), F.lit(" failed]"))))
    return marked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("body").alias("v")))), lambda s: s["v"]), "\n\n").alias("merged"), F.count("*").alias("chunks"), F.count_if(F.col(text).isNull()).alias("failed"))


def greedy_chunks(sizes: list[int], most_items: int, most_size: int) -> list[list[int]]:
    """Sizes in order as chunks that take on items while they have room; an item that is too large is a chunk of its own."""
    out: list[list[int]] = []
    held = 0
    for n in sizes:
        if not out or len(out[-1]) >= most_items or held + n > most_size:
            out.append([])
            held = 0
        out[-1].append(n)
        held += n
    return out


def levelled_chunks(chunks: list[list[int]], most_items: int, most_size: int, least: int) -> list[list[int]]:
    """Chunks whose last one is filled up to ``least`` items from the nearest one before it that has more, and neighbours that then differ by one at most where they may."""
    fits = lambda c, n: len(c) < most_items and sum(c) + n <= most_size
    while len(chunks) > 1 and len(chunks[-1]) < least:
        donor = next((d for d in range(len(chunks) - 2, -1, -1) if len(chunks[d]) > least), None)
        # one item moves on along the chunks in between, so each of those but the last gives one too
        after = [] if donor is None else [chunks[donor][:-1], *([chunks[k - 1][-1], *chunks[k][: len(chunks[k]) - (k < len(chunks) - 1)]] for k in range(donor + 1, len(chunks)))]
        grown = zip(range(donor + 1, len(chunks)), after[1:], strict=True) if after else ()
        if not after or any(len(c) > most_items or sum(chunks[k]) + c[0] > most_size for k, c in grown):
            break
        chunks = [*chunks[:donor], *after]
    moved = True
    while moved:
        moved = False
        for a, b in zip(chunks, chunks[1:], strict=False):
            if len(a) - len(b) >= 2 and len(a) > least and fits(b, a[-1]):
                b.insert(0, a.pop())
                moved = True
    return chunks


def _by_chunks(df: DataFrame, key: str, order: str, size: str, plan) -> DataFrame:
    """(key, order, chunk from 1): a plan of each key's sizes in order. A key's rows are read by one task, two numbers each."""
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        numbers = [n for n, c in enumerate(plan(rows[size].astype(int).tolist()), 1) for _ in c]
        return pd.DataFrame({key: rows[key], order: rows[order], "chunk": numbers})

    return df.select(key, order, size).groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, chunk int")


#: Rows of a key that are folded in one task; larger keys are packed by jumps. Positions that one task then walks through, at least.
FOLD_ROWS, WALK = 100_000, 4096


def _met(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "inner") -> DataFrame:
    """Join in which nulls are equal: columns of the left by those of the right."""
    same = F.lit(True)
    for a, b in on.items():
        same = same & left[a].eqNullSafe(right[b])
    return left.join(right, same, how)


def _hops(rows: DataFrame, key: str, most_items: int, most_size: int) -> DataFrame:
    """(key, at, next): the chunk that begins at a position ends before ``next``.

    The first item too many is the first whose running sum exceeds what was there before the chunk by more than ``most_size``: limits and
    sums meet in one falling order, in which a limit stands before equal sums and of those the earliest comes last.
    """
    none = F.lit(None).cast("long")
    sums = rows.select(key, F.col("upto").alias("v"), F.col("at").alias("stop"), none.alias("at"))
    limits = rows.select(key, (F.col("upto") - F.col("size") + most_size).alias("v"), none.alias("stop"), "at")
    met = scans.scan(limits.unionByName(sums), [key], [F.desc("v"), F.desc_nulls_first("stop"), "at"], lasts={"over": F.col("stop")}, spread=True)
    at = F.col("at")
    return met.filter("at IS NOT NULL").select(key, "at", F.greatest(at + 1, F.least(at + most_items, F.coalesce("over", at + most_items))).alias("next"))


def _path(hops: DataFrame, key: str, most_items: int) -> DataFrame:
    """(key, at) of the positions that are met from 0 on.

    Positions are cut into blocks. Within one, the way out is walked back from its end for each of the few positions where a path can come
    in. Over blocks the way is found by doubling: the positions that are known to be met jump along, and every jump is put behind itself.
    """
    width = max(WALK, 4 * most_items)
    kind = dict(hops.dtypes)[key]
    hops = storage.table(hops.withColumn("block", F.floor(F.col("at") / width)), "hops")

    def exits(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        first, nexts = int(rows["at"].iloc[0]), rows["next"].tolist()
        ways = list(nexts)
        for i in range(len(nexts) - 1, -1, -1):
            if nexts[i] - first < len(nexts):
                ways[i] = ways[nexts[i] - first]
        out = rows.assign(to=ways)
        return out.loc[out["at"] - first < most_items, [key, "at", "to"]]

    def walked(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        first, nexts, at, met = int(rows["at"].iloc[0]), rows["next"].tolist(), int(rows["entry"].iloc[0]), []
        while at - first < len(nexts):
            met.append(at)
            at = nexts[at - first]
        return pd.DataFrame({key: rows[key].iloc[0], "at": met})

    known = storage.table(hops.filter("at = 0").select(key, "at"), "met")
    jumps = storage.table(hops.groupBy(key, "block").applyInPandas(exits, f"`{key}` {kind}, at long, to long"), "jumps")
    blocks = (hops.agg(F.max("block")).first()[0] or 0) + 1
    for _ in range((blocks - 1).bit_length()):
        ahead = _met(known, jumps.select(F.col(key).alias("of"), F.col("at").alias("from"), "to"), {key: "of", "at": "from"}).select(key, F.col("to").alias("at"))
        further = _met(jumps, jumps.select(F.col(key).alias("of"), F.col("at").alias("from"), F.col("to").alias("beyond")), {key: "of", "to": "from"}).select(key, "at", F.col("beyond").alias("to"))
        before = (known, jumps)
        known, jumps = storage.table(known.unionByName(ahead).distinct(), "met"), storage.table(further, "jumps")
        storage.drop(*before)
    # the last way out may end behind the last position and yet in its block
    entries = known.groupBy(F.col(key).alias("of"), F.floor(F.col("at") / width).alias("in")).agg(F.min("at").alias("entry"))
    return _met(hops, entries, {key: "of", "block": "in"}).drop("of", "in").groupBy(key, "block").applyInPandas(walked, f"`{key}` {kind}, at long")


def packed(df: DataFrame, key: str, order: str, size: str, most_items: int, most_size: int) -> DataFrame:
    """Greedy chunks of each key in order, at most so many items and so large: (key, order value, chunk from 1). A null size counts as 0.

    Keys of more than ``FOLD_ROWS`` rows are packed by jumps: no task holds a key, whatever its size.
    """
    df = df.select(key, order, F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("size"))
    if not scans.hot(df, [key], FOLD_ROWS):
        return _by_chunks(df, key, order, "size", lambda sizes: greedy_chunks(sizes, most_items, most_size))
    rows = storage.table(scans.scan(df, [key], [order, "size"], sums={"upto": F.col("size"), "number": F.lit(1)}, spread=True).withColumn("at", F.col("number") - 1), "positions")
    starts = _path(_hops(rows, key, most_items, most_size), key, most_items).select(F.col(key).alias("of"), F.col("at").alias("start"))
    marked = _met(rows, starts, {key: "of", "at": "start"}, "left")
    return scans.scan(marked, [key], ["at"], sums={"chunk": F.when(F.col("start").isNotNull(), 1).otherwise(0)}, spread=True).select(key, order, F.col("chunk").cast("int").alias("chunk"))


def planned_chunks(df: DataFrame, key: str, order: str, size: str, most_items: int, most_size: int, least: int) -> DataFrame:
    """``packed`` with chunks levelled; a key of ``most_items`` rows or fewer is one chunk whatever its size."""
    return _by_chunks(df, key, order, size, lambda sizes: [sizes] if len(sizes) <= most_items else levelled_chunks(greedy_chunks(sizes, most_items, most_size), most_items, most_size, least))


def listed(df: DataFrame, order: list, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their ``place`` in an order, within keys; without keys for lists that fit one task, such as a user's projects."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def changed(df: DataFrame, before: str, after: str, order: list, count: int) -> DataFrame:
    """The first ``count`` rows in an order whose value has changed."""
    return df.filter(~F.col(before).eqNullSafe(F.col(after))).orderBy(*order).limit(count)


def balanced(df: DataFrame, keys: list[str], order: list, height: str) -> DataFrame:
    """Where to split each key's items into two columns so that their heights differ least (earliest split on ties)."""
    w = _ordered(keys, order)
    summed = df.withColumn("upto", F.sum(height).over(w.rowsBetween(*SO_FAR))).withColumn("total", F.sum(height).over(Window.partitionBy(*keys))).withColumn("split", F.row_number().over(w))
    apart = F.round(F.abs(2 * F.col("upto") - F.col("total")), 6)
    return summed.groupBy(*keys).agg(F.min(F.struct(apart.alias("apart"), F.col("split"), F.round("upto", 6).alias("left"))).alias("best")).select(*keys, F.col("best.split").alias("split"), F.col("best.left").alias("left_height"), F.col("best.apart").alias("apart"))


def trimmed_fit(df: DataFrame, keys: list[str], x: str, y: str, rounds: int = 4) -> DataFrame:
    """Least squares per key, refitted without rows whose residual exceeds the larger of 2 and 2.5 upper medians.

    Each round's residuals are written once: a round reads its rows four times, and unwritten rounds would nest to the fourth power.
    """
    rows, before = df.select(*keys, x, y), None
    spread = scans.hot(rows, keys)
    fitted = lambda d: d.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))
    for _ in range(rounds):
        off = storage.table(rows.join(fitted(rows), keys).select(*keys, x, y, F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")).alias("off")), "residuals")
        storage.drop(before)
        mid = medians.upper_medians(off, keys, "off", spread=spread)
        # a key without a slope has no residuals and keeps its rows
        rows = off.join(mid, keys, "left").filter(F.coalesce(F.col("off") <= F.greatest(F.lit(2.0), 2.5 * F.col("mid")), F.lit(True))).select(*keys, x, y)
        before = off
    fit = fitted(rows)
    return fit.filter("n >= 6")
