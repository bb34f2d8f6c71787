"""Filters, lookups, matching joins, set operations, aggregates and quality measures."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import storage
from docloom.operators import medians
from docloom.parse import udfs

# --- filters ---------------------------------------------------------------------------------------------


def notices(df: DataFrame, category: str = "college", search: str = "") -> DataFrame:
    """Rows of a category ("college" takes admissions and results in), with a case-blind substring over three columns."""
    wanted = ("college", "admissions", "results") if category == "college" else (category,)
    q = search.strip().lower()
    hit = F.lit(True) if not q else sum((F.coalesce(F.lower(c), F.lit("")).contains(q).cast("int") for c in ("title", "dept", "org")), F.lit(0)) > 0
    return df.filter(F.col("category").isin(*wanted) & hit)


def of_category(df: DataFrame, category: str, search: str = "", columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one category ("all": every one) in any of whose columns the text occurs."""
    df = df if category == "all" else df.filter(F.col("category") == category)
    if search:
        df = df.filter(F.greatest(*(F.coalesce(F.lower(c), F.lit("")).contains(search.lower()) for c in columns), F.lit(False)))
    return df


def tagged_search(tables: dict[str, tuple[DataFrame, str, str]], search: str) -> DataFrame:
    """One union over several tables: (source, id, label) of the rows whose label holds the text in any case."""
    out = None
    for source, (df, key, label) in tables.items():
        part = df.filter(F.lower(label).contains(search.lower())).select(F.lit(source).alias("source"), F.col(key).cast("long").alias("id"), F.col(label).alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


def owned(df: DataFrame, column: str, owner: str) -> DataFrame:
    """An owner's rows; none for an owner that is not there."""
    return df.filter(F.col(column) == owner)


def payload(items: DataFrame, key: str, column: str) -> DataFrame:
    """Bytes of each key's payloads; missing ones have none."""
    return items.groupBy(key).agg(F.sum(F.coalesce(F.octet_length(column), F.lit(0))).alias("bytes"))


_SCHEME = r"^([a-z][a-z0-9+.-]*://)"
#: What admits every origin is dealt over so many keys.
_ANY = 64


def origin_allowed(origins: DataFrame, allowed: DataFrame) -> DataFrame:
    """Origins (origin) that a list of patterns (pattern) admits: *, exact, host, scheme with host, or *.host.

    Both sides become keys that meet by equality: an origin asks for itself, its host with and without its scheme, and each suffix of its host's labels.
    """
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    p = allowed.select(F.lower(F.trim("pattern")).alias("p")).filter("p <> ''").distinct()
    p = p.withColumn("scheme", F.regexp_extract("p", _SCHEME, 1)).withColumn("bare", F.regexp_replace(F.regexp_replace("p", _SCHEME, ""), "/.*$", ""))
    anywhere = F.transform(F.sequence(F.lit(0), F.lit(_ANY - 1)), lambda i: key("any", i.cast("string")))
    exact = F.when(F.col("bare") != "", F.array(key("host", F.concat("scheme", "bare"))))
    under = F.when(F.col("bare").startswith("*."), F.array(key("under", F.expr("substring(bare, 3)"))))
    none = F.filter(anywhere, lambda _: F.lit(False))
    admitted = p.select(F.explode(F.concat(F.array(key("whole", F.col("p"))), F.coalesce(exact, none), F.coalesce(under, none), F.when(F.col("p") == "*", anywhere).otherwise(none))).alias("k")).distinct()
    o = origins.select("origin").distinct().withColumn("host", F.lower(F.try_parse_url(F.col("origin"), F.lit("HOST")))).filter(F.col("host").isNotNull()).withColumn("low", F.lower("origin"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: key("under", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    own = F.array(key("whole", F.col("low")), key("host", F.col("host")), key("host", F.concat(F.regexp_extract("low", _SCHEME, 1), "host")), key("any", F.pmod(F.xxhash64("origin"), F.lit(_ANY)).cast("string")))
    met = o.select("origin", F.explode(F.concat(own, suffixes)).alias("k")).join(admitted, "k", "left_semi").select("origin").distinct()
    return origins.join(met, "origin", "left_semi").select("origin")


def route(url: Column, stored: Column) -> Column:
    """legacy if the query parameter or the stored flag says so, else the default."""
    mode = F.lower(F.coalesce(F.nullif(F.try_parse_url(url, F.lit("QUERY"), F.lit("mode")), F.lit("")), F.nullif(stored, F.lit("")), F.lit("")))
    return F.when(mode.isin("legacy", "classic"), "legacy").when(mode == "studio", "studio").otherwise("default")


def failure(status: Column, body: Column) -> Column:
    """(kind, wait_sec) of a proxy's answer; the first rule that holds decides."""
    get = lambda p: F.get_json_object(body, p)
    wait = F.coalesce(get("$.retryInSec").try_cast("long"), F.lit(0))
    attempts = F.coalesce(F.from_json(get("$.attempts"), "array<struct<class:string>>"), F.array().cast("array<struct<class:string>>"))
    detail = F.coalesce(get("$.lastError.detail"), F.lit(""))
    last = F.coalesce(get("$.lastError.status").try_cast("int"), F.lit(0))
    fatal = ((F.size(attempts) > 0) & F.forall(attempts, lambda a: F.coalesce(a["class"] == "FATAL_INPUT", F.lit(False)))) | ((last == 400) & ~detail.rlike("(?i)API key not valid|API_KEY_INVALID"))
    location = F.exists(attempts, lambda a: F.coalesce(a["class"] == "LOCATION", F.lit(False))) | detail.rlike("(?i)user location is not supported")
    made = lambda kind, sec: F.struct(F.lit(kind).alias("kind"), (sec if isinstance(sec, Column) else F.lit(sec)).cast("long").alias("wait_sec"))
    daily = (status == 429) & (F.coalesce(get("$.limit") == "ip_daily", F.lit(False)) | F.coalesce(get("$.error"), F.lit("")).contains("দৈনিক"))
    return (
        F.when(status.isin(401, 403), made("unauthorized", 0))
        .when(daily, made("daily_cap", F.when(wait > 0, wait).otherwise(3600)))
        .when(status == 429, made("all_cooling", wait))
        .when(location, made("location", 90))
        .when(fatal, made("fatal_input", 0))
        .when((status == 0) | (status >= 500), made("server_error", F.when(wait > 0, wait).otherwise(60)))
        .otherwise(made("unknown", 60))
    )


def fallback(failures: DataFrame) -> DataFrame:
    """(kind, own_key) to what to do next and its tone, from a small dimension of decisions."""
    spark = failures.sparkSession
    direct = {"location": "info", "all_cooling": "info", "server_error": "warning", "unknown": "warning"}
    rows = [(k, o, "direct" if o and k in direct else "abort", direct[k] if o and k in direct else {"fatal_input": "error", "unauthorized": "error", "daily_cap": "warn"}.get(k, "warning")) for k in (*direct, "fatal_input", "unauthorized", "daily_cap") for o in (True, False)]
    return failures.join(F.broadcast(spark.createDataFrame(rows, "kind string, own_key boolean, action string, tone string")), ["kind", "own_key"], "left")


# --- lookups and matching --------------------------------------------------------------------------------


def by_alias(rows: DataFrame, key: str, entries: DataFrame) -> DataFrame:
    """The canonical id whose id or aliases (array) hold a key in any case; null if none does."""
    names = entries.select("id", F.explode(F.array_union(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).select(F.lower("alias").alias("alias"), "id").groupBy("alias").agg(F.min("id").alias("canonical"))
    return rows.join(names, F.lower(key) == F.col("alias"), "left").drop("alias")


def effective(defaults: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Settings of a row where it has them (blank and 0 count as missing), else the defaults of its key."""
    types = dict(overrides.dtypes)
    given = lambda c: F.nullif(F.col(f"o.{c}"), F.lit("")) if types[c] == "string" else F.nullif(F.col(f"o.{c}"), F.lit(0))
    mine = [c for c in defaults.columns if c != key]
    joined = overrides.alias("o").join(defaults.alias("d"), key, "left")
    return joined.select(*(F.col(f"o.{c}") for c in overrides.columns if c not in mine), *(F.coalesce(given(c), F.col(f"d.{c}")).alias(c) if c in overrides.columns else F.col(f"d.{c}").alias(c) for c in mine))


def ranked_match(slots: DataFrame, parts: DataFrame, keys: list[str], slot_order: list, part_order: list) -> DataFrame:
    """One pass of one-to-one matching: the k-th slot of a key takes the k-th part of that key."""
    s = slots.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*slot_order)))
    p = parts.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*part_order)))
    return s.select("slot_id", *keys, "k").join(p.select("part_id", *keys, "k"), [*keys, "k"]).select("slot_id", "part_id")


def matched(slots: DataFrame, parts: DataFrame, passes: list[list[str]]) -> DataFrame:
    """Passes of matching from the strictest keys to the loosest; each takes what earlier ones left. (slot_id, part_id, pass)"""
    out = None
    for n, keys in enumerate(passes, 1):
        # written, so that a later pass doesn't run the earlier ones again
        got = storage.table(ranked_match(slots, parts, keys, ["slot_pos", "slot_id"], ["part_pos", "part_id"]).withColumn("pass", F.lit(n)), "matched")
        out = got if out is None else out.unionByName(got)
        slots = slots.join(got.select("slot_id"), "slot_id", "left_anti")
        parts = parts.join(got.select("part_id"), "part_id", "left_anti")
    return out


def same_text(x: Column | str) -> Column:
    """A text as it is compared: lower case, without spaces and marks at its end."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")), r"\s+", ""), r"[,:।;.]+$", ""))


def slot_matching(slots: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc, slot_id, part_id, rule) for the slots and parts of drafts, each slot and part once, by rules from the strictest to the loosest.

    Slots have (doc, slot_id, pos, kind, role, key, ctx, text, header, cols), parts (doc, part_id, pos, kind, key, ctx, text, rows). Rules: label
    and address; label where one side has no address; equal texts (of a fixed slot, the rule is "present"); tables that fit, or
    the only two; equal short first lines; and what is left between two matches in order, if both sides have equally many.
    """
    s = slots.withColumns({"same": same_text("text"), "line": same_text(F.substring_index("text", "\n", 1)), "ctx": F.coalesce("ctx", F.lit(""))})
    p = parts.withColumns({"same": same_text("text"), "line": same_text(F.substring_index("text", "\n", 1)), "ctx": F.coalesce("ctx", F.lit(""))})
    found: list[DataFrame] = []

    def take(pairs: DataFrame, rule: str | Column) -> None:
        nonlocal s, p
        got = storage.table(pairs.select("doc", "slot_id", "part_id", (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule")), "slots")
        found.append(got)
        s, p = s.join(got, ["doc", "slot_id"], "left_anti"), p.join(got, ["doc", "part_id"], "left_anti")

    def in_order(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        k = lambda d: d.withColumn("k", F.row_number().over(Window.partitionBy("doc", *keys).orderBy("pos")))
        return k(a).select("doc", *keys, "k", "slot_id", "role").join(k(b).select("doc", *keys, "k", "part_id"), ["doc", *keys, "k"])

    keyed, pairs = F.col("key").isNotNull() & F.col("kind").isin("kv", "para"), F.col("kind") == "kv"
    take(in_order(s.filter(keyed), p.filter(pairs), ["key", "ctx"]), "label")
    take(in_order(s.filter(keyed & (F.col("ctx") == "")), p.filter(pairs), ["key"]), "label alone")
    take(in_order(s.filter(keyed), p.filter(pairs & (F.col("ctx") == "")), ["key"]), "label alone")
    free = ~F.col("kind").isin("kv", "table") & (F.col("same") != "")
    take(in_order(s.filter(free), p.filter(free), ["same"]), F.when(F.col("role") == "fixed", "present").otherwise("text"))
    tables = s.filter("kind = 'table'").select("doc", "slot_id", "header", "cols", F.col("pos").alias("a")).join(p.filter("kind = 'table'").select("doc", "part_id", "rows", F.col("pos").alias("b")), "doc")
    alone = (F.count("*").over(Window.partitionBy("doc")) == 1).cast("double") / 2
    fit = tables.withColumn("fit", F.greatest(table_fit(F.col("header"), F.col("cols"), F.col("rows")).cast("double"), alone)).filter("fit > 0")
    one, two = F.struct("doc", "slot_id"), F.struct("doc", "part_id")
    best = best_first(fit.select(one.alias("a"), two.alias("b"), (F.col("fit") - F.col("a") / 1e5 - F.col("b") / 1e9).alias("similarity")))
    take(best.select("a.doc", "a.slot_id", "b.part_id"), "table")
    several = F.col("text").contains("\n")
    first = F.col("kind").isin("para", "list") & F.length("line").between(2, 30)
    take(in_order(s.filter(first & (F.col("role") == "var") & several), p.filter(first), ["line"]), "first line")
    take(in_order(s.filter(first & (F.col("role") == "var")), p.filter(first & several), ["line"]), "first line")
    # matches in order on both sides part what is left into gaps
    every = reduce(DataFrame.unionByName, found)
    placed = every.join(slots.select("doc", "slot_id", F.col("pos").alias("a")), ["doc", "slot_id"]).join(parts.select("doc", "part_id", F.col("pos").alias("b")), ["doc", "part_id"])
    upto = F.max("b").over(Window.partitionBy("doc").orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    anchors = placed.withColumn("upto", upto).filter(F.col("upto").isNull() | (F.col("b") > F.col("upto")))

    def gaps(rows: DataFrame, side: str, name: str) -> DataFrame:
        both = rows.select("doc", "pos", F.col(name), "kind", F.lit(0).alias("anchor")).unionByName(anchors.select("doc", F.col(side).alias("pos"), F.lit(None).cast("string").alias(name), F.lit(None).cast("string").alias("kind"), F.lit(1).alias("anchor")))
        gap = F.sum("anchor").over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        return both.withColumn("gap", gap).filter("anchor = 0")

    gs, gp = gaps(s.filter(F.col("role") == "var"), "a", "slot_id").filter(F.col("kind").isin("para", "list", "heading", "sign")), gaps(p, "b", "part_id").filter(F.col("kind").isin("para", "list", "heading"))
    plain = F.col("kind").isin("para", "list")
    size = lambda d, n: d.groupBy("doc", "gap").agg(F.count("*").alias(n), F.count_if(plain).alias(f"{n}_plain"))
    counts = size(gs, "slots").join(size(gp, "parts"), ["doc", "gap"])
    # headings of the draft count only where the numbers then agree, and other slots than text only in such gaps
    whole = counts.filter("slots = parts").select("doc", "gap")
    partly = counts.filter("slots <> parts AND slots = parts_plain AND slots = slots_plain").select("doc", "gap")
    left = gs.withColumn("role", F.lit("var"))
    for chosen, rows in ((whole, gp), (partly, gp.filter(plain))):
        take(in_order(left.join(chosen, ["doc", "gap"], "left_semi"), rows.join(chosen, ["doc", "gap"], "left_semi"), ["gap"]), "order")
    return reduce(DataFrame.unionByName, found)


def left_over(slots: DataFrame, parts: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slots without a part and parts without a slot."""
    return slots.join(pairs, "slot_id", "left_anti"), parts.join(pairs, "part_id", "left_anti")


def checked_map(wanted: DataFrame, slots: DataFrame, parts: DataFrame) -> DataFrame:
    """Of a given map (slot_id, part_id, pos): known ids of one kind, each part once, the first mention wins."""
    known = wanted.join(slots.select("slot_id", F.col("kind").alias("slot_kind")), "slot_id").join(parts.select("part_id", F.col("kind").alias("part_kind")), "part_id").filter("slot_kind = part_kind")
    once = known.withColumn("k", F.row_number().over(Window.partitionBy("part_id").orderBy("pos"))).filter("k = 1")
    return once.withColumn("k", F.row_number().over(Window.partitionBy("slot_id").orderBy("pos"))).filter("k = 1").select("slot_id", "part_id")


def table_fit(header: Column, columns: Column, rows: Column) -> Column:
    """2 if half of a slot's header cells match the first row, 1 if the widest row has the slot's columns, else 0."""
    cells = F.filter(F.transform(F.get(rows, F.lit(0)), lambda c: F.lower(F.trim(c))), lambda c: c != "")
    heads = F.filter(F.transform(header, lambda h: F.lower(F.trim(h))), lambda h: h != "")
    hits = F.size(F.filter(heads, lambda h: F.exists(cells, lambda c: (c == h) | c.contains(h) | h.contains(c))))
    widest = F.array_max(F.transform(rows, F.size))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, 0).when((F.size(header) > 0) & (hits >= 0.5 * F.greatest(F.lit(1), F.size(heads))), 2).when(widest == columns, 1).otherwise(0)


#: A text is cut into pieces of so many characters, those into smaller ones, and these into bigrams: reaching a character walks from a piece's begin.
PIECE_CHARS = (1 << 14, 1 << 7)


def bigrams(df: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """(key, gram, n): character bigrams as a multiset; a text of one character counts as itself."""
    keys = [key] if isinstance(key, str) else key
    piece, at = F.col("piece"), F.col("at")
    rows = df.select(*keys, F.col(text).alias("piece")).filter(F.length("piece") > 0)
    for size in PIECE_CHARS:
        # pieces share a character, so that no bigram is lost between them
        last = F.floor((F.greatest(F.length(piece), F.lit(2)) - 2) / size)
        rows = rows.select(*keys, "piece", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("at")).select(*keys, F.substring(piece, (at * size + 1).cast("int"), F.lit(size + 1)).alias("piece"))
    grams = rows.select(*keys, "piece", F.explode(F.sequence(F.lit(1), F.greatest(F.length(piece) - 1, F.lit(1)))).alias("at")).select(*keys, F.substring(piece, at, F.lit(2)).alias("gram"))
    return grams.groupBy(*keys, "gram").agg(F.count("*").alias("n"))


def similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean of the two bigram containments for every pair (a, b) that shares a bigram."""
    totals = lambda d, name: d.groupBy("id").agg(F.sum("n").alias(name))
    common = left.select(F.col("id").alias("a"), "gram", F.col("n").alias("x")).join(right.select(F.col("id").alias("b"), "gram", F.col("n").alias("y")), "gram").groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("common"))
    out = common.join(totals(left, "na").withColumnRenamed("id", "a"), "a").join(totals(right, "nb").withColumnRenamed("id", "b"), "b")
    return out.select("a", "b", ((F.col("common") / F.col("na") + F.col("common") / F.col("nb")) / 2).alias("similarity"))


#: Texts that a text may meet one by one: those of its keys, on its page and the two beside it.
NEIGHBOURS = 64


def _bigram_counts(text: str) -> Counter:
    return Counter(map(str.__add__, text, text[1:])) if len(text) > 1 else Counter(text)


def _likeness_of(a: str, b: str) -> float | None:
    """Mean of the two bigram containments of two texts; null if they share none."""
    x, y = _bigram_counts(a), _bigram_counts(b)
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    common = sum(min(n, y[g]) for g, n in x.items() if g in y)
    return (common / x.total() + common / y.total()) / 2 if common else None


_likeness = udfs.over_text(_likeness_of, "double")


def match_candidates(left: DataFrame, right: DataFrame, least: float = 0.6, share: float = 0.25, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b, similarity) of texts (id, page, text and the keys) of equal keys on the same or the next page (a page may be unknown), of like length and likeness.

    Where pages are known and a text has few texts beside it, all of those are met and compared whole, so a text is shuffled a few times and its
    bigrams never are. Texts with more than ``NEIGHBOURS`` beside them or of an unknown page, and those that meet such, go by ``_prefixed``. Null keys match nothing.
    """
    keys = list(keys)
    if not keys:
        return _prefixed(left, right, least, share, keys)
    alone = {name: d.select(*keys, "id", "page", "text").filter(F.length("text") > 0) for name, d in (("a", left), ("b", right))}
    # a whole key goes one way: by its largest page of each side, and by bigrams if a page is unknown
    counts = [d.groupBy(*keys, "page").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias(f"most_{name}"), F.bool_or(F.col("page").isNull()).alias(f"loose_{name}")) for name, d in alone.items()]
    many = counts[0].join(counts[1], keys).filter(F.col("loose_a") | F.col("loose_b") | (F.greatest(F.col("most_a"), F.col("most_b")) * 3 > NEIGHBOURS)).select(*keys)
    many = storage.table(many, "many")
    rest = {name: d.join(many, keys, "left_anti") for name, d in alone.items()}
    asking = rest["a"].select(*keys, F.col("id").alias("a"), F.col("text").alias("text_a"), F.explode(F.array(*(F.col("page") + i for i in (-1, 0, 1)))).alias("page"))
    both = asking.join(rest["b"].select(*keys, "page", F.col("id").alias("b"), F.col("text").alias("text_b")), [*keys, "page"])
    both = both.filter(F.least(F.length("text_a"), F.length("text_b")) >= share * F.greatest(F.length("text_a"), F.length("text_b")))
    met = both.select("a", "b", _likeness("text_a", "text_b").alias("similarity")).filter(F.col("similarity") >= least)
    if many.isEmpty():
        return met
    return met.unionByName(_prefixed(*(alone[name].join(many, keys, "left_semi") for name in "ab"), least, share, keys))


def _prefixed(left: DataFrame, right: DataFrame, least: float, share: float, keys: list[str]) -> DataFrame:
    """Such pairs by a prefix-filtered join.

    Two multisets of x and y bigrams reach ``least`` only with (2 * least - 1) * x of them in common, and of y as well, so both
    have one of their rarest x - that + 1 in common: these prefixes alone are joined. Of the pairs that meet, those go on whose sizes, and what stands
    behind the first bigram they share, leave room for enough; only these are counted out.
    """
    floor = max(2 * least - 1, 0.0)
    each = {}
    for name, d in (("a", left), ("b", right)):
        rows = d.select(*keys, F.col("id").alias(name), F.col("page").alias(f"page_{name}"), F.col("text"), F.length("text").alias(f"length_{name}"))
        each[name] = storage.table(bigrams(rows, [*keys, name, f"page_{name}", f"length_{name}"], "text").withColumnRenamed("n", f"g_{name}"), "bigrams")
    often = each["a"].select("gram").unionByName(each["b"].select("gram")).groupBy("gram").agg(F.count("*").alias("often"))
    prefix = {}
    for name, grams in each.items():
        w = Window.partitionBy(*keys, name)
        placed = grams.join(often, "gram").withColumn(f"n_{name}", F.sum(f"g_{name}").over(w)).withColumn(f"at_{name}", F.sum(f"g_{name}").over(w.orderBy("often", "gram").rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"g_{name}"))
        need = F.greatest(F.lit(1), F.ceil(floor * F.col(f"n_{name}") - 1e-9))
        prefix[name] = storage.table(placed.filter(F.col(f"at_{name}") <= F.col(f"n_{name}") - need).drop("often", f"g_{name}"), "prefixes")
    x, y = prefix["a"], prefix["b"]
    near = F.explode(F.array(*(F.col("page_a") + i for i in (-1, 0, 1))))
    known = x.filter("page_a IS NOT NULL").withColumn("page_b", near).join(y.filter("page_b IS NOT NULL"), [*keys, "page_b", "gram"])
    columns = ["a", "b", *(f"{c}_{s}" for c in ("length", "n", "at") for s in "ab")]
    loose = [x.filter("page_a IS NULL").join(y, [*keys, "gram"]), x.filter("page_a IS NOT NULL").join(y.filter("page_b IS NULL"), [*keys, "gram"])]
    met = reduce(DataFrame.unionByName, [d.select(*columns) for d in (known, *loose)])
    met = met.filter((F.least("length_a", "length_b") >= share * F.greatest("length_a", "length_b")) & (F.least("n_a", "n_b") >= floor * F.greatest("n_a", "n_b") - 1e-9))
    pairs = met.groupBy("a", "b", "n_a", "n_b").agg(F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b"))
    likeness = lambda c: (c / F.col("n_a") + c / F.col("n_b")) / 2
    pairs = pairs.filter(likeness(F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))) >= least - 1e-9)
    counted = pairs.join(each["a"].select("a", "gram", "g_a"), "a").join(each["b"].select("b", "gram", "g_b"), ["b", "gram"])
    common = counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum(F.least("g_a", "g_b")).alias("common"))
    return common.select("a", "b", likeness(F.col("common")).alias("similarity")).filter(F.col("similarity") >= least)


def matched_texts(left: DataFrame, right: DataFrame, least: float = 0.6, share: float = 0.25, keys: tuple[str, ...] = ()) -> DataFrame:
    """One-to-one pairs (a, b, similarity) of texts (id, page, text and the keys), the most alike first."""
    return best_first(match_candidates(left, right, least, share, keys))


#: Candidates that are matched on the driver: what many short rounds would be left for.
FEW = 100_000


def _greedy(rows: list) -> list:
    """Greedy pairs of (a, b, similarity), one by one; as in Spark, NaN is above and null below every number."""
    def key(r) -> tuple:
        s = r[2]
        return (2, 0.0, r[0], r[1]) if s is None else (0, 0.0, r[0], r[1]) if s != s else (1, -s, r[0], r[1])

    out, a, b = [], set(), set()
    for r in sorted(rows, key=key):
        if r[0] not in a and r[1] not in b:
            a.add(r[0])
            b.add(r[1])
            out.append(r)
    return out


def _round(left: DataFrame) -> DataFrame:
    """Pairs that greedy matching takes whatever the others do: mutual bests, and groups in which every a ties with every b, k-th to k-th."""
    order = (F.desc("similarity"), "a", "b")
    by_a, by_b = Window.partitionBy("a"), Window.partitionBy("b")
    e = left.withColumn("ra", F.row_number().over(by_a.orderBy(*order))).withColumn("rb", F.row_number().over(by_b.orderBy(*order)))
    e = e.withColumn("top_a", F.col("similarity").eqNullSafe(F.max("similarity").over(by_a))).withColumn("top_b", F.col("similarity").eqNullSafe(F.max("similarity").over(by_b)))
    e = e.withColumn("first", F.min(F.when(F.col("top_a"), F.col("b"))).over(by_a)).withColumn("closed_a", F.bool_and(~F.col("top_a") | F.col("top_b")).over(by_a))
    mine = F.when(F.col("top_b"), F.col("first"))
    e = e.withColumn("closed", F.col("closed_a") & F.bool_and(~F.col("top_b") | F.col("top_a")).over(by_b) & (F.min(mine).over(by_b) == F.max(mine).over(by_b))).withColumn("n", F.count_if("top_b").over(by_b))
    tops = e.filter("top_a AND top_b")
    # a closed group, named by the first b of all its a, is whole if each b has as many a as that one
    whole = tops.groupBy("first").agg(F.min("a").alias("least"), F.bool_and("closed").alias("ok"), F.min("n").alias("lo"), F.max("n").alias("hi")).filter("ok AND lo = hi").select("first", "least")
    grouped = tops.join(whole, "first")
    k = lambda c: F.row_number().over(Window.partitionBy("first").orderBy(c))
    sides = grouped.filter("b = first").select("first", "a", "similarity", k("a").alias("k")).join(grouped.filter("a = least").select("first", "b", k("b").alias("k")), ["first", "k"])
    rest = tops.filter("ra = 1 AND rb = 1").join(whole, "first", "left_anti")
    return sides.select("a", "b", "similarity").unionByName(rest.select("a", "b", "similarity"))


def best_first(candidates: DataFrame) -> DataFrame:
    """Greedy one-to-one pairs (a, b, similarity), best first and ties by (a, b); candidates without an a or b pair with none.

    Rounds go on until no candidate is left; each takes one pair at least. The last ``FEW`` candidates are matched on the driver.
    """
    spark = candidates.sparkSession
    held = lambda d: storage.table(d, "best-first")
    left = held(candidates.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
    schema, parts = left.schema, []
    while (n := left.count()) > FEW:
        tops = held(_round(left))
        parts.append(tops)
        if len(parts) == 20:
            whole = held(reduce(DataFrame.unionByName, parts))
            storage.drop(*parts)
            parts = [whole]
        before, left = left, held(left.join(tops.select("a"), "a", "left_anti").join(tops.select("b"), "b", "left_anti").select("a", "b", "similarity"))
        storage.drop(before)
    parts.append(spark.createDataFrame(_greedy(left.collect()) if n else [], schema))
    storage.drop(left)
    return reduce(DataFrame.unionByName, parts)


def near_pairs(left: DataFrame, right: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Range join of positions within a tolerance: equal buckets of that width and their neighbours, then the exact test."""
    a = left.select(key, F.col("pos").alias("a"), F.explode(F.array(*(F.floor(F.col("pos") / tolerance) + d for d in (-1, 0, 1)))).alias("bucket"))
    b = right.select(key, F.col("pos").alias("b"), F.floor(F.col("pos") / tolerance).alias("bucket"))
    return a.join(b, [key, "bucket"]).filter(F.abs(F.col("a") - F.col("b")) <= tolerance).select(key, "a", "b")


def match_f1(pairs: int | Column, left: int | Column, right: int | Column) -> Column:
    """F1 of a one-to-one match; 1 if both sides are empty."""
    p, a, b = (x if isinstance(x, Column) else F.lit(x) for x in (pairs, left, right))
    return F.when(a + b == 0, F.lit(1.0)).otherwise(2 * p / (a + b))


def line_matches(lines: DataFrame, tolerance: float) -> DataFrame:
    """Lines (page, side a or b, pos) per page: (page, a, b, matched), where each line of a in order takes the nearest line of b that is left, the last of equally near ones."""
    def run(df: pd.DataFrame) -> pd.DataFrame:
        a, b = (df.loc[df["side"] == s, "pos"].sort_values().tolist() for s in ("a", "b"))
        free = dict(enumerate(b))
        for y in a:
            near = [(abs(z - y), -j) for j, z in free.items() if abs(z - y) <= tolerance]
            if near:
                free.pop(-min(near)[1])
        return pd.DataFrame([(df["page"].iloc[0], len(a), len(b), len(b) - len(free))], columns=["page", "a", "b", "matched"])

    return lines.groupBy("page").applyInPandas(run, "page long, a long, b long, matched long")


def two_sided(strict_a: DataFrame, strict_b: DataFrame) -> DataFrame:
    """Per page the share of strict lines of both sides that the other side's loose ones meet, of two results of ``line_matches``; 1 without lines."""
    both = strict_a.select("page", "a", F.col("matched").alias("met_a")).join(strict_b.select("page", F.col("a").alias("b"), F.col("matched").alias("met_b")), "page", "full_outer").fillna(0)
    total = F.col("a") + F.col("b")
    return both.select("page", F.when(total == 0, F.lit(1.0)).otherwise((F.col("met_a") + F.col("met_b")) / total).alias("ratio"))


def overlapping(left: DataFrame, right: DataFrame, key: str, share: float, width: float = 100.0, height: float | None = None) -> DataFrame:
    """Interval join: pairs of boxes of one key that overlap by a share of the shorter, each pair once, by buckets.

    Where all boxes have one ``height``, that is what the share is taken of: the difference of two rounded ends may miss it by a last digit.
    """
    from docloom.functions.calc import y_overlap

    spread = lambda d, p: d.select(key, F.col("id").alias(f"{p}_id"), F.col("y0").alias(f"{p}0"), F.col("y1").alias(f"{p}1"), F.explode(F.sequence(F.floor(F.col("y0") / width), F.floor(F.col("y1") / width))).alias("bucket"))
    first = F.greatest(F.floor(F.col("l0") / width), F.floor(F.col("r0") / width)) == F.col("bucket")
    both = spread(left, "l").join(spread(right, "r"), [key, "bucket"]).filter(first)
    ends = [F.col(c) for c in ("l0", "l1", "r0", "r1")]
    shared = y_overlap(*ends) if height is None else (F.least(ends[1], ends[3]) - F.greatest(ends[0], ends[2])) / height
    return both.filter(shared >= share).select(key, "l_id", "r_id")


def reconciled(tokens: DataFrame, design: DataFrame) -> DataFrame:
    """Numbers in the script in which the design first shows them, else in that of the document's majority."""
    from docloom.functions.calc import to_ascii_digits, to_bengali_digits

    bengali = lambda c: F.col(c).rlike("[০-৯]")
    first = design.withColumn("number", to_ascii_digits(F.col("token"))).groupBy("doc", "number").agg(F.min_by(bengali("token"), "pos").alias("script"))
    most = design.groupBy("doc").agg((F.count_if(bengali("token")) * 2 > F.count("*")).alias("majority"))
    out = tokens.withColumn("number", to_ascii_digits(F.col("token"))).join(first, ["doc", "number"], "left").join(most, "doc", "left")
    return out.select("doc", "pos", F.when(F.coalesce("script", "majority", F.lit(False)), to_bengali_digits(F.col("number"))).otherwise(F.col("number")).alias("token"))


def cached(keys: DataFrame, session: DataFrame, history: DataFrame) -> DataFrame:
    """The payload of each cache key: the session's first, then the newest of history; blank payloads don't count."""
    rows = session.withColumn("source", F.lit("session")).withColumn("rank", F.lit(0)).unionByName(history.withColumn("source", F.lit("history")).withColumn("rank", F.lit(1))).filter("length(trim(payload)) > 0")
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy("cache_key").orderBy("rank", F.desc("at"), F.desc("id")))).filter("k = 1")
    return keys.join(best.select("cache_key", "source", "payload"), "cache_key", "left")


def session(saved: DataFrame, key: str, version: int, now: Column, seconds: int) -> DataFrame:
    """Saved sessions that a key may go on with: of that version and not too old."""
    return saved.filter((F.col("key") == key) & (F.col("v") == version) & (F.unix_timestamp(now) - F.unix_timestamp("at") <= seconds))


def content_hash(parts: Column) -> Column:
    """SHA-256 of one part; of several, that of their hexadecimal hashes joined by a pipe."""
    hashes = F.transform(parts, lambda p: F.sha2(p.cast("binary"), 256))
    return F.when(F.size(parts) == 1, F.get(hashes, F.lit(0))).otherwise(F.sha2(F.array_join(hashes, "|").cast("binary"), 256))


def cache_key(version: Column, mode: Column, directive: Column, hash_: Column) -> Column:
    """version|mode|directive|hash, without the directive if it is blank."""
    return F.concat_ws("|", version, F.coalesce(F.nullif(mode, F.lit("")), F.lit("template")), F.nullif(F.trim(directive), F.lit("")), hash_)


def consumed(rows: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """What a read-once store still holds."""
    return rows.join(taken.select(key).distinct(), key, "left_anti")


#: Rows of one name in a piece, on average: a hot name is numbered piece by piece.
PIECE = 10_000


def _place(cuts: Column, x: Column) -> Column:
    """How many of the sorted cuts are at most x, by halving; 0 without cuts or value."""
    def step(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.coalesce(F.get(cuts, mid) <= x, F.lit(False)) & (s["lo"] < s["hi"])
        return F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    size = F.size(cuts)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))
    return F.when(cuts.isNull(), 0).otherwise(F.aggregate(steps, F.struct(F.lit(0).alias("lo"), size.alias("hi")), step, lambda s: s["lo"]))


def unique_names(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New rows (id, name) with " (n)" behind names that are taken, by earlier rows too.

    A name's rows are cut at ids that a hash picks and numbered by pieces, so no task holds all rows of a hot name.
    """
    new = new.select("id", "name")
    cuts = new.filter(F.pmod(F.xxhash64("id"), F.lit(PIECE)) == 0).groupBy("name").agg(F.sort_array(F.collect_set("id")).alias("cuts"))
    rows = new.join(F.broadcast(cuts), "name", "left").select("id", "name", _place(F.col("cuts"), F.col("id")).alias("piece"))
    before = Window.partitionBy("name").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    taken = existing.groupBy("name").agg(F.count("*").alias("taken"))
    offsets = rows.groupBy("name", "piece").agg(F.count("*").alias("rows")).join(taken, "name", "left").select("name", "piece", (F.coalesce("taken", F.lit(0)) + F.coalesce(F.sum("rows").over(before), F.lit(0))).alias("offset"))
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("name", "piece").orderBy("id"))).join(offsets, ["name", "piece"], "left")
    n = F.col("k") + F.col("offset")
    return numbered.select("id", F.when(n > 1, F.concat("name", F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col("name")).alias("name"))


# --- aggregates and measures -----------------------------------------------------------------------------


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: str, order: str) -> DataFrame:
    """The value of the largest total weight; the one seen first wins ties."""
    per = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"), F.min(order).alias("o"))
    return per.groupBy(*keys).agg(F.max_by(value, F.struct("w", -F.col("o"))).alias(value))


def overlap_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset intersection: recall and precision of right's counts against left's."""
    both = left.withColumnRenamed("n", "x").join(right.withColumnRenamed("n", "y"), keys, "full_outer")
    s = both.agg(F.sum(F.least("x", "y") * F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1).otherwise(0)).alias("common"), F.sum("x").alias("left"), F.sum("y").alias("right"))
    return s.select("common", (F.col("common") / F.col("left")).alias("recall"), (F.col("common") / F.col("right")).alias("precision"))


def otsu(df: DataFrame, keys: list[str], level: str, low: int = 160, high: int = 205) -> DataFrame:
    """The level that separates a histogram best (between-class variance, the lowest on ties), kept within bounds."""
    w = Window.partitionBy(*keys).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    h = df.groupBy(*keys, level).agg(F.count("*").alias("n"))
    h = h.withColumn("n0", F.sum("n").over(w)).withColumn("s0", F.sum(F.col("n") * F.col(level)).over(w)).withColumn("nt", F.sum("n").over(all_)).withColumn("st", F.sum(F.col("n") * F.col(level)).over(all_)).filter("n0 < nt")
    between = F.col("n0").cast("double") * (F.col("nt") - F.col("n0")) * F.pow(F.col("s0") / F.col("n0") - (F.col("st") - F.col("s0")) / (F.col("nt") - F.col("n0")), 2)
    best = h.withColumn("v", F.round(between, 3)).groupBy(*keys).agg(F.max_by(level, F.struct("v", -F.col(level))).alias("threshold"))
    return best.withColumn("threshold", F.least(F.greatest("threshold", F.lit(low)), F.lit(high)))


def extents(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The rectangle of ink (x, y) per page."""
    return pixels.groupBy(*keys).agg(F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"))


def suspects(rows: DataFrame, keys: list[str], height: str, order: str, most: int = 3) -> DataFrame:
    """Rows at least 1.35 or at most 0.65 upper medians high, the furthest from it first."""
    off = rows.join(medians.upper_medians(rows, keys, height), keys).filter((F.col(height) >= 1.35 * F.col("mid")) | (F.col(height) <= 0.65 * F.col("mid")))
    return off.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs(F.col(height) - F.col("mid"))), order))).filter(F.col("k") <= most).drop("k")


def salary(lines: DataFrame) -> DataFrame:
    """Pay slip lines (doc, pos, line) to earnings, deductions and net; totals are not added again."""
    from docloom.functions.calc import leading_number

    line = F.trim("line")
    head_out = F.col("line").rlike(r"^(?:---\s*কর্তন|কর্তন\s*সমূহ|কর্তনসমূহ|বিয়োগ|কর্তন\s*[ঃ:]?\s*$)")
    head_in = F.col("line").rlike(r"^(?:---\s*আয়|আয়\s*সমূহ|আয়\s*[ঃ:]?\s*$)")
    total = F.col("line").rlike(r"^(?:মোট|সর্বমোট|নিট|নীট)") & F.col("line").rlike("[0-9০-৯]")
    rows = lines.withColumn("line", line).withColumn("mode", F.when(head_out & ~total, "deductions").when(head_in & ~total, "earnings"))
    rows = rows.withColumn("kind", F.coalesce(F.last("mode", ignorenulls=True).over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)), F.lit("earnings")))
    pattern = r"^(.+?)[ঃ:]\s*([0-9,০-৯]+(?:\.[0-9]+)?)\s*(?:টাকা)?$"
    amounts = rows.filter(~total & F.col("mode").isNull() & F.col("line").rlike(pattern)).withColumn("amount", leading_number(F.regexp_extract("line", pattern, 2)))
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0.0))
    return amounts.groupBy("doc").agg(part("earnings").alias("earnings"), part("deductions").alias("deductions")).withColumn("net", F.col("earnings") - F.col("deductions"))


def key_status(status: DataFrame) -> DataFrame:
    """How many keys are ready, cooling and invalid, and their requests today."""
    return status.agg(*(F.count_if(F.col("shown") == s).alias(s.lower()) for s in ("READY", "COOLING", "INVALID")), F.sum("requests").alias("requests"))


def marked_pages(text: Column, pattern: str) -> Column:
    """Distinct page numbers that markers name."""
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1)))


def violations(blocks: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """(doc, idx, problem) for unknown roles, tables that are not rectangular and empty sides."""
    ragged = F.size(F.array_distinct(F.transform("rows", F.size))) > 1
    checks = {"role": ~F.col("role").isin(*roles), "table": (F.col("role") == "table") & F.coalesce(ragged, F.lit(True)), "sides": (F.col("role") == "side_by_side") & (F.coalesce(F.size("rows"), F.lit(0)) <= 0)}
    return blocks.select("doc", "idx", F.explode(F.filter(F.array(*(F.when(c, n) for n, c in checks.items())), lambda x: x.isNotNull())).alias("problem"))


def required(parsed: DataFrame, needs: dict[str, list[str]]) -> DataFrame:
    """The first missing field of each row for its doc_type; null if none is or the type is unknown."""
    missing = F.lit(None).cast("string")
    for kind, fields in needs.items():
        first = F.coalesce(*(F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", f) for f in fields))
        missing = F.when(F.col("doc_type") == kind, first).otherwise(missing)
    return parsed.withColumn("missing", missing)


def edit_score(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paragraph states (id, text, style) compared: shares of paragraphs kept, of texts and of styles unchanged."""
    j = before.select("id", F.col("text").alias("t0"), F.col("style").alias("s0"), F.lit(1).alias("was")).join(after.select("id", F.col("text").alias("t1"), F.col("style").alias("s1"), F.lit(1).alias("is")), "id", "full_outer")
    both = F.col("was").isNotNull() & F.col("is").isNotNull()
    share = lambda c: F.count_if(both & c) / F.greatest(F.count_if(both), F.lit(1))
    return j.agg((F.count_if(both) / F.greatest(F.count_if(F.col("was").isNotNull()), F.lit(1))).alias("kept"), share(F.col("t0").eqNullSafe(F.col("t1"))).alias("same_text"), share(F.col("s0").eqNullSafe(F.col("s1"))).alias("same_style"), F.count_if(F.col("was").isNull()).alias("added"))


def page_score(lines: Column, edges: Column, size: Column, rules: Column, boxes: Column) -> Column:
    """Weights 40, 20, 10, 20 and 10 of components that are 0..1."""
    return 40 * lines + 20 * edges + 10 * size + 20 * rules + 10 * boxes
