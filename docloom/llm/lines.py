"""Line dedup by a segment-partition edit join, in DataFrame functions alone.

A line is compared by its text without spaces, tabs and carriage returns at its ends, if that has at least
``LEAST`` code points; shorter lines always stay. An occurrence is removed if an earlier line (by document
id, then line number) is at most ``threshold`` edits away, 0 included; lines are judged on the input.

Equal lines are found by a 128-bit hash. Among distinct lines, each is split into threshold + 1 segments of
nearly equal length; with at most ``threshold`` edits one segment survives. Segments are indexed by (length
of the line, segment number, text); every line probes the index with the substrings that a surviving segment
can be, for each partner length from its own down to ``threshold`` less. Only lines that meet another one at
such a key fetch their text; pairs are verified with a bit-parallel automaton on the diagonal band of width
2 * threshold + 1.

With the threshold of 1, a key that a crowd of lines shares would make pairs in the square of the crowd. Lines at
such keys are split again: of FINE parts one edit touches one, so near lines agree in all the others. What still
agrees is split on until the one part in question has at most SHORT code points, and then lines meet in the text
that is left when one code point goes: lines that meet there are one edit apart, so the earliest of them is enough and
no pairs are made, however large a crowd is. For larger thresholds crowds are paired as they are.

Defined results: a row is known by its id and a hash of its text. Rows that agree in both are copies of one
document and lose the same lines; rows that share an id alone are documents of their own, the one with the smaller hash
the earlier; a null id counts as the largest, so copies of a line that stands under an id go there too. Null and
empty texts have one empty line and stay; the earliest of tied lines stays; an empty table gives an empty result;
further columns pass. A text is split in one task, so it must fit there together with its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import work

LEAST = 20
THRESHOLD = 1
#: A key that more distinct lines index than this is a crowd's; into how many parts its lines are split, and when that ends.
CROWD, FINE, SHORT = 64, 8, 64


def segment(n: Column, i: int, t: int) -> tuple[Column, Column]:
    """First position (from 1) and length of segment i of a line of n code points; later ones are the longer."""
    base, more = F.floor(n / (t + 1)).cast("int"), n % (t + 1)
    short = F.least(F.lit(i - 1), t + 1 - more)
    return (short * base + (i - 1 - short) * (base + 1) + 1).cast("int"), F.when(F.lit(i) <= t + 1 - more, base).otherwise(base + 1).cast("int")


def keys(line: Column, n: Column, t: int) -> tuple[list[Column], list[bool]]:
    """Hashes to probe with, and which of them are those of the line's own segments, by which it is indexed."""
    probe, own = [], []
    for less in range(t + 1):
        for i in range(1, t + 2):
            at, size = segment(n - less, i, t)
            for o in range(max(1 - i, less - (t + 1 - i)), min(i - 1, less + t + 1 - i) + 1):
                key = F.xxhash64((n - less).cast("int"), F.lit(i), F.substring(line, at + o, size))
                probe.append(F.when((at + o >= 1) & (at + o + size <= n + 1), key))
                own.append(less == 0 and o == 0)
    return probe, own


def within(a: Column, b: Column, t: int) -> Column:
    """Whether two texts are at most t edits apart: bit c of state d says that the cell c - t off the diagonal is reached with d edits."""
    width = (1 << (2 * t + 1)) - 1
    start = F.struct(*(F.lit(((1 << (d + 1)) - 1) << t & width).alias(f"d{d}") for d in range(t + 1)), F.lit(0).alias("i"))

    def step(s: Column, c: Column, other: Column) -> Column:
        i = s["i"]
        match = sum((F.when(F.get(other, i + (k - t)) == c, 1 << k).otherwise(0) for k in range(2 * t + 1)), F.lit(0))
        new = [s["d0"].bitwiseAND(match)]
        for d in range(1, t + 1):
            old = s[f"d{d - 1}"]
            reached = s[f"d{d}"].bitwiseAND(match).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
            new.append(reached.bitwiseAND(width))
        return F.struct(*(x.cast("int").alias(f"d{d}") for d, x in enumerate(new)), (i + 1).alias("i"))

    # b is split once, as the only element of an array that transform() walks
    ended = F.get(F.transform(F.array(F.split(b, "")), lambda other: F.aggregate(F.split(a, ""), start, lambda s, c: step(s, c, other), lambda s: s[f"d{t}"])), F.lit(0))
    off = F.length(b) - F.length(a) + t
    reached = F.get(F.array(*(ended.bitwiseAND(1 << k) > 0 for k in range(2 * t + 1))), off)
    return (F.abs(F.length(b) - F.length(a)) <= t) & reached


def alike(a: Column, b: Column) -> Column:
    """Whether two texts that are one edit apart at most could be so: all but one of FINE parts of the shorter agree."""
    n = F.least(F.length(a), F.length(b))
    out = F.lit(False)
    for i in range(1, FINE + 1):
        at, size = segment(n, i, FINE - 1)
        rest = n - (at + size - 1)
        tail = lambda x, r=rest: F.substring(x, F.length(x) - r + 1, r)
        out = out | ((F.substring(a, F.lit(1), at - 1) == F.substring(b, F.lit(1), at - 1)) & (tail(a) == tail(b)))
    return out


#: An occurrence as one number in order of (id, hash of the text, line): such a minimum needs no sorting.
PLACE = "CAST(id AS DECIMAL(19, 0)) * 4611686018427387904 + (CAST(th AS BIGINT) * 2147483648 + at)"
PLACED = {
    "id": "CAST((w - pmod(w, CAST(4611686018427387904 AS DECIMAL(19, 0)))) div CAST(4611686018427387904 AS DECIMAL(19, 0)) AS BIGINT)",
    "th": "CAST(pmod(w, CAST(4611686018427387904 AS DECIMAL(19, 0))) div 2147483648 AS INT)",
    "at": "CAST(pmod(w, CAST(2147483648 AS DECIMAL(19, 0))) AS INT)",
}


def row_key(id_column: str, text_column: str) -> tuple[Column, Column]:
    key, th = work.row_key(id_column, text_column)
    return key, F.pmod(th, F.lit(1 << 31)).cast("int")


def occurrences(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, th, at, line, n) of every line that is compared."""
    key, th = row_key(id_column, text_column)
    every = docs.select(key.alias("id"), th.alias("th"), F.posexplode(F.split(F.col(text_column), "\n", -1)).alias("at", "raw"))
    trimmed = every.select("id", "th", "at", F.btrim("raw", F.lit(" \t\r")).alias("line"))
    return trimmed.withColumn("n", F.length("line")).filter(F.col("n") >= LEAST)


def _shared(rows: DataFrame) -> DataFrame:
    """Keys (key, own, m) that an indexing line and another one have, of rows (w, key, own): how many index it, and how many have it."""
    return work.table(rows.groupBy("key").agg(F.count_if("own").alias("indexed"), F.count("*").alias("m")).filter("indexed > 0 AND m > 1"), "line-keys")


def _meeting(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows whose key is shared, with how many lines index it."""
    return work.joined(work.likely(rows, shared, ["key"]), shared, ["key"], "m")


def _parts(rows: DataFrame) -> DataFrame:
    """Rows (w, key, own, part) of lines that agree outside of a part, by the FINE parts of that part: the key then says what is outside of the smaller one.

    A row that is not its line's own looks for a line that is one code point shorter.
    """
    n = F.length("part") - F.when(F.col("own"), 0).otherwise(1)
    out = []
    for i in range(1, FINE + 1):
        at, size = segment(n, i, FINE - 1)
        rest = n - (at + size - 1)
        before, behind = F.substring("part", F.lit(1), at - 1), F.substring(F.col("part"), F.length("part") - rest + 1, rest)
        out.append(F.struct(F.xxhash64("key", F.lit(i), before, F.lit(i), behind).alias("key"), F.substring(F.col("part"), at, F.length("part") - rest - at + 1).alias("part")))
    return rows.select("w", "own", F.explode(F.array(*out)).alias("k")).select("w", "own", "k.key", "k.part")


def _deletions(rows: DataFrame) -> DataFrame:
    """(w, witness): later lines, each with the earliest line that is one edit away within the part in question.

    Two lines of one length meet if they are equal without the same code point; a longer one meets the shorter that it is without one.
    """
    n = F.length("part")
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    without = lambda p: F.concat(F.substring(F.col("part"), F.lit(1), p - 1), F.substring(F.col("part"), p + 1, n))
    made = lambda key, role: F.struct(key.alias("key"), F.lit(role).alias("role"))
    own = F.concat(F.transform(places, lambda p: made(F.xxhash64("key", F.lit(1), p, without(p)), 0)), F.array(made(F.xxhash64("key", F.lit(2), "part"), 1)))
    longer = F.array_distinct(F.transform(places, lambda p: made(F.xxhash64("key", F.lit(2), without(p)), 2)))
    each = work.table(rows.select("w", F.explode(F.when(F.col("own"), own).otherwise(longer)).alias("k")).select("w", "k.key", "k.role"), "line-deletions")
    first = lambda role: F.min(F.when(F.col("role") == role, F.col("w"))).alias(f"w{role}")
    least = each.groupBy("key").agg(first(0), first(1), first(2), F.count("*").alias("m")).filter("m > 1")
    witness = F.when(F.col("role") == 0, F.col("w0")).when(F.col("role") == 1, F.col("w2")).otherwise(F.col("w1"))
    found = work.table(each.join(least, "key").select("w", witness.alias("witness")).filter("w > witness").distinct(), "line-witnesses")
    work.drop(each)
    return found


def _crowded(lines: DataFrame, t: int) -> DataFrame:
    """(w) of the lines (w, line) in crowds that have an earlier line one edit away."""
    rows = lines.select("w", F.lit(True).alias("own"), F.length("line").alias("n"), "line").unionByName(lines.select("w", F.lit(False).alias("own"), (F.length("line") - 1).alias("n"), "line"))
    rows = rows.select("w", "own", F.xxhash64("n").alias("key"), F.col("line").alias("part"))
    before = None
    while True:
        parts = _parts(rows)
        shared = _shared(parts)
        rows = work.table(_meeting(parts, shared).select("w", "own", "key", "part"), "line-parts")
        work.drop(before, shared)
        before = rows
        if (rows.agg(F.max(F.length("part"))).first()[0] or 0) <= SHORT:
            break
    found = _deletions(rows)
    work.drop(rows)
    one, two = lines.withColumnRenamed("line", "one"), lines.select(F.col("w").alias("witness"), F.col("line").alias("two"))
    out = work.table(found.join(one, "w").join(two, "witness").filter(within(F.col("one"), F.col("two"), t)).select("w").distinct(), "lines-near")
    work.drop(found)
    return out


def removed(docs: DataFrame, threshold: int = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, th, at): the lines to remove, numbered from 0, of rows known by their id and a hash of their text.

    The texts are split once; later steps read the columns they need of the written lines.
    """
    lines = occurrences(docs, id_column, text_column)
    probe, own = keys(F.col("line"), F.col("n"), threshold)
    names = [f"p{j}" for j in range(len(probe))]
    lines = work.table(lines.select("id", "th", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), *(k.alias(c) for k, c in zip(probe, names, strict=True)), "line"), "lines")
    place = F.expr(PLACE)
    firsts = work.table(lines.groupBy("h1", "h2").agg(F.min(place).alias("w"), F.count("*").alias("m"), *(F.min(c).alias(c) for c in names)), "firsts")
    # equal lines: all but the first occurrence
    copies = work.joined(lines.select("id", "th", "at", "h1", "h2"), firsts.filter("m > 1").select("h1", "h2", "w", "m"), ["h1", "h2"], "m").filter(place > F.col("w")).select("id", "th", "at")
    # near lines: those that share a key
    made = (F.struct(F.col(c).alias("key"), F.lit(o).alias("own")) for c, o in zip(names, own, strict=True))
    rows = firsts.select("w", F.explode(F.array(*made)).alias("k")).select("w", "k.key", "k.own").filter("key IS NOT NULL")
    shared = _shared(rows)
    crowd = F.col("indexed") > CROWD if threshold == 1 else F.lit(False)
    hits = work.table(_meeting(rows, shared).select("w", "key", "own", crowd.alias("crowd")), "line-hits")
    wanted = hits.select("w").distinct().selectExpr("w", *(f"{e} AS {c}" for c, e in PLACED.items()))
    wanted = work.table(wanted, "lines-wanted")
    place_ = ["id", "th", "at"]
    texts = work.likely(lines.select(*place_, "line"), wanted, place_).join(wanted, place_).select("w", "line").dropDuplicates(["w"])
    texts = work.table(texts, "line-texts")
    few = hits.filter("NOT crowd").join(texts, "w")
    left, right = few.filter("own").select("key", F.col("w").alias("a"), F.col("line").alias("one")), few.select("key", F.col("w").alias("b"), F.col("line").alias("two"))
    pairs = left.join(right, "key").filter("a <> b")
    one, two = F.col("one"), F.col("two")
    near = work.table(pairs.filter((alike(one, two) if threshold == 1 else F.lit(True)) & within(one, two, threshold)).select(F.greatest("a", "b").alias("w")).distinct(), "lines-near")
    crowds = texts.join(hits.filter("crowd").select("w").distinct(), "w", "left_semi")
    more = _crowded(work.table(crowds, "line-crowds"), threshold) if not crowds.isEmpty() else None
    near_ = near if more is None else near.unionByName(more)
    out = work.table(copies.unionByName(near_.selectExpr(*(f"{e} AS {c}" for c, e in PLACED.items()))), "lines-removed")
    work.drop(lines, firsts, shared, hits, wanted, texts, near, more)
    return out


def _cut(docs: DataFrame, threshold: int, id_column: str, text_column: str) -> DataFrame:
    """The documents with one more column: the numbers of the lines to remove in order, null if there are none."""
    gone = removed(docs, threshold, id_column, text_column).groupBy("id", "th").agg(F.array_sort(F.collect_set("at")).alias("gone lines")).withColumnsRenamed({"id": "gone id", "th": "gone text"})
    key, th = row_key(id_column, text_column)
    keyed = docs.withColumns({"row id": key, "row text": th})
    return keyed.join(gone, (F.col("row id") == F.col("gone id")) & (F.col("row text") == F.col("gone text")), "left").select(*(keyed[c] for c in docs.columns), "gone lines")


def digest(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: lines, removed lines, and the numbers of those."""
    cut = _cut(docs.select("doc_id", "text"), threshold, "doc_id", "text")
    gone = F.col("gone lines")
    return cut.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.transform(gone, lambda x: x.cast("string")), ","), F.lit("")).alias("removed_lines"))


def apply(docs: DataFrame, threshold: int = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without their repeated lines; those of which only blank lines are left go."""
    # a document's other columns stand in one, so that none of them meets a name that is used here
    others = [c for c in docs.columns if c != text_column]
    rows = docs.select(F.struct(*map(work.named, others)).alias("document"), work.named(id_column).alias("doc_id"), work.named(text_column).alias("text"))
    cut = _cut(rows, threshold, "doc_id", "text")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("gone lines", i)), "\n")
    whole = F.col("gone lines").isNull()
    out = cut.withColumn("text", F.when(whole, F.col("text")).otherwise(kept)).filter(whole | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*(F.col("text").alias(c) if c == text_column else F.col("document").getField(c).alias(c) for c in docs.columns))


ORACLE = f"""
WITH e AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
l AS (SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM e),
c AS (SELECT doc_id, pos, line, length(line) AS n FROM l WHERE length(line) >= {LEAST}),
f AS (SELECT line, n, min((doc_id, pos)) AS first FROM c GROUP BY line, n),
near AS (SELECT DISTINCT b.first AS p FROM f a JOIN f b ON a.n BETWEEN b.n - {THRESHOLD} AND b.n + {THRESHOLD} AND a.first < b.first AND levenshtein(a.line, b.line) <= {THRESHOLD}),
gone AS (SELECT DISTINCT doc_id, pos FROM c JOIN f USING (line) WHERE (c.doc_id, c.pos) > f.first OR f.first IN (SELECT p FROM near)),
g AS (SELECT doc_id, count(*) AS m, string_agg(pos, ',' ORDER BY pos) AS s FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines, coalesce(m, 0) AS n_removed, coalesce(s, '') AS removed_lines FROM documents d LEFT JOIN g USING (doc_id)
"""
