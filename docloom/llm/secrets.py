"""Secret scans with multipart credential linking, in DataFrame functions alone.

Strong findings (assignments, access ids, long hex runs) stand for themselves. Weak parts, a bare 40
character secret or an endpoint, say nothing alone; an interval join within each document reports a weak
secret only if an access id starts at most ``REACH`` code points away, and an endpoint only if an access id
and a secret part (weak secret or assignment) both do. The join is a range-framed window over the parts of a
document ordered by position, so no pairs are made however dense a text is.

Positions are code points, end exclusive. Spark has no function for match positions; a text is split by the
pattern and the running sum of the lengths of gaps and matches gives them. Only lengths are shuffled.

``credentials`` gives the links themselves: each secret part with the nearest access id and, if there is one in reach of that, the
nearest endpoint.

Defined results: a null or empty text has no spans; rows that repeat an id, or have none, are scanned apart; spans that
start together are listed in the order of ``KINDS``; of two parts that are equally near the earlier one is linked; an
empty table gives an empty result; further columns are ignored. A text is scanned whole by one task; of its matches only
lengths leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REACH = 256
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Patterns by kind, in the order of listing; a maximal run shorter than the least length can't match.
KINDS = (
    ("assign", ASSIGN),
    ("access", r"AKIA[A-Z0-9]{16,}"),
    ("hex", r"[0-9a-f]{24,}"),
    ("secret", r"[A-Za-z0-9/+]{40,}"),
    ("endpoint", r"""https?://[^\x20\x09-\x0D"'<>]+"""),
)


def _sound(kind: str, match: Column) -> Column:
    """Whether a match counts as a part of its kind."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6
    if kind == "secret":
        return (F.length(match) == 40) & match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
    return F.lit(True)


def _pieces(text: Column, k: int) -> Column:
    """Gaps and matches of one kind in order: (kind, at, gap, size, sound); the last gap is left out."""
    kind, pattern = KINDS[k]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.struct(F.length(m).alias("size"), _sound(kind, m).alias("sound")))
    rows = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m["size"].alias("size"), m["sound"].alias("sound")))
    rows = F.transform(rows, lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("at"), x["gap"].alias("gap"), x["size"].alias("size"), x["sound"].alias("sound")))
    nothing = F.array().cast("array<struct<kind:int,at:int,gap:int,size:int,sound:boolean>>")
    return F.when(text.rlike(pattern), rows).otherwise(nothing)


def _placed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Every match (id, row, kind, start, end) and one row with a null kind per document without."""
    rows = docs.select(F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    found = rows.select("id", "row", F.explode_outer(F.concat(*(_pieces(F.col("text"), k) for k in range(len(KINDS))))).alias("p"))
    found = found.select("id", "row", "p.*").repartition("row")
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("at"))
    placed = found.withColumn("end", upto).withColumn("start", F.col("end") - F.col("size"))
    return placed.withColumn("kind", F.when(F.col("sound"), F.col("kind")))


def parts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per reported span (id, row, kind number, start, end), and one with a null kind per document without."""
    placed = _placed(docs, id_column, text_column)
    near = Window.partitionBy("row").orderBy("start").rangeBetween(-REACH, REACH)
    access = F.max(F.when(F.col("kind") == 1, 1).otherwise(0)).over(near) == 1
    secret = F.max(F.when(F.col("kind").isin(0, 3), 1).otherwise(0)).over(near) == 1
    told = (F.col("kind") <= 2) | ((F.col("kind") == 3) & access) | ((F.col("kind") == 4) & access & secret)
    return placed.withColumn("told", told).select("id", "row", F.when(F.col("told"), F.col("kind")).alias("kind"), "start", "end")


def credentials(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, secret, access, endpoint) as spans: each assignment or weak secret within REACH of an access id, with the nearest one and the endpoint nearest to the secret."""
    placed = _placed(docs, id_column, text_column).filter("kind IS NOT NULL")
    span = F.struct("start", "end")
    before = Window.partitionBy("row").orderBy("start").rangeBetween(-REACH, 0)
    behind = Window.partitionBy("row").orderBy("start").rangeBetween(0, REACH)

    def nearest(kind: int) -> Column:
        own = F.when(F.col("kind") == kind, span)
        a, b = F.max(own).over(before), F.min(own).over(behind)
        return F.when(b.isNull() | (F.col("start") - a["start"] <= b["start"] - F.col("start")), a).otherwise(b)

    linked = placed.withColumns({"access": nearest(1), "endpoint": nearest(4), "secret": span})
    return linked.filter(F.col("kind").isin(0, 3) & F.col("access").isNotNull()).select(F.col("id").alias(id_column), "secret", "access", "endpoint")


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: counts of the strong kinds and the spans as array<struct<start,kind,end,name>>."""
    one = F.struct("start", "kind", "end", F.element_at(F.array(*(F.lit(k) for k, _ in KINDS)), F.col("kind") + 1).alias("name"))
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k][0]}")
    spans = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), one)))
    return parts(docs, id_column, text_column).groupBy("row").agg(F.first("id").alias(id_column), count(0), count(1), count(2), spans.alias("spans")).drop("row")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] <= 2)
    return scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def oracle() -> str:
    """DuckDB SQL of ``digest``; RE2 folds more letters than A-Z, so case is spelled out."""
    word = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join([*map(word, ("password", "passwd", "secret", "token")), f"{word('api')}_?{word('key')}"])
    assign = rf"""({names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    patterns = [assign] + [p.replace("'", "''") for _, p in KINDS[1:]]
    sound = [f"length(regexp_extract(x, '{assign}', 2)) >= 6", "true", "true", "length(x) = 40 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]')", "true"]
    each = " UNION ALL ".join(f"SELECT doc_id, {k} AS kind, '{KINDS[k][0]}' AS name, i, pieces, ms, ms[i] AS x, {sound[k].replace('x,', 'ms[i],').replace('(x)', '(ms[i])')} AS sound FROM (SELECT doc_id, string_split_regex(t, '{p}') AS pieces, regexp_extract_all(t, '{p}') AS ms FROM d), unnest(range(1, len(ms) + 1)) AS u(i)" for k, p in enumerate(patterns))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({each}),
p AS (SELECT doc_id, kind, name, CAST(list_sum(list_transform(pieces[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS s, length(x) AS n FROM m WHERE sound),
w AS (SELECT *, max(CASE WHEN kind = 1 THEN 1 ELSE 0 END) OVER near AS a, max(CASE WHEN kind IN (0, 3) THEN 1 ELSE 0 END) OVER near AS k
      FROM p WINDOW near AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN {REACH} PRECEDING AND {REACH} FOLLOWING)),
r AS (SELECT doc_id, kind, s, name || ':' || s || ':' || (s + n) AS said FROM w WHERE kind <= 2 OR (kind = 3 AND a = 1) OR (kind = 4 AND a = 1 AND k = 1))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(said, ',' ORDER BY s, kind) FILTER (kind <= 2), '')) AS base_sha256,
       coalesce(string_agg(said, ',' ORDER BY s, kind) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id"""
