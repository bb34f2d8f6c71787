"""Operators over rows on small inputs written here: matching, ledgers, nested values, layout, office files, retried calls."""

from __future__ import annotations

import io
import struct
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import documents, ledger, nested, relational, windows
from docloom.parse import papers
from docloom.plans import classify
from tests.stated_text import QUERIES as _TAKEN
from tests.stated_text import values
from docloom.sources import office
from docloom.streaming import limits

QUERIES, SQL = {}, {}


def frame(name: str, expected: list[tuple[int, str | None]]):
    """Registers a function of a session that gives (id, out); out must be text already."""

    def add(f):
        assert name not in _TAKEN and name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(spark).select(F.col("id").cast("long").alias("id"), F.col("out").cast("string").alias("out"))
        SQL[name] = values(expected)
        return f

    return add


def rows(spark: SparkSession, schema: str, *data: tuple) -> DataFrame:
    return spark.createDataFrame(list(data), schema)


def told(*columns: str, sep: str = ":") -> F.Column:
    return F.concat_ws(sep, *(F.col(c).cast("string") for c in columns))


# --- stores ----------------------------------------------------------------------------------------------


@frame("project_list", [(1, "c"), (2, "a"), (3, "b")])
def _(spark):
    df = rows(spark, "name string, updated long, pages int", ("a", 20, 1), ("b", 10, 2), ("c", 30, 3))
    return windows.listed(df, [F.desc("updated"), "name"]).select(F.col("place").alias("id"), F.col("name").alias("out"))


@frame("owned_rows", [(1, "a"), (3, "c")])
def _(spark):
    df = rows(spark, "id int, owner string, name string", (1, "017", "a"), (2, "018", "b"), (3, "017", "c"), (4, None, "d"))
    return relational.owned(df, "owner", "017").select("id", F.col("name").alias("out"))


@frame("feedback_scan", [(1, "good:5"), (2, "bad:")])
def _(spark):
    docs = rows(spark, "id int, json string", (1, '{"fields":{"comment":{"stringValue":"good"},"rating":{"integerValue":"5"}}}'), (2, '{"fields":{"comment":{"stringValue":"bad"}}}'))
    v = office.untagged(F.col("json"), ["comment", "rating"])
    return docs.select("id", v.alias("v")).select("id", F.concat(F.col("v.comment"), F.lit(":"), F.coalesce("v.rating", F.lit(""))).alias("out"))


@frame("typed_documents", [(1, '{"fields":{"a":{"stringValue":"x"},"b":{"integerValue":3},"c":{"booleanValue":true},"d":{"doubleValue":1.5}}}')])
def _(spark):
    df = rows(spark, "id int, r struct<a:string,b:int,c:boolean,d:double>", (1, ("x", 3, True, 1.5)))
    return df.select("id", office.tagged("r")(df).alias("out"))


@frame("written_status", [(1, '"\ufeffkey","state","wait"'), (2, '"k1","READY","0"'), (3, '"k2","COOLING","20"')])
def _(spark):
    from docloom import storage

    status = rows(spark, "key string, state string, wait int", ("k1", "READY", 0), ("k2", "COOLING", 20)).coalesce(1)
    path = f"{storage.new_path(spark, 'status')}/csv"
    documents.write_status(status, path)
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.rtrim(F.regexp_replace("value", "\n$", "")), "\n")).alias("out"))
    return lines.withColumn("id", F.when(F.col("out").contains("key"), 1).when(F.col("out").contains("k1"), 2).otherwise(3))


@frame("stored_keys", [(1, "3 of 3, 36 long")])
def _(spark):
    kept = documents.stored(rows(spark, "v string", ("a",), ("a",), ("b",)))
    return kept.agg(F.concat(F.count_distinct("key").cast("string"), F.lit(" of "), F.count("*").cast("string"), F.lit(", "), F.max(F.length("key")).cast("string"), F.lit(" long")).alias("out")).withColumn("id", F.lit(1))


@frame("layout_changes", [(1, "3:b>c"), (2, "2:a>b")])
def _(spark):
    log = rows(spark, "at int, source string, target string", (1, "x", "a"), (2, "a", "b"))
    new = rows(spark, "at int, source string, target string", (3, "b", "c"))
    out = documents.transitions(log, new, 2)
    return windows.listed(out, [F.desc("at")]).select(F.col("place").alias("id"), F.concat(F.col("at").cast("string"), F.lit(":"), F.col("source"), F.lit(">"), F.col("target")).alias("out"))


@frame("export_envelopes", [(1, '{"format":"f","formatVersion":2,"templates":[{"id":1,"name":"a"},{"id":2,"name":""}]}')])
def _(spark):
    df = rows(spark, "id int, name string, hidden int", (2, "", 9), (1, "a", 9))
    return documents.envelope(df, "f", 2, ["id", "name"], "id").select(F.lit(1).alias("id"), F.col("json").alias("out"))


@frame("imported_envelopes", [(0, "1:a:true"), (1, "2::false")])
def _(spark):
    row = '"templates":[{"id":1,"name":"a"},{"id":2,"name":""}]'
    df = rows(spark, "json string", ('{"format":"f","formatVersion":2,' + row + "}",), ('{"format":"f","formatVersion":3,' + row + "}",), ('{"format":"g","formatVersion":1,' + row + "}",), ("no json",), (None,))
    got = documents.opened(df, "f", 2, "struct<id:int,name:string>", "name")
    return got.select(F.col("pos").alias("id"), F.concat_ws(":", F.col("id").cast("string"), "name", F.col("sound").cast("string")).alias("out"))


@frame("saved_sessions", [(1, "kept")])
def _(spark):
    df = rows(spark, "id int, key string, v int, at string", (1, "a", 1, "2024-05-01 10:00:00"), (2, "b", 1, "2024-05-01 10:00:00"), (3, "a", 2, "2024-05-01 10:00:00"), (4, "a", 1, "2024-04-29 10:00:00"))
    return relational.session(df.withColumn("at", F.col("at").cast("timestamp")), "a", 1, F.lit("2024-05-02 09:59:59").cast("timestamp"), 86400).select("id", F.lit("kept").alias("out"))


@frame("capture_models", [(0, "heading:1::"), (1, "paragraph::1:left"), (2, "paragraph::1:right"), (3, "label_value::3:left"), (4, "list::3:right"), (5, "paragraph:::"), (6, 'table[["a","b"],["1","2"]]:::'), (8, "rule:::"), (9, "paragraph:::")])
def _(spark):
    left, right = [100.0, 50.0, 200.0, 450.0], [120.0, 500.0, 220.0, 950.0]
    df = rows(
        spark, "doc int, page int, idx int, type string, fs string, box array<double>, text string",
        (1, 1, 0, "heading", "xl", [10.0, 50.0, 50.0, 950.0], "শির"), (1, 1, 1, "paragraph", None, left, "এক"), (1, 1, 2, "unknown", None, right, "দুই"), (1, 1, 3, "label_value", None, [300.0, 50.0, 400.0, 300.0], "ক: খ"), (1, 1, 4, "list_item", None, [300.0, 310.0, 400.0, 500.0], "গ"),
        (1, 1, 5, "paragraph", None, [300.0, 510.0, 400.0, 900.0], "ঘ"), (1, 1, 6, "table", None, None, "| a | b |\n|---|---|\n| 1 | 2 |"), (1, 1, 7, "table", None, None, ""), (1, 1, 8, "other", None, None, "⟦─×12⟧"), (1, 1, 9, "paragraph", None, None, "শেষ"),
    )
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return documents.model_of_capture(df).select(F.col("idx").alias("id"), F.concat_ws(":", F.concat("role", F.coalesce(F.to_json("rows"), F.lit(""))), blank("level"), blank("pair"), blank("side")).alias("out"))


@frame("stale_scores", [(2, "new"), (3, "changed")])
def _(spark):
    now = rows(spark, "id int, fingerprint string", (1, "a"), (2, "b"), (3, "d"))
    scored = rows(spark, "id int, fingerprint string", (1, "a"), (3, "c"))
    return documents.stale(now, scored, "id").select("id", F.when(F.col("id") == 2, "new").otherwise("changed").alias("out"))


@frame("payload_sizes", [(1, "7"), (2, "0")])
def _(spark):
    items = rows(spark, "id int, chunk string", (1, "abcd"), (1, "xyz"), (2, None))
    return relational.payload(items, "id", "chunk").select("id", F.col("bytes").alias("out"))


# --- filters and decisions -------------------------------------------------------------------------------


@frame("notice_filter", [(1, "true"), (3, "true"), (4, "true")])
def _(spark):
    df = rows(spark, "id int, category string, title string, dept string, org string", (1, "college", "Form", None, None), (2, "job", "Form", None, None), (3, "results", None, "form office", None), (4, "admissions", "x", "y", "FORM"), (5, "college", "none", None, None))
    return relational.notices(df, "college", " form ").select("id", F.lit("true").alias("out"))


@frame("fallback_decisions", [(1, "direct:info"), (2, "abort:warning"), (3, "abort:warn"), (4, "abort:error")])
def _(spark):
    df = rows(spark, "id int, kind string, own_key boolean", (1, "location", True), (2, "server_error", False), (3, "daily_cap", True), (4, "fatal_input", True))
    return relational.fallback(df).select("id", told("action", "tone").alias("out"))


@frame("available_keys", [(1, "true"), (2, "false"), (3, "false"), (4, "false"), (5, "true")])
def _(spark):
    df = rows(spark, "id int, state string, k long, m long", (1, None, None, None), (2, "INVALID", None, None), (3, "READY", 101, None), (4, "READY", 0, 200), (5, "READY", 100, 100))
    return df.select("id", ledger.available(F.col("state"), F.col("k"), F.col("m"), F.lit(100)).alias("out"))


_EXAM = "১. নিচের উদ্দীপক পড়।\nক. পানি কাকে বলে? ১\nখ. বায়ু কেন দরকার বল। ২\nগ. মাটি ব্যাখ্যা কর। ৩"
_CHOICE = "\n".join(f"{n}. রং কোনটি?\nক) লাল\nখ) নীল\nগ) কালো\nঘ) সাদা" for n in "১২৩৪৫৬")
_TYPES = [
    ("---\ndoc_type: CASH_MEMO\n---\nক", "CASH_MEMO:1.0"),
    ("---\ndoc_type: EXAM_CQ\nlayout_lock: true\ngrade: 3\n---\nক", "EXAM_CQ:1.0"),
    ("---\ndoc_type: EXAM_CQ\ngrade: ৩\n---\nক", "EXAM_GENERAL:0.97"),
    ("---\ncontent: SYLLABUS\n---\nক", "EXAM_GENERAL:0.97"),
    (f"---\ndoc_type: EXAM_GENERAL\nsections: cq:1\n---\n{_EXAM}", "EXAM_CQ:0.96"),
    (f"---\nsections: cq:1\nsubject: গণিত\n---\n{_EXAM}", "EXAM_MATH:0.96"),
    ("---\ndoc_type: EXAM_CQ\nsections: cq:4\n---\nকোনো গঠন নেই", "EXAM_GENERAL:0.9"),
    (f"---\nsections: mcq:6\n---\n{_CHOICE}", "EXAM_MCQ:0.96"),
    (f"---\nsections: cq:1, mcq:6\n---\n{_EXAM}\n{_CHOICE}", "EXAM_COMBINED:0.96"),
    (f"---\nsections: cq:1, essay:2\n---\n{_EXAM}", "EXAM_GENERAL:0.95"),
    (f"সৃজনশীল প্রশ্ন\n{_EXAM}", "EXAM_CQ:"),
    (_CHOICE, "EXAM_MCQ:"),
    ("ক্যাশ মেমো\nক্রেতার স্বাক্ষর\nবিক্রেতার স্বাক্ষর", "CASH_MEMO:"),
    ("বরাবর,\nবিষয়: ছুটি\nমহোদয়,\nবিনীত নিবেদন আবেদন", "GOVT_APP:"),
    ("PAY SLIP\nমূল বেতন", "SALARY_SLIP:"),
    ("প্রবেশপত্র", "ADMIT_CARD:"),
    ("জরুরি বিজ্ঞপ্তি\nস্মারক নং ৫", "OFFICIAL_NOTICE:"),
    ("ক্লাস রুটিন\n| বার | সময় |", "ROUTINE:"),
    ("জীবনবৃত্তান্ত", "CV_RESUME:"),
    ("হলফনামা", "STAMP_DEED:"),
    ("এই মর্মে প্রত্যয়ন করা যাচ্ছে", "PROTTOYON:"),
    ("মেসার্স করিম ট্রেডার্স", "OFFICE_PAD:"),
    ("কথা", "GENERAL:"),
    (None, "GENERAL:"),
]


@frame("classified_texts", [(i, out) for i, (_, out) in enumerate(_TYPES, 1)])
def _(spark):
    df = rows(spark, "doc_id int, text string", *((i, t) for i, (t, _) in enumerate(_TYPES, 1)))
    return classify.classify(df).select(F.col("doc_id").alias("id"), F.concat(F.col("doc_type"), F.lit(":"), F.coalesce(F.col("confidence").cast("string"), F.lit(""))).alias("out"))


@frame("block_statistics", [(1, "1:1:0:0"), (2, "6:0:6:0"), (3, "1:0:0:1")])
def _(spark):
    df = rows(spark, "doc int, t string", (1, _EXAM), (2, _CHOICE), (3, "১. $x^2$ কত?"))
    lines = df.select("doc", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    return classify.block_counts(lines).select(F.col("doc").alias("id"), told("numbered", "cq", "mcq", "math").alias("out"))


# --- matching --------------------------------------------------------------------------------------------


@frame("matched_paragraphs", [(1, "1"), (2, "2"), (5, "5")])
def _(spark):
    left = rows(spark, "id int, page int, text string", (1, 1, "the same paragraph"), (2, 1, "the same paragraph"), (3, 5, "alone on its page"), (4, 2, "ab"), (5, None, "without a page"))
    right = rows(spark, "id int, page int, text string", (1, 2, "the same paragraph"), (2, 1, "the same paragraph"), (3, 7, "alone on its page"), (4, 2, "abababababab"), (5, 9, "without a page"), (6, 1, "quite other words"))
    return relational.matched_texts(left, right).select(F.col("a").alias("id"), F.col("b").alias("out"))


@frame("slot_passes", [(1, "p3:label"), (2, "p1:label"), (3, "p2:label alone"), (4, "p4:present"), (5, "p6:table"), (6, "p7:first line"), (7, "p8:order"), (8, "p9:order")])
def _(spark):
    s = rows(
        spark, "doc int, slot_id string, pos int, kind string, role string, key string, ctx string, text string, header array<string>, cols int",
        (1, "1", 1, "kv", "var", "village", "present", "গ্রাম: ক", None, None), (1, "2", 2, "kv", "var", "village", "permanent", "গ্রাম: খ", None, None), (1, "3", 3, "kv", "var", "name", None, "নাম", None, None),
        (1, "4", 4, "para", "fixed", None, None, "জনাব,", None, None), (1, "5", 5, "table", "var", None, None, None, ["পণ্য", "দর"], 2), (1, "6", 6, "para", "var", None, None, "বিনীত নিবেদক\nক", None, None),
        (1, "7", 7, "para", "var", None, None, "নমুনা", None, None), (1, "8", 8, "heading", "var", None, None, "শির", None, None), (2, "9", 1, "para", "var", None, None, "একা", None, None),
    )
    p = rows(
        spark, "doc int, part_id string, pos int, kind string, key string, ctx string, text string, rows array<array<string>>",
        (1, "p1", 1, "kv", "village", "permanent", "গ্রাম: গ", None), (1, "p2", 2, "kv", "name", "present", "নাম: রহিম", None), (1, "p3", 0, "kv", "village", "present", "গ্রাম: ঘ", None),
        (1, "p4", 4, "para", None, None, " জনাব", None), (1, "p5", 5, "table", None, None, None, [["x", "y", "z"]]), (1, "p6", 6, "table", None, None, None, [["পণ্য", "দর"], ["চাল", "৫"]]),
        (1, "p7", 7, "para", None, None, "বিনীত নিবেদক\nরহিম", None), (1, "p8", 8, "para", None, None, "নতুন", None), (1, "p9", 9, "heading", None, None, "নতুন শির", None), (2, "pa", 1, "para", None, None, "এক", None), (2, "pb", 2, "para", None, None, "দুই", None),
    )
    return relational.slot_matching(s, p).select(F.col("slot_id").alias("id"), told("part_id", "rule").alias("out"))


@frame("checked_maps", [(1, "p1"), (2, "p2")])
def _(spark):
    wanted = rows(spark, "slot_id string, part_id string, pos int", ("1", "p1", 0), ("2", "p1", 1), ("2", "p2", 2), ("3", "p9", 3), ("4", "p3", 4))
    slots = rows(spark, "slot_id string, kind string", ("1", "kv"), ("2", "kv"), ("3", "kv"), ("4", "table"))
    parts = rows(spark, "part_id string, kind string", ("p1", "kv"), ("p2", "kv"), ("p3", "kv"))
    return relational.checked_map(wanted, slots, parts).select(F.col("slot_id").alias("id"), F.col("part_id").alias("out"))


@frame("line_matches", [(1, "3:3:2"), (2, "1:0:0")])
def _(spark):
    lines = rows(spark, "page int, side string, pos double", (1, "a", 0.10), (1, "a", 0.20), (1, "a", 0.50), (1, "b", 0.11), (1, "b", 0.21), (1, "b", 0.80), (2, "a", 0.5))
    return relational.line_matches(lines, 0.02).select(F.col("page").alias("id"), told("a", "b", "matched").alias("out"))


@frame("two_sided_lines", [(1, "0.75"), (2, "1.0")])
def _(spark):
    a = rows(spark, "page int, a int, b int, matched int", (1, 2, 5, 2), (2, 0, 0, 0))
    b = rows(spark, "page int, a int, b int, matched int", (1, 2, 5, 1), (2, 0, 0, 0))
    return relational.two_sided(a, b).select(F.col("page").alias("id"), F.col("ratio").alias("out"))


@frame("photo_rows", [(1, "9"), (3, "8")])
def _(spark):
    b = rows(spark, "doc int, page int, idx int, box array<double>, text string", (1, 1, 1, [100.0, 50.0, 140.0, 400.0], "নাম"), (1, 1, 2, [500.0, 50.0, 540.0, 400.0], "নিচে"), (1, 1, 9, [90.0, 700.0, 300.0, 900.0], "ছবি"), (1, 2, 3, [100.0, 50.0, 140.0, 400.0], "নাম"), (1, 2, 7, [90.0, 600.0, 200.0, 690.0], ""), (1, 2, 8, [90.0, 700.0, 300.0, 900.0], "photo"))
    return documents.photo_rows(b).select(F.col("idx").alias("id"), F.col("photo").alias("out"))


@frame("reconciled_digits", [(1, "১২"), (2, "7"), (3, "৫")])
def _(spark):
    tokens = rows(spark, "doc int, pos int, token string", (1, 1, "12"), (1, 2, "৭"), (1, 3, "5"))
    design = rows(spark, "doc int, pos int, token string", (1, 0, "১২"), (1, 1, "7"), (1, 2, "৯"), (1, 3, "12"), (1, 4, "৮"))
    return relational.reconciled(tokens, design).select(F.col("pos").alias("id"), F.col("token").alias("out"))


@frame("address_contexts", [(1, None), (2, "1"), (3, "1"), (4, None), (5, None), (6, None), (7, "6")])
def _(spark):
    df = rows(spark, "doc int, pos int, key string", (1, 1, "addr"), (1, 2, "village"), (1, 3, "post"), (1, 4, "name"), (1, 5, "village"), (1, 6, "addr"), (1, 7, "village"))
    df = windows.carried(df, ["doc"], ["pos"], F.col("key") == "addr", F.col("key").isin("village", "post"), "pos")
    return df.select(F.col("pos").alias("id"), F.col("owner").alias("out"))


# --- checks and measures -----------------------------------------------------------------------------------


@frame("document_checks", [(1, "digits,headings,long_tables,placeholders,tables,words"), (2, "digits,headings,long_tables,tables"), (3, "headings,long_tables,placeholders,words")])
def _(spark):
    pairs = rows(spark, "id int, source string, output string", (1, "# ক\nএক দুই", "# ক\nএক দুই"), (2, "এক দুই", "এক [[TODO"), (3, "এক ১\n| a |", "এক ১ 2"))
    pairs = pairs.withColumn("output", F.when(F.col("id") == 3, F.lit("এক ১ 2 a")).otherwise(F.col("output")))
    return documents.checks(pairs).filter("ok").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("check")), ",").alias("out"))


@frame("model_violations", [(1, "table"), (2, "role"), (4, "sides")])
def _(spark):
    df = rows(spark, "doc int, idx int, role string, rows array<array<string>>", (1, 1, "table", [["a"], ["b", "c"]]), (1, 2, "odd", None), (1, 3, "table", [["a"], ["b"]]), (1, 4, "side_by_side", None))
    return relational.violations(df, ("table", "side_by_side")).select(F.col("idx").alias("id"), F.col("problem").alias("out"))


@frame("kept_words", [(1, "এক দুই তিন|এক **দুই**\nতিন")])
def _(spark):
    b = rows(spark, "doc int, idx int, role string, text string, rows array<array<string>>", (1, 0, "paragraph", "এক **দুই**", None), (1, 1, "noise", "বাদ", None), (1, 2, "table", "তিন", [["তিন", "-"]]))
    w = nested.kept_words(b, ("paragraph", "table")).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "at", "word"))), lambda x: x["word"]), " ").alias("w"))
    return w.join(nested.plain_text(b, ("paragraph", "table")), "doc").select(F.col("doc").alias("id"), told("w", "text", sep="|").alias("out"))


@frame("required_fields", [(1, "date"), (2, None), (3, None)])
def _(spark):
    df = rows(spark, "id int, doc_type string, date string, name string", (1, "A", None, "x"), (2, "A", "d", "x"), (3, "B", None, None))
    return relational.required(df, {"A": ["name", "date"]}).select("id", F.col("missing").alias("out"))


@frame("ink_extents", [(1, "3:2:9:8")])
def _(spark):
    px = rows(spark, "page int, x int, y int", (1, 3, 4), (1, 9, 2), (1, 5, 8))
    return relational.extents(px, ["page"]).select(F.col("page").alias("id"), told("left", "top", "right", "bottom").alias("out"))


@frame("pay_slips", [(1, "20000.0:1600.0:18400.0")])
def _(spark):
    slip = ["মূল বেতন: ১৬,০০০", "ভাতা: ৪,০০০ টাকা", "মোট আয়: ২০,০০০", "কর্তন:", "তহবিল: ১,৬০০"]
    return relational.salary(rows(spark, "doc int, pos int, line string", *((1, i, x) for i, x in enumerate(slip)))).select(F.col("doc").alias("id"), told("earnings", "deductions", "net").alias("out"))


@frame("section_styles", [(1, "true"), (2, "false")])
def _(spark):
    q = rows(spark, "section int, num string, text string", (1, "১", "কী"), (1, "২", "কে"), (2, "1", "What"), (2, "2", "Who"))
    return q.groupBy("section").agg(text.bengali_style(F.collect_list("num"), F.collect_list("text")).alias("out")).withColumnRenamed("section", "id")


# --- ordered rows ----------------------------------------------------------------------------------------


@frame("column_bands", [(0, "1:wide"), (1, "2:left"), (2, "2:right"), (9, "2:right")])
def _(spark):
    data = [(1, 1, 0, "paragraph", "t" * 50, [0.0, 50.0, 40.0, 950.0])]
    for i in range(4):
        data.append((1, 1, 1 + 2 * i, "paragraph", "l" * 80, [100.0 + 50 * i, 50.0, 140.0 + 50 * i, 480.0]))
        data.append((1, 1, 2 + 2 * i, "paragraph", "r" * 80, [100.0 + 50 * i, 520.0, 140.0 + 50 * i, 950.0]))
    data.append((1, 1, 9, "paragraph", "no box", None))
    df = rows(spark, "doc int, page int, idx int, role string, text string, box array<double>", *data)
    return windows.column_bands(df).filter("idx IN (0, 1, 2, 9)").select(F.col("idx").alias("id"), told("cols", "kind").alias("out"))


@frame("chunk_plans", [(1, "5,5"), (2, "7,6"), (3, "8,8"), (4, "8"), (5, "2,2,2,2,1")])
def _(spark):
    sizes = {1: [1] * 10, 2: [1] * 13, 3: [1] * 16, 4: [1] * 8, 5: [300] * 9}
    df = rows(spark, "doc int, page int, size int", *((d, i, s) for d, xs in sizes.items() for i, s in enumerate(xs)))
    out = windows.planned_chunks(df, "doc", "page", "size", 8, 700, 5)
    per = out.groupBy("doc", "chunk").count().groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "count"))), lambda x: x["count"].cast("string")), ",").alias("out"))
    return per.withColumnRenamed("doc", "id")


_CHUNKS = ["---\ndoc_type: EXAM_CQ\n---\n# স্কুল\n## ক বিভাগ\n১. এক\n২. দুই\n[এআই অডিট নোট ও পরিবর্তনসমূহ: পুরোনো]", "---\ndoc_type: X\n---\n# স্কুল\n## ক বিভাগ\n১. তিন [[FIG:p=1;box=1,2,3,4]]\n## খ বিভাগ\n৫. চার\n[এআই অডিট নোট ও পরিবর্তনসমূহ: নতুন]", None]


@frame("merged_answers", [(1, "---\ndoc_type: EXAM_CQ\n---\n# স্কুল\n## ক বিভাগ\n১. এক\n২. দুই\n\n৩. তিন [[FIG:p=9;box=1,2,3,4]]\n## খ বিভাগ\n১. চার\n\n[অসম্পূর্ণ: ভাগ ৩/৩ (পৃষ্ঠা ১৭–২০) ব্যর্থ হয়েছে — সার্ভার ত্রুটি। বাকি ভাগের ফলাফল সংরক্ষিত আছে।]\n\n[এআই অডিট নোট ও পরিবর্তনসমূহ: নতুন]")])
def _(spark):
    df = rows(spark, "doc int, chunk int, text string, first int, last int, error string", *((1, i, t, a, b, None) for i, (t, a, b) in enumerate(zip(_CHUNKS, (1, 9, 17), (8, 16, 20), strict=True))))
    return papers.merged_answers(df, "doc", "chunk").select(F.col("doc").alias("id"), F.col("merged").alias("out"))


@frame("merged_formats", [(1, "ab:true"), (2, "c:false")])
def _(spark):
    df = rows(spark, "p int, i int, bold boolean, t string", (1, 0, True, "a"), (1, 1, True, "b"), (1, 2, False, "c"))
    return windows.merged_runs(df, ["p"], "i", ["bold"], "t").select(F.col("run").alias("id"), told("t", "bold").alias("out"))


# --- ledgers ---------------------------------------------------------------------------------------------


def _states(spark):
    e = rows(spark, "key string, model string, at string, ok boolean, class string, latency_ms long, reopen_after_ms long, scope string, seq int", ("k", "m", "2024-05-01 10:00:00", True, None, 100, 0, "model", 1), ("k", "m", "2024-05-01 10:01:00", True, None, 201, 0, "model", 2), ("k", "m", "2024-05-01 10:02:00", False, "SERVER", 0, 30000, "model", 3), ("k", "m", "2024-05-01 10:03:00", False, "TIMEOUT", 0, 0, "model", 4), ("k", "n", "2024-05-01 10:04:00", False, "SERVER", 0, 30000, "model", 5))
    return ledger.states(e.withColumn("at", F.col("at").cast("timestamp")), F.lit("2024-05-01 10:04:10").cast("timestamp"))


@frame("ledger_states", [(1, "5:2:3:151.0:2")])
def _(spark):
    return _states(spark).select(F.lit(1).alias("id"), told("requests", "success", "fail", "avg_latency_ms", "fail_streak").alias("out"))


@frame("ledger_status", [(1, "READY:0:20")])
def _(spark):
    s = ledger.status(_states(spark), 1714557850000)
    return s.select(F.lit(1).alias("id"), F.concat_ws(":", "shown", *(F.col("waits")[m]["reopen_in_sec"].cast("string") for m in ("m", "n"))).alias("out"))


@frame("soonest_reopening", [(1, "20")])
def _(spark):
    return ledger.soonest(ledger.status(_states(spark), 1714557850000)).select(F.lit(1).alias("id"), F.col("wait_sec").alias("out"))


@frame("migrated_ledgers", [(1, "0::0:2"), (2, "5:SERVER:3:2"), (3, "7:RPM:0:2")])
def _(spark):
    df = rows(spark, "key string, model string, reopen_ms long, reason string, fail_streak long, version int", ("1", "m", 5, "SERVER", 3, 1), ("2", "m", 5, "SERVER", 3, 2), ("3", "m", 7, "RPM", 2, 1))
    out = ledger.migrate(df).withColumn("reason", F.coalesce("reason", F.lit("")))
    return out.select(F.col("key").alias("id"), told("reopen_ms", "reason", "fail_streak", "version").alias("out"))


@frame("given_up_models", [(2, "n"), (3, "m")])
def _(spark):
    plan = rows(spark, "step int, model string", (0, "m"), (1, "m"), (2, "n"), (3, "m"))
    return ledger.skip_model(plan, 0, "m").select(F.col("step").alias("id"), F.col("model").alias("out"))


@frame("round_robin", [(1, "1"), (2, "0"), (3, "0")])
def _(spark):
    df = rows(spark, "id int, o int, n int", (1, 0, 3), (2, 2, 3), (3, 5, 0))
    return df.select("id", ledger.next_offset(F.col("o"), F.col("n")).alias("out"))


@frame("folded_ledgers", [(1, "4:2:2:1:151.0:READY"), (2, "1:0:1:0:0.0:INVALID")])
def _(spark):
    data = [("1", "2024-05-01", 1000, 1, True, None, 100, 0), ("1", "2024-05-01", 2000, 2, True, None, 201, 0), ("1", "2024-05-01", 3000, 3, False, "SERVER", 0, 30000), ("1", "2024-05-01", 4000, 4, False, "TIMEOUT", 0, 0), ("2", "2024-05-01", 1, 1, False, "RPD", 0, 500), ("2", "2024-05-02", 2, 2, False, "INVALID", 0, None)]
    df = rows(spark, "key string, day string, at_ms long, seq int, ok boolean, cls string, latency_ms long, reopen_after_ms long", *data)
    return limits.ledger_batch(df).select(F.col("key").alias("id"), told("requests", "success", "fail", "fail_streak", "avg_latency_ms", "state").alias("out"))


@frame("retried_calls", [(1, "done::1"), (2, ":SERVER:3"), (3, ":FATAL_INPUT:1")])
def _(spark):
    def call(payload: str) -> str:
        if payload == "ok":
            return "done"
        error = ValueError()
        error.kind = payload
        raise error

    chunks = rows(spark, "id long, payload string", (1, "ok"), (2, "SERVER"), (3, "FATAL_INPUT"))
    out = limits.with_retries(chunks, call)
    return out.select("id", F.concat_ws(":", F.coalesce("text", F.lit("")), F.coalesce("failure", F.lit("")), F.col("tries").cast("string")).alias("out"))


# --- nested values ----------------------------------------------------------------------------------------

_PAPER = "id int, paper struct<sections:array<struct<title:string,questions:array<struct<num:string,text:string,subQuestions:array<struct<label:string,text:string>>,options:array<struct<label:string,text:string>>>>>>>"


def _paper(spark):
    return rows(spark, _PAPER, (1, ([("ক [সহজ]", [("১", "এক [সহজ]", [("ক", "x [কঠিন]")], []), ("২", "দুই", [], [("ক", "y (easy)")])])],)))


@frame("difficulty_free_papers", [(1, "ক/এক/x/y")])
def _(spark):
    s = _paper(spark).select("id", nested.rewritten(F.col("paper.sections"), text.difficulty_free).alias("s"))
    return s.select("id", F.concat_ws("/", F.col("s")[0]["title"], F.col("s")[0]["questions"][0]["text"], F.col("s")[0]["questions"][0]["subQuestions"][0]["text"], F.col("s")[0]["questions"][1]["options"][0]["text"]).alias("out"))


@frame("question_rows", [(0, "0:১:এক [সহজ]"), (1, "0:২:দুই")])
def _(spark):
    return nested.questions(_paper(spark), "id").select(F.col("question").alias("id"), told("section", "num", "text").alias("out"))


@frame("replaced_elements", [(1, '[{"a":"x"},{"a":"new"}]')])
def _(spark):
    df = rows(spark, "id int, xs array<struct<a:string>>", (1, [("x",), ("y",)]))
    return df.select("id", F.to_json(nested.set_at(F.col("xs"), F.lit(1), "a", F.lit("new"))).alias("out"))


@frame("rectangular_tables", [(1, '[["a","b"],["c",""]]'), (2, "[]")])
def _(spark):
    df = rows(spark, "id int, r array<array<string>>", (1, [["a", "b"], ["c"]]), (2, []))
    return df.select("id", F.to_json(nested.rectangle(F.col("r"))).alias("out"))


@frame("flattened_blocks", [(1, "para:a,side:,para:l,para:r,para:b")])
def _(spark):
    df = rows(spark, "id int, blocks array<struct<role:string,text:string,left:array<struct<role:string,text:string>>,right:array<struct<role:string,text:string>>>>", (1, [("para", "a", [], []), ("side", "", [("para", "l")], [("para", "r")]), ("para", "b", [], [])]))
    f = nested.flat_blocks(df, "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "side_idx", told("role", "text").alias("t")))).alias("xs"))
    return f.select("id", F.array_join(F.transform("xs", lambda x: x["t"]), ",").alias("out"))


def _slots(spark):
    return nested.slots(rows(spark, "template string, idx int, kind string, key string, text string", ("t", 0, "heading", None, "শিরোনাম"), ("t", 1, "kv", "নাম", "রহিম"), ("t", 2, "kv", "নাম", "রহিম"), ("t", 3, "para", None, "তারিখ ১/১")))


@frame("template_slots", [(0, "s0:fixed:"), (1, "s1:var:"), (2, "s2:var:s1"), (3, "s3:var:")])
def _(spark):
    return _slots(spark).select(F.col("idx").alias("id"), F.concat_ws(":", "slot_id", "role", F.coalesce("twin_of", F.lit(""))).alias("out"))


@frame("filled_templates", [(0, "শিরোনাম"), (1, "করিম"), (2, "করিম"), (3, "")])
def _(spark):
    out = nested.filled(_slots(spark), rows(spark, "slot_id string, part_id string", ("s1", "p")), rows(spark, "part_id string, text string", ("p", "করিম")))
    return out.select(F.col("idx").alias("id"), F.col("text").alias("out"))


@frame("filled_tables", [(1, '[["h","g"],["1",""],["",""],["মোট",""]]'), (2, '[["h"],["1"],["2"]]')])
def _(spark):
    df = rows(spark, "id int, s array<array<string>>, r array<array<string>>", (1, [["h", "g"], ["a", "b"], ["c", "d"], ["মোট", ""]], [["1"]]), (2, [["h"], ["a"]], [["1"], ["2"]]))
    return df.select("id", F.to_json(nested.filled_table(F.col("s"), F.col("r"))).alias("out"))


@frame("checked_settings", [(1, "11.0:a"), (2, "12.0:b"), (3, "11.0:a")])
def _(spark):
    raw = rows(spark, "id int, size string, layout string", (1, "99", "X"), (2, "12", " B "), (3, None, None))
    return nested.settings(raw, {"size": (6, 48, 11)}, {"layout": ("a", "b")}).select("id", told("size", "layout").alias("out"))


@frame("choice_pages", [(0, "0:12.0"), (1, "0:12.0"), (2, "0:12.0"), (3, "1:12.0"), (4, "1:12.0"), (5, "1:12.0")])
def _(spark):
    items = rows(spark, "doc long, item long, height double", *((1, i, 30.0) for i in range(6)))
    return nested.plans(items, 100.0).select(F.col("item").alias("id"), told("column", "size").alias("out"))


@frame("booklet_pages", [(0, "0"), (1, "0"), (2, "1"), (3, "1"), (4, "2")])
def _(spark):
    items = rows(spark, "doc long, item long, height double", *((1, i, 50.0) for i in range(5)))
    return nested.plans(items, 110.0, kind="booklet").select(F.col("item").alias("id"), F.col("column").alias("out"))


@frame("header_balance", [(1, "2"), (2, None)])
def _(spark):
    cases = rows(spark, "id int, n int", (1, nested.best_split([3, 3, 2, 2], 6, 6)), (2, nested.best_split([9, 9], 6, 6)))
    return cases.select("id", F.col("n").alias("out"))


# --- office files ------------------------------------------------------------------------------------------

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(parts: dict[str, str]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return b.getvalue()


DOCX = zipped({
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="B"/></w:pPr><w:r><w:t>শিরো</w:t></w:r><w:r><w:rPr><w:b w:val="0"/><w:sz w:val="30"/></w:rPr><w:t>নাম</w:t><w:tab/></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>ক</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>খ</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="A"><w:rPr><w:rFonts w:ascii="Nikosh"/></w:rPr></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/><w:rPr><w:b/></w:rPr></w:style></w:styles>',
    "word/_rels/document.xml.rels": '<r xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="media/a.png"/></r>',
})
XLSX = zipped({"xl/workbook.xml": "<x/>", "xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><r><t>দুই</t></r><r><t>ভাগ</t></r></si></sst>', "xl/worksheets/sheet1.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>x</t></is></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>'})
PPTX = zipped({"ppt/presentation.xml": "<x/>", "ppt/slides/slide1.xml": '<p xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>স্লাইড</a:t></a:r></a:p></p>'})
MHTML = b"MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=B\r\n\r\n--B\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\nPGI+a2E8L2I+\r\n--B\r\nContent-Type: image/png\r\nContent-Location: a.png\r\nContent-Transfer-Encoding: base64\r\n\r\nAAEC\r\n--B--\r\n"


def files(spark, *contents: bytes) -> DataFrame:
    return spark.createDataFrame([(str(i), bytearray(c)) for i, c in enumerate(contents, 1)], "path string, content binary")


@frame("office_texts", [(1, "docx:শিরোনাম\t\nক\n\nখ"), (2, "xlsx:দুইভাগ\nx\n5"), (3, "pptx:স্লাইড"), (4, "mhtml:ka"), (5, "text:সাধারণ"), (6, "text:আমি বাংলা গান গাই"), (7, "bad")])
def _(spark):
    legacy = "Avwg evsjv Mvb MvB"
    got = office.texts(files(spark, DOCX, XLSX, PPTX, MHTML, "সাধারণ".encode(), (legacy + " Ö×ØÙÚÛÜÝÞßàáâãäåæçèéêë").encode(), b"PK\x03\x04bad"))
    short = F.when(F.col("was_legacy"), F.rtrim(F.substring("text", 1, 18))).otherwise(F.col("text"))
    return got.select(F.col("path").alias("id"), F.when(F.col("error").isNotNull(), "bad").otherwise(F.concat_ws(":", "kind", short)).alias("out"))


@frame("document_runs", [(0, "শিরো:Nikosh:true:"), (1, "নাম\t:Nikosh:false:15.0")])
def _(spark):
    r = office.runs(files(spark, DOCX)).filter("para = 0")
    return r.select(F.col("run").alias("id"), F.concat_ws(":", "text", "font", F.col("bold").cast("string"), F.coalesce(F.col("size").cast("string"), F.lit(""))).alias("out"))


@frame("slide_runs", [(0, "স্লাইড")])
def _(spark):
    return office.runs(files(spark, PPTX)).select(F.col("run").alias("id"), F.col("text").alias("out"))


@frame("sheet_cells", [(1, "A1=দুইভাগ,B1=x,C1=5")])
def _(spark):
    return office.cells(files(spark, XLSX)).groupBy(F.col("path").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("cell", F.lit("="), "text"))), ",").alias("out"))


@frame("changed_cells", [(1, "A1:দুইভাগ>`yBfvM")])
def _(spark):
    from docloom.parse import transcode

    c = office.cells(files(spark, XLSX)).withColumn("after", transcode.to_legacy("text"))
    return windows.changed(c, "text", "after", ["path", "cell"], 10).select(F.col("path").alias("id"), F.concat("cell", F.lit(":"), "text", F.lit(">"), "after").alias("out"))


@frame("page_facts", [(1, "portrait:10.0:0"), (2, "landscape:7.5:2")])
def _(spark):
    other = zipped({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:framePr/></w:pPr><w:r><w:rPr><w:sz w:val="15"/></w:rPr><w:t>ক</w:t></w:r></w:p><w:tbl><w:tblPr><w:tblpPr/></w:tblPr></w:tbl><w:sectPr><w:pgSz w:orient="landscape"/></w:sectPr></w:body></w:document>'})
    return office.page_facts(files(spark, DOCX, other)).select(F.col("path").alias("id"), told("orientation", "least_size", "frames").alias("out"))


def compound(streams: dict[str, bytes]) -> bytes:
    """A small compound file: every stream is 4096 bytes or more and so in ordinary sectors."""
    fat: list[int] = []
    blocks: list[bytes] = []

    def put(data: bytes) -> int:
        start, n = len(fat), -(-len(data) // 512)
        fat.extend([*range(start + 1, start + n), 0xFFFFFFFE])
        blocks.append(data.ljust(n * 512, b"\0"))
        return start

    entries = [(name, 2, put(data), len(data)) for name, data in streams.items()]
    entries.insert(0, ("Root Entry", 5, 0xFFFFFFFE, 0))
    directory = put(b"".join(n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<H", 2 * len(n) + 2) + bytes([k, 0]) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<II", s, z) + b"\0" * 4 for n, k, s, z in entries))
    table = len(fat)
    fat.append(0xFFFFFFFD)
    blocks.append(b"".join(struct.pack("<I", x) for x in fat).ljust(512, b"\xff"))
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", 1, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return (head + struct.pack("<109I", table, *[0xFFFFFFFF] * 108)).ljust(512, b"\0") + b"".join(blocks)


def old_doc(wide: str, narrow: bytes) -> bytes:
    """An old Word file of two pieces: UTF-16, then eight bits."""
    word = bytearray(4096)
    data = wide.encode("utf-16-le")
    word[1024 : 1024 + len(data)], word[2048 : 2048 + len(narrow)] = data, narrow
    struct.pack_into("<H", word, 10, 0x200)
    n = len(wide), len(wide) + len(narrow)
    pieces = struct.pack("<III", 0, *n) + struct.pack("<HIH", 0, 1024, 0) + struct.pack("<HIH", 0, 0x40000000 | 2 * 2048, 0)
    clx = b"\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", word, 0x1A2, 0, len(clx))
    return compound({"WordDocument": bytes(word), "1Table": clx.ljust(4096, b"\0")})


@frame("old_word_files", [(1, "doc:পুরোনো\nplain – text"), (2, "bad")])
def _(spark):
    got = office.texts(files(spark, old_doc("পুরোনো\r", b"plain \x96 text"), bytes.fromhex("d0cf11e0a1b11ae1")))
    return got.select(F.col("path").alias("id"), F.when(F.col("error").isNotNull(), "bad").otherwise(told("kind", "text")).alias("out"))


@frame("document_tables", [(1, '[[[{"text":"ক","span":2,"goes_on":false}],[{"text":"","span":1,"goes_on":true},{"text":"খ","span":1,"goes_on":false}]]]')])
def _(spark):
    return office.tables(files(spark, DOCX)).select(F.col("path").alias("id"), F.to_json("tables").alias("out"))


@frame("relationships", [(1, "rId1=media/a.png")])
def _(spark):
    return office.targets(files(spark, DOCX)).select(F.col("path").alias("id"), F.concat("rel", F.lit("="), "target").alias("out"))


@frame("bundle_parts", [(0, "text/html:9:"), (1, "image/png:3:a.png")])
def _(spark):
    return office.bundle_parts(files(spark, MHTML)).select(F.col("part").alias("id"), F.concat_ws(":", "type", F.length("data").cast("string"), "location").alias("out"))


@frame("embedded_pictures", [(0, "jpeg:8"), (1, "png:17")])
def _(spark):
    data = b"..\xff\xd8\xff123\xff\xd9..\x89PNG\r\n\x1a\n0IEND1234.."
    return office.pictures(files(spark, data)).select(F.col("at").alias("id"), F.concat_ws(":", "kind", F.length("data").cast("string")).alias("out"))


@frame("style_rules", [(1, 'p>{"color":"red","a":"b"}'), (2, '.x>{"c":"d"}')])
def _(spark):
    css = rows(spark, "t string", ("p { Color: red; a:b } .x{c:d}",)).select(F.posexplode(office.css_rules(F.col("t"))).alias("i", "r"))
    return css.select((F.col("i") + 1).alias("id"), F.concat("r.selector", F.lit(">"), F.to_json(office.declared(F.col("r.body")))).alias("out"))


@frame("resolved_styles", [(1, "b:2,c:3,d:4,e:5")])
def _(spark):
    df = rows(spark, "id int, p map<string,string>, t map<string,string>, c map<string,string>, i map<string,string>", (1, {"b": "1", "e": "5"}, {"b": "2", "c": "2"}, {"c": "3", "d": "3"}, {"d": "4"}))
    m = office.resolved(*(F.col(c) for c in "ptci"))
    return df.select("id", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), ",").alias("out"))


@frame("first_source", [(1, "2 rows")])
def _(spark):
    got = office.first_of(lambda: spark.read.json("/nowhere at all"), lambda: spark.range(0), lambda: spark.range(2))
    return got.agg(F.concat(F.count("*").cast("string"), F.lit(" rows")).alias("out")).withColumn("id", F.lit(1))


@frame("notice_files", [(1, 'এক "দুই"\nতিন:x')])
def _(spark):
    from docloom import storage

    path = f"{storage.new_path(spark, 'notices')}/n"
    rows(spark, "value string", ('শিরোনাম,dept\n"এক ""দুই""\nতিন",x\n,y',)).coalesce(1).write.text(path)
    return office.notices(spark, path).select(F.lit(1).alias("id"), F.concat_ws(":", "title", "dept").alias("out"))
