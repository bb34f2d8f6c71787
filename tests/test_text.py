"""Text functions, the classifier and the parsers on hand-made Bangla."""

import re

import pytest
from docloom.functions import calc, text
from docloom.parse import forms, maths, papers, transcode
from docloom.plans import catalogue, classify
from pyspark.sql import functions as F


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.grade, "পঞ্চম", 5), (text.grade, "শ্রেণি: ৮ম", 8), (text.grade, "Class Ten", 10), (text.grade, "১৪", 0), (text.grade, "", 0),
        (text.compose_nukta, "সম\u09af\u09bc", "সম\u09df"), (text.number_prefix, "(১) কী?", "১. কী?"), (text.sub_prefix, "ক) কী?", "ক. কী?"), (text.degrees, "৩০^{\\circ}", "৩০°"), (text.degrees, "30^\\circ", "30°"),
        (text.latex_symbols, "\\alpha \\times \\theta", "α × θ"), (text.latex_aliases, "\\dfrac{1}{2} \\left( x \\right)", "\\frac{1}{2} ( x )"), (text.arrows, "A \\rightarrow B", "A → B"), (text.needs_structure, "\\frac{1}{2}", True), (text.needs_structure, "x+1", False),
        (text.difficulty_free, "প্রশ্ন [সহজ] কী", "প্রশ্ন কী"), (text.has_bengali, "abc।", True), (text.has_bengali, "abc", False), (text.without_roles, "a<!-- role:title -->b", "ab"), (text.paper_language, "What is this?", "en"), (text.paper_language, "এটি কী abc", "bn"),
        (text.nested_paper, "(১) ক\n(২) খ", True), (text.roman, "l. এক\nll. দুই", "i. এক\nii. দুই"), (text.strip_stray_front, "ক\n---\na: b\n---\nখ", "ক\nখ"), (text.plain_markdown, "## শিরোনাম\n**মোটা** লেখা", "শিরোনাম\nমোটা লেখা"),
        (lambda c: text.digits(c, "english"), "১২৩", "123"), (text.words, "(এক) দুই, !", ["এক", "দুই"]), (text.cells, "| ক | $a|b$ |", ["ক", "$a|b$"]),
        (calc.money, 1234567.0, "১২,৩৪,৫৬৭"), (calc.money, 999.5, "১,০০০"), (calc.leading_number, "১,৫০০ টাকা", 1500.0), (calc.leading_number, "abc", 0.0), (calc.retry_delay_ms, "1.5s", 1500), (calc.retry_delay_ms, "500ms", 500), (calc.retry_delay_ms, "soon", 0),
        (calc.mask_key, "abcdefghijklm", "abcdef...jklm"), (calc.mask_key, "abc", "abc..."), (calc.half_up, -2.5, -2), (calc.human_wait, 3700, "১ ঘণ্টা ২ মিনিট"), (calc.human_wait, 59, "৫৯ সেকেন্ড"), (calc.human_wait, 0, ""),
    ],
)
def test_scalars(spark, f, given, want):
    assert one(spark, f(F.col("x")), x=given) == want


def test_structs(spark):
    assert tuple(one(spark, text.split_mark(F.col("x")), x="ব্যাখ্যা কর। ৩")) == ("ব্যাখ্যা কর।", "৩")
    assert tuple(one(spark, text.time_and_marks(F.col("x")), x="সময়: ২ ঘণ্টা  পূর্ণমান: ১০০")) == ("২ ঘণ্টা", "১০০")
    assert one(spark, text.sections(F.col("x")), x="[cq:৩, mcq=10; cq x 2]") == {"cq": 5, "mcq": 10}
    front = one(spark, text.front(F.col("x")), x='---\ndoc_type: EXAM_CQ\nGrade: "৮"\ngrade: ৯\n---\nলেখা')
    assert front["fields"] == {"doc_type": "EXAM_CQ", "grade": "৯"} and front["body"] == "লেখা"
    assert one(spark, text.upsert_front(F.col("x"), {"layout": "a4"}), x="---\na: 1\nlayout: b\n---\nz") == "---\na: 1\nlayout: a4\n---\nz"
    assert one(spark, text.page_range(F.col("x"), F.lit(6)), x="১-3, 5,3,9-4") == [1, 2, 3, 4, 5, 6]
    assert one(spark, text.figures(F.col("x")), x="[[FIG:p=2;box=1,2,30,40]] [[FIG:p=1;box=9,9,1,1]]")[0]["page"] == 2
    assert [tuple(t) for t in one(spark, text.tables(F.col("x")), x="| a | b |\n|--|--|\n| 1 | 2 |\n\n| x |")] == [(2, 2), (1, 1)]
    assert tuple(one(spark, text.label_value(F.col("x")), x="**নাম**: রহিম")) == ("নাম", "রহিম")
    assert [f["label"] for f in one(spark, text.leader_fields(F.col("x")), x="নাম ........ পিতা .....")] == ["নাম", "পিতা"]
    assert [tuple(c) for c in one(spark, text.checkboxes(F.col("x")), x="☑ হ্যাঁ ☐ না")] == [(True, "হ্যাঁ"), (False, "না")]
    assert tuple(one(spark, text.audit_note(F.col("x")), x="ক\n\nনোট: দেখুন")) == ("ক", "নোট: দেখুন")
    age = one(spark, calc.age(F.lit("2000-03-31").cast("date"), F.lit("2024-03-30").cast("date")))
    assert tuple(age) == (23, 11, 30)
    assert one(spark, calc.eligible(F.lit("1992-01-01").cast("date"), F.lit("2024-01-01").cast("date"))) is True
    assert one(spark, text.wrapped_lines(F.col("x"), F.lit(10.0), F.lit(60.0), {"[a-z]": 0.5}), x="aaaa bbbb cccc") == 2
    assert one(spark, text.options_grid(F.array(F.lit(20.0), F.lit(90.0)), F.lit(240.0))) == 2


#: Unicode and legacy pairs over conjuncts, signs before and after, reph and chandrabindu.
PAIRS = [("আমি", "Avwg"), ("বাংলা", "evsjv"), ("শিক্ষা", "wk¶v"), ("কর্ম", "Kg©"), ("চাঁদ", "Pvu`"), ("প্রশ্ন", "cÖkœ"), ("দেশে", "†`‡k"), ("কোথায়", "†Kv_vq"), ("বিদ্যালয়", "we`¨vjq"), ("স্কুল", "¯‹zj"), ("১২৩।", "123|")]


@pytest.mark.parametrize(("u", "legacy"), PAIRS)
def test_transcoding(u, legacy):
    if u != "স্কুল":
        assert transcode.to_legacy_text(u) == legacy
    assert transcode.from_legacy_text(legacy) == transcode.normal(u)


def test_transcoding_round_trip(spark):
    words = [a + v + b for a in ("ক", "ত্র", "ক্ষ", "ন্ত", "স্ব", "জ্ঞ", "ম্প") for v in ("", "া", "ি", "ী", "ে", "ো", "ৌ") for b in ("ন", "র্ম", "")]
    rows = spark.createDataFrame([(w,) for w in words] + [(None,)], "u string")
    got = rows.select("u", transcode.from_legacy(transcode.to_legacy("u")).alias("v")).collect()
    assert all(r.u == r.v for r in got)
    kept = "দেখ $x^2$ ও https://a.b/c"
    assert "$x^2$" in transcode.to_legacy_text(kept) and "https://a.b/c" in transcode.to_legacy_text(kept)
    assert transcode.from_legacy_text("The cat is on the mat.") == "The cat is on the mat."


def test_maths():
    assert [s["type"] for s in maths.segments("যদি $x^2$ হয় \\(y\\) তবে")] == ["text", "math", "text", "math", "text"]
    assert maths.segments("$a$ = $b$") == [{"type": "math", "value": "a = b"}]
    assert maths.omml("\\frac{1}{2}") == "<m:oMath><m:f><m:num><m:r><m:t>1</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f></m:oMath>"
    assert "<m:sSubSup>" in maths.omml("x_1^2") and "<m:rad>" in maths.omml("\\sqrt[3]{x}")
    assert maths.eq_field("\\frac{a}{\\sqrt{b}}") == "EQ \\f(a,\\r(,b))"
    assert maths.readable("\\frac{1}{2} \\times x") == "1/2 × x"
    assert maths.unicode_to_latex("x² + H₂") == "$x^{2}$ + $H_{2}$"
    assert maths.heal("3.0 x 10^8 এবং H2O") == "$3.0 \\times 10^{8}$ এবং $H_{2}O$"
    text_, held = maths.shield("ক $a$ খ $$b$$")
    assert maths.unshield(text_, held) == "ক $a$ খ $$b$$" and len(held) == 2


PAPER = """আদর্শ উচ্চ বিদ্যালয়
বার্ষিক পরীক্ষা ২০২৪
শ্রেণি: অষ্টম বিষয়: বিজ্ঞান
সময়: ২ ঘণ্টা  পূর্ণমান: ৫০
ক-বিভাগ (সৃজনশীল প্রশ্ন)
[উদ্দীপক ১]
রহিম একটি গাছ লাগাল।
১। গাছটি দেখে উত্তর দাও।
ক. গাছ কী? ১
খ. বর্ণনা কর। ২
অথবা
গ. ব্যাখ্যা কর [৩]
খ-বিভাগ (বহুনির্বাচনি)
২। পানির সংকেত কোনটি?
ক) H2O    খ) CO2
গ) O2    ঘ) N2
"""


def test_paper(spark):
    got = spark.createDataFrame([(PAPER,), (None,), ("",)], "t string").select(papers.parse_paper("t").alias("p")).collect()
    p = got[0]["p"]
    assert p["error"] is None and p["header"]["institute"] == "আদর্শ উচ্চ বিদ্যালয়" and p["header"]["time"] == "২ ঘণ্টা" and p["header"]["marks"] == "৫০"
    assert [s["title"][:1] for s in p["sections"]] == ["ক", "খ"]
    q = p["sections"][0]["questions"][0]
    assert q["num"] == "১" and "গাছ লাগাল" in q["stimulus"]
    assert [(s["label"], s["mark"], s["isAlternative"]) for s in q["subQuestions"]] == [("ক", "১", False), ("খ", "২", False), ("", "", True), ("গ", "৩", False)]
    assert [o["label"] for o in p["sections"][1]["questions"][0]["options"]] == ["ক", "খ", "গ", "ঘ"]
    assert got[1]["p"] is None and got[2]["p"]["sections"] == []


def test_choice_papers():
    p = papers.paper("---\ndoc_type: EXAM_MCQ\n---\n১. কোনটি?\nক. এক\nখ. দুই\nদীর্ঘ\nগ. তিন\nঘ. চার\n২. সাধারণ লেখা\nআরও লেখা")
    a, b = p["sections"][0]["questions"]
    assert p["error"] is None and [o["text"] for o in a["options"]] == ["এক", "দুই দীর্ঘ", "তিন", "চার"] and b["text"] == "সাধারণ লেখা\nআরও লেখা"
    q = papers.paper("১. কোনটি সঠিক?\nক. এক\nখ. দুই\nগ. তিন\nঘ. চার")["sections"][0]["questions"][0]
    assert len(q["options"]) == 4 and not q["subQuestions"]


def test_small_parsers():
    assert papers.options("ক) $x)$ খ) y") == [{"label": "ক", "text": "$x)$"}, {"label": "খ", "text": "y"}]
    assert papers.sub_parts("ক. এক ১\tখ. দুই ২") == [{"label": "ক", "text": "এক", "mark": "১"}, {"label": "খ", "text": "দুই", "mark": "২"}]
    assert papers.mark_tail("গ. সা. গু.") == ("গ. সা. গু.", "")
    tags = papers.layout_tags("[[B:t=title;p=2;box=1,2,3,4]]শিরোনাম\n[[B:t=paragraph]]লেখা")
    assert [(t["page"], t["type"], t["box"]) for t in tags] == [(2, "title", [1.0, 2.0, 3.0, 4.0]), (2, "paragraph", None)]
    assert papers.continued("[[B:t=p;p=1]]এক দুই", "[[B:t=p;p=1]]এক দুই তিন") == "\n[[B:t=p;p=1]]এক দুই তিন"
    assert papers.rebreak(["aa", "bb", "cc", "dd"], [2, 2, 2, 2], 2) == ["aa bb", "cc dd"]
    assert papers.numbered_figures("[[FIG:p=1;box=1]] x [[FIG:p=2;box=2]]") == "[[FIGURE-1]] x [[FIGURE-2]]"
    assert papers.placed_figures("১.\n[[FIG:a]]\n\nলেখা") == "১. লেখা [[FIG:a]]"
    assert papers.split_combined("১। ক\nবহুনির্বাচনি প্রশ্ন\n২। খ") == {"cq": "১। ক", "mcq": "বহুনির্বাচনি প্রশ্ন\n২। খ"}
    assert papers.nested("১। এক\n(১) ক\nক) x")[0]["items"][0]["letters"] == [{"label": "ক", "text": "x"}]
    assert papers.edited({"a": [{"b": "x"}]}, [("a.0.b", "y"), ("a.5.b", "z")]) == {"a": [{"b": "y"}]}
    assert papers.document("# ক\n| a | b |\n|--|--|\n| c |")[1]["rows"] == [["a", "b"], ["c", ""]]
    assert papers.clean_response("```md\nক\n\n\n\nখ\n```") == "ক\n\nখ"
    assert forms.routine("বার | ১ম | ২য়\nরবি: বাংলা | গণিত") == {"headers": ["বার", "১ম", "২য়"], "rows": [["রবি", "বাংলা", "গণিত"]]}
    memo = forms.parse("CASH_MEMO", "মেসার্স রহিম\nঢাকা\nনং: ৫  তারিখ: ১/১/২৪\n| পণ্য | দর |\n|--|--|\n| চাল | ৫০ |\nমোট: ৫০")
    assert memo["fields"]["number"] == "৫" and memo["fields"]["total"] == "৫০" and memo["tables"] == [[["পণ্য", "দর"], ["চাল", "৫০"]]]
    assert forms.parse("ADMIT_CARD", "নাম: করিম")["missing"] == "roll"


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (PAPER, "EXAM_CQ"), ("---\ndoc_type: CV\n---\nনাম: ক", "CV_RESUME"), ("বরাবর,\nপ্রধান শিক্ষক\nবিষয়: ছুটি\nজনাব, বিনীত নিবেদন এই যে", "GOVT_APP"), ("ক্যাশ মেমো\nক্রেতার স্বাক্ষর বিক্রেতার স্বাক্ষর", "CASH_MEMO"),
        ("বেতন স্লিপ\nমূল বেতন: ১০০", "SALARY_SLIP"), ("প্রবেশপত্র\nনাম", "ADMIT_CARD"), ("কিছু সাধারণ লেখা", "GENERAL"), ("", "GENERAL"), (None, "GENERAL"), ("---\ndoc_type: EXAM_COMBINED\n---\nলেখা", "EXAM_GENERAL"),
        ("হলফনামা\nআমি", "STAMP_DEED"), ("ক্লাস রুটিন\n| বার | ১ম |", "ROUTINE"), ("এই মর্মে প্রত্যয়ন করা যাচ্ছে যে", "PROTTOYON"),
    ],
)
def test_classify(spark, given, want):
    assert classify.classify(spark.createDataFrame([(1, given)], "doc_id long, text string")).first()["doc_type"] == want


def test_metadata(spark):
    m = one(spark, classify.metadata(F.col("x")), x=PAPER)
    assert (m["institute"], m["time"], m["marks"]) == ("আদর্শ উচ্চ বিদ্যালয়", "২ ঘণ্টা", "৫০")
    w = one(spark, classify.winner(F.from_json(F.col("x"), "array<struct<type:string,score:int>>")), x='[{"type":"EXAM_CQ","score":30},{"type":"CV_RESUME","score":33}]')
    assert tuple(w) == ("EXAM_CQ", 30)


def plain_type(t):
    """The rules of ``classify`` without its columns: (type, score)."""
    t = (t or "").replace("\u09a1\u09bc", "\u09dc").replace("\u09a2\u09bc", "\u09dd").replace("\u09af\u09bc", "\u09df").strip(" ")
    front = re.match(r"---\n(.*?)\n---", t, re.S)
    named = dict(x.split(": ", 1) for x in front[1].split("\n")).get("doc_type", "").strip().upper() if front else ""
    known = next((k for k, names in classify.NAMES.items() if named in names), None)
    blocks = []
    for x in re.split(r"\r?\n", t):
        number = re.search(r"^\s*(?:#{1,6}\s*)?(?:প্রশ্ন\s*(?:নং)?[\s\-:ঃ.]*)?\(?[0-9০-৯]{1,3}\s*[।.)]", x, re.A)
        if number or re.search(r"^\s*#{1,6}\s", x, re.A):
            blocks.append([])
        if blocks:
            p = re.search(r"^\s*\(?\s*([কখগঘ])\s*[.)।]\s*(.+)$", x, re.A)
            body = p[2].strip(" ") if p else ""
            marked = bool(len(body) >= 10 and re.search(r"(?:\s|\[|\()[1-4১-৪]\s*[\])]?\s*$", body, re.A))
            task = bool(p) and bool(re.search(r"(?:করো|কর|দাও|লিখ|নির্ণয়|ব্যাখ্যা|বর্ণনা|প্রমাণ|হিসাব)\s*[।.]?\s*$", body, re.A) or re.search(r"\[[^\]]*\]", x))
            blocks[-1].append((bool(number), p and p[1], marked, task, bool(re.search(r"\$[^$\n]+\$|\\(?:frac|sqrt|int|sum|theta|pi|begin)\b", x, re.A))))
    numbered = sum(any(r[0] for r in b) for b in blocks)
    creative_blocks = [len({r[1] for r in b if r[1]}) >= 3 and sum(r[2] for r in b) >= 2 for b in blocks]
    mcq = sum(not c and sum(bool(r[1]) for r in b) >= 2 and not any(r[3] for r in b) and any(r[0] for r in b) for b, c in zip(blocks, creative_blocks, strict=True))
    maths = sum(any(r[0] for r in b) and any(r[4] for r in b) for b in blocks)
    has = lambda p: re.search(p, t, re.A) is not None
    special = {k: sum(n for n, need, never in each if all(map(has, need)) and not any(map(has, never))) for k, each in classify.RULES.items()}
    highest = max(special.values())
    creative, strict, broken = has(classify.CREATIVE), mcq >= 5 and mcq >= 0.85 * numbered, has(r"(?i)---\s*SECTION_BREAK|\[LAYOUT:\s*COMBINED")
    general = highest < 4 and not creative and not strict
    exam = has("শ্রেণি|সময়|পূর্ণমান") and has("পরীক্ষা|বিষয়")
    score = {"EXAM_MATH": 30 * (numbered >= 3 and maths >= 0.5 * numbered), "EXAM_COMBINED": 50 * (broken or (creative and strict)), "EXAM_CQ": 30 * creative, "EXAM_MCQ": 35 * (not creative and strict)}
    score["EXAM_GENERAL"] = 25 if general and (exam or numbered >= 2) else 15 if general and (has("শ্রেণি|বিষয়|সময়|পূর্ণমান|পরীক্ষা") or numbered > 0) else 0
    order = sorted((score | special).items(), key=lambda x: -x[1])
    top = order[1] if order[0][1] > 0 and order[0][1] - order[1][1] < 4 and order[1][0] == "EXAM_CQ" else order[0]
    if known:
        return ("EXAM_COMBINED" if broken else "EXAM_GENERAL" if known == "EXAM_COMBINED" and not any(creative_blocks) else known), None
    return (top[0] if top[1] >= 4 else "GENERAL"), top[1]


#: One text or more for each type, and texts on which several rules fire.
KINDS = [
    PAPER, "---\ndoc_type: CV\n---\nনাম: ক", "বরাবর,\nপ্রধান শিক্ষক\nবিষয়: ছুটি\nজনাব, বিনীত নিবেদন এই যে", "ক্যাশ মেমো\nক্রেতার স্বাক্ষর বিক্রেতার স্বাক্ষর", "বেতন স্লিপ\nমূল বেতন: ১০০", "প্রবেশপত্র\nনাম", "হলফনামা\nআমি",
    "ক্লাস রুটিন\n| বার | ১ম |", "এই মর্মে প্রত্যয়ন করা যাচ্ছে যে", "বিজ্ঞপ্তি\nসকলের জ্ঞাতার্থে", "মেসার্স রহিম\nমোবাইলঃ ০১", "CURRICULUM VITAE\nREFERENCE", "My resume, with a reference to a voucher", "1. one\n2. two", "# a heading\n1) $x$\n2) $y$\n3) $z$",
    "\n".join(f"{i}. কোনটি?\nক) এক\nখ) দুই\nগ) তিন" for i in range(1, 7)), "উদ্দীপক\n" + "\n".join(f"{i}. কোনটি?\nক) এক\nখ) দুই" for i in range(1, 7)), "বিষয়: গণিত\nশ্রেণি: ৫ম", "--- SECTION_BREAK\nক", "বিজ্ঞপ্তি\nভাউচার নং ৫, বরাবর, বিষয়: x", None, "", "plain words",
]


def test_classify_documents_is_whole(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    own = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(KINDS)], "doc_id long, text string")
    docs.unionByName(own).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    got = {r.doc_id: (r.doc_type, r.score) for r in catalogue.QUERIES["classify_documents"](spark, str(tmp_path)).collect()}
    want = {d: plain_type(t) for d, t in rows.items()}
    assert {d: (got.get(d), w, (rows[d] or "")[:60]) for d, w in want.items() if got.get(d) != w} == {} and len(got) == len(want)
    assert len({k for k, _ in want.values()}) >= 14


def test_legacy_texts_are_whole(spark, tmp_path):
    known = [(u, b) for u, b in PAIRS if u != "স্কুল"]
    mixed = [(" $x^2$ ".join(p[k] for p in known) + "\n" + " ".join(p[k] for p in reversed(known))) for k in (0, 1)]
    rows = [(1, mixed[0]), (2, "The cat is on the mat.\nhttps://a.b/c"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.legacy, r.text) for r in catalogue.QUERIES["legacy_texts"](spark, str(tmp_path)).collect()}
    assert got == {1: (mixed[1], transcode.normal(mixed[0])), 2: (rows[1][1], rows[1][1]), 3: (None, None), 4: ("", "")}
