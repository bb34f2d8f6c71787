"""Operators over single texts on small inputs written here beside the rows that must come out.

Every query gives (id, out): the number of the input, from 1, and the result as text, nested results as JSON. The rows
that must come out are stated by hand in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import calc, text
from docloom.operators import documents, relational, windows
from docloom.parse import forms, maths, papers, transcode
from docloom.plans import classify

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def values(expected: list[tuple[int, str | None]]) -> str:
    """(id, out) as SQL."""
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return "SELECT CAST(id AS BIGINT) AS id, CAST(o AS VARCHAR) AS out FROM (VALUES " + ", ".join(f"({i}, {quoted(o)})" for i, o in expected) + ") AS t(id, o)"


def whole(x: str | None) -> str | None:
    """Letters with a separate nukta as single ones, as parsers give them."""
    for base, one in (("\u09af", "\u09df"), ("\u09a1", "\u09dc"), ("\u09a2", "\u09dd")):
        x = x and x.replace(base + "\u09bc", one)
    return x


def shown(c: Column, kind: str) -> Column:
    return F.to_json(c) if kind.startswith(("array", "struct", "map")) else c.cast("string")


def frame(name: str, expected: list[tuple[int, str | None]]):
    """Registers a function of a session that gives (id, out)."""

    def add(f: Callable[[SparkSession], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark)
            kinds = dict(df.dtypes)
            return df.select(F.col("id").cast("long").alias("id"), shown(F.col("out"), kinds["out"]).alias("out"))

        QUERIES[name], SQL[name] = run, values(expected)
        return f

    return add


def scalar(name: str, schema: str, cases: list[tuple], f: Callable[..., Column], composed: bool = False) -> None:
    """A column function on one row per case: (inputs ..., expected); ``composed``: it gives letters with a nukta as single ones."""
    names = [c.split()[0] for c in schema.split(", ")]

    @frame(name, [(i, whole(c[-1]) if composed else c[-1]) for i, c in enumerate(cases, 1)])
    def run(spark: SparkSession) -> DataFrame:
        rows = [(i, *c[:-1]) for i, c in enumerate(cases, 1)]
        return spark.createDataFrame(rows, f"id int, {schema}").select("id", f(*(F.col(n) for n in names)).alias("out"))


# --- predicates and cleaning -------------------------------------------------------------------------------

scalar("has_bengali", "t string", [("abc", "false"), ("a ক", "true"), ("end।", "true"), (None, "false")], text.has_bengali)
scalar("compose_nukta", "t string", [("য়", "য়"), ("বড়", "বড়"), ("ঢ়", "ঢ়"), ("ক", "ক")], text.compose_nukta)
scalar("lone_vowel_signs", "t string", [("া কলম", " কলম"), ("কি (ি) কা", "কি () কা"), ("কলম", "কলম")], text.drop_lone_signs)
scalar("digit_scripts", "t string", [("১২a", "12a"), ("12", "12"), ("", "")], lambda t: text.digits(t, "english"))
scalar("ascii_digits", "t string", [("০১২৩৪৫৬৭৮৯", "0123456789"), ("ক৫", "ক5")], calc.to_ascii_digits)
scalar("ocr_artifacts", "t string", [("ক\n--- Page 2 ---\nখ", "ক\n\nখ"), ("[পৃষ্ঠা ৩]\nগ\n\n\n\nঘ", "গ\n\nঘ"), ("ক <!-- MANIFEST\n x --> খ", "ক  খ")], text.strip_artifacts)
scalar("frontmatter_upsert", "t string", [("---\na: 1\ntitle: x\n---\nbody", "---\ntitle: x\na: 2\n---\nbody"), ("body", "---\na: 2\n---\nbody")], lambda t: text.upsert_front(t, {"a": "2"}))
scalar("stray_frontmatter", "t string", [("এক\n---\ndoc_type: X\ngrade: 5\n---\nদুই", "এক\nদুই"), ("এক\n---\nদুই", "এক\n---\nদুই")], text.strip_stray_front)
scalar("roman_labels", "t string", [("lll. গ", "iii. গ"), ("ll) খ", "ii. খ"), ("l. ক\nll. খ", "i. ক\nii. খ"), ("llama", "llama")], text.roman)
scalar("time_and_marks", "t string", [("সময়: ২ ঘণ্টা  পূর্ণমান: ১০০", '{"time":"২ ঘণ্টা","marks":"১০০"}'), ("মান- ৫০", '{"time":"","marks":"৫০"}'), ("কিছু নেই", '{"time":"","marks":""}')], text.time_and_marks)
scalar("difficulty_tags", "t string", [("প্রশ্ন [সহজ] এক (Hard)", "প্রশ্ন এক"), ("ক  খ [কঠিন]", "ক খ")], text.difficulty_free)
scalar("question_numbers", "t string", [("১) কী", "১. কী"), ("(২) কী", "২. কী"), ("৩। কী", "৩. কী"), ("কী", "কী")], text.number_prefix)
scalar("part_labels", "t string", [("(ক) এক", "ক. এক"), ("খ) দুই", "খ. দুই"), ("ঙ) না", "ঙ) না")], text.sub_prefix)
scalar("option_tabs", "t string", [("ক) এক খ) দুই গ. তিন", "ক. এক\tখ. দুই\tগ. তিন")], text.option_tabs)
scalar("english_question", "t string", [("1. What is it", "true"), ("a) Yes or no", "true"), ("১. কী", "false"), ("What", "false")], text.is_english_question)
scalar("question_paper_lines", "t string", [("১) কী?\nক) এক খ) দুই\n1. What is it?", "১. কী?\nক. এক\tখ. দুই\n1. What is it?")], text.question_paper)
scalar("reaction_arrows", "t string", [("A \\rightarrow B \\to C", "A → B → C"), ("N \\rightleftharpoons M", "N ⇌ M"), ("\\total", "\\total")], text.arrows)
scalar("degree_signs", "t string", [("90^\\circ", "90°"), ("30^{\\circ}C", "30°C"), ("x^2", "x^2")], text.degrees)
scalar("latex_symbols", "t string", [("\\alpha + \\leq", "α + ≤"), ("\\theta\\times\\pi", "θ×π"), ("\\alphabet", "\\alphabet")], text.latex_symbols)
scalar("latex_aliases", "t string", [("\\dfrac{1}{2}", "\\frac{1}{2}"), ("\\left( x \\right)", "( x )"), ("\\displaystyle x", "x")], text.latex_aliases)
scalar("needs_structure", "t string", [("\\frac{1}{2}", "true"), ("x+1", "false"), ("x^{12}", "true"), ("x^2", "false")], text.needs_structure)
scalar("figure_tags", "t string", [("[[FIG:p=2;box=10,20,300,400]] ক [[FIG:p=1;box=5,5,1,9]]", '[{"page":2,"box":[10.0,20.0,300.0,400.0]}]'), ("[[FIG:p=1;box=1,2,3]]", "[]"), ("[[FIG:p=1;box=0,0,1001,9]]", "[]")], text.figures)
scalar("role_tags", "t string", [("ক <!-- role:title key=a --> খ <!--role:rule-->", '[{"role":"title","key":"a"},{"role":"rule"}]'), ("ক", "[]")], text.roles)
scalar("role_tags_stripped", "t string", [("ক <!-- role:title key=a -->খ", "ক খ")], text.without_roles)
scalar("leader_fields", "t string", [("নাম ........ পিতা ......", '[{"label":"নাম","width":8},{"label":"পিতা","width":6}]'), ("নাম: ___", '[{"label":"নাম","width":3}]'), ("নাম", "[]")], text.leader_fields)
scalar("checkbox_items", "t string", [("☐ হ্যাঁ ☑ না", '[{"checked":false,"label":"হ্যাঁ"},{"checked":true,"label":"না"}]')], text.checkboxes)
scalar("pipe_cells", "t string", [("| a | $x|y$ | b |", '["a","$x|y$","b"]'), ("a|b", '["a","b"]')], text.cells)
scalar("table_shapes", "t string", [("| a | b |\n|---|---|\n| 1 | 2 |\nx\n| q |", '[{"rows":2,"cols":2},{"rows":1,"cols":1}]'), ("x", "[]")], text.tables)
scalar("total_lines", "t string", [("**সর্বমোট: ১,২০০.৫০ টাকা", '{"label":"সর্বমোট","value":"১,২০০.৫০"}'), ("Total = 45", '{"label":"Total","value":"45"}'), ("নাম: ৫", '{"label":"","value":""}')], text.total_line)
scalar("audit_notes", "t string", [("ক\nখ\nনোট: দেখুন\nআরও", '{"body":"ক\\nখ","note":"নোট: দেখুন\\nআরও"}'), ("ক", '{"body":"ক","note":""}')], text.audit_note)
scalar("nested_papers", "t string", [("(১) ক\n(২) খ", "true"), ("(১) ক", "false"), ("ঙ) ক\nচ) খ", "true"), ("ক) ক\nখ) খ", "false")], text.nested_paper)
scalar("queue_ranges", "page int, spec string", [(2, "1-3", "true"), (4, "1-3", "false"), (5, "৫", "true"), (9, "7–9", "true")], lambda p, s: F.array_contains(text.page_range(s, F.lit(9)), p))
scalar("text_widths", "t string, size double", [("aaB", 10.0, "17.0"), ("", 10.0, "0.0"), ("?", 10.0, "5.5")], lambda t, s: F.round(text.text_width(t, s, {"[a-z]": 0.5, "[A-Z]": 0.7}), 6))
scalar("wrapped_lines", "t string, width double", [("aa aa aa", 25.0, "2"), ("aa", 5.0, "1"), ("", 5.0, "1"), ("aa aa aa", 9.0, "3")], lambda t, w: text.wrapped_lines(t, F.lit(10.0), w, {"[a-z]": 0.5}))
scalar("legacy_detector", "t string, font string", [("Avwg", "SutonnyMJ", "true"), ("আমি", None, "false"), ("plain", None, "false"), ("Ö×Ø", None, "true")], text.is_legacy)
scalar("english_detector", "t string, font string", [("Hello world", None, "true"), ("আমি", "Times", "false"), ("x", "Arial", "true"), ("12", None, "false")], text.is_english)
scalar("plain_markdown", "t string", [("# শিরোনাম\n**মোটা** *বাঁকা*\n- এক", "শিরোনাম\nমোটা বাঁকা\n• এক"), ("| a |\n|---|\n| b |", "| a |\n| b |")], text.plain_markdown)
scalar("normal_words", "t string", [("“কলম”,", "কলম"), ("(a-b)!", "a-b"), ("é", "é"), ("...", "")], maths.normal_word)
scalar("bengali_style", "nums array<string>, texts array<string>", [(["১", "2"], [""], "true"), (["1", "2"], ["ক"], "false"), ([], ["What is the capital of it"], "false"), ([], ["কী", "What"], "true"), ([], ["one"], "true")], text.bengali_style)
scalar("paper_headers", "t string", [
    ("---\ninstitute: ক\ngrade: ৫\nsubject: বাংলা\nfull_marks: ১০০\n---\n", '{"institute":"ক","location":"","exam":"","classAndSubject":"শ্রেণি: ৫  |  বিষয়: বাংলা","time":"","marks":"১০০"}'),
    ("---\nschool: S\nclass: 9\nsubject: Physics\nduration: 2h\naddress: D\nexam_name: T\n---\n", '{"institute":"S","location":"D","exam":"T","classAndSubject":"Class: 9  |  Subject: Physics","time":"2h","marks":""}'),
    ("x", '{"institute":"","location":"","exam":"","classAndSubject":"","time":"","marks":""}'),
], lambda t: text.paper_header(text.front(t)["fields"]))

# --- calculators -----------------------------------------------------------------------------------------

scalar("ramp_scores", "v double", [(0.5, "1.0"), (1.0, "1.0"), (2.0, "0.5"), (3.0, "0.0"), (5.0, "0.0")], lambda v: calc.ramp(v, 1.0, 3.0))
scalar("box_pixels", "box array<double>, w int, h int", [([100.0, 200.0, 500.0, 600.0], 1000, 2000, '{"x":200,"y":200,"w":400,"h":800}'), ([0.0, 0.0, 1000.0, 1000.0], 10, 20, '{"x":0,"y":0,"w":10,"h":20}')], calc.box_to_pixels)
scalar("physical_sizes", "crop double, page double", [(500.0, 1000.0, "4.0"), (100.0, 1000.0, "0.827")], lambda c, p: F.round(calc.physical_inches(c, p, 8.27, 4.0), 6))
scalar("projected_points", "x double, y double", [(1.0, 1.0, '{"x":3.0,"y":4.0}'), (0.0, 0.0, '{"x":2.0,"y":3.0}')], lambda x, y: calc.project([1, 0, 2, 0, 1, 3, 0, 0, 1], x, y))


@frame("calendar_ages", [(1, '{"years":24,"months":0,"days":1}'), (2, '{"years":18,"months":0,"days":0}'), (3, '{"years":17,"months":11,"days":30}'), (4, '{"years":0,"months":1,"days":1}')])
def _(spark):
    rows = [(1, "2000-02-29", "2024-03-01"), (2, "2000-01-15", "2018-01-15"), (3, "2000-01-16", "2018-01-15"), (4, "2024-01-31", "2024-03-01")]
    return spark.createDataFrame(rows, "id int, a string, b string").select("id", calc.age(F.to_date("a"), F.to_date("b")).alias("out"))


@frame("age_limits", [(1, "true"), (2, "false"), (3, "true"), (4, "false")])
def _(spark):
    rows = [(1, "2000-01-15"), (2, "2000-01-16"), (3, "1986-01-15"), (4, "1986-01-14")]
    return spark.createDataFrame(rows, "id int, a string").select("id", calc.eligible(F.to_date("a"), F.lit("2018-01-15").cast("date")).alias("out"))


# --- papers ----------------------------------------------------------------------------------------------

scalar("choice_options", "t string", [("ক) এক খ) $ক) x$ গ) তিন", '[{"label":"ক","text":"এক"},{"label":"খ","text":"$ক) x$"},{"label":"গ","text":"তিন"}]'), ("কিছু নয়", "[]")], papers.parse_options)
scalar("creative_parts", "t string", [("ক. কী? ১  খ. কেন? ২", '[{"label":"ক","text":"কী?","mark":"১"},{"label":"খ","text":"কেন?","mark":"২"}]'), ("ক. গ. সা. গু. কী?", '[{"label":"ক","text":"গ. সা. গু. কী?","mark":""}]'), ("খাতা ক. না", "[]")], papers.parse_sub_parts)
scalar("stated_marks", "t string", [("কী বলে? ৩", '{"text":"কী বলে?","mark":"৩"}'), ("কী বলে? [4]", '{"text":"কী বলে?","mark":"4"}'), ("কী বলে? (মান: ৫)", '{"text":"কী বলে?","mark":"৫"}'), ("কী বলে? ২ নম্বর", '{"text":"কী বলে?","mark":"২"}'), ("৭", '{"text":"৭","mark":""}'), ("কী বলে?", '{"text":"কী বলে?","mark":""}')], papers.parse_mark)
_PAPER = "আদর্শ বিদ্যালয়\nবার্ষিক পরীক্ষা\nসময়: ২ ঘণ্টা পূর্ণমান: ৫০\n## ক বিভাগ সৃজনশীল প্রশ্ন\n১. নিচের উদ্দীপক পড়।\nক. পানি কী? ১\nখ. বায়ু কেন লাগে বল। ২\nগ. মাটি ব্যাখ্যা কর। ৩\n## বহুনির্বাচনি\n১. রং কোনটি?\nক) লাল খ) জল গ) বল ঘ) কল"
scalar("exam_headers", "t string", [(_PAPER, "আদর্শ বিদ্যালয়|বার্ষিক পরীক্ষা|২ ঘণ্টা|৫০"), ("১. কী?", "|||")], lambda t: F.concat_ws("|", *(papers.parse_paper(t)["header"][c] for c in ("institute", "exam", "time", "marks"))), composed=True)
scalar("exam_sections", "t string", [(_PAPER, "ক বিভাগ সৃজনশীল প্রশ্ন:১:3:0;বহুনির্বাচনি:১:0:4"), ("", "")], lambda t: F.array_join(F.transform(papers.parse_paper(t)["sections"], lambda s: F.concat_ws(":", s["title"], F.array_join(F.transform(s["questions"], lambda q: F.concat_ws(":", q["num"], F.size(q["subQuestions"]).cast("string"), F.size(q["options"]).cast("string"))), ","))), ";"), composed=True)
scalar("exam_part_marks", "t string", [(_PAPER, "ক:পানি কী?:১|খ:বায়ু কেন লাগে বল।:২|গ:মাটি ব্যাখ্যা কর।:৩")], lambda t: F.array_join(F.transform(papers.parse_paper(t)["sections"][0]["questions"][0]["subQuestions"], lambda p: F.concat_ws(":", p["label"], p["text"], p["mark"])), "|"), composed=True)
scalar("exam_stimuli", "t string", [("[উদ্দীপক ২] করিম বাজারে যায়।\n২. সে কেন যায়?\nক. কী? ১", "২|উদ্দীপক ২\nকরিম বাজারে যায়।|সে কেন যায়?")], lambda t: F.concat_ws("|", *(papers.parse_paper(t)["sections"][0]["questions"][0][c] for c in ("num", "stimulus", "text"))), composed=True)
_PARTS = lambda t: F.array_join(F.flatten(F.transform(papers.parse_paper(t)["sections"], lambda s: F.transform(s["questions"], lambda q: F.concat(q["num"], F.lit(":"), F.array_join(F.transform(q["subQuestions"], lambda p: F.concat(p["label"], F.lit("="), p["mark"])), ","))))), "|")
scalar("exam_abbreviations", "t string", [
    ("সময়: ১ ঘণ্টা\n## প্রশ্ন ১২। চাল বিক্রি হলো।\n\tক. সূত্র লেখো।\t২\n\tখ. কত টাকা?\t৮\n## প্রশ্ন ০৭। ব্যাংকে জমা।\n\tক. $A$ ও $B$ এর গ. সা. গু. নির্ণয় করো।\t১০", "১২:ক=২,খ=৮|০৭:ক=১০"),
    ("১. কী?\nক. এক\nখ. দুই\nগ. তিন\nঘ. চার\nঙ. পাঁচ", "১:ক=,খ=,গ=,ঘ=,ঙ="),
    ("১. ক. এক কী? ১\n১. খ. দুই কেন? ২", "১:ক=১,খ=২"),
    ("১. What is it?\n(a) one way to say 2\n(b) two ways to say 3", "১:a=2,b=3"),
], _PARTS)
scalar("exam_stimulus_lines", "t string", [
    ("উদ্দীপক: ১\nকরিম যায়।\n১. কেন?\nক. বল ১", ":১:উদ্দীপক ১\nকরিম যায়।"),
    ("[উদ্দীপক ১] করিম\n## খ বিভাগ মান: ২০\n১. কী?\nক. বল ১", "খ বিভাগ২০:১:উদ্দীপক ১\nকরিম"),
    ("১. নিচের উদ্দীপকটি পড়ে উত্তর দাও।\n(ক) কী বলে বলো? ১", ":১:নিচের উদ্দীপকটি পড়ে উত্তর দাও।"),
    ("## ক বিভাগ\n১. এক?\n## ক বিভাগ\n২. দুই?", "ক বিভাগ:১:|ক বিভাগ:২:"),
], lambda t: F.array_join(F.flatten(F.transform(papers.parse_paper(t)["sections"], lambda s: F.transform(s["questions"], lambda q: F.concat(s["title"], s["marks"], F.lit(":"), q["num"], F.lit(":"), q["stimulus"])))), "|"), composed=True)
scalar("exam_alternatives", "t string", [("১. কী?\nক. এক বল। ২\nঅথবা\nখ. দুই বল। ২", "ক:false,:true,খ:false")], lambda t: F.array_join(F.transform(papers.parse_paper(t)["sections"][0]["questions"][0]["subQuestions"], lambda p: F.concat_ws(":", p["label"], p["isAlternative"].cast("string"))), ","))
scalar("exam_statements", "t string", [("১. কোনটি ঠিক?\ni. এক\nii. দুই\nক) i খ) ii গ) i ও ii ঘ) নেই", '["i. এক","ii. দুই"]')], lambda t: papers.parse_paper(t)["sections"][0]["questions"][0]["statements"])
scalar("combined_papers", "t string", [("১. কী?\n## বহুনির্বাচনি\n১. না?", '{"cq":"১. কী?","mcq":"## বহুনির্বাচনি\\n১. না?"}'), ("১. কী?\n---SECTION_BREAK:MCQ---\n২. না?", '{"cq":"১. কী?","mcq":"২. না?"}'), ("১. কী?", '{"cq":"১. কী?"}')], papers.parse_combined)
scalar("primary_papers", "t string", [("১. বল\n(১) এক\n(ক) আম\n(২) দুই", '[{"num":"১","text":"বল","items":[{"label":"১","text":"এক","letters":[{"label":"ক","text":"আম"}]},{"label":"২","text":"দুই","letters":[]}]}]')], papers.parse_nested)
scalar("markdown_blocks", "t string", [("# এক\nকথা\nআরও\n\n- ক\n- খ\n| a | b |\n|---|---|\n| 1 | 2 |", '[{"type":"heading","level":1,"text":"এক","items":[],"rows":[]},{"type":"para","text":"কথা\\nআরও","items":[],"rows":[]},{"type":"list","text":"","items":["ক","খ"],"rows":[]},{"type":"table","text":"","items":[],"rows":[["a","b"],["1","2"]]}]')], papers.parse_blocks)
scalar("document_model", "t string", [("## ক\n| a | b |\n| c |", '[{"idx":0,"role":"title","level":2,"text":"ক","rows":[]},{"idx":1,"role":"table","text":"","rows":[["a","b"],["c",""]]}]')], papers.parse_document)
scalar("draft_parts", "t string", [("নাম: রহিম\nকথা\n# শির", '[{"idx":0,"kind":"kv","key":"নাম","text":"রহিম","rows":[]},{"idx":1,"kind":"para","text":"কথা","rows":[]},{"idx":2,"kind":"heading","text":"শির","rows":[]}]')], papers.parse_parts)
_TAGS = "[[B:t=title;p=2;box=1,2,3,4;al=c;b=1]]শির\n[[B:t=para]]এক\nদুই"
scalar("layout_tags", "t string", [(_TAGS, '[{"page":2,"idx":0,"type":"title","box":[1.0,2.0,3.0,4.0],"align":"c","bold":true,"text":"শির","lines":["শির"]},{"page":2,"idx":1,"type":"para","bold":false,"text":"এক\\nদুই","lines":["এক","দুই"]}]')], papers.parse_tags)
scalar("continued_texts", "a string, b string", [("[[B:t=p;p=1]]এক\n[[B:t=p;p=2]]দুই তিন", "[[B:t=p;p=2]]দুই তিন চার", "[[B:t=p;p=1]]এক\n[[B:t=p;p=2]]দুই তিন চার"), ("[[B:t=p;p=1]]এক", "[[B:t=p;p=2]]এক", "[[B:t=p;p=1]]এক\n[[B:t=p;p=2]]এক")], papers.continue_text)
scalar("figure_markers", "t string", [("ক [[FIG:p=1;box=1,2,3,4]] খ [[FIG:p=1;box=5,6,7,8]]", "ক [[FIGURE-1]] খ [[FIGURE-2]]")], papers.mark_figures)
scalar("figure_placement", "t string", [("১.\n[[FIG:p=1;box=1,2,3,4]]\n\nকী?", "১. কী? [[FIG:p=1;box=1,2,3,4]]"), ("১.\nকী?", "১.\nকী?")], papers.place_figures)
scalar("rich_runs", "t string", [("ক **খ** *গ* $x$", '[{"text":"ক ","bold":false,"italic":false,"math":false},{"text":"খ","bold":true,"italic":false,"math":false},{"text":" ","bold":false,"italic":false,"math":false},{"text":"গ","bold":false,"italic":true,"math":false},{"text":" ","bold":false,"italic":false,"math":false},{"text":"x","bold":false,"italic":false,"math":true}]')], papers.parse_runs)
scalar("ocr_answers", "t string", [("```md\nlll. গ\n\n\n\nশেষ\n```", "iii. গ\n\nশেষ"), ("--- Page 3 ---\nক", "ক")], papers.clean)
scalar("script_tokens", "t string", [("কি ab, ১", '["কি"," ","ab",","," ","১"]')], papers.word_tokens)
scalar("rebroken_lines", "r struct<words:array<string>,widths:array<double>,lines:int>", [((["a", "b", "c", "d"], [1.0, 1.0, 1.0, 1.0], 2), '["a b","c d"]'), ((["long", "b"], [9.0, 1.0], 5), '["long","b"]')], papers.broken_lines)
scalar("path_edits", "r struct<data:string,edits:array<struct<path:string,value:string>>>", [(('{"a": [{"t": "x"}], "b": "y"}', [("a.0.t", "z"), ("a.5.t", "no"), ("b", "w"), ("c", "no")]), '{"a": [{"t": "z"}], "b": "w"}')], papers.edit_json)

# --- transcoding and maths --------------------------------------------------------------------------------

_PAIRS = [("কলম", "Kjg"), ("বই", "eB"), ("বিশ্ব", "wek¦"), ("ক্ষমা", "¶gv"), ("কর্ম", "Kg©"), ("মেয়ে", "†g‡q"), ("কুল", "Kzj"), ("আমি বাংলা", "Avwg evsjv"), ("১২।", "12|"), ("মোম", "†gvg"), ("$x$ বই", "$x$ eB"), ("a@b.com", "a@b.com")]
scalar("legacy_encoding", "t string", [p for p in _PAIRS], transcode.to_legacy)
scalar("legacy_decoding", "t string", [(b, a) for a, b in _PAIRS], transcode.from_legacy, composed=True)
scalar("auto_transcoding", "t string", [("কলম", "Kjg"), ("Kjg", "কলম"), ("the pen of it", "the pen of it")], transcode.auto)
scalar("script_runs", "t string", [("আমি Hello ১২।", '[{"type":"bn","text":"আমি "},{"type":"en","text":"Hello "},{"type":"bn","text":"১২।"}]')], transcode.split_scripts)
scalar("maths_segments", "t string", [("ক $x^2$ খ", '[{"type":"text","value":"ক "},{"type":"math","value":"x^2"},{"type":"text","value":" খ"}]'), ("\\(a\\)", '[{"type":"math","value":"a"}]'), ("$ক x$", '[{"type":"text","value":" ক "},{"type":"math","value":"x"}]')], maths.math_segments)
_RUN = "<m:r><m:t>{}</m:t></m:r>"
scalar("office_maths", "t string", [("\\frac{1}{2}", f"<m:oMath><m:f><m:num>{_RUN.format(1)}</m:num><m:den>{_RUN.format(2)}</m:den></m:f></m:oMath>"), ("x^{2}", f"<m:oMath><m:sSup><m:e>{_RUN.format('x')}</m:e><m:sup>{_RUN.format(2)}</m:sup></m:sSup></m:oMath>"), ("a<b", f"<m:oMath>{_RUN.format('a')}{_RUN.format('&lt;')}{_RUN.format('b')}</m:oMath>")], maths.to_omml)
scalar("field_codes", "t string", [("\\frac{a}{b}", "EQ \\f(a,b)"), ("\\sqrt{x}", "EQ \\r(,x)"), ("\\sqrt[3]{x}", "EQ \\r(3,x)"), ("\\alpha", "EQ α"), ("x_1^2", "EQ x\\s\\do4(1)\\s\\up6(2)")], maths.to_eq_field)
scalar("rtf_maths", "t string", [("x", "{\\moMath {\\mr x}}")], maths.to_rtf)
scalar("field_codes_of_office_maths", "t string", [(f"<m:oMath><m:f><m:num>{_RUN.format(1)}</m:num><m:den>{_RUN.format(2)}</m:den></m:f>{_RUN.format('x')}</m:oMath>", "EQ \\f(1,2)x"), (f'<m:oMath><m:rad><m:radPr><m:degHide m:val="1"/></m:radPr><m:deg></m:deg><m:e>{_RUN.format("y")}</m:e></m:rad></m:oMath>', "EQ \\r(,y)"), (f"<m:oMath><m:sSubSup><m:e>{_RUN.format('a')}</m:e><m:sub>{_RUN.format('i')}</m:sub><m:sup>{_RUN.format('2')}</m:sup></m:sSubSup></m:oMath>", "EQ a\\s\\do4(i)\\s\\up6(2)"), ("<broken", "EQ ")], maths.field_of_omml)
scalar("unicode_maths", "t string", [("x² + √3", "$x^{2}$ + $\\sqrt{3}$"), ("H₂O", "$H_{2}$O"), ("ক", "ক")], maths.from_unicode)
scalar("readable_maths", "t string", [("\\frac{1}{2} + \\sqrt{3}", "1/2 + √3"), ("$\\alpha$", "α")], maths.to_readable)
scalar("bengali_outside_maths", "t string", [("$ক x$", " ক $x$"), ("$$", ""), ("$x$", "$x$")], maths.bengali_out)
scalar("healed_formulae", "t string", [("3x10^5 H2O x^2", "$3 \\times 10^{5}$ $H_{2}O$ $x^{2}$"), ("$H2O$", "$H2O$")], maths.healed)
scalar("simple_maths_runs", "t string", [("2x+1", '[{"text":"2","italic":false},{"text":"x","italic":true},{"text":"+1","italic":false}]')], maths.math_tokens)
scalar("visual_maths", "t string", [("\\frac{12}{3}", "12"), ("x^{2}", "x2")], maths.to_visual)
scalar("shielded_maths", "t string", [("ক $x$ খ \\(y\\)", '{"text":"ক 0 খ 1","held":["$x$","\\\\(y\\\\)"]}'), ("ক", '{"text":"ক","held":[]}')], maths.shielded)

# --- forms -----------------------------------------------------------------------------------------------

_FORM = lambda kind: lambda t: F.to_json(forms.parse_form(F.lit(kind), t)["fields"])
scalar("cash_memos", "t string", [("করিম ট্রেডার্স\nক্যাশ মেমো\nমেমো নং: ১২  তারিখ: ১/১/২৪\nনাম: রহিম\n| পণ্য | দর |\n|---|---|\n| চাল | ৫০ |\nসর্বমোট: ৫০\nকথায়: পঞ্চাশ", '{"number":"১২","date":"১/১/২৪","name":"রহিম","total":"৫০","in_words":"পঞ্চাশ","institute":"করিম ট্রেডার্স","title":"ক্যাশ মেমো"}')], _FORM("CASH_MEMO"))
scalar("cash_memo_tables", "t string", [("ক\n| পণ্য | দর |\n|---|---|\n| চাল | ৫০ |", '[[["পণ্য","দর"],["চাল","৫০"]]]')], lambda t: F.to_json(forms.parse_form(F.lit("CASH_MEMO"), t)["tables"]))
scalar("memo_signatures", "t string", [("ক\nনাম: ........\nকথায়: একশত\nক্রেতার স্বাক্ষর\tবিক্রেতার স্বাক্ষর", '{"in_words":"একশত","institute":"ক"}|["ক্রেতার স্বাক্ষর","বিক্রেতার স্বাক্ষর"]')], lambda t: F.concat_ws("|", F.to_json(forms.parse_form(F.lit("CASH_MEMO"), t)["fields"]), F.to_json(forms.parse_form(F.lit("CASH_MEMO"), t)["signs"])))
scalar("receipts", "t string", [("ক সমিতি\nরসিদ\nরসিদ নং: ৭\nটাকা: ৫০০\nবাবদ: চাঁদা", '{"number":"৭","amount":"৫০০","purpose":"চাঁদা","institute":"ক সমিতি","title":"রসিদ"}')], _FORM("RECEIPT"))
scalar("admit_cards", "t string", [("ক স্কুল\nপ্রবেশপত্র\nপরীক্ষার্থীর নাম: রহিম\nরোল: ১২\nশ্রেণি: দশম", '{"name":"রহিম","roll":"১২","class":"দশম","institute":"ক স্কুল","title":"প্রবেশপত্র"}')], _FORM("ADMIT_CARD"))
scalar("curricula", "t string", [("জীবনবৃত্তান্ত\nনাম: রহিম\nমোবাইল: ০১৭\nশিক্ষাগত যোগ্যতা\nএসএসসি ২০১০", '{"doc_type":"CV_RESUME","fields":{"name":"রহিম","phone":"০১৭","title":"জীবনবৃত্তান্ত"},"sections":[{"title":"শিক্ষাগত যোগ্যতা","lines":["এসএসসি ২০১০"]}],"tables":[],"body":"","signs":[]}')], lambda t: forms.parse_form(F.lit("CV_RESUME"), t))
scalar("deeds", "t string", [("চুক্তিপত্র\n১ম পক্ষ: রহিম\n২য় পক্ষ: করিম\nতফসিল\nদাগ ১২", '{"doc_type":"STAMP_DEED","fields":{"first_party":"রহিম","second_party":"করিম","title":"চুক্তিপত্র"},"sections":[{"title":"তফসিল","lines":["দাগ ১২"]}],"tables":[],"body":"","signs":[]}')], lambda t: forms.parse_form(F.lit("STAMP_DEED"), t))
scalar("certificates", "t string", [("ক ইউনিয়ন\nপ্রত্যয়নপত্র\nস্মারক নং: ৫\nনাম: রহিম\nতিনি ভালো।", '{"memo":"৫","name":"রহিম","institute":"ক ইউনিয়ন","title":"প্রত্যয়নপত্র"}')], _FORM("PROTTOYON"), composed=True)
scalar("applications", "t string", [("তারিখ: ১/১\nবরাবর,\nপ্রধান শিক্ষক\nবিষয়: ছুটি\nমহোদয়, ছুটি চাই।", '{"date":"১/১","to":"প্রধান শিক্ষক","subject":"ছুটি"}')], _FORM("GOVT_APP"))
scalar("missing_fields", "kind string, t string", [("ADMIT_CARD", "নাম: রহিম", "roll"), ("ADMIT_CARD", "নাম: রহিম\nরোল: ১", None), ("GOVT_APP", "ক", "subject")], lambda k, t: forms.parse_form(k, t)["missing"])
scalar("routines", "t string", [("| বার | ১ম |\n|---|---|\n| রবি | বাংলা |", '{"headers":["বার","১ম"],"rows":[["রবি","বাংলা"]]}'), ("বার\t১ম\nসোম: গণিত | ধর্ম", '{"headers":["বার","১ম"],"rows":[["সোম","গণিত","ধর্ম"]]}')], forms.parse_routine)
scalar("paper_metadata", "t string", [("আদর্শ স্কুল\nবার্ষিক পরীক্ষা\nশ্রেণি: ষষ্ঠ; বিষয়: বাংলা\nসময়: ২ ঘণ্টা পূর্ণমান: ৫০", '{"institute":"আদর্শ স্কুল","exam":"বার্ষিক পরীক্ষা","class":"ষষ্ঠ","subject":"বাংলা","time":"২ ঘণ্টা","marks":"৫০","date":""}')], classify.metadata)

# --- layout and document checks ---------------------------------------------------------------------------

_BOX = "box array<double>, role string"
scalar("column_kinds", _BOX, [([0.0, 50.0, 9.0, 480.0], "paragraph", "left"), ([0.0, 520.0, 9.0, 950.0], "paragraph", "right"), ([0.0, 50.0, 9.0, 950.0], "paragraph", "wide"), ([0.0, 50.0, 9.0, 100.0], "table", "wide"), (None, "paragraph", None), ([0.0, 450.0, 9.0, 540.0], "list", "left")], windows.column_kind)
scalar("eligible_blocks", f"{_BOX}, t string", [([0.0, 50.0, 9.0, 480.0], "paragraph", "কথা", "true"), ([0.0, 50.0, 9.0, 100.0], "paragraph", "কথা", "false"), ([0.0, 50.0, 9.0, 480.0], "title", "কথা", "false"), ([0.0, 50.0, 9.0, 480.0], "list", "নাম ......", "false")], windows.eligible)
scalar("cut_lines", "t string, role string", [("✂ ----------", "paragraph", "true"), ("----------------", "paragraph", "true"), ("কথা", "cut_line", "true"), ("a - b", "paragraph", "false")], documents.cut_line)
scalar("photo_boxes", "box array<double>, t string", [([100.0, 700.0, 300.0, 900.0], "ছবি", "true"), ([100.0, 700.0, 300.0, 900.0], "নাম", "false"), ([100.0, 100.0, 300.0, 300.0], "", "false"), (None, "", "false")], documents.photo_box)
scalar("structure_warnings", "t string", [("বরাবর\nবিষয়: ছুটি", "[]"), ("বিষয়: ছুটি", '["addressee"]'), ("ক", '["addressee","subject"]')], lambda t: documents.structure_warnings(t, {"addressee": "বরাবর", "subject": "বিষয়"}))
_OPTIONS = "\n".join(f"{c}) বিকল্প" for c in "কখগঘকখগঘ")
scalar("promoted_papers", "kind string, t string, cq int", [("EXAM_CQ", f"১. কী?\nবহুনির্বাচনি\n{_OPTIONS}", 1, "EXAM_COMBINED"), ("EXAM_CQ", f"১. কী?\nবহুনির্বাচনি\n{_OPTIONS}", 0, "EXAM_CQ"), ("EXAM_GENERAL", f"১. কী?\nবহুনির্বাচনি\n{_OPTIONS}", 1, "EXAM_GENERAL"), ("EXAM_MATH", "ক\n---SECTION_BREAK:MCQ---", 0, "EXAM_COMBINED"), ("EXAM_CQ", f"বহুনির্বাচনি\n{_OPTIONS}", 1, "EXAM_CQ")], documents.promoted)
scalar("fact_routes", "content string, grade int, cq int, mcq int, short int, other int, maths boolean", [("SYLLABUS", 0, 0, 0, 0, 0, False, '{"type":"EXAM_GENERAL","confidence":0.97}'), ("QUESTION", 3, 1, 0, 0, 0, False, '{"type":"EXAM_GENERAL","confidence":0.97}'), ("", 9, 1, 0, 0, 2, False, '{"type":"EXAM_GENERAL","confidence":0.95}'), ("", 9, 3, 5, 0, 0, False, '{"type":"EXAM_COMBINED","confidence":0.96}'), ("", 9, 3, 0, 1, 0, True, '{"type":"EXAM_MATH","confidence":0.96}'), ("OTHER", 9, 3, 0, 0, 0, False, '{"type":"EXAM_CQ","confidence":0.96}'), ("", 9, 0, 5, 0, 0, False, '{"type":"EXAM_MCQ","confidence":0.96}'), ("", 9, 0, 5, 2, 0, False, '{"type":"EXAM_GENERAL","confidence":0.9}')], classify.route_facts)
scalar("chosen_routes", "url string, stored string", [("https://h/x?mode=classic", None, "legacy"), ("https://h/x", "legacy", "legacy"), ("https://h/x?mode=studio", "legacy", "studio"), ("https://h/x", "", "default")], relational.route)
scalar("match_scores", "p int, a int, b int", [(0, 0, 0, "1.0"), (2, 2, 2, "1.0"), (1, 2, 2, "0.5"), (0, 1, 0, "0.0")], relational.match_f1)
scalar("page_scores", "a double, b double, c double, d double, e double", [(1.0, 1.0, 1.0, 1.0, 1.0, "100.0"), (0.5, 1.0, 0.0, 0.0, 0.0, "40.0")], relational.page_score)
scalar("fitting_tables", "h array<string>, c int, r array<array<string>>", [(["নাম", "দর"], 2, [["নাম", "দর"], ["ক", "১"]], "2"), (["x"], 2, [["a", "b"]], "1"), (["x"], 3, [["a"]], "0"), (["x"], 3, [], "0")], relational.table_fit)
