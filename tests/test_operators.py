"""Windows, matching, rasters, nested values, office files and streams."""

import io
import pathlib
import re
import struct
import zipfile

import numpy as np
import pytest
from docloom import storage
from docloom.operators import ledger, nested, raster, relational, windows
from docloom.sources import office
from docloom.streaming import limits
from pyspark.sql import functions as F


def test_column_bands(spark):
    rows = [(1, 1, 0, "paragraph", "t" * 50, [0.0, 50.0, 40.0, 950.0])]
    for i in range(4):
        rows.append((1, 1, 1 + 2 * i, "paragraph", "l" * 80, [100.0 + 50 * i, 50.0, 140.0 + 50 * i, 480.0]))
        rows.append((1, 1, 2 + 2 * i, "paragraph", "r" * 80, [100.0 + 50 * i, 520.0, 140.0 + 50 * i, 950.0]))
    rows.append((1, 1, 9, "paragraph", "no box", None))
    df = spark.createDataFrame(rows, "doc int, page int, idx int, role string, text string, box array<double>")
    got = {r.idx: (r.cols, r.kind) for r in windows.column_bands(df).collect()}
    assert got[0] == (1, "wide") and got[1] == (2, "left") and got[2] == (2, "right") and got[9] == (2, "right")
    few = windows.column_bands(df.filter("idx < 4"))
    assert {r.cols for r in few.collect()} == {1}


def test_matching(spark):
    s = spark.createDataFrame([("a", "k", "x", 0), ("b", "k", "y", 1), ("c", "z", "x", 2)], "slot_id string, key string, ctx string, slot_pos int")
    p = spark.createDataFrame([("1", "k", "y", 0), ("2", "k", "q", 1), ("3", "m", "x", 2)], "part_id string, key string, ctx string, part_pos int")
    pairs = relational.matched(s, p, [["key", "ctx"], ["key"]])
    assert sorted(map(tuple, pairs.collect())) == [("a", "2", 2), ("b", "1", 1)]
    left, rest = relational.left_over(s, p, pairs)
    assert [r.slot_id for r in left.collect()] == ["c"] and [r.part_id for r in rest.collect()] == ["3"]
    cand = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.85), (2, 2, 0.6), (3, 2, 0.7)], "a int, b int, similarity double")
    assert sorted(map(tuple, relational.best_first(cand).collect())) == [(1, 1, 0.9), (3, 2, 0.7)]
    fit = spark.createDataFrame([(["নাম", "দর"], 2, [["নাম", "দর"], ["ক", "১"]]), (["x"], 2, [["a", "b"]]), (["x"], 3, [["a"]])], "h array<string>, c int, r array<array<string>>")
    assert [r.f for r in fit.select(relational.table_fit(F.col("h"), F.col("c"), F.col("r")).alias("f")).collect()] == [2, 1, 0]


@pytest.mark.parametrize("few", [0, 100_000])
def test_best_first_leaves_nothing(spark, monkeypatch, few):
    monkeypatch.setattr(relational, "FEW", few)
    rng = np.random.default_rng(5)
    # 30 equal texts on each side; a chain of falling similarity; ties that are no whole group; odd values
    rows = [(a, b, 0.9) for a in range(30) for b in range(100, 130)]
    chain = [(200 + (i + 1) // 2, 300 + i // 2, 0.8 - i / 1000) for i in range(0 if few == 0 else 99)]
    ties = [(400 + int(a), 500 + int(b), float(s)) for a, b, s in zip(rng.integers(0, 15, 60), rng.integers(0, 15, 60), rng.integers(1, 4, 60) / 4, strict=True)]
    odd = [(600, 700, None), (601, 700, float("nan")), (None, 701, 1.0), (602, None, 1.0), (0, 100, 0.5)]
    every = rows + chain + ties + odd
    used_a, used_b, want = set(), set(), []
    for a, b, s in sorted((r for r in every if r[0] is not None and r[1] is not None), key=lambda r: (r[2] is None, -9 if r[2] != r[2] else -(r[2] or 0), r[0], r[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.append((a, b))
    cand = spark.createDataFrame(every, "a int, b int, similarity double")
    got = sorted((r.a, r.b) for r in relational.best_first(cand).collect())
    assert got == sorted(want) and sum(a < 30 for a, _ in got) == 30
    assert relational.best_first(cand.limit(0)).collect() == []


def test_matched_texts_keeps_its_limits(spark):
    left = spark.createDataFrame([(1, 1, "the same paragraph"), (2, 1, "the same paragraph"), (3, 5, "alone on its page"), (4, 2, "ab"), (5, None, "without a page")], "id int, page int, text string")
    right = spark.createDataFrame([(1, 2, "the same paragraph"), (2, 1, "the same paragraph"), (3, 7, "alone on its page"), (4, 2, "abababababab"), (5, 9, "without a page"), (6, 1, "quite other words")], "id int, page int, text string")
    assert sorted((r.a, r.b) for r in relational.matched_texts(left, right).collect()) == [(1, 1), (2, 2), (5, 5)]


def test_page_is_turned_warped_and_levelled():
    g = np.full((420, 300), 255, np.uint8)
    for y in range(40, 380, 30):
        # a headline with strokes below it, and a ragged right margin
        end = 240 + y % 37
        g[y : y + 3, 30:end] = 0
        g[y + 3 : y + 14, 30:end:7] = 0
    up = raster.prepared(g)[0]
    for k, want in ((1, 90), (0, 0), (-1, 270)):
        side = np.rot90(g, k)
        assert raster.orientation(raster.ink(side)) == want
        assert np.array_equal(raster.prepared(side)[0], up)
    tilted = raster.levelled(g, -3.0)
    assert abs(raster.skew(raster.ink(tilted)) - 3.0) <= 0.25 and abs(raster.skew(raster.ink(raster.prepared(tilted)[0]))) <= 0.25
    # a sheet on a dark table
    photo = np.full((520, 420), 40, np.uint8)
    quad = np.array([[50, 60], [360, 40], [380, 480], [40, 460]])
    h = raster.homography(quad, np.array([[0, 0], [299, 0], [299, 419], [0, 419]]))
    y, x = np.mgrid[0:520, 0:420]
    u, v, w = h @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    u, v = np.round(u / w).astype(int), np.round(v / w).astype(int)
    inside = (u >= 0) & (u < 300) & (v >= 0) & (v < 420)
    photo.reshape(-1)[inside] = g[v[inside], u[inside]]
    page = raster.prepared(photo)[0]
    assert len(page) < 450 and len(page[0]) < 350
    # each line lies at its share of the height, within the jagged border of the sheet
    middle = raster.lines(raster.ink(page)[:, 40:-80])
    assert np.allclose([(a + b) / 2 / len(page) for a, b in middle], [(a + b) / 2 / 420 for a, b in raster.lines(raster.ink(g))], atol=0.01)
    assert raster.orientation(np.zeros((50, 50), bool)) == 0


def test_unique_names_of_a_hot_name(spark, monkeypatch):
    monkeypatch.setattr(relational, "PIECE", 7)
    new = [(i * 37 % 1009, "hot" if i % 5 else f"n{i % 30}") for i in range(1000)] + [(2000, None)]
    old = spark.createDataFrame([(1, "hot"), (2, "hot"), (3, "n0"), (4, "gone")], "id long, name string")
    seen, want = {"hot": 2, "n0": 1, "gone": 1}, []
    for i, name in sorted(new):
        seen[name] = seen.get(name, 0) + 1
        want.append((i, f"{name} ({seen[name]})" if name and seen[name] > 1 else name))
    for kind in ("long", "string"):
        df = spark.createDataFrame(new, "id long, name string").withColumn("id", F.lpad(F.col("id").cast("string"), 4, "0").cast(kind))
        got = relational.unique_names(old.withColumn("id", F.col("id").cast(kind)), df)
        assert sorted((int(r.id), r.name) for r in got.collect()) == want
    # no window numbers all rows of a name
    assert re.search(r"row_number\(\) windowspecdefinition\(name#\d+, piece#", got._jdf.queryExecution().optimizedPlan().toString())


def test_salary_and_rules(spark):
    slip = ["মূল বেতন: ১৬,০০০", "ভাতা: ৪,০০০ টাকা", "মোট আয়: ২০,০০০", "কর্তন:", "তহবিল: ১,৬০০"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(slip)], "doc int, pos int, line string")
    assert tuple(relational.salary(df).first()) == (1, 20000.0, 1600.0, 18400.0)
    bad = spark.createDataFrame([(1, 0, "table", [["a"], ["b", "c"]]), (1, 1, "odd", None), (1, 2, "paragraph", None)], "doc int, idx int, role string, rows array<array<string>>")
    assert sorted((r.idx, r.problem) for r in relational.violations(bad, ("table", "paragraph")).collect()) == [(0, "table"), (1, "role")]
    f = spark.createDataFrame([(429, '{"limit":"ip_daily"}', True), (0, None, True), (502, '{"attempts":[{"class":"FATAL_INPUT"}]}', False), (401, "{}", True)], "s int, b string, own_key boolean")
    got = relational.fallback(f.select("own_key", relational.failure(F.col("s"), F.col("b")).alias("f")).select("own_key", "f.kind")).collect()
    assert {(r.kind, r.action) for r in got} == {("daily_cap", "abort"), ("server_error", "direct"), ("fatal_input", "abort"), ("unauthorized", "abort")}


def test_ledger_states(spark):
    rows = [("k", "m", "2024-05-01 10:00:00", True, None, 100, 0, "model", 1), ("k", "m", "2024-05-01 10:01:00", True, None, 201, 0, "model", 2), ("k", "m", "2024-05-01 10:02:00", False, "SERVER", 0, 30000, "model", 3), ("k", "m", "2024-05-01 10:03:00", False, "TIMEOUT", 0, 0, "model", 4), ("k", "n", "2024-05-01 10:04:00", False, "SERVER", 0, 30000, "model", 5)]
    e = spark.createDataFrame(rows, "key string, model string, at string, ok boolean, class string, latency_ms long, reopen_after_ms long, scope string, seq int").withColumn("at", F.col("at").cast("timestamp"))
    s = ledger.states(e, F.lit("2024-05-01 10:04:10").cast("timestamp"))
    r = s.first()
    assert (r.requests, r.success, r.fail, r.avg_latency_ms, r.fail_streak) == (5, 2, 3, 151.0, 2) and r.by_reason == {"SERVER": 2, "TIMEOUT": 1}
    now = 1714557850000
    st = ledger.status(s, now)
    assert st.first()["shown"] == "READY" and ledger.soonest(st).first()["wait_sec"] == 20
    keys = spark.createDataFrame([("a", 0, False, False), ("b", 1, False, False), ("c", 2, False, True), ("d", 3, True, False)], "key string, idx int, invalid boolean, cooling boolean")
    assert [r.key for r in ledger.rotation(keys, 1, True).collect()] == ["b", "a", "c"]
    plan = spark.createDataFrame([(0, "m"), (1, "m"), (2, "n"), (3, "m")], "step int, model string")
    assert [r.step for r in ledger.skip_model(plan, 0, "m").orderBy("step").collect()] == [2, 3]
    old = spark.createDataFrame([("a", "m", 5, "SERVER", 3, 1)], "key string, model string, reopen_ms long, reason string, fail_streak long, version int")
    assert tuple(ledger.migrate(old).first()) == ("a", "m", 0, None, 0, 2)


def page():
    g = np.full((120, 200), 255, np.uint8)
    for y in (10, 30, 50):
        g[y : y + 8, 20:180:3] = 0
        g[y + 3, 20:180] = 0
    g[80:110, 30:33] = g[80:110, 97:100] = g[80:83, 30:100] = g[107:110, 30:100] = 0
    return g


def test_raster(spark):
    g = page()
    m = raster.ink(g)
    assert raster.lines(m)[:3] == [(10, 18), (30, 38), (50, 58)]
    assert raster.frames(m) == [(30, 80, 99, 109)]
    assert raster.skew(m[:60]) == 0.0 and raster.content_box(m, 0.0) == (20, 10, 179, 109)
    assert raster.horizontal_rules(m, 0.75) == [(13, 14), (33, 34), (53, 54)]
    c = raster.components(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool))
    assert c == [(0, 0, 2, 1, 3), (0, 3, 1, 3, 2)]
    assert len(raster.components(np.array([[1, 0], [0, 1]], bool), eight=False)) == 2
    h = raster.homography(np.array([[0, 0], [1, 0], [1, 1], [0, 1]]), np.array([[2, 3], [4, 3], [4, 5], [2, 5]]))
    assert np.allclose(h @ [0.5, 0.5, 1], [3, 4, 1])
    assert np.array_equal(raster.warped(g, np.array([[0, 0], [199, 0], [199, 119], [0, 119]]), 200, 120)[5:-5, 5:-5], g[5:-5, 5:-5])
    assert raster.ink_f1(m, np.roll(m, 1, 1), 1) > 0.95 and raster.ink_f1(m, m, 0) == 1.0
    assert raster.shift_correlation(np.sin(np.arange(50)), np.sin(np.arange(50) + 2), 5)[0] == 2
    assert raster.skeleton(np.pad(np.ones((3, 20), bool), 2)).sum() <= 20
    assert raster.rows_in_bands([1, 2, 1], [1, 3], [False, False, False]) == [0, 1, 1]
    assert raster.aligned([(0, 10), (20, 30)], [(1, 11), (50, 60)], 100) == [(0, 0)]
    assert raster.reliable(np.array([[0, 0], [99, 0], [99, 99], [0, 99]]), 100, 100) and raster.block_metrics(m, (0, 0, 199, 70), 72)["lines"] == 3
    pages = spark.createDataFrame([(1, 200, 120, bytearray(g.tobytes()))], "page_id long, w int, h int, gray binary")
    got = raster.per_page(pages, lambda p: [{"y0": a, "y1": b} for a, b in raster.lines(raster.ink(p))], "y0 int, y1 int").collect()
    assert (got[0].page_id, got[0].y0, got[0].y1) == (1, 10, 18)


def test_nested(spark):
    paper = spark.createDataFrame([(1, ([("ক [সহজ]", [("১", "এক [সহজ]", [("ক", "x [কঠিন]")], [])])],))], "id int, paper struct<sections:array<struct<title:string,questions:array<struct<num:string,text:string,subQuestions:array<struct<label:string,text:string>>,options:array<struct<label:string,text:string>>>>>>>")
    from docloom.functions.text import difficulty_free

    s = paper.select(nested.rewritten(F.col("paper.sections"), difficulty_free).alias("s")).first()["s"]
    assert s[0]["title"] == "ক" and s[0]["questions"][0]["subQuestions"][0]["text"] == "x"
    assert nested.questions(paper, "id").first()["num"] == "১"
    t = spark.createDataFrame([([["h", "g"], ["a", "b"], ["c", "d"], ["মোট", ""]], [["1"]])], "s array<array<string>>, r array<array<string>>")
    assert t.select(nested.filled_table(F.col("s"), F.col("r")).alias("x")).first()["x"] == [["h", "g"], ["1", ""], ["", ""], ["মোট", ""]]
    items = spark.createDataFrame([("t", 0, "heading", None, "শিরোনাম"), ("t", 1, "kv", "নাম", "রহিম"), ("t", 2, "kv", "নাম", "রহিম")], "template string, idx int, kind string, key string, text string")
    slots = nested.slots(items)
    out = nested.filled(slots, spark.createDataFrame([("s1", "p")], "slot_id string, part_id string"), spark.createDataFrame([("p", "করিম")], "part_id string, text string"))
    assert [r.text for r in out.orderBy("idx").collect()] == ["শিরোনাম", "করিম", "করিম"]
    assert nested.mcq_plan([30.0] * 6, 100.0)["pages"] == 1 and nested.best_split([3, 3, 2, 2], 6, 6) == 2
    assert nested.booklet_plan([50.0] * 9, 110.0, cover=60.0)["back"] == [8]
    plan = nested.plans(spark.createDataFrame([(1, i, 30.0) for i in range(6)], "doc long, item long, height double"), 100.0)
    assert plan.count() == 6
    raw = spark.createDataFrame([("99", "X"), ("12", " B ")], "size string, layout string")
    assert [tuple(r) for r in nested.settings(raw, {"size": (6, 48, 11)}, {"layout": ("a", "b")}).collect()] == [(11.0, "a"), (12.0, "b")]


def zipped(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx():
    body = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="B"/></w:pPr><w:r><w:t>শিরো</w:t></w:r><w:r><w:rPr><w:b w:val="0"/><w:sz w:val="30"/></w:rPr><w:t>নাম</w:t><w:tab/></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>ক</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    style = f'<w:styles {W}><w:style w:styleId="A"><w:rPr><w:rFonts w:ascii="Nikosh"/></w:rPr></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/><w:rPr><w:b/></w:rPr></w:style></w:styles>'
    return zipped({"word/document.xml": body, "word/styles.xml": style})


def compound(streams):
    """A small compound file: every stream is 4096 bytes or more and so in ordinary sectors."""
    sector, fat, blocks, entries = 512, [], [], []

    def put(data):
        start = len(fat)
        n = -(-len(data) // sector)
        for k in range(n):
            fat.append(start + k + 1 if k + 1 < n else 0xFFFFFFFE)
        blocks.append(data.ljust(n * sector, b"\0"))
        return start

    for name, data in streams.items():
        entries.append((name, 2, put(data), len(data)))
    entries.insert(0, ("Root Entry", 5, 0xFFFFFFFE, 0))
    directory = b"".join(n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<H", 2 * len(n) + 2) + bytes([k, 0]) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<II", s, z) + b"\0" * 4 for n, k, s, z in entries)
    d = put(directory)
    fat_at = len(fat)
    fat.append(0xFFFFFFFD)
    blocks.append(b"".join(struct.pack("<I", x) for x in fat).ljust(sector, b"\xff"))
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<II", 1, d) + struct.pack("<I", 0) + struct.pack("<IIIII", 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return (head + struct.pack("<109I", fat_at, *[0xFFFFFFFF] * 108)).ljust(512, b"\0") + b"".join(blocks)


def old_doc(text):
    word = bytearray(4096)
    data = text.encode("utf-16-le")
    word[1024 : 1024 + len(data)] = data
    struct.pack_into("<H", word, 10, 0x200)
    pieces = struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 1024, 0)
    clx = b"\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", word, 0x1A2, 0, len(clx))
    return compound({"WordDocument": bytes(word), "1Table": clx.ljust(4096, b"\0")})


def test_office(spark, tmp_path):
    xlsx = zipped({"xl/workbook.xml": "<x/>", "xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><r><t>দুই</t></r><r><t>ভাগ</t></r></si></sst>', "xl/worksheets/sheet1.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>x</t></is></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>'})
    pptx = zipped({"ppt/presentation.xml": "<x/>", "ppt/slides/slide1.xml": '<p xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>স্লাইড</a:t></a:r></a:p></p>'})
    mht = b"MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=B\r\n\r\n--B\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\nPGI+a2E8L2I+\r\n--B--\r\n"
    files = {"a.docx": docx(), "b.xlsx": xlsx, "c.pptx": pptx, "d.mht": mht, "e.txt": "সাধারণ".encode(), "f.docx": b"PK\x03\x04bad", "g.txt": ("Avwg evsjv Mvb MvB Ö×ØÙÚÛÜÝÞßàáâãäåæçèéêë").encode(), "h.doc": old_doc("পুরোনো")}
    for n, data in files.items():
        (tmp_path / n).write_bytes(data)
    frame = office.files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in office.texts(frame).collect()}
    assert got["a.docx"].text == "শিরোনাম\t\nক" and got["b.xlsx"].text == "দুইভাগ\nx\n5" and got["c.pptx"].text == "স্লাইড" and got["d.mht"].text == "ka" and got["e.txt"].text == "সাধারণ"
    assert got["f.docx"].error and got["g.txt"].was_legacy and got["g.txt"].text.startswith("আমি বাংলা") and got["h.doc"].text == "পুরোনো"
    runs = office.runs(frame.filter(F.col("path").endswith("a.docx"))).orderBy("para", "run").collect()
    assert [(r.font, r.bold, r.size) for r in runs][:2] == [("Nikosh", True, None), ("Nikosh", False, 15.0)]
    assert office.docx_tables(docx())[0][0][0]["span"] == 2 and office.cells(frame.filter(F.col("path").endswith(".xlsx"))).count() == 3
    assert office.embedded_images(b"..\xff\xd8\xff123\xff\xd9..")[0][0] == "jpeg"
    (tmp_path / "n.csv").write_text('শিরোনাম,dept\n"এক ""দুই""\nতিন",x\n,y\n')
    assert [r.title for r in office.notices(spark, str(tmp_path / "n.csv")).collect()] == ['এক "দুই"\nতিন']
    assert office.first_of(lambda: spark.read.json("/nowhere"), lambda: spark.range(0), lambda: spark.range(2)).count() == 2
    css = spark.createDataFrame([("p { Color: red; a:b } .x{c:d}",)], "t string").select(office.css_rules(F.col("t")).alias("r")).select(F.col("r")[0]["selector"].alias("s"), office.declared(F.col("r")[0]["body"]).alias("d")).first()
    assert css.s == "p" and css.d == {"color": "red", "a": "b"}


def test_streams(spark, tmp_path):
    rows = [("a", "2024-05-01", 1000, 1, True, None, 100, 0), ("a", "2024-05-01", 2000, 2, True, None, 201, 0), ("a", "2024-05-01", 3000, 3, False, "SERVER", 0, 30000), ("a", "2024-05-01", 4000, 4, False, "TIMEOUT", 0, 0), ("b", "2024-05-01", 1, 1, False, "RPD", 0, 500), ("b", "2024-05-02", 2, 2, False, "INVALID", 0, None)]
    schema = "key string, day string, at_ms long, seq int, ok boolean, cls string, latency_ms long, reopen_after_ms long"
    spark.createDataFrame(rows[:3] + rows[4:5], schema).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(rows[3:4] + rows[5:], schema).write.mode("append").parquet(str(tmp_path / "in"))
    want = {r.key: tuple(r) for r in limits.ledger_batch(spark.createDataFrame(rows, schema)).collect()}
    assert want["a"][1:6] == (4, 2, 2, 1, 151.0) and want["b"][6] == "INVALID" and want["b"][1] == 1
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = limits.ledger_stream(stream).writeStream.outputMode("update").format("memory").queryName("ledger").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = {r.key: tuple(r) for r in spark.table("ledger").collect()}
    assert got == want
    ev = spark.createDataFrame([("u", f"2024-05-01 10:00:{i:02d}") for i in range(5)] + [("u", "2024-05-01 10:30:00")], "user string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    ev.write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    q = limits.limited(s, "user", "ts", "1 minute", 3).writeStream.outputMode("append").format("memory").queryName("limited").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.awaitTermination(120)
    assert [(r.n, r.blocked) for r in spark.table("limited").collect()] == [(5, 2)]


def test_retries(spark):
    def call(payload):
        error = ValueError()
        error.kind = payload
        if payload == "ok":
            return "done"
        raise error

    chunks = spark.createDataFrame([(1, "ok"), (2, "SERVER"), (3, "FATAL_INPUT")], "id long, payload string")
    assert {r.id: (r.text, r.failure, r.tries) for r in limits.with_retries(chunks, call).collect()} == {1: ("done", None, 1), 2: (None, "SERVER", 3), 3: (None, "FATAL_INPUT", 1)}


def test_tables_of_a_scope_go(spark):
    with storage.scope() as kept:
        gone = storage.table(spark.range(5), "test")
        path = gone._shared_path.removeprefix("file://")
        kept.append(stays := storage.table(gone.filter("id > 2"), "test"))
        assert pathlib.Path(path).exists() and gone.count() == 5
    assert not pathlib.Path(path).exists() and stays.count() == 2
    storage.drop(stays, None, spark.range(1))
    assert not hasattr(stays, "_shared_path") or stays._shared_path is None


@pytest.mark.parametrize("seed", range(6))
def test_planned_chunks_keep_their_limits(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, [10, 300, 900][seed % 3], rng.integers(9, 60)).tolist()
    plan = windows.levelled_chunks(windows.greedy_chunks(sizes, 8, 700), 8, 700, 5)
    assert [n for c in plan for n in c] == sizes
    assert all(len(c) <= 8 and (len(c) == 1 or sum(c) <= 700) for c in plan)
    if seed % 3 == 0:
        assert all(len(c) >= 5 for c in plan)
