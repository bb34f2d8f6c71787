"""Office files as rows: DOCX, XLSX, PPTX, MHTML and old DOC, read from ``binaryFile`` frames.

Each reader takes the frame of ``spark.read.format("binaryFile")`` and explodes it in ``mapInPandas`` into one
row per run, cell, part or image. A file that can't be read is one row with an error.
"""

from __future__ import annotations

import email
import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
RUNS = "path string, part string, para int, run int, font string, bold boolean, italic boolean, size double, text string, error string"
DOCX_PARTS = re.compile(r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml")


def kind_of(content: bytes) -> str:
    """docx, xlsx, pptx, doc, mhtml, html, rtf or text, by the first bytes and the parts inside."""
    if content[:4] == b"PK\x03\x04":
        names = set(zipfile.ZipFile(io.BytesIO(content)).namelist())
        return "docx" if "word/document.xml" in names else "xlsx" if "xl/workbook.xml" in names else "pptx" if "ppt/presentation.xml" in names else "zip"
    if content[:8] == bytes.fromhex("d0cf11e0a1b11ae1"):
        return "doc"
    head = content[:2048].lstrip().lower()
    return "mhtml" if b"mime-version:" in head else "rtf" if head.startswith(b"{\\rtf") else "html" if b"<html" in head else "text"


def styles(package: zipfile.ZipFile) -> dict[str, dict]:
    """Run formatting of every style, basedOn chains resolved."""
    if "word/styles.xml" not in package.namelist():
        return {}
    own, base = {}, {}
    for s in ElementTree.fromstring(package.read("word/styles.xml")).iter(f"{W}style"):
        sid = s.get(f"{W}styleId")
        own[sid] = format_of(s.find(f"{W}rPr"))
        b = s.find(f"{W}basedOn")
        base[sid] = b.get(f"{W}val") if b is not None else None

    def full(sid: str, seen: tuple = ()) -> dict:
        if sid not in own or sid in seen:
            return {}
        return full(base[sid], (*seen, sid)) | own[sid]

    return {sid: full(sid) for sid in own}


def format_of(props) -> dict:
    if props is None:
        return {}
    out, on = {}, lambda e: e.get(f"{W}val", "1") not in ("0", "false")
    for e in props:
        tag = e.tag.removeprefix(W)
        if tag == "rFonts":
            out["font"] = e.get(f"{W}ascii") or e.get(f"{W}cs")
        elif tag in ("b", "i"):
            out["bold" if tag == "b" else "italic"] = on(e)
        elif tag == "sz":
            out["size"] = float(e.get(f"{W}val", "0")) / 2
    return out


def docx_runs(content: bytes) -> Iterator[tuple]:
    """(part, para, run, font, bold, italic, size, text); tabs and breaks are characters."""
    package = zipfile.ZipFile(io.BytesIO(content))
    known = styles(package)
    for part in sorted(n for n in package.namelist() if DOCX_PARTS.fullmatch(n)):
        for p, para in enumerate(ElementTree.fromstring(package.read(part)).iter(f"{W}p")):
            style = para.find(f"{W}pPr/{W}pStyle")
            base = known.get(style.get(f"{W}val"), {}) if style is not None else {}
            for r, run in enumerate(para.iter(f"{W}r")):
                props = run.find(f"{W}rPr")
                named = props.find(f"{W}rStyle") if props is not None else None
                f = base | (known.get(named.get(f"{W}val"), {}) if named is not None else {}) | format_of(props)
                text = "".join(e.text or "" if e.tag == f"{W}t" else "\t" if e.tag == f"{W}tab" else "\n" if e.tag in (f"{W}br", f"{W}cr") else "" for e in run)
                if text:
                    yield part, p, r, f.get("font"), f.get("bold", False), f.get("italic", False), f.get("size"), text


def docx_text(content: bytes) -> str:
    paras: dict[int, list[str]] = {}
    for part, p, _, _, _, _, _, text in docx_runs(content):
        if part == "word/document.xml":
            paras.setdefault(p, []).append(text)
    return "\n".join("".join(paras.get(i, [])) for i in range(max(paras, default=-1) + 1))


def docx_tables(content: bytes) -> list[list[list[dict]]]:
    """Tables as rows of cells with text, span and whether a cell goes on from the one above."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    out = []
    for t in body.iter(f"{W}tbl"):
        rows = []
        for tr in t.findall(f"{W}tr"):
            cells = []
            for tc in tr.findall(f"{W}tc"):
                span, merge = tc.find(f"{W}tcPr/{W}gridSpan"), tc.find(f"{W}tcPr/{W}vMerge")
                cells.append({"text": "\n".join("".join(x.text or "" for x in p.iter(f"{W}t")) for p in tc.findall(f"{W}p")), "span": int(span.get(f"{W}val")) if span is not None else 1, "goes_on": merge is not None and merge.get(f"{W}val") != "restart"})
            rows.append(cells)
        out.append(rows)
    return out


def relationships(content: bytes, part: str = "word/_rels/document.xml.rels") -> dict[str, str]:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read(part))
    return {e.get("Id"): e.get("Target") for e in root}


def xlsx_cells(content: bytes) -> Iterator[tuple]:
    """(sheet, cell, text) of shared, inline and plain values."""
    package = zipfile.ZipFile(io.BytesIO(content))
    names = package.namelist()
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{S}t"))
    shared = [text_of(si) for si in ElementTree.fromstring(package.read("xl/sharedStrings.xml")).findall(f"{S}si")] if "xl/sharedStrings.xml" in names else []
    for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        for c in ElementTree.fromstring(package.read(name)).iter(f"{S}c"):
            v, inline = c.find(f"{S}v"), c.find(f"{S}is")
            text = text_of(inline) if inline is not None else shared[int(v.text)] if v is not None and c.get("t") == "s" else v.text if v is not None else None
            if text:
                yield name, c.get("r"), text
    for name in sorted(n for n in names if re.fullmatch(r"xl/drawings/drawing\d+\.xml", n)):
        for i, t in enumerate(ElementTree.fromstring(package.read(name)).iter(f"{A}t")):
            if t.text:
                yield name, f"shape{i}", t.text


def pptx_runs(content: bytes) -> Iterator[tuple]:
    package = zipfile.ZipFile(io.BytesIO(content))
    for name in sorted(n for n in package.namelist() if re.fullmatch(r"ppt/(?:slides|notesSlides)/[^/]+\.xml", n)):
        for p, para in enumerate(ElementTree.fromstring(package.read(name)).iter(f"{A}p")):
            for r, t in enumerate(para.iter(f"{A}t")):
                if t.text:
                    yield name, p, r, t.text


def mhtml_parts(content: bytes) -> list[tuple[str, str, bytes]]:
    """(location, type, bytes) of a MIME bundle, decoded."""
    message = email.message_from_bytes(content)
    return [(m.get("Content-Location", ""), m.get_content_type(), m.get_payload(decode=True) or b"") for m in message.walk() if not m.is_multipart()]


def embedded_images(content: bytes) -> list[tuple[str, bytes]]:
    """JPEG and PNG streams found by their signatures."""
    found = [("jpeg", m.start(), m[0]) for m in re.finditer(rb"\xff\xd8\xff.*?\xff\xd9", content, re.S)] + [("png", m.start(), m[0]) for m in re.finditer(rb"\x89PNG\r\n\x1a\n.*?IEND.{4}", content, re.S)]
    return [(k, data) for k, _, data in sorted(found, key=lambda x: x[1])]


def ole_streams(content: bytes) -> dict[str, bytes]:
    """Streams of a compound file by name: sector chains through the FAT, small ones through the mini stream."""
    if content[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
        raise ValueError("no compound file")
    size, mini = 1 << struct.unpack_from("<H", content, 30)[0], 1 << struct.unpack_from("<H", content, 32)[0]
    fat_count, first_dir, cutoff, first_mini, _, first_difat, difat_count = (*struct.unpack_from("<II", content, 44), *struct.unpack_from("<IIIII", content, 56))
    sector = lambda n: content[(n + 1) * size : (n + 2) * size]
    end = 0xFFFFFFFA
    difat = list(struct.unpack_from("<109I", content, 76))
    at = first_difat
    for _ in range(difat_count):
        *more, at = struct.unpack(f"<{size // 4}I", sector(at))
        difat += more
    fat: list[int] = []
    for n in difat[:fat_count]:
        if n < end:
            fat += struct.unpack(f"<{size // 4}I", sector(n))

    def chain(n: int, table: list[int], read) -> bytes:
        out, seen = [], 0
        while n < end and n < len(table) and seen <= len(table):
            out.append(read(n))
            n, seen = table[n], seen + 1
        return b"".join(out)

    directory = chain(first_dir, fat, sector)
    entries = []
    for i in range(0, len(directory) - 127, 128):
        e = directory[i : i + 128]
        length = struct.unpack_from("<H", e, 64)[0]
        if length:
            entries.append((e[: length - 2].decode("utf-16-le", "replace"), e[66], struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<I", e, 120)[0]))
    root = next(e for e in entries if e[1] == 5)
    small = chain(root[2], fat, sector)
    raw = chain(first_mini, fat, sector)
    mini_fat = list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
    return {name: (chain(start, fat, sector) if n >= cutoff else chain(start, mini_fat, lambda k: small[k * mini : (k + 1) * mini]))[:n] for name, kind, start, n in entries if kind == 2}


def doc_text(content: bytes) -> str:
    """Text of an old Word file by its piece table: 8-bit pieces in cp1252, others in UTF-16."""
    streams = ole_streams(content)
    word = streams["WordDocument"]
    table = streams.get("1Table" if struct.unpack_from("<H", word, 10)[0] & 0x200 else "0Table", b"")
    at, length = struct.unpack_from("<II", word, 0x1A2)
    clx, i = table[at : at + length], 0
    while i < len(clx) and clx[i] == 1:
        i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
    if i >= len(clx) or clx[i] != 2:
        raise ValueError("no piece table")
    n = struct.unpack_from("<I", clx, i + 1)[0]
    pieces = clx[i + 5 : i + 5 + n]
    count = (n - 4) // 12
    ends = struct.unpack_from(f"<{count + 1}I", pieces)
    out = []
    for k in range(count):
        fc = struct.unpack_from("<I", pieces, 4 * (count + 1) + 8 * k + 2)[0]
        chars = ends[k + 1] - ends[k]
        if fc & 0x40000000:
            start = (fc & 0x3FFFFFFF) // 2
            out.append(word[start : start + chars].decode("cp1252", "replace"))
        else:
            out.append(word[fc : fc + 2 * chars].decode("utf-16-le", "replace"))
    return "".join(out).replace("\r", "\n").replace("\x07", "\t")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def runs(frame: DataFrame) -> DataFrame:
    """One row per run of DOCX and PPTX files."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RUNS.split(", ")]
        for df in batches:
            for path, content in zip(df["path"], df["content"], strict=True):
                try:
                    if kind_of(bytes(content)) == "pptx":
                        rows = [(path, a, p, r, None, None, None, None, t, None) for a, p, r, t in pptx_runs(bytes(content))]
                    else:
                        rows = [(path, *x, None) for x in docx_runs(bytes(content))]
                except Exception as e:  # noqa: BLE001  one bad file is one row
                    rows = [(path, *[None] * 8, str(e))]
                yield pd.DataFrame(rows, columns=columns)

    return frame.select("path", "content").mapInPandas(read, RUNS)


def cells(frame: DataFrame) -> DataFrame:
    """One row per text cell of XLSX files."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for path, content in zip(df["path"], df["content"], strict=True):
                try:
                    rows = [(path, *x, None) for x in xlsx_cells(bytes(content))]
                except Exception as e:  # noqa: BLE001  one bad file is one row
                    rows = [(path, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "sheet", "cell", "text", "error"])

    return frame.select("path", "content").mapInPandas(read, "path string, sheet string, cell string, text string, error string")


def _per_file(frame: DataFrame, read_one, schema: str) -> DataFrame:
    """read_one(bytes) per file: its rows behind the path; a file that can't be read has none."""
    names = ["path", *(c.split()[0] for c in schema.split(", "))]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out: list[tuple] = []
            for path, content in zip(df["path"], df["content"], strict=True):
                try:
                    out += [(path, *r) for r in read_one(bytes(content))]
                except Exception:  # noqa: BLE001  a bad file gives no rows
                    continue
            yield pd.DataFrame(out, columns=names)

    return frame.select("path", "content").mapInPandas(read, f"path string, {schema}")


def tables(frame: DataFrame) -> DataFrame:
    """(path, tables) of DOCX files: rows of cells with text, span and whether a cell goes on from the one above."""
    return _per_file(frame, lambda c: [(docx_tables(c),)], "tables array<array<array<struct<text:string,span:int,goes_on:boolean>>>>")


def targets(frame: DataFrame) -> DataFrame:
    """(path, rel, target) of the relationships of DOCX files."""
    return _per_file(frame, lambda c: list(relationships(c).items()), "rel string, target string")


def bundle_parts(frame: DataFrame) -> DataFrame:
    """(path, part, location, type, data) of MIME bundles."""
    return _per_file(frame, lambda c: [(i, *p) for i, p in enumerate(mhtml_parts(c))], "part int, location string, type string, data binary")


def pictures(frame: DataFrame) -> DataFrame:
    """(path, at, kind, data) of the JPEG and PNG streams in files of any kind."""
    return _per_file(frame, lambda c: [(i, *p) for i, p in enumerate(embedded_images(c))], "at int, kind string, data binary")


def page_facts(frame: DataFrame) -> DataFrame:
    """(path, orientation, least_size, frames) of DOCX files: of the last section, the smallest size of text in points, and floating frames and tables."""
    def one(content: bytes) -> list[tuple]:
        package = zipfile.ZipFile(io.BytesIO(content))
        body = ElementTree.fromstring(package.read("word/document.xml"))
        given = ElementTree.fromstring(package.read("word/styles.xml")).find(f"{W}docDefaults//{W}sz") if "word/styles.xml" in package.namelist() else None
        default = float(given.get(f"{W}val")) / 2 if given is not None else 10.0
        sizes = [default if size is None else size for part, *_, size, text in docx_runs(content) if part == "word/document.xml" and text.strip()]
        page = list(body.iter(f"{W}pgSz"))
        floating = sum(1 for tag in ("framePr", "tblpPr") for _ in body.iter(f"{W}{tag}"))
        return [(page[-1].get(f"{W}orient", "portrait") if page else "portrait", min(sizes, default=None), floating)]

    return _per_file(frame, one, "orientation string, least_size double, frames int")


def texts(frame: DataFrame) -> DataFrame:
    """(path, kind, text, was_legacy, error) of any supported file; legacy glyph text is decoded."""
    from docloom.parse.transcode import from_legacy_text

    def one(content: bytes) -> tuple[str, str]:
        kind = kind_of(content)
        if kind == "docx":
            return kind, docx_text(content)
        if kind == "doc":
            return kind, doc_text(content)
        if kind == "xlsx":
            return kind, "\n".join(t for _, _, t in xlsx_cells(content))
        if kind == "pptx":
            return kind, "\n".join(t for *_, t in pptx_runs(content))
        if kind == "mhtml":
            content = next((b for _, t, b in mhtml_parts(content) if t == "text/html"), b"")
        text = content.decode("utf-8-sig", "replace")
        return kind, re.sub(r"<[^>]+>", "", text) if kind in ("mhtml", "html") else text

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for path, content in zip(df["path"], df["content"], strict=True):
                try:
                    kind, text = one(bytes(content))
                    legacy = len(re.findall(r"[¡-ÿƒˆ‘-•‰‹›†‡]", text)) > 20 and len(re.findall(r"[ঀ-৿]", text)) < 5
                    rows.append((path, kind, from_legacy_text(text) if legacy else text, legacy, None))
                except Exception as e:  # noqa: BLE001  one bad file is one row
                    rows.append((path, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "kind", "text", "was_legacy", "error"])

    return frame.select("path", "content").mapInPandas(read, "path string, kind string, text string, was_legacy boolean, error string")


def notices(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of notices, every cell a string, quotes doubled and line feeds inside quotes; rows without a title go."""
    raw = spark.read.csv(path, multiLine=True, quote='"', escape='"', header=False)
    names = ["title", "dept", "org", "category", "date", "link", "badge", "detail", "id", "lang"]
    out = raw.select(*(F.col(c).alias(n) for c, n in zip(raw.columns, names, strict=False)))
    return out.filter((F.coalesce(F.trim("title"), F.lit("")) != "") & ~F.lower("title").isin("title", "শিরোনাম"))


def first_of(*loaders) -> DataFrame:
    """The first source that opens and has rows; the last one's error if none does."""
    error = None
    for load in loaders:
        try:
            df = load()
            if not df.isEmpty():
                return df
        except Exception as e:  # noqa: BLE001  the next source is tried
            error = e
    raise error or ValueError("no source has rows")


def css_rules(column):
    """Selectors and declarations of a style sheet as array<struct<selector,body>>."""
    rule = r"([^{}]+)\{([^{}]*)\}"
    return F.transform(F.regexp_extract_all(column, F.lit(rule), F.lit(0)), lambda m: F.struct(F.trim(F.regexp_extract(m, rule, 1)).alias("selector"), F.trim(F.regexp_extract(m, rule, 2)).alias("body")))


def declared(body):
    """Declarations as a map, names in lower case."""
    parts = F.filter(F.transform(F.split(body, ";"), lambda c: F.trim(c)), lambda p: p.contains(":"))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))), F.trim(F.regexp_replace(p, "^[^:]*:", "")))))


def resolved(parent, tag, klass, inline):
    """Styles in rising order of precedence: parent, tag, class, inline."""
    empty = F.create_map().cast("map<string,string>")
    out = F.coalesce(parent, empty)

    def over(lower, upper):
        return F.map_concat(F.map_filter(lower, lambda k, _: ~F.map_contains_key(upper, k)), upper)

    for more in (tag, klass, inline):
        out = over(out, F.coalesce(more, empty))
    return out


def tagged(row):
    """A struct column as typed JSON: every field an object of its type and value."""
    kinds = {"string": "stringValue", "bigint": "integerValue", "int": "integerValue", "double": "doubleValue", "boolean": "booleanValue"}
    return lambda df: F.to_json(F.struct(F.struct(*(F.struct(F.col(f"{row}.{n}").alias(kinds.get(t, "stringValue"))).alias(n) for n, t in df.select(f"{row}.*").dtypes)).alias("fields")))


def untagged(json, names: list[str]):
    """Values of typed JSON as strings."""
    value = lambda n: F.coalesce(*(F.get_json_object(json, f"$.fields.{n}.{k}") for k in ("stringValue", "integerValue", "doubleValue", "booleanValue", "timestampValue")))
    return F.struct(*(value(n).alias(n) for n in names))
