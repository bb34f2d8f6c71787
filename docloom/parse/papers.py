"""Exam papers, blocks and layout tags as nested values; one Arrow UDF per parser.

A parser takes a text and never fails a job: what it can't read becomes an ``error`` beside empty fields.
Fields are strings in the digits of the source; marks that a text doesn't state stay empty.
"""

from __future__ import annotations

import json
import re

from docloom.parse.udfs import over_text

DIGIT = "0-9০-৯"
LABEL = "কখগঘঙচ"
QUESTION = re.compile(rf"^(?:>\s*)?(?:#{{1,6}}\s*)?(?:প্রশ্ন[\s\-–—:ঃ.]*)?([{DIGIT}]+)[।.)]\s*(.*)$")
HEADING = re.compile(r"^(?:#{1,6}\s*)?(?:[কখগঘ]\s*[-–—]?\s*)?(?:বিভাগ|অংশ|সৃজনশীল\s*প্রশ্ন|সংক্ষিপ্ত(?:-উত্তর)?\s*প্রশ্ন|বহুনির্বাচন[িী]|নৈর্ব্যক্তিক|section\b|part\b|MCQ\b)", re.I)
SHARED = re.compile(r"^নিচের\s*(?:উদ্দীপক|অনুচ্ছেদ|তথ্য|ছক|চিত্র)")
STIMULUS = re.compile(rf"^[\[(]\s*(?:নিচের\s+)?উদ্দীপক\s*[#:ঃ]?\s*([{DIGIT}]*)\s*[\])]\s*(.*)$")
STIMULUS_LINE = re.compile(rf"^উদ্দীপক\s*[:ঃ]\s*([{DIGIT}]+)()\s*$")
OR_LINE = re.compile(r"^[\-–—\s]*(?:অথবা|বিকল্প\s*প্রশ্ন)[\-–—,ঃ:\s]*$")
STATEMENT = re.compile(r"^\(?(i{1,3}|iv|v)[.)]\s*(.+)$", re.I)
# Labels of parts and options with the signs behind them, and the words around a mark.
PARTS, CHOICES = ("কখগঘ", ".:।-"), ("কখগঘa-dA-D", ".)")
MARK_NAMES, MARK_UNITS = ("মান", "মার্ক"), ("নম্বর", "মার্ক", "মান")
NUMBER = re.compile(f"[{DIGIT}]+")


def label_pattern(kind: tuple[str, str], before: str) -> re.Pattern:
    labels, signs = kind
    return re.compile(rf"(?:{before})([{labels}])[{re.escape(signs)}]\s*")


PART = label_pattern(PARTS, r"^|\t| {2,}")
OPTION = label_pattern(CHOICES, r"(?:^|\s)\(?")


def labelled(line: str, pattern: re.Pattern, visible: str | None = None) -> tuple[int, list[tuple[str, str]]]:
    """Where the first label of a line stands (-1 without one), and each label with the text up to the next one. Labels are looked for in ``visible``."""
    found = list(pattern.finditer(line if visible is None else visible))
    if not found:
        return -1, []
    ends = [m.start() for m in found[1:]] + [len(line)]
    return found[0].start(), [(m[1], line[m.end() : end].strip()) for m, end in zip(found, ends, strict=True)]


def mark_tail(text: str) -> tuple[str, str]:
    """A text without the mark that it states at its end, and that mark: a last word that is a number, maybe in brackets, behind a name or before a unit."""
    words = text.split()
    bare = lambda w: w.strip("()[]").rstrip(":ঃ")
    taken = int(len(words) > 1 and bare(words[-1]) in MARK_UNITS)
    number = bare(words[-1 - taken]) if len(words) > taken else ""
    for name in MARK_NAMES:
        number = number.removeprefix(name).lstrip(":ঃ")
    if not NUMBER.fullmatch(number):
        return text.strip(), ""
    taken += 1
    taken += int(len(words) > taken and bare(words[-1 - taken]) in MARK_NAMES)
    return (text.strip().rsplit(None, taken)[0], number) if len(words) > taken else (text.strip(), "")


def sub_parts(line: str) -> list[dict]:
    """Labelled parts of a line that begins with one; a label stands at the start, behind a tab or behind two spaces."""
    at, found = labelled(line, PART)
    parts_ = [{"label": label, **dict(zip(("text", "mark"), mark_tail(body), strict=True))} for label, body in found]
    return [p for p in parts_ if p["text"]] if at == 0 else []


def options(line: str) -> list[dict]:
    """Labelled options of a line; labels inside maths don't count."""
    masked = re.sub(r"\$[^$]*\$|\\\(.*?\\\)", lambda m: "\0" * len(m[0]), line)
    return [{"label": label, "text": body} for label, body in labelled(line, OPTION, masked)[1]]


def header(lines: list[str]) -> tuple[dict, int]:
    """Header fields from the first eight lines, and where the body begins."""
    out = dict.fromkeys(("institute", "location", "exam", "classAndSubject", "examType", "time", "marks", "instructions"), "")
    body = 0
    for i, line in enumerate(lines[:8]):
        clean = re.sub(r"^[*#\-\s]+", "", line).strip()
        if QUESTION.match(clean) or re.match(r"^(?:[কখগঘ]|[a-dA-D])[.:।)\-\]]", clean) or STIMULUS.match(clean) or STIMULUS_LINE.match(clean):
            break
        time = re.search(rf"(?:সময়|time)\s*[ঃ:\-]\s*(.+?)\s*(?:\||;|\s{{2,}}|পূর্ণমান|মান|(?:full\s*)?marks|$)", clean, re.I)
        marks = re.search(rf"(?:পূর্ণমান|মান|marks)\s*[ঃ:\-]?\s*([{DIGIT}]+)", clean, re.I)
        if not out["institute"] and re.search(r"স্কুল|কলেজ|মাদরাসা|বিদ্যালয়|একাডেমী|প্রতিষ্ঠান|\b(?:school|college|academy|university|institute)\b", clean, re.I):
            out["institute"] = clean
        elif time or (marks and not HEADING.match(line)):
            out["time"] = out["time"] or (time[1].strip() if time else "")
            out["marks"] = out["marks"] or (marks[1] if marks else "")
        elif not out["exam"] and re.search(r"পরীক্ষা|মূল্যায়ন|সেমিস্টার|নির্বাচনী|\b(?:examination|test)\b", clean, re.I):
            out["exam"] = clean
        elif re.search(r"শ্রেণি|বিষয়|^(?:class|subject)\s*[:\-]", clean, re.I):
            out["classAndSubject"] = " | ".join(x for x in (out["classAndSubject"], clean) if x)
        elif clean.startswith("[") and clean.endswith("]") or clean.startswith("বিশেষ দ্রষ্টব্য"):
            out["instructions"] = clean
        elif not out["location"] and re.search(r"উপজেলা|জেলা|ঢাকা|থানা", clean):
            out["location"] = clean
        else:
            continue
        body = i + 1
    return out, body


class Paper:
    """Sections and questions of a body, line by line."""

    def __init__(self, choice: bool = False) -> None:
        self.sections: list[dict] = []
        self._choice, self._named = choice, choice
        self._section = {"title": "", "marks": "", "questions": []}
        self._question: dict | None = None
        self._shared, self._stimulus, self._open = "", "", False

    def _close_question(self) -> None:
        q = self._question
        if q:
            parts_ = q["subQuestions"]
            # four short labels without marks or a stimulus are options, whatever sign follows the label
            plain = len(parts_) == 4 and not q["options"] and not q["stimulus"] and not q["preContext"] and all(not p["mark"] and not p["isAlternative"] and len(p["text"]) < 60 and not p["text"].endswith(("?", "।")) for p in parts_)
            if plain and [p["label"] for p in parts_] == list("কখগঘ"):
                q["options"], q["subQuestions"] = [{"label": p["label"], "text": p["text"]} for p in parts_], []
            self._section["questions"].append(q)
        self._question = None

    def _close_section(self) -> None:
        self._close_question()
        if self._section["questions"] or self._section["title"]:
            self.sections.append(self._section)

    def _begin_section(self, line: str) -> None:
        title = re.sub(r"^[#*\s]+|[*\s]+$", "", line)
        tail = re.search(rf"(?:মান|মার্ক)[ঃ:]\s*([{DIGIT}]+)\s*$", title)
        title = title[: tail.start()].rstrip(" ,;:।-–") if tail else title
        bare = lambda t: re.sub(r"[#*_\s:ঃ।.\-–—]+", "", t)
        self._close_question()
        if self._section["questions"] and bare(title) == bare(self._section["title"]) != "":
            return
        self._close_section()
        self._choice = bool(re.search(r"বহুনির্বাচন|নৈর্ব্যক্তিক|\bMCQ\b|multiple[\s-]*choice", title, re.I)) or (self._named and not re.search(r"সৃজনশীল|সংক্ষিপ্ত|creative|short", title, re.I))
        self._section = {"title": title, "marks": tail[1] if tail else "", "questions": []}

    def _begin_question(self, number: str, text: str) -> None:
        q = self._question
        again = re.match(rf"^([{LABEL}])[.ঃ।\-–—]\s*(.+)$", text)
        if q and q["num"] == number and again:
            self._part(again[1], again[2])
            return
        self._close_question()
        self._question = {"num": number, "text": text.strip(), "preContext": self._shared, "stimulus": self._stimulus, "statements": [], "subQuestions": [], "options": []}
        self._shared = self._stimulus = ""
        self._open = False
        if again and not self._choice and not OPTION.search(text[1:]):
            self._question["text"] = ""
            self._part(again[1], again[2])
        elif SHARED.match(text) and not self._question["stimulus"]:
            self._question["stimulus"], self._question["text"] = text.strip(), ""

    def _part(self, label: str, text: str, alternative: bool = False) -> None:
        body, mark = mark_tail(text)
        self._question["subQuestions"].append({"label": label, "text": body, "mark": mark, "isAlternative": alternative})

    def line(self, line: str) -> None:
        m = STIMULUS.match(line) or STIMULUS_LINE.match(line)
        if m:
            self._stimulus = "\n".join(x for x in (f"উদ্দীপক {m[1]}" if m[1] else "", m[2].strip()) if x)
            self._open = True
            return
        question = QUESTION.match(line)
        heading = not question and HEADING.match(line) and len(line) < 100
        if self._open and not question and not heading:
            self._stimulus = "\n".join(x for x in (self._stimulus, line) if x)
            return
        self._open = False
        if heading:
            self._begin_section(line)
        elif SHARED.match(line) and not question:
            self._close_question()
            self._shared = "\n".join(x for x in (self._shared, line) if x)
        elif question:
            self._begin_question(question[1], question[2])
        elif self._question is None:
            if self._shared:
                self._shared += "\n" + line
        elif OR_LINE.match(line):
            self._question["subQuestions"].append({"label": "", "text": "অথবা", "mark": "", "isAlternative": True})
        else:
            self._inside(line)

    def _inside(self, line: str) -> None:
        q = self._question
        statement = STATEMENT.match(line)
        opts = options(line)
        parts = sub_parts(line)
        if opts and parts and not self._choice and not q["options"] and not "কখগঘ".startswith("".join(o["label"] for o in opts)):
            # labels that don't follow one another are abbreviations inside a part
            opts = []
        short = opts and all(len(o["text"]) < 70 and not mark_tail("x " + o["text"])[1] for o in opts)
        if statement:
            q["statements"].append(line)
        elif self._choice and opts and OPTION.match(line):
            q["options"] += opts
        elif self._choice and q["options"]:
            q["options"][-1]["text"] += " " + line
        elif opts and not line[: 1].isspace() and OPTION.match(line) and (len(opts) > 1 or q["options"] or short) and not q["subQuestions"] and (len(opts) > 1 or not parts or q["options"] or ")" in line[:3]):
            q["options"] += opts
        elif parts:
            for p in parts:
                q["subQuestions"].append({**p, "isAlternative": False})
        elif re.match(rf"^\(?([{LABEL}])[.)।]\s*", line):
            label = re.match(rf"^\(?([{LABEL}])[.)।]\s*(.*)$", line)
            self._part(label[1], label[2])
        elif not self._choice and not q["options"] and (english := re.match(r"^\(\s*([a-h])\s*\)\s*(.+)$", line)):
            self._part(english[1], english[2])
        elif q["subQuestions"]:
            q["subQuestions"][-1]["text"] += " " + line
        else:
            q["text"] = "\n".join(x for x in (q["text"], line) if x)

    def done(self) -> list[dict]:
        self._close_section()
        return self.sections


def paper(text: str) -> dict:
    """Header and sections of an exam paper."""
    try:
        text = re.sub(r"(?im)^\s*\[LAYOUT:[^\]]*\]\s*", "", text.replace("\u09af\u09bc", "\u09df").replace("\u09a1\u09bc", "\u09dc").replace("\u09a2\u09bc", "\u09dd").replace("\r\n", "\n").replace("\r", "\n").replace("\f", "\n"))
        front = re.match(r"\A\s*---\n(.*?)\n---\n", text, re.S)
        text = text[front.end() :] if front else text
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        head, body = header(lines)
        p = Paper(bool(front and re.search(r"(?im)^\s*(?:doc_type|type|layout)\s*:.*MCQ", front[1])))
        for x in lines[body:]:
            p.line(x)
        return {"error": None, "header": head, "sections": p.done()}
    except Exception as e:  # noqa: BLE001  a text that can't be read is a row with an error
        return {"error": str(e), "header": None, "sections": []}


HEADER_TYPE = "struct<institute:string,location:string,exam:string,classAndSubject:string,examType:string,time:string,marks:string,instructions:string>"
SECTION_TYPE = "struct<title:string,marks:string,questions:array<struct<num:string,text:string,preContext:string,stimulus:string,statements:array<string>,subQuestions:array<struct<label:string,text:string,mark:string,isAlternative:boolean>>,options:array<struct<label:string,text:string>>>>>"
PAPER_TYPE = f"struct<error:string,header:{HEADER_TYPE},sections:array<{SECTION_TYPE}>>"


def split_combined(text: str) -> dict:
    """A paper of two parts at its multiple-choice heading or section break."""
    lines = text.split("\n")
    at = next((i for i, x in enumerate(lines) if re.search(r"---\s*SECTION_?BREAK", x, re.I) or (len(x) < 80 and re.match(r"^[#*\s]*(?:[কখগঘ]\s*[-–—]?\s*(?:বিভাগ|অংশ)\s*[:ঃ\-–—(]?\s*)?(?:বহুনির্বাচন[িী]|নৈর্ব্যক্তিক|MCQ\b|multiple[\s-]*choice)", x, re.I) and i)), None)
    return {"cq": text, "mcq": None} if at is None else {"cq": "\n".join(lines[:at]).strip(), "mcq": "\n".join(lines[at + ("SECTION" in lines[at].upper()) :]).strip()}


def nested(text: str) -> list[dict]:
    """Primary papers: numbered questions with bracketed items, and the lettered items under those."""
    out: list[dict] = []
    for line in (x.strip() for x in text.split("\n") if x.strip()):
        item, letter, number = re.match(rf"^\(([{DIGIT}]{{1,2}})\)\s*(.*)$", line), re.match(r"^\(?([ক-ঞ])\s*[.)।]\s*(.*)$", line), QUESTION.match(line)
        if item and out:
            out[-1]["items"].append({"label": item[1], "text": item[2], "letters": []})
        elif letter and out and out[-1]["items"]:
            out[-1]["items"][-1]["letters"].append({"label": letter[1], "text": letter[2]})
        elif number:
            out.append({"num": number[1], "text": number[2], "items": []})
        elif letter and out:
            out[-1]["items"].append({"label": letter[1], "text": letter[2], "letters": []})
        elif out:
            out[-1]["text"] = "\n".join(x for x in (out[-1]["text"], line) if x)
    return out


def markdown_blocks(text: str) -> list[dict]:
    """Headings, tables, lists and paragraphs in order; table rows as cells."""
    out: list[dict] = []
    cells = lambda x: [c.strip() for c in re.split(r"\|(?=(?:[^$]*\$[^$]*\$)*[^$]*$)", x.strip().strip("|"))]
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            out.append({"type": "gap"})
        elif re.match(r"^\|[\s:|-]+\|$", s):
            continue
        elif s.startswith("|") and s.endswith("|"):
            if not out or out[-1]["type"] != "table":
                out.append({"type": "table", "rows": [], "text": ""})
            out[-1]["rows"].append(cells(s))
        elif h := re.match(r"^(#{1,6})\s+(.*)$", s):
            out.append({"type": "heading", "level": len(h[1]), "text": h[2].strip()})
        elif li := re.match(rf"^(?:[-*•]|[{DIGIT}]+[.)।])\s+(.*)$", s):
            if not out or out[-1]["type"] != "list":
                out.append({"type": "list", "items": [], "text": ""})
            out[-1]["items"].append(li[1])
        elif out and out[-1]["type"] == "para":
            out[-1]["text"] += "\n" + s
        else:
            out.append({"type": "para", "text": s})
    return [{"type": b["type"], "level": b.get("level"), "text": b.get("text", ""), "items": b.get("items", []), "rows": b.get("rows", [])} for b in out if b["type"] != "gap"]


BLOCK_TYPE = "array<struct<type:string,level:int,text:string,items:array<string>,rows:array<array<string>>>>"
ROLE_OF = {"heading": "title", "para": "paragraph", "list": "list", "table": "table"}


def document(text: str) -> list[dict]:
    """Markdown as model blocks: role, text, rows padded to a rectangle."""
    out = []
    for i, b in enumerate(markdown_blocks(text)):
        width = max(map(len, b["rows"]), default=0)
        out.append({"idx": i, "role": ROLE_OF[b["type"]], "level": b["level"], "text": "\n".join(b["items"]) if b["items"] else b["text"], "rows": [[*r, *[""] * (width - len(r))] for r in b["rows"]]})
    return out


def parts(text: str) -> list[dict]:
    """A draft as typed parts: label and value, table, heading, list or paragraph."""
    out = []
    for b in markdown_blocks(text):
        if b["type"] != "para":
            out.append({"kind": b["type"], "key": None, "text": "\n".join(b["items"]) or b["text"], "rows": b["rows"]})
            continue
        for line in b["text"].split("\n"):
            kv = re.match(r"^\**([^:ঃ|]{1,40}?)\**\s*[:ঃ]\**\s*(.+)$", line)
            out.append({"kind": "kv" if kv else "para", "key": re.sub(r"\s+", "", kv[1]).lower() if kv else None, "text": kv[2] if kv else line, "rows": []})
    return [{"idx": i, **p} for i, p in enumerate(out)]


TAG = re.compile(r"\[\[B:([^\]]*)\]\](.*?)(?=\[\[B:|\Z)", re.S)


def layout_tags(text: str) -> list[dict]:
    """[[B:t=..;p=..;box=..]] blocks with their text; a block without a page is on that of the one before."""
    out, page = [], 1
    for i, m in enumerate(TAG.finditer(text)):
        attrs = dict(x.split("=", 1) for x in m[1].split(";") if "=" in x)
        page = int(attrs["p"]) if attrs.get("p", "").isdigit() else page
        try:
            box = [float(v) for v in attrs["box"].split(",")]
        except (KeyError, ValueError):
            box = None
        body = m[2].strip("\n")
        out.append({"page": page, "idx": i, "type": attrs.get("t", "paragraph"), "box": box if box and len(box) == 4 else None, "align": attrs.get("al"), "bold": attrs.get("b") == "1", "text": body, "lines": body.split("\n")})
    return out


TAG_TYPE = "array<struct<page:int,idx:int,type:string,box:array<double>,align:string,bold:boolean,text:string,lines:array<string>>>"


def continued(before: str, after: str) -> str:
    """A continuation put behind a text; the text's last block goes if the continuation begins by restating it."""
    a, b = layout_tags(before), layout_tags(after)
    if a and b and (a[-1]["page"], a[-1]["type"]) == (b[0]["page"], b[0]["type"]):
        x, y = (re.sub(r"\s+", " ", t["text"]).strip() for t in (a[-1], b[0]))
        n = min(40, len(x), len(y))
        if n and x[:n] == y[:n]:
            before = before[: before.rindex("[[B:")]
    return before.rstrip("\n") + "\n" + after


def numbered_figures(text: str, first: int = 1) -> str:
    """Figure tags as numbered markers, in order."""
    count = iter(range(first, 1 << 30))
    return re.sub(r"\[\[FIG:[^\]]*\]\]", lambda _: f"[[FIGURE-{next(count)}]]", text)


def placed_figures(text: str) -> str:
    """A bare number line, then tags or blank lines, then a text line, as one line: number, text, tags."""
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        if re.fullmatch(rf"\s*[{DIGIT}]+[.)।]\s*", lines[i]):
            j, tags = i + 1, []
            while j < len(lines) and (not lines[j].strip() or re.fullmatch(r"\s*(?:\[\[FIG:[^\]]*\]\]\s*)+", lines[j])):
                tags += re.findall(r"\[\[FIG:[^\]]*\]\]", lines[j])
                j += 1
            if tags and j < len(lines):
                out.append(" ".join([lines[i].strip(), lines[j].strip(), *tags]))
                i = j + 1
                continue
        out.append(lines[i])
        i += 1
    return "\n".join(out)


def rich_runs(text: str) -> list[dict]:
    """Inline bold, italic and maths runs."""
    out = []
    for bold, italic, math, plain in re.findall(r"\*\*(.+?)\*\*|\*([^*\n]+)\*|(\$[^$\n]+\$)|((?:(?!\*\*.+?\*\*|\*[^*\n]+\*|\$[^$\n]+\$).)+)", text, re.S):
        out.append({"text": bold or italic or math.strip("$") or plain, "bold": bool(bold), "italic": bool(italic), "math": bool(math)})
    return out


def clean_response(text: str) -> str:
    """A recognition answer without code fences, page markers, manifests and tripled blank lines; roman labels repaired."""
    text = re.sub(r"^\s*```[a-zA-Z]*\n|\n```\s*$", "", text)
    text = re.sub(r"(?im)^\s*(?:---|\[)\s*(?:page|পৃষ্ঠা)\s*[-:]?\s*[0-9০-৯]+\s*(?:---|\])\s*$\n?", "", text)
    text = re.sub(r"(?is)<!--\s*MANIFEST.*?-->", "", text)
    for bad, good in (("lll", "iii"), ("ll", "ii"), ("l", "i")):
        text = re.sub(rf"(?m)^(\s*){bad}[.)](?=\s)", rf"\1{good}.", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def tokens(text: str) -> list[str]:
    """Words that keep a script together: combining signs never start one."""
    return re.findall("[ঀ-৿‌‍]+|[A-Za-z0-9]+|\\s+|.", text, re.S)


def rebreak(words: list[str], widths: list[float], lines: int, space: float = 1.0) -> list[str]:
    """Words in exactly so many lines (fewer if there are fewer words) with the least sum of squared slack."""
    n = len(words)
    lines = max(1, min(lines, n))
    total = [0.0]
    for w in widths:
        total.append(total[-1] + w)
    goal = (total[-1] + space * (n - lines)) / lines if n else 0.0
    best = {(0, 0): (0.0, -1)}
    for k in range(1, lines + 1):
        for j in range(k, n + 1):
            options_ = [(best[k - 1, i][0] + (total[j] - total[i] + space * (j - i - 1) - goal) ** 2, i) for i in range(k - 1, j) if (k - 1, i) in best]
            if options_:
                best[k, j] = min(options_)
    out, j = [], n
    for k in range(lines, 0, -1):
        i = best[k, j][1] if n else 0
        out.append(" ".join(words[i:j]))
        j = i
    return out[::-1]


def edited(data: dict, edits: list[tuple[str, str]]) -> dict:
    """Edits (path such as sections.0.questions.1.text, value) applied in order to a copy; unknown paths are left out."""
    import copy

    out = copy.deepcopy(data)
    for path, value in edits:
        *way, last = (int(p) if p.isdigit() else p for p in path.split("."))
        at = out
        try:
            for p in way:
                at = at[p]
            at[last] = value if (isinstance(last, int) and 0 <= last < len(at)) or last in at else at[last]
        except (KeyError, IndexError, TypeError):
            continue
    return out


# Fixed values of merged answers: the note of an audit, a figure's page, and what stands for a part that failed.
AUDIT = re.compile(r"\[এআই অডিট নোট ও পরিবর্তনসমূহ:.*?\]", re.S)
FIGURE_PAGE = re.compile(r"(\[\[\s*FIG\s*:\s*p\s*=\s*)(\d+)", re.I)
FAILED = "[অসম্পূর্ণ: ভাগ {k}/{n}{pages} ব্যর্থ হয়েছে — {why}। বাকি ভাগের ফলাফল সংরক্ষিত আছে।]"
NUMBERED = re.compile(rf"^( *)([{DIGIT}]+)(।|\.[ \t]+|\)[ \t]+)")
BENGALI_DIGITS = str.maketrans("0123456789", "০১২৩৪৫৬৭৮৯")
FRONT = re.compile(r"\A\s*---[^\S\n]*\n.*?\n---[^\S\n]*(?:\n|\Z)", re.S)


def renumbered_lines(lines: list[str]) -> list[str]:
    """Questions numbered through each section in the digits that most of it has; a heading that its own section repeats goes."""
    sections: list[dict] = [{"title": "", "at": []}]
    gone = set()
    for i, line in enumerate(lines):
        s = line.strip()
        heading = " ".join(s[2:].split()) if re.match(r"##\s+\S", s) else s if s.upper().startswith("---SECTION_BREAK:") else None
        if heading is not None:
            if not sections[-1]["at"]:
                sections[-1]["title"] = heading
            elif heading != sections[-1]["title"] or heading.startswith("---"):
                sections.append({"title": heading, "at": []})
            else:
                gone.add(i)
        elif not re.match(r"---|\*\*\*|={3,}|<!--|\||\f", s) and NUMBERED.match(line):
            sections[-1]["at"].append(i)
    out = list(lines)
    for section in sections:
        digits = "".join(NUMBERED.match(lines[i])[2] for i in section["at"])
        bengali = 2 * sum(c > "9" for c in digits) >= len(digits)
        for n, i in enumerate(section["at"], 1):
            m = NUMBERED.match(lines[i])
            out[i] = m[1] + (str(n).translate(BENGALI_DIGITS) if bengali else str(n)) + m[3] + lines[i][m.end() :]
    return [x for i, x in enumerate(out) if i not in gone]


def merged_answer(chunks: list[dict]) -> str:
    """The answers to a document's parts (text, first, last, error) in order as one text.

    The first frontmatter stays, figures are on the document's pages, the title stands once, questions of exams are numbered
    through, the last audit note ends the text, and a part that failed leaves a line.
    """
    front, bodies, notes = "", [], []
    for k, c in enumerate(chunks):
        if c["text"] is None:
            pages = "" if c["first"] is None or c["last"] is None else f" (পৃষ্ঠা {c['first']}–{c['last']})"
            bodies.append(FAILED.format(k=k + 1, n=len(chunks), pages=pages, why=c["error"] or "সার্ভার ত্রুটি").translate(BENGALI_DIGITS))
            continue
        own = FRONT.match(c["text"])
        front = front or (own[0].strip() if own else "")
        body = c["text"][own.end() :] if own else c["text"]
        notes += AUDIT.findall(body)
        body = AUDIT.sub("", body)
        if (c["first"] or 1) > 1:
            body = FIGURE_PAGE.sub(lambda m, more=c["first"] - 1: m[1] + str(int(m[2]) + more), body)
        body = re.sub(r"\A\s*#\s+[^\n]+(?:\n|\Z)", "", body) if k else body
        if body.strip("\r\n"):
            bodies.append(body.strip("\r\n"))
    text = "\n\n".join(bodies)
    kind = re.search(r"doc_type:\s*([\w-]+)", front)
    if not kind or kind[1].upper().startswith("EXAM"):
        text = "\n".join(renumbered_lines(text.split("\n")))
    return "\n".join(x for x in (front, "\n\n".join(x for x in (text, *notes[-1:]) if x)) if x)


def merged_answers(chunks, key: str, order: str):
    """(key, merged) of rows (key, order, text, first, last, error); a document's parts are few and are read by one task."""
    import pandas as pd

    kind = dict(chunks.dtypes)[key]

    def run(df: pd.DataFrame) -> pd.DataFrame:
        held = df.sort_values(order)[["text", "first", "last", "error"]].astype(object)
        held = held.where(held.notna(), None).to_dict("records")
        return pd.DataFrame({key: [df[key].iloc[0]], "merged": [merged_answer(held)]})

    return chunks.select(key, order, "text", "first", "last", "error").groupBy(key).applyInPandas(run, f"`{key}` {kind}, merged string")


parse_paper = over_text(paper, PAPER_TYPE)
parse_options = over_text(options, "array<struct<label:string,text:string>>")
parse_sub_parts = over_text(sub_parts, "array<struct<label:string,text:string,mark:string>>")
parse_blocks = over_text(markdown_blocks, BLOCK_TYPE)
parse_document = over_text(document, "array<struct<idx:int,role:string,level:int,text:string,rows:array<array<string>>>>")
parse_parts = over_text(parts, "array<struct<idx:int,kind:string,key:string,text:string,rows:array<array<string>>>>")
parse_tags = over_text(layout_tags, TAG_TYPE)
parse_nested = over_text(nested, "array<struct<num:string,text:string,items:array<struct<label:string,text:string,letters:array<struct<label:string,text:string>>>>>>")
parse_runs = over_text(rich_runs, "array<struct<text:string,bold:boolean,italic:boolean,math:boolean>>")
parse_combined = over_text(split_combined, "struct<cq:string,mcq:string>")
clean = over_text(clean_response, "string")
mark_figures, place_figures = over_text(numbered_figures, "string"), over_text(placed_figures, "string")
word_tokens = over_text(tokens, "array<string>")
parse_mark = over_text(lambda t: dict(zip(("text", "mark"), mark_tail(t), strict=True)), "struct<text:string,mark:string>")
continue_text = over_text(continued, "string")
broken_lines = over_text(lambda r: rebreak(r["words"], r["widths"], r["lines"]), "array<string>")
edit_json = over_text(lambda r: json.dumps(edited(json.loads(r["data"]), [(e["path"], e["value"]) for e in r["edits"]]), ensure_ascii=False), "string")
