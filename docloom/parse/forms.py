"""Business documents as label, value and table records: memos, receipts, admit cards, CVs, deeds, certificates,
applications, routines. Each type is a declaration; one engine reads the lines of all of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from docloom.parse.papers import markdown_blocks
from docloom.parse.udfs import over_text


@dataclass(frozen=True)
class Form:
    """Labels by field, headings that begin a section, and a name for the first free lines."""

    fields: dict[str, str]
    sections: tuple[str, ...] = ()
    heads: tuple[str, ...] = ("institute", "title")
    required: tuple[str, ...] = field(default=())


# The labels that documents use.
FORMS = {
    "CASH_MEMO": Form({"number": "মেমো নং|ক্রমিক নং|নং|no", "date": "তারিখ|date", "name": "নাম|ক্রেতার নাম|name", "address": "ঠিকানা|address", "phone": "মোবাইল|ফোন|phone", "total": "সর্বমোট|মোট|total", "in_words": "কথায়|in words"}),
    "RECEIPT": Form({"number": "রসিদ নং|ভাউচার নং|নং|no", "date": "তারিখ|date", "received_from": "প্রদানকারী|প্রাপক|গ্রহীতা|received from|নাম", "amount": "টাকার পরিমাণ|টাকা|amount", "purpose": "বাবদ|উদ্দেশ্য|purpose", "in_words": "কথায়|in words"}),
    "ADMIT_CARD": Form({"exam": "পরীক্ষা|পরীক্ষার নাম|exam", "name": "পরীক্ষার্থীর নাম|শিক্ষার্থীর নাম|নাম|name", "father": "পিতার নাম", "mother": "মাতার নাম", "class": "শ্রেণি|class", "roll": "রোল|রোল নং|roll", "section": "শাখা", "year": "সাল|বর্ষ"}, required=("name", "roll")),
    "CV_RESUME": Form({"name": "নাম|name", "father": "পিতার নাম", "mother": "মাতার নাম", "birth": "জন্ম তারিখ|date of birth", "address": "ঠিকানা|বর্তমান ঠিকানা|স্থায়ী ঠিকানা|address", "phone": "মোবাইল|ফোন|phone|mobile", "email": "ইমেইল|ই-মেইল|email"}, ("শিক্ষাগত যোগ্যতা", "অভিজ্ঞতা", "দক্ষতা", "ব্যক্তিগত তথ্য", "রেফারেন্স", "education", "experience", "skills", "references"), ("title",), ("name",)),
    "STAMP_DEED": Form({"first_party": "১ম পক্ষ|প্রথম পক্ষ", "second_party": "২য় পক্ষ|দ্বিতীয় পক্ষ", "date": "তারিখ", "amount": "টাকা|মূল্য"}, ("তফসিল", "শর্তাবলী", "শর্তসমূহ", "সাক্ষী"), ("title",)),
    "PROTTOYON": Form({"memo": "স্মারক নং|স্মারক|সূত্র", "date": "তারিখ", "name": "নাম", "father": "পিতা|পিতার নাম", "mother": "মাতা|মাতার নাম", "address": "ঠিকানা|গ্রাম"}),
    "GOVT_APP": Form({"date": "তারিখ", "to": "বরাবর", "subject": "বিষয়", "through": "মাধ্যম", "applicant": "নিবেদক|বিনীত"}, heads=(), required=("subject",)),
}


#: What stands for a value to be filled in by hand, and lines of signatures.
BLANK, SIGNED = re.compile(r"[.…_\-–—\s]*"), re.compile("স্বাক্ষর|signature", re.I)


def parse(kind: str, text: str) -> dict:
    """Fields, heading lines, sections, tables and signatures of a document of one kind; paragraphs in between are its body.

    A field whose value is a line to be filled in takes none, nor what stands on the next line.
    """
    form = FORMS[kind]
    text = text.replace("\u09af\u09bc", "\u09df").replace("\u09a1\u09bc", "\u09dc").replace("\u09a2\u09bc", "\u09dd")
    text = re.sub(r"\A\s*---\n.*?\n---\n", "", text, flags=re.S)
    names = {alias.strip().lower(): f for f, aliases in form.fields.items() for alias in aliases.split("|")}
    out: dict = {"fields": {}, "heads": [], "sections": [], "tables": [], "body": [], "signs": []}
    waiting = None
    for b in markdown_blocks(text):
        if b["type"] == "table":
            out["tables"].append(b["rows"])
            continue
        for line in (b["items"] or b["text"].split("\n")):
            plain = re.sub(r"[*#]+", "", line).strip()
            pairs = re.findall(r"([^:ঃ\t]{1,30}?)\s*[:ঃ]\s*(.*?)(?=\s{2,}|\t|$)", plain)
            known = [(names[k.strip().lower()], v.strip()) for k, v in pairs if k.strip().lower() in names]
            known = [(f, "" if BLANK.fullmatch(v) else v) for f, v in known]
            if not known and SIGNED.search(plain):
                out["signs"] += [x.strip() for x in re.split(r"\t+|\s{3,}|\|", line) if x.strip()]
            elif any(plain.rstrip(":ঃ ").lower() == s for s in form.sections):
                out["sections"].append({"title": plain.rstrip(":ঃ "), "lines": []})
            elif known:
                for f, v in known:
                    out["fields"].setdefault(f, v)
                waiting = known[-1][0] if not known[-1][1] and plain.rstrip()[-1:] in ":ঃ" else None
            elif plain.rstrip(",") in names:
                waiting = names[plain.rstrip(",")]
            elif waiting:
                out["fields"][waiting] = plain
                waiting = None
            elif out["sections"]:
                out["sections"][-1]["lines"].append(plain)
            elif len(out["heads"]) < len(form.heads) and not out["fields"]:
                out["heads"].append(plain)
            else:
                out["body"].append(plain)
    for name, value in zip(form.heads, out["heads"], strict=False):
        out["fields"].setdefault(name, value)
    missing = next((f for f in form.required if not out["fields"].get(f)), None)
    return {"doc_type": kind, "fields": {k: v for k, v in out["fields"].items() if v}, "sections": out["sections"], "tables": out["tables"], "body": "\n".join(out["body"]), "signs": out["signs"], "missing": missing}


def routine(text: str) -> dict:
    """A timetable: the first row of a pipe or tab table is its header; "day: a | b" lines are rows of their own."""
    rows = []
    for line in (x.strip() for x in text.split("\n") if x.strip()):
        if re.fullmatch(r"\|?[\s:|-]+\|?", line):
            continue
        if "|" in line or "\t" in line:
            day, colon, rest = line.partition(":")
            if colon and "|" in rest and "|" not in day:
                rows.append([day.strip(), *(c.strip() for c in rest.strip().strip("|").split("|"))])
            else:
                rows.append([c.strip() for c in re.split(r"\||\t", line.strip("|"))])
    return {"headers": rows[0] if rows else [], "rows": rows[1:]}


FORM_TYPE = "struct<doc_type:string,fields:map<string,string>,sections:array<struct<title:string,lines:array<string>>>,tables:array<array<array<string>>>,body:string,signs:array<string>,missing:string>"


parse_form = over_text(lambda kind, text: parse(kind, text) if kind in FORMS else None, FORM_TYPE)
parse_routine = over_text(routine, "struct<headers:array<string>,rows:array<array<string>>>")
