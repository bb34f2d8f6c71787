"""Bangla in Unicode to and from the legacy glyph encoding of ASCII fonts.

Glyphs of conjuncts follow from rules where they can: a second or later consonant য, র or ব is a following
sign, ন after most letters and ল, ম likewise; what has a glyph of its own is in the table below. Maths between
dollar signs, URLs, e-mail addresses and Latin words are left as they are.

Arrow UDFs: ``to_legacy``, ``from_legacy``, ``auto``. Null stays null.
"""

from __future__ import annotations

import re
from functools import lru_cache

from docloom.parse.udfs import over_text

# Fixed values of the encoding: letters, signs, and the conjuncts with glyphs of their own.
SINGLE = {
    "অ": "A", "ই": "B", "ঈ": "C", "উ": "D", "ঊ": "E", "ঋ": "F", "এ": "G", "ঐ": "H", "ও": "I", "ঔ": "J", "ক": "K", "খ": "L",
    "গ": "M", "ঘ": "N", "ঙ": "O", "চ": "P", "ছ": "Q", "জ": "R", "ঝ": "S", "ঞ": "T", "ট": "U", "ঠ": "V", "ড": "W", "ঢ": "X",
    "ণ": "Y", "ত": "Z", "থ": "_", "দ": "`", "ধ": "a", "ন": "b", "প": "c", "ফ": "d", "ব": "e", "ভ": "f", "ম": "g", "য": "h",
    "র": "i", "ল": "j", "শ": "k", "ষ": "l", "স": "m", "হ": "n", "ড়": "o", "ঢ়": "p", "য়": "q", "ৎ": "r", "ং": "s", "ঃ": "t",
    "ঁ": "u", "্": "&", "।": "|", "০": "0", "১": "1", "২": "2", "৩": "3", "৪": "4", "৫": "5", "৬": "6", "৭": "7", "৮": "8",
    "৯": "9", "া": "v", "ী": "x", "ু": "y", "ূ": "~", "ৃ": "„", "আ": "Av", "ঽ": "",
}
CONJUNCTS = {
    "অ্যা": "A¨v", "অ্য": "A¨", "ন্ত্র": "š¿", "ক্ষ্ম": "¶¥", "ক্ষ্ণ": "ÿè", "ঙ্ক্ষ": "¼¶", "ম্ভ্র": "¤£", "ত্ত্ব": "Ë¡", "স্ত্র": "¯¿", "স্ক্র": "¯Œ",
    "ন্দ্ব": "›Ø", "ত্র": "Î", "ক্ক": "°", "ক্ট": "±", "ক্ত": "³", "ক্ম": "´", "ক্র": "µ", "ক্ল": "K¬", "ক্ষ": "¶", "ক্স": "·",
    "গ্ধ": "»", "গ্র": "MÖ", "ঙ্ক": "¼", "ঙ্গ": "½", "চ্চ": "”P", "চ্ছ": "”Q", "চ্ঞ": "”T", "জ্জ": "¾", "জ্ঝ": "À", "জ্ঞ": "Á",
    "ঞ্চ": "Â", "ঞ্ছ": "Ã", "ঞ্জ": "Ä", "ঞ্ঝ": "Å", "ট্ট": "Æ", "ড্ড": "Ç", "ণ্ট": "›U", "ন্ট": "›U", "ন্ঠ": "Ú", "ণ্ঠ": "Ú",
    "ণ্ড": "Û", "ন্ড": "Û", "ণ্ণ": "bœ", "ত্ত": "Ë", "ত্থ": "Î", "ত্ন": "Í", "দ্দ": "Ï", "দ্ধ": "×", "দ্ব": "Ø", "দ্ভ": "™¢",
    "দ্ম": "Ù", "ন্ত": "šÍ", "ন্থ": "š’", "ন্দ": "›`", "ন্ধ": "Ü", "ন্ব": "š^", "ন্স": "Ý", "প্ট": "Þ", "প্ত": "ß", "প্প": "à",
    "প্র": "cÖ", "প্স": "á", "ফ্র": "d«", "ফ্ল": "d¬", "ব্জ": "â", "ব্দ": "ã", "ব্ধ": "ä", "ব্ব": "eŸ", "ভ্র": "å", "ম্প": "¤ú",
    "ম্ফ": "ç", "ম্ব": "¤^", "ম্ভ": "¤¢", "ম্ম": "¤§", "ম্ল": "¤ø", "ল্ক": "é", "ল্গ": "ê", "ল্ট": "ë", "ল্ড": "ì", "ল্প": "í",
    "ল্ফ": "î", "শ্চ": "ð", "শ্ছ": "ñ", "শ্ব": "k¦", "শ্র": "kÖ", "ষ্ক": "®‹", "ষ্ট": "ó", "ষ্ঠ": "ô", "ষ্ণ": "ò", "ষ্প": "®ú",
    "ষ্ফ": "®œ", "ষ্ম": "®§", "স্ক": "¯‹", "স্খ": "ö", "স্ট": "÷", "স্ত": "¯Í", "স্থ": "¯’", "স্প": "¯ú", "স্ফ": "ù", "স্ব": "¯^",
    "স্ম": "¯§", "হ্ন": "ý", "হ্ণ": "nè", "হ্ব": "nŸ", "হ্ম": "þ", "হ্ল": "n¬",
}
FOLLOWING = {"য": "¨", "র": "ª", "ব": "¡", "ন": "œ", "ম": "¥", "ল": "ø"}
SIGNS = {"া": "v", "ী": "x", "ু": "y", "ূ": "~", "ৃ": "„"}
WITH_SIGN = {"কু": "Kz", "রু": "iæ", "রূ": "iƒ", "শু": "ï", "হু": "û", "হৃ": "ü"}
#: Signs that stand before and behind a cluster's glyphs.
BEFORE = {"w": "ি", "†": "ে", "‡": "ে", "ˆ": "ৈ", "‰": "ৈ"}
BEHIND = {v: k for k, v in SIGNS.items()} | {"z": "ু", "…": "ৃ", "Š": "ৌ"}
HASANTA, REPH, CHANDRA = "\u09cd", "©", "ঁ"

CONSONANT = "ক-হ\u09dc\u09dd\u09df"
CLUSTER = re.compile(f"(?:(র{HASANTA})(?=[{CONSONANT}]))?((?:অ্যা|অ্য|[{CONSONANT}](?:{HASANTA}[{CONSONANT}])*{HASANTA}?)|[\u0980-\u09ff।॥])([িেৈোৌাীুূৃঁ]*)")
KEEP = re.compile(r"\$\$.*?\$\$|\$[^$\n]+\$|\\\(.*?\\\)|\\\[.*?\\\]|https?://\S+|www\.\S+|[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}", re.S | re.A)
#: What every match of KEEP holds one of.
KEEP_SIGNS = ("$", "\\(", "\\[", "://", "www.", "@")


@lru_cache(maxsize=1)
def tables() -> tuple[dict[str, str], dict[str, str]]:
    """Glyphs by cluster, and clusters by glyphs: the longest glyphs of a text are tried first."""
    forward = CONJUNCTS
    back: dict[str, str] = {}
    every = list(forward)
    letters = [c for c in SINGLE if re.fullmatch(f"[{CONSONANT}]", c)]
    every += [f"{a}{HASANTA}{b}" for a in letters for b in FOLLOWING]
    every += [f"{a}{HASANTA}{b}" for a in forward for b in "যরব"]
    for u in every:
        back.setdefault(glyphs(u, forward), u)
    for u, b in SINGLE.items():
        if b:
            back.setdefault(b, u)
    for u, b in WITH_SIGN.items():
        back[b] = u
    return forward, back


def glyphs(cluster: str, forward: dict[str, str]) -> str:
    """A cluster's glyphs: its longest known beginning, then signs or joined letters."""
    if cluster in forward:
        return forward[cluster]
    letters = cluster.split(HASANTA)
    if len(letters) == 1:
        return SINGLE.get(cluster, cluster)
    for n in range(len(letters) - 1, 0, -1):
        head = HASANTA.join(letters[:n])
        if n == 1 or head in forward:
            out = forward.get(head) or SINGLE.get(head, head)
            for c in letters[n:]:
                out += FOLLOWING.get(c) or "&" + SINGLE.get(c, c)
            return out
    return cluster


def normal(text: str) -> str:
    """Typographic quotes and dashes as plain ones, split vowels and nuktas as one character, no joiners."""
    text = text.translate(str.maketrans("“”‘’—–−‒―", "\"\"''-----", "\u200c\u200d"))
    for a, b in (("\u09a1\u09bc", "\u09dc"), ("\u09a2\u09bc", "\u09dd"), ("\u09af\u09bc", "\u09df"), ("\u09c7\u09be", "\u09cb"), ("\u09c7\u09d7", "\u09cc")):
        text = text.replace(a, b)
    return text


#: Words of a text whose transcription a process keeps, and the longest of those: texts repeat most of their words.
KEPT_WORDS, KEPT_LENGTH = 1 << 17, 32
BLANK = re.compile(r"(\s+)")
BENGALI = re.compile("[\u0980-\u09ff।॥]")


def by_words(text: str, kept, f) -> str:
    """A function over a text, word by word: neither encoding looks beyond white space."""
    return "".join([x if i & 1 else kept(x) if len(x) <= KEPT_LENGTH else f(x) for i, x in enumerate(BLANK.split(text))])


def encode(text: str) -> str:
    return by_words(text, _kept_encoded, encoded)


def decode(text: str) -> str:
    return by_words(text, _kept_decoded, decoded)


def encoded(text: str) -> str:
    forward, _ = tables()
    text = normal(text)

    def unit(m: re.Match) -> str:
        reph, cluster, signs = m.groups()
        begins = m.start() == 0 or not re.match("[\u0980-\u09ff]", text[m.start() - 1])
        e = "†" if begins else "‡"
        before, after, chandra = "", "", ""
        for s in signs:
            if s == "ি":
                before = "w"
            elif s == "ৈ":
                before = "ˆ"
            elif s in "েোৌ":
                before, after = e, {"ো": "v", "ৌ": "Š"}.get(s, after)
            elif s == CHANDRA:
                chandra = "u"
            else:
                after = SIGNS[s]
        body = glyphs(cluster, forward)
        special = [k for k in WITH_SIGN if k[0] == cluster and k[1] in signs]
        if special and not before:
            body, after = WITH_SIGN[special[0]], ""
        return before + body + after + (REPH if reph else "") + chandra

    return CLUSTER.sub(unit, text)


def decoded(text: str) -> str:
    _, back = tables()
    sizes, pre, post = _sizes(), BEFORE, BEHIND
    out, i, end = [], 0, len(text)
    while i < end:
        sign = pre.get(text[i], "")
        j = i + bool(sign)
        for n in sizes.get(text[j : j + 1], ()):
            if j + n <= end and text[j : j + n] in back:
                break
        else:
            out.append(sign + text[j : j + 1])
            i = j + 1
            continue
        cluster = back[text[j : j + n]]
        j += n
        after = reph = chandra = ""
        if not sign and (j == end or (text[j] not in post and text[j] not in "u©")):
            out.append(cluster)
            i = j
            continue
        vowel = cluster[0] in "অআইঈউঊঋএঐওঔ"
        while j < end:
            c = text[j]
            if c == REPH:
                reph = "র" + HASANTA
            elif c == "u":
                chandra = CHANDRA
            elif c in post and not vowel:
                after = post[c]
            else:
                break
            j += 1
        both = {("ে", "া"): "ো", ("ে", "ৌ"): "ৌ"}.get((sign, after), sign + after)
        if len(cluster) == 2 and cluster in WITH_SIGN and sign:
            both = sign
        out.append(reph + cluster + both + chandra)
        i = j
    return "".join(out)


@lru_cache(maxsize=1)
def _sizes() -> dict[str, list[int]]:
    """Lengths of the glyphs that begin with a character, the longest first."""
    out: dict[str, set[int]] = {}
    for k in tables()[1]:
        out.setdefault(k[0], set()).add(len(k))
    return {c: sorted(n, reverse=True) for c, n in out.items()}


_kept_encoded, _kept_decoded = lru_cache(maxsize=KEPT_WORDS)(encoded), lru_cache(maxsize=KEPT_WORDS)(decoded)


def outside(text: str, f) -> str:
    """A function over what isn't maths, an address or a link."""
    if not any(sign in text for sign in KEEP_SIGNS):
        return f(text)
    out, at = [], 0
    for m in KEEP.finditer(text):
        out += [f(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, f(text[at:])])


def to_legacy_text(text: str) -> str:
    if not BENGALI.search(text):
        return text
    return outside(text, lambda t: encode(t) if BENGALI.search(t) else t)


LATIN = re.compile(r"(?<![^\s(\[\"'])[A-Za-z]{2,}(?:['-][A-Za-z]+)*(?=[\s.,;:!?)\]\"']|$)")
COMMON = {"the", "of", "and", "to", "in", "is", "for", "on", "with", "by", "at", "from", "this", "that", "are", "be"}


def from_legacy_text(text: str) -> str:
    """Latin text stays: runs of plain words of which one is a common English word."""
    def part(t: str) -> str:
        if not t.strip() or (t.isascii() and any(m[0].lower() in COMMON for m in LATIN.finditer(t))):
            return t
        return decode(t)

    return outside(text, part)


def auto_text(text: str) -> str:
    """To legacy if there are Bengali letters, else from it."""
    return to_legacy_text(text) if re.search("[\u0980-\u09ff]", text) else from_legacy_text(text)


def script_runs(text: str) -> list[dict]:
    """Runs of Bangla and Latin text; neutral characters stay with the run before them."""
    out: list[dict] = []
    for token in re.findall("[\u0980-\u09ff।॥]+|[A-Za-z]+|[^A-Za-z\u0980-\u09ff।॥]+", text):
        kind = "bn" if re.match("[\u0980-\u09ff।॥]", token) else "en" if token[0].isalpha() and token[0].isascii() else None
        if out and (kind is None or kind == out[-1]["type"]):
            out[-1]["text"] += token
        else:
            out.append({"type": kind or "en", "text": token})
    return out


to_legacy, from_legacy, auto = over_text(to_legacy_text, "string"), over_text(from_legacy_text, "string"), over_text(auto_text, "string")
split_scripts = over_text(script_runs, "array<struct<type:string,text:string>>")
