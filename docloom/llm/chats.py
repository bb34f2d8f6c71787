r"""Conversations as training text: a finite-state machine over roles, segments with loss flags, a declarative template.

``Template`` states what stands before and after a turn of each role, which roles are learned and which role may follow
which state. A turn becomes three segments (what opens it, its text, what closes it); only the text of a learned role
carries the loss flag. Control strings inside a text are broken by a backslash after their first character and
backslashes are doubled, so that a formatted text holds control strings of its template alone and can be read back.

Turns are dealt by ranges of (conversation, turn), so a conversation of any length spreads over tasks. A task walks the
machine through its turns in order; for a conversation that may have begun in an earlier range it keeps the state for
every state that the conversation may have come with, and the ranges' transitions are composed afterwards.

Defined results: a null text or role is empty. Turns are ordered by number (null first), role and a hash of the text; repeated
turns are turns of their own. A role that the template doesn't know is written out with its name and breaks the order, as
does every turn that the machine doesn't allow; a broken conversation is formatted like any other, ``state`` says so.
Rows whose conv_id is null form one conversation. A very long text stays one segment. An empty table gives no rows;
further columns are ignored. The digest hashes a conversation's texts one after the other, as SHA-256 asks for: one task reads
all turns of a conversation there, a batch at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import work

START, BROKEN = "start", "broken"


@dataclass(frozen=True)
class Turn:
    """What a role's turns look like."""

    opens: str
    closes: str
    learned: bool = False


@dataclass(frozen=True)
class Template:
    """Roles, what they look like and which may follow which; states are START, BROKEN and the role of the last turn."""

    begins: str
    turns: dict[str, Turn]
    follows: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    controls: tuple[str, ...]
    #: A role of another name stands between these two, its text before the third.
    named: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[END]")

    def __post_init__(self) -> None:
        opens = [t.opens for t in self.turns.values()] + [self.named[0]]
        closes = [t.closes for t in self.turns.values()] + [*self.named[1:]]
        for k in self.all_controls:
            if "\\" in k or len(k) < 2:
                raise ValueError(f"a control string has two characters or more and no backslash: {k!r}")
            for cut in range(1, len(k)):
                if any(o.endswith(k[:cut]) for o in (*opens, self.named[1])) or any(c.startswith(k[cut:]) or k[cut:].startswith(c) for c in closes):
                    raise ValueError(f"a text next to a marker could complete the control string {k!r}")
        if any(a != b and a.startswith(b) for a in opens for b in opens) or not all(any(k in c for k in self.all_controls) for c in closes):
            raise ValueError("markers must tell turns apart")

    @property
    def all_controls(self) -> tuple[str, ...]:
        return (*self.controls, *self.named)

    @property
    def states(self) -> list[str]:
        return [START, *self.turns, BROKEN]

    def after(self, state: int, role: str) -> int:
        """The machine's step."""
        names = self.states
        return names.index(role) if role in self.follows.get(names[state], ()) else len(names) - 1

    @cached_property
    def _control(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, sorted(self.all_controls, key=len, reverse=True))))

    def escape(self, text: Column) -> Column:
        found = "|".join(re.sub(r"([^\w<>/])", r"\\\1", k) for k in self.all_controls)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"(?=(?:{found}))(.)", r"$1\\")

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: Column, text: Column) -> Column:
        """array<struct<text, loss>> of a turn."""
        known = lambda pick, other: F.coalesce(*(F.when(role == r, F.lit(pick(t))) for r, t in self.turns.items()), other)
        opens = known(lambda t: t.opens, F.concat(F.lit(self.named[0]), self.escape(role), F.lit(self.named[1])))
        part = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
        return F.array(part(opens, F.lit(False)), part(self.escape(text), known(lambda t: t.learned, F.lit(False))), part(known(lambda t: t.closes, F.lit(self.named[2])), F.lit(False)))

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of the turns of a formatted conversation, or of some turns of it in a row."""
        out, at = [], len(self.begins) if formatted.startswith(self.begins) else 0
        opening, middle, closing = self.named
        while at < len(formatted):
            for role, t in self.turns.items():
                if formatted.startswith(t.opens, at):
                    at, closes = at + len(t.opens), t.closes
                    break
            else:
                if not formatted.startswith(opening, at):
                    raise ValueError(f"no turn begins at character {at}")
                end = formatted.index(middle, at)
                role, at, closes = self.unescape(formatted[at + len(opening) : end]), end + len(middle), closing
            end = formatted.index(closes, at)
            out.append((role, self.unescape(formatted[at:end])))
            at = end + len(closes)
        return out


#: The published markers of two common formats.
INSTRUCT = Template(
    "<s>",
    {"system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn(" ", "</s>", learned=True)},
    {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ("assistant",),
    ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"),
)
MARKUP = Template(
    "",
    {r: Turn(f"<|im_start|>{r}\n", "<|im_end|>\n", learned=r == "assistant") for r in ("system", "user", "assistant", "tool")},
    {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)},
    ("assistant",),
    ("<|im_start|>", "<|im_end|>"),
)

RANGE_BYTES = 16 << 20


def _ordered(conversations: DataFrame, template: Template) -> DataFrame:
    """Turns with their segments, sorted within ranges."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), F.xxhash64(text).alias("tie"), text.alias("text"))
    order = ("conv_id", "turn", "role", "tie")
    dealt = turns.repartitionByRange(work.groups(conversations, RANGE_BYTES), *order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "role", template.segments(F.col("role"), F.col("text")).alias("segments"))


def _walked(template: Template):
    """Adds to sorted turns: part and place, whether the turn is the first of its conversation in the part, whether the conversation may reach
    into another part (the first and last one of a part), and the state behind the turn for every state before the part."""
    size = len(template.states)
    steps: dict[str, list[int]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, seen, current, first = TaskContext.get().partitionId(), 0, False, None, True
        for batch in batches:
            behind, heads, early = [], [], []
            for conv, role in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), strict=True):
                head = not seen or conv != current
                if head:
                    first, seen, current, states = not seen, True, conv, list(range(size))
                if role not in steps:
                    if len(steps) > 1000:
                        steps.clear()
                    steps[role] = [template.after(s, role) for s in range(size)]
                states = [steps[role][s] for s in states]
                behind.append(states)
                heads.append(head)
                early.append(first)
            n = len(behind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.array(heads), pa.array(early), pa.array(behind, pa.list_(pa.int32()))], names=[*batch.schema.names, "part", "place", "head", "early", "behind"])
            at += n

    return run


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each part after the first finds its conversation."""
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            state = 0
            for k, p in enumerate(row["parts"]):
                if k:
                    found.append((row["conv_id"], p["part"], state))
                state = p["behind"][state]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["late id", "late part", "before"])


def formatted(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Turns (conv_id, turn, role, text) as (conv_id, part, place, turn, role, state, segments): in the order of part and place a conversation's
    segments are its formatted text; ``state`` is the machine's state behind the turn."""
    ordered = _ordered(conversations, template)
    kinds = ", ".join(f"{c} {t}" for c, t in ordered.dtypes)
    walked = work.table(ordered.mapInArrow(_walked(template), f"{kinds}, part int, place long, head boolean, early boolean, behind array<int>"), "turns")
    pieces = walked.groupBy("conv_id", "part").agg(F.max_by("behind", "place").alias("behind"))
    # a part has few conversations that reach beyond it: the states before those are composed of one row a part
    cut = pieces.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("part", "behind"))).alias("parts")).filter("n > 1")
    before = cut.mapInArrow(_composed, "`late id` long, `late part` int, before int")
    # only the first conversation of a part can have begun before it
    joined = walked.filter("early").join(before, F.col("conv_id").eqNullSafe(F.col("late id")) & (F.col("part") == F.col("late part")), "left").drop("late id", "late part")
    rows = joined.unionByName(walked.filter("NOT early").withColumn("before", F.lit(None).cast("int")))
    names = F.array(*map(F.lit, template.states))
    begins = F.array(F.struct(F.lit(template.begins).alias("text"), F.lit(False).alias("loss")))
    segments = F.when(F.col("head") & F.col("before").isNull() & (F.lit(template.begins) != ""), F.concat(begins, "segments")).otherwise(F.col("segments"))
    return rows.select("conv_id", "part", "place", "turn", "role", F.get(names, F.get("behind", F.coalesce("before", F.lit(0)))).alias("state"), segments.alias("segments"))


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, final_state string, valid boolean"


def _read_back(template: Template):
    """Digests of conversations whose turns come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, state, done = None, None, START, []
        utf8 = lambda s: s.encode("utf-8", "surrogatepass")

        def close() -> None:
            n, turns, chars, loss, size = held
            done.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), size, state, state in template.ends))

        def flush() -> pa.RecordBatch:
            names = [c.split()[0] for c in _DIGEST.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)
            done.clear()
            return out

        for batch in batches:
            for row in batch.to_pylist():
                if held is None or row["conv_id"] != current:
                    if held is not None:
                        close()
                    current, held = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = "".join(s["text"] for s in row["segments"])
                for role, said in template.read(text):
                    held[0] += 1
                    held[1].update(utf8(f"{role}\n{said}\n"))
                learned = "".join(template.unescape(s["text"]) for s in row["segments"] if s["loss"])
                held[2] += len(learned)
                held[3].update(utf8(learned))
                held[4] += len(text)
                state = row["state"]
            yield flush()
        if held is not None:
            close()
            yield flush()

    return run


def digest(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Formats conversations and reads the result back, one row a conversation."""
    rows = work.table(formatted(conversations, template).select("conv_id", "part", "place", "state", "segments"), "chats")
    n = work.groups(conversations, RANGE_BYTES)
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(_read_back(template), _DIGEST)


#: The control strings of INSTRUCT broken one after the other, as none holds another.
_ESCAPED = r"replace(t, '\', '\\')"
for _k in INSTRUCT.all_controls:
    _ESCAPED = f"replace({_ESCAPED}, '{_k}', '{_k[0]}\\{_k[1:]}')"

ORACLE = f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, t)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  3 + sum(length({_ESCAPED}) + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 ELSE 5 END) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN p = '' WHEN 'user' THEN p <> 'user' ELSE p = 'user' END) AS ordered, arg_max(role, k) AS last
  FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, CASE WHEN ordered THEN last ELSE 'broken' END AS final_state, ordered AND last = 'assistant' AS valid FROM g"""
