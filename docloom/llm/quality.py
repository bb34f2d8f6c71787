"""Quality rules as a short-circuit cascade.

Each rule has a cost and a selectivity, both measured on a bounded sample: about SAMPLE_TASKS partitions picked by a hash
of their numbers, and of each the first SAMPLE_BYTES of text. Executors measure; only seconds and counts come to the
driver. The rule with the most rejections per second goes first, the next ones by what they reject of the rest, and a
document that one rule rejects is not shown to the next. Words, which all rules need, count for none. The order changes
the time spent and never the verdict: a document is kept if no rule rejects it. ``apply`` orders the base rule with the
others; ``judge`` states its verdict and all measures for every document, so there it comes first.

Defined results: a null or empty text has no words and is rejected by the base rule; null and repeated ids, ties and
repeated rows are judged alike, each row by its own text; an empty table gives an empty result; further columns pass
through ``apply`` untouched, whatever their names are. A very long text is a block of its own.
"""

from __future__ import annotations

import time
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import scan, work

#: Partitions on which cost and selectivity are estimated, and bytes of text of each.
SAMPLE_TASKS, SAMPLE_BYTES = 32, 256 << 10
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


@dataclass
class View:
    """Lazy features of a block, kept once computed."""

    buf: np.ndarray
    offsets: np.ndarray
    _kept: dict = field(default_factory=dict)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._kept:
            self._kept[name] = getattr(self, f"_{name}")()
        return self._kept[name]

    def _words(self) -> scan.Words:
        return scan.words(self.buf, self.offsets, scan.WORD)

    def _prefix(self) -> scan.Prefix:
        return scan.byte_prefix(self.buf)

    def _n_words(self) -> np.ndarray:
        return self.words.counts

    def _word_chars(self) -> np.ndarray:
        leads = (self.buf & 0xC0) != 0x80
        return scan.sums(leads & scan.WORD[self.buf], self.offsets)

    def _n_symbols(self) -> np.ndarray:
        return scan.sums(SYMBOLS[self.buf], self.offsets)

    def _letter_words(self) -> np.ndarray:
        """Words with an ASCII letter or a non-ASCII character."""
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(LETTER[self.buf], out=total[1:])
        w = self.words
        return scan.sums(total[w.ends] > total[w.starts], w.first)

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, key) of every line that has a word."""
        breaks = np.flatnonzero(self.buf == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        doc_of_break = np.searchsorted(self.offsets, breaks, side="right") - 1
        per_doc = np.bincount(doc_of_break, minlength=len(self.offsets) - 1) + 1
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        ends = np.sort(np.concatenate([breaks, self.offsets[1:]]), kind="stable")
        w = self.words
        has = np.searchsorted(w.starts, starts) < np.searchsorted(w.starts, ends)
        starts, ends, doc = starts[has], ends[has], doc[has]
        return doc, self.prefix.ranges(starts, ends) ^ scan.mix(doc.astype(np.uint64) + np.uint64(1))

    def _n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0], minlength=len(self.offsets) - 1)

    def _n_dup_lines(self) -> np.ndarray:
        doc, key = self.lines
        order = np.argsort(key)
        again = np.zeros(len(key), bool)
        again[1:] = key[order][1:] == key[order][:-1]
        return np.bincount(doc[order][again], minlength=len(self.offsets) - 1)

    def _n_repeat_words(self) -> np.ndarray:
        w = self.words
        at, key = scan.windows(self.prefix.ranges(w.starts, w.ends), w.first, 5)
        key = key ^ scan.mix(w.doc()[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        return scan.sums(scan.covered(len(w.starts), at[order][twice], 5), w.first)

    def take(self, keep: np.ndarray) -> View:
        """A view of the documents in a mask."""
        sizes = np.diff(self.offsets)
        return View(self.buf[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])]))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[View], np.ndarray]


#: The base rule, then the rules of the method. All compare whole numbers, so that SQL gives the same.
BASE = Rule("base", lambda v: (v.n_words < 10) | (100 * v.n_repeat_words > 20 * v.n_words))
RULES = (
    Rule("word_length", lambda v: (v.word_chars < 2 * v.n_words) | (v.word_chars > 15 * v.n_words)),
    Rule("symbols", lambda v: 10 * v.n_symbols > v.n_words),
    Rule("letter_words", lambda v: 10 * v.letter_words < 6 * v.n_words),
    Rule("repeated_lines", lambda v: 2 * v.n_dup_lines > v.n_lines),
)


def measured(rules: tuple[Rule, ...], views: Iterator[View]) -> tuple[np.ndarray, dict[int, int]]:
    """Seconds of each rule, and how many documents each set of rules (as bits) rejects."""
    seconds, sets = np.zeros(len(rules)), Counter()
    for v in views:
        bits = np.zeros(len(v.offsets) - 1, np.int64)
        for i, rule in enumerate(rules):
            fresh = View(v.buf, v.offsets, {"words": v.words})
            began = time.perf_counter()
            bits |= rule.rejects(fresh).astype(np.int64) << i
            seconds[i] += time.perf_counter() - began
        sets.update(bits.tolist())
    return seconds, dict(sets)


def ordered(rules: tuple[Rule, ...], seconds: np.ndarray, sets: dict[int, int]) -> tuple[Rule, ...]:
    """Rules by rejections per second among what the rules before them leave; equal rates keep the given order."""
    left, out = list(range(len(rules))), []
    while left:
        rate = lambda i: sum(n for bits, n in sets.items() if bits >> i & 1) / max(seconds[i], 1e-9)
        best = max(left, key=lambda i: (rate(i), -i))
        out.append(rules[best])
        left.remove(best)
        sets = {bits: n for bits, n in sets.items() if not bits >> best & 1}
    return tuple(out)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], column: str) -> tuple[Rule, ...]:
    """The rules in the order that the sample suggests."""
    each = docs.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    every = max(1, work.input_bytes(docs) // each // SAMPLE_TASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        if zlib.crc32(str(task).encode()) % every:
            return
        views, size = [], 0
        for b in scan.blocks(batches, "text"):
            views.append(View(b.buf, b.offsets))
            size += len(b.buf)
            if size >= SAMPLE_BYTES:
                break
        seconds, sets = measured(rules, iter(views))
        rows = [*((-1 - i, float(x)) for i, x in enumerate(seconds)), *((k, float(n)) for k, n in sets.items())]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.float64())], names=["key", "value"])

    rows = docs.select(docs[column].alias("text")).mapInArrow(run, "key long, value double").groupBy("key").agg(F.sum("value").alias("value")).collect()
    seconds = np.zeros(len(rules))
    for r in rows:
        if r["key"] < 0:
            seconds[-1 - r["key"]] = r["value"]
    return ordered(rules, seconds, {r["key"]: int(r["value"]) for r in rows if r["key"] >= 0})


def cascade(view: View, rules: tuple[Rule, ...]) -> np.ndarray:
    """True where no rule rejects; each rule sees only what the rules before it left."""
    alive = np.arange(len(view.offsets) - 1)
    for rule in rules:
        if not len(alive):
            break
        bad = rule.rejects(view)
        if bad.any():
            alive, view = alive[~bad], view.take(~bad)
    return alive


DIGEST = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures and verdict per document; one pass, no shuffle."""
    by_rate = order_rules(docs, rules, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scan.blocks(batches, "text"):
            v = View(b.buf, b.offsets)
            failed = BASE.rejects(v)
            kept = np.zeros(b.n, bool)
            sound = np.flatnonzero(~failed)
            kept[sound[cascade(v.take(~failed), by_rate)]] = True
            out = [b.rows.column(0), *(pa.array(np.asarray(getattr(v, n), np.int64)) for n in DIGEST.names[:5]), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(out, names=["id", *DIGEST.names])

    kind = docs.schema[id_column].dataType
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("id", kind), *DIGEST.fields])).withColumnRenamed("id", id_column)


def apply(docs: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns; the rules' measures are not computed for others."""
    names, (docs, text_column) = docs.columns, work.numbered(docs, text_column)
    by_rate = order_rules(docs, (BASE, *rules), text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scan.blocks(batches, text_column):
            alive = cascade(View(b.buf, b.offsets), by_rate)
            if len(alive):
                yield b.rows.take(pa.array(alive))

    return docs.mapInArrow(run, docs.schema).toDF(*names)
