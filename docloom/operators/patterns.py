"""Many patterns or words over a text in one pass: an Aho-Corasick automaton over literals.

``needed`` reads from a regular expression which literals any match must hold one of; one pass over a text tells which of
those occur, and only patterns that can match are run at all. ``replaced_at_once`` replaces the words of a dictionary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from docloom import storage

#: Characters of all words of a dictionary together, at most: every task holds its automaton.
MOST_CHARACTERS = 1 << 24
#: Words between blanks whose replacement a batch keeps, and the longest of those.
KEPT_WORDS, KEPT_LENGTH = 1 << 17, 32
_BLANK = re.compile(r"([\x20\x09-\x0D]+)")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def needed(pattern: str) -> frozenset[str]:
    """Literals, A-Z lowered, of which every text that the pattern matches holds at least one; none where no literal is certain."""
    from re import _constants as op
    from re import _parser

    def weight(found: frozenset[str]) -> tuple[int, int]:
        return min(map(len, found)), -len(found)

    def of(tree) -> frozenset[str]:
        known, run = [], ""
        for kind, value in [*tree, (None, None)]:
            if kind is op.LITERAL:
                run += chr(value)
                continue
            if run:
                known.append(frozenset([run.translate(_LOWER)]))
                run = ""
            if kind is op.SUBPATTERN:
                known.append(of(value[3]))
            elif kind is op.BRANCH:
                each = [of(b) for b in value[1]]
                known.append(frozenset().union(*each) if all(each) else frozenset())
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
                known.append(of(value[2]))
        return max(filter(None, known), key=weight, default=frozenset())

    return of(_parser.parse(pattern))


@lru_cache(maxsize=8)
def _automaton(words: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, w in enumerate(words):
        a.add_word(w, (i, len(w)))
    a.make_automaton()
    return a


def possible(text: Column, patterns: list[str]) -> Column:
    """array<boolean>: which patterns may match a text; false means that they don't. Null texts give null."""
    groups = [needed(p) for p in patterns]
    words = tuple(sorted(frozenset().union(*groups)))
    users = [[i for i, g in enumerate(groups) if w in g] for w in words]
    always = [not g for g in groups]

    @arrow_udf("array<boolean>")
    def found(texts: pa.Array) -> pa.Array:
        a, out = _automaton(words) if words else None, []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            may = list(always)
            for i in {k for _, (k, _) in a.iter(t.translate(_LOWER))} if a else ():
                for p in users[i]:
                    may[p] = True
            out.append(may)
        return pa.array(out, pa.list_(pa.bool_()))

    return found(text)


def _longest(text: str, automaton) -> Iterator[tuple[int, int, int]]:
    """(begin, end, word) of words from the left, the longest at each place, without overlaps."""
    best: dict[int, tuple[int, int]] = {}
    for last, (word, size) in automaton.iter(text):
        if size > best.get(last - size + 1, (0, 0))[0]:
            best[last - size + 1] = (size, word)
    at = 0
    for begin in sorted(best):
        if begin >= at:
            at = begin + best[begin][0]
            yield begin, at, best[begin][1]


def replaced_at_once(rows: DataFrame, column: str, dictionary: DataFrame, count: str = "n_replaced") -> DataFrame:
    """Texts with the words of a dictionary (word, replacement) replaced in one pass, and how many were: from the left, the longest word at each
    place; what was put in is not looked at again. Entries with both sides only; of a word given twice the smallest replacement counts.

    The dictionary is one that a user keeps: its size is checked, and a larger one than ``MOST_CHARACTERS`` is refused. Null texts stay null.
    """
    entries = storage.table(dictionary.filter("length(trim(word)) > 0 AND length(trim(replacement)) > 0").groupBy("word").agg(F.min("replacement").alias("replacement")), "entries")
    size = entries.agg(F.sum(F.length("word") + F.length("replacement"))).first()[0] or 0
    if size > MOST_CHARACTERS:
        raise ValueError(f"a dictionary of {size} characters; at most {MOST_CHARACTERS} fit every task")
    held = sorted((r["word"], r["replacement"]) for r in entries.collect())
    storage.drop(entries)
    words, others = tuple(w for w, _ in held), [r for _, r in held]
    apart = not any(_BLANK.search(w) for w in words)

    @arrow_udf("struct<text: string, n: bigint>")
    def put(texts: pa.Array) -> pa.Array:
        a = _automaton(words) if words else None

        def one(t: str) -> tuple[str, int]:
            parts, at, n = [], 0, 0
            for begin, end, word in _longest(t, a) if t and a else ():
                parts += [t[at:begin], others[word]]
                at, n = end, n + 1
            return "".join([*parts, t[at:]]), n

        kept = lru_cache(maxsize=KEPT_WORDS)(one)
        out, ns = [], []
        for t in texts:
            t = t.as_py()
            if t is None:
                done = None, 0
            elif apart:
                # no word of the dictionary holds a blank, so what stands between blanks is replaced by itself, and mostly was before
                each = [(x, 0) if i & 1 else kept(x) if len(x) <= KEPT_LENGTH else one(x) for i, x in enumerate(_BLANK.split(t))]
                done = "".join([x for x, _ in each]), sum([n for _, n in each])
            else:
                done = one(t)
            out.append(done[0])
            ns.append(done[1])
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(ns, pa.int64())], names=["text", "n"])

    return rows.withColumn("put in", put(F.col(column))).withColumn(column, F.col("put in.text")).withColumn(count, F.col("put in.n")).drop("put in")


def guarded(text: Column, pattern: str, may: Column) -> Column:
    """Whether a pattern matches, run only where it may."""
    return F.when(may, text.rlike(pattern)).otherwise(F.lit(False))
