"""Benchmark decontamination.

The windows of the benchmark (13 consecutive normalised words; a shorter item is one window) become a hash
set that is broadcast; document windows are looked up in it, hits are verified word for word, and covered
words, spans and items are reported. ``BLOCK_WINDOWS`` bounds what is broadcast: a larger benchmark is
taken in blocks of that many windows, one scan of the documents each, and the spans are united.

Defined results: null texts have no words; an item without words has no window; a repeated item counts by
each of its ids; passages of items without an id cover words like any others, and all those items count as one
item that has no place in the hash of ids (a null at the end of ``items``); null and repeated document ids are rows of
their own; ties need no rule; empty tables give no hits; further columns are ignored or passed on. A very long text is a
block of its own, held whole by one task.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import scan, work

WIDTH = 13
#: Windows in one broadcast: about 300 bytes each in a worker.
BLOCK_WINDOWS = 200_000
#: Bits of the first filter.
FILTER_BITS = 22

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def in_order(items: set[str | None]) -> list[str | None]:
    """Item ids in order, a missing one last."""
    return sorted(items, key=lambda x: (x is None, x or ""))


def normal_words(text: str | None) -> list[bytes]:
    """Words of one text as the kernel finds them; the plain definition, for the small side."""
    buf = scan.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    w = scan.words(buf, np.array([0, len(buf)]), scan.ALNUM)
    return [buf[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]


class Index:
    """Hash set of windows by their length in words; each hash leads to (window, items)."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]]) -> None:
        found: dict[int, dict[bytes, set[str | None]]] = defaultdict(lambda: defaultdict(set))
        for item, ws in items:
            width = min(WIDTH, len(ws))
            for i in range(len(ws) - width + 1 if width else 0):
                found[width][b" ".join(ws[i : i + width])].add(item)
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, list]] = {}
        for width, entries in found.items():
            keys = list(entries)
            flat = [w for k in keys for w in k.split(b" ")]
            ends = np.cumsum([len(w) for w in flat])
            buf = np.frombuffer(b"".join(flat), np.uint8)
            hashes = scan.byte_prefix(buf).ranges(np.concatenate([[0], ends[:-1]]), ends)
            rolled = scan.Prefix(hashes, scan.POW_W).rolling(width)[::width]
            order = np.argsort(rolled, kind="stable")
            present = np.zeros(1 << FILTER_BITS, bool)
            present[rolled >> np.uint64(64 - FILTER_BITS)] = True
            self.by_width[width] = (present, rolled[order], [(keys[i], tuple(in_order(entries[keys[i]]))) for i in order])

    def hits(self, block: scan.Block) -> tuple[scan.Words, list[tuple[int, int, tuple[str | None, ...]]]]:
        """The block's words and, for each verified occurrence, (first word, width, items)."""
        buf = scan.LOWER[block.buf]
        w = scan.words(buf, block.offsets, scan.ALNUM)
        if not len(w.starts):
            return w, []
        hashes, out = scan.byte_prefix(buf).ranges(w.starts, w.ends), []
        for width, (present, known, entries) in self.by_width.items():
            at, rolled = scan.windows(hashes, w.first, width)
            maybe = present[rolled >> np.uint64(64 - FILTER_BITS)]
            at, rolled = at[maybe], rolled[maybe]
            lo, hi = np.searchsorted(known, rolled, "left"), np.searchsorted(known, rolled, "right")
            for i, a, b in zip(at[lo < hi], lo[lo < hi], hi[lo < hi], strict=True):
                mine = b" ".join(buf[w.starts[j] : w.ends[j]].tobytes() for j in range(i, i + width))
                out += [(int(i), width, entries[e][1]) for e in range(a, b) if entries[e][0] == mine]
        return w, out


def _blocks_of(benchmark: DataFrame, item_column: str, text_column: str) -> Iterator[Index]:
    """The benchmark as indexes of at most BLOCK_WINDOWS windows, read row by row."""
    held: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for item, text in benchmark.select(F.col(item_column).cast("string"), text_column).toLocalIterator():
        ws = normal_words(text)
        if not ws:
            continue
        # a long item is cut where windows still overlap
        for lo in range(0, max(1, len(ws) - WIDTH + 1), BLOCK_WINDOWS):
            part = ws[lo : lo + BLOCK_WINDOWS + WIDTH - 1]
            if held and size + len(part) > BLOCK_WINDOWS + WIDTH:
                yield Index(held)
                held, size = [], 0
            held.append((item, part))
            size += len(part)
    yield Index(held)


MARKS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])


def annotate(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", name: str = "marks") -> DataFrame:
    """The documents with one more column: word count, covered word ranges (end exclusive, disjoint), items found.

    One pass for each benchmark block, no shuffle. Between two blocks the rows are written to the shared
    folder, so that one task never holds more than one block.
    """
    if name in docs.columns:
        raise ValueError(f"the documents already have a column {name}")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, MARKS)])
    out = None
    for index in _blocks_of(benchmark, item_column, item_text):
        out = docs if out is None else work.table(out, "decontaminate")
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            arrow = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
            for b in scan.blocks(batches, text_column):
                w, found = shared.value.hits(b)
                items: dict[int, set] = defaultdict(set)
                marks: dict[int, list] = defaultdict(list)
                for i, width, names in found:
                    d = int(np.searchsorted(w.first, i, side="right")) - 1
                    items[d].update(names)
                    marks[d].append((i - int(w.first[d]), i - int(w.first[d]) + width))
                columns, fields = list(b.rows.columns), list(b.rows.schema)
                if name in b.rows.schema.names:
                    k = b.rows.schema.get_field_index(name)
                    for d, old in enumerate(columns.pop(k).to_pylist()):
                        items[d].update(old["items"])
                        marks[d] += [(s["start"], s["end"]) for s in old["spans"]]
                    fields.pop(k)
                new = [{"n_words": n, "spans": [{"start": x, "end": y} for x, y in united(marks[d])] if d in marks else [], "items": in_order(items[d]) if d in items else []} for d, n in enumerate(w.counts.tolist())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(new, arrow)], schema=pa.schema([*fields, pa.field(name, arrow)]))

        out = out.mapInArrow(run, schema)
    return out


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint union of ranges, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def n_hit(marks: str = "marks") -> Column:
    """Words covered by the spans of a marks column."""
    return F.aggregate(F.col(f"{marks}.spans"), F.lit(0).cast("long"), lambda a, s: (a + s["end"] - s["start"]).cast("long"))


def contaminated(marks: str = "marks") -> Column:
    """A twentieth of the words or more are covered."""
    return (n_hit(marks) > 0) & (20 * n_hit(marks) >= F.col(f"{marks}.n_words"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = annotate(docs.select("doc_id", "text"), benchmark)
    joined = F.array_join("marks.items", ",")
    return found.select("doc_id", F.col("marks.n_words").alias("n_words"), n_hit().alias("n_hit"), F.size("marks.items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def apply(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text_column: str = "text") -> DataFrame:
    """Documents without the contaminated ones (mode "documents"), or all with the covered words cut out (mode "spans")."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode}")
    names, (docs, text_column), name = docs.columns, work.numbered(docs, text_column), "marks"
    found = annotate(docs, benchmark, text_column, name=name)
    if mode == "documents":
        return found.filter(~contaminated(name)).select(*docs.columns).toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scan.blocks(batches, text_column):
            k = b.rows.schema.get_field_index(text_column)
            marks = b.rows.column(b.rows.schema.get_field_index(name)).to_pylist()
            texts = b.rows.column(k).to_pylist()
            w = scan.words(scan.LOWER[b.buf], b.offsets, scan.ALNUM)
            for d, m in enumerate(marks):
                at, pieces = int(b.offsets[d]), []
                for s in m["spans"]:
                    x, y = int(w.first[d]) + s["start"], int(w.first[d]) + s["end"]
                    pieces.append(b.buf[at : w.starts[x]].tobytes())
                    at = int(w.ends[y - 1])
                if pieces:
                    texts[d] = b"".join([*pieces, b.buf[at : b.offsets[d + 1]].tobytes()]).decode()
            out = b.rows.set_column(k, b.rows.schema.field(k), pa.array(texts, b.rows.schema.field(k).type))
            yield out.select([f.name for f in out.schema if f.name != name])

    return found.mapInArrow(run, docs.schema).toDF(*names)


def brute(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]]) -> list[tuple]:
    """The contract, word by word, for small tables."""
    import re

    def split(t: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    wins = defaultdict(set)
    for item, t in items:
        ws = split(t)
        k = min(WIDTH, len(ws))
        for i in range(len(ws) - k + 1 if k else 0):
            wins[tuple(ws[i : i + k])].add(None if item is None else str(item))
    out = []
    for doc, t in docs:
        ws, hit, names = split(t), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(ws) - k + 1):
                if found := wins.get(tuple(ws[i : i + k])):
                    hit.update(range(i, i + k))
                    names |= found
        out.append((doc, len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names - {None})).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return out
