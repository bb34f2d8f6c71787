"""Substring dedup over words with a compressed FM-index per shard.

Removes each word covered by a window of 13 words that also starts in a document with a smaller id. The
windows that can match are routed to shards (see ``overlap``); a shard builds an FM-index of its distinct fragments:
the Burrows-Wheeler transform of their words in a wavelet matrix of packed bits with a rank directory, and two bit
vectors that mark where rows begin to differ within 12 and 13 words. The order of the suffixes goes once these are made.
Pieces of documents are streamed through the index from right to left: each backward step extends the match by one word,
and an interval of 13 words is widened to that of its first 12. These are the matching statistics, cut at the
threshold; the smallest document in the interval of a full window decides.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged, and told apart by their bytes. Defined results: null texts have no words; rows that repeat an id
count as one document, so they never remove each other's words; a null id
counts as the largest; an empty table gives an empty result; further columns are ignored. A very long text is read whole
by one task. The fragments of a part of a shard are indexed in memory, at about 60 bytes a word while the index is made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import overlap, scan

WIDTH = 13
#: Words whose hashes are anchors.
GRAM = 5


def _split(b: scan.Block) -> tuple[np.ndarray, np.ndarray, scan.Words]:
    w = scan.words(b.buf, b.offsets, scan.WORD)
    return scan.byte_prefix(b.buf).ranges(w.starts, w.ends), w.first, w


def _cut(b: scan.Block, w: scan.Words, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words lo:hi of each range, each followed by a line feed."""
    k = overlap.gather(lo, hi - lo)
    size = w.ends[k] - w.starts[k] + 1
    src = overlap.gather(w.starts[k], size)
    stops = np.cumsum(size)
    out = b.buf[np.minimum(src, len(b.buf) - 1)]
    out[stops - 1] = 10
    return out, stops[np.cumsum(hi - lo) - 1]


UNITS = overlap.Units(WIDTH, GRAM, 8, _split, _cut)


class Bits:
    """A bit vector, packed in 64-bit words with running counts."""

    def __init__(self, bits: np.ndarray) -> None:
        self._packed = np.packbits(np.pad(bits, (0, -len(bits) % 64 + 64)), bitorder="little").view("<u8")
        self._ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self._packed))]).astype(np.int32)
        self.total = int(self._ones[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        return self._ones[word] + np.bitwise_count(self._packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the one numbered k from 0."""
        word = np.searchsorted(self._ones, k, side="right") - 1
        left, bits, at = k - self._ones[word], self._packed[word], word << 6
        for size in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(bits & np.uint64((1 << size) - 1)).astype(np.int64)
            up = left >= low
            left = np.where(up, left - low, left)
            bits = np.where(up, bits >> np.uint64(size), bits)
            at = np.where(up, at + size, at)
        return at


class Wavelet:
    """A wavelet matrix: a bit vector per level."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.n, self.levels, self.rows = len(values), levels, []
        for level in reversed(range(levels)):
            bits = (values >> level & 1).astype(bool)
            held = Bits(bits)
            self.rows.append((held, self.n - held.total))
            values = np.concatenate([values[~bits], values[bits]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position, plus where the symbol's block starts on the last level."""
        for level, (bits, zeros) in zip(reversed(range(self.levels)), self.rows, strict=True):
            one = bits.rank(at)
            at = np.where(symbols >> level & 1, zeros + one, at - one)
        return at


class FMIndex:
    """Of a text of symbols >= 1 with separators 0; orders suffixes by their first ``depth`` symbols.

    ``owner`` has a number per position; of the rows that agree in ``depth`` symbols the index keeps the smallest one.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, depth: int) -> None:
        self.depth, self.n = depth, len(text)
        order = self._order(text, depth + 1)
        levels = max(1, int(text.max()).bit_length())
        self.wavelet = Wavelet(text[order - 1].astype(np.int32), levels)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << levels))])[:-1]
        symbols = np.arange(1 << levels, dtype=np.int32)
        self._base = self.wavelet.rank(symbols, np.zeros(1 << levels, np.int64))
        new = np.zeros(self.n, bool)
        new[0] = True
        for k in range(depth):
            at = order + k
            sym = np.where(at < self.n, text[np.minimum(at, self.n - 1)], -1)
            new[1:] |= sym[1:] != sym[:-1]
            if k == depth - 2:
                self._short = Bits(new)
        self._full = Bits(new)
        self.least = np.minimum.reduceat(owner[order], np.flatnonzero(new))

    @staticmethod
    def _order(text: np.ndarray, depth: int) -> np.ndarray:
        n = len(text)
        rank, reach = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while True:
            sorted_ = rank[order]
            rank[order] = np.cumsum(np.append(0, sorted_[1:] != sorted_[:-1]))
            if reach >= depth:
                return order
            after = np.zeros(n, np.int64)
            after[: n - reach] = rank[reach:] + 1
            rank = rank * (n + 2) + after
            order = np.argsort(rank, kind="stable")
            reach *= 2

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Backward search of one symbol: where the rows that start with it and go on as row ``at`` begin."""
        return self.first[symbols] + self.wavelet.rank(symbols, at) - self._base[symbols]

    def widen(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of rows that agree with a row in depth - 1 symbols."""
        group = self._short.rank(row + 1) - 1
        after = group + 1 < self._short.total
        return self._short.select(group), np.where(after, self._short.select(np.where(after, group + 1, group)), self.n)

    def group(self, row: np.ndarray) -> np.ndarray:
        return self._full.rank(row + 1) - 1

    def stream(self, symbols: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, smallest owner) of every full window of sequences symbols[begin:begin + count] that occurs in the index, each sequence from right to left.

        A symbol of 0 or less occurs nowhere. Where a match ends, the sequence goes on with the longest piece that may still lie in one.
        """
        lane = np.flatnonzero(count > 0)
        at, low = begin[lane] + count[lane] - 1, begin[lane]
        lo, hi, length = np.zeros(len(lane), np.int64), np.full(len(lane), self.n), np.zeros(len(lane), np.int64)
        places, owners = [], []
        while len(at):
            wide = np.flatnonzero(length == self.depth)
            if len(wide):
                lo[wide], hi[wide] = self.widen(lo[wide])
                length[wide] -= 1
            sym = symbols[at]
            known = np.maximum(sym, 1)
            both = self.step(np.concatenate([known, known]), np.concatenate([lo, hi]))
            new_lo, new_hi = both[: len(at)], both[len(at) :]
            found = (new_hi > new_lo) & (sym > 0)
            if found.all():
                lo, hi, length, at = new_lo, new_hi, length + 1, at - 1
            else:
                again = np.where(length > 0, at + length - 1, at - 1)
                lo, hi = np.where(found, new_lo, 0), np.where(found, new_hi, self.n)
                at, length = np.where(found, at - 1, again), np.where(found, length + 1, 0)
            full = np.flatnonzero(length == self.depth)
            if len(full):
                places.append(at[full] + 1)
                owners.append(self.least[self.group(lo[full])])
            live = at >= low
            if not live.all():
                at, low, lo, hi, length = (x[live] for x in (at, low, lo, hi, length))
        none = np.zeros(0, np.int64)
        return (np.concatenate(places), np.concatenate(owners)) if places else (none, none)


def symbols_of(payload: np.ndarray, w: scan.Words) -> np.ndarray:
    """A number from 1 for every distinct word: equal hashes are compared by their bytes."""
    hashes = scan.byte_prefix(payload).ranges(w.starts, w.ends)
    _, rep, symbol = np.unique(hashes, return_index=True, return_inverse=True)
    size, rep = w.ends - w.starts, rep[symbol]
    runs = np.split(np.arange(len(rep)), np.arange(1 << 15, len(rep), 1 << 15))
    if np.array_equal(size, size[rep]) and all(np.array_equal(payload[overlap.gather(w.starts[k], size[k])], payload[overlap.gather(w.starts[rep[k]], size[k])]) for k in runs):
        return symbol + 1
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(payload[a:b].tobytes(), len(seen) + 1) for a, b in zip(w.starts, w.ends, strict=True)])


def kernel(payload: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The smallest owner of each window of each fragment, windows in order."""
    w = scan.words(payload, np.concatenate([[0], ends]), scan.WORD)
    symbol, count = symbols_of(payload, w), w.counts
    m = len(count)
    # a separator before each fragment and one at the end
    text = np.zeros(len(symbol) + m + 1, np.int64)
    begin = w.first[:-1] + np.arange(m) + 1
    where = overlap.gather(begin, count)
    text[where] = symbol
    own = np.full(len(text), np.iinfo(np.int64).max)
    own[where] = np.repeat(owner, count)
    at, least = FMIndex(text, own, WIDTH).stream(text, begin, count)
    number = np.cumsum(np.maximum(count - WIDTH + 1, 0))
    fragment = np.searchsorted(begin, at, side="right") - 1
    out = np.empty(int(number[-1]) if m else 0, np.int64)
    if len(at) != len(out):
        raise AssertionError("the index lost windows")
    out[number[fragment] - (count[fragment] - WIDTH + 1) + at - begin[fragment]] = least
    return out


def _finish(b: scan.Block, w: scan.Words, first: np.ndarray, covered: np.ndarray) -> pa.Table:
    removed = scan.sums(covered, first)
    keep = ~covered
    size = w.ends - w.starts + 1
    buf = np.append(b.buf, np.uint8(32))
    joined = buf[overlap.gather(w.starts[keep], size[keep])]
    stops = np.cumsum(size[keep])
    joined[stops - 1] = 32
    data, shas = joined.tobytes(), []
    at = np.concatenate([[0], np.cumsum(keep)])[first]
    edge = np.concatenate([[0], stops])[at]
    for i in range(b.n):
        lo, hi = int(edge[i]), int(edge[i + 1])
        shas.append(hashlib.sha256(memoryview(data)[lo : max(lo, hi - 1)]).hexdigest())
    return pa.table({"doc_id": b.rows.column(0), "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return overlap.remove_repeated(docs, UNITS, kernel, _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", "doc_id", "text")


def apply(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, kept_text): what is left of each text, words joined by one space, and the removed word ranges."""

    def finish(b: scan.Block, w: scan.Words, first: np.ndarray, covered: np.ndarray) -> pa.Table:
        texts, spans = [], []
        for i in range(b.n):
            lo, hi = first[i], first[i + 1]
            texts.append(b" ".join(b.buf[w.starts[k] : w.ends[k]].tobytes() for k in range(lo, hi) if not covered[k]).decode())
            c = np.concatenate([[False], covered[lo:hi], [False]]).astype(np.int8)
            edges = np.flatnonzero(np.diff(c))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
        return pa.table({id_column: b.rows.column(0), "kept_text": pa.array(texts, pa.string()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return overlap.remove_repeated(docs, UNITS, kernel, finish, f"`{id_column}` long, kept_text string, removed array<struct<start:long,end:long>>", id_column, text_column)


ORACLE = r"""
WITH s AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM s, unnest(range(1, len(ws) - 11)) AS u(i)),
o AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, i + k AS p FROM g JOIN o USING (g), range(0, 13) AS x(k) WHERE first < doc_id),
w AS (SELECT doc_id, u.p, ws[u.p] AS word FROM s, unnest(range(1, len(ws) + 1)) AS u(p)),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS t FROM w ANTI JOIN r ON r.doc_id = w.doc_id AND r.p = w.p GROUP BY w.doc_id),
c AS (SELECT doc_id, count(*) AS m FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(m, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM s LEFT JOIN c ON c.doc_id = s.doc_id LEFT JOIN k ON k.doc_id = s.doc_id"""
