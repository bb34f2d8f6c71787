"""Suffix-array dedup over bytes with induced sorting on disk-backed queues.

Removes each byte covered by a 50-byte string that also starts in a document with a smaller id. The strings
that can match are routed to shards (see ``overlap``); a shard sorts the suffixes of its fragments by external induced
sorting:

1. the leftmost S-type suffixes are the starts of the runs of equal bytes that are local minima. They are dealt into
   one queue per first byte; a queue of more than CHUNK items is dealt again by the next byte, and so on, and what
   is small enough is sorted by 8-byte words;
2. all others are induced from them in one ascending and one descending sweep. Items are tuples of a suffix and its common
   prefix with the one before it. They wait in one queue per first byte, in order, so the queues together are a priority
   queue; a sweep takes at most CHUNK items at a time. The common prefix of two neighbours in a queue is one more than
   the least one between the two suffixes that they were induced from, so no text is compared again;
3. the descending sweep gives all suffixes in order with their common prefixes: neighbours with WIDTH or more form a
   group, and the smallest owner of a group decides for all of it.

Queues hold POOL_ITEMS items in memory together; beyond that the largest go to one file of the task's temporary folder. The
text, and the tables by position, are mapped files where they exceed MAPPED_BYTES. So memory is bounded by these
parameters, apart from a few bytes per fragment and the shard's messages as they arrive.

The sorted strings end at 56 bytes, so the leftmost S-type suffixes need no names and no reduced string: dealing by the
next byte is the recursion, and it is at most 56 deep.

Defined results: null texts are empty; rows that repeat an id count as one document; a null id counts as the
largest; an empty table gives an empty result; further columns are ignored. A very long text is read whole by one task.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm import overlap, scan

WIDTH = 50
#: Bytes by which the leftmost S-type suffixes are sorted.
DEPTH = 56
#: Bytes whose hashes are anchors.
GRAM = 20
#: Items that all queues keep in memory, items that a step takes, and bytes from which a table is a mapped file.
POOL_ITEMS, CHUNK, MAPPED_BYTES = 3 << 18, 1 << 18, 64 << 20
NONE = 255


def _split(b: scan.Block) -> tuple[np.ndarray, np.ndarray, None]:
    return scan.BYTES_A[b.buf], b.offsets, None


def _cut(b: scan.Block, _: None, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return b.buf[overlap.gather(lo, hi - lo)], np.cumsum(hi - lo)


UNITS = overlap.Units(WIDTH, GRAM, 4, _split, _cut)


def table(n: int, kind: type | str, fill: int | None = None) -> np.ndarray:
    """An array, in a file without a name if it is large."""
    size = max(1, n) * np.dtype(kind).itemsize
    if size <= MAPPED_BYTES:
        out = np.empty(n, kind)
    else:
        file = tempfile.TemporaryFile()  # noqa: SIM115  it lives as long as the map
        file.truncate(size)
        out = np.memmap(file, kind, "r+", shape=(n,))
    if fill is not None:
        out[:] = fill
    return out


class Pool:
    """The queues of a sort: what they hold in memory together, and the file for the rest."""

    def __init__(self, limit: int = POOL_ITEMS) -> None:
        self.limit, self.held, self.spilled, self.queues = limit, 0, 0, []
        self._file, self._end = None, 0

    def many(self, n: int) -> list[Queue]:
        new = [Queue(self) for _ in range(n)]
        self.queues += new
        return new

    def make_room(self) -> None:
        while self.held > self.limit:
            max(self.queues, key=lambda q: q.in_memory).spill()

    def write(self, items: np.ndarray) -> int:
        if self._file is None:
            self._file = tempfile.TemporaryFile()  # noqa: SIM115  it lives as long as the pool
        self._file.seek(self._end)
        self._file.write(items.tobytes())
        at, self._end, self.spilled = self._end, self._file.tell(), self.spilled + len(items)
        return at

    def read(self, at: int, n: int, kind: np.dtype) -> np.ndarray:
        self._file.seek(at)
        return np.frombuffer(self._file.read(n * kind.itemsize), kind)


ITEM = np.dtype([("at", "<i8"), ("common", "u1")])


class Queue:
    """Suffixes with their common prefixes, in order of arrival: the older ones are in extents of the pool's file."""

    def __init__(self, pool: Pool) -> None:
        self._pool, self._extents, self._held, self.in_memory, self.size = pool, [], [], 0, 0

    def push(self, at: np.ndarray, common: np.ndarray) -> None:
        self._held.append((at, common))
        self.in_memory += len(at)
        self.size += len(at)
        self._pool.held += len(at)
        if self._pool.held > self._pool.limit:
            self._pool.make_room()

    def _memory(self) -> tuple[np.ndarray, np.ndarray]:
        at, common = (np.concatenate([x[i] for x in self._held]) for i in (0, 1))
        self._pool.held -= self.in_memory
        self._held, self.in_memory = [], 0
        return at, common

    def spill(self) -> None:
        at, common = self._memory()
        items = np.empty(len(at), ITEM)
        items["at"], items["common"] = at, common
        self._extents.append((self._pool.write(items), len(items)))

    def _read(self, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        items = self._pool.read(at, n, ITEM)
        return items["at"].copy(), items["common"].copy()

    def take(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The oldest items, at most so many; they are then out of the queue."""
        parts, left = [], most
        while self._extents and left:
            at, n = self._extents[0]
            k = min(n, left)
            parts.append(self._read(at, k))
            left -= k
            if k == n:
                self._extents.pop(0)
            else:
                self._extents[0] = (at + k * ITEM.itemsize, n - k)
        if self._held and left:
            at, common = self._memory()
            if len(at) > left:
                self._held, self.in_memory = [(at[left:], common[left:])], len(at) - left
                self._pool.held += self.in_memory
            parts.append((at[:left], common[:left]))
        at, common = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
        self.size -= len(at)
        return at, common

    def backwards(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All items in runs from the last one to the first; the order within a run is that of arrival."""
        if self._held:
            at, common = self._memory()
            for hi in range(len(at), 0, -most):
                yield at[max(0, hi - most) : hi], common[max(0, hi - most) : hi]
        for at, n in reversed(self._extents):
            for hi in range(n, 0, -most):
                lo = max(0, hi - most)
                yield self._read(at + lo * ITEM.itemsize, hi - lo)
        self._extents, self.size = [], 0


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo:hi + 1] for each pair."""
    levels, size = [values], 1
    while 2 * size <= len(values):
        x = levels[-1]
        levels.append(np.minimum(x[:-size], x[size:]))
        size *= 2
    flat = np.concatenate(levels)
    begins = np.cumsum([0, *(len(x) for x in levels)])[:-1]
    level = np.log2(hi - lo + 1).astype(np.int64)
    return np.minimum(flat[begins[level] + lo], flat[begins[level] + hi + 1 - (1 << level)])


class Sorter:
    """External induced sorting of a text that ends in a zero; ``text`` has 80 zeros more behind it."""

    def __init__(self, text: np.ndarray, n: int, limit: int = POOL_ITEMS, chunk: int = CHUNK) -> None:
        self.text, self.n, self.chunk, self.pool = text, n, chunk, Pool(limit)
        # eight bytes from every position on, as numbers in the order of the bytes
        self._words = np.ndarray((n + 72,), ">u8", text.data, 0, (1,))

    def words(self, at: np.ndarray) -> np.ndarray:
        return self._words[at].astype(np.uint64)

    def common(self, i: int, j: int) -> int:
        differ = np.flatnonzero(self.text[i : i + WIDTH] != self.text[j : j + WIDTH])
        return int(differ[0]) if len(differ) else WIDTH

    def minima(self) -> Iterator[np.ndarray]:
        """Starts of the runs of equal bytes that are local minima, chunk by chunk."""
        starts, values = np.zeros(1, np.int64), self.text[:1].astype(np.int64)
        for lo in range(1, self.n, self.chunk):
            part = self.text[lo - 1 : min(lo + self.chunk, self.n)]
            new = np.flatnonzero(part[1:] != part[:-1]) + lo
            starts, values = np.concatenate([starts, new]), np.concatenate([values, self.text[new].astype(np.int64)])
            if len(values) > 2:
                yield starts[1:-1][(values[:-2] > values[1:-1]) & (values[1:-1] < values[2:])]
                starts, values = starts[-2:], values[-2:]

    def _sorted(self, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions that agree in ``depth`` bytes sorted by DEPTH bytes, and the common prefixes of neighbours."""
        key = self.words(at + depth)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        common = np.full(len(at), DEPTH, np.int64)
        group = np.zeros(len(at), np.int64)
        for k in range(depth, DEPTH, 8):
            if k > depth:
                tied = np.zeros(len(at), bool)
                same = group[1:] == group[:-1]
                tied[1:] |= same
                tied[:-1] |= same
                t = np.flatnonzero(tied)
                if not len(t):
                    break
                key = self.words(at[t] + k)
                by = np.lexsort((key, group[t]))
                at[t], key = at[t][by], key[by]
            else:
                t = np.arange(len(at))
            differ = key[1:] ^ key[:-1]
            fresh = (group[t][1:] == group[t][:-1]) & (differ != 0)
            zeros = sum(((differ >> np.uint64(s)) == 0).astype(np.int64) for s in range(56, 0, -8))
            common[t[1:][fresh]] = k + zeros[fresh]
            head = np.zeros(len(at), bool)
            head[0] = True
            head[1:] = group[1:] != group[:-1]
            head[t[1:][fresh]] = True
            group = np.cumsum(head)
        return at, np.minimum(common, WIDTH).astype(np.uint8)

    def _settle(self, queue: Queue, depth: int, out: Queue, last: list[int]) -> None:
        """Sorts a queue of suffixes that agree in ``depth`` bytes into another one."""
        if queue.size <= self.chunk or depth >= DEPTH:
            while queue.size:
                at, common = queue.take(self.chunk)
                at, common = self._sorted(at, depth) if depth < DEPTH else (at, np.full(len(at), WIDTH, np.uint8))
                common[0] = self.common(last[-1], int(at[0])) if last else 0
                last[:] = [int(at[-1])]
                out.push(at, common)
            return
        deeper = self.pool.many(256)
        while queue.size:
            self._deal(queue.take(self.chunk)[0], depth, deeper)
        for q in deeper:
            if q.size:
                self._settle(q, depth + 1, out, last)
        self.pool.queues = [q for q in self.pool.queues if q not in set(deeper)]

    def _deal(self, at: np.ndarray, depth: int, queues: list[Queue]) -> None:
        byte = self.text[at + depth]
        by = np.argsort(byte, kind="stable")
        counts = np.bincount(byte, minlength=256)
        ends = np.cumsum(counts)
        for b in np.flatnonzero(counts):
            mine = at[by[ends[b] - counts[b] : ends[b]]]
            queues[b].push(mine, np.zeros(len(mine), np.uint8))

    def _induce(self, at: np.ndarray, common: np.ndarray, queues: list[Queue], since: np.ndarray, seen: np.ndarray, keeps: Callable[[np.ndarray], np.ndarray]) -> None:
        """Pushes the predecessors by a byte that ``keeps`` admits, each with its common prefix.

        ``since`` has for each queue the least common prefix of what was processed since its last item was induced, ``seen`` whether it ever had one.
        """
        if len(at) == 1:
            p = int(at[0])
            np.minimum(since, common[0], out=since)
            if p and keeps(self.text[p - 1]):
                c = int(self.text[p - 1])
                queues[c].push(at - 1, np.array([min(int(since[c]), WIDTH - 1) + 1 if seen[c] else 0], np.uint8))
                since[c], seen[c] = NONE, True
            return
        byte = self.text[np.maximum(at - 1, 0)]
        idx = np.flatnonzero(keeps(byte) & (at > 0))
        upto = np.minimum.accumulate(common[::-1])[::-1]
        if not len(idx):
            np.minimum(since, upto[0], out=since)
            return
        idx = idx[np.argsort(byte[idx], kind="stable")]
        c = byte[idx]
        head = np.append(0, np.flatnonzero(c[1:] != c[:-1]) + 1)
        lo = np.empty(len(idx), np.int64)
        lo[1:] = idx[:-1] + 1
        lo[head] = 0
        least = least_between(common, lo, idx)
        mine = c[head]
        least[head] = np.minimum(least[head], since[mine])
        new = np.minimum(least, WIDTH - 1) + np.uint8(1)
        new[head[~seen[mine]]] = 0
        ends = np.append(head[1:], len(idx))
        np.minimum(since, upto[0], out=since)
        since[mine] = np.append(upto, np.uint8(NONE))[idx[ends - 1] + 1]
        seen[mine] = True
        prev = at[idx] - 1
        for b, x, y in zip(mine.tolist(), head.tolist(), ends.tolist(), strict=True):
            queues[b].push(prev[x:y], new[x:y])

    def run(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes from the largest to the smallest by 50 bytes at least, in runs, each with its common prefix with the one before it."""
        seeds, raw, queues, large = (self.pool.many(256) for _ in range(4))
        for at in self.minima():
            self._deal(at, 0, raw)
        since, seen = np.full(256, NONE, np.uint8), np.zeros(256, bool)
        queues[self.text[self.n - 1]].push(np.array([self.n - 1], np.int64), np.zeros(1, np.uint8))
        seen[self.text[self.n - 1]] = True
        for b in range(256):
            last = None
            while queues[b].size:
                at, common = queues[b].take(self.chunk)
                large[b].push(at, common)
                self._induce(at, common, queues, since, seen, lambda c, b=b: c >= b)
                last = int(at[-1])
            if raw[b].size:
                self._settle(raw[b], 1, seeds[b], [])
            fresh = True
            while seeds[b].size:
                at, common = seeds[b].take(self.chunk)
                if fresh:
                    common = common.copy()
                    common[0] = self.common(last, int(at[0])) if last is not None else 0
                    fresh = False
                self._induce(at, common, queues, since, seen, lambda c, b=b: c > b)
        since, seen = np.full(256, NONE, np.uint8), np.zeros(256, bool)
        for b in reversed(range(256)):
            last = None
            while queues[b].size:
                at, common = queues[b].take(self.chunk)
                yield at, common
                self._induce(at, common, queues, since, seen, lambda c, b=b: c <= b)
                last = int(at[-1])
            follows = None
            for at, common in large[b].backwards(self.chunk):
                end = follows if follows is not None else self.common(last, int(at[-1])) if last is not None else 0
                follows = int(common[0])
                at, common = at[::-1], np.append(np.uint8(end), common[:0:-1])
                yield at, common
                self._induce(at, common, queues, since, seen, lambda c, b=b: c < b)


def kernel(payload: np.ndarray, ends: np.ndarray, owner: np.ndarray, limit: int = POOL_ITEMS, chunk: int = CHUNK) -> np.ndarray:
    """The smallest owner of each window of each fragment, windows in order."""
    size = np.diff(ends, prepend=0)
    begin = ends - size + np.arange(len(size)) + 1
    n = int(ends[-1]) + len(size) + 1
    text = table(n + 80, np.uint8, 0)
    count = np.maximum(size - WIDTH + 1, 0)
    number_at = np.concatenate([[0], np.cumsum(count)])
    windows = int(number_at[-1])
    kind = np.int32 if windows < 1 << 31 else np.int64
    starts, own = table(n, kind, -1), table(windows, np.int64)
    # fragments in runs of bounded size
    for run in np.split(np.arange(len(size)), np.flatnonzero(np.diff((ends - 1) // chunk)) + 1):
        text[overlap.gather(begin[run], size[run])] = payload[ends[run[0]] - size[run[0]] : ends[run[-1]]]
        lo, hi = number_at[run[0]], number_at[run[-1] + 1]
        starts[overlap.gather(begin[run], count[run])] = np.arange(lo, hi)
        own[lo:hi] = np.repeat(owner[run], count[run])
    group, least = table(windows, kind), table(windows, np.int64, np.iinfo(np.int64).max)
    now = seen = 0
    for at, common in Sorter(text, n, limit, chunk).run():
        number = starts[at]
        ids = now + np.cumsum(common < WIDTH)
        now = int(ids[-1])
        mine = number >= 0
        number, ids = number[mine], ids[mine]
        if len(number):
            # groups without a window leave gaps: no more numbers are used than windows
            head = np.append(True, ids[1:] != ids[:-1])
            first = seen - (seen > 0 and bool(ids[0] == last))
            place = first + np.cumsum(head) - 1
            group[number] = place
            at_ = np.flatnonzero(head)
            least[place[at_]] = np.minimum(least[place[at_]], np.minimum.reduceat(own[number], at_))
            seen, last = int(place[-1]) + 1, ids[-1]
    for lo in range(0, windows, chunk):
        own[lo : lo + chunk] = least[group[lo : lo + chunk]]
    return own


def _finish(b: scan.Block, _: None, first: np.ndarray, covered: np.ndarray) -> pa.Table:
    edge = np.zeros(len(covered) + 1, bool)
    edge[:-1] = covered
    edge[1:-1] &= ~covered[:-1]
    inner = first[:-1][first[:-1] < len(covered)]
    edge[inner] = np.append(covered, False)[inner]
    kept = ~covered
    data = memoryview(b.buf[kept].tobytes())
    at = np.concatenate([[0], np.cumsum(kept)])[first]
    shas = [hashlib.sha256(data[at[i] : at[i + 1]]).hexdigest() for i in range(b.n)]
    return pa.table({"doc_id": b.rows.column(0), "n_bytes": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(scan.sums(covered, first), pa.int64()), "n_spans": pa.array(scan.sums(edge[:-1], first), pa.int64()), "kept_sha256": pa.array(shas, pa.string())})


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return overlap.remove_repeated(docs, UNITS, kernel, _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", "doc_id", "text")


def apply(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, kept, removed): the bytes that are left, which need not be UTF-8 any more, and the removed byte ranges."""

    def finish(b: scan.Block, _: None, first: np.ndarray, covered: np.ndarray) -> pa.Table:
        kept, spans = [], []
        for i in range(b.n):
            c = covered[first[i] : first[i + 1]]
            kept.append(b.buf[first[i] : first[i + 1]][~c].tobytes())
            edges = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(np.int8), [0]])))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
        return pa.table({id_column: b.rows.column(0), "kept": pa.array(kept, pa.binary()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return overlap.remove_repeated(docs, UNITS, kernel, finish, f"`{id_column}` long, kept binary, removed array<struct<start:long,end:long>>", id_column, text_column)


ORACLE = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, i, substring(x, 2 * i + 1, {2 * WIDTH}) AS w FROM h, unnest(range(0, length(x) // 2 - {WIDTH - 1})) AS u(i)),
o AS (SELECT w, min(doc_id) AS first FROM g GROUP BY w),
r AS (SELECT doc_id, i FROM g JOIN o USING (w) WHERE first < doc_id),
l AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {WIDTH} THEN 0 ELSE 1 END AS new FROM r),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM l),
s AS (SELECT doc_id, min(i) AS a, max(i) + {WIDTH} AS b FROM n GROUP BY doc_id, run),
p AS (SELECT doc_id, b AS lo, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS hi FROM s UNION ALL SELECT doc_id, 0, min(a) FROM s GROUP BY doc_id),
k AS (SELECT p.doc_id, string_agg(substring(x, 2 * lo + 1, 2 * (coalesce(hi, length(x) // 2) - lo)), '' ORDER BY lo) AS kept FROM p JOIN h ON h.doc_id = p.doc_id GROUP BY p.doc_id),
c AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT h.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM h LEFT JOIN c ON c.doc_id = h.doc_id LEFT JOIN k ON k.doc_id = h.doc_id"""
