"""Which windows of a document also start in a document with a smaller id: the plan that two operators share.

A window is ``width`` consecutive units (bytes or words) of one document. Its anchor is the smallest hash of
the ``gram``-unit strings inside it, so equal windows have equal anchors. Documents are dealt into groups by
id and text, once; then:

1. every group sends the sorted set of its anchors, 6 bytes and a capped count each, to buckets (a truncated hash can
   only add work, never lose a match);
2. a bucket answers with two bits per anchor: whether more than one document has it, and whether it is hot;
3. groups cut the runs of windows with a shared anchor into fragments, collapse equal fragments, and send the
   text of each, with the smallest id that has it, to the shard of its anchor: all equal windows meet there;
4. a shard runs the operator's own index over its fragments and answers with one bit per window: whether it
   also starts in a document with a smaller id than the group's own for that fragment;
5. groups put the bits together per document.

A fragment that millions of documents share is sent once by each group, so whole copies cost a shard no more
than the number of groups. At the edges of a hot passage fragments reach into the text around it and differ. An anchor
with HOT_RUNS runs or more is hot: its runs are cut into single windows, and each goes to the shard of its own hash, so
that they spread over all shards.

All messages are binary columns, one row per (sender, receiver). Their number is groups x buckets and groups x shards:
it grows with the square of the input until a message holds a single anchor, and in proportion from there on. Groups grow
from GROUP_BYTES to GROUP_MOST with the input, buckets take BUCKET_BYTES of it and shards SHARD_BYTES, which keeps the
square small. Everything is one plan, and its first exchange is reused by steps 1, 3 and 5.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import scan, work

#: Input bytes in a group of documents: so many up to GROUPS groups, then more, up to GROUP_MOST.
GROUP_BYTES, GROUPS, GROUP_MOST = 8 << 20, 512, 32 << 20
#: Input bytes whose anchors make a bucket, and whose fragments make a shard.
BUCKET_BYTES, SHARD_BYTES = 16 << 20, 4 << 20
#: Runs of an anchor, as far as groups count them (255 each), from which it is hot.
HOT_RUNS = 100_000


@dataclass(frozen=True)
class Units:
    """What a window is made of. ``split`` gives unit values and the first unit of each document, ``cut`` the bytes of unit ranges; a shard is indexed in ``parts``, one after another."""

    width: int
    gram: int
    parts: int
    split: Callable[[scan.Block], tuple[np.ndarray, np.ndarray, object]]
    cut: Callable[[scan.Block, object, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    size = 1
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:]) if len(h) > size else h[:0]
        size *= 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :]) if size < w and len(h) > w - size else h if size == w else h[:0]


def runs(units: Units, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of the maximal runs of windows of one document with one anchor."""
    n = len(values) - units.width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64)
    anchor = sliding_min(scan.Prefix(values, scan.POW_W).rolling(units.gram), units.width - units.gram + 1)[:n]
    inner = first[1:-1]
    bad = np.zeros(n + 1, np.int32)
    np.add.at(bad, np.clip(inner - units.width + 1, 0, n), 1)
    np.add.at(bad, np.clip(inner, 0, n), -1)
    ok = np.cumsum(bad[:-1]) <= 0
    begins = ok.copy()
    begins[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
    # the first window of a document starts a run even if the one before, of another document, has its anchor
    starts = inner[inner < n]
    begins[starts] |= ok[starts]
    at = np.flatnonzero(begins)
    if not len(at):
        return none, none, none.astype(np.uint64)
    total = np.concatenate([[0], np.cumsum(ok)])
    return at, total[np.append(at[1:], n)] - total[at], anchor[at]


def _blocks(group: pa.Table) -> list[scan.Block]:
    """Blocks of a group's rows in one order, whatever order a shuffle has brought them in."""
    group = group.select(["id", "text"]).sort_by([("id", "ascending"), ("text", "ascending")])
    return list(scan.blocks(iter(group.combine_chunks().to_batches()), "text"))


def _anchors(units: Units, group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Distinct truncated anchors of a group in order, whether more than one of its documents has each, how many runs it has, and the runs by block."""
    seen, per = [], []
    for b in _blocks(group):
        values, first, more = units.split(b)
        at, size, anchor = runs(units, values, first)
        short = anchor >> np.uint64(16)
        ids = b.column("id")[np.searchsorted(first, at, side="right") - 1]
        per.append((b, more, first, at, size, short, ids))
        seen.append((short, ids))
    short = np.concatenate([s for s, _ in seen]) if seen else np.zeros(0, np.uint64)
    ids = np.concatenate([i for _, i in seen]) if seen else np.zeros(0, np.int64)
    order = np.argsort(short)
    short, ids = short[order], ids[order]
    heads = np.flatnonzero(np.append(True, short[1:] != short[:-1])) if len(short) else np.zeros(0, np.int64)
    if not len(heads):
        return short, np.zeros(0, bool), heads, per
    return short[heads], np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads), np.diff(heads, append=len(short)), per


def bounds(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_keys, np.arange(n + 1))


def message(dest: list, peer: list, blobs: list) -> pa.Table:
    return pa.table({"dest": pa.array(dest, pa.int32()), "peer": pa.array(peer, pa.int32()), "blob": pa.array(blobs, pa.binary())})


MESSAGE = "dest int, peer int, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one message, each behind its length in bytes."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return b"".join(x for p in parts for x in (len(p).to_bytes(8, "little"), p))


def squeeze(*arrays: np.ndarray) -> bytes:
    """A packed message under Zstandard; ``unpack`` knows it by its magic number, which no length begins with."""
    return zstandard.ZstdCompressor(level=1).compress(pack(*arrays))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    if blob[:4] == zstandard.FRAME_HEADER:
        blob = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 0, []
    for kind in kinds:
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(np.frombuffer(blob, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _six(values: np.ndarray) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _eight(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = data.reshape(-1, 6)
    return out.view("<u8").ravel()


Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Finish = Callable[[scan.Block, object, np.ndarray, np.ndarray], pa.Table]


def remove_repeated(docs: DataFrame, units: Units, kernel: Kernel, finish: Finish, schema: str, id_column: str, text_column: str) -> DataFrame:
    """Runs the plan. ``kernel(payload, ends, owner)`` gives a bit per window of the distinct fragments of a shard part;
    ``finish(block, more, first, covered units)`` gives the rows of a block of documents."""
    size = work.input_bytes(docs)
    n, buckets, shards = (work.groups(docs, b) for b in (min(GROUP_MOST, max(GROUP_BYTES, size // GROUPS)), BUCKET_BYTES, SHARD_BYTES))
    hot_runs = HOT_RUNS
    # a null id counts as the largest; rows that share an id need not meet
    ids = F.coalesce(F.col(id_column).cast("long"), F.lit((1 << 63) - 1))
    dealt = docs.select(ids.alias("id"), F.col(text_column).alias("text"), F.pmod(F.xxhash64(ids, F.col(text_column)), F.lit(n)).cast("int").alias("g"))
    dealt = dealt.repartition(n, "g")

    def say(group: pa.Table) -> pa.Table:
        g = group.column("g")[0].as_py()
        keys, many, runs_, _ = _anchors(units, group)
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = bounds(bucket[order], buckets)
        counts = np.minimum(runs_, 255).astype(np.uint8)
        dest, blobs = [], []
        for b in range(buckets):
            mine = order[cut[b] : cut[b + 1]]
            if len(mine):
                dest.append(b)
                blobs.append(squeeze(_six(keys[mine]), np.packbits(many[mine]), counts[mine]))
        return message(dest, [g] * len(dest), blobs)

    def match(group: pa.Table) -> pa.Table:
        b, peers = group.column("dest")[0].as_py(), group.column("peer").to_pylist()
        keys, many, counts, sizes = [], [], [], []
        for blob in group.column("blob").to_pylist():
            six, bits, c = unpack(blob, "u1", "u1", "u1")
            k = _eight(six)
            keys.append(k)
            sizes.append(len(k))
            counts.append(c)
            many.append(np.unpackbits(bits)[: len(k)].astype(bool))
        key, flag, count = np.concatenate(keys), np.concatenate(many), np.concatenate(counts)
        order = np.argsort(key)
        heads = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        times = np.diff(heads, append=len(key))
        of_key = (times > 1) | np.logical_or.reduceat(flag[order], heads), np.add.reduceat(count[order].astype(np.int64), heads) >= hot_runs
        shared, hot = np.empty(len(key), bool), np.empty(len(key), bool)
        shared[order], hot[order] = (np.repeat(x, times) for x in of_key)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        # back to the groups: who asked is now who is told
        return message(peers, [b] * len(peers), [pack(*(np.packbits(x[cut[i] : cut[i + 1]]) for x in (shared, hot))) for i in range(len(peers))])

    def fragments(group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows or not told.num_rows:
            return message([], [], [])
        g = group.column("g")[0].as_py()
        keys, _, _, per = _anchors(units, group)
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = bounds(bucket[order], buckets)
        shared, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for b, blob in zip(told.column("peer").to_pylist(), told.column("blob").to_pylist(), strict=True):
            mine = order[cut[b] : cut[b + 1]]
            shared[mine], hot[mine] = (np.unpackbits(x)[: len(mine)].astype(bool) for x in unpack(blob, "u1", "u1"))
        keys, hot = keys[shared], hot[shared]
        texts, lens, shorts, counts, owners, docs_, starts, one, two = ([] for _ in range(9))
        base = 0
        for b, more, first, at, size, short, own in per:
            place = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == short) if len(keys) else np.zeros(0, np.int64)
            if len(hit):
                at, size, short, own, single = at[hit], size[hit], short[hit], own[hit], hot[place[hit]]
                if single.any():
                    # the runs of hot anchors as single windows
                    times = np.where(single, size, 1)
                    at = gather(at, times)
                    size, short, own, single = np.repeat(np.where(single, 1, size), times), np.repeat(short, times), np.repeat(own, times), np.repeat(single, times)
                payload, ends = units.cut(b, more, at, at + size + units.width - 1)
                x, y = scan.range_hashes(payload, ends)
                one.append(x)
                two.append(y)
                texts.append(payload)
                lens.append(np.diff(ends, prepend=0))
                shorts.append(np.where(single, x >> np.uint64(16), short))
                counts.append(size)
                owners.append(own)
                d = np.searchsorted(first, at, side="right") - 1
                docs_.append(d + base)
                starts.append(at - first[d])
            base += b.n
        if not texts:
            return message([], [], [])
        payload, lens, short, count, owner = (np.concatenate(x) for x in (texts, lens, shorts, counts, owners))
        doc, start, one, two = (np.concatenate(x) for x in (docs_, starts, one, two))
        # equal fragments collapse; the smallest id owns them
        order = np.lexsort((owner, two, one))
        head = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(head) - 1
        rep = order[head]
        shard = ((short[rep] >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)
        # fragments by shard: number them in the order in which they are sent
        by = np.argsort(shard, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        rep, shard, which = rep[by], shard[by], place[which]
        begin = np.concatenate([[0], np.cumsum(lens)])[:-1]
        cut, dest, blobs = bounds(shard, shards), [], []
        for s in range(shards):
            lo, hi = cut[s], cut[s + 1]
            if lo < hi:
                r = rep[lo:hi]
                dest.append(s)
                blobs.append(squeeze(payload[gather(begin[r], lens[r])], lens[r].astype("<u4"), (short[r] % np.uint64(units.parts)).astype("u1"), owner[r].astype("<i8"), count[r].astype("<u4")))
        # to itself: where each fragment stands
        dest.append(shards + g)
        blobs.append(squeeze(doc.astype("<u4"), start.astype("<u4"), which.astype("<u4"), count[rep].astype("<u4"), owner[rep].astype("<i8"), shard.astype("<u4")))
        return message(dest, [g] * len(dest), blobs)

    def answer(group: pa.Table) -> pa.Table:
        dest = group.column("dest")[0].as_py()
        peers, blobs = group.column("peer").to_pylist(), group.column("blob").to_pylist()
        if dest >= shards:
            return message(peers, [-1] * len(peers), blobs)
        got = [unpack(x, "u1", "<u4", "u1", "<i8", "<u4") for x in blobs]
        payload, lens, part, owner, count = (np.concatenate([x[i] for x in got]) for i in range(5))
        lens, count = lens.astype(np.int64), count.astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(lens)])[:-1]
        bit_at = np.concatenate([[0], np.cumsum(count)])
        bits = np.zeros(bit_at[-1], bool)
        for p in range(units.parts):
            mine = np.flatnonzero(part == p)
            if not len(mine):
                continue
            text, size = payload[gather(begin[mine], lens[mine])], lens[mine]
            ends = np.cumsum(size)
            one, two = scan.range_hashes(text, ends)
            order = np.lexsort((two, one))
            head = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
            which = np.empty(len(order), np.int64)
            which[order] = np.cumsum(head) - 1
            rep = order[head]
            least = np.minimum.reduceat(owner[mine][order], np.flatnonzero(head))
            text = text[gather((ends - size)[rep], size[rep])]
            windows = count[mine][rep]
            smallest = kernel(text, np.cumsum(size[rep]), least)
            w_at = np.concatenate([[0], np.cumsum(windows)])
            if w_at[-1] != len(smallest):
                raise AssertionError("the index lost windows")
            spread = smallest[gather(w_at[:-1][which], count[mine])]
            bits[gather(bit_at[:-1][mine], count[mine])] = spread < np.repeat(owner[mine], count[mine])
        cut = np.concatenate([[0], np.cumsum([len(x[1]) for x in got])])
        return message(peers, [dest] * len(peers), [squeeze(np.packbits(bits[bit_at[cut[i]] : bit_at[cut[i + 1]]])) for i in range(len(peers))])

    def put_together(group: pa.Table, told: pa.Table) -> pa.Table:
        rows = _blocks(group)
        parsed = [(b, *units.split(b)) for b in rows] if told.num_rows else []
        marks = [np.zeros(len(values) + 1, np.int32) for _, values, _, _ in parsed]
        if told.num_rows:
            peers, blobs = told.column("peer").to_pylist(), told.column("blob").to_pylist()
            doc, start, which, count, owner, shard = unpack(blobs[peers.index(-1)], "<u4", "<u4", "<u4", "<u4", "<i8", "<u4")
            count = count.astype(np.int64)
            bits = np.zeros(count.sum(), bool)
            bit_at = np.concatenate([[0], np.cumsum(count)])
            cut = np.searchsorted(shard, np.arange(shards + 1))
            for s, blob in zip(peers, blobs, strict=True):
                if s >= 0:
                    lo, hi = bit_at[cut[s]], bit_at[cut[s + 1]]
                    bits[lo:hi] = np.unpackbits(unpack(blob, "u1")[0])[: hi - lo]
            base = 0
            for (b, _, first, _), mark in zip(parsed, marks, strict=True):
                lo, hi = np.searchsorted(doc, [base, base + b.n])
                f = which[lo:hi].astype(np.int64)
                d = doc[lo:hi].astype(np.int64) - base
                later = b.column("id")[d] > owner[f]
                on = bits[gather(bit_at[:-1][f], count[f])] | np.repeat(later, count[f])
                at = gather(first[d] + start[lo:hi], count[f])[on]
                np.add.at(mark, at, 1)
                np.add.at(mark, at + units.width, -1)
                base += b.n
        out = []
        for k, b in enumerate(rows):
            _, values, first, more = parsed[k] if parsed else (b, *units.split(b))
            covered = np.cumsum(marks[k][:-1]) > 0 if parsed else np.zeros(len(values), bool)
            out.append(finish(b, more, first, covered))
        return pa.concat_tables(out)

    asked = dealt.groupBy("g").applyInArrow(say, MESSAGE)
    shared = asked.groupBy("dest").applyInArrow(match, MESSAGE)
    sent = dealt.groupBy("g").cogroup(shared.groupBy("dest")).applyInArrow(fragments, MESSAGE)
    told = sent.groupBy("dest").applyInArrow(answer, MESSAGE)
    out = dealt.groupBy("g").cogroup(told.groupBy("dest")).applyInArrow(put_together, schema)
    return out.withColumn(id_column, F.nullif(F.col(id_column), F.lit((1 << 63) - 1)))


def gather(begins: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions of the ranges begins[i]:begins[i]+lens[i], one after another."""
    lens = lens.astype(np.int64)
    ends = np.cumsum(lens)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(begins.astype(np.int64) - (ends - lens), lens) + np.arange(ends[-1])


def brute(items: list[tuple[int, list]], width: int) -> dict[int, list[bool]]:
    """Which units are removed, by the definition; for small inputs."""
    owner: dict = {}
    for doc, seq in items:
        for i in range(len(seq) - width + 1):
            key = tuple(seq[i : i + width])
            owner[key] = min(owner.get(key, doc), doc)
    out = {}
    for doc, seq in items:
        gone = [False] * len(seq)
        for i in range(len(seq) - width + 1):
            if owner[tuple(seq[i : i + width])] < doc:
                gone[i : i + width] = [True] * width
        out[doc] = gone
    return out
