"""Harmonic packing of token sequences.

A document's tokens are cut into pieces: full sequences first, then at most ``CUTS`` pieces whose length is
exactly a reciprocal share of the capacity (capacity // k), then one last piece. A piece of length n belongs
to class k = capacity // n and every bin of class k takes exactly k pieces, so each worker fills its bins
without asking any other. Bins that a worker leaves unfilled at its end (fewer than k pieces for each k, so a
bounded number) are packed together by first fit, longest first. Tokenising, cutting and packing run in one
pass without a shuffle.

Ids: the ``tokenizers`` file at ``vocabulary``; where a text has only characters on which both libraries
provably split alike, the same vocabulary (compared token by token) is run by the faster ``tiktoken``. A null or empty
text is the end id alone. Repeated and null ids and rows are packed like others; an empty table gives no pieces;
further columns are ignored. A very long text is tokenised whole in one task.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CAPACITY = 2048
CUTS = 2
LEAST_PIECE = 16
END_ID = 1

#: A character outside of these goes to the slower library.
PLAIN = re.compile("[^\t\n\r\\x20-\\x7E¡-¬®-ɏ–—‘’“”…]")
SPECIAL = "<|endoftext|>"


def same_vocabulary(tokens: dict[str, int], ranks: dict[bytes, int]) -> bool:
    """Whether every token of the ranks has that id in a byte-level vocabulary, whose other tokens are special ones in angle brackets.

    Printable bytes stand for themselves there; the others, in order, for the characters from 256 on.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    letter = [chr(b) if b in printable else chr(256 + hidden.index(b)) for b in range(256)]
    named = {"".join(letter[b] for b in token): rank for token, rank in ranks.items()}
    return all(tokens.get(t) == rank for t, rank in named.items()) and all(t in named or re.fullmatch(r"<.*>", t) for t in tokens)


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """text -> uint32 ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    ranks_file = re.sub(r"\.json$", ".tiktoken", vocabulary)
    fast = None
    if os.path.exists(ranks_file):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if same_vocabulary(slow.get_vocab(), ranks):
            split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            fast = tiktoken.Encoding("packing", pat_str=split, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if fast is not None and SPECIAL not in text and not PLAIN.search(text):
            return np.asarray(fast.encode_to_numpy(text), np.uint32)
        return np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    for _ in range(CUTS):
        if rest < 2 * LEAST_PIECE:
            break
        share = capacity // -(-capacity // rest)
        if rest == share:
            break
        out.append(share)
        rest -= share
    return out + [rest] * (rest > 0)


class Bins:
    """One worker's bins: an open bin per class, closed at k pieces."""

    def __init__(self, first_id: int, capacity: int = CAPACITY) -> None:
        self.capacity, self._next, self._open = capacity, first_id, {}

    def _new(self) -> int:
        self._next += 1
        return self._next - 1

    def add(self, length: int, piece: int) -> list[tuple[int, int, int]]:
        """(piece, sequence, offset) of the pieces that this one completes a bin of."""
        k = self.capacity // length
        held = self._open.setdefault(k, [])
        held.append((length, piece))
        if len(held) < k:
            return []
        del self._open[k]
        return self._close(held)

    def _close(self, held: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        sequence, at, out = self._new(), 0, []
        for length, piece in held:
            out.append((piece, sequence, at))
            at += length
        return out

    def rest(self) -> list[tuple[int, int, int]]:
        """Packs what open bins hold: first fit, longest first."""
        bins: list[list[tuple[int, int]]] = []
        room: list[int] = []
        for length, piece in sorted((x for held in self._open.values() for x in held), key=lambda x: (-x[0], x[1])):
            i = next((i for i, r in enumerate(room) if r >= length), None)
            if i is None:
                bins.append([])
                room.append(self.capacity)
                i = len(bins) - 1
            bins[i].append((length, piece))
            room[i] -= length
        self._open = {}
        return [x for held in bins for x in self._close(held)]


PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the token ids themselves as array<int>."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    more = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), *PIECES.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        context = TaskContext.get()
        bins = Bins((context.partitionId() if context else 0) << 36, capacity)
        pieces: dict[int, tuple] = {}
        count = 0

        def rows(placed: list[tuple[int, int, int]]) -> list[tuple]:
            out = []
            for piece, sequence, offset in placed:
                doc, start, length, crc, total, ids = pieces.pop(piece)
                out.append((doc, start, length, crc, total, sequence, offset, ids))
            return out

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            arrays = [pa.array(cols[0], kind)] + [pa.array(c, pa.int64()) for c in cols[1:7]] + ([pa.array(cols[7], pa.list_(pa.int32()))] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        kind, done = pa.int64(), []
        for batch in batches:
            kind = batch.schema.field(0).type
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 256):
                for doc, text in zip(batch.column(0).slice(lo, 256).to_pylist(), texts.slice(lo, 256).to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                    data, at = memoryview(ids).cast("B"), 0
                    for length in cut(len(ids), capacity):
                        pieces[count] = (doc, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), len(ids), ids[at : at + length].astype(np.int32) if with_ids else None)
                        done += rows(bins.add(length, count))
                        at += length
                        count += 1
                if len(done) > 8192:
                    yield batch_of(done)
                    done = []
        done += rows(bins.rest())
        if done:
            yield batch_of(done)

    packed = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(run, schema)
    return packed.withColumnRenamed("id", id_column)
