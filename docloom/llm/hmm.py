"""Language-model scoring with a hidden Markov model.

Tokens are words, lower-cased in A-Z, and one end per text. Every token has a class: the OWN most frequent ones have
one of their own, others share HASHED classes by their hash. Latent states emit classes, and a class emits its tokens by
their smoothed share in the training texts, so the model's tables stay of one size while the vocabulary, of any
size, is counted whole.

1. A task writes its texts in blocks: the distinct tokens of a block as 96-bit hashes with their counts in training texts,
   the most frequent first, and the texts as numbers into that list under Zstandard. Counts are added up across blocks by
   a window over all rows of a token, of which each block has one.
2. Baum-Welch: each round every task runs the forward and backward recursions over its training texts and emits
   expected counts by class; these are added up by Spark across partitions, in as many rows as there are classes, and the
   driver re-estimates. Rounds end when the likelihood grows by less than TOLERANCE of itself, or after ROUNDS.
3. The counts go back to the blocks, and the scaled forward recursion over each whole text gives its exact likelihood.

Recursions run over whole texts. Texts of more than SEGMENT tokens are cut for the run alone: the product of the
transition and emission matrices of a segment says how it carries a state distribution on, so a pass over
segments gives each the exact distributions at its borders, and all segments of a block then run side by side. Memory is
bounded by BLOCK_TOKENS whatever the length of a text, but for two bytes or four for each of its tokens.

Texts whose crc32 of the id as text is 0 modulo ``FOLDS`` are held out: no count or expectation sees them.

Defined results: a null or empty text is one end token; a null id counts as the text ""; rows that repeat an
id are texts of their own; with no training text all counts are 0; an empty table gives an empty result;
further columns are ignored. Sums of doubles across partitions have no fixed order, so ``score`` may differ between
runs in its last digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import overlap, scan, work

FOLDS = 10
STATES = 8
#: Classes of one token each, and classes that all others share.
OWN, HASHED = 2048, 4096
ROUNDS, TOLERANCE = 5, 1e-3
#: Tokens of a segment, tokens whose forward values are held at a time, and tokens in a block.
SEGMENT, BLOCK_TOKENS, ENCODED_TOKENS = 1024, 250_000, 1_000_000
#: Steps after which products of matrices are scaled.
SCALED = 16
ADD = 0.1
END = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


def held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(str("" if i is None else i).encode()) % FOLDS == 0 for i in ids], bool)


def tokens(b: scan.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every token, ends included, and the first token of each document."""
    buf = scan.LOWER[b.buf]
    w = scan.words(buf, b.offsets, scan.WORD)
    first = w.first + np.arange(b.n + 1)
    total = len(w.starts) + b.n
    where = np.ones(total, bool)
    where[first[1:] - 1] = False
    out = []
    for second in (False, True):
        h = np.full(total, END[second], np.uint64)
        h[where] = scan.byte_prefix(buf, second).ranges(w.starts, w.ends)
        out.append(h)
    return out[0], out[1], first


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs together, and where in it a new pair begins."""
    order = np.argsort(one)
    a, b = one[order], two[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
    return order, np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]


ENCODED = "block long, ids array<long>, held array<boolean>, sizes array<int>, one binary, two binary, counts binary, numbers binary"


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The texts in blocks, one row each: ids, folds, sizes, distinct tokens with their training counts, and the texts as numbers into those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, done = (context.partitionId() if context else 0) << 32, 0
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            ids = [i for part, *_ in held for i in part]
            one, two = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            sizes = np.concatenate([h[3] for h in held])
            out = held_out(ids)
            order, new = _distinct(one, two)
            number = np.empty(len(one), np.int32)
            number[order] = np.cumsum(new, dtype=np.int32) - 1
            # small numbers for frequent tokens
            by_use = np.argsort(-np.bincount(number), kind="stable")
            place = np.empty(len(by_use), np.int32)
            place[by_use] = np.arange(len(by_use), dtype=np.int32)
            number = place[number]
            counts = np.bincount(number[np.repeat(~out, sizes)], minlength=len(by_use))
            squeezed = zstandard.ZstdCompressor(level=1).compress(number.astype("<u2" if len(by_use) <= 1 << 16 else "<u4").tobytes())
            values = ([task + done], [ids], [out], [sizes.astype(np.int32)], *([x.tobytes()] for x in (one[order][new][by_use], two[order][new][by_use].astype("<u4"), counts.astype("<u4"))), [squeezed])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("one", "two", "counts", "numbers"))])
        size = 0
        for b in scan.blocks(batches, "text"):
            one, two, first = tokens(b)
            two &= np.uint64(0xFFFFFFFF)
            held.append((b.rows.column(0).to_pylist(), one, two, np.diff(first)))
            size += len(one)
            if size >= ENCODED_TOKENS:
                yield block()
                held, size, done = [], 0, done + 1
        if held:
            yield block()

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return work.table(rows.mapInArrow(run, ENCODED), "encoded")


VOCABULARY = pa.schema([("block", pa.int64()), ("number", pa.int32()), ("one", pa.int64()), ("two", pa.int32()), ("c", pa.int64())])


def vocabulary(encoded: DataFrame) -> DataFrame:
    """The distinct tokens of each block (block, number, one, two, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, one, two, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                one, two, counts = np.frombuffer(one, "<i8"), np.frombuffer(two, "<i4"), np.frombuffer(counts, "<u4")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), block)), pa.array(np.arange(len(one), dtype=np.int32)), pa.array(one), pa.array(two), pa.array(counts.astype(np.int64))], schema=VOCABULARY)

    return encoded.select("block", "one", "two", "counts").mapInArrow(run, "block long, number int, one long, two int, c long")


def totals(words: DataFrame) -> DataFrame:
    """(block, number, total, one, two): each token of each block with its count over all blocks; one row of a token alone has its hashes."""
    same = Window.partitionBy("one", "two")
    first = F.row_number().over(same.orderBy("block")) == 1
    counted = words.select("block", "number", F.sum("c").over(same).alias("total"), *(F.when(first, F.col(c)).alias(c) for c in ("one", "two")))
    return work.table(counted, "counts")


class Classes:
    """The class of a token by its hashes."""

    def __init__(self, one: np.ndarray, two: np.ndarray) -> None:
        order = np.argsort(one)
        self._one, self._two, self.n = one[order], two[order], OWN + HASHED

    def __call__(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = (OWN + one % np.uint64(HASHED)).astype(np.int64)
        if len(self._one):
            at = np.minimum(np.searchsorted(self._one, one), len(self._one) - 1)
            own = (self._one[at] == one) & (self._two[at] == two)
            out[own] = at[own]
        return out


def classes_of(counts: DataFrame) -> tuple[Classes, np.ndarray, np.ndarray]:
    """The classes, and training tokens and distinct tokens of each, from counts (one, two, c) of all tokens."""
    top = counts.filter("c > 0").orderBy(F.desc("c"), "one", "two").limit(OWN).collect()
    kind = Classes(np.array([r["one"] for r in top], np.int64).view(np.uint64), np.array([r["two"] for r in top], np.int32).view(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, v = np.zeros(kind.n, np.int64), np.zeros(kind.n, np.int64)
        for batch in batches:
            one, two, n = (batch.column(i).to_numpy() for i in range(3))
            k = kind(one.view(np.uint64), two.view(np.uint32))
            c += np.bincount(k, n, kind.n).astype(np.int64)
            v += np.bincount(k, n > 0, kind.n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(kind.n, dtype=np.int32)), pa.array(c), pa.array(v)], names=["class", "c", "v"])

    c, v = np.zeros(kind.n, np.int64), np.zeros(kind.n, np.int64)
    for r in counts.select("one", "two", "c").mapInArrow(run, "class int, c long, v long").groupBy("class").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():
        c[r["class"]], v[r["class"]] = r["c"], r["v"]
    return kind, c, v


class Model:
    """Start, transition and emission probabilities; ``emit`` is by class and state."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, c: np.ndarray, states: int = STATES) -> Model:
        """Class shares, tilted by fixed pseudo-random factors so that states differ; states tend to stay."""
        tilt = scan.mix(np.arange(len(c) * states, dtype=np.uint64) + np.uint64(77)).astype(np.float64) / 2.0**64
        emit = (c[:, None] + ADD) * np.exp(4 * tilt.reshape(len(c), states))
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(np.full(states, 1.0 / states), move, emit / emit.sum(0))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        start, move, emit = start + ADD, move + ADD, emit + ADD
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _lockstep(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences longest first, and how many are still running at each step."""
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes[order[0]]) if len(order) else 0
    return order, np.searchsorted(-sizes[order], -np.arange(longest), side="left")


class Pieces:
    """Sequences cut into segments: each piece's first token, size and sequence, and what it borders on."""

    def __init__(self, model: Model, classes: np.ndarray, first: np.ndarray, sizes: np.ndarray, segment: int, both: bool) -> None:
        count = np.maximum(-(-sizes // segment), 1)
        self.sequence = np.repeat(np.arange(len(sizes)), count)
        k = overlap.gather(np.zeros(len(sizes), np.int64), count)
        self.first = first[self.sequence] + k * segment
        self.sizes = np.minimum(sizes[self.sequence] - k * segment, segment)
        self.begins = k == 0
        n, states = len(k), len(model.start)
        #: Distribution before the first token, distribution after the last token of the piece before, and what follows the last token.
        self.start = np.tile(model.start, (n, 1))
        self.before = np.zeros((n, states))
        self.after = np.ones((n, states))
        long = np.flatnonzero(count > 1)
        if not len(long):
            return
        mine = np.flatnonzero(count[self.sequence] > 1)
        carry = np.empty((n, states, states))
        carry[mine] = _carry(model, classes, self.first[mine], self.sizes[mine])
        at, order = np.cumsum(count) - count, long[np.argsort(-count[long], kind="stable")]
        for j in range(1, int(count[order[0]])):
            now = at[order[: int(np.searchsorted(-count[order], -j, side="left"))]] + j
            a = np.einsum("ns,nst->nt", self.start[now - 1], carry[now - 1])
            self.before[now] = a / a.sum(1, keepdims=True)
            self.start[now] = self.before[now] @ model.move
        if both:
            for j in range(int(count[order[0]]) - 1, 0, -1):
                now = at[order[: int(np.searchsorted(-count[order], -j, side="left"))]] + j
                b = np.einsum("nst,nt->ns", carry[now], self.after[now]) @ model.move.T
                self.after[now - 1] = b / b.sum(1, keepdims=True)

    def batches(self, tokens_: int) -> Iterator[np.ndarray]:
        """The pieces in runs of about so many tokens."""
        ends = np.cumsum(self.sizes)
        for run in np.split(np.arange(len(ends)), np.flatnonzero(np.diff((ends - 1) // tokens_)) + 1):
            if len(run):
                yield run


def _carry(model: Model, classes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each piece the matrix that takes a distribution before its first token to one after its last, up to a factor."""
    order, running = _lockstep(sizes)
    at, states = first[order], len(model.start)
    out = np.eye(states)[None] * model.emit[classes[at]][:, None, :]
    ones = np.ones(states * states)
    for t, k in enumerate(running[1:], 1):
        m = (out[:k].reshape(-1, states) @ model.move).reshape(k, states, states)
        m *= model.emit[classes[at[:k] + t]][:, None, :]
        if t % SCALED == 0 or t == len(running) - 1:
            m /= (m.reshape(k, -1) @ ones)[:, None, None]
        out[:k] = m
    back = np.empty_like(out)
    back[order] = out
    return back


def forward(model: Model, classes: np.ndarray, first: np.ndarray, sizes: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """log10 likelihood of each class sequence, by the scaled forward recursion."""
    p, total = Pieces(model, classes, first, sizes, segment, False), np.zeros(len(sizes))
    order, running = _lockstep(p.sizes)
    at, out, a, ones = p.first[order], np.zeros(len(order)), p.start[order], np.ones(len(model.start))
    for t, k in enumerate(running):
        a = a[:k] * model.emit[classes[at[:k] + t]]
        scale = a @ ones
        out[:k] += np.log10(scale)
        a /= scale[:, None]
        a = a @ model.move
    np.add.at(total, p.sequence[order], out)
    return total


def expect(model: Model, classes: np.ndarray, first: np.ndarray, sizes: np.ndarray, segment: int = SEGMENT, tokens_: int = BLOCK_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions over the sequences, and their log10 likelihood."""
    states = len(model.start)
    start, move, emit, level = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit), 0.0
    if not len(sizes):
        return start, move, emit, level
    p, ones = Pieces(model, classes, first, sizes, segment, True), np.ones(states)
    for run in p.batches(tokens_):
        order, running = _lockstep(p.sizes[run])
        order = run[order]
        at, after = p.first[order], p.after[order]
        alphas, scales, emits = [], [], []
        a = p.start[order]
        for t, k in enumerate(running):
            e = model.emit[classes[at[:k] + t]]
            a = a[:k] * e
            scale = a @ ones
            a /= scale[:, None]
            alphas.append(a)
            scales.append(scale)
            e /= scale[:, None]
            emits.append(e)
            a = a @ model.move
        level += float(np.log10(np.concatenate(scales)).sum())
        gammas, seen, beta = [], [], np.ones((0, states))
        for t in range(len(running) - 1, -1, -1):
            k, nxt = int(running[t]), int(running[t + 1]) if t + 1 < len(running) else 0
            ended = after[nxt:k] / (alphas[t][nxt:k] * after[nxt:k]).sum(1, keepdims=True)
            if nxt:
                later = beta * emits[t + 1]
                move += alphas[t][:nxt].T @ later
                ended = np.concatenate([later @ model.move.T, ended])
            beta = ended
            gammas.append(alphas[t] * beta)
            seen.append(classes[at[:k] + t])
        # the move into a piece from the one before it
        inner = ~p.begins[order]
        if inner.any():
            move += p.before[order[inner]].T @ (beta[inner] * emits[0][inner])
        start += gammas[-1][~inner].sum(0)
        gamma, seen_ = np.concatenate(gammas), np.concatenate(seen)
        for s in range(states):
            emit[:, s] += np.bincount(seen_, gamma[:, s], len(emit))
    return start, move * model.move, emit, level


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _kinds(row: dict, kind: Classes) -> np.ndarray:
    """The class of each distinct token of a block."""
    return kind(np.frombuffer(row["one"], "<u8"), np.frombuffer(row["two"], "<u4")).astype("<u2")


def _block(row: dict, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, classes, first token and size of each text) of a block that ``encode`` has written."""
    number = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["numbers"]), "<u2" if len(kinds) <= 1 << 16 else "<u4")
    sizes = np.array(row["sizes"], np.int64)
    return number, kinds[number], np.cumsum(sizes) - sizes, sizes


def train(encoded: DataFrame, kind: Classes, c: np.ndarray, states: int = STATES, rounds: int = ROUNDS, tolerance: float = TOLERANCE, segment: int = SEGMENT) -> tuple[Model, list[float]]:
    """Baum-Welch over all training texts, and the log10 likelihood before each round."""
    spark, model, levels = encoded.sparkSession, Model.initial(c, states), []
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((model.start, model.move, model.emit, kind))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            *tables, kind = shared.value
            now, total = Model(*tables), None
            for row in _rows(batches):
                _, classes, first, sizes = _block(row, _kinds(row, kind))
                take = np.flatnonzero(~np.array(row["held"], bool))
                got = expect(now, classes, first[take], sizes[take], segment)
                total = got if total is None else tuple(x + y for x, y in zip(total, got, strict=True))
            if total is None:
                return
            start, move, emit, level = total
            # class -1 - i: row i of the moves; then the starts and the likelihood
            keys = np.concatenate([np.arange(len(emit)), -1 - np.arange(states + 2)]).astype(np.int32)
            table = np.concatenate([emit, move, start[None], np.full((1, states), level)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(table[:, i]) for i in range(states))], names=["class", *(f"s{i}" for i in range(states))])

        schema = "class int, " + ", ".join(f"s{i} double" for i in range(states))
        used = encoded.select("held", "sizes", "one", "two", "numbers")
        summed = used.mapInArrow(run, schema).groupBy("class").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(states))).collect()
        start, move, emit, level = np.zeros(states), np.zeros((states, states)), np.zeros((kind.n, states)), 0.0
        for r in summed:
            values = np.array(r[1:], float)
            if r[0] >= 0:
                emit[r[0]] = values
            elif r[0] >= -states:
                move[-1 - r[0]] = values
            elif r[0] == -1 - states:
                start = values
            else:
                level = float(values[0])
        shared.destroy()
        model = Model.from_counts(start, move, emit)
        levels.append(level)
        if len(levels) > 1 and level - levels[-2] < tolerance * abs(levels[-2]):
            break
    return model, levels


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Per text: counts, the base score and the model's log10 probability."""
    encoded = encode(docs, id_column, text_column)
    answers = totals(vocabulary(encoded))
    kind, c, v = classes_of(answers.filter("one IS NOT NULL").select("one", "two", F.col("total").alias("c")))
    model, _ = train(encoded, kind, c, states, rounds)
    total, distinct = int(c.sum()), int(v.sum())
    rest, within = float(np.log10(total + ADD * (distinct + 1))), np.log10(c + ADD * (v + 1))
    shared = docs.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit, kind, within))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # classes are all that scoring needs of the hashes
        for row in _rows(batches):
            made = ([row["block"]], [row["ids"]], [row["held"]], [row["sizes"]], [_kinds(row, shared.value[3]).tobytes()], [row["numbers"]])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()), strict=True)], names=["block", "ids", "held", "sizes", "kinds", "numbers"])

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        start, move, emit, _, within = shared.value
        row = next(_rows(block.to_batches()))
        kinds = np.frombuffer(row["kinds"], "<u2")
        number, classes, first, sizes = _block(row, kinds)
        seen = np.zeros(len(kinds), np.int64)
        seen[told.column("number").to_numpy()] = told.column("total").to_numpy()
        logs = np.add.reduceat(np.log10(seen + ADD)[number], first)
        share = logs - np.add.reduceat(within[classes], first)
        values = [pa.array(row["ids"], pa.int64()), pa.array(row["held"]), pa.array(sizes), pa.array(scan.sums((seen > 0)[number], np.append(first, len(number)))), pa.array(np.full(len(sizes), total)), pa.array(logs - sizes * rest), pa.array(forward(Model(start, move, emit), classes, first, sizes) + share)]
        return pa.table(values, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    blocks = encoded.drop("counts").mapInArrow(lean, "block long, ids array<long>, held array<boolean>, sizes array<int>, kinds binary, numbers binary")
    out = blocks.groupBy("block").cogroup(answers.select("block", "number", "total").groupBy("block")).applyInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_column)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return score(docs)
