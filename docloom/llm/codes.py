"""Product codes of vectors by Lloyd rounds on cover trees.

Vectors of whole numbers are cut into equal parts. A task builds, for each block of vectors and each part position, a cover
tree over the distinct parts: a node's children lie within half its level's radius of its centre's points and further
than that from each other, down to single points. Points stand in the order of the tree, so every subtree is a range and
cumulative sums give its count and sum. A round takes a node's distances to the codebook: where the triangle inequality
leaves one entry that can be nearest to any of its points, the whole subtree goes to it; other nodes descend, and single
points are compared exactly. Trees are built once and written; the rounds read those.

Defined results: vectors are kept if they have ``width`` components, none null or non-finite; others have no row. Codebooks start
with the smallest ids (null is the largest, equal ones by the vector), fewer where there are fewer vectors. Repeated and null ids are vectors of their
own. Vectors with very large components are compared with all entries by Python's integers. An error beyond 64 bits is null, as
is the sum of a label that has one. Null labels count as one. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import vectors, work

SCALE, WIDTH, PARTS, ENTRIES, ROUNDS = 256, 64, 16, 64, 2
#: Vectors whose trees are built together, and nodes or points compared at a time.
BLOCK, AT_ONCE = 4096, 4096

_TREES = "points binary, weights binary, parts binary, nodes binary, radii binary, places binary, vec_id array<long>, label array<long>, wide_id array<long>, wide_label array<long>, wide array<array<string>>"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


@dataclass
class Forest:
    """Cover trees of all part positions of a block.

    A node is (position of its centre, first and last point + 1, first child, children, first of its points that are no child's). Points of a
    node's children come first, in the children's order, then those that stand alone.
    """

    points: np.ndarray
    weights: np.ndarray
    parts: np.ndarray
    nodes: np.ndarray
    radii: np.ndarray
    roots: int

    @classmethod
    def build(cls, q: np.ndarray, parts: int) -> tuple[Forest, np.ndarray]:
        """The trees of a matrix of whole numbers, and where the part of each vector stands among the points."""
        n, w = len(q), q.shape[1] // parts
        rows = np.empty((n * parts, w + 1), np.int64)
        rows[:, 0], rows[:, 1:] = np.tile(np.arange(parts), n), q.reshape(n * parts, w)
        found, inverse, weights = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        part, points, m = found[:, 0], found[:, 1:], len(found)
        order = np.arange(m)  # the point that stands at a place
        root_at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = np.r_[root_at[1:], m]
        owner = np.repeat(np.arange(len(root_at)), ends - root_at)  # the node of the point at a place; -1 once it stands alone
        apart = squared(points, points[root_at[owner]])
        centre, start, end = root_at.tolist(), root_at.tolist(), ends.tolist()
        radius = np.maximum.reduceat(apart, root_at).tolist()
        first, count, alone = [0] * len(centre), [0] * len(centre), list(start)
        open_ = ends - root_at > 1
        owner[~open_[owner]] = -1
        reach = 1
        while reach * reach < max(radius):
            reach *= 2
        while (owner >= 0).any():
            reach /= 2
            limit = reach * reach
            active = np.flatnonzero(owner >= 0)
            mine = owner[active]
            child, to, middle = np.zeros(len(active), np.int64), apart[active], np.zeros(len(active), np.int64)
            middle[:] = np.asarray(centre)[mine]
            left = np.flatnonzero(to > limit)
            k = 0
            while len(left):
                k += 1
                head = np.r_[True, mine[left[1:]] != mine[left[:-1]]]
                chosen = order[active[left[head]]][np.cumsum(head) - 1]
                far = squared(points[order[active[left]]], points[chosen])
                near = far <= limit
                child[left[near]], to[left[near]], middle[left[near]] = k, far[near], chosen[near]
                left = left[~near]
            # nodes with one child only stay as they are; the others get children for groups of two points or more
            split = np.zeros(len(centre), bool)
            split[mine[child > 0]] = True
            changes = split[mine]
            key = mine * (k + 1) + child
            _, group, size = np.unique(key, return_inverse=True, return_counts=True)
            single = size[group] == 1
            again = np.lexsort((child, single, np.asarray(start)[mine]))  # within an owner: children, then points alone
            # active places of an owner are contiguous up to its first point alone, so places are dealt again within the owner
            order[active], apart[active] = order[active[again]], to[again]
            mine, child, middle, single, changes = mine[again], child[again], middle[again], single[again], changes[again]
            fresh = changes & ~single
            heads = np.flatnonzero(fresh & np.r_[True, (mine[1:] != mine[:-1]) | (child[1:] != child[:-1]) | ~fresh[:-1]])
            tails = np.flatnonzero(fresh & np.r_[(mine[1:] != mine[:-1]) | (child[1:] != child[:-1]) | ~fresh[1:], True])
            base = len(centre)
            centre += middle[heads].tolist()
            start += active[heads].tolist()
            end += (active[tails] + 1).tolist()
            radius += [int(apart[active[h] : active[t] + 1].max()) for h, t in zip(heads, tails, strict=True)]
            first += [0] * len(heads)
            count += [0] * len(heads)
            alone += active[heads].tolist()
            for i, parent in enumerate(mine[heads].tolist()):
                if not count[parent]:
                    first[parent] = base + i
                count[parent] += 1
                alone[parent] = int(active[tails[i]] + 1)
            number = np.cumsum(np.isin(np.arange(len(mine)), heads)) - 1 + base
            owner[active] = np.where(changes, np.where(single, -1, number), mine)
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        nodes = np.stack([place[centre], start, end, first, count, alone], axis=1).astype(np.int32)
        return cls(points[order], weights[order], part[order], nodes, np.asarray(radius, np.int64), len(root_at)), place[inverse.ravel()].reshape(n, parts)

    def assigned(self, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first point, last point + 1, nearest entry) of ranges of points of one part position."""
        level = np.arange(self.roots)
        while len(level):
            below, lone = [], []
            for at in range(0, len(level), AT_ONCE):
                some = level[at : at + AT_ONCE]
                centre, start, end, first, count, alone = self.nodes[some].T.astype(np.int64)
                apart = squared(self.points[centre][:, None, :], books[self.parts[centre]])
                root = np.sqrt(apart.astype(np.float64))
                # a point of the subtree is at most the radius off, so an entry this much further can't be nearest to it
                bound = (root.min(axis=1) + 2 * np.sqrt(self.radii[some].astype(np.float64))) * (1 + 1e-9) + 1e-6
                sure = (root <= bound[:, None]).sum(axis=1) == 1
                yield start[sure], end[sure], np.argmin(apart[sure], axis=1)
                below.append(_ranges(first[~sure], count[~sure]))
                lone.append(_ranges(alone[~sure], end[~sure] - alone[~sure]))
            level = np.concatenate(below)
            for points in lone:
                for at in range(0, len(points), AT_ONCE):
                    p = points[at : at + AT_ONCE]
                    yield p, p + 1, np.argmin(squared(self.points[p][:, None, :], books[self.parts[p]]), axis=1)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of several ranges."""
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(start) else np.zeros(0, np.int64)


def _grown(width: int, parts: int):
    """Rows of _TREES of the vectors of each batch."""
    narrow = lambda a: a.astype(np.min_scalar_type(int(a.max(initial=0))) if a.min(initial=0) >= 0 else np.int32)

    def packed(a: np.ndarray) -> bytes:
        return a.dtype.char.encode() + a.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for whole in batches:
            for at in range(0, len(whole), BLOCK):
                batch = whole.slice(at, BLOCK)
                near, q, far, wide = vectors.matrices(batch, width)
                ids, labels = batch.column("vec_id"), batch.column("label")
                row: dict = {c: b"" for c in ("points", "weights", "parts", "nodes", "radii", "places")}
                if len(near):
                    forest, places = Forest.build(q, parts)
                    low = forest.points.astype(np.int16) if np.abs(forest.points).max() < 1 << 15 else forest.points.astype(np.int32)
                    row = {"points": low, "weights": narrow(forest.weights), "parts": forest.parts.astype(np.uint8), "nodes": forest.nodes, "radii": narrow(forest.radii), "places": narrow(places)}
                    row = {c: packed(a) for c, a in row.items()}
                take = lambda c, rows: c.take(pa.array(rows)).to_pylist()
                row |= {"vec_id": take(ids, near), "label": take(labels, near), "wide_id": take(ids, far), "wide_label": take(labels, far), "wide": [[str(v) for v in r] for r in wide]}
                schema = schema or pa.schema([(c, pa.binary()) for c in ("points", "weights", "parts", "nodes", "radii", "places")] + [(c, pa.list_(pa.int64())) for c in ("vec_id", "label", "wide_id", "wide_label")] + [("wide", pa.list_(pa.list_(pa.string())))])
                yield pa.RecordBatch.from_pylist([row], schema)

    return run


def _read(row: dict, parts: int, width: int) -> tuple[Forest | None, np.ndarray, np.ndarray]:
    """(trees, places, wide vectors) of a row of _TREES."""
    unpacked = lambda c: np.frombuffer(row[c], np.dtype(chr(row[c][0])), offset=1)
    wide = np.empty((len(row["wide"]), width), object)
    for k, r in enumerate(row["wide"]):
        wide[k] = [int(v) for v in r]
    if not row["points"]:
        return None, np.zeros((0, parts), np.int64), wide
    part = unpacked("parts").astype(np.int64)
    forest = Forest(unpacked("points").astype(np.int64).reshape(len(part), -1), unpacked("weights").astype(np.int64), part, unpacked("nodes").reshape(-1, 6), unpacked("radii"), len(np.unique(part)))
    return forest, unpacked("places").astype(np.int64).reshape(-1, parts), wide


def _nearest(wide: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) by vector and part, compared one by one."""
    cut = wide.reshape(len(wide), len(books), books.shape[2])
    entry, apart = np.zeros(cut.shape[:2], np.int64), np.zeros(cut.shape[:2], object)
    for i, vector in enumerate(cut):
        d = squared(vector[:, None, :], books.astype(object))
        entry[i] = np.argmin(d, axis=1)
        apart[i] = d[np.arange(len(books)), entry[i]]
    return entry, apart


def _sums(books: np.ndarray, width: int):
    """Counts and sums by part position and entry, each a place."""
    parts, entries, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}

        def add(slot: int, values: list[int]) -> None:
            for k, v in enumerate(values):
                held[slot * (w + 1) + k] = held.get(slot * (w + 1) + k, 0) + v

        for batch in batches:
            for row in batch.to_pylist():
                forest, _, wide = _read(row, parts, width)
                if forest:
                    # cumulative sums of counts and weighted points: a subtree is the difference of two of them
                    upto = np.zeros((len(forest.points) + 1, w + 1), np.int64)
                    np.cumsum(np.column_stack([forest.points * forest.weights[:, None], forest.weights]), axis=0, out=upto[1:])
                    total = np.zeros((parts * entries, w + 1), np.int64)
                    for start, end, entry in forest.assigned(books):
                        np.add.at(total, forest.parts[start] * entries + entry, upto[end] - upto[start])
                    for slot in np.flatnonzero(total[:, w]).tolist():
                        add(slot, total[slot].tolist())
                for vector, entry in zip(wide.reshape(len(wide), parts, w), _nearest(wide, books)[0].tolist(), strict=True):
                    for p, e in enumerate(entry):
                        add(p * entries + e, [*vector[p].tolist(), 1])
        yield vectors.sum_rows(held)

    return run


def _coded(books: np.ndarray, width: int):
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                forest, places, wide = _read(row, parts, width)
                ids, labels = row["vec_id"] + row["wide_id"], row["label"] + row["wide_label"]
                entries, errors = [], []
                if forest:
                    entry = np.zeros(len(forest.points), np.int64)
                    for start, end, e in forest.assigned(books):
                        entry[_ranges(start, end - start)] = np.repeat(e, end - start)
                    off = squared(forest.points, books[forest.parts, entry])
                    entries.append(entry[places])
                    errors += off[places].sum(axis=1).tolist()
                near, apart = _nearest(wide, books)
                entries.append(near)
                errors += apart.sum(axis=1).tolist()
                text = np.concatenate(entries).astype(np.uint8).tobytes().hex()
                codes = [text[i * 2 * parts : (i + 1) * 2 * parts] for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(codes, pa.string()), pa.array([vectors.as_long(int(e)) for e in errors], pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def coded(embeddings: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that is kept; at most 256 entries a codebook."""
    w = width // parts
    kept = vectors.prepared(embeddings, scale, width)
    trees = work.table(kept.mapInArrow(_grown(width, parts), _TREES), "trees")
    begins = [vectors.plain(r) for r in kept.select("vec_id", "q", "wide").orderBy(F.asc_nulls_last("vec_id"), "wide", "q").limit(entries).collect()]
    books = [[r[p * w : (p + 1) * w] for r in begins] for p in range(parts)]
    arrays = lambda: vectors.integers([e for b in books for e in b]).reshape(parts, len(begins), w)
    for _ in range(rounds if begins else 0):
        total = vectors.totals(trees.mapInArrow(_sums(arrays(), width), vectors.SUMS))
        at = lambda p, e, k: total.get((p * len(begins) + e) * (w + 1) + k, 0)
        books = [[[at(p, e, k) // n for k in range(w)] if (n := at(p, e, w)) else old for e, old in enumerate(book)] for p, book in enumerate(books)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    if not begins:
        rows = trees.select(F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("long").alias("label"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    else:
        rows = work.table(trees.mapInArrow(_coded(arrays(), width), "vec_id long, label long, code string, error long"), "codes")
    rows = rows.withColumn("labelled", F.col("label").isNotNull()).withColumn("name", F.coalesce("label", F.lit(0)))
    by_label = rows.groupBy("labelled", "name").agg(F.expr("try_cast(CASE WHEN count(error) = count(*) THEN sum(CAST(error AS DECIMAL(38, 0))) END AS BIGINT)").alias("label_error"), F.count("*").alias("weight"))
    return work.joined(rows, by_label, ["labelled", "name"], "weight").select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def oracle() -> str:
    """Both rounds and the last assignment as one query."""
    w = WIDTH // PARTS
    floor = lambda s, n: f"({s} - (({s} % {n}) + {n}) % {n}) // {n}"
    steps = [
        f"v AS (SELECT vec_id, label, embedding FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH})",
        f"q AS MATERIALIZED (SELECT vec_id, p, list_transform(range(1, {w + 1}), lambda j: CAST(floor({SCALE} * CAST(embedding[p * {w} + j] AS DOUBLE)) AS BIGINT)) AS x FROM v, range({PARTS}) AS r(p))",
        f"s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < {ENTRIES})",
        "c0 AS MATERIALIZED (SELECT p, e, x FROM s JOIN q USING (vec_id))",
    ]
    square = " + ".join(f"(q.x[{j}] - m.x[{j}]) * (q.x[{j}] - m.x[{j}])" for j in range(1, w + 1))
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, min(({square}, e)) AS best FROM q JOIN c{k} AS m USING (p) GROUP BY ALL)")
        if k < ROUNDS:
            sums = ", ".join(f"CAST(sum(x[{j}]) AS BIGINT) AS s{j}" for j in range(1, w + 1))
            steps.append(f"m{k} AS (SELECT p, best[2] AS e, {sums}, count(*) AS n FROM a{k} JOIN q USING (vec_id, p) GROUP BY ALL)")
            means = ", ".join(floor(f"m.s{j}", "m.n") for j in range(1, w + 1))
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT o.p, o.e, CASE WHEN m.n IS NULL THEN o.x ELSE [{means}] END AS x FROM c{k} AS o LEFT JOIN m{k} AS m USING (p, e))")
    return "WITH " + ",\n".join(steps) + f""",
z AS (SELECT vec_id, string_agg(printf('%02x', CAST(best[2] AS INT)), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM z JOIN v USING (vec_id), h"""
