"""MinHash near-dedup with fast similarity sketching.

A document's set holds its distinct shingles of a few consecutive words. A sketch has ``BINS`` coordinates.
In round r < BINS every shingle is thrown into a random bin with a value that starts with r; in round
BINS + b all shingles go to bin b, so every coordinate is filled; rounds stop once all are. A coordinate keeps
its smallest value: two sets agree there with a probability equal to their similarity, concentrated as for
independent samples, and a large set is done after one or two rounds. ``ROWS`` coordinates make a band;
documents that share a band are candidates and are confirmed on their full sets.

Equal sets collapse to one node before anything is paired. In each bucket of equal bands, every member is
first held against one of them only; after those links, members of one bucket that are still in different
components are compared in blocks, so no candidate is lost and a group of copies costs rows in proportion to
its size. Pairs of sizes that can't reach the threshold are left out beforehand. Buckets, pivots and sets with
many rows are joined by broadcast, so none lands in one task.

With 32 bands of 4 rows a pair at the threshold of 0.8 is missed with a probability of 5e-8.

Defined results: a row is known by its id and a hash of its text, so rows that share an id alone are documents of their
own, which may be in different groups. Texts without words have an empty set, link to nothing and are all kept by
``apply``. Of each group it keeps the row with the smallest id, of those with one id that with the smaller hash, and of
equal rows one; a null id counts as the largest, so in a group of null ids one row is kept. ``groups`` calls a group by
its smallest id, null if it has none. An empty table gives an empty result; further columns pass through ``apply``. A
text is held whole by the task that reads it, and so is its set; blocks of texts are bounded by bytes, not by rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import components as cc
from docloom.llm import scan, work

BINS, ROWS = 128, 4
#: A pivot's members that are compared in one run.
MEMBERS = 128
#: Documents and shingles of a bucket in a block at most on average, and shingles in a slice of the matrix of two blocks.
SIDE, SIDE_SHINGLES, COLUMNS = 1024, 1 << 20, 4096
#: Documents whose intersections are looked at together.
LOOK = 512
BLOCK = 3 << 19
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
SEEDS = scan.mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ordered by document and hash, and where each document's begin."""
    buf = scan.LOWER[buf]
    w = scan.words(buf, offsets, scan.WORD)
    hashes = scan.byte_prefix(buf).ranges(w.starts, w.ends)
    at, h = scan.windows(hashes, w.first, width)
    doc = w.doc()[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(few):
        whole = scan.Prefix(hashes, scan.POW_W).ranges(w.first[few], w.first[few + 1])
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, few])
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16) if len(offsets) < 65536 else doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(offsets)))


def sketch(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BINS values per document; documents without shingles keep the largest value everywhere."""
    n = len(first) - 1
    out = np.full(n * BINS, NONE)
    doc = np.repeat(np.arange(n), np.diff(first))
    for r in range(2 * BINS):
        if not len(h):
            break
        x = scan.mix(h ^ SEEDS[r])
        at = doc * BINS + ((x & np.uint64(BINS - 1)).astype(np.int64) if r < BINS else r - BINS)
        np.minimum.at(out, at, np.uint64(r << 55) | (x >> np.uint64(9)))
        live = np.unique(doc)
        full = (out.reshape(n, BINS)[live] != NONE).all(axis=1)
        if full.any():
            done = np.zeros(n, bool)
            done[live[full]] = True
            left = ~done[doc]
            h, doc = h[left], doc[left]
    return out.reshape(n, BINS)


FEATURES = T.StructType([*(T.StructField(c, T.LongType()) for c in ("id", "oid", "th", "n", "k1", "k2")), T.StructField("bands", T.ArrayType(T.LongType(), False))])


def features(docs: DataFrame, width: int) -> DataFrame:
    """Set size, a 128-bit key of the set and the band hashes, for (id, oid, th, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scan.blocks(batches, "text", BLOCK):
            h, first = shingles(b.buf, b.offsets, width)
            sizes = np.diff(first)
            keys = []
            for seed in (np.uint64(101), np.uint64(202)):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scan.mix(h ^ scan.mix(np.array([seed]))))])
                keys.append((total[first[1:]] - total[first[:-1]]).astype(np.int64))
            s = sketch(h, first).reshape(b.n, BINS // ROWS, ROWS)
            band = np.broadcast_to(np.arange(BINS // ROWS, dtype=np.uint64), s.shape[:2]).copy()
            for r in range(ROWS):
                band = scan.mix(band ^ s[:, :, r]) + np.uint64(r)
            band = band[sizes > 0].astype(np.int64)
            offs = np.concatenate([[0], np.cumsum((sizes > 0) * (BINS // ROWS))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.rows.column(i) for i in range(3)), pa.array(sizes, pa.int64()), *(pa.array(k) for k in keys), pa.ListArray.from_arrays(pa.array(offs), pa.array(band.ravel()))], schema=pa.schema([*((c, pa.int64()) for c in FEATURES.names[:6]), ("bands", pa.list_(pa.field("element", pa.int64(), nullable=False)))]))

    return docs.mapInArrow(run, FEATURES)


def _with_texts(wanted: DataFrame, texts: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Rows of ``wanted`` (want, ...) with the id and text of that node; ``texts`` are the nodes with their rows (node, oid, th) and the rows (oid, th, text)."""
    nodes, docs = texts
    named = wanted.join(nodes.select(F.col("node").alias("want"), F.col("oid").alias("want id"), F.col("th").alias("want text")), "want")
    need = named.select(F.col("want id").alias("oid"), F.col("want text").alias("th"))
    found = work.likely(docs, need, ["oid", "th"])
    return named.join(found, (F.col("want id") == F.col("oid")) & (F.col("want text") == F.col("th"))).drop("want id", "want text", "oid", "th")


def confirm(pairs: DataFrame, texts: tuple[DataFrame, DataFrame], width: int, share: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b) of nodes, those with at least share[0] of share[1] of the union in common.

    A pivot a meets its members b in runs of at most about MEMBERS; a run starts with the pivot's text, so a
    task holds one pivot's set and streams the members past it, however many there are.
    """
    runs = pairs.groupBy("a").agg(F.count("*").alias("m"))
    asked = work.joined(pairs, runs, ["a"], "m").select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / MEMBERS)).alias("run"), "b")
    pivots = asked.select("a", "run").distinct().select("a", "run", F.lit(0).alias("role"), F.col("a").alias("want"))
    wanted = work.table(asked.select("a", "run", F.lit(1).alias("role"), F.col("b").alias("want")).unionByName(pivots), "wanted")
    rows = _with_texts(wanted, texts).select("a", "run", "role", F.col("want").alias("id"), "text").repartition("a", "run").sortWithinPartitions("a", "run", "role", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, now = np.zeros(0, np.uint64), None
        for b in scan.blocks(batches, "text", BLOCK):
            h, first = shingles(b.buf, b.offsets, width)
            a, role, ids, part = b.column("a"), b.column("role"), b.column("id"), b.column("run")
            hits = []
            for i in range(b.n):
                mine = h[first[i] : first[i + 1]]
                if role[i] == 0:
                    pivot, now = mine, (a[i], part[i])
                    continue
                if now != (a[i], part[i]):
                    raise AssertionError("a member came before its pivot")
                if not len(mine) or not len(pivot):
                    continue
                small, large = (mine, pivot) if len(mine) < len(pivot) else (pivot, mine)
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                if share[1] * common >= share[0] * (len(mine) + len(pivot) - common):
                    hits.append(i)
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(a[hits]), pa.array(ids[hits])], names=["a", "b"])

    out = work.table(rows.mapInArrow(run, "a long, b long").distinct(), "links")
    work.drop(wanted)
    return out


def across(members: DataFrame, texts: tuple[DataFrame, DataFrame], width: int, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components.

    ``members`` has band, which names the bucket, node, component and the bucket's documents m and shingles total; where buckets of two kinds meet, whole tells them apart. A bucket is dealt into blocks of
    about SIDE documents or SIDE_SHINGLES shingles, whatever is less, and each pair of blocks is one group: sets meet as
    rows of a matrix of shingles, pairs are never made as rows, and of the links found only as many come out as join components.
    """
    members = members if "whole" in members.columns else members.withColumn("whole", F.lit(False))
    blocks = members.withColumn("k", F.greatest(F.ceil(F.col("m") / SIDE), F.ceil(F.col("total") / SIDE_SHINGLES), F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("node", F.lit(3)), F.col("k")))
    dealt = blocks.select("node", "component", "whole", "band", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other"))
    dealt = dealt.select(F.col("node").alias("want"), "component", "whole", "band", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), F.col("mine"))
    rows = _with_texts(dealt, texts).select("whole", "band", "x", "y", "mine", F.col("want").alias("id"), "component", "text")

    def run(group: pa.Table) -> pa.Table:
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        ids, comp, mine = (group.column(c).to_numpy() for c in ("id", "component", "mine"))
        sets: list[np.ndarray] = []
        for b in scan.blocks(iter(group.select(["text"]).combine_chunks().to_batches()), "text"):
            h, first = shingles(b.buf, b.offsets, width)
            sets += [h[first[i] : first[i + 1]] for i in range(b.n)]
        sizes = np.array([len(s) for s in sets])
        names, counts = np.unique(comp, return_counts=True)
        # pairs inside the largest component need no look
        left = np.flatnonzero(comp != names[np.argmax(counts)])
        every = _common(sets, left)
        root = {c: c for c in names.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for lo in range(0, len(left), LOOK):
            some, common = left[lo : lo + LOOK], every[lo : lo + LOOK].astype(np.int64)
            union = sizes[some][:, None] + sizes[None, :] - common
            hit = (share[1] * common >= share[0] * union) & (common > 0) & (comp[some][:, None] != comp[None, :])
            if x != y:
                hit &= mine[some][:, None] != mine[None, :]
            for i, j in np.argwhere(hit):
                a, b = find(int(comp[some[i]])), find(int(comp[j]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(ids[some[i]]), int(ids[j])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy("whole", "band", "x", "y").applyInArrow(run, "a long, b long").distinct()


def _common(sets: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered in ``left`` with all sets."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    h, doc = np.concatenate(sets)[order], doc[order]
    new = np.append(True, h[1:] != h[:-1])
    column, uses = np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(h)))
    # a shingle of one document alone is in no intersection but its own
    shared = uses > 1
    keep = shared[column]
    column = (np.cumsum(shared) - 1)[column[keep]]
    doc = doc[keep]
    out = np.zeros((len(left), len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        table = np.zeros((len(sets), COLUMNS), np.float32)
        table[doc[a:b], column[a:b] - lo] = 1
        for at in range(0, len(left), LOOK):
            out[at : at + LOOK] += table[left[at : at + LOOK]] @ table.T
    return out


def _met_once(rest: DataFrame) -> DataFrame:
    """Buckets (band, node, size, component) whose members are still apart, as ``across`` takes them.

    Members of a group of near copies meet in many buckets, nearly the same ones each time. Buckets with one largest component are met as
    one bucket (``whole``) with every member once, unless that would compare more pairs than they do by themselves; so rows follow the members.
    """
    per = rest.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    apart = per.groupBy("band").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("m"), F.sum("s").alias("total"), F.count("*").alias("parts")).filter("parts > 1")
    apart = work.table(apart.select("band", F.col("top.component").alias("chief"), "m", "total", (F.col("m") * (F.col("m") - F.col("top.n"))).alias("looks")), "apart")
    open_ = work.table(work.joined(rest, apart, ["band"], "m").select("band", "node", "size", "component", "chief", "m", "total"), "open-buckets")
    # a node has one size and one component, so that any of its rows says them
    members = work.table(open_.groupBy("chief", "node").agg(F.first("size").alias("size"), F.first("component").alias("component")), "members")
    sums = members.groupBy("chief").agg(F.count("*").alias("m"), F.sum("size").alias("total"), F.count_if(F.col("component") != F.col("chief")).alias("minor"))
    looks = apart.groupBy("chief").agg(F.sum("looks").alias("looks"))
    whole = work.table(sums.join(looks, "chief").filter(F.col("m") * F.col("minor") <= F.col("looks")).select("chief", "m", "total"), "whole")
    one = work.joined(members, whole, ["chief"], "m").select(F.lit(True).alias("whole"), F.col("chief").alias("band"), "node", "component", "m", "total")
    single = open_.join(whole.select("chief"), "chief", "left_anti").select(F.lit(False).alias("whole"), "band", "node", "component", "m", "total")
    out = work.table(one.unionByName(single), "open-members")
    work.drop(apart, open_, members, whole)
    return out


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """(id, oid, th, n_shingles, component_id, first) per row: oid and th know the row, ``first`` is true for the row of its group that stays."""
    oid, th = work.row_key(id_column, text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), oid.alias("oid"), th.alias("th"), F.col(text_column).alias("text"))
    feats = work.table(features(rows, width), "features")
    sets = feats.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min(F.struct("oid", "th")).alias("r"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    nodes = work.table(sets.select(F.monotonically_increasing_id().alias("node"), "n", "k1", "k2", "r.oid", "r.th", "copies", "bands"), "nodes")
    texts = nodes, rows.select("oid", "th", "text")
    bands = nodes.select("node", F.col("n").alias("size"), F.explode("bands").alias("band"))
    alike = lambda x, y: F.least(x, y) * share[1] >= F.greatest(x, y) * share[0]
    buckets = bands.groupBy("band").agg(F.min(F.struct("node", "size")).alias("p"), F.count("*").alias("m"), F.sum("size").alias("total")).filter("m > 1")
    buckets = work.table(buckets.select("band", F.col("p.node").alias("a"), F.col("p.size").alias("a_size"), "m", "total"), "buckets")
    starred = work.table(work.joined(work.likely(bands, buckets, ["band"]), buckets, ["band"], "m").filter(F.col("node") != F.col("a")).select("band", "node", "size", "a", "a_size", "m", "total"), "starred")
    first = work.table(starred.filter(alike(F.col("size"), F.col("a_size"))).select("a", F.col("node").alias("b")).distinct(), "pairs")
    links = confirm(first, texts, width, share)
    comp = cc.components(links)
    # buckets whose members are still apart
    rest = starred.filter("m > 2").select("band", "node", "size").unionByName(buckets.filter("m > 2").select("band", F.col("a").alias("node"), F.col("a_size").alias("size")))
    rest = _met_once(rest.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")))
    more = None
    if not rest.isEmpty():
        more = work.table(links.unionByName(across(rest, texts, width, share)), "links")
        work.drop(comp)
        comp = cc.components(more)
    work.drop(buckets, starred, first, links, rest, more)
    # the smallest row of each component; a node without a link is one of its own
    rooted = nodes.join(comp, "node", "left").select("n", "k1", "k2", "oid", "th", "copies", F.coalesce("component", "node").alias("root"))
    roots = rooted.groupBy("root").agg(F.min(F.struct("oid", "th")).alias("least"), F.count("*").alias("m"))
    owner = work.joined(rooted, roots, ["root"], "m").select("n", "k1", "k2", "copies", F.col("least.oid").alias("first_id"), F.col("least.th").alias("first_text"))
    owner = work.table(owner, "owners")
    work.drop(comp, nodes)
    own = work.joined(feats.filter("n > 0").drop("bands"), owner, ["n", "k1", "k2"], "copies")
    own = own.select("id", "oid", "th", "n", F.nullif("first_id", F.lit(work.NO_ID)).alias("component_id"), ((F.col("oid") == F.col("first_id")) & (F.col("th") == F.col("first_text"))).alias("first"))
    out = own.unionByName(feats.filter("n = 0").select("id", "oid", "th", "n", F.col("id").alias("component_id"), F.lit(True).alias("first")))
    return out.withColumnsRenamed({"id": id_column, "n": "n_shingles"})


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: shingles of four words, 80 of 100."""
    return groups(docs, width=4).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def apply(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """One document of each group: the one with the smallest id. Only texts of rows that may go are shuffled."""
    found = groups(docs, id_column, text_column, width, share)
    gone = found.filter("NOT first").select(F.col("oid").alias("gone id"), F.col("th").alias("gone text")).distinct()
    oid, th = work.row_key(id_column, text_column)
    # a document's own columns stand in one, so that none of them meets a name that is used here
    keyed = docs.select(F.struct(*map(work.named, docs.columns)).alias("document"), oid.alias("row id"), th.alias("row text"))

    def without(rows: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
        return rows.join(keys, (F.col("row id") == F.col("gone id")) & (F.col("row text") == F.col("gone text")), how)

    asked = work.marked(keyed, gone.select(F.col("gone id").alias("row id"), F.col("gone text").alias("row text")), ["row id", "row text"])
    kept = asked.filter(~F.col(work.MAYBE)).drop(work.MAYBE).unionByName(without(asked.filter(F.col(work.MAYBE)).drop(work.MAYBE), gone))
    # equal rows with one id: one of them
    again = found.filter("n_shingles > 0 AND first").groupBy("oid", "th").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("oid").alias("gone id"), F.col("th").alias("gone text"))
    if not again.isEmpty():
        kept = without(kept, again).unionByName(without(kept, again, "left_semi").dropDuplicates(["row id", "row text"]))
    return kept.select("document.*")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1) + 1))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, m.c AS component_id, m.c = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.d = w.doc_id
"""
