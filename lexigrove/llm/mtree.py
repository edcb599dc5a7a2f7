"""Exact top-k inner products by best-first search of M-trees.

Vectors are quantised to integers; the metric is Euclidean.  Vectors go to the nearest of some pivots; a
pivot's vectors, in parts of about PART_BYTES, each become an M-tree, written to a file of its own: pages
of entries with a routing vector, the radius that covers its subtree and its distance to the page's own
routing vector.  As a product differs from that with another vector by at most |q| times their distance,
these bound the products below an entry, by its stored distance alone or by its own product.

A search takes pages from a queue by the greatest product that they may hold, for a block of queries at
once: a page is read for those queries whose k-th product it may beat.  A query first searches the part
that it is in; its k-th product there then tells which pivots, by their covering radii, can't hold a
better one, and only the others' parts are searched.  Queries go to the trees, which are read from the
shared folder, so trees are not copied to blocks of queries.  Bounds only skip what can't be among the k
best, ties included, so the result is exact.  Where distances are all alike, as with random vectors of
many dimensions, bounds skip nothing, and each block of queries is multiplied with each page.

Vectors that are null, or hold a null or a component that isn't finite, take no part, nor do rows
without id.  Rows that repeat an id are queries and candidates of their own.  Shorter vectors count as
filled up with zeros.  Scores are exact; the longest vectors (from WILD on) are kept apart, so that only they
pay for integers of any size.  A score beyond a long counts as the nearest long.
"""

import heapq
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import stage, table, work_path

PART_BYTES, QUERY_ROWS = 32 << 20, 4096  #: bytes of the vectors of a part; queries of a block
PIVOTS = 256  #: pivots at most; their vectors are sent to every executor
LEAF, FAN = 256, 16  #: entries of a leaf page, and of an inner one
TAME, WILD = 2.0**26, 2.0**31  #: lengths below which products of two vectors fit a double, and a long
SCALE = 256.0


def quantise(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, x: array of double, not yet quantised, norm: length after it) of the vectors that take part."""
    x = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("x"))
    x = x.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return x.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + F.pow(F.abs(c) * SCALE + 1, 2))))


def numbers(x) -> list:
    """Components as exact integers of any size."""
    return [int(c) * int(SCALE) if abs(c) > 2.0**53 else math.floor(c * SCALE) for c in x]


class Tree:
    """An M-tree over rows of x, bulk-loaded; ``pages`` in order, the first is the root.

    A page: routing vector's row or -1, leaf?, entries' rows, distances to the routing vector, radii, child pages.
    """

    def __init__(self, x, leaf: int = LEAF, fan: int = FAN, seed: int = 0):
        self.x, self.pages, self.leaf, self.fan, self.rng = x, [], leaf, fan, np.random.default_rng(seed)
        self._build(np.arange(len(x)), -1)

    def _distance(self, rows, to: int):
        return np.linalg.norm(self.x[rows] - self.x[to], axis=1) if to >= 0 else np.zeros(len(rows))

    def _build(self, rows, parent: int) -> int:
        at = len(self.pages)
        self.pages.append(None)
        own = self._distance(rows, parent)
        if len(rows) <= self.leaf:
            self.pages[at] = (parent, True, rows, own, np.zeros(len(rows)), np.full(len(rows), -1))
            return at
        fan = min(self.fan, -(-len(rows) // max(1, self.leaf // 2)))
        seeds = self.rng.choice(rows, max(2, fan), replace=False)
        far = np.stack([self._distance(rows, s) for s in seeds])
        near = np.argmin(far, axis=0)
        if np.bincount(near, minlength=len(seeds)).max() == len(rows):  # all alike: cut evenly
            near = np.arange(len(rows)) % len(seeds)
        used = np.unique(near)
        kids = [self._build(rows[near == s], int(seeds[s])) for s in used]
        self.pages[at] = (parent, False, seeds[used], self._distance(seeds[used], parent), np.array([far[s][near == s].max() for s in used]), np.array(kids))
        return at


class Best:
    """The k best (score, id, row) of each of n queries, ties to smaller ids."""

    def __init__(self, n: int, k: int, floor):
        self.k = k
        self.score, self.id, self.row = (np.full((n, k), v, dtype=np.int64) for v in (-(1 << 63), (1 << 63) - 1, -1))
        self.limit = floor.copy()  # what a score must reach

    def offer(self, at, score, ids, rows) -> None:
        """Scores (of queries ``at`` by vectors) that may be among the best; equal pairs aren't offered twice."""
        if not len(at):
            return
        some, at = np.unique(at, return_inverse=True)
        q = np.concatenate([at, np.repeat(np.arange(len(some)), self.k)])
        s, i, r = np.concatenate([score, self.score[some].ravel()]), np.concatenate([ids, self.id[some].ravel()]), np.concatenate([rows, self.row[some].ravel()])
        order = np.lexsort((r, i, ~s, q))
        first = np.searchsorted(q[order], np.arange(len(some)))
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[some], self.id[some], self.row[some] = (v[take].reshape(-1, self.k) for v in (s, i, r))
        self.limit[some] = np.maximum(self.limit[some], np.where(self.row[some, -1] >= 0, self.score[some, -1], -(1 << 63)))

    def found(self):
        """(query, score, id) of all that are there."""
        at = np.nonzero(self.row >= 0)
        return at[0], self.score[at], self.id[at]


def _slack(bound):
    """Bounds with room for rounding."""
    return bound + 1 + np.abs(bound) * 1e-9


def search(pages, x, ids, rids, q, own, floor, k: int, wide: bool = False):
    """(query, score, id) of the k best vectors of a tree for each query of a block, and the number of products computed.

    pages as in Tree; x, q: quantised vectors; own: the queries' own rows (of rids); floor: scores that k
    vectors elsewhere reach already; wide: products may not fit a double, but a long.
    """
    best, computed = Best(len(q), k, floor), 0
    norm = np.linalg.norm(q, axis=1)
    xs, qs = (x.astype(np.int64), q.astype(np.int64)) if wide else (x, q)

    def products(rows, at):
        return (qs[at] @ xs[rows].T).astype(np.int64)

    everyone = np.arange(len(q))
    queue = [(-np.inf, 0, everyone, np.full(len(q), np.inf), None)]
    while queue:
        _, page, at, bound, to_parent = heapq.heappop(queue)
        keep = bound >= best.limit[at]
        at = at[keep]
        if not len(at):
            continue
        parent, leaf, rows, dist, radius, kids = pages[page]
        if parent >= 0:  # |q.e - q.p| <= |q| d(e, p), so what can't reach any query's limit isn't multiplied
            open_ = (_slack(to_parent[keep][:, None] + norm[at][:, None] * (dist + radius)) >= best.limit[at][:, None]).any(axis=0)
            rows, radius, kids = rows[open_], radius[open_], kids[open_]
        if not len(rows):
            continue
        score = products(rows, at)
        computed += score.size
        if leaf:
            least = best.limit[at]
            if score.shape[1] > k + 1:  # one of them may be the query's own
                least = np.maximum(least, np.partition(score, -k - 1, axis=1)[:, -k - 1])
            i, j = np.nonzero(score >= least[:, None])
            other = rids[rows[j]] != own[at[i]]
            i, j = i[other], j[other]
            best.offer(at[i], score[i, j], ids[rows[j]], rids[rows[j]])
        else:
            reach = _slack(score + norm[at][:, None] * radius)
            for e, kid in enumerate(kids.tolist()):
                some = reach[:, e] >= best.limit[at]
                if some.any():
                    heapq.heappush(queue, (-float(reach[some, e].max()), kid, at[some], reach[some, e], score[some, e].astype(float)))
    return *best.found(), computed


def scan(x, ids, rids, q, own, floor, k: int):
    """The same for vectors of any size (x, q: not quantised), by integers without bounds."""
    best = Best(len(q), k, floor)
    rows = [numbers(v) for v in x]
    for i, v in enumerate(q):
        v = numbers(v)
        score = np.array([max(-(1 << 63), min((1 << 63) - 1, sum(map(int.__mul__, v, r)))) for r in rows], dtype=np.int64)
        j = np.flatnonzero((score >= floor[i]) & (rids != own[i]))
        best.offer(np.full(len(j), i), score[j], ids[j], rids[j])
    return best.found()


def _matrix(column, dim: int):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), dim))
    many = np.diff(column.offsets.to_numpy())
    out[np.repeat(np.arange(len(column)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _save(path: str, t, dim: int) -> None:
    """Grows the tree of a part (Arrow table of rid, id, x) and writes it to a file."""
    from pyarrow import fs, ipc

    x, ids, rids = _matrix(t.column("x"), dim), t.column("id").to_numpy(), t.column("rid").to_numpy()
    wild = bool(t.column("norm").to_numpy().max() >= WILD)
    pages = [] if wild else Tree(np.floor(SCALE * x), LEAF, FAN).pages
    kinds = (pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()))
    out = pa.table([pa.array([p[i] for p in pages], kind) for i, kind in enumerate(kinds)], names=["parent", "leaf", "rows", "distances", "radii", "children"])
    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at) as f:
        for part in (pa.table([pa.array(rids), pa.array(ids), pa.array([r.tobytes() for r in x], pa.binary())], names=["rid", "id", "x"]), out):
            with ipc.new_stream(f, part.schema) as w:
                w.write_table(part)


def _load(path: str, dim: int):
    """(pages, x, ids, rids) of a part."""
    from pyarrow import fs, ipc

    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as f:
        own, pages = (ipc.open_stream(f).read_all() for _ in range(2))
    x = np.frombuffer(b"".join(own.column("x").to_pylist()), dtype=float).reshape(-1, dim)
    lists = [[np.asarray(v.values) for v in pages.column(c)] for c in ("rows", "distances", "radii", "children")]
    return list(zip(pages.column("parent").to_pylist(), pages.column("leaf").to_pylist(), *lists)), x, own.column("id").to_numpy(), own.column("rid").to_numpy()


def top_k(vectors: DataFrame, queries, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id meets ``queries`` (a condition on id), the k others of greatest score."""
    spark = vectors.sparkSession
    base = stage(quantise(vectors, vec_id, embedding).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    n, dim = base.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, query_rows = max(1, dim), QUERY_ROWS
    part_rows = max(1, PART_BYTES // (8 * dim))

    # pivots: a bounded sample by hash; those of long vectors are kept apart as number -1
    count = min(PIVOTS, max(1, -(-n // part_rows)))
    some = base.where(F.col("norm") < WILD).orderBy(F.xxhash64("id"), "id", "rid").limit(count).select("x").toArrow()
    pivots = spark.sparkContext.broadcast(np.floor(SCALE * _matrix(some.column("x"), dim)))

    def assign(batches):
        p = pivots.value
        for b in batches:
            x, wild = np.floor(SCALE * _matrix(b.column(1), dim)), b.column(2).to_numpy() >= WILD
            x[wild] = 0
            near, away = np.zeros(len(x), dtype=np.int32), np.full(len(x), np.inf)
            for j in range(len(p)):
                d = np.linalg.norm(x - p[j], axis=1)
                near, away = np.where(d < away, j, near), np.minimum(d, away)
            near[wild] = -1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(np.where(wild, np.inf, away))], ["id", "x", "norm", "rid", "pivot", "away"])

    placed = base.select("id", "x", "norm", "rid").mapInArrow(K.tidy(assign), "id long, x array<double>, norm double, rid long, pivot int, away double")
    placed = stage(placed, "placed")
    sizes = {r["pivot"]: (r["n"], r["radius"]) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}  # at most PIVOTS + 1 rows
    parts = {p: -(-m // part_rows) for p, (m, _) in sizes.items()}
    salts = F.create_map(*[F.lit(v) for kv in parts.items() for v in kv])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("rid"), salts[F.col("pivot")]).cast("int"))
    base_path = work_path(spark, "trees")

    def grow(t):
        path = f"{base_path}/{uuid.uuid4().hex}.arrow"  # a lost task writes another; only files named here are read
        _save(path, t, dim)
        return pa.table([t.column("pivot").slice(0, 1), t.column("part").slice(0, 1), pa.array([path])], names=["pivot", "part", "path"])

    trees = stage(placed.select("rid", "id", "x", "norm", "pivot", "part").groupBy("pivot", "part").applyInArrow(grow, "pivot int, part int, path string"), "trees")

    def look(batches):
        """Rows (path, kind, id, x, norm, rid, floor) come sorted by path and kind: a tree is read once for each block of queries."""
        opened = None

        def block(t):
            nonlocal opened
            if opened is None or opened[0] != t.column("path")[0].as_py():
                opened = t.column("path")[0].as_py(), _load(t.column("path")[0].as_py(), dim)
            pages, x, ids, rids = opened[1]
            q, own, asked = _matrix(t.column("x"), dim), t.column("rid").to_numpy(), t.column("id").to_numpy()
            floor = t.column("floor").fill_null(-(1 << 63)).to_numpy()
            if pages and t.column("norm").to_numpy().max() < WILD:
                x, q = np.floor(SCALE * x), np.floor(SCALE * q)
                wide = max(np.linalg.norm(x, axis=1).max(), np.linalg.norm(q, axis=1).max()) >= TAME
                at, score, found, _ = search(pages, x, ids, rids, q, own, floor, k, wide)
            else:
                at, score, found = scan(x, ids, rids, q, own, floor, k)
            return pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(asked[at]), pa.array(found), pa.array(score)], ["rid", "query_id", "vec_id", "score"])

        rest = None
        for b in batches:
            t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b]).combine_chunks()
            while len(t):
                key = np.array(t.column("path").to_pylist()), t.column("kind").to_numpy()
                other = np.flatnonzero((key[0] != key[0][0]) | (key[1] != key[1][0]))
                end = min(int(other[0]) if len(other) else len(t), query_rows)
                if end == len(t) and end < query_rows:
                    break
                yield block(t.slice(0, end).combine_chunks())
                t = t.slice(end)
            rest = t
        if rest is not None and len(rest):
            yield block(rest.combine_chunks())

    def searched(rows: DataFrame) -> DataFrame:
        """rows: (pivot, part, id, x, norm, rid, floor), a query for each tree that it is looked up in."""
        rows = rows.join(F.broadcast(trees) if len(parts) and sum(parts.values()) <= 100_000 else trees, ["pivot", "part"])
        rows = rows.select("path", ((F.col("norm") >= TAME).cast("int") + (F.col("norm") >= WILD).cast("int")).alias("kind"), "id", "x", "norm", "rid", "floor").withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(blocks)))
        rows = rows.repartition("path", "salt").drop("salt").sortWithinPartitions("path", "kind", "rid")
        return stage(rows.mapInArrow(K.tidy(look), "rid long, query_id long, vec_id long, score long"), "found")

    asked = placed.where(queries(F.col("id"))).select("id", "x", "norm", "rid", "pivot", "part")
    blocks = max(1, -(-asked.count() // query_rows))  # a tree that all queries visit is read by several tasks
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    home = searched(asked.withColumn("floor", F.lit(None).cast("long")))
    floors = best(home).where(F.col("rank") == k).select("rid", F.col("score").alias("floor"))
    radii = [(p, r, parts[p]) for p, (_, r) in sorted(sizes.items())]

    def route(batches):
        p = pivots.value
        names = ["id", "x", "norm", "rid", "floor", "pivot", "part"]
        for b in batches:
            q, norm = np.floor(SCALE * _matrix(b.column(1), dim)), b.column(2).to_numpy()
            wild = norm >= WILD
            q[wild] = 0
            floor = b.column(6).fill_null(-(1 << 63)).to_numpy()
            home, part = b.column(4).to_numpy(), b.column(5).to_numpy()
            for j, r, many in radii:
                may = np.full(len(q), True) if j < 0 else wild | (_slack(q @ p[j] + norm * r) >= floor)
                for s in range(many):
                    at = pa.array(np.flatnonzero(may & ((home != j) | (part != s))))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in (0, 1, 2, 3, 6)), pa.array(np.full(len(at), j, dtype=np.int32)), pa.array(np.full(len(at), s, dtype=np.int32))], names)

    routed = asked.join(floors, "rid", "left").select("id", "x", "norm", "rid", "pivot", "part", "floor").mapInArrow(K.tidy(route), "id long, x array<double>, norm double, rid long, floor long, pivot int, part int")
    out = best(home.union(searched(routed)))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_mtree_top_k(spark, sf_dir):
    """The 5 vectors of greatest product for each whose id is divisible by 50, over the whole table."""
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.rid <> b.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
