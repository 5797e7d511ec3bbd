"""Nearest neighbours by largest inner product, with a vantage-point tree for each shard.

Shards hold vectors whose norms have one binary exponent, rounded, as many shards for each exponent as its rows need; a shard's
vectors are scaled by a power of two to norms of at most 1, a query likewise, so that neither very small nor very large
norms lose anything. Inner products become distances by one more dimension: with R the largest norm of a shard,
x -> (x, sqrt(R^2 - |x|^2)) and q -> (q R / |q|, 0) give |x' - q'|^2 = 2 R^2 - 2 <x, q> R / |q|, so the nearest in that metric
space is the largest product.

A shard's tree splits its points at the median distance from a vantage point (the point farthest from one drawn), down to
leaves. For a query, every vantage distance on the way bounds the distance to all points of a leaf from below (the triangle
inequality). First the leaves with the least bounds are searched; then every other leaf, unless its bound is larger than the
k-th distance found so far divided by `relax`: relax 1 prunes what cannot matter and is exact, larger factors prune more.
Distances only prune; candidates are ranked by sums of double products over the original vectors in one fixed order.

Without a given factor it is set so that on a sample (SAMPLE_POINTS vectors, SAMPLE_QUERIES queries, both at most) the share
TARGET of all true neighbours lies in leaves that are not pruned. Every vector is indexed and every query searched, whatever
the sample.

Each shard's tree is built once and stored in the shared folder. Trees and query blocks make a grid whose cells are tasks; a
cell holds one tree and one block, both of bounded expected size, and gives k rows for each query. Rows of one id and one vector
are counted before anything else, so copies of any number are one row.

Defined cases: vectors that are null, zero, empty, or hold a null or a non-finite component take no part, nor do those of
a dimension other than the most frequent one; rows with a null id take no part; equal vectors are searched once and all
their ids considered, the smaller first; repeated ids are separate candidates, but never for a query of their own id; queries of one id and different vectors are ranked
each by itself, those that repeat both are one; a product
beyond the range of doubles is infinite, one below it zero, and ranked as such; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, table

K, LEAF, SHARD, QUERY_BLOCK = 20, 64, 32_768, 8192
#: Leaves that a query searches before any is pruned.
FIRST_LEAVES = 4
#: Of the fit of the factor: the most vectors and queries, and the share of true neighbours in leaves that stay.
SAMPLE_POINTS, SAMPLE_QUERIES, TARGET, MOST_RELAX = 16_384, 256, 0.98, 64.0
#: What rounding may do to distances and products of vectors of norm 1, generously.
DISTANCE_SLACK, PRODUCT_SLACK = 1e-6, 1e-12


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two to norms from 1/4 to 1, and their exponents."""
    first = np.frexp(np.abs(x).max(axis=1, initial=0.0))[1]
    x = np.ldexp(x, -first[:, None])
    more = np.frexp(np.linalg.norm(x, axis=1))[1]
    return np.ldexp(x, -more[:, None]), first + more


def lifted(x: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)
    return np.hstack([x, np.sqrt(square.max(initial=0.0) - square)[:, None]])


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in one fixed order, so that equal vectors have equal products."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


class VPTree:
    """points: float64 rows. Leaves are ranges of `order`; `path` has (leaf, vantage point) with the leaf's shell around it."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points = points
        vantage, order, edges, path = [], [], [0], []
        todo = [(np.arange(len(points)), [])] if len(points) else []
        while todo:
            ids, above = todo.pop()
            if len(ids) <= leaf:
                path += [(len(edges) - 1, *shell) for shell in above]
                order.append(ids)
                edges.append(edges[-1] + len(ids))
                continue
            far = np.linalg.norm(points[ids] - points[ids[len(above) % len(ids)]], axis=1)
            v = ids[int(far.argmax())]
            d = np.linalg.norm(points[ids] - points[v], axis=1)
            half, n = np.argpartition(d, len(ids) // 2), len(vantage)
            vantage.append(v)
            for part in (half[: len(ids) // 2], half[len(ids) // 2 :]):
                todo.append((ids[part], [*above, (n, float(d[part].min()), float(d[part].max()))]))
        self.vantage, self.order = np.array(vantage, np.int64), np.concatenate([*order, np.zeros(0, np.int64)])
        self.edges, self.path = np.array(edges, np.int64), np.array(path, np.float64).reshape(-1, 4)

    PARTS = (("points", np.float64), ("vantage", np.int64), ("order", np.int64), ("edges", np.int64), ("path", np.float64))

    def stored(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, name)).tobytes() for name, _ in self.PARTS]

    @classmethod
    def restored(cls, parts: list[bytes], dim: int) -> VPTree:
        tree = cls.__new__(cls)
        for (name, kind), raw in zip(cls.PARTS, parts):
            setattr(tree, name, np.frombuffer(raw, kind))
        tree.points, tree.path = tree.points.reshape(-1, dim), tree.path.reshape(-1, 4)
        return tree

    @property
    def leaves(self) -> int:
        return len(self.edges) - 1

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """[query, leaf]: no point of the leaf is nearer."""
        v = self.points[self.vantage]
        d = np.sqrt(np.maximum((v**2).sum(axis=1)[:, None] + (queries**2).sum(axis=1) - 2 * v @ queries.T, 0))
        low = np.zeros((self.leaves, len(queries)))
        for leaf, n, inner, outer in self.path.tolist():
            own, at = low[int(leaf)], d[int(n)]
            np.maximum(own, inner - at, out=own)
            np.maximum(own, at - outer, out=own)
        return low.T

    def stretched(self, queries: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """For lifted points: R^2, what makes each query's norm R, and the queries so lifted."""
        square = float((self.points[0] ** 2).sum())
        stretch = np.sqrt(square / (queries**2).sum(axis=1))
        return square, stretch, np.pad(queries * stretch[:, None], ((0, 0), (0, 1)))

    def search(self, queries: np.ndarray, k: int, relax: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Point numbers and distances [query, k], nearest first; -1 and infinity where there are fewer."""
        best, dist = np.full((len(queries), k), -1), np.full((len(queries), k), np.inf)
        if len(self.points) and len(queries):
            about = lambda x, y: 2 * x @ y.T - (x**2).sum(axis=1)[:, None] - (y**2).sum(axis=1)
            size = float((self.points**2).sum(axis=1).max() + (queries**2).sum(axis=1).max())
            who, what, score, _ = self._best(queries, queries, self.points, k, relax, about, lambda x, y: -((x - y) ** 2).sum(axis=1), lambda least: np.sqrt(np.maximum(-least, 0)), size)
            at = np.arange(len(who)) - np.searchsorted(who, np.arange(len(queries)))[who]
            best[who, at], dist[who, at] = what, np.sqrt(-score)
        return best, dist

    def largest_products(self, queries: np.ndarray, k: int, relax: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(query number, point number, product) of each query's k best, by (query, product, point number), and the share of pairs
        that were not looked at. points are lifted, queries are not; norms are at most 1."""
        if not len(self.points) or not len(queries):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0.0
        square, stretch, asked = self.stretched(queries)
        reach = lambda least: np.sqrt(np.maximum(2 * square - 2 * least * stretch, 0))
        return self._best(asked, queries, np.ascontiguousarray(self.points[:, :-1]), k, relax, lambda x, y: x @ y.T, products, reach, 1.0)

    def _best(self, asked: np.ndarray, queries: np.ndarray, points: np.ndarray, k: int, relax: float, about, exact, reach, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The k best of each query by exact(query, point), where about gives a matrix of the same up to rounding, and reach the
        distance of a score. asked are the queries in the tree's space; size is the scale of scores."""
        q, n = len(queries), len(points)
        low = np.ascontiguousarray(self.bounds(asked).T)
        nothing = np.zeros(0, np.int64)
        least, held = np.full(q, -np.inf), [(nothing, nothing, np.zeros(0))]
        looked, room = 0, 0

        def merge() -> None:
            nonlocal room
            who, what, score = (np.concatenate(x) for x in zip(*held))
            by = np.lexsort((what, -score, who))
            who, what, score = who[by], what[by], score[by]
            first = np.searchsorted(who, np.arange(q + 1))
            best = np.arange(len(who)) - first[who] < k
            held[:] = [(who[best], what[best], score[best])]
            full = np.flatnonzero(np.diff(first) >= k)
            least[full] = score[first[full] + k - 1]
            room = 0

        def look(leaf: int, rows: np.ndarray, fresh: bool) -> None:
            nonlocal looked, room
            ids = self.order[self.edges[leaf] : self.edges[leaf + 1]]
            looked += len(ids) * len(rows)
            close = about(queries[rows], points[ids])
            floor = least[rows]
            if fresh and len(ids) > k:  # k of this leaf are as good
                floor = np.partition(close, len(ids) - k, axis=1)[:, len(ids) - k]
            i, j = np.nonzero(close >= (floor - PRODUCT_SLACK * size)[:, None])
            if len(i):
                held.append((rows[i], ids[j], exact(queries[rows[i]], points[ids[j]])))
                room += len(i)
                if room > 16 * q:
                    merge()

        some = min(FIRST_LEAVES, self.leaves)
        seen = np.zeros(low.shape, bool)
        np.put_along_axis(seen, np.argpartition(low, some - 1, axis=0)[:some], True, axis=0)
        for leaf in range(self.leaves):
            rows = np.flatnonzero(seen[leaf])
            if len(rows):
                look(leaf, rows, True)
        merge()
        for leaf in np.argsort(low.sum(axis=1), kind="stable").tolist():
            rows = np.flatnonzero(~seen[leaf] & ~(low[leaf] > reach(least) / relax + DISTANCE_SLACK * size**0.5))
            if len(rows):
                look(leaf, rows, False)
        merge()
        return *held[0], 1 - looked / (n * q)


def fitted_relax(points: np.ndarray, queries: np.ndarray, k: int, target: float = TARGET) -> float:
    """The factor at which the share `target` of the queries' true neighbours among points lies in leaves that are not pruned."""
    if len(points) <= k or not len(queries):
        return 1.0
    tree, asked = VPTree(lifted(scaled_together(points)[0])), scaled(queries)[0]
    leaf = np.empty(len(points), np.int64)
    leaf[tree.order] = np.repeat(np.arange(tree.leaves), np.diff(tree.edges))
    close = asked @ tree.points[:, :-1].T
    near = np.argpartition(-close, k, axis=1)[:, :k]
    square, stretch, lift = tree.stretched(asked)
    reach = np.sqrt(np.maximum(2 * square - 2 * np.take_along_axis(close, near, 1).min(axis=1) * stretch, 0))
    bound = np.take_along_axis(tree.bounds(lift), leaf[near], 1)
    ratio = float(np.quantile(bound / np.maximum(reach, 1e-9)[:, None], target))
    return min(MOST_RELAX, max(1.0, 1 / max(ratio, 1e-9)))


def scaled_together(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows scaled by one power of two to norms of at most 1, and its exponent."""
    if not len(x):
        return x, 0
    _, exponents = scaled(x)
    return np.ldexp(x, -exponents.max()), int(exponents.max())


_TREE = "s int, exponent int, ids binary, edges binary, points binary, vantage binary, leaf_order binary, leaf_edges binary, path binary"


def _build(dim: int, k: int):
    def of(shard: pa.Table) -> pa.Table:
        points, ids = _vectors(shard.column("v"), dim), shard.column("id").to_numpy()
        times = np.minimum(shard.column("c").to_numpy(), k)
        points = points + 0.0  # -0.0 and 0.0 are one value
        _, first, same = np.unique(np.ascontiguousarray(points).view(f"V{8 * dim}").ravel(), return_index=True, return_inverse=True)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, same, ids)
        number = np.empty(len(first), np.int64)  # distinct vectors in the order of their least id
        number[np.argsort(least, kind="stable")] = np.arange(len(first))
        by = np.lexsort((ids, number[same]))
        group, own = np.repeat(number[same][by], times[by]), np.repeat(ids[by], times[by])
        edges = np.searchsorted(group, np.arange(len(first) + 1))
        distinct = np.empty((len(first), dim))
        distinct[number] = points[first]
        distinct, exponent = scaled_together(distinct)
        row = [shard.column("s")[0].as_py(), exponent, own.tobytes(), edges.astype(np.int64).tobytes(), *VPTree(lifted(distinct)).stored()]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
        return pa.table([pa.array([x], t) for x, t in zip(row, kinds)], [c.split()[0] for c in _TREE.split(", ")])

    return of


def _vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten(), np.float64).reshape(-1, dim)


#: Exponents of products beyond which doubles lose them.
_RANGE = 900


def _cell(dim: int, k: int, relax: float):
    schema = pa.schema([("query_id", pa.int64()), ("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("skipped", pa.float64())])

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        row = left.to_pylist()[0]
        tree = VPTree.restored([row[c] for c in ("points", "vantage", "leaf_order", "leaf_edges", "path")], dim + 1)
        ids, edges = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["edges"], np.int64)
        queries, own, name = _vectors(right.column("v"), dim), right.column("id").to_numpy(), right.column("q").to_numpy()
        out: list[pa.Table] = []
        for a in range(0, len(queries), 2048):
            asked, exponent = scaled(queries[a : a + 2048])
            mine, power = own[a : a + 2048], exponent + row["exponent"]
            # one more than k, as a query's own vector may be among them
            who, what, score, skipped = tree.largest_products(asked, k + 1, relax)
            odd = np.flatnonzero(np.abs(power) > _RANGE)
            if len(odd):  # their ranks are those of what doubles can hold
                stay = ~np.isin(who, odd)
                every = [np.ldexp(products(np.broadcast_to(asked[i], (len(tree.points), dim)), tree.points[:, :dim]), power[i]) for i in odd]
                top = [np.lexsort((np.arange(len(x)), -x))[: k + 1] for x in every]
                who = np.concatenate([who[stay], np.repeat(odd, [len(t) for t in top])])
                what = np.concatenate([what[stay], *top])
                score = np.concatenate([np.ldexp(score[stay], power[who[: stay.sum()]]), *(x[t] for x, t in zip(every, top))])
            else:
                score = np.ldexp(score, power[who])
            # of each vector the k smallest ids that are not the query's own
            size = edges[what + 1] - edges[what]
            start = np.cumsum(size) - size
            at = np.repeat(edges[what] - start, size) + np.arange(int(size.sum()))
            who, score, found = np.repeat(who, size), np.repeat(score, size), ids[at]
            other = found != mine[who]
            who, score, found = who[other], score[other], found[other]
            by = np.lexsort((found, -score, who))
            who, score, found = who[by], score[by], found[by]
            best = np.arange(len(who)) - np.searchsorted(who, np.arange(len(mine)))[who] < k
            out.append(pa.table([mine[who[best]], name[a : a + 2048][who[best]], found[best], score[best], np.full(int(best.sum()), skipped)], schema=schema))
        return pa.concat_tables(out)

    return of


_USABLE = "id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"


def _banded(dim: int):
    """Adds the binary exponent of each norm, rounded: norms of about 1 have one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, exponents = scaled(_vectors(batch.column("v"), dim))
            band = exponents + np.round(np.log2(np.linalg.norm(x, axis=1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(band, pa.int32())], [*batch.schema.names, "band"])

    return of


def search(vectors: DataFrame, queries: DataFrame, k: int = K, relax: float | None = 1.0, shard: int = SHARD, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score, skipped): for each query (id, v) its k nearest of vectors (id, v) but for its own id.
    skipped is the share of the row's shard that its block of queries did not have to look at. relax None fits the factor."""
    shape = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where(_USABLE)
    vectors, queries = shape(vectors), shape(queries)
    schema = "query_id long, rank int, vec_id long, score double, skipped double"
    dims = vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = dims[0].dim
    vectors = materialise(vectors.where(F.size("v") == dim).groupBy("id", "v").agg(F.count("*").alias("c")).mapInArrow(_banded(dim), "id long, v array<double>, c long, band int"), "vectors")
    queries = queries.where(F.size("v") == dim).dropDuplicates(["id", "v"]).withColumn("q", F.xxhash64("v"))
    # as many shards for each exponent as its rows need; there are about two thousand exponents of doubles
    sizes = sorted(tuple(r) for r in vectors.groupBy("band").agg(F.count("*")).collect())
    shards, parts = 0, []
    for band, n in sizes:
        parts.append((band, shards, -(-n // shard)))
        shards += -(-n // shard)
    if relax is None:
        drawn = lambda df, n, salt: np.array([r.v for r in df.orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(n).select("v").collect()], np.float64).reshape(-1, dim)
        widest = max(sizes, key=lambda x: (x[1], x[0]))[0]
        relax = fitted_relax(drawn(vectors.where(F.col("band") == widest), SAMPLE_POINTS, 1), drawn(queries, SAMPLE_QUERIES, 2), k)
    place = vectors.sparkSession.createDataFrame(parts, "band int, base int, parts int")
    dealt = vectors.join(F.broadcast(place), "band").select((F.col("base") + F.pmod(F.xxhash64("id", "v"), F.col("parts"))).cast("int").alias("s"), "id", "v", "c")
    trees = materialise(dealt.groupBy("s").applyInArrow(_build(dim, k), _TREE), "trees")
    blocks = -(-max(1, queries.count()) // block)
    grid = trees.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.select("id", "v", "q", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"))
    found = grid.groupBy("s", "b").cogroup(asked.groupBy("s", "b")).applyInArrow(_cell(dim, k, relax), "query_id long, q long, vec_id long, score double, skipped double")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id, q order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "skipped")


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search(rows, rows.where("id % 20 = 0"), relax=None).drop("skipped")
