"""Exact top-k search by inner product with M-trees.

Vectors are dealt to the nearest of a bounded number of pivots, and each pivot's cell is cut into blocks of a bounded number of rows. Of every block an M-tree of pages is built
once and written. Inner product becomes a metric by one more coordinate: with M the largest norm of a
block, v becomes (v, sqrt(M^2 - |v|^2)) and a query (q, 0), so distance falls as the product grows. A node stores its
routing vector, covering radius and distance to its parent's routing vector; a subtree is skipped when the parent's distance alone,
or else its own distance minus the radius, shows that nothing below beats the k-th best. Bounds are floating point with a slack far above
the rounding error; scores are exact integers.

A query first searches the cell of its likeliest pivot. Its k-th best score there is the bar for all other cells: it is routed only to those whose covering radius
can reach the bar (q v <= q c + |q| r for a cell with centre c and radius r). The query set grows with the data, so queries are not broadcast: they go to tasks in blocks,
each of which meets one tree, and all queries of a task go through the tree together, each taking its most promising page first.

Defined results: a component x counts as floor(256 x), components beyond what a long holds are cut to its range, and scores are exact as long as they fit a long; null vectors,
or those with a null or non-finite component, take no part, nor do
rows with a null id; a query's own row is no candidate, but every other one is: rows that repeat id and vector are searched once and count as often as they stand there, as candidates
and as queries; vectors of another length are compared over the common length only as zeros beyond; fewer candidates give fewer ranks; ties go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch

PAGE = 256
CHILDREN = 32
BLOCK = 8192
QUERY_BLOCK = 8192
#: Pivots at most, and the rows that they are chosen from.
PIVOTS, PIVOT_SAMPLE = 256, 4096
#: Pages that queries take one by one, best first, before the rest goes page by page.
FIRST_PAGES = 3


@dataclass
class Node:
    """An inner node's children, or a leaf page's rows; ``near``: each child's distance to this node's routing vector."""

    routing: np.ndarray
    radius: float
    rows: np.ndarray | None = None
    page: np.ndarray | None = None
    ids: np.ndarray | None = None
    copies: np.ndarray | None = None
    children: list[Node] | None = None
    near: np.ndarray | None = None
    routings: np.ndarray | None = None
    radii: np.ndarray | None = None


def _distances(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - one) ** 2).sum(axis=1), 0))


def _to(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Distances of many points to one, by a product of matrices; a rounding error is covered by the slack of what uses it."""
    return np.sqrt(np.maximum((points * points).sum(axis=1) - 2 * (points @ one) + one @ one, 0))


def _deal(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivots far from each other and the nearest pivot of each point."""
    n = min(most, max(2, -(-2 * len(points) // PAGE)))
    pivots, least = [0], _distances(points, points[0])
    owner = np.zeros(len(points), np.int64)
    while len(pivots) < n and least.max() > 0:
        pivots.append(int(least.argmax()))
        d = _distances(points, points[pivots[-1]])
        owner[d < least] = len(pivots) - 1
        least = np.minimum(least, d)
    return np.array(pivots), owner


def _narrow(whole: np.ndarray) -> np.ndarray:
    """Integers in the smallest type that holds them."""
    kind = np.promote_types(np.min_scalar_type(whole.min(initial=0)), np.min_scalar_type(whole.max(initial=0)))
    return whole.astype(kind if kind.kind in "iu" else np.int64)


def build(points: np.ndarray, rows: np.ndarray | None = None, routing: np.ndarray | None = None) -> Node:
    """Bulk-loaded tree: at most PAGE rows a leaf and about CHILDREN children a node."""
    rows = np.arange(len(points)) if rows is None else rows
    own = points[rows]
    routing = own.mean(axis=0) if routing is None else routing
    radius = float(_distances(own, routing).max())
    if len(rows) <= PAGE:
        return Node(routing, radius, rows=rows, near=_distances(own, routing))
    pivots, owner = _deal(own, CHILDREN)
    if len(pivots) == 1:  # all are one point: pages of equal rows
        children = [build(points, rows[i : i + PAGE], own[0]) for i in range(0, len(rows), PAGE)] if len(rows) <= PAGE * PAGE else [build(points, rows[i : i + PAGE * PAGE], own[0]) for i in range(0, len(rows), PAGE * PAGE)]
    else:
        children = [build(points, rows[owner == i], own[p]) for i, p in enumerate(pivots)]
    routings = np.stack([c.routing for c in children])
    return Node(routing, radius, children=children, near=_distances(routings, routing), routings=routings, radii=np.array([c.radius for c in children]))


@dataclass
class Index:
    lift: float
    root: Node
    exact: bool
    wide: int

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray | None = None) -> Index:
        """``copies``: how many rows each vector stands for (else one)."""
        copies = np.ones(len(ids), np.int64) if copies is None else copies
        norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
        top = norms.max()
        points = np.concatenate([vectors.astype(np.float64), np.sqrt(top - norms)[:, None]], axis=1)
        # sums of products below 2^53 are exact in floating point
        exact = top * 4 < 2**53
        root = build(points)
        todo = [root]
        while todo:
            node = todo.pop()
            if node.rows is not None:  # a page holds its rows side by side, in as few bytes as they need: trees travel to every chunk of queries
                node.page, node.ids, node.copies = _narrow(vectors[node.rows]), ids[node.rows], copies[node.rows]
            todo += node.children or []
        return cls(float(top), root, exact, vectors.shape[1])

    def pages(self, queries: np.ndarray, reach: Callable[[], np.ndarray]) -> Iterator[tuple[Node, np.ndarray, np.ndarray]]:
        """(page, lower bound of each query's distance, distance to the parent), from the root down; ``reach``: how far each query still looks."""
        todo = [(self.root, np.zeros(len(queries)), _to(queries, self.root.routing))]
        while todo:
            node, bound, here = todo.pop()
            if node.rows is not None:
                yield node, bound, here
                continue
            for child, near, radius, routing in zip(node.children, node.near, node.radii, node.routings, strict=True):
                low = np.maximum(bound, np.abs(near - here) - radius)  # by the stored distance to the parent only
                dist = np.full(len(queries), np.inf)
                some = np.flatnonzero(low <= reach())
                if len(some):
                    dist[some] = _to(queries[some], routing)
                    todo.append((child, np.maximum(low, np.where(np.isinf(dist), np.inf, dist - radius)), dist))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, bar: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """For each query the k best (score, id), best first, of those that reach its ``bar`` (if any); ``own``: the queries' ids."""
        q = np.concatenate([queries.astype(np.float64), np.zeros((len(queries), 1))], axis=1)
        norms = (q * q).sum(axis=1)
        # a query may be far longer than the block's vectors, so its products can be inexact where theirs aren't
        exact = self.exact and norms.max(initial=0) * self.lift * 16 < 2.0**106
        whole = queries.astype(np.float64 if exact else np.int64)
        square = norms + self.lift
        slack = 1e-6 * (1 + np.sqrt(square))
        scores = np.full((len(q), k), np.iinfo(np.int64).min, np.int64)
        ids = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
        full = np.zeros(len(q), np.int64)
        least = np.full(len(q), np.nan) if bar is None else bar

        def reach() -> np.ndarray:
            # the k-th best score s stands for the distance sqrt(square - 2 s); nothing farther, ties apart, can be better
            score = np.where(full >= k, scores[:, -1].astype(np.float64), np.nan)
            return np.nan_to_num(np.sqrt(np.maximum(0.0, square - 2.0 * np.fmax(score, least))) + slack, nan=np.inf)

        def visit(page: Node, which: np.ndarray) -> None:
            found = (whole[which] @ page.page.astype(whole.dtype).T).astype(np.int64)
            times = np.broadcast_to(page.copies, found.shape)
            mine = page.ids[None, :] == own[which][:, None]
            if mine.any():
                times = times.copy()
                at, hit = np.nonzero(mine)
                times[at, hit] -= (queries[which[at]] == page.page[hit]).all(axis=1)
            fit = (times > 0) & ~(found < least[which][:, None]) & ((found >= scores[which, -1][:, None]) | (full[which] < k)[:, None])
            for row in np.flatnonzero(fit.any(axis=1)):
                i, hits = which[row], np.flatnonzero(fit[row])
                hits = np.repeat(hits, np.minimum(times[row, hits], k))
                s = np.concatenate([scores[i, : full[i]], found[row, hits]])
                names = np.concatenate([ids[i, : full[i]], page.ids[hits]])
                order = np.lexsort((names, -s))[:k]
                full[i] = len(order)
                scores[i, : full[i]], ids[i, : full[i]] = s[order], names[order]

        listed = list(self.pages(q, reach))
        bounds = np.stack([bound for _, bound, _ in listed], axis=1)
        first = np.argsort(bounds, axis=1, kind="stable")[:, :FIRST_PAGES]
        for turn in range(first.shape[1]):
            far = reach()
            for at in np.unique(first[:, turn]):
                which = np.flatnonzero((first[:, turn] == at) & (bounds[:, at] <= far))
                if len(which):
                    visit(listed[at][0], which)
                    bounds[which, at] = np.inf
        for at, (page, _, here) in enumerate(listed):
            far = reach()
            which = np.flatnonzero(np.isfinite(bounds[:, at]) & (bounds[:, at] <= far))
            # by the rows' stored distances to the page's routing vector
            which = which[(here[which] - far[which] <= page.near.max()) & (here[which] + far[which] >= page.near.min())]
            if len(which):
                visit(page, which)
        return [[(int(s), int(n)) for s, n in zip(scores[i, : full[i]], ids[i, : full[i]], strict=True)] for i in range(len(q))]


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component; null if the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(fine, F.transform(F.when(fine, x), lambda v: F.floor(v * 256).cast("long")))


def _matrix(column, wide: int = 1) -> np.ndarray:
    """Rows of integers from an Arrow list column or a sequence of arrays, zeros beyond their length; ``wide`` columns at least."""
    if isinstance(column, pa.ListArray):
        ends = column.offsets.to_numpy()
        flat, sizes = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends)
    else:
        rows = [np.asarray(v, np.int64) for v in column]
        flat, sizes = np.concatenate([np.empty(0, np.int64), *rows]), np.array([len(v) for v in rows], np.int64)
    wide = max(wide, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide)[None, :] < sizes[:, None]] = flat
    return out


def pivots_of(vectors: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors far from each other, out of ``PIVOT_SAMPLE`` by hash."""
    sample = vectors.orderBy(F.xxhash64("q"), "vec_id").limit(PIVOT_SAMPLE).select("q").collect()  # PIVOT_SAMPLE rows
    points = np.unique(_matrix(r["q"] for r in sample).astype(np.float64), axis=0)
    if not len(points):
        return points
    chosen, least = [0], _distances(points, points[0])
    while len(chosen) < most and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, _distances(points, points[chosen[-1]]))
    return points[chosen]


def _fit(points: np.ndarray, wide: int) -> np.ndarray:
    return np.pad(points, ((0, 0), (0, max(0, wide - points.shape[1]))))


def placed(rows: DataFrame, pivots: np.ndarray, best: bool = False) -> DataFrame:
    """Rows (vec_id, q and the numbers beside them) with the nearest pivot as ``cell`` and the distance to it; ``best``: the pivot with the largest product instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("q"), pivots.shape[1]).astype(np.float64)
            p = _fit(pivots, v.shape[1])
            product = v @ p.T
            away = (v * v).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * product
            cell = (product.argmax(axis=1) if best else away.argmin(axis=1)).astype(np.int64)
            dist = np.sqrt(np.maximum(((v - p[cell]) ** 2).sum(axis=1), 0)) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)], names=[*b.schema.names, "cell", "away"])

    return rows.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "cell long, away double"]))


def _trees(dealt: DataFrame) -> DataFrame:
    """(cell, part, tree): one M-tree a block."""

    def build_one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tree = Index.of(frame["vec_id"].to_numpy(np.int64), _matrix(frame["q"]), frame["copies"].to_numpy(np.int64))
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "tree": [pickle.dumps(tree)]})

    return dealt.groupBy("cell", "part").applyInPandas(build_one, "cell long, part long, tree binary")


def _of_cell(numbers: dict[int, int]) -> Column:
    """The number that belongs to a row's ``cell``; ``numbers`` has PIVOTS entries at most."""
    return F.element_at(F.create_map(*[F.lit(x) for c, n in numbers.items() for x in (int(c), int(n))]), F.col("cell"))


def _each(numbers: dict[int, int]) -> Column:
    """A row for every number below that of the row's cell."""
    return F.explode(F.sequence(F.lit(0).cast("long"), _of_cell(numbers).cast("long") - 1))


def _searched(asked: DataFrame, trees: DataFrame, parts: dict[int, int], k: int, query_block: int) -> DataFrame:
    """(query_id, nth, times, vec_id, score): the k best of every block for every query of ``asked`` (vec_id, nth, times, q, cell, bar), queries in chunks of a bounded number.

    How many blocks and chunks a cell has is known before, so queries and trees meet by one shuffle and without another join: written as files both are
    so small, compared with their rows, that Spark would broadcast them. Both sides' keys are longs: a cogroup hashes them as they are, and an int goes elsewhere than an equal long.
    """
    sizes = asked.groupBy("cell").agg(F.ceil(F.count("*") / query_block).cast("long").alias("chunks"))
    chunks = {r["cell"]: r["chunks"] for r in sizes.collect()}  # PIVOTS rows at most

    def search(_: tuple, ask: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int, int]] = []
        if len(ask):
            for blob in data["tree"]:
                tree = pickle.loads(blob)
                queries = _matrix(ask["q"])
                wide = tree.wide
                queries = _fit(queries[:, :wide], wide)  # beyond the block's length its vectors are zero
                own = ask["vec_id"].to_numpy(np.int64)
                for i, nth, times, hits in zip(own, ask["nth"], ask["times"], tree.search(own, queries, k, ask["bar"].to_numpy(np.float64, na_value=np.nan)), strict=True):
                    out += [(int(i), int(nth), int(times), vec_id, score) for score, vec_id in hits]
        return pd.DataFrame(out, columns=["query_id", "nth", "times", "vec_id", "score"]).astype("int64")

    result = "query_id long, nth long, times long, vec_id long, score long"
    if not chunks:
        return asked.sparkSession.createDataFrame([], result)
    key = lambda name: F.col(name).cast("long")
    keyed = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "q"), _of_cell(chunks))).withColumn("part", _each(parts)).select(key("cell").alias("c"), key("part").alias("p"), key("chunk").alias("n"), "vec_id", "nth", "times", "q", "bar")
    held = trees.where(F.col("cell").isin([int(c) for c in chunks])).withColumn("chunk", _each(chunks)).select(*(key(c).alias(c) for c in ("cell", "part", "chunk")), "tree")
    return keyed.groupBy("c", "p", "n").cogroup(held.groupBy("cell", "part", "chunk")).applyInPandas(search, result)


def _best(found: DataFrame, k: int) -> DataFrame:
    """A query (query_id, nth, times) and its k best (minus score, vec_id), merged with partial aggregation."""
    return found.groupBy("query_id", "nth", "times").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k).alias("best"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Rows query_id, rank, vec_id, score. Both inputs: vec_id long, q array<long>. Of queries that share an id each (``nth``) has its own ranks, given as often (``times``) as it is asked."""
    scratch = Scratch(vectors.sparkSession, "mtree")
    vectors = vectors.groupBy("vec_id", "q").agg(F.count("*").alias("copies"))
    nth = F.row_number().over(Window.partitionBy("vec_id").orderBy("q")).cast("long")
    queries = queries.groupBy("vec_id", "q").agg(F.count("*").alias("times")).withColumn("nth", nth)
    n = vectors.count()
    pivots = pivots_of(vectors, max(1, min(PIVOTS, -(-n // block))))
    if not len(pivots):
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).cast("int").alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    near = scratch.written(placed(vectors, pivots), "cells")
    cells = near.groupBy("cell").agg(F.max("away").alias("radius"), F.ceil(F.count("*") / block).cast("long").alias("parts"))
    held = {r["cell"]: (r["radius"], r["parts"]) for r in cells.collect()}  # PIVOTS rows at most
    parts = {c: p for c, (_, p) in held.items()}
    trees = scratch.written(_trees(near.withColumn("part", F.pmod(F.xxhash64("vec_id", "q"), _of_cell(parts)))), "trees")
    known = np.array(sorted(held))
    home = scratch.written(placed(queries, pivots[known], best=True).withColumn("cell", F.get(F.array(*[F.lit(int(c)).cast("long") for c in known]), F.col("cell").cast("int"))).withColumn("bar", F.lit(None).cast("double")).drop("away"), "home")
    first = scratch.written(_searched(home, trees, parts, k, query_block), "first")
    bar = _best(first, k).select(F.col("query_id").alias("vec_id"), "nth", F.when(F.size("best") >= k, -F.get("best.minus", F.lit(k - 1))).cast("double").alias("bar"))
    radii = np.array([held[c][0] for c in known])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("q"), pivots.shape[1]).astype(np.float64)
            p = _fit(pivots[known], v.shape[1])
            size = np.linalg.norm(v, axis=1)[:, None]
            most = v @ p.T + size * radii[None, :]
            most += 1e-6 * (1 + np.abs(most)) + 1e-9 * size * (np.linalg.norm(p, axis=1) + radii)[None, :]
            least = b.column("bar").to_numpy(zero_copy_only=False).astype(np.float64)
            rows, to = np.nonzero(((most >= least[:, None]) | np.isnan(least)[:, None]) & (known[None, :] != b.column("cell").to_numpy()[:, None]))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows)) for c in ("vec_id", "nth", "times", "q", "bar")), pa.array(known[to].astype(np.int64))], names=["vec_id", "nth", "times", "q", "bar", "cell"])

    more = scratch.written(home.drop("bar").join(bar.hint("merge"), ["vec_id", "nth"], "left").select("vec_id", "nth", "times", "q", "cell", "bar").mapInArrow(route, "vec_id long, nth long, times long, q array<long>, bar double, cell long"), "routed")
    found = first.unionByName(_searched(more, trees, parts, k, query_block))
    asked = _best(found, k).withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    ranked = asked.select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))


def op5_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("q"))
    rows = rows.where("vec_id IS NOT NULL AND q IS NOT NULL")
    return top_k(rows, rows.where("vec_id % 50 = 0"))


OP5_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""
