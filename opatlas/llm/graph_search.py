"""Approximate nearest neighbours by inner product: robustly pruned graphs, one for each shard.

Distinct vectors are sharded by their norm, in bands of a factor of ``2 ** BAND``, then by hash.
Within a shard vectors are divided by its longest norm and get one more component that makes their
norm 1, so that the largest inner product with a query is the smallest distance to it; a vector of
any length leaves the precision of the other bands as it is.  Each shard is a directed graph:
points are inserted in batches, a greedy beam search over the graph so far proposes a point's neighbours, and pruning
keeps a neighbour only if no kept one is closer to it by the factor ``ALPHA`` (Subramanya et al.,
2019), so that diverse edges stay.  Every query searches every shard's graph with a beam; the
shards' best are merged.  Inner products of the divided vectors steer the search in single
precision; scores are inner products of the original vectors in double precision.

Equal vectors are one point of a graph.  It carries the ``TOP + 1`` smallest ids that have it,
which are all that a result of ``TOP`` rows can hold, as ties go to the smaller id.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
those without an id, nor those of another length than most.  Rows that repeat an id and its
vector count once.  Extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opatlas.functions.columns import let
from opatlas.llm.runs import by_key, runs
from opatlas.llm.tables import written

TOP = 20
EVERY = 20
SHARD_ROWS, QUERY_ROWS = 8192, 8192
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 96, 1.2
FIRST, BATCH, AT_ONCE = 64, 512, 4
# Powers of two that the norms of one shard span.
BAND = 3


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int):
    """(ids, negative inner products) of the ``beam`` nearest found, nearest first; -1 where there is none.

    All points have one norm, so the nearest have the largest inner product.
    """
    q = len(queries)
    ids = np.full((q, beam), -1, np.int64)
    far = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    ids[:, 0], done[:, 0] = entry, False
    far[:, 0] = -(queries @ points[entry])
    active = np.arange(q)
    while len(active):
        a_ids, a_far, a_done = ids[active], far[active], done[active]
        # the first few entries not yet expanded; the beam is sorted
        order = np.argsort(a_done, axis=1, kind="stable")[:, :AT_ONCE]
        line = np.arange(len(active))[:, None]
        fresh = ~a_done[line, order]
        a_done[line, order] = True
        near = np.where(fresh[:, :, None], edges[a_ids[line, order]], -1).reshape(len(active), -1)
        near = np.where((near[:, :, None] == a_ids[:, None, :]).any(axis=2), -1, near)
        dots = np.einsum("qnd,qd->qn", points[near], queries[active])
        new_far = np.where(near >= 0, -dots, np.inf)
        all_ids = np.concatenate([a_ids, near], axis=1)
        all_far = np.concatenate([a_far, new_far.astype(np.float32)], axis=1)
        all_done = np.concatenate([a_done, near < 0], axis=1)
        by_id = np.argsort(all_ids, axis=1, kind="stable")  # one point may come from two lists
        sorted_ids = all_ids[line, by_id]
        twice = np.zeros_like(all_done)
        twice[line, by_id[:, 1:]] = (sorted_ids[:, 1:] == sorted_ids[:, :-1]) & (sorted_ids[:, 1:] >= 0)
        all_far[twice] = np.inf
        keep = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        far[active] = all_far[line, keep]
        gone = ~np.isfinite(far[active])
        ids[active] = np.where(gone, -1, all_ids[line, keep])
        done[active] = all_done[line, keep] | gone
        active = active[~done[active].all(axis=1)]
    return ids, far


def robust_prune(points: np.ndarray, centres: np.ndarray, near: np.ndarray, degree: int, alpha: float):
    """For each centre, up to ``degree`` diverse neighbours out of the candidates ``near`` (-1: none)."""
    rows, width = near.shape
    near = np.where(near == centres[:, None], -1, near)
    found = points[near]
    far = ((found - points[centres][:, None, :]) ** 2).sum(axis=2)
    far[near < 0] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    line = np.arange(rows)[:, None]
    near, far, found = near[line, order], far[line, order], found[line, order]
    norms = (found**2).sum(axis=2)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(found, found.transpose(0, 2, 1))
    alive = near >= 0
    kept = np.full((rows, degree), -1, np.int64)
    count = np.zeros(rows, np.int64)
    factor = alpha * alpha  # squared distances
    for i in range(width):
        take = np.flatnonzero(alive[:, i] & (count < degree))
        kept[take, count[take]] = near[take, i]
        count[take] += 1
        alive[take] &= factor * between[take, i] > far[take]
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA):
    """(edges, entry): out-neighbours of every point, -1 where there are fewer, and where to start."""
    n = len(points)
    edges = np.full((n, degree), -1, np.int64)
    middle = points.mean(axis=0)
    entry = int(((points - middle) ** 2).sum(axis=1).argmin())
    order = np.random.Generator(np.random.PCG64(n)).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    first = order[: min(FIRST, n)]
    edges[first] = robust_prune(points, first, np.broadcast_to(first, (len(first), len(first))), degree, alpha)
    at = len(first)
    while at < n:
        new = order[at : at + min(BATCH, at)]
        at += len(new)
        near, _ = beam_search(points, edges, entry, points[new], beam)
        edges[new] = robust_prune(points, new, near, degree, alpha)
        _add_back(points, edges, new, degree, alpha)
    return edges, entry


def _add_back(points: np.ndarray, edges: np.ndarray, new: np.ndarray, degree: int, alpha: float) -> None:
    """Edges from the new points' neighbours back to them; full lists are pruned anew."""
    target, source = edges[new].ravel(), np.repeat(new, degree)
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    heads, begin, count = np.unique(target, return_index=True, return_counts=True)
    width = int(count.max(initial=0))
    extra = np.full((len(heads), width), -1, np.int64)
    place = np.arange(len(target)) - np.repeat(begin, count)
    extra[np.repeat(np.arange(len(heads)), count), place] = source
    merged = np.concatenate([edges[heads], extra], axis=1)
    sizes = (merged >= 0).sum(axis=1)
    room = sizes <= degree
    packed = np.take_along_axis(merged, np.argsort(merged < 0, axis=1, kind="stable"), axis=1)
    edges[heads[room]] = packed[room, :degree]
    for own in np.array_split(np.flatnonzero(~room), max(1, int((~room).sum()) * merged.shape[1] ** 2 >> 22)):
        if len(own):
            widest = int(sizes[own].max())
            edges[heads[own]] = robust_prune(points, heads[own], packed[own, :widest], degree, alpha)


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part."""
    as_doubles = F.col(vector).cast("array<double>")
    some = rows.select("vec_id", as_doubles.alias("vector")).where(
        F.col("vec_id").isNotNull()
        & (F.size("vector") > 0)
        & F.forall(
            "vector",
            lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")),
        )
        & F.exists("vector", lambda x: x != 0)
    )
    length = some.agg(F.mode(F.size("vector")).alias("n")).first()["n"]
    # -0.0 and 0.0 are one value
    plain = F.transform("vector", lambda x: x + F.lit(0.0))
    return some.where(F.size("vector") == F.lit(length or 0)).select("vec_id", plain.alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector divided by its largest component, so that no square leaves the doubles' range."""
    return vectors / np.abs(vectors).max(axis=1, keepdims=True)


def _raised(vectors: np.ndarray) -> np.ndarray:
    """Points of norm 1 whose distance to a query (with a 0 added) falls as the inner product grows."""
    shared = np.abs(vectors).max(initial=0.0) or 1.0
    vectors = vectors / shared
    squares = (vectors**2).sum(axis=1)
    longest = squares.max(initial=0.0) or 1.0
    rest = np.sqrt(np.maximum(1.0 - squares / longest, 0.0))
    return np.concatenate([vectors / np.sqrt(longest), rest[:, None]], axis=1).astype(np.float32)


def _band() -> Column:
    """Which band the norm of ``vector`` lies in; a norm of 1 is in the middle of its band."""
    top = F.array_max(F.transform("vector", F.abs))
    squares = let(
        top,
        lambda m: F.struct(
            m.alias("top"), F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + (x / m) * (x / m)).alias("sum")
        ),
    )
    return let(squares, lambda s: F.round((F.log2(s["top"]) + F.log2(s["sum"]) / 2) / BAND).cast("int"))


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(graph rows, number of shards) over all usable vectors."""
    first = Window.partitionBy("vector").orderBy("vec_id")
    points = (
        vectors.distinct()
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= TOP + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("band", _band())
    )
    points = written(points, "points")
    bands, shards = [], 0
    for row in points.groupBy("band").count().orderBy("band").collect():  # at most some 700 bands
        own = -(-row["count"] // shard_rows)
        bands.append((row["band"], shards, own))
        shards += own
    layout = points.sparkSession.createDataFrame(bands, "of_band int, base int, own int")
    placed = points.join(F.broadcast(layout), F.col("band") == F.col("of_band")).withColumn(
        "shard", (F.col("base") + F.pmod(F.xxhash64("vector"), F.col("own"))).cast("int")
    )

    def graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "shard"):
            edges, entry = build_graph(_raised(_matrix(run.column("vector"))))
            n = len(edges)
            yield pa.RecordBatch.from_arrays(
                [
                    run.column("shard"),
                    pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(np.arange(n) == entry),
                    run.column("vector"),
                    run.column("ids"),
                    pa.array(list(edges.astype(np.int32)), pa.list_(pa.int32())),
                ],
                ["shard", "point", "entry", "vector", "ids", "edges"],
            )

    schema = "shard int, point int, entry boolean, vector array<double>, ids array<bigint>, edges array<int>"
    graph = by_key(placed.select("shard", "vector", "ids"), "shard").mapInArrow(graphs, schema)
    return written(graph, "graph"), max(1, shards)


def search(graph: DataFrame, shards: int, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of each query, its own id left out.

    Every query meets every shard, in blocks of bounded size on both sides.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERY_ROWS))
    asked = queries.select(F.col("vec_id").alias("query_id"), "vector").distinct()
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spread = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def found(points: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], "score": [], "ids": []}
        if points.num_rows and asked.num_rows:
            points = points.sort_by("point")
            vectors, wanted = _matrix(points.column("vector")), _matrix(asked.column("vector"))
            raised = _raised(vectors)
            edges = _matrix(points.column("edges")).astype(np.int64)
            entry = int(np.flatnonzero(points.column("entry").to_numpy(zero_copy_only=False))[0])
            ids = points.column("ids").to_pylist()
            least = np.array([i[0] for i in ids])
            names = asked.column("query_id").to_numpy()
            for begin in range(0, len(wanted), 512):
                part = wanted[begin : begin + 512]
                ready = np.concatenate([_scaled(part), np.zeros((len(part), 1))], axis=1).astype(np.float32)
                near, _ = beam_search(raised, edges, entry, ready, max(SEARCH_BEAM, 4 * top))
                for line, (query, own) in enumerate(zip(part, near, strict=True)):
                    own = own[own >= 0]
                    score = (vectors[own] * query).sum(axis=1)
                    for i in np.lexsort((least[own], -score))[: top + 1]:
                        out["query_id"].append(int(names[begin + line]))
                        out["score"].append(float(score[i]))
                        out["ids"].append(ids[own[i]])
        return pa.table(
            {
                "query_id": pa.array(out["query_id"], pa.int64()),
                "score": pa.array(out["score"], pa.float64()),
                "ids": pa.array(out["ids"], pa.list_(pa.int64())),
            }
        )

    best = (
        spread.groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInArrow(found, "query_id bigint, score double, ids array<bigint>")
    )
    each = best.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(rows: DataFrame, vector: str = "embedding", every: int = EVERY, top: int = TOP) -> DataFrame:
    """Nearest neighbours of every row whose id is divisible by ``every``, among all rows."""
    vectors = usable(rows, vector)
    graph, shards = build_index(vectors)
    return search(graph, shards, vectors.where(F.col("vec_id") % every == 0), top)
