"""Approximate nearest neighbours: NN-descent builds a graph by iterative Spark joins, queries search it greedily.

Equal vectors are one node (its smallest vec_id), so a vector that a third of the rows repeat adds no edges. The graph starts from blocks
of nodes that lie side by side on random directions. In each round every node gathers its neighbours, forward ones and a bounded number
of reverse ones, with 8-bit copies of their vectors, and tells each of them which of the others are nearer than its farthest neighbour.
A search keeps the EF nearest nodes seen so far for each query and opens all of them that are not open yet, one round of joins for all
queries of a block; it ends when there is nothing to open. Distances of the search are exact, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.llm.common import remove, written

#: Neighbours of a node in the graph; reverse ones in a round; nodes of a starting block; rounds; width of the search; queries of a block.
NEIGHBOURS, REVERSE, BLOCK, STARTS, ROUNDS, EF, QUERIES = 20, 20, 256, 3, 6, 768, 4096

_EDGES = "node long, near array<long>, dist array<float>"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector (array<double>) of the rows that take part: no null id, and a vector that is neither null, empty nor zero and holds
    neither null nor non-finite components."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(~F.coalesce(bad, F.lit(True)) & F.exists("vector", lambda x: x != 0.0))


def _matrix(column: pa.Array, kind: str = "f8") -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1), dtype=kind)


def _best(ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest, each id once, ties to the smaller id."""
    order = np.lexsort((ids, dist))
    ids, dist = ids[order], dist[order]
    _, first = np.unique(ids, return_index=True)
    keep = np.sort(first)[:k]
    return ids[keep], dist[keep]


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
    return np.maximum(d, 0)


def _block_edges(k: int, block: int):
    """Sorted rows to edges inside blocks of neighbours in the order."""

    def edges(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        d = _squared(x, x)
        np.fill_diagonal(d, np.inf)
        m = min(k, len(ids) - 1)
        at = np.argpartition(d, m - 1, 1)[:, :m] if m else np.zeros((len(ids), 0), int)
        return _rows(ids, [ids[a] for a in at], [d[i, a] for i, a in enumerate(at)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.zeros(0, np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            more = _matrix(b.column(1), "f4")
            ids, x = np.concatenate([ids, b.column(0).to_numpy()]), more if x is None else np.concatenate([x, more])
            while len(ids) >= 2 * block:
                yield edges(ids[:block], x[:block])
                ids, x = ids[block:], x[block:]
        if len(ids) and x is not None:
            yield edges(ids, x)

    return run


def _rows(nodes, near: list, dist: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(near, pa.list_(pa.int64())), pa.array([np.asarray(d, "f4") for d in dist], pa.list_(pa.float32()))], ["node", "near", "dist"])


def _merge(edges: DataFrame, k: int) -> DataFrame:
    """One row per node: its k nearest of all rows."""

    def best(parts: pd.DataFrame) -> pd.DataFrame:
        a, d = _best(np.concatenate([np.asarray(x, np.int64) for x in parts["near"]]), np.concatenate([np.asarray(x, "f4") for x in parts["dist"]]), k)
        return pd.DataFrame({"node": [parts["node"].iloc[0]], "near": [a], "dist": [d]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, dist = [], []
            for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                a, d = _best(np.array([i for p in x for i in p], np.int64), np.array([v for p in y for v in p], "f4"), k)
                near.append(a)
                dist.append(d)
            yield _rows(b.column(0), near, dist)

    return edges.groupBy("node").agg(F.collect_list("near").alias("near"), F.collect_list("dist").alias("dist")).mapInArrow(run, _EDGES)


def _local_join(k: int):
    """(hub, members: id, code, scale, far) to what each member learns: nearer members than its farthest neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, near, dist = [], [], []
            lists = b.column(0)
            flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ids = flat.field("id").to_numpy()
            scale, far = flat.field("scale").to_numpy(), flat.field("far").to_numpy()
            codes = np.frombuffer(b"".join(flat.field("code").to_pylist()), np.int8).reshape(len(ids), -1)
            for a, e in zip(ends[:-1], ends[1:]):
                own = ids[a:e]
                _, one = np.unique(own, return_index=True)
                x = codes[a:e][one].astype("f4") * scale[a:e][one, None]
                d = _squared(x, x)
                np.fill_diagonal(d, np.inf)
                own, bound = own[one], far[a:e][one]
                good = d < bound[:, None] * 1.02
                for i in np.flatnonzero(good.any(1)):
                    at = np.flatnonzero(good[i])
                    if len(at) > k:
                        at = at[np.argpartition(d[i, at], k - 1)[:k]]
                    nodes.append(own[i])
                    near.append(own[at])
                    dist.append(d[i, at])
            if nodes:
                yield _rows(nodes, near, dist)

    return run


def _coded(nodes: DataFrame) -> DataFrame:
    """node, code (8-bit components), scale."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), "f4")
                scale = np.abs(x).max(1) / 127
                code = np.rint(x / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale, pa.float32())], ["node", "code", "scale"])

    return nodes.select("node", "vector").mapInArrow(run, "node long, code binary, scale float")


def build_graph(nodes: DataFrame, k: int = NEIGHBOURS, reverse: int = REVERSE, rounds: int = ROUNDS, starts: int = STARTS, block: int = BLOCK, seed: int = 9) -> DataFrame:
    """node, near (array<long>, nearest first), dist (squared, of the 8-bit copies from the second round on). nodes: node, vector."""
    width = nodes.select(F.max(F.size("vector"))).first()[0] or 0
    rng = np.random.default_rng(seed)
    parts = []
    for _ in range(starts):
        way = F.array(*[F.lit(float(v)) for v in rng.standard_normal(width)])
        place = F.aggregate(F.zip_with("vector", way, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        parts.append(nodes.withColumn("place", place).repartitionByRange("place").sortWithinPartitions("place", "node").select("node", "vector").mapInArrow(_block_edges(k, block), _EDGES))
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    graph = written(_merge(edges, k), "graph")
    codes = written(_coded(nodes), "codes")
    for turn in range(rounds):
        forward = graph.select(F.col("node").alias("hub"), F.explode(F.concat("near", F.array("node"))).alias("id"))
        # Reverse neighbours of a node are unbounded (hubs); each round draws others, at most `reverse`.
        back = graph.select(F.explode("near").alias("hub"), F.col("node").alias("id")).withColumn("k", F.row_number().over(Window.partitionBy("hub").orderBy(F.xxhash64("id", F.lit(turn))))).where(F.col("k") <= reverse).drop("k")
        members = forward.unionByName(back).join(codes.withColumnRenamed("node", "id"), "id").join(graph.select(F.col("node").alias("id"), F.coalesce(F.element_at("dist", -1), F.lit(float("inf"))).cast("float").alias("far")), "id")
        hubs = members.groupBy("hub").agg(F.collect_list(F.struct("id", "code", "scale", "far")).alias("m")).select("m")
        told = hubs.mapInArrow(_local_join(k), _EDGES)
        last, graph = graph, written(_merge(graph.unionByName(told), k), "graph")
        remove(last)
    remove(codes)
    return graph


def _opened(hop: DataFrame, vectors: DataFrame, queries, width: int) -> DataFrame:
    """(node, queries that look at it) to (query, ids, dist): the `width` nearest for each query, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = queries.value
        held: dict[int, list] = {}

        def rows(which: list[int]) -> pa.RecordBatch:
            near, dist = [], []
            for q in which:
                part = held.pop(q)
                a, d = _best(np.concatenate([p for p, _ in part]), np.concatenate([p for _, p in part]), width)
                near.append(a)
                dist.append(d)
            return pa.RecordBatch.from_arrays([pa.array([int(ids[q]) for q in which], pa.int64()), pa.array(near, pa.list_(pa.int64())), pa.array(dist, pa.list_(pa.float64()))], ["query", "near", "dist"])

        count = 0
        for b in batches:
            if not b.num_rows:
                continue
            nodes, y = b.column(0).to_numpy(), _matrix(b.column(2))
            lists = b.column(1)
            who = np.searchsorted(ids, lists.flatten().to_numpy())
            row = np.repeat(np.arange(len(nodes)), np.diff(lists.offsets.to_numpy()))
            d = np.empty(len(who))
            for k in range(0, len(who), 8192):
                d[k : k + 8192] = np.sqrt(((x[who[k : k + 8192]] - y[row[k : k + 8192]]) ** 2).sum(1))
            order = np.argsort(who, kind="stable")
            who, row, d = who[order], row[order], d[order]
            cuts = np.flatnonzero(np.diff(who)) + 1
            for a, n in zip(np.split(np.arange(len(who)), cuts), who[np.concatenate([[0], cuts]).astype(int)] if len(who) else []):
                held.setdefault(int(n), []).append((nodes[row[a]], d[a]))
            count += len(who)
            if count > 2_000_000:
                for k in range(0, len(which := list(held)), 256):
                    yield rows(which[k : k + 256])
                count = 0
        for k in range(0, len(which := list(held)), 256):
            yield rows(which[k : k + 256])

    seen = hop.join(vectors, "node").select("node", "queries", "vector")
    return seen.mapInArrow(run, "query long, near array<long>, dist array<double>")


def _beam(old: DataFrame | None, found: DataFrame, width: int) -> DataFrame:
    """query, near, dist, open: the best `width` of both; open marks entries whose neighbours were not looked at yet."""
    rows = found.select("query", "near", "dist", F.transform("near", lambda _: F.lit(True)).alias("open"))
    if old is not None:
        rows = old.unionByName(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, dist, open_ = [], [], []
            for part in b.column(1).to_pylist():
                ids = np.array([i for p in part for i in p["near"]], np.int64)
                d = np.array([v for p in part for v in p["dist"]])
                o = np.array([v for p in part for v in p["open"]], bool)
                order = np.lexsort((o, ids, d))  # of an id that is there twice the opened entry comes first
                ids, d, o = ids[order], d[order], o[order]
                _, first = np.unique(ids, return_index=True)
                keep = np.sort(first)[:width]
                near.append(ids[keep])
                dist.append(d[keep])
                open_.append(o[keep])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near, pa.list_(pa.int64())), pa.array(dist, pa.list_(pa.float64())), pa.array(open_, pa.list_(pa.bool_()))], ["query", "near", "dist", "open"])

    grouped = rows.groupBy("query").agg(F.collect_list(F.struct("near", "dist", "open")).alias("parts"))
    return grouped.mapInArrow(run, "query long, near array<long>, dist array<double>, open array<boolean>")


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, width: int = EF, at_once: int = QUERIES) -> DataFrame:
    """query, node, dist: up to `width` nearest nodes of each query (query, node, vector: its id, the node it starts at, its vector)."""
    spark = nodes.sparkSession
    vectors = nodes.select("node", "vector")
    # Both directions of an edge are followed, so that nodes nobody names are still reached.
    there = graph.select("node", F.explode("near").alias("to"))
    out_of = written(there.unionByName(there.select(F.col("to").alias("node"), F.col("node").alias("to"))).groupBy("node").agg(F.collect_set("to").alias("to")), "links")
    n = queries.count()
    blocks = max(1, -(-n // at_once))
    results = []
    for block in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block) if blocks > 1 else queries
        table = some.select("query", "node", "vector").orderBy("query").collect()  # at_once queries, about
        if not table:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["query"] for r in table], np.int64), np.array([r["vector"] for r in table], float)))
        first = some.groupBy("node").agg(F.collect_list("query").alias("queries"))
        beam = written(_beam(None, _opened(first, vectors, shared, width), width), "beam")
        while True:  # what falls out of a beam is farther than all in it and never returns, so there is an end
            todo = beam.select("query", F.explode(F.arrays_zip("near", "open")).alias("e")).where("e.open").select(F.col("e.near").alias("node"), "query")
            if todo.isEmpty():
                break
            by_node = todo.groupBy("node").agg(F.collect_list("query").alias("queries"))
            hop = by_node.join(out_of, "node").select(F.explode("to").alias("node"), "queries").groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("queries"))).alias("queries"))
            shut = beam.withColumn("open", F.transform("open", lambda _: F.lit(False)))
            last, beam = beam, written(_beam(shut, _opened(hop, vectors, shared, width), width), "beam")
            remove(last)
        results.append(beam.select("query", F.explode(F.arrays_zip("near", "dist")).alias("e")).select("query", F.col("e.near").alias("node"), F.col("e.dist").alias("dist")))
    if not results:
        return spark.createDataFrame([], "query long, node long, dist double")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = NEIGHBOURS, width: int = EF, rounds: int = ROUNDS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose id `every` divides, by Euclidean distance, nearest first,
    ties to the smaller id, never the row itself.

    Rows without id or with an unusable vector (see usable) take no part. Rows that repeat an id with equal vectors count once; of an id with
    several vectors the smallest vector counts. Equal vectors are at distance 0 of each other. Vectors of another length than the first row's
    take no part. An empty table gives an empty result; fewer than k others give all of them. Other columns are ignored.
    """
    rows = usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    length = rows.agg(F.min_by(F.size("vector"), "vec_id")).first()[0]
    if length is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = written(rows.where(F.size("vector") == length), "vectors")
    named = rows.groupBy("vector").agg(F.min("vec_id").alias("node"))
    nodes = written(named, "nodes")
    belongs = rows.join(nodes, "vector").select("vec_id", "node", "vector")
    belongs = written(belongs, "members")
    graph = build_graph(nodes, neighbours, rounds=rounds)
    queries = belongs.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), "node", "vector")
    found = search(nodes, graph, queries, width)
    # k+1 nodes and k+1 members of each are enough: one of them may be the query itself.
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("dist", "node"))).where(F.col("r") <= k + 1).drop("r")
    few = belongs.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= k + 1).select("node", "vec_id")
    pairs = near.join(few, "node").where("vec_id <> query")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("dist", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", "vec_id", F.col("dist").alias("score"))
