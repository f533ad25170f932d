"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard of the vectors.

Equal vectors are one node, so that a group of copies can't fill the lists of its members; a node keeps the ``k + 1``
smallest ids of its group, which is all that a result of ``k`` can hold of it.  Nodes are dealt into shards by a hash.  A shard's
graph is built in one task and kept as flat arrays: nodes are ordered by level, highest first, so that a layer is the first
so many nodes, with one array of neighbours (-1: none) of fixed width.  A layer starts as the graph of the layer above
it; the other nodes enter in batches, each searching from where the upper layers lead it, and link to the candidates that
are nearer to them than to any neighbour chosen before; lists that overflow are chosen anew by the same rule.

Queries go against all shards, in blocks of ``QUERY_ROWS`` that are broadcast; every block reads the written graphs once.
A search goes down the layers and ends with ``ef`` candidates, whose cosines are then taken in double precision on the original vectors;
the shards' results are merged by score.

Vectors that are null, empty or zero, or hold null or non-finite components, and rows without a vec_id take no part.  Vectors meet only those
of their own length.  Repeated rows count once; a vec_id with several vectors is a candidate by each, the best counts, and searches by
each, its results merged; it never finds itself.  Equal scores go to the smaller vec_id.  Without rows there are no results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteline.llm import store

#: Nodes of a shard, on average: one task's work and memory.
SHARD_ROWS = 1 << 14
#: Queries that are broadcast at once.
QUERY_ROWS = 1 << 16
#: Links of a node in upper layers; twice as many in the lowest.
LINKS = 16
EF_BUILD, EF_SEARCH = 96, 256
#: Nodes that enter, or queries that search, side by side; nodes that a search opens in one step.
BATCH, OPENED = 512, 4


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 as doubles.  They are first scaled by a power of two, which is exact, so that no square overflows or vanishes."""
    wide = vectors.astype(np.float64)
    _, exponent = np.frexp(np.abs(wide).max(axis=1, initial=0))
    wide = np.ldexp(wide, -exponent[:, None])
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


def levels(hashes: np.ndarray, links: int = LINKS) -> np.ndarray:
    """A node's top layer, drawn from its hash: each layer has one in ``links`` of the nodes of that below."""
    share = ((hashes >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.floor(-np.log(share) / math.log(links)).astype(np.int64)


def beam(points: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, opened: int = OPENED) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` nearest nodes that each query finds from its entry, nearest first, with their distances (1 - cosine); -1: none."""
    n, rows = len(queries), np.arange(len(queries))
    opened = min(opened, ef)
    ids = np.full((n, ef), -1, np.int64)
    dist = np.full((n, ef), np.inf, np.float32)
    done = np.ones((n, ef), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = entry, 1 - np.einsum("ij,ij->i", points[entry], queries), False
    seen = np.zeros((n, len(neighbours)), bool)
    seen[rows, entry] = True
    live = rows
    while len(live):
        open_ = np.where(done[live], np.inf, dist[live])
        pick = np.argpartition(open_, opened - 1, axis=1)[:, :opened] if opened < ef else np.tile(np.arange(ef), (len(live), 1))
        able = np.isfinite(np.take_along_axis(open_, pick, 1))
        some = able.any(axis=1)
        live, pick, able = live[some], pick[some], able[some]
        if not len(live):
            break
        at = live[:, None]
        done[at, pick] = True
        found = []
        for k in range(opened):
            near = neighbours[ids[live, pick[:, k]]]
            fresh = (near >= 0) & able[:, k, None] & ~seen[at, near]
            seen[np.broadcast_to(at, near.shape)[fresh], near[fresh]] = True
            found.append(np.where(fresh, near, -1))
        new = np.concatenate(found, axis=1)
        row, col = np.nonzero(new >= 0)
        far = np.full(new.shape, np.inf, np.float32)
        far[row, col] = 1 - np.einsum("ij,ij->i", points[new[row, col]], queries[live[row]])
        all_d = np.concatenate([dist[live], far], axis=1)
        keep = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
        dist[live] = np.take_along_axis(all_d, keep, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], new], axis=1), keep, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], new < 0], axis=1), keep, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    return np.where(np.isfinite(dist), ids, -1), dist


def chosen(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (-1: none), nearest first, those nearer to ``own`` than to any chosen before; ``most`` at most."""
    order = np.argsort(np.where(candidates < 0, np.inf, dist), axis=1, kind="stable")
    candidates, dist = np.take_along_axis(candidates, order, 1), np.take_along_axis(dist, order, 1)
    n, rows = len(own), np.arange(len(own))
    out = np.full((n, most), -1, np.int64)
    held = np.zeros((n, most, points.shape[1]), np.float32)
    count = np.zeros(n, np.int64)
    for k in range(candidates.shape[1]):
        c = candidates[:, k]
        on = rows[(c >= 0) & (count < most) & (c != own)]
        if not len(on):
            continue
        vec = points[c[on]]
        top = int(count[on].max())
        if top:
            between = 1 - np.einsum("ijk,ik->ij", held[on, :top], vec)
            between[np.arange(top)[None, :] >= count[on][:, None]] = np.inf
            good = between.min(axis=1) > dist[on, k]
            on, vec = on[good], vec[good]
        out[on, count[on]], held[on, count[on]] = c[on], vec
        count[on] += 1
    return out


def _back(points: np.ndarray, neighbours: np.ndarray, source: np.ndarray, links: np.ndarray) -> None:
    """Adds ``source`` to the lists of those it links to."""
    width = neighbours.shape[1]
    row, col = np.nonzero(links >= 0)
    to, from_ = links[row, col], source[row]
    d = 1 - np.einsum("ij,ij->i", points[to], points[from_])
    order = np.lexsort((d, to))
    to, from_, d = to[order], from_[order], d[order]
    first = np.flatnonzero(np.diff(to, prepend=-1))
    rank = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
    near = rank < width  # a node that many want at once regards the nearest of them
    to, from_, d, rank = to[near], from_[near], d[near], rank[near]
    nodes, at = np.unique(to, return_inverse=True)
    more = np.full((len(nodes), int(rank.max(initial=0)) + 1), -1, np.int64)
    more[at, rank] = from_
    old = neighbours[nodes]
    more[(more[:, :, None] == old[:, None, :]).any(axis=2)] = -1  # linked already
    room = (old >= 0).sum(axis=1) + (more >= 0).sum(axis=1) <= width
    both = np.concatenate([old, more], axis=1)
    for low in range(0, len(nodes), BATCH):
        part = slice(low, low + BATCH)
        own, held = nodes[part], both[part]
        fits = room[part]
        packed = np.take_along_axis(held, np.argsort(held < 0, axis=1, kind="stable"), 1)[:, :width]
        if not fits.all():
            over = np.flatnonzero(~fits)
            c = held[over]
            dist = 1 - np.einsum("ijk,ik->ij", points[c], points[own[over]])
            packed[over] = chosen(points, own[over], c, dist, width)
        neighbours[own] = packed


def build(points: np.ndarray, top: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, batch: int = BATCH) -> list[np.ndarray]:
    """The layers' neighbour arrays, lowest first, of unit vectors ordered by ``top`` level, highest first."""
    sizes = [int((top >= k).sum()) for k in range(int(top.max(initial=0)) + 1)]
    layers: list[np.ndarray] = [np.empty(0)] * len(sizes)
    for layer in reversed(range(len(sizes))):
        width = links * (2 if layer == 0 else 1)
        neighbours = np.full((sizes[layer], width), -1, np.int64)
        done = 1
        if layer + 1 < len(sizes):
            done = sizes[layer + 1]
            neighbours[:done, :links] = layers[layer + 1]
        while done < sizes[layer]:
            new = np.arange(done, min(sizes[layer], done + min(batch, max(1, done))))
            own = points[new]
            entry = descend(points, layers, own, layer + 1)
            ids, dist = beam(points[:done], neighbours[:done], own, entry, min(ef, done))
            among = 1 - own @ own.T
            np.fill_diagonal(among, np.inf)
            k = min(links, len(new) - 1)
            if k:
                side = np.argpartition(among, k - 1, axis=1)[:, :k]
                ids, dist = np.concatenate([ids, new[side]], axis=1), np.concatenate([dist, np.take_along_axis(among, side, 1)], axis=1)
            picked = chosen(points, new, ids, dist, links)
            neighbours[new, :links] = picked
            _back(points, neighbours, new, picked)
            done += len(new)
        layers[layer] = neighbours
    return layers


def descend(points: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, to: int) -> np.ndarray:
    """The node nearest to each query that a greedy walk finds in layer ``to``, from the top."""
    entry = np.zeros(len(queries), np.int64)
    for layer in reversed(range(to, len(layers))):
        entry = beam(points[: len(layers[layer])], layers[layer], queries, entry, 1)[0][:, 0]
    return entry


_SHARD = "dim int, shard int, ids binary, counts binary, vectors binary, sizes binary, layers binary"


def _kind(schema_type: str) -> str:
    return "<f4" if schema_type == "array<float>" else "<f8"


def _matrix(column: pa.ChunkedArray, dim: int, kind: str) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.asarray(c.flatten(), kind) for c in column.chunks)]).reshape(-1, dim)


def _shard(kind: str, links: int, ef: int):
    """A shard's nodes as one row of flat arrays."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        raw = _matrix(table.column("embedding"), dim, kind)
        hashes = table.column("hash").to_numpy().view(np.uint64)
        top = levels(hashes, links)
        order = np.lexsort((hashes, -top))
        raw, top = raw[order], top[order]
        layers = build(unit(raw).astype(np.float32), top, links, ef)
        ids = table.column("ids").combine_chunks()
        ids = [ids[int(k)].as_py() for k in order]
        flat = np.array([i for x in ids for i in x], "<i8")
        row = [key[0].as_py(), key[1].as_py(), flat.tobytes(), np.array([len(x) for x in ids], "<i4").tobytes(), raw.tobytes(), np.array([len(x) for x in layers], "<i4").tobytes(), b"".join(x.astype("<i4").tobytes() for x in layers)]
        store.trim()
        return pa.table([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), *[pa.binary()] * 5), strict=True)], [c.split()[0] for c in _SHARD.split(", ")])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    number = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    good = F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def index(vectors: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, links: int = LINKS, ef: int = EF_BUILD) -> DataFrame:
    """The written graphs of ``vectors`` (vec_id, embedding), a row a shard."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    first = usable(vectors).distinct().withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= k + 1)
    nodes = store.written(first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    n = nodes.count()
    dealt = nodes.withColumn("hash", F.xxhash64("embedding")).select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64(F.lit(1), "hash"), F.lit(store.parts(n, shard_rows))).cast("int").alias("shard"), "hash", "ids", "embedding")
    kind = _kind(dict(nodes.dtypes)["embedding"])
    out = store.written(dealt.groupBy("dim", "shard").applyInArrow(_shard(kind, links, ef), _SHARD), "graphs")
    store.delete(nodes)
    out.kind = kind
    return out


_FOUND = "query_id long, vec_id long, score double"


def _searcher(block, kind: str, links: int, k: int, ef: int):
    """Searches the shards of a partition for a broadcast block of queries; each gives a query's ``k`` best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                if dim not in block.value:
                    continue
                asked, queries = block.value[dim]
                raw = np.frombuffer(row["vectors"], kind).reshape(-1, dim)
                wide = unit(raw)
                points = wide.astype(np.float32)
                flat, at, layers = np.frombuffer(row["layers"], "<i4"), 0, []
                for layer, size in enumerate(np.frombuffer(row["sizes"], "<i4").tolist()):
                    width = links * (2 if layer == 0 else 1)
                    layers.append(flat[at : at + size * width].reshape(size, width).astype(np.int64))
                    at += size * width
                counts = np.frombuffer(row["counts"], "<i4")
                ids, starts = np.frombuffer(row["ids"], "<i8"), np.cumsum(counts) - counts
                for low in range(0, len(asked), BATCH):
                    own = queries[low : low + BATCH]
                    narrow = own.astype(np.float32)
                    found, _ = beam(points, layers[0], narrow, descend(points, layers, narrow, 1), min(ef, len(points)))
                    which, col = np.nonzero(found >= 0)
                    node = found[which, col]
                    score = np.einsum("ij,ij->i", wide[node], own[which])
                    reps = counts[node]
                    member = ids[np.repeat(starts[node] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))]
                    which, score = np.repeat(which, reps), np.repeat(score, reps)
                    other = member != asked[low : low + BATCH][which]
                    which, score, member = which[other], score[other], member[other]
                    order = np.lexsort((member, -score, which))
                    which, score, member = which[order], score[order], member[order]
                    first = np.flatnonzero(np.diff(which, prepend=-1))
                    rank = np.arange(len(which)) - np.repeat(first, np.diff(np.append(first, len(which))))
                    top = rank < k
                    yield pa.RecordBatch.from_arrays([pa.array(asked[low : low + BATCH][which[top]]), pa.array(member[top]), pa.array(score[top])], ["query_id", "vec_id", "score"])

    return store.trimmed(run)


def search(graphs: DataFrame, queries: DataFrame, k: int = 5, query_rows: int = QUERY_ROWS, links: int = LINKS, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each of ``queries`` (vec_id, embedding)."""
    spark = graphs.sparkSession
    asked = usable(queries).distinct()
    blocks = store.parts(asked.count(), query_rows)
    path = store.new_path(spark, "queries")
    asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(path)
    whole = spark.read.schema("vec_id long, embedding array<double>, block int" if graphs.kind == "<f8" else "vec_id long, embedding array<float>, block int").parquet(path)
    to = store.new_path(spark, "found")
    for b in range(blocks):
        rows = whole.filter(F.col("block") == b).select("vec_id", "embedding", F.size("embedding").alias("dim")).toArrow()  # query_rows of them
        held = {}
        for dim in set(rows.column("dim").to_pylist()):
            part = rows.filter(pc.equal(rows.column("dim"), dim))
            held[dim] = (part.column("vec_id").to_numpy(), unit(_matrix(part.column("embedding"), dim, graphs.kind)))
        shared = spark.sparkContext.broadcast(held)
        graphs.mapInArrow(_searcher(shared, graphs.kind, links, k, ef), _FOUND).write.mode("append").parquet(to)
        shared.unpersist()
    best = spark.read.schema(_FOUND).parquet(to).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(index(vectors), vectors.filter(F.col("vec_id") % 50 == 0))


QUERIES = {"op12_nearest_vectors": op12_nearest_vectors}
