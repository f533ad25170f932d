"""Deleted interpolation: a bigram model mixed by context-frequency buckets.

A token's probability after context v is

    l2 c(v w) / c(v)  +  l1 c(w) / N  +  l0 / (V + 1)

with maximum-likelihood estimates from counts over all training documents.  The
weights (l2, l1, l0) belong to the bucket of c(v), its binary order of
magnitude.  They are learned by expectation-maximisation: part of the training
documents (the held-out counts) is deleted from the counts, and the weights are those
that make it likeliest.  Held-out tokens enter EM through a grid of (bucket, estimates)
whose cells keep exact counts and the mean logarithms of their estimates, so that
what the driver gets is bounded by the grid while all held-out tokens count.

Tokens are lower-cased (A-Z) words, then one end for each text; the first context is
a start mark.  Counts are exact but for collisions of 63-bit hashes.  A null text is
empty (its end alone).  Repeated rows count as often as they are given.  With nothing to learn
from, N is 0 and the model is uniform over V + 1 = 1 tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteline.llm import blocks, store
from siteline.llm import text as T

END, BEGIN = np.uint64(0x3C6EF372FE94F82A), np.uint64(0xA54FF53A5F1D36F0)
BUCKETS = 28
LEVELS = 96  #: of each estimate in the grid, two for each binary order of magnitude; 0 is a zero
EM_STEPS = 60
LEAST_WEIGHT = 1e-6
DEFAULT = (0.5, 0.4, 0.1)


@dataclass
class Model:
    tokens: int  #: N
    types: int  #: V
    weights: np.ndarray  #: BUCKETS x 3, for c(v) in [2**(b - 1), 2**b); bucket 0 is c(v) = 0


def bucket_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(float))[1], BUCKETS - 1)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token keys of all texts, each text's words and its end, and the texts' bounds."""
    parts, sizes = [], []
    for w in T.words(texts, lower=True):
        out = np.empty(len(w.hashes) + w.n_docs, np.uint64)
        out[np.arange(len(w.hashes)) + w.doc] = w.hashes
        out[w.bounds[1:] + np.arange(w.n_docs)] = END
        parts.append(out)
        sizes.append(w.counts + 1)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return flat & ~np.uint64(1), np.concatenate([[0], *(np.cumsum(np.concatenate(sizes)),)] if sizes else [[0]]).astype(np.int64)


def pairs(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context of each token and the key of the pair (odd, so that it is never a token's)."""
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[bounds[:-1]] = BEGIN
    return before, T.mix(before * np.uint64(0x9E3779B97F4A7C15) + flat) | np.uint64(1)


def _keys(flat: np.ndarray, before: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys (tokens, start mark and pairs), and where each token, context and pair is among them."""
    n = len(flat)
    keys, back = np.unique(np.concatenate([[BEGIN], flat, both]), return_inverse=True)
    token = back[1 : n + 1]
    context = np.empty(n, np.int64)
    context[1:] = token[:-1]
    context[before == BEGIN] = back[0]
    return keys, token, context, back[n + 1 :]


REPLY = "block int, shard int, held boolean, kept binary, total binary, n int, tokens long, types long, kept_tokens long, kept_types long"
_REPLY = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("held", pa.bool_()), ("kept", pa.binary()), ("total", pa.binary()), ("n", pa.int32()), *((x, pa.int64()) for x in ("tokens", "types", "kept_tokens", "kept_types"))])


def _counts(docs: DataFrame, n_shards: int) -> DataFrame:
    """Answers for each block: total and retained counts of its keys, and by shard the sizes of the model."""

    def send(packed: pa.Table) -> pa.Table:
        table = blocks.opened(packed)
        flat, bounds = tokens(table.column("text"))
        before, both = pairs(flat, bounds)
        keys, token, context, pair = _keys(flat, before, both)
        sizes = np.diff(bounds)
        role = table.column("role").to_numpy()  # 0 retained, 1 held out for the weights, 2 not learned from
        by_token = np.repeat(role, sizes)
        begin = int(np.searchsorted(keys, BEGIN))
        counts = []
        for r in (0, 1):
            c = np.bincount(token[by_token == r], minlength=len(keys)) + np.bincount(pair[by_token == r], minlength=len(keys))
            c[begin] = int((role == r).sum())
            counts.append(c)
        seen = np.zeros(len(keys), bool)  # by held-out documents of the block
        seen[token[by_token == 1]] = seen[pair[by_token == 1]] = True
        seen[begin] = bool((role == 1).any())
        block, out = packed.column("block")[0].as_py(), []
        for shard, at in blocks.cuts(keys, n_shards):
            out.append((shard, block, blocks.pack_keys(keys[at]), np.packbits(seen[at]).tobytes(), blocks.pack(counts[0][at]), blocks.pack(counts[1][at])))
        cols = list(zip(*out, strict=True))
        return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.int32()] * 2 + [pa.binary()] * 4, strict=True)], ["shard", "block", "keys", "seen", "kept", "held"])

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        chunks = [blocks.unpack_keys(r["keys"]) for r in rows]
        keys, back = np.unique(np.concatenate(chunks), return_inverse=True)
        sums = [np.bincount(back, np.concatenate([blocks.unpack(r[c], len(k)) for r, k in zip(rows, chunks, strict=True)]), len(keys)).astype(np.int64) for c in ("kept", "held")]
        kept, total = sums[0], sums[0] + sums[1]
        is_token = ((keys & np.uint64(1)) == 0) & (keys != BEGIN)
        shard = rows[0]["shard"]
        sizes = [int(total[is_token].sum()), int((total[is_token] > 0).sum()), int(kept[is_token].sum()), int((kept[is_token] > 0).sum())]
        out, at = [(-1, shard, False, b"", b"", 0, *sizes)], 0
        for r, k in zip(rows, chunks, strict=True):
            own, at = back[at : at + len(k)], at + len(k)
            seen = np.unpackbits(np.frombuffer(r["seen"], np.uint8))[: len(k)].astype(bool)
            for held in (False, True):
                some = own[seen == held]
                if len(some):
                    out.append((r["block"], shard, held, blocks.pack(kept[some]) if held else b"", blocks.pack(total[some]), len(some), 0, 0, 0, 0))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _REPLY, strict=True)], schema=_REPLY)

    sent = docs.groupBy("block").applyInArrow(send, "shard int, block int, keys binary, seen binary, kept binary, held binary")
    return sent.groupBy("shard").applyInArrow(answer, REPLY)


def _joined(replies: pa.Table, column: str) -> np.ndarray:
    order = np.argsort(replies.column("shard").to_numpy(), kind="stable")
    raw, n = replies.column(column), replies.column("n")
    parts = [blocks.unpack(raw[i].as_py(), n[i].as_py()) for i in order.tolist()]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _level(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.clip(1 + np.floor(-2 * np.log2(np.where(x > 0, x, 1))), 1, LEVELS - 1), 0).astype(np.int64)


def _grid(docs: DataFrame, replies: DataFrame, kept_tokens: int) -> DataFrame:
    """Held-out tokens by cell: cell, n, sums of the estimates' logarithms."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("cell", pa.int64()), ("n", pa.int64()), ("log2", pa.float64()), ("log1", pa.float64())])
        if not docs.num_rows:
            return schema.empty_table()
        docs = blocks.opened(docs)
        flat, bounds = tokens(docs.column("text"))
        before, both = pairs(flat, bounds)
        _, token, context, pair = _keys(flat, before, both)
        count = _joined(replies, "kept")
        cv, cw, cvw = count[context], count[token], count[pair]
        f2 = cvw / np.maximum(cv, 1)
        f1 = cw / max(kept_tokens, 1)
        cell = (bucket_of(cv) * LEVELS + _level(f2)) * LEVELS + _level(f1)
        cells, back = np.unique(cell, return_inverse=True)
        logs = [np.bincount(back, np.log(np.where(f > 0, f, 1)), len(cells)) for f in (f2, f1)]
        return pa.table([pa.array(cells), pa.array(np.bincount(back, minlength=len(cells))), pa.array(logs[0]), pa.array(logs[1])], schema=schema)

    made = docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, "cell long, n long, log2 double, log1 double")
    return made.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("log2").alias("log2"), F.sum("log1").alias("log1"))


def learn_weights(grid: list[tuple[int, int, float, float]], types: int) -> np.ndarray:
    """EM over the cells of each bucket; a bucket without tokens takes the weights of the next one below."""
    weights = np.empty((BUCKETS, 3))
    cells = np.array(grid, float).reshape(-1, 4)
    bucket = (cells[:, 0] // LEVELS**2).astype(int)
    last = np.array(DEFAULT)
    for b in range(BUCKETS):
        own = cells[bucket == b]
        if len(own):
            level = own[:, 0].astype(int)
            n = own[:, 1]
            f2 = np.where(level // LEVELS % LEVELS > 0, np.exp(own[:, 2] / n), 0)
            f1 = np.where(level % LEVELS > 0, np.exp(own[:, 3] / n), 0)
            f = np.stack([f2, f1, np.full(len(own), 1 / (types + 1))], 1)
            last = np.full(3, 1 / 3)
            for _ in range(EM_STEPS):
                share = f * last
                last = (n[:, None] * share / share.sum(1, keepdims=True)).sum(0) / n.sum()
        weights[b] = last
    weights[0, 0] = 0  # an unseen context has no estimate
    weights[:, 1:] = np.maximum(weights[:, 1:], LEAST_WEIGHT)
    return weights / weights.sum(1, keepdims=True)


def _score(docs: DataFrame, replies: DataFrame, m: Model) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        docs = blocks.opened(docs)
        flat, bounds = tokens(docs.column("text"))
        before, both = pairs(flat, bounds)
        keys, token, context, pair = _keys(flat, before, both)
        held = np.repeat(docs.column("role").to_numpy() == 1, np.diff(bounds))
        seen = np.zeros(len(keys), bool)
        seen[token[held]] = seen[pair[held]] = True
        seen[np.searchsorted(keys, BEGIN)] = bool(held.any())
        flags = replies.column("held").to_numpy(zero_copy_only=False)
        count = np.empty(len(keys), np.int64)
        count[seen], count[~seen] = _joined(replies.filter(pa.array(flags)), "total"), _joined(replies.filter(pa.array(~flags)), "total")
        cv, cw, cvw = count[context], count[token], count[pair]
        w = m.weights[bucket_of(cv)]
        p = w[:, 0] * cvw / np.maximum(cv, 1) + w[:, 1] * cw / max(m.tokens, 1) + w[:, 2] / (m.types + 1)
        base = np.log10((cw + 0.5) / (m.tokens + 0.5 * (m.types + 1)))
        cols = [docs.column("doc_id"), np.diff(bounds), T.per_doc(cw > 0, bounds), np.add.reduceat(base, bounds[:-1]), np.add.reduceat(np.log10(p), bounds[:-1])]
        return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], schema=schema)

    return docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, learn: Column, held: Column) -> DataFrame:
    """The log10 probabilities of every text of ``docs`` (doc_id, text).

    ``learn`` marks the rows to learn from, ``held`` those of them whose counts are held out for the weights;
    both depend on doc_id alone.
    """
    spark = docs.sparkSession
    size = store.text_bytes(docs)
    n_blocks, n_shards = store.parts(size), store.parts(size // 5, blocks.SHARD_KEYS)
    role = F.when(~F.coalesce(learn, F.lit(False)), 2).when(F.coalesce(held, F.lit(False)), 1).otherwise(0)
    roles = docs.select("doc_id", "text", role.alias("role"))
    dealt = blocks.blocked(roles, n_blocks)
    replies = store.written(_counts(dealt, n_shards), "lm")
    blocks.free(spark)
    sizes = replies.filter("block < 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "kept_tokens", "kept_types"))).first()
    own = replies.filter("block >= 0").select("block", "shard", "held", "kept", "total", "n")
    grid = _grid(blocks.blocked(roles.filter("role = 1"), n_blocks), own.filter("held"), sizes["kept_tokens"]).collect()  # BUCKETS * LEVELS**2 rows at most
    m = Model(sizes["tokens"], sizes["types"], learn_weights([tuple(r) for r in grid], sizes["kept_types"]))
    blocks.free(spark)
    return _score(dealt, own, m).withColumn("train_tokens", F.lit(m.tokens))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = store.fold()
    out = score(store.documents(spark, sf_dir), fold != 1, fold == 0)
    return out.select("doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op1_lm_interpolation": query}
