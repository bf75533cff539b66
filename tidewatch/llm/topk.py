"""Exact top-k inner-product search: a KD-tree for each shard, best-first, with a kth score that is passed on."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, table

SHARD = 8192  # rows of a shard
BLOCK = 2048  # queries of a block
LEAF = 256  # rows of a leaf
CHAIN = 8  # shards that a task searches one after another
SPREAD = 64  # keys by which blocks and boxes meet
LOW = int(np.iinfo(np.int64).min)


def whole(embedding: str = "embedding", scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double; null where a component is null or not finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(fine, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Tree:
    """A KD-tree over the rows of x: median splits of the widest dimension, with the tight box of every node.

    order: rows of x, leaf after leaf, those of a leaf by id. Nodes: low and high ends of the box, start and end in
    order, left and right child (-1: a leaf). Node 0 is the root.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        low, high, self.start, self.end, self.left, self.right = [], [], [], [], [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node, own = len(low), self.order[a:b]
            low.append(x[own].min(axis=0))
            high.append(x[own].max(axis=0))
            self.start.append(a)
            self.end.append(b)
            self.left.append(-1)
            self.right.append(-1)
            if parent >= 0:
                (self.right if side else self.left)[parent] = node
            if b - a <= leaf:
                self.order[a:b] = own[np.argsort(ids[own], kind="stable")]
                continue
            half = (b - a) // 2
            self.order[a:b] = own[np.argpartition(x[own, int((high[-1] - low[-1]).argmax())], half)]
            todo += [(a, a + half, node, 0), (a + half, b, node, 1)]
        self.low, self.high = np.array(low), np.array(high)


def _dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: by doubles where these are exact, else by 64-bit integers."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if largest < 2**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def search(q: np.ndarray, q_rows: np.ndarray, floor: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each query's k best rows of a shard whose score is floor or more; where there are fewer, LOW.

    Best-first: a query has a heap of nodes by their bound, the largest inner product that a box allows. The best node is
    opened, or, if it is a leaf, its rows are scored; the query is done when the best bound is below its kth score.
    Queries that come to a leaf in the same turn share a product. A row is not a candidate of itself.
    """
    best, who = np.full((len(q), k), LOW), np.zeros((len(q), k), np.int64)
    tree = Tree(x, ids)
    bound = _dot(np.maximum(q, 0), tree.high) + _dot(np.minimum(q, 0), tree.low)
    heaps = [[(-b, 0)] for b in bound[:, 0].tolist()]
    active = range(len(q))
    while active:
        leaves = defaultdict(list)
        kth = np.maximum(best[:, -1], floor)
        for i in active:
            heap, least = heaps[i], int(kth[i])
            while heap:
                b, node = heapq.heappop(heap)
                if -b < least:
                    break
                if tree.left[node] < 0:
                    leaves[node].append(i)
                    break
                for child in (tree.left[node], tree.right[node]):
                    heapq.heappush(heap, (-int(bound[i, child]), child))
        for node, who_asks in leaves.items():
            at, own = np.array(who_asks), tree.order[tree.start[node] : tree.end[node]]
            score = _dot(q[at], x[own])
            score[rows[own][None, :] == q_rows[at][:, None]] = LOW
            score[score < kth[at][:, None]] = LOW
            some = (score > LOW).any(axis=1)
            at, score = at[some], score[some]
            if len(at):
                best[at], who[at] = _best(np.concatenate([best[at], score], axis=1), np.concatenate([who[at], np.broadcast_to(ids[own], score.shape)], axis=1), k)
        active = [i for own in leaves.values() for i in own]
    return best, who


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -np.maximum(scores, LOW + 1)), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def _packed(rows: DataFrame, key: str, per: int) -> DataFrame:
    """Rows of (vec_id, row, v) packed by parts of about `per` rows: key, dim, ids, rows, values (binary), low, high (the box)."""
    parts = max(1, -(-rows.count() // per))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["v"].to_numpy()).astype(np.int64)
        small = np.abs(v).max() < 2**31
        out = {"ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "rows": pdf["row"].to_numpy(np.int64).tobytes(), "values": v.astype(np.int32 if small else np.int64).tobytes(), "low": v.min(axis=0), "high": v.max(axis=0)}
        return pd.DataFrame({key: pdf["part"][:1], "dim": pdf["dim"][:1]} | {n: [x] for n, x in out.items()})

    rows = rows.withColumns({"part": F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"), "dim": F.size("v")})
    return rows.groupBy("part", "dim").applyInPandas(run, f"{key} int, dim int, ids binary, rows binary, values binary, low array<long>, high array<long>")


def _arrays(ids: bytes, rows: bytes, values: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, rows and values, which take 4 or 8 bytes."""
    own = np.frombuffer(ids, np.int64)
    kind = np.int32 if len(values) == 4 * dim * len(own) else np.int64
    return own, np.frombuffer(rows, np.int64), np.frombuffer(values, kind).reshape(len(own), dim)


_BOUND = "aggregate(sequence(0, dim - 1), 0D, (a, i) -> a + greatest({}))".format(", ".join(f"double(b.{x}[i]) * double(s.{y}[i])" for x in ("low", "high") for y in ("low", "high")))
_FOUND = "query_row long, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest integer inner product, ties to the smaller vec_id.

    Queries are the rows for which `query` holds, candidates all other rows of the same dimension (all k where there are
    so many). Vectors that are null, empty or have a null or non-finite component, and rows without vec_id, take no part.
    Rows that repeat a vec_id are queries and candidates each: a query_id then has as many lists of ranks, and a vec_id
    may be in a list more than once. An empty table or no query gives an empty result. Other columns are ignored.

    The queries, a stated set, meet all rows in blocks. Rows are packed into shards and queries into blocks, each with a
    box. First only boxes meet: their bounds are small rows, spread over many keys. Each block searches the shard with the
    best bound; its kth scores are the floors of the rest, and shards whose box allows less are left out for the block.
    A task then takes a block through a chain of shards, the best bound first, and passes its kth scores from each to the
    next, so that later shards open few leaves and return few rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole(scale=scale).alias("v"), query.alias("asks")).where("vec_id is not null and size(v) > 0")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    shards = materialize(_packed(rows, "shard", SHARD), "shards")
    blocks = materialize(_packed(rows.where("asks"), "block", BLOCK), "blocks")
    asking = blocks.select("block", "dim", "low", "high", F.pmod("block", F.lit(SPREAD)).alias("key"))
    asked = shards.select("shard", "dim", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("key"))
    bounds = asking.alias("b").join(asked.alias("s"), ["key", "dim"]).select("block", "dim", "shard", F.expr(_BOUND).alias("bound"))
    bounds = materialize(bounds, "bounds")
    payload = ("ids", "rows", "values")
    of = lambda df, key, side: df.select(key, "dim", *[F.col(c).alias(f"{side}_{c}") for c in payload])
    queries, held = of(blocks, "block", "q"), of(shards, "shard", "x")

    def first(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q_ids, q_rows, q = _arrays(r.q_ids, r.q_rows, r.q_values, r.dim)
                ids, own, x = _arrays(r.x_ids, r.x_rows, r.x_values, r.dim)
                best, who = search(q, q_rows, np.full(len(q), LOW), x, ids, own, k)
                found = _found(best, who, q_ids, q_rows).to_dict("records")
                yield pd.DataFrame({"block": [r.block], "dim": [r.dim], "done": [r.shard], "floor": [best[:, -1].tobytes()], "least": [int(best[:, -1].min())], "found": [found]})

    best = bounds.groupBy("block", "dim").agg(F.max(F.struct("bound", "shard"))["shard"].alias("shard"))
    seeds = queries.join(best, ["block", "dim"]).join(held, ["shard", "dim"])
    seeds = materialize(seeds.mapInPandas(first, f"block int, dim int, done int, floor binary, least long, found array<struct<{_FOUND.replace(' long', ': long')}>>"), "seeds")
    # the bound is a sum of doubles, so it has some slack
    rest = bounds.join(seeds.select("block", "dim", "done", "least"), ["block", "dim"]).where("shard <> done and bound + 1 + abs(bound) * 1e-9 >= least")
    rest = materialize(rest.select("block", "dim", F.floor(F.col("shard") / CHAIN).cast("int").alias("chain"), "shard", "bound"), "rest")
    keys = ["block", "dim", "chain"]
    chains = rest.select(*[F.col(c).alias(c) for c in keys]).distinct()
    left = queries.join(seeds.select("block", "dim", "floor"), ["block", "dim"]).join(chains, ["block", "dim"])
    right = rest.join(held, ["shard", "dim"])

    def run(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        r = own.iloc[0]
        q_ids, q_rows, q = _arrays(r.q_ids, r.q_rows, r.q_values, r.dim)
        floor = np.frombuffer(r.floor, np.int64)
        best, who = np.full((len(q), k), LOW), np.zeros((len(q), k), np.int64)
        for o in others.sort_values(["bound", "shard"], ascending=[False, True]).itertuples(index=False):
            ids, rows, x = _arrays(o.x_ids, o.x_rows, o.x_values, r.dim)
            more, names = search(q, q_rows, floor, x, ids, rows, k)
            best, who = _best(np.concatenate([best, more], axis=1), np.concatenate([who, names], axis=1), k)
            floor = np.maximum(floor, best[:, -1])
        return _found(best, who, q_ids, q_rows)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, _FOUND)
    every = found.unionByName(seeds.select(F.explode("found").alias("x")).select("x.*"))
    ranked = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", ranked).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _found(best: np.ndarray, who: np.ndarray, q_ids: np.ndarray, q_rows: np.ndarray) -> pd.DataFrame:
    at = np.nonzero(best > LOW)
    return pd.DataFrame({"query_row": q_rows[at[0]], "query_id": q_ids[at[0]], "vec_id": who[at], "score": best[at]})


def op3_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP3_SQL = """
with v as (
    select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) e from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
    select q.r, q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint score
    from v q join v c on c.r <> q.r and len(c.e) = len(q.e) where q.vec_id % 100 = 0)
select query_id, rank::int rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id) rank from s) where rank <= 10
"""
