"""Communities by modularity, as rounds of DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.graph import Rounds, edge_weights

PART = 50_000  # edges of a task: rows are few bytes and much work, so a round would be one task by its bytes


def communities(edges: DataFrame, resolution: float = 1.0, least: int = 3) -> DataFrame:
    """id, community (its smallest id), index (from 0: by size, largest first, then by name) of communities of at least
    `least` nodes.

    Louvain: nodes move to the neighbouring community with the largest gain of modularity until no round raises it, then
    each community becomes one node of a smaller graph, until no node of that moves. All nodes move at once; in even
    rounds only to smaller names, in odd ones only to larger, so that two never change places. A round is one
    join and one partially aggregated sum over the edges; no task sees a whole community.
    """
    rounds = Rounds(edges.sparkSession)
    w = rounds.write(edge_weights(edges), "weights")
    # numbers that rise with the names stand for them in the rounds
    ids = rounds.write(w.select(F.explode(F.array("a", "b")).alias("name")).distinct().orderBy("name").withColumn("n", F.monotonically_increasing_id()), "ids")
    a, b = (ids.select(F.col("name").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    w = w.join(a, "a").join(b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), "weight")
    graph = rounds.write(w.select(F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b"), "weight") for x, y in ("ab", "ba")])).alias("e")).select("e.*"), "graph")
    total = graph.agg(F.sum("weight")).first()[0]
    name = graph.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id"))
    while total:
        label = _moves(graph, float(total), resolution, rounds)
        if label is None:
            break
        name = rounds.write(name.join(label.select(F.col("id").alias("community"), F.col("community").alias("new")), "community").select("id", F.col("new").alias("community")), "name")
        a, b = (label.select(F.col("id").alias(x), F.col("community").alias(f"c{x}")) for x in "ab")
        graph = rounds.write(graph.join(a, "a").join(b, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight")), "graph")
    low = name.groupBy("community").agg(F.min("id").alias("name"), F.count("*").alias("members")).where(F.col("members") >= least)
    # one row for each size: how many communities are larger
    before = low.groupBy("members").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy(F.desc("members")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = low.join(before.select("members", "before"), "members").withColumn("index", F.col("before") + F.row_number().over(Window.partitionBy("members").orderBy("name")) - 1)
    own = ranked.join(ids.select(F.col("n").alias("name"), F.col("name").alias("called")), "name").select("community", "called", F.col("index").cast("long").alias("index"))
    return name.join(own, "community").join(ids, F.col("id") == F.col("n")).select(F.col("name").alias("id"), F.col("called").alias("community"), "index")


def _moves(graph: DataFrame, total: float, resolution: float, rounds: Rounds) -> DataFrame | None:
    """id, community after all rounds that raise modularity; null if none does."""
    loops, rows = graph.agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight"))), F.lit(0)), F.count("*")).first()
    parts = 1 + rows // PART
    label = graph.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("k")).withColumn("community", F.col("id"))
    state = _picks(graph, label, total, resolution, parts, rounds)
    (best, *waiting), r, quiet, changed = _rated(state, loops, total, resolution), 0, 0, False
    while quiet < 2:  # neither moves down nor moves up are left
        way, kept = r % 2, False
        r += 1
        if waiting[way]:
            go = F.coalesce(F.col("new") < F.col("community") if way == 0 else F.col("new") > F.col("community"), F.lit(False))
            tried = _picks(graph, state.select("id", "k", F.when(go, F.col("new")).otherwise(F.col("community")).alias("community")), total, resolution, parts, rounds)
            value, *left = _rated(tried, loops, total, resolution)
            kept = value > best + 1e-9
            if kept:
                state, best, waiting, changed = tried, value, left, True
            else:
                rounds.drop("picks")
        quiet = 0 if kept else quiet + 1
    return state.select("id", "community") if changed else None


def _picks(graph: DataFrame, label: DataFrame, total: float, resolution: float, parts: int, rounds: Rounds) -> DataFrame:
    """id, k, community, new (where it gains most by going to, if anywhere), inside (weight of its links in its community).

    What a node does next and what its place is worth come from the same sums, so a round reads the edges once, and a
    direction that is tried in vain leaves them for the other.
    """
    size = label.groupBy("community").agg(F.sum("k").alias("sigma"))
    held = label.join(size, "community").repartition(parts, "id")
    other = held.select(F.col("id").alias("b"), F.col("community").alias("there"), F.col("sigma").alias("theirs"))
    near = graph.where("a <> b").repartition(parts, "b").join(other, "b")
    near = near.groupBy("a", "there").agg(F.sum("weight").alias("links"), F.max("theirs").alias("theirs"))
    here = F.col("there") == F.col("community")
    gain = F.round(F.col("links") - resolution * F.col("k") * F.when(here, F.col("theirs") - F.col("k")).otherwise(F.col("theirs")) / total, 9)
    alone = F.round(-resolution * F.col("k") * (F.col("sigma") - F.col("k")) / total, 9)
    once = [F.first(c).alias(c) for c in ("k", "community", "sigma")]
    near = near.repartition(parts, "a")
    picked = held.join(near, F.col("id") == F.col("a"), "left").groupBy("id").agg(
        *once, F.min_by("there", F.struct((-gain).alias("g"), "there")).alias("best"), F.max(F.when(here, gain)).alias("stay"), F.max(gain).alias("top"), F.sum(F.when(here, F.col("links"))).alias("inside"))
    return rounds.write(picked.select("id", "k", "community", F.when(F.col("top") > F.coalesce("stay", alone), F.col("best")).alias("new"), "inside"), "picks")


def _rated(state: DataFrame, loops: int, total: float, resolution: float) -> tuple[float, int, int]:
    """Modularity, and how many nodes would go to smaller and to larger names."""
    sums = state.groupBy("community").agg(F.sum("k").alias("s"), F.sum("inside").alias("inside"), F.count_if(F.col("new") < F.col("community")).alias("down"), F.count_if(F.col("new") > F.col("community")).alias("up"))
    row = sums.agg(F.sum("inside"), F.sum(F.col("s").cast("double") * F.col("s")), F.sum("down"), F.sum("up")).first()
    return (loops + (row[0] or 0)) / total - resolution * (row[1] or 0) / total**2, row[2] or 0, row[3] or 0


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """community, n, cohesion: weight inside over the number of pairs."""
    a, b = (members.select(F.col("id").alias(x), F.col("community").alias(f"c{x}")) for x in "ab")
    inside = edge_weights(edges).join(a, "a").join(b, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("w"))
    size = members.groupBy("community").agg(F.count("*").alias("n"))
    return size.join(inside, "community", "left").select("community", "n", F.round(F.coalesce("w", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2), 6).alias("cohesion"))
