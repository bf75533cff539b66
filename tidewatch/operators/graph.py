"""The property graph: events to nodes and edges, components, rings, paths, communities and merges."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def node(kind: str, node_id: str | Column, when: Column | None = None) -> Column:
    own = F.col(node_id) if isinstance(node_id, str) else node_id
    null = F.lit(None).cast("string")
    out = F.struct(
        F.lit("upsert_node").alias("op"), F.lit(kind).alias("node_kind"), own.alias("node_id"), null.alias("edge_kind"), null.alias("src_kind"), null.alias("src_id"), null.alias("dst_kind"), null.alias("dst_id"),
        F.lit(None).cast("map<string,string>").alias("properties"),
    )
    return F.when(own.isNotNull() if when is None else own.isNotNull() & when, out)


def edge(kind: str, src_kind: str, src: str | Column, dst_kind: str | Column, dst: str | Column, when: Column | None = None, **properties: Column) -> Column:
    """An edge where both ends are there and `when` holds, with those of its properties that are there, as text."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (src, dst))
    null = F.lit(None).cast("string")
    to = F.lit(dst_kind) if isinstance(dst_kind, str) else dst_kind
    given = [x for k, v in properties.items() for x in (F.lit(k), v.cast("string"))]
    held = F.map_filter(F.create_map(*given), lambda k, v: v.isNotNull()) if given else F.lit(None)
    out = F.struct(
        F.lit("upsert_edge").alias("op"), null.alias("node_kind"), null.alias("node_id"), F.lit(kind).alias("edge_kind"), F.lit(src_kind).alias("src_kind"), a.alias("src_id"), to.alias("dst_kind"), b.alias("dst_id"),
        held.cast("map<string,string>").alias("properties"),
    )
    fine = a.isNotNull() & b.isNotNull()
    return F.when(fine if when is None else fine & when, out)


def operations(events: DataFrame, *ops: Column) -> DataFrame:
    """event_id, ts_ms, ordinal and the graph operations of each event, one row each; a map-only plan."""
    every = F.array_compact(F.array(*ops))
    return events.select("event_id", "ts_ms", F.posexplode(every).alias("ordinal", "x")).select("event_id", "ts_ms", "ordinal", "x.*")


def voice_operations(voice: DataFrame) -> DataFrame:
    """Both numbers; CALLED on call_start; the device and USED where there is an imei."""
    start = F.col("kind") == "call_start"
    return operations(voice, node("Number", "caller"), node("Number", "callee"), edge("CALLED", "Number", "caller", "Number", "callee", start), node("Device", "imei"), edge("USED", "Number", "caller", "Device", "imei"))


def sms_operations(sms: DataFrame) -> DataFrame:
    """Both numbers; SMSED, with the template, for messages sent or delivered."""
    return operations(sms, node("Number", "sender"), node("Number", "recipient"), edge("SMSED", "Number", "sender", "Number", "recipient", F.col("kind").isin("mt", "mo"), template_hash=F.col("template_hash")))


def looks_like_ip(value: Column) -> Column:
    return value.contains(":") | value.rlike(r"^\d+(\.\d+){3}$")


def data_operations(data: DataFrame) -> DataFrame:
    """QUERIED a domain; RESOLVED_TO an address on responses; CONNECTED to the domain, else the address, on sessions, with
    its bytes (0 where unknown). Empty names count as none."""
    named = data.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("msisdn", "domain", "rdata")})
    dns = F.col("kind").isin("dns_query", "dns_response")
    ip = (F.col("kind") == "dns_response") & F.col("domain").isNotNull() & looks_like_ip(F.col("rdata"))
    session = F.col("kind") == "ipdr_session"
    direct = session & F.col("msisdn").isNotNull() & F.col("domain").isNull()
    size = {c: F.coalesce(c, F.lit(0)) for c in ("bytes_up", "bytes_down")}
    return operations(
        named, node("Number", "msisdn"), node("Domain", "domain"), edge("QUERIED", "Number", "msisdn", "Domain", "domain", dns),
        node("IPEndpoint", "rdata", ip), edge("RESOLVED_TO", "Domain", "domain", "IPEndpoint", "rdata", ip), edge("CONNECTED", "Number", "msisdn", "Domain", "domain", session, **size),
        node("IPEndpoint", "rdata", direct), edge("CONNECTED", "Number", "msisdn", "IPEndpoint", "rdata", direct, **size),
    )


def momo_operations(momo: DataFrame) -> DataFrame:
    """Wallets and owners; SENT between wallets but for reversals and cash-ins; else CASHED_OUT_TO a bank account."""
    both = F.col("sender_wallet").isNotNull() & F.col("recipient_wallet").isNotNull()
    send = both & ~F.col("kind").isin("reversal", "cash_in")
    account = ~send & F.col("counterparty_kind").isin("bank", "external")
    return operations(
        momo, node("Wallet", "sender_wallet"), node("Wallet", "recipient_wallet"), edge("OWNS", "Number", "sender_msisdn", "Wallet", "sender_wallet"),
        edge("OWNS", "Number", "recipient_msisdn", "Wallet", "recipient_wallet"), edge("SENT", "Wallet", "sender_wallet", "Wallet", "recipient_wallet", send),
        node("Account", "account_hash", account), edge("CASHED_OUT_TO", "Wallet", "sender_wallet", "Account", "account_hash", account),
    )


def mutations(ops: DataFrame) -> DataFrame:
    """Operations as records with an id of their own and the key that orders them."""
    return ops.select(F.concat(F.lit("gm_"), F.substring(F.col("event_id").cast("string"), 1, 32), F.lit("_"), F.col("ordinal")).alias("mutation_id"), F.coalesce("node_id", "src_id", F.col("event_id").cast("string")).alias("key"), "op", F.coalesce("node_kind", "edge_kind").alias("kind"))


def latest_nodes(ops: DataFrame) -> DataFrame:
    """kind, id and last time of each node."""
    return ops.where("op = 'upsert_node'").groupBy(F.col("node_kind").alias("kind"), F.col("node_id").alias("id")).agg(F.max("ts_ms").alias("last_ms"))


def distinct_edges(ops: DataFrame) -> DataFrame:
    return ops.where("op = 'upsert_edge'").select(F.col("edge_kind").alias("kind"), "src_kind", "src_id", "dst_kind", "dst_id", "ts_ms").dropDuplicates(["kind", "src_id", "dst_id", "ts_ms"])


def undirected(edges: DataFrame) -> DataFrame:
    """a < b: distinct pairs that are linked in either direction."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    pairs = undirected(edges)
    both = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id")))
    return both.groupBy("id").agg(F.count("*").alias("degree"))


def edge_weights(edges: DataFrame) -> DataFrame:
    """Number of relations of each undirected pair."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("weight")).where("a <> b")


LEAST = 50_000  # links from which on another task is worth it


class Rounds:
    """Tables of a loop, written as Parquet in the shared folder (spark.checkpoint.dir) so that lineage is cut and a lost
    executor costs its running tasks only. Each name has two places, written in turn, so old rounds take no room."""

    def __init__(self, spark):
        self.spark, self.turn = spark, {}
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:  # as in tests
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="tidewatch-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.path = f"{base}/rounds-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        turn = self.turn[name] = 1 - self.turn.get(name, 1)
        path = f"{self.path}/{name}-{turn}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """The last table of this name is not wanted: the next takes its place, and the one before stays."""
        self.turn[name] = 1 - self.turn[name]


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable over (src, dst) links; ids without links to others are absent.

    Alternating large-star and small-star steps until nothing changes. Each is a partially aggregated minimum and an equi
    join, so a hub with very many neighbours is pre-aggregated in the first and split by the skew join in the second. The
    number of rounds grows with the logarithm of the longest chain. Few links, of which no round makes more, go to few
    tasks, with at most some LEAST each, however many partitions a shuffle has.
    """
    rounds = Rounds(edges.sparkSession)
    pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    pairs = rounds.write(pairs, "links")
    mark = _mark(pairs)
    while mark[0]:
        tasks = max(edges.sparkSession.sparkContext.defaultParallelism, 2 * mark[0] // LEAST)  # links stand in both directions
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").coalesce(tasks)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        pairs = rounds.write(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(tasks), "links")
        old, mark = mark, _mark(pairs)
        if mark == old:
            break
    own = pairs.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own).distinct()


def _mark(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38, 0))"))).first()
    return row[0], row[1]


def rings(members: DataFrame, used: DataFrame, sent: DataFrame, motifs: DataFrame, least: int = 3) -> DataFrame:
    """Components of at least `least` members with their shared devices, sends, motifs and composite score.

    members: id, component; used: src (number), dst (device); sent: src, dst; motifs: id of a member and the motif.
    """
    size = members.groupBy("component").agg(F.count("*").alias("members")).where(F.col("members") >= least)
    shared = used.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("src")).where("n > 1")
    devices = shared.join(members, F.col("src") == F.col("id")).groupBy("component").agg(F.count("*").alias("devices"))
    flows = sent.select("src", "dst").distinct().join(members, F.col("src") == F.col("id")).groupBy("component").agg(F.count("*").alias("flows"))
    kinds = motifs.join(members, "id").groupBy("component").agg(F.count_distinct("motif").alias("motifs"))
    out = size.join(devices, "component", "left").join(flows, "component", "left").join(kinds, "component", "left").na.fill(0)
    score = F.least(F.lit(0.3), 0.05 * F.col("members")) + F.least(F.lit(0.3), 0.1 * F.col("devices")) + F.least(F.lit(0.2), 0.05 * F.col("flows")) + F.least(F.lit(0.4), 0.15 * F.col("motifs"))
    return out.withColumn("score", F.round(F.least(F.lit(0.99), score), 6))


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """id, hops: nodes within depth undirected hops of any seed; seeds are 0 away. One join a hop, the visited left out."""
    pairs = undirected(edges)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = front = seeds.select("id").distinct().withColumn("hops", F.lit(0))
    for d in range(1, depth + 1):
        near = front.join(both, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        front = near.join(seen, "id", "left_anti").withColumn("hops", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def _passed_by_all(walks: DataFrame, total: DataFrame) -> DataFrame:
    """seed, id, via: the nodes that all walks to id pass; walks: a row for each walk and node on it, total: their number n."""
    return walks.groupBy("seed", "id", "via").agg(F.count("*").alias("c")).join(total, ["seed", "id"]).where("c = n").select("seed", "id", "via")


def flow_links(edges: DataFrame, seeds: DataFrame, depth: int = 4) -> DataFrame:
    """seed, src, dst, hop: the links on simple directed paths of at most `depth` edges from each seed.

    hop: how many edges from the seed the link is, at least. A link x -> y is on such a path if x is reached in fewer than
    `depth` edges by a walk that does not pass y. So no path is listed: layer by layer, each reached node keeps the nodes
    that all walks to it pass (as many as the layer's number at most, with itself), and an edge is looked at once a layer.
    Loops do not count; a seed that sends nothing has no links.
    """
    out = Rounds(edges.sparkSession)
    hop = out.write(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct(), "hops")
    start = seeds.where("id is not null").select(F.col("id").alias("seed"), "id").distinct()
    layer = out.write(start.withColumn("via", F.col("id")), "layer0")
    layers = [layer]
    for d in range(1, depth):
        step = layer.join(hop, F.col("id") == F.col("src")).select("seed", "src", F.col("dst").alias("id"), "via")
        came = step.select("seed", "src", "id").distinct()
        passed = _passed_by_all(step, came.groupBy("seed", "id").agg(F.count("*").alias("n")))
        own = came.select("seed", "id").distinct().withColumn("via", F.col("id"))
        layer = out.write(passed.unionByName(own).distinct(), f"layer{d}")
        layers.append(layer)
    every = reduce(DataFrame.unionByName, [x.withColumn("hop", F.lit(d + 1)) for d, x in enumerate(layers)])
    reached = every.select("seed", "id", "hop").distinct().groupBy("seed", "id").agg(F.count("*").alias("n"), F.min("hop").alias("hop"))
    barred = _passed_by_all(every.select("seed", "id", "via"), reached.select("seed", "id", "n"))
    links = reached.join(hop, F.col("id") == F.col("src")).select("seed", "src", "dst", "hop")
    return links.join(barred.select("seed", F.col("id").alias("src"), F.col("via").alias("dst")), ["seed", "src", "dst"], "left_anti")


def fund_flow(edges: DataFrame, seeds: DataFrame, depth: int = 4) -> DataFrame:
    """Totals of the distinct links on paths from the seeds: src, dst, amount_minor, n."""
    links = flow_links(edges, seeds, depth).select("src", "dst").distinct()
    return edges.join(links, ["src", "dst"]).groupBy("src", "dst").agg(F.sum("amount_minor").alias("amount_minor"), F.count("*").alias("n"))


def largest_flows(edges: DataFrame, seeds: DataFrame, depth: int = 4, most: int = 200) -> DataFrame:
    """seed, rank, src, dst, kind, amount_minor, n, hop: each seed's `most` links nearest to it, then largest, then by name.

    edges have kind, of which a link has the smallest. The links of a seed are cut in parts before they are ranked.
    """
    links = flow_links(edges, seeds, depth)
    totals = edges.groupBy("src", "dst").agg(F.min("kind").alias("kind"), F.sum("amount_minor").alias("amount_minor"), F.count("*").alias("n"))
    own = links.join(totals, ["src", "dst"])
    for key in ([F.col("seed"), F.pmod(F.xxhash64("src", "dst"), F.lit(64))], [F.col("seed")]):
        place = F.row_number().over(Window.partitionBy(*key).orderBy("hop", F.desc("amount_minor"), "src", "dst"))
        own = own.withColumn("rank", place).where(F.col("rank") <= most)
    return own.select("seed", "rank", "src", "dst", "kind", "amount_minor", "n", "hop")


def identifier_hash(kind: Column, value: Column, salt: str = "salt") -> Column:
    """Salted digest by which operators compare identifiers; devices keep 16 hex digits."""
    full = F.sha2(F.concat_ws("|", F.lit(salt), kind, value), 256)
    return F.when(kind == "Device", F.substring(full, 1, 16)).otherwise(full)


def ring_exits(edges: DataFrame, members: DataFrame, salt: str = "salt") -> DataFrame:
    """Numbers and wallets outside a ring that its members send to: ring, kind, hash, once each."""
    out = edges.where("edge_kind in ('SENT', 'CASHED_OUT_TO') and dst_kind in ('Number', 'Wallet')")
    out = out.join(members.select("ring", F.col("id").alias("src_id")), "src_id")
    out = out.join(members.select("ring", F.col("id").alias("dst_id")), ["ring", "dst_id"], "left_anti")
    return out.select("ring", F.col("dst_kind").alias("kind"), identifier_hash(F.col("dst_kind"), F.col("dst_id"), salt).alias("hash")).distinct()


def cross_operator(exits: DataFrame, flags: DataFrame) -> DataFrame:
    """Rings whose exits other operators have flagged: peers, hits, mean confidence and the lift of the score."""
    hit = exits.join(flags, exits["hash"] == flags["identifier_hash"])
    out = hit.groupBy("ring").agg(F.count_distinct("peer").alias("peers"), F.count("*").alias("hits"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return out.withColumn("lift", F.round(F.least(F.lit(0.4), 0.1 * F.col("peers")) + F.least(F.lit(0.2), 0.05 * F.col("mean_confidence")), 6))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node for each hash of several operators' nodes: 'multi' where two or more contribute."""
    out = nodes.groupBy("identifier_hash").agg(F.min_by("kind", "opco").alias("kind"), F.max("risk_score").alias("risk_score"), F.array_sort(F.collect_set("opco")).alias("contributors"))
    return out.select("identifier_hash", "kind", "risk_score", F.array_join("contributors", ",").alias("contributors"), F.when(F.size("contributors") > 1, "multi").otherwise(F.get("contributors", F.lit(0))).alias("opco"))


def seams(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends belong to different operators."""
    a = nodes.select(F.col("identifier_hash").alias("src_hash"), F.col("opco").alias("src_opco"))
    b = nodes.select(F.col("identifier_hash").alias("dst_hash"), F.col("opco").alias("dst_opco"))
    return edges.join(a, "src_hash").join(b, "dst_hash").where("src_opco <> dst_opco")
