"""Hand cases with exact expectations."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import agents, communities, content, features, graph, ingest, learned, motifs, names, policy, scoring, serving

M, H, D = 60_000, 3_600_000, 86_400_000
VOICE = "event_id long, caller string, callee string, kind string, imei string, ts_ms long"
SMS = "event_id long, sender string, recipient string, kind string, template_hash string, ts_ms long"
DATA = "event_id long, msisdn string, kind string, domain string, bytes_up long, bytes_down long, ts_ms long"
SENT = "edge_id long, src string, dst string, ts_ms long, amount_minor long"


def numbers(spark, voice=(), sms=(), data=(), **kw):
    events = features.number_events(spark.createDataFrame(list(voice), VOICE), spark.createDataFrame(list(sms), SMS), spark.createDataFrame(list(data), DATA))
    return {r["event_id"]: r for r in features.number_features(events, **kw).collect()}


def test_velocity_and_fanout(spark):
    out = numbers(spark, [(i, "A", f"B{i}", "call_start", None, 1_000_000 + i * 30_000) for i in range(18)])
    assert (out[17]["velocity_1h"], out[17]["fanout_1h"]) == (18, 18) and out[17]["velocity_5m"] >= 8


def test_boundaries(spark):
    out = numbers(spark, [(0, "A", "B", "call_start", "i", 0), (1, "A", "C", "call_start", "j", H)])
    assert (out[1]["velocity_1h"], out[1]["fanout_1h"], out[1]["velocity_1m"], out[1]["imei_count"]) == (2, 1, 1, 2)
    assert numbers(spark, [(0, "A", "B", "call_start", None, 0), (1, "A", "C", "call_start", None, 2 * H)])[1]["velocity_1h"] == 1


def test_template_top_ties_go_to_the_first(spark):
    out = numbers(spark, sms=[(i, "A", "B", "mt", t, i * 1000) for i, t in enumerate(["z", "a", "a", "z"])])
    assert out[3]["sms_template_top"] == "z" and out[2]["sms_template_top"] == "a" and out[3]["sms_freq_1h"] == 4


def test_domains_and_volume(spark):
    bad = F.col("domain").isin("bad.com", "x.bad.com")
    out = numbers(spark, data=[(0, "A", "dns_query", "bad.com", 0, 0, 0), (1, "A", "dns_query", "x.bad.com", 0, 0, 1), (2, "A", "dns_query", "ok.com", 0, 0, 2), (3, "A", "ipdr_session", None, 1000, 10_000, 3)], suspicious=bad)
    assert (out[3]["dns_query_rate_1h"], out[3]["suspicious_domain_count_1h"], out[3]["data_volume_1h_bytes"]) == (3, 2, 11_000)


def test_late_and_suppressed(spark):
    ev = spark.createDataFrame([("A", 0, 100_000, 0), ("A", 1, 50_000, 1), ("A", 2, 70_000, 2)], "key string, event_id long, ts_ms long, arrival long")
    assert [r["late"] for r in features.late_events(ev, "key", "arrival").orderBy("event_id").collect()] == [False, True, False]
    ev = spark.createDataFrame([("A", i, t) for i, t in enumerate([0, 50, 99, 100, 150, 200])], "key string, event_id long, ts_ms long")
    assert [r["event_id"] for r in features.suppressed(ev, "key", "ts_ms", "event_id", 100).where("emitted").orderBy("event_id").collect()] == [0, 3, 5]
    odd = spark.createDataFrame([("A", 2**60 + 1, 0), ("B", 2**60 + 1, 5), ("A", None, 20), ("A", 7, None), (None, 1, 3), (None, 2, 4)], "key string, event_id long, ts_ms long")
    got = {tuple(r) for r in features.suppressed(odd, "key", "ts_ms", "event_id", 10).collect()}
    assert got == {("A", 2**60 + 1, 0, True), ("B", 2**60 + 1, 5, True), ("A", None, 20, True), ("A", 7, None, False), (None, 1, 3, True), (None, 2, 4, False)}
    assert features.suppressed(odd.where("false"), "key", "ts_ms", "event_id", 10).count() == 0


def test_wallet_p95(spark):
    momo = spark.createDataFrame([(i, "W", f"R{i % 3}", None, "p2p_transfer" if i else "reversal", i * 10, i) for i in range(11)], "event_id long, sender_wallet string, recipient_wallet string, account_hash string, kind string, amount_minor long, ts_ms long")
    last = features.final_state(features.wallet_features(momo), "wallet_id").first()
    assert (last["txn_velocity_1h"], last["counterparty_diversity_24h"], last["value_p95_24h"]) == (10, 3, 90.0)


@pytest.mark.parametrize("send_at, n", [(M + H, 1), (25 * H + M + 1, 0)])
def test_voice_sms_momo(spark, send_at, n):
    calls = spark.createDataFrame([(1, "A", "B", "call_start", None, 0)], VOICE)
    sms = spark.createDataFrame([(2, "A", "B", "mt", None, M)], SMS)
    owns = spark.createDataFrame([("B", "WB")], "number string, wallet string")
    sent = spark.createDataFrame([(3, "WB", "X", send_at, 5)], SENT)
    assert motifs.voice_sms_momo(calls, sms, owns, sent).count() == n


def test_mule_chain_and_carousel(spark):
    sent = spark.createDataFrame([(i, f"W{i}", f"W{i + 1}", i * 1000, 10) for i in range(1, 4)], SENT)
    out = {r["chain"]: r["total_amount_minor"] for r in motifs.mule_chains(sent).collect()}
    assert out == {"W1>W2>W3": 20, "W2>W3>W4": 20, "W1>W2>W3>W4": 30}
    used = spark.createDataFrame([(i, f"N{i}", "x", "call_start", "D", i) for i in range(3)], VOICE)
    assert motifs.sim_carousel(used).first()["confidence"] == 0.55


def test_rules(spark):
    row = spark.createDataFrame([(12, 20, 60, 1, 0, None), (0, 0, 0, 4, 0, None), (0, 0, 0, 0, 30, "t"), (0, 31, 20, 2, 0, None)], "velocity_1m int, velocity_5m int, fanout_1h int, imei_count int, sms_freq_1h int, sms_template_top string")
    assert [(r["signal_kind"], r["score"]) for r in scoring.score_number(row).collect()] == [("voice.velocity_burst", 0.92), ("device.imei_churn", 0.78), ("sms.bulk_template", 0.85), (None, 0.64)]


def test_policy_first_match(spark):
    sig = spark.createDataFrame([("momo.mule_velocity", "high", 0.9, "wallet", {}), ("momo.mule_velocity", "high", 0.9, "wallet", {"verified_business": "true"}), ("momo.mule_velocity", "low", 0.9, "wallet", None), ("x", "low", 0.1, "number", {})], "signal_kind string, severity string, score double, subject_kind string, evidence map<string, string>")
    got = [r["rule_id"] for r in policy.decide(sig, policy.signal_predicate).collect()]
    assert got == ["momo-mule-friction-tier1", "verified-business-suppress", "default", "default"]
    changed = list(policy.DEFAULT_RULES)
    changed[4] = policy.Rule(**{**changed[4].__dict__, "severity_in": ("low",)})
    assert policy.fingerprint(changed) != policy.fingerprint(policy.DEFAULT_RULES)


def test_policy_from_dict():
    rules, default = policy.from_dict({"rules": [{"id": "a", "match": {"signal_kind": "s", "severity_in": ["high"]}, "action": "x", "tier": "tier1", "suppression_window_s": 5}], "default": {"action": "y", "tier": "tier3"}})
    assert rules[0].severity_in == ("high",) and rules[0].window_s == 5 and default.action == "y"


def test_names():
    assert names.soundex("Ashcraft") == "A226" and names.soundex("Robert") == "R163" and names.soundex("12") == ""
    assert names.metaphone("Knight") == "NFT" and names.metaphone("Thomas")[0] == "0"
    assert round(names.jaro("martha", "marhta"), 4) == 0.9444 and round(names.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert names.match(names.plain("Mensah-Boateng"), names.plain("mensah boateng")) == 1.0
    assert names.match([], ["a"]) == 0.0


def test_names_blocking_is_lossless(spark):
    pool = ["kofi mensah", "kofi mensa", "ama boateng", "kwame nkrumah", "ama boatin", "john smith", "jon smyth"]
    a = spark.createDataFrame(list(enumerate(pool)), "query_id long, name string")
    b = spark.createDataFrame(list(enumerate(pool[::-1])), "entry_id long, name string")
    want = {}
    for i, x in enumerate(pool):
        rated = [(round(names.match(names.plain(x), names.plain(y)), 6), -j) for j, y in enumerate(pool[::-1])]
        if max(rated)[0] >= 0.85:
            want[i] = (-max(rated)[1], max(rated)[0])
    assert {r["query_id"]: (r["entry_id"], r["score"]) for r in names.check_names(a, b).collect()} == want


def test_agents(spark):
    t = spark.createDataFrame([("A", "C", k, "wallet", 100, i * 100_000 + (30_000 if k == "cash_out" else 0), 2 * i + (k == "cash_out")) for i in range(5) for k in ("cash_in", "cash_out")], "agent string, counterparty string, kind string, counterparty_kind string, amount_minor long, ts_ms long, event_id long")
    r = agents.commission_farming(t).first()
    assert (r["cycles"], r["cycle_amount_minor"], r["score"]) == (5, 1000, 0.6)


def test_profile_is_the_fold(spark):
    rng = random.Random(5)
    rows = [(f"a{i % 7}", rng.randrange(30) * 1_800_000, rng.choice([0.0, 0.3, 0.55, 0.9]), i) for i in range(300)]
    rows += [("zero", 0, 0.0, 900), ("gap", 0, 0.9, 901), ("gap", 10 * 3_600_000, 0.2, 902), ("gap", 11 * 3_600_000, 0.1, 903)]
    want = {}
    for agent, t, score, _ in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        last, risk, n = want.get(agent, (t, 0.0, 0))
        want[agent] = (t, max(score, risk * max(0.0, 1 - (t - last) / 3_600_000 * 0.1)), n + 1)
    got = agents.profile(spark.createDataFrame(rows, "agent string, ts_ms long, score double, event_id long"))
    assert {r["agent"]: (r["risk"], r["detections"]) for r in got.collect()} == {a: (pytest.approx(r, abs=2e-6), n) for a, (_, r, n) in want.items()}


def test_metadata_merges_by_key(spark):
    schema = "kind string, identifier string, risk_score double, hit_count long, last_ms long, expires_ms long, metadata map<string, string>"
    old = spark.createDataFrame([("n", "1", 0.5, 2, 10, 90, {"a": "x", "b": "y"}), ("n", "2", 0.1, 1, 5, 50, None), (None, "3", 0.2, 1, 1, 1, {"k": "v"})], schema)
    new = spark.createDataFrame([("n", "1", 0.4, 3, 20, 80, {"b": "z", "c": None})], schema)
    got = {(r["kind"], r["identifier"]): (r["risk_score"], r["hit_count"], r["last_ms"], r["expires_ms"], r["metadata"]) for r in serving.upsert_intel(old, new).collect()}
    assert got == {("n", "1"): (0.5, 5, 20, 90, {"a": "x", "b": "z", "c": None}), ("n", "2"): (0.1, 1, 5, 50, {}), (None, "3"): (0.2, 1, 1, 1, {"k": "v"})}


def test_content(spark):
    df = spark.createDataFrame([("mtn.com.gh", None, None), ("mtn-login.com", "mtn", None), ("ecobnk.com", "ecobank.com", 1), ("example.org", None, None)], "domain string, target string, distance int")
    for r in df.withColumn("x", content.lookalike(F.col("domain"))).collect():
        assert (r["x"]["target"], r["x"]["distance"]) == (r["target"], r["distance"])
    out = spark.createDataFrame([("Pay GHS 1,200.50 to 0241234567  code 12",)], "body string").select(content.template(F.col("body"))).first()[0]
    assert out == "pay ghs<AMOUNT> to <MSISDN> code<AMOUNT>"


def test_components_of_few_links_take_few_tasks(spark, monkeypatch):
    """However many partitions a shuffle has: a round after the first writes a file for each core at most."""
    made, write = [], graph.Rounds.write
    monkeypatch.setattr(graph.Rounds, "write", lambda self, df, name: made.append(write(self, df, name)) or made[-1])
    held = {"spark.sql.shuffle.partitions": "41", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        pairs = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(300) if i % 50 != 49]
        got = graph.components(spark.createDataFrame(pairs, "src string, dst string")).collect()
        assert {r["id"]: r["component"] for r in got} == {f"n{i:03d}": f"n{i // 50 * 50:03d}" for i in range(300)}
        assert len(made) > 2 and all(len(df.inputFiles()) <= spark.sparkContext.defaultParallelism for df in made[-2:])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_components_and_communities(spark):
    e = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x"), ("p", "q")]
    df = spark.createDataFrame(e, "src string, dst string")
    assert {r["id"]: r["component"] for r in graph.components(df).collect()} == dict.fromkeys("abcxyz", "a") | dict.fromkeys("pq", "p")
    got = {r["id"]: r["community"] for r in communities.communities(df).collect()}
    assert got["a"] == got["b"] == got["c"] != got["x"] == got["y"] == got["z"]
    # a ring of cliques: one community each, numbered by size, then name
    e = [(f"{k}{i}", f"{k}{j}") for k, n in (("a", 4), ("b", 4), ("c", 5)) for i in range(n) for j in range(i)] + [("a0", "b0"), ("b1", "c0"), ("c1", "a1")]
    got = {(r["community"], r["index"], r["id"][0]) for r in communities.communities(spark.createDataFrame(e, "src string, dst string")).collect()}
    assert got == {("c0", 0, "c"), ("a0", 1, "a"), ("b0", 2, "b")}
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(120)], "src string, dst string")
    assert {r["component"] for r in graph.components(chain).collect()} == {"n000"}
    assert graph.components(chain.limit(0)).count() == 0 and communities.communities(chain.limit(0)).count() == 0
    assert {r["id"]: r["hops"] for r in graph.k_hop(df, spark.createDataFrame([("a",)], "id string"), 2).collect()} == {"a": 0, "b": 1, "c": 1, "x": 2}


def test_ingest(spark):
    raw = spark.createDataFrame([(None, "handoff", "A", None, 5, None), ("v1", "other", "A", "B", 6, None)], "vendor_id string, event_type string, caller string, callee string, ts_ms long, imei string")
    a, b = ingest.voice(raw).orderBy("ts_ms").collect()
    assert a["kind"] == "handover" and a["event_id"] == "voice_" + hashlib.sha256(b"A||handoff|5").hexdigest()[:24] and b["event_id"] == "voice_v1" and b["kind"] is None
    good, dead = ingest.split_valid(ingest.voice(raw), F.col("kind").isNotNull())
    assert (good.count(), dead.count()) == (1, 1) and ingest.dead_letter_topic("sms.events.v1") == "sms.events.dlq.v1"


def test_serving(spark):
    rows = spark.createDataFrame([("proposed", "approved"), ("proposed", "done"), ("nope", "done")], "state string, wanted string")
    assert [(r["state"], r["applied"]) for r in serving.transition(rows).collect()] == [("approved", True), ("proposed", False), ("nope", False)]


def test_learned(spark):
    rows = spark.createDataFrame([(i, float(i % 2), int(i % 2), 0.1, "k") for i in range(60)], "event_id long, x double, label int, score double, signal_kind string")
    out = learned.score_features(rows, learned.fit_features(rows, ["x"], rounds=3), ["x"])
    assert out.where("(score >= 0.7) <> (label = 1)").count() == 0
    assert learned.score_features(rows, None, ["x"]) is rows


def test_sessions_connect_to_a_domain_or_else_to_an_address(spark):
    schema = "event_id long, msisdn string, kind string, domain string, rdata string, bytes_up long, bytes_down long, ts_ms long"
    data = [
        (0, "A", "ipdr_session", "a.com", "10.0.0.1", 5, None, 0), (1, "A", "ipdr_session", None, "10.0.0.2", None, 7, 1), (2, "A", "ipdr_session", "", "10.0.0.3", 1, 2, 2),
        (3, None, "ipdr_session", None, "10.0.0.4", 1, 2, 3), (4, "A", "dns_response", "a.com", "::1", 0, 0, 4), (5, "A", "dns_response", None, "10.0.0.5", 0, 0, 5),
        (6, "A", "dns_response", "a.com", "b.com", 0, 0, 6), (7, "A", "ipdr_session", None, None, 0, 0, 7),
    ]
    out = graph.data_operations(spark.createDataFrame(data, schema))
    edges = {(r["event_id"], r["edge_kind"], r["dst_kind"], r["dst_id"], (r["properties"] or {}).get("bytes_up"), (r["properties"] or {}).get("bytes_down")) for r in out.where("op = 'upsert_edge'").collect()}
    assert edges == {
        (0, "CONNECTED", "Domain", "a.com", "5", "0"), (1, "CONNECTED", "IPEndpoint", "10.0.0.2", "0", "7"), (2, "CONNECTED", "IPEndpoint", "10.0.0.3", "1", "2"), (4, "QUERIED", "Domain", "a.com", None, None),
        (4, "RESOLVED_TO", "IPEndpoint", "::1", None, None), (6, "QUERIED", "Domain", "a.com", None, None),
    }
    assert {(r["event_id"], r["node_id"]) for r in out.where("node_kind = 'IPEndpoint'").collect()} == {(1, "10.0.0.2"), (2, "10.0.0.3"), (4, "::1")}
    sms = spark.createDataFrame([(0, "A", "B", "mt", "t", 0), (1, "A", "B", "mo", None, 1), (2, "A", "B", "mt_delivery_receipt", "t", 2)], SMS)
    assert [(r["event_id"], r["properties"]) for r in graph.sms_operations(sms).where("op = 'upsert_edge'").orderBy("event_id").collect()] == [(0, {"template_hash": "t"}), (1, {})]


def test_domains_are_valid_and_allowed_with_what_is_below(spark):
    own = spark.createDataFrame([(x,) for x in ("a.com", "x.a.com", "xa.com", "com", "b.c1", "ü.de", "", None)], "domain string")
    assert {r["domain"] for r in own.where(content.valid_domain(F.col("domain"))).collect()} == {"a.com", "x.a.com", "xa.com"}
    free = spark.createDataFrame([(" A.com. ",), (None,)], "domain string")
    assert {r["domain"] for r in content.not_allowed(own, "domain", free).collect()} == {"xa.com", "com", "b.c1", "ü.de", "", None}
    assert content.not_allowed(own, "domain", free.where("false")).count() == 8


def test_redaction_reaches_into_objects(spark):
    deep = '{"a":{"b":{"c":{"d":{"Token":"abc","x":[{"pin":1}],"msisdn":null}}}},"wallet_id":{"n":1},"extra":"q","n":5}'
    rows = [(1, deep), (2, "[1]"), (3, "7"), (4, None), (5, "{}")]
    df = spark.createDataFrame(rows, "i int, j string").select("i", F.parse_json("j").alias("v"))
    got = {r["i"]: r["o"] for r in df.select("i", F.to_json(content.redact_nested(F.col("v"), ("EXTRA",))).alias("o")).collect()}
    assert got[1] == '{"a":{"b":{"c":{"d":{"Token":"<redacted:3>","msisdn":"<none>","x":[{"pin":1}]}}}},"extra":"<redacted:1>","n":5,"wallet_id":"<redacted:7>"}'
    assert (got[2], got[3], got[4], got[5]) == ("[1]", "7", None, "{}")
    cut = df.where("i = 1").select(F.to_json(content.redact_nested(F.col("v"), depth=2)).alias("o")).first()["o"]
    assert '"b":"<redacted:' in cut and "Token" not in cut


def test_patterns_keep_their_greatest_score(spark):
    h = 3_600_000
    rows = [("A", "p", 0, 1, 0.8), ("A", "q", h, 2, 0.5), ("A", "p", 2 * h, 3, 0.1), ("B", "p", 0, 4, 0.9), ("B", "q", 20 * h, 5, 0.2), ("B", None, 20 * h, 6, 0.9)]
    got = {(r["agent"], r["pattern"]): (r["score"], r["n"]) for r in agents.pattern_profile(spark.createDataFrame(rows, "agent string, pattern string, ts_ms long, event_id long, score double")).collect()}
    assert got == {("A", "p"): (0.648, 2), ("A", "q"): (0.45, 1), ("B", "p"): (0.0, 1), ("B", "q"): (0.2, 1)}


def test_templates_of_prefixed_texts_are_worked_out_once_a_document(spark, small):
    from tidewatch.plans.content import lead, sms_template
    from tidewatch.sources.views import Views

    texts = ["", " ", "123 foo", "  7,500 and 0241234567", "foo 12", "+233241234567 x", "é  12.50\n", "<b> 1 ", "12345678901 5", "́x 3"]
    df = spark.createDataFrame([(e, t) for e in range(6) for t in texts], "event_id long, text string").withColumn("lead", lead())
    got = content.prefixed(F.col("lead"), content.collapse(content.nfc(F.col("text"))), content.template(content.nfc(F.col("text"))))
    whole = content.nfc(F.concat("lead", "text"))
    for r in df.select(*got, content.body_hash(whole), content.template(whole)).collect():
        assert (r[0], r[1]) == (r[2], r[3])
    plan = sms_template(Views(spark, small))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("ArrowEvalPython")
