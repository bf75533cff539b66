"""Each operator against a brute-force version or an exact round trip, and on awkward rows."""

import glob
import hashlib
import itertools
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import chat, common, decontaminate, license, lines, minhash, packing, pii, quality, topk, toxicity
from tidewatch.llm.labelled import crc
from tidewatch.llm.queries import oracle_sql, queries

DOC = "doc_id long, text string"


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def awkward(spark):
    """Nulls, empty and blank texts, repeated rows, a long text, and columns whose names the operators use inside."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here at all"), (5, "long " * 30_000), (6, "\x00 é \U0001f600 end")]
    own = [(i, t, 1, "x", 2, 3.0, "r", 4) for i, t in rows]
    return spark.createDataFrame(own, DOC + ", row int, line string, n int, score double, near string, n_lines int")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, small, name):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, sql = queries()[name](spark, small), con.sql(oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(sql.columns)
    rows = sorted(tuple(map(str, r)) for r in got.select(cols).collect())
    assert rows and rows == sorted(tuple(map(str, r)) for r in sql.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (20, 20)] + [(100 + i, 101 + i) for i in range(40)]
    out = {r["id"]: r["component"] for r in common.connected_components(frame(spark, pairs, "src long, dst long")).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(41)}
    assert common.connected_components(frame(spark, [], "src long, dst long")).count() == 0


# 1 and 9: classifiers


def test_quality_and_toxicity_held_out(spark, small):
    for name, label in (("op1_quality_knn", "quality"), ("op9_toxicity", "toxic")):
        got = queries()[name](spark, small)
        assert got.count() == spark.read.parquet(f"{small}/documents.parquet").count()
        own = got.join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").toPandas()
        assert own["score"].between(0, 1).all() and (own["predicted"] == (own["score"] >= 0.3)).all()
        held = own[own["held_out"]]
        assert (held["predicted"] == held[label]).mean() > (0.9 if label == "quality" else 0.8)
    assert got.where("held_out").count() == sum(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got.collect())


def test_quality_neighbours_equal_brute_force():
    rng = np.random.default_rng(0)
    rows = [(int(i % 3 > 0), *(x.astype(np.int32) for x in (np.unique(rng.integers(0, 50, 20)),) * 1), None) for i in range(60)]
    rows = [(y, t, np.ones(len(t), np.int32)) for y, t, _ in rows]
    m = quality.Model({i: 5 for i in range(50)}, 60, rows)
    got = m.scores([r[1:] for r in rows[:5]])
    for i in range(5):
        cosine = m.vectors @ m.vectors[i]
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        w = np.maximum(cosine[near], 0) ** quality.SHARPNESS
        assert abs(got[i] - (w * m.labels[near]).sum() / w.sum()) < 1e-3


def test_classifiers_on_awkward_rows(spark):
    docs = awkward(spark)
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    some = frame(spark, [(4, 1, 1), (5, 0, 0), (6, 1, 0), (2, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        learn = F.lit(True)
        for out, name in ((quality.score(docs, quality.fit(docs, labels, learn)), "score"), (toxicity.score(docs, toxicity.fit(docs, labels, learn)), "toxicity")):
            got = out.collect()
            assert len(got) == docs.count() and all(0 <= r[name] <= 1 for r in got)
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), none, F.lit(True))).count() == 0


def decoder(*more):
    words = ("idiot", "moron", "stupid", "loser", "the", "with", "scum", "ass", "you", "are", "a", *more)
    counts = np.zeros(27**4, np.int64)
    c = [0]
    for w in words * 50:
        c += [*(ord(x) - 96 for x in w), 0]
    for i in range(len(c) - 3):
        counts[((c[i] * 27 + c[i + 1]) * 27 + c[i + 2]) * 27 + c[i + 3]] += 1
    return toxicity.Decoder(counts)


def test_decoding():
    d = decoder("worthless")
    for given in ("1d10t", "i d i o t", "id!ot", "idiooot", "i.d.i.o.t", "i d 1 o t", "i.d.1.0.t", "i  d\ti   o t", "i-d.i_o*t", "1-d-1-0-t", "i . d . i . o . t", "id*ot", "idi0t!"):
        assert d.restore(f"the {given} with").rstrip("!") == "the idiot with", given
    assert d.restore("plain text, 12 is 34% of it") == "plain text, 12 is 34% of it"
    assert d.restore("M0R0N st*pid l0s3r") == "moron stupid loser" and d.restore("a$$") == "ass"
    assert d.restore("y o u a r e a w o r t h l e s s i d i o t") == "you are a worthless idiot"
    assert d.restore("y.o.u.a.r.e.a.w.0.r.t.h.l.3.s.s.i.d.i.o.t") == "you are a worthless idiot"
    assert d.restore("1 2 3 4") == "1 2 3 4" and d.restore("***** #*#*#*#") == "***** #*#*#*#"


def test_decoding_equals_exhaustive_search():
    d = decoder()
    r = random.Random(6)
    for _ in range(300):
        apart = r.random() < 0.5
        letters = [r.choice("idotsaem1043$!*") for _ in range(r.randint(3, 6))]
        span = "".join(x + r.choice([" ", ".", "-"]) * apart for x in letters).strip(" .-")
        slots = d.slots(span, apart)
        if np.prod([len(x) for x in slots]) > 40_000:
            continue
        best = None
        for path in itertools.product(*slots):
            c = [0, 0, 0] + [ord(x) - 96 if x != " " else 0 for x in "".join(t for t, _ in path)] + [0]
            p = sum(q for _, q in path) + sum(float(d.table[((c[i] * 27 + c[i + 1]) * 27 + c[i + 2]) * 27 + c[i + 3]]) for i in range(len(c) - 3))
            if best is None or p > best[0] + 1e-9:
                best = (p, {" ".join("".join(t for t, _ in path).split())})
            elif abs(p - best[0]) < 1e-9:
                best[1].add(" ".join("".join(t for t, _ in path).split()))
        assert d.decode(slots) in best[1], span


def test_toxicity_score_equals_the_formula():
    d = decoder()
    ids = [toxicity._id("=idiot"), toxicity._id("moro")]
    scorer = toxicity.Scorer([])
    scorer.bias, scorer.weights = -2.0, dict(zip(ids, (3.0, 2.0)))
    own = toxicity.Features(d, scorer.weights)
    for text, x in (("you 1d10t", (1, 0)), ("you are", (0, 0)), ("i d i o t morons " + "the " * 119, (1, 60 / 125)), ("", (0, 0))):
        assert abs(scorer.score(own.of(text)) - 1 / (1 + np.exp(2 - 3 * x[0] - 2 * x[1]))) < 1e-9, text


AWKWARD_IDS = [None, 2**60 + 1, 2**63 - 1, -(2**62) - 1, 7, 7]


@pytest.mark.parametrize("name", ["quality", "pii", "topk", "decontaminate", "packing", "lines", "minhash", "license", "toxicity", "chat"])
def test_ids_stay_as_they_are(spark, name):
    text = " ".join(words(30, 5)) + " All rights reserved. Mail x@y.zz"
    docs = frame(spark, [(i, text) for i in AWKWARD_IDS]).coalesce(1)
    labels = frame(spark, [(7, 1, 1), (2**60 + 1, 0, 0)], "doc_id long, quality int, toxic int")
    every = F.lit(True)
    out = {
        "quality": lambda: quality.score(docs, quality.fit(docs, labels, every)), "pii": lambda: pii.detect(docs), "decontaminate": lambda: decontaminate.hits(docs, frame(spark, [(1, text)], "item_id long, text string")),
        "packing": lambda: packing.pack(docs), "lines": lambda: lines.dedup(docs), "minhash": lambda: minhash.components(docs), "license": lambda: license.scan(docs), "toxicity": lambda: toxicity.score(docs, toxicity.fit(docs, labels, every)),
        "chat": lambda: chat.digests(chat.formatted(docs.selectExpr("doc_id as conv_id", "0 as turn", "'user' as role", "text"))).withColumnRenamed("conv_id", "doc_id"),
        "topk": lambda: topk.top_k(docs.selectExpr("doc_id as vec_id", "array(1.0f, 2.0f) as embedding"), every).selectExpr("vec_id as doc_id").distinct(),
    }[name]()
    want = {None, *AWKWARD_IDS} - ({None} if name == "topk" else set())
    got = [r["doc_id"] for r in out.collect()]
    assert set(got) == want and (len(got) == len(AWKWARD_IDS) or name in ("topk", "license", "chat"))


# 2: personal data


def slow_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_equal_the_patterns():
    r = random.Random(4)
    for _ in range(4000):
        t = "".join(r.choice(["a", "Z", "9", "0", "1.2.3.4", "@", ".", "-", " ", "+", "(", "b.c", "4111 1111 1111 1111", "é", "255.", "x@y.z", "%"]) for _ in range(r.randint(0, 14)))
        assert pii.base(t) == slow_base(t), t


def test_pii_query(spark, small):
    got = {r["doc_id"]: r for r in queries()["op2_pii"](spark, small).collect()}
    for d in spark.read.parquet(f"{small}/documents.parquet").collect():
        want = slow_base(d["text"] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and (r["spans"] + ",").startswith(text)
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]


def test_disguised_mail_equals_the_pattern():
    whole = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:[\[(] ?at ?[\])]| at ) ?[A-Za-z0-9-]+(?:(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[A-Za-z0-9-]+)+")
    r = random.Random(1)
    for _ in range(4000):
        t = "".join(r.choice(["a", "b.c", " ", "at", " at ", "(at)", "[ at ]", " dot ", "(dot)", ".", "-", "host.de", "é", "  "]) for _ in range(r.randint(0, 12)))
        assert pii.disguised(t) == [m.span() for m in whole.finditer(t)], t


def personal(kind, i, right=True):
    """A text with one candidate of a kind; its checks hold or not, its format is the same."""
    r = random.Random(f"{kind} {i}")
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if kind == "secret":
        return ("token = " if right else "token; ") + "".join(r.choice("0123456789abcdef") for _ in range(40))
    if kind == "number":
        own = "4" + d(14)
        own += next(c for c in "0123456789" if pii.luhn(own + c) == right)
        return "pay " + " ".join(own[k : k + 4] for k in (0, 4, 8, 12))
    if kind == "tel":
        return f"ask {'+1 ' if right else ''}({d(3)}) 555-{d(4)} now"
    if kind == "mail":
        return f"ask j{d(2)}.doe (at) host{d(1)} (dot) {'com' if right else 'zzz'} now"
    return "from " + ":".join(f"{r.randrange(4096, 65536):x}" for _ in range(8 if right else 7)) + " now"


def test_every_wider_kind_is_added(spark, monkeypatch):
    rows = [(i, personal(kind, i, i % 50 > 0)) for kind in pii.WIDER for i in range(200)]
    added = [s["kind"] for r in pii.detect(frame(spark, rows)).collect() for s in r["added"]]
    assert {"secret", "mail", "host", "number", "tel"} == set(added) and added.count("mail") > 180 and added.count("host") > 180
    assert pii.candidates("ask me at home.com")[0][0] == "mail" and not pii.known("ask me at home.com", "mail", 4, 18)
    # a kind that is rare beside the sample has a threshold all the same
    monkeypatch.setattr(pii, "SAMPLE", 100)
    rows = [(i, personal("number", i)) for i in range(4000)] + [(i, personal("host", i, False)) for i in range(4000)] + [(i, personal("mail", i)) for i in range(40)]
    added = [s["kind"] for r in pii.detect(frame(spark, rows)).collect() for s in r["added"]]
    assert added.count("mail") == 40


def test_pii_on_awkward_rows(spark):
    docs = awkward(spark).unionByName(spark.createDataFrame([(7, 'token = "a1b2c3d4e5f6a7b8c9d0e1f2" ip 1.2.3.4 +1 (212) 555-0100', 1, "x", 2, 3.0, "r", 4)], awkward(spark).schema))
    out = pii.detect(docs).collect()
    assert len(out) == 9 and sum(len(r["base"]) for r in out) == 2
    assert pii.redact("a x@y.zz b", [("email", 2, 8)]) == "a [email] b"
    assert pii.detect(docs.limit(0)).count() == 0


# 3: top-k


def test_search_equals_brute_force():
    r = np.random.default_rng(2)
    x = r.integers(-3, 4, (900, 6)).astype(np.int32)
    ids = r.permutation(900) - 450
    rows = np.arange(900)
    low = np.iinfo(np.int64).min
    for floor in (low, 20):
        best, who = topk.search(x[:40], rows[:40], np.full(40, floor), x, ids, rows, 10)
        for i in range(40):
            score = x.astype(int) @ x[i]
            want = sorted((-int(s), int(d)) for j, (s, d) in enumerate(zip(score, ids)) if j != i and s >= floor)[:10]
            assert [(-int(s), int(d)) for s, d in zip(best[i], who[i]) if s > low] == want


def test_tree_has_tight_boxes():
    x = np.random.default_rng(1).integers(-9, 10, (1000, 4))
    t = topk.Tree(x, np.arange(1000), 50)
    assert sorted(t.order.tolist()) == list(range(1000))
    for n in range(len(t.left)):
        own = x[t.order[t.start[n] : t.end[n]]]
        assert (own.min(axis=0) == t.low[n]).all() and (own.max(axis=0) == t.high[n]).all()
        assert t.left[n] >= 0 or t.end[n] - t.start[n] <= 50


def test_topk_over_shards_equals_brute_force(spark, monkeypatch):
    for name, n in (("SHARD", 60), ("BLOCK", 7), ("LEAF", 8), ("CHAIN", 2)):
        monkeypatch.setattr(topk, name, n)
    r = np.random.default_rng(4)
    rows = [(int(i), r.integers(-4, 5, 5).astype(float).tolist()) for i in [*range(0, 600, 2), *range(0, 200, 20), *range(-40, 0)]]
    rows += [(300, rows[3][1]), (300, rows[4][1]), (7, [2.0**40] * 5)]
    got = defaultdict(list)
    for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, scale=1).collect():
        got[x["query_id"]].append((x["rank"], -x["score"], x["vec_id"]))
    want = defaultdict(list)
    for i, (a, v) in enumerate(rows):
        if a % 100 == 0:
            own = sorted((-int(np.dot(v, w)), b) for j, (b, w) in enumerate(rows) if i != j)[:10]
            want[a] += [(k + 1, s, b) for k, (s, b) in enumerate(own)]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_topk_on_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [0.5, -0.25]), (1, [1.0, 2.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [None, 1.0]), (6, []), (7, [3.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0])]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "vec_id long, embedding array<float>, rank int")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    s = 1024 * 1024
    assert got == [(0, 1, 1, 5 * s), (0, 2, 8, 5 * s), (0, 3, 100, 0), (100, 1, 0, 0), (100, 2, 1, 0), (100, 3, 8, 0)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# 4: decontamination


def test_hits_on_awkward_rows(spark):
    item = " ".join(f"i{k}" for k in range(14))
    docs = awkward(spark).select("doc_id", "text", "near", "row").unionByName(frame(spark, [(10, "x " + item.upper() + "! y", "n", 1), (11, "i0 i1 i2, i3", "n", 1), (12, "Short one", "n", 1), (12, "Short one", "n", 1)], DOC + ", near string, row int"))
    bench = frame(spark, [(1, item), (2, "short, ONE"), (3, None), (4, "..."), (5, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.hits(docs, bench).collect()}
    assert got[10] == (16, 14, 2, True) and got[11] == (4, 0, 0, False) and got[12] == (2, 2, 1, True) and got[1] == (0, 0, 0, False)
    assert decontaminate.hits(docs, bench).count() == docs.count()
    assert decontaminate.hits(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.hits(docs.limit(0), bench).count() == 0


# 5: packing


def test_patterns_use_everything():
    r = random.Random(5)
    for n, low, high in ((1, 1, 1024), (50, 1, 40), (300, 1, 1024), (300, 400, 700), (200, 512, 512)):
        count = defaultdict(int)
        for _ in range(n):
            count[r.randint(low, high)] += 1
        used = defaultdict(int)
        for lengths, k in packing.patterns(dict(count)):
            assert sum(lengths) <= 1024 and k > 0
            for x in lengths:
                used[x] += k
        assert used == count
    assert packing.patterns({}) == [] and packing.patterns({600: 2, 424: 2}) == [((600, 424), 2)]
    assert sum(k for _, k in packing.patterns({700: 1, 200: 1, 100: 1, 24: 1})) == 1


def test_packing(spark, small):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(frame(spark, [(-1, None), (-2, ""), (-3, "a<|endoftext|>b"), (-4, "x " * 5000)]))
    got = packing.pack(docs).toPandas()
    ids = Tokenizer.from_file(packing.vocabulary())
    for d in docs.collect():
        own = [*ids.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        rows = got[got["doc_id"] == d["doc_id"]].sort_values("piece")
        assert rows["length"].sum() == len(own) and (rows["length"].iloc[1:] == 1024).all() and rows["piece"].tolist() == list(range(len(rows)))
        for r in rows.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]] and rows["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= 1.02 * got["length"].sum() / 1024 + 2
    assert packing.pack(docs.limit(0)).count() == 0


# 6: lines


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_within_equals_edit_distance(spark):
    r = random.Random(3)
    rows = []
    for _ in range(1500):
        a = "".join(r.choice("abé") for _ in range(r.randint(0, 12)))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            i = r.randint(0, len(b))
            b[i : i + r.randint(0, 1)] = r.choice(["", "a", "b", "é"])
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"x": F.split("a", ""), "y": F.split("b", "")})
    for k in (1, 2, 3):
        for row in df.select("a", "b", lines.within(edits=k).alias("w")).collect():
            assert row["w"] == (edit_distance(row["a"], row["b"]) <= k)


@pytest.mark.parametrize("hot, block", [(64, 48), (0, 48), (0, 3), (6, 4)])
def test_near_lines_lose_no_pair(spark, monkeypatch, hot, block):
    monkeypatch.setattr(lines, "HOT", hot)
    monkeypatch.setattr(lines, "BLOCK", block)
    r = random.Random(9)
    base = ["".join(r.choice("abcde fgh") for _ in range(r.randint(20, 45))) for _ in range(30)]
    own = set(base)
    for t in base * 4 + base[:2] * 12:
        s = list(t)
        for _ in range(r.randint(1, 3)):
            i = r.randint(0, len(s))
            s[i : i + r.randint(0, 1)] = r.choice(["", "a", "x"])
        if len(s) >= 20:
            own.add("".join(s))
    own = sorted(own)
    held = lines.distinct_lines(frame(spark, [(i, t) for i, t in enumerate(own + own[:50])]), 20)
    ids = {row["id"]: row["line"] for row in held.collect()}
    assert sorted(ids.values()) == own
    links, degree = lines.near_lines(held)
    want = {frozenset((a, b)) for i, a in enumerate(own) for b in own[:i] if abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= 2}
    got = {frozenset((ids[row["src"]], ids[row["dst"]])) for row in links.collect()}
    count = defaultdict(int)
    for a, b in map(tuple, want):
        count[a] += 1
        count[b] += 1
    assert {ids[row["id"]]: row["degree"] for row in degree.collect()} == count and len(want) > 30
    assert got == want if hot == 64 else parts(got) == parts(want)


def test_keys_are_probes_of_segments_hashed_row_by_row(spark):
    """Three segments, the last ones longer by one; and no array of hashes, whose code would be too long to compile."""
    texts = ["abcdefghijklmnopqrst", "abcdefghijklmnopqrstu", "\u00e4bc\u5b8c\U0001f600fghijklmnopqrstuv"]
    got = lines.keys(frame(spark, [(i, t) for i, t in enumerate(texts)], "id long, line string").withColumn("length", F.length("line")))
    assert "array(xxhash64" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for k, t in enumerate(texts):
        for side, i, less, shift in lines.probes():
            base, more = divmod(len(t) - less, 3)
            sizes = [base + (j >= 3 - more) for j in range(3)]
            start = sum(sizes[:i]) + shift
            want.append((k, i, len(t) - less, t[start : start + sizes[i]], side))
    want = frame(spark, want, "id long, i int, n int, part string, side int").select("id", F.xxhash64("i", "n", "part").alias("key"), F.col("side").cast("byte"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 36


def test_automaton_passes_over_the_rest_once_nothing_can_come(spark):
    """400 pairs of long lines that differ from the start take a small part of the time of as many near ones."""
    r = random.Random(3)
    far = [(("".join(r.choice("abcdef") for _ in range(900))), "".join(r.choice("ghijkl") for _ in range(900))) for _ in range(40)]
    near = [(x, x[:450] + "z" + x[451:]) for x, _ in far]

    def took(rows):
        df = spark.createDataFrame(rows * 10, "x string, y string").select(F.split("x", "").alias("x"), F.split("y", "").alias("y")).coalesce(1)
        df = common.materialize(df, "split")  # else a filter splits again for each character
        began = time.time()
        n = df.where(lines.within()).count()
        return n, time.time() - began

    took(far)
    (n, fast), (m, slow) = took(far), took(near)
    assert (n, m) == (0, 400) and fast < slow / 2


def parts(pairs):
    low = {}
    find = lambda x: x if low.setdefault(x, x) == x else find(low[x])
    for a, b in map(sorted, pairs):
        x, y = sorted((find(a), find(b)))
        low[y] = x
    return {x: find(x) for x in low}


def test_line_dedup_keeps_columns_of_any_name(spark):
    import corpus_pipeline as p

    text = "a line that is long enough for the edit join"
    names = ("gone", "degree", "row", "doc", "__doc", "class", "hash", "n")
    docs = spark.createDataFrame([(1, text, *names), (2, text + "\nown", *names)], DOC + "".join(f", {n} string" for n in names))
    got = {r["doc_id"]: r for r in lines.dedup(docs).collect()}
    assert got[2]["text"] == "own" and all(r[n] == n for r in got.values() for n in names)
    docs = docs.withColumns({"n_lines": F.lit("mine"), "n_dropped": F.lit("mine"), "n_links": F.lit("mine"), "n_chars": F.lit(7)})
    out = p.drop_lines(spark, docs, "")
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == {1, 2} and all(r[n] == "mine" for r in got.values() for n in ("n_lines", "n_dropped", "n_links")) and got[2]["n_chars"] == 3


def test_line_dedup(spark):
    a, b = "this is the first common line of text", "another line that stands everywhere here"
    rows = [(1, f"{a}\nunique text of the first document\n"), (2, f"{b}\n{a}\nown"), (3, f"{a[:-1]}\n{b}!!\n\n"), (4, None), (5, ""), (2, f"{b}\n{a}\nown")]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], DOC + ", n_lines int, row string")
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["row"]) for r in lines.dedup(docs).collect()), key=str)
    assert got == sorted([(1, rows[0][1], 3, 0, "k"), (2, f"{b}\nown", 3, 1, "k"), (2, f"{b}\nown", 3, 1, "k"), (3, "\n", 4, 2, "k"), (4, None, 0, 0, "k"), (5, "", 1, 0, "k")], key=str)
    assert lines.dedup(docs.limit(0)).count() == 0
    assert lines.dedup(awkward(spark)).count() == 8


def test_short_lines_go_if_they_repeat(spark):
    long = "a line that is long enough for the edit join"
    rows = [(1, f"Read more\n{long}\n\n \t\n\u5b8c"), (2, f"{long}\nRead more\nRead mores\n\n \t\nown\nown"), (3, "\u5b8c\nread more\n"), (None, "Read more\nx")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"], r["n_links"]) for r in lines.dedup(frame(spark, rows)).collect()}
    assert got == {
        None: ("Read more\nx", 2, 0, 0), 1: (f"{long}\n\n \t\n\u5b8c", 5, 1, 0), 2: ("Read mores\n\n \t\nown", 7, 3, 0), 3: ("read more\n", 3, 1, 0),
    }


# 7: near duplicates


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    low = {i: i for i in sets}
    find = lambda i: i if low[i] == i else find(low[i])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(n=40, seed=1):
    r = random.Random(seed)
    rows = []
    for g in range(n):
        w = words(r.choice([3, 8, 30, 120, 400]), g)
        for _ in range(r.randint(1, 6)):
            own = list(w)
            for _ in range(r.choice([0, 0, 1, 2, max(1, len(w) // 25)])):
                own[r.randrange(len(own))] = "new"
            rows.append((len(rows) + 1, " ".join(own).upper() if r.random() < 0.3 else "  ".join(own)))
    common_part = " ".join(words(60, 999))
    rows += [(len(rows) + 1 + i, common_part + " " + " ".join(words(150, 5000 + i))) for i in range(40)]
    return rows


@pytest.mark.parametrize("block", [1_000_000, 3_000])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus() + [(9001, None), (9002, ""), (9003, "  "), (9004, "a b"), (9005, "A  b")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_pipeline_stages_on_awkward_rows(spark, small):
    """Nulls, repeats, very long and empty texts and an empty table go through each stage with the columns they came with."""
    import corpus_pipeline

    rows = [(None, None, None, None, None), (1, None, "en", "web", None), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, "plain words " * 20_000, None, "web", 240_000), (None, "no id at all here", "de", "x", 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clean = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clean.unionByName(docs) if name == "toxicity" else docs, small)
        own = [r for r in out.collect() if r["doc_id"] is None or name != "toxicity" or r["doc_id"] <= 3]
        assert sum(r["doc_id"] is None for r in own) == 2
        if name == "packing":
            assert sum(r["length"] for r in own if r["doc_id"] == 2) == 2 and max(r["length"] for r in own) == 1024
        else:
            assert out.columns == docs.columns and len(own) >= (5 if name == "near_dedup" else 6)
        assert stage(spark, docs.limit(0), small).count() == 0


def test_ip_scan_is_linear_and_the_same():
    import time

    plain, r = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), random.Random(11)
    for _ in range(3000):
        text = "".join(r.choice("0123456789..... a") for _ in range(r.randrange(40)))
        assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in plain.finditer(text)]
    began = time.time()
    assert pii.base("7" * 1_000_000) == [] and time.time() - began < 5


def test_minhash_one_id_with_several_texts(spark):
    a, b, c = (" ".join(words(30, seed)) for seed in (71, 72, 73))
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, None), (9, c), (2, ""), (2, " "), (11, c + " x")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.components(frame(spark, rows)).collect()}
    assert got == {(3, 3, True), (5, 3, False), (7, 3, False), (9, 9, True), (11, 9, False), (2, 2, True)}
    assert minhash.components(frame(spark, rows)).count() == len(rows)



def test_near_duplicates_on_awkward_rows(spark):
    got = [tuple(r) for r in minhash.components(awkward(spark)).orderBy("doc_id").collect()]
    assert len(got) == 8 and (1, 0, 1, True) in got and got.count((4, 1, 4, True)) == 2 and (None, 1, None, True) in got
    assert minhash.components(awkward(spark).limit(0)).count() == 0


def test_estimate():
    a, b = np.arange(0, 100, dtype=np.uint64), np.arange(20, 120, dtype=np.uint64)
    assert minhash.estimate(a[:48], b[:48]) == 28 / 48 and minhash.estimate(a[:48], a[:48]) == 1.0
    assert not minhash.linked(a, b) and minhash.linked(a, a[:75])


def test_letter_counts_make_no_object_for_each_code_in_the_driver(spark, monkeypatch):
    kind = type(spark.range(0))
    for name in ("collect", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(kind, name, lambda *a: pytest.fail("rows became objects"))
    got = toxicity.letter_counts(frame(spark, [(1, "abcde"), (2, "ABCD"), (3, None)]))
    code = lambda x: sum((ord(c) - 96) * 27**i for i, c in enumerate(reversed(x)))
    assert got.dtype == np.int64 and len(got) == 27**toxicity.ORDER and (got[code("abcd")], got[code("bcde")], got[code("dcba")]) == (2, 1, 0)


def test_scorer_is_fitted_without_numbers_of_8_bytes_for_each_entry(monkeypatch):
    """Beyond the rows themselves the driver holds little more than an entry's id, row and value; chunks change no weight."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(2000):
        toxic = int(k % 5 == 0)
        ids = np.unique(np.append(rng.integers(100, 4000, 600), rng.integers(0, 30, 6 * toxic))).astype(np.int32)
        rows.append((toxic, ids, rng.integers(1, 256, len(ids)).astype(np.uint8)))
    tracemalloc.start()
    try:
        scorer = toxicity.Scorer(rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24 * sum(len(r[1]) for r in rows)
    assert len(scorer.weights) > 10 and set(scorer.weights) <= set(range(30))
    monkeypatch.setattr(toxicity, "CHUNK", 1 << 10)
    assert (lambda s: (s.bias, s.weights))(toxicity.Scorer(rows)) == (scorer.bias, scorer.weights)
    assert toxicity.Scorer([(0, rows[0][1][:0], rows[0][2][:0]), (1, rows[0][1], rows[0][2])]).weights == {}


@pytest.mark.parametrize("blocks", [1, 2])
def test_near_copies_that_do_not_link_cost_no_test_of_a_pair_alone(monkeypatch, blocks):
    """Sets around the limit, most pairs below it: brute force has the same components; long sets are estimated first."""
    r = random.Random(4)
    base, tests = r.sample(range(10**6), 300), []
    sets = [np.array(sorted({*r.sample(base, r.randint(225, 290)), *r.sample(range(10**6, 2 * 10**6), 20)}), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(120)]
    sets, sides = [np.sort(s) for s in sets], [i % blocks if blocks > 1 else 2 for i in range(120)]
    want = parts([(i, j) for i in range(120) for j in range(i) if (sides[i] != sides[j] or blocks == 1) and minhash.linked(sets[i], sets[j])])
    estimate, linked = minhash.estimate, minhash.linked
    monkeypatch.setattr(minhash, "estimate", lambda *a: tests.append(a) or estimate(*a))
    monkeypatch.setattr(minhash, "linked", lambda *a: tests.append(a) or linked(*a))
    got = minhash.spanning_links(list(range(120)), sets, sides)
    assert parts(got) == want and len(got) == len(want) - len(set(want.values())) and 20 < len(want) and not tests
    monkeypatch.setattr(minhash, "LONG", 280)
    assert parts(minhash.spanning_links(list(range(120)), sets, sides)) == want and tests


# 8: licenses


def test_bands_keep_their_promise():
    for n in (3, 5, 8, 12, 40, 200):
        _, stride, held = license.shape(n)
        m = held - stride + 1
        need = -(-3 * m // 4)
        jaccard = need / (held + m - need)
        assert jaccard >= 1 or (1 - jaccard) ** license.bands(m, stride) <= license.MISSED


def test_license_scan_on_awkward_rows(spark):
    text = " ".join(words(70, 3)) + " Permission is hereby GRANTED, free of charge, to any person obtaining a copy of this software and the associated documentation files, " + " ".join(words(50, 4))
    docs = awkward(spark).select("doc_id", "text", "row").unionByName(frame(spark, [(20, text, 1), (21, "all  RIGHTS reserved", 1), (22, "rights all reserved", 1)], DOC + ", row int"))
    got = {(r["doc_id"], r["license_id"]): r["containment"] for r in license.scan(docs).collect()}
    assert set(got) == {(20, "mit-text"), (21, "reserved")} and 0.75 <= got[20, "mit-text"] < 1 == got[21, "reserved"]
    assert license.scan(docs.limit(0)).count() == 0 and license.scan(docs, {}).count() == 0


def test_every_license_is_found_and_nothing_else(spark):
    """Brute force over all windows: each text between other words, whole and with a word in twelve changed."""
    rows, r = [], random.Random(2)
    for i, (name, text) in enumerate(sorted(license.NOTICES.items())):
        rows.append((2 * i, " ".join(words(40, i)) + " " + text.upper() + " " + " ".join(words(60, i + 1))))
        w = text.split()
        rows.append((2 * i + 1, " ".join(w[k] if (k + 3) % 24 else "changed" for k in range(len(w)))))
    got = {(x["doc_id"], x["license_id"]): (x["containment"], x["first_word"], x["n_windows"]) for x in license.scan(frame(spark, rows)).collect()}
    split = lambda t: [x for x in re.split(r"[\W_]+", t.lower()) if x]
    want = {}
    for name, text in license.NOTICES.items():
        t = split(text)
        width, stride, held = license.shape(len(t))
        own = {tuple(t[k : k + width]) for k in range(len(t) - width + 1)}
        for i, text in rows:
            w = split(text)
            every = [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]
            shares = {a: len(own & set(every[a : a + held])) / len(own) for a in range(0, max(1, len(every)), stride)}
            fine = {a: x for a, x in shares.items() if x >= 0.75}
            if fine:
                want[i, name] = (round(max(fine.values()), 6), min(fine), len(fine))
    assert got == want and {(2 * i, n) for i, n in enumerate(sorted(license.NOTICES))} <= set(got)


# 10: chat


def test_round_trip():
    r = random.Random(8)
    bits = [*chat.CONTROL, "\\", "\\\\", "<", "<|turn", "|>", "s>", " ", "\n", "a", "é", "[INST", "</s", "<<"]
    for _ in range(3000):
        turns = [(r.choice(["user", "assistant", "system", "tool", "", "<|turn|>"]), "".join(r.choice(bits) for _ in range(r.randint(0, 9)))) for _ in range(r.randint(0, 5))]
        text, loss = chat.format_turns(turns)
        assert [(x[0], x[1]) for x in chat.parse(text)] == turns
        assert [chat.unescape(text[a:b]) for a, b in loss] == [t for role, t in turns if role == "assistant"]


def test_chat_query(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (2**60 + 1, 0, "user", "big"), (-(2**60) - 1, 0, "user", "big"), (1, 1, "assistant", "yo</s>"), (1, 600, "assistant", None), (2, None, "user", ""), (2, 0, None, "x"), (None, 0, "user", "n"), (1, 1, "assistant", "yo</s>")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries()["op10_chat_format"](spark, str(tmp_path)).collect()}

    def digest(turns):
        return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()

    assert got[1]["turns_sha256"] == digest([("user", "hi"), ("assistant", "yo</s>"), ("assistant", "yo</s>"), ("assistant", "")])
    assert got[1]["loss_sha256"] == hashlib.sha256(b"yo</s>yo</s>").hexdigest() and got[1]["loss_chars"] == 12 and got[1]["n_turns"] == 4
    assert got[2]["turns_sha256"] == digest([("user", ""), ("", "x")]) and got[None]["n_turns"] == 1
    said = "</s>[INST] ok [/INST]"
    assert got[-1]["turns_sha256"] == digest([("user", said), ("assistant", said)]) and got[-1]["loss_chars"] == len(said)


# the pipeline


def test_pipeline_stages(spark, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for (name, stage), nxt in zip(p.STAGES, [*p.STAGES[1:], None]):
        out = common.materialize(stage(spark, docs, small), f"t-{name}")
        if nxt:
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
            if name == "near_dedup":
                kept = {i for i, (_, low) in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()]).items() if i == low}
                assert {r["doc_id"] for r in out.collect()} == kept
        else:
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
        docs = out


def test_held_out_is_by_crc(spark):
    assert [r[0] for r in frame(spark, [(7, ""), (123, "")]).select(crc()).collect()] == [zlib.crc32(b"7"), zlib.crc32(b"123")]


def test_pipeline_keeps_rows_apart(spark, tmp_path):
    import corpus_pipeline as p

    a, b, c, item = (" ".join(words(60, seed)) for seed in (31, 32, 33, 34))
    frame(spark, [(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, a), (None, a + " more"), (None, None), (1, a), (2, a + " more"), (2, b), (3, b + " more"), (4, c), (4, c + " more"), (5, None), (5, "")]
    got = [tuple(r) for r in p.drop_near(spark, frame(spark, rows), str(tmp_path)).collect()]
    both = [r for r in got if r[0] == 4]
    want = [(None, a), (None, a + " more"), (None, None), (1, a), (2, b), (5, None), (5, "")]
    assert len(both) == 1 and both[0] in rows and sorted(map(str, got)) == sorted(map(str, want + both))
    rows = [(None, item), (None, a), (None, None), (7, b + " " + item), (7, b), (7, None)]
    got = [tuple(r) for r in p.drop_leaks(spark, frame(spark, rows), str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, a), (None, None), (7, b), (7, None)]))


def test_near_dedup_numbers_rows_without_moving_texts(spark, tmp_path, monkeypatch):
    import corpus_pipeline as p

    plans, own = [], common.materialize
    monkeypatch.setattr(p, "materialize", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), own(df, name))[1])
    a = " ".join(words(60, 35))
    # copies of one document stay or go together, wherever they stand; the smallest doc_id of a component stays
    rows = [(9, a), (4, a + " more"), (4, a + " more"), (-2, a + " yet more"), (-2, a + " yet more"), (7, ""), (7, "")]
    got = [tuple(r) for r in p.drop_near(spark, frame(spark, rows).repartition(3), str(tmp_path)).collect()]
    assert sorted(got) == [(-2, a + " yet more")] * 2 + [(7, "")] * 2
    got = p.drop_near(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), str(tmp_path))
    assert got.count() > 0 and [x for x in plans if "text" in x[1]][-1][1].count("Exchange") == 0


def test_near_dedup_leaves_no_plan_that_holds_the_components_twice(spark, tmp_path):
    """What is left after the components is read from a table, so the driver doesn't plan their making again and again."""
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = p.drop_near(spark, docs, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation") <= 5 and plan.count("Join") <= 3
