"""op12: counts by tries and their runs, and the ranking, against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewatch.llm import phrases

DOC = "doc_id long, text string, lang string"


def brute(rows, least=10, top=2000, longest=3, covered=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(n, seed, vocabulary=12, size=60):
    r = random.Random(seed)
    words = [f"{x}{i}" for i in range(vocabulary) for x in ("w", "É")]
    ends = [" ", " ", " ", " ", "\t ", ". ", ",", "\n", "\r\n", "\x0b", "!? "]
    return ["".join(r.choice(words).title() + r.choice(ends) for _ in range(r.randrange(size))) for _ in range(n)]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("entries", [phrases.ENTRIES, 300, 1])
def test_equals_plain_counting(spark, entries):
    """Also where tries spill after nearly every text."""
    rows = [(t, lang) for lang, seed in (("en", 1), ("de", 2), (None, 3), ("und", 4)) for t in texts(150, seed)]
    rows += [(None, "en"), ("", None), ("  \t\n", "fr"), ("a a a a a a a a a a a a a", "fr")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOC).repartition(3)
    assert rows_of(phrases.collocations(df, entries=entries)) == brute(rows)
    assert rows_of(phrases.collocations(df, least=3, top=7, longest=2, covered=20, entries=entries)) == brute(rows, 3, 7, 2, 20)


def test_tries_burst_and_slices_lose_nothing(monkeypatch):
    monkeypatch.setattr(phrases, "WORDS", 40)
    monkeypatch.setattr(phrases, "FEED", 16)
    for entries, burst in ((10**6, 4096), (10**6, 3), (60, 3), (60, 1)):
        own, got = phrases.Counter((1, 2, 3), None, entries, burst, feed=16), Counter()
        text = " ".join(texts(40, 5)).encode()
        found = [*own.read("x", text), *own.read("x", b""), *own.spill(0)]
        assert len(found) > 1
        for run in found:
            keys = [tuple(k.encode().partition(b"\n")[2].split()) for k in run.column("key").to_pylist()]
            assert keys == sorted(keys) and len(set(keys)) == len(keys)
            for k, n in zip(keys, run.column("n").to_pylist()):
                got[k] += n
        want = Counter()
        for piece in re.split(b"[.,;:!?\n\x0b\x0c\r]", bytes(c + 32 if 65 <= c <= 90 else c for c in text)):
            w = piece.split()
            want[()] += len(w)
            want.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
        assert got == want


def test_trie_bursts_at_branches():
    r = random.Random(8)
    for burst in (1, 2, 5, 50):
        trie, want = phrases.HatTrie(burst), Counter()
        for _ in range(30):
            some = Counter((r.randrange(1, 9) << 42) | (r.randrange(0, 9) << 21) | r.randrange(0, 9) for _ in range(60))
            codes = sorted(some)
            trie.add(np.array(codes), np.array([some[c] for c in codes]))
            want += some
            assert trie.entries == sum(map(len, trie.containers)) and trie.edges == sorted(trie.edges)
            for lo, hi, own in zip(trie.edges, [*trie.edges[1:], 1 << 63], trie.containers):
                assert all(lo <= k < hi for k in own) and lo % (1 << 21) == 0
                assert len(own) <= burst or len({k >> 21 for k in own}) == 1
            if r.random() < 0.4:
                keep = r.randrange(trie.entries)
                codes, counts = trie.take(keep)
                assert trie.entries <= keep
                want -= Counter(dict(zip(codes.tolist(), counts.tolist())))
        codes, counts = trie.take(0)
        assert dict(zip(codes.tolist(), counts.tolist())) == dict(want) and trie.entries == 0


def test_filter_lets_all_frequent_pairs_pass(spark):
    words = [f"w{i}" for i in range(50)] + ["é\x00", "\U0001f600"]
    pairs = [(a, b) for a in words for b in words if random.Random(a + b).random() < 0.3]
    bits = np.frombuffer(phrases.pair_filter(spark.createDataFrame([(f"{a} {b}",) for a, b in pairs], "phrase string")), np.uint8)
    own = phrases.Counter((3,), bits)
    list(own.read("x", " ".join(f"{a} {b}." for a in words for b in words).encode()))
    ids = np.array([own.ids[x.encode()] for a in words for b in words for x in (a, b)])
    passes = own._passes(ids)[::2]
    assert [p for p, ok in zip([(a, b) for a in words for b in words], passes) if ok] == pairs and len(bits) == 1 << (phrases.FILTER - 3)


def test_awkward_documents(spark):
    rows = [(1, None, None), (2, "", "en"), (None, "\x00 \x00 nul\x00 A a", "en"), (None, "\x00 \x00 nul\x00 A a", "en"), (5, "Long text " * 30_000, "en"), (6, "\U0001f600 é\xa0é \U0001f600", "en")]
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], DOC + ", n int, phrase string, first string, part int")
    assert rows_of(phrases.collocations(df, least=2)) == brute([(t, lang) for _, t, lang in rows], 2)
    assert phrases.collocations(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(df, longest=4)


def test_scores_do_not_overflow(spark):
    """a^2 * 10^6 passes 64 bits from about three million on."""
    a, left, right = 4 * 10**9, 5 * 10**9, 6 * 10**9
    from pyspark.sql import functions as F

    score = F.expr("(1000000 * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    assert spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(score).first()[0] == 10**6 * a * a // (left * right)
