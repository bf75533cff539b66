"""Names against a watchlist with aliases: the token index finds what comparing all pairs finds."""

import random
import time

import numpy as np
import pytest

from tidewatch.operators import names

FIRST = ["john", "jon", "joan", "mary", "marie", "kofi", "kwame", "ama", "abena", "josé", "muhammad", "mohammed", "o", "x"]
LAST = ["smith", "smyth", "smit", "schmidt", "mensah", "mensa", "boateng", "boatin", "nkrumah", "van", "der", "berg", "berge", "knight", "night"]


def some_name(r):
    own = [r.choice(FIRST + LAST) for _ in range(r.choice([1, 2, 2, 3, 3, 4, 5]))]
    if r.random() < 0.4:
        i = r.randrange(len(own))
        at = r.randrange(len(own[i]))
        own[i] = own[i][:at] + r.choice("abefnst") + own[i][at + r.randrange(2) :]
    return r.choice([" ", "-", "  "]).join(x.title() if r.random() < 0.5 else x for x in own)


def brute(queries, listed, threshold):
    out = {}
    for i, name in queries:
        rated = []
        for entry, main, aliases in listed:
            for other in [main, *(aliases or [])]:
                score = round(names.match(names.plain(name), names.plain(other)), 6)
                if score >= threshold:
                    rated.append((-score, entry))
        if rated:
            out[i] = (min(rated)[1], -min(rated)[0])
    return out


@pytest.mark.parametrize("threshold", [0.85, 0.75, 0.95])
@pytest.mark.parametrize("chunk", [4000, 7])
def test_equals_all_pairs(spark, monkeypatch, threshold, chunk):
    """Also where sounds are cut in parts of seven names."""
    monkeypatch.setattr(names, "CHUNK", chunk)
    r = random.Random(f"{threshold}{chunk}")
    queries = [(i, some_name(r)) for i in range(70)] + [(100, None), (101, ""), (102, "--"), (103, "12 34"), (104, "12 34")]
    listed = [(i, some_name(r), [some_name(r) for _ in range(r.randrange(3))] if r.random() < 0.7 else None) for i in range(80)] + [(200, "", ["34 12"]), (201, None, ["Ama Boateng"]), (202, "Ama  Boateng", [])]
    got = names.check_names(spark.createDataFrame(queries, "query_id long, name string"), spark.createDataFrame(listed, "entry_id long, name string, aliases array<string>"), threshold)
    rows = got.collect()
    assert {r["query_id"]: (r["entry_id"], r["score"]) for r in rows} == brute(queries, listed, threshold)
    assert all(r["score"] == round(names.match(names.plain(dict(queries)[r["query_id"]]), names.plain(r["matched"])), 6) for r in rows)
    assert len(rows) > 15 and all(0 < r["candidates"] < 240 for r in rows)


def test_bounds_hold():
    """No pair is more similar than its bound, and tokens are found whatever their letters."""
    r = random.Random(3)
    words = ["".join(r.choice("aabcdeé7z\U0001f600") for _ in range(r.randrange(1, 9))) for _ in range(250)]
    held = names.Tokens(sorted(set(words)))
    for w in words[:60] + ["aaaaaa", "b"]:
        for least in (0.3, 0.6, 0.8, 1.0):
            near = set(held.similar(w, least))
            assert {x for x in held.tokens if names.jaro_winkler(w, x) >= least} <= near
    assert np.mean([len(held.similar(w, 0.8)) for w in words]) < len(held.tokens) / 3


def test_common_sound_does_not_mean_all_pairs():
    """2,000 names of one last name: the other token decides which are compared."""
    r = random.Random(5)
    first = ["".join(r.choice("bcdfghjklmnprstvz") + r.choice("aeiou") for _ in range(3)) for _ in range(400)]
    rows = sorted({f"{r.choice(first)} {r.choice(first)} mensahkoffi" for _ in range(2000)})
    s, m = names.soundex("mensahkoffi"), names.metaphone("mensahkoffi")
    listed = [(k, s, m, k.split(" "), (i, k)) for i, k in enumerate(rows)]
    found = names.compare([(k, s, m, k.split(" ")) for k in rows[:100]], listed, 0.85, True)
    assert all(x[1] == x[0] and x[2] == 1.0 for x in found) and np.mean([x[3] for x in found]) < len(rows) / 3


def test_jaro_winkler_of_many_is_that_of_each_and_faster():
    rng = random.Random(8)
    word = lambda most: "".join(rng.choice("abcdé\0ß中😀") for _ in range(rng.randrange(most)))
    pairs = [(word(12), word(12)) for _ in range(20000)] + [(word(70), word(70)) for _ in range(300)] + [("", ""), ("", "a"), ("a", ""), ("a", "a"), ("a", "b"), ("é" * 60, "é" * 60)]
    a, b = map(list, zip(*pairs))
    began = time.process_time()
    each = [names.jaro_winkler(x, y) for x, y in pairs]
    between = time.process_time()
    many = names.jaro_winkler_all(a, b).tolist()
    assert many == each
    assert 2 * (time.process_time() - between) < between - began
    assert len(names.jaro_winkler_all([], [])) == 0
