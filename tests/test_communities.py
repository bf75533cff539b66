"""Communities against the same rounds in plain Python, and how often a round goes over the edges."""

import random
from collections import Counter, defaultdict

from tidewatch.operators import communities, graph


def plain(pairs: list[tuple[str, str]]) -> tuple[set, int]:
    """The groups of three nodes and more, and the number of rounds tried."""
    weight = Counter()
    for a, b in pairs:
        if a != b:
            weight[a, b] += 1
            weight[b, a] += 1
    total, name, tried = float(sum(weight.values())), {a: a for a, _ in weight}, 0

    def modularity(k, label):
        sigma = Counter()
        for a in k:
            sigma[label[a]] += k[a]
        return sum(w for (a, b), w in weight.items() if label[a] == label[b]) / total - sum(s * s for s in sigma.values()) / total**2

    while True:
        k = Counter()
        for (a, _), w in weight.items():
            k[a] += w
        label = {a: a for a in k}
        best, r, quiet, changed = modularity(k, label), 0, 0, False
        while quiet < 2:
            sigma, new = Counter(), dict(label)
            for a in k:
                sigma[label[a]] += k[a]
            for a in k:
                links = Counter()
                for (x, b), w in weight.items():
                    if x == a != b:
                        links[label[b]] += w
                gain = {c: round(w - k[a] * (sigma[c] - k[a] * (c == label[a])) / total, 9) for c, w in links.items()}
                stay = gain.get(label[a], round(-k[a] * (sigma[label[a]] - k[a]) / total, 9))
                if gain and max(gain.values()) > stay:
                    to = min(c for c in gain if gain[c] == max(gain.values()))
                    if (to < label[a]) if r % 2 == 0 else (to > label[a]):
                        new[a] = to
            r, tried = r + 1, tried + (new != label)
            if new != label and modularity(k, new) > best + 1e-9:
                best, quiet, changed, label = modularity(k, new), 0, True, new
            else:
                quiet += 1
        if not changed:
            break
        name = {i: label[c] for i, c in name.items()}
        smaller = Counter()
        for (a, b), w in weight.items():
            smaller[label[a], label[b]] += w
        weight = smaller
    groups = defaultdict(set)
    for i, c in name.items():
        groups[c].add(i)
    return {(min(g), i) for g in groups.values() if len(g) >= 3 for i in g}, tried


def test_communities_equal_plain_rounds_and_a_round_writes_once(spark, monkeypatch):
    rng, written, own = random.Random(5), Counter(), graph.Rounds.write
    pairs = [(f"N{g * 9 + rng.randrange(9)}", f"N{(g * 9 + rng.randrange(11)) % 54}") for g in range(6) for _ in range(22)]
    want, tried = plain(pairs)

    def write(self, df, name):
        written[name] += 1
        return own(self, df, name)

    monkeypatch.setattr(graph.Rounds, "write", write)
    monkeypatch.setattr(communities, "PART", 50, raising=False)
    got = communities.communities(spark.createDataFrame(pairs, "src string, dst string")).collect()
    assert {(r["community"], r["id"]) for r in got} == want and tried > 3
    levels = written["name"] + 1
    # a table of nodes at the start of each level and for each round that has moves: none where none would move
    assert sum(written.values()) - written["graph"] - written["name"] - written["weights"] - written["ids"] == levels + tried
