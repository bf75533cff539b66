"""Fuzzy name matching against a watchlist: lossless phonetic blocking, then a score over tokens."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The letter codes of Soundex.
CODES = {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6"}
_CODE = {c: d for letters, d in CODES.items() for c in letters}
# Silent beginnings, and what letters sound like (before a soft vowel, before H, else).
BEGINNINGS = {"AE": "E", "GN": "N", "KN": "N", "PN": "N", "WR": "R", "WH": "W"}
BEFORE_H = {"C": "X", "G": "F", "P": "F", "S": "X", "T": "0"}
BEFORE_SOFT = {"C": "S", "G": "J"}
SOUNDS = {"B": "B", "C": "K", "D": "T", "F": "F", "G": "K", "J": "J", "K": "K", "L": "L", "M": "M", "N": "N", "P": "P", "Q": "K", "R": "R", "S": "S", "T": "T", "V": "F", "X": "KS", "Z": "S"}


def plain(name: str | None) -> list[str]:
    """Tokens in small letters, without marks and punctuation."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(c))
    return re.sub(r"[^\w\s]", " ", folded.lower()).split()


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach, free, pairs = max(len(a), len(b)) // 2 - 1, list(range(len(b))), []
    for i, c in enumerate(a):
        j = next((j for j in free if i - reach <= j <= i + reach and b[j] == c), None)
        if j is not None:
            free.remove(j)
            pairs.append((c, j))
    if not pairs:
        return 0.0
    moved = sum(c != b[j] for (c, _), j in zip(pairs, sorted(j for _, j in pairs))) // 2
    m = len(pairs)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """The prefix boost has no floor."""
    j = jaro(a, b)
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return j + same * 0.1 * (1 - j)


def soundex(word: str) -> str:
    """H and W part equal codes as vowels do."""
    letters = [c for c in word.upper() if c.isalpha()]
    codes = [_CODE.get(c, "") for c in letters]
    kept = [c for i, c in enumerate(codes) if i and c and c != codes[i - 1]]
    return (letters[0] + "".join(kept) + "000")[:4] if letters else ""


def metaphone(word: str) -> str:
    """Simplified: vowels only at the start, digraphs with H, soft C and G; six characters."""
    s = "".join(c for c in word.upper() if c.isalpha())
    if s[:2] in BEGINNINGS:
        s = BEGINNINGS[s[:2]] + s[2:]
    out, skip = "", False
    for i, c in enumerate(s):
        if skip:
            skip = False
            continue
        following = s[i + 1 : i + 2]
        soft = following in tuple("EIY")
        if c in "AEIOU":
            out += c if i == 0 else ""
        elif following == "H" and c in BEFORE_H:
            out, skip = out + BEFORE_H[c], True
        elif soft and c in BEFORE_SOFT:
            out += BEFORE_SOFT[c]
        elif c == "D" and following == "G" and s[i + 2 : i + 3] in tuple("EIY"):
            out, skip = out + "J", True
        elif c == "H":
            out += "H" if out[-1:] in tuple("AEIOU") else ""
        elif c in "WY":
            out += c if following in tuple("AEIOU") else ""
        else:
            out += SOUNDS.get(c, "")
    return out[:6]


def match(query: list[str], other: list[str], similarity=jaro_winkler) -> float:
    """min(1, 0.7 * mean Jaro-Winkler of the greedy pairs + 0.15 for each equal sound of the longest tokens)."""
    if not query or not other:
        return 0.0
    left, best = list(other), []
    for q in query:
        if left:
            rated = [similarity(q, c) for c in left]
            best.append(max(rated))
            left.pop(rated.index(max(rated)))
    a, b = max(query, key=len), max(other, key=len)
    bonus = sum(0.15 for f in (soundex, metaphone) if f(a) == f(b) != "")
    return min(1.0, 0.7 * sum(best) / len(best) + bonus)


LONG = 48  # characters of a word from which on pairs are compared one by one


def jaro_winkler_all(a: list[str], b: list[str]) -> np.ndarray:
    """jaro_winkler of each pair. Pairs of like length are compared at once, a character of all first words at a time."""
    out = np.zeros(len(a))
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    size = np.maximum(n, m)
    for i in np.flatnonzero(size > LONG):
        out[i] = jaro_winkler(a[i], b[i])
    for low in range(0, LONG, 4):
        near = np.flatnonzero((size > low) & (size <= low + 4))
        for at in np.split(near, range(8192, len(near), 8192)):
            if len(at):
                out[at] = _jaro_winkler_block([a[i] for i in at], [b[i] for i in at], n[at], m[at], low + 4)
    out[size == 0] = 1.0  # both empty
    return out


def _jaro_winkler_block(a: list[str], b: list[str], n: np.ndarray, m: np.ndarray, width: int) -> np.ndarray:
    x, y = (np.array(s, f"U{width}").view(np.uint32).reshape(len(s), width) for s in (a, b))
    place = np.arange(width)
    reach, free, matched = np.maximum(n, m) // 2 - 1, place < m[:, None], np.zeros(x.shape, bool)
    for i in range(width):
        fits = free & (y == x[:, i, None]) & (np.abs(place - i) <= reach[:, None]) & (i < n)[:, None]
        j, matched[:, i] = fits.argmax(axis=1), fits.any(axis=1)
        rows = np.flatnonzero(matched[:, i])
        free[rows, j[rows]] = False
    taken, pairs = ~free & (place < m[:, None]), matched.sum(axis=1)
    # the matched characters of both in their order
    first, second = (np.take_along_axis(s, np.argsort(~k, axis=1, kind="stable"), axis=1) for s, k in ((x, matched), (y, taken)))
    moved = ((first != second) & (place < pairs[:, None])).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        j = np.where(pairs > 0, (pairs / n + pairs / m + (pairs - moved) / pairs) / 3, 0.0)
    equal = (n == m) & ((x == y) | (place >= n[:, None])).all(axis=1)
    j = np.where(equal, 1.0, j)
    same = np.cumprod((x == y)[:, :4] & (place[:4] < np.minimum(n, m)[:, None]), axis=1).sum(axis=1)
    return j + same * 0.1 * (1 - j)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(jaro_winkler_all(a.tolist(), b.tolist()), dtype=float)


@F.pandas_udf(T.StructType([T.StructField("soundex", T.StringType()), T.StructField("metaphone", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))]))
def sounds_udf(name: pd.Series) -> pd.DataFrame:
    rows = [plain(x) for x in name]
    main = [max(r, key=len) if r else "" for r in rows]
    return pd.DataFrame({"soundex": [soundex(m) for m in main], "metaphone": [metaphone(m) for m in main], "tokens": rows})


CHUNK = 4000  # names of each side that a task compares
LETTERS = 38  # a to z, digits, all else in two parts
REPEATS = 3  # occurrences of a letter that are told apart


def letters(tokens: list[str]) -> np.ndarray:
    """A row for each token: whether it has each letter once, twice, three times or more, as 0 and 1."""
    out = np.zeros((len(tokens), LETTERS, REPEATS), np.float32)
    for i, token in enumerate(tokens):
        for c in token:
            at = ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) - 48 if "0" <= c <= "9" else 36 + ord(c) % 2
            free = np.flatnonzero(out[i, at] == 0)
            if len(free):
                out[i, at, free[0]] = 1
    return out.reshape(len(tokens), -1)


class Tokens:
    """The different tokens of some names, and for any token those of them that may be similar to it.

    Jaro-Winkler is bounded before it is worked out: two tokens match in no more letters than they have in common (letters
    beyond the third of a kind may all match), whatever their order, and the beginning they share is known.
    """

    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, {t: i for i, t in enumerate(tokens)}
        self.letters, self.size = letters(tokens), np.array([len(t) for t in tokens], float)
        self.starts = np.array([[ord(c) for c in (t + "\0\0\0\0")[:4]] for t in tokens]).reshape(-1, 4)
        self.beyond = self.size - self.letters.sum(axis=1)
        self.held: dict = {}

    def similar(self, token: str, least: float) -> list[str]:
        """All tokens whose similarity to token is `least` or more."""
        if least > 1 - 1e-9:
            return [token] if token in self.at else []
        own = self.held.get(token)
        if own is None:
            mine = letters([token])[0]
            most = np.minimum(self.size, len(token))
            common = np.where(self.beyond + len(token) > mine.sum(), most, np.minimum(self.letters @ mine, most))
            bound = np.where(common > 0, (common / self.size + common / len(token) + 1) / 3, 0.0)
            start = np.array([ord(c) for c in (token + "\1\1\1\1")[:4]])
            same = np.cumprod(self.starts == start, axis=1).sum(axis=1)
            own = self.held[token] = bound + same * 0.1 * (1 - bound)
        return [self.tokens[i] for i in np.flatnonzero(own >= least - 1e-9)]


def needed(threshold: float, sounds: int) -> float:
    """The mean similarity of the pairs that a score needs, with so many equal sounds."""
    return (threshold - 0.15 * sounds) / 0.7


def candidates(query: list[str], index: dict, tokens: Tokens, mean: float) -> set:
    """Names of the index that may have `mean` or more with query.

    index: number of tokens -> token -> names. As many of the query's first tokens are paired as the shorter name has, p.
    If the mean is reached, any s of the p pairs have one of at least 1 - p (1 - mean) / s. Of the first p tokens the
    half that has the fewest names is asked for.
    """
    found: set = set()
    for size, own in index.items():
        p = min(size, len(query))
        s = (p + 1) // 2
        least = 1 - p * (1 - mean) / s
        asked = []
        for token in dict.fromkeys(query[:p]):
            near = tokens.similar(token, least)
            asked.append((sum(len(own.get(t, ())) for t in near), near))
        asked.sort(key=lambda x: x[0])
        # s pairs: where a token is repeated, fewer different ones stand for as many pairs or more
        for _, near in asked[: min(s, len(asked))]:
            for t in near:
                found.update(own.get(t, ()))
    return found


def compare(queries: list[tuple], listed: list[tuple], threshold: float, by_soundex: bool) -> list[tuple]:
    """(query, listed name, score, number of candidates) of each query's best name at or above threshold.

    queries, listed: (id, soundex, metaphone, tokens), all with one soundex, or, if not by_soundex, with one metaphone,
    where pairs of one soundex are left out. A listed name has its rank behind, and ties go to the smaller one.
    """
    groups: dict = {}
    for row in listed:
        groups.setdefault(row[2] if by_soundex else row[1], []).append(row)
    index, held = {}, {}
    for key, rows in groups.items():
        for i, _, _, own, _ in rows:
            for t in set(own):
                index.setdefault(key, {}).setdefault(len(own), {}).setdefault(t, []).append(i)
        held[key] = Tokens(sorted({t for r in rows for t in r[3]}))
    names, ranks, memo, out = {r[0]: r[3] for r in listed}, {r[0]: r[4] for r in listed}, {}, []

    def similarity(a: str, b: str) -> float:
        if (a, b) not in memo:
            memo[a, b] = jaro_winkler(a, b)
        return memo[a, b]

    for i, soundex_, metaphone_, own in queries:
        best, n = None, 0
        for key in groups:
            both = key == (metaphone_ if by_soundex else soundex_) and key != ""
            if both and not by_soundex:
                continue  # met by its soundex
            for c in candidates(own, index[key], held[key], needed(threshold, 2 if both else 1)):
                n += 1
                score = round(match(own, names[c], similarity), 6)
                if score >= threshold and (best is None or (-score, ranks[c]) < (-best[1], ranks[best[0]])):
                    best = (c, score)
        out.append((i, *(best or (None, None)), n))
    return out


def check_names(queries: DataFrame, watchlist: DataFrame, threshold: float = 0.85) -> DataFrame:
    """query_id, entry_id, score, matched, candidates: each query's best entry at or above threshold.

    queries: query_id, name. watchlist: entry_id, name and, if there, aliases (array): an entry's score is that of the best
    of them, matched. Ties go to the smaller entry_id, then the smaller name. candidates: how many names the query's name
    was compared with in full. Null and empty names match nothing; equal names are looked up once.

    Without an equal sound a score is 0.7 at most, so names meet by the Soundex or the Metaphone of their longest token. A
    sound that very many names have is cut in parts of CHUNK names; parts meet parts, names go as rows of one side, and no
    row stands for a pair. In a part, names are found by tokens: a score asks for a mean similarity of the paired tokens,
    so some of the rarer ones must be similar to a token of the other name.
    """
    if threshold <= 0.7:
        raise ValueError("names meet by sounds, which is lossless above 0.7 only")
    aliases = F.coalesce(F.col("aliases"), F.array().cast("array<string>")) if "aliases" in watchlist.columns else F.array().cast("array<string>")
    every = watchlist.select("entry_id", F.explode(F.concat(F.array("name"), aliases)).alias("name")).where("name is not null")

    def sounded(df: DataFrame) -> DataFrame:
        # a name is its tokens: what differs in marks and capitals only is one name
        own = df.select("name").distinct().withColumn("s", sounds_udf("name")).select("name", "s.*").where("size(tokens) > 0")
        return own.withColumn("key", F.array_join("tokens", " "))

    w = every.join(sounded(every), "name")
    first = w.groupBy("key").agg(F.min(F.struct("entry_id", "name")).alias("e"), F.first("soundex").alias("soundex"), F.first("metaphone").alias("metaphone"))
    asked = sounded(queries)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("code")) for k in ("soundex", "metaphone")])).alias("x")
    side = lambda df: df.select("key", "soundex", "metaphone").distinct().select("*", kinds).select("key", "soundex", "metaphone", "x.*").where("code <> ''")
    left, right = side(asked), side(first).join(first.select("key", "e"), "key").select("kind", "code", "key", "soundex", "metaphone", "e.*")
    parts = lambda df, name: df.groupBy("kind", "code").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    sizes = parts(left, "l_parts").join(parts(right, "r_parts"), ["kind", "code"])
    part = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(sizes, ["kind", "code"]).withColumns({"l": part("l_parts"), "r": upto("r_parts")})
    right = right.join(sizes, ["kind", "code"]).withColumns({"r": part("r_parts"), "l": upto("l_parts")})

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        asked, listed = ([(r.key, r.soundex, r.metaphone, r.key.split(" ")) for r in x.itertuples(index=False)] for x in (a, b))
        listed = [(*r, rank) for r, rank in zip(listed, zip(b["entry_id"], b["name"]))]
        found = compare(asked, listed, threshold, a["kind"].iloc[0] == "soundex") if len(a) and len(b) else []
        return pd.DataFrame(found, columns=["asked", "found", "score", "n"]).astype({"asked": object, "found": object, "score": float, "n": "int64"})

    keys, columns = ["kind", "code", "l", "r"], ["key", "soundex", "metaphone"]
    met = left.select(*keys, *columns).groupBy(*keys).cogroup(right.select(*keys, *columns, "entry_id", "name").groupBy(*keys)).applyInPandas(run, "asked string, found string, score double, n long")
    names = first.select(F.col("key").alias("found"), "e.entry_id", F.col("e.name").alias("matched"))
    rated = met.join(names, "found", "left")
    best = rated.groupBy("asked").agg(F.min_by(F.struct("entry_id", "score", "matched"), F.when(F.col("found").isNotNull(), F.struct(-F.col("score"), "entry_id", "matched"))).alias("b"), F.sum("n").alias("candidates"))
    best = best.where("b.entry_id is not null").select(F.col("asked").alias("key"), "b.*", "candidates")
    return queries.select("query_id", "name").join(asked.select("name", "key"), "name").join(best, "key").select("query_id", "entry_id", "score", "matched", "candidates")


def severity(score: Column) -> Column:
    return F.when(score >= 0.95, "critical").when(score >= 0.9, "high").otherwise("medium")


