"""Phrase collocations: counts of word sequences by HAT-tries whose subtrees spill as sorted runs, scored by their weakest cut."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, share, table

BITS = 21  # of a word id: three ids fit 64 bits
ENTRIES = 300_000  # phrases that the tries of a task hold; beyond it whole subtrees spill
BURST = 8192  # phrases of a container that is burst
FEED = 1 << 16  # words counted at once, and phrases of a batch that goes back
WORDS = 1 << 17  # different words that a task numbers before it starts anew
FILTER = 27  # 2^FILTER bits say which pairs are frequent: 16 MB, whatever the input
PARTS = (64, 8)  # parts of a language's ranking, before the last
ROWS = 1000  # texts of a batch that goes to Python
_LOW = (1 << BITS) - 1
# What parts pieces, and what parts words.
_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_END = b"A"  # capitals are gone when it is set
_TABLE = bytes(10 if c in _ENDS else 32 if c in _BLANKS else c + 32 if 65 <= c <= 90 else c for c in range(256))


class HatTrie:
    """Counts of phrases of one to three word ids: a trie over the first two ids, with hash containers under it.

    A phrase is its ids, packed, 0 behind the last. A container is a hash table for a run of neighbouring branches: all
    phrases from its edge up to the next edge. With over `burst` phrases it is burst where a first id begins, or, if all
    its phrases begin with the same id, where a second id begins; a pair's own branch is not divided.
    """

    def __init__(self, burst: int = BURST):
        self.burst, self.edges, self.containers, self.entries = burst, [0], [{}], 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """codes: sorted, distinct phrases; counts: how often each comes."""
        cuts = [*np.searchsorted(codes, self.edges).tolist(), len(codes)]
        keys, n = codes.tolist(), counts.tolist()
        edges, containers = [], []
        for edge, own, a, b in zip(self.edges, self.containers, cuts, cuts[1:]):
            more = dict(zip(keys[a:b], n[a:b]))
            for k in own.keys() & more.keys():
                more[k] += own[k]
            self.entries -= len(own)
            own.update(more)
            self.entries += len(own)
            for e, x in self._burst(edge, own):
                edges.append(e)
                containers.append(x)
        self.edges, self.containers = edges, containers

    def _burst(self, edge: int, own: dict) -> list[tuple[int, dict]]:
        if len(own) <= self.burst:
            return [(edge, own)]
        codes = np.sort(np.fromiter(own, np.int64, len(own)))
        for level in (2 * BITS, BITS):
            heads = codes >> level
            at = np.flatnonzero(heads[1:] != heads[:-1]) + 1  # where branches begin
            if len(at):
                # the first branch behind each half of a full container, so that most parts are half full, and the last
                half = max(1, self.burst // 2)
                cuts = np.unique([*at[np.searchsorted(at, np.arange(half, at[-1] + 1, half))], at[-1]]).tolist()
                keys, parts = codes.tolist(), []
                values = list(map(own.__getitem__, keys))
                for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                    parts += self._burst(edge if a == 0 else int(heads[a]) << level, dict(zip(keys[a:b], values[a:b])))
                return parts
        return [(edge, own)]

    def take(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Remove whole subtrees, the largest first, until at most `keep` phrases are left: their codes and counts."""
        taken = []
        for i in sorted(range(len(self.edges)), key=lambda i: -len(self.containers[i])):
            if self.entries <= keep:
                break
            taken.append(self.containers[i])
            self.containers[i] = {}
            self.entries -= len(taken[-1])
        held = [i for i, own in enumerate(self.containers) if own or i == 0]
        self.edges, self.containers = [self.edges[i] for i in held], [self.containers[i] for i in held]
        n = sum(map(len, taken))
        return np.fromiter(chain.from_iterable(taken), np.int64, n), np.fromiter(chain.from_iterable(x.values() for x in taken), np.int64, n)


class Names(dict):
    """Ids of words, in the order of their first use; 0 is the mark for the end of a piece."""

    def __init__(self):
        super().__init__({_END: 0})
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.words)
        self.words.append(word)
        return i


def places(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each pair of words, from the hashes of both; as `_PLACES` in SQL."""
    h = (first << np.uint64(1) | first >> np.uint64(63)) ^ second
    mask = np.uint64((1 << FILTER) - 1)
    return h & mask, (h >> np.uint64(FILTER)) & mask


_HASH = "(shiftleft(xxhash64(w[0]), 1) | shiftrightunsigned(xxhash64(w[0]), 63)) ^ xxhash64(w[1])"
_PLACES = f"transform(array(0, {FILTER}), i -> cast(shiftrightunsigned({_HASH}, i) & {(1 << FILTER) - 1} as int))"


class Counter:
    """The tries of a task, one for each language, over word ids of its own.

    sizes: how many words the counted phrases have. frequent: the bits of the filter; only phrases of three words whose
    pairs both pass it are counted.
    """

    def __init__(self, sizes: tuple = (1, 2, 3), frequent: np.ndarray | None = None, entries: int = ENTRIES, burst: int = BURST, feed: int = FEED):
        self.sizes, self.frequent, self.limit, self.burst, self.feed = sizes, frequent, entries, burst, feed
        self.ids, self.tries, self.held, self.total = Names(), {}, {}, {}

    def read(self, lang: str, text: bytes):
        """Take in a text; gives runs where the tries have grown too large. Id 0 ends a piece."""
        tokens, more = text.translate(_TABLE).replace(b"\n", b" " + _END + b" ").split(), max(self.sizes) - 1
        for at in range(0, max(1, len(tokens)), self.feed):
            part = tokens[at : at + self.feed + more]  # the words behind the slice end its phrases
            if len(self.ids.words) + len(part) > WORDS + FEED:
                yield from self.spill(0)
            own = np.zeros(len(part) + 1, np.int64)
            own[:-1] = np.fromiter(map(self.ids.__getitem__, part), np.int64, len(part))
            held = self.held.setdefault(lang, [[], 0])
            held[0].append((own, min(self.feed, len(tokens) - at)))
            held[1] += len(part) + 1
            if held[1] >= self.feed:
                yield from self.count(lang)

    def count(self, lang: str):
        """Move the words that wait into the trie."""
        waiting, _ = self.held.pop(lang, ([], 0))
        if not waiting:
            return
        ids = np.concatenate([x for x, _ in waiting])
        start = np.concatenate([np.arange(len(x)) < n for x, n in waiting]) & (ids > 0)
        if 1 in self.sizes:
            self.total[lang] = self.total.get(lang, 0) + int(start.sum())
        code, codes = ids << (2 * BITS), []
        for k in range(1, max(self.sizes) + 1):
            if k > 1:
                start = start[:-1] & (ids[k - 1 :] > 0)
                code = code[:-1] | (ids[k - 1 :] << (BITS * (3 - k)))
            if k == 3 and self.frequent is not None:
                own = self._passes(ids)
                start = start & own[:-1] & own[1:]
            if k in self.sizes:
                codes.append(code[start])
        trie = self.tries.setdefault(lang, HatTrie(self.burst))
        trie.add(*np.unique(np.concatenate(codes), return_counts=True))
        if sum(t.entries for t in self.tries.values()) > self.limit:
            yield from self.spill(self.limit // 2)

    def _passes(self, ids: np.ndarray) -> np.ndarray:
        used, at = np.unique(ids, return_inverse=True)
        h = np.array([xxhash.xxh64_intdigest(self.ids.words[i], 42) for i in used.tolist()], np.uint64)[at]
        one, two = ((self.frequent[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 for p in places(h[:-1], h[1:]))
        return (one & two).astype(bool)

    def spill(self, keep: int):
        """Runs of whole subtrees, sorted by their words; with keep 0 of all that is held, after which ids start anew."""
        if keep == 0:
            for lang in list(self.held):
                yield from self.count(lang)
        every = sum(t.entries for t in self.tries.values())
        for lang, trie in self.tries.items():
            codes, counts = trie.take(keep * trie.entries // every if every else 0)
            if len(codes):
                yield self._run(lang, codes, counts)
        if keep == 0:
            self.ids, self.tries = Names(), {}
            if self.total:
                yield pa.RecordBatch.from_arrays([pa.array([f"{lang}\n" for lang in self.total]), pa.array(self.total.values(), pa.int64())], names=["key", "n"])
            self.total = {}

    def _run(self, lang: str, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        parts = [p for p in (codes >> 2 * BITS, (codes >> BITS) & _LOW, codes & _LOW) if p.any()]
        used = np.unique(np.concatenate(parts))
        words = [self.ids.words[i] for i in used.tolist()]
        place = sorted(range(len(words)), key=words.__getitem__)
        rank = np.zeros(int(used[-1]) + 1, np.int64)
        rank[used[place]] = np.arange(len(words))
        ranks = [rank[p] for p in parts]
        order = np.argsort(sum(r << (BITS * (2 - i)) for i, r in enumerate(ranks)))
        names = pa.array([words[i] for i in place], pa.binary()).cast(pa.string())
        cols = [names.take(pa.array(r[order], mask=p[order] == 0)) for r, p in zip(ranks, parts)]
        phrase = pc.binary_join_element_wise(*cols, pa.scalar(" "), null_handling="skip")
        return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(pa.scalar(f"{lang}\n"), phrase, ""), pa.array(counts[order])], names=["key", "n"])


def runs(docs: DataFrame, sizes: tuple, frequent: bytes | None = None, entries: int = ENTRIES) -> DataFrame:
    """key (language, line end, phrase), n: the sorted runs of all tasks.

    With phrases of one word, a run also has the number of words of each language, under the key without a phrase.
    frequent, bits of a fixed number, is broadcast.
    """
    held = None if frequent is None else share(docs.sparkSession, frequent)

    def found(batches):
        own = Counter(sizes, None if held is None else np.frombuffer(held(), np.uint8), entries)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if text.is_valid:
                    yield from own.read(lang, text.as_py())
        yield from own.spill(0)

    def count(batches):
        for run in found(batches):
            for at in range(0, run.num_rows, FEED):
                yield run.slice(at, FEED)

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(count, "key string, n long")


def merged(rows: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, k, f) of the runs' phrases that come `least` times or more; k is 0 for the words of a language.

    Runs meet by the whole key, of which the words are a prefix of longer phrases' keys: what begins with a frequent
    word or pair is as many keys, so no partition is hot, and a task sends a phrase once for each of its runs.
    """
    own = rows.groupBy("key").agg(F.sum("n").alias("f"))
    phrase = F.substring_index("key", "\n", -1)
    k = F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ")))
    out = own.select(F.expr("left(key, length(key) - length(substring_index(key, '\n', -1)) - 1)").alias("lang"), phrase.alias("phrase"), k.alias("k"), "f")
    return out.where((F.col("f") >= least) | (F.col("k") == 0))


def pair_filter(pairs: DataFrame) -> bytes:
    """Bits for the places of each phrase of two words. Their number is fixed, so it may be broadcast."""

    @F.pandas_udf("binary")
    def packed(sets: pd.Series) -> pd.Series:
        def pack(own):
            bits = np.zeros(1 << 16, np.uint8)
            bits[np.asarray(own, np.int64)] = 1
            return np.packbits(bits, bitorder="little").tobytes()

        return sets.map(pack)

    place = pairs.select(F.split("phrase", " ").alias("w")).select(F.explode(F.expr(_PLACES)).alias("p"))
    blocks = place.groupBy(F.shiftright("p", 16).alias("block")).agg(F.collect_set(F.col("p").bitwiseAND(0xFFFF)).alias("own")).select("block", packed("own").alias("bits"))
    out = bytearray(1 << (FILTER - 3))
    for r in blocks.toLocalIterator():
        out[r["block"] << 13 : (r["block"] + 1) << 13] = r["bits"]
    return bytes(out)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table, made with small batches, as texts may be long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(ROWS))
    try:
        return materialize(df, name)
    finally:
        conf.set(key, before)


def frequencies(docs: DataFrame, least: int, longest: int = 3, entries: int = ENTRIES) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f) of phrases of up to `longest` words that come `least` times or more, (lang, n) of all words).

    Words and pairs are counted first. A phrase of three words is as frequent as its pairs at most, so the second reading
    counts only those whose pairs pass a filter of the frequent ones. The filter may let others pass, which costs rows
    and is right still, as all that is counted is held against `least`.
    """
    short = _stored(merged(runs(docs, (1, 2), None, entries), least), "phrases")
    frequent = short.where("k > 0")
    if longest > 2:
        bits = pair_filter(short.where("k = 2").select("phrase").distinct())
        frequent = frequent.unionByName(_stored(merged(runs(docs, (3,), bits, entries), least), "triples"))
    return frequent, short.where("k = 0").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, longest: int = 3, covered: int = 50, entries: int = ENTRIES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of two to `longest` (2 or 3) words.

    Texts are split into pieces at . , ; : ! ? and line ends, pieces into words at blanks and tabs; A-Z are lower-cased,
    all else stays. A phrase that comes a times, `least` or more, is scored by its cut with the lowest
    floor(10^6 a^2 / (l r)), l and r the counts of both parts (ties: the shorter first part). A phrase goes if a longer
    candidate holds it and comes in at least `covered` percent of its places. Order: score and a falling, then the
    phrase's bytes. Arithmetic is decimal, exact up to counts of 10^16.

    Null and empty texts have no words; a null lang is und. Repeated rows count each, and doc_id is not read. An empty
    table gives no rows. Long texts are counted in slices. Other columns are ignored.

    A part of a candidate is as frequent as the candidate, so all counts that a score needs are of frequent phrases:
    the table that is joined with itself is a small part of all phrases. A language's ranking is cut in parts first.
    """
    if longest not in (2, 3):
        raise ValueError("phrases have two or three words at most")
    frequent, words = frequencies(docs, least, longest, entries)
    held = frequent.where("k > 1").withColumn("w", F.split("phrase", " "))
    cut = held.select("lang", "phrase", "k", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select("lang", "phrase", "k", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.expr("slice(w, cut + 1, k)"), " ").alias("right"))
    l, r = (frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    score = F.expr("(1000000 * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").alias("score")
    rated = cut.join(l, ["lang", "left"]).join(r, ["lang", "right"]).select("lang", "phrase", "k", "a", "cut", "l", "r", score)
    best = rated.groupBy("lang", "phrase", "k", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("x")).select("lang", "phrase", "k", "a", "x.*")
    inner = held.where("k > 2").select("lang", F.col("f").alias("longer"), F.explode(F.expr("transform(sequence(1, 2), i -> array_join(slice(w, i, 2), ' '))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for parts in PARTS:  # no task ranks more than `top` phrases of each part before it
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order))).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """
with pieces as (
    select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\\x0A-\\x0D]')) piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') w from pieces),
g as (select lang, k, unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' '))) phrase
    from w, (values (1), (2), (3)) t(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) f from g group by all),
total as (select lang, sum(f)::bigint n from f where k = 1 group by 1),
c as (select lang, k, phrase, f a, string_split(phrase, ' ') w from f where k > 1 and f >= 10),
cuts as (select lang, k, phrase, a, array_to_string(w[:i], ' ') x, array_to_string(w[i + 1:], ' ') y, i from c, (values (1), (2)) t(i) where i < k),
rated as (select cuts.*, l.f l, r.f r, (1000000::hugeint * a * a) // (l.f::hugeint * r.f) score
    from cuts join f l on l.lang = cuts.lang and l.phrase = x join f r on r.lang = cuts.lang and r.phrase = y),
best as (select * from rated qualify row_number() over (partition by lang, phrase order by score, i) = 1),
longer as (select lang, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) phrase, a from c where k = 3),
most as (select lang, phrase, max(a) longer from longer group by all),
kept as (select best.* from best left join most using (lang, phrase) where longer is null or 100 * longer < 50 * a)
select lang, rank, phrase, a, l, r, n, score::bigint score
from (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept) join total using (lang) where rank <= 2000
"""
