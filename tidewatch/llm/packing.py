"""Best-fit packing of token sequences by exact-complement hashing."""

from __future__ import annotations

import base64
import binascii
import functools
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, table

ROOM = 1024
END = 2
SPECIAL = "<|endoftext|>"  # fixed value: the one special string of the default vocabulary
SALT = 50_000  # pieces of a length that one window ranks


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def encoder(path: str):
    """text -> ids, as the tokenizers library gives them for this file without adding special tokens.

    The vocabulary also comes as ranks beside it, with which tiktoken makes the same ids in a quarter of the time. Texts
    with the special string, to which tokenizers gives an id of its own, go to tokenizers. Where the ranks are missing all
    texts go to tokenizers; a missing vocabulary is an error. It is made once in a Python worker, for all its tasks.
    """
    import os

    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: slow.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)


def cut(n: int, room: int = ROOM) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole rooms at the end, the first piece what is left over."""
    first = n % room or room
    return [(0, first), *((s, room) for s in range(first, n, room))]


def pieces(docs: DataFrame, path: str | None = None, room: int = ROOM, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. A null text counts as empty: a piece of the end id alone."""
    path = path or vocabulary()

    @F.pandas_udf("array<struct<piece: int, start: long, length: long, ids_crc32: long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path)
        for texts in batches:
            out = []
            for text in texts:
                ids = np.array([*encode(text or ""), end], "<u4")
                out.append([{"piece": k, "start": start, "length": n, "ids_crc32": binascii.crc32(ids[start : start + n].tobytes())} for k, (start, n) in enumerate(cut(len(ids), room))])
            yield pd.Series(out)

    # only texts go to Python, so ids stay as they are
    return docs.select("doc_id", F.explode(run("text")).alias("x")).select("doc_id", "x.*")


def patterns(count: dict[int, int], room: int = ROOM) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many such sequences)] that use up count, pieces by length.

    Plans that fill gaps exactly by up to three, two or one other lengths; the one with the fewest sequences. (Where
    there are few pieces, triples can use up the short ones that would fill more gaps alone.)
    """
    plans = [_plan(count, room, most) for most in (3, 2, 1)]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


class Sums:
    """The sums of two and of three lengths, each with the longest length of the combinations that make it.

    pairs[s]: the longer ones, the most even pair first; triples[s]: the longest ones, the shortest first. Counts only go
    down, so what has run out is dropped from the front of a list when it is met there.
    """

    def __init__(self, have: np.ndarray, room: int):
        self.have = have
        self.pairs: dict[int, deque] = defaultdict(deque)
        self.triples: dict[int, deque] = defaultdict(deque)
        own, sums = np.flatnonzero(have).tolist(), np.zeros(room, bool)
        for k, a in enumerate(own):
            for b in own[: k + 1]:
                if a + b >= room:
                    break
                self.pairs[a + b].append(a)
                sums[a + b] = True
            for t in (np.flatnonzero(sums[: room - a]) + a).tolist():
                self.triples[t].append(a)

    def pair(self, total: int, most: int, *used: int) -> tuple[int, int] | None:
        """Two lengths of at most `most` each that make this sum and are there besides those used."""
        lists, have = self.pairs.get(total), self.have
        while lists and not (have[lists[0]] and have[total - lists[0]]):
            lists.popleft()
        for a in lists or ():
            if a > most:
                return None
            b = total - a
            if have[a] > used.count(a) + (a == b) and have[b] > used.count(b) + (a == b):
                return a, b
        return None

    def fill(self, top: int, gap: int, most: int) -> tuple[int, ...] | None:
        """One, two or three lengths that make gap and are there besides one piece of length top."""
        have = self.have
        if have[gap] > (gap == top):
            return (gap,)
        if most > 1 and (two := self.pair(gap, gap, top)):
            return two
        if most > 2:
            lists = self.triples.get(gap)
            while lists and not have[lists[-1]]:
                lists.pop()
            for a in reversed(lists or ()):  # the longest first: short ones fill later gaps
                if have[a] > (a == top) and (two := self.pair(gap - a, a, top, a)):
                    return (a, *two)
        return None


def _plan(count: dict[int, int], room: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """From the longest length down, its gap is filled exactly by one to `most` lengths that are still there.

    The combinations are looked up by their sums, and each is consumed as often as the counts allow. What finds no exact
    complement goes best-fit, in bulk, into the sequences with the smallest gap that holds it. The work depends on the
    number of different lengths, not on the number of pieces.
    """
    have = np.zeros(room + 1, np.int64)
    for k, v in count.items():
        have[k] = v
    out: list[tuple[tuple[int, ...], int]] = [((room,), int(have[room]))] if have[room] else []
    have[room] = 0
    sums = Sums(have, room)
    for top in range(room - 1, 0, -1):
        while have[top]:
            combo = sums.fill(top, room - top, most)
            if combo is None:
                break
            lengths, times = np.unique((top, *combo), return_counts=True)
            n = int((have[lengths] // times).min())
            have[lengths] -= n * times
            out.append(((top, *combo), n))
    open_: dict[int, list] = defaultdict(list)  # gap -> [(lengths, how many)]
    for top in range(room - 1, 0, -1):
        left = int(have[top])
        while left:
            gap = min((g for g in open_ if g >= top), default=None)
            if gap is None:  # new sequences, each with as many of this length as it holds
                fit = room // top
                for size, n in ((fit, left // fit), (left % fit, 1)):
                    if size and n:
                        open_[room - size * top].append(((top,) * size, n))
                break
            lengths, n = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
            used = min(n, left)
            if n > used:
                open_[gap].append((lengths, n - used))
            if gap - top:
                open_[gap - top].append(((*lengths, top), used))
            else:
                out.append(((*lengths, top), used))
            left -= used
    return out + [x for own in open_.values() for x in own]


def pack(docs: DataFrame, path: str | None = None, room: int = ROOM) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    Every row of docs is packed, rows that repeat a doc_id too; a null or empty text is a piece of one id. An empty table
    gives an empty result. Columns other than doc_id and text are ignored.

    The pieces are counted by length (room numbers at most, whatever the input), the sequences are planned from these
    counts, and each piece finds its place by its number among those of its length. The numbering is salted: a window
    ranks a bucket of a length, whose first number comes from the counts of the buckets before it.
    """
    cutout = materialize(pieces(docs, path, room), "pieces")
    buckets = max(1, cutout.count() // SALT)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))
    cutout = cutout.withColumn("bucket", bucket)
    sizes = cutout.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    total = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges, base, low = [], 0, defaultdict(int)
    for lengths, n in patterns(total, room):
        offset = 0
        for x in lengths:
            ranges.append((x, low[x], low[x] + n, base - low[x], offset))
            low[x] += n
            offset += x
        base += n
    places = docs.sparkSession.createDataFrame(ranges, "length long, low long, high long, shift long, offset long")
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = cutout.withColumn("own", own).join(before.select("length", "bucket", "before"), ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("own") - 1)
    # places: a few rows for each length, from the plan of at most `room` lengths
    placed = ranked.alias("r").join(F.broadcast(places.alias("p")), F.expr("r.length = p.length and r.rank >= p.low and r.rank < p.high"))
    return placed.select("doc_id", "piece", "start", F.col("r.length").alias("length"), "ids_crc32", F.expr("rank + shift").alias("sequence_id"), "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
