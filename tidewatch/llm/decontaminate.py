"""Benchmark decontamination: a prefix-filtered join of word windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, table

WINDOW = 10  # words of a window; an item of fewer words is one window
SHINGLE = 3  # words of a shingle, the token of the join
PART = 1 << 20  # bytes of text that are searched together
FEW = 200_000  # distinct shingles of all items that may travel to every task (16 bytes each)

_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


PLACE = pa.struct([("shingle", pa.string()), ("p", pa.int64()), ("lo", pa.int64()), ("around", pa.list_(pa.string()))])


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and everything beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def item_windows(benchmark: DataFrame, width: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id, words (array), shingles (array of strings, by place) for each window of each item."""

    def run(batches):
        for pdf in batches:
            out = []
            for item, text in zip(pdf["item_id"], pdf["text"]):
                w = [x.decode("utf-8", "surrogatepass") for x in words(text)]
                for i in range(max(1, len(w) - width + 1) if w else 0):
                    own = w[i : i + width]
                    k = min(shingle, len(own))
                    out.append((item, own, [" ".join(own[j : j + k]) for j in range(len(own) - k + 1)]))
            yield pd.DataFrame(out, columns=["item_id", "words", "shingles"])

    return benchmark.select("item_id", "text").mapInPandas(run, f"item_id {dict(benchmark.dtypes)['item_id']}, words array<string>, shingles array<string>")


def chunks(batches):
    """(texts, bytes of them all in small letters with one blank for every other byte, where each starts) in parts of about a MB."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        text = text.cast("binary") if text.type != "binary" else text
        if not len(text):
            continue
        cuts = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
        data = memoryview(text.buffers()[2] or b"")
        first = 0
        while first < len(text):
            last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + PART, side="right")) - 1)
            yield batch.slice(first, last - first), bytes(data[cuts[first] : cuts[last]]).translate(_KEEP), cuts[first : last + 1] - cuts[first]
            first = last


class Finder:
    """Where wanted shingles are in texts, by arrays: words get their ids from a polynomial hash of their bytes."""

    def __init__(self, wanted: list[str]):
        vocabulary = sorted({w for s in wanted for w in s.split(" ")})
        hashes = np.array([self.hashes(*self.spans(w.encode("utf-8", "surrogatepass"), np.array([0])))[0] for w in vocabulary], np.uint64)
        order = np.argsort(hashes)
        self.known, ids, self.base = hashes[order], {vocabulary[i]: k + 1 for k, i in enumerate(order)}, len(vocabulary) + 1
        tables: dict[int, dict[int, str]] = {}
        for s in wanted:
            code = 0
            for w in s.split(" "):
                code = code * self.base + ids[w]
            tables.setdefault(s.count(" ") + 1, {})[code] = s
        self.codes = {k: np.array(sorted(t), np.int64) for k, t in tables.items()}
        self.names = {k: [t[c] for c in sorted(t)] for k, t in tables.items()}

    @staticmethod
    def spans(raw: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, and where words start and end; a word ends with its text."""
        b = np.frombuffer(raw, np.uint8)
        word = np.concatenate(([False], b != 0x20, [False]))
        first = word[1:-1] & ~word[:-2]
        inner = cuts[(cuts > 0) & (cuts < len(b))]
        first[inner] = word[1:-1][inner]
        last = word[1:-1] & ~word[2:]
        last[inner - 1] = word[1:-1][inner - 1]
        return b, np.flatnonzero(first), np.flatnonzero(last) + 1

    @staticmethod
    def hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0, np.uint64)
        size = ends - starts
        own = b[b != 0x20].astype(np.uint64)
        first = np.cumsum(size) - size
        place = np.arange(len(own)) - np.repeat(first, size)
        power = np.full(int(size.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
        with np.errstate(over="ignore"):
            power = np.cumprod(power)
            return np.add.reduceat((own + np.uint64(1)) * power[place], first)

    def find(self, raw: bytes, cuts: np.ndarray):
        """(starts, ends, text of each word, [(shingle words, place of the first word, index of the shingle)])."""
        b, starts, ends = self.spans(raw, cuts)
        text = np.searchsorted(cuts, starts, side="right") - 1
        h = self.hashes(b, starts, ends)
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        ids = np.where(self.known[at] == h, at + 1, 0).astype(np.int64) if len(self.known) else np.zeros(len(h), np.int64)
        found = []
        for k, codes in self.codes.items():
            n = len(ids) - k + 1
            if n < 1:
                continue
            p = np.flatnonzero((ids[:n] > 0) & (ids[k - 1 :] > 0) & (text[:n] == text[k - 1 :]))
            for j in range(1, k - 1):
                p = p[ids[p + j] > 0]
            code = np.zeros(len(p), np.int64)
            for j in range(k):
                code = code * self.base + ids[p + j]
            i = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[i] == code
            found.append((k, p[hit], i[hit]))
        return starts, ends, text, found


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    A document word is hit if it lies in an occurrence of an item's window. A null or empty text has no words, nothing is
    hit in it; an item without words has no window. Rows that repeat a doc_id are told apart by their text's hash, so
    each gets its own counts. An empty benchmark hits nothing. items_sha256 of no items is the digest of the empty
    string. Other columns are ignored.

    1. The shingles of all windows are counted over all documents. 2. A window must hold all its words in order, so one
    of its shingles is prefix enough: the rarest. Where documents hold a prefix shingle they are joined with its windows.
    3. The place of the shingle in the window gives the window's place in the document; it must lie inside (position
    and length bounds). 4. The words there must equal the window's.
    """
    return row_hits(docs, benchmark, width).drop("row")


def row_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """hits() with row, the xxhash64 of the text (null as empty)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    wins = materialize(item_windows(benchmark, width), "windows")
    every = materialize(wins.select(F.explode("shingles").alias("shingle")).distinct(), "shingles")
    none = every.select("shingle", F.lit(0).cast("long").alias("often")).limit(0)
    counts = reduce(DataFrame.unionByName, [materialize(_count(docs, x), "counts") for x in _blocks(every)] or [none])
    ranked = wins.select("words", "shingles").distinct().select("words", F.posexplode("shingles").alias("at", "shingle")).join(counts, "shingle", "left")
    first = F.row_number().over(Window.partitionBy("words").orderBy(F.coalesce("often", F.lit(0)), "shingle", "at"))
    prefix = materialize(ranked.withColumn("k", first).where("k = 1").select("shingle", "at", "words"), "prefix")
    scans = [materialize(_find(docs, x, width), "places") for x in _blocks(prefix.select("shingle").distinct())] or [materialize(_find(docs, [], width), "places")]
    near = reduce(DataFrame.unionByName, [x.where("size(near) > 0").select("doc_id", "row", "n_words", F.explode("near").alias("x")).select("doc_id", "row", "n_words", "x.*") for x in scans])
    pairs = near.join(prefix, "shingle").withColumns({"start": F.col("p") - F.col("at"), "len": F.size("words")})
    pairs = pairs.where("start >= 0 and start + len <= n_words and slice(around, start - lo + 1, len) = words")
    spans = materialize(pairs.select("doc_id", "row", F.col("start").cast("long").alias("start"), "len", "words").distinct(), "spans")
    union = F.expr("""aggregate(array_sort(collect_set(struct(start, start + len as end))), named_struct('n', 0L, 'to', 0L),
        (a, x) -> named_struct('n', a.n + greatest(0L, x.end - greatest(a.to, x.start)), 'to', greatest(a.to, x.end)), a -> a.n)""")
    n_hit = spans.groupBy("doc_id", "row").agg(union.alias("n_hit"))
    owner = wins.select("words", F.col("item_id").cast("string").alias("item")).distinct()
    items = spans.select("doc_id", "row", "words").distinct().join(owner, "words").groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = n_hit.join(items, _same(n_hit, items), "left").select(n_hit["doc_id"], n_hit["row"], "n_hit", "items")
    out = scans[0].join(both, _same(scans[0], both), "left").select(scans[0]["doc_id"], scans[0]["row"], "n_words", "n_hit", "items")
    none = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(none).cast("long").alias("n_items"),
        F.sha2(F.array_join(none, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row"] == b["row"])


def _blocks(shingles: DataFrame) -> Iterator[list[str]]:
    """The shingles in lists of about FEW, one after another: the driver holds one, and documents are read once for each."""
    n = shingles.count() // FEW + 1
    part = F.pmod(F.xxhash64("shingle"), F.lit(n))
    for i in range(n):
        if own := [r["shingle"] for r in shingles.where(part == i).collect()]:
            yield own


def _count(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """How often each of these shingles occurs in all documents: shingle, often."""

    def run(batches):
        finder = Finder(wanted)
        n = {k: np.zeros(len(c), np.int64) for k, c in finder.codes.items()}
        for _, raw, cuts in chunks(batches):
            for k, _, i in finder.find(raw, cuts)[3]:
                n[k] += np.bincount(i, minlength=len(n[k]))
        rows = [(finder.names[k][i], int(n[k][i])) for k in n for i in np.flatnonzero(n[k])]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], "string"), pa.array([x for _, x in rows], "int64")], ["shingle", "n"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "shingle string, n long").groupBy("shingle").agg(F.sum("n").alias("often"))


def _find(docs: DataFrame, wanted: list[str], width: int) -> DataFrame:
    """doc_id, row (hash of the text), n_words, near: each place of a wanted shingle with the words around it."""
    around = width - 1

    def run(batches):
        finder = Finder(wanted)
        for batch, raw, cuts in chunks(batches):
            starts, ends, text, found = finder.find(raw, cuts)
            n = np.bincount(text, minlength=batch.num_rows)
            first = np.cumsum(n) - n
            near: list[list] = [[] for _ in range(batch.num_rows)]
            for k, places, names in found:
                for p, i in zip(places.tolist(), names.tolist()):
                    t = int(text[p])
                    lo, hi = max(int(first[t]), p - around), min(int(first[t] + n[t]), p + around + k)
                    own = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
                    near[t].append({"shingle": finder.names[k][i], "p": p - int(first[t]), "lo": lo - int(first[t]), "around": own})
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("row")), pa.array(n, "int64"), pa.array(near, pa.list_(PLACE))], ["doc_id", "row", "n_words", "near"])

    kind = dict(docs.dtypes)["doc_id"]
    held = docs.select("doc_id", F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text"))
    return held.mapInArrow(run, f"doc_id {kind}, row long, n_words long, near array<struct<shingle: string, p: long, lo: long, around: array<string>>>")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP4_SQL = f"""
with b as (select item_id, {_WORDS} w from benchmark),
i as (select distinct item_id, unnest(list_transform(range(greatest(1, len(w) - 9)), lambda k: array_to_string(w[k + 1:k + 10], ' '))) x, least(10, len(w)) n
    from b where len(w) > 0),
d as (select doc_id, {_WORDS} w from documents),
p as (select doc_id, n, unnest(range(len(w) - n + 1)) k, w from d, (select distinct n from i)),
h as (select distinct doc_id, k, n, item_id from (select doc_id, n, k, array_to_string(w[k + 1:k + n], ' ') x from p) join i using (n, x)),
g as (select doc_id, count(distinct place) n_hit from (select doc_id, unnest(range(k, k + n)) place from h) group by doc_id),
l as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item_id::varchar item from h) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
    sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join g using (doc_id) left join l using (doc_id)
"""
