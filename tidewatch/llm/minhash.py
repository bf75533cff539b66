"""Near-duplicate documents: bottom-k sketches from one hash function, exact Jaccard at the end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import connected_components, materialize, table

SKETCH = 48  # retained values of a document
SHARED = 0.375  # part of a full sketch, and of the union's, that a pair must share; a linked pair shares 0.75 on average, 1e-8 of them less
LONG = 4096  # shingles from which on two sets are rated by their sketches before they are compared, one pair at a time
GATHERED = 1 << 20  # shingles that are looked up at once
BLOCK = 1_000_000  # shingles of a block, with 600 more for each document; a task compares two blocks at most


class _Hashes(dict):
    """64-bit hash of each word; emptied when it holds very many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: dict, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Words are runs without ASCII white space, A-Z lower-cased: what bytes.lower and bytes.split do. A text of fewer
    words has its whole sequence as one shingle; without words or text the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, 0x9E3779B97F4A7C15 + len(h[:width]), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(width, len(h))):
            out = (out ^ h[i : i + n]) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
        out *= np.uint64(0xC4CEB9FE1A85EC53)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    hashes = _Hashes()
    for texts in batches:
        sets = [shingle_set(t, hashes) for t in texts]
        yield pd.DataFrame({"n_shingles": [len(s) for s in sets], "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "sketch": [s[:SKETCH].astype(np.int64) for s in sets]})


def _full_sets(batches):
    hashes = _Hashes()
    for pdf in batches:
        sets = [shingle_set(t, hashes).tobytes() for t in pdf["text"]]
        own = [xxhash.xxh3_128_digest(x) == d for x, d in zip(sets, pdf["digest"])]  # a doc_id may come with several texts
        yield pdf.assign(shingles=sets).loc[own, ["task", "side", "rep", "shingles"]]


def linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Exact Jaccard test of two sorted distinct sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def spanning_links(ids: list, sets: list, sides: list, percent: int = 75, size: int = SKETCH) -> list:
    """A spanning forest of the links among these sets: all the connections, without all the pairs.

    sides: 0 and 1 are two blocks of which only pairs across count; 2 counts with all. Inverted lists of the retained
    values count overlaps; pairs that are connected already are passed over; the full sets decide, those of many
    candidates in one look-up. Of long sets the union sketch estimates the pair first.
    """
    order = np.lexsort((np.array(sides), np.array([len(s) for s in sets])))
    ids, sets, sides = [ids[i] for i in order], [sets[i] for i in order], np.array(sides)[order]
    low = [s[:size] for s in sets]
    _, where = np.unique(np.concatenate(low), return_inverse=True)
    cuts = np.cumsum([0, *map(len, low)])
    by = np.argsort(where, kind="stable")  # entries by value, then set: the inverted lists
    holders, place = np.repeat(np.arange(len(sets)), np.diff(cuts))[by], np.empty_like(by)
    place[by] = np.arange(len(by))
    begins = np.searchsorted(where[by], where)
    short = np.array([len(s) <= LONG for s in sets])
    codes = np.unique(np.concatenate([np.empty(0, np.uint64), *(s for s, own in zip(sets, short) if own)]), return_inverse=True)[1]
    full = np.cumsum([0, *(len(s) * own for s, own in zip(sets, short))])
    mark = np.zeros(len(codes), bool)
    n, label, links = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    for i in range(len(sets)):
        before = [holders[a:b] for a, b in zip(begins[cuts[i] : cuts[i + 1]], place[cuts[i] : cuts[i + 1]]) if a < b]
        if not before:
            continue
        count = np.bincount(np.concatenate(before), minlength=i)
        need = np.maximum(1, (SHARED * np.minimum(n[:i], size)).astype(int))
        js = np.flatnonzero((count[:i] >= need) & (100 * n[:i] >= percent * n[i]) & (label[:i] != label[i]) & ((sides[:i] != sides[i]) | (sides[i] == 2)))
        js, many = js[np.argsort(-count[js], kind="stable")], 4
        if len(js) and short[i]:
            mark[codes[full[i] : full[i + 1]]] = True
        while len(js):  # few at first, as a link spares the pairs that it connects
            now, js = js[:many], js[many:]
            many = min(4 * many, max(1, GATHERED // n[i]))
            if short[i]:  # and so are those before it
                both = np.add.reduceat(mark[np.concatenate([codes[full[j] : full[j + 1]] for j in now])], np.cumsum([0, *n[now[:-1]]]), dtype=np.int64)
                now = now[100 * both >= percent * (n[i] + n[now] - both)]
            for j in now:
                if label[i] != label[j] and (short[i] or estimate(low[i], low[j], size) >= SHARED and linked(sets[i], sets[j], percent)):
                    links.append((ids[i], ids[j]))
                    label[label == label[i]] = label[j]
            js = js[label[js] != label[i]]
        if short[i]:
            mark[codes[full[i] : full[i + 1]]] = False
    return links


def estimate(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Share of the union's bottom-k values that both sketches retain."""
    both = np.sort(np.concatenate([a, b]))
    first = np.append(True, both[1:] != both[:-1])
    last = np.searchsorted(np.cumsum(first), min(size, int(first.sum())), side="right")
    return float((~first[:last]).sum()) / min(size, int(first.sum()))


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    found = spanning_links(pdf["rep"].tolist(), sets, pdf["side"].tolist())
    return pd.DataFrame(found, columns=["src", "dst"]).astype("int64")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of documents whose shingle sets have a Jaccard similarity of 0.75 or more.

    Null and empty texts, and texts of white space, have no shingles and are components of their own. Copies share a set
    and are one class from the start, so they are never paired. Rows that repeat a doc_id each get a row with the same
    component: they are one document, whatever their texts, and an empty one has the component of the others. A row
    without doc_id is linked with nothing and kept; its component_id is null. Other columns of docs are ignored.

    1. Sketch every document and gather equal sets in classes. 2. Count in how many classes each retained value is, and
    keep the classes with enough values that others have too. A pair must share many, so the most frequent of these
    (all but one of the number needed) can go: passages that very many documents share leave the lists here. 3. Classes
    with a common list form coarse groups; large ones are cut into blocks by length and hash, and each pair of blocks
    that can hold links is one task. 4. A task links by full sets and returns a forest. 5. Components of the links.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sketch = F.pandas_udf(_sketches, "n_shingles long, digest binary, sketch array<long>")  # only texts go to Python, so ids stay as they are
    every = materialize(docs.select("doc_id", sketch("text").alias("x")).select("doc_id", "x.*"), "sketches")
    sketches, docs = every.where("doc_id is not null"), docs.where("doc_id is not null")
    classes = sketches.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "sketch"), "doc_id").alias("x")).select("digest", "rep", "x.*")
    lists = classes.select("rep", "digest", "n_shingles", F.explode("sketch").alias("value"))
    often = lists.groupBy("value").agg(F.count("*").alias("often")).where("often > 1")
    need = F.greatest(F.lit(1), F.floor(SHARED * F.least("n_shingles", F.lit(SKETCH)))).cast("int")
    prefix = lists.join(often, "value").groupBy("rep", "digest", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("values"))
    prefix = prefix.withColumn("need", need).where("size(values) >= need").select("rep", "digest", "n_shingles", F.explode(F.slice("values", F.lit(1), F.size("values") - F.col("need") + 1)["value"]).alias("value"))
    prefix = materialize(prefix, "prefix")
    heads = prefix.groupBy("value").agg(F.min("rep").alias("head"))
    coarse = connected_components(prefix.join(heads, "value").where("rep <> head").select(F.col("rep").alias("src"), F.col("head").alias("dst")).distinct())
    found = _links(docs, prefix.select("rep", "digest", "n_shingles").distinct().join(coarse, F.col("rep") == F.col("id")).select("rep", "digest", "n_shingles", "component"))
    members = sketches.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "rep"), "digest", "left")
    # a doc_id that comes with several texts is one document: its classes are linked through it
    again = materialize(sketches.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    repeated = materialize(members.join(again, "doc_id").select("doc_id", "rep"), "repeated")
    heads = materialize(repeated.groupBy("doc_id").agg(F.min("rep").alias("head")), "heads")
    same = repeated.join(heads, "doc_id").where("rep <> head").select(F.col("rep").alias("src"), F.col("head").alias("dst")).distinct()
    final = connected_components(found.unionByName(same)).withColumnRenamed("component", "low")
    own = members.join(heads, "doc_id", "left").withColumn("rep", F.coalesce("rep", "head"))
    out = own.join(final, F.col("rep") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("low", "rep", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = every.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)


def _links(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Verified links of the coarse groups, a forest from each task."""
    step = F.floor(F.log("n_shingles") / float(np.log(1 / 0.75))).cast("int")  # linked sets differ by one step at most
    groups = materialize(groups.withColumns({"step": step, "weight": F.col("n_shingles") + 600}), "groups")
    sizes = groups.groupBy("component").agg(F.sum("weight").alias("all"))
    bins = max(1, (groups.agg(F.sum("weight")).first()[0] or 0) // BLOCK)
    small = groups.join(sizes.where(f"all <= {BLOCK}"), "component").select("rep", "digest", F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(bins))).alias("task"), F.lit(2).alias("side"))
    large = groups.join(sizes.where(f"all > {BLOCK}"), "component")
    steps = large.groupBy("component", "step").agg(F.ceil(F.sum("weight") / BLOCK).cast("int").alias("parts"))
    near = steps.alias("a").join(steps.alias("b"), F.expr("a.component = b.component and b.step in (a.step, a.step + 1)"))
    near = near.select(F.col("a.component").alias("component"), F.col("a.step").alias("lo"), F.col("b.step").alias("hi"), F.explode(F.sequence(F.lit(0), F.col("a.parts") - 1)).alias("p"), F.col("b.parts").alias("parts"))
    near = near.select("component", "lo", "hi", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")).where("lo < hi or p <= q")
    near = near.withColumn("task", F.concat_ws("/", "component", "lo", "p", "hi", "q"))
    alone = F.expr("lo = hi and p = q")
    part = near.select("component", F.col("lo").alias("step"), F.col("p").alias("part"), "task", F.when(alone, 2).otherwise(0).alias("side"))
    part = part.unionByName(near.where(~alone).select("component", F.col("hi").alias("step"), F.col("q").alias("part"), "task", F.lit(1).alias("side")))
    large = large.join(steps, ["component", "step"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = small.unionByName(large.join(part, ["component", "step", "part"]).select("rep", "digest", "task", "side"))
    texts = docs.join(dealt.hint("shuffle_hash"), docs["doc_id"] == dealt["rep"]).select("task", "side", "rep", "digest", "text")
    sets = texts.mapInPandas(_full_sets, "task string, side int, rep long, shingles binary")
    return sets.groupBy("task").applyInPandas(_compare, "src long, dst long")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


# Pairs by a common shingle, so fit for small tables only.
OP7_SQL = """
with recursive d as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') w from documents),
s as (select doc_id, list_distinct(list_transform(range(greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) s
    from d where len(w) > 0),
t as (select doc_id, len(s) n, unnest(s) x from s),
p as (select a.doc_id a, b.doc_id b, a.n an, b.n bn, count(*) c from t a join t b using (x) where a.doc_id < b.doc_id group by all),
l as (select a, b from p where 100 * c >= 75 * (an + bn - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, low) as (select doc_id, doc_id from d union select e.b, r.low from r join e on e.a = r.doc_id),
m as (select doc_id, min(low) low from r group by doc_id)
select d.doc_id, coalesce(len(s.s), 0)::bigint n_shingles, m.low component_id, d.doc_id = m.low kept
from d left join s using (doc_id) join m on m.doc_id = d.doc_id
"""
