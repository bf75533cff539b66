"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import share, table
from tidewatch.llm.labelled import crc, sample

SAMPLE = 4000  # labelled documents that vote, at most
TOPICS = 48  # latent dimensions
NEIGHBOURS = 15
SHARPNESS = 4  # a neighbour's weight is its cosine to this power

# Classes of bytes: letters beyond ASCII count as small letters, marks without a class of their own share the last.
_MARKS = b" \n.,!|*%$&#"
_CLASSES = len(_MARKS) + 4
_BUCKETS = 10
_SHAPES = _CLASSES**3 + 3 * _BUCKETS
_WORDS = 1 << 12  # buckets of words, by hash
TERMS = _SHAPES + _WORDS
MEANING = 0.5  # weight of the words beside the shapes


def _byte_classes() -> np.ndarray:
    out = np.full(256, _CLASSES - 1, np.int64)
    out[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    for i, c in enumerate(_MARKS):
        out[c] = 3 + i
    return out


class Reader(dict):
    """The terms of texts; as a dict, the bucket of each word met."""

    def __init__(self):
        self.classes = _byte_classes()

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        own = self[word] = _SHAPES + (xxhash.xxh32_intdigest(word.strip(b".,;:!?\"'()[]")) & (_WORDS - 1))
        return own

    def terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(term, count): words, in small letters and by buckets; triples of the classes of successive runs of
        characters; and tenths of how repetitive the text is."""
        raw = text.encode("utf-8", "surrogatepass")
        w = raw.lower().split()
        if not w:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        c = self.classes[np.frombuffer(raw, np.uint8)]
        c = c[np.append(True, (c[1:] != c[:-1]) | (c[1:] > 4))]
        t = (c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:]
        n = np.bincount(t, minlength=_CLASSES**3)
        pairs = max(1, len(w) - 1)
        same = sum(map(bytes.__eq__, w, w[1:])) / pairs
        again = 1 - len(set(zip(w, w[1:]))) / pairs if len(w) > 1 else 0
        lines = [x for x in raw.split(b"\n") if x.strip()]
        twice = 1 - len(set(lines)) / max(1, len(lines))
        extra = [_CLASSES**3 + k * _BUCKETS + min(_BUCKETS - 1, int(np.ceil(x * 10))) for k, x in enumerate((same, again, twice))]
        own = np.flatnonzero(n)
        word, often = np.unique(np.fromiter(map(self.__getitem__, w), np.int64, len(w)), return_counts=True)
        return np.concatenate([own, extra, word]), np.concatenate([n[own], [20, 20, 20], often])


def _frequencies(batches):
    reader, n, docs = Reader(), np.zeros(TERMS, np.int64), 0
    for pdf in batches:
        for text in pdf["text"]:
            t, _ = reader.terms(text or "")
            n[t] += 1
            docs += 1
    at = np.flatnonzero(n)
    yield pd.DataFrame({"term": np.append(at, -1), "n": np.append(n[at], docs)})


def _packed(batches):
    reader = Reader()
    for pdf in batches:
        t = [reader.terms(x) for x in pdf["text"]]
        yield pd.DataFrame({"label": pdf["label"], "terms": [a.astype(np.int32).tobytes() for a, _ in t], "counts": [b.astype(np.int32).tobytes() for _, b in t]})


class Model:
    """The weights of the terms, the latent basis and the labelled vectors: TERMS x TOPICS and SAMPLE x TOPICS floats."""

    def __init__(self, df: dict[int, int], docs: int, rows: list[tuple[int, np.ndarray, np.ndarray]]):
        self.idf = np.zeros(TERMS)
        for t, n in df.items():
            self.idf[t] = np.log((1 + docs) / (1 + n))
        self.labels = np.array([r[0] for r in rows], float)
        self.prior = float(self.labels.mean()) if len(rows) else 0.0
        x = self.weighted([r[1:] for r in rows])
        self.basis = _right_vectors(x, TOPICS)
        self.vectors = self.unit(x @ self.basis)

    def weighted(self, rows) -> np.ndarray:
        x = np.zeros((len(rows), TERMS), np.float32)
        for i, (t, n) in enumerate(rows):
            x[i, t] = np.log1p(n) * self.idf[t]
        for part, weight in ((x[:, :_SHAPES], 1.0), (x[:, _SHAPES:], MEANING), (x, 1.0)):  # in place: x is large in fit()
            part *= weight / np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part)), 1e-9)[:, None]
        return x

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, rows) -> np.ndarray:
        """Votes for a block of documents, from the cosines to all labelled vectors; the prior where nothing is similar."""
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        cosine = self.unit(self.weighted(rows) @ self.basis) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(float) ** SHARPNESS
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.clip(np.where(total > 1e-6, votes / np.maximum(total, 1e-6), self.prior), 0, 1)


def _right_vectors(x: np.ndarray, k: int) -> np.ndarray:
    """The first right singular vectors of x by subspace iteration from a fixed start."""
    q = np.random.default_rng(1).standard_normal((x.shape[1], k)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q)) if len(x) else (q, None)
    return q.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE) -> Model:
    """Term statistics of all documents; basis and voters from a sample of at most `rows` labelled ones."""
    counted = docs.select("text").mapInPandas(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r["term"]: r["n"] for r in counted.collect()}  # TERMS rows at most
    own = sample(docs, labels, "quality", learn, rows).mapInPandas(_packed, "label int, terms binary, counts binary")
    got = sorted((r["label"], bytes(r["terms"]), bytes(r["counts"])) for r in own.collect())
    return Model(df, df.pop(-1, 0), [(y, np.frombuffer(t, np.int32), np.frombuffer(n, np.int32)) for y, t, n in got])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row. A null, empty or blank text has no terms and gets the prior of the voters.

    Equal texts get equal scores. Without labelled documents every score is 0. Other columns are ignored.
    """
    held = share(docs.sparkSession, model)

    @F.pandas_udf("double")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, reader = held(), Reader()
        for texts in batches:
            rows = [reader.terms(t or "") for t in texts]
            parts = [own.scores(rows[i : i + 256]) for i in range(0, len(rows), 256)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    # only texts go to Python, so ids stay as they are
    return docs.select("doc_id", vote("text").alias("score"))


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc() % 5 == 0
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
