"""Toxicity: disguised words are decoded by a noisy channel, then the restored text is scored."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import share, table
from tidewatch.llm.labelled import crc, sample

SAMPLE = 5000  # labelled documents that the scorer is fitted on, at most
FEATURES = 64  # words and beginnings that it may use
BEGINNINGS = (4, 5, 6, 7)  # letters
RATE = 60  # a beginning counts fully where one word in so many has it
BITS = 26
LEAST_GAIN = 8.0  # one is added while its score statistic is at least this
ORDER = 4  # letters of the letter model's terms
PART = 1 << 20  # characters that are counted together
CHUNK = 1 << 17  # entries of the sample that are rated together

# Letters that a mark or digit may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz",
}
WILD = "*#"
_SIGN = "0-9@$!|+(*#"
_SEP = r".\-_*/,~'| "
# Costs (log probabilities) of the channel.
READ, READ_WILD, TWICE, DROPPED, DROPPED_DOLLAR, CHOICE = -0.5, -3.0, -0.5, -1.5, -4.0, -0.7

SPAN = re.compile(rf"[a-z{_SIGN}]+")
OUTER = re.compile(rf"[^a-z{_SIGN}]*(.*?)[^a-z{_SIGN}]*", re.S)
DISGUISED = re.compile(rf"[{_SIGN}]|([a-z])\1\1")
SPACED = re.compile(rf"[a-z{_SIGN}](?:[{_SEP}]+[a-z{_SIGN}])+")
LONE = re.compile(rf"[^\w{_SIGN}]*[a-z{_SIGN}][^\w@$]*")
MARKS = re.compile(r"[^\w\s]+")
LETTER = re.compile(r"[a-z]")
WORD = re.compile(r"[^\W\d_]+")
RUNS = re.compile(r"(.)\1*", re.S)

# Kinds of tokens: nothing to count, a single letter or sign, something to count, marks only.
PLAIN, ALONE, COUNTS, MARK = range(4)
_ALONE_RUN, _COUNTED = re.compile(rb"\x01(?:\x03*\x01){2,}"), re.compile(rb"\x02")


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Counts of the runs of ORDER letters (0: anything but a-z, once however long) over all documents."""
    size = 27**ORDER

    def run(batches):
        lower = np.zeros(256, np.uint8)
        lower[ord("a") : ord("z") + 1] = lower[ord("A") : ord("Z") + 1] = np.arange(1, 27)
        n = np.zeros(size, np.int64)

        def count(texts):
            c = lower[np.frombuffer(f" {' '.join(texts)} ".encode("utf-8", "surrogatepass"), np.uint8)]
            c = c[np.append(True, (c[1:] > 0) | (c[:-1] > 0))].astype(np.int32)
            if len(c) >= ORDER:
                code = c[: len(c) - ORDER + 1]
                for i in range(1, ORDER):
                    code = code * 27 + c[i : len(c) - ORDER + 1 + i]
                n[:] += np.bincount(code, minlength=size)

        for pdf in batches:
            held, chars = [], 0
            for text in pdf["text"]:
                held.append(text or "")
                chars += len(held[-1])
                if chars > PART:
                    count(held)
                    held, chars = [], 0
            count(held)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"code": at, "n": n[at]})

    out = np.zeros(size, np.int64)
    got = docs.select("text").mapInPandas(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # 27^ORDER rows at most, and no object for each in the driver
    out[got["code"].to_numpy()] = got["n"].to_numpy()
    return out


class Decoder:
    """Viterbi decoding of disguised spans under a letter model of order ORDER, each order backed off to the one below."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape((27,) * ORDER).astype(float)
        p = np.full(27, 1 / 27)
        for k in range(ORDER):
            own = n.sum(axis=tuple(range(ORDER - 1 - k)))
            p = (own + 10 * p) / (own.sum(axis=-1, keepdims=True) + 10)
        self.table = np.log(p).astype(np.float32).ravel()
        self.log: list[float] | None = None
        self.seen: dict[str, str] = {}

    def restore(self, text: str) -> str:
        """The text in small letters, its disguised words decoded, with single blanks between its tokens."""
        tokens = text.lower().split()
        kinds = bytes(ALONE if LONE.fullmatch(t) else MARK if MARKS.fullmatch(t) else PLAIN for t in tokens)
        out, done = [], 0
        for a, b in self.runs(tokens, kinds):
            out += [*map(self.token, tokens[done:a]), self.spaced(" ".join(tokens[a:b]))]
            done = b
        return " ".join([*out, *map(self.token, tokens[done:])])

    @staticmethod
    def runs(tokens: list[str], kinds: bytes) -> Iterator[tuple[int, int]]:
        """Where three or more single letters or signs stand in a row, two letters among them at least."""
        for m in _ALONE_RUN.finditer(kinds):
            if sum(bool(LETTER.search(t)) for t in tokens[m.start() : m.end()]) > 1:
                yield m.span()

    def token(self, token: str) -> str:
        """A token with its disguised spans decoded; letters set apart by marks are one span."""
        if not DISGUISED.search(token) and not SPACED.search(token):
            return token
        m = OUTER.fullmatch(token)
        if m and SPACED.fullmatch(m[1]) and len(LETTER.findall(m[1])) > 1 and len(SPAN.findall(m[1])) > 2:
            return token[: m.start(1)] + self.spaced(m[1]) + token[m.end(1) :]
        return SPAN.sub(self._span, token)

    def _span(self, m: re.Match) -> str:
        """What is decoded: a span with letters and with signs or a letter three times, wild signs no more than letters."""
        span = m[0]
        letters = len(LETTER.findall(span))
        if letters and len(span) > 2 and DISGUISED.search(span) and sum(c in WILD for c in re.sub(r"([*#])\1+", r"\1", span)) <= letters:
            return self.known(span, False)
        return span

    def spaced(self, span: str) -> str:
        return self.known(span, True)

    def known(self, span: str, apart: bool) -> str:
        key = span + " " * apart
        if key not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[key] = self.decode(self.slots(span, apart))
        return self.seen[key]

    def slots(self, span: str, apart: bool = False) -> list[list[tuple[str, float]]]:
        """The lattice: for each run of a character, what it may stand for and the channel's log probability.

        A sign is read as a letter; at an end of the span it may also be a mark that goes. A letter three times or more
        is one or two. In a span of letters set apart, each separator goes or is the end of a word.
        """
        out, n = [], len(span)
        for run in RUNS.finditer(span):
            c, k = run[1], len(run[0])
            own: list[tuple[str, float]] = []
            if c in LEET:
                letters = LEET[c]
                p = -np.log(len(letters)) + (READ_WILD if c in WILD else READ)
                own += [(x * min(k, 2), p * min(k, 2)) for x in letters]
                own += [(x, p + TWICE) for x in letters] if k > 1 else []
                if run.start() == 0 or run.end() == n:
                    own.append(("", DROPPED_DOLLAR if c == "$" else DROPPED))
            elif "a" <= c <= "z":
                own += [(c, CHOICE), (c * 2, CHOICE)] if k > 2 else [(c * k, 0.0)]
            if apart and c in ".-_*/,~'| " or not own:
                own += [("", CHOICE), (" ", CHOICE)]
            out.append(own)
        return out

    def decode(self, slots: list[list[tuple[str, float]]]) -> str:
        """The best reading of a lattice: the largest sum of the channel's and the letter model's logs, ties to the last
        in the order of strings."""
        if self.log is None:
            self.log = self.table.tolist()
        log, size = self.log, 27 ** (ORDER - 1)
        best = {0: (0.0, "")}
        for own in slots:
            new: dict[int, tuple[float, str]] = {}
            for state, (p, s) in best.items():
                for letters, cost in own:
                    x, q = state, p + cost
                    for c in letters:
                        z = ord(c) - 96 if c != " " else 0
                        q += log[x * 27 + z]
                        x = (x * 27 + z) % size
                    if x not in new or new[x] < (q, s + letters):
                        new[x] = (q, s + letters)
            best = new
        return " ".join(max((p + log[x * 27], s) for x, (p, s) in best.items())[1].split())


class Features(dict):
    """Ids of what a text's words count for: each word itself, then its beginnings. With `chosen`, of these only.

    As a dict it holds the kind of each token met; a token's decoding and counting are done once.
    """

    def __init__(self, decoder: Decoder, chosen=None):
        self.decoder, self.chosen = decoder, chosen
        self.counted: dict[str, tuple] = {}

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
            self.counted.clear()
        if LONE.fullmatch(token):
            kind = ALONE
        elif MARKS.fullmatch(token):
            kind = MARK
        else:
            kind = COUNTS if self.ids(token) else PLAIN
        self[token] = kind
        return kind

    def ids(self, token: str) -> tuple:
        if token not in self.counted:
            own = self.of_words(self.decoder.token(token))
            if not own:
                return own
            self.counted[token] = own
        return self.counted[token]

    def of_words(self, text: str) -> tuple:
        out = []
        for word in WORD.findall(text):
            for k, i in enumerate([_id("=" + word), *(_id(word[:k]) for k in BEGINNINGS if len(word) > k)]):
                if self.chosen is None or i in self.chosen:
                    out.append((i, k == 0))
        return tuple(out)

    def of(self, text: str) -> dict[int, float]:
        """id -> value of a text: 1 for a word that is there, for a beginning the rate of tokens that have it."""
        tokens = text.lower().split()
        kinds = bytes(map(self.__getitem__, tokens))
        found = [self.ids(tokens[m.start()]) for m in _COUNTED.finditer(kinds)]
        found += [self.of_words(self.decoder.spaced(" ".join(tokens[a:b]))) for a, b in self.decoder.runs(tokens, kinds)]
        out: dict[int, float] = {}
        step = RATE / max(1, len(tokens))
        for own in found:
            for i, whole in own:
                out[i] = 1.0 if whole else max(out.get(i, 0.0), min(1.0, out.get(i, 0.0) + step))
        return out


def _id(x: str) -> int:
    return xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) >> (32 - BITS)


class Scorer:
    """Logistic regression over words and beginnings chosen one by one, while the next explains enough of what is left."""

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray]]):
        y = np.array([r[0] for r in rows], float)
        share = float(y.mean()) if len(y) else 0.0
        self.weights: dict[int, float] = {}
        self.bias = 9.0 if share == 1 else -9.0
        if not 0 < share < 1:
            return
        self.bias = float(np.log(share / (1 - share)))
        ids, begins, doc, value = _by_id(rows)
        # ids of about CHUNK entries at a time, so that no number of 8 bytes is made for each entry at once
        cuts = np.unique(np.append(np.searchsorted(begins, np.arange(0, len(doc), CHUNK)), len(ids))).tolist()
        chosen: list[int] = []
        x, weight = np.ones((len(y), 1)), np.array([self.bias])
        while len(ids):
            p = 1 / (1 + np.exp(-x @ weight))
            rest, spread = y - p, p * (1 - p)
            gain = np.zeros(len(ids))
            for a, b in zip(cuts, cuts[1:]):
                at, own = np.repeat(np.arange(b - a), np.diff(begins[a : b + 1])), slice(begins[a], begins[b])
                d, v = doc[own], value[own] / 255
                gain[a:b] = np.maximum(np.bincount(at, rest[d] * v, b - a), 0) ** 2 / (np.bincount(at, spread[d] * v**2, b - a) + 1.0)
            gain[chosen] = 0
            top = int(gain.argmax())
            if gain[top] < LEAST_GAIN or len(chosen) >= FEATURES:
                break
            chosen.append(top)
            has, own = np.zeros(len(y)), slice(begins[top], begins[top + 1])
            has[doc[own]] = value[own] / 255
            x = np.column_stack([x, has])
            weight = _newton(x, y, np.append(weight, 0.0))
        self.bias, self.weights = float(weight[0]), dict(zip(ids[chosen].tolist(), weight[1:].tolist()))

    def score(self, own: dict[int, float]) -> float:
        return float(1 / (1 + np.exp(-self.bias - sum(self.weights[i] * v for i, v in own.items()))))


def _by_id(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids that more than two rows have, where the entries of each begin (and all end), and each entry's row and value."""
    packed, n = np.empty(sum(len(r[1]) for r in rows), np.uint64), 0
    for k, (_, own, values) in enumerate(rows):  # id, row, value in one number, sorted where they stand
        packed[n : n + len(own)] = own.astype(np.uint64) << np.uint64(32) | np.uint64(k << 8) | values
        n += len(own)
    packed.sort()
    low = packed.astype(np.uint32)
    packed >>= np.uint64(32)
    own = packed.astype(np.int32)
    del packed
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if n else np.empty(0, np.int64)
    often = np.diff(np.append(starts, n))
    ids, low = own[starts[often > 2]], low[np.repeat(often > 2, often)]
    return ids, np.append(0, np.cumsum(often[often > 2])), low >> np.uint32(8), low.astype(np.uint8)


def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(8):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w = w + np.clip(np.linalg.solve(hessian, x.T @ (y - p) - penalty * w), -3, 3)
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE) -> tuple[Decoder, Scorer]:
    """The letter model from all documents; the scorer from a sample of at most `rows` labelled ones, restored."""
    decoder = Decoder(letter_counts(docs))
    held = share(docs.sparkSession, decoder)

    def run(batches):
        every = Features(held())
        for pdf in batches:
            rows = [sorted(every.of(t).items()) for t in pdf["text"]]
            yield pd.DataFrame({"label": pdf["label"], "ids": [np.array([i for i, _ in r], np.int32).tobytes() for r in rows], "values": [bytes(round(255 * v) for _, v in r) for r in rows]})

    got = sample(docs, labels, "toxic", learn, rows).mapInPandas(run, "label int, ids binary, values binary").toArrow()
    got = sorted(zip(*(got[c].to_pylist() for c in ("label", "ids", "values"))))
    return decoder, Scorer([(y, np.frombuffer(i, np.int32), np.frombuffer(v, np.uint8)) for y, i, v in got])


def score(docs: DataFrame, model: tuple[Decoder, Scorer]) -> DataFrame:
    """doc_id and toxicity, a probability, of every row. A null or empty text has no words: it gets the base rate.

    Equal texts get equal scores. Without labels of both kinds every text gets the same score, near 0 unless all are
    toxic. Other columns are ignored.
    """
    return docs.select("doc_id", rating(docs, model).alias("toxicity"))


def rating(docs: DataFrame, model: tuple[Decoder, Scorer]) -> Column:
    """The toxicity of the text column as an expression: only texts go to Python, other columns stay as they are."""
    held = share(docs.sparkSession, model)

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder, scorer = held()
        chosen = Features(decoder, scorer.weights)
        for texts in batches:
            yield pd.Series([scorer.score(chosen.of(t or "")) for t in texts], dtype=float)

    return rate("text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc() % 4 == 2
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"), ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))
