"""Personal data: base patterns, and wider candidates that boosted trees accept or turn down."""

from __future__ import annotations

import ipaddress
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, table

SAMPLE = 20_000  # candidates that the trees are fitted on, at most; an equal part for each kind
PRECISION = 0.95  # of the candidates that a threshold lets through
BASE = ("email", "ip", "card", "phone")
WIDER = ("secret", "number", "tel", "mail", "host")
KINDS = BASE + WIDER

# The base formats.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# from where a run of digits begins, as all leftmost matches do, so a long run is read once
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")

# Generators of candidates; their spans may overlap.
GENERATORS = (
    ("secret", re.compile(r"[A-Za-z0-9_+/=-]{16,}")),
    ("number", re.compile(r"[0-9](?:[ ./-]?[0-9]){8,}")),
    ("tel", re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}")),
    ("host", re.compile(r"(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}")),
)
# Disguised mail is found from its "at".
AT = re.compile(r" ?(?:[\[(] ?at ?[\])]| at ) ?")
DOTTED = re.compile(r"[A-Za-z0-9-]+(?:(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[A-Za-z0-9-]+)+")
DOT = re.compile(r" ?[\[(] ?dot ?[\])] ?| dot ")
TLDS = frozenset(
    "com org net edu gov mil int info biz name pro io ai app dev xyz online site tech cloud shop test example invalid local "
    "ac ad ae af ag al am ao ar at au az ba bb bd be bf bg bh bi bj bn bo br bs bt bw by bz ca cd cf cg ch ci ck cl cm cn co cr cu cv cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fm fo fr "
    "ga ge gh gm gn gr gt gy hk hn hr ht hu id ie il in iq ir is it je jm jo jp ke kg kh ki km kr kw kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mk ml mm mn mo mr mt mu mv mw mx my mz "
    "na ne ng ni nl no np nr nz om pa pe pg ph pk pl ps pt pw py qa ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st sv sy sz td tg th tj tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vn vu ws ye za zm zw".split()
)
HINTS = ("token", "secret", "key", "passw", "phone", "tel", "call", "mail", "card", "account", "iban", "id", "ip", "host")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their @: what is before it does not change whether a domain follows."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base spans, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = NO_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return out


def disguised(text: str) -> list[tuple[int, int]]:
    """Addresses with a spelled at, as far to the left as their name goes."""
    out, done, at = [], 0, AT.search(text)
    while at:
        start = at.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at.start() and (m := DOTTED.match(text, at.end())):
            out.append((start, m.end()))
            done = m.end()
        at = AT.search(text, max(at.start() + 1, done))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    out = []
    digit = DIGIT.search(text)
    for kind, pattern in GENERATORS:
        if digit or kind == "host":
            out += [(kind, *m.span()) for m in pattern.finditer(text) if kind != "secret" or DIGIT.search(m[0])]
    return out + [("mail", a, b) for a, b in disguised(text)]


def known(text: str, kind: str, start: int, end: int) -> bool:
    """Whether what the trees do not see shows a candidate to be right: the name of a secret before it, a real top-level
    domain behind a marked at or dot (or after a word for mail), an address that parses."""
    own, before = text[start:end], text[max(0, start - 24) : start]
    if kind == "secret":
        return bool(re.search(r"(?i)(token|secret|key|passw\w*)\W{0,6}$", before))
    if kind == "mail":
        marked = "(" in own or "[" in own or " dot " in own or re.search(r"(?i)(mail|contact|write to|reach)\W{0,6}$", before)
        return bool(marked) and DOT.sub(".", own).rpartition(".")[2] in TLDS
    if kind == "host":
        groups = own.split(":")
        if before[-1:] == ":" or before[-1:].isalnum() or text[end : end + 1] == ":" or text[end : end + 1].isalnum():
            return False
        return (len(groups) == 6 and all(len(g) == 2 for g in groups)) or _parses(own)
    return False


def _parses(address: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(address))
    except ValueError:
        return False


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Numbers about the format of a candidate and what stands around it; no checksum and no validity test."""
    own, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
    n, counts = len(own), Counter(own)
    digits, upper = sum(c.isdigit() for c in own), sum(c.isupper() for c in own)
    hexa = sum(c in "0123456789abcdefABCDEF" for c in own)
    groups = [len(g) for g in re.findall(r"[0-9]+", own)] or [0]
    low = before.lower()
    return [
        float(WIDER.index(kind)), n, digits / n, upper / n, hexa / n, len(counts) / n, -sum(c / n * math.log(c / n) for c in counts.values()),
        len(groups), max(groups), min(groups), groups[0], own.count(" "), own.count("-"), own.count("."), own.count("(") + own.count("["),
        max((low.rfind(h) for h in HINTS), default=-1) + 1, float(any(c in before[-4:] for c in "=:")), float(before[-1:] in "\"'"), float(before[-1:] == "+"), float("@" in before[-12:]), float(before[-1:].isalnum()),
        float(after[:1] in "\"'"), float(after[:1].isalnum()), float(after[:1] in ".,;"), float("@" in after),
    ]


def _found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        out = []
        for text in texts:
            sure = base(text)
            more = [(k, a, b) for k, a, b in candidates(text)]
            named = [{"kind": k, "start": a, "end": b} for k, a, b in sure]
            rows = []
            for k, a, b in more:
                covered = any(x < b and a < y for _, x, y in sure)
                rows.append({"kind": k, "start": a, "end": b, "covered": covered, "label": int(covered or known(text, k, a, b)), "features": describe(text, k, a, b)})
            out.append((named, rows))
        yield pd.DataFrame({"base": [x for x, _ in out], "more": [x for _, x in out]})


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans (arrays of kind, start, end) of every row.

    Offsets are code points, the end exclusive. A null or empty text has no spans. Base spans always stay. A candidate is
    added if the trees give it its kind's threshold, it overlaps no base span and no added one with a higher score
    (ties: the earlier, then the longer). Equal rows are each searched. Where the candidates are all of one label there
    is nothing to learn from, and nothing is added. Other columns are ignored.

    The trees learn from candidates whose label is known: those that lie on a base span or that known() accepts, by
    checks that they do not see. They are fitted on a bounded sample by hash, an equal part of it for each kind. The
    thresholds are set on all other candidates.
    """
    span = "struct<kind: string, start: int, end: int>"
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    search = F.pandas_udf(_found, f"base array<{span}>, more array<struct<kind: string, start: int, end: int, covered: boolean, label: int, features: array<double>>>")
    # only texts go to Python, so ids stay as they are
    found = materialize(texts.select("doc_id", "row", search("text").alias("x")).select("doc_id", "row", "x.base", "x.more"), "found")
    more = found.where("size(more) > 0").select("row", F.posexplode("more").alias("at", "x")).select("row", "at", "x.*").withColumn("vector", array_to_vector("features"))
    order = F.xxhash64("row", "at")
    first = [more.where((F.col("kind") == k) & (F.pmod(order, F.lit(2)) == 0)).orderBy(order, "row", "at").limit(SAMPLE // len(WIDER)) for k in WIDER]
    fit = materialize(reduce(DataFrame.unionByName, first).select("row", "at", "label", "features"), "fit").withColumn("vector", array_to_vector("features"))
    if fit.select("label").distinct().count() < 2:
        return found.select("doc_id", "base", F.array().cast(f"array<{span}>").alias("added"))
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=12, maxDepth=4, seed=1).fit(fit)
    score = vector_to_array("probability")[1]
    scored = materialize(model.transform(more).select("row", "kind", "start", "end", "at", "covered", "label", score.alias("score")), "scored")
    least = thresholds(scored.join(F.broadcast(fit.select("row", "at")), ["row", "at"], "left_anti"))
    rated = scored.where("not covered")
    passed = F.lit(False)
    for k, t in least.items():
        passed = passed | ((F.col("kind") == k) & (F.col("score") >= t))
    rated = rated.where(passed).groupBy("row").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "start", (-F.col("end")).alias("last"), "kind"))).alias("rated"))
    joined = found.select("doc_id", "row", "base").join(rated, "row", "left")

    @F.pandas_udf(f"array<{span}>")
    def pick(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            added = []
            for rated in lists:
                taken: list[tuple[int, int, str]] = []
                for r in rated if rated is not None else ():
                    if not any(a < -r["last"] and r["start"] < b for a, b, _ in taken):
                        taken.append((r["start"], -r["last"], r["kind"]))
                added.append([{"kind": k, "start": a, "end": b} for a, b, k in sorted(taken, key=lambda x: (KINDS.index(x[2]), x[0]))])
            yield pd.Series(added)

    return joined.select("doc_id", "base", pick("rated").alias("added"))


def thresholds(scored: DataFrame, precision: float = PRECISION) -> dict[str, float]:
    """The lowest score of each kind from which on the wanted part of the candidates is right (by hundredths)."""
    bins = scored.groupBy("kind", F.floor(F.col("score") * 100).alias("bin")).agg(F.sum("label").alias("right"), F.count("*").alias("n")).collect()
    out = {}
    for kind in {r["kind"] for r in bins}:
        right = n = 0
        for r in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]):
            right, n = right + r["right"], n + r["n"]
            if right >= precision * n:
                out[kind] = r["bin"] / 100
    return out


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first covers the rest."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long) as n_{k}") for k in BASE]
    every = F.concat("base", "added")
    return found.select("doc_id", *count, F.sha2(text("base"), 256).alias("base_sha256"), text(every).alias("spans"))


