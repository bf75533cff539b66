"""Message and domain rules: normalising, URLs, reputation, lookalikes, the content cascade, scrubbing."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
SCAM_WORDS = ["lottery", "prize", "winner", "claim", "urgent", "deactivated", "verify", "click", "suspended", "unauthorized", "kindly", "momo", "ghs", "won", "congratulations"]
BRANDS = ["bog", "ecobank", "gcb", "momo", "mtn"]
LEGITIMATE = ["bog.gov.gh", "ecobank.com", "gcb.com.gh", "mtn.com", "mtn.com.gh", "mymtn.com.gh"]
SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "is.gd", "buff.ly", "ow.ly", "rb.gy", "cutt.ly", "shorturl.at", "lnkd.in", "rebrand.ly", "bl.ink", "snip.ly", "soo.gd"]
URL = r"(?i)https?://[^\s<>\"')\]}]+"
PHONE = r"\b(?:\+?[0-9]{8,15}|0[0-9]{9})\b"
AMOUNT = r"\b(?:GHS|GH₵|GHC|\$|£|€)?\s?[0-9]{1,3}(?:[,.\s][0-9]{3})*(?:[.,][0-9]{1,2})?\b"
NUMBER = r"\b[0-9]+\b"


def collapse(body: Column) -> Column:
    return F.trim(F.regexp_replace(body, r"\s+", " "))


def ascii_only(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def _a_labels(domain: pd.Series) -> pd.Series:
    """A-labels of domains; null where a label cannot be one. Each different label of a batch is encoded once."""
    known: dict = {}

    def encoded(label: str):
        if label not in known:
            try:
                known[label] = label if label.isascii() else label.encode("idna").decode()
            except UnicodeError:
                known[label] = None
        return known[label]

    def whole(name):
        labels = [encoded(x) for x in name.split(".")]
        return None if None in labels else ".".join(labels)

    return domain.map(lambda d: None if d is None else whole(d))


def nfc(text: Column) -> Column:
    """Unicode normal form C. Texts of ASCII only are in it and stay in the JVM: the function gets null for them."""
    return F.when(ascii_only(text), text).otherwise(_nfc(F.when(~ascii_only(text), text)))


def canonical_ascii(domain: Column) -> Column:
    """As canonical, with labels beyond ASCII as A-labels (nameprep and Punycode); null where one cannot be."""
    d = canonical(domain)
    own = F.when(ascii_only(d), d).otherwise(_a_labels(F.when(~ascii_only(d), d)))
    return F.when(~own.rlike(r"(^|\.)(\.|$)"), own)


def body_hash(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(collapse(body), 256))


def template(body: Column) -> Column:
    """The text with phones, amounts and numbers as tokens, in this order. It is in small letters before, so a currency stays."""
    return masked(F.lower(collapse(body)))


def masked(text: Column) -> Column:
    out = text
    for pattern, token in ((PHONE, "<MSISDN>"), (AMOUNT, "<AMOUNT>"), (NUMBER, "<NUM>")):
        out = F.regexp_replace(out, pattern, token)
    return out


def prefixed(lead: Column, text: Column, template_: Column) -> tuple[Column, Column]:
    """Hash and template of lead followed by a text, whose collapsed form and template are known.

    lead is empty or ASCII with one blank at its end, before which is no currency. Then only an amount that starts with the
    text's first digit can reach over the blank; such texts are gone through anew.
    """
    body = F.trim(F.concat(lead, text))
    apart = F.trim(F.concat(masked(F.lower(lead)), template_))
    return F.concat(F.lit("sha256:"), F.sha2(body, 256)), F.when((lead != "") & text.rlike("^[0-9]"), masked(F.lower(body))).otherwise(apart)


def urls(body: Column) -> Column:
    """Distinct URLs, sorted, without punctuation behind them, scheme and host in small letters."""
    # a URL has no white space, so it stands in the text as it is; most texts have none and are not searched
    none = F.array().cast("array<string>")
    found = F.when(F.contains(body, F.lit("://")), F.regexp_extract_all(body, F.lit(f"({URL})"), F.lit(1))).when(body.isNotNull(), none)
    clean = F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]}\"']+$", ""))
    lowered = F.transform(clean, lambda u: F.concat(F.lower(F.regexp_extract(u, r"^([^/]*//[^/?#]*)", 1)), F.regexp_replace(u, r"^[^/]*//[^/?#]*", "")))
    return F.array_sort(F.array_distinct(lowered))


def domain_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/:?#]+)", 1))


def canonical(domain: Column) -> Column:
    """Small letters, no blanks around and no dots behind; null where a label is empty or it is too long."""
    d = F.rtrim(F.lower(F.trim(domain)), F.lit("."))
    return F.when((d != "") & (F.length(d) <= 253) & ~d.rlike(r"(^|\.)(\.|$)"), d)


def registrable(domain: Column) -> Column:
    """The last two labels."""
    return F.substring_index(domain, ".", -2)


def valid_domain(domain: Column) -> Column:
    """Whether a canonical domain is small letters, digits, dots and hyphens with letters at the end; null is not."""
    return F.coalesce(domain.rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$"), F.lit(False))


def suffixes(domain: Column, least: int = 1) -> Column:
    """The domain and its parents, down to `least` labels."""
    labels = F.split(domain, r"\.")
    n = F.size(labels)
    return F.when(n >= least, F.transform(F.sequence(F.lit(1), n - least + 1), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def listed(df: DataFrame, domain: str, blocked: DataFrame, least: int = 1) -> DataFrame:
    """df with `listed`, the longest suffix of its domain that is in blocked (column domain), else null.

    The distinct domains are exploded to suffixes and joined, not the events.
    """
    names = df.select(domain).where(F.col(domain).isNotNull()).distinct()
    exploded = names.select(domain, F.explode(suffixes(F.col(domain), least)).alias("suffix"))
    hit = exploded.join(blocked.select(F.col("domain").alias("suffix")).distinct(), "suffix").groupBy(domain).agg(F.max_by("suffix", F.length("suffix")).alias("listed"))
    return df.join(hit, domain, "left")


def not_allowed(df: DataFrame, domain: str, allowed: DataFrame) -> DataFrame:
    """df without the rows whose domain, or a parent of it, is in allowed (column domain); rows without domain stay."""
    own = listed(df.select(domain).distinct(), domain, allowed.select(canonical(F.col("domain")).alias("domain"))).where("listed is not null")
    return df.join(own.select(domain), domain, "left_anti")


def shortener(domain: Column) -> Column:
    d = F.rtrim(F.lower(domain), F.lit("."))
    out = d.isin(SHORTENERS)
    for s in SHORTENERS:
        out = out | d.endswith("." + s)
    return out


def lookalike(domain: Column) -> Column:
    """target, distance of the brand that a domain imitates; both null if it does not.

    Legitimate domains and what is below them do not. A brand in any label is enough; else the root label must be one or
    two edits from a legitimate one (ties by name).
    """
    d = F.rtrim(F.lower(domain), F.lit("."))
    fine = F.lit(False)
    for x in LEGITIMATE:
        fine = fine | (d == x) | d.endswith("." + x)
    brand = F.get(F.filter(F.array(*[F.lit(b) for b in BRANDS]), lambda b: F.contains(d, b)), F.lit(0))
    root = F.substring_index(registrable(d), ".", 1)
    near = F.array_min(F.array(*[F.when(F.levenshtein(root, F.lit(x.split(".")[0]), 2).isin(1, 2), F.struct(F.levenshtein(root, F.lit(x.split(".")[0]), 2).alias("distance"), F.lit(x).alias("target"))) for x in LEGITIMATE]))
    return F.struct(F.when(~fine, F.coalesce(brand, near["target"])).alias("target"), F.when(~fine & brand.isNull(), near["distance"]).alias("distance"))


def cascade(df: DataFrame) -> DataFrame:
    """df (body, bad_body, bad_template, reputation, url, domain flags) with score, signal_kind and severity.

    In order: known body, known template, no body, reputation of a URL, lookalike, shortener, three scam words, URL only.
    """
    words = F.array(*[F.lit(w) for w in SCAM_WORDS])
    # the text is an argument here, so it is put in small letters once and not for each word
    hits = F.get(F.transform(F.array(F.lower("body")), lambda b: F.size(F.filter(words, lambda w: F.contains(b, w)))), F.lit(0))
    none, fake, short = F.coalesce(F.col("body"), F.lit("")) == "", F.col("target").isNotNull(), F.coalesce(F.col("short"), F.lit(False))
    rated, three, url = F.col("reputation").isNotNull(), hits >= 3, F.col("url").isNotNull()
    def pick(body, temp, empty, rep, both, look, shortened, words, link, rest):
        return F.when(F.col("bad_body"), body).when(F.col("bad_template"), temp).when(none, empty).when(rated, rep).when(fake & short, both).when(fake, look).when(short, shortened).when(three, words).when(url, link).otherwise(rest)

    null = F.lit(None).cast("string")
    return df.withColumns({
        "score": pick(0.98, 0.93, 0.0, F.col("reputation"), 0.85, 0.78, 0.55, 0.75, 0.35, 0.05),
        "signal_kind": pick("sms.known_bad_body", "sms.known_bad_template", null, "sms.malicious_url", "sms.ott_lookalike", "sms.ott_lookalike", "sms.url_shortener_abuse", "sms.template_smishing", null, null),
        "severity": pick("critical", "high", "low", F.when(F.col("reputation") > 0.8, "high").otherwise("medium"), "high", "high", "medium", "medium", "low", "low"),
    })


def dns_verdict(df: DataFrame) -> DataFrame:
    """domain rows with target, short and newly_seen as a verdict: lookalike .85 high, shortener .65 medium, new .30 low."""
    fake, short = F.col("target").isNotNull(), F.col("short")
    return df.withColumns({"confidence": F.when(fake, 0.85).when(short, 0.65).when(F.col("newly_seen"), 0.3).otherwise(0.0), "severity": F.when(fake, "high").when(short, "medium").when(F.col("newly_seen"), "low")})


def redact(value: Column) -> Column:
    """Phones keep four and two characters, long numbers two and two, other values only their length."""
    n = F.length(value)
    phone = value.rlike(r"^\+[0-9]{8,15}$")
    return F.when(value.isNull(), "<none>").when(n == 0, "<empty>").when(phone, F.concat(F.substring(value, 1, 4), F.lit("****"), F.substring(value, -2, 2))).when(value.rlike(r"^[0-9]{10,}$"), F.concat(F.substring(value, 1, 2), F.lit("****"), F.substring(value, -2, 2))).otherwise(F.concat(F.lit("<redacted:"), n, F.lit(">")))


# Fields whose values are never shown.
PRIVATE = [
    "account", "account_hash", "account_number", "callee", "caller", "card", "card_number", "imei", "imsi", "msisdn", "national_id", "password", "phone", "phone_number", "pin", "recipient",
    "recipient_wallet_id", "secret", "sender", "sender_wallet_id", "ssn", "token", "wallet_id",
]


def redact_nested(value: Column, more: tuple[str, ...] = (), depth: int = 8) -> Column:
    """A VARIANT in which the values of private fields are redacted, in objects within objects, whatever the case of names.

    Arrays and values of other fields stay. What lies deeper than `depth` objects is redacted as a whole, so nothing is
    shown that was not looked at. Null stays null; a value that is no object stays.
    """
    names = [*PRIVATE, *(m.lower() for m in more)]

    def level(x: Column, left: int) -> Column:
        def field(k: Column, v: Column) -> Column:
            return F.when(F.lower(k).isin(names), redact(v.cast("string")).cast("variant")).otherwise(level(v, left - 1))

        whole = redact(x.cast("string")).cast("variant") if left == 0 else F.to_variant_object(F.transform_values(x.cast("map<string,variant>"), field))
        return F.when(F.schema_of_variant(x).startswith("OBJECT"), whole).otherwise(x)

    return level(value, depth)


def scrub(text: Column) -> Column:
    """Free text without phones, device ids and tokens."""
    out = text
    for pattern, token in ((r"\+[0-9]{8,15}", "[+REDACTED-MSISDN]"), (r"\b0[25][0-9]{8}\b", "[REDACTED-MSISDN]"), (r"\b[0-9]{14,17}\b", "[REDACTED-DIGITS]"), (r"\b[A-Za-z0-9_\-]{32,}\b", "[REDACTED-TOKEN]")):
        out = F.regexp_replace(out, pattern, token)
    return out
