"""Personal data: regular expressions propose spans, checksums confirm them, words before them adjust the score.

DataFrame functions only. Base kinds: ``email``, ``ip``, ``card`` (Luhn) and ``phone``, leftmost and non-overlapping
inside a kind; a match that fails its check is dropped and not tried again. The method adds ``iban`` (mod-97),
``ssn`` (three groups of digits; only with a context word, as nothing else confirms it), ``secret`` (a long value after
``=``, ``:`` or ``Bearer``, with letters, digits and at least eight different characters; only with a context word) and
``key`` (published formats of access keys, signed tokens and private key blocks). Every span has a score: a
start value by kind, ``CONTEXT_BONUS`` more if one of the kind's words stands in the ``CONTEXT_CHARS`` code points
before it. Base spans and confirmed ones always stay; the score decides only about kinds without a check.

The patterns are written so that each is linear in the text: repeats are possessive, and a run of characters is tried
only from its first one or from the end of the match before (``\\G``), which finds the same matches. Positions are
running sums over pieces between matches, in two levels, so that a text with very many matches stays cheap.

Defined cases: a null or empty text has no span; equal rows have equal results; other columns are passed through, and
those named like a result are replaced. There is no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret", "key")
# Patterns of the kinds, words that make a kind more likely, start scores.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16})(?<=[=:][\x20\t]{0,4}[\"']?|[Bb]earer\x20)[A-Za-z0-9+/_-]++=*+",
    "key": r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+"
           r"|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)(?![A-Za-z0-9_])",
}
CONTEXT = {
    "email": "mail|contact|write to|adresse|correo",
    "ip": "address|server|host|login",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer",
    "secret": "token|secret|passw|passphrase|api.?key|access.?key|private.?key|credential|auth|bearer|signature|kennwort|contraseñ|mot de passe",
    "key": "key|token|secret",
}
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.9, "ssn": 0.2, "secret": 0.3, "key": 0.9}
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.35
THRESHOLD = 0.5
#: Kinds that stay whatever their score: the base ones and those that a checksum confirms.
CERTAIN = ("email", "ip", "card", "phone", "iban", "key")
#: A text without one of these characters has no match of the kind.
NEEDED = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
RUN = 256
#: Different characters that a secret has at least.
DISTINCT = 8


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _sums_from(start: Column, xs: Column) -> Column:
    """Sums before each element, from ``start``."""
    none = F.array().cast("array<bigint>")
    return F.aggregate(
        xs, F.struct(start.alias("at"), none.alias("sums")),
        lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["sums"], F.array(a["at"])).alias("sums")),
        lambda a: a["sums"])


def sums_before(xs: Column) -> Column:
    """Exclusive running sums of an array; runs of ``RUN`` first, so that the cost stays near linear."""
    zero = F.lit(0).cast("bigint")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")),
                       lambda r: F.slice(xs, r * RUN + 1, RUN))
    starts = _sums_from(zero, F.transform(runs, _total))
    split = F.flatten(F.zip_with(runs, starts, lambda run, start: _sums_from(start, run)))
    return F.when(F.size(xs) <= RUN, _sums_from(zero, xs)).otherwise(split)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.split(F.reverse(digits), "")
    worth = F.transform(backwards, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.pmod(F.aggregate(worth, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(10)) == 0


def mod97_ok(s: Column) -> Column:
    """Whether an account number (spaces allowed) has remainder 1 by 97, letters as 10 to 35, front four moved back."""
    plain = F.replace(s, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    value = F.transform(F.split(turned, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    rest = F.aggregate(value, F.lit(0), lambda a, x: F.coalesce(
        F.when(x > 9, a * 100 + x).otherwise(a * 10 + x) % 97, a))
    return rest == 1


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.length(_digits(s)).between(16, 19) & luhn_ok(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    if kind == "iban":
        return F.length(F.replace(s, F.lit(" "), F.lit(""))).between(15, 34) & mod97_ok(s)
    if kind == "secret":
        # random values have letters and digits and repeat few of them; names and plain numbers do not pass
        return s.rlike("[0-9]") & s.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(s, ""))) >= DISTINCT)
    return F.lit(True)


def _spans_of(kind: str, text: Column, threshold: float) -> Column:
    """Confirmed and scored spans of one kind, from its matches and their starts."""
    def span(x: Column) -> Column:
        near = F.lower(F.substring(text, F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0)).cast("int") + 1,
                                   F.least(x["start"], F.lit(CONTEXT_CHARS)).cast("int")))
        score = F.lit(START_SCORE[kind]) + F.when(near.rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"),
                        (x["start"] + F.length(x["text"])).alias("stop"), x["text"].alias("text"),
                        F.least(score, F.lit(1.0)).alias("score"))

    scored = F.transform(F.filter(F.col(f"_s_{kind}"), lambda x: _valid(kind, x["text"])), span)
    if kind not in CERTAIN:
        scored = F.filter(scored, lambda x: x["score"] >= threshold)
    return F.when(F.size(F.col(f"_m_{kind}")) > 0, scored).otherwise(
        F.array().cast("array<struct<kind:string,start:bigint,stop:bigint,text:string,score:double>>"))


def pii_spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``pii``: spans ``(kind, start, stop, text, score)``, by kind as listed, then start (code points)."""
    docs = docs.drop("pii")
    whole = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    frame, text = docs, F.col("_text")
    frame = frame.withColumn("_text", whole)
    found = {}
    for kind in KINDS:
        matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        if kind in NEEDED:
            matches = F.when(F.contains(text, F.lit(NEEDED[kind])), matches).otherwise(none)
        found[f"_m_{kind}"] = matches
    frame = frame.withColumns(found)
    gaps = {}
    for kind in KINDS:
        m = F.col(f"_m_{kind}")
        between = F.transform(F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(m)),
                              lambda p: F.length(p).cast("bigint"))
        gaps[f"_g_{kind}"] = F.when(F.size(m) > 0, between)
    frame = frame.withColumns(gaps)
    starts = {}
    for kind in KINDS:
        m, g = F.col(f"_m_{kind}"), F.col(f"_g_{kind}")
        steps = F.zip_with(g, m, lambda gap, s: gap + F.length(s))
        starts[f"_s_{kind}"] = F.when(F.size(m) > 0, F.zip_with(
            F.zip_with(sums_before(steps), g, lambda a, gap: a + gap), m,
            lambda at, s: F.struct(at.alias("start"), s.alias("text"))))
    frame = frame.withColumns(starts)
    spans = [_spans_of(kind, text, threshold) for kind in KINDS]
    return frame.select(*docs.columns, F.concat(*spans).alias("pii"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Per document: counts by base kind, digest of the base spans, list of all spans, highest score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, pii = pii_spans(docs), F.col("pii")
    base = F.filter(pii, lambda x: x["kind"].isin("email", "ip", "card", "phone"))
    return found.select(
        "doc_id",
        *[_count(pii, kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(pii).alias("spans"))
