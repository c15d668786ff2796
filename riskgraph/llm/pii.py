"""Personal data with DataFrame functions only.

Per kind a regular expression proposes spans (JVM regular expressions; possessive and anchored to
the start of a run, so that long runs cost linear time and no recursion), a validator confirms
them (Luhn, mod-97, value ranges) and context words nearby adjust a score.  Positions come from
the lengths of the text between matches: ``split`` and ``regexp_extract_all`` of one pattern give
gaps and matches, whose running lengths are the starts and ends in code points.

An IBAN may be followed by words that look like more of it, so its pattern takes only the head (country
and check digits) and looks ahead at the longest run that may follow; each end of a group in that run
is tested, and of several that leave 1 the one of the country's length is taken, else the longest.

The four base kinds stay whatever their score; further kinds need ``THRESHOLD``.

Edge cases: a null or empty text has no spans; texts are scanned whole; repeated rows each get
their result; extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import read

#: Characters before and after a span in which context words count.
NEAR = 48
THRESHOLD = 0.6


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes; ``gate`` is a text every match contains (a cheap first test).

    With ``head`` the pattern takes that many characters, and its group 1 is the longest run they may start.
    """

    name: str
    pattern: str
    score: float
    context: str
    gate: str = ""
    head: int = 0


_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"\b(?:e-?mail|mailto|contact)\b", "@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.7, r"\b(?:ip|host|server|address)\b", "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.8, r"\b(?:card|visa|master|amex|credit|payment)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, r"\b(?:phone|tel|mobile|call|fax)\b", "+"),
)
MORE = (
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])))[A-Z]{2}[0-9]{2}", 0.9,
         r"\b(?:iban|bank|account|konto|cuenta|compte)\b", head=4),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.5, r"\b(?:ssn|social security)\b", "-"),
    Kind("birth_date", r"(?<![0-9./-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9./-])", 0.3, r"\b(?:born|birth|dob|geboren|nacido|naissance)\b", "-"),
)
KINDS = BASE + MORE

#: Lengths of the registered countries' IBANs.
IBAN_LENGTHS = {c: int(n) for c, n in re.findall("([A-Z]{2})([0-9]{2})", """
    AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24
    FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21
    LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22
    RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30""")}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97, letters read as 10 to 35."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(acc, i):
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = F.split(match, r"\.")
        return F.forall(part, lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def iban_size(run: Column) -> Column:
    """Characters of the IBAN that ``run`` starts with, at an end of one of its groups; 0 if there is none."""
    groups = F.split(run, " ")
    expected = F.try_element_at(F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair]), F.substring(run, 1, 2))

    def end(i):
        part = F.slice(groups, F.lit(1), i)
        s = F.array_join(part, "")
        good = F.when(F.length(s).between(15, 34), mod97(s)).otherwise(False)
        return F.struct(good.alias("good"), F.coalesce(F.length(s) == expected, F.lit(False)).alias("usual"),
                        F.length(F.array_join(part, " ")).alias("size"))

    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size(groups)), end))
    return F.when(best["good"], best["size"]).otherwise(0)


def _spans(kind: Kind, text: Column) -> Column:
    """Array of ``kind, start, end, score`` of the confirmed matches of one kind."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1 if kind.head else 0))
    gaps = F.split(text, kind.pattern, -1)
    item = "struct<s: int, e: int, m: string>"
    state = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{item}>").alias("out"))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["g"])
        if kind.head:
            size, at = iban_size(pair["m"]), start + kind.head
            last = F.coalesce(F.try_element_at(acc["out"], F.lit(-1))["e"], F.lit(0))
            good = (size > 0) & (start >= last)
        else:
            size = F.length(pair["m"])
            at, good = start + size, valid(kind.name, pair["m"])
        one = F.struct(start.alias("s"), (start + size).alias("e"), pair["m"].alias("m")).cast(item)
        return F.struct(at.alias("at"), F.when(good, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    pairs = F.filter(F.arrays_zip(gaps.alias("g"), matches.alias("m")), lambda p: p["m"].isNotNull())
    found = F.aggregate(pairs, state, step, lambda acc: acc["out"])

    def scored(x):
        begin = F.greatest(x["s"] - NEAR, F.lit(0))
        around = F.concat_ws(" ", F.substring(text, begin + 1, x["s"] - begin), F.substring(text, x["e"] + 1, F.lit(NEAR)))
        score = F.lit(kind.score) + F.when(F.lower(around).rlike(kind.context), 0.35).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["s"].alias("start"), x["e"].alias("end"),
                        F.round(F.least(score, F.lit(1.0)), 2).alias("score"))

    out = F.transform(found, scored)
    if kind in MORE:
        out = F.filter(out, lambda x: x["score"] >= THRESHOLD)
    none = F.array().cast("array<struct<kind: string, start: int, end: int, score: double>>")
    hit = text.contains(kind.gate) if kind.gate else text.rlike(kind.pattern)
    return F.when(hit, out).otherwise(none)


def find(docs: DataFrame, kinds=KINDS) -> DataFrame:
    """``doc_id, text`` and ``found``: spans by kind as listed, then start; null texts are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"))
    return base.select("doc_id", "text", F.concat(*[_spans(k, F.col("text")) for k in kinds]).alias("found"))


def redact(text: Column, found: Column) -> Column:
    """``text`` with every span replaced by ``[KIND]``; of overlapping spans the first to start names all."""
    spans = F.array_sort(F.transform(found, lambda x: F.struct(
        x["start"].alias("s"), (-x["end"]).alias("e"), x["kind"].alias("k"))))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.upper(x["k"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], -x["e"]).alias("at"), F.when(x["s"] >= acc["at"], put).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def op3_pii(spark, sf_dir) -> DataFrame:
    found = find(read(spark, sf_dir, "documents")).drop("text")
    names = [k.name for k in BASE]

    def spans(xs):
        return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda x: x["kind"].isin(names))
    return found.select("doc_id", *[count(n) for n in names], F.sha2(spans(base), 256).alias("base_sha256"), spans("found").alias("spans"))


def mask(docs: DataFrame, kinds=KINDS) -> DataFrame:
    """Rows of ``docs``, all columns, with the spans of ``text`` replaced; ``n_chars`` is renewed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn("_found", F.concat(*[_spans(k, text) for k in kinds]))
    out = found.withColumn("text", F.when(F.size("_found") > 0, redact(F.col("text"), F.col("_found"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("_found") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in every text."""
    return mask(docs)
