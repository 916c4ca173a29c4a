"""Personal data by patterns, checksums and context, in DataFrame functions only.

Regular expressions propose spans, checks confirm them (octets up to 255, the Luhn sum, digit counts, IBAN modulo 97),
and the words around a span move its score. Spans of the base kinds stay whatever their score; the further kinds
need ``KEEP``. The matches of a pattern come from one call, the texts between them from another; their lengths give the
places, so nothing leaves the JVM. A pattern starts only where a match can start, which keeps it linear on
long runs of letters or digits.

Defined results: a null or empty text has no spans; a null key and repeated rows are reported as they are; an empty
table gives no rows. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP = 0.5
# Characters on either side of a span that are searched for context words.
CONTEXT = 48

_LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """``needs`` is a cheap test a text must pass; base kinds are kept whatever their score."""

    name: str
    pattern: str
    needs: str
    prior: float
    context: str
    base: bool = True


# Possessive and look-behind forms of the patterns: same matches, no backtracking over long runs.
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "@", 0.8, "mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9]\.[0-9]", 0.6, "ip|address|host|server|adresse"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){13}", 0.7, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", r"[A-Z]{2}[0-9]{2}", 0.6, "iban|account|bank|konto|compte|cuenta", base=False),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"[0-9]-[0-9]{2}-[0-9]", 0.2, "ssn|social|security|insurance", base=False),
)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    numbers = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    summed = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(summed, F.lit(0), lambda total, d: total + d) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN passes its check: first four characters last, letters as 10 to 35, remainder 1."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    numbers = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(numbers, F.lit(0), lambda rest, d: (rest * F.when(d > 9, 100).otherwise(10) + d) % 97) == 1


def _valid(kind: str, value: Column) -> Column:
    count = F.length(_digits(value))
    if kind == "ip":
        return ~value.rlike(r"(?:^|\.)0*(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?:\.|$)")
    if kind == "card":
        return count.between(14, 19) & luhn(F.when(count.between(14, 19), _digits(value)).otherwise(""))
    if kind == "phone":
        return count.between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & mod97(value)
    return F.lit(True)


def _found(kind: Kind, order: int, text: Column) -> Column:
    """All confirmed spans of a kind as (start, end, kind, score), from one pass for matches and one for the gaps."""
    gaps = F.transform(F.split(text, kind.pattern, -1), F.length)
    pairs = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    valid = F.aggregate(
        F.filter(pairs, lambda p: p["match"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + F.length(p["match"])).alias("at"),
            F.when(
                _valid(kind.name, p["match"]),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), p["match"].alias("value")))),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )

    def scored(s: Column) -> Column:
        end = s["start"] + F.length(s["value"])
        begin = F.greatest(s["start"] - CONTEXT, F.lit(0))
        around = F.concat(F.substring(text, begin + 1, s["start"] - begin), F.lit(" "), F.substring(text, end + 1, F.lit(CONTEXT)))
        near = around.rlike(f"(?i)(?:^|[^A-Za-z])(?:{kind.context})(?:[^A-Za-z]|$)")
        score = F.when(near, F.lit(kind.prior + (1 - kind.prior) * 0.7)).otherwise(F.lit(kind.prior))
        return F.struct(s["start"].alias("start"), F.lit(order).alias("kind_order"), end.alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))

    spans = F.transform(valid, scored)
    kept = spans if kind.base else F.filter(spans, lambda s: s["score"] >= KEEP)
    nothing = F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string,score:double>>")
    return F.when(text.rlike(kind.needs), kept).otherwise(nothing)


def personal_data(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with ``pii``: all spans (start, kind_order, end, kind, score) in order, in code points, end exclusive."""
    docs = docs.drop("pii", *[f"_{k.name}" for k in kinds])
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({f"_{k.name}": _found(k, i, content) for i, k in enumerate(kinds)})
    return rows.withColumn("pii", F.array_sort(F.concat(*[F.col(f"_{k.name}") for k in kinds]))).drop(*[f"_{k.name}" for k in kinds])


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans as text."""
    base = [k.name for k in kinds if k.base]
    rows = personal_data(docs.select(key, text), text, kinds)
    rows = rows.select(key, "pii", F.filter("pii", lambda s: s["kind"].isin(base)).alias("_base"))
    return rows.select(
        key,
        *[_count(name).alias(f"n_{name}") for name in base],
        F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
    )


def redacted(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans the first is replaced."""
    rows = personal_data(docs, text, kinds)
    content = F.coalesce(F.col(text), F.lit(""))
    walk = F.aggregate(
        F.col("pii"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(content, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(content, acc["at"] + 1, F.length(content))),
    )
    return rows.withColumn(text, F.when(F.col(text).isNotNull(), walk)).drop("pii")
