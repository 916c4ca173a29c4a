"""Column helpers shared by the operators. All of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEMPORAL = tuple(
    getattr(T, name) for name in ("DateType", "TimestampType", "TimestampNTZType", "TimeType") if hasattr(T, name)
)
NESTED = tuple(getattr(T, name) for name in ("ArrayType", "MapType", "StructType", "VariantType") if hasattr(T, name))


def kind_of(data_type: T.DataType) -> str:
    """Profile kind of a column: numeric, temporal, generic (nested) or categorical."""
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, TEMPORAL):
        return "temporal"
    if isinstance(data_type, NESTED):
        return "generic"
    return "categorical"


def quoted(name: str) -> str:
    """A column name for use in a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A text for use in a SQL expression."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def time_sql(sql: str) -> str:
    """A time as text whose text order is its time order: no fraction, or all six digits of it."""
    text = f"CAST(CAST({sql} AS TIMESTAMP_NTZ) AS STRING)"
    return f"CASE WHEN LENGTH({text}) = 19 THEN {text} ELSE RPAD({text}, 26, '0') END"


def time_text(sql: str) -> Column:
    return F.expr(time_sql(sql))


def value_sql(sql: str, data_type: T.DataType) -> str:
    """Text of a value as the evidence and the profile show it."""
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return time_sql(sql)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return f"CAST({sql} + 0D AS STRING)"  # -0.0 and 0.0 are one value
    if isinstance(data_type, NESTED):
        return f"to_json({sql})"
    return f"CAST({sql} AS STRING)"


def value_text(sql: str, data_type: T.DataType) -> Column:
    return F.expr(value_sql(sql, data_type))


def looks_like_time_sql(sql: str) -> str:
    """At least ten characters, four leading digits and a dash somewhere."""
    return f"(LENGTH({sql}) >= 10 AND {sql} RLIKE '^[0-9]{{4}}' AND CONTAINS({sql}, '-'))"


def hash_uniform(seed: int | str, *parts: Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of an md5, equal on every engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def words_of(text: Column) -> Column:
    """Distinct lower-cased words of a text, split at any Unicode white space."""
    parts = F.split(F.lower(text), r"[\t-\r\x1c-\x20\x85\p{Z}]+")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def filled(template: str, **values: Column | str) -> Column:
    """A template as a concatenation: known names become values, unknown ones stay as they are."""
    return F.concat(*[F.lit(p) if k == "text" else values[p] if isinstance(values[p], Column) else F.lit(values[p])
                      for k, p in _pieces(template, values)])


def strict_filled(template: str, **values: Column | str) -> Column:
    """Like ``filled`` but an unknown name is an error."""
    unknown = [p for k, p in _pieces(template, None) if k == "name" and p not in values]
    if unknown:
        raise KeyError(unknown[0])
    return filled(template, **values)


def _pieces(template: str, known) -> list[tuple[str, str]]:
    from string import Formatter

    out: list[tuple[str, str]] = []
    for literal, name, _spec, _conv in Formatter().parse(template):
        if literal:
            out.append(("text", literal))
        if name is not None:
            known_name = known is None or name in known
            out.append(("name", name) if known_name else ("text", "{" + name + "}"))
    return out or [("text", "")]
