"""JSON text with the separators and escapes of Python's ``json.dumps``, byte for byte, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that have an escape of two, fixed by the format.
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}
_ASCII, _PLAIN = r"[^\x20\x21\x23-\x5b\x5d-\x7e]", r"[\x00-\x1f\x22\x5c]"


def _unit(n: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))


def _escape(c: Column) -> Column:
    """The escape of one character; beyond 16 bits it is that of a surrogate pair."""
    n = F.ascii(c)
    pair = F.concat(_unit((n - 0x10000).bitwiseAND(0xFFC00) / 1024 + 0xD800), _unit((n - 0x10000).bitwiseAND(0x3FF) + 0xDC00))
    out = F.when(n < 0x10000, _unit(n)).otherwise(pair)
    for plain, short in SHORT.items():
        out = F.when(c == plain, F.lit(short)).otherwise(out)
    return out


def string(value: Column, ascii_only: bool = True) -> Column:
    """A JSON string, or null's text; with ``ascii_only`` all but ASCII is escaped, in lower-case digits."""
    odd = _ASCII if ascii_only else _PLAIN
    parts = F.struct(F.split(value, odd, -1).alias("gaps"), F.regexp_extract_all(value, F.lit(odd), F.lit(0)).alias("odd"))
    joined = lambda s: F.array_join(F.zip_with(s["gaps"], s["odd"], lambda g, c: F.concat(g, F.when(c.isNull(), "").otherwise(_escape(c)))), "")
    escaped = F.when(value.rlike(odd), F.element_at(F.transform(F.array(parts), joined), 1)).otherwise(value)
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def number(value: Column) -> Column:
    """A whole number, or null's text."""
    return F.coalesce(value.cast("bigint").cast("string"), F.lit("null"))


def array(values: Column, item: Callable[[Column], Column]) -> Column:
    """An array whose elements ``item`` writes; null's text where the array is null."""
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: item(x)), ", "), F.lit("]")), F.lit("null"))


def obj(fields: dict[str, Column], sort_keys: bool = False) -> Column:
    """An object of fields that are JSON already, in the order given or by name; names are plain."""
    names = sorted(fields) if sort_keys else list(fields)
    parts = [part for i, n in enumerate(names) for part in (F.lit(f'{", " if i else ""}"{n}": '), fields[n])]
    return F.concat(F.lit("{"), *parts, F.lit("}"))
