"""Text expressions for names and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rendered texts.
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
PAYLOAD_CHARS = 4000
CUT_MARK = " …[truncated]"
MISSING = "—"
UNTRUSTED_START = "<untrusted-data>"
UNTRUSTED_END = "</untrusted-data>"
REDACTED = "[REDACTED]"
SECRET_CHARS = 8


def stripped(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def normalize_topic(name: Column) -> Column:
    return F.lower(stripped(name))


def _cut(x: Column, most: int) -> Column:
    short = F.regexp_replace(F.substring(x, 1, most), r"(?U)\s+$", "")
    return F.when(F.length(x) > most, F.concat(short, F.lit(CUT_MARK))).when(x == "", MISSING).otherwise(x)


def normalize_payload(text: Column, most: int = PAYLOAD_CHARS) -> Column:
    """No control characters, no white space at the ends, ``most`` characters at most; a blank text is a dash."""
    return _cut(stripped(F.regexp_replace(text, CONTROLS, "")), most)


def normalize_excerpt(text: Column, most: int = PAYLOAD_CHARS) -> Column:
    """Like a payload, with line feeds as the only line ends and no white space before them."""
    lines = F.regexp_replace(F.regexp_replace(text, CONTROLS, ""), r"\r\n?", "\n")
    return _cut(stripped(F.regexp_replace(lines, r"(?U)[^\S\n]+(?=\n|$)", "")), most)


def wrap_untrusted(label: Column | str, text: Column) -> Column:
    name = F.lit(label) if isinstance(label, str) else label
    return F.concat(F.lit(UNTRUSTED_START + " kind="), name, F.lit("\n"), text, F.lit("\n" + UNTRUSTED_END))


def redact(text: Column, secrets: list[str]) -> Column:
    """Secrets of SECRET_CHARS characters or more give way to a mark."""
    return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit(REDACTED)), [s for s in secrets if len(s) >= SECRET_CHARS], text)


def secrets_present(text: Column, secrets: list[str]) -> Column:
    found = [F.when(F.contains(text, F.lit(s)), s) for s in secrets if len(s) >= SECRET_CHARS]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def evidence_ids(text: Column) -> Column:
    """Distinct ids such as E12, ascending as texts."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(E\d+)\b"), F.lit(1))))


def search_terms(**terms: Column) -> Column:
    """``name:value`` for every value that isn't null, with single spaces; ``query`` stands without its name."""
    return F.concat_ws(" ", *(v if k == "query" else F.when(v.isNotNull(), F.concat(F.lit(f"{k}:"), v.cast("string"))) for k, v in terms.items()))
