"""Column expressions: digests, resource names, sizes, versions, instants, codes. All stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from buildlens import schemas as S


def lookup(code: Column, table: dict, default=None) -> Column:
    """Constant code table as a CASE chain."""
    chain = reduce(lambda acc, kv: acc.when(code == F.lit(kv[0]), F.lit(kv[1])), table.items(), F)
    return chain.otherwise(F.lit(default)) if default is not None else chain


def test_status_name(code: Column) -> Column:
    return lookup(code, S.TEST_STATUS, "NO_STATUS")


def canonical_digest(raw: Column) -> Column:
    """Lower-case digest when it is exactly 64 hex characters, else null."""
    return F.when(raw.rlike("^[0-9a-fA-F]{64}$"), F.lower(raw))


def split_digest(rendered: Column) -> tuple[Column, Column]:
    """``hash-size`` at the last dash -> (hash, size)."""
    h = F.regexp_extract(rendered, "^(.*)-([^-]*)$", 1)
    s = F.regexp_extract(rendered, "^(.*)-([^-]*)$", 2).try_cast("bigint")
    return F.when(h != "", h), s


def resource_parts(name: Column) -> tuple[Column, Column]:
    """Digest and size from the last two path parts; both null when there is no such pair."""
    parts = F.split(name, "/")
    size = F.try_element_at(parts, F.lit(-1)).try_cast("bigint")
    # a cast tolerates blanks and fractions that an integer literal must not have
    size = F.when(F.try_element_at(parts, F.lit(-1)).rlike(r"^[+-]?[0-9]+$"), size)
    digest = F.try_element_at(parts, F.lit(-2))
    return F.when(size.isNotNull(), digest), F.when(digest.isNotNull(), size)


def instant(raw: Column) -> Column:
    """RFC 3339 text -> timestamp; text that is no instant gives null."""
    return raw.try_cast("timestamp")


def span_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two timestamps; null for a negative span (see ``skewed``)."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.when(micros >= 0, F.floor(micros / 1000).cast("bigint"))


def skewed(start: Column, end: Column) -> Column:
    return F.coalesce(end < start, F.lit(False))


def same_instant(start: Column, end: Column) -> Column:
    """Both present and equal as text, so nanoseconds count."""
    return F.coalesce(start == end, F.lit(False))


def fraction_digits(raw: Column) -> Column:
    """Digits after the seconds' point without trailing zeros: keeps what a timestamp cuts off."""
    return F.rtrim(F.regexp_extract(raw, r"\.([0-9]+)", 1), F.lit("0"))


def digest_of(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def byte_size(content: Column) -> Column:
    return F.octet_length(content).cast("bigint")


def version_of(raw: Column) -> Column:
    """``major[.minor[.patch]]`` as a struct; a bad minor or patch counts as 0, a bad major gives null."""
    parts = F.split(raw, r"\.")

    def number(i: int) -> Column:
        part = F.try_element_at(parts, F.lit(i))
        return F.when(part.rlike(r"^\+?[0-9]+$"), part.try_cast("int"))

    return F.when(
        number(1).isNotNull(),
        F.struct(
            number(1).alias("major"),
            F.coalesce(number(2), F.lit(0)).alias("minor"),
            F.coalesce(number(3), F.lit(0)).alias("patch"),
        ),
    )


# Fixed value: how a user agent names the build tool and its version.
TOOL_TOKEN = r"(?i)bazel/\s*(\S+)"


def client_version(header: Column, user_agent: Column) -> Column:
    """Version from the dedicated header, else from the tool token of the user agent."""
    token = F.regexp_extract(user_agent, TOOL_TOKEN, 1)
    return F.coalesce(version_of(F.trim(header)), version_of(F.when(token != "", token)))


# Size suffixes and their factor to megabytes, longest first.
SIZE_UNITS = [
    ("KIB", 1 / 1024),
    ("MIB", 1.0),
    ("GIB", 1024.0),
    ("TIB", 1024.0 * 1024.0),
    ("KB", 1 / 1024),
    ("MB", 1.0),
    ("GB", 1024.0),
    ("TB", 1024.0 * 1024.0),
    ("B", 1 / (1024 * 1024)),
]


def megabytes(raw: Column) -> Column:
    """Human-readable size -> MB. No suffix means bytes; text that is no size counts as 0."""
    text = F.upper(F.trim(raw))
    unit = F.regexp_extract(text, "([KMGT]I?B|B)$", 1)
    amount = F.regexp_replace(text, "([KMGT]I?B|B)$", "").try_cast("double")
    factor = lookup(unit, dict(SIZE_UNITS), 1 / (1024 * 1024))
    return F.coalesce(amount * factor, F.lit(0.0))


def percent_half_up(part: Column, whole: Column) -> Column:
    """``round(100*part/whole)`` with halves up, 0 for an empty whole."""
    return F.when(whole > 0, F.floor(F.lit(100.0) * part / whole + 0.5)).otherwise(F.lit(0)).cast("bigint")


def contains_text(column: Column, query: str) -> Column:
    return F.contains(F.lower(column), F.lit(query.lower()))
