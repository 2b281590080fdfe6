# No postponed annotations here: pandas UDFs need real types.
"""Scalar functions with the string, number and date rules of JavaScript, as native columns but for to_fixed1."""

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLANK = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower(c: str | Column) -> Column:  # F1
    return F.lower(col(c))


def includes(c: str | Column, part: str | Column) -> Column:
    """literal substring; part is a value if a string."""
    return F.contains(col(c), F.lit(part) if isinstance(part, str) else part)


def starts_with(c: str | Column, prefix: str) -> Column:  # F3
    return F.startswith(col(c), F.lit(prefix))


def first_piece(c: str | Column, divider: str) -> Column:
    """what stands before the first divider; '' stays ''."""
    return F.split_part(col(c), F.lit(divider), F.lit(1))


def prefix(c: str | Column, n: int) -> Column:  # F5
    return F.substring(col(c), 1, n)


def truncated(c: str | Column, n: int = 200) -> Column:
    """at most n characters, then dots if any were left out."""
    return F.concat(prefix(c, n), F.when(F.length(col(c)) > n, "...").otherwise(""))


def file_stem(c: str | Column) -> Column:  # F7
    return first_piece(c, ".")


def falsy_to(c: str | Column, default: str | Column) -> Column:
    """Null and '' give the default."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default) if isinstance(default, str) else default)


def safe_job_title(title: str | Column, description: str | Column) -> Column:  # F8
    return F.coalesce(F.nullif(col(title), F.lit("")), F.nullif(prefix(first_piece(description, "\n"), 60), F.lit("")), F.lit("Unknown Role"))


def trim(c: str | Column) -> Column:
    """without white space of any Unicode kind at either end."""
    return F.btrim(col(c), F.lit(BLANK))


def utf16_length(c: str | Column) -> Column:
    """F10, exact: UTF-16 units."""
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("bigint")


def byte_length(c: str | Column) -> Column:  # F11
    return F.octet_length(col(c)).cast("bigint")


def rounded(c: str | Column) -> Column:
    """halves go up, also below zero."""
    return F.floor(col(c) + 0.5).cast("bigint")


def quotient(c: str | Column, by: int) -> Column:  # F13
    return F.floor(col(c) / by).cast("bigint")


def _fixed1(x: pd.Series) -> pd.Series:
    v = x.to_numpy(np.float64, na_value=np.nan)
    # formatting rounds the exact value, but ties, which are odd quarters, to even
    quarters = np.rint(v * 4)
    tie = (v * 4 == quarters) & (quarters % 2 != 0)
    return pd.Series(np.char.mod("%.1f", np.where(tie, v + np.copysign(0.01, v), v)), dtype=object).where(~np.isnan(v), None)


def to_fixed1(c: str | Column) -> Column:
    """one decimal of the exact binary value, ties away from zero. The only scalar without a native form."""
    return F.pandas_udf(_fixed1, StringType())(col(c))


def backoff_ms(attempt: int, jitter: float) -> float:
    """what to wait after a failed attempt; jitter from 0 up to 1."""
    return 2000 * 2**attempt + jitter * 1000


def stable_id(*of: str | Column) -> Column:
    """F16: nine characters in base 36 from a hash, in place of chance, so that a recomputed row keeps its id."""
    return F.substring(F.lpad(F.lower(F.conv(F.hex(F.abs(F.xxhash64(*of))), 16, 36)), 13, "0"), 5, 9)


def prefixed_id(kind: str, ms: str | Column) -> Column:
    """kind-epoch_ms."""
    return F.concat(F.lit(f"{kind}-"), col(ms).cast("string"))


def time_ago(ts: str | Column, as_of: Column) -> Column:
    """F18; a time to come is now, one a week old or more its date (F19: en-US, session time zone)."""
    ms = F.unix_millis(as_of.cast("timestamp")) - F.unix_millis(col(ts).cast("timestamp"))
    pieces = [F.floor(ms / unit).cast("bigint") for unit in (60_000, 3_600_000, 86_400_000)]
    out = F.when(pieces[0] < 1, "Just now")
    for most, n, unit in zip((60, 24, 7), pieces, "mhd"):
        out = out.when(n < most, F.concat(n.cast("string"), F.lit(f"{unit} ago")))
    return out.otherwise(F.date_format(col(ts), "M/d/yyyy"))


def iso_time(ts: str | Column) -> Column:  # F19
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def locale_time(ts: str | Column) -> Column:  # F19
    return F.date_format(col(ts), "M/d/yyyy, h:mm:ss a")


def csv_field(c: str | Column) -> Column:
    """quoted if it has a comma, a quote or a line feed; null is ''."""
    x = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(x.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def array_or_empty(c: str | Column) -> Column:  # F23
    return F.coalesce(col(c), F.array().cast("array<string>"))


def overlay(old: Column, new: Column, old_fields: Iterable[str], new_fields: Iterable[str]) -> Column:
    """a struct of old with new's fields laid over it, null ones too; what only old has stays. Where there is no new, old as it is."""
    over = list(new_fields)
    kept = [f for f in old_fields if f not in over]
    return F.struct(*[old[f].alias(f) for f in kept], *[F.when(new.isNotNull(), new[f]).otherwise(old[f]).alias(f) for f in over])


def counted(n: str | Column, noun: str) -> Column:
    """the noun, with s unless n is 1."""
    return F.concat(col(n).cast("string"), F.lit(f" {noun}"), F.when(col(n) == 1, "").otherwise("s"))


def blob_id(c: str | Column) -> Column:
    """the middle of tp-x-..., else the id as it is."""
    return F.when(F.startswith(col(c), F.lit("tp-")) & (F.size(F.split(col(c), "-")) >= 3), F.split_part(col(c), F.lit("-"), F.lit(2))).otherwise(col(c))


def user_key(email: str | Column) -> Column:  # W3
    return falsy_to(email, "guest")


def storage_key(email: str | Column) -> Column:  # F27
    return F.concat(F.lit("resume-screener-history-"), user_key(email))


def full_name(mode: str | Column, first: str | Column, last: str | Column) -> Column:  # F28
    return F.when(col(mode) == "signup", F.concat_ws(" ", col(first), col(last))).otherwise("System User")


def clean_text(c: str | Column) -> Column:
    """Small letters, all but letters, digits and +#. as single blanks."""
    return trim(F.regexp_replace(lower(c), "[^\\p{L}\\p{N}+#.]+", " "))
