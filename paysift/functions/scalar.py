"""Scalar column expressions.

All of these are native Catalyst expressions, so they stay inside whole-stage codegen and do not
block predicate pushdown or constant folding (the original application used opaque UDFs for each of them).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_currency(c, strict: bool = True) -> Column:
    """Remove every ``$`` and parse the rest as a double.

    ``strict`` raises on unparsable text (``1,234.5``, empty string) like the original; the
    lenient form returns null instead. Null stays null; blanks around the number are accepted.
    """
    text = F.regexp_replace(_col(c), r"\$", "")
    return text.cast("double") if strict else text.try_cast("double")


def to_double(c, strict: bool = True) -> Column:
    """String (or integral) to double. Strict raises on bad text, lenient gives null."""
    return _col(c).cast("double") if strict else _col(c).try_cast("double")


def bucket_label(c, width: int = 100) -> Column:
    """Truncate to int, then floor toward zero to a multiple of ``width``; as text.

    1250.9 -> "1200", -250.9 -> "-200", null -> null.
    """
    i = _col(c).cast("int")
    return (i - i % F.lit(width)).cast("string")


def abs_error(label, prediction) -> Column:
    """|y - y_hat|."""
    return F.abs(_col(label) - _col(prediction))


def relative_error(label, prediction) -> Column:
    """|y - y_hat| / |y| as a fraction (not x100). A zero label gives null instead of Inf/NaN."""
    return F.try_divide(F.abs(_col(label) - _col(prediction)), F.abs(_col(label)))


def split_bucket(keys: list[str], seed: int) -> Column:
    """Layout-independent bucket 0..99 of a row, from md5 of its key columns and a seed.

    Unlike ``randomSplit`` it does not depend on partitioning or task order, so a split is the
    same on every cluster size and can be reproduced by plain SQL.
    """
    digest = F.md5(F.concat_ws("|", *[_col(k).cast("string") for k in keys], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100


def row_hash_key(keys: list[str], seed: int = 0) -> Column:
    """Hex md5 of the key columns: a repeatable pseudo-random order for sampling."""
    return F.md5(F.concat_ws("|", *[_col(k).cast("string") for k in keys], F.lit(str(seed))))


def unit_hash(keys: list, salt) -> Column:
    """Deterministic uniform number in [0, 1) from key columns and a salt column or literal."""
    parts = [_col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    salt_c = salt.cast("string") if isinstance(salt, Column) else F.lit(str(salt))
    digest = F.md5(F.concat_ws("|", *parts, salt_c))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
