"""Reusable Column expressions.

Everything here is a composition of ``pyspark.sql.functions`` so it stays
inside whole-stage codegen. The same formulas are written in the DuckDB oracle
SQL, so the two must stay in step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts) -> Column:
    """Reproducible pseudo-random order key: md5 of the parts joined by '|'.

    Build it from integers or strings only; double-to-string differs between engines.
    """
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hex_bucket(h: Column, digits: int) -> Column:
    """Order-preserving bucket of an md5 hex key: its first ``digits`` hex characters."""
    return F.substring(h, 1, digits)


def hex_fraction(h: Column) -> Column:
    """A value in [0, 1) from the first 8 hex digits of an md5 key."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pmod(a: Column, n) -> Column:
    return F.pmod(a, F.lit(n) if not isinstance(n, Column) else n)
