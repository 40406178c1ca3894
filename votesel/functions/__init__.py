"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from votesel.functions.exprs import hash_key, hex_bucket, hex_fraction, pmod  # noqa: F401
