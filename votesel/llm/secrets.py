"""Secret scan with built-in DataFrame functions only: patterns plus sliding-window Shannon entropy.

Three fixed patterns give the base spans. On top of them every candidate string (a maximal run of one
character class) is read with a sliding window: the counts of the window's symbols are kept in one array
and changed by the symbol that enters and the one that leaves, and the sum of ``c * log2(c)`` changes with
them, so each step costs the same whatever the window's width. Windows whose entropy
``log2(w) - sum / w`` reaches the class's threshold are joined into spans. Candidates on the allow-list
(identifiers with dashes, repeated or counting placeholders, words, paths, documented examples) and spans
inside a base span are left out.

Everything is a row expression: one scan, no shuffle, memory bounded by a row. Null text counts as empty;
repeated rows give repeated results; overlapping base spans of different kinds are all kept; spans are
ordered by start, then kind (assign, access, hex, entropy64, entropy16). Offsets are code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, with the least length of the group that counts.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),  # a greedy run: the same as all runs, then those of 18 or more
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)


@dataclass(frozen=True)
class EntropyClass:
    """A character class: its symbols, the candidates' pattern, the window and the threshold in bits."""

    name: str
    symbols: str
    pattern: str
    window: int
    bits: float


#: Random base64 windows of 24 symbols average 4.4 bits and rarely fall below 4.0; words stay below 3.8.
#: Random hex windows of 24 symbols average 3.4 bits; candidates of digits only are on the allow-list.
CLASSES = (
    EntropyClass("entropy64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", r"[A-Za-z0-9+/_=-]{24,}", 24, 4.0),
    EntropyClass("entropy16", "0123456789ABCDEF", r"[0-9A-F]{24,}", 24, 3.0),
)

#: Candidates that are no secrets.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"^[A-Za-z/_=+-]+$",  # words, paths: a token without a digit
    r"^[0-9/_=+-]+$",  # numbers, dates
    r"(?i)(example|sample|placeholder|changeme|dummy|xxxx)",
    r"(?i)(abcdefghij|0123456789|1234567890)",
    r"^(?i:sha(1|256|384|512))-",  # content digests
    r"^([A-Za-z]+[0-9]{0,4}[/_-])+[A-Za-z]+[0-9]{0,4}$",  # slugs
)

SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Leftmost non-overlapping matches with offsets. ``split`` gives the pieces between the matches, so
    a match starts behind all pieces and matches before it."""
    rx = F.lit(pattern)
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, rx, F.lit(0))
    if group:
        kept = F.regexp_extract_all(text, rx, F.lit(group))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    parts = F.arrays_zip(found.alias("m"), F.slice(pieces, F.lit(1), F.size(found)).alias("p"), (kept if group else found).alias("g"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        stop = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(F.length(x["g"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def _windows(candidate: Column, cls: EntropyClass, offset: Column, kind: int) -> Column:
    """Joined windows of one candidate that reach the threshold, by incremental counts."""
    w = cls.window
    symbols = F.lit(cls.symbols)
    codes = F.transform(F.split(candidate, ""), lambda c: F.call_function("instr", symbols, c) - 1)
    xlog = lambda n: F.when(n > 1, n * F.log2(F.greatest(n, F.lit(1.0)))).otherwise(F.lit(0.0))
    zero = F.struct(
        F.array_repeat(F.lit(0.0), len(cls.symbols)).alias("n"), F.lit(0.0).alias("s"), F.array().cast(SPAN).alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        i, code, gone = x["i"], x["c"], x["g"]
        had = F.get(acc["n"], code)
        # the symbol that enters, then the one that leaves (none while the first window fills)
        added = acc["s"] + xlog(had + 1) - xlog(had)
        after = F.get(acc["n"], gone) + F.when(gone == code, 1.0).otherwise(0.0)
        total = F.when(gone >= 0, added - xlog(after) + xlog(after - 1)).otherwise(added)
        counts = F.transform(acc["n"], lambda n, k: n + F.when(k == code, 1.0).otherwise(0.0) - F.when(k == gone, 1.0).otherwise(0.0))
        hot = (i >= w - 1) & (F.lit(w).cast("double") * (F.log2(F.lit(float(w))) - F.lit(cls.bits)) >= total - F.lit(1e-9))
        start, stop = offset + i - (w - 1), offset + i + 1
        last = F.element_at(acc["out"], -1)
        joined = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.struct(last["start"].alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"))))
        fresh = F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"))))
        out = F.when(~hot, acc["out"]).when((F.size(acc["out"]) > 0) & (F.coalesce(last["stop"], F.lit(-1)) >= start), joined).otherwise(fresh)
        return F.struct(counts.alias("n"), total.alias("s"), out.alias("out"))

    steps = F.transform(codes, lambda c, i: F.struct(i.alias("i"), c.alias("c"), F.coalesce(F.when(i >= w, F.get(codes, i - w)), F.lit(-1)).alias("g")))
    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def _allowed(candidate: Column) -> Column:
    found = F.lit(False)
    for rx in ALLOW:
        found = found | candidate.rlike(rx)
    return found


def _added(cls: EntropyClass, kind: int) -> Column:
    """Spans of the class's candidates that are neither allowed nor inside a base span."""

    def windows(span: Column) -> Column:
        candidate = F.col("text").substr(span["start"] + 1, span["stop"] - span["start"])
        return F.when(_allowed(candidate), F.array().cast(SPAN)).otherwise(_windows(candidate, cls, span["start"], kind))

    def outside(s: Column) -> Column:
        return ~F.exists(F.col("base"), lambda b: (b["start"] <= s["start"]) & (b["stop"] >= s["stop"]))

    return F.filter(F.flatten(F.transform(F.col(cls.name), windows)), outside)


def secret_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added``: sorted arrays of (start, kind, stop), kinds by position in ``KINDS``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    for k, (name, pattern, group, least) in enumerate(BASE):
        df = df.withColumn(name, _spans(F.col("text"), pattern, group, least, k))
    for k, cls in enumerate(CLASSES):
        df = df.withColumn(cls.name, _spans(F.col("text"), cls.pattern, 0, 1, len(BASE) + k))
    df = df.withColumn("base", F.array_sort(F.concat(*[F.col(b[0]) for b in BASE])))
    added = [_added(cls, len(BASE) + k) for k, cls in enumerate(CLASSES)]
    return df.select("doc_id", *[b[0] for b in BASE], "base", F.array_sort(F.concat(*added)).alias("added"))


KINDS = (*[b[0] for b in BASE], *[c.name for c in CLASSES])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of each row's whole text."""
    found = secret_spans(docs)
    counts = [F.size(b[0]).cast("long").alias(f"n_{b[0]}") for b in BASE]
    everything = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(everything).alias("spans"))
