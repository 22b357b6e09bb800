"""Operator 2: quality rules kept as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit
per failed rule; a policy is a versioned set of rules, applied with one bitwise AND, and an
ablation asks which documents a policy would keep without one of its rules, from the same
bits and without reading a text again.

Defined results: a null or empty text has no words and all measurements 0, so it fails
`few_words`. Repeated rows and null ids get a row each. An empty table gives an empty ledger.
Columns of the input pass through; names that clash with the ledger's get a suffix of `_`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import arrow_column, fresh, text_bytes
from claimloom.llm.words import inside, windows, word_batches

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Name and failing condition of each rule; a rule's bit is its place here, so rules are only ever appended.
RULES = (
    ("few_words", lambda m: m["n_words"] < 50),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    ("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    ("long_words", lambda m: m["word_chars"] > 15 * m["n_words"]),
    ("repeated_lines", lambda m: (m["n_dup_lines"] >= 4) & (100 * m["n_dup_lines"] > 30 * m["n_lines"])),  # one repeated line among three is no sign yet
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that reject a document.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "short_words", "long_words", "repeated_lines"),
}
CURRENT = 2

_SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])  # white space, and all but a code point's first byte


def _repeated_words(w) -> np.ndarray:
    """Words of each text that lie in 3-word windows found twice or more in that text."""
    out = np.zeros(len(w), np.int64)
    if len(w.hash) < 3:
        return out
    own = inside(w.doc, 3)
    x = windows(w.hash, 3) ^ (w.doc[: len(own)].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    ordered = np.sort(x[own])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        hit = np.flatnonzero(own & np.isin(x, twice))
        covered = np.zeros(len(w.hash), bool)
        for k in range(3):
            covered[hit + k] = True
        out += np.bincount(w.doc[covered], minlength=len(w))
    return out


def _measure(texts: pa.Array) -> pa.Array:
    columns: list[list[np.ndarray]] = [[] for _ in MEASURES]
    for rows in text_bytes(texts):
        for w in word_batches(rows):
            lines = [[x for x in t.split(b"\n") if x.strip()] for t in w.texts]
            for c, values in zip(
                columns,
                (
                    np.diff(w.first),
                    [len(t.translate(None, _NOT_COUNTED)) for t in w.texts],
                    [len(t) - len(t.translate(None, _SYMBOLS)) for t in w.texts],
                    [len(x) for x in lines],
                    [len(x) - len(set(x)) for x in lines],
                    _repeated_words(w),
                ),
                strict=True,
            ):
                c.append(np.asarray(values, np.int64))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in columns], list(MEASURES))


def measurements(text: Column) -> Column:
    """Struct of MEASURES of a text, counted over the whole text."""
    return arrow_column(_measure, ", ".join(f"{m} bigint" for m in MEASURES))(text)


def failure_bits(m: Column) -> Column:
    """The failure bits of a struct of measurements."""
    bits = F.lit(0).cast("bigint")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(fails(m), F.lit(BIT[name])).otherwise(F.lit(0)).cast("bigint"))
    return bits


def mask(policy: int, without: str | None = None) -> int:
    return sum(BIT[r] for r in POLICIES[policy] if r != without)


def ledger(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (default: all) columns of docs, the measurements, and fail_bits."""
    m = fresh(docs, "measured")
    keep = docs.columns if keep is None else keep
    out = docs.select(*[docs[c] for c in keep], measurements(docs[text_col]).alias(m))
    names = {x: fresh(docs.select(*keep), x) for x in (*MEASURES, "fail_bits")}
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(m)[x].alias(names[x]) for x in MEASURES], failure_bits(F.col(m)).alias(names["fail_bits"]))


def bits_column(rows: DataFrame) -> str:
    """The ledger's failure bits: the last column of that name, with or without a suffix, since a ledger puts them last."""
    return [c for c in rows.columns if c.rstrip("_") == "fail_bits"][-1]


def apply_policy(rows: DataFrame, policy: int = CURRENT, bits: str | None = None) -> DataFrame:
    """rows of a ledger with `kept` as last column: no rule of the policy failed. A column of that name stays, and the new one gets a suffix of `_`."""
    return rows.withColumn(fresh(rows, "kept"), F.col(bits or bits_column(rows)).bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame, policy: int = CURRENT, bits: str | None = None) -> DataFrame:
    """One row per rule of the policy: documents that it fails, and those that only it rejects."""
    held = F.col(bits or bits_column(rows)).bitwiseAND(F.lit(mask(policy)))
    counts = rows.select(held.alias("b")).groupBy("b").agg(F.count("*").alias("n"))  # at most 2**rules rows
    per_rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("bigint").alias("bit")) for r in POLICIES[policy]]))
    return (
        counts.select("b", "n", per_rule.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("b").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_rejected_alone"),
        )
    )


def keep_good(docs: DataFrame, text_col: str = "text", policy: int = CURRENT) -> DataFrame:
    """The rows of docs whose text passes the policy, with their columns unchanged."""
    m = fresh(docs, "measured")
    return docs.withColumn(m, measurements(docs[text_col])).where(failure_bits(F.col(m)).bitwiseAND(F.lit(mask(policy))) == 0).drop(m)
