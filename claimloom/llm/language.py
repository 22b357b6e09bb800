"""Operator 3: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts hashed 2- and 3-grams of characters per language on the executors; the matrix of
log probabilities, languages by buckets, is the only thing that is broadcast. Scoring turns the
characters of many texts into bucket numbers at once and sums the matrix's entries per text.

Characters are lower-cased; what isn't a letter counts as one blank, and an n-gram counts where
its second character is a letter. A text is scored whole, in pieces that overlap by two
characters.

Defined results: null text, or text without a letter, is `und` with score 0; so is every text if
there is nothing to learn from. Rows without a language or text aren't learned from. Repeated
rows, null ids and extra columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import arrow_column, bound_batches

BUCKETS = 1 << 16
#: Training documents per language, in expectation: a language with more is sampled by a hash of the id.
TRAIN_PER_LANGUAGE = 4_000
#: Languages that a model may have, unless told otherwise: the broadcast matrix has so many times BUCKETS entries, 128 MB.
MOST_LANGUAGES = 500
SMOOTHING = 0.1
UNKNOWN = "und"
PIECE = 1 << 18

_letter = np.zeros(0x110000, np.int8)  # 0 not looked up yet, 1 letter, 2 other


def _letters(c: np.ndarray) -> np.ndarray:
    kind = _letter[c]
    if not kind.all():
        for x in np.unique(c[kind == 0]).tolist():
            _letter[x] = 1 if chr(x).isalpha() else 2
        kind = _letter[c]
    return kind == 1


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of pieces of about PIECE characters, with the number of each piece's text."""
    of: list[int] = []
    parts: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        t = (t or "").lower()
        for at in range(0, max(1, len(t)), PIECE):
            part = t[max(0, at - 2) : at + PIECE]
            of.append(i)
            parts.append(part)
            size += len(part) + 2
            if size >= PIECE:
                yield of, parts
                of, parts, size = [], [], 0
    if parts:
        yield of, parts


def _grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 2-grams and 3-grams that start at each character, where each counts, and each piece's first place."""
    c = np.frombuffer((" " + "  ".join(parts) + "   ").encode("utf-32-le", "replace"), np.uint32)
    letter = _letters(c)
    c = np.where(letter, c, 32).astype(np.uint64)
    two = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two + c[2:] * np.uint64(0x165667B19E3779F9)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    spread = np.uint64(0xFF51AFD7ED558CCD)
    first = np.concatenate(([0], np.cumsum([len(p) + 2 for p in parts])))
    return ((two ^ (two >> np.uint64(29))) * spread) >> shift, ((three ^ (three >> np.uint64(31))) * spread) >> shift, letter[1:-1], first


def _counter(langs: list[str]):
    place = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            texts, lang = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in set(lang):
                for _, parts in _pieces([t for t, x in zip(texts, lang, strict=True) if x == name]):
                    two, three, good, _ = _grams(parts)
                    for g in (two, three):
                        counts[place[name]] += np.bincount(g[good].astype(np.int64), minlength=BUCKETS)
        lang_no, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang_no, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[lang_no, bucket])], ["lang_no", "bucket", "n"])

    return run


class Model:
    """Languages, their log priors, and log probabilities (one row per language)."""

    def __init__(self, langs: list[str], prior: np.ndarray, logp: np.ndarray):
        self.langs, self.prior, self.logp = langs, prior, logp

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n = len(texts)
        score = np.tile(self.prior.astype(np.float64), (n, 1))
        seen = np.zeros(n, np.int64)
        for of, parts in _pieces(texts):
            two, three, good, first = _grams(parts)
            starts, of_ = first[:-1], np.array(of)
            np.add.at(seen, of_, np.add.reduceat(good.astype(np.int64), starts))
            for k, row in enumerate(self.logp):
                total = np.where(good, row[two] + row[three], np.float32(0))
                np.add.at(score[:, k], of_, np.add.reduceat(total, starts, dtype=np.float64))
        if not self.langs:
            return [UNKNOWN] * n, [0.0] * n
        best = score.argmax(1)
        p = 1.0 / np.exp(score - score.max(1, keepdims=True)).sum(1)
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best, seen, strict=True)], np.where(seen > 0, p, 0.0).tolist()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    """Learns from the labelled rows of docs: all of a language with up to per_language rows, else about that many by hash of id. More than most_languages are an error."""
    bound_batches()
    rows = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(rows[lang_col].alias("l")).agg(F.count("*")).limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(0), np.zeros((0, BUCKETS), np.float32))
    steps = 1 << 30
    kept = F.create_map(*[x for l in langs for x in (F.lit(l), F.lit(min(steps, -(-steps * per_language // counts[l]))))])
    sample = rows.where(F.pmod(F.xxhash64(rows[id_col].cast("string"), F.lit("train")), F.lit(steps)) < kept[rows[lang_col]])
    cells = sample.select(rows[text_col].alias("text"), rows[lang_col].alias("lang")).mapInArrow(_counter(langs), "lang_no int, bucket int, n bigint").groupBy("lang_no", "bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((len(langs), BUCKETS))
    n[cells["lang_no"], cells["bucket"]] = cells["n"]
    logp = np.log(n + SMOOTHING) - np.log(n.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    prior = np.log(np.array([counts[l] for l in langs], float) / sum(counts.values()))
    return Model(langs, prior, logp.astype(np.float32))


def predict(text: Column, model: Model, docs: DataFrame) -> Column:
    """Struct (lang, score): the most probable language and its posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        langs: list[str] = []
        scores: list[float] = []
        for at in range(0, len(texts), 256):
            found, p = shared.value.predict(texts.slice(at, 256).to_pylist())
            langs += found
            scores += p
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return arrow_column(run, "lang string, score double")(text)
