"""Operators 11 to 13 against literal versions: tries of dictionaries, the sentencepiece library, k-means in Python's integers."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import pieces, turntrie, vectorcodes
from tests.llm import tables

# 11. A trie of conversations.

TURNS = "conv_id bigint, turn bigint, role string, text string"


def brute_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


def brute_trie(built):
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: {q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p} for p in members}

    def under(p):
        return [p, *(x for q in kids[p] for x in under(q))]

    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under(p) if q)
        leaves = sum(not kids[q] for q in under(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def turns_of(seed, n, deep=6):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(4 * n), n):
        rows += [(c, t, r.choice(("user", "bot")), r.choice(("a", "b", "é", ""))) for t in range(r.randint(1, deep))]
    rows += [(9001, None, None, None), (9001, 1, "user", "b"), (None, 1, "user", "x"), (9002, 1, "user", None), (9002, 1, "user", None), (9005, 0, "user", "a")]
    rows += [(9500 + k, t, "user", "same") for k in range(40) for t in range(3)]
    rows += [(9700, t, "user", f"long {t}") for t in range(100)] + [(9703, t, "user", f"long {t}") for t in range(90)]
    return rows


def found_nodes(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_dictionaries(spark, seed):
    rows = turns_of(seed, 120)
    table = spark.createDataFrame([(*r, "extra") for r in rows], f"{TURNS}, key string").repartition(3)
    assert found_nodes(turntrie.nodes(turntrie.rebuilt(table))) == brute_trie(brute_rebuilt(rows))


def test_trie_of_many_small_shards(spark):
    """Every batch of seven conversations is a shard of its own, so that almost all nodes are at a boundary."""
    rows = turns_of(5, 60, 4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found_nodes(turntrie.nodes(turntrie.rebuilt(spark.createDataFrame(rows, TURNS)))) == brute_trie(brute_rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert turntrie.nodes(turntrie.rebuilt(spark.createDataFrame([], TURNS))).count() == 0
    c = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    rows = [(c, 0, "user", "gone")]
    assert found_nodes(turntrie.nodes(turntrie.rebuilt(spark.createDataFrame(rows, TURNS)))) == brute_trie(brute_rebuilt(rows))


def test_rows_are_sorted_by_all_columns():
    r = random.Random(4)
    seqs = [[r.randrange(2) for _ in range(r.choice((0, 1, 3, 40, 70)))] for _ in range(200)]
    seqs += [seqs[k] + [1] for k in range(50)]
    conv = np.array(r.sample(range(1000), len(seqs)))
    length = np.array([len(s) for s in seqs])
    first, ids = np.concatenate(([0], np.cumsum(length)[:-1])), np.array([x for s in seqs for x in s], np.int64)
    order = turntrie.sort_rows(conv, first, length, ids)
    assert order.tolist() == sorted(range(len(seqs)), key=lambda k: (seqs[k], conv[k]))
    shared = turntrie.shared_turns(first[order], length[order], ids).tolist()
    inside = [[seqs[k] for k in order][i : i + 2] for i in range(len(seqs) - 1)]
    assert shared == [-1, *(next((k for k in range(min(map(len, p))) if p[0][k] != p[1][k]), min(map(len, p))) for p in inside)]


# 12. Pieces.


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.model_path())


def test_pieces_equal_the_library(library):
    m, r = pieces.model(pieces.model_path()), random.Random(2)
    letters = [*"  \n\t▁aeiouthrn éü€漢😀\0\r'.,012", "  ", "   ", "the", "ing", "�", "ab"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(4000)]
    texts += ["", " ", "▁", "\n", " " * 5000, "a" * 5000, "<s></s><unk><0x41>", "é" * 999, "the" * 2000, "x " * 500]
    for t in texts:
        ids = list(memoryview(m.encode(t)).cast("i"))
        assert ids == library.encode(t, add_eos=True)
        assert m.decode(ids) == library.decode(ids)
    for _ in range(2000):
        ids = [r.randrange(32_000) if r.random() < 0.5 else r.randrange(300) for _ in range(r.randrange(10))]
        assert m.decode(ids) == library.decode(ids)


def test_backtracking_equals_joins():
    """On short words, the walk gives what joining gives, with and without the tables filled."""
    m, r = pieces.Pieces(pieces.model_path()), random.Random(3)
    for _ in range(3000):
        word = "▁" * r.randrange(4) + "".join(r.choice("aeiouthrnsing▁") for _ in range(r.randint(1, 25)))
        assert [m.spelled[i] for i in m.encode_word(word)] == m.join_again(word)


def test_pieces_without_cuts_are_the_same():
    """Cutting texts at white space only saves work."""
    m = pieces.Pieces(pieces.model_path())
    text = tables.prose(random.Random(1), "fr", 300)
    cut = m.encode(text)
    m.cut = None
    assert m.encode(text) == cut


def test_pieces_of_documents(spark, library):
    docs = tables.frame(spark)
    rows = docs.select("doc_id", "text", pieces.round_trip(docs["text"], pieces.model_path()).alias("r")).collect()
    for d in rows:
        assert d["r"]["ids"] == library.encode(d["text"] or "", add_eos=True)
        assert d["r"]["decoded"] == library.decode(d["r"]["ids"])
    coded = pieces.encode_documents(docs.withColumn("ids", F.lit(1)), pieces.model_path())
    back = coded.select("doc_id", "n_tokens", "ids", pieces.decode(F.col("ids"), pieces.model_path()).alias("t")).collect()
    assert len(back) == len(rows) and all(x["n_tokens"] == len(x["ids"]) and x["t"] == library.decode(x["ids"]) for x in back)
    assert pieces.encode_documents(docs.limit(0), pieces.model_path()).count() == 0


def test_models_that_are_not_implemented():
    good = ({pieces.MODEL_TYPE: pieces.BPE, pieces.BYTE_FALLBACK: 1}, {pieces.REMOVE_EXTRA: 0}, [pieces.BYTE] * 256)
    pieces.check_supported(*good)
    for bad in (({}, good[1], good[2]), (good[0], {}, good[2]), (good[0], good[1] | {pieces.CHARS_MAP: b"x"}, good[2]), (good[0], good[1], [*good[2], pieces.USER_DEFINED])):
        with pytest.raises(ValueError):
            pieces.check_supported(*bad)


# 13. Vector codes.

VECTORS = "vec_id bigint, embedding array<double>, label string"


def brute_codes(rows, parts=8, k=16, rounds=6):
    kept = [(i, [floor(4096 * Fraction(x)) for x in v], label) for i, v, label in rows if v and all(x is not None and abs(x) < inf for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == size * parts]
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:k]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(book))

    for r in range(rounds + 1):
        found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
        if r == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == e]
                books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else books[p][e]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{n:02x}" for _, n in f), e if e < 1 << 63 else None, labels[label] if labels[label] < 1 << 63 else None) for (i, _, label), f, e in zip(kept, found, errors, strict=True)]
    return sorted(out, key=repr), sha


def found_codes(df):
    codes = vectorcodes.compress(df)
    rows = vectorcodes.with_label_errors(codes).select("id", vectorcodes.hex_code(F.col("code")), "error", "label_error").collect()
    return sorted((tuple(r) for r in rows), key=repr), codes.codebooks_sha256()


def clusters(seed, n, dims=16, scale=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, scale) for _ in range(dims)] for _ in range(9)]
    rows = [(i, [x + r.gauss(0, scale / 5) for x in r.choice(centres)], r.choice(("a", "a", "a", "b", None))) for i in r.sample(range(9 * n), n)]
    return rows + [rows[0]] * 5


def test_codes_equal_plain_k_means(spark):
    rows = clusters(1, 400)
    rows += [(-1, None, "a"), (-2, [], "a"), (-3, [nan] * 16, "a"), (-4, [inf] + [0.0] * 15, "b"), (-5, [None] + [1.0] * 15, "b"), (None, [0.5] * 16, None), (7_000, [1.0] * 8, "b")]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{VECTORS}, code int, error int").repartition(3)
    assert found_codes(table) == brute_codes(rows)


def test_codes_with_ties(spark):
    """Components on a small grid: most comparisons are ties."""
    r = random.Random(2)
    rows = [(i, [float(r.randrange(-1, 2)) / 4096 for _ in range(16)], "x") for i in range(300)]
    assert found_codes(spark.createDataFrame(rows, VECTORS)) == brute_codes(rows)


@pytest.mark.parametrize("scale", [1e5, 1e14, 1e200])
def test_codes_of_large_components(spark, scale):
    rows = clusters(3, 60, 8, scale)
    assert found_codes(spark.createDataFrame(rows, VECTORS)) == brute_codes(rows)


def test_few_and_no_vectors(spark):
    rows = clusters(4, 5)
    assert found_codes(spark.createDataFrame(rows, VECTORS)) == brute_codes(rows)
    got, sha = found_codes(spark.createDataFrame([(1, None, "a")], VECTORS))
    assert got == [] and sha == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        vectorcodes.compress(spark.createDataFrame([(1, [1.0] * 9, "a")], VECTORS))


def test_bounds_never_mislead():
    """Looks carried over moving entries give what a comparison with all entries gives, and spare most of them."""
    r = np.random.default_rng(5)
    parts = r.integers(-300, 300, (3000, 8)) + 2000 * r.integers(0, 4, (3000, 1))
    entries = parts[:16].copy()
    look, width, spared = vectorcodes.Look.none(len(parts)), 4, 0
    moved = np.zeros(16)
    for step in range(8):
        look, d, need = vectorcodes.assign(parts, entries, moved, look, width)
        every = ((parts[:, None] - entries[None]) ** 2).sum(-1)
        assert (look.near[:, 0] == every.argmin(1)).all() and (d == every.min(1)).all()
        others = np.sort(np.where(np.isin(np.arange(16), look.near[:, :1]), np.inf, every), axis=1) if width == 1 else None
        assert others is None or (look.bound[:, -1] <= np.sqrt(others[:, 0])).all()
        spared += int((need == 0).sum())
        width = vectorcodes.best_width(dict(zip(*np.unique(need, return_counts=True), strict=True)), width, 16)
        after = entries + r.integers(-40 // (step + 1), 40 // (step + 1) + 1, entries.shape)
        moved = np.sqrt(((after - entries) ** 2).sum(1))
        entries = after
    assert spared > 3000
