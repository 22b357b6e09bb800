"""Substring search by grams against plain tests of all pairs."""

from __future__ import annotations

import random

from claimloom.operators import grams, grounding

LETTERS = "aAbßΣσς é😀%_\n"


def texts_of(r, n):
    return [(i, "".join(r.choice(LETTERS) for _ in range(r.randint(0, 14)))) for i in range(n)] + [(n, None), (n + 1, "")]


def test_passages_of_a_few_characters(spark):
    r = random.Random(1)
    texts, quotes = texts_of(r, 80), [q for q in texts_of(r, 25)] + [(90, "a"), (91, "A"), (92, "zz"), (93, "ab"), (94, " ")]
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, quote string")
    for any_case in (False, True):
        got = {(x["doc_id"], x["item_id"]) for x in grounding.passages_in(items, docs, any_case).collect()}
        low = (lambda s: s.lower()) if any_case else (lambda s: s)
        assert got == {(i, j) for i, t in texts for j, q in quotes if t is not None and q and low(q) in low(t)}


def test_an_index_follows_changes(spark, tmp_path):
    r = random.Random(2)
    index, want = grams.GramIndex(spark, str(tmp_path / "g"), bucket_rows=20), {}
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    for step in range(3):
        new = [(r.randrange(60), t) for _, t in texts_of(r, 25)]
        new = list({i: (i, t) for i, t in new}.values())
        gone = [i for i in want if i % 5 == step and i not in dict(new)]
        index.change(frame(new), frame([(i, None) for i in gone]).select("id"))
        want = {i: t for i, t in want.items() if i not in gone} | dict(new)
    counts = {}
    for t in want.values():
        for g in {t.lower()[a : a + k] for k in (1, 2, 3) for a in range(len(t) - k + 1)} if t and t.isascii() else ():
            counts[g] = counts.get(g, 0) + 1
    kept = {x["gram"]: x["n"] for x in index.ledger.table("gram_counts").collect()}
    only_ascii = {g for g in kept if g.isascii() and not any(g in (t or "").lower() for t in want.values() if not (t or "").isascii())}
    assert {g: kept[g] for g in only_ascii} == {g: counts[g] for g in only_ascii}
    quotes = [(k, q) for k, q in enumerate(["a", "AB", "ß a", "", "aaa", "no such", " "])]
    got = {(x["item_id"], x["id"]) for x in index.containing(spark.createDataFrame(quotes, "item_id long, quote string")).collect()}
    assert got == {(k, i) for k, q in quotes for i, t in want.items() if q and t and q.lower() in t.lower()}
    for pattern in ("a_b", "a%ß", "%", "b"):
        expected = {x["id"] for x in frame(list(want.items())).where(f"text ILIKE '%{pattern}%'").collect()}
        assert {x["id"] for x in index.like(pattern).collect()} == expected, pattern


def test_grams_on_the_fly_are_numbers_of_whole_characters(spark):
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh \u00df\U0001f600") for _ in range(20_000))
    held = {grams._numbers(text[a : a + k].encode(), [k])[0] for k in (1, 3) for a in range(len(text) - k + 1)}
    assert set(grams._numbers(text.encode(), [1, 3])) == held and len(grams._numbers(b"ab", None)) == 1 and not len(grams._numbers(b"", None))
    docs = spark.range(1000).selectExpr("id AS doc_id", "concat(repeat('abcdefgh \u00df', 300), id, 'x') AS text")
    quotes = spark.createDataFrame([(k, f"{k}x") for k in range(0, 10)] + [(100, "zz"), (101, None)], "item_id long, quote string")
    got = {(x["item_id"], x["doc_id"]) for x in grams.candidates(quotes, docs).collect()}
    assert got == {(k % 10, k) for k in range(1000)}
