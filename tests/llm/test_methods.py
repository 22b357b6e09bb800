"""The methods themselves against independent, literal versions on small inputs."""

from __future__ import annotations

import itertools
import json
import math
import os
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimloom.llm import bpe, language, mixing, neardup, neighbours, pii, quality, secretscan, sharding
from claimloom.llm.common import filter_bits
from claimloom.llm.spans import free_of
from tests.llm import tables
from tests.llm.test_operators import brute_components, brute_quality, brute_targets, words

DATA = "/root/testdata"


# 1. The automaton that merge gadgets build, arc by arc.


def vocabulary(tmp_path, letters, merges, **changes):
    vocab = {x: i for i, x in enumerate(letters)}
    for u, v in merges:
        vocab.setdefault(u + v, len(vocab))
    spec = {"model": {"type": "BPE", "vocab": vocab, "merges": [f"{u} {v}" for u, v in merges]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}, "added_tokens": []} | changes
    path = tmp_path / f"v{len(os.listdir(tmp_path))}.json"
    path.write_text(json.dumps(spec))
    return str(path), vocab


def literal_automaton(letters, merges):
    """States as dictionaries from token to state. State 0 is the start and accepts all."""
    arcs = [{x: 0 for x in letters}]
    for u, v in merges:
        targets = {a[u] for a in arcs if u in a}
        if not targets:
            continue  # no state has an arc u
        assert len(targets) == 1  # the state that a token leads to depends on the token alone
        t = targets.pop()
        led = arcs[t].get(v)
        arcs.append({x: y for x, y in arcs[t].items() if x != v})
        for a in arcs:
            if u in a:
                a[u] = len(arcs) - 1
                if led is not None:
                    a[u + v] = led
    return arcs


def spelled_by(arcs, word):
    """All paths from the start that spell word."""
    if not word:
        return [[]]

    def go(state, at):
        if at == len(word):
            return [[]]
        return [[x, *rest] for x, to in arcs[state].items() if word.startswith(x, at) for rest in go(to, at + len(x))]

    return go(0, 0)


def test_arcs_are_those_of_the_literal_construction(tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(6)
    for _ in range(40):
        letters = "ab" if r.random() < 0.5 else "abc"
        tokens, merges = list(letters), []
        while len(merges) < 9:
            pair = (r.choice(tokens), r.choice(tokens))
            if "".join(pair) not in tokens and len("".join(pair)) <= 6:
                merges.append(pair)
                tokens.append("".join(pair))
        path, vocab = vocabulary(tmp_path, letters, merges)
        a, arcs, lib = bpe.Automaton(path), literal_automaton(letters, merges), Tokenizer.from_file(path)
        name = {i: x for x, i in vocab.items()}
        for n in range(1, 9):
            for _ in range(20):
                word = "".join(r.choice(letters) for _ in range(n))
                paths = spelled_by(arcs, word)
                got = [name[i] for i in a.encode_word(word.encode())]
                assert paths == [got] and lib.encode(word).tokens == got
        # Whatever arc a reachable state has, the tabulated one has, too, and no other.
        after = {}
        for state in arcs:
            after |= state
        for x, state in after.items():
            for y in after:
                assert a.has_arc(vocab[x], vocab[y]) == (y in arcs[state]), (merges, x, y)


def test_vocabularies_with_other_rules_are_refused(tmp_path):
    ok = [("a", "b")]
    bpe.Automaton(vocabulary(tmp_path, "ab", ok)[0])
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"added_tokens": [{"id": 9, "content": "<x>", "lstrip": True}]}, {"model": {"type": "WordPiece", "vocab": {}, "merges": []}}):
        with pytest.raises(ValueError, match="not supported"):
            bpe.Automaton(vocabulary(tmp_path, "ab", ok, **change)[0])


def test_split_takes_the_fast_pattern_only_where_both_agree():
    r = random.Random(3)
    chars = "aB9_ \n\t-'sléßɏĀ²½ª\x1c\x85\xa0٣日Ⅷ "
    for _ in range(4000):
        t = "".join(r.choice(chars) for _ in range(r.randint(0, 14)))
        assert bpe.split(t) == bpe._SPLIT.findall(t), repr(t)


# 2. Policies on ledgers with clashing names.


def test_policy_reads_its_own_bits_and_keeps_the_input(spark):
    docs = spark.createDataFrame([(1, "word", 7, 99), (2, "one two three four five " * 3 + " ".join(f"w{i}" for i in range(60)), 8, 99)], "doc_id long, text string, kept int, fail_bits int")
    rows = quality.apply_policy(quality.ledger(docs))
    assert rows.columns[-1] == "kept_" and [tuple(r) for r in rows.select("kept", "fail_bits", "kept_").orderBy("doc_id").collect()] == [(7, 99, False), (8, 99, True)]
    assert {r["rule"]: r["n_failed"] for r in quality.ablations(quality.ledger(docs)).collect()}["few_words"] == 1


# 3. Naive Bayes, gram by gram.


def brute_grams(text):
    m = (1 << 64) - 1
    c = [x if x.isalpha() else " " for x in f" {text.lower()} "]
    out = []
    for i in range(len(c) - 1):
        if c[i + 1] == " ":
            continue
        a, b, d = ord(c[i]), ord(c[i + 1]), ord(c[i + 2]) if i + 2 < len(c) else 32
        two = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & m
        three = (two + d * 0x165667B19E3779F9) & m
        out += [((two ^ (two >> 29)) * 0xFF51AFD7ED558CCD & m) >> 48, ((three ^ (three >> 31)) * 0xFF51AFD7ED558CCD & m) >> 48]
    return out


def test_language_equals_naive_bayes_by_hand(spark):
    docs = tables.frame(spark)
    data = [(t, lang) for _, t, lang, *_ in tables.documents() if t is not None]
    model = language.train(docs, per_language=10**9)
    counts, priors = defaultdict(Counter), Counter()
    for t, lang in data:
        if lang is not None:
            counts[lang].update(brute_grams(t))
            priors[lang] += 1
    texts = [t for t, _ in data if len(t) < 3000][:40] + ["", "123", "der the que", "ÀÉ日本"]
    got = model.predict(texts)
    for t, lang, score in zip(texts, *got, strict=True):
        grams = brute_grams(t)
        if not any(x.isalpha() for x in t):
            assert (lang, score) == ("und", 0.0)
            continue
        logs = {x: math.log(priors[x] / sum(priors.values())) + sum(math.log((counts[x][g] + 0.1) / (sum(counts[x].values()) + 0.1 * 65_536)) for g in grams) for x in counts}
        top = max(logs.values())
        best = max(sorted(logs), key=logs.get)
        assert lang == best and score == pytest.approx(1 / sum(math.exp(x - top) for x in logs.values()), rel=1e-3)
    with pytest.raises(ValueError, match="more than 2 languages"):
        language.train(docs, most_languages=2)


# 4. Differencing, tuple by tuple.


def brute_differencing(totals, k):
    parts = [(i, [t] + [0] * (k - 1)) for i, t in enumerate(totals)]
    number = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (p[1][-1] - p[1][0], p[0]))  # largest spread first
        (_, a), (_, b), *rest = parts
        parts = [*rest, (number, sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))]
        number += 1
    return parts[0][1]


def test_shards_have_the_sums_of_differencing_by_hand(spark):
    docs = tables.frame(spark)
    got = sharding.shard(docs, shards=5).collect()
    groups = Counter()
    for _, t, *_ in tables.documents():
        groups[t or ""] += len((t or "").encode()) + 1
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert sorted((sums[i] for i in range(5)), reverse=True) == brute_differencing(sorted(groups.values(), reverse=True), 5)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in tables.documents())


# 5 and 8. Spans.


def test_spans_free_of_others():
    r = random.Random(1)
    some = lambda n: [(a, a + r.randint(1, 9)) for a in (r.randint(0, 60) for _ in range(n))]
    for _ in range(2000):
        x, taken = some(r.randint(0, 8)), sorted(some(r.randint(0, 6)))
        assert free_of(x, taken) == sorted(s for s in x if not any(a < s[1] and s[0] < b for a, b in taken))


def test_a_megabyte_of_spans_takes_seconds():
    personal = "a@b.de (415) 555-2671 and\n" * 40_000
    began = time.time()
    base, spans = pii.all_spans([personal], pii.train())[0]
    assert len(base["email"]) == 40_000 and sum(k == "phone" for k, *_ in spans) == 40_000
    secret = "password=abcdefgh1 pwd: xK9$mQ2!vLp0\n" * 28_000
    base, spans = secretscan.all_spans(secret)
    assert len(base["assign"]) == 28_000 and sum(k == "guess" for k, *_ in spans) == 28_000
    assert time.time() - began < 60


def test_viterbi_finds_the_best_of_all_paths():
    r = np.random.default_rng(4)
    field = pii.train()
    k = len(pii.TAGS)
    for n in (1, 2, 3, 4):
        runs = [r.standard_normal((n, k)) * 3 for _ in range(3)]
        for x, got in zip(runs, field.viterbi(runs), strict=True):
            score = lambda p: field.moves[0, p[0]] + sum(field.moves[a, b] for a, b in itertools.pairwise(p)) + sum(x[i, a] for i, a in enumerate(p)) + field.moves[p[-1], 0]  # noqa: B023, E731
            best = max(itertools.product(range(k), repeat=n), key=score)
            assert score(tuple(got)) == pytest.approx(score(best))


LINES = [
    ("please call (212) 555-0187 before noon", ["phone"]), ("Phone: 646-555-0142, ask for the manager", ["phone"]), ("fax 415.555.2671 is off", ["phone"]), ("his ssn 078-05-1120 leaked", ["ssn"]), ("social security 219-09-9999.", ["ssn"]),
    ("meeting on 2024-05-17 at 10:30", []), ("version 4.2.1 fixes 12 bugs", []), ("chapter 3. page 218", []), ("it costs $1,299.00 or 15% less", []), ("between 1914 and 1918", []), ("room 12-34", []), ("order 10 of 250 pieces", []),
]


def test_field_on_lines_written_by_hand():
    right = sum([k for k, *_ in spans] == want for (_, want), (_, spans) in zip(LINES, pii.all_spans([t for t, _ in LINES], pii.train()), strict=True))
    assert right >= len(LINES) - 1
    assert pii.shape("a" * 90 + "7" * 3) == "a999" and pii.shape("x" * 300 + "-1") == "a-9"


def brute_cost(v, ranks):
    """Least cost over all segmentations; a walk or repeat begins where its run does."""
    low = v.translate(secretscan._LOWER)
    plain = low.translate(secretscan._LEET)
    per = secretscan.alphabet(v)

    def segment(a, b):
        n = b - a
        out = [secretscan.SEGMENT + n * per]
        if n == 1 and v[a] in "-_. ":
            out.append(secretscan.JOIN)
        for form, extra in ((low, 0), (plain, secretscan.LEET)):
            if form[a:b] in ranks and n >= 3:
                out.append(secretscan.SEGMENT + math.log10(ranks[form[a:b]] + 1) + extra + secretscan.CASED * (v[a:b] != low[a:b]))
        for pattern, c in secretscan._DATES:
            m = pattern.match(v, a)
            if m and m.end() == b:
                out.append(secretscan.SEGMENT + c)
        if n >= 3 and all(secretscan.beside(low[i], low[i + 1]) for i in range(a, b - 1)) and (a == 0 or not secretscan.beside(low[a - 1], low[a])):
            out.append(secretscan.SEGMENT + secretscan.WALK + 2 * math.log10(n))
        for p in range(1, 5):
            run = lambda i: i >= p and v[i] == v[i - p]  # noqa: B023, E731
            if n >= 3 * p and all(run(i) for i in range(a + p, b)) and not run(a + p - 1):
                out.append(secretscan.SEGMENT + p * per + math.log10(n / p))
        return min(out)

    best = [0.0] + [math.inf] * len(v)
    for b in range(1, len(v) + 1):
        best[b] = min(best[a] + segment(a, b) for a in range(b))
    return best[-1]


def test_guess_cost_is_the_least_over_all_segmentations():
    r = random.Random(12)
    parts = ["password", "p4ssw0rd", "Admin", "2024", "2024-01-31", "aaaa", "abab", "abcabcabc", "qwerty", "xK9$", "-", "_", "the", "zz", "1111", "7", "İ", "q"]
    for path in (None, bpe.vocabulary_path()):
        ranks = secretscan.dictionary(path)
        for _ in range(400):
            v = "".join(r.choice(parts) for _ in range(r.randint(1, 4)))[:26]
            cost, found = secretscan.guess_cost(v, path)
            assert cost == pytest.approx(brute_cost(v, ranks)), v
            assert [s for _, s, _ in found] + [len(v)] == [0] + [e for *_, e in found]


def test_words_of_a_vocabulary_tell_phrases_from_keys():
    path = bpe.vocabulary_path()
    kinds = lambda v: {k for k, *_ in secretscan.guess_cost(v, path)[1]}
    assert kinds("correcthorsebatterystaple") == {"word"} and secretscan.is_secret("correcthorsebatterystaple", path=path)
    for weak in ("pleasefillthisin", "your_password_here", "change-this-token", "Welcome2024", "summer.holiday"):
        assert not secretscan.is_secret(weak, path=path), weak
    for strong in ("x9Kq27zLmP4v", "wJalrXUtnFEMI/K7MDENG", "q8#vLp0!zT"):
        assert secretscan.is_secret(strong, path=path), strong
    assert secretscan.all_spans("login: pleasefillthisin", path=path)[1] == []
    text = "İİ pwd: İx9Kq27zLmP4v end"
    (_, s, e), = secretscan.all_spans(text, path=path)[1]
    assert text[s:e] == "İx9Kq27zLmP4v"


CONTEXTS = [
    ("pwd: 'p,ss;w0rd9xQ'", ["p,ss;w0rd9xQ"]), ('secret = "my secret value is long"', ["my secret value is long"]), ("at postgres://bob:Zk8!qqL0w@db/x and http://a:b@c", ["Zk8!qqL0w"]),
    ("mysql -u root -p Xk29vLqP0z run", ["Xk29vLqP0z"]), ("-p /data/some/path --token --verbose-mode", []), ("curl --passphrase=Xk29vLqP0z", ["Xk29vLqP0z"]),
    ("-----BEGIN RSA PRIVATE KEY-----\nMIIEowIBAAKC\nZm9vYmFyQEA7\n-----END RSA PRIVATE KEY-----", ["MIIEowIBAAKC\nZm9vYmFyQEA7"]), ("time 10:30 http://x.org:8080/path@foo", []), ("login: someone@example.com", []),
    ("pwd: x9Kq27zz!a, pwd: 'x9Kq27zz!b", ["x9Kq27zz!a", "x9Kq27zz!b"]),
]


@pytest.mark.parametrize("text, want", CONTEXTS)
def test_credential_contexts(text, want):
    spans = secretscan.all_spans(text, path=bpe.vocabulary_path())[1]
    assert [text[s:e] for k, s, e in spans if k == "guess"] == want


def test_costs_of_long_values_end_early():
    r = random.Random(1)
    for _ in range(1500):
        v = "".join(r.choice(("the", "pass", "aaaa", "qwert", "abc", "2021", "x", "Q", "9", "-", "secret", "zzz", "1234")) for _ in range(r.randint(1, 30)))
        whole, part = secretscan.guess_cost(v)[0], secretscan.guess_cost(v, enough=15)[0]
        assert part == whole or 15 <= part <= whole + 1e-9
    start = time.time()
    for t in ("token: " + "aB3$x!9Q" * 250_000, 'pwd: "' + "the word list " * 100_000 + '"'):
        assert any(k == "guess" for k, *_ in secretscan.all_spans(t)[1])
    assert secretscan.all_spans("token: " + "aB3x9Q" * 250_000)[1] == [("assign", 0, 7 + 1_500_000)]
    assert time.time() - start < 5


# 7. A source of low weights.


def test_mix_of_low_weights_takes_the_same_rows_as_a_sort(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ORDERED", 20)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.when(F.col("id") % 10 == 0, "rare").alias("source"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.05).alias("q"))
    got = mixing.plan(docs, weight=docs["q"], weights=(1, 1), share=0.7).collect()
    rows = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.exponential_key(F.col("doc_id"), F.col("q")).alias("key")).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    want = brute_targets(sizes, (1, 1), 0.7)
    taken = {}
    for s in sizes:
        epochs, ahead = int(want[s] // sizes[s]), 0
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: (r["key"], r["doc_id"])):
            inside = ahead + r["size"] / 2 <= want[s] - epochs * sizes[s]
            taken[r["doc_id"]] = (epochs + inside) * r["size"]
            ahead += r["size"]
    assert {r["doc_id"]: r["taken"] for r in got} == taken


# 9. Recall on the given tables.


@pytest.mark.parametrize("sf", [sf for sf in ("sf0.001", "sf0.01", "sf0.1") if os.path.exists(f"{DATA}/{sf}/embeddings.parquet")])
def test_recall_on_the_given_vectors(spark, sf):
    path = f"{DATA}/{sf}/embeddings.parquet"
    df = spark.read.parquet(path)
    found = defaultdict(dict)
    for r in neighbours.search(df, df["vec_id"] % 20 == 0).collect():
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    t = pq.read_table(path)
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), float)
    hits = 0
    for q, ranks in found.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hits += len({i for i, _ in ranks.values()} & set(best.tolist()))
        assert sorted(ranks) == list(range(1, 11)) and all(s == d[ids == i][0] for i, s in ranks.values())
    assert len(found) == (ids % 20 == 0).sum() and hits >= 0.9 * 10 * len(found)


@pytest.mark.parametrize("dims", [64, 128])
@pytest.mark.parametrize("n", [8_192, 65_536])
def test_recall_of_vectors_without_structure(spark, tmp_path, n, dims):
    x = np.random.default_rng(n + dims).standard_normal((n, dims))
    column = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dims).cast(pa.list_(pa.float64()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": column}), tmp_path / "x.parquet")
    df = spark.read.parquet(str(tmp_path / "x.parquet"))
    every, found = n // 64, defaultdict(set)
    for row in neighbours.search(df, df["vec_id"] % every == 0).collect():
        found[row["query_id"]].add(row["vec_id"])
    hits = 0
    for q in range(0, n, every):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argpartition(d, 10)[:10].tolist()))
    assert hits >= 0.9 * 640


def test_forests_settle_by_what_they_measure():
    """Clusters need few candidates; vectors that prefixes can't tell apart are scanned, exactly."""
    r = np.random.default_rng(1)
    plain = r.standard_normal((4096, 64))
    for x, want in ((0.2 * plain + r.standard_normal((30, 64))[r.integers(0, 30, 4096)], "few"), (r.standard_normal((4096, 400)), "all"), (plain[:100], "all")):
        planes = neighbours.Planes(x, neighbours.TREES, neighbours.BITS, 5)
        forest = neighbours.Forest.build(planes, np.arange(len(x)), x)
        trees, reach, examined = forest.settle(planes.strings(x), 5, 10)
        assert trees <= neighbours.TREES and (examined == len(x) if want == "all" else examined < len(x) // 8)
        if want == "all":
            some = forest.candidates(None, x[:20], reach, examined, 10)
            for q in range(20):
                d = np.sqrt(((x - x[q]) ** 2).sum(1))
                d[q] = np.inf
                assert forest.nearest(q, x[q], some[q], 10)[0].tolist() == np.lexsort((np.arange(len(x)), d))[:10].tolist()


def test_recall_over_partitions_and_query_groups(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "partition_size", lambda n, dims: 1500)
    monkeypatch.setattr(neighbours, "QUERY_GROUP", 40)
    r = np.random.default_rng(2)
    x = r.standard_normal((6000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for row in neighbours.search(df, df["vec_id"] % 100 == 0).collect():
        found[row["query_id"]].add(row["vec_id"])
    hits = 0
    for q in range(0, 6000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 600


# 10. Long texts, and filters.


def test_clusters_of_long_texts_are_compared_in_blocks_by_bytes(spark, monkeypatch):
    for name, value in (("LEFT_BYTES", 40_000), ("ALL_BYTES", 90_000), ("UNIT_BYTES", 150_000)):
        monkeypatch.setattr(neardup, name, value)
    r = random.Random(3)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(2500)]
    data = []
    for i in range(45):
        w = list(base)
        for _ in range(r.randint(1, 260)):
            w[r.randrange(2500)] = f"x{i}_{r.randint(0, 99)}"
        data.append((i, " ".join(w), "en", "s", 0))
    want = brute_components(data, 5)
    got = neardup.near_duplicates(tables.frame(spark, data)).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == want


def test_id_filters_hold_every_id(spark):
    ids = spark.range(0, 300_000, 3)
    f = filter_bits(ids)
    assert f.size >= 16 * 100_000
    import pyarrow as pa

    on = lambda df: f.is_on(pa.array([r[0] for r in df.select(f.bit(F.col("id"))).collect()], pa.int32()))
    assert on(ids).all() and on(spark.range(1, 300_000, 3)).mean() < 0.12
    assert not filter_bits(ids.where("false")).is_on(pa.array([0, 5, 1 << 19], pa.int32())).any()


# The pipeline's stages, each on what its predecessor kept.


def test_each_stage_does_what_a_literal_version_does(spark):
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    docs = tables.frame(spark)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    before = rows(docs)

    good = stages["quality"](spark, docs, "")
    limits = lambda m: m[0] >= 50 and 100 * m[5] <= 50 * m[0] and 10 * m[2] <= 3 * m[0] and 2 * m[0] <= m[1] <= 15 * m[0] and not (m[4] >= 4 and 100 * m[4] > 30 * m[3])
    want = [r for r in before if limits(brute_quality(r[1]))]
    assert rows(good) == want and len(want) > 20

    single = stages["near_duplicates"](spark, good, "")
    component = brute_components(want, 5)
    want = [r for r in want if r[0] is None or component[r[0]][1] == r[0]]
    assert rows(single) == want

    spoiled = single.withColumn("text", F.concat("text", F.lit(" mail me@home.example or (415) 555-2671 now")))
    clean = stages["personal_data"](spark, spoiled, "")
    assert all(r["text"].endswith(" mail <EMAIL> or <PHONE> now") and r["n_chars"] == len(r["text"]) for r in clean.collect())
    assert rows(stages["personal_data"](spark, single, "")) == [(*r[:4], len(r[1])) for r in want]

    mixed = stages["mixing"](spark, single, "")
    plan = {r["doc_id"]: r for r in mixing.plan(single).collect()}
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert {i: copies[i] * plan[i]["size"] for i in plan} == {i: plan[i]["taken"] for i in plan}

    lib = Tokenizer.from_file(bpe.vocabulary_path())
    packed = stages["encoding"](spark, single, "").collect()
    text = {r[0]: r[1] for r in want}
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == lib.encode(text[r["doc_id"]], add_special_tokens=False).ids for r in packed) and len(packed) == len(want)
