from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions import urls as U
from claimloom.operators import adapters, corpus, grounding, ranking
from claimloom.sources import readers, writers
from claimloom.streaming import extraction


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column).first()[0]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_text_and_urls(spark):
    assert one(spark, T.normalize_text(F.col("t")), t="  Café \r\nb　\n\n\n\nc  ") == "Café\nb\n\nc"
    assert one(spark, T.html_to_text(F.col("t")), t="<script>x</script><p>a<b>b</b>\n c</p><style>y</style>") == "a b c"
    assert one(spark, T.page_title(F.col("t"), F.col("u")), t="<TITLE></TITLE>", u="http://x") == ""
    assert one(spark, T.page_title(F.col("t"), F.col("u")), t="<title>a\nb</title>", u="http://x") == "http://x"
    assert one(spark, T.page_title(F.col("t"), F.col("u")), t="<title>\t a\u00a0</title>", u="http://x") == "a"
    assert one(spark, T.html_to_text(F.col("t")), t="a<script>x</script>b<STYLE>y</STYLE>\u00a0\x1cc\u2003") == "ab c"
    assert one(spark, T.normalize_text(F.col("t")), t="a \u0085b \r\nc") == "a \u0085b\nc"
    code = "x" + "Y" * 1999
    assert one(spark, T.capitalized(F.col("t")), t=code) == "X" + "y" * 1999
    assert one(spark, T.normalized_code(F.col("t"), "D"), t="\u00a0\tx\n") == "X" and one(spark, T.normalized_code(F.col("t"), "D"), t="\n") == "D"
    assert one(spark, T.casefold(F.col("t")), t="STRAßE") == "strasse"
    assert one(spark, T.strip_fence(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, U.canonical(F.col("u")), u="http://WWW.Example.com:443/a?utm_x=1&b=2&a=&fbclid=3#z") == "https://www.example.com/a?a=&b=2"
    assert one(spark, U.normalize_percent(F.col("u")), u="/%7euser/%c3%a4") == "/~user/%C3%A4"
    assert one(spark, U.document_canonical(F.col("a"), F.col("b")), a="https://www.x.org/p", b="https://x.org/q") == "https://www.x.org/p"
    assert one(spark, T.published_at(F.col("t"))[1], t="2024-01-02") == "DAY"
    assert one(spark, T.published_at(F.col("t"))[1], t="2024-01-02T03:04:05Z") == "INSTANT"
    assert one(spark, T.published_at(F.col("t"))[1], t="2024-01-02T03:04:05") is None


def brute_canonical(url):
    """The rule, by the standard library."""
    import re
    from urllib.parse import parse_qsl, urlencode, urlsplit

    x = urlsplit(url)
    keep = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"
    path = re.sub("%([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)) if chr(int(m[1], 16)) in keep else m[0].upper(), x.path or "/")
    pairs = sorted((k, v) for k, v in parse_qsl(x.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in U.TRACKING)
    return "https://" + x.hostname.encode("idna").decode().lower() + (f":{x.port}" if x.port and x.port != 443 else "") + path + ("?" + urlencode(pairs) if pairs else "")


def test_canonical_urls_equal_the_rule(spark):
    urls = [
        "http://WWW.Example.com:443/a?utm_x=1&b=2&a=&fbclid=3#z", "https://user:pw@bücher.example:8080/%7euser/%c3%a4%2f", "http://x.org", "https://x.org?q=a+b%20c&q=%C3%A9&flag&UTM_y=1", "https://x.org/p?b=*~&a=%2A%7e&&=v",
        "HTTP://X.ORG:0443/a%zz?k=1=2", "https://x.org/ä?ü=ö", "https://x.org:/p", "https://x.org/?mc%5Fcid=1&a=1",
    ]
    for u in urls:
        assert one(spark, U.canonical(F.col("u")), u=u) == brute_canonical(u), u
    from urllib.parse import urljoin

    base = "https://www.x.org/a/b/c?d#e"
    for ref in ("../q", "?k=1", "/r", "//x.org/s", "t", "#u", "", "https://x.org/v", "https://other.org/", None):
        whole = urljoin(base, ref) if ref else base
        want = brute_canonical(whole) if "x.org" in whole else brute_canonical(base)
        assert one(spark, U.document_canonical(F.col("r").cast("string"), F.col("b")), r=ref, b=base) == want, ref


def test_growth_truncates_and_needs_a_base(spark):
    df = spark.createDataFrame([(120, 100), (1, 0), (119, 100)], "c int, p int")
    assert [r[0] for r in df.select(T.growth_percent(F.col("c"), F.col("p")).cast("int")).collect()] == [20, None, 19]


def test_grounding_levels_refs_and_limit(spark):
    claims = spark.createDataFrame([(1, 0, "c0", "Acme Power plant opened", None), (1, 1, "c1", "전력망 확대", None)], "doc_id int, pos int, ref string, quote string, claim_text string")
    entities = spark.createDataFrame([(1, i, n) for i, n in enumerate(["acme power", "Power Unit", "한국전력", "Q"])] + [(2, i, f"e{i}") for i in range(12)], "doc_id int, pos int, name string")
    found = grounding.ground_entities(entities, claims, most=10)
    assert rows(found.where("doc_id = 1"), "name", "level", "claim_refs", "ref_id") == [("Power Unit", 2, ["c0"], "n1"), ("acme power", 1, ["c0"], "n0"), ("한국전력", 3, ["c1"], "n2")]
    assert found.where("doc_id = 2").count() == 10
    assert grounding.ground_entities(entities, claims).where("doc_id = 2").count() == 12
    asked = spark.createDataFrame([(1, ["i"] * 9, [(f"q{k}", " \t" if k == 1 else "a") for k in range(8)])], "node_id int, issues array<string>, questions array<struct<question: string, answer: string>>")
    cut = grounding.insight_rows(asked, 5, 5).first()
    assert (len(cut["issues"]), [q["sequence"] for q in cut["questions"]]) == (5, [0, 2, 3, 4])
    assert len(grounding.insight_rows(asked).first()["questions"]) == 7


def test_passages_are_found_in_every_text_that_holds_them(spark):
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcÄß") for _ in range(r.randint(1, 3)))
    texts = [(i, r.choice((" ", "  ", "\n")).join(word() for _ in range(r.randint(0, 60)))) for i in range(80)]
    items = []
    for i in range(60):  # cut anywhere, also inside of words and blanks
        t = r.choice(texts)[1]
        at = r.randint(0, max(len(t) - 1, 0))
        items.append((i, t[at : at + r.randint(1, 60)] if i % 6 else " ".join(word() for _ in range(5))))
    items += [(100, "same start of a line and then one"), (101, "same start of a line and then two"), (102, None), (103, "lone"), (104, "A b")]
    texts += [(200 + i, f"x{i} same start of a line and then {'one' if i % 3 else 'two'} more, lone wolf") for i in range(30)] + [(300, None), (301, "")]
    d, q = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, quote string")
    for fold, any_case in ((str, False), (str.lower, True)):
        want = sorted((i, k) for i, t in texts for k, x in items if t is not None and x is not None and fold(x) in fold(t))
        assert [tuple(x) for x in grounding.passages_in(q, d, any_case).select("doc_id", "item_id").orderBy("doc_id", "item_id").collect()] == want
        assert len({(i % 40, k % 40) for i, k in want if i % 40 != k % 40}) > 20
    assert grounding.passages_in(q.limit(0), d).count() == 0


def test_whole_passages_are_attributed_across_remainders(spark, tmp_path):
    from claimloom.plans import registry

    passage = "One Passage that stands in other documents as a whole text"
    spark.createDataFrame([(7, passage), (8, passage[:40] + " but goes on in another way")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(3, f"before {passage.upper()} after", "src1"), (41, f"x {passage}", "src2"), (7, passage[:45], "src7")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect()))
    assert run("c10_claim_attribution") == [(3, 7, 3), (41, 7, 41)]
    assert run("c22_reattribution") == [(7, "3,41")]


def test_adapters(spark):
    sentences, points = "array<struct<index: bigint, text: string>>", "array<struct<text: string, evidence: array<bigint>>>"
    items = spark.createDataFrame([(1, 1, [(10, "a")], [("p", [10])]), (2, 3, [(10, "a")], [("p", [10])]), (3, 3, [(10, "a")], [("p", [999])]), (4, None, None, None)], f"id long, analysisArticleId long, sentences {sentences}, keyPoints {points}")
    assert rows(adapters.news_errors(items), "id", "error") == [(1, None), (2, "ANALYSIS_SOURCE_MISMATCH"), (3, "MISSING_EVIDENCE_REFERENCE"), (4, None)]
    tasks = spark.createDataFrame([("a", True, False), ("b", True, False), ("c", True, False), ("d", False, False)], "id string, enabled boolean, blocked boolean")
    needs = spark.createDataFrame([("b", "d"), ("c", "b")], "id string, parent string")
    assert rows(adapters.effective_items(tasks, needs), "id") == [("a",)]
    assert rows(adapters.suppressed_items(tasks, needs), "id") == [("b",), ("c",)]
    with pytest.raises(ValueError):
        adapters.producer("unknown")
    a = spark.createDataFrame([(1, "x", "t1"), (1, "x", "t2")], "id int, v string, exportedAt string")
    assert adapters.drop_replays(a, ["exportedAt"]).count() == 1
    cells = "array<struct<name: string, regions: array<struct<previewRows: array<array<struct<address: string, value: string>>>>>, tables: array<struct<previewRows: array<array<struct<address: string, value: string>>>>>>>"
    book = spark.createDataFrame([("w", [(None, [([[("A1", "1")]],)], [([[("A1", "2"), ("B1", "3")]],)])])], f"workbook string, sheets {cells}")
    assert rows(adapters.cell_index(adapters.workbook_cells(book)), "sheet", "address", "value") == [("Sheet1", "A1", "2"), ("Sheet1", "B1", "3")]


def literal_round_robin(items):
    """One pick per interval in turn, hosts of an interval rotating."""
    out, groups = {}, {}
    for interval, host, key in items:
        groups.setdefault(interval, {}).setdefault(host, []).append(key)
    for interval, hosts in groups.items():
        queue = [(h, sorted(k)) for h, k in sorted(hosts.items())]
        turn = 0
        while queue:
            host, keys = queue.pop(0)
            turn += 1
            out[keys.pop(0)] = turn
            if keys:
                queue.append((host, keys))
    return out


def test_fair_order_is_round_robin_in_any_input_order(spark):
    import random

    r = random.Random(1)
    items = [(r.randint(0, 2), r.choice("abcd"), f"k{i:03d}") for i in range(120)]
    want = literal_round_robin(items)
    for _ in range(2):
        r.shuffle(items)
        df = spark.createDataFrame(items, "i int, h string, k string")
        assert {x["k"]: x["turn"] for x in corpus.fair_order(df, "i", "h", "k").collect()} == want


def test_row_numbers_over_a_hot_group_in_many_ranges(spark):
    from claimloom.operators.order import row_numbers

    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 30 == 0, None).otherwise((F.col("id") % 7).cast("string")).alias("g"), F.xxhash64("id").alias("o"))
    got = row_numbers(df.repartition(6), ["g"], ["o"], "n")
    w = Window.partitionBy("g").orderBy("o")
    assert got.withColumn("m", F.row_number().over(w)).where("n <> m").count() == 0 and got.count() == 5000


def test_quota_selection_folds_in_order(spark):
    data = [("r", 0, "u0", "b0", ["x"]), ("r", 1, "u0", "b1", ["x"]), ("r", 2, "u2", "b0", ["y"]), ("r", 3, "u3", "b3", []), ("r", 4, "u4", "b4", ["x", "y"]), ("r", 5, "u5", "b5", [])]
    got = corpus.select_with_quota(spark.createDataFrame(data, "run string, pos long, url_key string, body_key string, tags array<string>"), ["x", "y"], 1, 10)
    assert rows(got, "pos", "status", "slot") == [(0, "SELECTED", "x"), (1, "DUPLICATE_URL", None), (2, "DUPLICATE_BODY", None), (3, "ELIGIBLE_NOT_SELECTED", None), (4, "SELECTED", "y"), (5, "SELECTED", None)]


def test_duplicates_are_judged_on_whole_urls_and_bodies(spark, tmp_path):
    from claimloom.plans import registry

    head = "a header that all pages share, longer than a hundred characters, so that no prefix tells them apart. " * 2
    page = lambda body: f"<html><style>x</style><p>{body}</p></html>"
    data = [(1, "http://x.org/a?utm_source=f", page(head + "one")), (2, "https://x.org/a#part", page("other")), (3, "http://x.org/b", page(head + "two")), (4, "http://x.org/c", f"<div>{head}</div> two"), (5, "http://x.org/d", page("opening " + head))]
    spark.createDataFrame(data, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.queries()["f20_drop_duplicates"](spark, str(tmp_path))
    assert rows(got, "page_id", "status") == [(1, "SELECTED"), (2, "DUPLICATE_URL"), (3, "SELECTED"), (4, "DUPLICATE_BODY"), (5, "SELECTED")]


def test_strata_are_filled_in_order_or_refused(spark):
    import hashlib

    data = [(i, f"i{i % 3}", f"p{i % 7}", i in (3, 9) or None) for i in range(60)]
    df = spark.createDataFrame(data, "k long, interval string, publisher string, slotted boolean")
    h = lambda r: hashlib.sha256(f"s:{r[0]}".encode()).hexdigest()
    want = {r[0]: "slotted" for r in data if r[3]}
    for name, at, least in (("interval", 1, 4), ("publisher", 2, 2)):
        for group in sorted({r[at] for r in data}):
            inside = sorted((r for r in data if r[at] == group), key=h)
            lack = least - sum(r[0] in want for r in inside)
            want |= {r[0]: name for r in [r for r in inside if r[0] not in want][: max(lack, 0)]}
    want |= {r[0]: "fill" for r in [r for r in sorted(data, key=h) if r[0] not in want][: 20 - len(want)]}
    strata = [("slotted", None, None), ("interval", 4, ["i0", "i1", "i2"]), ("publisher", 2, None)]
    assert {r["k"]: r["picked"] for r in corpus.strata_sample(df, "k", strata, 20, "s").collect()} == want
    for bad, size in (([("interval", 4, ["i0", "i9"])], 20), ([("interval", 21, None)], 60), ([("publisher", 3, None)], 20), ([("publisher", 1, None)], 61)):
        with pytest.raises(ValueError):
            corpus.strata_sample(df, "k", bad, size, "s")
    with pytest.raises(ValueError):
        corpus.stratified_sample(df, "k", "publisher", 3, 20, "s")


def literal_quota(part, slots, need, total):
    urls, bodies, counts, out, chosen = set(), set(), dict.fromkeys(slots, 0), [], 0
    for run, pos, url, body, tags in sorted(part, key=lambda r: r[1]):
        status, slot = "SELECTED", None
        if chosen >= total:
            status = "NOT_REACHED"
        elif url in urls:
            status = "DUPLICATE_URL"
        elif body in bodies:
            status = "DUPLICATE_BODY"
        elif min(counts.values(), default=need) < need:
            open_ = [s for s in slots if s in (tags or ()) and counts[s] < need]
            slot = min(open_, key=lambda s: (counts[s], slots.index(s)), default=None)
            status = "SELECTED" if slot else "ELIGIBLE_NOT_SELECTED"
        if status == "SELECTED":
            urls.add(url)
            bodies.add(body)
            chosen += 1
            if slot:
                counts[slot] += 1
        out.append((run, pos, status, slot))
    return out


def test_quota_selection_equals_the_fold_and_holds_no_run_in_a_task(spark):
    import random

    r = random.Random(2)
    data = []
    for run, n, keys in (("hot", 150, 60), ("b", 40, 10), (None, 20, 30), ("few", 3, 3)):
        data += [(run, i, r.choice([None, *[f"u{k}" for k in range(keys)]]), r.choice([None, *[f"b{k}" for k in range(keys)]]), r.choice([None, [], ["x"], ["y"], ["x", "y", "q"]])) for i in range(n)]
    data += [("chain", i, f"u{(i + 1) // 2}", f"b{i // 2}", ["x", "y"]) for i in range(9)]
    df = spark.createDataFrame(data, "run string, pos long, url_key string, body_key string, tags array<string>")
    for slots, need, total in ((["x", "y"], 2, 1000), (["x", "y"], 1, 12), ([], 3, 1000)):
        want = [x for run in {d[0] for d in data} for x in literal_quota([d for d in data if d[0] == run], slots, need, total)]
        found = corpus.select_with_quota(df, slots, need, total)
        assert rows(found, "run", "pos", "status", "slot") == sorted(want, key=repr)
        assert "InPandas" not in found._jdf.queryExecution().toString()


def test_sizes_count_all_lines(spark, tmp_path):
    from claimloom.plans import registry

    lines = [(1, 1, o, 10.0) for o in range(6)] + [(1, 2, o // 300, 50.0) for o in range(900)] + [(2, 1, 5, 1.0)] * 700
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_orderkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert rows(registry.queries()["g8_size_class"](spark, str(tmp_path)), "l_suppkey", "l_partkey", "size") == [(1, 1, "large"), (1, 2, "medium"), (2, 1, "small")]


def test_layout_and_filters(spark):
    gaps = spark.createDataFrame([("g", 10.0), ("g", 100.0), ("g", 350.0)], "g string, a double")
    assert rows(ranking.largest_gap(gaps, "g", "a", 360.0), "start", "gap") == [(100.0, 250.0)]
    assert one(spark, ranking.date_match(F.col("d"), "2024-01-01", "2024-01-31"), d=None) is True
    assert one(spark, F.size(ranking.sections(F.col("t"))), t="[a] one [b] two") == 2


def test_record_log_drops_only_a_torn_tail(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"k": "a", "v": 1}\n{"k": "b", "v": 2}\n{"k": "a", "v": 3}\n{"k": "c", "v"')
    log = readers.record_log(spark, str(tmp_path / "log.jsonl"), "k string, v int")
    assert rows(log, "k", "v") == [("a", 1), ("a", 3), ("b", 2)]
    assert rows(corpus.latest_records(log, "k", "ordinal"), "k", "v") == [("a", 3), ("b", 2)]
    (tmp_path / "bad.jsonl").write_text('{"k": "a"\n{"k": "b", "v": 2}\n')
    with pytest.raises(Exception, match="malformed record"):
        readers.record_log(spark, str(tmp_path / "bad.jsonl"), "k string, v int").collect()


def test_candidate_layouts_and_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿stratum,sample_rank,candidate_count,url,seen_at\ns,1,2,http://x,2024\n", encoding="utf-8")
    assert readers.candidates(spark, str(tmp_path / "a.csv"))[0] == "reused_stratified_sample"
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        readers.candidates(spark, str(tmp_path / "b.csv"))
    files = tmp_path / "files"
    files.mkdir()
    (files / "n.txt").write_bytes(b"plain \xff")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Head </w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    (files / "d.docx").write_bytes(buffer.getvalue())
    assert rows(readers.files(spark, str(files)), "title", "content") == [("d.docx", "Head\n\nBody"), ("n.txt", "plain �")]


def test_sinks_and_store(spark, tmp_path):
    bodies = spark.createDataFrame([("a",), ("a",), ("b",)], "body string")
    for _ in range(2):
        writers.save_bodies(bodies, str(tmp_path / "bodies"))
    assert spark.read.parquet(str(tmp_path / "bodies")).count() == 2
    records = spark.createDataFrame([("k2", "RETRY_PENDING", 1), ("k1", "SELECTED", 2)], "k string, status string, private int")
    assert [tuple(r) for r in writers.public_records(records, ["k", "status"], "k").collect()] == [("k1", "SELECTED"), ("k2", "FAILED_HTTP")]
    with pytest.raises(Exception, match="unknown status"):
        writers.public_records(records.withColumn("status", F.lit("ODD")), ["status"], "status").collect()
    assert writers.snapshot_id(bodies) == writers.snapshot_id(bodies.orderBy(F.desc("body")).repartition(3))


def test_a_store_shows_whole_commits_or_none(spark, tmp_path, monkeypatch):
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, body string")
    store = writers.Store(spark, str(tmp_path / "store"))
    assert store.version() is None
    with pytest.raises(ValueError, match="empty"):
        store.table("nodes")
    first = store.commit({"nodes": nodes})
    before = store.table("nodes")
    with pytest.raises(Exception):
        store.commit({"nodes": nodes.select("id", F.raise_error(F.lit("no")).alias("body"))})
    assert store.version() == first
    # A writer that stops between the tables and the log leaves everything as it was.
    monkeypatch.setattr(writers.Store, "_log", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        store.append({"nodes": nodes.where("id = 1").withColumn("body", F.lit("lost"))}, "s", 0)
    monkeypatch.undo()
    assert (store.version(), rows(store.table("nodes"), "id", "body")) == (first, [(1, "a"), (2, "b"), (3, "c")])
    change = spark.createDataFrame([(2, "B"), (4, "d")], "id long, body string")
    second = store.append({"nodes": change}, "s", 0)
    assert store.append({"nodes": change.withColumn("body", F.lit("again"))}, "s", 0) == second
    want = [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    assert rows(store.table("nodes"), "id", "body") == want
    store.compact()
    assert rows(store.table("nodes"), "id", "body") == want and len(store._last()["tables"]["nodes"]) == 1
    assert before.count() == 3 and rows(store.table("nodes", first), "id") == [(1,), (2,), (3,)]
    store.commit({"nodes": nodes.where("body = 'b'")})
    assert rows(store.table("nodes"), "id") == [(2,)]


def test_scratch_tables_need_a_shared_folder_off_local_masters(spark):
    from types import SimpleNamespace

    from claimloom.plans import scratch

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(away)


def test_duplicates_count_only_after_selected_rows(spark):
    data = [(0, "A", "X"), (1, "B", "X"), (2, "B", "Y"), (3, "A", "Z"), (4, None, "W"), (5, None, "V"), (6, "C", None), (7, "D", None)]
    df = spark.createDataFrame(data, "n int, a string, b string").withColumn("run", F.lit("clash"))
    want = ["SELECTED", "DUPLICATE_BODY", "SELECTED", "DUPLICATE_URL", "SELECTED", "DUPLICATE_URL", "SELECTED", "DUPLICATE_BODY"]
    assert rows(corpus.drop_duplicates_in_order(df, "a", "b", ["n"]), "n", "status") == list(enumerate(want))
    assert corpus.drop_duplicates_in_order(df.where("false"), "a", "b", ["n"]).count() == 0
    assert [r[0] for r in corpus.select_with_quota(df.select("run", F.col("n").alias("pos"), F.col("a").alias("url_key"), F.col("b").alias("body_key"), F.array().cast("array<string>").alias("tags")), [], 0).where("status = 'SELECTED'").select("pos").orderBy("pos").collect()] == [0, 2, 4, 6]


def test_audits_are_updated_by_key_and_gated(spark):
    sheet = spark.createDataFrame([("a", "", ""), ("b", "yes", "s")], "k string, ok string, slot string")
    done = corpus.update_audit(sheet, spark.createDataFrame([("a", " YES")], "k string, ok string"), "k")
    assert rows(done, "k", "ok") == [("a", " YES"), ("b", "yes")]
    with pytest.raises(ValueError, match="exactly one"):
        corpus.update_audit(sheet, spark.createDataFrame([("z", "no")], "k string, ok string"), "k")
    summary = corpus.audit_summary(done, ["ok"], "slot", "ok")
    assert tuple(summary.first()) == (2, 2, 2, 1, 1)
    assert corpus.audit_failures(summary, {"ok_yes": 2}, {"slot_rows": 1}).count() == 0
    assert rows(corpus.audit_failures(summary, {"ok_yes": 3}, {"slot_rows": 9}), "check", "found", "wanted") == [("ok_yes", 2, 3), ("slot_rows", 1, 9)]


def test_streamed_responses_are_grounded_once(spark, tmp_path):
    import json

    source, checkpoint = tmp_path / "in", tmp_path / "ck"
    source.mkdir()
    response = {"nodes": [{"name": "Acme"}, {"name": "Zzq"}], "edges": [{"source_name": "acme", "target_name": "Known", "relation": "USES"}], "claims": [{"quote": "Acme grows"}]}
    row = {"doc_id": 1, "title": "t", "content": "x Acme grows", "raw_response": f"```json\n{json.dumps(response)}\n```"}
    (source / "1.json").write_text(json.dumps(row) + "\n" + json.dumps(row | {"doc_id": 2, "raw_response": "no json"}))
    known = spark.createDataFrame([("Known",)], "name string")
    seen = []
    for _ in range(2):
        extraction.run(extraction.responses(spark, str(source)), lambda: known, lambda tables, n: seen.append({k: [r.asDict() for r in v.collect()] for k, v in tables.items()}), str(checkpoint)).awaitTermination(60)
    assert len(seen) == 1
    assert [(r["doc_id"], r["reason"]) for r in seen[0]["rejected"]] == [(2, "response is no JSON")]
    assert [(c["start"], c["end"]) for c in seen[0]["claims"]] == [(2, 12)]
    assert [e["name"] for e in seen[0]["entities"]] == ["Acme"]
    assert [(e["source_name"], e["claim_ref"]) for e in seen[0]["edges"]] == [("acme", "c0")]


def test_responses_are_decoded_once(spark):
    """What is made of a batch of responses reads the decoded ones, and doesn't decode them again."""
    raw = '{"nodes": [{"name": "Acme"}], "edges": [{"source_name": "acme", "target_name": "Known", "relation": "USES"}], "claims": [{"quote": "Acme grows"}]}'
    batch = spark.createDataFrame([(1, "t", "x Acme grows", raw), (2, "t", "x", "no json"), (3, "t", "far too long", raw)], extraction.RESPONSES)
    parts = extraction.grounded(batch, spark.createDataFrame([("Known",)], "name string"), most_content=11)
    assert sorted(parts) == ["claims", "decoded", "edges", "entities", "rejected"]
    assert rows(parts["rejected"], "doc_id") == [(1,), (2,), (3,)]
    parts = extraction.grounded(batch, spark.createDataFrame([("Known",)], "name string"))
    assert rows(parts["edges"], "doc_id", "claim_ref") == [(1, "c0"), (3, "c0")]
    for df in (*parts.values(), extraction.payloads(parts)):
        assert "from_json" not in df._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(KeyError):
        parts["rows"]


def test_period_gate_and_catalog(spark):
    books = spark.createDataFrame([("a", "1.0"), ("b", "1.0"), ("c", "1.0"), ("d", "2.0")], "workbook string, schema_version string")
    cells = spark.createDataFrame([("a", "S", "C2", "2024"), ("b", "S", "C2", None), ("c", "T", "C2", "x")], "workbook string, sheet string, address string, value string")
    heads = spark.createDataFrame([("b", "S", "C", "2024")], "workbook string, sheet string, column string, label string")
    assert rows(adapters.period_gate(books, cells, heads, "S", "C2"), "workbook", "error") == [("a", None), ("b", None), ("c", "MISSING_PERIOD_REFERENCE"), ("d", "UNSUPPORTED_SCHEMA")]
    from claimloom.sources import catalog

    tables = {"books": books.schema, "cells": cells.schema}
    text = catalog.describe(tables)
    assert catalog.drifted(tables, text) == []
    assert catalog.drifted({"books": heads.schema, "cells": cells.schema}, text) == ["books"]


def test_columns_of_the_input_with_helpers_names_stay(spark):
    """Names that an operator uses itself, or gives its result, neither clash with the input's nor replace them."""
    t = spark.createDataFrame([(k, f"h{k % 2}", "i", f"own{k}") for k in range(6)], "id long, host string, interval string, x string")
    every = ("first_row", "n_rows", "round", "turn", "slot", "lane", "status", "hash", "picked", "place", "group", "present", "part", "stratum_of", "of", "n", "span", "before")
    t = t.select("*", *[F.col("x").alias(c) for c in every])

    def kept(df):
        assert [tuple(r) for r in df.select("id", *every).distinct().orderBy("id").collect()] == [(r["id"], *[f"own{r['id']}"] * len(every)) for r in df.select("id").distinct().orderBy("id").collect()]
        return df

    merged = kept(corpus.merge_candidates(t.withColumn("flag", F.col("id") == 0), "host", ["id"], ["flag"], "id"))
    assert rows(merged, "host", "id", "flag", "n_rows_") == [("h0", 0, True, 3), ("h1", 1, False, 3)]
    fair = kept(corpus.fair_order(t, "interval", "host", "id"))
    assert [r["id"] for r in fair.orderBy("turn_").collect()] == [0, 1, 2, 3, 4, 5] and rows(fair.where("id < 3"), "id", "round_") == [(0, 1), (1, 1), (2, 2)]
    lanes = kept(corpus.interleave(t.withColumn("groups", F.array("host")), "id", "groups", "id", ["h0", "h1"]))
    assert rows(lanes.where("id > 3"), "id", "slot_", "lane_") == [(4, 3, 1), (5, 3, 2)]
    unique = kept(corpus.drop_duplicates_in_order(t, "host", "x", ["id"]))
    assert rows(unique, "id", "status_") == [(0, "SELECTED"), (1, "SELECTED")] + [(k, "DUPLICATE_URL") for k in range(2, 6)]
    plain = corpus.stratified_sample(t.select("id", "host"), "id", "host", 1, 4, "salt")
    sample = kept(corpus.stratified_sample(t, "id", "host", 1, 4, "salt"))
    assert rows(sample, "id", "hash_", "picked_") == rows(plain, "id", "hash", "picked") and sample.where("picked_ = 'stratum'").count() == 2
    strata = kept(corpus.strata_sample(t, "id", [("host", 2, ["h0", "h1"])], 5, "salt"))
    assert rows(strata.groupBy("picked_").count(), "picked_", "count") == [("fill", 1), ("host", 4)]


def test_texts_are_not_shuffled_to_the_task_of_no_address(spark, tmp_path):
    path = str(tmp_path / "sources")
    spark.range(300).selectExpr("id", "CASE id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'text' END AS source_type", "CAST('p' || id AS BINARY) AS data", "'' AS name").write.parquet(path)
    fetched = spark.range(0, 300, 6).selectExpr("'p' || id AS url", "'<p>x</p>' AS html")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = readers.documents(spark.read.parquet(path), fetched)
        found = out.withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.id, r.content) for r in found) == [(i, ("x" if i % 6 == 0 else None) if i % 3 == 0 else f"p{i}") for i in range(300)]
    joined = {r.part for r in found if r.source_type == "url"}
    assert all(r.part not in joined for r in found if r.source_type != "url")
