"""Queries of the operators over the given tables, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from claimloom.llm import bpe, language, mixing, neardup, neighbours, pieces, pii, quality, secretscan, sharding, substring, turntrie, vectorcodes


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    r = docs.select("doc_id", bpe.round_trip(docs["text"], bpe.vocabulary_path()).alias("r"))
    return r.select(
        "doc_id",
        (F.octet_length("r.ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("r.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("r.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(_documents(spark, sf_dir), keep=["doc_id"]))
    base = quality.mask(1)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("fail_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", "n_lines", "fail_bits")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS k FROM g WHERE n > 1) GROUP BY 1),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END
    + CASE WHEN n_dup_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, n_lines, fail_bits
FROM b
"""


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    part = F.pmod(F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")), F.lit(3))
    model = language.train(docs.where(part != 1))
    return docs.select("doc_id", (part == 1).alias("held_out"), language.predict(docs["text"], model, docs).alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(_documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = docs.select("doc_id", pii.detect(docs["text"], docs).alias("f"))
    counts = [_count("f.base", k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("f.base")), 256).alias("base_sha256"), _joined(F.col("f.spans")).alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = docs.select("doc_id", secretscan.detect(docs["text"], path=bpe.vocabulary_path()).alias("f"))
    counts = [_count("f.spans", k).alias(f"n_{k}") for k in secretscan.BASE_KINDS]
    base = F.filter("f.spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("f.spans")).alias("spans"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(greatest(0.05::DOUBLE, 1.0::DOUBLE - 2.0::DOUBLE * length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) / greatest(length(text), 1)), 1.0::DOUBLE) AS w,
         ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 13))::BIGINT AS bits
  FROM documents),
k AS (SELECT *, -ln((bits::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / w AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
s2 AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS all_weight FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * total - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0)) / (all_weight - coalesce(sum(weight) OVER b, 0)) AS level
       FROM s2 WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, ratio) AS level FROM s3 WHERE level <= ratio),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(l.level * weight, 2.0::DOUBLE * source_size)) AS target FROM s3, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       ((epochs + CASE WHEN rest > 0 AND ahead + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM p
"""


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.parse(_documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("parsed.spans", F.lit(0).cast("bigint"), lambda n, f: n + f["length"])
    return rows.select("doc_id", "parsed.n_words", removed.alias("n_removed"), F.sha2(F.col("parsed.kept").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY 1),
m AS (SELECT h.doc_id, h.i FROM h JOIN f ON h.h = f.h WHERE h.doc_id > f.first),
r AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM m),
x AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM r GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(x.n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN x.n IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(x.gone, k)), lambda k: w[k]), ' ') END) AS kept_sha256
FROM d LEFT JOIN x ON d.doc_id = x.doc_id
"""


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.search(vectors, vectors["vec_id"] % 100 == 0)


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), n=2)


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(w[i], w[i + 1]) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) >= 2)
  UNION SELECT doc_id, hash(w[1]) FROM d WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.b AS component_id, m.b = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS b FROM r GROUP BY 1) m ON m.a = d.doc_id
"""


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turntrie.nodes(turntrie.rebuilt(conversations))


OP11_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
x AS (SELECT conv_id, i, md5(length(role)::VARCHAR || ':' || role || text) AS k, strlen(text)::BIGINT AS b FROM t),
o AS (SELECT DISTINCT conv_id, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda y: [ord(y)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS s FROM x),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
             xor(list_reduce(list_prepend(4294967295, s), lambda y, z: CASE WHEN z < 0 THEN xor(y >> 1, (y & 1) * 3988292384) ELSE xor(y, z) END), 4294967295) % 9 AS h FROM o),
r AS (
  SELECT c.conv_id, x.i, x.k, x.b FROM c JOIN x ON x.conv_id = c.base AND x.i <= c.h
  UNION ALL SELECT c.conv_id, x.i, x.k, x.b FROM c JOIN x ON x.conv_id = c.conv_id AND x.i > c.h),
s AS (SELECT c.conv_id, coalesce(list(r.k ORDER BY r.i) FILTER (WHERE r.k IS NOT NULL), []) AS k, coalesce(list(r.b ORDER BY r.i) FILTER (WHERE r.b IS NOT NULL), []) AS b
      FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY 1),
p AS MATERIALIZED (
  SELECT conv_id, d, md5(array_to_string(k[1:d], '')) AS node, md5(array_to_string(k[1:d - 1], '')) AS up, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS b, d = len(k) AS last
  FROM (SELECT conv_id, k, b, unnest(range(0, len(k) + 1)) AS d FROM s)),
n AS MATERIALIZED (
  SELECT d, node, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n, max(b) AS b,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends
  FROM p GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, up AS node, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1, 2),
m AS MATERIALIZED (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids ON kids.d = n.d AND kids.node = n.node),
u AS (SELECT p.d, p.node, count(*) FILTER (WHERE m.kids = 0) AS leaves, sum((m.n - 1) * m.b) AS saved
      FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY 1, 2)
SELECT m.conv_id, m.d::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n::BIGINT AS n_convs, m.kids::BIGINT AS n_children,
       u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN u ON u.d = m.d AND u.node = m.node LEFT JOIN n q ON q.d = m.d - 1 AND q.node = m.up
"""


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    r = docs.select("doc_id", pieces.round_trip(docs["text"], pieces.model_path()).alias("r"))
    return r.select(
        "doc_id",
        F.size("r.ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("r.ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("r.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vectorcodes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = vectorcodes.with_label_errors(codes)
    return rows.select(F.col("id").alias("vec_id"), vectorcodes.hex_code(F.col("code")).alias("code"), "error", "label_error", F.lit(codes.codebooks_sha256()).alias("codebooks_sha256"))


def _op13_sql(rounds: int = 6) -> str:
    """Each round: the nearest entry of every part, then the entries' means (floored)."""
    steps = """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q, len(embedding) // 8 AS s
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS MATERIALIZED (SELECT vec_id, label, i AS part, q[i * s + 1:(i + 1) * s] AS x FROM (SELECT *, unnest(range(0, 8)) AS i FROM v)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM p QUALIFY e < 16),
"""
    for r in range(rounds + 1):
        steps += f"""
a{r} AS MATERIALIZED (
  SELECT p.vec_id, p.part, any_value(p.label) AS label, any_value(p.x) AS x,
         min(list_sum(list_transform(range(1, len(p.x) + 1), lambda k: (p.x[k] - b.x[k]) * (p.x[k] - b.x[k])))::BIGINT * 16 + b.e) AS m
  FROM p JOIN b{r} b ON b.part = p.part GROUP BY 1, 2),
"""
        if r < rounds:
            steps += f"""
c{r} AS (SELECT part, e, k, sum(v) AS s, count(*) AS n FROM (SELECT part, m % 16 AS e, unnest(range(0, len(x))) AS k, unnest(x) AS v FROM a{r}) GROUP BY 1, 2, 3),
b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.e, coalesce(y.x, b.x) AS x FROM b{r} b LEFT JOIN (
    SELECT part, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS x FROM c{r} GROUP BY 1, 2) y ON y.part = b.part AND y.e = b.e),
"""
    return f"""{steps}
r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m % 16), '' ORDER BY part) AS code, sum(m // 16)::BIGINT AS error FROM a{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r, h
"""


OP13_SQL = _op13_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_sharding": op4_sharding,
    "op5_pii": op5_pii,
    "op6_passages": op6_passages,
    "op7_mixing": op7_mixing,
    "op8_secrets": op8_secrets,
    "op9_neighbours": op9_neighbours,
    "op10_neardup": op10_neardup,
    "op11_turn_trie": op11_turn_trie,
    "op12_pieces": op12_pieces,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": OP2_SQL, "op6_passages": OP6_SQL, "op7_mixing": OP7_SQL, "op10_neardup": OP10_SQL, "op11_turn_trie": OP11_SQL, "op13_vector_codes": OP13_SQL}
