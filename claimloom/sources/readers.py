"""Readers: candidate CSV files, record logs, JSON exports, pages, documents from binary files."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions.text import blank, html_to_text, page_title, strip, text_title
from claimloom.operators.order import fresh

#: Columns by which a candidate file's layout is told.
FULL_COLUMNS = ("query_interval_start", "query_interval_end", "seen_at", "url", "has_sk", "has_samsung", "has_intel", "has_nvidia")
SAMPLE_COLUMNS = ("stratum", "sample_rank", "candidate_count", "url", "seen_at")


def candidates(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(layout, rows) of a CSV file with a header: `reused_stratified_sample` or `full_export`, by its columns; ValueError for neither."""
    rows = spark.read.option("header", True).csv(path)
    for layout, wanted in (("reused_stratified_sample", SAMPLE_COLUMNS), ("full_export", FULL_COLUMNS)):
        if set(wanted) <= set(rows.columns):
            return layout, rows.select(*wanted)
    raise ValueError(f"candidate columns not recognised: {rows.columns}")


def record_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of an append-only log of JSON lines, with `ordinal`. A torn last line is left out; a malformed line elsewhere fails the read.

    Lines of a file are in order of their place in it, files in order of their names.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    parsed = lines.where(~blank(F.col("value"))).withColumn("r", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    last = parsed.agg(F.max(F.struct("file", "block", "line")).alias("last")).first()["last"]
    marked = parsed.withColumn("at", F.struct("file", "block", "line"))
    bad, torn = F.col("r._bad").isNotNull(), (F.col("file") == last["file"]) & (F.col("line") == last["line"]) if last else F.lit(False)
    good = F.when(bad & torn, False).when(bad, F.raise_error(F.concat(F.lit("malformed record: "), "value"))).otherwise(True)
    return marked.where(good).select("r.*", F.col("at").alias("ordinal")).drop("_bad")


def exports(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """Producers' JSON objects, one per file (or, with lines, one per line), with `file`."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path).withColumn("file", F.col("_metadata.file_path"))


def pages(rows: DataFrame) -> DataFrame:
    """(url, title, content) of fetched pages(url, html)."""
    return rows.select("url", page_title(F.col("html"), F.col("url")).alias("title"), html_to_text(F.col("html")).alias("content"))


def docx_text(data: bytes) -> str:
    """Non-empty paragraphs of a Word file's body, a blank line between; tables are left out."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{word}body")
    texts = ("".join(t.text or "" for t in p.iter(f"{word}t")).strip() for p in body.findall(f"{word}p"))
    return "\n\n".join(t for t in texts if t)


def pdf_text(data: bytes) -> str:
    """Texts of the pages that have any, a blank line between. Needs the pypdf library on the workers."""
    from pypdf import PdfReader

    texts = (page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)
    return "\n\n".join(t.strip() for t in texts if t.strip())


def _extract(content: pa.Array, name: pa.Array) -> pa.Array:
    out = []
    for data, n in zip(content.to_pylist(), name.to_pylist(), strict=True):
        low = n.lower()
        out.append(docx_text(data) if low.endswith(".docx") else pdf_text(data) if low.endswith(".pdf") else data.decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def files(spark: SparkSession, path: str) -> DataFrame:
    """(name, title, content) of files: Word and PDF by their extension, anything else as UTF-8."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = spark.read.format("binaryFile").load(path).select(name.alias("name"), "content")
    text = F.arrow_udf(_extract, returnType="string")("content", "name")
    return rows.select("name", text.alias("content")).select("name", text_title(F.col("content"), F.col("name")).alias("title"), "content")


def documents(sources: DataFrame, fetched: DataFrame) -> DataFrame:
    """sources(source_type, data binary, name, ...) with `title` and `content`, by type.

    `url`: data is an address, whose page is looked up in fetched(url, html); null where it
    hasn't been fetched. `file`: Word and PDF by the name's extension, anything else as UTF-8; its title
    is its name. Anything else is text, trimmed: its title is its name, or its first 30 characters on
    one line. Null data is empty; an empty name counts as none. Columns `title` and `content` of
    sources are replaced. Of pages fetched twice one counts.
    """
    named = F.when(F.coalesce("name", F.lit("")) != "", F.col("name"))
    address, text_of, is_url, is_file = (fresh(sources, x) for x in ("address", "text_of", "is_url", "is_file"))
    decode = F.arrow_udf(_extract, returnType="string")
    marked = sources.withColumns({is_url: F.coalesce(F.col("source_type") == "url", F.lit(False)), is_file: F.coalesce(F.col("source_type") == "file", F.lit(False))})
    x = marked.withColumn(text_of, decode(F.coalesce("data", F.lit(b"")), F.when(F.col(is_file), F.coalesce(named, F.lit(""))).otherwise("")))
    x = x.withColumn(address, F.when(F.col(is_url), strip(F.col(text_of))))
    read = pages(fetched.dropDuplicates(["url"])).select(F.col("url").alias(address), F.col("title").alias(f"{address} title"), F.col("content").alias(f"{address} content"))
    low = F.lower(F.coalesce(named, F.lit("")))
    kind = F.when(low.endswith(".pdf"), "PDF Document").when(low.endswith(".docx"), "Word Document").otherwise("Text Document")
    own = strip(F.col(text_of))
    title = F.when(F.col(is_url), F.col(f"{address} title")).when(F.col(is_file), F.coalesce(named, kind)).otherwise(strip(F.translate(F.coalesce(named, F.substring(own, 1, 30)), "\n", " ")))
    content = F.when(F.col(is_url), F.col(f"{address} content")).when(F.col(is_file), F.col(text_of)).otherwise(own)
    # Only addresses are joined: texts and files stay where they are, instead of all lying in the task of the null address.
    found = x.where(F.col(is_url)).join(read, address, "left")
    rest = x.where(~F.col(is_url)).withColumns({f"{address} {c}": F.lit(None).cast("string") for c in ("title", "content")})
    out = found.unionByName(rest).withColumns({"title": title, "content": content})
    return out.drop(address, text_of, is_url, is_file, f"{address} title", f"{address} content")


def body_shard(sha: Column) -> Column:
    return F.substring(sha, 1, 2)


def number_lines(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """df with a dense number per partition of `order[0]`."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:])))
