"""Corpus files, pages, sentence windows and their identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions.text import bound, chunk_id, safe_filename, strip_boilerplate, u_trim, unescape

PAGE_MARK = r"(?i)-+ Page \d+ -+"
METADATA = ("author", "publisher", "published_at", "category", "url")


def read_files(spark: SparkSession, directory: str) -> DataFrame:
    """(source, content, failure) of every .txt and .md file; a file that is not UTF-8 has a failure and no content."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md}").load(directory)
    text = F.expr("try_validate_utf8(cast(content as string))")
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("source"), text.alias("content"), F.when(text.isNull(), F.lit("not valid UTF-8")).alias("failure"))


def _paged(docs: DataFrame, source: str, text: str) -> DataFrame:
    """(source, title, paragraph_id, __p): a document's pages as an array of (page, content).

    A first line ``Title: `` names the document, a second ``Paragraph-ID: `` line is no evidence; both leave the text. What
    precedes the first page marker is dropped; without a marker, or with empty pages only, all is page 1.
    """
    d = docs.select(F.col(source).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    head = r"^Title: ([^\n]*)(?:\n|$)"
    d = d.withColumn("title", F.when(F.col("__t").rlike(head), u_trim(F.regexp_extract("__t", head, 1))).otherwise(F.col("source").cast("string")))
    d = d.withColumn("__t", F.regexp_replace("__t", head, ""))
    line = r"^\s*Paragraph-ID: ([^\n]*)(?:\n|$)"
    d = d.withColumn("paragraph_id", F.nullif(u_trim(F.regexp_extract("__t", line, 1)), F.lit("")))
    d = d.withColumn("__t", F.regexp_replace("__t", line, ""))
    marks = F.regexp_extract_all("__t", F.lit(r"(?i)-+ Page (\d+) -+"), F.lit(1))
    parts = F.filter(F.split("__t", PAGE_MARK), lambda _, i: i > 0)
    pages = F.filter(F.zip_with(marks, parts, lambda n, c: F.struct(n.cast("int").alias("page"), u_trim(c).alias("content"))), lambda p: p["content"] != "")
    whole = F.array(F.struct(F.lit(1).alias("page"), u_trim(F.regexp_replace("__t", PAGE_MARK, "")).alias("content")))
    d = d.withColumn("__p", bound(pages, lambda p: F.when(F.size(p) > 0, p).otherwise(whole)))
    return d.select("source", "title", "paragraph_id", "__p")


def parse_pages(docs: DataFrame, source: str, text: str) -> DataFrame:
    """(source, title, paragraph_id, page_no, page, content): pages in order from 1."""
    d = _paged(docs, source, text)
    return d.select("source", "title", "paragraph_id", F.posexplode("__p").alias("page_no", "p")).select("source", "title", "paragraph_id", "page_no", "p.page", "p.content")


def sentence_windows(text: Column, n: int = 6) -> Column:
    """Windows of ``n`` sentences joined by one space; the tail stays, empty sentences do not."""
    s = F.filter(F.split(u_trim(F.coalesce(text, F.lit(""))), r"(?U)(?<=[.!?])\s+"), lambda x: x != "")  # no sentence has blanks at its ends then

    def windows(s: Column) -> Column:
        starts = F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s), F.lit(n))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(s, i, n), " "))

    return bound(s, windows)


def chunk_documents(docs: DataFrame, source: str, text: str, n: int = 6, *, paged: bool = True) -> DataFrame:
    """(id, source, title, page, sent_id, text): windows never cross a page; ``sent_id`` counts through the document.

    A document's windows are numbered in its own row, so no text is shuffled. Without ``paged`` a text is one page as it is.
    """
    if paged:
        d = _paged(docs, source, text)
    else:
        d = docs.select(F.col(source).alias("source"), F.col(source).cast("string").alias("title"), F.array(F.struct(F.lit(1).alias("page"), F.col(text).alias("content"))).alias("__p"))
    windows = F.flatten(F.transform("__p", lambda p: F.transform(sentence_windows(p["content"], n), lambda w: F.struct(p["page"].alias("page"), w.alias("text")))))
    w = d.select("source", "title", F.posexplode(windows).alias("sent_id", "w"))
    return w.select(chunk_id(F.col("source").cast("string"), F.col("title"), F.col("sent_id")).alias("id"), "source", "title", "w.page", "sent_id", "w.text")


def empty_documents(docs: DataFrame, source: str, text: str) -> DataFrame:
    """Documents without a sentence: error rows."""
    return docs.where(F.size(sentence_windows(F.col(text))) == 0).select(F.col(source).alias("source"), F.lit("no text").alias("failure"))


def source_metadata(rows: DataFrame) -> DataFrame:
    """One row a source with the allowed fields, trimmed, blanks as null; of repeated rows the fullest, then the greatest."""
    clean = [F.nullif(u_trim(F.col(c)), F.lit("")).alias(c) for c in METADATA]
    filled = sum((F.col(c).isNotNull().cast("int") for c in METADATA), F.lit(0))
    best = rows.select("source", *clean).groupBy("source").agg(F.max(F.struct(filled.alias("n"), *METADATA)).alias("m"))
    return best.select("source", *(f"m.{c}" for c in METADATA))


def metadata_from_json(spark: SparkSession, path: str) -> DataFrame:
    """The metadata file, an object of objects by source, as rows."""
    fields = ", ".join(f"{c} string" for c in METADATA)
    text = spark.read.text(path, wholetext=True)
    m = text.select(F.explode(F.from_json("value", f"map<string, struct<{fields}>>")).alias("source", "m"))
    return source_metadata(m.select("source", "m.*"))


def with_metadata(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join; the planner broadcasts the metadata while it is small."""
    return chunks.join(source_metadata(metadata), "source", "left")


def article_corpus(articles: DataFrame) -> DataFrame:
    """Scraped articles (ord, title, body, and metadata) with decoded titles, stripped bodies and unique file names."""
    a = articles.withColumn("title", unescape("title")).withColumn("body", strip_boilerplate(unescape("body"))).where("body <> ''")
    a = a.withColumn("base", safe_filename(F.col("title")))
    nth = F.row_number().over(W.partitionBy("base").orderBy("ord"))
    return a.withColumn("source", F.when(nth == 1, F.concat("base", F.lit(".txt"))).otherwise(F.concat("base", F.lit("_"), (nth - 1).cast("string"), F.lit(".txt")))).drop("base")


def evidence(queries: DataFrame, evidence_list: str) -> DataFrame:
    """Titles in first-seen order without repeats, facts with repeats, of an array of (title, fact)."""
    e = F.coalesce(F.col(evidence_list), F.array().cast(queries.schema[evidence_list].dataType))
    titles = F.array_distinct(F.filter(F.transform(e, lambda x: u_trim(x["title"])), lambda t: t.isNotNull() & (t != "")))
    facts = F.filter(F.transform(e, lambda x: u_trim(x["fact"])), lambda t: t.isNotNull() & (t != ""))
    return queries.withColumn("evidence_docs", titles).withColumn("evidence_facts", facts)


def sentences_of(paragraphs: DataFrame) -> DataFrame:
    """(source_id, title, idx, sentence) of the sentence store; broken JSON has no sentences, repeated rows count once."""
    s = paragraphs.select("source_id", "title", F.from_json("sentences", "array<string>").alias("s")).where("s is not null").distinct()
    return s.select("source_id", "title", F.posexplode("s").alias("idx", "sentence"))


def hotpot_source_id(title: Column) -> Column:
    return F.concat(F.lit("hotpotqa_"), F.substring(F.sha2(title, 256), 1, 24))


def occurrence_id(query_id: Column, row: Column) -> Column:
    return F.format_string("%s__row_%04d", query_id, row)


def table_digest(df: DataFrame, *columns: str) -> DataFrame:
    """(rows, digest) that do not depend on row order, by a sum of row hashes instead of one sorted list of everything."""
    h = F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns)), 256)
    part = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("decimal(38,0)")
    sums = [F.sum(part(a)).cast("string").alias(f"s{a}") for a in (1, 9, 17, 25)]
    s = df.select(*columns).agg(F.count(F.lit(1)).alias("rows"), *sums)
    return s.select("rows", F.sha2(F.concat_ws("|", "rows", *(F.coalesce(f"s{a}", F.lit("0")) for a in (1, 9, 17, 25))), 256).alias("digest"))
