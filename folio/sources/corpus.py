"""Sources: feeds, the taxonomy, and a paper corpus made from the plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import schema
from folio.functions import text as T


def categories(spark: SparkSession) -> DataFrame:
    """ord, code, name, grp; a constant of 155 rows."""
    return spark.createDataFrame([(o, c, n) for o, c, n, _ in schema.CATEGORIES], "ord int, code string, name string").withColumn("grp", T.group_of(F.col("code")))


def error_contracts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(schema.ERRORS, "reason string, code string, when string")


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """A corpus of papers kept as Parquet."""
    return spark.read.parquet(path).select(*schema.PAPER_FIELDS)


def parse_feed(feeds: DataFrame, column: str = "xml") -> DataFrame:
    """total_results, start_index, entries of feed texts; ok is false where there is no feed."""
    feed = F.from_xml(F.col(column), schema.FEED, {"columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = feeds.withColumn("_feed", feed)
    number = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))
    ok = F.col(column).rlike(r"<feed[\s>]") & F.col("_feed._corrupt_record").isNull()
    return parsed.select("*", number(F.col("_feed.`opensearch:totalResults`")).alias("total_results"), number(F.col("_feed.`opensearch:startIndex`")).alias("start_index"), F.coalesce("_feed.entry", F.array()).alias("entries"), F.coalesce(ok, F.lit(False)).alias("ok")).drop("_feed")


def decode_entries(entries: DataFrame) -> DataFrame:
    """Papers of the raw entries in column ``entry``; other columns stay."""
    e = F.col("entry")
    text = lambda c: F.coalesce(c, F.lit(""))
    paper_id = T.extract_id(text(e["id"]))
    terms = F.coalesce(e["category"]["_term"], F.array().cast("array<string>"))
    links = F.coalesce(e["link"], F.array().cast("array<struct<_href:string,_rel:string,_title:string,_type:string>>"))
    fields = {
        "id": paper_id, "title": T.squeeze(text(e["title"])), "authors": F.coalesce(e["author"]["name"], F.array().cast("array<string>")), "abstract": T.squeeze(text(e["summary"])),
        "primary_category": T.primary_category(e["arxiv:primary_category"]["_term"], terms), "categories": terms, "published": text(e["published"]), "updated": text(e["updated"]),
        "comment": T.optional(e["arxiv:comment"]), "journal_ref": T.optional(e["arxiv:journal_ref"]), "doi": T.optional(e["arxiv:doi"]), "pdf_url": T.pdf_url(links, paper_id), "abstract_url": T.abstract_url(links, paper_id),
    }
    return entries.select(*[c for c in entries.columns if c != "entry"], *[v.alias(k) for k, v in fields.items()])


def read_feeds(feeds: DataFrame, column: str = "xml") -> DataFrame:
    """Papers of feed texts, in feed order (pos)."""
    parsed = parse_feed(feeds, column).where("ok")
    return decode_entries(parsed.select("total_results", "start_index", F.posexplode("entries").alias("pos", "entry")))


def papers_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in corpus: a paper for each document, with doc_id and base_id besides its fields."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    codes = F.array(*[F.lit(c[1]) for c in schema.CATEGORIES])
    n = len(schema.CATEGORIES)
    i = F.col("doc_id")
    base = F.concat(F.lit("24"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("."), T.five_digits(i))
    pick = lambda k: F.element_at(codes, (k % n + 1).cast("int"))
    day = lambda d: F.concat(F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), d.cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    published = (i * 37) % 1500
    rows = docs.join(labels, "doc_id", "left").withColumn("base_id", base).withColumn("id", F.concat("base_id", F.lit("v"), (i % 3 + 1).cast("string")))
    first_line = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    return rows.select(
        "doc_id", "base_id", "id",
        F.substring(T.squeeze(first_line), 1, 120).alias("title"),
        F.array(F.concat(F.lit("Author "), i % 97), F.concat(F.lit("Author "), i % 31)).alias("authors"),
        T.squeeze(F.col("text")).alias("abstract"),
        pick(i).alias("primary_category"), F.array_distinct(F.array(pick(i), pick(i * 7 + 3))).alias("categories"),
        day(published).alias("published"), day(published + i % 5).alias("updated"),
        F.when(i % 4 != 0, F.concat(F.col("n_chars").cast("string"), F.lit(" characters"))).alias("comment"),
        F.when(F.col("quality") == 1, F.concat(F.lit("Journal "), "source")).alias("journal_ref"),
        F.when(F.col("toxic") == 0, F.concat(F.lit("10.1234/"), i)).alias("doi"),
        F.concat(F.lit(schema.PDF_URL), "id").alias("pdf_url"), F.concat(F.lit(schema.ABSTRACT_URL), "id").alias("abstract_url"),
    )


def renderings_of_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(native, mirror) renderings: base_id, status, html. Pages stand for papers of the same number; statuses vary by page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    i = F.col("page_id")
    base = F.concat(F.lit("24"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("."), T.five_digits(i))
    noisy = F.replace(F.replace(F.replace(F.col("html"), F.lit("<p>"), F.lit('<p class="ltx_para" id="p1">')), F.lit("<h1>"), F.lit('<h1 class="ltx_title ltx_title_section" id="h">')), F.lit("</p>"), F.lit('</p><br class="ltx_break"/><br/>'))
    native = pages.where(i % 3 != 0).select(base.alias("base_id"), F.when(i % 11 == 0, 503).when(i % 7 == 0, 404).otherwise(200).alias("status"), noisy.alias("html"))
    mirror = pages.where(i % 3 != 1).select(base.alias("base_id"), F.when(i % 13 == 0, 307).otherwise(200).alias("status"), noisy.alias("html"))
    return native, mirror
