"""Personal data and the terms that give it away, in DataFrame operations only.

Patterns find the protected entities. A term is a word outside of entities.
The context of an entity is the ``NEAR`` words before and after each of its
occurrences, so the pairs of terms and entities are linear in the entities.
Over the word positions of the corpus, with n of all, n_e in contexts of the
entity, n_t that hold the term and n_te that are both, the term tells
PMI = log(n_te * n / (n_t * n_e)) of the entity's information
IC = log(n / n_e). A term is disclosing if for some entity

* PMI reaches ``disclosure`` times IC, and
* it stands in contexts of the entity at least ``share`` of the times that it
  stands anywhere: who reads it guesses the entity at even odds or better, and
* ``support`` documents hold it near the entity, in contexts that differ:
  repeats within a document count once, and so do copies.

Rows with the same doc_id and text count once on all sides. Disclosing
terms are spans wherever they stand, also in documents without the entity.
Entities are generalised to their kind, terms are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import cut, documents, packed, span_digest, unpacked
from folio.llm.spans import SPAN, found_if, free_of, in_order, matches, replaced

#: Fixed patterns of the contract, written so that no match can backtrack, nor begin again inside a run that failed.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}]{3,}+"
KINDS = ["email", "ip", "card", "phone", "term"]
NEAR = 20
DISCLOSURE, SHARE, SUPPORT = 0.8, 0.5, 2


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test: from the right, every second digit doubled, digits summed."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.when(c.cast("int") > 4, 1).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_matches(text: Column) -> dict[str, Column]:
    number = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    small = lambda x: (F.length(number(x)) <= 3) & (F.substring(number(x), 1, 3).cast("int") <= 255)
    n_digits = lambda s: F.length(_digits(s["m"]))
    return {
        "email": found_if(text.contains("@"), text, EMAIL),
        "ip": F.filter(found_if(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), text, IP), lambda s: F.forall(F.split(s["m"], r"\."), small)),
        "card": F.filter(found_if(text.rlike(CARD), text, CARD), lambda s: F.when(n_digits(s).between(14, 19), _luhn(_digits(s["m"]))).otherwise(False)),
        "phone": F.filter(found_if(text.rlike(r"\+[0-9]"), text, PHONE), lambda s: n_digits(s).between(10, 15)),
    }


def _scanned(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base (array of kind, value, start, end), digest of the text; the text itself only where base isn't empty."""
    rows = documents(docs).withColumn("text_key", F.xxhash64("text"))
    rows = rows.select("doc_id", "text_key", "text", *[v.alias(k) for k, v in base_matches(F.col("text")).items()])

    def entities(kind: str) -> Column:
        value = _digits if kind in ("card", "phone") else F.lower
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), value(s["m"]).alias("value"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))

    rows = rows.select("doc_id", "text_key", "text", F.concat(*map(entities, KINDS[:4])).alias("base"))
    return rows.select("doc_id", "text_key", "base", F.sha2("text", 256).alias("digest"), F.when(F.size("base") > 0, F.col("text")).alias("text"))


def _words(text: Column) -> Column:
    """array<struct<term, start, end>>"""
    return F.transform(matches(text, TERM), lambda m: F.struct(F.lower(m["m"]).alias("term"), m["start"].alias("start"), m["end"].alias("end")))


def _contexts(scanned: DataFrame, near: int) -> DataFrame:
    """doc_id, text_key, entity, context (hash of its terms), term, start: the words near each occurrence of an entity."""
    rows = scanned.where(F.size("base") > 0).select("doc_id", "text_key", "base", _words(F.col("text")).alias("words"))
    event = lambda s, entity, term: F.struct(s["start"].cast("int").alias("start"), entity.cast("string").alias("entity"), term.cast("string").alias("term"))
    entities = F.transform("base", lambda s: event(s, F.concat_ws(":", s["kind"], s["value"]), F.lit(None)))
    words = F.transform(free_of(F.col("words"), F.col("base"), "term"), lambda w: event(w, F.lit(None), w["term"]))
    rows = rows.select("doc_id", "text_key", F.array_sort(F.concat(entities, words)).alias("events"))
    # ``events`` is a column of its own, so each slice costs its own length only; it isn't carried along with what is exploded.
    around = lambda i: F.filter(F.slice("events", F.greatest(i - near + 1, F.lit(1)), F.lit(near) + F.least(i, F.lit(near)) + 1), lambda e: e["term"].isNotNull())
    places = F.filter(F.transform("events", lambda e, i: F.struct(e["entity"].alias("entity"), i.alias("i"))), lambda x: x["entity"].isNotNull())
    found = F.transform(places, lambda x: F.struct(x["entity"].alias("entity"), around(x["i"]).alias("near")))
    rows = rows.select("doc_id", "text_key", F.explode(found).alias("f")).select("doc_id", "text_key", "f.entity", F.xxhash64("f.near.term").alias("context"), F.explode("f.near").alias("w"))
    return rows.select("doc_id", "text_key", "entity", "context", "w.term", "w.start")


def _counts(docs: DataFrame) -> DataFrame:
    """term, n_t over the corpus: each doc_id and text once. Counts are summed in tasks before they are shuffled.

    All rows are counted; then, of texts that are there m times under one
    doc_id, m - 1 times their words are taken off, so only such texts are shuffled.
    """
    words = F.explode(F.array_append(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower), F.lit(""))).alias("term")
    rows = documents(docs).withColumn("text_key", F.xxhash64("text"))
    more = cut(rows.groupBy("doc_id", "text_key").agg((F.count("*") - 1).alias("more")).where("more > 0").select(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), "more"))
    again = rows.join(more, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_key") == F.col("m_key"))).dropDuplicates(["doc_id", "text_key"])
    each = rows.select(words, F.lit(1).cast("long").alias("c")).union(again.select(words, -F.col("more")))
    return each.groupBy("term").agg(F.sum("c").alias("n_t"))


def disclosing_terms(docs: DataFrame, scanned: DataFrame, disclosure: float = DISCLOSURE, share: float = SHARE, support: int = SUPPORT, near: int = NEAR) -> DataFrame:
    """entity, term pairs above the thresholds."""
    # A position near two occurrences of an entity counts once.
    met = cut(_contexts(scanned, near).groupBy("doc_id", "text_key", "entity", "term", "start").agg(F.min("context").alias("context")))
    n_e = met.groupBy("entity").agg(F.count_distinct("doc_id", "text_key", "start").alias("n_e"))
    each = met.groupBy("entity", "term", "doc_id", "text_key").agg(F.count("*").alias("n"), F.min("context").alias("context"))
    n_te = each.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count_distinct("context").alias("contexts")).where(F.col("contexts") >= support)
    pairs = cut(n_te.select("entity", "term", "n_te").join(cut(n_e), "entity"))
    counts = cut(_counts(docs))
    # Each row has an empty word besides, so that an empty corpus has a count too.
    n = counts.agg(F.sum("n_t").alias("n"))
    told = pairs.join(counts, "term").crossJoin(F.broadcast(n))  # n is one row
    pmi = F.log(F.col("n_te") * F.col("n") / (F.col("n_t") * F.col("n_e")))
    return told.where((F.col("n_te") >= F.col("n_t") * share) & (pmi >= F.log(F.col("n") / F.col("n_e")) * disclosure)).select("entity", "term")


def personal_spans(docs: DataFrame, disclosure: float = DISCLOSURE, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """One row per document: doc_id, text_key, base and terms (arrays of kind, start, end), digest, text (null if there are no spans)."""
    scanned = cut(_scanned(docs))
    told = cut(disclosing_terms(docs, scanned, disclosure, share, support).select("term").distinct())
    # The terms are few: their table is sent to the words of all documents while it is small; beyond that, words alone are shuffled.
    rows = documents(docs).withColumn("text_key", F.xxhash64("text"))
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))
    hits = cut(rows.select("doc_id", "text_key", F.explode(words).alias("term")).join(told, "term", "left_semi").select(F.col("doc_id").alias("t_id"), F.col("text_key").alias("t_key")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_key") == F.col("t_key"))
    # Places are worked out in documents that hold such a term only.
    holders = cut(rows.join(hits, same, "left_semi").dropDuplicates(["doc_id", "text_key"]))
    placed = holders.select("doc_id", "text_key", F.explode(_words(F.col("text"))).alias("w")).select("doc_id", "text_key", "w.term", "w.start", "w.end")
    span = F.struct(F.lit("term").alias("kind"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    terms = placed.join(told, "term", "left_semi").groupBy("doc_id", "text_key").agg(F.collect_list(span).alias("terms"))
    terms = terms.select(F.col("doc_id").alias("t_id"), F.col("text_key").alias("t_key"), "terms")
    texts = holders.select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"), F.col("text").alias("h_text"))
    terms = terms.join(texts, F.col("t_id").eqNullSafe(F.col("h_id")) & (F.col("t_key") == F.col("h_key"))).select("t_id", "t_key", "terms", "h_text")
    joined = scanned.join(terms, same, "left")
    base = in_order(F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), KINDS)
    free = F.when(F.col("terms").isNull(), F.array().cast(SPAN)).when(F.size("base") == 0, F.array_sort("terms")).otherwise(free_of(F.col("terms"), F.col("base")))
    return joined.select("doc_id", "text_key", base.alias("base"), free.alias("terms"), "digest", F.coalesce("text", "h_text").alias("text"))


def _clean(text: Column, base: Column, terms: Column) -> Column:
    return replaced(text, in_order(F.concat(base, terms), KINDS), lambda k: F.when(k == "term", F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(k), F.lit(">"))))


def personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all), n_terms, n_spans (all), clean_sha256 (of the sanitised text).

    Null and empty texts have no spans; repeated rows give repeated results;
    spans of two kinds may overlap, each is reported; an empty table gives
    none. Work is linear in a text's matches and words, but for sorting; a
    text of 5 MB in one line is a test. Ids must be numbers.
    """
    found = personal_spans(docs, disclosure, share, support)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.concat("base", "terms")
    clean = F.when(F.size(every) > 0, F.sha2(_clean(F.col("text"), F.col("base"), F.col("terms")), 256)).otherwise(F.col("digest"))
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(span_digest(F.col("base")), 256).alias("base_sha256"), span_digest(in_order(every, KINDS)).alias("spans"), F.size("terms").cast("long").alias("n_terms"), F.size(every).cast("long").alias("n_spans"), clean.alias("clean_sha256"))


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """The documents with entities generalised to their kind, as <EMAIL>, and disclosing terms removed, n_chars to match; other columns as they are, whatever their names."""
    found = personal_spans(docs, disclosure, share, support).where(F.size("base") + F.size("terms") > 0).dropDuplicates(["doc_id", "text_key"])
    found = found.select(F.col("doc_id").alias("s_id"), F.col("text_key").alias("s_key"), "base", "terms")
    rows = packed(docs)
    joined = rows.join(found, rows["id"].eqNullSafe(F.col("s_id")) & (rows["text_key"] == F.col("s_key")), "left")
    return unpacked(joined, _clean(F.col("text"), F.col("base"), F.col("terms")), F.col("base").isNotNull())
