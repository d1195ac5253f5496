"""Queries p3 to p7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellora.llm import leaks as lk
from vellora.llm import lookalike as la
from vellora.llm import packing as pk
from vellora.llm import quality as ql
from vellora.llm import segment as sg
from vellora.operators.references import clean_ref
from vellora.plans.registry import Registry
from vellora.session import table

Q = Registry()

LIMIT, OVERLAP = 8000, 200


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "blocks").select("doc_id", "block_idx", "heading", "parent_headings", "content")
    return sg.split_oversized(b, "content", LIMIT, OVERLAP)


_EST = (
    "CAST(floor(((length(regexp_replace(content, '[^一-龥]', '', 'g')) * CAST(0.75 AS DOUBLE) + length(regexp_replace(content, '[^\\[\\]\",{}]', '', 'g')) * CAST(1 AS DOUBLE)"
    " + length(regexp_replace(content, '[一-龥\\[\\]\",{}]', '', 'g')) * CAST(0.4 AS DOUBLE)) * CAST(1.05 AS DOUBLE))) AS BIGINT) + 2"
)


@Q.add(sql=f"SELECT DISTINCT doc_id, block_idx FROM blocks WHERE content <> '' AND {_EST} > {LIMIT}")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Blocks above the limit: those the splitter cut."""
    return _pieces(spark, d).filter("piece_no = 0 and n_pieces > 1").select("doc_id", "block_idx").distinct()


@Q.add()
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of oversized blocks with heading and parent headings."""
    return _pieces(spark, d).dropDuplicates(["doc_id", "block_idx", "piece_no"])


def two_topics(spark: SparkSession, d: str, limit: int) -> DataFrame:
    """Texts of two topics with a known border: volume, border (characters before the second topic), content.

    Test items of one language after those of another: 20 in English, cut at the end of a sentence at three quarters of the limit, then four in
    one other language. Each is followed by a blank or, where the hash of its id is even, a line feed.
    """
    items = table(spark, d, "benchmark").filter("text is not null and item_id is not null and lang is not null").select("item_id", "text", "lang").distinct()
    ended = F.concat("text", F.when(F.xxhash64("item_id") % 2 == 0, F.lit("\n")).otherwise(F.lit(" ")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("item_id"), "text")) - 1  # of a table of fixed size
    part = items.select("lang", place.alias("place"), ended.alias("t")).withColumn("no", F.floor(F.col("place") / F.when(F.col("lang") == "en", 20).otherwise(4)))
    joined = part.groupBy("lang", "no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]), "").alias("t"))
    volume = F.row_number().over(Window.partitionBy(F.col("lang") == "en").orderBy("lang", "no")).alias("volume")
    joined = joined.select("lang", "t", volume)
    most = int(limit * 0.75 / 0.42)
    a = joined.filter("lang = 'en'").select("volume", F.regexp_extract("t", r"(?s)^(.{%d}[^.!?]*[.!?]\s).*" % most, 1).alias("a"))
    b = joined.filter("lang <> 'en'").select("volume", F.col("t").alias("b"))
    return a.join(b, "volume").filter("a <> ''").select("volume", F.length("a").alias("border"), F.concat("a", F.repeat("b", 4)).alias("content"))


@Q.add()
def p3_topics(spark: SparkSession, d: str) -> DataFrame:
    """Cuts at planted borders of topics: characters between the border and the nearest end of a piece."""
    limit = 2000
    cut = sg.split_oversized(two_topics(spark, d, limit), "content", limit, 100)
    return cut.groupBy("volume", "border").agg(F.min(F.abs(F.col("end_at") - F.col("border"))).alias("off"), F.count("*").alias("pieces"))


_ITEMS = "SELECT DISTINCT item_id, doc_id, upper(trim(uuid, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))) AS r, violation_text AS q FROM edit_items WHERE regexp_matches(violation_text, '[^\\t-\\r\\x{85}\\p{Z}]')"


# The form of the quotes in these tables, written down a second time and character by character: code points by arithmetic, letters side by side.
_LETTERS = ("аеорсухѕіјАВЕКМНОРСТУХЅІЈοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ‐‑", "aeopcyxsijABEKMHOPCTYXSIJoABEZHIKMNOPTYX--")
_RADICALS = ("⼀⼈⼚⼩⼯⼿⽀⽂⽅⽆⽇⽉⽔⽤⽯⽴⾃⾏⾦⾯⾸", "一人厂小工手支文方无日月水用石立自行金面首")
_CHAR = (
    "CASE WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) WHEN unicode(c) IN (160, 8199, 8201, 8239, 12288, 9) OR unicode(c) BETWEEN 8192 AND 8202 THEN ' '"
    " WHEN unicode(c) IN (173, 8203, 8204, 8205, 8288, 65279) THEN '' WHEN unicode(c) = 64256 THEN 'ff' WHEN unicode(c) = 64257 THEN 'fi' WHEN unicode(c) = 64258 THEN 'fl' WHEN unicode(c) = 64259 THEN 'ffi'"
    f" ELSE translate(c, '{_LETTERS[0] + _RADICALS[0]}', '{_LETTERS[1] + _RADICALS[1]}') END"
)


def _plain(text: str) -> str:
    bare = f"translate({text}, '{''.join(map(chr, (173, 8203, 8204, 8205, 8288, 65279)))}', '')"
    return f"nfc_normalize(array_to_string(list_transform(string_split(nfc_normalize({bare}), ''), lambda c: {_CHAR}), ''))"


@Q.add(
    sql=f"""WITH i AS (SELECT *, {_plain('q')} AS f FROM ({_ITEMS})), b AS (SELECT DISTINCT doc_id, upper(uuid) AS r, content AS c, {_plain('content')} AS f FROM blocks WHERE content IS NOT NULL)
SELECT item_id FROM i JOIN b ON b.doc_id = i.doc_id AND b.r = i.r WHERE i.r <> '' AND trim(i.f, ' ' || chr(10) || chr(13)) <> '' GROUP BY item_id HAVING bool_or(contains(b.f, i.f)) AND NOT bool_or(contains(b.c, i.q))"""
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Items whose quote is in its block only in the consistent form."""
    return la.unmasked_quotes(table(spark, d, "edit_items"), table(spark, d, "blocks"), "item_id", "doc_id", "uuid", "violation_text", "content", clean_ref)


@Q.add()
def p4_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes in the consistent form."""
    return la.consistent(table(spark, d, "edit_items").select("item_id", "violation_text"), {"violation_text": "form"}).distinct()


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return lk.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


_WORDS = "regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}]+')"


def _windows(table_name: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i + 1:i + 12], ' ') AS g FROM (SELECT {key}, w, unnest(range(len(w) - 11)) AS i FROM (SELECT {key}, {_WORDS} AS w FROM {table_name} WHERE text IS NOT NULL) WHERE len(w) >= 12)"


@Q.add(sql=f"SELECT DISTINCT doc_id, item_id FROM ({_windows('documents', 'doc_id')}) d JOIN ({_windows('benchmark', 'item_id')}) b ON d.g = b.g")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Reviews and the test items of which they hold twelve consecutive words."""
    return _leaks(spark, d).filter("longest_run >= 12").select("doc_id", "item_id")


@Q.add()
def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Aligned pairs, edited copies included: a score of at least 24 (twelve words) or a quarter of the item."""
    return _leaks(spark, d).select("doc_id", "item_id", "score", F.round("share", 4).alias("share"), "longest_run")


def edited_copies(spark: SparkSession, d: str, every: list[int]) -> DataFrame:
    """A copy of each test item between other words, for each n of ``every`` with each n-th word replaced: every, item_id, text."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    items = table(spark, d, "benchmark").filter("item_id is not null").select("item_id", words.alias("w"), F.explode(F.array([F.lit(n) for n in every])).alias("every"))
    edited = F.transform("w", lambda x, i: F.when((i + 1) % F.col("every") == 0, F.concat(F.lit("zq"), i.cast("string"))).otherwise(x))
    return items.filter(F.size("w") >= 24).select("every", "item_id", F.concat_ws(" ", F.lit("before it"), F.array_join(edited, " "), F.lit("and after")).alias("text")).distinct()


@Q.add(
    sql=f"WITH w AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) SELECT every, count(*) AS planted, count(*) AS found FROM w, (SELECT unnest([6, 8, 10, 12]) AS every) WHERE len(w) >= 24 GROUP BY every"
)
def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of edited copies of the test items, by rate of edits: copies planted, and those found with their own item."""
    copies = edited_copies(spark, d, [6, 8, 10, 12]).withColumn("copy", F.concat_ws("/", "every", "item_id"))
    found = lk.leaks(copies, table(spark, d, "benchmark"), "copy", "text", "item_id", "text").withColumnRenamed("item_id", "other")
    own = copies.join(found, "copy", "left").groupBy("every", "copy", "item_id").agg(F.max((F.col("other") == F.col("item_id")).cast("int")).alias("hit"))
    return own.groupBy("every").agg(F.count("*").alias("planted"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"))


@Q.add()
def p5_packing(spark: SparkSession, d: str) -> DataFrame:
    """Reviews in containers of 2048 tokens."""
    return pk.pack(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id", "text", "source")


@Q.add()
def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return pk.fill_report(p5_packing(spark, d))


@Q.add()
def p5_mix(spark: SparkSession, d: str) -> DataFrame:
    """How near each window is to the sources' shares."""
    return pk.mix_report(p5_packing(spark, d), "source")


@Q.add()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Reviews that are a list, a table or junk."""
    return ql.text_statistics(table(spark, d, "documents"), "doc_id", "text").filter("kind in ('list', 'table', 'junk')").select("doc_id").distinct()


@Q.add()
def p7_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of all reviews."""
    return ql.text_statistics(table(spark, d, "documents"), "doc_id", "text")


def strung_together(spark: SparkSession, d: str) -> DataFrame:
    """The reviews of 512 neighbouring ids as one text, in order of their id: texts far longer than a review."""
    docs = table(spark, d, "documents").filter("text is not null and doc_id is not null").withColumn("volume", F.floor(F.col("doc_id") / 512))
    return docs.groupBy("volume").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("text"))


@Q.add()
def p7_huge(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of texts so long that their chunks are spread over the cluster."""
    return ql.text_statistics(strung_together(spark, d), "volume", "text", stretch=1 << 16)
