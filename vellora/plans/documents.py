"""Queries of Word documents: paragraphs written as packages, read back, edited and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellora.operators import edits as ed
from vellora.operators import match as mt
from vellora.operators import structure as st
from vellora.plans.blocks import _P
from vellora.plans.registry import Registry
from vellora.plans.texts import strip_sql
from vellora.session import table
from vellora.sources import docx as dx
from vellora.sources import docx_writer as dw

Q = Registry()

_D = f"{_P}, d AS (SELECT doc_id || '-' || CAST(pos // {dw.SECTION} AS VARCHAR) || '.docx' AS doc, * FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS n FROM d)"


def _packages(spark: SparkSession, d: str, **how) -> DataFrame:
    return dw.packages(st.current_paragraphs(table(spark, d, "paragraphs")), **how)


@Q.add(sql=f"WITH {_D} SELECT doc AS doc_id, n AS pos, {strip_sql('text')} AS text, para_id, CASE WHEN is_table THEN para_id_end END AS para_id_end, is_table, CASE WHEN NOT is_table THEN level END AS level FROM o")
def docx_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Body, styles and outline levels of packages written from all paragraphs."""
    return dx.read_binary(_packages(spark, d), strict=True).drop("table_header", "row_ids", "row_ends", "source_hash")


@Q.add(
    sql=f"""WITH {_D}, t AS (SELECT doc, n, para_id, para_id_end, text, from_json(text[8:-9], '[["VARCHAR"]]') AS r FROM o WHERE is_table)
SELECT doc AS doc_id, n AS pos, text, array_to_string(r[1], '|') AS header, CAST(len(r) AS INTEGER) AS n_rows, CAST(list_max(list_transform(r, lambda x: len(x))) AS INTEGER) AS n_columns, para_id AS first_id, para_id_end AS last_id FROM t"""
)
def docx_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables written with spans and vertical merges come back on their grid, with header rows and ids per cell."""
    from vellora.functions import text as tx

    t = dx.read_binary(_packages(spark, d), strict=True).filter("is_table")
    return t.select("doc_id", "pos", "text", F.array_join(F.col("table_header")[0], "|").alias("header"), F.size("row_ids").alias("n_rows"), F.array_max(F.transform("row_ends", F.size)).alias("n_columns"), tx.first_id(F.col("row_ids")).alias("first_id"), tx.last_id(F.col("row_ends")).alias("last_id"))


def _counter(k: int) -> str:
    """Counter of level k at heading h: explicit ones since the last higher heading, one more where a deeper one came first."""
    since = f"x.doc = h.doc AND x.pos <= h.pos AND x.pos > coalesce((SELECT max(y.pos) FROM h y WHERE y.doc = h.doc AND y.pos < h.pos AND y.level < {k}), -1)"
    first = f"(SELECT min(x.pos) FROM h x WHERE {since} AND x.level = {k})"
    return f"(SELECT count(*) FROM h x WHERE {since} AND x.level = {k}) + CASE WHEN EXISTS (SELECT 1 FROM h x WHERE {since} AND x.level > {k} AND x.pos < coalesce({first}, 9e18)) THEN 1 ELSE 0 END"


_LABEL = " || ".join([f"CAST({_counter(1)} AS VARCHAR)", *(f"CASE WHEN level >= {k} THEN '.' || CAST({_counter(k)} AS VARCHAR) ELSE '' END" for k in range(2, 9))])


@Q.add(sql=f"WITH {_D}, h AS (SELECT * FROM o WHERE level IS NOT NULL AND NOT is_table) SELECT doc AS doc_id, n AS pos, {_LABEL} || ' ' || {strip_sql('text')} AS text FROM h")
def docx_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of headings numbered over all levels by an inherited list."""
    return dx.read_binary(_packages(spark, d, labels=True), strict=True).filter("level is not null").select("doc_id", "pos", "text")


@Q.add(
    sql=f"""WITH {_D}, s AS (SELECT *, strpos(reverse(text), ' ') AS b FROM o WHERE NOT is_table), c AS (SELECT *, CASE WHEN b = 0 THEN '' ELSE substr(text, 1, length(text) - b + 1) END AS head, CASE WHEN b = 0 THEN text ELSE substr(text, length(text) - b + 2) END AS tail FROM s)
SELECT doc AS doc_id, n AS pos, {strip_sql('''regexp_replace(head, '([0-9]+)', '<sup>\\1</sup>', 'g') || regexp_replace(tail, '([0-9]+)', '<sup>\\1</sup>', 'g') || CASE WHEN level IS NOT NULL THEN '<equation>{x}^{' || pos || '}</equation><drawing id="' || pos || '" name="P ' || pos || '" path="' || CASE WHEN pos % 2 = 1 THEN 'https://host.invalid/b.jpg?v=1" format="jpeg' ELSE 'word/media/a.png" format="png' END || '" />' ELSE '' END''')} AS text FROM c"""
)
def docx_runs(spark: SparkSession, d: str) -> DataFrame:
    """Raised runs, tracked changes, equations and drawings."""
    return dx.read_binary(_packages(spark, d, rich=True), strict=True).filter("not is_table").select("doc_id", "pos", "text")


@Q.add(sql=f"WITH {_D} SELECT DISTINCT doc AS doc_id, x.name, x.format, x.content FROM o, (VALUES ('a.png', 'png', 'first'), ('c.bin', 'emf', 'second')) x(name, format, content)")
def docx_images(spark: SparkSession, d: str) -> DataFrame:
    """Embedded images, formats by part before extension, links left out."""
    return dx.image_rows(_packages(spark, d, rich=True)).withColumn("content", F.col("content").cast("string"))


_KIND = "CASE WHEN is_table OR length(text) < 24 THEN -1 ELSE pos % 5 END"


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Items for every long paragraph, by its place: the first 12 characters replaced (0) or deleted (1), commented (2), none (3), all replaced twice over (4)."""
    p = st.current_paragraphs(table(spark, d, "paragraphs")).withColumn("kind", F.expr(_KIND)).filter("kind in (0, 1, 2, 4)")
    quote = F.when(F.col("kind") == 4, F.col("text")).otherwise(F.substring("text", 1, 12))
    turn = F.explode(F.when(F.col("kind") == 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    new = F.concat(F.lit("changed "), F.col("pos").cast("string"))
    return p.select(
        F.concat_ws("-", "doc_id", F.floor(F.col("pos") / dw.SECTION)).alias("doc"), F.lpad(F.col("pos").cast("string"), 9, "0").alias("no"), turn.alias("turn"), F.col("para_id").alias("uuid"), F.col("para_id").alias("uuid_end"),
        quote.alias("violation_text"), F.lit("because").alias("violation_reason"), F.when(F.col("kind") == 1, "delete").when(F.col("kind") == 2, "manual").otherwise("replace").alias("fix_action"), new.alias("revised_text"), F.lit("grammar").alias("category"),
    ).withColumns({"doc_id": F.concat("doc", F.lit(".docx")), "item_id": F.concat_ws(".", "no", "turn")})


def _edited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _packages(spark, d).select(F.col("path").alias("doc_id"), "content")
    return ed.apply_edits(docs, _items(spark, d))


_AFTER = f"CASE {_KIND} WHEN 0 THEN 'changed ' || pos || substr(text, 13) WHEN 1 THEN substr(text, 13) WHEN 4 THEN 'changed ' || pos ELSE text END"


@Q.add(sql=f"WITH {_D} SELECT doc AS doc_id, para_id, {strip_sql(_AFTER)} AS text FROM o WHERE NOT is_table")
def edit_documents(spark: SparkSession, d: str) -> DataFrame:
    """Text after the tracked changes of all items, read back from the edited packages."""
    done = _edited(spark, d)[0].select(F.col("doc_id").alias("path"), "content")
    return dx.read_binary(done).filter("not is_table").select("doc_id", "para_id", "text")


@Q.add(
    sql=f"""WITH {_D}, k AS (SELECT doc, pos, {_KIND} AS kind FROM o), i AS (SELECT doc, pos, kind, unnest(CASE WHEN kind = 4 THEN [0, 1] ELSE [0] END) AS turn FROM k WHERE kind IN (0, 1, 2, 4))
SELECT doc AS doc_id, lpad(CAST(pos AS VARCHAR), 9, '0') || '.' || turn AS item_id, CASE WHEN turn = 1 THEN 'conflict' WHEN kind = 2 THEN 'commented' ELSE 'success' END AS status, true AS success, turn = 1 AS warning FROM i"""
)
def edit_results(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of each item; a second edit of the same text becomes a comment."""
    return _edited(spark, d)[1].drop("message")


@Q.add(sql=f"WITH {_D}, k AS (SELECT {_KIND} AS kind FROM o) SELECT count(*) FILTER (WHERE kind IN (0, 1, 2, 4)) AS succeeded, count(*) FILTER (WHERE kind = 4) AS warnings, CAST(0 AS BIGINT) AS failed FROM k")
def edit_summary(spark: SparkSession, d: str) -> DataFrame:
    """Items succeeded, with warnings, failed."""
    return ed.summary(_edited(spark, d)[1])


@Q.add(sql=f"WITH {_D} SELECT DISTINCT doc AS doc_id FROM o WHERE length(doc) % 2 = 1 OR doc LIKE '%42-%'")
def docx_changed(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose bytes are not those of their meta row, here falsified for some."""
    docs = _packages(spark, d)
    wrong = (F.length("source_file") % 2 == 1) | F.col("source_file").like("%42-%")
    meta = dx.sources(docs).select(F.col("source_file").alias("doc_id"), F.when(wrong, "sha256:0").otherwise(F.col("source_hash")).alias("source_hash"))
    return ed.verify_hashes(docs.withColumnRenamed("path", "doc_id"), meta)


_CELLS = "x AS (SELECT doc, n, para_id, para_id_end, from_json(text[8:-9], '[[\"VARCHAR\"]]') AS r, text FROM o WHERE is_table AND NOT contains(text, '\\'))"


def _tables(spark: SparkSession, d: str) -> DataFrame:
    t = st.current_paragraphs(table(spark, d, "paragraphs")).filter(r"is_table and not contains(text, '\\')")
    return t.withColumn("r", F.from_json(F.regexp_extract("text", "(?s)^<table>(.*)</table>$", 1), "array<array<string>>")).filter("size(r) > 1 and size(r[1]) > 1")


@Q.add(
    sql=f"""WITH {_D}, {_CELLS}
SELECT doc AS doc_id, n AS pos, '["' || array_to_string(r[2][:-2], '", "') || '", "' || CASE WHEN r[2][-1] = '' THEN '' ELSE 'changed ' || n END || '"]' AS second, '["' || array_to_string(r[1], '", "') || '"]' AS first, CAST(len(r) AS INTEGER) AS n_rows FROM x WHERE len(r) > 1 AND len(r[2]) > 1"""
)
def edit_tables(spark: SparkSession, d: str) -> DataFrame:
    """The last cell of the second row of every table changed by an item that quotes the row; an empty one belongs to the cell it is merged with and stays."""
    from vellora.functions import text as tx

    p = st.current_paragraphs(table(spark, d, "paragraphs"))
    place = p.withColumn("doc", F.concat_ws("-", "doc_id", F.floor(F.col("pos") / dw.SECTION))).groupBy("doc").agg(F.array_sort(F.collect_list("pos")).alias("order"))
    t = _tables(spark, d).withColumn("doc", F.concat_ws("-", "doc_id", F.floor(F.col("pos") / dw.SECTION))).join(place, "doc").withColumn("n", F.array_position("order", F.col("pos")) - 1)
    new = F.concat(F.slice(F.col("r")[1], F.lit(1), F.size(F.col("r")[1]) - 1), F.array(F.concat(F.lit("changed "), F.col("n").cast("string"))))
    items = t.select(
        F.concat("doc", F.lit(".docx")).alias("doc_id"), F.lpad(F.col("pos").cast("string"), 9, "0").alias("item_id"), F.col("para_id").alias("uuid"), F.col("para_id_end").alias("uuid_end"), tx.json_row(F.col("r")[1]).alias("violation_text"),
        F.lit("because").alias("violation_reason"), F.lit("replace").alias("fix_action"), tx.json_row(new).alias("revised_text"), F.lit("number").alias("category"),
    )
    done, _ = ed.apply_edits(_packages(spark, d).select(F.col("path").alias("doc_id"), "content"), items)
    back = dx.read_binary(done.select(F.col("doc_id").alias("path"), "content")).filter(r"is_table and not contains(text, '\\')")
    r = back.withColumn("r", F.from_json(F.regexp_extract("text", "(?s)^<table>(.*)</table>$", 1), "array<array<string>>")).filter("size(r) > 1 and size(r[1]) > 1")
    return r.select("doc_id", "pos", tx.json_row(F.col("r")[1]).alias("second"), tx.json_row(F.col("r")[0]).alias("first"), F.size("r").alias("n_rows"))


_NEXT = f"{_D}, w AS (SELECT *, lead(text) OVER (PARTITION BY doc ORDER BY pos) AS after, lead(is_table) OVER (PARTITION BY doc ORDER BY pos) AS after_table, lead(para_id) OVER (PARTITION BY doc ORDER BY pos) AS after_id FROM o), j AS (SELECT *, n % 9 = 0 AND NOT is_table AND after IS NOT NULL AND NOT after_table AND length(text) > 30 AND length(after) > 30 AS hit FROM w)"


@Q.add(
    sql=f"""WITH {_NEXT}, k AS (SELECT *, coalesce(lag(hit) OVER (PARTITION BY doc ORDER BY pos), false) AS behind FROM j)
SELECT doc AS doc_id, para_id, {strip_sql('CASE WHEN hit AND behind THEN substr(text, 13, length(text) - 24) WHEN hit THEN substr(text, 1, length(text) - 12) WHEN behind THEN substr(text, 13) ELSE text END')} AS text FROM k WHERE NOT is_table"""
)
def edit_across(spark: SparkSession, d: str) -> DataFrame:
    """The end of a paragraph and the beginning of the next deleted by one item, for every ninth place."""
    p = st.current_paragraphs(table(spark, d, "paragraphs")).withColumn("doc", F.concat_ws("-", "doc_id", F.floor(F.col("pos") / dw.SECTION)))
    w = Window.partitionBy("doc").orderBy("pos")  # a section, not a document
    j = p.withColumns({"n": F.row_number().over(w) - 1, "after": F.lead("text").over(w), "after_table": F.lead("is_table").over(w), "after_id": F.lead("para_id").over(w)})
    items = j.filter("n % 9 = 0 and not is_table and after is not null and not after_table and length(text) > 30 and length(after) > 30").select(
        F.concat("doc", F.lit(".docx")).alias("doc_id"), F.lpad(F.col("pos").cast("string"), 9, "0").alias("item_id"), F.col("para_id").alias("uuid"), F.col("after_id").alias("uuid_end"),
        F.concat(F.expr("right(text, 12)"), F.lit("\n"), F.substring("after", 1, 12)).alias("violation_text"), F.lit("because").alias("violation_reason"), F.lit("delete").alias("fix_action"), F.lit(None).cast("string").alias("revised_text"), F.lit("style").alias("category"),
    )
    done, _ = ed.apply_edits(_packages(spark, d).select(F.col("path").alias("doc_id"), "content"), items)
    return dx.read_binary(done.select(F.col("doc_id").alias("path"), "content")).filter("not is_table").select("doc_id", "para_id", "text")


_PLAIN = "regexp_replace(coalesce({}, ''), '(?i)</?(?:sup|sub)>', '', 'g')"


@Q.add(sql=f"SELECT item_id, {_PLAIN.format('any_value(violation_text)')} AS old, {_PLAIN.format('any_value(revised_text)')} AS new FROM edit_items GROUP BY item_id")
def edit_differences(spark: SparkSession, d: str) -> DataFrame:
    """What is kept and deleted gives the old text of every item, what is kept and inserted the new one."""
    i = table(spark, d, "edit_items").dropDuplicates(["item_id"]).select("item_id", ed.diff_ops("violation_text", "revised_text").alias("ops"))
    side = lambda op: F.array_join(F.transform(F.filter("ops", lambda x: x["op"] != op), lambda x: x["text"]), "")
    return i.select("item_id", side("insert").alias("old"), side("delete").alias("new"))


_RUNS = f"""{_P}, r AS (SELECT doc_id, pos AS para, CAST(k AS INTEGER) AS run_no, CAST(k * 40 AS INTEGER) AS start_off, CAST(least(k * 40 + 40, length(text)) AS INTEGER) AS end_off, CASE WHEN k % 3 = 1 THEN 'ins' END AS revision FROM (SELECT *, unnest(range(CAST(ceil(length(text) / 40.0) AS BIGINT))) AS k FROM p)),
m AS (SELECT doc_id, pos AS para, 10 AS m_start, CASE WHEN pos % 2 = 0 THEN 30 ELSE 95 END AS m_end FROM p WHERE length(text) >= 100)"""


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = st.current_paragraphs(table(spark, d, "paragraphs")).withColumn("n", F.length("text"))
    k = p.select("doc_id", F.col("pos").alias("para"), "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / 40).cast("int") - 1)).alias("run_no"))
    runs = k.select("doc_id", "para", "run_no", (F.col("run_no") * 40).alias("start_off"), F.least(F.col("run_no") * 40 + 40, "n").alias("end_off"), F.when(F.col("run_no") % 3 == 1, "ins").alias("revision"), F.lit(0).alias("cell"))
    matches = p.filter("n >= 100").select("doc_id", F.col("pos").alias("para"), F.lit(10).alias("m_start"), F.when(F.col("pos") % 2 == 0, 30).otherwise(95).alias("m_end"))
    return runs, matches


@Q.add(sql=f"WITH {_RUNS} SELECT doc_id, para, run_no, greatest(start_off, m_start) AS from_off, least(end_off, m_end) AS to_off FROM m JOIN r USING (doc_id, para) WHERE end_off > m_start AND start_off < m_end")
def match_runs(spark: SparkSession, d: str) -> DataFrame:
    """The parts of runs a match touches."""
    runs, matches = _runs(spark, d)
    return mt.overlapping(runs.drop("cell"), matches).select("doc_id", "para", "run_no", "from_off", "to_off")


@Q.add(sql=f"WITH {_RUNS} SELECT DISTINCT doc_id, para FROM m JOIN r USING (doc_id, para) WHERE revision IS NOT NULL AND end_off > m_start AND start_off < m_end")
def match_revised(spark: SparkSession, d: str) -> DataFrame:
    """matches that touch an earlier change."""
    runs, matches = _runs(spark, d)
    return mt.revised_overlap(runs.drop("cell"), matches).select("doc_id", "para")


@Q.add(sql=f"WITH {_RUNS} SELECT doc_id, para, run_no FROM r WHERE run_no % 4 <> 0 AND run_no % 5 <> 1")
def match_real_runs(spark: SparkSession, d: str) -> DataFrame:
    """runs without those that stand for a drawing or an equation."""
    runs = _runs(spark, d)[0].withColumns({"is_drawing": F.col("run_no") % 4 == 0, "is_equation": F.when(F.col("run_no") % 5 == 1, True)})
    return mt.real_runs(runs).select("doc_id", "para", "run_no")


@Q.add(sql=f"WITH {_RUNS} SELECT doc_id, para, 0 AS cell, min(start_off) AS start_off, max(end_off) AS end_off, count(*) AS n_runs FROM r GROUP BY doc_id, para")
def match_segments(spark: SparkSession, d: str) -> DataFrame:
    """A10: extent and number of runs of each paragraph."""
    return mt.paragraph_segments(_runs(spark, d)[0])
