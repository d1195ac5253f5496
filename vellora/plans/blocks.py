"""Queries of document structure and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellora.functions import text as tx
from vellora.operators import chunking as ch
from vellora.operators import structure as st
from vellora.plans.registry import Registry
from vellora.plans.texts import WS, est_sql
from vellora.session import table

Q = Registry()

_P = f"""p AS (SELECT doc_id, pos, any_value(text) AS text, any_value(para_id) AS para_id, any_value(para_id_end) AS para_id_end, any_value(is_table) AS is_table, any_value(level) AS level
FROM paragraphs WHERE deleted_at IS NULL AND text IS NOT NULL AND regexp_replace(text, '{WS}+', '', 'g') <> '' GROUP BY doc_id, pos)"""


def _numbered(test: str) -> str:
    return f"""{_P},
a AS (SELECT *, coalesce({test}, false) AS is_split FROM p),
l AS (SELECT *, lag(is_split) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM a),
b AS (SELECT *, CAST(sum(CASE WHEN is_split AND NOT prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS INTEGER) AS block_no FROM l)"""


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return st.current_paragraphs(table(spark, d, "paragraphs"))


@Q.add(sql=f"WITH {_P} SELECT doc_id, pos, CAST(coalesce(sum({est_sql('text')}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS token_pos FROM p")
def struct_token_position(spark: SparkSession, d: str) -> DataFrame:
    """Token position of every paragraph."""
    return st.prefix_sum(_paragraphs(spark, d), "doc_id", ["pos"], tx.estimate_tokens(F.col("text")), "token_pos", size=16).select("doc_id", "pos", "token_pos")


def _blocks_sql(test: str) -> str:
    return f"""WITH {_numbered(test)},
t AS (SELECT doc_id, block_no, string_agg(text, chr(10) ORDER BY pos) AS content, arg_min(para_id, pos) AS uuid, arg_max(coalesce(para_id_end, para_id), pos) AS uuid_end,
  arg_min(text, pos) AS first_text, arg_min(level, pos) AS first_level, arg_min(is_split, pos) AS headed FROM b GROUP BY doc_id, block_no)
SELECT doc_id, block_no, uuid, uuid_end, CASE WHEN headed THEN first_text ELSE '{st.PREFACE}' END AS heading, CASE WHEN headed THEN first_level ELSE 1 END AS level, content, {est_sql('content')} AS tokens FROM t"""


@Q.add(sql=_blocks_sql("level IS NOT NULL"))
def struct_heading_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks by headings."""
    return st.unsplit_blocks(_paragraphs(spark, d), size=16).select("doc_id", "block_no", "uuid", "uuid_end", "heading", "level", "content", "tokens")


@Q.add(sql=_blocks_sql("level <= 1"))
def struct_fixlevel_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks at headings of level 1 only."""
    return st.unsplit_blocks(_paragraphs(spark, d), 1).select("doc_id", "block_no", "uuid", "uuid_end", "heading", "level", "content", "tokens")


_MAX = "(SELECT max(h2.pos) FROM h h2 WHERE h2.doc_id = h.doc_id AND h2.pos < h.pos AND h2.level {})"


@Q.add(
    sql=f"""WITH {_P}, h AS (SELECT doc_id, pos, text, level FROM p WHERE level IS NOT NULL),
o AS (SELECT h.doc_id, h.pos, a.text AS up, a.level AS up_level FROM h JOIN h a ON a.doc_id = h.doc_id AND a.pos < h.pos AND a.level < h.level
  WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.doc_id = h.doc_id AND c.pos > a.pos AND c.pos < h.pos AND c.level <= a.level))
SELECT h.doc_id, h.pos, coalesce(string_agg(o.up, ' / ' ORDER BY o.up_level), '') AS parents FROM h LEFT JOIN o ON o.doc_id = h.doc_id AND o.pos = h.pos GROUP BY h.doc_id, h.pos"""
)
def struct_parent_headings(spark: SparkSession, d: str) -> DataFrame:
    """Open headings above each heading."""
    h = _paragraphs(spark, d).filter("level is not null").select("doc_id", "pos", "text", "level")
    return st.parent_headings(h, size=32).select("doc_id", "pos", F.array_join("parent_headings", " / ").alias("parents"))


_BIG = "(SELECT doc_id, pos, list_transform(flatten(list_transform(range(60), lambda k: r)), lambda x: x) AS r FROM (SELECT DISTINCT doc_id, pos, list_transform(from_json(text[8:-9], '[[\"VARCHAR\"]]'), lambda row: '[\"' || array_to_string(row, '\", \"') || '\"]') AS r FROM paragraphs WHERE is_table AND text LIKE '<table>[[%]]</table>' AND NOT contains(text, '\\')))"


def _slice_sql(a: str, b: str) -> str:
    return f"('[' || array_to_string(r[{a} + 1:{b}], ', ') || ']')"


@Q.add(
    sql=f"""WITH t AS (SELECT *, len(r) AS n FROM {_BIG}), s AS (SELECT *, {est_sql(_slice_sql('0', 'n'))} AS total FROM t),
p AS (SELECT *, CASE WHEN total <= 5000 THEN 1 ELSE greatest(CAST(ceil(total / 3000) AS BIGINT), CAST(ceil(total / 5000) AS BIGINT)) END AS parts FROM s),
b AS (SELECT *, list_filter(list_transform(range(1, parts), lambda k: CAST(floor(k * (n / parts)) AS BIGINT)), lambda x: x > 0 AND n - x >= 0.3 * n / parts) AS inner_ FROM p),
c AS (SELECT *, CASE WHEN len(inner_) > 0 AND {est_sql(_slice_sql('inner_[-1]', 'n'))} < 1600 AND {est_sql(_slice_sql('coalesce(inner_[-2], 0)', 'n'))} <= 5000 THEN inner_[:-2] ELSE inner_ END AS cuts FROM b),
e AS (SELECT doc_id, pos, r, list_concat([0], cuts, [n]) AS borders FROM c),
k AS (SELECT *, unnest(range(len(borders) - 1)) AS chunk_no FROM e)
SELECT doc_id, pos, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(borders[chunk_no + 1] AS INTEGER) AS start, CAST(borders[chunk_no + 2] AS INTEGER) AS "end", md5({_slice_sql('borders[chunk_no + 1]', 'borders[chunk_no + 2]')}) AS json FROM k"""
)
def chunk_tables(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the table paragraphs, their rows sixty times over, so that they are as large as tables that need it."""
    t = _all_tables(spark, d).select("doc_id", "pos", F.flatten(F.array_repeat("r", 60)).alias("r"))
    c = t.select("doc_id", "pos", ch.table_chunks(tx.json_table(F.col("r"))).alias("c"))
    return c.select("doc_id", "pos", F.posexplode("c").alias("chunk_no", "x")).select("doc_id", "pos", "chunk_no", "x.start", "x.end", F.md5("x.json").alias("json"))


def _all_tables(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "paragraphs").filter(r"is_table and text like '<table>[[%]]</table>' and not contains(text, '\\')")
    return t.select("doc_id", "pos", F.from_json(F.expr("substring(text, 8, length(text) - 15)"), "array<array<string>>").alias("r")).distinct()


@Q.add(
    sql=f"""WITH {_numbered('level IS NOT NULL')}, t AS (SELECT doc_id, block_no, {est_sql("string_agg(text, chr(10) ORDER BY pos)")} AS tokens, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM b GROUP BY doc_id, block_no)
SELECT doc_id, block_no, first_pos, last_pos, n FROM t WHERE tokens > 8000"""
)
def chunk_split_long(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each long block cover its paragraphs once and without a gap."""
    p = st.number_blocks(_paragraphs(spark, d))
    cut = ch.split_long(p, st.unsplit_blocks(p))
    in_piece = p.join(cut.select("doc_id", "block_no", "first_pos", "last_pos"), ["doc_id", "block_no"]).filter("pos between first_pos and last_pos")
    return in_piece.groupBy("doc_id", "block_no").agg(F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.count("*").alias("n"))


@Q.add(
    sql=f"""WITH {_numbered('level IS NOT NULL')}, t AS (SELECT doc_id, block_no, {est_sql("string_agg(text, chr(10) ORDER BY pos)")} AS tokens, min(pos) AS first_pos FROM b GROUP BY doc_id, block_no),
g AS (SELECT b.*, t.tokens, t.first_pos, coalesce(sum({est_sql('b.text')}) OVER (PARTITION BY b.doc_id, b.block_no ORDER BY b.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tp FROM b JOIN t ON t.doc_id = b.doc_id AND t.block_no = b.block_no WHERE t.tokens > 1000 AND t.tokens <= 1500),
y AS (SELECT doc_id, block_no, arg_min(pos, (abs(tp - tokens / 2), pos)) AS border FROM g WHERE NOT is_table AND length(text) <= 100 GROUP BY doc_id, block_no),
h AS (SELECT g.doc_id, g.block_no, a.border, any_value(g.first_pos) AS first_pos, {est_sql("coalesce(string_agg(g.text, chr(10) ORDER BY g.pos) FILTER (WHERE g.pos < a.border), '')")} AS one, {est_sql("string_agg(g.text, chr(10) ORDER BY g.pos) FILTER (WHERE g.pos >= a.border)")} AS two FROM g JOIN y a ON a.doc_id = g.doc_id AND a.block_no = g.block_no GROUP BY g.doc_id, g.block_no, a.border)
SELECT doc_id, block_no, border FROM h WHERE border > first_pos AND one <= 1000 AND two <= 1000"""
)
def chunk_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Where blocks of two parts are cut: at the anchor nearest to the middle (at an eighth of the real sizes, where there are many)."""
    p = st.number_blocks(_paragraphs(spark, d))
    b = st.unsplit_blocks(p)
    cut = ch.split_long(p, b.filter("tokens <= 1500"), 750, 1000)
    where = (F.col("p.doc_id") == F.col("c.doc_id")) & (F.col("p.block_no") == F.col("c.block_no")) & F.col("p.pos").between(F.col("c.first_pos"), F.col("c.last_pos"))
    pieces = st.assemble(p.alias("p").join(cut.alias("c"), where).select("p.*", "c.piece_no", "c.first_pos"), ["doc_id", "block_no", "piece_no", "first_pos"], ["pos"])
    two = pieces.groupBy("doc_id", "block_no").agg(F.count("*").alias("n"), F.max("first_pos").alias("border"), F.max(tx.estimate_tokens(F.col("content"))).alias("most")).filter("n = 2 and most <= 1000")
    return two.select("doc_id", "block_no", "border")


@Q.add()
def chunk_merge_small(spark: SparkSession, d: str) -> DataFrame:
    """Small blocks merged."""
    b = st.unsplit_blocks(_paragraphs(spark, d)).withColumns({"table_chunk_role": F.lit("none"), "table_header": F.lit(None).cast("array<array<string>>")})
    return ch.merge_small(b)


@Q.add()
def chunk_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs to token-bounded blocks."""
    return ch.build_blocks(_paragraphs(spark, d))


_WHOLE = f"WITH {_numbered('level IS NOT NULL')}, t AS (SELECT doc_id, block_no, string_agg(text, chr(10) ORDER BY pos) AS content FROM b GROUP BY doc_id, block_no) SELECT doc_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY block_no)) AS text, count(*) AS n_blocks, true AS fits FROM t GROUP BY doc_id"


@Q.add(sql=_WHOLE)
def chunk_merged_text(spark: SparkSession, d: str) -> DataFrame:
    """Merged blocks give the text of their documents back, and none grew above the limit by merging."""
    m = chunk_merge_small(spark, d)
    per = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "content"))), lambda x: x["content"]), "\n\n")
    return m.groupBy("doc_id").agg(F.md5(per).alias("text"), F.sum("n_merged").alias("n_blocks"), F.bool_and((F.col("tokens") <= ch.LIMIT) | (F.col("n_merged") == 1)).alias("fits"))


@Q.add(sql=f"WITH {_P} SELECT doc_id, md5(replace(string_agg(replace(text, chr(10), ''), '' ORDER BY pos), ']]</table><table>[[', '], [')) AS text, true AS counted FROM p GROUP BY doc_id")
def chunk_block_text(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of a document hold all its paragraphs in order, numbered from 0 without a gap."""
    b = chunk_blocks(spark, d)
    per = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "content"))), lambda x: F.replace(x["content"], F.lit("\n"), F.lit(""))), "")
    whole = F.replace(per, F.lit("]]</table><table>[["), F.lit("], ["))  # chunks of a table, put together again
    return b.groupBy("doc_id").agg(F.md5(whole).alias("text"), (F.max("block_idx") + 1 == F.count("*")).alias("counted"))


_FULL = "floor(((f.c + i.c) * CAST(0.75 AS DOUBLE) + (f.j + i.j) * CAST(1 AS DOUBLE) + (f.o + i.o) * CAST(0.4 AS DOUBLE)) * CAST(1.05 AS DOUBLE)) + 2 > 2000"
_CLASSES = "length(regexp_replace(violation_text, '[^一-龥]', '', 'g')) AS c, length(regexp_replace(violation_text, '[^\\[\\]\",{}]', '', 'g')) AS j, length(regexp_replace(violation_text, '[一-龥\\[\\]\",{}]', '', 'g')) AS o"


@Q.add(
    sql=f"""WITH RECURSIVE i AS (SELECT rule_id, item_id, {_CLASSES}, row_number() OVER (PARTITION BY rule_id ORDER BY item_id) AS k
  FROM (SELECT DISTINCT item_id, rule_id, violation_text FROM edit_items WHERE rule_id IS NOT NULL AND violation_text IS NOT NULL)),
f AS (SELECT rule_id, item_id, k, c, j, o, 0 AS chunk_no FROM i WHERE k = 1
  UNION ALL SELECT i.rule_id, i.item_id, i.k, CASE WHEN {_FULL} THEN i.c ELSE f.c + i.c END, CASE WHEN {_FULL} THEN i.j ELSE f.j + i.j END, CASE WHEN {_FULL} THEN i.o ELSE f.o + i.o END,
  CASE WHEN {_FULL} THEN f.chunk_no + 1 ELSE f.chunk_no END FROM f JOIN i ON i.rule_id = f.rule_id AND i.k = f.k + 1)
SELECT rule_id, item_id, CAST(chunk_no AS INTEGER) AS chunk_no FROM f"""
)
def chunk_pack_items(spark: SparkSession, d: str) -> DataFrame:
    """All items packed per rule by token budget, each class of characters with its weight."""
    i = table(spark, d, "edit_items").filter("rule_id is not null and violation_text is not null").select("rule_id", "item_id", "violation_text").distinct()
    i = ch.with_counts(i, "violation_text").drop("violation_text")
    return ch.pack_by_budget(i, "rule_id", ["item_id"], ["n_cjk", "n_json", "n_other"], 2000, per_item=(0, 0, 0)).select("rule_id", "item_id", "chunk_no")
