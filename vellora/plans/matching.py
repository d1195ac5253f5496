"""Queries of quote location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellora.operators import match as mt
from vellora.operators import structure as st
from vellora.plans.blocks import _P
from vellora.plans.registry import Registry
from vellora.plans.texts import AUTO, WS
from vellora.session import table

Q = Registry()

_RANGES = f"""{_P}, i AS (SELECT item_id, any_value(doc_id) AS doc_id, upper(trim(any_value(uuid), ' ' || chr(9))) AS u, upper(trim(any_value(uuid_end), ' ' || chr(9))) AS e, any_value(violation_text) AS q FROM edit_items GROUP BY item_id),
s AS (SELECT i.item_id, i.doc_id, i.e, i.q, min(p.pos) AS start_pos FROM i JOIN p ON p.doc_id = i.doc_id AND p.para_id = i.u GROUP BY ALL),
s2 AS (SELECT s.*, p.is_table AS in_table FROM s JOIN p ON p.doc_id = s.doc_id AND p.pos = s.start_pos),
g AS (SELECT item_id, s2.doc_id, start_pos, in_table, q, CASE WHEN in_table THEN max(p.pos) ELSE min(p.pos) END AS end_pos
 FROM s2 LEFT JOIN p ON p.doc_id = s2.doc_id AND (p.para_id = s2.e OR p.para_id_end = s2.e) AND p.pos >= s2.start_pos GROUP BY item_id, s2.doc_id, start_pos, in_table, q)"""


@Q.add(sql=f"WITH {_RANGES} SELECT item_id, doc_id, start_pos, end_pos, in_table FROM g")
def match_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of paragraphs the items name."""
    return mt.ranges(table(spark, d, "edit_items").dropDuplicates(["item_id"]), st.current_paragraphs(table(spark, d, "paragraphs")))


@Q.add(sql=f"WITH {_RANGES} SELECT DISTINCT g.item_id, g.doc_id, p.pos FROM g JOIN p ON p.doc_id = g.doc_id AND p.is_table AND p.pos >= g.start_pos AND (g.end_pos IS NULL OR p.pos <= g.end_pos)")
def match_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables touched by the ranges."""
    p = st.current_paragraphs(table(spark, d, "paragraphs"))
    return mt.tables_in_range(mt.ranges(table(spark, d, "edit_items").dropDuplicates(["item_id"]), p), p)


@Q.add(
    sql=f"""WITH {_RANGES}, h AS (SELECT g.item_id, p.pos, strpos(p.text, g.q) - 1 AS off FROM g JOIN p ON p.doc_id = g.doc_id AND p.pos >= g.start_pos AND (g.end_pos IS NULL OR p.pos <= g.end_pos) WHERE g.q <> '' AND strpos(p.text, g.q) > 0)
SELECT item_id, CAST(min(pos) AS BIGINT) AS pos, CAST(arg_min(off, pos) AS INTEGER) AS "offset" FROM h GROUP BY item_id"""
)
def match_exact(spark: SparkSession, d: str) -> DataFrame:
    """M01 rank 1, L05: first literal place of each quote in its range."""
    return mt.locate(table(spark, d, "edit_items"), st.present_paragraphs(table(spark, d, "paragraphs")), upto=1).filter("rank = 1").select("item_id", "pos", "offset")


@Q.add(
    sql=f"""WITH {_RANGES}, q AS (SELECT g.*, regexp_replace(q, '{WS}+$', '') AS q2, regexp_replace(q, '{AUTO}', '') AS q3, regexp_replace(q, '(?i)</?(?:sup|sub)>', '', 'g') AS q7 FROM g),
c AS (SELECT q.*, p.pos, p.text AS t FROM q JOIN p ON p.doc_id = q.doc_id AND p.pos >= q.start_pos AND (q.end_pos IS NULL OR p.pos <= q.end_pos) WHERE q.q <> ''),
h AS (SELECT item_id, pos, CASE WHEN contains(t, q) THEN {{'rank': 1, 'at': strpos(t, q)}} WHEN q2 <> '' AND contains(regexp_replace(t, '{WS}+$', ''), q2) THEN {{'rank': 2, 'at': strpos(t, q2)}} WHEN q3 <> '' AND q3 <> q AND contains(t, q3) THEN {{'rank': 3, 'at': strpos(t, q3)}}
 WHEN q7 <> '' AND contains(regexp_replace(t, '(?i)</?(?:sup|sub)>', '', 'g'), q7) THEN {{'rank': 7, 'at': strpos(regexp_replace(t, '(?i)</?(?:sup|sub)>', '', 'g'), q7)}} END AS h FROM c),
m AS (SELECT item_id, min((h.rank, pos, h.at - 1)) AS m FROM h WHERE h IS NOT NULL GROUP BY item_id), a AS (SELECT item_id, any_value(doc_id) AS doc_id FROM edit_items GROUP BY item_id)
SELECT a.item_id, a.doc_id, CASE WHEN g.item_id IS NULL THEN 'no_anchor' WHEN m.m IS NULL THEN 'not_found' ELSE 'found' END AS status, CAST(m.m[1] AS INTEGER) AS rank, m.m[2] AS pos, CAST(m.m[3] AS INTEGER) AS "offset"
FROM a LEFT JOIN g ON g.item_id = a.item_id LEFT JOIN m ON m.item_id = a.item_id"""
)
def match_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Place, rank and status of each quote; the quotes here are of one line and none is of table rows, so the SQL has ranks 1, 2, 3 and 7."""
    return mt.locate(table(spark, d, "edit_items").drop("fix_action"), st.present_paragraphs(table(spark, d, "paragraphs")))


@Q.add(
    sql=f"""WITH {_P}, t AS (SELECT doc_id, pos, from_json(text[8:-9], '[["VARCHAR"]]') AS r FROM p WHERE is_table AND NOT contains(text, '\\')),
rows_ AS (SELECT doc_id, pos, i, r[i + 1] AS c FROM (SELECT *, unnest(range(len(r))) AS i FROM t)), l AS (SELECT *, length('["' || array_to_string(c, '", "') || '"]') AS n FROM rows_),
s AS (SELECT *, coalesce(sum(n + 2) OVER (PARTITION BY doc_id, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l), k AS (SELECT *, unnest(range(len(c))) AS j FROM s)
SELECT doc_id, pos, CAST(i AS INTEGER) AS row, CAST(j AS INTEGER) AS col, c[j + 1] AS cell, CAST(start + 2 + length(array_to_string(c[:j], '", "')) + CASE WHEN j > 0 THEN 4 ELSE 0 END AS INTEGER) AS "at" FROM k"""
)
def match_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of all tables with the place of their text in the table's rows."""
    return mt.table_cells(st.current_paragraphs(table(spark, d, "paragraphs")).filter(r"not contains(text, '\\')"))
