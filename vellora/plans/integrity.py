"""Queries p1 (orphan references) and p2 (nested records to flat tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellora.operators import flatten as fl
from vellora.operators import references as rf
from vellora.plans.registry import Registry
from vellora.session import table

Q = Registry()


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return rf.references(table(spark, d, "edit_items"), "item_id", ["uuid", "uuid_end"], "doc_id", "exported_at")


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return rf.parents(table(spark, d, "paragraphs"), ["para_id", "para_id_end"], "doc_id", "loaded_at", "deleted_at")


#: Outer blanks of a reference as SQL sees them: Unicode white space.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
_REFS_SQL = f"""
r AS (SELECT DISTINCT item_id, ref_field, doc_id, upper(trim(v, {_BLANKS})) AS ref, exported_at AS used_at FROM (
        SELECT item_id, doc_id, exported_at, 'uuid' AS ref_field, uuid AS v FROM edit_items
        UNION ALL SELECT item_id, doc_id, exported_at, 'uuid_end', uuid_end FROM edit_items)
      WHERE trim(v, {_BLANKS}) <> ''),
p AS (SELECT DISTINCT doc_id, upper(k) AS ref, loaded_at, deleted_at FROM (
        SELECT doc_id, para_id AS k, loaded_at, deleted_at FROM paragraphs
        UNION ALL SELECT doc_id, para_id_end, loaded_at, deleted_at FROM paragraphs)
      WHERE k IS NOT NULL),
x AS (SELECT r.*, EXISTS (SELECT 1 FROM p WHERE p.doc_id = r.doc_id AND p.ref = r.ref AND p.loaded_at <= r.used_at
        AND (p.deleted_at IS NULL OR r.used_at < p.deleted_at)) AS there FROM r)"""


@Q.add(sql=f"WITH {_REFS_SQL} SELECT item_id, ref_field FROM x WHERE NOT there")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """References of edit items that name no paragraph of their document existing at export."""
    return rf.orphans(_refs(spark, d), _parents(spark, d)).select("item_id", "ref_field")


@Q.add(
    sql=f"""WITH {_REFS_SQL}, f AS (SELECT doc_id, ref, min(loaded_at) AS t FROM p GROUP BY ALL)
SELECT item_id, ref_field, ref, CASE WHEN t IS NULL THEN 'missing' WHEN used_at < t THEN 'arrives_later' ELSE 'withdrawn' END AS reason
FROM x LEFT JOIN f USING (doc_id, ref) WHERE NOT there"""
)
def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The same references with the reason."""
    p = _parents(spark, d)
    return rf.explain_orphans(rf.orphans(_refs(spark, d), p), p).select("item_id", "ref_field", "ref", "reason")


@Q.add(
    sql=f"""WITH {_REFS_SQL} SELECT 'edit_items' AS table_name, ref_field, date_trunc('month', used_at) AS period, count(*) AS refs,
count(*) FILTER (WHERE NOT there) AS orphan_refs, count(DISTINCT (doc_id, ref)) FILTER (WHERE NOT there) AS orphan_keys
FROM x GROUP BY ref_field, date_trunc('month', used_at)"""
)
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field and month of export."""
    return rf.orphan_report(_refs(spark, d), _parents(spark, d)).select("table_name", "ref_field", F.col("period").cast("timestamp_ntz").alias("period"), "refs", "orphan_refs", "orphan_keys")


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "manifest").select(F.col("entry_id").cast("string").alias("parent_key"), "violations")
    return fl.flatten(t, ["parent_key"], ["violations"], ["child_no"]).withColumn("entry_no", F.lit(0))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "manifest_raw").select(F.col("line_id").cast("string").alias("parent_key"), "raw")
    return fl.flatten(fl.parse_lines(t, "raw"), ["parent_key"], ["entries", "violations"], ["entry_no", "child_no"])


def _headings(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "blocks").select(F.concat_ws("#", F.coalesce("doc_id", F.lit("")), F.coalesce(F.col("block_idx").cast("string"), F.lit(""))).alias("parent_key"), "parent_headings")
    flat = fl.flatten(t, ["parent_key"], ["parent_headings"], ["child_no"]).withColumn("entry_no", F.lit(0))
    return flat.filter(F.col("value").rlike(r"(?U)\S"))


_KEYS = ["parent_key", "entry_no", "child_no"]


_FIELDS = ("rule_id", "uuid", "uuid_end", "violation_text", "violation_reason", "fix_action", "revised_text", "category")
_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN from_json({0}, '[\"JSON\"]') WHEN 'OBJECT' THEN [{0}] ELSE [] END"
_SINGLE = " OR ".join(f"list_contains(json_keys(a), '{f}')" for f in _FIELDS)
# the same shapes by the JSON functions of the SQL engine
_RAW_SQL = f"""j AS (SELECT DISTINCT line_id, raw::JSON AS j FROM manifest_raw WHERE json_valid(raw)),
e AS (SELECT line_id, CASE WHEN json_type(j) = 'ARRAY' THEN {_LIST.format('j')} WHEN json_type(j) <> 'OBJECT' THEN [] WHEN json_exists(j, '$.entries') THEN {_LIST.format("json_extract(j, '$.entries')")}
  WHEN json_exists(j, '$.entry') THEN [json_extract(j, '$.entry')] WHEN coalesce(j ->> '$.type', '') <> 'meta' THEN [j] ELSE [] END AS es FROM j),
n AS (SELECT line_id, CAST(unnest(range(len(es))) AS INTEGER) AS entry_no, unnest(es) AS e FROM e),
a0 AS (SELECT line_id, entry_no, json_extract(e, '$.violations') AS b FROM n WHERE json_type(e) = 'OBJECT'),
a AS (SELECT line_id, entry_no, CASE WHEN json_type(b) = 'VARCHAR' AND json_valid(b ->> '$') THEN (b ->> '$')::JSON ELSE b END AS a FROM a0),
w AS (SELECT line_id, entry_no, CASE WHEN json_type(a) = 'ARRAY' THEN list_transform({_LIST.format('a')}, lambda x: {{'rule': NULL::VARCHAR, 'x': x}})
  WHEN json_type(a) <> 'OBJECT' THEN [] WHEN json_exists(a, '$.items') THEN list_transform({_LIST.format("json_extract(a, '$.items')")}, lambda x: {{'rule': NULL::VARCHAR, 'x': x}})
  WHEN {_SINGLE} THEN [{{'rule': NULL::VARCHAR, 'x': a}}]
  ELSE flatten(list_transform(json_keys(a), lambda k: list_transform({_LIST.format("json_extract(a, '$.' || chr(34) || k || chr(34))")}, lambda x: {{'rule': k, 'x': x}}))) END AS vs FROM a WHERE a IS NOT NULL),
c AS (SELECT line_id, entry_no, CAST(unnest(range(len(vs))) AS INTEGER) AS child_no, unnest(vs) AS v FROM w),
raw_ AS (SELECT CAST(line_id AS VARCHAR) AS parent_key, entry_no, child_no, coalesce(v.x ->> '$.rule_id', CASE WHEN v.rule <> 'unknown' THEN v.rule END) AS rule_id, {", ".join(f"v.x ->> '$.{f}' AS {f}" for f in _FIELDS[1:])} FROM c WHERE json_type(v.x) = 'OBJECT')"""
_MANIFEST_SQL = "SELECT DISTINCT CAST(entry_id AS VARCHAR) AS parent_key, CAST(unnest(range(len(violations))) AS INTEGER) AS child_no, unnest(violations) AS v FROM manifest"
_HEADING_SQL = "SELECT DISTINCT doc_id || '#' || CAST(block_idx AS VARCHAR) AS parent_key, CAST(unnest(range(len(parent_headings))) AS INTEGER) AS child_no, unnest(parent_headings) AS heading FROM blocks"


@Q.add(
    sql=f"""WITH {_RAW_SQL} SELECT DISTINCT 'manifest_raw' AS src, parent_key, entry_no, child_no FROM raw_
UNION ALL SELECT 'manifest', parent_key, 0, child_no FROM ({_MANIFEST_SQL}) WHERE v IS NOT NULL
UNION ALL SELECT DISTINCT 'blocks', parent_key, 0, child_no FROM ({_HEADING_SQL}) WHERE trim(heading, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) <> ''"""
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every violation and parent heading with its parent and place."""
    parts = [f(spark, d).select(F.lit(src).alias("src"), *_KEYS) for src, f in (("manifest", _manifest), ("manifest_raw", _raw), ("blocks", _headings))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@Q.add(
    sql="""SELECT parent_key, child_no, v.rule_id, v.uuid, v.uuid_end, v.violation_text, v.fix_action FROM (
SELECT DISTINCT CAST(entry_id AS VARCHAR) AS parent_key, CAST(unnest(range(len(violations))) AS INTEGER) AS child_no, unnest(violations) AS v FROM manifest)
WHERE v IS NOT NULL"""
)
def p2_manifest_violations(spark: SparkSession, d: str) -> DataFrame:
    """The violations of manifest as a flat table."""
    return _manifest(spark, d).select("parent_key", "child_no", "rule_id", "uuid", "uuid_end", "violation_text", "fix_action").distinct()


@Q.add(sql=f"WITH {_RAW_SQL} SELECT * FROM raw_")
def p2_raw_violations(spark: SparkSession, d: str) -> DataFrame:
    """The violations of the raw lines as a flat table."""
    return _raw(spark, d).dropDuplicates(_KEYS)


@Q.add(
    sql="""SELECT DISTINCT parent_key, child_no, heading FROM (
SELECT doc_id || '#' || CAST(block_idx AS VARCHAR) AS parent_key, CAST(unnest(range(len(parent_headings))) AS INTEGER) AS child_no, unnest(parent_headings) AS heading FROM blocks)
WHERE trim(heading, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) <> ''"""
)
def p2_parent_headings(spark: SparkSession, d: str) -> DataFrame:
    """The parent headings of blocks as a flat table."""
    return _headings(spark, d).select("parent_key", "child_no", F.col("value").alias("heading")).distinct()
