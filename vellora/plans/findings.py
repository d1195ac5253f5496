"""Queries of rules, manifest, report and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellora.functions import text as tx
from vellora.operators import audit as au
from vellora.operators import global_audit as ga
from vellora.operators import manifest as mf
from vellora.operators import report as rp
from vellora.operators import rules as rl
from vellora.plans.registry import Registry
from vellora.plans.texts import est_sql
from vellora.session import table
from vellora.sources import jsonl as jl

Q = Registry()

_M = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY entry_id) AS k FROM manifest) WHERE k = 1)"
_R = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY id) AS k FROM audit_rules) WHERE k = 1)"
_V = f"""{_M}, v0 AS (SELECT entry_id, doc_id, uuid AS e_uuid, uuid_end AS e_end, p_heading, p_content, is_violation, unnest(violations) AS v, unnest(range(len(violations))) AS no FROM m),
v AS (SELECT * FROM v0 WHERE v IS NOT NULL)"""
_ROWS = f"""{_V}, rows_ AS (SELECT entry_id, CAST(no AS INTEGER) AS violation_no, doc_id, coalesce(e_uuid, '') AS uuid, coalesce(v.uuid_end, e_end, '') AS uuid_end, coalesce(e_uuid, '') || '|' || coalesce(v.uuid_end, e_end, '') AS source_id,
coalesce(p_heading, '') AS heading, coalesce(v.category, 'other') AS category, coalesce(v.rule_id, '') AS rule_id, coalesce(v.violation_text, '') AS violation_text, coalesce(v.violation_reason, '') AS violation_reason,
coalesce(v.fix_action, 'manual') AS fix_action, coalesce(v.revised_text, '') AS revised_text FROM v WHERE is_violation)"""


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audit_rules").dropDuplicates(["id"])


@Q.add(sql=f"WITH {_ROWS} SELECT * FROM rows_")
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Report rows with defaults."""
    return rp.report_rows(table(spark, d, "manifest"))


@Q.add(sql=f"WITH {_ROWS} SELECT category, count(*) AS n FROM rows_ GROUP BY category")
def report_categories(spark: SparkSession, d: str) -> DataFrame:
    """Findings per category."""
    return rp.by_category(rp.report_rows(table(spark, d, "manifest")))


@Q.add(sql=f"WITH {_ROWS}, c AS (SELECT count(*) AS n FROM rows_ GROUP BY category) SELECT (SELECT count(*) FROM m) AS total_blocks, coalesce(CAST(sum(n) AS BIGINT), 0) AS violation_count, coalesce(max(n), 0) AS max_category_count FROM c")
def report_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals."""
    return rp.totals(table(spark, d, "manifest"))


@Q.add(sql=f"WITH {_ROWS}, f AS (SELECT doc_id, source_id, min(entry_id) AS entry_id FROM rows_ GROUP BY ALL) SELECT f.doc_id, f.source_id, coalesce(m.p_content, '') AS content FROM f JOIN m ON m.entry_id = f.entry_id")
def report_sources(spark: SparkSession, d: str) -> DataFrame:
    """Contents by source."""
    return rp.source_contents(table(spark, d, "manifest"))


@Q.add(
    sql=f"""WITH {_ROWS}, {_R}, u AS (SELECT rule_id, arg_min(category, (entry_id, violation_no)) AS seen FROM rows_ WHERE rule_id <> '' GROUP BY rule_id)
SELECT rule_id, CASE WHEN r.id IS NOT NULL THEN coalesce(r.category, 'other') ELSE seen END AS category, coalesce(severity, 'medium') AS severity, coalesce(description, '') AS description FROM u LEFT JOIN r ON r.id = u.rule_id"""
)
def report_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules in use."""
    return rp.used_rules(table(spark, d, "manifest"), _rules(spark, d))


@Q.add(
    sql="""SELECT count(*) AS n_blocks, count(DISTINCT heading) AS n_headings, CAST(coalesce(sum(length(content)), 0) AS BIGINT) AS n_chars, CAST(floor(sum(length(content)) / count(*)) AS BIGINT) AS average
FROM (SELECT doc_id, block_idx, any_value(heading) AS heading, any_value(content) AS content FROM blocks GROUP BY doc_id, block_idx)"""
)
def report_block_stats(spark: SparkSession, d: str) -> DataFrame:
    """Block statistics."""
    return rp.block_stats(table(spark, d, "blocks"))


@Q.add(
    sql=f"""WITH {_V}, {_R} SELECT entry_id, CAST(no AS INTEGER) AS violation_no, v.rule_id AS rule_id, coalesce(r.category, 'other') AS category FROM v LEFT JOIN r ON r.id = v.rule_id"""
)
def manifest_categories(spark: SparkSession, d: str) -> DataFrame:
    """Category of each finding by its rule."""
    v = mf.violations(mf.entries(table(spark, d, "manifest"))).drop("category")
    return mf.with_category(v, _rules(spark, d)).select("entry_id", "violation_no", "rule_id", "category")


_KEYED = "b AS (SELECT DISTINCT doc_id, coalesce(nullif(uuid, ''), CAST(block_idx AS VARCHAR)) AS uuid, block_idx FROM blocks)"


@Q.add(sql=f"WITH {_KEYED} SELECT doc_id, block_idx FROM b WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.doc_id = b.doc_id AND m.uuid = b.uuid)")
def manifest_pending(spark: SparkSession, d: str) -> DataFrame:
    """Blocks not audited yet."""
    return mf.pending(table(spark, d, "blocks"), table(spark, d, "manifest")).select("doc_id", "block_idx").distinct()


@Q.add(sql=f"WITH {_KEYED}, {_M}, i AS (SELECT doc_id, uuid, max(block_idx) AS block_idx FROM b GROUP BY ALL) SELECT m.entry_id, i.block_idx FROM m LEFT JOIN i ON i.doc_id = m.doc_id AND i.uuid = m.uuid")
def manifest_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Block of each entry; null for unknown ones."""
    m, b = table(spark, d, "manifest"), table(spark, d, "blocks")
    return mf.with_block(m, b).select("entry_id", "block_idx").unionByName(mf.unknown_blocks(m, b).select("entry_id", F.lit(None).cast("int").alias("block_idx")))


_STRIPPED = ["R001", "R004", "R007"]


@Q.add(
    sql=f"""WITH {_M}, k AS (SELECT *, list_filter(violations, lambda v: NOT coalesce(v.rule_id, '') IN ('R001', 'R004', 'R007')) AS kept FROM m)
SELECT entry_id, CASE WHEN len(kept) < len(violations) THEN len(kept) > 0 ELSE is_violation END AS is_violation, CAST(coalesce(len(violations) - len(kept), 0) AS INTEGER) AS removed, CAST(coalesce(len(kept), -1) AS INTEGER) AS kept FROM k"""
)
def manifest_strip(spark: SparkSession, d: str) -> DataFrame:
    """Findings of some rules taken out."""
    return mf.strip_rules(mf.entries(table(spark, d, "manifest")), _STRIPPED).select("entry_id", "is_violation", "removed", F.coalesce(F.size("violations"), F.lit(-1)).alias("kept"))


_E = lambda c: f"coalesce({c}, '')"


@Q.add(
    sql=f"""WITH {_V}, {_R}, {_KEYED},
old AS (SELECT doc_id, e_uuid AS uuid, v.rule_id AS rule_id, v.violation_text AS violation_text, v.uuid_end AS uuid_end, v.category AS category FROM v),
n0 AS (SELECT doc_id, uuid, {_E('rule_id')} AS rule_id, {_E('violation_text')} AS violation_text, {_E('uuid_end')} AS uuid_end, min(item_id) AS item_id FROM edit_items WHERE {_E('uuid')} <> '' GROUP BY ALL),
n AS (SELECT n0.* FROM n0 WHERE EXISTS (SELECT 1 FROM b WHERE b.doc_id = n0.doc_id AND b.uuid = n0.uuid) AND NOT EXISTS (SELECT 1 FROM old o WHERE o.doc_id = n0.doc_id AND o.uuid = n0.uuid AND {_E('o.rule_id')} = n0.rule_id AND {_E('o.violation_text')} = n0.violation_text AND {_E('o.uuid_end')} = n0.uuid_end))
SELECT doc_id, uuid, rule_id, violation_text, uuid_end, category, 'old' AS source FROM old
UNION ALL SELECT doc_id, uuid, rule_id, violation_text, uuid_end, coalesce(r.category, 'other'), 'new' FROM n LEFT JOIN r ON r.id = n.rule_id"""
)
def manifest_merge(spark: SparkSession, d: str) -> DataFrame:
    """Edit items merged into the manifest as new findings."""
    v = mf.violations(mf.entries(table(spark, d, "manifest")))
    old = v.drop("uuid").withColumnRenamed("e_doc_id", "doc_id").withColumnRenamed("e_uuid", "uuid")
    new = table(spark, d, "edit_items").withColumn("no", F.col("item_id"))
    return mf.merge_violations(old, new, table(spark, d, "blocks"), _rules(spark, d)).select("doc_id", "uuid", "rule_id", "violation_text", "uuid_end", "category", "source")


@Q.add(
    sql=f"""WITH {_V}, {_KEYED}, i AS (SELECT doc_id, uuid, max(block_idx) AS block_idx FROM b GROUP BY ALL)
SELECT m.entry_id, i.block_idx, o.rule_order FROM m JOIN i ON i.doc_id = m.doc_id AND i.uuid = m.uuid
LEFT JOIN (SELECT entry_id, string_agg(coalesce(v.rule_id, ''), ',' ORDER BY coalesce(v.rule_id, ''), no) AS rule_order FROM v GROUP BY entry_id) o ON o.entry_id = m.entry_id"""
)
def manifest_compact(spark: SparkSession, d: str) -> DataFrame:
    """Entries by block, findings by rule."""
    c = mf.compact(table(spark, d, "manifest"), table(spark, d, "blocks"))
    order = F.array_join(F.transform("violations", lambda v: F.coalesce(v["rule_id"], F.lit(""))), ",")
    return c.select("entry_id", "block_idx", F.when(F.size("violations") > 0, order).alias("rule_order"))


@Q.add(
    sql=f"""WITH {_M}, n AS (SELECT is_violation, coalesce(len(list_filter(violations, lambda v: v IS NOT NULL)), 0) AS n FROM m)
SELECT count(*) AS processed, count(*) FILTER (WHERE n > 0) AS with_violations, CAST(sum(n) AS BIGINT) AS violations, count(*) FILTER (WHERE coalesce(is_violation, false) <> (n > 0)) AS wrong_flags, (SELECT count(*) FILTER (WHERE entry_id % 11 = 0) FROM m) AS failed FROM n"""
)
def manifest_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a run, every eleventh entry marked as failed."""
    return mf.run_stats(table(spark, d, "manifest").withColumn("error", F.when(F.col("entry_id") % 11 == 0, "down")))


@Q.add(
    sql="""WITH m AS (SELECT DISTINCT * FROM manifest WHERE uuid_end IS NOT NULL), x AS (SELECT entry_id, uuid, uuid_end, p_heading, unnest(CASE WHEN violations IS NULL THEN [NULL] ELSE violations END) AS v FROM m)
SELECT p_heading AS heading, coalesce(nullif(v.uuid, ''), uuid) AS uuid, coalesce(nullif(v.uuid_end, ''), uuid_end) AS uuid_end, v.rule_id AS rule_id, v.violation_text AS violation_text, v.fix_action AS fix_action, v.revised_text AS revised_text, v.category AS category FROM x"""
)
def json_edit_items(spark: SparkSession, d: str) -> DataFrame:
    """Edit items of nested lines written from the manifest; the finding's own ids win."""
    m = table(spark, d, "manifest").filter("uuid_end is not null").dropDuplicates(["entry_id"])
    raw = m.select(F.to_json(F.struct("uuid", "uuid_end", "p_heading", "violations")).alias("value")).unionByName(spark.createDataFrame([('{"type": "meta"}',), ("",)], "value string"))
    return jl.edit_items_of(raw).select("heading", "uuid", "uuid_end", "rule_id", "violation_text", "fix_action", "revised_text", "category")


@Q.add(sql="SELECT line_id % 3 AS part, raw ->> '$.uuid' AS uuid, raw ->> '$.p_heading' AS p_heading FROM (SELECT DISTINCT line_id, raw FROM manifest_raw WHERE json_valid(raw)) WHERE json_type(raw) = 'OBJECT'")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines as delivered, bad and blank ones left out."""
    raw = table(spark, d, "manifest_raw").dropDuplicates(["line_id"])
    parts = [jl.parsed_lines(raw.filter(F.col("line_id") % 3 == k).select(F.col("raw").alias("value")), "uuid string, p_heading string").withColumn("part", F.lit(k).cast("long")) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@Q.add(sql="SELECT uuid, uuid_end, heading, content, level, coalesce(array_to_string(parent_headings, '|'), '') AS parents, 'sha256:x' AS source_hash FROM (SELECT doc_id, block_idx, any_value(uuid) AS uuid, any_value(uuid_end) AS uuid_end, any_value(heading) AS heading, any_value(content) AS content, any_value(level) AS level, any_value(parent_headings) AS parent_headings FROM blocks GROUP BY doc_id, block_idx)")
def json_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of lines with a meta line before them."""
    b = table(spark, d, "blocks").dropDuplicates(["doc_id", "block_idx"])
    raw = b.select(F.to_json(F.struct("uuid", "uuid_end", "heading", "content", "type", "level", "parent_headings")).alias("value")).unionByName(spark.createDataFrame([('{"type": "meta", "source_hash": "sha256:x"}',)], "value string"))
    meta, blocks = jl.blocks_of(raw)
    hash_ = jl.manifest_meta(meta, "source_hash").first().source_hash
    return blocks.select("uuid", "uuid_end", "heading", "content", "level", F.coalesce(F.array_join("parent_headings", "|"), F.lit("")).alias("parents"), F.lit(hash_).alias("source_hash"))


@Q.add(sql=f"WITH {_R} SELECT id, description FROM r")
def rules_strict(spark: SparkSession, d: str) -> DataFrame:
    """Rule files with ids of their own, put together."""
    r = _rules(spark, d)
    return rl.union_strict([r.filter("id <= 'R009'"), r.filter("id > 'R009'"), r.limit(1).withColumn("id", F.lit(None).cast("string"))]).select("id", "description")


@Q.add(
    sql="""WITH b AS (SELECT doc_id, block_idx, any_value(uuid) AS uuid, any_value(content) AS content FROM blocks GROUP BY doc_id, block_idx), x AS (SELECT *, regexp_extract_all(coalesce(content, ''), '[0-9]{4}') AS f FROM b)
SELECT doc_id, block_idx, CASE WHEN block_idx % 13 = 12 THEN NULL ELSE len(f) > 0 END AS is_violation, block_idx % 13 = 12 AS failed, CASE WHEN block_idx % 13 = 12 THEN '' ELSE array_to_string(f, ',') END AS found FROM x"""
)
def audit_model(spark: SparkSession, d: str) -> DataFrame:
    """Blocks through a pluggable auditor, which fails for some; the flag follows from the findings."""
    import re

    def auditor(block: dict) -> list[dict]:
        if block["heading"] is not None and block["heading"].startswith("\x00"):
            raise au.NonRetryable("refused")
        return [{"rule_id": "D1", "violation_text": x} for x in re.findall("[0-9]{4}", block["content"] or "")]

    b = table(spark, d, "blocks").dropDuplicates(["doc_id", "block_idx"]).withColumn("heading", F.when(F.col("block_idx") % 13 == 12, F.lit("\x00")).otherwise(F.col("heading")))
    out = au.audit_by_model(b, auditor, workers=spark.sparkContext.defaultParallelism, delay=0, tries=0)
    return out.select("doc_id", "block_idx", "is_violation", F.col("error").isNotNull().alias("failed"), F.array_join(F.transform("violations", lambda v: v["violation_text"]), ",").alias("found"))


@Q.add(
    sql="""WITH a AS (SELECT *, 0 AS f FROM audit_rules UNION ALL SELECT * REPLACE ('changed ' || description AS description), 1 AS f FROM audit_rules WHERE id > 'R010'),
l AS (SELECT id, arg_max(description, f) AS description, arg_max(severity, f) AS severity, any_value(category) AS category FROM a GROUP BY id)
SELECT id, description, coalesce((SELECT any_value(severity) FROM audit_rules x WHERE x.id = l.id), 'medium') AS severity, coalesce(category, 'other') AS category FROM l"""
)
def rules_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Two rule files, the later one wins."""
    r = _rules(spark, d)
    return rl.report_rules(rl.union_last([r, r.filter("id > 'R010'").withColumn("description", F.concat(F.lit("changed "), "description"))]))


@Q.add(sql=f"WITH {_R} SELECT 'R' || lpad(CAST(row_number() OVER (ORDER BY description, id) AS VARCHAR), 3, '0') AS id, description, CASE WHEN coalesce(nullif(type, ''), 'block') = 'block_level' THEN 'block' ELSE coalesce(nullif(type, ''), 'block') END AS type FROM r")
def rules_renumbered(spark: SparkSession, d: str) -> DataFrame:
    """Rules numbered by description, types normalised."""
    r = _rules(spark, d).withColumn("type", rl.rule_type(F.col("type"), F.lit(None).cast("string")))
    return rl.renumber(r, ["description", "id"]).select("id", "description", "type")


_RULES = [au.PatternRule("D1", "[0-9]{4}", "four digits", None, "number"), au.PatternRule("D2", " the the ", "twice", " the ", "grammar")]


@Q.add(
    sql="""WITH b AS (SELECT DISTINCT doc_id, block_idx, content FROM blocks WHERE content IS NOT NULL),
x AS (SELECT doc_id, block_idx, 'D1' AS rule_id, unnest(regexp_extract_all(content, '[0-9]{4}')) AS violation_text, 'manual' AS fix_action FROM b UNION ALL SELECT doc_id, block_idx, 'D2', unnest(regexp_extract_all(content, ' the the ')), 'replace' FROM b)
SELECT doc_id, block_idx, rule_id, violation_text, fix_action, count(*) AS n FROM x GROUP BY ALL"""
)
def audit_rule_engine(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the deterministic auditor over all blocks."""
    a = au.audit_by_rules(table(spark, d, "blocks").dropDuplicates(["doc_id", "block_idx"]), _RULES)
    return a.select("doc_id", "block_idx", F.inline("violations")).groupBy("doc_id", "block_idx", "rule_id", "violation_text", "fix_action").agg(F.count("*").alias("n"))


@Q.add(
    sql="""WITH b AS (SELECT DISTINCT doc_id, block_idx, content FROM blocks WHERE content IS NOT NULL), x AS (SELECT regexp_extract_all(content, 'Costs above ([0-9]+) credits', 1) AS f FROM b),
y AS (SELECT DISTINCT f FROM (SELECT unnest(f) AS f FROM x))
SELECT rule_id, entity, field, count(DISTINCT value) AS n_values, count(*) AS n_items FROM (SELECT 'C1' AS rule_id, doc_id AS entity, 'credits' AS field, unnest(regexp_extract_all(content, 'Costs above ([0-9]+) credits', 1)) AS value FROM b) GROUP BY ALL HAVING count(DISTINCT value) > 1"""
)
def audit_value_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Values that differ within a document."""
    b = table(spark, d, "blocks").dropDuplicates(["doc_id", "block_idx"])
    v = b.select(F.lit("C1").alias("rule_id"), F.col("doc_id").alias("entity"), F.lit("credits").alias("field"), F.explode(F.regexp_extract_all("content", F.lit("Costs above ([0-9]+) credits"), 1)).alias("value"))
    return au.value_conflicts(v)


@Q.add(sql="SELECT DISTINCT doc_id, block_idx, 'middle' AS part FROM blocks WHERE block_idx BETWEEN 2 AND 5 UNION ALL SELECT DISTINCT doc_id, block_idx, 'rest' FROM blocks WHERE block_idx >= 3")
def audit_block_range(spark: SparkSession, d: str) -> DataFrame:
    """a range of blocks, and all from a block on."""
    b = table(spark, d, "blocks").select("doc_id", "block_idx").distinct()
    return au.block_range(b, 2, 5).withColumn("part", F.lit("middle")).unionByName(au.block_range(b, 3, -1).withColumn("part", F.lit("rest")))


@Q.add(sql=f"SELECT count(DISTINCT doc_id) AS documents, count(*) AS blocks, CAST(sum({est_sql('content')}) AS BIGINT) AS tokens FROM (SELECT doc_id, block_idx, any_value(content) AS content FROM blocks GROUP BY ALL)")
def audit_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """What an audit of all blocks would take."""
    return au.dry_run(table(spark, d, "blocks"))


@Q.add(sql=f"WITH {_KEYED} SELECT doc_id, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.doc_id = b.doc_id AND m.uuid = b.uuid)) = 0 AS complete FROM b GROUP BY doc_id")
def manifest_complete(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose blocks are all audited."""
    return mf.complete_documents(table(spark, d, "blocks"), table(spark, d, "manifest"))


@Q.add(sql="SELECT DISTINCT doc_id, block_idx, heading FROM blocks ORDER BY doc_id, block_idx LIMIT 5")
def report_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first five blocks, for a look."""
    return rp.preview(table(spark, d, "blocks").select("doc_id", "block_idx", "heading").distinct(), ["doc_id", "block_idx"])


# ---- global rules ----

_GLOBAL = [ga.FieldPattern("G1", "credits", r"above ([0-9]+) credits"), ga.FieldPattern("G2", "days", r"within ([0-9]+) days", "deadline"), ga.FieldPattern("G9", "year", r"(20[0-9]{2})")]
_GLOBAL_RULES = "(VALUES ('G1', 'global', 'number', 'costs'), ('G2', 'global', NULL, NULL), ('G3', 'global', 'other', 'unused'), ('B1', 'block_level', 'grammar', NULL)) r(id, type, category, topic)"
_FOUND = """b AS (SELECT doc_id, block_idx, any_value(uuid) AS uuid, any_value(uuid_end) AS uuid_end, any_value(heading) AS p_heading, any_value(content) AS content FROM blocks GROUP BY doc_id, block_idx),
x AS (SELECT *, 'G1' AS rule_id, 'document' AS entity, 'credits' AS name, 0 AS g, regexp_extract_all(content, 'above ([0-9]+) credits') AS e, regexp_extract_all(content, 'above ([0-9]+) credits', 1) AS v FROM b
 UNION ALL SELECT *, 'G2', 'deadline', 'days', 1, regexp_extract_all(content, 'within ([0-9]+) days'), regexp_extract_all(content, 'within ([0-9]+) days', 1) FROM b
 UNION ALL SELECT *, 'G9', 'document', 'year', 2, regexp_extract_all(content, '(20[0-9]{2})'), regexp_extract_all(content, '(20[0-9]{2})', 1) FROM b),
f AS (SELECT doc_id, block_idx, uuid, uuid_end, rule_id, entity, name, unnest(e) AS evidence, unnest(v) AS value, unnest(range(len(v))) AS k FROM x)"""


def _global_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("G1", "global", "number", "costs"), ("G2", "global", None, None), ("G3", "global", "other", "unused"), ("B1", "block_level", "grammar", None)], "id string, type string, category string, topic string")


def _extractions(spark: SparkSession, d: str) -> DataFrame:
    return ga.extract(table(spark, d, "blocks").dropDuplicates(["doc_id", "block_idx"]), ga.pattern_extractor(_GLOBAL), workers=spark.sparkContext.defaultParallelism)


@Q.add(sql=f"WITH {_FOUND} SELECT doc_id, block_idx, rule_id, entity, name, value, evidence, count(*) AS n FROM f GROUP BY ALL")
def audit_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Items an extractor takes from all blocks."""
    i = ga.items(_extractions(spark, d)).select("doc_id", "block_idx", "rule_id", "entity", F.inline("fields"))
    return i.groupBy("doc_id", "block_idx", "rule_id", "entity", "name", "value", "evidence").agg(F.count("*").alias("n"))


@Q.add(sql=f"WITH {_FOUND} SELECT f.rule_id, coalesce(r.topic, '') AS topic, coalesce(r.category, 'other') AS category, count(*) AS n FROM f LEFT JOIN {_GLOBAL_RULES} ON r.id = f.rule_id GROUP BY ALL")
def audit_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topic and category of extracted items."""
    return ga.with_topic(ga.items(_extractions(spark, d)), _global_rules(spark)).groupBy("rule_id", "topic", "category").agg(F.count("*").alias("n"))


@Q.add(sql=f"WITH {_FOUND} SELECT rule_id, count(DISTINCT doc_id || '#' || block_idx) AS n_blocks, count(*) AS n_items, count(*) AS n_fields FROM f GROUP BY rule_id")
def audit_entities(spark: SparkSession, d: str) -> DataFrame:
    """Counts of extracted entities."""
    return ga.entity_counts(_extractions(spark, d))


@Q.add(sql=f"WITH {_FOUND}, k AS (SELECT rule_id, doc_id, block_idx, k, value FROM f WHERE rule_id IN ('G1', 'G2')) SELECT r.id AS rule_id, count(k.rule_id) AS n_items, coalesce(string_agg(value, ',' ORDER BY k.doc_id, k.block_idx, k.k), '') AS in_order FROM {_GLOBAL_RULES} LEFT JOIN k ON k.rule_id = r.id WHERE r.type = 'global' GROUP BY r.id")
def audit_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Items of each global rule in order, rules without items kept, unknown rules left out."""
    _, wanted = ga.split_by_type(_global_rules(spark))
    got = au.rule_buckets(wanted, ga.of_known_rules(ga.items(_extractions(spark, d)), wanted).select("rule_id", "doc_id", "block_idx", "item_no", F.col("fields")[0]["value"].alias("value")), ["doc_id", "block_idx", "item_no"])
    return got.select("rule_id", F.col("n_items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda x: x["value"]), ",").alias("in_order"))


_CONFLICTS = "c AS (SELECT f.*, count(DISTINCT value) OVER (PARTITION BY doc_id, rule_id, entity, name) AS values_ FROM f WHERE rule_id IN ('G1', 'G2'))"


@Q.add(sql=f"WITH {_FOUND}, {_CONFLICTS} SELECT doc_id, rule_id, uuid, evidence AS violation_text, name || ' has ' || values_ || ' values' AS violation_reason, count(*) AS n FROM c WHERE values_ > 1 GROUP BY ALL")
def audit_global(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the global rules after both phases, a chunk holding each document's items."""
    b = table(spark, d, "blocks").dropDuplicates(["doc_id", "block_idx"])
    out = ga.two_phases(b, _global_rules(spark), lambda x: au.audit_by_rules(x, _RULES), ga.pattern_extractor(_GLOBAL), budget=10**8, workers=spark.sparkContext.defaultParallelism)
    assert out.status == "done"
    return out.findings.groupBy("doc_id", "rule_id", "uuid", "violation_text", "violation_reason").agg(F.count("*").alias("n"))


@Q.add(sql="SELECT 'aborted: audit' AS status, count(*) FILTER (WHERE block_idx % 50 = 49) AS failed FROM (SELECT DISTINCT doc_id, block_idx FROM blocks)")
def audit_aborted(spark: SparkSession, d: str) -> DataFrame:
    """A failed block ends the run before the global phase."""
    b = table(spark, d, "blocks").dropDuplicates(["doc_id", "block_idx"])
    failing = lambda x: au.audit_by_rules(x, _RULES).withColumn("error", F.when(F.col("block_idx") % 50 == 49, "down"))
    out = ga.two_phases(b, _global_rules(spark), failing, ga.pattern_extractor(_GLOBAL))
    return out.entries.agg(F.lit(out.status).alias("status"), F.count("error").alias("failed"))


@Q.add(
    sql=f"""WITH {_FOUND}, {_CONFLICTS}, {_V}, {_KEYED},
old AS (SELECT doc_id, e_uuid AS uuid, coalesce(v.rule_id, '') AS rule_id, coalesce(v.violation_text, '') AS violation_text FROM v WHERE coalesce(v.rule_id, '') NOT IN ('G1', 'G2', 'G3')),
new_ AS (SELECT DISTINCT doc_id, uuid, rule_id, evidence AS violation_text, coalesce(uuid_end, '') AS e FROM c WHERE values_ > 1 AND coalesce(uuid, '') <> '' AND EXISTS (SELECT 1 FROM b k WHERE k.doc_id = c.doc_id AND k.uuid = c.uuid))
SELECT 'old' AS source, rule_id, count(*) AS n FROM old GROUP BY ALL UNION ALL SELECT 'new', rule_id, count(*) FROM new_ GROUP BY ALL""".replace(f", {_KEYED}", "").replace("FROM b k WHERE k.doc_id = c.doc_id AND k.uuid = c.uuid", "FROM blocks k WHERE k.doc_id = c.doc_id AND coalesce(nullif(k.uuid, ''), CAST(k.block_idx AS VARCHAR)) = c.uuid")
)
def audit_global_merged(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the global rules merged into the manifest, twice over with the same result."""
    b, rules = table(spark, d, "blocks"), _global_rules(spark)
    out = ga.two_phases(b.dropDuplicates(["doc_id", "block_idx"]), rules, lambda x: au.audit_by_rules(x, _RULES), ga.pattern_extractor(_GLOBAL), budget=10**8, workers=spark.sparkContext.defaultParallelism)
    m = ga.merged(table(spark, d, "manifest"), out.findings, b, rules)
    return m.groupBy("source", F.coalesce("rule_id", F.lit("")).alias("rule_id")).agg(F.count("*").alias("n"))


@Q.add(
    sql="""SELECT item_id, 'AI-' || coalesce(nullif(trim(category, ' ' || chr(9)), ''), 'uncategorized') AS author, fix_action,
CASE fix_action WHEN 'delete' THEN '' ELSE coalesce(revised_text, '') END AS target FROM (SELECT item_id, any_value(category) AS category, any_value(fix_action) AS fix_action, any_value(revised_text) AS revised_text FROM edit_items GROUP BY item_id)"""
)
def edit_item_actions(spark: SparkSession, d: str) -> DataFrame:
    """Items with author and the text they aim at."""
    i = table(spark, d, "edit_items").dropDuplicates(["item_id"])
    return i.select("item_id", tx.author("AI", F.col("category")).alias("author"), "fix_action", F.when(F.col("fix_action") == "delete", "").otherwise(F.coalesce("revised_text", F.lit(""))).alias("target"))
