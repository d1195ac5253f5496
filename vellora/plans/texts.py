"""Queries of the text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellora.functions import prompts as pr
from vellora.functions import tables as tb
from vellora.functions import text as tx
from vellora.plans.registry import Registry
from vellora.session import table

Q = Registry()

#: White space and digits in the SQL engine's patterns.
WS, ND = r"[\t-\r\x{85}\p{Z}]", r"\p{Nd}"
AUTO = rf"^(?:{ND}+(?:[\.\p{{Nd}})）]+){WS}+|[a-zA-Z][.)）]{WS}+|•{WS}*|[表图]{WS}*{ND}+{WS}*|注[:：]{WS}*)"
ONLY = rf"^(?:{ND}+(?:\.{ND}+|[)）.])*|[a-zA-Z][.)）]|•|[表图]{WS}*{ND}+|注[:：]?)$"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def est_sql(x: str) -> str:
    n = lambda p: f"length(regexp_replace({x}, '{p}', '', 'g'))"
    return (
        f"CASE WHEN coalesce({x}, '') = '' THEN 0 ELSE CAST(floor(({n('[^一-龥]')} * CAST(0.75 AS DOUBLE) + {n('[^\\[\\]",{}]')} * CAST(1 AS DOUBLE)"
        f" + {n('[一-龥\\[\\]",{}]')} * CAST(0.4 AS DOUBLE)) * CAST(1.05 AS DOUBLE)) AS BIGINT) + 2 END"
    )


@Q.add(sql=f"SELECT DISTINCT doc_id, block_idx, {est_sql('content')} AS tokens FROM blocks")
def fn_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Size estimate of every block."""
    return table(spark, d, "blocks").select("doc_id", "block_idx", tx.estimate_tokens(F.col("content")).alias("tokens")).distinct()


@Q.add(
    sql=f"""SELECT DISTINCT item_id, regexp_replace(violation_text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS clean,
CASE WHEN length(one) > 50 THEN substr(one, 1, 50) || '...' ELSE one END AS preview,
regexp_replace(regexp_replace(violation_text, '(?i)</?(?:sup|sub)>', '', 'g'), '{WS}+$', '') AS plain
FROM (SELECT *, trim(regexp_replace(replace(replace(replace(violation_text, chr(10), ' '), chr(9), ' '), chr(13), ''), ' +', ' ', 'g')) AS one FROM edit_items)"""
)
def fn_clean_text(spark: SparkSession, d: str) -> DataFrame:
    """Control characters, preview, markup, trailing blanks."""
    v = F.col("violation_text")
    return table(spark, d, "edit_items").select("item_id", tx.sanitize_xml(v).alias("clean"), tx.preview(v).alias("preview"), tx.rtrim_lines(tx.strip_markup(v)).alias("plain")).distinct()


@Q.add(sql="SELECT DISTINCT doc_id, block_idx, CASE WHEN length(h) > 200 THEN substr(h, 1, 197) || '...' ELSE h END AS short, coalesce(length(h) > 200, false) AS too_long FROM (SELECT *, repeat(heading, 1 + block_idx % 12) AS h FROM blocks)")
def fn_headings(spark: SparkSession, d: str) -> DataFrame:
    """Truncation and the length test, of headings repeated up to twelve times."""
    b = table(spark, d, "blocks").select("doc_id", "block_idx", F.expr("repeat(heading, 1 + block_idx % 12)").alias("h"))
    return b.select("doc_id", "block_idx", tx.truncate_heading(F.col("h")).alias("short"), F.coalesce(F.length("h") > tx.HEADING_LIMIT, F.lit(False)).alias("too_long")).distinct()


_NUMBERED = "(SELECT DISTINCT item_id, CASE item_id % 8 WHEN 0 THEN '1.1 ' WHEN 1 THEN 'a) ' WHEN 2 THEN '• ' WHEN 3 THEN '表 3 ' WHEN 4 THEN '注：' WHEN 5 THEN '2024 ' WHEN 6 THEN '7 ' ELSE '' END || violation_text AS t FROM edit_items)"


@Q.add(sql=f"SELECT item_id, regexp_replace(t, '{AUTO}', '') AS bare, regexp_matches(t, '{AUTO}') AS was FROM {_NUMBERED}")
def fn_strip_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Automatic numbering before quotes."""
    t = table(spark, d, "edit_items").selectExpr("item_id", "concat(case item_id % 8 when 0 then '1.1 ' when 1 then 'a) ' when 2 then '• ' when 3 then '表 3 ' when 4 then '注：' when 5 then '2024 ' when 6 then '7 ' else '' end, violation_text) as t").distinct()
    return t.select("item_id", tx.strip_auto_number(F.col("t")).alias("bare"), tx.has_auto_number(F.col("t")).alias("was"))


_LINES = "(SELECT doc_id, block_idx, string_agg(CASE i % 5 WHEN 0 THEN 'a) ' || l WHEN 1 THEN '3.2.1' WHEN 2 THEN l WHEN 3 THEN '10. ' || l ELSE ' • ' END, chr(10) ORDER BY i) AS t FROM (SELECT DISTINCT doc_id, block_idx, content FROM blocks WHERE content IS NOT NULL), LATERAL (SELECT unnest(string_split(content, chr(10))) AS l, unnest(range(len(string_split(content, chr(10))))) AS i) GROUP BY doc_id, block_idx)"


@Q.add(
    sql=f"""WITH b AS (SELECT doc_id, block_idx, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS i FROM {_LINES}),
s AS (SELECT *, regexp_replace(l, '{AUTO}', '') AS bare FROM b),
c AS (SELECT *, regexp_matches({strip_sql('l')}, '{ONLY}') AS only_number, {strip_sql('bare')} <> '' AND NOT regexp_matches({strip_sql('bare')}, '{ONLY}') AS content FROM s),
w AS (SELECT *, coalesce(bool_or(content AND NOT only_number OR content) OVER (PARTITION BY doc_id, block_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM c)
SELECT doc_id, block_idx, string_agg(CASE WHEN only_number AND seen THEN '' ELSE bare END, chr(10) ORDER BY i) AS bare FROM w GROUP BY doc_id, block_idx"""
)
def fn_strip_numbering_lines(spark: SparkSession, d: str) -> DataFrame:
    """Numbering of every line of a block (lines numbered by rule here)."""
    b = table(spark, d, "blocks").filter("content is not null").select("doc_id", "block_idx", "content").distinct()
    lines = F.transform(
        F.split("content", "\n"),
        lambda l, i: F.when(i % 5 == 0, F.concat(F.lit("a) "), l)).when(i % 5 == 1, "3.2.1").when(i % 5 == 2, l).when(i % 5 == 3, F.concat(F.lit("10. "), l)).otherwise(" • "),
    )
    t = b.withColumn("t", F.array_join(lines, "\n"))
    # a line of one block always has a line feed beside it, or is alone: both give the per-line rule
    return t.select("doc_id", "block_idx", tx.strip_auto_number_lines(F.col("t")).alias("bare"))


def _roman_sql(n: str) -> str:
    unit = lambda p, w: f"[{', '.join(chr(39) + x + chr(39) for x in w)}][CAST(({n} // {p}) % 10 AS INT) + 1]"
    return f"CASE WHEN {n} BETWEEN 1 AND 3999 THEN {' || '.join(unit(10 ** (3 - i), w) for i, w in enumerate(tx._ROMAN))} ELSE CAST({n} AS VARCHAR) END"


def _cn_sql(n: str) -> str:
    dig = lambda x: f"substr('{tx._CN}', CAST({x} AS INT) + 1, 1)"
    return f"CASE WHEN {n} BETWEEN 1 AND 99 THEN (CASE WHEN {n} // 10 = 0 THEN '' WHEN {n} // 10 = 1 THEN '十' ELSE {dig(n + ' // 10')} || '十' END) || (CASE WHEN {n} % 10 = 0 THEN '' ELSE {dig(n + ' % 10')} END) ELSE CAST({n} AS VARCHAR) END"


@Q.add(
    sql=f"""SELECT n, chr(CAST(97 + (n - 1) % 26 AS INT)) AS letter, chr(CAST(65 + (n - 1) % 26 AS INT)) AS capital, lower({_roman_sql('n')}) AS roman, {_roman_sql('n')} AS great, '•' AS bullet, '' AS nothing, CAST(n AS VARCHAR) AS decimal, {_cn_sql('n')} AS chinese, substr('{tx._STEMS}', CAST((n - 1) % 10 AS INT) + 1, 1) AS stem,
'第' || ({_cn_sql('n')}) || '章' AS chapter, CAST(n AS VARCHAR) || '.' || CAST(n + 1 AS VARCHAR) AS legal
FROM (SELECT DISTINCT l_orderkey AS n FROM lineitem WHERE l_orderkey > 0)"""
)
def fn_number_formats(spark: SparkSession, d: str) -> DataFrame:
    """Counters in number formats and label templates."""
    n = table(spark, d, "lineitem").filter("l_orderkey > 0").select(F.col("l_orderkey").alias("n")).distinct()
    f = lambda k: tx.format_number(F.col("n"), F.lit(k))
    level = lambda x, k: F.struct(x.alias("n"), F.lit(k).alias("fmt"))
    return n.select(
        "n", f("lowerLetter").alias("letter"), f("upperLetter").alias("capital"), f("lowerRoman").alias("roman"), f("upperRoman").alias("great"), f("bullet").alias("bullet"), f("none").alias("nothing"), f("decimal").alias("decimal"), f("chineseCountingThousand").alias("chinese"), f("ideographTraditional").alias("stem"),
        tx.format_label(F.lit("第%1章"), F.array(level(F.col("n"), "chineseCountingThousand")), F.lit(False)).alias("chapter"),
        tx.format_label(F.lit("%1.%2"), F.array(level(F.col("n"), "upperRoman"), level(F.col("n") + 1, "decimal")), F.lit(True)).alias("legal"),
    )


@Q.add(
    sql=f"""WITH s AS (SELECT DISTINCT doc_id, block_idx, content, string_split_regex(content, '</?table>') AS p FROM blocks),
u AS (SELECT doc_id, block_idx, {strip_sql('x')} AS x, i FROM (SELECT doc_id, block_idx, unnest(p) AS x, unnest(range(len(p))) AS i FROM s WHERE regexp_matches(content, '</?table>'))),
m AS (SELECT doc_id, block_idx, arg_max(x, length(x) * 100000 - i) AS longest FROM u WHERE x <> '' GROUP BY ALL)
SELECT s.doc_id, s.block_idx, m.longest FROM s LEFT JOIN m ON s.doc_id = m.doc_id AND s.block_idx = m.block_idx"""
)
def fn_longest_segment(spark: SparkSession, d: str) -> DataFrame:
    """Longest text outside table tags."""
    return table(spark, d, "blocks").select("doc_id", "block_idx", tx.longest_segment(F.col("content")).alias("longest")).distinct()


@Q.add(
    sql=f"""WITH t AS (SELECT DISTINCT doc_id, pos, CAST(json(regexp_extract(text, '<table>(.*)</table>', 1)) AS VARCHAR[][]) AS r FROM paragraphs
WHERE is_table AND text LIKE '<table>%</table>' AND json_valid(regexp_extract(text, '<table>(.*)</table>', 1)))
SELECT doc_id, pos, len(r) AS n_rows, len(r[1]) AS n_cols, r[1][1] AS corner,
'[' || array_to_string(list_transform(r, lambda x: '[' || array_to_string(list_transform(x, lambda y: CASE WHEN y IS NULL THEN 'null' ELSE '"' || replace(replace(y, '\\', '\\\\'), '"', '\\"') || '"' END), ', ') || ']'), ', ') || ']' AS json FROM t"""
)
def fn_table_json(spark: SparkSession, d: str) -> DataFrame:
    """Tables of paragraphs parsed and written back in the block form."""
    t = table(spark, d, "paragraphs").filter("is_table").select("doc_id", "pos", F.from_json(F.regexp_extract("text", "(?s)^<table>(.*)</table>$", 1), "array<array<string>>").alias("r")).filter("r is not null")
    first = F.get("r", F.lit(0))
    return t.select("doc_id", "pos", F.size("r").cast("long").alias("n_rows"), F.size(first).cast("long").alias("n_cols"), F.get(first, F.lit(0)).alias("corner"), tx.json_table(F.col("r")).alias("json")).distinct()


@Q.add(
    sql="""SELECT DISTINCT item_id, CASE WHEN revised_text <> '' THEN head || chr(10) || 'Suggestion: ' || revised_text ELSE head END AS manual,
'{WHY}' || coalesce(violation_reason, '') || ' {WHERE}' || coalesce(violation_text, '') || ' {SUGGEST}' || coalesce(revised_text, '') AS failed,
'AI-' || coalesce(nullif(trim(category, ' ' || chr(9)), ''), 'uncategorized') AS author FROM (SELECT *, coalesce(violation_reason, '') AS head FROM edit_items)"""
)
def fn_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comment texts and authors."""
    c = F.col
    return table(spark, d, "edit_items").select(
        "item_id", tx.manual_comment(c("violation_reason"), c("revised_text")).alias("manual"), tx.comment_text(c("violation_reason"), c("violation_text"), c("revised_text")).alias("failed"), tx.author("AI", c("category")).alias("author")
    ).distinct()


@Q.add(
    sql=f"""WITH e AS (SELECT DISTINCT item_id, trim(regexp_replace(coalesce(violation_reason, ''), '{WS}+', ' ', 'g')) AS one FROM edit_items),
k AS (SELECT item_id, CASE WHEN contains(one, '; ') THEN trim(split_part(one, '; ', 1)) WHEN contains(one, '. ') THEN trim(split_part(one, '. ', 1)) ELSE one END AS cut FROM e)
SELECT item_id, CASE WHEN length(cut) > 48 THEN rtrim(substr(cut, 1, 45)) || '...' ELSE cut END AS summary FROM k"""
)
def fn_status_summary(spark: SparkSession, d: str) -> DataFrame:
    """One-line summary of a reason."""
    return table(spark, d, "edit_items").select("item_id", tx.status_summary(F.col("violation_reason")).alias("summary")).distinct()


def _quoted(c: str) -> str:
    """A text as a list shows it, in SQL."""
    q, dq, bs = "''''", "chr(34)", "chr(92)"
    e = f"replace(replace(replace({c}, {bs}, {bs} || {bs}), chr(10), {bs} || 'n'), chr(9), {bs} || 't')"
    return f"CASE WHEN {c} IS NULL THEN 'None' WHEN contains({c}, {q}) AND NOT contains({c}, {dq}) THEN {dq} || {e} || {dq} ELSE {q} || replace({e}, {q}, {bs} || {q}) || {q} END"


_UP = f"coalesce(array_to_string(list_filter(list_transform(parent_headings, lambda x: {strip_sql('x')}), lambda x: x IS NOT NULL AND x <> ''), ' → '), '')"
_HEADER = f"CASE WHEN len(table_header) > 0 THEN chr(10) || 'Table header context: [' || array_to_string(list_transform(table_header, lambda r: '[' || array_to_string(list_transform(r, lambda c: {_quoted('c')}), ', ') || ']'), ', ') || ']' ELSE '' END"


def _prompt_sql(header: str) -> str:
    return f"'Section hierarchy context: ' || CASE WHEN up <> '' THEN up || '  → ' || h ELSE h END || {header} || chr(10) || chr(10) || 'Content:' || chr(10) || coalesce({strip_sql('content')}, '')"


_SHOWN = f"(SELECT *, coalesce(nullif({strip_sql('heading')}, ''), 'Unknown') AS h, {_UP} AS up FROM blocks)"


@Q.add(sql=f"SELECT DISTINCT doc_id, block_idx, {_prompt_sql(_HEADER)} AS audit, {_prompt_sql(chr(39) * 2)} AS extract FROM {_SHOWN}")
def fn_block_prompt(spark: SparkSession, d: str) -> DataFrame:
    """All blocks as the auditor reads them, and as the extractor does."""
    c = F.col
    b = table(spark, d, "blocks")
    return b.select("doc_id", "block_idx", pr.audit_user(c("heading"), c("parent_headings"), c("table_header"), c("content")).alias("audit"), pr.extract_user(c("heading"), c("parent_headings"), c("content")).alias("extract")).distinct()


@Q.add(
    sql=f"""WITH i AS (SELECT DISTINCT item_id, rule_id, category, heading, uuid, violation_text FROM edit_items WHERE rule_id IS NOT NULL)
SELECT item_id, '- [' || rule_id || '] ' || coalesce({strip_sql('heading')}, '') || ': ' || coalesce({strip_sql('violation_text')}, '') || chr(10) || '  entity: ' || coalesce(nullif({strip_sql('category')}, ''), 'any') || chr(10) || '  - value: one' || chr(10) || '  - old: legacy (evidence: words)' AS definition,
'{pr.VERIFY}' || chr(10) || chr(10) || 'Rule [' || rule_id || '] ' || coalesce({strip_sql('heading')}, '') || ': ' || coalesce({strip_sql('violation_text')}, '') AS system,
'Items:' || chr(10) || '1. ' || coalesce(uuid, 'none') || chr(10) || '2. ' || coalesce(category, 'none') AS user FROM i"""
)
def fn_global_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Definitions with fields of both shapes, and the verifier's texts."""
    c = F.col
    i = table(spark, d, "edit_items").filter("rule_id is not null").select("item_id", "rule_id", "category", "heading", "uuid", "violation_text").distinct()
    m = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    fields = tx.extracted_fields(F.array(m("name", "value", "desc", " one "), F.lit(None).cast("map<string,string>"), m("old", "legacy", "evidence", "words")))
    return i.select(
        "item_id", pr.definition(c("rule_id"), c("heading"), c("violation_text"), c("category"), fields).alias("definition"), pr.verify_system(c("rule_id"), c("heading"), c("violation_text")).alias("system"),
        pr.verify_user(F.array(F.coalesce("uuid", F.lit("none")), F.coalesce("category", F.lit("none")))).alias("user"),
    )


@Q.add(
    sql="""WITH r AS (SELECT id, description, examples FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY id) AS k FROM audit_rules) WHERE k = 1),
x AS (SELECT id, i, coalesce(e.violation, '') AS v, coalesce(e.correction, '') AS c FROM (SELECT id, unnest(examples) AS e, unnest(range(len(examples))) AS i FROM r)),
l AS (SELECT id, string_agg(chr(10) || '  - Example ' || (i + 1) || ':' || CASE WHEN v <> '' THEN chr(10) || '       ✗ violation: ' || v ELSE '' END || CASE WHEN c <> '' THEN chr(10) || '       ✓ correction: ' || c ELSE '' END, '' ORDER BY i) AS t FROM x WHERE v <> '' OR c <> '' GROUP BY id)
SELECT 'Audit Rules:' || chr(10) || string_agg('- [' || r.id || '] ' || coalesce(description, '') || coalesce(t, ''), chr(10) ORDER BY r.id) AS prompt FROM r LEFT JOIN l ON l.id = r.id"""
)
def fn_rules_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The block rules as the auditor reads them."""
    return tb.rules_prompt(table(spark, d, "audit_rules").dropDuplicates(["id"]))


@Q.add(
    sql="""SELECT msg, NOT (regexp_matches(m, 'api[_ ]key|authenticat(ion|e)|forbidden|403') OR (contains(m, 'permission') AND contains(m, 'denied')) OR (contains(m, 'invalid') AND regexp_matches(m, 'request|argument'))
OR (contains(m, '400') AND contains(m, 'bad request')) OR (contains(m, 'model') AND regexp_matches(m, 'not found|not exist')) OR contains(m, '404') OR contains(m, 'billing')) AS retry
FROM (SELECT msg, lower(msg) AS m FROM (SELECT DISTINCT coalesce(violation_reason, '') || CASE item_id % 7 WHEN 0 THEN ' 429 rate limit' WHEN 1 THEN ' 403 Forbidden' WHEN 2 THEN ' Model not found' WHEN 3 THEN ' quota exceeded' WHEN 4 THEN ' invalid argument' WHEN 5 THEN ' billing' ELSE '' END AS msg FROM edit_items))"""
)
def fn_retryable(spark: SparkSession, d: str) -> DataFrame:
    """which failures are worth another try, by their message."""
    m = table(spark, d, "edit_items").selectExpr("concat(coalesce(violation_reason, ''), case item_id % 7 when 0 then ' 429 rate limit' when 1 then ' 403 Forbidden' when 2 then ' Model not found' when 3 then ' quota exceeded' when 4 then ' invalid argument' when 5 then ' billing' else '' end) as msg").distinct()
    return m.select("msg", tx.message_retryable(F.col("msg")).alias("retry"))


@Q.add(
    sql="""WITH k AS (SELECT DISTINCT ['AuthenticationError', 'RateLimitError', 'APIStatusError', 'InternalServerError', 'NotFoundError', 'Other', NULL][item_id % 7 + 1] AS kind, [429, 500, 404, 503, 400, NULL][item_id % 6 + 1] AS status FROM edit_items)
SELECT kind, status, CASE WHEN kind IN ('AuthenticationError', 'NotFoundError') THEN false WHEN kind = 'APIStatusError' THEN coalesce(status IN (429, 500, 503), false) ELSE true END AS retry FROM k"""
)
def fn_status_retryable(spark: SparkSession, d: str) -> DataFrame:
    """failures by kind and status."""
    kinds, states = ["AuthenticationError", "RateLimitError", "APIStatusError", "InternalServerError", "NotFoundError", "Other", None], [429, 500, 404, 503, 400, None]
    at = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("item_id") % n + 1).cast("int"))
    k = table(spark, d, "edit_items").select(at(kinds, 7).alias("kind"), at(states, 6).alias("status")).distinct()
    return k.select("kind", "status", tx.status_retryable(F.col("kind"), F.col("status")).alias("retry"))


@Q.add(
    sql="""WITH t AS (SELECT DISTINCT doc_id, pos, text[9:-10] AS body FROM paragraphs WHERE is_table AND text LIKE '<table>[[%]]</table>'),
m AS (SELECT *, string_split(body[3:-3], '"], ["') AS r FROM t)
SELECT doc_id, pos, '["' || list_filter(r, lambda x: contains(x, 'final'))[1] || '"]' AS hit, '["' || r[1] || '"]' AS first, body AS fixed FROM m"""
)
def fn_matching_row(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each table that holds a word, and doubled brackets taken off."""
    t = table(spark, d, "paragraphs").filter("is_table and text like '<table>[[%]]</table>'").select("doc_id", "pos", F.expr("substring(text, 8, length(text) - 15)").alias("j")).distinct()
    rows = tx.fix_table_json(F.col("j"))
    return t.select("doc_id", "pos", tx.matching_row(rows, F.lit("final")).alias("hit"), tx.matching_row(rows, F.lit("")).alias("first"), rows.alias("fixed"))


@Q.add(sql="SELECT DISTINCT item_id, violation_text AS text, CAST(least(20, length(violation_text)) AS INTEGER) AS place FROM edit_items WHERE violation_text IS NOT NULL")
def fn_json_escape(spark: SparkSession, d: str) -> DataFrame:
    """Quotes escaped and read again, and the place of their twentieth character told from the escaped form."""
    i = table(spark, d, "edit_items").filter("violation_text is not null").select("item_id", F.concat("violation_text").alias("t")).distinct()
    e = i.withColumns({"e": tx.json_escape(F.col("t")), "at": F.length(tx.json_escape(F.substring("t", 1, 20)))})
    return e.select("item_id", tx.json_unescape(F.col("e")).alias("text"), tx.unescaped_offset(F.col("e"), F.col("at")).alias("place"))


@Q.add(sql=f"WITH t AS (SELECT DISTINCT doc_id, pos, text FROM paragraphs WHERE text IS NOT NULL) SELECT doc_id, pos, {est_sql('text')} > 60 AND text LIKE '<table>%' AS over, CASE WHEN text LIKE '<table>%' OR text LIKE '[[\"%' THEN 'table' WHEN text LIKE '[\"%' THEN 'row' ELSE 'text' END AS shape, CASE WHEN is_table THEN CASE WHEN len(string_split(text, '\"], [\"')) > 1 THEN 'rows' ELSE 'row' END ELSE 'text' END AS inner FROM (SELECT t.*, text LIKE '<table>[[%' AS is_table FROM t)")
def fn_table_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Tables above a limit (60 here: the tables are small), and what a text quotes."""
    t = table(spark, d, "paragraphs").filter("text is not null").select("doc_id", "pos", "text").distinct()
    rows = F.when(F.col("text").like("<table>[[%"), F.expr("substring(text, 9, length(text) - 17)")).otherwise(F.col("text"))
    return t.select("doc_id", "pos", tx.table_over_limit(F.col("text"), 60).alias("over"), tx.quote_shape(F.col("text")).alias("shape"), tx.quote_shape(rows).alias("inner"))


@Q.add(
    sql=f"""SELECT item_id, CASE WHEN regexp_replace(t, '{AUTO}', '') <> t THEN [regexp_replace(t, '{AUTO}', '')] ELSE [] END AS variants,
list_filter([t, regexp_replace(t, '{AUTO}', ''), violation_text], lambda x, i: x IS NOT NULL AND list_position([t, regexp_replace(t, '{AUTO}', ''), violation_text], x) = i) AS attempts
FROM (SELECT *, CASE item_id % 3 WHEN 0 THEN '1.1 ' WHEN 1 THEN 'a) ' ELSE '' END || violation_text AS t FROM (SELECT DISTINCT item_id, violation_text FROM edit_items WHERE violation_text IS NOT NULL AND NOT contains(violation_text, chr(10)) AND NOT contains(violation_text, '\\n')))"""
)
def fn_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Search texts without numbering, and attempts once each in order (quotes of one line)."""
    i = table(spark, d, "edit_items").filter(r"violation_text is not null and not contains(violation_text, '\n') and not contains(violation_text, '\\n')").select("item_id", "violation_text").distinct()
    i = i.withColumn("t", F.expr("concat(case item_id % 3 when 0 then '1.1 ' when 1 then 'a) ' else '' end, violation_text)"))
    return i.select(
        "item_id", F.transform(tx.numbering_variants(F.col("t")), lambda x: x["text"]).alias("variants"), tx.in_order_once(F.array("t", tx.strip_auto_number(F.col("t")), "violation_text")).alias("attempts")
    )


@Q.add(
    sql=f"""SELECT DISTINCT item_id, CAST(item_id AS VARCHAR) AS id, nullif(coalesce(rule_id, ''), '') AS name, 'see <drawing id="' || item_id || '" name="' || coalesce(rule_id, '') || '" /> there' AS plain, 'jpeg' AS format,
'gpt-5-' || item_id AS model, true AS reasoning, item_id % 2 = 0 AS not_found, '\\sum{{' || item_id || '}}' AS equation FROM edit_items"""
)
def fn_small_texts(spark: SparkSession, d: str) -> DataFrame:
    """Drawing placeholders, formats, model names, reasons and linear equations."""
    k = F.col("item_id").cast("string")
    text = F.concat(F.lit('see <drawing id="'), k, F.lit('" name="'), F.coalesce("rule_id", F.lit("")), F.lit('" path="a/b.png" format="png" /> there'))
    model = F.concat(F.lit("models/x/gpt-5-"), k)
    why = F.when(F.col("item_id") % 2 == 0, " NF_C: violation text not found(C)").otherwise("violation text not found")
    return table(spark, d, "edit_items").select(
        "item_id", tx.drawing_attribute(text, "id").alias("id"), tx.drawing_attribute(text, "name").alias("name"), tx.normalize_drawings(text).alias("plain"), tx.image_format(F.lit(" image/JPG ")).alias("format"),
        tx.model_name(model).alias("model"), tx.is_reasoning_model(model).alias("reasoning"), tx.not_found_reason(why).alias("not_found"), tx.clean_linear(F.concat(F.lit("\\sum"), k)).alias("equation"),
    ).distinct()


@Q.add()
def fn_table_row_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Row numbers stripped from table paragraphs, in all cells and in first cells only."""
    t = table(spark, d, "paragraphs").filter("is_table").select("doc_id", "pos", F.regexp_extract("text", "(?s)^<table>(.*)</table>$", 1).alias("j")).distinct()
    return t.select("doc_id", "pos", tb.strip_row_numbers(F.col("j"), F.lit(True)).alias("all_cells"), tb.strip_row_numbers(F.col("j"), F.lit(False)).alias("first_cells"))


@Q.add(
    sql="""WITH t AS (SELECT DISTINCT doc_id, pos, CAST(json(regexp_extract(text, '<table>(.*)</table>', 1)) AS VARCHAR[][]) AS r FROM paragraphs
WHERE is_table AND text LIKE '<table>%</table>' AND json_valid(regexp_extract(text, '<table>(.*)</table>', 1))),
c AS (SELECT doc_id, pos, i, j, coalesce(r[i][j], 'None') AS x FROM (SELECT doc_id, pos, r, i, unnest(range(1, len(r[i]) + 1)) AS j FROM (SELECT doc_id, pos, r, unnest(range(1, len(r) + 1)) AS i FROM t))),
f AS (SELECT doc_id, pos, len(r[1]) AS n FROM t),
w AS (SELECT c.doc_id, c.pos, j, CASE WHEN j <= any_value(n) THEN least(40, max(length(x))) ELSE 20 END AS w FROM c JOIN f ON f.doc_id = c.doc_id AND f.pos = c.pos GROUP BY c.doc_id, c.pos, j),
l AS (SELECT c.doc_id, c.pos, i, string_agg(rpad(substr(x, 1, w), CAST(w AS INTEGER), ' '), ' | ' ORDER BY c.j) AS line FROM c JOIN w ON w.doc_id = c.doc_id AND w.pos = c.pos AND w.j = c.j GROUP BY c.doc_id, c.pos, i)
SELECT doc_id, pos, string_agg(line, chr(10) ORDER BY i) AS shown FROM l GROUP BY doc_id, pos"""
)
def fn_table_display(spark: SparkSession, d: str) -> DataFrame:
    """Tables as padded lines."""
    t = table(spark, d, "paragraphs").filter("is_table").select("doc_id", "pos", F.from_json(F.regexp_extract("text", "(?s)^<table>(.*)</table>$", 1), "array<array<string>>").alias("r")).filter("r is not null")
    return t.select("doc_id", "pos", tx.display_table(F.col("r")).alias("shown")).distinct()
