"""JSON and JSON Lines: blocks, rules, manifests, edit items; reports and exports."""

from __future__ import annotations

import html
import json
import os
import warnings
import zipfile
from collections.abc import Iterable
from typing import BinaryIO
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellora.functions.text import is_blank, sanitize_xml
from vellora.operators.flatten import VIOLATION_FIELDS
from vellora.operators.rules import rule_type

_VIOLATIONS = "array<struct<" + ",".join(f"{f}:string" for f in VIOLATION_FIELDS) + ">>"
BLOCK = "type string, uuid string, uuid_end string, heading string, content string, parent_headings array<string>, level int, table_chunk_role string, table_header array<array<string>>"
META = "type string, source_file string, source_hash string, parsed_at string, audited_at string"
MANIFEST = f"type string, uuid string, uuid_end string, p_heading string, p_content string, is_violation boolean, violations {_VIOLATIONS}, source_file string, source_hash string, audited_at string"
RULE = "id string, description string, severity string, category string, type string, examples array<struct<violation:string,correction:string>>"


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Lines of JSON (S15, S16): blank lines are skipped; a bad line is an error if ``strict``, else left out.

    A path that is not there gives no rows unless ``strict``.
    """
    try:
        raw = spark.read.text(path)
    except Exception as e:  # noqa: BLE001
        if strict or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return parsed_lines(raw, schema, strict)


def parsed_lines(raw: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    """Rows of lines of JSON in a column ``value``, as read_lines gives them."""
    raw = raw.filter(~is_blank(F.col("value")))
    options = {"mode": "FAILFAST"} if strict else {"columnNameOfCorruptRecord": "_bad"}
    parsed = raw.select(F.from_json("value", schema if strict else f"{schema}, _bad string", options).alias("r")).select("r.*")
    return parsed if strict else parsed.filter("_bad is null").drop("_bad")


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Meta rows and blocks (S10, F05) of JSON Lines, or of one JSON file holding a list or {blocks, meta}."""
    if not path.endswith(".json"):
        return blocks_of(spark.read.text(path))
    text = spark.read.text(path, wholetext=True)
    boxed = text.select(F.when(F.ltrim("value").startswith("["), F.concat(F.lit('{"blocks":'), "value", F.lit("}"))).otherwise(F.col("value")).alias("v"))
    box = boxed.select(F.from_json("v", f"struct<blocks:array<struct<{_nested(BLOCK)}>>,meta:struct<{_nested(META)}>>", {"mode": "FAILFAST"}).alias("b"))
    blocks = box.select(F.inline("b.blocks")).filter("type is null or type <> 'meta'").drop("type")
    return box.select("b.meta.*").filter("source_file is not null or source_hash is not null"), blocks


def blocks_of(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Meta rows and blocks of lines of JSON in a column ``value``."""
    return parsed_lines(raw, META, True).filter("type = 'meta'"), parsed_lines(raw, BLOCK, True).filter("type is null or type <> 'meta'").drop("type")


def _nested(schema: str) -> str:
    """A table schema as the inside of a struct type."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T._parse_datatype_string(schema).fields)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON file (S11): a list, or {type, rules}; types normalised. Rule files are read whole on the driver's side of the scan."""
    text = spark.read.text(path, wholetext=True)
    boxed = text.select(F.when(F.ltrim("value").startswith("["), F.concat(F.lit('{"rules":'), "value", F.lit("}"))).otherwise(F.col("value")).alias("v"))
    r = boxed.select(F.from_json("v", f"struct<type:string,rules:array<struct<{_nested(RULE)}>>>", {"mode": "FAILFAST"}).alias("b")).select(F.col("b.type").alias("file_type"), F.inline("b.rules"))
    return r.withColumn("type", rule_type(F.col("type"), F.col("file_type"))).drop("file_type")


def read_base_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules to build on (S13): none, with a warning, where the file is not there."""
    try:
        return read_rules(spark, path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        warnings.warn(f"no base rules at {path}", stacklevel=2)
        return spark.createDataFrame([], RULE)


def resolve_rule_path(name: str, *folders: str) -> str:
    """A path as it is; a bare name in the working folder, then in ``folders``."""
    for at in [name] if os.path.dirname(name) else [name, *(os.path.join(f, name) for f in folders)]:
        if os.path.exists(at):
            return at
    raise FileNotFoundError(name)


def read_edit_items(spark: SparkSession, path: str) -> DataFrame:
    """Edit items (S18) of flat lines or of entries with violations; the violation's own ids win.

    A line without uuid_end is an error.
    """
    return edit_items_of(spark.read.text(path))


def edit_items_of(raw: DataFrame) -> DataFrame:
    """Edit items of lines of JSON in a column ``value``."""
    flat = "type string, uuid string, uuid_end string, " + ", ".join(f"{f} string" for f in VIOLATION_FIELDS if f not in ("uuid", "uuid_end")) + f", heading string, p_heading string, violations {_VIOLATIONS}"
    rows = parsed_lines(raw, flat, True).filter("type is null or type <> 'meta'")
    one = F.struct(*[F.col(f) for f in VIOLATION_FIELDS])
    got = rows.select(F.col("uuid").alias("u"), F.col("uuid_end").alias("e"), F.coalesce("heading", "p_heading").alias("heading"), F.explode(F.when(F.col("violations").isNotNull(), F.col("violations")).otherwise(F.array(one))).alias("v"))
    end = F.coalesce(F.nullif("v.uuid_end", F.lit("")), "e")
    return got.select("heading", F.coalesce(F.nullif("v.uuid", F.lit("")), "u").alias("uuid"), F.when(end.isNull(), F.raise_error(F.lit("edit item without uuid_end"))).otherwise(end).alias("uuid_end"), *[F.col(f"v.{f}").alias(f) for f in VIOLATION_FIELDS if f not in ("uuid", "uuid_end")])


def write_lines(df: DataFrame, path: str, meta: dict | None = None, append: bool = False) -> None:
    """JSON Lines, in parts (K01, K03, K04, K12); with ``meta`` a first part of one line, {"type": "meta", ..}.

    Lines appended later come in parts of their own; a folder written anew holds nothing of what was there before.
    """
    df.write.mode("append" if append else "overwrite").json(path)
    if meta is not None:
        line = json.dumps({"type": "meta", **meta}, ensure_ascii=False)
        df.sparkSession.range(1).select(F.lit(line).alias("value")).coalesce(1).write.mode("append").text(path)


def entry_lines(entries: DataFrame) -> DataFrame:
    """Entries as lines of a manifest (K01): a failed one carries ``_error`` and no findings, others none."""
    error = F.col("error") if "error" in entries.columns else F.lit(None).cast("string")
    found = F.when(error.isNull(), F.col("violations"))
    return entries.select(*[c for c in entries.columns if c not in ("error", "violations")], found.alias("violations"), error.alias("_error"))


def extraction_path(manifest: str) -> str:
    """Where the extractions of a manifest go."""
    stem, _ = os.path.splitext(manifest)
    return f"{stem}_extractions.jsonl"


#: The report sheet's columns.
SHEET = ["uuid", "uuid_end", "heading", "category", "rule_id", "violation_text", "violation_reason", "revised_text"]


def sheet(rows: DataFrame) -> DataFrame:
    """The report's eight columns without characters a sheet cannot hold."""
    return rows.select(*[sanitize_xml(F.col(c)).alias(c) for c in SHEET])


#: Fixed value: rows a sheet can hold.
SHEET_ROWS = 1_048_576
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"
_SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def write_xlsx(out: BinaryIO, header: list[str], rows: Iterable[tuple], most: int = SHEET_ROWS) -> int:
    """Writes a workbook with frozen headers (K07) row by row and gives its number of sheets.

    Rows beyond what one sheet holds go on in a further one, so none is left out; no more than a row is in memory.
    """
    col = lambda k: (chr(64 + k // 26) if k >= 26 else "") + chr(65 + k % 26)
    cell = lambda r, k, v: f'<c r="{col(k)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'
    line = lambda r, values: (f'<row r="{r}">' + "".join(cell(r, k, v) for k, v in enumerate(values)) + "</row>").encode()
    left, n = iter(rows), 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
        ahead = next(left, None)
        while ahead is not None or n == 0:
            n += 1
            with z.open(f"xl/worksheets/sheet{n}.xml", "w", force_zip64=True) as f:
                f.write(f'<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
                f.write(line(1, header))
                for r in range(2, most + 1):
                    if ahead is None:
                        break
                    f.write(line(r, ahead))
                    ahead = next(left, None)
                f.write(b"</sheetData></worksheet>")
        each = lambda form: "".join(form.format(k=k, name="Report" if k == 1 else f"Report {k}") for k in range(1, n + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_SHEET_TYPE}.sheet.main+xml"/>' + each(f'<Override PartName="/xl/worksheets/sheet{{k}}.xml" ContentType="{_SHEET_TYPE}.worksheet+xml"/>') + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PKG}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PKG}/relationships">' + each(f'<Relationship Id="r{{k}}" Type="{_REL}/worksheet" Target="worksheets/sheet{{k}}.xml"/>') + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + each('<sheet name="{name}" sheetId="{k}" r:id="r{k}"/>') + "</sheets></workbook>")
    return n


def html_report(title: str, counts: dict[str, int], rows: list[dict], trusted: bool = False) -> str:
    """A small page of counts and findings (K06); values are escaped unless trusted."""
    e = str if trusted else (lambda v: html.escape("" if v is None else str(v)))
    head = "".join(f"<li>{e(k)}: {n}</li>" for k, n in sorted(counts.items()))
    body = "".join("<tr>" + "".join(f"<td>{e(r.get(c))}</td>" for c in SHEET) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset='utf-8'><title>{e(title)}</title><h1>{e(title)}</h1><ul>{head}</ul><table><tr>" + "".join(f"<th>{c}</th>" for c in SHEET) + f"</tr>{body}</table>"


def blocks_json(blocks: list[dict], meta: dict) -> str:
    """One readable JSON text of a document's blocks."""
    return json.dumps({"total_blocks": len(blocks), "blocks": blocks, "meta": meta}, ensure_ascii=False, indent=2)


def rules_json(rules: list[dict], version: str = "1.0", description: str = "") -> str:
    """One readable JSON text of a rule set."""
    return json.dumps({"version": version, "description": description, "type": "block", "rules": rules}, ensure_ascii=False, indent=2)


def manifest_meta(lines: DataFrame, order: str) -> DataFrame:
    """The first line with audited_at or of type meta."""
    return lines.filter("audited_at is not null or type = 'meta'").orderBy(order).limit(1)
