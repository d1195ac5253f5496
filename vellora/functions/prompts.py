"""Texts an auditor, extractor or verifier is asked with (P32): system texts once per run, user texts per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellora.functions import text as tx

_ANSWER = "Answer with JSON only and nothing else."
AUDIT = "You check one section of a document against the rules below. Quote the text that breaks a rule exactly as it stands, give the reason, one of the actions replace, delete or manual, and for replace the text to put in its place. " + _ANSWER
EXTRACT = "You read one section of a document and list what the definitions below ask for: each entity with its fields, and for every value the words it was taken from. List nothing that is not there. " + _ANSWER
VERIFY = "You compare items that were taken from all sections of a document under one rule and report those that contradict each other or the rule, by the id they carry. " + _ANSWER


def _nonempty(c: Column, other: str = "") -> Column:
    return F.coalesce(F.nullif(tx.trim_u(c), F.lit("")), F.lit(other))


def audit_system(rules: str) -> str:
    """System text of the block audit: what to do, and the rules as rendered by rules_prompt."""
    return f"{AUDIT}\n\n{rules}"


def audit_user(heading: Column, parents: Column, table_header: Column, content: Column) -> Column:
    """User text of the block audit: the block."""
    return tx.block_prompt(heading, parents, table_header, content)


def definition(rule_id: Column, topic: Column, extraction: Column, entity: Column, fields: Column) -> Column:
    """One global rule as the extractor reads it: what to look for, the entity and its normalised fields."""
    line = F.transform(fields, lambda f: F.concat(F.lit("\n  - "), f["name"], F.when(f["desc"] != "", F.concat(F.lit(": "), f["desc"])).otherwise(""), F.when(f["evidence_desc"] != "", F.concat(F.lit(" (evidence: "), f["evidence_desc"], F.lit(")"))).otherwise("")))
    return F.concat(
        F.lit("- ["), _nonempty(rule_id), F.lit("] "), _nonempty(topic), F.lit(": "), _nonempty(extraction), F.lit("\n  entity: "), _nonempty(entity, "any"), F.coalesce(F.array_join(line, ""), F.lit(""))
    )


def extract_system(definitions: list[str]) -> str:
    """System text of the extraction: all definitions."""
    return EXTRACT + "\n\nDefinitions:\n" + "\n".join(definitions)


def extract_user(heading: Column, parents: Column, content: Column) -> Column:
    """User text of the extraction: the block without a table header."""
    return tx.block_prompt(heading, parents, F.lit(None).cast("array<array<string>>"), content)


def verify_system(rule_id: Column, topic: Column, verification: Column) -> Column:
    """System text of the verification of one rule."""
    return F.concat(F.lit(VERIFY + "\n\nRule ["), _nonempty(rule_id), F.lit("] "), _nonempty(topic), F.lit(": "), _nonempty(verification))


def verify_user(items: Column) -> Column:
    """User text of the verification: item texts, numbered from 1."""
    return F.concat(F.lit("Items:"), F.array_join(F.transform(items, lambda t, i: F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". "), t)), ""))
