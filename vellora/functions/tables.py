"""Functions of table texts and rule sets that need more than one expression."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from vellora.functions import text as tx

_PREFIX, _ONLY, _ROW = re.compile(tx.AUTO_NUMBER), re.compile(tx.ONLY_NUMBER), re.compile(r"\d+(?:[.\d)）]+)?")


def unnumbered_lines(s: str) -> str:
    """The rule of strip_auto_number_lines on a Python text."""
    sep = next((x for x in ("\n", "\\n") if x in s), None)
    if sep is None:
        return _PREFIX.sub("", s, count=1)
    seen, out = False, []
    for line in s.split(sep):
        if seen and _ONLY.fullmatch(line.strip()):
            out.append("")
            continue
        bare = _PREFIX.sub("", line, count=1)
        seen = seen or bool(bare.strip() and not _ONLY.fullmatch(bare.strip()))
        out.append(bare)
    return sep.join(out)


def _first_cell(cell: object) -> object:
    if not isinstance(cell, str):
        return cell
    s = cell.strip()
    if m := _PREFIX.match(s):
        return s[m.end() :].strip()
    return "" if _ROW.fullmatch(s) else cell


def parse_rows(s: str) -> tuple[list, str] | None:
    """Rows of a JSON row, of rows joined by commas, or of a whole table, and which of these it is."""
    s = s.strip()
    for text, kind in ((s, "one"), (f"[{s}]" if s.startswith('["') else "", "many")):
        try:
            v = json.loads(text)
        except ValueError:
            continue
        if not isinstance(v, list):
            continue
        nested = bool(v) and isinstance(v[0], list)
        if kind == "many":
            return (v, "many") if nested else None
        return (v, "table") if nested else ([v], "one")
    return None


def row_numbers_stripped(s: str, every: bool) -> str:
    """The first cell of each row without its number; with ``every``, numbering in all cells as well.

    A whole table comes out as rows joined by commas; other text without a change, and text that is no table, stays
    as it is.
    """
    if not s.strip().startswith("[") or (got := parse_rows(s)) is None:
        return s
    rows, kind = got
    new = []
    for r in rows:
        if isinstance(r, list) and r:
            r = [_first_cell(r[0]), *r[1:]]
            if every:
                r = [unnumbered_lines(c) if isinstance(c, str) else c for c in r]
        new.append(r)
    text = ", ".join(json.dumps(r, ensure_ascii=False) for r in new)
    return text if kind == "table" or new != rows else s


@pandas_udf(StringType())
def strip_row_numbers(s: pd.Series, every: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else row_numbers_stripped(t, bool(e)) for t, e in zip(s, every)], dtype=object)


def rules_prompt(rules: DataFrame) -> DataFrame:
    """All rules in order of id as one prompt (P31); rule sets are small by nature."""
    line = rules.select(F.col("id"), tx.rule_prompt(F.col("id"), F.col("description"), F.col("examples")).alias("t"))
    return line.agg(F.concat(F.lit("Audit Rules:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "t"))), lambda x: x["t"]), "\n")).alias("prompt"))
