"""Nested lists to flat child tables on Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ordinals(parents: np.ndarray) -> np.ndarray:
    """Place from 0 of each child within its parent; parents are runs in order."""
    n = len(parents)
    at = np.arange(n, dtype=np.int64)
    if n == 0:
        return at
    new = np.ones(n, dtype=bool)
    new[1:] = parents[1:] != parents[:-1]
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _level(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Parent index of each child, and the children, from the list's offsets."""
    return pc.list_parent_indices(col).to_numpy(zero_copy_only=False), pc.list_flatten(col)


def flatten(df: DataFrame, keys: list[str], path: list[str], ordinals: list[str], keep_nulls: bool = False) -> DataFrame:
    """Children of the nested lists along ``path`` as flat rows: keys, one ordinal per level, then the child's fields.

    ``path`` names a list column, then list fields inside its structs. A child that is a struct gives its fields, any
    other child the column ``value``; fields named like a key or an ordinal get the prefix ``child_``. Ordinals count
    from 0 in written order. Null and empty lists give no rows; null elements keep their place and are left out unless
    ``keep_nulls``. Only buffers move: parent indices come from the list offsets, keys follow by take.
    """
    kind = df.schema[path[0]].dataType.elementType
    for p in path[1:]:
        kind = kind[p].dataType.elementType
    fields = list(kind.fields) if isinstance(kind, T.StructType) else [T.StructField("value", kind)]
    taken = {*keys, *ordinals}
    names = [f"child_{f.name}" if f.name in taken else f.name for f in fields]
    schema = T.StructType(
        [T.StructField(k, df.schema[k].dataType) for k in keys]
        + [T.StructField(o, T.IntegerType()) for o in ordinals]
        + [T.StructField(n, f.dataType) for n, f in zip(names, fields)]
    )
    struct, sub = isinstance(kind, T.StructType), [f.name for f in fields]
    out_names = [*keys, *ordinals, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            root = np.arange(b.num_rows, dtype=np.int64)
            child: pa.Array = b.column(b.schema.get_field_index(path[0]))
            places: list[np.ndarray] = []
            for depth in range(len(path)):
                if depth:
                    child = pc.struct_field(child, path[depth])
                up, child = _level(child)
                places = [p[up] for p in places] + [_ordinals(up)]
                root = root[up]
            if not keep_nulls:
                keep = pc.is_valid(child)
                mask = keep.to_numpy(zero_copy_only=False)
                child, root, places = child.filter(keep), root[mask], [p[mask] for p in places]
            take = pa.array(root)
            cols = [b.column(b.schema.get_field_index(k)).take(take) for k in keys]
            cols += [pa.array(p, pa.int32()) for p in places]
            cols += [pc.struct_field(child, s) for s in sub] if struct else [child]
            yield pa.RecordBatch.from_arrays(cols, names=out_names)

    return df.select(*keys, path[0]).mapInArrow(run, schema)


def child_tables(df: DataFrame, keys: list[str], root: str, name: str) -> dict[str, DataFrame]:
    """Every list of structs or scalars under ``root`` as its own table, tied by keys and ordinals.

    The table ``name`` holds the children of ``root``; a list field f inside them gives ``name_f``, which carries the
    ordinals of all levels above. List fields themselves are left out of the parent's table.
    """
    tables: dict[str, DataFrame] = {}

    def walk(kind: T.DataType, path: list[str], label: str) -> None:
        flat = flatten(df, keys, path, [f"{p}_no" for p in path])
        lists = [f for f in kind.fields if isinstance(f.dataType, T.ArrayType)] if isinstance(kind, T.StructType) else []
        tables[label] = flat.drop(*[f.name for f in lists])
        for f in lists:
            walk(f.dataType.elementType, [*path, f.name], f"{label}_{f.name}")

    walk(df.schema[root].dataType.elementType, [root], name)
    return tables


VIOLATION_FIELDS = ["rule_id", "uuid", "uuid_end", "violation_text", "violation_reason", "fix_action", "revised_text", "category"]
_VIOLATION = "struct<" + ",".join(f"{f}:string" for f in VIOLATION_FIELDS) + ">"
_ENTRY = "struct<uuid:string,uuid_end:string,p_heading:string,p_content:string,is_violation:string,violations:string>"


def _starts(c: Column, s: str) -> Column:
    return F.ltrim(c, F.lit(" \t\r\n")).startswith(s)


def _items(c: Column) -> Column:
    """JSON text of a list as its elements' texts; an object is a list of one; anything else none."""
    return F.when(_starts(c, "["), F.from_json(c, "array<string>")).when(_starts(c, "{"), F.array(c))


def _violations(c: Column) -> Column:
    """array<struct<rule, text>> of one entry's violations in written order, whatever shape holds them.

    Shapes: list; text holding a list; one violation object; {items: [...]}; {rule id: [...]} (lists in written order).
    """
    plain = lambda a: F.transform(a, lambda x: F.struct(F.lit(None).cast("string").alias("rule"), x.alias("text")))
    m = F.from_json(c, "map<string,string>")
    keys = F.map_keys(m)
    by_rule = F.flatten(
        F.transform(
            F.map_entries(m),
            lambda e: F.transform(F.coalesce(_items(e["value"]), F.array().cast("array<string>")), lambda x: F.struct(e["key"].alias("rule"), x.alias("text"))),
        )
    )
    obj = (
        F.when(F.array_contains(keys, "items"), plain(_items(F.try_element_at(m, F.lit("items")))))
        .when(F.arrays_overlap(keys, F.array(*[F.lit(f) for f in VIOLATION_FIELDS])), plain(F.array(c)))
        .otherwise(by_rule)
    )
    return F.when(_starts(c, "["), plain(F.from_json(c, "array<string>"))).when(_starts(c, "{"), obj)


def parse_lines(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``entries``: array<struct<uuid, .., violations: array<violation>>>, of JSON lines in any of the known shapes.

    A line is one entry, ``{"entry": {...}}`` or ``{"entries": [...]}``. Lines that are null, not exactly one JSON
    value, or a meta record get null. All parsing is by built-in expressions; every field is text, so an odd type
    never spoils a line. Rule-keyed violations get the key as rule_id unless they carry their own or it is "unknown".
    """
    one = F.from_json(F.concat(F.lit("["), F.col(raw), F.lit("]")), "array<string>")
    line = F.when(F.size(one) == 1, F.get(one, F.lit(0)))
    head = F.from_json(F.col("_line"), "struct<type:string,entry:string,entries:string>")
    entries = (
        F.when(_starts(F.col("_line"), "["), F.from_json(F.col("_line"), "array<string>"))
        .when(F.col("_h.entries").isNotNull(), _items(F.col("_h.entries")))
        .when(F.col("_h.entry").isNotNull(), F.array(F.col("_h.entry")))
        .when(_starts(F.col("_line"), "{") & ~F.col("_h.type").eqNullSafe("meta"), F.array(F.col("_line")))
    )
    nothing = F.lit(None).cast(_VIOLATION)

    def violation(x: Column) -> Column:
        v = F.from_json(x["text"], _VIOLATION)
        rule = F.coalesce(v["rule_id"], F.when(x["rule"] != "unknown", x["rule"]))
        return F.when(_starts(x["text"], "{"), F.struct(rule.alias("rule_id"), *[v[f].alias(f) for f in VIOLATION_FIELDS[1:]])).otherwise(nothing)

    def entry(x: Column) -> Column:
        e = F.from_json(x, _ENTRY)
        return F.when(
            _starts(x, "{"),
            F.struct(*[e[f].alias(f) for f in ("uuid", "uuid_end", "p_heading", "p_content", "is_violation")], F.transform(_violations(e["violations"]), violation).alias("violations")),
        )

    return (
        df.withColumn("_line", line).withColumn("_h", head).withColumn("_e", entries)
        .withColumn("entries", F.transform("_e", entry)).drop("_line", "_h", "_e")
    )
