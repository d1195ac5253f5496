import json

import pytest
from pyspark.sql import functions as F

from vellora.operators import flatten as fl
from vellora.plans.integrity import _raw

FIELDS = set(fl.VIOLATION_FIELDS)


def places(raw):
    """(entry_no, child_no) by plain parsing."""
    try:
        v = json.loads(raw) if raw is not None else None
    except ValueError:
        return
    if isinstance(v, list):
        entries = v
    elif not isinstance(v, dict):
        return
    elif v.get("entries") is not None:
        entries = v["entries"] if isinstance(v["entries"], list) else [v["entries"]]
    elif v.get("entry") is not None:
        entries = [v["entry"]]
    else:
        entries = [] if v.get("type") == "meta" else [v]
    for i, e in enumerate(entries):
        if not isinstance(e, dict):
            continue
        x = e.get("violations")
        if isinstance(x, str):
            try:
                x = json.loads(x)
            except ValueError:
                x = None
        if isinstance(x, dict):
            if "items" in x:
                x = x["items"]
                x = [x] if isinstance(x, dict) else x
            elif FIELDS & x.keys():
                x = [x]
            else:
                x = [z for y in x.values() for z in (y if isinstance(y, list) else [y] if isinstance(y, dict) else [])]
        for j, z in enumerate(x if isinstance(x, list) else []):
            if isinstance(z, dict):
                yield i, j


LINES = [
    '{"uuid":"A","violations":[{"rule_id":"R1"},null,{"rule_id":"R2","x":{"deep":[1]}}]}',
    '  {"entry":{"violations":{"R1":[{"uuid":"a"},null],"R2":[{"uuid":"b"}]}},"run":1}\n',
    '{"type":"batch","entries":[null,{"violations":{"items":[{"rule_id":"R1"}],"total":1}},{"violations":"[{\\"rule_id\\": \\"R1\\"}]"},{"violations":{}}]}',
    '{"violations":{"rule_id":"R1","violation_text":"x"}}',
    '{"violations":{"unknown":[{"uuid":"a"}],"R9":[{"uuid":"b","rule_id":"R8"}]}}',
    '{"type":"meta","violations":[{"rule_id":"R1"}]}',
    '{"violations":[{"rule_id":"R1"}',
    '{"violations":[{"rule_id":"R1"}]} tail',
    '{"violations":[{"rule_id":"R1"}]},{"violations":[]}',
    '{"violations":"not json"}',
    '{"violations":"[{\\"rule_id\\": \\"R"}',
    '{"violations":7,"is_violation":"odd"}',
    '{"violations":[1,"two",{"rule_id":3}]}',
    '[{"violations":[{"rule_id":"R1"}]}]',
    "12", '"text"', "", " ", "null", None,
]


def test_lines_of_all_shapes(spark):
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(LINES)], "k string, raw string")
    got = fl.flatten(fl.parse_lines(df, "raw"), ["k"], ["entries", "violations"], ["entry_no", "child_no"]).collect()
    assert sorted((r.k, r.entry_no, r.child_no) for r in got) == sorted((str(i), *p) for i, s in enumerate(LINES) for p in places(s))
    rules = {(r.k, r.child_no): r.rule_id for r in got}
    assert rules["1", 0] == "R1" and rules["1", 2] == "R2"
    assert rules["4", 0] is None and rules["4", 1] == "R8" and rules["12", 2] == "3"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_raw_table(spark, sf):
    d = f"/root/testdata/{sf}"
    got = {(r.parent_key, r.entry_no, r.child_no) for r in _raw(spark, d).select("parent_key", "entry_no", "child_no").collect()}
    rows = spark.read.parquet(f"{d}/manifest_raw.parquet").select("line_id", "raw").collect()
    assert got == {(str(r.line_id), *p) for r in rows for p in places(r.raw)}


def test_flatten_nulls_and_clashing_names(spark):
    df = spark.createDataFrame(
        [(1, [(5, "a"), None, (6, None)], "x"), (2, [], "y"), (3, None, None), (1, [(5, "a")], "x")],
        "k long, items array<struct<k:long,v:string>>, other string",
    )
    got = sorted(map(tuple, fl.flatten(df, ["k"], ["items"], ["no"]).collect()))
    assert got == [(1, 0, 5, "a"), (1, 0, 5, "a"), (1, 2, 6, None)]
    assert fl.flatten(df, ["k"], ["items"], ["no"]).columns == ["k", "no", "child_k", "v"]
    assert len(fl.flatten(df, ["k"], ["items"], ["no"], keep_nulls=True).collect()) == 4
    assert fl.flatten(df.limit(0), ["k"], ["items"], ["no"]).count() == 0


def test_scalars_and_three_levels(spark):
    df = spark.createDataFrame([(1, [([([1, 2],), None],), (None,), ([([None, 3],)],)])], "k long, a array<struct<b:array<struct<c:array<int>>>>>")
    got = fl.flatten(df, ["k"], ["a", "b", "c"], ["i", "j", "l"])
    assert [tuple(r) for r in got.orderBy("i", "j", "l").collect()] == [(1, 0, 0, 0, 1), (1, 0, 0, 1, 2), (1, 2, 0, 1, 3)]
    t = fl.child_tables(df, ["k"], "a", "t")
    assert set(t) == {"t", "t_b", "t_b_c"} and t["t_b_c"].count() == 3 and t["t"].columns == ["k", "a_no"]


def test_long_list_is_flattened_once(spark):
    df = spark.range(3).select(F.col("id").alias("k"), F.expr("sequence(0, 50000)").alias("a"))
    assert fl.flatten(df, ["k"], ["a"], ["no"]).filter("no <> value").count() == 0
