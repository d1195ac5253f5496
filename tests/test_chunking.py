import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellora.functions import tables as tb
from vellora.operators import chunking as ch
from vellora.operators import structure as so
from vellora.plans import blocks

LEVELS = "doc_id string, pos long, text string, para_id string, para_id_end string, is_table boolean, level int"


def block(tokens, level=1, role="none"):
    return (0, 0, round((tokens - 2) / 1.05 / 0.4)), level, role


def test_merge_cases():
    assert ch.merge_plan([block(100), block(200)]) == [[0, 1]]
    assert ch.merge_plan([block(100, 1), block(200, 2)]) == [[0, 1]]
    assert ch.merge_plan([block(6100), block(900)]) == [[0, 1]]
    assert ch.merge_plan([block(6100), block(1100)]) == [[0], [1]]
    assert ch.merge_plan([block(6500), block(400), block(6500), block(300)]) == [[0], [1, 2, 3]]
    assert ch.merge_plan([block(100), block(100, 1, "middle"), block(100)]) == [[0], [1], [2]]
    assert ch.merge_plan([block(100, 1, "first"), block(100)]) == [[0, 1]]
    assert ch.merge_plan([block(100, 1, "first"), block(100, 1, "last")]) == [[0, 1]]
    assert ch.merge_plan([]) == [] and ch.merge_plan([block(5)]) == [[0]]


sizes = st.lists(st.tuples(st.sampled_from([50, 300, 900, 1500, 3000, 4500, 5900, 6050, 7000, 7600, 7950]), st.integers(1, 3), st.sampled_from(["none", "none", "none", "first", "middle", "last"])), min_size=1, max_size=14)


@settings(max_examples=300, deadline=None)
@given(sizes)
def test_stretches_are_independent(spec):
    blocks = [block(*x) for x in spec]
    whole = ch.merge_plan(blocks)
    starts = [0] + [i for i in range(1, len(blocks)) if ch.size(*(a + b for a, b in zip(blocks[i - 1][0], blocks[i][0])), ) > 0 and ch.size(blocks[i - 1][0][0] + blocks[i][0][0], blocks[i - 1][0][1] + blocks[i][0][1], blocks[i - 1][0][2] + blocks[i][0][2] + 2) > ch.LIMIT] + [len(blocks)]
    parts = []
    for a, b in zip(starts, starts[1:]):
        nxt = blocks[b] if b < len(blocks) else None
        after = (nxt[1], ch.size(*nxt[0])) if nxt and nxt[2] != "middle" else None
        parts += [[a + i for i in g] for g in ch.merge_plan(blocks[a:b], after)]
    assert parts == whole
    assert [i for g in whole for i in g] == list(range(len(blocks)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(5, 900), st.booleans()), min_size=1, max_size=60))
def test_long_split(spec):
    paras = [("anchor" if a else None, (0, 0, n * 3)) for n, a in spec]
    plan = ch.split_plan(paras, "H", 600, 800)
    assert [i for s, e, _, _ in plan for i in range(s, e)] == list(range(len(paras)))
    assert plan[0][2] in ("H", "anchor") and all(m[0] == "H" for _, _, _, m in plan if m)


def test_chunks_of_a_table_have_their_own_ids_and_its_header(spark):
    rows = [[f"{i}", "cell " * 60] for i in range(300)]
    ids, ends = [[f"S{i}", f"T{i}"] for i in range(300)], [[f"U{i}", f"V{i}"] for i in range(300)]
    text = f"<table>{json.dumps(rows)}</table>"
    s = LEVELS + ", table_header array<array<string>>, row_ids array<array<string>>, row_ends array<array<string>>"
    head = [["no", "what"]]
    df = spark.createDataFrame([("d", 0, "Head", "A", None, False, 1, None, None, None), ("d", 1, text, "S0", "V299", True, None, head, ids, ends), ("d", 2, "after", "Z", None, False, None, None, None, None)], s)
    want = ch.table_pieces(rows)
    placed = ch.place_tables(df).filter("is_table").orderBy("sub").collect()
    assert [(r.para_id, r.para_id_end) for r in placed] == [(f"S{a}", f"V{b - 1}") for a, b in want] and len(want) > 3
    b = ch.build_blocks(df).orderBy("block_idx").collect()
    keys = [r.uuid for r in b]
    assert len(set(keys)) == len(keys) == len(want) and keys[0] == "A" and keys[1:] == [f"S{a}" for a, _ in want[1:]]
    assert b[0].table_header is None and all(r.table_header == head for r in b[1:]) and [r.uuid_end for r in b] == [f"V{e - 1}" for _, e in want[:-1]] + ["Z"]
    assert b[1].heading == f"Head [{ch.SUFFIX}1]" and not any(r.oversize for r in b)
    # without ids per row the table's own stand for all chunks
    plain = ch.place_tables(df.drop("row_ids", "row_ends")).filter("is_table").collect()
    assert {(r.para_id, r.para_id_end) for r in plain} == {("S0", "V299")}


def test_blocks_no_anchor_can_part_are_marked(spark):
    df = spark.createDataFrame([("d", k, "x" * 9000, f"P{k}", None, False, None) for k in range(3)], LEVELS)
    assert [(r.oversize, r.tokens > ch.LIMIT) for r in ch.build_blocks(df).collect()] == [(True, True)]
    try:
        ch.build_blocks(df, strict=True).collect()
    except Exception as e:
        assert "no anchor" in str(e)
    else:
        raise AssertionError


def test_long_split_takes_the_nearest_anchor():
    paras = [(None, (0, 0, 3000))] * 4 + [("Mid", (0, 0, 3))] + [(None, (0, 0, 3000))] * 4
    assert ch.split_plan(paras, "H", 6000, 8000) == [(0, 4, "H", ()), (4, 9, "Mid", ("H",))]
    assert ch.split_plan([(None, (0, 0, 90000))] * 2, "H") == [(0, 2, "H", ())]
    assert ch.split_plan([("H", (0, 0, 3)), (None, (0, 0, 90000))], "H") == [(0, 2, "H", ())]


def test_table_pieces():
    rows = [["item", "x" * 40, str(i)] for i in range(400)]
    p = ch.table_pieces(rows)
    assert p[0][0] == 0 and p[-1][1] == 400 and all(a[1] == b[0] for a, b in zip(p, p[1:])) and len(p) > 1
    for a, b in p:
        t = json.dumps(rows[a:b], ensure_ascii=False)
        assert ch.size(*ch.counts(t)) <= ch.TABLE_LIMIT
    assert ch.table_pieces(rows[:3]) == [(0, 3)] and ch.table_pieces([]) == [(0, 0)]


def test_blocks_over_stretches(spark):
    rng = random.Random(2)
    rows = []
    for d in "ab":
        for i in range(120):
            lv = rng.choice([None, None, None, 1, 2, 3])
            rows.append((d, i * 3, f"{d}{i}", f"P{i}", None, False, lv))
    df = spark.createDataFrame(rows, LEVELS)
    small = so.number_blocks(df, size=7).select("doc_id", "pos", "block_no").collect()
    want, seen = {}, {}
    for d in "ab":
        no, body = 0, False
        for r in (x for x in rows if x[0] == d):
            if r[6] and body:
                no, body = no + 1, False
            body |= r[6] is None
            want[d, r[1]] = no
        seen[d] = no
    assert {(r.doc_id, r.pos): r.block_no for r in small} == want
    up = {(r.doc_id, r.pos): r.parent_headings for r in so.parent_headings(df.filter("level is not null").select("doc_id", "pos", "text", "level"), size=11).collect()}
    for d in "ab":
        stack = {}
        for r in (x for x in rows if x[0] == d and x[6]):
            stack = {k: v for k, v in stack.items() if k < r[6]}
            assert up[d, r[1]] == [stack[k] for k in sorted(stack)]
            stack[r[6]] = r[2]
    sums = {(r.doc_id, r.pos): r.s for r in so.prefix_sum(df, "doc_id", ["pos"], F.col("pos"), "s", size=5).collect()}
    assert sums["a", 30] == sum(range(0, 30, 3))
    assert so.unsplit_blocks(df.limit(0)).count() == 0


def test_pipeline_keeps_all_text(spark):
    row = ", ".join(json.dumps(["cell", "x" * 60, str(i)]) for i in range(600))
    rows = [("d", 0, "Intro", "A0", None, False, 1), ("d", 1, "Before", "A1", None, False, None), ("d", 2, f"<table>[{row}]</table>", "A2", "A3", True, None), ("d", 3, "After", "A4", None, False, None), ("d", 4, "Next", "A5", None, False, 1)]
    rows += [("d", 5 + i, ("Short %d" % i) if i % 4 == 0 else "word " * 900, f"B{i}", None, False, None) for i in range(40)]
    rows += [("e", 0, "only", "C0", None, False, None)]
    out = ch.build_blocks(spark.createDataFrame(rows, LEVELS)).orderBy("doc_id", "block_idx").collect()
    assert all(r.tokens <= ch.LIMIT for r in out)
    text = "".join(r.content for r in out if r.doc_id == "d")
    assert all(f'"{i}"' in text for i in range(600)) and text.count("word") == 900 * sum(i % 4 != 0 for i in range(40))
    assert any("表格片段1" in r.heading for r in out) and {r.heading for r in out if r.doc_id == "e"} == {so.PREFACE}
    assert [r.block_idx for r in out if r.doc_id == "d"] == list(range(sum(r.doc_id == "d" for r in out)))


def test_row_numbers():
    f = tb.row_numbers_stripped
    assert f('["1", "1. Intro", "2. Body"]', True) == '["", "Intro", "Body"]'
    assert f('["1", "A"], ["2", "B"]', True) == '["", "A"], ["", "B"]'
    assert f('[["1", "A"], ["2", "B"]]', True) == '["", "A"], ["", "B"]'
    assert f('["1", "a) x"]', False) == '["", "a) x"]'
    assert f('["content"]', True) == '["content"]' and f("no table", True) == "no table" and f('["broken', True) == '["broken'
    assert f('["", "a) First\\nb) Second"]', True) == '["", "First\\nSecond"]'


def test_all_items_are_packed(spark):
    d = "/root/testdata/sf0.01"
    rows = sorted({tuple(r) for r in spark.read.parquet(f"{d}/edit_items.parquet").select("rule_id", "item_id", "violation_text").collect() if r.rule_id is not None and r.violation_text is not None})
    assert any("一" <= c <= "龥" for r in rows for c in r[2]) and any(c in '[]",{}' for r in rows for c in r[2])
    want, state = [], {}
    for rule, item, t in rows:
        own = (sum("一" <= c <= "龥" for c in t), sum(c in '[]",{}' for c in t))
        own = (*own, len(t) - sum(own))
        tot, no = state.get(rule, ((0, 0, 0), 0))
        more = tuple(a + b for a, b in zip(tot, own))
        full = rule in state and int((more[0] * 0.75 + more[1] * 1.0 + more[2] * 0.4) * 1.05) + 2 > 2000
        state[rule] = (own, no + 1) if full else (more, no)
        want.append((rule, item, state[rule][1]))
    got = [tuple(r) for r in blocks.queries["chunk_pack_items"](spark, d).collect()]
    assert sorted(got) == sorted(want) and max(w[2] for w in want) > 0


def test_later_chunks_keep_the_header_rows(spark):
    head = [["No", "Name"]]
    big = json.dumps(head + [[str(i), "cell text of some length " * 4] for i in range(420)])
    rows = [("d", 0, "Heading", "P0", None, False, 1, None), ("d", 1, f"<table>{big}</table>", "P1", "P2", True, None, head), ("d", 2, "after " * 900, "P3", None, False, None, None), ("d", 3, f"<table>{json.dumps(head)}</table>", "P4", "P5", True, None, head)]
    df = spark.createDataFrame(rows, LEVELS + ", table_header array<array<string>>")
    got = [r for r in ch.build_blocks(df).orderBy("block_idx").collect()]
    assert len(got) >= 3 and got[0].table_header is None and "middle" in {r.table_chunk_role for r in got}
    assert all(r.table_header == head for r in got[1:] if "cell text" in r.content)
    assert all(r.table_header is None for r in ch.build_blocks(df.drop("table_header")).collect())
