from datetime import datetime

from vellora.operators import references as rf

T = [datetime(2024, m, 1) for m in range(1, 13)]
ITEMS = "item_id long, doc_id string, uuid string, uuid_end string, exported_at timestamp, table_name string"
PARAS = "doc_id string, para_id string, para_id_end string, loaded_at timestamp, deleted_at timestamp, ref string"


def run(spark, items, paras):
    r = rf.references(spark.createDataFrame(items, ITEMS), "item_id", ["uuid", "uuid_end"], "doc_id", "exported_at")
    p = rf.parents(spark.createDataFrame(paras, PARAS), ["para_id", "para_id_end"], "doc_id", "loaded_at", "deleted_at")
    return r, p


def test_orphans(spark):
    items = [
        (1, "d", " aa\t", "BB", T[5], "clash"),  # padded, lower case; end exists
        (1, "d", " aa\t", "BB", T[5], "clash"),
        (2, "d", "AA", "", T[0], None),  # before it is loaded
        (3, "d", "AA", None, T[7], None),  # withdrawn at that very moment
        (4, "d", "　", "7", T[5], None),  # blank; a block number
        (5, "e", "AA", "BB", T[5], None),  # another document
        (6, None, "AA", None, T[5], None),
        (7, "d", "AA", None, None, None),
        (8, "d", "AA", None, T[9], None),  # put back
    ]
    paras = [("d", "AA", "bb", T[1], T[7], "x"), ("d", "AA", "bb", T[1], T[7], "x"), ("d", "AA", None, T[9], None, "x"), ("e", None, None, None, None, None)]
    r, p = run(spark, items, paras)
    got = sorted((x.item_id, x.ref_field) for x in rf.orphans(r, p).collect())
    assert got == [(2, "uuid"), (3, "uuid"), (4, "uuid_end"), (5, "uuid"), (5, "uuid_end"), (6, "uuid"), (7, "uuid")]
    why = {(x.item_id, x.ref_field): x.reason for x in rf.explain_orphans(rf.orphans(r, p), p).collect()}
    assert why[2, "uuid"] == "arrives_later" and why[3, "uuid"] == "withdrawn" and why[4, "uuid_end"] == "missing"
    rep = {(x.ref_field, x.period): (x.refs, x.orphan_refs, x.orphan_keys) for x in rf.orphan_report(r, p).collect()}
    assert rep["uuid", T[5]] == (3, 2, 2) and rep["uuid", None] == (1, 1, 1) and rep["uuid_end", T[5]] == (3, 2, 2)


def test_empty_tables(spark):
    r, p = run(spark, [], [])
    assert rf.orphans(r, p).count() == 0 and rf.orphan_report(r, p).count() == 0
    r, p = run(spark, [(1, "d", "AA", None, T[5], None)], [])
    assert rf.orphans(r, p).count() == 1


def test_hot_reference(spark):
    items = [(i, "d", "AA" if i % 3 else "CC", None, T[i % 12], None) for i in range(3000)]
    r, p = run(spark, items, [("d", "AA", None, T[6], None, "x")])
    assert rf.orphans(r, p).count() == sum(1 for i in range(3000) if i % 3 == 0 or i % 12 < 6)
