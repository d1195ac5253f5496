import numpy as np
import pytest
from pyspark.sql import functions as F

from vellora.llm import packing as pk

COLS = "doc_id long, text string, source string, container string"


def test_partition_packs_all_within_capacity():
    rng = np.random.default_rng(1)
    sizes = np.minimum(2048, rng.lognormal(4.5, 1.0, 5000).astype(int))
    source = rng.choice(["a", "b", "c"], 5000, p=[0.7, 0.2, 0.1])
    c, w = pk.pack_partition(sizes, source, {"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 500.0, "b": -400.0}, 2048, 16)
    fill = np.bincount(c, weights=sizes)
    assert c.min() >= 0 and fill.max() <= 2048
    assert len(fill) - -(-sizes.sum() // 2048) <= 2
    # each window is mixed, but for what is carried
    total = np.bincount(w, weights=sizes)
    for s in "abc":
        share = np.bincount(w, weights=sizes * (source == s), minlength=len(total)) / total
        assert abs(share[1:-1] - sizes[source == s].sum() / sizes.sum()).max() < 0.08
    # and the containers along the way
    for k in range(200, len(fill) - 200, 200):
        some = (c >= k) & (c < k + 200)
        assert abs(sizes[some & (source == "a")].sum() / sizes[some].sum() - sizes[source == "a"].sum() / sizes.sum()) < 0.12


@pytest.mark.parametrize("share", [{"a": 1.0, "b": 0.0}, {"a": 0.0, "b": 0.0}, {"a": 0.5, "b": 0.5}])
def test_odd_mixtures_end(share):
    c, _ = pk.pack_partition(np.array([10, 10, 0, 7, 10]), np.array(["a", "b", "b", "a", "b"]), share, {}, 10, 1)
    assert sorted(np.bincount(c, weights=[10, 10, 0, 7, 10])) == [7, 10, 10, 10]


def test_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    p = pk.pack(d, "doc_id", "text", "source", rows_per_part=300).cache()
    enc = pk.encoder(pk.VOCABULARY)
    want = {r.doc_id: len(enc.encode_ordinary(r.text)) if r.text else 0 for r in d.collect()}
    got = p.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("m")).collect()
    assert {r.doc_id: r.n for r in got} == want
    assert all(r.m == max(1, -(-want[r.doc_id] // 2048)) for r in got)
    rep = pk.fill_report(p).first()
    assert rep.fullest <= 2048 and rep.left_over < 0.05
    mix = pk.mix_report(p, "source").collect()
    assert abs(sum(r.share for r in mix) - 1) < 1e-9 and all(r.mean_off < 0.1 for r in mix)


def test_layout_of_the_files_does_not_matter(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    d = d.union(d.limit(3)).union(spark.createDataFrame([(7, "many words " * 3000, "s")] * 2, "doc_id long, text string, source string"))
    run = lambda x: sorted(map(tuple, pk.pack(x, "doc_id", "text", "source", rows_per_part=60).collect()), key=str)
    assert run(d) == run(d.repartition(7).orderBy(F.desc("text")))


def test_dirty_rows(spark):
    rows = [(1, "a b c " * 2000, "s", "x"), (2, None, None, None), (3, "", "s", None), (4, "hello", None, None), (None, "hello", "t", None), (4, "hello", None, None)]
    p = pk.pack(spark.createDataFrame(rows, COLS), "doc_id", "text", "source", capacity=256, mix={"t": 2.0, "gone": 1.0}).collect()
    assert len([r for r in p if r.doc_id == 4]) == 2
    big = sorted((r for r in p if r.doc_id == 1), key=lambda r: r.piece)
    assert [r.token_from for r in big] == [256 * i for i in range(len(big))] and all(r.n_tokens == 256 for r in big[:-1])
    assert pk.pack(spark.createDataFrame([], COLS), "doc_id", "text", "source").count() == 0
