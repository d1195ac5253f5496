import random

import numpy as np

from vellora.llm import codes
from vellora.llm import leaks as lk
from vellora.llm.queries import Q


def brute(docs, items, n=12):
    idx = {}
    for i, t in items:
        w = lk.words(t)
        for k in range(len(w) - n + 1):
            idx.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [lk.words(t)] for k in range(len(w) - n + 1) for i in idx.get(tuple(w[k : k + n]), ())}


def smith_waterman(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = max(0, m[i][j] + (2 if x == y else -1), m[i][j + 1] - 1, m[i + 1][j] - 1)
    return max(map(max, m))


def test_alignment_is_smith_waterman():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(25))] for _ in range(2))
        score, i, j, longest = lk.align(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))
        assert score == (smith_waterman(a, b) if a and b else 0)
        assert longest == max((k for k in range(len(a) + 1) for p in range(len(a) - k + 1) if any(a[p : p + k] == b[q : q + k] for q in range(len(b) - k + 1))), default=0)
        assert 0 <= i <= len(a) and 0 <= j <= len(b)


def test_whole_tables(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    assert {tuple(r) for r in Q.queries["p6_found"](spark, d).collect()} == brute(docs, items)


def make(spark):
    item = " ".join(f"w{i}" for i in range(40)) + " Straße ÄRGER don't stop"
    edited = " ".join("zz" if i % 9 == 8 else f"w{i}" for i in range(40))
    docs = [
        (1, "Intro. " + item.upper() + " outro", "x"), (2, "w3, w4; w5\nw6 - w7 w8 > w9 w10 w11 w12 w13 w14", "x"), (3, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 no", "x"),
        (4, edited, None), (5, None, None), (6, "", ""), (7, " ".join(["w1 w2"] * 3000), ""), (1, "Intro. " + item.upper() + " outro", "x"),
    ]
    items = [(10, item, "en"), (11, item, "en"), (12, "short one", "en"), (13, None, "en"), (10, item, "en"), (14, "strasse ärger don t stop " + " ".join(f"v{i}" for i in range(9)), "de")]
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string, lang string"), docs, items


def run(corpus, items, **more):
    return lk.leaks(corpus, items, "doc_id", "text", "item_id", "text", **more).collect()


def test_fixture(spark):
    df, bench, docs, items = make(spark)
    got = run(df.drop("item_id"), bench, least_score=0)
    exact = {(r.doc_id, r.item_id) for r in got if r.longest_run >= 12}
    assert exact == brute([x[:2] for x in docs], [x[:2] for x in items]) == {(1, 10), (1, 11), (2, 10), (2, 11)}
    edited = next(r for r in got if (r.doc_id, r.item_id) == (4, 10))
    assert edited.longest_run == 8 and edited.score >= 60 and len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {(r.doc_id, r.item_id) for r in run(df.drop("item_id"), bench)} == {(r.doc_id, r.item_id) for r in got if r.score >= 24 or r.share >= 0.25} >= exact
    assert run(df.drop("item_id").limit(0), bench) == run(df.drop("item_id"), bench.limit(0)) == []


def test_tiles_of_long_texts_give_the_alignment_of_the_whole(spark):
    rng = random.Random(11)
    item = [f"w{i}" for i in range(30)]
    docs = []
    for k in range(12):
        w = [f"z{rng.randrange(50)}" for _ in range(6000)]
        for at in [*rng.sample(range(0, 5900), 5), 500, 1020]:
            copy = [x for i, x in enumerate(item) if rng.random() > 0.1] + ["zz"] * rng.randrange(4) + item[: rng.randrange(30)]
            w[at : at + len(copy)] = copy
        docs.append((k, " ".join(w)))
    got = {r.doc_id: r for r in run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))}
    number = {w: i for i, w in enumerate(sorted({w for _, t in docs for w in t.split()}))}
    for k, t in docs:
        a, b = (np.array([number[w] for w in x], dtype=np.int32) for x in (t.split(), item))
        score, _, _, longest = lk.align(a, b)
        assert (got[k].score, got[k].longest_run) == (score, longest)
        e = got[k].doc_end
        assert lk.align(a[max(0, e - 120) : e], b)[0] == score


def test_alignment_of_many_is_that_of_each():
    rng = random.Random(4)
    pairs = [tuple(np.array([rng.randrange(6) for _ in range(rng.randrange(30))], dtype=np.int32) for _ in range(2)) for _ in range(200)]
    pairs += [tuple(np.array([rng.randrange(90) for _ in range(n)], dtype=np.int32) for n in (130, 400))] + [(np.arange(500, dtype=np.int32),) * 2]
    for cells in (1, 100, 1 << 15):
        assert lk.align_many(pairs, cells) == [lk.align(a, b) for a, b in pairs]
        assert lk.scores([tuple(x.astype(np.int16) for x in p) for p in pairs], cells).tolist() == [lk.align(a, b)[0] for a, b in pairs]


def test_edited_copies_without_and_beside_intact_ones(spark):
    item = [f"w{i}" for i in range(56)]
    edits = {n: " ".join(f"z{i}" if i % n == n - 1 and i < 54 or i == 55 else w for i, w in enumerate(item)) for n in (6, 8, 10, 12)}
    alone = list(edits.items())
    for docs in [[x] for x in alone] + [alone, [*alone, *((100 + k, " ".join(item)) for k in range(3))]]:
        corpus = spark.createDataFrame(docs, "doc_id long, text string")
        got = {r.doc_id: r.score for r in run(corpus, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))}
        assert got == {k: smith_waterman(lk.words(t), item) for k, t in docs}


def test_recall_of_edited_copies(spark):
    got = Q.queries["p6_recall"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.every for r in got) == [6, 8, 10, 12] and all(r.found == r.planted > 200 for r in got)


def test_a_full_filter_only_passes_more(spark, monkeypatch):
    df, bench, docs, items = make(spark)
    want = sorted(map(tuple, run(df.drop("item_id"), bench)))
    monkeypatch.setattr(lk, "_filter", lambda grams: np.full(1 << (lk.FILTER_BITS - 3), 255, dtype=np.uint8))
    assert sorted(map(tuple, run(df.drop("item_id"), bench))) == want


def test_words_of_many_texts(spark):
    texts = ["Straße İstanbul x_y", None, "", "a1 b-2", "ÄRGER\nü"]
    h, at = codes.words(texts)
    one = lambda w: int(codes.words([w])[0][0])
    assert [h[i:j].tolist() for i, j in zip(at, at[1:])] == [[one(w) for w in lk.words(t)] for t in texts]
