import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellora.llm import segment as sg


def estimate(t):
    cjk = sum("一" <= c <= "龥" for c in t)
    js = sum(c in '[]",{}' for c in t)
    return int((cjk * 0.75 + js * 1.0 + (len(t) - cjk - js) * 0.4) * 1.05) + 2 if t else 0


def check(text, limit, overlap):
    p = sg.cuts(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text)
    assert all(estimate(text[a:b]) <= limit for a, b, _ in p)
    whole = text[: p[0][1]]
    for (a, b, _), (c, e, _) in zip(p, p[1:]):
        assert a < c <= b < e
        assert estimate(text[c:b]) <= overlap + 2
        whole += text[b:e]
    assert whole == text
    return p


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "字数", ". ", "\n", "。", ", ", " ", '["a", "b"], ', "é́", "x" * 50, "👍🏽", "\r\n"]), min_size=50, max_size=600).map("".join), st.integers(60, 300), st.integers(0, 14))
def test_pieces_fit_and_give_the_text_back(text, limit, overlap):
    check(text, limit, overlap)


def test_natural_boundaries_come_first():
    lines = "\n".join("The pump of hall %d was checked and noted in the book." % i for i in range(200))
    p = check(lines, 500, 40)
    assert all(lv == 0 for _, _, lv in p[:-1])
    p = check("One two three four five. " * 300, 500, 40)
    assert all(lv == 1 for _, _, lv in p[:-1])
    p = check("第一项检查完成。" * 500, 500, 40)
    assert all(lv == 1 for _, _, lv in p[:-1])
    rows = "<table>[" + ", ".join('["pump", "%d", "final"]' % i for i in range(400)) + "]</table>"
    assert all(rows[b:].startswith('["') for _, b, _ in check(rows, 500, 40)[:-1])
    assert all(lv == 4 for _, _, lv in check("x" * 5000, 500, 40)[:-1])


def test_cut_is_at_the_change_of_topic():
    rng = random.Random(1)
    topic = lambda ws, n: [" ".join(rng.choice(ws) for _ in range(8)) + "." for _ in range(n)]
    a = topic("river bridge water dam flood boat pier quay".split(), 30)
    b = topic("oven bread flour yeast salt crust loaf dough".split(), 30)
    text = "\n".join(a + b)
    p = check(text, 800, 0)
    assert len("\n".join(a)) + 1 in [e for _, e, _ in p]


def test_depth_comes_before_the_kind_of_place():
    rng = random.Random(2)
    topic = lambda ws, n: " ".join(" ".join(rng.choice(ws) for _ in range(8)).capitalize() + "." for _ in range(n))
    a = topic("river bridge water dam flood boat pier quay".split(), 14)
    b = topic("oven bread flour yeast salt crust loaf dough".split(), 30)
    border = len(a) + 1
    for feed in (70, 97, 150):  # a line feed a little further on, inside the second topic
        at = b.index(". ", feed) + 1
        text = a + " " + b[:at] + "\n" + b[at + 1 :]
        assert border in [e for _, e, _ in check(text, 400, 20)]
    # of equal valleys the line break is taken
    flat = "one two three four five six. " * 40
    text = flat[:580] + "\n" + flat[580:]
    assert 581 in [e for _, e, _ in check(text, 300, 0)]


def test_planted_topics(spark):
    from vellora.llm.queries import Q

    got = Q.queries["p3_topics"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) >= 8 and sum(r.off == 0 for r in got) >= 0.9 * len(got)


def test_similarity_is_the_cosine_of_both_sides():
    rng = random.Random(5)
    t = sg._Terms(" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(900)))
    places = np.array(sorted(rng.sample(range(0, 1500), 400)))
    for width in (1, 7, 60):
        for p, got in zip(places, t.similarity(places, width)):
            m = int(np.searchsorted(t.at, p))
            x, y = (np.bincount(z, minlength=512).astype(float) for z in (t.term[max(0, m - width) : m], t.term[m : m + width]))
            norm = np.sqrt((x @ x) * (y @ y))
            assert abs(got - (x @ y / norm if norm else 0)) < 1e-5


def test_operator(spark):
    big = "Sentence with words. " * 200
    rows = [(1, "d", "h", ["a", None], big, "clash"), (1, "d", "h", ["a", None], big, "clash"), (2, "d", None, None, "short", None), (3, None, None, [], None, None), (4, "d", "", [], "", None)]
    df = spark.createDataFrame(rows, "block_idx int, doc_id string, heading string, parent_headings array<string>, content string, piece string")
    got = sg.split_oversized(df, "content", 300, 20).drop("piece").count()
    out = sg.split_oversized(df, "content", 300, 20, keep=["block_idx", "heading", "parent_headings"]).orderBy("piece_no").collect()
    assert got == len(out) and {r.block_idx for r in out} == {1}
    assert all(r.heading == "h" and r.parent_headings == ["a", None] and r.n_pieces == len(out) // 2 for r in out)
    every = sg.pieces(df, "content", 300, 20)
    assert {r.block_idx for r in every.filter("n_pieces = 1").collect()} == {2, 4}
    assert sg.split_oversized(df.limit(0), "content").count() == 0
    with pytest.raises(ValueError):
        sg.split_oversized(df, "content", 100, 50)


def test_estimate_at_the_limit(spark):
    from vellora.functions.text import estimate_tokens

    texts = ["", "a", "字" * 9, '[]",{}', "x" * 19040, "x" * 19046, "字" * 10156, "é漢\U0001f44d", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(estimate_tokens(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [estimate(t) if t else 0 for t in texts]
