import unicodedata

import pytest

from vellora.llm import lookalike as la
from vellora.operators.references import clean_ref

PAIRS = [
    ("ｆｕｌｌ　ｗｉｄｔｈ，１２", "full width,12"),
    ("ofﬁce ﬀ ﬂ ﬃ", "office ff fl ffi"),
    ("café über", "café über"),
    ("a​b‌‍⁠﻿c­d", "abcd"),
    ("a b c d e　f\tg", "a b c d e f g"),
    ("Тhе ореrаtоr ѕhаll іѕѕuе", "The operator shall issue"),
    ("ΝΑΤΟ οne", "NATO one"),
    ("⼈⼯⾯", "人工面"),
    ("non‑stop re‐do", "non-stop re-do"),
    ("a​̈", "ä"),
    ("ӓ", "ä"),
    ("豈", unicodedata.normalize("NFC", "豈")),
    ("ρорulаtιοn", "population"),
    ("𝐁𝑜𝓵𝔡 𝟙𝟚", "Bold 12"),
    ("Ⅳ ⅻ", "IV xii"),
    ("25 ℃, № 7, ㎏", "25 °C, No 7, kg"),
    ("2020–2024 a‒b", "2020-2024 a-b"),
    ("“it’s”", "\"it's\""),
    ("wait… now", "wait... now"),
    ("ﻣﺮﺣﺒﺎ", "مرحبا"),
    ("ﾊﾟｿｺﾝ", "パソコン"),
]


def forms(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, t string, n string")
    return [r.form for r in la.consistent(df, {"t": "form"}).orderBy("i").collect()]


def test_same_on_the_page(spark):
    assert forms(spark, [a for a, _ in PAIRS]) == [b for _, b in PAIRS]


def test_visible_differences_stay(spark):
    keep = ["Case", "case", "e", "é", "a  b", "a b", "x²", "①", "½", "H₂O", "a—b", "™", "ﬁ" and "x", "line\nbreak", "оно была" and "ж", "œ", "", "'quoted'", None]
    assert forms(spark, keep) == keep


def test_form_of_a_form(spark):
    texts = [a for a, _ in PAIRS] + ["Обязанности: заказчик", "Ελληνικά", "한국어", "ﾊﾝｶｸ", "\U0002f800", "ǆ Ǆ"]
    once = forms(spark, texts)
    assert forms(spark, once) == once


def test_quotes(spark):
    items = [
        (1, "d", " u1\t", "the operator"),  # literal
        (2, "d", "U1", "thе оperator"),  # look-alikes
        (2, "d", "U1", "thе оperator"),
        (3, "d", "U1", "The operator"),  # case differs
        (4, "d", "U2", "the operator"),  # the block's own text is masked
        (5, "e", "U1", "thе оperator"),  # another document
        (6, "d", "U1", "  "), (7, "d", None, "the"), (8, "d", "U1", None), (9, "d", "U3", "x"), (10, "d", "U1", "​"),
        (11, "d", "U1", "the  operator"),
        (12, "d", "U4", "thе"),  # one of two blocks holds it literally
    ]
    blocks = [("d", "U1", "see the operator now"), ("d", "U1", "see the operator now"), ("d", "U2", "see t​he ｏperator now"), ("d", "U3", None), (None, "U1", "x"), ("d", None, "x"), ("d", "U4", "the"), ("d", "U4", "thе")]
    i = spark.createDataFrame(items, "item_id long, doc_id string, uuid string, violation_text string")
    b = spark.createDataFrame(blocks, "doc_id string, uuid string, content string")
    run = lambda x, y: la.unmasked_quotes(x, y, "item_id", "doc_id", "uuid", "violation_text", "content", clean_ref)
    assert sorted(r.item_id for r in run(i, b).collect()) == [2, 4]
    assert run(i.limit(0), b).count() == 0 and run(i, b.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 300_000])
def test_long_text(spark, n):
    assert forms(spark, ["ﬁ​" * n]) == ["fi" * n]
