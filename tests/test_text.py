import pytest
from pyspark.sql import functions as F

from vellora.functions import text as tx


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_cleaning(spark):
    assert values(spark, ["a\x00\x08b\t\n\r\x0b\x1f", "", None], tx.sanitize_xml) == ["ab\t\n\r", "", None]
    assert values(spark, ["x" * 201, "x" * 200, None], tx.truncate_heading) == ["x" * 197 + "...", "x" * 200, None]
    assert values(spark, ["a\n b\t\tc\r", "y" * 60, ""], tx.preview) == ["a b c", "y" * 50 + "...", ""]
    assert values(spark, ["a  \nb\u00a0", "a \\n b"], tx.rtrim_lines) == ["a\nb", "a \\n b"]
    assert values(spark, ["a  \nb ", "a \\n b"], tx.strip_before_newline) == ["a\nb ", "a\\n b"]
    assert values(spark, ["　 a\u2003", None], tx.trim_u) == ["a", None]
    with pytest.raises(Exception, match="heading above"):
        values(spark, ["x" * 201], tx.checked_heading)


def test_numbering(spark):
    t = ["1. Intro", "1.1 x", "a) First", "• note", "表1 x", "注：x", "1 Foo", "10 Foo", "Normal", "", None]
    assert values(spark, t, tx.strip_auto_number) == ["Intro", "x", "First", "note", "x", "x", "1 Foo", "Foo", "Normal", "", None]
    assert values(spark, ["e) one\nf) two", "text\n3.2.1\nmore", "3.2.1\ntext", "a) x\\nb) y", None], tx.strip_auto_number_lines) == ["one\ntwo", "text\n\nmore", "3.2.1\ntext", "x\\ny", None]
    got = values(spark, ["1. a\n2. b", "plain", "1. a"], tx.numbering_variants)
    assert [[(x.text, x.mode) for x in v] for v in got] == [[("a\n2. b", "prefix"), ("a\nb", "lines")], [], [("a", "prefix")]]


def test_tables_and_markup(spark):
    assert values(spark, ["Title\n<table>[[1, 2]]</table>", "<table>x</table>\nlonger body", "none", "<table></table>", None], tx.longest_segment) == ["[[1, 2]]", "longer body", None, None, None]
    assert values(spark, ['[["a", "b"]', '["a"]]', '[["a"]]', "x]]", None], tx.fix_table_json) == ['["a", "b"]', '["a"]', '["a"]', "x]]", None]
    assert values(spark, ['["a", "b"], ["c", "d"]', "x"], lambda c: tx.matching_row(c, F.lit("c"))) == ['["c", "d"]', None]
    assert values(spark, ["H<sub>2</sub>O<SUP>x</SUP>"], tx.strip_markup) == ["H2Ox"]
    assert values(spark, ['a"b\\c\n字', ""], tx.json_escape) == ['a\\"b\\\\c\\n字', ""]
    d = '<drawing id="1" name="P &quot;1&quot;" path="a/b.png" format="png" />'
    assert values(spark, [f"x {d} y"], tx.normalize_drawings) == ['x <drawing id="1" name="P &quot;1&quot;" /> y']
    assert values(spark, [d, "none"], lambda c: tx.drawing_attribute(c, "name")) == ['P "1"', None]
    assert values(spark, ["image/x-emf", ".JPG", "image/svg+xml", "png"], tx.image_format) == ["emf", "jpeg", "svg", "png"]
    rows = spark.createDataFrame([([["a", "bb"], ["ccc", None, "x"]],), ([],), (None,)], "r array<array<string>>").select(tx.display_table(F.col("r")).alias("v"), tx.first_id(F.col("r")).alias("f"), tx.last_id(F.col("r")).alias("l")).collect()
    assert rows[0].v == "a   | bb  \nccc | None | " + "x".ljust(20) and rows[1].v == rows[2].v == "(empty table)" and (rows[0].f, rows[0].l, rows[1].f, rows[2].l) == ("a", "x", None, None)


def test_equations_comments_failures(spark):
    assert values(spark, ["\\cbrtx", "\\sum12", "\\lim\\below{a}{b}", "\\degc", "\\oint2", "plain"], tx.clean_linear) == ["\\sqrt[3]{x}", "\\sum{12}", "\\lim_{a}{b}", "&deg;C", "\\oint{2}", "plain"]
    assert values(spark, ["[FALLBACK]a\nb\nc", "a\nb", "[FALLBACK]a"], tx.word_comment) == ["[FALLBACK]a\x0bb\\nc", "a\nb", "[FALLBACK]a"]
    assert values(spark, ["one; two", "a. b", "w " * 40, None], tx.status_summary) == ["one", "a", ("w " * 40)[:45].rstrip() + "...", ""]
    assert values(spark, ["NF_C: violation text not found(C)", "violation text not found(M)", "x", None], tx.not_found_reason) == [True, True, False, False]
    assert values(spark, ["Quota exceeded", "billing quota exceeded", "429", "HTTP 404", "", None], tx.message_retryable) == [True, False, True, False, True, True]
    s = spark.createDataFrame([("APIStatusError", 503), ("APIStatusError", 418), ("RateLimitError", None), ("BadRequestError", 400), ("Odd", None)], "k string, s int")
    assert [r.v for r in s.select(tx.status_retryable(F.col("k"), F.col("s")).alias("v")).collect()] == [True, False, True, False, True]
    assert values(spark, ["models/gpt-5-mini", "o3", "gpt-4.1"], tx.is_reasoning_model) == [True, True, False]
    assert tx.positive_int(None, 5) == 5 and tx.positive_int(" 7 ", 5) == 7
    with pytest.raises(ValueError):
        tx.positive_int("0", 5)


def test_prompts(spark):
    df = spark.createDataFrame([(" h ", [" a ", "", None, "b"], [["x", "it's", None]], " c ")], "h string, p array<string>, t array<array<string>>, c string")
    v = df.select(tx.block_prompt(F.col("h"), F.col("p"), F.col("t"), F.col("c")).alias("v")).first().v
    assert v == "Section hierarchy context: a → b  → h\nTable header context: [['x', \"it's\", None]]\n\nContent:\nc"
    raw = [{"name": " n ", "desc": "d", "evidence": "e"}, {"old": "x", "evidence": "y"}, None, {}]
    got = spark.createDataFrame([(raw,)], "f array<map<string,string>>").select(tx.extracted_fields(F.col("f")).alias("v")).first().v
    assert [tuple(x) for x in got] == [("n", "d", "e"), ("old", "x", "y")]
