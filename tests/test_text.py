import re
import string

import pytest
from pyspark.sql import functions as F

from strandloom.functions import text as t


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_normalise_answer(spark):
    def plain(s):
        s = "".join(ch for ch in (s or "").lower() if ch not in set(string.punctuation))
        return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())

    values = ["The Cat, an A-team!", None, "", "theatre a", "  tab\there ", "Ärger the\nEnd", "a"]
    assert column(spark, t.normalise_answer, values) == [plain(v) for v in values]


@pytest.mark.parametrize(
    "text,want",
    [("x \\boxed{1} y \\boxed{a{b}c}", "a{b}c"), ("thought\nFinal Answer: Ulm\n\nmore", "Ulm"), ("Answer: one\nAnswer: two", "one\nAnswer: two"), ("plain", "plain"), ("", ""), (None, ""), ("answer: x\n", "x")],
)
def test_final_answer(spark, text, want):
    assert column(spark, t.final_answer, [text]) == [want]


def test_abstains(spark):
    assert column(spark, t.abstains, ["I DO NOT KNOW.", "Ulm", None, "Insufficient information."]) == [True, False, False, True]


def test_facts(spark):
    df = spark.createDataFrame([("same fact", "the same\nfact is"), ("", "x"), ("Same", "same"), ("a b c d e", "e d c zzz")], "f string, c string")
    got = [tuple(r) for r in df.select(t.fact_in(F.col("f"), F.col("c")), t.fact_near(F.col("f"), F.col("c"))).collect()]
    assert got == [(True, True), (False, False), (False, True), (False, True)]


def test_identities(spark):
    import hashlib

    r = spark.createDataFrame([("s", "t", 3)], "source string, title string, sent_id int").select(t.chunk_id(F.col("source"), F.col("title"), F.col("sent_id"))).first()[0]
    assert r == hashlib.md5(b"s-t-3").hexdigest()
    df = spark.createDataFrame([(" x ", "t", "s", 1, 2), ("  ", "t", "s", None, 2), (None, None, None, None, None)], "id string, title string, source string, page int, sent_id int")
    assert [x[0] for x in df.select(t.node_identity(*(F.col(c) for c in df.columns))).collect()] == ["x", "t:s::2", ":::"]


def test_more_functions(spark):
    assert column(spark, t.document_key, ["My File.PDF", "10-K report", None]) == ["myfile", "10kreport", ""]
    assert column(spark, t.unwrap_json, ['{"answer": {"text": "x"}}', '{"b": 1}', "plain"]) == ["x", '{"b": 1}', "plain"]
    assert column(spark, t.strip_thinking, ["<think>a</think> b<end>", "c"]) == ["b", "c"]
    assert column(spark, t.safe_filename, ['a/b: "c"  d', ""]) == ["a_b___c__d", "untitled"]
    assert column(spark, t.entity_term, ["Ａ_b-C  d", None]) == ["a b c d", None]
    assert column(spark, t.fulltext_query, ['title:"x" AND (y)', "***"]) == ["title x AND y", "***"]
    assert column(spark, t.unescape, [" A &amp; B ", None]) == ["A & B", ""]
    assert column(spark, lambda c: t.rank_of_score(c.cast("double")), ["1", "0.5", "0.4", "0"]) == [0, 1, None, None]
    assert column(spark, t.strip_boilerplate, ["x {{ /verifyErrors }} y {{ /verifyErrors }}  body\nCLICK HERE TO SIGN UP\nend"]) == ["body\nend"]
    assert t.namespace_token("ok_1") == "ok_1" and t.namespace_token("a b").startswith("a_b_")
    assert t.digest({"b": 1, "a": 2}) == t.digest({"a": 2, "b": 1})
