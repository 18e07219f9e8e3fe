import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import text as tx


def run(spark, rows, **columns):
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    return [tuple(r) for r in df.select(*[c(F.col("t")).alias(k) for k, c in columns.items()]).collect()]


def test_task1_labels(spark):
    rows = ["Reasoning. Final answer: Supported", "the final answer is: Answer: REFUTED", "supported then refuted.", "Final answer:\n\n refuted. but supported", "unsupported", "gibberish", "", None]
    want = ["Supported", "Refuted", "Refuted", "Refuted", None, None, None, None]
    assert [r[0] for r in run(spark, rows, a=tx.task1_label)] == want
    assert [r[0] for r in run(spark, rows, a=lambda c: tx.with_default(tx.task1_label(c), "task1"))][4:] == ["Refuted"] * 4


def test_task2_labels(spark):
    rows = ["Final answer: evidence_id_2", "final answer: answer: $1", "evidence_id_1 or evidence_id_2", "I say answer 2", "none"]
    assert [r[0] for r in run(spark, rows, a=tx.task2_label)] == ["evidence_id_2", "evidence_id_1", "evidence_id_2", "evidence_id_2", None]


def test_thinking(spark):
    assert [r[0] for r in run(spark, ["<think>a\nb</think> yes ", "<THINK>only</think>", " \t x\n"], a=tx.strip_thinking)] == ["yes", "<THINK>only</think>", "x"]


def test_sentences(spark):
    got = run(spark, ["We saw this in Fig. 2 and it was higher. Table 1. Done! 3 more? Yes. e.g. this.", "", "  "], a=tx.split_sentences)
    assert got[0][0] == ["We saw this in Fig.", "2 and it was higher.", "Table 1.", "Done!", "3 more?", "Yes. e.g. this."]
    assert got[1][0] == [] and got[2][0] == []


def test_numbers(spark):
    got = [r[0] for r in run(spark, ["12.5 (3,400)", "5-10", "1,", "10.", "<0.001"], a=tx.raw_numbers)]
    assert got == [["12.5", "3,400"], ["5", "-10"], ["1,"], ["10"], ["0.001"]]
    targets = run(spark, ["In Table 3, scores rose from 12.5 to 2015 and 9 of 40."], a=tx.claim_targets)[0][0]
    assert targets == [12.5, 40.0]


def test_mentions(spark):
    rows = ["Table 3 shows a higher rate.", "Table S3 shows it.", "eTable 3 of it", "Table 3: a caption", "Tables 2-4 and Table 2"]
    assert [r[0] for r in run(spark, rows, a=lambda c: tx.is_own_mention(c))] == [True, False, False, False, True]
    assert run(spark, rows, a=lambda c: tx.mentioned_numbers(c))[4][0] == ["2", "4"]


def test_worthy(spark):
    rows = ["Table 3 shows that the score rose to 14 in all groups.", "See Table 3 for all of the scores in the groups.", "Table 3 is short 5."]
    assert [r[0] for r in run(spark, rows, a=lambda c: tx.is_claim_worthy(c))] == [True, False, False]


def test_small_helpers(spark):
    assert run(spark, ["PMC1_0"], a=tx.first_even_byte) == [(False,)]
    assert run(spark, ["a/b.tar.GZ", ".x", "n"], a=tx.stem, b=tx.extension) == [("b.tar", ".gz"), (".x", ""), ("n", "")]
    assert run(spark, ["./a//b/./c"], a=tx.canonical_path) == [("a/b/c",)]
    assert run(spark, ["12%", "0.044", "MDH1", ""], a=tx.looks_numeric) == [(True,), (True,), (False,), (False,)]
    assert run(spark, ["x {a} y}"], a=tx.json_block) == [("{a} y}",)]
    with pytest.raises(Exception, match="no evidence type"):
        run(spark, ["other/a.png"], a=tx.evidence_type)


def test_splice_keeps_the_rest(spark):
    df = spark.createDataFrame([("a 1.5 (2,3) b",)], "t string")
    assert df.select(tx.splice(F.col("t"), F.lit(1), F.lit("X"))).first()[0] == "a 1.5 (X) b"


def test_patterns_agree_with_python(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.text(alphabet="Tabless 1,2S-–to anddFig.\n:Final answer supported REFUTED", max_size=40), min_size=200, max_size=200))
    def check(rows):
        got = run(spark, rows, a=lambda c: F.regexp_extract_all(c, F.lit(tx.SPAN["table"]), F.lit(0)), b=lambda c: tx.last_match(c, tx.BARE_LABEL), c=tx.raw_numbers)
        for text, (spans, last, nums) in zip(rows, got, strict=True):
            assert spans == [m[0] for m in re.finditer(tx.SPAN["table"], text)]
            assert last == (re.findall(tx.BARE_LABEL, text) or [None])[-1]
            assert nums == re.findall(tx.NUMBER, text)

    check()
