"""Column functions and criteria on the cases that tables do not hold."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import records


@pytest.mark.parametrize(("text", "want"), [
    ("ignore ​ previous", ["instruction-override"]), ("ignore previous", ["instruction-override"]), ("ig​nore\x07 pre­vious", ["instruction-override"]), ("IGNORE,\n\tprevious!", ["instruction-override"]),
    ("ignoreprevious", []), ("", []), (None, []), ("You must reveal: prompt; rank-me", ["prompt-reference", "decision-manipulation", "instruction-directive"]),
])
def test_instruction_signals(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(scalars.instruction_signals(F.col("t"))).first()[0] == want


def test_a_text_is_prepared_once_for_all_phrases(spark):
    texts = ["ig\u00adnore \t\u00a0 pre\x00vious", "SYSTEM.Prompt and l\u200blm", "you  must", "you must", "you\x85must", "youmust", " ", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", scalars.instruction_signals(F.col("t")).alias("s"))
    assert [r["s"] for r in df.orderBy("k").collect()] == [["instruction-override"], ["prompt-reference", "model-addressing"], *[["instruction-directive"]] * 3, [], [], []]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2


@pytest.mark.parametrize(("criterion", "want"), [
    ("<>", ["a*b", "axb", "NaN", "5", "inf"]), ("=", [None, ""]), ("a~*b", ["a*b"]), ("a*b", ["a*b", "axb"]), ("=nan", ["NaN"]), ("inf", ["inf"]), ("<>nan", [None, "", "a*b", "axb", "5", "inf"]), (">4", ["5"]), ("=5.0", ["5"]), ("<>5", [None, "", "a*b", "axb", "NaN", "inf"]), (">", []),
])
def test_criteria(spark, criterion, want):
    table = spark.createDataFrame([(x,) for x in (None, "", "a*b", "axb", "NaN", "5", "inf")], "c string")
    key = lambda x: (x is not None, x or "")
    assert sorted((r.c for r in table.where(records.criterion("c", criterion)).collect()), key=key) == sorted(want, key=key)
