import pytest
from pyspark.sql import functions as F

from factgraph.functions import canon


def test_identity_of_known_facts():
    # fixed value: the identity that this registration has everywhere
    assert canon.fact_identity({"type": "patient_registration", "timestamp": "2026-01-01T00:00:00Z", "content": {"name": "Test Patient"}}) == "36d7b60d4c870e46aedd1c069ac4c747b956b3aa36b6d8a1abe520ab55959acd"


@pytest.mark.parametrize(("x", "text"), [(0.0, "0"), (-0.0, "0"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (4.5, "4.5"), (333333333.33333329, "333333333.3333333"), (2e-3, "0.002"), (9007199254740992.0, "9007199254740992"), (5e-324, "5e-324"), (-1.5e300, "-1.5e+300")])
def test_numbers_print_as_in_ecmascript(x, text):
    assert canon.canonical(x) == text


def test_keys_sort_by_utf16():
    assert canon.canonical({"\U0001f600": 1, "דּ": 2, "a": [True, None, "é\n"]}) == '{"a":[true,null,"é\\n"],"\U0001f600":1,"דּ":2}'


@pytest.mark.parametrize(("x", "text"), [(1.0005, "1.001"), (2.0, "2"), (-0.0001, "0"), (6.2999999, "6.3")])
def test_values_round_half_away(x, text):
    assert canon.format_number(x) == text


def test_note_summary_cuts_whole_characters(spark):
    rows = spark.createDataFrame([("x\n# head",), ("",), ("é" * 150,)], "t string").select(canon.note_summary(F.col("t")).alias("s")).collect()
    assert [r.s for r in rows] == ["# head", "", "é" * 100]
