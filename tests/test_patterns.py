import pytest
from pyspark.sql import functions as F

from lethe.functions.patterns import pattern_hits
from lethe.functions.text import nhs_valid

CASES = [
    ("NHS 943 476 5919", [("ID", "943 476 5919")]),
    ("NHS 943 476 5918", []),
    ("call 07700 900123 or (01446) 123456 now", [("PHONE", "07700 900123"), ("PHONE", "(01446) 123456")]),
    ("+44 (0)29 2012 3456", [("PHONE", "+44 (0)29 2012 3456")]),
    ("a.b@c.org, x@y", [("EMAIL", "a.b@c.org")]),
    ("AB 12 34 56 C and DA123456C", [("ID", "AB 12 34 56 C")]),
    ("CF62 7AB cf62 7ab SW1A 1AA", [("ADDRESS", "CF62 7AB"), ("ADDRESS", "SW1A 1AA")]),
    ("20-45-77 120-45-77", [("ID", "20-45-77")]),
    ("DOB: 14/03/1941, review 14/03/2024", [("DATE_OF_BIRTH", "14/03/1941")]),
    ("born on 3rd March 1950", [("DATE_OF_BIRTH", "3rd March 1950")]),
    ("at 10.30 for 45 minutes in room 12", []),
    ("", []),
    (None, []),
]


def test_cases(spark):
    units = spark.createDataFrame([(i, 0, t) for i, (t, _) in enumerate(CASES)], "doc_id long, unit_id int, text string")
    got = {}
    for r in pattern_hits(units).orderBy("doc_id", "ord").collect():
        got.setdefault(r["doc_id"], []).append((r["type"], r["text"]))
    for i, (_, want) in enumerate(CASES):
        assert got.get(i, []) == want, CASES[i]


def _valid(n: str) -> bool:
    check = 11 - sum(int(c) * (10 - i) for i, c in enumerate(n[:9])) % 11
    return n[0] != "0" and check != 10 and (0 if check == 11 else check) == int(n[9])


def test_check_digit(spark):
    numbers = [str(1000000007 + 7919 * i) for i in range(500)] + ["0123456789"]
    rows = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", nhs_valid(F.col("n")).alias("v")).collect()
    assert {r["n"]: r["v"] for r in rows} == {n: _valid(n) for n in numbers}


@pytest.mark.parametrize("text", ["", "x"])
def test_no_hits_in_tiny_texts(spark, text):
    assert pattern_hits(spark.createDataFrame([(1, 0, text)], "doc_id long, unit_id int, text string")).count() == 0
