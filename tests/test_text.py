import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing, text
from millrace.functions.variant import records
from millrace.session import prepared


def column(spark, values, c, name="x"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in rows.orderBy("i").select(c).collect()]


ODD = ["红　烧​肉", " a b\t\tc ", "x\r\ny\rz\n\n  \n w ", "é n", "\x00a\x07b\x85c", "👨‍👩 ok", "", None, "Å Å Å", "각", "  x"]


def python_normalize(value, lines):
    """What the functions must do, said in plain Python."""
    value = unicodedata.normalize("NFC", value or "")
    for old, new in (("\xa0", " "), ("\r\n", "\n"), ("\r", "\n")):
        value = value.replace(old, new)
    value = "".join(c for c in value if c in "\n\t‍" or unicodedata.category(c) not in ("Cc", "Cf"))
    if not lines:
        return " ".join(value.split())
    kept = (" ".join(x for x in line.replace("\t", " ").split(" ") if x).strip() for line in value.splitlines())
    return "\n".join(x for x in kept if x)


@pytest.mark.parametrize("lines", [False, True])
def test_normalisation_matches_its_definition(spark, lines):
    got = column(spark, ODD, text.normalized(F.col("x"), lines))
    assert got == [python_normalize(v, lines) for v in ODD]


def test_lists_are_normalised_too(spark):
    df = spark.createDataFrame([(["é", "b"],), ([],), (None,), (["plain"],)], "x array<string>")
    assert [r[0] for r in df.select(text.nfc_each(F.col("x"))).collect()] == [["é", "b"], [], None, ["plain"]]


def test_unknown_values_and_blank_lines(spark):
    assert column(spark, ["Unknown", "NULL", "", "无", "肉"], text.is_unknown(F.col("x"))) == [True] * 4 + [False]
    assert column(spark, ["", " 　\t", "x"], text.is_blank(F.col("x"))) == [True, True, False]


def test_hashes(spark):
    assert column(spark, ["糖醋排骨"], hashing.blake2b(F.col("x"), 2)) == ["bb26"]
    assert column(spark, ["糖醋排骨"], hashing.prompt(F.col("x"))) == ["糖醋排骨怎么做？"]
    odd = 'a"b\\c\td 中'
    assert column(spark, [odd], hashing.json_text(F.col("x"))) == [json.dumps(odd, ensure_ascii=False)]


def test_json_types_are_kept_apart(spark):
    lines = ['{"name": 12, "recipeIngredient": "one"}', '{"name": "n", "recipeIngredient": ["a", 1, null, "b"], "keywords": {"a": 1}}', '{"name": null}', '{"name": "a", "name": "b"}', "nope", '{"a": 1} x']
    rows = records(prepared(spark).createDataFrame([(v,) for v in lines], "value string")).collect()
    assert [(r.valid, r.object) for r in rows] == [(True, True)] * 4 + [(False, False)] * 2
    assert [r.name for r in rows] == ["", "n", "", "b", "", ""]
    assert [r.recipeIngredient for r in rows] == [["one"], ["a", "", "", "b"], [], [], [], []] and rows[1].keywords == []
