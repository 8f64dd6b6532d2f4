import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.rules import Compiled, Rule, guard, guarded_replace, is_exact, java_replacement, rules_of


def apply(spark, rules, texts, words=()):
    book = Compiled.of(rules, "f", list(words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [(r.s.text, r.s.counts) for r in df.select("i", book.apply(F.array("x"))[0].alias("s")).orderBy("i").collect()]


def literal(pattern, into, **kw):
    return Rule("r", frozenset({"f"}), pattern, into, **kw)


def test_protected_words_spare_what_they_overlap(spark):
    assert apply(spark, [literal("沫过", "没过")], ["红沫过鱼沫过水"], ["红沫过鱼"]) == [("红沫过鱼没过水", [1])]


@pytest.mark.parametrize("seed", range(3))
def test_guards_match_the_scan(spark, seed):
    rnd = random.Random(seed)
    some = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    for _ in range(4):
        fragment, words = some(2), [some(rnd.randrange(2, 6)) for _ in range(4)]
        texts = [some(rnd.randrange(0, 40)) for _ in range(60)]
        want = [guarded_replace(t, fragment, "#", words) for t in texts]
        assert apply(spark, [literal(fragment, "#")], texts, words) == [(t, [n]) for t, n in want], (fragment, words, is_exact(fragment, words))


def test_rules_run_longest_first_and_count(spark):
    rules = rules_of({"rules": [
        {"id": "a", "fields": ["f"], "pattern": "bb", "replacement": "c"}, {"id": "b", "fields": ["f"], "pattern": "abb", "replacement": "bb"},
        {"id": "off", "enabled": False, "fields": ["f"], "pattern": "x" * 9}, {"id": "re", "fields": ["f"], "regex": True, "pattern": r"(\d)(\d)", "replacement": r"\2\1"},
    ]})
    assert [r.id for r in rules] == ["re", "b", "a"]
    assert apply(spark, rules, ["12abb 345"]) == [("21c 435", [2, 1, 1])]


def test_python_patterns_keep_their_meaning(spark):
    regex = lambda p: [literal(p, "#", literal=False)]
    assert apply(spark, regex(r"\s+"), ["a　b"]) == [("a#b", [1])]
    assert apply(spark, regex(r"\d+"), ["１２"]) == [("#", [1])]
    assert apply(spark, regex(r"(?im)^ÉX.*$"), ["a\néx yz\nb c"]) == [("a\n#\nb c", [1])]
    assert apply(spark, regex(r"\W"), ["中a_"]) == [("中a_", [0])]


def test_replacements_are_quoted():
    assert java_replacement(r"a$1\1\g<2>") == r"a\$1$1$2"
    assert guard("ab", ["xaby"]) == "(?!(?<=x)(?=aby))ab" or "(?<=x)" in guard("ab", ["xaby"])
