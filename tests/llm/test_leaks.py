import random
import time
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import leaks, queries
from tests.llm import cases


def truth(docs, items, least):
    out = set()
    for i, text in docs:
        w = cases.words(text)
        for j, other in items:
            v = cases.words(other)
            for p in range(len(w)):
                for q in range(len(v)):
                    if w[p] == v[q] and not (p and q and w[p - 1] == v[q - 1]):
                        n = 0
                        while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                            n += 1
                        if n >= least:
                            out.add((i, j, p, q, n))
    return out


@pytest.mark.parametrize("parts", [32 << 20, 300])
def test_against_brute_force(spark, parts):
    rnd = random.Random(2)
    some = lambda n: " ".join(rnd.choice("abcdefghij") for _ in range(n))
    items = [(i, some(rnd.randrange(5, 40))) for i in range(12)]
    docs = []
    for i in range(80):
        text = some(rnd.randrange(0, 60))
        if i % 2:
            body = items[i % 12][1].split()
            a = rnd.randrange(len(body))
            text += ", " + " ".join(body[a : a + rnd.randrange(10, 40)]).upper() + ". " + some(20)
        docs.append((i, text))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + items[:2], "item_id long, text string")
    want = truth(docs, items, 13)
    assert len(want) > 5
    assert {tuple(r) for r in leaks.contaminated(df, bench, part_bytes=parts).collect()} == want
    kept = {r.doc_id for r in leaks.drop_contaminated(df, bench, part_bytes=parts).collect()}
    assert kept == {i for i, _ in docs} - {x[0] for x in want}


@pytest.mark.parametrize("parts", [32 << 20, 1])
def test_odd_rows(spark, parts):
    passage = " ".join(f"shared{i}" for i in range(60))
    bench = spark.createDataFrame([(1, passage), (None, "twice the very same row of text"), (2, None), (3, ""), (4, "word " * 13)], "item_id long, text string")
    docs = cases.odd(spark)
    found = [tuple(r) for r in leaks.contaminated(docs, bench, part_bytes=parts).collect()]
    assert {f for f in found if f[1] == 1} == {(10, 1, 2, 0, 60), (11, 1, 3, 0, 60), (12, 1, 6, 0, 60)}
    assert {f[0] for f in found if f[1] == 4} == {6}
    kept = leaks.drop_contaminated(docs, bench, part_bytes=parts)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert leaks.contaminated(cases.empty(spark), bench).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert leaks.contaminated(docs, nothing).count() == 0 and leaks.drop_contaminated(docs, nothing).count() == docs.count()


@pytest.mark.parametrize("seed", range(6))
def test_texts_that_repeat_themselves(seed):
    rnd = random.Random(seed)
    some = lambda n: [x for _ in range(n) for x in [rnd.choice("ab")] * rnd.randrange(1, 9) + list(rnd.choice(["abc", "ab", "aab", "x", "abcd"])) * rnd.randrange(1, 9)]
    items, docs = [(i, " ".join(some(3))) for i in range(3)], [(i, " ".join(some(6))) for i in range(4)]
    index = leaks.Index.of([i for i, _ in items], [t for _, t in items], 5, 13)
    texts = pa.array([t for _, t in docs])
    want = truth(docs, items, 13)
    assert {tuple(int(x) for x in row) for row in zip(*index.hits(texts))} == want
    assert set(np.flatnonzero(index.held(texts)).tolist()) == {x[0] for x in want}


def test_one_word_ten_thousand_times(spark):
    began = time.time()
    docs, bench = spark.createDataFrame([(1, "ha " * 10_000)], "doc_id long, text string"), spark.createDataFrame([(2, "ha " * 2_000)], "item_id long, text string")
    got = leaks.contaminated(docs, bench).collect()
    assert len(got) == 12_000 - 25 and {r.n_words for r in got} == set(range(13, 2001))
    assert leaks.drop_contaminated(docs, bench).count() == 0
    assert time.time() - began < 30


def test_other_scripts_equal_the_sql(spark, tmp_path):
    passage = "東京は日本の首都です、人口が多い街 안녕，세계 여러분→반갑습니다 a😀b naïve “quoted—words” 한글"
    rows = [(1, "前に " + passage + " 後"), (2, passage.replace(" ", "→")), (3, "別の文章です"), (4, unicodedata.normalize("NFD", passage) + " é"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(1, passage), (2, "".join(passage.split())[5:])], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/b")
    con = duckdb.connect()
    for view, at in (("documents", "d"), ("benchmark", "b")):
        con.sql(f"CREATE VIEW {view} AS SELECT * FROM '{tmp_path}/{at}/*.parquet'")
    names = "doc_id, item_id, doc_start, item_start, n_words"
    want = set(con.sql(f"SELECT {names} FROM ({queries.ORACLES['op8_decontamination']})").fetchall())
    docs, bench = spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/b")
    for parts in (32 << 20, 1):
        assert {tuple(r) for r in leaks.contaminated(docs, bench, part_bytes=parts).select(*names.split(", ")).collect()} == want
    assert {1, 2, 4} <= {x[0] for x in want}


def test_windows_narrower_than_k_are_refused(spark):
    docs = cases.empty(spark)
    with pytest.raises(ValueError):
        leaks.contaminated(docs, spark.createDataFrame([(1, "a")], "item_id long, text string"), k=5, min_words=4)
