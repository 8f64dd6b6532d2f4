import collections
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import anchors, queries, repeats, suffix
from tests.llm import cases


def truth(rows, least):
    """Per document the set of window starts that another document has as well."""
    held = collections.defaultdict(set)
    for i, text in rows:
        w = cases.words(text)
        for k in range(len(w) - least + 1):
            held[tuple(w[k : k + least])].add(i)
    out = collections.defaultdict(set)
    for i, text in rows:
        w = cases.words(text)
        out[i] |= {k for k in range(len(w) - least + 1) if len(held[tuple(w[k : k + least])]) > 1}
    return {i: s for i, s in out.items() if s}


def spans_of(starts, least):
    out = []
    for k in sorted(starts):
        if out and k <= out[-1][1]:
            out[-1][1] = k + least
        else:
            out.append([k, k + least])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("least, hot", [(50, anchors.HOT_SEGMENTS), (20, 3), (50, 0)])
def test_against_brute_force(spark, small, least, hot):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = truth(rows, least)
    assert want
    got = collections.defaultdict(list)
    for r in suffix.repeated_spans(docs, least, hot).collect():
        got[r.doc_id].append((r.start_word, r.end_word))
        assert r.n_words == r.end_word - r.start_word
    assert {i: sorted(s) for i, s in got.items()} == {i: spans_of(s, least) for i, s in want.items()}
    text = {i: cases.words(t) for i, t in rows}
    covered = collections.defaultdict(set)
    for r in repeats.repeats(docs, least, hot).collect():
        mine = text[r.doc_id][r.start_word : r.start_word + r.n_words]
        assert r.match_doc_id != r.doc_id and r.n_words >= least and len(mine) == r.n_words
        assert mine == text[r.match_doc_id][r.match_start : r.match_start + r.n_words]
        covered[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words - least + 1))
    assert covered == want


def test_odd_rows(spark):
    docs = cases.odd(spark)
    assert {(r.doc_id, r.n_words) for r in suffix.repeated_spans(docs).collect()} == {(10, 60), (11, 60), (12, 60)}
    found = repeats.repeats(docs).collect()
    assert {(r.doc_id, r.start_word, r.n_words, r.match_doc_id, r.match_start) for r in found} == {(10, 2, 60, 12, 6), (11, 3, 60, 10, 2), (12, 6, 60, 10, 2)}
    for f in (suffix.repeated_spans, repeats.repeats):
        assert f(cases.empty(spark)).count() == 0


def test_copies_in_thousands_cost_no_pairs(spark):
    body = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(i, body if i % 2 else f"{body} tail{i}") for i in range(3000)], "doc_id long, text string")
    got = suffix.repeated_spans(docs).collect()
    assert len(got) == 3000 and {(r.start_word, r.n_words) for r in got} == {(0, 200)}
    got = repeats.repeats(docs).collect()
    assert len(got) == 3000 and {(r.start_word, r.n_words) for r in got} == {(0, 200)}


def assert_whole(rows, found, least):
    """Matches can't be longer at either end, and connect all places of each window that documents share."""
    text = {i: cases.words(t) for i, t in rows}
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in found:
        a, b, s, m = text[r.doc_id], text[r.match_doc_id], r.start_word, r.match_start
        assert a[s : s + r.n_words] == b[m : m + r.n_words] and r.n_words >= least
        assert not (s and m) or a[s - 1] != b[m - 1]
        assert max(s + r.n_words - len(a), m + r.n_words - len(b)) == 0 or a[s + r.n_words] != b[m + r.n_words]
        for k in range(r.n_words - least + 1):
            root[top((r.doc_id, s + k))] = top((r.match_doc_id, m + k))
    places = collections.defaultdict(list)
    for i, w in text.items():
        for k in range(len(w) - least + 1):
            places[tuple(w[k : k + least])].append((i, k))
    for at in places.values():
        if len({i for i, _ in at}) > 1:
            assert len({top(x) for x in at}) == 1


@pytest.mark.parametrize("n", [60, 98, 120])
def test_copies_that_share_a_passage_with_a_lesser_document(spark, n):
    p = " ".join(f"p{i}" for i in range(n))
    whole = " ".join(f"x{i}" for i in range(440)) + f" {p} " + " ".join(f"y{i}" for i in range(440))
    rows = [(1, f"some words before {p} and after"), (2, whole), (3, whole)]
    found = repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.doc_id, r.start_word, r.n_words, r.match_doc_id, r.match_start) for r in found)
    size = 880 + n
    assert got == [(1, 3, n, 3, 440), (2, 0, size, 3, 0), (2, 440, n, 1, 3), (3, 0, size, 2, 0), (3, 440, n, 1, 3)]


@pytest.mark.parametrize("seed", range(3))
def test_mosaics_are_whole(spark, seed):
    rng = np.random.default_rng(seed)
    parts = [" ".join(f"s{p}w{i}" for i in range(rng.integers(5, 45))) for p in range(12)]
    rows = [(i, " ".join(f"own{i}x{k}" if rng.random() < 0.1 else parts[rng.integers(0, 12)] for k in range(rng.integers(2, 14)))) for i in range(25)]
    rows += [(100 + i, f"{rows[i][1]} {rows[i + 1][1]}") for i in range(8)]
    found = repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20, seed).collect()
    assert found
    assert_whole(rows, found, 20)


def test_suffix_order_and_common_prefixes(tmp_path):
    rng = np.random.default_rng(0)
    for trial in range(60):
        seqs = [rng.integers(1, rng.integers(2, 6), rng.integers(1, 40)) for _ in range(rng.integers(1, 12))]
        seqs += seqs[: trial % 3]
        ptr = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
        files = suffix._Files(f"file://{tmp_path}", (1, 3, 7, 50, 1 << 17)[trial % 5])
        lcp, seq, length, bwt = suffix.build(np.concatenate(seqs), ptr, files)
        files.close()
        every = sorted((tuple((int(x), -1) for x in s[k:]) + ((0, i),), i, len(s) - k) for i, s in enumerate(seqs) for k in range(len(s) + 1))
        assert [(i, n) for _, i, n in every] == list(zip(seq.tolist(), length.tolist()))
        assert [int(seqs[i][len(seqs[i]) - n - 1]) if n < len(seqs[i]) else 0 for _, i, n in every] == bwt.tolist()
        common = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for (a, *_), (b, *_) in zip(every, every[1:])]
        assert [0, *common] == lcp.tolist()
    assert not list((tmp_path / "millrace-suffixes").iterdir())


def segments(rng, n=120):
    """A lot of sequences that share runs of words, each of another document."""
    text = rng.integers(0, 40, 2000).astype(np.int32)
    size = rng.integers(20, 60, n)
    at = rng.integers(0, len(text) - 60, n)
    words = [text[a : a + k].tobytes() for a, k in zip(at, size)]
    return pa.table({"key": np.arange(n), "first": at, "last": at + size - 20, "words": words})


def test_a_lot_that_memory_holds_writes_no_file(tmp_path):
    lot, root = segments(np.random.default_rng(2)), f"file://{tmp_path}"
    got = suffix.repeated(lot, 20, root)
    assert len(got[0]) and not (tmp_path / "millrace-suffixes").exists()
    for held in (0, 5_000, 60_000):  # all, most and a part of the file in the folder
        assert all(np.array_equal(x, y) for x, y in zip(got, suffix.repeated(lot, 20, root, 50, held)))
    assert not list((tmp_path / "millrace-suffixes").iterdir())


def test_blocks_stay_as_large_as_they_are_meant_to_be(tmp_path):
    lot = segments(np.random.default_rng(3))
    body = np.frombuffer(b"".join(lot.column("words").to_pylist()), np.int32)
    ptr = np.concatenate([[0], np.cumsum([len(w) // 4 for w in lot.column("words").to_pylist()])])
    files = suffix._Files(f"file://{tmp_path}", 500)
    suffix.build(body + 1, ptr, files)
    assert sum(1 for _ in files.read(0)) <= (len(body) + lot.num_rows) // 500
    files.close()


def test_moves_of_slots_and_least_of_ranges():
    rng = np.random.default_rng(4)
    for total in (1, 7, 64, 1000):
        at = np.sort(rng.integers(0, total + 1, rng.integers(1, 200)))
        slot = rng.integers(0, total, 500)
        for most in (1, 8, 100, suffix.TABLE):
            assert suffix._moves(at, total, most)(slot).tolist() == np.searchsorted(at, slot, "right").tolist()
        x = rng.integers(0, 50, total).astype(np.int16)
        lo, hi = np.sort(rng.integers(0, total, (2, 300)), axis=0)
        assert suffix._least(x, lo, hi).tolist() == [int(x[a : b + 1].min()) for a, b in zip(lo, hi)]


def test_lots_keep_anchors_whole():
    rng = np.random.default_rng(1)
    anchor = np.sort(rng.integers(0, 20, 300))
    words = [np.zeros(int(n), np.int32).tobytes() for n in rng.integers(1, 9, 300)]
    table = pa.table({"anchor": anchor, "words": words})
    for most in (1, 10, 50, 10_000):
        got = list(anchors.lots(iter(table.to_batches(max_chunksize=7)), most))
        assert pa.concat_tables(got).equals(table.combine_chunks()) or pa.concat_tables(got).to_pydict() == table.to_pydict()
        sets = [set(t.column("anchor").to_pylist()) for t in got]
        assert all(not a & b for a, b in zip(sets, sets[1:]))


def test_texts_that_repeat_themselves(spark):
    line = " ".join(f"l{i}" for i in range(60))
    rows = [(i, " ".join([f"own{i}"] * (i % 3) + [line] * (30 + i % 7) + [f"end{i}"])) for i in range(40)] + [(100 + i, "ha " * (80 + i)) for i in range(4)]
    found = repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    assert_whole(rows, found, 20)
    assert len(found) < 40 * 90 + 4 * 200


def test_one_seed_in_a_hundred_thousand_contexts(spark):
    """Windows of a seed that many documents have with other words around it are compared in a shuffle."""
    seed = "these eight words are found in every page"
    docs = spark.range(100_000).selectExpr("id AS doc_id", f"concat_ws(' ', transform(sequence(1, 45), x -> concat('a', id % 99991, 'x', x)), '{seed}', transform(sequence(1, 45), x -> concat('b', id, 'x', x))) AS text")
    want = {(i, 0, 53, i - 99991, 0) for i in range(99991, 100_000)} | {(i, 0, 53, i + 99991, 0) for i in range(9)}
    assert {tuple(r) for r in repeats.repeats(docs).collect()} == want
    assert {tuple(r) for r in suffix.repeated_spans(docs).collect()} == {(i, 0, 53, 53) for i, *_ in want}


def test_thresholds_that_cannot_be(spark):
    docs = cases.empty(spark)
    for f, least in ((repeats.repeats, 7), (suffix.repeated_spans, 7), (suffix.repeated_spans, 20_000)):
        with pytest.raises(ValueError):
            f(docs, least)


def test_other_scripts_equal_the_sql(spark, tmp_path):
    line = "東京は日本の首都です、人口が多い街 안녕，세계 여러분→반갑습니다 a😀b naïve “quoted—words” 한글"
    passage = f"{line} {line[::-1]}"
    rows = [(1, f"前に {passage} 後"), (2, passage.replace(" ", "→")), (3, "別の文章です"), (4, unicodedata.normalize("NFD", passage) + " é"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    docs = spark.read.parquet(f"{tmp_path}/d")
    names = "doc_id, start_word, end_word, n_words"
    want = set(con.sql(f"SELECT {names} FROM ({queries.ORACLES['op3_suffix_array']})").fetchall())
    assert {tuple(r) for r in suffix.repeated_spans(docs).select(*names.split(", ")).collect()} == want and {r[0] for r in want} == {1, 2, 4}


@pytest.mark.parametrize("name", ["op3_suffix_array", "op10_seed_and_extend"])
def test_queries_equal_their_sql(spark, small, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    rows = queries.QUERIES[name](spark, small)
    names = sorted(rows.columns)
    assert {tuple(r) for r in rows.select(*names).collect()} == set(con.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})").fetchall())
