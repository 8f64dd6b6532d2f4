import itertools

import numpy as np
import pyarrow as pa

from millrace.llm import graph, near
from tests.llm import cases


def shingles(text, k=3):
    w = cases.words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def groups_of(rows, found):
    root = {r.doc_id: r.duplicate_of for r in found}
    return {i: root.get(i, i) for i in rows}


def truth(rows):
    """Pairs of ids with the Jaccard similarity of their shingles, for all that have a shingle in common."""
    sets = {i: shingles(t) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {p for ids in holders.values() for p in itertools.combinations(ids, 2)}
    return sets, {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}


def roots(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_recall_and_precision_against_brute_force(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    sets, alike = truth([(r.doc_id, r.text) for r in docs.collect()])
    root = groups_of(sets, near.near_duplicates(docs).collect())
    true = roots(sets, [p for p, j in alike.items() if j >= near.THRESHOLD])
    pairs = [p for p, j in alike.items() if j >= near.THRESHOLD]
    assert len(pairs) > 100
    assert np.mean([root[a] == root[b] for a, b in pairs]) >= 0.99
    # verified by all shingles: nothing is joined that the pairs of 0.5 and more don't join
    assert all(true[i] == true[r] for i, r in root.items())


def test_recall_just_above_the_threshold(spark):
    rng = np.random.default_rng(11)
    rows, n = [], 400
    for i in range(n):
        size = int(rng.integers(30, 1200))
        base = [f"w{x}" for x in rng.integers(0, 10**9, size)]
        keep = int(size * 0.69)  # Jaccard (k - 2) / (2 n - k - 2), about 0.52
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:keep] + [f"v{x}" for x in rng.integers(0, 10**9, size - keep)]))]
    _, alike = truth(rows)
    want = {p for p, j in alike.items() if j >= near.THRESHOLD}
    got = {(r.duplicate_of, r.doc_id) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > n * 0.8 and got <= want and len(got) >= 0.97 * len(want)


def test_ids_that_name_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")
    assert [tuple(r) for r in near.near_duplicates(docs).collect()] == [(2, 1)]
    assert sorted(tuple(r) for r in near.drop_near_duplicates(docs).collect()) == [(1, a), (2, b)]


def test_estimates_are_unbiased():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        n, share = int(rng.integers(300, 900)), rng.random()
        base = [f"w{x}" for x in rng.integers(0, 10**9, n)]
        other = base[: int(n * share)] + [f"v{x}" for x in rng.integers(0, 10**9, n - int(n * share))]
        m, _, _ = near.signatures(pa.array([" ".join(base), " ".join(other)]))
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        errors.append((m[0] == m[1]).mean() - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_every_bin_is_filled():
    m, short, node = near.signatures(pa.array(["one", "two words", "", None, "!!", "a b c d e"]))
    empty = m == near._EMPTY
    assert empty[2].all() and empty[3].all() and not empty[[0, 1, 4, 5]].any()
    assert [len(s) // 4 for s in short] == [1, 1, 0, 0, 1, 3] and len(set(node.tolist())) == 5
    assert near.jaccard(pa.array([b"", short[5], short[0], b""])[1:], pa.array([short[5], short[1], short[1]])).tolist() == [1, 0, 0]


def test_components_of_long_and_branching_graphs(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (45, 2))] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in list(parent) if find(x) != x}
    got = graph.components(spark.createDataFrame(edges, "u long, v long"))
    assert {(r.node, r.root) for r in got.collect()} == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(spark):
    docs = cases.odd(spark)
    found = {(r.doc_id, r.duplicate_of) for r in near.near_duplicates(docs).collect()}
    assert (8, 7) in found and {(11, 10), (12, 10)} <= found and len(found) == 3
    kept = near.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect())
    assert [i for null, i in ids if not null] == [1, 2, 3, 4, 5, 6, 7, 9, 10, 13, 13] and sum(null for null, _ in ids) == 2
    for f in (near.near_duplicates, near.drop_near_duplicates):
        assert f(cases.empty(spark)).count() == 0


def test_thousands_of_copies_and_a_shared_passage(spark):
    rng = np.random.default_rng(9)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    base, passage = word(200), word(60)
    rows = [(i, base) for i in range(100_000)] + [(100_000 + i, f"{word(150)} {passage} {word(150)}") for i in range(300)]
    got = {(r.doc_id, r.duplicate_of) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 0) for i in range(1, 100_000)}
