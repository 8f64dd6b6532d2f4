import numpy as np
import pyarrow as pa

from millrace.llm import queries, toxicity
from tests.llm import cases


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.Model(toxicity.BITS, 0.3, np.arange(50), rng.standard_normal(50), rng.standard_normal((50, 4)))
    texts = pa.array([" ".join(f"t{x}" for x in rng.integers(0, 40, 12)) for _ in range(5)])
    t, _ = toxicity.terms(texts)
    m.known = np.unique(t)[:50]
    got = m.scores(texts)
    for i in range(5):
        own, _ = toxicity.terms(texts.slice(i, 1))
        at = [int(np.searchsorted(m.known, x)) for x in own if x in m.known]
        margin = 0.3 + sum(m.linear[a] for a in at) + sum(m.factors[a] @ m.factors[b] for k, a in enumerate(at) for b in at[:k])
        assert abs(got[i] - 1 / (1 + np.exp(-margin))) < 1e-9 if at else got[i] == 0


def test_learns_what_is_toxic_only_together():
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"n{x}" for x in rng.integers(0, 200, 10)] + ["insult"] * a + ["group"] * b
        rows.append(" ".join(words))
        labels.append(int(a and b))
    t, p = toxicity.terms(pa.array(rows))
    sets = [t[p[i] : p[i + 1]] for i in range(len(rows))]
    m = toxicity.fit(sets[:3000], np.array(labels[:3000]), epochs=15)
    said = m.scores(pa.array(rows[3000:])) >= toxicity.THRESHOLD
    assert (said == np.array(labels[3000:], bool)).mean() > 0.97
    linear = toxicity.Model(m.bits, m.bias, m.known, m.linear, m.factors * 0)
    assert np.abs(linear.scores(pa.array(rows[3000:])) - m.scores(pa.array(rows[3000:]))).max() > 0.05


def test_pairs_of_terms_that_are_neutral_alone():
    """With what the query uses: nothing is passed but rows and labels."""
    rng = np.random.default_rng(4)
    texts, labels = [], []
    for _ in range(6000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([f"n{x}" for x in rng.integers(0, 200, 10)] + ["insult"] * a + ["group"] * b))
        labels.append(int(a != b))
    t, p = toxicity.terms(pa.array(texts))
    sets, y = [t[p[i] : p[i + 1]] for i in range(len(texts))], np.array(labels)
    marginal = np.abs(toxicity.evidence(sets[:5000], y[:5000], toxicity.BITS))
    own, _ = toxicity.terms(pa.array(["insult group"]))
    assert (marginal[own] < 3).all()
    m = toxicity.fit(sets[:5000], y[:5000])
    assert ((m.scores(pa.array(texts[5000:])) >= toxicity.THRESHOLD) == y[5000:].astype(bool)).mean() > 0.95


def test_gradients_are_those_of_the_loss():
    """One step from known weights, against the loss by finite differences."""
    rows = [np.array([0, 1, 2], np.int32), np.array([1, 3], np.int32), np.array([0, 3], np.int32), np.array([2], np.int32)]
    y = np.array([1.0, 0, 0, 1])
    rng = np.random.default_rng(0)
    w, v, b = rng.standard_normal(4), rng.standard_normal((4, 2)), 0.2

    def loss(w, v, b):
        out = 0.0
        for r, t in zip(rows, y):
            m = b + w[r].sum() + sum(v[i] @ v[j] for k, i in enumerate(r) for j in r[:k])
            out += np.log1p(np.exp(-m if t else m))
        return out / len(rows)

    ptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    t = np.concatenate(rows)
    gb, used, gw, gv = toxicity.gradients(b, w, v, t, ptr, y, np.ones(4), 0.0)
    assert used.tolist() == [0, 1, 2, 3]
    e = 1e-6
    assert abs((loss(w, v, b + e) - loss(w, v, b - e)) / (2 * e) - gb) < 1e-5
    for i in range(4):
        d = np.zeros(4)
        d[i] = e
        assert abs((loss(w + d, v, b) - loss(w - d, v, b)) / (2 * e) - gw[i]) < 1e-5
        for f in range(2):
            d = np.zeros((4, 2))
            d[i, f] = e
            assert abs((loss(w, v + d, b) - loss(w, v - d, b)) / (2 * e) - gv[i, f]) < 1e-5


def test_query_equals_a_slow_restatement(spark, medium):
    """Training on all labels, then scores by plain sums over pairs."""
    docs, labels = spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet")
    got = {r.doc_id: r.score for r in queries.op9_toxicity(spark, medium).collect()}
    model = toxicity.train(docs, labels)
    place = {int(k): i for i, k in enumerate(model.known)}
    want = {}
    for r in docs.collect():
        own = [place[x] for x in toxicity.terms(pa.array([r.text]))[0].tolist() if x in place]
        margin = model.bias + sum(float(model.linear[a]) for a in own) + sum(float(model.factors[a].astype(float) @ model.factors[b].astype(float)) for k, a in enumerate(own) for b in own[:k])
        if own and 1 / (1 + np.exp(-margin)) >= toxicity.THRESHOLD:
            want[r.doc_id] = 1 / (1 + np.exp(-margin))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-3 for i in want)


def test_held_out_accuracy(spark):
    """Half of the labels train, the other half judges."""
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    rows = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("text", "toxic").collect()
    y = np.array([r.toxic for r in rows], bool)
    said = model.scores(pa.array([r.text for r in rows])) >= toxicity.THRESHOLD
    assert said[y].mean() >= 0.88 and said[~y].mean() <= 0.005


def test_odd_rows(spark):
    docs = cases.odd(spark)
    extra = spark.createDataFrame([(100 + i, f"you {i} are scum plus trash {i * i}" if i % 2 else f"a fine {i} day out {i * i}", "en", "a", 1) for i in range(160)], cases.DOCS)
    docs = docs.unionByName(extra, allowMissingColumns=True)
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(120)] * 2 + [(None, 1), (9999, 1), (1, 0), (101, None)], "doc_id long, toxic int")
    found = toxicity.toxic_documents(docs, labels).collect()
    assert {r.doc_id for r in found} == {100 + i for i in range(1, 160, 2)} and all(r.score >= 0.5 for r in found)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 80
    one_class = labels.where("toxic = 0")
    assert toxicity.toxic_documents(docs, one_class).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, none).count() == docs.count()
    assert toxicity.toxic_documents(cases.empty(spark), labels).count() == 0
