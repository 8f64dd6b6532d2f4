import collections

import corpus_pipeline
from millrace.llm import near, queries, tokens
from tests.llm import cases
from tests.llm.test_near import roots, truth


def test_stages_in_order(spark, medium):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    before = docs.collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    bench = [" ".join(cases.words(r.text)) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, medium)
        rows = out.collect()
        ids, had = {r.doc_id for r in rows}, {r.doc_id for r in before}
        if name != "token_ids":
            assert out.columns == docs.columns and ids <= had
        if name == "toxicity":
            toxic = {i for i, t in labels.items() if t == 1}
            assert had - ids == {r.doc_id for r in queries.op9_toxicity(spark, medium).collect()}
            assert len(ids & toxic) <= 0.35 * len(toxic) and len({i for i, t in labels.items() if t == 0} - ids) <= 6
        if name == "near_duplicates":
            assert ids == had - {r.doc_id for r in near.near_duplicates(docs).collect()} and len(rows) == len(ids)
            sets, alike = truth([(r.doc_id, r.text) for r in before])
            root = roots(sets, [p for p, j in alike.items() if j >= near.THRESHOLD])
            least = {i for i, r in root.items() if i == r}  # the first of each group, by all pairs
            assert least <= ids and len(ids - least) <= 0.01 * len(had - least)
        if name == "decontamination":
            spans = lambda t: {tuple(w[i : i + 13]) for w in [cases.words(t)] for i in range(len(w) - 12)}
            known = {s for b in bench for s in spans(b)}
            assert had - ids == {r.doc_id for r in before if spans(r.text) & known} != set()
        if name == "mixing":
            per, now = collections.Counter(r.source for r in before), collections.Counter(r.source for r in rows)
            mass = sum(n**0.7 for n in per.values())
            assert all(abs(now[s] - len(before) * n**0.7 / mass) < 1 for s, n in per.items())
        if name == "token_ids":
            text = {r.doc_id: r.text for r in before}
            assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r.doc_id for r in before)
            for r in rows[::50]:
                assert tokens.encoding().decode(tokens.unpack(bytes(r.tokens), r.n_tokens, r.bits, r.block_offsets).tolist()) == text[r.doc_id]
        docs, before = spark.createDataFrame(rows, out.schema) if name != "token_ids" else out, rows


def test_run_is_the_stages_one_after_another(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    n = corpus_pipeline.run(spark, small).count()
    assert 0 < n < docs.count()


def test_stages_take_odd_rows(spark, small):
    docs = cases.odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert stage(spark, cases.empty(spark), small).count() == 0
        if name != "token_ids":
            assert out.columns == docs.columns and 0 < out.count() <= docs.count() + 3
