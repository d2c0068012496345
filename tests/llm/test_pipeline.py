from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_decontaminate import semi_global, words
from tests.llm.test_jaccard import brute
from tests.llm.test_sharding_mixing import plain_targets, trie
from thalweg.llm import mixing, sharding, toxicity


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    """Each stage against plain Python on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_copies", "decontamination", "mixing", "sharding"]
    clean = P.drop_toxic(spark, docs, sf_dir).cache()
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert clean.columns == docs.columns and 0.7 * docs.count() <= len(rows) < docs.count()
    scored = toxicity.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {d for d, _ in rows} == {r.doc_id for r in scored.where("predicted = 0").collect()}
    one = P.drop_near_copies(spark, clean, sf_dir)
    want = {c for d, n, c in brute(rows) if n} | {d for d, n, c in brute(rows) if not n}
    left = {r.doc_id: r for r in one.collect()}
    assert one.columns == docs.columns and set(left) == want
    kept = P.drop_benchmark_leaks(spark, one, sf_dir)
    items = [w for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if (w := words(r.text))]

    def leaks(text):
        own = words(text or "")
        known = set(own)
        return any(sum(w not in known for w in item) <= len(item) // 5 and semi_global(item, own) <= len(item) * 20 // 100 for item in items)

    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in left.items() if not leaks(r.text)}
    inside = kept.collect()
    mixed = P.mix_sources(spark, kept, sf_dir)
    plan = {r.doc_id: r for r in mixing.mix_documents(kept).collect()}
    size = Counter()
    for r in inside:
        size[r.source] += len((r.text or "").split())
    goal, taken = plain_targets(size), Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and all(taken[d] == int(r.taken / r.size + 0.5) for d, r in plan.items() if r.size)
    for source, n in goal.items():
        got = sum(taken[r.doc_id] * len((r.text or "").split()) for r in inside if r.source == source)
        assert abs(got - n) <= max(len((r.text or "").split()) for r in inside if r.source == source)
    shards = P.shard(spark, mixed, sf_dir).collect()
    repeated = [(r.doc_id, r.text) for r in mixed.collect()]
    leaf = trie(repeated, sharding.SHARD_BYTES)
    assert Counter((r.doc_id, r.shard, r.shard_bytes) for r in shards) == Counter((d, *leaf[i]) for i, (d, _) in enumerate(repeated))


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_odd_rows_in_every_stage(spark, sf_dir, name, stage):
    """Null ids, texts, languages and sources, empty and repeated rows, and columns whose names the operators use."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    odd = [(None, "some plain words that nobody minds", None, None, None), (None, None, None, None, None), (900001, "", "en", "web", 0), (900001, "", "en", "web", 0), (900002, "twice the same row here", "en", "web", 23), (900002, "twice the same row here", "en", "web", 23), (900003, " \t", "en", None, 2), (900004, "word " * 30000, "en", "books", 150000)]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema))
    docs = docs.withColumns({c: F.lit(k) for k, c in enumerate(("row", "set_id", "component", "toxic", "item_id", "size", "_size", "_id", "_position", "cell", "depth", "h", "key", "score"))})
    out = stage(spark, docs, sf_dir)
    rows = out.collect()
    if name != "sharding":
        assert out.columns == docs.columns
    ids = Counter(r.doc_id for r in rows)
    if name != "mixing":  # texts without words take no place in a mix
        assert ids[900001] == 2 and ids[900003] == 1 and ids[None] == 2
        assert ids[900002] == (1 if name == "near_copies" else 2)
    assert ids[900004] == (0 if name == "mixing" else 1)  # its source is given less than half of its words
    assert stage(spark, docs.limit(0), sf_dir).collect() == []
