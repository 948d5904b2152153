"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from panellink.llm import decontam, mixing, sharding, simhash, toxicity
from tests.llm.test_operators import brute_decontam, jaccard, shingles

SF = "/root/testdata/sf0.001"


def similar_components(texts):
    sets = [shingles(t) for t in texts]
    roots = list(range(len(sets)))

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                roots[find(a)] = find(b)
    return [find(a) for a in range(len(sets))]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((name, docs, after))
        docs = after
    assert [s[0] for s in seen] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    assert all(after.columns == before.columns for _, before, after in seen[:4])
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]

    _, before, after = seen[0]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score_documents(before, model).where("predicted = 1").collect()}
    assert Counter(rows(after)) == Counter(r for r in rows(before) if r[0] not in toxic)

    # near duplicates are those of Jaccard 0.8 over five-word shingles
    _, before, after = seen[1]
    first, roots = {}, similar_components([t for _, t in rows(before)])
    for (i, _), root in zip(rows(before), roots):
        first[root] = min(first.get(root, i), i)
    assert {i for i, _ in rows(after)} == set(first.values()) and after.count() == len(first)

    _, before, after = seen[2]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute_decontam(rows(before), items) if r[-1]}
    assert Counter(rows(after)) == Counter(r for r in rows(before) if r[0] not in dirty)

    _, before, after = seen[3]
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(before).collect()}
    assert Counter(rows(after)) == Counter({r: taken[r[0]] for r in rows(before) if taken[r[0]]}) and max(taken.values()) <= 3

    _, before, after = seen[4]
    alone = {r["doc_id"]: (r["shard"], r["text_crc32"]) for r in sharding.shard_documents(before).collect()}
    assert {r["doc_id"]: (r["shard"], r["text_crc32"]) for r in after.collect()} == alone
    assert Counter(rows(after)) == Counter(rows(before))
    slots = after.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in slots)


def test_near_dedup_keeps_no_pair_at_the_threshold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    sets = [shingles(r["text"]) for r in kept.collect()]
    assert not [1 for k, a in enumerate(sets) for b in sets[:k] if jaccard(a, b) >= 0.8]


def test_contract_columns(spark):
    from panellink.llm.queries import oracle_sql, queries

    assert list(queries()) == sorted(queries(), key=lambda n: int(n[2:].split("_")[0])) and set(oracle_sql()) <= set(queries())
    assert corpus_pipeline.ORACLE_SQL is None and decontam.op4_decontaminate and simhash.op5_simhash
