import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tonemark.llm import bpe, queries, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture
def docs(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(30, 200)), "en", rng.choice(["a", "b", None]), 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "a", 0) for i in range(10)]
    rows += [(200, "token=abcdefgh1 " + prose(rng, 50), "en", "a", 0), (201, None, None, None, None), (202, "", "en", "a", 0)]
    rows += [(None, prose(rng, 60), "en", "b", 0), (5, rows[5][1], "en", rows[5][3], 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_stages_take_effect(spark, docs):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "secret_scan", "source_mixing", "bpe"]
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["quality_rules"](spark, docs, SF)
    assert kept.columns == docs.columns and {201, 202}.isdisjoint(r[0] for r in kept.select("doc_id").collect())
    assert kept.count() == 73
    alone = steps["simhash_near_dedup"](spark, kept, SF)
    ids = [r["doc_id"] for r in alone.select("doc_id").collect()]
    assert alone.columns == docs.columns and sorted(map(str, ids)) == sorted(map(str, [*range(60), 200, None]))
    clean = steps["secret_scan"](spark, alone, SF)
    assert clean.columns == docs.columns and clean.count() == len(ids)
    row = clean.where("doc_id = 200").first()
    assert row["text"].startswith("[secret] ") and row["n_chars"] == len(row["text"])
    mixed = steps["source_mixing"](spark, clean, SF)
    assert mixed.columns == docs.columns
    plan = queries.mixing
    sizes = clean.groupBy("source").agg(F.sum(plan.word_count(F.col("text"))).alias("source_size"))
    goal = {r["source"]: r["target"] for r in plan.targets(sizes).collect()}
    words = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(plan.word_count(F.col("text"))).alias("n")).collect()}
    assert all(abs(words[s] - goal[s]) <= 60 for s in goal)
    coded = steps["bpe"](spark, mixed, SF)
    codec = bpe.Codec(bpe.load_vocabulary(queries.VOCABULARY))
    want = sorted(codec.encode(r["text"]) for r in mixed.select("text").collect())
    got = coded.collect()
    assert sorted(bytes(r["ids"]) for r in got) == want and all(r["exact"] for r in got)


def test_words_are_counted_once_for_the_mix(spark, docs, monkeypatch):
    plans, mix = [], corpus_pipeline.mixing.mix
    kept = docs.where("text IS NOT NULL")

    def seen(rows, *rest):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return mix(rows, *rest)

    monkeypatch.setattr(corpus_pipeline.mixing, "mix", seen)
    assert corpus_pipeline.mix(spark, kept, SF).count() > 0
    assert len(plans) == 1 and "regexp" not in plans[0]


def test_stages_take_an_empty_table(spark, docs):
    rows = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF)
        assert rows.count() == 0


def test_run_equals_the_stages_on_a_table(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 100 and got.where(~F.col("exact")).count() == 0
    assert simhash.RADIUS == 4


@pytest.mark.parametrize("key", sorted(queries.QUERIES))
def test_every_query_returns_its_table(spark, key):
    got = queries.QUERIES[key](spark, SF)
    source = {"op7": "embeddings", "op10": "pages"}.get(key.split("_")[0], "documents")
    if not key.startswith("op5"):
        assert got.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
    else:
        assert got.count() > 0


def test_near_copies_keeps_unrelated_texts_without_or_with_equal_ids(spark):
    rng = random.Random(2)
    texts = [prose(rng, 80) for _ in range(12)]
    rows = [(None, t, "en", "a", 0) for t in texts[:6]] + [(7, t, "en", "a", 0) for t in texts[6:9]]
    rows += [(8, texts[9], "en", "a", 0), (None, texts[9], "en", "a", 0), (7, texts[9], "en", "b", 0)]
    rows += [(7, texts[6], "en", "a", 0), (None, texts[0], "en", "b", 0), (9, texts[10], "en", "a", 0), (9, texts[10], "en", "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, df, SF).collect()]
    want = [(None, t) for t in texts[:6]] + [(7, t) for t in texts[6:10]] + [(9, texts[10])]
    assert sorted(map(str, got)) == sorted(map(str, want))
