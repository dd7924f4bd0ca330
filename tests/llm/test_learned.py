"""The learned operators against plain versions, and with labels or texts that are out of proportion."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm import brute
from tickloom.llm import bit_sliced, language, toxicity
from tickloom.llm.words import slices

LABELLED = "doc_id bigint, toxic int"


@pytest.fixture(scope="module")
def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


def plain_weights(rows, passes, seen):
    """Weights over word tuples, from (place, label, text)."""
    sets = []
    for _, label, text in sorted(rows, key=lambda r: r[:2]):
        w = brute.plain_words(text)
        sets.append((label, {(x,) for x in w} | {(0, *x) for x in zip(w, w[1:])} | {(1, *x) for x in zip(w, w[2:])}))
    often = Counter(f for _, own in sets for f in own)
    z, n, bz, bn = defaultdict(float), defaultdict(float), 0.0, 0.0
    alpha, beta, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(z, n, l1):
        return 0.0 if abs(z) <= l1 else (math.copysign(l1, z) - z) / ((beta + math.sqrt(n)) / alpha + l2)

    for _ in range(passes):
        for label, own in sets:
            own = [f for f in own if often[f] >= seen]
            w = {f: weight(z[f], n[f], l1) for f in own}
            bias = weight(bz, bn, 0.0)
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()) + bias)))) - label
            for f in own:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
            bz, bn = bz + g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * bias, bn + g * g
    found = [weight(z[f], n[f], l1) for f in z]
    return sorted(x for x in found if x), weight(bz, bn, 0.0)


def test_weights_are_those_of_plain_ftrl(spark, documents, labels):
    model = toxicity.train(documents, labels)
    rows = documents.join(labels, "doc_id").where("toxic is not null").where(~toxicity.held_out(F.col("doc_id")))
    rows = [tuple(r) for r in rows.select(F.xxhash64("doc_id"), "toxic", "text").collect()]
    weights, bias = plain_weights(rows, toxicity.PASSES, toxicity.SEEN)
    assert len(weights) > 5
    assert sorted(model.weight.tolist()) == pytest.approx(weights, rel=1e-6)
    assert model.bias == pytest.approx(bias, rel=1e-6)


def same(one, two):
    return one.feature.tolist() == two.feature.tolist() and one.weight.tolist() == two.weight.tolist() and one.bias == two.bias


def test_labels_of_other_documents_change_nothing(spark, documents, labels):
    model = toxicity.train(documents, labels)
    other = spark.range(10**9, 10**9 + 3_000_000).select("id", (F.col("id") % 2).cast("int").alias("toxic"))
    more = labels.select("doc_id", F.col("toxic").cast("int")).unionByName(other.toDF("doc_id", "toxic"))
    assert model.learned and same(toxicity.train(documents, more), model)


def test_one_doc_id_with_a_third_of_the_rows(spark, documents, labels):
    """Its many texts give one example, the same one in any order."""
    named = labels.where("toxic = 1").where(~toxicity.held_out(F.col("doc_id"))).first()["doc_id"]
    own = documents.where(F.col("doc_id") == named)
    copies = own.crossJoin(spark.range(300)).withColumn("text", F.concat("text", F.lit(" "), F.col("id"))).drop("id")
    one, two = (toxicity.train(documents.unionByName(copies).repartition(n), labels) for n in (3, 7))
    assert one.learned and same(one, two)


@pytest.mark.parametrize("kept", ["false", "toxic = 1", "toxic = 0", "doc_id < 0"])
def test_without_labels_of_both_kinds_nothing_is_toxic(spark, documents, labels, kept, tmp_path):
    labels.where(kept).write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.drop_toxic(spark, documents, str(tmp_path))
    assert found.count() == documents.count() and found.columns == documents.columns


def plain_language(rows, texts):
    """Predictions for ``texts`` from (text, lang), by sums over dictionaries."""

    def runs(text):
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        out = Counter()
        for size in (1, 2, 3):
            for i in range(len(data) - size + 1):
                key = int.from_bytes(data[i : i + size], "big") + (size << 24)
                out[(key * 2654435761 & 0xFFFFFFFF) >> 19] += 1
        return out

    total, number = defaultdict(Counter), Counter()
    for text, lang in rows:
        own = runs(text)
        number[lang] += 1
        for bucket, n in own.items():
            total[lang][bucket] += n / own.total()
    names = sorted(total)
    code = language.codewords(len(names)).tolist()
    frequency = {x: [total[x][b] / number[x] + 1e-6 for b in range(language.BUCKETS)] for x in names}
    weights = []
    for bit in range(len(code[0])):
        sides = [[frequency[x] for x, word in zip(names, code) if word[bit] == value] for value in (1, 0)]
        means = [[sum(column) / len(side) for column in zip(*side)] for side in sides]
        weights.append([math.log(a) - math.log(b) for a, b in zip(*means)])
    out = []
    for text in texts:
        own = runs(text)
        scale = math.sqrt(own.total() + 1)
        margins = [sum(n * w[b] for b, n in own.items()) / scale for w in weights]
        loss = [sum(math.log1p(math.exp(-m if bit else m)) for m, bit in zip(margins, word)) for word in code]
        best = min(range(len(names)), key=loss.__getitem__)
        out.append((names[best], 1 / sum(math.exp(loss[best] - x) for x in loss)))
    return out


def test_languages_are_those_of_the_plain_version(documents):
    rows = documents.where("lang is not null and text is not null").where(~toxicity.held_out(F.col("doc_id")))
    texts = {r["doc_id"]: r["text"] for r in documents.where("text rlike '[a-z]'").orderBy("doc_id").limit(60).collect()}
    found = {r["doc_id"]: r for r in language.predict(documents, language.train(documents)).collect()}
    want = plain_language([tuple(r) for r in rows.select("text", "lang").collect()], texts.values())
    for doc_id, (lang, score) in zip(texts, want):
        assert found[doc_id]["lang_pred"] == lang and found[doc_id]["score"] == pytest.approx(score, abs=1e-4)


def test_many_short_texts_are_taken_a_few_at_a_time(spark, documents, monkeypatch):
    texts = pa.array([None, "", "a", "abc"] * 2_500)
    batch = pa.record_batch([texts], names=["text"])
    parts = [part.num_rows for part in slices(batch, "text", language.PART, language.ROWS)]
    assert sum(parts) == 10_000 and max(parts) == language.ROWS
    short = spark.range(100_000).selectExpr("id as doc_id", "element_at(array(null, '', 'a'), cast(id % 3 as int) + 1) as text", "'xx' as lang")
    model = language.train(documents.select("doc_id", "text", "lang").unionByName(short))
    assert "xx" in model.languages
    assert language.predict(short, model).groupBy("lang_pred").count().count() <= 3


def test_top_k_with_repeated_rows(spark):
    rows = [(50, [1.0]), (50, [1.0]), (1, [2.0]), (1, [2.0]), (2, [3.0]), *[(3, [0.5])] * 9]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = bit_sliced.top_k(df, df.where("vec_id = 50"), 5).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in found] == [(1, 2), (2, 1), (3, 1), (4, 3), (5, 3)]
    few = bit_sliced.top_k(df.where("vec_id <> 3"), df.where("vec_id = 50"), 5)
    assert few.count() == 3


def test_top_k_with_queries_in_several_rounds(spark, monkeypatch):
    generator = np.random.default_rng(3)
    values = generator.integers(-20, 20, (300, 4))
    df = spark.createDataFrame([(i, [float(x) / 256 for x in v]) for i, v in enumerate(values)], "vec_id bigint, embedding array<double>")
    whole = sorted(map(tuple, bit_sliced.top_k(df, df, 3).collect()))
    score = values @ values.T
    for query, rank, vec, found in whole:
        order = sorted((-int(score[query, i]), i) for i in range(300) if i != query)
        assert order[rank - 1] == (-found, vec)
    assert len(whole) == 900
