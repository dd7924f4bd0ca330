"""The operators against plain versions, and their defined results for odd rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import brute
from tickloom.llm import (
    bit_sliced,
    components,
    decontamination,
    language,
    mixing,
    near_duplicates,
    substrings,
    token_files,
    toxicity,
)


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def counted(df, *columns):
    return Counter(pairs(df, *columns))


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(documents, size):
    found = near_duplicates.near_duplicates(documents, size)
    want = brute.near_duplicates(pairs(documents, "doc_id", "text"), size)
    assert counted(found, "doc_id", "n_shingles", "component_id", "kept") == want


def test_near_duplicates_in_long_lists(spark, monkeypatch):
    """A chain of texts, each near the next one only, and a common list longer than a block."""
    monkeypatch.setattr(near_duplicates, "PART", 4)
    monkeypatch.setattr(near_duplicates, "BLOCK", 6)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(40):
        text = base[: 120 - 3 * i] + [f"c{k}" for k in range(3 * i)]
        rows.append((100 - i, " ".join(text)))
    rows += [(200 + i, " ".join(base[:60] + [f"own{i}x{k}" for k in range(60)])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = near_duplicates.near_duplicates(df, 4)
    assert counted(found, "doc_id", "n_shingles", "component_id", "kept") == brute.near_duplicates(rows, 4)


def test_near_duplicates_odd(odd, none):
    found = near_duplicates.near_duplicates(odd, 4)
    want = brute.near_duplicates(pairs(odd, "doc_id", "text"), 4)
    assert counted(found, "doc_id", "n_shingles", "component_id", "kept") == want
    assert near_duplicates.near_duplicates(none).count() == 0


def test_near_duplicates_refuse_a_percent_that_loses_links(none):
    with pytest.raises(ValueError, match="80 percent"):
        near_duplicates.near_duplicates(none, 4, percent=79)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 7), (200, 200), (None, 3)]
    found = components.components(spark.createDataFrame(links, "a bigint, b bigint"))
    want = {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100, 200: 200}
    assert dict(pairs(found, "node", "label")) == want


@pytest.mark.parametrize(
    "chain",
    [
        [2, 5, 4, 3, 1],
        [1, 5, 3, 4, 2],
        [4, 2, 6, 5, 3, 1],
        [1, 3, 7, 4, 6, 5, 2],
        [1, 7, 8, 5, 4, 2, 6, 3],
        [4, 3, 7, 8, 6, 9, 1, 5, 2],
        [4, 9, 1, 7, 3, 6, 5, 2, 8, 10],
        [4, 3, 2, 8, 11, 9, 10, 6, 1, 5, 7],
        [3, 4, 12, 9, 6, 2, 8, 5, 11, 1, 10, 7],
    ],
)
def test_components_of_a_chain(spark, chain):
    """Numberings with which a node still points to two roots when no root points to any."""
    links = spark.createDataFrame(list(zip(chain, chain[1:])), "a bigint, b bigint")
    found = counted(components.components(links), "node", "label")
    assert found == Counter((node, 1) for node in chain)


def test_contamination(spark, folder, documents):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = decontamination.contamination(documents, items).withColumn("ids", F.concat_ws(",", "items"))
    want = brute.contamination(pairs(documents, "doc_id", "text"), pairs(items, "item_id", "text"), 10)
    assert counted(found, "doc_id", "n_words", "n_hit", "n_items", "ids", "contaminated") == want
    assert any(row[2] for row in want)


def test_contamination_odd(spark, odd, none):
    items = [(3, "same1 SAME2, same3"), (20, "same0 same1"), (3, "one"), (None, "12345"), (4, None), (5, "")]
    items = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.contamination(odd, items, 2).withColumn("ids", F.concat_ws(",", "items"))
    want = brute.contamination(pairs(odd, "doc_id", "text"), pairs(items, "item_id", "text"), 2)
    assert counted(found, "doc_id", "n_words", "n_hit", "n_items", "ids", "contaminated") == want
    assert decontamination.contamination(none, items).count() == 0
    clean = decontamination.contamination(odd, items.where("false"))
    assert clean.count() == odd.count() and not clean.where("contaminated").count()


def test_proximity(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e"), (2, "a x b c d e"), (3, "b a c x e d"), (4, "a b"), (5, "c d e")], "doc_id bigint, text string"
    )
    items = spark.createDataFrame([(1, "a b c d e")], "item_id bigint, text string")

    def hit(slack):
        found = decontamination.contamination(docs, items, 5, slack)
        return {r["doc_id"] for r in found.where("contaminated").collect()}

    assert hit(0) == {1}
    assert hit(1) == {1, 2}
    assert hit(2) == {1, 2, 3}


def test_tokens(documents, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_tokens(documents, path, sequence=64, folder=str(tmp_path))
    rows = sorted(pairs(documents, "doc_id", "text"))
    want = brute.tokens(rows, token_files.tokenizer(path))
    found = token_files.read_documents(manifest)
    assert sorted(pairs(found, "doc_id", "start", "n_tokens", "ids_crc32")) == want
    # any sequence, without reading the others
    stream = []
    for row in manifest.orderBy("shard").collect():
        file = token_files.TokenFile(row["path"])
        own = []
        for i in reversed(range(row["n_sequences"])):
            ids, mask = file[i]
            assert len(ids) == len(mask) == 64
            own.insert(0, ids[mask])
        stream.append(np.concatenate(own))
        assert len(stream[-1]) == row["n_tokens"]
    whole = [i for _, text in rows for i in [*token_files.tokenizer(path).encode(text, add_special_tokens=False).ids, 1]]
    assert np.concatenate(stream).tolist() == whole


def test_tokens_odd(odd, none):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = sorted(pairs(odd, "doc_id", "text"), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1]))
    want = brute.tokens(rows, token_files.tokenizer(path))
    for parts in (True, False):
        found = token_files.read_documents(token_files.write_tokens(odd, path, parts=parts))
        assert sorted(pairs(found, "start", "doc_id", "n_tokens", "ids_crc32")) == [(s, d, n, c) for d, s, n, c in want]
    assert token_files.read_documents(token_files.write_tokens(none, path)).count() == 0


def test_parts_give_the_ids_of_whole_texts():
    import public_tokenizers
    import pyarrow as pa

    texts = ["a<|endoftext|>b <|endoftext|> c", "ΟΔΟΣ ΣΣ", "é ́e", "it's we'll x", "x\x1cy\x85z", "ÀB\tC\r\nD 123", "<|start oftext|>"]
    whole = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"), False)
    parts = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"), True)
    for a, b in zip(whole(pa.array(texts)), parts(pa.array(texts))):
        assert a.tolist() == b.tolist()


def test_top_k(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = sorted(pairs(vectors, "vec_id", "embedding"))
    ids = np.array([r[0] for r in rows])
    numbers = np.floor(256 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        score = numbers @ numbers[q]
        order = [i for i in np.lexsort((ids, -score)) if i != q][:5]
        want += [(int(ids[q]), n + 1, int(ids[i]), int(score[i])) for n, i in enumerate(order)]
    found = bit_sliced.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)
    assert sorted(pairs(found, "query_id", "rank", "vec_id", "score")) == want


def test_top_k_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, -0.5]), (1, [1.0, -0.5]), (2, [1.0, -0.5]), (2, [1.0, -0.5]), (3, None), (4, [nan, 1.0]),
        (5, [inf, 0.0]), (6, [None, 1.0]), (7, []), (None, [5.0, 5.0]), (8, [0.25, 0.25, 0.25]), (9, [-3.0, 2.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = bit_sliced.top_k(df, df, 2)
    high = 256 * 256 + 128 * 128
    low = -3 * 256 * 256 - 2 * 256 * 128
    want = {
        (0, 1, 1, high), (0, 2, 2, high), (1, 1, 0, high), (1, 2, 2, high), (2, 1, 0, high), (2, 2, 1, high),
        (9, 1, 0, low), (9, 2, 1, low),
    }
    assert set(pairs(found, "query_id", "rank", "vec_id", "score")) == want
    assert bit_sliced.top_k(df.where("false"), df, 2).count() == 0


def test_bit_sliced_candidates_hold_the_best():
    generator = np.random.default_rng(5)
    for spread in (1, 3, 40, 3000):
        values = generator.integers(-spread, spread + 1, (300, 9))
        queries = generator.integers(-spread, spread + 1, (20, 9))
        index = bit_sliced.Slices(values)
        for q, rows in enumerate(index.candidates(queries, 5)):
            score = values @ queries[q]
            assert set(np.flatnonzero(score >= np.sort(score)[-5])) <= set(rows)


def test_bit_sliced_best_with_several_rows_under_the_own_id():
    values = np.array([[1000 - i] for i in range(4)] + [[100 + i] for i in range(20)], np.int64)
    ids = np.array([7] * 4 + list(range(20, 40)), np.int64)
    for k in (1, 2, 5):
        _, found, score = bit_sliced.Slices(values).best(values[:1], ids[:1], ids, k)
        assert ids[found].tolist() == list(range(39, 39 - k, -1))
        assert score.tolist() == [(119 - i) * 1000 for i in range(k)]


def test_language(spark, documents):
    model = language.train(documents)
    found = language.predict(documents, model).join(documents.select("doc_id", "lang"), "doc_id")
    held = found.where(toxicity.held_out(F.col("doc_id"))).where("lang_pred <> 'und'")
    right = held.where("lang = lang_pred").count()
    assert right >= 0.95 * held.count() > 0
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_odd(odd, none, documents):
    for model in (language.train(documents), language.train(odd), language.train(none)):
        found = language.predict(odd, model)
        assert found.count() == odd.count()
        by_id = {r["doc_id"]: r for r in found.where("doc_id in (4, 5, 6, 12)").collect()}
        assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in by_id.values())
        assert language.predict(none, model).count() == 0


def test_codewords():
    for n in (2, 3, 4, 7, 40):
        code = language.codewords(n)
        apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert len(code) == n and min(apart) >= code.shape[1] // 4 and min(apart) > 0


def test_toxicity(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels)
    assert 0 < len(model.feature) < 2000
    found = toxicity.score(docs, model, "score").join(labels, "doc_id")
    held = found.where(toxicity.held_out(F.col("doc_id")))
    rows = pairs(held, "score", "toxic")
    toxic = [s for s, t in rows if t]
    clean = [s for s, t in rows if not t]
    assert sum(a > b for a in toxic for b in clean) > 0.8 * len(toxic) * len(clean)


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, None), (None, 1), (7, 0), (77, 1), (4, 1)], "doc_id bigint, toxic int"
    )
    for model in (toxicity.train(odd, labels), toxicity.train(odd, labels.where("false")), toxicity.train(none, labels)):
        found = toxicity.score(odd, model, "score")
        assert found.count() == odd.count() and found.columns == [*odd.columns, "score"]
        assert not found.where("score is null or score < 0 or score > 1").count()
        assert toxicity.score(none, model, "score").count() == 0
    with pytest.raises(ValueError):
        toxicity.score(odd, model, "size")


def checked_mix(df):
    rows = pairs(mixing.copies(df), "doc_id", "source", "size", "source_size", "target", "copies", "taken")
    given = pairs(df, "doc_id", "source", "text")
    assert Counter(r[:3] for r in rows) == Counter((d, s, len(brute.blank_words(t))) for d, s, t in given)
    sizes = defaultdict(int)
    for _, source, size, *_ in rows:
        sizes[source] += size
    targets = brute.targets(sizes, (3, 1, 2), 1.5, 2.0)
    taken, biggest = defaultdict(int), defaultdict(int)
    for _, source, size, source_size, target, copies, words in rows:
        assert source_size == sizes[source] and target == pytest.approx(targets[source])
        assert words == size * copies <= 2 * size
        if target > 0:
            assert abs(copies - target / source_size) < 1
        taken[source] += words
        biggest[source] = max(biggest[source], size)
    for source, words in taken.items():
        assert abs(words - targets[source]) <= biggest[source] / 2 + 1
    assert sorted(map(repr, rows)) == sorted(
        map(repr, pairs(mixing.copies(df.repartition(3)), "doc_id", "source", "size", "source_size", "target", "copies", "taken"))
    )
    return rows


def test_mixing(documents):
    assert checked_mix(documents)


def test_mixing_many(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
        F.repeat(F.lit("w "), (F.pmod(F.hash("id"), F.lit(97)) + 1).cast("int")).alias("text"),
    )
    assert len(checked_mix(rows)) == 3000


def test_mixing_odd(odd, none):
    rows = checked_mix(odd)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r[5] for r in rows)
    assert mixing.copies(none).count() == 0 and mixing.mix(none).count() == 0


def test_repeats(documents):
    found = substrings.remove_repeats(documents, 50)
    want = brute.repeats(pairs(documents, "doc_id", "text"), 50)
    assert counted(found, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert any(row[2] for row in want)


@pytest.mark.parametrize("many", [1, 2048])
def test_repeats_inside_texts(spark, monkeypatch, many):
    monkeypatch.setattr(substrings, "MANY", many)
    passage = [f"p{i}" for i in range(90)]
    rows = [
        (i, " ".join([*(f"a{i}x{k}" for k in range(i * 3)), *passage[i % 7 : 90 - i % 5], *(f"b{i}x{k}" for k in range(40))]))
        for i in range(60)
    ]
    rows += [(100, "w " * 300), (101, "w " * 200 + "x " + "w " * 49), (102, "x " + "w " * 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = substrings.remove_repeats(df, 50)
    assert counted(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.repeats(rows, 50)


@pytest.mark.parametrize("size", [45, 70])
def test_repeats_of_a_common_passage(spark, monkeypatch, size):
    """A passage in all texts, with other words around it: no key of an index outgrows its bound."""
    monkeypatch.setattr(substrings, "MANY", 4)
    monkeypatch.setattr(substrings, "FULL", 500, raising=False)
    search = substrings._search

    def bounded(window):
        inner = search(window)

        def run(batches):
            batches, seen = list(batches), Counter()
            for batch in batches:
                for key, words in zip(batch.column("key").to_pylist(), batch.column("words").to_pylist()):
                    seen[key] += len(words)
            if max(seen.values(), default=0) > 500:
                raise ValueError("a key has too many words for an index")
            yield from inner(iter(batches))

        return run

    monkeypatch.setattr(substrings, "_search", bounded)
    passage = [f"p{i}" for i in range(size)]
    rows = []
    for i in range(60):
        before, after = ([f"{c}{i % 50}x{k}" for k in range(12 + i % 5)] for c in "ab")
        rows.append((100 - i, " ".join([*before, *passage, *after, f"end{i}"])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = substrings.remove_repeats(df, 50)
    want = brute.repeats(rows, 50)
    assert any(row[2] for row in want)
    assert counted(found, "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_repeats_odd(odd, none):
    found = substrings.remove_repeats(odd, 50)
    want = brute.repeats(pairs(odd, "doc_id", "text"), 50)
    assert counted(found, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    for row in found.collect():
        assert row["kept_sha256"] == hashlib.sha256(row["kept_text"].encode()).hexdigest()
    assert substrings.remove_repeats(none).count() == 0
