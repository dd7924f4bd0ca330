"""The trie of conversations against a plain one of dictionaries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, n int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(sequences):
    """Rows of the trie from {conv_id: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1].encode()) if node else 0
    out = Counter()
    for node, own in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out[(min(own), len(node), parent, len(own), children[node], leaves[node], saved[node], digest)] += 1
    return out


def ordered(rows):
    """{conv_id: [(role, text), ...]} of rows without ties."""
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(own)] for c, own in found.items()}


def trie(frame):
    return Counter(map(tuple, prefix_trie.prefix_trie(frame).select(*COLUMNS).collect()))


def rows_of(sequences):
    return [(c, i, role, text, "x", 1) for c, turns in sequences.items() for i, (role, text) in enumerate(turns)]


def some(kind, r):
    letters = [("user", "a"), ("user", "é"), ("assistant", "a"), ("user", "")]
    if kind == "random":
        return {c: [r.choice(letters) for _ in range(r.randint(1, 7))] for c in range(250)}
    if kind == "chain":  # each is the beginning of the next, and one branch leaves at each depth
        line = [("user", f"t{i}") for i in range(45)]
        return {c: line[: c + 1] for c in range(45)} | {100 + c: [*line[: c + 1], ("user", "off")] for c in range(45)}
    if kind == "copies":
        return {c: [("user", "same"), ("assistant", "same")] for c in range(60)} | {-5: [("user", "same")]}
    return {c: [("user", "hub"), *[("user", f"{c % 20}")] * (c % 37)] for c in range(120)}  # long runs below one turn


@pytest.mark.parametrize("kind", ["random", "chain", "copies", "hub"])
def test_tries(spark, kind):
    sequences = some(kind, random.Random(5))
    frame = spark.createDataFrame(rows_of(sequences), SCHEMA)
    assert trie(prefix_trie.sequences(frame)) == plain(sequences)


def test_rebuilt_and_odd_rows(spark, folder):
    rows = [
        (0, None, "user", "first"), (0, 2, None, "x"), (0, 1, "user", None), (3, 1, "user", "own"), (3, 0, None, None),
        (7, 0, "user", "no base"), (8, 0, "user", "no base"), (None, 0, "user", "nobody"), (None, None, None, None), (10, 0, "user", ""),
    ]
    small = spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA)
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    given = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    for frame, source in ((small, rows), (table, given)):
        own = ordered(source)
        want = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            want[c] = own.get(c - c % 5, [])[:h] + turns[h:]
        assert trie(prefix_trie.rebuilt(prefix_trie.sequences(frame))) == plain(want)


def test_nothing_and_ties(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert not trie(prefix_trie.sequences(none))
    turnless = spark.createDataFrame([(4, []), (2, [])], "conv_id bigint, turns array<struct<high:bigint,low:bigint,size:bigint>>")
    assert trie(turnless) == plain({4: [], 2: []})
    tied = [(c, 1, "user", t, "p", 1) for c, texts in ((1, "abca"), (2, "caab")) for t in texts]
    found = trie(prefix_trie.sequences(spark.createDataFrame(tied, SCHEMA)))
    assert sorted(row[3] for row in found.elements()) == [2] * 5  # rows of one turn have one order wherever they stand


def test_two_fattest(spark):
    rows = [(a, b) for a in range(40) for b in range(a + 1, 70)]
    df = spark.createDataFrame(rows, "a int, b int").select("a", "b", prefix_trie.two_fattest("a", "b").alias("f"))
    for a, b, f in df.collect():
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_a_key_does_not_depend_on_what_stands_around(spark):
    df = spark.createDataFrame(rows_of({1: [("user", "a"), ("user", "b")], 2: [("user", "a"), ("user", "c")]}), SCHEMA)
    hashed = prefix_trie.sequences(df).coalesce(1).mapInArrow(
        prefix_trie._hash_prefixes, f"conv_id bigint, n int, keys {prefix_trie._KEYS}, sizes array<bigint>"
    )
    one, two = hashed.orderBy("conv_id").select(F.col("keys")).collect()
    assert one[0][0] == two[0][0] and one[0][1] != two[0][1]
