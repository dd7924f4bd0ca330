import hashlib

import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import chat, license_texts, licenses

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
HARD = st.lists(st.sampled_from([*"\\ok <>/s[]\né", *chat.CONTROL]), max_size=12).map("".join)


@given(HARD, st.sampled_from(["user", "assistant", "system", "", "a[/ROLE]b", "user\\"]))
def test_turns_can_be_read_back(text, role):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)
    assert chat.parse_turn("".join(chat.format_turn(role, text))) == (role, text)


def plain(turns):
    """Expected rows of read_conversations from {conv_id: [(turn, role, text)]}."""
    out = set()
    for conv_id, rows in turns.items():
        rows = sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
        rows = [(role or "", text or "") for _, role, text in rows]
        said = "".join(text for role, text in rows if role == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
        size = sum(len("".join(chat.format_turn(r, t))) for r, t in rows)
        out.add((conv_id, len(rows), digest, len(said), hashlib.sha256(said.encode()).hexdigest(), size))
    return out


def check(df):
    turns = {}
    for r in df.select("conv_id", "turn", "role", "text").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    tree, members = chat.build_tree(df, VOCABULARY)
    found = chat.read_conversations(tree, members, VOCABULARY)
    assert {tuple(r) for r in found.collect()} == plain(turns)

    nodes = {bytes(r["key"]): r for r in tree.collect()}
    # each prefix once, no gaps and no overlaps in the stream
    prefixes = set()
    for rows in turns.values():
        rows = sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
        prefixes |= {tuple((r or "", t or "") for _, r, t in rows[: i + 1]) for i in range(len(rows))}
    assert len(nodes) == len(prefixes) == tree.count()
    at = 0
    stack = []
    for node in sorted(nodes.values(), key=lambda r: r["start"]):
        assert node["start"] == at
        at += len(node["ids"])
        # depth-first: the parent is the last node on the way here
        while stack and stack[-1] != bytes(node["parent"]):
            stack.pop()
        assert bytes(node["parent"]) == (stack[-1] if stack else b"")
        assert node["depth"] == len(stack)
        assert node["position"] == sum(len(nodes[k]["ids"]) for k in stack)
        seen = {t for s, e in node["attends"] for t in range(s, e)}
        assert seen == {t for k in stack for t in range(nodes[k]["start"], nodes[k]["start"] + len(nodes[k]["ids"]))}
        assert all(a["last"] < b["first"] for a, b in zip(node["attends"], node["attends"][1:]))
        stack.append(bytes(node["key"]))
    return nodes


def test_tree_of_the_given_conversations(spark, folder):
    df = spark.read.parquet(f"{folder}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], df.schema)
    assert check(df.unionByName(more))


def test_tree_with_forks_and_odd_rows(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"turn {t} of {c // 2 ** (6 - t)}") for c in range(64) for t in range(6)]
    rows += [(100 + c, t, "user", f"long {t}") for c in range(3) for t in range(30 - c)]
    rows += [(200, 0, None, None), (200, 1, "assistant", ""), (201, 0, "user", "a"), (201, 0, "user", "a")]
    rows += [(None, 0, "user", "nobody"), (None, None, "system", "s"), (202, 5, "tool", "[/ROLE]</s>\\")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    nodes = check(df.withColumn("key", F.lit("clash")))
    assert max(len(n["attends"]) for n in nodes.values()) > 1
    assert not check(df.where("false"))


def test_licenses(spark, odd):
    rows = [
        ("a/LICENSE", "Released under the MIT License.\n"),
        ("a/b/c/one.py", "# some code\nx = 1"),
        ("a/b/COPYING", "licensed under the apache license version 2.0"),
        ("a/b/two.py", "# Licensed under CC BY-NC 4.0.\n" + "code " * 300),
        ("a/three.py", "nothing here"),
        ("b/four.py", "nothing here either"),
        ("five.py", "x"),
        (None, "Released under the MIT License."),
        ("a/null.py", None),
        ("a/b/long.py", "word " * 50_000 + "\nThis work is licensed under the GNU General Public License, version 3.\n"),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id bigint, path string, text string")
    found = {r["doc_id"]: (r["license"], r["inherited"], r["license_path"]) for r in licenses.scan(df).collect()}
    assert found == {
        0: ("MIT", False, None),
        1: ("Apache-2.0", True, "a/b/COPYING"),
        2: ("Apache-2.0", False, None),
        3: ("CC-BY-NC-4.0", False, None),
        4: ("MIT", True, "a/LICENSE"),
        5: (None, False, None),
        6: (None, False, None),
        7: ("MIT", False, None),
        8: ("MIT", True, "a/LICENSE"),
        9: ("GPL-3.0", False, None),
    }
    again = licenses.scan(df.unionByName(df))
    assert again.count() == 2 * len(rows)
    assert licenses.scan(odd.withColumn("path", F.lit("x/y"))).count() == odd.count()
    assert licenses.scan(df.where("false")).count() == 0


def test_wrapped_headers_and_full_texts(spark):
    texts = {}
    for name, text in license_texts.TEMPLATES:
        texts.setdefault(name, []).append(text)
    code = "\n".join(f"x{i} = call{i}(y{i})" for i in range(400))
    rows = []
    for name, own in texts.items():
        for i, text in enumerate(own):
            commented = "\n".join(f" * {line}" for line in text.split("\n"))
            rows.append((f"h/{name}{i}.c", f"/* one{i}.c - does things\n{commented}\n */\n{code}", name, False))
        rows.append((f"{name}/LICENSE", f"Copyright (c) 2020 Some Body\n\n{own[-1]}\n", name, False))
        rows.append((f"{name}/src/main.c", code, name, True))
    short = "\n".join(f"# {' '.join(license_texts.TEMPLATES[6][1].split()[i:i + 5])}" for i in range(0, 99, 5))
    rows += [("n/wrapped.py", f"{short}\n{code}", "GPL-3.0", False), ("n/none.c", code, None, False)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, *_) in enumerate(rows)], "doc_id bigint, path string, text string")
    found = {r["path"]: (r["license"], r["inherited"]) for r in licenses.scan(df).collect()}
    assert found == {path: (name, inherited) for path, _, name, inherited in rows}


def test_licenses_of_the_documents(documents):
    from tickloom.llm.queries import op4

    import llm.brute as brute

    known = {" ".join(brute.plain_words(text)): name for name, text in licenses.NOTICES.items()}
    found = {r["doc_id"]: r for r in op4(documents.sparkSession, "/root/testdata/sf0.001").collect()}
    for row in documents.collect():
        lines = [" ".join(brute.plain_words(line)) for line in row["text"].split("\n")]
        own = [known[line] for line in lines if line in known]
        if own:
            assert found[row["doc_id"]]["license"] in own and not found[row["doc_id"]]["inherited"]
            assert found[row["doc_id"]]["score"] == pytest.approx(1)
        else:
            assert found[row["doc_id"]]["license"] is None or found[row["doc_id"]]["inherited"]
