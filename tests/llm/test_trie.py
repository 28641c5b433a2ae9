import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from panelwright.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, words int, part int, sid long, k1 string, block int"


def content(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    """The trie with every subtree walked."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, content(role, text), role or "", text or ""))
    for conv in own:
        own[conv].sort()
    paths = {}
    for conv, found in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - (abs(conv) % 20) * (1 if conv >= 0 else -1)
        paths[conv] = tuple((role, text) for *_, role, text in own.get(base, [])[:h] + found[h:])
    nodes = defaultdict(list)
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(conv)
    children = defaultdict(list)
    for prefix in nodes:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", prefix[-1][1])) if prefix else 0
        saved[prefix] = (len(nodes[prefix]) - 1) * words + sum(saved[c] for c in children[prefix])
        leaves[prefix] = sum(leaves[c] for c in children[prefix]) or 1
    result = []
    for prefix, convs in nodes.items():
        ends = ",".join(str(c) for c in sorted(convs) if paths[c] == prefix)
        result.append((
            min(convs), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(convs), len(children[prefix]),
            leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(result, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*row, 1, 2, 3, "k", 5) for row in rows], SCHEMA)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def random_rows(seed, convs, texts=3, longest=7):
    draw = random.Random(seed)
    rows = []
    for _ in range(convs):
        conv = draw.randrange(-45, 3 * convs)
        rows += [(conv, turn, draw.choice(["user", "assistant", None]), draw.choice(["a b", "c", "", None][:texts])) for turn in range(draw.randrange(longest))]
    return rows


AWKWARD = [
    (0, None, "user", "first of all"), (0, 3, "user", "one two"), (0, 3, "assistant", "tie"), (0, 3, "assistant", "tie"), (1, 0, None, None),
    (1, 1, "user", "one two"), (2, 5, "user", "first of all"), (2, 9, "", "\t\n"), (None, 1, "user", "nobody"), (60, 0, "user", "x" * 5000),
    (61, 0, "user", "y"), (61, 1, "user", "y"), (-3, 0, "u", "ser"), (-4, 0, "us", "er"), (25, 0, "user", "one two"), (26, 1, "user", "one two"),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_walking_every_subtree(spark, seed):
    rows = random_rows(seed, 150) + (AWKWARD if seed == 1 else [])
    found = prefix_trie.trie(table(spark, rows).repartition(3), rest=20)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert rows_of(found) == brute(rows)


def test_long_conversations_run_over_blocks_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    draw = random.Random(5)
    path = [("user", draw.choice(["a", "b c"])) for _ in range(150)]
    rows = [(conv, turn, *path[turn]) for conv, size in ((0, 150), (20, 150), (40, 90), (60, 41), (80, 8)) for turn in range(size)]
    rows += random_rows(6, 10)
    assert rows_of(prefix_trie.trie(table(spark, rows), rest=5)) == brute(rows)


def test_one_first_turn_for_all(spark):
    rows = [(20 * c, t, "user", "hello" if t == 0 else f"turn {c % 40} {t}") for c in range(300) for t in range(3)]
    assert rows_of(prefix_trie.trie(table(spark, rows), rest=30)) == brute(rows)


def test_empty_and_turnless(spark):
    assert prefix_trie.trie(table(spark, [])).count() == 0
    rows = [(c, 0, "user", "only turn") for c in range(41, 59)]  # there is no conversation 40
    assert rows_of(prefix_trie.trie(table(spark, rows))) == brute(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 500])
def test_list_ranking(spark, size):
    draw = random.Random(size)
    order = draw.sample(range(10 * size), size)
    rows = [(e, order[i + 1] if i + 1 < size else -1, draw.randrange(3), draw.randrange(100)) for i, e in enumerate(order)]
    expected, leaves, saved = [], 0, 0
    for e, _, a, b in rows:
        expected.append((e, leaves, saved))
        leaves, saved = leaves + a, saved + b
    draw.shuffle(rows)
    found = prefix_trie.prefix_sums(spark.createDataFrame(rows, "id long, succ long, leaves long, saved long"), rest=4)
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_a_hot_conversation_and_a_hot_parent_are_dealt_over_tasks(spark):
    """One conversation has most turns: no partition of the numbered turns holds them all."""
    rows = [(40, t, "user", f"t{t}") for t in range(3000)] + [(c, 0, "user", "x") for c in range(100, 400)]
    own, spanning = prefix_trie.turns(table(spark, rows))
    assert [r.span_id for r in spanning.collect()] == [40]
    assert sorted(r.pos for r in own.where("conv_id = 40").collect()) == list(range(3000))
    parts = own.where("conv_id = 40").groupBy(prefix_trie.F.input_file_name()).count().collect()
    assert max(row["count"] for row in parts) < 2000
