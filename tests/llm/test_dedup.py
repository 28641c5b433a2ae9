"""Exact and near duplicates and repeated passages against brute force."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import takewhile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import exact_dedup, near_dup, repeats
from panelwright.llm.words import hashed_words, sequences
from tests.llm import corpus


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_exact_groups(spark):
    rows = corpus.texts()
    found = exact_dedup.exact_groups(corpus.documents(spark).repartition(7)).collect()
    assert len(found) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    expected = sorted(
        (str(i), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in rows
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == expected
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_one_row_of_each_group_of_equal_texts_stays(spark):
    docs = corpus.documents(spark)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in corpus.texts()})
    assert {r.doc_id for r in kept.where("text = '" + corpus.texts()[0][1] + "'").collect()} == {1}
    hot = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', cast(id % 40 AS string)) AS text")
    assert {(r.text, r.doc_id) for r in exact_dedup.keep_one(hot.repartition(20)).collect() if r.text == "hot"} == {("hot", 2997)}


def test_digests_that_agree_by_chance_stay_apart(spark):
    rows = [(1, b"d", 3, 7), (2, b"d", 3, 8), (3, b"d", 4, 7), (4, b"d", 3, 7)]
    table = spark.createDataFrame(rows, "doc_id long, digest binary, n_bytes long, second long").repartition(3)
    merged = {(r.n_bytes, r.second): (r.keep_id, r.size, r.ties) for r in exact_dedup.merge_tree(table).collect()}
    assert merged == {(3, 7): (4, 2, 1), (3, 8): (2, 1, 1), (4, 7): (3, 1, 1)}


def test_a_task_with_many_rows_merges_them(spark):
    """More rows in one task than a run is built of."""
    docs = spark.range(0, 450_000, 1, 1).selectExpr("id AS doc_id", "concat('t', id % 300000) AS text")
    found = exact_dedup.exact_groups(docs).groupBy("group_size", F.expr("doc_id < 150000"), F.expr("keep_id - doc_id"), "kept", "ties").count().collect()
    assert sorted(map(tuple, found)) == [(1, False, 0, True, 1, 150_000), (2, False, 0, True, 1, 150_000), (2, True, 300_000, False, 1, 150_000)]


def test_one_row_of_each_group_stays_when_a_task_has_many_rows(spark):
    docs = spark.range(0, 450_000, 1, 1).selectExpr("id AS doc_id", "concat('t', id % 300000) AS text", "id % 3 AS other")
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.agg(F.count("*"), F.countDistinct("text"), F.min("doc_id"), F.sum("doc_id")).first() == (300_000, 300_000, 150_000, sum(range(150_000, 450_000)))


@pytest.mark.parametrize("run", ["_build_runs", "_merge_runs"])
def test_runs_are_merged_whatever_their_columns_say_of_nulls(run, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 40)
    marked = {"ties", "size"}
    kinds = {"place": pa.int32(), "digest": pa.binary(), "n_bytes": pa.int64(), "second": pa.int64(), "keep_id": pa.int64(), "ties": pa.int64(), "size": pa.int64()}
    schema = pa.schema([pa.field(name, kind, name not in marked) for name, kind in kinds.items()])
    rows = [{"place": i % 3, "digest": b"%d" % (i % 30), "n_bytes": i % 2, "second": 7, "keep_id": None if i % 7 == 0 else i, "ties": 1, "size": 1} for i in range(1000)]
    made = getattr(exact_dedup, run)(pa.RecordBatch.from_pylist(rows[at : at + 10], schema=schema) for at in range(0, 1000, 10))
    got = defaultdict(list)
    for r in pa.Table.from_batches(list(made)).to_pylist():
        got[r["place"], r["digest"]].append((r["keep_id"], r["size"]))
    wanted = defaultdict(list)
    for r in rows:
        wanted[r["place"], r["digest"]].append((r["keep_id"], 1))
    largest_and_rows = lambda found: {k: (max(i for i, _ in v if i is not None), sum(n for _, n in v)) for k, v in found.items()}
    assert largest_and_rows(got) == largest_and_rows(wanted)
    assert all(len(v) == 1 for v in got.values()) or run == "_build_runs"


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus.texts()
    found = near_dup.near_duplicates(corpus.documents(spark)).collect()
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    names = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[top(i)].append(doc)
    expected = [(doc, len(sets[i]), min(names[top(i)], default=None) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in found)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_one_document_of_each_near_group_stays(spark):
    docs = corpus.documents(spark, [(5, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (9, None), (8, "q")])
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, "A b c d e f"), (8, "q"), (9, None)]


def test_null_ids_and_shared_ids_leave_one_row(spark):
    base, other, shared, alone = (corpus.prose(200, seed) for seed in (60, 61, 62, 63))
    rows = [(None, base), (7, corpus.edited(base, 180, 1)), (None, base + " tail"), (4, shared), (4, re.sub("[a-z]", lambda m: m.group().upper(), shared)), (4, shared + " end")]
    rows += [(None, other), (None, other), (None, other + " tail"), (None, alone)]
    docs = corpus.documents(spark, rows)
    kept = near_dup.keep_one(docs).collect()
    stems = sorted(r.text.lower()[:40] for r in kept)
    assert stems == sorted(text[:40] for text in (rows[1][1], shared, other, alone))
    flags = near_dup.near_duplicates(docs).collect()
    assert [r.kept for r in flags if r.component_id == 7 and r.doc_id is None] == [False, False]
    assert sum(r.leads for r in flags if r.doc_id == 4) == 1 and all(r.kept for r in flags if r.doc_id == 4)


def test_every_row_that_names_its_component_is_kept_by_contract(spark):
    text = corpus.prose(200, 70)
    found = near_dup.near_duplicates(corpus.documents(spark, [(1, text + " extra"), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert sum(r.leads for r in found) == 1


def test_a_hot_centre_is_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", 5)
    monkeypatch.setattr(near_dup, "SALTS", 4)
    base = corpus.prose(150, 71)
    rows = [(i, f"{base} tail{i}") for i in range(60)] + [(100 + i, corpus.prose(30, 200 + i)) for i in range(10)]
    found = near_dup.near_duplicates(corpus.documents(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: 0 for i in range(60)} | {100 + i: 100 + i for i in range(10)}


def test_bounds_lose_no_link_and_densified_bins_agree():
    draw = random.Random(1)
    sets = []
    for _ in range(300):
        size = draw.choice([1, 2, 6, 20, 100, 500])
        sets.append(np.unique(np.array([draw.getrandbits(64) for _ in range(size)], dtype=np.uint64)))
    dense = near_dup.signatures(sets)
    for row, values in zip(dense, sets, strict=True):
        assert set(row.tolist()) <= set(values.tolist())
    alone = np.concatenate([near_dup.signatures([values]) for values in sets[:40]])
    assert (alone == dense[:40]).all()
    # Equal shares of equal bins estimate the similarity.
    a = np.unique(np.array([draw.getrandbits(64) for _ in range(400)], dtype=np.uint64))
    first, second = near_dup.signatures([a[:380], a[20:]])
    assert abs((first == second).mean() - 360 / 400) < 0.08


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (102, 102)]
    found = near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_words_hash_by_content_only():
    texts = ["Ab  cd\tab", "", " ", "cd", "é" * 30, "x" * 3000 + " ab"]
    hashes, starts, ends, first = hashed_words([t.encode() for t in texts])
    assert first.tolist() == [0, 3, 3, 3, 4, 5, 7]
    assert hashes[0] == hashes[2] == hashes[6] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 4
    assert len(sequences(hashes[:2], 5)) == 0


def test_repeated_passages_equal_brute_force(spark):
    rows = [(i, t) for i, t in dict.fromkeys(corpus.texts())]
    found = {(r.doc_id, r.spans) for r in repeats.repeated_passages(corpus.documents(spark)).collect()}
    size = repeats.PASSAGE
    assert size == 50
    places, owners = {}, defaultdict(set)
    for n, (_, t) in enumerate(rows):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        places[n] = [(m.group(), *m.span()) for m in re.finditer(r"[^\x20\x09-\x0D]+", low)]
        for at in range(len(places[n]) - size + 1):
            owners[tuple(w for w, _, _ in places[n][at : at + size])].add(n)
    expected = set()
    for n, (doc, _) in enumerate(rows):
        held = [False] * len(places[n])
        for at in range(len(held) - size + 1):
            if len(owners[tuple(w for w, _, _ in places[n][at : at + size])]) > 1:
                held[at : at + size] = [True] * size
        spans, at = [], 0
        while at < len(held):
            if held[at]:
                start = at
                while at + 1 < len(held) and held[at + 1]:
                    at += 1
                spans.append(f"{places[n][start][1]}:{places[n][at][2]}")
            at += 1
        if spans:
            expected.add((doc, ",".join(spans)))
    assert found == expected
    assert {19, 20, 21} <= {doc for doc, _ in found}


def _brute_passages(rows):
    """Word numbers of each document that lie in a window of PASSAGE words of another document."""
    size, owners = repeats.PASSAGE, defaultdict(set)
    for i, text in rows:
        w = words(text)
        for at in range(len(w) - size + 1):
            owners[tuple(w[at : at + size])].add(i)
    held = defaultdict(set)
    for i, text in rows:
        w = words(text)
        for at in range(len(w) - size + 1):
            if len(owners[tuple(w[at : at + size])]) > 1:
                held[i].update(range(at, at + size))
    return held


def test_runs_that_are_not_broadcast_give_the_same_passages(spark, monkeypatch):
    docs = corpus.documents(spark)
    held = sorted(map(str, repeats.repeated_passages(docs).collect()))
    monkeypatch.setattr(repeats, "SMALL", -1)
    assert held == sorted(map(str, repeats.repeated_passages(docs).collect()))


def test_passages_of_several_documents_are_not_joined(spark):
    """A shares 46 words with B and 46 others with C, overlapping or in a row: nothing is a passage of any two."""
    rows, size = [], repeats.PASSAGE
    for n in range(24):
        base = words(corpus.prose(200, 40_000 + n))
        step = (20, 46, 30, 4)[n % 4]
        left, right = base[60:106], base[60 + step : 106 + step]
        other = [corpus.prose(40, 50_000 + 4 * n + k) for k in range(4)]
        rows += [
            (10 * n, " ".join(base)), (10 * n + 1, f"{other[0]} {' '.join(left)} {other[1]}"),
            (10 * n + 2, f"{other[2]} {' '.join(right)} {other[3]}"),
        ]
    assert repeats.repeated_passages(corpus.documents(spark, rows)).count() == 0 == len(_brute_passages(rows))
    draw = random.Random(17)  # cuts of one long text of any length: some share a passage, some only stitched ones
    long = words(corpus.prose(900, 777))
    rows = []
    for i in range(160):
        parts = []
        for k in range(draw.randrange(1, 4)):
            at = draw.randrange(800)
            parts += [corpus.prose(draw.randrange(30), 60_000 + 5 * i + k), " ".join(long[at : at + draw.randrange(30, 90)])]
        rows.append((i, " ".join(parts)))
    held = _brute_passages(rows)
    found = {r.doc_id: r.n_repeated_words for r in repeats.repeated_passages(corpus.documents(spark, rows)).collect()}
    assert found == {i: len(places) for i, places in held.items()} and size == 50


def test_neighbours_in_order_have_the_longest_agreement():
    draw = random.Random(21)
    for _ in range(60):
        rows = sorted(
            (draw.randrange(3), [draw.randrange(2) for _ in range(draw.randrange(repeats.REACH + 1))], draw.randrange(4))
            for _ in range(draw.randrange(1, 40))
        )
        lists = pa.array([words for _, words, _ in rows], pa.list_(pa.int64()))
        key, doc = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
        best = repeats._best_agreement(key, doc, repeats._matrix(lists))
        for (k, words, d), found in zip(rows, best, strict=True):
            shared = [len(list(takewhile(lambda x: x[0] == x[1], zip(words, w, strict=False)))) for j, w, e in rows if j == k and e != d]
            assert found == max(shared, default=0)


def test_repeats_of_one_document_hide_no_other(spark):
    passage = corpus.prose(60, 700)
    many = "".join(f"{corpus.prose(20, 10_000 + i)} l{i} {passage} r{i} " for i in range(300))
    docs = corpus.documents(spark, [(1, many), (2, f"{corpus.prose(30, 701)} left {passage} right {corpus.prose(30, 702)}")])
    old = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for name, value in zip(old, ("60", "false"), strict=True):
            spark.conf.set(name, value)
        found = {r.doc_id: r for r in repeats.repeated_passages(docs).collect()}
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    expected = [f"{m.start()}:{m.end()}" for m in re.finditer(re.escape(passage), many)]
    assert found[1].spans.split(",") == expected and found[1].n_repeated_words == 300 * 60
    assert found[2].n_repeated_words == 60


def test_copies_behind_runs_of_one_word_keep_a_common_place():
    draw, size = random.Random(5), repeats.PASSAGE
    for _ in range(400):
        rest = [f"s{draw.randrange(99)}" for _ in range(draw.randrange(1, size))]
        least = size - len(rest)
        texts = [["x"] * draw.randrange(3) + ["|"] * (least + draw.choice([0, draw.randrange(60)])) + rest + [f"e{i}"] * draw.randrange(40) for i in range(2)]
        found = []
        for text in texts:
            hashes, _, _, first = hashed_words([" ".join(text).encode()])
            found.append(set(repeats.retained(hashes, first)[2].tolist()))
        assert found[0] & found[1], texts


def test_empty_tables(spark):
    docs = corpus.documents(spark, [])
    for result in (
        exact_dedup.exact_groups(docs), exact_dedup.keep_one(docs), near_dup.near_duplicates(docs), near_dup.keep_one(docs),
        repeats.repeated_passages(docs),
    ):
        assert result.count() == 0
