import math
import random
from collections import Counter

import numpy as np
import pytest

from panelwright.llm import search
from panelwright.llm.decontaminate import words
from tests.llm import corpus


def brute(rows, items, places):
    """Every document is scored for every item, by the contract's formula."""
    docs = [(doc_id, Counter(found), len(found)) for doc_id, text in rows if (found := words((text or "").encode()))]
    total, size = len(docs), sum(n for _, _, n in docs)
    frequency = Counter(term for _, counts, _ in docs for term in counts)
    weight = {term: math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) for term, df in frequency.items()}
    result = []
    for item_id, text in items:
        scored = []
        for doc_id, counts, n in docs:
            m = 100 - 25 + 25 * n * total // size
            score = sum(weight[t] * (10**9 * counts[t] // (1000 * counts[t] + 12 * m)) for t in words((text or "").encode()) if t in counts)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        scored.sort()
        result += [(item_id, rank, doc_id, -score) for rank, (score, _, _, doc_id) in enumerate(scored[:places], 1)]
    return sorted(result, key=str)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("shard_bytes, block, query_bytes", [(1 << 20, 128, 1 << 20), (3000, 2, 1 << 20), (20_000, 16, 150)])
def test_search_equals_scoring_every_document(spark, monkeypatch, shard_bytes, block, query_bytes):
    monkeypatch.setattr(search, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "QUERY_BYTES", query_bytes)
    items = corpus.BENCHMARK + [(50, "und und und end"), (51, corpus.prose(80, 77)), (51, "nowhere at all 987"), (52, "ÉÉ " + corpus.prose(3, 1))]
    docs = corpus.documents(spark).repartition(3)
    found = search.search(docs, corpus.benchmark(spark, items))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(found) == brute(corpus.texts(), items, 20)


def test_empty_tables(spark):
    assert search.search(corpus.documents(spark, []), corpus.benchmark(spark)).count() == 0
    assert search.search(corpus.documents(spark), corpus.benchmark(spark, [])).count() == 0
    assert search.search(corpus.documents(spark, [(1, None), (2, "?!")]), corpus.benchmark(spark)).count() == 0


def shard_of(texts, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    builder = search._Builder(None)
    for i, text in enumerate(texts):
        builder.add(i, text.encode())
    row = builder.row(0).to_pylist()[0]
    stats = search.Stats(len(texts), row["n_terms"])
    df = dict(zip(row["terms"], row["sizes"], strict=True))
    weights = {term: math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * n + 1))) for term, n in df.items()}
    shard = search._Shard(row, search.parts_of(row, stats), weights)
    return shard, weights


def joint_lists(shard, queries):
    made = {}
    for query in queries:
        for a, _, b, _ in query.pairs:
            if a in shard.numbers and b in shard.numbers:
                joint = search.joint_maxima(shard, shard.numbers[a], shard.numbers[b])
                if joint is not None:
                    made[a, b] = joint
    return made


def test_bounds_hold_and_pairs_tighten_them(monkeypatch):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(draw.choices(vocabulary, weights=range(1, 31), k=draw.randrange(1, 40))) for _ in range(200)]
    shard, weights = shard_of(texts, monkeypatch, 8)
    queries = search.plan([(i, " ".join(draw.choices(vocabulary, k=9)).encode()) for i in range(40)], weights)
    tighter = 0
    for query in queries:
        joint = joint_lists(shard, [query])
        steps, ahead = search.bounds(shard, joint, query)
        alone = sum(times * shard.largest[shard.numbers[t]] for a, x, b, y in query.pairs for t, times in ((a, x), (b, y)) if t is not None)
        tighter += int((ahead[0] < alone).sum())
        assert (ahead[0] <= alone).all()
        for i in range(len(steps)):  # what the pairs from i on add to any document stays below the bound of its block
            scores = np.zeros(len(texts), dtype=np.int64)
            for lists in steps[i:]:
                for docs, impacts, times in lists:
                    scores[docs] += times * impacts
            assert (scores <= ahead[i][shard.block_of]).all()
    assert tighter > 0.5 * len(queries) * shard.blocks


def test_postings_of_common_terms_are_skipped(monkeypatch):
    """Two hundred documents share common words, five have the rare ones: from the first pair on only these are read."""
    texts = ["all these words are common here"] * 200 + ["rare unusual all these words"] * 5
    shard, weights = shard_of(texts, monkeypatch, 16)
    (query,) = search.plan([(1, b"all these words are common here rare unusual")], weights)
    joint = joint_lists(shard, [query])
    assert query.pairs[0][:3:2] == ("rare", "unusual")
    full, known = search.best(shard, joint, query, 1, 5)
    touched = []
    monkeypatch.setattr(search.np, "searchsorted", lambda docs, live, f=np.searchsorted: (touched.append(len(live)), f(docs, live))[1])
    found, scores = search.best(shard, joint, query, int(known.min()), 5)
    assert found.tolist() == full.tolist() == list(range(200, 205))
    assert touched and max(touched) == 5


def test_index_of_all_terms_holds_every_document(spark):
    rows = corpus.texts()
    index = search.build_index(corpus.documents(spark).repartition(5))
    with_terms = [words((text or "").encode()) for _, text in rows]
    assert search.corpus_stats(index) == (sum(map(bool, with_terms)), sum(map(len, with_terms)))
    held = Counter()
    for row in index.collect():
        held.update(dict(zip(row.terms, row.sizes, strict=True)))
    assert held == Counter(t.decode() for found in with_terms for t in set(found))
