"""Ranked lexical search by MaxScore with bounds for pairs of terms.

The index holds shards of documents. A shard has its documents' ids and lengths, the postings of its terms,
and for pairs of terms an intersection list: per run of BLOCK documents the largest joint impact of a document
that holds both. Impacts are the integer weights of the contract: weight of the term times a saturated
frequency.

A query's terms are taken in pairs, the rarest first. A pair adds at most its joint maximum or what one of its
terms adds alone, which is less than both maxima together wherever the two peak in different documents or never
meet. Summed from the end, these bounds say per block what the pairs not yet read can still add. Once that
is below the score of the last place, no unseen document of the block can enter, the postings that remain are
only looked up for documents already seen, and those fall out as soon as their bound falls behind.
Nothing is cut off by a number: the result is that of scoring every document.

The last place's score is first taken from the shards of a sixteenth of the hash space; the other shards start from
there. Queries are held against all shards in blocks of QUERY_BYTES of text, each broadcast on its own.
Shards are rows that never move; only their best documents per query do, limited per task before the shuffle.

Defined cases: null text has no terms; documents without terms are not counted and never found; every row of
the queries is ranked by itself, even if its id repeats or is null; terms of a query that repeat count as often; rows
that repeat a doc_id are documents of their own; of equal scores a null doc_id comes last; empty tables give
empty results; extra columns are not read.
"""

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.decontaminate import words as terms
from panelwright.llm.words import struct_of
from panelwright.session import cut_lineage

PLACES = 20
SHARD_BYTES = 8 << 20  # text of a shard, one document at least
BLOCK = 128  # documents that share a bound
QUERY_BYTES = 1 << 20  # text of queries held against all shards at a time
FIRST_SHARE = 16  # one in so many shards is searched first

_SHARD = pa.schema([
    ("shard", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()),
    ("terms", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("docs", pa.binary()), ("tfs", pa.binary()),
])
SHARD = (
    "shard long, n_terms long, ids array<long>, lengths binary, terms array<string>, sizes array<int>, docs binary, tfs binary"
)
_PAIRED = pa.schema([
    ("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())),
    ("docs", pa.binary()), ("parts", pa.binary()), ("pairs", pa.binary()), ("joint", pa.binary()),
])
PAIRED = (
    "shard long, ids array<long>, terms array<string>, sizes array<int>, docs binary, parts binary, pairs binary, joint binary"
)
_FOUND = pa.schema([("query", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
FOUND = "query int, item_id long, doc_id long, score long"


class Stats(NamedTuple):
    """Documents with terms, and all their terms."""

    documents: int
    terms: int


class Query(NamedTuple):
    """A query's distinct terms, rarest first, with how often each occurs in it, two by two: term or None."""

    number: int
    item_id: int | None
    pairs: list[tuple[str, int, str | None, int]]


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        number = self[term] = len(self)
        return number


class _Builder:
    """Postings of one shard."""

    def __init__(self, vocabulary: dict[bytes, int] | None):
        self.closed = vocabulary is not None
        self.numbers = vocabulary if self.closed else _Numbers()
        self.ids: list = []
        self.lengths: list[int] = []
        self.keys: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, text: bytes) -> None:
        found = terms(text)
        self.size += len(text)
        if not found:
            return
        if self.closed:
            get = self.numbers.get
            codes = np.fromiter((get(term, -1) for term in found), dtype=np.int64, count=len(found))
            codes = codes[codes >= 0]
        else:
            codes = np.fromiter(map(self.numbers.__getitem__, found), dtype=np.int64, count=len(found))
        self.keys.append(codes << 32 | len(self.ids))
        self.ids.append(doc_id)
        self.lengths.append(len(found))

    def row(self, shard: int) -> pa.RecordBatch:
        keys, tfs = np.unique(np.concatenate(self.keys), return_counts=True)
        codes, sizes = np.unique(keys >> 32, return_counts=True)
        names = list(self.numbers)
        columns = [
            [shard], [sum(self.lengths)], [self.ids], [np.array(self.lengths, dtype="<i8").tobytes()], [[names[code].decode() for code in codes.tolist()]],
            [sizes.astype(np.int32)], [(keys & 0xFFFFFFFF).astype("<i4").tobytes()], [tfs.astype("<i8").tobytes()],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SHARD, strict=True)], schema=_SHARD)


def build_index(docs: DataFrame, vocabulary: Iterable[str] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Shards of all documents as a stored table. A `vocabulary` (bounded: it is broadcast) restricts the postings,
    not the documents, their lengths or their frequencies."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    known = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast({term.encode(): i for i, term in enumerate(vocabulary)})

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        builder = _Builder(known and known.value)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                raw = text.as_buffer().to_pybytes()
                if builder.ids and builder.size + len(raw) > SHARD_BYTES:
                    yield builder.row(shard)
                    shard, builder = shard + 1, _Builder(known and known.value)
                builder.add(doc_id.as_py(), raw)
        if builder.ids:
            yield builder.row(shard)

    return cut_lineage(rows.mapInArrow(run, struct_of(SHARD)))


def corpus_stats(index: DataFrame) -> Stats:
    row = index.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    return Stats(row[0], row[1])


def term_weights(index: DataFrame, wanted: Iterable[str], stats: Stats) -> dict[str, int]:
    """Weight of each wanted term (a bounded set) that the index holds."""
    spark = index.sparkSession
    frequencies = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.sizes").alias("df"))
    chosen = F.broadcast(spark.createDataFrame([(term,) for term in wanted], "wanted string"))
    weight = F.floor(1000 * F.log((2.0 * stats.documents + 2) / (2 * F.col("df") + 1)))
    rows = frequencies.join(chosen, F.col("term") == F.col("wanted")).select("term", weight.cast("long").alias("weight"))
    return {row.term: row.weight for row in rows.toLocalIterator()}


def plan(items: list[tuple[int | None, bytes]], weights: dict[str, int]) -> list[Query]:
    queries = []
    for number, (item_id, text) in enumerate(items):
        counts = Counter(term.decode() for term in terms(text))
        order = sorted((t for t in counts if weights.get(t, 0) > 0), key=lambda t: (-weights[t], t))
        halves = [(t, counts[t]) for t in order] + [(None, 0)] * (len(order) % 2)
        queries.append(Query(number, item_id, [(*a, *b) for a, b in zip(halves[::2], halves[1::2], strict=True)]))
    return queries


class _Shard:
    """A shard's row with impacts: weight times part, per posting."""

    def __init__(self, row: dict, parts: np.ndarray, weights: dict[str, int]):
        self.ids = row["ids"]
        self.docs = np.frombuffer(row["docs"], dtype="<i4")
        sizes = np.array(row["sizes"], dtype=np.int64)
        self.starts = np.concatenate(([0], sizes.cumsum()))
        self.numbers = {term: i for i, term in enumerate(row["terms"])}
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.impacts = parts.astype(np.int64) * np.array([weights.get(term, 0) for term in row["terms"]], dtype=np.int64)[owner]
        self.blocks = -(-len(self.ids) // BLOCK)
        self.block_of = np.arange(len(self.ids)) // BLOCK
        # The largest impact of each term in each block; the postings of a term are in order of documents.
        self.largest = np.zeros((len(sizes), self.blocks), dtype=np.int64)
        if len(owner):
            cell = owner * self.blocks + self.docs // BLOCK
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            self.largest.ravel()[cell[first]] = np.maximum.reduceat(self.impacts, first)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[term], self.starts[term + 1]
        return self.docs[a:b], self.impacts[a:b]


def joint_maxima(shard: _Shard, left: int, right: int) -> np.ndarray | None:
    """Per block the largest joint impact of a document that holds both terms, 0 where none does; None if nowhere."""
    docs, places, others = np.intersect1d(*(shard.postings(t)[0] for t in (left, right)), assume_unique=True, return_indices=True)
    if not len(docs):
        return None
    joint = shard.postings(left)[1][places] + shard.postings(right)[1][others]
    blocks = docs // BLOCK
    first = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
    result = np.zeros(shard.blocks, dtype=np.int64)
    result[blocks[first]] = np.maximum.reduceat(joint, first)
    return result


def parts_of(row: dict, stats: Stats) -> np.ndarray:
    """The saturated frequency of each posting: (1000000000 * tf) div (1000 * tf + 12 * m)."""
    lengths = np.frombuffer(row["lengths"], dtype="<i8")
    m = 100 - 25 + (25 * lengths * stats.documents) // stats.terms
    tfs = np.frombuffer(row["tfs"], dtype="<i8")
    return (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[np.frombuffer(row["docs"], dtype="<i4")])


def with_pairs(index: DataFrame, stats: Stats, weights: dict[str, int], pairs: list[tuple[str, str]]) -> DataFrame:
    """Shards with impacts and the intersection lists of `pairs` (a bounded set), as a stored table."""
    held = index.sparkSession.sparkContext.broadcast((stats, weights, pairs))

    def run(batches):
        stats, weights, pairs = held.value
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                parts = parts_of(row, stats)
                shard, numbers, lists = _Shard(row, parts, weights), [], []
                for number, (a, b) in enumerate(pairs):
                    left, right = shard.numbers.get(a), shard.numbers.get(b)
                    if left is not None and right is not None:
                        joint = joint_maxima(shard, left, right)
                        if joint is not None:
                            numbers.append(number)
                            lists.append(joint)
                columns = {
                    **{name: [row[name]] for name in ("shard", "ids", "terms", "sizes", "docs")}, "parts": [parts.astype("<i4").tobytes()],
                    "pairs": [np.array(numbers, dtype="<i4").tobytes()], "joint": [b"".join(joint.astype("<i8").tobytes() for joint in lists)],
                }
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _PAIRED], schema=_PAIRED)

    return cut_lineage(index.mapInArrow(run, struct_of(PAIRED)))


def bounds(shard: _Shard, joint: dict[tuple[str, str], np.ndarray], query: Query) -> tuple[list, np.ndarray]:
    """The query's postings in this shard, pair by pair, and per pair and block what it and all later ones can add."""
    steps, most = [], []
    for a, times_a, b, times_b in query.pairs:
        lists, alone = [], []
        for term, times in ((a, times_a), (b, times_b)):
            number = shard.numbers.get(term)
            if number is not None:
                lists.append((*shard.postings(number), times))
                alone.append(times * shard.largest[number])
        if not lists:
            continue
        limit = np.maximum.reduce(alone)
        if (both := joint.get((a, b))) is not None:
            fewer = min(times_a, times_b)
            rest = alone[0] // times_a * (times_a - fewer) + alone[1] // times_b * (times_b - fewer)
            limit = np.maximum(limit, np.where(both > 0, fewer * both + rest, 0))
        steps.append(lists)
        most.append(limit)
    ahead = np.zeros((len(steps) + 1, shard.blocks), dtype=np.int64)
    for i in range(len(steps) - 1, -1, -1):
        ahead[i] = ahead[i + 1] + most[i]
    return steps, ahead


def best(shard: _Shard, joint: dict, query: Query, least: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the shard that may be among the query's best, with their scores; `least` is a score that
    the last place has at least."""
    steps, ahead = bounds(shard, joint, query)
    scores, least = np.zeros(len(shard.ids), dtype=np.int64), max(least, 1)
    live = None
    for i, lists in enumerate(steps):
        if live is None and (ahead[i] < least).all():
            live = np.flatnonzero(scores + ahead[i][shard.block_of] >= least)
        if live is None:
            for docs, impacts, times in lists:
                scores[docs] += times * impacts
            if i % 4 == 3 and len(scores) >= places:
                least = max(least, int(np.partition(scores, -places)[-places]))
            continue
        for docs, impacts, times in lists:
            at = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
            hit = docs[at] == live
            scores[live[hit]] += times * impacts[at[hit]]
        live = live[scores[live] + ahead[i + 1][shard.block_of[live]] >= least]
        if not len(live):
            return live, live
    found = np.flatnonzero(scores >= least) if live is None else live
    if len(found) > places:  # all that reach the last place stay, so that equal ones are settled by doc_id
        found = found[scores[found] >= np.partition(scores[found], -places)[-places]]
    return found, scores[found]


def _searched(index: DataFrame, queries: list[Query], weights: dict[str, int], pairs: list[tuple[str, str]], least: dict[int, int], places: int):
    """(query, item_id, doc_id, score) of the documents of each shard that may be among the best."""
    held = index.sparkSession.sparkContext.broadcast((queries, weights, pairs, least))

    def run(batches):
        queries, weights, pairs, least = held.value
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                shard = _Shard(row, np.frombuffer(row["parts"], dtype="<i4"), weights)
                lists = np.frombuffer(row["joint"], dtype="<i8").reshape(-1, shard.blocks)
                joint = {pairs[n]: values for n, values in zip(np.frombuffer(row["pairs"], dtype="<i4").tolist(), lists, strict=True)}
                for query in queries:
                    docs, scores = best(shard, joint, query, least.get(query.number, 1), places)
                    if len(docs):
                        ids = [shard.ids[doc] for doc in docs.tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([query.number] * len(ids), pa.int32()), pa.array([query.item_id] * len(ids), pa.int64()),
                             pa.array(ids, pa.int64()), pa.array(scores)], schema=_FOUND,
                        )

    return index.mapInArrow(run, struct_of(FOUND))


def _query_blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[int | None, bytes]]]:
    held, size = [], 0
    for row in items.select(F.col(id_column).cast("long"), F.coalesce(F.col(text_column), F.lit(""))).toLocalIterator():
        held.append((row[0], row[1].encode()))
        size += len(held[-1][1])
        if size >= QUERY_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def search_index(index: DataFrame, items: list[tuple[int | None, bytes]], stats: Stats, places: int = PLACES) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents of one block of queries."""
    wanted = sorted({term.decode() for _, text in items for term in terms(text)})
    weights = term_weights(index, wanted, stats)
    queries = plan(items, weights)
    pairs = sorted({(a, b) for query in queries for a, _, b, _ in query.pairs if b is not None})
    paired = with_pairs(index, stats, weights, pairs)
    first = F.pmod(F.xxhash64("shard"), F.lit(FIRST_SHARE)) == 0
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    sample = cut_lineage(_searched(paired.where(first), queries, weights, pairs, {}, places).withColumn("rank", rank).where(F.col("rank") <= places))
    least = {row.query: row.score for row in sample.where(F.col("rank") == places).select("query", "score").toLocalIterator()}
    rest = _searched(paired.where(~first), queries, weights, pairs, least, places)
    ranked = sample.drop("rank").union(rest).withColumn("rank", rank).where(F.col("rank") <= places)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, places: int = PLACES, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id and score of the `places` best documents for every row of `items`."""
    blocks = _query_blocks(items, item_column, "text")
    block, another = next(blocks, []), next(blocks, None)
    # A single block's terms are all that the index needs; several blocks share an index of all terms.
    vocabulary = sorted({term.decode() for _, text in block for term in terms(text)}) if another is None else None
    index = build_index(docs, vocabulary, id_column, text_column)
    stats = corpus_stats(index)
    result = None
    while block is not None:
        found = search_index(index, block, stats, places)
        result = found if result is None else result.union(found)
        block, another = another, next(blocks, None) if another is not None else None
    return result
