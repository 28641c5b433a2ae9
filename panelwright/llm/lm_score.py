"""Stupid-backoff scores of an n-gram model over the corpus itself, computed relationally.

Tokens are the bytes of the text, so the vocabulary is closed and the same for every language. Count
tables of orders 1 to 4 are aggregated over the whole corpus, partitioned by hash; each 4-gram's row
gets the counts of its shorter orders and contexts by joins. The n-grams of every document are exploded with
their number of occurrences in it, joined to the counts and summed per document.

An occurrence is held against what is left when the document's occurrences of that 4-gram are taken away: of the
orders 4 to 1, the first whose n-gram still occurs counts, `(count - own) / (context count - own)`, with a factor
of 0.4 for every order given up. A byte seen nowhere else scores 1 / (number of bytes + 1).

The corpus grows, the table of 4-grams much less; it is broadcast only if it has at most BROADCAST rows,
else the join shuffles on the n-gram, with partial sums after it.

`score_words` does the same with words and orders 1 to 3, for the order of words. There are nearly as many trigrams as words,
so what moves is kept small: the texts are stored once, dealt out in blocks of BLOCK_WORDS words, and do not move again. A block
sends its distinct sequences of one to three words once, as sorted 64-bit hashes in ranges of hashes (places), with their counts;
equal places meet, add up the counts and send them back in the same order, without the hashes. The block then
scores its documents. There the document's own occurrences are taken away from every order and context, so a sequence
that only this document repeats counts as unknown. Two sequences of n in the corpus share a hash with probability n^2 / 2^65.

Defined cases: null text is empty, has no tokens and no mean; rows that repeat are scored one by one and all
count; an empty table gives an empty result; extra columns are not read.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from panelwright.llm.pieces import stored_by_block
from panelwright.llm.words import MULTIPLIERS, encoded, hashed_words, map_rows, mixed, release, slices, struct_of
from panelwright.session import cut_lineage

ORDER = 4
WORD_ORDER = 3
BACKOFF = 0.4
BROADCAST = 1_000_000  # rows of 60 bytes
BLOCK_WORDS = 3_500_000  # words of documents that share one list of sequences, one document at least
PLACE_WORDS = 1_000_000  # words of the corpus for each range of hashes
LOW = 40  # bits of a sorted hash that are sent as they are; steps between the upper ones compress well


def _grams(text: bytes) -> np.ndarray:
    """The 4-gram that ends at each byte, as a number; the text starts after three zero bytes."""
    padded = np.frombuffer(b"\0" * (ORDER - 1) + text, dtype=np.uint8).astype(np.int64)
    size = len(text)
    return padded[:size] << 24 | padded[1 : size + 1] << 16 | padded[2 : size + 2] << 8 | padded[3:]


def _counted(batch: pa.RecordBatch):
    texts = encoded(batch["text"])
    for a, b in slices(texts):
        grams, counts = np.unique(np.concatenate([_grams(text) for text in texts[a:b]]), return_counts=True)
        yield {"gram": grams, "count": counts}


def _exploded(batch: pa.RecordBatch):
    texts, rows = encoded(batch["text"]), batch["row"]
    for at in range(0, len(texts), 128):
        part = [np.unique(_grams(text), return_counts=True) for text in texts[at : at + 128]]
        yield {"row": rows[at : at + 128], "grams": [g for g, _ in part], "own": [c.astype(np.int32) for _, c in part]}


def count_tables(texts: DataFrame) -> DataFrame:
    """A row per 4-gram of the corpus with c4..c1, its context counts x4..x2, and the corpus size x1."""
    four = cut_lineage(map_rows(texts.select("text"), _counted, "gram long, count long").groupBy("gram").agg(F.sum("count").alias("c4")))
    table, ends, context = four, F.col("gram"), F.shiftright("gram", 8)
    for order in (4, 3, 2):
        mask = (1 << 8 * order) - 1
        shorter = (1 << 8 * (order - 1)) - 1
        # Contexts of this order, and the n-grams one shorter, counted over all positions.
        of_context = four.groupBy(context.bitwiseAND(F.lit(shorter)).alias("by_context")).agg(F.sum("c4").alias(f"x{order}"))
        of_end = four.groupBy(ends.bitwiseAND(F.lit(shorter)).alias("by_end")).agg(F.sum("c4").alias(f"c{order - 1}"))
        table = table.join(of_context, context.bitwiseAND(F.lit(mask >> 8)) == F.col("by_context")).drop("by_context")
        table = table.join(of_end, ends.bitwiseAND(F.lit(shorter)) == F.col("by_end")).drop("by_end")
    total = four.agg(F.coalesce(F.sum("c4"), F.lit(0))).scalar()
    return cut_lineage(table.withColumn("x1", total))


def log_score(own: str = "own"):
    """Natural logarithm of the stupid-backoff score of one occurrence."""
    k = F.col(own)
    result = F.log(1 / (F.col("x1") + 1.0))
    for order in (1, 2, 3, 4):
        left, context = F.col(f"c{order}") - k, F.col(f"x{order}") - k
        given_up = float(np.log(BACKOFF)) * (ORDER - order)
        result = F.when(left > 0, F.log(left / context) + given_up).otherwise(result)
    return result


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_score (the sum) and mean_log_score for every row of `docs`."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    counts = count_tables(rows)
    if counts.count() <= BROADCAST:
        counts = F.broadcast(counts)
    # Rows are named by their place in the stored list of documents, so that rows that repeat stay apart.
    texts = rows.select(F.struct("doc_id", F.monotonically_increasing_id().alias("at")).alias("row"), "text")
    arrays = map_rows(texts, _exploded, "row struct<doc_id:long,at:long>, grams array<long>, own array<int>")
    exploded = arrays.select("row", F.explode(F.arrays_zip("grams", "own")).alias("g")).select("row", F.col("g.grams").alias("gram"), "g.own")
    joined = exploded.join(counts, "gram")
    sums = joined.groupBy("row").agg(F.sum("own").alias("n"), F.sum(F.col("own") * log_score()).alias("sum"))
    empty = arrays.where(F.size("grams") == 0).select("row", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("sum"))
    return sums.union(empty).select(
        "row.doc_id", F.col("n").alias("n_tokens"), F.round("sum", 3).alias("log_score"),
        F.when(F.col("n") > 0, F.round(F.col("sum") / F.col("n"), 6)).alias("mean_log_score"),
    )


def _combined(*columns: np.ndarray) -> np.ndarray:
    total = np.full(len(columns[0]), len(columns), dtype=np.uint64)
    for column, multiplier in zip(columns, MULTIPLIERS, strict=False):
        total = mixed(total + column * multiplier)
    return total


def _back(values: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """The value one place before in the same text; `start` before the first one."""
    before = np.roll(values, 1)
    before[first] = start
    return before


def _word_grams(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of words of each text, and for every word the hashes of the 3-, 2- and 1-gram that end at it; texts start after two zeros."""
    sizes, grams = [np.zeros(0, dtype=np.int64)], [[np.zeros(0, dtype=np.uint64)] for _ in range(WORD_ORDER)]
    for a, b in slices(texts):
        words, _, _, first = hashed_words(texts[a:b])
        begins = first[:-1][np.diff(first) > 0]
        one = _back(words, begins, 0)
        for known, columns in zip(grams, ((_back(one, begins, 0), one, words), (one, words), (words,)), strict=True):
            known.append(_combined(*columns))
        sizes.append(np.diff(first))
    return np.concatenate(sizes), [np.concatenate(known) for known in grams]


_START = [_combined(*[np.zeros(1, dtype=np.uint64)] * order) for order in (2, 1)]  # the contexts before a text's first word


class _Sequences:
    """The distinct sequences of a block. `keys` are their sorted hashes, `counts` their occurrences as n-grams, `more` how
    many more they have as contexts: a context is what ended one word before, so only the starts and ends of texts differ.
    With `places_too`, the place of each word's sequences in the list of their order is held instead of these three."""

    def __init__(self, texts: list[bytes], places_too: bool = False):
        self.sizes, grams = _word_grams(texts)
        ends = np.cumsum(self.sizes)[self.sizes > 0] - 1
        self.places, self.starts, keys, counts, more = [], [], [], [], []
        for i, gram in enumerate(grams):
            lasts, start = gram[ends], _START[i - 1] if i and len(ends) else gram[:0]
            found = np.unique(np.concatenate([gram, start]), return_counts=True, return_inverse=places_too)
            differ = np.zeros(len(found[0]), dtype=np.int64)
            if len(start):
                at = int(np.searchsorted(found[0], start[0]))
                found[-1][at] -= 1
                np.subtract.at(differ, np.searchsorted(found[0], lasts), 1)
                differ[at] += len(ends)
                self.starts.append(at)
            if places_too:
                self.places.append(found[1][: len(gram)].astype(np.int32))
            keys.append(found[0])
            counts.append(found[-1])
            more.append(differ)
            grams[i] = None
            del found, gram
        self.borders = np.cumsum([len(part) for part in keys])[:-1]
        self.order = np.argsort(np.concatenate(keys), kind="stable")
        if not places_too:
            self.keys, self.counts, self.more = (np.concatenate(parts)[self.order] for parts in (keys, counts, more))

    def by_order(self, values: np.ndarray) -> list[np.ndarray]:
        """Values of the sorted keys, for 3-, 2- and 1-grams apart, as `places` number them."""
        result = np.empty_like(values)
        result[self.order] = values
        return np.split(result, self.borders)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as planes of bytes, most of which are zero."""
    planes = b"".join(np.ascontiguousarray(c, dtype="<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(columns, 8, -1)
    return [part.T.copy().view("<i8").ravel() for part in planes]


_SENT = pa.schema({"block": pa.int64(), "place": pa.int32(), "low": pa.binary(), "rest": pa.binary()})
_ANSWER = pa.schema({"block": pa.int64(), "place": pa.int32(), "counts": pa.binary()})
_SUMS = pa.schema({"doc_id": pa.int64(), "n": pa.int64(), "sum": pa.float64()})


def _low(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW // 8].tobytes()


def _keys(low: bytes, steps: np.ndarray) -> np.ndarray:
    parts = np.zeros((len(steps), 8), dtype=np.uint8)
    parts[:, : LOW // 8] = np.frombuffer(low, dtype=np.uint8).reshape(len(steps), LOW // 8)
    return parts.view("<u8").ravel() | np.cumsum(steps).astype(np.uint64) << np.uint64(LOW)


def _ended(columns: dict, schema: pa.Schema) -> pa.Table:
    release()
    return pa.table(columns, schema=schema)


def _dealt(batches):
    """Documents with the number of their words and of their block."""
    from pyspark import TaskContext

    block, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sizes, blocks = [len(text.split()) for text in encoded(part["text"])], []
            for size in sizes:
                if held and held + size > BLOCK_WORDS:
                    block, held = block + 1, 0
                held += size
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(sizes, pa.int64()), *part.columns], names=["block", "n", *part.schema.names])


def _sent(places: int):
    def run(documents: pa.Table) -> pa.Table:
        own = _Sequences(encoded(documents["text"]))
        high = (own.keys >> np.uint64(LOW)).astype(np.int64)
        edges = np.searchsorted(high * places >> 64 - LOW, np.arange(places + 1))
        some = [(place, slice(a, b)) for place, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
        return _ended({
            "block": [documents["block"][0].as_py()] * len(some), "place": [place for place, _ in some], "low": [_low(own.keys[at]) for _, at in some],
            "rest": [_packed(np.diff(high[at], prepend=0), own.counts[at], own.more[at]) for _, at in some],
        }, _SENT)

    return run


def _added(sent: pa.Table) -> pa.Table:
    """The sequences of one place, of all blocks: the counts of equal ones are added up and given to each."""
    rest = [_unpacked(data.as_py(), 3) for data in sent["rest"]]
    keys = np.concatenate([_keys(low.as_py(), steps) for low, (steps, _, _) in zip(sent["low"], rest, strict=True)])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    begins, number = np.flatnonzero(new), np.cumsum(new) - 1
    totals = []
    for i in (1, 2):
        total = np.empty(len(keys), dtype=np.int64)
        total[order] = np.add.reduceat(np.concatenate([columns[i] for columns in rest])[order], begins)[number]
        totals.append(np.split(total, np.cumsum([len(columns[0]) for columns in rest])[:-1]))
    return _ended({"block": sent["block"], "place": sent["place"], "counts": [_packed(*pair) for pair in zip(*totals, strict=True)]}, _ANSWER)


def _own(owner: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How often the document of each word has the sequence in that place."""
    _, inverse, counts = np.unique(owner << 32 | places, return_inverse=True, return_counts=True)
    return counts[inverse]


def _word_scores(left: list[np.ndarray], contexts: list[np.ndarray], words: int) -> np.ndarray:
    """Natural logarithm of the stupid-backoff score against all other documents; counts of orders 3 to 1 without the document's own."""
    result = np.full(len(left[0]), np.log(1 / (words + 1.0)))
    for back in reversed(range(WORD_ORDER)):
        some = left[back] > 0
        result[some] = np.log(left[back][some] / contexts[back][some]) + np.log(BACKOFF) * back
    return result


def _scored(words: int):
    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        texts = encoded(documents["text"])
        block = _Sequences(texts, True)
        totals = [_unpacked(data.as_py(), 2) for data in answers.sort_by("place")["counts"]]
        counts, more = (np.concatenate([np.zeros(0, dtype=np.int64), *[pair[i] for pair in totals]]) for i in (0, 1))
        if len(counts) != len(block.order):
            raise ValueError(f"{len(counts)} counts for {len(block.order)} sequences")
        as_grams, as_contexts = block.by_order(counts), block.by_order(counts + more)
        del totals, counts, more
        sums, first = np.zeros(len(texts)), np.concatenate(([0], np.cumsum(block.sizes)))
        for a, b in slices(texts):
            some, sizes = slice(first[a], first[b]), block.sizes[a:b]
            owner = np.repeat(np.arange(b - a), sizes)
            grams = [places[some].astype(np.int64) for places in block.places]
            begins = (first[a:b] - first[a])[sizes > 0]
            if not len(begins):
                continue
            contexts = [_back(places, begins, start) for places, start in zip(grams[1:], block.starts, strict=True)]
            left = [known[places] - _own(owner, places) for known, places in zip(as_grams, grams, strict=True)]
            over = [known[places] - _own(owner, places) for known, places in zip(as_contexts[1:], contexts, strict=True)]
            over.append(words - sizes[owner])
            sums[a:b] = np.bincount(owner, weights=_word_scores(left, over, words), minlength=b - a)
        return _ended({"doc_id": documents["doc_id"], "n": block.sizes, "sum": sums}, _SUMS)

    return run


def score_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens (words), log_score (the sum) and mean_log_score for every row of `docs`."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    dealt = stored_by_block(rows.mapInArrow(_dealt, struct_of("block long, n long, doc_id long, text string")), "zstd")
    words = dealt.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    places = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words // PLACE_WORDS))
    sent = dealt.where("n > 0").groupBy("block").applyInArrow(_sent(places), from_arrow_schema(_SENT))
    answers = sent.groupBy("place").applyInArrow(_added, from_arrow_schema(_ANSWER))
    sums = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(words), from_arrow_schema(_SUMS))
    return sums.select(
        "doc_id", F.col("n").alias("n_tokens"), F.round("sum", 3).alias("log_score"),
        F.when(F.col("n") > 0, F.round(F.col("sum") / F.col("n"), 6)).alias("mean_log_score"),
    )
