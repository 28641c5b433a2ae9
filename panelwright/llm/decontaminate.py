"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. Patterns are the
windows of ten consecutive words of every benchmark item, or the whole item if it has fewer. Patterns of
one length form a matcher. A block is a pair of neighbouring words; a shift table says how far the search
may jump from a block that does not end a pattern, a block that may end one selects the few patterns with
that suffix, and a direct comparison confirms the occurrence. Occurrences may overlap.

The benchmark is read in blocks of windows of bounded size, each broadcast on its own, and every block
is held against all documents; so its size is not limited, and no document moves.

Defined cases: null text has no words; items without words have no window; items with a null item_id
still mark words but are not counted; items and windows that repeat count once; extra columns are not read.
"""

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.words import encoded, map_rows, releasing
from panelwright.session import cut_lineage

WINDOW = 10
BLOCK_BYTES = 8 << 20  # text of benchmark items that is broadcast at a time
PART = 256  # documents that are Python objects at a time

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Matcher:
    """Wu-Manber tables for patterns of one length in words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[int]]):
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.far = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.suffixes = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, self.length + 1):
                block = pattern[end - self.block : end]
                jump = self.length - end
                if self.shift.get(block, self.far) > jump:
                    self.shift[block] = jump
            self.suffixes[pattern[self.length - self.block :]].append((pattern, items))

    def occurrences(self, text: list[bytes]):
        """Start of each occurrence and the items that have it."""
        block, far, shift = self.block, self.far, self.shift.get
        end, count = self.length, len(text)
        while end <= count:
            tail = (text[end - 2], text[end - 1]) if block == 2 else (text[end - 1],)
            jump = shift(tail, far)
            if jump:
                end += jump
                continue
            start = end - self.length
            window = tuple(text[start:end])
            for pattern, items in self.suffixes[tail]:
                if pattern == window:
                    yield start, items
            end += 1


def matchers(items: list[tuple[int | None, bytes]]) -> list[Matcher]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        item = words(text)
        length = min(WINDOW, len(item))
        for start in range(len(item) - length + 1 if item else 0):
            found = by_length[length][tuple(item[start : start + length])]
            if item_id is not None:
                found.add(item_id)
    return [Matcher(patterns) for patterns in by_length.values()]


def _blocks(benchmark: DataFrame):
    """Items of the benchmark, BLOCK_BYTES of text at a time. The driver holds one block."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))).toLocalIterator():
        held.append((row[0], row[1].encode()))
        size += len(held[-1][1])
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scan(block):
    """A function over batches that adds the block's hits to those of earlier blocks."""

    def run(batch: pa.RecordBatch):
        tables = _compiled(block)
        starts_before, ends_before, items_before = (batch[c].to_pylist() for c in ("starts", "ends", "items"))
        counts, starts, ends, items = [], [], [], []
        for i, text in enumerate(encoded(batch["text"])):
            document = words(text)
            found, hits = set(items_before[i]), [*zip(starts_before[i], ends_before[i], strict=True)]
            for matcher in tables:
                for start, ids in matcher.occurrences(document):
                    found |= ids
                    hits.append((start, start + matcher.length))
            merged = _union(hits)
            counts.append(len(document))
            starts.append([a for a, _ in merged])
            ends.append([b for _, b in merged])
            items.append(sorted(found, key=str))
        yield {"doc_id": batch["doc_id"], "text": batch["text"], "n_words": counts, "starts": starts, "ends": ends, "items": items}

    return run


_kept: dict = {}


def _compiled(block):
    """The matchers of a broadcast block, built once in a Python worker."""
    items = block.value
    if _kept.get("items") is not items:
        _kept.update(items=items, tables=matchers(items))
    return _kept["tables"]


def _union(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(hits):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def contaminated_words(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, text, n_words, the hit ranges of words (starts, ends) and the items."""
    spark: SparkSession = docs.sparkSession
    empty = F.array().cast("array<long>")
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.lit(0).cast("long").alias("n_words"),
        empty.alias("starts"), empty.alias("ends"), empty.alias("items"),
    )
    schema = "doc_id long, text string, n_words long, starts array<long>, ends array<long>, items array<long>"
    first = True
    for block in _blocks(benchmark):
        if not first:
            rows = cut_lineage(rows)  # one block's tables in a task at a time
        rows, first = map_rows(rows, _scan(spark.sparkContext.broadcast(block)), schema), False
    return map_rows(rows, _scan(spark.sparkContext.broadcast([])), schema) if first else rows


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contaminated_words(docs, benchmark).select("doc_id", "n_words", "starts", "ends", "items")
    total = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x)
    hit = total("ends") - total("starts")
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` whose text has no occurrence; all its columns. No row moves."""
    spark: SparkSession = docs.sparkSession
    for block in _blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            for batch in batches:
                tables = _compiled(held)
                for at in range(0, batch.num_rows, PART):
                    part = batch.slice(at, PART)
                    texts = map(words, encoded(part["text"]))
                    free = [not any(True for matcher in tables for _ in matcher.occurrences(text)) for text in texts]
                    yield part.filter(pa.array(free, pa.bool_()))

        docs = docs.mapInArrow(releasing(run), docs.schema)
    return docs
