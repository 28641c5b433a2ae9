"""Passages that repeat across documents, by a sparse suffix array.

Words are lower-cased (A-Z) and split at ASCII white space. A suffix is retained where its first words
are the smallest of WINDOW neighbouring positions (a minimiser), so copies of a passage retain the same
places. The retained suffixes of all documents are sorted by their first PREFIX words (as a hash), and
neighbours are compared: suffixes equal in these words in different documents match. Matches of a document that overlap
form a run. The places at both ends of every run are sorted again by the words to the left or right of them, and the
longest agreement with a neighbour extends the run.

Any passage of at least PASSAGE = PREFIX + WINDOW - 1 words that two documents share holds a retained suffix whose
PREFIX words lie inside it, so an extended run holds it whole and none is missed. But a run may join matches with several
documents, none of which has PASSAGE of its words. Matches next to each other form a chain if the same documents have
both, at the same distance (told by sums of hashes over the documents of a key, two moduli of 31 bits). A run made of
chains of PASSAGE words is sound, and so is what extends it. For all other runs the windows of PASSAGE words around their
matches are sorted and compared like the suffixes, and those that another document has are reported: a word is
reported exactly if it lies in such a window.

Sorting is by range with the document as last key, so the copies of one passage spread over many tasks; a
partition knows its own rows, and what the rows at its borders miss is settled on a table with a few rows
per partition.

Defined cases: null text is empty; documents under PASSAGE words have no run; rows that repeat both
doc_id and text are one document; rows that share a doc_id with another text are two; extra columns are
not read. Only documents with a run are returned.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.words import MULTIPLIERS, encoded, hashed_words, map_rows, mixed, sequences, slices
from panelwright.session import cut_lineage

GRAM, WINDOW, PREFIX = 7, 16, 35  # words; PREFIX is a multiple of GRAM, WINDOW a power of two
PASSAGE = PREFIX + WINDOW - 1
REACH = WINDOW - 1
PRIMES = (2**31 - 1, 2**31 - 19)
SMALL = 2_000_000  # places, of at most 16 bytes each, that may be broadcast


def retained(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place (word) within it and prefix hash of the retained suffixes of some texts."""
    grams = sequences(hashes, GRAM)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    value, place, width = grams, np.arange(len(grams)), 1
    while width < WINDOW:
        later = value[width:] <= value[:-width]
        place = np.where(later, place[width:], place[:-width])
        value = np.where(later, value[width:], value[:-width])
        width *= 2
    starts = np.arange(len(place))
    place = place[owner[starts] == owner[np.minimum(starts + WINDOW + GRAM - 2, len(owner) - 1)]]
    place = np.unique(place)
    # In a run of equal grams (one word again and again) every place is smallest: those near its ends stay. Between them
    # each WINDOW-th from the end does, smallest or not, so that copies with another start of the run keep the same ones.
    breaks = np.ones(len(grams), dtype=bool)
    breaks[1:] = (grams[1:] != grams[:-1]) | (owner[1 : len(grams)] != owner[: len(grams) - 1])
    start = np.flatnonzero(breaks)
    lengths = np.diff(np.append(start, len(grams)))
    since = np.arange(len(grams)) - np.repeat(start, lengths)
    until = np.repeat(lengths, lengths) - since
    place = place[(since[place] < WINDOW) | (until[place] <= WINDOW)]
    place = np.union1d(place, np.flatnonzero(until % WINDOW == 0))
    place = place[place + PREFIX <= first[owner[place] + 1]]
    key = np.full(len(place), PREFIX, dtype=np.uint64)
    for i in range(PREFIX // GRAM):
        key = key + grams[place + i * GRAM] * MULTIPLIERS[i]
    return owner[place], place - first[owner[place]], mixed(key)


def _suffixes(batch: pa.RecordBatch):
    texts, docs = encoded(batch["text"]), batch["doc"].to_numpy()
    for a, b in slices(texts):
        hashes, _, _, first = hashed_words(texts[a:b])
        if len(hashes) >= PASSAGE:
            owner, place, key = retained(hashes, first)
            yield {"key": key.view(np.int64), "doc": docs[a:b][owner], "place": place.astype(np.int32)}


def _matches(batches):
    """Rows of one sorted partition that match a neighbour (state 1); rows of its first and last suffix that have no other
    document here (state 0); and for those two suffixes whom they occur in (state 2)."""
    tables = [pa.Table.from_batches([batch]) for batch in batches if batch.num_rows]
    if not tables:
        return
    table = pa.concat_tables(tables).combine_chunks()
    key, doc = table["key"].to_numpy(), table["doc"].to_numpy()
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    low, high = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    state = np.where((low != high)[group], 1, np.where((group == 0) | (group == len(start) - 1), 0, -1)).astype(np.int32)
    edge = np.unique([0, len(start) - 1])
    seen = pa.table({
        "key": np.repeat(key[start[edge]], 2), "doc": np.stack([low[edge], high[edge]], axis=1).ravel(),
        "place": np.zeros(2 * len(edge), dtype=np.int32), "state": np.full(2 * len(edge), 2, dtype=np.int32),
    })
    yield from table.append_column("state", pa.array(state)).filter(pa.array(state >= 0)).to_batches(10_000)
    yield from seen.to_batches()


def matching_suffixes(suffixes: DataFrame) -> DataFrame:
    """Rows (key, doc, place) whose key another doc has as well."""
    order = ["key", "doc", "place"]
    found = cut_lineage(
        suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_matches, "key long, doc long, place int, state int")
    )
    across = found.where("state = 2").groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("key")
    open_rows = found.where("state = 0").join(F.broadcast(across), "key")  # both hold a few rows per partition
    return found.where("state = 1").select(*order).union(open_rows.select(*order))


def _lists(values: np.ndarray, keep: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists of their kept cells, which come first."""
    offsets = np.concatenate(([0], np.cumsum(keep.sum(axis=1))))
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(values[keep]))


def _surroundings(batch: pa.RecordBatch):
    """For each asked place: word hashes before it and after its PREFIX words, nearest first."""
    texts, docs = encoded(batch["text"]), batch["doc"].to_numpy()
    asked, ends_of = batch["places"].flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(batch["places"]).to_numpy())
    steps = np.arange(REACH + 1)
    for a, b in slices(texts):
        hashes, _, _, first = hashed_words(texts[a:b])
        words = hashes.view(np.int64)
        from_row, to_row = (ends_of[a - 1] if a else 0), ends_of[b - 1]
        counts = np.diff(np.concatenate(([from_row], ends_of[a:b])))
        owner, place = np.repeat(np.arange(b - a), counts), asked[from_row:to_row]
        for at in range(0, len(place), 20_000):
            own, here = owner[at : at + 20_000], place[at : at + 20_000]
            low, high = first[own][:, None], first[own + 1][:, None]
            left = (first[own] + here)[:, None] - steps  # the place itself, then the words before it
            right = (first[own] + here + PREFIX - 1)[:, None] + steps  # its last word, then the words after it
            in_left, in_right = left >= low, right < high
            left, right = np.maximum(left, 0), np.minimum(right, len(words) - 1)
            yield {
                "doc": docs[a:b][own], "place": here,
                "before": _lists(words[left[:, 1:]], in_left[:, 1:]), "after": _lists(words[right[:, 1:]], in_right[:, 1:]),
            }


def _runs(batch: pa.RecordBatch, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word and number of words of the runs of texts a to b."""
    counts = pa.compute.list_value_length(batch["runs"]).to_numpy()
    ends_of = np.concatenate(([0], np.cumsum(counts)))
    flat = batch["runs"].flatten()
    start, words = (flat.field(i).to_numpy()[ends_of[a] : ends_of[b]] for i in (0, 1))
    return np.repeat(np.arange(b - a), counts[a:b]), start, words


def _passages(batch: pa.RecordBatch):
    """Every window of PASSAGE words inside the ranges (of words, which may reach beyond the text) of a document."""
    texts, docs = encoded(batch["text"]), batch["doc"].to_numpy()
    for a, b in slices(texts):
        hashes, _, _, first = hashed_words(texts[a:b])
        owner, start, words = _runs(batch, a, b)
        if len(owner):
            stop = np.minimum(start + words, (first[1:] - first[:-1])[owner])
            start = np.maximum(start, 0)
            count = np.maximum(stop - start - PASSAGE + 1, 0)
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            owner, place = np.repeat(owner, count), np.repeat(start, count) + within
            key = sequences(hashes, PASSAGE)[first[owner] + place]
            yield {"key": key.view(np.int64), "doc": docs[a:b][owner], "place": place.astype(np.int32)}


def _spans(batch: pa.RecordBatch):
    """The runs of each document in code points."""
    texts = encoded(batch["text"])
    for a, b in slices(texts):
        _, starts, ends, first = hashed_words(texts[a:b])
        joined = np.frombuffer(b"\n".join(texts[a:b]) + b"\n", dtype=np.uint8)
        points = np.concatenate(([0], np.cumsum((joined & 0xC0) != 0x80)))  # code points before each byte
        begin = points[np.cumsum([0] + [len(text) + 1 for text in texts[a:b]])]
        owner, start, words = _runs(batch, a, b)
        left = points[starts[first[owner] + start]] - begin[owner]
        right = points[ends[first[owner] + start + words - 1]] - begin[owner]
        spans = [[] for _ in range(b - a)]
        for i, x, y in zip(owner.tolist(), left.tolist(), right.tolist(), strict=True):
            spans[i].append(f"{x}:{y}")
        total = np.bincount(owner, weights=words, minlength=b - a).astype(np.int64)
        yield {
            "doc_id": batch["doc_id"][a : b], "n_passages": [len(s) for s in spans],
            "n_repeated_words": total, "spans": [",".join(s) for s in spans],
        }


def _agreement(side: str):
    """Compares neighbours of one partition sorted by (key, words of `side`): the words in which a row agrees with a neighbour
    of another document. Rows of the first document at a border may have such a neighbour behind it; `top` and `bottom` tell
    what they share with the border row, which leaves as an edge with the nearest row of another document and its key."""

    def run(batches):
        tables = [pa.Table.from_batches([batch]) for batch in batches if batch.num_rows]
        if not tables:
            return
        table = pa.concat_tables(tables).combine_chunks()
        key, doc, place = (table[name].to_numpy() for name in ("key", "doc", "place"))
        words = _matrix(table[side].combine_chunks())
        best, shared = _best_agreement(key, doc, words), _shared(key, words)
        size, number = len(key), TaskContext.get().partitionId()
        top, below = _border(key, doc, shared)
        bottom, above = _border(key[::-1], doc[::-1], shared[::-1])
        edge = np.unique(np.concatenate(([0, size - 1], below, size - 1 - above)))
        out = {
            "key": np.append(key, key[edge]), "doc": np.append(doc, doc[edge]), "place": np.append(place, place[edge]),
            "agree": np.append(best, 0 * edge), "part": np.full(size + len(edge), number), "edge": np.append(np.full(size, -1), edge),
            "top": np.append(top, np.where(edge == 0, 0, -1)), "bottom": np.append(bottom[::-1], np.where(edge == size - 1, 0, -1)),
            "words": pa.array([None] * size + table[side].take(edge).to_pylist(), pa.list_(pa.int64())),
        }
        kinds = {"key": pa.int64(), "doc": pa.int64(), "words": pa.list_(pa.int64())}
        columns = {n: c if isinstance(c, pa.Array) else pa.array(c, kinds.get(n, pa.int32())) for n, c in out.items()}
        yield from pa.table(columns).to_batches(10_000)

    return run


def _border(key: np.ndarray, doc: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the first rows of a partition that have one key and document the words they share with the first row, -1 for others;
    and the next row, if it has the same key."""
    other = np.flatnonzero((key != key[0]) | (doc != doc[0]))
    size = int(other[0]) if len(other) else len(key)
    common = np.full(len(key), -1, dtype=np.int64)
    common[:size] = np.minimum.accumulate(np.concatenate(([REACH], shared[: size - 1])))
    return common, np.array([size] if size < len(key) and key[size] == key[0] else [], dtype=np.int64)


def _across(batches):
    """The agreement of all partitions' edges, in order, with the nearest edge of another document."""
    tables = [pa.Table.from_batches([batch]) for batch in batches if batch.num_rows]
    if tables:
        table = pa.concat_tables(tables).combine_chunks()
        key, doc = table["key"].to_numpy(), table["doc"].to_numpy()
        best = _best_agreement(key, doc, _matrix(table["words"].combine_chunks()))
        for batch in table.select(["part", "top", "bottom"]).append_column("beyond", pa.array(best, pa.int32())).to_batches(10_000):
            yield batch


def _matrix(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of a matrix of REACH columns, and their lengths."""
    lengths = np.diff(lists.offsets.to_numpy())
    values = np.zeros((len(lists), REACH), dtype=np.int64)
    values[np.arange(REACH) < lengths[:, None]] = lists.flatten().to_numpy()
    return values, lengths


def _shared(key: np.ndarray, words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The leading words each row shares with the next one, -1 where that has another key."""
    values, lengths = words
    shared = (np.cumprod(values[1:] == values[:-1], axis=1)).sum(axis=1)
    return np.where(key[1:] == key[:-1], np.minimum(shared, np.minimum(lengths[1:], lengths[:-1])), -1)


def _best_agreement(key: np.ndarray, doc: np.ndarray, words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each row of a sorted partition the leading words it shares with a row of its key in another document: the
    nearest such row above or below, since rows between two others share at least as much with either."""
    shared = _shared(key, words)
    best = np.zeros(len(key), dtype=np.int64)
    for backwards in (False, True):
        step, other = (shared[::-1], doc[::-1]) if backwards else (shared, doc)
        common = np.full(len(key), -1, dtype=np.int64)
        common[1:] = step
        same = np.zeros(len(key), dtype=bool)
        same[1:] = (other[1:] == other[:-1]) & (step >= 0)
        for i in np.flatnonzero(same):  # within a document's block: what its predecessor shares, or less
            common[i] = min(common[i], common[i - 1])
        best = np.maximum(best, common[::-1] if backwards else common)
    return best


def _extension(around: DataFrame, side: str) -> DataFrame:
    """(doc, place, agree) with the words that agree with the best neighbour on one side."""
    order = ["key", side, "doc", "place"]
    compared = cut_lineage(
        around.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_agreement(side), "key long, doc long, place int, agree int, part int, edge int, top int, bottom int, words array<long>")
    )
    # Between partitions: at most four rows of each, in order.
    edges = compared.where("edge >= 0").select("part", "edge", "key", "doc", "top", "bottom", "words")
    settled = cut_lineage(
        edges.repartition(1).sortWithinPartitions("part", "edge").mapInArrow(_across, "part int, top int, bottom int, beyond int")
    )
    rows = compared.where("edge < 0")
    for name in ("top", "bottom"):
        there = settled.where(f"{name} = 0").select("part", F.col("beyond").alias(f"beyond_{name}"))
        rows = rows.join(F.broadcast(there), "part", "left")
        reached = F.least(name, f"beyond_{name}")
        rows = rows.withColumn("agree", F.when(F.col(name) >= 0, F.greatest("agree", reached)).otherwise(F.col("agree")))
    return rows.select("doc", "place", "agree")


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document that shares a passage of PASSAGE words or more with another one: doc_id,
    n_passages, n_repeated_words, and spans (start:end in code points, comma-joined)."""
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    texts = texts.withColumn("doc", F.xxhash64("doc_id", "text"))
    suffixes = cut_lineage(map_rows(texts.select("doc", "text"), _suffixes, "key long, doc long, place int"))
    matched = cut_lineage(matching_suffixes(suffixes).distinct())

    by_place = Window.partitionBy("doc").orderBy("place")  # one document's suffixes
    chained = F.lit(True)
    sums, hashed = {"n": F.count("*")}, {}
    for i, prime in enumerate(PRIMES):
        hashed[f"h{i}"] = F.pmod(F.xxhash64("doc", F.lit(i)), F.lit(prime))
        sums[f"docs{i}"] = F.pmod(F.sum(f"h{i}"), F.lit(prime))
        sums[f"places{i}"] = F.pmod(F.sum(F.pmod(F.col(f"h{i}") * F.col("place"), F.lit(prime))), F.lit(prime))
    for name in ("n", *(f"docs{i}" for i in range(len(PRIMES)))):
        chained &= F.col(name) == F.lag(name).over(by_place)
    gap = F.col("place") - F.lag("place").over(by_place)
    for i, prime in enumerate(PRIMES):
        moved = F.col(f"places{i}") - F.lag(f"places{i}").over(by_place) - F.pmod(gap * F.col(f"docs{i}"), F.lit(prime))
        chained &= F.pmod(moved, F.lit(prime)) == 0
    of_key = matched.withColumns(hashed).groupBy("key").agg(*[total.alias(name) for name, total in sums.items()])
    apart = F.coalesce(gap > PREFIX, F.lit(True))
    numbered = matched.join(of_key, "key").withColumns({"apart": apart, "chained": F.coalesce(chained, F.lit(False)) & ~apart})
    numbered = numbered.select(
        "key", "doc", "place", F.sum(F.col("apart").cast("int")).over(by_place).alias("run"),
        F.sum((~F.col("chained")).cast("int")).over(by_place).alias("chain"),
    )
    by_chain, by_run = Window.partitionBy("doc", "run", "chain"), Window.partitionBy("doc", "run")
    length = F.max("place").over(by_chain) - F.min("place").over(by_chain)
    judged = numbered.withColumn("solid", length >= REACH).withColumns(
        {"sound": F.min("solid").over(by_run), "low": F.min("place").over(by_run), "high": F.max("place").over(by_run)}
    )
    judged = cut_lineage(judged.select("key", "doc", "place", "run", "sound", "low", "high"))
    # Only places less than REACH words from an end of their run can reach beyond it.
    ends = judged.where("sound").where(f"place < low + {REACH} OR place > high - {REACH}").select("doc", "run", "place", "key")
    end_keys = cut_lineage(ends.select("key").distinct())
    wanted = cut_lineage(matched.join(end_keys, "key"))

    places = cut_lineage(wanted.groupBy("doc").agg(F.sort_array(F.collect_set("place")).alias("places")))  # of one document
    held = F.broadcast(places) if wanted.count() <= SMALL else places
    asked = texts.join(held.withColumnRenamed("doc", "asked"), F.col("doc") == F.col("asked")).select("doc", "text", "places")
    around = map_rows(asked, _surroundings, "doc long, place int, before array<long>, after array<long>").join(wanted, ["doc", "place"])
    around = cut_lineage(around.dropDuplicates(["doc", "place"]))

    grown = ends
    for side, name in (("before", "left"), ("after", "right")):
        grown = grown.join(_extension(around, side).withColumnRenamed("agree", name), ["doc", "place"])
    start = F.min(F.col("place") - F.col("left"))
    words = F.max(F.col("place") + PREFIX + F.col("right")) - start
    extended = grown.groupBy("doc", "run").agg(start.alias("start"), words.alias("words"))

    # What is not sound: every window that holds a match whose key lies in such a run, in all documents.
    unsure = matched.join(judged.where("not sound").select("key").distinct(), "key", "left_semi").select("doc", "place")
    close = F.coalesce(F.col("place") > F.lag("place").over(by_place) + REACH + 1, F.lit(True))
    unsure = unsure.withColumn("range", F.sum(close.cast("int")).over(by_place)).groupBy("doc", "range")
    ranges = unsure.agg((F.min("place") - REACH).alias("start"), (F.max("place") - F.min("place") + REACH + PASSAGE).alias("words"))
    windows = cut_lineage(map_rows(_with_runs(texts, cut_lineage(ranges)), _passages, "key long, doc long, place int"))
    shared = matching_suffixes(windows).select("doc", F.col("place").alias("start"), F.lit(PASSAGE).alias("words"))

    parts = extended.select("doc", "start", "words").union(shared).withColumn("stop", F.col("start") + F.col("words"))
    before = Window.partitionBy("doc").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True)).cast("int")
    parts = parts.withColumn("apart", apart).withColumn("run", F.sum("apart").over(Window.partitionBy("doc").orderBy("start", "stop")))
    kept = parts.groupBy("doc", "run").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("words"))
    return map_rows(
        _with_runs(texts, cut_lineage(kept)), _spans, f"doc_id {docs.schema[id_column].dataType.simpleString()}, n_passages long, n_repeated_words long, spans string"
    )


def _with_runs(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents that have runs, with their runs in order. A document's runs are short beside its text; up to SMALL of
    them are broadcast, so that texts stay where they are."""
    lists = runs.groupBy(F.col("doc").alias("asked")).agg(F.sort_array(F.collect_list(F.struct("start", "words"))).alias("runs"))
    lists = F.broadcast(lists) if runs.count() <= SMALL else lists
    return texts.join(lists, F.col("doc") == F.col("asked")).select("doc", "doc_id", "text", "runs")
