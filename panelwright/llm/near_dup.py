"""MinHash near-duplicates by one-permutation hashing.

A document's set holds its distinct shingles of five words (lower-cased A-Z, split at ASCII white
space). One hash permutation fills the bins of a signature; every empty bin borrows from the filled bin
that comes first in an order drawn for that bin (optimal densification). Bands of bins are buckets.

Equal sets are one node. Within a bucket every node is a candidate of the smallest one (a star), so
pairs grow with the rows and not with their square. Candidates are confirmed on full sets and joined
into components. Then only nodes whose bucket still holds another component are compared further, and
only pairs that pass two bounds which lose no link: the ratio of the set sizes, and the overlap that
the counts per hash range allow.

Defined cases: null text is empty; a text without words has an empty set and is linked with nothing;
rows that repeat a doc_id are judged one by one; `keep_one` keeps a component's row that comes first by
doc_id (null last), then text key; a null doc_id never names a component that has a
member with one; extra columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.words import encoded, hashed_words, map_rows, mixed, sequences, slices
from panelwright.session import cut_lineage

SHINGLE = 5
BANDS, ROWS = 40, 8  # a pair at similarity 0.85 shares no band with probability 3e-6
BINS = BANDS * ROWS
RANGES, LEVELS = 128, 8  # a profile counts the hashes of each range in unary, up to LEVELS
SALTS, HOT = 64, 1000  # keys that a hot centre is dealt over; a centre is hot above one in HOT of all pairs
SMALL = 500_000  # rows of (id, text key) that may be broadcast: at most 40 MB

_RNG = np.random.default_rng(85)
_RANK = _RNG.integers(0, 2**32, (BINS, BINS), dtype=np.uint32)
_ORDER = _RANK.argsort(axis=1, kind="stable").T.copy()
_ROW = _RNG.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 2**64, BANDS, dtype=np.uint64)
_TRIES = 24


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words is one shingle."""
    hashes, _, _, first = hashed_words(texts)
    every, sets = sequences(hashes, SHINGLE), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            values = np.sort(every[a : b - SHINGLE + 1])
            keep = np.ones(len(values), dtype=bool)
            np.not_equal(values[1:], values[:-1], out=keep[1:])
            sets.append(values[keep])
        else:
            sets.append(sequences(hashes[a:b], b - a) if b > a else hashes[:0])
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Densified signatures, a row per set; sets must not be empty."""
    sizes = np.array([len(values) for values in sets])
    values = np.concatenate(sets)
    cell = np.repeat(np.arange(len(sets)) * BINS, sizes) + (
        ((values >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    ).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))  # sorted: the bin's minimum
    signature = np.zeros(len(sets) * BINS, dtype=np.uint64)
    signature[cell[first]] = values[first]
    signature = signature.reshape(-1, BINS)
    filled = np.zeros(len(sets) * BINS, dtype=bool)
    filled[cell[first]] = True
    filled = filled.reshape(-1, BINS)
    row, column = np.nonzero(~filled)
    for turn in range(_TRIES):
        donor = _ORDER[turn][column]
        found = filled[row, donor]
        signature[row[found], column[found]] = signature[row[found], donor[found]]
        row, column = row[~found], column[~found]
    for i in np.unique(row):  # sparse sets: the same first donor, looked up among the filled bins
        empty, full = column[row == i], np.flatnonzero(filled[i])
        signature[i, empty] = signature[i, full[_RANK[np.ix_(empty, full)].argmin(axis=1)]]
    return signature


def band_hashes(signature: np.ndarray) -> np.ndarray:
    return mixed((signature.reshape(-1, BANDS, ROWS) * _ROW).sum(axis=2, dtype=np.uint64) + _BAND)


def _sketch(batch: pa.RecordBatch):
    texts, ids, keys = encoded(batch["text"]), batch["doc_id"], batch["text_key"]
    for a, b in slices(texts):
        sets = shingle_sets(texts[a:b])
        some = [i for i, values in enumerate(sets) if len(values)]
        bands: list = [None] * len(sets)
        profiles: list = [None] * len(sets)
        over = [0] * len(sets)
        if some:
            hashed = band_hashes(signatures([sets[i] for i in some])).view(np.int64)
            for i, values in zip(some, hashed, strict=True):
                bands[i] = values
                counts = np.bincount((sets[i] >> np.uint64(57)).astype(np.int64), minlength=RANGES)
                unary = np.arange(LEVELS) < counts[:, None]
                profiles[i] = np.packbits(unary).view(np.int64)
                over[i] = len(sets[i]) - int(unary.sum())
        yield {
            "doc_id": ids[a:b], "text_key": keys[a:b], "n": [len(values) for values in sets],
            "digest": [hashlib.blake2b(values.tobytes(), digest_size=16).digest() for values in sets],
            "bands": bands, "profile": profiles, "over": over,
        }


def _full_sets(batch: pa.RecordBatch):
    texts, nodes = encoded(batch["text"]), batch["node"]
    for a, b in slices(texts):
        yield {"node": nodes[a:b], "items": [values.view(np.int64) for values in shingle_sets(texts[a:b])]}


def _can_link(percent: int, overlap, a: str, b: str):
    return (100 + percent) * overlap >= percent * (F.col(a) + F.col(b))


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and profiles (an upper bound of the overlap) allow the similarity; loses none that reach it."""
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    common = F.least("over_a", "over_b")
    for i in range(RANGES * LEVELS // 64):
        common = common + F.bit_count(F.col("profile_a")[i].bitwiseAND(F.col("profile_b")[i]))
    return pairs.where(100 * small >= percent * large).where(_can_link(percent, common, "n_a", "n_b"))


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the candidate pairs (a, b) with sizes and counts those that reach the similarity on full sets."""
    pairs = cut_lineage(_possible(pairs, percent).select("a", "b", "n_a", "n_b"))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    needed = cut_lineage(ends.join(nodes.select("node", "doc_id", "text_key"), "node"))
    if needed.count() <= SMALL:
        needed = F.broadcast(needed)
    found = texts.join(
        needed.withColumnsRenamed({"doc_id": "need_id", "text_key": "need_key"}),
        F.col("text_key").eqNullSafe(F.col("need_key")) & F.col("doc_id").eqNullSafe(F.col("need_id")),
    ).select("node", "text")
    sets = cut_lineage(map_rows(found, _full_sets, "node long, items array<long>"))
    # A centre with many pairs is dealt over SALTS keys, and so are its copies; there are at most HOT such centres.
    counts = pairs.groupBy(F.col("a").alias("hot")).agg(F.count("*").alias("size"))
    hot = F.broadcast(counts.where(F.col("size") > F.greatest(F.lit(pairs.count() / HOT), F.lit(HOT))).select("hot"))
    salted = pairs.join(hot, F.col("a") == F.col("hot"), "left").withColumn(
        "salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("b"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    )
    centres = sets.join(hot, F.col("node") == F.col("hot"), "left").select(
        F.col("node").alias("a"), F.col("items").alias("items_a"),
        F.explode(F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"),
    )
    both = salted.join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b").join(centres, ["a", "salt"])
    overlap = F.size(F.array_intersect("items_a", "items_b"))
    return cut_lineage(both.where(_can_link(percent, overlap, "n_a", "n_b")).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): the smallest node it reaches.

    Large-star and small-star rounds on tables in the shared folder until the edges stay as they are;
    each round groups by node with partial minima, so a node with many neighbours is no hot task.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u").where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        )
        large = cut_lineage(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        changed = small.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(small, ["u", "v"], "left_anti").limit(1).count()
        edges = small
        if not changed:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )


def near_duplicates(docs: DataFrame, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id names the component), text_key and leads (the row that
    `keep_one` keeps, or one equal to it) for every row of `docs`."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    sketches = cut_lineage(
        map_rows(texts, _sketch, "doc_id long, text_key long, n int, digest binary, bands array<long>, profile array<long>, over int")
    )
    # Equal sets are one node; the aggregate also keeps one row that has the set, and the smallest id.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    nodes = (
        sketches.where("n > 0").groupBy("digest")
        .agg(first.alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("profile").alias("profile"), F.first("over").alias("over"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", "first.doc_id", "first.text_key", "n", "bands", "profile", "over")
    )
    nodes = cut_lineage(nodes)  # written once, so the numbers stay as they are
    sizes = nodes.select("node", "n", "profile", "over")

    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    centres = buckets.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("members")).where("members > 1").drop("members")
    shared = cut_lineage(buckets.join(centres, "bucket"))
    stars = shared.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    side = lambda name: sizes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("profile").alias(f"profile_{name}"), F.col("over").alias(f"over_{name}"))
    links = _confirmed(stars.join(side("b"), "b").join(side("a"), "a"), nodes, texts, percent)
    roots = cut_lineage(components(links))

    # Buckets that hold several components: pairs across them, which no star has tried.
    placed = shared.join(roots, "node", "left").select("bucket", "centre", "node", F.coalesce("root", "node").alias("root"))
    mixed_buckets = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    rest = cut_lineage(
        placed.join(mixed_buckets.select("bucket"), "bucket").join(sizes, "node")
        .select("bucket", "node", "root", "n", "profile", "over", (F.col("node") == F.col("centre")).alias("tried"))
    )
    left = rest.select("bucket", *[F.col(c).alias(f"{c}_a") for c in ("node", "root", "n", "profile", "over", "tried")])
    right = rest.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "n", "profile", "over", "tried")])
    across = _possible(left.join(right, "bucket").where("root_a < root_b and not tried_a and not tried_b"), percent)
    across = across.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    more = _confirmed(across.join(side("a"), "a").join(side("b"), "b"), nodes, texts, percent)
    roots = cut_lineage(components(links.union(more)))

    placed = nodes.select("node", "digest", "doc_id", "text_key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = placed.groupBy("root").agg(first.alias("leader"))
    leader = (F.col("leader.doc_id").alias("component_id"), F.col("leader.text_key").alias("leader_key"))
    named = cut_lineage(placed.join(names, "root").select("digest", *leader))
    result = sketches.select("doc_id", "text_key", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    leads = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("leader_key"))
    return result.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key", ((F.col("n") == 0) | leads).alias("leads"),
    )


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id (null last), then text key; rows that repeat both its
    doc_id and its text count once. Returns the columns of `docs`, whatever their names."""
    kept = near_duplicates(docs, percent).where("leads").groupBy(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).agg((F.count("*") > 1).alias("tied"))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("key"))
    rows = rows.join(kept, F.col("row.doc_id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    tied = rows.where("tied").dropDuplicates(["kept_id", "kept_key"])
    return rows.where("not tied").union(tied).select("row.*")
