"""The prefix trie of conversations by the Euler-tour technique.

Turns get their places from one range sort, so that even a conversation with a third of all turns is dealt over
tasks; what crosses a border is settled from one row per partition. A prefix is named by 128 bits: the exclusive
or of its turns' digests, each salted with its place, taken in blocks of BLOCK turns and carried across blocks.
Members of a prefix are one aggregate.

Runs of nodes with the same members are segments (of at most BLOCK nodes), and the tour runs over these: an arc
enters a segment, an arc leaves it, and a segment without children has both in one. Children are linked to
parents and siblings by one range sort on the parent's name, so a parent of a third of all nodes is dealt over tasks too.
The tour is a linked list, ranked by contraction: in every round the elements whose random number is below both
neighbours' leave the list and add their weights to the element before them, until at most REST are left; these are
ranked directly, and the rounds run backwards. Prefix sums at a segment's two arcs give the leaves and
the savings below it; a node's share of its segment is the sum above it within the segment.

The ids of a node's ends are joined in order piece by piece, and the pieces run through one digest, so a list of
any length needs bounded memory.

Defined cases: rows with a null conv_id belong to no conversation and are left out; turns of one conversation with equal
numbers are ordered by the digest of role and text; rows that repeat are turns of their own; null turns come first;
null role or text is empty; conversations that are empty once rebuilt are members of the root; an empty table
gives an empty result; extra columns are not read.
"""

import hashlib
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from panelwright.llm.words import struct_of
from panelwright.session import cut_lineage

GROUP, HEADS = 20, 4  # conversations that share a first one, and the bound of the turns they take from it
BLOCK = 256  # turns, or nodes of a segment, that are handled together
PIECE = 1 << 16  # ids joined at a time
REST = 8192  # elements of the list that are ranked directly


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranged(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Sorted over all partitions; the rows are stored first, so that sampling the bounds runs nothing twice."""
    return cut_lineage(df).repartitionByRange(_partitions(df), *columns).sortWithinPartitions(*columns)


def _streamed(df: DataFrame, start, schema: str) -> DataFrame:
    """`start()` gives (step, end) for each partition: step(batch) and end() return columns or None."""
    struct = struct_of(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        from pyspark import TaskContext

        step, end = start(TaskContext.get().partitionId())
        for batch in batches:
            if batch.num_rows and (columns := step(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)
        if (columns := end()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, digest, words) of every turn, pos counted from 0, as a stored table with `spans`, which marks
    conversations that lie in several partitions; and the ids of the latter, fewer than there are partitions."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    content = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", content.alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )

    def start(part: int):
        last, seen = None, 0

        def step(batch):
            nonlocal last, seen
            conv = batch["conv_id"].to_numpy()
            first = _runs(conv)
            at = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
            if conv[0] == last:
                at[: first[1] if len(first) > 1 else None] += seen
            last, seen = conv[-1], int(at[-1]) + 1
            return {"conv_id": conv, "at": at, "digest": batch["digest"], "words": batch["words"], "part": [part] * len(conv)}

        return step, lambda: None

    ranged = _ranged(rows, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"))
    numbered = cut_lineage(_streamed(ranged, start, "conv_id long, at long, digest binary, words long, part int"))
    borders = numbered.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max(F.struct("conv_id", "at")).alias("end"))
    carried, conv, seen = [(-1, 0, 0)], None, 0
    for row in borders.orderBy("part").collect():
        before = seen if row.first == conv else 0
        if before:
            carried.append((row.part, row.first, before))
        conv, seen = row.last, row.end.at + 1 + (before if row.first == row.last else 0)
    spark = conversations.sparkSession
    carried = spark.createDataFrame(carried, "in_part int, in_conv long, before long")
    spanning = carried.where("in_part >= 0").select(F.col("in_conv").alias("span_id")).distinct()
    placed = numbered.join(F.broadcast(carried), (F.col("part") == F.col("in_part")) & (F.col("conv_id") == F.col("in_conv")), "left")
    placed = placed.join(F.broadcast(spanning), F.col("conv_id") == F.col("span_id"), "left").select(
        "conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "words", F.col("span_id").isNotNull().alias("spans")
    )
    return cut_lineage(placed), spanning


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, digest, words, size) of the rebuilt conversations, and all conversations (conv_id, size)."""
    own, spanning = turns(conversations)
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    taken = F.crc32(F.col("conv_id").cast("string")) % HEADS
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(bases, "base", "left").select(
        "conv_id", "base", taken.alias("skip"), F.least(taken, F.coalesce("n_base", F.lit(0))).alias("take"), "n"
    )
    convs = cut_lineage(convs.withColumn("size", F.col("take") + F.greatest(F.col("n") - F.col("skip"), F.lit(0))))
    first = own.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    heads = first.join(convs, "base").where("pos < take").select("conv_id", "pos", "digest", "words", "size")
    moved = ("conv_id", (F.col("pos") - F.col("skip") + F.col("take")).alias("pos"), "digest", "words", "size")
    plain = convs.select("conv_id", "skip", "take", "size")
    large = plain.join(F.broadcast(spanning), F.col("conv_id") == F.col("span_id"), "left_semi")
    rest = own.where("not spans").join(plain, "conv_id").union(own.where("spans").join(F.broadcast(large), "conv_id"))
    return heads.union(rest.where("pos >= skip").select(*moved)), convs.select("conv_id", "size")


def members(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row per conversation and depth from 1: the prefix's name (k1, k2), its parent's (u1, u2), words of the last
    turn, and whether the conversation ends there; and all conversations."""
    rows, convs = rebuilt(conversations)
    salted = [F.xxhash64("digest", "pos", F.lit(i)).alias(f"x{i}") for i in (1, 2)]
    block = F.floor(F.col("pos") / BLOCK)
    rows = rows.select("conv_id", "pos", block.alias("block"), "words", "size", *salted)
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = cut_lineage(rows.select("*", F.bit_xor("x1").over(inside).alias("k1"), F.bit_xor("x2").over(inside).alias("k2")))
    # Conversations of several blocks carry what came before; their blocks are few.
    totals = rows.where(F.col("size") > BLOCK).groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "block", F.bit_xor("t1").over(before).alias("o1"), F.bit_xor("t2").over(before).alias("o2"))
    later = rows.where("block > 0").join(totals, ["conv_id", "block"])
    later = later.withColumn("k1", F.col("k1").bitwiseXOR(F.col("o1"))).withColumn("k2", F.col("k2").bitwiseXOR(F.col("o2"))).select(*rows.columns)
    return rows.where("block = 0").union(later).select(
        "conv_id", "k1", "k2", (F.col("pos") + 1).alias("depth"), "words", (F.col("pos") + 1 == F.col("size")).alias("last"),
        F.col("k1").bitwiseXOR(F.col("x1")).alias("u1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("u2"),
    ), convs


def ends_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256) of ends (k1, k2, depth, conv_id)."""

    def pieces(part: int):
        number = -1

        def step(batch):
            nonlocal number
            keys = [batch[c].to_numpy() for c in ("k1", "k2", "depth")]
            conv = batch["conv_id"].to_numpy()
            change = np.zeros(len(conv), dtype=bool)
            change[::PIECE] = True
            for key in keys:
                change[1:] |= key[1:] != key[:-1]
            edges = np.append(np.flatnonzero(change), len(conv)).tolist()
            found = {name: key[edges[:-1]] for name, key in zip(("k1", "k2", "depth"), keys, strict=True)}
            found["piece"] = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(edges, edges[1:], strict=False)]
            found["part"], found["number"] = [part] * (len(edges) - 1), np.arange(number + 1, number + len(edges))
            number += len(edges) - 1
            return found

        return step, lambda: None

    def joined(_):
        key, digest, held = None, None, {}

        def done(into):
            for name, value in zip(("k1", "k2", "depth"), key, strict=True):
                into.setdefault(name, []).append(value)
            into.setdefault("ends_sha256", []).append(digest.hexdigest())

        def step(batch):
            nonlocal key, digest
            found = {}
            for *names, piece in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "depth", "piece")), strict=True):
                if names == key:
                    digest.update(b"," + piece.encode())
                    continue
                if key is not None:
                    done(found)
                key, digest = names, hashlib.sha256(piece.encode())
            return found or None

        def end():
            if key is not None:
                done(held)
            return held or None

        return step, end

    ranged = _ranged(ends.select("k1", "k2", "depth", "conv_id"), "k1", "k2", "depth", "conv_id")
    parts = _streamed(ranged, pieces, "k1 long, k2 long, depth long, part int, number long, piece string")
    ordered = parts.repartition("k1", "k2", "depth").sortWithinPartitions("k1", "k2", "depth", "part", "number").select("k1", "k2", "depth", "piece")
    return _streamed(ordered, joined, "k1 long, k2 long, depth long, ends_sha256 string")


def linked(segments: DataFrame) -> DataFrame:
    """(sid, child, sibling, parent, parent_conv, n_children) of every segment: its first child, the next child of
    its parent (-1: none), its parent and that one's conv_id (null: the root)."""
    heads = segments.select(F.col("bottom").alias("key"), F.lit(0).alias("kind"), "conv_id", "sid")
    children = segments.where("top_depth > 0").select(F.col("above").alias("key"), F.lit(1).alias("kind"), "conv_id", "sid")

    def start(part: int):
        held, head, at = None, (None, None), 0  # the row whose successor is not known yet, and the last head

        def columns(rows, after, open_end):
            nonlocal at
            sid, kind, owner, owner_conv, known = rows
            follows = np.append(after, -1)[: len(sid)]
            found = {
                "sid": sid, "kind": kind, "after": follows, "part": [part] * len(sid), "at": np.arange(at, at + len(sid)),
                "open": np.append(np.zeros(len(sid) - 1, dtype=bool), open_end),
                "parent": pa.array(owner, mask=~known), "parent_conv": pa.array(owner_conv, mask=~known),
            }
            at += len(sid)
            return found

        def step(batch):
            nonlocal held, head
            kind, sid, conv = (batch[c].to_numpy() for c in ("kind", "sid", "conv_id"))
            # The last head at or before each row is its parent: every group starts with its head.
            last = np.maximum.accumulate(np.where(kind == 0, np.arange(len(kind)), -1))
            known = (last >= 0) | (head[0] is not None)
            owner = np.where(last >= 0, sid[last], head[0] if head[0] is not None else 0)
            owner_conv = np.where(last >= 0, conv[last], head[1] if head[0] is not None else 0)
            if last[-1] >= 0:
                head = (int(sid[last[-1]]), int(conv[last[-1]]))
            rows = [sid, kind, owner, owner_conv, known]
            if held is not None:
                rows = [np.concatenate(pair) for pair in zip(held, rows, strict=True)]
            held = [column[-1:] for column in rows]
            if len(rows[0]) == 1:
                return None
            after = np.where(rows[1][1:] == 1, rows[0][1:], -1)  # a head begins another group
            return columns([column[:-1] for column in rows], after, False)

        def end():
            return None if held is None else columns(held, np.array([], dtype=np.int64), True)

        return step, end

    ranged = _ranged(heads.union(children).select("key.*", "kind", "conv_id", "sid"), "k1", "k2", "depth", "kind", "conv_id")
    stored = cut_lineage(_streamed(
        ranged.select("kind", "conv_id", "sid"), start,
        "sid long, kind int, after long, part int, at long, open boolean, parent long, parent_conv long",
    ))
    borders = stored.groupBy("part").agg(
        F.min_by(F.struct("kind", "sid"), "at").alias("first"),
        F.max_by(F.struct("parent", "parent_conv"), F.when(F.col("parent").isNotNull(), F.col("at"))).alias("head"),
    )
    settled, head, rows = [(-1, None, None, -1)], (None, None), borders.orderBy("part").collect()
    for row, following in zip_longest(rows, rows[1:]):
        after = following.first.sid if following is not None and following.first.kind == 1 else -1
        settled.append((row.part, *head, after))
        head = (row.head.parent, row.head.parent_conv) if row.head is not None else head
    settled = segments.sparkSession.createDataFrame(settled, "in_part int, from_parent long, from_conv long, from_after long")
    rows = stored.join(F.broadcast(settled), F.col("part") == F.col("in_part")).select(
        "sid", "kind", F.when(F.col("open"), F.col("from_after")).otherwise(F.col("after")).alias("after"),
        F.coalesce("parent", "from_parent").alias("parent"), F.coalesce("parent_conv", "from_conv").alias("parent_conv"),
    )
    of = lambda kind, name: F.max(F.when(F.col("kind") == kind, F.col(name)))
    links = rows.groupBy("sid").agg(of(0, "after").alias("child"), of(1, "after").alias("sibling"), of(1, "parent").alias("parent"), of(1, "parent_conv").alias("parent_conv"))
    counts = rows.where("kind = 1").groupBy(F.col("parent").alias("sid")).agg(F.count("*").alias("n_children"))
    return links.join(counts, "sid", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def tour(segments: DataFrame) -> DataFrame:
    """The Euler tour as a list (id, succ, leaves, saved): 2 * sid enters a segment, 2 * sid + 1 leaves it; one
    without children is left by the arc that enters it. -1 ends the tour."""
    after = (
        F.when(F.col("parent").isNull(), F.lit(-1)).when(F.col("sibling") >= 0, 2 * F.col("sibling")).otherwise(2 * F.col("parent") + 1)
    )
    childless = F.col("child") < 0
    zero = F.lit(0).cast("long")
    enter = segments.select(
        (2 * F.col("sid")).alias("id"), F.when(childless, after).otherwise(2 * F.col("child")).alias("succ"),
        childless.cast("long").alias("leaves"), "saved",
    )
    leave = segments.where(~childless).select((2 * F.col("sid") + 1).alias("id"), after.alias("succ"), zero.alias("leaves"), zero.alias("saved"))
    return enter.union(leave)


def prefix_sums(elements: DataFrame, rest: int = REST) -> DataFrame:
    """(id, leaves, saved): the sums over all elements before each one of a list (id, succ, leaves, saved)."""
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    messages = elements.select("id", none.alias("pred"), "succ", "leaves", "saved").union(
        elements.where("succ >= 0").select(F.col("succ"), F.col("id"), none, zero, zero)
    )

    def gathered(messages):
        return cut_lineage(messages.groupBy("id").agg(
            F.max("pred").alias("pred"), F.max("succ").alias("succ"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        ))

    live, rounds = gathered(messages), []
    while live.count() > rest:
        number = lambda name, turn=len(rounds): F.xxhash64(F.col(name), F.lit(turn))
        # The first and the last element stay; of two neighbours at most one leaves.
        leaves_now = F.col("pred").isNotNull() & (F.col("succ") >= 0) & (number("id") < number("pred")) & (number("id") < number("succ"))
        marked = live.withColumn("gone", leaves_now)
        gone = marked.where("gone")
        # Kept elements keep the neighbour that stays; the others are told their new one.
        kept = marked.where("not gone")
        told = kept.select("id", F.struct(F.lit(0).alias("new"), "pred").alias("pred"), F.struct(F.lit(0).alias("new"), "succ").alias("succ"), "leaves", "saved")
        empty = F.struct(F.lit(-1).alias("new"), none.alias("pred")), F.struct(F.lit(-1).alias("new"), none.alias("succ"))
        told = told.union(gone.select(F.col("pred"), empty[0], F.struct(F.lit(1).alias("new"), F.col("succ")), "leaves", "saved"))
        told = told.union(gone.select(F.col("succ"), F.struct(F.lit(1).alias("new"), F.col("pred")), empty[1], zero, zero))
        rounds.append(gone.select("id", "succ", "leaves", "saved"))
        live = cut_lineage(
            told.groupBy("id").agg(F.max("pred").alias("p"), F.max("succ").alias("s"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            .select("id", "p.pred", "s.succ", "leaves", "saved")
        )
    rows = {row.id: row for row in live.collect()}  # at most `rest`
    ranked, at, leaves, saved = [], next((row.id for row in rows.values() if row.pred is None), -1), 0, 0
    while at >= 0:
        row = rows[at]
        ranked.append((at, leaves, saved))
        at, leaves, saved = row.succ, leaves + row.leaves, saved + row.saved
    known = elements.sparkSession.createDataFrame(ranked, "id long, leaves long, saved long")
    for gone in reversed(rounds):
        ahead = known.select(F.col("id").alias("succ"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
        back = gone.join(ahead, "succ").select("id", (F.col("l") - F.col("leaves")).alias("leaves"), (F.col("s") - F.col("saved")).alias("saved"))
        known = cut_lineage(known.union(back))
    return known


def trie(conversations: DataFrame, rest: int = REST) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = members(conversations)
    zero = F.lit(0).cast("long")
    nodes = rows.groupBy("k1", "k2", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("u1").alias("u1"), F.max("u2").alias("u2")
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("words"), zero.alias("u1"), zero.alias("u2")
    )
    nodes = nodes.union(root).withColumn("gain", (F.col("n_convs") - 1) * F.col("words")).withColumn("block", F.floor(F.col("depth") / BLOCK))
    nodes = cut_lineage(nodes)
    ends = rows.where("last").select("k1", "k2", "depth", "conv_id").union(convs.where("size = 0").select(zero, zero, zero, "conv_id"))

    # Nodes with the same smallest member and as many members have the same members, and follow one another.
    key = ["conv_id", "n_convs", "block"]
    above = F.struct(F.col("u1").alias("k1"), F.col("u2").alias("k2"), (F.col("depth") - 1).alias("depth"))
    segments = nodes.groupBy(*key).agg(
        F.min("depth").alias("top_depth"), F.min_by(above, "depth").alias("above"), F.max("depth").alias("bottom_depth"),
        F.max_by(F.struct("k1", "k2", "depth"), "depth").alias("bottom"), F.sum("gain").alias("saved"),
    )
    segments = cut_lineage(segments.withColumn("sid", F.monotonically_increasing_id()))  # written once, so the numbers stay
    segments = cut_lineage(segments.join(linked(segments), "sid"))
    sums = prefix_sums(tour(segments), rest)
    arcs = sums.groupBy(F.floor(F.col("id") / 2).alias("sid")).agg(
        *[F.max(F.when(F.col("id") % 2 == side, F.col(name))).alias(f"{name}_{side}") for side in (0, 1) for name in ("leaves", "saved")]
    )
    below = segments.join(arcs, "sid").select(
        *key, "top_depth", "bottom_depth", "parent_conv", "n_children",
        F.coalesce(F.col("leaves_1") - F.col("leaves_0"), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.col("saved_1") - F.col("saved_0"), F.col("saved")).alias("saved"),
    )
    higher = Window.partitionBy(*key).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    result = nodes.join(below, key).withColumn("above", F.coalesce(F.sum("gain").over(higher), F.lit(0)))
    result = result.join(ends_digests(ends), ["k1", "k2", "depth"], "left")
    return result.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top_depth"), F.col("parent_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(F.col("depth") == F.col("bottom_depth"), F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves", (F.col("saved") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
