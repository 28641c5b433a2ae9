"""SentencePiece encoding and decoding by a table of distinct chunks.

The model's pieces never cross from another character to a word marker, so the marked text falls into
chunks, a run of markers and what follows it, that are segmented by themselves. Documents go through three
steps:

1. A task numbers the distinct chunks of a block of documents, the most frequent first, and turns every
   document into the numbers at its positions. A block is bounded in bytes; a chunk leaves it once, however
   often it occurs. Chunks leave in buckets by their hash, so a row is a few thousand chunks.
2. Buckets of all blocks meet by number. A distinct chunk is in one bucket, is segmented when it is first
   met there, and its ids go to every block that uses it; a frequent chunk comes once per block.
3. A block's ids come to its documents, which lie in files dealt out by block: ids are joined back by position,
   and decoded.

A task remembers at most TABLE_BYTES of chunks of a bucket; beyond that it forgets them and segments again, so
memory is bounded at any number of distinct chunks, and results stay the same.

Within a chunk the pair of highest score is merged first, the leftmost of equal ones, with a heap; characters
that no piece holds become byte pieces. Positions between which no piece has those two neighbours are
never merged across, so even a chunk of many megabytes is a list of short stretches.

Defined cases: null text is empty and has only the begin and end ids; word markers in a text decode as
spaces, as in the library; unpaired surrogates cannot occur in Spark strings; rows that repeat are encoded one
by one; an empty table gives an empty result; extra columns are not read. Models with a character map, with
markers behind words, or with pieces that cross a marker are refused.
"""

import hashlib
import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from panelwright.llm.words import struct_of
from panelwright.session import scratch_dir

MARK = "▁"
BLOCK_BYTES = 24 << 20  # text whose distinct chunks are numbered together, one document at least
LEAST_BUCKETS, MOST_BUCKETS = 64, 4096
TABLE_BYTES = 64 << 20  # chunks and ids of a bucket that a task remembers
DECODE_IDS = 1 << 16  # ids decoded at a time
SHORT, NEVER = 48, -1e300  # characters of a short stretch; the score of what is no piece
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        else:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class Model:
    """A BPE piece model: scores of mergeable pieces, ids, byte pieces, and what the texts are prepared with."""

    def __init__(self, raw: bytes):
        self.surfaces: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.unknown, controls = 0, {}
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in _fields(raw):
            if field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
            if field != 1:
                continue
            number, piece = len(self.surfaces), dict(_fields(value))
            text, kind = piece[1].decode(), piece.get(3, NORMAL)
            surface = text.replace(MARK, " ").encode()
            if kind == BYTE:
                code = int(text[3:5], 16)
                self.bytes[code], surface = number, bytes([code])
            elif kind == NORMAL:
                self.ids[text], self.scores[text] = number, struct.unpack("<f", piece.get(2, bytes(4)))[0]
            elif kind == UNKNOWN:
                self.unknown, surface = number, " ⁇ ".encode()
            elif kind == CONTROL:
                controls[text], surface = number, b""
            else:
                raise ValueError(f"piece {number} ({text}) is of a kind that is not supported: {kind}")
            self.surfaces.append(surface)
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1):
            raise ValueError("only BPE models without a character map, with a leading marker and kept white space, are supported")
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in self.ids):
            raise ValueError("a piece crosses a word marker, so chunks cannot be segmented by themselves")
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces for unknown characters")
        self.begin, self.end = (controls[name] for name in ("<s>", "</s>"))
        self.is_byte = np.zeros(len(self.surfaces), dtype=bool)
        self.is_byte[list(self.bytes.values())] = True
        self.neighbours = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}

    def stretches(self, chunk: str) -> Iterator[str]:
        """Parts of the chunk between which no merge can happen."""
        start, neighbours = 0, self.neighbours
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in neighbours:
                yield chunk[start:i]
                start = i
        yield chunk[start:]

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short stretch: neighbours' scores in a list, the highest looked for each time."""
        score = self.scores.get
        parts = list(text)
        values = [score(text[i : i + 2], NEVER) for i in range(len(text) - 1)]
        while values:
            best = max(values)
            if best == NEVER:
                break
            i = values.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del values[i]
            if i < len(values):
                values[i] = score(parts[i] + parts[i + 1], NEVER)
            if i:
                values[i - 1] = score(parts[i - 1] + parts[i], NEVER)
        return parts

    def _merged_long(self, text: str) -> list[str]:
        """The same with a heap of neighbours, in a time that grows little faster than the stretch."""
        score, size = self.scores.get, len(text)
        parts: list[str] = list(text)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            value = score(parts[i] + parts[j])
            if value is not None:
                heapq.heappush(heap, (-value, i, parts[i] + parts[j]))

        for i in range(size - 1):
            offer(i, i + 1)
        while heap:
            _, i, joint = heapq.heappop(heap)
            j = after[i] if parts[i] else size
            if j >= size or parts[i] + parts[j] != joint:
                continue  # one of the two was merged elsewhere meanwhile
            parts[i], parts[j] = joint, ""
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [part for part in parts if part]

    def segment(self, stretch: str) -> bytes:
        """Ids of one stretch as little-endian unsigned 32-bit integers."""
        ids: list[int] = []
        for part in (self._merged if len(stretch) <= SHORT else self._merged_long)(stretch):
            number = self.ids.get(part)
            if number is None:
                ids += [self.bytes[byte] for byte in part.encode()]
            else:
                ids.append(number)
        return array("I", ids).tobytes()

    def framed(self, ids: bytes) -> bytes:
        return struct.pack("<I", self.begin) + ids + struct.pack("<I", self.end)

    def decoded(self, ids: bytes) -> Iterator[bytes]:
        """Text of the ids in UTF-8, block by block; the leading marker's space goes, bytes that form no character
        become U+FFFD one by one."""
        numbers, first, held = np.frombuffer(ids, dtype="<u4"), True, b""
        for at in range(0, len(numbers), DECODE_IDS):
            part = numbers[at : at + DECODE_IDS]
            text, open_end = held + b"".join(map(self.surfaces.__getitem__, part.tolist())), bool(held)
            held = b""
            if open_end or self.is_byte[part].any():
                cut = len(text)
                for back in range(1, min(3, len(text)) + 1):  # an unfinished character waits for the next block
                    lead = text[-back]
                    if lead >= 0xC0:
                        cut -= back if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) else 0
                    if lead >= 0xC0 or lead < 0x80:
                        break
                text, held = text[:cut], text[cut:]
                try:
                    text.decode()
                except UnicodeDecodeError:
                    text = _repaired(text)
            if first and text:
                text, first = text.removeprefix(b" "), False
            yield text
        yield _repaired(held)


def _repaired(text: bytes) -> bytes:
    """Every byte that belongs to no character is replaced by itself."""
    out, at = [], 0
    while at < len(text):
        try:
            out.append(text[at:].decode().encode())
            break
        except UnicodeDecodeError as error:
            out += [text[at : at + error.start], "�".encode()]
            at += error.start + 1
    return b"".join(out)


class _Numbers(dict):
    """chunk (without its first marker) -> number, in order of first use."""

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        return number


_CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


def chunks(text: str) -> list[str]:
    """Chunks of a text, each without its first marker; none for an empty text. No chunk holds a space."""
    if not text:
        return []
    parts = text.split(" ")
    if MARK not in text and all(parts):
        return parts
    return [chunk[1:] for chunk in _CHUNKS(MARK + text.replace(" ", MARK))]


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, which compress well since high bytes are mostly zero."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _small(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _large(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


# One table of three kinds of rows: documents (doc_id, payload: numbers at its positions; place null), the buckets of a block's
# chunks (place: bucket, payload: chunks), and a block's list of the bucket of each number (place -1).
CODED = "block long, place int, doc_id long, payload binary"
_CODED = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("payload", pa.binary())])


def _rows(block: int, places: list, doc_ids: list, payloads: list) -> pa.RecordBatch:
    columns = ([block] * len(payloads), places, doc_ids, payloads)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CODED, strict=True)], schema=_CODED)


class _Block:
    """Documents as numbers of distinct chunks."""

    def __init__(self):
        self.numbers, self.doc_ids, self.codes, self.size = _Numbers(), [], [], 0

    def add(self, doc_id, text: str) -> None:
        self.size += len(text)
        words = chunks(text)
        self.doc_ids.append(doc_id)
        self.codes.append(np.fromiter(map(self.numbers.__getitem__, words), dtype=np.uint32, count=len(words)))

    def rows(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(len(self.numbers), dtype=np.int64)
        for codes in self.codes:
            np.add.at(uses, codes, 1)
        order = np.argsort(-uses, kind="stable")  # the most frequent chunk gets number 0
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        for at in range(0, len(self.codes), 512):
            some = self.codes[at : at + 512]
            yield _rows(block, [None] * len(some), self.doc_ids[at : at + 512], [_small(_packed(rank[codes])) for codes in some])
        known = list(self.numbers)
        known = [known[code] for code in order.tolist()]
        bucket_of = np.fromiter((zlib.crc32(chunk.encode()) % buckets for chunk in known), dtype="<u2", count=len(known))
        by_bucket = np.argsort(bucket_of, kind="stable")
        edges = np.searchsorted(bucket_of[by_bucket], np.arange(buckets + 1)).tolist()
        yield _rows(block, [-1], [None], [_small(bucket_of.tobytes())])
        for bucket in range(buckets):
            a, b = edges[bucket], edges[bucket + 1]
            if a < b:
                yield _rows(block, [bucket], [None], [_small(" ".join([known[i] for i in by_bucket[a:b].tolist()]).encode())])


def _coded(buckets: int):
    def run(batches):
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text.as_py()
                if block.size and block.size + len(text) > BLOCK_BYTES:
                    yield from block.rows(number, buckets)
                    number, block = number + 1, _Block()
                block.add(doc_id.as_py(), text)
        if block.doc_ids:
            yield from block.rows(number, buckets)

    return run


def _chunks_of(payload: bytes) -> list[str]:
    return _large(payload).decode().split(" ")


_models: dict = {}


def _model(file) -> Model:
    """The model of a broadcast file, read once in a Python worker."""
    raw = file.value
    if _models.get("raw") is not raw:
        _models.update(raw=raw, model=Model(raw))
    return _models["model"]


def _model_file(docs: DataFrame, path: str | None):
    """The model file is of fixed size (half a megabyte), so it is broadcast; it is checked on the driver."""
    import public_tokenizers

    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        raw = file.read()
    Model(raw)
    return docs.sparkSession.sparkContext.broadcast(raw)


class _Table(dict):
    """Distinct chunk (without its first marker) -> packed ids, segmented when first met. Chunks that differ in
    punctuation only share their stretches."""

    def __init__(self, model: Model):
        self.model, self.known, self.size = model, {}, 0

    def __missing__(self, chunk: str) -> bytes:
        if self.size > TABLE_BYTES:
            self.clear()
            self.known.clear()
            self.size = 0
        parts = []
        for stretch in self.model.stretches(MARK + chunk):
            ids = self.known.get(stretch)
            if ids is None:
                ids = self.known[stretch] = self.model.segment(stretch)
                self.size += len(stretch) + len(ids) + 200
            parts.append(ids)
        ids = self[chunk] = b"".join(parts)
        self.size += len(chunk) + len(ids) + 200
        return ids


def segmented(coded: DataFrame, file) -> DataFrame:
    """The buckets of all blocks with ids in place of chunks: equal buckets meet, and share a table."""

    def run(batches):
        place, table = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                if batch["place"][row].as_py() != place:
                    place, table = batch["place"][row].as_py(), _Table(_model(file))
                ids = [table[chunk] for chunk in _chunks_of(batch["payload"][row].as_py())]
                sizes = np.fromiter(map(len, ids), dtype=np.uint32, count=len(ids)) // 4
                packed = _small(struct.pack("<I", len(ids)) + _packed(sizes) + _packed(np.frombuffer(b"".join(ids), dtype="<u4")))
                yield _rows(batch["block"][row].as_py(), [place], [None], [packed])

    buckets = coded.where("place >= 0")
    return buckets.repartition("place").sortWithinPartitions("place").mapInArrow(run, struct_of(CODED))


def _ids_of(payload: bytes) -> list[bytes]:
    data = _large(payload)
    (count,) = struct.unpack_from("<I", data)
    sizes = _unpacked(data[4 : 4 + 4 * count])
    ids, ends = _unpacked(data[4 + 4 * count :]).tobytes(), (4 * sizes.cumsum()).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _joined(coded: DataFrame, file, finish, schema: str) -> DataFrame:
    """Joins the ids of a block's chunks to the positions of its documents. `finish` takes the model, doc_ids and
    the packed ids of some documents and gives columns. The documents lie in the files of their block already, so
    only ids move."""
    struct = struct_of(schema)
    arrow = to_arrow_schema(struct)

    def run(documents: pa.Table, buckets: pa.Table) -> pa.Table:
        model, flat, table, made = _model(file), [], [], []
        buckets = buckets.sort_by("place")
        for payload in buckets["payload"]:
            flat += _ids_of(payload.as_py())
        is_list = pc.is_valid(documents["place"])
        for payload in documents.filter(is_list)["payload"]:
            bucket_of = np.frombuffer(_large(payload.as_py()), dtype="<u2")
            inverse = np.empty(len(bucket_of), dtype=np.int64)
            inverse[np.argsort(bucket_of, kind="stable")] = np.arange(len(bucket_of))
            table = [flat[i] for i in inverse.tolist()]
        documents = documents.filter(pc.invert(is_list))
        for at in range(0, documents.num_rows, 64):
            part = documents.slice(at, 64)
            packed = [
                model.framed(b"".join(map(table.__getitem__, _unpacked(_large(payload.as_py())).tolist()))) for payload in part["payload"]
            ]
            columns = finish(model, part["doc_id"].to_pylist(), packed)
            made.append(pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow))
        return pa.Table.from_batches(made, schema=arrow)

    documents = coded.where("place is null or place < 0").groupBy("block")
    return documents.cogroup(segmented(coded, file).groupBy("block")).applyInArrow(run, struct)


def stored_by_block(rows: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows as a stored table whose files are dealt out by block, so that no join on block moves them. The
    catalogue's entry goes at once, the frame keeps to the files in the shared folder."""
    spark, name = rows.sparkSession, f"coded_{uuid4().hex}"
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(partitions, "block").option("compression", compression).option("path", f"{scratch_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _prepared(docs: DataFrame, path: str | None, id_column: str, text_column: str):
    file = _model_file(docs, path)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(max(LEAST_BUCKETS, 4 * partitions), MOST_BUCKETS)
    return file, stored_by_block(rows.mapInArrow(_coded(buckets), struct_of(CODED)))


def chunk_table(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The distinct chunks of all texts: chunk (with its marker), ids, and the blocks of documents that use it."""
    file, coded = _prepared(docs, path, id_column, text_column)

    def listed(batches):
        for batch in batches:
            for payload in batch["payload"]:
                yield pa.RecordBatch.from_arrays([pa.array([MARK + chunk for chunk in _chunks_of(payload.as_py())])], names=["chunk"])

    def run(batches):
        for batch in batches:
            table = _Table(_model(file))
            ids = [np.frombuffer(table[chunk[1:]], dtype="<u4").astype(np.int32) for chunk in batch["chunk"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["chunk"], pa.array(ids, pa.list_(pa.int32())), batch["n_blocks"]], names=["chunk", "ids", "n_blocks"])

    uses = coded.where("place >= 0").select("payload").mapInArrow(listed, struct_of("chunk string"))
    counted = uses.groupBy("chunk").agg(F.count("*").alias("n_blocks"))
    return counted.mapInArrow(run, struct_of("chunk string, ids array<int>, n_blocks long"))


def encode(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the ids (array of int, begin and end included) of every whole text."""
    file, coded = _prepared(docs, path, id_column, text_column)

    def finish(model, doc_ids, packed):
        return {"doc_id": doc_ids, "ids": [np.frombuffer(ids, dtype="<u4").astype(np.int32) for ids in packed]}

    return _joined(coded, file, finish, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """doc_id and the text of the ids; null ids are none."""
    file = _model_file(tokens, path)
    rows = tokens.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(ids_column), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [b"".join(_model(file).decoded(np.array(ids, dtype="<u4").tobytes())).decode() for ids in part["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, struct_of("doc_id long, text string"))


def round_trip(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes and decodes every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    file, coded = _prepared(docs, path, id_column, text_column)

    def finish(model, doc_ids, packed):
        back = []
        for ids in packed:
            digest = hashlib.sha256()
            for part in model.decoded(ids):
                digest.update(part)
            back.append(digest.hexdigest())
        return {
            "doc_id": doc_ids, "n_tokens": [len(ids) // 4 for ids in packed],
            "ids_sha256": [hashlib.sha256(ids).hexdigest() for ids in packed], "decoded_sha256": back,
        }

    return _joined(coded, file, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
