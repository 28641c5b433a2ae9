"""Byte-level BPE by a finite-state transducer that is determinised while it runs.

The merges define a nondeterministic transducer over bytes: a configuration holds the last finished
token and a place in the vocabulary's prefix tree, and a token may follow another only where merging
the two together gives back just the two. Exactly one token ends the encoding of each prefix, but bytes
ahead decide which prefixes end in a token of the whole text. Determinisation keeps the set of live
configurations, each set is a state made when it is first met, and a transition gives the token that ends
the prefix. Tokens leave when every live configuration agrees on them, after a bounded lookahead. States
beyond the memory set for them are forgotten and made again.

Decoding joins the tokens' bytes and passes them through an incremental UTF-8 state machine, which holds
back an unfinished character at the end of a block.

Defined cases: null text is empty and has no tokens; rows that repeat are encoded one by one; extra
columns are not read.
"""

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.words import map_rows

STATES = 250_000  # remembered states of the transducer
PIECES = 250_000  # remembered pieces of text in each of two generations, some 170 bytes each
NODE_BITS, TOKEN_BITS = 28, 24  # room for nodes of the prefix tree and for tokens
NODE, TOKEN = (1 << NODE_BITS) - 1, (1 << TOKEN_BITS) - 1
LOOKAHEAD = 4_096  # bytes after which tokens leave that are settled; far above the longest token
DECODE_BLOCK = 8_192  # tokens decoded at a time


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def merged_pairs(data: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[int]:
    """Tokens of a short byte string by repeatedly merging the neighbours of lowest rank under `below`."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        joins = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
        least = min(joins)
        if least >= below:
            break
        at = joins.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[part] for part in parts]


class Transducer:
    """Deterministic transitions, made when first met. After each byte a state gives the last token of the
    encoding of the bytes so far; tokens leave once every live configuration agrees on them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = [len(token) for token in self.tokens]
        # The prefix tree: node << 8 | byte -> node; 0 is the root.
        self.children: dict[int, int] = {}
        self.ends, self.depth, self.inner = [-1], [0], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                after = self.children.get(node << 8 | byte)
                if after is None:
                    after = self.children[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.inner.append(False)
                node = after
            self.ends[node] = rank
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        # A configuration is one number, token + 1 over NODE_BITS bits of node, and so is a move: state over
        # TOKEN_BITS bits of token. States in moves are already shifted by a byte.
        start = (0,)
        self.numbers: dict[tuple, int] = {start: 0}
        self.states: list[tuple] = [start]
        self.moves: dict[int, int] = {}

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; itself twice for a byte, None if merging never makes it."""
        if token not in self.halves:
            data = self.tokens[token]
            parts = merged_pairs(data, self.ranks, token)
            self.halves[token] = (token, token) if len(data) == 1 else (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def _follows(self, last: int, token: int) -> bool:
        """Whether merging the bytes of both tokens gives back just the two."""
        if self._halves(token) is None:
            return False
        if last < 0:
            return True
        key = last << 32 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 2 * STATES:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(last, token)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Undoes the later merge of the two sides again and again; a merge across the border that comes
        before the merges on both sides of it would have joined them."""
        before = 1 << 60
        while True:
            joint = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joint is not None and joint < before:
                return False
            undo_left = self.lengths[left] > 1 and (left > right or self.lengths[right] == 1)
            if undo_left:
                before, left = left, self._halves(left)[1]
            elif self.lengths[right] > 1:
                before, right = right + 1, self._halves(right)[0]
            else:
                return True

    def _step(self, state: int, byte: int) -> int:
        """The next state, with the token that the encoding of all bytes so far ends with."""
        live, finished = [], -1
        children, ends, inner = self.children, self.ends, self.inner
        for configuration in self.states[state >> 8]:
            after = children.get((configuration & NODE) << 8 | byte)
            if after is None:
                continue
            token = ends[after]
            if token >= 0 and finished < 0 and self._follows((configuration >> NODE_BITS) - 1, token):
                finished = token
            if inner[after]:
                live.append(configuration & ~NODE | after)
        live.append(finished + 1 << NODE_BITS)
        key = tuple(live)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states) << 8
            self.states.append(key)
        move = self.moves[state | byte] = number << TOKEN_BITS | finished
        return move

    def _emit(self, last: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= self.lengths[last[end]]
        out.reverse()
        return out

    def _settled(self, last: list[int], state: int) -> int:
        """The latest place that the encodings of all live configurations pass through."""
        paths = []
        for configuration in self.states[state >> 8]:
            at, path = len(last) - 1 - self.depth[configuration & NODE], set()
            while at > 0:
                path.add(at)
                at -= self.lengths[last[at]]
            paths.append(path)
        return max(set.intersection(*paths), default=0)

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) >= STATES:
            self.forget()
        state, out, last = 0, [], [-1]
        get, append = self.moves.get, last.append
        if len(piece) <= LOOKAHEAD:
            for byte in piece:
                move = get(state | byte)
                if move is None:
                    move = self._step(state, byte)
                state = move >> TOKEN_BITS
                append(move & TOKEN)
            return self._emit(last, len(piece))
        for byte in piece:
            move = get(state | byte)
            if move is None:
                move = self._step(state, byte)
            state = move >> TOKEN_BITS
            last.append(move & TOKEN)
            if len(last) % LOOKAHEAD == 0:
                cut = self._settled(last, state)
                out += self._emit(last, cut)
                last = [-1] + last[cut + 1 :]
        return out + self._emit(last, len(last) - 1)


class Encoder(dict):
    """Text after a single space, up to the next -> its tokens, the space included, as
    little-endian bytes, each piece encoded once.

    The pattern always breaks before a space that a non-space precedes and follows, so such pieces can be
    encoded by themselves. Texts with other white space next to a space are matched as a whole."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.transducer = Transducer(ranks)
        self.older: dict[str, bytes] = {}  # what was met before the younger generation was full
        self.matches = regex.compile(pattern).findall

    def _tokens(self, text: str) -> bytes:
        encode = self.transducer.encode
        ids: list[int] = []
        whole = self.transducer.ranks.get
        for match in self.matches(text):
            match = match.encode()
            token = whole(match)
            if token is None:
                ids += encode(match)
            else:
                ids.append(token)
        return array("I", ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise KeyError(piece)
        value = self.older.get(piece)
        if value is None:
            value = self._tokens(" " + piece)
        if len(piece) <= 64:
            if len(self) >= PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = value
        return value

    def encode(self, text: str) -> bytes:
        """Token ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self._tokens(text)
        try:
            return self._tokens(first) + b"".join(map(self.__getitem__, rest))
        except KeyError:
            return self._tokens(text)


class Utf8Stream:
    """An incremental UTF-8 state machine: bytes in, whole characters out, the unfinished rest held back.
    Bytes that no character can have become U+FFFD."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that begin a character without ending it."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self._unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], tokens: list[bytes]) -> Iterator[str]:
    """Text of the tokens, block by block."""
    machine, block = Utf8Stream(), []
    for token in ids:
        block.append(tokens[token])
        if len(block) == DECODE_BLOCK:
            yield machine.feed(b"".join(block))
            block = []
    yield machine.feed(b"".join(block))
    yield machine.finish()


def decoded(ids: bytes, tokens: list[bytes]) -> Iterator[str]:
    """The same over packed ids, without a Python integer for each that is not yet needed."""
    numbers, machine = np.frombuffer(ids, dtype="<u4"), Utf8Stream()
    for at in range(0, len(numbers), DECODE_BLOCK):
        yield machine.feed(b"".join(map(tokens.__getitem__, numbers[at : at + DECODE_BLOCK].tolist())))
    yield machine.finish()


_built: dict = {}


def _codec(vocabulary, pattern: str) -> tuple[Encoder, list[bytes]]:
    """Encoder and token table of a broadcast vocabulary file, built once in a Python worker."""
    raw = vocabulary.value
    if _built.get("raw") is not raw:
        ranks = read_ranks(raw)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _built.update(raw=raw, codec=(Encoder(ranks, pattern), table))
    return _built["codec"]


def _vocabulary(docs: DataFrame, path: str | None, pattern: str | None):
    """The vocabulary file is of fixed size (under a megabyte), so it is broadcast."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        raw = file.read()
    return docs.sparkSession.sparkContext.broadcast(raw), pattern or public_tokenizers.PATTERN


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_column="doc_id", text_column="text") -> DataFrame:
    """doc_id and the token ids (array of int) of every whole text."""
    vocabulary, pattern = _vocabulary(docs, path, pattern)

    def run(batch: pa.RecordBatch):
        encoder, _ = _codec(vocabulary, pattern)
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids = [np.frombuffer(encoder.encode(text), dtype="<u4").astype(np.int32) for text in part["text"].to_pylist()]
            yield {"doc_id": part["doc_id"], "ids": ids}

    return map_rows(_rows(docs, id_column, text_column), run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None, id_column="doc_id", ids_column="ids") -> DataFrame:
    """doc_id and the text of the token ids."""
    vocabulary, pattern = _vocabulary(tokens, path, None)
    rows = tokens.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(ids_column), F.array().cast("array<int>")).alias("ids"))

    def run(batch: pa.RecordBatch):
        _, table = _codec(vocabulary, pattern)
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield {"doc_id": part["doc_id"], "text": ["".join(decode_stream(ids, table)) for ids in part["ids"].to_pylist()]}

    return map_rows(rows, run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes and decodes every whole text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    vocabulary, pattern = _vocabulary(docs, path, pattern)

    def run(batch: pa.RecordBatch):
        encoder, table = _codec(vocabulary, pattern)
        counts, digests, back = [], [], []
        for text in batch["text"]:
            ids = encoder.encode(text.as_py())
            counts.append(len(ids) // 4)
            digests.append(hashlib.sha256(ids).hexdigest())
            digest = hashlib.sha256()
            for part in decoded(ids, table):
                digest.update(part.encode())
            back.append(digest.hexdigest())
        yield {"doc_id": batch["doc_id"], "n_tokens": counts, "ids_sha256": digests, "decoded_sha256": back}

    return map_rows(_rows(docs, "doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip (decoding gives the text back) of every whole text. A stage among
    others: the codec goes with the task, so that a reused Python worker does not carry it into the next stage."""
    vocabulary, pattern = _vocabulary(docs, path, pattern)

    def coded(batch: pa.RecordBatch):
        encoder, table = _codec(vocabulary, pattern)
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = part["text"].to_pylist()
            packed = [encoder.encode(text) for text in texts]
            yield {
                "doc_id": part["doc_id"], "ids": [np.frombuffer(ids, dtype="<u4").astype(np.int32) for ids in packed],
                "n_tokens": [len(ids) // 4 for ids in packed],
                "round_trip": ["".join(decoded(ids, table)) == text for ids, text in zip(packed, texts, strict=True)],
            }

    schema = "doc_id long, ids array<int>, n_tokens long, round_trip boolean"
    return map_rows(_rows(docs, "doc_id", "text"), coded, schema, _built.clear)
