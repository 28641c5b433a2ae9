"""Words of whole texts as 64-bit hashes, vectorised over many documents; used inside tasks."""

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WINDOW = 1 << 20  # bytes hashed at a time; a longer word widens its window
SLICE = 2 << 20  # bytes of text whose words are held at a time, one document at least
SPACES = bytes([9, 10, 11, 12, 13, 32])

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D  # 5 modulo 8, so that its powers differ in their low bits
_INVERSE = pow(_BASE, -1, 2**64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_powers: dict[int, np.ndarray] = {}
MULTIPLIERS = _RNG.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, count: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < count:
        steps = np.full(max(count, WINDOW + 1), base, dtype=np.uint64)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known[:count]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all 64."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _window_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.concatenate(([True], _IS_SPACE[raw], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * powers(_BASE, len(raw)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(_INVERSE, len(raw) + 1)[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64)), starts, ends


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes within all texts joined by line breaks) of every lower-cased word,
    and the index of each text's first word, with the number of words at the end."""
    joined = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    parts, at = [], 0
    while at < len(joined):
        end = min(at + WINDOW, len(joined))
        back = np.flatnonzero(_IS_SPACE[joined[max(at, end - 4096) : end]])
        if len(back):
            end = max(at, end - 4096) + int(back[-1]) + 1
        else:
            rest = np.flatnonzero(_IS_SPACE[joined[at:]])
            inside = rest[rest < end - at]
            end = at + int(inside[-1] if len(inside) else rest[0]) + 1
        hashes, starts, ends = _window_words(joined[at:end])
        parts.append((hashes, starts + at, ends + at))
        at = end
    hashes, starts, ends = (np.concatenate(column) for column in zip(*parts, strict=True))
    begins = np.cumsum([0] + [len(text) + 1 for text in texts])
    return hashes, starts, ends, np.searchsorted(starts, begins)


def sequences(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of `length` consecutive words, in order."""
    count = max(len(hashes) - length + 1, 0)
    total = np.full(count, length, dtype=np.uint64)
    for i in range(length):
        total = total + hashes[i : i + count] * MULTIPLIERS[i % 16]
        if i % 16 == 15:
            total = mixed(total)
    return mixed(total)


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together hold about SLICE bytes."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def encoded(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def struct_of(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def release() -> None:
    """Gives memory that is no longer used back to the system: garbage in cycles, Arrow's pool, and free pages of malloc where
    the C library can (glibc). Spark reuses Python workers, and an idle one would keep it through the next stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run):
    """The function over batches, with `release` when its task ends."""

    def released(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return released


def map_rows(df: DataFrame, function, schema: str, at_end=None) -> DataFrame:
    """`function` takes an Arrow batch and yields dictionaries of columns; `at_end` is called when the task ends."""
    struct = struct_of(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for columns in function(batch):
                    made = (columns[field.name] for field in arrow)
                    yield pa.RecordBatch.from_arrays(
                        [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(made, arrow, strict=True)],
                        schema=arrow,
                    )
        if at_end is not None:
            at_end()

    return df.mapInArrow(releasing(run), struct)


def listed(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)
