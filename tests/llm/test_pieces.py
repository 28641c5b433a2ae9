import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from panelwright.llm import pieces
from tests.llm import corpus

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
AWKWARD = [
    "", " ", "  ", "a", " a", "a ", "  a  b ", "▁", "a▁b", "▁▁ x", "x\n\ny\t z\r\n", "héllo 😀 x", "😀", "\0a\0", "﻿ab",
    "a　b c", "<s> hi </s> <0x0A> <unk>", "日本語のテキスト", "x" * 3000, " " * 500 + "end", "é" * 400, "ab" * 700 + " " * 33, "\U0010ffff\x7f",
]


def expected(text):
    ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
    return ids, LIBRARY.decode(ids)


def noise(seed):
    draw = random.Random(seed)
    return "".join(draw.choice("  ▁aeinst.,\n\té😀日th") for _ in range(draw.randrange(200)))


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return pieces.Model(file.read())


def one_by_one(model, text):
    table = pieces._Table(model)
    return model.framed(b"".join(map(table.__getitem__, pieces.chunks(text))))


def test_segmenting_and_decoding_equal_the_library(model):
    for text in AWKWARD + [noise(seed) for seed in range(300)]:
        ids, back = expected(text)
        packed = one_by_one(model, text)
        assert np.frombuffer(packed, dtype="<u4").tolist() == ids, text
        assert b"".join(model.decoded(packed)).decode() == back


def test_a_bounded_table_and_the_heap_change_nothing(model, monkeypatch):
    texts = AWKWARD + [noise(seed) for seed in range(60)]
    plain = [one_by_one(model, text) for text in texts]
    monkeypatch.setattr(pieces, "TABLE_BYTES", 0)
    monkeypatch.setattr(pieces, "SHORT", 0)
    assert [one_by_one(model, text) for text in texts] == plain


def test_decoding_in_small_blocks_and_of_broken_bytes(model, monkeypatch):
    broken = [model.begin, *(model.bytes[b] for b in (0xE6, 0x97, 0xA5, 0xFF, 0xE6, 0x97)), 400, model.end, model.bytes[0xF0]]
    for size in (1, 2, 3, 1 << 16):
        monkeypatch.setattr(pieces, "DECODE_IDS", size)
        for ids in (broken, expected(AWKWARD[11])[0]):
            assert b"".join(model.decoded(np.array(ids, dtype="<u4").tobytes())).decode() == LIBRARY.decode(ids)


def digests(rows):
    result = []
    for doc_id, text in rows:
        ids, back = expected(text)
        result.append((
            doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(),
        ))
    return sorted(result, key=str)


def test_round_trip_over_awkward_documents(spark, monkeypatch):
    rows = corpus.texts() + [(1000 + i, text) for i, text in enumerate(AWKWARD)]
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 4000)  # many blocks: documents of one block meet their own chunks only
    docs = corpus.documents(spark, rows).repartition(3)
    found = pieces.round_trip(docs)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == digests(rows)
    assert pieces.round_trip(corpus.documents(spark, [])).count() == 0


def test_every_distinct_chunk_is_segmented_once(spark):
    docs = spark.createDataFrame([(i, "the same words again and again") for i in range(200)], "doc_id long, text string").coalesce(1)
    table = {row.chunk: row.n_blocks for row in pieces.chunk_table(docs).collect()}
    assert table == {f"▁{word}": 1 for word in ("the", "same", "words", "again", "and")}


def test_encode_then_decode(spark):
    docs = corpus.documents(spark)
    back = {(row.doc_id, row.text) for row in pieces.decode(pieces.encode(docs)).collect()}
    assert back == {(doc_id, expected(text)[1]) for doc_id, text in corpus.texts()}


def test_models_that_chunks_do_not_fit_are_refused(model):
    def field(number, value):
        return bytes([number << 3 | 2, len(value)]) + value

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        raw = file.read()
    with pytest.raises(ValueError, match="crosses"):
        pieces.Model(field(1, field(1, "a▁b".encode())) + raw)
    with pytest.raises(ValueError, match="kind"):
        pieces.Model(raw + field(1, field(1, b"abc") + bytes([3 << 3, 4])))
