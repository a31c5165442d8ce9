"""Packing and byte-pair encoding against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quadmill.llm import bpe, packing

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n \t", "a", "It's the dog's  café,  we'll\tSEE\r\n42!! 12345", "<|endoftext|>x <|endoftext|>", "a<|startoftext|>b",
    " x　y  z\x1c\x1d q\x85", "é ́ Å ﬁ İstanbul ΟΔΟΣ Σ", "日本語 テスト 中文" * 9, "🙂👍🏽 x", "x" * 5000, "ab " * 3000, "\x00\x01 \x7f", "don't 'S 'll", "   lead", "trail   ", "a\n\n\nb   c \n d", "½ ² ٣ Ⅷ", "﻿bom", "word̀", "_under_score__", "###***$$$",
]


def texts(spark, sf):
    rng = random.Random(5)
    pieces = ["the", "a", " ", "  ", "\n", "é", "ñ", "ß", "'s", "1", "!!", "\t", " ", "Über", "|", "<|endoftext|>", "漢"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    real = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    return ODD + made + real


def frame(spark, all_texts):
    return spark.createDataFrame([(i, t, "en", "clash", "clash") for i, t in enumerate(all_texts)], "doc_id long, text string, lang string, ids string, decoded string")


def test_bpe_equals_the_library(spark, sf):
    library = Tokenizer.from_file(BYTE)
    library.no_truncation()
    library.no_padding()
    all_texts = texts(spark, sf)
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark, all_texts), BYTE).collect()}
    for i, t in enumerate(all_texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids, t
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False), t


def test_a_long_part_takes_time_in_proportion():
    coder = bpe.coder(BYTE)
    assert coder.decode(coder.encode("ab" * 50_000)) == "ab" * 50_000


def test_packing(spark, sf):
    library = Tokenizer.from_file(WORD)
    all_texts = texts(spark, sf)
    rows = packing.pack(frame(spark, all_texts), WORD).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(all_texts)}
    pieces, sequences = {}, {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        data = np.array(own, "<u4").tobytes()
        assert r.ids == data and r.ids_crc32 == zlib.crc32(data)
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for i, own in pieces.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == len(ids[i])
    filled = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        filled += at
    assert filled / (2048 * len(sequences)) > 0.98


def test_packing_of_nothing_and_of_repeated_rows(spark):
    none = frame(spark, [None]).limit(0)
    assert packing.pack(none, WORD).count() == 0
    twice = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, None)], "doc_id long, text string")
    rows = packing.pack(twice, WORD).collect()
    assert sum(r.length for r in rows) == 7 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


@pytest.mark.parametrize("length", [1, 2, 45, 46, 682, 683, 1023, 2047, 2048, 2049, 100_000])
def test_cuts_are_classes(length):
    classes = packing.class_lengths(2048)
    cut = packing.piece_lengths(length, 2048, classes)
    assert sum(cut) == length and set(cut) <= set(classes.tolist())
