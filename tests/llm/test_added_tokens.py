"""Texts that hold an added token's own characters: one id of the library's, as its defaults have it."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandline.llm import packing, token_files
from strandline.llm.tokenize import TextEncoder, tokenizer_path

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|startoftext|>a cat<|endoftext|><|endoftext|>", "x<|EndOfText|> y", "<|endoftext", "<| endoftext |>", "é中 <|endoftext|>\t.", "plain words"]


def library(name, text):
    return Tokenizer.from_file(tokenizer_path(name)).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "keeps_space", "special"), [("byte_bpe_50k.json", True, {50256}), ("word_bpe_49k.json", False, {49406, 49407})])
def test_encoder_keeps_added_tokens(name, keeps_space, special):
    encoder = TextEncoder(tokenizer_path(name), keeps_space)
    for _ in range(2):  # the second time with a full cache
        got = [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(TEXTS)]
        assert got == [library(name, t) for t in TEXTS]
    assert special <= {i for ids in got for i in ids}


def test_operators_keep_added_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    files = {r["doc_id"]: bytes(r["ids"]) for r in token_files.round_trip(docs).collect()}
    assert files == {i: np.array([*library("byte_bpe_50k.json", t), 0], "<u4").tobytes() for i, t in enumerate(TEXTS)}
    packed = {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in packing.packed(docs).collect()}
    want = {i: [*library("word_bpe_49k.json", t), 2] for i, t in enumerate(TEXTS)}
    assert packed == {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in want.items()}
