"""Strings of added tokens in texts: the queries give the ids of the library as it is, nothing set."""

from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from segline.llm import queries

TEXTS = ["plain words", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b  <|startoftext|>", "x--<|endoftext|>--", "<|ENDOFTEXT|> <|StartOfText|>", "<|endoftext", "|> <|", "é <|startoftext|>\n<|endoftext|> \n", "", "last one"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("added"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def ids_of(name, end_id):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*library.encode(t, add_special_tokens=False).ids, end_id], "<u4") for t in TEXTS]


def test_token_files_take_added_tokens_as_the_library(spark, folder):
    want, at = [], 0
    for doc, ids in enumerate(ids_of("word_bpe_49k.json", 1)):
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op8_token_planes(spark, folder).collect())) == want


@pytest.mark.parametrize("run", [queries.op10_best_fit_packing, lambda spark, path: corpus_pipeline.packing(spark, spark.read.parquet(f"{path}/documents.parquet"), path)])
def test_packing_takes_added_tokens_as_the_library(spark, folder, run):
    want = [(doc, 0, 0, len(ids), zlib.crc32(ids.tobytes())) for doc, ids in enumerate(ids_of("byte_bpe_50k.json", 2))]
    assert sorted(tuple(r)[:5] for r in run(spark, folder).collect()) == want
