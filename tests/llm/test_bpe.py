from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from faultline.llm import bpe, queries

from .conftest import NASTY, table


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_file()


@pytest.fixture(scope="module")
def library(path):
    return Tokenizer.from_file(path)


def test_encoder_matches_library(path, library, sample):
    texts = [t or "" for t in NASTY] + [t for _, t in sample]
    flat, sizes = bpe.Encoder(bpe.vocabulary(path)).encode(texts)
    got = [ids.tolist() for ids in np.split(flat, np.cumsum(sizes)[:-1])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_random_words_match_library(path, library):
    rng = random.Random(7)
    texts = ["".join(rng.choices("aeinrst'é \n09!ß", k=rng.randrange(60))) for _ in range(3000)]
    flat, sizes = bpe.Encoder(bpe.vocabulary(path)).encode(texts)
    got = [ids.tolist() for ids in np.split(flat, np.cumsum(sizes)[:-1])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_short_character_matches_library(path, library):
    # Some capitals below U+0250 lower to characters above it, or to three bytes.
    texts = [form.format(chr(c)) for c in range(0x250) for form in ("{0}", "a{0}b {0}1{0}", "x {0} y", "12{0}'s")]
    texts += ["İstanbul ve Ankara", "Əliyev", "Ƙasar Ɗan", "Ⱥb Ⱦc dȺ"]
    flat, sizes = bpe.Encoder(bpe.vocabulary(path)).encode(texts)
    got = [ids.tolist() for ids in np.split(flat, np.cumsum(sizes)[:-1])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_transducer_numbers_its_words_and_shares_suffixes():
    words = sorted(a.encode() + b.encode() for a, b in itertools.product(("walk", "talk", "é"), ("", "s", "ed", "ing")))
    walk = bpe.Transducer.of(words)
    probe = [*words, b"wal", b"walkings", b"zz"]
    rows = np.frombuffer(b"".join(w.ljust(24, b"\0") for w in probe), np.uint8).reshape(-1, 24)
    numbers = walk.numbers(rows, np.array([len(w) for w in probe]))
    assert numbers.tolist() == [*range(len(words)), -1, -1, -1]
    assert len(walk.final) < len({w[:n] for w in words for n in range(len(w) + 1)})


def test_query_matches_library(spark, path, library, tmp_path):
    texts = [*NASTY, *NASTY]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op1_bpe_transducer"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["op1_bpe_transducer"](spark, str(tmp_path)).count() == 0
