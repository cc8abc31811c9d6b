"""Token files and packing: the same ids as from the tokenizers library, exact round trips, full use of sequences."""

import random
import tempfile
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from helpers import CLASHES, ODD, docs, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clarion.llm import packing, tokenfiles, tokens

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
HARD = ODD + [
    "don't  stop\n\n now\t\tthen  ", " lead", "trail ", " nbsp em", "a\u0085b", "1,234.50€ 'll 've", "é éx ́a", "İstanbul ΣΑΣ ς", "日本語 テキスト  です", "\r\n\r\n", "x​y",
    "word's   'S I'M", "﻿bom", "A<|startoftext|>B",
]


@pytest.mark.parametrize("path, pieces", [(BYTE, tokens.SPACED), (WORD, tokens.WORDS)])
def test_pieces_encode_as_whole_texts(path, pieces):
    rng = random.Random(2)
    t = Tokenizer.from_file(path)
    alphabet = ["a", "Z", "é", "ß", " ", "  ", "\n", "\t", "'", "'s", "9", "12", ".", "…", " ", "漢", "👍🏽", "́", "-", "_"]
    texts = [x for x in HARD if x] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(1500)]
    mine = tokens.Encoder(path, pieces)
    for x in texts:
        assert np.frombuffer(mine.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_files_hold_all_ids_in_order(spark):
    rng = random.Random(4)
    texts = HARD + [words(rng, 50) for _ in range(60)]
    ids = rng.sample(range(1000), len(texts))
    t = Tokenizer.from_file(BYTE)
    path = tempfile.mkdtemp(prefix="spark-") + "/tokens"
    got = {r.doc_id: r for r in tokenfiles.tokenized(docs(spark, texts, ids, extra=CLASHES), BYTE, path).collect()}
    start = 0
    for i, x in sorted(zip(ids, texts)):
        want = np.array((t.encode(x, add_special_tokens=False).ids if x else []) + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    few = tokenfiles.select(spark, path, F.col("doc_id") == ids[30]).collect()
    assert len(few) == 1 and few[0]["ids"][-1] == 2
    assert tokenfiles.lengths(spark, path).agg(F.sum("n_tokens")).first()[0] == start
    plan = tokenfiles.lengths(spark, path)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:int>" in plan
    assert tokenfiles.tokenized(docs(spark, []), BYTE).count() == 0


def test_layout_of_files(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/tokens"
    tokenfiles.write(docs(spark, ["a few words here"] * 3000), path, BYTE)
    import pathlib

    seen = defaultdict(set)
    for f in pathlib.Path(path).glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                seen[col.path_in_schema] |= set(col.encodings)
                assert col.has_column_index or col.path_in_schema.startswith("ids")
    ids = next(v for k, v in seen.items() if k.startswith("ids"))
    assert ids & {"RLE_DICTIONARY", "PLAIN_DICTIONARY"}
    assert "DELTA_BINARY_PACKED" in seen["doc_id"] and "DELTA_BINARY_PACKED" in seen["n_tokens"]


def packed(spark, texts, size=4096, **options):
    got = packing.pack_documents(docs(spark, texts, **options), WORD, size=size).collect()
    t = Tokenizer.from_file(WORD)
    want = {}
    for i, x in enumerate(texts):
        a = np.array((t.encode(x, add_special_tokens=False).ids if x else []) + [1], "<u4")
        for k, s in enumerate(range(0, len(a), size)):
            p = a[s : s + size]
            want[i, k] = (s, len(p), zlib.crc32(p.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    return len(places), sum(n for _, n, _ in want.values())


def test_pieces_fill_sequences(spark):
    rng = random.Random(6)
    texts = HARD + [words(rng, rng.randrange(1, 120)) for _ in range(400)]
    used, total = packed(spark, texts, size=256, extra=CLASHES)
    assert used <= 1.02 * total / 256 + 1
    assert packing.pack_documents(docs(spark, []), WORD).count() == 0


def test_plan_uses_every_length_as_often_as_given():
    rng = np.random.default_rng(7)
    counts = np.zeros(513, np.int64)
    for n in np.clip(rng.lognormal(4, 1, 5000).astype(int), 1, 512):
        counts[n] += 1
    used = np.zeros(513, np.int64)
    sequences = 0
    for repeats, parts in packing.plan(counts):
        assert sum(n * k for n, k in parts) <= 512
        sequences += repeats
        for n, k in parts:
            used[n] += repeats * k
    assert (used == counts).all()
    assert sequences <= 1.01 * (counts * np.arange(513)).sum() / 512 + 1


def test_fit_is_non_negative_least_squares():
    choices = [(5, 3), (4, 4), (3, 3, 2), (6, 2)]
    counts = np.array([0, 0, 7, 16, 10, 5, 3, 0, 0.0])
    x = packing.fit(choices, counts)
    a = np.zeros((9, len(choices)))
    for p, c in enumerate(choices):
        for n in c:
            a[n, p] += 1
    slope = a.T @ (a @ x - counts)
    assert (x >= 0).all() and (slope > -1e-3).all() and np.abs(slope[x > 1e-6]).max() < 1e-3


@pytest.mark.parametrize("path, pieces", [(BYTE, tokens.SPACED), (WORD, tokens.WORDS)])
def test_long_texts_go_through_in_slices(monkeypatch, path, pieces):
    """Texts beyond a slice, pieces beyond a call, and a memory that is full give the same ids."""
    monkeypatch.setattr(tokens, "SLICE", 500)
    monkeypatch.setattr(tokens, "CALL", 40)
    monkeypatch.setattr(tokens, "REMEMBERED", 25)
    rng = random.Random(5)
    texts = [words(rng, n, 300) for n in (3, 2000, 40, 40, 700)] + HARD + ["x" * 3000, None, "one\n\ntwo \n three  four"]
    texts += texts[:4]
    t = Tokenizer.from_file(path)
    mine = tokens.Encoder(path, pieces)
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in mine.encode_all(texts)]
        assert got == [t.encode(x, add_special_tokens=False).ids if x else [] for x in texts]
        assert len(mine.known) <= 25


def test_fitted_patterns_place_most_pieces():
    """On a histogram of many pieces the fit does the work, sequences are full, and every piece has one place."""
    rng = np.random.default_rng(2)
    lengths = np.clip(rng.lognormal(6.3, 0.8, 40_000).astype(int), 1, 4096)
    counts = np.bincount(lengths, minlength=4097)
    choices = packing.patterns(counts)
    assert all(sum(c) == 4096 and all(counts[n] for n in c) and len(c) <= packing.DOCUMENTS for c in choices)
    assert any(len(c) > 3 for c in choices)
    x = np.rint(packing.fit(choices, counts))
    assert sum(len(c) * k for c, k in zip(choices, x)) > 0.5 * len(lengths)
    made = packing.plan(counts)
    used = np.zeros(4097, np.int64)
    for repeats, parts in made:
        assert sum(n * k for n, k in parts) <= 4096
        for n, k in parts:
            used[n] += repeats * k
    assert (used == counts).all()
    assert sum(r for r, _ in made) <= -(-int(lengths.sum()) // 4096) + 1


def test_token_files_remember_more_pieces_than_other_encoders():
    assert tokenfiles.REMEMBERED > tokens.REMEMBERED and tokenfiles.LAYOUT["parquet.compression.codec.zstd.level"] == "1"
