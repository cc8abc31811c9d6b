"""Mixture packing against a token-by-token round robin, the plain tokenizer and the target proportions."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import CLASHES, ODD, docs, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clarion.llm import mixture, packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def turns(totals, weights, window):
    """The order of service, token by token: every window each queue's credit grows by its quantum, whole tokens are taken."""
    done, credit, out = [0] * len(totals), [0] * len(totals), []
    fresh = True
    while any(d < t for d, t in zip(done, totals)):
        if fresh:
            share = [w if d < t else 0 for w, d, t in zip(weights, done, totals)]
            quanta = [max(1, int(np.rint(s / sum(share) * window * mixture.UNIT))) if s else 0 for s in share]
            credit, fresh = [0] * len(totals), False
        for q, quantum in enumerate(quanta):
            credit[q] += quantum
            while credit[q] >= mixture.UNIT and done[q] < totals[q]:
                out.append((q, done[q]))
                done[q] += 1
                credit[q] -= mixture.UNIT
            fresh |= quantum > 0 and done[q] == totals[q]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_closed_form_is_the_round_robin(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 7)
    totals = [rng.randrange(0, 900) for _ in range(n)]
    weights = [t / max(1, sum(totals)) for t in totals] if seed % 2 else [rng.random() + 0.01 for _ in range(n)]
    window = rng.choice([7, 64, 500])
    order = {token: place for place, token in enumerate(turns(totals, weights, window))}
    rounds = mixture.Rounds(totals, weights, window)
    for q, total in enumerate(totals):
        p = 0
        while p < total:
            m = min(total - p, rng.randrange(1, 200))
            runs = rounds.runs(q, p, m)
            assert [at for at, _, _ in runs] == [0, *np.cumsum([k for _, k, _ in runs])[:-1].tolist()] and sum(k for _, k, _ in runs) == m
            assert all(order[q, p + at + i] == place + i for at, k, place in runs for i in range(k))
            assert all(a[2] + a[1] != b[2] for a, b in zip(runs, runs[1:]))
            p += m


@pytest.mark.parametrize("total", [0, 1, 5, 63, 64, 65, 127, 200, 1000])
def test_sequences_are_full_or_powers_of_two(total):
    s = mixture.Sequences(total, 64)
    sizes = defaultdict(int)
    for take, k, offset in s.cuts(0, total):
        assert sizes[k] == offset
        sizes[k] += take
    assert sum(sizes.values()) == total and sorted(sizes) == list(range(len(sizes)))
    assert all(n == 64 or k >= total // 64 and n & (n - 1) == 0 for k, n in sizes.items())


def check(df, got, size):
    plain = Tokenizer.from_file(BYTE)
    plain.encode_special_tokens = False
    ids = defaultdict(list)
    for r in df.collect():
        ids[r.doc_id].append([*plain.encode(r.text or "", add_special_tokens=False).ids, 1])
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length, r.queue))
    assert pieces.keys() == ids.keys()
    for d, own in ids.items():
        if len(own) > 1:
            continue  # repeated ids: their pieces can't be told apart
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            raw = np.array(own[0][at : at + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(raw), len(own[0]))
            at += r.length
        assert at == len(own[0])
    total = sum(len(x) for own in ids.values() for x in own)
    assert sum(r.length for r in got) == total
    for k, parts in sequences.items():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at == size or k >= total // size and at & (at - 1) == 0
    return sequences


def test_pieces_are_the_tokens_and_windows_have_their_proportions(spark):
    rng = random.Random(3)
    texts = ODD + [words(rng, rng.choice([3, 40, 900]), 500) for _ in range(300)]
    df = docs(spark, texts).withColumn("source", F.expr("case when doc_id % 3 > 0 then 'hot' when doc_id % 2 = 0 then null else concat('s', doc_id % 5) end")).repartition(7)
    size, window = 64, 64 * 8
    got = mixture.pack_mixture(df, BYTE, size=size, window=window).collect()
    sequences = check(df, got, size)
    share = defaultdict(int)
    for r in got:
        share[r.queue] += r.length
    total = sum(share.values())
    for w in range(total // window - 1):
        held = defaultdict(int)
        for k in range(w * 8, w * 8 + 8):
            for _, n, q in sequences[k]:
                held[q] += n
        # A window of the stream lies in two of the schedule's, as those may miss it by some tokens.
        assert all(abs(held[q] - n / total * window) <= 0.1 * window for q, n in share.items())
    # Few cuts: one at each end of a queue's turn and of a sequence.
    assert len(got) <= df.count() + total // size + total // window * (len(share) + 1) + 20


def test_targets_of_their_own(spark):
    """A source with a higher weight is used up earlier; then the others share the windows anew."""
    df = docs(spark, ["one two three four five six seven eight nine ten"] * 400).withColumn("source", F.when(F.col("doc_id") < 200, "a").otherwise("b"))
    got = mixture.pack_mixture(df, BYTE, weights={"a": 3.0, "b": 1.0}, size=32, window=320).collect()
    check(df, got, 32)
    early = defaultdict(int)
    for r in got:
        if r.sequence_id < 30:
            early[r.queue] += r.length
    assert abs(early["a"] / early["b"] - 3) < 0.1
    with pytest.raises(ValueError):
        mixture.pack_mixture(df, BYTE, weights={"a": 0.0})


def test_small_sources_share_a_queue_and_large_tables_take_the_other_join(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BROADCAST_ROWS", 0)
    df = docs(spark, [f"text number {k} of the small sources" for k in range(1500)]).withColumn("source", F.concat(F.lit("s"), F.col("doc_id"))).repartition(5)
    got = mixture.pack_mixture(df, BYTE, size=128).collect()
    check(df, got, 128)
    assert {r.queue for r in got} == {"(rest)"}


def test_empty_and_odd_tables(spark):
    assert mixture.pack_mixture(docs(spark, []), BYTE).count() == 0
    df = docs(spark, [*ODD, None, ""], ids=[*range(len(ODD)), None, 3], extra=CLASHES)
    got = mixture.pack_mixture(df, BYTE, size=256)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"]
    check(df, got.collect(), 256)
    # The plain packing gives the same ids of uncut documents.
    whole = {(r.doc_id, r.length): r.ids_crc32 for r in packing.pieces(df, BYTE, size=10**9, split=None).collect()}
    assert all(whole[r.doc_id, r.length] == r.ids_crc32 for r in got.collect() if r.length == r.doc_tokens and r.doc_id != 3)
