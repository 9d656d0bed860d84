"""The operators' cores without a session: against brute force, libraries and exact round trips."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from patchloom.llm import _text as X
from patchloom.llm import bpe, chunks, embeddings, language_model, minhash, warc

RNG = random.Random(3)
WORDS = ["the", "of", "Über", "日本", "x1", "end.", "a", "licensed"]
TEXTS = ["", "one", "A b\tC\nd", " ".join(RNG.choices(WORDS, k=900)), "x" * 3000, "é é", *(" ".join(RNG.choices(WORDS, k=RNG.randint(0, 30))) for _ in range(60))]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_words_and_shingles():
    arr = pa.array([*TEXTS, None])
    for limit in (64, 1 << 20):
        got, sizes = [], []
        for _, _, data, off in X.slices(arr, limit):
            w = X.words(data, off)
            got += [[w.word(k).decode() for k in range(a, b)] for a, b in zip(w.first, w.first[1:])]
            sizes += np.diff(X.shingle_sets(data, off)[1]).tolist()
        want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for t in [*TEXTS, None]]
        assert got == want
        assert sizes == [len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) > 4 else int(bool(w)) for w in want]


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)
    both = np.concatenate([a, b])
    r = minhash.registers(np.concatenate([a, b, both]), np.array([0, 900, 1200, 2400]))
    assert (np.maximum(r[0], r[1]) == r[2]).all()
    assert abs((r[0] == r[2]).mean() - 0.75) < 0.12
    assert minhash.may_reach(r[:1], r[2:], np.array([900]), np.array([1200]), 0.75)[0] and not minhash.may_reach(r[:1], r[1:2], np.array([900]), np.array([300]), 0.75)[0]


def test_gear_cuts_resist_shifts():
    body = np.frombuffer("".join(RNG.choices("abcdefgh ", k=5000)).encode(), np.uint8)
    cut = chunks.cuts(body)
    assert np.diff(cut).max() <= chunks.SPREAD + chunks.SHIFT and cut[0] == 0 and cut[-1] == 5000
    shifted = chunks.cuts(np.concatenate([np.frombuffer(b"inserted", np.uint8), body])) - 8
    far = set(cut[cut > 200].tolist())
    assert far <= set(shifted.tolist())
    h = chunks.gear(body)
    k = 777
    assert int(h[k]) == sum(int(chunks._GEAR[body[k - j]]) << j for j in range(32)) % 2**32
    wide = np.frombuffer(("日本語テキスト" * 200).encode(), np.uint8)
    assert all(wide[c] & 0xC0 != 0x80 for c in chunks.cuts(wide)[:-1])


def test_bpe_equals_the_library():
    P, T = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    lib, own = T.Tokenizer.from_file(path), bpe.Bpe(open(path, encoding="utf-8").read())
    bits = [*"abst're  \n\t\r1²½é日ß.!-_\x85\xa0\u3000\x1c😀", "'s", "'re", "'Ll", " '", "<|endoftext|>"]
    texts = [*TEXTS, "ab" * 900, "<|endoftext|>", "<|endof", "text|>", "'s", *("".join(RNG.choices(bits, k=RNG.randint(0, 40))) for _ in range(800))]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    got, back = [], []
    for _, _, data, off in X.slices(pa.array(texts), 4096):
        ids, at = own.encode(data, off)
        got += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
        back += own.decode(ids, at)
    assert got == want and [t.encode() for t in texts] == back
    assert own.merged, "some words went through exact merging"


def test_traversal_is_in_order():
    rng = np.random.default_rng(2)
    d1, d2 = rng.random((7, 9)), rng.random((7, 11))
    got = embeddings.traverse(d1, d2, 20)
    for k in range(7):
        want = sorted(itertools.product(range(9), range(11)), key=lambda c: d1[k, c[0]] + d2[k, c[1]])[:20]
        assert got[k].tolist() == [i * 11 + j for i, j in want]


def test_seating_keeps_customers():
    rng = np.random.default_rng(4)
    counts, prior = np.array([1, 5, 300, 0, 2]), np.full(5, 0.2)
    s = language_model.Seating(counts, 0.5, prior, rng)
    for _ in range(5):
        s.sweep(prior)
        assert (np.bincount(s.dish, s.size, 5) == counts).all() and (s.size > 0).all() and (np.diff(s.dish) >= 0).all()
    served = language_model._served(counts, s.tables(), 0.5, prior)
    assert served.sum() == pytest.approx(1) and served.argmax() == 2 and served[3] > 0


def test_warc_parsing():
    body = b"a\r\n\r\nWARC/1.1 b"
    raw = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    got = list(warc.parse(raw * 2 + b"junk"))
    assert len(got) == 3 and bytes(got[1][1]) == body and got[0][0][0] == ("warc-type", "resource") and got[2][2] == "4 bytes that are no record"
    import gzip

    both, error = warc._inflated(gzip.compress(raw) + gzip.compress(raw))
    assert list(warc.parse(both))[1][0] == got[0][0] and error is None and list(warc.parse(b"")) == []


def test_tables_of_many_customers():
    """Numbers of tables agree with seating customer by customer, and are not held down for high counts."""
    d, prior, rng = 0.6, 0.03, np.random.default_rng(6)
    for n in (3, 12, 150):
        chain, seen = language_model.Seating(np.array([n]), d, np.array([prior]), rng), []
        for _ in range(400 if n < 100 else 60):
            chain.sweep(np.array([prior]))
            seen.append(chain.tables()[0])
        one = np.ones(4000)
        got = language_model.tables(np.full(4000, n), d * one, language_model.STRENGTH * prior * one, d * prior * one, rng.integers(0, 2**63, 4000).astype(np.uint64))
        assert got.min() >= 1 and got.max() <= n and got.mean() == pytest.approx(np.mean(seen), rel=0.15), n
    few = np.ones(5)
    many = language_model.tables(np.full(5, 125_000), d * few, (1 + d * 20_000) * prior * few, d * prior * few, np.arange(5, dtype=np.uint64))
    assert (many > 1500).all() and (many < 3500).all()
