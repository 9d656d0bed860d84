"""Vector codes, files of token ids and alignments against plain versions in unbounded whole numbers and by the libraries."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from patchloom.llm import align, codes, tokenfile
from patchloom.llm._store import Scratch

P = pytest.importorskip("public_tokenizers")
VOCABULARY, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
VECTORS = "vec_id long, embedding array<double>, label int, part string, error string, code int"


def plain_codes(rows, rounds=codes.ROUNDS):
    """(vec_id, code, error, label_error, digest) by the definition, one component at a time."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 8) * 8
    clip = lambda x: min(2**63 - 1, max(-(2**63), x))
    ints = [[clip(math.floor(4096 * x) if abs(x) < 1e300 else math.floor(x)) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    size = width // 8
    parts = [[v[p * size : (p + 1) * size] for v in ints] for p in range(8)]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, np.array(ints[k], "<i4" if max(map(abs, ints[k]), default=0) < 2**31 else "<i8").tobytes()))[:16]
    books = [[parts[p][k] for k in first] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        own = [[min(range(len(books[p])), key=lambda j, p=p, x=x: (far(x, books[p][j]), j)) for x in parts[p]] for p in range(8)]
        if turn < rounds:
            for p in range(8):
                for j in set(own[p]):
                    mine = [x for x, o in zip(parts[p], own[p], strict=True) if o == j]
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    errors = [clip(sum(far(parts[p][k], books[p][own[p][k]]) for p in range(8))) for k in range(len(kept))]
    of = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        of[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{own[p][k]:02x}" for p in range(8)), errors[k], clip(of[label]), digest) for k, (i, _, label) in enumerate(kept))


def coded(spark, rows):
    got = codes.op11(spark.createDataFrame([(i, v, label, "p", "e", 1) for i, v, label in rows], VECTORS)).collect()
    return Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got)


def test_codes(spark):
    rng = random.Random(5)
    rows = [(k * 3 % 70, [rng.gauss(0, 0.3) for _ in range(16)], k % 4 if k % 5 else None) for k in range(70)]
    rows += [(100, None, 1), (101, [math.nan] * 16, 1), (102, [math.inf] * 16, 1), (103, [None] + [0.0] * 15, 1), (104, [0.0] * 16, 1), (105, [-1e-9] * 16, 9)]
    rows += [(7, rows[3][1], 2), (106, rows[3][1], 2), (None, [0.25] * 16, None)]
    assert coded(spark, rows) == plain_codes(rows)
    assert coded(spark, []) == Counter()
    few = rows[:5]
    assert coded(spark, few) == plain_codes(few)


def test_codes_of_odd_lengths_and_sizes(spark):
    rng = random.Random(6)
    rows = [(k, [rng.choice([-1.0, 0.0, 0.5, 1e6]) for _ in range(rng.choice([9, 12]))], None) for k in range(40)]
    assert coded(spark, rows) == plain_codes(rows)
    rows += [(50, [1e200, -1e308] + [0.0] * 8, 1), (51, [1e12] * 10, 2), (52, [3e14, -3e14] + [1.0] * 8, 2), (53, [], 3), (54, [1e-200] * 10, 3)]
    assert coded(spark, rows) == plain_codes(rows)


def test_screening_keeps_the_nearest():
    rng = np.random.default_rng(4)
    for size in (1, 3, 8, 100):
        for scale in (3, 4096, 1 << 25, 1 << 40):
            c = rng.integers(-scale, scale, (16, size))
            x = c[rng.integers(0, 16, 300)] + rng.integers(-2, 3, (300, size))
            want = [min(range(16), key=lambda j, v=v: (sum((a - b) ** 2 for a, b in zip(v, c[j].tolist(), strict=True)), j)) for v in x.tolist()]
            assert codes.nearest(x, c).tolist() == want
            if 8 <= size and scale == 4096:
                assert codes.candidates(x, c).sum(1).mean() < 2  # most entries are screened out


TEXTS = [
    (3, "Hello world, it's 2 o'clock.  \n\n x"), (1, None), (2, ""), (9, "été <|endoftext|> 中文 \U0001f600 <s> </s> <0x41>"), (3, "Hello world, it's 2 o'clock.  \n\n x"), (3, "another text of the same id"),
    (None, "no id"), (5, " leading and   many   spaces\t\ttabs"), (6, "a▁b"), (7, "x" * 3000 + " " + "word " * 4000), (8, "Ａﬁ wide"), (4, "one two one two one two three"), (10, "\x00\x01 \x7f\r\n"),
]
DOCS = "doc_id long, text string, n int, k string, row int, pair int, frame int"


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, 1, "k", 2, 3, 4) for i, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)


def test_token_files(spark, texts, library):
    got = tokenfile.op12(texts, VOCABULARY).collect()
    ids = Counter()
    for i, t in TEXTS:
        x = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        ids[i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == ids
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is None, i or 0))
    assert tokenfile.op12(texts.limit(0), VOCABULARY).count() == 0


def test_one_document_is_read_by_its_offset(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_BYTES", 4000)
    rows = [(k, f"document {k} says hello to document {k * 7 % 300} and nothing else, number {k}") for k in range(300)]
    docs, scratch = spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")
    path = "file://" + str(tmp_path / "tokens")
    tokenfile.write(docs, path, VOCABULARY, None, scratch)
    assert {r["doc_id"]: r["token_ids"] for r in tokenfile.read(spark, path).collect()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}
    some = tokenfile.read(spark, path, [7, 250, 999]).collect()
    assert sorted((r["doc_id"], r["token_ids"]) for r in some) == [(i, library.encode(rows[i][1], add_special_tokens=False).ids) for i in (7, 250)]
    where = tokenfile.index(spark, path).where("doc_id = 250").collect()
    assert len(where) == 1 and tokenfile.index(spark, path).select("number").distinct().count() >= 3
    dictionary, width = tokenfile._frames(spark, path)
    assert dictionary and width == 2
    frames, at = tokenfile.Frames(dictionary, width), where[0]
    raw = open(at["path"].removeprefix("file:"), "rb").read()
    assert frames.unpack(raw[at["begin"] : at["end"]]).tolist() == library.encode(rows[250][1], add_special_tokens=False).ids
    for bad in (raw[:-9], b"x" + raw[1:], raw[:40]):
        with pytest.raises(tokenfile.Damaged):
            tokenfile.File(bad, frames)
    with pytest.raises(tokenfile.Damaged):
        tokenfile.File(raw, tokenfile.Frames(b"", width))


def test_white_space_beyond_the_pattern(spark, library):
    text = " " * 1_200_000 + "x"
    r = tokenfile.op12(spark.createDataFrame([(1, text)], "doc_id long, text string"), VOCABULARY).collect()[0]
    assert r["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids) + 1


def plain_alignment(rows):
    from tokenizers import Tokenizer

    import sentencepiece

    a = Tokenizer.from_file(VOCABULARY)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = {c: bytes([v]) for c, v in align.ByteLevel.__init__.__globals__["_byte_letters"]().items()}
    out, counts = [], Counter()
    for i, t in rows:
        ia = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ib = b.encode(t) if t else []
        ba = [b"".join(letters[c] for c in a.id_to_token(x)) for x in ia]
        bb = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ib]
        if not t or b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            out.append((i, [], [], [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        links = [(x, y) for x, e, n in zip(ia, ea, map(len, ba), strict=True) for y, f, m in zip(ib, eb, map(len, bb), strict=True) if e - n < f and f - m < e] if len(ia) < 3000 else None
        if links is None:  # the long text: by two pointers
            links, k = [], 0
            for x, e, n in zip(ia, ea, map(len, ba), strict=True):
                while eb[k] <= e - n:
                    k += 1
                j = k
                while j < len(ib) and eb[j] - len(bb[j]) < e:
                    links.append((x, ib[j]))
                    j += 1
        both, groups, p, q = sorted(set(ea) & set(eb)), [], 0, 0
        for cut in both:
            u, v = ea.index(cut, p) + 1, eb.index(cut, q) + 1
            groups.append(",".join(map(str, ia[p:u])) + "|" + ",".join(map(str, ib[q:v])))
            p, q = u, v
        counts.update(links)
        out.append((i, ia, ib, groups, links))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    rows = Counter()
    for i, ia, ib, groups, links in out:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if ia else ""
        rows[i, len(ia), len(ib), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), digest] += 1
    return rows, counts, top


@pytest.mark.parametrize("common", [align.COMMON, 6, 0])
def test_alignment(spark, texts, common):
    want, counts, top = plain_alignment(TEXTS)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r[n] for n in names) for r in align.op13(texts, VOCABULARY, PIECES, common).collect()) == want
    assert any(r[1] == 0 and r[0] in (6, 8) for r in want) and align.op13(texts.limit(0), VOCABULARY, PIECES).count() == 0
    if common == 6:
        both = align.Alignment(spark, VOCABULARY, PIECES)
        pairs = both.pairs(both.texts(texts))
        assert {(r["pair"] // both.width, r["pair"] % both.width): r["n"] for r in pairs.collect()} == counts
        assert {r["b"]: (r["a"], r["n"]) for r in both.mapping(pairs).collect()} == {b: (min(x for x, y in counts if y == b and counts[x, y] == n), n) for b, n in top.items()}


def test_alignment_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r[n] for n in names) for r in align.op13(docs, VOCABULARY, PIECES).collect()) == plain_alignment(rows)[0]
