"""Each operator on small tables with nulls, empty and very long texts, repeated rows and extra columns."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from patchloom.llm import bpe, chunks, components, decontaminate, embeddings, language_model, licenses, minhash, quality, toxicity, warc
from patchloom.llm._store import Scratch

from ..conftest import DATA, same_rows

DOCS = "doc_id long, text string, lang string, band string, id string, n int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = " ".join(f"w{k}" for k in range(40))
ROWS = [
    (1, BASE), (2, BASE), (3, BASE + " more"), (4, "W0 " + BASE), (5, None), (6, ""), (7, " \n"), (8, "two words"), (9, "Two  WORDS"), (10, "w " * 30000), (None, BASE), (1, BASE),
    (11, " ".join(f"z{k}" for k in range(60))), (12, " ".join(f"w{k}" for k in range(20)) + " other " * 30),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "b", "i", 1) for i, t in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def test_components(spark, tmp_path):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, 2), (2, 1), (5, 5), (7, 3), (3, 9), (None, 4)]
    got = components.components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {k: 100 for k in range(100, 161)} | {1: 1, 2: 1, 3: 3, 7: 3, 9: 3}
    assert components.components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_minhash(docs, none):
    sets = {}
    for i, t in ROWS:
        w = words(t)
        sets[i, t] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    got = minhash.op1(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(sets[i, t])) for i, t in ROWS)
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10, None: None, 11: 11, 12: 12}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.op1(none).count() == 0


def test_classifiers(spark, docs, none):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    for op, k, rest in ((quality.op2, 3, 1), (toxicity.op6, 4, 2)):
        got = {r["doc_id"]: r for r in op(table, labels).collect()}
        assert len(got) == table.count() and all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % k == rest) for i, r in got.items())
        odd = op(docs, labels.limit(0))
        assert odd.count() == len(ROWS) and none.count() == op(none, labels.limit(0)).count()
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/labels.parquet").collect()}
    rows = toxicity.op6(spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/labels.parquet")).collect()
    rows = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    assert sum(p * y for p, y in rows) >= 0.5 * sum(y for _, y in rows) and not any(p and not y for p, y in rows)
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    scored = [r for r in quality.op2(table, labels).collect() if r["held_out"] and r["doc_id"] in y]
    assert sum(r["predicted"] == y[r["doc_id"]] for r in scored) >= 0.9 * len(scored)


def test_bpe(docs, none):
    P, T = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    lib = T.Tokenizer.from_file(path)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op3(docs, path).collect())
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), digest(b"".join(x.to_bytes(4, "little") for x in ids)), digest((t or "").encode())] += 1
    assert got == want and bpe.op3(none, path).count() == 0
    round_trip = bpe.decode(bpe.encode(docs, path), path)
    assert all(r["decoded"] == (r["text"] or "") for r in round_trip.collect()) and "band" in round_trip.columns


def test_warc(spark):
    rows = [(1, "http://a/x", "same"), (2, "http://a/y", "same"), (9, None, "same"), (3, "http://b", None), (4, "u", ""), (5, "http://c/?q\r\nX: y", "p\r\n\r\nWARC/1.1 q" * 50), (6, "h", "é" * 70000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_id string")
    got = {r["page_id"]: r for r in warc.op4(pages).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert all(got[i]["payload_bytes"] == len((h or "").encode()) for i, _, h in rows)
    scratch = Scratch(spark, "t")
    path = scratch.path("w")
    warc.write(pages, path, scratch)
    full = {r["metadata"][0]["headers"]: r for r in warc.assemble(warc.read(spark, path), scratch).collect()}
    assert len(full) == 7 and {bytes(r["response"]["payload"]).decode() for r in full.values() if r["response"]["record_type"] == "response"} == {"same", "", rows[5][2], rows[6][2]}
    assert all(len(r["request"]) == 1 for r in full.values()) and warc.op4(pages.limit(0)).count() == 0


def test_warc_rows_of_any_page(spark, tmp_path):
    """Repeated, tied and null page_ids and null payloads, as SQL has them."""
    import duckdb

    from patchloom.llm.queries import ORACLE_OP4

    rows = [(1, "u", "A"), (1, "u", "B"), (2, "u", "A"), (3, "u", "B"), (3, "v", "C"), (None, "u", "A"), (None, None, "N"), (None, "w", "N"), (9, "u", "A"), (9, "v", "A"), (4, "x", None), (5, "x", ""), (7, "é", "é" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "p"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/p/*.parquet')")
    got = warc.op4(pages).toPandas()
    same_rows(got, con.execute(ORACLE_OP4).df())
    assert (got["record_type"] == "revisit").sum() == 5 and warc.op4(pages.limit(0)).count() == 0
    scratch = Scratch(spark, "t")
    path = scratch.path("w")
    warc.write(pages, path, scratch)
    held = sorted(bytes(r["payload"]).decode() for r in warc.read(spark, path).where("record_type = 'response'").collect())
    assert held == sorted(["A", "A", "B", "C", "N", "N", "", "é" * 9])


def test_warc_files_are_bounded(spark):
    """Large payloads go to files of fewer records."""
    pages = spark.createDataFrame([(k, "u", f"{k}" + "x" * (3 << 20)) for k in range(30)] + [(100 + k, "u", f"s{k}") for k in range(30)], "page_id long, url string, html string").coalesce(1)
    scratch = Scratch(spark, "t")
    path = scratch.path("w")
    warc.write(pages, path, scratch)
    sizes = [len(warc._inflated(bytes(r["content"]))[0]) for r in spark.read.format("binaryFile").load(path).collect()]
    assert sum(sizes) > 90 << 20 and max(sizes) < 80 << 20 and warc.op4(pages).count() == 60


def test_warc_assembly_in_any_direction(spark):
    """A response that names its request, records that name one another, repeated headers, and records left alone."""
    rec = lambda i, kind, to: (i, kind, to, None, None, None, None, None, {}, None, None)
    rows = [rec("r1", "response", ["q1"]), rec("q1", "request", []), rec("m1", "metadata", ["q1"]), rec("r2", "revisit", []), rec("q2", "request", ["r2", "x"]), rec("m2", "metadata", ["x", "r2"]), rec("m3", "metadata", ["gone"]), rec("w", "warcinfo", []), rec(None, None, [])]
    got = {r["capture_id"]: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD), Scratch(spark, "t")).collect()}
    ids = lambda k, part: [x["record_id"] for x in got[k][part] or []]
    assert set(got) == {"r1", "r2", "gone", "w"} and got["gone"]["response"] is None
    assert (ids("r1", "request"), ids("r1", "metadata"), ids("r2", "request"), ids("r2", "metadata")) == (["q1"], ["m1"], ["q2"], ["m2"])


def test_warc_damage_is_told(spark, tmp_path):
    """Junk, missing lengths, cut blocks and cut archives cost what they damage and no more."""
    import gzip

    one = lambda k, length="Content-Length: 3\r\n": f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: {k}\r\n{length}\r\nabc\r\n\r\n".encode()
    whole = one(1) + b"junk line\n" + one(2) + one(3, "Content-Length: x\r\n") + one(4) + one(5, "Content-Length: 99\r\n")
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one(6)) + gzip.compress(one(7) * 50)[:-20])
    rows = warc.read(spark, str(tmp_path)).collect()
    wrong = {r["record_id"]: r["error"] for r in rows if r["record_id"]}
    assert set("123456") <= set(wrong) and wrong["1"] is wrong["2"] is wrong["4"] is wrong["6"] is None and wrong["3"] == "no Content-Length" and "cut short" in wrong["5"]
    assert {"no record" in r["error"] or "cut short" in r["error"] for r in rows if r["record_type"] is None} == {True} and sum(r["record_type"] is None for r in rows) == 3


def test_decontamination(spark, docs, none, monkeypatch):
    items = [(1, " ".join(f"w{k}" for k in range(5, 17))), (10, "two WORDS"), (3, None), (4, "..."), (None, "w1 w2"), (10, "two words"), (2, "absent " * 12)]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, spans string")
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for i, t in items:
        w = words(t, word)
        size = min(10, len(w))
        if i is not None and w:
            for k in range(len(w) - size + 1):
                windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    want = Counter()
    for d, t in ROWS:
        w, hit, found = words(t, word), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        want[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)] += 1
    assert Counter(tuple(r) for r in decontaminate.op5(docs, bench).collect()) == want
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 5)
    assert Counter(tuple(r) for r in decontaminate.op5(docs, bench).collect()) == want
    assert decontaminate.op5(none, bench).count() == 0 and decontaminate.op5(docs, bench.limit(0)).where("contaminated").count() == 0


def test_substrings(spark, none):
    passage = " ".join(f"passage{k} of" for k in range(40))
    own = lambda c: " ".join(f"{c}{k}" for k in range(80))
    rows = [(1, own("a") + " " + passage + " " + own("b")), (2, own("c") + "\n" + passage), (3, own("d")), (4, None), (5, ""), (None, passage), (6, "short of it"), (7, "short of it"), (8, passage[:150] + own("e"))]
    table = spark.createDataFrame([(i, t, "x", len(t or "")) for i, t in rows], "doc_id long, text string, shared string, n_chars long")
    assert {r["doc_id"] for r in chunks.op7(table).collect()} == {1, 2}
    left = {r["doc_id"]: r for r in chunks.dedupe(table, Scratch(spark, "t")).collect()}
    assert left[1]["text"] == rows[0][1] and own("c") in left[2]["text"] and len(left[2]["text"]) < len(rows[1][1]) - len(passage) // 2 and left[2]["n_chars"] == len(left[2]["text"])
    assert all(left[i]["text"] == t for i, t in rows if i != 2) and chunks.op7(none).count() == 0


def test_embeddings(spark, duck):
    from patchloom.llm.queries import ORACLE_OP8

    same_rows(embeddings.op8(spark.read.parquet(f"{DATA}/embeddings.parquet")).toPandas(), duck.execute(ORACLE_OP8).df())
    odd = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [1.0, 2.0, 3.0]), (9, [1.0, 0.0]), (10, [])]
    table = spark.createDataFrame([(*r, 0) for r in odd], "vec_id long, embedding array<float>, cell int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.op8(table).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 9: (2, 1)} | {k: (0, k) for k in (3, 4, 5, 6, 7, 8, 10)}
    assert embeddings.op8(table.limit(0)).count() == 0


def test_language_model(docs, none):
    rows = language_model.op9(docs).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in ROWS if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    import math

    want = sorted((len(words(t)) + 1, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 4), sum(c[w] > 0 for w in [*words(t), None])) for _, t in ROWS)
    assert sorted((r["n_tokens"], round(r["base_score"], 4), r["n_known"]) for r in rows) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in rows) and language_model.op9(none).count() == 0


def test_language_model_learns_pairs_of_rare_words(spark):
    """Words beyond any fixed number have dishes and restaurants: a rare pair that was seen beats the same words apart."""
    pad = [(k, " ".join(f"p{k}x{j}" for j in range(60)) + " " + " ".join(f"q{j}" for j in range(9000))) for k in range(0, 40)]
    rows = [*pad, *((100 + k, "rarea rareb") for k in range(8)), *((200 + k, f"rarec sole{k}") for k in range(8))]
    got = language_model.op9(spark.createDataFrame([*rows, (1000, "rarea rareb"), (1001, "rarec rareb")], "doc_id long, text string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["score"] > by[1001]["score"] + 0.3 and by[1000]["n_known"] == 3


def test_licenses(spark, docs, none):
    texts = ["Released under the MIT License, and under the mit license.", "CC-BY-NC 4.0", "nothing " * 100, None, "x " * 70 + "This work is licensed under the GNU General Public License version three", "Apache License, Version 2.0"]
    table = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, places string")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.op10(table).collect()}
    assert got[0] == (10, 2, 1, 6, "mit", "mit", 1.0)
    assert got[1][1:6] == (1, 0, 0, "cc-by-nc", "cc-by-nc") and got[2][1:] == (0, None, None, "", "", 0.0) and got[3][:2] == (0, 0)
    assert got[4][4:6] == ("", "gpl-3") and 0.8 <= got[4][6] < 1 and got[5][4] == "apache-2"
    assert licenses.op10(docs).count() == len(ROWS) and licenses.op10(none).count() == 0


def test_licenses_in_order_of_length(spark):
    """Words of a short template that are scattered are none of its blocks; a long one is found wherever it stands."""
    scattered = ["The general public was told that a lesser known license exists.", "All readers have rights that are reserved by law.", "a lesser general public license", "All rights are reserved", "all reserved rights", "public lesser general x license", "ALL RIGHTS - RESERVED."]
    table = spark.createDataFrame(list(enumerate(scattered)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.op10(table).collect()}
    assert got == {0: "", 1: "", 2: "lgpl-3", 3: "", 4: "", 5: "", 6: "all-rights-reserved"}
    body = " ".join(f"term{k}" for k in range(150))
    table = spark.createDataFrame([(k, "x " * k + body + " y" * 90 + " " + body) for k in (0, 17, 75, 149, 151)], "doc_id long, text string")
    got = {r["doc_id"]: [(b["label"], b["start"], b["containment"]) for b in r["blocks"]] for r in licenses.find(table, [("long", body)], {}).collect()}
    assert len(got) == 5 and all(len(v) == 2 and v[0][2] == v[1][2] == 1 and v[0][1] == k for k, v in got.items())


def test_licenses_against_brute_force(spark):
    """All windows of random texts of template words, against a count of each."""
    import math
    import random

    rng = random.Random(8)
    templates = [("a", "p q r"), ("b", "p q r s t u v p q"), ("c", " ".join(f"k{j}" for j in range(20)))]
    texts = [" ".join(rng.choice(["p", "q", "r", "s", "t", "u", "v", "x", "y", *(f"k{j}" for j in range(20))]) for _ in range(rng.randint(0, 120))) for _ in range(120)]
    texts += [" ".join(f"k{j}" for j in rng.sample(range(20), 18)) + " p r q" for _ in range(20)]
    got = {r["doc_id"]: {(b["label"], round(b["containment"], 9)) for b in r["blocks"]} for r in licenses.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates, {}).collect()}
    for k, text in enumerate(texts):
        w, want = text.split(), {}
        for label, body in templates:
            s, n = set(body.split()), math.ceil(licenses.SPREAD * len(body.split()))
            best = max((len(s & set(w[i : i + n])) for i in range(len(w))), default=0)
            if len(body.split()) < licenses.ORDERED:
                best = len(s) if f" {body} " in f" {text} " else 0
            if best >= math.ceil(0.8 * len(s) - 1e-9):
                want[label] = round(best / len(s), 9)
        top = {}
        for label, share in got[k]:
            top[label] = max(top.get(label, 0), share)
        assert top == want, text


def test_embeddings_of_every_length(spark):
    """Vectors of each length link among themselves, those of one component too."""
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [3.0, 0.0, 0.02]), (5, [1.0]), (6, [2.0]), (7, [-1.0]), (8, [0.0, 1.0]), (9, [0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.op8(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8), 9: (0, 9)}


def test_embeddings_of_extreme_norms(spark):
    """Vectors whose squares over- or underflow link by their direction, and take no link from others."""
    import duckdb
    import numpy as np
    import pandas as pd

    from patchloom.llm.queries import ORACLE_OP8

    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, base + 0.02 * rng.normal(size=base.shape)]))]
    tiny, huge = (100, [1e-200] * 8), (101, [1e200] * 8)
    rows += [tiny, huge, (102, [-1e-320] * 8), (103, [-1e308] * 7 + [-9e307]), (104, [1e-300] + [0.0] * 7), (105, [1e300] + [1.0] * 7)]
    got = embeddings.op8(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    con = duckdb.connect()
    con.register("embeddings", pd.DataFrame(rows, columns=["vec_id", "embedding"]))
    same_rows(got, con.execute(ORACLE_OP8).df())
    by = got.set_index("vec_id")
    assert by.component_id[:80].tolist() != list(range(80)) and (by.n_links[:80] > 0).all()
    assert by.component_id[101] == 100 and by.component_id[103] == 102 and by.component_id[105] == 104


def test_language_model_is_normalised(spark, monkeypatch):
    """P(w | u) sums to 1 over all words and the unknown one, after common, rare and unseen words alike."""
    import numpy as np
    import pyarrow as pa

    L = language_model
    texts = ["a b a b a c", "a b", "c a b q1 q2", "q2 b q3 a a b", "b b b c a q4", ""] + [f"z{k} a b z{k}" for k in range(30)]
    learnt = L.Learnt(spark.createDataFrame([(t,) for t in texts * 2], "text string").repartition(3), Scratch(spark, "t"), most=6)
    assert 0 < len(learnt.common.n) <= 6 and learnt.parts == 1
    cells, arrays = learnt.model.cells.toArrow().combine_chunks(), learnt.arrays()
    vocabulary = sorted({w for t in texts for w in t.split()})
    ids = {}
    for w in [*vocabulary, "never"]:
        data = np.frombuffer(w.encode(), np.uint8)
        ids[w] = int(learnt.common.ids(data, np.array([0, len(data)]))[1][0])
    outcomes = np.array([ids[w] for w in vocabulary] + [ids["never"], L.END])
    assert len(vocabulary) + 1 == learnt.words
    stats = {r["u"]: r for r in learnt.model.cells.select("ones", "many").mapInArrow(L._rare_contexts, "u long, c long, s long").collect()}
    for u in (L.START, ids["a"], ids["b"], ids["z3"], ids["q2"], ids["never"]):
        block = L.pack(np.full(len(outcomes), u), outcomes, np.arange(len(outcomes)))
        got = L.look_up(arrays, cells, pa.table({"block": [block]})).to_pydict()
        if u >= 0 and u <= L.START:
            p = [10**x for x in got["log"]]
        else:
            own = stats.get(u, {"c": 0, "s": 0})
            cold = [(x, q) for x, q, k in zip(got["x"], got["p"], got["u"]) if k is not None]
            p = [(x + (L.STRENGTH + learnt.model.d_rare * own["s"] / L.KEPT) * q) / (L.STRENGTH + own["c"]) for x, q in cold]
        assert len(p) == len(outcomes) and sum(p) == pytest.approx(1) and min(p) > 0, u


def test_blocks_are_dealt_in_steps(spark, monkeypatch):
    """More parts than one task deals to are reached in steps, and nothing is lost on the way."""
    import numpy as np
    import pyarrow as pa

    L = language_model
    monkeypatch.setattr(L, "FAN", 4)
    u, w = np.arange(500) % 40, np.arange(500) // 40 - 3
    first = L._dealt(L.part_of(u, w, 16), 4, u, w, np.arange(500))
    blocks = [(p, b) for p, b in zip(first["part"].to_pylist(), first["block"].to_pylist())]
    rows = L._regrouped((np.int64,) * 3, 16, 16, iter([pa.RecordBatch.from_pydict({"part": [p for p, _ in blocks], "block": [b for _, b in blocks]})]))
    seen = []
    for batch in rows:
        for p, b in zip(batch["part"].to_pylist(), batch["block"].to_pylist()):
            a, c, n = L.unpack(b, *(np.int64,) * 3)
            assert (L.part_of(a, c, 16) == p).all()
            seen += n.tolist()
    assert sorted(seen) == list(range(500)) and L.parts_for(5 << 20) == 16 and L.parts_for(3 << 20) == 3


def _planted(n, dim, seed):
    """Random vectors, with a group of near copies and pairs planted at cosines around the threshold."""
    import numpy as np

    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    group = rng.normal(size=dim)
    x[: n // 10] = group + 0.25 * rng.normal(size=(n // 10, dim))
    for k in range(n // 2, n - 1, 2):
        u = x[k] / np.linalg.norm(x[k])
        side = rng.normal(size=dim)
        side -= (side @ u) * u
        c = rng.uniform(0.85, 0.99)
        x[k + 1] = c * u + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    return x.astype(np.float32)


@pytest.mark.parametrize("n,parts", [(1500, 1 << 14), (4000, 150)])
def test_embeddings_recall_of_planted_links(spark, monkeypatch, n, parts):
    """Links found against all pairs: none wrong, and nearly none missed, in one part and in many."""
    import numpy as np

    monkeypatch.setattr(embeddings, "MEET", parts)
    x = _planted(n, 64, n)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.op8(rows).collect()}
    y = embeddings.unit(x.astype(np.float64))
    want = (y @ y.T >= embeddings.COSINE).sum(1) - 1
    found = np.array([got[k] for k in range(n)])
    assert (found <= want).all() and want.sum() > n and found.sum() >= 0.99 * want.sum()


def test_substrings_against_brute_force(spark):
    """Every run of 60 words that two documents share is found, and every span found stands in another document."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(12)]
    texts = [" ".join(word() for _ in range(rng.randint(10, 150))) for _ in range(80)]
    for k in range(40):
        cut = texts[k].split()
        at = rng.randint(0, len(cut))
        texts[k] = " ".join([*cut[:at], passages[k % 12], *cut[at:]])
    texts += ["漢字" * 700 + "甲", "x y " + "漢字" * 700 + "乙乙", " ".join("de fg"[k % 2 * 3 :][:2] + str(k) for k in range(30))]
    rows = chunks.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Scratch(spark, "t")).collect()
    grams = {}
    for k, text in enumerate(texts):
        w = text.split()
        for i in range(len(w) - 59):
            grams.setdefault(tuple(w[i : i + 60]), set()).add(k)
    shared = {k for own in grams.values() if len(own) > 1 for k in own} | {80, 81}
    found = {r["doc_id"]: [r["text"].encode()[s["start"] : s["end"]] for s in r["shared"]] for r in rows if r["shared"]}
    assert set(found) == shared
    for k, spans in found.items():
        assert all(any(s.strip() in t.encode() for j, t in enumerate(texts) if j != k) for s in spans), k
    later = {r["doc_id"] for r in rows if r["later"]}
    assert later == {k for k in range(40) if k >= 12} | {81}


def test_minhash_against_brute_force(spark, monkeypatch):
    """Components of a table and of a large group of near copies, most of them near the threshold, by all pairs."""
    import random

    rng = random.Random(12)
    base = [f"b{k}" for k in range(70)]
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for _ in range(160):
        own = base[:]
        for k in rng.sample(range(70), rng.choice([0, 1, 2, 3, 4, 5])):
            own[k] = f"z{rng.randint(0, 9**9)}"
        texts.append(" ".join(own))
    monkeypatch.setattr(minhash, "PART", 16)
    monkeypatch.setattr(minhash, "ROUNDS", 1)
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                links += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in minhash.op1(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert links > 500 and got == {k: root(k) for k in range(len(texts))}


def test_samples_are_bounded(spark):
    """Repeated ids, conflicting labels and labels of other tables take no room in a sample."""
    from pyspark.sql import functions as F

    from patchloom.llm import features

    docs = spark.createDataFrame([(k, f"text {k} {j}") for k in range(20) for j in range(30)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(5, 500)] * 2 + [(6, 1), (None, 1), (7, None)], "doc_id long, quality int")
    rows = features.sample(docs, labels, "quality", F.lit(False), 8).collect()
    assert len(rows) == 8 == len({r["doc_id"] for r in rows}) and all(5 <= r["doc_id"] < 20 and r["doc_id"] != 6 and r["y"] == r["doc_id"] % 2 for r in rows)
    assert features.sample(docs, labels, "quality", F.lit(False), 100).count() == 14


def test_words_of_long_texts():
    """Texts and words longer than a block are split and hashed like short ones."""
    import numpy as np

    from patchloom.llm import _text as X

    parts = ["ab " * 200_000, "c" * 700_000, " d ", "é" * 300_000, "x"]
    raw = np.frombuffer("".join(parts).encode(), np.uint8)
    w = X.words(raw, np.array([0, len(raw)]))
    assert [w.word(k).decode() for k in range(len(w.start))] == "".join(parts).split() and w.first.tolist() == [0, len(w.start)]
    for k in (0, 199_999, 200_000, 200_001, 200_002):
        one = raw[w.start[k] : w.end[k]]
        assert X.words(one, np.array([0, len(one)])).hash[0] == w.hash[k]
    assert len(set(w.hash[199_990:].tolist())) == 4
