"""The registered queries: each applies one operator to its whole table and returns the whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, chunks, codes, decontaminate, embeddings, language_model, licenses, minhash, quality, tokenfile, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The file of the public byte-level vocabulary that the encoding query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces() -> str:
    """The file of the public model of pieces that the alignment query uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op1(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op2(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op3(_table(spark, sf_dir, "documents"), vocabulary())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op4(_table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op5(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op6(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.op7(_table(spark, sf_dir, "documents"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.op8(_table(spark, sf_dir, "embeddings"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.op9(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op10(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.op11(_table(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.op12(_table(spark, sf_dir, "documents"), vocabulary())


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.op13(_table(spark, sf_dir, "documents"), vocabulary(), pieces())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of the subpackage by name."""
    every = (op1_minhash, op2_quality, op3_bpe, op4_warc, op5_decontamination, op6_toxicity, op7_substring, op8_embeddings, op9_language_model, op10_licenses, op11_vector_codes, op12_token_files, op13_alignment)
    return {f.__name__: f for f in every}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_OP1 = f"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(len(w) - 4), lambda k: array_to_string(w[k + 1 : k + 5], ' '))) END) AS s FROM dw),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 75 * (na.n + nb.n - m)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN comp ON comp.node = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
"""

ORACLE_OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
b AS (SELECT page_id, payload_bytes, h,
  translate(concat(to_base(('0x' || h[1:10])::BIGINT, 32, 8), to_base(('0x' || h[11:20])::BIGINT, 32, 8),
    to_base(('0x' || h[21:30])::BIGINT, 32, 8), to_base(('0x' || h[31:40])::BIGINT, 32, 8)),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS owner FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner IS NULL OR page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to FROM m
"""

ORACLE_OP5 = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
ip AS (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(greatest(len(w) - 10, 0) + 1)) AS k FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[k + 1 : k + size], ' ') AS g FROM ip),
sizes AS (SELECT DISTINCT size FROM win),
dp AS (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS k FROM dw, sizes WHERE len(w) >= size),
hits AS (SELECT dp.doc_id, dp.k, dp.size, win.item_id FROM dp JOIN win ON dp.size = win.size AND array_to_string(dp.w[dp.k + 1 : dp.k + dp.size], ' ') = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN named USING (doc_id)
"""


ORACLE_OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
big AS (SELECT *, list_max(list_transform(e, lambda x: abs(x))) AS most FROM v),
ok AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM (SELECT vec_id, CASE WHEN most > 0 THEN list_transform(e, lambda x: x / most) ELSE e END AS e FROM big)
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON comp.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


_TEMPLATES = ", ".join(f"('{label}', '{text}')" for label, text in licenses.TEMPLATES if len(text.split()) >= licenses.ORDERED)
_ORDERED = ", ".join(f"('{label}', '{text}')" for label, text in licenses.TEMPLATES if len(text.split()) < licenses.ORDERED)
_PHRASES = ", ".join(f"('{label}', '{text}')" for text, label in licenses.PHRASES.items())
ORACLE_OP10 = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
t AS (SELECT label, list_distinct(string_split(words, ' ')) AS s, ceil({licenses.SPREAD} * len(string_split(words, ' ')))::INT AS span FROM (VALUES {_TEMPLATES}) v(label, words)),
p AS (SELECT label, words AS phrase, len(string_split(words, ' ')) AS size FROM (VALUES {_PHRASES}) v(label, words)),
places AS (SELECT doc_id, label, k FROM (SELECT doc_id, w, label, phrase, size, unnest(range(len(w) - size + 1)) AS k FROM dw, p WHERE len(w) >= size)
  WHERE array_to_string(w[k + 1 : k + size], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
few AS (SELECT doc_id, w, label, s, span FROM dw, t WHERE len(list_intersect(s, list_distinct(w))) >= ceil(0.8 * len(s) - 1e-9)),
b AS (SELECT doc_id, label, s, w[k + 1 : k + span] AS block FROM (SELECT *, unnest(range(len(w))) AS k FROM few) WHERE list_contains(s, w[k + 1])),
held AS (SELECT doc_id, label, len(list_intersect(s, list_distinct(block))) AS n, len(s) AS size FROM b),
o AS (SELECT label, words AS phrase, len(string_split(words, ' ')) AS size FROM (VALUES {_ORDERED}) v(label, words)),
short AS (SELECT DISTINCT doc_id, label FROM (SELECT doc_id, w, label, phrase, size, unnest(range(len(w) - size + 1)) AS k FROM dw, o WHERE len(w) >= size) WHERE array_to_string(w[k + 1 : k + size], ' ') = phrase),
found AS (SELECT doc_id, label, n / size AS share FROM held WHERE n >= ceil(0.8 * size - 1e-9) UNION ALL SELECT doc_id, label, 1.0 AS share FROM short),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM found) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM dw LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""


def _rounds() -> str:
    """A table of assignments and one of entries for each round."""
    out = []
    for k in range(codes.ROUNDS + 1):
        out.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, row, p, arg_min(struct_pack(j := j, d := d), (d, j)) AS best, any_value(x) AS x FROM (SELECT v.vec_id, v.row, v.p, c.j, v.x,
  list_sum(list_transform(list_zip(v.x, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v JOIN c{k} c USING (p)) GROUP BY vec_id, row, p)""")
        if k < codes.ROUNDS:
            out.append(f"""m{k} AS MATERIALIZED (SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS e FROM (SELECT p, best.j AS j, i, sum(x[i])::HUGEINT AS s, count(*) AS n
  FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL)""")
            out.append(f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.j, coalesce(m.e, c.e) AS e FROM c{k} c LEFT JOIN m{k} m USING (p, j))")
    return ",\n".join(out)


ORACLE_OP11 = f"""
WITH k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row, list_transform(embedding, lambda y: floor({codes.SCALE} * y::DOUBLE)::BIGINT) AS y FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
v AS MATERIALIZED (SELECT vec_id, row, p, y[p * (len(y) // {codes.PARTS}) + 1 : (p + 1) * (len(y) // {codes.PARTS})] AS x FROM (SELECT *, unnest(range({codes.PARTS})) AS p FROM k)),
c0 AS MATERIALIZED (SELECT p, row - 1 AS j, x AS e FROM v WHERE row <= {codes.ENTRIES}),
{_rounds()},
done AS (SELECT vec_id, row, string_agg(printf('%02x', best.j), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{codes.ROUNDS} GROUP BY ALL),
books AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM c{codes.ROUNDS})
SELECT k.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM done JOIN k USING (row), books
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that it can express over whole tables."""
    return {"op1_minhash": ORACLE_OP1, "op4_warc": ORACLE_OP4, "op5_decontamination": ORACLE_OP5, "op8_embeddings": ORACLE_OP8, "op10_licenses": ORACLE_OP10, "op11_vector_codes": ORACLE_OP11}
