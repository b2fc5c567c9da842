"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, codes, exact, hardneg, lines, minhash, mixing, simhash, suffix, tokens, toxicity, windows


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, radius=4)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    less = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return less.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, repeats=2)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.repeated_windows(_table(spark, sf_dir, "documents"), width=13)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_bytes(_table(spark, sf_dir, "documents"), length=200)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.equal_text_groups(_table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label, positives=5, k=3, low=50, high=95)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_token_counts, op3_line_dedup, op4_nearest, op5_mixing, op6_byte_bpe, op7_toxicity, op8_window_dedup,
                                  op9_suffix_dedup, op10_exact_dedup, op11_minhash, op12_hard_negatives, op13_vector_codes)}


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""


OP11_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n nx ON nx.doc_id = a JOIN n ny ON ny.doc_id = b WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.least, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""

WHOLE = """SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

OP12_SQL = f"""
WITH r AS MATERIALIZED (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM ({WHOLE}) WHERE label IS NOT NULL),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""

FAR = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _round(k: int) -> str:
    return f"""a{k} AS MATERIALIZED (SELECT x.vec_id, x.p, arg_min(c.e, [{FAR}, c.e]) AS e, min({FAR}) AS far FROM x JOIN c{k} c ON c.p = x.p GROUP BY 1, 2),
m{k} AS (SELECT p, e, j, floor(sum(v[j]) / count(*)) AS mean FROM (SELECT a.p, a.e, x.v, unnest(range(1, len(x.v) + 1)) AS j FROM a{k} a JOIN x ON x.vec_id = a.vec_id AND x.p = a.p) GROUP BY 1, 2, 3),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT p, e, list(mean ORDER BY j) AS v FROM m{k} GROUP BY 1, 2) m ON m.p = c.p AND m.e = c.e)"""


OP13_SQL = f"""
WITH k AS MATERIALIZED ({WHOLE}),
x AS MATERIALIZED (SELECT vec_id, p, v[len(v) * p // 16 + 1:len(v) * (p + 1) // 16] AS v FROM k, (SELECT unnest(range(16)) AS p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 64),
{_round(0)}, {_round(1)}, {_round(2).split("m2 AS")[0].rstrip().rstrip(",")},
h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2),
f AS (SELECT vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY 1),
t AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM f JOIN k USING (vec_id) GROUP BY 1)
SELECT f.vec_id, code, error, label_error, codebooks_sha256 FROM f JOIN k USING (vec_id) JOIN t ON t.label IS NOT DISTINCT FROM k.label CROSS JOIN h
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": OP10_SQL, "op11_minhash": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_vector_codes": OP13_SQL}
