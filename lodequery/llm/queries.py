"""The registered queries of this subpackage: thin views of its operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .balltree import top_k
from .jaccard import jaccard_groups
from .kneser_ney import language_model_scores
from .mixture import mix_sources, mixture_sql
from .phrase_index import contamination
from .planes import plane_output
from .pseudonyms import pseudonymise
from .quality import quality_scores
from .qualityrules import quality_rules
from .token_counts import token_counts
from .toxicity import toxicity_scores
from .vectorcodes import codes_sql, vector_codes
from .wavelet import ranked_search, search_sql

BPE = "byte_bpe_50k.json"
#: For the query only; a real run takes its key from a secret store.
PSEUDONYM_KEY = "op8 demonstration key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents"))


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op7_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op10_plane_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_output(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op13_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kneser_ney": op1_kneser_ney,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_ordinal_quality": op3_ordinal_quality,
    "op4_counterfactual_toxicity": op4_counterfactual_toxicity,
    "op5_ball_tree": op5_ball_tree,
    "op6_temperature_mixing": op6_temperature_mixing,
    "op7_phrase_index": op7_phrase_index,
    "op8_feistel_pseudonyms": op8_feistel_pseudonyms,
    "op9_token_counts": op9_token_counts,
    "op10_plane_output": op10_plane_output,
    "op11_vector_codes": op11_vector_codes,
    "op12_quality_rules": op12_quality_rules,
    "op13_wavelet_search": op13_wavelet_search,
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS s
        FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0),
pos AS (SELECT rid, k, n, array_to_string(w[k : k + n - 1], ' ') AS s
        FROM d, (SELECT DISTINCT n FROM win) AS l, unnest(range(1, len(w) - n + 2)) AS t(k)),
m AS (SELECT rid, k, pos.n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.s = win.s),
h AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT rid, k, n FROM m) AS q, unnest(range(k, k + n)) AS t(x) GROUP BY rid),
f AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) AS q GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.rid = h.rid LEFT JOIN f ON d.rid = f.rid
"""

_OP2 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, md5(array_to_string(w[k : k + least(len(w), 5) - 1], ' ')) AS g
      FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(k) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.g = y.g AND x.rid <> y.rid GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS u ON u.rid = a JOIN n AS v ON v.rid = b WHERE 100 * c >= 80 * (u.n + v.n - c)),
r(a, b) AS (SELECT rid, rid FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, q.component_id
FROM d LEFT JOIN n ON d.rid = n.rid JOIN (SELECT r.a, min(e.doc_id) AS component_id FROM r JOIN d AS e ON e.rid = r.b GROUP BY r.a) AS q ON q.a = d.rid
"""

_OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) AS r WHERE rank <= 10
"""

ORACLE: dict[str, str] = {
    "op2_jaccard_join": _OP2,
    "op5_ball_tree": _OP5,
    "op6_temperature_mixing": mixture_sql(),
    "op7_phrase_index": _OP7,
    "op11_vector_codes": codes_sql(),
    "op13_wavelet_search": search_sql(),
}
