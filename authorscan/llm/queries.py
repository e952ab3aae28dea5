"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from authorscan.llm.decontamination import contamination
from authorscan.llm.hard_negatives import mine
from authorscan.llm.line_dedup import line_dedup
from authorscan.llm.lm_scoring import backoff_scores
from authorscan.llm.packing import pack_documents
from authorscan.llm.quality_rules import quality_rules
from authorscan.llm.sharding import shard_documents
from authorscan.llm.simhash import simhash_groups
from authorscan.llm.substring_dedup import substring_dedup
from authorscan.llm.suffix_dedup import suffix_dedup
from authorscan.llm.token_alignment import alignment
from authorscan.llm.topk_search import top_k
from authorscan.llm.url_filters import judge_pages
from authorscan.session import read_table

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_quality_rules(spark, sf_dir):
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_lm_scoring(spark, sf_dir):
    return backoff_scores(read_table(spark, sf_dir, "documents"), order=3)


def op3_sharding(spark, sf_dir):
    return shard_documents(read_table(spark, sf_dir, "documents"), shards=8)


def op4_simhash_near_dedup(spark, sf_dir):
    return simhash_groups(read_table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op5_substring_dedup(spark, sf_dir):
    return substring_dedup(read_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup(read_table(spark, sf_dir, "documents"))


def op7_url_filters(spark, sf_dir):
    return judge_pages(read_table(spark, sf_dir, "pages"), URL_RULES)


def op8_benchmark_decontamination(spark, sf_dir):
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)


def op9_line_dedup(spark, sf_dir):
    return line_dedup(read_table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(), tokens=2048)


def op11_token_alignment(spark, sf_dir):
    return alignment(read_table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_topk_search(spark, sf_dir):
    return top_k(read_table(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024)


def op13_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read_table(spark, sf_dir, "embeddings"), label, every=100, positives=5, negatives=5, low=80, high=100, scale=256)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the public tokenizers installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_sharding": op3_sharding,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
    "op11_token_alignment": op11_token_alignment,
    "op12_topk_search": op12_topk_search,
    "op13_hard_negatives": op13_hard_negatives,
}

WHOLE = """
whole AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""

ORACLES: dict[str, str] = {
    "op12_topk_search": f"""
WITH {WHOLE.format(scale=1024)},
scored AS (
  SELECT q.rid, q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::bigint AS score
  FROM whole q JOIN whole x ON q.vec_id % 100 = 0 AND q.rid <> x.rid
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::int AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op13_hard_negatives": f"""
WITH {WHOLE.format(scale=256)},
named AS (
  SELECT rid, vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM whole WHERE label IS NOT NULL
),
scored AS (
  SELECT a.rid, a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_inner_product(a.v, x.v)::bigint AS score
  FROM named a JOIN named x ON a.vec_id % 100 = 0 AND a.rid <> x.rid
),
positive AS (
  SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS nth
  FROM scored WHERE same
),
negative AS (
  SELECT p.rid, p.nth, p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.rid, p.nth ORDER BY n.score DESC, n.vec_id)::int AS rank
  FROM positive p JOIN scored n ON p.rid = n.rid
  WHERE p.nth <= 5 AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5""",
}
