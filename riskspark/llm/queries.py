"""Registered queries of the training-data operators; each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import bpe, conversations, fingerprint, hard_negatives, html_extract, langid, near_dedup, packing, quality, repeats, sharding, token_store, topk
from riskspark.llm.common import id_remainder, table

RANK_FILE = "byte_bpe_50k.tiktoken"
BYTE_FILE, WORD_FILE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and their decoding, as digests."""
    return bpe.round_trip(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path(RANK_FILE),
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    added = packing.added_tokens(public_tokenizers.path(BYTE_FILE))
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, capacity=2048, added=added)


def language_prototypes(docs: DataFrame) -> dict:
    """Learned from the rows with a language whose id remainder by 4 isn't 2."""
    return langid.learn(docs.where(id_remainder(F.col("doc_id"), 4) != 2))


def quality_model(docs: DataFrame, labels: DataFrame) -> tuple:
    """Learned from the labelled rows whose id remainder by 3 isn't 1."""
    known = labels.select("doc_id", "quality").where(id_remainder(F.col("doc_id"), 3) != 1)
    return quality.learn(docs, known, "doc_id", "text", "quality")


def op3_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, on 4-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, language_prototypes(docs))
    return found.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of eight and its slot there."""
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op6_i_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents")
    return fingerprint.edited_likeness(docs, fingerprint.build_lexicon(docs))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    found = quality.predict(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return found.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", predicted.alias("predicted"))


def op8_prefix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages that start earlier."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])
    spans = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", "n_bytes", lost.alias("n_removed"), spans, F.sha2("kept", 256).alias("kept_sha256"))


def op9_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    found = html_extract.extract(pages, html_extract.learn(pages))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every 50th vector, by integer inner product."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op11_four_russians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of the five best positives of every 100th vector; labels of every seventh id moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0, positives=5, negatives=5, least=80, most=100, scale=256)


def op12_deepening_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def op13_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to files and read back, as digests."""
    return token_store.store_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE), end_id=1)


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_minhash_hamming": op3_minhash_hamming,
    "op4_language_id": op4_language_id,
    "op5_sampled_splitters": op5_sampled_splitters,
    "op6_i_match": op6_i_match,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_prefix_intervals": op8_prefix_intervals,
    "op9_block_labeller": op9_block_labeller,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_four_russians": op11_four_russians,
    "op12_deepening_repair": op12_deepening_repair,
    "op13_token_store": op13_token_store,
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL: dict[str, str] = {
    "op3_minhash_hamming": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w
), n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
links AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.b, r.c FROM r JOIN links ON links.a = r.doc_id WHERE r.c < links.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
""",
    "op10_exact_top_k": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM e q JOIN e d ON d.vec_id <> q.vec_id AND len(d.v) = len(q.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op11_four_russians": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, d.vec_id AS other_id, a.label = d.label AS same, CAST(list_dot_product(a.v, d.v) AS BIGINT) AS score
  FROM e a JOIN e d ON d.vec_id <> a.vec_id AND len(d.v) = len(a.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 5
""",
}
