"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._base import shared_dir, sieve, sifted, table, written
from tessella.llm.chat_format import digest_chats, format_chats
from tessella.llm.exact_dedup import exact_dedup
from tessella.llm.hard_negatives import mine_negatives
from tessella.llm.html_extract import extract_text
from tessella.llm.license_scan import DISTINCT, scan_licenses
from tessella.llm.lm_scoring import score_texts
from tessella.llm.mixing import mix_sources
from tessella.llm.piece_lattice import encode_pieces
from tessella.llm.quality_crf import score_quality, train
from tessella.llm.signature_trees import similar_documents
from tessella.llm.spelling import spelling_variants
from tessella.llm.vector_forest import near_duplicates
from tessella.llm.token_rollup import TokenRollup, count_tokens, count_words, signed


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def op4_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are loaded under two tokenizer versions, those of quality 0 have their digits
    redacted and are counted again, and those labelled toxic are withdrawn. Each batch is committed
    twice, and the deltas are folded before the totals are read."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    both = lambda d: count_tokens(d).unionByName(count_words(d))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    poor = labels.where("quality = 0").select("doc_id").distinct().join(toxic, "doc_id", "left_anti")
    counts = written(both(docs))
    # Texts are counted where they lie; only counts meet the labels by a shuffle.
    likely = sifted(docs, F.col("doc_id"), sieve(poor), "likely").where("likely")
    redacted = both(likely.withColumn("text", F.regexp_replace("text", "[0-9]+", ""))).join(poor, "doc_id", "left_semi")
    changes = {
        "load": signed(inserted=counts),
        "redact": signed(revised=(counts.join(poor, "doc_id", "left_semi"), redacted)),
        "withdraw": signed(deleted=counts.join(toxic, "doc_id", "left_semi")),
    }
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/rollup/{uuid.uuid4().hex}")
    for _ in range(2):
        for batch, rows in changes.items():
            rollup.commit(batch, rows)
    rollup.fold()
    return rollup.totals()


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest_chats(format_chats(rows))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), across_lines=True, distinct=DISTINCT)


def op11_vantage_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_elias_fano_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return score_texts(table(spark, sf_dir, "documents"), F.crc32(id_text) % 7 == 2)


def op13_anagram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_crf, op2_exact_dedup, op3_signature_trees, op4_piece_lattice, op5_mix_sources, op6_token_rollup, op7_chat_format, op8_html_extract, op9_vector_forest, op10_license_scan, op11_vantage_negatives, op12_elias_fano_trie, op13_anagram_variants)}
