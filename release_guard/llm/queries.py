"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, stored
from . import oracles
from .common import table, text_or_empty
from .conversations import damaged, repair
from .decontamination import contaminated
from .divergence import source_divergence
from .html_text import extract_text
from .jaccard import jaccard_components
from .language import identify, learn
from .packing import encode_pieces, pack
from .pii import BASE, find_personal_data
from .substrings import without_repeats
from .token_files import REMEMBERED, document_index, write_token_files
from .tokens import token_counts
from .topk import top_k
from .toxicity import calibrate, learn_lexicon, score_passages, score_texts

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers or names."""
    pairs = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.drop("text_key")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and whether there are more than 512."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(documents, public_tokenizers.path(BYTE_BPE)).select(
        "doc_id",
        F.octet_length(text_or_empty()).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"),
    )


def op3_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector."""
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(embeddings, embeddings.where("vec_id % 50 = 0"), 5)


def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts without the bytes of repeated 200-byte strings."""
    return without_repeats(table(spark, sf_dir, "documents"), 200)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all texts to directly addressable codes and reads them back."""
    path = scratch_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), end_id=1)
    return document_index(spark, path)


def op6_style_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    texts = extract_text(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all texts, learned from three of four parts of the documents."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = learn(documents.where(~held_out))
    return identify(documents.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts packed into sequences of 2048 ids."""
    pieces = encode_pieces(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=0, capacity=2048, remembered=REMEMBERED
    )
    return pack(pieces, 2048)


def op9_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the smallest document their shingle sets are linked with."""
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of all texts, as counts and places."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(counted, BASE),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def op11_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all texts; words learned from three, the calibration from one of five parts of the labels."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("toxic in (0, 1) and doc_id is not null")
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(-1))
    # One plan at every size: both sides of the join are sorted, whether or not the labels are few.
    labels = labels.hint("merge")
    lexicon = learn_lexicon(documents.join(labels.where(part.isin(1, 2, 3)), "doc_id"))
    calibration = None
    if lexicon:
        passages = score_passages(documents.where(part == 4), lexicon).drop("text")
        calibration = calibrate(stored(passages.join(labels, "doc_id"), "passages"))
    return score_texts(documents, lexicon, calibration).select(
        "doc_id",
        (part == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the words of each source differ from those of its language and of each other source."""
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of all conversations after planted damage."""
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_template_decontamination": op1_template_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_threshold_top_k": op3_threshold_top_k,
    "op4_repeated_substrings": op4_repeated_substrings,
    "op5_token_files": op5_token_files,
    "op6_style_tree_text": op6_style_tree_text,
    "op7_language": op7_language,
    "op8_best_two_fit": op8_best_two_fit,
    "op9_parity_sketch_join": op9_parity_sketch_join,
    "op10_personal_data": op10_personal_data,
    "op11_segment_toxicity": op11_segment_toxicity,
    "op12_source_divergence": op12_source_divergence,
    "op13_conversation_repair": op13_conversation_repair,
}

# The others need tokenizers, learned models or byte strings, or are too slow in SQL over whole tables.
ORACLES = {
    "op3_threshold_top_k": oracles.TOP_K,
    "op9_parity_sketch_join": oracles.JACCARD_COMPONENTS,
    "op12_source_divergence": oracles.SOURCE_DIVERGENCE,
    "op13_conversation_repair": oracles.CONVERSATION_REPAIR,
}
