"""The queries of this subpackage over the given tables; ``ORACLE`` has the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from daypanel.llm import bpe, chat, codes, decontaminate, exact_dedup, fim, licences, near_join, pii, quality, quality_rules, suffix_dedup, toxicity
from daypanel.llm.common import read
from daypanel.llm.oracle import ORACLE as ORACLE


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), vocabulary_path())


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_turns(rows))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end")))
    return found.select(
        "doc_id",
        *(F.size(F.array_remove(F.transform("base", lambda s: s["kind_no"] == F.lit(i)), False)).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)),
        F.sha2(pii.written(plain), 256).alias("base_sha256"),
        pii.written(pii.all_spans()).alias("spans"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.similar_classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    model = toxicity.fit(docs, labels, remainder != 1)
    return toxicity.score(docs, model, out="score").select(
        "doc_id",
        (remainder == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.col("is_toxic").alias("toxic_for_language"),
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), digests=True)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(read(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.lit(codes.books_text(books)), 256)
    return codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.transform(read(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("fim_text", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("fim_text"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents"))
    quality = (F.floor(F.col("quality") * 1e6 + 0.501) / 1e6).alias("quality")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", quality
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_licences, op3_bpe, op4_decontaminate, op5_chat, op6_pii, op7_quality, op8_near_join, op9_toxicity, op10_suffix_dedup, op11_vector_codes, op12_fill_in_middle, op13_quality_rules)
}
