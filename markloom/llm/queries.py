"""The registered queries of this subpackage: thin wrappers that derive contract columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.llm import chat, exact, hyperminhash, licenses, mixing, pieces, quality, sharding, substring, token_files
from markloom.llm._io import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), ["doc_id"])
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken", ",").alias("broken")
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.classes(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = substring.parse(table(spark, sf_dir, "documents"))
    return parsed.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.link(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.roundtrip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 40)
    none = F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def quoted_conversations(conversations: DataFrame) -> DataFrame:
    """``conversations`` as mail: the synthetic table holds no quotation, so earlier turns are quoted by rule.

    Turns 1, 5, ... quote the turn before; turns 2, 6, ... the one before that on level 1 and
    the last on level 2; turns 3, 7, ... the second last on level 3; the others quote nothing.
    """
    own = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    kind = F.pmod("turn", F.lit(4))
    asks = {1: ((1, 1), (2, 2)), 2: ((2, 1), (3, 3))}  # distance: (kind of turn, level)
    out = own
    for distance, cases in asks.items():
        earlier = own.select("conv_id", (F.col("turn") + distance).alias("turn"), F.col("text").alias("_said"))
        level = F.lit(None).cast("int")
        for k, n in cases:
            level = F.when(kind == k, n).otherwise(level)
        met = out.join(earlier, ["conv_id", "turn"], "left")
        mark = F.repeat(F.lit(">"), level)
        lines = F.array_join(F.transform(F.split("_said", "\n"), lambda x: F.concat(mark, F.lit(" "), x)), "\n")
        out = met.withColumn("text", F.when(level.isNotNull() & F.col("_said").isNotNull(), F.concat(lines, F.lit("\n"), "text")).otherwise(F.col("text"))).drop("_said")
    return out


def op2_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat.link(quoted_conversations(table(spark, sf_dir, "conversations")))
    return linked.withColumn("parent_turn", F.coalesce("parent_turn", F.lit(-1)))  # -1: answers no message


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["license"]))), ",")
    lines = F.array_join(F.transform("notices", lambda n: n["line"].cast("string")), ",")
    exact_ones = F.size(F.filter("notices", lambda n: (n["covered"] == 1.0) & (F.size(n["differences"]) == 0)))
    return found.select(
        "doc_id", F.size("notices").cast("long").alias("n_notices"), names.alias("licenses"), lines.alias("lines"), exact_ones.cast("long").alias("n_exact")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quotation_links": op2_quotation_links,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_token_files": op5_token_files,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_sharding": op7_sharding,
    "op8_mix_sources": op8_mix_sources,
    "op9_license_scan": op9_license_scan,
    "op10_exact_dedup": op10_exact_dedup,
}
