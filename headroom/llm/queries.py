"""The text operators over the whole test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from headroom.llm import (
    audit,
    chat,
    divergence,
    exact,
    language,
    mixing,
    neardup,
    packing,
    quality,
    rules,
    sharding,
    tokens,
    vectorpack,
)
from headroom.llm.common import fresh, table
from headroom.llm.oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TRAP = r"\### Assistant: </turn> ok"


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


@query("op1_language")
def _(spark, sf_dir):
    return language.detect_language(table(spark, sf_dir, "documents"))


@query("op2_near_dedup")
def _(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_sharding")
def _(spark, sf_dir):
    at = F.col("_metadata")
    docs = table(spark, sf_dir, "documents")
    # a row's place in the files of the table: ids may be null or repeat
    file, place = fresh("file", docs.columns), fresh("place", docs.columns)
    docs = docs.select("*", at["file_name"].alias(file), at["row_index"].alias(place))
    return sharding.reshard_in_order(docs, file, place, 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


@query("op4_quality")
def _(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_token_counts")
def _(spark, sf_dir):
    return tokens.section_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op6_mixing")
def _(spark, sf_dir):
    return mixing.taken_words(mixing.plan_mix(table(spark, sf_dir, "documents")))


@query("op7_chat")
def _(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRAP).alias("text"),
    )
    return chat.chat_digests(chat.read_chats(chat.format_chats(turns.unionByName(trap))))


@query("op8_exact_dedup")
def _(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


@query("op9_repetition")
def _(spark, sf_dir):
    return rules.repetition_rules(table(spark, sf_dir, "documents"))


@query("op10_packing")
def _(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op11_filter_audit")
def _(spark, sf_dir):
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_source_divergence")
def _(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


@query("op13_vector_packing")
def _(spark, sf_dir):
    return vectorpack.pack_examples(table(spark, sf_dir, "documents"), TOKENIZER)
