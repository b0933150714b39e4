"""The registered queries of the operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (
    embedding,
    fill_middle,
    importance,
    licenses,
    mixing,
    packing,
    pieces,
    quality,
    sharding,
    simhash,
    substring,
    training_order,
    warc,
)
from .common import table

SHARDS = 8


def op1_license(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark, sf_dir):
    """Writes all pages as records, then reads the archive back."""
    folder = warc.archive_folder(spark)
    warc.write_warc(warc.records(table(spark, sf_dir, "pages")), folder)
    return warc.archived(spark, folder)


def op5_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_suffix_array(spark, sf_dir):
    return substring.removal_report(table(spark, sf_dir, "documents"))


def op7_embedding(spark, sf_dir):
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark, sf_dir):
    """Every source with equal weight; the copies in their global order."""
    return mixing.replicate(table(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    dealt = sharding.assign(docs, "doc_id", SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_training_order(spark, sf_dir):
    """Writes the shards, then reads every slot back and compares it with the index."""
    folder = training_order.order_folder(spark)
    index = training_order.write_training_order(table(spark, sf_dir, "documents"), folder)
    read = training_order.read_training_order(spark, folder, index.count())
    # What a task reads from the files is larger than the planner can know: no broadcast.
    found = read.select("slot", F.crc32("ids").alias("found")).hint("merge")
    return index.join(found, "slot").select(
        "slot", "shard", "n_tokens", "ids_crc32", "doc_ids", (F.col("found") == F.col("record_crc32")).alias("read_back")
    )


def op11_fill_middle(spark, sf_dir):
    return fill_middle.digest(table(spark, sf_dir, "documents"))


def op12_importance(spark, sf_dir):
    return importance.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sentencepiece(spark, sf_dir):
    return pieces.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license": op1_license,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_suffix_array": op6_suffix_array,
    "op7_embedding": op7_embedding,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_training_order": op10_training_order,
    "op11_fill_middle": op11_fill_middle,
    "op12_importance": op12_importance,
    "op13_sentencepiece": op13_sentencepiece,
}
ORACLE: dict[str, str] = {"op11_fill_middle": fill_middle.SQL, "op12_importance": importance.SQL}
