"""Registered queries of the operators over the shared tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm import arc, hard_negatives, neighbours, packing, pieces, prob_minhash, roles, spelling, suffix_groups, tiled_cosine, token_files, transducer, winnowing
from sessionlens.llm.common import read
from sessionlens.session import checkpoint_dir

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tiled_cosine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiled_cosine.linked(read(spark, sf_dir, "embeddings"))


def token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE), end_id=2)
    docs = token_files.read_documents(spark, path)
    return docs.select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))


def arc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    arc.write_arc(read(spark, sf_dir, "pages"), f"{path}/arc")
    arc.write_warc(arc.with_revisits(arc.read_arc(spark, f"{path}/arc")), f"{path}/warc")
    records = arc.read_warc(spark, f"{path}/warc")
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_key").alias("refers_to"))


def neighbours_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def roles_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.repaired(read(spark, sf_dir, "conversations"))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), 2048, end_id=0)
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(digests, 2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def prob_minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.near_copies(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def suffix_groups_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_groups.removal_report(read(spark, sf_dir, "documents"))


def pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path(PIECES)
    rows = pieces.decoded(pieces.encoded(read(spark, sf_dir, "documents"), model), model)
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


def winnowing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(read(spark, sf_dir, "documents"))


def hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # One label in seven is wrong, so that hard negatives are told by their scores.
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = F.when(finite, F.transform(x, lambda v: F.floor(v * 256)))
    return hard_negatives.mine(rows.select(F.col("vec_id").alias("id"), label.alias("label"), vectors.alias("vector"), (F.col("vec_id") % 50 == 0).alias("is_anchor")))


def spelling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES)).withColumn("over_limit", F.col("n_tokens") > 4096)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tiled_cosine": tiled_cosine_query,
    "op2_token_files": token_files_query,
    "op3_arc": arc_query,
    "op4_neighbours": neighbours_query,
    "op5_roles": roles_query,
    "op6_packing": packing_query,
    "op7_prob_minhash": prob_minhash_query,
    "op8_suffix_groups": suffix_groups_query,
    "op9_pieces": pieces_query,
    "op10_winnowing": winnowing_query,
    "op11_hard_negatives": hard_negatives_query,
    "op12_spelling": spelling_query,
    "op13_token_counts": token_counts_query,
}
