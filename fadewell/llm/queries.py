"""Registered queries of the corpus operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fadewell.session import ensure_checkpoint_dir

from . import decontaminate, embeddings, html, language, oracles, packing, planes, prefixtree, secrets, sharding, simhash, substrings, suffixes, whitening
from .shared import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bit_planes(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    path = f"{ensure_checkpoint_dir(spark)}/planes-{uuid.uuid4().hex}"
    planes.write_planes(planes.encode_planes(table(spark, sf, "documents"), tokenizer_path()), path)
    return planes.read_planes(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_secret_automaton(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf, "documents"))


def op3_simhash_bk_trees(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.fingerprint_groups(spark, table(spark, sf, "documents"))


def op4_site_style_tree(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract(spark, table(spark, sf, "pages"))


def op5_iterative_quantisation(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.near_vectors(spark, table(spark, sf, "embeddings"))


def op6_rendezvous(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_records(spark, table(spark, sf, "documents"))


def op7_seed_and_extend(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.remove_repeats(spark, table(spark, sf, "documents"))


def op8_simhash_windows(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(spark, table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op9_nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


def op10_residual_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack_documents(spark, table(spark, sf, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_ternary_trees(spark: SparkSession, sf: str) -> DataFrame:
    return prefixtree.conversation_tree(spark, table(spark, sf, "conversations"))


def op12_two_stage_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.remove_repeats(spark, table(spark, sf, "documents"))


def op13_qdwh_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(spark, table(spark, sf, "embeddings"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_bit_planes, op2_secret_automaton, op3_simhash_bk_trees, op4_site_style_tree, op5_iterative_quantisation, op6_rendezvous,
    op7_seed_and_extend, op8_simhash_windows, op9_nearest_centroid, op10_residual_packing, op11_ternary_trees, op12_two_stage_suffixes,
    op13_qdwh_whitening, pipeline)}

#: Tokenizers, XXH64, learned models and matrix functions are not in SQL; the tests compare those with brute force.
ORACLES: dict[str, str] = {"op11_ternary_trees": oracles.PREFIX_TREE, "op12_two_stage_suffixes": oracles.SUFFIX_REPEATS}
