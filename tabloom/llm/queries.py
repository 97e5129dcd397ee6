"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, cover_tree, decontamination, heavy_dedup, jaccard_join, licenses, merkle, mixing, quality, secrets, sharding, suffix_dedup, token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontamination.op1_decontaminate,
    "op2_shard_tree": sharding.op2_shard_tree,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_near_vectors": cover_tree.op4_near_vectors,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_quality": quality.op6_quality,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_mix": mixing.op9_mix,
    "op10_token_store": token_store.op10_token_store,
    "op11_heavy_dedup": heavy_dedup.op11_heavy_dedup,
    "op12_collocations": collocations.op12_collocations,
    "op13_merkle": merkle.op13_merkle,
}

#: Hashes, fingerprints, checksums, tokenizers and fitted models have no SQL form; tests/llm has brute force for the others.
ORACLE_SQL: dict[str, str] = {"op1_decontaminate": decontamination.OP1_SQL, "op4_near_vectors": cover_tree.OP4_SQL, "op7_jaccard_join": jaccard_join.OP7_SQL,
                              "op9_mix": mixing.OP9_SQL, "op11_heavy_dedup": heavy_dedup.OP11_SQL, "op12_collocations": collocations.OP12_SQL,
                              "op13_merkle": merkle.OP13_SQL}
