"""The subpackage's registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontamination import op7_decontamination
from tessera.llm.divergence import OP13_SQL, op13_divergence
from tessera.llm.fingerprints import op9_fingerprints
from tessera.llm.language_id import op2_language_id
from tessera.llm.manifest import OP11_SQL, op11_manifest
from tessera.llm.mixing import OP6_SQL, op6_mixing
from tessera.llm.near_dedup import op10_near_dedup
from tessera.llm.neighbours import op12_neighbours
from tessera.llm.pii import op4_pii
from tessera.llm.quality import op1_quality
from tessera.llm.suffix_dedup import op8_suffix_dedup
from tessera.llm.token_counts import op3_token_counts
from tessera.llm.toxicity import op5_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_language_id": op2_language_id,
        "op3_token_counts": op3_token_counts,
        "op4_pii": op4_pii,
        "op5_toxicity": op5_toxicity,
        "op6_mixing": op6_mixing,
        "op7_decontamination": op7_decontamination,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_fingerprints": op9_fingerprints,
        "op10_near_dedup": op10_near_dedup,
        "op11_manifest": op11_manifest,
        "op12_neighbours": op12_neighbours,
        "op13_divergence": op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": OP6_SQL, "op11_manifest": OP11_SQL, "op13_divergence": OP13_SQL}
