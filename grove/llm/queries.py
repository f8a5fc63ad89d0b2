"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op3_benchmark_decontamination
from .digest import op10_document_fingerprints
from .kneser_ney import op9_quality
from .langid import op1_language_id
from .packing import op6_best_fit_packing
from .secrets import OP4_SQL, op4_secret_scans
from .simhash import op5_simhash_near_dedup
from .tokens import op2_token_counts
from .toxicity import op7_toxicity
from .warc import OP8_SQL, op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_token_counts": op2_token_counts,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_secret_scans": op4_secret_scans,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_toxicity": op7_toxicity,
        "op8_warc": op8_warc,
        "op9_quality": op9_quality,
        "op10_document_fingerprints": op10_document_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_secret_scans": OP4_SQL, "op8_warc": OP8_SQL}
