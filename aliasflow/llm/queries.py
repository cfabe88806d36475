"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, mixing, near_dedup, substring_dedup, warc
from .ann import op2_ivf_pq
from .decontaminate import op3_decontamination
from .html_extract import op5_html_extraction
from .lm_scoring import op1_lm_scoring
from .mixing import op7_source_mixing
from .near_dedup import op9_minhash_near_dedup
from .pii import op10_pii
from .substring_dedup import op4_substring_dedup
from .toxicity import op6_toxicity
from .warc import op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_ivf_pq": op2_ivf_pq,
        "op3_decontamination": op3_decontamination,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_html_extraction": op5_html_extraction,
        "op6_toxicity": op6_toxicity,
        "op7_source_mixing": op7_source_mixing,
        "op8_warc": op8_warc,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontamination": decontaminate.ORACLE,
        "op4_substring_dedup": substring_dedup.ORACLE,
        "op7_source_mixing": mixing.ORACLE,
        "op8_warc": warc.ORACLE,
        "op9_minhash_near_dedup": near_dedup.ORACLE,
    }
