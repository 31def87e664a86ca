"""The numbered operators' queries and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.exact_dedup import ORACLE as EXACT_SQL
from tessella.llm.exact_dedup import op1_exact_dedup
from tessella.llm.filter_audit import ORACLE as AUDIT_SQL
from tessella.llm.filter_audit import op13_filter_audit
from tessella.llm.fingerprints import op10_fingerprints
from tessella.llm.hard_negatives import ORACLE as NEGATIVES_SQL
from tessella.llm.hard_negatives import op11_hard_negatives
from tessella.llm.language_model import op2_language_model
from tessella.llm.line_dedup import ORACLE as LINES_SQL
from tessella.llm.line_dedup import op12_line_dedup
from tessella.llm.mixing import op8_mixing
from tessella.llm.near_dedup import op9_near_dedup
from tessella.llm.packing import op6_packing
from tessella.llm.quality import op7_quality
from tessella.llm.secrets import op4_secrets
from tessella.llm.sharding import op3_sharding
from tessella.llm.urls import op5_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each query applies its operator to its whole table."""
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_language_model": op2_language_model,
        "op3_sharding": op3_sharding,
        "op4_secrets": op4_secrets,
        "op5_url_filter": op5_url_filter,
        "op6_packing": op6_packing,
        "op7_quality": op7_quality,
        "op8_mixing": op8_mixing,
        "op9_near_dedup": op9_near_dedup,
        "op10_fingerprints": op10_fingerprints,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_line_dedup": op12_line_dedup,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those results that SQL can state."""
    return {"op1_exact_dedup": EXACT_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_line_dedup": LINES_SQL, "op13_filter_audit": AUDIT_SQL}
