"""The queries of this package, by name, and the SQL that gives the same rows where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, line_dedup, parity_join, substring_dedup
from millrace.llm.byte_bpe import op9_byte_bpe
from millrace.llm.decontaminate import op1_decontaminate
from millrace.llm.language import op5_language
from millrace.llm.line_dedup import op7_line_dedup
from millrace.llm.lsh_forest import op3_lsh_forest
from millrace.llm.parity_join import op6_parity_join
from millrace.llm.quality import op8_quality
from millrace.llm.rans import op2_rans_tokens
from millrace.llm.substring_dedup import op10_substring_dedup
from millrace.llm.url_filter import op4_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_rans_tokens": op2_rans_tokens,
    "op3_lsh_forest": op3_lsh_forest,
    "op4_url_filter": op4_url_filter,
    "op5_language": op5_language,
    "op6_parity_join": op6_parity_join,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op6_parity_join": parity_join.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
}
