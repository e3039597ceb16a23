"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stipule.llm.langid import op6_langid
from stipule.llm.media import op3_audio
from stipule.llm.minhash import op2_minhash
from stipule.llm.mixing import op4_mixing
from stipule.llm.neighbours import op7_neighbours
from stipule.llm.packing import op5_packing
from stipule.llm.pii import op9_pii
from stipule.llm.repeats import op8_repeats
from stipule.llm.tokencount import op1_tokencount
from stipule.llm.toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tokencount": op1_tokencount,
    "op2_minhash": op2_minhash,
    "op3_audio": op3_audio,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_langid": op6_langid,
    "op7_neighbours": op7_neighbours,
    "op8_repeats": op8_repeats,
    "op9_pii": op9_pii,
    "op10_toxicity": op10_toxicity,
}

SQL: dict[str, str] = {}
