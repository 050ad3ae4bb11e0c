"""The queries of this package and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulseframe.llm.bpe import op5_bpe
from pulseframe.llm.conversations import op11_conversation_repair
from pulseframe.llm.fingerprints import op4_paragraph_sketch
from pulseframe.llm.licenses import op6_license_scan
from pulseframe.llm.mil import op10_mil_quality
from pulseframe.llm.packing import op1_length_buckets
from pulseframe.llm.quality_rules import op8_quality_rules
from pulseframe.llm.secrets import OP9_SQL, op9_secret_scan
from pulseframe.llm.simhash import op3_simhash
from pulseframe.llm.substrings import OP7_SQL, op7_substring_dedup
from pulseframe.llm.vptrees import op13_vantage_search
from pulseframe.llm.warc import OP2_SQL, op2_warc_revisit
from pulseframe.llm.whitening import op12_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_length_buckets,
        op2_warc_revisit,
        op3_simhash,
        op4_paragraph_sketch,
        op5_bpe,
        op6_license_scan,
        op7_substring_dedup,
        op8_quality_rules,
        op9_secret_scan,
        op10_mil_quality,
        op11_conversation_repair,
        op12_embedding_whitening,
        op13_vantage_search,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_revisit": OP2_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op9_secret_scan": OP9_SQL,
}
