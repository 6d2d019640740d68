"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from transcripta.llm import op1_repair_tokens as op1
from transcripta.llm import op10_bit_sliced_topk as op10
from transcripta.llm import op11_spelling_variants as op11
from transcripta.llm import op12_secular_whitening as op12
from transcripta.llm import op13_cross_parsing as op13
from transcripta.llm import op2_dart_minhash as op2
from transcripta.llm import op3_bounded_ring as op3
from transcripta.llm import op4_line_dedup as op4
from transcripta.llm import op5_quality_rules as op5
from transcripta.llm import op6_template_removal as op6
from transcripta.llm import op7_sentencepiece_fst as op7
from transcripta.llm import op8_licence_rules as op8
from transcripta.llm import op9_fair_queue_mix as op9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repair_tokens": op1.op1_repair_tokens,
    "op2_dart_minhash": op2.op2_dart_minhash,
    "op3_bounded_ring": op3.op3_bounded_ring,
    "op4_line_dedup": op4.op4_line_dedup,
    "op5_quality_rules": op5.op5_quality_rules,
    "op6_template_removal": op6.op6_template_removal,
    "op7_sentencepiece_fst": op7.op7_sentencepiece_fst,
    "op8_licence_rules": op8.op8_licence_rules,
    "op9_fair_queue_mix": op9.op9_fair_queue_mix,
    "op10_bit_sliced_topk": op10.op10_bit_sliced_topk,
    "op11_spelling_variants": op11.op11_spelling_variants,
    "op12_secular_whitening": op12.op12_secular_whitening,
    "op13_cross_parsing": op13.op13_cross_parsing,
}
ORACLES: dict[str, str] = {
    "op5_quality_rules": op5.ORACLE,
    "op8_licence_rules": op8.ORACLE,
    "op9_fair_queue_mix": op9.ORACLE,
    "op10_bit_sliced_topk": op10.ORACLE,
    "op11_spelling_variants": op11.ORACLE,
}
