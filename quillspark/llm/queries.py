"""Queries and DuckDB SQL of the training-data operators, one ``opN_<name>`` each, and of the pipeline."""

from __future__ import annotations

from quillspark.llm.decontamination import OP4_SQL, op4_decontaminate
from quillspark.llm.importance import op5_quality_classifier
from quillspark.llm.language_id import op1_language_id
from quillspark.llm.near_dedup import OP10_SQL, op10_near_dedup
from quillspark.llm.ngram_join import OP11_SQL, op11_ngram_join
from quillspark.llm.pieces import op8_sampled_pieces
from quillspark.llm.pii import op9_personal_data
from quillspark.llm.quality_rules import OP2_SQL, op2_quality_rules
from quillspark.llm.resampling import OP13_SQL, op13_importance_resampling
from quillspark.llm.sharding import op3_external_shuffle
from quillspark.llm.suffix_dedup import OP7_SQL, op7_suffix_dedup
from quillspark.llm.vector_codes import OP12_SQL, op12_vector_codes
from quillspark.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality_rules": op2_quality_rules,
    "op3_external_shuffle": op3_external_shuffle,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_warc": op6_warc,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_sampled_pieces": op8_sampled_pieces,
    "op9_personal_data": op9_personal_data,
    "op10_near_dedup": op10_near_dedup,
    "op11_ngram_join": op11_ngram_join,
    "op12_vector_codes": op12_vector_codes,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE_SQL = {
    "op2_quality_rules": OP2_SQL,
    "op4_decontaminate": OP4_SQL,
    "op6_warc": OP6_SQL,
    "op7_suffix_dedup": OP7_SQL,
    "op10_near_dedup": OP10_SQL,
    "op11_ngram_join": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
