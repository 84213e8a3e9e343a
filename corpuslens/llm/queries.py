"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from corpuslens.llm.jaccard_join import OP4_SQL, op4_jaccard_join
from corpuslens.llm.language_id import op7_language_id
from corpuslens.llm.mixing import OP8_SQL, op8_mixing
from corpuslens.llm.packing import op1_packing
from corpuslens.llm.periodic_runs import OP13_SQL, op13_periodic_runs
from corpuslens.llm.pii import op2_pii
from corpuslens.llm.quality_classifier import op6_quality_classifier
from corpuslens.llm.quality_rules import OP5_SQL, op5_quality_rules
from corpuslens.llm.spelling_variants import OP11_SQL, op11_spelling_variants
from corpuslens.llm.substring_dedup import OP3_SQL, op3_substring_dedup
from corpuslens.llm.suffix_dedup import OP12_SQL, op12_suffix_dedup
from corpuslens.llm.token_counts import op9_token_counts
from corpuslens.llm.vector_search import op10_vector_search


def queries() -> dict:
    found = (op1_packing, op2_pii, op3_substring_dedup, op4_jaccard_join, op5_quality_rules, op6_quality_classifier, op7_language_id, op8_mixing, op9_token_counts, op10_vector_search,
             op11_spelling_variants, op12_suffix_dedup, op13_periodic_runs)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": OP3_SQL, "op4_jaccard_join": OP4_SQL, "op5_quality_rules": OP5_SQL, "op8_mixing": OP8_SQL,
        "op11_spelling_variants": OP11_SQL, "op12_suffix_dedup": OP12_SQL, "op13_periodic_runs": OP13_SQL,
    }
