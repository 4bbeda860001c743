"""Registry of the training-data queries and their DuckDB SQL."""

from __future__ import annotations

from claimforge.llm import oracles
from claimforge.llm.decontaminate import op13_benchmark_decontamination
from claimforge.llm.html_extract import op4_html_consensus
from claimforge.llm.mixing import op8_source_mixing
from claimforge.llm.periodic import op12_periodic_runs
from claimforge.llm.prefix_bpe import op9_prefix_bpe
from claimforge.llm.quality import op10_ordinal_quality
from claimforge.llm.rlz_dedup import op1_rlz_substring_dedup
from claimforge.llm.simhash_golay import op5_simhash_near_dedup
from claimforge.llm.suffix_dedup import op7_suffix_array_dedup
from claimforge.llm.trie import op11_conversation_trie
from claimforge.llm.url_filter import op3_url_filter
from claimforge.llm.vectors import op2_kdtree_top_k, op6_vptree_ann

QUERIES = (
    op1_rlz_substring_dedup,
    op2_kdtree_top_k,
    op3_url_filter,
    op4_html_consensus,
    op5_simhash_near_dedup,
    op6_vptree_ann,
    op7_suffix_array_dedup,
    op8_source_mixing,
    op9_prefix_bpe,
    op10_ordinal_quality,
    op11_conversation_trie,
    op12_periodic_runs,
    op13_benchmark_decontamination,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_rlz_substring_dedup": oracles.OP1, "op2_kdtree_top_k": oracles.OP2, "op7_suffix_array_dedup": oracles.OP7, "op11_conversation_trie": oracles.OP11, "op12_periodic_runs": oracles.OP12, "op13_benchmark_decontamination": oracles.OP13}
