"""The queries of this subpackage and their DuckDB SQL, for the entry module."""

from __future__ import annotations

from . import balltree, debruijn, decontamination, jaccard, lmscore, mixing, oracles, pieces, quality, sharding, suffixes, toxicity, trie, urlfilter


def queries() -> dict:
    return {
        "op1_robust_outliers": quality.op1_robust_outliers,
        "op2_sparse_suffix_array": suffixes.op2_sparse_suffix_array,
        "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
        "op4_url_digests": urlfilter.op4_url_digests,
        "op5_spaced_seeds": decontamination.op5_spaced_seeds,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_temperature_mix": mixing.op7_temperature_mix,
        "op8_minimax_shards": sharding.op8_minimax_shards,
        "op9_cross_entropy_difference": lmscore.op9_cross_entropy_difference,
        "op10_debruijn_dedup": debruijn.op10_debruijn_dedup,
        "op11_prefix_trie": trie.op11_prefix_trie,
        "op12_ball_tree": balltree.op12_ball_tree,
        "op13_pieces": pieces.op13_pieces,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_digests": urlfilter.oracle(), "op5_spaced_seeds": decontamination.oracle(), "op2_sparse_suffix_array": oracles.passages(), "op3_ngram_jaccard": oracles.jaccard(), "op9_cross_entropy_difference": oracles.cross_entropy(lmscore.PAIR_MASS, lmscore.WORD_MASS, lmscore.WORDS), "op8_minimax_shards": oracles.minimax(), "op10_debruijn_dedup": oracles.dedup(), "op11_prefix_trie": trie.oracle(), "op12_ball_tree": balltree.oracle()}
