"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from folioflow.llm import collocations, hmm, jaccard, licenses, linededup, media, mixing, pieces, resampling, simhash, toxicity, urlfilter, winnowing


def queries() -> dict:
    return {
        "op1_license_digests": licenses.op1_license_digests,
        "op2_signatures": media.op2_signatures,
        "op3_hmm": hmm.op3_hmm,
        "op4_line_windows": linededup.op4_line_windows,
        "op5_text_cnn": toxicity.op5_text_cnn,
        "op6_pivotal_mix": mixing.op6_pivotal_mix,
        "op7_winnowing": winnowing.op7_winnowing,
        "op8_url_lm": urlfilter.op8_url_lm,
        "op9_merge_dropout": pieces.op9_merge_dropout,
        "op10_simhash_balls": simhash.op10_simhash_balls,
        "op11_jaccard_product": jaccard.op11_jaccard_product,
        "op12_trie_resampling": resampling.op12_trie_resampling,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict:
    return {"op1_license_digests": licenses.SQL, "op4_line_windows": linededup.SQL, "op8_url_lm": urlfilter.SQL, "op11_jaccard_product": jaccard.SQL, "op12_trie_resampling": resampling.SQL, "op13_collocations": collocations.SQL}
