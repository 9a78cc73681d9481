"""Queries of this subpackage, and the SQL that gives the same rows where there is any."""

from . import brown_lm, collocations, cover_tree, exact_dedup, language_id, licenses, line_dedup, mixing, ngram_join, sentencepiece_dropout, simhash, source_divergence, toxicity

QUERIES = {
    "op1_sentencepiece": sentencepiece_dropout.op1_sentencepiece,
    "op2_cover_tree": cover_tree.op2_cover_tree,
    "op3_language_id": language_id.op3_language_id,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_mixing": mixing.op6_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op8_line_dedup_50_words": line_dedup.op8_line_dedup_50_words,
    "op9_licenses": licenses.op9_licenses,
    "op10_brown_lm": brown_lm.op10_brown_lm,
    "op11_source_divergence": source_divergence.op11_source_divergence,
    "op12_collocations": collocations.op12_collocations,
    "op13_simhash": simhash.op13_simhash,
}

ORACLES = {
    "op2_cover_tree": cover_tree.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op8_line_dedup_50_words": line_dedup.ORACLE_50_WORDS,
    "op11_source_divergence": source_divergence.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
