"""Queries of this subpackage, and their SQL where there is one."""

from . import byte_bpe, fill_middle, html_text, language_id, licenses, metric_join, ngram_jaccard, packing, period_runs, quality_classifier, quality_rules, token_counts, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        byte_bpe.op1_byte_bpe,
        quality_rules.op2_quality_rules,
        ngram_jaccard.op3_ngram_jaccard,
        language_id.op4_language_id,
        token_counts.op5_token_counts,
        licenses.op6_license_scans,
        quality_classifier.op7_quality_classifier,
        metric_join.op8_embedding_near_dedup,
        html_text.op9_html_extraction,
        packing.op10_best_fit_packing,
        period_runs.op11_period_runs,
        toxicity.op12_toxicity,
        fill_middle.op13_fill_in_middle,
    )
}
ORACLES = {"op2_quality_rules": quality_rules.OP2_SQL, "op13_fill_in_middle": fill_middle.OP13_SQL}
