"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from stratavec.llm import annsearch, bytebpe, langid, linededup, ngramjoin, packing, pii, quality, tokens, warc


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_byte_bpe": bytebpe.op2_byte_bpe,
        "op3_vector_search": annsearch.op3_vector_search,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_warc": warc.op5_warc,
        "op6_token_counts": tokens.op6_token_counts,
        "op7_pii": pii.op7_pii,
        "op8_ngram_jaccard": ngramjoin.op8_ngram_jaccard,
        "op9_line_dedup": linededup.op9_line_dedup,
        "op10_language_id": langid.op10_language_id,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality.OP4_SQL, "op5_warc": warc.OP5_SQL, "op8_ngram_jaccard": ngramjoin.OP8_SQL}
