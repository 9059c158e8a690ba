"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from catalogspark.llm import queries_chat, queries_filter_audit, queries_gif, queries_jaccard, queries_line_dedup, queries_lm, queries_mixing, queries_negatives, queries_pii, queries_pipeline, queries_sentencepiece, queries_topk, queries_toxicity, queries_warc

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (queries_chat, queries_filter_audit, queries_gif, queries_jaccard, queries_line_dedup, queries_lm, queries_mixing, queries_negatives, queries_pii, queries_pipeline, queries_sentencepiece, queries_topk, queries_toxicity, queries_warc):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
