"""The queries of this subpackage, and the SQL that gives the same rows where there is such."""

from __future__ import annotations

import corpus_pipeline

from .exact_dedup import OP6_SQL, op6_exact_dedup
from .line_dedup import op9_line_dedup
from .lm_score import op5_lm_score
from .mixing import OP4_SQL, op4_mix_sources
from .sentencepiece_bpe import op8_sentencepiece
from .sharding import OP3_SQL, op3_feistel_shards
from .simhash_dedup import op1_simhash_near_dedup
from .spotsigs import OP7_SQL, op7_spotsigs
from .toxicity import op10_toxicity
from .url_filter import OP2_SQL, op2_url_filter

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_feistel_shards": op3_feistel_shards,
    "op4_mix_sources": op4_mix_sources,
    "op5_lm_score": op5_lm_score,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_spotsigs": op7_spotsigs,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
}
SQL = {"op2_url_filter": OP2_SQL, "op3_feistel_shards": OP3_SQL, "op4_mix_sources": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op7_spotsigs": OP7_SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
