"""Defaults of the study's tools, in one place."""

from __future__ import annotations

from dataclasses import dataclass

_CONTRIBUTION = "Summarize the main contribution of this paper"
_FINDINGS = "Summarize the proposed method and main findings of this paper"
_PROBLEM = "What problem does this paper address and how does it solve it?"
QUERIES = (_CONTRIBUTION, _FINDINGS, _PROBLEM)
K_VALUES = (1, 3, 5, 10)
SEED = 42


@dataclass(frozen=True)
class Chunking:
    max_words: int = 150
    overlap_words: int = 30
    min_words: int = 40
    hard_max_words: int = 180
    min_section_words: int = 10
    heading_chars: int = 120
    heading_words: int = 12
    title_share: float = 0.6
    fallback_from_words: int = 120
    fallback_below_chunks: int = 3


@dataclass(frozen=True)
class Targets:
    min_words: int = 20
    max_words: int = 512


@dataclass(frozen=True)
class Inputs:
    query_words: int = 80
    context_words: int = 180
    input_words: int = 950
    target_words: int = 512


@dataclass(frozen=True)
class Build:
    train_limit: int = 20_000
    valid_limit: int = 1_000
    test_limit: int = 500
    noise_pool_limit: int = 10_000
    test_pool_offset: int = 30_000
    final_k: int = 3
    noise_k: int = 2
    min_chunks: int = 3
    substitutive_clean_k: int = 1
    mmr_lambda: float = 0.5
    oversample: float = 1.35


@dataclass(frozen=True)
class Evaluation:
    max_source_tokens: int = 1024
    max_target_tokens: int = 512
    summary_resamples: int = 2_000
    test_resamples: int = 10_000
    xlsx_rows: int = 50_000


#: Subword tokens of a word, by tokenizer family, where no tokenizer is plugged in.
TOKENS_PER_WORD = {"bart": 1.43, "t5": 1.82}
CHUNKING, TARGETS, INPUTS, BUILD, EVALUATION = Chunking(), Targets(), Inputs(), Build(), Evaluation()
