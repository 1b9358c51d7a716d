"""Parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    stem: bool = True
    # weight of a word by the zone it stands in; a body word has 1
    w_title: int = 5
    w_head: int = 3
    w_bold: int = 2
    w_anchor: int = 2
    # near duplicates: fingerprints that share one of 4 bands of 16 bits and differ in at most so many bits
    max_hamming: int = 5
    # ranking
    alpha_unigram: float = 0.85
    beta_bigram: float = 0.15
    phrase_boost: float = 0.15
    top_k: int = 10
    min_results: int = 50
    # documents whose phrases are looked at, and candidates that are ranked, of a query; None for all
    phrase_docs: int | None = 5000
    max_candidates: int | None = 5000
