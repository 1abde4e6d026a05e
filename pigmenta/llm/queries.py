"""Queries of this package and, where SQL can express them, their oracles."""

from __future__ import annotations

import corpus_pipeline

from .compression import op13_compression
from .decontaminate import op10_decontamination
from .importance import op11_importance
from .lm import op7_lm_scores
from .merkle import op12_merkle
from .mixing import op1_mixing
from .ngram_join import op5_ngram_jaccard
from .pii import op2_pii
from .quality import op8_quality_rules
from .secrets import op6_secrets
from .sharding import op3_sharding
from .sql import SQL
from .substring_dedup import op4_substring_dedup
from .warc import op9_warc

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_pii": op2_pii,
    "op3_sharding": op3_sharding,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_secrets": op6_secrets,
    "op7_lm_scores": op7_lm_scores,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc": op9_warc,
    "op10_decontamination": op10_decontamination,
    "op11_importance": op11_importance,
    "op12_merkle": op12_merkle,
    "op13_compression": op13_compression,
    "pipeline": corpus_pipeline.run,
}

__all__ = ["QUERIES", "SQL"]
