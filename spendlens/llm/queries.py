"""All queries of this package (importing it registers them)."""

from . import q_alignment, q_bpe, q_decontaminate, q_importance, q_jaccard, q_license, q_lm_score, q_pu_quality, q_quality_rules, q_shards, q_token_files, q_url_filter, q_warc  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
