"""The queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from .jaccard import op7_grouped_prefix_join
from .language import op4_language_codes
from .media import op10_avi_clips
from .mixing import op6_mixing
from .outliers import op3_robust_outliers
from .packing import op1_packing
from .quality import op9_site_quality
from .secrets import op2_secret_scan
from .token_counts import op8_token_counts
from .token_files import op5_token_files


def queries():
    return {
        "op1_packing": op1_packing,
        "op2_secret_scan": op2_secret_scan,
        "op3_robust_outliers": op3_robust_outliers,
        "op4_language_codes": op4_language_codes,
        "op5_token_files": op5_token_files,
        "op6_mixing": op6_mixing,
        "op7_grouped_prefix_join": op7_grouped_prefix_join,
        "op8_token_counts": op8_token_counts,
        "op9_site_quality": op9_site_quality,
        "op10_avi_clips": op10_avi_clips,
    }


def oracle_sql():
    """None of these is expressible in SQL: tokenizers, trained models and file formats are tested by brute force or round trips."""
    return {}
