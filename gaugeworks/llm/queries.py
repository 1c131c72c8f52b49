"""The training-data queries, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from .exact_dedup import OP6_SQL, op6_exact_dedup
from .language import op4_language_id
from .media import op1_media_columns
from .mixing import op5_source_mixing
from .packing import op8_bestfit_packing
from .passages import op7_substring_dedup
from .quality import op2_quality_classifier
from .secrets import op10_secret_scan
from .simhash import op3_simhash_neardup
from .url_filter import OP9_SQL, op9_url_filter

QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_simhash_neardup": op3_simhash_neardup,
    "op4_language_id": op4_language_id,
    "op5_source_mixing": op5_source_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_bestfit_packing": op8_bestfit_packing,
    "op9_url_filter": op9_url_filter,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE_SQL = {"op6_exact_dedup": OP6_SQL, "op9_url_filter": OP9_SQL}
