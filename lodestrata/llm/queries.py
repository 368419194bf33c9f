"""The queries of this subpackage's operators and, where SQL can express them, their DuckDB equivalents."""

from .bpe import op4_byte_level_bpe
from .credentials import OP12_SQL, op12_secret_scan
from .licenses import op5_license_scan
from .lm import op7_lm_score
from .media import op3_media_columns
from .packing import op2_best_fit_packing
from .pii import op6_pii_pseudonyms
from .quality import op8_quality_rules
from .resampling import OP13_SQL, op13_importance_resampling
from .simhash import op9_simhash
from .spelling import OP11_SQL, op11_spelling_variants
from .substrings import OP1_SQL, op1_substring_dedup
from .toxicity import op10_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op4_byte_level_bpe": op4_byte_level_bpe,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_media_columns": op3_media_columns,
    "op5_license_scan": op5_license_scan,
    "op6_pii_pseudonyms": op6_pii_pseudonyms,
    "op7_lm_score": op7_lm_score,
    "op8_quality_rules": op8_quality_rules,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_secret_scan": op12_secret_scan,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op11_spelling_variants": OP11_SQL, "op12_secret_scan": OP12_SQL, "op13_importance_resampling": OP13_SQL}
