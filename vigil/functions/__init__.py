"""Column-expression builders (all JVM-side, no Python per row)."""

from vigil.functions.text import (tokenize, strip_run_suffix, short_model_name,
                                  render_template, sanitize_name)
from vigil.functions.jsonx import with_answer_reason
from vigil.functions.numeric import (is_yes, nan_to_null, safe_ratio, round_half_even,
                                     coerce_numeric_col)
from vigil.functions.hashing import unit_hash, poisson1_weight
from vigil.functions.stopwords import english_stopwords

__all__ = [
    "tokenize", "strip_run_suffix", "short_model_name", "render_template", "sanitize_name",
    "with_answer_reason", "is_yes", "nan_to_null", "safe_ratio",
    "round_half_even", "coerce_numeric_col", "unit_hash", "poisson1_weight",
    "english_stopwords",
]
