"""Assembled study plans: responses -> extracted -> scored -> summaries.

The scored table feeds several summaries; ``scored_responses(...,
materialize=True)`` checkpoints it once into the shared checkpoint folder so
each consumer starts from the written table, not from the raw text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import strip_run_suffix
from vigil.operators.extract import extract_and_clean
from vigil.operators.lexicon import DEFAULT_STOPWORDS, lexicon_scores
from vigil.session import materialize as _materialize


def with_perspective(df: DataFrame, combine_runs: bool = True, run: str = "perspective_run") -> DataFrame:
    p = strip_run_suffix(F.col(run)) if combine_runs else F.col(run)
    return df.withColumn("perspective", p)


def lexicon_scored_responses(responses: DataFrame, lexicon: DataFrame, col: str = "response",
                             categories: Sequence[str] | None = None,
                             stopwords=DEFAULT_STOPWORDS, combine_runs: bool = True,
                             materialize: bool = False, **kw) -> DataFrame:
    """Extract answers, drop incomplete rows, score ``col`` with the lexicon."""
    kept = extract_and_clean(responses, "response")
    scored = lexicon_scores(kept, lexicon, col=col, categories=categories, stopwords=stopwords, **kw)
    scored = with_perspective(scored, combine_runs)
    return _materialize(scored) if materialize else scored
