"""Scans and sinks: driver tables, response files, lexicons."""

from vigil.sources.tables import read_table
from vigil.sources.fixtures import json_responses, scored_rows, small_lexicon
from vigil.sources.lexicon import read_lexicon, read_dic_lexicon

__all__ = ["read_table", "json_responses", "scored_rows", "small_lexicon",
           "read_lexicon", "read_dic_lexicon"]
