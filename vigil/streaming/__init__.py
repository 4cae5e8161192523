"""Structured Streaming entry points for the row-wise stages.

Extraction (E1-E4) and lexicon scoring (L1-L7) are stateless per row, so the
same column expressions run on a streaming DataFrame; the yes-ratio summary
(A2) runs as a streaming aggregate with Spark-managed state.
"""

from vigil.streaming.rowwise import scored_stream, start_scored_sink, streaming_yes_counts

__all__ = ["scored_stream", "start_scored_sink", "streaming_yes_counts"]
