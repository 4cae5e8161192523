"""A membership filter of bounded size for keys that are too many to broadcast.

``hash_bits`` folds the keys' hashes into words of 64 bits, at most ``2 ** log2_words``
rows whatever the number of keys; ``keep_possible`` broadcasts them and keeps the rows
whose bit is set.  Rows with a key always stay; some others do too, so a join follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^20 words: 67 million bits in at most 16 MB.
LOG2_WORDS = 20


def _word_and_bit(key: str, log2_words: int):
    h = F.xxhash64(F.col(key))
    return h.bitwiseAND(F.lit((1 << log2_words) - 1).cast("long")), F.shiftrightunsigned(h, 58).cast("int")


def hash_bits(keys: DataFrame, key: str, log2_words: int = LOG2_WORDS) -> DataFrame:
    """(word, bits) of the keys' hashes; nulls are left out."""
    word, bit = _word_and_bit(key, log2_words)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return keys.where(F.col(key).isNotNull()).select(word.alias("__word"), one.alias("__one")) \
        .groupBy("__word").agg(F.bit_or("__one").alias("__bits"))


def keep_possible(df: DataFrame, key: str, bits: DataFrame, log2_words: int = LOG2_WORDS) -> DataFrame:
    """Rows of ``df`` whose key may be among those of ``bits``.  ``bits`` is small by construction and is broadcast."""
    word, bit = _word_and_bit(key, log2_words)
    probed = df.withColumn("__w", word).join(F.broadcast(bits), F.col("__w") == F.col("__word"))
    return probed.where(F.getbit("__bits", bit) == 1).drop("__w", "__word", "__bits")
