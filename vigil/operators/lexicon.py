"""Lexicon scoring.

Per row: tokens = ASCII-letter runs of the lower-cased text; optional stopword
removal; each token found in the lexicon counts once for its category;
ratio = count / max(matched, 1); a foundation (the part of the category
before ``.``) sums its categories.

Two plans:

* ``inset`` (default): no shuffle and no row key.  The lexicon (a size-checked
  dimension table) becomes literal hash sets; one pass keeps the matched
  tokens, then small per-category passes count them.  Rows never move.
* ``join``: rows become (digest, token, count) vectors, which meet the lexicon
  and add up per text digest; the sums join back.  The text itself never travels.
  A lexicon checked small is broadcast into the scan.  For a larger one the vectors
  are packed into blocks, as places in a block's vocabulary, and only the vocabularies
  pass a bounded hash filter and a shuffle join; a block's vectors travel once, packed.
  Used for lexicons above ``max_inline_tokens``.

Stopword removal is applied to the lexicon, not per row: the ratio
denominator counts only matched tokens, so dropping stopword tokens before
matching equals dropping stopword entries from the lexicon.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.stopwords import english_stopwords
from vigil.functions.text import longest_entries, sanitize_name, token_counts, tokenize
from vigil.plans.bits import hash_bits, keep_possible
from vigil.plans.sizing import bounded_broadcast, collect_bounded, is_small
from vigil.session import materialize

DEFAULT_STOPWORDS = "english"
#: Categories that a lexicon may bring without being asked for; each makes two columns.
MAX_CATEGORIES = 2_000
#: Bytes of tokens in a block, about: what a task holds of the texts at a time.
BLOCK_CHARS = 32 << 20


def lexicon_map(lexicon: DataFrame, token: str = "token", category: str = "category",
                ordinal: str = "ordinal") -> DataFrame:
    """L1: lower-cased token -> category; for duplicates the last entry (max ordinal) wins."""
    return (lexicon.where(F.col(token).isNotNull())
            .groupBy(F.lower(F.col(token)).alias("token"))
            .agg(F.max_by(F.col(category), F.col(ordinal)).alias("category")))


def _stopword_list(stopwords) -> list[str]:
    if stopwords is None or stopwords is False:
        return []
    if stopwords is True or stopwords == DEFAULT_STOPWORDS:
        return list(english_stopwords())
    return [str(w).lower() for w in stopwords]


def remove_stopwords(token_map: DataFrame, stopwords=DEFAULT_STOPWORDS) -> DataFrame:
    """L3 (lexicon side): drop entries whose token is a stopword."""
    words = _stopword_list(stopwords)
    if not words:
        return token_map
    return token_map.where(~F.col("token").isin(words))


def foundations_of(categories: Sequence[str]) -> list[str]:
    seen = []
    for c in categories:
        f = c.split(".", 1)[0]
        if f not in seen:
            seen.append(f)
    return seen


def _count_columns(counts: dict[str, Column], matched: Column, foundations: Sequence[str]) -> dict:
    denom = F.greatest(matched, F.lit(1)).cast("double")
    out = {}
    for cat, c in counts.items():
        n = sanitize_name(cat)
        out[f"{n}_count"] = c.cast("long")
        out[f"{n}_ratio"] = c.cast("double") / denom
    for f in foundations:
        parts = [counts[c] for c in counts if c.split(".", 1)[0] == f]
        total = sum(parts[1:], parts[0]) if parts else F.lit(0)
        out[f"{sanitize_name(f)}_count"] = total.cast("long")
        out[f"{sanitize_name(f)}_ratio"] = total.cast("double") / denom
    return out


def _count_in(arr: Column, words: list[str]) -> Column:
    # Built in a helper so the lambda closes over its own list.
    return F.size(F.filter(arr, lambda t: t.isin(words)))


def lexicon_scores(df: DataFrame, lexicon: DataFrame, col: str = "response",
                   categories: Sequence[str] | None = None,
                   foundations: Sequence[str] | None = None,
                   stopwords=DEFAULT_STOPWORDS, strategy: str = "auto",
                   max_inline_tokens: int = 50_000,
                   keep_matched: bool = False, max_broadcast_tokens: int = 2_000_000, phrases: bool = False) -> DataFrame:
    """Append ``<category>_count/_ratio`` and ``<foundation>_count/_ratio``.

    ``categories`` fixes the output schema (default: the lexicon's categories,
    sorted).  Absent categories give 0 counts and 0 ratios.  Both plans give
    the same rows: a row needs no key, and its score depends on its text only.

    ``phrases``: entries of several words match too (by default they never do, as tokens
    are single words).  Entries are cut into tokens like texts; at each place of a text the
    longest entry counts, once, and matching goes on behind it.  Needs the ``inset`` plan.
    """
    if phrases:
        if strategy == "join":
            raise ValueError("phrases need the 'inset' plan")
        strategy = "inset"
        words = F.array_join(tokenize("token", null_as=None), " ")
        lexicon = lexicon.withColumn("token", words).where(F.col("token") != "")
    token_map = remove_stopwords(lexicon_map(lexicon), stopwords)
    if strategy not in ("auto", "inset", "join"):
        raise ValueError(f"unknown strategy {strategy!r}")
    pairs = None
    if strategy in ("auto", "inset"):
        pairs = collect_bounded(token_map.select("token", "category"), max_inline_tokens)
        if pairs is None and strategy == "inset":
            raise ValueError(f"lexicon larger than max_inline_tokens={max_inline_tokens}")
    if categories is None:
        # Every category the lexicon names gets a column, even when stopword
        # removal or a later duplicate leaves it without tokens.
        found = collect_bounded(lexicon.select("category").where(F.col("category").isNotNull()).distinct(), MAX_CATEGORIES)
        if found is None:  # one output column each
            raise ValueError(f"lexicon with more than {MAX_CATEGORIES} categories; name the wanted ones in categories=")
        categories = sorted(r[0] for r in found)
    categories = list(dict.fromkeys(categories))
    foundations = list(foundations) if foundations is not None else foundations_of(categories)

    if pairs is not None:
        by_cat: dict[str, list[str]] = {c: [] for c in categories}
        for tok, cat in pairs:
            if cat in by_cat:
                by_cat[cat].append(tok)
        vocab = [t for ws in by_cat.values() for t in ws]
        tokens = tokenize(F.col(col))
        if phrases:
            matched_tokens = longest_entries(tokens, vocab)
        else:
            matched_tokens = F.filter(tokens, lambda t: t.isin(vocab)) if vocab else F.array().cast("array<string>")
        tmp = "__vigil_matched"
        staged = df.withColumn(tmp, matched_tokens)
        m = F.col(tmp)
        counts = {c: (_count_in(m, ws) if ws else F.lit(0)) for c, ws in by_cat.items()}
        cols = _count_columns(counts, F.size(m), foundations)
        if keep_matched:
            cols["matched_count"] = F.size(m).cast("long")
        return staged.withColumns(cols).drop(tmp)

    # Scores depend on the text alone, so the text's digest is the key: rows
    # keep apart whatever their own keys are, and equal texts are scored alike.
    # What travels is (digest, token, count) of tokens that may match; a text
    # stays in its scan, unless the caller selects it from the result.
    digest = F.unhex(F.md5(F.coalesce(F.col(col).cast("string"), F.lit("nan")).cast("binary")))
    wanted = F.array(*map(F.lit, categories)).cast("array<string>")
    token_map = materialize(token_map.select("token", (F.array_position(wanted, F.col("category")) - 1).cast("int").alias("__cat"))
                            .where("__cat >= 0"))
    sums = _broadcast_sums if is_small(token_map, max_broadcast_tokens) else _block_sums
    agg = sums(df.select(digest.alias("__k"), tokenize(F.col(col)).alias("__t")), token_map, len(categories))
    j = df.withColumn("__k", digest).join(agg.withColumnRenamed("__k", "__k2"), F.col("__k") == F.col("__k2"), "left")
    counts = {c: F.coalesce(F.col(f"__c{i}"), F.lit(0).cast("long")) for i, c in enumerate(categories)}
    matched = sum(list(counts.values())[1:], list(counts.values())[0]) if counts else F.lit(0)
    cols = _count_columns(counts, matched, foundations)
    if keep_matched:
        cols["matched_count"] = matched.cast("long")
    return j.withColumns(cols).drop("__k", "__k2", *[f"__c{i}" for i in range(len(categories))])


def _broadcast_sums(texts: DataFrame, token_map: DataFrame, n: int) -> DataFrame:
    """(digest, a sum per category) of (digest, tokens) rows; the lexicon is broadcast, so a text's tokens add up in the scan.

    The digest is a column of its own before the vector is exploded, else it is made anew for each
    token.  The vector is none, else Spark infers a filter on its size and makes it twice.
    """
    tokens = texts.select("__k", F.posexplode(token_counts(F.col("__t"))).alias("__pos", "__e")).select("__k", "__pos", "__e.token", "__e.n")
    hits = tokens.join(F.broadcast(token_map), "token", "left")
    sums = [F.sum(F.when(F.col("__cat") == i, F.col("n")).otherwise(0)).alias(f"__c{i}") for i in range(n)]
    # rows with the same text have the same vector: the sums are so many times those of one
    agg = hits.groupBy("__k").agg(*sums, F.count_if(F.col("__pos") == 0).alias("__copies"))
    return agg.select("__k", *[F.expr(f"__c{i} div __copies").alias(f"__c{i}") for i in range(n)])


def distinct_tokens(df: DataFrame, col: str) -> DataFrame:
    """Every distinct token of the texts; those of a batch of texts are told apart before a token becomes a row."""
    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).flatten().unique()], ["token"])
    return df.select(tokenize(F.col(col)).alias("t")).mapInArrow(of_batch, "token string").distinct()


def _packing(block_chars: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with its distinct tokens, as places in its block's vocabulary, and their counts; a row per block with the vocabulary."""
        task, block, filled, held = TaskContext.get().partitionId() << 32, 0, 0, []
        for b in batches:
            lists = b.column(1)
            # a text goes to the block that is being filled where it begins
            ends = filled + np.cumsum(_text_bytes(lists))
            at = np.concatenate([[filled], ends[:-1]]) // block_chars
            for first, last in pairwise([0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]):
                if first < last:
                    if held and at[first] != block:
                        yield _packed(task + block, held)
                        held = []
                    block = int(at[first])
                    held.append(b.slice(first, last - first))
            filled = int(ends[-1]) if len(ends) else filled
        if held:
            yield _packed(task + block, held)
    return pack


def _text_bytes(lists: pa.ListArray) -> np.ndarray:
    """About what each text takes in a block: its tokens' characters, a place for each of them, and its digest."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype("int64")
    chars = np.concatenate([[0], np.cumsum(pc.binary_length(lists.flatten()).to_numpy(zero_copy_only=False), dtype="int64")])
    ends = np.cumsum(n)
    return chars[ends] - chars[ends - n] + n + 16


def _packed(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The texts of one block as rows, its vocabulary as the last."""
    batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    lists = batch.column(1)
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype("int64")
    tokens = lists.flatten().dictionary_encode()
    vocabulary = tokens.dictionary
    size = max(len(vocabulary), 1)
    # (text, place) pairs in order, each with its number
    pairs, counts = np.unique(np.repeat(np.arange(len(n)), n) * size + tokens.indices.to_numpy(), return_counts=True)
    text, place = np.divmod(pairs, size)
    ends = np.cumsum(np.bincount(text, minlength=len(n)))[:-1]
    some = n > 0
    cut = [[x.tobytes() for x, keep in zip(np.split(v.astype("<i4"), ends), some, strict=True) if keep] for v in (place, counts)]
    keys = batch.column(0).filter(pa.array(some)).to_pylist()
    words = pa.ListArray.from_arrays(pa.array([0, len(vocabulary)], pa.int32()), vocabulary.cast(pa.string()))
    return pa.RecordBatch.from_arrays([
        pa.array([block] * (len(keys) + 1), pa.int64()), pa.array([*keys, None], pa.binary()),
        pa.array([*cut[0], None], pa.binary()), pa.array([*cut[1], None], pa.binary()),
        pa.concat_arrays([pa.nulls(len(keys), words.type), words])],
        ["__block", "__k", "places", "counts", "vocabulary"])


def _counting(n: int):
    def count(rows: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        """A block's packed vectors by its own part of the lexicon; places that are not in it count for a category ``n``."""
        places = np.frombuffer(b"".join(rows["places"]), "<i4")
        counts = np.frombuffer(b"".join(rows["counts"]), "<i4")
        cat = np.full(places.max(initial=0) + 1, n)
        cat[words["__pos"].to_numpy()] = words["__cat"].to_numpy()
        text = np.repeat(np.arange(len(rows)), rows["places"].map(len).to_numpy(dtype="int64") // 4)
        sums = np.bincount(text * (n + 1) + cat[places], counts, len(rows) * (n + 1)).astype("int64").reshape(len(rows), n + 1)
        out = pd.DataFrame(sums[:, :n], columns=[f"__c{i}" for i in range(n)])
        out.insert(0, "__k", rows["__k"].to_numpy())
        return out
    return count


def _block_sums(texts: DataFrame, token_map: DataFrame, n: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(digest, a sum per category) of (digest, tokens) rows, for a lexicon above the broadcast bound.

    A row per (text, token) would be shuffled to the lexicon and back.  Instead each task
    cuts its texts into blocks of about ``block_chars`` and writes them once, their tokens
    as places in the block's vocabulary.  The vocabularies, far fewer rows, meet the lexicon;
    a block's texts meet their answers by place, so no token of a text is a row or a string again.
    """
    packed = materialize(texts.mapInArrow(_packing(block_chars), "__block long, __k binary, places binary, counts binary, vocabulary array<string>"))
    words = packed.where("vocabulary is not null").select(F.col("__block").alias("__b"), F.posexplode("vocabulary").alias("__pos", "token"))
    words = keep_possible(words, "token", materialize(hash_bits(token_map, "token")))
    named = words.join(token_map, "token").select("__b", "__pos", "__cat")
    schema = ", ".join(["__k binary", *[f"__c{i} long" for i in range(n)]])
    vectors = packed.where("vocabulary is null").select("__block", "__k", "places", "counts")
    counted = vectors.groupBy("__block").cogroup(named.groupBy("__b")).applyInPandas(_counting(n), schema)
    # rows with the same text have the same sums: one of them counts
    return counted.groupBy("__k").agg(*[F.max(f"__c{i}").alias(f"__c{i}") for i in range(n)])


def token_category_hits(df: DataFrame, lexicon: DataFrame, col: str, key: str,
                        stopwords=DEFAULT_STOPWORDS, max_broadcast_rows: int = 200_000) -> DataFrame:
    """The probe itself — one row per matched token (key, token, category)."""
    token_map = remove_stopwords(lexicon_map(lexicon), stopwords)
    exploded = df.select(F.col(key), F.explode(tokenize(F.col(col))).alias("token"))
    return exploded.join(bounded_broadcast(token_map, max_broadcast_rows), "token", "inner")
