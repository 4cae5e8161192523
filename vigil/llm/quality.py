"""Line-first quality rules, as DataFrame functions only.

Each line is judged on its own and by shares of itself, so a long line fails
for what it mostly is and not for one phrase in it: punctuation (too many
symbols), navigation (a row of short items between separators, or only menu
words) and boilerplate (stock phrases that make up much of the line).  Failing lines are removed; a document that loses too much of
its text that way is rejected.  Beside it stand document statistics with two
hard limits (too short, too repetitive).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import WORD, let, words

#: Share of a line's characters other than white space that may be neither letter nor digit, if they are several.
MAX_SYMBOL_SHARE, MIN_SYMBOLS = 0.3, 3
#: Separators that make a line a navigation row, if there is one for so many words at least.
MIN_SEPARATORS, WORDS_PER_SEPARATOR = 4, 6
NAV_SEPARATOR = r"(?:^|\s)[|»›•·>](?=\s|$)"
NAV_WORDS = ("home", "menu", "login", "logout", "register", "search", "sitemap", "next", "previous", "share", "contact")
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
               "subscribe to our", "sign up for", "click here", "enable javascript", "powered by", "lorem ipsum")
#: Share of a line's characters other than white space that stock phrases make up in boilerplate.
MIN_PHRASE_SHARE = 0.2
#: Share of the text's characters that may go with failing lines.
MAX_LOST = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines_removed", "lost_share", "kept")


def line_failed(line: Column) -> Column:
    """Whether a line breaks the punctuation, navigation or boilerplate rule (a blank line breaks none)."""
    solid = F.regexp_replace(line, r"[\x20\x09-\x0D]+", "")
    symbols = F.regexp_count(line, F.lit(r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]"))
    punctuation = (symbols >= MIN_SYMBOLS) & (symbols > F.lit(MAX_SYMBOL_SHARE) * F.length(solid))
    separators = F.regexp_count(line, F.lit(NAV_SEPARATOR))
    row = (separators >= MIN_SEPARATORS) & (F.regexp_count(line, F.lit(WORD)) <= WORDS_PER_SEPARATOR * separators)
    navigation = row | line.rlike(rf"(?i)^\W*(?:(?:{'|'.join(NAV_WORDS)})\W*)+$")
    phrases = f"(?i)(?:{'|'.join(BOILERPLATE)})"
    said = F.length(F.regexp_replace(F.array_join(F.regexp_extract_all(line, F.lit(phrases), F.lit(0)), ""), " ", ""))
    boilerplate = line.rlike(phrases) & (said >= F.lit(MIN_PHRASE_SHARE) * F.length(solid))
    return (F.length(solid) > 0) & (punctuation | navigation | boilerplate)


def repeat_words(tokens: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text.

    Windows are compared by a 64-bit hash; a window's places meet by sorting
    (hash, place) pairs, so a text costs n log n.
    """
    n = F.size(tokens)
    windows = F.transform(F.slice(F.arrays_zip(tokens.alias("a"), F.slice(tokens, 2, F.greatest(n, F.lit(0))).alias("b"),
                                               F.slice(tokens, 3, F.greatest(n, F.lit(0))).alias("c")),
                                  F.lit(1), F.greatest(n - 2, F.lit(0))),
                          lambda z: F.xxhash64(z["a"], z["b"], z["c"]))

    def places(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(pairs, lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                                              | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
        return F.size(covered).cast("long")

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(places(h)))


def quality_rules(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST, clean: bool = True) -> DataFrame:
    """Adds statistics and the verdict; with ``clean`` also ``clean_text`` (the text without failing lines).

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (long), ``base_failed``, ``n_lines_removed`` (long),
    ``lost_share`` (double) and ``kept``.  A null text counts as empty; it and
    any text under 50 words fail.  Columns of the input with such names are
    replaced; all others and all rows stay.
    """
    d = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumns({"__w": words(F.col("__t")), "__l": F.split("__t", "\n", -1)})
    lines = F.filter("__l", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    judged = F.transform("__l", lambda x: F.struct(x.alias("line"), line_failed(x).alias("bad")))
    d = d.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(F.col("__w")),
        "__j": judged})
    d = d.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        "__lost": F.aggregate("__j", F.lit(0), lambda a, x: a + F.when(x["bad"], F.length(x["line"])).otherwise(0)),
        "n_lines_removed": F.size(F.filter("__j", lambda x: x["bad"])).cast("long")})
    whole = F.greatest(F.length("__t") - F.size("__l") + 1, F.lit(1))
    d = d.withColumn("lost_share", F.col("__lost") / whole)
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_lost))
    if clean:
        good = F.array_join(F.transform(F.filter("__j", lambda x: ~x["bad"]), lambda x: x["line"]), "\n")
        d = d.withColumn("clean_text", F.when(F.col("n_lines_removed") == 0, F.col(text)).otherwise(good))
    made = [*RESULTS, *(["clean_text"] if clean else [])]
    # A one-element generator: a filter on the verdict stays above it instead of
    # being pushed below, where all rules would be evaluated a second time.
    out = F.inline(F.array(F.struct(*[F.col(c) for c in made])))
    return d.select(*[c for c in docs.columns if c not in made], out)
