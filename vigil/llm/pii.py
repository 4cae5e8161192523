"""Personal data by seed patterns and bootstrapped contextual extraction, as DataFrame functions only.

Strict patterns find the certain identifiers (the seeds) of four kinds: email,
ip, card, phone.  Looser patterns find candidates of the same kinds that the
strict ones miss (written-out mail addresses, numbers without a plus, numbers
that fail a checksum).  A candidate alone is no evidence; its context is:

* the words next to a seed are lexical patterns of its kind (word before, with
  the punctuation after it, or word after, with the punctuation before it; both
  may touch the identifier).  A pattern's confidence is the share of all occurrences of its
  word in the corpus that stand next to a known identifier of the kind, so
  "mail:" scores high and "the" next to nothing;
* patterns and instances (identifier values) form a graph that is scored in
  rounds: confident patterns, with several different identifiers each, make the
  candidates beside them likely (noisy or over patterns); likely candidates
  become known identifiers and raise the patterns of the next round, and make
  new ones of words that no seed stands beside.  Rounds end when nothing changes;
* candidates that pass in the end are spans, wherever their value occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import K1, let, stored, with_ordinal
from vigil.plans.sizing import bounded_broadcast, collect_bounded

KINDS = ("email", "ip", "card", "phone")

# The seed patterns.  Each matches what its plain form matches, leftmost and
# not overlapping, but never tries one run of characters from several starts.
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+ of 16 to 19 digits               phone \+[0-9][\x20().0-9-]+[0-9]
SEEDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms, whose matches need their context's word for it.
CANDIDATES = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20)"
             r"[A-Za-z0-9-]++(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\[(](?:\.|dot)[\])]\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?<![0-9][\x20.-])[0-9](?:[\x20.-]?[0-9]){12,18}+(?![\x20.-]?[0-9])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,4}+(?![0-9-]|\.[0-9])",
}
#: A cheap test that a text can hold any match at all.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Of a written-out address the middle: the word for the at sign up to the first one for a dot.
CANDIDATE_HINTS = {
    "email": r"(?i)(?:[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:\x20?[\[({]\x20?dot\x20?[\])}]|\x20dot\x20|\.)",
    "ip": r"[\[(](?:\.|dot)[\])]", "card": r"[0-9][\x20.-]?[0-9][\x20.-]?[0-9]", "phone": r"[0-9]\)?[\x20.-][0-9]"}

#: Different identifiers that a pattern must have been seen with.
MIN_IDENTIFIERS = 3
#: Confidence from which a pattern, or an instance, counts.
MIN_CONFIDENCE = 0.5
#: Contexts that are sought in the texts as a list; more are joined.
MAX_LISTED = 5_000
#: Rise of the known identifiers' mean belief under which a round without a new one is the last.
SETTLED = 1e-6
_WORD, _MARKS = r"[\p{L}\p{M}\p{N}]", r"[^\p{L}\p{M}\p{N}\s]"

SPAN = "struct<kind:string,start:int,end:int,value:string,before:string,after:string>"


def _matches(text: Column, kind: str, pattern: str, hint: str) -> Column:
    """All matches with their places (code points) and the words beside them.

    The text between matches comes from splitting at the pattern, so a place is
    a sum of lengths; texts without a match are not split.
    """
    found = F.when(text.rlike(hint), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    empty = F.array().cast(f"array<{SPAN}>")

    def places(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        each = F.transform(F.arrays_zip(hits.alias("value"), gaps.alias("gap"), F.slice(gaps, F.lit(2), F.size(hits)).alias("next")),
                           lambda x: x)
        each = F.slice(each, F.lit(1), F.size(hits))
        # both are sought from the match outwards, so a long gap costs no search
        after = lambda g: F.regexp_extract(g, rf"^\s*+({_MARKS}*+{_WORD}*+)", 1)
        before = lambda g: F.lower(F.reverse(after(F.reverse(g))))
        walked = F.aggregate(
            each, F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("at"),
                F.array_append(acc["out"], F.struct(
                    F.lit(kind).alias("kind"), (acc["at"] + F.length(x["gap"])).alias("start"),
                    (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("end"), x["value"].alias("value"),
                    before(x["gap"]).alias("before"), F.lower(after(x["next"])).alias("after"))).alias("out")))
        return walked["out"]

    bound = F.transform(F.array(found), lambda hits: F.when(F.size(hits) > 0, places(hits)).otherwise(empty))
    return F.element_at(bound, 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int"))
                       .otherwise(F.floor(d.cast("int") * 2 / 10).cast("int") + (d.cast("int") * 2) % 10))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("0"), p), F.lit(3)).cast("int") <= 255)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _by_kind(text: Column, spans) -> Column:
    """The spans of all kinds as listed; all but mail addresses have digits, so a text without one is searched for those only."""
    numbers = F.when(text.rlike("[0-9]"), F.concat(*[spans(k) for k in KINDS if k != "email"])).otherwise(F.array().cast(f"array<{SPAN}>"))
    return F.concat(spans("email"), numbers)


def base_spans(text: Column) -> Column:
    """The seeds of a text, kinds as listed, by place within a kind."""
    def seeds(kind: str) -> Column:
        return F.filter(_matches(text, kind, SEEDS[kind], HINTS[kind]), lambda s: _valid(kind, s["value"]))

    return _by_kind(text, seeds)


def candidate_spans(text: Column, base: Column) -> Column:
    """Loose matches that overlap no seed."""
    loose = _by_kind(text, lambda k: _matches(text, k, CANDIDATES[k], CANDIDATE_HINTS[k]))
    return F.filter(loose, lambda c: ~F.exists(base, lambda b: (c["start"] < b["end"]) & (b["start"] < c["end"])))


#: Context units by side: a word with the marks behind it, or before it, or marks alone.
UNITS = {"before": f"{_WORD}+{_MARKS}*|{_MARKS}+", "after": f"{_MARKS}*{_WORD}+|{_MARKS}+"}


def unit_uses(texts: DataFrame, text: Column, apt: DataFrame, max_listed: int = MAX_LISTED) -> DataFrame:
    """(side, word, uses): how often the places between a text's words offer each context of ``apt`` (side, word), in lower case.

    Contexts that can become patterns are few; up to ``max_listed`` of them are sought within a
    text's array of units, so no other unit becomes a row.  More meet the units in a join.
    """
    listed = collect_bounded(apt.select("side", "word"), max_listed)
    found = lambda side: F.regexp_extract_all(F.lower(text), F.lit(UNITS[side]), F.lit(0))
    if listed is None:
        each = lambda side: F.transform(found(side), lambda w: F.struct(F.lit(side).alias("side"), w.alias("word")))
        rows = texts.select(F.explode(F.concat(each("before"), each("after"))).alias("u")).select("u.*")
        rows = rows.join(bounded_broadcast(apt), ["side", "word"], "left_semi")
    else:
        def wanted(side: str) -> Column:
            words = [w for s, w in listed if s == side]
            return F.filter(found(side), lambda w: w.isin(words)) if words else F.array().cast("array<string>")

        pairs = F.map_from_arrays(F.array(F.lit("before"), F.lit("after")), F.array(wanted("before"), wanted("after")))
        rows = texts.select(F.explode(pairs).alias("side", "words")).select("side", F.explode("words").alias("word"))
    return rows.groupBy("side", "word").agg(F.count(F.lit(1)).alias("uses"))


def bootstrap(seen: DataFrame, uses, min_confidence: float = MIN_CONFIDENCE,
              min_identifiers: int = MIN_IDENTIFIERS) -> DataFrame:
    """(kind, value) of the candidates that their contexts make identifiers.

    ``seen``: one row per occurrence: ``kind``, ``value``, ``before``, ``after``
    (words beside it) and ``seed``.  ``uses``: a function from contexts (side, word) to
    how often the corpus, outside its identifiers, has each (side, word, uses).
    """
    edge = seen.select("kind", "value", "seed", F.explode(F.array(
        F.struct(F.lit("before").alias("side"), F.col("before").alias("word")),
        F.struct(F.lit("after").alias("side"), F.col("after").alias("word")))).alias("p")) \
        .select("kind", "value", "seed", "p.side", "p.word").where("word <> ''")
    edge = edge.groupBy("kind", "side", "word", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    edge = stored(edge, "pattern-instances")
    # only words beside several identifiers, known or yet to be, can become patterns at all; a candidate must stand beside one
    apt = edge.groupBy("kind", "side", "word").agg(F.sum(F.col("seed").cast("int")).alias("seeds"),
                                                   F.sum((~F.col("seed")).cast("int")).alias("open")) \
        .where((F.col("seeds") + F.col("open") >= min_identifiers) & (F.col("open") >= 1))
    apt = stored(apt.select("side", "word").distinct(), "pattern-words")
    counts = stored(uses(apt), "pattern-uses")
    edge = edge.join(bounded_broadcast(apt), ["side", "word"], "left_semi") \
        .join(bounded_broadcast(counts), ["side", "word"], "left").fillna(0, ["uses"])
    edge = stored(edge, "pattern-graph")
    # a seed is marked as such: a candidate's belief may round to 1 too
    seeds = stored(edge.where("seed").select("kind", "value", F.lit(1.0).alias("belief")).distinct(), "seeds")
    known = seeds
    size, belief = -1, 0.0
    while True:
        told = edge.join(known, ["kind", "value"], "left").withColumn("belief", F.coalesce("belief", F.lit(0.0)))
        patterns = told.groupBy("kind", "side", "word").agg(
            (F.sum(F.col("n") * F.col("belief")) / F.greatest(F.max("uses"), F.sum("n"))).alias("confidence"),
            F.sum((F.col("belief") >= min_confidence).cast("int")).alias("identifiers"))
        patterns = patterns.where((F.col("confidence") >= min_confidence) & (F.col("identifiers") >= min_identifiers))
        doubt = F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))
        beside = edge.where(~F.col("seed")).join(patterns, ["kind", "side", "word"]).groupBy("kind", "value") \
            .agg((1 - doubt).alias("belief")).where(F.col("belief") >= min_confidence)
        known = stored(seeds.unionByName(beside.join(seeds.select("kind", "value"), ["kind", "value"], "left_anti")), "instances")
        now = known.agg(F.count(F.lit(1)).alias("size"), F.sum("belief").alias("belief")).first()
        # beliefs only rise, and what is known only grows
        if now["size"] == size and (now["belief"] or 0.0) - belief <= SETTLED * size:
            break
        size, belief = now["size"], now["belief"] or 0.0
    return known.join(seeds.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value")


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``base`` (seed spans) and ``extra`` (spans that the bootstrapping adds).

    Spans are (kind, start, end, value, before, after), in code points, end
    exclusive.  ``extra`` spans overlap no seed, but may overlap each other.
    ``docs`` needs ``doc_id`` and ``text``; a null text has no spans; columns of
    the input with the two names are replaced, all others and all rows stay.
    """
    d = with_ordinal(docs.drop("base", "extra"), text=text)
    t = F.coalesce(F.col(text), F.lit(""))
    d = d.withColumn("base", base_spans(t))
    few = d.select(K1, "__ord", "base", candidate_spans(t, F.col("base")).alias("loose")) \
        .where((F.size("base") > 0) | (F.size("loose") > 0))
    few = stored(few, "identifiers")
    loose = few.select(K1, "__ord", F.explode("loose").alias("s")).distinct()
    seen = few.select(F.explode("base").alias("s")).select("s.*", F.lit(True).alias("seed")).unionByName(
        loose.select("s.*", F.lit(False).alias("seed")))
    cut = let(base_spans(t), lambda b: replaced(t, F.concat(b, candidate_spans(t, b)), lambda s: F.lit("\n")))
    uses = lambda apt: unit_uses(docs.select(cut.alias("cut")), F.col("cut"), apt)
    found = stored(bootstrap(seen.select("kind", "value", "before", "after", "seed"), uses), "found")
    extra = loose.select(K1, "__ord", "s", F.col("s.kind").alias("kind"), F.col("s.value").alias("value")) \
        .join(found, ["kind", "value"], "left_semi") \
        .groupBy(F.col(K1).alias("__a"), F.col("__ord").alias("__b")).agg(F.sort_array(F.collect_set("s")).alias("extra"))
    extra = bounded_broadcast(stored(extra, "extra-spans"))
    return d.join(extra, (F.col(K1) == F.col("__a")) & (F.col("__ord") == F.col("__b")), "left") \
        .withColumn("extra", F.coalesce("extra", F.array().cast(f"array<{SPAN}>"))).drop(K1, "__ord", "__a", "__b")


def span_list(spans: Column) -> Column:
    """``kind:start:end``, kinds as listed, then by start, joined by commas."""
    def part(kind: str) -> Column:
        own = F.sort_array(F.transform(F.filter(spans, lambda s: s["kind"] == kind),
                                       lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        return F.transform(own, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*[part(k) for k in KINDS]), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    return replaced(text, spans, lambda s: F.concat(F.lit("["), s["kind"], F.lit("]")))


def replaced(text: Column, spans: Column, by) -> Column:
    """The text with ``by(span)`` for every span; overlapping spans become one, the first."""
    own = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(own, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(
            F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), by(s)))).alias("out")))
    bound = F.transform(F.array(done), lambda x: F.concat(F.array_join(x["out"], ""), F.substring(text, x["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(F.element_at(bound, 1))
