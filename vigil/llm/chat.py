"""Chat formatting of conversations made of typed content parts.

A turn's content is a list of parts (text, image, audio, document).  A visitor,
one expression per part kind, flattens them in order: text is escaped, every
other part becomes a placeholder, with its reference and the tokens it expands
to recorded beside the text.  All of it is DataFrame functions.

Template: ``<|im_start|>role\\ncontent<|im_end|>\\n``.  Texts and roles may hold
the template's own marks; every backslash is doubled and ``<|`` becomes
``<\\|``, so a mark can't come from a text and the escape is undone exactly.

The conversation is the unit of output: its turns meet in one row (the only
grouping), so one conversation must fit a row, as in any chat format.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<kind:string,text:string,ref:string,units:int>"
#: Tokens that one unit of a part expands to: image tiles, seconds of audio, document pages.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 600}


def escape(text: Column) -> Column:
    """Text in which neither of the template's marks can occur."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: a backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """A role on one line: as ``escape``, and a line end is ``\\n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    pieces = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")),
                                                               F.lit("\\|"), F.lit("|"))), "\\")


def text_parts(text: Column) -> Column:
    """The parts of a plain text turn."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def _visit(part: Column, place: Column, tokens_per_unit: Mapping[str, int]) -> Column:
    """One part as (piece, is_text, kind, ref, tokens).

    An unknown or null kind is text; a null text is empty; null units count as 1.
    """
    known = part["kind"].isin(*tokens_per_unit)
    each = F.create_map(*[F.lit(x) for kv in tokens_per_unit.items() for x in kv])
    mark = F.concat(F.lit("<|"), part["kind"], F.lit(":"), place.cast("string"), F.lit("|>"))
    is_text = ~F.coalesce(known, F.lit(False))
    text = F.coalesce(part["text"], F.lit(""))
    return F.struct(
        F.when(is_text, escape(text)).otherwise(mark).alias("piece"), is_text.alias("is_text"),
        F.when(~is_text, part["kind"]).alias("kind"), F.when(~is_text, part["ref"]).alias("ref"),
        F.when(is_text, F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")))
        .otherwise(F.element_at(each, part["kind"]) * F.coalesce(part["units"], F.lit(1))).cast("long").alias("tokens"))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         parts: str = "parts", learn: str = "assistant",
                         tokens_per_unit: Mapping[str, int] = TOKENS_PER_UNIT) -> DataFrame:
    """One row per conversation: the formatted string, its loss mask and its attachments.

    Returns ``conv``, ``formatted``, ``loss`` (array of turn number, start and
    length in code points within that turn's stretch of the string; text parts
    of ``learn`` turns only), ``attachments`` (array of turn number, kind, ref,
    tokens, in order) and ``n_tokens`` (words of texts plus expanded tokens).

    Turns are ordered by ``turn`` (null first); equal turns by what they say.
    A null role is empty, null parts are none, a null conversation id is one
    conversation.  Other columns are ignored.
    """
    t = turns.select(F.col(conv).alias("__conv"), F.col(turn).alias("__turn"), F.coalesce(role, F.lit("")).alias("__role"),
                     F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("__parts"))
    seen = F.transform("__parts", lambda p, i: _visit(p, i, tokens_per_unit))
    t = t.select("__conv", "__turn", "__role", seen.alias("__seen"))
    head = F.concat(F.lit(START), escape_role(F.col("__role")), F.lit("\n"))
    start = F.length(F.lit(START)) + F.length(escape_role(F.col("__role"))) + 1
    # where each part begins: the lengths of those before it
    spans = F.aggregate(
        "__seen", F.struct(start.alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["piece"])).alias("at"),
            F.when(p["is_text"], F.array_append(acc["out"], F.struct(acc["at"].alias("start"),
                                                                      F.length(p["piece"]).alias("length"))))
            .otherwise(acc["out"]).alias("out")))["out"]
    said = t.select(
        "__conv", "__turn",
        F.concat(head, F.array_join(F.transform("__seen", lambda p: p["piece"]), ""), F.lit(END + "\n")).alias("piece"),
        F.when(F.col("__role") == learn, spans).otherwise(F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
        F.transform(F.filter("__seen", lambda p: ~p["is_text"]),
                    lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("files"),
        F.aggregate("__seen", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("tokens"))
    g = said.groupBy("__conv").agg(
        F.sort_array(F.collect_list(F.struct("__turn", "piece", "spans", "files"))).alias("all"),
        F.sum("tokens").alias("n_tokens"))
    numbered = lambda name, fields: F.flatten(F.transform("all", lambda x, i: F.transform(
        x[name], lambda s: F.struct(i.alias("turn_no"), *[s[f].alias(f) for f in fields]))))
    return g.select(
        F.col("__conv").alias(conv), F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        numbered("spans", ("start", "length")).alias("loss"),
        numbered("files", ("kind", "ref", "tokens")).alias("attachments"), "n_tokens")


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Adds what the formatted string says: ``turns`` (role, text) and ``loss_text`` (unescaped text under the mask)."""
    stretches = F.filter(F.split("formatted", r"(?=<\|im_start\|>)", -1), lambda s: s != "")
    d = formatted.withColumn("__stretch", stretches)
    foot = len(END) + 1

    def turn(s: Column) -> Column:
        head = F.instr(s, "\n")
        return F.struct(unescape_role(F.substring(s, F.lit(len(START) + 1), head - len(START) - 1)).alias("role"),
                        unescape(F.substring(s, head + 1, F.length(s) - head - foot)).alias("text"))

    masked = F.transform("loss", lambda m: unescape(F.substring(F.get(F.col("__stretch"), m["turn_no"]),
                                                                m["start"] + 1, m["length"])))
    return d.withColumns({"turns": F.transform("__stretch", turn), "loss_text": F.array_join(masked, "")}).drop("__stretch")


def read_parts(formatted: DataFrame) -> DataFrame:
    """Adds ``parts``: every turn's content as typed parts again, array of (role, array of (kind, text, ref, tokens)).

    ``<|`` stands in a formatted string only where a mark begins, so the marks of other
    parts are told apart from a text that looks like one.  A mark's reference and tokens
    are those of its ``attachments`` entry: the turn's marks and entries agree in order.
    Texts next to each other come back as one text, empty ones not at all.
    """
    kind = "struct<kind:string,text:string,ref:string,tokens:bigint>"
    stretches = F.filter(F.split("formatted", r"(?=<\|im_start\|>)", -1), lambda s: s != "")
    foot = len(END) + 1

    def typed(pieces: Column, files: Column) -> Column:
        is_mark = lambda p: p.startswith("<|")
        marks = lambda k: F.size(F.filter(F.slice(pieces, F.lit(1), k + 1), is_mark))
        none = F.lit(None)
        return F.transform(pieces, lambda p, k: F.when(is_mark(p), F.struct(
            F.get(files, marks(k) - 1)["kind"].alias("kind"), none.cast("string").alias("text"),
            F.get(files, marks(k) - 1)["ref"].alias("ref"), F.get(files, marks(k) - 1)["tokens"].alias("tokens")))
            .otherwise(F.struct(F.lit("text").alias("kind"), unescape(p).alias("text"), none.cast("string").alias("ref"), none.cast("bigint").alias("tokens"))))

    def turn(s: Column, i: Column) -> Column:
        head = F.instr(s, "\n")
        content = F.substring(s, head + 1, F.length(s) - head - foot)
        pieces = F.regexp_extract_all(content, F.lit(r"(?s)<\|[^|]*\|>|(?:[^<]|<(?!\|))+"), F.lit(0))
        files = F.filter("attachments", lambda a: a["turn_no"] == i)
        found = F.get(F.transform(F.array(F.struct(pieces.alias("p"), files.alias("f"))), lambda x: typed(x["p"], x["f"])), F.lit(0))
        return F.struct(unescape_role(F.substring(s, F.lit(len(START) + 1), head - len(START) - 1)).alias("role"),
                        found.cast(f"array<{kind}>").alias("parts"))

    return formatted.withColumn("parts", F.transform(stretches, turn))
