"""Conversation structure repair: cheapest edits that make turns alternate.

Rows of a conversation, ordered by turn (nulls first; equal turns by role, then
text), are audited and repaired.  A row's first fault counts: blank (no word),
duplicate (role and text seen earlier in the conversation) or truncated (its last
word does not end in ``.``, ``!`` or ``?``).  Edits: Keep (0), Rerole to user or
assistant (3), Delete (4; required for blank and duplicate rows), Insert an empty
user or assistant turn anywhere (3); a truncated row that is not deleted adds 3.
The repaired role initials match ``(s?(ua)+)?``.  Of the cheapest edit lists the one
whose initials (D, I, K, R) come first in ASCII is taken.

Method.  Edits are arcs of a lattice whose nodes are (rows worked off, state of the
pattern).  An auction finds shortest paths: a path grows from an origin; its last
node raises its price to the least of arc cost plus price of the arc's end and the
path contracts, or, when the price is there already, the path extends along that
arc.  When it reaches the end, the prices along it are exact distances.  Arcs whose
cost equals the fall in price are tight; the trace takes the tight arc with the
least letter, after the auction has made the price of its end exact.  Blocks of
``BLOCK`` rows are solved from the last to the first, each with the exact prices of
the next one's entry as its terminal costs, so work grows with the rows.

On Spark.  Repeated rows collapse to one with its count before any shuffle; first
occurrences come from a grouped minimum; the rows are sorted by range, so a long
conversation is spread over tasks; of the texts only a one-letter code per row goes to
the conversation's audit (which is one string per conversation by contract); texts
meet their edits in a streamed pass with batches in memory only.

Null roles and texts count as one space.  Conversations may have a null id.  Empty
tables give no rows.  Only the named columns are read, so others don't clash.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import prepare_python, stored, tidy

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows that an auction works on together.
BLOCK = 32
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ACCEPTING = (START, AFTER_A)
#: Codes of a row: class of its role's initial (s, u, a, another) + 4 * fault (none, truncated, blank, duplicate), as a hex digit.
CODES = "0123456789ABCDEF"


# ---------------------------------------------------------------- auction


def _next(state: int, kind: int) -> int | None:
    """State after a turn of a kind (0 s, 1 u, 2 a), or None if the pattern forbids it."""
    if kind == 0:
        return AFTER_S if state == START else None
    if kind == 1:
        return None if state == AFTER_U else AFTER_U
    return AFTER_A if kind == 2 and state == AFTER_U else None


def wanted(state: int) -> int:
    """Kind of the inserted or reroled turn that the pattern allows after a state."""
    return 2 if state == AFTER_U else 1


def _arcs(code: int, state: int) -> tuple:
    """Edits of a row in a state, by letter: (letter, cost, rows worked off, next state)."""
    kind, fault = code % 4, code // 4
    forced = _next(state, wanted(state))
    out = [("D", DELETE, 1, state), ("I", INSERT, 0, forced)]
    if fault < 2:
        more = TRUNCATED * fault
        if (kept := _next(state, kind)) is not None:
            out.append(("K", KEEP + more, 1, kept))
        out.append(("R", REROLE + more, 1, forced))
    return tuple(out)


ARCS = [[_arcs(code, state) for state in range(4)] for code in range(16)]
#: After the last row: insert, until the pattern is complete.
TAIL = [(("I", INSERT, 0, _next(s, wanted(s))),) for s in range(4)]


class _Block:
    """Prices of a block's nodes; node 4 * row + state, and one end behind the last row's states."""

    def __init__(self, codes: str, exits: list[int] | None):
        """``exits``: exact prices of the next block's entry states, or None for the last block."""
        self.rows = [ARCS[int(c, 16)] for c in codes]
        self.exits = exits
        self.end = 4 * (len(codes) + 1)
        low = min(exits) if exits else 0  # no path is cheaper: a feasible start
        self.price = [low] * self.end + [0]
        self.exact = [False] * self.end + [True]

    def arcs(self, node: int):
        """(letter, cost, node) of the arcs out of a node; the arc to the end has no letter."""
        row, state = divmod(node, 4)
        if row < len(self.rows):
            return [(letter, cost, node - state + 4 * step + to) for letter, cost, step, to in self.rows[row][state]]
        if self.exits is not None:
            return [("", self.exits[state], self.end)]
        ends = [("", 0, self.end)] if state in ACCEPTING else []
        return ends + [(letter, cost, node - state + to) for letter, cost, _, to in TAIL[state]]

    def settle(self, origin: int) -> int:
        """Auction from an origin until its path reaches the end; the origin's price is then its distance."""
        price, exact, path = self.price, self.exact, [origin]
        while not exact[path[-1]]:
            node = path[-1]
            best, to = min((cost + price[j], j) for _, cost, j in self.arcs(node))
            if price[node] < best:
                price[node] = best  # raise, and contract unless it is the origin
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for node in path:
            exact[node] = True
        return price[origin]

    def trace(self, state: int) -> tuple[str, int]:
        """Letters of the first cheapest path from an entry state, and the state it leaves the block in."""
        node, letters = state, []
        self.settle(node)
        while True:
            for letter, cost, to in self.arcs(node):
                if self.price[node] == cost + self.price[to] and self.price[node] == cost + self.settle(to):
                    break
            letters.append(letter)
            if to == self.end:
                return "".join(letters), node % 4
            node = to


def cheapest_edits(codes: str) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of a conversation that is given by its rows' codes."""
    return _solve("".join(c if c < "8" else "8" for c in codes)) if len(codes) <= 64 else _solve_any(codes)


@functools.lru_cache(1 << 16)
def _solve(codes: str) -> tuple[int, str]:
    return _solve_any(codes)


def _solve_any(codes: str) -> tuple[int, str]:
    cuts = list(range(0, len(codes), BLOCK)) or [0]
    exits: list[list[int] | None] = [None]  # from the last block to the first; two small tables per block stay in memory
    for at in reversed(cuts[1:]):
        block = _Block(codes[at:at + BLOCK], exits[-1])
        exits.append([block.settle(s) for s in range(4)])
    state, letters, cost = START, [], None
    for at, known in zip(cuts, reversed(exits), strict=True):
        block = _Block(codes[at:at + BLOCK], known)
        if cost is None:
            cost = block.settle(START)
        some, state = block.trace(state)
        letters.append(some)
    return cost or 0, "".join(letters)


def illegal_pairs(codes: str) -> int:
    """Adjacent rows whose role initials are not su, ua or au."""
    kinds = [int(c, 16) % 4 for c in codes]
    return sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(kinds, kinds[1:], strict=False))


def apply_edits(letters: str, turns):
    """Repaired turns: (role, text, letter) from an audit and the rows in order."""
    state, turns = START, iter(turns)
    names = {1: "user", 2: "assistant"}
    for letter in letters:
        if letter == "I":
            role, text = names[wanted(state)], ""
        else:
            role, text = next(turns)
            if letter == "D":
                continue
            if letter == "R":
                role = names[wanted(state)]
        state = _next(state, "sua".index(role[0]))
        yield role, text, letter


# ---------------------------------------------------------------- Spark


def _faults(text: Column, seen: Column) -> Column:
    """0 none, 1 truncated, 2 blank, 3 duplicate; the first that holds of blank, duplicate, truncated."""
    rest = F.rtrim(text, F.lit(BLANKS))
    return F.when(rest == "", 2).when(seen, 3).when(~F.substring(rest, -1, 1).isin(".", "!", "?"), 1).otherwise(0)


def _code(kind: Column, fault: Column) -> Column:
    return F.substring(F.lit(CODES), kind + 4 * fault + 1, F.lit(1))


def audit_rows(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               copies: str | None = None) -> DataFrame:
    """Rows in order, written to the shared folder: conv, turn, role, text, copies, fault, codes, seq.

    ``copies`` names a column with the number of times that a row stands.
    """
    prepare_python(rows.sparkSession)
    times = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    rows = rows.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text), F.lit(" ")).alias("text"), times.alias("copies"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2(F.col("text").cast("binary"), 256)), "at": F.struct(F.col("turn").isNotNull().alias("known"), "turn")})
    again = rows.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")) \
        .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    rows = rows.join(again, same, "left")
    seen = F.coalesce(F.col("at") != F.col("first"), F.lit(False))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = rows.select("conv", "turn", "role", "text", "copies", kind.alias("kind"), _faults(F.col("text"), seen).alias("fault"))
    more = F.when(F.col("fault") == 2, 2).otherwise(3)  # a repeated row's copies are blank as it is, or duplicates
    codes = F.concat(_code(F.col("kind"), F.col("fault")), F.repeat(_code(F.col("kind"), more), (F.col("copies") - 1).cast("int")))
    rows = rows.orderBy(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text")
    return stored(rows.select("conv", "turn", "role", "text", "copies", "fault", codes.alias("codes"),
                              F.monotonically_increasing_id().alias("seq")), "turns")


def audit(ordered: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost and the audit of the cheapest edits.

    ``ordered`` is from ``audit_rows``.
    """
    n = F.col("copies")
    count = lambda fault: F.sum(F.when(F.col("fault") == fault, 1).otherwise(0)).cast("long")
    found = ordered.groupBy("conv").agg(
        (F.max("turn").cast("decimal(20,0)") - F.min("turn") + 1).alias("span"), F.count_distinct("turn").alias("turns"),
        count(2).alias("blank"), count(3).alias("duplicate"), count(1).alias("truncated"),
        F.sum(F.when(F.col("fault") == 2, n - 1).otherwise(0)).alias("more_blank"),
        F.sum(F.when(F.col("fault") == 2, 0).otherwise(n - 1)).alias("more_duplicate"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "codes"))), lambda r: r["codes"]), "").alias("codes"))
    found = found.select("conv", F.coalesce((F.col("span") - F.col("turns")).cast("long"), F.lit(0)).alias("gaps"),
                         (F.col("blank") + F.col("more_blank")).alias("blank"),
                         (F.col("duplicate") + F.col("more_duplicate")).alias("duplicate"), "truncated", "codes")

    import pyarrow as pa

    def solve(batches):
        for batch in batches:
            codes = batch.column(batch.schema.get_field_index("codes")).to_pylist()
            edits = [cheapest_edits(c) for c in codes]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([illegal_pairs(c) for c in codes], pa.int64()), pa.array([c for c, _ in edits], pa.int64()),
                 pa.array([a for _, a in edits], pa.string())], [*batch.schema.names[:-1], "illegal", "cost", "audit"])

    kind = found.schema["conv"].dataType.simpleString()
    return found.mapInArrow(tidy(solve), f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired_turns(ordered: DataFrame, audits: DataFrame) -> DataFrame:
    """Repaired conversations, a row a turn: conv, position, role, text, edit.

    A conversation's turns come in order and side by side in one partition, as
    ``conversation_digest`` needs them.  Conversations without turns left have no row.
    """
    import pyarrow as pa

    kind = ordered.schema["conv"].dataType.simpleString()
    # the audit comes first, then the rows
    both = ordered.select("conv", F.col("seq"), "role", "text", "copies") \
        .unionByName(audits.select("conv", F.lit(-1).cast("long").alias("seq"), F.lit("").alias("role"), F.col("audit").alias("text"),
                                   F.lit(0).cast("long").alias("copies")))
    both = both.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "seq")
    schema = both.schema["conv"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        out: dict[str, list] = {c: [] for c in ("conv", "position", "role", "text", "edit")}
        types = [to_arrow_type(schema), pa.int64(), pa.string(), pa.string(), pa.string()]
        size = 0

        def flush():
            nonlocal size
            b = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))
            for v in out.values():
                v.clear()
            size = 0
            return b

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)

        stream = rows()
        ahead = next(stream, None)

        def turns():
            """The rows of the conversation at hand, with their copies."""
            nonlocal ahead
            while ahead is not None and ahead[1] >= 0:
                row = ahead
                for _ in range(row[4]):
                    yield row[2], row[3]
                ahead = next(stream, None)

        while ahead is not None:
            conv, letters = ahead[0], ahead[3]
            ahead = next(stream, None)
            held = turns()
            for position, (role, text, letter) in enumerate(apply_edits(letters, held)):
                for v, x in zip(out.values(), (conv, position, role, text, letter), strict=True):
                    v.append(x)
                size += 1 + len(text)
                if size >= 1 << 20:
                    yield flush()
            for _ in held:  # deleted copies at the end
                pass
        yield flush()

    return both.mapInArrow(tidy(run), f"conv {kind}, position long, role string, text string, edit string")


def conversation_digest(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, joined by newlines, read from ``repaired_turns`` as a stream."""
    import pyarrow as pa

    kind = turns.schema["conv"].dataType
    simple = kind.simpleString()

    def run(batches):
        import hashlib

        from pyspark.sql.pandas.types import to_arrow_type

        at, sha = None, None
        for batch in batches:
            done = []
            names = batch.schema.names
            conv, position, role, text = (batch.column(names.index(c)).to_pylist() for c in ("conv", "position", "role", "text"))
            for c, p, r, t in zip(conv, position, role, text, strict=True):
                if p == 0:
                    if sha is not None:
                        done.append((at, sha.hexdigest()))
                    at, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{r}:{t}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], to_arrow_type(kind)), pa.array([d[1] for d in done], pa.string())],
                                             ["conv", "sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], to_arrow_type(kind)), pa.array([sha.hexdigest()])], ["conv", "sha256"])

    return turns.mapInArrow(run, f"conv {simple}, sha256 string")
