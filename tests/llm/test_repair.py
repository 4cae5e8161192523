"""Conversation repair: the auction against a dynamic program, and the query against plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from vigil.llm import queries, repair

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def cheapest(rows):
    """(cost, letters) by a dynamic program over suffixes; rows are (initial, fault)."""
    best = {}
    for k in range(len(rows), -1, -1):
        now = {}
        for q in range(4):
            c = [(0, "")] if k == len(rows) and q in (0, 3) else []
            if k < len(rows):
                initial, fault = rows[k]
                a, b = best[k + 1, q]
                c.append((a + 4, "D" + b))
                if fault in ("", "truncated"):
                    more = 3 * bool(fault)
                    if (q, initial) in STEP:
                        a, b = best[k + 1, STEP[q, initial]]
                        c.append((a + more, "K" + b))
                    for r in "ua":
                        if (q, r) in STEP:
                            a, b = best[k + 1, STEP[q, r]]
                            c.append((a + more + 3, "R" + b))
            now[q] = min(c) if c else (10**9, "")
        for _ in range(4):  # inserts
            for q in range(4):
                for r in "ua":
                    if (q, r) in STEP:
                        a, b = now[STEP[q, r]]
                        now[q] = min(now[q], (a + 3, "I" + b))
        best.update({(k, q): v for q, v in now.items()})
    return best[0, 0]


def audited(rows):
    """A conversation's row of the result; rows are (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds = set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append((role[:1], fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
    cost, letters = cheapest(kinds)
    state, lines, at = 0, [], iter(rows)
    for letter in letters:
        role, text = ("?", "") if letter == "I" else next(at)[1:]
        if letter == "D":
            continue
        if letter in "IR":
            role = "assistant" if state == 2 else "user"
        state = STEP[state, role[0]]
        lines.append(f"{role}:{text}")
    assert state in (0, 3) and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    n = lambda f: sum(k[1] == f for k in kinds)
    return (gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20, s(role), s(text)
        out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: audited(r) for c, r in out.items()}


def query(spark, tmp_path, rows, schema="conv_id long, turn long, role string, text string"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op12(spark, str(tmp_path)).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def test_auction_equals_a_dynamic_program():
    rng = random.Random(3)
    names = ["", "truncated", "blank", "duplicate"]
    for i in range(3000):
        n = rng.choice([31, 32, 33, 64, 65, 130]) if i % 40 == 0 else rng.randint(0, 9)
        codes = "".join(rng.choice("0123456789ABCDEF" if i % 2 else "0112123567A") for _ in range(n))
        want = cheapest([("suax"[int(c, 16) % 4], names[int(c, 16) // 4]) for c in codes])
        assert repair.cheapest_edits(codes) == want == repair._solve_any(codes)


def test_prices_of_a_solved_block_are_feasible_and_tight_on_the_path():
    block = repair._Block("0121", None)
    assert block.settle(0) == block.price[0]
    for node in range(block.end):
        assert all(block.price[node] <= cost + block.price[to] for _, cost, to in block.arcs(node))


def test_query_on_hostile_conversations(spark, tmp_path):
    rng = random.Random(11)
    says = ["Yes.", "No!", "why?", "cut off", " ", "", None, "a. ", "b.\n\t", "é。", "x\n.", "..", " ", "mail me:\nnow"]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", None, "", "U"]
    rows = []
    for c in [*range(120), None, -5]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, t, t * 2, None, t // 2]), rng.choice(roles), rng.choice(says)))
    rows += [(500, t, "user" if t % 2 else "assistant", rng.choice(says)) for t in range(300)] + [(501, 3, "user", "again.")] * 70
    assert query(spark, tmp_path, rows) == damage(rows)


def test_given_table(spark):
    import duckdb

    rows = duckdb.sql("select conv_id, turn, role, text from '/root/testdata/sf0.01/conversations.parquet'").fetchall()
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12(spark, "/root/testdata/sf0.01").collect()}
    assert got == damage(rows)


def test_no_rows_after_damage_and_empty_table(spark, tmp_path):
    gone = [(c, t, "user", "x.") for c in range(400) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert query(spark, tmp_path, gone) == {r[0]: nothing for r in gone}
    assert query(spark, tmp_path, []) == {}


def test_extra_columns(spark, tmp_path):
    rows = [(1, 0, "user", "hi.", "x", 1, 9), (1, 1, "assistant", "yes.", "y", 2, 9)]
    got = query(spark, tmp_path, rows, "conv_id long, turn long, role string, text string, audit string, seq int, conv int")
    assert got == damage([r[:4] for r in rows])


@pytest.mark.parametrize("codes", ["", "1", "2", "3", "0", "00", "12" * 40])
def test_simple_cases(codes):
    cost, letters = repair.cheapest_edits(codes)
    assert (cost, letters) == cheapest([("suax"[int(c)], "") for c in codes])
