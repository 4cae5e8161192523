"""Deterministic per-row randomness for resampling.

Draws depend only on (seed, row key, replicate), never on partitioning, so a
retried task or a repartitioned input reproduces the same resamples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO53 = float(2 ** 53)
_TWO32 = float(2 ** 32)


def unit_hash(seed: int, *cols, method: str = "xxhash64") -> Column:
    """Uniform double in [0, 1) from a hash of ``seed`` and the columns.

    ``xxhash64`` is the fast default; ``md5`` hashes ``seed|c1|c2...`` and
    takes the first 32 bits, which a SQL engine with ``md5`` reproduces
    bit-for-bit (used for oracle checks).
    """
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    if method == "xxhash64":
        h = F.xxhash64(F.lit(int(seed)), *cs)
        return F.pmod(h, F.lit(2 ** 53)).cast("double") / F.lit(_TWO53)
    if method == "md5":
        s = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cs])
        hexpart = F.substring(F.md5(s), 1, 8)
        return F.conv(hexpart, 16, 10).cast("double") / F.lit(_TWO32)
    raise ValueError(f"unknown hash method {method!r}")


def poisson1_thresholds(kmax: int = 12) -> list[float]:
    """Cumulative Poisson(1) probabilities P(X <= k), k = 0..kmax-1."""
    out, acc = [], 0.0
    for k in range(kmax):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
    return out


def poisson1_weight(u: Column, kmax: int = 12) -> Column:
    """Poisson(1) draw by inverse CDF of a uniform ``u``.  ``kmax`` = 12 is the largest
    value a 32-bit draw can reach, 18 that of a 53-bit one; more would not change a draw."""
    expr = None
    for k, p in enumerate(poisson1_thresholds(kmax)):
        expr = F.when(u < F.lit(p), F.lit(k)) if expr is None else expr.when(u < F.lit(p), F.lit(k))
    return expr.otherwise(F.lit(kmax))


def poisson1_weight_sql(u_sql: str, kmax: int = 12) -> str:
    """The same draw as SQL text (for oracle queries)."""
    parts = [f"when {u_sql} < cast({p!r} as double) then {k}" for k, p in enumerate(poisson1_thresholds(kmax))]
    return "(case " + " ".join(parts) + f" else {kmax} end)"


# ---------------------------------------------------------------- replicate weights (mix32)
#
# Row seed: the first 32 bits of md5("<seed>|<key...>"), computed once per row
# in Spark.  Replicate b of that row draws u = mix32(mix32((h + (b + 1) * G)
# mod 2^32)) / 2^32, where mix32 is a 32-bit xor-shift-multiply finaliser.
# The draw is vectorised with numpy inside tasks and reproducible in any SQL
# engine with 64-bit unsigned integers (no product exceeds 2^64).

# Golden-ratio increment and the two multipliers of mix32.
MIX_GOLDEN = 0x9E3779B9
MIX_C1 = 0x7FEB352D
MIX_C2 = 0x846CA68B
_M32 = 0xFFFFFFFF


def row_seed(seed: int, *cols) -> Column:
    """32-bit per-row seed from md5 of ``seed|key...`` (BIGINT)."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    s = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cs])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")


def mix32_words(h, b):
    """numpy: the 32-bit draws for row seeds ``h`` and replicate ids ``b``
    (broadcasting).  uint32 arithmetic wraps modulo 2^32 by itself."""
    import numpy as np

    x = np.asarray(h).astype(np.uint32) + (np.asarray(b).astype(np.uint32) + np.uint32(1)) * np.uint32(MIX_GOLDEN)
    for _ in range(2):
        x ^= x >> np.uint32(16)
        x *= np.uint32(MIX_C1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(MIX_C2)
        x ^= x >> np.uint32(16)
    return x


def mix32_uniforms(h, b):
    """numpy: uniforms in [0, 1) (``mix32_words / 2^32``)."""
    import numpy as np

    return mix32_words(h, b).astype(np.float64) / 4294967296.0


def poisson1_from_words(x, kmax: int = 12):
    """Poisson(1) weights from 32-bit draws: the number of thresholds
    ``P(X <= k)`` at or below ``x / 2^32``, compared as integers
    (``x / 2^32 >= p  <=>  x >= ceil(p * 2^32)``)."""
    import math

    import numpy as np

    w = np.zeros(np.shape(x), dtype=np.uint8)
    for p in poisson1_thresholds(kmax):
        w += x >= np.uint32(min(math.ceil(p * 4294967296.0), 4294967295))
    return w


def mix32_sql_ctes(src: str, name: str, h_col: str = "h", b_col: str = "b") -> tuple[str, str]:
    """CTE chain over ``src`` (UBIGINT ``h_col``, integer ``b_col``) adding the
    uniform ``u``; returns (ctes text, name of the last CTE)."""
    steps = [f"(({h_col} + ({b_col} + 1) * {MIX_GOLDEN}) & {_M32})"]
    ops = []
    for _ in range(2):
        ops += ["xor(__x, __x >> 16)", f"((__x * {MIX_C1}) & {_M32})", "xor(__x, __x >> 15)",
                f"((__x * {MIX_C2}) & {_M32})", "xor(__x, __x >> 16)"]
    ctes = [f"{name}0 as (select *, {steps[0]} as __x from {src})"]
    for k, op in enumerate(ops, start=1):
        ctes.append(f"{name}{k} as (select * replace ({op} as __x) from {name}{k - 1})")
    last = len(ops) + 1
    ctes.append(f"{name}{last} as (select * exclude (__x), __x::DOUBLE / 4294967296.0 as u from {name}{last - 1})")
    return ",\n".join(ctes), f"{name}{last}"
