"""Random numbers that depend only on the content of a row.

A draw is the hash of (seed, salt, key), so it does not change with the
partitioning, the order of the rows or a recomputed task.  Keys are column names
or integer constants; each expression is parsed in one piece.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..scratch import quoted

# 13 hex digits = 52 bits: exact in a double.
HEX_DIGITS = 13
SCALE = float(16**HEX_DIGITS)


def hash_sql(seed: int, salt: str, *keys: str | int) -> str:
    """SQL text of the hash: 32 hex digits."""
    parts = [str(k) if isinstance(k, int) else f"coalesce(cast({quoted(k)} AS string), '')" for k in keys]
    literal = salt.replace("\\", "\\\\").replace("'", "\\'")
    return f"md5(concat_ws('|', '{seed}', '{literal}', {', '.join(parts)}))"


def uniform_sql(seed: int, salt: str, *keys: str | int) -> str:
    digits = f"substring({hash_sql(seed, salt, *keys)}, 1, {HEX_DIGITS})"
    return f"(cast(conv({digits}, 16, 10) AS bigint) / {SCALE!r}D)"


def normal_sql(seed: int, salt: str, *keys: str | int) -> str:
    """SQL text of a standard normal by Box-Muller on two hash uniforms."""
    u1, u2 = (uniform_sql(seed, f"{salt}:{part}", *keys) for part in ("r", "a"))
    return f"(sqrt(-2.0D * ln(1.0D - {u1})) * cos({2.0 * math.pi!r}D * {u2}))"


def hash_uniform(seed: int, salt: str, *keys: str | int) -> Column:
    """Uniform in [0, 1) for each distinct (seed, salt, keys)."""
    return F.expr(uniform_sql(seed, salt, *keys))
