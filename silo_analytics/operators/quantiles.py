"""Exact quantiles of many columns without gathering a column in one place.

A mergeable sketch brackets every wanted rank; one more pass counts the values
below the bracket and inside it, and another those inside by distinct value.  A bracket that may hold more
than ``BRACKET_ROWS`` rows is narrowed by further passes before it is ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..scratch import quoted

ACCURACY = 20_000
# Rows of a column that one task may order.
BRACKET_ROWS = 500_000
_SLACK = 3.0 / ACCURACY


def exact_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]]
) -> dict[tuple[str, float], float | None]:
    """Linear-interpolation quantiles of numeric columns; nulls and NaN are skipped.

    Returns ``{(column, p): value}``; a column without values gives None.
    """
    return quantiles_and(df, wanted, [])[0]


def quantiles_and(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], also: Sequence[Column]
) -> tuple[dict[tuple[str, float], float | None], Row]:
    """Exact quantiles, and other aggregates of the same rows taken in the same pass.

    ``also`` refers to the wanted columns as c0, c1, ... in their order.
    """
    asks = [(c, float(p)) for c, ps in wanted.items() for p in ps]
    columns = list(wanted)
    values = df.selectExpr(*[f"nanvl(cast({quoted(c)} AS double), NULL) AS c{i}" for i, c in enumerate(columns)])

    sketches = [F.expr(f"count(c{i}) AS n{i}") for i in range(len(columns))]
    for j, (c, p) in enumerate(asks):
        around = f"array({max(p - _SLACK, 0.0)!r}D, {min(p + _SLACK, 1.0)!r}D)"
        sketches.append(F.expr(f"percentile_approx(c{columns.index(c)}, {around}, {ACCURACY}) AS q{j}"))
    sketch = values.agg(*sketches, *also).first()

    out: dict[tuple[str, float], float | None] = {}
    open_asks = []
    for j, (c, p) in enumerate(asks):
        n = sketch[f"n{columns.index(c)}"]
        if n == 0:
            out[(c, p)] = None
        else:
            low, high = sketch[f"q{j}"]
            open_asks.append((c, p, n, low, high))
    while open_asks:
        narrow = [a for a in open_asks if a[2] * 2 * _SLACK > BRACKET_ROWS]
        if narrow:
            found = dict(zip(narrow, _narrowed(values, columns, narrow)))
            open_asks = [found.get(a, a) for a in open_asks]
        retry = []
        for ask, value in zip(open_asks, _read_brackets(values, columns, open_asks)):
            c, p, n, _, _ = ask
            if value is None:  # the sketch was off by more than its bound
                retry += _narrowed(values, columns, [(c, p, n, float("-inf"), float("inf"))])
            else:
                out[(c, p)] = value
        open_asks = retry
    return out, sketch


def _narrowed(values, columns, asks) -> list[tuple]:
    """Brackets that surely hold the wanted ranks and few rows besides.

    Every pass counts the rows below and inside the brackets; a bracket that lacks its ranks
    is opened on that side, one that holds too many rows is cut by a sketch of the rows inside.
    A bracket of one value is final, however many rows have it.
    """
    asks, done = list(asks), [False] * len(asks)
    while not all(done):
        parts = []
        for j, (c, _, _, low, high) in enumerate(asks):
            x, low, high = f"c{columns.index(c)}", f"double('{low!r}')", f"double('{high!r}')"
            parts += [
                F.expr(f"count_if({x} < {low}) AS b{j}"), F.expr(f"count_if({x} BETWEEN {low} AND {high}) AS i{j}"),
                F.expr(f"min({x}) AS l{j}"), F.expr(f"max({x}) AS h{j}"),
            ]
        row = values.agg(*parts).first()
        cuts = []
        for j, (c, p, n, low, high) in enumerate(asks):
            below, inside = row[f"b{j}"], row[f"i{j}"]
            first = int((n - 1) * p) + 1
            last = min(first + 1, n)
            low, high = max(low, row[f"l{j}"]), min(high, row[f"h{j}"])
            if first <= below or last > below + inside:
                asks[j] = (c, p, n, low if first > below else row[f"l{j}"], high if last <= below + inside else row[f"h{j}"])
                done[j] = False
            else:
                asks[j] = (c, p, n, low, high)
                done[j] = done[j] or inside <= BRACKET_ROWS or low == high
                if not done[j]:
                    cuts.append((j, (first - below) / inside))
        if cuts:
            sketches = []
            for j, share in cuts:
                c, _, _, low, high = asks[j]
                x = f"c{columns.index(c)}"
                around = f"array({max(share - _SLACK, 0.0)!r}D, {min(share + _SLACK, 1.0)!r}D)"
                inside = f"CASE WHEN {x} BETWEEN double('{low!r}') AND double('{high!r}') THEN {x} END"
                sketches.append(F.expr(f"percentile_approx({inside}, {around}, {ACCURACY}) AS q{j}"))
            row = values.agg(*sketches).first()
            for j, _ in cuts:
                c, p, n, low, high = asks[j]
                done[j] = (low, high) == tuple(row[f"q{j}"])  # as narrow as the values allow
                asks[j] = (c, p, n, *row[f"q{j}"])
    return asks


def _read_brackets(values, columns, asks) -> list[float | None]:
    """Exact order statistics around each ask, or None when the bracket missed them.

    One pass counts the rows below and inside every bracket; only the rows inside a bracket of several values are
    counted by value.
    """
    counts, entries = [], []
    for j, (c, _, _, low, high) in enumerate(asks):
        x, least, most = f"c{columns.index(c)}", f"double('{low!r}')", f"double('{high!r}')"
        counts += [F.expr(f"count_if({x} < {least}) AS b{j}"), F.expr(f"count_if({x} BETWEEN {least} AND {most}) AS i{j}")]
        if low < high:
            entries.append(f"CASE WHEN {x} BETWEEN {least} AND {most} THEN named_struct('ask', {j}, 'v', {x}) END")
    found = values.agg(*counts).first()
    # (first rank, last rank, value) of the values that are looked at
    runs: dict[int, list[tuple[int, int, float]]] = {
        j: [(found[f"b{j}"] + 1, found[f"b{j}"] + found[f"i{j}"], low + 0.0)] for j, (_, _, _, low, high) in enumerate(asks) if low == high
    }
    if entries:
        counted = (
            values.select(F.expr(f"explode(array_compact(array({', '.join(entries)})))").alias("e"))
            .groupBy("e.ask", "e.v")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        ranked = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("ask").orderBy("v")))
        wanted = set()
        for j, (_, p, n, low, high) in enumerate(asks):
            first = int((n - 1) * p) + 1
            if low < high:
                wanted |= {(j, rank - found[f"b{j}"]) for rank in (first, min(first + 1, n))}
        hits = " OR ".join(f"(ask = {j} AND upto >= {rank} AND upto - n < {rank})" for j, rank in sorted(wanted))
        for r in ranked.filter(hits).collect():  # at most 2 per ask
            below = found[f"b{r.ask}"]
            runs.setdefault(r.ask, []).append((below + r.upto - r.n + 1, below + r.upto, r.v))

    out: list[float | None] = []
    for j, (_, p, n, _, _) in enumerate(asks):
        position = (n - 1) * p
        first = int(position) + 1
        pair = [v for rank in (first, min(first + 1, n)) for low, high, v in runs.get(j, []) if low <= rank <= high]
        out.append(pair[0] + (pair[1] - pair[0]) * (position - int(position)) if len(pair) == 2 else None)
    return out


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    got = exact_quantiles(df, {c: (0.5,) for c in columns})
    return {c: got[(c, 0.5)] for c in columns}
