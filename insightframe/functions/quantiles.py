"""Exact quantiles of any number of rows, by narrowing brackets around the wanted ranks.

A sketch (``percentile_approx``) gives two values around a rank, one pass counts the rows below
and within them, and the next round looks only inside. A round divides the rows in question by
about ``ACCURACY`` / 4, so few rounds reach a bracket without a value in between (ties) or with
at most ``LAST_ROWS`` rows, which are sorted. Every pass is one aggregate of all columns with
map-side combination; no shuffle grows with the data and no state with the distinct values.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
LAST_ROWS = 5_000


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of numeric expressions; NULL and NaN values are left out.

    ``columns`` names the expressions. A column without values gives None throughout.
    """
    names = list(columns)
    if not names:
        return {}
    work = df.select(*[F.nanvl(columns[c].cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(names)])
    counts = work.agg(*[F.count(f"x{i}").alias(f"n{i}") for i in range(len(names))]).first()
    ranks = {(i, k) for i in range(len(names)) if counts[i] for p in probs
             for k in (math.floor((counts[i] - 1) * p), math.ceil((counts[i] - 1) * p))}
    # per rank: inclusive bounds, rows below them, rows within
    brackets = {r: (None, None, 0, counts[r[0]]) for r in ranks}
    found: dict[tuple[int, int], float] = {}

    def inside(i: int, lo, hi) -> Column:
        x = F.col(f"x{i}")
        kept = x.isNotNull() if lo is None else (x >= F.lit(lo)) & (x <= F.lit(hi))
        return F.when(kept, x)

    slack = 2.0 / ACCURACY
    while brackets:
        todo = list(brackets)
        few = [r for r in todo if brackets[r][3] <= LAST_ROWS]
        if few:
            row = work.agg(*[F.sort_array(F.collect_list(inside(r[0], *brackets[r][:2]))).alias(f"s{j}") for j, r in enumerate(few)]).first()
            for j, r in enumerate(few):
                found[r] = row[j][r[1] - brackets.pop(r)[2]]
            continue
        asked: dict[tuple, list[tuple[int, int]]] = {}  # ranks of one bracket ask the same sketch
        for r in todo:
            asked.setdefault((r[0], *brackets[r][:2]), []).append(r)
        sketch = []
        for (i, lo, hi), mine in asked.items():
            at = [(k - brackets[(i, k)][2] + 0.5) / brackets[(i, k)][3] for _, k in mine]
            sketch.append(F.percentile_approx(inside(i, lo, hi), [p for a in at for p in (max(0.0, a - slack), min(1.0, a + slack))], ACCURACY))
        row = work.agg(*[s.alias(f"p{j}") for j, s in enumerate(sketch)]).first()
        near = {r: (row[j][2 * m], row[j][2 * m + 1]) for j, mine in enumerate(asked.values()) for m, r in enumerate(mine)}
        checks = []
        for j, (i, k) in enumerate(todo):
            x, (a, b) = F.col(f"x{i}"), near[(i, k)]
            checks += [F.count(F.when(x < F.lit(a), 1)).alias(f"b{j}"), F.count(F.when(x <= F.lit(a), 1)).alias(f"a{j}"),
                       F.count(F.when(x <= F.lit(b), 1)).alias(f"u{j}"), F.count(F.when(x < F.lit(b), 1)).alias(f"v{j}")]
        row = work.agg(*checks).first()
        missed = False
        for j, r in enumerate(todo):
            a, b = near[r]
            under, to_a, to_b, under_b = row[f"b{j}"], row[f"a{j}"], row[f"u{j}"], row[f"v{j}"]
            if not under <= r[1] < to_b:
                missed = True  # the sketch's error left the rank out: look again with wider bounds
            elif r[1] < to_a:
                found[r] = a
                del brackets[r]
            elif r[1] >= under_b:
                found[r] = b
                del brackets[r]
            else:
                brackets[r] = (a, b, under, to_b - under)
        slack = min(0.5, slack * 4) if missed else slack
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        n, values = counts[i], []
        for p in probs:
            if not n:
                values.append(None)
                continue
            at = (n - 1) * p
            lo, hi = found[(i, math.floor(at))], found[(i, math.ceil(at))]
            values.append(lo + (at - math.floor(at)) * (hi - lo) if hi != lo else lo)
        out[c] = values
    return out
