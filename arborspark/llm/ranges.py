"""Global order of a table by sampled splitters, with DataFrame functions only.

A weighted sample of keys, of a size that depends on the number of ranges and not
on the rows, gives quantile boundaries; rows are dealt to the ranges between
them; ranges that come out overfull are sampled again and subdivided, up to four
times; a range that is overfull even then, as one of many rows with one key is,
stays whole, and nothing is dropped.  The
histogram of the ranges (one row each) gives every range its place, so a row's
place in the whole order needs a window over its own range alone.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled keys for each range, rows that a range should hold, and the least number of ranges.
PER_RANGE = 16
ROWS_A_RANGE = 250_000
LEAST_RANGES = 512
#: A range is overfull beyond so many times the mean.
OVERFULL = 4


def _constant(values: list, kind: str) -> Column:
    """A list as one foldable array."""
    return F.from_json(F.lit(json.dumps(values)), kind)


@dataclass
class Ranges:
    """Splitters over two long columns, with the rows and the weight of each range."""

    splitters: list[tuple[int, int]]
    rows: list[int]
    weight: list[int]

    def of(self, a: str, b: str) -> Column:
        """The range of a key: how many splitters do not exceed it, by a search over two levels."""
        if not self.splitters:
            return F.lit(0)
        step = max(1, int(len(self.splitters) ** 0.5))
        blocks = [self.splitters[i : i + step] for i in range(0, len(self.splitters), step)]
        as_rows = lambda xs: [{"a": a, "b": b} for a, b in xs]
        key = F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
        upto = lambda arr: F.size(F.filter(arr, lambda x: x <= key))
        block = upto(_constant(as_rows([x[0] for x in blocks]), "array<struct<a:bigint,b:bigint>>"))
        inner = F.element_at(_constant([as_rows(x) for x in blocks], "array<array<struct<a:bigint,b:bigint>>>"), block)
        # never null, and told so: no filter for nulls then sets plans of the same rows apart
        return F.coalesce(F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + upto(inner)), F.lit(0))

    def before(self, what: list[int], number: Column) -> Column:
        """The sum of what over the ranges before this one."""
        sums = [0]
        for x in what:
            sums.append(sums[-1] + x)
        return F.element_at(_constant(sums, "array<bigint>"), number + 1)

    def following(self) -> list[int]:
        """For each range, the next one with rows, going round."""
        full = [i for i, n in enumerate(self.rows) if n]
        if not full:
            return []
        after = dict(zip(full, full[1:] + full[:1], strict=True))
        return [after.get(i, -1) for i in range(len(self.rows))]


def sampled_ranges(df: DataFrame, a: str, b: str, weight: str) -> Ranges:
    """Ranges of near-equal weight over the keys (a, b) of df, both long and not null."""
    total, mass = df.agg(F.count("*"), F.sum(weight)).first()
    wanted = max(LEAST_RANGES, -(-total // ROWS_A_RANGE))

    def drawn(rows: DataFrame, mass: int, number: int, seed: int) -> list[tuple[int, int]]:
        # a row is taken if an exponential variable of its weight's rate stays below a limit: as many as wanted on average, whatever the number of rows or tasks
        u = (F.pmod(F.xxhash64(a, b, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        keys = rows.where(-F.log(u) / F.col(weight) <= number * PER_RANGE / max(mass or 0, 1)).select(a, b).collect()
        keys = sorted((r[0], r[1]) for r in keys)
        return [keys[i * len(keys) // number] for i in range(1, number)] if keys else []

    splitters = sorted(set(drawn(df, mass, wanted, 1)))
    for turn in range(2, 6):
        found = Ranges(splitters, [], [])
        counted = {r["r_"]: (r["n"], r["w"]) for r in df.groupBy(found.of(a, b).alias("r_")).agg(F.count("*").alias("n"), F.sum(weight).alias("w")).collect()}
        over = [r for r, (n, _) in counted.items() if n > OVERFULL * max(1, total / wanted) and n > 1000]
        if not over or turn == 5:
            break
        extra = set(drawn(df.where(found.of(a, b).isin(over)), sum(counted[r][1] for r in over), 4 * len(over) * OVERFULL, turn)) - set(splitters)
        if not extra:
            break
        splitters = sorted({*splitters, *extra})
    n = len(splitters) + 1
    return Ranges(splitters, [counted.get(i, (0, 0))[0] for i in range(n)], [counted.get(i, (0, 0))[1] for i in range(n)])

