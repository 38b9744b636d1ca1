"""Places and carried values within long sequences, without one task for each sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a cell that one task orders, and most cells; a table of at most one cell is ordered by a plain window.
CELL, MOST_CELLS = 100_000, 1024


def below(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds lie below a value: by blocks, so that a row looks at few of them."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    under = lambda array: F.size(F.filter(array, lambda b: b < value))
    whole = under(F.array(*[F.lit(b[-1]) for b in blocks]))  # blocks that lie below as a whole
    rest = F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), whole)
    return whole * step + F.when(whole < len(blocks), under(rest)).otherwise(len(bounds) - len(blocks) * step)


def celled(df: DataFrame, order: str, cell: int | None = None) -> tuple[DataFrame, int]:
    """Adds ``cell``, which rises with a numeric ``order``; bounds are quantiles over all rows."""
    n = min(MOST_CELLS, -(-df.count() // (cell or CELL)))
    if n < 2:
        return df.withColumn("cell", F.lit(0)), 1
    bounds = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 100 * n)).first()[0]
    return df.withColumn("cell", below(F.col(order), sorted(set(bounds)))), n


def _joined(df: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with its cell's row; null keys match."""
    names = [*by, "cell"]
    other = cells.select(*[F.col(c).alias(f"cell_{c}") for c in names], *[c for c in cells.columns if c not in names])
    on = [F.col(c).eqNullSafe(F.col(f"cell_{c}")) for c in names]
    return df.join(other, on).drop(*[f"cell_{c}" for c in names], "cell")


def numbered(df: DataFrame, by: list[str], order: str, name: str = "pos", cell: int | None = None) -> DataFrame:
    """Adds the place, from 0, of each row among those with the same ``by``, in ``order``."""
    dealt, n = celled(df, order, cell)
    place = F.row_number().over(Window.partitionBy(*by, "cell").orderBy(order)).cast("long") - 1
    if n < 2:
        return dealt.withColumn(name, place).drop("cell")
    run = Window.partitionBy(*by).orderBy("cell")  # a row for each cell
    cells = dealt.groupBy(*by, "cell").agg(F.count("*").alias("cell_n")).withColumn("cell_before", F.sum("cell_n").over(run) - F.col("cell_n"))
    return _joined(dealt.withColumn(name, place), cells.drop("cell_n"), by).withColumn(name, F.col(name) + F.col("cell_before")).drop("cell_before")


def carried(df: DataFrame, value: str, by: list[str], order: str, cell: int | None = None) -> DataFrame:
    """``value`` where it is null replaced by the last one before it among rows with the same ``by``; leading nulls stay."""
    dealt, n = celled(df, order, cell)
    near = F.last(value, ignorenulls=True).over(Window.partitionBy(*by, "cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    if n < 2:
        return dealt.withColumn(value, near).drop("cell")
    latest = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("cell_last")
    run = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = dealt.groupBy(*by, "cell").agg(latest).withColumn("cell_carry", F.last("cell_last", ignorenulls=True).over(run)).drop("cell_last")
    return _joined(dealt.withColumn(value, near), cells, by).withColumn(value, F.coalesce(value, "cell_carry")).drop("cell_carry")
