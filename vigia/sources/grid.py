"""Sheet cell grids: header promotion and positional block slicing.

A spreadsheet lands as a long table ``(source, sheet, row_no, col_no, value)``
(one row per non-empty cell, ``value`` as text).  Workbook sheets carry title
rows above the header, so the header is promoted from a given row and the
body is every later row.  Blocks of columns placed side by side are cut out
by column position and named positionally.

Both steps are a filter plus one ``groupBy(...).pivot(values)`` with an
explicit value list, so Spark skips the distinct-values job and the shuffle is
keyed by sheet row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID_KEYS = ["source", "sheet", "row_no"]


def header_row(skip_rows: int) -> int:
    """Row that holds the column names when a reader skips ``skip_rows`` rows,
    takes the next row as its own header and the row after it is promoted:
    the names sit at ``skip_rows + 1`` and the body starts one row later."""
    return skip_rows + 1


def promote_header(grid: DataFrame, sheet: str, skip_rows: int) -> DataFrame:
    """Body cells of ``sheet`` with the column name promoted from the header
    row: ``(source, sheet, row_no, col_no, name, value)``.

    The header map is one row per sheet column — at most 16,384 per sheet by
    the workbook format — so it is broadcast per source without a size probe."""
    hr = header_row(skip_rows)
    s = grid.filter(F.col("sheet") == F.lit(sheet))
    names = (s.filter(F.col("row_no") == hr)
             .select("source", "sheet", "col_no", F.col("value").alias("name")))
    body = s.filter(F.col("row_no") > hr)
    return body.join(F.broadcast(names), ["source", "sheet", "col_no"], "left") \
               .select("source", "sheet", "row_no", "col_no", "name", "value")


def block_slice(cells: DataFrame, col_from: int, names: list[str]) -> DataFrame:
    """Columns ``col_from .. col_from + len(names) - 1`` of every body row as a
    wide table with ``names`` assigned by position (text values)."""
    cols = list(range(col_from, col_from + len(names)))
    part = cells.filter(F.col("col_no").between(col_from, cols[-1]))
    wide = part.groupBy(*GRID_KEYS).pivot("col_no", cols).agg(F.first("value"))
    return wide.select(*GRID_KEYS, *[F.col(str(c)).alias(n) for c, n in zip(cols, names)])


@dataclass(frozen=True)
class Slice:
    """A block of a sheet: its columns from ``col_from`` on, named by position, and of the body below the header (see
    :func:`header_row`) the rows from ``first_row`` on, ``n_rows`` of them or all."""

    sheet: str
    block: str
    skip_rows: int
    col_from: int
    names: tuple[str, ...]
    first_row: int = 0
    n_rows: int | None = None


def slice_catalogue(spark: SparkSession, slices: list[Slice]) -> DataFrame:
    """The slices as a table, one row per column of a block: sheet, block, row_from, row_to (null: no end), col_no,
    position, name.  Blocks may overlap; a block is named once per sheet."""
    names = [(s.sheet, s.block) for s in slices]
    if len(set(names)) < len(names):
        raise ValueError(f"blocks named twice: {sorted({n for n in names if names.count(n) > 1})}")
    rows = []
    for s in slices:
        low = header_row(s.skip_rows) + 1 + s.first_row
        high = None if s.n_rows is None else low + s.n_rows - 1
        rows += [(s.sheet, s.block, low, high, s.col_from + i, i, n) for i, n in enumerate(s.names)]
    return spark.createDataFrame(rows, "sheet string, block string, row_from int, row_to int, col_no int, position int, name string")


#: Columns of a catalogue (one row each) that go to all tasks; a larger catalogue is joined like any table.
CATALOGUE_ROWS = 100_000


def slice_blocks(cells: DataFrame, catalogue: DataFrame) -> DataFrame:
    """All blocks of all sheets and sources cut out of the cell grid in one pass: (source, sheet, block, row_no,
    position, name, value), one row per cell of a block.  A cell may lie in several blocks."""
    if catalogue.count() <= CATALOGUE_ROWS:
        catalogue = F.broadcast(catalogue)
    got = cells.join(catalogue, ["sheet", "col_no"]).filter(
        (F.col("row_no") >= F.col("row_from")) & (F.col("row_no") <= F.coalesce("row_to", "row_no")))
    return got.select("source", "sheet", "block", "row_no", "position", "name", "value")


def wide_blocks(rows: DataFrame, width: int) -> DataFrame:
    """The rows of :func:`slice_blocks` with one row per sheet row and block: GRID_KEYS, block, c0 .. c<width - 1> by
    position (text).  One aggregation for all blocks."""
    at = [F.max(F.when(F.col("position") == i, F.col("value"))).alias(f"c{i}") for i in range(width)]
    return rows.groupBy(*GRID_KEYS, "block").agg(*at)


def block_table(wide: DataFrame, block: str, names: list[str] | tuple[str, ...]) -> DataFrame:
    """One block of :func:`wide_blocks` with its own column names."""
    return wide.filter(F.col("block") == F.lit(block)).select(*GRID_KEYS, *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def to_cells(df: DataFrame, row_no, col_from: int, source: str, sheet: str) -> DataFrame:
    """Explode a typed table into text cells at ``row_no`` (a column
    expression), its columns starting at ``col_from``."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(col_from + i).alias("col_no"), F.col(c).cast("string").alias("value"))
        for i, c in enumerate(df.columns)]))
    return (df.select(row_no.cast("int").alias("row_no"), cells.alias("c"))
              .select(F.lit(source).alias("source"), F.lit(sheet).alias("sheet"), "row_no", "c.col_no", "c.value")
              .filter(F.col("value").isNotNull()))
