"""Table structure: tokens to cells, sparse cells to grids, HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = "array<struct<row:int,col:int,row_span:int,col_span:int>>"


def argmax(scores: Column) -> Column:
    """0-based place of the largest value, the first of equals."""
    return F.array_position(scores, F.array_max(scores)) - 1


def structure_tokens(steps: Column) -> Column:
    return F.transform(steps, argmax)


def decode_tokens(tokens: Column) -> Column:
    """struct<cells, rows, cols> of a token sequence.

    2 ends it, 5 opens a row, 6 closes one, 3 opens a cell, 4 closes it; 7 to 19 give its column span (token
    less 7) and 20 to 32 its row span (token less 20), both from 1 to 10. Rows and columns are 1 at least.
    """
    zero = F.struct(
        F.array().cast(CELLS).alias("cells"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(0).alias("most"), F.lit(False).alias("open"), F.lit(1).alias("rs"), F.lit(1).alias("cs"), F.lit(False).alias("done")
    )

    def step(a: Column, token: Column) -> Column:
        t = token.cast("int")
        live = ~a.done
        closes = live & (t == 4) & a.open
        pick = lambda cond, new, old: F.when(cond, new).otherwise(old)
        span = lambda base: F.least(F.greatest(t - base, F.lit(1)), F.lit(10))
        cell = F.struct(a.row.alias("row"), a.col.alias("col"), a.rs.alias("row_span"), a.cs.alias("col_span"))
        opens = live & (t == 3)
        return F.struct(
            pick(closes, F.array_append(a.cells, cell), a.cells).alias("cells"),
            pick(live & (t == 6), a.row + 1, a.row).alias("row"),
            pick(live & (t == 5), F.lit(0), pick(closes, a.col + a.cs, a.col)).alias("col"),
            pick(live & (t == 6), F.greatest(a.most, a.col), a.most).alias("most"),
            pick(opens, F.lit(True), pick(closes, F.lit(False), a.open)).alias("open"),
            pick(opens, F.lit(1), pick(live & t.between(20, 32), span(20), a.rs)).alias("rs"),
            pick(opens, F.lit(1), pick(live & t.between(7, 19), span(7), a.cs)).alias("cs"),
            (a.done | (t == 2)).alias("done"),
        )

    return F.aggregate(tokens, zero, step, lambda a: F.struct(a.cells.alias("cells"), F.greatest(a.row, F.lit(1)).alias("rows"), F.greatest(a.most, F.lit(1)).alias("cols")))


def cell_at(cells: DataFrame, row: Column, col: Column) -> DataFrame:
    """Of each table the first cell that covers a place."""
    hit = (row >= F.col("row")) & (row < F.col("row") + F.col("row_span")) & (col >= F.col("col")) & (col < F.col("col") + F.col("col_span"))
    return cells.filter(hit).groupBy("table_id").agg(F.min_by("content", "ord").alias("content"))


def row_of(cells: DataFrame, row: int) -> DataFrame:
    """The cells that begin in a row."""
    return cells.filter(F.col("row") == row)


def column_of(cells: DataFrame, col: int) -> DataFrame:
    """The cells that begin in a column."""
    return cells.filter(F.col("col") == col)


def header(cells: DataFrame) -> DataFrame:
    return row_of(cells, 0)


def data_rows(cells: DataFrame) -> DataFrame:
    """The rows below the header, each with its cells from left to right: (table_id, row, cells)."""
    cell = F.struct("col", "ord", "content", "row_span", "col_span")
    return cells.filter(F.col("row") > 0).groupBy("table_id", "row").agg(F.sort_array(F.collect_list(cell)).alias("cells"))


def spans_rows(row_span: Column) -> Column:
    return row_span > 1


def spans_columns(col_span: Column) -> Column:
    return col_span > 1


def cell_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def structure(outputs: Column) -> Column:
    """struct<cells, rows, cols> of a model's outputs (array of struct<name, steps>).

    The output whose name speaks of structure, or else the first, gives the token scores by step; without
    any output the table is one cell.
    """
    named = F.filter(outputs, lambda o: o["name"].contains("structure") | o["name"].contains("output"))
    steps = F.coalesce(F.get(named, F.lit(0)).steps, F.get(outputs, F.lit(0)).steps)
    one = F.struct(F.array(F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"))).cast(CELLS).alias("cells"), F.lit(1).alias("rows"), F.lit(1).alias("cols"))
    return F.when(steps.isNotNull(), decode_tokens(structure_tokens(steps))).otherwise(one)


def dense_grid(cells: DataFrame, size: DataFrame) -> DataFrame:
    """(table_id, row, col, content): every covered place inside the table's size; where cells overlap the later one stands."""
    spread = (
        cells.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)))
        .withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)))
        .join(size, "table_id")
        .filter((F.col("r") < F.col("rows")) & (F.col("c") < F.col("cols")))
    )
    return spread.groupBy("table_id", F.col("r").alias("row"), F.col("c").alias("col")).agg(F.max_by("content", "ord").alias("content"))


def html(cells: DataFrame) -> DataFrame:
    """(table_id, html): heads in row 0, data below, spans as attributes; places that a span covers have no cell of their own."""
    tag = F.when(F.col("row") == 0, F.lit("th")).otherwise(F.lit("td"))
    attribute = lambda name, n: F.when(F.col(n) > 1, F.concat(F.lit(f' {name}="'), F.col(n).cast("string"), F.lit('"'))).otherwise(F.lit(""))
    one = F.concat(F.lit("    <"), tag, attribute("rowspan", "row_span"), attribute("colspan", "col_span"), F.lit(">"), F.coalesce("content", F.lit("")), F.lit("</"), tag, F.lit(">\n"))
    ordered = lambda key, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x.v), "")
    rows = cells.select("table_id", "row", "col", one.alias("cell")).groupBy("table_id", "row").agg(ordered("col", F.col("cell")).alias("inner"))
    rows = rows.withColumn("inner", F.concat(F.lit("  <tr>\n"), F.col("inner"), F.lit("  </tr>\n")))
    return rows.groupBy("table_id").agg(ordered("row", F.col("inner")).alias("b")).select("table_id", F.concat(F.lit("<table>\n"), F.col("b"), F.lit("</table>")).alias("html"))


def table_kind(scores: Column) -> Column:
    """wired or lineless by a two-way softmax; a tie is lineless."""
    a, b = F.get(scores, F.lit(0)), F.get(scores, F.lit(1))
    return F.when(a > b, F.lit("wired")).otherwise(F.lit("lineless"))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))
