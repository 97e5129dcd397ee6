"""Laboratory tables made long: one row per batch, test, storage condition and month.

Tables come as rows (table_id, title, row_no, cells array<string>), ragged or not. A table's header is the first of its first rows that
names the tests and, besides, a limit, a result, a batch, a condition or a month. Cells are unpivoted; what a column means is read from its header
and from the row above it, whose cells span the blank ones that follow. Columns of batches, conditions and months are carried down
over blank cells. A batch that only the title or the rows above the header name holds for the whole table.

Null and edge cases: null cells are blank; blank rows do not count; a table without a header, a row without a test and a value
without a batch give nothing; a value under a header that says nothing is kept as `loose`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.functions.dates import storage_condition, timepoint
from tabloom.sources.records import batch_of, header_role

#: Rows among which a header is looked for.
HEADER_ROWS = 4


def _role(cell: Column) -> Column:
    """Role of a header cell; a condition without a temperature heads a column of conditions."""
    return F.when(cell.rlike(r"(?i)\bconditions?\b") & storage_condition(cell).isNull(), "condition").otherwise(header_role(cell))


def laboratory_results(tables: DataFrame, stability: str | None = None) -> DataFrame:
    """table_id, row_no, col_no, batch, test, criterion, method, unit, condition, month, value, confidence.

    stability: a boolean column of the tables; only for those is a condition taken from the title."""
    keep = F.col(stability) if stability else F.lit(True)
    cells = F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    rows = tables.select("table_id", F.coalesce("title", F.lit("")).alias("title"), "row_no", keep.alias("stable"), cells.alias("cells")).where(F.exists("cells", lambda c: c != ""))

    # The header: among the first rows that are not blank.
    first = rows.withColumn("at", F.row_number().over(W.partitionBy("table_id").orderBy("row_no"))).where(F.col("at") <= HEADER_ROWS)
    roles = F.transform("cells", _role)
    named = F.array_contains(roles, "criterion") | F.array_contains(roles, "result") | F.exists("cells", lambda c: batch_of(c).isNotNull()) | F.array_contains(roles, "batch")
    named = named | F.exists("cells", lambda c: timepoint(c).isNotNull() | storage_condition(c).isNotNull())
    is_header = F.array_contains(roles, "test") & named
    header = first.where(is_header).groupBy("table_id").agg(F.min_by("cells", "row_no").alias("header"), F.min("row_no").alias("header_no"))
    above = first.join(header, "table_id").where(F.col("row_no") < F.col("header_no"))
    above = above.groupBy("table_id").agg(F.max_by("cells", "row_no").alias("spans"), F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "cells"))), lambda x: x["cells"])), " ").alias("preamble"))

    # Columns: each header cell with the nearest filled cell at or before it in the row above.
    columns = header.join(above, "table_id", "left").select("table_id", "header_no", "preamble", "spans", F.posexplode("header").alias("col_no", "head"))
    # A row of one cell is a heading of the whole table, not of the columns after it.
    over = F.when(F.size(F.filter("spans", lambda c: c != "")) > 1, F.try_element_at(F.filter(F.slice("spans", F.lit(1), F.col("col_no") + 1), lambda c: c != ""), F.lit(-1)))
    columns = columns.withColumn("over", F.coalesce(over, F.lit(""))).withColumn("role", _role(F.col("head")))
    own = lambda read: F.coalesce(read(F.col("head")), read(F.col("over")))
    columns = columns.select("table_id", "header_no", "col_no", "preamble", "head", "role", own(batch_of).alias("col_batch"), own(storage_condition).alias("col_condition"), own(timepoint).alias("col_month"))
    says = lambda *cs: F.coalesce(*[c.cast("string") for c in cs]).isNotNull()
    head = F.col("head")
    carried = F.col("role").isin("batch", "condition", "timepoint") & ~says(batch_of(head), storage_condition(head), timepoint(head))
    labelled = says(F.col("col_batch"), F.col("col_condition"), F.col("col_month")) | F.coalesce(F.col("role") == "result", F.lit(False))
    kind = F.when(F.col("role").isin("test", "criterion", "method", "unit") | carried, F.col("role")).when(labelled, "labelled").when(head != "", "loose")
    columns = columns.withColumn("kind", kind).where("kind is not null")
    # Of several columns with one role the first counts, and the others hold nothing.
    turn = F.row_number().over(W.partitionBy("table_id", "kind").orderBy("col_no"))
    columns = columns.withColumn("turn", turn).where((F.col("turn") == 1) | F.col("kind").isin("labelled", "loose"))

    long = rows.select("table_id", "title", "stable", "row_no", F.posexplode("cells").alias("col_no", "value")).join(columns, ["table_id", "col_no"]).where((F.col("row_no") > F.col("header_no")) & (F.col("value") != ""))
    # What a row says of itself, carried down where it is blank; tests, limits and units are the row's own.
    about = lambda k: F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k)
    of_row = long.groupBy("table_id", "row_no").agg(*map(about, ("test", "criterion", "method", "unit", "batch", "condition", "timepoint")))
    down = W.partitionBy("table_id").orderBy("row_no").rowsBetween(W.unboundedPreceding, 0)
    of_row = of_row.select("table_id", "row_no", "test", "criterion", "method", "unit", *[F.last(c, ignorenulls=True).over(down).alias(c) for c in ("batch", "condition", "timepoint")])
    told = long.where(F.col("kind").isin("labelled", "loose")).join(of_row, ["table_id", "row_no"])
    whole = F.concat_ws(" ", "table_id", "title", "preamble")
    months = F.coalesce(timepoint(F.col("timepoint")), F.col("timepoint").try_cast("double"))
    out = told.select(
        "table_id", "row_no", "col_no",
        F.coalesce("col_batch", F.coalesce(batch_of(F.col("batch")), F.col("batch")), batch_of(whole)).alias("batch"), "test", "criterion", "method", "unit",
        F.coalesce("col_condition", F.coalesce(storage_condition(F.col("condition")), F.col("condition")), F.when(F.col("stable"), storage_condition(whole))).alias("condition"),
        F.coalesce("col_month", months).alias("month"), "value", F.col("kind").alias("confidence"),
    )
    return out.where("test is not null and batch is not null")
