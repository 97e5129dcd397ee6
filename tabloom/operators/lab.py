"""Laboratory results: conformance, stability, trends, pivots, formulas and totals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.functions.text import fold_name, fold_unit
from tabloom.functions.values import compare, parse_criterion, parse_value
from tabloom.operators.joins import BROADCAST_ROWS


def conformance(results: DataFrame, result: str = "value_text", criterion: str = "criterion") -> DataFrame:
    """Results with outcome and reason. Rows share few different pairs of result and criterion, so each pair is read and
    compared once and its verdict joined back."""
    pairs = results.select(F.col(result).cast("string").alias("_r"), F.col(criterion).cast("string").alias("_c")).distinct()
    judged = pairs.select("_r", "_c", compare(parse_value(F.col("_r")), parse_criterion(F.col("_c"))).alias("_x"))
    # The count is of the bare pairs: nothing is parsed for it.
    judged = F.broadcast(judged) if pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else judged
    met = F.col(result).cast("string").eqNullSafe(F.col("_r")) & F.col(criterion).cast("string").eqNullSafe(F.col("_c"))
    return results.join(judged, met, "left").withColumn("outcome", F.col("_x.outcome")).withColumn("reason", F.col("_x.reason")).drop("_r", "_c", "_x")


def result_kind(condition: Column, months: Column) -> Column:
    return F.when(condition.isNull() & months.isNull(), "release").otherwise("stability")


def spec_conflicts(tests: DataFrame, material: str, name: str, what: list[str]) -> DataFrame:
    """Tests of one material and folded name that state more than one value of any of the columns."""
    sets = [F.array_sort(F.collect_set(c)).alias(c) for c in what]
    g = tests.groupBy(material, fold_name(F.col(name)).alias("folded")).agg(*sets)
    clash = F.lit(False)
    for c in what:
        clash = clash | (F.size(c) > 1)
    return g.where(clash)


def spelling_variants(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Folded names that are spelled in more than one way."""
    g = df.groupBy(*(by or []), fold_name(F.col(name)).alias("folded")).agg(F.array_sort(F.collect_set(name)).alias("spellings"))
    return g.where(F.size("spellings") > 1)


def unit_drift(results: DataFrame, unit: str, test_unit: str) -> DataFrame:
    a, b = fold_unit(F.col(unit)), fold_unit(F.col(test_unit))
    return results.where((a != "") & (b != "") & (a != b))


def stability_holes(results: DataFrame, batch: str, condition: str, month: str) -> DataFrame:
    """Time points that other batches have at a condition and a batch lacks."""
    cell = results.groupBy(batch, condition).agg(F.collect_set(month).alias("have"))
    seen = results.groupBy(condition).agg(F.collect_set(month).alias("seen"))
    return cell.join(seen, condition).select(batch, condition, F.array_sort(F.array_except("seen", "have")).alias("missing")).where(F.size("missing") > 0)


def pick(results: DataFrame, cell: list[str], verified: str, ident: str) -> DataFrame:
    """One result per cell: a verified one first, then the smallest id."""
    w = W.partitionBy(*cell).orderBy(F.col(verified).isNull(), ident)
    return results.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def conflicts(results: DataFrame, cell: list[str], text: str) -> DataFrame:
    """Cells with more than one reported text."""
    return results.groupBy(*cell).agg(F.array_sort(F.collect_set(F.regexp_replace(F.lower(F.trim(F.col(text))), r"\s+", " "))).alias("texts")).where(F.size("texts") > 1)


def stability_pivot(results: DataFrame, rows: list[str], month: str, months: list, value: str, agg: str = "first") -> DataFrame:
    """Rows by time point. The time points are given, so the pivot is one aggregation."""
    cells = [(F.min(F.when(F.col(month) == m, F.col(value))) if agg == "first" else F.count_if(F.col(month) == m)).alias(f"m{m}") for m in months]
    return results.groupBy(*rows).agg(*cells)


def trends(results: DataFrame, series: list[str], t: str, value: str, upper: float, least: int = 3) -> DataFrame:
    """Series that only rise over at least three points, and where the line through the first and last point meets the limit."""
    w = W.partitionBy(*series).orderBy(t)
    d = results.withColumn("_rise", F.col(value) > F.lag(value).over(w))
    g = d.groupBy(*series).agg(F.count("*").alias("points"), F.every(F.coalesce("_rise", F.lit(True))).alias("rising"), F.min_by(value, t).alias("first_value"), F.max_by(value, t).alias("last_value"), F.min(t).alias("t0"), F.max(t).alias("t1"))
    slope = F.try_divide(F.col("last_value") - F.col("first_value"), F.col("t1") - F.col("t0"))
    return g.where((F.col("points") >= least) & F.col("rising") & (F.col("t1") > F.col("t0"))).withColumn("crosses_at", F.col("t0") + F.try_divide(upper - F.col("first_value"), slope)).withColumn("flagged", F.coalesce(F.col("crosses_at") <= 2 * F.col("t1"), F.lit(False)))


def observed_range(results: DataFrame, by: list[str], number: str, text: str) -> DataFrame:
    """Texts of the smallest and largest number: the range as reported."""
    return results.where(F.col(number).isNotNull()).groupBy(*by).agg(F.min_by(text, F.struct(number, text)).alias("least"), F.max_by(text, F.struct(number, text)).alias("most"), F.count("*").alias("n"))


def modal_factor(formula: DataFrame, group: list[str], item: str, factor: str, tolerance: float = 0.001) -> DataFrame:
    """The factor that most items of a group agree on within the tolerance, and whether each item does.

    Factors within a share of each other are within a constant of each other in logarithms, so votes are counted by a
    window over the group's different factors in order, and no items are paired."""
    each = formula.where(F.col(factor).isNotNull()).groupBy(*group, F.col(factor).cast("double").alias("_f")).agg(F.count("*").alias("_n"))
    each = each.withColumn("_sign", F.signum("_f")).withColumn("_log", F.coalesce(F.ln(F.abs("_f")), F.lit(0.0)))
    by = ", ".join(f"`{c}`" for c in [*group, "_sign"])
    frame = f"RANGE BETWEEN {math.log1p(tolerance):.17g}D PRECEDING AND {-math.log1p(-tolerance):.17g}D FOLLOWING"
    votes = each.withColumn("votes", F.expr(f"sum(_n) OVER (PARTITION BY {by} ORDER BY _log {frame})"))
    best = votes.groupBy(*group).agg(F.max_by("_f", F.struct("votes", -F.col("_f"))).alias("modal"))
    return formula.join(best, group).withColumn("agrees", F.abs(F.col(factor) - F.col("modal")) <= tolerance * F.abs(F.col("modal")))


def percent_totals(formula: DataFrame, group: list[str], percent: str, tolerance: str = "0.5") -> DataFrame:
    """Sum of percentages in exact decimals, and whether it is 100 within the tolerance."""
    total = F.sum(F.col(percent).cast("decimal(18,6)"))
    return formula.groupBy(*group).agg(total.alias("total")).withColumn("ok", F.abs(F.col("total") - 100) <= F.lit(tolerance).cast("decimal(18,6)"))


def row_totals(df: DataFrame, columns: list[str]) -> Column:
    """Sum of the columns if every one is a number, else null."""
    values = [F.replace(F.trim(F.col(c).cast("string")), F.lit(","), F.lit("")).try_cast("decimal(38,6)") for c in columns]
    out = values[0]
    for v in values[1:]:
        out = out + v
    return out


def invoice(lines: DataFrame, by: list[str], quantity: str, price: str, tax_rate: str = "0.10", split: int = 2) -> DataFrame:
    """Amounts half up to cents, tax on the subtotal, and the tax in parts that add up to it."""
    amount = F.round(F.col(quantity).cast("decimal(18,4)") * F.col(price).cast("decimal(18,4)"), 2).cast("decimal(18,2)")
    g = lines.groupBy(*by).agg(F.sum(amount).cast("decimal(18,2)").alias("subtotal"))
    g = g.withColumn("tax", F.round(F.col("subtotal") * F.lit(tax_rate).cast("decimal(6,4)"), 2).cast("decimal(18,2)"))
    part = F.round(F.col("tax") / split, 2).cast("decimal(18,2)")
    g = g.withColumn("tax_first", part).withColumn("tax_rest", (F.col("tax") - part * (split - 1)).cast("decimal(18,2)"))
    return g.withColumn("total", (F.col("subtotal") + F.col("tax")).cast("decimal(18,2)"))


def findings(*parts: DataFrame) -> DataFrame:
    """Findings (code, severity, message) of several checks, blockers first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.when(F.col("severity") == "blocker", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return out.orderBy(rank, "code", "message")


def finding(df: DataFrame, code: str, severity: str, message: Column) -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"))


def sop_untraceable(methods: DataFrame, sops: DataFrame, method: str, text: str) -> DataFrame:
    """Methods that no procedure mentions."""
    m = methods.select(F.col(method).alias("_m")).distinct()
    tokens = sops.select(F.explode(F.array_distinct(F.regexp_extract_all(F.upper(F.col(text)), F.lit(r"[A-Z0-9][A-Z0-9./\-]*[A-Z0-9]"), F.lit(0)))).alias("_t")).distinct()
    return m.join(tokens, F.upper("_m") == F.col("_t"), "left_anti").withColumnRenamed("_m", method)


# Look-ups and counts


def test_for(rows: DataFrame, tests: DataFrame, material: str, name: str, ident: str) -> DataFrame:
    """rows with test_id: the test of the material with that folded name, else one whose name begins with it or the other way
    round, the exact one first, then the longest shared beginning, then the smallest id. Beginnings meet by equality: each
    name is looked up by all its prefixes of three characters and more, which are as many as it has characters."""
    key = fold_name(F.col(name))
    prefixes = lambda c: F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.length(c))), lambda n: F.substring(c, F.lit(1), n))
    wanted = rows.select(F.col(material).alias("_m"), key.alias("_k")).where(F.length("_k") >= 3).distinct()
    have = tests.select(F.col(material).alias("_m"), key.alias("_t"), F.col(ident).alias("test_id")).where(F.length("_t") >= 3)
    longer = wanted.join(have.withColumn("_k", F.explode(prefixes(F.col("_t")))).distinct(), ["_m", "_k"])
    shorter = wanted.withColumn("_p", F.explode(prefixes(F.col("_k")))).join(have.withColumnRenamed("_t", "_p"), ["_m", "_p"]).select("_m", "_k", F.col("_p").alias("_t"), "test_id")
    found = longer.select("_m", "_k", "_t", "test_id").unionByName(shorter)
    best = found.groupBy("_m", "_k").agg(F.min(F.struct((F.col("_t") != F.col("_k")).alias("other"), (-F.least(F.length("_t"), F.length("_k"))).alias("shared"), "test_id")).alias("b"))
    out = rows.withColumn("_key", key).join(best, (F.col(material) == F.col("_m")) & (F.col("_key") == F.col("_k")), "left")
    return out.withColumn("test_id", F.col("b.test_id")).drop("_m", "_k", "_key", "b")


def verification_summary(results: DataFrame, by: list[str], verified: str, conflict: str) -> DataFrame:
    """Rows, verified rows and conflicting rows."""
    return results.groupBy(*by).agg(F.count("*").alias("n"), F.count(verified).alias("verified"), F.count_if(F.coalesce(F.col(conflict), F.lit(False))).alias("conflicts"))


def verified_by_test(results: DataFrame, tests: DataFrame, test: str, name: str, verified: str, fields: list[str], order: str) -> DataFrame:
    """Verified results only, listed by test name in order."""
    j = results.where(F.col(verified).isNotNull()).join(tests.select(test, name), test)
    return j.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("results"))


def unverified(rows: DataFrame, kind: str, name: str, verified: str) -> DataFrame:
    """Of each kind of row how many nobody has verified, and the different names among them."""
    return rows.where(F.col(verified).isNull()).groupBy(kind).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.coalesce(name, F.lit("unnamed")))).alias("names"))


# Tables of a dossier. `lacking` says what a row lacks, as a reviewer has to see it.

#: Fixed value: what stands for a value that may not be shown.
HOLE = "[DATA NEEDED]"
IMPURITY_MARKS = ("impurit", "related substance", "degradation", "residual solvent")


def lacking(what: dict[str, str]) -> Column:
    """"no criterion, no method" for the columns (name -> column) that are empty."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"no {n}")) for n, c in what.items()])), ", ")


def spec_table(tests: DataFrame) -> DataFrame:
    """Test, method and criterion in the specification's order."""
    return tests.select("test_order", "test", "method", "criterion", lacking({"method identifier": "method", "acceptance criterion": "criterion"}).alias("missing")).orderBy("test_order", "test")


def batch_analyses(results: DataFrame, tests: DataFrame, batches: list[str], shown_unverified: bool = False) -> DataFrame:
    """Tests by batches with the reported texts: a verified result first, then the smallest id. Where a cell holds
    several, `notes` counts such cells; what is not verified is a hole unless asked for."""
    picked = pick(results, ["test_id", "batch"], "verified_by", "result_id")
    shown = F.col("value_text") if shown_unverified else F.when(F.col("verified_by").isNotNull(), F.col("value_text")).otherwise(HOLE)
    wide = picked.groupBy("test_id").agg(*[F.first(F.when(F.col("batch") == b, shown), ignorenulls=True).alias(b) for b in batches])
    many = results.groupBy("test_id", "batch").agg(F.count("*").alias("n")).groupBy("test_id").agg(F.count_if(F.col("n") > 1).alias("notes"))
    return tests.select("test_id", "test", "criterion").join(wide, "test_id", "left").join(many, "test_id", "left").select("test", "criterion", *batches, F.coalesce("notes", F.lit(0)).alias("notes")).orderBy("test")


def formula_table(components: DataFrame, full: bool, shown_unverified: bool = False) -> DataFrame:
    """Components in order, their quantities verified or held back; the full table or the composition of a unit."""
    hidden = F.col("verified_by").isNull() & F.lit(not shown_unverified)
    cell = lambda c: F.when(hidden, HOLE).otherwise(c)
    quantity = F.concat_ws(" ", F.col("quantity").cast("string"), "unit")
    more = [cell(F.col("per_batch").cast("string")).alias("per_batch"), cell(F.col("standard")).alias("standard")] if full else []
    return components.orderBy(F.coalesce("sort_order", F.lit(0)), F.coalesce("component", F.lit("")), "id").select("component", "function", cell(quantity).alias("quantity"), cell(F.col("percent").cast("string")).alias("percent"), *more)


def site_list(sites: DataFrame) -> DataFrame:
    """Sites by name with what they lack; activities joined by commas."""
    s = sites.where("deleted_at is null").withColumn("activities", F.array_join("activities", ", "))
    return s.select("name", "address", "identifier", "activities", lacking({"address": "address", "identifier": "identifier", "activities": "activities"}).alias("missing")).orderBy("name", "identifier")


def impurity_table(results: DataFrame, tests: DataFrame) -> DataFrame:
    """Tests whose name marks an impurity, with the reported texts of the least and greatest result."""
    name = F.lower("test")
    marked = F.lit(False)
    for m in IMPURITY_MARKS:
        marked = marked | name.contains(m)
    t = tests.where(marked).select("test_id", "test", "criterion")
    seen = observed_range(results.join(t.select("test_id"), "test_id", "left_semi"), ["test_id"], "number", "value_text")
    span = F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.concat_ws(" - ", "least", "most"))
    return t.join(seen, "test_id", "left").select("test", "criterion", F.when(F.col("n").isNotNull(), span).otherwise(HOLE).alias("observed")).orderBy("test")


TABLES = {"spec_table": spec_table, "batch_analyses": batch_analyses, "batch_formula": lambda c: formula_table(c, True), "composition_table": lambda c: formula_table(c, False), "site_list": site_list, "impurity_table": impurity_table}


def render(key: str, *inputs) -> DataFrame:
    """A table by its key; an unknown key is refused."""
    if key not in TABLES:
        raise ValueError(f"{key!r} is no table; there are {', '.join(sorted(TABLES))}")
    return TABLES[key](*inputs)


def formula_findings(components: DataFrame, by: str, tolerance: str = "0.5") -> DataFrame:
    """Formulas of a deliverable whose percentages do not add up to 100."""
    bad = percent_totals(components, [by], "percent", tolerance).where(~F.col("ok"))
    return finding(bad, "FORMULA_TOTAL", "blocker", F.concat_ws(" ", F.col(by).cast("string"), F.col("total").cast("decimal(18,2)").cast("string")))
