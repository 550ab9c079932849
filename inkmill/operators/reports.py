"""Results as lines of fixed width: rows of (…, place, line), place counted from 0.

Numbers are formatted from the exact binary value, ties to even, as C and Python do; Java's
own %.2f would round the shortest decimal half up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkmill.operators import style, taste

# What the lines say.
NOTHING = "  nothing notable - rhythm and range sit in normal territory"
SHORT_NOTE = "  (mtld under ~200 words is directional only - the gap is real, the absolute numbers are not comparable to published norms)"
MODES = {True: "vs author baseline", False: "vs absolute floors (no baseline)"}
NOT_LOWER = "  The rewrite does not score lower on either axis."


def fixed(value: Column, digits: int, signed: bool = False) -> Column:
    """What is left of the value beside a half is told without rounding, from two halves of its bits."""
    scale, size = 10.0**digits, F.abs(value)
    spread = size * 134217729.0  # 2**27 + 1
    high = spread - (spread - size)
    whole = F.floor(size * scale).cast("double")
    over = high * scale - whole - 0.5 + (size - high) * scale
    exact = (whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1.0).otherwise(0.0)) / scale * F.signum(value)
    shape = f"%+.{digits}f" if signed else f"%.{digits}f"
    return F.when(value.isNotNull(), F.format_string(shape, F.when(size < 1e12, exact).otherwise(value)))


def _numbered(lines: DataFrame, order: list[Column], *by: str) -> DataFrame:
    """One row a line, in order. Without keys the rows are a table for reading: a handful."""
    window = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    return lines.select(*by, (F.row_number().over(window) - 1).cast("long").alias("place"), "line")


def _lines(rows: DataFrame, lines: Column, *by: str) -> DataFrame:
    return rows.select(*by, F.posexplode(lines)).select(*by, F.col("pos").cast("long").alias("place"), F.col("col").alias("line"))


def style_report(rows: DataFrame, notes: DataFrame, baseline: bool, openings: DataFrame | None = None) -> DataFrame:
    """What was measured and what departs, a document. rows: measured(…, doc_id, …), notes: compare(…), openings: worst_openings(…)."""
    order = [m[0] for m in style.MATCH] + [c[0] for c in style.CHECKS]
    pos = F.array_position(F.array(*map(F.lit, order)), F.col("metric"))
    each = notes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(pos.alias("pos"), "note", "metric", "detail"))).alias("notes"))  # a row a metric and document at most
    joined = rows.select("doc_id", "words", "sentences").join(each, "doc_id", "left").withColumn("notes", F.coalesce("notes", F.array()))
    worst = F.lit(None).cast("string")
    if openings is not None:
        quote = F.when(F.contains("opening", F.lit("'")), F.lit('"')).otherwise(F.lit("'"))
        most = openings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", F.concat(quote, "opening", quote, F.lit(" x"), "n").alias("text")))).alias("worst"))  # three a document
        joined, worst = joined.join(most, "doc_id", "left"), F.concat(F.lit("     most repeated: "), F.array_join(F.col("worst.text"), ", "))
    said = lambda n: F.array(F.concat(F.lit("  "), n["note"]), F.concat(F.lit("     "), n["metric"], F.lit(" = "), n["detail"]), F.when(n["metric"] == "repeated_opening_rate", worst))
    head = F.concat("words", F.lit(" words, "), "sentences", F.lit(f" sentences, {MODES[baseline]}"))
    short = F.when(F.array_contains(F.col("notes.metric"), "mtld") & (F.col("words") < style.SHORT), F.lit(SHORT_NOTE))
    nothing = F.when(F.size("notes") == 0, F.lit(NOTHING))
    return _lines(joined, F.array_compact(F.concat(F.array(head, nothing), F.flatten(F.transform("notes", said)), F.array(short))), "doc_id")


def rewrite_report(compared: DataFrame, losses: DataFrame) -> DataFrame:
    """Each axis before and after, what was lost most, and the axes that fell. compared: taste.compare_axes(…), losses: taste.lost(…)."""
    axes = F.array(*map(F.lit, taste.AXES))
    line = F.concat(F.format_string("%-12s", "axis"), F.lpad(fixed(F.col("before"), 3), 9, " "), F.lpad(fixed(F.col("after"), 3), 9, " "), F.lpad(fixed(F.col("delta"), 3, True), 9, " "))
    table = compared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.array_position(axes, F.col("axis")).alias("pos"), line.alias("line"), F.when(F.col("worse"), F.col("axis")).alias("axis")))).alias("t"))  # a row an axis
    one = F.concat(F.format_string("    %-24s ", "key"), fixed(F.col("before"), 2), F.lit(" -> "), fixed(F.col("after"), 2))
    lost = losses.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", one.alias("line")))).alias("d"))  # five at most
    fallen = F.array_compact(F.col("t.axis"))
    closing = F.when(F.size(fallen) > 0, F.concat(F.lit("  The rewrite scores lower on: "), F.array_join(fallen, ", "), F.lit("."))).otherwise(F.lit(NOT_LOWER))
    drops = F.when(F.col("d").isNotNull(), F.concat(F.array(F.lit("  what the rewrite lost:")), F.col("d.line"))).otherwise(F.array().cast("array<string>"))
    return _lines(table.join(lost, "id", "left"), F.concat(F.col("t.line"), drops, F.array(closing)), "id")


def generator_report(rows: DataFrame) -> DataFrame:
    """Held-out generators, the best told first. rows: (generator, n, auc_vs_exemplars, rejected, threshold)."""
    line = F.concat(
        F.format_string("%-20s%4d", "generator", "n"), F.lpad(F.col("auc_vs_exemplars").cast("string"), 8, " "), F.lpad(fixed(F.col("rejected"), 2), 10, " "), F.lpad(fixed(F.col("threshold"), 2), 7, " ")
    )
    return _numbered(rows.withColumn("line", line), [F.desc("auc_vs_exemplars"), F.col("generator")])


def weights_report(weights: DataFrame) -> DataFrame:
    """Weights by size; those that contradict the expected sign are marked. weights: taste.weight_report(…)."""
    mark = F.when(F.col("disagrees"), F.lit("   <- opposes its expected direction")).otherwise(F.lit(""))
    line = F.concat(F.format_string("  %-22s ", "key"), fixed(F.col("weight"), 3, True), mark)
    return _numbered(weights.withColumn("line", line), [F.col("place")], "axis")


def ladder_report(rows: DataFrame) -> DataFrame:
    """Formulations by how they rank neighbours. rows: (formulation, rank_accuracy, adjacent_accuracy, mean_spearman, position_bias, verdict)."""
    number = lambda c, width: F.lpad(fixed(F.coalesce(c, F.lit(0.0)), 2), width, " ")
    line = F.concat(
        F.format_string("%-12s ", "formulation"), number("rank_accuracy", 6), F.lit(" "), number("adjacent_accuracy", 9), F.lit(" "), number("mean_spearman", 7), F.lit(" "),
        number("position_bias", 8), F.lit("  "), "verdict",
    )
    return _numbered(rows.withColumn("line", line), [F.desc("adjacent_accuracy"), F.col("formulation")])


def ranking_report(ranked: DataFrame, *by: str) -> DataFrame:
    """Candidates from the strongest down. ranked: pairwise.ranked(…)."""
    line = F.concat(F.format_string("  %-18s ", F.col("item").cast("string")), fixed(F.col("strength"), 3, True))
    return _numbered(ranked.withColumn("line", line), [F.col("place")], *by)


def fidelity_report(rows: DataFrame, label: str, dimensions: DataFrame | None = None) -> DataFrame:
    """How far each candidate is from chance, and to which side. rows: fidelity.fidelity(…, label), dimensions: (label, dimension, normalized)."""
    name = F.format_string("  %-16s ", F.col(label).cast("string"))
    first = F.concat(name, F.lit("p="), fixed(F.col("mean_p"), 2), F.lit(" (sd "), fixed(F.col("stdev"), 2), F.lit(", n="), F.col("n"), F.lit(")  fidelity_error="), fixed(F.col("fidelity_error"), 2))
    cells = F.lit(None).cast("string")
    if dimensions is not None:
        each = dimensions.groupBy(label).agg(F.sort_array(F.collect_list(F.concat("dimension", F.lit("="), fixed(F.col("normalized"), 2)))).alias("cells"))  # four dimensions
        rows, cells = rows.join(each, label, "left"), F.concat(F.lit(" " * 19 + "voice dimensions (1.00 = matched): "), F.array_join("cells", "  "))
    return _lines(rows, F.array_compact(F.array(first, F.concat(F.lit(" " * 19), F.col("direction")), cells)), label)


def rollup_report(rolled: DataFrame) -> DataFrame:
    """A line a run: assertions passed of those that need no reader. rolled: grading.rollup(…)."""
    score = F.when(F.col("status") == "MISSING", F.col("status")).otherwise(F.concat("passed", F.lit("/"), "total"))
    return rolled.select("run_id", F.concat(F.format_string("eval-%-23d", "eval_id"), F.lpad(score, 10, " ")).alias("line"))
