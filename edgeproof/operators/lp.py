"""Linear-programme epochs: residuals, acceptance, the exact bound, and a textbook solver for small models.

lp_coef(row, col, val), lp_row(row, sense, rhs), lp_col(col, obj, lb, ub), lp_dual(row, y), lp_primal(col, x).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeproof.functions.scalars import conservative_integer

#: Bits of the fixed point, and the largest scaled dual.
BITS = 24
SCALED = 1e15


@dataclass(frozen=True)
class Model:
    coef: DataFrame
    row: DataFrame
    col: DataFrame
    offset: float = 0.0


def faults(m: Model) -> DataFrame:
    """(what, n): integrity constraints that do not hold."""
    return (
        m.row.where("sense not in ('L', 'G', 'E')").agg(F.lit("sense").alias("what"), F.count("*").alias("n"))
        .unionAll(m.col.where("isnan(lb) or isnan(ub) or lb > ub").agg(F.lit("bounds").alias("what"), F.count("*").alias("n")))
        .unionAll(m.coef.join(m.row, "row", "left_anti").agg(F.lit("row").alias("what"), F.count("*").alias("n")))
        .unionAll(m.coef.join(m.col, "col", "left_anti").agg(F.lit("column").alias("what"), F.count("*").alias("n")))
        .unionAll(m.coef.groupBy("row", "col").count().where("count > 1").agg(F.lit("repeated").alias("what"), F.count("*").alias("n")))
        .where("n > 0")
    )


def row_activity(m: Model, primal: DataFrame) -> DataFrame:
    """(row, activity, violation)."""
    act = m.coef.join(primal, "col").groupBy("row").agg(F.sum(F.col("val") * F.col("x")).alias("activity"))
    rows = m.row.join(act, "row", "left").withColumn("activity", F.coalesce("activity", F.lit(0.0)))
    over, under = F.greatest(F.col("activity") - F.col("rhs"), F.lit(0.0)), F.greatest(F.col("rhs") - F.col("activity"), F.lit(0.0))
    return rows.select("row", "activity", F.when(F.col("sense") == "L", over).when(F.col("sense") == "G", under).otherwise(F.greatest(over, under)).alias("violation"))


def reduced_costs(m: Model, dual: DataFrame) -> DataFrame:
    """(col, reduced): objective less the rows' duals."""
    paid = m.coef.join(dual, "row").groupBy("col").agg(F.sum(F.col("val") * F.col("y")).alias("paid"))
    return m.col.join(paid, "col", "left").select("col", (F.col("obj") - F.coalesce("paid", F.lit(0.0))).alias("reduced"))


def dual_objective(m: Model, dual: DataFrame) -> DataFrame:
    """One row: objective, what a dual (signs as its rows have them) proves in floating point: right sides and offset, and each column at the bound that its reduced cost makes worse; minus infinity where that bound is none."""
    side = F.when(F.col("reduced") >= 0, F.col("lb")).otherwise(F.col("ub"))
    columns = m.col.join(reduced_costs(m, dual), "col").agg(F.coalesce(F.sum(F.when(F.col("reduced") != 0, F.col("reduced") * side).otherwise(0.0)), F.lit(0.0)).alias("c"))
    rows = m.row.join(dual, "row").agg(F.coalesce(F.sum(F.col("rhs") * F.col("y")), F.lit(0.0)).alias("r"))
    return columns.join(F.broadcast(rows)).select((F.col("c") + F.col("r") + m.offset).alias("objective"))


def residuals(m: Model, primal: DataFrame, dual: DataFrame, given: DataFrame) -> DataFrame:
    """One row: max_primal_violation (rows and bounds), and max_reduced_cost_residual against the reduced costs given (col, rc)."""
    rows = row_activity(m, primal).agg(F.max("violation").alias("a"))
    box = m.col.join(primal, "col").agg(F.max(F.greatest(F.col("lb") - F.col("x"), F.col("x") - F.col("ub"), F.lit(0.0))).alias("b"))
    red = reduced_costs(m, dual).join(given, "col").agg(F.max(F.abs(F.col("reduced") - F.col("rc"))).alias("max_reduced_cost_residual"))
    return rows.join(F.broadcast(box)).join(F.broadcast(red)).select(F.greatest("a", "b").alias("max_primal_violation"), "max_reduced_cost_residual")


def accepted(res: DataFrame, status: str) -> DataFrame:
    """``res`` with accepted: an optimal status, violations of at most 1e-7 and residuals of at most 1e-6."""
    return res.withColumn("accepted", (F.lit(status) == "OPTIMAL") & (F.col("max_primal_violation") <= 1e-7) & (F.col("max_reduced_cost_residual") <= 1e-6))


def exact_bound(m: Model, dual: DataFrame, bits: int = BITS) -> DataFrame:
    """One row: certified, numerator (text) and denominator of a lower bound of the model that holds in integers.

    Duals are cut to their row's sign and rounded to the fixed point, half away from zero; each column is put at the bound that its reduced
    numerator makes worse. Not certified (null numerator) if a dual is missing, not finite or beyond 1e15 scaled, or a number that must be an integer
    is none.
    """
    one, big = float(1 << bits), "decimal(38,0)"
    y = F.when(F.col("sense") == "L", F.least("y", F.lit(0.0))).when(F.col("sense") == "G", F.greatest("y", F.lit(0.0))).otherwise(F.col("y"))
    rows = m.row.join(dual, "row", "left").withColumn("s", y * one)
    sound = F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("s") <= SCALED)
    q = F.signum("s") * F.floor(F.abs("s") + 0.5)
    rows = rows.select("row", conservative_integer(F.col("rhs")).cast(big).alias("rhs"), F.when(sound, q).cast(big).alias("q"))
    term = m.coef.join(rows.select("row", "q"), "row").groupBy("col").agg(F.sum(conservative_integer(F.col("val")).cast("decimal(19,0)") * F.col("q").cast("decimal(18,0)")).cast(big).alias("paid"), F.bool_or(conservative_integer(F.col("val")).isNull() | F.col("q").isNull()).alias("bad"))
    cols = m.col.join(term, "col", "left")
    reduced = conservative_integer(F.col("obj")).cast("decimal(19,0)") * F.lit(1 << bits).cast("decimal(18,0)") - F.coalesce("paid", F.lit(0).cast(big))
    cols = cols.withColumn("reduced", reduced.cast(big)).withColumn("side", conservative_integer(F.when(F.col("reduced") >= 0, F.col("lb")).otherwise(F.col("ub"))))
    columns = cols.agg(F.sum(F.col("reduced").cast("decimal(28,0)") * F.col("side").cast("decimal(10,0)")).cast(big).alias("c"), F.coalesce(F.bool_or(F.coalesce("bad", F.lit(False)) | F.col("reduced").isNull() | F.col("side").isNull()), F.lit(False)).alias("c_bad"))
    constant = rows.agg(F.sum((F.col("rhs").cast("decimal(19,0)") * F.col("q").cast("decimal(18,0)")).cast(big)).alias("r"), F.coalesce(F.bool_or(F.col("rhs").isNull() | F.col("q").isNull()), F.lit(False)).alias("r_bad"))
    offset = conservative_integer(F.lit(m.offset))
    both = columns.join(F.broadcast(constant))
    good = ~F.col("c_bad") & ~F.col("r_bad") & offset.isNotNull()
    total = (offset.cast("decimal(19,0)") * F.lit(1 << bits).cast("decimal(18,0)")).cast(big) + F.coalesce("r", F.lit(0).cast(big)) + F.coalesce("c", F.lit(0).cast(big))
    return both.select(good.alias("certified"), F.when(good, total.cast(big).cast("string")).alias("numerator"), F.lit(1 << bits).cast("bigint").alias("denominator"))


def solve_small(m: Model, rounds: int = 20000) -> tuple[dict[int, float], dict[int, float], str]:
    """Primal and dual of a small model (a few hundred rows, collected whole) by a primal-dual hybrid gradient with restarts; and a status."""
    import numpy as np

    rows, cols, coef = m.row.orderBy("row").collect(), m.col.orderBy("col").collect(), m.coef.collect()
    ri, ci = {r["row"]: i for i, r in enumerate(rows)}, {c["col"]: i for i, c in enumerate(cols)}
    a = np.zeros((len(rows), len(cols)))
    for t in coef:
        a[ri[t["row"]], ci[t["col"]]] = t["val"]
    b, c = np.array([r["rhs"] for r in rows]), np.array([x["obj"] for x in cols])
    lo, hi = np.array([x["lb"] for x in cols]), np.array([x["ub"] for x in cols])
    low = np.array([-np.inf if r["sense"] == "E" else 0.0 if r["sense"] == "G" else -np.inf for r in rows])
    high = np.array([np.inf if r["sense"] in "EG" else 0.0 for r in rows])
    step = 0.9 / max(1e-9, np.linalg.norm(a, 2)) if a.size else 1.0
    x, y = np.clip(np.zeros(len(cols)), lo, hi), np.zeros(len(rows))
    sx, sy, n = x.copy(), y.copy(), 1
    status = "ITERATION_LIMIT"
    for k in range(1, rounds + 1):
        nx = np.clip(x - step * (c - a.T @ y), lo, hi)
        y = np.clip(y + step * (b - a @ (2 * nx - x)), low, high)
        x = nx
        sx, sy, n = sx + x, sy + y, n + 1
        if k % 200 == 0:
            mx, my = sx / n, sy / n
            for px, py in ((x, y), (mx, my)):
                act, red = a @ px - b, c - a.T @ py
                feas = max([0.0, *np.where([r["sense"] == "G" for r in rows], -act, np.where([r["sense"] == "L" for r in rows], act, np.abs(act)))])
                gap = c @ px - (b @ py + np.where(red >= 0, red * np.where(np.isfinite(lo), lo, 0), red * np.where(np.isfinite(hi), hi, 0)).sum())
                if feas <= 1e-8 and abs(gap) <= 1e-8 * (1 + abs(c @ px)):
                    return dict(zip(ci, px.tolist(), strict=True)), dict(zip(ri, py.tolist(), strict=True)), "OPTIMAL"
            x, y, sx, sy, n = mx, my, mx.copy(), my.copy(), 1
    return dict(zip(ci, x.tolist(), strict=True)), dict(zip(ri, y.tolist(), strict=True)), status


def solved(e: dict, m: Model) -> tuple[dict, list[float], list[float], list[float]]:
    """The epoch ``e`` with frames ``m``, solved and judged: the facts of a solution file, primal, dual and reduced costs by place. For models that ``solve_small`` takes."""
    start = time.perf_counter()
    x, y, status = solve_small(m)
    spark = m.col.sparkSession
    dual, primal = spark.createDataFrame(list(y.items()), "row int, y double"), spark.createDataFrame(list(x.items()), "col int, x double")
    red = reduced_costs(m, dual)
    res = accepted(residuals(m, primal, dual, red.withColumnRenamed("reduced", "rc")), status).first()
    bound = exact_bound(m, dual).first()
    took = time.perf_counter() - start
    cost = sum(c * x[i] for i, c in enumerate(e["objective"])) + e["objective_offset"]
    held = dual_objective(m, dual).first()["objective"]
    facts = {"solver": "pdhg", "solver_version": "1", "status": status, "termination_status": status, "objective": cost, "dual_objective": held, "solve_time_seconds": took, "max_primal_violation": res["max_primal_violation"], "max_reduced_cost_residual": res["max_reduced_cost_residual"], "numerically_accepted": bool(res["accepted"])}
    facts |= {"exact_model_bound_certified": bound["certified"], "exact_model_bound_numerator": bound["numerator"] or "0", "exact_model_bound_denominator": bound["denominator"], "exact_model_bound_reason": "explicit variables only"}
    rc = {r["col"]: r["reduced"] for r in red.collect()}
    return facts, [x[i] for i in sorted(x)], [y[i] for i in sorted(y)], [rc[i] for i in sorted(rc)]
