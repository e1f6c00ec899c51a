"""LP epoch and solution files."""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeproof.functions import fnv
from edgeproof.operators.lp import Model

from .text import FormatError, lines

# First lines and fields of the formats, in order.
EPOCH_NAME = "CUDAEE_LP_EPOCH_V1"
SOLUTION_NAME = "CUDAEE_LP_SOLUTION_V1"
SOLUTION_ARRAYS = ("primal", "dual", "reduced_costs")
ARRAYS = {"objective": float, "row_offsets": int, "column_indices": int, "values": float, "senses": str, "rhs": float, "lower_bounds": float, "upper_bounds": float, "variable_types": str, "edge_u": int, "edge_v": int}


def epoch_hash(e: dict) -> str:
    out = [struct.pack("<iiid", e["rows"], e["columns"], e["objective_sense"], e["objective_offset"])]
    for name, kind in ARRAYS.items():
        form = {"float": "d", "int": "i", "str": "s"}[kind.__name__]
        out += [struct.pack(f"<{form}", v.encode() if kind is str else v) for v in e[name]]
    return fnv.text(fnv.fnv1a(b"".join(out)))


def validate(e: dict) -> None:
    n, m, nz = e["rows"], e["columns"], len(e["values"])
    sizes = {"objective": m, "row_offsets": n + 1, "column_indices": nz, "senses": n, "rhs": n, "lower_bounds": m, "upper_bounds": m, "variable_types": m, "edge_u": m, "edge_v": m}
    ok = n >= 0 and m > 0 and all(len(e[k]) == v for k, v in sizes.items()) and e["objective_sense"] == 1
    ok = ok and e["row_offsets"][0] == 0 and e["row_offsets"][-1] == nz and all(a <= b for a, b in zip(e["row_offsets"], e["row_offsets"][1:], strict=False))
    ok = ok and all(0 <= c < m for c in e["column_indices"]) and all(s in "LGE" for s in e["senses"]) and all(t == "C" for t in e["variable_types"])
    ok = ok and all(math.isfinite(v) for k in ("objective", "values", "rhs") for v in e[k]) and all(not math.isnan(a) and not math.isnan(b) and a <= b for a, b in zip(e["lower_bounds"], e["upper_bounds"], strict=True))
    if not ok:
        raise FormatError("LP epoch does not hold together")


def _number(v) -> str:
    return format(v, ".17g") if isinstance(v, float) else str(v)


def epoch_text(e: dict) -> str:
    validate(e)
    out = [EPOCH_NAME, *(f"{k} {_number(e[k])}" for k in ("rows", "columns", "objective_sense", "objective_offset"))]
    out += [f"{k} {len(e[k])}" + "".join(f" {_number(v)}" for v in e[k]) for k in ARRAYS]
    return "\n".join([*out, f"hash {epoch_hash(e)}", "END", ""])


def parse_epoch(text: str) -> dict:
    rest = text.split("\n")
    if rest[0] != EPOCH_NAME:
        raise FormatError("no LP epoch")
    e: dict = {}
    for line in rest[1:]:
        f = line.split()
        if not f:
            continue
        if f == ["END"]:
            break
        if f[0] in e:
            raise FormatError(f"{f[0]} stands twice")
        try:
            if f[0] in ("rows", "columns", "objective_sense"):
                (e[f[0]],) = map(int, f[1:])
            elif f[0] == "objective_offset":
                (e[f[0]],) = map(float, f[1:])
            elif f[0] == "hash":
                (e["hash"],) = f[1:]
            elif f[0] in ARRAYS:
                e[f[0]] = [ARRAYS[f[0]](v) for v in f[2:]]
                if len(e[f[0]]) != int(f[1]):
                    raise ValueError(f[0])
            else:
                raise FormatError(f"unknown field {f[0]}")
        except ValueError as x:
            raise FormatError(f"{f[0]} can't be read") from x
    else:
        raise FormatError("LP epoch without END")
    if missing := {"rows", "columns", "objective_sense", "objective_offset", "hash", *ARRAYS} - e.keys():
        raise FormatError(f"LP epoch without {', '.join(sorted(missing))}")
    validate(e)
    if epoch_hash(e) != e["hash"]:
        raise FormatError("LP epoch hash")
    return e


def frames(spark: SparkSession, e: dict) -> Model:
    """The epoch as lp_coef, lp_row and lp_col (with the edge of each column; -1 without)."""
    coef = [(r, e["column_indices"][k], e["values"][k]) for r in range(e["rows"]) for k in range(e["row_offsets"][r], e["row_offsets"][r + 1])]
    row = [(r, s, b) for r, (s, b) in enumerate(zip(e["senses"], e["rhs"], strict=True))]
    col = list(zip(range(e["columns"]), e["objective"], e["lower_bounds"], e["upper_bounds"], e["edge_u"], e["edge_v"], strict=True))
    return Model(
        spark.createDataFrame(coef, "row int, col int, val double"), spark.createDataFrame(row, "row int, sense string, rhs double"),
        spark.createDataFrame(col, "col int, obj double, lb double, ub double, u int, v int"), e["objective_offset"],
    )


def example() -> dict:
    """min x + 2y, x + y >= 1, both in [0, 1]."""
    return {"rows": 1, "columns": 2, "objective_sense": 1, "objective_offset": 0.0, "objective": [1.0, 2.0], "row_offsets": [0, 2], "column_indices": [0, 1], "values": [1.0, 1.0], "senses": ["G"], "rhs": [1.0], "lower_bounds": [0.0, 0.0], "upper_bounds": [1.0, 1.0], "variable_types": ["C", "C"], "edge_u": [0, 0], "edge_v": [1, 2]}


def solution_text(model_hash: str, facts: dict, primal: list[float], dual: list[float], reduced: list[float]) -> str:
    """A solution: facts by field name, in order, then the three arrays."""
    out = [SOLUTION_NAME, f"model_hash {model_hash}", *(f"{k} {_number(int(v) if isinstance(v, bool) else v)}" for k, v in facts.items())]
    out += [f"{k} {len(a)}" + "".join(f" {_number(v)}" for v in a) for k, a in zip(SOLUTION_ARRAYS, (primal, dual, reduced), strict=True)]
    return "\n".join([*out, "END", ""])


def read_solution(spark: SparkSession, path: str) -> DataFrame:
    """(field, at, value) of a solution file: a fact's value with ``at`` null, each entry of the three arrays with its place.

    A FormatError names a first or last line that is not the format's, a field that stands twice or has no value, and an array that is
    missing or whose count is not that of its entries.
    """
    rows = lines(spark, path)
    ends = rows.agg(F.min(F.struct("n", "line")).alias("first"), F.max(F.struct("n", "line")).alias("last")).first()
    if ends["first"] is None or ends["first"]["line"] != SOLUTION_NAME or ends["last"]["line"] != "END":
        raise FormatError(f"a solution starts with {SOLUTION_NAME} and stops with END")
    word = F.split("line", " +")
    body = rows.where((F.col("n") > ends["first"]["n"]) & (F.col("n") < ends["last"]["n"])).select(word[0].alias("field"), word.alias("words"), F.expr("substring(line, length(split_part(line, ' ', 1)) + 2)").alias("rest"))
    array = F.col("field").isin(*SOLUTION_ARRAYS)
    wrong = F.when(array, ~F.coalesce(F.expr("try_cast(words[1] AS INT)") == F.size("words") - 2, F.lit(False))).otherwise(F.col("rest") == "")
    seen = body.groupBy("field").agg(F.count("*").alias("k"), F.max(wrong).alias("wrong"))
    found = seen.agg(F.count_if(F.col("field").isin(*SOLUTION_ARRAYS)).alias("arrays"), F.min(F.when(F.col("wrong") | (F.col("k") > 1), F.col("field"))).alias("bad")).first()
    if found["bad"] is not None or found["arrays"] != len(SOLUTION_ARRAYS):
        raise FormatError(f"solution field {found['bad']} is wrong" if found["bad"] is not None else "a solution has three arrays")
    facts = body.where(~array).select("field", F.lit(None).cast("int").alias("at"), F.col("rest").alias("value"))
    entries = body.where(array).select("field", F.posexplode(F.expr("slice(words, 3, size(words) - 2)")).alias("at", "value"))
    return facts.unionByName(entries)
