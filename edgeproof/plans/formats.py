"""Registered queries of the sources and sinks (each writes files from the driver's tables, by Spark, reads them back and returns what it read), of scalar functions, predicates and LP models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeproof.functions import distance as D
from edgeproof.functions import fnv
from edgeproof.functions import scalars as S
from edgeproof.operators import catalogs, epochs, kopt, lp, tour
from edgeproof.sources import lp as lp_files
from edgeproof.sources import proofs, text

from . import registry as R
from . import synth
from .cut import cut, fresh_path

_query = R._query

# ---- files ----


@_query(f"WITH p AS ({R._POINTS['supp']}) SELECT id, ix, iy, 'CEIL_2D' AS kind, (SELECT count(*) FROM p) AS dimension FROM p")
def source_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point file of the suppliers, packed by gzip."""
    path = fresh_path(spark, "points")
    text.write_points(synth.points_of_suppliers(spark, sf_dir), "CEIL_2D", path, "gzip")
    p, kind, n = text.read_points(spark, path, "supp")
    return p.select("id", "ix", "iy", F.lit(kind).alias("kind"), F.lit(n).cast("bigint").alias("dimension"))


@_query(f"WITH {R._graph_sql('emb')} SELECT edge_id, u, v, w AS weight FROM e")
def source_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge list of the graph's active edges."""
    g, path = synth.embeddings_graph(spark, sf_dir), fresh_path(spark, "edges")
    text.write_active_edges(g, path)
    return text.read_edges(spark, path, "emb", g.points.count()).select("edge_id", "u", "v", "weight")


@_query(f"WITH {R._graph_sql('emb')} SELECT (SELECT count(*) FROM p) AS points, count(*) AS edges, CAST(sum(w) AS BIGINT) AS weight FROM e")
def source_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole graph from its two files, every weight checked against the points."""
    g, points, edges = synth.embeddings_graph(spark, sf_dir), fresh_path(spark, "points"), fresh_path(spark, "edges")
    text.write_points(g.points, "EUC_2D", points)
    text.write_active_edges(g, edges)
    got = text.read_graph(spark, points, edges)
    return got.edges.agg(F.lit(got.points.count()).cast("bigint").alias("points"), F.count("*").alias("edges"), F.sum("weight").alias("weight"))


_TOUR = f"p AS ({R._POINTS['emb']}), t AS (SELECT row_number() OVER (ORDER BY ix, iy, id) - 1 AS pos, id AS node FROM p)"


def _tour(g) -> DataFrame:
    return g.points.select("g", (F.row_number().over(Window.partitionBy("g").orderBy("ix", "iy", "id")) - 1).alias("pos"), F.col("id").alias("node"))


@_query(f"WITH {_TOUR} SELECT CAST(pos AS INTEGER) AS pos, node FROM t")
def source_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tour file of the points from left to right."""
    g, path = synth.embeddings_graph(spark, sf_dir), fresh_path(spark, "tour")
    text.write_tour(_tour(g), path)
    return text.read_tour(spark, path, "emb", g.points.count()).select("pos", "node")


@_query(f"WITH {_TOUR}, s AS (SELECT least(a.node, b.node) AS u, greatest(a.node, b.node) AS v FROM t a JOIN t b ON b.pos = (a.pos + 1) % (SELECT count(*) FROM t)) SELECT {R._fnv_sql(f'{R._bytes("count(*)", 4)} || flatten(list({R._bytes("CAST(u AS BIGINT)", 4)} || {R._bytes("CAST(v AS BIGINT)", 4)} ORDER BY u, v))', fnv.TOUR_BASIS)} AS hash FROM s")
def tour_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = synth.embeddings_graph(spark, sf_dir)
    return tour.tour_hash(g, _tour(g)).select("hash")


@_query("SELECT s_name AS instance, 'points/' || s_suppkey AS tsp, 'edges/' || s_nationkey AS edges, CAST(s_suppkey AS BIGINT) * 100 AS optimum FROM supplier")
def source_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instance table with a comment line."""
    s, path = spark.read.parquet(f"{sf_dir}/supplier.parquet"), fresh_path(spark, "instances")
    rows = s.select(F.concat_ws("\t", "s_name", F.concat(F.lit("points/"), "s_suppkey"), F.concat(F.lit("edges/"), "s_nationkey"), F.col("s_suppkey") * 100).alias("value"))
    rows.unionAll(spark.createDataFrame([("# instance\ttsp\tedges\toptimum",)], "value string")).write.text(path)
    return text.read_instances(spark, path)


@_query("SELECT s_name AS instance, 'https://example.org/' || s_suppkey AS url, sha256(s_name) AS sha256, s_name || '.tour' AS file FROM supplier")
def source_tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of tour files."""
    s, path = spark.read.parquet(f"{sf_dir}/supplier.parquet"), fresh_path(spark, "tours")
    s.select(F.concat_ws("\t", "s_name", F.concat(F.lit("https://example.org/"), "s_suppkey"), F.sha2("s_name", 256), F.concat("s_name", F.lit(".tour"))).alias("value")).write.text(path)
    return text.read_tour_sources(spark, path)


@_query(f"{R._FIXED} {R._RECORDS}")
def source_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an elimination proof, written as text and parsed again."""
    r = epochs.jv_fixed_point(synth.suppliers_graph(spark, sf_dir))
    return proofs.records_frame(spark, proofs.parse_proof(proofs.proof_text(r, "supp")), "supp").drop("g")


@_query(f"{R._FIXED} SELECT epoch, count(*) AS records FROM ({R._RECORDS}) GROUP BY epoch")
def proof_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a proof as Parquet by epoch, counted from the files."""
    path = fresh_path(spark, "proof")
    proofs.write_tables(epochs.jv_fixed_point(synth.suppliers_graph(spark, sf_dir)), path)
    return spark.read.parquet(f"{path}/records").groupBy("epoch").agg(F.count("*").alias("records"))


_EPOCH = "c AS (SELECT n_nationkey AS col, n_regionkey AS row, n_nationkey * 7 % 23 + 1 AS obj FROM nation)"


def _epoch(spark: SparkSession, sf_dir: str) -> dict:
    """A covering model: each region must take a nation of its own; costs by rule. The format is one text, so its rows are on the driver."""
    rows = sorted((r["n_regionkey"], r["n_nationkey"]) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect())
    regions, n = sorted({r for r, _ in rows}), len(rows)
    offsets = [sum(r < k for r, _ in rows) for k in regions] + [n]
    return {
        "rows": len(regions), "columns": n, "objective_sense": 1, "objective_offset": 0.0, "objective": [float(k * 7 % 23 + 1) for k in range(n)], "row_offsets": offsets, "column_indices": [c for _, c in rows], "values": [1.0] * n,
        "senses": ["G"] * len(regions), "rhs": [1.0] * len(regions), "lower_bounds": [0.0] * n, "upper_bounds": [1.0] * n, "variable_types": ["C"] * n, "edge_u": list(range(n)), "edge_v": [k + 1 for k in range(n)],
    }


@_query(f"WITH {_EPOCH} SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CAST(1 AS DOUBLE) AS val, CAST(obj AS DOUBLE) AS obj, 'G' AS sense, CAST(1 AS DOUBLE) AS rhs, CAST(col AS INTEGER) AS u, CAST(col + 1 AS INTEGER) AS v FROM c")
def source_lp_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An LP epoch, written as text by Spark, read and parsed again: its coefficients with their row, column and edge."""
    path = fresh_path(spark, "lp")
    spark.createDataFrame([(lp_files.epoch_text(_epoch(spark, sf_dir)),)], "value string").coalesce(1).write.text(path)
    m = lp_files.frames(spark, lp_files.parse_epoch(spark.read.text(path, wholetext=True).first()[0]))
    return m.coef.join(m.col.select("col", "obj", "u", "v"), "col").join(m.row, "row").select("row", "col", "val", "obj", "sense", "rhs", "u", "v")


@_query(f"WITH {_EPOCH}, b AS (SELECT row, min(obj) AS m FROM c GROUP BY row) SELECT 'OPTIMAL' AS status, CAST(sum(m) AS DOUBLE) AS objective, CAST(sum(m) AS DOUBLE) AS dual_objective FROM b")
def lp_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epoch solved: primal and dual objective, to six places."""
    m = lp_files.frames(spark, _epoch(spark, sf_dir))
    x, y, status = lp.solve_small(m)
    primal, dual = spark.createDataFrame(list(x.items()), "col int, x double"), spark.createDataFrame(list(y.items()), "row int, y double")
    cost = m.col.join(primal, "col").agg(F.round(F.sum(F.col("obj") * F.col("x")), 5).alias("objective"))
    held = lp.dual_objective(m, dual).select(F.round("objective", 5).alias("dual_objective"))
    return cost.join(F.broadcast(held)).select(F.lit(status).alias("status"), "objective", "dual_objective")


@_query(f"WITH {_EPOCH}, b AS (SELECT row, min(obj) AS m FROM c GROUP BY row) SELECT 'primal' AS field, CAST(col AS INTEGER) AS at, CAST(obj = m AS DOUBLE) AS value FROM c JOIN b USING (row) UNION ALL SELECT 'objective', NULL, CAST(sum(m) AS DOUBLE) FROM b")
def source_lp_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epoch solved, its solution written as text by Spark and read again: the objective and each nation's value, to four places."""
    path, e = fresh_path(spark, "solution"), _epoch(spark, sf_dir)
    text_ = lp_files.solution_text(lp_files.epoch_hash(e), *lp.solved(e, lp_files.frames(spark, e)))
    spark.createDataFrame([(text_,)], "value string").coalesce(1).write.text(path)
    value = F.round(F.col("value").cast("double"), 4) + F.lit(0.0)
    return lp_files.read_solution(spark, path).where(F.col("field").isin("primal", "objective")).select("field", "at", value.alias("value"))


# ---- scalar functions and predicates ----


@_query("SELECT a.c_custkey AS k, CAST(floor(sqrt((a.c_acctbal - b.c_acctbal) * (a.c_acctbal - b.c_acctbal) + 0.25) + 0.5) AS BIGINT) AS euc, CAST(ceil(sqrt((a.c_acctbal - b.c_acctbal) * (a.c_acctbal - b.c_acctbal) + 0.25)) AS BIGINT) AS ceiling FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1")
def floating_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of points without integer coordinates: each customer's balance and the next one's, half a unit apart."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"))
    both = c.join(c.select((F.col("k") - 1).alias("k"), F.col("x").alias("z")), "k")
    d = lambda kind: D.floating(F.col("x"), F.lit(0.0), F.col("z"), F.lit(0.5), kind)
    return both.select("k", d("EUC_2D").alias("euc"), d("CEIL_2D").alias("ceiling"))


@_query("SELECT count(*) FILTER (WHERE c_acctbal = floor(c_acctbal)) AS whole, count(*) AS n, CAST(power(max(floor(c_acctbal)) - min(floor(c_acctbal)), 2) + power(max(c_custkey) - min(c_custkey), 2) <= 9223372036854775807 AS BOOLEAN) AS safe FROM customer")
def coordinate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many balances are integer coordinates, and whether squared distances in the box fit BIGINT."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_acctbal").alias("x"), F.floor("c_acctbal").alias("ix"), F.col("c_custkey").alias("iy"))
    big = lambda c: (F.max(c) - F.min(c)).cast("decimal(19,0)")
    return c.agg(F.count_if(D.is_integer(F.col("x"))).alias("whole"), F.count("*").alias("n"), ((big("ix") * big("ix") + big("iy") * big("iy")) <= F.lit(D.SAFE_LIMIT)).alias("safe"))


@_query("""SELECT c_custkey AS k, lower(lpad(to_hex(c_custkey * 2654435761), 16, '0')) AS hex, TRY_CAST(CAST(c_custkey AS HUGEINT) * 12345678901234567 AS BIGINT) AS product, TRY_CAST(CAST(c_custkey AS HUGEINT) * 1000000000000000 + 9223372036000000000 AS BIGINT) AS total,
TRY_CAST(CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 4 = 1 THEN '-' || c_custkey END AS BIGINT) AS number, CASE WHEN c_custkey % 2 = 0 THEN lower(lpad(to_hex(c_custkey), 16, '0')) END AS hash, trim(c_name || ' x ' || c_custkey) AS line,
CASE WHEN abs(c_acctbal - round(c_acctbal)) <= 1e-9 THEN CAST(round(c_acctbal) AS BIGINT) END AS whole, list_extract([1, 2, 8, 48, 384, 3840, 46080], CAST(c_custkey % 7 + 1 AS INTEGER)) :: BIGINT AS outside, list_extract([1, 3, 15, 105, 945, 10395, 135135], CAST(c_custkey % 7 + 1 AS INTEGER)) :: BIGINT AS inside FROM customer""")
def more_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexadecimal digits, checked arithmetic, strict tokens, single lines, integers that doubles stand for, and counts of matchings."""
    k, name = F.col("c_custkey"), F.col("c_custkey").cast("string")
    # the total is (k + 9223) * 10^15 + 372036 * 10^9: its product passes BIGINT only where the sum does, so null means the same
    token = F.when(k % 4 == 0, name).when(k % 4 == 1, F.concat(F.lit("-"), name)).when(k % 4 == 2, F.concat(F.lit("+"), name)).otherwise(F.concat(name, F.lit("x")))
    digits = F.when(k % 2 == 0, S.hex16(k)).otherwise(F.upper(F.concat(F.lit("A"), S.hex16(k))))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("k"), S.hex16(k * 2654435761).alias("hex"), S.checked_product(k.cast("bigint"), F.lit(12345678901234567)).alias("product"), S.checked_sum(S.checked_product(k.cast("bigint") + 9223, F.lit(1000000000000000)), F.lit(372036000000000)).alias("total"),
        S.strict_integer(token).alias("number"), S.strict_hash(digits).alias("hash"), S.single_line(F.concat(F.lit(" \t"), "c_name", F.lit("\nx\r"), name, F.lit("\n"))).alias("line"),
        S.conservative_integer(F.col("c_acctbal")).alias("whole"), S.outside_count((k % 7 + 1).cast("int")).alias("outside"), S.inside_count((k % 7 + 1).cast("int")).alias("inside"),
    )


@_query("SELECT c_custkey AS k, list_sort([(c_custkey // 64) % 4, (c_custkey // 16) % 4, (c_custkey // 4) % 4, c_custkey % 4]) = [0, 1, 2, 3] AND (c_custkey // 64) % 4 <> 0 AND ([(c_custkey // 64) % 4, (c_custkey // 16) % 4, (c_custkey // 4) % 4, c_custkey % 4])[(c_custkey // 64) % 4 + 1] = 0 AND ([(c_custkey // 64) % 4, (c_custkey // 16) % 4, (c_custkey // 4) % 4, c_custkey % 4])[(c_custkey // 16) % 4 + 1] = 1 AND (c_custkey // 16) % 4 <> 1 AND (c_custkey // 4) % 4 <> 2 AS perfect FROM customer")
def matching_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which arrays of four mates, the digits of a key in base four, are perfect matchings."""
    k = F.col("c_custkey").cast("int")
    digit = lambda n: F.floor(k / n).cast("int") % 4
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), catalogs.is_perfect(F.array(digit(64), digit(16), digit(4), digit(1)), F.lit(2)).alias("perfect"))


_ASKED = "ask AS (SELECT c_custkey AS k, CAST(6 + c_custkey % 2 AS INTEGER) AS m, CAST(c_custkey AS BIGINT) * 7919 % (CASE WHEN c_custkey % 2 = 0 THEN 3840 ELSE 46080 END) AS outside_id, CAST(c_custkey AS BIGINT) * 104729 % (CASE WHEN c_custkey % 2 = 0 THEN 10395 ELSE 135135 END) AS inside_id FROM customer)"


@_query(f"""WITH RECURSIVE {R._upto(R._OUTSIDE_SQL, 7)}, {R._upto(R._INSIDE_SQL, 7)}, {_ASKED},
go AS (SELECT k, ask.m, o.mates AS x, i.mates AS y, i.mates[o.mates[1] + 1] AS pos, 1 AS n FROM ask JOIN outside o ON o.m = ask.m AND o.id = ask.outside_id JOIN inside i ON i.m = ask.m AND i.id = ask.inside_id
  UNION ALL SELECT k, m, x, y, y[x[pos + 1] + 1], n + 1 FROM go WHERE pos <> 0 AND n <= m)
SELECT k, n = m AS compatible FROM go WHERE pos = 0""")
def path_compat_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility of pairs of six and seven paths, evaluated directly, one a customer."""
    k = F.col("c_custkey").cast("bigint")
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("k"), (k % 2 + 6).cast("int").alias("m"), (k * 7919 % F.when(k % 2 == 0, 3840).otherwise(46080)).alias("outside_id"), (k * 104729 % F.when(k % 2 == 0, 10395).otherwise(135135)).alias("inside_id"))
    return catalogs.evaluate(spark, asked).select("k", "compatible")


# ---- search, leaves ----


#: A leaf of two paths of three points is proven if, for both ways to join the paths outside, some tour through the outside joins and without the target
#: edge costs less inside than the paths: all 120 orders of six points, by brute force.
_LEAVES = f"""p AS ({R._POINTS["emb"]}), perm AS (SELECT [0] AS t UNION ALL SELECT t || [x] FROM (SELECT t, unnest(range(1, 6)) AS x FROM perm WHERE len(t) < 6) WHERE NOT list_contains(t, x)),
cyc AS (SELECT row_number() OVER (ORDER BY t) AS c, t FROM perm WHERE len(t) = 6), hop AS (SELECT c, t[i + 1] AS a, t[(i + 1) % 6 + 1] AS b FROM (SELECT *, unnest(range(6)) AS i FROM cyc)), step AS (SELECT c, least(a, b) AS a, greatest(a, b) AS b FROM hop),
joint(o, a, b) AS (VALUES (0, 2, 3), (0, 0, 5), (1, 2, 5), (1, 0, 3)), way AS (SELECT c, o FROM step JOIN joint USING (a, b) GROUP BY c, o HAVING count(*) = 2),
inner_edge AS (SELECT way.c, way.o, step.a, step.b FROM way JOIN step USING (c) WHERE NOT EXISTS (SELECT 1 FROM joint v WHERE v.o = way.o AND v.a = step.a AND v.b = step.b)),
free AS (SELECT c, o FROM inner_edge GROUP BY c, o HAVING count(*) FILTER (WHERE a = 0 AND b = 1) = 0),
gap AS (SELECT x.id // 6 AS k, x.id % 6 AS a, y.id % 6 AS b, {R._dist("x", "y")} AS d FROM p x JOIN p y ON x.id // 6 = y.id // 6 AND x.id < y.id WHERE x.id // 6 IN (SELECT id // 6 FROM p GROUP BY id // 6 HAVING count(*) = 6)),
own AS (SELECT k, sum(d) AS d FROM gap WHERE (a = 0 AND b = 1) OR (a = 1 AND b = 2) OR (a = 3 AND b = 4) OR (a = 4 AND b = 5) GROUP BY k),
cost AS (SELECT k, c, o, sum(d) AS d FROM free JOIN inner_edge USING (c, o) JOIN gap USING (a, b) GROUP BY k, c, o), best AS (SELECT k, o, min(d) AS d FROM cost GROUP BY k, o)"""


@_query(f"WITH RECURSIVE {_LEAVES} SELECT k, true AS proof_same, bool_and(best.d < own.d) AS proven, bool_and(best.d < own.d) AS verified, CAST(2 AS INTEGER) AS path_count, CAST(2 AS BIGINT) AS outside_count FROM best JOIN own USING (k) GROUP BY k")
def leaf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf proofs of windows of six points, read back from their text: whether each is as it was, is proven (in SQL by all tours), and is taken by the independent verifier, which must take the proven ones and no others."""
    def back(rows: pd.DataFrame) -> pd.DataFrame:
        leaf = [kopt.leaf_of(r) for r in rows.to_dict("records")]
        parsed = [proofs.parse_leaf(proofs.leaf_text(f, "0" * 16))[0] for f in leaf]
        return pd.DataFrame({"proof_same": [f == g for f, g in zip(leaf, parsed, strict=True)], "proven": [g.proven for g in parsed], "path_count": [g.path_count for g in parsed], "outside_count": [g.outside_count for g in parsed]})

    got = cut(R._six(spark, sf_dir).withColumn("leaf", kopt.leaves(F.col("paths"), F.col("places"), F.lit(0), F.lit(1), kopt.Options(3, 0, 10))))
    told = got.withColumn("told", F.pandas_udf(back, "proof_same boolean, proven boolean, path_count int, outside_count bigint")(F.col("leaf")))
    verdict = kopt.leaf_verdicts(F.col("paths"), F.col("places"), F.lit(0), F.lit(1), F.col("leaf"))
    return told.select("k", "told.*", (verdict == "ok").alias("verified"))


# ---- models ----


@_query("SELECT 'sense' AS what, (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey % 5 = 0 AND c_nationkey % 7 <> 0) AS n UNION ALL SELECT 'bounds', (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0) UNION ALL SELECT 'row', (SELECT CAST(sum(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) FROM customer WHERE c_nationkey % 7 = 0) UNION ALL SELECT 'repeated', (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0)")
def lp_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints that a model breaks by rule: senses, bounds, rows that are missing, coefficients that stand twice."""
    m, _, _ = R._model(spark, sf_dir)
    row = m.row.where("row % 7 <> 0").withColumn("sense", F.when(F.col("row") % 5 == 0, "X").otherwise("G"))
    col = m.col.withColumn("ub", F.when(F.col("col") % 10 == 0, -1.0).otherwise(1.0))
    return lp.faults(lp.Model(m.coef.unionAll(m.coef.where("col % 3 = 0")), row, col))


@_query("SELECT c_custkey AS k, c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 AS accepted FROM customer")
def lp_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numerical gate over residuals and states by rule."""
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("k"), F.when(k % 3 == 0, 2e-7).otherwise(1e-7).alias("max_primal_violation"), F.when(k % 4 == 0, 2e-6).otherwise(1e-6).alias("max_reduced_cost_residual"))
    ended = lp.accepted(rows.where("k % 5 <> 0"), "OPTIMAL").unionAll(lp.accepted(rows.where("k % 5 = 0"), "ITERATION_LIMIT"))
    return ended.select("k", "accepted")
