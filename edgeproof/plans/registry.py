"""Registered queries of the edge-elimination operators, and DuckDB SQL with the same rows.

Graphs come from the driver's tables (plans/synth.py); SQL repeats the definitions over all pairs of points, which is fine for a check.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeproof.functions import distance as D
from edgeproof.functions import fnv
from edgeproof.functions import scalars as S
from edgeproof.operators import catalogs, commit, epochs, ht, ht_verify, jv, kopt, lazy, lp, paths, tour, wavefront
from edgeproof.operators.graph import Graph, nearest, number_edges, violations

from . import synth
from .cut import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["jv_candidates"](spark, sf_dir)


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _dist(a: str, b: str) -> str:
    return f"CAST(floor(sqrt(CAST(({a}.ix-{b}.ix)*({a}.ix-{b}.ix)+({a}.iy-{b}.iy)*({a}.iy-{b}.iy) AS DOUBLE))+0.5) AS BIGINT)"


_POINTS = {
    "emb": "SELECT CAST(vec_id AS INTEGER) AS id, CAST(floor(1e6*CAST(embedding[1] AS DOUBLE)) AS BIGINT) AS ix, CAST(floor(1e6*CAST(embedding[2] AS DOUBLE)) AS BIGINT) AS iy FROM embeddings",
    "supp": "SELECT CAST(s_suppkey AS INTEGER) AS id, CAST(round(100*s_acctbal) AS BIGINT) AS ix, CAST((7919*s_suppkey)%100003*10 AS BIGINT) AS iy FROM supplier",
}


def _graph_sql(which: str) -> str:
    return f"""p AS ({_POINTS[which]}),
nn AS (SELECT a, b, w, row_number() OVER (PARTITION BY a ORDER BY w, b) AS r FROM (SELECT a.id AS a, b.id AS b, {_dist("a", "b")} AS w FROM p a, p b WHERE a.id <> b.id)),
e0 AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v, w FROM nn WHERE r <= 8),
e AS (SELECT CAST(row_number() OVER (ORDER BY u, v) - 1 AS INTEGER) AS edge_id, u, v, w FROM e0),
adj AS (SELECT u AS n, v AS m, edge_id, w FROM e UNION ALL SELECT v, u, edge_id, w FROM e),
deg AS (SELECT p.id, count(adj.m) AS degree FROM p LEFT JOIN adj ON adj.n = p.id GROUP BY p.id),
gate AS (SELECT e.* FROM e JOIN deg a ON a.id = e.u AND a.degree > 2 JOIN deg b ON b.id = e.v AND b.degree > 2)"""


def _held_sql(ctes: str) -> str:
    """The same CTEs, each computed once."""
    return re.sub(r"(^|, |,\n)(\w+) AS \((?=SELECT|WITH|VALUES)", r"\1\2 AS MATERIALIZED (", ctes)


def _jv_sql(which: str) -> str:
    return f"""{_graph_sql(which)},
c0 AS (SELECT DISTINCT g.edge_id, g.u, g.v, g.w, adj.m AS c FROM gate g JOIN adj ON adj.n = g.u AND adj.m <> g.v UNION SELECT g.edge_id, g.u, g.v, g.w, adj.m FROM gate g JOIN adj ON adj.n = g.v AND adj.m <> g.u),
c1 AS (SELECT c0.*, {_dist("a", "q")} AS ac, {_dist("q", "b")} AS cb FROM c0 JOIN p a ON a.id = c0.u JOIN p b ON b.id = c0.v JOIN p q ON q.id = c0.c),
top AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY ac + cb, c) AS rank FROM c1 QUALIFY rank <= 10),
bad AS (SELECT DISTINCT t.edge_id, t.c FROM top t JOIN adj ON adj.n = t.c AND adj.m <> t.u AND adj.m <> t.v JOIN p d ON d.id = adj.m JOIN p a ON a.id = t.u JOIN p b ON b.id = t.v
  WHERE t.w + adj.w <= t.ac + {_dist("d", "b")} OR t.w + adj.w <= {_dist("a", "d")} + t.cb),
cand AS (SELECT edge_id, u, v, c AS witness FROM (SELECT t.*, row_number() OVER (PARTITION BY t.edge_id ORDER BY rank) AS k FROM top t ANTI JOIN bad ON bad.edge_id = t.edge_id AND bad.c = t.c) WHERE k = 1)"""


# ---- distances and graphs ----


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's point with those of the next 20 keys."""
    p = synth.points_of_suppliers(spark, sf_dir)
    a = p.select(F.col("id").alias("a"), F.col("ix").alias("ax"), F.col("iy").alias("ay"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 20)).alias("b"))
    return a.join(p.select(F.col("id").alias("b"), F.col("ix").alias("bx"), F.col("iy").alias("by")), "b")


_S = "(a.ix-b.ix)*(a.ix-b.ix)+(a.iy-b.iy)*(a.iy-b.iy)"
_PAIR_SQL = f"p AS ({_POINTS['supp']}), s AS (SELECT a.id AS a, b.id AS b, {_S} AS s, CAST(floor(sqrt(CAST({_S} AS DOUBLE))) AS BIGINT) AS r0 FROM p a JOIN p b ON b.id > a.id AND b.id <= a.id + 20), r AS (SELECT a, b, s, r0 - CAST(r0*r0 > s AS BIGINT) + CAST((r0+1)*(r0+1) <= s AS BIGINT) AS r FROM s)"


def _distances(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    s = D.squared(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return _pairs(spark, sf_dir).select("a", "b", D.rounded(s, kind, fast=False).alias("d"))


@_query(f"WITH {_PAIR_SQL} SELECT a, b, r + CAST(s - r*r > r AS BIGINT) AS d FROM r")
def exact_distance_euc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distances(spark, sf_dir, "EUC_2D")


@_query(f"WITH {_PAIR_SQL} SELECT a, b, r + CAST(r*r <> s AS BIGINT) AS d FROM r")
def exact_distance_ceil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distances(spark, sf_dir, "CEIL_2D")


@_query(f"WITH {_graph_sql('emb')} SELECT edge_id, u, v, w AS weight FROM e")
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.embeddings_graph(spark, sf_dir).edges.select("edge_id", "u", "v", "weight")


@_query(f"WITH {_graph_sql('supp')} SELECT a, b, w AS d, r AS rank FROM nn WHERE r <= 8")
def knn_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(synth.points_of_suppliers(spark, sf_dir), 8).select("a", "b", "d", F.col("rank").cast("bigint").alias("rank"))


@_query(f"WITH {_graph_sql('emb')} SELECT n, m, edge_id, w AS weight FROM adj")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.embeddings_graph(spark, sf_dir).adjacency().drop("g")


@_query(f"WITH {_graph_sql('emb')} SELECT id, degree FROM deg")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.embeddings_graph(spark, sf_dir).degree().drop("g")


@_query(f"WITH {_graph_sql('supp')} SELECT 'weight' AS what, count(*) AS n FROM e JOIN p a ON a.id = e.u JOIN p b ON b.id = e.v WHERE e.edge_id % 7 = 0")
def graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity constraints of a graph a seventh of whose weights is one too large."""
    g = synth.suppliers_graph(spark, sf_dir)
    g = g.with_edges(g.edges.withColumn("weight", F.col("weight") + (F.col("edge_id") % 7 == 0).cast("bigint")))
    return violations(g).select("what", "n")


# ---- quick elimination ----


@_query(f"WITH {_jv_sql('emb')} SELECT edge_id, c, ac + cb AS score, rank FROM top")
def jv_topk_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jv.ranked_witnesses(synth.embeddings_graph(spark, sf_dir)).select("edge_id", "c", "score", "rank")


@_query(f"WITH {_jv_sql('emb')} SELECT u, v, witness FROM cand")
def jv_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jv.candidates(synth.embeddings_graph(spark, sf_dir)).select("u", "v", "witness")


@_query(f"""WITH {_jv_sql("emb")}, prop AS (SELECT edge_id, u, v, CASE WHEN edge_id % 3 = 0 THEN u ELSE witness END AS witness FROM cand UNION ALL SELECT edge_id, u, v, c FROM top WHERE rank = 1 AND edge_id NOT IN (SELECT edge_id FROM cand)),
w AS (SELECT prop.*, {_dist("a", "q")} AS ac, {_dist("q", "b")} AS cb, {_dist("a", "b")} AS ab FROM prop JOIN p a ON a.id = prop.u JOIN p b ON b.id = prop.v JOIN p q ON q.id = prop.witness),
no AS (SELECT DISTINCT w.edge_id FROM w JOIN adj ON adj.n = w.witness AND adj.m <> w.u AND adj.m <> w.v JOIN p d ON d.id = adj.m JOIN p a ON a.id = w.u JOIN p b ON b.id = w.v WHERE ab + adj.w <= ac + {_dist("d", "b")} OR ab + adj.w <= {_dist("a", "d")} + cb)
SELECT u, v, witness, witness <> u AND witness <> v AND edge_id NOT IN (SELECT edge_id FROM no) AS ok FROM w""")
def jv_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verifier over candidates, a third of them with an end for a witness, and over the first witness of all other edges."""
    g = synth.embeddings_graph(spark, sf_dir)
    ranked = cut(jv.ranked_witnesses(g))
    c = jv.first_sound(g, ranked).withColumn("witness", F.when(F.col("edge_id") % 3 == 0, F.col("u")).otherwise(F.col("witness")))
    c = cut(c)
    rest = ranked.where("rank = 1").select("g", "edge_id", "u", "v", F.col("c").alias("witness")).join(c, ["g", "edge_id"], "left_anti")
    return jv.verify(g, c.unionByName(rest)).select("u", "v", "witness", "ok")


@_query(f"""WITH RECURSIVE {_jv_sql("supp")}, ranked AS (SELECT c.*, row_number() OVER (ORDER BY u, v, witness, edge_id) AS k, a.degree AS du, b.degree AS dv FROM cand c JOIN deg a ON a.id = c.u JOIN deg b ON b.id = c.v),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS ends, CAST([] AS BIGINT[]) AS acc UNION ALL
  SELECT r.k, CASE WHEN r.du - len(list_filter(w.ends, lambda x: x = r.u)) > 2 AND r.dv - len(list_filter(w.ends, lambda x: x = r.v)) > 2 THEN w.ends || [r.u, r.v] ELSE w.ends END,
  CASE WHEN r.du - len(list_filter(w.ends, lambda x: x = r.u)) > 2 AND r.dv - len(list_filter(w.ends, lambda x: x = r.v)) > 2 THEN w.acc || [r.k] ELSE w.acc END FROM walk w JOIN ranked r ON r.k = w.k + 1),
fin AS (SELECT acc FROM walk ORDER BY k DESC LIMIT 1)
SELECT u, v, witness, row_number() OVER (ORDER BY k) - 1 AS place FROM ranked WHERE k IN (SELECT unnest(acc) FROM fin)""")
def jv_commit_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = synth.suppliers_graph(spark, sf_dir)
    return commit.commit(g, cut(jv.candidates(g))).select("u", "v", "witness", "place")


def _bytes(x: str, width: int) -> str:
    """A number's little-endian bytes as a list."""
    return "[" + ", ".join(f"({x} >> {8 * i}) & 255" for i in range(width)) + "]"


def _fnv_sql(data: str, basis: int = fnv.BASIS) -> str:
    """Sixteen digits of the hash of a list of bytes."""
    return f"lower(lpad(to_hex(CAST(list_reduce([CAST({basis} AS UHUGEINT)] || list_transform({data}, lambda x: CAST(x AS UHUGEINT)), lambda h, b: (xor(h, b) * {fnv.PRIME}) % 18446744073709551616) AS UBIGINT)), 16, '0'))"


def _snapshot_sql(active: str) -> str:
    """Hash of the snapshot whose active edges the CTE ``active`` holds."""
    p = f"(SELECT list({_bytes('ix', 8)} || {_bytes('iy', 8)} ORDER BY id) FROM p)"
    e = f"(SELECT list({_bytes('CAST(e.u AS BIGINT)', 4)} || {_bytes('CAST(e.v AS BIGINT)', 4)} || {_bytes('e.w', 8)} || [CAST(x.edge_id IS NOT NULL AS BIGINT)] ORDER BY e.edge_id) FROM e LEFT JOIN {active} x ON x.edge_id = e.edge_id)"
    return f"(SELECT {_fnv_sql(f'{_bytes("(SELECT count(*) FROM p)", 4)} || [0, 1] || flatten({p}) || flatten({e})')})"


#: Rounds of quick elimination that SQL unrolls; the last ones commit nothing.
_ROUNDS = 5
_WALK = """ranked AS (SELECT c.*, row_number() OVER (ORDER BY u, v, witness, edge_id) AS k, a.degree AS du, b.degree AS dv FROM cand c JOIN deg a ON a.id = c.u JOIN deg b ON b.id = c.v),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS ends, CAST([] AS BIGINT[]) AS acc UNION ALL
  SELECT r.k, CASE WHEN r.du - len(list_filter(w.ends, lambda x: x = r.u)) > 2 AND r.dv - len(list_filter(w.ends, lambda x: x = r.v)) > 2 THEN w.ends || [r.u, r.v] ELSE w.ends END,
  CASE WHEN r.du - len(list_filter(w.ends, lambda x: x = r.u)) > 2 AND r.dv - len(list_filter(w.ends, lambda x: x = r.v)) > 2 THEN w.acc || [r.k] ELSE w.acc END FROM walk w JOIN ranked r ON r.k = w.k + 1),
took AS (SELECT edge_id, u, v, witness, row_number() OVER (ORDER BY k) - 1 AS place FROM ranked WHERE k IN (SELECT unnest(acc) FROM (SELECT acc FROM walk ORDER BY k DESC LIMIT 1)))"""


def _fixed_sql(base: str) -> str:
    """Rounds over the points p and edges e of ``base``: cand0, took0 (the committed), e1 (what is left), and so on."""
    whole = _jv_sql("supp")
    one = whole[whole.index("adj AS (") :] + ",\n" + _WALK
    out = [base, "e0_ AS (SELECT * FROM e)"]
    for r in range(_ROUNDS):
        names = "adj|deg|gate|c0|c1|top|bad|cand|ranked|walk|took"
        mine = re.sub(rf"\b({names})\b", rf"\g<1>{r}_", one)
        mine = re.sub(r"\be\b", f"e{r}_", mine)
        out += [mine, f"e{r + 1}_ AS (SELECT e{r}_.* FROM e{r}_ ANTI JOIN took{r}_ t ON t.edge_id = e{r}_.edge_id)"]
    return re.sub(r"(walk\d_) AS MATERIALIZED", r"\1 AS", _held_sql(",\n".join(out)))


def _base_sql(which: str) -> str:
    whole = _graph_sql(which)
    return whole[: whole.index(",\nadj AS (")].replace("e0 AS", "first_e AS").replace("FROM e0", "FROM first_e")


_FIXED = "WITH RECURSIVE " + _fixed_sql(_base_sql("supp"))
_RECORDS = " UNION ALL ".join(f"SELECT CAST({r} AS INTEGER) AS epoch, {_snapshot_sql(f'e{r}_')} AS snapshot_hash, edge_id, u, v, 'jv' AS method, witness, CAST(NULL AS BIGINT) AS certificate_index, place FROM took{r}_" for r in range(_ROUNDS))


@_query(f"{_FIXED} {_RECORDS}")
def jv_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of quick elimination to its fixed point."""
    return epochs.jv_fixed_point(synth.suppliers_graph(spark, sf_dir)).records.drop("g")


@_query(f"{_FIXED}, m AS ({' UNION ALL '.join(f'SELECT {r} AS epoch, (SELECT count(*) FROM e{r}_) AS edges_before, (SELECT count(*) FROM cand{r}_) AS proposed, (SELECT count(*) FROM took{r}_) AS committed' for r in range(_ROUNDS))}) SELECT CAST(epoch AS BIGINT) AS epoch, edges_before, proposed, proposed AS verified, committed FROM m WHERE epoch <= (SELECT min(epoch) FROM m WHERE committed = 0)")
def jv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each round saw, proposed, verified and committed."""
    r = epochs.jv_fixed_point(synth.suppliers_graph(spark, sf_dir))
    names = ("epoch", "edges_before", "proposed", "verified", "committed")
    return spark.createDataFrame([tuple(m[n] for n in names) for m in r.metrics], ", ".join(f"{n} bigint" for n in names))


@_query(f"WITH RECURSIVE {_held_sql(_graph_sql('emb'))} SELECT {_snapshot_sql('e')} AS hash")
def snapshot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epochs.snapshot_hashes(synth.embeddings_graph(spark, sf_dir)).select("hash")


# ---- targets, tours ----


@_query(f"WITH {_graph_sql('emb')} SELECT edge_id AS target, u, v, w AS weight, row_number() OVER (ORDER BY w DESC, u, v, edge_id) - 1 AS place FROM gate QUALIFY place >= 10 AND place < 60")
def ht_targets_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ht.select_targets(synth.embeddings_graph(spark, sf_dir), "weight", 10, 50).drop("g")


@_query(f"WITH {_graph_sql('emb')} SELECT edge_id AS target, u, v, w AS weight, row_number() OVER (ORDER BY u, v, edge_id) - 1 AS place FROM gate")
def ht_targets_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ht.select_targets(synth.embeddings_graph(spark, sf_dir)).drop("g")


@_query(f"""WITH {_graph_sql("emb")}, t AS (SELECT id, coalesce(lead(id) OVER (ORDER BY ix, iy, id), first_value(id) OVER (ORDER BY ix, iy, id)) AS nxt FROM p),
s AS (SELECT least(t.id, nxt) AS u, greatest(t.id, nxt) AS v, {_dist("a", "b")} AS d FROM t JOIN p a ON a.id = t.id JOIN p b ON b.id = nxt)
SELECT CAST(sum(d) AS BIGINT) AS cost, count(*) FILTER (WHERE e.u IS NULL) AS missing_edges FROM s LEFT JOIN e ON e.u = s.u AND e.v = s.v""")
def tour_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tour from left to right against the graph."""
    g = synth.embeddings_graph(spark, sf_dir)
    t = g.points.select("g", (F.row_number().over(Window.partitionBy("g").orderBy("ix", "iy", "id")) - 1).alias("pos"), F.col("id").alias("node"))
    return tour.check_tour(g, t).drop("g")


# ---- Hamilton-Tutte ----

_TARGETS = "t AS (SELECT edge_id AS target, u, v FROM gate)"


def _targets(g: Graph) -> DataFrame:
    return cut(ht.select_targets(g).select("g", "target", "u", "v"))


_HT_SQL = f"""{_graph_sql("emb")}, {_TARGETS},
tp AS (SELECT t.*, a.ix AS ux, a.iy AS uy, b.ix AS vx, b.iy AS vy FROM t JOIN p a ON a.id = t.u JOIN p b ON b.id = t.v),
near AS (SELECT target, p.id AS node, (2*p.ix-ux-vx)*(2*p.ix-ux-vx)+(2*p.iy-uy-vy)*(2*p.iy-uy-vy) AS score FROM tp, p WHERE p.id <> u AND p.id <> v),
rk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score, node) AS rank FROM near),
one AS (SELECT t.target, t.u, t.v, n.id AS center, m.id AS node, {_dist("a", "b")} AS t, adj.w AS o, {_dist("a", "n")} + {_dist("b", "n")} AS through FROM t JOIN p a ON a.id = t.u JOIN p b ON b.id = t.v JOIN rk ON rk.target = t.target AND rk.rank <= 25 JOIN p n ON n.id = rk.node JOIN adj ON adj.n = n.id JOIN p m ON m.id = adj.m
  WHERE {_dist("a", "m")} + {_dist("b", "n")} >= {_dist("a", "b")} + adj.w OR {_dist("a", "n")} + {_dist("b", "m")} >= {_dist("a", "b")} + adj.w),
rep AS (SELECT x.target, x.center, x.node AS first, y.node AS second, row_number() OVER (PARTITION BY x.target, x.center ORDER BY x.node, y.node) - 1 AS reply FROM one x JOIN one y ON x.target = y.target AND x.center = y.center AND x.node < y.node JOIN p f ON f.id = x.node JOIN p s ON s.id = y.node
  WHERE NOT (x.node = least(x.u, x.v) AND y.node = greatest(x.u, x.v)) AND x.t + x.o + y.o <= {_dist("f", "s")} + x.through),
cnt AS (SELECT target, center, count(*) AS n FROM rep GROUP BY target, center),
pr AS (SELECT x.target, least(x.node, y.node) AS c, greatest(x.node, y.node) AS d FROM rk x JOIN rk y ON x.target = y.target AND x.node < y.node WHERE x.rank <= 25 AND y.rank <= 25),
ps AS (SELECT pr.*, e.edge_id IS NOT NULL AS act, NOT ({_dist("a", "d")} + {_dist("b", "c")} >= {_dist("a", "b")} + {_dist("c", "d")} OR {_dist("a", "c")} + {_dist("b", "d")} >= {_dist("a", "b")} + {_dist("c", "d")}) AS inc FROM pr JOIN t ON t.target = pr.target JOIN p a ON a.id = t.u JOIN p b ON b.id = t.v JOIN p c ON c.id = pr.c JOIN p d ON d.id = pr.d LEFT JOIN e ON e.u = pr.c AND e.v = pr.d)"""


def _cd_sql(where: str) -> str:
    return f"""WITH {_HT_SQL} SELECT target, c, d, product, rank FROM (SELECT ps.target, c, d, coalesce(x.n, 0) * coalesce(y.n, 0) AS product, row_number() OVER (PARTITION BY ps.target ORDER BY coalesce(x.n, 0) * coalesce(y.n, 0), c, d) AS rank FROM ps LEFT JOIN cnt x ON x.target = ps.target AND x.center = ps.c LEFT JOIN cnt y ON y.target = ps.target AND y.center = ps.d WHERE {where}) WHERE rank <= 5"""


@_query(f"WITH {_HT_SQL} SELECT target, node, score, rank FROM rk WHERE rank <= 25")
def ht_midpoint_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = synth.embeddings_graph(spark, sf_dir)
    return ht.midpoint_rank(g, _targets(g), most=25).drop("g")


@_query(_cd_sql("act AND inc"))
def ht_cd_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = synth.embeddings_graph(spark, sf_dir)
    return ht.cd_candidates(g, _targets(g)).drop("g")


@_query(_cd_sql("NOT act OR inc"))
def ht_cd_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = synth.embeddings_graph(spark, sf_dir)
    return ht.cd_candidates(g, _targets(g), ht.RootOptions(mode=ht.MODES[1])).drop("g")


@_query(f"WITH {_HT_SQL} SELECT target, center, first, second, reply FROM rep")
def ht_hamilton_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = synth.embeddings_graph(spark, sf_dir)
    t = _targets(g)
    near = ht.midpoint_rank(g, t, most=25).select("g", "target", F.col("node").alias("center"))
    return ht.hamilton_replies(g, near, t).drop("g")


@_query(f"WITH {_HT_SQL} SELECT t.u AS endpoint, t.v AS internal, adj.m AS neighbor, row_number() OVER (PARTITION BY t.target ORDER BY adj.m) - 1 AS reply FROM t JOIN adj ON adj.n = t.u AND adj.m <> t.v")
def ht_end_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = synth.embeddings_graph(spark, sf_dir)
    return ht.end_replies(g, _targets(g).select("g", F.col("u").alias("endpoint"), F.col("v").alias("internal"))).drop("g")


_CD = _cd_sql("act AND inc").replace("WITH " + _HT_SQL, "")


@_query(f"""WITH {_held_sql(_HT_SQL)}, cd AS MATERIALIZED ({_CD}),
r AS MATERIALIZED (SELECT CAST(target AS BIGINT) * 1000000 + center AS k, first, second, reply FROM rep),
half AS MATERIALIZED (SELECT cd.*, r.first AS c_first, r.second AS c_second, r.reply AS c_reply, CAST(cd.target AS BIGINT) * 1000000 + cd.d AS dk FROM cd JOIN r ON r.k = CAST(cd.target AS BIGINT) * 1000000 + cd.c WHERE cd.product <= 1000000)
SELECT target, rank, row_number() OVER (PARTITION BY target, rank ORDER BY c_reply, r.reply) - 1 AS reply, c, c_first, c_second, d, r.first AS d_first, r.second AS d_second FROM half JOIN r ON r.k = half.dk""")
def ht_root_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint replies of all root candidates within the default limit of combinations."""
    return _root_replies(synth.embeddings_graph(spark, sf_dir))


def _root_replies(g: Graph, o: ht.RootOptions = ht.RootOptions()) -> DataFrame:
    t = _targets(g)
    cds = cut(ht.cd_candidates(g, t, o))
    return ht.root_replies(g, cds.where(F.col("product") <= o.reply_combinations) if o.reply_combinations else cds, t).drop("g")


#: Targets of the scan, the longest first, and its options: those of a command without flags, but for moves below the root.
SCAN_TARGETS, SCAN = 50, wavefront.Options(leaf=kopt.Options(5, 100_000), depth=0)


@_query()
def ht_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the search over the longest targets of the derived graph, and whether the verifier, which is written apart, accepts each proof (null without one)."""
    g = synth.embeddings_graph(spark, sf_dir)
    t = cut(ht.select_targets(g, "weight", 0, SCAN_TARGETS).select("g", "target", "u", "v"))
    result, proof = lazy.prove(g, t, SCAN)
    own = t.join(proof.nodes.where("node = 0").select("g", "target"), ["g", "target"], "left_semi")
    verdict = ht_verify.verify(g, own, proof, SCAN.root.mode).select("g", "target", (F.size("faults") == 0).alias("verified"))
    return result.join(verdict, ["g", "target"], "left").select("target", "status", "exhausted", "candidate", "candidates", "states", "replies", "verified")


@_query("""WITH t AS (SELECT c_custkey AS k, unnest(range(c_custkey % 3 + 1)) AS m FROM customer),
r AS (SELECT k, m, unnest(range((k + m) % 4)) AS r FROM t),
bad AS (SELECT DISTINCT k, m FROM r WHERE (k + m + r) % 5 <> 0 AND (k * 7 + m * 3 + r) % 3 = 0),
win AS (SELECT k, min(m) AS ord FROM t ANTI JOIN bad ON bad.k = t.k AND bad.m = t.m GROUP BY k)
SELECT c_custkey AS k, win.ord IS NOT NULL AS proven, CAST(win.ord AS INTEGER) AS ord FROM customer LEFT JOIN win ON win.k = c_custkey""")
def andor_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of two levels from each customer's key: truth of its root by AND over replies and OR over moves, and the first move that succeeds."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("tree").alias("g"), F.col("c_custkey").cast("int").alias("target"))
    leaf = lambda v: F.struct(v.alias("proven")).alias("leaf")
    root = c.select("g", "target", F.array(F.lit(1)).alias("sid"))
    moves = root.select("g", "target", "sid", F.explode(F.sequence(F.lit(0), F.col("target") % 3)).alias("ord"))
    n = (F.col("target") + F.col("ord")) % 4
    rows = moves.where(n > 0).withColumn("reply", F.explode(F.sequence(F.lit(0), n - 1)))
    child = F.when((F.col("target") + F.col("ord") + F.col("reply")) % 5 != 0, F.concat("sid", F.array("ord", "reply")))
    rows = rows.withColumn("child", child)
    below = rows.where("child is not null").select("g", "target", F.col("child").alias("sid"), leaf((F.col("target").cast("bigint") * 7 + F.col("ord") * 3 + F.col("reply")) % 3 != 0))
    wave = wavefront.Wave(None, c, wavefront.Options(), [root.withColumn("leaf", F.struct(F.lit(False).alias("proven"))), below], [moves], [rows])
    got = wavefront.propagate(wave).where(F.size("sid") == 1)
    return got.select(F.col("target").cast("bigint").alias("k"), "proven", "ord")


#: Options of the fixture's golden proofs.
GOLDEN = wavefront.Options(ht.RootOptions(0, 8, 0, 1000), kopt.Options(3, 1, 0), 1, 20000, 200000, 1000, 5, 5)


_FIX = f"p AS (SELECT CAST(id AS INTEGER) AS id, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy FROM (VALUES {', '.join(str((i, *xy)) for i, xy in enumerate(synth.FIXTURE))}) t(id, ix, iy)), e AS (SELECT CAST(row_number() OVER (ORDER BY a.id, b.id) - 1 AS INTEGER) AS edge_id, a.id AS u, b.id AS v, {_dist('a', 'b')} AS w FROM p a JOIN p b ON a.id < b.id)"


@_query(f"WITH RECURSIVE {_fixed_sql(_FIX)}, jv AS ({_RECORDS}) SELECT epoch, u, v, method, witness, certificate_index FROM jv UNION ALL SELECT max(epoch) + 1, 2, 4, 'hamilton-tutte', -1, CAST(0 AS BIGINT) FROM jv")
def local_eliminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one round of quick elimination and search over the fixture."""
    got = epochs.local_elimination(synth.fixture(spark), epochs.ScanOptions(GOLDEN, "weight", 1), 100, 1)
    return got.result.records.select("epoch", "u", "v", "method", "witness", "certificate_index")


@_query(f"{_FIXED} SELECT {_snapshot_sql(f'e{_ROUNDS}_')} AS hash")
def proof_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of the snapshot after quick elimination over the suppliers, from a checked replay of its records."""
    g = synth.suppliers_graph(spark, sf_dir)
    r = epochs.jv_fixed_point(g)
    return epochs.snapshot_hashes(epochs.replay(g, r.records, r.initial_hash, r.final_hash)).select("hash")


# ---- catalogs, leaves ----

def _upto(sql: str, most: int) -> str:
    return sql.replace("MOST", str(most + 1))


_INSIDE_SQL = """ins AS (SELECT m, list_transform(range(2 * m), lambda x: -1) AS mates FROM range(1, MOST) r(m) UNION ALL
  SELECT m, list_transform(range(2 * m), lambda x: CASE WHEN x = a THEN b WHEN x = b THEN a ELSE mates[x + 1] END) FROM (SELECT m, mates, list_position(mates, -1) - 1 AS a, unnest(range(2 * m)) AS b FROM ins WHERE list_contains(mates, -1)) WHERE b > a AND mates[b + 1] = -1),
inside AS (SELECT m, mates, row_number() OVER (PARTITION BY m ORDER BY mates) - 1 AS id FROM ins WHERE NOT list_contains(mates, -1))"""


@_query(f"WITH RECURSIVE {_upto(_INSIDE_SQL, 7)} SELECT CAST(m AS INTEGER) AS m, id AS matching_id, array_to_string(mates, ',') AS mates FROM inside")
def inside_matchings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.matchings(spark, "inside", 7).select("m", "matching_id", F.concat_ws(",", F.col("mates").cast("array<string>")).alias("mates"))


_OUTSIDE_SQL = """step AS (SELECT m, [0] AS ord, 0 AS bits, 1 AS n FROM range(1, MOST) r(m) UNION ALL SELECT m, ord || [x], bits + CAST(f * (1 << (n - 1)) AS INTEGER), n + 1 FROM (SELECT *, unnest(range(1, m)) AS x FROM step WHERE n < m) s, range(2) t(f) WHERE NOT list_contains(ord, x)),
outs AS (SELECT m, row_number() OVER (PARTITION BY m ORDER BY ord, bits) - 1 AS id, list_transform(range(m), lambda i: 2 * ord[i + 1] + CASE WHEN i > 0 THEN (bits >> (i - 1)) & 1 ELSE 0 END) AS enter FROM step WHERE n = m),
outside AS (SELECT m, id, list_transform(range(2 * m), lambda e: CASE WHEN list_contains(enter, e) THEN xor(enter[(list_position(enter, e) + m - 2) % m + 1], 1) ELSE enter[list_position(enter, xor(e, 1)) % m + 1] END) AS mates FROM outs)"""


@_query(f"WITH RECURSIVE {_upto(_OUTSIDE_SQL, 7)} SELECT CAST(m AS INTEGER) AS m, id AS matching_id, array_to_string(mates, ',') AS mates FROM outside")
def outside_matchings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.matchings(spark, "outside", 7).select("m", "matching_id", F.concat_ws(",", F.col("mates").cast("array<string>")).alias("mates"))


_COMPAT = """way AS (SELECT o.m, o.id AS outside_id, i.id AS inside_id, o.mates AS x, i.mates AS y, i.mates[o.mates[1] + 1] AS pos, 1 AS n FROM outside o JOIN inside i ON i.m = o.m
  UNION ALL SELECT m, outside_id, inside_id, x, y, y[x[pos + 1] + 1], n + 1 FROM way WHERE pos <> 0 AND n <= m),
compat AS MATERIALIZED (SELECT CAST(m AS INTEGER) AS m, outside_id, inside_id, n = m AS compatible FROM way WHERE pos = 0)"""
_FORMS = """way3 AS (SELECT m, id, mates, mates[2 * m] AS pos, 1 AS n FROM inside WHERE m >= 3 AND NOT list_contains(list_transform(range(m), lambda i: mates[2 * i + 1] = 2 * i + 1), true)
  UNION ALL SELECT m, id, mates, mates[CASE WHEN pos % 2 = 1 THEN (pos + 1) % (2 * m) ELSE (pos + 2 * m - 1) % (2 * m) END + 1], n + 1 FROM way3 WHERE pos <> 0 AND n <= m),
forms AS MATERIALIZED (SELECT CAST(m AS INTEGER) AS k, row_number() OVER (PARTITION BY m ORDER BY id) - 1 AS template_id, mates FROM way3 WHERE pos = 0 AND n = m)"""


@_query(f"WITH RECURSIVE {_upto(_OUTSIDE_SQL, 5)}, {_upto(_INSIDE_SQL, 5)}, {_COMPAT} SELECT * FROM compat")
def path_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.compatibility(spark, 5)


@_query(f"WITH RECURSIVE {_upto(_INSIDE_SQL, 5)}, {_FORMS} SELECT k, template_id, array_to_string(mates, ',') AS mates FROM forms")
def reconnect_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.templates_table(spark).select("k", "template_id", F.concat_ws(",", F.col("mates").cast("array<string>")).alias("mates"))


_HASHED = f"""cover AS MATERIALIZED (SELECT m, inside_id, outside_id // 8 AS j, sum(CAST(compatible AS INTEGER) << (outside_id % 8)) AS v FROM compat GROUP BY ALL),
place AS (SELECT m, inside_id, unnest(range((max(outside_id) + 64) // 64 * 8)) AS j FROM compat GROUP BY m, inside_id),
filled AS (SELECT m, list(CAST(coalesce(v, 0) AS BIGINT) ORDER BY inside_id, j) AS b FROM place LEFT JOIN cover USING (m, inside_id, j) GROUP BY m),
sized AS (SELECT CAST(m AS BIGINT) AS m, max(outside_id) + 1 AS o, max(inside_id) + 1 AS i, (max(outside_id) + 64) // 64 AS w FROM compat GROUP BY m)
SELECT 'table' AS what, CAST(m AS INTEGER) AS size, {_fnv_sql(f"{list(fnv.COMPATIBILITY_NAME)} || {_bytes('m', 4)} || {_bytes('o', 4)} || {_bytes('i', 4)} || {_bytes('w', 4)} || b")} AS hash FROM filled JOIN sized USING (m)
UNION ALL SELECT 'templates', k, {_fnv_sql(f"{list(fnv.TEMPLATES_NAME)} || {_bytes('CAST(k AS BIGINT)', 4)} || {_bytes('n', 4)} || b")} FROM (SELECT k, count(*) AS n, flatten(list(mates ORDER BY template_id)) AS b FROM forms GROUP BY k)"""


@_query(f"WITH RECURSIVE {_upto(_OUTSIDE_SQL, 5)}, {_upto(_INSIDE_SQL, 5)}, {_COMPAT}, {_FORMS}, {_HASHED}")
def catalog_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the compatibility tables and the reconnection templates."""
    rows = [("table", m, catalogs.table_hash(m)) for m in range(1, 6)] + [("templates", k, catalogs.templates_hash(k)) for k in (3, 4, 5)]
    return spark.createDataFrame(rows, "what string, size int, hash string")


def _tasks(points: DataFrame) -> DataFrame:
    """From each window of ten points in id order a task of three, four and five deleted edges: steps from one point to the next."""
    p = points.where("id % 10 = 0").select("g", "id", F.explode(F.array(F.lit(3), F.lit(4), F.lit(5))).alias("k"))
    last = points.groupBy("g").agg(F.max("id").alias("last"))
    p = p.join(F.broadcast(last), "g").where("id + 9 <= last")
    return p.select("g", (F.col("id").cast("bigint") * 10 + F.col("k")).alias("task_id"), "k", F.expr("sequence(id, id + 2 * k - 1)").alias("ports"))


_COSTS = f"""{_upto(_INSIDE_SQL, 5)}, {_FORMS}, p AS ({_POINTS["emb"]}), f AS (SELECT k, template_id, a, mates[a + 1] AS b FROM (SELECT *, unnest(range(2 * k)) AS a FROM forms) WHERE a < mates[a + 1]),
t AS (SELECT id, CAST(id AS BIGINT) * 10 + k AS task_id, k FROM p, (VALUES (3), (4), (5)) v(k) WHERE id % 10 = 0 AND id + 9 <= (SELECT max(id) FROM p)),
cost AS (SELECT task_id, t.k, template_id, CAST(sum({_dist("x", "y")}) AS BIGINT) AS added_cost FROM t JOIN f ON f.k = t.k JOIN p x ON x.id = t.id + f.a JOIN p y ON y.id = t.id + f.b GROUP BY ALL)"""


@_query(f"WITH RECURSIVE {_COSTS} SELECT * FROM cost")
def kopt_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = synth.points_of_embeddings(spark, sf_dir)
    return kopt.template_costs(_tasks(pts), pts, catalogs.templates_table(spark)).drop("g")


@_query(f"""WITH RECURSIVE {_COSTS}, paid AS (SELECT task_id, CAST(sum({_dist("x", "y")}) AS BIGINT) AS deleted_cost FROM (SELECT *, unnest(range(k)) AS i FROM t) t JOIN p x ON x.id = t.id + 2 * i JOIN p y ON y.id = t.id + 2 * i + 1 GROUP BY task_id)
SELECT task_id, min(template_id) FILTER (WHERE added_cost < deleted_cost) AS template_id FROM paid JOIN cost USING (task_id) GROUP BY task_id""")
def kopt_first_improving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each task the first template that costs less than the edges it deletes."""
    pts = synth.points_of_embeddings(spark, sf_dir)
    t = _tasks(pts)
    gone = t.select("g", "task_id", F.explode(F.expr("transform(sequence(0, k - 1), i -> struct(ports[2 * i] as a, ports[2 * i + 1] as b))")).alias("e")).select("g", "task_id", "e.a", "e.b")
    at = lambda n: pts.select("g", F.col("id").alias(n), F.col("ix").alias(f"{n}x"), F.col("iy").alias(f"{n}y"))
    paid = gone.join(at("a"), ["g", "a"]).join(at("b"), ["g", "b"]).groupBy("g", "task_id").agg(F.sum(D.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).alias("deleted_cost"))
    return kopt.first_improving(kopt.template_costs(t, pts, catalogs.templates_table(spark)), paid).drop("g")


#: Three paths from a key: nodes modulo 12, so that they meet, close and cross; some keys lose all but one node of a path, or have a node that is none.
_SYSTEMS = """s AS (SELECT CAST(c_custkey AS INTEGER) AS k, CAST(c_custkey AS BIGINT) AS c FROM customer),
p AS (SELECT k, 0 AS i, [c % 12, (c // 12) % 12, (5 * c + 1) % 12] AS p FROM s UNION ALL
  SELECT k, 1, CASE WHEN c % 23 = 0 THEN [c % 12] ELSE [(7 * c + 3) % 12, CASE WHEN c % 29 = 0 THEN 12 ELSE (c // 5) % 12 END] END FROM s UNION ALL SELECT k, 2, [(c // 7) % 12, (11 * c + 5) % 12] FROM s)"""


@_query(f"""WITH RECURSIVE {_SYSTEMS},
e AS (SELECT k, i, j, p[j] AS a, p[j + 1] AS b FROM (SELECT *, unnest(range(1, len(p))) AS j FROM p)),
arc AS (SELECT k, i, j, a, b FROM e UNION ALL SELECT k, i, j, b, a FROM e),
f AS (SELECT k, [i, 0, 0, 0] AS place, 'short path' AS reason FROM p WHERE len(p) < 2 UNION ALL SELECT k, [i, 1, 0, 0], 'node out of range' FROM p WHERE list_max(p) > 11
  UNION ALL SELECT k, [i, 2, 0, 0], 'repeated node' FROM p WHERE len(list_distinct(p)) < len(p)
  UNION ALL SELECT k, [i, 3, j, 0], 'repeated edge' FROM (SELECT *, row_number() OVER (PARTITION BY k, least(a, b), greatest(a, b) ORDER BY i, j) AS n FROM e) WHERE n > 1
  UNION ALL SELECT k, [i, 3, j, 1], 'degree above two' FROM (SELECT *, count(*) OVER (PARTITION BY k, a ORDER BY i, j ROWS UNBOUNDED PRECEDING) AS n FROM arc) WHERE n > 2),
bad AS (SELECT k, arg_min(reason, place) AS reason FROM f GROUP BY k),
good AS MATERIALIZED (SELECT arc.* FROM arc ANTI JOIN bad ON bad.k = arc.k),
deg AS (SELECT k, a AS n, count(*) AS d FROM good GROUP BY ALL),
walk AS (SELECT k, n AS before, n AS now, [n] AS chain FROM deg WHERE d = 1 UNION ALL SELECT w.k, w.now, g.b, list_append(w.chain, g.b) FROM walk w JOIN good g ON g.k = w.k AND g.a = w.now AND g.b <> w.before),
ended AS (SELECT w.k, w.chain FROM walk w JOIN deg ON deg.k = w.k AND deg.n = w.now AND deg.d = 1 WHERE len(w.chain) > 1 AND w.chain[1] < w.now),
whole AS (SELECT k, list(chain ORDER BY chain) AS chains, sum(len(chain)) AS held FROM ended GROUP BY k),
size AS (SELECT k, count(*) AS n, CAST(sum(d) // 2 AS BIGINT) AS edges FROM deg GROUP BY k),
r AS (SELECT s.k, coalesce(bad.reason, CASE WHEN coalesce(held, 0) < n THEN 'cycle' ELSE '' END) AS reason, chains, edges FROM s LEFT JOIN bad USING (k) LEFT JOIN whole USING (k) LEFT JOIN size USING (k))
SELECT k, reason = '' AS valid, reason, CASE WHEN reason = '' THEN edges ELSE 0 END AS edge_count, CASE WHEN reason = '' THEN replace(CAST(chains AS VARCHAR), ' ', '') ELSE '[]' END AS paths FROM r""")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form of three short paths from each customer's key, or the first fault."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("int").alias("key"), F.col("c_custkey").cast("bigint").alias("c"))
    node = lambda text: F.expr(f"cast(({text}) % 12 as int)")
    one = F.array(node("c"), node("c div 12"), node("5 * c + 1"))
    two = F.when(F.expr("c % 23 = 0"), F.array(node("c"))).otherwise(F.array(node("7 * c + 3"), F.when(F.expr("c % 29 = 0"), F.lit(12)).otherwise(node("c div 5"))))
    systems = c.select("key", F.lit(12).alias("nodes"), F.array(one, two, F.array(node("c div 7"), node("11 * c + 5"))).alias("paths"))
    return paths.normal_forms(systems).select(F.col("key").alias("k"), "valid", "reason", "edge_count", F.to_json("paths").alias("paths"))


@_query("SELECT CAST(c_custkey AS INTEGER) AS key, c_custkey % 5 NOT IN (1) AND c_custkey % 5 NOT IN (2) AND NOT (c_custkey % 5 = 0 AND (c_custkey + 2) % 5 = 2) AS feasible FROM customer")
def path_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an end move from the first node of 0 - 1 - 2 to node k mod 5 and back is sound, one task a customer."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("int").alias("key"))
    parents = c.select("key", F.array(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("paths"))
    tasks = c.select("key", F.col("key").alias("task_id"), F.lit("end").alias("kind"), F.lit(0).alias("first"), F.lit(-1).alias("center"), (F.col("key") % 5).alias("second"))
    return paths.feasible_appends(parents, tasks).select("key", "feasible")


def _six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two paths of three points each from every window of six."""
    p = synth.points_of_embeddings(spark, sf_dir)
    w = p.select(F.expr("id div 6").alias("k"), (F.col("id") % 6).alias("id"), F.col("ix").alias("x"), F.col("iy").alias("y"))
    return w.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("id", "x", "y"))).alias("places")).where("size(places) = 6").withColumn("paths", F.expr("array(array(0, 1, 2), array(3, 4, 5))"))


@_query()
def leaf_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _six(spark, sf_dir).withColumn("leaf", kopt.leaves(F.col("paths"), F.col("places"), F.lit(0), F.lit(1), kopt.Options(3, 0, 10)))
    return got.select("k", "leaf.proven", "leaf.deletion_sets", "leaf.matchings", F.size("leaf.records").alias("records"))


# ---- scalars, LP ----


@_query("SELECT c_custkey AS k, lower(hex(CAST(c_name AS BLOB))) AS name_hex, c_name AS name_back, CAST(CASE WHEN c_custkey <= 1 THEN 0 ELSE floor(log2(c_custkey)) END AS INTEGER) AS bucket FROM customer")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("k"), S.hex_encode(F.col("c_name")).alias("name_hex"), S.hex_decode(S.hex_encode(F.col("c_name"))).alias("name_back"), S.log2_bucket(F.col("c_custkey")).alias("bucket"))


def _model(spark: SparkSession, sf_dir: str) -> tuple[lp.Model, DataFrame, DataFrame]:
    """A transport of each nation's customers: row = nation, column = customer, and a dual and a primal by rule."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    coef = c.select(F.col("c_nationkey").alias("row"), F.col("c_custkey").alias("col"), (F.col("c_custkey") % 3 + 1).cast("double").alias("val"))
    row = c.select(F.col("c_nationkey").alias("row")).distinct().select("row", F.lit("G").alias("sense"), (F.col("row") % 4 + 1).cast("double").alias("rhs"))
    col = c.select(F.col("c_custkey").alias("col"), (F.col("c_custkey") % 11 + 1).cast("double").alias("obj"), F.lit(0.0).alias("lb"), F.lit(1.0).alias("ub"))
    dual = row.select("row", ((F.col("row") % 5 - 1) * 0.375).alias("y"))
    primal = col.select("col", (F.col("col") % 2).cast("double").alias("x"))
    return lp.Model(coef, row, col), dual, primal


_LP = "q AS (SELECT DISTINCT c_nationkey AS r, greatest((c_nationkey % 5 - 1) * 0.375, 0) * 16777216 AS q, c_nationkey % 4 + 1 AS rhs FROM customer), red AS (SELECT c_custkey, CAST((c_custkey % 11 + 1) * 16777216 - (c_custkey % 3 + 1) * q.q AS HUGEINT) AS n FROM customer JOIN q ON q.r = c_nationkey)"


@_query(f"WITH {_LP} SELECT true AS certified, CAST(CAST((SELECT sum(rhs * q) FROM q) + (SELECT sum(least(n, 0)) FROM red) AS HUGEINT) AS VARCHAR) AS numerator, CAST(16777216 AS BIGINT) AS denominator")
def lp_exact_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, dual, _ = _model(spark, sf_dir)
    return lp.exact_bound(m, dual)


@_query("""WITH a AS (SELECT c_nationkey AS row, sum((c_custkey % 3 + 1) * (c_custkey % 2)) AS act FROM customer GROUP BY ALL)
SELECT CAST(max(greatest(row % 4 + 1 - act, 0)) AS DOUBLE) AS max_primal_violation, (SELECT max(abs((c_custkey % 11 + 1) - (c_custkey % 3 + 1) * ((c_nationkey % 5 - 1) * 0.375) - (c_custkey % 11 + 1)))::DOUBLE FROM customer) AS max_reduced_cost_residual FROM a""")
def lp_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, dual, primal = _model(spark, sf_dir)
    return lp.residuals(m, primal, dual, m.col.select("col", F.col("obj").alias("rc")))
