"""Strict text formats as DataFrames: point and tour files, edge lists, instance tables; plain or gzip, by extension.

Readers take any path that Spark reads, one file a graph. They number lines across the byte ranges that tasks read, so a header keeps its
meaning however the file is split.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeproof.functions.distance import KINDS, is_integer
from edgeproof.operators.graph import Graph
from edgeproof.plans.cut import cut
from edgeproof.plans.order import numbered

#: Most bytes of a tour file.
TOUR_BYTES = 64 << 20


class FormatError(ValueError):
    """A file that is not what it should be."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a text file: trimmed, empty ones left out, numbered from 0 with them; a .gz file is unpacked by its name.

    A plain file is read in as many tasks as it has byte ranges (spark.sql.files.maxPartitionBytes); lines are numbered within their range, and
    the counts of the ranges before, one row a range, are added. Files of a folder follow each other by name. Rows are cut first, so ranges do
    not move between counting and numbering. A gzip file cannot be split and is one task.
    """
    where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    held = cut(spark.read.text(path).select(*where, F.monotonically_increasing_id().alias("row"), F.trim(F.translate("value", "\t", " ")).alias("line")))
    ranges = held.groupBy("file", "start").agg(F.min("row").alias("first"), F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("file", "start", (before - F.col("first")).alias("shift"))
    return held.where("line <> ''").join(ranges, ["file", "start"]).select((F.col("row") + F.col("shift")).alias("n"), "line")


def _must(ok: bool, what: str) -> None:
    if not ok:
        raise FormatError(what)


def _header(rows: DataFrame, section: str) -> tuple[dict[str, str], int]:
    """The KEY : value lines before a section line, and that line's number."""
    at = rows.where(F.col("line") == section).agg(F.min("n").alias("n"), F.count("*").alias("k")).first()
    _must(at["k"] == 1, f"{section} must stand once")
    head = rows.where(F.col("n") < at["n"]).orderBy("n").collect()
    out: dict[str, str] = {}
    for r in head:
        key, colon, value = r["line"].partition(":")
        _must(bool(colon), f"no header line: {r['line'][:60]}")
        _must(key.strip() not in out, f"{key.strip()} stands twice")
        out[key.strip()] = value.strip()
    return out, at["n"]


def read_points(spark: SparkSession, path: str, g: str) -> tuple[DataFrame, str, int]:
    """points, distance kind and dimension of a point file: ids 1..n, each once, made 0..n-1; coordinates that are integers are held as such."""
    rows = lines(spark, path)
    head, start = _header(rows, "NODE_COORD_SECTION")
    kind = head.get("EDGE_WEIGHT_TYPE", "")
    _must(kind in KINDS, f"EDGE_WEIGHT_TYPE must be one of {KINDS}")
    _must(bool(re.fullmatch("[0-9]+", head.get("DIMENSION", ""))), "DIMENSION")
    n = int(head["DIMENSION"])
    end = rows.where((F.col("line") == "EOF") & (F.col("n") > start)).agg(F.min("n")).first()[0]
    body = rows.where(F.col("n") > start) if end is None else rows.where((F.col("n") > start) & (F.col("n") < end))
    part = body.select(F.split("line", " +").alias("f"))
    number = "^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?$"
    good = (F.size("f") == 3) & F.col("f")[0].rlike("^[0-9]{1,9}$") & F.col("f")[1].rlike(number) & F.col("f")[2].rlike(number)
    told = part.agg(F.count("*").alias("n"), F.sum((~good).cast("int")).alias("bad"), F.count_distinct(F.col("f")[0]).alias("ids"), F.min(F.when(good, F.col("f")[0].cast("int"))).alias("low"), F.max(F.when(good, F.col("f")[0].cast("int"))).alias("high")).first()
    _must(told["n"] == n and not told["bad"] and told["ids"] == n and (n == 0 or (told["low"], told["high"]) == (1, n)), "points must be 1 to DIMENSION, each once, with two numbers")
    # the plan may cast before it leaves out header lines, and all lines are judged above
    x, y = F.col("f")[1].try_cast("double"), F.col("f")[2].try_cast("double")
    p = part.select(F.lit(g).alias("g"), (F.col("f")[0].try_cast("int") - 1).alias("id"), x.alias("x"), y.alias("y"))
    whole = lambda c: F.when(is_integer(F.col(c)), F.col(c).cast("bigint")).alias(f"i{c}")
    return p.select("g", "id", "x", "y", whole("x"), whole("y")), kind, n


def read_edges(spark: SparkSession, path: str, g: str, dimension: int) -> DataFrame:
    """edges of an edge list: a line "n m", then m lines "u v weight" of 0-based ids; canonical ends, edge_id by (u, v)."""
    from edgeproof.operators.graph import number_edges

    rows = lines(spark, path)
    first = rows.orderBy("n").first()
    _must(first is not None and bool(re.fullmatch("[0-9]+ +[0-9]+", first["line"])), "the first line must be n m")
    n, m = map(int, first["line"].split())
    _must(n == dimension, "dimension")
    part = rows.where(F.col("n") > first["n"]).select("line", F.split("line", " +").alias("f"))
    good = F.col("line").rlike("^[0-9]{1,9} +[0-9]{1,9} +[0-9]{1,18}$")
    e = part.where(good).select(F.col("f")[0].try_cast("int").alias("a"), F.col("f")[1].try_cast("int").alias("b"), F.col("f")[2].try_cast("bigint").alias("weight"))
    e = e.select(F.lit(g).alias("g"), F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "weight")
    told = e.agg(F.count("*").alias("n"), F.count_distinct("u", "v").alias("k"), F.max("v").alias("high"), F.sum((F.col("u") == F.col("v")).cast("int")).alias("loops")).first()
    _must(told["n"] == m == part.count(), "edge lines must be as many as declared, each of three numbers")
    _must(told["k"] == m and not told["loops"] and (m == 0 or told["high"] < n), "edges must be unique, no loops, of known ends")
    return number_edges(e)


def read_graph(spark: SparkSession, points: str, edges: str, g: str = "graph") -> Graph:
    """A graph of two files; every stored weight must be the distance."""
    from edgeproof.operators.graph import violations

    p, kind, n = read_points(spark, points, g)
    box = p.agg(F.max("ix") - F.min("ix"), F.max("iy") - F.min("iy")).first()
    fast = all(v is not None and v * v < (1 << 47) for v in box)
    out = Graph(p, read_edges(spark, edges, g, n), kind, fast)
    bad = violations(out).first()
    _must(bad is None, f"{bad['what']} of {bad['n']} rows" if bad else "")
    return out


def read_tour(spark: SparkSession, path: str, g: str, dimension: int) -> DataFrame:
    """(g, pos, node) of a tour file: a permutation of 1..n ended by -1, made 0-based."""
    size = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    _must(size is not None and size <= TOUR_BYTES, "tour file too large")
    rows = lines(spark, path)
    head, start = _header(rows, "TOUR_SECTION")
    _must("DIMENSION" not in head or head["DIMENSION"] == str(dimension), "DIMENSION")
    token = numbered(rows.where(F.col("n") > start).select(F.lit(g).alias("g"), "n", F.posexplode(F.split("line", " +")).alias("k", "t")), ["n", "k"], "pos")
    told = token.agg(F.min(F.when(F.col("t") == "-1", F.col("pos"))).alias("end"), F.count("*").alias("n"), F.max_by("t", "pos").alias("last")).first()
    _must(told["end"] is not None, "the tour must end with -1")
    _must(told["n"] == told["end"] + 1 or (told["n"] == told["end"] + 2 and told["last"] == "EOF"), "text after the tour")
    body = token.where(F.col("pos") < told["end"]).select("g", F.col("pos").cast("int").alias("pos"), F.when(F.col("t").rlike("^[0-9]{1,9}$"), F.col("t")).cast("int").alias("node"))
    got = body.agg(F.count("*").alias("n"), F.count_distinct("node").alias("ids"), F.min("node").alias("low"), F.max("node").alias("high")).first()
    _must(got["n"] == got["ids"] == dimension and (dimension == 0 or (got["low"], got["high"]) == (1, dimension)), "the tour must be a permutation")
    return body.withColumn("node", F.col("node") - 1)


def _one_file(head: list[str], body: DataFrame, tail: list[str], path: str, codec: str | None = None) -> None:
    """Header lines, the rows (at, value) in order and last lines as one text file (of a folder)."""
    spark = body.sparkSession
    ends = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(2, i, x) for i, x in enumerate(tail)], "part int, at bigint, value string")
    rows = ends.unionByName(body.select(F.lit(1).alias("part"), F.col("at").cast("bigint").alias("at"), "value"))
    writer = rows.coalesce(1).sortWithinPartitions("part", "at").select("value").write.mode("errorifexists")
    (writer.option("compression", codec) if codec else writer).text(path)


def write_points(points: DataFrame, kind: str, path: str, codec: str | None = None) -> None:
    """One graph's points as a point file: ids from 1, integers as such."""
    number = lambda c: F.coalesce(F.col(f"i{c}").cast("string"), F.col(c).cast("string"))
    body = points.select(F.col("id").alias("at"), F.concat_ws(" ", F.col("id") + 1, number("x"), number("y")).alias("value"))
    _one_file([f"DIMENSION : {points.count()}", f"EDGE_WEIGHT_TYPE : {kind}", "NODE_COORD_SECTION"], body, ["EOF"], path, codec)


def write_tour(tour: DataFrame, path: str) -> None:
    """One graph's tour (pos, node) as a tour file."""
    body = tour.select(F.col("pos").alias("at"), (F.col("node") + 1).cast("string").alias("value"))
    _one_file(["TYPE : TOUR", f"DIMENSION : {tour.count()}", "TOUR_SECTION"], body, ["-1", "EOF"], path)


def write_active_edges(graph: Graph, path: str) -> None:
    """The active edges of one graph as an edge list in (u, v) order, in one text file (of a folder), by Spark's writer."""
    n, e = graph.points.count(), graph.active()
    spark = e.sparkSession
    head = spark.createDataFrame([(-1, -1, f"{n} {e.count()}")], "u int, v int, value string")
    body = e.select("u", "v", F.concat_ws(" ", "u", "v", "weight").alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("u", "v").select("value").write.mode("errorifexists").text(path)


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """The instance table: (instance, tsp, edges, optimum), tab-separated; a first field of # starts a comment."""
    return spark.read.csv(path, sep="\t", comment="#", mode="FAILFAST", schema="instance string, tsp string, edges string, optimum bigint")


def read_tour_sources(spark: SparkSession, path: str) -> DataFrame:
    """The tour table: (instance, url, sha256, file)."""
    return spark.read.csv(path, sep="\t", comment="#", mode="FAILFAST", schema="instance string, url string, sha256 string, file string")


def read_pinned(spark: SparkSession, path: str) -> DataFrame:
    """(fields) of the record lines of a pinned hash list."""
    return lines(spark, path).where("line like 'record %'").select(F.split("line", " +").alias("fields"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
