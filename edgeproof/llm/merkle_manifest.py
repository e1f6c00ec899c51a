"""Merkle dataset manifest: higher-order SQL blocks.

A row's leaf is the hash of its fields. Leaves of a group lie in order in arrays of fixed size, and one expression (sequence, transform,
slice, aggregate) collapses all levels of such a block; the roots of blocks are the leaves of the next round, until each group has one
root, and the groups' roots are the leaves of one more tree. Proofs go down again: a block gives each of its leaves the siblings of its
own levels in front of those of the block's root. A row's place comes from one sort by range, counts a part and their running sums, so
a group may be any share of the table. Texts are hashed where they lie; only digests move. No Python runs on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._arrow import written

#: Children of a node, and levels that a block collapses.
FANOUT, LEVELS = 16, 2
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """`-` for a null, else the bytes of the value's text, `:` and the text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return sha(*(field(c) for c in fields))


def folded_case(text: Column) -> Column:
    """The text with A-Z in lower case, other letters as they are."""
    return F.translate(text, _UPPER, _LOWER)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with pos, the place (from 0) in the group by ``order``, nulls first; written. Ties of all columns of ``order`` take places in any order."""
    by = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    own = F.monotonically_increasing_id()
    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", own), "ranked").withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part", group).agg(F.min("_at").alias("_least"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", group, (before - F.col("_least")).alias("_shift"))
    return placed.join(counts, ["_part", group]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def level_up(nodes: Column, fanout: int) -> Column:
    """Hashes of each ``fanout`` consecutive nodes; the last run may be shorter."""
    run = lambda i: F.slice(nodes, (i * fanout + 1).cast("int"), F.lit(fanout))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int")), lambda i: F.sha2(F.aggregate(run(i), F.lit(""), lambda s, x: F.concat(s, x)), 256))


def collapsed(nodes: Column, levels: Column, fanout: int) -> Column:
    """All levels of a block: ``nodes`` first, then so many levels up."""
    return F.aggregate(F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.expr("cast(array() as array<int>)")), F.array(nodes), lambda acc, _: F.concat(acc, F.array(level_up(F.element_at(acc, -1), fanout))))


def siblings(stack: Column, levels: Column, i: Column, fanout: int) -> Column:
    """For node ``i`` of the lowest level, the concatenated siblings left and right of it and of each node above it, in each of ``levels`` levels."""

    def beside(nodes: Column, k: Column) -> Column:
        at = F.floor(i / F.pow(F.lit(float(fanout)), k)).cast("int")
        first = (at - at % fanout).cast("int")
        left, right = F.slice(nodes, first + 1, at - first), F.slice(nodes, at + 2, fanout - 1 - (at - first))
        return F.struct(F.array_join(left, "").alias("l"), F.array_join(right, "").alias("r"))

    return F.transform(F.slice(stack, F.lit(1), levels), beside)


def fold(digest: Column, path: Column) -> Column:
    """The root that a digest and its siblings give."""
    return F.aggregate(path, digest, lambda acc, x: sha(x["l"], acc, x["r"]))


def proof(path: Column) -> Column:
    """One hash of all siblings, level by level, left to right."""
    return F.sha2(F.aggregate(path, F.lit(""), lambda s, x: F.concat(s, x["l"], x["r"])), 256)


@dataclass
class Tree:
    """members: (group, row, pos, path, subroot), row having the leaf's other columns and path all siblings up to the group's root; roots: (group, subroot)."""

    members: DataFrame
    roots: DataFrame


def trees(leaves: DataFrame, group: str, digest: str, order: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> Tree:
    """The tree of each group over the column ``digest`` of ``leaves`` in ``order``. ``group`` has no nulls. A group of one leaf has that leaf as root; an empty table has no group."""
    size = fanout**levels
    rows = ranked(leaves, group, order)
    rounds, up = [], rows.select(group, "pos", F.struct(*[c for c in leaves.columns if c != group]).alias("row"), F.col(digest).alias("digest"))
    most = 0
    while True:
        sizes = up.groupBy(group).agg(F.count("*").alias("n"))
        blocks = up.groupBy(group, F.floor(F.col("pos") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", *(["row"] if not rounds else [])))).alias("nodes")).join(sizes, group)
        depth = F.lit(0)
        for k in range(levels):
            depth = F.when(F.col("n") > fanout**k, k + 1).otherwise(depth)
        blocks = blocks.withColumn("depth", depth).withColumn("stack", collapsed(F.col("nodes.digest"), F.col("depth"), fanout))
        rounds.append(written(blocks.withColumn("root", F.element_at(F.element_at("stack", -1), 1)), "blocks"))
        most = rounds[-1].agg(F.max("n")).first()[0] or 0
        if most <= size:
            break
        up = rounds[-1].select(group, F.col("block").alias("pos"), F.col("root").alias("digest"))
    roots = rounds[-1].select(group, F.col("root").alias("subroot"))
    above: DataFrame | None = None  # (group, block, path, subroot): what comes after the siblings within a block
    for k, blocks in reversed(list(enumerate(rounds))):
        if above is None:
            whole = blocks.withColumn("subroot", F.col("root")).withColumn("above", F.expr("cast(array() as array<struct<l:string,r:string>>)"))
        else:
            whole = blocks.join(above, [group, "block"])
        each = whole.select(group, "subroot", "above", "stack", "depth", F.posexplode("nodes").alias("i", "node"))
        path = F.concat(siblings(F.col("stack"), F.col("depth"), F.col("i"), fanout), F.col("above"))
        if k:
            above = each.select(group, F.col("node.pos").alias("block"), path.alias("above"), "subroot")
        else:
            members = each.select(group, F.col("node.row").alias("row"), F.col("node.pos").alias("pos"), path.alias("path"), "subroot")
    return Tree(members, roots)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, text_col: str = "text", fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """id_col, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    Rows of a group are in order of id (null first), then of leaf, so repeated rows take neighbouring places and have equal leaves. A
    null group is a group of its own, the first; null fields are `-`. Rows whose crc32 of the decimal id is divisible by 5 are tampered
    with: A-Z of the text in lower case, a null text stays null; a null id is not tampered with. An empty table has no rows.
    """
    changed = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    new = [folded_case(F.col(c)) if c == text_col else F.col(c) for c in fields]
    bare = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-")).alias("grp"), F.col(id_col).alias("id"),
        leaf(*(F.col(c) for c in fields)).alias("leaf"), F.when(changed, leaf(*new)).alias("tampered"),
    )
    inner = trees(written(bare, "leaves"), "grp", "leaf", ["id", "leaf"], fanout, levels)
    outer = trees(inner.roots.select(F.lit("").alias("all"), "grp", "subroot"), "all", "subroot", ["grp"], fanout, levels)
    top = outer.members.select("row.grp", F.col("path").alias("above"), F.col("subroot").alias("root"))
    rows = inner.members.join(written(top, "roots"), "grp").withColumn("path", F.concat("path", "above"))
    folded = fold(F.coalesce("row.tampered", "row.leaf"), F.col("path"))
    out = rows.select(F.col("row.id").alias(id_col), "row.leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))




def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The place of every document in the manifest of its source, and whether it still proves itself after tampering."""
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT *, coalesce('=' || source, '-') AS grp, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 5 = 0 AS t FROM documents),
f AS (SELECT grp, doc_id, t, low, text, list_aggregate([coalesce(strlen(x) || ':' || x, '-') FOR x IN [doc_id::VARCHAR, source, lang, n_chars::VARCHAR]], 'string_agg', '') AS head FROM d),
l AS (SELECT grp, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN t THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS tampered FROM f),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
tree AS (SELECT grp, 0 AS lvl, pos, leaf AS h FROM leaves UNION ALL SELECT grp, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM tree) WHERE n > 1 GROUP BY grp, lvl, pos // 16),
subs AS (SELECT grp, max(lvl) AS depth, arg_max(h, lvl) AS subroot FROM tree GROUP BY grp),
tops AS (SELECT *, row_number() OVER (ORDER BY grp) - 1 AS pos FROM subs),
top AS (SELECT 0 AS lvl, pos, subroot AS h FROM tops UNION ALL SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY lvl, pos // 16),
own AS (SELECT leaves.*, depth, subroot, tops.pos AS place, (SELECT max(lvl) FROM top) AS above, (SELECT arg_max(h, lvl) FROM top) AS root FROM leaves JOIN tops USING (grp)),
steps AS (SELECT grp, pos, k, k AS lvl, FALSE AS up, pos // CAST(16 ** k AS BIGINT) AS me FROM (SELECT *, unnest(range(depth)) AS k FROM own) UNION ALL
  SELECT grp, pos, depth + k, k, TRUE, place // CAST(16 ** k AS BIGINT) FROM (SELECT *, unnest(range(above)) AS k FROM own)),
nodes AS (SELECT grp, lvl, pos, h, FALSE AS up FROM tree UNION ALL SELECT NULL, lvl, pos, h, TRUE FROM top),
sib AS (SELECT s.grp, s.pos, s.k, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < s.me), '') AS l, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > s.me), '') AS r
  FROM steps s JOIN nodes n ON n.up = s.up AND n.lvl = s.lvl AND n.pos // 16 = s.me // 16 AND (s.up OR n.grp = s.grp) GROUP BY s.grp, s.pos, s.k),
path AS (SELECT grp, pos, list({'l': l, 'r': r} ORDER BY k) AS p FROM sib GROUP BY grp, pos),
done AS (SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate([x.l || x.r FOR x IN p], 'string_agg', ''), '')) AS proof_sha256,
  (list_reduce(list_prepend({'l': coalesce(tampered, leaf), 'r': ''}, coalesce(p, [])), lambda a, x: {'l': sha256(x.l || a.l || x.r), 'r': ''})).l AS folded_root FROM own LEFT JOIN path USING (grp, pos))
SELECT *, folded_root = root AS verified FROM done
"""
