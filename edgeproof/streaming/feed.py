"""Edge deactivations as a stream: each micro-batch is an epoch whose affected neighbourhood is looked at again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgeproof.operators import commit, jv
from edgeproof.operators.graph import Graph
from edgeproof.plans.cut import cut


class Feed:
    """Holds the current snapshot; apply() takes a batch (g, edge_id) out of it and gives the candidates that this makes.

    Only edges with an end at a touched point, or next to one, can change their verdict; the others are left alone, and not searched. Edge ids that are
    unknown or inactive, and repeated ones, do nothing.
    """

    def __init__(self, graph: Graph) -> None:
        self.graph = graph

    def apply(self, batch: DataFrame) -> DataFrame:
        gone = cut(self.graph.active().join(batch.select("g", "edge_id").distinct(), ["g", "edge_id"], "left_semi"))
        before = self.graph.adjacency()
        self.graph = self.graph.with_edges(cut(commit.without(self.graph, gone).edges))
        touched = gone.select("g", F.col("u").alias("n")).unionAll(gone.select("g", F.col("v").alias("n"))).distinct()
        near = touched.unionAll(before.join(touched, ["g", "n"]).select("g", F.col("m").alias("n"))).distinct()
        near = cut(near)
        gated = self.graph.gated()
        sides = [gated.join(near.select("g", F.col("n").alias(end)), ["g", end], "left_semi").select(*gated.columns) for end in ("u", "v")]
        return jv.first_sound(self.graph, jv.ranked_witnesses(self.graph, edges=sides[0].unionAll(sides[1]).distinct()))

    def start(self, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
        """Follow a stream of (g, edge_id); sink gets each batch's candidates and number."""

        def each(batch: DataFrame, number: int) -> None:
            sink(self.apply(batch), number)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
