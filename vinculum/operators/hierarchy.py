"""Parent-child links to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vinculum.runtime import cut


def token_parents(tokengraph: DataFrame, root: str = "root") -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a token graph: nodes doc_id, id; links doc_id, id, parent.

    The parent is related1 if that names a record of the same document, else related2 if that does; `root` in related1
    means none. Copies of a record are one node; rows with null doc_id or id are no node.
    """
    rec = tokengraph.where(F.col("doc_id").isNotNull() & F.col("id").isNotNull()).groupBy("doc_id", "id").agg(F.max("related1").alias("r1"), F.max("related2").alias("r2"))
    nodes = rec.select("doc_id", "id")
    tries = F.when(F.col("r1") == root, F.array().cast("array<struct<prio:int,parent:string>>")).otherwise(
        F.array(F.struct(F.lit(1).alias("prio"), F.col("r1").alias("parent")), F.struct(F.lit(2).alias("prio"), F.col("r2").alias("parent")))
    )
    cand = rec.select("doc_id", "id", F.explode(tries).alias("c")).select("doc_id", "id", "c.prio", "c.parent").where("parent is not null")
    links = cand.join(nodes.withColumnRenamed("id", "parent"), ["doc_id", "parent"]).groupBy("doc_id", "id").agg(F.min_by("parent", "prio").alias("parent"))
    return nodes, links


def _step(live: DataFrame) -> DataFrame:
    """One doubling of the jump length; a node whose jump target has no jump itself is resolved and drops out."""
    far = live.select("doc_id", F.col("id").alias("jump"), F.col("jump").alias("next"))
    return live.join(far, ["doc_id", "jump"]).select("doc_id", "id", F.col("next").alias("jump"))


def loop_nodes(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Nodes that are their own ancestors: doc_id, id. links: doc_id, id, parent (at most one row an id).

    After k rounds a pointer spans 2**k links; nodes whose chain ends drop out. The targets still pointed at shrink
    from round to round; once their number stays the same, jumping permutes them, so they are exactly the nodes on
    loops, and what only leads into a loop is none of them. An empty table gives an empty result.
    """
    live = cut(links.select("doc_id", "id", F.col("parent").alias("jump")).where("jump is not null"))
    last = -1
    for _ in range(max_rounds):
        targets = live.select("doc_id", "jump").distinct().count()
        if targets == last or targets == 0:
            break
        last = targets
        live = cut(_step(live))
    else:
        raise RuntimeError(f"loops not told after {max_rounds} rounds")
    return live.select("doc_id", F.col("jump").alias("id")).distinct()


def hierarchy(nodes: DataFrame, links: DataFrame, sep: str = ">", max_rounds: int = 64) -> DataFrame:
    """For each node its path from the root, depth, root and loop flags.

    nodes: doc_id, id; links: doc_id, id, parent (at most one row an id, parents among the nodes). Result: doc_id, id,
    path (ids from root to node joined by `sep`), depth (0 at a root), root, on_loop, into_loop, ids (the path as an
    array). A node on a loop, or one that leads into one, has null path, depth and root. Path pieces are concatenated as
    the pointers double: each round is one join of what is still open with what it points at, and writes only what is new.
    Round k finishes the depths from 2**(k-1) up to 2**k - 1; where a round finishes nothing, no deeper node is left, and
    what is still open are loops and what leads into them. More than `max_rounds` rounds are an error.
    """
    start = cut(nodes.join(links, ["doc_id", "id"], "left").select("doc_id", "id", F.col("parent").alias("jump"), F.array("id").alias("path")))
    nothing = F.lit(None).cast("string")
    finished, live = [start.where("jump is null").select("doc_id", "id", "path")], start.where("jump is not null")
    for _ in range(max_rounds):
        over = live.select("doc_id", F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("path").alias("head"))
        for part in finished:
            over = over.unionByName(part.select("doc_id", F.col("id").alias("jump"), nothing.alias("next"), F.col("path").alias("head")))
        step = cut(live.join(over, ["doc_id", "jump"]).select("doc_id", "id", F.col("next").alias("jump"), F.concat("head", "path").alias("path")))
        told = step.where("jump is null").select("doc_id", "id", "path")
        if told.isEmpty():
            break
        finished.append(told)
        live = step.where("jump is not null")
    else:
        raise RuntimeError(f"paths not finished after {max_rounds} rounds")
    return _labelled(finished, live.select("doc_id", "id"), start.where("jump is not null").select("doc_id", "id", F.col("jump").alias("parent")), sep)


def _labelled(finished: list[DataFrame], left: DataFrame, links: DataFrame, sep: str) -> DataFrame:
    """The finished paths with their labels, and the nodes left over, told apart by a search for loops among them alone."""
    known = finished[0]
    for part in finished[1:]:
        known = known.unionByName(part)
    good = known.select("doc_id", "id", F.array_join("path", sep).alias("path"), (F.size("path") - 1).alias("depth"), F.element_at("path", 1).alias("root"), F.lit(False).alias("on_loop"), F.lit(False).alias("into_loop"), F.col("path").alias("ids"))
    left = cut(left.join(links, ["doc_id", "id"]))
    looping = loop_nodes(left).withColumn("on", F.lit(True))
    nothing = F.lit(None).cast("string")
    on = F.coalesce("on", F.lit(False))
    bad = left.join(looping, ["doc_id", "id"], "left").select("doc_id", "id", nothing.alias("path"), F.lit(None).cast("int").alias("depth"), nothing.alias("root"), on.alias("on_loop"), (~on).alias("into_loop"), F.lit(None).cast("array<string>").alias("ids"))
    return good.unionByName(bad)


def intervals(tree: DataFrame) -> DataFrame:
    """doc_id, id, entry, below: the place of each node of a `hierarchy` in the preorder of its document, and its descendants' number.

    The nodes below a node are those of its document with an entry over its own, up to its own plus `below`. Paths sort
    as the preorder does, so one range-partitioned sort numbers all documents, however large; nodes without a path are
    left out.
    """
    good = tree.where("ids is not null").select("doc_id", "id", "ids")
    at = cut(good.repartitionByRange("doc_id", "ids").sortWithinPartitions("doc_id", "ids").select("doc_id", "id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n")))
    sizes = at.groupBy("part").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = sizes.select("part", "first", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))  # one row a partition
    placed = at.join(F.broadcast(before), "part").select("doc_id", "id", (F.col("n") - F.col("first") + F.col("before")).alias("place"))
    start = placed.groupBy("doc_id").agg(F.min("place").alias("start"))
    return placed.join(start, "doc_id").join(descendant_counts(tree), ["doc_id", "id"], "left").select("doc_id", "id", (F.col("place") - F.col("start")).alias("entry"), F.coalesce("n_descendants", F.lit(0)).cast("long").alias("below"))


def descendants(tree: DataFrame) -> DataFrame:
    """All (ancestor, descendant) pairs of a `hierarchy`: doc_id, id, descendant, distance; one row for each ancestor on a path."""
    return (
        tree.where("depth > 0")
        .select("doc_id", F.col("id").alias("descendant"), "depth", F.posexplode(F.expr("slice(ids, 1, depth)")).alias("at", "above"))
        .select("doc_id", F.col("above").alias("id"), "descendant", (F.col("depth") - F.col("at")).alias("distance"))
    )


def descendant_counts(tree: DataFrame) -> DataFrame:
    """doc_id, id, n_descendants for every node that has any."""
    return tree.where("depth > 0").select("doc_id", F.explode(F.expr("slice(ids, 1, depth)")).alias("id")).groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n_descendants"))
