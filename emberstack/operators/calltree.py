"""The call tree as a table of nodes, its expansion and its hot path.

A node is named by a hash over the chain of (parent node, module, symbol) from the root, so names may hold any characters; its
path is the names joined, for people to read. The root itself is no row; its key is ROOT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberstack.operators.graph import reachable

ROOT = 0


def nodes(frames: DataFrame, by: tuple[str, ...] = (), weights: DataFrame | None = None) -> DataFrame:
    """``(key, parent_key, path, parent, depth, module, symbol, *by, total, self)``: a node for each distinct chain from the root;
    the root's children have parent ''.

    With ``by`` (columns that are the same for all frames of a sample, as its source) a row for each node and value of them.
    With ``weights(stack_id, *by, n)`` frames are of stacks, ``frames(stack_id, ...)``, which count n times.

    Stacks that are equal are counted first (those with ``weights`` are so already), so frames of a frequent stack are expanded once;
    what is shuffled is keyed by the node's 64 bits, with its parent's path, from which its own follows, and aggregated by hash
    in memory.
    """
    frame = F.struct("depth", "module", "symbol")
    chain = F.transform(F.array_sort(F.collect_list(frame)), lambda x: F.struct(x["module"].isNull().alias("none"), x["module"].alias("module"), x["symbol"].alias("symbol"))).alias("stack")
    if weights is None:
        stacks = frames.groupBy("sample_id", *by).agg(chain).groupBy("stack", *by).agg(F.count("*").alias("n"))
    else:
        own = weights.groupBy(F.col("stack_id").alias("__stack"), *by).agg(F.sum("n").alias("n"))
        stacks = frames.groupBy("stack_id").agg(chain).join(own, F.col("stack_id") == F.col("__stack")).select("stack", *by, "n")
    shown = F.transform("stack", lambda x: F.concat_ws("!", x["module"], x["symbol"]))
    each = stacks.select("stack", shown.alias("names"), F.size("stack").alias("size"), *by, "n", F.posexplode("stack").alias("at", "node"))
    chained = lambda n: F.xxhash64(F.slice("stack", F.lit(1), n))
    spelled = lambda n: F.array_join(F.slice("names", F.lit(1), n), ">")
    at, root = F.col("at"), F.lit(ROOT).cast("long")
    chains = each.select(
        chained(at + 1).alias("key"), F.when(at == 0, root).otherwise(chained(at)).alias("parent_key"), spelled(at).alias("parent"),
        (at + 1).cast("long").alias("depth"), "node.module", "node.symbol", *by, "n", F.when(at + 1 == F.col("size"), F.col("n")).otherwise(0).alias("own"),
    )
    found = chains.groupBy("key", "parent", "depth", "module", "symbol", *by).agg(F.min("parent_key").alias("parent_key"), F.sum("n").alias("total"), F.sum("own").alias("self"))
    name = F.concat_ws("!", "module", "symbol")
    path = F.when(F.col("depth") == 1, name).otherwise(F.concat("parent", F.lit(">"), name)).alias("path")
    return found.select("key", "parent_key", path, "parent", "depth", "module", "symbol", *by, "total", "self")


def children(tree: DataFrame, of: str | int) -> DataFrame:
    """The children of a node, named by its key or (where no name holds a separator) by its path; of the root by ROOT or ''."""
    return tree.where((F.col("parent") if isinstance(of, str) else F.col("parent_key")) == of)


def _hot(tree: DataFrame, root_self: DataFrame) -> DataFrame:
    """``(node)``: the keys of the hot path, ROOT too."""
    shown = F.concat_ws("!", "module", "symbol")
    top = tree.groupBy("parent_key").agg(F.min_by(F.struct("key", "total"), F.struct(-F.col("total"), shown)).alias("top"))
    own = tree.select(F.col("key").alias("own_key"), F.col("self").alias("own_self")).unionByName(root_self.select(F.lit(ROOT).cast("long").alias("own_key"), F.col("self").alias("own_self")))
    links = top.join(own, F.col("parent_key") == F.col("own_key")).where(F.col("top.total") > F.col("own_self"))
    return reachable(links.select(F.col("top.key").alias("child"), F.col("parent_key").alias("parent")), tree.sparkSession.range(1).select(F.lit(ROOT).cast("long").alias("node")))


def hot_path(tree: DataFrame, root_self: DataFrame) -> DataFrame:
    """From the root along the child with the largest total (ties to the lesser name), while it exceeds its parent's self hits, at
    any depth. ``root_self(self)`` is one row."""
    return tree.join(_hot(tree, root_self), F.col("key") == F.col("node")).select("path", "depth", "total", "self")


def hot_tree(tree: DataFrame, root_self: DataFrame) -> DataFrame:
    """What a viewer shows of the hot path: the children of every node on it, those that are on it themselves marked ``expanded``."""
    hot = _hot(tree, root_self)
    on = hot.select(F.col("node").alias("on_node"), F.lit(True).alias("on"))
    shown = tree.join(hot, F.col("parent_key") == F.col("node"), "left_semi")
    return shown.join(on, F.col("key") == F.col("on_node"), "left").select(*tree.columns, F.coalesce("on", F.lit(False)).alias("expanded"))
