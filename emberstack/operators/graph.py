"""Reachability over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberstack.tables import discard, saved, saved_counted


def reachable(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``(node)`` that lead to one of ``roots(node)`` along ``links(child, parent)``, the roots too; saved. Cycles end.

    Links are doubled: after k rounds they lead 2**k steps up, so a chain of n takes about log2(n) rounds, each two joins. Where a
    child has one parent no round holds more links than there are.
    """
    done, known = saved_counted(roots.select("node").distinct())
    jump, left = saved_counted(links.select("child", "parent").where("child is not null and parent is not null and child <> parent").distinct())
    while left:
        new = jump.join(done, F.col("parent") == F.col("node"), "left_semi").select(F.col("child").alias("node")).distinct().join(done, "node", "left_anti")
        more, found = saved_counted(done.unionByName(new))
        if found == known:
            discard(more)
            break
        far = jump.select(F.col("child").alias("__child"), F.col("parent").alias("__parent"))
        longer, left = saved_counted(jump.join(far, F.col("parent") == F.col("__child")).select("child", F.col("__parent").alias("parent")).distinct())
        discard(done, jump)
        done, known, jump = more, found, longer
    discard(jump)
    return done
