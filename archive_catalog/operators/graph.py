"""Connected components by least neighbours and pointer doubling, in DataFrame joins only; the folder that executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode (as in tests), else one in the warehouse, which executors share."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        own = tempfile.mkdtemp(prefix="spark-", dir="/tmp") if re.fullmatch(r"local(\[[0-9*, ]*\])?", sc.master) else f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or own)
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, label): each node with the least node that it is connected with. Every step is a table in the shared folder, deleted once the next one stands.

    Each round points every node to its least neighbour, follows the pointers to their ends by doubling, and goes on with the edges between different ends: they
    are few, so the edges as a whole are joined once only. A round at least halves the nodes that still have edges.
    """
    from .scratch import Scratch

    scratch = Scratch(edges.sparkSession, "components")
    a, b = F.col(src), F.col(dst)
    live = scratch.written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges-0")
    maps, step = [], 0
    while True:
        there = live.select(F.col("a").alias("node"), F.col("b").alias("near"))
        ups = scratch.written(there.unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("near"))).groupBy("node").agg(F.least("node", F.min("near")).alias("up")), f"ups-{step}")
        while True:
            top = ups.select(F.col("node").alias("up"), F.col("up").alias("top"))
            after = scratch.written(ups.join(top, "up").select("node", F.col("top").alias("up"), (F.col("top") < F.col("up")).alias("moved")), f"ups-{step + 1}")
            scratch.drop(f"ups-{step}")
            step += 1
            ups = after.select("node", "up")
            if after.where("moved").isEmpty():
                break
        maps.append(ups)
        ends = live.join(ups.toDF("a", "x"), "a").join(ups.toDF("b", "y"), "b").where("x <> y")
        rest = scratch.written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"edges-{len(maps)}")
        scratch.drop(f"edges-{len(maps) - 1}")
        live, step = rest, step + 1
        if live.isEmpty():
            break
    labels = maps.pop().toDF("node", "label")
    for ups in reversed(maps):
        labels = ups.join(labels.toDF("up", "label"), "up", "left").select("node", F.coalesce("label", "up").alias("label"))
    return labels
