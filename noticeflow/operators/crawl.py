"""A tree walked level by level under limits, and a budget of requests dealt before anything is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.streaming.windows import work_dir


def bounded_crawl(roots: DataFrame, children: DataFrame, max_depth: int, max_folders: int, max_files: int) -> tuple[DataFrame, DataFrame]:
    """Folders and files below each root, breadth first, and each root's status.

    ``roots(root)``; ``children(parent, path, directory)``. Gives (root, path, directory, depth) of the roots that kept
    within the limits, and (root, status, folders, files): SUCCESS, or DEPTH, FOLDERS or FILES for the limit that a root
    went beyond; such a root gives no rows, as an index of a part would be wrong. A path met again is not walked again.
    Each level is one join of the frontier with its children and one anti join with what was visited, written as it is
    found; the driver holds a count a level. Names that begin with . or ~$ are passed over.
    """
    spark = roots.sparkSession
    folder = work_dir(spark, "crawl")
    entries = children.where(~F.regexp_extract("path", "([^/]*)$", 1).rlike(r"^(\.|~\$)"))
    level = roots.select("root", F.col("root").alias("path"), F.lit(True).alias("directory"), F.lit(0).alias("depth")).distinct()
    schema, depth = level.schema, 0
    over = []
    while True:
        level.write.parquet(f"{folder}/level={depth}")
        now = spark.read.schema(schema).parquet(f"{folder}/level={depth}")
        visited = spark.read.schema(schema).parquet(*[f"{folder}/level={d}" for d in range(depth + 1)])
        sizes = visited.groupBy("root").agg(F.count_if("directory").alias("folders"), F.count_if(~F.col("directory")).alias("files"))
        beyond = sizes.where((F.col("folders") > max_folders) | (F.col("files") > max_files)).select("root")
        frontier = now.where("directory").join(beyond, "root", "left_anti")
        if frontier.isEmpty():
            break
        met = frontier.select("root", F.col("path").alias("parent")).join(entries, "parent").groupBy("root", "path").agg(F.bool_or("directory").alias("directory"))
        new = met.join(visited.select("root", "path"), ["root", "path"], "left_anti")
        if depth >= max_depth:
            over.append(new.where("directory").select("root").distinct())
            new = new.where("not directory")
        level = new.select("root", "path", "directory", F.lit(depth + 1).alias("depth"))
        depth += 1
        if depth > max_depth + 1:
            break
    deep = over[0] if over else roots.select("root").where("false")
    for x in over[1:]:
        deep = deep.unionByName(x)
    marked = sizes.join(deep.distinct().withColumn("deep", F.lit(True)), "root", "left")
    status = F.when(F.col("folders") > max_folders, "FOLDERS").when(F.col("files") > max_files, "FILES").when(F.coalesce("deep", F.lit(False)), "DEPTH").otherwise("SUCCESS")
    states = marked.select("root", status.alias("status"), "folders", "files")
    return visited.join(states.where("status = 'SUCCESS'").select("root"), "root", "left_semi"), states


def deal_budget(listings: DataFrame, group: str, order: list[Column], pages: str, budget: int) -> DataFrame:
    """One row per request (``page`` from 1) that a budget allows: groups in order, in them listings by ``order``, each
    with its ``pages``; the listing in which the budget ends gets its first pages.

    Sums run over the groups (one row each) and within each group, so the whole is sorted in no single task.
    """
    totals = listings.groupBy(group).agg(F.sum(pages).alias("__all"))
    w = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)  # a row per group
    starts = totals.select(group, F.coalesce(F.sum("__all").over(w), F.lit(0)).alias("__start"))
    own = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = listings.withColumn("__own", F.coalesce(F.sum(pages).over(own), F.lit(0))).join(F.broadcast(starts), group)
    allowed = F.least(F.col(pages).cast("long"), F.lit(budget) - F.col("__start") - F.col("__own")).cast("int")
    return placed.where(allowed > 0).withColumn("page", F.explode(F.sequence(F.lit(1), allowed))).drop("__own", "__start")
