"""Category tree: closure, subtrees and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.session import shared_folder

ABOVE_ALL = 0  # Fixed value: the parent id of every top category.


def closure(edges: DataFrame) -> DataFrame:
    """Every (root_id, category_id, level) pair of ancestor and descendant.

    One join per tree level, stopping when a level is empty. Levels and the
    result are checkpointed, so no level walks those before it again, and later queries scan it instead of walking the tree again.
    """
    links = edges.select("category_id", "parent_category_id")
    frontier = links.select(
        F.col("parent_category_id").alias("root_id"),
        "category_id",
        F.lit(1).alias("level"),
    )
    shared_folder(edges.sparkSession)
    levels = [frontier]
    while True:
        frontier = frontier.join(
            links.select(
                F.col("category_id").alias("root_id"),
                F.col("parent_category_id").alias("_up"),
            ),
            "root_id",
        ).select(
            F.col("_up").alias("root_id"),
            "category_id",
            (F.col("level") + 1).alias("level"),
        )
        frontier = frontier.checkpoint()
        if frontier.isEmpty():
            break
        if not frontier.where("root_id = category_id").isEmpty():
            raise ValueError("the category tree contains a cycle")
        levels.append(frontier)
    pairs = levels[0]
    for level in levels[1:]:
        pairs = pairs.union(level)
    return pairs.checkpoint()


def descendants(pairs: DataFrame, root_id: int | None = None, level: int = 0) -> DataFrame:
    """Descendants of one root or of all; ``level`` 0 means every level."""
    if root_id is not None:
        pairs = pairs.where(F.col("root_id") == root_id)
    return pairs if level == 0 else pairs.where(F.col("level") == level)


def subtree(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(root_id, category_id): strict descendants, or the category itself if a leaf."""
    inner = pairs.where(F.col("root_id") != ABOVE_ALL).select("root_id", "category_id")
    parents = edges.select(F.col("parent_category_id").alias("category_id")).distinct()
    leaves = edges.join(parents, "category_id", "left_anti").select(
        F.col("category_id").alias("root_id"), "category_id"
    )
    return inner.union(leaves)


def hierarchy(edges: DataFrame) -> DataFrame:
    """Title, parent and ordered child ids of every category."""
    children = edges.groupBy(F.col("parent_category_id").alias("category_id")).agg(
        F.array_sort(F.collect_list(F.col("category_id"))).alias("children_ids")
    )
    return edges.join(children, "category_id", "left").select(
        "category_id",
        F.col("title").alias("name"),
        F.col("parent_category_id").alias("parent_id"),
        F.coalesce("children_ids", F.array().cast("array<bigint>")).alias("children_ids"),
    )


def with_title(
    rows: DataFrame, titles: DataFrame, key: str, out: str, missing: str = ""
) -> DataFrame:
    """Look up the title of the category in ``key``; ``missing`` if unknown.

    ``titles`` is the (category_id, title) table, already sized for broadcast.
    """
    names = titles.select(F.col("category_id").alias(key), F.col("title").alias(out))
    return rows.join(names, key, "left").withColumn(
        out, F.coalesce(F.col(out), F.lit(missing))
    )
