"""The tables one marketplace consists of, and the views shared by all queries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.operators import hierarchy
from tallymart.operators.sizes import sized_broadcast
from tallymart.plans import rollup
from tallymart.sources.stores import between


@dataclass(frozen=True)
class Marketplace:
    """Raw snapshots, positions and the category tree, with the stored roll-up.

    ``partials`` holds roll-up observations written by batch or stream. Without
    it the roll-up is derived from the raw snapshots on every read.
    """

    products: DataFrame
    categories: DataFrame
    positions: DataFrame | None = None
    partials: DataFrame | None = None

    def snapshots(self, start: dt.date | None = None, end: dt.date | None = None):
        """Raw snapshots of whole days ``start`` to ``end``."""
        return between(self.products, start, end)

    def sku_days(
        self,
        attributes: list[str],
        start: dt.date | None = None,
        end: dt.date | None = None,
        member: Callable[[DataFrame], DataFrame] | None = None,
    ) -> DataFrame:
        """Roll-up rows per SKU and day with only the wanted attributes.

        ``member`` keeps the observations of some entity. Products without any
        are left out before anything is merged; since a SKU-day may combine
        observations of several entities, the caller still filters the result.
        """
        if self.partials is None:
            source = rollup.observations(self.snapshots(start, end))
        else:
            source = between(self.partials, start, end, "date")
        if member is not None:
            products = member(source).select("product_id").distinct()
            source = source.join(products, "product_id", "left_semi")
        return rollup.sku_days(rollup.merge(source, attributes))

    @cached_property
    def closure(self) -> DataFrame:
        """Ancestor pairs of the category tree, walked once per marketplace.

        Sets the checkpoint folder that what is built on it needs too.
        """
        return hierarchy.closure(self.categories)

    @cached_property
    def subtree(self) -> DataFrame:
        """(root_id, category_id) for every category, sized for broadcast."""
        pairs = hierarchy.subtree(self.categories, self.closure)
        return sized_broadcast(pairs.checkpoint())

    @cached_property
    def roots_of(self) -> DataFrame:
        """(category_id, roots): every category whose subtree holds this one."""
        roots = F.array_sort(F.collect_list("root_id")).alias("roots")
        return sized_broadcast(self.subtree.groupBy("category_id").agg(roots).checkpoint())

    @cached_property
    def top_subtree(self) -> DataFrame:
        """The subtree of the top categories only."""
        top = self.closure.where(
            (F.col("root_id") == hierarchy.ABOVE_ALL) & (F.col("level") == 1)
        ).select(F.col("category_id").alias("root_id"))
        pairs = self.subtree.join(top, "root_id", "left_semi")
        return sized_broadcast(pairs.checkpoint())

    @cached_property
    def titles(self) -> DataFrame:
        """(category_id, title), sized for broadcast."""
        return sized_broadcast(self.categories.select("category_id", "title"))
