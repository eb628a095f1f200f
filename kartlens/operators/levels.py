"""Level of detail: product, aisle or department.

The reference computes each metric per product and per department; the
dashboard also wanted aisles. A level maps every product to the columns
its results are grouped by. Products without a catalog row, or whose
aisle / department row is missing, drop out (inner joins, rule N8).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from kartlens.functions.joins import bounded_broadcast
from kartlens.model import Tables

LEVELS = ("product", "aisle", "department")


@dataclass(frozen=True)
class Level:
    name: str
    # Columns identifying one group, in output order.
    keys: tuple[str, ...]
    # Prefix of the level's own metric columns: product_avg_..., department_avg_...
    prefix: str

    def product_map(self, tables: Tables) -> DataFrame | None:
        """product_id -> group columns, or None at product level (the group
        is the product itself; names are attached after aggregating)."""
        if self.name == "product":
            return None
        products = tables.products
        if self.name == "department":
            departments = bounded_broadcast(tables.departments, tables.rows("departments"))
            return products.select("product_id", "department_id").join(departments, "department_id").select(
                "product_id", "department"
            )
        aisles = bounded_broadcast(tables.aisles, tables.rows("aisles"))
        return products.select("product_id", "aisle_id").join(aisles, "aisle_id").select("product_id", "aisle")

    def attach(self, tables: Tables, per_group: DataFrame) -> DataFrame:
        """Attach the product name after a product-level aggregate."""
        if self.name != "product":
            return per_group
        names = tables.products.select("product_id", "product_name")
        return per_group.join(bounded_broadcast(names, tables.catalog_rows()), "product_id")

    def label(self) -> tuple[str, ...]:
        return ("product_id", "product_name") if self.name == "product" else self.keys


def level(name: str) -> Level:
    if name == "product":
        return Level("product", ("product_id",), "product")
    if name == "department":
        return Level("department", ("department",), "department")
    if name == "aisle":
        return Level("aisle", ("aisle",), "aisle")
    raise ValueError(f"unknown level {name!r}; expected one of {LEVELS}")


def by_level(tables: Tables, facts: DataFrame, lvl: Level) -> DataFrame:
    """Attach the level's group columns to rows keyed by product_id.

    The product map has at most one row per catalog product, so it is
    broadcast when the counted catalog fits the budget and shuffle-joined
    otherwise.
    """
    mapping = lvl.product_map(tables)
    if mapping is None:
        return facts
    return facts.join(bounded_broadcast(mapping, tables.catalog_rows()), "product_id")
