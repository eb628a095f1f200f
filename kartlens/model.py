"""The order / line-item / catalog data model every operator reads."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    """The six input tables, as DataFrames with the S1 column names.

    ``lines`` (order_id, product_id) and ``gaps`` (order_id,
    days_since_prior_order) are the projections every analysis step reads.
    A source that can produce them more cheaply than projecting the full
    tables (for example without deriving ``reordered`` or ``order_number``)
    passes them explicitly.
    """

    orders: DataFrame
    prior: DataFrame
    products: DataFrame
    aisles: DataFrame
    departments: DataFrame
    train: DataFrame | None = None
    prior_lines: DataFrame | None = None
    order_gaps: DataFrame | None = None
    _counts: dict = field(default_factory=dict, compare=False, repr=False)
    # Frames written once for these tables (``plans.stored``).
    _stored: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def lines(self) -> DataFrame:
        if self.prior_lines is not None:
            return self.prior_lines
        return self.prior.select("order_id", "product_id")

    @property
    def gaps(self) -> DataFrame:
        """(order_id, days_since_prior_order) of every order."""
        if self.order_gaps is not None:
            return self.order_gaps
        return self.orders.select("order_id", "days_since_prior_order")

    def rows(self, name: str) -> int:
        """Row count of one input table, counted once per ``Tables``."""
        if name not in self._counts:
            df = self.table(name)
            self._counts[name] = 0 if df is None else df.count()
        return self._counts[name]

    def line_rows(self) -> int:
        """Row count of the prior line items (``lines``), counted once."""
        if "lines" not in self._counts:
            self._counts["lines"] = self.lines.count()
        return self._counts["lines"]

    def catalog_rows(self) -> int:
        """Row count of ``products``: the proven bound for every
        catalog-sized side (product maps, qualifying products)."""
        return self.rows("products")

    def table(self, name: str) -> DataFrame | None:
        return {
            "orders": self.orders,
            "order_products__prior": self.prior,
            "order_products__train": self.train,
            "products": self.products,
            "aisles": self.aisles,
            "departments": self.departments,
        }[name]
