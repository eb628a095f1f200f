from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from kartlens.model import Tables  # noqa: E402
from kartlens.session import local_session  # noqa: E402
from kartlens.sources import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, app="kartlens-tests")
    yield session
    session.stop()


def make_tables(
    spark,
    orders: list[tuple],
    lines: list[tuple],
    products: list[tuple],
    aisles: list[tuple] | None = None,
    departments: list[tuple] | None = None,
) -> Tables:
    """Tables from plain rows in the S1 layouts.

    orders: (order_id, user_id, order_number, days_since_prior_order)
    lines: (order_id, product_id) or (order_id, product_id, add_to_cart_order, reordered)
    products: (product_id, product_name, aisle_id, department_id)
    """
    orders_rows = [(o, u, "prior", n, 0, 0, None if g is None else float(g)) for o, u, n, g in orders]
    line_rows = [tuple(r) + (None,) * (4 - len(r)) for r in lines]
    aisles = aisles if aisles is not None else sorted({(p[2], f"aisle {p[2]}") for p in products if p[2] is not None})
    departments = (
        departments if departments is not None else sorted({(p[3], f"dept {p[3]}") for p in products if p[3] is not None})
    )
    return Tables(
        orders=spark.createDataFrame(orders_rows, schemas.ORDERS),
        prior=spark.createDataFrame(line_rows, schemas.ORDER_PRODUCTS),
        products=spark.createDataFrame(products, schemas.PRODUCTS),
        aisles=spark.createDataFrame(aisles, schemas.AISLES),
        departments=spark.createDataFrame(departments, schemas.DEPARTMENTS),
    )


def rows(df, *cols):
    """Rows of ``df`` as sorted tuples of the given columns."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
