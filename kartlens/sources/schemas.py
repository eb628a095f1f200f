"""The six input tables of the order / line-item / catalog model.

Types follow the declared SQL types: INTEGER -> int, TEXT -> string and
the 8-byte SQL FLOAT of ``days_since_prior_order`` -> double (a Spark
``float`` would be 4 bytes). Ids read from parquet may be ``long``; every
operator only relies on the column names.
"""

from __future__ import annotations

from pyspark.sql import types as T

ORDERS = T.StructType(
    [
        T.StructField("order_id", T.IntegerType(), False),
        T.StructField("user_id", T.IntegerType(), True),
        T.StructField("eval_set", T.StringType(), True),
        T.StructField("order_number", T.IntegerType(), True),
        T.StructField("order_dow", T.IntegerType(), True),
        T.StructField("order_hour_of_day", T.IntegerType(), True),
        T.StructField("days_since_prior_order", T.DoubleType(), True),
    ]
)

ORDER_PRODUCTS = T.StructType(
    [
        T.StructField("order_id", T.IntegerType(), True),
        T.StructField("product_id", T.IntegerType(), True),
        T.StructField("add_to_cart_order", T.IntegerType(), True),
        T.StructField("reordered", T.IntegerType(), True),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.IntegerType(), False),
        T.StructField("product_name", T.StringType(), True),
        T.StructField("aisle_id", T.IntegerType(), True),
        T.StructField("department_id", T.IntegerType(), True),
    ]
)

AISLES = T.StructType(
    [
        T.StructField("aisle_id", T.IntegerType(), False),
        T.StructField("aisle", T.StringType(), True),
    ]
)

DEPARTMENTS = T.StructType(
    [
        T.StructField("department_id", T.IntegerType(), False),
        T.StructField("department", T.StringType(), True),
    ]
)

# Table name -> (schema, primary key columns). The two line-item tables
# have no key.
TABLES: dict[str, tuple[T.StructType, tuple[str, ...]]] = {
    "orders": (ORDERS, ("order_id",)),
    "order_products__prior": (ORDER_PRODUCTS, ()),
    "order_products__train": (ORDER_PRODUCTS, ()),
    "products": (PRODUCTS, ("product_id",)),
    "aisles": (AISLES, ("aisle_id",)),
    "departments": (DEPARTMENTS, ("department_id",)),
}

# Foreign-key style references the analysis joins rely on (never enforced
# by the source): (child table, child column, parent table, parent column).
REFERENCES: tuple[tuple[str, str, str, str], ...] = (
    ("order_products__prior", "order_id", "orders", "order_id"),
    ("order_products__prior", "product_id", "products", "product_id"),
    ("order_products__train", "order_id", "orders", "order_id"),
    ("order_products__train", "product_id", "products", "product_id"),
    ("products", "aisle_id", "aisles", "aisle_id"),
    ("products", "department_id", "departments", "department_id"),
)
