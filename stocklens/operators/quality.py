"""Data-quality checks: what the schema declares, tested on the data.

Each check is a function to a frame of violations or violation counts; an empty frame or a
zero count means the declaration holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from stocklens.sources.tables import Tables, kept

# The constraints of the data model.
KEYS: dict[str, list[list[str]]] = {
    "warehouses": [["warehouse_id"], ["warehouse_code"]],
    "product_categories": [["category_id"]],
    "products": [["product_id"], ["sku"]],
    "suppliers": [["supplier_id"], ["supplier_code"]],
    "product_suppliers": [["product_id", "supplier_id"]],
    "customers": [["customer_id"], ["customer_code"]],
    "purchase_orders": [["po_id"], ["po_number"]],
    "purchase_order_items": [["po_item_id"]],
    "sales_orders": [["so_id"], ["so_number"]],
    "sales_order_items": [["so_item_id"]],
    "inventory": [["inventory_id"], ["warehouse_id", "product_id"]],
    "demand_forecasts": [["product_id", "warehouse_id", "forecast_date", "forecast_period"]],
    "stockout_events": [["stockout_id"]],
    "inventory_transactions": [["transaction_id"]],
}
REQUIRED: dict[str, list[str]] = {
    "warehouses": ["warehouse_code", "warehouse_name", "city", "state", "capacity_units"],
    "product_categories": ["category_name"],
    "products": ["sku", "product_name", "unit_cost", "unit_price"],
    "suppliers": ["supplier_code", "supplier_name"],
    "product_suppliers": ["unit_cost", "lead_time_days"],
    "customers": ["customer_code", "customer_name"],
    "purchase_orders": ["po_number", "order_date", "expected_delivery_date"],
    "purchase_order_items": ["quantity_ordered", "unit_cost"],
    "sales_orders": ["so_number", "order_date"],
    "sales_order_items": ["quantity_ordered", "unit_price"],
    "inventory": ["quantity_on_hand", "quantity_reserved"],
    "demand_forecasts": ["forecast_date", "forecasted_quantity"],
    "stockout_events": ["stockout_start_date"],
    "inventory_transactions": ["quantity", "transaction_date"],
}
REFERENCES: list[tuple[str, str, str, str]] = [
    ("product_categories", "parent_category_id", "product_categories", "category_id"),
    ("products", "category_id", "product_categories", "category_id"),
    ("product_suppliers", "product_id", "products", "product_id"),
    ("product_suppliers", "supplier_id", "suppliers", "supplier_id"),
    ("purchase_orders", "supplier_id", "suppliers", "supplier_id"),
    ("purchase_orders", "warehouse_id", "warehouses", "warehouse_id"),
    ("purchase_order_items", "po_id", "purchase_orders", "po_id"),
    ("purchase_order_items", "product_id", "products", "product_id"),
    ("sales_orders", "customer_id", "customers", "customer_id"),
    ("sales_orders", "warehouse_id", "warehouses", "warehouse_id"),
    ("sales_order_items", "so_id", "sales_orders", "so_id"),
    ("sales_order_items", "product_id", "products", "product_id"),
    ("inventory", "warehouse_id", "warehouses", "warehouse_id"),
    ("inventory", "product_id", "products", "product_id"),
    ("inventory_transactions", "warehouse_id", "warehouses", "warehouse_id"),
    ("inventory_transactions", "product_id", "products", "product_id"),
    ("demand_forecasts", "product_id", "products", "product_id"),
    ("demand_forecasts", "warehouse_id", "warehouses", "warehouse_id"),
    ("stockout_events", "warehouse_id", "warehouses", "warehouse_id"),
    ("stockout_events", "product_id", "products", "product_id"),
]
ALLOWED: list[tuple[str, str, list[str]]] = [
    ("customers", "customer_type", ["Retail", "Wholesale", "Distributor", "Direct"]),
    (
        "purchase_orders",
        "status",
        ["Draft", "Submitted", "Confirmed", "Shipped", "Delivered", "Cancelled"],
    ),
    (
        "sales_orders",
        "status",
        ["Pending", "Confirmed", "Picking", "Shipped", "Delivered", "Cancelled"],
    ),
    (
        "inventory_transactions",
        "transaction_type",
        ["Receipt", "Sale", "Transfer_In", "Transfer_Out", "Adjustment", "Return", "Damaged"],
    ),
    ("demand_forecasts", "forecast_period", ["Daily", "Weekly", "Monthly"]),
]
RANGES: list[tuple[str, str, str, str]] = [("suppliers", "quality_rating", "0", "5")]
LENGTHS: dict[str, dict[str, int]] = {
    "warehouses": {
        "warehouse_code": 10, "warehouse_name": 100, "address": 255, "city": 100, "state": 50, "zip_code": 20,
        "country": 50,
    },
    "product_categories": {"category_name": 100},
    "products": {"sku": 50, "product_name": 200},
    "suppliers": {
        "supplier_code": 20, "supplier_name": 200, "contact_name": 100, "email": 100, "phone": 20, "address": 255,
        "city": 100, "state": 50, "country": 50,
    },
    "product_suppliers": {"supplier_sku": 50},
    "customers": {
        "customer_code": 20, "customer_name": 200, "customer_type": 50, "email": 100, "phone": 20, "address": 255,
        "city": 100, "state": 50, "zip_code": 20, "country": 50,
    },
    "purchase_orders": {"po_number": 30, "status": 30},
    "sales_orders": {"so_number": 30, "status": 30},
    "inventory_transactions": {"transaction_type": 30, "reference_type": 30},
    "demand_forecasts": {"forecast_period": 20, "model_used": 50},
    "stockout_events": {"root_cause": 100},
}
DECIMALS: dict[str, dict[str, tuple[int, int]]] = {
    "warehouses": {"latitude": (10, 8), "longitude": (11, 8), "operating_cost_per_unit": (10, 2)},
    "products": {"unit_cost": (12, 2), "unit_price": (12, 2), "weight_kg": (8, 3), "volume_cubic_m": (8, 4)},
    "suppliers": {"quality_rating": (3, 2)},
    "product_suppliers": {"unit_cost": (12, 2)},
    "customers": {"latitude": (10, 8), "longitude": (11, 8), "credit_limit": (12, 2)},
    "purchase_orders": {"total_amount": (14, 2)},
    "purchase_order_items": {"unit_cost": (12, 2), "line_total": (14, 2)},
    "sales_orders": {"total_amount": (14, 2), "shipping_cost": (10, 2)},
    "sales_order_items": {"unit_price": (12, 2), "discount_percent": (5, 2), "line_total": (14, 2)},
    "inventory_transactions": {"unit_cost": (12, 2)},
    "stockout_events": {"lost_sales_amount": (14, 2)},
}


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once; NULL keys do not collide."""
    # Counted and not filtered: a filter would reach the scan, and rows that several keys of a derived
    # table are made of would move once for each key instead of once.
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    counted = F.count(F.when(present, F.lit(1))).alias("occurrences")
    return df.groupBy(*keys).agg(counted).filter("occurrences > 1")


def missing_references(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose non-NULL reference has no parent."""
    # Repeated references are folded before the shuffle: a hot parent key travels once.
    wanted = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    keys = parent.select(F.col(parent_column).alias("value"))
    return wanted.join(keys, "value", "left_anti")


def check_unique(
    t: Tables, keys: Mapping[str, list[list[str]]] = KEYS, folder: str | None = None
) -> DataFrame:
    """Duplicated values and surplus rows per declared key.

    With a ``folder``, the counts of a table are written there before the next table is read: what its
    keys moved is gone then.
    """
    tables = []
    for name, groups in keys.items():
        if name not in t:
            continue
        out = []
        for cols in groups:
            out.append(
                key_violations(t(name, *cols), cols)
                .agg(
                    F.count("*").alias("duplicated_keys"),
                    F.coalesce(F.sum(F.col("occurrences") - 1), F.lit(0)).alias("surplus_rows"),
                )
                .select(
                    F.lit(name).alias("table_name"),
                    F.lit(",".join(cols)).alias("columns"),
                    "duplicated_keys",
                    "surplus_rows",
                )
            )
        counts = _union(out)
        tables.append(counts if folder is None else kept(counts, f"{folder}/{name}"))
    return _union(tables)


def _counts_per_column(df: DataFrame, name: str, bad: dict[str, object]) -> DataFrame:
    """One pass over the table: a violation count per column, as rows."""
    counts = df.agg(*[F.count_if(cond).alias(c) for c, cond in bad.items()])
    return counts.unpivot([], list(bad), "column_name", "violations").select(
        F.lit(name).alias("table_name"), "column_name", "violations"
    )


def check_required(t: Tables, required: Mapping[str, list[str]] = REQUIRED) -> DataFrame:
    """NULLs per mandatory column, one pass per table."""
    return _union(
        [
            _counts_per_column(t(name, *cols), name, {c: F.col(c).isNull() for c in cols})
            for name, cols in required.items()
            if name in t
        ]
    )


def check_references(t: Tables, references: Sequence[tuple[str, str, str, str]] = tuple(REFERENCES)) -> DataFrame:
    """Orphan rows per foreign key, one pass over each child table.

    All references of a child are unfolded from the same scan and counted per value before they
    meet their parents' keys, so that a hot key travels once.
    """
    out = []
    for child in dict.fromkeys(r[0] for r in references):
        held = [r for r in references if r[0] == child and child in t and r[2] in t]
        if not held:
            continue
        columns = list(dict.fromkeys(r[1] for r in held))
        pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
        values = (
            t(child, *columns)
            .select(F.explode(F.array(*pairs)).alias("p"))
            .groupBy("p.column_name", "p.value")
            .agg(F.count("*").alias("n"))
        )
        parents = _union(
            [
                t(parent, key).select(
                    F.lit(column).alias("column_name"),
                    F.col(key).cast("string").alias("value"),
                    F.lit(True).alias("known"),
                )
                for _, column, parent, key in held
            ]
        )
        orphan = F.col("known").isNull() & F.col("value").isNotNull()
        found = (
            values.join(parents.distinct(), ["column_name", "value"], "left")
            .groupBy("column_name")
            .agg(F.sum(F.when(orphan, F.col("n")).otherwise(0)).alias("orphan_rows"))
        )
        parent_of = F.create_map(*[F.lit(x) for r in held for x in (r[1], r[2])])
        out.append(
            found.select(
                F.lit(child).alias("table_name"),
                "column_name",
                F.element_at(parent_of, F.col("column_name")).alias("parent_table"),
                "orphan_rows",
            )
        )
    return _union(out)


def check_allowed(t: Tables, allowed: Sequence[tuple[str, str, list[str]]] = tuple(ALLOWED)) -> DataFrame:
    """Values outside their declared list, with counts."""
    return _union(
        [
            t(name, column)
            .filter(~F.col(column).isin(*values))
            .groupBy(F.col(column).alias("value"))
            .agg(F.count("*").alias("violations"))
            .select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), "value", "violations")
            for name, column, values in allowed
            if name in t
        ]
    )


def check_ranges(t: Tables, ranges: Sequence[tuple[str, str, str, str]] = tuple(RANGES)) -> DataFrame:
    """Rows outside their declared range."""
    return _union(
        [
            _counts_per_column(
                t(name, column), name, {column: ~F.col(column).between(F.lit(low).cast("int"), F.lit(high).cast("int"))}
            )
            for name, column, low, high in ranges
            if name in t
        ]
    )


def check_fits(
    t: Tables,
    lengths: Mapping[str, Mapping[str, int]] = LENGTHS,
    decimals: Mapping[str, Mapping[str, tuple[int, int]]] = DECIMALS,
) -> DataFrame:
    """Texts longer, and numbers wider or finer, than declared; one pass per table."""
    out = []
    for name in dict.fromkeys([*lengths, *decimals]):
        if name not in t:
            continue
        have = set(t.columns(name))
        bad = {c: F.length(c) > n for c, n in lengths.get(name, {}).items() if c in have}
        for c, (p, s) in decimals.get(name, {}).items():
            if c not in have:
                continue
            kept = F.col(c).try_cast(DecimalType(p, s))
            bad[c] = F.col(c).isNotNull() & (kept.isNull() | (kept != F.col(c)))
        out.append(_counts_per_column(t(name, *bad), name, bad))
    return _union(out)
