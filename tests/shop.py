"""A hand-made shop of a few rows that exercises the paths generated data does not reach."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import SparkSession

from stocklens.sources.schemas import OPERATIONAL
from stocklens.sources.tables import Tables

TODAY = dt.date(2025, 6, 30)


def day(back: int) -> dt.date:
    return TODAY - dt.timedelta(days=back)


def frame(spark: SparkSession, name: str, rows: list[dict]):
    schema = OPERATIONAL[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


WAREHOUSES = [
    dict(warehouse_id=0, warehouse_code="W0", warehouse_name="Zero", city="A", state="S", capacity_units=1, is_active=True),
    dict(warehouse_id=1, warehouse_code="W1", warehouse_name="One", city="B", state="T", capacity_units=1, is_active=True),
]
CATEGORIES = [dict(category_id=1, category_name="Tools"), dict(category_id=2, category_name="Toys", parent_category_id=1.0)]


def product(i: int, cost: str, category: int | None = 1, lead: int = 4) -> dict:
    return dict(
        product_id=i, sku=f"SKU-{i}", product_name=f"Product {i}", category_id=category, unit_cost=D(cost),
        unit_price=D(cost) * 2, lead_time_days=lead, safety_stock_days=2, min_order_quantity=1, is_active=True,
    )


PRODUCTS = [
    product(0, "10.00"),
    product(1, "5.00"),
    product(2, "5.00", category=2),
    product(3, "1.00", category=None),
    product(4, "2.00"),  # only ever ordered in a cancelled order
    product(5, "0.00"),
]
SUPPLIERS = [
    dict(supplier_id=0, supplier_code="S0", supplier_name="Always", quality_rating=D("4.00"), is_active=True),
    dict(supplier_id=1, supplier_code="S1", supplier_name="Once", quality_rating=D("3.00"), is_active=False),
    dict(supplier_id=2, supplier_code="S2", supplier_name="Never", quality_rating=D("5.50"), is_active=True),
    dict(supplier_id=3, supplier_code="S3", supplier_name="Wild", quality_rating=D("1.00"), is_active=True),
]
MAPPING = [
    dict(product_supplier_id=n, product_id=p, supplier_id=s, unit_cost=D("1.00"), lead_time_days=5)
    for n, (p, s) in enumerate([(0, 0), (1, 0), (1, 1), (2, 3)])
]


def sale(i: int, back: int, status: str = "Delivered", warehouse: int = 0) -> dict:
    return dict(
        so_id=i, so_number=f"SO-{i}", customer_id=1, warehouse_id=warehouse, order_date=day(back),
        requested_delivery_date=day(back - 5), actual_ship_date=day(back - 2), status=status, total_amount=D("0.00"),
    )


def line(i: int, order: int, product_id: int, ordered: int, shipped: int, price: str, discount: str = "0") -> dict:
    return dict(
        so_item_id=i, so_id=order, product_id=product_id, quantity_ordered=ordered, quantity_shipped=shipped,
        unit_price=D(price), discount_percent=D(discount),
    )


SALES = [
    sale(1, 0),
    sale(2, 3),
    sale(3, 10, warehouse=1),
    sale(4, 20, status="Cancelled"),
    sale(5, 400),
    sale(6, 5, status="Pending"),
]
LINES = [
    line(11, 1, 0, 10, 10, "20.00"),
    line(12, 1, 1, 4, 2, "10.00"),
    line(21, 2, 0, 4, 4, "20.00", "50"),
    line(22, 2, 2, 4, 4, "10.00"),  # the same net revenue as product 1
    line(31, 3, 3, 1, 1, "2.00", "100"),  # net zero
    line(41, 4, 4, 9, 0, "4.00"),
    line(51, 5, 0, 100, 100, "20.00"),
    line(61, 6, 0, 2, 0, "20.00"),
]


def purchase(i: int, supplier: int, back: int, expected: int, actual: int | None) -> dict:
    """Ordered ``back`` days ago, expected and delivered so many days after the order."""
    return dict(
        po_id=i, po_number=f"PO-{i}", supplier_id=supplier, warehouse_id=0, order_date=day(back),
        expected_delivery_date=day(back - expected), actual_delivery_date=None if actual is None else day(back - actual),
        status="Shipped" if actual is None else "Delivered", total_amount=D("100.00"),
    )


PURCHASES = [
    purchase(1, 0, 100, 10, 10),
    purchase(2, 0, 90, 10, 10),
    purchase(3, 0, 80, 10, 9),
    purchase(4, 0, 5, 10, None),
    purchase(5, 1, 60, 7, 9),
    purchase(6, 3, 200, 5, 1),
    purchase(7, 3, 150, 5, 30),
    purchase(8, 3, 120, 5, 5),
]


def po_line(i: int, po: int, product_id: int, ordered: int, received: int) -> dict:
    return dict(
        po_item_id=i, po_id=po, product_id=product_id, quantity_ordered=ordered, quantity_received=received,
        unit_cost=D("2.50"),
    )


PO_LINES = [
    po_line(1, 1, 0, 10, 10),
    po_line(2, 2, 0, 10, 10),
    po_line(3, 3, 0, 10, 10),
    po_line(4, 4, 0, 10, 0),
    po_line(5, 5, 1, 10, 9),
    po_line(6, 6, 2, 10, 5),
    po_line(7, 7, 2, 10, 5),
    po_line(8, 8, 2, 10, 5),
    po_line(9, 8, 0, 10, 10),  # supplier 3 is not mapped to product 0
]


def stock(i: int, warehouse: int, product_id: int, on_hand: int, reserved: int, rop: int | None) -> dict:
    return dict(
        inventory_id=i, warehouse_id=warehouse, product_id=product_id, quantity_on_hand=on_hand,
        quantity_reserved=reserved, reorder_point=rop, reorder_quantity=10,
    )


STOCK = [
    stock(1, 0, 0, 100, 0, 10),
    stock(2, 0, 1, 10, 10, 5),  # nothing available
    stock(3, 0, 2, 6, 1, 5),  # exactly at the reorder point
    stock(4, 1, 3, 7, 0, 5),  # below one and a half reorder points
    stock(5, 1, 4, 9, 0, None),  # no reorder point
    stock(6, 1, 0, 0, 0, 3),
]
STOCKOUTS = [
    dict(stockout_id=1, warehouse_id=0, product_id=0, stockout_start_date=dt.datetime(2025, 6, 1),
         stockout_end_date=dt.datetime(2025, 6, 2, 23), demand_during_stockout=5, lost_sales_amount=D("100.00"),
         root_cause="Demand spike"),
    dict(stockout_id=2, warehouse_id=0, product_id=0, stockout_start_date=dt.datetime(2025, 6, 28),
         stockout_end_date=None, demand_during_stockout=1, lost_sales_amount=None, root_cause=None),
    dict(stockout_id=3, warehouse_id=1, product_id=1, stockout_start_date=dt.datetime(2024, 1, 7),
         stockout_end_date=None, demand_during_stockout=2, lost_sales_amount=D("50.00"), root_cause="Demand spike"),
]
FORECASTS = [
    dict(forecast_id=n, product_id=p, warehouse_id=0, forecast_date=day(back), forecast_period=kind,
         forecasted_quantity=q, model_used="ARIMA")
    for n, (p, back, q, kind) in enumerate([(0, 0, 11, "Daily"), (0, 1, 3, "Daily"), (0, 2, 9, "Weekly"), (4, 20, 5, "Daily")])
]
CUSTOMERS = [dict(customer_id=1, customer_code="C1", customer_name="Cy", customer_type="Retail", city="A", state="S")]

ROWS = {
    "warehouses": WAREHOUSES,
    "product_categories": CATEGORIES,
    "products": PRODUCTS,
    "suppliers": SUPPLIERS,
    "product_suppliers": MAPPING,
    "customers": CUSTOMERS,
    "sales_orders": SALES,
    "sales_order_items": LINES,
    "purchase_orders": PURCHASES,
    "purchase_order_items": PO_LINES,
    "inventory": STOCK,
    "stockout_events": STOCKOUTS,
    "demand_forecasts": FORECASTS,
}


def shop(spark: SparkSession, **changed: list[dict]) -> Tables:
    return Tables.of(**{n: frame(spark, n, changed.get(n, rows)) for n, rows in ROWS.items()})


def by(df, *keys: str) -> dict:
    """Rows of a result by key."""
    rows = [r.asDict() for r in df.collect()]
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}
