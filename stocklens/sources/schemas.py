"""Typed schemas of the operational and star tables.

The operational schemas list columns in file order: an explicit CSV schema binds by
position. Types are fixed values of the data model.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

_SIMPLE = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _type(text: str) -> T.DataType:
    decimal = re.fullmatch(r"decimal\((\d+),(\d+)\)", text)
    return T.DecimalType(int(decimal[1]), int(decimal[2])) if decimal else _SIMPLE[text]


def _ddl(text: str) -> T.StructType:
    """``name type`` pairs; built by hand because parsing DDL needs a running session."""
    pairs = re.findall(r"(\w+) ([a-z_]+(?:\(\d+,\d+\))?)(?:,|$)", " ".join(text.split()))
    return T.StructType([T.StructField(name, _type(kind)) for name, kind in pairs])


OPERATIONAL: dict[str, T.StructType] = {
    "warehouses": _ddl(
        """warehouse_code string, warehouse_name string, city string, state string,
        latitude decimal(10,8), longitude decimal(11,8), warehouse_id int, capacity_units int,
        operating_cost_per_unit decimal(10,2), is_active boolean"""
    ),
    "product_categories": _ddl("category_id int, category_name string, parent_category_id double"),
    "products": _ddl(
        """product_id int, sku string, product_name string, category_id int,
        unit_cost decimal(12,2), unit_price decimal(12,2), weight_kg decimal(8,3),
        volume_cubic_m decimal(8,4), lead_time_days int, safety_stock_days int,
        min_order_quantity int, is_perishable boolean, is_active boolean"""
    ),
    "suppliers": _ddl(
        """supplier_id int, supplier_code string, supplier_name string, contact_name string,
        email string, phone string, city string, state string, country string,
        payment_terms_days int, is_preferred boolean, quality_rating decimal(3,2),
        is_active boolean"""
    ),
    "product_suppliers": _ddl(
        """product_supplier_id int, product_id int, supplier_id int, supplier_sku string,
        unit_cost decimal(12,2), min_order_quantity int, lead_time_days int,
        is_primary_supplier boolean"""
    ),
    "customers": _ddl(
        """customer_id int, customer_code string, customer_name string, customer_type string,
        email string, phone string, city string, state string, zip_code string, country string,
        latitude double, longitude double, credit_limit decimal(12,2), is_active boolean"""
    ),
    "purchase_orders": _ddl(
        """po_id int, po_number string, supplier_id int, warehouse_id int, order_date date,
        expected_delivery_date date, actual_delivery_date date, status string,
        total_amount decimal(14,2)"""
    ),
    "purchase_order_items": _ddl(
        """po_item_id int, po_id int, product_id int, quantity_ordered int,
        quantity_received int, unit_cost decimal(12,2)"""
    ),
    "sales_orders": _ddl(
        """so_id int, so_number string, customer_id int, warehouse_id int, order_date date,
        requested_delivery_date date, actual_ship_date date, status string,
        total_amount decimal(14,2), shipping_cost decimal(10,2)"""
    ),
    "sales_order_items": _ddl(
        """so_item_id int, so_id int, product_id int, quantity_ordered int,
        quantity_shipped int, unit_price decimal(12,2), discount_percent decimal(5,2)"""
    ),
    "inventory": _ddl(
        """inventory_id int, warehouse_id int, product_id int, quantity_on_hand int,
        quantity_reserved int, reorder_point int, reorder_quantity int,
        last_received_date date, last_sold_date date"""
    ),
    "inventory_transactions": _ddl(
        """transaction_id int, warehouse_id int, product_id int, transaction_type string,
        quantity int, reference_type string, reference_id int, unit_cost decimal(12,2),
        transaction_date timestamp_ntz"""
    ),
    "demand_forecasts": _ddl(
        """forecast_id int, product_id int, warehouse_id int, forecast_date date,
        forecast_period string, forecasted_quantity int, confidence_lower int,
        confidence_upper int, model_used string"""
    ),
    "stockout_events": _ddl(
        """stockout_id int, warehouse_id int, product_id int,
        stockout_start_date timestamp_ntz, stockout_end_date timestamp_ntz,
        demand_during_stockout int, lost_sales_amount decimal(14,2), root_cause string"""
    ),
}

STAR: dict[str, T.StructType] = {
    "dim_date": _ddl(
        """date_key int, full_date date, day_of_week int, day_name string, day_of_month int,
        day_of_year int, week_of_year int, month_num int, month_name string, quarter int,
        year int, is_weekend boolean, is_holiday boolean, fiscal_quarter int, fiscal_year int"""
    ),
    "dim_product": _ddl(
        """product_key bigint, product_id bigint, sku string, product_name string,
        category_id bigint, category_name string, unit_cost decimal(12,2),
        unit_price decimal(12,2), profit_margin decimal(14,2), abc_class string,
        lead_time_days int, reorder_point int, safety_stock int, is_active boolean,
        effective_date date, expiration_date date, is_current boolean"""
    ),
    "dim_supplier": _ddl(
        """supplier_key bigint, supplier_id bigint, supplier_code string, supplier_name string,
        city string, state string, country string, payment_terms_days int,
        quality_rating decimal(3,2), reliability_score decimal(9,2), reliability_tier string,
        is_preferred boolean, is_active boolean, effective_date date, expiration_date date,
        is_current boolean"""
    ),
    "dim_warehouse": _ddl(
        """warehouse_key bigint, warehouse_id bigint, warehouse_code string,
        warehouse_name string, city string, state string, region string,
        latitude decimal(10,6), longitude decimal(10,6), capacity_units int,
        operating_cost_per_unit decimal(10,2), is_active boolean"""
    ),
    "dim_customer": _ddl(
        """customer_key bigint, customer_id bigint, customer_code string, customer_name string,
        customer_type string, city string, state string, country string,
        credit_limit decimal(12,2), is_active boolean, effective_date date,
        expiration_date date, is_current boolean"""
    ),
    "fact_sales": _ddl(
        """sales_fact_key string, date_key int, product_key bigint, customer_key bigint,
        warehouse_key bigint, sales_order_number string, line_item_number int,
        quantity_ordered int, quantity_shipped int, unit_price decimal(12,2),
        discount_percent decimal(5,2), gross_amount decimal(18,2), discount_amount decimal(18,2),
        net_amount decimal(18,2), cost_amount decimal(18,2), profit_amount decimal(18,2),
        days_to_ship int, is_on_time boolean"""
    ),
    "fact_inventory_daily": _ddl(
        """inventory_fact_key string, date_key int, product_key bigint, warehouse_key bigint,
        quantity_on_hand int, quantity_reserved int, quantity_available int, reorder_point int,
        inventory_value decimal(24,2), days_of_supply decimal(24,2), is_below_reorder boolean,
        is_stockout boolean, is_overstock boolean"""
    ),
    "fact_purchases": _ddl(
        """purchase_fact_key string, order_date_key int, delivery_date_key int,
        product_key bigint, supplier_key bigint, warehouse_key bigint,
        purchase_order_number string, line_item_number int, quantity_ordered int,
        quantity_received int, unit_cost decimal(12,2), total_cost decimal(18,2),
        expected_lead_days int, actual_lead_days int, lead_time_variance int,
        is_on_time boolean, is_complete boolean"""
    ),
    "fact_stockouts": _ddl(
        """stockout_fact_key bigint, start_date_key int, end_date_key int, product_key bigint,
        warehouse_key bigint, duration_days int, estimated_lost_units int,
        estimated_lost_revenue decimal(14,2), root_cause string"""
    ),
    "agg_sales_monthly": _ddl(
        """year int, month int, product_key bigint, warehouse_key bigint, total_orders bigint,
        total_quantity bigint, gross_revenue decimal(24,2), net_revenue decimal(24,2),
        total_cost decimal(24,2), total_profit decimal(24,2), avg_order_value decimal(24,2)"""
    ),
    "agg_supplier_performance": _ddl(
        """year int, quarter int, supplier_key bigint, total_orders bigint,
        total_units_ordered bigint, total_units_received bigint, total_spend decimal(24,2),
        on_time_deliveries bigint, late_deliveries bigint, on_time_rate decimal(14,2),
        fill_rate decimal(14,2), avg_lead_time decimal(14,2), lead_time_std_dev decimal(14,2)"""
    ),
    "agg_abc_classification": _ddl(
        """analysis_date date, product_key bigint, total_revenue decimal(24,2),
        revenue_rank int, cumulative_revenue decimal(24,2), cumulative_pct decimal(14,2),
        abc_class string"""
    ),
}

# The raw order book the benchmark data comes in; only the columns the mapping reads.
RAW: dict[str, T.StructType] = {
    "region": _ddl("r_regionkey int, r_name string"),
    "nation": _ddl("n_nationkey int, n_name string, n_regionkey int"),
    "customer": _ddl("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    "supplier": _ddl("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    "part": _ddl("p_partkey bigint, p_name string, p_type string, p_size int, p_retailprice double"),
    "orders": _ddl(
        """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string"""
    ),
    "lineitem": _ddl(
        """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_returnflag string,
        l_linestatus string"""
    ),
    "events": _ddl("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"),
}
