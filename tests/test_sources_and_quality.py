from __future__ import annotations

import datetime as dt

import pytest
from shop import LINES, PRODUCTS, STOCK, SUPPLIERS, by, line, product, sale, shop

from stocklens.operators import quality
from stocklens.sources.schemas import OPERATIONAL, STAR
from stocklens.sources.tables import (
    insert_into,
    open_tables,
    read_rejects,
    read_table,
    register_views,
    write_extract,
)


def test_schema_catalogue():
    assert len(OPERATIONAL) == 14 and len(STAR) == 12
    assert OPERATIONAL["warehouses"].names[6] == "warehouse_id"  # file order
    assert OPERATIONAL["sales_orders"]["total_amount"].dataType.simpleString() == "decimal(14,2)"


def test_csv_tables_are_typed_and_optional(spark, tmp_path):
    (tmp_path / "product_categories.csv").write_text(
        "category_id,category_name,parent_category_id\n1,Tools,\n7,Saws,1.0\n"
    )
    (tmp_path / "stockout_events.csv").write_text(
        "stockout_id,warehouse_id,product_id,stockout_start_date,stockout_end_date,demand_during_stockout,"
        "lost_sales_amount,root_cause\n1,4,85,2024-09-08,,8,128.08,Demand spike\n"
    )
    t = open_tables(spark, str(tmp_path))
    assert t.names() == ["product_categories", "stockout_events"] and "products" not in t
    assert by(t("product_categories"), "category_id")[7]["parent_category_id"] == 1
    event = t("stockout_events").collect()[0]
    assert event.stockout_start_date == dt.datetime(2024, 9, 8) and event.stockout_end_date is None
    with pytest.raises(KeyError):
        t("products")
    with pytest.raises(KeyError):
        read_table(spark, str(tmp_path), "nonsense")


def test_generated_columns(spark):
    t = shop(spark)
    assert by(t("inventory"), "inventory_id")[3]["quantity_available"] == 5
    assert by(t("sales_order_items"), "so_item_id")[21]["line_total"] == 40


def test_write_insert_and_views(spark, tmp_path):
    t = shop(spark)
    path = write_extract(t("products"), str(tmp_path / "p"), drop=["unit_price"])
    assert "unit_price" not in spark.read.parquet(path).columns
    for _ in range(2):
        insert_into(t("warehouses", "warehouse_id", "city"), "site_log", ["city"])
    assert spark.table("site_log").count() == 4
    register_views({"v_products": t("products")})
    assert spark.sql("select count(*) from v_products").first()[0] == len(PRODUCTS)


def test_clean_tables_pass(spark):
    t = shop(spark, suppliers=SUPPLIERS[:2] + SUPPLIERS[3:])
    assert sum(r.duplicated_keys for r in quality.check_unique(t).collect()) == 0
    assert sum(r.orphan_rows for r in quality.check_references(t).collect()) == 0
    assert sum(r.violations for r in quality.check_required(t).collect()) == 0
    assert quality.check_allowed(t).collect() == []
    assert sum(r.violations for r in quality.check_ranges(t).collect()) == 0
    assert sum(r.violations for r in quality.check_fits(t).collect()) == 0


def test_violations_are_found(spark):
    t = shop(
        spark,
        products=PRODUCTS + [product(0, "1.00"), product(6, "1.00", category=99), {**product(7, "1.00"), "sku": None}],
        sales_order_items=LINES + [line(71, 999, 0, 1, 1, "1.00")] * 3,
        sales_orders=[sale(i, 1, status=s) for i, s in [(1, "Lost"), (2, "Shipped"), (3, "Lost")]],
        inventory=STOCK + STOCK[:1],
    )
    unique = by(quality.check_unique(t), "table_name", "columns")
    assert unique["products", "product_id"]["surplus_rows"] == 1
    assert unique["products", "sku"]["duplicated_keys"] == 1  # NULL does not collide
    assert unique["sales_order_items", "so_item_id"]["surplus_rows"] == 2
    assert unique["inventory", "warehouse_id,product_id"]["duplicated_keys"] == 1
    orphans = by(quality.check_references(t), "table_name", "column_name")
    assert orphans["products", "category_id"]["orphan_rows"] == 1
    assert orphans["sales_order_items", "so_id"]["orphan_rows"] == 6  # orders 4 to 6 are gone as well
    assert by(quality.check_required(t), "table_name", "column_name")["products", "sku"]["violations"] == 1
    bad = quality.check_allowed(t).collect()
    assert [(r.table_name, r.value, r.violations) for r in bad] == [("sales_orders", "Lost", 2)]
    assert quality.check_ranges(t).collect()[0].violations == 1  # rated 5.5


def test_fit_checks(spark):
    t = shop(spark, products=[{**product(0, "1.00"), "sku": "x" * 51}])
    rows = by(quality.check_fits(t), "table_name", "column_name")
    assert rows["products", "sku"]["violations"] == 1
    narrow = quality.check_fits(t, lengths={}, decimals={"products": {"unit_cost": (2, 2), "unit_price": (3, 0)}})
    assert [(r.column_name, r.violations) for r in narrow.collect()] == [("unit_cost", 1), ("unit_price", 0)]


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    (tmp_path / "product_categories.csv").write_text("category_name,parent_category_id,category_id\nTools,,7\n")
    row = read_table(spark, str(tmp_path), "product_categories").first()
    assert (row.category_id, row.category_name) == (7, "Tools")
    (tmp_path / "product_categories.csv").write_text("category_name,category_id\nTools,7\n")
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "product_categories")
    (tmp_path / "product_categories.csv").write_text("category_id,category_name,parent_category_id\nseven,Tools,\n")
    with pytest.raises(Exception, match="MALFORMED|CAST|FAILFAST"):
        read_table(spark, str(tmp_path), "product_categories").collect()


def test_rows_that_do_not_fit_are_set_aside_with_reasons(spark, tmp_path):
    (tmp_path / "products.csv").write_text(
        "product_id,sku,product_name,category_id,unit_cost,unit_price,weight_kg,volume_cubic_m,lead_time_days,"
        "safety_stock_days,min_order_quantity,is_perishable,is_active\n"
        '1,A,"Saw, small",7,1.50,3.00,,,4,2,1,True,false\n'
        "two,B,Drill,7,x,3.00,,,4,2,1,True,perhaps\n"
        "3,C,Short row,7\n"
        "4,D,Long row,7,1.50,3.00,,,4,2,1,True,True,1,2\n"
        "5,E,Too dear,7,123456789012.00,3.00,,,4,2,1,,True\n"
    )
    (tmp_path / "stockout_events.csv").write_text(
        "stockout_id,warehouse_id,product_id,stockout_start_date,stockout_end_date,demand_during_stockout,"
        "lost_sales_amount,root_cause\n1,4,85,2024-09-08,,8,128.08,\n2,4,85,8.9.24,,8,128.08,\n"
    )
    t = open_tables(spark, str(tmp_path), bad="skip")
    assert t.names() == ["products", "stockout_events"]
    (saw,) = t("products").collect()
    assert (saw.product_id, saw.product_name, saw.is_perishable, saw.is_active) == (1, "Saw, small", True, False)
    assert [r.stockout_id for r in t("stockout_events").collect()] == [1]
    bad = {(r.table_name, r.record.split(",")[0]): r.reasons for r in read_rejects(spark, str(tmp_path)).collect()}
    assert bad == {
        ("products", "two"): ["product_id: no int", "unit_cost: no decimal(12,2)", "is_active: no boolean"],
        ("products", "3"): ["not 13 values"],
        ("products", "4"): ["not 13 values"],
        ("products", "5"): ["unit_cost: no decimal(12,2)"],
        ("stockout_events", "2"): ["stockout_start_date: no timestamp_ntz"],
    }
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "products", bad="ignore")
    assert read_rejects(spark, str(tmp_path), ["suppliers"]).count() == 0
