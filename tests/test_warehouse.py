from __future__ import annotations

from pyspark.sql import functions as F
from shop import TODAY, shop

from stocklens.plans.warehouse import build_star, register_all_views, update_star
from stocklens.sources.schemas import STAR


def test_build_star_writes_every_declared_table(spark, tmp_path):
    t = shop(spark)
    s = build_star(t, str(tmp_path), as_of=TODAY, regions={"S": "South"})
    assert set(s) == set(STAR)
    for name, schema in STAR.items():
        missing = set(schema.names) - set(s[name].columns)
        assert not missing, (name, missing)
    assert s["fact_sales"].count() == 8 and s["fact_stockouts"].count() == 3
    # Every date key of a fact is in the calendar.
    for fact, key in [("fact_sales", "date_key"), ("fact_purchases", "delivery_date_key"), ("fact_stockouts", "end_date_key")]:
        keys = s[fact].filter(f"{key} is not null").select(s[fact][key].alias("date_key"))
        assert keys.join(s["dim_date"], "date_key", "left_anti").count() == 0
    register_all_views(t, s)
    assert spark.table("vw_sales_dashboard").count() == 8
    assert spark.table("v_inventory_status").count() == 6
    regions = {r.region for r in spark.table("vw_inventory_health").select("region").collect()}
    assert regions == {"South", None}
    # A second run leaves the same rows.
    again = build_star(t, str(tmp_path), as_of=TODAY, regions={"S": "South"})
    assert again["fact_sales"].count() == 8 and again["agg_abc_classification"].count() == 5


def test_update_star_keeps_closed_versions_and_old_months(spark, tmp_path):
    t = shop(spark)
    before = build_star(t, str(tmp_path), as_of=TODAY)
    old_keys = {r.sales_fact_key: r.product_key for r in before["fact_sales"].collect()}
    first = {r.product_id: r.product_key for r in before["dim_product"].collect()}
    changed = t("products").withColumn("lead_time_days", F.when(F.col("product_id") == 0, 99).otherwise(F.col("lead_time_days")))
    since = TODAY.replace(day=1)
    for _ in range(2):  # loading the same change again alters nothing
        after = update_star(t.replaced(products=changed), str(tmp_path), since, as_of=TODAY)
        versions = after["dim_product"].filter("product_id = 0").orderBy("effective_date").collect()
        assert [(v.lead_time_days, v.is_current) for v in versions] == [(4, False), (99, True)]
        assert versions[0].expiration_date == versions[1].effective_date == TODAY
        assert after["dim_product"].filter("product_id = 1").count() == 1
        rows = after["fact_sales"].collect()
        assert len(rows) == len(old_keys)
        day = int(TODAY.strftime("%Y%m%d"))
        for r in rows:
            if r.date_key < day:
                assert r.product_key == old_keys[r.sales_fact_key]
            elif old_keys[r.sales_fact_key] == first[0]:
                assert r.product_key == versions[1].product_key
