"""The domain tables seen through a generic order book.

Maps an ``orders / lineitem / part / supplier / customer / nation / region / events`` set
of Parquet tables onto the domain schema, so that the operators can run on it. Only
row-wise integer arithmetic is used: a value depends on its own row and on the latest order
date. A table is built from the columns asked for, so a join (say, customer for the
warehouse of an order) is only paid by operators that need it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.sources.schemas import RAW
from stocklens.sources.tables import Source, Tables, estimate_rows_not_files

# Fixed values of the data model.
ROOT_CAUSES = [
    "Supplier delay", "Demand spike", "Forecast error",
    "Quality issue", "Transportation delay", "System error",
]
MODELS = ["ARIMA", "Prophet", "LightGBM", "Exponential_Smoothing"]
#: A third of the forecasts is for the day of a sale, the others for the same weekday a year on.
YEAR_ON = 364

Columns = dict[str, Callable[[], Column]]


def _cents(c: str) -> Column:
    """Cents of a two-decimal DOUBLE."""
    return F.rint(F.col(c) * 100).cast("bigint")


def _amount(cents: Column, kind: str = "decimal(12,2)") -> Column:
    return (cents.cast("decimal(15,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(kind)


def _idiv(a: Column, b: Column | int) -> Column:
    """Integer quotient of non-negative integers, without going through DOUBLE."""
    b = F.lit(b).cast("bigint") if isinstance(b, int) else b
    return F.call_function("div", a.cast("bigint"), b)


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _key_text(*columns: str) -> Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in columns])


def _line_id() -> Column:
    """The line's own columns: order and line number alone are not unique."""
    numbers = _key_text("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return F.concat_ws("-", numbers, _quantity().cast("string"), _cents("l_extendedprice").cast("string"))


def _category_id() -> Column:
    """60 bits of the type's MD5, so that products need no join to get their category."""
    return F.conv(F.substring(F.md5("p_type"), 1, 15), 16, 10).cast("bigint")


def _unit_cost() -> Column:
    return _amount(_idiv(_cents("p_retailprice") * 6, 10))


def _quantity() -> Column:
    return F.col("l_quantity").cast("bigint")


def _price_cents() -> Column:
    return _idiv(2 * _cents("l_extendedprice") + _quantity(), 2 * _quantity())


def _discount() -> Column:
    return F.rint(F.col("l_discount") * 100).cast("bigint")


def _line_total() -> Column:
    """Quantity x price less discount, rounded half-up, all in integers."""
    hundredths = _quantity() * _price_cents() * (100 - _discount())
    return _amount(_idiv(hundredths + 50, 100), "decimal(14,2)")


def _order_status() -> Column:
    pending = F.col("o_orderstatus") == "P"
    return (
        F.when(pending & (F.col("o_orderpriority") == "4-NOT SPECIFIED"), "Cancelled")
        .when(pending, "Pending")
        .when(F.col("o_orderstatus") == "O", "Shipped")
        .otherwise("Delivered")
    )


def _order_day() -> Column:
    return F.col("o_orderdate").cast("date")


class OrderBook:
    def __init__(self, spark: SparkSession, folder: str):
        estimate_rows_not_files(spark)
        self._spark = spark
        self._folder = folder
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A raw table; its schema is declared, so reading it starts no inference job."""
        if name not in self._raw:
            self._raw[name] = self._spark.read.schema(RAW[name]).parquet(f"{self._folder}/{name}.parquet")
        return self._raw[name]

    def tables(self) -> Tables:
        names = [
            "warehouses", "product_categories", "products", "suppliers", "product_suppliers",
            "customers", "sales_orders", "sales_order_items", "purchase_orders",
            "purchase_order_items", "inventory", "stockout_events", "demand_forecasts",
        ]
        return Tables({n: getattr(self, f"_{n}")() for n in names})

    def last_order_date(self) -> Column:
        return self.raw("orders").agg(F.max(_order_day())).scalar()

    def _next_key(self, name: str, key: str) -> Column:
        """One more than the largest key of a table; keys begin at zero."""
        return self.raw(name).agg(F.max(key) + 1).scalar()

    @staticmethod
    def _source(base: Callable[[set[str]], DataFrame], columns: Columns) -> Source:
        def load(wanted: Sequence[str]) -> DataFrame:
            return base(set(wanted)).select(*[columns[c]().alias(c) for c in wanted])

        return Source(tuple(columns), load)

    # ---- dimensions -------------------------------------------------------------------

    def _warehouses(self) -> Source:
        key = lambda: F.col("r_regionkey")
        return self._source(
            lambda _: self.raw("region"),
            {
                "warehouse_id": lambda: key().cast("bigint"),
                "warehouse_code": lambda: F.concat(F.lit("WH00"), (key() + 1).cast("string")),
                "warehouse_name": lambda: F.col("r_name"),
                "city": lambda: F.col("r_name"),
                "state": lambda: F.col("r_name"),
                "latitude": lambda: (key() * 10).cast("decimal(10,6)"),
                "longitude": lambda: (key() * -15).cast("decimal(10,6)"),
                "capacity_units": lambda: 50000 + key() * 1000,
                "operating_cost_per_unit": lambda: F.lit("2.50").cast("decimal(10,2)"),
                "is_active": lambda: F.lit(True),
            },
        )

    def _product_categories(self) -> Source:
        return self._source(
            lambda _: self.raw("part").select("p_type").distinct(),
            {
                "category_id": _category_id,
                "category_name": lambda: F.col("p_type"),
                "parent_category_id": lambda: F.lit(None).cast("bigint"),
            },
        )

    def _products(self) -> Source:
        key = lambda: F.col("p_partkey")
        return self._source(
            lambda _: self.raw("part"),
            {
                "product_id": key,
                "sku": lambda: F.format_string("SKU-%06d", key()),
                "product_name": lambda: F.col("p_name"),
                "category_id": _category_id,
                "unit_cost": _unit_cost,
                "unit_price": lambda: _amount(_cents("p_retailprice")),
                "lead_time_days": lambda: 3 + F.col("p_size") % 19,
                "safety_stock_days": lambda: (2 + key() % 6).cast("int"),
                "min_order_quantity": lambda: F.lit(1),
                "is_perishable": lambda: F.col("p_size") % 5 == 0,
                "is_active": lambda: key() % 50 != 49,
            },
        )

    def _suppliers(self) -> Source:
        key = lambda: F.col("s_suppkey")

        def base(wanted: set[str]) -> DataFrame:
            df = self.raw("supplier")
            if wanted & {"state", "country"}:
                df = df.join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            return df

        return self._source(
            base,
            {
                "supplier_id": key,
                "supplier_code": lambda: F.format_string("SUP-%03d", key()),
                "supplier_name": lambda: F.col("s_name"),
                "city": lambda: F.concat(F.lit("City "), (key() % 40).cast("string")),
                "state": lambda: F.col("n_name"),
                "country": lambda: F.col("n_name"),
                "payment_terms_days": lambda: (15 * (1 + key() % 4)).cast("int"),
                "is_preferred": lambda: F.col("s_acctbal") > 5000,
                "quality_rating": lambda: _amount(300 + (key() % 21) * 10, "decimal(3,2)"),
                "is_active": lambda: key() % 25 != 7,
            },
        )

    def _customers(self) -> Source:
        key = lambda: F.col("c_custkey")

        def base(wanted: set[str]) -> DataFrame:
            df = self.raw("customer")
            if "state" in wanted:
                df = df.join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            return df

        return self._source(
            base,
            {
                "customer_id": key,
                "customer_code": lambda: F.format_string("CUST-%04d", key()),
                "customer_name": lambda: F.col("c_name"),
                "customer_type": lambda: F.col("c_mktsegment"),
                "city": lambda: F.concat(F.lit("City "), (key() % 100).cast("string")),
                "state": lambda: F.col("n_name"),
                "country": lambda: F.lit("USA"),
                "credit_limit": lambda: _amount(_cents("c_acctbal")),
                "is_active": lambda: F.lit(True),
            },
        )

    def _product_suppliers(self) -> Source:
        def base(wanted: set[str]) -> DataFrame:
            pairs = self.raw("lineitem").select("l_partkey", "l_suppkey").distinct()
            df = pairs
            if "is_primary_supplier" in wanted:
                first = pairs.groupBy("l_partkey").agg(F.min("l_suppkey").alias("first_supplier"))
                df = df.join(first, "l_partkey")
            if "unit_cost" in wanted:
                df = df.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            return df

        return self._source(
            base,
            {
                "product_id": lambda: F.col("l_partkey"),
                "supplier_id": lambda: F.col("l_suppkey"),
                "unit_cost": _unit_cost,
                "min_order_quantity": lambda: F.lit(1),
                "lead_time_days": lambda: (3 + (F.col("l_partkey") + F.col("l_suppkey")) % 20).cast("int"),
                "is_primary_supplier": lambda: F.col("l_suppkey") == F.col("first_supplier"),
            },
        )

    # ---- sales ------------------------------------------------------------------------

    def _with_warehouse(self, orders: DataFrame) -> DataFrame:
        """An order ships from the region of its customer's nation."""
        home = (
            self.raw("customer")
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", F.col("n_regionkey").cast("bigint").alias("warehouse_id"))
        )
        return orders.join(home, F.col("o_custkey") == F.col("c_custkey"))

    def _sales_orders(self) -> Source:
        key = lambda: F.col("o_orderkey")

        def base(wanted: set[str]) -> DataFrame:
            df = self.raw("orders")
            return self._with_warehouse(df) if "warehouse_id" in wanted else df

        return self._source(
            base,
            {
                "so_id": key,
                "so_number": lambda: F.format_string("SO-%d-%06d", F.year(_order_day()), key()),
                "customer_id": lambda: F.col("o_custkey"),
                "warehouse_id": lambda: F.col("warehouse_id"),
                "order_date": _order_day,
                "requested_delivery_date": lambda: F.date_add(_order_day(), (3 + key() % 12).cast("int")),
                "actual_ship_date": lambda: F.when(
                    F.col("o_orderstatus").isin("O", "F"), F.date_add(_order_day(), (1 + (key() * 7) % 9).cast("int"))
                ),
                "status": _order_status,
                "total_amount": lambda: _amount(_cents("o_totalprice"), "decimal(14,2)"),
                "shipping_cost": lambda: (10 + key() % 91).cast("decimal(10,2)"),
            },
        )

    def _sales_order_items(self) -> Source:
        short = lambda: (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")
        return self._source(
            lambda _: self.raw("lineitem"),
            {
                "so_item_id": _line_id,
                "so_id": lambda: F.col("l_orderkey"),
                "product_id": lambda: F.col("l_partkey"),
                "line_number": lambda: F.col("l_linenumber"),
                "quantity_ordered": _quantity,
                "quantity_shipped": lambda: F.when(short(), _idiv(_quantity() * 9, 10)).otherwise(_quantity()),
                "unit_price": lambda: _amount(_price_cents()),
                "discount_percent": lambda: _discount().cast("decimal(5,2)"),
                "line_total": _line_total,
            },
        )

    # ---- purchasing -------------------------------------------------------------------

    def _po_id(self) -> Column:
        """Order and supplier in one integer; it overflows, loudly, only beyond 9 x 10^18."""
        return F.col("l_orderkey") * self._next_key("supplier", "s_suppkey") + F.col("l_suppkey")

    def _expected(self) -> Column:
        return F.date_add(_order_day(), (7 + F.col("l_suppkey") % 14).cast("int"))

    def _actual(self) -> Column:
        """Delivery date; NULL while after the last order date."""
        supp, order = F.col("l_suppkey"), F.col("l_orderkey")
        late = (order % 100) < (supp % 10) * 4
        moved = F.date_add(self._expected(), F.when(late, 1 + order % 7).otherwise(-(order % 3)).cast("int"))
        return F.when(moved <= self.last_order_date(), moved)

    def _purchase_orders(self) -> Source:
        """One purchase order per sales order and supplier of its lines."""

        def base(wanted: set[str]) -> DataFrame:
            lines, dated = self.raw("lineitem"), {"order_date", "expected_delivery_date", "actual_delivery_date", "status", "warehouse_id"}
            # Lines that are to meet their orders move to them once, and are folded there.
            moved = (lambda df: df.repartition("l_orderkey")) if wanted & dated else (lambda df: df)
            if "total_amount" in wanted:
                cents = _quantity() * _idiv(_cents("p_retailprice") * 6, 10)
                priced = lines.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
                heads = (
                    moved(priced.select("l_orderkey", "l_suppkey", cents.alias("cents")))
                    .groupBy("l_orderkey", "l_suppkey")
                    .agg(F.sum("cents").alias("cents"))
                )
            else:
                heads = moved(lines.select("l_orderkey", "l_suppkey")).distinct()
            if not wanted & dated:
                return heads
            orders = self.raw("orders")
            if "warehouse_id" in wanted:
                orders = self._with_warehouse(orders)
            df = heads.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            return df.withColumn("actual", self._actual()) if wanted & {"actual_delivery_date", "status"} else df

        return self._source(
            base,
            {
                "po_id": self._po_id,
                "po_number": lambda: F.concat(F.lit("PO-"), _key_text("l_orderkey", "l_suppkey")),
                "supplier_id": lambda: F.col("l_suppkey"),
                "warehouse_id": lambda: F.col("warehouse_id"),
                "order_date": _order_day,
                "expected_delivery_date": self._expected,
                "actual_delivery_date": lambda: F.col("actual"),
                "status": lambda: F.when(F.col("actual").isNull(), "Shipped").otherwise("Delivered"),
                "total_amount": lambda: _amount(F.col("cents"), "decimal(14,2)"),
            },
        )

    def _purchase_order_items(self) -> Source:
        def received() -> Column:
            arrived = _quantity() - _idiv(_quantity() * ((F.col("l_suppkey") % 4) * 3), 100)
            return F.when(self._actual().isNotNull(), arrived).otherwise(F.lit(0).cast("bigint"))

        def base(wanted: set[str]) -> DataFrame:
            # Lines meet their products last, so that they lie by product for who joins more to it; what
            # arrived moves with them, and not their order's day.
            df = self.raw("lineitem")
            if "quantity_received" in wanted:
                df = df.join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
                df = df.withColumn("received", received())
            if wanted & {"unit_cost", "line_total"}:
                df = df.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            return df

        return self._source(
            base,
            {
                "po_item_id": _line_id,
                "po_id": self._po_id,
                "product_id": lambda: F.col("l_partkey"),
                "line_number": lambda: F.col("l_linenumber"),
                "quantity_ordered": _quantity,
                "quantity_received": lambda: F.col("received"),
                "unit_cost": _unit_cost,
                "line_total": lambda: _amount(_quantity() * _idiv(_cents("p_retailprice") * 6, 10), "decimal(14,2)"),
            },
        )

    # ---- stock, forecasts, stockouts --------------------------------------------------

    def _inventory(self) -> Source:
        """Every product at every warehouse: the grain is product x warehouse."""
        part, site = lambda: F.col("p_partkey"), lambda: F.col("warehouse_id")

        def base(_wanted: set[str]) -> DataFrame:
            # Regions number from zero, so the sites need no gathering.
            sites = F.sequence(F.lit(0).cast("bigint"), self._next_key("region", "r_regionkey") - 1)
            lead = 3 + F.col("p_size") % 19
            return (
                self.raw("part")
                .select("p_partkey", "p_size", F.explode(sites).alias("warehouse_id"))
                .withColumn("rop", _idiv(F.col("p_size") * (lead + 2 + part() % 6), 5))
                .withColumn("on_hand", _idiv(F.col("rop") * (40 + (part() * 37 + site() * 101) % 261), 100))
                .withColumn("reserved", _idiv(F.col("on_hand") * ((part() * 13 + site() * 29) % 31), 100))
            )

        return self._source(
            base,
            {
                "inventory_id": lambda: part() * 1000 + site(),
                "warehouse_id": site,
                "product_id": part,
                "quantity_on_hand": lambda: F.col("on_hand"),
                "quantity_reserved": lambda: F.col("reserved"),
                "quantity_available": lambda: F.col("on_hand") - F.col("reserved"),
                "reorder_point": lambda: F.col("rop"),
                "reorder_quantity": lambda: (F.col("p_size") * 6).cast("bigint"),
            },
        )

    def _stockout_events(self) -> Source:
        key = lambda: F.col("event_id")
        hours = lambda: (24 * (1 + key() % 7) + key() % 24).cast("int")
        return self._source(
            lambda _: self.raw("events").filter(F.col("event_type") == "error"),
            {
                "stockout_id": key,
                "warehouse_id": lambda: F.col("user_id") % self._next_key("region", "r_regionkey"),
                "product_id": lambda: key() % self._next_key("part", "p_partkey"),
                "stockout_start_date": lambda: F.col("ts"),
                "stockout_end_date": lambda: F.when(key() % 11 != 0, F.timestamp_add("HOUR", hours(), F.col("ts"))),
                "demand_during_stockout": lambda: F.floor("value").cast("bigint"),
                "lost_sales_amount": lambda: _amount(_cents("value") * 10, "decimal(14,2)"),
                "root_cause": lambda: _pick(ROOT_CAUSES, key() % 6),
            },
        )

    def _demand_forecasts(self) -> Source:
        """Daily forecasts: some for days with a sale of the product at the site, most without.

        The quantity depends on product, site and day, not on what was sold.
        """
        part, site, day = (lambda c=c: F.col(c) for c in ("product_id", "warehouse_id", "forecast_date"))

        def base(_wanted: set[str]) -> DataFrame:
            later = F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(YEAR_ON)
            orders = self._with_warehouse(self.raw("orders")).select(
                "o_orderkey", "warehouse_id", F.date_add(_order_day(), later).alias("forecast_date")
            )
            lines = self.raw("lineitem").select("l_orderkey", F.col("l_partkey").alias("product_id"))
            return (
                lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
                .select("product_id", "warehouse_id", "forecast_date")
                .distinct()
            )

        return self._source(
            base,
            {
                "product_id": part,
                "warehouse_id": site,
                "forecast_date": day,
                "forecast_period": lambda: F.lit("Daily"),
                "forecasted_quantity": lambda: 1 + (part() * 7 + site() * 11 + F.dayofmonth(day())) % 50,
                "model_used": lambda: _pick(MODELS, part() % 4),
            },
        )
