"""The driver's star-schema tables seen as a shop.

Headers, lines and ledgers are projections of the given tables. Cost sheets and
order documents are written once per session to the shared folder, in the formats
a shop delivers them, and read back through the normal sources.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profitloom.config import NO_DISCOUNT, UNFULFILLED, UNKNOWN, ProfitConfig
from profitloom.functions.frames import grouped
from profitloom.functions.money import MONEY, cast, from_units, sum_units
from profitloom.functions.text import NBSP
from profitloom.operators.lines import (
    current_pages,
    discount_code,
    override_table,
    product_key,
    with_overrides,
)
from profitloom.sources.fees import read_card_transactions, read_wallet_ledger
from profitloom.sources.orders import read_orders
from profitloom.sources.sheets import (
    CostLookup,
    cost_lookup,
    product_costs,
    read_cost_rows,
    read_sheet,
)
from profitloom.storage import new_folder

# The override is one of this shop's data, not a default of the package.
DEFAULT_CONFIG = ProfitConfig(
    as_of=date(2000, 7, 1), discount_code_overrides={1019: "KIRA30"}
)
#: Lines of an order that one page document holds at most.
PAGE_LINES = 1000
#: Pages in a landed file at most.
FILE_PAGES = 50_000
WALLET_START, WALLET_END = date(2024, 1, 1), date(2024, 3, 31)

_URGENT = "o_orderpriority in ('1-URGENT', '2-HIGH')"

# Only the columns the shop is made of.
_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_discount double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "supplier": "s_suppkey bigint, s_name string, s_acctbal double",
    "events": "ts timestamp_ntz, event_type string, value double",
}

_CSV = {
    "header": True,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

_landed: dict[tuple[str, str, str], str] = {}
_sheets: dict[str, DataFrame] = {}
_lookups: dict[str, CostLookup] = {}


class ShopTables:
    """Shop inputs derived from the tables in one directory.

    The cost sheet lists some products twice, as hand-kept sheets do, unless
    ``clean_costs`` asks for one row per product.
    """

    def __init__(
        self,
        spark: SparkSession,
        sf_dir: str,
        cfg: ProfitConfig = DEFAULT_CONFIG,
        clean_costs: bool = False,
    ):
        self.spark, self.sf_dir, self.cfg, self.clean_costs = spark, sf_dir, cfg, clean_costs

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    # --- order headers and lines ---

    def headers(self, customer: bool = False) -> DataFrame:
        """One row per order; customer fields only when asked for, as they cost a join."""
        day, key = "cast(o_orderdate as date)", "o_orderkey"
        code = discount_code("nullif(c_mktsegment, 'HOUSEHOLD')")
        fields = [
            f"{key} as order_number",
            f"{key} + 1000000 as order_id",
            f"{day} as order_date",
            f"concat(cast({day} as string), 'T', lpad(cast({key} * 7 % 24 as string), 2, '0'), "
            f"':30:00', if(month({day}) between 4 and 10, '+02:00', '+01:00')) "
            "as order_created_at",
            "'NOK' as currency",
            "case when o_orderstatus = 'P' then 'refunded' "
            f"when {key} % 50 = 7 then 'partially_refunded' else 'paid' end as financial_status",
            f"case when o_orderstatus = 'O' or (o_orderstatus = 'P' and {key} % 2 = 1) "
            f"then '{UNFULFILLED}' else 'fulfilled' end as fulfillment_status",
            f"case when {key} % 20 = 0 then '{UNKNOWN}' when {_URGENT} "
            "then 'Vipps/MobilePay Payments' else 'shopify_payments' end as payment_method",
            f"{cast(f'if({key} % 3 <> 0, 79, 0)', MONEY)} as order_shipping",
            f"{cast(f'if({key} % 4 = 1, 50, 0)', MONEY)} as undistributed_discount",
        ]
        orders = self.table("orders")
        if not customer:
            return orders.selectExpr(*fields)
        fields += [
            "case when o_custkey % 10 = 3 then '' when o_custkey % 10 <> 4 "
            "then concat(c_name, '@example.org') end as customer_email",
            f"{code} as discount_code",
            f"if({key} % 70 = 0, '{UNKNOWN}', coalesce(n_name, '{UNKNOWN}')) as city",
        ]
        customers = self.table("customer").join(
            self.table("nation"), F.expr("c_nationkey = n_nationkey"), "left"
        )
        known = orders.join(customers, F.expr("o_custkey = c_custkey"), "left").selectExpr(*fields)
        return with_overrides(known, override_table(self.spark, self.cfg))

    def order_keys(self) -> DataFrame:
        """Order number of every line, for reports that need nothing else of it."""
        return self.table("lineitem").selectExpr("l_orderkey as order_number")

    def lines(self) -> DataFrame:
        """One row per line, amounts in units.

        ``line_pos`` orders an order's lines: line, part and supplier number side by side
        in one whole number, so that aggregates over it hash instead of sorting.
        """
        joined = self.table("lineitem").join(
            self._products(), F.expr("l_partkey = p_partkey"), "left"
        )
        place = [
            f"cast({column} as decimal(12,0)) * {10**shift}BD"
            for column, shift in (("l_linenumber", 24), ("l_partkey", 12), ("l_suppkey", 0))
        ]
        cents = "coalesce(price_cents, 0L)"
        return joined.selectExpr(
            "l_orderkey as order_number",
            f"cast({' + '.join(place)} as decimal(38,0)) as line_pos",
            "coalesce(product_key, '') as product_key",
            "coalesce(product_title, '') as product_title",
            "variant_title",
            "cast(l_quantity as int) as quantity",
            f"{cents} * 100 as price_units",
            f"{cents} * cast(l_quantity as int) * cast(rint(l_discount * 100) as bigint)"
            " as discount_units",
            "l_partkey as product_id",
            "l_suppkey as variant_id",
        )

    def _products(self) -> DataFrame:
        variant = "nullif(p_brand, if(p_partkey % 9 = 0, p_brand, ''))"
        return self.table("part").selectExpr(
            "p_partkey",
            "p_retailprice",
            "p_brand",
            "cast(cast(p_retailprice as decimal(10,2)) * 100 as bigint) as price_cents",
            "p_name as product_title",
            f"{variant} as variant_title",
            f"{product_key('p_name', variant)} as product_key",
        )

    # --- fees ---

    def card_transactions(self) -> DataFrame:
        """Balance transactions, landed as JSON."""
        path = self._land(
            "card-transactions", lambda p: self._balance().write.option("compression", "gzip").json(p)
        )
        return read_card_transactions(self.spark, path)

    def wallet_ledger(self) -> DataFrame:
        """Ledger entries, landed as JSON in one folder per day."""

        def write(path: str) -> None:
            days = self._ledger().repartition("ledger_date")
            days.write.partitionBy("ledger_date").option("compression", "gzip").json(path)

        return read_wallet_ledger(self.spark, self._land("wallet-ledger", write))

    def _balance(self) -> DataFrame:
        """Up to three balance rows per order, made without leaving the order's row."""
        price = "cast(o_totalprice as decimal(18,2))"
        card = f"not {_URGENT} and o_orderkey % 5 <> 0"

        def row(when: str, kind: str, fee: str) -> str:
            return f"if({when}, struct('{kind}' as type, cast({fee} as string) as fee), null)"

        rows = ", ".join(
            [
                row(card, "charge", cast(f"{price} * 0.02", MONEY)),
                row(f"{card} and o_orderkey % 25 = 1", "charge", "1.5"),
                row("o_orderstatus = 'P'", "refund", "9"),
            ]
        )
        return (
            self.table("orders")
            .selectExpr(
                "o_orderkey + 1000000 as source_order_id",
                f"inline(array_compact(array({rows})))",
            )
            .select("type", "source_order_id", "fee")
        )

    def _ledger(self) -> DataFrame:
        value = "cast(value as decimal(18,2))"
        capture = f"cast({value} * 100 as bigint)"
        fee = f"-cast(round({value} * 2.66, 0) as bigint)"
        entry = lambda kind, amount: f"struct('{kind}' as entryType, {amount} as amount)"
        return (
            self.table("events")
            .filter("event_type in ('purchase', 'error')")
            .selectExpr(
                "cast(ts as date) as ledger_date",
                "inline(if(event_type = 'purchase', "
                f"array({entry('capture', capture)}, {entry('capture-fee', fee)}), "
                f"array({entry('payout', capture)})))",
            )
        )

    # --- landed sheets and documents ---

    def _land(self, name: str, write) -> str:
        """Write a landed input once per session, directory and shop; return its path."""
        shop = f"{name} {self.clean_costs} {self.cfg} {PAGE_LINES}"
        key = (self.spark.conf.get("spark.app.id"), self.sf_dir, shop)
        if key not in _landed:
            path = new_folder(self.spark, name)
            write(path)
            _landed[key] = path
        return _landed[key]

    def cost_sheet(self) -> DataFrame:
        """Cost sheet text with stray white space, cells that are no number, and products
        listed again at another cost or at none."""

        def write(path: str) -> None:
            own_brand = "p_brand = 'Brand#5'"
            named = "variant_title is not null and length(product_key) % 2 = 0"
            price = f"cast(cast(max(p_retailprice) as decimal(10,2)) * 0.55 as {MONEY})"
            listed = grouped(
                self._products().filter(f"not {own_brand} or ({named})"),
                ["product_key"],
                f"if(every({own_brand}), 'mangler', cast({price} as string)) as cost",
            )
            padded = (
                "if(length(product_key) % 3 = 0, "
                f"concat('{NBSP}', product_key, ' {NBSP}'), product_key)"
            )
            again = "length(product_key) % 4"
            other = f"cast(try_cast(cost as {MONEY}) + 1.5 as string)"
            rows = (
                f"case when cost = 'mangler' then array(cost) when {again} = 1 "
                f"then array(cost, {other}) when {again} = 2 then array(cost, 'mangler') "
                "else array(cost) end"
            )
            if not self.clean_costs:
                listed = listed.selectExpr("product_key", f"explode({rows}) as cost")
            listed.selectExpr(
                f"{padded} as `Produkt navn`",
                "cost as `Innkjøpspris pr. produkt i NOK uten MVA`",
            ).write.options(**_CSV).csv(path)

        path = self._land("cost-sheet", write)
        if path not in _sheets:
            _sheets[path] = read_sheet(self.spark, path)
        return _sheets[path]

    def price_list(self) -> DataFrame:
        """Cost and current price per product key."""
        prices = grouped(
            self._products(),
            ["product_key"],
            f"{cast('cast(max(p_retailprice) as decimal(10,2))', MONEY)} as sell_price",
        )
        return prices.selectExpr("*", f"{cast('sell_price * 0.55', MONEY)} as cost_price")

    def costs(self) -> DataFrame:
        return product_costs(self.cost_sheet())

    def cost_lookup(self) -> CostLookup:
        """The cost sheet by key, measured once per landed sheet."""
        self.cost_sheet()
        key = self._land("cost-sheet", lambda path: None)
        if key not in _lookups:
            _lookups[key] = cost_lookup(self.costs())
        return _lookups[key]

    def _write_rows(self, name: str, amount: str, path: str) -> None:
        rows = self.table("supplier").selectExpr(
            f"{name} as name", f"{amount} as amount", "s_suppkey as row_pos"
        )
        rows.write.options(**_CSV, emptyValue="").csv(path)

    def fixed_sheet(self) -> DataFrame:
        """Overhead sheet: one row per supplier, in the spellings people use."""

        def write(path: str) -> None:
            comma = "translate(format_number(s_acctbal, 2), ',.', '_,')"
            name = (
                "case s_suppkey % 10 when 4 then 'Sum' when 8 then "
                "concat('Supplier#', lpad(cast(s_suppkey - 2 as string), 9, '0'), ' ') "
                "else s_name end"
            )
            amount = (
                "case when s_suppkey % 10 = 7 then '' "
                f"when s_suppkey % 10 = 3 then replace({comma}, '_', '.') "
                f"when s_suppkey % 2 = 0 then concat(replace({comma}, '_', '{NBSP}'), '{NBSP}kr') "
                f"else concat(replace({comma}, '_', ' '), ' kr') end"
            )
            self._write_rows(name, amount, path)

        return read_cost_rows(self.spark, self._land("fixed-sheet", write))

    def per_order_sheet(self) -> DataFrame:
        """Per-order sheet: fee rules, fixed amounts and rows to be left out."""

        def write(path: str) -> None:
            small = cast("cast(floor(abs(s_acctbal)) as decimal(12,0)) * 0.0001", "decimal(12,4)")
            name = (
                "case s_suppkey % 10 when 0 then 'Transaksjonsgebyr Vipps' "
                "when 5 then 'Transaksjonsgebyr kort' when 9 then 'Ca fraktkostnad' "
                "else s_name end"
            )
            amount = (
                "case s_suppkey % 10 "
                "when 0 then concat(cast(s_suppkey % 3 + 2 as string), ',5% av ordrepris') "
                "when 5 then '5% av ordrepris + 2 kr' when 3 then '25 kr' when 6 then '' "
                "when 9 then concat(cast(s_suppkey % 7 + 40 as string), ',50') "
                f"else replace(cast({small} as string), '.', ',') end"
            )
            self._write_rows(name, amount, path)

        return read_cost_rows(self.spark, self._land("per-order-sheet", write))

    def _long_orders(self, lines: DataFrame) -> DataFrame | None:
        """Numbers of orders that don't fit one page, at most one in ``PAGE_LINES`` lines; none in most shops.

        Stored, so that Spark knows its size and broadcasts a short list.
        """
        path = new_folder(self.spark, "long-orders")
        counts = grouped(lines, ["order_number"], "count(1) as n")
        listed = counts.filter(f"n > {PAGE_LINES}").select("order_number")
        listed.write.parquet(path)
        found = self.spark.read.schema(listed.schema).parquet(path)
        return None if found.isEmpty() else found

    def _numbered_lines(self, lines: DataFrame) -> DataFrame:
        """Lines with their place in the order as ``place``, 0 and up without gaps.

        Lines are ranged over tasks by order and position, so that no task has an order to
        itself; an order's parts are numbered from the lines in its earlier parts.
        """
        path = new_folder(self.spark, "numbered-lines")
        ranged = lines.repartitionByRange("order_number", "line_pos", "quantity", "discount_units")
        ranged.sortWithinPartitions("order_number", "line_pos").selectExpr(
            "*", "spark_partition_id() as part", "monotonically_increasing_id() as row"
        ).write.parquet(path)
        rows = self.spark.read.parquet(path)
        parts = grouped(rows, ["order_number", "part"], "min(row) as first_row", "count(1) as n")
        earlier = "sum(n) over (partition by order_number order by part) - n"
        starts = parts.selectExpr("order_number", "part", f"{earlier} - first_row as shift")
        numbered = rows.join(starts, ["order_number", "part"])
        return numbered.selectExpr("*", "row + shift as place").drop("part", "row", "shift")

    def _paged_orders(self, headers: DataFrame) -> DataFrame:
        """Orders with ``first_line``, ``items`` and the order's ``own_discount``, a row per page.

        Orders and their lines are each dealt once by order number, and pages are made, met by their
        order and written where they lie. Only long orders are numbered and dealt by page.
        """
        # Several files a stage, whatever the size, so that streams take several batches.
        files = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        fields = (
            "product_title as title, variant_title, quantity, "
            f"cast({from_units('price_units')} as string) as price, "
            f"cast({from_units('discount_units')} as string) as total_discount, product_id, variant_id"
        )
        bare = "x.title, x.variant_title, x.quantity, x.price, x.total_discount, x.product_id, x.variant_id"

        def items(place: str) -> str:
            return f"transform(sort_array(collect_list(struct({place}, {fields}))), x -> struct({bare})) as items"

        def discount(rows: DataFrame, *also: str) -> DataFrame:
            return grouped(rows, ["order_number"], f"{sum_units('discount_units')} as own_discount", *also)

        lines, orders = self.lines().filter("order_number is not null"), headers
        found = self._long_orders(lines)
        if found is not None:
            lines = lines.join(found, "order_number", "left_anti")
            orders = headers.join(found, "order_number", "left_anti")
        # Lines of equal or unknown position stay as they come.
        arrived = lines.selectExpr("*", "monotonically_increasing_id() as arrival")
        short = discount(arrived.repartition(files, "order_number"), items("line_pos, arrival"))
        # Pages are wide: the orders are the hashed side, so that no page is sorted.
        dealt = orders.repartition(files, "order_number").hint("shuffle_hash")
        paged = dealt.join(short.selectExpr("*", "0L as first_line"), "order_number", "left")
        if found is None:
            return paged
        numbered = self._numbered_lines(self.lines().join(found, "order_number", "left_semi"))
        first = f"place div {PAGE_LINES} * {PAGE_LINES} as first_line"
        pages = grouped(numbered, ["order_number", first], items("place"))
        known = headers.join(found, "order_number", "left_semi").join(discount(numbered), "order_number")
        long = known.join(pages, "order_number").repartition(files, "order_number", "first_line")
        return paged.unionByName(long)

    def _documents(self) -> DataFrame:
        """Order documents, every order as pages of ``PAGE_LINES`` lines."""
        plain = ShopTables(
            self.spark, self.sf_dir, replace(self.cfg, discount_code_overrides={})
        )
        headers = plain.headers(customer=True)
        known_city = f"city <> '{UNKNOWN}'"
        return self._paged_orders(headers).selectExpr(
            "order_id as id",
            "order_number",
            "order_created_at as created_at",
            "currency",
            "financial_status",
            f"nullif(fulfillment_status, '{UNFULFILLED}') as fulfillment_status",
            "customer_email as email",
            f"if(payment_method = '{UNKNOWN}', cast(array() as array<string>), "
            "array(payment_method)) as payment_gateway_names",
            f"if({known_city} and order_number % 7 <> 0, struct(city), null) as shipping_address",
            f"if({known_city} and order_number % 7 = 0, struct(city), null) as billing_address",
            f"cast({cast('coalesce(own_discount, 0) + undistributed_discount', MONEY)} as string)"
            " as total_discounts",
            f"if(discount_code <> '{NO_DISCOUNT}', array(struct(discount_code as code)), null)"
            " as discount_codes",
            "if(order_shipping > 0, array(struct(cast(order_shipping as string) as price)), null)"
            " as shipping_lines",
            "coalesce(first_line, 0L) as first_line",
            "if(items is null, filter(items, x -> false), items) as line_items",
        )

    def _land_documents(self) -> str:
        """JSON pages of orders: as they stand, and both states of the ones that changed."""

        def write(path: str) -> None:
            stages = "if(financial_status = 'refunded', array('before', 'after'), array('stable'))"
            later = "concat(date_add(to_date(left(created_at, 10)), 5), substring(created_at, 11, 15))"
            staged = self._documents().selectExpr("*", f"explode({stages}) as stage")
            pages = staged.selectExpr(
                "* except (financial_status)",
                "if(stage = 'before', 'paid', financial_status) as financial_status",
                f"if(stage = 'after', {later}, created_at) as updated_at",
            )
            # Files are bounded, as none can be split: their number, and the tasks that read a batch of them,
            # grow with the input.
            pages.write.partitionBy("stage").options(compression="gzip", maxRecordsPerFile=FILE_PAGES).json(path)

        return self._land("documents", write)

    def documents(self) -> DataFrame:
        """Pages of orders in their latest state, by version, whatever folder holds it, with
        their order's sums."""
        return current_pages(read_orders(self.spark, self._land_documents()))

    def document_feed(self) -> str:
        """Folder with every state of every order, as an incremental job sees it."""
        return self._land_documents()
