"""Explicit schemas of the landed inputs; nothing is inferred."""

from pyspark.sql import types as T

_LINE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("variant_title", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("price", T.StringType()),
        T.StructField("total_discount", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("variant_id", T.LongType()),
    ]
)
_ADDRESS = T.StructType([T.StructField("city", T.StringType())])

ORDER = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("order_number", T.LongType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("updated_at", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("financial_status", T.StringType()),
        T.StructField("fulfillment_status", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("payment_gateway_names", T.ArrayType(T.StringType())),
        T.StructField("shipping_address", _ADDRESS),
        T.StructField("billing_address", _ADDRESS),
        T.StructField("total_discounts", T.StringType()),
        T.StructField(
            "discount_codes",
            T.ArrayType(T.StructType([T.StructField("code", T.StringType())])),
        ),
        T.StructField(
            "shipping_lines",
            T.ArrayType(T.StructType([T.StructField("price", T.StringType())])),
        ),
        # Place of the page's first line in its order; missing where one page holds the order.
        T.StructField("first_line", T.LongType()),
        T.StructField("line_items", T.ArrayType(_LINE)),
    ]
)

CARD_TRANSACTION = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("source_order_id", T.LongType()),
        T.StructField("fee", T.StringType()),
    ]
)

WALLET_ENTRY = T.StructType(
    [
        T.StructField("ledger_date", T.DateType()),
        T.StructField("entryType", T.StringType()),
        T.StructField("amount", T.LongType()),
    ]
)

COST_ROW = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("amount", T.StringType()),
        T.StructField("row_pos", T.LongType()),
    ]
)
