"""A small hand-made shop: order documents and sheets as Spark tables."""

from __future__ import annotations

import json
from datetime import date

from profitloom.config import ProfitConfig
from profitloom.schemas import COST_ROW, ORDER

CFG = ProfitConfig(as_of=date(2024, 9, 1))


def line(title, variant=None, quantity=1, price="100.00", discount="0", pid=1):
    return {
        "title": title,
        "variant_title": variant,
        "quantity": quantity,
        "price": price,
        "total_discount": discount,
        "product_id": pid,
        "variant_id": pid * 10,
    }


def order(number, lines, created="2024-07-01T12:00:00+02:00", **fields):
    doc = {
        "id": number + 5000,
        "order_number": number,
        "created_at": created,
        "updated_at": created,
        "currency": "NOK",
        "financial_status": "paid",
        "fulfillment_status": "fulfilled",
        "email": f"c{number}@example.org",
        "payment_gateway_names": ["shopify_payments"],
        "shipping_address": {"city": "Oslo"},
        "total_discounts": "0",
        "discount_codes": [],
        "shipping_lines": [],
        "line_items": lines,
    }
    doc.update(fields)
    return {k: v for k, v in doc.items() if v is not ...}


def documents(spark, *docs):
    """Documents as JSON text read with the engine's schema."""
    rows = [(json.dumps(doc),) for doc in docs]
    ddl = ORDER.simpleString()
    return (
        spark.createDataFrame(rows, "doc string")
        .selectExpr(f"from_json(doc, '{ddl}') as d")
        .select("d.*")
    )


def costs(spark, *rows):
    return spark.createDataFrame(
        [(k, None if c is None else str(c)) for k, c in rows], "product_key string, c string"
    ).selectExpr("product_key", "cast(c as decimal(18,4)) as cost_price")


def sheet(spark, *rows):
    return spark.createDataFrame([(n, a, i) for i, (n, a) in enumerate(rows)], COST_ROW)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}
