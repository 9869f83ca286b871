"""Figures worked out beforehand for the driver's tables (see FIXTURES.md)."""

import pytest
from shop import one

from profitloom import catalog
from profitloom.sources.tables import ShopTables

KNOWN = {
    "0.001": {
        "headline_totals": {
            "num_orders": 991,
            "revenue": 88895780.78,
            "revenue_excl_mva": 71116624.62,
            "total_cost": 49504698.60,
            "total_discount": 4702997.12,
            "shipping_revenue": 51587.00,
        },
        "unmatched_headline": {"n_lines": 155},
        "repeat_customers": {"unique_customers": 120, "repeat_customers": 119},
        "unfulfilled_count": {"open_orders": 507},
        "wallet_fee_summary": {"total_fees": 277.25, "total_captured": 10424.69},
        "fees": {"actual": (491, 2532721.27), "estimated": (500, 1211366.16)},
        "sizes": {"weekly_profit": 328, "product_margin": 62},
    },
    "0.01": {
        "headline_totals": {
            "num_orders": 9743,
            "revenue": 906956860.04,
            "revenue_excl_mva": 725565488.03,
            "total_cost": 516610112.87,
            "total_discount": 47563682.06,
            "shipping_revenue": 512868.00,
        },
        "unmatched_headline": {"n_lines": 1268},
        "repeat_customers": {"unique_customers": 1197, "repeat_customers": 1178},
        "unfulfilled_count": {"open_orders": 4884},
        "wallet_fee_summary": {"total_fees": 2539.23, "total_captured": 95455.77},
        "fees": {"actual": (4675, 23329463.53), "estimated": (5068, 12337340.06)},
        "sizes": {"weekly_profit": 345, "product_margin": 64},
    },
}


@pytest.mark.parametrize("sf", sorted(KNOWN))
def test_known_figures(spark, sf):
    known = KNOWN[sf]
    # The figures are those of a sheet that lists every product once.
    shop = ShopTables(spark, f"/root/testdata/sf{sf}", clean_costs=True)
    queries = {name: lambda build=build: build(shop) for name, build in catalog._shop_queries().items()}
    for name, figures in known.items():
        if name in ("fees", "sizes"):
            continue
        row = one(queries[name]())
        assert {k: row[k] for k in figures} == pytest.approx(figures, abs=0.011), name
    for name, size in known["sizes"].items():
        assert queries[name]().count() == size
    rows = queries["fee_breakdown"]().collect()
    assert {r.fee_source: (r.orders, r.fees) for r in rows} == {
        k: pytest.approx(v, abs=0.011) for k, v in known["fees"].items()
    }
