"""Business parameters, passed to every operator instead of being hard-coded."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

# Labels and constants that results must carry unchanged.
UNKNOWN = "Ukjent"
NO_DISCOUNT = "Ingen rabatt"
UNFULFILLED = "unfulfilled"
SHIPPING_COST_NAME = "Ca fraktkostnad"
FEE_ROW_MARKER = "transaksjonsgebyr"
WALLET_MARKER = "vipps"
CARD_METHOD = "kort"
TOTAL_ROW_MARKER = "sum"
MONTHLY_TOTAL = "Totalt (månedlig)"
PER_ORDER_TOTAL = "Sum pr. bestilling"
HIGHER_ORDER_VALUE = "Høyere ordreverdi"
LOWER_ORDER_VALUE = "Lavere ordreverdi"
WEEKDAYS = ("Mandag", "Tirsdag", "Onsdag", "Torsdag", "Fredag", "Lørdag", "Søndag")
PAYMENT_NAMES = {
    "shopify_payments": "Kort (Shopify Payments)",
    "Vipps/MobilePay Payments": "Vipps",
}
COST_SHEET_HEADERS = {
    "Produkt navn": "product_key",
    "Innkjøpspris pr. produkt i NOK uten MVA": "cost_price",
}


@dataclass(frozen=True)
class ProfitConfig:
    """Rates, windows and labels of one shop.

    ``as_of`` stands for "today" wherever a report depends on it, so that a job
    gives the same answer whenever it is run.
    """

    as_of: date
    vat_rate: Decimal = Decimal("0.25")
    refunded_statuses: tuple[str, ...] = ("refunded",)
    top_n: int = 15
    wallet_fallback_rate: Decimal = Decimal("0.02")
    wallet_window_days: int = 90
    scenario_wallet_rate: Decimal = Decimal("0.02")
    scenario_card_rate: Decimal = Decimal("0.05")
    scenario_card_fixed: Decimal = Decimal("2")
    # Order number to the code it is credited with, whatever the order itself says.
    discount_code_overrides: Mapping[int, str] = field(default_factory=dict)
