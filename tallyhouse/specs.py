"""Declared feeds, table schemas and the fixed values of the data model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---- fixed values: cell texts that mean NULL
NULL_MARKERS = ["", "NA", "N/A", "NULL", "None", "nan", "NaN", "na", "n/a", "#N/A"]

# ---- fixed values: timestamp formats in the order they are tried
DATE_PATTERNS = [
    "yyyy-M-d H:m:s",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d H:m",
    "M/d/yyyy H:m:s",
    "M/d/yyyy",
    "yyyy-M-d",
    "d-MMM-yyyy H:m:s",
    "d-MMM-yyyy",
]

# per-value parsing also knows the mixed formats that feeds are seen to carry
TIMESTAMP_PATTERNS = [*DATE_PATTERNS, "M/d/yyyy H:m", "d-MMM-yyyy H:m", "yyyy/M/d H:m:s"]

# ---- fixed values: words in a column name that mark dates and identifiers
DATE_WORDS = ("_date", "_ts", "_at", "_time", "datetime", "date", "timestamp")
ID_WORDS = (
    "_id",
    "_key",
    "order_id",
    "transaction_id",
    "campaign_id",
    "promo_id",
    "store_id",
    "location_id",
)

CURRENCY_MARKS = "$,€£¥"
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2002\u2003\u2009\u3000"

HEADER_SCAN_ROWS = 15
VOTE_THRESHOLD = 0.5

# lineage columns every landed row carries
FILE, SHEET, ROW = "_source_file", "_sheet_name", "_row_idx"
LINEAGE = (FILE, SHEET, ROW)


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "decimal(8,4)": T.DecimalType(8, 4),
    "decimal(12,4)": T.DecimalType(12, 4),
    "decimal(14,4)": T.DecimalType(14, 4),
}


def _schema(**cols: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in cols.items()])


# ---- curated tables
SALES = _schema(
    transaction_id="string",
    transaction_ts="timestamp_ntz",
    store_id="string",
    sku="string",
    quantity="decimal(12,4)",
    unit_price="decimal(12,4)",
    revenue="decimal(14,4)",
    currency="string",
    source_system="string",
    source_file="string",
)
PRODUCTS = _schema(
    sku="string",
    category="string",
    brand="string",
    package_size="string",
    list_price="decimal(12,4)",
    launch_date="date",
)
STORES = _schema(store_id="string", region="string", city="string", store_type="string")
REGIONS = _schema(
    region="string", population="bigint", median_income_band="string", climate_zone="string"
)
CALENDAR = _schema(
    calendar_date="date", season="string", is_holiday="string", holiday_name="string"
)
PROMOS = _schema(
    promo_id="string",
    category="string",
    region="string",
    start_date="date",
    end_date="date",
    discount_pct="decimal(8,4)",
)
CAMPAIGNS = _schema(
    campaign_id="string",
    category="string",
    region="string",
    channel="string",
    start_date="date",
    end_date="date",
    exposure="bigint",
)
COMPETITOR_PRICES = _schema(
    obs_date="date", category="string", region="string", competitor_price="decimal(12,4)"
)
PRODUCT_UPDATES = _schema(
    sku="string",
    attribute="string",
    old_value="string",
    new_value="string",
    effective_date="date",
    change_reason="string",
)
FORECASTS = _schema(
    run_date="date",
    category="string",
    region="string",
    target_date="date",
    predicted_revenue="decimal(14,4)",
    yhat_lower="decimal(14,4)",
    yhat_upper="decimal(14,4)",
    model_version="string",
)


@dataclass(frozen=True)
class FeedSpec:
    """One sheet of one group of workbooks, and where its rows go."""

    name: str
    folder: str
    pattern: str
    table: str
    schema: T.StructType
    sheet: str = "*"
    key: tuple[str, ...] = ()
    rules: dict[str, str] = field(default_factory=dict)
    mapping: dict[str, str] = field(default_factory=dict)
    literals: dict[str, str | None] = field(default_factory=dict)
    text: tuple[str, ...] = ()
    dedup: str | None = None
    mode: str = "overwrite"
    enabled: bool = True

    @property
    def target_key(self) -> tuple[str, ...]:
        return tuple(self.mapping.get(k, k) for k in self.key)

    def columns(self) -> list[str]:
        """Source columns: those mapped, or those of the target schema."""
        return [c.lower() for c in self.mapping] or self.schema.names


_POS = dict(
    table="sales_transactions",
    schema=SALES,
    key=("transaction_id",),
    rules={"qty": "positive_numeric", "unit_price": "numeric", "amount": "numeric"},
    mapping={
        "transaction_id": "transaction_id",
        "ts": "transaction_ts",
        "store_id": "store_id",
        "sku": "sku",
        "qty": "quantity",
        "unit_price": "unit_price",
        "amount": "revenue",
        "currency": "currency",
    },
    literals={"source_system": "POS", "source_file": None},
)
_ONLINE = dict(
    table="sales_transactions",
    schema=SALES,
    key=("order_id",),
    rules={"units": "positive_numeric", "price_per_unit": "numeric"},
    mapping={
        "order_id": "transaction_id",
        "order_datetime": "transaction_ts",
        "location_id": "store_id",
        "product_sku": "sku",
        "units": "quantity",
        "price_per_unit": "unit_price",
        "currency": "currency",
    },
    literals={"source_system": "ONLINE", "source_file": None},
)
_HIST, _INCR = "historical", "incremental"


def _dimension(name: str, schema: T.StructType, key: str) -> FeedSpec:
    return FeedSpec(
        name, _HIST, "historical_data.xlsx", name, schema, sheet=name, key=(key,),
        text=("is_holiday", "package_size"),
    )


def _reference(name: str, schema: T.StructType, key: tuple[str, ...] = ()) -> FeedSpec:
    return FeedSpec(name, _HIST, f"{name}.xlsx", name, schema, key=key)


FEEDS: tuple[FeedSpec, ...] = (
    _dimension("dim_region", REGIONS, "region"),
    _dimension("dim_store", STORES, "store_id"),
    _dimension("dim_product", PRODUCTS, "sku"),
    _dimension("seasonal_calendar", CALENDAR, "calendar_date"),
    _reference("promo_windows", PROMOS, ("promo_id",)),
    _reference("marketing_campaigns", CAMPAIGNS, ("campaign_id",)),
    _reference("competitor_prices", COMPETITOR_PRICES),
    FeedSpec("pos_history", _HIST, "*pos*.xlsx", mode="overwrite", **_POS),
    FeedSpec("online_history", _HIST, "*online*.xlsx", mode="append", **_ONLINE),
    FeedSpec("pos_batch", _INCR, "*.xlsx", sheet="Sales", mode="append", **_POS),
    FeedSpec("online_batch", _INCR, "*.xlsx", sheet="Orders", mode="append", **_ONLINE),
    FeedSpec(
        "product_updates",
        _INCR,
        "*.xlsx",
        "product_updates",
        PRODUCT_UPDATES,
        sheet="product_updates",
        key=("sku", "attribute", "effective_date"),
        text=("old_value", "new_value", "attribute", "change_reason"),
        mode="append",
    ),
)
