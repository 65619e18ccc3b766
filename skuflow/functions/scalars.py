"""Scalar Column functions (JVM-side expressions, codegen-friendly).

Each function takes and returns ``Column`` objects, so they compose inside
``select``/``withColumns`` and stay inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skuflow import schemas as S

def _zero() -> Column:
    return F.lit(0.0)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- C1 ---------------------------------------------------------------------
def available_quantity(on_hand, reserved) -> Column:
    """max(on_hand - reserved, 0); unknown (NULL) if either is unknown."""
    free = col(on_hand) - col(reserved)
    return F.when(free.isNotNull(), F.greatest(free, _zero()))


def available_quantity_valid(on_hand, reserved) -> Column:
    """The domain rule: a missing or negative on-hand or reserved is a validation error."""
    return F.coalesce((col(on_hand) >= 0) & (col(reserved) >= 0), F.lit(False))


# --- C2 / C3 / C4 -------------------------------------------------------------
def projected_ending(available, inbound, forecast) -> Column:
    return col(available) + col(inbound) - col(forecast)


def projected_shortage(ending) -> Column:
    return F.greatest(-col(ending), _zero())


def shortage_ratio(shortage, forecast) -> Column:
    # ANSI mode raises on /0, so the guard is part of the expression.
    return F.when(col(forecast) > 0, col(shortage) / col(forecast)).otherwise(_zero())


def forecast_error(forecast, actual) -> Column:
    return col(forecast) - col(actual)


# --- C5 -----------------------------------------------------------------------
def severity_band(ratio, low_to_medium, medium_to_high) -> Column:
    r = col(ratio)
    return (
        F.when(r == 0, F.lit("none"))
        .when(r <= col(low_to_medium), F.lit("low"))
        .when(r <= col(medium_to_high), F.lit("medium"))
        .otherwise(F.lit("high"))
    )


# --- C6 / C9 / C25 -------------------------------------------------------------
def unit_conversion(quantity, factor) -> Column:
    """canonical = source x factor, stored as DECIMAL(18,3) (half-up)."""
    return (col(quantity).cast(S.QTY) * col(factor).cast(S.QTY)).cast(S.QTY)


def quantize(value, places: int = 3) -> Column:
    """Half-up rounding to ``places`` decimals via DECIMAL cast."""
    return col(value).cast(f"decimal(18,{places})")


def reverse_unit(canonical, factor) -> Column:
    """Source quantity = canonical / factor, DECIMAL(18,3)."""
    return (col(canonical) / col(factor)).cast(S.QTY)


# --- C7 -----------------------------------------------------------------------
def difference(reported, hub) -> Column:
    return col(reported) - col(hub)


# --- C8 -----------------------------------------------------------------------
def invalid_row(key_columns=S.KEY_COLUMNS, quantity_columns=S.QUANTITY_COLUMNS) -> Column:
    """Any key NULL or (non-date) blank after trim; any quantity NULL or < 0.

    NaN passes (NaN < 0 is false), matching the reference gate.
    """
    terms = []
    for c in key_columns:
        terms.append(F.col(c).isNull())
        if c != "event_date":
            terms.append(F.trim(F.col(c)) == "")
    for c in quantity_columns:
        terms.append(F.col(c).isNull() | (F.col(c) < 0))
    return reduce(lambda a, b: a | b, terms)


# --- C12 / C18 / C19 / C16 ------------------------------------------------------
# Patterns and bounds of codes, names, keys, run and correlation ids.
CODE_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_-]*$"
IDEMPOTENCY_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._:-]*$"
CORRELATION_PATTERN = r"^[A-Za-z0-9._:-]{1,128}$"
UNSAFE_IN_RUN_ID = r"[^A-Za-z0-9_.-]"
CODE_LENGTH, NAME_LENGTH, KEY_LENGTH = (2, 100), (1, 200), (8, 128)


def normalize_code(c) -> Column:
    return F.upper(F.trim(col(c)))


def code_valid(c) -> Column:
    n = F.trim(col(c))
    return F.length(n).between(*CODE_LENGTH) & n.rlike(CODE_PATTERN)


def name_valid(c, max_len: int = NAME_LENGTH[1]) -> Column:
    return F.length(F.trim(col(c))).between(NAME_LENGTH[0], max_len)


def idempotency_key_valid(c) -> Column:
    k = col(c)
    return F.length(k).between(*KEY_LENGTH) & k.rlike(IDEMPOTENCY_PATTERN)


def correlation_id_safe(c) -> Column:
    return col(c).rlike(CORRELATION_PATTERN)


def safe_run_id(c) -> Column:
    return F.substring(F.regexp_replace(col(c), UNSAFE_IN_RUN_ID, "_"), 1, S.RUN_ID_MAX_LENGTH)


# --- C13 / C14 ------------------------------------------------------------------
TZ_SUFFIX_PATTERN = r"(Z|z|[+-]\d\d:?\d\d)$"


def utc_iso(ts) -> Column:
    """Render an instant as ISO-8601 UTC with a ``Z`` suffix (session tz is UTC)."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_iso_micros(ts) -> Column:
    """ISO-8601 UTC with microseconds and a ``Z`` suffix."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def has_timezone(text) -> Column:
    return col(text).rlike(TZ_SUFFIX_PATTERN)


def parse_aware_timestamp(text) -> Column:
    """Timezone-aware ISO-8601 text -> UTC instant; naive or malformed -> NULL.

    Parsing uses Spark's string-to-timestamp cast rules (``T`` or space,
    optional fraction, ``Z`` or numeric offset); the offset is required.
    """
    t = F.trim(col(text))
    return F.when(has_timezone(t), F.try_to_timestamp(t))


def parse_naive_timestamp(text) -> Column:
    """A timestamp text without an offset (to report "timezone required")."""
    t = F.trim(col(text))
    return F.when(~has_timezone(t), F.try_to_timestamp(t))


# --- C17 ---------------------------------------------------------------------------
def source_prefix(event_date) -> Column:
    return F.concat(F.lit("raw/history/inventory/event_date="), F.date_format(col(event_date), "yyyy-MM-dd"), F.lit("/"))


def manifest_key(event_date, run_id) -> Column:
    return F.concat(
        F.lit("manifests/inventory-risk/event_date="), F.date_format(col(event_date), "yyyy-MM-dd"),
        F.lit("/run_id="), safe_run_id(run_id), F.lit(".json"),
    )


def quality_key(event_date, run_id) -> Column:
    return F.concat(
        F.lit("quality/inventory/event_date="), F.date_format(col(event_date), "yyyy-MM-dd"),
        F.lit("/run_id="), safe_run_id(run_id), F.lit(".json"),
    )


def curated_prefix(event_date, run_id, summary: bool = False) -> Column:
    root = "curated/inventory-risk-summary/" if summary else "curated/inventory-risk/"
    return F.concat(
        F.lit(root + "event_date="), F.date_format(col(event_date), "yyyy-MM-dd"),
        F.lit("/run_id="), safe_run_id(run_id),
    )


def raw_object_key(source_type, sha256, observed_at) -> Column:
    ext = F.when(col(source_type) == "supplier_a_json", F.lit("json")).otherwise(F.lit("csv"))
    return F.concat(
        F.lit("raw/inventory/source="), col(source_type),
        F.lit("/ingest_date="), F.date_format(col(observed_at), "yyyy-MM-dd"),
        F.lit("/"), col(sha256), F.lit("."), ext,
    )


# --- C23 / C24 ------------------------------------------------------------------
def classify_failure(error_type) -> tuple[Column, Column]:
    """error type -> (retryable, failure code)."""
    e = col(error_type)
    retry = F.lit(False)
    code = F.lit(S.UNEXPECTED_FAILURE_CODE)
    for name, retryable, failure_code in reversed(S.FAILURE_CLASSES):
        retry = F.when(e == name, F.lit(retryable)).otherwise(retry)
        code = F.when(e == name, F.lit(failure_code)).otherwise(code)
    return retry, code


def retry_delay_seconds(attempts, base: int = S.IMPORT_RETRY_BASE_SECONDS,
                        cap: int = S.IMPORT_RETRY_MAX_SECONDS) -> Column:
    exponent = F.greatest(col(attempts) - 1, F.lit(0))
    # pow saturates to +inf for huge exponents, so least() caps without overflow.
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), exponent), F.lit(float(cap))).cast("int")


# --- uniform deterministic integers (generators) ---------------------------------
def md5_uint(expr: Column, hex_digits: int = 8) -> Column:
    """Unsigned integer from the first hex digits of md5 (same value in DuckDB)."""
    return F.conv(F.substring(F.md5(expr), 1, hex_digits), 16, 10).cast("bigint")


# --- C15 ------------------------------------------------------------------------
def iana_timezones(spark) -> "DataFrame":
    """The IANA zone names known to the runtime (a few hundred rows: a bounded,
    broadcastable dimension)."""
    import zoneinfo

    names = sorted(zoneinfo.available_timezones())
    return spark.createDataFrame([(n,) for n in names], "timezone string")


def with_timezone_valid(df, tz_col: str = "timezone"):
    """Flag rows whose time zone is a valid IANA name (broadcast lookup)."""
    zones = F.broadcast(iana_timezones(df.sparkSession).withColumn("_tz_ok", F.lit(True)))
    return df.join(zones.withColumnRenamed("timezone", "_tz"), F.col(tz_col) == F.col("_tz"), "left").select(
        *df.columns, F.coalesce(F.col("_tz_ok"), F.lit(False)).alias("timezone_valid"))
