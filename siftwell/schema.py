"""Table layouts shared by every module."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("created_at", T.LongType()),
    ]
)

MODES = ("dense", "sparse", "hybrid")

DENSE_DIM = 384

# Optional per-query filter columns: null means "no condition".
QUERY_FILTERS = {
    "category_filter": "string",
    "created_after": "bigint",
    "created_before": "bigint",
}


def require_columns(df, *names: str):
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def epoch_seconds(ts) -> Column:
    """Epoch seconds of a timestamp column, for time ranges kept as BIGINT."""
    return F.unix_timestamp(F.col(ts) if isinstance(ts, str) else ts)


def from_epoch(seconds) -> Column:
    return F.timestamp_seconds(F.col(seconds) if isinstance(seconds, str) else seconds)
