"""End-to-end cleaning and feature chain (the reference's preprocessing entry).

Lazy except for the data-dependent column decisions (D1, D2), which each need
one small profile action. Order follows SURVEY §2.16: labels are split
before they are standardised, and the detail is filled last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from flowsift.functions import columns as C
from flowsift.operators import clean as D

# fixed values: helper columns of the test view that are not log fields
VIEW_HELPERS = ("cents", "score")


def raw_log_from_view(flows: DataFrame) -> DataFrame:
    """The test view as the log reader would produce it: numeric text under
    the log's names, helper columns removed."""
    df = flows.drop(*C.present(flows, VIEW_HELPERS))
    return df.withColumnsRenamed({"duration_raw": "duration", "label_raw": "label"})


def clean_flows(df: DataFrame, sparse: float = 0.20, zeros: float = 0.95,
                drop: Sequence[str] = C.DROP_BEFORE_MODEL + ("event_time",),
                eps_mode: str = "replace_zero") -> DataFrame:
    df = C.coerce_numeric(df)
    df = C.clean_labels(df)
    df = D.apply_cleaning(df, D.fit_cleaning(df, sparse, zeros))
    if "ts" in df.columns and "event_time" not in df.columns:
        df = C.with_event_time(df, "ts")
    df = C.time_features(df)
    df = C.volume_features(df)
    df = C.log1p_features(df)
    df = C.bytes_per_packet(df, eps_mode)
    df = C.ratio_features(df)
    return C.drop_if_present(df, drop)


def binary_flows(df: DataFrame) -> DataFrame:
    """Only the two known classes, with a 0/1 target."""
    return C.binary_target(C.keep_classes(df))
