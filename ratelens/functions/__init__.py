from ratelens.functions.columns import (
    NEG_STAR_POS_TEXT,
    NONE_SENTINEL,
    POS_STAR_NEG_TEXT,
    anomaly_type,
    binary_label,
    clean_repr,
    contains_flag,
    correct_mark,
    friend_count,
    is_present,
    literal_flag,
    month_of,
    month_start,
    pct,
    preview_text,
    sentiment_name,
)

__all__ = [
    "NONE_SENTINEL", "POS_STAR_NEG_TEXT", "NEG_STAR_POS_TEXT", "anomaly_type", "binary_label",
    "clean_repr", "contains_flag", "correct_mark", "friend_count", "is_present", "literal_flag",
    "month_of", "month_start", "pct", "preview_text", "sentiment_name",
]
