"""Schemas of the tables that sources give and operators take."""

BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume bigint"
NEWS = "id string, source string, headline string, content string, url string, published_at string, fetched_at string, language string, ticker string, sentiment_score double, sentiment_label string"
SCORED_NEWS = NEWS + ", sentiment_model string, sentiment_calibration string, lexicon_score double, lexicon_label string"
FEATURES = "ticker string, timeframe string, timezone string, bucket_start string, bucket_end string, news_count bigint, score_mean double, score_std double, score_min double, score_max double, positive_ratio double, neutral_ratio double, negative_ratio double"
DIVIDENDS = "symbol string, ex_date date, amount double"
SPLITS = "symbol string, date date, ratio double"
EX_RIGHTS = "date date, code string, name string, kind string, kind_label string, before_price double, reference_price double, value double, source string"
CATALOG = "code string, symbol string, name_zh string, name_en string, market string, kind string, tags array<string>"
SOURCE_CONFIG = (
    "sources array<struct<name:string, type:string, enabled:boolean, list_url:string, language:string, timezone:string, max_items:int, timeout_seconds:int, retry_count:int, "
    "rate_limit_seconds:double, article_link_selector:string, title_selector:string, time_selector:string, content_selector:string, rss_use_article_content:boolean, base_url:string, "
    "article_link_include:array<string>, article_link_exclude:array<string>, ticker_keywords:array<string>, request_headers:map<string,string>, content_extract_mode:string, "
    "content_extract_fallback:boolean, content_extract_timeout_seconds:int>>"
)
