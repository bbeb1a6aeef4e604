"""Message and table schemas, as DDL: usable before there is a session and in workers."""

from __future__ import annotations

RAW_MESSAGE = "slot STRING, row_no INT, line STRING, kind STRING"
TONE = "tone DOUBLE, positive DOUBLE, negative DOUBLE, polarity DOUBLE, word_count INT"
CLEAN_ARTICLE = (
    "url_hash STRING, gkg_record_id STRING, slot STRING, url STRING, title STRING, domain STRING, published_at TIMESTAMP_NTZ, "
    "themes ARRAY<STRING>, persons ARRAY<STRING>, orgs ARRAY<STRING>, "
    "tone STRUCT<tone: DOUBLE, positive: DOUBLE, negative: DOUBLE, polarity: DOUBLE, word_count: INT>"
)
CLEAN_EVENT = (
    "event_id BIGINT, event_date DATE, actor1 STRUCT<code: STRING, name: STRING, country: STRING, type1: STRING>, "
    "actor2 STRUCT<code: STRING, name: STRING, country: STRING, type1: STRING>, is_root BOOLEAN, cameo_code STRING, cameo_base STRING, "
    "cameo_root STRING, quad_class INT, goldstein DOUBLE, num_mentions INT, num_sources INT, num_articles INT, avg_tone DOUBLE, "
    "geo STRUCT<name: STRING, country: STRING, adm1: STRING, lat: DOUBLE, lon: DOUBLE>, date_added TIMESTAMP_NTZ, source_url STRING, source_url_hash STRING"
)
CLEAN_MENTION = "event_id BIGINT, url STRING, url_hash STRING, source_name STRING, mention_time TIMESTAMP_NTZ, confidence INT"
DEAD_LETTER = "reason STRING, slot STRING, row_no INT, line STRING, kind STRING"
DEAD_LETTER_CHARS = 2048
REASONS = ("missing_url", "missing_title", "missing_event_id", "bad_column_count", "bad_field")
KINDS = ("gkg", "events", "mentions")
