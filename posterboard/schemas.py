"""Row types."""

from __future__ import annotations

LISTING = (
    "id long, title string, start_date date, end_date date, location string, tribe string, details string, flyer_url string, "
    "report_count int, approved boolean, created_at timestamp"
)
RECORD = (
    "title string, start_date date, end_date date, location string, tribe string, details string, flyer_url string, source string, source_url string, "
    "source_posted_at date, extraction string, confidence int, warnings array<string>, flyer_phash string, raw_text string, first_seen timestamp, "
    "title_provisional boolean, manual_fields array<string>, ordinal long"
)
LEDGER = (
    "fingerprint string, title string, start_date date, match_key string, phash string, source string, source_url string, outcome string, "
    "first_seen timestamp, last_seen timestamp"
)
MANIFEST = "name string, size long, in_bucket boolean, first_backed_up timestamp, last_seen timestamp, gone_since timestamp"
