"""Explicit schemas of what is read and kept; nothing is inferred."""

from __future__ import annotations

UNIT = "unit_id string, repo string, kind string, path string, symbol string, start_line int, end_line int, char_count int, text string, metadata map<string,string>, content_hash string"
USER = "struct<login:string,type:string>"
COMMENT = f"id bigint, in_reply_to_id bigint, path string, diff_hunk string, body string, user {USER}, pull_request_url string, created_at string, html_url string, side string, line int, original_line int, commit_id string, subject_type string"
PULL = f"number int, title string, body string, user {USER}, merged_at string, merge_commit_sha string, html_url string, updated_at string"
ISSUE = f"number int, title string, body string, state string, user {USER}, html_url string, pull_request struct<url:string>, updated_at string"
DELIVERY = "delivery_id string, event string, action string, repo string, pr bigint, head_sha string, installation_id bigint, ts timestamp, arrival bigint"
VECTOR = "id string, vector array<float>, tokens int, model string, fingerprint string"
RESULT = "repo string, outcome string, framework string, reason string, pull_seconds double, fetch_seconds double, run_seconds double, dropped array<string>"
INDEX = "unit_id string, repo string, kind string, content_hash string, ref string, updated_at int"
