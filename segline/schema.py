"""Column bundles and table schemas shared by all operators."""

from __future__ import annotations

CHANNEL = ["channel_id"]
PERIOD = ["channel_id", "period_id"]
SET = ["channel_id", "period_id", "as_id"]
TRACK = ["channel_id", "period_id", "as_id", "rep_id"]
REP = ["channel_id", "rep_id"]

SEGMENTS = "channel_id string, period_id string, as_id string, rep_id string, media_type string, seg_no bigint, start_pts bigint, end_pts bigint, timescale int, path string, init_path string, status string, commit_at timestamp, discontinuity boolean, key_uri string, iv binary"
SIDECAR = "channel_id string, period_id string, as_id string, rep_id string, n bigint, s bigint, e bigint, t int, dc boolean, k string, iv string"
DOCUMENTS = "doc_id string, channel_id string, rep_id string, url string, fetched_at timestamp, body string"
POLLS = "channel_id string, rep_id string, poll_at timestamp, ok boolean, media_sequence bigint, last_seq bigint, n_segments int, end_list boolean, message string"
ATTEMPTS = "channel_id string, period_id string, as_id string, rep_id string, seg_no bigint, attempt_at timestamp, url string, http_status int, stage string, outcome string, bytes bigint, duration_s double, deadline timestamp, retries int"
PROTECTION = "channel_id string, period_id string, as_id string, rep_id string, scheme string, kids array<string>, n_tracks int"
KEYS = "channel_id string, kid string, added_at timestamp"
CHANNELS = "channel_id string, source_type string, key_mode string, hls_key_mode string, url string, keep_all boolean, enabled boolean, is_vod boolean, playready boolean, widevine boolean, content_keys array<string>"
LIFECYCLE = "channel_id string, at timestamp, transition string, stored bigint"
