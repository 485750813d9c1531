"""Schemas of the tables the library reads and produces."""

from __future__ import annotations

FILES = (
    "file_id STRING, filename STRING, content BINARY, content_length BIGINT, profile STRING, mode STRING, "
    "tags MAP<STRING,STRING>, policy_version STRING, received_at TIMESTAMP"
)
CHUNKS = "request_id STRING, seq INT, chunk BINARY, is_last BOOLEAN"
FINDING = "STRUCT<type: STRING, location: STRING, description: STRING, severity: STRING>"
INSPECTED = (
    f"file_id STRING, original_type STRING, status STRING, original_size BIGINT, findings ARRAY<{FINDING}>, "
    "error_message STRING, output BINARY"
)
FINDINGS = "file_id STRING, seq INT, type STRING, location STRING, description STRING, severity STRING"
LEDGER = (
    "fingerprint STRING, name STRING, common_name STRING, issued_at TIMESTAMP, not_after TIMESTAMP, "
    "revoked_at TIMESTAMP, revoke_reason STRING"
)
LEDGER_DOCUMENT = (
    "version INT, clients ARRAY<STRUCT<fingerprint: STRING, name: STRING, common_name: STRING, "
    "issued_at_unix: BIGINT, not_after_unix: BIGINT, revoked_at_unix: BIGINT, revoke_reason: STRING>>"
)
