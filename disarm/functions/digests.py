"""Digest column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def token_hash(token: Column) -> Column:
    """Tokens are only ever kept as the hex digest of their text."""
    return F.sha2(token.cast("binary"), 256)


def pem_fingerprint(pem: Column) -> Column:
    """``sha256:`` and the hex digest of the DER body, which may be empty, of the first PEM block; null without one."""
    # the dashes before the body tell an empty body from no block
    found = F.regexp_extract(pem, r"(?s)-----BEGIN [^-]+(-----.*?)-----END [^-]+-----", 1)
    body = F.regexp_replace(found, r"^-----|\s+", "")
    return F.when(F.length(found) > 0, F.concat(F.lit("sha256:"), F.sha2(F.unbase64(body), 256)))
