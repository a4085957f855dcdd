"""Report files {audit}/v{version}/report.{json,html} and access to them by share token."""

from __future__ import annotations

import hashlib
import hmac
import os
import secrets
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Content types of the formats; other formats are read as the first one.
FORMATS = {"html": "text/html; charset=utf-8", "json": "application/json"}


def report_path(audit_id: str, version: int, form: str) -> str:
    return f"{audit_id}/v{version}/report.{form}"


def share_token() -> str:
    """32 random hex digits."""
    return secrets.token_hex(16)


def write_report_files(reports: DataFrame, folder: str) -> DataFrame:
    """Writes json and html of every row (audit_id, version, json, html) into the folder, which all machines share.

    Gives audit_id, version, share_token, json_path and html_path. A file is there whole or not at all; writing again replaces
    it. Nulls are written as empty files. The result has to be stored once: every run of it draws new tokens.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for audit, version, *texts in zip(frame["audit_id"], frame["version"], frame["json"], frame["html"]):
                paths = [report_path(audit, version, form) for form in ("json", "html")]
                for path, text in zip(paths, texts):
                    target = os.path.join(folder, path)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    part = f"{target}.{os.getpid()}.part"
                    with open(part, "w", encoding="utf-8") as file:
                        file.write(text or "")
                    os.replace(part, target)
                rows.append((audit, version, share_token(), *paths))
            yield pd.DataFrame(rows, columns=["audit_id", "version", "share_token", "json_path", "html_path"])

    ddl = "audit_id string, version int, share_token string, json_path string, html_path string"
    return reports.select("audit_id", "version", "json", "html").mapInPandas(run, ddl)


def read_report_file(reports: DataFrame, folder: str, token: str, form: str = "html") -> tuple[bytes, str] | None:
    """Content and content type of the report with a share token; None if there is no such report."""
    form = form if form in FORMATS else "html"
    found = reports.where(F.col("share_token") == token).select(f"{form}_path").first()
    if found is None:
        return None
    with open(os.path.join(folder, found[0]), "rb") as file:
        return file.read(), FORMATS[form]


def signature(payload: bytes, timestamp: str, secret: str) -> str:
    """HMAC-SHA256 of `timestamp.payload` in hex, by which a receiver knows the sender."""
    return hmac.new(secret.encode(), timestamp.encode() + b"." + payload, hashlib.sha256).hexdigest()
