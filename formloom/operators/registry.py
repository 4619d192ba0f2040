"""Sending finalized records to a clinical registry over HTTP."""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .finalize import registry_rows


class RegistryError(RuntimeError):
    pass


def payload(rows: list[dict[str, str]], token: str, overwrite: bool) -> dict[str, str]:
    """The import request's form fields."""
    return {
        "token": token, "content": "record", "action": "import", "format": "json", "type": "flat",
        "overwriteBehavior": "overwrite" if overwrite else "normal", "forceAutoNumber": "false",
        "data": json.dumps(rows, ensure_ascii=False), "returnContent": "count", "returnFormat": "json",
    }


def _post(url: str, data: dict[str, str]) -> tuple[int, str]:
    with urllib.request.urlopen(url, urllib.parse.urlencode(data).encode(), timeout=60) as r:
        return r.status, r.read().decode()


def send(recs: DataFrame, settings: dict[str, Any], allow_hosts: tuple[str, ...], post: Callable = _post, batch: int = 500) -> DataFrame:
    """Send all records in batches, and return the ids sent (record_id).

    The host must be allowed and the token come from the environment; neither
    shows in errors.  A batch that is not accepted in full raises, and nothing
    is returned to be marked as exported.
    """
    url, key = settings.get("api_url") or "", settings.get("record_id_field", "record_id")
    if (urllib.parse.urlparse(url).hostname or "") not in set(allow_hosts):
        raise RegistryError("the registry's host is not allowed")
    token = os.environ.get(settings.get("token_env", "REDCAP_API_TOKEN"), "").strip()
    if not token:
        raise RegistryError("the registry's token is not in the environment")
    long = registry_rows(recs, settings.get("field_map") or {}, key, settings.get("skip_unmapped", True), settings.get("table_fields_as_json", True))
    flat = recs.select(F.col("record_id").alias(key)).join(long.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("target", "cell"))).alias("cells")), key, "left")
    pending: list[dict[str, str]] = []

    def flush():
        status, body = post(url, payload(pending, token, settings.get("overwrite", False)))
        if status != 200:
            raise RegistryError(f"import failed (HTTP {status}): {body[:500]}")
        try:
            count = int(json.loads(body).get("count", 0))
        except (ValueError, AttributeError):
            raise RegistryError(f"unreadable reply: {body[:200]}") from None
        if count != len(pending):
            raise RegistryError(f"{count} of {len(pending)} records were accepted; none is marked")
        pending.clear()

    for row in flat.toLocalIterator():
        pending.append({key: row[key], **(row["cells"] or {})})
        if len(pending) >= batch:
            flush()
    if pending:
        flush()
    return recs.select("record_id")
