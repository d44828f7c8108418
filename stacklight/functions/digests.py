"""Digests that keep secrets and paths out of what is stored."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from stacklight.functions.paths import col

# Endings of the keys whose values are paths.
_PATH_KEYS = ("path", "file", "model", "tags", "directory", "root")


def safe_error(kind: str | Column, message: str | Column) -> Column:
    """Type:message_sha256= and the first 16 hex digits of the message's digest."""
    return F.concat(col(kind), F.lit(":message_sha256="), F.substring(F.sha2(F.coalesce(col(message), F.lit("")), 256), 1, 16))


def metadata_evidence(pairs: str | Column) -> Column:
    """struct(sha256, keys, n) of a map<string,string>: the digest of its sorted compact JSON, its sorted keys and their number."""
    entries = F.array_sort(F.map_entries(col(pairs)))
    return F.struct(F.sha2(F.to_json(F.map_from_entries(entries)), 256).alias("sha256"), F.array_sort(F.map_keys(col(pairs))).alias("keys"), F.size(col(pairs)).alias("n"))


def canonical(document: str | Column) -> Column:
    """A JSON text in its canonical form: no white space, keys of every object in order. A text that is no JSON is null."""
    return F.to_json(F.try_parse_json(col(document)))


def nested_evidence(document: str | Column) -> Column:
    """metadata_evidence of a JSON object with nested values: struct(sha256 of its canonical form, sorted keys, n), never the values. Anything else than an object is null."""
    fields = F.map_keys(F.try_parse_json(col(document)).try_cast("map<string,variant>"))
    return F.when(fields.isNotNull(), F.struct(F.sha2(canonical(document), 256).alias("sha256"), F.array_sort(fields).alias("keys"), F.size(fields).alias("n")))


def flat_config(config: Mapping[str, Any]) -> dict[str, str]:
    """Every leaf of a configuration as JSON text under its path of keys; of texts below a key that ends as a path's does, only the last component, so that nothing depends on the machine."""
    out: dict[str, str] = {}
    todo: list[tuple[tuple[str, ...], str, Any]] = [((), "", config)]
    while todo:
        at, key, value = todo.pop()
        if isinstance(value, Mapping):
            out["/".join((*at, "{}"))] = ""
            todo += [((*at, json.dumps(str(k))), str(k), v) for k, v in value.items()]
        elif isinstance(value, (list, tuple)):
            out["/".join((*at, "[]"))] = str(len(value))
            todo += [((*at, str(i)), key, v) for i, v in enumerate(value)]
        elif value is None or isinstance(value, (str, bool, int)) or isinstance(value, float) and math.isfinite(value):
            local = isinstance(value, str) and key.lower().endswith(_PATH_KEYS)
            out["/".join(at)] = json.dumps(re.split(r"[\\/]", value.rstrip("\\/"))[-1] if local else value)
        else:
            raise ValueError(f"a configuration can't hold {value!r}")
    return out


def config_fingerprint(config: Mapping[str, Any]) -> str:
    lines = sorted(f"{k}={v}" for k, v in flat_config(config).items())
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()
