"""Content-addressed identity."""

from __future__ import annotations

import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(value) -> str:
    """JSON with sorted keys, no spaces and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_digest(payloads: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of a JSON text; null stays null."""
    return payloads.map(lambda p: None if p is None else hashlib.sha256(canonical_json(json.loads(p)).encode()).hexdigest())


def name_uuid(namespace: str):
    """Column function: the name-based (SHA-1) uuid of a text within a namespace."""
    space = uuid.UUID(namespace)

    @F.pandas_udf(T.StringType())
    def of(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else str(uuid.uuid5(space, n)))

    return of


def set_fingerprint(values: Column) -> Column:
    """Digest of a set of texts that does not depend on their order (an aggregate)."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(values)), "\n"), 256)
