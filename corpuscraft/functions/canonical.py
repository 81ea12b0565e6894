"""Digests of records as canonical JSON, in the dialects that stored artifacts use."""

from __future__ import annotations

import hashlib
import inspect
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exact import arrow_udf

#: The dialects; keys are always sorted. (separators, ASCII escapes)
DIALECTS = {
    "compact": ((",", ":"), False),
    "compact_ascii": ((",", ":"), True),
    "spaced": ((", ", ": "), False),
    "spaced_ascii": ((", ", ": "), True),
    "lines": ((",", ": "), True),
}


def write(text: str | None, dialect: str) -> str | None:
    """JSON text in another dialect; null where it is not JSON. Numbers keep their spelling, duplicate keys are refused."""
    separators, ascii_only = DIALECTS[dialect]

    def unique(pairs: list) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("duplicate key")
        return dict(pairs)

    try:
        doc = json.loads(text or "", object_pairs_hook=unique)
    except (ValueError, RecursionError):
        return None
    return json.dumps(doc, sort_keys=True, separators=separators, ensure_ascii=ascii_only, indent=1 if dialect == "lines" else None)


def digest(text: str | None, dialect: str = "compact") -> str | None:
    raw = write(text, dialect)
    return None if raw is None else hashlib.sha256(raw.encode()).hexdigest()


digests_column = arrow_udf(lambda text: {d: digest(text, d) for d in DIALECTS}, ", ".join(f"{d} string" for d in DIALECTS))
digest_column = arrow_udf(lambda text, dialect: {"digest": digest(text, dialect or "compact")}, "digest string")


def without(text: str | None, field: str | None) -> dict:
    """A record's own digest field and the digest of what is left without it."""
    try:
        doc = json.loads(text or "")
        own = doc.pop(field, None)
    except (ValueError, AttributeError, RecursionError):
        return {"stored": None, "computed": None}
    return {"stored": None if own is None else str(own), "computed": digest(json.dumps(doc))}


self_hash_column = arrow_udf(without, "stored string, computed string")


def record(*columns: str) -> Column:
    """A row's named columns as compact JSON with sorted keys, nulls kept: the JVM's own writer, for flat records."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def fingerprint(*modules) -> str:
    """One digest of modules' sources, by name: results are bound to the code that made them."""
    parts = sorted((m.__name__.rsplit(".", 1)[-1], inspect.getsource(m)) for m in modules)
    return hashlib.sha256(b"\0".join(name.encode() + b"\0" + source.encode() for name, source in parts)).hexdigest()
