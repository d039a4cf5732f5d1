"""Deterministic identities as columns: the first 16 hex digits of SHA-256 over parts joined by a bar."""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode white space as Python's str.split() sees it, for Java patterns.
SPACE = r"(?U)[\s\x1c-\x1f]+"
# Fixed value: the namespace of vector point ids.
POINTS = uuid.UUID("6e2f6a3e-6b1e-4b8b-9c1e-3b7b7e9f9a10")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Python's strip(): all Unicode white space, not blanks alone."""
    return F.regexp_replace(_c(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def spaced(x: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(_c(x), SPACE, " "))


@F.pandas_udf(StringType())
def _exact_key(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).split()).casefold())


def identity_key(x: Column | str, ascii_only: bool = False) -> Column:
    """NFKC, single blanks, case-folded. ascii_only stays in the JVM, for names known to be ASCII."""
    return F.lower(spaced(x)) if ascii_only else _exact_key(_c(x))


def short_hash(*parts: Column | str) -> Column:
    """Null if a part is null: concat_ws alone would leave it out."""
    parts = tuple(_c(p).cast("string") for p in parts)
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("|"), p)
    return F.substring(F.sha2(joined, 256), 1, 16)


def paper_id(source: Column | str, source_id: Column | str, ascii_only: bool = False) -> Column:
    return F.concat(F.lit("paper:"), identity_key(source, ascii_only), F.lit(":"), spaced(source_id))


def version_id(paper: Column | str, version: Column | str) -> Column:
    own = spaced(_c(version).cast("string"))
    own = F.when(F.lower(own).startswith("v"), own).otherwise(F.concat(F.lit("v"), own))
    return F.concat(F.lit("paper-version:"), F.regexp_replace(_c(paper), r"^[^:]*:", ""), F.lit(":"), own)


def section_id(version: Column | str, kind: Column | str, order: Column | str) -> Column:
    return F.concat(F.lit("section:"), short_hash(version, kind, order))


def chunk_id(version: Column | str, section: Column | str, index: Column | str, fingerprint: Column | str) -> Column:
    return F.concat(F.lit("chunk:"), short_hash(version, section, index, fingerprint))


def entity_id(kind: Column | str, name: Column | str, ascii_only: bool = False) -> Column:
    """The type is in the hash too, so one name in two types gives two ids."""
    return F.concat(F.lit("entity:"), _c(kind), F.lit(":"), short_hash(kind, identity_key(name, ascii_only)))


def relationship_id(source: Column | str, kind: Column | str, target: Column | str) -> Column:
    """The paper's version is not part of it: versions share their edges."""
    return F.concat(F.lit("relationship:"), short_hash(source, kind, target))


def evidence_id(kind: Column | str, *refs: Column | str) -> Column:
    return F.concat(F.lit("evidence:"), short_hash(kind, *refs))


def path_evidence_id(kind: Column, operation: Column, nodes: Column, edges: Column) -> Column:
    """For arrays of node ids and edge ids in path order."""
    joined = F.array_join(F.concat(F.array(kind, operation), nodes, edges), "|")
    return F.concat(F.lit("evidence:"), F.substring(F.sha2(joined, 256), 1, 16))


def collection_id(name: Column | str) -> Column:
    return F.concat(F.lit("collection:"), short_hash(identity_key(name)))


@F.pandas_udf(StringType())
def point_id(chunk: pd.Series) -> pd.Series:
    """UUIDv5 of the chunk id: one vector point for each chunk."""
    return chunk.map(lambda c: None if c is None else str(uuid.uuid5(POINTS, c)))


def fingerprint(values: dict[str, Any], compact: bool = True) -> str:
    """SHA-256 of canonical JSON; configurations use compact separators, decisions the default ones."""
    return hashlib.sha256(json.dumps(values, sort_keys=True, separators=(",", ":") if compact else None).encode()).hexdigest()


def json_safe(values: dict[str, Any]) -> dict[str, Any]:
    try:
        json.dumps(values)
    except TypeError as why:
        raise ValueError(f"not JSON-serialisable: {why}") from why
    return values


def new_job_id() -> str:
    """The one id that isn't deterministic: every run is a job of its own."""
    return f"ingestion-job:{uuid.uuid4().hex}"
