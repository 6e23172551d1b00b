"""Name-based identifiers, so that a repeated job writes the same keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace every chunk id is derived from.
CHUNK_NAMESPACE = "6f5a1f5f-1f0f-4d0a-9c1f-5b1d4f7c9a10"
ZERO_UUID = "00000000-0000-0000-0000-000000000000"


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version 5 UUID of ``name``, as lower-case text."""
    prefix = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(prefix, F.encode(name, "UTF-8")))
    # Version nibble is 5, the two top bits of the variant nibble are 10.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    return uuid5(CHUNK_NAMESPACE, F.concat(document_id.cast("string"), F.lit(":"), chunk_index.cast("string")))


def node_id(document_id: Column, path: Column) -> Column:
    """Stable node key: one per document and outline path (the root path is empty)."""
    return uuid5(CHUNK_NAMESPACE, F.concat(document_id.cast("string"), F.lit("/node/"), path))


def edge_id(document_id: Column, child_path: Column) -> Column:
    return uuid5(CHUNK_NAMESPACE, F.concat(document_id.cast("string"), F.lit("/edge/"), child_path))


def canonical_uuid(text: Column) -> Column:
    """Lower-case hyphenated form of a UUID text, null when it is not one."""
    bare = F.lower(F.regexp_replace(text, r"^urn:uuid:|[{}-]", ""))
    return F.when(
        bare.rlike("^[0-9a-f]{32}$"),
        F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
    )
