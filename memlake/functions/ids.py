"""Content-derived ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F


def hash_id(text: Column, prefix: str = "") -> Column:
    """Prefix and MD5 of the text."""
    return F.concat(F.lit(prefix), F.md5(text))


def uuid5(name: Column, namespace: uuid.UUID | Column = uuid.NAMESPACE_OID) -> Column:
    """Name-based UUID; the namespace may be a column of UUID texts."""
    raw = F.unhex(F.lit(namespace.hex)) if isinstance(namespace, uuid.UUID) else F.unhex(F.translate(namespace, "-", ""))
    h = F.sha1(F.concat(raw, F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def node_id(name: Column) -> Column:
    """UUID5 of a node's normalised name."""
    from memlake.functions.text import node_key

    return uuid5(node_key(name))
