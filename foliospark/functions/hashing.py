"""Digests, seeds and identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = chr(0)


def _text(part) -> Column:
    col = part if isinstance(part, Column) else F.lit(part)
    return F.coalesce(col.cast("string"), F.lit("None"))


def stable_digest(*parts) -> Column:
    """SHA-256 of the parts as text, joined by NUL; a null part reads "None"."""
    return F.sha2(F.concat_ws(NUL, *[_text(p) for p in parts]), 256)


def discovery_rank(seed, key: Column) -> Column:
    """SHA-256 of ``seed|key``."""
    return F.sha2(F.concat(_text(seed), F.lit("|"), _text(key)), 256)


def row_fingerprint(*columns: str) -> Column:
    """SHA-256 of a canonical JSON object with the columns in alphabetical order.

    Nulls are kept as JSON nulls, so that a missing value differs from an absent one.
    """
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def stable_seed(*parts) -> Column:
    """The first 15 hex digits of the digest as a BIGINT."""
    return F.conv(F.substring(stable_digest(*parts), 1, 15), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """A number in [0, 1) from the digest: the seed over 2^60."""
    return stable_seed(*parts) / F.lit(float(1 << 60))


def choice(seed: Column, options: list, shift: int = 0) -> Column:
    """One of ``options`` by the seed, shifted right by ``shift`` bits, modulo their number."""
    at = F.pmod(F.shiftright(seed, shift), F.lit(len(options))).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), at + 1)


def uuid5(namespace: str, name: Column) -> Column:
    """The RFC 4122 version-5 UUID of a name."""
    digest = F.sha1(F.concat(F.lit(uuid.UUID(namespace).bytes), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
