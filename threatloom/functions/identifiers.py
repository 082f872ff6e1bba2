"""Deterministic UUIDv5 identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom import fixed_values as V
from threatloom.functions.expressions import let

_NAMESPACE = V.STIX_NAMESPACE.replace("-", "")


def uuid5(name: Column) -> Column:
    """UUIDv5 of a name in the STIX namespace."""

    def layout(digest: Column) -> Column:
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

    return let(F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE)), F.encode(name, "UTF-8"))), layout)


def stix_id(stix_type: Column | str, name: Column) -> Column:
    kind = F.lit(stix_type) if isinstance(stix_type, str) else stix_type
    return F.concat(kind, F.lit("--"), uuid5(name))


def named_id(stix_type: str, **parts: Column) -> Column:
    """Id from a canonical JSON object of the given parts (keys sorted)."""
    fields = [parts[key].alias(key) for key in sorted(parts)]
    return stix_id(stix_type, F.to_json(F.struct(*fields)))


_UUID_AT_END = r"--[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"
_UUID_LENGTH = 36
_WHOLE = 1 << 30  # longer than any id


def packed_id(stix_id: Column) -> Column:
    """An id in few bytes, one to one, for shuffles: a UUID at its end as 16 bytes, then the rest; any other text as it stands."""
    digits = F.replace(F.right(stix_id, F.lit(_UUID_LENGTH)), F.lit("-"), F.lit(""))
    rest = F.left(stix_id, F.length(stix_id) - _UUID_LENGTH)
    packed = F.concat(F.lit(b"\x01"), F.unhex(digits), F.encode(rest, "UTF-8"))
    return F.when(stix_id.rlike(_UUID_AT_END), packed).otherwise(F.concat(F.lit(b"\x00"), F.encode(stix_id, "UTF-8")))


def unpacked_id(packed: Column) -> Column:
    """The id that ``packed_id`` made smaller."""
    digits = F.lower(F.hex(F.substring(packed, 2, 16)))
    pieces = [F.substring(digits, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    whole = F.concat(F.decode(F.substring(packed, 18, _WHOLE), "UTF-8"), F.concat_ws("-", *pieces))
    other = F.decode(F.substring(packed, 2, _WHOLE), "UTF-8")
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\x01"), whole).otherwise(other)
