"""The entry: the one row type, its typed attributes, and tag names."""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EV = T.StructType([T.StructField("name", T.StringType()), T.StructField("type_id", T.ShortType()), T.StructField("value", T.StringType()), T.StructField("raw", T.BinaryType())])
ENTRY = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("nsec_rem", T.IntegerType()),
        T.StructField("src", T.BinaryType()),
        T.StructField("tag", T.StringType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("evs", T.ArrayType(EV)),
    ]
)
COLUMNS = ENTRY.fieldNames()
NO_EVS = f"CAST(array() AS {T.ArrayType(EV).simpleString()})"

#: Attribute types by id.
EV_TYPES = {1: "bytes", 2: "bool", 3: "byte", 4: "int8", 5: "int16", 6: "uint16", 7: "int32", 8: "uint32", 9: "int64", 10: "uint64", 11: "float32", 12: "float64", 13: "string", 14: "mac", 15: "ip", 16: "timestamp", 17: "duration"}
EV_ID = {name: i for i, name in EV_TYPES.items()}
#: Limits in bytes, or in attributes for the block.
MAX_EV_NAME, MAX_EV_VALUE, MAX_EV, MAX_BLOCK_EVS, MAX_BLOCK_BYTES = 1024, 63 * 1024 - 9, 65535, 65535, 32 << 20
MAX_DATA, HEADER_BYTES = 0x3FFFFFFF, 34
DEFAULT_TAG, MAX_TAG_BYTES = "default", 4096
#: Characters that no tag holds, besides white space and what cannot be printed.
TAG_FORBIDDEN = "\"'`´‘’“”*$\\[]|{}();=<!>~%^&\".:,/"


def entries(df: DataFrame, *, ts: Column, data: Column, tag: Column | str = DEFAULT_TAG, src: Column | None = None, evs: Column | None = None, nsec_rem: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Any DataFrame as entries; ``keep`` names further columns that stay."""
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return df.select(
        ts.cast("timestamp").alias("ts"),
        (nsec_rem if nsec_rem is not None else F.lit(0)).cast("int").alias("nsec_rem"),
        (src if src is not None else F.lit(None)).cast("binary").alias("src"),
        tag.alias("tag"),
        data.cast("binary").alias("data"),
        (evs if evs is not None else F.expr(NO_EVS)).alias("evs"),
        *keep,
    )


def text() -> Column:
    """The payload as a string; bytes stay as they are."""
    return F.col("data").cast("string")


def entry_size() -> Column:
    """Bytes of an entry: payload, header and attributes."""
    own = F.aggregate("evs", F.lit(0), lambda a, e: a + F.octet_length(e["name"]) + F.coalesce(F.octet_length(e["raw"]), F.octet_length(e["value"]), F.lit(0)) + 9)
    return F.octet_length("data") + HEADER_BYTES + own


def ev(name: str, value: Column, kind: str = "string") -> Column:
    """One attribute."""
    if not name or len(name.encode()) > MAX_EV_NAME:
        raise ValueError(f"bad attribute name {name!r}")
    return F.struct(F.lit(name).alias("name"), F.lit(EV_ID[kind]).cast("short").alias("type_id"), value.cast("string").alias("value"), F.lit(None).cast("binary").alias("raw"))


def ev_upsert(evs: Column, new: Column, name: str) -> Column:
    """``evs`` with the attribute: in the place of those with its name, else at the end."""
    there = F.exists(evs, lambda e: e["name"] == name)
    return F.when(there, F.transform(evs, lambda e: F.when(e["name"] == name, new).otherwise(e))).otherwise(F.concat(evs, F.array(new)))


def ev_add_set(evs: Column, new: Sequence[tuple[str, Column]]) -> Column:
    """Several at once: onto no attributes they go as they are, repeated names too; else each replaces its name."""
    onto = evs
    for name, one in new:
        onto = ev_upsert(onto, one, name)
    return F.when(F.size(evs) == 0, F.array(*(one for _, one in new))).otherwise(onto)


def ev_get(name: str, evs: Column | str = "evs") -> Column:
    """The first value of that name, as text; null if there is none."""
    return F.get(F.filter(F.col(evs) if isinstance(evs, str) else evs, lambda e: e["name"] == name), F.lit(0))["value"]


def ev_clear(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Without attributes, or without those named."""
    return df.withColumn("evs", F.expr(NO_EVS) if names is None else F.filter("evs", lambda e: ~e["name"].isin(*names)))


def ev_valid() -> Column:
    """Whether names, values and their number keep within the limits."""
    each = lambda e: (F.length(e["name"]) > 0) & (F.octet_length(e["name"]) <= MAX_EV_NAME) & (F.coalesce(F.octet_length(e["raw"]), F.octet_length(e["value"]), F.lit(0)) <= MAX_EV_VALUE) & e["type_id"].between(1, 17)
    return (F.size("evs") <= MAX_BLOCK_EVS) & F.forall("evs", each)


def tag_error(tag: str) -> str | None:
    """Why a tag's name is not allowed; None if it is."""
    name = tag.strip()
    if not name:
        return "empty tag"
    if len(name.encode("utf-8")) > MAX_TAG_BYTES:
        return "tag too long"
    bad = [c for c in name if c in TAG_FORBIDDEN or c.isspace() or unicodedata.category(c)[0] in "CZ"]
    return f"forbidden characters {bad}" if bad else None


def check_tag(tag: str) -> str:
    if error := tag_error(tag):
        raise ValueError(f"tag {tag!r}: {error}")
    return tag.strip()


def remap_tag(tag: Column, by: str = "_") -> Column:
    """``tag`` with every forbidden character replaced."""
    if by and tag_error(by):
        raise ValueError("the replacement is not allowed either")
    inside = "".join("\\" + c if not c.isalnum() else c for c in dict.fromkeys(TAG_FORBIDDEN))
    return F.regexp_replace(F.trim(tag), rf"[\s\p{{C}}\p{{Z}}{inside}]", by)


_SECONDS_TO_1970 = 62135596800


def encode_timestamp(seconds: int, nanoseconds: int) -> bytes:
    """12 bytes: seconds since year 1 and nanoseconds, little-endian."""
    return struct.pack("<qI", seconds + _SECONDS_TO_1970, nanoseconds)


def decode_timestamp(raw: bytes) -> tuple[int, int]:
    seconds, nanoseconds = struct.unpack("<qI", raw)
    return seconds - _SECONDS_TO_1970, nanoseconds


def order(descending: bool = False) -> list[Column]:
    """Sort keys for time at full precision."""
    return [F.desc("ts"), F.desc("nsec_rem")] if descending else [F.asc("ts"), F.asc("nsec_rem")]


_FORMATS = {"bool": "<?", "byte": "<B", "int8": "<b", "int16": "<h", "uint16": "<H", "int32": "<i", "uint32": "<I", "int64": "<q", "uint64": "<Q", "float32": "<f", "float64": "<d", "duration": "<q"}


def encode_value(kind: str, value: object) -> bytes:
    """An attribute's value as bytes."""
    if kind in _FORMATS:
        return struct.pack(_FORMATS[kind], value)
    if kind == "timestamp":
        return encode_timestamp(*value)
    raw = value.encode("utf-8") if isinstance(value, str) else bytes(value)
    if len(raw) > MAX_EV_VALUE:
        raise ValueError("value too long")
    if kind == "ip" and len(raw) not in (4, 16):
        raise ValueError("an address has 4 or 16 bytes")
    if kind == "mac" and (not raw or len(raw) % 2 or len(raw) > 20):
        raise ValueError("a hardware address has an even number of bytes, at most 20")
    return raw


def decode_value(kind: str, raw: bytes) -> object:
    if kind in _FORMATS:
        return struct.unpack(_FORMATS[kind], raw)[0]
    if kind == "timestamp":
        return decode_timestamp(raw)
    return raw.decode("utf-8") if kind == "string" else bytes(raw)
