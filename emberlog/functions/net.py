"""Addresses: 16-byte form, numbers, ranges."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MAPPED = bytes(10) + b"\xff\xff"


def to_bytes(text: str) -> bytes:
    """16 bytes; IPv4 is mapped.  Also takes a decimal integer, or an even number of hex digits up to 32, right-aligned."""
    t = text.strip()
    try:
        a = ipaddress.ip_address(t)
        return _MAPPED + a.packed if a.version == 4 else a.packed
    except ValueError:
        pass
    if t.isdigit():
        return int(t).to_bytes(16, "big")
    h = t.removeprefix("0x")
    if h and len(h) % 2 == 0 and len(h) <= 32:
        return bytes.fromhex(h).rjust(16, b"\0")
    raise ValueError(f"no address: {text!r}")


def to_text(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    if len(raw) == 16 and raw.startswith(_MAPPED):
        raw = raw[12:]
    return str(ipaddress.ip_address(bytes(raw))) if len(raw) in (4, 16) else None


def cidr(text: str) -> tuple[bytes, bytes, int]:
    """(first, last, prefix length of 128) of a network or a single address."""
    net = ipaddress.ip_network(text.strip(), strict=False)
    first, last = net.network_address.packed, net.broadcast_address.packed
    if net.version == 4:
        return _MAPPED + first, _MAPPED + last, net.prefixlen + 96
    return first, last, net.prefixlen


def ipv4_binary(number: Column) -> Column:
    """The 16-byte form of an IPv4 address given as a number, without Python."""
    return F.unhex(F.concat(F.lit("00000000000000000000FFFF"), F.lpad(F.hex(number.cast("long")), 8, "0")))


def ipv4_number(src: Column) -> Column:
    """The number of a mapped IPv4 address; null for others."""
    tail = F.conv(F.hex(F.substring(src, -4, 4)), 16, 10).cast("long")
    return F.when((F.octet_length(src) == 4) | F.startswith(src, F.unhex(F.lit(_MAPPED.hex()))), tail)


def in_network(src: Column, network: str) -> Column:
    """Whether a 16-byte address lies in the network: two comparisons of bytes, which a Parquet scan can use."""
    first, last, _ = cidr(network)
    return F.coalesce((src >= F.lit(first)) & (src <= F.lit(last)), F.lit(False))


@F.pandas_udf(T.StringType())
def address_text(src: pd.Series) -> pd.Series:
    """The usual written form."""
    return src.map(to_text)


def ipv4_text(src: Column) -> Column:
    """The dotted form of a mapped IPv4 address, without Python; null for others."""
    n = ipv4_number(src)
    return F.when(n.isNotNull(), F.concat_ws(".", *(F.shiftrightunsigned(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0))))


@F.pandas_udf(T.BinaryType())
def address_bytes(text: pd.Series) -> pd.Series:
    """16 bytes of a written address; null if it is none."""

    def one(t: str | None) -> bytes | None:
        try:
            return None if t is None else to_bytes(t)
        except ValueError:
            return None

    return text.map(one)
