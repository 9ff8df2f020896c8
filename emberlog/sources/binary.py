"""Binary formats: packet captures, flow records, spreadsheets, address sets."""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..entry import check_tag, entries
from ..functions.net import to_bytes

#: A flow record's fields, big-endian: name, offset, bytes.
FLOW_FIELDS = (
    ("src", 0, 4), ("dst", 4, 4), ("next", 8, 4), ("input", 12, 2), ("output", 14, 2), ("pkts", 16, 4), ("bytes", 20, 4), ("first", 24, 4), ("last", 28, 4), ("sport", 32, 2),
    ("dport", 34, 2), ("flags", 37, 1), ("proto", 38, 1), ("tos", 39, 1), ("src_as", 40, 2), ("dst_as", 42, 2), ("src_mask", 44, 1), ("dst_mask", 45, 1),
)
FLOW_HEADER, FLOW_RECORD, MAX_FLOWS = 24, 48, 30


def _number(data: Column, offset: Column | int, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, (F.lit(offset) if isinstance(offset, int) else offset) + 1, F.lit(size))), 16, 10).cast("bigint")


def flow_packets(df: DataFrame, packet: Column, tag: str, src: Column | None = None) -> DataFrame:
    """Valid version 5 packets as entries at their header's time."""
    rows = df.withColumn("_p", packet).filter(_valid(F.col("_p")))
    ts = F.timestamp_micros(_number(F.col("_p"), 8, 4) * 1_000_000 + F.floor(_number(F.col("_p"), 12, 4) / 1000))
    return entries(rows, ts=ts, data=F.col("_p"), tag=check_tag(tag), src=src, nsec_rem=F.pmod(_number(F.col("_p"), 12, 4), F.lit(1000)))


def _valid(p: Column) -> Column:
    count = _number(p, 2, 2)
    return (F.octet_length(p) >= FLOW_HEADER) & (_number(p, 0, 2) == 5) & count.between(1, MAX_FLOWS) & (F.octet_length(p) >= FLOW_HEADER + FLOW_RECORD * count)


def flow_records(packets: DataFrame) -> DataFrame:
    """A row for each record of version 5 packets (column ``data``), by byte expressions alone."""
    p = F.col("data")
    rows = packets.filter(_valid(p)).withColumn("_k", F.explode(F.sequence(F.lit(0), (_number(p, 2, 2) - 1).cast("int"))))
    at = F.col("_k") * FLOW_RECORD + FLOW_HEADER
    return rows.select("ts", F.col("_k").alias("record"), *(_number(p, at + offset, size).alias(name) for name, offset, size in FLOW_FIELDS))


def can_frames(df: DataFrame, frame: Column) -> DataFrame:
    """``df`` with ``can`` (id, extended, rtr, data) of a bus frame: address and flags in four bytes, length, data; null if it is cut short."""
    at = lambda k: _number(frame, k, 1)
    length = at(4).bitwiseAND(15)
    extended, address = at(3).bitwiseAND(0x80) != 0, at(0) + at(1) * 256 + at(2) * 65536 + at(3) * 16777216
    fields = [F.when(extended, address.bitwiseAND(0x1FFFFFFF)).otherwise(address.bitwiseAND(0x7FF)).alias("id"), extended.alias("extended"), (at(3).bitwiseAND(0x40) != 0).alias("rtr"), F.substring(frame, F.lit(6), F.octet_length(frame)).alias("data")]
    whole = (F.octet_length(frame) >= 5) & (F.octet_length(frame) >= 5 + length)
    return df.withColumn("can", F.when(whole, F.struct(*fields)))


def can_raw(buffer: Column) -> Column:
    """A frame as :func:`can_frames` reads it, from a reader's buffer of 16 bytes: the data moves over the three bytes before it, the rest goes; null for other sizes."""
    length = _number(buffer, 4, 1).bitwiseAND(15).cast("int")
    return F.when(F.octet_length(buffer) == 16, F.concat(F.substring(buffer, 1, 5), F.substring(buffer, F.lit(9), F.least(length, F.lit(8)))))


@F.pandas_udf(T.BinaryType())
def location_bytes(lat: pd.Series, lon: pd.Series) -> pd.Series:
    """A place in 16 bytes: latitude and longitude as little-endian doubles."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else struct.pack("<dd", a, b) for a, b in zip(lat, lon, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("long", T.DoubleType())]))
def location_of(raw: pd.Series) -> pd.DataFrame:
    """The place in 16 bytes or more; nulls for fewer, or outside the globe's degrees."""
    found = [struct.unpack("<dd", r[:16]) if r is not None and len(r) >= 16 else (None, None) for r in raw]
    return pd.DataFrame([(a, b) if a is not None and abs(a) <= 90 and abs(b) <= 180 else (None, None) for a, b in found], columns=["lat", "long"], dtype=float)


def ipfix_sets(packet: bytes) -> tuple[int, int, list[tuple[int, bytes]]] | None:
    """(version, domain, sets (id, bytes)) of a version 9 or 10 packet; None if it is broken."""
    if len(packet) < 16:
        return None
    version = struct.unpack_from(">H", packet)[0]
    if version not in (9, 10):
        return None
    head, domain_at = (20, 16) if version == 9 else (16, 12)
    if len(packet) < head:
        return None
    domain, sets, at = struct.unpack_from(">I", packet, domain_at)[0], [], head
    while at + 4 <= len(packet):
        set_id, size = struct.unpack_from(">HH", packet, at)
        if size < 4 or at + size > len(packet):
            return None
        sets.append((set_id, packet[at : at + size]))
        at += size
    return version, domain, sets


def attach_templates(packets: list[bytes], known: dict[int, bytes] | None = None) -> list[bytes]:
    """Packets of one session (domain and source), in order; those that lack a template which came before get it, others stay."""
    known, out = dict(known or {}), []
    for packet in packets:
        parsed = ipfix_sets(packet)
        if parsed is None:
            out.append(packet)
            continue
        version, _, sets = parsed
        template_set = 0 if version == 9 else 2
        here = set()
        for set_id, raw in sets:
            if set_id == template_set and len(raw) >= 8:
                template = struct.unpack_from(">H", raw, 4)[0]
                known[template] = raw
                here.add(template)
        lacking = [known[i] for i, _ in sets if i >= 256 and i not in here and i in known]
        if not lacking:
            out.append(packet)
            continue
        extra = b"".join(dict.fromkeys(lacking))
        head = 20 if version == 9 else 16
        body = bytearray(packet[:head] + extra + packet[head:])
        if version == 10:
            struct.pack_into(">H", body, 2, len(body))
        else:
            struct.pack_into(">H", body, 2, struct.unpack_from(">H", packet, 2)[0] + len(lacking))
        out.append(bytes(body))
    return out


def pcap_packets(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(microseconds, nanoseconds beyond, packet) of a capture file."""
    magic = content[:4]
    order = {b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">", b"\x4d\x3c\xb2\xa1": "<", b"\xa1\xb2\x3c\x4d": ">"}.get(magic)
    if order is None:
        return
    nano = magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")
    at = 24
    while at + 16 <= len(content):
        seconds, part, size, _ = struct.unpack_from(order + "IIII", content, at)
        if at + 16 + size > len(content):
            return
        yield seconds * 1_000_000 + (part // 1000 if nano else part), part % 1000 if nano else 0, content[at + 16 : at + 16 + size]
        at += 16 + size


def read_pcap(spark: SparkSession, path: str, tag: str, src: str | None = None) -> DataFrame:
    """A packet is an entry at its capture time; a file is a task's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for row in pcap_packets(bytes(content)):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["micros", "nsec", "data"])
                        rows = []
                yield pd.DataFrame(rows, columns=["micros", "nsec", "data"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "micros long, nsec int, data binary")
    return entries(rows, ts=F.timestamp_micros("micros"), data=F.col("data"), tag=check_tag(tag), src=F.lit(to_bytes(src)) if src else None, nsec_rem=F.col("nsec"))


def write_pcap(packets: list[tuple[int, bytes]], link: int = 1) -> bytes:
    """A capture file of (microseconds, packet)."""
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 0x3FFFFFFF, link)
    return head + b"".join(struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(p), len(p)) + p for us, p in packets)


_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def xlsx_rows(content: bytes) -> list[list[str]]:
    """Cells of the first sheet as text; dates in RFC 3339."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        dates = set()
        if "xl/styles.xml" in names:
            styles = ET.fromstring(z.read("xl/styles.xml"))
            own = {int(n.get("numFmtId")) for n in styles.iter(_S + "numFmt") if any(c in n.get("formatCode", "").lower() for c in ("yy", "mm", "dd", "hh"))}
            xfs = styles.find(_S + "cellXfs")
            dates = {k for k, x in enumerate(xfs if xfs is not None else []) if int(x.get("numFmtId", 0)) in own | set(range(14, 23))}
        sheet = ET.fromstring(z.read(sorted(n for n in names if n.startswith("xl/worksheets/sheet"))[0]))
    out = []
    for row in sheet.iter(_S + "row"):
        cells: list[str] = []
        for c in row.iter(_S + "c"):
            letters = "".join(x for x in c.get("r", "") if x.isalpha())
            column = 0
            for x in letters:
                column = column * 26 + ord(x) - 64
            cells += [""] * (column - 1 - len(cells)) if letters else []
            v = c.find(_S + "v")
            kind = c.get("t")
            if kind == "s" and v is not None:
                cells.append(shared[int(v.text)])
            elif kind == "inlineStr":
                cells.append("".join(t.text or "" for t in c.iter(_S + "t")))
            elif v is not None and int(c.get("s", 0)) in dates:
                cells.append((datetime(1899, 12, 30) + timedelta(days=float(v.text))).isoformat() + "Z")
            else:
                cells.append(v.text if v is not None else "")
        out.append(cells)
    return out


def read_xlsx(spark: SparkSession, path: str, tag: str, skip_first: bool = True) -> DataFrame:
    """A row of a spreadsheet is an entry, as a CSV record; blank rows go."""
    import csv

    @F.pandas_udf("array<string>")
    def records(contents: pd.Series) -> pd.Series:
        def one(content: bytes) -> list[str]:
            found = []
            for cells in xlsx_rows(bytes(content))[int(skip_first) :]:
                if any(cells):
                    out = io.StringIO()
                    csv.writer(out, lineterminator="").writerow(cells)
                    found.append(out.getvalue())
            return found

        return contents.map(one)

    rows = spark.read.format("binaryFile").load(path).select("modificationTime", F.explode(records(F.col("content"))).alias("_r"))
    return entries(rows, ts=F.col("modificationTime"), data=F.col("_r"), tag=check_tag(tag))


class AddressSet:
    """IPv4 addresses as bitmaps of 65536 each; 255.255.0.0/16 is not held.  For lookups on the driver and its file form; clusters use ``filters.ip_set``."""

    MAGIC = b"IPB1"

    def __init__(self) -> None:
        self.blocks: dict[int, bytearray] = {}

    def add(self, ip: int) -> None:
        if ip >> 16 == 0xFFFF:
            raise ValueError("255.255.0.0/16 is not supported")
        self.blocks.setdefault(ip >> 16, bytearray(8192))[(ip & 0xFFFF) >> 3] |= 1 << (ip & 7)

    def remove(self, ip: int) -> None:
        if ip >> 16 in self.blocks:
            self.blocks[ip >> 16][(ip & 0xFFFF) >> 3] &= ~(1 << (ip & 7)) & 0xFF

    def exists(self, ip: int) -> bool:
        block = self.blocks.get(ip >> 16)
        return block is not None and bool(block[(ip & 0xFFFF) >> 3] >> (ip & 7) & 1)

    def encode(self) -> bytes:
        return self.MAGIC + struct.pack("<I", len(self.blocks)) + b"".join(struct.pack("<H", k) + bytes(b) for k, b in sorted(self.blocks.items()))

    @classmethod
    def decode(cls, raw: bytes) -> AddressSet:
        if raw[:4] != cls.MAGIC or len(raw) != 8 + 8194 * (n := struct.unpack_from("<I", raw, 4)[0]):
            raise ValueError("no address set")
        out = cls()
        for k in range(n):
            at = 8 + 8194 * k
            out.blocks[struct.unpack_from("<H", raw, at)[0]] = bytearray(raw[at + 2 : at + 8194])
        return out
