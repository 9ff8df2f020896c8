"""Synthetic entries by rule: any number, any kind, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..entry import check_tag, entries, ev
from ..functions.net import ipv4_binary, ipv4_text

KINDS = ("binary", "bind", "csv", "dnsmasq", "fields", "json", "xml", "regex", "syslog", "zeekconn", "evs", "megajson")
_USERS, _HOSTS = ("ada", "grace", "alan", "edsger", "barbara", "donald"), ("alpha", "bravo", "charlie", "delta")


def _pick(values: tuple[str, ...], h: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(h, F.lit(len(values))).cast("int"))


def generate(spark: SparkSession, n: int, kind: str = "json", tag: str | None = None, start: str = "2024-01-01 00:00:00", span_s: int = 3600, seed: int = 0, chaos: bool = False, partitions: int | None = None) -> DataFrame:
    """``n`` entries over ``span_s`` seconds, in order or not."""
    if kind not in KINDS:
        raise ValueError(f"no kind {kind!r}")
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    h = lambda k: F.xxhash64("id", F.lit(seed), F.lit(k))
    at = F.pmod(h(0), F.lit(span_s * 1_000_000)) if chaos else (F.col("id").cast("double") * (span_s * 1e6 / max(n, 1))).cast("bigint")
    ts = F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + at)
    user, host, a, b = _pick(_USERS, h(1)), _pick(_HOSTS, h(2)), F.pmod(h(3), F.lit(1 << 24)) + (10 << 24), F.pmod(h(4), F.lit(1 << 32))
    ip, other = ipv4_text(ipv4_binary(a)), ipv4_text(ipv4_binary(b))
    when = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    port = F.pmod(h(5), F.lit(65536)).cast("string")
    row = F.struct(when.alias("time"), user.alias("account"), F.pmod(h(6), F.lit(1000)).alias("class"), F.array(host, user).alias("groups"), F.lit("agent/1.0").alias("user_agent"), ip.alias("ip"), host.alias("remote_host"), F.sha2(h(7).cast("string"), 256).alias("data"))
    text = {
        "json": F.to_json(row),
        "megajson": F.to_json(F.struct(row.alias("head"), F.array_repeat(row, 20).alias("items"))),
        "csv": F.concat_ws(",", when, user, host, ip, port),
        "fields": F.concat_ws("\t", when, user, host, ip, port),
        "xml": F.concat(F.lit("<event><time>"), when, F.lit("</time><user>"), user, F.lit("</user><ip>"), ip, F.lit("</ip></event>")),
        "regex": F.concat(when, F.lit(" ["), host, F.lit("] user="), user, F.lit(" from "), ip),
        "syslog": F.concat(F.lit("<"), F.pmod(h(8), F.lit(192)).cast("string"), F.lit(">1 "), when, F.lit(" "), host, F.lit(" "), user, F.lit(" 77 - - login from "), ip),
        "bind": F.concat(F.date_format(ts, "dd-MMM-yyyy HH:mm:ss.SSS"), F.lit(" queries: info: client "), ip, F.lit("#"), port, F.lit(" query: "), host, F.lit(".example.com IN A +")),
        "dnsmasq": F.concat(F.date_format(ts, "MMM d HH:mm:ss"), F.lit(" dnsmasq[77]: query[A] "), host, F.lit(".example.com from "), ip),
        "zeekconn": F.concat_ws("\t", F.format_string("%.6f", F.unix_micros(ts) / 1e6), F.concat(F.lit("C"), F.hex(h(9))), ip, port, other, F.lit("443"), F.lit("tcp"), F.lit("ssl"), F.format_string("%.5f", F.pmod(h(10), F.lit(100000)) / 1e4)),
        "evs": F.concat(user, F.lit(" on "), host),
        "binary": F.unhex(F.sha2(h(7).cast("string"), 512)),
    }[kind]
    evs = F.array(ev("user", user), ev("port", port, "uint16"), ev("size", F.pmod(h(11), F.lit(1 << 20)), "int64")) if kind == "evs" else None
    return entries(ids, ts=ts, data=text, tag=check_tag(tag or kind), src=ipv4_binary(a), evs=evs, keep=["id"])
