"""Services' formats: event collectors, delivery streams, Kafka, object stores, reimport, collectd, migration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..entry import DEFAULT_TAG, check_tag, entries, ev, remap_tag
from ..functions.jsonpath import raw_values
from ..functions.net import address_bytes, ipv4_binary
from ..functions.regexes import glob_to_regex, is_glob
from ..functions.timeformats import Grinder
from .framing import json_slices

_HEC = "time string, event string, host string, source string, sourcetype string, index string, fields map<string,string>"


def collector_time(value: Column, now: Column) -> Column:
    """Seconds, milliseconds above 1e10, microseconds above 1e13; below 1000 it is now, negative is an error (null)."""
    n = value.try_cast("double")
    seconds = F.when(n > 1e13, n / 1e6).when(n > 1e10, n / 1e3).otherwise(n)
    return F.when(value.isNull(), now).when(n < 0, F.lit(None).cast("timestamp")).when(n < 1000, now).otherwise(F.timestamp_micros(F.round(seconds * 1e6).cast("bigint")))


def collector_events(
    bodies: DataFrame, value: Column, tags: dict[str, str] | None = None, default: str = DEFAULT_TAG, now: Column | None = None, token: Column | None = None, tokens: dict[str, str] | None = None, tag: Column | None = None, sourcetype: Column | None = None
) -> DataFrame:
    """Bodies of concatenated JSON events as entries; host, source and fields are attributes.

    The payload is a string event's text, or another's bytes as they stand.  The
    tag is, by falling rank, that of the event's source type in ``tags``, the
    request's ``tag``, that of its ``sourcetype``, that of its ``token`` in
    ``tokens``, the default.  A request with a tag of forbidden characters gives none.
    """
    now = now if now is not None else F.current_timestamp()
    null = F.lit(None).cast("string")
    asked = bodies.select(value.alias("_v"), *(c.alias(n) if c is not None else null.alias(n) for n, c in (("_token", token), ("_tag", tag), ("_type", sourcetype))))
    asked = asked.filter(F.col("_tag").isNull() | (F.col("_tag") == "") | (remap_tag(F.col("_tag")) == F.col("_tag")))
    rows = asked.select("_token", "_tag", "_type", F.explode(json_slices(F.col("_v"))).alias("_j")).withColumn("_e", F.from_json("_j", _HEC))
    # only what is no string needs its own bytes
    other = F.col("_j").rlike(r'"event"\s*:\s*[^"\s]')
    raw = F.get(raw_values(F.when(other, F.col("_j")), [["event"]]), F.lit(0))
    rows = rows.withColumn("_raw", raw).withColumn("_data", F.when(F.col("_raw.kind") != "string", F.col("_raw.text")).otherwise(F.col("_e.event")))
    table = lambda names: F.create_map(*(F.lit(x) for k, v in (names or {"": default}).items() for x in (k, check_tag(v))))
    kinds = table(tags)
    base = F.array(*(ev(n, F.col(f"_e.{n}")) for n in ("host", "source")))
    fields = F.transform(F.map_entries(F.coalesce("_e.fields", F.create_map().cast("map<string,string>"))), lambda kv: F.struct(kv["key"].alias("name"), F.lit(13).cast("short").alias("type_id"), kv["value"].alias("value"), F.lit(None).cast("binary").alias("raw")))
    evs = F.filter(F.concat(base, fields), lambda e: e["value"].isNotNull())
    chosen = [F.nullif(F.col("_tag"), F.lit("")), kinds[F.coalesce("_type", F.lit("\0"))], table(tokens)[F.coalesce("_token", F.lit("\0"))], F.lit(check_tag(default))]
    out = entries(rows, ts=collector_time(F.col("_e.time"), now), data=F.col("_data"), tag=F.coalesce(kinds[F.coalesce("_e.sourcetype", F.lit(""))] if tags else null, *chosen), evs=evs)
    return out.filter("ts IS NOT NULL AND data IS NOT NULL")


def queued_records(records: DataFrame, data: Column, tag: str, arrived: Column | None = None, grinder: Grinder | None = None, attributes: dict[str, Column] | None = None) -> DataFrame:
    """Messages of a queue or shard as entries: the time found in them, else the service's time of arrival, else now; null attributes are left out."""
    now = F.current_timestamp()
    ts = F.coalesce(*([grinder.extract(data.cast("string"))] if grinder else []), *([arrived] if arrived is not None else []), now)
    evs = F.filter(F.array(*(ev(n, c.cast("string")) for n, c in attributes.items())), lambda e: e["value"].isNotNull()) if attributes else None
    return entries(records, ts=ts, data=data, tag=check_tag(tag), evs=evs)


def topic_messages(bodies: DataFrame, value: Column, tag: str) -> DataFrame:
    """A pull from a topic, as JSON: every received message's base64 data is an entry at its publish time, its attributes kept."""
    body = F.from_json(value, "receivedMessages array<struct<message: struct<data: string, messageId: string, publishTime: string, attributes: map<string,string>>>>")
    rows = bodies.select(F.explode(body["receivedMessages"]["message"]).alias("m"))
    evs = F.transform(F.map_entries(F.coalesce("m.attributes", F.create_map().cast("map<string,string>"))), lambda kv: F.struct(kv["key"].alias("name"), F.lit(13).cast("short").alias("type_id"), kv["value"].alias("value"), F.lit(None).cast("binary").alias("raw")))
    return entries(rows, ts=F.try_to_timestamp("m.publishTime"), data=F.unbase64("m.data"), tag=check_tag(tag), evs=evs).filter("ts IS NOT NULL")


def service_records(pages: DataFrame, value: Column, tag: str, items: str, id_path: str, time_path: str, seen: DataFrame | None = None) -> DataFrame:
    """Records of a service's pages of JSON (a list at ``items``, or the page itself) as entries: each id once, and none of ``seen`` (ids).

    The time is the record's own, else now.  What a service gives twice is taken once.
    """
    found = value if not items else F.get_json_object(value, f"$.{items}")
    rows = pages.select(F.explode(F.from_json(found, "array<string>")).alias("_r")).withColumn("_id", F.get_json_object("_r", f"$.{id_path}"))
    if seen is not None:
        rows = rows.join(seen.select(F.col(seen.columns[0]).cast("string").alias("_id")), "_id", "left_anti")
    once = rows.filter("_id IS NOT NULL").groupBy("_id").agg(F.min("_r").alias("_r")).select("_r").unionByName(rows.filter("_id IS NULL").select("_r"))
    ts = F.coalesce(F.try_to_timestamp(F.get_json_object("_r", f"$.{time_path}")), F.current_timestamp())
    return entries(once, ts=ts, data=F.col("_r"), tag=check_tag(tag))


def delivery_records(bodies: DataFrame, value: Column, tag: str) -> DataFrame:
    """A delivery stream's batch: every record's base64 data is an entry."""
    body = F.from_json(value, "requestId string, timestamp bigint, records array<struct<data: string>>")
    rows = bodies.select(body.alias("b")).select("b.timestamp", F.explode("b.records").alias("r"))
    return entries(rows, ts=F.timestamp_millis("timestamp"), data=F.unbase64("r.data"), tag=check_tag(tag))


def http_lines(bodies: DataFrame, value: Column, tag: str, multiline: bool = True, grinder: Grinder | None = Grinder(), params: dict[str, str] | None = None) -> DataFrame:
    """Request bodies as one entry each, or one a line; URL parameters are attributes."""
    from .framing import to_entries

    parts = F.split(value, r"\r?\n", -1) if multiline else F.array(value)
    rows = bodies.select(F.explode(F.filter(parts, lambda p: F.length(p) > 0)).alias("_m"))
    out = to_entries(rows, F.col("_m"), tag, grinder)
    return out.withColumn("evs", F.array(*(ev(k, F.lit(v)) for k, v in params.items()))) if params else out


def read_kafka(spark: SparkSession, servers: str, topics: Sequence[str], **options: str) -> DataFrame:
    """The stream of Kafka's records with headers; needs Spark's Kafka package on the class path."""
    return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "includeHeaders": "true"} | options).load()


def kafka_entries(records: DataFrame, default: str = DEFAULT_TAG, time: str = "message", tag_header: str | None = None, source_header: str | None = None, allowed: Sequence[str] = ("*",), grinder: Grinder = Grinder()) -> DataFrame:
    """Records (value, timestamp, headers) as entries; tags from a header count only if allowed, names or globs."""
    header = lambda name: F.get(F.filter("headers", lambda h: h["key"] == name), F.lit(0))["value"].cast("string")
    tag = F.lit(check_tag(default))
    if tag_header:
        named = header(tag_header)
        ok = F.lit(False)
        for a in allowed:
            ok |= named.rlike(glob_to_regex(a)) if is_glob(a) else named == a
        tag = F.when(F.coalesce(ok, F.lit(False)), named).otherwise(tag)
    caught = F.current_timestamp()
    ts = {"message": grinder.clamp(F.col("timestamp")), "ignore": caught, "extract": F.coalesce(grinder.extract(F.col("value").cast("string")), caught)}[time]
    src = address_bytes(header(source_header)) if source_header else None
    return entries(records, ts=ts, data=F.col("value"), tag=tag, src=src)


def trail_records(files: DataFrame, value: Column, tag: str) -> DataFrame:
    """Audit-trail files: every item of ``Records`` is an entry at its ``eventTime``; files without records give none."""
    rows = files.select(F.explode(F.from_json(value, "Records array<string>")["Records"]).alias("_r"))
    return entries(rows, ts=F.try_to_timestamp(F.get_json_object("_r", "$.eventTime")), data=F.col("_r"), tag=check_tag(tag)).filter("ts IS NOT NULL")


def read_objects(spark: SparkSession, path: str, tag: str, reader: str = "line", glob: str | None = None, name_ev: bool = False, stream: bool = False) -> DataFrame:
    """Objects of a store, line by line or as audit trails; a stream remembers in its checkpoint what it has read."""
    from .framing import read_lines

    if reader == "line":
        return read_lines(spark, path, tag, stream=stream, glob_filter=glob, keep_name=name_ev)
    source = (spark.readStream if stream else spark.read).option("wholetext", "true")
    source = source.option("pathGlobFilter", glob) if glob else source
    return trail_records(source.text(path), F.col("value"), tag)


def notified_objects(messages: DataFrame, value: Column) -> DataFrame:
    """(bucket, key) that notifications name, also inside another service's envelope."""
    inner = F.coalesce(F.get_json_object(value, "$.Message"), value)
    schema = "Records array<struct<s3: struct<bucket: struct<name: string>, object: struct<key: string>>>>"
    rows = messages.select(F.explode(F.from_json(inner, schema)["Records"]).alias("r"))
    return rows.select(F.col("r.s3.bucket.name").alias("bucket"), F.url_decode("r.s3.object.key").alias("key")).filter("bucket IS NOT NULL")


CSV_HEADER = ["Timestamp", "Source", "Tag", "Data"]


def reimport_csv(spark: SparkSession, path: str, shift_s: int = 0) -> DataFrame:
    """Exported CSV; the header must be exactly Timestamp,Source,Tag,Data."""
    rows = spark.read.option("header", "true").option("enforceSchema", "false").option("multiLine", "true").option("escape", '"').schema(", ".join(f"{c} string" for c in CSV_HEADER)).csv(path)
    return _reimported(rows, F.col("Timestamp"), F.col("Source"), F.col("Tag"), F.col("Data").cast("binary"), None, shift_s)


def reimport_json(spark: SparkSession, path: str, shift_s: int = 0) -> DataFrame:
    """Exported JSON lines, with the older field names or the newer; attributes come back as strings."""
    return exported_entries(spark.read.text(path), shift_s)


def exported_entries(rows: DataFrame, shift_s: int = 0) -> DataFrame:
    """The same from lines in a column ``value``."""
    e = rows.select(*(F.get_json_object("value", f"$.{n}").alias(f"_{k}") for k, n in enumerate(("TS", "Timestamp", "SRC", "Src", "Tag", "Data"))), F.from_json(F.get_json_object("value", "$.Enumerated"), "array<struct<Name: string, ValueStr: string>>").alias("_evs"))
    evs = F.transform(F.coalesce("_evs", F.array().cast("array<struct<Name: string, ValueStr: string>>")), lambda x: F.struct(x["Name"].alias("name"), F.lit(13).cast("short").alias("type_id"), x["ValueStr"].alias("value"), F.lit(None).cast("binary").alias("raw")))
    return _reimported(e, F.coalesce("_0", "_1"), F.coalesce("_2", "_3"), F.col("_4"), F.unbase64("_5"), evs, shift_s)


def _reimported(rows: DataFrame, ts: Column, src: Column, tag: Column, data: Column, evs: Column | None, shift_s: int) -> DataFrame:
    micros = F.try_to_timestamp(ts) + F.make_dt_interval(secs=F.lit(shift_s))
    nanos = F.coalesce(F.rpad(F.nullif(F.regexp_extract(ts, r"\.\d{6}(\d{1,3})", 1), F.lit("")), 3, "0").cast("int"), F.lit(0))
    return entries(rows, ts=micros, data=data, tag=tag, src=address_bytes(src), evs=evs, nsec_rem=nanos)


_COLLECTD = "values array<double>, dstypes array<string>, dsnames array<string>, time double, interval double, host string, plugin string, plugin_instance string, type string, type_instance string"


def collectd_values(df: DataFrame, value: Column, tag: str, plugin_tags: dict[str, str] | None = None) -> DataFrame:
    """A JSON entry for each value of each report; what is not a number is null; plugins may have tags of their own."""
    rows = df.select(F.explode(F.from_json(value, f"array<struct<{_COLLECTD.replace(' ', ': ').replace(',:', ',')}>>")).alias("r")).select("r.*", F.posexplode("r.values").alias("_k", "_v"))
    finite = F.when(~F.isnan("_v") & (F.abs("_v") != float("inf")), F.col("_v"))
    one = F.to_json(F.struct("host", "plugin", "plugin_instance", "type", "type_instance", F.get("dsnames", F.col("_k")).alias("dsname"), F.get("dstypes", F.col("_k")).alias("dstype"), "interval", finite.alias("value")), {"ignoreNullFields": "false"})
    to = F.lit(check_tag(tag))
    if plugin_tags:
        to = F.coalesce(F.create_map(*(F.lit(x) for k, v in plugin_tags.items() for x in (k, check_tag(v))))[F.col("plugin")], to)
    return entries(rows, ts=F.timestamp_micros(F.round(F.col("time") * 1e6).cast("bigint")), data=one, tag=to)


def migrated_rows(df: DataFrame, tags: dict[tuple[str, str], str], default: str = DEFAULT_TAG) -> DataFrame:
    """Rows of a foreign export (_time, _raw, index, sourcetype, others) as entries: index and source type choose the tag, other columns are attributes."""
    table = F.create_map(*(F.lit(x) for (i, s), t in tags.items() for x in (f"{i}\0{s}", check_tag(t))))
    key = F.concat(F.coalesce("index", F.lit("")), F.lit("\0"), F.coalesce("sourcetype", F.lit("")))
    rest = [c for c in df.columns if c not in ("_time", "_raw", "index", "sourcetype")]
    evs = F.filter(F.array(*(ev(c, F.col(c)) for c in rest)), lambda e: e["value"].isNotNull()) if rest else None
    return entries(df, ts=F.col("_time"), data=F.col("_raw"), tag=F.coalesce(table[key], F.lit(check_tag(default))), evs=evs)


def deltas(df: DataFrame, keys: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Counters as differences from the row before, by key; the first row of a key has none."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy("ts")
    return df.withColumns({c: F.col(c) - F.lag(c).over(w) for c in counters}).filter(F.col(counters[0]).isNotNull())


def events_as_entries(events: DataFrame, keep: Sequence[str] = ("event_id",)) -> DataFrame:
    """The ``events`` table as entries: an address made of the last 24 bits of the user's number, the type as tag, the properties as payload."""
    evs = F.array(ev("user_id", F.col("user_id"), "int64"), ev("value", F.col("value"), "float64"))
    return entries(events, ts=F.col("ts"), data=F.col("props"), tag=F.col("event_type"), src=ipv4_binary(F.lit(10 << 24) + F.pmod("user_id", F.lit(1 << 24))), evs=evs, keep=keep)
