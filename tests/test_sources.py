"""Sources, framing, binary formats, sinks and streams."""

import gzip
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from emberlog.entry import entries, text
from emberlog.functions.net import to_bytes
from emberlog.functions.timeformats import Grinder
from emberlog.plans.search import Engine
from emberlog.sources import binary, framing, services, sinks
from emberlog.sources.generate import KINDS, generate
from emberlog.streaming.stateful import Parts, Shard, TokenBucket, reassemble_stream, sessions, throttled


def strings(df, column="data"):
    return sorted(bytes(r[column]).decode() for r in df.select(column).collect())


def test_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text('"2022-01-10 12:44:18 one"\r\n# skip\n\nskipme x\n')
    (tmp_path / "b.log.gz").write_bytes(gzip.compress(b"2022-01-11 12:44:18 two\n"))
    df = framing.read_lines(spark, str(tmp_path), "logs", Grinder(only=("DPKG",)), src="1.2.3.4", prefixes=["#"], globs=["skip*"], quotes=True, keep_name=True)
    rows = {bytes(r.data).decode(): r for r in df.collect()}
    assert set(rows) == {"2022-01-10 12:44:18 one", "2022-01-11 12:44:18 two"}
    assert rows["2022-01-11 12:44:18 two"].evs[0].value == "b.log.gz" and str(rows["2022-01-10 12:44:18 one"].ts) == "2022-01-10 12:44:18"


def test_framing(spark):
    one = spark.createDataFrame([("<34>1 a\n<35>1 b\nc", 'x--y--z {"a": 1}{"b":[2]} {bad', "start A|mid B|end")], "s string, j string, p string")
    r = one.select(framing.syslog_stream(F.col("s")).alias("s"), framing.syslog_stream(F.col("s"), True).alias("n"), framing.split_stream(F.col("j"), "--").alias("d"), framing.split_stream(F.col("p"), r"(?P<suffix>\|)").alias("suffix"), framing.split_stream(F.col("p"), r"(?P<prefix>\|)").alias("prefix"), framing.json_stream(F.lit(' {"a": 1}{"b":[2]} {bad')).alias("o")).first()
    assert r.s == ["<34>1 a", "<35>1 b\nc"] and r.n == ["1 a", "1 b\nc"] and r.d[:2] == ["x", "y"]
    assert r.suffix == ["start A|", "mid B|", "end"] and r.prefix == ["start A", "|mid B", "|end"] and r.o == ['{"a":1}', '{"b":[2]}']
    assert framing.octet_frames(b"5 hello11 hello\nworld99 short") == ["hello", "hello\nworld"]
    tags = one.select(framing.tag_by_field(F.lit('{"t":"x"}'), "t", {"x": "tx"}, "d").alias("a"), framing.tag_by_field(F.lit("no"), "t", {"x": "tx"}, "d").alias("b")).first()
    assert tuple(tags) == ("tx", "d")


def test_collector_times(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame([(v,) for v in ("1700000000", "1700000000123", "1700000000123456", "5", "-1", None)], "v string")
    got = [r.t for r in df.select(services.collector_time(F.col("v"), now).cast("string").alias("t")).collect()]
    assert got == ["2023-11-14 22:13:20", "2023-11-14 22:13:20.123", "2023-11-14 22:13:20.123456", "2024-01-01 00:00:00", None, "2024-01-01 00:00:00"]


def test_kafka_shape(spark):
    rows = [(b"v1", [("tag", b"good-1"), ("src", b"10.0.0.9")]), (b"v2", [("tag", b"evil")]), (b"v3", None)]
    df = spark.createDataFrame(rows, "value binary, headers array<struct<key: string, value: binary>>").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    got = {bytes(r.data): (r.tag, r.src) for r in services.kafka_entries(df, "dflt", tag_header="tag", source_header="src", allowed=["good*"]).collect()}
    assert got[b"v1"] == ("good-1", bytearray(to_bytes("10.0.0.9"))) and got[b"v2"][0] == "dflt" and got[b"v3"] == ("dflt", None)


def test_notifications(spark):
    body = '{"Records":[{"s3":{"bucket":{"name":"b"},"object":{"key":"a%2Fb+c"}}}]}'
    df = spark.createDataFrame([(body,), ('{"Message": ' + __import__("json").dumps(body) + "}",), ("{}",)], "v string")
    assert [tuple(r) for r in services.notified_objects(df, F.col("v")).collect()] == [("b", "a/b c")] * 2


def entry_rows(spark, n=50):
    return generate(spark, n, "evs", tag="gen", seed=3).drop("id")


def test_export_and_reimport(spark, tmp_path):
    df = entry_rows(spark)
    sinks.write_results(df, str(tmp_path / "json"))
    back = services.reimport_json(spark, str(tmp_path / "json"))
    pick = lambda d: sorted((r.ts, r.tag, bytes(r.src), bytes(r.data), tuple((e.name, e.value) for e in r.evs)) for r in d.collect())
    assert pick(back) == pick(df) and {e.type_id for r in back.collect() for e in r.evs} == {13}
    sinks.write_results(df, str(tmp_path / "csv"), "csv")
    back = services.reimport_csv(spark, str(tmp_path / "csv"), shift_s=60)
    assert sorted(bytes(r.data) for r in back.collect()) == sorted(bytes(r.data) for r in df.collect())
    assert back.agg(F.min("ts")).first()[0] > df.agg(F.min("ts")).first()[0]
    first = sinks.bulk_export(df, str(tmp_path / "bulk"))
    assert sinks.bulk_export(df, str(tmp_path / "bulk")) == [] and spark.read.text(str(tmp_path / "bulk")).count() == 50
    later = df.withColumn("ts", F.col("ts") + F.expr("INTERVAL 3 DAYS"))
    second = sinks.bulk_export(df.unionByName(later), str(tmp_path / "bulk"))
    assert second and not set(first) & set(second) and spark.read.text(str(tmp_path / "bulk")).count() == 100
    assert not [p for p in (tmp_path / "bulk").iterdir() if p.name.startswith("_new")]
    for form in ("text", "archive", "ipset"):
        sinks.write_results(df, str(tmp_path / form), form)
    with pytest.raises(ValueError):
        sinks.write_results(df, str(tmp_path / "x"), "nope")


def test_entry_table_prunes(spark, tmp_path):
    sinks.write_entries(entry_rows(spark), str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    found = Engine(table).search("gen", "2024-01-01", "2024-01-02").frame
    assert found.count() == 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "dt#" in filters and "tag#" in filters and "GreaterThanOrEqual(ts" in plan


def test_pcap_and_flows(spark, tmp_path):
    (tmp_path / "c.pcap").write_bytes(binary.write_pcap([(1_700_000_000_000_001, b"abc"), (1_700_000_000_000_002, b"de")]) + b"cut")
    df = binary.read_pcap(spark, str(tmp_path / "c.pcap"), "pcap")
    assert strings(df) == ["abc", "de"] and df.agg(F.max(F.unix_micros("ts"))).first()[0] == 1_700_000_000_000_002
    record = struct.pack(">IIIHHIIIIHHBBBBHHBBH", 1, 2, 3, 4, 5, 6, 7, 8, 9, 443, 80, 0, 24, 6, 1, 10, 11, 8, 9, 0)
    good = struct.pack(">HHIIIIBBH", 5, 2, 0, 1_700_000_000, 5001, 0, 0, 0, 0) + record * 2
    packets = spark.createDataFrame([(good,), (good[:60],), (b"\0\x09" + good[2:],)], "p binary")
    found = binary.flow_packets(packets, F.col("p"), "flow")
    assert [(r.nsec_rem, F and r.ts.microsecond) for r in found.collect()] == [(1, 5)]
    rows = binary.flow_records(found).collect()
    assert len(rows) == 2 and rows[0].asDict()["sport"] == 443 and rows[1].dst_mask == 9 and rows[1].proto == 6 and rows[0].src_as == 10


def template(template_id):
    body = struct.pack(">HHHH", template_id, 1, 8, 4)
    return struct.pack(">HH", 2, 4 + len(body)) + body


def message(*sets, domain=7):
    body = b"".join(sets)
    return struct.pack(">HHIII", 10, 16 + len(body), 0, 0, domain) + body


def test_template_sessions(spark):
    data = struct.pack(">HH", 300, 8) + b"\1\2\3\4"
    first, second, other = message(template(300)), message(data), message(struct.pack(">HH", 301, 8) + b"abcd")
    a, b, c, bad = binary.attach_templates([first, second, other, b"junk"])
    assert a == first and b == message(template(300), data) and c == other and bad == b"junk"


def test_template_sessions_stream(spark, tmp_path):
    data = struct.pack(">HH", 300, 8) + b"\1\2\3\4"
    rows = [(1, message(template(300))), (2, message(data))]
    df = spark.createDataFrame(rows, "us long, d binary")
    entries(df, ts=F.timestamp_micros("us"), data=F.col("d"), tag="ipfix").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = sessions(stream).writeStream.format("memory").queryName("sess").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(bytes(r.data) for r in spark.table("sess").collect()) == sorted([message(template(300)), message(template(300), data)])


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>head</t></is></c></row><row><c r="A2" t="s"><v>0</v></c><c r="C2"><v>1.5</v></c></row><row><c r="A3" s="1"><v>45000.5</v></c></row><row><c r="A4"/></row></sheetData></worksheet>'
    styles = f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}><si><t>a,b</t></si></sst>')
        z.writestr("xl/styles.xml", styles)
    (tmp_path / "x.xlsx").write_bytes(buffer.getvalue())
    assert strings(binary.read_xlsx(spark, str(tmp_path / "x.xlsx"), "sheet")) == ['"a,b",,1.5', "2023-03-15T12:00:00Z"]


def test_address_set():
    s = binary.AddressSet()
    for ip in (1, 70000, 0xFFFE0000):
        s.add(ip)
    s.remove(1)
    t = binary.AddressSet.decode(s.encode())
    assert not t.exists(1) and t.exists(70000) and not t.exists(70001) and not t.exists(0xFFFF0001)
    with pytest.raises(ValueError):
        s.add(0xFFFF0001)
    with pytest.raises(ValueError):
        binary.AddressSet.decode(b"junk")


def test_blobs_and_sorting(spark, tmp_path):
    (tmp_path / "s1").write_bytes(b"GET / \r\n\r\n")
    assert strings(framing.read_blobs(spark, str(tmp_path / "s1"), "session")) == ["GET / \r\n\r\n"]
    df = framing.sort_by_time(generate(spark, 200, "json", chaos=True))
    times = [r.ts for r in df.select("ts").collect()]
    assert times == sorted(times) and len(times) == 200


def test_generators(spark):
    for kind in KINDS:
        a, b = (generate(spark, 20, kind, seed=5).select("data").collect() for _ in range(2))
        assert a == b and len(a) == 20
    with pytest.raises(ValueError):
        generate(spark, 1, "nope")


def test_reassembly_state():
    p = Parts()
    for seq in (1, 0):
        p.add(5, "t", None, 3, seq, f"b{seq}")
    assert not p.complete(False) and Parts(p.row()).joined() == "b0b1"
    p.add(6, "t", None, 3, 0, "B0")
    assert p.complete(True) and not p.complete(False) and p.micros == 5
    one = Parts()
    one.add(1, "t", None, 1, 0, "x")
    assert one.complete(False) and not one.complete(True)


@pytest.fixture
def no_empty_batches(spark):
    """Time-outs would keep a query of what is there running for ever."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


@pytest.mark.parametrize("limit", [None, 1 << 20])
def test_reassembly_stream_equals_batch(spark, tmp_path, no_empty_batches, limit):
    from emberlog.operators.vendor import reassemble

    lines = [f"Oct 10 10:10:10 h CAT {i} 3 {s} b{i}{s};" for s in (2, 0, 1) for i in range(20)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lines)], "k long, v string")
    rows = entries(df, ts=F.timestamp_micros("k"), data=F.col("v"), tag="ise")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    found, name = reassemble_stream(source, latency_ms=600_000, max_total=limit, shards=4), f"parts_{limit}"
    q = found.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.table(name)
    assert strings(got) == strings(reassemble(rows)) and got.filter("complete").count() == 20


def test_oldest_messages_leave_first():
    shard = Shard()
    for now, key in ((1, "a"), (2, "b"), (3, "c"), (4, "a")):
        shard.add((key, "CAT", 1), now, now, "t", None, 3, now // 3, key * 10)
    assert shard.size == 40 and not list(shard.evicted(0, 40))
    again = Shard(shard.rows())
    assert again.size == 40 and again.rows() == shard.rows()
    assert [p.joined() for p in again.evicted(0, 25)] == ["b" * 10, "c" * 10] and again.size == 20
    assert [p.joined() for p in shard.evicted(2, 40)] == ["b" * 10]
    assert shard.take(("c", "CAT", 1)).size == 10 and [p.joined() for p in shard.evicted(9, 40)] == ["a" * 20] and shard.size == 0


def test_stream_to_table_and_tees(spark, tmp_path):
    entry_rows(spark).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for _ in range(2):  # the second run finds nothing new
        q = sinks.stream_entries(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    seen = []
    send = throttled(lambda batch, number: seen.append(batch.count()), rate=1e9, burst=1e9)
    sinks.stream_to(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), [send, send], str(tmp_path / "cp2")).awaitTermination(120)
    assert seen == [50, 50]


def test_token_bucket():
    now = [0.0]
    b = TokenBucket(10, 20, clock=lambda: now[0])
    assert b.wait(20) == 0 and b.wait(10) == 1.0
    now[0] = 5
    assert b.wait(1) == 0


def test_http_lines(spark):
    df = spark.createDataFrame([("a\nb\n",)], "b string")
    out = services.http_lines(df, F.col("b"), "web", params={"p": "1"}, grinder=None)
    assert strings(out) == ["a", "b"] and out.select(text()).count() == 2 and out.first().evs[0].name == "p"


def fetch_pages(mark):
    """A service of seven items, three a page."""
    at = int(mark or 0)
    items = [{"n": n} for n in range(at, min(at + 3, 7))]
    return items, str(at + len(items))


def test_follow_and_paged(spark, tmp_path):
    from emberlog.sources.datasources import _FollowReader, _PagedReader, follow

    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_bytes(b"one\ntwo\npart")
    reader = _FollowReader({"path": str(folder)})
    first = reader.latestOffset()
    lines = lambda a, b: [r[2] for p in reader.partitions(a, b) for r in reader.read(p)]
    assert lines(reader.initialOffset(), first) == ["one", "two"]
    (folder / "a.log").rename(folder / "b.log")
    with open(folder / "b.log", "ab") as f:
        f.write(b"ial\nthree\n")
    assert lines(first, reader.latestOffset()) == ["partial", "three"]
    q = follow(spark, str(folder)).writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert {r.value for r in spark.table("followed").collect()} == {"one", "two", "partial", "three"}
    finally:
        q.stop()
    paged_reader = _PagedReader({"fetch": f"{__name__}:fetch_pages"})
    rows, end = paged_reader.read(paged_reader.initialOffset())
    assert len(list(rows)) == 7 and end == {"mark": "7"} and len(list(paged_reader.readBetweenOffsets({"mark": "3"}, end))) == 4


def test_capture_files(spark):
    df = entry_rows(spark, 30)
    numbers = [r.number for r in sinks.capture_files(df.repartition(3), packets=4).collect()]
    assert len(numbers) > 3 and len(set(numbers)) == len(numbers)
    found = [p for r in sinks.capture_files(df, packets=4).collect() for p in binary.pcap_packets(bytes(r.content))]
    assert sorted(d for _, _, d in found) == sorted(bytes(r.data) for r in df.collect()) and len(found) == 30
