"""Operators on small inputs with known results."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from emberlog.entry import check_tag, decode_timestamp, decode_value, encode_timestamp, encode_value, entries, ev, ev_get, tag_error, text
from emberlog.functions.jsonpath import split_paths, split_quoted
from emberlog.functions.net import to_bytes, to_text
from emberlog.functions.regexes import Pattern, glob_to_regex
from emberlog.functions.timeformats import Grinder, custom_format
from emberlog.operators import filters, rewriters, routers, timestamps, vendor
from emberlog.operators.forward import Forwarder, RingBuffer, encode_json, tolerant_plugin
from emberlog.plans.config import parse, parse_bool
from emberlog.plans.pipeline import ConfigError, Pipeline, only_tags
from emberlog.plans.search import Alert, Engine, Extraction, Schedule


def make(spark, rows, tag="default", src="192.168.1.1"):
    """rows: payloads, or (payload, tag, src)."""
    full = [(k, *(r if isinstance(r, tuple) else (r, tag, src))) for k, r in enumerate(rows)]
    full = [(k, d if isinstance(d, bytes) else d.encode(), t, to_bytes(s)) for k, d, t, s in full]
    df = spark.createDataFrame(full, "k int, d binary, t string, s binary")
    return entries(df, ts=F.lit("2020-01-01").cast("timestamp"), data=F.col("d"), tag=F.col("t"), src=F.col("s"), evs=F.array(ev("testing", F.lit("yes"))), keep=["k"])


def out(df, *extra):
    rows = df.select("k", text().alias("d"), "tag", ev_get("testing").alias("testing"), *extra).collect()
    return sorted(rows, key=lambda r: (r.k, r.d))


def payloads(df):
    return [r.d for r in out(df)]


def tags(df):
    return [(r.k, r.tag) for r in out(df)]


def test_json_extract(spark):
    df = make(spark, ['{"foo": 99, "bar": "hello", "foobar": {"baz": 4.12}}', '{"foo": 1.40, "x": "a\\"b"}', "not json", '{"none": 1}'])
    assert payloads(df.transform(rewriters.JsonExtract("foo,bar,foobar.baz"))) == ['{"foo":99,"bar":"hello","baz":4.12}', '{"foo":1.40}', "not json", '{"none": 1}']
    assert payloads(df.transform(rewriters.JsonExtract("foo,bar", drop_misses=True))) == ['{"foo":99,"bar":"hello"}', '{"foo":1.40}', '{"none": 1}']
    assert payloads(df.transform(rewriters.JsonExtract("foo,bar", strict=True, drop_misses=True))) == ['{"foo":99,"bar":"hello"}']
    assert payloads(df.transform(rewriters.JsonExtract("x"))) == ['{"foo": 99, "bar": "hello", "foobar": {"baz": 4.12}}', 'a\\"b', "not json", '{"none": 1}']
    dotted = make(spark, ['{"foo": 99, "bar": "hello", "foo.bar": {"baz": 4.12}}'])
    got = out(dotted.transform(rewriters.JsonExtract('foo,bar,"foo.bar".baz')))
    assert got[0].d == '{"foo":99,"bar":"hello","baz":4.12}' and got[0].testing == "yes"
    with pytest.raises(ValueError):
        rewriters.JsonExtract("a", strict=True)


def test_json_array_split(spark):
    df = make(spark, ['{"foo": {"bar": ["a", "b", 1.4, {"stuff": "things"}]}, "foobar": "barbaz", "barbaz": 99}', '{"x":1}', "bad{"])
    assert sorted(payloads(df.transform(rewriters.JsonArraySplit("foo.bar")))) == sorted(["a", "b", "1.4", '{"stuff": "things"}', '{"x":1}'])
    forced = payloads(df.transform(rewriters.JsonArraySplit("foo.bar", additional="foobar,barbaz", drop_misses=True)))
    assert '{"bar":"a","foobar":"barbaz","barbaz":99}' in forced and len(forced) == 4
    bare = make(spark, ['[{"foo":"bar"}, {"bar":"foo"}]'])
    assert payloads(bare.transform(rewriters.JsonArraySplit())) == ['{"bar":"foo"}', '{"foo":"bar"}']


@pytest.mark.parametrize("logic,action,kept", [("and", "pass", [0]), ("and", "drop", [1, 2, 3]), ("or", "pass", [0, 1, 2]), ("or", "drop", [3])])
@pytest.mark.parametrize("raw", [True, False])
def test_json_filter(spark, logic, action, kept, raw):
    df = make(spark, ['{"f1":"foo", "f2":{"f3":"X"}}', '{"f1":"foo", "f2":"zappa"}', '{"f1":"no", "f2":{"f3":"Y"}}', "nothing"])
    stage = filters.JsonFilter({"f1": ["foo", "bar"], "f2.f3": ["X", "Y"]}, logic, action, raw)
    assert [r.k for r in out(df.transform(stage))] == kept


def test_json_filter_with_a_large_set(spark):
    df = make(spark, ['{"f":"v7"}', '{"f":"w"}'])
    assert [r.k for r in out(df.transform(filters.JsonFilter({"f": [f"v{n}" for n in range(1500)]})))] == [0]


def test_json_router(spark):
    df = make(spark, ['{"a":"login"}', '{"a":"logout"}', '{"a":"error"}', '{"a":"unknown"}', "{bad"])
    routes = ["login:logintag", "logout:logouttag", "error:"]
    assert tags(df.transform(routers.JsonRouter("a", routes))) == [(0, "logintag"), (1, "logouttag"), (3, "default"), (4, "default")]
    assert tags(df.transform(routers.JsonRouter("a", routes, drop_misses=True))) == [(0, "logintag"), (1, "logouttag")]
    with pytest.raises(ValueError):
        routers.JsonRouter("a", ["x:y", "x:z"]).table()


def test_csv_router(spark):
    df = make(spark, ["a,foo,c", "a,baz,c", "UncleEddy", 'internal,quotes,foo"bar', "a,     foo,c", 'a,"bar",x', '"a,b",foo', 'a"b,foo,c'])
    got = tags(df.transform(routers.CsvRouter(1, ["foo:footag", "bar:bartag", "baz:"])))
    assert got == [(0, "footag"), (2, "default"), (3, "default"), (4, "footag"), (5, "bartag"), (6, "footag"), (7, "default")]


def test_source_router(spark):
    routes = ["1.1.1.1:foo", "2.2.2.2:bar", "3.3.3.3:", "4.4.4.4:", "6.0.0.0/8:", "7.7.0.0/16:foo", "8.8.8.0/24:bar", "7.7.7.0/24:inner", "fe80::/10:six"]
    df = make(spark, [("x", "default", s) for s in ("1.1.1.1", "3.3.3.3", "5.5.5.5", "6.6.6.6", "7.7.8.7", "8.8.8.8", "7.7.7.7", "fe80::1")])
    want = [(0, "foo"), (2, "default"), (4, "foo"), (5, "bar"), (6, "inner"), (7, "six")]
    assert tags(df.transform(routers.SourceRouter(routes))) == want
    many = routes + [f"9.{n >> 8}.{n & 255}.0/24:nine" for n in range(600)]
    assert tags(df.transform(routers.SourceRouter(many))) == want
    for bad in ("1.1.1.1", "xyzzy:foobar", "1234::", "1.1.1.1:x!f_$$$"):
        with pytest.raises(ValueError):
            routers.SourceRouter([bad]).table()


def test_tag_router(spark):
    df = make(spark, [("x", "alpha", "1.1.1.1"), ("x", "bravo", "2.2.2.2"), ("x", "bravo", "22.22.22.22"), ("x", "charlie", "3.3.3.3"), ("x", "charlie", "33.33.33.33")])
    got = tags(df.transform(routers.TagRouter(["alpha:foxtrot", "bravo:echo:2.2.2.2", "charlie:delta:3.0.0.0/8"])))
    assert [t for _, t in got] == ["foxtrot", "echo", "bravo", "delta", "charlie"]


def test_syslog_router(spark):
    df = make(spark, ["<34>1 2003-10-11T22:14:15.003Z foobar su - ID47 - msg", "<34>1 2003-10-11T22:14:15.003Z barbaz - - ID47 - msg", "<13>Oct 11 22:14:15 box very.large.syslog.message.tag: hi", "<13>Oct 11 22:14:15 box foo!bar#baz: hi", "no syslog"])
    more = make(spark, ["<34>1 t h a p m [x@1 k=\"v\"] body\x01here", "<34>1 t h a p m -\n", "<34>1 t h a p m - \n", "<13>Oct 11 22:14:15 box app[7]: hi\nthere", "<34>1 t\x01u h a p m -"] + [r.data.decode() for r in df.collect()])
    both = routers.with_syslog_parts(more, text()).select("_s", *(c.alias(f"p_{n}") for n, c in routers.syslog_parts(text()).items())).collect()
    for r in both:
        assert (r._s is None) == (r.p_Priority is None) and (r._s is None or all(r._s[n] == r[f"p_{n}"] for n in routers.SYSLOG_PARTS)), r
    got = [t for _, t in tags(df.transform(routers.SyslogRouter("${Hostname}-${Appname}")))]
    assert got == ["foobar-su", "barbaz-", "box-very_large_syslog_message_tag", "box-foo_bar#baz", "default"]
    assert len(tags(df.transform(routers.SyslogRouter("${Hostname}", drop_misses=True)))) == 4


def test_regex_stages(spark):
    df = make(spark, ["101 THINGS STUFF", "nothing", "user@example.com"])
    got = out(df.transform(rewriters.RegexExtract(r"\d+\s+(?P<things>\S+)\s+(?P<stuff>\S+)", "${_SRC_} ${stuff}", attach=["things"])), ev_get("things").alias("things"))
    assert got[0].d == "192.168.1.1 STUFF" and got[0].things == "THINGS" and got[1].d == "nothing" and got[1].things is None
    replaced = out(df.transform(rewriters.regex_replace(r"(\w+)@(\w+\.\w+)", "$1 at $2")))
    assert replaced[2].d == "user at example.com" and replaced[2].testing is None
    assert payloads(make(spark, ["This is a test string with test words"]).transform(rewriters.regex_replace("test", "replacement", True))) == ["This is a replacement string with replacement words"]
    assert payloads(make(spark, ["a Test"]).transform(rewriters.regex_replace("test", "x$$"))) == ["a x$"]
    assert payloads(df.transform(filters.regex_drop("THING"))) == ["nothing", "user@example.com"]
    assert payloads(df.transform(filters.regex_drop("THING", invert=True))) == ["101 THINGS STUFF"]
    for bad in (r"(?=x)", r"(a)\1", ""):
        with pytest.raises(ValueError):
            Pattern(bad)


def test_times(spark):
    df = make(spark, ["foobar=2009-11-10T23:00:00Z BAR", '{"foo":{"bar":"2009-11-10T23:00:00Z"}}', "none"])
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")
    got = out(df.transform(timestamps.regex_time(r"foobar=(?P<ts>\S+)\s", "ts", Grinder(override="RFC3339"))), stamp)
    assert [r["at"] for r in got] == ["2009-11-10 23:00:00", "2020-01-01 00:00:00", "2020-01-01 00:00:00"]
    got = out(df.transform(timestamps.json_time("foo.bar", Grinder(only=("RFC3339",)))), stamp)
    assert [r["at"] for r in got][1:] == ["2009-11-10 23:00:00", "2020-01-01 00:00:00"]
    with pytest.raises(ValueError):
        Grinder(override="nope")
    with pytest.raises(ValueError):
        custom_format("x", "y", "")


FORMATS = {
    "AnsiC": ("this is AnsiC Jan 10 12:44:18 2022", "2022-01-10 12:44:18"),
    "Unix": ("some Unix Jan 10 12:44:18 UTC 2022", "2022-01-10 12:44:18"),
    "Ruby": ("ruby format Jan 10 12:44:18 +0000 2022", "2022-01-10 12:44:18"),
    "RFC822": ("stuff 10 Jan 22 12:44 UTC", "2022-01-10 12:44:00"),
    "RFC822Z": ("stuff 10 Jan 22 12:44 +0000", "2022-01-10 12:44:00"),
    "RFC850": ("10-Jan-22 12:44:18 UTC", "2022-01-10 12:44:18"),
    "RFC1123": ("stuff 10 Jan 2022 12:44:18 UTC ", "2022-01-10 12:44:18"),
    "RFC1123Z": ("stuff 10 Jan 2022 12:44:18 +0000 ", "2022-01-10 12:44:18"),
    "RFC3339": ("lsdkfj 2022-01-10T12:44:18Z00:00", "2022-01-10 12:44:18"),
    "RFC3339Nano": ("lsdkfj 2022-01-10T12:44:18.123456000Z00:00", "2022-01-10 12:44:18.123456"),
    "ZonelessRFC3339": ("lsdkfj 2022-01-10T12:44:18.123456000", "2022-01-10 12:44:18.123456"),
    "Apache": ("apache 10/Jan/2022:12:44:18 +0000", "2022-01-10 12:44:18"),
    "ApacheNoTz": ("apache 10/Jan/2022:12:44:18", "2022-01-10 12:44:18"),
    "NGINX": ("nginx 2022/01/10 12:44:18", "2022-01-10 12:44:18"),
    "Syslog": ("xyz Dec 31 12:44:18", "2021-12-31 12:44:18"),
    "SyslogFile": ("sf 2022-01-10T12:44:18.123456000+00:00", "2022-01-10 12:44:18.123456"),
    "SyslogFileTZ": ("sf 2022-01-10T12:44:18.123456000+0000", "2022-01-10 12:44:18.123456"),
    "SyslogVariant": ("sf Jan 10 2022 12:44:18", "2022-01-10 12:44:18"),
    "DPKG": ("dpgk 2022-01-10 12:44:18", "2022-01-10 12:44:18"),
    "UnpaddedDateTime": ("2022-1-10 12:44:18", "2022-01-10 12:44:18"),
    "UnpaddedMilliDateTime": ("2022-1-10 12:44:18.123456000", "2022-01-10 12:44:18.123456"),
    "MonthDayYear": ("1-10-2022 12:44:04.12345", "2022-01-10 12:44:04.12345"),
    "Bind": ("10-Jan-2022 12:44:04.123", "2022-01-10 12:44:04.123"),
    "UK": ("10/01/2022 12:44:04,12345", "2022-01-10 12:44:04.12345"),
    "LDAP": ("132862922580000000 ldap garbage", "2022-01-10 12:44:18"),
    "UnixSeconds": ("1641818658 unix", "2022-01-10 12:44:18"),
    "UnixMs": ("1641818658123 unix", "2022-01-10 12:44:18.123"),
    "UnixNano": ("1641818658123456000 unix", "2022-01-10 12:44:18.123456"),
    "UnixMilli": ("1641818658.0 unix", "2022-01-10 12:44:18"),
    "DirectAdmin": ("2022:12:16-15:14:23: 'x' failed", "2022-12-16 15:14:23"),
    "TimePicker": ("07/01/2025 11:25:36 AM", "2025-07-01 11:25:36"),
}


def test_all_formats(spark):
    now = F.lit("2022-03-01").cast("timestamp")
    df = spark.createDataFrame([(n, v) for n, (v, _) in FORMATS.items()], "n string, v string")
    columns = [F.when(F.col("n") == n, Grinder(override=n, only=(n,), now=now).extract(F.col("v")).cast("string")) for n in FORMATS]
    got = dict(df.select("n", F.coalesce(*columns).alias("ts")).collect())
    assert got == {n: ts for n, (_, ts) in FORMATS.items()}


def test_first_format_wins_and_window(spark):
    df = spark.createDataFrame([("2022-01-10 12:44:18 and 2024-01-10 12:44:18",)], "v string")
    now = F.lit("2024-02-01").cast("timestamp")
    got = df.select(Grinder(now=now, only=("DPKG",)).extract(F.col("v")).cast("string").alias("a"), Grinder(now=now, only=("DPKG",), past=86400 * 60, future=60).extract(F.col("v")).cast("string").alias("b"), Grinder(now=now, only=("DPKG", "NGINX"), leftmost=True).extract(F.col("v")).cast("string").alias("c")).first()
    assert tuple(got) == ("2022-01-10 12:44:18", "2024-01-10 12:44:18", "2022-01-10 12:44:18")


def test_gzip(spark):
    df = make(spark, [gzip.compress(b"hello"), b"plain", gzip.compress(b"x" * 100)[:20]])
    assert payloads(df.transform(rewriters.gunzip_entries())) == ["hello"]
    assert payloads(df.transform(rewriters.gunzip_entries(passthrough=True))) == ["hello", "plain"]


def test_attach(spark):
    df = make(spark, ["x"]).transform(rewriters.Attach([("a", "1"), ("testing", "new"), ("host", "$HOSTNAME"), ("at", "$NOW")]))
    r = out(df, ev_get("a").alias("a"), ev_get("host").alias("host"), ev_get("at").alias("at"), F.size("evs").alias("n"))[0]
    assert r.a == "1" and r.testing == "new" and r.host and r["at"] and r.n == 4
    for bad in ([("a", "$UUID")], [("a", "1"), ("a", "2")], [("", "x")], [("a", "")], []):
        with pytest.raises(ValueError):
            rewriters.Attach(bad)


def test_monitor_tsv(spark):
    row = {"_path": "conn", "ts": "2020-08-16T06:26:03.553287Z", "uid": "C1\tx", "id.orig_h": "10.0.0.1", "id.orig_p": 443.0, "duration": 0.066851, "local_orig": True, "service": None}
    df = make(spark, ["junk " + json.dumps(row), '{"_path":"unknown","ts":"2020-08-16T06:26:03Z"}', "none"])
    got = out(df.transform(vendor.MonitorTsv(custom=["foobar:ts,this"])))
    cells = got[0].d.split("\t")
    assert got[0].tag == "zeekconn" and cells[:5] == ["1597559163.553287", "C1 x", "10.0.0.1", "443", "-"] and cells[7:9] == ["<nil>", "0.06685"] and "true" in cells and len(cells) == 22
    assert [r.tag for r in got[1:]] == ["default", "default"] and len(vendor.HEADERS) == 41


def test_flow_log(spark):
    events = [{"id": str(n), "timestamp": 1, "message": f"m{n}", "extractedFields": {"start": "100"}} for n in range(4)]
    good, bad = json.dumps({"owner": "o", "logEvents": events}), json.dumps({"logEvents": [events[0], {"id": "x", "message": "m", "extractedFields": {"start": "soon"}}]})
    got = out(make(spark, [good, gzip.compress(good.encode()), bad]).transform(vendor.flow_log_split()), F.unix_seconds("ts").alias("s"))
    assert [r.d for r in got] == ["m0", "m1", "m2", "m3"] * 2 and {r.s for r in got} == {100}


def test_identity_messages(spark):
    message = "2020-11-23 12:50:01.926 -05:00 0089414462 5200 NOTICE Passed-Authentication: Authentication succeeded, ConfigVersionId=1, UserName=a\\,b, Step=11001, Step=11002, NoValue, A B=c=d"
    df = make(spark, [message, "other"])
    row = json.loads(payloads(df.transform(vendor.IdentityFormat("json", ["Step=*"])))[0])
    assert row["Attributes"] == {"ConfigVersionId": "1", "UserName": "a,b", "A B": "c=d"} and row["Text"] == "Authentication succeeded" and row["Sequence"] == 89414462
    cef = payloads(df.transform(vendor.IdentityFormat("cef")))[0]
    assert cef.startswith("CEF:0|CISCO|ISE_DEVICE|||Passed-Authentication|NOTICE| sequence=0089414462 ode=5200") and " AB=c\\=d" in cef
    assert out(df.transform(vendor.IdentityFormat("raw")), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))[0]["at"] == "2020-11-23 17:50:01.926"
    assert vendor.strip_header("cisco-av-pair", "mdm-tlv=device=mac") == ("device", "mac") and vendor.strip_header("a", "(x=y)") == ("a", "(x=y)")


def test_reassembly(spark):
    line = "<181>Oct 10 10:10:10 host CAT 7 3 {} body{};"
    rows = [line.format(n, n) for n in (2, 0, 1)] + ["plain", "<181>Oct 10 10:10:10 host CAT 8 2 1 last", "<181>Oct 10 10:10:10 host CAT 9 2 5 bad"]
    df = make(spark, rows).drop("k")
    got = sorted(r.d for r in vendor.reassemble(df).select(text().alias("d")).collect())
    assert got == sorted(["body0;body1;body2;", "plain", "last", rows[5]])
    assert sorted(r.d for r in vendor.reassemble(df, exact=True).select(text().alias("d")).collect()) == sorted(["body0;body1;body2;", "plain", rows[5]])


def test_parts_are_matched_alike(spark):
    """Once with marks or group by group: the same columns, for line ends, marks in payloads, zones and numbers out of range."""
    line = "<181>Oct 10 10:10:10 {}host CAT 7 3 {} body{}"
    rows = [line.format("", 0, ""), line.format("+1:00 ", 1, " x\n"), line.format("", 2, "\x01y\x01"), line.format("\x01", 2, ""), line.format("12:30 ", 0, "a\nb"), line.format("", 4, ""), line.format("", 99999999999999999999, ""), "Oct 10 10:10:10 h c 5000000000 1 0 b", "", "plain"]
    df = make(spark, rows)
    names = ("host", "cat", "id", "total", "seq", "body")
    want = df.select("k", *(c.alias(n) for n, c in vendor.part_columns(text()).items()))
    got = vendor.with_parts(df).select("k", *(F.col(f"_{n}").alias(n) for n in names))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.filter("id IS NOT NULL").count() >= 4


def test_repeated_parts(spark):
    line = "Oct 10 10:10:10 host CAT 7 2 {} {}"
    df = make(spark, [line.format(0, "old"), line.format(1, "-b"), line.format(0, "new")]).drop("k")
    df = df.withColumn("ts", F.when(text().endswith("new"), F.timestamp_seconds(F.lit(20))).otherwise(F.timestamp_seconds(F.lit(10))))
    got = vendor.reassemble(df, exact=True).select(text().alias("d"), F.unix_seconds("ts").alias("s")).collect()
    assert [tuple(r) for r in got] == [("new-b", 10)]


def test_split_unescaped():
    for value in ("", "a", ",", "a,b", r"a\,b", r"a\\,b", r"a\\\,b,", "a\\", r"\,\,,", "\\,"):
        parts, now, escaped = [], "", False
        for c in value:
            if c == "," and not escaped:
                parts, now = [*parts, now], ""
            else:
                now += c
            escaped = c == "\\" and not escaped
        assert vendor.split_unescaped(value, ",") == [*parts, now], value


def test_tags_codecs_and_addresses():
    assert tag_error("foo_bar#baz") is None and check_tag(" ok-1@? ") == "ok-1@?"
    for bad in ("", "a b", "a.b", "a/b", "x!y", "a’b", "a\tb", "a" * 5000):
        assert tag_error(bad)
    assert decode_timestamp(encode_timestamp(1641818658, 123456789)) == (1641818658, 123456789) and len(encode_timestamp(0, 0)) == 12
    for kind, value in (("bool", True), ("uint64", 2**64 - 1), ("int8", -5), ("float32", 1.5), ("string", "é"), ("timestamp", (5, 6)), ("duration", -7), ("mac", b"\1\2\3\4\5\6")):
        assert decode_value(kind, encode_value(kind, value)) == value
    for kind, value in (("ip", b"123"), ("mac", b"123"), ("mac", b"")):
        with pytest.raises(ValueError):
            encode_value(kind, value)
    assert to_text(to_bytes("10.1.2.3")) == "10.1.2.3" and to_bytes("1")[-1] == 1 and to_bytes("00ff")[-1] in (255, 99) and to_text(to_bytes("fe80::1")) == "fe80::1"
    with pytest.raises(ValueError):
        to_bytes("xyz")


def test_quoted_paths_and_globs():
    import re

    assert split_quoted('foo."a.b".c') == ["foo", "a.b", "c"] and split_quoted(r"a\.b.c") == ["a.b", "c"]
    assert split_paths('foo,bar,"foo.bar".baz') == [["foo"], ["bar"], ["foo.bar", "baz"]]
    with pytest.raises(ValueError):
        split_quoted('"open')
    for glob, yes, no in (("a*c", "abbc", "abb"), ("a?c", "abc", "abbc"), ("[ab]x", "bx", "cx"), ("[!ab]x", "cx", "ax"), ("{foo,bar}1", "bar1", "baz1"), ("a.b", "a.b", "axb")):
        assert re.match(glob_to_regex(glob), yes) and not re.match(glob_to_regex(glob), no)


def test_config_and_pipeline(spark):
    config = parse('[Global]\nA=1\nA=2\n# no\n[preprocessor "x"]\n\tType = RegexDrop\n\tRegex = "a\\"b" # why\n[preprocessor "y"]\nType=nope\n[preprocessor "z"]\nType=jsonextract\n')
    assert config[("global", "")].many("a") == ["1", "2"] and config[("preprocessor", "x")].one("Regex") == 'a"b'
    df = make(spark, ['a"b', "c"])
    assert payloads(Pipeline.from_config(config, ["x"])(df)) == ["c"] and payloads(Pipeline([])(df)) == ['a"b', "c"]
    for names in (["y"], ["z"], ["missing"]):
        with pytest.raises(ConfigError):
            Pipeline.from_config(config, names)
    assert parse_bool("Yes") and not parse_bool("f")
    with pytest.raises(ValueError):
        parse_bool("maybe")

    def broken(df):
        raise RuntimeError("no")

    p = Pipeline([("bad", broken), ("drop", filters.regex_drop("c"))], tolerant=["bad"])
    assert payloads(p(df)) == ['a"b'] and p.faults == {"bad": "no"}
    assert len(out(df.transform(only_tags(filters.drop, ["other"])))) == 2


def test_plugin_faults(spark):
    def process(batch):
        if any(b"boom" in bytes(d) for d in batch["data"]):
            raise RuntimeError("boom")
        return batch.assign(data=batch["data"].map(lambda d: bytes(d).upper()))

    good, bad = make(spark, ["a"]).coalesce(1), make(spark, ["boom"]).coalesce(1)
    assert payloads(good.transform(tolerant_plugin(process))) == ["A"]
    r = bad.transform(tolerant_plugin(process)).first()
    assert bytes(r.data) == b"boom" and "RuntimeError" in r["_err"]


def test_forwarder_and_ring_buffer(spark, tmp_path):
    df = make(spark, [("yes a", "t1", "10.0.0.1"), ("no", "t1", "10.0.0.1"), ("yes b", "t2", "10.0.0.1"), ("yes c", "t1", "11.0.0.1")])
    f = Forwarder("localhost:1", tags=["t1"], patterns=["yes", "never"], sources=["10.0.0.0/8"])
    assert [bytes(r.line) for r in f.selected(df).collect()] == [b"yes a\n"] and f(df) is df
    row = json.loads(df.select(encode_json().alias("j")).first().j)
    assert row["Tag"] == "t1" and row["SRC"] == "10.0.0.1" and row["TS"] == "2020-01-01T00:00:00.000000000Z" and row["Enumerated"][0]["Name"] == "testing"
    with pytest.raises(ValueError):
        Forwarder("x", format="xml")
    ring = RingBuffer(str(tmp_path / "ring"), size=1)
    for _ in range(3):
        ring.send(df.drop("k").coalesce(1))
    assert ring.read(spark).count() == 4 and "evs" not in ring.read(spark).columns
    assert ring.pop(spark).count() == 4
    ring.send(df.drop("k").coalesce(1).limit(1))
    assert ring.pop(spark).count() == 1


def test_pipeline_sends_to_its_tees(spark, tmp_path):
    df = make(spark, [("keep one", "t1", "10.0.0.1"), ("drop two", "t1", "10.0.0.1"), ("keep three", "t2", "10.0.0.1")]).drop("k")
    config = parse(f'[preprocessor "all"]\nType=clusterforwarder\nTarget={tmp_path}/all\n[preprocessor "less"]\nType=regexdrop\nRegex="^drop"\n[preprocessor "rest"]\nType=persistent-buffer\nFilename={tmp_path}/rest\n[preprocessor "gone"]\nType=forwarder\nTarget=127.0.0.1:1\n')
    out = Pipeline.from_config(config, ["all", "less", "rest"]).run(df)
    assert out.count() == 2 and spark.read.parquet(f"{tmp_path}/all").count() == 3 and spark.read.parquet(f"{tmp_path}/rest").count() == 2
    with pytest.raises(Exception):
        Pipeline.from_config(config, ["gone"]).run(df)
    tolerant = Pipeline(Pipeline.from_config(config, ["gone"]).stages, tolerant=["gone"])
    assert tolerant.run(df).count() == 3 and "gone" in tolerant.faults
    df.write.parquet(f"{tmp_path}/in")
    got = []
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = Pipeline.from_config(config, ["less", "rest"]).stream(stream, [lambda b, n: got.append(b.count())], f"{tmp_path}/check")
    q.awaitTermination()
    assert sum(got) == 2 and spark.read.parquet(f"{tmp_path}/rest").count() == 4


def test_json_bytes_as_they_stand(spark):
    """Both ways, by the JVM and by Arrow, give what the plain rule gives."""
    odd = ['{"a":1}', '{"a":1.0}', '{"a": "x y"}', '{"a":"q\\"z"}', '{"a":[1, 2]}', '{"a":"[1]"}', '{"a":null}', '{"a":true}', '{"a":1e5}', '{"a":"5"}', '{"a":{"b":1.50}}', '{"a":1', '{"b":2}', "no", "", "1,2", "{\"a\":1},{\"a\":2}", '{"a":1}x', '{"a":"é"}', '{"a":-7}', '{"a":1,"a":2}', '{"a":""}']
    df = make(spark, [(t, "t", "10.0.0.1") for t in odd])
    for drop in (False, True):
        stage = rewriters.JsonExtract("a", drop_misses=drop)
        want = [w for t in odd if (w := stage.extract(t)) is not None]
        assert sorted(r.d for r in df.transform(stage).selectExpr("cast(data as string) d").collect()) == sorted(want)
    arrays = ['{"a":[1,2]}', '{"a":[1, 2]}', '{"a":[{"b":1},{"b":"x"}]}', '{"a":["p","","q"]}', '{"a":[1.0,2]}', '{"a":"[1,2]"}', '{"a":[]}', '{"a":[null,1]}', '{"a":[[1],[2,3]]}', '{"a":3}', "{", '{"b":[1]}', '{"a":[1,2]', '{"a":[true,false]}', '{"a":["é"]}']
    df = make(spark, [(t, "t", "10.0.0.1") for t in arrays])
    for drop in (False, True):
        stage = rewriters.JsonArraySplit("a", drop_misses=drop)
        want = [x for t, w in ((t, stage.split(t)) for t in arrays) for x in ([t] if w is None else w)]
        assert sorted(r.d for r in df.transform(stage).selectExpr("cast(data as string) d").collect()) == sorted(want)


def test_forwarder_sends(spark):
    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))
    got = []

    def take():
        c, _ = server.accept()
        while chunk := c.recv(65536):
            got.append(chunk)

    t = threading.Thread(target=take)
    t.start()
    Forwarder(f"127.0.0.1:{server.getsockname()[1]}", format="syslog").send(make(spark, ["one", "two"]).coalesce(1))
    t.join(10)
    assert b"".join(got).count(b"\n") == 2 and b"<134>1 2020-01-01T00:00:00.000000000Z emberlog default - - - one" in b"".join(got)


def test_search_and_contracts(spark):
    df = make(spark, [('{"k": 5}', "a", "1.1.1.1"), ("user=bob id=7", "b", "1.1.1.2"), ("x;y", "c", "1.1.1.3")])
    engine = Engine(df, filters.Access(grants=["a", "b*"]))
    found = engine.search("a,b,c", "2019-01-01", "2021-01-01")
    assert found.count() == 2 and {r.tag for r in found.facets()["tag"].collect()} == {"a", "b"} and found.entries(0, 1).count() == 1
    assert engine.history() == [found] and engine.history("zzz") == []
    assert Extraction("e", "kv", "user,id", ["b"]).apply(df).select("user", "id").first() == ("bob", "7")
    assert Extraction("f", "fields", "p,q", ["c"], args='-d ";"').apply(df).select("p", "q").first() == ("x", "y")
    assert 'params="a\\"b c"' in Extraction("g", "json", 'a"b\nc', ["c"]).toml()
    engine.set_macro("WHO", "user=$X")
    engine.set_macro("X", "bob")
    assert engine.expand("find $WHO") == "find user=bob"
    for bad in (lambda: Extraction("e", "nope", "x", ["a"]), lambda: Extraction("e", "json", "x", ["a", "a"]), lambda: Schedule("s", "* *", "q", -60), lambda: Schedule("s", "* * * * *", "q", 60), lambda: engine.set_macro("low", "x")):
        with pytest.raises(ValueError):
            bad()
    assert Schedule("s", "* * * * *", "q", -60, offset_s=-10).range(1000) == (930, 990) and Schedule("s", "* * * * *", "q", -60, since_last=True).range(1000, 900) == (900, 1000)
    assert Alert("a", ["s"], schema=[("n", "number"), ("t", "string")]).validate({"n": "x"}) == ["n: no number", "t: missing"]


def test_access():
    a = filters.Access(grants=["x*"], group_grants=[["y"]])
    assert a.overlaps(["y", "z", "xa"]) == ["y", "xa"] and filters.Access(admin=True).allows("z") and not filters.Access().allows("z")


def test_facets_by_group(spark):
    from emberlog.operators.aggregates import facet_values

    df = spark.createDataFrame([("t", v) for v in "aaabbc"] + [("u", "z"), ("u", None)], "tag string, v string")
    got = sorted(tuple(r) for r in facet_values(df, F.col("v"), top=1, by=["tag"]).select("tag", "value", "count").collect())
    assert got == [("t", "Other", 3), ("t", "a", 3), ("u", "z", 1)]
    assert sorted(tuple(r) for r in facet_values(df, F.col("v"), top=2).select("value", "count").collect()) == [("Other", 2), ("a", 3), ("b", 2)]
