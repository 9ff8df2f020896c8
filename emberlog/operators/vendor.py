"""Vendor formats: flow logs, network monitor JSON to tab-separated lines, multipart syslog."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..entry import text
from ..functions.regexes import Pattern, glob_to_regex
from .rewriters import _gunzip, is_gzip

_FLOW = "struct<logEvents: array<struct<id: string, timestamp: bigint, message: string, extractedFields: map<string,string>>>>"


def flow_log_split(extract_json: bool = False) -> Callable[[DataFrame], DataFrame]:
    """One entry for each log event of a flow-log envelope, plain or gzip: its message, or its fields as JSON.

    Time := the field ``start`` in seconds.  An envelope with any bad event goes as a whole.
    """

    def run(df: DataFrame) -> DataFrame:
        packed = is_gzip(F.col("data"))
        plain = F.when(packed, _gunzip(F.when(packed, F.col("data")))).otherwise(F.col("data")).cast("string")
        df = df.withColumn("_events", F.from_json(plain, _FLOW)["logEvents"])
        good = F.forall("_events", lambda e: e["extractedFields"]["start"].try_cast("bigint").isNotNull() & (F.lit(extract_json) | e["message"].isNotNull()))
        df = df.filter(F.coalesce(good, F.lit(False))).withColumn("_e", F.explode("_events"))
        payload = F.to_json("_e.extractedFields") if extract_json else F.col("_e.message")
        return df.withColumns({"data": payload.cast("binary"), "ts": F.timestamp_seconds(F.col("_e.extractedFields")["start"].cast("bigint")), "nsec_rem": F.lit(0)}).drop("_events", "_e")

    return run


#: Columns of each kind of log, the time first.
HEADERS = {
    "bacnet": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,bvlc_function,bvlc_len,apdu_type,service_choice,data",
    "conn_long": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,proto,service,duration,orig_bytes,resp_bytes,conn_state,local_orig,local_resp,missed_bytes,history,orig_pkts,orig_ip_bytes,resp_pkts,resp_ip_bytes,corelight_shunted",
    "conn": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,proto,service,duration,orig_bytes,resp_bytes,conn_state,local_orig,local_resp,missed_bytes,history,orig_pkts,orig_ip_bytes,resp_pkts,resp_ip_bytes,tunnel_parents,vlan",
    "dhcp": "ts,uids,client_addr,server_addr,mac,host_name,client_fqdn,domain,requested_addr,assigned_addr,lease_time,client_message,server_message,msg_types,duration",
    "dns": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,proto,trans_id,rtt,query,qclass,qclass_name,qtype,qtype_name,rcode,rcode_name,AA,TC,RD,RA,Z,answers,TTLs,rejected",
    "dpd": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,proto,analyzer,failure_reason,packet_segment",
    "encrypted_dns": "ts,uid,resp_h,sni,match",
    "etc_viz": "ts,uid,server_a,server_p,service,viz_stat,c2s_viz.size,c2s_viz.enc_dev,c2s_viz.enc_frac,c2s_viz.pdu1_enc,c2s_viz.clr_frac,s2c_viz.size,s2c_viz.enc_dev,s2c_viz.enc_frac,s2c_viz.pdu1_enc,s2c_viz.clr_frac",
    "files": "ts,fuid,tx_hosts,rx_hosts,conn_uids,source,depth,analyzers,mime_type,filename,duration,local_orig,is_orig,seen_bytes,total_bytes,missing_bytes,overflow_bytes,timedout,parent_fuid,md5,sha1,sha256,extracted,extracted_cutoff,extracted_size",
    "ftp": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,user,password,command,arg,mime_type,file_size,reply_code,reply_msg,data_channel.passive,data_channel.orig_h,data_channel.resp_h,data_channel.resp_p,fuid",
    "http": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,trans_depth,method,host,uri,referrer,version,user_agent,origin,request_body_len,response_body_len,status_code,status_msg,info_code,info_msg,tags,username,password,proxied,orig_fuids,orig_filenames,orig_mime_types,resp_fuids,resp_filenames,resp_mime_types",
    "intel": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,seen.indicator,seen.indicator_type,seen.where,seen.node,matched,sources,fuid,file_mime_type,file_desc",
    "irc": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,nick,user,command,value,addl,dcc_file_name,dcc_file_size,dcc_mime_type,fuid",
    "kerberos": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,request_type,client,service,success,error_msg,from,till,cipher,forwardable,renewable,client_cert_subject,client_cert_fuid,server_cert_subject,server_cert_fuid",
    "modbus": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,func,exception",
    "mysql": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,cmd,arg,success,rows,response",
    "notice": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,fuid,file_mime_type,file_desc,proto,note,msg,sub,src,dst,p,n,peer_descr,actions,suppress_for,remote_location.destination_country_code,remote_location.destination_region,remote_location.destination_city,remote_location.destination_latitude,remote_location.destination_longitude,dropped",
    "ntp": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,version,mode,stratum,poll,precision,root_delay,root_disp,ref_id,ref_time,org_time,rec_time,xmt_time,num_exts",
    "pe": "ts,id,machine,compile_ts,os,subsystem,is_exe,is_64bit,uses_aslr,uses_dep,uses_code_integrity,uses_seh,has_import_table,has_cert_table,has_debug_data,section_names",
    "radius": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,username,mac,framed_addr,tunnel_client,connect_info,reply_msg,result,ttl,logged",
    "rdp": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,cookie,result,security_protocol,client_channels,keyboard_layout,client_build,client_name,client_dig_product_id,desktop_width,desktop_height,requested_color_depth,cert_type,cert_count,cert_permanent,encryption_level,encryption_method",
    "reporter": "ts,level,message,location",
    "rfb": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,client_major_version,client_minor_version,server_major_version,server_minor_version,authentication_method,auth,share_flag,desktop_name,width,height",
    "signature": "ts,uid,src_addr,src_port,dst_addr,dst_port,note,sig_id,event_msg,sub_msg,sig_count,host_count",
    "sip": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,trans_depth,method,uri,date,request_from,request_to,response_from,response_to,reply_to,call_id,seq,subject,request_path,response_path,user_agent,status_code,status_msg,warning,request_body_len,response_body_len,content_type",
    "smb_files": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,fuid,action,path,name,size,prev_name,times.modified,times.accessed,times.created,times.changed",
    "smb_mapping": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,path,service,native_file_system,share_type",
    "smtp_links": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,fuid,link",
    "smtp": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,trans_depth,helo,mailfrom,rcptto,date,from,to,cc,reply_to,msg_id,in_reply_to,subject,x_originating_ip,first_received,second_received,last_reply,path,user_agent,tls",
    "snmp": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,duration,version,community,get_requests,get_bulk_requests,get_responses,set_requests,display_string,up_since",
    "socks": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,version,user,password,status,request,request.host,request.name,request_p,bound.host,bound.name,bound_p",
    "software": "ts,host,host_p,software_type,name,version.major,version.minor,version.minor2,version.minor3,version.addl,unparsed_version",
    "ssh": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,version,auth_success,auth_attempts,direction,client,server,cipher_alg,mac_alg,compression_alg,kex_alg,host_key_alg,host_key,inferences",
    "ssl": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,version,cipher,curve,server_name,resumed,last_alert,next_protocol,established,cert_chain_fuids,client_cert_chain_fuids,subject,issuer,client_subject,client_issuer,validation_status",
    "suricata_corelight": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,suri_id,service,flow_id,tx_id,pcap_cnt,alert.action,alert.gid,alert.signature_id,alert.rev,alert.signature,alert.category,alert.severity,alert.metadata,community_id,metadata",
    "syslog": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,proto,facility,severity,message",
    "traceroute": "ts,src,dst,proto",
    "tunnel": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,tunnel_type,action",
    "weird": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,name,addl,notice,peer,source",
    "x509": "ts,id,certificate.version,certificate.serial,certificate.subject,certificate.issuer,certificate.not_valid_before,certificate.not_valid_after,certificate.key_alg,certificate.sig_alg,certificate.key_type,certificate.key_length,certificate.exponent,certificate.curve,san.dns,san.uri,san.email,san.ip,basic_constraints.ca,basic_constraintspath_len",
    "zeekdnp3": "ts,uid,id.orig_h,id.orig_p,id.resp_h,id.resp_p,fc_request,fc_reply,iin",
}


def _tsv_value(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):  # every number is a double, as JSON has it; beyond 2^53 not all are exact
        return f"{float(value):.0f}" if float(value).is_integer() else f"{value:.5f}"
    if value is None:
        return "<nil>"
    if isinstance(value, str):
        return value.replace("\t", " ")
    if isinstance(value, list):
        return "[" + " ".join(map(_tsv_value, value)) + "]"
    return "map[" + " ".join(f"{k}:{_tsv_value(v)}" for k, v in sorted(value.items())) + "]"


@dataclass(frozen=True)
class MonitorTsv:
    """Network monitor JSON (keys ``_path`` and ``ts``) as tab-separated lines, tagged by kind; all else stays as it is."""

    prefix: str = "zeek"
    custom: Sequence[str] = ()

    def headers(self) -> dict[str, list[str]]:
        table = {k: v.split(",") for k, v in HEADERS.items()}
        for rule in self.custom:
            path, colon, columns = rule.partition(":")
            names = [c.strip() for c in columns.split(",") if c.strip()]
            if not colon or not path.strip() or not names:
                raise ValueError(f"{rule!r} is not path:column,...")
            table[path.strip()] = names
        return table

    def convert(self, value: str | None, table: dict[str, list[str]]) -> tuple[str, str, str] | None:
        """(cells after the time, kind, the time as text) of one message."""
        at = (value or "").find("{")
        if at < 0:
            return None
        try:
            row = json.loads(value[at:])
            path, ts = row["_path"], row["ts"]
            columns = table[path]
        except (ValueError, KeyError, TypeError):
            return None
        return "".join("\t" + (_tsv_value(row[c]) if c in row else "-") for c in columns[1:]), path, str(ts)

    def __call__(self, df: DataFrame) -> DataFrame:
        table = self.headers()

        @F.pandas_udf("cells string, path string, ts string")
        def run(values: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([self.convert(v, table) or (None, None, None) for v in values], columns=["cells", "path", "ts"], dtype=object)

        df = df.withColumn("_t", run(text())).withColumn("_ts", F.try_to_timestamp("_t.ts"))
        hit, micros = F.col("_ts").isNotNull() & F.col("_t.cells").isNotNull(), F.unix_micros("_ts")
        seconds = F.concat(F.floor(micros / 1_000_000).cast("string"), F.lit("."), F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0"))
        out = {"data": F.when(hit, F.concat(seconds, "_t.cells").cast("binary")).otherwise(F.col("data")), "tag": F.when(hit, F.concat(F.lit(self.prefix), F.col("_t.path"))).otherwise(F.col("tag")), "ts": F.when(hit, F.col("_ts")).otherwise(F.col("ts"))}
        return df.withColumns(out).drop("_t", "_ts")


#: The header of a part, and the message that parts make up.
PART = Pattern(r"^(?:<\d+>)?(?P<ts>\S+\s\d+\s\d+\:\d+\:\d+)(\s[-+]?\d+:\d+)?\s(?P<host>\S+)\s(?P<cat>\S+)\s(?P<msgid>\d+)\s(?P<total>\d+)\s(?P<seq>\d+)\s(?P<body>.+)$")
MESSAGE = r"^(?P<ts>\d+\-\d+\-\d+\s\d+\:\d+\:\d+(\.\d+)?(?P<zone>\s[-+]?\d+:\d+)?)\s(?P<seq>\d+)\s(?P<ode>\S+)\s(?P<sev>\S+)\s(?P<class>[^\:]+)\:\s(?P<body>.+)$"
MAX_ID, MAX_PART = 0xFFFFFFFF, 0xFFFF
_MARK = "\x01"


def part_columns(value: Column) -> dict[str, Column]:
    """host, cat, id, total, seq and body of a part; all null if it is none."""
    id_, total, seq = (PART.group(value, n).try_cast("bigint") for n in ("msgid", "total", "seq"))
    ok = PART.matches(value) & (id_ <= MAX_ID) & (total <= MAX_PART) & (seq <= total)
    found = {"host": PART.group(value, "host"), "cat": PART.group(value, "cat"), "id": id_, "total": total, "seq": seq, "body": PART.group(value, "body")}
    return {k: F.when(ok, v) for k, v in found.items()}


def with_parts(df: DataFrame) -> DataFrame:
    """``df`` with the columns of :func:`part_columns`, their names after ``_``, each payload matched once.

    A match is replaced by its groups between marks and split there; the
    generator keeps filters of these columns from matching again.  Payloads that
    hold the mark themselves go by single groups.
    """
    names = ("host", "cat", "msgid", "total", "seq", "body")
    plain = ~F.coalesce(text().contains(_MARK), F.lit(False))
    marked = F.regexp_replace(text(), PART.java, "".join(f"{_MARK}${PART.names[n]}" for n in names) + _MARK)
    df = df.select("*", F.explode(F.array(F.when(plain, marked))).alias("_marked"))
    groups = F.split("_marked", _MARK, -1)
    fast = {n: F.get(groups, F.lit(k)) for k, n in enumerate(names, 1)}
    id_, total, seq = (fast[n].try_cast("bigint") for n in ("msgid", "total", "seq"))
    ok = F.startswith("_marked", F.lit(_MARK)) & (id_ <= MAX_ID) & (total <= MAX_PART) & (seq <= total)
    fast = {"host": fast["host"], "cat": fast["cat"], "id": id_, "total": total, "seq": seq, "body": fast["body"]}
    slow = part_columns(text())
    return df.withColumns({f"_{k}": F.when(plain, F.when(ok, v)).otherwise(slow[k]) for k, v in fast.items()}).drop("_marked")


def split_unescaped(text: str, mark: str) -> list[str]:
    """``text`` parted at each ``mark`` that no backslash escapes."""
    pieces = text.split(mark)
    if "\\" not in text:
        return pieces
    out: list[str] = []
    for piece in pieces:
        if out and (len(out[-1]) - len(out[-1].rstrip("\\"))) % 2:
            out[-1] += mark + piece
        else:
            out.append(piece)
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\([,\\\"'])", r"\1", text) if "\\" in text else text


def strip_header(key: str, value: str) -> tuple[str, str]:
    """The innermost ``key=value`` of a value that holds more of them, unless it is bracketed."""
    if value[:1] in ("(", "{") or "=" not in value:
        return key, value
    head, _, last = value.rpartition("=")
    return head.rpartition("=")[2], last


@dataclass(frozen=True)
class IdentityFormat:
    """Identity-service messages as ``raw``, ``cef`` or ``json``, less attributes that a glob describes."""

    output: str = "raw"
    attribute_drops: Sequence[str] = ()
    strip_headers: bool = False
    passthrough: bool = True

    def __post_init__(self) -> None:
        if self.output not in ("raw", "cef", "json"):
            raise ValueError("output is raw|cef|json")

    def convert(self, value: str | None, drops: list[re.Pattern]) -> tuple[str, str] | None:
        """(the message's new form, its time with a zone) of one message."""
        m = re.match(MESSAGE, value or "", re.DOTALL)
        if not m:
            return None
        fields = split_unescaped(m["body"], ",")
        attributes = []
        for part in fields[1:]:
            sides = split_unescaped(part.strip(), "=")
            if len(sides) < 2 or any(d.match(part.strip()) for d in drops):
                continue
            key, val = sides[0], "=".join(sides[1:])
            if self.strip_headers:
                key, val = strip_header(key, val)
            attributes.append((unescape(key), unescape(val)))
        head = fields[0]
        if self.output == "raw":
            out = value if not self.attribute_drops and not self.strip_headers else f"{m['ts']} {m['seq']} {m['ode']} {m['sev']} {m['class']}: " + ", ".join([head, *(f"{k}={v}" for k, v in attributes)])
        elif self.output == "cef":
            out = f"CEF:0|CISCO|ISE_DEVICE|||{m['class']}|{m['sev']}| sequence={m['seq']} ode={m['ode']} class={m['class']} text={head}" + "".join(f" {k.replace(' ', '')}={v.replace('=', chr(92) + '=')}" for k, v in attributes)
        else:
            out = json.dumps({"TS": m["ts"], "Sequence": int(m["seq"]), "ODE": m["ode"], "Severity": m["sev"], "Class": m["class"], "Text": head, "Attributes": dict(attributes)}, separators=(",", ":"), ensure_ascii=False)
        return out, m["ts"] + ("" if m["zone"] else " +00:00")

    def __call__(self, df: DataFrame) -> DataFrame:
        drops = [re.compile(glob_to_regex(g)) for g in self.attribute_drops]

        @F.pandas_udf("out string, ts string")
        def run(values: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([self.convert(v, drops) or (None, None) for v in values], columns=["out", "ts"], dtype=object)

        df = df.withColumn("_m", run(text()))
        hit = F.col("_m.out").isNotNull()
        df = df if self.passthrough else df.filter(hit)
        return df.withColumns({"data": F.when(hit, F.col("_m.out").cast("binary")).otherwise(F.col("data")), "ts": F.coalesce(F.try_to_timestamp("_m.ts"), "ts")}).drop("_m")


def reassemble(df: DataFrame, exact: bool = False) -> DataFrame:
    """Multipart messages of a batch: one entry for each (host, category, id), bodies in the order of their numbers.

    The entry has the envelope of the part that came first.  Messages that lack
    parts come out as far as they came, as at the end of a stream.  Parts that
    repeat a number count once, the last body staying; with ``exact`` only
    complete messages come out.  Entries that are no parts pass.
    """
    marked = with_parts(df)
    is_part = "coalesce(_id IS NOT NULL AND _total > 0 AND _seq < _total, false)"
    parts, others = marked.filter(is_part), marked.filter(f"NOT {is_part}").select(df.columns)
    when = F.struct("ts", "nsec_rem", "_seq")
    came = F.struct("_seq", F.struct("ts", "nsec_rem").alias("when"), "_body")
    envelope = [c for c in df.columns if c != "data"]
    whole = parts.groupBy("_host", "_cat", "_id").agg(F.array_sort(F.collect_list(came)).alias("all"), F.min_by(F.struct(*envelope), when).alias("e"), F.max("_total").alias("total"))
    # of parts that repeat a number, the last in order stays
    last = F.filter("all", lambda part, at: (at + 1 == F.size("all")) | (F.get("all", at + 1)["_seq"] != part["_seq"]))
    whole = whole.withColumn("all", last)
    whole = whole.filter(F.size("all") == F.col("total")) if exact else whole
    joined = F.array_join(F.transform("all", lambda part: part["_body"]), "")
    return whole.select(*(joined.cast("binary").alias(c) if c == "data" else F.col(f"e.{c}").alias(c) for c in df.columns)).unionByName(others)
