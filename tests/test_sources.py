"""Hostile records and the table helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.sources import tables
from wiretally.sources.records import normalise

BASE = {"ts": "1757000000.5", "uid": "C1", "id.orig_h": "10.0.0.5", "id.orig_p": "40000", "id.resp_h": "198.51.100.7", "id.resp_p": "443",
        "proto": "tcp", "orig_pkts": "10", "orig_ip_bytes": "1000", "conn_state": "SF", "service": None, "query": None, "answers": None}


def test_hostile_records(spark):
    changes = [
        {}, {"id.orig_h": "999.1.1.1"}, {"id.resp_p": "99999"}, {"ts": "-"}, {"ts": "soon"}, {"query": "a..b"}, {"query": "x" * 300},
        {"orig_ip_bytes": "-5000"}, {"proto": "253"}, {"service": "s" * 5000}, {"query": "ok.example.com", "answers": str(["a"] * 500).replace("'", '"')},
        {"id.resp_h": "2001:db8::1"},
    ]
    rows = [{**BASE, **c, "uid": f"C{i}"} for i, c in enumerate(changes)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"`{k}` string" for k in BASE))
    n = normalise(df)
    reasons = sorted(r["reason"] for r in n.rejects.collect())
    assert reasons == ["bad_address", "bad_address", "bad_domain", "bad_domain", "bad_timestamp", "other", "validation"]
    flows = {r["flow_id"]: r for r in n.flows.collect()}
    assert set(flows) == {"C0", "C7", "C8", "C9", "C10"}
    assert flows["C7"]["orig_bytes"] == 0 and flows["C8"]["transport"] == "other" and len(flows["C9"]["service"]) == 256
    assert len(flows["C10"]["dns"]["answers"]) == 64 and flows["C0"]["direction"] == "OUTBOUND" and flows["C0"]["ts_us"] == 1757000000500000


def test_insert_and_prune(spark, tmp_path):
    day = 86_400_000_000
    df = spark.range(10).select(F.col("id").cast("string").alias("event_id"), (F.col("id") * (day // 2)).alias("ts_us"))
    root = str(tmp_path)
    tables.insert_new(df, root, "events")
    tables.insert_new(df, root, "events")
    assert tables.read(spark, root, "events").count() == 10
    assert tables.prune(spark, root, 3 * day)["events"] == 6
    assert sorted(int(r[0]) for r in tables.read(spark, root, "events").select("event_id").collect()) == [6, 7, 8, 9]


def test_log_folder_with_a_missing_log_and_ties(spark, tmp_path):
    """No ssl.log; of several DNS records of a connection the last line counts; bad lines are rejects."""
    from wiretally.sources.jsonlogs import read_log_dir

    conn = ['{"uid":"c1","ts":"100.5","id.orig_h":"10.0.0.1","id.resp_h":"8.8.8.8","id.resp_p":53,"proto":"udp"}',
            '{"uid":"c2","ts":"1e300","id.orig_h":"10.0.0.1","id.resp_h":"8.8.8.8"}', '{"uid":"c3"}{"uid":"c4"}', '{"uid":"c5"} x}', "# note"]
    dns = ['{"uid":"c1","query":"first.example.com"}', '{"uid":"c1","query":"last.example.com"}']
    (tmp_path / "conn.log").write_text("\n".join(conn))
    (tmp_path / "dns.log").write_text("\n".join(dns))
    out = read_log_dir(spark, str(tmp_path))
    assert [(r["dns"]["query"], r["src_ip"]) for r in out.flows.collect()] == [("last.example.com", "10.0.0.1")]
    assert sorted(r["reason"] for r in out.rejects.collect()) == ["bad_json", "bad_json", "other"]


def test_capture_tag_reaches_the_flow(spark, tmp_path):
    from wiretally.sources.jsonlogs import read_lines
    from wiretally.sources.records import normalise

    (tmp_path / "day1.log").write_text('{"uid":"1","uid":"2","ts":"1","id.orig_h":"10.0.0.1","id.resp_h":"8.8.8.8"}\n')
    records, _ = read_lines(spark, str(tmp_path / "day1.log"), tag_capture=True)
    assert [r["uid"] for r in records.collect()] == ["2"]
    assert [r["pcap_reference"] for r in normalise(records.drop("_pos"), raw="_raw").flows.collect()] == ["day1.log"]
