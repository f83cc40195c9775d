"""Discovery floods: what is asked over what is answered, in features and at the gate, and methods shown by payloads only."""

import pytest

from tidewatch.operators import decide as dc
from tidewatch.operators import features as ft

ROW = "capture string, window_index long, packet_no long, w_start long, us long, len long, is_udp int, is_tcp int, is_icmp int, tcp_syn int, tcp_synack int, src_port int, dst_port int, dst_ip string, src_ip string, src_mac string, ttl int, ssdp_method string, ssdp_st string, ssdp_man string, ssdp_user_agent string, payload binary"


def rows_of(spark, methods, port=1900, udp=1, payloads=None):
    data = [("c", 0, i, 0, 1000 * i, 100, udp, 1 - udp, 0, 0, 0, 5000, port, "10.0.0.9", f"10.0.0.{i % 3}", "m", 4, m, None, None, None, (payloads or [None] * len(methods))[i]) for i, m in enumerate(methods)]
    return spark.createDataFrame(data, ROW)


@pytest.mark.parametrize(("methods", "udp", "ratio"), [
    (["NOTIFY"] * 9 + ["200-OK"], 1, 9.0),
    (["NOTIFY"] * 9 + ["M-SEARCH"] * 3 + ["200-OK"] * 2, 1, 6.0),
    (["NOTIFY"] * 9, 1, 0.0),  # nothing answered
    (["NOTIFY"] * 9 + ["200-OK"], 0, 0.0),  # not over UDP
])
def test_ratio(spark, methods, udp, ratio):
    rows = rows_of(spark, methods, udp=udp)
    assert ft.ratios(rows, 1900).first().udp_ssdp_req_over_resp == ratio
    assert ft.gate_snapshots(rows, 1_000_000, 4).first().udp_ssdp_req_over_resp == ratio
    # the ratio takes packets of any port, the gate's counts only those of the discovery port
    other = ft.gate_snapshots(rows_of(spark, methods, port=53, udp=udp), 1_000_000, 4).first()
    assert other.udp_ssdp_req_over_resp == ratio and other.ssdp_notify_count == 0


def test_flood_opens_the_gate(spark):
    """Twelve notices an answer are lopsided; without an answer there is no ratio, and the gate says so by other reasons only."""
    base = spark.createDataFrame([("c", 1e6, 1.0, -1.0, -1.0, -1.0, 1.0)], "capture string, pkts_med double, pkts_sigma double, H_src_ip_p10 double, H_dst_port_p10 double, H_ttl_p10 double, median_bin_pkts_med double")
    reasons = {}
    for name, methods in (("answered", ["NOTIFY"] * 96 + ["200-OK"] * 8), ("silent", ["NOTIFY"] * 104)):
        gate = dc.dos_gate(ft.gate_snapshots(rows_of(spark, methods), 1_000_000, 4), base).first()
        reasons[name] = set(gate.gate_reasons), gate.gate_ok
    assert reasons["answered"][1] and {"asymmetry", "SSDP asymmetry"} <= reasons["answered"][0]
    assert "asymmetry" not in reasons["silent"][0] and "SSDP asymmetry" not in reasons["silent"][0]


def test_methods_shown_by_payloads(spark):
    payloads = [b"NOTIFY * HTTP/1.1\r\nHOST: x", b"xx m-search * http/1.1\r\n", b"HTTP/1.1 200 OK\r\n", b"notify me", b"\xff\xfe", None, b"NOTIFY * HTTP/1.1"]
    rows = rows_of(spark, [None, "", None, None, None, None, "M-SEARCH"], payloads=payloads)
    s = ft.gate_snapshots(rows, 1_000_000, 4).first()
    assert (s.ssdp_notify_count, s.ssdp_msearch_count, s.ssdp_200ok_count) == (2, 2, 1)
