"""The gate's view of two windows, worked out by hand: ports on either side, multicast by link address, notices in any case, no SYN."""

import pytest

from tidewatch.operators import features as ft


def test_gate_snapshots(spark):
    columns = "capture string, window_index long, w_start long, us long, is_udp int, is_tcp int, tcp_syn int, tcp_synack int, src_port int, dst_port int, dst_ip string, dst_mac string, ssdp_method string, src_ip string, ttl int"
    rows = [
        ("c", 0, 0, 100_000, 1, 0, 0, 0, 5000, 1900, "10.0.0.2", "02:00:00:00:00:07", "Notify", "a", 4),
        ("c", 0, 0, 200_000, 1, 0, 0, 0, 1900, 5001, "10.0.0.3", "01:00:5E:00:00:07", "HTTP 200 OK", "b", 4),
        ("c", 0, 0, 300_000, 1, 0, 0, 0, None, 53, "10.0.0.3", None, "M-SEARCH", "a", 4),
        ("c", 0, 0, 900_000, 0, 1, 0, 2, 1900, 80, None, None, "M-SEARCH", "b", None),
        ("c", 1, 1_000_000, 1_600_000, 0, 1, 1, 0, 1, 2, "FF02::C", None, None, "a", 4),
    ]
    got = {r.window_index: r for r in ft.gate_snapshots(spark.createDataFrame(rows, columns), 1_000_000, 2).collect()}
    a, b = got[0], got[1]
    assert (a.total_pkts, a.total_udp, a.total_tcp, a.pkts_per_s, a.max_bin_pkts, a.median_bin_pkts) == (4, 3, 1, 4, 3, 2)
    assert (a.ssdp_notify_count, a.ssdp_200ok_count, a.ssdp_msearch_count, a.udp_ssdp_req_over_resp, a.ssdp_multicast_hit) == (1, 1, 0, 0, 1)  # the ratio takes methods by their names only
    assert a.udp_1900_fraction == pytest.approx(2 / 3) and a.tcp_synack_completion == pytest.approx(2e6) and a.tcp_syn_over_synack == 0
    assert (a.H_src_ip, a.H_dst_port, a.H_ttl) == (1, 2, 0)
    assert (b.total_udp, b.udp_1900_fraction, b.ssdp_multicast_hit, b.tcp_syn_rate, b.tcp_synack_completion) == (0, 0, 1, 1, 0)
