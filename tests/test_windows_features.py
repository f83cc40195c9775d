"""Windowing and features on hand-made packets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import net, stats
from tidewatch.operators import features as ft
from tidewatch.operators import windows as win

SECOND = 1_000_000


def packets_at(spark, micros, capture="c"):
    return spark.createDataFrame([(capture, i, u) for i, u in enumerate(micros)], "capture string, packet_no long, us long")


def counts(df):
    return {r.window_index: r["count"] for r in df.groupBy("window_index").count().collect()}


def test_first_policy_windows_and_bins(spark):
    w = win.assign(packets_at(spark, [i * 125_000 for i in range(14)]), SECOND, SECOND // 4, "first")
    assert counts(w) == {0: 8, 1: 8, 2: 8, 3: 8, 4: 6, 5: 4, 6: 2}
    assert {r.b for r in w.select(win.microbin(SECOND, 4).alias("b")).collect()} == set(range(4))


def test_aligned_policy(spark):
    # the first packet is at 0.7 s, so windows of 0.9 s begin at multiples of 0.3 s from 0.6 s
    w = win.assign(packets_at(spark, [700_000, 1_450_000, 1_500_000, 2_399_999]), 900_000, 300_000, "aligned")
    assert counts(w) == {0: 2, 1: 2, 2: 2, 3: 2, 4: 1, 5: 1}
    assert {r.w_start for r in w.collect()} == {600_000, 900_000, 1_200_000, 1_500_000, 1_800_000, 2_100_000}


def test_empty_windows_are_kept(spark):
    full = win.every_window(packets_at(spark, [0, 3_000_000]), SECOND, SECOND).orderBy("window_index").collect()
    assert [r.window_index for r in full] == [0, 1, 2, 3]
    assert win.every_window(packets_at(spark, [0, 3_000_000]), SECOND, SECOND, max_windows=2).count() == 2


@pytest.mark.parametrize("bad", [(0, 1), (1, 0), (-1, 1)])
def test_bad_parameters(spark, bad):
    with pytest.raises(ValueError, match="positive"):
        win.assign(packets_at(spark, [0]), *bad)


def test_late_packets(spark):
    # the packet at 0.2 s comes after one at 2.0 s: its windows have ended
    w = win.assign_arrival(packets_at(spark, [0, 2_000_000, 200_000, 1_900_000]), SECOND, SECOND // 2)
    assert {(r.packet_no, r.window_index) for r in w.collect()} == {(0, 0), (1, 3), (1, 4), (3, 3)}


def test_each_packet_is_in_width_over_hop_windows(spark):
    rng = random.Random(0)
    micros = sorted(rng.randrange(0, 60 * SECOND) for _ in range(500))
    for width, hop in ((4, 1), (3, 3), (5, 2)):
        w = win.assign(packets_at(spark, micros), width * SECOND, hop * SECOND)
        for r in w.groupBy("packet_no", "us").agg(F.count("*").alias("n"), F.min("w_start").alias("a"), F.max("w_start").alias("b")).collect():
            assert r.a <= r.us < r.a + width * SECOND and r.b <= r.us
            if r.us - micros[0] >= width * SECOND and width % hop == 0:
                assert r.n == width // hop
        if width % hop == 0:
            p = win.panes(packets_at(spark, micros), width * SECOND, hop * SECOND, {"count": F.lit(1)})
            assert {r.window_index: r["count"] for r in p.collect()} == counts(w)


def test_sequences_and_chunks(spark):
    rows = spark.createDataFrame([("c", i, i * 10) for i in range(5)] + [("d", 0, 7)], "capture string, window_index long, v int")
    assert {(r.seq_no, r.seq_start) for r in win.sequences(rows, 2, 2).collect()} == {(0, 0), (1, 2), (2, 3)}
    assert win.sequences(rows.where("capture = 'd'"), 2, 1).count() == 0
    assert {(r.seq_no) for r in win.sequences(rows, 2, 2, tail=False).collect()} == {0, 1}
    chunked = {(r.capture, r.chunk, r.position): r.v for r in win.chunks(rows, 2).collect()}
    assert chunked == {("c", 0, 0): 0, ("c", 0, 1): 10, ("c", 1, 0): 20, ("c", 1, 1): 30, ("d", 0, 0): 7, ("d", 0, 1): 7}
    assert [r.history for r in win.history(rows.where("capture = 'c'"), "v", 3, F.lit(0)).orderBy("window_index").collect()][:3] == [[0, 0, 0], [0, 0, 10], [0, 10, 20]]


def test_flow(spark):
    """Six packets of two seconds; expected values worked out by hand."""
    names = "capture string, window_index long, packet_no long, us long, len long, is_tcp int, is_udp int, is_icmp int, tcp_syn int, tcp_ack int, tcp_rst int, tcp_fin int, src_ip string, dst_ip string, src_port int, dst_port int"
    rows = [
        (0, 40, 1, 0, 0, 1, 0, 0, 0, "a", "x", 1, 443),
        (250_000, 1500, 1, 0, 0, 0, 1, 0, 0, "a", "x", 1, 443),
        (700_000, 60, 1, 0, 0, 0, 1, 0, 1, "b", "x", 2, 443),
        (700_000, 60, 0, 1, 0, 0, 0, 0, 0, "b", "x", 3, 53),
        (1_500_000, 90, 0, 1, 0, 0, 0, 0, 0, "c", "y", 4, 53),
        (1_900_000, 250, 0, 0, 1, 0, 0, 0, 0, "c", "z", None, None),
    ]
    r = ft.flow(spark.createDataFrame([("c", 0, i, *x) for i, x in enumerate(rows)], names), 2 * SECOND).first()
    assert (r.pkt_count, r.byte_count, r.pps, r.bps, r.tcp_ratio, r.min_pkt_len, r.max_pkt_len) == (6, 2000, 3.0, 8000.0, 0.5, 40, 1500)
    assert (r.tcp_syn, r.tcp_ack, r.tcp_rst, r.tcp_fin) == (1, 2, 0, 1)
    assert (r.unique_src_ips, r.unique_dst_ips, r.unique_src_ports, r.unique_dst_ports) == (3, 3, 4, 2)
    assert [r.src_ip_entropy, r.dst_ip_entropy, r.src_port_entropy, r.dst_port_entropy] == pytest.approx([1.584963, 1.251629, 1.921928, 0.970951], abs=1e-6)
    assert (r.mean_iat, r.std_iat) == pytest.approx((0.38, 0.292831), abs=1e-6)


DOS = "capture string, window_index long, packet_no long, us long, w_start long, len long, is_udp int, is_tcp int, is_icmp int, dst_port int, tcp_syn int, tcp_synack int, ssdp_method string, ssdp_st string, ssdp_man string, ssdp_user_agent string, src_ip string, dst_ip string, src_mac string, ttl int"


def dos_rows(spark):
    """Eight packets of one second: discovery, a name query, three SYN of which one is answered, a ping."""
    udp, tcp, icmp, no = (1, 0, 0), (0, 1, 0), (0, 0, 1), (None, None, None, None)
    rows = [
        (100_000, 120, *udp, 1900, 0, 0, "M-SEARCH", "a", "d", "q", "s1", "v", "m1", 64),
        (130_000, 120, *udp, 1900, 0, 0, "NOTIFY", "b", None, None, "s1", "v", "m1", 64),
        (240_000, 300, *udp, 53, 0, 0, *no, "s2", "v", "m2", 128),
        (300_000, 60, *tcp, 22, 1, 0, *no, "s2", "w", "m2", 128),
        (610_000, 60, *tcp, 22, 1, 1, *no, "s3", "w", "m1", 64),
        (620_000, 60, *tcp, 22, 1, 0, *no, "s3", "w", "m1", 64),
        (990_000, 80, *icmp, None, 0, 0, *no, "s1", "w", "m3", 255),
        (995_000, 200, *udp, 1900, 0, 0, "200-OK", "a", None, "", "s1", "v", "m1", 64),
    ]
    return spark.createDataFrame([("c", 0, i, us, 0, *x) for i, (us, *x) in enumerate(rows)], DOS)


def test_dos_static(spark):
    r = ft.dos_static(dos_rows(spark), SECOND, 4, (1900, 53)).first()
    assert (r.pkts_per_s, r.bytes_per_s, r.udp_port_fraction, r.ssdp_msearch, r.ssdp_notify, r.ssdp_200ok) == (8, 1000, 0.75, 1, 1, 1)
    assert (r.tcp_syn_over_synack, r.udp_ssdp_req_over_resp, r.src_mac_dominance, r.max_bin_pkts, r.gini_pkts) == (3.0, 2.0, 0.625, 3, 0.1875)
    assert [r.H_ST, r.H_MAN, r.H_USER_AGENT, r.H_ttl] == pytest.approx([0.918296, 0, 0, 1.298795], abs=1e-6)
    assert (r.n_unique_src_ip, r.n_unique_dst_ip) == (3, 2)
    # nothing answered: the ratio over nothing is 0
    assert ft.ratios(dos_rows(spark).where("tcp_synack = 0"), 1900).first().tcp_syn_over_synack == 0.0


def test_dos_bins(spark):
    binned = ft.dos_bins(dos_rows(spark), SECOND, 4, (1900, 53))
    b = {r.bin: r for r in binned.collect()}
    assert (b[0].bin_total_pkts, b[0].bin_total_bytes, b[0].bin_udp_pkts, b[0].bin_udp_pkts_dst_1900, b[0].bin_udp_pkts_dst_53, b[0].bin_ssdp_msearch) == (3, 540, 3, 2, 1, 1)
    assert (b[2].bin_tcp_pkts, b[2].bin_tcp_syn, b[2].bin_tcp_synack, b[3].bin_icmp_pkts, b[3].bin_ssdp_response) == (2, 2, 1, 1, 1)
    assert ft.matrix(binned, 4, ["bin_total_pkts", "bin_tcp_pkts"]).first().seq == [3.0, 0.0, 1.0, 1.0, 2.0, 2.0, 2.0, 0.0]


ARP = "capture string, window_index long, packet_no long, us long, w_start long, len long, is_arp int, arp_opcode int, arp_sender_ip string, arp_sender_mac string, arp_target_ip string, arp_target_mac string, arp_is_gratuitous int"


def arp_rows(spark):
    """Two questions and four answers, 50 ms apart: two machines answer for i9, one machine for i9 and i5."""
    rows = [(1, "i1", "m1", "i9", "00:00:00:00:00:00", 0), (2, "i9", "m2", "i1", "m1", 0), (2, "i9", "m3", "i1", "m1", 0), (2, "i5", "m3", "i4", "m4", 1), (1, "i2", "m1", "i9", "ff:ff:ff:ff:ff:ff", 0), (2, "i9", "m2", None, "m1", 0)]
    return spark.createDataFrame([("c", 0, i, i * 50_000, 0, 64, 1, *r) for i, r in enumerate(rows)], ARP)


def test_arp_static(spark):
    r = ft.arp_static(arp_rows(spark), SECOND, 5).first()
    assert (r.arp_request_rate, r.arp_reply_rate, r.arp_broadcast_fraction, r.arp_reply_to_request_ratio, r.unique_sender_target_pairs) == (2, 4, 1.0, 2.0, 5)
    assert (r.max_claims_per_ip, r.max_ips_per_mac, r.reply_conflict_ratio, r.target_reply_conflict_ratio) == (2, 2, 0.5, 0.5)
    assert [r.mean_claims_per_ip, r.conflict_ratio_claims_per_ip, r.mean_ips_per_mac, r.conflict_ratio_ips_per_mac, r.arp_gratuitous_fraction] == pytest.approx([4 / 3, 1 / 3, 5 / 3, 2 / 3, 1 / 6])


def test_arp_sequence_set(spark):
    r = ft.arp_static_seq(arp_rows(spark), 2 * SECOND).first()
    assert len(r) == 27
    assert (r.arp_fraction, r.arp_request_rate, r.arp_reply_rate, r.arp_gratuitous_rate, r.arp_bytes_per_s, r.arp_reply_to_request_ratio, r.arp_request_to_reply_ratio) == (1.0, 1.0, 2.0, 0.5, 192.0, 2.0, 0.5)
    assert (r.unique_sender_ips, r.unique_sender_macs, r.unique_target_ips, r.unique_target_macs, r.unique_sender_target_pairs) == (4, 3, 3, 4, 5)
    assert (r.max_claims_per_ip, r.mean_claims_per_ip, r.conflict_ip_ratio, r.max_ips_per_mac) == (2, 1.25, 0.25, 2)
    assert [r.mean_ips_per_mac, r.sender_conflict_ratio, r.target_conflict_ratio, r.arp_iat_mean, r.arp_iat_std] == pytest.approx([5 / 3, 2 / 3, 1 / 3, 0.05, 0.0])


def test_arp_bins(spark):
    first, second = ft.arp_bins(arp_rows(spark), SECOND, 5).orderBy("bin").collect()
    assert (first.bin, first.bin_requests, first.bin_replies, first.bin_conflicting_senders, first.bin_conflicting_targets, first.bin_sender_ips, first.bin_gratuitous) == (0, 1, 3, 1, 1, 3, 1)
    assert (second.bin, second.bin_pkts, second.bin_bytes, second.bin_conflicting_senders) == (1, 2, 128, 0)


def test_gini_and_interpolation(spark):
    rows = spark.createDataFrame([([0, 0, 0, 8],), ([2, 2, 2, 2],), ([0, 0, 0, 0],)], "a array<long>")
    assert [r.g for r in rows.select(stats.gini(F.col("a")).alias("g")).collect()] == [0.75, 0.0, 0.0]
    x = spark.createDataFrame([(0.5,), (1.5,), (9.0,)], "x double").select(stats.interpolated(F.col("x"), [1.0, 2.0], [10.0, 20.0]).alias("y")).collect()
    assert [r.y for r in x] == [10.0, 15.0, 20.0]


def test_entropy_bounds(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(g, rng.randint(1, 50)) for g in range(20) for _ in range(rng.randint(1, 8))], "g int, n int")
    for r in rows.groupBy("g").agg(stats.entropy(F.col("n")).alias("h"), F.count("*").alias("k")).collect():
        assert -1e-9 <= r.h <= math.log2(r.k) + 1e-9


def test_addresses(spark):
    import ipaddress

    rng = random.Random(0)
    ips = [".".join(str(rng.choice([0, 9, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 255, rng.randrange(256)])) for _ in range(4)) for _ in range(400)] + ["172.16.0.1", "172.32.0.1", "192.168.3.4", "", "x", "1.2.3", "256.1.1.1", "fe80::1", "fd00::1", "2001:db8::1"]

    def want(t):
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            return False
        return a.is_private and not (a.is_loopback or a.is_link_local or a.is_unspecified or a.is_multicast)

    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    for r in df.select("ip", net.is_private_ipv4(F.col("ip")).alias("a"), net.is_private_ip(F.col("ip")).alias("b")).collect():
        assert r.b == want(r.ip), r.ip
        if ":" not in r.ip:
            assert r.a == want(r.ip), r.ip


def test_ssdp(spark):
    texts = ['M-SEARCH * HTTP/1.1\r\nHOST: x\r\nMAN: "all"\r\nUser-Agent: probe 7\r\nST: urn:lamp\r\n\r\n', "HTTP/1.1 200 OK\r\nEXT:\r\nst: urn:door\r\n\r\n", "", None, "GET /", "NOTIFY *\r\nST: a\r\n st : b:c \r\n"]
    got = [tuple(r.s) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(net.ssdp(F.col("t")).alias("s")).collect()]
    assert got == [("M-SEARCH", "urn:lamp", '"all"', "probe 7"), ("200-OK", "urn:door", None, None), ("NONE", None, None, None), ("NONE", None, None, None), ("OTHER", None, None, None), ("NOTIFY", "b:c", None, None)]


def test_rounded(spark):
    """Halves go away from zero as doubles have them; what has no fraction, no number or no value stays."""
    values = [0.5, -0.5, 2.5, 0.49999999999999994, -0.0, 1e300, -1e17, float("nan"), float("inf"), None]
    got = [r.y for r in spark.createDataFrame(list(enumerate(values)), "i int, x double").orderBy("i").select(stats.rounded(F.col("x"), 0).alias("y")).collect()]
    assert got[:7] == [1.0, -1.0, 3.0, 0.0, 0.0, 1e300, -1e17]
    assert got[7] != got[7] and got[8:] == [float("inf"), None]
    assert spark.range(1).select(stats.rounded(F.lit(0.0027855)).alias("y")).first().y == 0.002786
