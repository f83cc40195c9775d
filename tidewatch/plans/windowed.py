"""Queries over windows and their features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.stats import rounded
from tidewatch.operators import features as ft
from tidewatch.operators import windows as win
from tidewatch.plans.registry import BINS, HOP, PACKETS, SQL, WIDTH, WINDOWED, query, windows_sql
from tidewatch.sources.tables import TOP_PORTS, packets

KEY = ft.KEY
K = "capture, window_index"


def windowed(spark, sf_dir, policy="sorted"):
    return win.assign(packets(spark, sf_dir), WIDTH, HOP, policy)


@query(f"with {PACKETS} select packet_no, us, capture, len, src_mac, src_ip, dst_ip, src_port, dst_port, is_tcp, is_udp, is_icmp, tcp_syn, tcp_synack, ssdp_method, ttl from p")
def packets_view(spark, sf_dir):
    return packets(spark, sf_dir).select("packet_no", "us", "capture", "len", "src_mac", "src_ip", "dst_ip", "src_port", "dst_port", "is_tcp", "is_udp", "is_icmp", "tcp_syn", "tcp_synack", "ssdp_method", "ttl")


def _assigned(policy):
    def run(spark, sf_dir):
        return windowed(spark, sf_dir, policy).select(*KEY, "packet_no", "w_start")

    return run


for _policy, _anchor in (("first", "arg_min(us, packet_no)"), ("sorted", "min(us)"), ("aligned", f"(min(us) // {HOP}) * {HOP}")):
    query(f"with {PACKETS}, {windows_sql(_anchor)} select {K}, packet_no, w_start from w", f"win_assign_{_policy}")(_assigned(_policy))


@query(f"""with {PACKETS}, a as (select capture, min(us) as u0, max(us) as u1 from p group by capture),
    g as (select capture, u0, unnest(generate_series(0, (u1 - u0) // {HOP})) as window_index from a)
    select g.capture, g.window_index, u0 + g.window_index * {HOP} as w_start, count(us) as pkts from g left join p on p.capture = g.capture and us >= u0 + g.window_index * {HOP} and us < u0 + g.window_index * {HOP} + {WIDTH} group by all""")
def win_empties(spark, sf_dir):
    rows = packets(spark, sf_dir)
    full = win.every_window(rows, WIDTH, HOP)
    counts = win.assign(rows, WIDTH, HOP).groupBy(*KEY).agg(F.count("*").alias("pkts"))
    return full.join(counts, KEY, "left").select(*KEY, "w_start", F.coalesce("pkts", F.lit(0)).alias("pkts"))


@query(f"""with {PACKETS}, s as (select *, (packet_no * 7919) % 1009 as arrival_key from p), o as (select *, row_number() over (partition by capture order by us // 600000000, arrival_key, packet_no) as arrival from s),
    a as (select capture, arg_min(us, arrival) as u0 from o group by capture),
    m as (select o.*, u0, max(us) over (partition by capture order by arrival rows between unbounded preceding and 1 preceding) as seen from o join a using (capture)),
    w as (select *, unnest(generate_series(case when us - u0 < {WIDTH} then 0 else (us - u0 - {WIDTH}) // {HOP} + 1 end, (us - u0) // {HOP})) as window_index from m where us >= u0)
    select {K}, count(*) as pkts, min(packet_no) as least_packet from w where seen is null or u0 + window_index * {HOP} + {WIDTH} > seen group by all""")
def win_late_drop(spark, sf_dir):
    rows = packets(spark, sf_dir).withColumn("arrival_key", F.expr("(packet_no * 7919) % 1009"))
    rows = rows.withColumn("arrival", F.expr("row_number() over (partition by capture order by us div 600000000, arrival_key, packet_no)"))
    return win.assign_arrival(rows, WIDTH, HOP, "arrival").groupBy(*KEY).agg(F.count("*").alias("pkts"), F.min("packet_no").alias("least_packet"))


@query(f"{WINDOWED} select {K}, bin::int as bin, count(*) as pkts from w group by all")
def win_microbins(spark, sf_dir):
    return windowed(spark, sf_dir).groupBy(*KEY, win.microbin(WIDTH, BINS).alias("bin")).agg(F.count("*").alias("pkts"))


COUNTS_SQL = f"{WINDOWED}, c as (select {K}, count(*) as pkts from w group by all), r as (select *, row_number() over (partition by capture order by window_index) - 1 as row, count(*) over (partition by capture) as n from c)"


def counted(spark, sf_dir):
    return win.panes(packets(spark, sf_dir), WIDTH, HOP, {"pkts": F.lit(1)}).select(*KEY, "pkts")


@query(f"""{COUNTS_SQL}, d as (select distinct capture, n from r where n >= 5), s as (select capture, unnest(list_distinct(generate_series(0, n - 5, 3) || [n - 5])) as seq_start from d),
    t as (select *, row_number() over (partition by capture order by seq_start) - 1 as seq_no from s)
    select t.capture, seq_no::int as seq_no, seq_start::int as seq_start, list(pkts order by row)::varchar as pkts from t join r on r.capture = t.capture and row between seq_start and seq_start + 4 group by all""")
def win_sequences(spark, sf_dir):
    rows = win.sequences(counted(spark, sf_dir), 5, 3)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "pkts"))), lambda x: x["pkts"].cast("string"))
    return rows.groupBy("capture", "seq_no", "seq_start").agg(F.concat(F.lit("["), F.array_join(ordered, ", "), F.lit("]")).alias("pkts"))


@query(f"{COUNTS_SQL} select capture, (row // 6)::int as chunk, sum(pkts)::bigint as pkts, count(*) as windows from r where row // 6 < n // 6 group by all")
def win_chunks(spark, sf_dir):
    return win.chunks(counted(spark, sf_dir), 6).groupBy("capture", "chunk").agg(F.sum("pkts").alias("pkts"), F.count("*").alias("windows"))


@query(f"{COUNTS_SQL}, h as (select {K}, list(pkts) over (partition by capture order by window_index rows between 3 preceding and current row) as l from r) select {K}, (list_transform(range(4 - len(l)), lambda x: 0::bigint) || l)::varchar as history from h")
def win_rolling(spark, sf_dir):
    rows = win.history(counted(spark, sf_dir), "pkts", 4, F.lit(0).cast("long"))
    return rows.select(*KEY, F.concat(F.lit("["), F.array_join(F.transform("history", lambda x: x.cast("string")), ", "), F.lit("]")).alias("history"))


def _history_sql(keys: str) -> str:
    past = f"over (partition by {keys} order by window_index rows between 5 preceding and 1 preceding)"
    return f"""select {keys}, window_index, cnt, (lag(cnt) over (partition by {keys} order by window_index))::double as previous, (count(cnt) {past})::int as history_n, round(avg(cnt) {past}, 6) as history_mean, round(stddev_pop(cnt) {past}, 6) as history_std from c"""


@query(f"{WINDOWED}, c as (select {K}, src_mac as host, count(*) as cnt from w group by all) {_history_sql('capture, host')}")
def host_history(spark, sf_dir):
    """What each host sent in the windows before: the last one that has it, and the last five. Buckets of 16 windows, so that most histories cross one."""
    rows = win.before(ft.host_counts(windowed(spark, sf_dir), "src_mac"), ["capture", "host"], "window_index", "cnt", 5, 16)
    return rows.withColumns({c: rounded(F.col(c)) for c in ("history_mean", "history_std")})


@query(f"{COUNTS_SQL.replace('c as (select', 'cc as (select').replace('from c)', 'from cc)')}, c as (select {K}, pkts as cnt from cc) {_history_sql('capture')}")
def rate_history(spark, sf_dir):
    """A capture's rates before each window."""
    rows = win.before(counted(spark, sf_dir).withColumnRenamed("pkts", "cnt"), ["capture"], "window_index", "cnt", 5, 7)
    return rows.withColumns({c: rounded(F.col(c)) for c in ("history_mean", "history_std")})


@query(f"with {PACKETS} select capture, count(*) as packets, arg_min(us, packet_no) as first_us, arg_max(us, packet_no) as last_us, arg_max(us, packet_no) - arg_min(us, packet_no) as duration_us from p group by capture")
def capture_bounds(spark, sf_dir):
    return win.bounds(packets(spark, sf_dir))


_SECONDS = WIDTH / 1_000_000
_RATES = {"pkts_per_s": "count(*)", "bytes_per_s": "sum(len)", "tcp_per_s": "sum(is_tcp)", "udp_per_s": "sum(is_udp)", "icmp_per_s": "sum(is_icmp)"} | {f"udp_dst_{p}_per_s": f"sum(is_udp * (dst_port = {p})::int)" for p in TOP_PORTS}


@query(f"{WINDOWED} select {K}, {', '.join(f'round(({v}) / {_SECONDS}, 6) as {k}' for k, v in _RATES.items())} from w group by all")
def window_rates(spark, sf_dir):
    """Sums merge, so packets aren't copied: hop-sized panes first."""
    sums = {"pkts_per_s": F.lit(1), "bytes_per_s": F.col("len"), "tcp_per_s": F.col("is_tcp"), "udp_per_s": F.col("is_udp"), "icmp_per_s": F.col("is_icmp")}
    sums |= {f"udp_dst_{p}_per_s": F.col("is_udp") * (F.col("dst_port") == p).cast("int") for p in TOP_PORTS}
    rows = win.panes(packets(spark, sf_dir), WIDTH, HOP, sums)
    return rows.select(*KEY, *[rounded(F.col(n) / _SECONDS).alias(n) for n in sums])


_GAPS = f"{WINDOWED}, g as (select {K}, (us - lag(us) over (partition by {K} order by us, packet_no)) / 1000000 as gap from w)"


@query(f"""{_GAPS} select {K}, round(coalesce(avg(gap), 0) + 1e-9, 6) as iat_mean, round(coalesce(stddev_pop(gap), 0) + 1e-9, 6) as iat_std, round(case when avg(gap) > 0 then coalesce(stddev_pop(gap) / avg(gap), 0) else 0 end + 1e-9, 6) as iat_cv,
    round(coalesce(quantile_cont(gap, 0.5), 0) + 1e-9, 6) as iat_median, round(coalesce(quantile_cont(gap, 0.95), 0) + 1e-9, 6) as iat_p95, round(coalesce(quantile_cont(gap, 0.99), 0) + 1e-9, 6) as iat_p99 from g group by all""")
def window_iat(spark, sf_dir):
    d = ft.iat(windowed(spark, sf_dir))
    # halves and hundredths of microseconds are ties in the last place, broken upwards on both sides
    return d.select(*KEY, *[rounded(F.col(c) + 1e-9).alias(c) for c in d.columns if c not in KEY])


@query(f"""{WINDOWED}, b as (select {K}, unnest(range({BINS})) as i from w group by {K}), c as (select b.{K.split(', ')[0]}, b.window_index, i, count(w.us) as n from b left join w on w.capture = b.capture and w.window_index = b.window_index and w.bin = b.i group by all),
    o as (select {K}, n, sum(n) over (partition by {K} order by n, i rows unbounded preceding) as cum from c)
    select {K}, max(n) as max_bin_pkts, round(({BINS} + 1 - 2 * sum(cum) / max(cum)) / {BINS}, 6) as gini_pkts, quantile_cont(n, 0.5)::double as median_bin_pkts from o group by all""")
def window_burst(spark, sf_dir):
    d = ft.burst(windowed(spark, sf_dir), WIDTH, BINS)
    return d.select(*KEY, "max_bin_pkts", rounded(F.col("gini_pkts")).alias("gini_pkts"), F.col("median_bin_pkts").cast("double").alias("median_bin_pkts"))


_VALUES = ("src_ip", "dst_port", "ttl", "src_mac")
_LONG = " union all ".join(f"select {K}, '{c}' as name, {c}::varchar as value from w" for c in _VALUES)


@query(f"""{WINDOWED}, l as ({_LONG}), c as (select {K}, name, value, count(*) as n from l group by all), h as (select {K}, name, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from c group by all)
    select {K}, {', '.join(f"round(max(case when name = '{c}' then h end), 6) as H_{c}" for c in _VALUES)} from h group by all""")
def window_entropy(spark, sf_dir):
    d = ft.distributions(windowed(spark, sf_dir), list(_VALUES))
    return d.select(*KEY, *[rounded(F.col(f"H_{c}")).alias(f"H_{c}") for c in _VALUES])


@query(f"{WINDOWED} select {K}, {', '.join(f'count(distinct {c}) as n_unique_{c}' for c in _VALUES)}, round(max(t), 6) as top_src_mac from (select *, count(*) over (partition by {K}, src_mac) / count(*) over (partition by {K}) as t from w) group by all")
def window_unique(spark, sf_dir):
    d = ft.distributions(windowed(spark, sf_dir), list(_VALUES))
    return d.select(*KEY, *[f"n_unique_{c}" for c in _VALUES], rounded(F.col("top_src_mac")).alias("top_src_mac"))


@query(f"""{WINDOWED}, s as (select {K}, sum(tcp_syn) as syn, sum(tcp_synack) as synack, count(*) filter (ssdp_method = 'M-SEARCH') as m, count(*) filter (ssdp_method = 'NOTIFY') as n, count(*) filter (ssdp_method = '200-OK') as r, count(*) filter (is_udp = 1 and ssdp_method in ('M-SEARCH', 'NOTIFY')) as asked, count(*) filter (is_udp = 1 and ssdp_method = '200-OK') as answered, sum(is_udp) as udp, count(*) filter (is_udp = 1 and dst_port = {TOP_PORTS[0]}) as hit from w group by all)
    select {K}, round(coalesce(syn / nullif(synack, 0), 0), 6) as tcp_syn_over_synack, round(coalesce(asked / nullif(answered, 0), 0), 6) as udp_ssdp_req_over_resp, 0.0::double as udp_dns_req_over_resp, 0.0::double as udp_ntp_req_over_resp,
    round(coalesce(hit / nullif(udp, 0), 0), 6) as udp_port_fraction, round(hit / greatest(udp, 1), 6) as ssdp_multicast_hit_rate, m as ssdp_msearch, n as ssdp_notify, r as ssdp_200ok from s""")
def window_ratios(spark, sf_dir):
    d = ft.ratios(windowed(spark, sf_dir), TOP_PORTS[0])
    return d.select(*KEY, *[rounded(F.col(c)).alias(c) if "over" in c or "fraction" in c or "rate" in c else c for c in d.columns if c not in KEY])


@query(f"""{WINDOWED}, s as (select {K}, count(*) as n, min(len) as lo, max(len) as hi, avg(len) as mean, stddev_pop(len) as std, least(20, greatest(5, floor(sqrt(count(*)))))::bigint as nb from w group by all),
    c as (select {K}, nb, lo, hi, case when hi = lo then nb // 2 else least(nb - 1, (len - lo) * nb // (hi - lo)) end as b, count(*) as c from w join s using (capture, window_index) group by all),
    m as (select {K}, nb, lo, hi, b, row_number() over (partition by {K} order by c desc, b) as rn from c)
    select {K}, round(mean, 6) as pkt_len_mean, round(std, 6) as pkt_len_std, round(case when m.hi = m.lo then m.lo - 0.5 + (b + 0.5) / m.nb else m.lo + (b + 0.5) * (m.hi - m.lo) / m.nb end, 6) as pkt_len_mode from s join m using (capture, window_index) where rn = 1""")
def window_len_mode(spark, sf_dir):
    d = ft.lengths(windowed(spark, sf_dir))
    return d.select(*KEY, *[rounded(F.col(c)).alias(c) for c in d.columns if c not in KEY])


_SSDP_LONG = " union all ".join(f"select {K}, '{n}' as name, {c} as value from w where {c} is not null" for c, n in ft.SSDP.items())
_JOINED = " ".join(f"join ({SQL[n]}) using ({K})" for n in ("window_iat", "window_burst", "window_entropy", "window_unique", "window_ratios", "window_len_mode"))


@query(f"""with r as ({SQL['window_rates']}), s as ({WINDOWED}, l as ({_SSDP_LONG}), c as (select {K}, name, value, count(*) as n from l group by all), h as (select {K}, name, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from c group by all)
      select {K}, {', '.join(f"max(case when name = '{n}' then h end) as H_{n}" for n in ft.SSDP.values())} from h group by all)
    select * exclude (median_bin_pkts, top_src_mac, H_ST, H_MAN, H_USER_AGENT), top_src_mac as src_mac_dominance, {', '.join(f'round(coalesce(H_{n}, 0), 6) as H_{n}' for n in ft.SSDP.values())} from r {_JOINED} join ({WINDOWED} select {K}, count(distinct dst_ip) as n_unique_dst_ip from w group by all) using ({K}) left join s using ({K})""")
def dos_features(spark, sf_dir):
    """All of the static set in one table."""
    d = ft.dos_static(windowed(spark, sf_dir), WIDTH, BINS, TOP_PORTS)
    gaps = [f"iat_{n}" for n in ("mean", "std", "cv", "median", "p95", "p99")]
    whole = ["max_bin_pkts", *[f"n_unique_{c}" for c in (*_VALUES, "dst_ip")], "ssdp_msearch", "ssdp_notify", "ssdp_200ok"]
    real = [*_RATES, "gini_pkts", *[f"H_{c}" for c in _VALUES], "src_mac_dominance", *[f"H_{n}" for n in ft.SSDP.values()], "pkt_len_mean", "pkt_len_std", "pkt_len_mode"]
    real += ["tcp_syn_over_synack", "udp_ssdp_req_over_resp", "udp_dns_req_over_resp", "udp_ntp_req_over_resp", "udp_port_fraction", "ssdp_multicast_hit_rate"]
    return d.select(*KEY, *whole, *[rounded(F.col(c) + 1e-9).alias(c) for c in gaps], *[rounded(F.col(c)).alias(c) for c in real])


@query(f"""{WINDOWED} select {K}, bin::int as bin, count(*) as bin_total_pkts, sum(len)::bigint as bin_total_bytes, count(*) filter (is_tcp = 1) as bin_tcp_pkts, count(*) filter (is_udp = 1) as bin_udp_pkts, count(*) filter (is_icmp = 1) as bin_icmp_pkts,
    sum(tcp_syn)::bigint as bin_tcp_syn, sum(tcp_synack)::bigint as bin_tcp_synack, {', '.join(f'count(*) filter (is_udp = 1 and dst_port = {p}) as bin_udp_pkts_dst_{p}' for p in TOP_PORTS)},
    count(*) filter (ssdp_method = 'M-SEARCH') as bin_ssdp_msearch, count(*) filter (ssdp_method = '200-OK') as bin_ssdp_response from w group by all""")
def bins_dos(spark, sf_dir):
    return ft.dos_bins(windowed(spark, sf_dir), WIDTH, BINS, TOP_PORTS)


_D = ", ".join(f"count(distinct {c}) filter (is_arp = 1) as bin_{n}" for c, n in (("arp_sender_ip", "sender_ips"), ("arp_sender_mac", "sender_macs"), ("arp_target_ip", "target_ips"), ("arp_target_mac", "target_macs")))


def _conflict_sql(name, keys, owner, claim, where="is_arp = 1"):
    return f"{name} as (select {keys}, max(n) as mx, avg(n) as mn, count(*) filter (n > 1) as cf, count(*) filter (n > 1) / count(*) as rt from (select {keys}, {owner}, count(distinct {claim}) as n from w where {where} group by all) group by all)"


@query(f"""{WINDOWED}, {_conflict_sql('s', K + ', bin', 'arp_sender_mac', 'arp_sender_ip')}, {_conflict_sql('t', K + ', bin', 'arp_target_ip', 'arp_sender_mac')},
    b as (select {K}, bin, count(*) as bin_pkts, sum(len)::bigint as bin_bytes, count(*) filter (is_arp = 1) as bin_arp, count(*) filter (is_arp = 1 and arp_opcode = 1) as bin_requests, count(*) filter (is_arp = 1 and arp_opcode = 2) as bin_replies, {_D}, count(*) filter (is_arp = 1 and arp_is_gratuitous = 1) as bin_gratuitous from w group by all)
    select b.* replace (b.bin::int as bin), coalesce(s.cf, 0) as bin_conflicting_senders, coalesce(t.cf, 0) as bin_conflicting_targets from b left join s using (capture, window_index, bin) left join t using (capture, window_index, bin)""")
def bins_arp(spark, sf_dir):
    return ft.arp_bins(windowed(spark, sf_dir), WIDTH, BINS)


@query(f"""{WINDOWED}, {_conflict_sql('c', K, 'arp_target_ip', 'arp_sender_mac')}, {_conflict_sql('i', K, 'arp_sender_mac', 'arp_sender_ip')}, {_conflict_sql('r1', K, 'arp_sender_mac', 'arp_sender_ip', 'is_arp = 1 and arp_opcode = 2')}, {_conflict_sql('r2', K, 'arp_target_ip', 'arp_sender_mac', 'is_arp = 1 and arp_opcode = 2')},
    t as (select {K}, count(*) as pkts, count(*) filter (is_arp = 1) as arp, sum(len) as bytes, count(*) filter (is_arp = 1 and arp_opcode = 1) as req, count(*) filter (is_arp = 1 and arp_opcode = 2) as rep, count(*) filter (is_arp = 1 and arp_is_gratuitous = 1) as grat, count(*) filter (is_arp = 1 and arp_opcode = 1 and arp_target_mac = '00:00:00:00:00:00') as to_all,
      count(distinct arp_sender_ip || '>' || arp_target_ip) filter (is_arp = 1) as pairs, count(distinct arp_sender_ip) filter (is_arp = 1) as sips from w group by all)
    , g as (select {K}, avg(gap) as gm, stddev_pop(gap) as gs from (select {K}, (us - lag(us) over (partition by {K} order by us, packet_no)) / 1000000 as gap from w where is_arp = 1) group by all),
    u as (select {K}, count(distinct arp_sender_mac) as unique_sender_macs, count(distinct arp_target_ip) as unique_target_ips, count(distinct arp_target_mac) as unique_target_macs from w where is_arp = 1 group by all),
    bc as (select {K}, max(bin_conflicting_senders) as max_conflicting_senders_bin, max(bin_conflicting_targets) as max_conflicting_targets_bin from ({SQL['bins_arp']}) group by all), mb as (select {K}, max_bin_pkts, median_bin_pkts from ({SQL['window_burst']}))
    select {K}, round(bytes / {_SECONDS}, 6) as bytes_per_s, round(arp / {_SECONDS}, 6) as arp_pkts_per_s, round(rep / {_SECONDS}, 6) as arp_reply_rate, round(grat / {_SECONDS}, 6) as arp_gratuitous_rate, round(coalesce(gm, 0) + 1e-9, 6) as arp_iat_mean, round(coalesce(gs, 0) + 1e-9, 6) as arp_iat_std,
    coalesce(unique_sender_macs, 0) as unique_sender_macs, coalesce(unique_target_ips, 0) as unique_target_ips, coalesce(unique_target_macs, 0) as unique_target_macs, round(coalesce(i.rt, 0), 6) as conflict_ratio_ips_per_mac, coalesce(max_bin_pkts, 0) as max_bin_pkts, coalesce(median_bin_pkts, 0) as median_bin_pkts,
    coalesce(max_conflicting_senders_bin, 0) as max_conflicting_senders_bin, coalesce(max_conflicting_targets_bin, 0) as max_conflicting_targets_bin,
    round(pkts / {_SECONDS}, 6) as pkts_per_s, round(bytes * (arp / pkts) / {_SECONDS}, 6) as arp_bytes_per_s, round(arp / pkts, 6) as arp_fraction, round(req / {_SECONDS}, 6) as arp_request_rate, round(grat / greatest(arp, 1), 6) as arp_gratuitous_fraction, round(to_all / greatest(req, 1), 6) as arp_broadcast_fraction,
    round(rep / greatest(req, 1), 6) as arp_reply_to_request_ratio, round(req / greatest(rep, 1), 6) as arp_request_to_reply_ratio, pairs as unique_sender_target_pairs, sips as unique_sender_ips, coalesce(c.mx, 0) as max_claims_per_ip, round(coalesce(c.mn, 0), 6) as mean_claims_per_ip, round(coalesce(c.rt, 0), 6) as conflict_ratio_claims_per_ip,
    coalesce(i.mx, 0) as max_ips_per_mac, round(coalesce(i.mn, 0), 6) as mean_ips_per_mac, round(coalesce(r1.rt, 0), 6) as reply_conflict_ratio, round(coalesce(r2.rt, 0), 6) as target_reply_conflict_ratio
    from t left join c using (capture, window_index) left join i using (capture, window_index) left join r1 using (capture, window_index) left join r2 using (capture, window_index)
    left join g using (capture, window_index) left join u using (capture, window_index) left join bc using (capture, window_index) left join mb using (capture, window_index)""")
def arp_static(spark, sf_dir):
    d = ft.arp_static(windowed(spark, sf_dir), WIDTH, BINS)
    whole = [c for c in d.columns if c.startswith(("unique_", "max_"))]
    gaps = ["arp_iat_mean", "arp_iat_std"]
    real = [c for c in d.columns if c not in (*KEY, *whole, *gaps, "median_bin_pkts")]
    return d.select(*KEY, *whole, F.col("median_bin_pkts").cast("double").alias("median_bin_pkts"), *[rounded(F.col(c) + 1e-9).alias(c) for c in gaps], *[rounded(F.col(c)).alias(c) for c in real])


@query(f"""{WINDOWED}, {_conflict_sql('c', K, 'arp_sender_ip', 'arp_sender_mac')}, {_conflict_sql('i', K, 'arp_sender_mac', 'arp_sender_ip')}, {_conflict_sql('g', K, 'arp_target_ip', 'arp_sender_mac')},
    x as (select {K}, avg(gap) as gm, stddev_pop(gap) as gs from (select {K}, (us - lag(us) over (partition by {K} order by us, packet_no)) / 1000000 as gap from w where is_arp = 1) group by all),
    t as (select {K}, count(*) as pkts, sum(len) as bytes, count(*) filter (is_arp = 1) as arp, sum(case when is_arp = 1 then len else 0 end) as ab, count(*) filter (is_arp = 1 and arp_opcode = 1) as req, count(*) filter (is_arp = 1 and arp_opcode = 2) as rep, count(*) filter (is_arp = 1 and arp_is_gratuitous = 1) as grat,
      count(distinct arp_sender_ip || '>' || arp_target_ip) filter (is_arp = 1) as unique_sender_target_pairs, {', '.join(f'count(distinct arp_{n}) filter (is_arp = 1) as unique_{n}s' for n in ('sender_ip', 'sender_mac', 'target_ip', 'target_mac'))} from w group by all)
    select {K}, {', '.join(f'round({v} / {_SECONDS}, 6) as {n}' for n, v in (('pkts_per_s', 'pkts'), ('bytes_per_s', 'bytes'), ('arp_pkts_per_s', 'arp'), ('arp_bytes_per_s', 'ab'), ('arp_request_rate', 'req'), ('arp_reply_rate', 'rep'), ('arp_gratuitous_rate', 'grat')))},
    round(arp / pkts, 6) as arp_fraction, round(coalesce(grat / nullif(arp, 0), 0), 6) as arp_gratuitous_fraction, round(coalesce(rep / nullif(req, 0), 0), 6) as arp_reply_to_request_ratio, round(coalesce(req / nullif(rep, 0), 0), 6) as arp_request_to_reply_ratio,
    round(coalesce(gm, 0) + 1e-9, 6) as arp_iat_mean, round(coalesce(gs, 0) + 1e-9, 6) as arp_iat_std, unique_sender_ips, unique_sender_macs, unique_target_ips, unique_target_macs, unique_sender_target_pairs,
    coalesce(c.mx, 0) as max_claims_per_ip, round(coalesce(c.mn, 0), 6) as mean_claims_per_ip, round(coalesce(c.rt, 0), 6) as conflict_ip_ratio, coalesce(i.mx, 0) as max_ips_per_mac, round(coalesce(i.mn, 0), 6) as mean_ips_per_mac, round(coalesce(i.rt, 0), 6) as sender_conflict_ratio, round(coalesce(g.rt, 0), 6) as target_conflict_ratio
    from t left join c using (capture, window_index) left join i using (capture, window_index) left join g using (capture, window_index) left join x using (capture, window_index)""")
def arp_static_seq(spark, sf_dir):
    d = ft.arp_static_seq(windowed(spark, sf_dir), WIDTH)
    whole = [c for c in d.columns if c.startswith(("unique_", "max_"))]
    gaps = ["arp_iat_mean", "arp_iat_std"]
    real = [c for c in d.columns if c not in (*KEY, *whole, *gaps)]
    return d.select(*KEY, *whole, *[rounded(F.col(c) + 1e-9).alias(c) for c in gaps], *[rounded(F.col(c)).alias(c) for c in real])


_FLOW = ("src_ip", "dst_ip", "src_port", "dst_port")
_FLONG = " union all ".join(f"select {K}, '{c}' as name, {c}::varchar as value from w" for c in _FLOW)


@query(f"""{WINDOWED}, l as ({_FLONG}), vc as (select {K}, name, value, count(*) as n from l group by all), h as (select {K}, name, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h, count(*) as u from vc group by all),
    hw as (select {K}, {', '.join(f"round(max(case when name = '{c}' then h end), 6) as {c}_entropy, max(case when name = '{c}' then u end) as unique_{c}s" for c in _FLOW)} from h group by all),
    g as (select {K}, round(coalesce(avg(gap), 0), 6) as mean_iat, round(coalesce(stddev_samp(gap), 0), 6) as std_iat from (select {K}, (us - lag(us) over (partition by {K} order by packet_no)) / 1000000 as gap from w) group by all),
    t as (select {K}, count(*) as pkt_count, sum(len)::bigint as byte_count, round(avg(len), 6) as mean_pkt_len, round(coalesce(stddev_samp(len), 0), 6) as std_pkt_len, min(len) as min_pkt_len, max(len) as max_pkt_len, sum(is_tcp)::bigint as tcp_count, sum(is_udp)::bigint as udp_count, sum(is_icmp)::bigint as icmp_count,
      round(count(*) / {_SECONDS}, 6) as pps, round(8 * sum(len) / {_SECONDS}, 6) as bps, round(sum(is_tcp) / count(*), 6) as tcp_ratio, round(sum(is_udp) / count(*), 6) as udp_ratio, round(sum(is_icmp) / count(*), 6) as icmp_ratio, {', '.join(f'sum({f})::bigint as {f}' for f in ('tcp_syn', 'tcp_ack', 'tcp_rst', 'tcp_fin'))} from w group by all)
    select * from t join g using (capture, window_index) join hw using (capture, window_index)""")
def flow_features(spark, sf_dir):
    d = ft.flow(windowed(spark, sf_dir), WIDTH)
    real = ("mean_pkt_len", "std_pkt_len", "pps", "bps", "tcp_ratio", "udp_ratio", "icmp_ratio", "mean_iat", "std_iat", *[f"{c}_entropy" for c in _FLOW])
    return d.select(*KEY, "pkt_count", "byte_count", "min_pkt_len", "max_pkt_len", "tcp_count", "udp_count", "icmp_count", "tcp_syn", "tcp_ack", "tcp_rst", "tcp_fin", *[rounded(F.col(c)).alias(c) for c in real], *[f"unique_{c}s" for c in _FLOW])


@query(f"{WINDOWED} select {K}, src_mac as host, count(*) as cnt from w group by all")
def host_counts(spark, sf_dir):
    return ft.host_counts(windowed(spark, sf_dir), "src_mac")


@query(f"{WINDOWED} select {K}, lower(arp_sender_mac) as mac, arp_sender_ip as ip, count(*) as cnt, count(*) filter (arp_opcode = 2) as replies from w where is_arp = 1 group by all")
def claim_counts(spark, sf_dir):
    return ft.claim_counts(windowed(spark, sf_dir))


@query("""select l_returnflag, max(n) as max_claims, round(avg(n), 6) as mean_claims, count(*) filter (n > 1) as conflicts_claims, round(count(*) filter (n > 1) / count(*), 6) as conflict_ratio_claims
    from (select l_returnflag, l_suppkey, count(distinct l_partkey) as n from lineitem group by all) group by all""")
def claim_conflicts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    d = ft.conflicts(rows.withColumn("l_suppkey", F.col("l_suppkey").cast("string")).withColumn("l_partkey", F.col("l_partkey").cast("string")), ["l_returnflag"], "l_suppkey", "l_partkey", "claims")
    return d.select("l_returnflag", "max_claims", rounded(F.col("mean_claims")).alias("mean_claims"), "conflicts_claims", rounded(F.col("conflict_ratio_claims")).alias("conflict_ratio_claims"))
