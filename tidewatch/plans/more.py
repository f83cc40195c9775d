"""Queries over overrides, claims by address, truths of windows and files, whole preparation, and runs without a tail."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import net
from tidewatch.functions.stats import rounded, wrapped_sum
from tidewatch.operators import attribute as at
from tidewatch.operators import decide as dc
from tidewatch.operators import evaluate as ev
from tidewatch.operators import features as ft
from tidewatch.operators import prep
from tidewatch.operators import windows as win
from tidewatch.plans import decided as de
from tidewatch.plans.prepared import _wide
from tidewatch.plans.registry import HOP, PACKETS, SQL, query
from tidewatch.plans.windowed import COUNTS_SQL, counted, windowed
from tidewatch.sources import capture_files, pcap
from tidewatch.sources.shared import scratch
from tidewatch.sources.tables import packets

KEY, K = ft.KEY, ", ".join(ft.KEY)



@query(f"""with {PACKETS}, i as (select *, string_split(src_ip, '.') as s, string_split(dst_ip, '.') as d from p) select strftime(make_timestamp(us), '%Y-%m-%d') as day, count(*) as packets, sum(us)::bigint as times, sum(len)::bigint as bytes, sum(is_tcp)::bigint as tcp, sum(is_udp)::bigint as udp, sum(is_icmp)::bigint as icmp, sum(tcp_syn)::bigint as syn, sum(tcp_fin)::bigint as fin,
    sum(case when is_icmp = 0 then src_port end)::bigint as src_ports, sum(ttl)::bigint as ttls, count(distinct src_ip) as sources, min(dst_ip) as first_target from i group by 1""")
def capture_roundtrip(spark, sf_dir):
    """Events written as captures, one a task, and read again in ranges of 32 KB: every packet comes back once, with its time, lengths, addresses, ports and flags.

    ``times`` is a check on all packets' times: their exact sum in 64 bits, wrapped where it doesn't fit (a day of more than about 5,400 packets, at which SQL's cast
    has no value). Users are numbered past an address's octets, so what a frame holds is the address carried into 32 bits.
    """
    folder = scratch(spark, "captures")
    rows = packets(spark, sf_dir).withColumn("src_ip", net.carried(F.col("src_ip"))).repartition(3, "packet_no")
    capture_files.write(capture_files.framed(rows), folder, 100 + F.col("len"))
    got = pcap.dos_packets(pcap.read(spark, f"{folder}/*.pcap", range_bytes=1 << 15))
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    return got.groupBy(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("packets"), wrapped_sum(F.col("us")).alias("times"), total(F.col("frame_len") - 100, "bytes"), *[total(f"is_{p}", p) for p in ("tcp", "udp", "icmp")], total("tcp_syn", "syn"), total("tcp_fin", "fin"),
        total("src_port", "src_ports"), total("ttl", "ttls"), F.count_distinct("src_ip").alias("sources"), F.min("dst_ip").alias("first_target"),
    )


_CLAIMED = "cl as (select capture, window_index, min(w_start) as seen_at, lower(arp_sender_mac) as mac, arp_sender_ip as ip, count(*) filter (arp_opcode = 2) as replies from w where is_arp = 1 group by all)"


@query(f"""{de._ARP}, {de._fold_sql('q', 2, 1, 1, 'v')}, {_CLAIMED}, cw as (select {K}, mac, min(seen_at) as seen_at from cl where replies > 0 group by all having count(distinct ip) >= 2), cc as (select capture, count(distinct window_index) as n, min(seen_at) as first_at from cw group by capture)
    select v.capture, case when n is not null then 'attack' else 'normal' end as decision, first_at as first_attack, case when n is not null then greatest(attack_windows, n, 1) else 0 end as attack_windows, max_prob from v left join cc using (capture)""")
def arp_override(spark, sf_dir):
    """ARP verdicts after the claims."""
    v = dc.verdict(dc.arp_gate(de.arp_snapshots(spark, sf_dir)), dc.ArpConfig())
    rows = windowed(spark, sf_dir)
    claims = ft.claim_counts(rows).join(rows.groupBy(*KEY).agg(F.min("w_start").alias("w_start")), KEY)
    return dc.arp_override(v, claims)


@query(f"""with {PACKETS}, cl as (select capture, lower(arp_sender_mac) as mac, arp_sender_ip as ip, count(*) as replies from p where is_arp = 1 and arp_opcode = 2 group by all), r as (select *, row_number() over (partition by capture, mac order by replies desc, ip) as r from cl)
    select capture, mac, string_agg(ip || '=' || replies, ',' order by r) as claimed_ips, max(case when r = 1 then ip end) as top_ip from r where r <= 5 group by capture, mac""")
def claimed_addresses(spark, sf_dir):
    """The five addresses that each mac's replies claim most."""
    return at.top_claims(ft.claim_counts(packets(spark, sf_dir).withColumn("window_index", F.lit(0).cast("long"))))


@query(f"""with v as ({SQL['fsm_dos']}), r as ({SQL['claim_rank']}), b as (select capture, mac, row_number() over (partition by capture order by score desc, mac) as n from r where distinct_ips >= 2)
    select v.capture, case when b.mac is not null then 'attack' else decision end as decision, b.mac as conflicting_mac, attack_windows from v left join b on b.capture = v.capture and n = 1""")
def reply_override(spark, sf_dir):
    """DoS verdicts, overruled where a mac answers for several addresses."""
    return at.reply_override(de.fsm_dos(spark, sf_dir), de.claim_rank(spark, sf_dir)).select("capture", "decision", "conflicting_mac", "attack_windows")


@query(f"""{COUNTS_SQL}, d as (select distinct capture, n from r where n >= 5), t as (select capture, unnest(generate_series(0, n - 5, 3)) as seq_start from d)
    select t.capture, seq_start::int as seq_start, sum(pkts)::bigint as pkts, count(*) as windows from t join r on r.capture = t.capture and row between seq_start and seq_start + 4 group by all""")
def win_sequences_whole(spark, sf_dir):
    """Runs at whole strides only: what is left over has no run of its own."""
    rows = win.sequences(counted(spark, sf_dir), 5, 3, tail=False)
    return rows.groupBy("capture", "seq_start").agg(F.sum("pkts").alias("pkts"), F.count("*").alias("windows"))


@query(f"{de.SCORED}, s as (select capture, u0 + {6 * HOP} as attack_start from a where right(capture, 2)::int % 3 = 0) select {K}, coalesce(start >= attack_start, false)::int as label, prob from sc left join s using (capture)")
def window_truth(spark, sf_dir):
    """Truths of windows by the start of their capture's attack."""
    a = win.anchors(packets(spark, sf_dir), HOP).where(F.right(F.col("capture"), F.lit(2)).cast("int") % 3 == 0)
    rows = ev.window_truth(de.scores(spark, sf_dir), a.select("capture", (F.col("u0") + 6 * HOP).alias("attack_start")))
    return rows.select(*KEY, "label", "prob")


@query(f"with v as ({SQL['fsm_dos']}) select capture, decision, (right(capture, 2)::int % 2) as label from v where right(capture, 2)::int % 5 <> 0")
def file_truth(spark, sf_dir):
    """Verdicts with their files' truths, by base name: folders differ, and files without truth are left out."""
    day = F.right(F.col("capture"), F.lit(2)).cast("int")
    v = de.fsm_dos(spark, sf_dir)
    truth = v.where(day % 5 != 0).select(F.concat(F.lit("D:\\truth\\"), F.col("capture")).alias("capture"), (day % 2).alias("label"))
    return ev.predictions_with_truth(v.select(F.concat(F.lit("/in/"), F.col("capture")).alias("capture"), "decision"), truth)


@query(f"""with e as (select vec_id, embedding[1]::double as x0, case when vec_id % 7 = 0 then null else embedding[2]::double end as x1 from embeddings), f as (select vec_id, ln(1 + greatest(coalesce(x0, 0), 0)) as x0, coalesce(x1, 0) as x1 from e),
    b as (select {', '.join(f'quantile_cont({c}, 0.05) as {c}_l, quantile_cont({c}, 0.95) as {c}_h' for c in ('x0', 'x1'))} from f), g as (select vec_id, {', '.join(f'least(greatest({c}, {c}_l), {c}_h) as {c}' for c in ('x0', 'x1'))} from f, b),
    s as (select {', '.join(f'avg({c}) as {c}_m, stddev_pop({c}) as {c}_s' for c in ('x0', 'x1'))} from g) select vec_id, {', '.join(f'round(({c} - {c}_m) / {c}_s, 6) as {c}' for c in ('x0', 'x1'))} from g, s""")
def whole_preparation(spark, sf_dir):
    """Invalid values to 0, logarithm of one column, clips at fitted quantiles, a fitted scale."""
    rows = _wide(spark, sf_dir, 2).withColumn("x1", F.when(F.col("vec_id") % 7 != 0, F.col("x1")))
    clean = rows.select("vec_id", prep.log_clipped(prep.finite(F.col("x0"))).alias("x0"), prep.finite(F.col("x1")).alias("x1"))
    clips = prep.fit_clip(clean, ["x0", "x1"], 0.05, 0.95)
    scaler = prep.fit_scaler(prep.clip(clean, clips), ["x0", "x1"], "standard")
    out = prep.prepared(rows, ["x0", "x1"], ["x0"], clips, scaler)
    return out.select("vec_id", *[rounded(F.col(c)).alias(c) for c in ("x0", "x1")])
