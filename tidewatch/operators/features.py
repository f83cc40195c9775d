"""Feature sets over windowed packets.

Input of every function: packets with capture and window_index (see operators.windows). Output: a row a
window (or a window and bin). A whole set reads the packets twice: once in time order, for gaps and, in the same aggregation, all sums, counts
and bins; and once as a long table of values (or of claims) that is counted before it is shuffled, for all distributions.

A group of features is a pair: its aggregates by name, and the features as expressions of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.fold import let
from tidewatch.functions.net import sniffed_method
from tidewatch.functions.stats import entropy, gini, percentile, ratio
from tidewatch.operators.windows import microbin

KEY = ["capture", "window_index"]
MICROS = 1_000_000


def rates(width: int, ports) -> dict[str, Column]:
    """Per-second rates by protocol and by destination port of UDP."""
    seconds = width / MICROS
    count = {"pkts_per_s": F.lit(1), "bytes_per_s": F.col("len"), "tcp_per_s": F.col("is_tcp"), "udp_per_s": F.col("is_udp"), "icmp_per_s": F.col("is_icmp")}
    count |= {f"udp_dst_{p}_per_s": (F.col("is_udp") * (F.col("dst_port") == p).cast("int")) for p in ports}
    return {n: F.coalesce(F.sum(c), F.lit(0)) / seconds for n, c in count.items()}


Measures = tuple[dict[str, Column], dict[str, Column]]


def _measured(rows: DataFrame, *groups: Measures) -> DataFrame:
    """The features of several groups, from one aggregation."""
    aggregates = {n: c for group in groups for n, c in group[0].items()}
    t = rows.groupBy(*KEY).agg(*[c.alias(n) for n, c in aggregates.items()])
    return t.select(*KEY, *[c.alias(n) for group in groups for n, c in group[1].items()])


def _as_they_are(aggregates: dict[str, Column]) -> Measures:
    return aggregates, {n: F.col(n) for n in aggregates}


def with_gaps(rows: DataFrame, order=("us", "packet_no"), of: Column | None = None) -> DataFrame:
    """Adds gap: seconds since the window's last packet before this one in ``order``. ``of``: only such packets have one, and count as last."""
    w = W.partitionBy(*KEY).orderBy(*order)
    if of is None:
        return rows.withColumn("gap", (F.col("us") - F.lag("us").over(w)) / MICROS)
    before = F.last(F.when(of, F.col("us")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("gap", F.when(of, (F.col("us") - before) / MICROS))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _gap_measures() -> Measures:
    q = percentile(F.col("gap"), F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    mean, std = F.col("__gap_mean"), F.col("__gap_std")
    out = {"iat_mean": _zero(mean), "iat_std": _zero(std), "iat_cv": F.when(mean > 0, _zero(ratio(std, mean))).otherwise(0.0)}
    return {"__gap_mean": F.avg("gap"), "__gap_std": F.stddev_pop("gap"), "__gap_q": q}, out | {n: _zero(F.get("__gap_q", F.lit(i))) for i, n in enumerate(("iat_median", "iat_p95", "iat_p99"))}


def iat(rows: DataFrame, order=("us", "packet_no")) -> DataFrame:
    """Gaps between packets in time order: mean, deviation (population), its ratio to the mean, median, 95th and 99th percentile in seconds."""
    return _measured(with_gaps(rows, order), _gap_measures())


def _bin_measures(width: int, bins: int) -> Measures:
    """Packets of each of the window's bins, zeros included, and what they tell of bursts."""
    place = microbin(width, bins)
    counts = F.array(*[F.col(f"__bin{i}") for i in range(bins)])
    middle = F.array_sort(counts)
    median = (F.get(middle, F.lit((bins - 1) // 2)) + F.get(middle, F.lit(bins // 2))) / 2
    return {f"__bin{i}": F.count_if(place == i) for i in range(bins)}, {"max_bin_pkts": F.array_max(counts), "gini_pkts": gini(counts), "median_bin_pkts": median}


def burst(rows: DataFrame, width: int, bins: int) -> DataFrame:
    return _measured(rows, _bin_measures(width, bins))


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(window, name, value, n) for all columns at once; nulls and empty strings aren't values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns])
    long = rows.select(*KEY, F.inline(pairs)).where("value is not null")
    return long.groupBy(*KEY, "name", "value").agg(F.count("*").alias("n"))


def distributions(rows: DataFrame, columns: list[str], histogram: str | None = None) -> DataFrame:
    """Entropy (H_), distinct values (n_unique_), the largest value's share (top_) of each column, as columns of one row a window.

    ``histogram``: one more column of whole numbers, whose values come with their counts as an array (value, n); of lengths
    there are no more than a packet can have.
    """
    values = [*columns, *([histogram] if histogram else [])]
    parts = [entropy(F.col("n")).alias("h"), F.count("*").alias("u"), ratio(F.max("n"), F.sum("n")).alias("t")]
    if histogram:
        parts.append(F.collect_list(F.when(F.col("name") == histogram, F.struct(F.col("value").cast("long").alias("value"), "n"))).alias("cells"))
    by = value_counts(rows, values).groupBy(*KEY, "name").agg(*parts)
    each = [F.max(F.when(F.col("name") == c, F.col(x))).alias(f"{p}{c}") for c in columns for p, x in (("H_", "h"), ("n_unique_", "u"), ("top_", "t"))]
    if histogram:
        each.append(F.first(F.when(F.col("name") == histogram, F.col("cells")), ignorenulls=True).alias(f"cells_{histogram}"))
    whole = by.groupBy(*KEY).agg(*each)
    found = [F.coalesce(F.col(f"{p}{c}"), F.lit(0).cast("double" if p != "n_unique_" else "long")).alias(f"{p}{c}") for c in columns for p in ("H_", "n_unique_", "top_")]
    return whole.select(*KEY, *found, *([f"cells_{histogram}"] if histogram else []))


def discovery_asked() -> Column:
    """Searches and notices of discovery over UDP, on any port."""
    return F.count_if((F.col("is_udp") == 1) & F.col("ssdp_method").isin("M-SEARCH", "NOTIFY"))


def discovery_answered() -> Column:
    return F.count_if((F.col("is_udp") == 1) & (F.col("ssdp_method") == "200-OK"))


def ratios(rows: DataFrame, port: int) -> DataFrame:
    """Request and response ratios. A packet with SYN and ACK counts as SYN too; ratios over nothing are 0.

    Searches and notices over UDP are what discovery answers are held against; the three counts take any packet with the method. The DNS and NTP ratios have no response counter behind them, so they are 0 throughout.
    """
    return _measured(rows, _ratio_measures(port))


def _ratio_measures(port: int) -> Measures:
    method = lambda m: F.count_if(F.col("ssdp_method") == m)
    aggregates = {"__syn": F.sum("tcp_syn"), "__synack": F.sum("tcp_synack"), "ssdp_msearch": method("M-SEARCH"), "ssdp_notify": method("NOTIFY"), "ssdp_200ok": method("200-OK"), "__udp": F.sum("is_udp")}
    aggregates |= {"__hit": F.count_if((F.col("is_udp") == 1) & (F.col("dst_port") == port)), "__asked": discovery_asked(), "__answered": discovery_answered()}
    c = F.col
    return aggregates, {
        "tcp_syn_over_synack": ratio(c("__syn"), c("__synack")),
        "udp_ssdp_req_over_resp": ratio(c("__asked"), c("__answered")),
        "udp_dns_req_over_resp": F.lit(0.0),
        "udp_ntp_req_over_resp": F.lit(0.0),
        "udp_port_fraction": ratio(c("__hit"), c("__udp")),
        "ssdp_multicast_hit_rate": ratio(c("__hit"), F.greatest(c("__udp"), F.lit(1))),
        **{n: c(n) for n in ("ssdp_msearch", "ssdp_notify", "ssdp_200ok")},
    }


def mode_of(cells: Column) -> Column:
    """The middle of the first fullest of min(20, max(5, floor(sqrt(n)))) bins of equal width between the least and the largest value;
    equal values stand in a bin one wide around them. ``cells``: an array of (value, n)."""

    def middle(s: Column) -> Column:
        same = s["hi"] == s["lo"]
        nbins = F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.sqrt(s["n"].cast("double"))))).cast("long")
        place = lambda x: F.when(same, F.floor(nbins / 2)).otherwise(F.least(nbins - 1, F.floor(((x["value"] - s["lo"]) * nbins) / F.greatest(s["hi"] - s["lo"], F.lit(1)))))
        counts = F.transform(F.sequence(F.lit(0).cast("long"), nbins - 1), lambda b: F.aggregate(F.filter(cells, lambda x: place(x) == b), F.lit(0).cast("long"), lambda t, x: t + x["n"]))
        first = F.array_position(counts, F.array_max(counts)) - 1
        step = F.when(same, F.lit(1.0)).otherwise((s["hi"] - s["lo"]).cast("double")) / nbins
        return F.when(same, s["lo"] - 0.5).otherwise(s["lo"].cast("double")) + (first + 0.5) * step

    known = F.struct(F.array_min(F.transform(cells, lambda x: x["value"])).alias("lo"), F.array_max(F.transform(cells, lambda x: x["value"])).alias("hi"), F.aggregate(cells, F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("n"))
    return F.when(F.size(cells) > 0, let(known, middle))


def _length_measures() -> Measures:
    return _as_they_are({"pkt_len_mean": F.avg("len"), "pkt_len_std": F.stddev_pop("len")})


def lengths(rows: DataFrame) -> DataFrame:
    """Mean, deviation (population) and mode of lengths (:func:`mode_of`)."""
    known = rows.where("len is not null")
    cells = known.groupBy(*KEY, "len").agg(F.count("*").alias("n")).groupBy(*KEY).agg(F.collect_list(F.struct(F.col("len").cast("long").alias("value"), "n")).alias("cells"))
    return _measured(known, _length_measures()).join(cells.select(*KEY, mode_of(F.col("cells")).alias("pkt_len_mode")), KEY)


#: Header fields of the discovery protocol and how their entropies are called.
SSDP = {"ssdp_st": "ST", "ssdp_man": "MAN", "ssdp_user_agent": "USER_AGENT"}


def dos_static(rows: DataFrame, width: int, bins: int, ports) -> DataFrame:
    """All static DoS features: one row a window, from two readings of the packets."""
    aggregates, out = _bin_measures(width, bins)
    shape = aggregates, {n: c for n, c in out.items() if n != "median_bin_pkts"}
    base = _measured(with_gaps(rows), _as_they_are(rates(width, ports)), _gap_measures(), shape, _ratio_measures(ports[0]), _length_measures())
    d = distributions(rows, ["src_ip", "dst_port", "ttl", "src_mac", "dst_ip", *SSDP], "len")
    d = d.drop(*[f"{p}_{c}" for p in ("n_unique", "top") for c in SSDP]).withColumnsRenamed({f"H_{c}": f"H_{n}" for c, n in SSDP.items()})
    d = d.withColumn("pkt_len_mode", mode_of(F.col("cells_len"))).drop("cells_len")
    return base.join(d, KEY, "left").withColumnRenamed("top_src_mac", "src_mac_dominance")


#: Where discovery requests are sent: groups, and the link addresses of multicast (fixed values).
DISCOVERY_GROUPS, GROUP_MACS = ("239.255.255.250", "ff02::c", "ff0e::c"), ("33:33:", "01:00:5e")
DISCOVERY_PORT = 1900


def gate_snapshots(rows: DataFrame, width: int, bins: int, port: int = DISCOVERY_PORT, groups=DISCOVERY_GROUPS) -> DataFrame:
    """What the plausibility gate (decide.dos_gate) looks at: a row a window, from one aggregation of the packets and one of their value counts.

    Discovery counts and the share are of UDP packets with the port on either side; a packet without a method has the one that its payload
    (where there is such a column) shows. Requests over answers are those of :func:`ratios`: on any port, by method only, 0 without answers.
    A completion without any SYN is over a millionth. Without a dst_mac column only addresses tell a multicast.
    """
    c, no = F.col, F.lit(False)
    udp, of = c("is_udp") == 1, lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("double")
    found = udp & F.coalesce((c("dst_port") == port) | (c("src_port") == port), no)
    cast = F.coalesce(F.lower("dst_ip").isin(*(g.lower() for g in groups)), no)
    if "dst_mac" in rows.columns:
        for start in GROUP_MACS:
            cast = cast | F.coalesce(F.lower("dst_mac").startswith(start), no)
    method = F.upper("ssdp_method")
    kind = F.when(method.contains("NOTIFY"), "NOTIFY").when(method.contains("M-SEARCH"), "M-SEARCH").when(method.contains("200"), "200-OK")
    if "payload" in rows.columns:
        kind = F.coalesce(kind, sniffed_method(c("payload").cast("binary")))
    seen = lambda name: F.count_if(found & (kind == name)).cast("double")
    place = microbin(width, bins)
    t = rows.groupBy(*KEY).agg(
        F.count("*").cast("double").alias("total_pkts"), of("is_udp").alias("total_udp"), of("is_tcp").alias("total_tcp"), of("tcp_syn").alias("tcp_syn_count"), of("tcp_synack").alias("synack"),
        F.max(cast.cast("double")).alias("ssdp_multicast_hit"), F.count_if(found).alias("found"), discovery_asked().alias("asked"), discovery_answered().alias("answered"),
        *[seen(name).alias(out) for name, out in (("M-SEARCH", "ssdp_msearch_count"), ("200-OK", "ssdp_200ok_count"), ("NOTIFY", "ssdp_notify_count"))],
        F.array_sort(F.array(*[F.count_if(place == i) for i in range(bins)])).alias("bins"),
    )
    s = width / MICROS
    t = t.select(
        *KEY, "total_pkts", "total_udp", "total_tcp", (c("total_pkts") / s).alias("pkts_per_s"), ((c("bins")[(bins - 1) // 2] + c("bins")[bins // 2]) / 2).alias("median_bin_pkts"), c("bins")[bins - 1].cast("double").alias("max_bin_pkts"),
        "tcp_syn_count", (c("tcp_syn_count") / s).alias("tcp_syn_rate"), (c("synack") / (c("tcp_syn_count") + 1e-6)).alias("tcp_synack_completion"), ratio(c("tcp_syn_count"), c("synack")).alias("tcp_syn_over_synack"),
        "ssdp_multicast_hit", (c("found") / F.greatest(c("total_udp"), F.lit(1.0))).alias("udp_1900_fraction"), "ssdp_msearch_count", "ssdp_200ok_count", "ssdp_notify_count",
        ratio(c("asked"), c("answered")).alias("udp_ssdp_req_over_resp"),
    )
    return t.join(distributions(rows, ["src_ip", "dst_port", "ttl"]).select(*KEY, "H_src_ip", "H_dst_port", "H_ttl"), KEY, "left")


def dos_bins(rows: DataFrame, width: int, bins: int, ports) -> DataFrame:
    """Per-bin DoS features, a row for each bin that has packets; TCP before UDP before ICMP where flags overlap."""
    udp = (F.col("is_tcp") == 0) & (F.col("is_udp") == 1)
    icmp = (F.col("is_tcp") == 0) & (F.col("is_udp") == 0) & (F.col("is_icmp") == 1)
    of = lambda name, on: F.sum(F.when(on, F.coalesce(F.col(name), F.lit(0))).otherwise(0))
    tcp = F.col("is_tcp") == 1
    return rows.groupBy(*KEY, microbin(width, bins).alias("bin")).agg(
        F.count("*").alias("bin_total_pkts"),
        F.coalesce(F.sum("len"), F.lit(0)).alias("bin_total_bytes"),
        F.count_if(tcp).alias("bin_tcp_pkts"),
        F.count_if(udp).alias("bin_udp_pkts"),
        F.count_if(icmp).alias("bin_icmp_pkts"),
        of("tcp_syn", tcp).alias("bin_tcp_syn"),
        of("tcp_synack", tcp).alias("bin_tcp_synack"),
        *[F.count_if(udp & (F.col("dst_port") == p)).alias(f"bin_udp_pkts_dst_{p}") for p in ports],
        F.count_if(udp & (F.col("ssdp_method") == "M-SEARCH")).alias("bin_ssdp_msearch"),
        F.count_if(udp & (F.col("ssdp_method") == "200-OK")).alias("bin_ssdp_response"),
    )


def matrix(binned: DataFrame, bins: int, features: list[str]) -> DataFrame:
    """Bins as one float array of bins * features, zeros where a bin has no row."""
    rows = binned.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.array(*[F.col(f).cast("float") for f in features])))).alias("m"))
    empty = F.array(*[F.lit(0.0).cast("float")] * len(features))
    cells = [F.coalesce(F.try_element_at("m", F.lit(i)), empty) for i in range(bins)]
    return rows.select(*KEY, F.flatten(F.array(*cells)).alias("seq"))


def claims(rows: DataFrame, kinds: dict[str, tuple[Column, str, str | None]], bins: Column | None = None, binned: tuple[str, ...] = ()) -> DataFrame:
    """What owners claim, for several kinds of claim at once: a row a window.

    ``kinds``: a name, which packets take part, the owner's column and the claim's (None: owners are only counted). Of each kind: its owners and pairs that differ
    (owners_, pairs_), the largest and mean number of different claims of an owner (max_, mean_), how many owners have several and which share
    (conflicts_, ratio_). Of kinds in ``binned`` only conflicts_: the most that a bin of the window has.
    Pairs are made single by plain aggregation before they are counted, so no set of values is held.
    """
    text = lambda name: F.nullif(F.col(name).cast("string"), F.lit(""))
    each = []
    for name, (on, owner, claim) in kinds.items():
        there = on & text(owner).isNotNull() & (text(claim).isNotNull() if claim else F.lit(True))
        place = bins if name in binned else F.lit(-1)
        each.append(F.when(F.coalesce(there, F.lit(False)), F.struct(F.lit(name).alias("kind"), place.cast("int").alias("bin"), text(owner).alias("owner"), (text(claim) if claim else F.lit("")).alias("claim"))))
    pairs = rows.select(*KEY, F.inline(F.array_compact(F.array(*each)))).distinct()
    per = pairs.groupBy(*KEY, "kind", "bin", "owner").agg(F.count("*").alias("n"))
    many = F.count_if(F.col("n") > 1)
    by = per.groupBy(*KEY, "kind", "bin").agg(F.count("*").alias("owners"), F.sum("n").alias("pairs"), F.max("n").alias("max"), F.avg("n").alias("mean"), many.alias("conflicts"), ratio(many, F.count("*")).alias("ratio"))
    what = lambda name: ("conflicts",) if name in binned else ("owners", "pairs", "max", "mean", "conflicts", "ratio")
    return by.groupBy(*KEY).agg(*[F.max(F.when(F.col("kind") == k, F.col(x))).alias(f"{x}_{k}") for k in kinds for x in what(k)])


def conflicts(rows: DataFrame, keys: list[str], owner: str, claim: str, name: str) -> DataFrame:
    """For each group of ``keys``: the largest and mean number of different claims of an owner, and the share (and number) of owners with several.

    Counted in two steps of plain aggregation; no set of values is held.
    """
    pairs = rows.where(F.col(owner).isNotNull() & F.col(claim).isNotNull() & (F.col(owner) != "") & (F.col(claim) != "")).select(*keys, owner, claim).distinct()
    per = pairs.groupBy(*keys, owner).agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.max("n").alias(f"max_{name}"), F.avg("n").alias(f"mean_{name}"), F.count_if(F.col("n") > 1).alias(f"conflicts_{name}"), ratio(F.count_if(F.col("n") > 1), F.count("*")).alias(f"conflict_ratio_{name}"))


def _zeros(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in df.columns if c not in keys])


BROADCAST_MACS = ("00:00:00:00:00:00", "ff:ff:ff:ff:ff:ff")


_ADDRESSES = ("sender_ip", "sender_mac", "target_ip", "target_mac")


def arp_static(rows: DataFrame, width: int, bins: int) -> DataFrame:
    """The CNN's ARP features. Claims per address are keyed by *target* address, and ratios of
    requests and replies have denominators of at least 1. Bytes of ARP are the window's bytes by ARP's share. From two readings of the packets."""
    s = width / MICROS if width > 0 else 1.0
    arp, c = F.col("is_arp") == 1, F.col
    request, reply, gratuitous = arp & (c("arp_opcode") == 1), arp & (c("arp_opcode") == 2), arp & (c("arp_is_gratuitous") == 1)
    to_all = request & F.coalesce(c("arp_target_mac").isin(*BROADCAST_MACS), F.lit(False))
    counts = {"__pkts": F.count("*"), "__bytes": F.coalesce(F.sum("len"), F.lit(0)), "__arp": F.count_if(arp), "__req": F.count_if(request), "__rep": F.count_if(reply), "__grat": F.count_if(gratuitous), "__to_all": F.count_if(to_all)}
    one = lambda n: F.greatest(c(n), F.lit(1))
    base = counts, {
        "pkts_per_s": c("__pkts") / s, "bytes_per_s": c("__bytes") / s, "arp_pkts_per_s": c("__arp") / s, "arp_bytes_per_s": c("__bytes") * ratio(c("__arp"), c("__pkts")) / s,
        "arp_fraction": ratio(c("__arp"), c("__pkts")), "arp_request_rate": c("__req") / s, "arp_reply_rate": c("__rep") / s, "arp_gratuitous_rate": c("__grat") / s,
        "arp_gratuitous_fraction": ratio(c("__grat"), one("__arp")), "arp_broadcast_fraction": ratio(c("__to_all"), one("__req")), "arp_reply_to_request_ratio": ratio(c("__rep"), one("__req")), "arp_request_to_reply_ratio": ratio(c("__req"), one("__rep")),
    }
    gap_aggregates, gaps = _gap_measures()
    gap_aggregates.pop("__gap_q")
    bin_aggregates, shape = _bin_measures(width, bins)
    t = _measured(with_gaps(rows, of=arp), base, (gap_aggregates, {f"arp_{n}": gaps[n] for n in ("iat_mean", "iat_std")}), (bin_aggregates, {n: shape[n] for n in ("max_bin_pkts", "median_bin_pkts")}))
    named = rows.withColumns({x: F.coalesce(x, F.lit("")) for x in ("arp_sender_ip", "arp_target_ip")}).withColumn("__pair", F.concat_ws("|", "arp_sender_ip", "arp_target_ip"))
    kinds = {f"u_{x}": (arp, f"arp_{x}", None) for x in _ADDRESSES} | {
        "pair": (arp, "__pair", None), "claims_per_ip": (arp, "arp_target_ip", "arp_sender_mac"), "ips_per_mac": (arp, "arp_sender_mac", "arp_sender_ip"), "reply": (reply, "arp_sender_mac", "arp_sender_ip"),
        "target_reply": (reply, "arp_target_ip", "arp_sender_mac"), "senders_bin": (arp, "arp_sender_mac", "arp_sender_ip"), "targets_bin": (arp, "arp_target_ip", "arp_sender_mac"),
    }
    found = claims(named, kinds, microbin(width, bins), ("senders_bin", "targets_bin"))
    d = found.select(
        *KEY, c("owners_pair").alias("unique_sender_target_pairs"), *[c(f"owners_u_{x}").alias(f"unique_{x}s") for x in _ADDRESSES], *[c(f"{x}_{k}") for k in ("claims_per_ip", "ips_per_mac") for x in ("max", "mean")],
        *[c(f"ratio_{k}").alias(f"conflict_ratio_{k}") for k in ("claims_per_ip", "ips_per_mac")], c("ratio_reply").alias("reply_conflict_ratio"), c("ratio_target_reply").alias("target_reply_conflict_ratio"),
        c("conflicts_senders_bin").alias("max_conflicting_senders_bin"), c("conflicts_targets_bin").alias("max_conflicting_targets_bin"),
    )
    return _zeros(t.join(d, KEY, "left"), KEY)


def arp_static_seq(rows: DataFrame, width: int) -> DataFrame:
    """The LSTM's 25 ARP features: exact ARP bytes, ratios that are 0 over nothing, claims keyed by *sender* address. A pair is a sender's
    address with the target's (empty where it is missing), of packets that name the sender's mac too."""
    s = width / MICROS
    arp, c = F.col("is_arp") == 1, F.col
    counts = {"__pkts": F.count("*"), "__bytes": F.sum("len"), "__arp": F.count_if(arp), "__arp_bytes": F.sum(F.when(arp, c("len")).otherwise(0)), "__req": F.count_if(arp & (c("arp_opcode") == 1)), "__rep": F.count_if(arp & (c("arp_opcode") == 2)), "__grat": F.count_if(arp & (c("arp_is_gratuitous") == 1))}
    base = counts, {
        "pkts_per_s": c("__pkts") / s, "bytes_per_s": c("__bytes") / s, "arp_pkts_per_s": c("__arp") / s, "arp_bytes_per_s": c("__arp_bytes") / s, "arp_fraction": ratio(c("__arp"), c("__pkts")), "arp_request_rate": c("__req") / s,
        "arp_reply_rate": c("__rep") / s, "arp_gratuitous_rate": c("__grat") / s, "arp_gratuitous_fraction": ratio(c("__grat"), c("__arp")), "arp_reply_to_request_ratio": ratio(c("__rep"), c("__req")), "arp_request_to_reply_ratio": ratio(c("__req"), c("__rep")),
    }
    gap_aggregates, gaps = _gap_measures()
    gap_aggregates.pop("__gap_q")
    t = _measured(with_gaps(rows, of=arp), base, (gap_aggregates, {f"arp_{n}": gaps[n] for n in ("iat_mean", "iat_std")}))
    named = arp & c("arp_sender_ip").isNotNull() & c("arp_sender_mac").isNotNull()
    pair = rows.withColumn("__pair", F.concat_ws("|", F.coalesce("arp_sender_ip", F.lit("")), F.coalesce("arp_target_ip", F.lit(""))))
    kinds = {f"u_{x}": (arp, f"arp_{x}", None) for x in _ADDRESSES} | {"pair": (named, "__pair", None), "claims_per_ip": (arp, "arp_sender_ip", "arp_sender_mac"), "ips_per_mac": (arp, "arp_sender_mac", "arp_sender_ip"), "target": (arp, "arp_target_ip", "arp_sender_mac")}
    d = claims(pair, kinds).select(
        *KEY, c("owners_pair").alias("unique_sender_target_pairs"), *[c(f"owners_u_{x}").alias(f"unique_{x}s") for x in _ADDRESSES], *[c(f"{x}_{k}") for k in ("claims_per_ip", "ips_per_mac") for x in ("max", "mean")],
        c("ratio_claims_per_ip").alias("conflict_ip_ratio"), c("ratio_ips_per_mac").alias("sender_conflict_ratio"), c("ratio_target").alias("target_conflict_ratio"),
    )
    return _zeros(t.join(d, KEY, "left"), KEY)


def arp_bins(rows: DataFrame, width: int, bins: int) -> DataFrame:
    """Per-bin ARP features, a row for each bin that has packets."""
    key = [*KEY, "bin"]
    binned = rows.withColumn("bin", microbin(width, bins))
    arp = F.col("is_arp") == 1
    d = lambda name: F.count_distinct(F.when(arp, F.nullif(F.col(name), F.lit(""))))
    base = binned.groupBy(*key).agg(
        F.count("*").alias("bin_pkts"), F.coalesce(F.sum("len"), F.lit(0)).alias("bin_bytes"), F.count_if(arp).alias("bin_arp"), F.count_if(arp & (F.col("arp_opcode") == 1)).alias("bin_requests"), F.count_if(arp & (F.col("arp_opcode") == 2)).alias("bin_replies"),
        d("arp_sender_ip").alias("bin_sender_ips"), d("arp_sender_mac").alias("bin_sender_macs"), d("arp_target_ip").alias("bin_target_ips"), d("arp_target_mac").alias("bin_target_macs"), F.count_if(arp & (F.col("arp_is_gratuitous") == 1)).alias("bin_gratuitous"),
    )
    only = binned.where(arp)
    s = conflicts(only, key, "arp_sender_mac", "arp_sender_ip", "s").select(*key, F.col("conflicts_s").alias("bin_conflicting_senders"))
    t = conflicts(only, key, "arp_target_ip", "arp_sender_mac", "t").select(*key, F.col("conflicts_t").alias("bin_conflicting_targets"))
    return _zeros(base.join(s, key, "left").join(t, key, "left"), key)


def flow(rows: DataFrame, width: int) -> DataFrame:
    """The autoencoder's features: bits per second, deviations with n - 1, gaps in the order of arrival, base-2 entropies."""
    s = width / MICROS
    c = F.col
    counts = {
        "pkt_count": F.count("*"), "byte_count": F.sum("len"), "mean_pkt_len": F.avg("len"), "std_pkt_len": _zero(F.stddev_samp("len")), "min_pkt_len": F.min("len"), "max_pkt_len": F.max("len"),
        "tcp_count": F.sum("is_tcp"), "udp_count": F.sum("is_udp"), "icmp_count": F.sum("is_icmp"), **{f: F.coalesce(F.sum(f), F.lit(0)) for f in ("tcp_syn", "tcp_ack", "tcp_rst", "tcp_fin")},
        "mean_iat": _zero(F.avg("gap")), "std_iat": _zero(F.stddev_samp("gap")),
    }
    n = F.greatest(c("pkt_count"), F.lit(1))
    more = {"pps": c("pkt_count") / s, "bps": 8 * c("byte_count") / s} | {f"{p}_ratio": c(f"{p}_count") / n for p in ("tcp", "udp", "icmp")}
    t = _measured(with_gaps(rows, ("packet_no",)), (counts, {k: c(k) for k in counts} | more))
    d = distributions(rows, ["src_ip", "dst_ip", "src_port", "dst_port"])
    d = d.select(*KEY, *[c(f"H_{x}").alias(f"{x}_entropy") for x in ("src_ip", "dst_ip", "src_port", "dst_port")], *[c(f"n_unique_{x}").alias(f"unique_{x}s") for x in ("src_ip", "dst_ip", "src_port", "dst_port")])
    return t.join(d, KEY, "left")


def host_counts(rows: DataFrame, host: str) -> DataFrame:
    """Packets of each host in each window, as a long table."""
    return rows.where(F.col(host).isNotNull() & (F.col(host) != "")).groupBy(*KEY, F.col(host).alias("host")).agg(F.count("*").alias("cnt"))


def claim_counts(rows: DataFrame) -> DataFrame:
    """ARP claims: packets and replies for each (window, mac, ip)."""
    return rows.where((F.col("is_arp") == 1) & F.col("arp_sender_mac").isNotNull() & F.col("arp_sender_ip").isNotNull()).groupBy(*KEY, F.lower("arp_sender_mac").alias("mac"), F.col("arp_sender_ip").alias("ip")).agg(F.count("*").alias("cnt"), F.count_if(F.col("arp_opcode") == 2).alias("replies"))
