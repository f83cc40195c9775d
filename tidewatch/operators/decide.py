"""Decisions over ordered windows: plausibility gates, hysteresis machines, run filters.

Gates are predicates of a row and its capture's baseline, computed in parallel. The machines behind them have few states, so a
capture's windows are decided in segments that run beside one another (:mod:`tidewatch.operators.segments`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.fold import folded, let
from tidewatch.functions.stats import percentile
from tidewatch.operators.segments import SEGMENT, Machine, through

FAR = 1e9


@dataclass(frozen=True)
class DosConfig:
    """Thresholds of the DoS verdict (fixed values)."""

    tau_high: float = 0.70
    tau_low: float = 0.55
    min_attack_windows: int = 3
    consecutive_required: int = 2
    cooldown_windows: int = 1
    enable_gate: bool = True
    pkts_cap: float = 1500.0
    burst_multiple: float = 3.0
    completion_max: float = 0.10
    override: bool = False
    override_tau: float = 0.93
    override_min_pkts: float = 3.0


@dataclass(frozen=True)
class ArpConfig:
    """Thresholds of the ARP verdict (fixed values)."""

    tau_high: float = 0.70
    tau_low: float = 0.55
    min_attack_windows: int = 2
    consecutive_required: int = 1
    cooldown_windows: int = 1
    enable_gate: bool = True
    min_replies: float = 2.0
    min_conflict_macs: int = 1


def baselines(windows: DataFrame) -> DataFrame:
    """Statistics of each capture's quiet windows: of the n windows, the max(100, floor(0.6 n)) with the least rate.

    Ties in rate go to the earlier window. Deviation is 1.4826 times the median absolute one, 1 where that is 0.
    """
    rank = F.row_number().over(W.partitionBy("capture").orderBy("pkts_per_s", "window_index"))
    n = windows.groupBy("capture").agg(F.count("*").alias("n"))
    quiet = windows.withColumn("rank", rank).join(n, "capture").where(F.col("rank") <= F.greatest(F.lit(100), F.floor(F.col("n") * 0.6)))
    first = quiet.groupBy("capture").agg(
        percentile(F.col("pkts_per_s"), 0.5).alias("pkts_med"),
        *[percentile(F.col(h), 0.1).alias(f"{h}_p10") for h in ("H_src_ip", "H_dst_port", "H_ttl")],
        percentile(F.col("median_bin_pkts"), 0.5).alias("median_bin_pkts_med"),
    )
    mad = quiet.join(first.select("capture", "pkts_med"), "capture").groupBy("capture").agg(percentile(F.abs(F.col("pkts_per_s") - F.col("pkts_med")), 0.5).alias("mad"))
    return first.join(mad, "capture").withColumn("pkts_sigma", F.when(F.col("mad") > 0, F.col("mad") * 1.4826).otherwise(1.0)).drop("mad")


def _or(df: DataFrame, name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in df.columns else F.lit(default)


def _reasons(*pairs) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]))


def dos_gate(windows: DataFrame, base: DataFrame, cfg: DosConfig = DosConfig()) -> DataFrame:
    """Adds gate_ok and gate_reasons. Missing snapshot columns stand for nothing seen; missing entropies for no collapse."""
    w = windows.join(base, "capture", "left")
    v = lambda n, d=0.0: _or(w, n, d)
    pkts, total = v("pkts_per_s"), v("total_pkts")
    quiet_bin = v("median_bin_pkts_med", 1.0)
    own_bin = F.coalesce(F.col("median_bin_pkts").cast("double"), quiet_bin) if "median_bin_pkts" in w.columns else quiet_bin
    bin_ = F.when(own_bin <= 0, F.greatest(F.lit(1.0), quiet_bin)).otherwise(own_bin)
    med, sigma = v("pkts_med"), F.coalesce(F.nullif(v("pkts_sigma", 1.0), F.lit(0.0)), F.lit(1.0))
    slow = pkts < 50
    spike = F.when(slow, (pkts >= med + 8 * sigma) & (pkts >= 25)).otherwise(pkts >= med + 6 * sigma) | (pkts >= cfg.pkts_cap)
    least = F.when(slow, 60.0).otherwise(40.0)
    enough = lambda c: (c >= least) | (pkts >= 60)
    ssdp_rr, syn_rr, other_rr, syn = v("udp_ssdp_req_over_resp"), v("tcp_syn_over_synack"), v("generic_req_resp_ratio"), v("tcp_syn_count")
    lopsided = ((ssdp_rr >= 10) & enough(total)) | ((syn_rr >= 10) & enough(syn)) | ((other_rr >= 10) & enough(total))
    collapse = (total >= 100) & ((v("H_src_ip", FAR) <= v("H_src_ip_p10", -1.0)) | (v("H_dst_port", FAR) <= v("H_dst_port_p10", -1.0)) | (v("H_ttl", FAR) <= v("H_ttl_p10", -1.0)))
    bursty = (total >= 120) & (v("max_bin_pkts") >= cfg.burst_multiple * bin_)
    generic = _reasons(("rate spike", spike), ("asymmetry", lopsided), ("entropy collapse", collapse), ("burstiness", bursty))
    share, notify, search, answers, cast = v("udp_1900_fraction"), v("ssdp_notify_count"), v("ssdp_msearch_count"), v("ssdp_200ok_count"), v("ssdp_multicast_hit") != 0
    repeated = v("ssdp_header_repetition") != 0
    ssdp = _reasons(
        ("SSDP dominance", share >= 0.5),
        ("SSDP multicast", cast & (notify + search >= 3)),
        ("SSDP asymmetry", (ssdp_rr >= 10) & (notify + search >= 5)),
        ("SSDP notify-dominant", ((notify >= 8) & (answers <= 1) & (share >= 0.3)) | ((pkts >= 80) & (answers == 0) & (search <= 2) & (share >= 0.3))),
        ("SSDP header repetition", repeated & ((share >= 0.3) | cast)),
    )
    completion = F.coalesce(F.col("tcp_synack_completion") <= cfg.completion_max, F.lit(False)) if "tcp_synack_completion" in w.columns else F.lit(False)
    surge = _reasons(("TCP SYN surge", (v("tcp_syn_rate") >= 200) | ((syn_rr >= 10) & (syn >= 100))), ("Low SYN-ACK completion", (syn >= 100) & completion))
    w = w.withColumns({"__generic": generic, "__ssdp": ssdp, "__surge": surge})
    several = F.size("__generic") >= 2
    hinted = ~slow & (F.size("__generic") >= 1) & ((F.size("__ssdp") > 0) | (F.size("__surge") > 0))
    hints = F.concat(F.when(F.size("__ssdp") > 0, F.col("__ssdp")).otherwise(F.col("__surge")), F.col("__generic"))
    none = F.array().cast("array<string>")
    ok = several | hinted if cfg.enable_gate else F.lit(True)
    why = F.when(several, F.col("__generic")).when(hinted, hints).otherwise(none) if cfg.enable_gate else none
    return w.withColumns({"gate_ok": ok, "gate_reasons": why}).drop("__generic", "__ssdp", "__surge", *[c for c in base.columns if c != "capture"])


def arp_gate(windows: DataFrame, cfg: ArpConfig = ArpConfig()) -> DataFrame:
    """Replies and conflicting macs, both."""
    replies, macs = F.coalesce(F.col("arp_replies"), F.lit(0)) >= cfg.min_replies, F.coalesce(F.col("reply_conflict_macs"), F.lit(0)) >= cfg.min_conflict_macs
    ok = replies & macs if cfg.enable_gate else F.lit(True)
    return windows.withColumns({"gate_ok": ok, "gate_reasons": _reasons(("arp_replies", replies), ("mac_conflict", macs))})


def _machine(cfg: DosConfig | ArpConfig) -> Machine:
    """The verdict's hysteresis. Symbols: 1 high, 2 plausible, 4 low, 8 sure; of the state only what still matters is kept."""
    dos = isinstance(cfg, DosConfig)
    lows = 2 if dos else max(1, cfg.cooldown_windows)
    override = dos and cfg.override
    needed = max(cfg.consecutive_required, cfg.min_attack_windows)

    def step(state, symbol):
        attack, run, low, cool, sure, forced = state
        high, ok, is_low, is_sure = (bool(symbol & bit) for bit in (1, 2, 4, 8))
        if attack:
            low = low + 1 if is_low else 0
            gain = int(high and (ok or forced))
            return ((False, 0, 0, cfg.cooldown_windows, 0, False) if low >= lows else (True, 0, low, 0, 0, forced)), gain, 0
        sure = sure + 1 if override and is_sure else 0
        cool = max(cool - 1, 0)
        run = run + 1 if high and ok and cool == 0 else 0
        if run >= needed:
            return (True, 0, 0, 0, 0, False), run, 1
        if override and sure >= needed:
            return (True, 0, 0, 0, 0, True), sure, 2
        return (False, run, 0, cool, sure, False), 0, 0

    return Machine((False, 0, 0, 0, 0, False), 16, step)


def verdict(windows: DataFrame, cfg: DosConfig | ArpConfig = DosConfig(), segment: int = SEGMENT) -> DataFrame:
    """One row a capture: decision, first_attack (start of the promoting window), attack_windows, max_prob, reasons (those of the promoting window, four at most).

    ``windows``: capture, window_index, start, prob, gate_ok, gate_reasons (and pkts_per_s for the override). NORMAL turns to ATTACK on enough
    plausible high windows in a row, and back after low ones in a row (two for DoS; the cooldown, at least one, for ARP).
    Windows are decided in segments (:mod:`operators.segments`), however many a capture has.
    """
    override = isinstance(cfg, DosConfig) and cfg.override
    prob = F.col("prob").cast("double")
    sure = (prob >= cfg.override_tau) & (F.col("pkts_per_s").cast("double") >= cfg.override_min_pkts) if override else F.lit(False)
    bits = (prob >= cfg.tau_high, F.col("gate_ok"), prob <= cfg.tau_low, sure)
    symbol = sum((F.coalesce(b, F.lit(False)).cast("int") * (1 << i) for i, b in enumerate(bits)), F.lit(0))
    tag = F.struct(F.col("start"), F.slice("gate_reasons", 1, 4).alias("why"))
    state = through(windows, _machine(cfg), symbol, "window_index", tag, prob, segment)
    why = F.when(F.col("event") == 2, F.array(F.lit("model-high-confidence"))).when(F.col("event") == 1, F.col("tag.why"))
    return state.select(
        "capture",
        F.when(F.col("event") > 0, "attack").otherwise("normal").alias("decision"),
        F.when(F.col("event") > 0, F.col("tag.start")).alias("first_attack"),
        F.col("gain").cast("int").alias("attack_windows"),
        F.greatest("top", F.lit(0.0)).alias("max_prob"),
        F.coalesce(why, F.array().cast("array<string>")).alias("reasons"),
    )


def sequence_gate(windows: DataFrame, tau_window: float, tau_file: float, required: int, cooldown: int, plausible: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row a capture: a window is marked when enough high ones in a row have come and it is plausible; then the run
    starts anew and as many windows as the cooldown are passed over. Attack if any is marked and the largest score reaches tau_file."""

    def step(state, symbol):
        run, cool = state
        run = min(run + 1, required) if symbol & 1 and cool == 0 else 0
        if run >= required and symbol & 2:
            return (0, cooldown), 1, 1
        return (run, max(cool - 1, 0)), 0, 0

    ok = F.coalesce(plausible, F.lit(False)) if plausible is not None else F.lit(True)
    symbol = F.coalesce(F.col("score") >= tau_window, F.lit(False)).cast("int") + 2 * ok.cast("int")
    state = through(windows, Machine((0, 0), 4, step), symbol, "window_index", F.col("window_index"), F.col("score"), segment)
    top = F.greatest("top", F.lit(0.0))
    return state.select("capture", ((F.col("gain") > 0) & (top >= tau_file)).alias("is_attack"), F.col("gain").cast("int").alias("marked"), F.when(F.col("event") > 0, F.col("tag")).alias("first_window"), top.alias("max_score"))


def count_gate(windows: DataFrame, tau_window: float, tau_file: float, least: int) -> DataFrame:
    """No memory: enough windows at tau_window and a largest score at tau_file."""
    g = windows.groupBy("capture").agg(F.count_if(F.col("score") >= tau_window).alias("marked"), F.max("score").alias("max_score"))
    return g.withColumn("is_attack", (F.col("marked") >= least) & (F.col("max_score") >= tau_file))


@dataclass(frozen=True)
class FamilyRates:
    """Least rates that make a family plausible (fixed values)."""

    ssdp_fraction: float = 0.1
    syn_rate: float = 5.0
    icmp_rate: float = 5.0
    udp_rate: float = 5.0
    http_rate: float = 2.0


def plausible_family(df: DataFrame, family: str = "family", rates: FamilyRates = FamilyRates()) -> Column:
    """Do the window's rates support the family? Any UDP at all does for ssdp; families that aren't known are plausible."""
    f = F.col(family)
    syn = _or(df, "tcp_syn_rate", 0.0) if "tcp_syn_rate" in df.columns else _or(df, "tcp_per_s", 0.0)
    return (
        F.when(f == "ssdp", (_or(df, "udp_1900_fraction", 0.0) >= rates.ssdp_fraction) | (_or(df, "udp_per_s", 0.0) > 0))
        .when(f == "syn", syn >= rates.syn_rate)
        .when(f == "icmp", _or(df, "icmp_per_s", 0.0) >= rates.icmp_rate)
        .when(f == "udp", _or(df, "pkts_per_s", 0.0) >= rates.udp_rate)
        .when(f == "http", _or(df, "bytes_per_s", 0.0) >= rates.http_rate)
        .otherwise(True)
    )


def islands(windows: DataFrame, flag: Column) -> DataFrame:
    """Adds run (its first window_index; null outside runs) and run_length of maximal runs of flagged rows."""
    w = W.partitionBy("capture").orderBy("window_index")
    rows = windows.withColumn("flag", F.coalesce(flag, F.lit(False)))
    rows = rows.withColumn("row", F.row_number().over(w)).withColumn("__g", F.col("row") - F.sum(F.col("flag").cast("long")).over(w))
    runs = rows.where("flag").groupBy("capture", "__g").agg(F.min("window_index").alias("run"), F.count("*").alias("run_length"))
    return rows.join(runs, ["capture", "__g"], "left").withColumns({"run": F.when(F.col("flag"), F.col("run")), "run_length": F.when(F.col("flag"), F.col("run_length"))}).drop("__g")


def filtered_runs(windows: DataFrame, flag: Column, least: int, cooldown: int = 0) -> DataFrame:
    """Adds kept: rows of runs of at least ``least`` flags. After a kept run ``cooldown`` rows are passed over; the row that
    ended the run is the first of them, so only a cooldown of two or more cuts into what follows.
    """
    if cooldown <= 1:
        return islands(windows, flag).withColumn("kept", F.coalesce(F.col("run_length") >= least, F.lit(False))).drop("row")
    rows = islands(windows, flag)
    spans = rows.where("flag").groupBy("capture", "run").agg(F.min("row").alias("a"), F.max("row").alias("b"))

    def step(s: Column, x: Column) -> dict[str, Column]:
        first = F.greatest(x["a"], s["free"])
        good = x["b"] - first + 1 >= least
        return {"free": F.when(good, x["b"] + 1 + cooldown).otherwise(s["free"]), "kept": F.when(good, F.concat(s["kept"], F.array(F.struct(first.alias("a"), x["b"].alias("b"))))).otherwise(s["kept"])}

    start = {"free": F.lit(0).cast("long"), "kept": F.array().cast("array<struct<a:long,b:long>>")}
    long = spans.select("capture", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    kept = long.groupBy("capture").agg(folded(["a"], ["b"], start, step).alias("s")).select("capture", F.inline("s.kept"))
    rows = rows.join(kept, (rows["capture"] == kept["capture"]) & rows["row"].between(kept["a"], kept["b"]), "left").drop(kept["capture"])
    return rows.withColumn("kept", F.col("a").isNotNull()).drop("a", "b", "row")


def intervals(windows: DataFrame, score: str, tau: float, least: int) -> DataFrame:
    """Maximal runs of scores at tau: first and last window, length, largest score."""
    rows = islands(windows, F.col(score) >= tau).where("flag and run_length >= %d" % least)
    return rows.groupBy("capture", F.col("run").alias("first_window")).agg(F.max("window_index").alias("last_window"), F.count("*").alias("length"), F.max(score).alias("max_score"))


def open_intervals(windows: DataFrame, score: str, tau: float) -> DataFrame:
    """As :func:`intervals`, but the closing window is the first below tau, one later; a run at the end closes with its last window."""
    found = intervals(windows, score, tau, 1)
    last = windows.groupBy("capture").agg(F.max("window_index").alias("end"))
    return found.join(last, "capture").withColumn("last_window", F.least(F.col("last_window") + 1, F.col("end"))).withColumn("length", F.col("last_window") - F.col("first_window") + 1).drop("end")


def arp_override(verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """ARP verdicts after the claims: without a mac that answers for two addresses in one window a capture is normal; with one it is an
    attack of at least as many windows as conflict. ``claims``: capture, window_index, mac, ip, replies, w_start."""
    per = claims.where("replies > 0").groupBy("capture", "window_index", "mac").agg(F.count_distinct("ip").alias("ips"), F.min("w_start").alias("at")).where("ips >= 2")
    c = per.groupBy("capture").agg(F.count_distinct("window_index").alias("conflict_windows"), F.min("at").alias("first_conflict"))
    j = verdicts.join(c, "capture", "left")
    bad = F.col("conflict_windows").isNotNull()
    return j.select(
        "capture",
        F.when(bad, "attack").otherwise("normal").alias("decision"),
        F.when(bad, F.col("first_conflict")).alias("first_attack"),
        F.when(bad, F.greatest("attack_windows", "conflict_windows", F.lit(1))).otherwise(0).alias("attack_windows"),
        "max_prob",
    )


__all__ = ["ArpConfig", "DosConfig", "arp_gate", "arp_override", "baselines", "count_gate", "dos_gate", "filtered_runs", "intervals", "islands", "let", "open_intervals", "plausible_family", "sequence_gate", "verdict"]
