"""Labels, machines, attribution, thresholds, metrics and scorers on hand-made rows and against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import attribute as at
from tidewatch.operators import decide as dc
from tidewatch.operators import evaluate as ev
from tidewatch.operators import joins as jn
from tidewatch.operators import prep
from tidewatch.operators import score as sc


def test_intervals_label_windows(spark):
    """Random intervals, overlapping and touching: a window takes the family of the first in the file's order that it overlaps."""
    rng = random.Random(4)
    spans = [(a := rng.randrange(0, 40) / 2, a + rng.randrange(1, 9) / 2, f"f{i % 3}", i) for i in range(7)]
    w = spark.createDataFrame([(c, i, float(i), float(i + 1)) for c in "cd" for i in range(25)], "capture string, window_index int, start double, end double")
    iv = spark.createDataFrame([("c", *s) for s in spans], "capture string, start double, end double, family string, interval_no int")
    for r in jn.label_intervals(w, iv).collect():
        hits = [f for a, b, f, _ in spans if r.capture == "c" and a < r.end and b > r.start]
        assert (r.attack, r.family) == (int(bool(hits)), hits[0] if hits else "normal")


def test_file_labels(spark):
    w = spark.createDataFrame([(c, i, float(i)) for c in "abc" for i in range(3)], "capture string, window_index int, start double")
    labels = spark.createDataFrame([("a", 1, 1.0, "x"), ("b", 1, None, "x")], "capture string, attack_label int, attack_start double, family string")
    assert [(r.capture, r.y) for r in jn.label_files(w, labels).orderBy("capture", "window_index").collect()] == [("a", 0), ("a", 1), ("a", 1), ("b", 1), ("b", 1), ("b", 1), ("c", 0), ("c", 0), ("c", 0)]


def slow_verdict(rows, cfg, dos):
    attack, first, flagged, run, low, cool, sure, forced = False, None, 0, 0, 0, 0, 0, False
    need = max(cfg.consecutive_required, cfg.min_attack_windows)
    for start, prob, ok, rate in rows:
        sure = sure + 1 if dos and cfg.override and prob >= cfg.override_tau and rate >= cfg.override_min_pkts else 0
        if not attack:
            cool = max(cool - 1, 0)
            run = run + 1 if prob >= cfg.tau_high and ok and cool == 0 else 0
            hit = run if run >= need else sure if dos and cfg.override and sure >= need else 0
            if hit:
                attack, forced, low = True, run < need, 0
                flagged += hit
                first = start if first is None else first
        else:
            flagged += prob >= cfg.tau_high and (ok or forced)
            low = low + 1 if prob <= cfg.tau_low else 0
            if low >= (2 if dos else max(1, cfg.cooldown_windows)):
                attack, forced, run, low, sure, cool = False, False, 0, 0, 0, cfg.cooldown_windows
    return ("attack" if first is not None else "normal", first, flagged)


@pytest.mark.parametrize("cfg", [dc.DosConfig(), dc.DosConfig(override=True, cooldown_windows=3), dc.ArpConfig(), dc.ArpConfig(cooldown_windows=2, min_attack_windows=1)])
def test_verdicts_agree_with_plain_machine(spark, cfg):
    rng = random.Random(3)
    data = {f"c{n}": [(float(i), rng.choice([0.2, 0.5, 0.6, 0.75, 0.95, 0.99]), rng.random() < 0.7, rng.choice([1.0, 9.0])) for i in range(rng.randint(1, 60))] for n in range(40)}
    df = spark.createDataFrame([(c, i, *r, ["why"]) for c, rows in data.items() for i, r in enumerate(rows)], "capture string, window_index long, start double, prob double, gate_ok boolean, pkts_per_s double, gate_reasons array<string>")
    want = {c: slow_verdict(rows, cfg, isinstance(cfg, dc.DosConfig)) for c, rows in data.items()}
    for segment in (4096, 7, 1):  # cuts anywhere give the same
        assert {r.capture: (r.decision, r.first_attack, r.attack_windows) for r in dc.verdict(df, cfg, segment).collect()} == want


def test_reasons_of_the_promoting_window(spark):
    """Four reasons at most, of the window that turned the capture, wherever segments are cut; a sure model has a reason of its own."""
    high = [(0.9, True, 0.0, [f"r{i}", "a", "b", "c", "d"]) for i in range(12)]
    sure = [(0.99, False, 9.0, []) for _ in range(12)]
    data = {"gate": high, "model": sure, "quiet": [(0.1, True, 0.0, ["x"])] * 12}
    df = spark.createDataFrame([(c, i, float(i), *r) for c, rows in data.items() for i, r in enumerate(rows)], "capture string, window_index long, start double, prob double, gate_ok boolean, pkts_per_s double, gate_reasons array<string>")
    for segment in (4096, 3, 2):
        got = {r.capture: (r.decision, r.first_attack, r.reasons, r.max_prob) for r in dc.verdict(df, dc.DosConfig(override=True), segment).collect()}
        assert got == {"gate": ("attack", 2.0, ["r2", "a", "b", "c"], 0.9), "model": ("attack", 2.0, ["model-high-confidence"], 0.99), "quiet": ("normal", None, [], 0.1)}


def test_sequence_gate_in_segments(spark):
    rng = random.Random(8)
    data = {f"c{n}": [(rng.choice([0.2, 0.6, 0.9]), rng.random() < 0.6) for _ in range(rng.randint(1, 50))] for n in range(20)}
    want = {}
    for c, rows in data.items():
        run = cool = 0
        marks = []
        for i, (score, ok) in enumerate(rows):
            run = run + 1 if score >= 0.5 and not cool else 0
            cool = max(cool - 1, 0)
            if run >= 3 and ok:
                marks.append(i)
                run, cool = 0, 4
        top = max(s for s, _ in rows)
        want[c] = (bool(marks) and top >= 0.8, len(marks), marks[0] if marks else None, top)
    df = spark.createDataFrame([(c, i, *r) for c, rows in data.items() for i, r in enumerate(rows)], "capture string, window_index long, score double, ok boolean")
    for segment in (4096, 5):
        got = dc.sequence_gate(df, 0.5, 0.8, 3, 4, F.col("ok"), segment).collect()
        assert {r.capture: (r.is_attack, r.marked, r.first_window, r.max_score) for r in got} == want


def test_long_captures_in_pieces(spark):
    """A hundred thousand windows of one capture: no group of the plan has more rows than a segment, and the verdict is the plain machine's."""
    cfg = dc.DosConfig()
    df = spark.range(100_000).select(F.lit("c").alias("capture"), F.col("id").alias("window_index"), F.col("id").cast("double").alias("start"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("prob"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)) < 8).alias("gate_ok"), F.array(F.lit("w")).alias("gate_reasons"))
    rows = [(r.start, r.prob, r.gate_ok, 0.0) for r in df.orderBy("window_index").collect()]
    r = dc.verdict(df, cfg, 1000).first()
    assert (r.decision, r.first_attack, r.attack_windows) == slow_verdict(rows, cfg, True)


def test_arp_gate_and_verdict(spark):
    """Random windows: both kinds of evidence open the gate, and the verdict is the plain machine's."""
    rng = random.Random(11)
    cfg = dc.ArpConfig()
    data = {f"c{n}": [(rng.choice([0.1, 0.6, 0.8, 0.99]), rng.randrange(5), rng.choice([0, 1, 2, None])) for _ in range(rng.randint(1, 40))] for n in range(30)}
    df = spark.createDataFrame([(c, i, float(i), *r) for c, rows in data.items() for i, r in enumerate(rows)], "capture string, window_index long, start double, prob double, arp_replies long, reply_conflict_macs long")
    gated = dc.arp_gate(df)
    for r in gated.collect():
        evidence = [n for n, on in (("arp_replies", r.arp_replies >= 2), ("mac_conflict", (r.reply_conflict_macs or 0) >= 1)) if on]
        assert (r.gate_ok, r.gate_reasons) == (len(evidence) == 2, evidence)
    got = {r.capture: (r.decision, r.first_attack, r.attack_windows) for r in dc.verdict(gated, cfg).collect()}
    assert got == {c: slow_verdict([(float(i), p, a >= 2 and (m or 0) >= 1, 0.0) for i, (p, a, m) in enumerate(rows)], cfg, False) for c, rows in data.items()}


GATES = {
    # what a window shows beyond a quiet one, and the reasons that open the gate (none: it stays closed)
    "spike and burst": ({"pkts_per_s": 170.0, "total_pkts": 500.0, "max_bin_pkts": 90.0, "median_bin_pkts": 30.0}, ["rate spike", "burstiness"]),
    "spike alone": ({"pkts_per_s": 170.0}, []),
    "discovery without anything else": ({"udp_1900_fraction": 0.8, "ssdp_notify_count": 9.0}, []),
    "spike with discovery": ({"pkts_per_s": 165.0, "udp_1900_fraction": 0.6}, ["SSDP dominance", "SSDP notify-dominant", "rate spike"]),
    "spike with repeated headers": ({"pkts_per_s": 165.0, "udp_1900_fraction": 0.3, "ssdp_200ok_count": 5.0, "ssdp_header_repetition": 1.0}, ["SSDP header repetition", "rate spike"]),
    "spike with SYN": ({"pkts_per_s": 165.0, "tcp_syn_rate": 250.0, "tcp_syn_count": 100.0, "tcp_synack_completion": 0.05}, ["TCP SYN surge", "Low SYN-ACK completion", "rate spike"]),
    "lopsided and few sources": ({"pkts_per_s": 80.0, "total_pkts": 150.0, "udp_ssdp_req_over_resp": 12.0, "H_src_ip": 0.5}, ["asymmetry", "entropy collapse"]),
    "slow": ({"pkts_per_s": 30.0, "udp_1900_fraction": 0.9}, []),
}


def test_dos_gate(spark):
    base = spark.createDataFrame([("c", 100.0, 10.0, 1.0, 1.0, 1.0, 20.0)], "capture string, pkts_med double, pkts_sigma double, H_src_ip_p10 double, H_dst_port_p10 double, H_ttl_p10 double, median_bin_pkts_med double")
    quiet = {"pkts_per_s": 100.0, "total_pkts": 50.0, "max_bin_pkts": 25.0, "median_bin_pkts": 20.0, "udp_ssdp_req_over_resp": 1.0, "tcp_syn_over_synack": 1.0, "udp_1900_fraction": 0.0, "ssdp_notify_count": 0.0, "ssdp_msearch_count": 0.0, "ssdp_200ok_count": 0.0, "ssdp_multicast_hit": 0.0, "ssdp_header_repetition": 0.0, "tcp_syn_rate": 0.0, "tcp_syn_count": 0.0, "tcp_synack_completion": 1.0, "H_src_ip": 3.0, "H_dst_port": 3.0, "H_ttl": 3.0}
    rows = [("c", i, *(quiet | seen).values()) for i, (seen, _) in enumerate(GATES.values())]
    df = spark.createDataFrame(rows, "capture string, window_index long, " + ", ".join(f"{n} double" for n in quiet))
    got = [(r.gate_ok, r.gate_reasons) for r in dc.dos_gate(df, base).orderBy("window_index").collect()]
    assert got == [(bool(why), why) for _, why in GATES.values()]
    # a baseline of its own windows: a level stream has no spike
    level = dc.dos_gate(df.where("window_index = 1"), dc.baselines(df.where("window_index = 1"))).first()
    assert not level.gate_ok


def test_sequence_gate(spark):
    rng = random.Random(1)
    rows = [("c", i, rng.choice([0.3, 0.6, 0.95])) for i in range(200)]
    run = cool = marked = 0
    for *_, s in rows:
        run = run + 1 if s >= 0.5 and not cool else 0
        if run >= 2:
            marked, run, cool = marked + 1, 0, 3
        else:
            cool = max(cool - 1, 0)
    g = dc.sequence_gate(spark.createDataFrame(rows, "capture string, window_index long, score double"), 0.5, 0.9, 2, 3).first()
    assert (g.marked, g.is_attack) == (marked, True)


@pytest.mark.parametrize("cooldown", [0, 1, 2, 4])
def test_run_filter(spark, cooldown):
    flags = [int(c) for c in "0110111011110111101111111011101111"]

    def slow():
        kept, i = [False] * len(flags), 0
        while i < len(flags):
            if not flags[i]:
                i += 1
                continue
            j = i
            while j < len(flags) and flags[j]:
                j += 1
            if j - i >= 3:
                kept[i:j] = [True] * (j - i)
                i = j + cooldown
            else:
                i = j
        return kept

    df = spark.createDataFrame([("c", i, bool(f)) for i, f in enumerate(flags)], "capture string, window_index long, f boolean")
    assert [r.kept for r in dc.filtered_runs(df, F.col("f"), 3, cooldown).orderBy("window_index").collect()] == slow()


def test_host_ranking(spark):
    """Three hosts over three windows, worked out by hand."""
    counts = spark.createDataFrame([("c", 4, "p", 6), ("c", 4, "q", 1), ("c", 5, "q", 3), ("c", 5, "r", 4), ("c", 6, "p", 2)], "capture string, window_index long, host string, cnt long")
    scores = spark.createDataFrame([("c", 4, 0.8, True), ("c", 5, 0.3, False), ("c", 6, 0.75, True)], "capture string, window_index long, score double, is_attack boolean")
    by = {r.host: r for r in at.ranked(at.host_activity(counts, scores)).collect()}
    assert [(by[h].total_packets, by[h].attack_packets, by[h].attack_windows) for h in "pqr"] == [(8, 8, 2), (4, 1, 1), (4, 0, 0)]
    assert [by[h].mean_score for h in "pqr"] == pytest.approx([(6 * 0.8 + 2 * 0.75) / 8, (0.8 + 3 * 0.3) / 4, 0.3])
    assert by["p"].rank == 1 and by["p"].suspicion > by["q"].suspicion > by["r"].suspicion


def test_claims(spark):
    claims = spark.createDataFrame([("c", w, "m", f"ip{i}", n) for w in range(14) for i, n in enumerate((3, 1, 1, 1))], "capture string, window_index long, mac string, ip string, replies long")
    probs = spark.createDataFrame([("c", w, 2.830359 / 84, float(w)) for w in range(13)] + [("c", 13, 2.830359 / 84, 13.0)], "capture string, window_index long, prob double, start double")
    r = at.claim_rank(claims, probs).first()
    assert (r.distinct_ips, r.total_replies, r.windows, r.conflict_windows, r.first_conflict) == (4, 84, 14, 14, 0.0)
    assert r.score == pytest.approx(2.830359 + 10 * 2.830359 / 84 + 0.84 + 1.4 + 7000 + 3000)
    v = spark.createDataFrame([("c", "normal"), ("d", "normal")], "capture string, decision string")
    assert {x.capture: x.decision for x in at.reply_override(v, at.claim_rank(claims, probs)).collect()} == {"c": "attack", "d": "normal"}


def test_scalers_and_thresholds(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (3.0, 30.0)], "a double, b double")
    s = prep.fit_scaler(df, ["a", "b"], "robust")
    assert [(round(r.a, 6), round(r.b, 6)) for r in s.apply(df).collect()] == [(-1.0, -1.0), (0.0, 0.0), (1.0, 1.0)]
    assert [r.a for r in s.invert(s.apply(df)).collect()] == pytest.approx([1, 2, 3])
    line = spark.createDataFrame([(float(x),) for x in np.linspace(0, 1, 1001)], "error double")
    assert prep.quantile_threshold(line, "error", 0.9) == pytest.approx(0.9)
    x = np.random.default_rng(0).normal(2, 0.5, 500)
    normal = spark.createDataFrame([(float(v),) for v in x], "error double")
    assert prep.gaussian_threshold(normal, "error", 3) == pytest.approx(x.mean() + 3 * x.std())
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "a double").select(prep.finite(F.col("a")).alias("a")).collect()
    assert [r.a for r in bad] == [0, 0, 0, 2]


def test_pareto_tail():
    rng = np.random.default_rng(0)
    u = rng.random(20_000)
    shape, scale = prep.generalized_pareto(2.0 * (u**-0.2 - 1) / 0.2)
    assert shape == pytest.approx(0.2, abs=0.03) and scale == pytest.approx(2.0, rel=0.05)


def test_extreme_threshold_of_many_rows(spark):
    """The threshold depends neither on the number of rows nor on one outlier."""
    n = 1_000_000
    one = spark.range(n).select((-F.log((F.col("id") + 0.5) / n)).alias("error"))
    got = prep.extreme_threshold(one, "error", seed_q=0.9)
    assert got == pytest.approx(np.log(10) + np.log(100), rel=0.01)
    assert prep.extreme_threshold(one.unionByName(one), "error", seed_q=0.9) == pytest.approx(got, rel=1e-3)
    assert prep.extreme_threshold(one.unionByName(spark.createDataFrame([(1e6,)], "error double")), "error", seed_q=0.9) == pytest.approx(got, rel=0.05)


def test_principal_components(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2)) @ np.array([[3.0, 1.0], [0.0, 0.5]]) + 5
    df = spark.createDataFrame(x.tolist(), "a double, b double")
    means, comps, share = prep.principal(df, ["a", "b"], 2)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(np.abs(comps[0]), np.abs(vectors[:, 1])) and share[0] == pytest.approx(values[1] / values.sum())
    got = np.array([r.pc1 for r in prep.project(df, ["a", "b"], means, comps).collect()])
    assert np.allclose(np.abs(got), np.abs((x - x.mean(axis=0)) @ vectors[:, 1]))


def test_metrics(spark):
    rng = random.Random(0)
    rows = [(round(rng.random(), 1), rng.randint(0, 1)) for _ in range(200)]
    m = ev.metrics(spark.createDataFrame(rows, "score double, label int")).first()
    pairs = [(a > b) + (a == b) / 2 for a, x in rows if x for b, y in rows if not y]
    assert m.roc_auc == pytest.approx(sum(pairs) / len(pairs))
    ap, seen = 0.0, 0
    total = sum(y for _, y in rows)
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp, n = sum(y for s, y in rows if s >= t), sum(s >= t for s, _ in rows)
        ap, seen = ap + (tp - seen) / total * tp / n, tp
    assert m.average_precision == pytest.approx(ap)
    none = ev.metrics(spark.createDataFrame([(0.5, 0)], "score double, label int")).first()
    assert (none.roc_auc, none.average_precision, none.f1) == (0, 0, 0)


def test_networks(spark):
    rng = np.random.default_rng(0)
    layers = [(rng.normal(size=(3, 4)), rng.normal(size=3)), (rng.normal(size=(4, 3)), rng.normal(size=4))]
    x = rng.normal(size=(20, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>")
    got = [r.score for r in sc.scored(df, "x", sc.autoencoder_error, layers).orderBy("i").collect()]
    want = ((np.maximum(x @ layers[0][0].T + layers[0][1], 0) @ layers[1][0].T + layers[1][1] - x) ** 2).mean(axis=1)
    assert got == pytest.approx(want.tolist())
    hidden = df.select(sc.dense_layer(F.col("x"), *layers[0]).alias("h")).collect()
    assert np.allclose([r.h for r in hidden], np.maximum(x @ layers[0][0].T + layers[0][1], 0))
    seq, static = rng.normal(size=(5, 8, 3)), rng.normal(size=(5, 2))
    p = {"blocks": [(rng.normal(size=(3, 3)), rng.normal(size=(4, 3)), np.zeros(4)), (rng.normal(size=(4, 3)), rng.normal(size=(4, 4)), np.zeros(4))], "attention": rng.normal(size=4), "head": [(rng.normal(size=(5, 6)), np.zeros(5)), (rng.normal(size=(1, 5)), np.zeros(1))]}
    logits, attention = sc.depthwise_detector(seq, static, p)
    assert logits.shape == (5,) and np.allclose(attention.sum(axis=1), 1)
    cell = lambda n, h: {"input": rng.normal(size=(4 * h, n)), "hidden": rng.normal(size=(4 * h, h)), "bias": rng.normal(size=4 * h)}
    bi = {"layers": [(cell(3, 4), cell(3, 4))], "attention_w": rng.normal(size=(5, 8)), "attention_v": rng.normal(size=5), "out_w": rng.normal(size=16), "out_b": 0.1}
    probs = sc.bilstm_scores(seq, bi)
    assert probs.shape == (5, 8) and ((probs > 0) & (probs < 1)).all()
    assert np.allclose(sc.lstm(seq[:, ::-1], bi["layers"][0][1])[:, ::-1], sc.lstm(seq, bi["layers"][0][1], True))


def test_autoencoder_learns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2)) @ rng.normal(size=(2, 6))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    layers = sc.train_autoencoder(df, "x", [8, 4], epochs=300, rate=1e-2)
    assert sc.autoencoder_error(x, layers).mean() < 0.5 * (x**2).mean()


def test_temperature(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    df = spark.createDataFrame([(float(3 * a), int(b)) for a, b in zip(z, y, strict=True)], "logit double, label int")
    assert sc.fit_temperature(df, "logit", "label") == pytest.approx(3.0, rel=0.12)
