"""Address predicates against the standard library, one-to-one renaming, samples and thinning that don't hang on partitions, components against NumPy, histories."""

import ipaddress
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import net
from tidewatch.operators import augment as au
from tidewatch.operators import prep
from tidewatch.operators import windows as win


def addresses():
    rng = random.Random(1)
    out = ["", "x", "1.2.3", "1.2.3.256", "::", "::1", ":::", "1::2::3", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::ffff:127.0.0.1", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "12345::", "fe80::1%eth0", "FC00::1", "2001:1::1", "2001:1::2", "2001:1::3", "2001:4:112::5", "2001:3::", "2001:20::", "2001:2f::", "2001:30::", "2001:3f:1::", "2001:1ff::", "2001:200::", "2001:db8::1", "2002::", "3fff:fff::", "3fff:1000::", "ff02::c", "100::1", "100:0:0:1::", "64:ff9b:1::", "64:ff9b::1", "fdff::", "fe00::", "1:2:3:4:5:6:1.2.3.4", "::1.2.3", "1::", "::1:2:3:4:5:6:7", ":1:2:3:4:5:6:7", None]
    for _ in range(400):
        out.append(str(ipaddress.IPv6Address(rng.getrandbits(128))))
        out.append(str(ipaddress.IPv6Address((rng.choice([0x2001, 0xFC00, 0x100, 0x64, 0x2002, 0xFE80, 0x3FFF, 0]) << 112) | (rng.randrange(0, 0x240) << 96) | rng.getrandbits(rng.choice([0, 16, 90])))))
        out.append(str(ipaddress.IPv4Address(rng.getrandbits(32))))
    return out


def private(text):
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return False
    a = getattr(a, "ipv4_mapped", None) or a
    return a.is_private and not (a.is_loopback or a.is_link_local or a.is_unspecified or a.is_multicast)


def test_private_addresses(spark):
    df = spark.createDataFrame([(a,) for a in addresses()], "a string").select("a", net.is_private_ip(F.col("a")).alias("p"))
    rows = df.collect()
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.a, r.p) for r in rows if r.p != private(r.a)] == []


def test_renaming_is_one_to_one(spark):
    rows = spark.range(30_000).select(F.lit("a").alias("capture"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("src_ip"), F.concat(F.lit("h"), (F.col("id") % 7).cast("string")).alias("dst_ip"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("src_mac"))
    got = au.remapped(rows, ["capture"], 3)
    r = got.agg(F.countDistinct("src_ip").alias("ips"), F.countDistinct("src_mac").alias("macs"), F.countDistinct("dst_ip").alias("few"), F.min(F.col("src_ip").rlike(r"^10(\.\d{1,3}){3}$")).alias("shape"), F.min(F.col("src_mac").rlike("^02(:[0-9a-f]{2}){5}$")).alias("mac")).first()
    assert tuple(r) == (30_000, 30_000, 7, True, True)
    again = {x.src_mac for x in au.remapped(rows.repartition(7), ["capture"], 3).where("dst_ip is not null").limit(50).collect()}
    assert again <= {x.src_mac for x in got.collect()}
    some = lambda df: sorted(tuple(x) for x in au.remapped(df, ["capture"], 3).where("src_mac like '%:00'").collect())
    assert some(rows) == some(rows.repartition(5))


def test_samples_and_thinning_repeat(spark):
    df = spark.range(5000).select(F.lit("c").alias("capture"), F.col("id").alias("packet_no"), (F.col("id") % 3).alias("label"))
    ids = lambda d: sorted(r.packet_no for r in d.collect())
    a = au.overlaid(df.limit(0), df, 0.5, 1)
    assert ids(a) == ids(au.overlaid(df.limit(0), df.repartition(9), 0.5, 1)) and 850 < a.count() < 1150
    thin = prep.balanced(df, "label", "packet_no", 40)
    assert ids(thin) == ids(prep.balanced(df.repartition(5), "label", "packet_no", 40))
    want = [r for k in range(3) for r in sorted((i for i in range(5000) if i % 3 == k), key=lambda i: (i * 2654435761 % 2**32, i))[:40]]
    assert ids(thin) == sorted(want)


def test_components_from_sums_of_matrices(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4)) @ rng.normal(size=(4, 4)) + 1e6
    df = spark.createDataFrame([tuple(r) for r in x.tolist()] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double").repartition(5)
    means, vectors, share = prep.principal(df, list("abcd"), 2)
    u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert means == pytest.approx(x.mean(axis=0)) and share == pytest.approx((s**2 / (s**2).sum())[:2])
    assert np.abs(np.sum(vectors * v[:2], axis=1)) == pytest.approx([1, 1])


def test_histories_over_gaps(spark):
    rng = random.Random(6)
    rows = [(k, i, None if rng.random() < 0.1 else float(rng.randint(0, 50))) for k in "ab" for i in sorted(rng.sample(range(400), 60))]
    for bucket in (4096, 10, 1):
        got = {(r.k, r.i): r for r in win.before(spark.createDataFrame(rows, "k string, i long, x double"), ["k"], "i", "x", 4, bucket).collect()}
        for k in "ab":
            past = []
            for _, i, v in (r for r in rows if r[0] == k and r[2] is not None):
                last, r = past[-4:], got.pop((k, i))
                assert (r.previous, r.history_n) == (last[-1] if last else None, len(last))
                assert (r.history_mean, r.history_std) == (pytest.approx((np.mean(last), np.std(last))) if last else (None, None))
                past.append(v)
        assert not got
