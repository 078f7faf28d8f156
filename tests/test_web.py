"""IPv6 networks as columns against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from turnwise.functions import web as W


def network(text):
    try:
        return str(ipaddress.IPv6Network((text, 48), strict=False))
    except ValueError:
        return ""


def test_ipv6_prefixes(spark):
    rng = random.Random(1)
    texts = ["::", "::1", "1::", "2001:DB8::", "::ffff:1.2.3.4", "64:ff9b::10.0.0.300", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8", "1::2::3", "1:2:3", "12345::", ":1:2", "0:0:7::1", "a:0:0:b::", "g::", ":::", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:8::"]
    for _ in range(300):
        value = ipaddress.IPv6Address(rng.getrandbits(128) & ~(rng.getrandbits(128) & rng.getrandbits(128) | ((1 << 80) - 1) * rng.randrange(2)))
        texts.append(rng.choice([str(value), value.exploded, str(value).upper()]))
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    got = {r.ip: r.p for r in df.select("ip", W.ip_prefix(F.col("ip")).alias("p")).collect()}
    assert got == {t: network(t) for t in texts}
