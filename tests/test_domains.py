import random

from pyspark.sql import functions as F

from tidewire.functions import urls
from tidewire.operators import domains


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equals_the_comparison_of_all_with_all_without_comparing_all(spark):
    rng = random.Random(1)
    label = lambda: rng.choice(["a", "b", "www", "x1", "com", "Org"])
    hosts = [(i, ".".join(label() for _ in range(rng.randint(1, 5))) + rng.choice(["", "", ".", ".."])) for i in range(300)] + [(900, None), (901, ""), (902, "a.com"), (902, "a.com")]
    names = [".".join(label() for _ in range(rng.randint(1, 3))) for _ in range(40)] + ["www.a.com", "a.com", "", None, "com."]
    h, d = spark.createDataFrame(hosts, "n long, host string"), spark.createDataFrame([(x,) for x in names], "domain string")
    wide = h.where("host <> ''").crossJoin(d.where("domain <> ''").distinct()).where(urls.domain_matches(F.col("host"), F.col("domain")) & (urls.bare_host(F.col("domain")) != ""))
    assert sorted(domains.matches(h, "host", d).collect()) == sorted(wide.select("host", "domain").distinct().collect())
    kept = domains.under(h, "host", d)
    assert sorted(kept.collect()) == sorted(h.join(wide.select("host").distinct(), "host", "left_semi").select("n", "host").collect())
    assert "NestedLoop" not in plan(kept) and "Cartesian" not in plan(kept)


def test_a_hundred_thousand_domains(spark):
    d = spark.range(100_000).select(F.concat(F.lit("site"), "id", F.lit(".example")).alias("domain"))
    h = spark.range(200_000).select("id", F.concat(F.lit("m.site"), F.col("id") % 150_000, F.lit(".example")).alias("host"))
    assert domains.under(h, "host", d).count() == 150_000
    assert domains.matches(h.limit(0), "host", d).count() == 0
