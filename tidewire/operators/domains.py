"""Hosts and the domains that they lie under, as equi-joins on domain suffixes.

A host is under a domain if the domain, without a leading ``www.``, is one of the host's own suffixes.
A host has as many suffixes as labels, so each distinct host is spelled out into these few rows and
joined by equality; neither side is compared with the whole of the other.

Null and empty hosts or domains match nothing; repeated domains match once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import urls


def suffixes(host: Column) -> Column:
    """The host itself and all domains above it, without a leading www."""
    labels = F.split(urls.bare_host(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def matches(rows: DataFrame, host: str, domains: DataFrame, domain: str = "domain") -> DataFrame:
    """(host, domain): every distinct host of ``rows`` with each domain that it lies under, both as written."""
    hosts = rows.select(F.col(host).alias("host")).where("host <> ''").distinct()
    keyed = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("_key"))
    named = domains.select(F.col(domain).alias("domain"), urls.bare_host(F.col(domain)).alias("_key")).where("_key <> ''").distinct()
    return keyed.join(named, "_key").select("host", "domain")


def under(rows: DataFrame, host: str, domains: DataFrame, domain: str = "domain") -> DataFrame:
    """The rows whose host lies under any of the domains, as they are."""
    found = matches(rows, host, domains, domain).select(F.col("host").alias(host)).distinct()
    return rows.join(found, host, "left_semi").select(*rows.columns)
