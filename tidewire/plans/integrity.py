"""Integrity of a built site: links, fragments, duplicate ids and required files.

Pages are (path, html) rows. References are taken out with expressions, so a
check of any number of pages is two anti-joins and one aggregate.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name of an attribute followed by a quoted value
_ATTR = r"(?is)<[a-z][^>]*?\s{name}\s*=\s*[\"']([^\"']*)[\"']"


def attribute_values(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(_ATTR.replace("{name}", name)), F.lit(1))


def references(pages: DataFrame) -> DataFrame:
    """(path, target, fragment) of every link, image and script of every page."""
    refs = F.concat(attribute_values(F.col("html"), "href"), attribute_values(F.col("html"), "src"))
    d = pages.select("path", F.explode(refs).alias("ref"))
    target = F.regexp_extract("ref", r"^([^#]*)", 1)
    return d.select("path", "ref", target.alias("target"), F.when(F.col("ref").contains("#"), F.regexp_extract("ref", r"#(.*)$", 1)).alias("fragment"))


def anchors(pages: DataFrame) -> DataFrame:
    """(path, id) of every element id."""
    return pages.select("path", F.explode(attribute_values(F.col("html"), "id")).alias("id"))


def resolve(target: Column, path: Column, base: str) -> Column:
    """File that a local reference means; null for other hosts and schemes."""
    folder = F.regexp_replace(path, r"[^/]*$", "")
    local = ~target.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)")
    file = F.when(target == "", path).when(target.startswith(base), F.substring(target, len(base) + 1, 1 << 20)).when(~target.startswith("/"), F.concat(folder, target))
    file = F.regexp_replace(file, r"\?.*$", "")
    return F.when(local, F.when((file == "") | file.endswith("/"), F.concat(file, F.lit("index.html"))).otherwise(file))


def repeated_ids(pages: DataFrame) -> DataFrame:
    """(path, code, message) of element ids that stand in a page more than once."""
    twice = anchors(pages).groupBy("path", "id").count().where("count > 1")
    return twice.select("path", F.lit("duplicate_id").alias("code"), F.col("id").alias("message"))


def issues(pages: DataFrame, files: DataFrame, required: DataFrame, base: str = "/") -> DataFrame:
    """(path, code, message): missing targets, missing fragments, repeated ids, missing required files."""
    refs = references(pages).withColumn("file", resolve(F.col("target"), F.col("path"), base))
    escapes = refs.where(F.col("target").startswith("/") & ~F.col("target").startswith("//") & ~F.col("target").startswith(base))
    outside = escapes.select("path", F.lit("outside_base").alias("code"), F.col("ref").alias("message"))
    local = refs.where("file is not null")
    lost = local.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_anti").select("path", F.lit("missing_target").alias("code"), F.col("ref").alias("message"))
    ids = anchors(pages)
    named = local.where("fragment is not null and fragment <> ''").join(pages.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    known = ids.select(F.col("path").alias("file"), F.col("id").alias("fragment")).distinct()
    broken = named.join(known, ["file", "fragment"], "left_anti").select("path", F.lit("missing_fragment").alias("code"), F.col("ref").alias("message"))
    twice = repeated_ids(pages)
    absent = required.select("path").join(files.select("path"), "path", "left_anti").select("path", F.lit("missing_file").alias("code"), F.col("path").alias("message"))
    out = lost.unionByName(broken).unionByName(twice).unionByName(absent).unionByName(outside)
    return out.distinct()
