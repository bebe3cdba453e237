"""URL rules with redirect equivalence.

A rule is a host and a path prefix with an action. It fits its host and every subdomain where the
URL's path starts with the rule's path; the longest rule (host plus path) wins, allow before block
when two are as long. Redirects and canonical links make URLs aliases of each other: distributed
connected components over those edges group them, and a block on one member spreads to every alias.
Explicit allow takes precedence: a URL that an allow rule itself fits is never blocked through its
aliases. URLs that no rule fits and no alias blocks are allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relmill.operators.components import connected_components
from relmill.staging import Scratch

#: Rules of the fitting hosts in all up to which these are broadcast.
FEW = 50_000
UPPER, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: HTML that is not markup of the page itself, tags with their quoted values, and attributes with theirs.
NOT_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
TAG = r"""(?is)<%s(?=[\s/>])(?:"[^"]*"|'[^']*'|[^'">])*>"""
ATTRIBUTE = r"""(?is)[\s/"']([^\s/>="']+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
REFRESH_URL = r"(?is)^[^;,]*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"']*?)[\"']?\s*$"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER_AZ)


def path_of(url: Column) -> Column:
    """From the end of the host up to ? or # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """The URL as a node: scheme and host lower-cased, no fragment; null without ://."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), rest))


def without_dots(path: Column) -> Column:
    """A path without . and .. segments (RFC 3986, 5.2.4); .. above the root is dropped."""
    parts = F.split(path, "/", -1)
    step = lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).when(x == ".", out).otherwise(F.concat(out, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step)
    last = F.element_at(parts, -1)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)  # a folder stays one
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(path)


def resolved(base: Column, link: Column) -> Column:
    """A link made absolute against the page that holds it, by RFC 3986, 5.2; null for an address without //, such
    as mailto:, and for a page without ://. The fragment goes."""
    link = F.regexp_replace(F.trim(F.replace(link, F.lit("&amp;"), F.lit("&"))), r"(?s)#.*$", "")
    part = lambda pattern: F.regexp_extract(base, pattern, 1)
    root, path, query = part(r"(?s)^(.*?://[^/?#]*)"), part(r"(?s)^.*?://[^/?#]*([^?#]*)"), part(r"(?s)^.*?://[^?#]*(\?[^#]*)")
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    own, search = F.regexp_extract(link, r"(?s)^([^?]*)", 1), F.regexp_extract(link, r"(?s)^[^?]*(\?.*)$", 1)
    other = F.when(link.startswith("//"), F.concat(part(r"(?s)^(.*?)://"), F.lit(":"), link)).otherwise(link)
    absolute = F.concat(F.regexp_extract(other, r"(?s)^(.*?://[^/?#]*)", 1), without_dots(F.regexp_extract(other, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.regexp_extract(other, r"(?s)^.*?://[^?#]*(\?.*)$", 1))
    return (
        F.when(F.instr(base, "://") == 0, F.lit(None))
        .when(link.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"), absolute)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link == "", F.concat(root, path, query))
        .when(own == "", F.concat(root, path, search))
        .when(own.startswith("/"), F.concat(root, without_dots(own), search))
        .otherwise(F.concat(root, without_dots(F.concat(folder, own)), search))
    )


def attributes(tag: Column) -> Column:
    """name to value of a tag's attributes, the first one where a name repeats; names are lower-cased."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 1), lambda n: F.lower(n))
    values = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 2), lambda v: F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v))
    pairs = F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda p, i: F.array_position(names, p["n"]) == i + 1)
    return F.map_from_entries(pairs)


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) for each canonical link and meta refresh in the pages' markup. rel is a list of words; links that
    name no address give no edge."""
    read = pages.where(F.instr(url_col, "://") > 0).where(F.col(html_col).rlike(r"(?i)canonical|refresh"))
    read = read.select(F.col(url_col).alias("u"), F.regexp_replace(F.col(html_col), NOT_MARKUP, "").alias("m"))
    tags = lambda name: F.transform(F.regexp_extract_all("m", F.lit(TAG % name), 0), attributes)
    word = lambda value, name: F.array_contains(F.split(F.lower(F.trim(value)), r"\s+"), name)
    canonical = F.transform(F.filter(tags("link"), lambda a: word(F.coalesce(a["rel"], F.lit("")), "canonical") & a["href"].isNotNull()), lambda a: a["href"])
    refresh = F.filter(tags("meta"), lambda a: F.lower(F.trim(F.coalesce(a["http-equiv"], F.lit("")))) == "refresh")
    refresh = F.filter(F.transform(refresh, lambda a: F.regexp_extract(F.coalesce(a["content"], F.lit("")), REFRESH_URL, 1)), lambda u: u != "")
    links = read.select("u", F.explode(F.concat(canonical, refresh)).alias("link"))
    return links.select(address(F.col("u")).alias("src"), address(resolved(F.col("u"), F.col("link"))).alias("dst")).where("dst is not null")


def rule_table(spark: SparkSession, rules: DataFrame | Sequence[tuple[str, str, str]], scratch: Scratch) -> tuple[DataFrame, list[int]]:
    """(rule_host, rules) with the rules of each host, and the numbers of labels that their hosts have."""
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string, action string")
    one = F.struct((F.length("host") + F.length("path")).alias("size"), (F.col("action") == "allow").alias("allow"), F.col("path").alias("path"), F.concat("host", "path").alias("rule"))
    table = scratch.store(table.select("host", "path", "action").where("host is not null and path is not null").distinct().groupBy(F.col("host").alias("rule_host")).agg(F.collect_list(one).alias("rules")), "rules")
    depths = table.groupBy(F.size(F.split("rule_host", r"\.")).alias("d")).count().collect()  # a name has at most 127 labels
    return table, sorted(r.d for r in depths)


def ruled(df: DataFrame, rules: tuple[DataFrame, list[int]], scratch: Scratch, host: str = "host", path: str = "path") -> DataFrame:
    """Adds rule and own (allow, block or null). The distinct hosts are joined with the rules once for each number of
    labels that rules have; the hosts that a rule fits come back to the rows, broadcast if they are few."""
    table, depths = rules
    hosts = df.select(F.col(host).alias("_host")).where("_host <> ''").distinct().withColumn("_fits", F.array().cast(table.schema["rules"].dataType))
    for d in depths:
        own = table.where(F.size(F.split("rule_host", r"\.")) == d).select("rule_host", "rules")
        labels = F.split("_host", r"\.")
        suffix = F.when(F.size(labels) >= d, F.array_join(F.slice(labels, -d, d), "."))
        hosts = hosts.join(own, suffix == F.col("rule_host"), "left").select("_host", F.concat("_fits", F.coalesce("rules", F.array().cast(table.schema["rules"].dataType))).alias("_fits"))
    fits = scratch.store(hosts.where(F.size("_fits") > 0), "ruled-hosts")
    few = fits.agg(F.coalesce(F.sum(F.size("_fits")), F.lit(0))).first()[0] <= FEW
    best = F.array_max(F.filter("_fits", lambda r: F.col(path).startswith(r["path"])))
    out = df.join(F.broadcast(fits) if few else fits.hint("merge"), F.col(host) == F.col("_host"), "left").withColumn("_best", best)
    return out.withColumns({"rule": F.col("_best.rule"), "own": F.when(F.col("_best.allow"), "allow").when(~F.col("_best.allow"), "block")}).drop("_best", "_host", "_fits")


def url_filter(
    pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_blocked for every page.

    rules: (host, path, action), a list or a table of any length; one with a null host or path fits nothing. redirects: further (src, dst) URL pairs, such as a crawler's log;
    edges in the pages' own markup are always read. A null URL or one without :// has an empty host and
    path, fits no rule, has no aliases and is allowed. Repeated pages are judged alike; other columns
    are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession)
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("src")).alias("src"), address(F.col("dst")).alias("dst")))
    groups = scratch.store(connected_components(edges, scratch, "src", "dst"), "aliases")
    table = rule_table(pages.sparkSession, rules, scratch)
    sides = ruled(groups.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), table, scratch)
    blocked = scratch.store(sides.groupBy("component").agg(F.max((F.col("own") == "block").cast("int")).alias("b")).where("b = 1").select("component"), "alias-blocks")
    spread = scratch.store(groups.join(blocked, "component", "left_semi").select(F.col("node").alias("_node"), F.lit(True).alias("_hit")), "alias-hits")
    judged = pages.select(F.col(id_col).alias("page_id"), address(F.col(url_col)).alias("_node"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = ruled(judged, table, scratch)
    # pages that no alias could block skip the join, so that null addresses do not meet in one task
    if spread.take(1):
        apart = F.coalesce("_node", F.concat(F.lit("\u0000"), F.xxhash64("page_id").cast("string")))
        judged = judged.withColumn("_node", apart).join(spread, "_node", "left")
    else:
        judged = judged.withColumn("_hit", F.lit(False))
    hit = F.coalesce("_hit", F.lit(False))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(hit, "block").otherwise("allow")).alias("verdict"), (hit & F.col("own").isNull()).alias("alias_blocked"))
