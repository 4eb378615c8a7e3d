"""URL rules whose block decisions reach all aliases of a page: redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ://; empty without one or for null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """A page's identity: lower-case host, path and query; scheme and fragment don't tell pages apart. Null without a host."""
    rest = F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def without_dots(path: Column) -> Column:
    """A path with its . and .. segments taken out; .. at the top is nothing."""
    parts = F.split(path, "/")
    end = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.array_append(acc, x)),
    )
    return F.when(F.instr(path, "/.") > 0, F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(end.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))).otherwise(path)


def resolved(url: Column, target: Column) -> Column:
    """target as an address seen from url: relative ones are resolved, &amp; is &; null for other schemes than those with ://."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    base, path = F.concat(F.lit("http://"), host_of(url)), path_of(url)
    own = F.regexp_extract(target, r"^[^?#]*", 0)
    rest = F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^(.*/)?", 0)), own))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(own == "", F.concat(base, path, rest))
        .otherwise(F.concat(base, without_dots(whole), rest))
    )


def alias_edges(pages: DataFrame, url_col: str, html_col: str, redirects: DataFrame | None) -> DataFrame:
    """(url, target) of canonical links, meta refreshes and redirects (columns url, target); relative targets are made absolute."""
    tags = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)<(?:link|meta)\s[^>]*>"), F.lit(0))
    kind = lambda t: t.rlike(r"""(?i)\srel\s*=\s*["']?canonical\b""") | t.rlike(r"""(?i)\shttp-equiv\s*=\s*["']?refresh\b""")
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    found = rows.select("url", F.explode(F.filter(tags, kind)).alias("tag"))
    target = F.regexp_extract("tag", r"""(?i)(?:\shref\s*=\s*["']?|;\s*url\s*=\s*["']?)([^"'\s>]+)""", 1)
    edges = found.select("url", target.alias("target"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "target"))
    edges = edges.where((F.col("target") != "") & (host_of(F.col("url")) != ""))
    return edges.select("url", resolved(F.col("url"), F.col("target")).alias("target")).where("target is not null")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Of distinct (host, path) rows those that a rule fits: _host, _path, rule, rule_verdict, by the longest rule.

    rules: columns rule ("host/path") and verdict. The join is on the rule's host, one of the host's
    endings; of the same rule with both verdicts, allow wins. Spark broadcasts the rules only if they are small.
    """
    r = rules.select("rule", F.col("verdict").alias("rule_verdict"), F.substring_index("rule", "/", 1).alias("rule_host"), F.expr("substring(rule, instr(rule, '/'))").alias("rule_path"))
    deepest = r.agg(F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(0)).alias("n")).first()["n"]
    parts = F.expr(f"slice(split(host, '[.]'), greatest(1, size(split(host, '[.]')) - {deepest} + 1), {max(deepest, 1)})")
    endings = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "."))
    asked = urls.where("host <> ''").select("host", "path").distinct().withColumn("parts", parts).select("host", "path", F.explode(endings).alias("ending"))
    fits = asked.join(r, (F.col("ending") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", (F.col("rule_verdict") == "allow").alias("a"))).alias("m"))
    return best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "m.rule", F.when(F.col("m.a"), "allow").otherwise("block").alias("rule_verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, aliased (whether the verdict came from an alias).

    A rule decides the pages that it fits. Pages without one take part in the component of their redirect
    and canonical-link edges: a block of any member, crawled or only linked, reaches them, an allow does
    not; a page's own allow stands against its aliases' blocks. Everything else is allowed. A null url or one without
    :// has an empty host and path, no rule and no aliases. Rows with the same url get the same verdict, whatever their page_id; an empty
    table gives no rows, and without rules everything is allowed. Other columns aren't read.

    Addresses that rules fit and aliases grow with the pages, so they are never broadcast; large partitions of hot addresses are split by Spark.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    edges = shared.materialise(alias_edges(rows, "url", "html", redirects))
    ends = edges.select(F.explode(F.array("url", "target")).alias("url"))
    address = [host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")]
    matched = shared.materialise(match_rules(rows.select(*address).unionByName(ends.select(*address)), rules))
    links = edges.select(node_of(F.col("url")).alias("u"), node_of(F.col("target")).alias("v")).where("u is not null and v is not null")
    roots = shared.components(links)
    nodes = ends.select(node_of(F.col("url")).alias("node"), *address).distinct()
    blocked = nodes.join(matched.hint("merge"), (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path"))).where("rule_verdict = 'block'").select("node").distinct()
    bad = roots.join(blocked.hint("merge"), "node").select("root").distinct()
    aliases = roots.join(bad.hint("merge"), "root", "left_semi").select(F.col("node").alias("_node"))
    out = rows.select("page_id", *address, node_of(F.col("url")).alias("_n"))
    out = out.join(matched.hint("merge"), (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").join(aliases.hint("merge"), F.col("_n") == F.col("_node"), "left")
    verdict = F.coalesce(F.col("rule_verdict"), F.when(F.col("_node").isNotNull(), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), (F.col("rule").isNull() & F.col("_node").isNotNull()).alias("aliased"))
