"""URL filters with redirect equivalence, in DataFrame functions only.

Rules name a host and a path prefix; a rule fits its host and all subdomains if the URL's path starts with its path, and
the longest rule that fits wins. Pages that a rule fits get its verdict.

Other pages inherit: URLs that redirect to each other (HTML refresh) or name the same canonical URL are aliases, and a
block decision on one URL of such a class holds for all of it, unless a URL of the class is explicitly allowed: allow goes
before block. A page that inherits nothing is allowed.

The classes are connected components. Each page mentions URLs: its own, canonical and refresh targets. Pages are linked
through the smallest page that mentions the same URL, so URLs outside the table link pages as well, and their rules count.
A page's own URL links it only where another page points to that URL. Links, components and flags are distributed tables;
rules are a parameter of the caller (a literal expression), not a table.

Edge cases: a null URL, or one without ://, has an empty host and path, fits no rule, and is allowed unless its html links
it to a blocked class. Null html mentions nothing. Rows with a null page_id are judged by their own URL alone. Rows that repeat a page_id are one node but
are judged each by its own URL. Relative targets resolve against the page's URL, &amp; in targets counts as &. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .graph import components

#: (host, path, verdict)
Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased. Empty where there is no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _key(url: Column) -> Column:
    """A URL without its scheme, fragment and the slashes at its end."""
    tail = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), "/+$", "")
    return F.when(host_of(url) != "", F.concat(host_of(url), tail))


def _plain(path: Column) -> Column:
    """A path that starts with / without its . and .. segments."""
    segments = F.split(F.substr(path, F.lit(2)), "/")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, s: F.when(s == "..", up(done)).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    open_end = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, open_end), "/"))


def _absolute(target: Column, url: Column) -> Column:
    """What a target of the page at url names; null for none, and for schemes without a host."""
    scheme = F.regexp_extract(url, r"^([^:/?#]+)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    target = F.regexp_replace(target, r"(?i)&(amp|#38|#x26);", "&")
    path, tail = (F.regexp_extract(target, r"(?s)^([^?#]*)(.*)$", k) for k in (1, 2))
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(url), r"(?s)^/(.*/)?", 1))
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return (
        F.when(F.trim(target) == "", F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("/"), F.concat(site, _plain(path), tail))
        .when(target.startswith("?"), F.concat(site, path_of(url), tail))
        .when(target.startswith("#"), F.concat(site, path_of(url), query, tail))
        .otherwise(F.concat(site, _plain(F.concat(folder, path)), tail))
    )


def targets_of(url: Column, html: Column) -> Column:
    """Array of the absolute canonical and refresh targets that html names."""
    tags = lambda pattern: F.coalesce(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
    href = lambda tag: F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    to = lambda tag: F.regexp_extract(tag, r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    found = F.concat(F.transform(tags(LINK), href), F.transform(tags(REFRESH), to))
    return F.filter(F.transform(found, lambda t: _absolute(t, url)), lambda t: t.isNotNull())


def judge(pages: DataFrame, rules: list[Rule], scratch: Scratch, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and component (the smallest page_id of its class, null if it is alone)."""
    u = F.col(url).cast("string")
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), u.alias("url"), targets_of(u, F.col(html).cast("string")).alias("targets"))
    own = scratch.cut(own.select("page_id", "url", "targets", _key(F.col("url")).alias("key")), "pages")
    flags = aliases(own, rules, scratch)
    out = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = out.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).join(flags, "page_id", "left")
    inherited = F.when(F.coalesce("class_block", F.lit(False)) & ~F.coalesce("class_allow", F.lit(False)), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", inherited).alias("verdict"), "component")


def aliases(own: DataFrame, rules: list[Rule], scratch: Scratch) -> DataFrame:
    """page_id, component, class_block and class_allow of the pages that redirect or canonical links join to others."""
    known = own.filter(F.col("page_id").isNotNull())
    pointing = known.select("page_id", F.explode("targets").alias("target")).select("page_id", "target", _key(F.col("target")).alias("key")).filter("key is not null")
    pointing = scratch.cut(pointing, "pointing")
    aimed = pointing.select("key").distinct()
    mentions = pointing.select("page_id", "key").unionByName(known.filter("key is not null").join(aimed, "key", "left_semi").select("page_id", "key"))
    mentions = scratch.cut(mentions.distinct(), "mentions")
    first = mentions.groupBy("key").agg(F.min("page_id").alias("b"))
    found = components(mentions.join(first, "key").select(F.col("page_id").alias("a"), "b"), scratch)
    found = scratch.cut(found, "classes").withColumnRenamed("node", "page_id")

    # A page that points to a URL outside the table still hears that URL's rule, so each pointing page is in a class.
    urls = pointing.select("page_id", F.col("target").alias("url")).unionByName(known.select("page_id", "url"))
    ruled = urls.select("page_id", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("verdict")).filter("verdict is not null")
    said = ruled.groupBy("page_id").agg(F.max(F.col("verdict") == "block").alias("block"), F.max(F.col("verdict") == "allow").alias("allow"))
    members = found.unionByName(pointing.select("page_id").distinct().join(found.select("page_id"), "page_id", "left_anti").withColumn("component", F.col("page_id")))
    members = scratch.cut(members.join(said, "page_id", "left"), "members")
    verdicts = members.groupBy("component").agg(F.max("block").alias("class_block"), F.max("allow").alias("class_allow"))
    return members.select("page_id", "component").join(verdicts, "component")
