"""Block and allow rules for urls, carried over redirects and canonical links.

A rule names a host and the start of a path; it fits the host and its subdomains, and the
longest fitting rule decides.  A url without a rule of its own is judged by its aliases:
urls that redirect to one another or name one another as canonical form one component, and
where a rule blocks a member, all of them are blocked, unless a rule allows a member: an
explicit allow goes before every block that is only passed on.  Urls that nothing decides
are allowed.

Redirects are refresh tags, canonical links are link tags of the pages, and further edges
(a crawl's redirect log) can be given.  Urls that differ in scheme, default port, letter
case of the host or fragment only are one node.  Links to other schemes are no edges.

Rules meet the distinct hosts, not the pages: each host is taken apart into the domains it
lies in, which are joined with the rules' hosts, so long rule lists need no longer work
per page.  Only pages with a tag take part in the components; what comes back to the pages
is the list of nodes in blocked components that have no rule.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and
no aliases and is allowed; null or empty html has no links; rows repeated in full are each
judged alike; rules of equal length that fit one url: allow goes first, then the smaller
rule; an unclosed comment or script reaches to the end of the html; very long html is
searched whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.functions.plan import broadcast_if_small, written
from codeaudit.llm.common import lower_ascii, table
from codeaudit.llm.components import components

#: verdict, host and start of the path
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Comments, scripts and styles are matched too, so that tags inside them are passed over.
TAGS = (
    r"(?is)<!--(?:.*?-->|.*)|<script\b(?:.*?</script\s*>|.*)|<style\b(?:.*?</style\s*>|.*)"
    r"""|<(?:link|meta)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>?"""
)
ATTRIBUTE = r"""(?s)([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""
REFRESH = r"""(?is)^\s*[0-9.]+\s*[;,\s]\s*(?:url\s*=\s*)?["']?([^"']*)"""


def host_of(url: str | Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: str | Column) -> Column:
    """The digest of host, path and query; null for a url without a host."""
    host = F.regexp_replace(host_of(url), r":(?:80|443)?$", "")
    path, query = path_of(url), F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.md5(F.concat(host, F.when(path == "", "/").otherwise(path), query)))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(rules or RULES, "verdict string, rule_host string, rule_path string")


def host_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): every distinct host that rules fit, with these in order of precedence."""
    hosts = urls.select(host_of("url").alias("host")).filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    place = F.struct(
        (-F.length(F.concat("rule_host", "rule_path"))).alias("length"),
        F.when(F.col("verdict") == "allow", 0).otherwise(1).alias("after"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_path").alias("path"), F.col("verdict").alias("verdict"),
    )
    placed = rules.dropDuplicates().select(lower_ascii("rule_host").alias("domain"), place.alias("rule"))
    in_domains = hosts.select("host", F.explode(domains).alias("domain"))
    fitting = in_domains.join(broadcast_if_small(placed), "domain")
    return fitting.groupBy("host").agg(F.sort_array(F.collect_list("rule")).alias("rules"))


def judged(urls: DataFrame, by_host: DataFrame) -> DataFrame:
    """``urls`` with host, path and the deciding rule as a struct, null where none fits."""
    parted = urls.withColumns({"host": host_of("url"), "path": path_of("url")})
    fits = F.filter("rules", lambda r: F.col("path").startswith(r["path"]))
    joined = parted.join(by_host, "host", "left").withColumn("fits", fits)
    return joined.withColumn("decided", F.get("fits", F.lit(0))).drop("rules", "fits")


def links(pages: DataFrame) -> DataFrame:
    """(url, target): the absolute targets of each page's canonical links and refresh tags."""
    linked = pages.filter(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|refresh"))
    tags = linked.select("url", F.explode(F.regexp_extract_all("html", F.lit(TAGS), F.lit(0))).alias("tag"))
    tags = tags.filter(F.col("tag").rlike("(?i)^<(?:link|meta)"))
    inner = F.regexp_replace("tag", r"(?i)^<(?:link|meta)|>$", "")
    group = [F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(i)) for i in (1, 2, 3, 4)]
    read = tags.select(
        "url", F.lower(F.substring("tag", 2, 4)).alias("kind"),
        F.transform(group[0], F.lower).alias("names"),
        F.transform(F.arrays_zip(*[g.alias(f"v{i}") for i, g in enumerate(group[1:])]),
                    lambda v: F.concat(v["v0"], v["v1"], v["v2"])).alias("values"),
    )

    def attribute(name: str) -> Column:
        at = F.array_position("names", name)
        return F.replace(F.when(at > 0, F.element_at("values", at.cast("int"))), F.lit("&amp;"), F.lit("&"))

    canonical = (F.col("kind") == "link") & F.array_contains(
        F.split(F.lower(attribute("rel")), r"\s+"), "canonical"
    )
    refresh = (F.col("kind") == "meta") & (F.lower(F.trim(attribute("http-equiv"))) == "refresh")
    target = F.when(canonical, attribute("href")).when(refresh, F.regexp_extract(attribute("content"), REFRESH, 1))
    named = read.select("url", F.trim(target).alias("target")).filter("target <> ''")
    return named.select("url", absolute("target", "url").alias("target")).filter("target IS NOT NULL")


def absolute(target: str, url: str) -> Column:
    """``target`` as seen from the page ``url``; null where it is the page itself or no web link."""
    link, base = F.col(target), F.col(url)
    scheme, origin = F.regexp_extract(base, "^(.*?)://", 1), F.regexp_extract(base, "^.*?://[^/?#]*", 0)
    path = F.when(path_of(base) == "", "/").otherwise(path_of(base))
    folder = F.regexp_extract(path, "^(?s)(.*/)", 1)
    place = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(link.rlike("(?i)^https?://"), link))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, path, link))
        .when(~link.startswith("#"), F.concat(origin, folder, link))
    )
    return F.when(place.rlike(r"/\.\.?(?:[/?#]|$)"), _without_dots(place)).otherwise(place)


def _without_dots(place: Column) -> Column:
    """The url with ``.`` and ``..`` taken out of its path."""
    start = F.regexp_extract(place, "^.*?://[^/?#]*", 0)
    path, rest = path_of(place), F.regexp_extract(place, r"(?s)://[^?#]*(.*)$", 1)
    parts = F.slice(F.split(path, "/"), 2, 1 << 30)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(part == ".", done).otherwise(F.array_append(done, part)),
    )
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    return F.concat(start, F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, ends).otherwise(""), rest)


def blocked_nodes(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(node): nodes in a component with a member that a rule blocks and none that one allows."""
    ends = edges.select("url").unionByName(edges.select(F.col("target").alias("url"))).distinct()
    verdicts = judged(ends, written(host_rules(ends, rules), "edge-hosts"))
    known = verdicts.groupBy(node_of("url").alias("node")).agg(
        *[F.max(F.col("decided.verdict") == v).alias(v) for v in ("allow", "block")]
    )
    pairs = edges.select(node_of("url").alias("a"), node_of("target").alias("b"))
    roots = written(components(pairs.filter("a IS NOT NULL AND b IS NOT NULL"), even=True), "aliases")
    told = roots.join(written(known, "edge-verdicts"), "node")
    per_root = told.groupBy("root").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    wrong = per_root.filter("block AND NOT coalesce(allow, false)").select("root")
    return roots.join(written(wrong, "blocked-aliases"), "root").select("node")


def verdicts(pages: DataFrame, rules: DataFrame, further: DataFrame | None = None) -> DataFrame:
    """Every page with host, path, the rule that fits its url, the verdict and what it comes from.

    ``further`` may hold more edges (url, target), such as a log of redirects.
    """
    edges = links(pages) if further is None else links(pages).unionByName(further.select("url", "target"))
    edges = written(edges.filter("url IS NOT NULL AND target IS NOT NULL").distinct(), "url-edges")
    urls = pages.select("page_id", "url")
    by_host = written(host_rules(urls, rules), "url-hosts")
    found = judged(urls, by_host).withColumn("node", node_of("url"))
    if edges.isEmpty():
        told = found.withColumn("alias_blocked", F.lit(False))
    else:
        wrong = written(blocked_nodes(edges, rules), "blocked-nodes")
        told = found.join(wrong.withColumn("alias_blocked", F.lit(True)), "node", "left")
    by_alias = F.coalesce("alias_blocked", F.lit(False))
    return told.select(
        "page_id", "host", "path", F.col("decided.rule").alias("rule"),
        F.coalesce("decided.verdict", F.when(by_alias, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("decided").isNotNull(), "rule").when(by_alias, "alias").otherwise("none").alias("decided_by"),
    )


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "pages"), rule_table(spark))
