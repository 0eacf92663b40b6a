"""URL rules, with decisions carried along redirects and canonical links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local, small, table
from .graph import connected_components

#: (host, path prefix, action)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
TO = r"(?is)\burl\s*=\s*['\"]?([^\"'\s>]+)"
TRACKING = r"(^|&)(utm_[a-z]+|ref)=[^&]*"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column, tracking: str = TRACKING) -> Column:
    """One name for spellings of an address: no scheme, fragment, ``tracking`` parts of the query or closing slash; null
    without a host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, tracking, ""), "^&", "") if tracking else query
    name = F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host_of(url) != "", name)


def _plain(path: Column) -> Column:
    """A path without its ``.`` and ``..`` steps."""
    steps = F.split(F.regexp_replace(path, r"(^|/)(\.\.?)$", "$1$2/"), "/")
    walked = F.aggregate(
        F.slice(steps, 2, F.size(steps)),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def _target(link: Column, url: Column) -> Column:
    """A link's absolute url, seen from its page; null for an empty one or one of another scheme, and without a host."""
    path, rest = F.regexp_extract(link, r"(?s)^[^?#]*", 0), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(url), r"(?s)^/(.*/)?", 1))
    own = F.when(rest.startswith("#"), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)).otherwise("")
    there = F.when(path.startswith("/"), _plain(path)).when(path == "", F.concat(path_of(url), own)).otherwise(_plain(F.concat(folder, path)))
    return (
        F.when(link.rlike("(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when((link != "") & ~link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & (host_of(url) != ""), F.concat(F.lit("http://"), host_of(url), there, rest))
    )


def _ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (row, host, path) with the longest rule that fits: columns row, rule, action; only rows with one.

    A host meets the rules through each of its suffixes, an equi-join, so the rule list may be of any size.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = urls.where("host <> ''").select("row", "path", F.explode(suffixes).alias("rule_host"))
    fits = each.join(small(rules), "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = F.max(F.struct(F.length("rule"), (F.col("action") == "allow").alias("allow"), "rule", "action"))
    return fits.groupBy("row").agg(best.alias("b")).select("row", "b.rule", "b.action")


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] | DataFrame = RULES, redirects: DataFrame | None = None, tracking: str = TRACKING) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, component.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins (allow on a tie),
    and decides for its page. Spellings of one address, canonical links and refresh redirects in ``html``, and pairs
    (from_url, to_url) of ``redirects`` make addresses equivalent; classes are connected components of these links.
    Tags may be written in either case, and targets are resolved against their page.
    A page that no rule fits is blocked if a rule blocks any address of its class, unless a rule allows one: an
    explicit allow takes precedence. Others are allowed. Link targets that are no pages themselves count as
    addresses. A null url or one without ``://`` has an empty host and path, no class and is allowed; null html has
    no links; repeated rows are judged each; an empty table gives no rows; other columns of ``pages``, whatever their
    names, play no part; html is read whole. ``component`` is the least address of the class, null without a host.
    ``tracking`` is the pattern of query parts that leave an address what it is; none where it is empty.
    """
    spark = pages.sparkSession
    named = lambda u: address(u, tracking)
    if not isinstance(rules, DataFrame):
        rules = local(spark, [tuple(r) for r in rules], rule_host=pa.string(), rule_path=pa.string(), action=pa.string())
    rules = rules.select("rule_host", "rule_path", "action", F.concat("rule_host", "rule_path").alias("rule"))
    url = F.col("url")
    link = lambda tag, at: F.regexp_extract(F.regexp_extract("html", tag, 0), at, 1)
    of = pages.select("page_id", url, F.coalesce("html", F.lit("")).alias("html"))
    rows = of.select("page_id", "url", link(LINK, HREF).alias("canonical"), link(META, TO).alias("refresh")).select(
        F.monotonically_increasing_id().alias("row"), "page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), named(url).alias("address"),
        _target(F.col("canonical"), url).alias("canonical"), _target(F.col("refresh"), url).alias("refresh"),
    )
    rows = table(rows, "pages")
    ruled = table(rows.select("row", "page_id", "host", "path", "address").join(_ruled(rows, rules), "row", "left"), "ruled")

    links = rows.select("url", F.explode(F.array_compact(F.array("canonical", "refresh"))).alias("to"))
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("from_url").alias("url"), F.col("to_url").alias("to")))
    links = table(links.where("url is not null and to is not null"), "links")
    classes = connected_components(links.select(named(url).alias("a"), named(F.col("to")).alias("b")))
    ends = links.select(F.explode(F.array("url", "to")).alias("url")).distinct()
    ends = ends.select(F.monotonically_increasing_id().alias("row"), host_of(url).alias("host"), path_of(url).alias("path"), named(url).alias("address"))
    ends = table(ends, "ends")
    judged = ruled.select("address", "action").unionByName(ends.join(_ruled(ends, rules), "row").select("address", "action")).where("action is not null")
    by_address = judged.groupBy("address").agg(F.max(F.col("action") == "allow").alias("allows"), F.max(F.col("action") == "block").alias("blocks"))
    classed = classes.select(F.col("node").alias("address"), "component")
    of_class = by_address.join(classed, "address", "left").groupBy(F.coalesce("component", "address").alias("component"))
    of_class = of_class.agg((F.max("blocks") & ~F.max("allows")).alias("blocked")).where("blocked").select("component", F.lit(True).alias("blocked"))
    out = ruled.join(classed, "address", "left").withColumn("component", F.coalesce("component", "address")).join(of_class, "component", "left")
    verdict = F.coalesce("action", F.when(F.col("blocked"), F.lit("block")).otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages under the query's rules, with the classes that their own links and spellings make."""
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    host = lambda u: f"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    path = lambda u: f"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    query = lambda u: f"regexp_replace(regexp_replace(regexp_extract({u}, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '{TRACKING}', '', 'g'), '^&', '')"
    name = lambda u: f"CASE WHEN {host(u)} <> '' THEN {host(u)} || regexp_replace({path(u)}, '/$', '') || CASE WHEN {query(u)} <> '' THEN '?' || {query(u)} ELSE '' END END"
    q = lambda s: s.replace("'", "''")
    link = lambda mark, tag, at: f"CASE WHEN contains(lower(html), '{mark}') THEN regexp_extract(regexp_extract(html, '{q(tag)}', 0), '{q(at)}', 1) END"
    steps = lambda x: f"string_split(regexp_replace({x}, '(^|/)(\\.\\.?)$', '\\1\\2/'), '/')[2:]"
    walked = lambda x: f"list_reduce({steps(x)}, lambda done, s: CASE s WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || s END, '')"
    plain = lambda x: f"coalesce(nullif({walked(x)}, ''), '/')"
    to, rest = (lambda x: f"regexp_extract({x}, '(?s)^[^?#]*', 0)"), (lambda x: f"regexp_extract({x}, '(?s)^[^?#]*(.*)$', 1)")
    own = lambda x: f"CASE WHEN starts_with({rest(x)}, '#') THEN regexp_extract(url, '(?s)^.*?://[^?#]*(\\?[^#]*)?', 1) ELSE '' END"
    folder = "'/' || regexp_extract(path, '(?s)^/(.*/)?', 1)"
    there = lambda x: f"CASE WHEN starts_with({to(x)}, '/') THEN {plain(to(x))} WHEN {to(x)} = '' THEN path || {own(x)} ELSE {plain(f'{folder} || {to(x)}')} END"
    target = lambda x: (
        f"CASE WHEN regexp_matches({x}, '(?i)^https?://') THEN {x} WHEN starts_with({x}, '//') THEN 'http:' || {x}"
        f" WHEN {x} <> '' AND NOT regexp_matches({x}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') AND host <> '' THEN 'http://' || host || {there(x)} || {rest(x)} END"
    )
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
    return f"""
WITH RECURSIVE rules(rh, rp, action) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS r, page_id, url, coalesce({host("url")}, '') AS host, coalesce({path("url")}, '') AS path, {name("url")} AS address,
  {link("canonical", LINK, HREF)} AS can, {link("refresh", META, TO)} AS ref FROM pages),
links AS (SELECT url, t FROM (SELECT url, {target("can")} AS t FROM p UNION ALL SELECT url, {target("ref")} AS t FROM p) WHERE url IS NOT NULL AND t IS NOT NULL),
urls AS (SELECT r, host, path, address FROM p UNION ALL SELECT -row_number() OVER () AS r, {host("u")}, {path("u")}, {name("u")} FROM (SELECT url AS u FROM links UNION SELECT t FROM links)),
fits AS (SELECT r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action FROM urls JOIN rules
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r),
e AS (SELECT {name("url")} AS a, {name("t")} AS b FROM links UNION SELECT {name("t")}, {name("url")} FROM links),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
comp AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
cls AS (SELECT coalesce(c, address) AS c FROM urls JOIN fits USING (r) LEFT JOIN comp ON address = a GROUP BY 1 HAVING bool_or(action = 'block') AND NOT bool_or(action = 'allow'))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN cls.c IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, coalesce(comp.c, address) AS component
FROM p LEFT JOIN fits USING (r) LEFT JOIN comp ON address = a LEFT JOIN cls ON cls.c = coalesce(comp.c, address)
"""


QUERIES = {"op7_url_filter": op7_url_filter}
SQL = {"op7_url_filter": _sql()}
