"""URL filters with DataFrame functions only: rules by host and path, and redirect equivalence.

A rule holds for a host and its subdomains if the path starts with the rule's path; of several the longest wins. Pages without
a rule of their own take the decision of their aliases: URLs that are connected by redirects (a table of edges, or a page's
refresh) and by canonical links. Components are found by distributed rounds. In a component an explicit allow of any alias goes
before a block of any alias; without either the verdict is allow. Links count as in a browser: in the head, outside comments,
scripts, styles, templates and the like; a tag ends at its first >.

A URL is the same with scheme and host in any case, with or without a fragment, and with / for an empty path; no other forms are
taken as equal. Edges for other ways of writing (www. or m., trailing slash, tracking parameters) are made by ``writing_edges``
for callers who want them.

Defined cases: null URLs and URLs without :// have an empty host and path, fit no rule, are no alias of anything, and are
allowed; null html has no links; very long pages are searched as a whole; ids may be null or repeated, rows stay rows; equally
long rules go by their text; other columns are ignored; an empty table gives no rows. Rules are compiled into the plan; more than
MAX_RULES are refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

MAX_RULES = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that say where a visitor came from. Fixed values.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|mc_cid|mc_eid)"


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def parsed(url: Column) -> Column:
    """Struct of host, path and node: the URL in the form in which equal ones agree, null without a host."""

    def parts(rest: Column) -> Column:
        host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
        return F.struct(host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1).alias("query"))

    def form(p: Column) -> Column:
        scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
        node = F.concat(scheme, F.lit("://"), p["host"], F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]), p["query"])
        return F.struct(p["host"].alias("host"), p["path"].alias("path"), F.when(p["host"] != "", node).alias("node"))

    return _let(_let(_rest(url), parts), form)


def writing_edges(urls: DataFrame) -> DataFrame:
    """(src, dst): from each URL (column url) to a form without scheme, www. or m., index page, trailing slash and tracking parameters."""
    at = parsed(F.col("url"))
    query = F.split(F.regexp_extract(at["node"], r"^[^?]*\?(.*)", 1), "&")
    kept = F.array_join(F.filter(query, lambda p: (p != "") & ~p.rlike(rf"^{TRACKING}=")), "&")
    path = F.regexp_replace(at["path"], r"(?:/index\.html?)?/*$", "")
    form = F.concat(F.lit("form://"), F.regexp_replace(at["host"], r"^(?:www|m)\.", ""), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return urls.select(F.col("url").alias("src"), F.when(at["node"].isNotNull(), form).alias("dst")).where("dst IS NOT NULL")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct of the text and verdict of the longest rule that fits (of equal ones the first by text), else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are compiled")
    out: Column | None = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        hit = F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<text:string,verdict:string>")


def _resolved(link: Column, url: Column) -> Column:
    """An absolute URL of a link on the page ``url``."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    at = parsed(url)
    base = F.concat(scheme, F.lit("://"), at["host"])
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    return (
        F.when(F.instr(link, "://") > 0, link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(base, link))
        .when(link != "", F.concat(base, F.regexp_extract(at["path"], r"^(.*/)?", 0), link))
    )


#: What a browser takes no link from: comments, and elements whose content is no markup of the page. Fixed values.
INERT = ("script", "style", "template", "noscript", "title", "textarea")
#: Without an end, each reaches to the end of the page.
_HIDDEN = "|".join(["<!--(?:.*?-->|.*)", *(rf"<{name}\b(?:.*?</{name}\s*>|.*)" for name in INERT)])
_TAG = r"<(?:link|meta)\b[^>]*>"
_PAIR = r"""[^\s"'>/=]{1,64}\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""


def _attribute(pairs: Column, name: str) -> Column:
    """The value of the first attribute of that name, else null."""
    mine = F.get(F.filter(pairs, lambda p: p.rlike(rf"(?is)^{name}\s*=")), F.lit(0))
    return F.regexp_replace(F.regexp_replace(mine, r"^[^=]*=\s*", ""), r"""^["']|["']$""", "")


def link_edges(pages: DataFrame) -> DataFrame:
    """(url, target): pages, and what the canonical links and refreshes of their heads lead to."""
    some = pages.where(F.col("html").rlike("(?i)canonical|refresh"))
    head = F.regexp_replace(F.regexp_replace("html", rf"(?is){_HIDDEN}", " "), r"(?is)(?:</head\s*>|<body\b).*", "")
    tags = F.explode(F.regexp_extract_all(head, F.lit(rf"(?is){_TAG}"), F.lit(0))).alias("tag")
    x = some.select("url", tags).select("url", "tag", F.regexp_extract_all("tag", F.lit(_PAIR), F.lit(0)).alias("pairs"))
    pairs, is_link = F.col("pairs"), F.col("tag").rlike(r"(?i)^<link")
    rel = F.split(F.lower(_attribute(pairs, "rel")), r"\s+")
    canonical = F.when(is_link & F.array_contains(rel, "canonical"), _attribute(pairs, "href"))
    refresh = F.when(~is_link & (F.lower(F.trim(_attribute(pairs, "http-equiv"))) == "refresh"), F.regexp_extract(_attribute(pairs, "content"), r"""(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["']?([^"']+)""", 1))
    link = F.coalesce(canonical, refresh)
    return x.select("url", link.alias("link")).where("link <> ''").select("url", _resolved(F.col("link"), F.col("url")).alias("target"))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row. redirects: further edges (src, dst) of URLs. URLs that are only linked to count
    with the rules that fit them."""
    links = link_edges(pages)
    if redirects is not None:
        links = links.union(redirects.select("src", "dst"))
    ruled = lambda url: _let(parsed(url), lambda p: F.struct(p.alias("at"), rule_of(p["host"], p["path"], rules).alias("r")))
    edges = links.select(ruled(F.col("url")).alias("x"), ruled(F.col("target")).alias("y"))
    comps = components(edges.select(F.col("x.at.node").alias("a"), F.col("y.at.node").alias("b"))).withColumnRenamed("node", "url_node")
    rows = pages.select("page_id", ruled(F.col("url")).alias("x")).select("page_id", "x.at.host", "x.at.path", "x.at.node", "x.r")
    # only URLs that are in a component can give or take a decision
    decided = edges.select("x.at.node", "x.r").union(edges.select("y.at.node", "y.r"))
    explicit = decided.where("r IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(F.max(F.col("r.verdict") == "allow").alias("allow"))
    by_comp = explicit.join(comps, F.col("node") == F.col("url_node")).groupBy("component").agg(F.max("allow").alias("allow"))
    inherited = by_comp.select("component", F.when(F.col("allow"), "allow").otherwise("block").alias("inherited"))
    taken = comps.join(inherited, "component").select("url_node", "inherited")
    ask = F.when(F.col("r").isNull(), F.col("node"))  # null for rows that have a rule: they ask nobody
    out = rows.withColumn("ask", ask).join(taken, F.col("ask") == F.col("url_node"), "left")
    return out.select("page_id", "host", "path", F.col("r.text").alias("rule"), F.coalesce("r.verdict", "inherited", F.lit("allow")).alias("verdict"))


def query(pages: DataFrame) -> DataFrame:
    return judged(pages.select("page_id", "url", "html"))


def _sql_rest(u: str) -> str:
    return f"CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"


def _sql_host(u: str) -> str:
    return f"translate(regexp_extract({_sql_rest(u)}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"


def _sql_path(u: str) -> str:
    return f"regexp_extract({_sql_rest(u)}, '^[^/?#]*([^?#]*)', 1)"


def _sql_node(u: str) -> str:
    scheme = f"translate(split_part({u}, '://', 1), '{UPPER}', '{LOWER}')"
    path = f"CASE WHEN {_sql_path(u)} = '' THEN '/' ELSE {_sql_path(u)} END"
    return rf"CASE WHEN {_sql_host(u)} <> '' THEN {scheme} || '://' || {_sql_host(u)} || {path} || regexp_extract({_sql_rest(u)}, '^[^?#]*(\?[^#]*)', 1) END"


def _sql_attribute(name: str) -> str:
    mine = rf"list_filter(pairs, lambda p: regexp_matches(p, '(?is)^{name}\s*='))[1]"
    return rf"""regexp_replace(regexp_replace({mine}, '^[^=]*=\s*', ''), '^["'']|["'']$', '', 'g')"""


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """Rules, and components by repeated minima over the edges of canonical links and refreshes in heads."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, what)}'" for r in ordered) + " END"
    quoted = lambda pattern: pattern.replace("'", "''")
    base = f"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) || '://' || {_sql_host('url')}"
    absolute = f"""CASE WHEN strpos(link, '://') > 0 THEN link WHEN starts_with(link, '//') THEN split_part(url, '://', 1) || ':' || link
      WHEN starts_with(link, '/') THEN {base} || link ELSE {base} || regexp_extract({_sql_path('url')}, '^(.*/)?') || link END"""
    return rf"""
WITH RECURSIVE p AS (
  SELECT page_id, {_sql_host('url')} AS host, {_sql_path('url')} AS path, {_sql_node('url')} AS node FROM pages
), r AS (
  SELECT *, {case('text')} AS rule, {case('verdict')} AS own FROM p
), h AS (
  SELECT url, regexp_replace(regexp_replace(html, '(?is){quoted(_HIDDEN)}', ' ', 'g'), '(?is)(?:</head\s*>|<body\b).*', '') AS head FROM pages WHERE regexp_matches(html, '(?i)canonical|refresh')
), g AS (
  SELECT url, tag, regexp_extract_all(tag, '{quoted(_PAIR)}') AS pairs FROM (SELECT url, unnest(regexp_extract_all(head, '(?is){quoted(_TAG)}')) AS tag FROM h)
), k AS (
  SELECT url, replace(CASE WHEN regexp_matches(tag, '(?i)^<link') THEN CASE WHEN list_contains(regexp_split_to_array(lower({_sql_attribute('rel')}), '\s+'), 'canonical') THEN {_sql_attribute('href')} END
    WHEN lower(trim({_sql_attribute('http-equiv')})) = 'refresh' THEN regexp_extract({_sql_attribute('content')}, '(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["'']?([^"'']+)', 1) END, '&amp;', '&') AS link FROM g
), t AS (
  SELECT url, {absolute} AS target FROM (SELECT url, trim(link) AS link FROM k) WHERE link <> ''
), e AS (
  SELECT DISTINCT {_sql_node('url')} AS a, {_sql_node('target')} AS b FROM t
), q AS (
  SELECT node, own FROM r UNION ALL SELECT node, {case('verdict')} FROM (SELECT {_sql_host('target')} AS host, {_sql_path('target')} AS path, {_sql_node('target')} AS node FROM t)
), b AS (
  SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL
), reach AS (
  SELECT a AS node, a AS other FROM b UNION SELECT reach.node, b.b FROM reach JOIN b ON reach.other = b.a
), comp AS (
  SELECT node, min(other) AS component FROM reach GROUP BY node
), d AS (
  SELECT component, bool_or(own = 'allow') AS allow FROM q JOIN comp USING (node) WHERE own IS NOT NULL GROUP BY 1
)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN d.allow THEN 'allow' WHEN NOT d.allow THEN 'block' END, 'allow') AS verdict
FROM r LEFT JOIN comp USING (node) LEFT JOIN d USING (component)
"""
