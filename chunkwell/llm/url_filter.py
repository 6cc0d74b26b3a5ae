"""Operator 4: URL filters with redirect equivalence.

URLs that redirect to one another (``<meta http-equiv="refresh">``), name one another as
canonical (``<link rel="canonical">``), or are the ends of a given edge table are aliases: the
connected components over these links.  A rule ``host/path`` fits a URL whose host is the rule's
or below it and whose path starts with the rule's; of the rules that fit, the longest decides.
A page without a fitting rule takes the decision of its component: blocked if an alias is blocked
by a rule and none is explicitly allowed (an explicit allow takes precedence), else the default.
A page's own rule always takes precedence over its aliases.

A URL's node is its host and path with query, without scheme and fragment.  Only pages that name
a canonical link or a redirect are parsed, and only they and their aliases enter the components.

Cases: a null URL, or one without ``://``, has an empty host and path and fits no rule.  Null or
empty HTML has no links; a link to itself, an unreadable or empty target is no link.  Repeated
pages are judged alike.  Rules of equal length that fit the same URL: allow wins.  An empty table
gives an empty result.  Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwell.llm.common import components, map_texts

ALLOW, BLOCK = "allow", "block"
RULES = (("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK), ("com/fr/", ALLOW), ("com/de/", BLOCK))


#: Host, path and query of a URL: after the first ``://``, up to the first of ``/ ? #``, and so on.
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def node_of(url: Column) -> Column:
    """The node of a URL: host, path and query; null without a host."""
    node = F.concat(host_of(url), F.regexp_replace(path_of(url), "^$", "/"), F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 3))
    return F.when(url.rlike(r"(?s)^.*?://[^/?#]"), node)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    # later entries override: shortest first, at equal length the allowing rule last
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[1] == ALLOW)):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for r, verdict in rules:
        out = F.when(rule == r, F.lit(verdict)).otherwise(out)
    return out


_COMMENT = re.compile(r"<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)", re.I | re.S)
_TAG = re.compile(r"<(link|meta)\b[^>]*>", re.I)
_ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_REFRESH = re.compile(r"url\s*=\s*(.*)$", re.I | re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def node(url: str) -> str | None:
    """:func:`node_of` for one URL."""
    rest = url.partition("://")[2].partition("#")[0]
    m = re.match(r"([^/?]*)([^?]*)(.*)", rest, re.S)
    return f"{m[1].translate(_LOWER)}{m[2] or '/'}{m[3]}" if m[1] else None


def targets(html: str) -> list[str]:
    """Where the canonical links and redirects of a page point, as they stand in it; comments and scripts are no tags."""
    found = []
    for m in _TAG.finditer(_COMMENT.sub("", html)):
        at = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[0])}
        if m[1].lower() == "link" and "canonical" in at.get("rel", "").lower().split():
            found.append(at.get("href", ""))
        elif m[1].lower() == "meta" and at.get("http-equiv", "").lower() == "refresh" and (r := _REFRESH.search(at.get("content", ""))):
            found.append(r[1])
    return [unescape(t).strip().strip("\"'").strip() for t in found]


def _links(urls, pages):
    left, right = [], []
    for url, html in zip(urls, pages, strict=True):
        own = node(url)
        for t in targets(html):
            try:
                other = node(urljoin(url, t)) if t else None
            except ValueError:  # an unreadable target is no link
                other = None
            if own and other and own != other:
                left.append(own)
                right.append(other)
    return left, right


def page_links(pages: DataFrame) -> DataFrame:
    """``a, b``: nodes that a page's canonical link or redirect makes aliases."""
    linked = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv") & F.col("url").contains("://"))
    return map_texts(linked, ["url", "html"], _links, "a string, b string")


def judge(pages: DataFrame, rules=RULES, edges: DataFrame | None = None, default: str = ALLOW) -> DataFrame:
    """``page_id, host, path, rule, verdict, by_alias`` of every row of ``pages``.

    ``edges`` (``a``, ``b``: URLs) adds redirects known from elsewhere, such as a crawl log.
    """
    links = page_links(pages)
    if edges is not None:
        links = links.unionByName(edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")))
    found = components(links, "url-cc")
    parts = found.withColumn("host", F.regexp_extract("node", r"(?s)^([^/]*)", 1)).withColumn("path", F.regexp_extract("node", r"(?s)^[^/]*([^?]*)", 1))
    decided = parts.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("verdict", verdict_of(F.col("rule"), rules))
    by_component = decided.groupBy("component").agg(F.max((F.col("verdict") == BLOCK)).alias("blocked"), F.max(F.col("verdict") == ALLOW).alias("allowed"))
    blocked = by_component.where(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).select(F.col("component").alias("c2"))
    aliases = found.join(blocked, F.col("component") == F.col("c2")).select(F.col("node").alias("alias"))
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    # pages without a node must not all meet in the join's task for nulls
    key = F.coalesce("node", F.concat(F.lit("\0"), F.xxhash64("page_id", "host").cast("string")))
    rows = rows.join(aliases, key == F.col("alias"), "left")
    own, by_alias = verdict_of(F.col("rule"), rules), F.col("rule").isNull() & F.col("alias").isNotNull()
    return rows.select("page_id", "host", "path", "rule", F.when(own.isNotNull(), own).when(by_alias, BLOCK).otherwise(default).alias("verdict"), by_alias.alias("by_alias"))
