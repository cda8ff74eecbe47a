"""URL decisions: rules by host and path, carried over to redirect and canonical aliases.

A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting
rule is the page's own verdict. Pages without one take the verdict of their aliases: the connected
component over (a) every redirect target (meta refresh) and (b) every canonical link that a page
names outside comments, read as a browser does (character references, and relative to the page's
``base`` or own URL), and (c) the URL's canonical spelling (scheme, ``www.`` or ``m.``, a closing
``/`` or ``.html`` and the fragment do not tell pages apart; the query does). The rules hold for
link targets too, whether the table has them as pages or not. In a component an explicit allow goes
before any block; without either the page is allowed.

Null URLs, and those without ``://``, have empty host and path, no rule and no alias: allowed.
Null html names no alias. Repeated rows and ids are judged each. Extra columns are ignored.
"""

from __future__ import annotations

import html as markup
import re
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import written
from foliograph.llm.components import components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


#: The rules of the query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _part_of(url: Column, part: int) -> Column:
    """Host (1), path (2) or query with its question mark (3). No group can fail, so the first ``://`` counts."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)((?:\?[^#]*)?)", part)


def host_of(url: Column) -> Column:
    return F.translate(_part_of(url, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return _part_of(url, 2)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host, r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def spelling(url: Column) -> Column:
    """The canonical spelling of a URL, a node beside the URLs themselves; null without ``://``."""
    host = F.regexp_replace(host_of(url), r"^(www\.|m\.)+", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(\.html?|/)$", ""), r"/+", "/")
    return F.when(F.coalesce(url, F.lit("")).contains("://") & (host != ""), F.concat(F.lit("//"), host, path, _part_of(url, 3)))


_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def resolved(target: str, url: str | None, base: str | None = None) -> str | None:
    """A link's target as an absolute URL; null if it cannot be one."""
    target = markup.unescape(target)
    if re.match(_ABSOLUTE, target):
        return target
    try:
        return urljoin(urljoin(url or "", markup.unescape(base or "")), target)
    except ValueError:
        return None


def _resolved(targets: pa.Array, url: pa.Array, base: pa.Array) -> pa.Array:
    rows = zip(targets.to_pylist(), url.to_pylist(), base.to_pylist(), strict=True)
    return pa.array([None if t is None else [resolved(x, u, b) for x in t] for t, u, b in rows], pa.list_(pa.string()))


_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""


def _named(html: Column, url: Column) -> Column:
    """The targets of all canonical links and refreshes in a page, absolute."""
    html = F.coalesce(html, F.lit(""))
    has = lambda word: html.rlike("(?i)" + word)
    linking = F.when(has("canonical") | has("http-equiv"), html)
    tags = F.regexp_extract_all(F.regexp_replace(linking, "(?s)<!--.*?(?:-->|$)", ""), F.lit(r"(?is)<(?:link|meta|base)\b[^>]*>"), F.lit(0))
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(r"""(?i)^<link\b.*\brel\s*=\s*(?:["'][^"']*\bcanonical\b|canonical\b)""")), lambda t: F.regexp_extract(t, _HREF, 1))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b""")), lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    base = F.regexp_extract(F.get(F.filter(tags, lambda t: t.rlike(r"(?i)^<base\b")), F.lit(0)), _HREF, 1)
    found = F.array_distinct(F.filter(F.concat(canonical, refresh), lambda x: x != ""))
    # Python sees only the targets that are not absolute as they stand.
    open_ = F.exists(found, lambda x: ~x.rlike(_ABSOLUTE) | x.contains("&"))
    read = F.arrow_udf(_resolved, "array<string>")
    return F.array_compact(F.coalesce(read(F.when(open_, found), F.when(open_, url), F.when(open_, base)), found, F.array().cast("array<string>")))


def decide(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict and component (its smallest spelling; null without alias)."""
    ruled = lambda x: rule_of(host_of(x), path_of(x), rules)
    aliases = F.transform("_named", lambda x: F.struct(spelling(x).alias("node"), ruled(x)["verdict"].alias("verdict")))
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), spelling(F.col(url)).alias("_node"), ruled(F.col(url)).alias("_own"), _named(F.col(html), F.col(url)).alias("_named"))
    rows = written(rows.withColumn("_named", F.filter(aliases, lambda x: x["node"].isNotNull())), "urls")
    links = rows.select(F.col("_node").alias("a"), F.explode("_named.node").alias("b")).where("a is not null and a <> b").distinct()
    joined = components(links, "a", "b", name="urls")
    rows = rows.join(joined.select(F.col("node").alias("_node"), "component"), "_node", "left").withColumn("component", F.coalesce("component", "_node"))
    # One row for each component with any rule, of its pages or of what they name; counted before it is dealt out.
    verdicts = F.concat(F.array("_own.verdict"), F.col("_named.verdict"))
    allows, blocks = F.array_contains(F.array_compact(verdicts), "allow"), F.array_contains(F.array_compact(verdicts), "block")
    said = rows.where("component is not null").where(allows | blocks).groupBy("component").agg(F.max(F.when(allows, 1).otherwise(0)).alias("_allow"))
    told = rows.join(said, "component", "left")
    verdict = F.coalesce(F.col("_own.verdict"), F.when(F.col("_allow") == 0, "block"), F.lit("allow"))
    return told.select("page_id", "host", "path", F.col("_own.rule").alias("rule"), verdict.alias("verdict"), "component")
