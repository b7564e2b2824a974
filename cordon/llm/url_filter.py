"""URL filters with redirect equivalence, in DataFrame functions only.

A rule names a host, with all its subdomains, and a path prefix; of the rules that fit a url the
longest wins. Pages are linked with the urls that they redirect to (meta refresh) or call canonical;
connected components over these links are one address under several names. A url that no rule fits
takes the block of any other name of its component; a url that a rule allows stays allowed.

A name is the url without scheme and fragment: host, path and query, since one path may serve as many
addresses as it has queries; rules look at host and path only. Nulls: a null url, or one without
`://`, has an empty host and path, fits no rule, is linked with nothing and is allowed; a null html has
no links. Empty tables give empty results; repeated rows are judged alike; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

#: (host, path, verdict); an empty path fits every path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(url: Column) -> Column:
    """Host, path and query; `/` stands for an empty path."""
    path, query = path_of(url), F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*((?:\?[^#]*)?)", 1), F.lit(""))
    return F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(path), query)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; null if none does. Of rules equally long the longer host wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def targets_of(html: Column) -> Column:
    """Urls that a page redirects to or calls canonical, as written."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"))
    href = lambda tag: F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = lambda tag: F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*[\"']?\s*[\d.]*\s*[;,]\s*url\s*=\s*[\"']?([^\"'\s>]+)", 1)
    found = F.transform(tags, lambda t: F.when(t.rlike(r"(?is)^<link.*\brel\s*=\s*[\"']?(?:[\w-]+\s+)*canonical\b"), href(t)).when(t.rlike(r"(?is)^<meta.*\bhttp-equiv\s*=\s*[\"']?refresh\b"), refresh(t)))
    return F.when(html.rlike(r"(?i)canonical|refresh"), F.filter(found, lambda x: x.isNotNull() & (x != ""))).otherwise(F.array().cast("array<string>"))


def resolved(target: Column, host: Column, path: Column) -> Column:
    """An absolute url for a target as written on a page of this host and path."""
    folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), r"[^/]*$", "")
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(F.lit("http:"), target)).when(target.startswith("/"), F.concat(F.lit("http://"), host, target)).otherwise(F.concat(F.lit("http://"), host, folder, target))


def judge(pages: DataFrame, url: str = "url", html: str = "html", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule and verdict (columns of these names are replaced; all others stay, whatever their names)."""
    names = {c: f"c_{i}" for i, c in enumerate(pages.columns)}
    rows = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    url_, html_ = F.col(names[url]), F.col(names[html])
    rows = rows.withColumns({"_host": host_of(url_), "_path": path_of(url_)}).withColumn("_name", F.when(F.col("_host") != "", name_of(url_)))
    links = rows.where("_name is not null").select(F.col("_name").alias("a"), F.explode(F.transform(targets_of(html_), lambda t: resolved(t, F.col("_host"), F.col("_path")))).alias("t"))
    members = components(links.where(host_of(F.col("t")) != "").select("a", name_of(F.col("t")).alias("b")))
    parts = F.split(F.col("node"), "/", 2)
    node_rule = rule_for(parts[0], F.concat(F.lit("/"), F.regexp_extract(parts[1], r"^[^?]*", 0)), rules)[1]
    blocked = members.where(node_rule == "block").select("component").distinct()
    # Names that no rule fits and whose component has a block: only they change, so pages without links just pass.
    caught = members.where(node_rule.isNull()).join(blocked, "component", "left_semi").select(F.col("node").alias("_caught"))
    rule, verdict = rule_for(F.col("_host"), F.col("_path"), rules)
    # Pages that cannot be caught get keys of their own, which no name equals, so that they don't meet in one task.
    alone = F.concat(F.lit("/"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumns({"_rule": rule, "_verdict": verdict}).withColumn("_key", F.when(F.col("_name").isNotNull() & F.col("_verdict").isNull(), F.col("_name")).otherwise(alone))
    rows = rows.join(caught, F.col("_key") == F.col("_caught"), "left")
    final = F.coalesce("_verdict", F.when(F.col("_caught").isNotNull(), "block"), F.lit("allow"))
    kept = [F.col(n).alias(c) for c, n in names.items() if c.lower() not in ("host", "path", "rule", "verdict")]
    return rows.select(*kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), final.alias("verdict"))
