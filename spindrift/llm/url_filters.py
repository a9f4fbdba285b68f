"""URL filters by redirect equivalence.

Longest-prefix rules decide for the urls they fit.  Urls that no rule fits take the decision of
their alias class: the connected component of the graph whose edges are redirects and canonical
links.  In a class an explicit allow wins over any block.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import cut, lower_ascii, reading, release
from spindrift.llm.components import connected_components

#: (host and path as one string, action), the rules of the query.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """host, path, query.  Host: after the first :// up to / ? # or the end, A-Z lower-cased."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*+", 0))
    return host, F.regexp_extract(rest, "^[^/?#]*+([^?#]*+)", 1), F.regexp_extract(rest, "^[^?#]*+\\?([^#]*+)", 1)


def parse(df: DataFrame) -> DataFrame:
    """df(url) + host, path, node, normal.

    node: a url's identity in the graph, its host, path and query; scheme and fragment don't count.
    normal: the node it redirects to by convention, without www. or m., tracking query, .html, final slash.
    """
    host, path, query = split_url(F.col("url"))
    out = df.select("url", host.alias("host"), path.alias("path"), query.alias("query"))
    bare = F.regexp_replace(F.regexp_replace("path", "\\.html?$", ""), "(?<=.)/+$", "")
    kept = F.array_sort(F.filter(F.split("query", "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_[a-z]*|ref)=")))
    out = out.select("*", F.regexp_replace("host", "^(?:www|m)\\.", "").alias("near"), bare.alias("bare"), F.array_join(kept, "&").alias("kept"))
    node = lambda host, path, query: F.concat(F.col(host), F.coalesce(F.nullif(F.col(path), F.lit("")), F.lit("/")), F.when(F.col(query) == "", F.lit("")).otherwise(F.concat(F.lit("?"), F.col(query))))
    return out.select("url", "host", "path", node("host", "path", "query").alias("node"), node("near", "bare", "kept").alias("normal"))


#: One attribute after another from the start of a tag: name, and value in double quotes, single quotes or none.
_ATTRIBUTE = r"""\G[\s/]*+([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)?+))?+"""
#: Marks the content of a refresh among references.
_MOVED = "\x00"
#: The url of a refresh, after its delay, in quotes or none.
_REFRESH = r"""(?is)\s*+(?:[\d.]++(?:\s*+[;,]\s*+|\s++)(?:url\s*+=\s*+)?+|url\s*+=\s*+)(?:"(?P<a>[^"]*+).*|'(?P<b>[^']*+).*|(?P<c>[^"'].*+))"""


#: What a browser doesn't read as tags: comments and elements of raw text.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b[^>]*+>.*?(?:</\1(?=[\s/>])|\z)"


def resolved(url: Column, base: Column, to: Column) -> Column:
    """The absolute url of a reference `to` on page `url` with base reference `base`, by RFC 3986; null if it is none.

    Character references are replaced first; a name without ; counts as one only before what can't go on with it.
    """

    @F.pandas_udf("string")
    def run(urls: pd.Series, bases: pd.Series, targets: pd.Series) -> pd.Series:
        import html
        import re
        from html.entities import html5
        from urllib.parse import urljoin

        def one(m) -> str:
            s = m.group()
            return html.unescape(s) if s[1] == "#" or s[1:] in html5 else s

        rx = re.compile(r"&(?:#(?:[0-9]++|[xX][0-9a-fA-F]++);?|[A-Za-z][A-Za-z0-9]*+(?:;|(?!=)))")
        blank = re.compile("[\t\n\r]")
        plain = lambda v: blank.sub("", rx.sub(one, v)).strip()

        def join(url: str, base: str, to: str) -> str | None:
            to = plain(to)
            refresh = re.fullmatch(_REFRESH, to[1:]) if to[:1] == _MOVED else None
            if to[:1] == _MOVED:
                to = (refresh["a"] or refresh["b"] or refresh["c"] or "").strip() if refresh else ""
            if not to:
                return None
            try:
                return urljoin(urljoin(url, plain(base)) if base else url, to)
            except ValueError:
                return None

        return pd.Series([join(*x) for x in zip(urls, bases, targets, strict=True)], dtype=object)

    return run(url, base, to)


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target) of each page's canonical links and redirects of meta tags; relative targets are resolved.

    A tag is read attribute by attribute, whatever its length; a page is split at its link, meta and base tags, so each part is
    read once.  Comments, scripts and other raw text hold no tags.  Every canonical tag and every refresh counts.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    found = pages.where("url is not null").where(F.contains(F.lower(html), F.lit("canonical")) | F.contains(F.lower(html), F.lit("refresh")))
    pieces = F.split(F.regexp_replace(html, _HIDDEN, ""), r"(?i)<(?=(?:link|meta|base)[\s/])")
    pieces = F.filter(F.slice(pieces, 2, F.size(pieces)), lambda t: t.rlike("(?i)canonical|refresh|^base"))
    part = lambda t, i: F.regexp_extract_all(t, F.lit(_ATTRIBUTE), F.lit(i))
    # The first attribute is the tag's name.  Of the four lists each match has a place in every one.
    tags = F.transform(pieces, lambda t: F.arrays_zip(F.transform(part(t, 1), F.lower).alias("k"), part(t, 2).alias("a"), part(t, 3).alias("b"), part(t, 4).alias("c")))

    def value(tag: Column, name: str) -> Column:
        """The first attribute of that name counts."""
        x = F.get(F.filter(tag, lambda x: x["k"] == name), F.lit(0))
        return F.coalesce(F.concat(x["a"], x["b"], x["c"]), F.lit(""))

    kind = lambda tag: F.get(tag, F.lit(0))["k"]
    canonical = F.transform(F.filter("tags", lambda t: (kind(t) == "link") & F.array_contains(F.split(F.lower(value(t, "rel")), r"\s+"), "canonical")), lambda t: value(t, "href"))
    refresh = F.transform(F.filter("tags", lambda t: (kind(t) == "meta") & (F.lower(F.trim(value(t, "http-equiv"))) == "refresh")), lambda t: F.concat(F.lit(_MOVED), value(t, "content")))
    base = F.coalesce(F.get(F.filter(F.transform(F.filter("tags", lambda t: kind(t) == "base"), lambda t: value(t, "href")), lambda h: h != ""), F.lit(0)), F.lit(""))
    out = found.select("url", tags.alias("tags")).select("url", base.alias("base"), F.explode(F.filter(F.concat(canonical, refresh), lambda h: h != "")).alias("to"))
    return out.select("url", resolved(F.col("url"), F.col("base"), F.col("to")).alias("target")).where("target is not null")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(host, path, ...) + rule, action of the longest fitting rule, or nulls.  One row of urls in, one out,
    if (host, path) is distinct.

    A url is looked up by those ends of its host that have as many labels as some rule's host, at
    most; so the join is by equality, whatever the number of rules.
    """
    r = rules.select(F.substring_index("rule", "/", 1).alias("rule_host"), F.expr("substr(rule, instr(rule, '/'))").alias("rule_path"), "rule", "action")
    depth = r.agg(F.max(F.size(F.split("rule_host", "\\.")))).first()[0] or 0
    names = F.split("host", "\\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(max(depth, 1)))), lambda i: F.array_join(F.slice(names, F.size(names) - i + 1, i), "."))
    hits = urls.select("host", "path", F.explode(ends).alias("rule_host")).join(r, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), F.col("rule"), F.col("action") == "allow")).alias("best"))
    return urls.join(best.select("host", "path", "best.rule", "best.action"), ["host", "path"], "left")


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", normal_forms: bool = False) -> DataFrame:
    """pages(id, url, html) -> id, host, path, rule, verdict, decided_by.

    rules(rule, action): host and path prefix in one string; redirects(url, target), optional, adds
    edges, and normal_forms those from each url to its form without www., tracking query and the like.
    Rule > alias class > default allow; in a class, one allowed member allows it all.
    Null or malformed urls have an empty host and path, fit no rule and are allowed; null and empty html has no links;
    repeated rows each give a row; tables without rows give none; other columns are ignored, whatever their names.
    """
    pages = pages.select(F.col(id_col).alias("id"), "url", "html")
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    links = cut(links.where("url is not null and target is not null").distinct())
    # One row for each text of a url: a third of the pages may share one.
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct()
    known = urls.unionByName(links.select("url")).unionByName(links.select(F.col("target").alias("url"))).distinct()
    known = cut(parse(known).where("host <> ''"))
    targets = known.select(F.col("url").alias("target"), F.col("node").alias("dst"))
    edges = links.join(known.select("url", F.col("node").alias("src")), "url").join(targets, "target").select("src", "dst")
    if normal_forms:
        edges = known.select(F.col("node").alias("src"), F.col("normal").alias("dst")).unionByName(edges)
    ruled = cut(match_rules(known.select("host", "path").distinct(), rules).where("rule is not null"))
    classes = connected_components(edges)
    members = known.select("host", "path", "node").join(ruled, ["host", "path"])
    said = members.join(classes, "node").groupBy("component").agg(F.max((F.col("action") == "allow").cast("int")).alias("allows"))
    spread = classes.join(said, "component").select("node", F.when(F.col("allows") == 1, F.lit("allow")).otherwise(F.lit("block")).alias("class_action"))
    verdicts = known.join(ruled, ["host", "path"], "left").join(spread, "node", "left")
    verdicts = cut(verdicts.where("rule is not null or class_action is not null").select("url", "rule", "action", "class_action"))
    release(links, known, ruled, classes)
    host, path, _ = split_url(F.col("url"))
    out = pages.select("id", "url").join(verdicts, "url", "left")
    by = F.when(F.col("rule").isNotNull(), F.lit("rule")).when(F.col("class_action").isNotNull(), F.lit("alias class")).otherwise(F.lit("default"))
    return reading(out.select(F.col("id").alias(id_col), host.alias("host"), path.alias("path"), "rule", F.coalesce("action", "class_action", F.lit("allow")).alias("verdict"), by.alias("decided_by")), verdicts)
