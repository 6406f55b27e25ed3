"""URL filters by redirect equivalence: rules on host and path, block decisions spread to aliases of a URL.

Pages name aliases by canonical links and by redirects (refresh tags). The components over these edges are the
equivalence classes of URLs. A page that a rule fits keeps that rule's verdict. Any other page is blocked if a URL of its
class is blocked by a rule and none is explicitly allowed; otherwise it is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized
from .components import connected_components

#: (verdict, host, path); a list of this kind is configuration and stays inside the plan.
Rule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*+([^?#]*)", 1), F.lit(""))


def _decision(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, else null."""
    fits = [
        F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def _node(url: Column) -> Column:
    """The key of a URL in the alias graph: host, path and query, without scheme and fragment."""
    host, path = host_and_path(url)
    return F.concat(host, path, F.regexp_extract(url, r"^[^?#]*+(\?[^#]*)", 1))


def alias_edges(pages: DataFrame) -> DataFrame:
    """url -> target for each canonical link and redirect; relative targets are resolved against the page's URL."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*+>"), 0)
    named = r"""(?is)\brel\s*=\s*["']?canonical\b|\bhttp-equiv\s*=\s*["']?refresh\b"""
    tag = pages.where(F.col("html").rlike("(?i)canonical|refresh") & (F.instr("url", "://") > 0)).select("url", F.explode(F.filter(tags, lambda t: t.rlike(named))).alias("tag"))
    link = F.coalesce(*[F.nullif(F.regexp_extract("tag", p, 1), F.lit("")) for p in (r"""(?is)\bhref\s*=\s*"([^"]*)""", r"""(?is)\bhref\s*=\s*'([^']*)""", r"""(?is)\bhref\s*=\s*([^\s"'>]+)""", r"""(?is)[;,]\s*url\s*=\s*["']?\s*([^"'>]+)""")])
    found = tag.select("url", F.trim(F.replace(link, F.lit("&amp;"), F.lit("&"))).alias("link")).where("link <> ''")
    base = F.regexp_extract("url", r"^([^?#]*?://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"^[^?#]*?://[^/?#]*((?:/[^/?#]*)*?/?)[^/?#]*(?:[?#]|$)", 1)
    target = (
        F.when(F.instr("link", "://") > 0, F.col("link"))
        .when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link"))
        .when(F.startswith("link", F.lit("/")), F.concat(base, "link"))
        .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), "link"))
    )
    return found.select("url", target.alias("target"))


def judge_urls(pages: DataFrame, rules: list[Rule], scratch: Scratch | None = None) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, host, path, rule, verdict.

    Null URLs and URLs without '://' have empty host and path, so no rule and no alias; null html has no links; a URL
    linking to itself and repeated rows or links change nothing; an empty table gives an empty result; further
    columns are ignored.
    """
    scratch = scratch or Scratch(pages.sparkSession, "urls")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    links = alias_edges(rows)
    a, b = F.xxhash64(_node(F.col("url"))), F.xxhash64(_node(F.col("target")))
    edges = scratch.table(links.select("url", "target", a.alias("src"), b.alias("dst")), "links")
    comps = connected_components(edges, scratch)
    ends = edges.select("url", F.col("src").alias("id")).union(edges.select("target", "dst")).dropDuplicates(["id"])
    verdict = _decision(*host_and_path(F.col("url")), rules)["verdict"]
    judged = ends.select("id", verdict.alias("verdict")).join(comps, "id")
    spread = judged.groupBy("component").agg(F.max((F.col("verdict") == "allow").cast("int")).alias("allowed"), F.max((F.col("verdict") == "block").cast("int")).alias("blocked"))
    bad = spread.where("blocked = 1 and coalesce(allowed, 0) = 0").select("component")
    blocked = scratch.table(comps.join(bad, "component").select(F.col("id").alias("node"), F.lit(True).alias("alias_blocked")), "blocked")
    host, path = host_and_path(F.col("url"))
    base = rows.select("page_id", host.alias("host"), path.alias("path"), F.xxhash64(_node(F.col("url"))).alias("node"))
    base = base.withColumn("d", _decision(F.col("host"), F.col("path"), rules)).join(sized(blocked), "node", "left")
    final = F.coalesce(F.col("d.verdict"), F.when(F.col("alias_blocked"), F.lit("block")), F.lit("allow"))
    return base.select("page_id", "host", "path", F.col("d.rule").alias("rule"), final.alias("verdict"))
