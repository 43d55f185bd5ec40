"""URL filter: expand each URL into host suffixes and path prefixes, equi-join the short hash
prefixes of these expressions with the rules, confirm full digests, apply rule precedence.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from
there up to ``?``, ``#`` or the end; a null url or one without ``://`` has neither (both empty).
A rule ``host/path`` fits its host and all subdomains if the path starts with the rule's path.
The longest rule wins. Rules of ``tier`` 0 come before those of ``tier`` 1, which decide where none
of the first fits; else the verdict is allow.

Repeated rows are judged once and given back as often as they came; null keys are kept. An empty
table gives an empty table, and without rules every url is allowed; further columns of the input are
not read. A url of any length or number of labels becomes as many expressions as there are pairs of
a number of labels and a path length among the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Hosts known for junk, with all their pages; a caller's own rules may take their place.
JUNK_HOSTS = ("adult-x", "casino-win", "free-bets", "spam-farm")
JUNK_ZONES = ("example.com", "example.net", "example.org")
#: Rules up to this number (some 200 bytes each) are broadcast, more are joined as Spark chooses.
MOST_BROADCAST = 50_000


def url_host(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    at = F.instr(rest, "/")
    return F.when(at > 0, F.substring(rest, at, F.length(rest))).otherwise(F.lit(""))


def junk_rules() -> tuple:
    return tuple(("block", f"{h}.{z}/") for h in JUNK_HOSTS for z in JUNK_ZONES)


def rule_table(spark, rules=RULES, second=None) -> DataFrame:
    """(tier, verdict, rule) of listed rules and of those that decide where none of them fits."""
    both = [(0, v, r) for v, r in rules] + [(1, v, r) for v, r in (junk_rules() if second is None else second)]
    return spark.createDataFrame(both, "tier int, verdict string, rule string")


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """The host's suffixes of as many labels as some rule has, each joined with the path's prefixes
    that are as long as some rule's path."""
    some = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    dots = F.length(host) - F.length(F.replace(host, F.lit(".")))
    suffixes = some([F.when(dots >= n - 1, F.substring_index(host, ".", -n)) for n in labels])
    prefixes = some([F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge_urls(urls: DataFrame, rules: DataFrame, key: str = "page_id", url_col: str = "url") -> DataFrame:
    """key, url, host, path, rule (of tier 0 or null), verdict and method_rule (of tier 1 or null).

    Rules that share a short hash are one row, so the join keeps a row an expression. Expressions of
    a row are next to each other, and one row is left of them before the only exchange, which brings
    equal rows together; a hot url is one row for each partition there. Numbers of labels and path
    lengths of the rules come to the driver; they are no more than the longest rule is long."""
    digest = F.sha2(F.col("rule"), 256)
    host_part = F.substring_index("rule", "/", 1)
    r = rules.select("tier", F.col("verdict").alias("r_verdict"), "rule", digest.alias("r_digest"), F.substring(digest, 1, 8).alias("short"))
    labels, lengths = rules.select(
        F.array_sort(F.collect_set(F.size(F.split(host_part, r"\.")))).alias("a"), F.array_sort(F.collect_set(F.length("rule") - F.length(host_part))).alias("b")
    ).first()
    r = r.groupBy("short").agg(F.collect_list(F.struct("tier", "r_verdict", "rule", "r_digest")).alias("held"))
    if rules.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        r = F.broadcast(r)
    parts = urls.select(F.col(f"`{key}`").alias("k"), F.col(f"`{url_col}`").alias("u"), url_host(F.col(f"`{url_col}`")).alias("host"), url_path(F.col(f"`{url_col}`")).alias("path"))
    every = expressions(F.col("host"), F.col("path"), labels, lengths) if labels else F.array().cast("array<string>")
    found = parts.select("*", F.posexplode_outer(every).alias("pos", "expr")).withColumn("digest", F.sha2("expr", 256)).withColumn("short", F.substring("digest", 1, 8))
    hit = found.join(r, "short", "left").withColumn("fits", F.filter("held", lambda x: x["r_digest"] == F.col("digest")))
    longest = lambda tier: F.max(F.array_max(F.transform(F.filter("fits", lambda x: x["tier"] == tier), lambda x: F.struct(F.length(x["rule"]).alias("n"), x["rule"].alias("rule"), x["r_verdict"].alias("r_verdict")))))
    out = hit.groupBy("k", "u", "host", "path").agg(longest(0).alias("a"), longest(1).alias("b"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("copies"))
    out = out.withColumn("i", F.explode(F.expr("sequence(1L, copies)")))
    return out.select(F.col("k").alias(key), F.col("u").alias(url_col), "host", "path", F.col("a.rule").alias("rule"), F.coalesce("a.r_verdict", "b.r_verdict", F.lit("allow")).alias("verdict"), F.col("b.rule").alias("method_rule"))


_case = " ".join(f"WHEN (host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{r}'" for _, r in sorted(RULES, key=lambda x: -len(x[1])))
_own = " OR ".join(f"host = '{h}.{z}' OR ends_with(host, '.{h}.{z}')" for h in JUNK_HOSTS for z in JUNK_ZONES)
_allow = ", ".join(f"'{r}'" for v, r in RULES if v == "allow")
SQL = rf"""
WITH a AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, lower(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)', 1) AS path FROM a),
c AS (SELECT page_id, url, host, path, CASE {_case} END AS rule, starts_with(path, '/') AND ({_own}) AS junk FROM b)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({_allow}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN junk THEN 'block' ELSE 'allow' END AS verdict FROM c
"""
