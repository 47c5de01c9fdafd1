"""URL verdicts from host rules and a path-template tree; DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Fixed rules: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEVELS = ["host", "s1", "s2", "s3"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _segments(path: Column) -> list[Column]:
    """Three template segments: digit runs are wildcards, the third holds all deeper ones."""
    shape = F.regexp_replace(path, "[0-9]+", "*")
    parts = F.split(F.regexp_replace(shape, "^/", ""), "/")
    return [F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.array_join(F.slice(parts, 3, 1 << 30), "/")]


def _generalise(nodes: DataFrame, level: int, least: int) -> DataFrame:
    """Segment ``level`` becomes ``*`` below parents with at least ``least`` children of which hardly any recurs.

    Parents are templates already, so what lies below a wildcard is one branch.
    """
    parent, child = ["host", *(f"t{k}" for k in range(1, level))], _LEVELS[level]
    each = nodes.groupBy(*parent, child).agg(F.sum("pages").alias("k"))
    wild = each.groupBy(*parent).agg(F.count("*").alias("kids"), F.sum("k").alias("all")).where((F.col("kids") >= least) & (F.col("all") < 2 * F.col("kids")))
    wild = wild.select(*parent, F.lit(True).alias("wild"))
    return nodes.join(wild, parent, "left").withColumn(f"t{level}", F.when(F.col("wild"), "*").otherwise(F.col(child))).drop("wild")


def template_scores(nodes: DataFrame, total: tuple[int, int], m: float, z: float) -> DataFrame:
    """Smoothed bad share of each (host, t1, t2, t3).

    From the root down, children whose share is within ``z`` standard errors of
    their parent's score merge into one branch that pools their labels; the others
    stand alone. A branch's score is its bad share, smoothed by its parent's score
    with weight ``m``.
    """
    keys, scored = [], None
    root = (total[0] + 1.0) / (total[1] + 2.0)
    for key in ("host", "t1", "t2", "t3"):
        parent, keys = list(keys), [*keys, key]
        level = nodes.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        level = level.join(scored.withColumnRenamed("score", "up"), parent) if scored is not None else level.withColumn("up", F.lit(root))
        apart = F.abs(F.col("bad") / F.col("n") - F.col("up")) > z * F.sqrt(F.col("up") * (1 - F.col("up")) / F.col("n"))
        level = level.withColumn("alone", F.coalesce((F.col("n") > 0) & apart, F.lit(False)))
        if parent:
            pool = level.where("not alone").groupBy(*parent).agg(F.sum("n").alias("pn"), F.sum("bad").alias("pbad"))
            level = level.join(pool, parent, "left")
        else:  # hosts: each is a tree of its own, similar ones take the root's score
            level = level.withColumn("pn", F.lit(0)).withColumn("pbad", F.lit(0))
        n = F.when(F.col("alone"), F.col("n")).otherwise(F.coalesce("pn", F.lit(0)))
        bad = F.when(F.col("alone"), F.col("bad")).otherwise(F.coalesce("pbad", F.lit(0)))
        scored = level.withColumn("score", (bad + m * F.col("up")) / (n + m)).select(*keys, "score")
    return scored


def url_verdicts(pages: DataFrame, labels: DataFrame, rules=RULES, m: float = 5.0, z: float = 2.0, reject: float = 0.5, least: int = 20, id_col: str = "page_id", url_col: str = "url", most_broadcast: int = 20_000) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    A page carries the label of the document whose number is the last digit run
    of its path; a document is bad if toxic or of quality 0 in any of its labels.
    Pages without a rule are blocked where their template's smoothed bad share is
    over ``reject``. A template has the host and three segments, of which the last
    holds all deeper ones. Urls that are null or without ``://`` have empty host and
    path and are judged by that template; null ids stay; repeated rows stay;
    without labels all shares are the prior's half, which allows. Pages are
    aggregated to templates before anything is joined, so a hot host moves a few
    rows; rejected templates go back to pages by broadcast while they are at most
    ``most_broadcast``, else by a salted join.
    """
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    s1, s2, s3 = _segments(F.col("path"))
    base = base.withColumns({"s1": s1, "s2": s2, "s3": s3})
    number = F.regexp_extract("path", "([0-9]{1,18})[^0-9]*$", 1)
    counts = base.withColumn("number", F.when(number != "", number.cast("long"))).groupBy(*_LEVELS, "number").agg(F.count("*").alias("pages"))
    bad = F.max(F.coalesce(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int"), F.lit(0)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("number")).agg(bad.alias("bad"))
    joined = counts.join(known, "number", "left")
    nodes = joined.groupBy(*_LEVELS).agg(F.sum("pages").alias("pages"), F.sum(F.when(F.col("bad").isNotNull(), F.col("pages")).otherwise(0)).alias("n"), F.sum(F.coalesce(F.col("bad"), F.lit(0)) * F.col("pages")).alias("bad"))
    nodes = stage(reduce(lambda d, k: _generalise(d, k, least), (1, 2, 3), nodes), "templates")
    totals = nodes.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    scores = template_scores(nodes, tuple(totals), m, z).where(F.col("score") > reject)
    refused = stage(nodes.join(scores, ["host", "t1", "t2", "t3"], "left_semi").select(*_LEVELS, F.lit("block").alias("judged")).distinct(), "refused")
    few = refused.limit(most_broadcast + 1).count() <= most_broadcast
    if few:
        out = base.join(F.broadcast(refused), _LEVELS, "left")
    else:
        salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(16)))
        out = salted.join(refused.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")))), [*_LEVELS, "salt"], "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "judged", F.lit("allow")).alias("verdict"))
