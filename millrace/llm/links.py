"""URL verdicts by rules, and by trust and distrust along links between hosts.

Rules name a host and a path; the longest one that fits a page decides.  For the
other pages their host decides.  A host's seed of trust (distrust) is the share
of its pages that an allow (block) rule fits.  Trust follows links: a host passes
its trust on in equal parts to the hosts it links to (personalised PageRank).
Distrust runs against them: a host that is linked to by others passes its
distrust to those others, in equal parts.  A host is blocked when its distrust
exceeds its trust by more than `MARGIN` of what a fully blocked host starts with.

Scores are whole billionths, rounded after each step, so reruns agree.  Hosts
without links keep their seeds; what a host without outward links holds is not
handed out again.

Defined results: a null url, or one without `://`, has an empty host and path, no
rule and the verdict of a host without seeds, which is allow; a null page has no
links; repeated rows count as pages each; an empty table gives no rows; columns
other than page_id, url and html are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import written

# The production rules, (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))

DAMPING = 0.85
#: Steps go on until no score moves; moves shrink by DAMPING a step, and are under a billionth
#: after 128 steps.
STEPS = 128
MARGIN = 0.5
UNIT = 1_000_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute links of a page, and links that leave only the scheme open.
HREF = r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.expr("substring(u, locate('://', u) + 3)")
    return _of(url, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER))


def path_of(url: Column) -> Column:
    rest = F.expr("substring(u, locate('://', u) + 3)")
    return _of(url, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1))


def _of(url: Column, value: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), value).otherwise("")


def located(pages: DataFrame) -> DataFrame:
    """`(page_id, u, host, path)`."""
    u = F.col("u")
    return pages.select("page_id", F.col("url").alias("u")).select(
        "page_id", "u", host_of(u).alias("host"), path_of(u).alias("path"))


def rule_of(rules=RULES) -> Column:
    """The longest rule that fits `host` and `path`, as `(verdict, rule)`; of equally long
    ones the first listed."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) \
            & F.startswith(F.col("path"), F.lit(slash + path))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))) \
                 .otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct `(src, dst)` between different hosts."""
    link = F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)))
    found = pages.select(F.col("url").alias("u"), link.alias("to")).select(
        host_of(F.col("u")).alias("src"),
        F.when(F.startswith("to", F.lit("//")), F.concat(F.lit("http:"), F.col("to")))
        .otherwise(F.col("to")).alias("u"))
    return (found.select("src", host_of(F.col("u")).alias("dst"))
            .where("src <> '' and dst <> '' and src <> dst").distinct())


def _spread(seeds: DataFrame, links: DataFrame, steps: int) -> DataFrame:
    """`(host, score)` after personalised PageRank from `seeds(host, seed)` along
    `links(src, dst)`, to the point where no score moves by a billionth.

    Each step is one join and one aggregate, and is written; every eighth is compared with
    the one before.  Scores only grow, so the number of steps is bounded; `steps` guards it.
    """
    degree = links.groupBy("src").agg(F.count("*").alias("degree"))
    weighted = written(links.join(degree, "src"), "weighted_links")
    base = F.round(F.col("seed") * (1 - DAMPING)).cast("bigint")
    state = seeds.select("host", base.alias("score"))
    if weighted.isEmpty():
        return state
    for step in range(1, steps + 1):
        part = F.floor(F.col("score") / F.col("degree"))
        passed = (weighted.join(state.where("score > 0"), F.col("src") == F.col("host"))
                  .groupBy(F.col("dst").alias("host")).agg(F.sum(part).alias("_in")))
        got = F.floor(F.coalesce("_in", F.lit(0)) * DAMPING).cast("bigint")
        moved = written(seeds.join(passed, "host", "left").select("host", "seed", (base + got).alias("score"))
                        .join(state.withColumnRenamed("score", "was"), "host"), "scores")
        state = moved.select("host", "score")
        if step % 8 == 0 and moved.where("score <> was").isEmpty():
            return state
    raise RuntimeError(f"scores still move after {steps} steps")


def host_scores(judged: DataFrame, links: DataFrame, steps: int = STEPS) -> DataFrame:
    """`(host, trust, distrust)` of hosts of `judged(host, verdict)` and of `links`, in billionths."""
    share = lambda verdict: F.round(
        F.count(F.when(F.col("verdict") == verdict, 1)) * UNIT / F.count("*")).cast("bigint")
    pages = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("good"),
                                                           share("block").alias("bad"))
    ends = links.select(F.col("src").alias("host")).union(links.select("dst"))
    hosts = written(pages.unionByName(ends.select("host", F.lit(0).alias("good"), F.lit(0).alias("bad")))
                    .groupBy("host").agg(F.max("good").alias("good"), F.max("bad").alias("bad")), "hosts")
    trust = _spread(hosts.select("host", F.col("good").alias("seed")), links, steps)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = _spread(hosts.select("host", F.col("bad").alias("seed")), back, steps)
    return trust.withColumnRenamed("score", "trust").join(
        distrust.withColumnRenamed("score", "distrust"), "host")


def blocked() -> Column:
    return F.col("distrust") - F.col("trust") > int(MARGIN * (1 - DAMPING) * UNIT)


def filter_urls(pages: DataFrame, rules=RULES, steps: int = STEPS) -> DataFrame:
    """`(page_id, host, path, rule, verdict, trust, distrust)` of every row; the scores are
    those of the host, null where it is empty."""
    rows = written(located(pages).withColumn("r", rule_of(rules)).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.col("r.verdict").alias("verdict")), "located")
    links = written(host_links(pages), "host_links")
    scores = host_scores(rows, links, steps)
    own = F.when(blocked(), "block").otherwise("allow")
    return rows.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"),
        "trust", "distrust")
