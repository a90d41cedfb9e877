"""URL filters: rules by host and path, and for what no rule decides, trust and distrust over links.

Rules give seeds: a host is trusted by the share of its pages that a rule allows, and distrusted by
the share that a rule blocks.  Links between hosts form a weighted graph.  Trust flows along links
(personalised PageRank from the trusted hosts), distrust against them, from the blocked hosts to
those that link to them; what reaches a host without further links returns to the seeds, so that each
of the two sums to 1.  Pages without a rule are judged by what their host receives over links,
without its own share of the seeds, so that a rule for one path doesn't condemn a host: it is blocked
if of what it receives more than BLOCK_AT is distrust.

Edges are summed by pair of hosts before anything is joined, so a host with a third of all pages
has no more rows than it has neighbours; each round is a join and a partial aggregation, and AQE
splits a hub's rows.  Rounds go on until they move less than TOLERANCE of the flow.  Every few
rounds are written to the shared folder.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and is
allowed; null html has no links, and html is read whole, however long; links within a host, and those
without a host, are left out; hosts that are only linked to take part in the flow; repeated pages
count each; equal trust and distrust (to SHARE_DIGITS digits) allow; no pages give no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DAMPING = 0.85
BLOCK_AT = 0.5
SHARE_DIGITS = 4  #: of a host's share of distrust
TOLERANCE = 1e-7  #: summed change of a round, of a flow of 1
TOGETHER = 4  #: rounds that are written together
#: Of a url: all between the first `://` and the next `/`, `?`, `#`; then all up to `?` or `#`.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Links out of the page's own site: those with a host.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), _UPPER, _UPPER.lower()), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def ruled(rules=RULES) -> Column:
    """rule and verdict of the longest rule that fits columns host and path; nulls if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links from host to host."""
    found = pages.select(host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), 1)).alias("link"))
    found = found.select("src", host(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))).alias("dst"))
    return found.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """host, trust, distrust, trust_in, distrust_in (the parts that came over links).  seeds: host, trust, distrust.

    kind 0 carries trust along links, kind 1 distrust against them.  Returning what hosts without
    links hold to the seeds only adds to the seeds' own inflow, and the flow is linear in that: so
    it is iterated without the return, and each kind is then scaled to a sum of 1.
    """
    both = edges.select(F.lit(0).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").unionByName(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
    out = both.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    step = cut(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("share")), "links-step")
    start = seeds.select("host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trust").alias("score")), F.struct(F.lit(1).alias("kind"), F.col("distrust").alias("score")))).alias("s"))
    start = start.select("s.kind", "host", "s.score").where("score > 0")
    sums = {r["kind"]: r["s"] for r in start.groupBy("kind").agg(F.sum("score").alias("s")).collect()}  # two rows
    weight = F.when(F.col("kind") == 0, F.lit(float(sums.get(0) or 1))).otherwise(F.lit(float(sums.get(1) or 1)))
    start = cut(start.withColumn("score", F.col("score") / weight), "links-start")
    base = start.withColumn("score", F.col("score") * (1 - DAMPING))
    none = F.lit(0.0)
    now, moving, written = base.withColumn("before", none), not step.isEmpty(), None
    while moving:
        for _ in range(TOGETHER):
            moved = now.join(step, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * DAMPING).alias("score"), none.alias("before"))
            # The score of the round before travels along, for the change.
            now = base.withColumn("before", none).unionByName(moved).unionByName(now.select("kind", "host", none.alias("score"), F.col("score").alias("before")))
            now = now.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("before").alias("before"))
        now = written = cut(now, "links-now", written)
        moving = (now.groupBy("kind").agg((F.sum(F.abs(F.col("score") - F.col("before"))) / F.sum("score")).alias("d")).agg(F.max("d")).first()[0] or 0) > TOLERANCE
    own = base.select("kind", "host", none.alias("score"), F.col("score").alias("own"))
    now = now.select("kind", "host", "score", none.alias("own")).unionByName(own).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("own").alias("own"))
    total = {r["kind"]: r["s"] for r in now.groupBy("kind").agg(F.sum("score").alias("s")).collect()}  # two rows
    columns = []
    for kind, name in enumerate(("trust", "distrust")):
        for value, suffix in ((F.col("score"), ""), (F.greatest(F.col("score") - F.col("own"), none), "_in")):
            columns.append(F.coalesce(F.sum(F.when(F.col("kind") == kind, value / F.lit(float(total.get(kind) or 1)))), none).alias(name + suffix))
    return now.groupBy("host").agg(*columns).select("host", "trust", "distrust", "trust_in", "distrust_in")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust."""
    named = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("r", ruled(rules))
    named = named.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))
    share = {v: F.count_if(F.col("ruled") == v) / F.count("*") for v in ("allow", "block")}
    seeds = named.where("host <> ''").groupBy("host").agg(share["allow"].alias("trust"), share["block"].alias("distrust"))
    scores = cut(propagate(cut(links(pages), "links"), cut(seeds, "links-seeds")), "links-scores")
    rows = named.join(small(scores), "host", "left")
    received = F.col("trust_in") + F.col("distrust_in")
    bad = F.coalesce((received > 0) & (F.round(F.col("distrust_in") / received, SHARE_DIGITS) > BLOCK_AT), F.lit(False))
    verdict = F.coalesce("ruled", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def _sql(rules=RULES, rounds: int = 85) -> str:
    """By definition: in each round a part of DAMPING moves over links, and all that didn't is dealt to the seeds.

    After 85 rounds 0.85^85, a millionth of the flow, may still move.
    """
    parts = PARTS.replace("'", "''")

    def host_of(x: str) -> str:
        return f"coalesce(translate(regexp_extract({x}, '{parts}', 1), '{_UPPER}', '{_UPPER.lower()}'), '')"

    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for h, p, _ in longest]
    rule = "CASE " + " ".join(f"{f}'{h}{p}'" for f, (h, p, _) in zip(fits, longest)) + " END"
    ruled_ = "CASE " + " ".join(f"{f}'{v}'" for f, (_, _, v) in zip(fits, longest)) + " END"
    link = LINK.replace("'", "''")
    out = [
        f"n AS (SELECT page_id, html, {host_of('url')} AS host, coalesce(regexp_extract(url, '{parts}', 2), '') AS path FROM pages)",
        f"j AS (SELECT *, {rule} AS rule, {ruled_} AS ruled FROM n)",
        f"l AS (SELECT host AS src, {host_of("CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM n))",
        "e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL)",
        "b AS (SELECT 0 AS kind, src AS host, dst AS too, n FROM e UNION ALL SELECT 1, dst, src, n FROM e)",
        "s AS MATERIALIZED (SELECT kind, host, too, n / sum(n) OVER (PARTITION BY kind, host) AS share FROM b)",
        "d AS (SELECT host, count(*) FILTER (ruled = 'allow') / count(*) AS trust, count(*) FILTER (ruled = 'block') / count(*) AS distrust FROM j WHERE host <> '' GROUP BY host)",
        "w AS (SELECT 0 AS kind, host, trust AS score FROM d UNION ALL SELECT 1, host, distrust FROM d)",
        "r0 AS MATERIALIZED (SELECT kind, host, score / sum(score) OVER (PARTITION BY kind) AS score FROM w WHERE score > 0)",
    ]
    for i in range(1, rounds + 1):
        out.append(f"m{i} AS MATERIALIZED (SELECT s.kind, s.too AS host, sum(r.score * s.share) * {DAMPING} AS score FROM r{i - 1} r JOIN s ON r.kind = s.kind AND r.host = s.host GROUP BY ALL)")
        rest = f"SELECT r0.kind, host, score * (1 - coalesce(t, 0)) AS score FROM r0 LEFT JOIN (SELECT kind, sum(score) AS t FROM m{i} GROUP BY kind) k ON r0.kind = k.kind"
        out.append(f"r{i} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (FROM m{i} UNION ALL {rest}) GROUP BY kind, host)")
    out.append(f"v AS (SELECT host, coalesce(sum(score) FILTER (kind = 0), 0) AS good, coalesce(sum(score) FILTER (kind = 1), 0) AS bad FROM m{rounds} GROUP BY host)")
    verdict = f"CASE WHEN good + bad > 0 AND round(bad / (good + bad), {SHARE_DIGITS}) > {BLOCK_AT} THEN 'block' ELSE 'allow' END"
    return "WITH " + ",\n".join(out) + f"\nSELECT page_id, j.host, path, rule, coalesce(ruled, {verdict}) AS verdict FROM j LEFT JOIN v ON j.host = v.host"


SQL = _sql()
