"""A catalogue crawl over stored pages: breadth first from seeds, in rounds, with bounds on rounds and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import page_links
from .gates import gate, violation
from .joins import small
from .tables import kept


def resolved(base: Column, link: Column) -> Column:
    """A link's address, seen from a page's; its fragment is left out."""
    bare = F.regexp_replace(link, "#.*$", "")
    page = F.regexp_replace(base, "[?#].*$", "")
    host = F.regexp_extract(base, "^([A-Za-z]+://[^/?#]*)", 1)
    path = F.regexp_extract(page, "^[A-Za-z]+://[^/]*(/.*/|/)", 1)
    here = F.concat(host, F.when(path == "", "/").otherwise(path), F.regexp_replace(bare, r"^(\./)+", ""))
    return (
        F.when(bare == "", F.regexp_replace(base, "#.*$", "")).when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), bare).when(bare.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), bare))
        .when(bare.startswith("/"), F.concat(host, bare)).when(bare.startswith("?"), F.concat(page, bare)).otherwise(here)
    )


def link_graph(pages: DataFrame) -> DataFrame:
    """url, target: each distinct link of a page to another address.  pages: url, html."""
    rows = page_links(pages.select(F.regexp_replace("url", "#.*$", "").alias("page_id"), "html")).select(F.col("page_id").alias("url"), resolved(F.col("page_id"), F.col("link")).alias("target"))
    return rows.where("target <> url").distinct()


def crawl(pages: DataFrame, seeds: DataFrame, rounds: int = 20, most: int | None = None) -> DataFrame:
    """seed, url, round, known: what is reached from each seed by at most `rounds` links, and in which round first.

    seeds: seed, url.  An address that isn't among the pages is listed with known = false and leads
    nowhere.  A round is one join of the frontier with the links and one anti join with what has been
    seen; frontiers are written, so that plans don't grow.  A seed that reaches more than `most` pages
    is an error: the catalogue isn't what it was taken for.
    """
    links = kept(link_graph(pages), "crawl-links")
    there = pages.select(F.regexp_replace("url", "#.*$", "").alias("url")).distinct().withColumn("known", F.lit(True))
    seen = kept(seeds.select("seed", F.regexp_replace("url", "#.*$", "").alias("url")).distinct().withColumn("round", F.lit(0)).join(there, "url", "left"), "crawl-seen")
    frontier = seen
    for turn in range(1, rounds + 1):
        ahead = frontier.where("known").select("seed", "url")
        found = links.join(small(ahead), "url").select("seed", F.col("target").alias("url")).distinct()
        frontier = kept(found.join(seen.select("seed", "url"), ["seed", "url"], "left_anti").withColumn("round", F.lit(turn)).join(there, "url", "left").select(seen.columns), f"crawl-{turn}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if most is not None:
            gate(violation(seen.where("known").groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > most), "too_many_pages", F.col("seed"), F.col("n")))
    return seen.select("seed", "url", "round", F.coalesce("known", F.lit(False)).alias("known"))
