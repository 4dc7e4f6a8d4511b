"""URL discovery: sitemaps, links and a breadth-first walk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siteledger.functions import urls as U
from siteledger.operators.html import html_elements
from siteledger.operators.ranking import rank_in_group
from siteledger.session import durable

# How a sitemap names its pages and its parts.
_LOC = "<loc>([^<]+)</loc>"
_INDEX_ENTRY = r"<sitemap>([\s\S]*?)</sitemap>"


def sitemap_locs(sitemaps: DataFrame) -> DataFrame:
    """(url, pos, loc): the page URLs of each sitemap document, as written. A document
    with a `<sitemap>` block is an index and holds none."""
    is_index = F.col("xml").rlike(_INDEX_ENTRY)
    locs = F.regexp_extract_all("xml", F.lit(_LOC), 1)
    return sitemaps.filter(~is_index).select("url", F.posexplode(locs).alias("pos", "loc"))


def _index_entries(sitemaps: DataFrame) -> DataFrame:
    """(url, pos, child): the first location of each entry of an index document."""
    blocks = F.regexp_extract_all("xml", F.lit(_INDEX_ENTRY), 1)
    return (
        sitemaps.filter(F.col("xml").contains("<sitemap>"))
        .select("url", F.posexplode(blocks).alias("pos", "_block"))
        .select("url", "pos", F.regexp_extract("_block", _LOC, 1).alias("child"))
        .filter(F.col("child") != "")
    )


#: Rounds of the search after which the places found so far are written as one table.
ROUNDS_KEPT = 10


def document_places(roots: DataFrame, entries: DataFrame) -> DataFrame:
    """(site, url, path): each document reachable from `roots(site, url)` over `entries(url, pos,
    child)`, once, at its first place in depth-first order: the smallest list of positions
    that leads to it.

    Places only ever get smaller: a round follows the documents whose place did, and compares
    what they list with the places known. So it costs one row per document and round that moves
    it, however many paths lead there, and a document that lists itself or one above it ends,
    as its path would be longer."""
    start = F.array().cast("array<int>")
    moved = roots.select("site", "url", start.alias("path")).distinct()
    known, rounds = moved, 0
    while True:
        listed = (
            moved.join(entries, "url")
            .groupBy("site", F.col("child").alias("url"))
            .agg(F.min(F.array_append("path", F.col("pos"))).alias("path"))
        )
        before = known.join(listed.select("site", "url"), ["site", "url"], "left_semi").groupBy("site", "url").agg(F.min("path").alias("_before"))
        nearer = F.col("_before").isNull() | (F.col("path") < F.col("_before"))
        moved = durable(listed.join(before, ["site", "url"], "left").filter(nearer).select("site", "url", "path"))
        if moved.isEmpty():
            return known.groupBy("site", "url").agg(F.min("path").alias("path"))
        known, rounds = known.unionByName(moved), rounds + 1
        if rounds % ROUNDS_KEPT == 0:
            known = durable(known.groupBy("site", "url").agg(F.min("path").alias("path")))


def every_place(roots: DataFrame, entries: DataFrame) -> DataFrame:
    """(site, url, path): each document reachable from `roots(site, url)` over `entries(url, pos,
    child)`, once for every path that leads to it. A document that lists itself or one above it
    is not followed there. Levels end where no path goes on; there are as many rows as paths."""
    start = F.array().cast("array<int>")
    level = roots.select("site", "url", start.alias("path"), F.array("url").alias("_above"))
    found = level
    while True:
        level = durable(
            level.join(entries, "url")
            .filter(~F.array_contains("_above", F.col("child")))
            .select(
                "site",
                F.col("child").alias("url"),
                F.array_append("path", F.col("pos")).alias("path"),
                F.array_append("_above", F.col("child")).alias("_above"),
            )
        )
        if level.isEmpty():
            return found.drop("_above")
        found = found.unionByName(level)


def expand_sitemap_index(roots: DataFrame, sitemaps: DataFrame, every: bool = False) -> DataFrame:
    """(site, path, loc): page URLs reachable from `roots(site, url)` through index documents
    of any depth. `path` lists positions from the root, so sorting by it gives depth-first
    order. A document listed in several places is given for each with `every`, else at the first
    of them, which is all that the order of distinct URLs needs and costs no more where paths
    multiply. Documents that were not captured add nothing."""
    entries = durable(_index_entries(sitemaps))
    places = every_place(roots, entries) if every else document_places(roots, entries)
    return places.join(sitemap_locs(sitemaps), "url").select("site", F.array_append("path", F.col("pos")).alias("path"), "loc")


def first_n_urls(found: DataFrame, n: int | None = None) -> DataFrame:
    """(site, ord, url): the distinct URLs per site in document order, the first `n` if given.

    Repeats are removed by a partial aggregate. With `n`, Spark keeps at most `n` rows per
    site and task before the shuffle of the ranking; without, a large site is ranked over
    several partitions."""
    first_seen = found.groupBy("site", F.col("loc").alias("url")).agg(F.min("path").alias("path"))
    if n is None:
        return rank_in_group(first_seen, ["site"], [F.col("path")], "ord").drop("path")
    return limit_pages(first_seen, n, "path").drop("path")


def limit_pages(urls: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first `n` URLs per site in discovery order, numbered from 0."""
    place = F.row_number().over(Window.partitionBy("site").orderBy(order))
    kept = urls.withColumn("_rank", place).filter(F.col("_rank") <= n)
    return kept.withColumn("ord", F.col("_rank") - 1).drop("_rank")


def extract_links(pages: DataFrame, key: str = "page_id", base: str = "site") -> DataFrame:
    """(key, base, pos, href, link): every `a[href]` with text in it, resolved against the
    `base` column — the site root by default, not the page. Links that do not resolve
    are dropped; fragments stay."""
    elements = html_elements(pages, key, "links", (base,), carry_on="all")
    rows = elements.filter(F.col("tag") == "a").select(
        key, base, F.col("elem_id").alias("pos"), F.col("attrs")["href"].alias("href")
    )
    return U.with_resolved_url(rows, "href", base, "link").filter(F.col("link").isNotNull())


def crawl_links(pages: DataFrame) -> DataFrame:
    """(site, url, pos, link): internal links of `pages(site, url, html)`, repeats within
    a page removed."""
    links = extract_links(pages, "url", "site").filter(U.is_internal(F.col("link"), F.col("site")))
    return links.groupBy("site", "url", "link").agg(F.min("pos").alias("pos"))


def crawl_frontier(links: DataFrame, seeds: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(site, ord, url): pages in the order a first-in-first-out walk visits them.

    `links(site, url, pos, link)`, `seeds(site, url)`. One round per level: the links of
    the newest pages, minus the pages already placed, in the order (place of the page,
    place of the link), up to `max_pages` per site if given. A page that was not captured has no
    links but still counts. Each round is written to the checkpoint folder; the rounds
    end with the level at which no site finds a new page.
    """
    links = durable(links)
    visited = seeds.select("site", "url", F.lit(0).cast("bigint").alias("ord"))
    frontier = visited
    rounds = 0
    while True:
        placed = visited.groupBy("site").agg(F.count(F.lit(1)).alias("_placed"))
        fresh = (
            frontier.join(links, ["site", "url"])
            .groupBy("site", F.col("link").alias("_link"))
            .agg(F.min(F.struct("ord", "pos")).alias("_from"))
            .join(
                visited.select("site", F.col("url").alias("_link")), ["site", "_link"], "left_anti"
            )
        )
        if max_pages is None:
            ranked = rank_in_group(fresh, ["site"], [F.col("_from.ord"), F.col("_from.pos")], "_rank")
        else:
            # Ranked before joining the counts, so Spark limits the rows per site early.
            place = F.row_number().over(Window.partitionBy("site").orderBy("_from"))
            ranked = fresh.withColumn("_nth", place).filter(F.col("_nth") < max_pages)
            ranked = ranked.withColumn("_rank", F.col("_nth") - 1)
        placed_next = ranked.join(placed, "site").select(
            "site", F.col("_link").alias("url"), (F.col("_placed") + F.col("_rank")).alias("ord")
        )
        if max_pages is not None:
            placed_next = placed_next.filter(F.col("ord") < max_pages)
        frontier = durable(placed_next)
        if frontier.isEmpty():
            return visited
        visited = visited.unionByName(frontier)
        rounds += 1
        if rounds % 10 == 0:
            visited = durable(visited)


def discover_urls(
    roots: DataFrame,
    sitemaps: DataFrame,
    links: DataFrame,
    max_pages: int | None = None,
    max_listed: int | None = None,
) -> DataFrame:
    """(site, ord, url): the sitemap's URLs, or the walk for sites whose sitemap gives none.

    `roots(site, url)` names each site's sitemap; the walk starts at the site root. With
    `max_listed` a sitemap gives its first URLs only, with `max_pages` a walk ends there."""
    listed = first_n_urls(expand_sitemap_index(roots, sitemaps), max_listed)
    listed = listed.select("site", F.col("ord").cast("bigint").alias("ord"), "url")
    without = roots.select("site").join(listed.select("site").distinct(), "site", "left_anti")
    seeds = without.select("site", F.col("site").alias("url"))
    reachable = links.join(without, "site", "left_semi")
    walked = crawl_frontier(reachable, seeds, max_pages)
    return listed.unionByName(walked.select("site", "ord", "url"))
