from siteledger.operators import discover as D

S = "https://s.example.com"


def xml(*locs):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in locs) + "</urlset>"


def xml_index(*locs):
    return "<x>" + "".join(f"<sitemap><loc>{u}</loc><loc>no</loc></sitemap>" for u in locs) + "</x>"


def test_sitemaps(spark):
    docs = [
        (f"{S}/sitemap.xml", xml_index("deep1", "missing", "leaf")),
        ("deep1", xml_index("deep2", "leaf2")), ("deep2", xml_index("deep3", "deep1", "deep2")),
        ("deep3", xml_index("deep4")), ("deep4", xml_index("deep5")), ("deep5", xml("five")),
        ("leaf", xml("a", "b", "a", *[f"p{i}" for i in range(20)])), ("leaf2", xml("b", " c&amp;d ")),
    ]
    sitemaps = spark.createDataFrame(docs, "url string, xml string")
    roots = spark.createDataFrame([(S, f"{S}/sitemap.xml")], "site string, url string")
    found = D.expand_sitemap_index(roots, sitemaps)
    want = ["five", "b", " c&amp;d ", "a"] + [f"p{i}" for i in range(20)]
    assert [r.url for r in D.first_n_urls(found).orderBy("ord").collect()] == want
    assert [r.url for r in D.first_n_urls(found, 10).orderBy("ord").collect()] == want[:10]


def plain_order(docs, root, path=(), above=()):
    """(path, url) of every page location, by a walk over every path."""
    import re
    xml = docs.get(root, "")
    if "<sitemap>" in xml:
        out = []
        for k, block in enumerate(re.findall(r"<sitemap>([\s\S]*?)</sitemap>", xml)):
            child = re.search("<loc>([^<]+)</loc>", block).group(1)
            if child not in (*above, root):
                out += plain_order(docs, child, (*path, k), (*above, root))
        return out
    return [((*path, k), loc) for k, loc in enumerate(re.findall("<loc>([^<]+)</loc>", xml))]


def test_documents_are_placed_first_in_depth_first_order(spark):
    import random
    for seed in range(3):
        r = random.Random(seed)
        docs = {f"d{k}": xml_index(*(f"d{r.randrange(9)}" for _ in range(r.randrange(1, 4)))) if k < 6 else xml(*(f"p{r.randrange(9)}" for _ in range(3))) for k in range(9)}
        sitemaps = spark.createDataFrame(list(docs.items()), "url string, xml string")
        roots = spark.createDataFrame([("s", "d0"), ("t", "d1"), ("u", "none")], "site string, url string")
        found = D.first_n_urls(D.expand_sitemap_index(roots, sitemaps)).collect()
        for site, root in (("s", "d0"), ("t", "d1"), ("u", "none")):
            want = list(dict.fromkeys(loc for _, loc in sorted(plain_order(docs, root))))
            assert [x.url for x in sorted((f for f in found if f.site == site), key=lambda x: x.ord)] == want


def test_an_index_that_lists_the_next_twice(spark):
    levels = 24
    docs = [(f"i{k}", xml_index(f"i{k + 1}", f"i{k + 1}", "i0")) for k in range(levels)] + [(f"i{levels}", xml("page"))]
    rows = D.expand_sitemap_index(spark.createDataFrame([(S, "i0")], "site string, url string"), spark.createDataFrame(docs, "url string, xml string")).collect()
    assert [(len(r.path), set(r.path), r.loc) for r in rows] == [(levels + 1, {0}, "page")]


def test_every_place_of_a_document(spark):
    import random
    r = random.Random(5)
    docs = {f"d{k}": xml_index(*(f"d{r.randrange(9)}" for _ in range(r.randrange(1, 4)))) if k < 6 else xml(*(f"p{r.randrange(9)}" for _ in range(3))) for k in range(9)}
    docs["d0"] = xml_index("d1", "d7", "d7")
    sitemaps = spark.createDataFrame(list(docs.items()), "url string, xml string")
    roots = spark.createDataFrame([("s", "d0"), ("u", "none")], "site string, url string")
    found = D.expand_sitemap_index(roots, sitemaps, every=True).collect()
    want = sorted(("s", path, loc) for path, loc in plain_order(docs, "d0"))
    assert sorted((f.site, tuple(f.path), f.loc) for f in found) == want
    assert len({path[:-1] for _, path, _ in want}) > 2


def links(*hrefs):
    return "".join(f'<a href="{h}">x</a>' for h in hrefs)


def walk(spark, pages, n=None):
    df = spark.createDataFrame([(S, u, h) for u, h in pages.items()], "site string, url string, html string")
    seeds = spark.createDataFrame([(S, S)], "site string, url string")
    rows = D.crawl_frontier(D.crawl_links(df), seeds, n).orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(len(rows)))
    return [r.url.removeprefix(S) for r in rows]


def brute(pages, n):
    from urllib.parse import urljoin
    import re
    seen, queue = [], [S]
    while queue and (n is None or len(seen) < n):
        url = queue.pop(0)
        if url in seen:
            continue
        seen.append(url)
        for href in re.findall('href="([^"]*)"', pages.get(url, "")):
            link = urljoin(S + "/", href)
            if link.startswith(S) and link not in seen and link not in queue:
                queue.append(link)
    return [u.removeprefix(S) for u in seen]


def test_walk(spark):
    pages = {S: links("/b", "/a", "https://other.example.org/", "/b", "/a#x"), f"{S}/a": links("/c", "/a", "/"), f"{S}/b": links("/c", "d", "/a")}
    assert walk(spark, pages) == brute(pages, None)


def test_walk_limits(spark):
    pages = {S: links(*[f"/p{i % 120}" for i in range(300)]), f"{S}/p1": links("/z")}
    every = walk(spark, pages)
    assert len(every) == 122 and every == brute(pages, None)
    assert walk(spark, pages, 50) == brute(pages, 50)
    chain = {S: links("/0"), **{f"{S}/{i}": links(f"/{i + 1}", "/0") for i in range(20)}}
    assert walk(spark, chain, 4) == brute(chain, 4)
