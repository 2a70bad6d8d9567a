"""The crawl of links."""

import random
from collections import deque

import pytest

from docloom import queries
from docloom.queries import page_queries
from docloom.sources import files


def test_a_chain_is_followed_to_its_end_within_the_boundary(spark):
    url = "https://a.example.org/docs/{}".format
    links = [(url(i), url(i + 1)) for i in range(52)] + [(url(3), "https://b.example.org/docs/1"), (url(4), "https://a.example.org/docsother"), (url(52), url(0)), (None, url(99))]
    found = files.crawl(spark.createDataFrame(links, "source string, target string"), url(0), "https://a.example.org/docs").collect()
    assert {(r.url, r.level) for r in found} == {(url(i), i) for i in range(53)} and len(found) == 53


def plain_crawl(links, start, ends, limit):
    """One queue: (requested, url, read) in its order."""
    follow = {}
    for source, target, at in sorted(links, key=lambda x: x[2]):
        follow.setdefault(source, []).append(target)
    queue, seen, ended, out = deque([start]), set(), set(), []
    while queue and (limit is None or len(out) < limit):
        u = queue.popleft()
        if u in seen:
            continue
        end = ends.get(u, u)
        seen |= {u, end}
        out.append((u, end, end not in ended))
        if end not in ended:
            ended.add(end)
            queue.extend(t for t in follow.get(end, []) if t not in seen)
    return out


def crawled(spark, links, start, ends, limit, **more):
    table = spark.createDataFrame(links, "source string, target string, at long")
    moved = spark.createDataFrame(list(ends.items()), "requested string, url string") if ends else None
    rows = files.crawl_in_order(table, start, moved, limit=limit, **more).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, len(rows) + 1))
    return [(r.requested, r.url, r.read) for r in rows]


def test_the_order_of_a_queue(spark):
    for seed in (0, 1):
        rng = random.Random(seed)
        links = list({(f"u{rng.randrange(40)}", f"u{rng.randrange(40)}"): rng.randrange(1000) for _ in range(90)}.items())
        links = [(s, t, at * 100 + i) for i, ((s, t), at) in enumerate(links)]
        # Redirects in chains, to themselves, to unlinked pages, and in a loop.
        ends = {f"u{rng.randrange(40)}": f"u{rng.randrange(44)}" for _ in range(14)} | {"u1": "u2", "u2": "u1", "u3": "u3"} if seed else {}
        for limit in (1, 7, 100) if seed else (100,):
            assert crawled(spark, links, "u0", ends, limit) == plain_crawl(links, "u0", ends, limit), (seed, limit)


def test_ends_stay_in_the_boundary(spark):
    url = "https://a.example.org/docs/{}".format
    links = [(url(i), url(i + 1), i) for i in range(9)] + [(url(1), "https://b.example.org/docs/1", 0)]
    assert [r[0] for r in crawled(spark, links, url(0), {}, None, root="https://a.example.org/docs")] == [url(i) for i in range(10)]
    with pytest.raises(Exception, match="leaves the crawl"):
        crawled(spark, links, url(0), {url(3): "https://b.example.org/x"}, None, root="https://a.example.org/docs")
    assert crawled(spark, [], "x", {}, 5) == [("x", "x", True)]
    assert files.crawl_in_order(spark.createDataFrame([], "source string, target string, at long"), "x", limit=0).count() == 0


def test_the_crawl_of_the_pages(spark):
    links, ends = page_queries.page_graph(spark, "/root/testdata/sf0.001")
    edges, moved = [tuple(r) for r in links.collect()], dict(tuple(r) for r in ends.collect())
    found = [(r.requested, r.url, r.read) for r in queries.QUERIES["a3_crawl_order"](spark, "/root/testdata/sf0.001").orderBy("place").collect()]
    assert found == plain_crawl(edges, min(e[0] for e in edges), moved, 60) and len(found) > 3


def test_links_to_groups_of_pages_are_not_paired(spark, monkeypatch):
    rng = random.Random(3)
    links = [(f"u{rng.randrange(30)}", f"g{rng.randrange(6)}", at) for at in range(60)] + [("u0", "g0", 60), ("u1", None, 61), (None, "g1", 62)]
    groups = [(f"g{rng.randrange(6)}", f"u{i % 28}", i) for i in range(40)] + [("g0", None, 40), (None, "u1", 41)]
    pairs = {}
    for source, via, at in links:
        for v, target, of in groups:
            if None not in (source, via, target) and via == v:
                pairs[source, target] = min(pairs.get((source, target), 1 << 60), at * 1000 + of)
    pairs = [(s, t, at) for (s, t), at in pairs.items()]
    table, through = spark.createDataFrame(links, "source string, via string, at long"), spark.createDataFrame(groups, "via string, target string, of long")
    moved = {"u5": "u1", "u7": "u2", "u9": "u5"}
    ends = spark.createDataFrame(list(moved.items()), "requested string, url string")
    for limit in (5, None):
        rows = files.crawl_in_order(table, "u0", ends, limit=limit, through=through).orderBy("place").collect()
        assert [(r.requested, r.url, r.read) for r in rows] == plain_crawl(pairs, "u0", moved, limit)

    def paired(*_):
        raise AssertionError("the square of the pages")

    monkeypatch.setattr(page_queries, "page_graph", paired)
    assert queries.QUERIES["a3_crawl_order"](spark, "/root/testdata/sf0.001").count() > 3
