"""Labels that come from the list do not teach the list; others do, and hold on urls that were not mined."""

import random

from impressa.llm import urls


def test_tokens_of_the_rules():
    assert {"t:com", "d:example.com", "h:example", "h:www", "p:en", "p:es", "p:fr", "t:net", "d:net"} <= set(urls.rule_tokens())


def test_pages_are_not_blocked_for_the_lists_own_paths(spark):
    r = random.Random(1)
    pages = [(i, f"http://s{r.randrange(40)}.example.com/en/{i}" if i % 2 else f"http://s{r.randrange(40)}.other.org/en/{i}") for i in range(600)]
    pages += [(1000 + i, f"http://s{r.randrange(40)}.shop.com/en/{i}") for i in range(900)]
    pages += [(600 + i, f"http://s.example.com/en/x?sid={i}") for i in range(50)] + [(700, "http://a.org/z?sid=3"), (701, "http://b.org/en/")]
    got = {x.page_id: (x.rule, x.verdict) for x in urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert got[1] == ("example.com/en/", "block") and got[2] == (None, "allow") and got[701] == (None, "allow")
    assert got[700] == (None, "block")  # sid is a token of blocked urls only, and none of the list's


def test_held_out_precision_of_mined_verdicts(spark):
    r = random.Random(2)

    def url(bad):
        path = f"/{r.choice(['a', 'b', 'c'])}/{'ads' if bad and r.random() < 0.7 else r.choice(['news', 'blog'])}/{r.randrange(999)}"
        return f"http://{r.choice(['x', 'y'])}.site{r.randrange(9)}.org{path}{'?click=1&aff=2' if bad and r.random() < 0.6 else '?page=1'}"

    rows = [(i, url(bad), "block" if bad else "allow") for i in range(3000) for bad in [r.random() < 0.3]]
    table = spark.createDataFrame(rows, "page_id long, url string, label string")
    judged = urls.judge(table.where("page_id % 3 = 0"), labelled=table.where("page_id % 3 <> 0").selectExpr("url", "label as verdict"))
    got = [(rows[x.page_id][2], x.verdict) for x in judged.collect()]
    blocked = [a for a, b in got if b == "block"]
    assert sum(a == "block" for a in blocked) / len(blocked) >= 0.98
    assert len([1 for a, b in got if a == b == "block"]) / len([1 for a, _ in got if a == "block"]) >= 0.8
