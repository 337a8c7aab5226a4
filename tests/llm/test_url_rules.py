"""Mined url rules see every token and may need any number of them."""

from impressa.llm import urls


def test_rules_of_late_tokens(spark):
    def deep(i):
        return "/".join(f"s{chr(97 + i)}{chr(97 + k)}" for k in range(14))

    labels = spark.createDataFrame([(f"http://x.org/{deep(i)}?{'ad' if i % 2 else 'id'}=1", "block" if i % 2 else "allow") for i in range(20)], "url string, verdict string")
    pages = spark.createDataFrame([(1, "http://y.info/z?ad=3"), (2, "http://y.info/z?id=3")], "page_id long, url string")
    assert {x.page_id: x.verdict for x in urls.judge(pages, labelled=labels, min_support=0.4).collect()} == {1: "block", 2: "allow"}


def test_rules_of_four_tokens(spark):
    rows = [("a/b/c/d", "block")] + [(p, "allow") for p in ("a/b/c", "a/b/d", "a/c/d", "b/c/d")]
    labels = spark.createDataFrame([(f"http://x.org/{p}", v) for p, v in rows for _ in range(20)], "url string, verdict string")
    pages = spark.createDataFrame([(1, "http://y.info/a/b/c/d"), (2, "http://x.org/a/b/c")], "page_id long, url string")
    assert {x.page_id: x.verdict for x in urls.judge(pages, labelled=labels).collect()} == {1: "block", 2: "allow"}
