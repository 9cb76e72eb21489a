"""The rules of op1's contract, word for word."""

from turnlake.llm import url_rules

#: As the contract lists them.
CONTRACT = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_words_of_the_rules(spark):
    pages = spark.createDataFrame([(i, f"http://{rule}") for i, rule in enumerate(CONTRACT)], "page_id long, url string")
    none = spark.createDataFrame([], url_rules.RULE)
    assert {r["rule"]: r["verdict"] for r in url_rules.judge(pages, none).collect()} == CONTRACT


def test_longest_rule_wins_and_an_allowed_host_is_not_blocked_by_mined_rules(spark):
    urls = ["http://a.net/de/1", "http://example.net/de/7", "http://x.example.net/de/81", "http://example.com/en/71", "http://example.com/en/6"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    mined = spark.createDataFrame([(["host:net"], 1.0, 1.0, "host:net")], url_rules.RULE)
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(pages, mined).collect()}
    assert found == {0: ("net/de/", "allow"), 1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("example.com/en/7", "allow"), 4: ("com/en/", "block")}
