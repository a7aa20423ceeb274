from sparkloom.llm import urls

HOSTS = ["freecasinobonus.example.org", "casinoroyale.example.org", "pokerzone.net", "windows.org", "freedom.example.org", "blog.example.org", "a-b.example.org"]
WORDS = ["free casino bonus example org", "casino royale example org", "poker zone net", "windows org", "freedom example org", "blog example org", "a b example org"]


def judged(spark, hosts, more=()):
    rows = [(k, f"http://{h}/en/{k}") for k, h in enumerate(hosts)] + [(1000 + k, u) for k, u in enumerate(more)]
    return {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), ()).collect()}


def test_labels_do_not_explain_themselves(spark):
    more = ["http://blog.example.org/freedom/day", "http://freecasinobonus.example.org/freecasinobonus"] + [f"http://www.example.org/a/{k}" for k in range(500)] + ["http://casinoroyale.example.org/"] * 40
    got = judged(spark, HOSTS, more)
    assert [got[k]["words"] for k in range(len(HOSTS))] == WORDS
    assert [got[k]["verdict"] for k in range(3)] == ["block"] * 3 and got[5]["verdict"] == "allow"


def test_words_apart():
    assert urls.apart("free-zone.mysite.net", "/Garden/free/mysite/of") == ["free", "zone", "net", "garden"]
    assert urls.made_up("freecasinobonus") and urls.made_up("clubcasino") and not urls.made_up("casino") and not urls.made_up("casinoroyale") and not urls.made_up("")


def test_rare_words_and_tokens_count_like_held_ones(spark):
    rest = "alder birch cedar maple rowan aspen hazel linden spruce walnut".split()
    more = [f"http://{a}{b}.{a}-{b}.net/{b}/{a}/{a}" for a in rest for b in rest] + ["http://example.org", None, "http://freecasinobonus.org/alder"]
    rows = [(k, f"http://{h}/en/{k}") for k, h in enumerate(HOSTS)] + [(1000 + k, u) for k, u in enumerate(more)] + [(1000, more[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    want = sorted(map(tuple, urls.judge(pages).collect()), key=repr)
    assert len(want) == len(rows) and any(r[5] == "alder birch alder birch net" for r in want)
    for held in (1, 8, 40):
        assert sorted(map(tuple, urls.judge(pages, held=held).collect()), key=repr) == want
