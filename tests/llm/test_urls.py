import re
from urllib.parse import urlsplit  # noqa: F401  not used for the split: the contract has its own

from sparkveil.llm import urls

PAGES = "page_id long, url string, html string, rule string, host string"


def plain(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [(len(h) + len(p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    text = (url or "").lower()
    found = [n for w, n in urls.VOCABULARY.items() if re.search(rf"(?<![a-z0-9]){w}(?![a-z0-9])", text)]
    bad = urls.LIMIT in found or len(found) >= 2
    return host, path, None, "block" if bad else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/en/", "https://a.example.com/en/7?x", "https://example.com/en/8", "https://notexample.com/en/7", "http://x.net/de/8", "http://www.Example.net/de/81#a",
    "http://example.net/de", "ftp://es.org/es/", "http://a.org/porn-site", "http://a.org/pornographic", "http://a.fr/?q=free+casino", "http://a.fr/free/free", "http://xxx.fr/", "http://a.fr/xxxl", "http://a.fr/sex-sexy",
    "http://ÄÖ.fr/POKER?win=1", "http://a.fr/\nen/://x.com/en/", "http://u:p@h.com:80/en/", "http://com/en/" + "a" * 100_000, "http://a.fr/casino casino", "http://a.fr/xxx xxx xxx",
]


def test_verdicts(spark):
    rows = [(k, u, "x", "clash", "clash") for k, u in enumerate(URLS)] + [(None, URLS[8], None, None, None)] * 3
    got = urls.judge(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(URLS[r["page_id"]]), URLS[r["page_id"]]
    assert urls.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_counts():
    terms = urls.automaton({"bad": 2, "soft": 1, "soften": 1})
    assert urls.count_terms("bad-bad_bad badly soft soft soften softly", terms) == (3, 2, 4)
    assert urls.count_terms(None, terms) == (0, 0, 0)
    assert urls.count_terms("anything", urls.automaton({})) == (0, 0, 0)


def test_weights(spark, tmp_path):
    (tmp_path / "terms").write_text("heavy\nhalf,3\n\nlight,1\n")
    own = urls.read_vocabulary(tmp_path / "terms", limit=6)
    assert own == {"heavy": 6, "half": 3, "light": 1}
    df = spark.createDataFrame([(1, "h://a/heavy"), (2, "h://a/half/half"), (3, "h://a/half-light"), (4, "h://half.b/light/heavy"), (5, "h://a/halfheavy")], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["weight"]) for r in urls.judge(df, (), own, 6).collect()}
    assert got == {1: ("block", 6), 2: ("allow", 3), 3: ("allow", 4), 4: ("block", 10), 5: ("allow", 0)}


def test_hits_on_the_table(spark, sf):
    """Hosts made of the vocabulary are rejected, and no other host of the table is."""
    got = urls.op8_urls(spark, sf.replace("sf0.001", "sf0.1")).where("rule is null").toPandas()
    assert (got.verdict == "block").any() and set(got.verdict[got.weight == 0]) == {"allow"}
    for host in set(got.host[got.verdict == "block"]):
        assert set(re.split("[^a-z0-9]", host)) & set(urls.VOCABULARY), host


def test_longer_rule_of_the_same_host_wins(spark):
    rules = (("a.b", "/x", "block"), ("a.b", "/x/y", "allow"), ("c.a.b", "/", "block"))
    df = spark.createDataFrame([(1, "h://a.b/x/y"), (2, "h://a.b/xz"), (3, "h://c.a.b/x/y"), (4, "h://d.a.b/z")], "page_id long, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, rules).collect()} == {1: ("a.b/x/y", "allow"), 2: ("a.b/x", "block"), 3: ("c.a.b/", "block"), 4: (None, "allow")}
