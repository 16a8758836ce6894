import random

from pyspark.sql import functions as F

from veritome.llm import revisits, rules, urlrules

RULES = "host string, path string, verdict string"


def fits(rule, host, path):
    return (host == rule[0] or host.endswith("." + rule[0])) and path.startswith(rule[1])


def test_nested_rules_match_brute_force(spark):
    random.seed(5)
    hosts = ["org", "com", "a.org", "b.a.org", "x.com", "axorg"]
    paths = ["/", "/a", "/a/", "/a/b", "/ab", "/a/b/é", "/z\U0001f600", "/a/\uffff"]
    own = list({(random.choice(hosts), random.choice(paths)): random.choice(("allow", "block")) for _ in range(25)}.items())
    own = [(h, p, v) for (h, p), v in own]
    urls = [f"http{random.choice(('', 's'))}://{random.choice(('', 'WWW.', 'm.'))}{random.choice(hosts)}{random.choice(('', *paths))}{random.choice(('', 'q', '?x=/a', '#f'))}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "http://", "http://org", "x://y://org/a"]
    rows = list(enumerate(urls)) + [(0, urls[0])]
    pages = spark.createDataFrame([(i, u, "extra") for i, u in rows], "page_id long, url string, verdict string").repartition(3)
    got = urlrules.judged(pages, spark.createDataFrame(own, RULES)).collect()
    assert len(got) == len(rows)
    for r in got:
        matching = [x for x in own if fits(x, r.host, r.path)]
        best = max(matching, key=lambda x: (len(x[0] + x[1]), x[0] + x[1]), default=None)
        assert (r.rule, r.verdict) == ((best[0] + best[1], best[2]) if best else (None, "allow")), r


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert urlrules.judged(pages, spark.createDataFrame([], RULES), default="block").collect()[0].verdict == "block"
    assert urlrules.judged(pages.limit(0), spark.createDataFrame([("org", "/", "allow")], RULES)).collect() == []


RECORDS = "record_id long, url string, ts long, kind string, headers map<string,string>, extra string"


def test_revisits(spark):
    rows = [
        (1, "http://a.org/x", 100, "response", {"ETag": '"1"', "Content-Type": "t", "Cache-Control": "old"}, ""),
        (2, "https://www.a.org/x/#f", 200_000, "revisit", {"etag": 'W/"1"', "Cache-Control": "new", "Content-Type": "no"}, ""),
        (3, "http://a.org/x?utm_a=1", 300_000, "response", {"ETag": '"2"'}, ""),
        (4, "http://a.org/x", 300_000, "revisit", {"etag": '"1"'}, ""),
        (5, "http://a.org/x", 300_001, "revisit", {"etag": '"1"'}, ""),
        (6, "http://a.org/x", 100, "revisit", {"etag": '"1"'}, ""),
        (7, "http://b.org/?b=2&a=1", 5, "response", {"Last-Modified": "d"}, ""),
        (8, "http://B.org:80/?a=1&b=2", 6, "revisit", {"Last-Modified": "d", "Age": "3"}, ""),
        (9, "http://b.org/?a=1&b=2", 7, "revisit", None, ""),
        (10, "http://b.org/?a=1&b=2", 8, "revisit", {"Last-Modified": "e"}, ""),
        (11, None, 8, "revisit", {}, ""),
        (12, "http://a.org/x", None, "revisit", {}, ""),
        (13, "http://a.org/x", 100, "response", {"ETag": '"1"', "X": "13"}, ""),
    ]
    got = {r.record_id: r for r in revisits.resolved(spark.createDataFrame(rows, RECORDS).repartition(3)).collect()}
    assert {k: (r.outcome, r.source_id) for k, r in got.items()} == {2: ("resolved", 13), 4: ("resolved", 13), 5: ("mismatch", 3), 6: ("no_response", None), 8: ("resolved", 7), 9: ("resolved", 7), 10: ("mismatch", 7), 11: ("no_response", None), 12: ("no_response", None)}
    assert got[2].headers == {"etag": 'W/"1"', "x": "13", "cache-control": "new"}
    assert got[8].headers == {"last-modified": "d", "age": "3"} and got[9].headers == {"last-modified": "d"} and got[5].headers is None
    assert revisits.resolved(spark.createDataFrame([], RECORDS)).collect() == []


def brute_rules(text):
    ws = (text or "").encode().split()
    at = {}
    for i in range(len(ws) - 7):
        at.setdefault(tuple(ws[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\v\f\r")]
    return (len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_measures_match_brute_force(spark):
    random.seed(9)
    texts = [None, "", " \n\t\v\f\r", "a " * 7, "a " * 8, "a " * 9, "é# é|\n\n x\n x\nx\n"]
    for _ in range(60):
        ws = [random.choice("abé#") for _ in range(random.randrange(0, 60))]
        texts.append(random.choice((" ", "\n", "\t ")).join(ws * random.randrange(1, 3)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in rules.measured(df).collect():
        want = brute_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_binomial_tail(spark):
    from math import comb

    cases = [(n, k, p) for n in (1, 10, 600, 5000) for k in (0, 1, 5) for p in (0.0125, 0.3) if k < n * p]
    for n, k, p in cases:
        got = spark.range(1).select(rules.binomial_tail(F.lit(n), F.lit(k), p)).first()[0]
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(got - want) <= 1e-9 * want
    exact = spark.range(1).select(rules.binomial_tail(F.lit(5000), F.lit(40), 0.0125)).first()[0]
    bound = spark.range(1).select(rules.binomial_tail(F.lit(5000), F.lit(40), 0.0125, terms=5)).first()[0]
    assert exact <= bound <= 2 * exact


def test_risk_is_controlled_by_stratum(spark):
    """In one stratum symbols mark bad texts only, in the other good ones have them too; strata without labels keep all."""
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    docs, labels = [], []
    for i in range(4000):
        lang, good = ("aa", "bb")[i % 2], i % 20 not in (3, 4)
        noisy = (not good) or (lang == "bb" and i % 10 == 5)
        docs.append((i, words(i) + (" ###" if noisy else ""), lang))
        labels.append((i, int(good)))
    docs += [(9000, words(1) + " ###", "cc"), (9001, words(2), None), (9002, None, "aa")]
    got = {r.doc_id: r for r in rules.risk_controlled(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert not got[4].kept and got[3].kept and got[5].kept and got[9000].kept and got[9001].kept and not got[9002].kept
    for lang in (0, 1):
        good = [got[i].kept for i in range(4000) if i % 2 == lang and i % 20 not in (3, 4)]
        assert sum(good) >= 0.95 * len(good)


def test_many_rules_of_one_host_over_many_ranges(spark):
    """Rules nested up to six deep under one host, with gaps between, cut into many ranges of the sweep."""
    random.seed(8)
    steps = lambda n: "".join(random.choice("/ab") for _ in range(n))
    own = [("h.org", p, random.choice(("allow", "block"))) for p in {steps(random.randrange(0, 7)) for _ in range(400)}] + [("org", "/a", "block"), (None, "/", "block"), ("org", None, "block")]
    urls = [(i, f"http://{random.choice(('h.org', 'x.h.org', 'org', 'h.orgs'))}{'/' + steps(random.randrange(0, 9))}") for i in range(2000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = urlrules.judged(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(own, RULES)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(got) == len(urls)
    for r in got:
        best = max((x for x in own if None not in x and fits(x, r.host, r.path)), key=lambda x: (len(x[0] + x[1]), x[0] + x[1]), default=None)
        assert (r.rule, r.verdict) == ((best[0] + best[1], best[2]) if best else (None, "allow")), r


def test_a_hundred_thousand_rules_of_one_host(spark):
    rules_ = spark.range(100_000).select(F.lit("big.org").alias("host"), F.format_string("/%d", "id").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.format_string("http://www.big.org/%d/x", "id").alias("url"))
    got = urlrules.judged(pages, rules_)
    assert got.where(F.col("rule") == F.format_string("big.org/%d", "page_id")).count() == 20_000 - got.where("verdict <> 'block'").count() == 20_000
