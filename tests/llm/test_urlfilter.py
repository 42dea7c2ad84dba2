import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from codeaudit.llm import urlfilter as uf
from codeaudit.llm.queries import URL_RULES

URLS = [None, "", "no scheme/fr/", "http://", "http://ORG", "http://org/", "http://a.b.ORG/x?y", "HTTP://X.example.org/es/1", "http://example.org/en/1#f",
        "http://example.org/en/12/a", "http://notexample.org/es/", "http://myorg/", "ftp://u@a.com:80/fr/x", "http://a.com?/fr/", "http://a.com#/de/",
        "http://a.com/de/", "http://a.com/De/", "http://ÉÀ.com/fr/é", "http://a.net/a\nb?c=1&d=%20", "x://y://z.com/fr/", "http://.com/de/", "http://a.com/fr"]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, key=lambda f: (-f[0], f[1]), default=(0, None, None))
    return host, path, best[1], best[2]


def test_rules_equal_brute_force(spark):
    df = spark.createDataFrame([(i, u, "c", "d") for i, u in enumerate(URLS)] + [(None, URLS[5], "c", "d")] * 2,
                               "page_id long, url string, host string, rule string")
    got = uf.judge(df, URL_RULES, uf.UrlModel(None, {}, 0.0)).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, rule, verdict = brute(URLS[5] if r.page_id is None else URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), r
    assert uf.judge(df.limit(0), URL_RULES, uf.train(uf.rule_labels(df.limit(0), URL_RULES))).count() == 0


def test_lexical_features(spark):
    url = "https://a-1.Example.com/p/q.html?x=1&y=%20"
    df = spark.createDataFrame([(url, "a-1.example.com", "/p/q.html"), (None, "", "")], "url string, host string, path string")
    got, none = uf.lexical_features(df).collect()
    assert (got.n_url, got.n_host, got.n_path, got.n_query, got.depth, got.labels, got.params, got.hyphens, got.percents,
            got.longest_label, got.secure, got.host_digits) == (len(url), 15, 9, 9, 2, 3, 2, 1, 1, 7, 1, 1)
    counts = Counter(url.lower())
    assert abs(got.entropy + sum(n / len(url) * math.log2(n / len(url)) for n in counts.values())) < 1e-9
    assert got.digit_ratio == sum(c.isdigit() for c in url) / len(url) and (got.suffix, got.domain) == ("com", "example.com")
    assert none.n_url == 0 and none.entropy == 0


def labelled(rng, n):
    out = []
    for _ in range(n):
        bad = rng.random() < 0.4
        words = rng.choices(["news", "blog", "shop", "a", "item"], k=rng.randint(1, 3))
        path = "/".join(str(rng.randrange(10 ** 8)) for _ in range(4)) if bad else "/".join(words)
        query = "&".join(f"k{i}={rng.randrange(999)}" for i in range(rng.randint(3, 6))) if bad else ""
        noisy = rng.random() < 0.03
        out.append((f"http://{rng.choice('abc')}{rng.randrange(30)}.{rng.choice(['com', 'net', 'org'])}/{path}?{query}", float(bad != noisy)))
    return out


def test_held_out_accuracy_also_for_new_suffixes(spark):
    rng = random.Random(6)
    model = uf.train(spark.createDataFrame(labelled(rng, 1500) + [(None, None)], "url string, blocked double"), trees=8)
    for suffix in (None, "zz"):
        held = [(i, u.replace(".com/", f".{suffix}/").replace(".net/", f".{suffix}/") if suffix else u, b)
                for i, (u, b) in enumerate(labelled(rng, 400))]
        df = spark.createDataFrame(held, "page_id long, url string, blocked double")
        judged = uf.judge(df, [], model).join(df, "page_id")
        right = judged.filter((F.col("verdict") == "block") == (F.col("blocked") == 1.0)).count()
        assert right / 400 > 0.9


def test_labels_of_one_kind(spark):
    for kind, verdict in ((1.0, "block"), (0.0, "allow")):
        model = uf.train(spark.createDataFrame([("http://a.b/", kind)] * 3, "url string, blocked double"))
        assert uf.judge(spark.createDataFrame([(1, "http://c.d/")], "page_id long, url string"), [], model).first().verdict == verdict


def test_model_does_not_depend_on_how_rows_are_dealt_out(spark):
    rng = random.Random(9)
    rows = labelled(rng, 600) + [("http://hot.com/1?a=2", 1.0)] * 300
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(labelled(rng, 200))], "page_id long, url string")
    table = spark.createDataFrame(rows, "url string, blocked double")
    runs = []
    for n in (3, 5, 17):
        # With a sample smaller than the table, it is drawn by content as well.
        model = uf.train(table.repartition(n), sample_rows=300, trees=4)
        runs.append(sorted((r.page_id, r.block_probability) for r in uf.judge(pages.repartition(n), [], model).collect()))
    assert runs[0] == runs[1] == runs[2] and len({p for _, p in runs[0]}) > 5


def test_query_keeps_the_rules_on_all_pages(spark):
    from codeaudit.llm.queries import op4_url_filter

    sf = "/root/testdata/sf0.001"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op4_url_filter(spark, sf).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.block_probability >= 0.5 else "allow"))
