"""Indexes for long lists and large feeds: the same rows as the plain way, with bounded work for each row."""

import random

import pytest
from pyspark.sql import functions as F

from urlrisk.functions import joins
from urlrisk.functions.joins import filter_of, join_hot, let_through
from urlrisk.functions.text import rarest_grams, words_within
from urlrisk.operators.iocs import match_iocs
from urlrisk.operators.normalize import host_table, normalize_urls
from urlrisk.operators.typosquat import _MOVES, _SEGMENTS, segments_of_text, similar_domains
from urlrisk.plans.verify import verify_urls
from urlrisk.sources.reference import default_iocs, reference_tables
from urlrisk.sources.urls import write_verdicts

IOC_ROWS = "id long, indicator string, indicator_type string, source string, severity string, description string, created_at timestamp"


def edited(rng, name, edits):
    """``name`` after some edits, swaps among them."""
    s = list(name)
    for _ in range(edits):
        k = rng.randrange(len(s))
        kind = rng.randrange(4)
        if kind == 0:
            s.insert(k, rng.choice("abxyz-"))
        elif kind == 1 and len(s) > 1:
            del s[k]
        elif kind == 2:
            s[k] = rng.choice("abxyz01")
        elif k + 1 < len(s):
            s[k], s[k + 1] = s[k + 1], s[k]
    return "".join(s)


def test_segments_lose_no_look_alike(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("abcdexyz", k=n)) for n in (1, 2, 5, 8, 9, 9, 10, 10, 11, 12, 14, 15, 19, 25, 40, 63) for _ in range(3)]
    texts = {edited(rng, rng.choice(names), rng.choice([0, 1, 2, 2, 2, 3])) for _ in range(1500)} - {""}
    domains = spark.createDataFrame([(f"{t}.net",) for t in texts], "registered_domain string")
    trusted = reference_tables(spark, trusted=[f"{n}.com" for n in names]).trusted
    plain, joined = ({tuple(r) for r in similar_domains(domains, trusted, path=p).collect()} for p in ("literal", "join"))
    assert plain == joined and len(plain) > 800


def test_rows_of_a_text_are_bounded(spark):
    texts = spark.createDataFrame([("x" * n,) for n in (1, 9, 10, 12, 63, 5000)] + [("abcdefghij" * 20,)], "t string")
    sizes = [r.n for r in texts.select(F.size(segments_of_text("t")).alias("n")).collect()]
    assert max(sizes) <= len(_MOVES) * _SEGMENTS == 65 and sizes[-1] > 30
    plan = similar_domains(texts.select(F.concat("t", F.lit(".net")).alias("registered_domain")), many(spark), path="join")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def many(spark, n=100_000):
    return spark.range(n).select(F.col("id").cast("int").alias("pos"), F.concat(F.md5(F.col("id").cast("string")), F.lit(".com")).alias("domain"), F.md5(F.col("id").cast("string")).alias("sld"))


def test_a_hundred_thousand_names(spark):
    names = many(spark)
    picked = [r.sld for r in names.where("pos % 9973 = 0").collect()]
    fakes = [p[:5] + p[6:] for p in picked] + [p[:20] + p[21] + p[20] + p[22:] for p in picked if p[20] != p[21]] + ["z" * 32]
    got = similar_domains(spark.createDataFrame([(f"{f}.org",) for f in fakes], "registered_domain string"), names).collect()
    assert {r.registered_domain for r in got} == {f"{f}.org" for f in fakes[:-1]} and len(got) == len(fakes) - 1


def test_words_within(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(60)] + ["", "aaa", "zz", "é", "日本語だ"]
    texts = ["".join(rng.choices("abcz", k=rng.randint(0, 30))) for _ in range(200)] + ["", "a", "日本語だよé"]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [tuple(r) for r in words_within(df, "id", "text", table, "word").collect()]
    assert sorted(got) == sorted({(i, w) for i, t in enumerate(texts) for w in words if w and w in t})
    index = rarest_grams(table, "word").collect()
    assert len(index) == len(set(words) - {""}) and all(r.gram in r.word and len(r.gram) == min(3, len(r.word)) for r in index)
    assert words_within(df, "id", "text", table.limit(0), "word").count() == 0


def test_filters_and_hot_keys(spark, monkeypatch):
    table = spark.range(0, 3000, 3).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(1).alias("v"))
    rows = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    some = let_through(rows, "key", filter_of(table, "key"))
    assert some.columns == ["key", "id"] and {r.id for r in some.collect()} >= set(range(0, 3000, 3)) and some.count() < 1010
    monkeypatch.setattr(joins, "FILTER_BITS", 64)  # full: all come through
    assert let_through(rows, "key", filter_of(table, "key")).count() == 3000
    hot = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "k0").otherwise(F.concat(F.lit("k"), "id")).alias("key"), "id")
    counts = hot.groupBy("key").agg(F.count("*").alias("n"))
    assert join_hot(hot, table.join(counts, "key"), "key", "n", 5000).count() == hot.join(table, "key").count()


@pytest.mark.parametrize("large_feed", [0, 10**6])
def test_a_feed_that_lists_com(spark, large_feed):
    """Every host of a suffix, a URL as given and as canonical, and a longer suffix that comes first."""
    urls = [f"http://h{k}.example.com/{k}" for k in range(60)] + ["http://a.bad.org/x", "HTTP://u.net:80/y?z", "http://u.net/other", "http://deep.evil.com", "http://10.0.0.1/", "   ", "http://ok.net"]
    feed = [(1, "com"), (2, "bad.org"), (3, "http://u.net/y?z"), (4, "http://u.net:80/y?z"), (5, "evil.com"), (6, "10.0.0.1"), (7, "com"), (8, "nobody.test")]
    iocs = spark.createDataFrame([(i, x, "domain", "s", "odd" if i == 1 else "low", f"row {i}", None) for i, x in feed], IOC_ROWS)
    n = normalize_urls(spark.createDataFrame(list(enumerate(urls)), "url_id long, url string"))
    hosts = host_table(n, reference_tables(spark).suffix_rules)
    got = {urls[r.url_id]: (r.ioc.description, r.ioc.severity) for r in match_iocs(n, hosts, iocs, large_feed).collect()}
    want = {u: ("row 1", "high") for u in urls[:60]}
    want |= {urls[60]: ("row 2", "low"), urls[61]: ("row 4", "low"), urls[63]: ("row 5", "low"), urls[64]: ("row 6", "low")}
    assert got == want


def test_verdict_table(spark, tmp_path):
    urls = spark.createDataFrame([(k, f"http://{'paypa1' if k % 3 else 'ok'}{k % 7}.com/login") for k in range(200)], "url_id long, url string")
    verdicts = verify_urls(urls, default_iocs(spark), reference_tables(spark), with_domain=True).cache()
    at = f"{tmp_path}/v"
    for run, part in (("a", "url_id < 100"), ("b", "url_id >= 100"), ("a", "url_id < 100")):
        write_verdicts(verdicts.where(part), at, run=run, rows_per_file=20)
    table = spark.read.parquet(at)
    assert table.count() == 200 and {(r.run, r.n) for r in table.groupBy("run").agg(F.count("*").alias("n")).collect()} == {("a", 100), ("b", 100)}
    assert sorted(table.select(*verdicts.columns).collect(), key=lambda r: r.url_id) == sorted(verdicts.collect(), key=lambda r: r.url_id)
    files = table.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.min("registered_domain").alias("a"), F.max("registered_domain").alias("z")).collect()
    assert max(r.n for r in files) <= 20
    plan = table.where("risk_level = 'HIGH' AND registered_domain = 'ok1.com'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(registered_domain), EqualTo(registered_domain,ok1.com)]" in plan and "PartitionFilters: [isnotnull(risk_level" in plan
    for run in "ab":  # ranges of domains do not overlap but where they meet
        own = sorted((r.a, r.z) for r in files if f"run={run}" in r.f and "risk_level=LOW" in r.f)
        assert all(z1 <= a2 for (_, z1), (a2, _) in zip(own, own[1:], strict=False))
    verdicts.unpersist()
