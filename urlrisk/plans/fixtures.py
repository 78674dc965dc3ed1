"""URL tables derived from the given tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: URLs of many kinds over ``pages``.
URL_CORPUS = """
SELECT page_id AS url_id,
       CASE CAST(page_id % 36 AS INT)
         WHEN 0  THEN concat('http://192.168.', CAST(page_id % 256 AS STRING), '.', CAST(page_id % 7 AS STRING), '/login')
         WHEN 1  THEN concat('https://paypa1.com/login?id=', CAST(page_id AS STRING))
         WHEN 2  THEN concat('https://micros0ft-login.com/', CAST(page_id AS STRING))
         WHEN 3  THEN concat('https://paypal.secure', CAST(page_id AS STRING), '-example.com/verify')
         WHEN 4  THEN concat('https://apple-support-recovery.com/invoice/', CAST(page_id AS STRING))
         WHEN 5  THEN concat('http://google.com@evil', CAST(page_id AS STRING), '-phishing.com/login')
         WHEN 6  THEN concat('http://example.com:', CAST(4000 + page_id % 9000 AS STRING), '/admin')
         WHEN 7  THEN concat('https://security-update', CAST(page_id AS STRING), '.zip/download')
         WHEN 8  THEN concat('https://xkj19f8q2pmvz09a', CAST(page_id AS STRING), '.com/dashboard')
         WHEN 9  THEN concat('https://a.b.c.d.example.com/', CAST(page_id AS STRING))
         WHEN 10 THEN concat('https://example.com/', repeat('a', CAST(100 + page_id % 100 AS INT)))
         WHEN 11 THEN concat('https://evil-example.com/steal/', CAST(page_id AS STRING))
         WHEN 12 THEN concat('  Sub', CAST(page_id AS STRING), '.Crypto-Airdrop-Scam.test/Claim  ')
         WHEN 13 THEN concat('http://аpple.com/', CAST(page_id AS STRING))
         WHEN 14 THEN concat('https://github.com/login?next=https://github.com/', CAST(page_id AS STRING))
         WHEN 15 THEN concat('https://my-secure-login-account-update.com/p/', CAST(page_id AS STRING))
         WHEN 16 THEN concat('https://example.org/r?u=http%3A%2F%2Fx%2F', CAST(page_id AS STRING))
         WHEN 17 THEN concat('https://example.net/q?a=1&b=2&c=3&d=4&e=5&f=', CAST(page_id AS STRING), '&a=9&g=')
         WHEN 18 THEN concat('https://shop', CAST(page_id AS STRING), '.co.uk/action-required/refund')
         WHEN 19 THEN concat('http://[invalid:', CAST(page_id AS STRING))
         WHEN 20 THEN '   '
         WHEN 21 THEN concat('https://a-quite-long-host-name-for-this-table', CAST(page_id AS STRING), '.example-hosting.net/a')
         WHEN 22 THEN concat('https://example.com/q9Zx7Lk2Vb8Nw4Rt6Yp1Jm3/Hd5Gs0Fa', CAST(page_id AS STRING))
         WHEN 25 THEN concat('http://[2001:DB8::00', hex(16 + page_id % 200), ']:8080/login')
         WHEN 26 THEN CASE WHEN page_id % 5 < 3 THEN concat('http://shop', CAST(page_id AS STRING), '.xn--mchen-kva.de/') ELSE 'http://xn--pple-43d.com/' END
         WHEN 27 THEN concat('http://сосо', CAST(page_id AS STRING), '.рф/')
         WHEN 28 THEN concat('https://a.shop', CAST(page_id AS STRING), '.city.ck/x')
         WHEN 29 THEN concat('https://b', CAST(page_id AS STRING), '.www.ck/x')
         WHEN 30 THEN concat('http://faß', CAST(page_id AS STRING), '.de/')
         WHEN 31 THEN CASE WHEN page_id % 5 < 3 THEN concat('http://xn--fa-hia.de/', CAST(page_id AS STRING)) ELSE concat('http://a', CAST(page_id AS STRING), '.xn--strae-oqa.de/') END
         WHEN 32 THEN CASE WHEN page_id % 5 < 3 THEN concat('http://i❤', CAST(page_id AS STRING), '.ws/') ELSE concat('http://xn--i-7iq.ws/', CAST(page_id AS STRING)) END
         WHEN 33 THEN CASE WHEN page_id % 5 < 3 THEN concat('http://l·l', CAST(page_id AS STRING), '.cat/') ELSE concat('http://a·b', CAST(page_id AS STRING), '.cat/') END
         WHEN 34 THEN CASE WHEN page_id % 5 < 3 THEN concat('http://xn--a-0ea', CAST(page_id AS STRING), '.com/') ELSE concat('http://か・き', CAST(page_id AS STRING), '.jp/') END
         ELSE url
       END AS url
FROM pages
"""

#: The corpus as lines of CSV and of JSON; some of them are broken, some URLs are empty or missing.
URL_LINES = {
    "csv": """SELECT CASE CAST(url_id % 10 AS INT) WHEN 7 THEN concat('n', CAST(url_id AS STRING), ',x') WHEN 8 THEN concat(CAST(url_id AS STRING), ',') ELSE concat(CAST(url_id AS STRING), ',"', url, '"') END AS value FROM url_corpus""",
    "json": """SELECT CASE CAST(url_id % 10 AS INT) WHEN 7 THEN concat('{"url_id": ', CAST(url_id AS STRING), ', "url": ') WHEN 8 THEN concat('{"url_id": ', CAST(url_id AS STRING), '}')
        WHEN 9 THEN concat('{"url_id": ', CAST(url_id AS STRING), ', "url": ""}') ELSE concat('{"url_id": ', CAST(url_id AS STRING), ', "url": "', url, '"}') END AS value FROM url_corpus""",
}

#: Suffixes of two labels and more, under which a name can be registered.
SUFFIXES = (
    "co.uk org.uk ac.uk com.au net.au edu.au co.nz govt.nz co.za co.jp ne.jp osaka.jp ikeda.osaka.jp bando.ibaraki.jp nishi.fukuoka.jp co.kr co.in gov.in com.br blog.br "
    "com.cn gov.cn com.tw com.hk com.sg com.my com.mx com.ar com.tr com.ng co.zm com.bo co.il co.th co.id com.pl katowice.pl campania.it on.ca lib.ny.us "
    "stjordal.no iz.hr edu.bb nat.tn aeroclub.aero city.kawasaki.jp a.kobe.jp x.ck www.ck a.sch.uk"
)
#: A host under each of these suffixes, by the number of a page.
SUFFIX_HOSTS = f"SELECT concat('www.shop', CAST(page_id AS STRING), '.', split_part('{SUFFIXES}', ' ', CAST(1 + page_id % {len(SUFFIXES.split())} AS INT))) AS hostname FROM pages"

#: Messages that quote one URL of the corpus each, a host without a scheme, an e-mail address
#: and what looks like hosts; every turn is one, with its whole text.
MESSAGES = """
SELECT c.conv_id * 1000 + c.turn AS msg_id,
       concat('Please see ', coalesce(trim(p.url), ''), ' now, or Pay', CAST(c.conv_id AS STRING), '.Example.co.uk:8080/x?y=1. Mail a.b@mail', CAST(c.turn AS STRING),
              '.example.com (v1.2.3, e.g. notes.unlisted, or [bücher', CAST(c.turn AS STRING), '.de]). ', coalesce(c.text, '')) AS text
FROM (SELECT conv_id, turn, text, (conv_id * 31 + turn) % (SELECT count(*) FROM pages) AS quoted FROM conversations) c
LEFT JOIN url_corpus p ON p.url_id = c.quoted
"""

#: A report for each page, of its host or of one of few large sites, with a number that
#: orders them; the last report of a host counts. The first is the only one of its host.
IOC_FEED = """
SELECT page_id AS seq,
       CASE WHEN page_id = 0 THEN 'first.test' WHEN page_id % 3 = 0 THEN concat('site', CAST(page_id % 7 AS STRING), '.test') ELSE regexp_extract(url, '://([^/?#:]+)', 1) END AS indicator,
       'domain' AS indicator_type, CASE WHEN page_id % 2 = 0 THEN 'community' ELSE 'partner' END AS source,
       CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
       concat('report ', CAST(page_id AS STRING)) AS description
FROM pages
"""

#: Which third of the reports, by their number, each is in: a stream gets them one by one.
REPORT_THIRDS = "SELECT *, CAST(floor(seq * 3 / (SELECT max(seq) + 1 FROM ioc_feed)) AS INT) AS third FROM ioc_feed"
#: Which third of the URLs each is in.
URL_THIRDS = "SELECT url_id, url, CAST(floor(url_id * 3 / (SELECT max(url_id) + 1 FROM url_corpus)) AS INT) AS third FROM url_corpus"

#: Ten URLs for each event, on few hosts.
URL_BENCH = """
SELECT event_id * 10 + k AS url_id,
       CASE CAST((event_id + k) % 6 AS INT)
         WHEN 0 THEN concat('https://site', CAST(user_id AS STRING), '.com/item/', CAST(event_id AS STRING))
         WHEN 1 THEN concat('http://10.', CAST(user_id % 256 AS STRING), '.0.', CAST(k AS STRING), '/verify')
         WHEN 2 THEN concat('https://paypa1-', CAST(event_id AS STRING), '.net/payment')
         WHEN 3 THEN concat('https://google.site', CAST(event_id AS STRING), '.xyz/otp')
         WHEN 4 THEN concat('https://github.com/login?o=', CAST(event_id AS STRING))
         ELSE concat('https://evil-example.com/', CAST(event_id AS STRING))
       END AS url
FROM (SELECT event_id, user_id, explode(sequence(0, 9)) AS k FROM events)
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def url_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "pages")
    return spark.sql(URL_CORPUS)


def url_lines(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    url_corpus(spark, sf_dir).createOrReplaceTempView("url_corpus")
    return spark.sql(URL_LINES[fmt])


def suffix_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "pages")
    return spark.sql(SUFFIX_HOSTS)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url_corpus(spark, sf_dir).createOrReplaceTempView("url_corpus")
    tables(spark, sf_dir, "conversations")
    return spark.sql(MESSAGES)


def ioc_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "pages")
    return spark.sql(IOC_FEED)


def thirds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The corpus and the reports, each with its third."""
    url_corpus(spark, sf_dir).createOrReplaceTempView("url_corpus")
    ioc_feed(spark, sf_dir).createOrReplaceTempView("ioc_feed")
    return spark.sql(URL_THIRDS), spark.sql(REPORT_THIRDS)


def url_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return spark.sql(URL_BENCH)
