"""Ids of reports, the table that they flow into, and streams that see it."""

import datetime
import os

import pytest

from urlrisk.operators.iocs import upsert_iocs
from urlrisk.operators.numbering import numbered
from urlrisk.schemas import IOC_UPDATE
from urlrisk.sources.ioc_table import IocTable
from urlrisk.sources.reference import default_iocs, reference_tables
from urlrisk.streaming.streams import ioc_report_stream, pinned_versions, verify_stream


def rows_of(df):
    return sorted((r.id, r.indicator, r.indicator_type, r.source, r.severity, r.description) for r in df.collect())


def one_by_one(seeds, reports):
    """The table after inserting reports one by one, each under the next id."""
    table, top = {r.indicator: (r.id, r.indicator, r.indicator_type, r.source, r.severity, r.description) for r in seeds}, max((r.id for r in seeds), default=0)
    for _, indicator, kind, source, severity, text in reports:
        if indicator is None or kind is None:
            continue
        top += 1
        table[indicator.strip().lower()] = (top, indicator.strip().lower(), kind.strip().lower(), "community" if source is None else source, (severity or "high").strip().lower(), text)
    return sorted(table.values())


def reports(n, hosts=7):
    return [(k, [None, f" H{k % hosts}.test", "evil-example.com"][(k % 11 != 3) + (k % 13 == 5)], "Domain", [None, "lab"][k % 2], [None, " LOW "][k % 3 == 0], f"report {k}") for k in range(n)]


def test_numbers_have_no_gaps(spark):
    for n, parts in ((0, 3), (1, 5), (997, 7)):
        df = spark.range(0, n, 1, parts).selectExpr("pmod(id * 7919, 1009) AS a", "'x' AS _place_in_range")
        got = numbered(df, "k", "a").collect()
        assert [r.a for r in sorted(got, key=lambda r: r.k)] == sorted(r.a for r in got) and sorted(r.k for r in got) == list(range(1, n + 1))


def test_ids_by_sequence_time_and_null(spark):
    given = reports(60)
    seeds = default_iocs(spark)
    want = one_by_one(seeds.collect(), given)
    assert want[-1][0] > 50 and any(r[1] == "h0.test" for r in want)
    assert rows_of(upsert_iocs(seeds, spark.createDataFrame(given, IOC_UPDATE))) == want
    began = datetime.datetime(2020, 1, 1)
    timed = [(began + datetime.timedelta(hours=k), *rest) for k, *rest in given]
    assert rows_of(upsert_iocs(seeds, spark.createDataFrame(timed, IOC_UPDATE.replace("seq long", "at timestamp")), "at")) == want
    late = [(None if k < 3 else k, f"n{k}.test", "domain", "a", "low", "") for k in range(9)]  # nulls first, by the name
    assert [r[0] for r in rows_of(upsert_iocs(seeds, spark.createDataFrame(late, IOC_UPDATE))) if r[1].startswith("n")] == list(range(5, 14))
    negative = [(k - 5, f"n{k}.test", "domain", "a", "low", "") for k in range(9)]
    assert rows_of(upsert_iocs(seeds, spark.createDataFrame(negative, IOC_UPDATE)))[4:] == [(5 + k, f"n{k}.test", "domain", "a", "low", "") for k in range(9)]
    assert rows_of(upsert_iocs(seeds.limit(0), spark.createDataFrame(given[:5], IOC_UPDATE))) == one_by_one([], given[:5])
    assert rows_of(upsert_iocs(seeds, spark.createDataFrame([], IOC_UPDATE))) == one_by_one(seeds.collect(), [])


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)


@pytest.fixture
def table(spark, tmp_path):
    return IocTable(spark, f"{tmp_path}/iocs", default_iocs(spark))


def test_batches_equal_one_upsert(spark, table):
    """However the reports are cut, with merging between, and with a batch done twice."""
    given, seeds = reports(50), default_iocs(spark).collect()
    assert table.version() is None and rows_of(table.snapshot()) == one_by_one(seeds, [])
    table.compact()  # nothing yet
    cuts = [0, 7, 7, 20, 21, 50]
    for n, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        table.append(spark.createDataFrame(given[a:z], IOC_UPDATE), n)
        if n == 2:
            table.compact()
            table.append(spark.createDataFrame(given[a:z], IOC_UPDATE), n)
        assert table.version() == n and rows_of(table.snapshot()) == one_by_one(seeds, given[:z])
    for n, z in enumerate(cuts[1:]):
        assert rows_of(table.snapshot(n)) == one_by_one(seeds, given[:z])
    assert rows_of(table.snapshot(-1)) == one_by_one(seeds, [])


def test_a_batch_writes_its_reports_alone(spark, table):
    many = spark.range(200_000).selectExpr("id AS seq", "concat('h', id, '.test') AS indicator", "'domain' AS indicator_type", "'a' AS source", "'low' AS severity", "concat('report ', id) AS description")
    table.append(many, 0)
    table.compact()
    before = size(table.folder)
    table.append(spark.createDataFrame([(k, f"h{k}.test", "domain", "b", "high", "new") for k in range(10)], IOC_UPDATE), 1)
    assert before > 1_000_000 and size(table.folder) - before < 60_000
    now = table.snapshot()
    assert now.count() == 200_004 and now.where("source = 'b'").count() == 10 and now.agg({"id": "max"}).first()[0] == 200_014


def test_readers_go_on_while_tables_are_merged(spark, table):
    given, seeds = reports(40), default_iocs(spark).collect()
    for n in range(4):
        table.append(spark.createDataFrame(given[10 * n : 10 * n + 10], IOC_UPDATE), n)
    reader = table.snapshot(2)
    table.compact()
    assert rows_of(reader) == rows_of(table.snapshot(2)) == one_by_one(seeds, given[:30])
    kinds = sorted(table.commits())
    assert ("merged", 3) in kinds and rows_of(table.snapshot()) == one_by_one(seeds, given)
    for n in range(4, 8):
        table.append(spark.createDataFrame(given[n : n + 1], IOC_UPDATE), n)
        table.compact(keep=2)
    assert sorted(table.commits()) == [("merged", 6), ("merged", 7), ("reports", 7)]
    assert rows_of(table.snapshot()) == one_by_one(seeds, given[:40] + given[4:8])
    with pytest.raises(ValueError):
        table.snapshot(2)
    assert len(rows_of(table.snapshot(6))) == len(one_by_one(seeds, given[:40] + given[4:7]))


def test_verdicts_follow_reports(spark, tmp_path):
    """A report between two batches is seen by the second; the first, done again, sees what it saw."""
    urls = spark.createDataFrame([(0, "http://bad.test/x")], "url_id long, url string")
    refs, seeds = reference_tables(spark), default_iocs(spark)
    table = IocTable(spark, f"{tmp_path}/iocs", seeds)
    seen = {}

    def verify():
        urls.write.mode("append").parquet(f"{tmp_path}/urls")
        stream = spark.readStream.schema(urls.schema).parquet(f"{tmp_path}/urls")
        verify_stream(stream, table, refs, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return {r.batch: r.known_ioc for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    def report(k, severity):
        spark.createDataFrame([(k, "bad.test", "domain", "a", severity, "")], IOC_UPDATE).write.mode("append").parquet(f"{tmp_path}/reports")
        stream = spark.readStream.schema(IOC_UPDATE).parquet(f"{tmp_path}/reports")
        ioc_report_stream(stream, table.folder, seeds, f"{tmp_path}/reports_state", compact_every=1).awaitTermination()

    assert verify() == {0: False}
    report(1, "low")
    assert verify() == {0: False, 1: True}
    report(2, "high")
    # the second batch is tried again, as after a crash before it was committed
    os.remove(f"{tmp_path}/state/commits/1")
    crc = f"{tmp_path}/state/commits/.1.crc"
    if os.path.exists(crc):
        os.remove(crc)
    seen = verify()
    assert seen == {0: False, 1: True, 2: True}
    severities = {r.batch: r.signals[0].severity for r in spark.read.parquet(f"{tmp_path}/out").where("known_ioc").collect()}
    assert severities == {1: "low", 2: "high"}
    assert {r.batch: r.version for r in pinned_versions(spark, f"{tmp_path}/out").collect()} == {0: -1, 1: 0, 2: 1}
