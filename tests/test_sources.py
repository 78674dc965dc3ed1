"""URL tables in text formats: what is accepted, what is rejected and how."""

import pytest

from urlrisk.sources.urls import read_urls


def both(frames):
    return [sorted(map(tuple, f.collect()), key=str) for f in frames]


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('1,http://a.com\n2,\nx3,http://b.com\n4,"http://c.com/?a=1,2"\n5,"   "\n')
    good, bad = both(read_urls(spark, f"{tmp_path}/t.csv", "csv"))
    assert good == [(1, "http://a.com"), (4, "http://c.com/?a=1,2"), (5, "   ")] and bad == sorted([(2, None), (None, "x3,http://b.com")], key=str)


def test_csv_with_header_and_text_ids(spark, tmp_path):
    (tmp_path / "t.csv").write_text("key;link\na;http://a.com\nb;\n")
    good, bad = both(read_urls(spark, f"{tmp_path}/t.csv", "csv", url_col="link", id_col="key", id_type="string", header=True, sep=";"))
    assert good == [("a", "http://a.com")] and bad == [("b", None)]


def test_json(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"url_id": 1, "url": "http://a.com", "more": 2}\n{"url_id": 2}\n{"url_id": 3, "url": ""}\n{"url_id": 4, "url": \n{"url_id": "five", "url": "http://b.com"}\n')
    good, bad = both(read_urls(spark, f"{tmp_path}/t.json", "json"))
    assert good == [(1, "http://a.com")]
    assert bad == sorted([(2, None), (3, ""), (None, '{"url_id": 4, "url": '), (None, '{"url_id": "five", "url": "http://b.com"}')], key=str)


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_empty_tables(spark, tmp_path, fmt):
    spark.createDataFrame([], "url_id long, url string").write.format(fmt).save(f"{tmp_path}/{fmt}")
    assert both(read_urls(spark, f"{tmp_path}/{fmt}", fmt)) == [[], []]
