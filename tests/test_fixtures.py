"""The derived inputs keep every row and whole texts."""

import pytest

from urlrisk.plans import fixtures
from urlrisk.sources.urls import extract_urls


@pytest.fixture
def folder(spark, tmp_path):
    pages = [(i, f"https://example.com/{i}") for i in range(75)]
    turns = [(i, t, "word " * 30 + f"https://late.test/{i}/{t}") for i in range(40) for t in range(2)] + [(40, 0, None)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_messages_are_whole(spark, folder):
    messages = fixtures.messages(spark, folder)
    assert sorted(r.msg_id for r in messages.collect()) == sorted([i * 1000 + t for i in range(40) for t in range(2)] + [40_000])
    found = {r.url for r in extract_urls(messages).collect()}
    assert {f"https://late.test/{i}/{t}" for i in range(40) for t in range(2)} <= found
    corpus = {r.url.strip(): r.url_id for r in fixtures.url_corpus(spark, folder).collect()}
    assert max(corpus[u] for u in found if u in corpus) > 49
