"""Failing documents as rows, failing jobs traced to a document, failures of the cluster raised."""

import pytest
from pyspark.sql import functions as F

from streamatlas.plans import build
from streamatlas.sources import adapters, isolation

PAGES = "url string, part int, body string"


def words():
    """A source's function, made here so that it is sent to the workers as it is."""

    def by_function(url, part, body):
        for word in body.split():
            yield {"title": word, "source_page_url": url, "target_url": f"https://h.example/{100 // (len(word) - 3)}.m3u8"}

    return by_function


def by_frame(pages):
    n = F.col("body").cast("int")
    return adapters._rows(pages.select("url", "body"), k2=n, title=F.col("body"), source_page_url=F.col("url"), target_url=F.col("url"), predisc_key=F.lit(None))


def test_documents_that_fail_become_rows(spark):
    pages = spark.createDataFrame([("u1", 0, "harbour bay-cam"), ("u2", 0, "quay one pier"), ("u3", 1, "two"), ("u4", 0, None), ("u5", 0, "")], PAGES)
    rows = isolation.document_source(words())(pages)
    good = [(r.source_page_url, r.title, r.k2, r.k3, r.predisc_key) for r in rows.where("error is null").orderBy("k1", "k3").collect()]
    assert good == [("u1", "harbour", 0, 0, "hls:https://h.example/25.m3u8"), ("u1", "bay-cam", 0, 1, "hls:https://h.example/25.m3u8")]
    told = [tuple(r) for r in isolation.error_rows(rows, "s").orderBy("url").collect()]
    assert [r[:4] for r in told] == [("s", "u2", 0, "ZeroDivisionError"), ("s", "u3", 1, "ZeroDivisionError")]


def test_messages_lose_credentials_and_queries(spark):
    def leaky(url, part, body):
        raise ValueError("GET https://api.example/x?key=SECRET&y=1 failed, api_key=OTHER " + "z" * 200)

    pages = spark.createDataFrame([("u1", 0, "x")], PAGES)
    detail = isolation.error_rows(isolation.document_source(leaky)(pages), "s").first().detail
    assert "SECRET" not in detail and "OTHER" not in detail


@pytest.mark.parametrize("bad", [[17], [30, 31]])
def test_isolate_finds_a_document(spark, bad):
    pages = spark.createDataFrame([(f"u{k}", 0, "x" if k in bad else str(k)) for k in range(40)], PAGES)
    found = isolation.isolate(pages, by_frame, "s", RuntimeError("job")).collect()
    assert len(found) == 1 and found[0].url in {f"u{k}" for k in bad} and found[0].error == "CAST_INVALID_INPUT"


def test_isolate_without_a_single_culprit(spark):
    def together(pages):
        if pages.count() > 3:
            raise RuntimeError("too many pages")
        return pages

    pages = spark.createDataFrame([(f"u{k}", 0, "1") for k in range(9)], PAGES)
    found = isolation.isolate(pages, together, "s", RuntimeError("too many pages")).collect()
    assert [(r.url, r.error) for r in found] == [(None, "RuntimeError")]


def test_failures_of_the_cluster_are_raised(spark):
    def lost(pages):
        raise RuntimeError("Job aborted due to stage failure: ExecutorLostFailure (executor 3 exited)")

    pages = spark.createDataFrame([("ozolio", "u1", 0, "x")], "source string, " + PAGES)
    with pytest.raises(RuntimeError, match="ExecutorLostFailure"):
        build.discover(pages, ["ozolio"], {"ozolio": lost})


def test_one_bad_document_makes_its_source_crash(spark):
    pages = spark.createDataFrame([("ozolio", "u1", 0, "harbour"), ("ozolio", "u2", 0, "one"), ("explore", "u3", 0, "5")], "source string, " + PAGES)
    candidates, crashed, quarantine = build.discover(pages, ["ozolio", "explore"], {"ozolio": isolation.document_source(words()), "explore": by_frame})
    assert crashed == ("ozolio",) and [r.source for r in candidates.collect()] == ["explore"]
    assert [(r.source, r.url) for r in quarantine.collect()] == [("ozolio", "u2")]
