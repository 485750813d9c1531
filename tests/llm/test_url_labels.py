"""No rule host is left out in silence."""

import pytest

from disarm.llm.url_filter import filter_urls


def test_hosts_of_too_many_labels_are_an_error(spark):
    hosts = [".".join(["a"] * n) for n in range(1, 131)]
    pages = spark.createDataFrame([(f"http://{h}/",) for h in hosts[:127]], "url string")
    rules = lambda part: spark.createDataFrame([(h, "/", "deny") for h in part], "host string, path string, verdict string")
    with pytest.raises(ValueError, match="130 labels"):
        filter_urls(pages, rules(hosts)).collect()
    assert [r.verdict for r in filter_urls(pages, rules([hosts[126]])).collect()].count("deny") == 1
