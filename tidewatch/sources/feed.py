"""A data source of HTTP feeds and pages: ``spark.read.format("web_page").option("urls", ...)``. It needs a network to be of use."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AGENT = "tidewatch-feed/1.0"
SCHEMA = "url string, final_url string, status int, content_type string, body string, error string"


class _Url(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.timeout, self.retries, self.delay = float(options.get("timeout", 8)), int(options.get("retries", 2)), float(options.get("delay", 1))
        self.most, self.html_only = int(options.get("max_bytes", 500_000)), options.get("html_only", "false") == "true"

    def partitions(self):
        return [_Url(u) for u in self.urls]

    def read(self, partition: _Url) -> Iterator[tuple]:
        """SRC19: retries with a delay that grows by the attempt."""
        from urllib.request import Request, urlopen

        error = None
        for attempt in range(self.retries + 1):
            if attempt:
                time.sleep(self.delay * attempt)
            try:
                with urlopen(Request(partition.url, headers={"User-Agent": AGENT}), timeout=self.timeout) as r:
                    kind = r.headers.get("content-type", "")
                    if self.html_only and "html" not in kind.lower():
                        yield partition.url, r.url, r.status, kind, None, "non_html_content_type"
                        return
                    yield partition.url, r.url, r.status, kind, r.read(self.most).decode(r.headers.get_content_charset() or "utf-8", "replace"), None
                    return
            except Exception as e:  # any failure is data
                error = str(e)
        yield partition.url, None, None, None, None, error


class WebPages(DataSource):
    """SRC2, SRC18, SRC20: one row for each URL, its body or what went wrong."""

    @classmethod
    def name(cls) -> str:
        return "web_page"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(WebPages)
