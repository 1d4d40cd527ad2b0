"""HTTP responses as a Spark data source in Python ("http_rows"): one row per URL, fetched on executors."""

from __future__ import annotations

import base64
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlencode

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Url(InputPartition):
    url: str

    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


def request(url: str, options: dict[str, str]) -> urllib.request.Request:
    """A GET with basic, bearer or key authentication, the key in a header or in the query."""
    kind, headers = options.get("auth", "none"), {}
    if kind == "basic":
        headers["Authorization"] = "Basic " + base64.b64encode(f"{options['user']}:{options['password']}".encode()).decode()
    elif kind == "bearer":
        headers["Authorization"] = f"Bearer {options['token']}"
    elif kind == "api_key" and options.get("keyin", "header") == "header":
        headers[options.get("keyname", "X-API-Key")] = options["key"]
    elif kind == "api_key":
        url += ("&" if "?" in url else "?") + urlencode({options.get("keyname", "api_key"): options["key"]})
    elif kind != "none":
        raise ValueError(f"unknown authentication {kind!r}")
    return urllib.request.Request(url, headers=headers)


class HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        if not options.get("urls"):
            raise ValueError("option urls is required")

    def partitions(self) -> list[InputPartition]:
        return [Url(u.strip()) for u in self.options["urls"].split(",") if u.strip()]

    def read(self, partition: Url) -> Iterator[tuple]:
        try:
            with urllib.request.urlopen(request(partition.url, self.options), timeout=float(self.options.get("timeout", 30))) as answer:
                yield partition.url, answer.status, answer.headers.get("Content-Type"), answer.read(), None
        except OSError as e:
            yield partition.url, None, None, None, str(e)


class HttpRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_rows"

    def schema(self) -> str:
        return "url string, status int, content_type string, body binary, error string"

    def reader(self, schema: StructType) -> HttpReader:
        return HttpReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpRows)
