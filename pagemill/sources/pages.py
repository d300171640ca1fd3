"""Where pages come from: the parquet corpus, or the web through a Python data source.

The reader of the web is for small batches of addresses (crawls); everything else reads the corpus.
"""

from __future__ import annotations

import http.client
import ssl
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.charset import charset_detect, decode_body

TEXT_TYPES = ("application/json", "application/xhtml+xml", "application/xml", "text/html", "text/plain", "text/xml")
MAX_BYTES = 10 * 1024 * 1024
RESPONSE = "url string, request_url string, status int, success boolean, content_type string, body binary, error string"


@dataclass(frozen=True)
class RequestOptions:
    max_bytes: int = MAX_BYTES
    max_redirects: int = 3
    timeout_ms: int = 10_000
    connect_ms: int = 5_000
    retry: int = 1
    text_only: bool = True
    detect_charset: bool = True
    headers: dict[str, str] = field(default_factory=dict)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores (one small file) is dealt out to all of them; any other is left as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df


def scan_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus: page_id, url, html. Filters and column choices reach the parquet scan."""
    return spark.read.parquet(f"{folder}/pages.parquet")


def content_type_filter(content_type: Column) -> Column:
    """Is it a type that is read as text?"""
    return F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0])).isin(*TEXT_TYPES)


def size_limit(body: Column, most: int = MAX_BYTES) -> Column:
    return F.octet_length(body) <= most


def decoded_pages(responses: DataFrame, options: RequestOptions = RequestOptions(), body: str = "body", content_type: str = "content_type") -> DataFrame:
    """Responses as pages: html, charset and charset_pos instead of the body, and error.

    An answer of another type or size is turned down (html null, an error), as is a body that can't be read (ErrorCharset). A null body without an
    error is an empty answer. An earlier error stays.
    """
    said = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    kind = content_type_filter(F.col(content_type)) if options.text_only else F.lit(True)
    wrong = F.when(~kind, "content type").when(~size_limit(F.col(body), options.max_bytes), "content length")
    found = charset_detect(F.col(body), F.col(content_type)) if options.detect_charset else F.struct(F.lit("UTF-8").alias("charset"), F.lit("").alias("charset_pos"))
    own = [c for c in responses.columns if c not in (body, "error", "html", "charset", "charset_pos")]
    out = responses.select(*own, F.col(body), F.coalesce(said, wrong).alias("_wrong")).withColumn("_c", F.when(F.col("_wrong").isNull() & F.col(body).isNotNull(), found))
    out = out.withColumn("html", F.when(F.col("_c").isNotNull(), decode_body(F.col(body), F.col("_c.charset"))))
    unread = F.when(F.col("_c").isNotNull() & F.col("html").isNull(), "ErrorCharset")
    return out.select(*own, "html", F.coalesce("_c.charset", F.lit("")).alias("charset"), F.coalesce("_c.charset_pos", F.lit("")).alias("charset_pos"), F.coalesce("_wrong", unread).alias("error"))


class _Address(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self, most: int):
        self.max_redirections = most


def _dialling(kind: type, seconds: float) -> type:
    """A connection that gives up dialling after so many seconds; reading has its own time."""

    class Connection(kind):
        def connect(self):
            read, self.timeout = self.timeout, min(seconds, self.timeout)
            super().connect()
            self.timeout = read
            self.sock.settimeout(read)

    return Connection


class _Http(urllib.request.HTTPHandler):
    def __init__(self, seconds: float):
        super().__init__()
        self.connection = _dialling(http.client.HTTPConnection, seconds)

    def http_open(self, req):
        return self.do_open(self.connection, req)


class _Https(urllib.request.HTTPSHandler):
    def __init__(self, seconds: float):
        super().__init__()
        self.connection, self.context = _dialling(http.client.HTTPSConnection, seconds), ssl.create_default_context()

    def https_open(self, req):
        return self.do_open(self.connection, req, context=self.context)


def fetch(url: str, options: RequestOptions) -> tuple:
    """One response row; an error is a value of the row. Certificates are verified."""
    dial = options.connect_ms / 1000
    opener = urllib.request.build_opener(_Redirects(options.max_redirects), _Http(dial), _Https(dial))
    said = ""
    for _ in range(max(1, options.retry)):
        try:
            with opener.open(urllib.request.Request(url, headers=options.headers), timeout=options.timeout_ms / 1000) as r:
                kind = r.headers.get("Content-Type", "")
                if options.text_only and kind.split(";")[0].strip().lower() not in TEXT_TYPES:
                    return (url, r.geturl(), r.status, False, kind, None, "content type")
                body = r.read(options.max_bytes + 1)
                if len(body) > options.max_bytes:
                    return (url, r.geturl(), r.status, False, kind, None, "content length")
                return (url, r.geturl(), r.status, True, kind, body, None)
        except urllib.error.HTTPError as e:
            return (url, e.geturl() or url, e.code, False, e.headers.get("Content-Type", ""), None, str(e))
        except (urllib.error.URLError, OSError, ValueError, http.client.HTTPException) as e:
            said = str(e)
    return (url, url, 0, False, "", None, said)


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], options: RequestOptions):
        self.urls, self.options = urls, options

    def partitions(self):
        return [_Address(u) for u in self.urls]

    def read(self, partition):
        yield fetch(partition.url, self.options)


class HttpSource(DataSource):
    """spark.read.format("pagemill_http").option("urls", "a b").load()"""

    @classmethod
    def name(cls) -> str:
        return "pagemill_http"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema):
        o = self.options
        number = {k: int(o[k]) for k in ("max_bytes", "max_redirects", "timeout_ms", "connect_ms", "retry") if o.get(k) is not None}
        return _Reader(o.get("urls", "").split(), RequestOptions(**number, text_only=o.get("text_only", "true").lower() == "true"))


def http_get(spark: SparkSession, *urls: str, **options) -> DataFrame:
    """Response rows of the addresses, one task each."""
    if not urls or not all(isinstance(u, str) for u in urls):
        raise ValueError("http get params error")
    spark.dataSource.register(HttpSource)
    reader = spark.read.format("pagemill_http").option("urls", " ".join(urls))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def http_do(spark: SparkSession, *urls: str, **options) -> DataFrame:
    """Pages of the addresses: http_get, charset, text. url is the address that answered, request_url the one that was asked."""
    got = http_get(spark, *urls, **options)
    named = {k: v for k, v in options.items() if k in ("max_bytes", "text_only", "detect_charset")}
    pages = decoded_pages(got.withColumn("error", F.when(~F.col("success"), F.col("error"))), RequestOptions(**named))
    return pages.withColumns({"url": F.col("request_url"), "request_url": F.col("url")})
