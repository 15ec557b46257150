"""Crawl records from the outcomes of fetches: responses, errors and addresses that robots.txt bars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from siteloom.functions import html as H
from siteloom.functions import url as U
from siteloom.operators.gates import ROBOTS
from siteloom.sources.pages import header_flags
from siteloom.sources.schema import conformed

# The reason phrases registered for HTTP.
REASONS = {
    100: "Continue", 101: "Switching Protocols", 102: "Processing", 200: "OK", 201: "Created", 202: "Accepted", 203: "Non Authoritative Information", 204: "No Content", 205: "Reset Content", 206: "Partial Content",
    207: "Multi-Status", 208: "Already Reported", 226: "IM Used", 300: "Multiple Choices", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 305: "Use Proxy", 307: "Temporary Redirect", 308: "Permanent Redirect",
    400: "Bad Request", 401: "Unauthorized", 402: "Payment Required", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 406: "Not Acceptable", 407: "Proxy Authentication Required", 408: "Request Timeout", 409: "Conflict", 410: "Gone",
    411: "Length Required", 412: "Precondition Failed", 413: "Payload Too Large", 414: "URI Too Long", 415: "Unsupported Media Type", 416: "Range Not Satisfiable", 417: "Expectation Failed", 418: "I'm a teapot", 421: "Misdirected Request",
    422: "Unprocessable Entity", 423: "Locked", 424: "Failed Dependency", 426: "Upgrade Required", 428: "Precondition Required", 429: "Too Many Requests", 431: "Request Header Fields Too Large", 451: "Unavailable For Legal Reasons",
    500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout", 505: "HTTP Version Not Supported", 506: "Variant Also Negotiates", 507: "Insufficient Storage", 508: "Loop Detected",
    510: "Not Extended", 511: "Network Authentication Required",
}
NO_RESPONSE = "No response"


@F.pandas_udf(ArrayType(StringType()))
def _link_canonicals(value: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([H.header_canonicals(v, b) if v else [] for v, b in zip(value, base)], dtype=object)


def fetch_records(fetches: DataFrame, scope: tuple[str, ...] = (), context: str = "") -> DataFrame:
    """Records of `fetches` (url, final_url, root_url, depth, status_code, headers map of lower-cased names, body string, error,
    blocked boolean, response_time_ms; `scope` and further record columns are kept), null status_code: no response.

    A response has its reason phrase, headers and hashes of its body; a body of no bytes has none. An error has the error's
    text, a barred address the reason in its place. Hashes are SHA-256: equal for equal bodies only. `context` names what a
    content hash covers; hashes of other contexts are not comparable.
    """
    barred = F.coalesce(F.col("blocked"), F.lit(False))
    seen = ~barred & F.col("status_code").isNotNull()
    ok = F.col("status_code").between(200, 299)
    header = lambda n: F.nullif(F.trim(F.col("headers")[n]), F.lit(""))
    has_body = seen & (F.octet_length("body") > 0)
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    # Only responses with a Link header pass through Python.
    linked = fetches.withColumn("_links", _link_canonicals(F.when(seen, F.col("headers")["link"]), F.col("final_url")))
    why = F.when(barred, ROBOTS).when(seen, F.when(ok, "Indexable").otherwise(F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))).otherwise(NO_RESPONSE)
    columns = {
        "storage_key": F.col("final_url"), "classification": F.when(F.coalesce(U.host(F.lower("final_url")) == U.host(F.lower("root_url")), F.lit(False)), "internal").otherwise("external"),
        "status_code": F.when(seen, F.col("status_code")).cast("int"), "status_text": F.when(barred, ROBOTS).when(seen, F.coalesce(reason[F.col("status_code")], F.lit(""))).otherwise(NO_RESPONSE), "content_type": F.when(seen, header("content-type")),
        "indexability": F.when(seen & ok, "Indexable").otherwise("Non-indexable"), "indexability_status": why, "response_time_ms": F.when(barred, 0).otherwise(F.coalesce("response_time_ms", F.lit(0))).cast("bigint"),
        "size_bytes": F.when(has_body, F.octet_length("body")).when(seen, F.coalesce(F.expr("try_cast(headers['content-length'] as bigint)"), F.lit(0))).otherwise(0).cast("bigint"),
        "response_hash": F.when(has_body, F.sha2("body", 256)), "content_hash": F.when(has_body & ok, F.sha2("body", 256)), "content_hash_context": F.when(has_body & ok, F.lit(context)),
        "x_robots_tag": F.when(seen, header("x-robots-tag")), "canonical": F.get("_links", F.lit(0)), "canonical_count": F.size("_links").cast("bigint"),
        "error": F.when(barred, ROBOTS).when(~seen, F.col("error")).otherwise(F.col("error")), **{k: F.coalesce(seen & c, F.lit(False)) for k, c in header_flags(F.col("headers")).items()},
    }
    return conformed(linked.withColumns(columns), scope)
