"""Not-modified revisits of web archives, resolved by an as-of join.

A capture is a full response (status 200, with a body) or a revisit (304, without). A
revisit takes the body of the latest earlier full response of its canonical url. The
validators it carries must agree with that response: an etag by weak comparison, else a
last-modified date. Headers of a not-modified response that may renew a stored one
replace its headers of that name; all others stay as stored.

The latest earlier response is found in steps, so a url may have any share of the
captures: captures of one second are aggregated, seconds of a stretch of time that have a
capture are put in order by a window, of at most STRETCH rows, and from earlier stretches
comes the last response of each, of which there is a row per url and stretch.

Defined results: captures without time, or whose url is null, does not begin with a scheme
or has no host, are resolved to nothing (``no_response``);
a response at the very time of a revisit counts as earlier; of several responses at one
time the largest capture_id counts; a null body is a response all the same; null headers
are none. Equal rows are captures of their own, each told by its place (ROW): captures
may share a capture_id or have none.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.shared import ROW, numbered
from rollbook.sources.staging import stage

#: Headers that a not-modified response may renew (public HTTP semantics).
RENEWED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that tell visitors apart and not pages.
TRACKING = "utm_[^=&]*|ref|fbclid|gclid"
FULL, NOT_MODIFIED = 200, 304
#: Seconds in a stretch of time.
STRETCH = 86_400


def canonical(url: Column) -> Column:
    """A url without scheme, www, default port, fragment, tracking and trailing slash.

    Blanks and control characters around a url and line ends and tabs within are no part
    of it. Host in lower case, parameters in order; null for what does not begin with a
    scheme and ``://`` or has no host.
    """
    url = F.regexp_replace(url, r"[\t\n\r]+|^[\x00-\x20]+|[\x00-\x20]+$", "")
    begins = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_extract(url, begins + "([^#]*)", 1)
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = (
        F.when(scheme == "http", F.regexp_replace(host, ":80$", ""))
        .when(scheme == "https", F.regexp_replace(host, ":443$", ""))
        .otherwise(host)
    )
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    asked = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    kept = F.array_sort(
        F.filter(asked, lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})(?:=|$)"))
    )
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when((scheme != "") & (host != ""), F.concat(host, path, query))


def resolve(captures: DataFrame, stretch: int = STRETCH, placed: bool = False) -> DataFrame:
    """Per revisit: capture_id, url_key, at, response_id, status, body and headers.

    ``captures`` has capture_id, url, at (seconds), status, etag, modified, body and
    headers, a map with names in lower case. ``status`` is resolved, mismatch (the
    validators tell of another response) or no_response; only resolved rows have a body.
    ``placed`` says that they have ROW too, which tells full responses apart; others are
    written to the shared folder first.
    """
    if not placed:
        columns = ["capture_id", "url", "at", "status", "etag", "modified", "body", "headers"]
        captures = numbered(captures, *columns)
    rows = captures.select(
        *ROW,
        "capture_id",
        canonical(F.col("url")).alias("url_key"),
        "at",
        F.floor(F.col("at") / stretch).alias("stretch"),
        (F.col("status") == FULL).alias("full"),
        "etag",
        "modified",
        F.when(F.col("status") == NOT_MODIFIED, F.col("headers")).alias("fresh"),
    ).filter(F.col("full") | (F.col("status") == NOT_MODIFIED))
    key = stage(rows, "captures")
    own = F.when(F.col("full"), F.struct("at", "capture_id", *ROW))
    timed = key.filter("url_key IS NOT NULL AND at IS NOT NULL")
    # one row per url and second: its best response, or the latest of the stretch before it
    seconds = timed.groupBy("url_key", "stretch", "at").agg(F.max(own).alias("_own"))
    order = Window.partitionBy("url_key", "stretch").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = seconds.withColumn("_near", F.last("_own", ignorenulls=True).over(upto))
    # the last response of each stretch, carried over to later stretches of the url
    lasts = seconds.groupBy("url_key", "stretch").agg(F.max("_own").alias("_last"))
    past = Window.partitionBy("url_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(
        F.col("url_key").alias("_key"),
        F.col("stretch").alias("_stretch"),
        F.last("_last", ignorenulls=True).over(past).alias("_far"),
    )
    known = near.join(
        carried, (F.col("url_key") == F.col("_key")) & (F.col("stretch") == F.col("_stretch"))
    ).select(
        "_key", F.col("at").alias("_at"), F.coalesce("_near", "_far").alias("_found")
    )
    asked = timed.filter("NOT full").join(
        known, (F.col("url_key") == F.col("_key")) & (F.col("at") == F.col("_at"))
    )
    # the columns go along: no capture_id has to tell a revisit from others
    told = ["capture_id", "url_key", "at", "etag", "modified", "fresh"]
    found = asked.select(*told, "_found")
    untimed = key.filter("NOT full AND (url_key IS NULL OR at IS NULL)").select(*told)
    revisits = found.unionByName(untimed, allowMissingColumns=True).select(
        *told,
        F.col("_found").isNotNull().alias("_met"),
        F.col("_found.capture_id").alias("response_id"),
        *[F.col(f"_found.{c}").alias(f"_{c}") for c in ROW],
    )
    stored = captures.filter(F.col("status") == FULL).select(
        *[F.col(c).alias(f"_its_{c}") for c in ROW],
        F.col("etag").alias("_etag"),
        F.col("modified").alias("_modified"),
        F.col("body").alias("_body"),
        F.col("headers").alias("_headers"),
    )
    place = [F.col(f"_{c}") == F.col(f"_its_{c}") for c in ROW]
    met = revisits.join(stored, place, "left")

    def weak(tag: str) -> Column:
        return F.regexp_replace(tag, "^W/", "")

    agrees = (
        F.when(F.col("etag").isNotNull(), F.coalesce(weak("etag") == weak("_etag"), F.lit(False)))
        .when(F.col("modified").isNotNull(), F.coalesce(F.col("modified") == F.col("_modified"), F.lit(False)))
        .otherwise(F.lit(True))
    )
    status = (
        F.when(~F.col("_met"), "no_response")
        .when(agrees, "resolved")
        .otherwise("mismatch")
    )
    none = F.create_map().cast("map<string,string>")
    renewed = F.map_filter(F.coalesce("fresh", none), lambda k, v: k.isin(RENEWED))
    kept = F.map_filter(
        F.coalesce("_headers", none), lambda k, v: ~F.map_contains_key(renewed, k)
    )
    resolved = status == "resolved"
    return met.select(
        "capture_id",
        "url_key",
        "at",
        "response_id",
        status.alias("status"),
        F.when(resolved, F.col("_body")).alias("body"),
        F.when(resolved, F.map_concat(kept, renewed)).alias("headers"),
    )


def captures_of(pages: DataFrame, stored: bool = False) -> DataFrame:
    """Captures drawn from pages: each page's full response and a later revisit of it.

    Times, validators and headers follow from page_id alone: pages with one canonical url
    are visits of one resource. One revisit in five carries the etag of another response,
    one in three only a date, and one in seven comes before any response of its page.
    Both have ROW, the place of the page.
    """
    base = numbered(pages, "page_id", "url", "html", stored=stored).filter("page_id IS NOT NULL")
    at = F.col("page_id") * 977 % 8_640_000
    etag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    day = F.concat(F.lit("day "), F.expr("page_id div 100").cast("string"))

    def headers(**values: Column) -> Column:
        flat = [x for k, v in values.items() for x in (F.lit(k.replace("_", "-")), v.cast("string"))]
        return F.create_map(*flat)

    full = base.select(
        *ROW,
        (F.col("page_id") * 2).alias("capture_id"),
        "url",
        at.alias("at"),
        F.lit(FULL).alias("status"),
        etag.alias("etag"),
        day.alias("modified"),
        F.col("html").alias("body"),
        headers(
            etag=etag, date=at, content_type=F.lit("text/html"), content_length=F.length("html")
        ).alias("headers"),
    )
    later = F.when(F.col("page_id") % 7 == 3, at - 500).otherwise(at + 86_400 * (F.col("page_id") % 4))
    told = F.when(F.col("page_id") % 5 == 2, F.lit('"other"')).when(
        F.col("page_id") % 3 == 0, F.lit(None)
    ).otherwise(F.concat(F.lit("W/"), etag))
    again = base.select(
        *ROW,
        (F.col("page_id") * 2 + 1).alias("capture_id"),
        "url",
        later.alias("at"),
        F.lit(NOT_MODIFIED).alias("status"),
        told.alias("etag"),
        day.alias("modified"),
        F.lit(None).cast("string").alias("body"),
        headers(date=later, cache_control=F.lit("max-age=60"), content_length=F.lit(0)).alias("headers"),
    )
    return full.unionByName(again)
