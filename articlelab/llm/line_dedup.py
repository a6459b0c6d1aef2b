"""Site-relative line deduplication (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articlelab.llm import common as C
from articlelab.llm.common import materialize, small_lookup, value_bytes

#: Fixed patterns: markup whose content is not text, and what ends a line.
#: Left open, it reaches to the end of the page.
NOT_TEXT = r"(?is)<script.*?(?:</script>|\z)|<style.*?(?:</style>|\z)|<!--.*?(?:-->|\z)"
LINE_END = r"<[^>]*>|[\r\n]+"
#: Boilerplate lines of a host that a page's lines are compared with one by one.
LIST_LINES = 1000
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; '' when there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def text_lines(html: Column) -> Column:
    """Trimmed, non-empty text lines of a page in order (tags end a line)."""
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), NOT_TEXT, "\n")
    return F.filter(F.transform(F.split(plain, LINE_END), lambda x: F.trim(x)), lambda x: x != "")


def _broadcast_from(boiler: DataFrame) -> tuple[int, bool]:
    """(k, whether that is all): the lines on 2**k pages or more fit a broadcast,
    by measured rows and bytes; the most frequent ones first."""
    steps = boiler.groupBy((F.length(F.bin("_n")) - 1).alias("_k")).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(value_bytes(F.col("_line")) + value_bytes(F.col("host"))).alias("_bytes")).collect()
    least, n, n_bytes = 64, 0, 0  # one row per power of two
    for row in sorted(steps, reverse=True):
        n, n_bytes = n + row["_rows"], n_bytes + row["_bytes"]
        if n > C.BROADCAST_ROWS or n_bytes > C.BROADCAST_BYTES:
            return least, False
        least = row["_k"]
    return least, True


def _without_lines(pages: DataFrame, boiler: DataFrame) -> DataFrame:
    """``pages`` whose ``_kept`` loses the lines of ``boiler``, by a join of single
    lines: (host, line) is the key, nothing is gathered but a page's own lines.
    Equal rows, told by ``_digest``, go through as one group and come out again
    as often as they were there."""
    key = ["page_id", "host", "_n_lines", "_digest"]
    rows = pages.select(*key, F.posexplode_outer("_kept").alias("_at", "_line"))
    right = boiler.select(F.col("host").alias("_b_host"), F.col("_line").alias("_b_line"))
    rows = rows.join(right.hint("merge"), (F.col("host") == F.col("_b_host")) & (F.col("_line") == F.col("_b_line")), "left")
    stays = F.col("_b_host").isNull() & F.col("_at").isNotNull()
    pages = rows.groupBy(*key).agg(
        F.sum(F.when(F.coalesce("_at", F.lit(0)) == 0, 1).otherwise(0)).alias("_times"),
        F.array_sort(F.collect_list(F.when(stays, F.struct("_at", "_line")))).alias("_all"))
    once = F.filter("_all", lambda x, i: i % F.col("_times") == 0)
    return pages.select(*key, F.transform(once, lambda x: x["_line"]).alias("_kept"), F.explode(
        F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_time")).drop("_time")


def site_line_dedup(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                    ratio: float = 0.1, min_pages: int = 2) -> DataFrame:
    """One row per page: ``page_id, host, n_lines, n_dropped, kept_text``.

    A line is boilerplate of its host if the share of the host's pages that
    contain it exceeds ``ratio`` and at least ``min_pages`` pages do. Each page
    names a line once (``array_distinct``), so counting needs no distinct
    shuffle and a line on every page of a huge host is summed on the map side.
    The boilerplate lines are written once and measured. While their rows and
    bytes fit a broadcast they go back to the pages as a list per host, and page
    texts are not shuffled. Beyond that only the most frequent ones do, and the
    rest meets the single lines of the pages under (host, line), as do the lines
    of a host that has over ``LIST_LINES`` of them.

    Null or host-less URLs share the host ''; null or empty pages have no
    lines and an empty kept text; repeated rows count as pages of their own;
    an empty table gives no rows; other columns are not read."""
    lined = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                         text_lines(F.col(html_col)).alias("_lines"))
    per_host = lined.groupBy("host").agg(F.count(F.lit(1)).alias("_pages"))
    counts = lined.select("host", F.explode(F.array_distinct("_lines")).alias("_line")).groupBy("host", "_line").agg(
        F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_pages)
    boiler = materialize(small_lookup(counts, per_host, ["host"], salt_by=F.col("_line")).filter(
        F.col("_n") / F.col("_pages") > ratio).select("host", "_line", "_n"), "boilerplate")
    least, whole = _broadcast_from(boiler)
    long = boiler.groupBy("host").agg(F.count(F.lit(1)).alias("_list")).filter(F.col("_list") > LIST_LINES)
    if not long.isEmpty():
        boiler = small_lookup(boiler, long, ["host"], salt_by=F.col("_line"))
        whole = False
    else:
        boiler = boiler.withColumn("_list", F.lit(None).cast("long"))
    often = (F.col("_n") >= F.lit(2.0) ** least) & F.col("_list").isNull()
    lists = boiler.filter(often).groupBy("host").agg(F.collect_list("_line").alias("_boiler"))
    kept = F.filter("_lines", lambda x: ~F.array_contains(F.coalesce("_boiler", F.array().cast("array<string>")), x))
    out = lined.join(F.broadcast(lists), "host", "left").withColumn("_kept", kept).withColumn("_n_lines", F.size("_lines"))
    if not whole:
        out = _without_lines(out.withColumn("_digest", F.sha2(F.array_join("_lines", "\n").cast("binary"), 256)), boiler.filter(~often))
    return out.select("page_id", "host", F.col("_n_lines").cast("long").alias("n_lines"),
                      (F.col("_n_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
                      F.array_join("_kept", "\n").alias("kept_text"))
