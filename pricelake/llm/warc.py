"""WARC archives: writing pages with revisit records, and reading them back by boundary chains.

Writing: a record per page, in uncompressed archives made by Spark's text writer (records end with
an empty line pair, which is the writer's separator). Pages with equal payloads of at least
``REVISIT_BYTES`` bytes are stored once, at the largest page id; the others become revisit records.

Reading: archives are split anywhere. Every occurrence of the magic line starts a segment; a
segment with a readable header is a candidate record, whose length names its successor's offset.
Offsets come from the octets of each split, summed over the splits of a file, so no task sees more
of an archive than a split. Segments of a split that follow one another's links form runs; pointer
jumping over the runs, from the start of each file, keeps only what is reachable, so a magic line or
a whole record inside a payload is not taken for a record. A record that holds several segments is
put together again.

Defined cases: a null html is an empty payload; a null page id gives a record under a digest instead
of a page's name, never a revisit; rows that share the largest id of a payload are all responses; a
very long payload is one record, held whole by one task; extra columns are ignored, whatever their
names; an empty table gives an empty archive and no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, written

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
REVISIT_BYTES = 1000
#: Repeated payloads that may be broadcast (32 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
URN = "urn:page:"


def _octets(c: Column) -> Column:
    return F.octet_length(c).cast("long")


def write_archives(pages: DataFrame, path: str, at: Column | None = None) -> None:
    """Writes page_id, url, html as WARC files under path, each with a warcinfo record first; at is the time of capture, else now."""
    html = F.coalesce(F.col("html"), F.lit(""))
    digested = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), _octets(html).alias("bytes"))
    groups = digested.where(f"bytes >= {REVISIT_BYTES} AND page_id IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("first"), F.min("page_id").alias("least")).where("least < first").select(F.unhex("digest").alias("d"), "first")
    groups = written(groups, "payloads")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    placed = digested.join(groups, (F.unhex("digest") == F.col("d")) & (F.col("bytes") >= REVISIT_BYTES), "left")
    revisit = F.coalesce(F.col("page_id") < F.col("first"), F.lit(False))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), c.cast("string"), F.lit(">"))
    date = F.date_format(F.to_utc_timestamp(F.current_timestamp() if at is None else at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:sha1:"), F.sha1(F.concat_ws(" ", "url", "digest").cast("binary")), F.lit(">")))
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), c, F.lit("\r\n")), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name),
        line("WARC-Date", date),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("first")))),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        _octets(block).cast("string"),
        F.lit(END),
        block,
    )
    about = "software: pricelake\r\nformat: WARC File Format 1.0\r\n"
    file_id = F.concat(F.lit("<urn:file:"), F.spark_partition_id().cast("string"), F.lit(">"))
    info = F.concat(F.lit(MAGIC), line("WARC-Type", F.lit("warcinfo")), line("WARC-Record-ID", file_id), line("WARC-Date", date), F.lit(f"Content-Type: application/warc-fields\r\nContent-Length: {len(about)}{END}{about}{END}"))
    # A task writes one file; the lower 33 bits number its rows.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    placed.select(F.concat(F.when(first, info).otherwise(""), record).alias("value")).write.option("lineSep", END).text(path)


def _field(header: str, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _parsed(value: str) -> dict[str, Column]:
    """What a whole record's text after the magic says; value ends with END."""
    v = F.col(value)
    rest = F.substr(v, F.length("header") + 5)
    http = F.substring_index(rest, END, 1)
    payload = F.substr(rest, F.length(http) + 5, F.greatest(F.length(rest) - F.length(http) - 8, F.lit(0)))
    return {"payload": payload, "http_bytes": F.regexp_extract(http, r"(?im)^content-length:[ \t]*(\d+)", 1).try_cast("long")}


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block, seq: the text between occurrences of the magic, in order."""
    return spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))


def _in_split():
    return Window.partitionBy("file", "block").orderBy("seq")


def _earlier_splits():
    """The splits of a file before one; a file has few."""
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _placed(found: DataFrame) -> DataFrame:
    """Segments with the offset of the magic before each; what stands before a file's first magic is left out."""
    size = F.col("octets") + len(MAGIC)
    splits = found.groupBy("file", "block").agg(F.sum(size).alias("size"))
    base = splits.select("file", "block", F.sum("size").over(_earlier_splits()).alias("base"))
    inside = F.sum(size).over(_in_split().rowsBetween(Window.unboundedPreceding, -1))
    placed = found.join(base, ["file", "block"]).withColumn("after", F.coalesce("base", F.lit(0)) + F.coalesce(inside, F.lit(0)))
    return placed.where("after > 0").withColumn("offset", F.col("after") - len(MAGIC)).drop("after", "base")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """A row for each occurrence of the magic: file, place, header, octets, link (octets to the successor), whole or else its text."""
    raw = _raw(spark, path)
    header = F.substring_index("value", END, 1)
    cut = raw.withColumn("octets", _octets(F.col("value"))).withColumn("header", F.when(F.col("value").startswith("WARC-") & F.contains("value", F.lit(END)), header))
    length = _field("header", "content-length").try_cast("long")
    linked = cut.withColumn("link", F.when(_field("header", "warc-type").isNotNull(), len(MAGIC) + _octets(F.col("header")) + length + 2 * len(END)))
    whole = F.coalesce(F.col("link") == F.col("octets") + len(MAGIC), F.lit(False))
    facts = _parsed("value")
    digest = F.when(whole, F.sha1(facts["payload"].cast("binary")))
    return linked.select("file", "block", "seq", "octets", "header", "link", whole.alias("whole"), digest.alias("digest"), F.when(whole, _octets(facts["payload"])).alias("bytes"), F.when(whole, facts["http_bytes"]).alias("http_bytes"), F.when(~whole, F.col("value")).alias("value"))


def reachable(runs: DataFrame) -> DataFrame:
    """file, run of the runs (file, run, start, next) that are reached from offset 0, by pointer jumping."""
    links = runs.select("file", "run", F.col("next")).join(runs.select("file", F.col("run").alias("to"), F.col("start").alias("next")), ["file", "next"]).select("file", "run", "to")
    links = written(links, "links")
    reached = runs.where("start = 0").select("file", "run")
    n = reached.count()
    while links.limit(1).count():
        reached = written(reached.union(reached.join(links, ["file", "run"]).select("file", "to")).distinct(), "reached")
        now = reached.count()
        if now == n:
            break
        n = now
        links = written(links.join(links.select("file", F.col("run").alias("to"), F.col("to").alias("end")), ["file", "to"]).select("file", "run", F.col("end").alias("to")), "links")
    return reached


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, type, refers_to, target, payload_bytes, payload_digest of every record in the archives under path."""
    found = written(segments(spark, path), "segments")
    placed = _placed(found).withColumn("next", F.col("offset") + F.col("link")).withColumn("follower", F.col("offset") + len(MAGIC) + F.col("octets"))
    leaps = placed.where("next <> follower").select("file", F.col("next").alias("offset")).distinct().withColumn("target", F.lit(True))
    before = F.lag("next").over(_in_split())
    head = F.col("target").isNotNull() | ~F.coalesce(before == F.col("offset"), F.lit(False))
    numbered = placed.join(leaps, ["file", "offset"], "left").withColumn("head", head)
    chained = numbered.withColumn("run", F.struct("block", F.sum(F.col("head").cast("long")).over(_in_split()).alias("n"))).drop("target", "head")
    runs = written(chained.groupBy("file", "run").agg(F.min("offset").alias("start"), F.max_by("next", "offset").alias("next")), "runs")
    kept = reachable(runs).withColumn("reached", F.lit(True))
    marked = chained.join(kept, ["file", "run"], "left").withColumn("own", F.when(F.col("reached") & F.col("header").isNotNull(), F.col("offset")))
    # The record that a segment belongs to starts in its split or in the last one before that has any.
    carried = marked.groupBy("file", "block").agg(F.max("own").alias("own")).select("file", "block", F.max("own").over(_earlier_splits()).alias("carried"))
    inside = F.max("own").over(_in_split().rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.join(carried, ["file", "block"]).withColumn("record", F.coalesce(inside, "carried")).drop("own", "carried")
    # Whole records inside a payload, whose text was not kept: those files are read once more.
    inner = marked.where("record IS NOT NULL AND reached IS NULL AND whole").select("file", "offset")
    if inner.limit(1).count():
        inner = written(inner, "inner")
        again = _placed(_raw(spark, path).join(inner.select("file").distinct(), "file", "left_semi").withColumn("octets", _octets(F.col("value"))))
        text = inner.join(again.select("file", "offset", F.col("value").alias("again")), ["file", "offset"])
        marked = marked.join(text, ["file", "offset"], "left").withColumn("value", F.coalesce("value", "again")).drop("again")
    single = marked.where("reached AND header IS NOT NULL AND whole")
    # Records with the magic inside: their own segment, and the unreached ones up to their end.
    several = marked.where("record IS NOT NULL AND NOT (coalesce(reached, false) AND whole)").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("offset", "octets", "value"))).alias("parts"), F.min_by("header", "offset").alias("header"), F.min_by("link", "offset").alias("link"), F.min("offset").alias("offset")).where("offset = record")
    joined = several.withColumn("text", F.expr(f"array_join(transform(parts, x -> x.value), 'WARC/1.0\r\n')")).where(_octets(F.col("text")) + len(MAGIC) == F.col("link"))
    facts = _parsed("text")
    joined = joined.withColumn("payload", facts["payload"]).withColumn("http_bytes", facts["http_bytes"]).withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("bytes", _octets(F.col("payload")))
    both = single.select("header", "digest", "bytes", "http_bytes").unionByName(joined.select("header", "digest", "bytes", "http_bytes"))
    kind = F.lower(_field("header", "warc-type"))
    return both.select(
        _field("header", "warc-record-id").alias("record_id"),
        kind.alias("type"),
        _field("header", "warc-refers-to").alias("refers_to"),
        _field("header", "warc-target-uri").alias("target"),
        F.when(kind == "revisit", F.col("http_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(kind == "revisit", F.regexp_extract(_field("header", "warc-payload-digest"), "(?i)^sha1:(.*)$", 1)).otherwise(F.col("digest")).alias("payload_digest"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written for the purpose."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(pages, path)
    page = lambda c: F.regexp_extract(c, rf"{URN}(-?\d+)", 1).try_cast("long")
    return read_archives(spark, path).where("type <> 'warcinfo'").select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT payload_digest AS g, max(page_id) AS first FROM d WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to FROM d LEFT JOIN m ON g = payload_digest AND payload_bytes >= {REVISIT_BYTES}
"""
