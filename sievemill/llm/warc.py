"""WARC archives: written by the text sink, read back by boundary-chain verification.

Reading never trusts the magic line alone. Tasks split archives at every ``WARC/1.`` and emit, for each candidate (a version
line 1.0 or 1.1), its offset and the offset its own Content-Length leads to. Pointer jumping from the start of
the file keeps the candidates that the chain reaches; a magic line inside a payload is not among them, whatever header
follows it, and its bytes go back to the record that holds it. Stretches of a file are jumped through one by one, and a far shorter
chain from stretch to stretch joins them, so that no task holds a whole file's offsets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import ROW, SRC, Scratch, identified, split_rows

MAGIC = "WARC/1."
WRITTEN = f"{MAGIC}1\r\n"
END = "\r\n\r\n"
#: Records that the writer puts into one archive file at most.
RECORDS_PER_FILE = 100_000
#: Bytes of a file whose candidates one task jumps through.
STRETCH = 1 << 26
#: Headers the writer adds to a record, fixed values.
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(hex_digest: Column) -> Column:
    """Forty hex digits as 32 upper-case base32 digits: five bytes make eight digits."""
    eights = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*eights), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _clean(url: Column) -> Column:
    """An URL without bytes that would end a header line."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A"), " ", "%20")


def _record(kind: str, body: Column) -> Column:
    """A record less its last line end, which the text sink adds."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, body)
    lines = [
        F.lit(f"{WRITTEN}WARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:"),
        F.regexp_replace(F.md5(F.concat_ws("/", SRC, ROW)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"),
        F.lit(f">\r\nWARC-Date: {DATE}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Page-ID: "), F.col("page_id").cast("string")), F.lit("")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), _clean(F.col("url"))), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
    ]
    if kind == "revisit":
        lines += [
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            F.coalesce(F.concat(F.lit("\r\nWARC-Refers-To-Page-ID: "), F.col("refers_to").cast("string")), F.lit("")),
        ]
    return F.concat(
        *lines,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
        block,
        F.lit(END[:-1]),
    )


def write_warc(
    pages: DataFrame, path: str, scratch: Scratch, *, min_revisit_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE
) -> None:
    """Writes one record for each row of ``pages`` (page_id, url, html) below ``path``.

    Null html is an empty payload. Of rows with equal payloads of at least ``min_revisit_bytes`` bytes the
    one with the largest page_id (a null id is smallest; of equal ids one row) is a response and the others are
    revisits of it without payload. Payloads are equal when their SHA-256 and length are. Payloads never leave the scan's tasks: what is shuffled
    are digests, and the set of revisit rows comes back as bitmaps. Other columns, of any name, are not
    read; an empty table writes no record.
    """
    base = identified(pages, scratch)
    html = F.coalesce("html", F.lit(""))
    slim = scratch.put(
        base.select(SRC, ROW, "page_id", "url", F.octet_length(html).cast("long").alias("payload_bytes"), base32_sha1(F.sha1(html)).alias("payload_digest"), F.unhex(F.sha2(html, 256)).alias("sha")),
        "slim",
    )
    rank = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", SRC, ROW)
    groups = (
        slim.filter(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy("sha", "payload_bytes")
        .agg(F.max(rank).alias("response"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("sha").alias("g_sha"), F.col("payload_bytes").alias("g_bytes"), "response")
    )
    revisits = scratch.put(
        slim.join(groups, (F.col("sha") == F.col("g_sha")) & (F.col("payload_bytes") == F.col("g_bytes")))
        .filter((F.col(f"response.{SRC}") != F.col(SRC)) | (F.col(f"response.{ROW}") != F.col(ROW)))
        .select(SRC, ROW, "page_id", "url", "payload_bytes", "payload_digest", F.col("response.page_id").alias("refers_to")),
        "revisits",
    )
    _, responses = split_rows(
        base.select(SRC, ROW, "page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), base32_sha1(F.sha1(html)).alias("payload_digest")),
        revisits.select(SRC, ROW),
        scratch,
        "revisit-bits",
    )
    for part, rows, kind, body in (("response", responses, "response", F.col("html")), ("revisit", revisits, "revisit", F.lit(""))):
        rows.select(_record(kind, body).alias("value")).write.mode("overwrite").option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(f"{path}/{part}")


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """What follows each magic in the scan's order: file, split_at, nth, rest (bytes) and raw. ``nth`` orders the rows of one split."""
    lines = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    meta = lines.metadataColumn("_metadata")
    return lines.select(
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("split_at"),
        F.monotonically_increasing_id().alias("nth"),
        F.octet_length("value").cast("long").alias("rest"),
        F.col("value").alias("raw"),
    )


def _located(rows: DataFrame) -> DataFrame:
    """Written rows of ``_scan`` with ``off``, where their magic stands in the file (below 0: bytes before the first one).

    Bytes are summed within each split, and then over a file's splits, of which there are few.
    """
    size = F.col("rest") + len(MAGIC)
    inside = F.sum(size).over(W.partitionBy("file", "split_at").orderBy("nth").rowsBetween(W.unboundedPreceding, -1))
    splits = rows.groupBy("file", "split_at").agg(F.sum(size).alias("bytes"))
    before = F.sum("bytes").over(W.partitionBy("file").orderBy("split_at").rowsBetween(W.unboundedPreceding, -1))
    base = splits.select("file", "split_at", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(base, ["file", "split_at"]).withColumn("off", F.col("base") + F.col("inside") - len(MAGIC)).drop("base", "inside")


def _header(head: Column, name: str, value: str = r"[^\r\n]*") -> Column:
    return F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*({value})", 1)


def _parsed(rows: DataFrame) -> DataFrame:
    """``rows`` with the fields of the head in ``raw`` and, of all but revisits, size and digest of the payload.

    Nothing is taken on trust: numbers that don't fit are null, and lengths end with the bytes there are.
    """
    head = F.substring_index("raw", END, 1)
    size = F.least(F.coalesce("length", F.lit(0)), F.octet_length("raw")).cast("int")
    block = F.substring(F.col("raw").cast("binary"), F.col("head_bytes").cast("int") + 5, size)
    http = F.substring_index(F.col("block").cast("string"), END, 1)
    is_http = _header(F.col("head"), "Content-Type").rlike("(?i)^application/http")
    body = F.when(is_http, F.substring(F.col("block"), F.octet_length("http") + 5, F.octet_length("block"))).otherwise(F.col("block"))
    named = _header(F.col("http"), "Content-Length", "[0-9]{1,18}")
    kind = F.nullif(_header(F.col("head"), "WARC-Type"), F.lit(""))
    revisit = F.coalesce(kind == "revisit", F.lit(False))
    return (
        rows.withColumn("head", head)
        .withColumn("head_bytes", F.octet_length("head").cast("long"))
        .withColumn("length", _long(_header(F.col("head"), "Content-Length", "[0-9]{1,18}")))
        .withColumn("block", block)
        .withColumn("http", http)
        .withColumns(
            {
                "record_type": kind,
                "page_id": _long(_header(F.col("head"), "WARC-Page-ID", "-?[0-9]{1,19}")),
                "refers_to": _long(_header(F.col("head"), "WARC-Refers-To-Page-ID", "-?[0-9]{1,19}")),
                "payload_bytes": F.when(revisit, _long(named)).otherwise(F.octet_length(body).cast("long")),
                "payload_digest": F.when(revisit, F.regexp_replace(_header(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "")).otherwise(base32_sha1(F.sha1(body))),
                "candidate": F.col("raw").rlike("^[01]\r\n"),
                "whole": F.coalesce(F.octet_length("raw") == F.col("head_bytes") + 8 + F.col("length"), F.lit(False)),
            }
        )
        .drop("head", "block", "http", "raw")
    )


def _long(text: Column) -> Column:
    return text.try_cast("long")


def _next(off: np.ndarray, succ: np.ndarray) -> np.ndarray:
    """The place of each candidate's successor in ``off`` (rising), len(off) where none stands there."""
    n = len(off)
    at = np.searchsorted(off, succ)
    return np.append(np.where((at < n) & (off[np.minimum(at, n - 1)] == succ), at, n), n)


def _reach(off: np.ndarray, succ: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Pointer jumping: marks what the chains from ``starts`` reach, doubling the stride each round."""
    jump = _next(off, succ)
    reached = np.append(np.isin(off, starts), False)
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        more[-1] = False
        if (more == reached).all():
            return reached[:-1]
        reached, jump = more, jump[jump]


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one stretch: where each candidate's chain leaves it, found by pointer jumping."""
    pdf = pdf.sort_values("off", kind="stable")
    n, jump = len(pdf), _next(pdf["off"].to_numpy(), pdf["succ"].to_numpy())
    leave = np.append(pdf["succ"].to_numpy(), -1)
    while (jump[:n] < n).any():
        leave, jump = np.where(jump < n, leave[np.minimum(jump, n)], leave), jump[jump]
    return pd.DataFrame({"file": pdf["file"], "off": pdf["off"], "leave": leave[:n]})


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one file: the candidates that are entered from another stretch, along the chain from the file's start."""
    pdf = pdf.sort_values("off", kind="stable")
    return pdf.loc[_reach(pdf["off"].to_numpy(), pdf["leave"].to_numpy(), np.array([0])), ["file", "off"]]


def _marks(key, rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """Of one stretch: which rows are real records, and the last real one up to each row (-1: in an earlier stretch, if any)."""
    rows = rows.sort_values("off", kind="stable")
    off, whole, heads = rows["off"].to_numpy(), rows["whole"].to_numpy(), rows["candidate"].to_numpy()
    real = np.zeros(len(rows), bool)
    real[heads] = _reach(off[heads], rows["succ"].to_numpy()[heads], entries["off"].to_numpy())
    owner = np.maximum.accumulate(np.where(real, np.arange(len(rows)), -1)) if len(rows) else np.empty(0, np.int64)
    known = owner >= 0
    return pd.DataFrame(
        {c: rows[c] for c in ("file", "stretch", "split_at", "nth", "off")}
        | {"owner": np.where(known, off[owner], -1), "owner_whole": known & whole[owner], "simple": real & whole}
    )


def _chains(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links (file, split_at, nth, off, succ, candidate, whole)`` with ``simple`` (a real record that is one row) and the ``owner`` of rows of torn ones."""
    links = links.withColumn("stretch", F.floor(F.col("off") / STRETCH))
    heads = links.filter("candidate")
    exits = scratch.put(heads.groupBy("file", "stretch").applyInPandas(_exits, "file string, off long, leave long"), "exits")
    # candidates that some chain enters a stretch by: mostly one for each stretch
    entered = exits.select("file", F.col("leave").alias("off")).filter("off >= 0").distinct()
    starts = exits.join(entered, ["file", "off"], "left_semi").union(exits.filter("off = 0")).distinct()
    entries = scratch.put(starts.groupBy("file").applyInPandas(_entries, "file string, off long"), "entries")
    entries = entries.withColumn("stretch", F.floor(F.col("off") / STRETCH))
    kinds = "file string, stretch long, split_at long, nth long, off long, owner long, owner_whole boolean, simple boolean"
    marked = scratch.put(links.groupBy("file", "stretch").cogroup(entries.groupBy("file", "stretch")).applyInPandas(_marks, kinds), "marked")
    last = marked.filter("owner >= 0").groupBy("file", "stretch").agg(F.max(F.struct("owner", "owner_whole")).alias("o"))
    every = marked.select("file", "stretch").distinct().join(last, ["file", "stretch"], "left")
    earlier = F.last("o", ignorenulls=True).over(W.partitionBy("file").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))
    joined = marked.join(every.select("file", "stretch", earlier.alias("o")), ["file", "stretch"])
    own = F.col("owner") >= 0
    owner = F.when(own, F.col("owner")).otherwise(F.coalesce("o.owner", F.lit(-1)))
    whole = F.when(own, F.col("owner_whole")).otherwise(F.coalesce("o.owner_whole", F.lit(True)))
    return scratch.put(joined.select("file", "split_at", "nth", "off", "simple", owner.alias("owner"), (~whole).alias("torn")), "chain")


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def read_warc(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """One row for each record that the chains reach: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Versions 1.0 and 1.1 are read. Size and digest are those of a record's payload (the block less its HTTP head, or the whole
    block where it holds no HTTP); of a revisit, those its headers name. Archives
    without a record give no rows, and a file that doesn't start with a record gives none. A magic line that no chain
    reaches is part of the record before it, whatever length it names. A record cut off by the end of its file comes back with the bytes
    there are; one without a readable length is the last of its file. Fields that are missing or no numbers are null.
    """
    chunks = scratch.put(_parsed(_scan(spark, path)), "chunks")
    succ = F.coalesce(F.col("off") + len(MAGIC) + F.col("head_bytes") + 8 + F.col("length"), F.lit(-1))
    links = _located(chunks.select("file", "split_at", "nth", "rest", "head_bytes", "length", "candidate", "whole")).filter("off >= 0")
    links = scratch.put(links.select("file", "split_at", "nth", "off", succ.alias("succ"), "candidate", "whole"), "links")
    chain = _chains(links, scratch)
    key = ["file", "split_at", "nth"]
    simple = chunks.join(chain.filter("simple").select(*key), key, "left_semi").select(*COLUMNS)
    torn = chain.filter("torn").select("file", "owner", "off")
    if torn.isEmpty():
        return simple
    # files with torn records are read again, and their rows located by what this scan says, however it is split
    again = _scan(spark, path).join(torn.select("file").distinct(), "file", "left_semi")
    pieces = _located(scratch.put(again, "again")).join(torn, ["file", "off"])
    records = pieces.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("off", "raw"))).alias("p")).select(F.array_join(F.col("p.raw"), MAGIC).alias("raw"))
    return simple.unionByName(_parsed(records).select(*COLUMNS))
