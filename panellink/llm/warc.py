"""WARC archives: written with deduplicated payloads, read back by boundary-chain verification."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panellink.llm.common import col_of, join_groups, scratch_root, stored

#: What every record starts with; it may stand inside payloads too.
MAGIC = "WARC/1.1\r\n"
#: A successor starts this many bytes after a record's block.
GAP = 4

_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of SHA-1: each 5 hex digits are 4 base32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def assign_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(page_id, url..., payload, digest, n, refers_to, none): refers_to is set on rows that revisit an earlier payload.

    Of equal payloads of ``min_bytes`` bytes or more, the row with the smallest id is the response.
    """
    first = pages.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    first = stored(first.where("copies > 1"), "warc-firsts")
    joined = join_groups(pages, first, "digest", pages.count(), "copies", "left")
    return joined.withColumn("refers_to", F.when(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))), F.col("first"))).drop("first")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, min_bytes: int = 0) -> None:
    """Write a WARC record for each page to gzipped files of ``path``, through Spark's committer.

    A response holds an HTTP message with the html in UTF-8 (null: empty) as its payload; a revisit holds no payload
    but its digest, its length and the record it refers to.  Record ids are ``urn:page:<id>``; null ids are empty.
    Rows that share an id (repeated rows) are a response each.  Other columns don't matter, whatever their names; an empty table gives no record.
    """
    text = F.coalesce(col_of(pages, html_col), F.lit(""))
    data = text.cast("binary")
    p = pages.select(
        col_of(pages, id_col).alias("page_id"), F.regexp_replace(F.coalesce(col_of(pages, url_col).cast("string"), F.lit("")), r"[\r\n]", "").alias("url"), text.alias("payload"),
        base32_sha1(data).alias("digest"), F.octet_length(data).cast("long").alias("n"),
    )
    p = assign_revisits(p, "page_id", "payload", min_bytes)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("refers_to").isNotNull()
    block_bytes = F.when(revisit, F.lit(0)).otherwise(F.octet_length(http).cast("long") + F.col("n"))
    record = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", F.col("url")), line("WARC-Date", F.lit("2000-01-01T00:00:00Z")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("X-Payload-Length", F.col("n").cast("string")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", block_bytes.cast("string")), F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("payload"))),
    )
    p.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _header(text: Column, name: str) -> Column:
    """A header's value, null where it is missing; ``text`` is the part of a piece before its first blank line."""
    found = F.regexp_extract(text, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between magics: (file, at, bytes, head, piece), ``at`` the offset of the magic before the piece.

    The files (gzipped or plain; plain ones are split) are scanned by Spark's readers with the magic as the separator, so one
    piece is in memory at a time.  Offsets are those of the uncompressed bytes: running sums of the pieces' lengths.
    """
    lines = spark.read.option("lineSep", MAGIC).text(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("piece"))
    pieces = stored(pieces.withColumn("bytes", F.octet_length("piece").cast("long")), "warc-pieces")
    order = W.partitionBy("file").orderBy("block", "seq")
    # the first piece of a file is what stands before its first magic
    ahead = F.coalesce(F.sum(F.col("bytes") + len(MAGIC)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - len(MAGIC)
    return pieces.select("file", "block", "seq", "bytes", ahead.alias("at")), pieces


def pointer_jumping(edges: pd.DataFrame) -> np.ndarray:
    """Whether each candidate (at, successor) of one file is reached from its start.

    Each round every reached record marks its 2^k-th successor, and links double their length: log2(n) rounds.
    """
    at = edges["at"].to_numpy()
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    n = len(at)
    found = np.searchsorted(sorted_at, edges["successor"].to_numpy()[order])
    link = np.where((found < n) & (sorted_at[np.minimum(found, n - 1)] == edges["successor"].to_numpy()[order]), found, n)
    link = np.append(link, n)
    link[:n] = np.where(link[:n] <= np.arange(n), n, link[:n])  # a successor is always ahead
    reached = np.zeros(n + 1, bool)
    reached[:n] = sorted_at == 0
    while True:
        more = reached.copy()
        more[link[reached]] = True
        link = link[link]
        if (more[:n] == reached[:n]).all() and (link[:n] == n).all():
            break
        reached = more
    out = np.empty(n, bool)
    out[order] = reached[:n]
    return out


def reached_records(candidates: pd.DataFrame) -> pd.DataFrame:
    """What the candidates of one file are: (block, seq, at, record, resumed, complete, skipped).

    ``candidates`` has (block, seq, at, bytes, successor), the bytes of the piece after each magic and -1 for no declared length.
    ``record`` is the record whose bytes a piece is, -1 if it is no record's.  Records are those reached by pointer jumping from the file's
    start.  Where the chain breaks (no length, or one that ends at neither a candidate nor the file's end) it is resumed at the first later
    candidate from which a chain leads to the file's end, if there is none at the first one past the declared end; such records
    are ``resumed``.  A broken record isn't ``complete``; it has what stands up to its declared end, its own piece if it has none,
    and ``skipped`` is how many bytes from there on up to the next record belong to none.
    """
    c = candidates.sort_values("at", kind="stable").reset_index(drop=True)
    at, successor = c["at"].to_numpy(), c["successor"].to_numpy()
    own_end = at + len(MAGIC) + c["bytes"].to_numpy()
    n, end = len(c), int(own_end[-1])
    to = np.searchsorted(at, successor)
    linked = (successor > at) & (to < n) & (at[np.minimum(to, n - 1)] == successor)
    whole = linked | (successor == end)
    reached = pointer_jumping(c)
    resumed = np.zeros(n, bool)
    last = int(np.flatnonzero(reached)[-1]) if reached.any() else -1
    if last < 0 or not whole[last]:
        good = np.zeros(n + 1, bool)  # a chain leads to the file's end
        for k in range(n - 1, -1, -1):
            good[k] = successor[k] == end or (linked[k] and good[to[k]])
        while last < 0 or not whole[last]:
            later = np.flatnonzero(good[last + 1 : n])
            past = np.flatnonzero(at[last + 1 :] >= (successor[last] if last >= 0 else 0))
            found = later if len(later) else past
            if not len(found):
                break
            last += 1 + int(found[0])
            resumed[last] = reached[last] = True
            while linked[last]:
                last = int(to[last])
                resumed[last] = reached[last] = True
    owner = np.maximum.accumulate(np.where(reached, np.arange(n), -1))
    starts = np.flatnonzero(reached)
    until, skipped = np.zeros(n, np.int64), np.zeros(n, np.int64)
    following = np.append(at[starts[1:]], end)
    declared = np.where(successor[starts] > 0, successor[starts], own_end[starts])
    until[starts] = np.minimum(declared, following)
    skipped[starts] = following - until[starts]
    held = (owner >= 0) & (at < until[np.maximum(owner, 0)])
    record = np.where(held, at[np.maximum(owner, 0)], -1)
    return c[["block", "seq", "at"]].assign(record=record, resumed=resumed, complete=whole & reached, skipped=skipped)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, record_type, record_id, target_uri, digest, refers_to, payload_bytes, payload_digest, payload, digest_ok, complete, resumed, skipped).

    Every magic is a candidate record; its successor is where its declared length ends.  Candidates that aren't
    reached from offset 0 of their file by pointer jumping are bytes of a payload: their pieces are appended to
    the reached record before them.  Damage doesn't hide what follows: see ``reached_records`` for broken chains, what ``resumed``,
    ``complete`` and ``skipped`` say of them, and ``lost_bytes`` for their sum.  digest_ok says whether the payload has the declared digest, null where none is
    declared or the payload is elsewhere.  Empty files have no record.  A file's candidates, some 40 bytes each, meet in one task.
    """
    places, pieces = candidates(spark, path)
    head = F.substring_index(F.col("piece"), "\r\n\r\n", 1)
    heads = pieces.select("file", "block", "seq", F.when(F.col("piece").contains("\r\n\r\n"), head).alias("head"))
    length = F.expr("try_cast(nullif(regexp_extract(head, '(?i)(?:^|\\r\\n)Content-Length:[ \\t]*([0-9]+)', 1), '') AS long)")
    heads = heads.select("file", "block", "seq", (F.octet_length("head") + GAP).cast("long").alias("head_bytes"), length.alias("content"))
    known = places.where("at >= 0").join(heads.hint("merge"), ["file", "block", "seq"])  # as many rows as records: never a broadcast
    edges = known.select("file", "block", "seq", "at", "bytes", F.coalesce(F.col("at") + len(MAGIC) + F.col("head_bytes") + F.col("content") + GAP, F.lit(-1)).alias("successor"))

    def reach(group: pd.DataFrame) -> pd.DataFrame:
        return reached_records(group).assign(file=group["file"].iloc[0])

    marked = edges.groupBy("file").applyInPandas(reach, "block long, seq long, at long, record long, resumed boolean, complete boolean, skipped long, file string")
    whole = stored(marked, "warc-reached").where("record >= 0").withColumn("several", F.count(F.lit(1)).over(W.partitionBy("file", "record")) > 1)
    joined = pieces.join(whole.hint("merge"), ["file", "block", "seq"])
    facts = ["resumed", "complete", "skipped"]
    one = joined.where("NOT several").select("file", F.col("record").alias("at"), "piece", *facts)
    more = joined.where("several").groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"), *[F.max(F.when(F.col("at") == F.col("record"), F.col(c))).alias(c) for c in facts])  # pieces of one record
    more = more.select("file", F.col("record").alias("at"), F.array_join(F.col("p.piece"), MAGIC).alias("piece"), *facts)
    r = one.unionByName(more)
    head = F.substring_index("piece", "\r\n\r\n", 1)
    content = F.expr("try_cast(nullif(regexp_extract(head, '(?i)(?:^|\\r\\n)Content-Length:[ \\t]*([0-9]+)', 1), '') AS long)")
    # a record without a length has its whole piece; what is longer than a value of Spark (2 GB) can't be read as a line, and isn't complete
    r = r.withColumn("head", head).withColumn("content", F.least(F.coalesce(content, F.octet_length("piece").cast("long")), F.lit(2**31 - 1)).cast("int"))
    block = F.expr(f"substring(cast(piece AS binary), octet_length(head) + {GAP + 1}, content)")
    # where the HTTP header in the block ends: at the second blank line of the piece
    r = r.withColumn("block", block).withColumn("h", F.octet_length(F.substring_index("piece", "\r\n\r\n", 2)) - F.octet_length("head") - GAP)
    http = F.coalesce(_header(F.col("head"), "Content-Type").startswith("application/http"), F.lit(False)) & (F.col("h") >= 0) & (F.col("h") + GAP <= F.octet_length("block"))
    r = r.withColumn("payload", F.when(http, F.expr(f"substring(block, h + {GAP + 1})")).otherwise(F.col("block")))
    kind = _header(F.col("head"), "WARC-Type")
    declared = F.regexp_replace(_header(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "")
    urn = lambda name: F.regexp_extract(F.coalesce(_header(F.col("head"), name), F.lit("")), "^<urn:page:(.*)>$", 1)
    revisit = F.coalesce(kind == "revisit", F.lit(False))
    n = F.when(revisit, _header(F.col("head"), "X-Payload-Length").try_cast("long")).otherwise(F.octet_length("payload").cast("long"))
    digest = base32_sha1(F.col("payload"))
    return r.select(
        "file", "at", kind.alias("record_type"), urn("WARC-Record-ID").alias("record_id"), _header(F.col("head"), "WARC-Target-URI").alias("target_uri"), declared.alias("digest"),
        urn("WARC-Refers-To").alias("refers_to"), n.alias("payload_bytes"), F.when(revisit, declared).otherwise(digest).alias("payload_digest"), "payload",
        F.when(~revisit, declared == digest).alias("digest_ok"), *facts,
    )


def lost_bytes(records: DataFrame) -> DataFrame:
    """(file, records, incomplete, resumed, skipped): what of each archive was damaged, and the bytes after its first record that no record has."""
    return records.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.count(F.when(~F.col("complete"), 1)).alias("incomplete"), F.count(F.when(F.col("resumed"), 1)).alias("resumed"), F.sum("skipped").alias("skipped"))


def op2_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    back = lambda c: F.nullif(F.col(c), F.lit("")).try_cast(pages.schema["page_id"].dataType)
    return read_archives(spark, path).select(back("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to"))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT *, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS INT), 1)), 'string_agg', '') AS b,
    min(page_id) OVER (PARTITION BY html) AS first
  FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, b AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
