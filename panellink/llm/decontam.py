"""Benchmark decontamination by a distributed positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panellink.llm.common import ascii_lower, broadcast_if_small, carried, col_of, held, returned, stored

#: What stands between words before A-Z are lower-cased: the complement of the contract's class, with A-Z let in.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Test terms, windows or documents that may be broadcast (about 200 bytes each); beyond it Spark joins by shuffle.
MAX_BROADCAST = 200_000
#: Terms of a window, from the rarest on, whose lists are intersected over the whole index; the others only where these meet.
FIRST_TERMS = 2


def _words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, GAP), ""), F.array().cast("array<string>"))


def _term(word: Column) -> Column:
    """The word with A-Z in lower case; words of ASCII alone take the short way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(ascii_lower(word))


def test_windows(items: DataFrame, item_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(windows, owners): windows (win, words, len), distinct by their words; owners (win, item_id)."""
    w = items.select(F.coalesce(col_of(items, item_col).cast("string"), F.lit("")).alias("item_id"), _words(ascii_lower(col_of(items, text_col))).alias("words")).where(F.size("words") > 0)
    starts = F.expr(f"sequence(1, greatest(1, size(words) - {width - 1}))")
    w = w.select("item_id", F.explode(starts).alias("at"), "words").select("item_id", F.expr(f"slice(words, at, {width})").alias("words"))
    w = stored(w.withColumn("wid", F.md5(F.concat_ws(" ", "words").cast("binary"))), "decontam-windows")
    windows = stored(w.groupBy("wid").agg(F.first("words").alias("words")).select("wid", "words", F.size("words").alias("len"), F.monotonically_increasing_id().alias("win")), "decontam-distinct")
    return windows.drop("wid"), stored(w.select("wid", "item_id").distinct().join(windows.select("wid", "win"), "wid").select("win", "item_id"), "decontam-owners")


def build_index(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The stored positional index of the training texts: postings (row, pos, term), and what each document is.

    Every word is a posting, or with ``terms`` (term) every word that is one of them: an index for one test set needs no others.
    More terms than may be broadcast aren't worth a filter, then all words are stored.  The posting at position 0 of a document, or
    a row without position if it has no words, also has doc_id, n_words and ``carry``.
    """
    kept = held(carry)
    d = docs.select(col_of(docs, id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), _words(col_of(docs, text_col)).alias("words"), *carried(docs, carry))
    d = d.select("doc_id", "row", *kept, F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    p = d.withColumn("term", _term(F.col("word")))
    if terms is not None and terms.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        p = p.join(F.broadcast(terms.select(F.col("term").alias("wanted"))), F.col("term") == F.col("wanted"), "left")
        p = p.where("wanted IS NOT NULL OR coalesce(pos, 0) = 0").withColumn("term", F.col("wanted"))
    once = [F.expr(f"CASE WHEN coalesce(pos, 0) = 0 THEN {c} END").alias(c) for c in ("doc_id", "n_words", *kept)]
    return stored(p.select("row", "pos", "term", (F.coalesce("pos", F.lit(0)) == 0).alias("document"), *once), "decontam-index")


def ranked_terms(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(win, len, term, off, rank): each window's terms from the rarest on, by their postings in the index.

    Windows with a term that no training text has can't occur and are left out.
    """
    terms = windows.select("win", "len", F.posexplode("words").alias("off", "term"))
    freq = index.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    freq = stored(freq.join(broadcast_if_small(terms.select("term").distinct(), MAX_BROADCAST), "term", "left_semi"), "decontam-frequencies")
    by = W.partitionBy("win")
    ranked = terms.join(broadcast_if_small(freq, MAX_BROADCAST), "term", "left")
    ranked = ranked.withColumn("rank", F.row_number().over(by.orderBy("freq", "off"))).withColumn("least", F.min(F.coalesce("freq", F.lit(0))).over(by))
    return stored(ranked.where("least > 0").select("win", "len", "term", "off", "rank"), "decontam-ranked")


def phrase_matches(index: DataFrame, ranked: DataFrame, slop: int = 0) -> DataFrame:
    """(row, win, start, len, exact): the offset-adjusted posting lists of each window's terms, intersected from the rarest on.

    A posting of the window's term ``off`` at ``pos`` says that the window starts at ``pos - off``.  The lists of the FIRST_TERMS rarest
    terms are intersected over the whole index; where they agree, so must the lists of all other terms, which are read for the documents left.
    An exact match has every term in place.  With ``slop`` over 0, proximity matches are returned too: the rarest term marks the
    start, and every other term stands within ``slop`` words of its place.
    """
    postings = index.where("term IS NOT NULL").select("row", "pos", "term")
    near = lambda d, c: d.withColumn("by", F.explode(F.sequence(F.lit(-slop), F.lit(slop)))).withColumn(c, F.col(c) + F.col("by")) if slop else d.withColumn("by", F.lit(0))
    first = broadcast_if_small(ranked.where(f"rank <= {FIRST_TERMS}"), MAX_BROADCAST)
    lists = postings.join(first, "term").select("row", "win", "len", "rank", (F.col("pos") - F.col("off")).alias("start"))
    if slop:
        lists = lists.where("rank = 1").withColumn("by", F.lit(0)).unionByName(near(lists.where("rank > 1"), "start"))
    else:
        lists = lists.withColumn("by", F.lit(0))
    in_place = F.countDistinct(F.when(F.col("by") == 0, F.col("rank"))) if slop else F.count(F.lit(1))
    met = lists.groupBy("row", "win", "start", "len").agg(F.max((F.col("rank") == 1).cast("int")).alias("anchored"), (F.countDistinct("rank") if slop else F.count(F.lit(1))).alias("terms"), in_place.alias("in_place"))
    met = stored(met.where(f"anchored = 1 AND terms = least(len, {FIRST_TERMS})").drop("anchored", "terms"), "decontam-met")
    rows = broadcast_if_small(met.where(f"len > {FIRST_TERMS}").select("row").distinct(), MAX_BROADCAST)
    rest = broadcast_if_small(ranked.where(f"rank > {FIRST_TERMS}").select("win", "term", "off"), MAX_BROADCAST)
    wanted = met.where(f"len > {FIRST_TERMS}").join(rest, "win").select("row", "win", "start", "term", "off", (F.col("start") + F.col("off")).alias("pos"))
    found = near(wanted, "pos").join(postings.join(rows, "row", "left_semi"), ["row", "pos", "term"])
    found = found.groupBy("row", "win", "start").agg((F.countDistinct("off") if slop else F.count(F.lit(1))).alias("others"), F.countDistinct(F.when(F.col("by") == 0, F.col("off"))).alias("others_in_place") if slop else F.count(F.lit(1)).alias("others_in_place"))
    longer = met.where(f"len > {FIRST_TERMS}").join(found, ["row", "win", "start"]).where(f"others = len - {FIRST_TERMS}")
    short = met.where(f"len <= {FIRST_TERMS}")
    exact = F.col("in_place") == F.least("len", F.lit(FIRST_TERMS))
    return short.select("row", "win", "start", "len", exact.alias("exact")).unionByName(longer.select("row", "win", "start", "len", (exact & (F.col("others_in_place") == F.col("len") - FIRST_TERMS)).alias("exact")))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_col: str = "item_id", item_text: str = "text", width: int = 10, slop: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, with ``slop`` n_near, ``carry``.

    A window is ``width`` consecutive words of an item (an item of fewer words is one window); a document's word is hit
    if an occurrence of any window covers it.  n_near is the number of places where a window occurs only by proximity (``phrase_matches``);
    they make no document contaminated.  Words lower-case A-Z only.  Null texts have no words; items without
    words have no window; null item ids count as the empty id.  Repeated rows are documents of their own.  Without
    items nothing is hit; without documents the result is empty.
    """
    windows, owners = test_windows(items, item_col, item_text, width)
    index = build_index(docs, id_col, text_col, windows.select(F.explode("words").alias("term")).distinct(), carry)
    every = stored(phrase_matches(index, ranked_terms(index, windows), slop), "decontam-matches")
    matches = every.where("exact")
    spans = matches.select("row", "start", (F.col("start") + F.col("len")).alias("end")).groupBy("row", "start").agg(F.max("end").alias("end"))
    before = F.coalesce(F.max("end").over(W.partitionBy("row").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hits = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", before))).groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    found = matches.select("row", "win").distinct().join(broadcast_if_small(owners, MAX_BROADCAST), "win").select("row", "item_id").distinct()
    found = found.groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    out = index.where("document").select("row", "doc_id", "n_words", *held(carry)).join(hits, "row", "left").join(found, "row", "left")
    near = []
    if slop:
        out = out.join(every.where("NOT exact").groupBy("row").agg(F.count(F.lit(1)).alias("n_near")), "row", "left")
        near = [F.coalesce("n_near", F.lit(0)).alias("n_near")]
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items_of).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *near, *returned(carry))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, len(w[s:s + 9]) AS n, array_to_string(w[s:s + 9], ' ') AS g
  FROM items, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 8))) AS s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM lowered, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s) WHERE len(w) >= n),
m AS (SELECT r, s, n, item_id FROM grams JOIN wins USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, s, n FROM m), LATERAL (SELECT unnest(range(s, s + n)) AS p) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
