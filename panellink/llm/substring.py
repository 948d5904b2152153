"""Substring dedup by hashing lines and the sentences that lines hold, and removing repeated passages of them."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from panellink.llm.common import carried, col_of, held, join_groups, returned, stored

#: Units of fewer words are only judged together with those beside them, until they are this many words.
MIN_WORDS = 6
#: A run of units that stand elsewhere too is removed from this many words on.  Passages of over 50 words lose some at their ends,
#: where a sentence that they share with the text around them isn't a repeated unit.
MIN_PASSAGE = 30
#: Letters that count as a word where blanks don't part words.
LETTERS_A_WORD = 12
#: Characters of the texts whose units or kept texts a Python worker holds at once; a longer text stands alone.
BATCH_CHARS = 1 << 20

_UNIT = re.compile(r"[^.!?\n\u3002\uff01\uff1f]*(?:[.!?\u3002\uff01\uff1f]+\s*|\n\s*|\Z)")
_DROP = re.compile(r"[\W_]+")


def _normal(text: str) -> str:
    """A unit's normal form: NFKC, lower case, runs of other than letters and digits as one blank."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _DROP.sub(" ", text.lower()).strip()


def _size(normal: str) -> int:
    """Words of a normal form; where blanks don't part words, one for each LETTERS_A_WORD letters."""
    return max(normal.count(" ") + 1, -(-len(normal) // LETTERS_A_WORD)) if normal else 0


def units(text: str | None) -> Iterator[tuple[int, int, bytes, int]]:
    """(start, end, digest, words) of each unit: the text's lines, and the sentences of those that hold several.

    Units follow one another without gaps; what has neither letters nor digits belongs to the unit before it.  A unit of fewer than MIN_WORDS
    words is hashed together with those before it, and if these are too few with those after, across lines; a text of fewer
    words than that has no unit.
    """
    parts: list[list] = []
    for m in _UNIT.finditer(text or ""):
        normal = _normal(m[0])
        if normal:
            parts.append([m.start(), m.end(), normal, _size(normal)])
        elif parts:
            parts[-1][1] = m.end()
    for k, (a, b, normal, n) in enumerate(parts):
        low = high = k
        total = n
        while total < MIN_WORDS and low:
            low -= 1
            total += parts[low][3]
        while total < MIN_WORDS and high + 1 < len(parts):
            high += 1
            total += parts[high][3]
        if total < MIN_WORDS:
            return
        digest = hashlib.md5(" ".join(p[2] for p in parts[low : high + 1]).encode("utf-8", "surrogatepass")).digest()
        yield a, b, digest + bytes([k - low]), n


def pieces(texts: pd.Series) -> Iterator[slice]:
    """Slices of all the texts, in order, of BATCH_CHARS characters at most or of one text."""
    start = chars = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > start and chars + n > BATCH_CHARS:
            yield slice(start, k)
            start, chars = k, 0
        chars += n
    yield slice(start, len(texts))


def unit_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The units of each text, a piece of a batch at a time: units take several times the memory of their text."""
    for texts in batches:
        for part in pieces(texts):
            yield pd.Series([[{"start": a, "end": b, "digest": d, "words": n} for a, b, d, n in units(t)] for t in texts.iloc[part]], dtype=object)


def text_units(text: Column) -> Column:
    @pandas_udf("array<struct<start:int, end:int, digest:binary, words:int>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from unit_batches(batches)

    return of(text)


def runs(spans: list[tuple[int, int, int]], least: int) -> list[tuple[int, int]]:
    """Spans (start, end, words) that follow one another joined to runs, and of these the ones of ``least`` words or more."""
    out: list[list[int]] = []
    for a, b, n in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
            out[-1][2] += n
        else:
            out.append([a, b, n])
    return [(a, b) for a, b, n in out if n >= least]


def cut(text: str | None, spans: list[tuple[int, int]]) -> tuple[str | None, list[dict]]:
    """The text without its spans (in order, apart from each other), and the spans, with their offsets in the original text."""
    if text is None or not spans:
        return text, []
    kept = "".join(text[p:a] for p, a in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)]))
    return kept, [{"start": a, "end": b} for a, b in spans]


def without(text: Column, spans: Column, least: int) -> Column:
    @pandas_udf("text string, removed array<struct<start:int, end:int>>, n_removed int")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            for part in pieces(texts):
                rows = [cut(t, runs([(int(x["start"]), int(x["end"]), int(x["words"])) for x in s], least) if s is not None else []) for t, s in zip(texts.iloc[part], found.iloc[part])]
                yield pd.DataFrame([(t, s, len(s)) for t, s in rows], columns=["text", "removed", "n_removed"])

    return of(text, spans)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_passage: int = MIN_PASSAGE, within: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (kept), removed (spans of code points in the original text), n_removed, n_chars_removed, ``carry``.

    All units are grouped by digest over all documents; the occurrence of the smallest (doc_id, digest of the text, start)
    stays.  The others are repeats; runs of them of ``min_passage`` words or more go.  With ``within``, a unit that the kept occurrence's own
    document has again is a repeat too; else a document's inner repetition is left to quality filters.

    Null ids rank last.  A null text stays null, an empty one empty.  Rows with equal
    id and text are one document: they all keep what it keeps.  An empty table gives an empty result.
    """
    doc_id, text = col_of(docs, id_col), col_of(docs, text_col)
    key = [doc_id.alias("doc_id"), F.xxhash64(text).alias("hash")]
    found = docs.select(*key, F.explode(text_units(text)).alias("u")).select("doc_id", "hash", "u.*")
    found = stored(found, "substring-units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("hash").alias("hash"), F.col("start").alias("start"))
    firsts = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = stored(firsts, "substring-firsts")
    same = F.col("first.id").eqNullSafe(F.col("doc_id")) & (F.col("first.hash") == F.col("hash"))
    kept = same & (F.col("first.start") == F.col("start")) if within else same
    later = join_groups(found, firsts, "digest", found.count()).where(~kept)
    spans = stored(later.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("start", "end", "words")).alias("spans")), "substring-spans")  # of one text
    d = docs.select(*key, text.alias("text"), *carried(docs, carry)).alias("d")
    s = spans.alias("s")
    out = d.join(s, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.hash") == F.col("s.hash")), "left")
    out = out.select("d.doc_id", without(F.col("d.text"), F.col("s.spans"), min_passage).alias("w"), *[f"d.{c}" for c in held(carry)])
    chars = F.aggregate("w.removed", F.lit(0), lambda n, x: n + x["end"] - x["start"]).cast("long")
    return out.select("doc_id", "w.*", chars.alias("n_chars_removed"), *returned(carry))


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
