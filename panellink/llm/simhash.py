"""Near duplicates by SimHash (a byte-position inverted index with count filtering) or by the true similarity of shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window as W

from panellink.llm.common import carried, col_of, join_groups, stored

#: Two fingerprints link at this many differing bits or fewer, so at least 8 - 2 of their 8 bytes agree.
MAX_BITS = 2
#: The index's lists are of four byte positions whose numbers' exclusive or is 0: 14 lists, each three positions in just one of them.
#: Two fingerprints that agree in six bytes share 3 of these lists, in seven 7, in eight all, but in five only 1 and in fewer 1 at most.
LISTS = tuple(q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0)
MIN_SHARED_LISTS = 3
#: A posting list longer than this isn't paired; its members meet through single-bit neighbours instead.
LONG_LIST = 64
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 16
#: Least hashes in a band of a sketch, and the chance at most that a pair at just the least similarity shares no band.  With eight,
#: 76 bands do for 0.8; pairs that are alike by half share one with a chance of a quarter, pairs alike by a fifth with one of 0.0002.
BAND_ROWS = 8
MISS = 1e-6
#: Shingles whose permuted hashes are held at once.
SKETCH_BLOCK = 64
#: Longs of one bit for each of the first least hashes: two sets differ in the fewer of them the more alike they are.
SKETCH_LONGS = 4
#: As many for the sets that meet all others of a key: so they meet only those that are alike by 0.76 or so.
FINE_LONGS = 64
#: Members of its keys that a node meets in a round, and rounds at most before those of a key that aren't connected yet all meet.
MET, ROUNDS = 4, 4


def _shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the text's shingles, BLOCK at a time; of fewer words, that of all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z, and 20 and 09-0D only
    if not words:
        return
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    first = starts[:n].tolist()
    for k in range(0, n, BLOCK):
        pieces = [joined[a:b] for a, b in zip(first[k : k + BLOCK], last[k : k + BLOCK])]
        yield np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, len(pieces))


def simhash(text: str | None, shingle: int = 3) -> int:
    """64-bit fingerprint: bit b is set where over half of the shingles' XXH64 (seed 42) have it.  No words: 0."""
    ones, n = np.zeros(64, np.int64), 0
    for h in _shingle_hashes(text, shingle):
        n += len(h)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(shingle: int = 3):
    """A column function: text to fingerprint, as a signed long."""

    @pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.fromiter((simhash(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64))

    return of


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *_shingle_hashes(text, shingle)]))


def bands(similarity: float) -> int:
    """So many bands of BAND_ROWS least hashes that sets of at least this similarity share one but for a chance of MISS."""
    return 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log(1 - similarity**BAND_ROWS))


def most_differing(similarity: float, longs: int) -> int:
    """So few bits of a sketch are the most that sets of at least this similarity differ in, but for a chance of MISS."""
    n, p = 64 * longs, (1 - similarity) / 2
    if p <= 0:
        return 0
    chance = lambda d: math.exp(math.lgamma(n + 1) - math.lgamma(d + 1) - math.lgamma(n - d + 1) + d * math.log(p) + (n - d) * math.log1p(-p))
    d, beyond = n, 0.0
    while d and beyond + chance(d) <= MISS:
        beyond += chance(d)
        d -= 1
    return d


def least_hashes(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The least hash of a set under each of ``n`` fixed permutations of 32-bit numbers."""
    a, b = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**32, (2, n), np.uint32)
    a |= np.uint32(1)
    low = hashes.astype(np.uint32)
    least = np.full(n, 2**32 - 1, np.uint32)
    held = np.empty((min(SKETCH_BLOCK, len(low)), n), np.uint32)
    for k in range(0, len(low), SKETCH_BLOCK):
        part = held[: len(low[k : k + SKETCH_BLOCK])]
        np.multiply.outer(low[k : k + SKETCH_BLOCK], a, out=part)
        part += b
        np.minimum(least, part.min(axis=0), out=least)
    return least


def sketch_bits(least: np.ndarray, longs: int) -> np.ndarray:
    """One bit for each of the first least hashes, as longs."""
    bits = (np.resize(least, 64 * longs) * np.uint32(0x85EBCA6B) >> np.uint32(31)).astype(np.uint8)
    return np.packbits(bits).view("<i8").astype(np.int64)


def sketch_keys(hashes: np.ndarray, n_bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, bits): one key for each band of a set's least hashes under fixed permutations of 32-bit numbers, and SKETCH_LONGS longs of bits.

    An empty set has no key.
    """
    if not len(hashes):
        return np.empty(0, np.int64), np.zeros(SKETCH_LONGS, np.int64)
    least = least_hashes(hashes, n_bands * BAND_ROWS, 42)
    rows = least.astype("<u4").reshape(n_bands, BAND_ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)), np.uint64, n_bands).view(np.int64), sketch_bits(least, SKETCH_LONGS)


def sketch(shingle: int, n_bands: int):
    """A column function: text to the digest of its shingle set, the set's size, the bits of its sketch and the keys of its bands."""

    @pandas_udf("fp binary, shingles int, bits array<long>, keys array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                h = shingle_set(t, shingle)
                keys, bits = sketch_keys(h, n_bands)
                rows.append((xxhash.xxh3_128_digest(h.astype("<u8").tobytes()), len(h), bits, keys))
            yield pd.DataFrame(rows, columns=["fp", "shingles", "bits", "keys"])

    return of


def shingle_bytes(shingle: int):
    @pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t, shingle).astype("<u8").tobytes() for t in texts])

    return of


def fine_sketch(sets: Column) -> Column:
    """FINE_LONGS longs of bits for each shingle set."""

    @pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for held in batches:
            yield pd.Series([sketch_bits(least_hashes(np.frombuffer(x, "<u8"), 64 * FINE_LONGS, 43), FINE_LONGS) for x in held])

    return of(sets)


def similar(similarity: float):
    """A column function of two shingle sets: whether their Jaccard similarity is at least this."""

    @pandas_udf("boolean")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lefts, rights in batches:
            out = []
            for x, y in zip(lefts, rights):
                a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-6:
                    out.append(False)
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                out.append(both / (len(a) + len(b) - both) >= similarity)
            yield pd.Series(out, dtype=bool)

    return of


def _byte(fp: str, k: int) -> str:
    return f"(shiftrightunsigned({fp}, {8 * k}) & 255)"


def posting_lists(fps: DataFrame) -> DataFrame:
    """(key, fp): the inverted index of byte positions, LISTS lists for each fingerprint.

    A list is of one value at each of four positions: a list of a single byte would hold 1/256 of all fingerprints.
    """
    keys = [f"{i}L * 4294967296L + " + " + ".join(f"{_byte('fp', k)} * {256**j}L" for j, k in enumerate(q)) for i, q in enumerate(LISTS)]
    return fps.select(F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"), "fp")


def linked_pairs(fps: DataFrame) -> DataFrame:
    """Edges (u, v), u < v, with the same connected components as all pairs of distinct fingerprints that link.

    For each pair the lists that it shares are tallied; MIN_SHARED_LISTS is what any pair of MAX_BITS differing bits, which touch two
    bytes at most, is sure to reach, and only six equal bytes or more reach it.  The pairs that do are verified by their bits.
    Lists of more than LONG_LIST members aren't paired: their members are posted under themselves and
    their 64 single-bit neighbours, where two fingerprints meet exactly if they differ in two bits or
    fewer.  Such a meeting holds 65 members at most, and all of them link, so edges to the least are enough.
    """
    postings = posting_lists(fps)
    lists = stored(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-lists")
    shared = stored(postings.join(lists, "key"), "simhash-shared")
    short = shared.where(F.col("n") <= LONG_LIST).select("key", "fp")
    pairs = short.alias("a").join(short.alias("b"), F.expr("a.key = b.key AND a.fp < b.fp")).groupBy(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).agg(F.count(F.lit(1)).alias("tally"))
    pairs = pairs.where(F.col("tally") >= MIN_SHARED_LISTS).where(F.expr(f"bit_count(u ^ v) <= {MAX_BITS}")).select("u", "v")
    members = shared.where(F.col("n") > LONG_LIST).select("fp").distinct()
    near = members.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))")).alias("near"))
    met = near.groupBy("near").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)  # 65 at most
    stars = met.select("u", F.explode("all").alias("v")).where("u < v")
    return pairs.unionByName(stars).distinct()


def similar_roots(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root) for the ``nodes`` (node, shingles, bits, keys) that share a key, root the least node reachable over the pairs that do and are similar.

    ``texts`` has (node, text).  Each node is first held against one other: the least of the least members of its keys.  Then rounds follow in which
    every key is led by some member and nodes meet a few leaders, until a round finds nothing; what is connected isn't compared again, so a group
    of copies costs some comparisons for each member.  At the end all members of a key that aren't connected yet meet.  Nodes meet only where their sizes
    and the bits of their sketches allow the similarity; every edge is verified on the whole sets.
    """
    bits = [f"b{k}" for k in range(SKETCH_LONGS)]
    nodes = nodes.select("node", "shingles", *[F.get("bits", F.lit(k)).alias(b) for k, b in enumerate(bits)], "keys")
    # the postings are shuffled once, and bare: what conditions need comes to those that are left
    key = W.partitionBy("key")
    postings = nodes.select("node", F.explode("keys").alias("key")).select("node", "key", F.min("node").over(key).alias("least"), F.count(F.lit(1)).over(key).alias("n"))
    shared = stored(postings.where("n > 1").drop("n"), "similar-shared")
    facts = stored(nodes.drop("keys").join(shared.select("node").distinct(), "node"), "similar-facts")
    head = facts.select(F.col("node").alias("least"), F.struct("node", "shingles", *bits).alias("head"))
    members = stored(shared.join(facts, "node").join(head, "least").drop("least"), "similar-members")
    sets = texts.join(facts.select("node"), "node").select("node", shingle_bytes(shingle)("text").alias("set"))
    sets = stored(sets, "similar-sets")
    most = most_differing(similarity, SKETCH_LONGS)

    def alike(x: str, y: str) -> Column:
        """What similar sets are: near in size and, but for a chance of MISS, in the bits of their sketches."""
        differing = " + ".join(f"bit_count({x}{b} ^ {y}{b})" for b in bits)
        return F.expr(f"least({x}shingles, {y}shingles) >= {similarity} * greatest({x}shingles, {y}shingles) - 1e-6 AND {differing} <= {most}")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        a, b = sets.select(F.col("node").alias("u"), F.col("set").alias("a")), sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
        pairs = stored(pairs.distinct(), f"{name}-pairs")
        return stored(pairs.join(a, "u").join(b, "v").where(similar(similarity)("a", "b")).select("u", "v"), name)

    def unjoined(roots: DataFrame, name: str) -> DataFrame:
        """The members of keys that aren't one component yet, with their roots."""
        held = stored(members.join(roots, "node"), f"{name}-held")
        open_keys = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        return stored(held.join(open_keys, "key"), name)

    least = members.where(alike("", "head.")).groupBy("node").agg(F.min("head.node").alias("u")).where("u < node")
    edges = verified(least.select("u", F.col("node").alias("v")), "similar-least")
    roots = joined(facts.select("node", F.col("node").alias("root")), edges, "similar-roots-0")
    left = unjoined(roots, "similar-open-0")
    for k in range(1, ROUNDS + 1):
        # each key is led by another member in every round; a node meets the leaders of MET of its keys
        member = F.struct(F.xxhash64("node", "key", F.lit(k)).alias("h"), "node", "root", "shingles", *bits)
        leaders = left.groupBy("key").agg(F.min(member).alias("leader"))
        meets = left.join(leaders, "key").where((F.col("root") != F.col("leader.root")) & alike("", "leader."))
        met = meets.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("leader.node")), 1, MET).alias("some"), F.slice(F.reverse(F.array_sort(F.collect_set("leader.node"))), 1, MET).alias("others"))  # its keys at most
        pairs = met.select("node", F.explode(F.array_union("some", "others")).alias("o"))
        found = verified(pairs.select(F.least("node", "o").alias("u"), F.greatest("node", "o").alias("v")), f"similar-round-{k}")
        if found.limit(1).count() == 0:
            break
        roots = joined(roots, found, f"similar-roots-{k}")
        left = unjoined(roots, f"similar-open-{k}")
    fine = sets.join(left.select("node").distinct(), "node").select("node", fine_sketch(F.col("set")).alias("fine"))
    rest = stored(left.select("key", "node", "root", "shingles", *bits).join(stored(fine, "similar-fine"), "node"), "similar-rest")
    near = F.expr(f"aggregate(zip_with(x.fine, y.fine, (a, b) -> bit_count(a ^ b)), 0, (s, d) -> s + d) <= {most_differing(similarity, FINE_LONGS)}")
    others = rest.alias("x").join(rest.alias("y"), F.expr("x.key = y.key AND x.root < y.root") & alike("x.", "y.") & near)
    found = verified(others.select(F.expr("least(x.node, y.node)").alias("u"), F.expr("greatest(x.node, y.node)").alias("v")), "similar-others")
    return joined(roots, found, "similar-roots")


def joined(roots: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) after ``edges`` (u, v) between nodes of ``roots`` are added, root the least node reachable.

    Only the roots that these edges join are walked, not the edges before.  Each of them is first replaced by its least neighbour, itself
    included: of a leader and the many that met it little more than the links between leaders is left for the rounds of ``components``.
    """

    def between(pairs: DataFrame, labels: DataFrame, step: str) -> DataFrame:
        a, b = labels.select(F.col("node").alias("u"), F.col("root").alias("ru")), labels.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        pairs = pairs.join(a, "u").join(b, "v").where("ru != rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
        return stored(pairs.distinct(), f"{name}-{step}")

    def relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))

    pairs = between(edges, roots, "between")
    if pairs.limit(1).count() == 0:
        return roots
    ends = pairs.select(F.col("u").alias("node"), F.col("u").alias("near")).unionAll(pairs.select(F.col("v").alias("node"), F.col("u").alias("near")))
    labels = stored(ends.groupBy("node").agg(F.min("near").alias("root")), f"{name}-near")
    rest = between(pairs, labels, "rest")
    roots = relabelled(roots, labels)
    return stored(roots if rest.limit(1).count() == 0 else relabelled(roots, components(rest)), name)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of the undirected ``edges`` (u, v), root the least node reachable.

    Each round hooks every node and its parent to the least parent seen over its edges, then halves all paths;
    every round is a stored table, and only the number of changes reaches the driver.
    """
    both = stored(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "cc-edges")
    parents = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "cc-0")
    for k in range(1, max_rounds + 1):
        p, q = parents.alias("p"), parents.alias("q")
        seen = both.alias("e").join(p, F.expr("e.u = p.node")).join(q, F.expr("e.v = q.node")).select("e.u", F.col("p.root").alias("pu"), F.col("q.root").alias("pv"))
        hooks = seen.select(F.explode(F.expr("array(struct(u AS node, pv AS root), struct(pu AS node, pv AS root))")).alias("h")).select("h.*")
        least = hooks.unionAll(parents.select("node", "root")).groupBy("node").agg(F.min("root").alias("root"))
        least = stored(least, f"cc-{k}-hooked")
        a, b, c = least.alias("a"), least.alias("b"), parents.alias("c")
        after = a.join(b, F.expr("a.root = b.node")).join(c, F.expr("a.node = c.node"))
        after = stored(after.select("a.node", F.col("b.root").alias("root"), (F.col("b.root") != F.col("c.root")).alias("moved")), f"cc-{k}")
        parents = after.select("node", "root")
        if after.where("moved").limit(1).count() == 0:
            return parents
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, similarity: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, fp (long), component_id, keep (true for one row of each component), ``carry``.

    Documents link at MAX_BITS differing bits of their SimHash or fewer; where ``similarity`` is given, at that Jaccard
    similarity of their sets of shingles or more, and fp is the set's digest (binary).  SimHash can't find those: at a similarity of 0.8 some
    10 of 64 bits differ.  There the inverted index is of bands of least hashes, and sets are compared whole.
    component_id is the smallest doc_id reachable over links, the own one included.  The kept row has that id; of
    several such rows, one is kept.  Null and blank texts have fingerprint 0 (an empty set) and link like any other.  Null ids
    order last; a component of only null ids has a null id.  An empty table gives an empty result.
    """
    row = F.monotonically_increasing_id().alias("row")
    doc_id, text = col_of(docs, id_col), col_of(docs, text_col)
    if similarity is None:
        d = docs.select(doc_id.alias("doc_id"), fingerprint(shingle)(text).alias("fp"), row, *carried(docs, carry))
    else:
        found = sketch(shingle, bands(similarity))(text).alias("sketch")
        d = docs.select(doc_id.alias("doc_id"), found, row, text.alias("t"), *[c for c, name in zip(carried(docs, carry), carry) if name != text_col])
        d = d.select("doc_id", "sketch.*", *[c for c in d.columns if c not in ("doc_id", "sketch")])
    d = stored(d, "simhash-rows")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    own = F.col("fp") if similarity is None else F.col("least.row")
    groups = d.groupBy("fp").agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("n"), *([] if similarity is None else [F.first("shingles").alias("shingles"), F.first("bits").alias("bits"), F.first("keys").alias("keys")]))
    groups = stored(groups.withColumn("own", own), "simhash-groups")
    if similarity is None:
        roots = components(linked_pairs(groups.select("fp")))
    else:
        roots = similar_roots(groups.select(F.col("own").alias("node"), "shingles", "bits", "keys"), d.select(F.col("row").alias("node"), F.col("t").alias("text")), shingle, similarity)
    labelled = groups.join(roots, groups["own"] == roots["node"], "left").select("fp", F.coalesce("root", "own").alias("root"), "least", "n")
    labelled = stored(labelled, "simhash-labelled")
    firsts = stored(labelled.groupBy("root").agg(F.min("least").alias("first")), "simhash-firsts")
    by_fp = stored(labelled.join(firsts, "root").select("fp", "first", "n"), "simhash-classes")
    out = join_groups(d, by_fp, "fp", d.count())
    columns = [F.col("t" if similarity is not None and c == text_col else f"c_{k}").alias(f"carry_{c}") for k, c in enumerate(carry)]
    return out.select("doc_id", "fp", F.col("first.id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("keep"), *columns)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
