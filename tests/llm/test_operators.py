"""Operators against brute force on small fixtures with nulls, ties, repeated rows, long texts and clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
import pytest
import xxhash

from panellink.llm import decontam, langid, media, mixing, pii, sharding, simhash, substring, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named like the operators' own.
CLASHING = SCHEMA + ", row long, fp long, size int, h string, at long, keep boolean, shard int, unit string, words string, _cell string, _n int"


def table(spark, rows, schema=SCHEMA):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.choice([1, 2, 3, 8, 40, 200])) for _ in range(60)]
    near = [t + " x" for t in base if len(t) > 1000]
    texts = [*base, *base[:10], *near, None, None, "", " \t ", "É È", words(rng, 30_000)]
    out = [(k * 3, t, "en", rng.choice(["s0", "s0", "s1", None])) for k, t in enumerate(texts)]
    return [*out, out[5], (None, base[0], None, None), (None, None, None, None)]


def records(df):
    return [r.asDict() for r in df.collect()]


# --- mixing ---------------------------------------------------------------------------------------------------


def test_mixing(spark, rows):
    got = records(mixing.mix_sources(table(spark, rows, CLASHING)))
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").encode().split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["copies"] in (int(np.floor(r["expected"])), int(np.ceil(r["expected"]))) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(len((t or "").encode().split()) for _, t, _, x in rows if x == s)
    again = records(mixing.mix_sources(table(spark, rows[::-1]).repartition(5)))
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixing_without_words_or_rows(spark):
    assert [r["taken"] for r in records(mixing.mix_sources(table(spark, [(1, None, None, "a"), (2, "", None, None)])))] == [0, 0]
    assert records(mixing.mix_sources(table(spark, []))) == []


# --- sharding -------------------------------------------------------------------------------------------------


def brute_capacity(sizes, shards):
    capacity = max(sizes)
    while True:
        need, held = 1, 0
        for x in sizes:
            need, held = (need, held + x) if held + x <= capacity else (need + 1, x)
        if need <= shards:
            return capacity
        capacity += 1


def test_minimax_cuts_are_the_least_capacity():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 25))]
        k = rng.randrange(1, 8)
        capacity, cuts = sharding.minimax_cuts(sizes, k)
        assert capacity == brute_capacity(sizes, k) and len(cuts) == k and cuts[-1] == len(sizes)
        assert all(sum(sizes[a:b]) <= capacity for a, b in zip([0, *cuts], cuts))


def test_sharding(spark, rows):
    got = records(sharding.shard_documents(table(spark, rows, CLASHING)))
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"}
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(0 <= s < 16 and sorted(v) == list(range(len(v))) for s, v in by.items())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    place = {}
    for r in got:
        assert place.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]
    assert records(sharding.shard_documents(table(spark, []))) == []


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_shards_have_the_least_capacity(spark, rows, digits, monkeypatch):
    """Brute force over the groups themselves; with units of one digit most cuts fall into units that are refined."""
    monkeypatch.setattr(sharding, "UNIT_DIGITS", digits)
    monkeypatch.setattr(sharding, "FINER", 1)
    rng = random.Random(31)
    docs = [(k, words(rng, rng.randint(1, 60))) for k in range(400)] + [(1000 + k, t) for k, (_, t, *_) in enumerate(rows[:40])] * 2
    for shards in (2, 7, 16):
        got = records(sharding.shard_documents(table(spark, docs), shards=shards))
        groups = Counter()
        for _, t in docs:
            data = (t or "").encode()
            groups[hashlib.md5(data).hexdigest()] += len(data) + 1
        sizes = [groups[g] for g in sorted(groups)]
        low, high = max(sizes), sum(sizes)
        while low < high:
            mid, need, kept = (low + high) // 2, 1, 0
            for x in sizes:
                need, kept = (need, kept + x) if kept + x <= mid else (need + 1, x)
            low, high = (low, mid) if need <= shards else (mid + 1, high)
        held = Counter()
        for r in got:
            held[r["shard"]] += r["size"]
        assert max(held.values()) == low and len(got) == len(docs)


# --- SimHash --------------------------------------------------------------------------------------------------


def plain_simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(fps):
    roots = list(range(len(fps)))

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                roots[find(a)] = find(b)
    return [find(a) for a in range(len(fps))]


def test_simhash_components(spark, rows):
    got = records(simhash.near_duplicates(table(spark, rows, CLASHING)))
    fps = [plain_simhash(t) for _, t, *_ in rows]
    least = {}
    for (i, *_), root in zip(rows, brute_components(fps)):
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    want = Counter((i, f, least[root]) for (i, *_), f, root in zip(rows, fps, brute_components(fps)))
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want
    assert Counter(r["component_id"] for r in got if r["keep"]).most_common(1)[0][1] == 1
    assert records(simhash.near_duplicates(table(spark, []))) == []


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def edited(rng, text, share):
    w = text.split()
    for k in rng.sample(range(len(w)), max(1, round(share * len(w)))):
        w[k] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def test_similarity_links_all_pairs_at_the_threshold(spark):
    rng = random.Random(12)
    texts = [None, "", " \n", "one two", "One  two", "three four"]
    for n in range(60):
        base = words(rng, rng.randint(60, 400))
        texts += [base, *(edited(rng, base, s) for s in (0.01, 0.02, 0.03))]
    base = words(rng, 200)
    texts += [base] * 40 + [edited(rng, base, 0.01) for _ in range(120)]  # a large group, pairs of it on both sides of 0.8
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, "three four")]
    sets = [shingles(t) for _, t in docs]
    roots, missed = list(range(len(docs))), 0

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                roots[find(a)] = find(b)
                missed += (plain_simhash(docs[a][1]) ^ plain_simhash(docs[b][1])).bit_count() > 2 if a < 100 else 0
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min((x for x in (least.get(find(k)), i) if x is not None), default=None)
    got = records(simhash.near_duplicates(table(spark, docs, CLASHING), shingle=5, similarity=0.8, carry=("text", "row", "keep")))
    assert missed > 30
    assert Counter((r["doc_id"], r["component_id"], r["carry_text"]) for r in got) == Counter((i, least[find(k)], t) for k, (i, t) in enumerate(docs))
    assert sum(r["keep"] for r in got) == len({find(k) for k in range(len(docs))})
    assert records(simhash.near_duplicates(table(spark, []), shingle=5, similarity=0.8)) == []


def test_found_links_are_walked_once(spark, monkeypatch):
    """Rounds hand only what they found to the components, so their rows grow with the members of a group of near copies, not with rounds times all links."""
    rng = random.Random(71)
    base = words(rng, 200)
    docs = [(k, edited(rng, base, 0.01 if k > 7 else 0.02)) for k in range(160)]  # the first ones are less than 0.8 alike to most
    stored, components, found, walked = simhash.stored, simhash.components, [], []

    def counted(df, name):
        out = stored(df, name)
        if name in ("similar-least", "similar-others") or name.startswith("similar-round-") and not name.endswith("-pairs"):
            found.append(out.count())
        return out

    def walk(edges):
        walked.append(edges.count())
        return components(edges)

    monkeypatch.setattr(simhash, "stored", counted)
    monkeypatch.setattr(simhash, "components", walk)
    got = records(simhash.near_duplicates(table(spark, docs), shingle=5, similarity=0.8))
    assert len(found) > 2 and found[1] > 2 * len(docs) and sum(walked) <= len(docs)
    sets, roots = [shingles(t) for _, t in docs], list(range(len(docs)))
    for x, y in combinations(range(len(docs)), 2):
        if roots[x] != roots[y] and jaccard(sets[x], sets[y]) >= 0.8:
            least, other = sorted((roots[x], roots[y]))
            roots = [least if r == other else r for r in roots]
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(roots))


def test_tally_of_shared_lists(spark):
    """Without long lists, the pairs are exactly those of two differing bits or fewer; six equal bytes are sure to share three lists."""
    assert len(simhash.LISTS) == 14
    for n, least in ((2, 3), (1, 7)):
        assert all(sum(not set(q) & set(gone) for q in simhash.LISTS) == least for gone in combinations(range(8), n))
    assert max(sum(not set(q) & set(gone) for q in simhash.LISTS) for gone in combinations(range(8), 3)) < simhash.MIN_SHARED_LISTS
    rng = random.Random(41)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        fps |= {base, *(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(8))}
    fps = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    got = {tuple(sorted((r["u"], r["v"]))) for r in simhash.linked_pairs(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == {(a, b) for a, b in combinations(fps, 2) if ((a ^ b) % 2**64).bit_count() <= 2} and len(got) > 20


def test_links_within_long_lists(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << a) ^ (1 << b) for a, b in combinations_with_replacement(range(20), 2)} | {rng.getrandbits(64) for _ in range(50)}
    fps |= {centre ^ (0xFF << 40) ^ (1 << k) for k in range(64)}
    fps = sorted(fps)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    edges = simhash.linked_pairs(spark.createDataFrame(signed, "fp long"))
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    got = defaultdict(set)
    for (s,) in signed:
        got[found.get(s, s)].add(s % 2**64)
    want = defaultdict(set)
    for f, root in zip(fps, brute_components(fps)):
        want[root].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001), (5000, 1001)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000, 5000: 1000}


# --- decontamination ------------------------------------------------------------------------------------------


def tokens(text):
    out, held = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not c.isdigit() and not ("a" <= c <= "z"):
            out += [held] if held else []
            held = ""
        else:
            held += c
    return out


def brute_decontam(rows, items):
    wins = defaultdict(set)
    for i, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])].add("" if i is None else str(i))
    for i, t, *_ in rows:
        w, hit, ids = tokens(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    ids |= wins[tuple(w[k : k + n])]
        yield i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, rows):
    rng = random.Random(2)
    long = [r for r in rows if r[1] and 30 < len(r[1].split()) < 5000]
    items = [(k, " ".join(long[k][1].split()[3 : 3 + n]).upper()) for k, n in enumerate((25, 10, 12, 9, 4))]
    items += [(7, items[0][1]), (8, None), (9, "..."), (None, words(rng, 15)), (10, "solo"), (11, "aa aa aa")]
    extra = [(900, "x solo, y SOLO é", None, None), (901, "aa aa aa aa aa b aa aa", None, None), (902, items[0][1] + " — " + items[1][1] * 3, None, None)]
    docs = [*rows, *extra]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = records(decontam.decontaminate(table(spark, docs, CLASHING), bench))
    assert Counter(tuple(r.values()) for r in got) == Counter(brute_decontam(docs, items))
    assert sum(r["contaminated"] for r in got) > 6
    none = records(decontam.decontaminate(table(spark, docs), spark.createDataFrame([], "item_id long, text string")))
    assert len(none) == len(docs) and not any(r["contaminated"] for r in none)
    assert records(decontam.decontaminate(table(spark, []), bench)) == []


def brute_matches(rows, items, slop):
    """(document, item, start, exact): the rarest term (by postings, then place) marks the start, all others stand within slop of their places."""
    texts = {i: tokens(t) for i, t in rows}
    freq = Counter(w for ws in texts.values() for w in ws)
    for item, t in items:
        w = tokens(t)
        if any(not freq[x] for x in w):
            continue
        rarest = min(range(len(w)), key=lambda k: (freq[w[k]], k))
        for i, d in texts.items():
            for at in range(len(d)):
                start = at - rarest
                if d[at] != w[rarest]:
                    continue
                near = all(any(0 <= start + k + s < len(d) and d[start + k + s] == w[k] for s in range(-slop, slop + 1)) for k in range(len(w)) if k != rarest)
                if near:
                    yield i, item, start, start >= 0 and d[start : start + len(w)] == w


def test_proximity_matches(spark):
    rng = random.Random(21)
    vocabulary = "one two three four five six".split()
    rows = [(1, "one two three four five"), (2, "one so two three four five"), (3, "five four"), (4, "x five four three two one"), *((k, " ".join(rng.choices(vocabulary, k=40))) for k in range(10, 40))]
    items = [(1, "one two three four five"), (2, "two four"), (3, "six"), (4, "three three one"), (5, "one absent")]
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    windows, owners = decontam.test_windows(bench, "item_id", "text", 10)
    for terms in (None, windows.selectExpr("explode(words) AS term").distinct()):
        index = decontam.build_index(docs, "doc_id", "text", terms)
        names = {r["row"]: r["doc_id"] for r in index.where("document").collect()}
        item = {r["win"]: int(r["item_id"]) for r in owners.collect()}
        for slop in (0, 1, 3):
            got = decontam.phrase_matches(index, decontam.ranked_terms(index, windows), slop).collect()
            assert Counter((names[r["row"]], item[r["win"]], r["start"], r["exact"]) for r in got) == Counter(brute_matches(rows, items, slop))
    near = {r["doc_id"]: r["n_near"] for r in records(decontam.decontaminate(docs, bench.where("item_id = 1"), slop=1))}
    assert near[1] == 0 and near[2] == 1 and near[4] == 0


# --- WARC -----------------------------------------------------------------------------------------------------


def pages_table(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    import base64

    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: 99999\r\n\r\n"
    pages = [(3, "http://a/", "<p>same</p>"), (1, "u", "<p>same</p>"), (2, None, None), (4, "v", ""), (5, "w\r\nX: y", inner), (6, "x", "é" * 70_000 + inner), (7, "y", "WARC/1.1\r\n"), (8, "z", "\r\n\r\n" * 3)]
    path = str(tmp_path / "w")
    warc.write_archives(pages_table(spark, pages).coalesce(1), path)
    got = {int(r["record_id"]): r for r in records(warc.read_archives(spark, path))}
    assert set(got) == {p[0] for p in pages}
    for i, _, html in pages:
        data = (html or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if got[i]["record_type"] == "response":
            assert bytes(got[i]["payload"]) == data
    assert {i: got[i]["refers_to"] for i in got if got[i]["record_type"] == "revisit"} == {3: "1", 4: "2"}


def test_warc_rejects_what_isnt_reached(spark, tmp_path):
    record = lambda body: b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    bodies = [b"one", record(b"fake"), b"\xff\x00" * 50, b"x" + record(b"a") + record(b"b")]
    (tmp_path / "a.warc").write_bytes(b"".join(map(record, bodies)) + b"WARC/1.1\r\nContent-Length: 50\r\n\r\ncut")
    (tmp_path / "b.warc").write_bytes(b"")
    got = sorted(records(warc.read_archives(spark, str(tmp_path))), key=lambda r: r["at"])
    assert [bytes(r["payload"]) for r in got[:4]] == bodies and len(got) == 5


def test_pointer_jumping_is_a_walk_from_the_start():
    rng = random.Random(4)
    for _ in range(100):
        at = sorted(rng.sample(range(1, 200), 30)) if rng.random() < 0.2 else [0, *sorted(rng.sample(range(1, 200), 30))]
        succ = [rng.choice([x for x in [*at, 500] if x > a]) for a in at]
        seen, a = set(), 0
        while a in at:
            seen.add(a)
            a = succ[at.index(a)]
        got = warc.pointer_jumping(pd.DataFrame({"at": at, "successor": succ}))
        assert {a for a, r in zip(at, got) if r} == seen


def test_warc_goes_on_after_damage(spark, tmp_path):
    record = lambda body, length=None: b"WARC/1.1\r\nWARC-Type: resource\r\n" + (b"" if length == "none" else b"Content-Length: %d\r\n" % (len(body) if length is None else length)) + b"\r\n" + body + b"\r\n\r\n"
    good = [record(b"body %d" % k) for k in range(5)]
    (tmp_path / "none.warc").write_bytes(record(b"first", "none") + b"".join(good))
    (tmp_path / "short.warc").write_bytes(good[0] + record(b"0123456789", 4) + b"".join(good[1:]))
    (tmp_path / "long.warc").write_bytes(good[0] + record(b"0123456789", 40) + b"".join(good[1:]))
    (tmp_path / "junk.warc").write_bytes(b"junk\r\n" + b"".join(good))
    (tmp_path / "huge.warc").write_bytes(good[0] + record(b"0123456789", 3 * 2**31) + b"".join(good[1:]))
    (tmp_path / "whole.warc").write_bytes(b"".join(good))
    got = records(warc.read_archives(spark, str(tmp_path)))
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["at"]):
        by[r["file"].rsplit("/", 1)[1]].append(r)
    bodies = lambda name: [bytes(r["payload"]) for r in by[name] if r["payload"].startswith(b"body")]
    assert all(bodies(n) == [b"body %d" % k for k in range(5)] for n in ("none.warc", "short.warc", "long.warc", "junk.warc", "huge.warc", "whole.warc"))
    assert [r["complete"] for r in by["none.warc"]] == [False, *[True] * 5] and [r["resumed"] for r in by["none.warc"]] == [False, *[True] * 5]
    assert bytes(by["short.warc"][1]["payload"]) == b"0123" and by["short.warc"][1]["skipped"] == 6 and not by["short.warc"][1]["complete"]
    assert not any(r["resumed"] or r["skipped"] or not r["complete"] for r in by["whole.warc"])
    sums = {r["file"].rsplit("/", 1)[1]: r for r in records(warc.lost_bytes(warc.read_archives(spark, str(tmp_path))))}
    assert sums["whole.warc"]["incomplete"] == 0 and sums["short.warc"]["skipped"] == 6 and sums["huge.warc"]["incomplete"] == 1


def test_warc_headers_ids_and_digests(spark, tmp_path):
    long_header = b"HTTP/1.1 200 OK\r\nX: " + b"y" * 100_000 + b"\r\n\r\n<p>"
    wrong = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(long_header) + long_header + b"\r\n\r\n"
    (tmp_path / "w.warc").write_bytes(wrong)
    (r,) = records(warc.read_archives(spark, str(tmp_path / "w.warc")))
    assert bytes(r["payload"]) == b"<p>" and r["digest_ok"] is False and r["complete"]
    schema = "page_id long, url string, html string, digest string, n int, first long, value string, `a.b` int"
    pages = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, "v", "<p>a</p>"), (None, None, None), (5, "x", "<p>a</p>")]
    path = str(tmp_path / "p")
    warc.write_archives(table(spark, pages, schema), path)
    got = records(warc.read_archives(spark, path))
    assert Counter((r["record_id"], r["record_type"], r["refers_to"]) for r in got) == Counter([("1", "response", ""), ("1", "response", ""), ("", "revisit", "1"), ("", "response", ""), ("5", "revisit", "1")])
    assert all(r["digest_ok"] for r in got if r["record_type"] == "response")


def test_warc_empty(spark, tmp_path):
    warc.write_archives(pages_table(spark, []), str(tmp_path / "e"))
    assert records(warc.read_archives(spark, str(tmp_path / "e"))) == []


# --- language -------------------------------------------------------------------------------------------------


def test_forward_backward_matches_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    emit, trans, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    gamma, counts, begins, logz = langid.forward_backward(emit, np.array([4, 3]), trans, start, pairs=True)
    want, pair, total = np.zeros((7, 3)), np.zeros((3, 3)), 0.0
    for a, n in ((0, 4), (4, 3)):
        z, g, p = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for y in product(range(3), repeat=n):
            s = np.exp(start[y[0]] + sum(emit[a + k, y[k]] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            z += s
            for k in range(n):
                g[k, y[k]] += s
            for k in range(n - 1):
                p[y[k], y[k + 1]] += s
        want[a : a + n], pair, total = g / z, pair + p / z, total + np.log(z)
    assert np.allclose(gamma, want) and np.allclose(counts, pair) and np.isclose(logz, total) and np.allclose(begins, want[[0, 4]].sum(axis=0))


def test_language(spark):
    rng = random.Random(1)
    make = {"xx": lambda: "".join(rng.choice(["ba", "bo", "bi", "nu"]) for _ in range(3)), "yy": lambda: "".join(rng.choice(["sta", "rke", "ung", "ek"]) for _ in range(3))}
    rows = [(k, " ".join(make[g]() for _ in range(30)), g) for k in range(120) for g in (("xx", "yy")[k % 2],)]
    rows += [(500, None, "xx"), (501, "12 !!", "yy"), (502, "", None), (None, "babobi", "xx"), (503, " ".join(make["yy"]() for _ in range(5000)), None)]
    docs = table(spark, rows, CLASHING)
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in records(langid.languages(docs, model))}
    assert all(got[i]["lang_pred"] == g for i, t, g in rows[:120]) and got[503]["lang_pred"] == "yy"
    assert all(got[i]["lang_pred"] == "und" for i in (500, 501, 502)) and all(0 <= r["score"] <= 1 for r in got.values())
    mixed = langid.word_labels(" ".join([make["xx"]() for _ in range(10)] + [make["yy"]() for _ in range(10)]), model)
    assert [x[1] for x in mixed] == ["xx"] * 10 + ["yy"] * 10
    empty = table(spark, [])
    assert records(langid.languages(empty, langid.fit(empty))) == []


def test_letters_make_words():
    assert langid.WORD.findall("½ ² ① 7 _ x²y") == ["x", "y"] and langid.WORD.findall("हिन्दी और e\u0301te\u0301") == ["हिन्दी", "और", "e\u0301te\u0301"]
    rng = np.random.default_rng(0)
    model = langid.LanguageModel(("a", "b"), rng.normal(size=(langid.SLOTS, 2)), np.zeros((2, 2)), np.zeros(2), {})
    assert langid._classify(["½ ² ①", "٣", "\u0301", None, ""], model, {}, []) == [("und", 0.0)] * 5
    halves = "a" * 20 + "b" * 9_000 + "c" * 20, "a" * 20 + "d" * 9_000 + "c" * 20
    a, b = langid._potentials(list(halves), model.weights, model.lexicon)
    assert not np.allclose(a, b)  # the middle of a long word counts


def test_language_against_brute_force(spark):
    """Each text by itself: the label of the greatest sum of word marginals, weighted by letters."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in records(langid.languages(docs, model))}
    for r in records(docs):
        ws = langid.WORD.findall((r["text"] or "").lower())
        if not ws:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        emit = langid._potentials(ws, model.weights, model.lexicon)
        alpha = np.empty_like(emit)
        alpha[0] = emit[0] + model.start
        add = lambda x: np.logaddexp.reduce(x, axis=0)
        for k in range(1, len(ws)):
            alpha[k] = emit[k] + add(alpha[k - 1][:, None] + model.transitions)
        beta = np.zeros_like(emit)
        for k in range(len(ws) - 2, -1, -1):
            beta[k] = add((model.transitions + emit[k + 1] + beta[k + 1]).T)
        post = np.exp(alpha + beta - add(alpha[-1]))
        sums = (post * np.array([len(w) for w in ws])[:, None]).sum(axis=0)
        want = sums / sums.sum()
        assert got[r["doc_id"]]["score"] == pytest.approx(want.max(), abs=2e-6) and want[model.labels.index(got[r["doc_id"]]["lang_pred"])] == pytest.approx(want.max(), abs=2e-6)


# --- toxicity -------------------------------------------------------------------------------------------------


def brute_segments(s):
    """All maximal segments by the recursive definition: the best, then those left and right of it."""
    best = max(((sum(s[a:b]), -(b - a), -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    a, b = -best[2], -best[2] - best[1]
    return [*brute_segments(s[:a]), (a, b, best[0]), *((x + b, y + b, z) for x, y, z in brute_segments(s[b:]))]


def test_maximal_segments():
    rng = random.Random(9)
    for _ in range(200):
        s = [rng.choice([-1.37, -0.61, -0.23, 0.71, 1.13, 2.09]) + rng.random() / 100 for _ in range(rng.randrange(0, 14))]
        got = toxicity.maximal_segments(np.array(s))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(s)]


def test_segments_take_linear_time():
    import time

    n = 200_000
    rng = np.random.default_rng(2)
    for s in (np.where(np.arange(n) % 2 == 0, 1.0, -1.1), np.where(np.arange(n) % 2 == 0, 1.0, -0.9), np.where(np.arange(n) % 2 == 0, 1.0, np.where(np.arange(n) < n / 2, -1.5, -0.5)), rng.normal(size=n) - 0.1):
        started = time.process_time()
        toxicity.maximal_segments(s)
        assert time.process_time() - started < 1


def test_extreme_value_law_is_recovered():
    rng = np.random.default_rng(5)
    lam, k = 1.7, 0.004
    n = rng.integers(20, 2000, 20_000)
    x = -np.log(-np.log(rng.random(len(n))) / (k * n)) / lam  # P(X <= x) = exp(-k n exp(-lam x))
    got = toxicity.gumbel_parameters([(max(v, 0.0), int(m)) for v, m in zip(x, n)])
    assert got == (pytest.approx(lam, rel=0.05), pytest.approx(k, rel=0.1))
    assert toxicity.gumbel_parameters([]) == toxicity.gumbel_parameters([(0.0, 10), (2.0, 10)]) == (1.0, 1e-3)


def test_toxicity_against_brute_force(spark):
    """Scores from the model's numbers alone: token scores looked up one by one, segments by their recursive definition."""
    import math
    import re

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in records(toxicity.score_documents(docs, model))}
    checked = 0
    for r in records(docs):
        steps = []
        for token in re.findall(r"[^\W_]+", (r["text"] or "").lower()):
            known = [model.scores[u] for u in (token, *(token[:n] + "*" for n in (6, 5, 4) if len(token) > n)) if u in model.scores]
            steps.append(known[0] if known else model.drift)
        hits = [k for k, x in enumerate(steps) if x > 0]
        if len(hits) > 25 or (hits and hits[-1] - hits[0] > 250):
            continue
        checked += bool(hits)
        around = steps[hits[0] : hits[-1] + 1] if hits else []
        level = math.log(max(model.k * len(steps), 1e-9))
        own = [model.lam * z - level for *_, z in brute_segments(around)]
        tail = mass = 0.0
        if own:
            tail = max(own) if max(own) >= 30 else -math.log(1 - math.exp(-math.exp(-max(own)))) if max(own) < 15 else max(own)
            mass = math.log1p(sum(x for x in own if x > 0))
        want = 1 / (1 + math.exp(-(model.bias + model.slopes[0] * tail + model.slopes[1] * mass)))
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-4)
    assert checked > 5


def test_toxicity(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(600):
        w = words(rng, 40).split()
        toxic = k % 5 == 2
        if toxic:
            w.insert(rng.randrange(40), rng.choice(["vileness", "vilely", "grossest"]))
        docs.append((k, " ".join(w), None, None))
        labels.append((k, int(toxic)))
    docs += [(900, None, None, None), (901, "", None, None), docs[2], (None, "vileness", None, None)]
    labels += [(900, 0), (5000, 1), (None, 1), (3, None)]
    d, l = table(spark, docs, CLASHING), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, l)
    got = records(toxicity.score_documents(d, model))
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    want = dict(labels)
    assert sum(r["predicted"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 600) >= 599
    spans = table(spark, [docs[2]]).select(toxicity.toxic_passages(model)("text").alias("s")).first()["s"]
    assert len(spans) == 1 and docs[2][1].split()[spans[0]["start"]] in ("vileness", "vilely", "grossest")
    flat = toxicity.fit(d, spark.createDataFrame([(k, 0) for k in range(50)], "doc_id long, toxic int"))
    assert all(r["score"] < 0.5 for r in records(toxicity.score_documents(d, flat)))
    empty = table(spark, [])
    assert records(toxicity.score_documents(empty, toxicity.fit(empty, l))) == []


# --- PII ------------------------------------------------------------------------------------------------------


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    import re

    card, spaced = "4058826588634783", "4058 8265 8863 4783"
    if not luhn(card):
        card = next(card[:-1] + c for c in "0123456789" if luhn(card[:-1] + c))
        spaced = f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}"
    bad = card[:-1] + str((int(card[-1]) + 1) % 10)
    texts = [f"pay {card} now", f"{spaced}.", f"not {bad}", "born 1987-02-28, or 1987-02-31", "ssn 123-45-6789 000-12-3456", "call +1 (724) 555-3457 or 724-555-3457", "at 16.195.23.156 and 999.1.1.1", "Jo.Doe7@mail.example.com " * 3, None, "", "no digits", "x" * 50_000 + f" {card}"]
    docs = table(spark, [(k, t) for k, t in enumerate(texts)], CLASHING)
    out = pii.pseudonymize(docs, key="k")
    got = {r["doc_id"]: r for r in records(out)}
    new = re.search(r"\d{16}", got[0]["text"])[0]
    assert new != card and luhn(new) and re.sub(r"\D", "", got[1]["text"]) == new and got[11]["text"].endswith(new)
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}\.", got[1]["text"])
    assert got[2]["text"] == texts[2] and got[2]["n_found"] == 0
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d, or 1987-02-31", got[3]["text"]) and "1987-02-28" not in got[3]["text"]
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4} 000-12-3456", got[4]["text"]) and "123-45-6789" not in got[4]["text"]
    a, b = re.fullmatch(r"call \+1 (\(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})", got[5]["text"]).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "7245553457"
    assert re.fullmatch(r"at (\d+\.){3}\d+ and 999\.1\.1\.1", got[6]["text"]) and "16.195.23.156" not in got[6]["text"]
    assert re.fullmatch(r"([A-Z][a-z]\.[A-Z][a-z]{2}\d@mail\.example\.com )\1\1", got[7]["text"]) and "Jo.Doe7" not in got[7]["text"]
    assert got[8]["text"] is None and got[8]["n_found"] == 0 and got[9]["text"] == "" and got[10]["text"] == "no digits"
    back = {r["doc_id"]: r["text"] for r in records(pii.pseudonymize(out.select("doc_id", "text"), key="k", inverse=True))}
    assert back == dict(enumerate(texts))
    assert records(pii.pseudonymize(table(spark, []), key="k")) == []


def _luhn_card(rng, n):
    d = str(rng.randint(3, 6)) + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(d + c for c in "0123456789" if luhn(d + c))


def _iban(rng):
    country, n = rng.choice([("DE", 18), ("FR", 23), ("NO", 11), ("GB", 18)])
    account = ("WEST" if country == "GB" else "") + "".join(rng.choice("0123456789") for _ in range(n - (4 if country == "GB" else 0)))
    spelled = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{country}{98 - int(spelled) % 97:02d}{account}"


def planted(rng):
    """(kind, value): one value of a random kind and layout."""
    d = lambda n, first="0123456789": rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))
    year, month, day = rng.randint(1900, 2099), rng.randint(1, 12), rng.randint(1, 28)
    area, exchange, line = d(3, "23456789"), d(3, "23456789"), d(4)
    sixteen, fifteen, fourteen = (_luhn_card(rng, n) for n in (16, 15, 14))
    account = _iban(rng)
    local = "".join(rng.choice("abcdefghijkXYZ.0123456789") for _ in range(rng.randint(2, 9))).strip(".") or "a"
    return rng.choice([
        ("email", f"{local}@mail.example.com"), ("iban", account), ("iban", " ".join(account[k : k + 4] for k in range(0, len(account), 4))),
        ("date", f"{year}-{month:02d}-{day:02d}"), ("date", f"{day:02d}.{month:02d}.{year}"), ("date", f"{day}.{month}.{year}"), ("date", f"{month}/{day}/{year}"), ("date", f"{month:02d}/{day:02d}/{year}"), ("date", f"{rng.randint(13, 28)}/{month}/{year}"),
        ("card", sixteen), ("card", " ".join(sixteen[k : k + 4] for k in range(0, 16, 4))), ("card", "-".join(sixteen[k : k + 4] for k in range(0, 16, 4))), ("card", f"{fifteen[:4]} {fifteen[4:10]} {fifteen[10:]}"), ("card", f"{fourteen[:4]} {fourteen[4:10]} {fourteen[10:]}"),
        ("ssn", f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"),
        ("phone", f"+1 ({area}) {exchange}-{line}"), ("phone", f"({area}) {exchange}-{line}"), ("phone", f"{area}-{exchange}-{line}"), ("phone", f"{area}.{exchange}.{line}"), ("phone", f"{area} {exchange} {line}"), ("phone", f"+44 20 {d(4)} {d(4)}"), ("phone", f"+33{d(9)}"),
        ("ip", ".".join(str(rng.randint(0, 255)) for _ in range(4))),
    ])


def test_no_planted_value_stays(spark):
    """Random mixtures, values side by side or in words: none is in the result, the inverse restores the text."""
    rng = random.Random(77)
    docs, values = [], []
    for k in range(400):
        own = [planted(rng) for _ in range(rng.randint(1, 5))]
        text = rng.choice(["", "id 12345 ", "see "])
        for kind, v in own:
            # an international phone takes the groups after it, so it stands alone
            before = [", ", "; ", " and ", "\n"] if v.startswith("+") or text.rstrip()[-12:].startswith("+") or "+" in text[-24:] else [", ", " and ", "\n", " ", "  ", " (", ". "]
            text += (rng.choice(before) if text else "") + v
        docs.append((k, text + rng.choice(["", ".", " 12/27", ", ok", ")"])))
        values.append(own)
    out = pii.pseudonymize(table(spark, docs), key="k")
    got = {r["doc_id"]: r for r in records(out)}
    leaks = [(docs[k][1], got[k]["text"], kind, v) for k in range(len(docs)) for kind, v in values[k] if v in got[k]["text"]]
    # a short address or one-letter name may be its own pseudonym
    assert len([x for x in leaks if x[2] != "email" or len(x[3].split("@")[0]) > 2]) == 0, leaks[:5]
    back = {r["doc_id"]: r["text"] for r in records(pii.pseudonymize(out.select("doc_id", "text"), key="k", inverse=True))}
    wrong = [(docs[k][1], got[k]["text"], back[k]) for k in range(len(docs)) if back[k] != docs[k][1]]
    assert len(wrong) == 0, wrong[:5]
    shown = records(pii.pseudonymize(table(spark, docs), key="other"))
    assert sum(r["text"] == got[r["doc_id"]]["text"] for r in shown) == 0


def test_accounts_dates_and_cards_keep_their_checks(spark):
    import datetime
    import re

    rng = random.Random(78)
    texts = [_iban(rng) for _ in range(30)] + [f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2099)}" for _ in range(30)] + [_luhn_card(rng, n) for n in (13, 14, 15, 16, 17, 18, 19) * 3]
    texts += ["2099-12-31", "1900-01-01", "2101-05-05", "1899-12-31", "31.4.1999", "2/30/1999", "DE00370400440532013000", "2019 2020 2021 2022", "999.1.1.1", "1.2.3.4.5", "01.02.03.04"]
    got = {r["doc_id"]: r for r in records(pii.pseudonymize(table(spark, list(enumerate(texts))), key="k"))}
    for k, t in enumerate(texts[:-9]):
        new = got[k]["text"]
        assert new != t and len(new) == len(t) and got[k]["n_found"] == 1
        if k < 30:
            assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1
        elif k < 60:
            datetime.date(*(int(x) for x in reversed(new.split("."))))
        elif k < 81:
            assert luhn(new)
        else:
            assert re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", new)
    assert all(got[k]["text"] == texts[k] for k in range(len(texts) - 9, len(texts)))


def test_phones_beside_other_numbers(spark):
    texts = ["555-123-4567 555-987-6543", "id 12345 555-123-4567", "id 12345 555.123.4567"]
    got = {r["doc_id"]: r for r in records(pii.pseudonymize(table(spark, [(k, t, None, None, None) for k, t in enumerate(texts)]), key="k"))}
    assert [got[k]["n_phone"] for k in range(3)] == [2, 1, 1]
    assert not [k for k, t in enumerate(texts) for n in ("555-123-4567", "555-987-6543", "555.123.4567") if n in got[k]["text"]]


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    d = spark.range(270 * 27).select(*[c.alias(n) for c, n in zip(pii.permute_number((F.col("id") / 27).cast("long"), F.col("id") % 27, 270, 27, "k", "t"), "ab")])
    assert d.distinct().count() == 270 * 27 and d.where("a < 0 OR a >= 270 OR b < 0 OR b >= 27").count() == 0
    e = spark.range(1000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("x"))
    assert e.distinct().count() == 1000 and e.where("length(x) != 3").count() == 0


# --- substring dedup ------------------------------------------------------------------------------------------


def test_repeats(spark):
    rng = random.Random(6)
    line = words(rng, 12).capitalize() + "."
    passage = ". ".join(words(rng, 9).capitalize() for _ in range(6)) + "."
    docs = [
        (10, f"{words(rng, 20)}\n{line}\n{words(rng, 15)}"), (3, f"{line.upper()}\n{words(rng, 9)}"), (7, words(rng, 30) + " " + passage + " " + words(rng, 10)),
        (8, words(rng, 25) + " " + passage), (20, "short line\nshort line\n"), (21, "short line"), (22, None), (23, ""), (24, f"{words(rng, 10)}.\n" * 1 + line),
        (30, words(rng, 8) + "\n" + line + "\n" + line), (31, words(rng, 20_000)),
    ]
    docs += [docs[0], (None, line)]
    got = records(substring.remove_repeats(table(spark, docs, CLASHING), min_passage=1, within=True))
    assert len(got) == len(docs)
    source = dict(docs)
    for r in got:
        t = source[r["doc_id"]]
        if t is None:
            assert r["text"] is None
            continue
        at, kept = 0, ""
        for s in r["removed"]:
            kept, at = kept + t[at : s["start"]], s["end"]
        assert r["text"] == kept + t[at:]
    text = {r["doc_id"]: r["text"] for r in got}
    assert line.upper() in text[3] and all(line not in text[i] for i in (10, 24, 30)) and text[None] == ""
    assert passage in text[7] and ". ".join(passage.split(". ")[1:]) not in text[8] and len(text[8]) < len(source[8]) - 0.7 * len(passage)
    assert text[21] == source[21] and text[31] == source[31] and text[23] == ""
    # brute force: every unit's first occurrence stays
    seen, want = {}, defaultdict(list)
    for i, t in sorted({d for d in docs if d[1]}, key=lambda d: (d[0] is None, d[0] or 0)):
        for a, b, digest, n in sorted(substring.units(t)):
            if digest in seen:
                want[i].append((a, b, n))
            seen.setdefault(digest, (i, a))
    kept = {i: substring.cut(t, substring.runs(want[i], 1))[0] for i, t in docs if t}
    assert {r["doc_id"]: r["text"] for r in got if r["text"]} == {i: t for i, t in kept.items() if t}
    assert records(substring.remove_repeats(table(spark, []))) == []


def test_repeated_passages(spark):
    """The defaults: only passages of 30 words or more that another document has before, whatever their lines; clean documents stay."""
    rng = random.Random(61)
    sentence = lambda n: words(rng, n).capitalize() + ". "
    passage = "".join(sentence(rng.randint(3, 9)) for _ in range(12)).strip()
    verse = "\n".join(words(rng, 3) for _ in range(20))
    licence = sentence(12)
    unspaced = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(700)) + "\u3002"
    docs = [(k, f"{sentence(9)}{licence}\n{sentence(30)}") for k in range(30)]
    docs += [(100, f"{sentence(20)}{passage}\n{sentence(8)}"), (101, f"{sentence(15)}\n{passage.upper()} {sentence(8)}"), (102, f"{passage}\n{passage}")]
    docs += [(200, f"{sentence(9)}\n{verse}\n{sentence(9)}"), (201, f"{sentence(9)}\n{verse}\n"), (300, f"{sentence(9)}\n{unspaced}"), (301, f"{unspaced}\n{sentence(9)}"), (400, f"{sentence(40)}\n" * 5)]
    source = dict(docs)
    got = {r["doc_id"]: r for r in records(substring.remove_repeats(table(spark, docs)))}
    assert all(got[i]["text"] == source[i] and not got[i]["removed"] for i in (*range(30), 100, 200, 300, 400))
    left = {i: len(got[i]["text"].split()) for i in (101, 201)}
    assert 23 <= left[101] <= 23 + 9 and 9 <= left[201] <= 9 + 6 and got[102]["text"] == ""
    assert len(got[301]["text"]) == len(source[301]) - 702 and got[301]["n_chars_removed"] == 702
    assert all(sum(x["end"] - x["start"] for x in r["removed"]) == r["n_chars_removed"] and len(r["removed"]) == r["n_removed"] for r in got.values())


def test_units_are_made_a_piece_at_a_time(spark):
    """A batch of Arrow's size isn't turned into units at once; all texts keep theirs, in order."""
    rng = random.Random(62)
    texts = [None, "", words(rng, 300_000), *(". ".join(words(rng, 7) for _ in range(40)) for _ in range(1500)), None]
    sizes, n, got = [], 0, []
    for out in substring.unit_batches(iter([pd.Series(texts, dtype=object), pd.Series([], dtype=object)])):
        sizes.append(sum(len(t or "") for t in texts[n : n + len(out)]) if len(out) > 1 else 0)
        n += len(out)
        got += [[(u["start"], u["end"], u["digest"], u["words"]) for u in us] for us in out]
    assert got == [list(substring.units(t)) for t in texts] and 0 < max(sizes) <= substring.BATCH_CHARS
    docs = list(enumerate([*texts, texts[5], texts[6]]))
    kept = {r["doc_id"]: r["text"] for r in records(substring.remove_repeats(table(spark, docs)))}
    assert kept == {i: "" if i >= len(texts) else t for i, t in docs}


# --- media ----------------------------------------------------------------------------------------------------


def test_media_round_trip(spark, rows):
    got = records(media.media_table(table(spark, rows, CLASHING)))
    want = Counter()
    for i, t, *_ in rows:
        data = (t or "").encode()
        padded = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        want[i, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert all(len(r["feature"]) == 16 and r["error"] is None for r in got)
    assert records(media.media_table(table(spark, []))) == []


def test_decoders_and_resize():
    rng = np.random.default_rng(3)
    rgb = rng.integers(0, 256, (5, 7, 3), np.uint8)
    assert (media.decode(media.encode_bmp(rgb)) == rgb).all()
    assert (media.decode(b"P6 # c\n7 5\n255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P3\n7 5 255 " + " ".join(map(str, rgb.ravel())).encode()) == rgb).all()
    gray = rgb[:, :, :1]
    assert (media.decode(b"P5\n7 5\n255\n" + gray.tobytes()) == gray).all()
    assert (media.decode(b"P2\n7 5\n255\n" + " ".join(map(str, gray.ravel())).encode()) == gray).all()
    deep = rng.integers(0, 65536, (5, 7, 1), np.uint16)
    assert (media.decode(b"P5\n7 5\n65535\n" + deep.astype(">u2").tobytes()) == deep).all()
    bits = (gray > 127).astype(np.uint8)
    assert (media.decode(b"P1\n7 5\n" + " ".join(map(str, 1 - bits.ravel())).encode()) == bits).all()
    assert (media.decode(b"P4\n7 5\n" + np.packbits(1 - bits[:, :, 0], axis=1).tobytes()) == bits).all()
    assert media.describe(b"junk")[-1] and media.describe(b"P6\n9 9\n255\n")[-1] == "truncated samples"
    big = gray[:, :, 0].repeat(9, axis=0).repeat(9, axis=1).astype(float)
    fine = np.repeat(np.repeat(big, 8, axis=0), 9, axis=1)  # 8 x 9 cells of whole pixels
    cells = fine.reshape(8, fine.shape[0] // 8, 9, fine.shape[1] // 9).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(big, 9, 8), cells)


def bmp32(pixels, masks):
    import struct

    rows, width = pixels.shape
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 66 + rows * width * 4, 0, 0, 66, 40, width, -rows, 1, 32, 3, 0, 0, 0, 0, 0) + struct.pack("<III", *masks) + pixels.astype("<u4").tobytes()


def test_damaged_images_are_rows_with_an_error():
    import struct

    rng = np.random.default_rng(7)
    rgb = rng.integers(0, 256, (5, 7, 3), np.uint8)
    packed = (rgb[:, :, 0].astype(np.uint32) << 2) | (rgb[:, :, 1].astype(np.uint32) << 12) | (rgb[:, :, 2].astype(np.uint32) << 22)
    assert (media.decode(bmp32(packed, (0xFF << 2, 0xFF << 12, 0xFF << 22))) == rgb).all()
    five = np.array([[0, 31 << 5]], np.uint32)
    assert media.decode(bmp32(five, (31, 31 << 5, 31 << 10))).tolist() == [[[0, 0, 0], [0, 255, 0]]]
    palette = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54 + 8, 40, 4, 1, 1, 8, 0, 0, 0, 0, 2, 0) + bytes(8) + bytes([0, 1, 5, 0])
    bad = [b"P2\n2 1\n255\n70000 1", b"P2\n2 1\n255\n-1 1", b"P2\n2 1\n9\n10 1", b"P5\n0 3\n255\n", b"P6\n3 0\n255\n", palette, bmp32(packed, (0, 0, 0)), bmp32(packed, (5, 1, 1)), b"BM" + bytes(60), b"", b"P3\n1 1\n255\nx y z", b"P5 1 1 0 a"]
    for data in [*bad, *(media.encode_bmp(rgb)[:k] for k in range(0, 150, 7)), *(b"P6 7 5 255 " + rgb.tobytes()[:k] for k in (0, 50))]:
        found = media.describe(data)
        assert found[-1] and found[0] is None and found[3] == len(data)


def test_features_against_exact_areas(monkeypatch):
    """Difference hashes from exact fractions, pixel by pixel; blocks of rows don't change them."""
    from fractions import Fraction as Fr

    rng = np.random.default_rng(11)
    for shape in ((8, 24), (16, 24), (40, 24), (3, 5), (1, 1), (9, 10)):
        image = rng.integers(0, 256, (*shape, 3), np.uint8)
        rows, columns = shape
        gray = [[Fr(int(image[y, x].sum()), 3) for x in range(columns)] for y in range(rows)]
        share = lambda k, cells, size, at: max(Fr(0), min(Fr((k + 1) * size, cells), Fr(at + 1)) - max(Fr(k * size, cells), Fr(at)))
        tile = [[sum(share(j, 8, rows, y) * share(i, 9, columns, x) * gray[y][x] for y in range(rows) for x in range(columns)) / (Fr(rows, 8) * Fr(columns, 9)) for i in range(9)] for j in range(8)]
        for block in (4096, 3):
            monkeypatch.setattr(media, "ROWS_AT_ONCE", block)
            assert np.allclose(media.area_resize(image, 9, 8), np.array([[float(v) for v in r] for r in tile]))
        level = [[round(v * 256) for v in r] for r in tile]
        close = any(abs(v * 256 - int(v * 256) - Fr(1, 2)) < Fr(1, 10**6) for r in tile for v in r)
        bits = "".join("1" if r[i + 1] > r[i] else "0" for r in level for i in range(8))
        assert close or media.tile_and_hash(image)[1] == f"{int(bits, 2):016x}"


# --- what all operators share ----------------------------------------------------------------------------------


def test_names_with_dots(spark, rows):
    schema = SCHEMA + ", `a.b` string, `c_0` string, `carry_text` string"
    short = [r for r in rows if not r[1] or len(r[1]) < 3000][:25]
    docs = table(spark, [(*r, *[None] * (5 - len(r)), "kept", "k0", "k1") for r in short], schema)
    carry = ("a.b", "text", "c_0", "carry_text")
    bench = spark.createDataFrame([(1, short[0][1])], "item_id long, text string")
    labels = spark.createDataFrame([(r[0], k % 2) for k, r in enumerate(short)], "doc_id long, toxic int")
    found = [
        mixing.mix_sources(docs, carry=carry), decontam.decontaminate(docs, bench, carry=carry), simhash.near_duplicates(docs, carry=carry), simhash.near_duplicates(docs, shingle=5, similarity=0.8, carry=carry),
        sharding.shard_documents(docs, carry=carry), pii.pseudonymize(docs, key="k", carry=carry), substring.remove_repeats(docs, carry=carry), toxicity.score_documents(docs, toxicity.fit(docs, labels), carry=carry),
    ]
    want = Counter((r[1], "kept", "k0", "k1") for r in short)
    for df in found:
        got = Counter((r["carry_text"] if isinstance(r["carry_text"], (str, type(None))) else None, r["carry_a.b"], r["carry_c_0"], r["carry_carry_text"]) for r in records(df))
        assert got == want
    dotted = docs.withColumnRenamed("text", "the.text").withColumnRenamed("doc_id", "the.id")
    assert len(records(langid.languages(dotted, langid.fit(docs), "the.id", "the.text"))) == len(records(media.media_table(dotted, "the.id", "the.text"))) == len(short)


def test_hot_groups_are_joined_by_broadcast(spark, rows, monkeypatch):
    from panellink.llm import common

    docs = table(spark, [*rows, *[(5000 + k, None, None, None) for k in range(40)], *[(6000 + k, rows[4][1], None, None) for k in range(40)]])
    plain = [records(f(docs)) for f in (simhash.near_duplicates, substring.remove_repeats)]
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    again = [records(f(docs)) for f in (simhash.near_duplicates, substring.remove_repeats)]
    key = lambda r: tuple(str(v) for k, v in r.items() if k != "keep")
    assert all(Counter(map(key, a)) == Counter(map(key, b)) for a, b in zip(plain, again))
    groups = spark.createDataFrame([("a", 10, 1), ("b", 1, 2)], "k string, n long, v int")
    left = spark.createDataFrame([("a",)] * 10 + [("b",), ("c",)], "k string")
    assert Counter(tuple(r) for r in common.join_groups(left, groups, "k", 12, how="left").collect()) == Counter({("a", 1): 10, ("b", 2): 1, ("c", None): 1})
    assert common.join_groups(left, groups, "k", 12).count() == 11


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from panellink.llm import common

    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(RuntimeError):
        common.scratch_root(SimpleNamespace(conf={"spark.checkpoint.dir": ""}, sparkContext=context))
