"""Interlock networks: seats, projections, meta-organizations, cores, centralities and mixing."""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panellink.operators.closure import connected_components
from panellink.operators.profile import modal
from panellink.sources.scratch import settled

# --- fixed values: sector groups --------------------------------------------------------------------------------

#: Sector groups by the first letters of an NTEE code; the first that fits counts.
MAJ12_RULES = (
    ("UNI", ("B40", "B41", "B42", "B43", "B50")), ("HOS", ("E20", "E21", "E22", "E24")), ("ART", ("A",)), ("EDU", ("B",)), ("ENV", ("C", "D")), ("HEL", ("E", "F", "G", "H")),
    ("HMS", ("I", "J", "K", "L", "M", "N", "O", "P")), ("IFA", ("Q",)), ("PSB", ("R", "S", "T", "U", "V", "W")), ("REL", ("X",)), ("MMB", ("Y",)),
)
MAJ10_FOLDS = {"UNI": "EDU", "HOS": "HEL"}

#: Nodes from which one task walks all paths.
SOURCES = 64


def maj12(ntee: Column) -> Column:
    """One of twelve sector groups; UNU for unknown, undefined and Z codes."""
    out = F.lit("UNU")
    for group, starts in reversed(MAJ12_RULES):
        out = F.when(F.substring(ntee, 1, len(starts[0])).isin(list(starts)), group).otherwise(out)
    return F.when(ntee.isNull() | ntee.startswith("UND"), "UNU").otherwise(out)


def maj10(ntee: Column) -> Column:
    m = maj12(ntee)
    return reduce(lambda out, fold: F.when(m == fold[0], fold[1]).otherwise(out), MAJ10_FOLDS.items(), m)


# --- projections -------------------------------------------------------------------------------------------------


def board_seats(profiles: DataFrame, persons: DataFrame | None = None) -> DataFrame:
    """(org, person, years): board members' seats; ``persons`` maps EMP_ID to a person across organizations (XORG_ID)."""
    p = profiles.where("is_board").select("EMP_ID", F.get("orgs", F.lit(0)).alias("org"), "years").where("org IS NOT NULL")
    p = p.join(persons.select("EMP_ID", F.col("XORG_ID").alias("person")), "EMP_ID", "left") if persons is not None else p.withColumn("person", F.col("EMP_ID"))
    p = p.withColumn("person", F.coalesce("person", "EMP_ID"))
    return p.groupBy("org", "person").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("years")))).alias("years"))


def org_pairs(seats: DataFrame, unit: str = "org") -> DataFrame:
    """(u1, u2, w): pairs of units, u1 < u2, and the persons they share.  Only persons of several units are joined."""
    s = seats.select(F.col(unit).alias("u"), "person").distinct()
    several = s.groupBy("person").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("person")
    s = s.join(several, "person")
    pairs = s.alias("a").join(s.alias("b"), F.expr("a.person = b.person AND a.u < b.u"))
    return pairs.groupBy(F.col("a.u").alias("u1"), F.col("b.u").alias("u2")).agg(F.count(F.lit(1)).alias("w"))


def org_projection(seats: DataFrame) -> DataFrame:
    """(u1, u2, w, s1, s2, jaccard, overlap) over organizations; s1 and s2 are board sizes."""
    size = seats.groupBy("org").agg(F.countDistinct("person").alias("s"))
    p = org_pairs(seats).join(size.toDF("u1", "s1"), "u1").join(size.toDF("u2", "s2"), "u2")
    return p.select("u1", "u2", "w", "s1", "s2", (F.col("w") / (F.col("s1") + F.col("s2") - F.col("w"))).alias("jaccard"), (F.col("w") / F.least("s1", "s2")).alias("overlap"))


def person_projection(seats: DataFrame, unit: str = "org") -> DataFrame:
    """(p1, p2): persons of several units who sat on one board in the same year."""
    several = seats.select(unit, "person").distinct().groupBy("person").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("person")
    y = seats.join(several, "person").select(F.col(unit).alias("u"), "person", F.explode("years").alias("y")).distinct()
    pairs = y.alias("a").join(y.alias("b"), F.expr("a.u = b.u AND a.y = b.y AND a.person < b.person"))
    return pairs.select(F.col("a.person").alias("p1"), F.col("b.person").alias("p2")).distinct()


# --- meta-organizations -------------------------------------------------------------------------------------------


def meta_orgs(projection: DataFrame, seats: DataFrame, min_shared: int = 3, jaccard: float | None = 0.5, overlap: float | None = None) -> DataFrame:
    """(org, meta): organizations joined by strong ties are one, named by that with the largest board (ties: least id).

    Ties share ``min_shared`` persons or more and reach ``jaccard`` and, if given, ``overlap``.  Others stand for themselves.
    """
    strong = projection.where(F.col("w") >= min_shared)
    for c, least in (("jaccard", jaccard), ("overlap", overlap)):
        strong = strong if least is None else strong.where(F.col(c) >= least)
    parts = connected_components(strong, "u1", "u2")
    size = seats.groupBy("org").agg(F.countDistinct("person").alias("b"))
    m = parts.join(size, parts["node"] == size["org"]).select("org", "component", "b")
    named = m.groupBy("component").agg(F.min(F.struct((-F.col("b")).alias("b"), F.col("org").alias("org")))["org"].alias("meta"))
    joined = m.join(named, "component").select("org", "meta")
    return size.select("org").join(joined, "org", "left").select("org", F.coalesce("meta", "org").alias("meta"))


def meta_share(projection: DataFrame, seats: DataFrame, meta: DataFrame, rule: str = "") -> DataFrame:
    """One row: how many ties and interlocking persons lie inside meta-organizations."""
    of = lambda c: meta.toDF(c, f"m_{c}")
    t = projection.join(of("u1"), "u1").join(of("u2"), "u2").withColumn("inside", F.col("m_u1") == F.col("m_u2"))
    ties = t.agg(
        F.count(F.lit(1)).alias("ties_1plus"), F.count(F.when(F.col("inside"), 1)).alias("ties_1plus_inside"), F.count(F.when(F.col("w") >= 2, 1)).alias("ties_2plus"),
        F.count(F.when(F.col("inside") & (F.col("w") >= 2), 1)).alias("ties_2plus_inside"),
    )
    k = seats.join(meta, "org").groupBy("person").agg(F.countDistinct("org").alias("k"), F.countDistinct("meta").alias("km")).where("k >= 2")
    people = k.agg(F.count(F.lit(1)).alias("interlockers"), F.count(F.when(F.col("km") == 1, 1)).alias("interlockers_only_inside"))
    groups = meta.groupBy("meta").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("meta_orgs"), F.coalesce(F.sum("n"), F.lit(0)).alias("entities_in_meta"))
    return groups.crossJoin(ties).crossJoin(people).withColumn("rule", F.lit(rule))  # one row each


def collapse(seats: DataFrame, meta: DataFrame) -> DataFrame:
    """(meta, person, years): seats of meta-organizations."""
    return seats.join(meta, "org").groupBy("meta", "person").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("years")))).alias("years"))


# --- mixing ------------------------------------------------------------------------------------------------------


def group_mixing(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, ties, possible, density): ties between groups of units (unit, grp), and their number for 1,000 possible pairs."""
    n = groups.groupBy("grp").agg(F.count(F.lit(1)).cast("double").alias("n"))
    t = pairs.join(groups.toDF("u1", "g1"), "u1").join(groups.toDF("u2", "g2"), "u2")
    t = t.groupBy(F.least("g1", "g2").alias("a"), F.greatest("g1", "g2").alias("b")).agg(F.count(F.lit(1)).alias("ties"))
    t = t.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    possible = F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    return t.select("a", "b", "ties", possible.alias("possible"), (1000 * F.col("ties") / possible).alias("density"))


def ei_index(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: ties to other groups minus ties inside, as a share of ties with both groups known."""
    t = pairs.join(groups.toDF("u1", "g1"), "u1").join(groups.toDF("u2", "g2"), "u2").where("g1 IS NOT NULL AND g2 IS NOT NULL")
    same = (F.col("g1") == F.col("g2")).cast("double")
    return t.agg(F.count(F.lit(1)).alias("ties"), F.avg(1 - same).alias("external"), F.avg(same).alias("internal"), F.avg(1 - 2 * same).alias("ei"))


# --- graph measures -----------------------------------------------------------------------------------------------


def _both(edges: DataFrame, weight: str | None = None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select(F.col("u1").alias("u"), F.col("u2").alias("v"), w.alias("w")).where("u <> v")
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).dropDuplicates(["u", "v"])


def degrees(edges: DataFrame) -> DataFrame:
    return _both(edges).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with the most nodes (ties: least id)."""
    parts = settled(connected_components(edges, "u1", "u2"), "components")
    top = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return edges.join(parts.join(F.broadcast(top), "component").select(F.col("node").alias("u1")), "u1", "left_semi")  # one row


def coreness(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, core): the largest k whose k-core holds the node.

    Starting from degrees, every node takes the h-index of its neighbours' values until nothing changes; that fixed point is
    the coreness.
    """
    both = settled(_both(edges).select("u", "v"), "core-edges")
    value = settled(both.groupBy("u").agg(F.count(F.lit(1)).cast("int").alias("h")), "core")
    for _ in range(max_rounds):
        seen = both.join(value.toDF("v", "hv"), "v").groupBy("u").agg(F.sort_array(F.collect_list("hv"), asc=False).alias("vs"))
        h = F.size(F.filter(F.transform("vs", lambda x, i: x >= i + 1), lambda ok: ok))
        after = seen.join(value, "u").select("u", F.least(h, F.col("h")).alias("h"), (F.least(h, F.col("h")) != F.col("h")).alias("moved"))
        after = settled(after, "core")
        value = after.select("u", "h")
        if after.where("moved").limit(1).count() == 0:
            return value.toDF("node", "core")
    raise RuntimeError(f"coreness: no fixed point after {max_rounds} rounds")


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """The edges among nodes that keep ``k`` ties or more to each other."""
    kept = settled(coreness(edges).where(F.col("core") >= k).select("node"), "k-core")
    return edges.join(kept.toDF("u1"), "u1", "left_semi").join(kept.toDF("u2"), "u2", "left_semi")


def eigen_centrality(edges: DataFrame, weight: str | None = "w", rounds: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """(node, centrality), 1 for the most central: power iteration on weights plus the identity, which bipartite graphs need.

    It goes on until no value moves by ``tolerance``; that it doesn't in ``rounds`` rounds is an error.
    """
    both = settled(_both(edges, weight if weight in edges.columns else None), "eigen-edges")
    x = settled(both.select(F.col("u").alias("node")).distinct().withColumn("x", F.lit(1.0)), "eigen")
    for _ in range(rounds):
        pulled = both.join(x.toDF("v", "xv"), "v").groupBy(F.col("u").alias("node")).agg(F.sum(F.col("w") * F.col("xv")).alias("s"))
        y = pulled.join(x, "node").select("node", (F.col("s") + F.col("x")).alias("y"), "x")
        top = y.agg(F.max("y").alias("top"))
        after = settled(y.crossJoin(F.broadcast(top)).select("node", (F.col("y") / F.col("top")).alias("x"), F.abs(F.col("y") / F.col("top") - F.col("x")).alias("d")), "eigen")  # one row
        x = after.select("node", "x")
        if (after.agg(F.max("d")).first()[0] or 0.0) < tolerance:
            return x.toDF("node", "centrality")
    raise RuntimeError(f"eigen_centrality: no fixed point after {rounds} rounds")


def transitivity(edges: DataFrame) -> DataFrame:
    """One row: triangles, wedges and 3 * triangles / wedges.  Edges point to the node of more ties, which bounds the join."""
    both = _both(edges)
    d = both.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    ranked = both.join(d.toDF("u", "du"), "u").join(d.toDF("v", "dv"), "v").where("du < dv OR (du = dv AND u < v)").select("u", "v")
    a, b, c = ranked.alias("a"), ranked.alias("b"), ranked.alias("c")
    triangles = a.join(b, F.expr("a.u = b.u AND a.v < b.v")).join(c, F.expr("a.v = least(c.u, c.v) AND b.v = greatest(c.u, c.v)"))
    n = triangles.agg(F.count(F.lit(1)).alias("triangles"))
    wedges = d.agg(F.coalesce(F.sum(F.col("d").cast("double") * (F.col("d") - 1) / 2), F.lit(0.0)).alias("wedges"))
    return n.crossJoin(wedges).withColumn("transitivity", F.when(F.col("wedges") > 0, 3 * F.col("triangles") / F.col("wedges")))


def _brandes(sources: list[str], links: dict[str, list[str]]) -> dict[str, float]:
    """What paths from ``sources`` add to the betweenness of undirected, unweighted nodes; each pair counts by half from either end."""
    score = dict.fromkeys(links, 0.0)
    for s in sources:
        order, before, paths, far = [], {s: []}, {s: 1.0}, {s: 0}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in links[v]:
                if w not in far:
                    far[w], paths[w], before[w] = far[v] + 1, 0.0, []
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        lean = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                lean[v] += paths[v] / paths[w] * (1 + lean[w])
            if w != s:
                score[w] += lean[w] / 2
    return score


def betweenness(edges: DataFrame, normalized: bool = False) -> DataFrame:
    """(node, betweenness), by components, which don't share paths, and within them by SOURCES nodes from which paths are walked.

    The edges of a component are in each of its tasks and must fit one; the walks, which take the time, are spread.
    """
    parts = settled(connected_components(edges, "u1", "u2"), "between-parts")
    both = _both(edges).join(parts.select(F.col("node").alias("u"), "component"), "u")
    total = parts.count()

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        links: dict[str, list[str]] = {}
        for u, v in zip(g["u"], g["v"]):
            links.setdefault(u, []).append(v)
        own, of = int(g["part"].iloc[0]), int(g["parts"].iloc[0])
        score = _brandes(sorted(links)[own::of], {u: sorted(vs) for u, vs in links.items()})
        return pd.DataFrame({"node": list(score), "betweenness": list(score.values())})

    parts_of = parts.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / SOURCES).cast("int").alias("parts"))
    spread = both.select("component", "u", "v").join(parts_of, "component").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    out = spread.groupBy("component", "part").applyInPandas(walk, "node string, betweenness double").groupBy("node").agg(F.sum("betweenness").alias("betweenness"))
    scale = (total - 1) * (total - 2) / 2 if normalized and total > 2 else 1.0
    return out.withColumn("betweenness", F.col("betweenness") / F.lit(float(scale)))


# --- bridges, spanners and name risk ------------------------------------------------------------------------------


def bridges(seats: DataFrame, attributes: DataFrame, unit: str = "org", brokerage: bool = False) -> DataFrame:
    """(person, boards, sectors, cbsas, sole_links[, brokerage]) of persons on two boards or more.

    ``attributes`` has (unit, sector, cbsa).  sole_links are pairs of units that only this person ties; brokerage is the
    betweenness in the graph of persons and units.
    """
    s = seats.select(F.col(unit).alias("u"), "person").distinct()
    s = s.join(s.groupBy("person").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("person"), "person")
    w = org_pairs(seats, unit)
    pairs = s.alias("a").join(s.alias("b"), F.expr("a.person = b.person AND a.u < b.u")).select(F.col("a.u").alias("u1"), F.col("b.u").alias("u2"), F.col("a.person").alias("person"))
    sole = pairs.join(w, ["u1", "u2"]).groupBy("person").agg(F.count(F.when(F.col("w") == 1, 1)).alias("sole_links"))
    known = F.when(F.col("sector") != "UNU", F.col("sector"))
    b = s.join(attributes.toDF("u", "sector", "cbsa"), "u", "left").groupBy("person").agg(F.count(F.lit(1)).alias("boards"), F.countDistinct(known).alias("sectors"), F.countDistinct("cbsa").alias("cbsas"))
    b = b.join(sole, "person", "left").withColumn("sole_links", F.coalesce("sole_links", F.lit(0)))
    if not brokerage:
        return b
    graph = s.select(F.concat(F.lit("p:"), "person").alias("u1"), F.concat(F.lit("o:"), "u").alias("u2"))
    bt = betweenness(graph, normalized=True).where(F.col("node").startswith("p:")).select(F.substring("node", 3, 1_000_000).alias("person"), F.col("betweenness").alias("brokerage"))
    return b.join(bt, "person", "left")


def spanners(pairs: DataFrame, places: DataFrame, min_shared: int = 2) -> DataFrame:
    """(unit, place, ties, cross_ties, cross_members, kind): units whose strong ties cross places."""
    t = pairs.where(F.col("w") >= min_shared).join(places.toDF("u1", "p1"), "u1").join(places.toDF("u2", "p2"), "u2").withColumn("cross", F.coalesce(F.col("p1") != F.col("p2"), F.lit(False)))
    ends = t.select(F.explode(F.array("u1", "u2")).alias("unit"), "w", "cross")
    n = ends.groupBy("unit").agg(F.count(F.lit(1)).alias("ties"), F.count(F.when(F.col("cross"), 1)).alias("cross_ties"), F.coalesce(F.sum(F.when(F.col("cross"), F.col("w"))), F.lit(0)).alias("cross_members"))
    out = places.toDF("unit", "place").join(n, "unit", "left").na.fill(0, ["ties", "cross_ties", "cross_members"])
    return out.withColumn("kind", F.when(F.col("cross_ties") > 0, "spanner").when(F.col("ties") > 0, "tied within its place").otherwise("no ties"))


def org_attributes(profiles: DataFrame) -> DataFrame:
    """(org, ntee, cbsa, people): the modal codes over an organization's persons."""
    p = profiles.select(F.get("orgs", F.lit(0)).alias("org"), *[modal(F.col(c)).alias(c) if c in profiles.columns else F.lit(None).cast("string").alias(c) for c in ("ntee", "cbsa")]).where("org IS NOT NULL")
    people = p.groupBy("org").agg(F.count(F.lit(1)).alias("people"))

    def top(c: str) -> DataFrame:
        n = p.where(F.col(c).isNotNull()).groupBy("org", c).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("org").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.length(c)).alias("l"), F.col(c).alias("v")))["v"].alias(c))

    return people.join(top("ntee"), "org", "left").join(top("cbsa"), "org", "left").select("org", "ntee", "cbsa", "people")


def name_risk(profiles: DataFrame, persons: DataFrame, seats: DataFrame, least: float = 1.0) -> DataFrame:
    """(person, boards, records, names, lambda, mi_confirmed, ambiguous) of persons on two boards or more.

    lambda is the number of persons with the full name to be expected from the shares of its given name and surname among all
    profiles; a person is ambiguous if one name that common stands on all its records and no middle initial confirms it.
    """
    full = F.concat_ws(" ", "first_name", "last_name")
    p = profiles.select("EMP_ID", "first_name", "last_name", full.alias("full"), "middle_initials", F.get("orgs", F.lit(0)).alias("org"), "is_board")
    n = p.agg(F.count(F.lit(1)).cast("double").alias("n"))

    def share(c: str) -> DataFrame:
        return p.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).cast("double").alias(f"n_{c}"))

    totals = p.agg(F.count("first_name").alias("nf"), F.count("last_name").alias("nl"))
    names = p.select("full", "first_name", "last_name").distinct().join(share("first_name"), "first_name").join(share("last_name"), "last_name").crossJoin(n).crossJoin(totals)  # one row each
    lam = names.select("full", (F.col("n") * F.col("n_first_name") / F.col("nf") * F.col("n_last_name") / F.col("nl")).alias("lambda"))
    m = p.where("is_board").join(persons.select("EMP_ID", F.col("XORG_ID").alias("person")), "EMP_ID").join(seats.select("org", "person").distinct(), ["org", "person"], "left_semi")
    g = m.groupBy("person").agg(
        F.countDistinct("org").alias("boards"), F.count(F.lit(1)).alias("records"), F.countDistinct("full").alias("names"), F.min("full").alias("full"),
        F.collect_list(F.when(F.size("middle_initials") > 0, F.col("middle_initials"))).alias("mis"),
    ).where("boards >= 2")
    shared = F.aggregate(F.slice("mis", 2, F.greatest(F.size("mis"), F.lit(1))), F.get("mis", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    g = g.withColumn("mi_confirmed", (F.size("mis") >= 2) & (F.size(shared) > 0)).join(lam, "full", "left")
    ambiguous = (F.col("names") == 1) & F.coalesce(F.col("lambda") >= least, F.lit(False)) & ~F.col("mi_confirmed")
    return g.select("person", "boards", "records", "names", "lambda", "mi_confirmed", ambiguous.alias("ambiguous"))


def split_back(seats: DataFrame, persons: DataFrame, ambiguous: DataFrame, unit: str = "org") -> DataFrame:
    """(ties, total, only_ambiguous): ties that would go if every ambiguous person were several."""
    w = org_pairs(seats, unit)
    clear = org_pairs(seats.join(ambiguous.select("person"), "person", "left_anti"), unit).toDF("u1", "u2", "clear")
    j = w.join(clear, ["u1", "u2"], "left").withColumn("clear", F.coalesce("clear", F.lit(0)))
    rows = [j.where(F.col("w") >= k).agg(F.lit(f"{k}+ shared persons").alias("ties"), F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("clear") < k, 1)).alias("only_ambiguous")) for k in (1, 2)]
    return rows[0].unionByName(rows[1])


def network_summary(seats: DataFrame, unit: str = "org") -> DataFrame:
    """One row: units, interlocking persons, ties of one and of two or more shared persons, mean degree."""
    w = org_pairs(seats, unit)
    people = seats.select(unit, "person").distinct().groupBy("person").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").agg(F.count(F.lit(1)).alias("interlockers"))
    ties = w.agg(F.count(F.lit(1)).alias("ties_1plus"), F.count(F.when(F.col("w") >= 2, 1)).alias("ties_2plus"))
    nodes = w.select(F.explode(F.array("u1", "u2")).alias("u")).agg(F.countDistinct("u").alias("tied_units"))
    out = seats.agg(F.countDistinct(unit).alias("units")).crossJoin(people).crossJoin(ties).crossJoin(nodes)  # one row each
    return out.withColumn("mean_degree", F.when(F.col("tied_units") > 0, 2 * F.col("ties_1plus") / F.col("tied_units")))


def top_brokers(edges: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` nodes of greatest betweenness (ties: least id)."""
    return betweenness(edges).orderBy(F.desc("betweenness"), "node").limit(k)

