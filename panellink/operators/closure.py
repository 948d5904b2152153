"""Greedy one-to-one matching, constrained closure and connected components."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panellink.sources.scratch import settled

#: Candidates of an organization that one task resolves.
TASK_EDGES = 500_000
EDGE = "org string, yr_x int, yr_y int, row_x string, row_y string, score double"
RESOLVED = EDGE + ", uid string, cluster string, rejected long"


def greedy_rows(rows: Iterable[tuple[Hashable, Hashable]]) -> list[int]:
    """Positions of the pairs that are free at both ends, in the order given (best first)."""
    left, right, kept = set(), set(), []
    for k, (a, b) in enumerate(rows):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            kept.append(k)
    return kept


def constrained_union(edges: Iterable[tuple[str, str]], marks: dict[str, Hashable]) -> tuple[dict[str, str], int]:
    """(least member of each node's cluster, refused edges): edges are merged in order unless the clusters share a mark."""
    parent = {x: x for x in marks}
    held = {x: {m} for x, m in marks.items()}
    members = {x: [x] for x in marks}
    refused = 0

    def root(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a == b:
            continue
        if not held[a].isdisjoint(held[b]):
            refused += 1
            continue
        if len(held[a]) < len(held[b]):
            a, b = b, a
        parent[b] = a
        held[a] |= held.pop(b)
        members[a] += members.pop(b)
    least = {r: min(m) for r, m in members.items()}
    return {x: least[root(x)] for x in marks}, refused


def resolve_within(candidates: DataFrame) -> DataFrame:
    """Accepted edges and clusters of each organization, one pass over the candidates above the threshold.

    Edges are accepted greedily within each pair of years; accepted edges are merged strongest first unless the
    clusters share a year.  Ties are broken by the record keys.  Rows with ``uid`` are members (cluster: the least key), the
    others are accepted edges; ``rejected`` counts refused merges on one row of each organization (or component).

    Organizations of up to TASK_EDGES candidates are resolved in a task each.  Larger ones are matched by rounds of mutually best edges
    (``greedy_one_to_one``), and closed a connected component at a time: edges of different components don't interact.
    """

    def resolve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "row_x", "row_y"], ascending=[False, True, True], kind="stable")
        kept = [i for _, part in g.groupby(["yr_x", "yr_y"], sort=False) for i in part.index[greedy_rows(zip(part["row_x"], part["row_y"]))]]
        e = g.loc[kept].sort_values(["score", "row_x", "row_y"], ascending=[False, True, True], kind="stable")
        years = dict(zip(e["row_x"], e["yr_x"])) | dict(zip(e["row_y"], e["yr_y"]))
        cluster, refused = constrained_union(zip(e["row_x"], e["row_y"]), years)
        members = pd.DataFrame({"org": g["org"].iloc[0], "uid": list(cluster), "cluster": list(cluster.values()), "rejected": 0})
        members.loc[members.index[:1], "rejected"] = refused
        out = pd.concat([e[["org", "yr_x", "yr_y", "row_x", "row_y", "score"]], members])
        for c in ("yr_x", "yr_y", "rejected"):
            out[c] = out[c].astype("Int64")
        return out[["org", "yr_x", "yr_y", "row_x", "row_y", "score", "uid", "cluster", "rejected"]].astype({"score": "float64"})

    edges = settled(candidates.select(*[F.col(c.split()[0]) for c in EDGE.split(", ")]), "candidates")
    large = edges.groupBy("org").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TASK_EDGES).select("org")
    large = settled(large, "large-organizations")
    if large.limit(1).count() == 0:
        return edges.groupBy("org").applyInPandas(resolve, RESOLVED)
    small = edges.join(large, "org", "left_anti").groupBy("org").applyInPandas(resolve, RESOLVED)
    # one partner for a record and a year
    rest = edges.join(large, "org", "left_semi").withColumns({"x": F.concat_ws(">", "row_x", F.col("yr_y").cast("string")), "y": F.concat_ws(">", "row_y", F.col("yr_x").cast("string"))})
    accepted = settled(greedy_one_to_one(rest, "x", "y").drop("x", "y"), "matched")
    parts = connected_components(accepted, "row_x", "row_y")
    whole = accepted.join(parts, accepted["row_x"] == parts["node"]).drop("node")

    def close(g: pd.DataFrame) -> pd.DataFrame:
        return resolve(g.drop(columns="component"))

    return small.unionByName(whole.groupBy("component").applyInPandas(close, RESOLVED))


def greedy_one_to_one(edges: DataFrame, x: str = "row_x", y: str = "row_y", score: str = "score", max_rounds: int = 1000) -> DataFrame:
    """Greedy matching of any bipartite edges, without gathering them: mutual best edges are accepted round by round.

    In the strict order (score, x, y) an edge that is best at both ends is one that the greedy scan would take; with
    its ends' other edges gone, the rest is the same problem.  Rounds are stored tables.
    """
    order = [F.desc(score), F.col(x), F.col(y)]
    left, accepted = settled(edges, "greedy"), None
    for _ in range(max_rounds):
        ranked = left.withColumn("_x", F.row_number().over(W.partitionBy(x).orderBy(*order))).withColumn("_y", F.row_number().over(W.partitionBy(y).orderBy(*order)))
        best = settled(ranked.where("_x = 1 AND _y = 1").drop("_x", "_y"), "greedy-best")
        if best.limit(1).count() == 0:
            break
        accepted = best if accepted is None else accepted.unionByName(best)
        left = settled(left.join(best.select(x), x, "left_anti").join(best.select(y), y, "left_anti").select(edges.columns), "greedy-left")
    else:
        if left.limit(1).count():
            raise RuntimeError(f"greedy_one_to_one: edges are left after {max_rounds} rounds")
    return accepted if accepted is not None else left.limit(0)


def greedy_within(edges: DataFrame) -> DataFrame:
    """``greedy_one_to_one`` of edges (org, emp_a, emp_b, score) that never leave an organization, one task each; over TASK_EDGES by rounds."""

    def match(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "emp_a", "emp_b"], ascending=[False, True, True], kind="stable")
        return g.iloc[greedy_rows(zip(g["emp_a"], g["emp_b"]))]

    e = edges.select("org", "emp_a", "emp_b", "score")
    n = settled(e.groupBy("org").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TASK_EDGES).select("org"), "large-organizations")
    schema = "org string, emp_a string, emp_b string, score double"
    if n.limit(1).count() == 0:
        return e.groupBy("org").applyInPandas(match, schema)
    small = e.join(n, "org", "left_anti").groupBy("org").applyInPandas(match, schema)
    return small.unionByName(greedy_one_to_one(e.join(n, "org", "left_semi"), "emp_a", "emp_b"))


def spanning(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges (a, b) with the same components, in each partition only those that join two components of it: at most one a node."""

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for g in batches:
            kept = []
            for x, y in zip(g[a], g[b]):
                p, q = root(x), root(y)
                if p != q:
                    parent[p] = q
                    kept.append((x, y))
            yield pd.DataFrame(kept, columns=[a, b])

    return edges.select(a, b).mapInPandas(forest, f"{a} string, {b} string")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected edges, component the least node.  Hook to the least parent, halve paths, repeat."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = settled(e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    parents = settled(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("component")), "cc")
    for _ in range(max_rounds):
        p, q = parents.alias("p"), parents.alias("q")
        seen = both.alias("e").join(p, F.expr("e.u = p.node")).join(q, F.expr("e.v = q.node"))
        hooks = seen.select(F.explode(F.array(F.struct(F.col("e.u").alias("node"), F.col("q.component").alias("component")), F.struct(F.col("p.component").alias("node"), F.col("q.component").alias("component")))).alias("h")).select("h.*")
        least = settled(hooks.unionByName(parents).groupBy("node").agg(F.min("component").alias("component")), "cc-hooked")
        x, y, z = least.alias("x"), least.alias("y"), parents.alias("z")
        after = x.join(y, F.expr("x.component = y.node")).join(z, F.expr("x.node = z.node"))
        after = settled(after.select("x.node", F.col("y.component").alias("component"), (F.col("y.component") != F.col("z.component")).alias("moved")), "cc")
        parents = after.select("node", "component")
        if after.where("moved").limit(1).count() == 0:
            return parents
    raise RuntimeError("connected_components: no fixed point")
