"""Splits that keep related records together.

Records and the entities they name (paper, claim pair) form a bipartite graph. Its connected
components are found by alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014), and the component's identifier is hashed into ranges
proportional to the wanted shares.

The graph is contracted before the iteration: records of one pair differ only in their papers, so
the pair's least paper is linked with its other papers, and only distinct links are kept. A paper
that holds a third of all rows is then a single node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import hash_uniform, materialize

#: claim_id_pair values that stand for "no pair" (compared in lower case, without outer spaces).
NO_PAIR = ("", "no pair", "n/a", "na", "none", "null", "nan", "-", "no_pair", "nopair")
#: Prefixes of paper identifiers that name a registry, not the paper.
REGISTRY = r"^(?:arxiv|acl|peerj|doi|pmc|id)\s*[:_\-/ ]\s*"
#: A component with at least this share of all rows is placed by room, not by hash; there are at most 1 / GIANT of them.
GIANT = 0.005


def paper_name(paper_id: Column, paper_path: Column) -> Column:
    """The paper as named inside paper_path (`<folder>/<prefix>_<name>.json`), else paper_id brought to that spelling; null where neither names one."""
    file = F.regexp_extract(paper_path, r"([^/]*)\.json\s*$", 1)
    by_path = F.regexp_replace(file, r"^(?:peerj_sibils|[A-Za-z]+)_", "")
    bare = F.lower(F.regexp_replace(paper_id, r"^[\s ]+|[\s ]+$", ""))
    by_id = F.regexp_replace(F.regexp_replace(bare, REGISTRY, ""), r"^(\d{4}\.\d{4,5})v\d+$", "$1")
    return F.coalesce(F.when(by_path != "", by_path), F.when(by_id != "", by_id))


def pair_name(claim_id_pair: Column) -> Column:
    """claim_id_pair without outer spaces; null for null, empty and placeholder values."""
    bare = F.regexp_replace(claim_id_pair, r"^[\s ]+|[\s ]+$", "")
    return F.when(~F.lower(bare).isin(*NO_PAIR), bare)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b): component is the least node of the connected component. Nulls join nothing.

    Each round is a large-star and a small-star step, two shuffles of the distinct links; it ends when a round
    changes nothing. Hubs don't grow: after a large-star step every link points to a smaller node, and a node's
    group is only ever reduced to its minimum (with map-side combining), never gathered into a list.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null").distinct()
    links = materialize(links)
    alone = links.where("u = v").select(F.col("u").alias("node"))
    links = links.where("u <> v")
    seen = None
    while True:  # every round lowers some node's least neighbour, so it ends
        # large star: every larger neighbour of a node is linked with the least of the node and its neighbours
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        links = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the node and its smaller neighbours are linked with the least of them
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        near = links.join(least, "u")
        links = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = materialize(links)
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    linked = stars.union(roots).distinct()
    lonely = alone.distinct().join(linked.select("node"), "node", "left_anti")
    return linked.union(lonely.select("node", F.col("node").alias("component")))


def paper_components(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The named records (row_id, paper, pair) and (paper, component) of papers that a chain of pairs joins with another paper."""
    named = records.select("row_id", paper_name(F.col("paper_id"), F.col("paper_path")).alias("paper"), pair_name(F.col("claim_id_pair")).alias("pair"))
    known = named.where("paper is not null and pair is not null").select("paper", "pair").distinct()
    least = known.groupBy("pair").agg(F.min("paper").alias("least"), F.max("paper").alias("greatest")).where("least <> greatest")
    edges = known.join(least, "pair").where("paper <> least").select(F.col("paper").alias("a"), F.col("least").alias("b"))
    return named, components(edges).select(F.col("node").alias("paper"), "component")


def chained_papers(records: DataFrame) -> DataFrame:
    """(paper_a, paper_b), paper_a < paper_b: papers whose rows must share a split, by pairs and chains of pairs.

    The result lists pairs of papers because it is defined so; papers of one component are joined on its identifier.
    Nulls, empty names and placeholders join nothing; repeated rows change nothing; an empty table gives no rows.
    """
    _, found = paper_components(records)
    found = materialize(found)
    a, b = found.select("component", F.col("paper").alias("paper_a")), found.select("component", F.col("paper").alias("paper_b"))
    return a.join(b, "component").where("paper_a < paper_b").select("paper_a", "paper_b")


def assign(records: DataFrame, targets: DataFrame, seed: int = 2) -> DataFrame:
    """(row_id, component, split): every record gets a split of targets (split, target_share); related records share one.

    The group of a row is its paper's component, its paper, its pair (where no paper is named), or else the row itself.
    Shares are normalised; null and non-positive ones get nothing. Components of at least GIANT of all rows go to the
    split with the most room left, largest first; the others are hashed into ranges proportional to what is left.
    """
    shares = {r.split: float(r.target_share) for r in targets.select("split", "target_share").limit(1001).collect() if r.split is not None and (r.target_share or 0) > 0}
    if not shares or len(shares) > 1000:
        raise ValueError("targets need between 1 and 1000 splits with a positive share")
    total = sum(shares.values())
    shares = {k: v / total for k, v in sorted(shares.items())}
    named, found = paper_components(records)
    of_paper = found.select("paper", F.concat(F.lit("paper:"), "component").alias("joined"))
    # rows that name only a pair follow a paper of that pair
    of_pair = named.where("pair is not null and paper is not null").groupBy("pair").agg(F.min("paper").alias("pair_paper"))
    lonely = named.where("paper is null").join(of_pair, "pair", "left").select("row_id", F.col("pair_paper").alias("paper"), "pair")
    rows = named.where("paper is not null").select("row_id", "paper", "pair").union(lonely)
    rows = rows.join(of_paper, "paper", "left").select("row_id", F.coalesce("joined", F.concat(F.lit("paper:"), "paper"), F.concat(F.lit("pair:"), "pair"), F.concat(F.lit("row:"), F.col("row_id").cast("string"))).alias("component"))
    rows = materialize(rows)
    n = rows.count()
    giants = rows.groupBy("component").count().where(F.col("count") >= max(2.0, GIANT * n)).orderBy(F.desc("count"), "component").collect()
    room, placed = {k: v * n for k, v in shares.items()}, {}
    for g in giants:
        to = max(room, key=lambda k: (room[k], k))
        placed[g["component"]] = to
        room[to] -= g["count"]
    left = {k: max(0.0, v) for k, v in room.items()}
    whole = sum(left.values()) or 1.0
    if not sum(left.values()):
        left, whole = shares, 1.0
    u = hash_uniform(F.col("component"), seed=seed)
    split, edge = None, 0.0
    for k, v in left.items():
        edge += v / whole
        if v > 0:
            split = F.when(u < edge, k) if split is None else split.when(u < edge, k)
    split = split.otherwise(max(left, key=left.get))
    if placed:
        known = F.create_map(*[F.lit(x) for kv in placed.items() for x in kv])
        split = F.coalesce(known[F.col("component")], split)
    return rows.select("row_id", "component", split.alias("split"))
