"""Connected components and other fixpoints over edge tables.

Loops keep their state in written tables (one fresh scan a round) and stop when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.functions.state import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every end of an edge (columns u, v); the label is the least node of the component.

    Alternating large-star and small-star rounds: each halves long paths and shrinks the table towards one edge a node. Joins are
    equi-joins on a node with its pre-aggregated minimum, which Spark can split at a node with many edges. Loops and null ends are ignored.
    """
    state = written(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    mark = None
    for _ in range(max_rounds):
        if mark is not None and mark[0] == 0:
            break
        state = written(_small_star(_large_star(state)), "components")
        seen = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen.n, seen.h):
            break
        mark = (seen.n, seen.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def mesh_components(vertices: DataFrame, edge_table: DataFrame) -> DataFrame:
    """vid, comp: the least vertex of the component; vertices without edges are components of their own."""
    labels = star_components(edge_table.select(F.col("v1").alias("u"), F.col("v2").alias("v")))
    return vertices.select("vid").join(labels.withColumnRenamed("node", "vid"), "vid", "left").select("vid", F.coalesce("label", "vid").alias("comp"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("comp").agg(F.count("*").alias("size"))


def biggest_components(components: DataFrame, n: int) -> DataFrame:
    """Members of the n components of most members (the least label on ties)."""
    top = component_sizes(components).orderBy(F.desc("size"), "comp").limit(n)
    return components.join(top.select("comp"), "comp", "left_semi")


def biggest_per_group(members: DataFrame, group: str) -> DataFrame:
    """Of each group, the members of its biggest component. Columns: group, comp and others."""
    sizes = members.groupBy(group, "comp").agg(F.count("*").alias("__n"))
    best = sizes.groupBy(group).agg(F.max_by("comp", F.struct("__n", -F.col("comp"))).alias("comp"))
    return members.join(best, [group, "comp"], "left_semi")


def n_ring(pairs: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """seed, item, hops for items within n steps of each seed. ``pairs`` has item and other; ``seeds`` has item."""
    reached = seeds.select(F.col("item").alias("seed"), "item", F.lit(0).alias("hops"))
    front = reached
    for k in range(1, n + 1):
        step = front.join(pairs, "item").select("seed", F.col("other").alias("item")).distinct()
        front = step.join(reached, ["seed", "item"], "left_anti").withColumn("hops", F.lit(k))
        reached = reached.unionByName(front)
        if k % 2 == 0 and k < n:
            reached, front = written(reached, "ring"), written(front, "ring")
    return reached


def distance_ring(pairs: DataFrame, seeds: DataFrame, places: DataFrame, radius: float, max_rounds: int = 200) -> DataFrame:
    """seed, item: items connected to the seed through items whose place lies within the radius of the seed's. ``places``: item, x, y, z."""
    at = places.select("item", "x", "y", "z")
    home = at.select(F.col("item").alias("seed"), *[F.col(k).alias(f"s{k}") for k in "xyz"])
    near = sum((F.col(k) - F.col(f"s{k}")) * (F.col(k) - F.col(f"s{k}")) for k in "xyz") <= radius * radius
    reached = front = written(seeds.select(F.col("item").alias("seed"), "item"), "ring")
    for _ in range(max_rounds):
        step = front.join(pairs, "item").select("seed", F.col("other").alias("item")).distinct().join(reached, ["seed", "item"], "left_anti")
        front = written(step.join(at, "item").join(home, "seed").where(near).select("seed", "item"), "ring")
        if front.isEmpty():
            return reached
        reached = written(reached.unionByName(front), "ring")
    raise RuntimeError("the ring did not settle")


FLOOD_ITEMS = 500_000  # items without cluster that one task fills


def _flooded(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """``flood_fill`` of few items: they and the clusters beside them go to one task, which makes all rounds."""
    import numpy as np
    import pandas as pd

    types = dict(state.dtypes)
    beside = state.select(F.col("item").alias("other"), F.coalesce("cluster", F.lit(0)).cast("long").alias("cluster"), F.col("cluster").isNotNull().alias("known"))
    links = pairs.select("item", "other").join(state.where("cluster IS NULL").select("item"), "item").join(beside, "other")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        ids, src = np.unique(df["item"].to_numpy(), return_inverse=True)
        known, top = df["known"].to_numpy(bool), np.iinfo(np.int64).max
        label, done = np.full(len(ids), top), np.zeros(len(ids), bool)
        np.minimum.at(label, src[known], df["cluster"].to_numpy(np.int64)[known])
        done[src[known]] = True
        src, dst = src[~known], np.searchsorted(ids, df["other"].to_numpy()[~known])
        while True:
            reached = done[dst] & ~done[src]
            if not reached.any():
                return pd.DataFrame({"item": ids[done], "taken": label[done]})
            np.minimum.at(label, src[reached], label[dst[reached]])
            done[src[reached]] = True
            src, dst = src[~done[src]], dst[~done[src]]

    new = links.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, f"item {types['item']}, taken {types['cluster']}")
    return written(state.join(new, "item", "left").select("item", F.coalesce("cluster", "taken").alias("cluster")), "flood")


def flood_fill(labels: DataFrame, pairs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """item, cluster: items without cluster take the least cluster of their neighbours, round by round; unreachable items stay null. Once few are left, one task makes the rounds."""
    state = written(labels.select("item", "cluster"), "flood")
    for _ in range(max_rounds):
        left = state.where("cluster IS NULL").count()
        if not left:
            return state
        if left <= FLOOD_ITEMS:
            return _flooded(state, pairs)
        known = state.where("cluster IS NOT NULL").select(F.col("item").alias("other"), "cluster")
        new = state.where("cluster IS NULL").select("item").join(pairs, "item").join(known, "other").groupBy("item").agg(F.min("cluster").alias("taken"))
        new = written(new, "flood-new")
        if new.isEmpty():
            return state
        state = written(state.join(new, "item", "left").select("item", F.coalesce("cluster", "taken").alias("cluster")), "flood")
    raise RuntimeError("the flood did not settle")


def ranged(c: str, cuts: list, at: int = 0) -> Column:
    """Number of the cuts (ascending) below the column, by halves."""
    if not cuts:
        return F.lit(at)
    k = len(cuts) // 2
    return F.when(F.col(c) > F.lit(cuts[k]), ranged(c, cuts[k + 1 :], at + k + 1)).otherwise(ranged(c, cuts[:k], at))


PART_ITEMS = 50_000  # items of a range whose clusters' parts one task finds


def cluster_parts(labels: DataFrame, pairs: DataFrame, block_items: int = PART_ITEMS, task_pairs: int | None = None) -> DataFrame:
    """item, cluster, comp of the items with a cluster: the connected part of their cluster, by its least item.

    A task finds the parts inside a range of items; the links between parts of different ranges go to one task if they are few, else to rounds of joins."""
    import numpy as np
    import pandas as pd

    own = labels.where("cluster IS NOT NULL").select(F.col("item").cast("long").alias("item"), F.col("cluster").cast("long").alias("cluster"))
    count = max(1, -(-own.count() // block_items))
    cuts = own.agg(F.percentile_approx("item", [i / count for i in range(1, count)], 10_000).alias("e")).first().e if count > 1 else []
    block = lambda c: ranged(c, cuts)
    # Pairs out of a range are seen from both sides.
    links = pairs.select(F.col("item").cast("long").alias("item"), F.col("other").cast("long").alias("other"), block("item").alias("near"), block("other").alias("far")).where("item < other OR near <> far")

    def run(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", ignore_index=True)
        ids, cluster = rows["item"].to_numpy(), rows["cluster"].to_numpy()
        a, b, out = links["item"].to_numpy(), links["other"].to_numpy(), (links["near"] != links["far"]).to_numpy()
        at = lambda x: np.minimum(np.searchsorted(ids, x), max(len(ids) - 1, 0))
        if not len(ids):
            return pd.DataFrame({k: a[:0] for k in ("item", "cluster", "part", "other")} | {"row": a[:0] > 0})
        ka, kb = at(a), at(b)
        here = ids[ka] == a
        same = here & ~out & (ids[kb] == b) & (cluster[ka] == cluster[kb])
        nodes, label, _ = signed_components(ka[same], kb[same], np.zeros(same.sum(), np.int64))
        part = np.arange(len(ids))
        part[nodes] = label
        far = np.flatnonzero(here & out)
        which = np.r_[np.arange(len(ids)), ka[far]]
        return pd.DataFrame({"item": ids[which], "cluster": cluster[which], "part": ids[part[which]], "other": np.r_[np.full(len(ids), -1), b[far]], "row": np.r_[np.ones(len(ids), bool), np.zeros(len(far), bool)]})

    found = written(own.withColumn("block", block("item")).groupBy("block").cogroup(links.groupBy("near")).applyInPandas(run, "item long, cluster long, part long, other long, row boolean"), "parts")
    parts = found.where("row").select("item", "cluster", "part")
    theirs = parts.select(F.col("item").alias("other"), F.col("cluster").alias("oc"), F.col("part").alias("op"))
    between = found.where("NOT row").select("cluster", "part", "other").join(theirs, "other").where("cluster = oc AND part <> op")
    between = written(between.select(F.greatest("part", "op").alias("u"), F.least("part", "op").alias("v")).distinct(), "parts-links")
    n = between.count()
    if not n:
        return parts.withColumnRenamed("part", "comp")
    if n > (ORIENT_PAIRS if task_pairs is None else task_pairs):
        root = star_components(between).select(F.col("node").alias("part"), F.col("label").alias("comp"))
    else:
        root = F.broadcast(written(_signed_in(between.select(F.col("u").alias("f"), F.col("v").alias("g"), F.lit(0).alias("odd"), F.lit(0).alias("one")), "one").select(F.col("fid").alias("part"), F.col("label").alias("comp")), "parts-roots"))
    return parts.join(root, "part", "left").select("item", "cluster", F.coalesce("comp", "part").alias("comp"))


def split_clusters(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """item, cluster: of each cluster only the biggest connected part keeps it; the rest becomes null."""
    own = labels.select("item", "cluster")
    kept = biggest_per_group(written(cluster_parts(own, pairs), "cluster-parts"), "cluster").select("item", F.col("cluster").cast(dict(own.dtypes)["cluster"]).alias("kept"))
    return own.join(kept, "item", "left").select("item", F.col("kept").alias("cluster"))


def signed_components(f, g, odd):
    """ids, label, sign of the ends of the pairs (f, g), in one task: the label is the least id of the component, the sign the parity of ``odd`` on the way to it (that found first, if
    ways differ). Roots hook to their least neighbour below them, until none has one."""
    import numpy as np

    ids, ends = np.unique(np.concatenate([f, g]), return_inverse=True)
    src, dst, odd = ends[: len(f)], ends[len(f) :], np.asarray(odd, np.int64)
    label, sign = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    while True:
        a, b, o = label[src], label[dst], odd ^ sign[src] ^ sign[dst]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return ids, ids[label], sign
        src, dst, odd = src[apart], dst[apart], odd[apart]
        high, low, o = np.maximum(a, b)[apart], np.minimum(a, b)[apart], o[apart]
        order = np.lexsort((o, low, high))
        high, low, o = high[order], low[order], o[order]
        first = np.flatnonzero(np.diff(high, prepend=-1))
        label[high[first]], sign[high[first]] = low[first], o[first]
        while True:
            up = label[label]
            if (up == label).all():
                break
            label, sign = up, sign ^ sign[label]


def _signed_in(pairs: DataFrame, key: str) -> DataFrame:
    """fid, label, sign by ``signed_components`` of each group of pairs (f, g, odd)."""
    import pandas as pd

    def run(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("fid", "label", "sign"), signed_components(*(df[k].to_numpy() for k in ("f", "g", "odd"))), strict=True)))

    return pairs.groupBy(key).applyInPandas(run, "fid long, label long, sign int")


def _signed_by_rounds(both: DataFrame, nodes: DataFrame, max_rounds: int) -> DataFrame:
    """fid, label, sign by rounds of joins: the parity of each node to its label travels with the label. ``both``: f, g, odd in both directions."""
    state = written(nodes.select("fid", F.col("fid").alias("label"), F.lit(0).alias("sign")), "orient")
    for _ in range(max_rounds):
        theirs = state.select(F.col("fid").alias("g"), F.col("label").alias("l"), F.col("sign").alias("s"))
        offers = both.join(theirs, "g").select(F.col("f").alias("fid"), "l", F.pmod(F.col("s") + F.col("odd"), F.lit(2)).alias("s"))
        best = offers.groupBy("fid").agg(F.min(F.struct("l", "s")).alias("o"))
        hook = state.join(best, "fid", "left").select("fid", "label", "sign", F.coalesce(F.col("o.l"), F.col("label")).alias("l"), F.coalesce(F.col("o.s"), F.col("sign")).alias("s"))
        moved = hook.select("fid", F.least("label", "l").alias("label"), F.when(F.col("l") < F.col("label"), F.col("s")).otherwise(F.col("sign")).alias("sign"), (F.col("l") < F.col("label")).alias("moved"))
        # Pointer jump: a face follows its label's own label and sign.
        root = moved.select(F.col("fid").alias("label"), F.col("label").alias("rl"), F.col("sign").alias("rs"))
        jumped = moved.join(root, "label", "left").select("fid", F.coalesce("rl", "label").alias("label"), F.pmod(F.col("sign") + F.coalesce("rs", F.lit(0)), F.lit(2)).alias("sign"), (F.col("moved") | (F.col("rl") < F.col("label"))).alias("moved"))
        state = written(jumped, "orient")
        if not state.agg(F.max("moved")).first()[0]:
            return state.select("fid", "label", "sign")
    raise RuntimeError("orientation did not settle")


ORIENT_FACES, ORIENT_PAIRS = 200_000, 500_000  # faces of a block, and pairs of blocks' parts that one task takes


def orient(faces: DataFrame, max_rounds: int = 200, block_faces: int = ORIENT_FACES, task_pairs: int = ORIENT_PAIRS) -> DataFrame:
    """fid, vs, flipped: faces turned so that neighbours across manifold edges agree with the least face of their component.

    Two faces agree if they run through their edge in opposite directions. A signed graph is contracted: the parity of each face to its label
    travels with the label. Ranges of faces are contracted in a task each; pairs between the parts go to one task if they are few, else they are contracted by rounds of joins, which are those of component
    search with a sign. Components that cannot be oriented keep the sign found first."""
    from . import mesh as m

    he = m.half_edges(faces).where("v1 <> v2").select("v1", "v2", "fid", (F.col("src") == F.col("v1")).alias("up"))
    sided = he.groupBy("v1", "v2").agg(F.count("*").alias("nf"), F.min("fid").alias("f"), F.max("fid").alias("g"), F.min_by("up", "fid").alias("fu"), F.max_by("up", "fid").alias("gu"))
    pair = sided.where("nf = 2 AND f <> g").groupBy("f", "g").agg(F.min((F.col("fu") == F.col("gu")).cast("int")).alias("odd"))
    count = -(-faces.count() // block_faces)
    cuts = faces.agg(F.percentile_approx("fid", [i / count for i in range(1, count)], 10_000).alias("e")).first().e if count > 1 else []
    block = lambda c: sum(((F.col(c) > F.lit(e)).cast("int") for e in cuts), F.lit(0))
    pair = written(pair.select("f", "g", "odd", block("f").alias("bf"), block("g").alias("bg")), "orient-pairs")
    part = written(_signed_in(pair.where("bf = bg"), "bf"), "orient-parts")
    between = pair.where("bf <> bg")
    for c in "fg":
        own = part.select(F.col("fid").alias(c), F.col("label").alias(f"l{c}"), F.col("sign").alias(f"s{c}"))
        between = between.join(own, c, "left").withColumns({f"l{c}": F.coalesce(f"l{c}", c), f"s{c}": F.coalesce(f"s{c}", F.lit(0))})
    odd = F.pmod(F.col("odd") + F.col("sf") + F.col("sg"), F.lit(2))
    links = written(between.where("lf <> lg").groupBy(F.least("lf", "lg").alias("f"), F.greatest("lf", "lg").alias("g")).agg(F.min(odd).alias("odd")), "orient-links")
    n = links.count()
    if n > task_pairs:
        both = links.unionByName(links.select(F.col("g").alias("f"), F.col("f").alias("g"), "odd"))
        root = _signed_by_rounds(both, both.select(F.col("f").alias("fid")).distinct(), max_rounds)
    else:
        root = written(_signed_in(links.withColumn("one", F.lit(0)), "one"), "orient")
    # A face without pairs in its block is a part of its own.
    home = faces.join(part, "fid", "left").select("fid", "vs", F.coalesce("label", "fid").alias("label"), F.coalesce("sign", F.lit(0)).alias("sign"))
    top = root.select(F.col("fid").alias("label"), F.col("sign").alias("rs"))
    turned = home.join(F.broadcast(top) if n <= task_pairs else top, "label", "left").withColumn("flipped", F.pmod(F.col("sign") + F.coalesce("rs", F.lit(0)), F.lit(2)) == 1)
    return turned.select("fid", F.when(F.col("flipped"), F.reverse("vs")).otherwise(F.col("vs")).alias("vs"), "flipped")


def bridge_components(vertices: DataFrame, edge_table: DataFrame, cell: float, max_rounds: int = 30) -> DataFrame:
    """v1, v2: shortest links that join the components, by rounds in which each component takes its shortest link to another (Boruvka).
    Candidates are vertex pairs of neighbouring grid cells; the cell doubles while components have none."""
    links = None
    spark = vertices.sparkSession
    comp = written(mesh_components(vertices, edge_table), "bridge")
    place = vertices.select("vid", "x", "y", "z")
    for _ in range(max_rounds):
        if comp.select("comp").distinct().limit(2).count() < 2:
            break
        at = place.join(comp, "vid").withColumns({f"c{k}": F.floor(F.col(k) / cell) for k in "xyz"})
        around = F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), (F.col("cz") + k).alias("cz")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
        wide = at.select("vid", "comp", "x", "y", "z", F.explode(around).alias("c")).select("vid", "comp", "x", "y", "z", "c.*")
        b = at.select(F.col("vid").alias("w"), F.col("comp").alias("wcomp"), *[F.col(k).alias(f"w{k}") for k in "xyz"], "cx", "cy", "cz")
        near = wide.join(b, ["cx", "cy", "cz"]).where("comp <> wcomp")
        d = F.sqrt(sum((F.col(k) - F.col(f"w{k}")) * (F.col(k) - F.col(f"w{k}")) for k in "xyz"))
        best = near.groupBy("comp").agg(F.min(F.struct(d.alias("d"), F.least("vid", "w").alias("v1"), F.greatest("vid", "w").alias("v2"))).alias("l"))
        new = written(best.select("l.v1", "l.v2").distinct(), "bridge-links")
        if new.isEmpty():
            cell *= 2
            continue
        links = new if links is None else written(links.unionByName(new), "bridge-links")
        comp = written(mesh_components(vertices, edge_table.select("v1", "v2").unionByName(links)), "bridge")
    return links if links is not None else spark.createDataFrame([], "v1 long, v2 long")
