"""Module graphs: names, import resolution, degrees, reachability, cycles, longest paths, coarsening.

modules(module, ...), edges(src, dst). Recursive results come from semi-naive rounds: each joins only the rows that are
new, and ends the plan's lineage with a checkpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.ordered import running_sum
from gristmill.sources.tables import cut

#: Last name segments that may have no edges.
ENTRY_POINTS = ("__main__", "main", "cli", "app", "manage")


def module_name(rel_path: Column) -> Column:
    """pkg/a.py -> pkg.a; pkg/__init__.py -> pkg; a root __init__.py is the empty name."""
    package = F.regexp_replace(rel_path, r"(^|/)__init__\.py$", "")
    plain = F.regexp_replace(rel_path, r"(?<=[^/])\.[^./]*$", "")
    return F.replace(F.when(rel_path.rlike(r"(^|/)__init__\.py$"), package).otherwise(plain), F.lit("/"), F.lit("."))


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, name, dst): the module that a name imported in module src means; unresolved names have no row.

    First that exists: for leading dots, src without as many last parts, then the bare rest; else the name itself, the
    name under src's parents from the outermost, and last a module that ends in .name (the smallest, if several do).
    """
    dots = F.length(F.regexp_extract("name", r"^\.*", 0))
    bare = F.regexp_replace("name", r"^\.+", "")
    parts = F.filter(F.split("src", r"\."), lambda x: x != "")
    base = F.slice(parts, 1, F.greatest(F.size(parts) - dots, F.lit(0)))
    joined = lambda *x: F.array_join(F.filter(F.concat(*x), lambda y: y != ""), ".")
    relative = F.array(joined(base, F.array(bare)), bare)
    parents = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: joined(F.slice(parts, 1, k), F.array("name"))))
    absolute = F.concat(F.array("name"), F.coalesce(parents, F.array().cast("array<string>")))
    names = imports.select("src", "name").distinct()
    tried = names.select("src", "name", F.posexplode(F.when(dots > 0, relative).otherwise(absolute)).alias("rank", "tried"))
    known = modules.select("module").distinct()
    exact = tried.join(known, tried["tried"] == known["module"]).groupBy("src", "name").agg(F.min_by("module", "rank").alias("dst"))
    segments = F.split("module", r"\.")
    endings = known.where(F.size(segments) > 1).select("module", F.explode(F.transform(F.sequence(F.lit(2), F.size(segments)), lambda k: F.array_join(F.slice(segments, k, F.size(segments)), "."))).alias("ending"))
    rest = names.where(dots == 0).join(exact, ["src", "name"], "left_anti")
    suffix = rest.join(endings.groupBy("ending").agg(F.min("module").alias("dst")), rest["name"] == F.col("ending")).select("src", "name", "dst")
    return exact.unionByName(suffix)


def dependency_edges(resolved: DataFrame) -> DataFrame:
    """Distinct (src, dst) without self-edges."""
    return resolved.where("src <> dst").select("src", "dst").distinct()


def degrees(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, fan_in, fan_out) for every module."""
    ends = edges.select(F.col("src").alias("module"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    ends = ends.unionAll(modules.select("module", F.lit(0), F.lit(0)))
    return ends.groupBy("module").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def reach(edges: DataFrame) -> DataFrame:
    """(src, dst, level): all dst that a path from src leads to, src itself left out, and the shortest path's length."""
    edges = cut(edges.where("src <> dst").select("src", "dst").distinct())
    found = frontier = cut(edges.withColumn("level", F.lit(1)))
    level = 1
    while not frontier.isEmpty():
        level += 1
        step = frontier.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").where("src <> dst").distinct()
        frontier = cut(step.join(found, ["src", "dst"], "left_anti").withColumn("level", F.lit(level)))
        found = found.unionByName(frontier)
        if level % 8 == 0:
            found = cut(found)
    return found


#: Sources that one row of a search stands for: a bit each.
SOURCES = 64


def reach_counts(edges: DataFrame) -> DataFrame:
    """(src, reach, eccentricity): how many modules a path from src leads to, src left out, and the longest of the shortest paths.

    As `reach` counts them, without a row for each pair: 64 sources are searched from at once, each a bit of a mask, so that a row
    is a module and a group of sources, and there are V / 64 times V of them at most. A round hands the new bits on.
    """
    edges = cut(edges.where("src <> dst").select("src", "dst").distinct())
    number = running_sum(edges.select("src").distinct().withColumn("one", F.lit(1).cast("long")), [], [F.asc("src")], "one", "number")
    own = cut(number.select("src", F.expr(f"(number - 1) div {SOURCES}").alias("part"), F.expr(f"cast((number - 1) % {SOURCES} as int)").alias("bit")))
    seen = frontier = own.select(F.col("src").alias("node"), "part", F.expr("shiftleft(1L, bit)").alias("mask"))
    levels, level = None, 0
    while True:
        level += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).groupBy("part", F.col("dst").alias("node")).agg(F.expr("bit_or(mask)").alias("mask"))
        held = seen.select("part", "node", F.col("mask").alias("had"))
        new = step.join(held, ["part", "node"], "left").select("part", "node", F.expr("mask & ~coalesce(had, 0L)").alias("mask")).where("mask <> 0")
        frontier = cut(new)
        still = cut(frontier.groupBy("part").agg(F.expr("bit_or(mask)").alias("mask")).withColumn("level", F.lit(level)))
        if still.isEmpty():
            break
        levels = still if levels is None else levels.unionByName(still)
        levels = cut(levels) if level % 8 == 0 else levels
        seen = cut(seen.unionByName(frontier).groupBy("part", "node").agg(F.expr("bit_or(mask)").alias("mask")))
    each = F.explode(F.sequence(F.lit(0), F.lit(SOURCES - 1))).alias("bit")
    counts = seen.groupBy("part").agg(F.array(*(F.sum(F.expr(f"shiftrightunsigned(mask, {i}) & 1")) for i in range(SOURCES))).alias("counts"))
    reach = counts.select("part", F.posexplode("counts").alias("bit", "n"))
    far = still.select("part", "level", "mask") if levels is None else levels.select("part", "level", "mask")
    far = far.select("part", "level", "mask", each).where("shiftrightunsigned(mask, bit) & 1 = 1").groupBy("part", "bit").agg(F.max("level").alias("eccentricity"))
    out = own.join(reach, ["part", "bit"]).join(far, ["part", "bit"], "left")
    return out.select("src", (F.col("n") - 1).cast("long").alias("reach"), F.coalesce("eccentricity", F.lit(0)).cast("long").alias("eccentricity"))


def indirect_dependencies(modules: DataFrame, edges: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """(module, reach, indirect, eccentricity): how many can be reached, less the direct ones, and the longest of the shortest paths.

    reached: of `reach`, if there is one already; else counts are made without it."""
    far = reach_counts(edges) if reached is None else reached.groupBy("src").agg(F.count("*").alias("reach"), F.max("level").cast("long").alias("eccentricity"))
    out = degrees(modules, edges).select("module", "fan_out").join(far, F.col("module") == F.col("src"), "left")
    n = F.coalesce("reach", F.lit(0))
    return out.select("module", n.cast("long").alias("reach"), (n - F.col("fan_out")).cast("long").alias("indirect"), F.coalesce("eccentricity", F.lit(0)).cast("long").alias("eccentricity"))


#: Paths are contracted where more nodes than this have one edge in and one out; below, as many plain rounds cost less.
LONG = 64


def _paths(edges: DataFrame) -> bool:
    """Whether there is much to contract: more than LONG inner nodes, and a quarter as many as edges."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    inner = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o = 1 and i = 1").count()
    return inner > LONG and 4 * inner >= edges.count()


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(short, inner, rings) of weighted edges(src, dst, w), without loops: paths through nodes with one edge in and one out as one edge.

    short(src, dst, w) keeps the longest of several edges, loops among them. inner(node, head, tail) has each inner node's path's
    ends. rings(node, component) has the rings of nothing but inner nodes, the smallest member as component. Each round doubles
    what a pointer spans, so rounds are as the logarithm of the longest path.
    """
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"), F.first("dst").alias("to"), F.first("w").alias("w"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"), F.first("src").alias("from"))
    inner = cut(out.join(into, "node").where("o = 1 and i = 1").select("node", "to", "from", F.col("w").cast("long").alias("w"), F.col("node").alias("least")))
    whole = edges.select("src", "dst", F.col("w").cast("long").alias("w"))
    span, at = 1, inner
    n = inner.count()
    while span < n:
        ahead = at.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("w").alias("w2"), F.col("least").alias("least2"))
        behind = at.select(F.col("node").alias("from"), F.col("from").alias("from2"))
        at = at.join(ahead, "to", "left").join(behind, "from", "left")
        at = cut(at.select("node", F.coalesce("to2", "to").alias("to"), F.coalesce("from2", "from").alias("from"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.least("least", F.coalesce("least2", "least")).alias("least")))
        span *= 2
    names = inner.select("node")
    ended = at.join(names.withColumnRenamed("node", "to"), "to", "left_anti").select("node", F.col("from").alias("head"), F.col("to").alias("tail"), "w")
    ended = cut(ended)
    rings = at.join(names.withColumnRenamed("node", "to"), "to", "left_semi").select("node", F.col("least").alias("component"))
    start = whole.join(names.withColumnRenamed("node", "src"), "src", "left_anti")
    direct = start.join(names.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst", "w")
    through = start.withColumnRenamed("w", "w0").join(ended.withColumnRenamed("node", "dst"), "dst").select("src", F.col("tail").alias("dst"), (F.col("w0") + F.col("w")).alias("w"))
    short = cut(direct.unionByName(through).groupBy("src", "dst").agg(F.max("w").alias("w")))
    return short, ended.select("node", "head", "tail"), cut(rings)


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without edges that lead from a node nothing leads to, or to one that leads nowhere: they are in no cycle."""
    n = edges.count()
    while n:
        src, dst = edges.select("src").distinct(), edges.select(F.col("dst").alias("src")).distinct()
        inner = cut(edges.join(dst, "src", "left_semi").join(src.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"))
        left = inner.count()
        if left == n:
            break
        edges, n = inner, left
    return edges


def cycles(edges: DataFrame) -> DataFrame:
    """(module, component, size): modules of strongly connected components of two or more; the id is the smallest member.

    Paths through nodes with one edge in and one out are contracted first, as long as that takes away a good part: such nodes
    are in their ends' component, if both ends are in one. Neither a long chain nor a long ring costs more rounds than the
    logarithm of its length.
    """
    left = cut(edges.where("src <> dst").select("src", "dst").distinct())
    paths, rings, loops = [], [], []
    n = left.count()
    while n and _paths(left):
        left = _without_ends(left)
        short, inner, ring = contracted(left.withColumn("w", F.lit(1)))
        rings.append(ring)
        loops.append(short.where("src = dst").select(F.col("src").alias("node")))
        paths.append(inner)
        left = cut(short.where("src <> dst").select("src", "dst"))
        n = left.count()
    members = _colored(left) if n else None
    # nodes of no component are their own; inner nodes of paths, those contracted last first, take their ends' one
    of = left.select(F.col("src").alias("node"), F.col("src").alias("color")).limit(0) if members is None else members
    for inner, ring, loop in zip(reversed(paths), reversed(rings), reversed(loops), strict=True):
        # a path from a node back to it: the node may be in no component yet
        alone = loop.join(of, "node", "left_anti").select("node", F.col("node").alias("color"))
        of = cut(of.unionByName(alone).unionByName(ring.select("node", F.col("component").alias("color"))))
        a, b = of.select(F.col("node").alias("head"), F.col("color").alias("color")), of.select(F.col("node").alias("tail"), F.col("color").alias("of_tail"))
        of = cut(of.unionByName(inner.join(a, "head").join(b, "tail").where("color = of_tail").select("node", "color")))
    size = of.groupBy("color").agg(F.count("*").alias("size"), F.min("node").alias("component")).where("size > 1")
    return of.join(size, "color").select(F.col("node").alias("module"), "component", "size")


def _without_ends(edges: DataFrame) -> DataFrame:
    """One round of `_trimmed`."""
    src, dst = edges.select("src").distinct(), edges.select(F.col("dst").alias("src")).distinct()
    return cut(edges.join(dst, "src", "left_semi").join(src.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"))


def _colored(edges: DataFrame) -> DataFrame | None:
    """(node, color) of the strongly connected components of one or more, but of nodes that were trimmed away.

    No closure is made, so there never are more rows than edges. Each round trims what is in no cycle; every node takes the
    smallest of those that lead to it as its color; back from that node along edges of one color its component is found,
    and leaves. Every color gives one component a round.
    """
    left = _trimmed(edges)
    found = []
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        color = cut(nodes.withColumn("color", F.col("node")))
        while True:
            over = left.join(color, left["src"] == color["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("near"))
            new = cut(color.join(over, "node", "left").select("node", F.least("color", "near").alias("color"), F.col("color").alias("was")))
            color = new.select("node", "color")
            if new.where("color <> was").isEmpty():
                break
        a, b = color.select(F.col("node").alias("src"), "color"), color.select(F.col("node").alias("dst"), F.col("color").alias("of"))
        same = cut(left.join(a, "src").join(b, "dst").where("color = of").select("src", "dst", "color"))
        members = frontier = cut(color.where("node = color"))
        while not frontier.isEmpty():
            back = same.join(frontier.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "color").distinct()
            frontier = cut(back.join(members, "node", "left_anti"))
            members = cut(members.unionByName(frontier))
        found.append(members)
        gone = members.select("node")
        rest = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = _trimmed(cut(rest.select("src", "dst")))
    return reduce(DataFrame.unionByName, found) if found else None


def longest_path(edges: DataFrame) -> int | None:
    """Edges on the longest path; 0 without edges, None if there is a cycle.

    Sources are peeled off round by round, a module when all that lead to it are gone, each handing on the length up to it.
    Before each round paths without branches are contracted, as long as there are many, so that a long chain is one round.
    """
    left = cut(edges.where("src <> dst").select("src", "dst").distinct().withColumn("w", F.lit(1).cast("long")))
    longest, n, real, stuck = 0, left.count(), None, 0
    while n:
        short = left
        if _paths(left):
            short, _, rings = contracted(left)
            if not rings.isEmpty() or not short.where("src = dst").isEmpty():
                return None
        targets = short.select(F.col("dst").alias("src")).distinct()
        first = cut(short.join(targets, "src", "left_anti").groupBy("dst").agg(F.max("w").alias("w")))
        if first.isEmpty():
            return None
        longest = max(longest, first.agg(F.max("w")).first()[0])
        rest = cut(short.join(targets, "src", "left_semi"))
        # what leads to a node from the peeled ones is kept as one edge from a node of its own, unless nothing leads on from it
        on = first.join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        waiting = on.join(rest.select("dst").distinct(), "dst", "left_semi")
        free = on.join(rest.select("dst").distinct(), "dst", "left_anti").select(F.col("dst").alias("src"), F.col("w").alias("before"))
        ahead = rest.join(free, "src", "left").select("src", "dst", (F.col("w") + F.coalesce("before", F.lit(0))).alias("w"))
        m = rest.where(~F.col("src").cast("string").startswith("\0")).count()
        stuck = stuck + 1 if real is not None and m >= real else 0
        if stuck == 2:
            return None  # nothing is peeled or freed any more: what is left is in cycles or behind them
        real = m
        held = waiting.select(F.concat(F.lit("\0"), F.col("dst").cast("string")).alias("src"), F.col("dst").cast("string").alias("dst"), "w")
        left = cut(ahead.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "w").unionByName(held))
        n = left.count()
    return longest


def orphans(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules without edges whose last segment isn't an entry point's."""
    alone = modules.select("module").join(edges, F.col("module") == F.col("src"), "left_anti").join(edges, F.col("module") == F.col("dst"), "left_anti")
    return alone.where(~F.substring_index("module", ".", -1).isin(*ENTRY_POINTS))


def coarsen(modules: DataFrame, edges: DataFrame, zoom: float) -> tuple[DataFrame, DataFrame]:
    """Names cut to max(1, int(least + zoom * (most - least))) segments; unchanged if all have as many."""
    depth = F.size(F.split("module", r"\."))
    low, high = modules.agg(F.min(depth), F.max(depth)).first()
    if low is None or low == high:
        return modules.select("module").distinct(), edges.select("src", "dst").distinct()
    k = max(1, int(low + zoom * (high - low)))
    short = lambda c: F.substring_index(c, ".", k)
    return modules.select(short("module").alias("module")).distinct(), edges.select(short("src").alias("src"), short("dst").alias("dst")).where("src <> dst").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges (u, v): the smallest node its component has.

    Hash-to-min with pointer jumping: each round takes the smallest label among a node and its neighbours, then that
    label's own label. Rows stay as many as there are nodes.
    """
    both = cut(edges.select("u", "v").unionAll(edges.select("v", "u")).distinct())
    label = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")).withColumnRenamed("u", "id"))
    while True:
        seen = both.join(label, both["v"] == label["id"]).groupBy("u").agg(F.min("c").alias("near"))
        low = label.join(seen, label["id"] == seen["u"]).select("id", F.least("c", "near").alias("c"), F.col("c").alias("was"))
        up = low.select(F.col("id").alias("c"), F.col("c").alias("top"))
        new = cut(low.join(up, "c").select("id", F.least("c", "top").alias("c"), "was"))
        if new.where("c <> was").isEmpty():
            return new.select("id", F.col("c").alias("component"))
        label = new.select("id", "c")
