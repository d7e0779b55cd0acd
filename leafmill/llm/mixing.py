"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document belongs to). A flow network routes
each pattern's words to the quotas of its sources; a further copy of a pattern costs more than the one before, so
repetition is convex and documents repeat only where the quotas need it. Documents are then selected by a seeded hash.
"""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stash, tune
from .components import components

#: Bits of the seeded hash, and those that one round of the histogram resolves.
HASH_BITS, BITS = 63, 10

#: Rounds that fill what the edge leaves open, and the share of a quota that may stay open.
FILLS, NEAR = 6, 0.0005

#: Rows of a pattern, at most, that are chosen to the word where one move at a time doesn't come near enough; with more rows there is nearly always a row of the right size.
FEW = 64

#: Patterns that one network on the driver routes. More are routed by tables, one network for each group of sources that patterns connect, with the same result.
PATTERNS_AT_ONCE = 2_000

#: Equal rows that one task deals out.
ALIKE = 100_000


def share_targets(sizes: dict, weights: dict, budget: float, limit: float) -> dict:
    """Splits `budget` by weight; what is above `limit` times a source's size goes to the others by weight, until none is above."""
    targets, free, left = dict.fromkeys(sizes, 0.0), [s for s in sizes if weights[s] > 0], float(budget)
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > limit * sizes[s]]
        if not over:
            targets |= {s: left * weights[s] / total for s in free}
            break
        for s in over:
            targets[s] = float(limit * sizes[s])
            left -= targets[s]
        free = [s for s in free if s not in over]
    return targets


def route(capacity: dict, members: dict, quota: dict, copies: int) -> dict:
    """Min-cost maximum flow: words of each (pattern, source). A pattern's copy k costs k squared a word.

    capacity: words of a pattern; members: its sources; quota: words wanted of a source. Primal and dual steps in turn:
    shortest distances give heights, and all that fits flows along edges without reduced cost. The steps are as many as
    there are path costs, not paths, and the result doesn't depend on hashing.
    """
    cap: dict = defaultdict(int)
    cost: dict = {}
    near: dict = defaultdict(dict)

    def edge(a, b, c, w):
        cap[a, b] += c
        cost[a, b], cost[b, a] = w, -w
        near[a][b] = near[b][a] = None

    for p, words in capacity.items():
        for k in range(copies):
            edge("start", ("copy", p, k), words, 0)
            edge(("copy", p, k), ("pattern", p), words, k * k)
        for s in members[p]:
            edge(("pattern", p), ("source", s), words * copies, 0)
    for s, words in quota.items():
        edge(("source", s), "end", words, 0)
    height: dict = defaultdict(int)

    def distances() -> dict:
        far, heap, n = {"start": 0}, [(0, 0, "start")], 0
        while heap:
            d, _, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for b in near[a]:
                if cap[a, b] > 0 and (e := d + cost[a, b] + height[a] - height[b]) < far.get(b, float("inf")):
                    far[b], n = e, n + 1
                    heapq.heappush(heap, (e, n, b))
        return far

    def free(a, b) -> bool:
        return cap[a, b] > 0 and cost[a, b] + height[a] == height[b]

    def levels() -> dict:
        level, queue = {"start": 0}, ["start"]
        for a in queue:
            for b in near[a]:
                if b not in level and free(a, b):
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    while "end" in (far := distances()):
        for x in near:
            height[x] += min(far.get(x, far["end"]), far["end"])
        while "end" in (level := levels()):
            path, left = ["start"], {x: iter(list(near[x])) for x in near}
            while path:
                a = path[-1]
                if a == "end":
                    steps = list(itertools.pairwise(path))
                    push = min(cap[e] for e in steps)
                    for x, y in steps:
                        cap[x, y] -= push
                        cap[y, x] += push
                    path = path[: next(k for k, e in enumerate(steps) if not cap[e]) + 1]
                    continue
                for b in left[a]:
                    if level.get(b) == level[a] + 1 and free(a, b):
                        left[a] = itertools.chain([b], left[a])  # it may carry more
                        path.append(b)
                        break
                else:
                    path.pop()
                    if path:
                        next(left[path[-1]])  # nothing more that way
    return {(p, s): flow for p in capacity for s in members[p] if (flow := cap[("source", s), ("pattern", p)]) > 0}


def _marked(docs: DataFrame, members: Column, size: Column, seed: int) -> DataFrame:
    """`docs` with what the plan is made for, under names of their own: the pattern, the size and the seeded hash of the whole row, so that rows share a place in the order only if they are equal."""
    plain = [F.col(f"`{f.name}`") if f.dataType.typeName() not in ("map", "variant") else F.to_json(f"`{f.name}`") for f in docs.schema]
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *plain), 64 - HASH_BITS)
    ready = docs.withColumns({"__members": F.array_sort(F.array_distinct(F.coalesce(members.cast("array<string>"), F.array().cast("array<string>")))), "__size": size.cast("long"), "__h": h})
    return ready.withColumn("__pattern", F.to_json("__members"))


def _extra(plan: str, h: str) -> Column:
    """How many of the equal rows with hash `h` are taken once more than the pattern's base: all (null) or none (0), if the hash isn't a special one."""
    told = F.element_at(f"{plan}special", F.col(h))
    before = (F.col(f"{plan}shift") < HASH_BITS) & (F.expr(f"shiftright({h}, {plan}shift)") < F.col(f"{plan}prefix"))
    return F.when(told.isNotNull(), told).when(before, F.lit(None)).otherwise(0)


def _split(rows: DataFrame, plan: DataFrame, pattern: str, h: str) -> tuple[DataFrame, DataFrame]:
    """Rows beside their plan. First those that are taken alike with all their equals, with `__more` (1 or 0); then, one for each, those of which only `__extra` of `__alike` are taken once more."""
    told = rows.join(plan, F.col(pattern) == F.col("__plan.pattern")).withColumn("__extra", _extra("__plan.", h))
    alone = told.where("__extra IS NULL OR __extra = 0").withColumn("__more", F.col("__extra").isNull().cast("int")).drop("__extra")
    some = told.where("__extra > 0")
    columns = [c for c in some.columns if c != h]
    some = some.groupBy(h).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in columns))).alias("__x"), F.count("*").alias("__alike")).select(h, "__x.*", "__alike")
    return alone, some


def _dealt(some: DataFrame, copies: Column) -> DataFrame:
    """Each row of `some` `copies` times, in blocks of ALIKE, so that no task makes an unbounded number of rows."""
    blocks = some.withColumn("__n", copies).where("__n > 0").withColumn("__at", F.explode(F.expr(f"sequence(0L, (__n - 1) div {ALIKE})")))
    return blocks.repartition("__at").withColumn("__k", F.explode(F.expr(f"sequence(__at * {ALIKE}, least(__n, (__at + 1) * {ALIKE}) - 1)")))


def mix(docs: DataFrame, members: Column, size: Column, weight: Callable, budget_share: float, limit: int, seed: int = 17, key: str = "doc_id") -> DataFrame:
    """One row per document: the key, `members`, `size`, `copies`, `taken` (words the mix takes, repeats counted), `plan` (by source: size, target, words routed).

    weight(rank, source) is a source's weight as a column; rank counts the sources in order of code points, null last, from
    0. A null text or an empty one has size 0 and is taken 0 times. Rows that are equal in every column are told apart by
    number only: any of them may be the one that is taken once more.
    """
    rows, plans = _planned(docs, members, size, weight, budget_share, limit, seed, key)
    alone, some = _split(rows, plans, "pattern", "h")
    some = _dealt(some, F.col("__alike")).withColumn("__more", (F.col("__k") < F.col("__extra")).cast("int"))
    columns = ["key", "members", "size", "__plan", "__more"]
    copies = F.when(F.col("size") > 0, F.col("__plan.base") + F.col("__more")).otherwise(0)
    both = alone.select(columns).unionByName(some.select(columns))
    return both.select(F.col("key").alias(key), "members", "size", copies.cast("int").alias("copies"), (copies * F.col("size")).alias("taken"), F.col("__plan.sources").alias("plan"))


def take(docs: DataFrame, members: Column, size: Column, weight: Callable, budget_share: float, limit: int, seed: int = 17, key: str = "doc_id") -> DataFrame:
    """The rows of `docs` as the mix takes them, a row for each copy. Decisions are computed beside the rows; no text is shuffled but those of equal rows that are taken unequally often."""
    _, plans = _planned(docs, members, size, weight, budget_share, limit, seed, key)
    alone, some = _split(_marked(docs, members, size, seed).where("__size > 0"), plans, "__pattern", "__h")
    alone = alone.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__plan.base").cast("int") + F.col("__more"))))
    some = _dealt(some, F.col("__plan.base") * F.col("__alike") + F.col("__extra"))
    names = [f"`{c}`" for c in docs.columns]
    return alone.select(names).unionByName(some.select(names))


def _planned(docs, members, size, weight, budget_share, limit, seed, key):
    """The written rows (key, members, size, h, pattern), and `plan`, a struct for each pattern: where its hashes are cut.

    plan: pattern, base (copies of every row), prefix and shift (rows with a lesser hash are taken once more), special (by
    hash, how many of the rows with it are), sources.
    """
    tune(docs.sparkSession)
    rows = _marked(docs, members, size, seed)
    rows = stash(rows.select(F.col(key).alias("key"), F.col("__members").alias("members"), F.col("__size").alias("size"), F.col("__h").alias("h"), F.col("__pattern").alias("pattern")), "mix-sizes")
    found = stash(rows.groupBy("pattern").agg(F.first("members").alias("members"), F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count_if(F.col("size") > 0).alias("filled")), "mix-patterns")
    sources = found.select(F.explode("members").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("words"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)  # a row for each source
    sources = stash(ranked.withColumn("weight", weight(F.col("rank"), F.col("source")).cast("double")), "mix-sources")
    budget = budget_share * (found.agg(F.sum("words")).first()[0] or 0)
    many = found.count() > PATTERNS_AT_ONCE
    routed = stash((_routed_by_tables if many else _routed_at_once)(found, sources, budget, limit), "mix-routed")
    state = routed.join(found.select("pattern", "filled"), "pattern").select("pattern", (F.col("wanted") - F.expr("coalesce(wanted div nullif(words, 0), 0)") * F.col("words")).alias("rest"), "wanted", "filled")
    cut = _chosen(rows, _filled(rows, _cut(rows, state)))
    plans = routed.join(cut.select("pattern", "prefix", "shift", "special"), "pattern").select(F.struct("pattern", F.expr("coalesce(wanted div nullif(words, 0), 0)").alias("base"), "prefix", "shift", "special", "sources").alias("__plan"))
    return rows, _beside(stash(plans, "mix-plans"))


def _beside(plans: DataFrame) -> DataFrame:
    """Plans to be joined with rows: broadcast while they are counted as small. With one plan for each pattern, and rows by the million for some, the join beyond that can be split where it is skewed."""
    wide = F.length(F.to_json(F.struct("*")))
    return small(plans, 64, wide)


SOURCES = "array<struct<source:string,source_size:long,target:double,routed:long>>"
ROUTED = f"pattern string, words long, wanted long, sources {SOURCES}"


def _routed_at_once(found: DataFrame, sources: DataFrame, budget: float, limit: int) -> DataFrame:
    """ROUTED, by one network on the driver, for at most PATTERNS_AT_ONCE patterns."""
    patterns, about = found.collect(), {r.source: r for r in sources.collect()}
    targets = share_targets({s: r.words for s, r in about.items()}, {s: r.weight for s, r in about.items()}, budget, limit)
    return found.sparkSession.createDataFrame(_network([(r.pattern, r.words, list(r.members)) for r in patterns], {s: (r.words, targets[s]) for s, r in about.items()}, limit), ROUTED)


def _network(patterns: list, about: dict, limit: int) -> list:
    """Rows of ROUTED for patterns (pattern, words, members) and sources (words, target)."""
    capacity, members = {p: w for p, w, _ in patterns}, {p: m for p, _, m in patterns}
    flow = route(capacity, members, {s: round(about[s][1]) for s in sorted({s for m in members.values() for s in m}, key=lambda s: (s is None, s or ""))}, limit)
    return [(p, w, sum(flow.get((p, s), 0) for s in m), [(s, int(about[s][0]), float(about[s][1]), int(flow.get((p, s), 0))) for s in m]) for p, w, m in sorted(patterns)]


def _routed_by_tables(found: DataFrame, sources: DataFrame, budget: float, limit: int) -> DataFrame:
    """ROUTED for any number of patterns.

    Targets: what is above the limit is reshared until none is, so the sources at their limit are those with the least
    limit for their weight; running sums in that order say how many there are. Then the patterns that sources connect make
    a network of their own, in a task of its own: networks that share no source don't touch each other's flow.
    """
    ratio = F.when(F.col("weight") > 0, limit * F.col("words") / F.col("weight"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    free = sources.where("weight > 0").withColumn("ratio", ratio)
    sums = free.withColumns({"full": F.sum(limit * F.col("words")).over(order), "used": F.sum("weight").over(order)})  # a row for each source
    whole = free.agg(F.sum("weight")).first()[0] or 0.0
    # What is left when all before a source are at their limit, by weight: the first source whose ratio isn't below it, and all after it, share it.
    at = sums.withColumn("before", (F.lit(budget) - F.col("full") + limit * F.col("words")) / (F.lit(whole) - F.col("used") + F.col("weight")))
    first = at.where("before <= ratio").agg(F.max("before")).first()[0]  # it falls from source to source
    reached = F.when(F.col("weight") > 0, F.least(limit * F.col("words").cast("double"), F.col("weight") * F.lit(first)) if first is not None else limit * F.col("words").cast("double")).otherwise(0.0)
    targets = stash(sources.select("source", F.col("words").alias("source_size"), reached.alias("target")), "mix-targets")

    links = found.select("pattern", F.explode("members").alias("source"))
    named = links.select(F.concat(F.lit("p"), "pattern").alias("a"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("b"))
    groups = components(named)
    group = found.join(groups.select(F.col("a").alias("_a"), F.col("b").alias("group")), F.concat(F.lit("p"), "pattern") == F.col("_a"), "left").select("pattern", "words", "members", F.coalesce("group", F.concat(F.lit("p"), "pattern")).alias("group"))
    full = group.select("group", "pattern", "words", "members", F.explode_outer("members").alias("source")).join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")) & (F.size("members") > 0), "left")
    return full.select("group", "pattern", "words", "members", "source", "source_size", "target").groupBy("group").applyInPandas(_solver(limit), ROUTED)


def _solver(limit: int):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        none = lambda s: None if s is None or s != s else s
        about = {none(r.source): (int(r.source_size), float(r.target)) for r in rows.itertuples() if r.source_size == r.source_size}
        patterns = {r.pattern: (r.pattern, int(r.words), list(r.members)) for r in rows.itertuples()}
        return pd.DataFrame(_network(list(patterns.values()), about, limit), columns=["pattern", "words", "wanted", "sources"])

    return solve


def _cut(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Where the rest of each pattern ends in the order of the hash: pattern, wanted, rest (what the cut leaves open), prefix, shift, special.

    A histogram of the leading bits finds the bin in which the rest ends, and is refined inside that bin only, until it
    holds equal rows alone, of which as many are taken as fit. Nothing is sorted or gathered; the state is a table.
    """
    none = F.create_map().cast("map<long,long>")
    state = stash(state.select("pattern", "wanted", "filled", F.col("rest").alias("aim"), "rest", F.lit(0).cast("long").alias("prefix"), F.lit(HASH_BITS).alias("shift"), none.alias("special"), (F.col("rest") > 0).alias("open")), "mix-cut")
    for done in range(BITS, HASH_BITS + BITS, BITS):
        if state.where("open").isEmpty():
            break
        shift = max(0, HASH_BITS - done)
        inside = rows.where("size > 0").join(_beside(state.where("open").select("pattern", "rest", "prefix", "shift")), "pattern").where("shiftright(h, shift) = prefix OR shift = 63")
        bins = inside.groupBy("pattern", F.expr(f"shiftright(h, {shift})").alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"), F.first("rest").alias("rest"))
        bins = bins.withColumn("upto", F.sum("words").over(Window.partitionBy("pattern").orderBy("bin")))  # 2**BITS rows a pattern
        end = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bin", "upto", "words", "n", "low", "high")))
        found = bins.groupBy("pattern").agg(end.alias("e"), F.max("bin").alias("last"), F.sum("words").alias("all"))
        told = state.join(found, "pattern", "left")
        left = F.when(F.col("e").isNull(), F.col("rest") - F.col("all")).otherwise(F.col("rest") - F.col("e.upto") + F.col("e.words"))
        told = told.select("pattern", "wanted", "filled", "aim", "special", "open", F.when(F.col("open") & F.col("last").isNotNull(), left).otherwise(F.col("rest")).alias("rest"), F.when(F.col("open"), F.coalesce("e.bin", F.col("last") + 1, "prefix")).otherwise(F.col("prefix")).alias("prefix"), F.when(F.col("open"), shift).otherwise(F.col("shift")).alias("shift"), "e")
        alike = F.col("open") & (F.col("e.low") == F.col("e.high"))
        fit = F.expr("least(e.n, rest div (e.words div e.n))")
        told = told.withColumns({"special": F.when(alike, F.map_from_entries(F.array(F.struct(F.col("e.low"), fit)))).otherwise(F.col("special")), "rest": F.when(alike, F.col("rest") - fit * F.expr("e.words div e.n")).otherwise(F.col("rest")), "open": F.col("open") & F.col("e").isNotNull() & ~F.coalesce(alike, F.lit(False)) & (F.col("rest") > 0) & (shift > 0)})
        state = stash(told.drop("e"), "mix-cut")
    return state


def _filled(rows: DataFrame, state: DataFrame) -> DataFrame:
    """What the cut leaves open is made good by the one row a round, taken or left out, that comes nearest to it."""
    state = stash(state.withColumn("open", F.abs("rest") > NEAR * F.col("wanted")), "mix-fill")
    for _ in range(FILLS):
        if state.where("open").isEmpty():
            break
        gaps = _beside(state.where("open").select("pattern", "rest", "prefix", "shift", "special"))
        moves = rows.where("size > 0").join(gaps, "pattern").where(~F.map_contains_key("special", F.col("h")))
        before = (F.col("shift") < HASH_BITS) & (F.expr("shiftright(h, shift)") < F.col("prefix"))
        step = F.when(before, -F.col("size")).otherwise(F.col("size"))
        best = moves.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("rest") - step).alias("off"), "h", step.alias("step"))).alias("x"))
        best = stash(best.select("pattern", "x.*"), "mix-best")
        alike = rows.join(_beside(best.select("pattern", F.col("h").alias("_h"))), "pattern").where("h = _h").groupBy("pattern").agg(F.count("*").alias("alike"))
        told = state.join(best, "pattern", "left").join(alike, "pattern", "left").withColumn("moves", F.col("open") & F.coalesce(F.col("off") < F.abs("rest"), F.lit(False)))
        special = F.map_concat("special", F.map_from_entries(F.array(F.struct("h", F.when(F.col("step") > 0, F.lit(1).cast("long")).otherwise(F.col("alike") - 1)))))
        told = told.withColumns({"special": F.when(F.col("moves"), special).otherwise(F.col("special")), "rest": F.when(F.col("moves"), F.col("rest") - F.col("step")).otherwise(F.col("rest"))})
        state = stash(told.withColumn("open", F.col("moves") & (F.abs("rest") > NEAR * F.col("wanted"))).select(state.columns), "mix-fill")
    return state


def _chosen(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Patterns of FEW rows or less that are still off: of all choices of rows, the one nearest to what is wanted."""
    off = state.where((F.abs("rest") > NEAR * F.col("wanted")) & (F.col("filled") <= FEW))
    if off.isEmpty():
        return state

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h")
        taken = [int(h) for h, x in zip(group["h"], subset(group["size"].tolist(), int(group["aim"].iloc[0])), strict=True) if x]
        return pd.DataFrame({"pattern": [group["pattern"].iloc[0]], "chosen": [[(h, taken.count(h)) for h in sorted(set(taken))]]})

    few = rows.where("size > 0").join(_beside(off.select("pattern", "aim")), "pattern").select("pattern", "h", "size", "aim")
    best = few.groupBy("pattern").applyInPandas(choose, "pattern string, chosen array<struct<h:long,n:long>>")
    told = state.join(best, "pattern", "left")
    return told.select("pattern", F.when(F.col("chosen").isNull(), F.col("prefix")).otherwise(0).alias("prefix"), F.when(F.col("chosen").isNull(), F.col("shift")).otherwise(HASH_BITS).alias("shift"), F.when(F.col("chosen").isNull(), F.col("special")).otherwise(F.map_from_entries("chosen")).alias("special"))


def subset(sizes: list[int], aim: int) -> list[bool]:
    """Which of the sizes to add up to come nearest to `aim`, the lesser sum of two equally near ones. A set of sums is a number whose bits are the sums."""
    sums = [1]
    for n in sizes:
        sums.append(sums[-1] | sums[-1] << n)
    below, above = sums[-1] & ((1 << aim + 1) - 1), sums[-1] >> aim + 1
    at = below.bit_length() - 1
    if above and (step := (above & -above).bit_length()) < aim - at:
        at = aim + step
    out = []
    for n, before in zip(reversed(sizes), reversed(sums[:-1]), strict=True):
        out.append(not before >> at & 1)
        at -= n if out[-1] else 0
    return out[::-1]
