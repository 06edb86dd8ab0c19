"""Ordered greedy grouping, component by component.

Rows arrive in the order of ``ord``. A row joins every group with which it shares a key and does not conflict; several
groups joined by one row become one, the earliest; a row without such a group opens one. A group's traits are those of
its row of highest authority, so later decisions depend on earlier ones.

Rows of different components of shared keys never meet. A component of up to ``SERIAL_ROWS`` rows is taken row by row in
one task, many components side by side. A larger one is split where no chain of compatible rows links its parts; what is
still larger is settled in turns of a parallel round, which settles all rows that no earlier row can influence, and a
step that takes the next ``SERIAL_ROWS`` rows of the order one by one, with the groups that they may join. So a hot key
whose rows agree takes a few turns however many rows it has, and any other at most one turn per ``SERIAL_ROWS`` rows.

In each round every row that is left is compared with the groups as they stand. The outcome is final for a row that no
earlier row of its cluster could influence; a row could influence a later one when it opens a group that the later one
might join, brings a group to a key that the later one holds, changes the traits of a group so that the later one's
answer changes, or unites groups. All rows before the first influenced row of their cluster are settled together, and
so are rows that are first on all their keys and on all groups these keys lead to.

Compatibility becomes equality: a row offers one token for each way in which its fields may be met and asks for those
that it meets, so "an earlier compatible row" is a minimum per key and token, and no pairs of rows are made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.operators.components import key_components, shared_pairs
from listwright.operators.ordered import rank_within
from listwright.session import cut, discard, shuffled

C = F.col
#: Rows that one task takes one by one: of small components together, or of one step through a large one.
SERIAL_ROWS = 20_000
#: Fields that must be equal where both rows have them.
EXACT = ("office", "division", "start")
#: Everything that a group takes over from its row of highest authority.
TRAITS = ("rank", "sid", *EXACT, "loc", "multi", "london")
#: Fields that decide conflicts between rows of different sources.
CLASS = (*EXACT, "loc", "multi")


def _crossed(options: Sequence[Column]) -> Column:
    """One hash per choice of an option from every list."""
    joined = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat_ws("|", x, y))))
    return F.transform(reduce(joined, options), lambda x: F.xxhash64(x))


def _tokens(t: Column, held: Column, absent: Column, multi: Column, place: Column) -> Column:
    fields = [
        F.when(t[name].isNull(), absent).otherwise(F.array(F.concat(F.lit("="), t[name]), held)) for name in EXACT
    ]
    where = F.when(t["london"], F.lit("london")).otherwise(F.concat(F.lit("@"), t["loc"]))
    fields.append(F.when(t["multi"], multi).otherwise(F.array(where, place)))
    return F.array_append(_crossed(fields), F.xxhash64(F.lit("sid"), t["sid"]))


def offers(t: Column) -> Column:
    """Tokens by which a row or group with traits ``t`` can be met."""
    some, none = F.lit("*"), F.lit("-")
    return _tokens(t, some, F.array(none, some), F.array(F.lit("m"), some), some)


def asks(t: Column) -> Column:
    """Tokens that a row with traits ``t`` meets: it shares one with the offers of all that it does not conflict with."""
    some, none = F.lit("*"), F.lit("-")
    return _tokens(t, none, F.array(some), F.array(some), F.lit("m"))


def _class_conflict(a: Column, b: Column) -> Column:
    differs = [F.coalesce(a[name] != b[name], F.lit(False)) for name in EXACT]
    apart = (a["loc"] != b["loc"]) & ~a["multi"] & ~b["multi"] & ~(a["london"] & b["london"])
    return reduce(lambda x, y: x | y, differs) | apart


def _same_class(a: Column, b: Column) -> Column:
    return reduce(lambda x, y: x & y, [a[name].eqNullSafe(b[name]) for name in CLASS])


def _with_division(t: Column, division: Column) -> Column:
    return t.withField("division", division)


def clusters(placed: DataFrame) -> DataFrame:
    """``(ord, cluster)`` of rows with their ``component``: rows of different clusters never meet in a group.

    Rows of one component of shared keys belong together when a chain of rows that do not conflict links them.
    """
    give = placed.select("ord", "component", F.explode("gives").alias("token"), F.lit(True).alias("given"))
    take = placed.select("ord", "component", F.explode("asks").alias("token"), F.lit(False).alias("given"))
    both = cut(give.unionByName(take).select("ord", F.struct("component", "token").alias("key"), "given"), "tokens")
    met = both.groupBy("key").agg(F.bool_or("given").alias("x"), F.bool_or(~C("given")).alias("y"), F.min("ord").alias("rep"))
    linked = both.join(met.filter("x and y"), "key").select(C("ord").alias("node"), "rep").distinct()
    found = key_components(linked)
    discard(both)
    # Every row offers and asks for its own source's token, so each is in one star at least.
    alone = placed.select("ord").join(found.select(C("node").alias("ord")), "ord", "left_anti").select("ord", C("ord").alias("cluster"))
    return found.select(C("node").alias("ord"), C("component").alias("cluster")).unionByName(alone)


def _hits(rows: DataFrame, groups: DataFrame, group_keys: DataFrame) -> DataFrame:
    """``(ord, root)`` of rows and the groups they would join, with the traits of both."""
    wanted = rows.select("ord", F.explode("keys").alias("key"), "asks").select("ord", "key", F.explode("asks").alias("token"))
    offered = groups.join(group_keys, "root").select("root", "key", F.explode(offers(C("g"))).alias("token"))
    met = wanted.join(offered, ["key", "token"]).select("ord", "root").distinct()
    full = met.join(rows.drop("gives", "asks"), "ord").join(groups, "root")
    sound = (C("t.sid") == C("g.sid")) | ~_class_conflict(C("t"), C("g"))
    return full.filter(sound).select(
        "ord", "root", "cluster", "keys", "t", "g", "lo", "hi",
        F.count(F.lit(1)).over(Window.partitionBy("ord")).alias("n"),
    )


def _influenced(rows: DataFrame, hits: DataFrame, group_keys: DataFrame) -> DataFrame:
    """``(ord)`` of rows whose outcome an earlier row of this round may change."""
    r, g = C("t"), C("g")
    up, fill = r["rank"] > g["rank"], g["division"].isNull() & r["division"].isNotNull()
    single = hits.withColumns({"up": up, "fill": fill, "soft": up & _same_class(r, g)}).filter("n = 1 and (up or fill)")
    after = F.when(C("up"), _with_division(r, F.coalesce(r["division"], g["division"]))).otherwise(_with_division(g, r["division"]))
    wanted = rows.select("ord", F.explode("keys").alias("key"), "asks").select("ord", "key", F.explode("asks").alias("token"))

    # Keys to which a group may come in this round, those it has included.
    reach = hits.select("root", F.explode("keys").alias("key"), "ord", "g")
    coming = reach.groupBy("root", "key").agg(F.min("ord").alias("at"), F.first("g").alias("g")).join(group_keys, ["root", "key"], "left_anti")
    may_hold = group_keys.unionByName(coming.select("root", "key"))

    opened = rows.join(hits, "ord", "left_anti")
    opened = opened.select(C("ord").alias("at"), F.explode("keys").alias("key"), C("gives").alias("tokens"))
    changed = single.select("root", C("ord").alias("at"), offers(after).alias("tokens"), "soft")
    hard = changed.filter("not soft").join(may_hold, "root").select("at", "key", "tokens")
    signals = opened.unionByName(hard.select("at", "key", "tokens")).select("at", "key", F.explode("tokens").alias("token"))
    signals = signals.groupBy("key", "token").agg(F.min("at").alias("at"))
    found = wanted.join(signals, ["key", "token"]).filter("ord > at").select("ord")

    # A group that comes to a key, or takes another source's identity, matters to rows that do not join it already.
    fresh = coming.select("root", "key", "at", F.explode(offers(C("g"))).alias("token"))
    named = single.filter("soft").select("root", C("ord").alias("at"), F.xxhash64(F.lit("sid"), r["sid"]).alias("token"))
    fresh = fresh.unionByName(named.join(may_hold, "root").select("root", "key", "at", "token"))
    fresh = fresh.groupBy("root", "key", "token").agg(F.min("at").alias("at"))
    late = wanted.join(fresh, ["key", "token"]).filter("ord > at").select("ord", "root").join(hits.select("ord", "root"), ["ord", "root"], "left_anti")
    found = found.unionByName(late.select("ord"))

    # Rows that join a group after its traits have changed; equal traits of a higher authority change only the identity.
    first = single.groupBy("root").agg(F.min(F.when(~C("soft"), C("ord"))).alias("hard"), F.min("ord").alias("any"))
    by_name = _class_conflict(r, g)
    held = hits.join(first, "root").filter((C("ord") > C("hard")) | (by_name & (C("ord") > C("any"))))
    found = found.unionByName(held.select("ord"))

    # Groups that a row unites.
    united = hits.filter("n > 1").select("root", C("ord").alias("at")).join(may_hold, "root").groupBy("key").agg(F.min("at").alias("at"))
    walled = rows.select("ord", F.explode("keys").alias("key")).join(united, "key").filter("ord > at")
    return found.unionByName(walled.select("ord")).distinct()


def _first_everywhere(rows: DataFrame, group_keys: DataFrame) -> DataFrame:
    """``(ord)`` of rows that come first on all their keys and on all keys of the groups there."""
    pairs = rows.select("ord", F.explode("keys").alias("key"))
    first = pairs.groupBy("key").agg(F.min("ord").alias("first"))
    of_group = group_keys.join(first, "key").groupBy("root").agg(F.min("first").alias("first"))
    around = group_keys.join(of_group, "root").groupBy("key").agg(F.min("first").alias("around"))
    seen = pairs.join(first, "key").join(around, "key", "left")
    own = (C("first") == C("ord")) & (F.coalesce("around", "ord") >= C("ord"))
    return seen.groupBy("ord").agg(F.bool_and(own).alias("own")).filter("own").select("ord")


def _joined(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that join one group: their places ``(ord, root, seq)`` and the groups after them.

    A row of higher authority than all before it goes to the front, any other to the end.
    """
    r, g = C("t"), C("g")
    raised = hits.filter(r["rank"] > g["rank"]).groupBy("root", r["rank"].alias("rank")).agg(F.min("ord").alias("first"))
    # One entry per authority rank.
    raised = raised.groupBy("root").agg(F.collect_list(F.struct("rank", "first")).alias("raised"))
    first = hits.groupBy("root").agg(F.min("ord").alias("start"))
    rows = hits.join(first, "root").join(raised, "root", "left")
    leads = (r["rank"] > g["rank"]) & F.forall("raised", lambda x: (x["rank"] < r["rank"]) | (x["first"] >= C("ord")))
    rows = rows.withColumn("leads", F.coalesce(leads, F.lit(False)))
    seq = F.when(C("leads"), C("lo") - (r["rank"] - g["rank"])).otherwise(C("hi") + 1 + C("ord") - C("start"))
    rows = cut(rows.withColumn("seq", seq), "joined")
    has = r["division"].isNotNull()
    groups = rows.groupBy("root").agg(
        F.first("g").alias("g"), F.max_by("t", F.when(C("leads"), C("ord"))).alias("led"),
        F.max_by(r["division"], F.when(C("leads") & has, C("ord"))).alias("d1"),
        F.min_by(r["division"], F.when(~C("leads") & has, C("ord"))).alias("d2"),
        F.least(F.first("lo"), F.min("seq")).alias("lo"), F.greatest(F.first("hi"), F.max("seq")).alias("hi"),
    )
    traits = _with_division(F.coalesce("led", "g"), F.coalesce("d1", C("g.division"), "d2"))
    return rows.select("ord", "root", "seq"), groups.select("root", traits.alias("g"), "lo", "hi")


def _united(hits: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that unite groups: their places, the groups after them, and ``moves (child, parent, shift)``.

    The earliest group takes the row, then the other groups, the latest first; each goes to the front if its authority
    is higher than that of all before it.
    """
    base = hits.groupBy("ord").agg(F.min("root").alias("base"), F.first("t").alias("g"))
    parts = hits.select("ord", "root").join(groups, "root").join(base.select("ord", "base"), "ord")
    parts = parts.select("ord", "base", "root", "g", "lo", "hi", F.when(C("root") == C("base"), 0).otherwise(2).alias("kind"))
    own = base.select("ord", "base", F.lit(None).cast("long").alias("root"), "g", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(1).alias("kind"))
    turn = Window.partitionBy("ord").orderBy("kind", F.desc("root"))
    lined = parts.unionByName(own).withColumns(
        {"turn": F.row_number().over(turn) - 1, "before": F.max(C("g.rank")).over(turn.rowsBetween(Window.unboundedPreceding, -1))}
    )
    lined = lined.withColumn("pos", F.when(C("g.rank") > C("before"), -C("turn")).otherwise(C("turn")))
    size = C("hi") - C("lo") + 1
    end = Window.partitionBy("ord")
    home = F.max(F.when(C("turn") == 0, C("lo"))).over(end), F.max(F.when(C("turn") == 0, C("hi"))).over(end)
    right = F.sum(F.when(C("pos") > 0, size).otherwise(0)).over(end.orderBy("pos")) - size
    left = F.sum(F.when(C("pos") < 0, size).otherwise(0)).over(end.orderBy(F.desc("pos"))) - size
    shift = F.when(C("pos") == 0, 0).when(C("pos") > 0, home[1] + 1 + right - C("lo")).otherwise(home[0] - 1 - left - C("hi"))
    lined = cut(lined.withColumn("shift", shift), "united")
    after = lined.groupBy("base").agg(
        F.min_by("g", "pos").alias("lead"), F.min_by(C("g.division"), F.when(C("g.division").isNotNull(), C("pos"))).alias("division"),
        F.min(C("lo") + C("shift")).alias("lo"), F.max(C("hi") + C("shift")).alias("hi"),
    )
    after = after.select(C("base").alias("root"), _with_division(C("lead"), C("division")).alias("g"), "lo", "hi")
    places = lined.filter("kind = 1").select("ord", C("base").alias("root"), C("shift").alias("seq"))
    moves = lined.filter("kind = 2").select(C("root").alias("child"), C("base").alias("parent"), "shift")
    return places, after, moves


def settled_moves(moves: DataFrame) -> DataFrame:
    """``(child, head, offset)``: follow every union to its last group by doubling the steps."""
    at = moves.select("child", C("parent").alias("head"), C("shift").alias("offset"))
    while True:
        onward = at.select(C("child").alias("head"), C("head").alias("next"), C("offset").alias("more"))
        joined = cut(at.join(onward, "head", "left"), "heads")
        at = joined.select(
            "child", F.coalesce("next", "head").alias("head"), (C("offset") + F.coalesce("more", F.lit(0))).alias("offset")
        )
        if joined.filter(C("next").isNotNull()).isEmpty():
            return at


# --- row by row -----------------------------------------------------------------------------


def _pattern(t: tuple) -> tuple:
    """Fields that decide conflicts; None meets anything."""
    _, _, office, division, start, loc, multi, london = t
    return start, None if multi else "london" if london else f"@{loc}", division, office


def _met(level: dict, pattern: tuple, depth: int = 0) -> Iterator[int]:
    if depth == len(pattern):
        yield from level
        return
    value = pattern[depth]
    for name in list(level) if value is None else (None, value):
        if name in level:
            yield from _met(level[name], pattern, depth + 1)


def _serial(pdf: pd.DataFrame) -> tuple[list, dict, dict]:
    """Rows in order, behind the groups given: places, groups that went into others, and the groups left."""
    traits: dict[int, tuple] = {}
    ends: dict[int, tuple[int, int]] = {}
    held: dict[int, set] = {}
    index: dict[str, dict] = {}
    named: dict[tuple, set] = {}
    heads: dict[int, tuple[int, int]] = {}
    places = []

    def enter(root: int, keys) -> None:
        for key in keys:
            level = index.setdefault(key, {})
            for value in _pattern(traits[root]):
                level = level.setdefault(value, {})
            level[root] = None
            named.setdefault((key, traits[root][1]), set()).add(root)

    def leave(root: int, keys) -> None:
        for key in keys:
            level = index[key]
            for value in _pattern(traits[root]):
                level = level[value]
            del level[root]
            named[key, traits[root][1]].discard(root)

    def take(root: int, t: tuple, lo: int, hi: int, keys: set) -> int:
        """Put a row or group into ``root``, in front if its authority is higher; how far its places move."""
        mine, (first, last) = traits[root], ends[root]
        front = t[0] > mine[0]
        lead, other = (t, mine) if front else (mine, t)
        after = (*lead[:3], other[3] if lead[3] is None else lead[3], *lead[4:])
        if after != mine:
            leave(root, held[root])
            traits[root] = after
            enter(root, held[root])
        enter(root, keys - held[root])
        held[root] |= keys
        ends[root] = (first - (hi - lo + 1), last) if front else (first, last + hi - lo + 1)
        return first - 1 - hi if front else last + 1 - lo

    columns = ["side", "id", "lo", "hi", "keys", *TRAITS]
    for side, at, lo, hi, keys, *t in pdf.sort_values(["side", "id"])[columns].itertuples(index=False, name=None):
        keys = set(keys)
        t = tuple(None if x is None or x != x else x for x in t)
        hits = set()
        if side == "row":
            for key in keys:
                hits.update(_met(index.get(key, {}), _pattern(t)), named.get((key, t[1]), ()))
        if not hits:
            traits[at], ends[at], held[at] = t, (lo, hi), keys
            enter(at, keys)
            if side == "row":
                places.append((at, at, 0))
            continue
        base, *more = sorted(hits)
        places.append((at, base, take(base, t, 0, 0, keys)))
        for root in reversed(more):
            gone = traits[root], *ends[root], held.pop(root)
            leave(root, gone[-1])
            del traits[root]
            heads[root] = base, take(base, *gone)

    def settled(root: int, seq: int) -> tuple[int, int]:
        trail = []
        while root in heads:
            trail.append(root)
            root = heads[root][0]
        shift = 0
        for step in reversed(trail):
            shift += heads[step][1]
            heads[step] = root, shift
        return root, seq + shift

    places = [(at, *settled(root, seq)) for at, root, seq in places]
    moves = {root: settled(root, 0) for root in list(heads)}
    return places, moves, {root: (*ends[root], *t) for root, t in traits.items()}


PLACED = "ord long, root long, seq long"


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(_serial(pdf)[0], columns=["ord", "root", "seq"], dtype="int64")


def _settle_step(pdf: pd.DataFrame) -> pd.DataFrame:
    """Places, moves of the groups given and the groups after the step, told apart by ``kind``."""
    given = set(pdf.loc[pdf["side"] == "group", "id"].tolist())
    places, moves, groups = _serial(pdf)
    none = (None,) * len(TRAITS)
    out = [("place", *row, None, None, *none) for row in places]
    out += [("move", root, *to, None, None, *none) for root, to in moves.items() if root in given]
    out += [("group", None, root, None, *rest) for root, rest in groups.items()]
    made = pd.DataFrame(out, columns=["kind", "ord", "root", "seq", "lo", "hi", *TRAITS])
    return made.astype({n: "Int64" for n in ("ord", "root", "seq", "lo", "hi", "rank")})


def _as_input(rows: DataFrame, side: str, number: str, traits: str, lo: Column, hi: Column, *more: str) -> DataFrame:
    return rows.select(
        *more, F.lit(side).alias("side"), C(number).alias("id"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"),
        "keys", *[C(f"{traits}.{n}").alias(n) for n in TRAITS],
    )


def _in_batches(rows: DataFrame, part: str) -> DataFrame:
    """``(ord, root, seq)`` of rows whose ``part`` has at most ``SERIAL_ROWS`` of them, many parts in one task."""
    batches = max(1, rows.count() // SERIAL_ROWS * 2, rows.sparkSession.sparkContext.defaultParallelism)
    given = _as_input(rows, "row", "ord", "t", F.lit(0), F.lit(0), part)
    return given.groupBy(F.pmod(F.xxhash64(part), F.lit(batches)).alias("b")).applyInPandas(_settle, PLACED)


def _by_size(rows: DataFrame, part: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the parts that one task may take, and the others if there are any."""
    large = cut(rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).filter(C("n") > SERIAL_ROWS).select(part), "large")
    if large.isEmpty():
        return rows, None
    # A large part has more than SERIAL_ROWS rows, so there are few of them.
    return rows.join(large, part, "left_anti"), rows.join(large, part, "left_semi")


def greedy_groups(rows: DataFrame) -> DataFrame:
    """``(ord, root, seq)`` of ``rows (ord, keys, t)``: the opening row of each one's group, and its place in it.

    The row with the least ``seq`` gives the group its fields, and lists are joined in the order of ``seq``.
    """
    pairs = rows.select(C("ord").alias("node"), F.explode("keys").alias("key"))
    shared = cut(shared_pairs(pairs), "shared")
    parts = key_components(shared).withColumnRenamed("node", "ord")
    lasting = shared.groupBy(C("node").alias("ord")).agg(F.collect_list("key").alias("keys"))
    rows = rows.select("ord", "t").join(shuffled(lasting), "ord").join(shuffled(parts), "ord")
    rows = cut(rows.select("ord", "keys", "t", "component"), "rows")
    small, large = _by_size(rows, "component")
    places = _in_batches(small, "component")
    if large is None:
        return places
    large = cut(large.withColumns({"gives": offers(C("t")), "asks": asks(C("t"))}), "tokens")
    large = cut(large.drop("component").join(shuffled(clusters(large)), "ord"), "clusters")
    small, large = _by_size(large, "cluster")
    places = places.unionByName(_in_batches(small, "cluster"))
    return places if large is None else places.unionByName(_in_turns(large))


def _round(rows: DataFrame, groups: DataFrame, group_keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Settle all rows that no earlier row can influence: their places, moves, and the groups and their keys."""
    hits = cut(_hits(rows, groups, group_keys), "hits")
    first = rows.join(_influenced(rows, hits, group_keys), "ord", "left_semi").groupBy("cluster").agg(F.min("ord").alias("stop"))
    early = rows.join(first, "cluster", "left").filter("stop is null or ord < stop").select("ord")
    done = cut(early.unionByName(_first_everywhere(rows, group_keys)).distinct(), "done")
    now = hits.join(done, "ord", "left_semi")
    opened = rows.join(done, "ord", "left_semi").join(hits, "ord", "left_anti")

    one_places, one_groups = _joined(now.filter("n = 1"))
    fresh = opened.select(C("ord").alias("root"), C("t").alias("g"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    groups = groups.join(one_groups, "root", "left_anti").unionByName(one_groups).unionByName(fresh)
    group_keys = group_keys.unionByName(opened.select(C("ord").alias("root"), F.explode("keys").alias("key")))
    group_keys = group_keys.unionByName(now.groupBy("ord").agg(F.min("root").alias("root"), F.first("keys").alias("keys")).select("root", F.explode("keys").alias("key")))
    place = one_places.unionByName(opened.select("ord", C("ord").alias("root"), F.lit(0).cast("long").alias("seq")))
    many_places, many_groups, moves = _united(now.filter("n > 1"), groups)
    moves = cut(moves, "moves")
    parent = moves.select(C("child").alias("root"), "parent")
    gone = many_groups.select("root").unionByName(parent.select("root"))
    groups = groups.join(gone, "root", "left_anti").unionByName(many_groups)
    group_keys = group_keys.join(parent, "root", "left").select(F.coalesce("parent", "root").alias("root"), "key")
    return cut(place.unionByName(many_places), "places"), moves, groups, group_keys


def _step(rows: DataFrame, groups: DataFrame, group_keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """As ``_round`` for the next rows of every cluster, one by one.

    A group changes only when a row joins it, so those that no row can join as they stand are not needed.
    """
    keyed = rows.select("cluster", F.explode("keys").alias("key"), "asks")
    offered = groups.join(group_keys, "root").select("root", "key", F.explode(offers(C("g"))).alias("token"))
    wanted = keyed.select("cluster", "key", F.explode("asks").alias("token")).distinct()
    near = cut(wanted.join(offered, ["key", "token"]).select("cluster", "root").distinct(), "near")
    held = group_keys.distinct().join(keyed.select("key").distinct(), "key", "left_semi").groupBy("root").agg(F.collect_list("key").alias("keys"))
    old = near.join(groups, "root").join(held, "root")
    given = _as_input(rows, "row", "ord", "t", F.lit(0), F.lit(0), "cluster").unionByName(
        _as_input(old, "group", "root", "g", C("lo"), C("hi"), "cluster")
    )
    fields = groups.schema["g"].dataType
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    out = given.groupBy("cluster").applyInPandas(_settle_step, f"kind string, {PLACED}, lo long, hi long, {columns}")
    out = cut(out, "step")
    place = out.filter("kind = 'place'").select("ord", "root", "seq")
    moves = out.filter("kind = 'move'").select(C("ord").alias("child"), C("root").alias("parent"), C("seq").alias("shift"))
    after = out.filter("kind = 'group'").select("root", F.struct(*TRAITS).cast(fields).alias("g"), "lo", "hi")
    gone = near.select("root").unionByName(after.select("root")).distinct()
    groups = groups.join(gone, "root", "left_anti").unionByName(after)
    parent = moves.select(C("child").alias("root"), "parent")
    group_keys = group_keys.join(parent, "root", "left").select(F.coalesce("parent", "root").alias("root"), "key")
    brought = rows.select("ord", "keys").join(shuffled(place), "ord").select("root", F.explode("keys").alias("key"))
    return place, moves, groups, group_keys.unionByName(brought)


def _in_turns(rows: DataFrame) -> DataFrame:
    """``(ord, root, seq)`` of clusters that are too large for one task: parallel rounds and serial steps by turns."""
    spark, traits = rows.sparkSession, rows.schema["t"].dataType.simpleString()
    turns = rank_within(rows.select("ord", "cluster"), ["cluster"], ["ord"], C("ord"))
    turns = turns.select("ord", F.floor((C("rank") - 1) / SERIAL_ROWS).alias("turn"))
    rows = cut(rows.join(shuffled(turns), "ord"), "rows")
    groups = spark.createDataFrame([], f"root long, g {traits}, lo long, hi long")
    group_keys = spark.createDataFrame([], "root long, key string")
    places, moves = [], []
    while (turn := rows.agg(F.min("turn")).first()[0]) is not None:
        for settle, some in ((_round, rows), (_step, None)):
            some = rows.filter(C("turn") == turn) if some is None else some
            place, moved, groups, group_keys = settle(some, groups, group_keys)
            places.append(place)
            moves.append(moved)
            rows = cut(rows.join(shuffled(place.select("ord")), "ord", "left_anti"), "rows")
            # Only keys that rows still hold lead to groups that matter.
            live = rows.select(F.explode("keys").alias("key")).distinct()
            group_keys = cut(group_keys.distinct().join(shuffled(live), "key", "left_semi"), "group_keys")
            groups = cut(groups.join(shuffled(group_keys), "root", "left_semi"), "groups")
    placed, moves = reduce(DataFrame.unionByName, places), cut(reduce(DataFrame.unionByName, moves), "moves")
    if moves.isEmpty():
        return placed
    heads = settled_moves(moves)
    return placed.join(shuffled(heads), placed["root"] == heads["child"], "left").select(
        "ord", F.coalesce("head", "root").alias("root"), (C("seq") + F.coalesce("offset", F.lit(0))).alias("seq")
    )
