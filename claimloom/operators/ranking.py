"""Ranking, filtering and layout of entities for display."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions.text import blank, strip
from claimloom.operators.order import fresh, row_numbers
from claimloom.plans.scratch import materialize


def ranked_search(nodes: DataFrame, query: str, top: int = 6) -> DataFrame:
    """Nodes by score: 15 for the classification, 10 for the name, 4 for the description; (id, name, score, reason). A blank query finds nothing; null texts count as empty; ties go to the newer id."""
    q = query.strip().lower()
    if not q:
        nodes = nodes.where("false")
    code, name, text = F.lower(F.coalesce("classification", F.lit(""))), F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("description", F.lit("")))
    by_code = code.contains(q) | F.lit(q).contains(code)
    by_name = name.contains(q) | F.lit(q).contains(name)
    by_text = text.contains(q)
    score = F.when(by_code, 15).otherwise(0) + F.when(by_name, 10).otherwise(0) + F.when(by_text, 4).otherwise(0)
    reason = F.when(by_code, "classification").when(by_name, "name").when(by_text, "description")
    return nodes.select("id", "name", score.cast("int").alias("score"), reason.alias("reason")).where("score > 0").orderBy(F.desc("score"), F.desc("id")).limit(top)


def selection_lookup(nodes: DataFrame, text: str, top: int = 4) -> DataFrame:
    """Up to 4 nodes, newest first, for a marked text of 2 to 30 characters, with how they match; other texts find none, null texts of a node don't match."""
    q = text.strip().lower()
    if not 2 <= len(q) <= 30:
        return nodes.where("false").select("id", "name", F.lit(None).cast("string").alias("match"))
    name, code = F.lower("name"), F.lower("classification")
    match = F.when(name.contains(q), "name").when(code.contains(q), "classification").when(F.lower("description").contains(q), "related")
    return nodes.select("id", "name", match.alias("match")).where("match IS NOT NULL").orderBy(F.desc("id")).limit(top)


def type_match(types: list[str], code: Column, kind: Column, name: Column) -> Column:
    """Whether the code or kind is among types, or the name holds one; no types match all."""
    if not types:
        return F.lit(True)
    up = [t.upper() for t in types]
    hit = F.upper(code).isin(up) | F.upper(kind).isin(up)
    for t in up:
        hit = hit | F.upper(name).contains(t)
    return F.coalesce(hit, F.lit(False))


def date_match(created: Column, start: str | None, end: str | None) -> Column:
    """Whether the day lies between both bounds; a missing date passes, and so does everything without both bounds."""
    if not start or not end:
        return F.lit(True)
    day = F.substring(created.cast("string"), 1, 10)
    return day.isNull() | day.between(start, end)


PRESET_DAYS = {"30D": 30, "90D": 90, "1Y": 365}


def preset_bounds(preset: str, today: Column) -> tuple[Column, Column]:
    """First and last day of a preset, from a given today; nulls for all dates."""
    days = PRESET_DAYS.get(preset)
    if days is None:
        return F.lit(None).cast("date"), F.lit(None).cast("date")
    return F.date_sub(today, days), today


def filtered_links(edges: DataFrame, matching: DataFrame) -> DataFrame:
    """Edges with both ends among matching(id), which may repeat; an edge with a null end goes."""
    ids = matching.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def classify_links(edges: DataFrame, members: DataFrame, center: int, conflicting: tuple = (), undirected: tuple = ()) -> DataFrame:
    """edges(id, source, target, relation, ...) among members with `kind`: backbone at the centre, cross between two direct neighbours, else outer; `conflict` and `directed` by relation; and `n_evidence`, the size of claim_ids where edges have them, else 0.

    Columns of these names are replaced. Members are unique; edges with an end that is null or no
    member go; repeated edges stay. Without a relation `conflict` and `directed` are null.
    """
    hop, near, far = members.select("id", "hop"), fresh(edges, "hop_s"), fresh(edges, "hop_t")
    e = edges.join(hop.withColumnsRenamed({"id": "source", "hop": near}), "source").join(hop.withColumnsRenamed({"id": "target", "hop": far}), "target")
    kind = F.when((F.col("source") == center) | (F.col("target") == center), "backbone").when((F.col(near) == 1) & (F.col(far) == 1), "cross").otherwise("outer")
    n = F.coalesce(F.array_size("claim_ids"), F.lit(0)) if "claim_ids" in edges.columns else F.lit(0)
    out = e.withColumns({"kind": kind, "n_evidence": n}).drop(near, far)
    if "relation" in edges.columns:
        out = out.withColumn("conflict", F.col("relation").isin(*conflicting) if conflicting else F.lit(False)).withColumn("directed", ~F.col("relation").isin(*undirected) if undirected else F.lit(True))
    return out


def center_choice(pinned: Column, searched: Column, requested: Column, top: Column) -> Column:
    """The entity to show: the one that the user pinned, else found by search, else asked for in the address, else the one of most relations."""
    return F.coalesce(pinned, searched, requested, top)


def size_class(n_claims: Column) -> Column:
    return F.when(n_claims >= 6, "large").when(n_claims >= 3, "medium").otherwise("small")


def strand_count(n_evidence: Column) -> Column:
    return F.least(F.greatest(n_evidence, F.lit(1)), F.lit(5))


def ring_layout(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, hop, radius, angle) of members, each once: direct neighbours evenly on a ring, the next ones around the parent's angle, all others evenly in the ring's widest gap.

    members(id, hop). The first ring's radius grows with its count between fixed bounds; a node of
    the second ring stands near the least-angle parent of the first. Farther nodes share the
    widest gap between the nodes of the second ring (the whole circle where there is none).
    """
    n = members.where("hop = 1").count()
    radius = float(min(250, max(145, round(n * 56 / (2 * math.pi)))))
    ring = row_numbers(members.where("hop = 1").select("id", "hop"), [], ["id"], "place")
    ring = ring.select("id", "hop", F.lit(radius).alias("radius"), (F.lit(-math.pi / 2) + 2 * math.pi * (F.col("place") - 1) / max(n, 1)).alias("angle"))
    ring = materialize(ring, "ring")
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("parent")), F.struct(F.col("target").alias("id"), F.col("source").alias("parent")))).alias("e")).select("e.*")
    second = members.where("hop = 2").join(ends, "id").join(ring.select(F.col("id").alias("parent"), F.col("angle").alias("a")), "parent")
    second = second.groupBy("id", "hop").agg(F.min(F.struct("a", "parent")).alias("p")).select("id", "hop", F.col("p.a").alias("a"), F.col("p.parent").alias("parent"))
    numbered = row_numbers(second, ["parent"], ["id"], "k")
    siblings = second.groupBy("parent").agg(F.count("*").alias("m"))
    outer = numbered.join(siblings, "parent").select("id", "hop", F.lit(radius + 110.0).alias("radius"), (F.col("a") + (F.col("k") - (F.col("m") + 1) / 2) * 0.18).alias("angle"))
    outer = materialize(outer, "outer")
    far = row_numbers(members.where("hop > 2").select("id", "hop"), [], ["id"], "place")
    n_far = members.where("hop > 2").count()
    gap = largest_gap(outer.select(F.lit(0).alias("g"), F.pmod(F.col("angle"), F.lit(2 * math.pi)).alias("a")).distinct(), "g", "a").first() if n_far else None
    start, width = (gap["start"], gap["gap"]) if gap else (-math.pi / 2, 2 * math.pi)
    rest = far.select("id", "hop", F.lit(radius + 220.0).alias("radius"), (F.lit(start) + width * F.col("place") / (n_far + 1)).alias("angle"))
    center = members.where("hop = 0").select("id", "hop", F.lit(0.0).alias("radius"), F.lit(0.0).alias("angle"))
    return center.unionByName(ring).unionByName(outer).unionByName(rest)


#: Points of a block: two of them meet in one task. Larger blocks are sent fewer times.
BLOCK = 16_384
_STRIP = 128
#: The largest double below a half: added away from zero, it makes trunc round as SQL does.
_HALF = float(np.nextafter(0.5, 0.0))


def _strips(x: np.ndarray, y: np.ndarray, width: float) -> tuple[np.ndarray, ...]:
    """(order, x, y, starts, boxes): points in an order in which every _STRIP of them lie close together, and their (low x, high x, low y, high y)."""
    order = np.lexsort((y, np.floor(x / width)))
    x, y, starts = x[order], y[order], np.arange(0, len(order), _STRIP)
    return order, x, y, starts, np.stack([f.reduceat(c, starts) for c in (x, y) for f in (np.minimum, np.maximum)])


def _push_blocks(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, distance: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of two blocks' points (of one block's, if it is the same), what each point gets along x and along y (integers of 1e-9), and from how many."""
    left = _strips(ax, ay, distance / 4)
    right = left if same else _strips(bx, by, distance / 4)
    a, b = np.zeros((3, len(ax)), np.int64), np.zeros((3, len(bx)), np.int64)
    # Of two boxes the gap between them along x and along y.
    gaps = [np.maximum(np.maximum(right[4][k][None] - left[4][k + 1][:, None], left[4][k][:, None] - right[4][k + 1][None]), 0) for k in (0, 2)]
    met = np.hypot(*gaps) < distance * (1 + 1e-9)
    if same:
        met = np.triu(met)
    spans = [np.maximum(right[4][k + 1][None] - left[4][k][:, None], left[4][k + 1][:, None] - right[4][k][None]) for k in (0, 2)]
    all_near = np.hypot(*spans) < distance * (1 - 1e-9)
    # Differences and sums as products of matrices: products by 1 are exact, and so are sums of integers.
    pairs = [(np.stack([p, np.ones_like(p)], axis=1), np.stack([np.ones_like(q), -q])) for p, q in ((left[1], right[1]), (left[2], right[2]))]
    ones = np.ones(_STRIP)
    room = np.empty((7, _STRIP * _STRIP))  # a strip's pairs stay in the processor's cache
    for i, j in zip(*np.nonzero(met), strict=True):
        at, to = (slice(s[3][k], s[3][k] + _STRIP) for s, k in ((left, i), (right, j)))
        shape = len(left[1][at]), len(right[1][to])
        dx, dy, dist, lack, push, half, more = (r[: shape[0] * shape[1]].reshape(shape) for r in room)
        for d, (p, q) in zip((dx, dy), pairs, strict=True):
            np.matmul(p[at], q[:, to], out=d)
        np.multiply(dx, dx, out=dist)
        np.multiply(dy, dy, out=more)
        np.sqrt(np.add(dist, more, out=dist), out=dist)
        every = all_near[i, j]
        if dist.min() <= 0.001:
            dist[dist <= 0.001], every = distance, False
        np.subtract(distance, dist, out=lack)
        if not every:
            np.maximum(lack, 0, out=lack)  # who lacks nothing pushes by 0
            near = lack > 0
        alone = same and i == j
        for k, d in enumerate((dx, dy)):
            np.multiply(np.multiply(np.multiply(np.divide(d, dist, out=push), lack, out=push), 0.225, out=push), 1e9, out=push)
            low, high, low_, high_ = *left[4][2 * k : 2 * k + 2, i], *right[4][2 * k : 2 * k + 2, j]
            away = _HALF if low >= high_ else -_HALF if high <= low_ else np.copysign(_HALF, push, out=half)
            np.trunc(np.add(push, away, out=push), out=push)
            a[k, at] += (push @ ones[: shape[1]]).astype(np.int64)
            if not alone:
                b[k, to] -= (ones[: shape[0]] @ push).astype(np.int64)
        a[2, at] += shape[1] if every else near.sum(axis=1, dtype=np.uint8)
        if not alone:
            b[2, to] += shape[0] if every else near.sum(axis=0, dtype=np.uint8)
    back = lambda sums, order: sums[:, np.argsort(order)]
    return back(a, left[0]), back(b, right[0])


def relaxed(points: DataFrame, distance: float = 80.0, rounds: int = 16, by: tuple[str, ...] = ()) -> DataFrame:
    """points(id, x, y) with those nearer than distance pushed apart, round by round; the other columns stay.

    In a round all points move at once: each by the mean of the pushes of its too near neighbours,
    and a push is 0.225 of what the pair lacks in distance, along their line. (Pushing pair after
    pair depends on the order of all pairs; for a point with one near neighbour both are the
    same, and means keep crowds from overshooting.) Neighbours are looked for in a point's cell of
    a grid and the eight around it, so no round compares all pairs. Within a crowded cell it does:
    cells are dealt into blocks of about BLOCK points, and each pair of blocks is looked at once,
    for both sides, in tasks that are dealt by pairs of blocks however few bytes these take. With
    `by`, points push within equal values only: many layouts relax in one job. Pushes are summed
    as integers of 1e-9, so reruns agree.

    ids are unique within `by`. Points that (nearly) coincide don't push each other; null or NaN
    places, and rows with a null in `by`, neither push nor move. An empty table stays empty. Stops
    early once nothing moves.
    """
    by_, spark = list(by), points.sparkSession
    tx, ty, n = (fresh(points, name) for name in ("to_x", "to_y", "n_near"))
    kept = [points.schema[c] for c in (*by_, "id")]
    # Names of the helper tables' own columns: by and id by place, since any name may be among them.
    keys = [f"by_{k}" for k in range(len(by_))]
    result = T.StructType([*[T.StructField(k, f.dataType) for k, f in zip([*keys, "id"], kept, strict=True)], *[T.StructField(c, T.LongType()) for c in ("px", "py", "n")]])
    pair = [*keys, "left_x", "left_y", "left_block", "right_x", "right_y", "right_block"]
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cell = lambda c: F.floor(F.col(c) / distance)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))

    def push(rows: pd.DataFrame) -> pd.DataFrame:
        same = all(rows[f"left_{c}"].iat[0] == rows[f"right_{c}"].iat[0] for c in ("x", "y", "block"))
        a, b = rows[rows["is_left"]], rows[~rows["is_left"]]
        sums = _push_blocks(*(side[c].to_numpy() for side in (a, a if same else b) for c in ("x", "y")), distance, same)
        sides = [(a, sums[0] + sums[1])] if same else [(a, sums[0]), (b, sums[1])]
        out = [side[[*keys, "id"]].assign(px=s[0], py=s[1], n=s[2])[s[2] > 0] for side, s in sides]
        return pd.concat(out, ignore_index=True)

    now = materialize(points, "relax")
    for _ in range(rounds):
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by_, "id")])
        placed = now.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").where(known)
        mine = placed.select(*[F.col(c).alias(k) for c, k in zip(by_, keys, strict=True)], "id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
        cells = mine.groupBy(*keys, "cx", "cy").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        cells = materialize(cells, "relax-cells")
        dealt = mine.join(cells, [*keys, "cx", "cy"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")
        met = dealt.select("*", around.alias("d")).withColumns({"ox": F.col("cx") + F.col("d.i"), "oy": F.col("cy") + F.col("d.j")})
        met = met.join(cells.withColumnsRenamed({"cx": "ox", "cy": "oy"}), [*keys, "ox", "oy"])
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        mine_, theirs = F.struct("cx", "cy", F.col("block").alias("b")), F.struct(F.col("ox").alias("cx"), F.col("oy").alias("cy"), F.col("other").alias("b"))
        met = met.withColumns({"is_left": mine_ <= theirs, "l": F.least(mine_, theirs), "r": F.greatest(mine_, theirs)})
        met = met.select(*keys, *[F.col(f"{side[0]}.{c}").alias(f"{side}_{name}") for side in ("left", "right") for c, name in (("cx", "x"), ("cy", "y"), ("b", "block"))], "is_left", "id", "x", "y")
        pushes = met.repartition(tasks, *pair).groupBy(*pair).applyInPandas(push, result)
        mean = lambda c: F.sum(c).cast("double") / 1e9 / F.sum("n")
        moves = pushes.groupBy(*keys, "id").agg(mean("px").alias(tx), mean("py").alias(ty), F.sum("n").alias(n)).withColumnsRenamed(dict(zip(keys, by_, strict=True)))
        shift = lambda c, by: F.col(c) + F.coalesce(by, F.lit(0.0))
        moved = materialize(now.join(moves, [*by_, "id"], "left").withColumns({"x": shift("x", tx), "y": shift("y", ty)}).drop(tx, ty), "relax")
        now = moved.select(*points.columns)
        if moved.where(F.col(n).isNotNull()).isEmpty():
            break
    return now


def relaxed_layout(layout: DataFrame, distance: float = 80.0, rounds: int = 16) -> DataFrame:
    """(id, hop, x, y) of a ring_layout, relaxed; the centre stays where it is and pushes nobody."""
    at = layout.select("id", "hop", (F.col("radius") * F.cos("angle")).alias("x"), (F.col("radius") * F.sin("angle")).alias("y"))
    at = materialize(at, "layout")
    return at.where("hop = 0").unionByName(relaxed(at.where("hop > 0"), distance, rounds))


def largest_gap(angles: DataFrame, group: str, angle: str, full: float = 2 * math.pi, parts: int = 64) -> DataFrame:
    """(group, start, gap): the widest empty arc of each group of angles in [0, full), around the circle; ties by the least start.

    Angles are cut into arcs of equal width; the widest gap within an arc is found there, and those
    between arcs from their first and last angles, so no task orders a whole group. Null angles
    don't count, repeated ones once; a group of one angle has the whole circle. No angles, no rows.
    """
    place, after = fresh(angles, "arc"), fresh(angles, "after")
    arc = F.floor(F.col(angle) * parts / full)
    w = Window.partitionBy(group, place).orderBy(angle)
    rows = angles.where(F.col(angle).isNotNull()).withColumn(place, arc).withColumn(after, F.lead(angle).over(w))
    inner = F.max(F.when(F.col(after).isNotNull(), F.struct((F.col(after) - F.col(angle)).alias("gap"), (-F.col(angle)).alias("m"))))
    arcs = rows.groupBy(group, F.col(place).alias("arc")).agg(F.min(angle).alias("low"), F.max(angle).alias("high"), inner.alias("inner"))
    around = Window.partitionBy(group).orderBy("arc")
    next_low = F.coalesce(F.lead("low").over(around), F.first("low").over(around) + full)
    ends = arcs.withColumn("between", F.struct((next_low - F.col("high")).alias("gap"), (-F.col("high")).alias("m")))
    best = ends.groupBy(group).agg(F.greatest(F.max("between"), F.max("inner")).alias("b"))
    return best.select(group, (-F.col("b.m")).alias("start"), "b.gap")


def shown_properties(properties: Column, reserved: list[str]) -> Column:
    """Entries of a map without reserved, internal (_) or empty ones."""
    return F.map_filter(properties, lambda k, v: ~k.isin(reserved) & ~k.startswith("_") & ~blank(v))


def property_lines(properties: Column, reserved: list[str]) -> Column:
    """shown_properties as sorted lines `key: value`; true and false read yes and no, numbers have no needless zeros."""
    value = lambda v: F.when(F.lower(v) == "true", "yes").when(F.lower(v) == "false", "no").when(v.rlike(r"^-?[0-9]+\.[0-9]*0+$"), F.regexp_replace(F.regexp_replace(v, r"0+$", ""), r"\.$", "")).otherwise(v)
    return F.transform(F.array_sort(F.map_entries(shown_properties(properties, reserved))), lambda e: F.concat(e["key"], F.lit(": "), value(e["value"])))


def edge_sentence(source: Column, target: Column, relation: Column, directed: Column, n: Column) -> Column:
    return F.concat(source, F.when(directed, " ➔ ").otherwise(" ↔ "), target, F.lit(" · "), relation, F.lit(" · "), n.cast("string"), F.lit(" evidence"))


def sections(text: Column) -> Column:
    """Parts of an insight: `[title] body` parts, else its paragraphs."""
    tagged = F.regexp_extract_all(text, F.lit(r"(\[[^\]]+\][^\[]*)"), 1)
    paras = F.filter(F.split(text, r"\n\s*\n"), lambda p: ~blank(p))
    return F.transform(F.when(F.size(tagged) > 0, tagged).otherwise(paras), lambda p: F.struct(F.nullif(F.regexp_extract(p, r"^\[([^\]]+)\]", 1), F.lit("")).alias("title"), strip(F.regexp_replace(p, r"^\[[^\]]+\]", "")).alias("body")))


def section_kind(title: Column, body: Column, kinds: dict[str, list[str]], default: str = "general") -> Column:
    """The first kind of which a keyword occurs in the title, else in the body, in any case; the default for neither."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(default)
    for part in (low(body), low(title)):  # what is written last is tested first
        for kind, words in reversed(kinds.items()):
            hit = F.lit(False)
            for w in words:
                hit = hit | part.contains(w.lower())
            out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def task_listing(tasks: DataFrame, limit: int | None = None) -> DataFrame:
    """tasks(id, title, status, created_at, nodes array, edges array) newest first, ties by id, with node_count and edge_count instead of the lists; a null list has 0."""
    n = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    out = tasks.select("id", "title", "status", "created_at", n("nodes").alias("node_count"), n("edges").alias("edge_count")).orderBy(F.desc("created_at"), "id")
    return out if limit is None else out.limit(limit)


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "completed", "failed")])
