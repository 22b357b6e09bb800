"""Corpus collection as set operations: candidates, order, eligibility, duplicates, samples, reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import blank, strip
from claimloom.functions.urls import origin
from claimloom.operators.order import fresh, row_numbers
from claimloom.plans.scratch import materialize


def row_key(prefix: str, *parts: Column) -> Column:
    """Prefix and SHA-256 of the parts as a JSON array."""
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256))


def merge_candidates(rows: DataFrame, key: str, order: list[str], flags: list[str], row_id: str) -> DataFrame:
    """One row per key: its first row by order, flags OR-ed, and how many rows were merged, as `n_rows`.

    Null keys are one key; a null flag counts as false unless all are null; repeated rows (of one
    row_id) count once. If rows have a column n_rows, the new one gets a suffix of `_`.
    """
    whole, n_rows = fresh(rows, "first_row"), fresh(rows, "n_rows")
    first = F.min_by(F.struct(*[c for c in rows.columns if c not in (key, *flags)]), F.struct(*order))
    out = rows.groupBy(key).agg(first.alias(whole), *[F.bool_or(f).alias(f) for f in flags], F.countDistinct(row_id).alias(n_rows))
    return out.select(key, f"{whole}.*", *flags, n_rows)


def merged_duplicates(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows that merge_candidates folds away: those of a key but for the first. No two rows are equal in order; null keys are one key.

    An aggregate and a join, so a key of any size fits.
    """
    k, least = fresh(rows, "first_of"), fresh(rows, "first_at")
    firsts = materialize(rows.groupBy(F.col(key).alias(k)).agg(F.min(F.struct(*order)).alias(least)), "firsts")
    return rows.join(firsts, rows[key].eqNullSafe(firsts[k])).where(F.struct(*order) != F.col(least)).drop(k, least)


def fair_order(rows: DataFrame, interval: str, host: str, tie: str) -> DataFrame:
    """rows with round, turn: hosts of an interval take turns, and intervals take turns. Order by turn, then interval.

    Null hosts are one host, null intervals one interval. If rows have columns of these names, the
    new ones get a suffix of `_`.
    """
    round_, turn = fresh(rows, "round"), fresh(rows, "turn")
    return row_numbers(row_numbers(rows, [interval, host], [tie], round_), [interval], [round_, host], turn)


def interleave(rows: DataFrame, key: str, groups: str, pos: str, names: list[str]) -> DataFrame:
    """rows(key, groups array, pos) with `slot`, `lane`: the first of each group, then the second of each, a row at its first place; rows of no group last (null).

    Order by slot and lane, nulls last, then pos. Keys are unique. If rows have columns of these
    names, the new ones get a suffix of `_`.
    """
    slot_, lane_ = fresh(rows, "slot"), fresh(rows, "lane")
    lane = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("g"))
    picks = row_numbers(rows.select(F.col(key).alias("k"), F.col(pos).alias("p"), F.explode(groups).alias("g")), ["g"], ["p"], "slot").withColumn("lane", lane)
    best = picks.groupBy(F.col("k").alias(key)).agg(F.min(F.struct("slot", "lane")).alias("best_of_row")).select(key, F.col("best_of_row.slot").alias(slot_), F.col("best_of_row.lane").alias(lane_))
    return rows.join(best, key, "left")


def fixed_windows(ts: Column, start: str, days: int, n: int) -> Column:
    """0-based number of the half-open window of `days` days from start (a date) in which ts lies; null outside of all n."""
    k = F.floor(F.datediff(ts.cast("date"), F.lit(start).cast("date")) / days).cast("int")
    return F.when((k >= 0) & (k < n), k)


def eligibility(rules: list[tuple[Column, str]]) -> Column:
    """The reason of the first failing rule; null if none fails. Unknown counts as failing."""
    out = F.lit(None).cast("string")
    for passes, reason in reversed(rules):
        out = F.when(~F.coalesce(passes, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


def exclusion(rules: list[tuple[Column, str, str]]) -> Column:
    """Struct (status, reason) of the first failing rule (passes, status, reason); null if none fails. Unknown counts as failing. A reason may be the text of a column's name in braces: its value in lower case."""
    out = F.lit(None).cast("struct<status: string, reason: string>")
    for passes, status, reason in reversed(rules):
        said = F.lower(F.col(reason[1:-1])) if reason.startswith("{") else F.lit(reason)
        out = F.when(~F.coalesce(passes, F.lit(False)), F.struct(F.lit(status).alias("status"), said.alias("reason"))).otherwise(out)
    return out


#: Why a row is a duplicate.
DUPLICATE_REASONS = {"DUPLICATE_URL": "canonical_url_already_selected", "DUPLICATE_BODY": "normalized_body_already_selected"}


def drop_duplicates_in_order(rows: DataFrame, first_key: str, second_key: str, order: list[str], id_col: str | None = None) -> DataFrame:
    """rows with `status`. In order, a row is DUPLICATE_URL if a selected row before it has its first key, else DUPLICATE_BODY if a selected row before it has its second key, else SELECTED.

    A key counts as seen only through rows that were selected. No two rows are equal in order;
    null keys are equal; an empty table gives an empty result. If rows have a column status, the
    new one gets a suffix of `_`. With id_col, `duplicate_of` is the id of the selected row that a
    duplicate repeats, and `failure_reason` says by which key.
    """
    pos = F.struct(*order, *([F.col(id_col).alias("id_of_row")] if id_col else []))
    keys = rows.select(F.lit(0).alias("run"), pos.alias("pos"), F.col(first_key).alias("url_key"), F.col(second_key).alias("body_key"))
    chosen = materialize(_select_in_order(materialize(keys, "order-keys")), "order-chosen")
    out = rows
    names = [fresh(rows, x) for x in ("by_url", "by_body", "chosen_key")]
    for k, column, name in (("url_key", first_key, names[0]), ("body_key", second_key, names[1])):
        c = chosen.select(F.col(k).alias(names[2]), F.col("pos").alias(name))  # selected rows share no key
        out = out.join(c, out[column].eqNullSafe(c[names[2]]), "left").drop(names[2])
    url, body = F.col(names[0]), F.col(names[1])
    status = F.when(url == pos, "SELECTED").when(url < pos, "DUPLICATE_URL").otherwise("DUPLICATE_BODY")
    if id_col:
        of = F.when(url < pos, url["id_of_row"]).when(url == pos, F.lit(None)).otherwise(body["id_of_row"])
        why = F.when(url < pos, DUPLICATE_REASONS["DUPLICATE_URL"]).when(url == pos, F.lit(None)).otherwise(DUPLICATE_REASONS["DUPLICATE_BODY"])
        out = out.withColumns({fresh(rows, "duplicate_of"): of, fresh(rows, "failure_reason"): why})
    return out.withColumn(fresh(rows, "status"), status).drop(names[0], names[1])


def _same(a: DataFrame, b: DataFrame, columns: dict[str, str]) -> Column:
    """a's columns equal to b's, null to null."""
    return reduce(lambda x, y: x & y, [a[l].eqNullSafe(b[r]) for l, r in columns.items()])


def _without(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """rows that share neither a url key nor a body key with a taken row of their run."""
    for k in ("url_key", "body_key"):
        t = taken.select(F.col("run").alias("_run"), F.col(k).alias("_key")).distinct()
        rows = rows.join(t, _same(rows, t, {"run": "_run", k: "_key"}), "left_anti")
    return rows


def _key_text(rows: DataFrame, column: str) -> Column:
    """A key of any type as text, null apart from every value."""
    value = F.hex(column) if rows.schema[column].dataType.simpleString() == "binary" else F.col(column).cast("string")
    return F.coalesce(F.concat(F.lit("k"), value), F.lit("n"))


def _quota_steps(need: int, ahead: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Decide the first rows of a run for its open slots, as far as all of them are known."""

    def steps(rows: pd.DataFrame) -> pd.DataFrame:
        of_slot = rows.groupby("k")["pos"].agg(["size", "max"])
        horizon = of_slot.loc[of_slot["size"] == ahead, "max"].min()  # beyond it a slot may have rows that aren't here
        counts, urls, bodies, out = list(rows["counts"].iloc[0]), set(), set(), []
        for r in rows.drop_duplicates("pos").sort_values("pos").itertuples(index=False):
            if r.pos > horizon:
                break
            open_ = [(n, k) for k, n in enumerate(counts) if r.has[k] and n < need]
            if open_ and r.url not in urls and r.body not in bodies:
                slot = min(open_)[1]
                counts[slot] += 1
                urls.add(r.url)
                bodies.add(r.body)
                out.append((r.of, r.pos, slot))
        return pd.DataFrame(out, columns=["of", "pos", "slot"])

    return steps


def _quota_picks(rows: DataFrame, slots: list[str], need: int) -> DataFrame:
    """(run, pos, url_key, body_key, slot): what each run selects until no slot needs more.

    A round looks at the first rows of each run and open slot, twice as many as a slot needs, and
    decides them in order up to the first place where a slot might have further rows. So a round
    holds a few rows a run whatever its size, and rounds are about as many as slots; each run
    that can go on does. The helper columns are safe, since only run, pos, url_key, body_key and
    has come in.
    """
    schema = "run {}, pos bigint, url_key {}, body_key {}, slot string".format(*[rows.schema[c].dataType.simpleString() for c in ("run", "url_key", "body_key")])
    picks = rows.sparkSession.createDataFrame([], schema)
    if not slots or need <= 0:
        return picks
    has = F.array(*[F.coalesce(F.array_contains("tags", n), F.lit(False)) for n in slots])
    some = rows.withColumn("has", has).where(F.exists("has", lambda x: x))
    some = materialize(some.groupBy("run", "url_key", "body_key", "has").agg(F.min("pos").alias("pos")), "quota-rows")
    ahead = 2 * need
    while True:
        state = picks.groupBy(F.col("run").alias("_run")).agg(F.max("pos").alias("_last"), F.array(*[F.count_if(F.col("slot") == n) for n in slots]).alias("_counts"))
        left = _without(some, picks)
        left = left.join(state, left["run"].eqNullSafe(state["_run"]), "left").where("_last IS NULL OR pos > _last")
        counts = F.coalesce("_counts", F.array(*[F.lit(0).cast("bigint")] * len(slots)))
        open_ = F.array_compact(F.array(*[F.when(F.col("has")[k] & (counts[k] < need), F.lit(k)) for k in range(len(slots))]))
        each = left.select("run", "pos", "url_key", "body_key", "has", counts.alias("counts"), _key_text(rows, "run").alias("of"), _key_text(rows, "url_key").alias("url"), _key_text(rows, "body_key").alias("body"), F.explode(open_).alias("k"))
        part = F.pmod(F.xxhash64("pos"), F.lit(64))
        near = each.withColumn("part", part).withColumn("n", F.row_number().over(Window.partitionBy("of", "k", "part").orderBy("pos"))).where(F.col("n") <= ahead)
        near = near.withColumn("n", F.row_number().over(Window.partitionBy("of", "k").orderBy("pos"))).where(F.col("n") <= ahead)
        near = materialize(near, "quota-near")
        if near.isEmpty():
            return picks
        decided = near.select("of", "pos", "has", "counts", "url", "body", "k").groupBy("of").applyInPandas(_quota_steps(need, ahead), "of string, pos bigint, slot int")
        name = F.get(F.array(*[F.lit(n) for n in slots]), F.col("slot"))
        more = near.dropDuplicates(["of", "pos"]).join(decided, ["of", "pos"]).select("run", "pos", "url_key", "body_key", name.alias("slot"))
        picks = materialize(picks.unionByName(more), "quota-picks")


def _select_in_order(rows: DataFrame) -> DataFrame:
    """(run, pos, url_key, body_key): the rows that share neither key with an earlier one of these, found in rounds.

    In a round every row that is first of its url key and of its body key, among those left, is
    one, and the rows that share a key with it go. Rounds are few but for chains of rows that
    each share a key with the next.
    """
    left = materialize(rows.groupBy("run", "url_key", "body_key").agg(F.min("pos").alias("pos")).select("run", "pos", "url_key", "body_key"), "order-rows")
    found = []
    while True:
        marked = left
        for k in ("url_key", "body_key"):
            least = materialize(left.groupBy(F.col("run").alias("_run"), F.col(k).alias("_key")).agg(F.min("pos").alias(f"_{k}")), "order-least")
            marked = marked.join(least, _same(marked, least, {"run": "_run", k: "_key"})).drop("_run", "_key")
        marked = materialize(marked.withColumn("_first", (F.col("pos") == F.col("_url_key")) & (F.col("pos") == F.col("_body_key"))).select(*left.columns, "_first"), "order-marked")
        found.append(marked.where("_first").drop("_first"))
        left = materialize(_without(marked.where("NOT _first").drop("_first"), found[-1]), "order-left")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)


def select_with_quota(rows: DataFrame, slots: list[str], need: int, total: int | None = None) -> DataFrame:
    """Exact ordered selection: rows(run, pos, url_key, body_key, tags array) -> (run, pos, status, slot). No two rows of a run are equal in pos.

    While a slot has fewer than `need`, a row must serve the emptiest slot among its tags that
    still needs one; later rows are selected without; `total`, if given, ends it. A row is a duplicate if it
    shares a key with a selected row before it. Null keys are equal. A run of any size is
    decided by aggregates and joins over all runs at once, and a few rows of it at a time in a task.
    """
    rows = materialize(rows.select("run", F.col("pos").cast("bigint").alias("pos"), "url_key", "body_key", "tags"), "quota-input")
    picks = _quota_picks(rows, slots, need)
    steps = need * len(slots) if need > 0 else 0
    if steps:
        full = picks.groupBy(F.col("run").alias("_run")).agg(F.max("pos").alias("_full"), F.count("*").alias("n")).where(F.col("n") == steps).drop("n")
        later = rows.join(full, _same(rows, full, {"run": "_run"})).where("pos > _full").select("run", "pos", "url_key", "body_key")
    else:
        later = rows.select("run", "pos", "url_key", "body_key")
    chosen = _select_in_order(_without(later, picks)).withColumn("slot", F.lit(None).cast("string"))
    chosen = row_numbers(picks.unionByName(chosen), ["run"], ["pos"], "n")
    chosen = materialize(chosen, "quota-chosen")
    out = rows.select("run", "pos", "url_key", "body_key")
    for k, name in (("url_key", "_url"), ("body_key", "_body")):
        c = chosen.select(F.col("run").alias("_run"), F.col(k).alias("_key"), F.col("pos").alias(name), *([F.col("slot").alias("_slot")] if name == "_url" else []))
        out = out.join(c, _same(out, c, {"run": "_run", k: "_key"}), "left").drop("_run", "_key")
    last = chosen.where(F.lit(False) if total is None else F.col("n") == total).select(F.col("run").alias("_run"), F.col("pos").alias("_last"))
    out = out.join(last, _same(out, last, {"run": "_run"}), "left")
    reached = F.col("_last").isNull() | (F.col("pos") <= F.col("_last")) if total is None or total > 0 else F.lit(False)
    status = F.when(~reached, "NOT_REACHED").when(F.col("pos") == F.col("_url"), "SELECTED").when(F.col("_url") < F.col("pos"), "DUPLICATE_URL").when(F.col("_body") < F.col("pos"), "DUPLICATE_BODY").otherwise("ELIGIBLE_NOT_SELECTED")
    return out.select("run", "pos", status.alias("status"), F.when(status == "SELECTED", F.col("_slot")).alias("slot"))


def salted(salt: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt + ":"), key), 256)


def _lowest(rows: DataFrame, column: str, order: list[str], n: int, place: str) -> DataFrame:
    """The n rows of each group that are lowest in order (hash, key), with their place.

    Groups are cut in a number of parts first, and each part to its n lowest, so that no task
    sorts a whole group.
    """
    part = fresh(rows, "part")
    near = rows.withColumn(part, F.pmod(F.xxhash64(order[-1]), F.lit(64))).withColumn(place, F.row_number().over(Window.partitionBy(column, part).orderBy(*order))).where(F.col(place) <= n).drop(part)
    return near.withColumn(place, F.row_number().over(Window.partitionBy(column).orderBy(*order))).where(F.col(place) <= n)


def strata_sample(rows: DataFrame, key: str, strata: list[tuple[str, int | None, list | None]], size: int, salt: str, short: bool = False) -> DataFrame:
    """`size` rows by lowest salted hash, ties by key, with `hash` and `picked`: the stratum a row was taken for, or fill.

    strata: (column, minimum, values) in order. Each group of the column (null is none) is brought
    up to the minimum by its lowest hashes; rows taken earlier count. Minimum null takes the whole
    group. values, if given, are the groups there must be. It is an error if a group has too few
    rows (unless `short`), if the minima need more than `size` rows, or if there are fewer than
    `size` rows (unless `short`). Keys are unique and not null. If rows have columns hash or
    picked, the new ones get a suffix of `_`.
    """
    hash_, picked, place, group, present_n = (fresh(rows, x) for x in ("hash", "picked", "place", "group", "present"))
    order = [hash_, key]
    base = rows.withColumn(hash_, salted(salt, F.col(key).cast("string")))
    chosen = base.where(F.lit(False)).withColumn(picked, F.lit(None).cast("string"))
    n = 0
    for column, minimum, values in strata:
        inside = F.col(column).isNotNull() & (F.col(column).isin(values) if values is not None else F.lit(True))
        left = base.join(chosen.select(key), key, "left_anti").where(inside)
        present = chosen.where(inside).groupBy(F.col(column).alias(group)).agg(F.count("*").alias(present_n))
        if minimum is not None:
            left = _lowest(left, column, order, minimum, place)
            left = left.join(present, F.col(column) == F.col(group), "left").where(F.col(place) <= minimum - F.coalesce(present_n, F.lit(0)))
        # One row more than fits is enough to see that they don't.
        more = materialize(left.select(*base.columns, F.lit(column).alias(picked)).limit(size - n + 1), "stratum")
        n += more.count()
        if n > size:
            raise ValueError(f"the strata up to {column} need more than {size} rows")
        chosen = materialize(chosen.unionByName(more), "strata")
        if minimum is not None and not short:
            found = chosen.where(inside).groupBy(column).agg(F.count("*").alias(present_n))
            groups = base.where(inside).select(column).distinct()
            if values is not None:
                groups = base.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` {rows.schema[column].dataType.simpleString()}")
            lacking = groups.join(found, column, "left").where(F.coalesce(present_n, F.lit(0)) < minimum).select(column).first()
            if lacking:
                raise ValueError(f"stratum {column}={lacking[0]} has fewer than {minimum} rows")
    fill = base.join(chosen.select(key), key, "left_anti").withColumn(picked, F.lit("fill")).orderBy(*order).limit(size - n)
    out = materialize(chosen.unionByName(fill), "sample")
    if not short and (found := out.count()) < size:
        raise ValueError(f"a sample of {size} rows needs as many, found {found}")
    return out.orderBy(*order)


def stratified_sample(rows: DataFrame, key: str, stratum: str, per_stratum: int, size: int, salt: str) -> DataFrame:
    """strata_sample of one column, a null a stratum as well: strata with fewer rows give all they have, and too many strata for `size` are an error."""
    name, picked = fresh(rows, "stratum_of"), fresh(rows, "picked")
    filled = rows.withColumn(name, F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")))
    out = strata_sample(filled, key, [(name, per_stratum, None)], size, salt, short=True)
    return out.withColumn(picked, F.when(F.col(picked) == name, "stratum").otherwise("fill")).drop(name)


def latest_records(log: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last record of each key, with `first_seen`, the ordinal of its first."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("r"), F.min(ordinal).alias("first_seen")).select(key, "r.*", "first_seen")


def fetch_outcome(http_status: Column, error: Column, allowed: Column) -> Column:
    """What a fetch leads to, by the first rule that holds."""
    return (
        F.when(error == "UNSAFE_URL", "FAILED_HTTP")
        .when(~F.coalesce(allowed, F.lit(False)), "BLOCKED_ROBOTS")
        .when(error.isin("TIMEOUT", "CONNECTION") | (http_status >= 500), "RETRY_PENDING")
        .when(error.isNotNull() | (http_status >= 400), "FAILED_HTTP")
        .otherwise("FETCHED")
    )


def robots_policy(robots_status: Column) -> Column:
    """Whether fetching is allowed by the status of an origin's robots file: all if there is none, nothing if it can't be read."""
    return F.when(robots_status == 404, True).when(robots_status.between(200, 299), True).otherwise(F.lit(False))


def crawl_delay(delay: Column, seconds: Column, requests: Column) -> Column:
    return F.greatest(F.lit(1.0), F.coalesce(delay.cast("double"), F.lit(0.0)), F.coalesce(F.try_divide(seconds, requests), F.lit(0.0)))


def with_robots(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """rows(url, ...) with `allowed` and `delay` (seconds between requests) by their origin's policies(origin, robots_status, delay, seconds, requests); an origin without one may not be fetched."""
    names = {x: fresh(rows, x) for x in ("origin", "allowed", "delay")}
    known = policies.dropDuplicates(["origin"]).select(F.col("origin").alias(names["origin"]), robots_policy(F.col("robots_status")).alias(names["allowed"]), crawl_delay(F.col("delay"), F.col("seconds"), F.col("requests")).alias(names["delay"]))
    out = rows.withColumn(names["origin"], origin(F.col("url"))).join(known, names["origin"], "left")
    return out.withColumn(names["allowed"], F.coalesce(names["allowed"], F.lit(False))).withColumn(names["delay"], F.coalesce(names["delay"], F.lit(1.0))).drop(names["origin"])


def enriched(rows: DataFrame, body: str) -> DataFrame:
    """rows with the SHA-256, bytes and characters of a body; nulls for a null body."""
    c = F.col(body)
    return rows.withColumns({"body_sha256": F.sha2(c.cast("binary"), 256), "body_bytes": F.octet_length(c).cast("bigint"), "body_chars": F.length(c).cast("bigint")})


def selected_index(latest: DataFrame, column: str, key: str) -> DataFrame:
    """(value, key): for each value of a column among selected records the least key that has it."""
    return latest.where(F.col("status") == "SELECTED").groupBy(F.col(column).alias("value")).agg(F.min(key).alias("key"))


def report_counts(rows: DataFrame, column: Column, name: str, top: int | None = None) -> DataFrame:
    """(value, n) by falling count, ties by value."""
    out = rows.groupBy(column.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)
    return out.limit(top) if top else out


def invariants(selected: DataFrame, unique: list[str], size: int | None = None, rules: dict[str, Column] | None = None, slot: str | None = None, slots: list[str] = (), per_slot: int = 0) -> DataFrame:
    """(invariant, found): one row per invariant that is violated, none for a good selection.

    unique: columns without repeats. size: the number of rows. rules: what must hold of each row
    (unknown counts as broken); found is the number of rows that break it. slots: names of which
    the column `slot` must have per_slot rows each; found is how many it has.
    """
    violated = lambda bad, name, found: F.when(bad, F.struct(F.lit(name).alias("invariant"), found.cast("bigint").alias("found")))
    checks = [violated(F.countDistinct(c) != F.count("*"), f"unique {c}", F.count("*") - F.countDistinct(c)) for c in unique]
    if size is not None:
        checks.append(violated(F.count("*") != size, "size", F.count("*")))
    for name, holds in (rules or {}).items():
        broken = F.count_if(~F.coalesce(holds, F.lit(False)))
        checks.append(violated(broken > 0, name, broken))
    for s in slots:
        n = F.count_if(F.col(slot) == s)
        checks.append(violated(n < per_slot, f"slot {s}", n))
    return selected.agg(F.array_compact(F.array(*checks)).alias("v")).select(F.explode("v").alias("v")).select("v.*")


def resumed(candidates: DataFrame, log: DataFrame, duplicates: DataFrame, key: str, ordinal: str) -> DataFrame:
    """candidates(key, ...) that a collection still has to work on, with `retries`, the open tries of each.

    log(key, status, ordinal) are the records so far; duplicates(key) are candidates that were
    folded away and count as done. A candidate is done if its last record is no RETRY_PENDING.
    """
    tries = log.groupBy(key).agg(F.max_by("status", ordinal).alias("last_status"), F.count_if(F.col("status") == "RETRY_PENDING").alias("retries"))
    status, retries = fresh(candidates, "last_status"), fresh(candidates, "retries")
    tries = tries.withColumnsRenamed({"last_status": status, "retries": retries})
    left = candidates.join(duplicates.select(key).distinct(), key, "left_anti").join(tries, key, "left")
    return left.where(F.col(status).isNull() | (F.col(status) == "RETRY_PENDING")).withColumn(retries, F.coalesce(retries, F.lit(0))).drop(status)


def utc_instant(raw: Column) -> Column:
    """A time with a zone (Z, an offset or UTC) as UTC text ...Z; null for others."""
    t = strip(raw)
    zoned = t.rlike(r"(?i)(Z|UTC|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.date_format(F.try_to_timestamp(F.regexp_replace(t, r"(?i)\s*UTC$", "Z")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def check_candidates(rows: DataFrame, starts: list[str]) -> DataFrame:
    """rows(url, seen_at, query_interval_start, has_...) with `error`: no address, a time without zone, an unknown interval, or no subject flag."""
    yes = lambda c: F.lower(strip(c)).isin("1", "true", "yes", "y")
    error = (
        F.when(blank(F.col("url")), "missing_url")
        .when(utc_instant(F.col("seen_at")).isNull(), "seen_at_without_zone")
        .when(~F.coalesce(utc_instant(F.col("query_interval_start")).isin(*starts), F.lit(False)), "unknown_interval")
        .when(~F.coalesce(yes(F.col("has_subject")), F.lit(False)), "missing_subject")
    )
    return rows.withColumn("error", error)


def audit_summary(rows: DataFrame, questions: list[str], slot: str | None = None, slot_question: str | None = None) -> DataFrame:
    """One row: rows, completed ones (every question answered), and yes counts per question of completed rows; with a slot column, its rows and their yes counts of slot_question."""
    yes = lambda c: F.lower(F.coalesce(strip(c), F.lit(""))) == "yes"
    done = F.lit(True)
    for q in questions:
        done = done & (F.coalesce(q, F.lit("")) != "")
    out = [F.count("*").alias("n"), F.count_if(done).alias("completed"), *[F.count_if(done & yes(F.col(q))).alias(f"{q}_yes") for q in questions]]
    if slot is not None:
        held = F.coalesce(slot, F.lit("")) != ""
        out += [F.count_if(held).alias("slot_rows"), F.count_if(held & yes(F.col(slot_question))).alias("slot_yes")]
    return rows.agg(*out)


def audit_failures(summary: DataFrame, least: dict[str, int], exact: dict[str, int] | None = None) -> DataFrame:
    """(check, found, wanted): thresholds that an audit_summary misses. least: columns with their least values; exact: those that must be equal."""
    checks = [F.when(F.col(c) < n, F.struct(F.lit(c).alias("check"), F.col(c).alias("found"), F.lit(n).cast("bigint").alias("wanted"))) for c, n in least.items()]
    checks += [F.when(F.col(c) != n, F.struct(F.lit(c).alias("check"), F.col(c).alias("found"), F.lit(n).cast("bigint").alias("wanted"))) for c, n in (exact or {}).items()]
    return summary.select(F.explode(F.array_compact(F.array(*checks))).alias("f")).select("f.*")


def update_audit(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """rows with the columns of decisions(key, ...) set for its keys; a decision that meets no row or more than one is an error."""
    columns = [c for c in decisions.columns if c != key]
    hits = decisions.select(key).join(rows.groupBy(key).count(), key, "left").where(F.coalesce("count", F.lit(0)) != 1).first()
    if hits:
        raise ValueError(f"a decision must be on exactly one row: {hits[0]}")
    mark = fresh(rows, "decided")
    new = decisions.select(key, F.struct(*columns).alias(mark))
    return rows.join(new, key, "left").select(*[F.when(F.col(mark).isNotNull(), F.col(mark)[c]).otherwise(rows[c]).alias(c) if c in columns else rows[c] for c in rows.columns])
