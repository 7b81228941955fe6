"""Episode sessions, abort rules, the lease queue and tick sampling over stored events: the batch twins of the streaming operators, by windows keyed by session or task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.joins import as_of
from framewright.operators.windows import EPISODE, in_order

TOLERANCE = 1e-12
LEASE_SECONDS, REVIEW_AFTER = 300, 2


def episode_sessions(markers: DataFrame, key: str = "source") -> DataFrame:
    """key, episode, task, start_t, end_t (null while it records) of start and end markers (key, t, kind, task). A start without a task, or while an episode records, is refused, and so is an end
    while none does; episodes are numbered by their starts. Markers of equal time: ends first."""
    known = markers.where((F.col("kind") == "end") | ((F.col("kind") == "start") & (F.trim(F.coalesce("task", F.lit(""))) != "")))
    w = Window.partitionBy(key).orderBy("t", "kind", "task")
    before, after = F.lag("kind").over(w), F.lead(F.struct("kind", "t")).over(w.orderBy("t", "kind", "task"))
    started = F.when((F.col("kind") == "start") & (F.coalesce(before, F.lit("end")) == "end"), 1).otherwise(0)
    numbered = known.withColumns({"_started": started, "_before": before}).withColumn("episode", F.sum("_started").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    rows = numbered.where((F.col("_started") == 1) | ((F.col("kind") == "end") & (F.col("_before") == "start")))
    return rows.groupBy(key, "episode").agg(F.min_by("task", F.when(F.col("kind") == "start", F.col("t"))).alias("task"), F.min(F.when(F.col("kind") == "start", F.col("t"))).alias("start_t"), F.min(F.when(F.col("kind") == "end", F.col("t"))).alias("end_t"))


def _stale(age: Column, limit: float) -> Column:
    return age.isNull() | (age > limit + TOLERANCE)


def abort_rules(ticks: DataFrame, limits=(0.10, 0.50, 0.10), counts=(20, 20, 10), window: int = 30, most: float = 1 / 28) -> DataFrame:
    """ticks (episode_index, frame_index, status_age, action_age, image_age) up to each episode's abort, with ``verdict``: ok, stale <input>, or abort <why>.

    An input is looked at only if those before it are fresh. A null age is missing, so stale; fresh ticks in between don't reset a count. With all fresh, the mean of the last ``window`` image ages
    of such ticks may not exceed ``most``. The first abort ends the episode; later ticks go.
    """
    names = ("status", "action", "image")
    first = F.lit(None).cast("string")
    for name, limit in reversed(list(zip(names, limits))):
        first = F.when(_stale(F.col(f"{name}_age"), limit), name).otherwise(first)
    rows = ticks.withColumn("_stale", first)
    so_far = in_order().rowsBetween(Window.unboundedPreceding, 0)
    fresh = Window.partitionBy(*EPISODE, F.col("_stale").isNull()).orderBy("frame_index").rowsBetween(1 - window, 0)
    why = F.lit(None).cast("string")
    for name, most_stale in zip(names, counts):
        why = F.when((F.col("_stale") == name) & (F.sum((F.col("_stale") == name).cast("int")).over(so_far) >= most_stale), f"abort {name}").otherwise(why)
    slow = F.col("_stale").isNull() & (F.count("image_age").over(fresh) == window) & (F.avg("image_age").over(fresh) > most)
    rows = rows.withColumn("_abort", F.when(slow, "abort average").otherwise(why))
    rows = rows.withColumn("_end", F.min(F.when(F.col("_abort").isNotNull(), F.col("frame_index"))).over(Window.partitionBy(*EPISODE)))
    verdict = F.coalesce("_abort", F.concat(F.lit("stale "), F.col("_stale")), F.lit("ok"))
    return rows.where("_end IS NULL OR frame_index <= _end").withColumn("verdict", verdict).drop("_stale", "_abort", "_end")


def lease_fold(events: DataFrame, key: str = "task_id", lease: float = LEASE_SECONDS, review_after: int = REVIEW_AFTER) -> DataFrame:
    """key, status, owner, until, skips, refused (events that changed nothing) after claim, heartbeat, submit and skip events (key, t in seconds, id, kind, device), taken in order of t and id.

    A claim takes a pending task or one whose lease has ended; all else needs the lease's owner. A skip frees the task, the ``review_after``-th sends it to review. The fold is an expression over a task's own events.
    """
    log = F.array_sort(F.collect_list(F.struct("t", "id", "kind", "device")))
    state = "struct<status:string,owner:string,until:double,skips:int,refused:int>"

    def made(s, status=None, owner=None, until=None, skips=None, refused=None):
        return F.struct(status if status is not None else s["status"], owner if owner is not None else s["owner"], until if until is not None else s["until"], skips if skips is not None else s["skips"], refused if refused is not None else s["refused"]).cast(state)

    def step(s: Column, e: Column) -> Column:
        none_owner, none_until = F.lit(None).cast("string"), F.lit(None).cast("double")
        free = (s["status"] == "pending") | ((s["status"] == "locked") & (s["until"].isNull() | (s["until"] < e["t"])))
        owns = F.coalesce(s["owner"] == e["device"], F.lit(False)) & (s["status"] == "locked")
        skips = s["skips"] + 1
        return (
            F.when((e["kind"] == "claim") & free, made(s, F.lit("locked"), e["device"], e["t"] + lease))
            .when((e["kind"] == "heartbeat") & owns, made(s, until=e["t"] + lease))
            .when((e["kind"] == "submit") & owns, made(s, F.lit("completed"), none_owner, none_until))
            .when((e["kind"] == "skip") & owns, made(s, F.when(skips >= review_after, "review").otherwise("pending"), none_owner, none_until, skips))
            .otherwise(made(s, refused=s["refused"] + 1))
        )

    start = F.struct(F.lit("pending"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(0), F.lit(0)).cast(state)
    return events.groupBy(key).agg(log.alias("_log")).select(key, F.aggregate("_log", start, step).alias("s")).select(key, "s.*")


def tick_samples(samples: DataFrame, sessions: DataFrame, keys: list[str], period: float, value: str, max_age: float) -> DataFrame:
    """keys, t, value of each tick of a session (keys, start_t, end_t), every ``period`` from its start on, with the latest sample not older than ``max_age``; ticks without one are dropped."""
    steps = F.floor((F.col("end_t") - F.col("start_t")) / period)
    ticks = sessions.select(*keys, "start_t", F.explode(F.sequence(F.lit(0).cast("long"), steps)).alias("_k")).select(*keys, (F.col("start_t") + F.col("_k") * period).alias("t"))
    return as_of(ticks, samples, keys, "t", value, max_age).where(F.col(value).isNotNull()).select(*keys, "t", value)


def response_times(requests: DataFrame, key: str, order: list[str], infer: str, total: str) -> DataFrame:
    """Each request's own time and the total time of the one before it on the same connection (null for the first)."""
    return requests.withColumn("previous_total", F.lag(total).over(Window.partitionBy(key).orderBy(*order))).select(key, *order, infer, "previous_total")


def button_edges(samples: DataFrame, key: str, order: list[str], buttons: str, width: int) -> DataFrame:
    """key, order, button, pressed of every one of ``width`` bits that changed; the first sample compares with all released."""
    before = F.coalesce(F.lag(buttons).over(Window.partitionBy(key).orderBy(*order)), F.lit(0).cast("long"))
    rows = samples.select(key, *order, F.col(buttons).cast("long").alias("_now"), before.cast("long").alias("_was"))
    bits = rows.withColumn("button", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    was, now = (F.expr(f"shiftright({c}, button) & 1") for c in ("_was", "_now"))
    return bits.where(was != now).select(key, *order, "button", (now == 1).alias("pressed"))


def dual_holds(samples: DataFrame, key: str, hold: float, timeout: float) -> DataFrame:
    """key, t at which left and right had both been held for ``hold`` seconds. samples: key, t, id, source, left, right, taken in order of t and id.

    Firing disarms until both are released; releasing one restarts the time. A gap longer than ``timeout``, another source or an invalid (null) input clears the state, which arms it. The fold is an expression over a key's own samples.
    """
    log = F.array_sort(F.collect_list(F.struct("t", "id", "source", "left", "right")))
    state = "struct<armed:boolean,since:double,last:double,source:string,fired:array<double>>"

    def step(s: Column, e: Column) -> Column:
        invalid = e["left"].isNull() | e["right"].isNull()
        cleared = s["last"].isNotNull() & ((e["t"] - s["last"] > timeout + TOLERANCE) | ~s["source"].eqNullSafe(e["source"]))
        armed, since = F.when(cleared, True).otherwise(s["armed"]), F.when(~cleared, s["since"])
        start = F.coalesce(since, e["t"])
        fires = armed & (e["t"] - start >= hold - TOLERANCE)
        none = F.lit(None).cast("double")

        def made(armed_, since_, fired):
            return F.struct(armed_, since_, e["t"], e["source"], fired).cast(state)

        return (
            F.when(invalid, F.struct(F.lit(True), none, none, F.lit(None).cast("string"), s["fired"]).cast(state))
            .when(~e["left"] & ~e["right"], made(F.lit(True), none, s["fired"]))
            .when(~(e["left"] & e["right"]), made(armed, none, s["fired"]))
            .when(fires, made(F.lit(False), start, F.concat(s["fired"], F.array(e["t"]))))
            .otherwise(made(armed, start, s["fired"]))
        )

    start = F.struct(F.lit(True), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("string"), F.array().cast("array<double>")).cast(state)
    return samples.groupBy(key).agg(log.alias("_log")).select(key, F.explode(F.aggregate("_log", start, step)["fired"]).alias("t"))


def input_verdicts(rows: DataFrame, key: str, limits: dict[str, float]) -> DataFrame:
    """key, t, id, verdict of each tick: ok, or the missing inputs, else the stale ones, by name. rows: key, t, id, kind (an input or 'tick'); at equal times inputs come first."""
    w = Window.partitionBy(key).orderBy("t", (F.col("kind") == "tick").cast("int"), "id").rowsBetween(Window.unboundedPreceding, 0)
    names = sorted(limits)
    seen = rows.withColumns({f"_{n}": F.last(F.when(F.col("kind") == n, F.col("t")), ignorenulls=True).over(w) for n in names}).where("kind = 'tick'")
    missing = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNull(), n) for n in names]))
    stale = F.array_compact(F.array(*[F.when(F.col("t") - F.col(f"_{n}") > limits[n] + TOLERANCE, n) for n in names]))
    verdict = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ","))).when(F.size(stale) > 0, F.concat(F.lit("stale "), F.array_join(stale, ","))).otherwise("ok")
    return seen.select(key, "t", "id", verdict.alias("verdict"))


def input_timeouts(samples: DataFrame, key: str, timeout: float) -> DataFrame:
    """key, t at which ``timeout`` had passed since a valid input (left and right known) without another one at or before that time. samples: key, t, left, right."""
    after = F.lead("t").over(Window.partitionBy(key).orderBy("t"))
    silent = samples.withColumn("_next", after).where(F.col("left").isNotNull() & F.col("right").isNotNull() & (F.col("_next").isNull() | (F.col("_next") - F.col("t") > timeout)))
    return silent.select(key, (F.col("t") + timeout).alias("t")).distinct()
