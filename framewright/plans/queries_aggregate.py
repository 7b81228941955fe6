"""Statistics, summaries and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import labels, statistics, store, windows
from framewright.plans.registry import query
from framewright.plans.views import FRAMES, episodes, frames, state, table
from framewright.sources import filesystem as fs

DIMS = "d AS (SELECT episode_index, 0 AS dim, s0 AS x FROM f UNION ALL SELECT episode_index, 1, s1 FROM f)"


def _rounded(df, *columns, digits=7):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {FRAMES}, {DIMS} SELECT dim, round(avg(x), 7) AS mean, round(stddev_pop(x), 7) AS std, count(x) AS n FROM d GROUP BY dim")
def agg01_running_norm(spark, sf):
    return _rounded(statistics.running_norm(state(frames(spark, sf)), "state"), "mean", "std")


@query(f"""WITH {FRAMES}, {DIMS}, b AS (SELECT dim, min(x) AS low, max(x) AS high, count(x) AS n FROM d GROUP BY dim),
p AS (SELECT dim, low, high, n, least(floor((x - low) / ((high - low) / 500)), 499) AS bin, count(*) AS c FROM d JOIN b USING (dim) GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY dim ORDER BY bin) AS sofar FROM p)
SELECT dim, round(min(CASE WHEN sofar >= 0.01 * n THEN low + bin * ((high - low) / 500) END), 7) AS q01, round(min(CASE WHEN sofar >= 0.99 * n THEN low + bin * ((high - low) / 500) END), 7) AS q99 FROM r GROUP BY dim""")
def agg02_histogram_quantiles(spark, sf):
    return _rounded(statistics.histogram_quantiles(state(frames(spark, sf)), "state", 500), "q01", "q99")


@query(f"""WITH {FRAMES}, {DIMS} SELECT dim, min(x) AS min, max(x) AS max, round(avg(x), 7) AS mean, round(stddev_pop(x), 7) AS std, count(x) AS count,
round(quantile_cont(x, 0.01), 7) AS q01, round(quantile_cont(x, 0.1), 7) AS q10, round(quantile_cont(x, 0.5), 7) AS q50, round(quantile_cont(x, 0.9), 7) AS q90, round(quantile_cont(x, 0.99), 7) AS q99 FROM d GROUP BY dim""")
def agg03_feature_statistics(spark, sf):
    return _rounded(statistics.feature_statistics(state(frames(spark, sf)), "state"), "mean", "std", "q01", "q10", "q50", "q90", "q99")


@query(f"WITH {FRAMES}, {DIMS} SELECT dim, min(x) AS min, max(x) AS max, round(avg(x), 7) AS mean, round(stddev_pop(x), 7) AS std, count(x) AS count FROM d GROUP BY dim")
def agg04_numeric_statistics(spark, sf):
    return _rounded(statistics.feature_statistics(state(frames(spark, sf)), "state", quantiles=False), "mean", "std")


@query(f"WITH {FRAMES}, {DIMS} SELECT episode_index, dim, min(x) AS min, max(x) AS max, round(avg(x), 7) AS mean, round(stddev_pop(x), 7) AS std, count(x) AS count FROM d GROUP BY GROUPING SETS ((episode_index, dim), (dim))")
def agg05_episode_and_global_stats(spark, sf):
    return _rounded(statistics.episode_and_global_statistics(state(frames(spark, sf)), "state"), "mean", "std")


@query(f"""WITH {FRAMES}, w AS (SELECT a.episode_index, k, b.s0 / 10 - a.s0 AS x FROM f a, range(0, 7) r(k), f b, ep
WHERE ep.episode_index = a.episode_index AND b.episode_index = a.episode_index AND b.frame_index = least(a.frame_index + k, ep.length - 1))
SELECT round(avg(x), 7) AS mean, round(stddev_pop(x), 7) AS std, count(x) AS n FROM w""")
def agg06_windowed_delta_norm(spark, sf):
    df = state(frames(spark, sf)).withColumn("window", windows.forward_window(F.col("action")[0], 7))
    deltas = df.select(F.transform("window", lambda a: a - F.col("s0")).alias("v")).select(F.explode("v").alias("x"))
    return _rounded(deltas.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("n")), "mean", "std")


SCORE = "s AS (SELECT *, sum(CASE WHEN raw_state = 2 THEN 0 ELSE raw_state END) OVER (PARTITION BY episode_index ORDER BY frame_index) AS score FROM f)"
PROGRESS = f"""{SCORE}, m AS (SELECT *, min(score) OVER (PARTITION BY episode_index) AS low, max(score) OVER (PARTITION BY episode_index) AS high FROM s),
p AS (SELECT *, CASE WHEN raw_state = 2 THEN 1.0 WHEN high - low <= 1e-8 THEN 0.0 ELSE (score - low)::DOUBLE / (high - low) * 0.99 END AS progress FROM m),
dl AS (SELECT *, coalesce(lead(progress, 5) OVER (PARTITION BY episode_index ORDER BY frame_index), last_value(progress) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) - progress AS delta FROM p),
st AS (SELECT greatest(avg(delta), 0) AS mean, greatest(stddev_pop(delta), 1e-6) AS std FROM dl)"""


def deltas(spark, sf):
    return labels.progress_deltas(labels.progress(frames(spark, sf)), 5)


@query(f"WITH {FRAMES}, {PROGRESS} SELECT round(mean, 6) AS mean, round(std, 6) AS std FROM st")
def agg07_delta_statistics(spark, sf):
    return _rounded(labels.delta_statistics(deltas(spark, sf)), "mean", "std", digits=6)


@query(f"WITH {FRAMES} SELECT episode_index, min(frame_index) AS start, max(frame_index) + 1 AS end_ FROM f GROUP BY episode_index")
def agg08_episode_bounds(spark, sf):
    return frames(spark, sf).groupBy("episode_index").agg(F.min("frame_index").alias("start"), (F.max("frame_index") + 1).alias("end_"))


@query("SELECT s.status, count(o.o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) LEFT JOIN orders o ON o.o_orderstatus = s.status GROUP BY s.status")
def agg09_status_counts(spark, sf):
    return store.status_counts(table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"), ["F", "O", "P", "X"])


@query(f"WITH {FRAMES} SELECT raw_state, count(*) AS n, count(DISTINCT episode_index) AS episodes FROM f GROUP BY raw_state")
def agg10_label_counter(spark, sf):
    return frames(spark, sf).groupBy("raw_state").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("episode_index").alias("episodes"))


@query(f"WITH {FRAMES} SELECT count(*) AS total, count_if(raw_state <> 0)::BIGINT AS valid, count_if(raw_state = 0)::BIGINT AS filtered FROM f")
def agg11_valid_summary(spark, sf):
    return frames(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("raw_state") != 0).alias("valid"), F.count_if(F.col("raw_state") == 0).alias("filtered"))


MEDIAN = "dt AS (SELECT episode_index, t - lag(t) OVER (PARTITION BY episode_index ORDER BY frame_index) AS dt FROM f), md AS (SELECT episode_index, median(CASE WHEN dt > 0 THEN dt END) AS median_dt FROM dt GROUP BY episode_index)"


def median_dt(df):
    steps = df.withColumn("dt", windows.first_difference("t"))
    return steps.groupBy("episode_index").agg(F.median(F.when(F.col("dt") > 0, F.col("dt"))).alias("median_dt"))


@query(f"WITH {FRAMES}, {MEDIAN} SELECT episode_index, round(t_last - t_first + median_dt, 3) AS duration, round(median_dt, 3) AS median_dt FROM ep JOIN md USING (episode_index)")
def agg12_duration_median_dt(spark, sf):
    df = frames(spark, sf)
    return episodes(df).join(median_dt(df), "episode_index").select("episode_index", F.round(F.col("t_last") - F.col("t_first") + F.col("median_dt"), 3).alias("duration"), F.round("median_dt", 3).alias("median_dt"))


ISLANDS = "i AS (SELECT episode_index, frame_index, frame_index - row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) AS g FROM f WHERE {}), r AS (SELECT episode_index, min(frame_index) AS start_frame, max(frame_index) + 1 AS end_frame, count(*) AS n_frames FROM i GROUP BY episode_index, g)"


@query(f"WITH {FRAMES}, {ISLANDS.format('raw_state = 0')} SELECT ep.episode_index, coalesce(max(n_frames), 0) AS longest_run FROM ep LEFT JOIN r ON r.episode_index = ep.episode_index GROUP BY ep.episode_index")
def agg13_longest_run(spark, sf):
    return windows.longest_run(frames(spark, sf), F.col("raw_state") == 0)


LAGS = """c AS (SELECT a.episode_index, lag, count(*) AS n, stddev_pop(a.s0) AS sx, stddev_pop(b.s1) AS sy, covar_pop(a.s0, b.s1) AS cv FROM f a, range(-2, 3) r(lag), f b
WHERE b.episode_index = a.episode_index AND b.frame_index = a.frame_index + lag GROUP BY ALL), k AS (SELECT episode_index, lag, CASE WHEN n >= 3 AND sx >= 1e-6 AND sy >= 1e-6 THEN cv / (sx * sy) END AS corr FROM c)"""


def correlations(spark, sf):
    return statistics.lagged_correlations(frames(spark, sf), "s0", "s1", range(-2, 3), ["frame_index"], 1e-6, ["episode_index"])


@query(f"WITH {FRAMES}, {LAGS} SELECT episode_index, lag, round(corr, 6) AS corr FROM k")
def agg14_lagged_correlation(spark, sf):
    return _rounded(correlations(spark, sf), "corr", digits=6)


@query(f"WITH {FRAMES}, {LAGS} SELECT episode_index, lag, round(corr, 6) AS corr FROM k QUALIFY row_number() OVER (PARTITION BY episode_index ORDER BY abs(corr) DESC NULLS LAST, lag) = 1 AND corr IS NOT NULL")
def agg15_best_lag(spark, sf):
    return _rounded(statistics.best_lag(correlations(spark, sf), ["episode_index"]), "corr", digits=6)


@query(f"WITH {FRAMES}, {LAGS}, g AS (SELECT avg(abs(corr)) FILTER (WHERE lag = 0) AS direct, avg(abs(corr)) FILTER (WHERE lag <> 0) AS crossed FROM k) SELECT round(direct, 6) AS direct, round(crossed, 6) AS crossed, direct >= 0.1 AND direct >= crossed + 0.05 AS passed FROM g")
def agg16_correlation_gate(spark, sf):
    c = F.abs("corr")
    g = correlations(spark, sf).agg(F.avg(F.when(F.col("lag") == 0, c)).alias("direct"), F.avg(F.when(F.col("lag") != 0, c)).alias("crossed"))
    return g.select(F.round("direct", 6).alias("direct"), F.round("crossed", 6).alias("crossed"), ((F.col("direct") >= 0.1) & (F.col("direct") >= F.col("crossed") + 0.05)).alias("passed"))


@query(f"WITH {FRAMES} SELECT count(*) AS total_episodes, sum(length)::BIGINT AS total_frames, ((count(*) - 1) // 100 + 1)::BIGINT AS total_chunks, count(*) * 3 AS total_videos FROM ep")
def agg17_totals(spark, sf):
    return store.totals(episodes(frames(spark, sf)), 100, 3)


@query(f"WITH {FRAMES} SELECT sum(ceil(length / 20))::BIGINT AS chunk_equivalents FROM ep")
def agg18_chunk_equivalents(spark, sf):
    return episodes(frames(spark, sf)).agg(F.sum(F.ceil(F.col("length") / 20)).cast("long").alias("chunk_equivalents"))


@query("SELECT l_orderkey, max(l_shipdate) AS completed FROM lineitem GROUP BY l_orderkey")
def agg19_completion_time(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("completed"))


@query("SELECT round(avg(value), 7) AS mean, round(stddev_pop(value), 7) AS std, " + ", ".join(f"round(quantile_cont(value, {q / 100}), 7) AS p{q}" for q in (25, 50, 75, 90, 95, 99)) + " FROM events")
def agg20_latency_distribution(spark, sf):
    rows, wanted = table(spark, sf, "events").select(F.lit(0).alias("dim"), F.col("value").alias("x")), (25, 50, 75, 90, 95, 99)
    found = statistics.exact_quantiles(rows, [p / 100 for p in wanted], [f"p{p}" for p in wanted])
    means = rows.groupBy("dim").agg(F.round(F.avg("x"), 7).alias("mean"), F.round(F.stddev_pop("x"), 7).alias("std"))
    return means.join(F.broadcast(found), "dim").select("mean", "std", *[F.round(f"p{p}", 7).alias(f"p{p}") for p in wanted])


@query("SELECT event_type AS task, count(*) AS episodes, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM events GROUP BY ROLLUP (event_type)")
def agg21_success_rate(spark, sf):
    won = F.when(F.col("value") > 50, 1.0).otherwise(0.0)
    return table(spark, sf, "events").withColumnRenamed("event_type", "task").rollup("task").agg(F.count(F.lit(1)).alias("episodes"), F.round(F.avg(won), 6).alias("success_rate"))


@query(f"WITH {FRAMES} SELECT episode_index, count(DISTINCT task) AS tasks, count(DISTINCT task) = 1 AS one_task FROM f GROUP BY episode_index")
def agg22_distinct_sets(spark, sf):
    return frames(spark, sf).groupBy("episode_index").agg(F.countDistinct("task").alias("tasks")).withColumn("one_task", F.col("tasks") == 1)


@query("SELECT d.doc_id % 10 AS part, bool_and(l.toxic IS NOT NULL) AS all_labelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY part")
def agg23_all_labelled(spark, sf):
    docs, marks = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "toxic")
    return docs.join(marks, "doc_id", "left").groupBy((F.col("doc_id") % 10).alias("part")).agg(F.bool_and(F.col("toxic").isNotNull()).alias("all_labelled"))


@query("SELECT (SELECT count(*) FROM customer) AS batches, (SELECT count(*) FROM orders) AS episodes, (SELECT count(*) FROM lineitem) AS files")
def agg24_ledger_counts(spark, sf):
    one = [table(spark, sf, t).agg(F.count(F.lit(1)).alias(n)) for t, n in (("customer", "batches"), ("orders", "episodes"), ("lineitem", "files"))]
    return one[0].join(F.broadcast(one[1])).join(F.broadcast(one[2]))


@query(r"SELECT max(CAST(nullif(regexp_extract(c_name, '^Customer#([0-9]+)$', 1), '') AS BIGINT)) + 1 AS next_sequence FROM customer")
def agg25_next_sequence(spark, sf):
    return store.next_sequence(table(spark, sf, "customer"), "c_name", "^Customer#([0-9]+)$")


@query(f"WITH {FRAMES} SELECT episode_index, count_if(raw_state = 2)::BIGINT AS done_frames FROM f GROUP BY episode_index")
def agg26_done_frames(spark, sf):
    return frames(spark, sf).groupBy("episode_index").agg(F.count_if(F.col("raw_state") == 2).alias("done_frames"))


@query(f"WITH {FRAMES} SELECT episode_index, frame_index // 10 AS log, round(avg(s0), 7) AS mean_s0 FROM f GROUP BY ALL")
def agg27_interval_means(spark, sf):
    return frames(spark, sf).groupBy("episode_index", F.floor(F.col("frame_index") / 10).alias("log")).agg(F.round(F.avg("s0"), 7).alias("mean_s0"))


@query("SELECT source, count(*) AS selected FROM documents GROUP BY source")
def agg28_source_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("selected"))


@query("SELECT round(sum(l_extendedprice * l_discount) / (sum(l_discount) + 1e-8), 7) AS weighted_mean FROM lineitem")
def agg29_weighted_mean(spark, sf):
    return _rounded(statistics.weighted_mean(table(spark, sf, "lineitem"), "l_extendedprice", "l_discount"), "weighted_mean")


WEIGHTS = "wt AS (SELECT episode_index, frame_index, CASE WHEN delta IS NULL THEN 0.0 WHEN delta > 0.3 THEN 1.0 WHEN delta <= 0 THEN 0.0 ELSE least(greatest((delta - (mean - 2 * std)) / (4 * std), 0), 1) END AS weight FROM dl, st)"


def weights(spark, sf):
    """Progress and deltas are computed once and stored, three narrow columns, since statistics and weights both need them."""
    d = fs.stored(deltas(spark, sf).select("episode_index", "frame_index", "delta"), "deltas")
    return labels.sample_weights(d, labels.delta_statistics(d), 0.3)


@query(f"WITH {FRAMES}, {PROGRESS}, {WEIGHTS} SELECT round(avg(weight), 5) AS mean_weight, round(avg(CASE WHEN weight <= 0 THEN 1.0 ELSE 0.0 END), 6) AS share_zero, count_if(weight > 0)::BIGINT AS positive FROM wt")
def agg30_weight_summary(spark, sf):
    w = F.col("weight")
    return weights(spark, sf).agg(F.round(F.avg(w), 5).alias("mean_weight"), F.round(F.avg(F.when(w <= 0, 1.0).otherwise(0.0)), 6).alias("share_zero"), F.count_if(w > 0).alias("positive"))


@query("SELECT label, round(avg(CASE WHEN list_position(embedding, list_max(embedding)) - 1 = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM embeddings GROUP BY label")
def agg31_accuracy(spark, sf):
    hit = F.array_position("embedding", F.array_max("embedding")) - 1 == F.col("label")
    return table(spark, sf, "embeddings").groupBy("label").agg(F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query("SELECT round(avg(m), 6) AS mean_of_means FROM (SELECT avg(value) AS m FROM events GROUP BY user_id % 8)")
def agg33_worker_means(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id") % 8).agg(F.avg("value").alias("m")).agg(F.round(F.avg("m"), 6).alias("mean_of_means"))
