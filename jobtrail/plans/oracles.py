"""SQL for the named queries, written independently of the Spark operators.

Overlaps are counted by brute force, queues are replayed row by row with a
recursive query and orders use plain global windows.
"""

from __future__ import annotations

# Shared building blocks: name -> (blocks it reads, SQL).
BLOCKS: dict[str, tuple[list[str], str]] = {
    "trace": ([], """
        SELECT event_id AS job_id, epoch_us(ts) AS submit_time,
               CAST(round(value * 60000) AS BIGINT) * 1000 AS runtime_us,
               CAST(round(value * 60000) AS BIGINT) * 1000 / 1e6 AS duration,
               k / 25.0::DOUBLE AS num_gpu, CAST(1 + k % 16 AS BIGINT) AS num_cpu,
               CAST(1 + k % 4 AS BIGINT) AS num_inst, 'u' || user_id AS "user", event_type AS gpu_type,
               user_id % 50 AS queue_id,
               CAST(round(value * 48000) AS BIGINT) * 1000 + (k - 50) * 1000000::BIGINT AS pred_us
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""),
    "sparse": (["trace"], """
        SELECT job_id, submit_time, duration, CASE WHEN num_gpu <> 0 THEN num_gpu END AS num_gpu, num_cpu, num_inst,
               CASE WHEN "user" <> 'u3' THEN "user" END AS "user",
               CASE WHEN gpu_type <> 'error' THEN gpu_type END AS gpu_type, queue_id, pred_us
        FROM trace"""),
    "jobs": (["trace"], """
        SELECT job_id, submit_time AS arrival_us, runtime_us, duration AS job_runtime,
               (submit_time - min(submit_time) OVER ()) / 1e6 AS arrival_sec,
               CAST(trunc(num_gpu) AS BIGINT) AS gpu_demand, num_gpu, num_cpu, num_inst, "user", gpu_type,
               queue_id, pred_us,
               CAST(hour(make_timestamp(submit_time)) AS BIGINT) AS hour_of_day,
               CAST(isodow(make_timestamp(submit_time)) - 1 AS BIGINT) AS day_of_week
        FROM trace WHERE duration > 0 AND num_gpu > 0"""),
    "numbered": (["jobs"], """
        SELECT *, row_number() OVER (ORDER BY arrival_us, job_id) AS rn, count(*) OVER () AS n,
               CASE WHEN row_number() OVER (ORDER BY arrival_us, job_id)
                         > count(*) OVER () - CAST(ceil(0.2::DOUBLE * count(*) OVER ()) AS BIGINT)
                    THEN 'test' ELSE 'train' END AS split
        FROM jobs"""),
    "loaded": (["jobs"], """
        SELECT a.job_id,
               CAST(sum(b.num_cpu) - any_value(a.num_cpu) AS BIGINT) AS cluster_load_cpu,
               CAST(sum(b.gpu_demand) - any_value(a.gpu_demand) AS BIGINT) AS cluster_load_gpu,
               CAST(count(*) - 1 AS BIGINT) AS active_job_count
        FROM jobs a JOIN jobs b
          ON b.arrival_us <= a.arrival_us AND b.arrival_us + b.runtime_us > a.arrival_us
        GROUP BY a.job_id"""),
    "engineered": (["numbered", "loaded"], "SELECT * FROM numbered JOIN loaded USING (job_id)"),
    "hashed": (["jobs"], """
        SELECT *, row_number() OVER (ORDER BY h, job_id) - 1 AS pos, count(*) OVER () AS n
        FROM (SELECT *, ('0x' || substr(md5(job_id || '|42'), 1, 10))::BIGINT AS h FROM jobs)"""),
    "deltas": (["jobs"], """
        SELECT t, CAST(sum(c) AS BIGINT) AS d_cpu, CAST(sum(g) AS BIGINT) AS d_gpu,
               CAST(sum(k) AS BIGINT) AS change_count
        FROM (SELECT arrival_us AS t, num_cpu AS c, gpu_demand AS g, 1 AS k FROM jobs
              UNION ALL SELECT arrival_us + runtime_us, -num_cpu, -gpu_demand, -1 FROM jobs)
        GROUP BY t"""),
    "state": (["deltas"], """
        SELECT t, CAST(sum(d_cpu) OVER w AS BIGINT) AS load_cpu, CAST(sum(d_gpu) OVER w AS BIGINT) AS load_gpu,
               CAST(sum(change_count) OVER w AS BIGINT) AS active_jobs
        FROM deltas WINDOW w AS (ORDER BY t)"""),
    "predicted": (["jobs"], """
        SELECT *, greatest(pred_us, 0) AS pred_linear, runtime_us // 2 AS pred_half,
               runtime_us // 1800000000 * 1800000000 AS pred_coarse FROM jobs"""),
    "predicted_long": (["predicted"], """
        SELECT gpu_type, model, runtime_us / 1e6 AS y, p / 1e6 AS p FROM (
            SELECT gpu_type, runtime_us, 'linear' AS model, pred_linear AS p FROM predicted
            UNION ALL SELECT gpu_type, runtime_us, 'half', pred_half FROM predicted
            UNION ALL SELECT gpu_type, runtime_us, 'coarse', pred_coarse FROM predicted)"""),
    "lines": (["jobs"], """
        SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY arrival_us, job_id) AS pos FROM jobs"""),
    "fifo": (["lines"], """
        SELECT queue_id, job_id, arrival_us AS submit_us, runtime_us, pos, arrival_us AS start_us,
               arrival_us + runtime_us AS completion_us, CAST(NULL AS BIGINT) AS free_us
        FROM lines WHERE pos = 1
        UNION ALL
        SELECT l.queue_id, l.job_id, l.arrival_us, l.runtime_us, l.pos, greatest(f.completion_us, l.arrival_us),
               greatest(f.completion_us, l.arrival_us) + l.runtime_us, f.completion_us
        FROM fifo f JOIN lines l ON l.queue_id = f.queue_id AND l.pos = f.pos + 1"""),
    "results": (["jobs"], """
        SELECT queue_id, policy, job_id, runtime_us, pred_us, done - runtime_us AS waiting_us,
               done AS turnaround_us, done / runtime_us::DOUBLE AS slowdown
        FROM (SELECT *, CAST(sum(runtime_us) OVER (PARTITION BY queue_id, policy
                             ORDER BY k, arrival_us, job_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done
              FROM (SELECT *, 'FIFO' AS policy, arrival_us AS k FROM jobs
                    UNION ALL SELECT *, 'SJF-Oracle', runtime_us FROM jobs
                    UNION ALL SELECT *, 'SJF-Pred', greatest(pred_us, 0) FROM jobs))"""),
    "means": (["results"], """
        SELECT policy, sum(waiting_us)::DOUBLE / count(*) / 1e6 AS mean_wait,
               sum(turnaround_us)::DOUBLE / count(*) / 1e6 AS mean_jct, avg(slowdown) AS mean_slowdown
        FROM results GROUP BY policy"""),
    "diffs": (["results"], """
        SELECT o.policy, o.job_id, f.turnaround_us - o.turnaround_us AS d
        FROM results o JOIN results f ON f.job_id = o.job_id AND f.policy = 'FIFO' WHERE o.policy <> 'FIFO'"""),
    "ranks": (["diffs"], """
        SELECT policy, d, count(*) OVER (PARTITION BY policy, abs(d)) AS ties,
               rank() OVER (PARTITION BY policy ORDER BY abs(d))
                 + (count(*) OVER (PARTITION BY policy, abs(d)) - 1) / 2.0 AS r
        FROM diffs WHERE d <> 0"""),
    "signed": (["ranks"], """
        SELECT policy, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS w_plus,
               sum(ties::DOUBLE * ties - 1)::DOUBLE AS tie_term
        FROM ranks GROUP BY policy"""),
}

NUMERIC = ["gpu_demand", "arrival_sec", "num_inst", "num_cpu", "hour_of_day", "day_of_week",
           "cluster_load_cpu", "cluster_load_gpu", "active_job_count"]

ERRORS = """
    count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
    round(CASE WHEN var_pop(y) = 0 THEN CASE WHEN sum(abs(y - p)) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
               ELSE 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END, 6) AS r2,
    round(avg(abs(y - p) / y) FILTER (y > 0), 6) AS mape,
    round(avg(CASE WHEN abs(y) + abs(p) > 0 THEN 2 * abs(y - p) / (abs(y) + abs(p)) ELSE 0 END), 6) AS smape,
    round(avg(p - y), 6) AS bias, round(avg(CASE WHEN p > y THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS over_share,
    round(avg(CASE WHEN p < y THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS under_share,
    round(quantile_cont(abs(y - p), 0.5), 6) AS mdae"""


def _needed(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in BLOCKS[name][0]:
                visit(other)
            order.append(name)

    for name in names:
        visit(name)
    return order


def _sql(body: str, *blocks: str) -> str:
    parts = [f"{name} AS ({BLOCKS[name][1]})" for name in _needed(list(blocks))]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def _histogram(value: str, source: str, bins: int, extra: str = "") -> str:
    """Histogram over ``value``; a value belongs to the bin whose edges enclose it."""
    return f"""
    , x AS (SELECT {value} AS x FROM {source}),
    e AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / {bins}.0::DOUBLE AS w FROM x),
    edges AS (SELECT i AS bin, CASE WHEN i = 0 THEN lo ELSE lo + i * w END AS l,
                     CASE WHEN i = {bins} - 1 THEN hi ELSE lo + (i + 1) * w END AS r
              FROM e, range({bins}) AS g(i))
    SELECT bin, round(l, 6) AS "left", round(r, 6) AS "right", count(x) AS n{extra}
    FROM edges LEFT JOIN x ON x.x >= l AND (x.x < r OR (bin = {bins} - 1 AND x.x <= r))
    GROUP BY bin, l, r"""


def _describe(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(f"""
        SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}::DOUBLE), 6) AS "mean",
               round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS "min",
               round(max({c})::DOUBLE, 6) AS "max", round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q1,
               round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median,
               round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q3 FROM {source}""" for c in columns)


def _windows(padded: bool, only_test: bool, length: int = 4) -> str:
    """One row per job and step; steps before the first job take the first job."""
    back = length - 1
    limits = "" if padded else f"WHERE a.rn >= {length}"
    if only_test:
        limits += " AND a.split = 'test'"
    return f"""
    SELECT a.job_id, CAST(s.pos AS BIGINT) AS pos, b.gpu_demand::DOUBLE AS gpu_demand,
           b.num_cpu::DOUBLE AS num_cpu, round(b.job_runtime, 6) AS job_runtime
    FROM numbered a CROSS JOIN range({length}) AS s(pos)
    JOIN numbered b ON b.rn = greatest(a.rn - {back} + s.pos, 1) {limits}"""


def _stump_rounds(loss: str, rounds: int, step: float, train: str, cuts: str) -> str:
    """Margins ``m1`` .. of rounds of stumps over ``train`` (x, y, val), each the best of all cuts."""
    sign, leaf, base = ("sign(y - m)", "quantile_cont(y - m, 0.5)", "quantile_cont(y, 0.5)") if loss == "absolute" \
        else ("y - m", "avg(y - m)", "avg(y)")
    sql = f"""
        , h AS ({train}), cut AS ({cuts}),
        m0 AS (SELECT *, (SELECT {base} FROM h WHERE NOT val) AS m FROM h)"""
    for k in range(1, rounds + 1):
        sql += f""",
        g{k} AS (SELECT *, {sign} AS g FROM m{k - 1}),
        b{k} AS (SELECT t FROM g{k}, cut WHERE NOT val GROUP BY t
                 ORDER BY var_pop(g) FILTER (x <= t) * count(*) FILTER (x <= t)
                          + var_pop(g) FILTER (x > t) * count(*) FILTER (x > t), t LIMIT 1),
        l{k} AS (SELECT t, {leaf} FILTER (x <= t AND NOT val) AS l, {leaf} FILTER (x > t AND NOT val) AS r FROM m{k - 1}, b{k} GROUP BY t),
        m{k} AS (SELECT job_id, x, y, val, m + {step}::DOUBLE * CASE WHEN x <= t THEN l ELSE r END AS m FROM m{k - 1}, l{k})"""
    return sql


def _boosting_rounds(loss: str, rounds: int = 8, step: float = 0.5, patience: int = 3) -> str:
    train = """SELECT job_id, num_cpu AS x, job_runtime AS y, row_number() OVER (ORDER BY ('0x' || substr(md5(job_id || '|42'), 1, 10))::BIGINT,
                      job_id) <= ceil(0.15::DOUBLE * count(*) OVER ()) AS val FROM numbered WHERE split = 'train'"""
    sql = _stump_rounds(loss, rounds, step, train, "SELECT DISTINCT x AS t FROM h WHERE NOT val AND x < (SELECT max(x) FROM h WHERE NOT val)")
    errors = " UNION ALL ".join(f"SELECT {k} AS k, avg(abs(y - m)) AS e FROM m{k} WHERE val" for k in range(1, rounds + 1))
    return _sql(sql + f""",
        errors AS ({errors}),
        so_far AS (SELECT a.k, a.e, arg_min(b.k, (b.e, b.k)) AS best FROM errors a JOIN errors b ON b.k <= a.k GROUP BY a.k, a.e),
        ended AS (SELECT coalesce(min(k) FILTER (k - best >= {patience}), max(k)) AS last FROM so_far)
        SELECT k::BIGINT AS round, round(e, 6) AS val_mae, k = (SELECT arg_min(best, -k) FROM so_far, ended WHERE k <= last) AS best
        FROM so_far, ended WHERE k <= last""", "numbered")


def statements() -> dict[str, str]:
    q = {}
    q["raw_trace"] = _sql("""
        SELECT job_id, submit_time, round(duration, 6) AS duration, round(num_gpu, 6) AS num_gpu, num_cpu, num_inst,
               "user", gpu_type, queue_id, pred_us FROM trace""", "trace")
    q["valid_jobs"] = _sql("""
        SELECT job_id, round(duration, 6) AS duration, round(num_gpu, 6) AS num_gpu FROM sparse
        WHERE duration > 0 AND num_gpu > 0""", "sparse")
    q["job_table"] = _sql("""
        SELECT job_id, arrival_us AS arrival_time, round(arrival_sec, 6) AS arrival_sec,
               round(job_runtime, 6) AS job_runtime, gpu_demand, "user", gpu_type, num_inst, num_cpu, arrival_us,
               runtime_us, queue_id, pred_us, round(num_gpu, 6) AS num_gpu FROM jobs""", "jobs")
    q["csv_round_trip"] = _sql("""
        SELECT job_id, arrival_us AS arrival_time, round(arrival_sec, 6) AS arrival_sec,
               round(job_runtime, 6) AS job_runtime, gpu_demand, "user", gpu_type, num_inst, num_cpu, arrival_us,
               runtime_us FROM jobs""", "jobs")
    q["csv_baseline_round_trip"] = _sql("""
        SELECT job_id, arrival_us, round(arrival_sec, 6) AS arrival_sec, round(job_runtime, 6) AS job_runtime FROM jobs""", "jobs")
    processed = """
        SELECT job_id, arrival_us AS arrival_time, round(arrival_sec, 6) AS arrival_sec, round(job_runtime, 6) AS job_runtime,
               gpu_demand, "user", gpu_type, num_cpu, hour_of_day, cluster_load_gpu FROM engineered"""
    q["job_table_round_trip"] = q["job_table_csv"] = _sql(processed, "engineered")
    q["experiments_round_trip"] = _sql(f"""
        SELECT gpu_type || '_' || model AS experiment, mae, rmse, r2
        FROM (SELECT gpu_type, model, {ERRORS} FROM predicted_long GROUP BY gpu_type, model)""", "predicted_long")
    q["one_experiment"] = "SELECT 'purchase_half' AS experiment, '{\"model\":\"half\",\"track\":\"purchase\"}' AS params"
    q["holdouts"] = _sql("""
        SELECT job_id, pos < ceil(0.15::DOUBLE * n) AS is_val_cv, pos < ceil(0.10::DOUBLE * n) AS is_val_fit FROM hashed""", "hashed")
    q["job_table_exact_gpu"] = _sql("SELECT job_id, round(num_gpu, 6) AS gpu_demand FROM jobs", "jobs")
    q["temporal_features"] = _sql("SELECT job_id, hour_of_day, day_of_week FROM jobs", "jobs")
    q["fill_unknown"] = _sql("""
        SELECT job_id, coalesce("user", 'unknown') AS "user", coalesce(gpu_type, 'unknown') AS gpu_type
        FROM sparse""", "sparse")
    q["verify_features"] = _sql(" UNION ALL ".join(f"""
        SELECT '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS nulls,
               round(min({c})::DOUBLE, 6) AS low, round(max({c})::DOUBLE, 6) AS high FROM engineered"""
                                                   for c in [*NUMERIC, "job_runtime"]), "engineered")
    q["scaled_replay"] = _sql("""
        SELECT job_id, round((arrival_us - min(arrival_us) OVER ()) / 1e6 * 0.4::DOUBLE, 6) AS submit_time
        FROM numbered WHERE split = 'test'""", "numbered")
    q["predictions_long"] = _sql("""
        SELECT job_id, 'linear' AS policy, pred_linear AS predicted_runtime FROM predicted
        UNION ALL SELECT job_id, 'half', pred_half FROM predicted
        UNION ALL SELECT job_id, 'coarse', pred_coarse FROM predicted""", "predicted")
    q["clip_predictions"] = _sql("SELECT job_id, greatest(pred_us, 0) AS pred_us FROM jobs", "jobs")

    q["event_deltas"] = _sql("SELECT * FROM deltas", "deltas")
    q["cluster_state"] = _sql("SELECT * FROM state", "state")
    q["offered_load"] = _sql("SELECT * FROM loaded", "loaded")
    q["asof_state"] = _sql("""
        SELECT a.job_id, a.arrival_us + 30000000 AS t, CAST(coalesce(sum(b.num_cpu), 0) AS BIGINT) AS load_cpu,
               CAST(coalesce(sum(b.gpu_demand), 0) AS BIGINT) AS load_gpu, count(b.job_id) AS active_jobs
        FROM jobs a LEFT JOIN jobs b ON b.arrival_us <= a.arrival_us + 30000000
                                    AND b.arrival_us + b.runtime_us > a.arrival_us + 30000000
        GROUP BY a.job_id, a.arrival_us""", "jobs")
    # The best partner of each job among all candidates; one pair per job is kept.
    def asof(by, where, order):
        return _sql(f"""
        , m AS (SELECT *, arrival_us // 60000000 AS minute FROM jobs),
        pairs AS (SELECT a.job_id, b.job_id AS found, b.minute AS found_minute,
                         row_number() OVER (PARTITION BY a.job_id ORDER BY {order}) AS k
                  FROM m a JOIN m b ON b.gpu_type = 'purchase' AND {by} AND {where})
        SELECT job_id, found, found_minute FROM jobs LEFT JOIN (SELECT * FROM pairs WHERE k = 1) USING (job_id)""", "jobs")
    q["asof_nearest"] = asof("a.queue_id = b.queue_id", "true", """abs(a.minute - b.minute), b.minute > a.minute,
                             CASE WHEN b.minute > a.minute THEN b.job_id ELSE -b.job_id END""")
    q["asof_forward"] = asof("true", "b.minute >= a.minute AND b.minute <= (SELECT max(minute) FROM m)", "b.minute, b.job_id")
    q["asof_tolerance"] = asof("a.queue_id = b.queue_id", "b.minute <= a.minute AND a.minute - b.minute <= 180",
                               "b.minute DESC, b.job_id DESC")
    q["load_stream"] = q["load_by_span"] = _sql("SELECT job_id, cluster_load_cpu, cluster_load_gpu, active_job_count FROM loaded", "loaded")
    q["utilization_timeline"] = _sql("""
        SELECT t, round(load_cpu / 12000.0::DOUBLE, 6) AS cpu_util, round(load_gpu / 400.0::DOUBLE, 6) AS gpu_util,
               active_jobs FROM state""", "state")
    q["order_load"] = """
        WITH spans AS (
            SELECT o_orderkey AS job_id, o_orderdate AS a, max(l_shipdate) AS b, count(*) AS g
            FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING max(l_shipdate) > o_orderdate),
        days AS (SELECT d, CAST(sum(g) AS BIGINT) AS g, count(*) AS k
                 FROM (SELECT DISTINCT a AS d FROM spans) JOIN spans ON spans.a <= d AND spans.b > d GROUP BY d)
        SELECT job_id, days.g - spans.g AS cluster_load_gpu, k - 1 AS active_job_count
        FROM spans JOIN days ON a = d"""
    fits = "num_cpu <= c.cpu + 1e-5 AND num_gpu <= c.gpu + 1e-5"
    machines = "(VALUES (0, 10, 4.0::DOUBLE, 1.0::DOUBLE), (10, 5, 8.0::DOUBLE, 2.0::DOUBLE)) AS c(id, nodes, cpu, gpu)"
    q["feasible_nodes"] = _sql(f"""
        SELECT job_id, CAST(coalesce(sum(c.nodes), 0) AS BIGINT) AS feasible_nodes,
               CAST(min(c.id) AS BIGINT) AS first_fit
        FROM jobs LEFT JOIN {machines} ON {fits} GROUP BY job_id""", "jobs")
    table = """, mt AS (SELECT p_partkey AS id, p_size / 3.0::DOUBLE AS cpu, p_partkey % 41 / 10.0::DOUBLE AS gpu, p_partkey % 3 AS nodes
                        FROM part WHERE p_partkey % 3 > 0)"""
    fit = "num_cpu <= mt.cpu + 1e-5::DOUBLE AND num_gpu <= mt.gpu + 1e-5::DOUBLE"
    q["fits_in_machine_table"] = _sql(f"""{table}
        SELECT job_id, CAST(coalesce(sum(mt.nodes), 0) AS BIGINT) AS feasible_nodes, CAST(min(mt.id) AS BIGINT) AS first_fit
        FROM jobs LEFT JOIN mt ON {fit} GROUP BY job_id""", "jobs")
    q["fits_no_machine"] = _sql(f"""{table}
        SELECT job_id, num_cpu, round(num_gpu, 6) AS num_gpu FROM jobs
        WHERE NOT EXISTS (SELECT 1 FROM mt WHERE {fit} AND mt.cpu < 12 AND mt.gpu < 3.5)""", "jobs")
    q["unplaceable_jobs"] = _sql(f"""
        SELECT job_id, num_cpu, round(num_gpu, 6) AS num_gpu FROM jobs
        WHERE NOT EXISTS (SELECT 1 FROM {machines} WHERE {fits})""", "jobs")

    marks = """round(quantile_cont(runtime_us, 0.5) / 1e6, 6) AS {0}, round(quantile_cont(runtime_us, 0.95) / 1e6, 6)
               AS {1}, round(quantile_cont(runtime_us, 0.99) / 1e6, 6) AS {2}"""
    rest = """round(sum(gpu_demand)::DOUBLE / count(*), 6) AS mean_gpu_demand, max(gpu_demand) AS max_gpu_demand,
              round((max(arrival_us) - min(arrival_us)) / 3.6e9, 6) AS time_span_hours FROM jobs"""
    q["basic_stats"] = _sql(f"""
        SELECT count(*) AS num_jobs, round(sum(runtime_us)::DOUBLE / count(*) / 1e6, 6) AS mean_runtime,
               {marks.format('median_runtime', 'p95_runtime', 'p99_runtime')}, {rest}""", "jobs")
    q["workload_summary"] = _sql(f"""
        SELECT count(*) AS num_jobs, round(sum(runtime_us)::DOUBLE / count(*) / 1e6, 6) AS mean_runtime_sec,
               {marks.format('median_runtime_sec', 'p95_runtime_sec', 'p99_runtime_sec')}, {rest}""", "jobs")
    q["runtime_tails"] = _sql(f"""
        SELECT {marks.format('p50', 'p95', 'p99')}, round(max(runtime_us) / 1e6, 6) AS "max",
               round((quantile_cont(runtime_us, 0.95) / 1e6) / (quantile_cont(runtime_us, 0.5) / 1e6), 6)
               AS p95_p50_ratio FROM jobs""", "jobs")
    q["runtime_hist"] = _sql(_histogram("job_runtime", "jobs", 50), "jobs")
    q["runtime_hist_log"] = _sql(_histogram("log10(job_runtime + 1)", "jobs", 60), "jobs")
    q["gpu_demand_counts"] = _sql("SELECT gpu_demand, count(*) AS n FROM jobs GROUP BY gpu_demand", "jobs")
    q["describe_numeric"] = _sql(_describe(["job_runtime", "gpu_demand", "num_cpu", "arrival_sec"], "jobs"), "jobs")
    raw_columns = ["job_id", "submit_time", "duration", "num_gpu", "num_cpu", "num_inst", '"user"', "gpu_type",
                   "queue_id", "pred_us"]
    q["missing_summary"] = _sql("SELECT * FROM (" + " UNION ALL ".join(f"""
        SELECT '{c.strip('"')}' AS "column", count(*) - count({c}) AS missing,
               round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS percent FROM sparse"""
                                                                      for c in raw_columns)
                                + ") WHERE missing > 0", "sparse")
    kinds = {"job_id": "bigint", "duration": "double", "num_gpu": "double", '"user"': "string", "gpu_type": "string"}
    q["table_info"] = _sql(" UNION ALL ".join(
        f"""SELECT '{c.strip('"')}' AS "column", '{t}' AS "type", count({c}) AS non_null FROM sparse"""
        for c, t in kinds.items()), "sparse")
    every = [*NUMERIC, "job_runtime"]
    q["corr_matrix"] = _sql(" UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM engineered"
        for a in every for b in every), "engineered")
    q["corr_target"] = _sql(" UNION ALL ".join(
        f"""SELECT '{a}' AS "column", round(corr({a}, job_runtime), 6) AS corr FROM engineered"""
        for a in NUMERIC), "engineered")
    q["runtime_ecdf"] = _sql("""
        SELECT runtime_us AS value, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY runtime_us) AS BIGINT) AS cum,
               round(sum(count(*)) OVER (ORDER BY runtime_us)::DOUBLE / sum(count(*)) OVER (), 6) AS ecdf
        FROM jobs GROUP BY runtime_us""", "jobs")
    q["user_concentration"] = _sql("""
        SELECT count(*) AS users, CAST(sum(n) AS BIGINT) AS jobs,
               round((sum(n) FILTER (r <= 1))::DOUBLE / sum(n), 6) AS top1_share,
               round((sum(n) FILTER (r <= 5))::DOUBLE / sum(n), 6) AS top5_share,
               round((sum(n) FILTER (r <= 10))::DOUBLE / sum(n), 6) AS top10_share
        FROM (SELECT "user", count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, "user") AS r
              FROM jobs GROUP BY "user")""", "jobs")

    for name, width in (("arrival_rate_rel", 3600000000), ("arrival_rate_5min", 300000000)):
        q[name] = _sql(f"""
            , b AS (SELECT (arrival_us - min(arrival_us) OVER ()) // {width} AS bin FROM jobs)
            SELECT g.i AS bin, round(g.i * {width} / 3.6e9, 6) AS elapsed_hours, count(b.bin) AS n
            FROM range((SELECT max(bin) + 1 FROM b)) AS g(i) LEFT JOIN b ON b.bin = g.i GROUP BY g.i""", "jobs")
    q["arrival_rate_calendar"] = _sql("""
        , b AS (SELECT date_trunc('hour', make_timestamp(arrival_us)) AS h FROM jobs),
        g AS (SELECT unnest(generate_series((SELECT min(h) FROM b), (SELECT max(h) FROM b), INTERVAL 1 HOUR)) AS h)
        SELECT epoch_us(g.h) AS hour_us,
               round((epoch_us(g.h) - epoch_us((SELECT min(h) FROM b))) / 8.64e10, 6) AS elapsed_days, count(b.h) AS n
        FROM g LEFT JOIN b ON b.h = g.h GROUP BY g.h""", "jobs")
    q["arrival_heatmap"] = _sql("""
        SELECT d.i AS day_of_week, h.i AS hour_of_day, count(job_id) AS n
        FROM range(7) AS d(i) CROSS JOIN range(24) AS h(i)
        LEFT JOIN jobs ON day_of_week = d.i AND hour_of_day = h.i GROUP BY 1, 2""", "jobs")
    q["arrival_heatmap_matrix"] = _sql(
        "SELECT day_of_week, " + ", ".join(f"count(*) FILTER (hour_of_day = {h}) AS h{h:02d}" for h in range(24))
        + " FROM jobs GROUP BY day_of_week", "jobs")
    q["inter_arrival"] = _sql("""
        SELECT arrival_us, round((arrival_us - p) / 1e6, 6) AS gap_sec
        FROM (SELECT arrival_us, lag(arrival_us) OVER (ORDER BY arrival_us) AS p FROM jobs)
        WHERE arrival_us > p""", "jobs")
    q["arrival_rate_stream"] = """
        SELECT epoch_us(date_trunc('hour', ts)) AS window_start, count(*) AS n FROM events GROUP BY 1"""

    q["job_ordinal"] = _sql("SELECT job_id, rn - 1 AS ordinal FROM numbered", "numbered")
    q["first_jobs"] = _sql("SELECT job_id, arrival_us FROM jobs ORDER BY arrival_us, job_id LIMIT 3000", "jobs")
    q["chrono_split"] = _sql("SELECT job_id, split FROM numbered", "numbered")
    q["test_split_jobs"] = _sql("""
        SELECT job_id, arrival_us AS submit_time, "user" FROM numbered WHERE split = 'test'""", "numbered")
    q["split_stats"] = _sql("""
        SELECT split, count(*) AS n, round(avg(job_runtime), 6) AS mean_runtime,
               round(quantile_cont(job_runtime, 0.5), 6) AS median_runtime FROM numbered GROUP BY split""", "numbered")
    q["hash_split_sizes"] = _sql("""
        SELECT 'test' AS split, CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT) AS n FROM jobs
        UNION ALL SELECT 'train', count(*) - CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT) FROM jobs""", "jobs")
    q["hash_split"] = _sql("""
        SELECT job_id, CASE WHEN pos < ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM hashed""", "hashed")
    q["sample_jobs"] = _sql("SELECT job_id, job_runtime FROM hashed WHERE pos < 3000", "hashed")
    q["kfold_sizes"] = _sql("""
        SELECT CAST(CASE WHEN pos < floor(n * 1 / 3) THEN 0 WHEN pos < floor(n * 2 / 3) THEN 1 ELSE 2 END AS BIGINT) AS fold,
               count(*) AS n FROM hashed GROUP BY 1""", "hashed")
    q["chrono_val_split"] = _sql("""
        , s AS (SELECT count(*) AS m, greatest(CAST(floor((count(*) - 9) * 0.2::DOUBLE) AS BIGINT), 1) AS v
                FROM numbered WHERE split = 'train')
        SELECT job_id, CASE WHEN split = 'test' THEN 'test' WHEN rn <= 9 THEN 'warmup'
                            WHEN rn > m - v THEN 'val' ELSE 'train' END AS split FROM numbered, s""", "numbered")
    q["sequences_strict"] = _sql(_windows(False, False), "numbered")
    q["sequences_padded"] = _sql(_windows(True, False), "numbered")
    q["sequences_test"] = _sql(_windows(False, True), "numbered")
    plain = ", ".join("round(arrival_sec, 6) AS arrival_sec" if c == "arrival_sec" else c for c in NUMERIC)
    q["feature_table"] = _sql(f"""
        SELECT job_id, {plain}, "user", gpu_type, round(job_runtime, 6) AS job_runtime, split
        FROM engineered""", "engineered")
    q["numeric_features"] = _sql(f"SELECT job_id, {plain} FROM engineered", "engineered")
    q["feature_matrix"] = _sql("""
        SELECT job_id, gpu_demand, num_cpu, "user", round(job_runtime, 6) AS label, split FROM numbered""", "numbered")
    scaled = ", ".join(f"""
        round((a.{c} - t.{c}_lo)::DOUBLE / CASE WHEN t.{c}_hi = t.{c}_lo THEN 1 ELSE t.{c}_hi - t.{c}_lo END, 6)
        AS {c}""" for c in ("arrival_sec", "num_cpu", "job_runtime"))
    ends = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in ("arrival_sec", "num_cpu", "job_runtime"))
    q["minmax_scaled"] = _sql(f"""
        SELECT a.job_id, {scaled} FROM numbered a, (SELECT {ends} FROM numbered WHERE split = 'train') t""", "numbered")
    known = "IN (SELECT {0} FROM numbered WHERE split = 'train')"
    q["onehot_long"] = _sql(f"""
        SELECT job_id, 'user_' || "user" AS feature, 1.0::DOUBLE AS value FROM numbered
        WHERE "user" {known.format('"user"')}
        UNION ALL SELECT job_id, 'gpu_type_' || gpu_type, 1.0::DOUBLE FROM numbered
        WHERE gpu_type {known.format('gpu_type')}""", "numbered")
    q["categorical_index"] = _sql("""
        , u AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i
                FROM (SELECT DISTINCT "user" AS v FROM numbered WHERE split = 'train')),
        g AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i
              FROM (SELECT DISTINCT gpu_type AS v FROM numbered WHERE split = 'train'))
        SELECT job_id, coalesce(u.i, (SELECT count(*) FROM u))::DOUBLE AS user_index,
               coalesce(g.i, (SELECT count(*) FROM g))::DOUBLE AS gpu_type_index
        FROM numbered LEFT JOIN u ON u.v = "user" LEFT JOIN g ON g.v = gpu_type""", "numbered")

    core = "mae, rmse, r2, mape, mdae"
    q["regression_metrics"] = _sql(
        f"SELECT {core} FROM (SELECT {ERRORS} FROM predicted_long WHERE model = 'linear')", "predicted_long")
    q["error_report"] = _sql(f"SELECT model, {ERRORS} FROM predicted_long GROUP BY model", "predicted_long")
    q["error_by_runtime_bin"] = _sql(f"""
        SELECT CAST(floor(log10(y)) AS BIGINT) AS decade, {ERRORS} FROM predicted_long
        WHERE model = 'linear' GROUP BY 1""", "predicted_long")
    q["residual_hist"] = _sql(_histogram(
        "p - y", "predicted_long WHERE model = 'linear'", 40,
        ", round((SELECT avg(x) FROM x), 6) AS mean_residual"), "predicted_long")
    q["error_ecdf"] = _sql("""
        , e AS (SELECT abs(runtime_us - pred_linear) AS v, count(*) AS n FROM predicted GROUP BY 1)
        SELECT v AS value, n, CAST(sum(n) OVER (ORDER BY v) AS BIGINT) AS cum,
               round(sum(n) OVER (ORDER BY v)::DOUBLE / sum(n) OVER (), 6) AS ecdf FROM e""", "predicted")
    q["leaderboard"] = _sql(f"""
        SELECT model, mae, r2, rank() OVER (ORDER BY mae) AS rank_mae, rank() OVER (ORDER BY r2 DESC) AS rank_r2
        FROM (SELECT model, {ERRORS} FROM predicted_long GROUP BY model)""", "predicted_long")
    q["experiment_ranking"] = _sql(f"""
        SELECT gpu_type, model, mae, rank() OVER (PARTITION BY gpu_type ORDER BY mae) AS rank
        FROM (SELECT gpu_type, model, {ERRORS} FROM predicted_long GROUP BY gpu_type, model)""", "predicted_long")

    q["model_comparison"] = _sql(f"""
        SELECT gpu_type AS track, model, mae, rmse, r2, row_number() OVER (PARTITION BY gpu_type ORDER BY mae, model) AS place
        FROM (SELECT gpu_type, model, {ERRORS} FROM predicted_long GROUP BY gpu_type, model)""", "predicted_long")
    q["champion_parameters"] = _sql("""
        SELECT DISTINCT gpu_type || '_' || model AS experiment,
               '{"model":"' || model || '","track":"' || gpu_type || '"}' AS params FROM predicted_long""", "predicted_long")
    # The normal tail by its power series; beyond six deviations it is 0 or 1 to six places.
    q["significance_table"] = _sql("""
        , t AS (SELECT policy, w_plus, (w_plus - n * (n + 1) / 4.0) / sqrt((n::DOUBLE * (n + 1) * (2 * n + 1) - tie_term / 2) / 24) AS z
                FROM signed),
        p AS (SELECT policy, w_plus, CASE WHEN z > 6 THEN 0.0 WHEN z < -6 THEN 1.0 ELSE 0.5 - list_sum(list_transform(
                  range(0, 120), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * z
                      * exp(2 * k * ln(greatest(abs(z), 1e-300)) - k * ln(2.0) - lgamma(k + 1)) / (2 * k + 1)))
                  / sqrt(2 * pi()) END AS v FROM t)
        SELECT policy, round(mean_jct, 6) AS mean_jct,
               round((SELECT mean_jct FROM means WHERE policy = 'FIFO') - mean_jct, 6) AS jct_vs_baseline,
               round(w_plus, 6) AS wilcoxon_w, round(v, 6) AS p_value, v < 0.05 AS significant
        FROM p JOIN means USING (policy)""", "signed", "means")
    q["stump_scores"] = _sql("""
        , tr AS (SELECT num_cpu AS x, job_runtime AS y FROM numbered WHERE split = 'train'),
        cut AS (SELECT DISTINCT x AS t FROM tr WHERE x < (SELECT max(x) FROM tr)),
        tried AS (SELECT t, avg(y) FILTER (x <= t) AS l, avg(y) FILTER (x > t) AS r,
                         var_pop(y) FILTER (x <= t) * count(*) FILTER (x <= t)
                         + var_pop(y) FILTER (x > t) * count(*) FILTER (x > t) AS loss FROM tr, cut GROUP BY t),
        best AS (SELECT * FROM tried ORDER BY loss, t LIMIT 1)
        SELECT job_id, round(CASE WHEN num_cpu <= t THEN l ELSE r END, 6) AS pred_tree,
               round(CASE WHEN num_cpu <= t THEN l ELSE r END, 6) AS pred_boosted
        FROM numbered, best WHERE split = 'test'""", "numbered")
    q["model_round_trip"] = _sql("""
        , tr AS (SELECT num_cpu AS x, job_runtime AS y FROM numbered WHERE split = 'train'),
        cut AS (SELECT DISTINCT x AS t FROM tr WHERE x < (SELECT max(x) FROM tr)),
        tried AS (SELECT t, avg(y) FILTER (x <= t) AS l, avg(y) FILTER (x > t) AS r FROM tr, cut GROUP BY t),
        best AS (SELECT t, l, r FROM tried, tr GROUP BY t, l, r ORDER BY sum(pow(y - CASE WHEN x <= t THEN l ELSE r END, 2)), t LIMIT 1)
        SELECT job_id, round(CASE WHEN num_cpu <= t THEN l ELSE r END, 6) AS pred_tree
        FROM numbered, best WHERE split = 'test'""", "numbered")
    q["l1_stump_scores"] = _sql(_stump_rounds(
        "absolute", 1, 1.0, "SELECT job_id, num_cpu AS x, job_runtime AS y, false AS val FROM numbered WHERE split = 'train'",
        "SELECT DISTINCT x AS t FROM h WHERE x < (SELECT max(x) FROM h)") + """
        SELECT job_id, round((SELECT any_value(m) FROM m0) + CASE WHEN num_cpu <= t THEN l ELSE r END, 6) AS pred_l1
        FROM numbered, l1 WHERE split = 'test'""", "numbered")
    q["boosting_rounds_l1"] = _boosting_rounds("absolute")
    q["boosting_rounds_l2"] = _boosting_rounds("squared")
    q["target_codes"] = _sql("""
        , tr AS (SELECT *, CASE WHEN split = 'train' THEN job_runtime::DECIMAL(28, 6) END AS own FROM numbered),
        mean AS (SELECT sum(own)::DOUBLE / count(own) AS m FROM tr),
        u AS (SELECT "user", sum(own) AS s, count(own) AS n FROM tr GROUP BY "user"),
        g AS (SELECT gpu_type, sum(own) AS s, count(own) AS n FROM tr GROUP BY gpu_type)
        SELECT job_id,
          round(((coalesce(u.s, 0) - coalesce(own, 0))::DOUBLE + 20 * m) / (u.n - (own IS NOT NULL)::INT + 20), 6) AS user_code,
          round(((coalesce(g.s, 0) - coalesce(own, 0))::DOUBLE + 20 * m) / (g.n - (own IS NOT NULL)::INT + 20), 6) AS gpu_type_code
        FROM tr JOIN u USING ("user") JOIN g USING (gpu_type), mean""", "numbered")
    # The exact distribution of the doubled rank sum, one rank after the other.
    q["signed_rank_groups"] = _sql("""
        , gd AS (SELECT policy, "user", gpu_type, job_id, d FROM diffs JOIN jobs USING (job_id)),
        rk AS (SELECT *, row_number() OVER (PARTITION BY policy, "user", gpu_type ORDER BY abs(d), job_id) AS i,
                 count(*) OVER (PARTITION BY policy, "user", gpu_type, abs(d)) AS ties,
                 2 * count(*) OVER (PARTITION BY policy, "user", gpu_type ORDER BY abs(d))
                   - count(*) OVER (PARTITION BY policy, "user", gpu_type, abs(d)) + 1 AS r FROM gd WHERE d <> 0),
        st AS (SELECT policy, "user", gpu_type, count(r) AS n, coalesce(sum(r) FILTER (rk.d > 0), 0)::BIGINT AS w2,
                 coalesce(sum(ties::DOUBLE * ties - 1), 0) AS tie_term
               FROM (SELECT DISTINCT policy, "user", gpu_type FROM gd) LEFT JOIN rk USING (policy, "user", gpu_type)
               GROUP BY policy, "user", gpu_type),
        ways AS (SELECT policy, "user", gpu_type, 0::BIGINT AS i, 0::BIGINT AS s, 1::DOUBLE AS w FROM st WHERE n <= 50
                 UNION ALL
                 SELECT policy, "user", gpu_type, i, s, sum(w) FROM (
                   SELECT w.policy, w."user", w.gpu_type, r.i, unnest([w.s, w.s + r.r]) AS s, w.w
                   FROM ways w JOIN rk r ON r.policy = w.policy AND r."user" = w."user" AND r.gpu_type = w.gpu_type AND r.i = w.i + 1)
                 GROUP BY policy, "user", gpu_type, i, s),
        tail AS (SELECT st.policy, st."user", st.gpu_type, sum(w) FILTER (s >= w2) / pow(2.0, any_value(n)) AS p
                 FROM ways w JOIN st ON st.policy = w.policy AND st."user" = w."user" AND st.gpu_type = w.gpu_type AND w.i = n
                 GROUP BY ALL),
        zs AS (SELECT *, CASE WHEN n > 0 THEN (w2 / 2.0 - n * (n + 1) / 4.0)
                 / sqrt((n::DOUBLE * (n + 1) * (2 * n + 1) - tie_term / 2) / 24) END AS z FROM st)
        SELECT policy, "user", gpu_type, n, round(w2 / 2.0, 6) AS w_plus, round(z, 6) AS z, n <= 50 AS exact,
          round(CASE WHEN n <= 50 THEN p WHEN z > 6 THEN 0.0 WHEN z < -6 THEN 1.0 ELSE 0.5 - list_sum(list_transform(
            range(0, 120), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * z
                * exp(2 * k * ln(greatest(abs(z), 1e-300)) - k * ln(2.0) - lgamma(k + 1)) / (2 * k + 1))) / sqrt(2 * pi()) END, 6) AS p_value
        FROM zs LEFT JOIN tail USING (policy, "user", gpu_type)""", "diffs")
    q["queue_fifo"] = _sql("""
        SELECT queue_id, job_id, submit_us, runtime_us, start_us, completion_us, start_us - submit_us AS waiting_us,
               completion_us - submit_us AS turnaround_us,
               round((completion_us - submit_us) / runtime_us::DOUBLE, 6) AS slowdown FROM fifo""", "fifo")
    q["queue_fifo_global"] = _sql("""
        , w AS (SELECT job_id, arrival_us, runtime_us, CAST(sum(runtime_us) OVER (ORDER BY arrival_us, job_id
                       ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM jobs),
        d AS (SELECT job_id, runtime_us, s + max(arrival_us - s + runtime_us) OVER (ORDER BY arrival_us, job_id
                     ROWS UNBOUNDED PRECEDING) AS c FROM w)
        SELECT job_id, CAST(c - runtime_us AS BIGINT) AS start_us, CAST(c AS BIGINT) AS completion_us FROM d""", "jobs")
    q["busy_periods"] = _sql("""
        , p AS (SELECT *, CAST(sum(CASE WHEN free_us IS NULL OR submit_us >= free_us THEN 1 ELSE 0 END)
                OVER (PARTITION BY queue_id ORDER BY pos) AS BIGINT) AS period FROM fifo)
        SELECT queue_id, period, min(start_us) AS begin_us, max(completion_us) AS end_us, count(*) AS jobs,
               CAST(sum(runtime_us) AS BIGINT) AS work_us FROM p GROUP BY queue_id, period""", "fifo")
    q["pending_timeline"] = _sql("""
        , s AS (SELECT queue_id, t, sum(d) AS d FROM (SELECT queue_id, submit_us AS t, 1 AS d FROM fifo
                    UNION ALL SELECT queue_id, start_us, -1 FROM fifo) GROUP BY queue_id, t)
        SELECT queue_id, t, CAST(sum(d) OVER (PARTITION BY queue_id ORDER BY t) AS BIGINT) AS pending
        FROM s""", "fifo")
    q["next_job_per_queue"] = _sql("""
        SELECT queue_id, policy, job_id FROM results WHERE waiting_us = 0""", "results")
    q["backlog_policies"] = _sql("""
        SELECT queue_id, policy, job_id, waiting_us, turnaround_us AS completion_us FROM results""", "results")
    q["policy_results"] = _sql("""
        SELECT policy, job_id, round(waiting_us / 1e6, 6) AS waiting_time,
               round(turnaround_us / 1e6, 6) AS turnaround_time, round(slowdown, 6) AS slowdown FROM results""", "results")
    q["results_with_pred"] = _sql("""
        SELECT policy, job_id, waiting_us, pred_us, round(runtime_us / 1e6, 6) AS job_runtime FROM results""", "results")
    q["policy_means"] = _sql("""
        SELECT policy, round(mean_wait, 6) AS mean_wait, round(mean_jct, 6) AS mean_jct,
               round(mean_slowdown, 6) AS mean_slowdown FROM means""", "means")
    q["policy_summary"] = _sql(f"""
        , s AS (SELECT policy, count(*) AS jobs, round(max(turnaround_us) / 1e6, 6) AS max_jct,
                       round(quantile_cont(waiting_us, 0.5) / 1e6, 6) AS median_wait,
                       round(quantile_cont(waiting_us, 0.95) / 1e6, 6) AS p95_wait FROM results GROUP BY policy),
        e AS (SELECT 'SJF-Pred' AS policy, {ERRORS} FROM predicted_long WHERE model = 'linear')
        SELECT policy, s.jobs, round(mean_wait, 6) AS mean_wait, round(mean_jct, 6) AS mean_jct, max_jct,
               round(mean_slowdown, 6) AS mean_slowdown, median_wait, p95_wait, e.mae, e.rmse, e.r2
        FROM s JOIN means USING (policy) LEFT JOIN e USING (policy)""", "means", "predicted_long")
    base = ", (SELECT mean_wait AS bw, mean_jct AS bj, mean_slowdown AS bs FROM means WHERE policy = 'FIFO')"
    q["improvement_vs_fifo"] = _sql(f"""
        SELECT policy, round(mean_jct, 6) AS mean_jct, round((bj - mean_jct) / bj * 100, 2) AS jct_improvement_pct
        FROM means{base}""", "means")
    q["improvement_matrix"] = _sql(f"""
        SELECT policy, round((bw - mean_wait) / bw * 100, 6) AS wait_gain_pct,
               round((bj - mean_jct) / bj * 100, 6) AS jct_gain_pct,
               round((bs - mean_slowdown) / bs * 100, 6) AS slowdown_gain_pct
        FROM means{base} WHERE policy <> 'FIFO'""", "means")
    q["speedup_table"] = _sql(f"""
        SELECT policy, round(bw / mean_wait, 6) AS wait_speedup, round(bj / mean_jct, 6) AS jct_speedup,
               round(bs / mean_slowdown, 6) AS slowdown_speedup FROM means{base}""", "means")
    q["wait_percentiles"] = _sql("SELECT policy, " + ", ".join(
        f"round(quantile_cont(waiting_us, {p}) / 1e6, 6) AS {name}"
        for name, p in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))
        + """, round(max(waiting_us) / 1e6, 6) AS "max" FROM results GROUP BY policy""", "results")
    q["wait_ecdf"] = _sql("""
        SELECT policy, waiting_us AS value, count(*) AS n,
               CAST(sum(count(*)) OVER (PARTITION BY policy ORDER BY waiting_us) AS BIGINT) AS cum,
               round(sum(count(*)) OVER (PARTITION BY policy ORDER BY waiting_us)::DOUBLE
                     / sum(count(*)) OVER (PARTITION BY policy), 6) AS ecdf
        FROM results GROUP BY policy, waiting_us""", "results")
    q["slowdown_boxplot"] = _sql("""
        , b AS (SELECT policy, quantile_cont(slowdown, 0.25) AS q1, quantile_cont(slowdown, 0.5) AS median,
                       quantile_cont(slowdown, 0.75) AS q3 FROM results GROUP BY policy)
        SELECT policy, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
               round(any_value(q3), 6) AS q3,
               round(min(slowdown) FILTER (slowdown >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
               round(max(slowdown) FILTER (slowdown <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
               count(*) FILTER (slowdown < q1 - 1.5 * (q3 - q1) OR slowdown > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM results JOIN b USING (policy) GROUP BY policy""", "results")
    z = """(w_plus - n * (n + 1.0::DOUBLE) / 4)
           / sqrt((n * (n + 1.0::DOUBLE) * (2 * n + 1) - tie_term / 2) / 24)"""
    q["wilcoxon"] = _sql(f"""
        SELECT policy, n, w_plus, tie_term, round({z}, 6) AS z FROM signed""", "signed")
    return q
