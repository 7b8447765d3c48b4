"""Queries over dashboard views, insights and scenarios."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tallyveer.config import AnalysisConfig
from tallyveer.functions import half_even
from tallyveer.operators import combination as cm
from tallyveer.operators import insight as ins
from tallyveer.operators import scenario as sc
from tallyveer.operators import series as se
from tallyveer.operators import views as vw
from tallyveer.operators.rollup import exact_sum
from tallyveer.registry import sql as q
from tallyveer.registry.core import query
from tallyveer.schema import ATTRIBUTION_DIMENSIONS
from tallyveer.sources.star import event_fact, star_fact, star_source

CFG = AnalysisConfig()
BY_TYPE = CFG.with_(series_keys=("category",))
SLIM = ("date", "revenue", "orders")
FACTS = f"WITH {q.FACT}"
SERIES = q.series_ctes()
EVENT_SERIES = q.series_ctes(("category",), q.EVENT_FACT)


def slim_series(spark, folder):
    return se.daily_series(star_fact(spark, folder, SLIM), CFG)


def event_series(spark, folder):
    return se.daily_series(event_fact(spark, folder), BY_TYPE)


@query(
    "a17_low_alerts",
    f"""{SERIES} SELECT metric, {q.iso('date')} AS date, value, {q.rnd('mean', 4)} AS mean FROM (
    SELECT *, sum(amount) OVER (PARTITION BY metric)::DOUBLE / n AS mean FROM long)
    WHERE value < mean * 0.85::DOUBLE""",
)
def _(spark, folder):
    alerts = vw.low_alerts(slim_series(spark, folder), CFG)
    return alerts.select("metric", "date", "value", half_even(F.col("mean"), 4).alias("mean"))


@query(
    "a18_series_stats",
    f"{SERIES} SELECT metric, count(*) AS points, min(value) AS min_value, "
    "max(value) AS max_value FROM long GROUP BY metric",
)
def _(spark, folder):
    return vw.series_stats(slim_series(spark, folder), CFG)


@query(
    "a19_histogram",
    f"""{SERIES}, recent AS (
      SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM long WHERE rn <= 90
      WINDOW w AS (PARTITION BY metric))
    SELECT metric, bin, count(*) AS n, {q.rnd('max(lo) + bin * (max(hi) - max(lo)) / 25e0', 4)} AS bin_start
    FROM (SELECT *, least(24, CASE WHEN hi > lo THEN floor((value - lo) / (hi - lo) * 25e0)
          ELSE 0 END)::BIGINT AS bin FROM recent) GROUP BY metric, bin""",
)
def _(spark, folder):
    return vw.histogram(slim_series(spark, folder), CFG)


@query(
    "w8_week_over_week",
    f"""{SERIES}, blocks AS (
      SELECT metric, (n - rn) // 7 AS block, sum(amount)::DOUBLE AS total, count(*) AS days,
             max(date) AS last_date FROM long GROUP BY metric, block),
    labelled AS (
      SELECT b.*, (SELECT min(l.date) FROM long l WHERE l.metric = b.metric
                   AND l.date > b.last_date) AS label,
             lag(total) OVER (PARTITION BY metric ORDER BY block) AS before FROM blocks b)
    SELECT metric, block, {q.iso('label')} AS date,
           CASE WHEN coalesce(before, 0) <> 0 THEN {q.rnd('(total - before) / before * 1e2', 1)}
                ELSE 0 END AS wow_pct
    FROM labelled WHERE days = 7 AND label IS NOT NULL""",
)
def _(spark, folder):
    return vw.week_over_week(slim_series(spark, folder), CFG)


PERIODS = (("90d", 61, 90, 30), ("60d", 31, 60, 30), ("30d", 15, 30, 16), ("14d", 1, 14, 14))


@query(
    "w9_period_averages",
    SERIES
    + " "
    + " UNION ALL ".join(
        f"SELECT metric, '{name}' AS period, "
        f"{q.rnd(f'coalesce(sum(amount) FILTER (rn BETWEEN {a} AND {b}), 0)::DOUBLE / {d}e0', 2)} "
        "AS average FROM long GROUP BY metric"
        for name, a, b, d in PERIODS
    ),
)
def _(spark, folder):
    return vw.period_averages(slim_series(spark, folder), CFG)


@query(
    "w10_normalised",
    f"""{SERIES} SELECT metric, {q.iso('date')} AS date, {q.rnd('''(value - min(value) OVER w)
      / CASE WHEN max(value) OVER w > min(value) OVER w
             THEN max(value) OVER w - min(value) OVER w ELSE 1 END''', 6)} AS scaled
    FROM long WHERE rn <= 90 WINDOW w AS (PARTITION BY metric)""",
)
def _(spark, folder):
    scaled = vw.normalised(slim_series(spark, folder), CFG)
    return scaled.withColumn("scaled", half_even(F.col("scaled"), 6))


@query(
    "w11_trailing_slices",
    SERIES
    + " "
    + " UNION ALL ".join(
        f"SELECT metric, {k} AS \"rows\", count(*) AS points, sum(amount)::DOUBLE AS total, "
        f"{q.iso('min(date)')} AS first_date FROM long WHERE rn <= {k} GROUP BY metric"
        for k in vw.TRAILING_SLICES
    ),
)
def _(spark, folder):
    return vw.trailing_slices(slim_series(spark, folder), CFG)


# --- insights -------------------------------------------------------------------------


@query(
    "x1_calendar_gaps",
    f"""{FACTS}, seen AS (SELECT DISTINCT region, date FROM fact),
    span AS (SELECT region, min(date) AS lo, max(date) AS hi FROM seen GROUP BY region),
    every AS (SELECT region, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
              FROM span)
    SELECT e.region, {q.iso('e.date')} AS date FROM every e ANTI JOIN seen s
    ON e.region = s.region AND e.date = s.date""",
)
def _(spark, folder):
    cfg = CFG.with_(series_keys=("region",))
    return ins.calendar_gaps(star_fact(spark, folder, ("date", "region")), cfg)


@query(
    "x3_rolling_and_growth",
    f"""{SERIES} SELECT metric, {q.iso('date')} AS date, value,
    {q.rnd('''sum(amount) OVER f::DOUBLE / count(*) OVER f''', 4)} AS rolling_mean,
    {q.rnd('coalesce(' + q.pct('value', 'lag(value) OVER o') + ', 0)', 4)} AS growth_pct
    FROM long WINDOW o AS (PARTITION BY metric ORDER BY date),
    f AS (PARTITION BY metric ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""".replace(
        "sum(amount) OVER f::DOUBLE", "(sum(amount) OVER f)::DOUBLE"
    ),
)
def _(spark, folder):
    rolled = ins.rolling(slim_series(spark, folder), CFG)
    return rolled.withColumns(
        {c: half_even(F.col(c), 4) for c in ("rolling_mean", "growth_pct")}
    )


@query(
    "x4_bollinger",
    f"""{SERIES} SELECT metric, {q.iso('date')} AS date, value, {q.rnd('mean', 2)} AS mean,
    {q.rnd('mean - 2e0 * sd', 2)} AS lower, {q.rnd('mean + 2e0 * sd', 2)} AS upper FROM (
      SELECT metric, date, value, (sum(amount) OVER f)::DOUBLE / 20e0 AS mean, stddev_pop(value) OVER f AS sd,
             count(*) OVER f AS k FROM long
      WINDOW f AS (PARTITION BY metric ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    WHERE k = 20""",
)
def _(spark, folder):
    bands = ins.bollinger(slim_series(spark, folder), CFG)
    return bands.withColumns({c: half_even(F.col(c), 2) for c in ("mean", "lower", "upper")})


SEGMENT_SQL = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS group_value, sum(revenue)::DOUBLE AS revenue, "
    f"sum(orders) AS orders FROM fact GROUP BY {d}"
    for d in ATTRIBUTION_DIMENSIONS
)


@query("x5_segments", f"{FACTS} {SEGMENT_SQL}")
def _(spark, folder):
    groups = ins.segments(star_fact(spark, folder), ATTRIBUTION_DIMENSIONS, CFG)
    return groups.drop("revenue_exact")


@query(
    "x5_segment_cube",
    f"""{FACTS} SELECT coalesce(region, '(all)') AS region, coalesce(campaign, '(all)') AS campaign,
    coalesce(category, '(all)') AS category, sum(revenue)::DOUBLE AS revenue, sum(orders) AS orders
    FROM fact GROUP BY CUBE (region, campaign, category)""",
)
def _(spark, folder):
    columns = ("date", "region", "campaign", "category", "revenue", "orders")
    return ins.segment_cube(star_fact(spark, folder, columns), ["region", "campaign", "category"])


@query(
    "x5_concentration",
    f"""{FACTS}, groups AS ({SEGMENT_SQL}) SELECT dimension, count(*) AS groups,
    {q.rnd('sum(pow(revenue / total, 2))', 8)} AS hhi,
    {q.rnd('max(revenue / total)', 8)} AS largest_share
    FROM groups, (SELECT sum(revenue)::DOUBLE AS total FROM fact) GROUP BY dimension""",
)
def _(spark, folder):
    groups = ins.segments(star_fact(spark, folder), ATTRIBUTION_DIMENSIONS, CFG)
    risk = ins.concentration(groups, CFG)
    return risk.withColumns({c: half_even(F.col(c), 8) for c in ("hhi", "largest_share")})


WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


@query(
    "x6_anomaly_calendar",
    f"{SERIES},\n{q.scored()} SELECT metric, {q.iso('''date_trunc('week', date)''')} AS week_start, "
    + ", ".join(
        f"count(*) FILTER (flagged AND isodow(date) = {i}) AS {d}"
        for i, d in enumerate(WEEKDAYS, 1)
    )
    + " FROM scored GROUP BY metric, week_start",
)
def _(spark, folder):
    return ins.anomaly_calendar(slim_series(spark, folder), CFG)


@query(
    "x9_correlated_groups",
    f"""{FACTS}, days AS (SELECT date, sum(revenue) AS total FROM fact GROUP BY date),
    names AS (SELECT DISTINCT campaign FROM fact),
    filled AS (
      SELECT n.campaign, d.date, d.total::DOUBLE AS total, coalesce(g.own, 0)::DOUBLE AS own
      FROM names n CROSS JOIN days d LEFT JOIN
        (SELECT campaign, date, sum(revenue) AS own FROM fact GROUP BY ALL) g
        ON g.campaign = n.campaign AND g.date = d.date)
    SELECT campaign AS group_value, {q.rnd('corr(own, total - own)', 6)} AS correlation
    FROM filled GROUP BY campaign""",
)
def _(spark, folder):
    fact = star_fact(spark, folder, ("date", "campaign", "revenue"))
    found = ins.correlated_groups(fact, "campaign", CFG)
    return found.withColumn("correlation", half_even(F.col("correlation"), 6))


LATTICE_DIMS = ("region", "channel", "category", "campaign")
LATTICE_SETS = [p for k in (1, 2, 3) for p in combinations(LATTICE_DIMS, k)]
LATTICE_GROUPS = " UNION ALL ".join(
    f"SELECT {len(p)} AS depth, '{','.join(p)}' AS dimensions, concat_ws(',', {', '.join(p)}) AS \"group\", "
    f"sum(CASE WHEN is_current THEN revenue ELSE -revenue END) AS change FROM sliced GROUP BY ALL"
    for p in LATTICE_SETS
)
#: Child and parent, each as its dimensions and the text of its group.
LATTICE_STEPS = " UNION ALL ".join(
    f"SELECT DISTINCT '{','.join(p)}' AS dimensions, concat_ws(',', {', '.join(p)}) AS \"group\", "
    f"'{','.join(c)}' AS parent, concat_ws(',', {', '.join(c)}) AS parent_group FROM sliced"
    for p in LATTICE_SETS
    if len(p) > 1
    for c in combinations(p, len(p) - 1)
)


@query(
    "x9_combination_drivers",
    f"""{FACTS}, {q.sliced()}, g AS ({LATTICE_GROUPS}), steps AS ({LATTICE_STEPS}),
    whole AS (SELECT sum(CASE WHEN is_current THEN revenue ELSE -revenue END) AS total FROM sliced),
    sized AS (SELECT g.*, total, change::DOUBLE / total::DOUBLE * 1e2 AS share FROM g CROSS JOIN whole),
    r AS (SELECT c.*, s.parent, s.parent_group,
        coalesce(CASE WHEN c.change::DOUBLE / p.change::DOUBLE > 1 THEN p.change::DOUBLE / c.change::DOUBLE
                      WHEN p.change <> 0 THEN c.change::DOUBLE / p.change::DOUBLE END, 0) AS part
      FROM sized c JOIN steps s USING (dimensions, "group")
      JOIN g p ON p.dimensions = s.parent AND p."group" = s.parent_group),
    parts AS (SELECT dimensions, "group", min(part) AS part FROM r GROUP BY ALL),
    carried AS (SELECT DISTINCT parent, parent_group FROM r WHERE part >= 0.8 AND abs(share) >= 5),
    listed AS (
      SELECT depth, s.dimensions, s."group", change, share, total, coalesce(part, 1) AS part,
        coalesce(part, 1) >= 0.8 AND c.parent IS NULL AS cause
      FROM sized s LEFT JOIN parts p USING (dimensions, "group")
      LEFT JOIN carried c ON c.parent = s.dimensions AND c.parent_group = s."group" WHERE abs(share) >= 5)
    SELECT depth, dimensions, "group", {q.rnd('change', 2)} AS delta, {q.rnd('share', 6)} AS share, {q.rnd('part', 6)} AS part, cause FROM listed
    UNION ALL SELECT depth, dimensions, '(others)', {q.rnd('max(total) - sum(change)', 2)},
      {q.rnd('(max(total) - sum(change))::DOUBLE / max(total)::DOUBLE * 1e2', 6)}, NULL, false FROM listed GROUP BY depth, dimensions""",
)
def _(spark, folder):
    fact = star_fact(spark, folder, ("date", "revenue", *LATTICE_DIMS))
    found = cm.combination_drivers(fact, CFG, LATTICE_DIMS, 3)
    places = {"delta": 2, "share": 6, "part": 6}
    return found.withColumns({c: half_even(F.col(c), n) for c, n in places.items()})


WELCH_PARTS = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS group_value, date, is_current, "
    f"sum(revenue)::DOUBLE AS value FROM sliced GROUP BY {d}, date, is_current"
    for d in ATTRIBUTION_DIMENSIONS
)


@query(
    "x9_change_significance",
    f"""{FACTS}, {q.sliced()}, per_day AS ({WELCH_PARTS}),
    stats AS (SELECT dimension, group_value,
      count(*) FILTER (is_current) AS n1, avg(value) FILTER (is_current) AS m1,
      var_samp(value) FILTER (is_current) AS v1, count(*) FILTER (NOT is_current) AS n0,
      avg(value) FILTER (NOT is_current) AS m0, var_samp(value) FILTER (NOT is_current) AS v0
      FROM per_day GROUP BY ALL)
    SELECT dimension, group_value, {q.rnd('m1', 2)} AS mean_current, {q.rnd('m0', 2)} AS mean_previous,
      CASE WHEN v1 / n1 + v0 / n0 > 0 THEN {q.rnd('(m1 - m0) / sqrt(v1 / n1 + v0 / n0)', 4)}
           ELSE 0 END AS welch_t FROM stats WHERE n1 > 1 AND n0 > 1""",
)
def _(spark, folder):
    return ins.change_significance(star_source(spark, folder), CFG)


# --- scenarios ------------------------------------------------------------------------


def shocks():
    """Campaign pause in two regions, then a category stock-out, each relabelled."""
    return [
        sc.Shock(
            (F.col("campaign") == "MACHINERY") & F.col("region").isin("ASIA", "EUROPE"),
            {"revenue": 0.5, "orders": 0.5},
            {"campaign": "NONE"},
        ),
        sc.Shock(
            (F.col("category") == "ECONOMY") & (F.col("campaign") == "NONE"),
            {"revenue": 0.1},
            {"inventory_status": "out_of_stock", "incident_flag": 1.0},
        ),
    ]


SHOCKED = """shocked AS (
  SELECT * REPLACE (CASE WHEN hit1 THEN 'NONE' ELSE campaign END AS campaign,
    revenue::DOUBLE * CASE WHEN hit1 THEN 0.5::DOUBLE ELSE 1e0 END
      * CASE WHEN hit1 AND category = 'ECONOMY' THEN 0.1::DOUBLE ELSE 1e0 END AS revenue,
    CASE WHEN hit1 AND category = 'ECONOMY' THEN 'out_of_stock' ELSE inventory_status END
      AS inventory_status,
    CASE WHEN hit1 AND category = 'ECONOMY' THEN 1e0 ELSE incident_flag END AS incident_flag)
  FROM (SELECT *, campaign = 'MACHINERY' AND region IN ('ASIA', 'EUROPE') AS hit1 FROM fact))"""


@query(
    "p22_scenario_facts",
    f"{FACTS}, {SHOCKED} SELECT campaign, inventory_status, incident_flag, count(*) AS n, "
    f"{q.rnd('sum(CAST(revenue AS DECIMAL(28,8)))::DOUBLE', 2)} AS revenue "
    "FROM shocked GROUP BY ALL",
)
def _(spark, folder):
    changed = sc.apply_scenario(star_fact(spark, folder), shocks())
    return changed.groupBy("campaign", "inventory_status", "incident_flag").agg(
        F.count("*").alias("n"),
        half_even(F.sum(F.col("revenue").cast("decimal(28,8)")).cast("double"), 2).alias("revenue"),
    )


@query(
    "x7_scenario_difference",
    f"""{FACTS}, {SHOCKED},
    a AS (SELECT campaign, sum(revenue) AS base FROM fact GROUP BY campaign),
    b AS (SELECT campaign, sum(CAST(revenue AS DECIMAL(28,8))) AS scenario FROM shocked GROUP BY campaign)
    SELECT campaign, {q.rnd('coalesce(base, 0)::DOUBLE', 2)} AS base,
    {q.rnd('coalesce(scenario, 0)::DOUBLE', 2)} AS scenario,
    {q.rnd('(coalesce(scenario, 0) - coalesce(base, 0))::DOUBLE', 2)} AS difference
    FROM a FULL JOIN b USING (campaign)""",
)
def _(spark, folder):
    columns = (
        "date", "campaign", "region", "category", "inventory_status", "incident_flag",
        "revenue", "orders",
    )
    diff = sc.run_scenario(star_fact(spark, folder, columns), shocks(), ["campaign"], CFG)
    return diff.withColumns(
        {c: half_even(F.col(c), 2) for c in ("base", "scenario", "difference")}
    )
