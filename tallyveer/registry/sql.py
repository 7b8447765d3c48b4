"""Building blocks of the comparison SQL: the same semantics in plain joins and sums.

The SQL follows another route than the Spark code on purpose (gap joins instead
of arrays, one statement per dimension instead of grouping sets), so agreement
of both says something.
"""

from __future__ import annotations

from tallyveer.schema import ATTRIBUTION_DIMENSIONS

LOOKBACK = 14
METRICS = ("revenue", "orders", "avg_order_value")
LABELS = {"revenue": "Revenue", "orders": "Order Volume", "avg_order_value": "Avg Order Value"}


def rnd(expr: str, places: int) -> str:
    """Half-even rounding by scaling, like the Spark side."""
    if places == 0:
        return f"round_even(({expr})::DOUBLE, 0)"
    return f"(round_even(({expr})::DOUBLE * 1e{places}, 0) / 1e{places})"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def path_length(n: str) -> str:
    m = f"({n})::DOUBLE"
    return (
        f"(CASE WHEN {m} <= 1 THEN 0.0::DOUBLE WHEN {m} = 2 THEN 1.0::DOUBLE "
        f"ELSE 2e0 * (ln({m} - 1e0) + 0.5772156649::DOUBLE) - 2e0 * ({m} - 1e0) / {m} END)"
    )


HOLIDAY_CODES = "101, 115, 219, 527, 704, 902, 1128, 1129, 1224, 1225"

FACT = f"""fact AS (
  SELECT CAST(o.o_orderdate AS DATE) AS date,
         coalesce(r.r_name, 'Unknown') AS region, coalesce(p.p_name, 'Unknown') AS product,
         coalesce(p.p_type, 'Unknown') AS category,
         coalesce(o.o_orderpriority, 'Unknown') AS channel,
         coalesce(c.c_mktsegment, 'Unknown') AS campaign,
         coalesce(l.l_linestatus, 'Unknown') AS inventory_status,
         CASE WHEN l.l_discount = 0 THEN 'none' WHEN l.l_discount <= 0.03::DOUBLE THEN 'low'
              WHEN l.l_discount <= 0.07::DOUBLE THEN 'medium' ELSE 'high' END AS discount_band,
         CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS revenue,
         1.0::DOUBLE AS orders, l.l_quantity AS impressions,
         CASE WHEN month(o.o_orderdate) * 100 + day(o.o_orderdate) IN ({HOLIDAY_CODES})
              THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS holiday_flag,
         CASE WHEN l.l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS incident_flag
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  WHERE o.o_orderdate IS NOT NULL)"""

EVENT_FACT = """fact AS (
  SELECT CAST(ts AS DATE) AS date, coalesce(event_type, 'Unknown') AS category,
         CAST(coalesce(value, 0) AS DECIMAL(18,4)) AS revenue, 1.0::DOUBLE AS orders
  FROM events WHERE ts IS NOT NULL)"""

ROLLED = f"""rolled AS (
  SELECT *, CASE WHEN orders > 0 THEN {rnd('revenue::DOUBLE / orders::DOUBLE', 2)} ELSE 0 END
              AS avg_order_value,
         CASE WHEN impressions > 0
              THEN {rnd('orders::DOUBLE / impressions::DOUBLE * 1e2', 4)} ELSE 0 END
              AS conversion_rate
  FROM (SELECT date, region, product, category, channel, campaign, inventory_status,
               discount_band, holiday_flag, incident_flag,
               sum(revenue) AS revenue, sum(CAST(orders AS DECIMAL(18,4))) AS orders,
               sum(CAST(impressions AS DECIMAL(18,4))) AS impressions
        FROM fact GROUP BY ALL))"""


def key_list(keys: tuple[str, ...], alias: str = "") -> str:
    prefix = f"{alias}." if alias else ""
    return "".join(f"{prefix}{k}, " for k in keys)


def daily(keys: tuple[str, ...] = (), parity: bool = False) -> str:
    k = key_list(keys)
    if parity:
        return f"""daily AS (
  SELECT {k}date, sum(revenue) AS revenue, sum(orders) AS orders,
         sum(CAST(avg_order_value AS DECIMAL(18,4))) AS avg_order_value
  FROM rolled GROUP BY ALL)"""
    return f"""daily AS (
  SELECT *, CAST(CASE WHEN orders > 0 THEN {rnd('revenue::DOUBLE / orders::DOUBLE', 2)}
                 ELSE 0 END AS DECIMAL(28,4)) AS avg_order_value
  FROM (SELECT {k}date, sum(revenue) AS revenue, sum(CAST(orders AS DECIMAL(18,4))) AS orders
        FROM fact GROUP BY ALL))"""


def long(keys: tuple[str, ...] = ()) -> str:
    k = key_list(keys)
    parts = " UNION ALL ".join(
        f"SELECT {k}'{m}' AS metric, date, CAST({m} AS DECIMAL(28,4)) AS amount, "
        f"{m}::DOUBLE AS value FROM daily"
        for m in METRICS
    )
    w = f"PARTITION BY {k}metric"
    return f"""long AS (
  SELECT *, row_number() OVER ({w} ORDER BY date DESC) AS rn, count(*) OVER ({w}) AS n
  FROM ({parts}))"""


def series_ctes(
    keys: tuple[str, ...] = (), fact: str = FACT, parity: bool = False
) -> str:
    middle = f"{ROLLED},\n" if parity else ""
    return f"WITH {fact},\n{middle}{daily(keys, parity)},\n{long(keys)}"


def scored(keys: tuple[str, ...] = (), contamination: float = 0.08) -> str:
    """Isolation scores through a join of points and gaps."""
    k = key_list(keys)
    using = f"({k}metric)"
    g = f"{k}metric"
    return f"""sample AS (
  SELECT {g}, value FROM (
    SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY value, date) - 1 AS place FROM long WHERE n >= 10)
  WHERE list_contains(list_transform(range(256), lambda i: (n * (2 * i + 1)) // 512), place)),
points AS (SELECT {g}, value AS x, count(*) AS ties FROM sample GROUP BY {g}, value),
sizes AS (SELECT {g}, count(*) AS m, count(DISTINCT value) AS k FROM sample GROUP BY {g}),
gaps AS (
  SELECT * FROM (SELECT {g}, x AS lo, lead(x) OVER (PARTITION BY {g} ORDER BY x) AS hi FROM points)
  WHERE hi IS NOT NULL),
depths AS (
  SELECT {key_list(keys, 'p')}p.metric, p.x,
         coalesce(sum(CASE WHEN q.lo >= p.x THEN (q.hi - q.lo) / (q.hi - p.x)
                           ELSE (q.hi - q.lo) / (p.x - q.lo) END), 0)
           + {path_length('max(p.ties)')} AS d
  FROM points p LEFT JOIN gaps q USING {using}
  GROUP BY {key_list(keys, 'p')}p.metric, p.x),
neighbours AS (
  SELECT {g}, x AS x0, d AS d0, lead(x) OVER (PARTITION BY {g} ORDER BY x) AS x1,
         lead(d) OVER (PARTITION BY {g} ORDER BY x) AS d1,
         row_number() OVER (PARTITION BY {g} ORDER BY x) AS i
  FROM depths),
placed AS (
  SELECT l.*, s.m, s.k,
         CASE WHEN b.x1 IS NULL THEN b.d0 WHEN l.value < b.x0 THEN b.d0
              ELSE b.d0 + (b.d1 - b.d0) * (l.value - b.x0) / (b.x1 - b.x0) END AS depth
  FROM long l JOIN sizes s USING {using} JOIN neighbours b USING {using}
  WHERE (l.value >= b.x0 OR b.i = 1) AND (b.x1 IS NULL OR l.value < b.x1)),
graded AS (
  SELECT *, CASE WHEN k < 2 THEN 0 ELSE
         {rnd(f"-pow(2e0, -depth / {path_length('m')})", 10)} END AS score
  FROM placed),
scored AS (
  SELECT *, CASE WHEN k < 2 THEN 0 ELSE {rnd('score - cut', 10)} END AS decision,
         CASE WHEN k < 2 THEN false ELSE {rnd('score - cut', 10)} < 0 END AS flagged
  FROM (SELECT *, quantile_cont(score, {contamination}::DOUBLE)
                    OVER (PARTITION BY {g}) AS cut FROM graded))"""


def pct(new: str, old: str) -> str:
    return f"(CASE WHEN {old} <> 0 THEN ({new} - {old}) / {old} * 1e2 ELSE 0 END)"


def card(keys: tuple[str, ...] = ()) -> str:
    """Scorecard on top of :func:`scored`."""
    g = f"{key_list(keys)}metric"
    label = " ".join(f"WHEN metric = '{m}' THEN '{t}'" for m, t in LABELS.items())
    return f"""windows AS (
  SELECT {g}, max(n) AS n, max(k) AS k, count(*) FILTER (flagged) AS anomaly_count,
         coalesce(min(decision) FILTER (flagged), 0) AS worst,
         list_sort(list({iso('date')}) FILTER (flagged AND rn <= {LOOKBACK})) AS dates,
         sum(amount) FILTER (rn <= {LOOKBACK})::DOUBLE AS recent,
         CASE WHEN max(n) >= {2 * LOOKBACK}
              THEN sum(amount) FILTER (rn > {LOOKBACK} AND rn <= {2 * LOOKBACK})::DOUBLE
              ELSE sum(amount) FILTER (rn <= {LOOKBACK})::DOUBLE END AS prior
  FROM scored GROUP BY {g}),
changes AS (SELECT *, {pct('recent', 'prior')} AS change FROM windows),
card AS (
  SELECT {g}, CASE {label} END AS label, anomaly_count > 0 AS anomaly_detected,
         CASE WHEN k < 2 THEN 'NORMAL'
              WHEN worst < -0.15::DOUBLE OR change < -20 THEN 'CRITICAL'
              WHEN worst < -0.05::DOUBLE OR change < -10 THEN 'WARNING' ELSE 'NORMAL' END AS severity,
         {rnd('change', 2)} AS change_pct, anomaly_count,
         coalesce(array_to_string(dates, ','), '') AS anomaly_dates,
         {rnd('recent', 2)} AS recent_value, {rnd('prior', 2)} AS prior_value,
         {rnd('worst', 4)} AS if_score_worst
  FROM changes)"""


def summary(keys: tuple[str, ...] = ()) -> str:
    k = key_list(keys)
    group = f"GROUP BY {k[:-2]}" if keys else ""
    return f"""summary AS (
  SELECT {k}bool_or(anomaly_detected) AS anomaly_detected,
         CASE max(CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END)
              WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' ELSE 'NORMAL' END AS severity,
         max(change_pct) FILTER (metric = 'revenue') AS change_pct,
         max(anomaly_count) FILTER (metric = 'revenue') AS anomaly_count,
         max(anomaly_dates) FILTER (metric = 'revenue') AS anomaly_dates,
         max(recent_value) FILTER (metric = 'revenue') AS recent_revenue,
         max(prior_value) FILTER (metric = 'revenue') AS prior_revenue,
         count(*) FILTER (anomaly_detected) AS anomalous_metrics
  FROM card {group})"""


def sliced(lookback: int = LOOKBACK) -> str:
    return f"""sliced AS (
  SELECT *, date > (SELECT max(date) FROM fact) - {lookback} AS is_current
  FROM fact WHERE date > (SELECT max(date) FROM fact) - {2 * lookback})"""


def attribution(
    keys: tuple[str, ...] = (), dims: tuple[str, ...] = ATTRIBUTION_DIMENSIONS,
    min_share: float = 5.0,
) -> str:
    """Drivers through one statement per dimension and an outer join per window pair."""
    k = key_list(keys)
    join_keys = f"({k}group_value)"
    per_dim = []
    for i, d in enumerate(dims):
        side = (
            f"SELECT {k}{d} AS group_value, sum(revenue) AS {{0}} FROM sliced "
            f"WHERE {{1}} GROUP BY {k}{d}"
        )
        per_dim.append(
            f"SELECT {k}'{d}' AS dimension, {i} AS dim_order, group_value, "
            f"(coalesce(cur, 0) - coalesce(prv, 0))::DOUBLE AS delta, "
            f"coalesce(cur, 0)::DOUBLE AS cur_revenue, coalesce(prv, 0)::DOUBLE AS prv_revenue "
            f"FROM ({side.format('cur', 'is_current')}) "
            f"FULL JOIN ({side.format('prv', 'NOT is_current')}) USING {join_keys}"
        )
    union = "\n  UNION ALL ".join(per_dim)
    total_group = f"GROUP BY {k[:-2]}" if keys else ""
    join_total = f"JOIN totals USING ({k[:-2]})" if keys else "CROSS JOIN totals"
    return f"""{sliced()},
window_rows AS (
  SELECT date, region, product, category, channel, campaign, inventory_status, discount_band,
         holiday_flag, incident_flag, is_current, revenue
  FROM sliced),
totals AS (
  SELECT *, total_cur - total_prv AS total_delta FROM (
  SELECT {k}coalesce(sum(revenue) FILTER (is_current), 0)::DOUBLE AS total_cur,
         coalesce(sum(revenue) FILTER (NOT is_current), 0)::DOUBLE AS total_prv,
         count(*) FILTER (NOT is_current) AS prv_rows,
         count(*) FILTER (is_current AND incident_flag = 1)::DOUBLE AS inc_n,
         sum(revenue) FILTER (is_current AND incident_flag = 1)::DOUBLE AS inc_rev,
         count(*) FILTER (is_current AND incident_flag = 0)::DOUBLE AS calm_n,
         sum(revenue) FILTER (is_current AND incident_flag = 0)::DOUBLE AS calm_rev,
         coalesce(sum(revenue) FILTER (is_current AND holiday_flag = 1), 0)::DOUBLE
           - coalesce(sum(revenue) FILTER (NOT is_current AND holiday_flag = 1), 0)::DOUBLE
           AS holiday_delta
  FROM window_rows {total_group})),
groups AS ({union}),
exact_totals AS (
  SELECT {k}(coalesce(sum(revenue) FILTER (is_current), 0)
           - coalesce(sum(revenue) FILTER (NOT is_current), 0))::DOUBLE AS exact_delta
  FROM window_rows {total_group}),
shares AS (
  SELECT {k}dimension, dim_order, group_value, delta, cur_revenue, prv_revenue,
         CASE WHEN exact_delta <> 0 THEN delta / exact_delta * 1e2 ELSE 0 END AS share
  FROM groups {join_total.replace('totals', 'exact_totals')}),
flags AS (
  SELECT {k}'incident_flag' AS dimension, {len(dims)} AS dim_order, 'event_active' AS group_value,
         -loss AS delta, -loss / (total_cur + loss) * 1e2 AS share
  FROM (SELECT *, (calm_rev / calm_n - inc_rev / inc_n) * inc_n AS loss
        FROM totals WHERE inc_n > 0 AND calm_n > 0)
  WHERE loss >= 100 AND prv_rows > 0 AND total_delta <> 0
  UNION ALL
  SELECT {k}'holiday_flag', {len(dims) + 1}, 'event_active', holiday_delta,
         holiday_delta / total_delta * 1e2
  FROM totals WHERE abs(holiday_delta) >= 1 AND prv_rows > 0 AND total_delta <> 0),
findings AS (
  SELECT {k}dimension, dim_order, group_value, delta, share FROM shares
  UNION ALL SELECT {k}dimension, dim_order, group_value, delta, share FROM flags),
kept AS (
  SELECT {k}dimension, dim_order, group_value, {rnd('delta', 2)} AS delta, delta AS exact,
         {rnd('share', 1)} AS contribution_pct
  FROM findings WHERE abs(share) >= {min_share}),
drivers AS (
  SELECT *, row_number() OVER ({f'PARTITION BY {k[:-2]} ' if keys else ''}ORDER BY
           abs(contribution_pct) DESC, dim_order, group_value) AS rank
  FROM kept)"""


def trend(keys: tuple[str, ...] = (), horizon: int = 7) -> str:
    """Weighted line, band and horizon rows on top of ``long``."""
    g = f"{key_list(keys)}metric"
    return f"""tail AS (
  SELECT {g}, date, amount, value, rn, least(n, 60) AS n60,
         (least(n, 60) - rn)::DOUBLE AS x FROM long WHERE rn <= 60),
weighted AS (
  SELECT *, CASE WHEN n60 > 1 THEN pow(0.5::DOUBLE + 0.5::DOUBLE * x / (n60 - 1)::DOUBLE, 2)
            ELSE 1e0 END AS w FROM tail),
normal AS (
  SELECT {g}, max(n60) AS n, max(date) AS last_date, sum(w) AS s, sum(w * x) AS sx,
         sum(w * value) AS sy, sum(w * x * x) AS sxx, sum(w * x * value) AS sxy,
         CASE WHEN max(n60) >= {LOOKBACK}
              THEN sum(amount) FILTER (rn <= {LOOKBACK})::DOUBLE / {LOOKBACK}.0::DOUBLE
              ELSE max(value) FILTER (rn = 1) END AS recent_avg
  FROM weighted GROUP BY {g}),
lines AS (
  SELECT *, (sy - slope * sx) / s AS intercept FROM (
    SELECT *, CASE WHEN n > 1 THEN (s * sxy - sx * sy) / (s * sxx - sx * sx) ELSE 0 END AS slope
    FROM normal)),
fitted AS (
  SELECT t.*, l.slope, l.intercept, t.value - (l.intercept + l.slope * t.x) AS residual,
         l.intercept + l.slope * t.x AS trend
  FROM weighted t JOIN lines l USING ({g})),
model AS (
  SELECT l.*, f.resid_std FROM lines l JOIN
    (SELECT {g}, coalesce(stddev_pop(residual), 0) AS resid_std FROM fitted GROUP BY {g}) f
    USING ({g})),
ahead AS (
  SELECT m.*, step, last_date + CAST(step AS INTEGER) AS date,
         intercept + slope * (n - 1 + step)::DOUBLE AS centre
  FROM model m, range(1, {horizon + 1}) AS steps(step)),
forecast AS (
  SELECT {g}, step, date, {rnd('greatest(0, centre)', 2)} AS yhat,
         {rnd('greatest(0, centre - margin)', 2)} AS lower,
         {rnd('greatest(0, centre + margin)', 2)} AS upper, recent_avg, n
  FROM (SELECT *, CASE WHEN n < 2 THEN 0 ELSE resid_std * 1.5::DOUBLE
                  + abs(centre) * 0.05::DOUBLE END AS margin FROM ahead)),
outlook AS (
  SELECT {g}, {rnd('pct', 2)} AS forecast_pct_change,
         CASE WHEN abs(pct) <= 0.5::DOUBLE THEN 'stable' WHEN pct < 0 THEN 'decline'
              ELSE 'increase' END AS verdict
  FROM (SELECT {g}, {pct('avg_future', 'recent_avg')} AS pct FROM (
        SELECT {g}, sum(CAST(yhat AS DECIMAL(28,2)))::DOUBLE / {horizon}.0::DOUBLE AS avg_future,
               max(recent_avg) AS recent_avg FROM forecast GROUP BY {g})))"""


def evidence(keys: tuple[str, ...] = ()) -> str:
    """Confidence score on top of summary, drivers and outlook."""
    k = key_list(keys)
    group = f"GROUP BY {k[:-2]}" if keys else ""
    join = f"JOIN {{}} USING ({k[:-2]})" if keys else "CROSS JOIN {}"
    score = """least(0.95::DOUBLE, 0.5::DOUBLE
      + CASE WHEN anomaly_detected THEN 0.08::DOUBLE ELSE 0::DOUBLE END
      + CASE WHEN abs(change_pct) > 15 THEN 0.10::DOUBLE WHEN abs(change_pct) > 5
             THEN 0.05::DOUBLE ELSE 0::DOUBLE END
      + CASE WHEN anomalous_metrics >= 2 THEN 0.08::DOUBLE WHEN anomalous_metrics = 1
             THEN 0.04::DOUBLE ELSE 0::DOUBLE END
      + CASE WHEN strong_drivers >= 2 THEN 0.10::DOUBLE WHEN strong_drivers = 1
             THEN 0.05::DOUBLE ELSE 0::DOUBLE END
      + CASE WHEN forecast_pct_change * change_pct > 0 THEN 0.05::DOUBLE ELSE 0::DOUBLE END
      + CASE WHEN enterprise_signal THEN 0.04::DOUBLE ELSE 0::DOUBLE END)"""
    return f"""evidence AS (
  SELECT {k}count(*) FILTER (abs(contribution_pct) >= 10) AS strong_drivers,
         coalesce(bool_or(dimension IN ('inventory_status', 'discount_band', 'incident_flag')),
                  false) AS enterprise_signal FROM drivers {group}),
headline AS (SELECT {k}forecast_pct_change FROM outlook WHERE metric = 'revenue'),
confidence AS (
  SELECT {k}severity, change_pct, forecast_pct_change, {rnd(score, 2)} AS confidence
  FROM summary {join.format('evidence')} {join.format('headline')})"""


# Sentences, spelled out once more: driver texts on top of drivers, the rest on top of evidence.
_THOUSANDS = "format('{{:,}}', CAST(round_even({0}, 0) AS BIGINT))"
_SIZE = "format('{:,}', CAST(round_even(abs(exact), 0) AS BIGINT))"
_MOVED = "CASE WHEN exact < 0 THEN 'fell' ELSE 'rose' END"
DRIVER_TEXTS = f"""texts AS (
  SELECT rank, contribution_pct, CASE dimension
    WHEN 'incident_flag' THEN 'Incident rows earned ' || {_SIZE} || ' less than calm rows would have'
    WHEN 'holiday_flag' THEN 'Holiday revenue ' || {_MOVED} || ' by ' || {_SIZE}
    ELSE CASE dimension WHEN 'campaign' THEN 'Campaign' WHEN 'region' THEN 'Region' WHEN 'category' THEN 'Category'
      WHEN 'channel' THEN 'Channel' WHEN 'inventory_status' THEN 'Inventory Status' ELSE 'Discount Band' END
      || ' ' || group_value || ' ' || {_MOVED} || ' by ' || {_SIZE} END AS driver
  FROM drivers)"""
TEXTS = f"""{DRIVER_TEXTS},
moves AS (SELECT printf('%+.1f%%', {rnd('change', 1)}) AS change FROM changes WHERE metric = 'revenue'),
outlook_text AS (
  SELECT 'Revenue ' || CASE verdict WHEN 'stable' THEN 'should hold steady over the coming 7 days'
    WHEN 'decline' THEN 'is projected to fall ' || size || ' over the coming 7 days'
    ELSE 'is projected to rise ' || size || ' over the coming 7 days' END AS prediction
  FROM (SELECT *, printf('%.1f%%', {rnd('abs(pct)', 1)}) AS size FROM (
    SELECT verdict, {pct('avg_future', 'recent_avg')} AS pct FROM outlook o JOIN (
      SELECT metric, sum(CAST(yhat AS DECIMAL(28,2)))::DOUBLE / 7e0 AS avg_future, max(recent_avg) AS recent_avg
      FROM forecast GROUP BY metric) USING (metric) WHERE metric = 'revenue'))),
odd AS (SELECT list_sort(list(label) FILTER (anomaly_detected)) AS labels FROM card),
told AS (
  SELECT severity, change, confidence, strong_drivers, enterprise_signal, prediction, t.driver AS top_driver,
    t.contribution_pct AS top_share,
    {_THOUSANDS.format('s.recent_revenue')} || ' came in over the latest 14 days and ' || {_THOUSANDS.format('s.prior_revenue')}
    || ' over the 14 before, a change of ' || change || ' that rates as ' || lower(severity) || '. '
    || t.driver || ', the strongest of ' || strong_drivers || ' that weigh a tenth or more. '
    || CASE WHEN len(labels) > 0 THEN array_to_string(labels, ' and ') || ' had' ELSE 'No metric had' END
    || ' days out of the ordinary. ' || prediction || '.' AS narrative
  FROM confidence CROSS JOIN moves CROSS JOIN evidence CROSS JOIN outlook_text CROSS JOIN odd
    CROSS JOIN (SELECT recent_revenue, prior_revenue FROM summary) s CROSS JOIN (SELECT * FROM texts WHERE rank = 1) t)"""


def piecewise(knots: int = 8, change: float = 0.05, wave: float = 0.01, rows: int = 60) -> str:
    """Ridge regression on hinges and weekly waves on top of the series: sums, and elimination over nested lists."""
    places = [0.8 * j / knots for j in range(1, knots + 1)]
    size = 2 + knots + 6

    def terms(u: str, day: str) -> str:
        hinges = [f"greatest(0, {u} - {c!r}::DOUBLE)" for c in places]
        waves = [f"{f}(({day})::DOUBLE * {2 * k} * pi() / 7)" for k in (1, 2, 3) for f in ("cos", "sin")]
        return "[" + ", ".join(["1::DOUBLE", u, *hinges, *waves]) + "]"

    ridge = [1e-9, 1e-9, *[change] * knots, *[wave] * 6]
    matrix = ", ".join(
        "["
        + ", ".join(f"sum(t[{i + 1}] * t[{j + 1}])" + (f" + {ridge[i]!r}::DOUBLE" if i == j else "") for j in range(size))
        + f", sum(t[{i + 1}] * y)]"
        for i in range(size)
    )
    value = "scale * list_sum(list_transform(list_zip(beta, {}), lambda p: p[1] * p[2]))"
    return f"""spans AS (
  SELECT metric, count(*) AS n, min(date) AS first_date, max(date) AS last_date, max(abs(value)) AS scale,
         greatest(1, datediff('day', min(date), max(date)))::DOUBLE AS days,
         sum(amount) FILTER (rn <= {LOOKBACK})::DOUBLE / {LOOKBACK} AS recent
  FROM long WHERE rn <= {rows} GROUP BY metric),
timed AS (
  SELECT metric, date, value, scale, value / scale AS y, {terms("(datediff('day', first_date, date)::DOUBLE / days)", 'isodow(date) - 1')} AS t
  FROM long JOIN spans USING (metric) WHERE rn <= {rows}),
systems AS (SELECT metric, [{matrix}] AS m FROM timed GROUP BY metric),
solutions AS (
  SELECT metric, list_transform(list_reduce(
    list_prepend({{m: m, k: 0::BIGINT}}, list_transform(range(1, {size + 1}), lambda k: {{m: CAST([] AS DOUBLE[][]), k: k}})),
    lambda a, s: {{m: list_transform(a.m, lambda r, i: list_transform(r, lambda v, j:
        CASE WHEN i = s.k THEN v / r[s.k] ELSE v - r[s.k] * (a.m[s.k][j] / a.m[s.k][s.k]) END)), k: s.k}}).m,
    lambda r: r[-1]) AS beta
  FROM systems),
rests AS (
  SELECT metric, quantile_cont(rest, 0.1::DOUBLE) AS low, quantile_cont(rest, 0.9::DOUBLE) AS high
  FROM (SELECT metric, value - {value.format('t')} AS rest FROM timed JOIN solutions USING (metric)) GROUP BY metric),
bent AS (
  SELECT metric, step, CAST(last_date + CAST(step AS INTEGER) AS DATE) AS date, recent, low, high,
         {value.format(terms("(datediff('day', first_date, last_date + CAST(step AS INTEGER))::DOUBLE / days)",
                             'isodow(last_date + CAST(step AS INTEGER)) - 1'))} AS centre
  FROM spans JOIN solutions USING (metric) JOIN rests USING (metric) CROSS JOIN (SELECT unnest(range(1, 8)) AS step))"""
