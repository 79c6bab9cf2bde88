"""The registered queries as DuckDB SQL, for checking results.

Written independently of the Spark side: each period is summed by itself and the two are put
together by a full outer join.
"""

from __future__ import annotations

from weekpulse.queries import (
    BY_SOURCE,
    CUT,
    EARLY,
    HOURS_AHEAD,
    KNOWN_SUBSET,
    LATE,
    MONTH,
    N_TIMES,
    SELECTED,
    SPEC,
    STEP,
    SWING,
    WITHOUT_ROWS,
    ZONE,
)
from weekpulse.spec import ReportSpec

M4 = ("revenue", "notif", "exp", "install")
M5 = (*M4, "new_devices")
SOURCE_COLUMN = {
    "revenue": "revenue",
    "notif": "notification_shown",
    "exp": "experience_shown",
    "install": "install_success",
    "new_devices": "new_devices",
}
SIDES = ("today", "last_week")

# A number that is not whole or not of 32 bits is none, nor is an amount that its type cannot hold.
EVENT = """
event AS (
  SELECT * EXCLUDE (n), CASE WHEN regexp_full_match(trim(n), '[+-]?[0-9]+') THEN TRY_CAST(trim(n) AS integer) END AS k,
         TRY_CAST(value AS decimal(18,2)) AS amount
  FROM (SELECT *, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS n FROM events)
)"""
REJECTED = "CASE WHEN k IS NULL THEN 'number' WHEN event_type = 'purchase' AND value IS NOT NULL AND amount IS NULL THEN 'amount' END"
FACT = f"""{EVENT},
fact AS (
  SELECT c.c_mktsegment AS brand,
         'feature_' || CAST(e.k % 7 AS varchar) AS feature,
         CASE e.k % 3 WHEN 0 THEN 'pre-install' WHEN 1 THEN 'FOTA' ELSE 'other' END AS source,
         CAST(date_trunc('hour', e.ts) AS timestamp) AS date_hour,
         CAST(CASE WHEN e.event_type = 'purchase' THEN e.amount ELSE 0 END AS decimal(18,2)) AS revenue,
         CAST(e.event_type = 'view' AS bigint) AS notification_shown,
         CAST(e.event_type = 'click' AS bigint) AS experience_shown,
         CAST(e.event_type = 'purchase' AS bigint) AS install_success,
         CAST(e.event_type = 'signup' AS bigint) AS new_devices
  FROM event e JOIN customer c ON c.c_custkey = e.user_id
  WHERE {REJECTED} IS NULL
)"""


def _text_list(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _selection(spec: ReportSpec) -> str:
    condition = f"brand IN ({_text_list(spec.selected_brands)})"
    condition += f" AND feature IN ({_text_list(spec.selected_features)})"
    return condition + (f" AND source = '{spec.source}'" if spec.source else "")


def _inside(spec: ReportSpec, side: str) -> str:
    now = f"TIMESTAMP '{spec.as_of}'"
    if side == "today":
        return f"date_hour BETWEEN date_trunc('day', {now}) AND {now}"
    back = f"INTERVAL {spec.lookback_days} DAY"
    return (
        f"date_hour BETWEEN date_trunc('day', {now}) - {back}"
        f" AND {now} - {back} - INTERVAL {spec.lag_hours} HOUR"
    )


def _side(spec: ReportSpec, side: str, keys: list[str]) -> str:
    sums = ", ".join(f"sum({SOURCE_COLUMN[m]}) AS {m}" for m in M5)
    return f"""
{side} AS (
  SELECT {", ".join(keys)}, {sums}
  FROM (SELECT *, CAST(extract(hour FROM date_hour) AS integer) AS hour_of_day FROM fact) f
  WHERE {_selection(spec)} AND {_inside(spec, side)}
  GROUP BY {", ".join(keys)}
)"""


def _both(spec: ReportSpec, keys: list[str]) -> str:
    """CTEs up to `b`: keys and exact sums of both sides, 0 for what is missing."""
    sums = ", ".join(f"coalesce({s}.{m}, 0) AS {m}_{s}" for m in M5 for s in SIDES)
    return f"""WITH {FACT}, {_side(spec, "today", keys)}, {_side(spec, "last_week", keys)},
b AS (
  SELECT {", ".join(keys)}, {sums}
  FROM today FULL OUTER JOIN last_week USING ({", ".join(keys)})
)"""


def _type(metric: str) -> str:
    return "double" if metric == "revenue" else "bigint"


def _value(metric: str, side: str) -> str:
    return f"CAST({metric}_{side} AS {_type(metric)})"


def _change(m: str) -> str:
    diff = f"CAST({m}_today - {m}_last_week AS double)"
    return f"{diff} / nullif(CAST({m}_last_week AS double), 0) * 100"


def _rounded(m: str) -> str:
    return f"CASE WHEN {m}_last_week > 0 THEN round({_change(m)}, 1) END"


def _zero_filled(m: str) -> str:
    return f"coalesce({_change(m)}, 0)"


def _positive(m: str) -> str:
    return f"CASE WHEN {m}_last_week > 0 THEN {_change(m)} ELSE 0 END"


def _ratio(m: str) -> str:
    return f"(CAST({m}_today AS double) / nullif(CAST({m}_last_week AS double), 0) - 1) * 100"


def _sides(metrics) -> str:
    return ", ".join(f"{_value(m, s)} AS {m}_{s}" for m in metrics for s in SIDES)


def _compared(metrics, percent) -> str:
    parts = []
    for m in metrics:
        parts += [f"{_value(m, s)} AS {m}_{s}" for s in SIDES]
        parts.append(f"CAST({m}_today - {m}_last_week AS {_type(m)}) AS {m}_diff")
        parts.append(f"{percent(m)} AS {m}_pct_diff")
    return ", ".join(parts)


def _added(metrics=M5) -> str:
    return ", ".join(f"coalesce(sum({m}_{s}), 0) AS {m}_{s}" for m in metrics for s in SIDES)


BF = ["brand", "feature"]
BFH = [*BF, "hour_of_day"]


def _summary(spec: ReportSpec) -> str:
    return f"{_both(spec, BF)} SELECT brand, feature, {_compared(M4, _rounded)} FROM b"


def _rolled(keys: list[str], spec: ReportSpec = SPEC) -> str:
    """CTEs up to `r`: the brand x feature sums added up to coarser keys."""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    listed = "".join(f"{k}, " for k in keys)
    return f"{_both(spec, BFH)}, r AS (SELECT {listed}{_added()} FROM b {group})"


COMBINED = f"'Combined ({len(SPEC.selected_brands)} brands)' AS brand"


def _breakdown(key: str) -> str:
    wanted = [("revenue", "today"), ("revenue", "last_week")]
    wanted += [(m, "today") for m in ("notif", "exp", "install")]
    values = ", ".join(f"{_value(m, s)} AS {m}_{s}" for m, s in wanted)
    return f"{_rolled([key])} SELECT {key}, {values} FROM r"


def _long(key: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {key}, 'revenue_{s}' AS variable, {_value('revenue', s)} AS value FROM r"
        for s in SIDES
    )
    return f"{_rolled([key])} {rows}"


def _new_devices_hourly() -> str:
    def side(s: str) -> str:
        return (
            f"CAST(sum(CASE WHEN {_inside(SPEC, s)} THEN new_devices ELSE 0 END) AS bigint)"
            f" AS new_devices_{s}"
        )

    return f"""WITH {FACT}
SELECT CAST(extract(hour FROM date_hour) AS integer) AS hour_of_day, {side("today")}, {side("last_week")}
FROM fact
WHERE {_selection(SPEC)} AND ({_inside(SPEC, "today")} OR {_inside(SPEC, "last_week")})
GROUP BY 1"""


def _new_devices_totals() -> str:
    sums = ", ".join(
        f"coalesce(sum(CASE WHEN {_inside(SPEC, s)} THEN new_devices ELSE 0 END), 0)"
        f" AS new_devices_{s}"
        for s in SIDES
    )
    return f"""WITH {FACT}, r AS (SELECT {sums} FROM fact WHERE {_selection(SPEC)})
SELECT {_compared(["new_devices"], _positive)} FROM r"""


def _unit(name: str, units: str) -> str:
    """CTE columns of a unit value on both sides."""
    return ", ".join(
        f"CASE WHEN {units}_{s} > 0 THEN CAST(revenue_{s} AS double) / {units}_{s} ELSE 0 END"
        f" AS {name}_{s}"
        for s in SIDES
    )


def _kpis() -> str:
    """CTEs up to `k`: the row of key figures."""
    columns = [f"{_sides(M5)}"]
    columns += [f"{_positive(m)} AS {m}_delta_pct" for m in M5]
    for name in ("ecpi", "rpu"):
        columns.append(f"{name}_today, {name}_last_week, {_positive(name)} AS {name}_delta_pct")
    return f"""{_rolled([])},
u AS (SELECT *, {_unit("ecpi", "install")}, {_unit("rpu", "exp")} FROM r),
k AS (SELECT {", ".join(columns)} FROM u)"""


def _shown(value: str, pattern: str) -> str:
    return f"format('{pattern}', CAST({value} AS double))"


def _kpi_display() -> str:
    shown = [
        ("Revenue", "revenue", "${:,.2f}"),
        ("Notifications", "notif", "{:,.0f}"),
        ("Experiences", "exp", "{:,.0f}"),
        ("Installs", "install", "{:,.0f}"),
        ("New Devices", "new_devices", "{:,.0f}"),
        ("eCPI", "ecpi", "${:.3f}"),
        ("RPU", "rpu", "${:.4f}"),
    ]
    rows = " UNION ALL ".join(
        f"SELECT '{label}' AS kpi, {_shown(name + '_today', pattern)} AS value_text,"
        f" {_shown(name + '_delta_pct', '{:+.1f}%')} AS delta_text FROM k"
        for label, name, pattern in shown
    )
    return f"{_kpis()} {rows}"


def _series(cut: str, spec: ReportSpec = SPEC) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, '{label}' AS series, hour_of_day,"
        f" CAST({m}_{s} AS double) AS value FROM r WHERE {m}_{s} > 0"
        + (f" AND hour_of_day <= {cut}" if s == "today" else "")
        for m in M5
        for s, label in (("today", "Today"), ("last_week", "Last Week"))
    )
    return f"{_rolled(['hour_of_day'], spec)} {rows}"


def _zone_hour(spec: ReportSpec = SPEC) -> str:
    local = f"TIMESTAMP '{spec.as_of}' AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}'"
    return f"extract(hour FROM {local})"


PEAK = "SELECT hour_of_day, {value} FROM h ORDER BY notif_today DESC, hour_of_day LIMIT 1"
TOP = "SELECT feature, {value} FROM f ORDER BY revenue_today DESC, feature LIMIT 1"


def _insights(spec: ReportSpec = SPEC) -> str:
    signed = "CASE WHEN {c} > 0 THEN '+' ELSE '' END || format('{{:.1f}}%', {c})"
    return f"""{_rolled(["feature", "hour_of_day"], spec)},
t AS (SELECT {_added(["revenue", "new_devices"])} FROM r),
c AS (SELECT *, {_positive("revenue")} AS rc, {_positive("new_devices")} AS nc FROM t),
h AS (SELECT hour_of_day, sum(notif_today) AS notif_today FROM r GROUP BY 1),
f AS (SELECT feature, sum(revenue_today) AS revenue_today FROM r GROUP BY 1),
p AS ({PEAK.format(value="notif_today")}),
q AS ({TOP.format(value="revenue_today")})
SELECT 1 AS rank, 'revenue_swing' AS kind, CAST(revenue_today AS double) AS value,
       CAST(rc AS double) AS change_pct,
       CASE WHEN rc > 0 THEN '🔥' ELSE '⚠️' END || ' Revenue ' || {signed.format(c="rc")}
         || ' vs last week - '
         || CASE WHEN rc > 0 THEN 'Great performance!' ELSE 'Needs attention' END AS message
FROM c WHERE abs(rc) > 20
UNION ALL
SELECT 2, 'peak_hour', CAST(notif_today AS double), NULL,
       '📊 Peak hour today: ' || hour_of_day || ':00 ('
         || {_shown("notif_today", "{:,.0f}")} || ' notifications)'
FROM p
UNION ALL
SELECT 3, 'new_devices_swing', CAST(new_devices_today AS double), CAST(nc AS double),
       CASE WHEN nc > 0 THEN '📈' ELSE '📉' END || ' New Devices ' || {signed.format(c="nc")}
         || ' - ' || {_shown("new_devices_today", "{:,.0f}")} || ' today'
FROM c WHERE new_devices_today > 0 AND abs(nc) > 10
UNION ALL
SELECT 4, 'top_feature', CAST(revenue_today AS double), NULL,
       '⭐ Top feature: ' || feature || ' ($' || {_shown("revenue_today", "{:,.2f}")} || ')'
FROM q"""


def _multi_grain(spec: ReportSpec = SPEC) -> str:
    grains = [
        ("brand, feature", "brand_feature", BF),
        ("brand, NULL AS feature", "brand", ["brand"]),
        ("NULL AS brand, feature", "feature", ["feature"]),
        ("NULL AS brand, NULL AS feature", "total", []),
    ]
    rows = " UNION ALL ".join(
        f"SELECT {keys}, '{grain}' AS grain, {_sides(M4)} FROM"
        f" (SELECT {''.join(k + ', ' for k in by)}{_added(M4)} FROM b"
        f" {'GROUP BY ' + ', '.join(by) if by else ''})"
        for keys, grain, by in grains
    )
    return f"{_both(spec, BF)} {rows}"


def _grid(spec: ReportSpec = SPEC) -> str:
    def values(of: tuple[str, ...], name: str) -> str:
        return f"(SELECT unnest([{_text_list(of)}]) AS {name})"

    sums = ", ".join(f"coalesce({m}_{s}, 0) AS {m}_{s}" for m in M5 for s in SIDES)
    return f"""{_both(spec, BF)},
g AS (
  SELECT brand, feature, {sums}
  FROM (SELECT * FROM {values(spec.selected_brands, "brand")},
                      {values(spec.selected_features, "feature")}) cells
  LEFT JOIN b USING (brand, feature)
)
SELECT brand, feature, {_compared(M5, _ratio)} FROM g"""


def _with_totals() -> str:
    return f"""{_both(SPEC, BF)}, r AS (SELECT {_added(["new_devices"])} FROM b),
n AS (SELECT {_compared(["new_devices"], _positive)} FROM r)
SELECT b.brand, b.feature, {_compared(M4, _rounded)}, n.* FROM
  (SELECT * EXCLUDE (new_devices_today, new_devices_last_week) FROM b) b, n"""


def _combined_with_totals() -> str:
    return f"""{_both(SPEC, BF)}, r AS (SELECT feature, {_added()} FROM b GROUP BY feature),
d AS (SELECT {_added(["new_devices"])} FROM b),
n AS (SELECT {_compared(["new_devices"], _positive)} FROM d)
SELECT feature, {COMBINED}, {_compared(M4, _zero_filled)}, n.* FROM
  (SELECT * EXCLUDE (new_devices_today, new_devices_last_week) FROM r) r, n"""


def _shifted(spec: ReportSpec = SPEC) -> str:
    return f"""{_rolled(["hour_of_day"], spec)}
SELECT CAST((hour_of_day + {HOURS_AHEAD}) % 24 AS integer) AS hour_shifted, {_sides(["revenue"])} FROM r"""


def _pct_rules() -> str:
    m = "revenue"
    return f"""{_both(SPEC, BF)}
SELECT brand, feature, {_rounded(m)} AS pct_sql, {_zero_filled(m)} AS pct_zero_filled,
       {_positive(m)} AS pct_guarded, {_change(m)} AS pct_nonzero, {_ratio(m)} AS pct_ratio
FROM b"""


def _display() -> str:
    cells = []
    for m in M4:
        money = "${:,.2f}" if m == "revenue" else "{:,.0f}"
        cells += [
            f"coalesce({_shown(f'{m}_{x}', money)}, 'N/A') AS {m}_{x}" for x in (*SIDES, "diff")
        ]
        cells.append(f"coalesce({_shown(f'{m}_pct_diff', '{:+.1f}%')}, 'N/A') AS {m}_pct_diff")
    return f"""{_both(SPEC, BF)}, s AS (SELECT brand, feature, {_compared(M4, _rounded)} FROM b)
SELECT brand, feature, {", ".join(cells)} FROM s"""


def _rollup() -> str:
    sums = ["CAST(sum(revenue) AS double) AS revenue"]
    sums += [f"CAST(sum({SOURCE_COLUMN[m]}) AS bigint) AS {SOURCE_COLUMN[m]}" for m in M5[1:]]
    return f"""WITH {FACT}
SELECT brand, feature, date_hour, {", ".join(sums)} FROM fact GROUP BY brand, feature, date_hour"""


def _live() -> str:
    """At the newest hour of all events."""
    return _summary(SPEC).replace(f"TIMESTAMP '{SPEC.as_of}'", "(SELECT max(date_hour) FROM fact)")


def _month() -> str:
    """Each time by itself: the rows of either period by a join on its bounds."""
    seconds = int(STEP.total_seconds())
    sums = ", ".join(
        f"coalesce(sum({SOURCE_COLUMN[m]}) FILTER (side = '{s}'), 0) AS {m}_{s}" for m in M5 for s in SIDES
    )
    inside = " UNION ALL ".join(
        f"SELECT t.as_of, '{s}' AS side, f.* FROM times t JOIN fact f ON {_selection(MONTH)} AND "
        + _inside(MONTH, s).replace(f"TIMESTAMP '{MONTH.as_of}'", "t.as_of")
        for s in SIDES
    )
    return f"""WITH {FACT},
times AS (SELECT TIMESTAMP '{MONTH.as_of}' + to_seconds({seconds} * k) AS as_of FROM range({N_TIMES}) r(k)),
inside AS ({inside}),
b AS (SELECT as_of, brand, feature, {sums} FROM inside GROUP BY as_of, brand, feature)
SELECT as_of, brand, feature, {_compared(M4, _rounded)} FROM b"""


ORACLE: dict[str, str] = {
    "wow_summary": _summary(SPEC),
    "wow_summary_foj": _summary(SPEC),
    "wow_selected": _summary(SELECTED),
    "wow_by_source": _summary(BY_SOURCE),
    "wow_early_hours": _summary(EARLY),
    "new_devices_totals": _new_devices_totals(),
    "new_devices_hourly": _new_devices_hourly(),
    "hourly_cube": f"{_both(SPEC, BFH)} SELECT brand, feature, hour_of_day, {_sides(M5)} FROM b",
    "hourly_cube_foj": f"{_both(SPEC, BFH)} SELECT brand, feature, hour_of_day, {_sides(M5)} FROM b",
    "wow_combined": f"{_rolled(['feature'])}"
    f" SELECT feature, {COMBINED}, {_compared(M4, _zero_filled)} FROM r",
    "hourly_combined": f"{_rolled(['feature', 'hour_of_day'])}"
    f" SELECT feature, hour_of_day, {COMBINED}, {_sides(M4)} FROM r",
    "kpi_totals": f"{_kpis()} SELECT * FROM k",
    "kpi_display": _kpi_display(),
    "by_brand": _breakdown("brand"),
    "by_feature": _breakdown("feature"),
    "by_brand_long": _long("brand"),
    "by_feature_long": _long("feature"),
    "hourly_series": _series(str(SPEC.today_cut_hour)),
    "hourly_series_tz": _series(_zone_hour()),
    "hourly_shifted": _shifted(),
    "peak_hour": f"{_rolled(['hour_of_day'])}, h AS (SELECT * FROM r) "
    + PEAK.format(value="CAST(notif_today AS bigint) AS notif_today"),
    "top_feature": f"{_rolled(['feature'])}, f AS (SELECT * FROM r) "
    + TOP.format(value="CAST(revenue_today AS double) AS revenue_today"),
    "insights": _insights(),
    "data_summary": f"{_both(SPEC, BF)} SELECT count(*) AS n_rows,"
    " count(DISTINCT brand) AS n_brands, count(DISTINCT feature) AS n_features FROM b",
    "dimension_values": f"{_both(SPEC, BF)} SELECT DISTINCT 'brand' AS dim, brand AS value FROM b"
    " UNION ALL SELECT DISTINCT 'feature', feature FROM b",
    "multi_grain": _multi_grain(),
    "grid_wow": _grid(),
    "wow_with_totals": _with_totals(),
    "pct_rules": _pct_rules(),
    "display_table": _display(),
    "export_roundtrip": _summary(SPEC),
    "hourly_rollup_stream": _rollup(),
    "wow_combined_with_totals": _combined_with_totals(),
    "hourly_series_cut": _series(str(CUT.cut_hour), CUT),
    "hourly_series_tz_wrap": _series(_zone_hour(LATE), LATE),
    "hourly_shifted_wrap": _shifted(LATE),
    "grid_early": _grid(EARLY),
    "insights_swing": _insights(SWING),
    "wow_known_subset": _summary(KNOWN_SUBSET),
    "multi_grain_empty": _multi_grain(WITHOUT_ROWS),
    "rejected_events": f"WITH {EVENT} SELECT coalesce({REJECTED}, 'counted') AS outcome, count(*) AS n FROM event GROUP BY 1",
    "wow_summary_by_day": _summary(SPEC),
    "wow_selected_clustered": _summary(SELECTED),
    "wow_summary_bucketed": _summary(SPEC),
    "wow_summary_from_rollup": _summary(SPEC),
    "wow_summary_replayed": _summary(SPEC),
    "wow_summary_live": _live(),
    "wow_summary_refreshed": _summary(SPEC),
    "wow_summaries_month": _month(),
}
