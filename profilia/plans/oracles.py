"""DuckDB equivalents of the registered queries, put together from named parts."""

from __future__ import annotations


def r(x: str, name: str | None = None) -> str:
    return f"CASE WHEN abs({x}) < 1e6 THEN round({x}, 6) ELSE round({x}, 0) END + 0.0 AS {name or x.rpartition('.')[2]}"


A = """raw AS (SELECT 'S' || lpad(l_suppkey::VARCHAR, 6, '0') AS well_name, l_shipdate::DATE AS date, l_quantity::DOUBLE AS oil,
  l_quantity::DOUBLE * l_discount::DOUBLE * 10 AS water, l_extendedprice::DOUBLE / 1000 AS gas, l_linenumber::DOUBLE AS days_prod FROM lineitem)"""
B = """raw AS (SELECT 'P' || lpad(l_partkey::VARCHAR, 6, '0') AS well_name, l_shipdate::DATE AS date, l_quantity::DOUBLE - 2 AS oil,
  l_quantity::DOUBLE * l_discount::DOUBLE * 10 AS water, l_extendedprice::DOUBLE / 1000 AS gas,
  CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_linenumber::DOUBLE END AS days_prod FROM lineitem)"""
CUST = """raw AS (SELECT 'C' || lpad(o_custkey::VARCHAR, 6, '0') AS well_name, o_orderdate::DATE AS date,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE o_totalprice::DOUBLE / 1000 END AS oil, 0.0::DOUBLE AS water, o_totalprice::DOUBLE / 5000 AS gas,
  NULL::DOUBLE AS days_prod FROM orders JOIN customer ON o_custkey = c_custkey)"""


def grid(clamp: bool = True, calendar: bool = False) -> str:
    c = lambda x: f"CASE WHEN {x} >= 0 THEN {x} END AS {x}" if clamp else x
    days = "day(last_day(date))::DOUBLE" if calendar else "date_diff('day', (date - INTERVAL 1 MONTH)::DATE, last_day(date))::DOUBLE"
    return f"""clean AS (SELECT well_name, date_trunc('month', date)::DATE AS date, {c('oil')}, {c('water')}, {c('gas')}, {c('days_prod')} FROM raw),
sums AS (SELECT well_name, date, coalesce(sum(oil), 0) AS oil_sum, coalesce(sum(water), 0) AS water_sum, coalesce(sum(gas), 0) AS gas_sum,
  coalesce(sum(days_prod), 0) AS days_sum, count(*) FILTER (days_prod > 0) AS valid_days FROM clean GROUP BY 1, 2),
eff AS (SELECT *, CASE WHEN valid_days > 0 THEN days_sum ELSE {days} END AS days_eff FROM sums),
grid AS (SELECT *, CASE WHEN days_eff > 0 THEN oil_sum / (days_eff + 1e-9) END AS r_oil, CASE WHEN days_eff > 0 THEN water_sum / (days_eff + 1e-9) END AS r_water,
  CASE WHEN days_eff > 0 THEN gas_sum / (days_eff + 1e-9) END AS r_gas FROM eff)"""


def _savgol(c: str) -> str:
    at = lambda k: f"lag({c}, {-k}) OVER w" if k < 0 else f"lead({c}, {k}) OVER w" if k else c
    fit = lambda h, o: "(" + " + ".join(f"{x} * {at(o + j)}" for j, x in enumerate(h)) + ") / 35.0"
    return f"""greatest(0.0, CASE WHEN n < 5 THEN {c} WHEN i = 0 THEN {fit([31, 9, -3, -5, 3], 0)} WHEN i = 1 THEN {fit([9, 13, 12, 6, -5], -1)}
  WHEN i = n - 1 THEN {fit([3, -5, -3, 9, 31], -4)} WHEN i = n - 2 THEN {fit([-5, 6, 12, 13, 9], -3)} ELSE {fit([-3, 12, 17, 12, -3], -2)} END) AS {c}_s"""


def panel(raw: str, relative: float = 0.01) -> str:
    q = ", ".join(f"quantile_cont(r_{c}, 0.01) AS {c}_lo, quantile_cont(r_{c}, 0.99) AS {c}_hi" for c in ("oil", "water", "gas"))
    w = ", ".join(f"least(greatest(r_{c}, {c}_lo), {c}_hi) AS r_{c}" for c in ("oil", "water", "gas"))
    s = ", ".join(_savgol(f"r_{c}") for c in ("oil", "water", "gas"))
    return f"""{raw}, {grid()},
q AS (SELECT well_name, {q} FROM grid GROUP BY 1),
wins AS (SELECT grid.* EXCLUDE (r_oil, r_water, r_gas), {w}, row_number() OVER (PARTITION BY well_name ORDER BY date) - 1 AS i,
  count(*) OVER (PARTITION BY well_name) AS n FROM grid JOIN q USING (well_name)),
smooth AS (SELECT *, {s} FROM wins WINDOW w AS (PARTITION BY well_name ORDER BY date)),
peaks AS (SELECT *, max(r_oil_s) OVER (PARTITION BY well_name) AS peak FROM smooth),
chan AS (SELECT *, r_water_s / (r_oil_s + r_water_s + 1e-9) AS wc, r_gas_s / (r_oil_s + 1e-9) AS gor,
  r_oil_s / (CASE WHEN peak > 1e-9 THEN peak ELSE 1.0 END + 1e-9) AS r_oil_norm, r_water_s / (CASE WHEN peak > 1e-9 THEN peak ELSE 1.0 END + 1e-9) AS r_water_norm,
  r_gas_s / (CASE WHEN peak > 1e-9 THEN peak ELSE 1.0 END + 1e-9) AS r_gas_norm FROM peaks),
starts AS (SELECT *, r_oil_norm - lag(r_oil_norm) OVER (PARTITION BY well_name ORDER BY date) AS dr_oil_norm,
  min(CASE WHEN r_oil_s >= greatest(0.01, {relative} * coalesce(peak, 0)) THEN i END) OVER (PARTITION BY well_name) AS start FROM chan),
valid AS (SELECT *, count(CASE WHEN i >= start THEN r_oil_s END) OVER (PARTITION BY well_name) AS valid FROM starts),
panel AS (SELECT *, (i - start)::INT AS t FROM valid WHERE start IS NOT NULL AND valid >= 12 AND i >= start AND i < start + 70)"""


_PANEL_D = ["oil_sum", "water_sum", "gas_sum", "days_sum", "days_eff", "r_oil", "r_water", "r_gas", "r_oil_s", "r_water_s", "r_gas_s", "wc", "r_oil_norm", "r_water_norm", "r_gas_norm", "dr_oil_norm"]
PANEL_OUT = "SELECT well_name, t, date, valid_days, CASE WHEN gor < 1e4 THEN round(gor, 2) ELSE round(gor, -3) END AS gor, " + ", ".join(map(r, _PANEL_D)) + " FROM panel"
GRID_OUT = "SELECT well_name, date, valid_days, " + ", ".join(map(r, ["oil_sum", "water_sum", "gas_sum", "days_sum", "days_eff", "r_oil", "r_water", "r_gas"])) + " FROM grid"

FEATURES = ["peak_oil", "early_mean6", "early_mean12", "early_trend6", "mid_trend12", "vol_doil_w6", "vol_doil_w12", "wc_mean12", "wc_trend12", "gor_trend12", "valid_ratio"]
COUNTS = ["t_peak", "t_half", "t_20", "plateau_len"]


def _frame(f: str, y: str, win: int) -> str:
    over = f"OVER (PARTITION BY well_name ORDER BY t ROWS BETWEEN CURRENT ROW AND {win - 1} FOLLOWING)"
    body = f"regr_slope({y}, t::DOUBLE) {over}" if f == "slope" else f"stddev_pop({y}) {over}"
    return f"CASE WHEN count(*) {over} = {win} AND count({y}) {over} >= {max(2, win // 2)} THEN {body} END"


SIDE = f"""{panel(A)},
fr AS (SELECT *, max(r_oil_s) OVER (PARTITION BY well_name) AS pk, row_number() OVER (PARTITION BY well_name ORDER BY t) - 1 AS k, {_frame('slope', 'r_oil_norm', 12)} AS s_oil,
  {_frame('slope', 'wc', 12)} AS s_wc, {_frame('slope', 'gor', 12)} AS s_gor, {_frame('std', 'dr_oil_norm', 6)} AS d6, {_frame('std', 'dr_oil_norm', 12)} AS d12 FROM panel WHERE t BETWEEN 0 AND 35),
feat AS (SELECT well_name, max(r_oil_s) AS peak_oil, min(k) FILTER (r_oil_s = pk)::INT AS t_peak, min(k) FILTER (r_oil_s <= 0.5 * pk)::INT AS t_half, min(k) FILTER (r_oil_s <= 0.2 * pk)::INT AS t_20,
  avg(r_oil_norm) FILTER (k < 6) AS early_mean6, avg(r_oil_norm) FILTER (k < 12) AS early_mean12,
  CASE WHEN count(*) FILTER (k < 6) >= 3 THEN regr_slope(r_oil_norm, k::DOUBLE) FILTER (k < 6) END AS early_trend6, avg(s_oil) AS mid_trend12, avg(d6) AS vol_doil_w6, avg(d12) AS vol_doil_w12,
  avg(wc) FILTER (k < 12) AS wc_mean12, avg(s_wc) AS wc_trend12, avg(s_gor) AS gor_trend12,
  coalesce(min(k) FILTER (r_oil_norm IS NULL OR r_oil_norm < 0.9), count(*))::INT AS plateau_len, count(r_oil_s) / 36.0 AS valid_ratio FROM fr GROUP BY 1)"""

SCALED = f"""{panel(A)},
scl AS (SELECT well_name, quantile_cont(r_oil_s, 0.9) AS scale FROM panel WHERE t < 20 GROUP BY 1),
pref AS (SELECT panel.*, greatest(0.0, least(3.0, r_oil_s / (abs(scale) + 1e-9))) AS r_oil_pref_norm FROM panel LEFT JOIN scl USING (well_name))"""

FORECAST = f"""{SCALED},
whole AS (SELECT well_name FROM pref GROUP BY 1 HAVING count(r_oil_s) = 70),
x AS (SELECT well_name, list(r_oil_pref_norm ORDER BY t) AS x FROM pref JOIN whole USING (well_name) WHERE t < 20 GROUP BY 1),
y AS (SELECT well_name, list(r_oil_s ORDER BY t) AS y FROM pref JOIN whole USING (well_name) GROUP BY 1),
d AS (SELECT a.well_name AS i, b.well_name AS j, round(list_distance(a.x, b.x), 9) AS d FROM x a, x b),
near AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM d),
kept AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY rank) AS nth FROM near WHERE rank <= 16 AND d > 0),
pairs AS (SELECT i, j FROM kept WHERE nth <= 15 UNION ALL SELECT i, j FROM near WHERE rank = 1 AND i NOT IN (SELECT i FROM kept)),
sc AS (SELECT i, j, list_dot_product(a.y[1:20], b.y[1:20]) / (list_dot_product(b.y[1:20], b.y[1:20]) + 1e-9) AS s, b.y AS y FROM pairs JOIN y a ON a.well_name = i JOIN y b ON b.well_name = j),
fc AS (SELECT i AS well_name, t::INT AS t, median(s * y[t + 1]) AS y_pred FROM sc, range(20, 70) g(t) GROUP BY 1, 2),
long AS (SELECT p.well_name, p.t, p.r_oil_s AS y_true, CASE WHEN p.t < 20 THEN p.r_oil_s ELSE fc.y_pred END AS y_pred,
  CASE WHEN p.t < 20 THEN 'observed' ELSE 'forecast' END AS segment FROM pref p JOIN whole USING (well_name) LEFT JOIN fc ON fc.well_name = p.well_name AND fc.t = p.t)"""

EMB = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), dd AS (SELECT a.id AS i, b.id AS j, a.label AS li, b.label AS lj, list_distance(a.v, b.v) AS x, round(list_distance(a.v, b.v), 9) AS d FROM e a JOIN e b ON a.id <> b.id), nn AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM dd)"
LOF = f"""{EMB}, e30 AS (SELECT * FROM nn WHERE rank <= 30), kd AS (SELECT i AS j, d AS kd FROM e30 WHERE rank = 30),
lrd AS (SELECT i, 1 / (avg(greatest(kd, d)) + 1e-10) AS lrd FROM e30 JOIN kd USING (j) GROUP BY 1),
lof AS (SELECT e30.i AS id, avg(b.lrd) / any_value(a.lrd) AS lof FROM e30 JOIN lrd b ON b.i = e30.j JOIN lrd a ON a.i = e30.i GROUP BY 1),
lofs AS (SELECT id, lof, (lof - min(lof) OVER ()) / (max(lof) OVER () - min(lof) OVER () + 1e-12) AS lof_score FROM lof)"""
MED = """sums AS (SELECT i, li, sum(x) AS s FROM dd WHERE li = lj AND li >= 0 GROUP BY 1, 2),
med AS (SELECT li AS label, arg_min(i, (round(s, 9), i)) AS m FROM sums GROUP BY 1),
dm AS (SELECT e.id, list_distance(e.v, f.v) AS dist FROM e JOIN med USING (label) JOIN e f ON f.id = m),
dms AS (SELECT id, dist, (dist - min(dist) OVER ()) / (max(dist) OVER () - min(dist) OVER () + 1e-12) AS dist_medoid FROM dm)"""
SCORES = f"{LOF}, {MED}, sc AS (SELECT id, lof_score, dist_medoid, 0.5 * (lof_score + dist_medoid) AS anomaly_score FROM lofs JOIN dms USING (id))"
LABELS = "lab AS (SELECT 'S' || lpad(s_suppkey::VARCHAR, 6, '0') AS well_name, (s_nationkey % 5 - 1)::INT AS cluster, s_suppkey % 7 / 7.0 AS prob FROM supplier)"

BASE = f"""{B},
day1 AS (SELECT well_name, date, CASE WHEN oil >= 0 THEN oil END AS oil, CASE WHEN gas >= 0 THEN gas END AS gas, CASE WHEN days_prod > 0 THEN days_prod END AS days FROM raw),
day2 AS (SELECT *, oil / days AS bopd, gas / days AS mcfpd, oil AS bbl FROM day1),
tops AS (SELECT well_name, quantile_cont(bopd, 0.995) AS qb, quantile_cont(mcfpd, 0.995) AS qm, quantile_cont(bbl, 0.995) AS qo FROM day2 GROUP BY 1),
sig AS (SELECT day2.well_name, date, oil, days, CASE WHEN bopd <= qb THEN bopd END AS bopd, CASE WHEN mcfpd <= qm THEN mcfpd END AS mcfpd, CASE WHEN bbl <= qo THEN bbl END AS bbl FROM day2 JOIN tops USING (well_name)),
mon AS (SELECT well_name, last_day(date) AS date, sum(oil) AS s FROM sig GROUP BY 1, 2),
ends AS (SELECT well_name, date_trunc('month', min(date)) AS a, date_trunc('month', max(date)) AS b FROM mon GROUP BY 1),
spine AS (SELECT well_name, last_day(unnest(generate_series(a, b, INTERVAL 1 MONTH))::DATE) AS date FROM ends),
dense AS (SELECT spine.well_name, spine.date, s, row_number() OVER (PARTITION BY spine.well_name ORDER BY spine.date) - 1 AS i FROM spine LEFT JOIN mon ON mon.well_name = spine.well_name AND mon.date = spine.date),
ip AS (SELECT *, last_value(CASE WHEN s IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(s IGNORE NULLS) OVER p AS py, first_value(CASE WHEN s IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ni, first_value(s IGNORE NULLS) OVER n AS ny
  FROM dense WINDOW p AS (PARTITION BY well_name ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY well_name ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fil AS (SELECT well_name, date, i, s, coalesce(s, py + (ny - py) * (i - pi) / (ni - pi), py, ny) AS f FROM ip),
mx AS (SELECT *, max(f) OVER (PARTITION BY well_name) AS top FROM fil),
fl AS (SELECT well_name, i, (f >= 0.05 * top)::INT AS flag, min((f >= 0.05 * top)::INT) OVER w AS ok, count(f) OVER w AS k FROM mx WHERE top > 0 WINDOW w AS (PARTITION BY well_name ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
st AS (SELECT well_name, min(i) AS start FROM fl WHERE ok = 1 AND k = 2 GROUP BY 1)"""
WIDE = f"""{BASE}, tot AS (SELECT well_name FROM fil GROUP BY 1 HAVING sum(s) <> 0),
wd AS (SELECT well_name, (i - start)::INT AS t, f FROM fil JOIN st USING (well_name) JOIN tot USING (well_name) WHERE i - start BETWEEN 0 AND 11),
zz AS (SELECT *, avg(f) OVER (PARTITION BY well_name) AS m, stddev_pop(f) OVER (PARTITION BY well_name) AS sd, count(f) OVER (PARTITION BY well_name) AS n FROM wd)"""

ORACLES: dict[str, str] = {
    "monthly_rates": f"WITH {B}, {grid(False)} {GRID_OUT}",
    "monthly_rates_clamped": f"WITH {B}, {grid(True, True)} {GRID_OUT}",
    "winsorized_rates": f"WITH {panel(A)} SELECT well_name, date, {r('r_oil')}, {r('r_water')}, {r('r_gas')} FROM wins",
    "savgol_smooth": f"WITH {panel(A)} SELECT well_name, date, {r('r_oil_s')}, {r('r_water_s')}, {r('r_gas_s')} FROM smooth",
    "watercut_gor": f"WITH {panel(A)} SELECT well_name, date, {r('wc')}, {r('gor')} FROM chan",
    "panel_aligned": f"WITH {panel(A)} {PANEL_OUT}",
    "panel_aligned_ragged": f"WITH {panel(B)} {PANEL_OUT}",
    "dropped_summary": f"""WITH {panel(CUST)}, dr AS (SELECT CASE WHEN start IS NULL THEN 'no_start_detected' WHEN valid < 12 THEN 'too_short(<12)' END AS reason FROM valid WHERE i = 0)
        SELECT reason, count(*) AS count FROM dr WHERE reason IS NOT NULL GROUP BY 1""",
    "start_detection_high_thr": f"WITH {panel(A, 0.5)} SELECT well_name, start::INT AS start FROM starts WHERE i = 0",
    "profile_tensor": f"""WITH {panel(B)} SELECT w.well_name, g.t::INT AS t, {r('r_oil_norm')}, {r('wc')}, {r('dr_oil_norm')}
        FROM (SELECT DISTINCT well_name FROM panel) w CROSS JOIN range(0, 70) g(t) LEFT JOIN panel p ON p.well_name = w.well_name AND p.t = g.t""",
    "side_features": f"WITH {SIDE} SELECT well_name, {', '.join(f'{c}::DOUBLE AS {c}' for c in COUNTS)}, {', '.join(map(r, FEATURES))} FROM feat",
    "side_features_scaled": f"WITH {SIDE}, sp AS (SELECT "
    + ", ".join(f"median({c}) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_s" for c in FEATURES + COUNTS)
    + " FROM feat) SELECT well_name, "
    + ", ".join(r(f"(({c} - {c}_m) / CASE WHEN {c}_s = 0 THEN 1.0 ELSE {c}_s END)", c) for c in FEATURES + COUNTS)
    + " FROM feat, sp",
    "prefix_scaled": f"WITH {SCALED} SELECT well_name, t, {r('r_oil_pref_norm')} FROM pref",
    "prefix_features": f"""WITH {SCALED}, pf AS (SELECT *, r_oil_pref_norm - 2 * lag(r_oil_pref_norm) OVER w + lag(r_oil_pref_norm, 2) OVER w AS d2 FROM pref WHERE t < 20 WINDOW w AS (PARTITION BY well_name ORDER BY t)),
        ag AS (SELECT well_name, avg(r_oil_pref_norm) AS y_mean, stddev_pop(r_oil_pref_norm) AS y_std, regr_slope(r_oil_pref_norm, t::DOUBLE) AS y_slope, regr_intercept(r_oil_pref_norm, t::DOUBLE) AS y_intercept,
          coalesce(avg(d2), 0) AS y_curv, avg(wc) AS wc_mean, stddev_pop(wc) AS wc_std FROM pf GROUP BY 1)
        SELECT well_name, {', '.join(map(r, ['y_mean', 'y_std', 'y_slope', 'y_intercept', 'y_curv', 'wc_mean', 'wc_std']))} FROM ag""",
    "knn_edges": f"WITH {EMB} SELECT i, j, {r('d')}, rank::INT AS rank FROM nn WHERE rank <= 10",
    "knn_pairs": f"WITH {EMB} SELECT a, b, {r('d')} FROM (SELECT least(i, j) AS a, greatest(i, j) AS b, min(d) AS d FROM nn WHERE rank <= 10 GROUP BY 1, 2)",
    "knn_forecast": f"WITH {FORECAST} SELECT well_name, t, {r('y_pred')} FROM fc",
    "forecast_long": f"WITH {FORECAST} SELECT well_name, t, {r('y_true')}, {r('y_pred')}, segment FROM long",
    "forecast_wide": f"WITH {FORECAST} SELECT well_name, " + ", ".join(f"max(CASE WHEN t = {t} THEN CASE WHEN abs(y_pred) < 1e6 THEN round(y_pred, 6) ELSE round(y_pred, 0) END + 0.0 END) AS m{t}" for t in range(70)) + " FROM long GROUP BY 1",
    "forecast_metrics": f"""WITH {FORECAST}, m AS (SELECT sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse, avg(2 * abs(y_pred - y_true) / (abs(y_pred) + abs(y_true) + 1e-9)) AS smape, count(DISTINCT well_name) AS n_eval FROM long WHERE segment = 'forecast')
        SELECT {r('rmse')}, {r('smape')}, n_eval FROM m""",
    "lof_scores": f"WITH {LOF} SELECT id, {r('lof')}, {r('lof_score')} FROM lofs",
    "medoid_distance": f"WITH {EMB}, {MED} SELECT id, {r('dist')}, {r('dist_medoid')} FROM dms",
    "anomaly_scores": f"WITH {SCORES} SELECT id, {r('lof_score')}, {r('dist_medoid')}, {r('anomaly_score')} FROM sc",
    "top_anomalies": f"WITH {SCORES} SELECT id, {r('lof_score')}, {r('dist_medoid')}, {r('anomaly_score')} FROM (SELECT * FROM sc ORDER BY round(sc.anomaly_score, 9) DESC, id LIMIT 50)",
    "silhouette_by_label": f"""WITH {EMB}, av AS (SELECT i, li, lj, avg(x) AS m FROM dd GROUP BY 1, 2, 3), ab AS (SELECT i, li, max(m) FILTER (li = lj) AS a, min(m) FILTER (li <> lj) AS b FROM av GROUP BY 1, 2),
        sl AS (SELECT li AS label, avg(coalesce((b - a) / greatest(a, b), 0)) AS silhouette, count(*) AS n FROM ab GROUP BY 1) SELECT label, {r('silhouette')}, n FROM sl""",
    "mutual_reachability": f"WITH {EMB}, co AS (SELECT i, d AS core FROM nn WHERE rank = 12), mr AS (SELECT nn.i, nn.j, greatest(a.core, b.core, d) AS mr FROM nn JOIN co a ON a.i = nn.i JOIN co b ON b.i = nn.j WHERE rank <= 12) SELECT i, j, {r('mr')} FROM mr",
    "cluster_summary": f"WITH {LABELS}, cs AS (SELECT cluster, count(*) AS size, count(*) / (SELECT count(*) FROM lab)::DOUBLE AS share, median(prob)::DOUBLE AS prob_median, (SELECT avg((cluster = -1)::INT) FROM lab) AS noise_share FROM lab GROUP BY 1) SELECT cluster, size, {r('share')}, {r('prob_median')}, {r('noise_share')} FROM cs",
    "prototypes_median_iqr": f"""WITH {panel(A)}, {LABELS}, ln AS (SELECT cluster, t, 'r_oil_norm' AS channel, r_oil_norm AS y FROM panel JOIN lab USING (well_name) WHERE cluster >= 0 AND t < 36 UNION ALL SELECT cluster, t, 'wc', wc FROM panel JOIN lab USING (well_name) WHERE cluster >= 0 AND t < 36),
        pr AS (SELECT cluster, channel, t, median(y) AS value, quantile_cont(y, 0.25) AS p25, quantile_cont(y, 0.75) AS p75 FROM ln GROUP BY 1, 2, 3) SELECT cluster, channel, t, {r('value')}, {r('p25')}, {r('p75')} FROM pr""",
    "cluster_mean_bands": f"WITH {panel(A)}, {LABELS}, mb AS (SELECT cluster, t, avg(r_oil_norm) AS mean, quantile_cont(r_oil_norm, 0.1) AS p10, quantile_cont(r_oil_norm, 0.9) AS p90 FROM panel JOIN lab USING (well_name) GROUP BY 1, 2) SELECT cluster, t, {r('mean')}, {r('p10')}, {r('p90')} FROM mb",
    "clipped_signal": f"WITH {BASE}, cl AS (SELECT well_name, count(bopd) AS n_bopd, max(bopd) AS max_bopd, sum(mcfpd) AS sum_mcfpd, count(bbl) AS n_bbl FROM sig GROUP BY 1) SELECT well_name, n_bopd, {r('max_bopd')}, round(sum_mcfpd, 3) AS sum_mcfpd, n_bbl FROM cl",
    "dense_month_spine": f"WITH {BASE} SELECT well_name, date, {r('s')} FROM fil",
    "interpolated_series": f"WITH {BASE} SELECT well_name, date, i::INT AS i, {r('f')} FROM fil",
    "run_length_start": f"WITH {BASE} SELECT well_name, start::INT AS start FROM st",
    "zscored_wide": f"WITH {WIDE} SELECT well_name, t, {r('((f - m) / (sd + 1e-8))', 'z')} FROM zz WHERE n = 12",
    "slugify_names": r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(' ' || p_name || ': a/b, ' || p_name), '[\\/:*?"<>|]+', '_', 'g'), '[\s,]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part""",
    "metadata_file_names": r"""SELECT c_custkey, concat_ws('_', regexp_replace(c_name, '[\s,]+', '_', 'g'), regexp_replace(c_mktsegment, '[\s,]+', '_', 'g'), 'A_b_' || c_custkey, 'unknown',
        CASE WHEN c_custkey % 2 = 0 THEN 'x_y' ELSE 'unknown' END) AS file FROM customer""",
    "wells_by_ordinal": """WITH w AS (SELECT well_name, row_number() OVER (ORDER BY well_name) - 1 AS k FROM (SELECT DISTINCT 'P' || lpad(l_partkey::VARCHAR, 6, '0') AS well_name FROM lineitem))
        SELECT a.k AS place, a.k * 2 AS well_idx, b.well_name FROM w a LEFT JOIN w b ON b.k = a.k * 2""",
    "sanitize_names": r"""SELECT c_custkey, coalesce(nullif(trim(regexp_replace(regexp_replace(c_name || ' <x>|  ?', '[\\/:*?"<>|]+', ' ', 'g'), '\s+', ' ', 'g')), ''), 'file') AS name FROM customer""",
    "sampled_wells": f"""WITH {A}, {grid()}, drawn AS (SELECT well_name FROM (SELECT DISTINCT well_name FROM grid) ORDER BY md5('43:' || well_name), well_name LIMIT 20)
SELECT well_name, date, {r('r_oil')} FROM grid JOIN drawn USING (well_name)""",
    "producing_rows": f"WITH {B} SELECT well_name, count(*) AS n, {r('sum(oil)', 'oil')}, {r('sum(gas)', 'gas')} FROM raw WHERE oil >= 0 AND gas >= 0 AND water >= 0 GROUP BY 1",
    "resampled_sums": f"WITH {BASE} SELECT well_name, date, {r('coalesce(s, 0.0)', 's')} FROM fil",
    "monthly_means": f"WITH {B} SELECT well_name, last_day(date) AS date, {r('avg(oil)', 's')} FROM raw GROUP BY 1, 2",
    "group_names": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'group ' || c_custkey ELSE 'records ' || c_custkey || ' - 9000' END AS folder,
  CASE WHEN c_custkey % 2 = 0 THEN c_custkey::BIGINT END AS nth, c_custkey || ' a b.csv' AS file FROM customer""",
    "record_range_parse": r"""WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Group ' || c_custkey ELSE 'Records ' || c_custkey || ' to ' || (c_custkey * 2 - 40) END AS label FROM customer)
        SELECT c_custkey, CASE WHEN regexp_matches(label, '(?i)Records?\s+(\d+)\s+to\s+(\d+)') THEN greatest(1, regexp_extract(label, '(?i)Records?\s+(\d+)\s+to\s+(\d+)', 2)::BIGINT - regexp_extract(label, '(?i)Records?\s+(\d+)\s+to\s+(\d+)', 1)::BIGINT + 1) ELSE 300 END AS records,
          regexp_matches(lpad(c_custkey::VARCHAR, 5, '0') || '1 - x', '^\s*\d{6,}\s*-\s*.+') AS is_node FROM l""",
}
