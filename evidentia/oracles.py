"""SQL for DuckDB that says independently what each query of evidentia.queries returns."""

from evidentia import queries as Q
from evidentia.config import DELIVERIES, LABELS, METHODS, SIGNALS, TIERS

SQL: dict[str, str] = {}


def lit(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(lit, x)) + "]::VARCHAR[]"
    return repr(x)


def rows(name: str, columns: str, values) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(lit, v)) + ')' for v in values)})"


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


NUM = "try_cast(nullif(regexp_extract(regexp_replace({0}, '[,%]', '', 'g'), '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') AS DOUBLE)"
STATS = "coalesce(avg({x}), 0) AS avg, coalesce(max({x}), 0) AS peak, coalesce(quantile_disc({x}, 0.95), 0) AS p95, coalesce(min({x}), 0) AS least, count({x}) AS n"
signals = rows("signals", "signal_id, value_kind, criticality, defaultable, tco_critical, derivable, aliases, ord", [(*s, k) for k, s in enumerate(SIGNALS)])
methods = rows("methods", "method, cap, trust, i", [(*m, k) for k, m in enumerate(METHODS)])

SQL["series_stats"] = f"SELECT event_type, {r6('avg')} AS avg, peak, p95, least, n FROM (SELECT event_type, {STATS.format(x='value')} FROM events GROUP BY 1)"
SQL["series_nonneg_filter"] = f"""SELECT c_mktsegment, {r6('avg')} AS avg, peak, p95, least, n FROM (
SELECT c_mktsegment, {STATS.format(x='x')} FROM (SELECT c_mktsegment, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS x FROM customer) GROUP BY 1)"""
SQL["percent_scale"] = f"""WITH s AS (SELECT event_type AS header, avg(value) AS a, max(value) AS p FROM events GROUP BY 1
 UNION ALL SELECT 'discount % ' || l_returnflag, avg(l_discount), max(l_discount) FROM lineitem GROUP BY 1),
f AS (SELECT *, CASE WHEN p > 1.5 THEN 100.0 WHEN p <= 1 THEN 1.0 WHEN contains(lower(header), '%') OR contains(lower(header), 'percent') THEN 100.0 ELSE 1.0 END AS k FROM s)
SELECT header, {r6('a / k::DOUBLE')} AS avg_fraction, {r6('p / k::DOUBLE')} AS peak_fraction FROM f"""

_cells = " UNION ALL ".join(
    f"SELECT '{n}' AS source, {k} AS col_idx, '{c}' AS header, coalesce(CAST({c} AS VARCHAR), '') AS cell FROM {n}"
    for n, cols in (("events", ["ts", "user_id", "value", "event_type"]), ("orders", ["o_orderstatus", "o_totalprice", "o_orderpriority"]), ("nation", ["n_name", "n_regionkey"]))
    for k, c in enumerate(cols)
)
_facts = rf"""WITH c AS ({_cells}), facts AS (SELECT source, col_idx, header, count(*) AS n,
 avg(CASE WHEN regexp_matches(cell, '^\d{{10,13}}$') OR (regexp_matches(cell, '^\d{{4}}-\d{{2}}-\d{{2}}([T ].*)?$') AND try_cast(cell[:10] AS DATE) IS NOT NULL) THEN 1 ELSE 0 END) >= 0.8 AS is_time,
 count({NUM.format('cell')}) AS numbers,
 regexp_matches(header, '(?i)\$|cost|price|usd|amount') OR coalesce(count(*) FILTER (cell LIKE '$%') / nullif(count(*) FILTER (trim(cell) <> ''), 0) >= 0.5, FALSE) AS is_currency
 FROM c GROUP BY source, col_idx, header)"""
SQL["column_facts"] = f"{_facts} SELECT * FROM facts"
SQL["column_role"] = f"""{_facts}, p AS (SELECT source, min(col_idx) FILTER (is_time) AS time_idx, list(col_idx) FILTER (numbers > 0) AS nums, bool_or(is_currency) AS money FROM facts GROUP BY 1)
SELECT source, CASE WHEN time_idx IS NOT NULL AND len(list_filter(nums, lambda k: k <> time_idx)) > 0 THEN 'metric-time-series' WHEN money THEN 'cost-model' ELSE 'data-table' END AS role, time_idx FROM p"""
SQL["parse_numeric"] = f"""SELECT p_partkey, {NUM.format("p_size || ' units'")} AS size, {NUM.format('p_brand')} AS brand,
 {NUM.format("' 1,' || lpad(p_size::VARCHAR, 3, '0') || '% off'")} AS priced FROM part"""

_norm = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
SQL["alias_match"] = f"""WITH {signals}, h AS (SELECT ({lit(list(Q.HEADERS))})[p_partkey % {len(Q.HEADERS)} + 1] || ' ' || p_brand AS header, count(*) AS n FROM part GROUP BY 1), a AS (SELECT signal_id, value_kind, ord, unnest(aliases) AS alias FROM signals),
m AS (SELECT header, n, signal_id, value_kind, row_number() OVER (PARTITION BY header ORDER BY length(alias) DESC, ord) AS k FROM h JOIN a ON contains({_norm.format('header')}, alias))
SELECT header, signal_id, value_kind, n FROM m WHERE k = 1"""
SQL["merge_bindings"] = f"""WITH {methods}, c AS (SELECT event_type AS signal_id, value AS num, (event_id % 100) / 100 AS confidence, method, trust, 'e' || event_id AS source
 FROM events JOIN methods ON i = user_id % 8), r AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY trust DESC, confidence DESC, source) AS k FROM c)
SELECT signal_id, num, confidence, method, source FROM r WHERE k = 1"""
SQL["role_assign"] = """WITH p AS (SELECT s_nationkey AS k, max(s_acctbal) AS peak FROM supplier GROUP BY 1),
n AS (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS idx, ['Primary CPU', 'HA secondary CPU', 'panel', 'DR site'][n_nationkey % 4 + 1] AS label,
 [1, 2, 0, 3][n_nationkey % 4 + 1] AS tok, peak, coalesce(peak, -1) AS pk FROM nation LEFT JOIN p ON k = n_nationkey),
w AS (SELECT *, tok > 0 AND row_number() OVER (PARTITION BY n_regionkey, tok ORDER BY pk DESC, idx) = 1 AS won FROM n),
c AS (SELECT *, list(tok) FILTER (won) OVER (PARTITION BY n_regionkey) AS claimed, max(pk) FILTER (NOT won) OVER (PARTITION BY n_regionkey) >= 0 AS any_peak FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey, won ORDER BY CASE WHEN any_peak THEN -pk ELSE idx END, tok, idx) AS k, list_filter([1, 2, 3], lambda x: NOT list_contains(coalesce(claimed, []), x)) AS open FROM c)
SELECT n_regionkey, idx, label, peak, ['primary', 'secondary', 'dr'][CASE WHEN won THEN tok ELSE coalesce(open[k], 3) END] AS role, NOT won AS heuristic FROM k"""
SQL["tier_lookup"] = f"WITH {rows('tiers', 'tier, vcpu', TIERS)} SELECT s_suppkey, ' m' || s_suppkey % 31 * 10 || ' ' AS name, vcpu FROM supplier JOIN tiers ON 'M' || s_suppkey % 31 * 10 = tier"
SQL["tier_synthesis"] = f"""WITH {rows('tiers', 'tier, vcpu', TIERS)}, {methods}, c AS (SELECT s_nationkey AS "case", ['node.atlasTier', 'node.hoVcpu', 'node.drVcpu', 'cluster.shardCount'][s_suppkey % 4 + 1] AS signal_id,
 CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 7 + 1 END::DOUBLE AS num, CASE WHEN s_suppkey % 4 = 0 THEN 'M' || s_suppkey % 9 * 10 END AS str, (s_suppkey % 100 / 100)::DOUBLE AS confidence,
 CASE WHEN s_suppkey % 4 = 2 AND s_nationkey % 2 = 0 THEN 'keyvalue' ELSE ['llm-text', 'vision', 'vision', 'table-lookup'][s_suppkey % 4 + 1] END AS method, 's' || s_suppkey AS source FROM supplier),
top AS (SELECT c.*, row_number() OVER (PARTITION BY "case" ORDER BY trust DESC, confidence DESC, source) AS k FROM c JOIN methods USING (method) WHERE signal_id = 'node.atlasTier'),
best AS (SELECT top.*, vcpu FROM top JOIN tiers ON str = tier WHERE k = 1)
SELECT "case", signal_id, confidence, method, source, num, str FROM c WHERE NOT (signal_id IN ('node.hoVcpu', 'node.drVcpu') AND method = 'vision' AND "case" IN (SELECT "case" FROM best))
UNION ALL SELECT b."case", s, 1.0, 'table-lookup', source, vcpu, NULL FROM best AS b, (SELECT unnest(['node.hoVcpu', 'node.drVcpu']) AS s)
 WHERE NOT EXISTS (FROM c WHERE c."case" = b."case" AND c.signal_id = s AND c.method IN ('keyvalue', 'numeric-series', 'table-lookup', 'manual'))"""

_bound = f"""{signals}, {methods}, b AS (SELECT signal_id, ord, method, cap, trust, CASE WHEN n_nationkey % 6 <> 5 THEN n_nationkey::DOUBLE END AS num, (n_nationkey * 37 % 100) / 100 AS confidence, n_name
 FROM signals JOIN nation ON ord = n_nationkey JOIN methods ON i = n_nationkey % 8)"""
_cov = f"""{_bound}, cov AS (SELECT s.signal_id, s.ord, s.criticality, s.tco_critical, b.method, CASE WHEN num IS NOT NULL THEN least(confidence, cap) ELSE 0 END AS effective,
 CASE WHEN num IS NULL OR least(confidence, cap) < 0.2 THEN 'missing' WHEN least(confidence, cap) >= 0.7 THEN 'satisfied' ELSE 'partial' END AS status FROM signals s LEFT JOIN b ON s.signal_id = b.signal_id)"""
SQL["coverage"] = f"WITH {_cov} SELECT signal_id, criticality, status, effective, method FROM cov"
SQL["verdict"] = f"""WITH {_cov}, v AS (SELECT count(*) AS required_total, count(*) FILTER (status = 'satisfied') AS required_satisfied, count(*) FILTER (status = 'partial') AS required_partial,
 count(*) FILTER (status = 'missing') AS required_missing, avg(effective) AS m, bool_or(method = 'assumption-default') AS assumed, min(effective) AS least,
 string_agg(signal_id, ',' ORDER BY ord) FILTER (status = 'missing') AS gaps, string_agg(signal_id, ',' ORDER BY ord) FILTER (effective < 0.7) AS weak FROM cov WHERE criticality = 'required')
SELECT CASE WHEN required_missing > 0 THEN 'blocked' WHEN required_partial = 0 AND least >= 0.7 AND m >= 0.69 AND NOT assumed THEN 'engineering-grade' ELSE 'directional-estimate' END AS tier,
 required_total, required_satisfied, required_partial, required_missing, {r6('m')} AS mean_confidence, coalesce(CASE WHEN required_missing > 0 THEN gaps ELSE weak END, '') AS limiting FROM v"""
_labels = rows("lab", "signal_id, label", LABELS)
SQL["verdict_text"] = f"""WITH {_cov}, {_labels}, v AS (SELECT count(*) AS n, count(*) FILTER (status = 'satisfied') AS s, count(*) FILTER (status = 'missing') AS m, avg(effective) AS a,
 bool_and(status = 'satisfied') AND avg(effective) >= 0.69 AND NOT coalesce(bool_or(method = 'assumption-default'), FALSE) AS sure, list(label ORDER BY ord) FILTER (status = 'missing') AS gaps, list(label ORDER BY ord) FILTER (effective < 0.7) AS weak
 FROM cov JOIN lab USING (signal_id) WHERE criticality = 'required'),
w AS (SELECT *, CASE WHEN m > 0 THEN 'blocked' WHEN sure THEN 'engineering-grade' ELSE 'directional-estimate' END AS tier FROM v), x AS (SELECT string_agg(label, ', ' ORDER BY ord) AS c, count(*) AS k FROM cov JOIN lab USING (signal_id) WHERE criticality <> 'required' AND tco_critical AND status <> 'satisfied')
SELECT tier, CASE tier WHEN 'blocked' THEN 'Not ready: ' || m || ' of ' || n || ' required values are unknown. Ask first for: ' || array_to_string(gaps[1:2], ', ')
 WHEN 'engineering-grade' THEN 'Ready to build on: each of the ' || n || ' required values has strong evidence'
 ELSE 'A first estimate. Better evidence would firm it up, to begin with on: ' || array_to_string(weak[1:2], ', ') END AS headline,
 'Of ' || n || ' required values ' || s || ' have strong evidence, ' || (n - s - m) || ' have weak evidence and ' || m || ' none; trust is ' || printf('%.2f', a) || ' on average.'
 || CASE WHEN tier = 'directional-estimate' THEN ' The weakest: ' || array_to_string(weak, ', ') || '.' ELSE '' END
 || CASE WHEN k > 0 THEN ' The costs also hang on what nothing shows so far: ' || c || '.' ELSE '' END AS rationale FROM w, x"""
SQL["nation_verdicts"] = f"""WITH {signals}, e AS (SELECT n_nationkey, CASE WHEN ord % (n_regionkey + 1) = 0 THEN 1.0::DOUBLE - n_nationkey / 100 ELSE 0 END AS x FROM nation, signals WHERE criticality = 'required')
SELECT n_nationkey, CASE WHEN min(x) < 0.2 THEN 'blocked' WHEN min(x) >= 0.7 AND avg(x) >= 0.69 THEN 'engineering-grade' ELSE 'directional-estimate' END AS tier,
 count(*) FILTER (x >= 0.7) AS required_satisfied, count(*) FILTER (x < 0.2) AS required_missing, {r6('avg(x)')} AS mean_confidence FROM e GROUP BY 1"""
_forms = rows("forms", "method, form", DELIVERIES)
_requests = f"""{_forms}, req AS (SELECT signal_id, label || ': ' || (SELECT string_agg(form, ' or ' ORDER BY list_position(derivable, method)) FROM forms WHERE list_contains(derivable, method)) AS request,
 CASE WHEN criticality = 'required' THEN 'Without it there is no size' WHEN tco_critical THEN 'Costs hang on it' ELSE 'It makes the estimate surer' END AS why FROM signals JOIN lab USING (signal_id))"""
SQL["what_to_collect"] = f"""WITH {_cov}, {_labels}, {_requests}, w AS (SELECT signal_id, criticality, CASE WHEN status = 'missing' AND criticality = 'required' THEN 'blocking' ELSE 'upgrade' END AS severity,
 CASE WHEN status = 'missing' THEN 'missing' ELSE 'low-confidence' END AS state, effective FROM cov WHERE (criticality = 'required' OR tco_critical) AND status <> 'satisfied')
SELECT *, CAST(row_number() OVER (ORDER BY severity, effective, signal_id) AS INTEGER) AS rank FROM w JOIN req USING (signal_id)"""
SQL["gate_items"] = f"WITH {_cov} SELECT signal_id, status, effective FROM cov WHERE criticality = 'required' AND (status = 'missing' OR (status = 'partial' AND effective < 0.7))"
SQL["missing_required"] = f"WITH {_bound} SELECT signal_id FROM signals WHERE criticality = 'required' AND signal_id NOT IN (SELECT signal_id FROM b WHERE num IS NOT NULL)"
SQL["inventory"] = f"""WITH {_bound} SELECT name, ok, CASE WHEN name = 'f' THEN found ELSE '' END AS signals, CASE WHEN name = 'f' THEN 'evidence' WHEN ok THEN 'noise' ELSE 'unrecognized' END AS role
FROM (VALUES ('f', TRUE), ('g', TRUE), ('h', FALSE)) AS x(name, ok), (SELECT string_agg(signal_id, ',' ORDER BY signal_id) AS found FROM b WHERE num IS NOT NULL)"""
_answered = f"""{_bound}, {rows('ans', 'signal_id, num, avg, peak, confirmed', Q.ANSWERS)}, allb AS (
 SELECT signal_id, method, confidence, num, NULL::DOUBLE AS avg, NULL::DOUBLE AS peak, trust, 'f#' || n_name AS source FROM b WHERE num IS NOT NULL
 UNION ALL SELECT signal_id, CASE WHEN confirmed THEN 'manual' ELSE 'assumption-default' END, 1.0, num, avg, peak, CASE WHEN confirmed THEN 7 ELSE 0 END, 'gate' FROM ans),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY trust DESC, confidence DESC, source) AS k FROM allb) WHERE k = 1)"""
SQL["gate_answers"] = f"WITH {_answered} SELECT signal_id, method, confidence, num, avg FROM best"
_pick = ", ".join(f"max({p}) FILTER (signal_id = '{s}') AS {n}" for s, p, n in (
    ("cluster.shardCount", "num", "shards"), ("node.hoVcpu", "num", "ho_vcpu"), ("node.drVcpu", "num", "dr_vcpu"), ("util.primary", "avg", "primary_avg"), ("util.primary", "peak", "primary_peak"),
    ("util.hoSec", "avg", "ho_sec_avg"), ("util.hoSec", "peak", "ho_sec_peak"), ("util.dr", "avg", "dr_avg"), ("util.dr", "peak", "dr_peak"), ("data.storageSizeGb", "num", "storage_gb")))
SQL["sizing_inputs"] = f"WITH {_answered} SELECT {_pick} FROM best HAVING (SELECT count(*) FROM signals WHERE criticality = 'required' AND signal_id NOT IN (SELECT signal_id FROM best)) = 0"

_loads = """l AS (SELECT s_suppkey, (s_suppkey % 5 + 1)::DOUBLE AS shards, [2.0, 4, 8, 16, 32][s_nationkey % 5 + 1]::DOUBLE AS hv, 8.0::DOUBLE AS dv, ((s_suppkey * 7) % 50) / 100 AS pa, ((s_suppkey * 11) % 100) / 100 AS pp,
 ((s_suppkey * 3) % 40) / 100 AS ha, ((s_suppkey * 13) % 90) / 100 AS hp, (s_suppkey % 30) / 100 AS da, ((s_suppkey * 5) % 60) / 100 AS dp, s_suppkey * 100.0::DOUBLE AS gb FROM supplier),
c AS (SELECT *, shards * hv * pa AS wa, shards * hv * pp AS wp, shards * hv * pa + shards * hv * ha + shards * dv * da AS fa, shards * hv * pp + shards * hv * hp + shards * dv * dp AS fp FROM l)"""
SQL["consumed_load"] = f"""WITH {_loads} SELECT s_suppkey, {r6('wa')} AS work_avg, {r6('wp')} AS work_peak, {r6('wp / nullif(wa, 0)')} AS work_ratio, {r6('fa')} AS full_avg, {r6('fp')} AS full_peak, {r6('fp / nullif(fa, 0)')} AS full_ratio FROM c"""
SQL["sizing_scenarios"] = f"""WITH {_loads}, b AS (SELECT s_suppkey, posture, ceil(greatest(wp / n, wa))::BIGINT AS base, gb FROM c, (VALUES ('conservative', 2), ('aggressive', 3)) AS p(posture, n)),
m AS (SELECT *, floor(base * 0.0807::DOUBLE * 730.0::DOUBLE + 0.5)::BIGINT AS mc, floor(gb * 0.1156::DOUBLE + 0.5)::BIGINT AS ms FROM b)
SELECT s_suppkey, posture, base, base * 2 AS ceiling_2x, base * 3 AS ceiling_3x, mc AS monthly_compute, ms AS monthly_storage, mc + ms AS total_monthly, 12 * (mc + ms) AS total_annual FROM m"""
SQL["restore_time"] = "SELECT s_suppkey, ceil(1.0::DOUBLE + 0.2::DOUBLE * ((s_suppkey * 3) / 10)::DOUBLE)::BIGINT AS hours FROM supplier"

_costs = """y AS (SELECT year(l_shipdate) AS yr, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS a, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS n,
 coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS r, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
k AS (SELECT yr, 'license' AS component, 'baseline' AS side, a AS central FROM y UNION ALL SELECT yr, 'hardware', 'baseline', n FROM y UNION ALL SELECT yr, 'storage', 'baseline', r FROM y
 UNION ALL SELECT yr, 'proposedPrimary', 'proposed', floor(q * 0.3::DOUBLE) FROM y UNION ALL SELECT yr, 'coldDrAdd', 'proposed', floor(q * 0.05::DOUBLE) FROM y
 UNION ALL SELECT yr, 'warmDrAdd', 'proposed', floor(q * 0.15::DOUBLE) FROM y UNION ALL SELECT yr, 'migration', 'once', floor(q * 0.2::DOUBLE) FROM y),
costs AS (SELECT yr, component, side, central * 0.5::DOUBLE AS low, central, central * 2 AS high FROM k),
base AS (SELECT yr, sum(low) AS low, sum(central) AS central, sum(high) AS high FROM costs WHERE side = 'baseline' GROUP BY 1),
prop AS (SELECT yr, posture, sum(low) AS low, sum(central) AS central, sum(high) AS high FROM costs, (VALUES ('none'), ('cold'), ('warm')) AS p(posture)
 WHERE component = 'proposedPrimary' OR component = posture || 'DrAdd' GROUP BY 1, 2)"""
_five = f"""{_costs}, f AS (SELECT prop.yr, posture, y AS year, CASE WHEN y = 1 THEN base.central + prop.central + m.central ELSE prop.central END AS a, base.central AS b
 FROM prop JOIN base ON prop.yr = base.yr JOIN (SELECT * FROM costs WHERE component = 'migration') AS m ON m.yr = prop.yr, (SELECT unnest([1, 2, 3, 4, 5]) AS y) WHERE posture <> 'none'),
s AS (SELECT *, sum(a) OVER w AS cum_a, sum(b) OVER w AS cum_b FROM f WINDOW w AS (PARTITION BY yr, posture ORDER BY year))"""
SQL["baseline_total"] = f"WITH {_costs} SELECT * FROM base"
SQL["proposed_total"] = f"WITH {_costs} SELECT * FROM prop"
SQL["cost_levels"] = f"WITH {_costs} SELECT yr, component, side, level, value FROM (UNPIVOT costs ON low, central, high INTO NAME level VALUE value)"
SQL["annual_saving"] = f"WITH {_costs} SELECT prop.yr, posture, base.central - prop.central AS saving, floor(100 * (base.central - prop.central) / nullif(base.central, 0) + 0.5)::BIGINT AS saving_pct FROM prop JOIN base ON prop.yr = base.yr"
SQL["five_year"] = f"WITH {_five} SELECT yr, posture, year, a, b, cum_a, cum_b FROM s"
SQL["payback"] = f"WITH {_five} SELECT yr, posture, sum(b) - sum(a) AS net, min(year) FILTER (year > 1 AND cum_b >= cum_a) AS payback_year FROM s GROUP BY 1, 2"
SQL["crossing"] = f"""WITH {_five}, g AS (SELECT yr, posture, year, cum_b - cum_a AS d, lag(cum_b - cum_a) OVER (PARTITION BY yr, posture ORDER BY year) AS e FROM s),
h AS (SELECT *, row_number() OVER (PARTITION BY yr, posture ORDER BY year) AS k FROM g WHERE year > 1 AND d >= 0)
SELECT yr, posture, year, {r6('year - 1 + greatest(coalesce(-e / nullif(d - e, 0), 0), 0)')} AS at FROM h WHERE k = 1"""
SQL["discounted"] = f"""WITH {_costs}, p AS (SELECT *, least(greatest((yr % 4 * 50 - 25)::DOUBLE, 0), 100) AS pct FROM costs)
SELECT yr, component, side, {', '.join(f"CASE WHEN side = 'proposed' AND pct > 0 THEN {k} * (1 - pct / 100) ELSE {k} END AS {k}" for k in ('low', 'central', 'high'))} FROM p"""
SQL["cost_bars"] = f"""WITH {_costs}, b AS (SELECT yr, list_position(['license', 'hardware', 'storage'], component) AS ord, central FROM costs WHERE side = 'baseline'),
t AS (SELECT yr, floor(sum(central) / 1000 + 0.5)::BIGINT AS total_k, sum(floor(central / 1000 + 0.5)) FILTER (ord < 3)::BIGINT AS head FROM b GROUP BY 1)
SELECT yr, ord, CASE WHEN ord < 3 THEN floor(central / 1000 + 0.5)::BIGINT ELSE total_k - head END AS value_k, total_k FROM b JOIN t USING (yr)"""
SQL["chart_axes"] = f"WITH {_costs} SELECT yr, ceil((floor(central / 1000 + 0.5) + 50) / 100)::BIGINT * 100 AS max_k, ceil((central * 5 / 1000000 + 0.2::DOUBLE) * 2) / 2 AS max_m FROM base"
SQL["case_models"] = f"""WITH {_costs}, f AS (SELECT DISTINCT yr, CASE WHEN yr % 2 = 1 THEN 0.75 ELSE 1.0 END::DOUBLE AS f FROM y),
p AS (SELECT prop.yr, base.central AS onprem, max(prop.central * f) FILTER (posture = 'warm') AS warm, max(prop.central * f) FILTER (posture = 'cold') AS cold, max(prop.central) FILTER (posture = 'warm' AND f < 1) AS list_warm, any_value(m.central) AS move
 FROM prop JOIN base ON prop.yr = base.yr JOIN f ON f.yr = prop.yr JOIN (SELECT * FROM costs WHERE component = 'migration') AS m ON m.yr = prop.yr GROUP BY prop.yr, base.central),
u AS (SELECT *, (SELECT min(k) FROM (SELECT unnest([2, 3, 4, 5]) AS k) WHERE k * onprem >= onprem + move + k * warm) AS payback_warm FROM p)
SELECT yr, {r6('onprem')} AS onprem, {r6('warm')} AS warm, {r6('cold')} AS cold, {r6('list_warm')} AS list_warm, floor(100 * (onprem - warm) / nullif(onprem, 0) + 0.5)::BIGINT AS saving_warm_pct,
 {r6('5 * onprem - (onprem + move + 5 * warm)')} AS net_warm, payback_warm, {r6('onprem + move + warm')} AS transition, ceil(1.0::DOUBLE + 0.2::DOUBLE * (yr / 100)::DOUBLE)::BIGINT AS cold_hours FROM u"""
SQL["range_normalize"] = f"""WITH r AS (SELECT p_partkey AS component, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN -p_size WHEN 2 THEN p_size * 3 WHEN 3 THEN p_size * 0.5::DOUBLE ELSE p_size END AS low, p_size AS central,
 CASE p_partkey % 7 WHEN 4 THEN p_size * 1.01::DOUBLE WHEN 5 THEN p_size ELSE p_size * 2 END AS high FROM part), v AS (SELECT component, low::DOUBLE AS low, central::DOUBLE AS central, high::DOUBLE AS high,
 CASE WHEN low IS NULL OR low < 0 THEN 'low is not a number of 0 or more' WHEN central IS NULL OR central < 0 THEN 'central is not a number of 0 or more' WHEN high IS NULL OR high < 0 THEN 'high is not a number of 0 or more' END AS p FROM r),
w AS (SELECT *, p IS NULL AND central > 0 AND low <= central AND central <= high AND high - low < 0.1 * central AS pt FROM v),
x AS (SELECT component, CASE WHEN pt THEN floor(central * 0.8::DOUBLE + 0.5) ELSE low END AS low, central, CASE WHEN pt THEN floor(central * 1.2::DOUBLE + 0.5) ELSE high END AS high, p FROM w)
SELECT component, low, central, high, coalesce(p, CASE WHEN NOT (low <= central AND central <= high) THEN 'not in order' END) AS problem FROM x"""
_sources = """src AS (SELECT o_custkey AS "case", CASE WHEN o_orderkey % 5 < 2 THEN 'published' WHEN o_orderkey % 5 = 2 THEN 'synthesized' ELSE 'training-cutoff' END AS quality,
 CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '2026-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS as_of, ['license', 'hardware', 'storage', 'labor'][o_orderkey % 4 + 1] AS component,
 o_orderpriority AS label, o_orderkey AS ord FROM orders)"""
SQL["source_confidence"] = f"""WITH {_sources}, s AS (SELECT *, quality = 'training-cutoff' AS cut, quality <> 'training-cutoff' AND coalesce(date_diff('day', try_cast(as_of AS DATE), DATE '1996-03-01') > 180, FALSE) AS stale,
 CASE quality WHEN 'published' THEN 0.75 WHEN 'synthesized' THEN 0.65 ELSE 0.5 END AS b FROM src),
g AS (SELECT "case", min(CASE WHEN stale THEN least(b, 0.6) ELSE b END) AS c, bool_or(stale) AS stale, bool_and(cut) AS all_cutoff FROM s GROUP BY 1)
SELECT "case", CASE WHEN all_cutoff THEN least(c, 0.5) ELSE least(c, 0.75) END::DOUBLE AS confidence, stale, all_cutoff FROM g"""
SQL["first_source"] = f"WITH {_costs}, {_sources} SELECT component, coalesce(label, 'no source given') AS label FROM (SELECT DISTINCT component FROM costs) LEFT JOIN (SELECT component, arg_min(label, ord) AS label FROM src GROUP BY 1) USING (component)"

_claims = rows("cl", "id, section, claim, on_, lab, conf, der", Q.CLAIMS)
_resolved = f"""{_cov}, {_claims}, dep AS (SELECT id, unnest(on_) AS s, generate_subscripts(on_, 1) AS p FROM cl), mt AS (SELECT id, min(effective) AS least, string_agg(s, ', ' ORDER BY p) AS srcs FROM dep JOIN cov ON s = signal_id GROUP BY 1),
z AS (SELECT cl.*, least, srcs, len(on_) > 0 AS asked, CASE WHEN len(on_) > 0 THEN CASE WHEN least IS NULL THEN 'low' WHEN least >= 0.85 THEN 'high' WHEN least >= 0.6 THEN 'medium' ELSE 'low' END ELSE coalesce(conf, 'low') END AS base FROM cl LEFT JOIN mt USING (id)),
res AS (SELECT id, section, claim, CASE WHEN asked THEN coalesce(srcs, '(no coverage)') WHEN conf IS NOT NULL THEN lab ELSE '(unsourced)' END AS source,
 CASE WHEN der AND base = 'high' THEN 'medium' WHEN der THEN 'low' ELSE base END AS confidence FROM z)"""
SQL["claims_confidence"] = f"WITH {_resolved} SELECT * FROM res"
SQL["checklist_summary"] = f"""WITH {_resolved} SELECT count(*) AS total, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low,
 string_agg(id, ',' ORDER BY id) FILTER (confidence <> 'high') AS to_check FROM res"""
SQL["claims_merge"] = "SELECT 'c' || n_nationkey AS id, 'A' AS section, n_name AS claim FROM nation UNION ALL SELECT 'c' || c_custkey, 'B', c_name FROM customer WHERE c_custkey NOT IN (SELECT n_nationkey FROM nation)"

_uses = "u AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN length(text) ELSE 0 END AS i, CASE WHEN role <> 'user' THEN length(text) ELSE 0 END AS o FROM conversations)"
_ledger = f"{_uses}, v AS (SELECT *, (i * 3.0::DOUBLE + o * 15.0::DOUBLE) / 1000 AS cost FROM u), g AS (SELECT *, sum(i + o) OVER w AS tt, sum(cost) OVER w AS tc FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"
SQL["ledger"] = f"WITH {_ledger} SELECT conv_id, turn, i AS input_tokens, o AS output_tokens, {r6('cost')} AS cost, tt AS total_tokens, {r6('tc')} AS total_cost FROM g"
SQL["budget_guard"] = f"WITH {_ledger} SELECT conv_id, turn, CASE WHEN tt > 1500 THEN 'tokens' WHEN tc > 12.0 THEN 'cost' ELSE 'ok' END AS decision FROM g"
SQL["error_counts"] = "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1"
SQL["log_tail"] = "SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k <= 200"
SQL["version_numbers"] = "SELECT o_custkey, o_orderkey, CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS version FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)"
SQL["qual_topk"] = "SELECT role, conv_id, turn, left(text, 200) AS text FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS k FROM conversations) WHERE k <= 20"
SQL["declutter"] = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events),
p AS (SELECT user_id, event_id, k, y AS placed FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, greatest(e.y, p.placed + 12.0) FROM p JOIN e ON e.user_id = p.user_id AND e.k = p.k + 1)
SELECT user_id, event_id, {r6('placed')} AS placed FROM p"""
SQL["box_overlaps"] = """WITH b AS (SELECT p_brand AS chart, p_partkey AS idx, (p_partkey * 37 % 1000)::DOUBLE AS x, (p_partkey * 91 % 700)::DOUBLE AS y, p_size::DOUBLE AS w, 14.0 AS h FROM part)
SELECT a.chart, a.idx AS i, c.idx AS j FROM b a JOIN b c ON a.chart = c.chart AND a.idx < c.idx AND a.x < c.x + c.w + 2 AND c.x < a.x + a.w + 2 AND a.y < c.y + c.h + 2 AND c.y < a.y + a.h + 2"""


def re_all(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {to}, 'g')"


def code_free(x: str) -> str:
    for tag in ("script", "style"):
        x = re_all(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "' '")
    return re_all(x, r"(?s)<!--.*?-->", "' '")


def entities(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        x = re_all(x, f"(?i)&{name};", lit(char.replace("\\", "\\\\")))
    return x


def stripped(x: str) -> str:
    return re_all(x, "^[\\s ]+|[\\s ]+$", "''")


def collapsed(x: str) -> str:
    x = re_all(x, r"[ \t\f\v\r]+", "' '")
    return stripped(re_all(re_all(x, " *\\n *", "chr(10)"), r"\n{3,}", "chr(10) || chr(10)"))


_link = r'(?i)\b(?:href|src|data-[\w-]+)\s*=\s*"(mailto:[^"]+|https?://[^"]+|[^"\s]*@[^"\s]+)"'
_targets = f"list_transform(regexp_extract_all({code_free('html')}, {lit(_link)}, 1), lambda t: regexp_replace(t, '(?i)^mailto:', ''))"
_tagged = re_all(re_all(code_free("html"), r"(?i)<br\s*/?>", "chr(10)"), r"(?i)</(?:p|div|li|tr|h[1-6]|table|section|article|header|footer|ul|ol|blockquote)\s*>", "chr(10)")
_distinct = "list_filter(l, lambda x, i: list_position(l, x) = i)"
SQL["html_links"] = f"SELECT page_id, array_to_string({_distinct}, ' ') AS targets FROM (SELECT page_id, {_targets} AS l FROM pages)"
SQL["html_text"] = f"""SELECT page_id, CASE WHEN len(l) > 0 THEN t || chr(10) || array_to_string({_distinct}, ' ') ELSE t END AS text
FROM (SELECT page_id, {_targets} AS l, {collapsed(entities(re_all(_tagged, '<[^>]+>', "' '")))} AS t FROM pages)"""
SQL["entity_decode"] = f"SELECT page_id, {entities('html')} || ' AB&lt; <&copy;&#0; \"&gt;' AS text FROM pages"
SQL["collapse_ws"] = "SELECT doc_id, " + collapsed(re_all("text", r"\. ", "'.  ' || chr(9) || chr(10) || chr(10) || chr(10) || ' '")) + " AS text FROM documents"
SQL["noise_text"] = rf"""WITH d AS (SELECT doc_id, {stripped("CASE WHEN doc_id % 5 = 0 THEN 'Thanks, ' || text WHEN doc_id % 7 = 0 THEN '  ' WHEN doc_id % 11 = 0 THEN 'Regards, 3 shard and 4 TB storage' ELSE text END")} AS t FROM documents)
SELECT doc_id, t = '' OR (NOT (regexp_matches(t, '[0-9]') AND regexp_matches(t, '(?i)\b(shard|replica|vcpu|core|node|cpu|ram|tb|gb|iops|ops|storage|data\s*size|utiliz|backup)\b'))
 AND regexp_matches(t, '(?i)^(--|regards|sincerely|best regards|thanks|thank you|sent from my|confidential|this email|disclaimer)')) AS noise FROM d"""
SQL["role_tokens"] = "SELECT n_nationkey, ['primary', 'secondary', 'dr', NULL, 'secondary', NULL][n_nationkey % 6 + 1] AS role FROM nation"


def hits(pattern: str, group: int) -> str:
    return f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {lit(pattern)}, {group})) AS phrase FROM documents"


_stop = lit(
    "The This That These Those A An In On For And Or But Our Your We It As At By To Of If Is Are With From Per Via All Each When While Note See Table Figure Section Summary Overview".split()
)
_name = r"(?:^|[^\p{L}\p{N}_])(\p{Lu}\p{L}+(?:\s+\p{Lu}\p{L}+){1,3})"
_names = rf"nm AS (SELECT doc_id, phrase, w, CASE WHEN len(w) <= 2 THEN 'person' ELSE 'term' END AS type FROM (SELECT doc_id, phrase, regexp_split_to_array(phrase, '\s+') AS w FROM ({hits(_name, 1)})) WHERE NOT list_contains({_stop}, w[1]))"
_octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_ipv4 = rf"\b{_octet}(?:\.{_octet}){{3}}\b"
_host = r"\b[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){2,}\b"
_email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_addressed = """documents AS (SELECT doc_id, text || ' 10.' || doc_id % 256 || '.0.1 10.0.' || doc_id % 300 || '.2,10.0.0.' || doc_id % 7 || ';1.2.3.4_ 999.1.1.1 a.b.c_x -d' || doc_id % 9
 || '.e-.f.g h.' || doc_id % 5 || '.i j.k.l.m x@y.zz,p@q.org ' AS text FROM main.documents)"""
SQL["detect_emails"] = f"WITH {_addressed} SELECT doc_id, phrase, 'email' AS type, 0.95::DOUBLE AS confidence FROM ({hits(_email, 0)})"
SQL["detect_ipv4"] = f"WITH {_addressed} SELECT doc_id, phrase, 'host' AS type, 0.9::DOUBLE AS confidence FROM ({hits(_ipv4, 0)})"
SQL["detect_hosts"] = f"WITH {_addressed} SELECT doc_id, phrase, 'host' AS type, 0.8::DOUBLE AS confidence FROM ({hits(_host, 0)})"
SQL["detect_names"] = f"WITH {_addressed}, {_names} SELECT doc_id, phrase, type, 0.6::DOUBLE AS confidence FROM nm"
SQL["detect_surnames"] = f"WITH {_addressed}, {_names} SELECT DISTINCT doc_id, w[-1] AS phrase, 'person' AS type, 0.5::DOUBLE AS confidence FROM nm WHERE type = 'person' AND length(w[-1]) >= 4"
SQL["phrase_candidates"] = f"""WITH {_names}, h AS (SELECT doc_id, phrase, 'email' AS type, 0.95 AS confidence, 2 AS ord FROM ({hits(_email, 0)}) UNION ALL SELECT doc_id, phrase, 'host', 0.9, 3 FROM ({hits(_ipv4, 0)})
 UNION ALL SELECT doc_id, phrase, 'host', 0.8, 4 FROM ({hits(_host, 0)}) UNION ALL SELECT doc_id, phrase, type, 0.6, 5 FROM nm UNION ALL SELECT doc_id, w[-1], 'person', 0.5, 6 FROM nm WHERE type = 'person' AND length(w[-1]) >= 4),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(phrase) ORDER BY ord, phrase) AS k FROM h), c AS (SELECT lower(phrase) AS key, count(DISTINCT doc_id) AS texts FROM h GROUP BY 1)
SELECT phrase, type, confidence::DOUBLE AS confidence, texts FROM r JOIN c ON key = lower(phrase) WHERE k = 1"""
_supplied = "s_name || ' Supplier Key ' || s_suppkey || '.a.b Key Value'"
SQL["candidate_counts"] = f"""WITH documents AS (SELECT s_suppkey AS doc_id, {_supplied} AS text FROM supplier), {_names},
h AS (SELECT doc_id, phrase, 'host' AS type, 4 AS ord FROM ({hits(_host, 0)}) UNION ALL SELECT doc_id, phrase, type, 5 FROM nm UNION ALL SELECT doc_id, w[-1], 'person', 6 FROM nm WHERE type = 'person' AND length(w[-1]) >= 4),
c AS (SELECT phrase, type FROM (SELECT *, row_number() OVER (PARTITION BY lower(phrase) ORDER BY ord, phrase) AS k FROM h) WHERE k = 1),
o AS (SELECT phrase, type, sum((length(lower(text)) - length(replace(lower(text), lower(phrase), ''))) / length(phrase))::BIGINT AS occurrences FROM documents, c GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY occurrences DESC, length(phrase) DESC, phrase) AS rank FROM o WHERE occurrences > 0"""
SQL["replaced_in_turn"] = "SELECT doc_id, replace(replace(replace(text, 'Apache License', 'the EV_1'), 'the', 'EV_2'), 'EV', 'W') AS text FROM documents"
SQL["merge_detected"] = """WITH n AS (SELECT c_custkey % 3 AS ord, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE c_mktsegment END AS phrase, c_nationkey AS o, (c_custkey % 10) / 10 AS c FROM customer)
SELECT arg_min(phrase, (ord, phrase)) AS phrase, 'org' AS type, sum(o)::BIGINT AS occurrences, max(c) AS confidence FROM n GROUP BY lower(phrase)"""
SQL["phrase_occurrences"] = f"""WITH {rows('p', 'phrase', [(x,) for x in Q.PHRASES])} SELECT phrase, sum((length(lower(text)) - length(replace(lower(text), lower(phrase), ''))) / length(phrase))::BIGINT AS occurrences FROM documents, p GROUP BY 1"""
SQL["slug_alloc"] = """WITH n AS (SELECT n_nationkey AS ord, upper(n_name[1]) || lower(n_name[2:]) AS one, n_name, ['ORG', 'TERM', 'PERSON'][n_regionkey % 3 + 1] AS cat FROM nation),
p AS (SELECT ord, cat, array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS phrase FROM n),
k AS (SELECT phrase, CASE lower(phrase) WHEN 'france' THEN 'EV_ORG_07' WHEN 'x' THEN 'EV_ORG_03' WHEN 'peru' THEN 'EV_TERM_99' END AS known, ord, cat FROM p),
r AS (SELECT phrase, cat, row_number() OVER (PARTITION BY cat ORDER BY ord, phrase) + CASE cat WHEN 'ORG' THEN 7 WHEN 'TERM' THEN 99 ELSE 0 END AS n FROM k WHERE known IS NULL)
SELECT phrase, known AS slug FROM k WHERE known IS NOT NULL UNION ALL SELECT phrase, 'EV_' || cat || '_' || CASE WHEN n < 100 THEN lpad(n::VARCHAR, 2, '0') ELSE n::VARCHAR END FROM r"""
_ordered = sorted(Q.ENTRIES, key=lambda e: (-len(e[0]), e[0]))
_alternation = lit("|".join("\\Q" + p + "\\E" for p, _ in _ordered))
_case = "CASE m " + " ".join(f"WHEN {lit(p)} THEN {lit(s)}" for p, s in _ordered) + " END"
SQL["anonymize"] = f"""WITH s AS (SELECT doc_id, text, regexp_split_to_array(text, {_alternation}) AS g, regexp_extract_all(text, {_alternation}) AS f FROM documents)
SELECT doc_id, len(f) AS n_replaced, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(list_transform(f, lambda m: {_case})[i], '')), '') AS text FROM s"""
SQL["anonymize_round_trip"] = "SELECT doc_id, text FROM documents"
SQL["slug_conflict"] = "SELECT DISTINCT lower(left(n_name, 3)) AS slug FROM nation WHERE EXISTS (FROM documents WHERE contains(text, lower(left(n_name, 3))))"
SQL["map_round_trip"] = "SELECT n_name || chr(9) || '\\t' || chr(10) || '\\' || n_name AS phrase, 's' || chr(13) || n_nationkey AS slug FROM nation"
SQL["map_problems"] = """WITH e AS (SELECT CASE s_suppkey % 10 WHEN 0 THEN ' ' WHEN 1 THEN 'x' || s_name ELSE s_name END AS phrase,
 CASE s_suppkey % 10 WHEN 2 THEN s_name WHEN 3 THEN '' WHEN 5 THEN 'EV_' || (s_suppkey - 1) ELSE 'EV_' || s_suppkey END AS slug FROM supplier
 UNION ALL SELECT right(s_name, 6), 'IN_' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 6)
SELECT phrase, slug, 'empty' AS problem FROM e WHERE trim(phrase) = '' OR trim(slug) = '' UNION ALL SELECT phrase, slug, 'maps to itself' FROM e WHERE phrase = slug AND trim(phrase) <> ''
 UNION ALL SELECT phrase, slug, 'slug used twice' FROM e WHERE slug IN (SELECT slug FROM e GROUP BY slug HAVING count(DISTINCT phrase) > 1)
 UNION ALL SELECT phrase, slug, 'inside another phrase' FROM e WHERE phrase <> '' AND EXISTS (FROM e AS o WHERE o.phrase <> e.phrase AND contains(o.phrase, e.phrase))"""
SQL["redact_key"] = "SELECT doc_id, regexp_replace(replace(text || ' sk-abcDEF_12-3 key-' || doc_id || ' sk-ab', 'key-' || doc_id, '***'), 'sk-[A-Za-z0-9_-]{4,}', '***', 'g') AS text FROM documents"
SQL["slugs_and_escapes"] = """SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48), ''), 'case') AS slug,
 replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages"""
SQL["iso_dates"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"
SQL["type_detect"] = f"SELECT c_custkey, ({lit([x[1] for x in Q.TEXTS])})[c_custkey % {len(Q.TEXTS)} + 1] AS type FROM customer"
SQL["delimiter_detect"] = f"SELECT c_custkey, ({lit([x[2] for x in Q.TEXTS])})[c_custkey % {len(Q.TEXTS)} + 1] AS delimiter FROM customer"
SQL["text_types_of_tables"] = "SELECT 'page' AS k, page_id AS id, 'html' AS type FROM pages UNION ALL SELECT 'event', event_id, CASE WHEN json_valid(props) THEN 'json' ELSE 'text' END FROM events"

# Bindings: what each key or header stands for, the longest alias first, then the profile's order.
_kinds = f"""{signals}, al AS (SELECT signal_id, value_kind, ord, unnest(aliases) AS alias FROM signals),
kinds AS (SELECT key, arg_max({{'s': signal_id, 'k': value_kind}}, (length(alias), -ord)) AS m FROM keys JOIN al ON contains({_norm.format('key')}, alias) GROUP BY key)"""
_key = f"({lit(list(Q.KEYS))})[p_partkey % 5 + 1]"
_kept = "((m.k = 'scalar' AND num IS NOT NULL) OR (m.k = 'enum' AND str IS NOT NULL))"
_bound = "m.s AS signal_id, CASE WHEN m.k = 'scalar' THEN num END AS num, CASE WHEN m.k = 'enum' THEN str END AS str"
SQL["pair_bindings"] = f"""WITH p AS (SELECT p_partkey::VARCHAR AS source, {_key} AS key, CASE WHEN p_partkey % 4 <> 0 THEN p_size END::DOUBLE AS num, CASE WHEN p_partkey % 4 <> 0 THEN p_size || ' units' END AS str FROM part),
keys AS (SELECT DISTINCT key FROM p), {_kinds} SELECT source, {_bound}, CASE WHEN m.k = 'scalar' THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence, 'keyvalue' AS method, key AS locator FROM p JOIN kinds USING (key) WHERE {_kept}"""
SQL["wide_bindings"] = """SELECT s_nationkey::VARCHAR AS source, 'cluster.shardCount' AS signal_id, arg_min(s_suppkey % 7, s_suppkey)::DOUBLE AS num, NULL::VARCHAR AS str, 0.95::DOUBLE AS confidence, 'table-lookup' AS method, 'Number of shards' AS locator
 FROM supplier WHERE s_suppkey % 2 = 1 GROUP BY 1 UNION ALL
SELECT s_nationkey::VARCHAR, 'node.atlasTier', NULL, 'M' || arg_min(s_suppkey % 3 * 10, s_suppkey), 0.9, 'table-lookup', 'Atlas Tier' FROM supplier GROUP BY 1"""
SQL["long_bindings"] = f"""WITH p AS (SELECT p_brand AS source, {_key} AS key, p_size::DOUBLE AS num, CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE p_size::VARCHAR END AS str FROM part),
keys AS (SELECT DISTINCT key FROM p), {_kinds}, b AS (SELECT source, {_bound}, key AS locator FROM p JOIN kinds USING (key) WHERE {_kept})
SELECT source, signal_id, locator, count(*) AS n, sum(num) AS num, max(str) AS str FROM b GROUP BY 1, 2, 3"""
SQL["series_bindings"] = f"""WITH e AS (SELECT event_type AS source, unnest([{{'h': 'System CPU', 's': 'util.primary', 'x': value}}, {{'h': 'DR CPU', 's': 'util.dr', 'x': value - 50}}], recursive := true) FROM events),
g AS (SELECT source, s, h, avg(x) AS a, max(x) AS p FROM e WHERE x >= 0 GROUP BY 1, 2, 3), f AS (SELECT *, CASE WHEN p > 1.5 THEN 100.0 ELSE 1.0 END::DOUBLE AS k FROM g)
SELECT source, s AS signal_id, {r6('a / k')} AS avg, {r6('p / k')} AS peak, 0.95::DOUBLE AS confidence, 'numeric-series' AS method, h AS locator FROM f"""
_versions = "SELECT 'c-' || o_custkey AS case_id, lpad(o_orderkey::VARCHAR, 12, '0') AS version, strftime(o_orderdate, '%Y-%m-%d') AS saved_at, [o_orderpriority, o_orderstatus] AS blobs FROM orders"
SQL["archive_listing"] = f"SELECT *, row_number() OVER (ORDER BY updated_at DESC, case_id) AS rank FROM (SELECT case_id, count(*) AS versions, max(saved_at) AS updated_at FROM ({_versions}) GROUP BY 1)"
SQL["archive_blobs"] = f"SELECT case_id, version, blob, case_id || '/' || blob AS content FROM (SELECT case_id, max(version) AS version, unnest(arg_max(blobs, version)) AS blob FROM ({_versions}) GROUP BY 1)"
SQL["dollar_amounts"] = """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) * 10000 ELSE floor(o_totalprice) END AS x FROM orders)
SELECT o_orderkey, CASE WHEN x >= 1000000 THEN '$' || printf('%.2f', x / 1000000) || 'M' ELSE '$' || floor(x / 1000 + 0.5)::BIGINT || 'K' END AS amount FROM a"""
SQL["xml_text"] = f"""SELECT page_id, CASE WHEN len(l) > 0 THEN t || chr(10) || array_to_string({_distinct}, ' ') ELSE t END AS text
FROM (SELECT page_id, {_targets} AS l, {collapsed(entities(re_all(code_free('html'), '<[^>]+>', "' '")))} AS t FROM pages)"""
SQL["office_paragraphs"] = "SELECT doc_id, doc_id || ' x' || CASE WHEN text <> '' THEN chr(10) || text ELSE '' END AS text FROM documents"

SQL["values_read_outside"] = f"""WITH e AS (SELECT event_id::VARCHAR AS source, ['util.primary', 'node.hoVcpu', 'mongo.edition', 'unknown'][event_id % 4 + 1] AS signal_id, value - 20 AS n, value / 100 AS a, event_id % 110 / 100 AS p,
 CASE WHEN event_id % 3 <> 0 THEN event_type END AS s, CASE WHEN event_id % 5 = 0 THEN 0.6 ELSE least(greatest(event_id % 130 / 100 - 0.1::DOUBLE, 0), 1) END::DOUBLE AS c FROM events)
SELECT source, signal_id, CASE WHEN signal_id = 'node.hoVcpu' THEN n END AS num, CASE WHEN signal_id = 'util.primary' THEN a END AS avg, CASE WHEN signal_id = 'util.primary' THEN p END AS peak,
 CASE WHEN signal_id = 'mongo.edition' THEN s END AS str, {r6('c')} AS confidence FROM e
WHERE (signal_id = 'util.primary' AND a BETWEEN 0 AND 1 AND p BETWEEN 0 AND 1 AND a <= p) OR (signal_id = 'node.hoVcpu' AND n >= 0) OR (signal_id = 'mongo.edition' AND s IS NOT NULL)"""
SQL["researched_claims"] = """SELECT 'cost-' || p_partkey AS id, 'B' AS section, p_partkey::VARCHAR AS claim, p_brand AS declared_label,
 CASE WHEN p_partkey % 120 >= 70 THEN 'medium' ELSE 'low' END AS declared_conf, FALSE AS derived FROM part"""
SQL["unmapped_phrases"] = """SELECT upper(n_name[1]) || lower(n_name[2:]) AS phrase FROM nation WHERE n_regionkey >= 3 AND NOT contains(n_name, ' ')
 UNION ALL SELECT array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') FROM nation WHERE n_regionkey >= 3 AND contains(n_name, ' ')
 UNION ALL SELECT p_brand FROM part"""
SQL["phrase_spellings"] = """WITH n AS (SELECT 'S' || n_nationkey AS slug, lower(n_name) AS l, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS i FROM nation),
f AS (SELECT slug, unnest([l || '  Of  It', l || '  of  it', upper(l) || '  OF  IT', i || ' Of It', l || ' Of It', l || ' of it', upper(l) || ' OF IT']) AS phrase FROM n) SELECT DISTINCT phrase, slug FROM f"""
SQL["ledger_in_batches"] = SQL["ledger"]
SQL["bindings_in_batches"] = SQL["merge_bindings"]
_all_hits = f"""nm_ AS (SELECT DISTINCT doc_id, phrase, type, 0.6::DOUBLE AS confidence FROM nm) SELECT doc_id, phrase, 'email' AS type, 0.95::DOUBLE AS confidence FROM ({hits(_email, 0)})
 UNION SELECT doc_id, phrase, 'host', 0.9 FROM ({hits(_ipv4, 0)}) UNION SELECT doc_id, phrase, 'host', 0.8 FROM ({hits(_host, 0)}) UNION SELECT * FROM nm_"""
SQL["detect_in_pieces"] = f"WITH {_addressed}, {_names}, {_all_hits}"
SQL["refinement_history"] = """SELECT conv_id, string_agg(trim(left(text, 30)), ' Then: ' ORDER BY turn) AS instruction FROM conversations WHERE role = 'user' AND turn % 3 <> 0 AND trim(left(text, 30)) <> '' GROUP BY 1"""

# Documents of nations: coverage by the signals whose number the region divides, the load of the first supplier, suppliers as files.
_nation_cov = """nc AS (SELECT n_nationkey, n_regionkey, n_name, signal_id, label, ord, criticality, tco_critical, derivable, CASE WHEN ord % (n_regionkey + 1) = 0 THEN 'keyvalue' END AS method,
 CASE WHEN ord % (n_regionkey + 1) = 0 THEN 1.0::DOUBLE - n_nationkey / 100 ELSE 0 END AS effective FROM nation, signals JOIN lab USING (signal_id)),
ns AS (SELECT *, CASE WHEN effective < 0.2 THEN 'missing' WHEN effective >= 0.7 THEN 'satisfied' ELSE 'partial' END AS status FROM nc),
ask AS (SELECT n_nationkey, signal_id, CASE WHEN status = 'missing' AND criticality = 'required' THEN 'blocking' ELSE 'upgrade' END AS severity, effective, request, why,
 row_number() OVER (PARTITION BY n_nationkey ORDER BY CASE WHEN status = 'missing' AND criticality = 'required' THEN 'blocking' ELSE 'upgrade' END, effective, signal_id) AS rank
 FROM ns JOIN req USING (signal_id) WHERE (criticality = 'required' OR tco_critical) AND status <> 'satisfied'),
rq AS (SELECT n_nationkey, count(*) AS n, count(*) FILTER (status = 'satisfied') AS s, count(*) FILTER (status = 'missing') AS m, count(*) FILTER (status = 'partial') AS w, avg(effective) AS a, min(effective) AS least,
 list(label ORDER BY ord) FILTER (status = 'missing') AS gaps, list(label ORDER BY ord) FILTER (effective < 0.7) AS weak FROM ns WHERE criticality = 'required' GROUP BY 1),
tr AS (SELECT *, CASE WHEN m > 0 THEN 'blocked' WHEN w = 0 AND least >= 0.7 AND a >= 0.69 THEN 'engineering-grade' ELSE 'directional-estimate' END AS tier FROM rq),
co AS (SELECT n_nationkey, string_agg(label, ', ' ORDER BY ord) AS c FROM ns WHERE criticality <> 'required' AND tco_critical AND status <> 'satisfied' GROUP BY 1),
vt AS (SELECT n_nationkey, tier, CASE tier WHEN 'blocked' THEN 'Not ready: ' || m || ' of ' || n || ' required values are unknown. Ask first for: ' || array_to_string(gaps[1:2], ', ')
 WHEN 'engineering-grade' THEN 'Ready to build on: each of the ' || n || ' required values has strong evidence'
 ELSE 'A first estimate. Better evidence would firm it up, to begin with on: ' || array_to_string(weak[1:2], ', ') END AS headline,
 'Of ' || n || ' required values ' || s || ' have strong evidence, ' || w || ' have weak evidence and ' || m || ' none; trust is ' || printf('%.2f', a) || ' on average.'
 || CASE WHEN tier = 'directional-estimate' THEN ' The weakest: ' || array_to_string(weak, ', ') || '.' ELSE '' END
 || coalesce(' The costs also hang on what nothing shows so far: ' || c || '.', '') AS rationale FROM tr LEFT JOIN co USING (n_nationkey)),
fl AS (SELECT s_nationkey AS n_nationkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'evidence' ELSE 'noise' END AS role FROM supplier),
ld AS (SELECT f.n_nationkey, s_suppkey % 5 + 1 AS shards, [2, 4, 8, 16, 32][s_nationkey % 5 + 1] AS ho, (s_suppkey * 7) % 50 / 100 AS pa, (s_suppkey * 11) % 100 / 100 AS pp, (s_suppkey * 3) % 40 / 100 AS ha,
 (s_suppkey * 13) % 90 / 100 AS hp, s_suppkey % 30 / 100 AS da, (s_suppkey * 5) % 60 / 100 AS dp, s_suppkey * 100 AS gb
 FROM supplier JOIN (SELECT s_nationkey AS n_nationkey, min(s_suppkey) AS k FROM supplier GROUP BY 1) AS f ON f.k = s_suppkey),
cn AS (SELECT *, (shards * ho)::DOUBLE * pa AS wa, (shards * ho)::DOUBLE * pp AS wp FROM ld),
sc AS (SELECT *, ceil(greatest(wp / n, wa))::BIGINT AS base FROM cn, (VALUES (0, 'Conservative', 2), (1, 'Aggressive', 3)) AS p(i, posture, n)),
cy AS (SELECT *, 12 * floor(base * 0.0807::DOUBLE * 730.0::DOUBLE + 0.5)::BIGINT AS cc, 12 * floor(gb * 0.1156::DOUBLE + 0.5)::BIGINT AS cs FROM sc)"""
_nation = f"{signals}, {_labels}, {_requests}, {_nation_cov}"


def usd(x: str) -> str:
    return f"CASE WHEN {x} >= 1000000 THEN '$' || printf('%.2f', ({x}) / 1000000) || 'M' ELSE '$' || floor(({x}) / 1000 + 0.5)::BIGINT || 'K' END"


def esc(x: str) -> str:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = f"replace({x}, {lit(char)}, {lit(name)})"
    return x


def cells(*values: str) -> str:
    return "'<tr>' || " + " || ".join(f"'<td>' || coalesce(({v})::VARCHAR, '') || '</td>'" for v in values) + " || '</tr>'"


def heads(*names: str) -> str:
    return "'<table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>'"


def per_nation(source: str, line: str, order: str) -> str:
    return f"coalesce((SELECT string_agg({line}, '' ORDER BY {order}) FROM {source} AS r WHERE r.n_nationkey = n.n_nationkey), '')"


def passage(name: str) -> str:
    return f"'<p>{name} &lt;' || n_regionkey || '&gt;</p>'"


def page_sql(title: str, body: list[str]) -> str:
    head = f"n_name || ' — {title}'"
    start = f"""'<!doctype html><html><head><meta charset="utf-8"><title>' || {head} || '</title></head><body><h1>' || {head} || '</h1><p>2026-06-30 · draft</p>'"""
    return " || ".join([start, *body, "'</body></html>'"])


def fixed(x: str, digits: int) -> str:
    return f"coalesce(printf('%.{digits}f', floor({x} * 1e{digits} + 0.5) / 1e{digits}), '—')"


def pct_sql(x: str) -> str:
    return f"floor({x} * 100 + 0.5)::BIGINT || '%'"


_base_cells = ["posture", "base", "base * 2 || ' / ' || base * 3"]
_brief = page_sql("Sizing Brief", [
    passage("context"), "'<h2>Environment</h2>'", heads("Attribute", "Value"),
    cells("'Shards'", "c.shards"), cells("'Processors per home node'", "c.ho"), cells("'Processors per recovery node'", "CASE WHEN c.ho IS NOT NULL THEN 8 END"), cells("'Data on disk'", fixed("c.gb / 1000", 1) + " || ' TB'"), "'</table>'",
    "'<h2>Load by role</h2>'", heads("Role", "Mean", "Peak"), *[cells(f"'{n}'", pct_sql(f"c.{a}"), pct_sql(f"c.{p}")) for n, a, p in (("Primary", "pa", "pp"), ("Secondary", "ha", "hp"), ("Recovery", "da", "dp"))], "'</table>'",
    f"'<p>The peak is ' || {fixed('c.wp / nullif(c.wa, 0)', 2)} || ' times the mean of ' || {fixed('c.wa', 1)} || ': ' || {fixed('c.wp', 1)} || '</p>'", "'<h2>Approach</h2>'", passage("approach"),
    "'<h2>Scenarios</h2>'", heads("Scenario", "Base", "2x / 3x", "Compute a year", "Storage a year", "Total a year"), per_nation("cy", cells(*_base_cells, usd("cc"), usd("cs"), usd("cc + cs")), "i"), "'</table>'",
    "'<h2>Evidence</h2>'", passage("evidence"), "'<h2>Open questions</h2>'",
    f"CASE WHEN EXISTS (FROM ask WHERE ask.n_nationkey = n.n_nationkey) THEN '<ul>' || {per_nation('ask', "'<li>' || " + esc('request') + " || '</li>'", 'rank')} || '</ul>' ELSE {passage('questions')} END",
])
_file = "trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') || '.html' AS filename"
SQL["sizing_briefs"] = f"WITH {_nation} SELECT n.n_nationkey, 'sizing-brief-' || {_file}, {_brief} AS html FROM nation AS n LEFT JOIN cn AS c ON c.n_nationkey = n.n_nationkey"
_review = page_sql("Technical Review", [
    "'<h2>Rationale</h2>'", passage("notes"), "'<h2>Evidence</h2>'", f"'<p><b>' || tier || '</b> ' || {esc('headline')} || '. ' || {esc('rationale')} || '</p>'",
    "'<h3>Files</h3>'", heads("File", "Role", "Signals"), per_nation("fl", cells("s_name", "role", "''"), "s_name"), "'</table>'",
    "'<h3>Signals</h3>'", heads("Signal", "Criticality", "Status", "Confidence", "Method"), per_nation("ns", cells("signal_id", "criticality", "status", "printf('%.2f', effective)", "coalesce(method, '—')"), "ord"), "'</table>'",
    f"CASE WHEN EXISTS (FROM ask WHERE ask.n_nationkey = n.n_nationkey) THEN '<h3>To collect</h3>' || {heads('Signal', 'Severity', 'Request', 'Why')} || {per_nation('ask', cells('signal_id', 'severity', esc('request'), 'why'), 'rank')} || '</table>' ELSE '' END",
    "'<h2>Sensitivity</h2>'", heads("Posture", "Base", "2x / 3x"), per_nation("sc", cells(*_base_cells), "i"), "'</table>'",
    "'<h2>Risk</h2>'", passage("risk"), "'<h2>Data model</h2>'", passage("data_model"), "'<h2>Validation</h2>'", passage("validation"),
])
SQL["technical_reviews"] = f"WITH {_nation} SELECT n.n_nationkey, 'technical-review-' || {_file}, {_review} AS html FROM nation AS n JOIN vt ON vt.n_nationkey = n.n_nationkey"
_told = """cd AS (SELECT * FROM (VALUES ('in-shards', 'F', 'Shards', ['cluster.shardCount'], FALSE), ('in-ho-vcpu', 'F', 'Processors per home node', ['node.hoVcpu'], FALSE), ('in-dr-vcpu', 'F', 'Processors per recovery node', ['node.drVcpu'], FALSE),
 ('in-primary', 'F', 'Use of primaries, mean/peak', ['util.primary'], FALSE), ('in-ho-sec', 'F', 'Use of secondaries, mean/peak', ['util.hoSec'], FALSE), ('in-dr', 'F', 'Use in recovery, mean/peak', ['util.dr'], FALSE),
 ('base-conservative', 'C', 'Conservative base', ['util.primary', 'node.hoVcpu', 'cluster.shardCount'], TRUE), ('base-aggressive', 'C', 'Aggressive base', ['util.primary', 'node.hoVcpu', 'cluster.shardCount'], TRUE)) AS x(id, section, claim, on_, der)),
ce AS (SELECT n_nationkey, id, section, claim, on_, der, min(effective) AS e FROM (SELECT n_nationkey, id, section, claim, on_, der, unnest(on_) AS signal_id FROM cn, cd) JOIN ns USING (n_nationkey, signal_id) GROUP BY ALL),
ct AS (SELECT *, CASE WHEN e >= 0.85 THEN 'high' WHEN e >= 0.6 THEN 'medium' ELSE 'low' END AS t FROM ce),
cf AS (SELECT n_nationkey, id, section, claim, array_to_string(on_, ', ') AS source, CASE WHEN NOT der THEN t WHEN t = 'high' THEN 'medium' ELSE 'low' END AS confidence FROM ct)"""
SQL["case_claims"] = f"WITH {_nation}, {_told} SELECT * FROM cf"
SQL["case_documents"] = f"""WITH {_nation}, {_told} SELECT n.n_nationkey, n_name AS company, tier, (SELECT count(*) FROM fl WHERE fl.n_nationkey = n.n_nationkey)::INTEGER AS files, 24 AS signals,
 (SELECT count(*) FROM ask WHERE ask.n_nationkey = n.n_nationkey AND severity = 'blocking')::INTEGER AS blocking, (SELECT any_value(signal_id) FROM ask WHERE ask.n_nationkey = n.n_nationkey AND rank = 1) AS ask_first,
 (SELECT any_value(base) FROM sc WHERE sc.n_nationkey = n.n_nationkey AND i = 0) AS base, (SELECT count(*) FROM cf WHERE cf.n_nationkey = n.n_nationkey)::INTEGER AS claims,
 (SELECT count(*) FROM cf WHERE cf.n_nationkey = n.n_nationkey AND confidence = 'high')::INTEGER AS sure FROM nation AS n JOIN vt ON vt.n_nationkey = n.n_nationkey"""

_models = f"""{_costs}, f AS (SELECT DISTINCT yr, CASE WHEN yr % 2 = 1 THEN 0.75 ELSE 1.0 END::DOUBLE AS f FROM y),
mo AS (SELECT prop.yr, base.central AS onprem, max(prop.central) FILTER (posture = 'none') AS none, max(prop.central) FILTER (posture = 'warm') AS warm, max(prop.central) FILTER (posture = 'cold') AS cold, any_value(m.central) AS move, any_value(f) AS f
 FROM prop JOIN base ON prop.yr = base.yr JOIN f ON f.yr = prop.yr JOIN (SELECT * FROM costs WHERE component = 'migration') AS m ON m.yr = prop.yr GROUP BY prop.yr, base.central)"""
SQL["recovery_options"] = f"""WITH {_models} SELECT yr, 0 AS ord, 'warm' AS posture, 'Warm' AS title, warm - none AS added, warm AS total, '< 10 min' AS restore, '0 (switchover) / ≤ 1 min (failover)' AS lost, 'manual cross-region' AS failover FROM mo
 UNION ALL SELECT yr, 1, 'cold', 'Cold', cold - none, cold, '~' || ceil(1.0::DOUBLE + 0.2::DOUBLE * (yr / 100)::DOUBLE)::BIGINT || ' hrs', '~1 min', 'manual cross-region' FROM mo"""
SQL["component_labels"] = f"WITH {_costs} SELECT yr, component, CASE component WHEN 'license' THEN 'Licences' WHEN 'hardware' THEN 'Servers' WHEN 'storage' THEN 'Storage' ELSE component END AS label FROM costs"


def card_sql(title: str, total: str, restore: str, lost: str) -> str:
    return (f"'<h3>{title}</h3><ul><li>Added a year: +' || {usd(f'({total} - none) * f')} || ', in all ' || {usd(f'{total} * f')} || '</li><li>Restored in: ' || {restore} || '</li><li>Data lost: {lost}</li><li>Failover: manual cross-region</li></ul>'")


def prose_sql(name: str, tag: str = "p") -> str:
    return f"'<{tag}>{name} &amp; ' || yr || '</{tag}>'"


_hours = "'~' || ceil(1.0::DOUBLE + 0.2::DOUBLE * (yr / 100)::DOUBLE)::BIGINT || ' hrs'"
_case_html = " || ".join([
    """'<!doctype html><html><head><meta charset="utf-8"><title>Year ' || yr || ' — Business Case</title></head><body><h1>Year ' || yr || ' — Business Case</h1><p>2026-06-30 · draft</p>'""", prose_sql("summary"),
    f"'<div><b>' || {usd('onprem')} || '</b> a year today</div>'",
    f"'<div><b>' || CASE WHEN f < 1 THEN '<s>' || {usd('warm')} || '</s> ' || {usd('warm * f')} || ' (25% discount)' ELSE {usd('warm')} END || '</b> a year with warm recovery</div>'",
    "'<div><b>' || floor(100 * (onprem - warm * f) / nullif(onprem, 0) + 0.5)::BIGINT || '%</b> lower cost</div>'",
    "'<div><b>Yr ' || coalesce((SELECT min(k) FROM (SELECT unnest([2, 3, 4, 5]) AS k) WHERE k * onprem >= onprem + move + k * warm * f)::VARCHAR, '—') || '</b> payback</div>'",
    "'<h2>Comparison</h2>'", prose_sql("comparison"), "'<h2>Path</h2>'", prose_sql("path"), "'<h2>Recovery</h2>'", prose_sql("recovery"),
    card_sql("Warm", "warm", "'&lt; 10 min'", "0 (switchover) / ≤ 1 min (failover)"), card_sql("Cold", "cold", _hours, "~1 min"),
    "'<h2>Assumptions</h2>'", prose_sql("assumptions"), prose_sql("quote", "blockquote"), "'<h2>Next steps</h2>'", prose_sql("next_steps"), "'</body></html>'",
])
SQL["business_cases"] = f"WITH {_models} SELECT yr, 'business-case-year-' || yr || '.html' AS filename, {_case_html} AS html FROM mo"

_supplier_part = """sp AS (SELECT s_nationkey AS "case", 'n' || s_nationkey || '/' || s_name AS source, s_suppkey % 4 AS k, s_suppkey % 7 + 1 AS shards FROM supplier)"""
SQL["triage_bindings"] = f"""WITH {_supplier_part}, p AS (SELECT "case", arg_min(shards, source) AS shards, min(source) AS source FROM sp WHERE k = 0 GROUP BY 1)
SELECT "case", 'cluster.shardCount' AS signal_id, shards::DOUBLE AS num, NULL::VARCHAR AS str, 1.0::DOUBLE AS confidence, 'keyvalue' AS method, source FROM p
 UNION ALL SELECT "case", 'node.hoVcpu', 8, NULL, 1.0, 'keyvalue', source FROM p UNION ALL SELECT "case", 'mongo.edition', NULL, 'standard', 0.9, 'keyvalue', source FROM p"""
SQL["triage_inventory"] = f"""WITH {_supplier_part} SELECT "case", source, ['keyvalue', 'text', 'text', 'image'][k + 1] AS kind, ['topology', 'prose', 'noise', 'chart'][k + 1] AS role,
 CASE WHEN k = 0 THEN 'cluster.shardCount,mongo.edition,node.hoVcpu' ELSE '' END AS signals, k = 2 AS ignored FROM sp"""
SQL["cost_profiles"] = """SELECT s_suppkey, (s_suppkey % 5 + 1)::DOUBLE AS shards, [2, 4, 8, 16, 32][s_nationkey % 5 + 1]::DOUBLE AS ho_vcpu, 8.0::DOUBLE AS dr_vcpu, (s_suppkey * 100)::DOUBLE AS data_gb,
 ['none', 'cold', 'warm', NULL][s_suppkey % 4 + 1] AS dr_posture FROM supplier"""
SQL["profile_problems"] = """SELECT s_suppkey, [NULL, 'shards is not a positive number', 'ho_vcpu is not a positive number', 'dr_vcpu is not a number of 0 or more', 'data_gb is not a positive number', 'dr_posture is unknown', NULL][s_suppkey % 7 + 1] AS problem FROM supplier"""
SQL["source_problems"] = f"""WITH {_sources} SELECT ord, CASE WHEN ord % 13 = 0 THEN 'component is unknown' WHEN ord % 17 = 0 THEN 'quality is unknown' WHEN ord % 9 = 0 THEN 'source is empty'
 WHEN ord % 6 = 0 AND quality <> 'training-cutoff' THEN 'url is missing' WHEN try_cast(as_of AS DATE) IS NULL THEN 'as_of is no date' END AS problem FROM src"""
_said = """i AS (SELECT trim(left(text, 20), ' ') AS text, conv_id::VARCHAR AS source, ['concern', 'objection', 'joke', 'timeline', 'positioning'][turn % 5 + 1] AS category FROM conversations WHERE turn % 4 <> 3 AND turn % 5 <> 2 AND trim(left(text, 20), ' ') <> '')"""
SQL["said_items"] = f"WITH {_said} SELECT * FROM i"
SQL["said_twice"] = f"WITH {_said} SELECT source, category, text, count(*) AS n FROM (SELECT * FROM i UNION ALL SELECT * FROM i WHERE category = 'concern') GROUP BY ALL"
SQL["searchable_corpus"] = """SELECT c_name AS name, CASE c_custkey % 4 WHEN 0 THEN 'name |  | segment' || chr(10) || c_name || ' | - | ' || c_mktsegment || chr(10) || 'x | y | ' || c_custkey WHEN 1 THEN c_name || ' | ' || c_mktsegment ELSE c_mktsegment END AS text
 FROM customer WHERE c_custkey % 4 <> 3"""
SQL["company_phrases"] = """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || '  of Acme Co ' || c_name END AS company FROM customer)
SELECT c_custkey, company AS phrase, 'org' AS type, 1.0::DOUBLE AS confidence, 0 AS ord FROM c
 UNION ALL SELECT c_custkey, w, 'org', 0.9, 1 FROM (SELECT c_custkey, unnest(regexp_split_to_array(company, '\\s+')) AS w FROM c WHERE contains(company, ' ')) WHERE length(w) >= 4 AND regexp_matches(w, '^[A-Z]')"""
SQL["hidden_names"] = """WITH e AS (SELECT event_id, ts, 'file ' || event_id * 7 % 50 || '.csv' AS name, event_id % 5 <> 0 AS own FROM events),
r AS (SELECT name, row_number() OVER (ORDER BY min(ts), name) AS k FROM e WHERE own GROUP BY name), m AS (SELECT event_id, CASE WHEN own THEN 'file-' || k ELSE e.name END AS a FROM e LEFT JOIN r ON e.name = r.name)
SELECT event_id, 'cannot read ' || a || ' or ' || a AS message, 'bad: ' || a AS title FROM m"""
SQL["panel_bindings"] = f"""WITH {signals}, e AS (SELECT (event_id // 20)::VARCHAR AS source, event_id AS idx, ['Primary CPU', 'panel', 'HA secondary', 'panel', 'DR site'][event_id % 5 + 1] AS label, [1, 0, 2, 0, 3][event_id % 5 + 1] AS tok,
 ['util.primary', 'util.primary', 'util.hoSec', 'disk.iops', 'node.hoVcpu', 'none'][event_id % 6 + 1] AS signal_id, value AS num, event_id * 37 % 120 / 100 AS peak, event_id % 100 / 100 AS confidence FROM events),
g AS (SELECT e.*, value_kind, coalesce(peak, -1) AS pk FROM e JOIN signals USING (signal_id) WHERE CASE WHEN value_kind = 'avgPeak' THEN peak <= 1 ELSE num >= 0 END),
u AS (SELECT *, tok > 0 AND row_number() OVER (PARTITION BY source, tok ORDER BY pk DESC, idx) = 1 AS won FROM g WHERE signal_id LIKE 'util.%'),
c AS (SELECT *, list(tok) FILTER (won) OVER (PARTITION BY source) AS claimed FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY source, won ORDER BY -pk, tok, idx) AS k, list_filter([1, 2, 3], lambda x: NOT list_contains(coalesce(claimed, []), x)) AS open FROM c)
SELECT source, idx, ['util.primary', 'util.hoSec', 'util.dr'][CASE WHEN won THEN tok ELSE coalesce(open[k], 3) END] AS signal_id, NULL::DOUBLE AS num, {r6('peak')} AS peak, {r6('confidence')} AS confidence, NOT won AS heuristic FROM r
 UNION ALL SELECT source, idx, signal_id, CASE WHEN value_kind = 'scalar' THEN {r6('num')} END, CASE WHEN value_kind = 'avgPeak' THEN {r6('peak')} END, {r6('confidence')}, FALSE FROM g WHERE signal_id NOT LIKE 'util.%'"""

_claims_head = """'<!doctype html><html><head><meta charset="utf-8"><title>Claims &amp; sources</title></head><body><h1>Claims &amp; sources</h1>'"""
SQL["checklist_pages"] = f"""WITH {_nation}, {_told} SELECT n_nationkey, {_claims_head} || {heads('Section', 'Claim', 'Source', 'Confidence')} || string_agg({cells('section', 'claim', 'source', 'confidence')}, '' ORDER BY section, id) || '</table></body></html>' AS html
FROM cf GROUP BY n_nationkey"""
SQL["case_json"] = """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","more":{"region":' || n_regionkey || ',"names":["' || n_name || '"]}}' AS json FROM nation"""
SQL["valid_case_ids"] = "SELECT c_custkey, c_custkey % 5 > 2 AS valid FROM customer"
SQL["archived_pages"] = "SELECT page_id, strlen(html)::INTEGER AS length FROM pages WHERE strlen(html) <= 2000"
SQL["label_widths"] = f"SELECT s_suppkey, {r6('(length(s_name) + 2) * 12.5::DOUBLE * 0.6::DOUBLE')} AS width FROM supplier"
_failures = """f AS (SELECT c_name AS file, ['msg', 'unknown', 'too large', 'csv', 'csv'][c_custkey % 5 + 1] AS type, ['unsupported format; save it as .eml', 'unrecognized file type', 'over 10 bytes', 'bad header *** in it', ''][c_custkey % 5 + 1] AS message,
 ['unsupported_format', 'unsupported_format', 'too_large', 'malformed_file', ''][c_custkey % 5 + 1] AS category FROM customer WHERE c_custkey % 5 < 4)"""
SQL["failed_files"] = f"WITH {_failures} SELECT '2026-01-01' AS at, category, category || ': ' || file AS title, message, file, type FROM f"
SQL["report_texts"] = f"""WITH {_failures} SELECT '2026-01-01' AS at, '[2026-01-01] ' || upper(category) || ' - ' || category || ': ' || file || chr(10) || '  ' || message || chr(10) || '  context: file=' || file || ' type=' || type AS line FROM f"""
SQL["report_mail"] = f"""WITH {_failures}, c AS (SELECT category, count(*) AS n FROM f GROUP BY 1)
SELECT 'Files that were not read:' || chr(10) || string_agg('  - ' || n || ' x ' || category || chr(10), '' ORDER BY n DESC, category) || 'Sent by hand' AS body FROM c"""
SQL["quarantined"] = """SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'image' WHEN strlen(text) + CASE WHEN doc_id % 4 < 2 THEN 1 ELSE 0 END > 3000 THEN 'large' WHEN doc_id % 4 = 1 THEN 'not UTF-8' WHEN doc_id % 4 = 0 THEN 'binary' END AS flag FROM documents"""
SQL["role_warnings"] = """SELECT s_nationkey AS "case", count(*) || ' panel(s) had no role label; their roles were assigned by load. Check the topology.' AS warning FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 GROUP BY 1"""
SQL["extracted_files"] = f"""SELECT 'p' || page_id AS name, 'html' AS type, 'text' AS kind, text, NULL::VARCHAR AS headers, NULL::VARCHAR AS cells, NULL::VARCHAR AS error FROM ({SQL['html_text']})
 UNION ALL SELECT 'e' || event_id, CASE WHEN json_valid(props) THEN 'json' ELSE 'text' END, 'text', props, NULL, NULL, NULL FROM events
 UNION ALL SELECT 'c' || c_custkey, 'csv', 'table', NULL, 'name|segment', c_name || '|' || c_mktsegment || '|-|' || c_custkey, NULL FROM customer
 UNION ALL SELECT 'n' || n_nationkey, 'text', 'text', 'Of ' || n_name, NULL, NULL, NULL FROM nation"""
SQL["archive_commits"] = """WITH o AS (SELECT *, 'c-' || o_custkey AS case_id, lpad(o_orderkey::VARCHAR, 12, '0') AS version FROM orders),
v AS (SELECT case_id, version, CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS state FROM o WHERE (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) AND o_custkey % 5 <> 0
 UNION ALL SELECT case_id, version, 'anew' FROM o WHERE o_custkey % 10 = 0 AND o_orderkey % 7 = 0),
b AS (SELECT case_id, count(DISTINCT o_orderstatus) AS n_blobs FROM o WHERE o_custkey % 5 <> 0 GROUP BY 1)
SELECT case_id, version, state, coalesce(n_blobs, 0) AS n_blobs FROM v LEFT JOIN b USING (case_id)"""
SQL["bar_charts"] = """WITH s AS (SELECT n_regionkey, n_nationkey % 3 AS bar, n_nationkey // 3 AS ord, n_name || ' &amp; co' AS label, n_nationkey * 7 + 1 AS value FROM nation),
t AS (SELECT *, sum(value) OVER (PARTITION BY n_regionkey, bar ORDER BY ord) AS top, min(ord) OVER (PARTITION BY n_regionkey, bar) AS first, max(bar) OVER (PARTITION BY n_regionkey) + 1 AS bars FROM s),
u AS (SELECT *, 280.0::DOUBLE / max(top) OVER (PARTITION BY n_regionkey) AS scale, 560 / bars AS step FROM t)
SELECT n_regionkey, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 640 360">' || string_agg(
 '<rect x="' || printf('%.1f', 40 + step * bar) || '" y="' || printf('%.1f', 320 - top * scale) || '" width="' || printf('%.1f', step * 0.7) || '" height="' || printf('%.1f', value * scale) || '" fill="' || ['#30475e', '#7a9e9f', '#c9d6df', '#e2b33c'][ord % 4 + 1] || '"/>'
 || CASE WHEN ord = first THEN '<text x="' || printf('%.1f', 40 + step * bar) || '" y="340" font-size="12">' || label || '</text>' ELSE '' END, '' ORDER BY bar, ord) || '</svg>' AS svg FROM u GROUP BY 1"""
SQL["cells_of_tables"] = """WITH r AS (SELECT 't' || c_custkey // 20 || '#s1' AS source, (row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_custkey) - 1)::INTEGER AS row_idx, c_name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_nationkey::VARCHAR END AS nation FROM customer)
SELECT source, row_idx, 0 AS col_idx, 'name' AS header, c_name AS cell FROM r UNION ALL SELECT source, row_idx, 1, 'nation', nation FROM r"""
SQL["clamped_values"] = "SELECT event_id, least(greatest(value / 100, 0.25), 1.0)::DOUBLE AS share, event_id % 9 > 1 AS finite FROM events"
