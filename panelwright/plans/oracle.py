"""The registered queries as plain SQL over the order tables, written apart from the operators."""

from panelwright.operators.features import FEATURES
from panelwright.plans.catalog import EVALUATED_BACK, INNER_FIRST, INNER_LAST, SINCE, SPLITS_BACK

LAST = "(SELECT max(q) FROM panel)"
EVALUATED = f"({LAST} - {EVALUATED_BACK})"


def quarter(day: str) -> str:
    return f"((year({day}) + CASE WHEN month({day}) >= 10 THEN 1 ELSE 0 END) * 4 + ((month({day}) + 2) % 12) // 3)"


def label(index: str) -> str:
    return f"('FY' || CAST(({index}) // 4 AS VARCHAR) || '_Q' || CAST(({index}) % 4 + 1 AS VARCHAR))"


def name(value: str) -> str:
    upper = f"upper(trim(regexp_replace({value}, '\\s+', ' ', 'g')))"
    last = f"string_split(replace({upper}, ',', ' '), ' ')[-1]"
    bare = f"replace({last}, '.', '')"
    # The suffixes, as an undotted last word with another word before it.
    initials = f"({bare} IN ('LLC', 'LLP') AND NOT contains({last}, '..') AND NOT starts_with({last}, '.'))"
    word = f"({last} IN ('INC', 'CORP', 'LTD', 'INC.', 'CORP.', 'LTD.'))"
    head = f"rtrim(left({upper}, length({upper}) - length({last})))"
    return (
        f"CASE WHEN length({last}) < length({upper}) AND ({initials} OR {word}) "
        f"THEN rtrim(CASE WHEN ends_with({head}, ',') THEN left({head}, length({head}) - 1) ELSE {head} END) || ' ' || {bare} "
        f"ELSE {upper} END"
    )


def company_id(value: str) -> str:
    return f"('emp_' || substr(sha256({value}), 1, 24))"


def pct(numerator: str, denominator: str) -> str:
    return f"round_even(100.0::DOUBLE * ({numerator}) / nullif({denominator}, 0), 2)"


def change_pct(value: str, before: str) -> str:
    return f"round_even(CAST(100 * ({value} - {before}) AS DOUBLE) / nullif({before}, 0), 2)"


ORDER = "shipped, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"

# Versioned cases: order lines, a repeated line number being a newer version.
LINES = f"""
lines AS (
  SELECT l_orderkey || '-' || l_linenumber AS case_number, CAST(l_shipdate AS DATE) AS shipped,
         {label(quarter('l_shipdate'))} AS release, {quarter('l_shipdate')} AS release_q,
         CAST(o_orderdate AS DATE) AS received, {quarter('o_orderdate')} AS received_q,
         {quarter('l_shipdate')} AS decided_q, CAST(l_quantity AS BIGINT) AS positions,
         c_name, {name('c_name')} AS company, lineitem.*
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY case_number ORDER BY release, {ORDER}) AS first_n,
         row_number() OVER (PARTITION BY case_number ORDER BY release DESC, shipped DESC, l_partkey DESC,
           l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC,
           l_returnflag DESC, l_linestatus DESC) AS last_n
  FROM lines
),
latest AS (SELECT * FROM numbered WHERE last_n = 1),
class_cases AS (SELECT * FROM latest WHERE l_returnflag = 'R')
"""

# The same lines with faults spread by part key; keys and days as the operators should read them.
DIRTY = f"""
{LINES},
spoilt AS (
  SELECT release, received, positions, l_linestatus, {', '.join(c.strip() for c in ORDER.split(','))},
         CASE l_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '  ' WHEN 3 THEN ' ' || case_number || chr(9) ELSE case_number END AS raw_case,
         CASE WHEN l_partkey % 11 NOT IN (0, 1, 2) THEN case_number END AS case_key,
         CASE l_partkey % 9 WHEN 0 THEN 'no date' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN CAST(shipped AS VARCHAR) || 'T08:30:00'
           WHEN 4 THEN '2023-02-30' ELSE CAST(shipped AS VARCHAR) END AS raw_day,
         CASE WHEN l_partkey % 9 NOT IN (0, 1, 2, 4) THEN shipped END AS day,
         CASE l_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN c_name || ', Inc.' WHEN 2 THEN c_name || '  l.l.c. ' WHEN 3 THEN c_name || ' Cafe' || chr(769)
           WHEN 4 THEN c_name || ',Ltd' WHEN 5 THEN NULL ELSE c_name END AS raw_name,
         CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '15-' || l_partkey END AS soc,
         CASE l_partkey % 10 WHEN 0 THEN ' ' || lower(l_returnflag) WHEN 1 THEN '' ELSE l_returnflag END AS visa,
         l_partkey % 10 <> 1 AND l_returnflag = 'R' AS in_class
  FROM lines
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY release DESC, {', '.join(c.strip() + ' DESC' for c in ORDER.split(','))}) AS n
  FROM spoilt WHERE case_key IS NOT NULL
),
newest AS (SELECT * FROM ranked WHERE n = 1)
"""

VERSION = """case_number AS "CASE_NUMBER", release AS "SOURCE_RELEASE", l_returnflag AS "VISA_CLASS",
 l_linestatus AS "CASE_STATUS", shipped AS "DECISION_DATE", CAST(positions AS VARCHAR) AS "TOTAL_WORKER_POSITIONS" """


def counts(source: str, period: str, status: str, positions: str) -> str:
    return f"""
counts AS (
  SELECT {company_id('company')} AS id, company, {period} AS q, count(*) AS cases,
         count(*) FILTER (WHERE {status} = 'F') AS certified, CAST(sum({positions}) AS BIGINT) AS positions
  FROM {source} GROUP BY ALL
)"""


ORDERS = f"""
sizes AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1),
cases AS (
  SELECT {name('c_name')} AS company, {quarter('o_orderdate')} AS q, o_orderstatus AS status,
         coalesce(quantity, 1) AS positions
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN sizes ON o_orderkey = l_orderkey
),
{counts('cases', 'q', 'status', 'positions')}
"""


def panel(where: str = "true") -> str:
    return f"""
{ORDERS},
kept AS (SELECT * FROM counts WHERE {where}),
spine AS (
  SELECT id, company, unnest(generate_series(min(q), (SELECT max(q) FROM kept))) AS q FROM kept GROUP BY id, company
),
panel AS (
  SELECT spine.id, spine.company, CAST(spine.q AS INTEGER) AS q, coalesce(cases, 0) AS cases,
         coalesce(certified, 0) AS certified, coalesce(positions, 0) AS positions
  FROM spine LEFT JOIN kept ON spine.id = kept.id AND spine.q = kept.q
)
"""


PANEL = panel()

# Features by self-joins and correlated ranges, the way their definitions read.
EXAMPLES = f"""
{PANEL},
market AS (SELECT q, CAST(sum(cases) AS BIGINT) AS m, count(*) FILTER (WHERE cases > 0) AS k FROM panel GROUP BY q),
market_rows AS (
  SELECT a.q, CAST(count(*) AS INTEGER) AS n, any_value(a.m) AS m, any_value(a.k) AS k,
         max(b.m) FILTER (WHERE b.q = a.q - 1) AS m1, max(b.k) FILTER (WHERE b.q = a.q - 1) AS k1,
         CAST(sum(b.m) FILTER (WHERE b.q > a.q - 4) AS BIGINT) AS last4,
         CAST(sum(b.m) FILTER (WHERE b.q <= a.q - 4 AND b.q > a.q - 8) AS BIGINT) AS prev4
  FROM market a JOIN market b ON b.q <= a.q GROUP BY a.q
),
horizons AS (SELECT unnest([1, 2]) AS h),
market_features AS (
  SELECT q, n, h, m, k, last4, CAST(m - m1 AS DOUBLE) / (m1 + 1) AS quarter_change,
         CASE WHEN n >= 8 THEN CAST(last4 - prev4 AS DOUBLE) / (prev4 + 1) ELSE 0 END AS growth,
         CASE WHEN n >= 8 THEN 1 ELSE 0 END AS has_year, CAST(k - k1 AS DOUBLE) / (k1 + 1) AS company_change,
         (SELECT CAST(sum(s.m) AS DOUBLE) / count(*) FROM market s
          WHERE s.q <= r.q AND s.q % 4 = (r.q + h) % 4) AS season_mean
  FROM market_rows r, horizons
),
past AS (
  SELECT a.id, any_value(a.company) AS company, a.q, any_value(a.cases) AS cases, count(*) AS n,
         CAST(sum(b.cases) AS BIGINT) AS total, count(*) FILTER (WHERE b.cases > 0) AS active, max(b.cases) AS top,
         max(b.cases) FILTER (WHERE b.q = a.q - 1) AS c2, max(b.cases) FILTER (WHERE b.q = a.q - 2) AS c3,
         max(b.cases) FILTER (WHERE b.q = a.q - 3) AS c4,
         CAST(sum(b.cases) FILTER (WHERE b.q > a.q - 4) AS BIGINT) AS last4,
         count(*) FILTER (WHERE b.q > a.q - 4 AND b.cases > 0) AS active4,
         CAST(sum(b.cases) FILTER (WHERE b.q <= a.q - 4 AND b.q > a.q - 8) AS BIGINT) AS prev4,
         a.q - max(b.q) FILTER (WHERE b.cases > 0) AS idle
  FROM panel a JOIN panel b ON a.id = b.id AND b.q <= a.q GROUP BY a.id, a.q
),
company AS (
  SELECT *, CAST(total AS DOUBLE) / n AS mean, CAST(active AS DOUBLE) / n AS active_rate, n >= 8 AS has_year,
         cases - c2 AS change1, (-1.5 * c4 - 0.5 * c3 + 0.5 * c2 + 1.5 * cases) / 5 AS slope,
         CASE WHEN n >= 8 THEN prev4 ELSE -1 END AS previous4,
         CASE WHEN n >= 8 THEN last4 - prev4 ELSE 0 END AS year_change,
         CASE WHEN n >= 8 THEN CAST(last4 - prev4 AS DOUBLE) / (prev4 + 1) ELSE 0 END AS year_growth
  FROM past
),
season AS (
  SELECT a.id, a.q, h, a.q + h AS target, count(*) AS seen, CAST(sum(b.cases) AS DOUBLE) / count(*) AS mean,
         CAST(count(*) FILTER (WHERE b.cases > 0) AS DOUBLE) / count(*) AS active_rate,
         max(b.cases) FILTER (WHERE b.q = a.q + h - 4) AS last_year
  FROM panel a, horizons, panel b WHERE a.id = b.id AND b.q <= a.q AND b.q % 4 = (a.q + h) % 4
  GROUP BY a.id, a.q, h
),
wide AS (
  SELECT c.id AS "EMPLOYER_ID", c.company AS "EMPLOYER_NAME", c.q AS origin, s.target AS target_quarter,
         c.n AS history_quarters, c.mean AS history_mean, c.active_rate AS history_active_rate, top AS history_max,
         c.cases AS cases_recent1, c2 AS cases_recent2, c3 AS cases_recent3, c4 AS cases_recent4,
         c.last4 AS cases_last4, active4 AS active_last4, change1 AS recent_change, slope AS recent_slope,
         previous4 AS cases_previous4, CASE WHEN c.has_year THEN 1 ELSE 0 END AS has_previous_year,
         year_change AS annual_change, year_growth AS annual_growth, idle AS inactive_quarters,
         s.last_year AS same_quarter_last_year, s.mean AS same_quarter_mean,
         s.active_rate AS same_quarter_active_rate, s.seen AS same_quarter_observations,
         f.m AS market_recent_cases, f.last4 AS market_last4_cases, f.quarter_change AS market_quarter_change,
         f.growth AS market_annual_growth, f.has_year AS market_has_previous_year, f.k AS market_active_companies,
         f.company_change AS market_company_change, f.season_mean AS market_season_mean,
         CAST(c.last4 AS DOUBLE) / greatest(f.last4, 1) AS company_market_share, s.h AS horizon,
         CASE WHEN s.target % 4 = 0 THEN 1 ELSE 0 END AS target_q1, CASE WHEN s.target % 4 = 1 THEN 1 ELSE 0 END AS target_q2,
         CASE WHEN s.target % 4 = 2 THEN 1 ELSE 0 END AS target_q3, CASE WHEN s.target % 4 = 3 THEN 1 ELSE 0 END AS target_q4,
         CAST(o.cases AS DOUBLE) AS target_cases
  FROM (SELECT id, q, company, cases, n, mean, active_rate, top, c2, c3, c4, last4, active4, change1, slope, previous4,
               has_year, year_change, year_growth, idle FROM company WHERE n >= 4) c
  JOIN season s ON c.id = s.id AND c.q = s.q
  JOIN market_features f ON f.q = c.q AND f.h = s.h AND f.n >= 4
  LEFT JOIN panel o ON o.id = c.id AND o.q = s.target
),
examples AS (
  SELECT "EMPLOYER_ID", "EMPLOYER_NAME", origin, CAST(target_quarter AS INTEGER) AS target_quarter,
         {', '.join(f'CAST({f} AS FLOAT) AS {f}' for f in FEATURES)},
         target_cases, CAST(CASE WHEN target_cases IS NULL THEN NULL WHEN target_cases > 0 THEN 1 ELSE 0 END AS DOUBLE) AS target_active
  FROM wide
)
"""

BASELINES = f"""
{EXAMPLES},
predictions AS (
  SELECT target_quarter, target_active,
         (SELECT avg(target_active) FROM examples WHERE target_active IS NOT NULL AND target_quarter <= {EVALUATED}) AS global_rate,
         CAST(CAST((CAST(CAST(CAST(history_active_rate AS DOUBLE) * history_quarters AS FLOAT) AS DOUBLE) + 1)
              / (CAST(history_quarters AS DOUBLE) + 2) AS FLOAT) AS DOUBLE) AS company_rate,
         CAST(CAST((CAST(active_last4 AS DOUBLE) + 1) / 6 AS FLOAT) AS DOUBLE) AS recent_rate
  FROM examples WHERE target_active IS NOT NULL AND origin = {EVALUATED}
),
long AS (
  SELECT target_quarter, target_active AS y, 'global_rate' AS model, global_rate AS p FROM predictions
  UNION ALL SELECT target_quarter, target_active, 'company_rate', company_rate FROM predictions
  UNION ALL SELECT target_quarter, target_active, 'recent_rate', recent_rate FROM predictions
)
"""

LINKS = f"""
parents AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS case_number, 'FY' || ({quarter('o_orderdate')} // 4) AS fy,
         n_name AS city, r_name AS state, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS postal
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
),
children AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS case_number, {label(quarter('l_shipdate'))} AS release,
         'FY' || ({quarter('l_shipdate')} // 4) AS fy, upper(n_name) AS city, upper(r_name) AS state,
         lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS postal
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)
"""


def per_class_query(where: str, period: str) -> str:
    return f"""WITH {LINES}, {counts('class_cases', period, 'l_linestatus', 'positions')}
SELECT id AS "EMPLOYER_ID", company AS "EMPLOYER_NAME", q AS quarter, cases AS "LCA_CASES",
       certified AS "CERTIFIED_CASES", positions AS "REQUESTED_POSITIONS" FROM counts {where}"""


def distribution(source: str, value: str) -> str:
    return f"""SELECT avg({value})::DOUBLE AS mean, CAST(min({value}) AS DOUBLE) AS min,
  quantile_cont({value}::DOUBLE, 0.5) AS median, quantile_cont({value}::DOUBLE, 0.9) AS p90,
  quantile_cont({value}::DOUBLE, 0.99) AS p99, CAST(max({value}) AS DOUBLE) AS max FROM {source}"""


COMPANY_QUARTERS = f"""
SELECT id AS "EMPLOYER_ID", company AS "EMPLOYER_NAME", {label('q')} AS "FISCAL_QUARTER", cases AS "LCA_CASES",
       certified AS "CERTIFIED_CASES", cases - before AS "CHANGE_FROM_PREVIOUS_QUARTER",
       {change_pct('cases', 'before')} AS "CHANGE_PERCENT", positions AS "REQUESTED_POSITIONS",
       positions - before_positions AS "POSITION_CHANGE_FROM_PREVIOUS_QUARTER",
       {change_pct('positions', 'before_positions')} AS "POSITION_CHANGE_PERCENT"
FROM (SELECT *, lag(cases) OVER w AS before, lag(positions) OVER w AS before_positions
      FROM panel WINDOW w AS (PARTITION BY id ORDER BY q))"""

PAIRS = """
history AS (
  SELECT id, q, cases > 0 AS active, row_number() OVER w AS n, lead(q) OVER w AS next_q, lead(cases) OVER w > 0 AS next_active
  FROM panel WINDOW w AS (PARTITION BY id ORDER BY q)
),
pairs AS (SELECT * FROM history WHERE next_q = q + 1 AND n >= 4)
"""


def split_checks(origin: str) -> str:
    train = f"target_active IS NOT NULL AND target_quarter <= {origin}"
    test = f"target_active IS NOT NULL AND origin = {origin}"
    checks = {
        "training_overlaps_origin": f"count(*) FILTER (WHERE {train} AND origin >= {origin})",
        "missing_training_rows": f"CASE WHEN count(*) FILTER (WHERE {train}) = 0 THEN 1 ELSE 0 END",
        "missing_evaluation_rows": f"CASE WHEN count(*) FILTER (WHERE {test}) = 0 THEN 1 ELSE 0 END",
        "single_training_class": f"CASE WHEN count(DISTINCT target_active) FILTER (WHERE {train}) < 2 THEN 1 ELSE 0 END",
        "missing_outcome_quarter": f"2 - count(DISTINCT target_quarter) FILTER (WHERE {test})",
        "invalid_label": "count(*) FILTER (WHERE target_active NOT IN (0, 1))",
        "horizon_mismatch": "count(*) FILTER (WHERE target_quarter <> origin + horizon)",
        "nonfinite_feature": "count(*) FILTER (WHERE " + " OR ".join(f"{f} IS NULL OR NOT isfinite({f})" for f in FEATURES) + ")",
    }
    return " UNION ALL ".join(
        f"SELECT '{check}' AS \"check\", CAST({value} AS BIGINT) AS violations, CAST({origin} AS INTEGER) AS split_origin FROM examples"
        for check, value in checks.items()
    )


def statements() -> dict[str, str]:
    changed = {
        "visa_class": "l_returnflag <> b_flag",
        "employer_name": "c_name <> b_name",
        "case_status": "l_linestatus <> b_status",
        "decision_date": "shipped <> b_shipped",
        "received_date": "received <> b_received",
        "total_worker_positions": "positions <> b_positions",
    }
    any_change = " OR ".join(changed.values())
    bands = [(f"{lo}–{lo + 10}%", f"p >= {lo / 100} AND p < {(lo + 10) / 100}") for lo in range(0, 90, 10)]
    bands += [("90–100%", "p >= 0.9 AND p <= 1"), (">=95%", "p >= 0.95"), (">=99%", "p >= 0.99")]
    return {
        "fiscal_quarter": f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST({quarter('o_orderdate')} AS INTEGER) AS quarter,
            {label(quarter('o_orderdate'))} AS label, CAST({quarter('o_orderdate')} AS INTEGER) AS from_label FROM orders""",
        "normalized_names": f"""SELECT DISTINCT c_name, {name('c_name')} AS normalized_name,
            {company_id(name('c_name'))} AS entity_id FROM customer""",
        "standardize_release": f"""SELECT CAST(o_orderkey AS VARCHAR) AS "CASE_NUMBER", o_orderstatus AS "CASE_STATUS",
            CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "RECEIVED_DATE", CAST(NULL AS VARCHAR) AS "DECISION_DATE",
            CAST(NULL AS VARCHAR) AS "JOB_TITLE", o_orderpriority AS "H_1B_DEPENDENT",
            {label(quarter('o_orderdate'))} AS "SOURCE_RELEASE", 'orders.parquet' AS "SOURCE_FILE",
            o_orderkey + 2 AS "SOURCE_ROW_NUMBER" FROM orders""",
        "latest_version": f"WITH {LINES} SELECT {VERSION} FROM latest",
        "first_version": f"WITH {LINES} SELECT {VERSION} FROM numbered WHERE first_n = 1",
        "revision_counts": f"""WITH {LINES}, versions AS (
            SELECT *, lag(case_number) OVER w AS before, lag(l_returnflag) OVER w AS b_flag, lag(c_name) OVER w AS b_name,
              lag(l_linestatus) OVER w AS b_status, lag(shipped) OVER w AS b_shipped, lag(received) OVER w AS b_received,
              lag(positions) OVER w AS b_positions, lag(decided_q) OVER w AS b_quarter
            FROM lines WINDOW w AS (PARTITION BY case_number ORDER BY release, {ORDER}))
            SELECT count(*) AS repeated_rows, count(*) FILTER (WHERE {any_change}) AS changed_rows,
              count(*) FILTER (WHERE ({any_change}) AND l_returnflag = 'R') AS h1b_changed_rows,
              count(*) FILTER (WHERE decided_q <> b_quarter) AS decision_quarter_changed_rows,
              {', '.join(f'count(*) FILTER (WHERE {test}) AS {field}_changed_rows' for field, test in changed.items())}
            FROM versions WHERE before IS NOT NULL""",
        "cross_release_duplicates": f"""WITH {LINES}, per_case AS (
            SELECT case_number, count(DISTINCT release) AS n FROM lines GROUP BY 1 HAVING count(DISTINCT release) > 1)
            SELECT count(*) AS case_numbers_in_multiple_releases,
              CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_case_occurrences_across_releases FROM per_case""",
        "release_overlaps": f"""WITH {LINES}, pairs AS (SELECT DISTINCT release, case_number FROM lines)
            SELECT l.release AS "left", r.release AS "right", count(*) AS shared_case_numbers
            FROM pairs l JOIN pairs r ON l.case_number = r.case_number AND l.release < r.release GROUP BY ALL""",
        "release_offset_histogram": f"""WITH {LINES} SELECT CAST(release_q - received_q AS BIGINT) AS quarter_offset, count(*) AS cases
            FROM numbered WHERE first_n = 1 AND l_returnflag = 'R' GROUP BY 1""",
        "source_profile": f"""WITH {LINES} SELECT (SELECT count(*) FROM lines) AS source_rows, CAST(0 AS BIGINT) AS missing_case_numbers,
            count(*) AS unique_cases, (SELECT count(*) FROM lines) - count(*) AS repeated_case_rows,
            count(*) FILTER (WHERE l_returnflag = 'R') AS h1b_cases,
            count(*) FILTER (WHERE l_returnflag = 'R') AS h1b_cases_with_company_and_date,
            CAST(sum(positions) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS requested_positions FROM latest""",
        "release_quality": f"""WITH {LINES} SELECT release AS "SOURCE_RELEASE", count(*) AS source_rows,
            count(*) FILTER (WHERE l_returnflag = 'R') AS h1b_rows,
            count(*) FILTER (WHERE l_returnflag = 'R' AND shipped >= DATE '{SINCE}') AS h1b_rows_since_start,
            count(*) FILTER (WHERE shipped IS NULL) AS missing_decision_date, CAST(0 AS BIGINT) AS invalid_decision_date,
            count(*) FILTER (WHERE shipped IS NULL AND l_returnflag = 'R') AS h1b_missing_decision_date,
            count(*) FILTER (WHERE l_returnflag = 'R' AND coalesce(c_name, '') = '') AS h1b_missing_employer_name,
            CAST(0 AS BIGINT) AS h1b_missing_soc_code, count(*) FILTER (WHERE case_number IS NULL) AS missing_case_number,
            count(*) - count(DISTINCT case_number) AS duplicate_case_number_rows,
            count(DISTINCT case_number) AS unique_case_numbers, min(shipped) AS decision_date_min,
            max(shipped) AS decision_date_max FROM lines GROUP BY release""",
        "status_counts": f"""WITH {LINES} SELECT l_linestatus AS "CASE_STATUS", count(*) AS rows FROM class_cases GROUP BY 1""",
        "release_value_counts": f"""WITH {LINES} SELECT release AS "SOURCE_RELEASE", l_returnflag AS "VISA_CLASS", count(*) AS rows
            FROM lines GROUP BY ALL""",
        "coverage": f"""WITH {LINES} SELECT release AS "SOURCE_RELEASE", CAST(received_q AS INTEGER) AS quarter, count(*) AS rows
            FROM lines WHERE l_returnflag = 'R' GROUP BY ALL""",
        "date_checks": f"""WITH {LINES} SELECT count(*) AS h1b_unique_cases, min(shipped) AS decision_date_min,
            max(shipped) AS decision_date_max, count(*) FILTER (WHERE shipped IS NULL) AS missing_or_invalid_decision_dates,
            count(*) FILTER (WHERE received IS NULL) AS missing_or_invalid_received_dates,
            count(*) FILTER (WHERE shipped < received) AS decision_before_received FROM class_cases""",
        "elapsed_distribution": f"""WITH {LINES}, elapsed AS (SELECT datediff('day', received, shipped) AS days FROM class_cases)
            {distribution('elapsed', 'days')}""",
        "positions_distribution": f"WITH {LINES} {distribution('class_cases', 'positions')}",
        "quarter_totals": f"""WITH {LINES} SELECT CAST(received_q AS INTEGER) AS quarter, count(*) AS "LCA_CASES",
            CAST(sum(positions) AS BIGINT) AS "REQUESTED_POSITIONS" FROM class_cases
            WHERE received_q BETWEEN {INNER_FIRST} AND {INNER_LAST} GROUP BY 1""",
        "quarter_counts_by_decision": per_class_query("", "CAST(decided_q AS INTEGER)"),
        "quarter_counts_by_received": per_class_query("", "CAST(received_q AS INTEGER)"),
        "invalid_positions": f"""WITH {LINES} SELECT 'invalid_positions' AS "check", case_number AS key,
            CAST(CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS VARCHAR) AS detail FROM lines
            WHERE l_returnflag = 'R' AND floor(l_tax * 100 + 0.5) < 1""",
        "worksite_link_same_year": f"""WITH {LINKS}, found AS (
            SELECT children.*, EXISTS (SELECT 1 FROM parents p WHERE p.case_number = children.case_number AND p.fy = children.fy) AS hit
            FROM children),
            years AS (SELECT fy, count(DISTINCT case_number) AS mains FROM parents GROUP BY fy),
            per_release AS (
              SELECT release, any_value(fy) AS fy, count(*) AS source_rows, count(*) FILTER (WHERE hit) AS matched,
                     count(DISTINCT case_number) FILTER (WHERE hit) AS linked FROM found GROUP BY release)
            SELECT release AS "SOURCE_RELEASE", source_rows, CAST(0 AS BIGINT) AS missing_case_number,
              matched AS worksite_rows_matching_main, source_rows - matched AS worksite_rows_without_same_year_main,
              coalesce(mains, 0) AS unique_main_case_numbers, linked AS main_cases_with_same_year_worksite_row,
              coalesce(mains, 0) - linked AS main_cases_without_same_year_worksite_row,
              {pct('linked', 'coalesce(mains, 0)')} AS same_year_main_to_worksite_match_pct,
              {pct('matched', 'source_rows')} AS same_year_worksite_to_main_match_pct
            FROM per_release LEFT JOIN years ON per_release.fy = years.fy""",
        "worksite_location_match": f"""WITH {LINKS}, per_case AS (
            SELECT release, c.case_number, bool_or(p.city <> '' AND p.state <> '' AND p.postal <> '') AS comparable,
                   bool_or(c.city = p.city AND c.state = p.state AND c.postal = p.postal) AS hit
            FROM children c JOIN parents p ON c.case_number = p.case_number AND c.fy = p.fy GROUP BY ALL)
            SELECT release AS "SOURCE_RELEASE", count(*) FILTER (WHERE comparable) AS comparable_cases,
              count(*) FILTER (WHERE hit) AS matching_cases,
              {pct('count(*) FILTER (WHERE hit)', 'count(*) FILTER (WHERE comparable)')} AS match_pct
            FROM per_case GROUP BY release""",
        "worksite_orphans": f"""WITH {LINKS} SELECT release AS "SOURCE_RELEASE",
            count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.case_number = c.case_number AND p.fy = c.fy))
              AS worksite_rows_without_same_year_main,
            count(DISTINCT case_number) FILTER (WHERE case_number NOT IN (SELECT case_number FROM parents))
              AS worksite_cases_without_any_selected_main,
            count(*) FILTER (WHERE case_number NOT IN (SELECT case_number FROM parents))
              AS worksite_rows_without_any_selected_main
            FROM children c GROUP BY release""",
        "worksite_other_year": f"""WITH {LINKS} SELECT release AS "SOURCE_RELEASE",
            count(DISTINCT case_number) AS worksite_cases_with_main_in_other_year FROM children c
            WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.case_number = c.case_number AND p.fy = c.fy)
              AND case_number IN (SELECT case_number FROM parents) GROUP BY release""",
        "multi_worksite_cases": f"""WITH {LINKS}, per_case AS (SELECT release, case_number, count(*) AS n FROM children GROUP BY ALL)
            SELECT release AS "SOURCE_RELEASE", count(*) AS unique_worksite_case_numbers,
              count(*) FILTER (WHERE n > 1) AS cases_with_multiple_worksite_rows FROM per_case GROUP BY release""",
        "case_links_by_year": f"""WITH {LINKS}, mains AS (
            SELECT DISTINCT fy, case_number, case_number IN (SELECT case_number FROM children) AS hit FROM parents)
            SELECT fy AS fiscal_year, count(*) AS unique_main_case_numbers, count(*) FILTER (WHERE hit) AS main_cases_with_any_worksite_row,
              count(*) FILTER (WHERE NOT hit) AS main_cases_without_any_worksite_row,
              {pct('count(*) FILTER (WHERE hit)', 'count(*)')} AS main_to_worksite_match_pct FROM mains GROUP BY fy""",
        "global_case_links": f"""WITH {LINKS}, m AS (SELECT DISTINCT case_number FROM parents),
            c AS (SELECT DISTINCT case_number FROM children), both_sides AS (SELECT count(*) AS n FROM m SEMI JOIN c USING (case_number))
            SELECT (SELECT count(*) FROM m) AS unique_main_case_numbers, (SELECT count(*) FROM c) AS unique_worksite_case_numbers,
              n AS main_cases_with_any_worksite_row, (SELECT count(*) FROM m) - n AS main_cases_without_any_worksite_row,
              {pct('n', '(SELECT count(*) FROM m)')} AS main_to_worksite_match_pct,
              (SELECT count(*) FROM c) - n AS worksite_cases_without_any_selected_main FROM both_sides""",
        "company_quarter_counts": f"""WITH {ORDERS} SELECT id AS "EMPLOYER_ID", company AS "EMPLOYER_NAME", CAST(q AS INTEGER) AS quarter,
            cases AS "LCA_CASES", certified AS "CERTIFIED_CASES", positions AS "REQUESTED_POSITIONS" FROM counts""",
        "dense_panel": f"""WITH {PANEL} SELECT id AS "EMPLOYER_ID", company AS "EMPLOYER_NAME", q AS quarter, cases AS "LCA_CASES",
            certified AS "CERTIFIED_CASES", positions AS "REQUESTED_POSITIONS" FROM panel""",
        "panel_window": f"""WITH {panel(f'q BETWEEN {INNER_FIRST} AND {INNER_LAST}')} SELECT id AS "EMPLOYER_ID", q AS quarter,
            cases AS "LCA_CASES", certified AS "CERTIFIED_CASES" FROM panel""",
        "excluded_cases": f"""WITH {ORDERS} SELECT count(*) AS excluded_cases FROM cases WHERE q < {INNER_FIRST} OR q > {INNER_LAST}""",
        "quarterly_change": f"WITH {PANEL} {COMPANY_QUARTERS}",
        "company_lookup": f"""WITH {PANEL} SELECT * FROM ({COMPANY_QUARTERS}) WHERE "EMPLOYER_NAME" = 'CUSTOMER#000000007' """,
        "reconcile_totals": f"""WITH {PANEL}, a AS (
              SELECT q, CAST(sum(cases) AS BIGINT) AS c, CAST(sum(positions) AS BIGINT) AS p FROM panel GROUP BY q),
            b AS (SELECT q, count(*) AS c, CAST(sum(positions) AS BIGINT) AS p FROM cases GROUP BY q)
            SELECT CAST(coalesce(a.q, b.q) AS INTEGER) AS quarter,
              (a.c IS DISTINCT FROM b.c OR a.p IS DISTINCT FROM b.p) AS differs, a.c AS "panel_LCA_CASES",
              a.p AS "panel_REQUESTED_POSITIONS", b.c AS "source_LCA_CASES", b.p AS "source_REQUESTED_POSITIONS"
            FROM a FULL JOIN b ON a.q = b.q""",
        "panel_violations": f"""WITH {ORDERS}, per_company AS (
              SELECT id, min(q) AS lo, max(q) AS hi, count(DISTINCT q) AS n FROM counts GROUP BY id)
            SELECT 'missing_value' AS "check", count(*) AS violations FROM counts WHERE id IS NULL OR company IS NULL OR q IS NULL
            UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT id, q FROM counts GROUP BY ALL HAVING count(*) > 1)
            UNION ALL SELECT 'invalid_quarter', count(*) FROM counts WHERE NOT regexp_full_match({label('q')}, 'FY[0-9]{{4}}_Q[1-4]')
            UNION ALL SELECT 'invalid_count', count(*) FROM counts WHERE cases < 0
            UNION ALL SELECT 'name_conflict', count(*) FROM (SELECT id FROM counts GROUP BY id HAVING count(DISTINCT company) > 1)
            UNION ALL SELECT 'missing_market_quarter', count(*) FROM (
              SELECT q - lag(q) OVER (ORDER BY q) AS gap FROM (SELECT DISTINCT q FROM counts)) WHERE gap > 1
            UNION ALL SELECT 'history_gap', count(*) FROM per_company
              WHERE hi - lo + 1 <> n OR hi <> (SELECT max(q) FROM counts)
            UNION ALL SELECT 'history_without_start', count(*) FROM per_company
              JOIN counts ON counts.id = per_company.id AND counts.q = lo WHERE cases <= 0""",
        "empty_quarters": f"""WITH {LINES}, axis AS (
              SELECT unnest(generate_series(min({quarter('o_orderdate')}) - 2, max({quarter('o_orderdate')}) + 2)) AS q FROM orders)
            SELECT 'empty_quarter' AS "check", {label('q')} AS key, 'no case in this quarter' AS detail
            FROM axis WHERE q NOT IN (SELECT received_q FROM class_cases)""",
        "quarter_overview": f"""WITH {PANEL} SELECT q AS quarter, CAST(sum(cases) AS BIGINT) AS "LCA_CASES",
            CAST(sum(certified) AS BIGINT) AS "CERTIFIED_CASES", CAST(sum(positions) AS BIGINT) AS "REQUESTED_POSITIONS",
            count(*) AS "KNOWN_COMPANIES", count(*) FILTER (WHERE cases > 0) AS "ACTIVE_COMPANIES" FROM panel GROUP BY q""",
        "panel_summary": f"""WITH {PANEL} SELECT min(q) AS first_quarter, max(q) AS last_quarter, count(DISTINCT q) AS quarters,
            count(DISTINCT id) AS companies, count(*) AS company_quarter_rows, CAST(sum(cases) AS BIGINT) AS lca_cases,
            CAST(sum(positions) AS BIGINT) AS requested_positions FROM panel""",
        "first_four_activity": f"""WITH {PANEL}, numbered AS (
              SELECT id, cases, row_number() OVER (PARTITION BY id ORDER BY q) AS n, count(*) OVER (PARTITION BY id) AS size FROM panel),
            per_company AS (SELECT id, count(*) FILTER (WHERE cases > 0) AS a FROM numbered WHERE n <= 4 AND size >= 4 GROUP BY id),
            shares AS (SELECT count(*) AS total, 100 * (CAST(sum(4 - a) AS DOUBLE) / (4 * count(*))) AS zero,
              100 * (CAST(count(*) FILTER (WHERE a = 1) AS DOUBLE) / count(*)) AS single FROM per_company)
            SELECT a AS active_quarters, count(*) AS companies, any_value(total) AS first_four_quarter_companies,
              any_value(zero) AS zero_case_percent, any_value(single) AS single_active_quarter_company_percent
            FROM per_company, shares GROUP BY a""",
        "transition_rates": f"""WITH {PANEL}, {PAIRS}, outcomes AS (
              SELECT next_q, count(*) FILTER (WHERE active) AS a, count(*) FILTER (WHERE active AND next_active) AS an,
                count(*) FILTER (WHERE NOT active) AS i, count(*) FILTER (WHERE NOT active AND next_active) AS "in" FROM pairs GROUP BY next_q)
            SELECT q AS quarter, coalesce(a, 0) AS "PREVIOUSLY_ACTIVE_COMPANIES", coalesce(an, 0) AS "PREVIOUSLY_ACTIVE_NEXT_ACTIVE",
              coalesce(i, 0) AS "PREVIOUSLY_INACTIVE_COMPANIES", coalesce("in", 0) AS "PREVIOUSLY_INACTIVE_NEXT_ACTIVE",
              CAST(100 * an AS DOUBLE) / nullif(a, 0) AS "PREVIOUSLY_ACTIVE_RATE_PERCENT",
              CAST(100 * "in" AS DOUBLE) / nullif(i, 0) AS "PREVIOUSLY_INACTIVE_RATE_PERCENT"
            FROM (SELECT DISTINCT q FROM panel) LEFT JOIN outcomes ON q = next_q""",
        "next_quarter_outcomes": f"""WITH {PANEL}, {PAIRS} SELECT 4 AS minimum_history_quarters, count(*) AS pairs,
            count(DISTINCT id) AS companies, count(*) FILTER (WHERE NOT next_active) AS no_record,
            count(*) FILTER (WHERE next_active) AS record FROM pairs""",
        "company_features": f"""WITH {EXAMPLES} SELECT id AS "EMPLOYER_ID", company AS "EMPLOYER_NAME", q AS quarter, cases AS "LCA_CASES",
            n AS history_quarters, mean AS history_mean, active_rate AS history_active_rate, top AS history_max, cases AS cases_recent1,
            c2 AS cases_recent2, c3 AS cases_recent3, c4 AS cases_recent4, last4 AS cases_last4, active4 AS active_last4,
            previous4 AS cases_previous4, CAST(has_year AS INTEGER) AS has_previous_year, idle AS inactive_quarters,
            change1 AS recent_change, CAST(slope AS DOUBLE) AS recent_slope, year_change AS annual_change,
            CAST(year_growth AS DOUBLE) AS annual_growth FROM company""",
        "season_features": f"""WITH {EXAMPLES} SELECT s.id AS "EMPLOYER_ID", CAST(s.q AS INTEGER) AS quarter, p.cases AS "LCA_CASES",
            CAST(h AS INTEGER) AS horizon, CAST(target AS INTEGER) AS target_quarter, seen AS same_quarter_observations,
            last_year AS same_quarter_last_year, s.mean AS same_quarter_mean, s.active_rate AS same_quarter_active_rate,
            {', '.join(f'CAST(target % 4 = {k} AS INTEGER) AS target_q{k + 1}' for k in range(4))}
            FROM season s JOIN panel p ON p.id = s.id AND p.q = s.q""",
        "market_features": f"""WITH {EXAMPLES} SELECT q AS quarter, n AS market_quarters, CAST(h AS INTEGER) AS horizon,
            m AS market_recent_cases, last4 AS market_last4_cases, quarter_change AS market_quarter_change,
            CAST(growth AS DOUBLE) AS market_annual_growth, has_year AS market_has_previous_year, k AS market_active_companies,
            company_change AS market_company_change, season_mean AS market_season_mean FROM market_features""",
        "labeled_examples": f"WITH {EXAMPLES} SELECT * FROM examples",
        "rolling_split_sizes": f"""WITH {EXAMPLES}, origins AS (SELECT {LAST} - unnest({list(SPLITS_BACK)}) AS o)
            SELECT CAST(o AS INTEGER) AS split_origin, count(*) FILTER (WHERE target_quarter <= o) AS training_rows,
              count(*) FILTER (WHERE target_quarter <= o AND target_active = 1) AS training_active,
              count(*) FILTER (WHERE origin = o) AS evaluation_rows,
              count(*) FILTER (WHERE origin = o AND target_active = 1) AS evaluation_active
            FROM examples, origins WHERE target_active IS NOT NULL GROUP BY o""",
        "split_checks": f"WITH {EXAMPLES} {split_checks(EVALUATED)} UNION ALL {split_checks(f'({LAST} - 1)')}",
        "baseline_scores": f"""WITH {BASELINES}, periods AS (
              SELECT 'all' AS period, * FROM long UNION ALL SELECT {label('target_quarter')}, * FROM long),
            ranked AS (
              SELECT *, rank() OVER (PARTITION BY period, model ORDER BY p)
                + (count(*) OVER (PARTITION BY period, model, p) - 1) / 2.0::DOUBLE AS mid_rank,
                sum(y) OVER d / count(*) OVER d AS precision_at
              FROM periods WINDOW d AS (PARTITION BY period, model ORDER BY p DESC RANGE UNBOUNDED PRECEDING)),
            clipped AS (SELECT *, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, p)) AS cp FROM ranked)
            SELECT period, model, count(*) AS rows, round(avg(y), 9) AS actual_rate, round(avg(p), 9) AS mean_probability,
              round(avg(-(y * ln(cp) + (1 - y) * ln(1 - cp))), 9) AS log_loss, round(avg((p - y) * (p - y)), 9) AS brier,
              round(sum(precision_at) FILTER (WHERE y = 1) / sum(y), 9) AS average_precision,
              round((sum(mid_rank) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 9) AS roc_auc
            FROM clipped GROUP BY period, model""",
        "dirty_names": f"""WITH {DIRTY} SELECT DISTINCT raw_name AS "EMPLOYER_NAME", nullif({name('nfc_normalize(raw_name)')}, '') AS normalized_name,
            {company_id(f"nullif({name('nfc_normalize(raw_name)')}, '')")} AS entity_id FROM spoilt""",
        "dirty_dates": f"""WITH {DIRTY} SELECT raw_day AS "DECISION_DATE", count(*) AS rows, any_value(day) AS day,
            any_value(CASE WHEN day IS NOT NULL THEN {label(quarter('day'))} END) AS label FROM spoilt GROUP BY raw_day""",
        "dirty_locations": """SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN upper(n_name) ELSE '' END AS city,
            coalesce(['NY', 'TX', 'CA', 'GU', 'ELSEWHERE', ''][c_custkey % 7 + 1], '') AS state,
            CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 6 = 0 THEN (c_custkey % 3000) || 'A'
              ELSE lpad(CAST(c_custkey % 3000 AS VARCHAR), 5, '0') END AS postal
            FROM customer JOIN nation ON c_nationkey = n_nationkey""",
        "dirty_source_profile": f"""WITH {DIRTY} SELECT (SELECT count(*) FROM spoilt) AS source_rows,
            (SELECT count(*) FROM spoilt WHERE case_key IS NULL) AS missing_case_numbers, count(*) AS unique_cases,
            (SELECT count(*) FROM ranked WHERE n > 1) AS repeated_case_rows, count(*) FILTER (WHERE in_class) AS h1b_cases,
            count(*) FILTER (WHERE in_class AND raw_name <> '' AND day IS NOT NULL) AS h1b_cases_with_company_and_date,
            CAST(coalesce(sum(positions) FILTER (WHERE in_class AND raw_name <> '' AND day IS NOT NULL), 0) AS BIGINT) AS requested_positions
            FROM newest""",
        "dirty_release_quality": f"""WITH {DIRTY} SELECT release AS "SOURCE_RELEASE", count(*) AS source_rows,
            count(*) FILTER (WHERE in_class) AS h1b_rows, count(*) FILTER (WHERE in_class AND day >= DATE '{SINCE}') AS h1b_rows_since_start,
            count(*) FILTER (WHERE coalesce(raw_day, '') = '') AS missing_decision_date,
            count(*) FILTER (WHERE raw_day <> '' AND day IS NULL) AS invalid_decision_date,
            count(*) FILTER (WHERE in_class AND coalesce(raw_day, '') = '') AS h1b_missing_decision_date,
            count(*) FILTER (WHERE in_class AND coalesce(raw_name, '') = '') AS h1b_missing_employer_name,
            count(*) FILTER (WHERE in_class AND coalesce(soc, '') = '') AS h1b_missing_soc_code,
            count(*) FILTER (WHERE coalesce(raw_case, '') = '') AS missing_case_number,
            count(*) FILTER (WHERE raw_case <> '') - count(DISTINCT raw_case) FILTER (WHERE raw_case <> '') AS duplicate_case_number_rows,
            count(DISTINCT raw_case) FILTER (WHERE raw_case <> '') AS unique_case_numbers,
            min(day) AS decision_date_min, max(day) AS decision_date_max FROM spoilt GROUP BY release""",
        "dirty_missing_keys": f"WITH {DIRTY} SELECT count(*) FILTER (WHERE case_key IS NULL) AS rows_without_case_number FROM spoilt",
        "dirty_date_checks": f"""WITH {DIRTY} SELECT count(*) AS h1b_unique_cases, min(day) AS decision_date_min, max(day) AS decision_date_max,
            count(*) FILTER (WHERE day IS NULL) AS missing_or_invalid_decision_dates,
            count(*) FILTER (WHERE received IS NULL) AS missing_or_invalid_received_dates,
            count(*) FILTER (WHERE day < received) AS decision_before_received FROM newest WHERE in_class""",
        "dirty_case_violations": f"""WITH {DIRTY}, found AS (
              SELECT 'missing_case_number' AS "check" FROM spoilt WHERE case_key IS NULL
              UNION ALL SELECT 'case_without_company_or_date' FROM newest WHERE in_class AND (day IS NULL OR coalesce(raw_name, '') = ''))
            SELECT "check", count(*) AS violations FROM found GROUP BY 1""",
        "dirty_value_maps": f"""WITH {DIRTY}, named AS (
              SELECT release, CASE WHEN visa <> '' THEN visa ELSE '<missing>' END AS visa, l_linestatus AS status, in_class FROM spoilt)
            SELECT release AS "SOURCE_RELEASE", 'visa_class_counts' AS "view", visa AS value, count(*) AS rows FROM named GROUP BY ALL
            UNION ALL SELECT release, 'case_status_counts', status, count(*) FROM named GROUP BY ALL
            UNION ALL SELECT release, 'h1b_case_status_counts', status, count(*) FROM named WHERE in_class GROUP BY ALL""",
        "count_mismatches": f"""WITH counts AS (
              SELECT {label(quarter('l_shipdate'))} AS release, count(*) AS n FROM lineitem GROUP BY 1)
            SELECT 'row_count_changed' AS "check", release AS key,
              CASE WHEN release LIKE '%Q4' THEN CAST(n AS VARCHAR) ELSE n || ' vs ' || (n + 1) END AS detail
            FROM counts WHERE release LIKE '%Q2' OR release LIKE '%Q4'""",
        "discount_log_odds": """SELECT l_discount, count(*) AS rows,
            round(ln(greatest(1e-6, least(1 - 1e-6, l_discount)) / (1 - greatest(1e-6, least(1 - 1e-6, l_discount)))), 9) AS log_odds
            FROM lineitem GROUP BY l_discount""",
        "reliability_bands": f"WITH {BASELINES} " + " UNION ALL ".join(
            f"""SELECT model, '{text}' AS probability_band, count(*) AS rows, round(avg(p), 9) AS mean_probability,
            round(avg(y), 9) AS actual_rate FROM long WHERE {test} GROUP BY model"""
            for text, test in bands
        ),
    }
