"""SQL that gives, on the supplied tables, the same rows as each registered query.

Written separately from the operators: one chain of CTEs derives and cleans both boards, and
each query reads the CTEs it needs.
"""

from __future__ import annotations

AS_OF = "DATE '2000-07-27'"

# --- derived boards as text ---

_RAW = r"""
deal_source AS (
  SELECT o_orderkey AS k, o_orderstatus AS flag, substr(o_orderpriority, 1, 1) AS urgency,
         o_totalprice AS price, o_orderdate AS day, c_mktsegment AS segment, c_nationkey AS nation
  FROM orders JOIN customer ON o_custkey = c_custkey
),
raw_deals AS (
  SELECT 2 * k + copy AS seq, CAST(k AS VARCHAR) AS id,
    'Order ' || k || CASE WHEN copy = 1 THEN ' (copy)' ELSE '' END AS name,
    CASE segment WHEN 'BUILDING' THEN 'construction' WHEN 'MACHINERY' THEN ' mining '
      WHEN 'AUTOMOBILE' THEN 'POWER' WHEN 'FURNITURE' THEN 'agri'
      ELSE CASE WHEN k % 2 = 0 THEN '' END END AS sector,
    CASE WHEN k % 37 = 0 THEN NULL
      WHEN flag = 'F' THEN CASE WHEN urgency IN ('1', '2', '3') THEN 'closed won' ELSE 'LOST DEAL' END
      WHEN urgency = '1' THEN 'f. negotiations' WHEN urgency = '2' THEN 'PROPOSAL'
      WHEN urgency = '3' THEN 'lead' WHEN urgency = '4' THEN 'C. demo done'
      ELSE 'm. projects on hold' END AS stage,
    CASE WHEN k % 41 = 0 THEN NULL WHEN k % 43 = 0 THEN '' WHEN k % 47 = 0 THEN 'tbd'
      WHEN k % 3 = 0 THEN '$' || format('{:,.2f}', price)
      ELSE '  ' || CAST(CAST(price AS DECIMAL(12, 2)) AS VARCHAR) || ' ' END AS value,
    CASE k % 7 WHEN 1 THEN '' WHEN 2 THEN '0' WHEN 3 THEN '0.45' WHEN 4 THEN '70%'
      WHEN 5 THEN '55' WHEN 6 THEN '100' END AS probability,
    CASE WHEN k % 29 = 0 THEN NULL WHEN k % 53 = 0 THEN 'soon'
      WHEN k % 4 = 0 THEN strftime(day, '%Y-%m-%d') WHEN k % 4 = 1 THEN strftime(day, '%Y/%m/%d')
      WHEN k % 4 = 2 THEN strftime(day, '%d-%m-%Y') ELSE strftime(day, '%m/%d/%Y') END AS expected_close_date,
    CASE WHEN k % 31 = 0 THEN '' ELSE 'Rep ' || nation END AS owner
  FROM deal_source, (VALUES (0), (1)) AS c(copy)
  WHERE copy = 0 OR k % 20 = 0
),
raw_orders AS (
  SELECT l_shipdate, l_partkey, l_suppkey, l_extendedprice,
    l_orderkey || '-' || l_linenumber AS id, 'WO ' || l_orderkey || '-' || l_linenumber AS name,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'COMPLETED' WHEN 'AO' THEN 'active'
      WHEN 'NF' THEN 'backlog' WHEN 'NO' THEN 'Overdue' WHEN 'RF' THEN 'canceled'
      ELSE CASE l_partkey % 3 WHEN 1 THEN 'executed until current month' WHEN 2 THEN 'done' END END AS status,
    strftime(l_shipdate - INTERVAL 30 DAY, '%Y-%m-%d') AS start_date,
    CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN strftime(l_shipdate, '%d-%m-%Y')
      ELSE strftime(l_shipdate, '%Y-%m-%d') END AS due_date,
    CASE p_size % 5 WHEN 0 THEN 'MINING' WHEN 1 THEN 'renewables' WHEN 2 THEN 'Infra' WHEN 3 THEN 'agro' END AS sector,
    CASE WHEN l_suppkey % 19 = 0 THEN '' ELSE s_name END AS assigned_to
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
)"""


def _title(text: str) -> str:
    runs = f"regexp_extract_all({text}, '[A-Za-z]+|[^A-Za-z]+')"
    return f"list_aggregate(list_transform({runs}, lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '')"


def _filled(text: str) -> str:
    return f"nullif(trim({text}), '')"


def _number(text: str) -> str:
    first = rf"regexp_extract(replace(replace({text}, ',', ''), '%', ''), '[-+]?\d*\.\d+|\d+', 0)"
    return f"coalesce(try_cast({first} AS DOUBLE), 0.0)"


def _date(text: str) -> str:
    formats = "'%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y', '%d/%m/%Y', '%m-%d-%Y', '%d-%m-%Y'"
    return f"CAST(try_strptime(trim({text}), [{formats}]) AS DATE)"


def _sector(titled: str) -> str:
    return (
        f"CASE WHEN {titled} IN ('Agri', 'Agro') THEN 'Agriculture' "
        f"WHEN {titled} IN ('Infra', 'Construction') THEN 'Infrastructure' "
        f"WHEN {titled} IN ('Power', 'Renewables') THEN 'Energy' ELSE {titled} END"
    )


def _stage(titled: str) -> str:
    return (
        f"CASE WHEN upper({titled}) IN ('WON', 'WON DEAL', 'CLOSED WON') THEN 'Won' "
        f"WHEN upper({titled}) IN ('LOST', 'LOST DEAL', 'CLOSED LOST') THEN 'Lost' ELSE {titled} END"
    )


def _status(titled: str) -> str:
    return (
        f"CASE WHEN lower({titled}) IN ('in progress', 'inprogress', 'active') THEN 'In Progress' "
        f"WHEN lower({titled}) IN ('not started', 'notstarted', 'backlog') THEN 'Not Started' "
        f"WHEN lower({titled}) IN ('delayed', 'overdue', 'blocked') THEN 'Delayed' ELSE {titled} END"
    )


_CLEAN = rf"""{_RAW},
first_deals AS (SELECT * FROM raw_deals QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
first_orders AS (
  SELECT * FROM raw_orders QUALIFY row_number() OVER (
    PARTITION BY id ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) = 1
),
titled_deals AS (
  SELECT * REPLACE ({_title(_filled("sector"))} AS sector, {_title(_filled("stage"))} AS stage) FROM first_deals
),
titled_orders AS (
  SELECT * REPLACE ({_title(_filled("sector"))} AS sector, {_title(_filled("status"))} AS status) FROM first_orders
),
deals AS (
  SELECT id, name, {_sector("sector")} AS sector, {_stage("stage")} AS stage, {_number("value")} AS value,
    {_number("probability")} AS probability, {_date("expected_close_date")} AS close, {_filled("owner")} AS owner
  FROM titled_deals
),
work_orders AS (
  SELECT id, name, {_status("status")} AS status, {_date("start_date")} AS start, {_date("due_date")} AS due,
    {_sector("sector")} AS sector, {_filled("assigned_to")} AS assigned_to
  FROM titled_orders
),
stage_percent AS (
  SELECT * FROM (VALUES ('Proposal', 60.0), ('F. Negotiations', 80.0), ('Lead', 10.0), ('C. Demo Done', 30.0),
    ('M. Projects On Hold', 0.0), ('Won', 100.0), ('Lost', 0.0)) AS t(stage, percent)
),
weighed AS (
  SELECT d.*, coalesce(percent, 20.0)::DOUBLE AS stage_pct,
    coalesce(percent, 0.0)::DOUBLE AS known_pct, d.stage IS NULL OR d.stage NOT IN ('Won', 'Lost') AS is_open
  FROM deals d LEFT JOIN stage_percent p ON d.stage = p.stage
),
rated AS (
  SELECT *,
    CASE WHEN probability = 0 THEN stage_pct ELSE probability END AS p,
    CASE WHEN probability = 0 THEN CASE WHEN stage_pct = 0 THEN 20.0 ELSE stage_pct END ELSE probability END AS bp,
    CASE WHEN probability = 0 THEN known_pct ELSE probability END AS fp
  FROM weighed
),
facts AS (
  SELECT *,
    CASE WHEN p > 0 AND p <= 1 THEN value * p ELSE value * (p / 100) END AS weighted,
    CASE WHEN probability <= 1 THEN value * probability ELSE value * (probability / 100) END AS weighted_raw,
    CASE WHEN bp <= 1 THEN value * bp ELSE value * (bp / 100) END AS weighted_browser,
    CASE WHEN probability = 0 THEN stage_pct WHEN probability > 1 THEN probability ELSE probability * 100 END AS pct,
    CASE WHEN fp <= 1 THEN fp * 100 ELSE fp END AS pct_browser,
    coalesce(close BETWEEN DATE '2000-07-01' AND DATE '2000-09-30', false) AS current
  FROM rated
),
tasks AS (
  SELECT *,
    CASE WHEN lower(status) IN ('completed', 'complete', 'won', 'done') THEN 'Completed'
      WHEN lower(status) IN ('in progress', 'inprogress', 'active', 'executed until current month') THEN 'In Progress'
      WHEN lower(status) IN ('delayed', 'overdue', 'blocked') THEN 'Delayed'
      WHEN lower(status) IN ('cancelled', 'canceled', 'lost', 'stopped') THEN 'Cancelled'
      ELSE 'Pending' END AS category,
    coalesce(status, '') <> 'Completed' AND coalesce(due < {AS_OF}, false) AS overdue
  FROM work_orders
),
judged AS (SELECT *, coalesce(status, '') = 'Delayed' OR overdue AS delayed FROM tasks)
"""

_META = rf"""{_CLEAN},
deals_meta AS (
  SELECT 'Deals' AS board, 'total_rows' AS metric, NULL AS field, count(*) AS count FROM raw_deals
  UNION ALL SELECT 'Deals', 'dropped_rows', NULL, (SELECT count(*) FROM raw_deals) - (SELECT count(*) FROM deals)
  UNION ALL SELECT 'Deals', 'missing_field', 'sector', count(*) FROM deals WHERE sector IS NULL
  UNION ALL SELECT 'Deals', 'missing_field', 'stage', count(*) FROM deals WHERE stage IS NULL
  UNION ALL SELECT 'Deals', 'missing_field', 'owner', count(*) FROM deals WHERE owner IS NULL
  UNION ALL SELECT 'Deals', 'missing_field', 'value', count(*) FROM first_deals WHERE value IS NULL
  UNION ALL SELECT 'Deals', 'missing_field', 'probability', count(*) FROM first_deals WHERE probability IS NULL
  UNION ALL SELECT 'Deals', 'missing_field', 'expected_close_date', count(*) FROM first_deals
    WHERE trim(expected_close_date) <> '' AND {_date("expected_close_date")} IS NULL
),
orders_meta AS (
  SELECT 'Work Orders' AS board, 'total_rows' AS metric, NULL AS field, count(*) AS count FROM raw_orders
  UNION ALL SELECT 'Work Orders', 'dropped_rows', NULL,
    (SELECT count(*) FROM raw_orders) - (SELECT count(*) FROM work_orders)
  UNION ALL SELECT 'Work Orders', 'missing_field', 'sector', count(*) FROM work_orders WHERE sector IS NULL
  UNION ALL SELECT 'Work Orders', 'missing_field', 'status', count(*) FROM work_orders WHERE status IS NULL
  UNION ALL SELECT 'Work Orders', 'missing_field', 'assigned_to', count(*) FROM work_orders WHERE assigned_to IS NULL
  UNION ALL SELECT 'Work Orders', 'missing_field', 'start_date', count(*) FROM first_orders
    WHERE trim(start_date) <> '' AND {_date("start_date")} IS NULL
  UNION ALL SELECT 'Work Orders', 'missing_field', 'due_date', count(*) FROM first_orders
    WHERE trim(due_date) <> '' AND {_date("due_date")} IS NULL
),
meta AS (
  SELECT * FROM (SELECT * FROM deals_meta UNION ALL SELECT * FROM orders_meta)
  WHERE count > 0 OR metric IN ('total_rows', 'dropped_rows')
),
quality_counts AS (
  SELECT
    max(CASE WHEN board = 'Deals' AND metric = 'total_rows' THEN count END) AS total_deals,
    max(CASE WHEN board = 'Work Orders' AND metric = 'total_rows' THEN count END) AS total_orders,
    coalesce(max(CASE WHEN board = 'Deals' AND field = 'expected_close_date' THEN count END), 0) AS dates,
    coalesce(max(CASE WHEN board = 'Deals' AND field = 'owner' THEN count END), 0) AS owners,
    coalesce(max(CASE WHEN board = 'Work Orders' AND field = 'status' THEN count END), 0) AS statuses,
    coalesce(max(CASE WHEN board = 'Deals' AND metric = 'dropped_rows' THEN count END), 0) AS duplicates,
    coalesce(CAST(sum(CASE WHEN board = 'Deals' AND field IN ('stage', 'value', 'probability') THEN count END)
      AS BIGINT), 0) AS invalid
  FROM meta
),
quality AS (
  SELECT 'missing_close_dates' AS "check", dates AS count, CASE WHEN dates = 0 THEN 'green'
    WHEN dates / greatest(total_deals, 1) <= 0.3 THEN 'yellow' ELSE 'red' END AS status FROM quality_counts
  UNION ALL SELECT 'missing_owners', owners, CASE WHEN owners = 0 THEN 'green'
    WHEN owners / greatest(total_deals, 1) <= 0.3 THEN 'yellow' ELSE 'red' END FROM quality_counts
  UNION ALL SELECT 'missing_status', statuses, CASE WHEN statuses = 0 THEN 'green'
    WHEN statuses / greatest(total_orders, 1) <= 0.1 THEN 'yellow' ELSE 'red' END FROM quality_counts
  UNION ALL SELECT 'duplicate_deals', duplicates, CASE WHEN duplicates = 0 THEN 'green' ELSE 'yellow' END
    FROM quality_counts
  UNION ALL SELECT 'invalid_values', invalid, CASE WHEN invalid = 0 THEN 'green' ELSE 'yellow' END
    FROM quality_counts
  UNION ALL SELECT 'missing_columns', 0, 'green'
),
notes AS (
  SELECT m.board, m.field, CASE
    WHEN metric = 'dropped_rows' THEN m.board || ' board: ' || count || ' duplicate row(s) dropped.'
    ELSE m.board || ' board: ' || count || ' values missing/malformed in ''' || m.field || ''' column.' END AS note
  FROM meta m WHERE metric = 'missing_field' OR (metric = 'dropped_rows' AND count > 0)
)
"""


def _raw(body: str) -> str:
    return f"WITH {_RAW} {body}"


def _clean(body: str) -> str:
    return f"WITH {_CLEAN} {body}"


def _meta(body: str) -> str:
    return f"WITH {_META} {body}"


def _money(amount: str, alias: str | None = None) -> str:
    total = f"CAST(coalesce(round(sum(CAST({amount} AS DECIMAL(28, 6))), 2), 0) AS DOUBLE)"
    return f"{total} AS {alias}" if alias else total


def _when(condition: str, amount: str = "value") -> str:
    return f"CASE WHEN {condition} THEN {amount} END"


_MONTH = "strftime(close, '%Y-%m')"
_HEALTH = f"""{_money("value", "total_pipeline_value")}, {_money("weighted", "weighted_pipeline_value")},
  count(*) AS deal_count, {_money(_when("current"), "current_quarter_pipeline_value")},
  count(*) FILTER (current) AS current_quarter_deal_count,
  count(*) FILTER (close IS NULL) AS deals_without_close_date_count"""
_DELIVERY = """count(*) AS total_work_orders, count(*) FILTER (status = 'Completed') AS completed_work_orders,
  count(*) FILTER (delayed) AS delayed_work_orders, count(*) FILTER (category = 'Completed') AS completed_category,
  count(*) FILTER (category = 'Delayed') AS delayed_category"""
_DELAYED_ITEM = """id, name, coalesce(status, 'None') AS status, coalesce(sector, 'Unassigned') AS sector,
  coalesce(strftime(due, '%Y-%m-%d'), 'None') AS due_date, coalesce(assigned_to, 'Unassigned') AS assigned_to"""
_MONTHS = "(SELECT strftime(DATE '2000-07-01' + to_months(CAST(i AS INTEGER)), '%Y-%m') AS month FROM range(6) r(i))"
_BUCKETS = "(VALUES ('0-20%'), ('20-40%'), ('40-60%'), ('60-80%'), ('80-100%'))"
_CATEGORIES = "(VALUES ('Completed'), ('In Progress'), ('Pending'), ('Delayed'), ('Cancelled'))"


def _bucket(pct: str) -> str:
    return (
        f"CASE WHEN {pct} <= 20 THEN '0-20%' WHEN {pct} <= 40 THEN '20-40%' WHEN {pct} <= 60 THEN '40-60%' "
        f"WHEN {pct} <= 80 THEN '60-80%' ELSE '80-100%' END"
    )


def _forecast(weighted: str = "weighted", source: str = "facts") -> str:
    return f"""SELECT m.month, {_money("value", "unweighted_value")}, {_money(weighted, "weighted_value")},
      count(f.id) AS deal_count
    FROM {_MONTHS} m LEFT JOIN (SELECT * FROM {source} WHERE is_open) f ON m.month = {_MONTH} GROUP BY m.month"""


def _closure(pct: str = "pct", source: str = "facts") -> str:
    return f"""SELECT b.range, count(f.id) AS count FROM {_BUCKETS} b(range)
      LEFT JOIN (SELECT id, {_bucket(pct)} AS range FROM {source} WHERE is_open) f ON f.range = b.range GROUP BY b.range"""


def _order_status(source: str = "judged") -> str:
    return f"""SELECT c.status, count(j.id) AS count FROM {_CATEGORIES} c(status)
      LEFT JOIN {source} j ON j.category = c.status GROUP BY c.status"""


def _distribution(source: str = "facts") -> str:
    return f"""SELECT 'Open' AS name, count(*) FILTER (is_open) AS value FROM {source}
      UNION ALL SELECT 'Won', count(*) FILTER (stage = 'Won') FROM {source}
      UNION ALL SELECT 'Lost', count(*) FILTER (stage = 'Lost') FROM {source}"""


_STAGE_TOTALS = f"""SELECT stage, {_money("value", "value")}, count(*) AS count FROM facts
  WHERE is_open AND stage IS NOT NULL GROUP BY stage"""
_OWNERS = f"""SELECT owner, {_money("value", "value")}, count(*) AS count FROM facts
  WHERE is_open AND owner IS NOT NULL GROUP BY owner"""
_ASSIGNEES = """SELECT assigned_to, count(*) AS total_count,
  count(*) FILTER (lower(status) IN ('delayed', 'overdue')) AS delayed_count
  FROM judged WHERE assigned_to IS NOT NULL GROUP BY assigned_to"""
_TOP = """SELECT name, value, coalesce(stage, 'None') AS stage,
  coalesce(strftime(close, '%Y-%m-%d'), 'None') AS expected_close_date
  FROM {source} WHERE is_open ORDER BY value DESC, id LIMIT 10"""
_SECTORS = f"""SELECT coalesce(d.sector, w.sector) AS sector, coalesce(total_value, 0.0) AS total_value,
    coalesce(won_value, 0.0) AS won_value, coalesce(active_value, 0.0) AS active_value,
    coalesce(deal_count, 0) AS deal_count, coalesce(won_count, 0) AS won_count, coalesce(wo_total, 0) AS wo_total,
    coalesce(wo_completed, 0) AS wo_completed, coalesce(wo_delayed, 0) AS wo_delayed,
    coalesce(wo_in_progress, 0) AS wo_in_progress
  FROM (SELECT sector, {_money("value", "total_value")}, {_money(_when("stage = 'Won'"), "won_value")},
      {_money(_when("is_open"), "active_value")}, count(*) AS deal_count,
      count(*) FILTER (stage = 'Won') AS won_count FROM facts WHERE sector IS NOT NULL GROUP BY sector) d
  FULL JOIN (SELECT sector, count(*) AS wo_total, count(*) FILTER (status = 'Completed') AS wo_completed,
      count(*) FILTER (delayed) AS wo_delayed, count(*) FILTER (status = 'In Progress') AS wo_in_progress
    FROM judged WHERE sector IS NOT NULL GROUP BY sector) w ON d.sector = w.sector"""
_OVERVIEW = f"""SELECT total_revenue, won_deals_count, total_pipeline_value, weighted_pipeline_value,
    deal_count AS active_deals_count, total_work_orders, completed_work_orders, delayed_work_orders,
    total_work_orders - completed_work_orders AS active_work_orders,
    CASE WHEN total_work_orders > 0 THEN delayed_work_orders / total_work_orders ELSE 0.0 END AS delay_rate
  FROM (SELECT {_money("value", "total_revenue")}, count(*) AS won_deals_count FROM facts WHERE stage = 'Won'),
    (SELECT {_HEALTH} FROM facts WHERE is_open), (SELECT {_DELIVERY} FROM judged)"""

# --- filters ---

_FILTERED = f"""{_CLEAN},
found AS (
  SELECT * FROM facts WHERE contains(lower(name), '11') AND fp BETWEEN 10 AND 80
    AND close BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
),
found_orders AS (
  SELECT * FROM judged WHERE contains(lower(name), '11')
    AND due BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
)"""

# --- sentences ---


def _insights(source: str, missing: str) -> str:
    """``missing`` is a scalar query for the unparseable close dates."""
    return f"""totals AS (
      SELECT {_money("value", "total_value")}, count(*) AS n, count(*) FILTER (current) AS q FROM {source} WHERE is_open
    ), leader AS (
      SELECT stage, {_money("value", "stage_value")} FROM {source} WHERE is_open AND stage IS NOT NULL
      GROUP BY stage ORDER BY 2 DESC, 1 LIMIT 1
    ), top5 AS (
      SELECT {_money("value", "held")} FROM
        (SELECT value FROM {source} WHERE is_open ORDER BY value DESC, id LIMIT 5)
    ), share AS (
      SELECT *, held / greatest(total_value, 1.0) * 100 AS pct, {missing} AS missing FROM totals, top5
    ), given AS (
      SELECT 1 AS nr, printf('Pipeline heavily concentrated in top 5 opportunities (%.1f%% of total value).', pct) AS insight
        FROM share WHERE pct >= 50
      UNION ALL SELECT 2, 'Most active pipeline value sits in ''' || stage || ''' stage ($' ||
        format('{{:,.2f}}', stage_value) || ').' FROM leader
      UNION ALL SELECT 3, CASE WHEN q <= 5
        THEN 'Only ' || q || ' opportunities are forecast to close in the current quarter.'
        ELSE q || ' opportunities are expected to close this quarter.' END FROM share
      UNION ALL SELECT 4, missing || ' open opportunities have no expected close date, reducing forecast accuracy.'
        FROM share WHERE missing > 0
      UNION ALL SELECT 5, 'Revenue forecast confidence: ' || CASE WHEN missing = 0 THEN 'High'
        WHEN missing / greatest(n, 1) * 100 <= 30 THEN 'Medium' ELSE 'Low' END || '.' FROM share
    ), insights AS (SELECT CAST(row_number() OVER (ORDER BY nr) AS INTEGER) AS rank, insight FROM given)"""


def _insights_filtered(source: str) -> str:
    return f"""totals AS (
      SELECT {_money("value", "total_value")}, count(*) FILTER (current) AS q,
        count(*) FILTER (close IS NULL) AS undated FROM {source} WHERE is_open
    ), leader AS (
      SELECT coalesce(stage, 'Unknown') AS stage, {_money("value", "stage_value")} FROM {source} WHERE is_open
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1
    ), top5 AS (
      SELECT {_money("value", "held")}, count(*) AS held_count FROM
        (SELECT value FROM {source} WHERE is_open ORDER BY value DESC, id LIMIT 5)
    ), share AS (
      SELECT *, held / greatest(total_value, 1.0) * 100 AS pct, (SELECT count(*) FROM {source}) AS everything
      FROM totals, top5
    ), given AS (
      SELECT 1 AS nr, printf('Most active pipeline value sits in ''%s'' stage (%.0f%% of total).', stage,
        stage_value / greatest(total_value, 1.0) * 100) AS insight
        FROM leader, totals WHERE stage_value / greatest(total_value, 1.0) * 100 > 40
      UNION ALL SELECT 2, 'Only ' || q || ' opportunities are expected to close this quarter, limiting near-term volume.'
        FROM share
      UNION ALL SELECT 3, undated || ' opportunities have no close date, lowering Q3/Q4 forecasting accuracy.'
        FROM share WHERE undated > 0
      UNION ALL SELECT 4, printf('Pipeline heavily concentrated in top 5 opportunities (%.0f%% of total active value).', pct)
        FROM share WHERE held_count > 0 AND pct > 50
      UNION ALL SELECT 5, 'Revenue forecast confidence: ' || CASE WHEN undated = 0 THEN 'High'
        WHEN undated / greatest(everything, 1) * 100 <= 30 THEN 'Medium' ELSE 'Low' END || '.' FROM share
    ), insights AS (SELECT CAST(row_number() OVER (ORDER BY nr) AS INTEGER) AS rank, insight FROM given)"""


_UNPARSED = """(SELECT coalesce(max(count), 0) FROM deals_meta
  WHERE metric = 'missing_field' AND field = 'expected_close_date')"""


# --- reports as (section, metric, key, value, detail) ---


def _rows(section: str, source: str, key: str, measures: dict[str, str], detail: str = "NULL") -> str:
    """One SELECT per measure over the same source."""
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, '{metric}' AS metric, CAST({key} AS VARCHAR) AS key, "
        f"CAST({value} AS DOUBLE) AS value, CAST({detail} AS VARCHAR) AS detail FROM ({source})"
        for metric, value in measures.items()
    )


def _same(*names: str) -> dict[str, str]:
    return {name: name for name in names}


def _kpis(deals: str, orders: str, weighted: str, delayed: str) -> str:
    return f"""SELECT 'total_pipeline' AS kpi, {_money("value", "value")}, 'Total value of all open deals' AS description
        FROM {deals} WHERE is_open
      UNION ALL SELECT 'weighted_pipeline', {_money(weighted)}, 'Risk-adjusted active value' FROM {deals} WHERE is_open
      UNION ALL SELECT 'open_opportunities', CAST(count(*) AS DOUBLE), 'Active sales opportunities' FROM {deals} WHERE is_open
      UNION ALL SELECT 'current_quarter_pipeline', {_money(_when("current"))},
        'Forecasted to close in Q3 (' || count(*) FILTER (current) || ' deals)' FROM {deals} WHERE is_open
      UNION ALL SELECT 'completed_work_orders', CAST(count(*) AS DOUBLE), 'Successfully delivered contracts'
        FROM {orders} WHERE category = 'Completed'
      UNION ALL SELECT 'delayed_work_orders', CAST(count(*) AS DOUBLE), 'Projects experiencing execution delays'
        FROM {orders} WHERE {delayed}"""


def _charts(
    deals: str = "facts", orders: str = "judged", weighted: str = "weighted", pct: str = "pct", unknown: str | None = None
) -> list[str]:
    label = f"coalesce(stage, '{unknown}')" if unknown else "stage"
    stages = f"""SELECT {label} AS stage, {_money("value", "value")}, count(*) AS count FROM {deals}
      WHERE is_open AND {label} IS NOT NULL GROUP BY 1"""
    return [
        _rows("pipeline_stage", stages, "stage", _same("value", "count")),
        _rows("revenue_forecast", _forecast(weighted, deals), "month", _same("unweighted_value", "weighted_value", "deal_count")),
        _rows("work_orders", _order_status(orders), "status", _same("count")),
        _rows("top_deals", _TOP.format(source=deals), "name", _same("value"), "stage || ', ' || expected_close_date"),
        _rows("probability_distribution", _closure(pct, deals), "range", _same("count")),
        _rows("opportunity_distribution", _distribution(deals), "name", {"count": "value"}),
    ]


def _filtered_quality(deals: str, orders: str) -> str:
    def check(name: str, count: str, total: str, tolerated: float) -> str:
        return f"""SELECT '{name}' AS "check", {count} AS count, CASE WHEN {count} = 0 THEN 'green'
          WHEN {count} / greatest({total}, 1) <= {tolerated} THEN 'yellow' ELSE 'red' END AS status"""

    total_deals, total_orders = f"(SELECT count(*) FROM {deals})", f"(SELECT count(*) FROM {orders})"
    undated = f"(SELECT count(*) FROM {deals} WHERE is_open AND close IS NULL)"
    dropped = "(SELECT max(count) FROM deals_meta WHERE metric = 'dropped_rows')"
    return " UNION ALL ".join(
        [
            check("missing_close_dates", undated, total_deals, 0.3),
            check("missing_owners", f"(SELECT count(*) FROM {deals} WHERE owner IS NULL)", total_deals, 0.3),
            check("missing_status", f"(SELECT count(*) FROM {orders} WHERE status IS NULL)", total_orders, 0.1),
            f"SELECT 'duplicate_deals', {dropped}, CASE WHEN {dropped} = 0 THEN 'green' ELSE 'yellow' END",
            "SELECT 'invalid_values', 0, 'green'",
            "SELECT 'missing_columns', 0, 'green'",
        ]
    )


def _quality_rows(source: str) -> str:
    return _rows("data_quality", source, '"check"', _same("count"), "status")


_INSIGHT_ROWS = _rows("insights", "SELECT * FROM insights", "rank", {"insight": "NULL"}, "insight")


def _dashboard() -> str:
    sections = [
        _rows("kpis", _kpis("facts", "judged", "weighted", "category = 'Delayed'"), "kpi", _same("value"), "description"),
        *_charts(),
        _INSIGHT_ROWS,
        _quality_rows("SELECT * FROM quality"),
    ]
    return _meta("," + _insights("facts", _UNPARSED) + " UNION ALL ".join(sections))


def _filtered_dashboard(found: str, found_orders: str) -> str:
    sections = [
        _rows(
            "kpis",
            _kpis("found", "found_orders", "weighted_browser",
                  f"category = 'Delayed' OR (category <> 'Completed' AND coalesce(due < {AS_OF}, false))"),
            "kpi", _same("value"), "description",
        ),
        *_charts("found", "found_orders", "weighted_browser", "pct_browser", "Unknown"),
        _INSIGHT_ROWS,
        _quality_rows(_filtered_quality("found", "found_orders")),
    ]
    ctes = f", found AS ({found}), found_orders AS ({found_orders}), " + _insights_filtered("found")
    return _meta(ctes + " UNION ALL ".join(sections))


def _delayed_detail() -> str:
    return "name || ' | ' || status || ' | ' || sector || ' | ' || due_date || ' | ' || assigned_to"


def _leadership() -> str:
    revenue = {"revenue": "revenue"}
    sections = [
        _rows("business_overview", _OVERVIEW, "NULL", _same(
            "total_revenue", "won_deals_count", "total_pipeline_value", "weighted_pipeline_value", "active_deals_count",
            "total_work_orders", "completed_work_orders", "delayed_work_orders", "active_work_orders", "delay_rate")),
        _rows("pipeline_health", f"SELECT {_HEALTH} FROM facts WHERE is_open", "NULL", _same(
            "total_pipeline_value", "weighted_pipeline_value", "deal_count", "current_quarter_pipeline_value",
            "current_quarter_deal_count", "deals_without_close_date_count")),
        _rows("revenue_by_sector", _REVENUE_BY_SECTOR, "sector", revenue),
        _rows("revenue_by_month", _REVENUE_BY_MONTH, "month", revenue),
        _rows("sector_analysis", _SECTORS, "sector", _same(
            "total_value", "won_value", "active_value", "deal_count", "won_count", "wo_total", "wo_completed",
            "wo_delayed", "wo_in_progress")),
        _rows("delayed_by_sector", _DELAYED_BY.format(column="sector"), "sector", _same("count")),
        _rows("delayed_by_assignee", _DELAYED_BY.format(column="assigned_to"), "assigned_to", _same("count")),
        _rows("delayed_items", f"SELECT {_DELAYED_ITEM} FROM judged WHERE delayed", "id", {"item": "NULL"}, _delayed_detail()),
        _rows("monthly_forecast", _MONTHLY, "month", _same("unweighted_value", "weighted_value", "deal_count")),
        *_charts(),
        _rows("data_completeness", "SELECT count(*) = 0 AS ok FROM meta WHERE metric = 'missing_field'", "NULL",
              {"is_complete": "CAST(ok AS INTEGER)"}),
        _rows("missing_data_notes", "SELECT * FROM notes", "concat_ws('/', board, field)", {"note": "NULL"}, "note"),
        _rows("metadata", "SELECT * FROM meta", "concat_ws('/', board, metric, field)", _same("count")),
    ]
    return _meta(" UNION ALL ".join(sections))


_REVENUE_BY_SECTOR = f"""SELECT sector, {_money("value", "revenue")} FROM facts
  WHERE stage = 'Won' AND sector IS NOT NULL GROUP BY sector"""
_REVENUE_BY_MONTH = f"""SELECT coalesce({_MONTH}, 'Unknown') AS month, {_money("value", "revenue")} FROM facts
  WHERE stage = 'Won' GROUP BY 1"""
_DELAYED_BY = """SELECT coalesce({column}, 'Unassigned') AS {column}, count(*) AS count FROM judged
  WHERE delayed GROUP BY 1"""
_MONTHLY = f"""SELECT coalesce({_MONTH}, 'Missing Date') AS month, {_money("value", "unweighted_value")},
  {_money("weighted_raw", "weighted_value")}, count(*) AS deal_count FROM facts WHERE is_open GROUP BY 1"""

# --- cells of nested items ---

_CELLS = r"""
deal_cells AS (
  SELECT seq, id, name, seq // 2 AS k, unnest([
      {'nr': 1, 'title': CASE WHEN seq // 2 % 2 = 0 THEN 'Sector' ELSE 'Sector/service' END, 'text': sector},
      {'nr': CASE WHEN seq // 2 % 13 = 0 THEN 2 END, 'title': 'Stage', 'text': 'Lead'},
      {'nr': 3, 'title': ' Stage', 'text': stage},
      {'nr': 4, 'title': 'Masked Deal value', 'text': value},
      {'nr': 5, 'title': 'Probability', 'text': probability},
      {'nr': 6, 'title': 'Expected Close Date', 'text': expected_close_date},
      {'nr': CASE WHEN seq // 2 % 11 = 0 THEN 7 END, 'title': 'Owner', 'text': 'Former Rep'},
      {'nr': 8, 'title': 'Owner code', 'text': owner}
    ]) AS cell FROM raw_deals
),
order_cells AS (
  SELECT l_shipdate, l_partkey, l_suppkey, l_extendedprice, id, name, unnest([
      {'nr': 1, 'title': 'Status', 'text': status},
      {'nr': 2, 'title': 'Work Order Date', 'text': start_date},
      {'nr': 3, 'title': 'Due Date', 'text': due_date},
      {'nr': 4, 'title': 'Sector/Service', 'text': sector},
      {'nr': 5, 'title': 'Assigned To', 'text': assigned_to}
    ]) AS cell FROM raw_orders
),
cells AS (
  SELECT 'Deals' AS board, seq, NULL AS shipped, NULL AS part, NULL AS supp, NULL AS price, id, name,
    cell.title AS title, cell.text AS text FROM deal_cells WHERE cell.nr IS NOT NULL
  UNION ALL
  SELECT 'Work Orders', NULL, l_shipdate, l_partkey, l_suppkey, l_extendedprice, id, name, cell.title, cell.text
  FROM order_cells
)"""

_PHRASES = """['Prepare the leadership brief', 'Compare pipeline versus delivery', 'Which fields have MISSING values?',
  'Show workload by assignee', 'Stage breakdown please', 'What are our largest accounts?',
  'Forecast for the coming months', 'Which jobs are overdue?', 'List every project',
  'How many opportunities are there?', 'How are sales going?', 'Good morning', ' Status ', 'how are we doing',
  'REPORT', 'Please stop the pipeline alerts']"""
_MESSAGES = f"""messages AS (
  SELECT user_id AS conversation_id, event_id AS turn, 'user' AS role, {_PHRASES}[event_id % 16 + 1] AS text FROM events
),
routed AS (
  SELECT conversation_id, turn, text,
    trim(lower(text)) IN ('status', 'how are we doing', 'performance', 'update', 'how''s things', 'report') AS is_ambiguous,
    CASE WHEN trim(lower(text)) IN ('status', 'how are we doing', 'performance', 'update', 'how''s things', 'report')
        THEN 'general_business_health'
      WHEN regexp_matches(lower(text), 'leadership|executive summary|weekly update') THEN 'leadership_summary'
      WHEN regexp_matches(lower(text), 'compare|versus|vs') THEN 'pipeline_vs_work_orders'
      WHEN regexp_matches(lower(text), 'data quality|governance|completeness|missing|error') THEN 'data_quality'
      WHEN regexp_matches(lower(text), 'owner|assignee|who owns|workload') THEN 'owner_analysis'
      WHEN regexp_matches(lower(text), 'stage|breakdown|funnel') THEN 'stage_breakdown'
      WHEN regexp_matches(lower(text), 'top|highest value|biggest|largest') THEN 'top_deals'
      WHEN regexp_matches(lower(text), 'forecast|expected close|months') THEN 'revenue_forecast'
      WHEN regexp_matches(lower(text), 'delayed|late|overdue|bottleneck') THEN 'delayed_work_orders'
      WHEN regexp_matches(lower(text), 'work order|project') THEN 'work_order_summary'
      WHEN regexp_matches(lower(text), 'opportunity|opportunities|deal count') THEN 'open_opportunities'
      WHEN regexp_matches(lower(text), 'pipeline|sales|commercial') THEN 'pipeline_summary'
      ELSE 'general_business_health' END AS route
  FROM messages
)"""


_QUESTION = """CASE WHEN is_ambiguous THEN 'Could you clarify if you want a Pipeline Summary, open opportunities count, '
  || 'delayed work orders details, or a general Leadership Summary?' END AS question"""


def _recent(source: str, n: int) -> str:
    return f"""SELECT conversation_id, turn, role, text FROM {source}
      QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) <= {n}"""


_CONVERSATIONS = "(SELECT conv_id AS conversation_id, turn, role, text FROM conversations)"
_CLEAN_DEALS = """SELECT id, name, sector, stage, value, probability,
  strftime(close, '%Y-%m-%d') AS expected_close_date, owner FROM deals"""
_CLEAN_ORDERS = """SELECT id, name, status, strftime(start, '%Y-%m-%d') AS start_date,
  strftime(due, '%Y-%m-%d') AS due_date, sector, assigned_to FROM work_orders"""
_PARSED_SPELLINGS = r"""WITH written AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderdate AS day, o_orderkey % 14 AS kind,
    CASE o_orderkey % 14 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
      WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y')
      WHEN 4 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 5 THEN strftime(o_orderdate, '%Y%m%d')
      WHEN 6 THEN strftime(o_orderdate, '%b %-d, %Y') WHEN 7 THEN strftime(o_orderdate, '%-d %B %Y')
      WHEN 8 THEN strftime(o_orderdate, '%B %Y') WHEN 9 THEN strftime(o_orderdate, '%d/%m/%y')
      WHEN 10 THEN strftime(o_orderdate, '%Y-%m') WHEN 11 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
      WHEN 12 THEN 'due ' || strftime(o_orderdate, '%d') ELSE strftime(o_orderdate, '%Y%m-%d-') END AS written
  FROM orders
)
SELECT id, written, strftime(CASE
    WHEN kind IN (2, 4, 9) AND day(day) <= 12 THEN make_date(year(day), day(day), month(day))
    WHEN kind IN (8, 10) THEN CAST(date_trunc('month', day) AS DATE)
    WHEN kind IN (12, 13) THEN NULL ELSE CAST(day AS DATE) END, '%Y-%m-%d') AS parsed
FROM written"""

# Fields of each board's specification that have no title on the first item of the other board.
_ABSENT = f"""{_RAW}, {_CELLS},
titles(board, field, title) AS (VALUES
  ('Deals', 'sector', 'Sector'), ('Deals', 'sector', 'Sector/service'), ('Deals', 'sector', 'service'), ('Deals', 'stage', 'Stage'),
  ('Deals', 'stage', 'Deal Stage'), ('Deals', 'value', 'Value'), ('Deals', 'value', 'Deal Value'), ('Deals', 'value', 'Masked Deal value'),
  ('Deals', 'probability', 'Probability'), ('Deals', 'expected_close_date', 'Expected Close Date'), ('Deals', 'owner', 'Owner'),
  ('Deals', 'owner', 'Owner code'), ('Work Orders', 'status', 'Status'), ('Work Orders', 'start_date', 'Work Order Date'),
  ('Work Orders', 'due_date', 'Due Date'), ('Work Orders', 'sector', 'Sector'), ('Work Orders', 'sector', 'Sector/service'),
  ('Work Orders', 'assigned_to', 'Assignee'), ('Work Orders', 'assigned_to', 'Assigned To')),
first_titles AS (SELECT board, lower(trim(title)) AS title FROM cells
  QUALIFY dense_rank() OVER (PARTITION BY board ORDER BY seq, shipped, part, supp, price) = 1),
absent AS (SELECT t.board, t.field FROM titles t LEFT JOIN first_titles f ON f.board <> t.board AND f.title = lower(t.title)
  GROUP BY 1, 2 HAVING count(f.title) = 0)"""

ORACLES: dict[str, str] = {
    "scan_board_pages": _raw("""SELECT (row_number() OVER (ORDER BY seq) - 1) // 100 AS page, id, name,
        7 - 1 + CASE WHEN seq // 2 % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN seq // 2 % 11 = 0 THEN 1 ELSE 0 END AS cells,
        'Owner code' AS title, owner AS text FROM raw_deals"""),
    "load_boards": _raw("""SELECT 'Deals' AS board, id, name FROM raw_deals
        UNION ALL SELECT 'Work Orders', id, name FROM raw_orders"""),
    "page_chain": _raw("""SELECT board, pages, 0::BIGINT AS least, pages - 1 AS greatest, 1::BIGINT AS first_pages,
        1::BIGINT AS last_pages, 0::BIGINT AS missing_pages, 0::BIGINT AS repeated_pages, 0::BIGINT AS unreadable_pages
        FROM (SELECT 'Deals' AS board, (count(*) + 99) // 100 AS pages FROM raw_deals
          UNION ALL SELECT 'Work Orders', (count(*) + 99) // 100 FROM raw_orders)"""),
    "damaged_pages": _raw("""SELECT 'Deals' AS board, 'page_items' AS metric, CAST(page AS VARCHAR) AS field, "count"
        FROM (SELECT page, count(*) AS "count", max(page) OVER () AS last
          FROM (SELECT (row_number() OVER (ORDER BY seq) - 1) // 100 AS page FROM raw_deals) GROUP BY page)
        WHERE page % 7 <> 3 AND page < last
        UNION ALL SELECT 'Deals', 'unreadable_pages', NULL, 0
        UNION ALL SELECT 'Deals', 'missing_pages', NULL, 1 + count(DISTINCT page) FILTER (page % 7 = 3 AND page < kept)
          FROM (SELECT page, max(page) FILTER (page % 7 <> 3 AND page < last) OVER () AS kept FROM (
            SELECT DISTINCT (row_number() OVER (ORDER BY seq) - 1) // 100 AS page, (count(*) OVER () - 1) // 100 AS last FROM raw_deals))"""),
    "scan_tables": _clean("""SELECT 'Deals' AS board, id, name, sector, stage, value, probability,
          strftime(close, '%Y-%m-%d') AS expected_close_date, owner, NULL AS status, NULL AS start_date, NULL AS due_date,
          NULL AS assigned_to FROM deals
        UNION ALL SELECT 'Work Orders', id, name, sector, NULL, NULL, NULL, NULL, NULL, status, strftime(start, '%Y-%m-%d'),
          strftime(due, '%Y-%m-%d'), assigned_to FROM work_orders"""),
    "laid_out_deals": _clean(_CLEAN_DEALS + """ WHERE owner = 'Rep 7'
        AND close BETWEEN DATE '1996-03-15' AND DATE '1997-08-20' AND id IN (SELECT id FROM facts WHERE fp BETWEEN 0 AND 100)"""),
    "laid_out_work_orders": _clean(_CLEAN_ORDERS + " WHERE status = 'Completed' AND due <= DATE '1995-06-15'"),
    "board_columns": f"""WITH {_RAW}, {_CELLS} SELECT board, 'col_' || replace(lower(title), ' ', '_') AS column_id,
        trim(title) AS title, count(*) FILTER (trim(text) <> '') AS items_with_value FROM cells GROUP BY 1, 2, 3""",
    "sample_items": f"""WITH {_RAW}, {_CELLS} SELECT board, id, name, title, text, '"' || text || '"' AS value FROM cells
        QUALIFY dense_rank() OVER (PARTITION BY board ORDER BY seq, shipped, part, supp, price) <= 3""",
    "write_records": _clean(_CLEAN_DEALS),
    "write_csv": _clean(_CLEAN_ORDERS + " WHERE status = 'In Progress'"),
    "write_csv_deals": f"""WITH {_FILTERED} SELECT id, name, sector, stage, value, probability,
        strftime(close, '%Y-%m-%d') AS expected_close_date, owner FROM found""",
    "flatten_items": _raw("""SELECT seq, id, name, trim(sector) AS sector, trim(stage) AS stage, trim(value) AS value,
        trim(probability) AS probability, trim(expected_close_date) AS expected_close_date, trim(owner) AS owner,
        CAST(63 AS BIGINT) AS titles_present FROM raw_deals"""),
    "alias_resolution": _raw("SELECT seq, trim(sector) AS sector, trim(stage) AS stage, trim(owner) AS owner FROM raw_deals"),
    "missing_columns": f"WITH {_ABSENT} SELECT board, field FROM absent WHERE board = 'Deals'",
    "missing_columns_union": f"WITH {_ABSENT} SELECT DISTINCT field FROM absent",
    "dedupe_items": _clean("SELECT id, strftime(l_shipdate, '%Y-%m-%d') AS ship_date, due_date FROM first_orders"),
    "normalize_text": _raw(
        f"SELECT seq, {_filled('sector')} AS sector, {_filled('owner')} AS owner, {_filled('value')} AS value FROM raw_deals"
    ),
    "title_case": f"""SELECT p_partkey, {_title("upper(p_name) || ' 3rd o''' || p_brand || '/' || p_type")} AS titled FROM part""",
    "clean_sector": _raw(f"""SELECT seq, {_sector("t")} AS sector
        FROM (SELECT seq, {_title(_filled("sector"))} AS t FROM raw_deals)"""),
    "clean_stage": _raw(f"""SELECT seq, {_stage("t")} AS stage
        FROM (SELECT seq, {_title(_filled("stage"))} AS t FROM raw_deals)"""),
    "clean_status": _raw(f"""SELECT {_status("t")} AS status, count(*) AS count
        FROM (SELECT {_title(_filled("status"))} AS t FROM raw_orders) GROUP BY 1"""),
    "parse_date": _PARSED_SPELLINGS,
    "parse_number": _raw(f"SELECT seq, {_number('value')} AS value, {_number('probability')} AS probability FROM raw_deals"),
    "count_missing": _meta("SELECT board, field, count FROM meta WHERE metric = 'missing_field'"),
    "clean_board_meta": _meta("SELECT * FROM meta"),
    "clean_deals": _clean(_CLEAN_DEALS),
    "clean_work_orders": _clean(_CLEAN_ORDERS),
    "empty_board": _clean(f"SELECT {_HEALTH} FROM facts WHERE id = ''"),
    "is_open": _clean("SELECT id, is_open FROM facts"),
    "is_won_is_lost": _clean("SELECT id, coalesce(stage = 'Won', false) AS is_won, coalesce(stage = 'Lost', false) AS is_lost FROM facts"),
    "is_overdue": _clean("SELECT id, overdue AS is_overdue FROM judged"),
    "is_delayed": _clean("SELECT id, delayed AS is_delayed FROM judged"),
    "in_quarter": _clean("SELECT id, close BETWEEN DATE '2000-07-01' AND DATE '2000-09-30' AS in_quarter FROM facts"),
    "no_close_date": _clean("SELECT id, close IS NULL AS no_close_date FROM facts"),
    "close_month": _clean(f"SELECT id, coalesce({_MONTH}, 'Missing Date') AS month FROM facts"),
    "stage_probability": _clean("SELECT id, stage_pct AS percent FROM facts"),
    "weighted_value": _clean("SELECT id, round(weighted, 4) AS weighted FROM facts"),
    "weighted_value_raw": _clean("SELECT id, round(weighted_raw, 4) AS weighted FROM facts"),
    "weighted_value_interactive": _clean("SELECT id, round(weighted_browser, 4) AS weighted FROM facts"),
    "probability_pct": _clean("SELECT id, pct AS percent FROM facts"),
    "probability_bucket": _clean(f"SELECT id, {_bucket('pct')} AS bucket FROM facts"),
    "delivery_category": _clean("SELECT id, category FROM judged"),
    "label_unassigned": _clean("SELECT id, coalesce(assigned_to, 'Unassigned') AS assigned_to FROM work_orders"),
    "filter_deals": f"""WITH {_FILTERED} SELECT id, name, sector, stage, value, probability,
        strftime(close, '%Y-%m-%d') AS expected_close_date, owner FROM found""",
    "filter_work_orders": _clean(_CLEAN_ORDERS + """ WHERE contains(lower(name), 'wo ')
        AND assigned_to = 'Supplier#000000007' AND status = 'In Progress'
        AND due BETWEEN DATE '2000-02-01' AND DATE '2001-01-31'"""),
    "pipeline_health": _clean(f"SELECT {_HEALTH} FROM facts WHERE is_open"),
    "pipeline_stage_totals": _clean(_STAGE_TOTALS),
    "revenue_total": _clean(
        f"SELECT {_money('value', 'total_revenue')}, count(*) AS won_deals_count FROM facts WHERE stage = 'Won'"
    ),
    "revenue_by_sector": _clean(_REVENUE_BY_SECTOR),
    "revenue_by_month": _clean(_REVENUE_BY_MONTH),
    "sector_analysis": _clean(_SECTORS),
    "delayed_count": _clean("SELECT count(*) AS total_delayed_count FROM judged WHERE delayed"),
    "delayed_items": _clean(f"SELECT {_DELAYED_ITEM} FROM judged WHERE delayed"),
    "delayed_by_sector": _clean(_DELAYED_BY.format(column="sector")),
    "delayed_by_assignee": _clean(_DELAYED_BY.format(column="assigned_to")),
    "monthly_forecast": _clean(_MONTHLY),
    "business_overview": _clean(_OVERVIEW),
    "opportunity_distribution": _clean(_distribution()),
    "stage_counts": _clean("SELECT stage, count(*) AS count FROM facts WHERE is_open AND stage IS NOT NULL GROUP BY stage"),
    "deals_by_owner": _clean(_OWNERS),
    "work_orders_by_assignee": _clean(_ASSIGNEES),
    "pipeline_diagnostics": _clean(f"""SELECT count(*) AS open_rows, {_money("value", "value_sum")},
        count(value) AS values_present, count(close) AS close_dates_present, count(*) FILTER (current) AS quarter_rows,
        {_money(_when("current"), "quarter_value")} FROM facts WHERE is_open"""),
    "mapping_profile": _clean("""SELECT DISTINCT 'sector' AS field, sector AS value FROM deals WHERE sector IS NOT NULL
        UNION ALL SELECT DISTINCT 'stage', stage FROM deals WHERE stage IS NOT NULL
        UNION ALL SELECT DISTINCT 'owner', owner FROM deals WHERE owner IS NOT NULL"""),
    "pipeline_stage": _clean(_STAGE_TOTALS),
    "revenue_forecast": _clean(_forecast()),
    "work_order_status": _clean(_order_status()),
    "top_deals": _clean(_TOP.format(source="facts")),
    "closure_probability": _clean(_closure()),
    "top5_share": _clean(f"""SELECT top_value, total_value, top_value / greatest(total_value, 1.0) * 100 AS pct FROM
        (SELECT {_money("value", "top_value")} FROM (SELECT value FROM facts WHERE is_open ORDER BY value DESC, id LIMIT 5)),
        (SELECT {_money("value", "total_value")} FROM facts WHERE is_open)"""),
    "filter_options": _clean("""SELECT 'owner' AS option, v AS value FROM
          (SELECT owner AS v FROM deals UNION SELECT assigned_to FROM work_orders) WHERE v IS NOT NULL
        UNION ALL SELECT DISTINCT 'stage', stage FROM deals WHERE stage IS NOT NULL
        UNION ALL SELECT DISTINCT 'status', status FROM work_orders WHERE status IS NOT NULL"""),
    "all_sectors": _clean("""SELECT sector FROM (SELECT sector FROM deals UNION SELECT sector FROM work_orders)
        WHERE sector IS NOT NULL"""),
    "data_quality": _meta("""SELECT "check", count, status, '' AS details FROM quality"""),
    "data_quality_filtered": _meta(f""", found AS (SELECT * FROM facts WHERE contains(lower(name), 'order 1') AND fp <= 100),
        found_orders AS (SELECT * FROM judged WHERE contains(lower(name), 'wo 1'))
        SELECT *, '' AS details FROM ({_filtered_quality("found", "found_orders")})"""),
    "quality_labels": _meta("""SELECT "check", status, CASE status WHEN 'green' THEN 'Healthy' WHEN 'yellow' THEN 'Warning'
        ELSE 'Critical' END AS label FROM quality"""),
    "quality_overall": _meta("""SELECT bool_and(status = 'green') AS all_healthy, CASE WHEN bool_or(status = 'red')
        THEN 'Critical' WHEN bool_or(status = 'yellow') THEN 'Warning' ELSE 'Healthy' END AS label FROM quality"""),
    "missing_data_notes": _meta("""SELECT row_number() OVER (ORDER BY board, field IS NULL, coalesce(list_position(
          ['sector', 'stage', 'value', 'probability', 'expected_close_date', 'owner'], field) + CASE WHEN board = 'Deals' THEN 0 END,
          list_position(['status', 'start_date', 'due_date', 'sector', 'assigned_to'], field)))::INT AS rank, * FROM notes"""),
    "data_completeness": _meta("SELECT count(*) = 0 AS is_complete FROM meta WHERE metric = 'missing_field'"),
    "value_complete": _meta("SELECT count(*) = 0 AS is_complete FROM meta WHERE board = 'Deals' AND field = 'value'"),
    "forecast_confidence": _meta(f"""SELECT CASE WHEN pct = 0 THEN 'High' WHEN pct <= 30 THEN 'Medium' ELSE 'Low' END
        AS confidence, round(pct, 6) AS pct_missing FROM (SELECT {_UNPARSED} / greatest(
        (SELECT count(*) FROM facts WHERE is_open), 1) * 100 AS pct)"""),
    "forecast_confidence_filtered": _clean("""SELECT CASE WHEN pct = 0 THEN 'High' WHEN pct <= 30 THEN 'Medium' ELSE 'Low'
        END AS confidence, round(pct, 6) AS pct_missing FROM (SELECT count(*) FILTER (is_open AND close IS NULL)
        / count(*) * 100 AS pct FROM facts WHERE contains(lower(name), 'order 1') AND fp <= 100)"""),
    "insights": _meta("," + _insights("facts", _UNPARSED) + " SELECT * FROM insights"),
    "insights_filtered": f"WITH {_FILTERED}, {_insights_filtered('found')} SELECT * FROM insights",
    "dashboard_kpis": _clean(_kpis("facts", "judged", "weighted", "category = 'Delayed'")),
    "dashboard": _dashboard(),
    "filtered_dashboard": _filtered_dashboard(
        """SELECT * FROM facts WHERE contains(lower(name), '11') AND fp BETWEEN 10 AND 80
           AND close BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'""",
        """SELECT * FROM judged WHERE contains(lower(name), '11')
           AND due BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'""",
    ),
    "filtered_dashboard_defaults": _filtered_dashboard(
        "SELECT * FROM facts WHERE fp BETWEEN 0 AND 100", "SELECT * FROM judged"
    ),
    "leadership_summary": _leadership(),
    "pipeline_summary": _clean(f"SELECT {_HEALTH} FROM facts WHERE is_open"),
    "open_opportunities": _clean(
        _rows("open_opportunities", "SELECT count(*) AS count FROM facts WHERE is_open", "NULL", _same("count"))
        + " UNION ALL " + _rows("opportunities_by_stage", _STAGE_TOTALS, "stage", _same("count"))
    ),
    "top_deals_query": _clean(_TOP.format(source="facts")),
    "delayed_work_orders": _clean(
        _rows("delayed_work_orders", "SELECT count(*) AS count FROM judged WHERE delayed", "NULL", _same("count"))
        + " UNION ALL "
        + _rows("delayed_items", f"SELECT {_DELAYED_ITEM} FROM judged WHERE delayed", "id", {"item": "NULL"}, _delayed_detail())
    ),
    "work_order_summary": _clean(
        _rows("total_work_orders", "SELECT count(*) AS count FROM judged", "NULL", _same("count"))
        + " UNION ALL " + _rows("status_distribution", _order_status(), "status", _same("count"))
    ),
    "revenue_forecast_query": _clean(_forecast()),
    "pipeline_vs_work_orders": _clean(f"""SELECT deal_count AS active_deals_count,
        total_pipeline_value AS active_pipeline_value, completed_category AS completed_projects_count,
        delayed_category AS delayed_projects_count,
        round(deal_count / greatest(completed_category, 1), 2) AS deals_to_delivery_ratio
        FROM (SELECT {_HEALTH} FROM facts WHERE is_open), (SELECT {_DELIVERY} FROM judged)"""),
    "data_quality_query": _meta("""SELECT "check", count, status, '' AS details FROM quality"""),
    "owner_analysis": _clean(
        _rows("deals_by_owner", _OWNERS, "owner", _same("value", "count"))
        + " UNION ALL " + _rows("work_orders_by_assignee", _ASSIGNEES, "assigned_to", _same("total_count", "delayed_count"))
    ),
    "stage_breakdown": _clean(_STAGE_TOTALS),
    "general_business_health": _clean(f"""SELECT
        (SELECT {_money("value")} FROM facts WHERE stage = 'Won') AS realized_revenue,
        (SELECT {_money("value")} FROM facts WHERE is_open) AS active_pipeline,
        count(*) FILTER (category = 'Completed') AS completed_projects,
        count(*) FILTER (category = 'Delayed') AS delayed_projects FROM judged"""),
    "route_messages": f"WITH {_MESSAGES} SELECT conversation_id, turn, text, is_ambiguous, {_QUESTION}, route FROM routed",
    "route_conversations": f"""WITH {_MESSAGES.replace(" FROM events", " FROM events WHERE false UNION ALL SELECT conv_id, turn, role, text FROM conversations")}
        SELECT conversation_id, turn, text, is_ambiguous, {_QUESTION}, route FROM routed""",
    "route_volume": f"WITH {_MESSAGES} SELECT route, count(*) AS count FROM routed GROUP BY route",
    "recent_turns": f"WITH {_MESSAGES} {_recent('messages', 20)}",
    "recent_turns_archive": f"WITH {_MESSAGES} {_recent('messages', 5000)}",
    "recent_turns_routing": _recent(_CONVERSATIONS, 3),
    "recent_turns_answer": _recent(_CONVERSATIONS, 5),
}

# Landed in batches or read at once: the same rows.
ORACLES |= {f"{name}_landed": ORACLES[name] for name in ("sector_analysis", "deals_by_owner", "work_orders_by_assignee")}


def _chart(name: str, source: str, key: str, order: str, *measures: str) -> str:
    numbered = f"SELECT *, (row_number() OVER (ORDER BY {order}))::INT AS rank FROM ({source})"
    rows = [f"SELECT '{name}' AS chart, rank, '{m}' AS metric, {key} AS key, {m}::DOUBLE AS value FROM ({numbered})" for m in measures]
    return " UNION ALL ".join(rows)


# Charts of each route, as the fixed table of the plan names them.
_CHARTS = {
    "pipeline_stage": _chart("pipeline_stage", ORACLES["pipeline_stage"], "stage", "value DESC, stage", "value", "count"),
    "revenue_forecast": _chart("revenue_forecast", ORACLES["revenue_forecast"], "month", "month", "unweighted_value", "weighted_value", "deal_count"),
    "opportunity_distribution": _chart(
        "opportunity_distribution", ORACLES["opportunity_distribution"], "name", "list_position(['Open', 'Won', 'Lost'], name)", "value"
    ),
    "work_orders": _chart(
        "work_orders", ORACLES["work_order_status"], "status",
        "list_position(['Completed', 'In Progress', 'Pending', 'Delayed', 'Cancelled'], status)", "count",
    ),
    "top_deals": _chart(
        "top_deals", _clean("SELECT id, name, value FROM facts WHERE is_open ORDER BY value DESC, id LIMIT 10"), "name", "value DESC, id", "value"
    ),
}
_SHOWN = (
    ("pipeline_summary", "pipeline_stage"), ("pipeline_summary", "revenue_forecast"),
    ("open_opportunities", "pipeline_stage"), ("open_opportunities", "opportunity_distribution"),
    ("top_deals", "top_deals"), ("delayed_work_orders", "work_orders"), ("work_order_summary", "work_orders"),
    ("revenue_forecast", "revenue_forecast"), ("pipeline_vs_work_orders", "pipeline_stage"),
    ("pipeline_vs_work_orders", "work_orders"), ("stage_breakdown", "pipeline_stage"),
)
ORACLES["answer_charts"] = " UNION ALL ".join(
    f"SELECT '{route}' AS route, chart, rank, metric, key, value FROM ({_CHARTS[chart]})" for route, chart in _SHOWN
)
_ROUTES = (
    "pipeline_summary open_opportunities top_deals delayed_work_orders work_order_summary revenue_forecast leadership_summary "
    "pipeline_vs_work_orders data_quality owner_analysis stage_breakdown general_business_health"
).split()
_COMPLETE = {"pipeline_summary": "value_complete", "leadership_summary": "data_completeness"}
ORACLES["answer_completeness"] = " UNION ALL ".join(
    f"SELECT '{r}' AS route, " + (f"(SELECT is_complete FROM ({ORACLES[_COMPLETE[r]]}))" if r in _COMPLETE else "true") + " AS data_complete"
    for r in _ROUTES
)


_HEALTH_COLUMNS = (
    "total_pipeline_value weighted_pipeline_value deal_count current_quarter_pipeline_value current_quarter_deal_count "
    "deals_without_close_date_count"
).split()
_RATIO_COLUMNS = (
    "active_deals_count active_pipeline_value completed_projects_count delayed_projects_count deals_to_delivery_ratio"
).split()
_BUSINESS_COLUMNS = "realized_revenue active_pipeline completed_projects delayed_projects".split()
_ANSWER_ROWS = {
    route: f"SELECT section, metric, key, value, detail FROM ({ORACLES[route]})"
    for route in ("open_opportunities", "delayed_work_orders", "work_order_summary", "leadership_summary", "owner_analysis")
} | {
    "pipeline_summary": _rows("pipeline_summary", ORACLES["pipeline_summary"], "NULL", _same(*_HEALTH_COLUMNS)),
    "top_deals": _rows("top_deals", ORACLES["top_deals_query"], "name", _same("value"), "stage"),
    "revenue_forecast": _rows(
        "revenue_forecast", ORACLES["revenue_forecast_query"], "month", _same("unweighted_value", "weighted_value", "deal_count")
    ),
    "pipeline_vs_work_orders": _rows("pipeline_vs_work_orders", ORACLES["pipeline_vs_work_orders"], "NULL", _same(*_RATIO_COLUMNS)),
    "data_quality": _rows("data_quality", ORACLES["data_quality_query"], '"check"', _same("count"), "status"),
    "stage_breakdown": _rows("stage_breakdown", ORACLES["stage_breakdown"], "stage", _same("value", "count")),
    "general_business_health": _rows(
        "general_business_health", ORACLES["general_business_health"], "NULL", _same(*_BUSINESS_COLUMNS)
    ),
}
ORACLES["whole_answers"] = " UNION ALL ".join(
    [
        *(
            f"SELECT '{r}' AS route, 'answer' AS part, NULL::INT AS rank, section, metric, key, value, detail FROM ({_ANSWER_ROWS[r]})"
            for r in _ROUTES
        ),
        f"""SELECT route, 'chart' AS part, rank, chart AS section, metric, key, value, NULL AS detail
            FROM ({ORACLES["answer_charts"]})""",
        f"""SELECT route, 'data_complete' AS part, NULL AS rank, 'data_complete' AS section, 'data_complete' AS metric, NULL AS key,
            data_complete::INT::DOUBLE AS value, NULL AS detail FROM ({ORACLES["answer_completeness"]})""",
        f"""SELECT 'leadership_summary' AS route, 'note' AS part, rank, 'missing_data_notes' AS section, 'note' AS metric,
            concat_ws('/', board, field) AS key, NULL AS value, note AS detail FROM ({ORACLES["missing_data_notes"]})""",
    ]
)


def _answered(messages: str) -> str:
    shown = " ".join(
        f"WHEN '{route}' THEN '{', '.join(chart for r, chart in _SHOWN if r == route)}'" for route in dict(_SHOWN)
    )
    return f"""SELECT conversation_id, turn, text, is_ambiguous, question, route,
          coalesce(is_ambiguous, false) OR data_complete AS data_complete,
          CASE WHEN NOT coalesce(is_ambiguous, false) THEN CASE route {shown} ELSE '' END END AS charts,
          CASE WHEN NOT coalesce(is_ambiguous, false) THEN CASE route WHEN 'leadership_summary' THEN coalesce(
            (SELECT string_agg(note, ', ' ORDER BY rank) FROM ({ORACLES["missing_data_notes"]})), '') ELSE '' END END AS notes
        FROM ({messages}) LEFT JOIN ({ORACLES["answer_completeness"]}) USING (route)"""


ORACLES["answer_messages"] = _answered(ORACLES["route_messages"])
ORACLES["answer_conversations"] = _answered(ORACLES["route_conversations"])
