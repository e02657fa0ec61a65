"""The named queries as SQL for an independent engine.

Written from the meaning of each query, not from its Spark plan. Every name and
type matches the Spark result.
"""

from __future__ import annotations

from tidepath.plans.queries import BAND_EDGES, PERIOD, SOURCES, STATUSES
from tidepath.sources.tables import SCHEMAS

# The places of the given tables, as columns of the path matrix.
PLACES = tuple(f"NATION_{number}" for number in range(25))

_TRANSFERS = """
transfers AS (
    SELECT l_orderkey AS order_key, l_linenumber AS line_number, o_orderdate AS sent_at,
           o_custkey AS party, l_partkey AS asset, sender.n_name AS src,
           receiver.n_name AS dst, o_orderstatus AS status,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS amount
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation AS sender ON s_nationkey = sender.n_nationkey
    JOIN nation AS receiver ON c_nationkey = receiver.n_nationkey
    WHERE s_nationkey <> c_nationkey
)"""

_ACTIVE = """
active AS (
    SELECT party, date_trunc('month', sent_at) AS period,
           min(date_trunc('month', sent_at)) OVER (PARTITION BY party) AS cohort
    FROM transfers
    GROUP BY party, date_trunc('month', sent_at)
)"""

_VOLUME = "CAST(sum(amount) AS DOUBLE) AS volume"


def _with(*parts: str) -> str:
    *tables, select = parts
    return "WITH " + ",".join((_TRANSFERS, *tables)) + "\n" + select.strip()


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{value}'" for value in values)


def _by_period(unit: str) -> str:
    return _with(
        f"""
        SELECT CAST(date_trunc('{unit}', sent_at) AS TIMESTAMP) AS period,
               count(*) AS n, {_VOLUME}
        FROM transfers GROUP BY 1
        """
    )


def _by_place(side: str) -> str:
    return _with(
        f"""
        SELECT {side} AS place, count(*) AS n, {_VOLUME}, count(DISTINCT party) AS parties
        FROM transfers GROUP BY {side}
        """
    )


def _rank_places(side: str) -> str:
    return _with(
        f"""
        SELECT {side} AS place, {_VOLUME},
               CAST(rank() OVER (ORDER BY sum(amount) DESC) AS INTEGER) AS rank
        FROM transfers GROUP BY {side}
        """
    )


def _path_matrix() -> str:
    columns = ",\n".join(
        f"count(*) FILTER (WHERE dst = '{place}') AS \"{place}\"" for place in PLACES
    )
    return _with(f"SELECT src, {columns} FROM transfers GROUP BY src")


_LAST_EVENT = "(SELECT max(ts) FROM events)"

ORACLE: dict[str, str] = {
    "read_tables": "\nUNION ALL\n".join(
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) AS n, "
        f"count({column}) AS n_known FROM {table}"
        for table, schema in SCHEMAS.items()
        for column in schema.names
    ),
    "approx_parties_bound": _with(
        """
        SELECT count(DISTINCT party) AS parties, true AS within_bound FROM transfers
        """
    ),
    "transfers": _with(
        """
        SELECT order_key, line_number, sent_at, party, asset, src, dst, status,
               CAST(amount AS DOUBLE) AS amount
        FROM transfers
        """
    ),
    "transfers_filtered": _with(
        f"""
        SELECT order_key, line_number, sent_at, party, asset, src, dst, status,
               CAST(amount AS DOUBLE) AS amount
        FROM transfers
        WHERE sent_at >= TIMESTAMP '{PERIOD[0]}' AND sent_at < TIMESTAMP '{PERIOD[1]}'
          AND src IN ({_listed(SOURCES)}) AND status IN ({_listed(STATUSES)})
        """
    ),
    "totals": _with(
        f"""
        SELECT count(*) AS n, {_VOLUME}, count(DISTINCT party) AS parties,
               (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM transfers)) AS paths,
               CAST(max(amount) AS DOUBLE) AS max_amount
        FROM transfers
        """
    ),
    "by_period": _by_period("month"),
    "by_period_week": _by_period("week"),
    "by_period_day": _by_period("day"),
    "by_place": _by_place("src"),
    "by_place_dst": _by_place("dst"),
    "paths": _with(
        f"""
        SELECT src, dst, count(*) AS n, {_VOLUME},
               round(CAST(sum(amount) AS DOUBLE) * 100
                     / (SELECT CAST(sum(amount) AS DOUBLE) FROM transfers), 4) AS share_pct
        FROM transfers GROUP BY src, dst
        """
    ),
    "top_paths_per_period": _with(
        """
        ranked AS (
            SELECT CAST(date_trunc('month', sent_at) AS TIMESTAMP) AS period, src, dst,
                   sum(amount) AS volume,
                   row_number() OVER (PARTITION BY date_trunc('month', sent_at)
                                      ORDER BY sum(amount) DESC, src, dst) AS rank
            FROM transfers GROUP BY date_trunc('month', sent_at), src, dst
        )""",
        """
        SELECT period, src, dst, CAST(volume AS DOUBLE) AS volume,
               CAST(rank AS INTEGER) AS rank
        FROM ranked WHERE rank <= 3
        """,
    ),
    "write_overview": _with(
        f"""
        SELECT strftime(sent_at, '%Y-%m') AS month, src, dst, count(*) AS n, {_VOLUME}
        FROM transfers GROUP BY 1, src, dst
        """
    ),
    "sql_over_view": _with(
        f"""
        SELECT status, src, count(*) AS n, {_VOLUME}
        FROM transfers GROUP BY status, src
        """
    ),
    "daily_zero_filled": _with(
        """
        calendar AS (
            SELECT unnest(generate_series(min(date_trunc('day', sent_at)),
                                          max(date_trunc('day', sent_at)),
                                          INTERVAL 1 DAY)) AS day
            FROM transfers
        )""",
        """
        SELECT CAST(day AS TIMESTAMP) AS day, count(party) AS n
        FROM calendar LEFT JOIN transfers ON day = date_trunc('day', sent_at)
        GROUP BY day
        """,
    ),
    "cumulative": _with(
        """
        SELECT CAST(date_trunc('month', sent_at) AS TIMESTAMP) AS period,
               CAST(sum(sum(amount)) OVER (ORDER BY date_trunc('month', sent_at)) AS DOUBLE)
                   AS cum_volume
        FROM transfers GROUP BY date_trunc('month', sent_at)
        """
    ),
    "period_change": _with(
        """
        monthly AS (
            SELECT CAST(date_trunc('month', sent_at) AS TIMESTAMP) AS period, count(*) AS n
            FROM transfers GROUP BY 1
        )""",
        """
        SELECT period, CAST(n - lag(n) OVER (ORDER BY period) AS DOUBLE) AS diff_n,
               round(CAST(n - lag(n) OVER (ORDER BY period) AS DOUBLE) * 100
                     / lag(n) OVER (ORDER BY period), 4) AS diff_pct
        FROM monthly
        """,
    ),
    "rolling_7d": _with(
        """
        daily AS (
            SELECT CAST(date_trunc('day', sent_at) AS TIMESTAMP) AS day, count(*) AS n
            FROM transfers GROUP BY 1
        )""",
        """
        SELECT day, CAST(sum(n) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING
                                      AND CURRENT ROW) AS BIGINT) AS n_7d
        FROM daily
        """,
    ),
    "rank_places": _rank_places("src"),
    "rank_places_dst": _rank_places("dst"),
    "net_flow": _with(
        """
        sides AS (
            SELECT src AS place, amount AS out_amount, CAST(0 AS DECIMAL(18,2)) AS in_amount
            FROM transfers
            UNION ALL
            SELECT dst, CAST(0 AS DECIMAL(18,2)), amount FROM transfers
        )""",
        """
        SELECT place, CAST(sum(out_amount) AS DOUBLE) AS out_volume,
               CAST(sum(in_amount) AS DOUBLE) AS in_volume,
               CAST(sum(in_amount) - sum(out_amount) AS DOUBLE) AS net
        FROM sides GROUP BY place
        """,
    ),
    "region_subtotals": _with(
        f"""
        SELECT CASE WHEN GROUPING(r_name) = 1 THEN 'all' WHEN GROUPING(src) = 1 THEN 'region'
                    ELSE 'place' END AS level,
               r_name AS region, src AS place, count(*) AS n, {_VOLUME}
        FROM transfers
        LEFT JOIN nation ON src = n_name
        LEFT JOIN region ON n_regionkey = r_regionkey
        GROUP BY ROLLUP (r_name, src)
        """
    ),
    "path_matrix": _path_matrix(),
    "size_bands": _with(
        f"""
        SELECT CASE WHEN amount < {BAND_EDGES[0]} THEN 'small'
                    WHEN amount < {BAND_EDGES[1]} THEN 'middle'
                    ELSE 'large' END AS band,
               count(*) AS n, {_VOLUME}
        FROM transfers GROUP BY 1
        """
    ),
    "amount_quantiles": _with(
        """
        SELECT src, round(quantile_cont(CAST(amount AS DOUBLE), 0.5), 4) AS p50,
               round(quantile_cont(CAST(amount AS DOUBLE), 0.95), 4) AS p95
        FROM transfers GROUP BY src
        """
    ),
    "top_parties": _with(
        f"""
        SELECT party, {_VOLUME}, count(*) AS n
        FROM transfers GROUP BY party ORDER BY sum(amount) DESC, party LIMIT 20
        """
    ),
    "party_breadth": _with(
        """
        breadth AS (
            SELECT party, count(DISTINCT src || '>' || dst) AS paths
            FROM transfers GROUP BY party
        )""",
        "SELECT paths, count(*) AS parties FROM breadth GROUP BY paths",
    ),
    "status_by_month": _with(
        f"""
        SELECT CAST(date_trunc('month', sent_at) AS TIMESTAMP) AS period, status,
               count(*) AS n, {_VOLUME}
        FROM transfers GROUP BY 1, status
        """
    ),
    "new_and_returning": _with(
        _ACTIVE,
        """
        SELECT CAST(period AS TIMESTAMP) AS period,
               count(*) FILTER (WHERE period = cohort) AS "new",
               count(*) FILTER (WHERE period > cohort) AS "returning"
        FROM active GROUP BY period
        """,
    ),
    "cohort_retention": _with(
        _ACTIVE,
        """
        SELECT CAST(cohort AS TIMESTAMP) AS cohort,
               CAST(datediff('month', cohort, period) AS INTEGER) AS k, count(*) AS parties
        FROM active GROUP BY 1, 2
        """,
    ),
    "latest_per_key": """
        SELECT * EXCLUDE (place) FROM (
            SELECT *, row_number() OVER (
                PARTITION BY l_orderkey, l_linenumber
                ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC,
                         l_extendedprice DESC, l_discount DESC, l_tax DESC,
                         l_returnflag DESC, l_linestatus DESC) AS place
            FROM lineitem
        ) WHERE place = 1
        """,
    "weekday_hour": """
        SELECT CAST(dayofweek(ts) AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour,
               count(*) AS n
        FROM events GROUP BY 1, 2
        """,
    "asof_clicks": """
        SELECT p.event_id, p.user_id, p.ts, CAST(c.event_id AS DOUBLE) AS click_id,
               c.ts AS clicked_at
        FROM (SELECT * FROM events WHERE event_type = 'purchase') AS p
        ASOF LEFT JOIN (
            SELECT user_id, ts, max(event_id) AS event_id FROM events
            WHERE event_type = 'click' GROUP BY user_id, ts
        ) AS c ON p.user_id = c.user_id AND p.ts >= c.ts
        """,
    "asof_orders": """
        SELECT e.event_id, e.user_id, e.ts, CAST(o.order_key AS DOUBLE) AS order_key, o.ordered_at
        FROM events AS e
        ASOF LEFT JOIN (
            SELECT o_custkey, o_orderdate AS ordered_at, max(o_orderkey) AS order_key
            FROM orders GROUP BY o_custkey, o_orderdate
        ) AS o ON e.user_id = o.o_custkey AND e.ts > o.ordered_at
        """,
    "events_in_sessions": """
        WITH marked AS (
            SELECT user_id, ts,
                   CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
                                   + INTERVAL 6 HOUR
                        THEN 0 ELSE 1 END AS starts
            FROM events WHERE event_type = 'purchase'
        ), numbered AS (
            SELECT user_id, ts, sum(starts) OVER (
                PARTITION BY user_id ORDER BY ts
                RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session
            FROM marked
        ), bursts AS (
            SELECT user_id AS session_user, min(ts) AS session_start,
                   max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_session
            FROM numbered GROUP BY user_id, session
        )
        SELECT session_user, session_start, session_end, n_session, count(*) AS n_inside,
               CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value_inside
        FROM bursts
        JOIN events ON user_id = session_user AND ts >= session_start AND ts < session_end
        GROUP BY ALL
        """,
    "sketched_parties": _with(
        """
        SELECT CAST(date_trunc('month', sent_at) AS TIMESTAMP) AS period,
               count(DISTINCT party) AS parties, TRUE AS within_bound
        FROM transfers GROUP BY 1
        """
    ),
    "sketched_quantiles": _with(
        "SELECT src, count(amount) AS n, TRUE AS within_bound FROM transfers GROUP BY src"
    ),
    "idle_parties": _with(
        """
        SELECT c_custkey, c_nationkey FROM customer
        WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (
            SELECT party FROM transfers WHERE party IS NOT NULL
            AND sent_at >= TIMESTAMP '1998-01-01' AND sent_at < TIMESTAMP '1998-02-01')
        """
    ),
    "routes_lost": _with(
        """
        SELECT party, src, dst FROM transfers
        WHERE sent_at >= TIMESTAMP '1992-01-01' AND sent_at < TIMESTAMP '1996-01-01'
        EXCEPT ALL
        SELECT party, src, dst FROM transfers
        WHERE sent_at >= TIMESTAMP '1996-01-01' AND sent_at < TIMESTAMP '2000-01-01'
        """
    ),
    "route_changes": _with(
        """
        SELECT party,
               CASE WHEN sum(n_come) = 0 THEN 'removed' WHEN sum(n_gone) = 0 THEN 'added'
                    ELSE 'changed' END AS change,
               CAST(sum(n_gone) AS BIGINT) AS n_gone, CAST(sum(n_come) AS BIGINT) AS n_come
        FROM (
            SELECT party, greatest(a - b, 0) AS n_gone, greatest(b - a, 0) AS n_come FROM (
                SELECT party, src, dst,
                       count(*) FILTER (WHERE sent_at < TIMESTAMP '1996-01-01') AS a,
                       count(*) FILTER (WHERE sent_at >= TIMESTAMP '1996-01-01') AS b
                FROM transfers
                WHERE sent_at >= TIMESTAMP '1992-01-01' AND sent_at < TIMESTAMP '2000-01-01'
                GROUP BY party, src, dst
            )
        ) GROUP BY party HAVING sum(n_gone) + sum(n_come) > 0
        """
    ),
    "grouped_at_once": _with(
        """
        SELECT concat_ws(',', CASE WHEN grouping(src) = 0 THEN 'src' END,
                         CASE WHEN grouping(dst) = 0 THEN 'dst' END,
                         CASE WHEN grouping(status) = 0 THEN 'status' END) AS "grouping",
               src, dst, status, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS volume
        FROM transfers GROUP BY GROUPING SETS ((src, dst), (src, status), (status), ())
        """
    ),
    "props_by_key": """
        SELECT CASE WHEN props IS NULL THEN 'null' WHEN json_valid(props) THEN 'ok'
                    ELSE 'malformed' END AS props_state,
               CASE WHEN json_valid(props)
                    THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k,
               count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
        FROM events GROUP BY 1, 2
        """,
    "live_daily": f"""
        SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n
        FROM events GROUP BY 1
        HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= {_LAST_EVENT} - INTERVAL 1 HOUR
        """,
    "live_daily_open": """
        SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n
        FROM events GROUP BY 1
        """,
    "stream_dedupe": "SELECT DISTINCT * FROM events",
    "user_sessions": f"""
        WITH marked AS (
            SELECT user_id, ts,
                   CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
                                   + INTERVAL 6 HOUR
                        THEN 0 ELSE 1 END AS starts
            FROM events
        ), numbered AS (
            SELECT user_id, ts, sum(starts) OVER (
                PARTITION BY user_id ORDER BY ts
                RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session
            FROM marked
        )
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end,
               count(*) AS n
        FROM numbered GROUP BY user_id, session
        HAVING max(ts) + INTERVAL 6 HOUR <= {_LAST_EVENT} - INTERVAL 1 HOUR
        """,
    "live_sessions": f"""
        WITH marked AS (
            SELECT user_id, ts,
                   CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
                                   + INTERVAL 6 HOUR
                        THEN 0 ELSE 1 END AS starts
            FROM events WHERE ts IS NOT NULL
        ), numbered AS (
            SELECT user_id, ts, sum(starts) OVER (
                PARTITION BY user_id ORDER BY ts
                RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session
            FROM marked
        )
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end,
               count(*) AS n,
               max(ts) + INTERVAL 6 HOUR <= {_LAST_EVENT} - INTERVAL 1 HOUR AS closed
        FROM numbered GROUP BY user_id, session
        """,
    "clicks_before_purchases": """
        SELECT p.event_id, p.user_id, p.ts AS bought_at, c.event_id AS click_id,
               c.ts AS clicked_at
        FROM events AS p
        JOIN events AS c ON p.user_id = c.user_id AND c.ts <= p.ts
                        AND c.ts >= p.ts - INTERVAL 6 HOUR
        WHERE p.event_type = 'purchase' AND c.event_type = 'click'
        """,
}
