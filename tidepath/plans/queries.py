"""One named query per operator, as functions of a session and a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepath import operators as ops
from tidepath.functions.periods import period_start
from tidepath.operators.sketches import relative_error
from tidepath.plans.views import load_transfers, place_names, register_transfers
from tidepath.session import new_work_path
from tidepath.sources import SCHEMAS, read_tables, write_overview
from tidepath.sources.tables import TRANSFER_TABLES, table_path
from tidepath.streaming import (
    append_to_files,
    interval_join,
    keep_latest,
    keep_sessions,
    live_daily,
    read_event_stream,
    session_changes,
    stream_dedupe,
    user_sessions,
)

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the named queries; the SQL twins use the same.
PERIOD = ("1996-02-01", "1999-11-01")
QUIET_PERIOD = ("1998-01-01", "1998-02-01")
SOURCES = ("NATION_3", "NATION_7", "NATION_11", "NATION_19", "NATION_24")
STATUSES = ("F", "O")
BAND_EDGES = ("25000.00", "75000.00")


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that other engines' frames show the same values.

    Done last, on the result only; sums are still made in decimals.
    """
    return df.select(
        *(
            F.col(f"`{field.name}`").cast("double").alias(field.name)
            if isinstance(field.dataType, T.DecimalType)
            else F.col(f"`{field.name}`")
            for field in df.schema
        )
    )


def _over_transfers(operator: Callable[..., DataFrame], **params) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _plain(operator(load_transfers(spark, folder), **params))

    return query


def _flat(moves: DataFrame) -> DataFrame:
    key = [
        F.col("transfer_key.order").alias("order_key"),
        F.col("transfer_key.line").alias("line_number"),
    ]
    return moves.select(*key, *(name for name in moves.columns if name != "transfer_key"))


def _read_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and known values of every column of every table; each is scanned once."""
    tables = read_tables(spark, folder, SCHEMAS)
    counts = []
    for name, df in tables.items():
        whole = df.agg(
            F.count(F.lit(1)).alias("n"), *(F.count(column).alias(column) for column in df.columns)
        )
        each = [
            F.struct(F.lit(column).alias("column_name"), "n", F.col(column).alias("n_known"))
            for column in df.columns
        ]
        counts.append(
            whole.select(F.lit(name).alias("table_name"), F.inline(F.array(*each)))
        )
    return reduce(DataFrame.unionByName, counts)


def _transfers(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(_flat(load_transfers(spark, folder)))


def _transfers_filtered(spark: SparkSession, folder: str) -> DataFrame:
    start, end = PERIOD
    kept = ops.transfers_filtered(
        load_transfers(spark, folder), start, end, src=SOURCES, status=STATUSES
    )
    return _plain(_flat(kept))


def _region_subtotals(spark: SparkSession, folder: str) -> DataFrame:
    tables = read_tables(spark, folder, (*TRANSFER_TABLES, "region"))
    moves = ops.transfers(tables)
    return _plain(ops.region_subtotals(moves, tables["nation"], tables["region"]))


def _path_matrix(spark: SparkSession, folder: str) -> DataFrame:
    tables = read_tables(spark, folder)
    return ops.path_matrix(ops.transfers(tables), place_names(tables["nation"]))


def _latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_tables(spark, folder, ("lineitem",))["lineitem"]
    return ops.latest_per_key(lines, ("l_orderkey", "l_linenumber"), ("l_shipdate",))


def _period_change(spark: SparkSession, folder: str) -> DataFrame:
    """`diff_n` as a double too: frames differ in how they show a null integer."""
    changes = ops.period_change(load_transfers(spark, folder), unit="month")
    return changes.withColumn("diff_n", F.col("diff_n").cast("double"))


def _approx_parties_bound(spark: SparkSession, folder: str) -> DataFrame:
    """The exact number of parties, and whether the estimate is within 3 deviations of it."""
    rsd = 0.05
    found = ops.approx_parties(load_transfers(spark, folder), rsd, exact=True)
    error = F.abs(F.col("approx_parties") - F.col("parties"))
    return found.select("parties", (error <= 3 * rsd * F.col("parties")).alias("within_bound"))


def _asof_clicks(spark: SparkSession, folder: str) -> DataFrame:
    """Every purchase, with the same user's last click at or before it."""
    events = read_tables(spark, folder, ("events",))["events"]
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'")
    found = ops.asof_join(
        purchases,
        clicks,
        {"user_id": "user_id"},
        "ts",
        "ts",
        {"click_id": "event_id", "clicked_at": "ts"},
        order=("event_id",),
    )
    return found.withColumn("click_id", F.col("click_id").cast("double"))


def _asof_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Every event, with the last order its user made before it."""
    tables = read_tables(spark, folder, ("events", "orders"))
    found = ops.asof_join(
        tables["events"].select("event_id", "user_id", "ts"),
        tables["orders"],
        {"user_id": "o_custkey"},
        "ts",
        "o_orderdate",
        {"order_key": "o_orderkey", "ordered_at": "o_orderdate"},
        order=("o_orderkey",),
        strict=True,
        unit="month",
    )
    return found.withColumn("order_key", F.col("order_key").cast("double"))


def _events_in_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts of a user's purchases, with all that the user did in each."""
    events = read_tables(spark, folder, ("events",))["events"]
    bursts = ops.sessions(events.where("event_type = 'purchase'"))
    inside = ops.points_in_intervals(
        events, bursts, "ts", "session_start", "session_end", [("user_id", "session_user")]
    )
    return _plain(
        inside.groupBy("session_user", "session_start", "session_end", "n_session").agg(
            F.count(F.lit(1)).alias("n_inside"),
            F.sum(F.col("value").cast("decimal(18,2)")).alias("value_inside"),
        )
    )


def _stored_sketches(moves: DataFrame) -> DataFrame:
    sketches = ops.daily_sketches(moves)
    path = new_work_path(moves.sparkSession, "sketches")
    write_overview(sketches, path)
    return moves.sparkSession.read.schema(sketches.schema).parquet(path)


def _sketched_parties(spark: SparkSession, folder: str) -> DataFrame:
    """Parties by month, and whether the united daily sketches are within 4 deviations of it."""
    moves = load_transfers(spark, folder)
    month = period_start(F.col("sent_at"), "month").alias("period")
    guess = ops.sketched_parties(_stored_sketches(moves), month)
    exact = moves.groupBy(month).agg(F.countDistinct("party").alias("parties"))
    off = F.abs(F.col("approx_parties") - F.col("parties"))
    bound = 4 * relative_error() * F.col("parties") + 1
    return exact.join(guess, "period").select("period", "parties", (off <= bound).alias("within_bound"))


def _sketched_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts by source, and whether the sketched quantiles lie within 2 % of their ranks."""
    moves = load_transfers(spark, folder)
    probs, slack = (0.05, 0.5, 0.95), 0.02
    guess = ops.sketched_quantiles(_stored_sketches(moves), probs, "src")
    amount = F.col("amount").cast("double")
    ranked = moves.join(guess, "src").groupBy("src").agg(
        F.count("amount").alias("n"),
        *(
            ((F.count_if(amount < F.col("quantiles")[i]) / F.count("amount") <= p + slack)
             & (F.count_if(amount <= F.col("quantiles")[i]) / F.count("amount") >= p - slack)).alias(f"ok{i}")
            for i, p in enumerate(probs)
        ),
    )
    return ranked.select("src", "n", (F.col("ok0") & F.col("ok1") & F.col("ok2")).alias("within_bound"))


def _weekday_hour(spark: SparkSession, folder: str) -> DataFrame:
    return ops.weekday_hour(read_tables(spark, folder, ("events",))["events"])


def _write_overview(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly paths, stored by month and read back."""
    moves = load_transfers(spark, folder)
    month = F.date_format(F.col("sent_at"), "yyyy-MM").alias("month")
    monthly = moves.groupBy(month, "src", "dst").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("volume")
    )
    path = new_work_path(spark, "overview")
    write_overview(monthly, path, ("month",))
    return _plain(spark.read.schema(monthly.schema).parquet(path))


def _sql_over_view(spark: SparkSession, folder: str) -> DataFrame:
    register_transfers(spark, folder)
    return spark.sql(
        """
        select status, src, count(*) as n, cast(sum(amount) as double) as volume
        from transfers
        group by status, src
        """
    )


def _events(spark: SparkSession, folder: str) -> DataFrame:
    # A pattern, since a stream accepts a single file only as the match of one.
    return read_event_stream(spark, table_path(folder, "{events}"))


def _live_daily(spark: SparkSession, folder: str) -> DataFrame:
    return append_to_files(live_daily(_events(spark, folder)))


def _live_daily_open(spark: SparkSession, folder: str) -> DataFrame:
    return keep_latest(live_daily(_events(spark, folder)))


def _stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """The events, delivered twice as a source may do after a failure."""
    twice = _events(spark, folder).unionByName(_events(spark, folder))
    return append_to_files(stream_dedupe(twice).drop("t"))


def _user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return append_to_files(user_sessions(_events(spark, folder)))


def _live_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Every session, open ones included."""
    return keep_sessions(session_changes(_events(spark, folder)))


def _clicks_before_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases with each click of the same user in the 6 hours before, from two streams."""
    purchases = _events(spark, folder).where("event_type = 'purchase'")
    clicks = _events(spark, folder).where("event_type = 'click'")
    pairs = interval_join(
        purchases.select("event_id", "user_id", F.col("t").alias("bought_t"), F.col("ts").alias("bought_at")),
        clicks.select(
            F.col("event_id").alias("click_id"), F.col("user_id").alias("click_user"),
            F.col("t").alias("clicked_t"), F.col("ts").alias("clicked_at"),
        ),
        [("user_id", "click_user")],
        "bought_t",
        "clicked_t",
        "6 hours",
    )
    return append_to_files(pairs.drop("bought_t", "clicked_t", "click_user"))


GROUPINGS = (("src", "dst"), ("src", "status"), ("status",), ())


def _idle_parties(spark: SparkSession, folder: str) -> DataFrame:
    """Parties of one segment that have no transfer in a month."""
    customers = read_tables(spark, folder, ("customer",))["customer"]
    moves = ops.transfers_filtered(load_transfers(spark, folder), *QUIET_PERIOD)
    builders = customers.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_nationkey")
    return ops.with_partner(builders, moves, {"c_custkey": "party"}, partner=False)


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    moves = load_transfers(spark, folder)
    routes = [
        ops.transfers_filtered(moves, start, end).select("party", "src", "dst")
        for start, end in (("1992-01-01", "1996-01-01"), ("1996-01-01", "2000-01-01"))
    ]
    return routes[0], routes[1]


def _routes_lost(spark: SparkSession, folder: str) -> DataFrame:
    """What parties sent along a path more often in the first four years than in the next."""
    return ops.bag_difference(*_halves(spark, folder))


def _route_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Parties whose transfers by path differ between the two halves, and by how many."""
    return ops.version_changes(*_halves(spark, folder), ("party",))


def _props_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """Events and their value by the key in their JSON text."""
    events = read_tables(spark, folder, ("events",))["events"]
    found = ops.json_scalars(events, "props", {"k": ("$.k", "long")})
    return _plain(
        found.groupBy("props_state", F.col("k").cast("double").alias("k")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value")
        )
    )


QUERIES: dict[str, Query] = {
    "read_tables": _read_tables,
    "transfers": _transfers,
    "transfers_filtered": _transfers_filtered,
    "totals": _over_transfers(ops.totals),
    "by_period": _over_transfers(ops.by_period, unit="month"),
    "by_period_week": _over_transfers(ops.by_period, unit="week"),
    "by_period_day": _over_transfers(ops.by_period, unit="day"),
    "by_place": _over_transfers(ops.by_place, side="src"),
    "by_place_dst": _over_transfers(ops.by_place, side="dst"),
    "paths": _over_transfers(ops.paths),
    "top_paths_per_period": _over_transfers(ops.top_paths_per_period, unit="month", k=3),
    "write_overview": _write_overview,
    "sql_over_view": _sql_over_view,
    "daily_zero_filled": _over_transfers(ops.daily_zero_filled),
    "cumulative": _over_transfers(ops.cumulative, unit="month"),
    "period_change": _period_change,
    "rolling_7d": _over_transfers(ops.rolling_7d),
    "rank_places": _over_transfers(ops.rank_places, side="src"),
    "rank_places_dst": _over_transfers(ops.rank_places, side="dst"),
    "net_flow": _over_transfers(ops.net_flow),
    "region_subtotals": _region_subtotals,
    "path_matrix": _path_matrix,
    "size_bands": _over_transfers(ops.size_bands, edges=BAND_EDGES),
    "amount_quantiles": _over_transfers(ops.amount_quantiles, probs=(0.5, 0.95)),
    "top_parties": _over_transfers(ops.top_parties, k=20),
    "party_breadth": _over_transfers(ops.party_breadth),
    "status_by_month": _over_transfers(ops.status_by_month),
    "new_and_returning": _over_transfers(ops.new_and_returning),
    "cohort_retention": _over_transfers(ops.cohort_retention),
    "latest_per_key": _latest_per_key,
    "weekday_hour": _weekday_hour,
    "asof_clicks": _asof_clicks,
    "asof_orders": _asof_orders,
    "events_in_sessions": _events_in_sessions,
    "sketched_parties": _sketched_parties,
    "sketched_quantiles": _sketched_quantiles,
    "idle_parties": _idle_parties,
    "routes_lost": _routes_lost,
    "route_changes": _route_changes,
    "grouped_at_once": _over_transfers(ops.grouped_at_once, sets=GROUPINGS),
    "props_by_key": _props_by_key,
    "approx_parties_bound": _approx_parties_bound,
    "approx_parties": _over_transfers(ops.approx_parties),
    "live_daily": _live_daily,
    "live_daily_open": _live_daily_open,
    "stream_dedupe": _stream_dedupe,
    "user_sessions": _user_sessions,
    "live_sessions": _live_sessions,
    "clicks_before_purchases": _clicks_before_purchases,
}
