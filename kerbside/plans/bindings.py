"""Mobility frames derived from the benchmark tables, in Spark and as SQL text.

Integer hashing keeps both engines equal. The two forms stand next to each other on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside import schemas as S
from kerbside.functions import geo
from kerbside.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(prime: int, low: float, width: float):
    return F.lit(low) + ((F.col("event_id") * prime) % 10000).cast("double") / 1e4 * width


def _spread_sql(prime: int, low: float, width: float) -> str:
    return f"({low}e0 + cast((event_id*{prime})%10000 AS double)/1e4*{width}e0)"


# --- pings: a third of all positions sit on one spot, so joins meet a hot place -----------------


def pings(spark: SparkSession, d: str, margin: float = 0.0) -> DataFrame:
    """``margin`` widens the box so that some pings fall outside the city."""
    e = table(spark, d, "events").where(F.col("event_type").isin("view", "click", "error"))
    return e.select(
        "event_id", F.concat(F.lit("taxi_"), (F.col("user_id") % 40).cast("string")).alias("taxi_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        _spread(104729, S.CITY.lat_min - margin, 0.1455 + 2 * margin).alias("lat"),
        _spread(7919, S.CITY.lon_min - margin, 0.2887 + 2 * margin).alias("lon"),
        (20 + F.col("event_id") % 41).cast("double").alias("speed"),
        F.when(F.col("event_type") == "view", "available").when(F.col("event_type") == "click", "engaged")
        .otherwise("offline").alias("status"),
    )


def pings_sql(margin: float = 0.0, name: str = "pings") -> str:
    lat = _spread_sql(104729, S.CITY.lat_min - margin, 0.1455 + 2 * margin)
    lon = _spread_sql(7919, S.CITY.lon_min - margin, 0.2887 + 2 * margin)
    return f"""{name} AS (SELECT event_id, concat('taxi_', cast(user_id % 40 AS varchar)) AS taxi_id, ts,
      {lat} AS lat, {lon} AS lon, cast(20 + event_id % 41 AS double) AS speed,
      CASE event_type WHEN 'view' THEN 'available' WHEN 'click' THEN 'engaged' ELSE 'offline' END AS status
      FROM events WHERE event_type IN ('view','click','error'))"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "signup"))
    given = F.col("event_id") % 7 != 0
    return e.select(
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("trip_id"),
        F.concat(F.lit("rider_"), F.col("user_id").cast("string")).alias("rider_id"),
        F.col("ts").cast("timestamp").alias("requested_at"),
        F.when(given, _spread(15485863, S.CITY.lat_min, 0.1455)).alias("origin_lat"),
        F.when(given, _spread(32452843, S.CITY.lon_min, 0.2887)).alias("origin_lon"),
        (F.col("event_id") % 16 + 1).cast("int").alias("origin_zone"),
        (F.col("event_id") * 3 % 16 + 1).cast("int").alias("destination_zone"),
    )


REQUESTS = f"""requests AS (SELECT concat('t', cast(event_id AS varchar)) AS trip_id,
  concat('rider_', cast(user_id AS varchar)) AS rider_id, ts AS requested_at,
  CASE WHEN event_id%7<>0 THEN {_spread_sql(15485863, S.CITY.lat_min, 0.1455)} END AS origin_lat,
  CASE WHEN event_id%7<>0 THEN {_spread_sql(32452843, S.CITY.lon_min, 0.2887)} END AS origin_lon,
  cast(event_id%16+1 AS int) AS origin_zone, cast((event_id*3)%16+1 AS int) AS destination_zone
  FROM events WHERE event_type IN ('purchase','signup'))"""


def trips_hist(spark: SparkSession, d: str) -> DataFrame:
    h, m = (F.col("l_partkey") % 24).cast("int"), (F.col("l_suppkey") % 60).cast("int")
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trip_id"),
        F.col("l_suppkey").cast("string").alias("taxi_id"),
        (F.col("l_suppkey") % 16 + 1).cast("int").alias("zone_id"),
        (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(hours=h, mins=m)).alias("pickup_ts"),
        (F.col("l_quantity") / 10).alias("trip_distance_miles"),
        (flag == "R").alias("missing_data"),
        F.when(flag == "A", "A").when(flag == "N", "B").otherwise("C").alias("call_type"),
        (F.col("l_linenumber") + 1).alias("n_points"), (F.col("l_partkey") % 5 + 1).alias("stride"),
    )


TRIPS = """trips_hist AS (SELECT l_orderkey*10 + l_linenumber AS trip_id, cast(l_suppkey AS varchar) AS taxi_id,
  cast(l_suppkey%16+1 AS int) AS zone_id,
  l_shipdate + to_hours(cast(l_partkey%24 AS int)) + to_minutes(cast(l_suppkey%60 AS int)) AS pickup_ts,
  l_quantity/10 AS trip_distance_miles, l_returnflag = 'R' AS missing_data,
  CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'C' END AS call_type,
  l_linenumber + 1 AS n_points, l_partkey%5 + 1 AS stride FROM lineitem)"""


def points(df: DataFrame) -> DataFrame:
    """Add ``points``: n_points pairs starting at a fixed corner, spaced by ``stride``."""
    k = F.sequence(F.lit(0), (F.col("n_points") - 1).cast("int"))
    return spread(df).withColumn("points", F.transform(k, lambda i: F.array(
        F.lit(-8.68) + F.lit(0.001) * i * F.col("stride"), F.lit(41.15) + F.lit(0.001) * i)))


POLYLINES = """polylines AS (SELECT *, list_transform(range(n_points),
  lambda k: [-8.68e0 + 0.001e0*k*stride, 41.15e0 + 0.001e0*k]) AS points FROM trips_hist)"""


def raw_trips(spark: SparkSession, d: str) -> DataFrame:
    """Raw trip file rows: text polyline, epoch seconds, duplicates of trip ids included."""
    t = points(trips_hist(spark, d))
    none = F.lit(None).cast("string")
    return t.select(
        F.col("trip_id").cast("string").alias("TRIP_ID"), F.col("call_type").alias("CALL_TYPE"),
        none.alias("ORIGIN_CALL"), none.alias("ORIGIN_STAND"), F.col("taxi_id").alias("TAXI_ID"),
        F.unix_seconds("pickup_ts").alias("TIMESTAMP"), F.lit("A").alias("DAY_TYPE"),
        F.col("missing_data").alias("MISSING_DATA"), F.to_json("points").alias("POLYLINE"),
    )


def yellow_raw(spark: SparkSession, d: str) -> DataFrame:
    """Yellow-taxi rows; every 50th has no zone, every 30th no distance."""
    t = trips_hist(spark, d)
    return t.select(
        F.when(F.col("trip_id") % 50 != 0, F.col("zone_id")).alias("PULocationID"),
        F.col("pickup_ts").alias("tpep_pickup_datetime"),
        F.when(F.col("trip_id") % 30 == 0, F.lit(0.0)).otherwise(F.col("trip_distance_miles")).alias("trip_distance"),
    )


YELLOW = """yellow AS (SELECT CASE WHEN trip_id%50<>0 THEN zone_id END AS zone_id, pickup_ts,
  CASE WHEN trip_id%30=0 THEN 0.0e0 ELSE trip_distance_miles END AS miles FROM trips_hist)"""


def billing_hist(spark: SparkSession, d: str) -> DataFrame:
    """Billing records, one per trip: the copy with the smallest (created_at, driver, km, minutes)."""
    from kerbside.functions import scalars
    from kerbside.operators.tables import first_per_key

    item = table(spark, d, "lineitem")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    rows = item.join(orders, item["l_orderkey"] == orders["o_orderkey"]).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trip_id"),
        F.col("l_suppkey").alias("driver_id"), F.col("o_custkey").alias("client_id"),
        (F.col("l_quantity") / 2).cast("decimal(8,3)").alias("distance_km"),
        (F.col("l_partkey") % 60 + 5).cast("decimal(6,2)").alias("duration_min"),
        (F.lit(1) + (F.col("l_linenumber") % 3) * F.lit(0.25)).cast("decimal(3,2)").alias("surge"),
        F.when(F.col("l_returnflag") == "N", "CHARGED").when(F.col("l_returnflag") == "A", "CALCULATED")
        .otherwise("REFUNDED").alias("status"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
        F.when(F.col("l_returnflag") == "N", F.col("l_shipdate").cast("timestamp") + F.expr("INTERVAL 1 HOUR"))
        .alias("charged_at"),
    )
    rows = first_per_key(rows, ["trip_id"], ["created_at", "driver_id", "distance_km", "duration_min", "status"])
    money = scalars.fare(F.col("distance_km"), F.col("duration_min"), F.col("surge"))
    return rows.withColumns({**money, "charge_attempts": (F.col("trip_id") % 6).cast("int"),
                             "last_charge_error": F.lit(None).cast("string"),
                             "last_attempted_at": F.lit(None).cast("timestamp")}).drop("surge")


BILLING = """billing AS (SELECT *, cast(round((5 + cast(3.5 AS decimal(3,2))*distance_km + cast(0.5 AS decimal(3,2))*duration_min)
      * surge, 2) AS decimal(8,2)) AS total_fare,
    cast(round(cast(round((5 + cast(3.5 AS decimal(3,2))*distance_km + cast(0.5 AS decimal(3,2))*duration_min) * surge, 2)
      AS decimal(8,2)) * cast(0.15 AS decimal(3,2)), 2) AS decimal(8,2)) AS commission,
    cast(total_fare - commission AS decimal(8,2)) AS driver_payout,
    cast(trip_id % 6 AS int) AS charge_attempts
  FROM (SELECT l_orderkey*10 + l_linenumber AS trip_id, l_suppkey AS driver_id, o_custkey AS client_id,
    cast(l_quantity/2 AS decimal(8,3)) AS distance_km, cast(l_partkey%60+5 AS decimal(6,2)) AS duration_min,
    cast(1 + (l_linenumber%3)*0.25 AS decimal(3,2)) AS surge,
    CASE l_returnflag WHEN 'N' THEN 'CHARGED' WHEN 'A' THEN 'CALCULATED' ELSE 'REFUNDED' END AS status,
    l_shipdate AS created_at, CASE l_returnflag WHEN 'N' THEN l_shipdate + INTERVAL 1 HOUR END AS charged_at
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    QUALIFY row_number() OVER (PARTITION BY l_orderkey*10 + l_linenumber
      ORDER BY l_shipdate, l_suppkey, cast(l_quantity/2 AS decimal(8,3)), cast(l_partkey%60+5 AS decimal(6,2)), status) = 1))"""


def trips_status(spark: SparkSession, d: str) -> DataFrame:
    """Trip table rows from orders."""
    s, even = F.col("o_orderstatus"), F.col("o_orderkey") % 2 == 0
    created = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(
        secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
    return table(spark, d, "orders").select(
        F.lit(S.CITY_NAME).alias("city"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_bucket"),
        created.alias("created_at"), F.col("o_orderkey").cast("string").alias("trip_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("rider_id"),
        F.when(s != "O", F.concat(F.lit("taxi_"), (F.col("o_custkey") % 40).cast("string"))).alias("taxi_id"),
        (F.col("o_orderkey") % 16 + 1).cast("int").alias("origin_zone"),
        F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_orderkey") % 13 + 1).cast("int")).alias("dest_zone"),
        F.when(s == "F", "COMPLETED").when(s == "O", "REQUESTED").when(even, "MATCHED").otherwise("IN_PROGRESS")
        .alias("status"),
        F.when(s != "O", (F.col("o_orderkey") % 600).cast("int")).alias("eta_seconds"),
    )


TRIPS_STATUS = """trips AS (SELECT 'casablanca' AS city, strftime(o_orderdate, '%Y-%m-%d') AS date_bucket,
  o_orderdate + to_seconds(o_orderkey % 86400) AS created_at, cast(o_orderkey AS varchar) AS trip_id,
  concat('c', cast(o_custkey AS varchar)) AS rider_id,
  CASE WHEN o_orderstatus <> 'O' THEN concat('taxi_', cast(o_custkey % 40 AS varchar)) END AS taxi_id,
  cast(o_orderkey % 16 + 1 AS int) AS origin_zone,
  CASE WHEN o_orderkey % 9 <> 0 THEN cast(o_orderkey % 13 + 1 AS int) END AS dest_zone,
  CASE WHEN o_orderstatus='F' THEN 'COMPLETED' WHEN o_orderstatus='O' THEN 'REQUESTED'
       WHEN o_orderkey%2=0 THEN 'MATCHED' ELSE 'IN_PROGRESS' END AS status,
  CASE WHEN o_orderstatus <> 'O' THEN cast(o_orderkey % 600 AS int) END AS eta_seconds FROM orders)"""


# --- driver events: assign, accept, reject, start, complete and pings of 150 drivers ------------


def driver_events(spark: SparkSession, d: str) -> DataFrame:
    """Life-cycle events by driver; the kind cycles with a hash, so invalid transitions occur too."""
    e = table(spark, d, "events")
    h = (F.col("event_id") * 2654435761) % 1000
    t = F.col("event_type")
    kind = (
        F.when(t == "purchase", "assign")
        .when(t == "signup", F.when(h < 700, "accept").otherwise("reject"))
        .when(t == "click", F.when(h < 500, "start").otherwise("ping"))
        .when(t == "error", F.when(h < 350, "complete").otherwise("ping")).otherwise("ping")
    )
    assign = t == "purchase"
    return e.select(
        F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("driver_id"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"),
        F.when(assign, F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("trip_id"),
        F.when(assign & (F.col("event_id") % 5 != 0), F.concat(F.lit("c"), (F.col("event_id") % 77).cast("string")))
        .alias("client_id"),
        _spread(104729, S.CITY.lat_min, 0.1455).alias("lat"), _spread(7919, S.CITY.lon_min, 0.2887).alias("lon"),
    )


DRIVER_EVENTS = f"""driver_events AS (SELECT concat('d', cast(user_id AS varchar)) AS driver_id, ts, event_id AS seq,
  CASE event_type WHEN 'purchase' THEN 'assign'
    WHEN 'signup' THEN CASE WHEN (event_id*2654435761)%1000 < 700 THEN 'accept' ELSE 'reject' END
    WHEN 'click' THEN CASE WHEN (event_id*2654435761)%1000 < 500 THEN 'start' ELSE 'ping' END
    WHEN 'error' THEN CASE WHEN (event_id*2654435761)%1000 < 350 THEN 'complete' ELSE 'ping' END
    ELSE 'ping' END AS kind,
  CASE WHEN event_type='purchase' THEN concat('t', cast(event_id AS varchar)) END AS trip_id,
  CASE WHEN event_type='purchase' AND event_id%5<>0 THEN concat('c', cast(event_id%77 AS varchar)) END AS client_id,
  {_spread_sql(104729, S.CITY.lat_min, 0.1455)} AS lat, {_spread_sql(7919, S.CITY.lon_min, 0.2887)} AS lon
  FROM events)"""


# --- zones -------------------------------------------------------------------------------------


def grid_polygons(spark: SparkSession) -> DataFrame:
    """The 16 grid zones as closed rectangles that share their edges exactly."""
    x0, x1, y0, y1 = S.CITY
    xs = [x0 + (x1 - x0) / S.GRID_COLS * i for i in range(S.GRID_COLS + 1)]
    ys = [y0 + (y1 - y0) / S.GRID_ROWS * i for i in range(S.GRID_ROWS + 1)]
    rows = []
    for z in range(S.GRID_COLS * S.GRID_ROWS):
        c, r = z % S.GRID_COLS, z // S.GRID_COLS
        ring = [[xs[c], ys[r]], [xs[c + 1], ys[r]], [xs[c + 1], ys[r + 1]], [xs[c], ys[r + 1]], [xs[c], ys[r]]]
        rows.append((z, z + 1, f"Zone-{z + 1}", [[ring]]))
    return spark.createDataFrame(
        rows, "zone_order int, zone_id int, zone_name string, polygons array<array<array<array<double>>>>")


def supplier_polygons(spark: SparkSession, d: str) -> DataFrame:
    """One L-shaped zone per supplier; they overlap, so the first match (smallest key) matters."""
    k = F.col("s_suppkey")
    x = F.lit(S.CITY.lon_min) + ((k * 7919) % 1000).cast("double") / 1000.0 * 0.2887
    y = F.lit(S.CITY.lat_min) + ((k * 104729) % 1000).cast("double") / 1000.0 * 0.1455
    w = F.lit(0.004) + (k % 7).cast("double") * 0.002
    at = lambda i, j: F.array(x + w * i, y + w * j)
    ring = F.array(at(0.0, 0.0), at(2.0, 0.0), at(2.0, 1.0), at(1.0, 1.0), at(1.0, 2.0), at(0.0, 2.0), at(0.0, 0.0))
    return table(spark, d, "supplier").select(
        k.cast("int").alias("zone_order"), (k + 1).cast("int").alias("zone_id"),
        F.concat(F.lit("Area-"), k.cast("string")).alias("zone_name"), F.array(F.array(ring)).alias("polygons"))


AREAS = f"""areas AS (SELECT cast(s_suppkey AS int) AS zone_order, cast(s_suppkey+1 AS int) AS zone_id,
  concat('Area-', cast(s_suppkey AS varchar)) AS zone_name,
  {S.CITY.lon_min}e0 + cast((s_suppkey*7919)%1000 AS double)/1000e0*0.2887e0 AS x,
  {S.CITY.lat_min}e0 + cast((s_suppkey*104729)%1000 AS double)/1000e0*0.1455e0 AS y,
  0.004e0 + cast(s_suppkey%7 AS double)*0.002e0 AS w FROM supplier)"""
# inside an L: the lower bar or the left bar
IN_AREA = "((lon>x AND lon<x+w*2 AND lat>y AND lat<y+w) OR (lon>x AND lon<x+w AND lat>y AND lat<y+w*2))"


def sql_haversine(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = S.EARTH_RADIUS_M) -> str:
    a = (f"(pow(sin(radians(({lat2})-({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))"
         f"*pow(sin(radians(({lon2})-({lon1}))/2),2))")
    return f"({2 * radius!r}e0*atan2(sqrt({a}),sqrt(1-{a})))"


def sql_grid(lat: str, lon: str, mode: str = "clamp", box: S.Box = S.CITY) -> str:
    gx = f"(4e0*({lon}-({box.lon_min}e0))/{box.lon_max - box.lon_min!r}e0)"
    gy = f"(4e0*({lat}-({box.lat_min}e0))/{box.lat_max - box.lat_min!r}e0)"
    if mode == "reject":
        return (f"(CASE WHEN {gx}>=0 AND {gx}<4 AND {gy}>=0 AND {gy}<4 "
                f"THEN cast(floor({gy})*4+floor({gx})+1 AS int) END)")
    cl = lambda v: f"floor(least(3e0,greatest(0e0,{v})))"
    return f"(CASE WHEN {lat} IS NOT NULL AND {lon} IS NOT NULL THEN cast({cl(gy)}*4+{cl(gx)}+1 AS int) END)"


def sql_center(zone: str) -> tuple[str, str]:
    i = f"least(15,greatest(0,{zone}-1))"
    box = S.CITY
    lat = f"({box.lat_min}e0+(({i})//4+0.5e0)*{(box.lat_max - box.lat_min) / 4!r}e0)"
    lon = f"({box.lon_min}e0+(({i})%4+0.5e0)*{(box.lon_max - box.lon_min) / 4!r}e0)"
    return lat, lon


def zoned(df: DataFrame) -> DataFrame:
    """Pings with their clamped grid zone."""
    return df.withColumn("zone_id", geo.grid_zone(F.col("lat"), F.col("lon"), "clamp"))
