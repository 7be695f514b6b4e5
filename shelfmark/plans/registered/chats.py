"""Chat histories from ``conversations``, arrivals from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import arrivals as ar
from shelfmark.operators import conversations as conv
from shelfmark.operators import triage as tr
from shelfmark.plans.registered import query, table

BUDGET = 150


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations")


@query(
    "latest_user_msg",
    "SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS message FROM conversations WHERE role = 'user' GROUP BY conv_id",
)
def latest_user_msg(spark: SparkSession, folder: str) -> DataFrame:
    return conv.latest_user_message(turns(spark, folder))


@query(
    "prior_turns",
    """SELECT conv_id, count(*) FILTER (role <> 'system')::BIGINT AS n_spoken, count(*) FILTER (role <> 'system') > 1 AS has_prior
FROM conversations GROUP BY conv_id""",
)
def prior_turns(spark: SparkSession, folder: str) -> DataFrame:
    return conv.has_prior_turns(turns(spark, folder))


@query(
    "history_window",
    """WITH recent AS (
  SELECT * FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)
SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM recent GROUP BY conv_id""",
)
def history_window(spark: SparkSession, folder: str) -> DataFrame:
    return conv.history_text(turns(spark, folder), 4)


MODEL_SQL = """spoken AS (SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'),
repeated AS (
  SELECT conv_id, max(turn) + 1 AS turn, 'user' AS role, max_by(text, turn) FILTER (role = 'user') AS text FROM spoken GROUP BY conv_id
  HAVING max_by(role, turn) <> 'user' AND count(*) FILTER (role = 'user') > 0),
model AS (SELECT * FROM spoken UNION ALL SELECT * FROM repeated)"""


@query("history_for_model", f"WITH {MODEL_SQL} SELECT conv_id, turn, role, md5(text) AS digest FROM model")
def history_for_model(spark: SparkSession, folder: str) -> DataFrame:
    ready = conv.history_for_model(turns(spark, folder))
    return ready.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query(
    "history_budget",
    f"""WITH {MODEL_SQL}, counted AS (
  SELECT conv_id, turn, sum(ceil(length(text) / 4.0)) OVER w AS used, row_number() OVER w AS place FROM model
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn, used::BIGINT AS tokens_so_far FROM counted WHERE used <= {BUDGET} OR place = 1""",
)
def history_budget(spark: SparkSession, folder: str) -> DataFrame:
    kept = conv.history_budget(conv.history_for_model(turns(spark, folder)), BUDGET)
    return kept.select("conv_id", "turn", F.col("tokens_so_far").cast("long").alias("tokens_so_far"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the key a rate limit would use: subject, else address, else unknown."""
    raw = table(spark, folder, "events")
    subject = F.when(F.col("user_id") > 20, F.col("user_id").cast("string"))
    address = F.when(F.col("user_id") > 5, F.concat(F.lit("10.0.0."), F.col("user_id")))
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", ar.client_key(subject, address).alias("client")
    )


EVENTS_SQL = """arrived AS (
  SELECT event_id, ts, CASE WHEN user_id > 20 THEN 'sub:' || user_id WHEN user_id > 5 THEN '10.0.0.' || user_id ELSE 'unknown' END AS client,
         epoch_us(ts) AS us FROM events),
placed AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS n FROM arrived)"""

# A bucket of two, refilled by one token every twelve hours; one token is so many microseconds.
BURST, PER_MINUTE = 2, 1 / 720
TOKEN = 720 * 60_000_000
QUIET_HOURS = 6
# Crowded already at this size, so that the cutting of crowded keys is compared too.
SMALL_HOT = 40

RATE_SQL = f"""WITH RECURSIVE {EVENTS_SQL},
walk AS (
  SELECT client, n, event_id, us, {(BURST - 1) * TOKEN}::BIGINT AS units, true AS allowed, 0::BIGINT AS retry_after_ms FROM placed WHERE n = 1
  UNION ALL
  SELECT client, n, event_id, us, CASE WHEN filled >= {TOKEN} THEN filled - {TOKEN} ELSE filled END, filled >= {TOKEN},
         CASE WHEN filled >= {TOKEN} THEN 0 ELSE ({TOKEN} - filled + 999) // 1000 END FROM (
    SELECT p.client, p.n, p.event_id, p.us, least({BURST * TOKEN}, w.units + (p.us - w.us)) AS filled
    FROM walk w JOIN placed p ON p.client = w.client AND p.n = w.n + 1))
SELECT client, event_id, allowed, retry_after_ms FROM walk"""


def _limited(spark: SparkSession, folder: str, **hot: int) -> DataFrame:
    limited = ar.rate_limit(events(spark, folder), burst=BURST, per_minute=PER_MINUTE, **hot)
    return limited.select("client", "event_id", "allowed", "retry_after_ms")


@query("rate_limit", RATE_SQL)
def rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    return _limited(spark, folder)


@query("rate_limit_hot", RATE_SQL)
def rate_limit_hot(spark: SparkSession, folder: str) -> DataFrame:
    """The same decisions with crowded keys cut at their pauses."""
    return _limited(spark, folder, hot_rows=SMALL_HOT)


DEDUPE_SQL = f"""WITH RECURSIVE {EVENTS_SQL},
walk AS (
  SELECT client, n, event_id, us AS last, true AS accepted FROM placed WHERE n = 1
  UNION ALL
  SELECT p.client, p.n, p.event_id, CASE WHEN p.us - w.last > {QUIET_HOURS * 3_600_000_000} THEN p.us ELSE w.last END,
         p.us - w.last > {QUIET_HOURS * 3_600_000_000}
  FROM walk w JOIN placed p ON p.client = w.client AND p.n = w.n + 1)
SELECT client, event_id, accepted FROM walk"""


def _single(spark: SparkSession, folder: str, **hot: int) -> DataFrame:
    marked = ar.suppress_duplicates(events(spark, folder), "client", quiet_seconds=QUIET_HOURS * 3600, **hot)
    return marked.select("client", "event_id", "accepted")


@query("events_dedupe", DEDUPE_SQL)
def events_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """A key is taken up again once six hours have passed since it was last accepted."""
    return _single(spark, folder)


@query("events_dedupe_hot", DEDUPE_SQL)
def events_dedupe_hot(spark: SparkSession, folder: str) -> DataFrame:
    """The same decisions with crowded keys cut at their pauses."""
    return _single(spark, folder, hot_rows=SMALL_HOT)


CLAIM_SQL = """CASE event_type WHEN 'signup' THEN 'claim' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail'
  WHEN 'click' THEN 'clarify' END"""


@query(
    "claim_status",
    f"""WITH claims AS (SELECT user_id, ts, event_id, {CLAIM_SQL} AS event FROM events WHERE event_type <> 'view')
SELECT user_id AS ticket_key, max_by(CASE event WHEN 'claim' THEN 'in-progress' WHEN 'finish' THEN 'done' WHEN 'fail' THEN 'failed' ELSE 'none' END,
       (ts, event_id)) AS status, count(*) FILTER (event = 'claim')::BIGINT AS n_claims, count(*)::BIGINT AS n_events
FROM claims GROUP BY user_id""",
)
def claim_status(spark: SparkSession, folder: str) -> DataFrame:
    names = {"signup": "claim", "purchase": "finish", "error": "fail", "click": "clarify"}
    kind = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    claims = table(spark, folder, "events").select(F.col("user_id").alias("ticket_key"), kind.alias("event"), "ts", "event_id")
    return tr.claim_status(claims)
