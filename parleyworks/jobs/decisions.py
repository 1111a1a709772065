"""Registered queries on what is decided about messages, calls and results, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import classify, evaluate, gates, retrieve, telemetry
from ..sources.tables import calls, read, turns
from .queries import _CALLS, _KNN, _SCORED, _STATS, _labelled, _neighbours, _scored, _sql_hits, _stats, query

# ---- gates over conversation turns ---------------------------------------------------------------

NEVER, ALWAYS = ["query"], ["order_status", "refund"]
GREETINGS, BUSINESS = ["hello", "hi"], ["ing"]
HANDOVER, CRITICAL = ["with this", "from the"], ["refund"]


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_BODY = r"lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))"


@query(
    f"WITH {_sql_hits()} SELECT conv_id, turn, CASE WHEN {_BODY} = '' THEN false WHEN label IN {_in(NEVER)} THEN false WHEN label IN {_in(ALWAYS)} THEN true "
    f"WHEN {_BODY} IN {_in(GREETINGS)} THEN false ELSE length({_BODY}) >= 200 OR {_any(_BODY, BUSINESS)} END AS wanted FROM best"
)
def knowledge_gate(spark, sf_dir):
    c = gates.needs_knowledge(F.col("text"), F.col("label"), NEVER, ALWAYS, GREETINGS, BUSINESS, least=200)
    return _labelled(spark, sf_dir).select("conv_id", "turn", c.alias("wanted"))


@query(f"WITH {_sql_hits()} SELECT conv_id, turn FROM best WHERE label = 'other' AND length({_BODY}) > 2 AND score < 0.5")
def clarification_gate(spark, sf_dir):
    return _labelled(spark, sf_dir).where(gates.needs_clarification(F.col("text"), F.col("label"), F.col("score"))).select("conv_id", "turn")


@query(f"WITH {_sql_hits()} SELECT conv_id, bool_or({_any('text', HANDOVER)} OR label IN {_in(CRITICAL)}) AS escalated FROM best GROUP BY conv_id")
def escalation(spark, sf_dir):
    c = gates.escalates(F.col("text"), F.lit(1), F.col("label"), HANDOVER, CRITICAL)
    return _labelled(spark, sf_dir).groupBy("conv_id").agg(F.bool_or(c).alias("escalated"))


@query(
    f"""WITH b AS (SELECT conv_id, turn, role = 'user' AS first, CASE WHEN role <> 'system' THEN '[' || role || ' - ' || CASE WHEN role = 'user' THEN 'primary' ELSE 'supporting' END || ']' || chr(10) || text END AS part,
  {_any('text', HANDOVER)} AS escalate FROM conversations)
SELECT conv_id, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY NOT first, turn), 'all branches failed') AS response, bool_or(escalate) AS escalated FROM b GROUP BY conv_id"""
)
def merged_branches(spark, sf_dir):
    b = turns(spark, sf_dir).select(
        "conv_id", "turn", F.col("role").alias("agent"), (F.col("role") == "user").alias("is_primary"), (F.col("role") != "system").alias("ok"), F.col("text").alias("content"), gates.any_of(F.col("text"), HANDOVER).alias("escalate")
    )
    return classify.merge_branches(b, "conv_id", "turn", "all branches failed")


@query(
    """WITH h AS (SELECT conv_id, turn, text, substr(role, 1, 20) || ':' || substr(text, 1, 160) AS said FROM conversations),
l AS (SELECT conv_id, turn, text, array_to_string(list(said) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), chr(31)) AS said FROM h)
SELECT conv_id, turn, md5(substr(text, 1, 200) || chr(31) || coalesce(said, '')) AS key FROM l"""
)
def cache_keys(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    before = F.collect_list(F.struct("role", F.col("text").alias("content"))).over(w)
    return turns(spark, sf_dir).withColumn("before", before).select("conv_id", "turn", tx.cache_key(F.col("text"), F.col("before")).alias("key"))


# ---- calls and their parameters -------------------------------------------------------------------

#: By tool: required names and declared types.
SPECS = {
    "click": (["k"], {"k": "integer"}),
    "view": (["k"], {"k": "string"}),
    "purchase": (["k", "amount"], {"k": "number"}),
    "signup": ([], {"k": "boolean", "other": "string"}),
}


@query(
    """SELECT event_id, CASE event_type
  WHEN 'click' THEN CASE WHEN k IS NULL THEN 'missing k' WHEN t NOT IN ('UBIGINT', 'BIGINT', 'BOOLEAN') THEN 'k is no integer' ELSE '' END
  WHEN 'view' THEN CASE WHEN k IS NULL THEN 'missing k' WHEN t <> 'VARCHAR' THEN 'k is no string' ELSE '' END
  WHEN 'purchase' THEN CASE WHEN k IS NULL THEN 'missing k' WHEN json_extract(props, '$.amount') IS NULL THEN 'missing amount' WHEN t NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') THEN 'k is no number' ELSE '' END
  WHEN 'signup' THEN CASE WHEN k IS NOT NULL AND t <> 'BOOLEAN' THEN 'k is no boolean' ELSE '' END
  ELSE '' END AS problem FROM (SELECT *, json_extract(props, '$.k') AS k, json_type(props, '$.k') AS t FROM events)"""
)
def param_validation(spark, sf_dir):
    c = F.lit("")
    for tool, (required, types) in SPECS.items():
        c = F.when(F.col("event_type") == tool, gates.param_problem(F.col("props"), required, types)).otherwise(c)
    return read(spark, sf_dir, "events").select("event_id", c.alias("problem"))


@query("SELECT event_type AS tool, sum((json_extract(regexp_extract('so: ' || props || ' done', '(?s)\\{.*\\}', 0), '$.k'))::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")
def reply_json(spark, sf_dir):
    reply = F.concat(F.lit("so: "), "props", F.lit(" done"))
    k = F.get_json_object(tx.json_body(reply), "$.k").cast("long")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tool")).agg(F.sum(k).alias("k"))


@query(
    f"""WITH {_CALLS} SELECT event_id, CASE WHEN ok THEN ms WHEN key % 2 = 0 THEN -1.0::DOUBLE END AS result, ok OR key % 2 = 0 AS success,
  CASE WHEN ok THEN '' ELSE tool || ' failed' END AS error FROM calls"""
)
def fallback_result(spark, sf_dir):
    fallback = F.when(F.col("key") % 2 == 0, F.lit(-1.0))
    r = telemetry.with_fallback(F.col("ms"), F.col("ok"), fallback, F.concat("tool", F.lit(" failed")))
    return calls(spark, sf_dir).select("event_id", r.alias("r")).select("event_id", "r.*")


# ---- instances, gauges and suggestions --------------------------------------------------------------


@query(f"WITH {_CALLS} SELECT tool, arg_max(ms, (us, event_id)) AS ms, count(*) AS samples FROM calls GROUP BY tool")
def gauge_last_value(spark, sf_dir):
    return telemetry.gauge(calls(spark, sf_dir), "tool", ["at", "event_id"], "ms")


@query(
    f"""WITH {_CALLS}, s AS (SELECT key % 7 AS pool, key, round(0.7 * avg(ok::INTEGER) + 0.3 / (1 + avg(ms) / 1000), 6) AS score FROM calls GROUP BY key)
SELECT pool, key, score FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY score DESC, key) AS n FROM s) WHERE n = 1"""
)
def best_instance(spark, sf_dir):
    s = _stats(spark, sf_dir).select((F.col("key") % 7).alias("pool"), "key", F.round("score", 6).alias("score"))
    return telemetry.best_instance(s, "pool", "key", "score")


@query(
    f"""WITH {_STATS}, good AS (SELECT key, max((us, event_id)) FILTER (WHERE ok) AS last_ok FROM calls GROUP BY key),
f AS (SELECT key, count(*) AS streak FROM calls JOIN good USING (key) WHERE NOT ok AND (last_ok IS NULL OR (us, event_id) > last_ok) GROUP BY key)
SELECT * FROM (SELECT 'tool ' || key || ' failed ' || streak || ' times in a row' AS title, 9 AS priority FROM f WHERE streak >= 2
  UNION SELECT 'agent ' || key || ' has a low success rate', 8 FROM stats WHERE success_rate < 0.85 AND total > 10) ORDER BY priority DESC, title LIMIT 5"""
)
def top_suggestions(spark, sf_dir):
    c = calls(spark, sf_dir)
    at = F.struct("at", "event_id")
    last = c.groupBy("key").agg(F.max(F.when(F.col("ok"), at)).alias("good"))
    streak = c.where(~F.col("ok")).join(last, "key").where(F.col("good").isNull() | (at > F.col("good"))).groupBy("key").agg(F.count(F.lit(1)).alias("streak"))
    return telemetry.suggestions(streak, _stats(spark, sf_dir), streak=2)


@query(
    f"""WITH {_CALLS}, z AS (SELECT event_id, key, us, ms, count(*) OVER w AS n, abs(ms - avg(ms) OVER w) / nullif(stddev_samp(ms) OVER w, 0) AS z
  FROM calls WINDOW w AS (PARTITION BY key ORDER BY us, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT event_id, key, round(z, 2) AS z FROM z WHERE n >= 30 AND z > 2.5 ORDER BY us DESC, event_id DESC LIMIT 10"""
)
def last_alerts(spark, sf_dir):
    z = telemetry.rolling_zscore(calls(spark, sf_dir), "key", ["at", "event_id"], "ms")
    return z.orderBy(F.desc("at"), F.desc("event_id")).limit(10).select("event_id", "key", F.round("z", 2).alias("z"))


# Ten digits: values with two decimals over small counts end in ties at the seventh, which engines round apart.
@query(
    """WITH t AS (SELECT user_id AS key, ts::DATE::VARCHAR AS tick, count(*) AS total, sum((event_type <> 'error')::INTEGER) AS success, sum(value) AS sum_ms FROM events GROUP BY 1, 2),
c AS (SELECT key, tick, sum(success) OVER w / sum(total) OVER w AS rate, sum(sum_ms) OVER w / sum(total) OVER w AS ms FROM t WINDOW w AS (PARTITION BY key ORDER BY tick)),
p AS (SELECT *, least(0.9, CASE WHEN rate < 0.9 THEN least(0.5, (0.9 - rate) * 2) ELSE 0 END + CASE WHEN ms > 45 THEN least(0.4, (ms - 45) / 100) ELSE 0 END) AS penalty FROM c),
l AS (SELECT *, coalesce(lag(penalty) OVER (PARTITION BY key ORDER BY tick), 0) AS before FROM p)
SELECT key, tick, round(before, 10) AS penalty, round((0.7 * rate + 0.3 / (1 + ms / 1000)) * greatest(0, 1 - before), 10) AS score FROM l"""
)
def feedback_loop(spark, sf_dir):
    daily = calls(spark, sf_dir).groupBy("key", F.to_date(F.timestamp_micros("at")).cast("string").alias("tick"))
    t = daily.agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("ok").cast("int")).alias("success"), F.sum("ms").alias("sum_ms"))
    return telemetry.feedback(t, "key", "tick", slow=45, scale=100).select("key", "tick", F.round("penalty", 10).alias("penalty"), F.round("score", 10).alias("score"))


# ---- retrieval and evaluation -----------------------------------------------------------------------


@query(
    """WITH d AS (SELECT q.vec_id AS q_id, c.vec_id AS id, q.label AS key,
  round(list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) ** 2)), 6) AS distance
  FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (SELECT q_id, key, id, distance, row_number() OVER (PARTITION BY q_id ORDER BY distance, id)::INTEGER AS rank FROM d) WHERE rank <= 5"""
)
def filtered_knn(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("key"), F.col("embedding").alias("vec"))
    return retrieve.knn_within(e.where("id % 20 = 0").withColumnRenamed("id", "q_id"), e, 5).select("q_id", "key", "id", "distance", "rank")


@query(
    f"""WITH {_KNN}, h AS (SELECT q_id, rank - 1 AS place, id FROM nn WHERE rank <= 8),
o AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY spot) - 1 AS pos FROM (
  SELECT q_id, unnest([7, 9, (q_id // 20) % 8, -1, 3, 0, 5]) AS want, generate_subscripts([7, 9, (q_id // 20) % 8, -1, 3, 0, 5], 1) AS spot FROM (SELECT DISTINCT q_id FROM nn WHERE q_id % 3 > 0)) WHERE want BETWEEN 0 AND 7)
SELECT h.q_id, id, (CASE WHEN h.q_id % 3 = 0 THEN place ELSE pos END + 1)::INTEGER AS rank FROM h LEFT JOIN o ON h.q_id = o.q_id AND place = want
WHERE CASE WHEN h.q_id % 3 = 0 THEN place < 4 ELSE pos < 4 END"""
)
def rerank(spark, sf_dir):
    h = _neighbours(spark, sf_dir, 8).select("q_id", (F.col("rank") - 1).alias("place"), "id")
    q = read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"))
    order = F.array(F.lit(7), F.lit(9), F.expr("cast((q_id div 20) % 8 AS int)"), F.lit(-1), F.lit(3), F.lit(0), F.lit(5))
    orders = q.select("q_id", F.when(F.col("q_id") % 3 > 0, order).alias("order"))
    return retrieve.rerank(h, orders, "q_id", 4).select("q_id", "id", "rank")


RULES = [("relevance", 0.515, "raise relevance"), ("completeness", 0.96, "raise completeness"), ("helpfulness", 0.68, "raise helpfulness")]


@query(
    f"WITH {_SCORED}, m AS (SELECT kind, avg(relevance) AS relevance, avg(completeness) AS completeness, avg(helpfulness) AS helpfulness FROM s GROUP BY kind) SELECT kind, coalesce(nullif(concat_ws('; ', "
    + ", ".join(f"CASE WHEN {m} < {floor} THEN '{text}' END" for m, floor, text in RULES)
    + "), ''), 'all targets met') AS advice FROM m"
)
def recommendations(spark, sf_dir):
    m = _scored(spark, sf_dir).groupBy("kind").agg(*[F.avg(c).alias(c) for c, _, _ in RULES])
    return m.select("kind", F.array_join(evaluate.recommend(RULES, "all targets met"), "; ").alias("advice"))
