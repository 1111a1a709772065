"""The registered queries over the given tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors
from ..operators import classify, evaluate, memory, retrieve, telemetry
from ..sources.tables import calls, read, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- dictionaries for the given tables -------------------------------------------------------

DICTIONARY = [
    ("order_status", 0, ["from", "with this"]),
    ("logistics", 0, ["on the", "to be"]),
    ("refund", 0, ["for the", "that"]),
    ("query", 1, ["is", "was"]),
    ("request", 1, ["it", "by", "be"]),
]
LEVELS = [(4, ["with this"]), (3, ["from the"]), (2, ["on the"])]
RULES = [
    ("general", 0.1, ["query", "request"], 0.55, ["is", "was"], 0.12, 0.35),
    ("technical", 0.0, ["logistics"], 0.75, ["from", "with", "for"], 0.18, 0.45),
    ("billing", 0.0, ["refund", "order_status"], 0.75, ["that", "to"], 0.18, 0.45),
]
GENERIC = ["query", "request"]


def _sql_hits() -> str:
    rows = [f"('{label}', {i}, {tier}, '{k}')" for i, (label, tier, ks) in enumerate(DICTIONARY) for k in ks]
    return f"""
dict AS (SELECT * FROM (VALUES {', '.join(rows)}) v(label, ord, tier, kw)),
hits AS (
  SELECT conv_id, turn, label, ord, tier, count(*) AS hits, least(1.0::DOUBLE, 0.5 + 0.25 * (count(*) - 1)) AS score
  FROM conversations JOIN dict ON contains(lower(text), kw) GROUP BY ALL),
best AS (
  SELECT c.conv_id, c.turn, c.role, c.text, coalesce(h.label, 'other') AS label, coalesce(h.score, 0)::DOUBLE AS score
  FROM conversations c LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY tier, score DESC, ord) AS rn FROM hits) h
  ON c.conv_id = h.conv_id AND c.turn = h.turn AND rn = 1)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = turns(spark, sf_dir).withColumn("hits", classify.keyword_hits(F.col("text"), DICTIONARY))
    return df.withColumn("best", classify.best_label(F.col("hits"))).select("*", F.col("best.label").alias("label"), F.col("best.score").alias("score"))


@query(f"WITH {_sql_hits()} SELECT role, label, count(*) AS n, round(sum(score), 6) AS score FROM best GROUP BY role, label")
def keyword_classify(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("role", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("score"))


@query(f"WITH {_sql_hits()} SELECT conv_id, turn, label, hits, score FROM hits")
def keyword_hit_scores(spark, sf_dir):
    df = turns(spark, sf_dir).select("conv_id", "turn", F.explode(classify.keyword_hits(F.col("text"), DICTIONARY)).alias("h"))
    return df.select("conv_id", "turn", "h.label", F.col("h.hits").cast("long").alias("hits"), "h.score")


@query(
    f"WITH {_sql_hits()} SELECT conv_id, turn, label, CASE WHEN contains(lower(text), 'with this') THEN 4 WHEN contains(lower(text), 'from the') THEN 3 "
    "WHEN contains(lower(text), 'on the') THEN 2 WHEN label IN ('escalation', 'human_handoff') THEN 3 WHEN label = 'complaint' THEN 2 ELSE 1 END AS urgency FROM best"
)
def urgency(spark, sf_dir):
    return _labelled(spark, sf_dir).select("conv_id", "turn", "label", classify.urgency(F.col("text"), F.col("label"), LEVELS).alias("urgency"))


def _sql_entity(p: str) -> str:
    return f"coalesce(array_to_string((SELECT list(m ORDER BY i) FROM (SELECT trim(m) AS m, min(i) AS i FROM (SELECT unnest(x) AS m, generate_subscripts(x, 1) AS i FROM (SELECT regexp_extract_all(text, '{p}', 1) AS x)) GROUP BY 1)), ','), '')"


@query(
    "SELECT doc_id, " + ", ".join(f"{_sql_entity(p)} AS {k}".replace("regexp_extract_all(text", "regexp_extract_all(" + ("word" if k == "error_code" else "text")) for k, p in tx.SQL_ENTITIES.items())
    + " FROM (SELECT *, regexp_replace(text, '[\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}]', 'x', 'g') AS word FROM documents)"  # there, word borders know ASCII only
)
def entity_extract(spark, sf_dir):
    found = tx.entities(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", *[F.array_join(c, ",").alias(k) for k, c in found.items()])


def _sql_scores() -> str:
    parts = []
    for i, (d, base, labels, bonus, kws, step, cap) in enumerate(RULES):
        hits = " + ".join(f"contains(lower(text), '{k}')::INTEGER" for k in kws)
        label = ", ".join(f"'{x}'" for x in labels)
        parts.append(f"SELECT conv_id, turn, '{d}' AS domain, {i} AS ord, round({base}::DOUBLE + CASE WHEN label IN ({label}) THEN {bonus}::DOUBLE ELSE 0 END + least({cap}::DOUBLE, ({hits}) * {step}::DOUBLE), 3) AS score FROM best")
    return f"{_sql_hits()}, scores AS ({' UNION ALL '.join(parts)}), ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, ord) AS rn, max(score) OVER (PARTITION BY conv_id, turn) AS top FROM scores)"


@query(f"WITH {_sql_scores()} SELECT conv_id, turn, domain, score FROM scores")
def domain_scores(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    return df.select("conv_id", "turn", F.explode(classify.domain_scores(F.col("text"), F.col("label"), RULES)).alias("s")).select("conv_id", "turn", "s.domain", "s.score")


@query(
    f"WITH {_sql_scores()} SELECT conv_id, turn, max(domain) FILTER (WHERE rn = 1) AS primary_domain, "
    "coalesce(string_agg(domain, ',' ORDER BY rn) FILTER (WHERE rn > 1 AND domain <> 'general' AND score >= 0.45 AND score >= 0.55 * top), '') AS supporting, "
    "round(least(max(top), 1.0), 3) AS confidence FROM ranked GROUP BY conv_id, turn"
)
def route_decision(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    routed = df.select("conv_id", "turn", classify.route(classify.domain_scores(F.col("text"), F.col("label"), RULES)).alias("r"))
    return routed.select("conv_id", "turn", F.col("r.primary").alias("primary_domain"), "r.supporting", "r.confidence")


@query(
    f"""WITH {_sql_hits()},
legs AS (SELECT conv_id, role, turn, label, score AS confidence, CASE role WHEN 'assistant' THEN 0.7 WHEN 'user' THEN 0.2 ELSE 0.1 END::DOUBLE AS weight, CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS leg
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM best) WHERE n = 1),
sums AS (SELECT conv_id AS id, label, sum(weight * confidence) AS score, min(leg) AS first FROM legs GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, first, label) AS rn FROM sums) WHERE rn = 1),
j AS (SELECT top.*, p.label AS p_label, p.confidence AS p_score,
  coalesce(top.label IN ('query', 'request') AND p.label NOT IN ('other', 'query', 'request') AND p.confidence >= 0.5 AND top.score < 0.8, false) AS yields
  FROM top LEFT JOIN legs p ON p.conv_id = top.id AND p.leg = 3)
SELECT id, CASE WHEN yields THEN p_label WHEN score < 0.5 THEN 'other' ELSE label END AS label,
  round(CASE WHEN yields THEN greatest(score, p_score) ELSE score END, 6) AS confidence FROM j"""
)
def weighted_vote(spark, sf_dir):
    """A conversation's label by vote of its first turn in each role, which lie in different rows."""
    leg = F.when(F.col("role") == "assistant", 1).when(F.col("role") == "user", 2).otherwise(3)
    first = memory.first_per_key(_labelled(spark, sf_dir), ["conv_id", "role"], ["turn"]).withColumn("leg", leg)
    weight = F.when(F.col("leg") == 1, 0.7).when(F.col("leg") == 2, 0.2).otherwise(0.1)
    legs = first.select(F.col("conv_id").alias("id"), "leg", weight.alias("weight"), "label", F.col("score").alias("confidence"))
    return classify.vote(legs, "id", generic=GENERIC).withColumn("confidence", F.round("confidence", 6))


@query(
    """WITH s AS (SELECT conv_id, turn, lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS text FROM conversations),
g AS (
  SELECT DISTINCT conv_id, turn, substr(text, i, n) AS g FROM (
    SELECT conv_id, turn, text, n, unnest(range(1, length(text) - n + 2)) AS i FROM s, (VALUES (1), (2), (3)) v(n) WHERE length(text) >= n)
  UNION SELECT conv_id, turn, '' FROM s WHERE length(text) = 0)
SELECT conv_id, turn, (('0x' || substr(md5(g), 1, 8))::BIGINT % 256)::INTEGER AS slot,
  sum(CASE WHEN ('0x' || substr(md5(g), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS value FROM g GROUP BY ALL"""
)
def ngram_vectors(spark, sf_dir):
    return vectors.sparse_vectors(turns(spark, sf_dir).select("conv_id", "turn", "text"), "text")


# ---- retrieval ---------------------------------------------------------------------------------


_PACK = """list_reduce(list_concat([{done: []::VARCHAR[], cur: '', s: ''}], list_transform(sentences, lambda s: {done: []::VARCHAR[], cur: '', s: s})), lambda a, x:
    CASE WHEN length(a.cur) + length(x.s) + 1 > 500 THEN {done: CASE WHEN a.cur = '' THEN a.done ELSE list_append(a.done, a.cur) END, cur: x.s, s: ''}
    ELSE {done: a.done, cur: CASE WHEN a.cur = '' THEN x.s ELSE a.cur || '.' || x.s END, s: ''} END)"""


_CHUNKED = f"""d AS (SELECT doc_id, text, source, source || '/' || doc_id AS title, list_filter(regexp_split_to_array(text, '[.\n]'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS sentences FROM documents),
p AS (SELECT *, {_PACK} AS x FROM d),
c AS (SELECT doc_id, source, title, CASE WHEN length(text) <= 500 THEN list_filter([text], lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> '') WHEN x.cur = '' THEN x.done ELSE list_append(x.done, x.cur) END AS c FROM p)"""


@query(
    f"""WITH {_CHUNKED} SELECT doc_id, title, len(c)::INTEGER AS total_chunks, (i - 1)::INTEGER AS chunk_index, chunk, md5(title || '_' || (i - 1) || '_' || substr(chunk, 1, 50)) AS chunk_id
FROM (SELECT *, unnest(c) AS chunk, generate_subscripts(c, 1) AS i FROM c)"""
)
def chunk_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("title", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    df = tx.exploded_chunks(docs.select("doc_id", "title", "text"), "text", delimiters="[.\n]", joiner=".")
    return df.withColumn("chunk_id", F.md5(F.concat_ws("_", "title", F.col("chunk_index").cast("string"), F.substring("chunk", 1, 50))))


@query(f"WITH {_CHUNKED} SELECT source, count(*) AS documents, sum(len(c))::BIGINT AS chunks FROM c GROUP BY source")
def chunk_counts(spark, sf_dir):
    n = F.size(tx.chunks(F.col("text"), delimiters="[.\n]", joiner="."))
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(n).alias("chunks"))


_KNN = """nn AS (
  SELECT q_id, id, label, distance, row_number() OVER (PARTITION BY q_id ORDER BY distance, id) AS rank FROM (
    SELECT q.vec_id AS q_id, c.vec_id AS id, c.label,
      round(list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) ** 2)), 6) AS distance
    FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id))"""


def _neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return retrieve.knn(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), k)


@query(f"WITH {_KNN} SELECT q_id, id, rank::INTEGER AS rank, round(1 - distance, 4) AS score FROM nn WHERE rank <= 5")
def knn_topk(spark, sf_dir):
    return _neighbours(spark, sf_dir, 5).select("q_id", "id", "rank", F.round(1 - F.col("distance"), 4).alias("score"))


def _voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    n = _neighbours(spark, sf_dir, 1).select("q_id", "id")
    return n.join(e.select(F.col("vec_id").alias("q_id"), F.col("label").alias("truth")), "q_id").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("predicted")), "id")


@query(
    f"""WITH {_KNN}, p AS (SELECT e.label AS truth, nn.label AS predicted FROM nn JOIN embeddings e ON e.vec_id = q_id WHERE rank = 1),
l AS (SELECT truth AS label FROM p UNION SELECT predicted FROM p),
c AS (SELECT label, count(*) FILTER (WHERE truth = label AND predicted = label) AS tp, count(*) FILTER (WHERE truth <> label AND predicted = label) AS fp,
  count(*) FILTER (WHERE truth = label AND predicted <> label) AS fn FROM l, p GROUP BY label)
SELECT label, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall FROM c"""
)
def knn_label_report(spark, sf_dir):
    r = evaluate.per_class(_voted(spark, sf_dir), "truth", "predicted")
    return r.select("label", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    f"""WITH {_KNN}, h AS (SELECT q_id - q_id % 40 AS q, q_id % 40 // 20 AS query_no, rank, id, round(1 - distance, 4) AS score FROM nn WHERE rank <= 5),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, id, score ORDER BY query_no, rank) AS n FROM h) WHERE n = 1)
SELECT * FROM (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY query_no, rank)::INTEGER AS place FROM o) WHERE place <= 5"""
)
def multi_query_dedup(spark, sf_dir):
    q = F.col("q_id")
    h = _neighbours(spark, sf_dir, 5).select((q - q % 40).alias("q"), F.floor(q % 40 / 20).alias("query_no"), "rank", "id", F.round(1 - F.col("distance"), 4).alias("score"))
    return retrieve.multi_query(h, "q", ["id", "score"]).select("q", "id", "score", "place")


# ---- evaluation ----------------------------------------------------------------------------------

_JUDGED = """j AS (SELECT doc_id, quality AS truth, 1 - toxic AS predicted FROM labels),
l AS (SELECT truth AS label FROM j UNION SELECT predicted FROM j),
c AS (SELECT label, count(*) FILTER (WHERE truth = label AND predicted = label) AS tp, count(*) FILTER (WHERE truth <> label AND predicted = label) AS fp,
  count(*) FILTER (WHERE truth = label AND predicted <> label) AS fn FROM l, j GROUP BY label),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS q FROM c)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("predicted"))


@query(f"WITH {_JUDGED} SELECT label, tp, fp, fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 6) AS f1 FROM r")
def precision_recall_f1(spark, sf_dir):
    r = evaluate.per_class(_judged(spark, sf_dir), "truth", "predicted")
    return r.select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_JUDGED} SELECT round((SELECT avg((truth = predicted)::INTEGER) FROM j), 6) AS accuracy, round(avg(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END), 6) AS macro_f1 FROM r")
def accuracy_macro_f1(spark, sf_dir):
    return evaluate.overall(_judged(spark, sf_dir), "truth", "predicted").select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


_SCORED = "s AS (SELECT l_linenumber AS kind, l_quantity / 50 AS relevance, 1 - l_discount AS accuracy, 1 - l_tax AS completeness, least(l_extendedprice / 50000, 1) AS helpfulness FROM lineitem)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("kind"),
        (F.col("l_quantity") / 50).alias("relevance"),
        (1 - F.col("l_discount")).alias("accuracy"),
        (1 - F.col("l_tax")).alias("completeness"),
        F.least(F.col("l_extendedprice") / 50000, F.lit(1.0)).alias("helpfulness"),
    )


@query(f"WITH {_SCORED} SELECT kind, count(*) AS n, round(avg(((relevance + accuracy + completeness + helpfulness) / 4 >= 0.75)::INTEGER), 6) AS pass_rate FROM s GROUP BY kind")
def pass_rate(spark, sf_dir):
    mean = (F.col("relevance") + F.col("accuracy") + F.col("completeness") + F.col("helpfulness")) / 4
    return _scored(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((mean >= 0.75).cast("int")), 6).alias("pass_rate"))


@query(f"WITH {_SCORED} SELECT metric, round(avg(v), 4) AS mean FROM (UNPIVOT s ON relevance, accuracy, completeness, helpfulness INTO NAME metric VALUE v) GROUP BY metric")
def metric_means(spark, sf_dir):
    return evaluate.metric_means(_scored(spark, sf_dir), ["relevance", "accuracy", "completeness", "helpfulness"]).select("metric", F.round("mean", 4).alias("mean"))


@query(
    """WITH d AS (SELECT ts::DATE::VARCHAR AS run, avg((event_type <> 'error')::INTEGER) AS success_rate, avg(value) AS mean_value FROM events GROUP BY 1),
r AS (SELECT run, metric, v, lag(v) OVER (PARTITION BY metric ORDER BY run) AS previous FROM (UNPIVOT d ON success_rate, mean_value INTO NAME metric VALUE v))
SELECT run, metric, round(v, 6) AS value, round(previous, 6) AS previous, round((v - previous) / previous, 6) AS delta FROM r WHERE previous > 0 AND (v - previous) / previous < -0.05"""
)
def regression_lag(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("run")).agg(F.avg((F.col("event_type") != "error").cast("int")).alias("success_rate"), F.avg("value").alias("mean_value"))
    runs = e.select("run", F.expr("stack(2, 'success_rate', success_rate, 'mean_value', mean_value) AS (metric, value)"))
    return evaluate.regressions(runs).select("run", "metric", *[F.round(c, 6).alias(c) for c in ("value", "previous", "delta")])


# ---- telemetry -------------------------------------------------------------------------------------

_CALLS = "calls AS (SELECT event_id, user_id AS key, event_type AS tool, epoch_us(ts) AS us, event_type <> 'error' AS ok, value AS ms FROM events)"
_STATS = f"{_CALLS}, stats AS (SELECT key, count(*) AS total, sum(ok::INTEGER)::BIGINT AS success, avg(ok::INTEGER) AS success_rate, avg(ms) AS avg_ms FROM calls GROUP BY key)"
_PENALTY = "least(0.9, CASE WHEN success_rate < 0.9 THEN least(0.5, (0.9 - success_rate) * 2) ELSE 0 END + CASE WHEN avg_ms > 45 THEN least(0.4, (avg_ms - 45) / 100) ELSE 0 END)"


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.call_stats(calls(spark, sf_dir), "key")


@query(f"WITH {_STATS} SELECT key, total, success, round(success_rate, 6) AS success_rate, round(avg_ms, 6) AS avg_ms, round(0.7 * success_rate + 0.3 / (1 + avg_ms / 1000), 6) AS score FROM stats")
def agent_stats(spark, sf_dir):
    return _stats(spark, sf_dir).select("key", "total", "success", *[F.round(c, 6).alias(c) for c in ("success_rate", "avg_ms", "score")])


@query(f"WITH {_CALLS} SELECT tool, count(*) AS total, sum(ok::INTEGER)::BIGINT AS success, round(avg(ok::INTEGER), 6) AS success_rate, round(sum(CASE WHEN ok THEN ms ELSE 0 END) / count(*), 6) AS avg_ms FROM calls GROUP BY tool")
def tool_stats(spark, sf_dir):
    s = telemetry.call_stats(calls(spark, sf_dir), "tool", tool_recipe=True)
    return s.select("tool", "total", "success", F.round("success_rate", 6).alias("success_rate"), F.round("avg_ms", 6).alias("avg_ms"))


@query(f"WITH {_STATS}, p AS (SELECT *, {_PENALTY} AS penalty FROM stats) SELECT key, round(penalty, 6) AS penalty, round((0.7 * success_rate + 0.3 / (1 + avg_ms / 1000)) * greatest(0, 1 - penalty), 6) AS score FROM p")
def routing_penalty(spark, sf_dir):
    s = _stats(spark, sf_dir).withColumn("penalty", telemetry.routing_penalty(F.col("success_rate"), F.col("avg_ms"), slow=45, scale=100))
    return s.select("key", F.round("penalty", 6).alias("penalty"), F.round(telemetry.routing_score(F.col("success_rate"), F.col("avg_ms"), F.col("penalty")), 6).alias("score"))


@query(
    f"""WITH {_STATS}, p AS (SELECT *, CASE WHEN key % 3 = 0 THEN {_PENALTY} * 4 - 1 ELSE 0 END AS found FROM stats),
c AS (SELECT *, greatest(0, least(0.9, found)) AS penalty FROM p), r AS (SELECT key % 7 AS pool, key, round((0.7 * success_rate + 0.3 / (1 + avg_ms / 1000)) * greatest(0, 1 - penalty), 6) AS score FROM c)
SELECT pool, key, score FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY score DESC, key) AS n FROM r) WHERE n = 1"""
)
def penalised_instance(spark, sf_dir):
    s = _stats(spark, sf_dir)
    found = s.where("key % 3 = 0").withColumn("penalty", telemetry.routing_penalty(F.col("success_rate"), F.col("avg_ms"), slow=45, scale=100) * 4 - 1)
    scored = telemetry.penalised(s, found, "key").select((F.col("key") % 7).alias("pool"), "key", F.round("score", 6).alias("score"))
    return telemetry.best_instance(scored, "pool", "key", "score")


@query(
    f"""WITH {_CALLS}, t AS (SELECT tool, count(*) AS n, sum(ok::INTEGER) AS success, {', '.join(f'count(*) FILTER (WHERE ms <= {b}) AS b{b}' for b in (5, 50, 1000))} FROM calls GROUP BY tool)
SELECT unnest(['requests_total{{tool="' || tool || '"}} ' || n, 'requests_ok_total{{tool="' || tool || '"}} ' || success,
  {', '.join(f"""'latency_ms_bucket{{tool="' || tool || '",le="{b}"}} ' || b{b}""" for b in (5, 50, 1000))}, 'latency_ms_bucket{{tool="' || tool || '",le="+Inf"}} ' || n, 'latency_ms_count{{tool="' || tool || '"}} ' || n]) AS line FROM t"""
)
def metrics_text(spark, sf_dir):
    n = F.count(F.lit(1)).alias("n")
    t = calls(spark, sf_dir).groupBy("tool").agg(n, F.sum(F.col("ok").cast("int")).alias("success"), *[F.count_if(F.col("ms") <= b).alias(f"b{b}") for b in (5, 50, 1000)])
    tool = {"tool": F.col("tool")}
    lines = [telemetry.exposition("latency_ms_bucket", tool | {"le": F.lit(str(b))}, F.col(f"b{b}")) for b in (5, 50, 1000)]
    lines.append(telemetry.exposition("latency_ms_bucket", tool | {"le": F.lit("+Inf")}, F.col("n")))
    lines += [telemetry.exposition(name, tool, F.col(c)) for name, c in (("requests_total", "n"), ("requests_ok_total", "success"), ("latency_ms_count", "n"))]
    return t.select(F.explode(F.array(*lines)).alias("line"))


@query(
    f"""WITH {_CALLS}, z AS (SELECT event_id, key, ms, count(*) OVER w AS n, abs(ms - avg(ms) OVER w) / nullif(stddev_samp(ms) OVER w, 0) AS z
  FROM calls WINDOW w AS (PARTITION BY key ORDER BY us, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT event_id, key, round(z, 2) AS z, CASE WHEN z > 3.75 THEN 'high' ELSE 'medium' END AS severity FROM z WHERE n >= 30 AND z > 2.5"""
)
def rolling_zscore(spark, sf_dir):
    return telemetry.rolling_zscore(calls(spark, sf_dir), "key", ["at", "event_id"], "ms").select("event_id", "key", F.round("z", 2).alias("z"), "severity")


@query(
    f"""WITH {_STATS} SELECT key, 'success_rate' AS metric, 'error' AS severity, round(success_rate, 6) AS value FROM stats WHERE success_rate < 0.8
UNION ALL SELECT key, 'avg_ms', 'warning', round(avg_ms, 6) FROM stats WHERE avg_ms > 50"""
)
def threshold_alerts(spark, sf_dir):
    s = _stats(spark, sf_dir)
    m = F.explode(
        F.array(
            F.struct(F.lit("success_rate").alias("metric"), F.lit("error").alias("severity"), F.col("success_rate").alias("value"), (F.col("success_rate") < 0.8).alias("on")),
            F.struct(F.lit("avg_ms").alias("metric"), F.lit("warning").alias("severity"), F.col("avg_ms").alias("value"), (F.col("avg_ms") > 50).alias("on")),
        )
    ).alias("a")
    return s.select("key", m).where("a.on").select("key", "a.metric", "a.severity", F.round("a.value", 6).alias("value"))


@query(
    f"""WITH {_CALLS}, i AS (SELECT *, sum(ok::INTEGER) OVER (PARTITION BY key ORDER BY us, event_id) AS island FROM calls),
s AS (SELECT key, sum((NOT ok)::INTEGER) OVER (PARTITION BY key, island ORDER BY us, event_id) AS streak FROM i)
SELECT key, max(streak)::BIGINT AS longest FROM s GROUP BY key HAVING max(streak) >= 3"""
)
def failure_streak(spark, sf_dir):
    return telemetry.failure_streaks(calls(spark, sf_dir), "key", ["at", "event_id"]).groupBy("key").agg(F.max("streak").alias("longest")).where("longest >= 3")


@query(f"WITH {_CALLS} SELECT event_id, count(*) OVER w AS total, (sum(ok::INTEGER) OVER w)::BIGINT AS success, round(sum(ms) OVER w, 4) AS total_ms FROM calls WINDOW w AS (PARTITION BY key ORDER BY us, event_id)")
def cumulative_counters(spark, sf_dir):
    sums = {"total": F.lit(1), "success": F.col("ok").cast("int"), "total_ms": F.col("ms")}
    t = telemetry.running_totals(calls(spark, sf_dir), "key", ["at", "event_id"], sums)
    return t.select("event_id", "total", "success", F.round("total_ms", 4).alias("total_ms"))


BUCKETS = [5, 10, 25, 50, 100, 250, 1000]


@query(f"WITH {_CALLS} SELECT tool, le, count(*) FILTER (WHERE ms <= le) AS n FROM calls, (VALUES {', '.join(f'({b})' for b in BUCKETS)}) b(le) GROUP BY tool, le")
def latency_histogram(spark, sf_dir):
    g = calls(spark, sf_dir).groupBy("tool").agg(*[F.count_if(F.col("ms") <= b).alias(f"b{b}") for b in BUCKETS])
    return g.select("tool", F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{b}").alias("n")) for b in BUCKETS])).alias("x")).select("tool", "x.le", "x.n")


@query(
    f"""WITH {_CALLS}, f AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY key ORDER BY us, event_id) >= 86400000000)::INTEGER, 0) AS new FROM calls),
s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY us, event_id)::BIGINT AS session FROM f)
SELECT key, session, count(*) AS n, min(us) AS first_at, max(us) AS last_at FROM s GROUP BY key, session"""
)
def session_ttl(spark, sf_dir):
    s = telemetry.sessions(calls(spark, sf_dir), "key", "at", "event_id", 86_400_000_000)
    return s.groupBy("key", "session").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


@query("SELECT epoch(time_bucket(INTERVAL 10 SECONDS, ts))::BIGINT AS tick, event_type AS tool, count(*) AS n, round(max(value), 6) AS worst FROM events GROUP BY 1, 2")
def fixed_interval_ticks(spark, sf_dir):
    tick = F.floor(F.col("at") / 10_000_000) * 10
    return calls(spark, sf_dir).groupBy(tick.alias("tick"), "tool").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("ms"), 6).alias("worst"))


_ORDERED = f"{_CALLS}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS i FROM calls)"


@query(
    f"""WITH RECURSIVE {_ORDERED}, run AS (
  SELECT key, i, CASE WHEN ok THEN 'closed' ELSE 'failed' END AS outcome, CASE WHEN ok THEN 0 ELSE 1 END AS fails, NULL::BIGINT AS opened FROM o WHERE i = 1
  UNION ALL
  SELECT o.key, o.i,
    CASE WHEN opened IS NOT NULL AND o.us - opened < 86400000000 THEN 'rejected' WHEN ok THEN 'closed' WHEN opened IS NOT NULL OR fails + 1 >= 2 THEN 'opened' ELSE 'failed' END,
    CASE WHEN opened IS NOT NULL AND o.us - opened < 86400000000 THEN fails WHEN ok THEN 0 ELSE fails + 1 END,
    CASE WHEN opened IS NOT NULL AND o.us - opened < 86400000000 THEN opened WHEN ok THEN NULL WHEN opened IS NOT NULL OR fails + 1 >= 2 THEN o.us END
  FROM run JOIN o ON o.key = run.key AND o.i = run.i + 1)
SELECT key, outcome, count(*) AS n FROM run GROUP BY key, outcome"""
)
def circuit_breaker(spark, sf_dir):
    b = telemetry.circuit_breaker(calls(spark, sf_dir).select("key", "at", "event_id", "ok"), "key", "at", "event_id", "ok", threshold=2, recovery=86_400_000_000)
    return b.groupBy("key", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH RECURSIVE {_ORDERED}, run AS (
  SELECT key, i, CASE WHEN ok THEN 'stored' ELSE 'missed' END AS outcome, CASE WHEN ok THEN us + 86400000000 ELSE 0 END AS expiry FROM o WHERE i = 1
  UNION ALL
  SELECT o.key, o.i, CASE WHEN o.us < expiry THEN 'hit' WHEN ok THEN 'stored' ELSE 'missed' END, CASE WHEN o.us < expiry OR NOT ok THEN expiry ELSE o.us + 86400000000 END
  FROM run JOIN o ON o.key = run.key AND o.i = run.i + 1)
SELECT key, outcome, count(*) AS n FROM run GROUP BY key, outcome"""
)
def ttl_cache(spark, sf_dir):
    c = telemetry.ttl_cache(calls(spark, sf_dir).select("key", "at", "event_id", "ok"), "key", "at", "event_id", "ok", ttl=86_400_000_000)
    return c.groupBy("key", "outcome").agg(F.count(F.lit(1)).alias("n"))


# ---- memory ------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4")
def working_memory_lastn(spark, sf_dir):
    return memory.last_n(turns(spark, sf_dir), ["conv_id"], ["turn"], 4).select("conv_id", "turn", "role", "text")


_COMPACTED = """n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
b AS (SELECT *, CASE WHEN i // 3 < greatest((n - 2) // 3, 0) THEN i // 3 END AS batch FROM n)"""


@query(f"WITH {_COMPACTED} SELECT conv_id, batch, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS summary, count(*) AS n FROM b WHERE batch IS NOT NULL GROUP BY conv_id, batch")
def compaction_batches(spark, sf_dir):
    b = memory.compact(turns(spark, sf_dir), ["conv_id"], ["turn"], 5, 2).where("batch is not null")
    return b.groupBy("conv_id", "batch").agg(memory.ordered_concat(F.col("turn"), F.concat_ws(": ", "role", "text"), "\n").alias("summary"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_COMPACTED}, live AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS recent FROM b WHERE batch IS NULL GROUP BY conv_id),
old AS (SELECT conv_id, max(batch) + 1 AS batches FROM b WHERE batch IS NOT NULL GROUP BY conv_id)
SELECT conv_id, recent, coalesce(batches, 0)::BIGINT AS batches FROM live LEFT JOIN old USING (conv_id)"""
)
def memory_context(spark, sf_dir):
    b = memory.compact(turns(spark, sf_dir), ["conv_id"], ["turn"], 5, 2)
    live = b.where("batch is null").groupBy("conv_id").agg(memory.ordered_concat(F.col("turn"), F.col("text"), "\n").alias("recent"))
    old = b.where("batch is not null").groupBy("conv_id").agg((F.max("batch") + 1).alias("batches"))
    return live.join(old, "conv_id", "left").withColumn("batches", F.coalesce("batches", F.lit(0)).cast("long"))


@query("SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def latest_profile(spark, sf_dir):
    return memory.latest_per_key(turns(spark, sf_dir), ["conv_id", "role"], ["turn"]).select("conv_id", "role", "turn", "text")


@query(
    """WITH c AS (SELECT conv_id, turn, CASE WHEN length(text) <= 600 THEN text ELSE rtrim(substr(text, 1, 600), ' ') || chr(10) || '...' END AS t FROM conversations),
l AS (SELECT *, 1500 - coalesce(sum(length(t)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM c)
SELECT conv_id, turn, CASE WHEN length(t) <= room THEN t ELSE rtrim(substr(t, 1, greatest(room - 4, 0)::BIGINT), ' ') || chr(10) || '...' END AS text FROM l WHERE room > 0"""
)
def budgeted_concat(spark, sf_dir):
    return memory.within_budget(turns(spark, sf_dir).select("conv_id", "turn", "text"), ["conv_id"], ["turn"], "text", budget=1500, each=600)


@query("SELECT conv_id, array_to_string(list(role ORDER BY first), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def ordered_distinct(spark, sf_dir):
    first = turns(spark, sf_dir).groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return first.groupBy("conv_id").agg(memory.ordered_concat(F.col("first"), F.col("role"), ",").alias("roles"))
