"""Registered queries on the vector leg, the full vote and route, skills, memory tiers and replies, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors
from ..operators import classify, memory, retrieve, skills, telemetry
from ..sources.tables import calls, read, turns
from .queries import _CALLS, _COMPACTED, DICTIONARY, GENERIC, LEVELS, RULES, _labelled, _sql_hits, query

# ---- the vector leg and the vote ------------------------------------------------------------------

#: Example texts of each label, for the given tables.
TEMPLATES = [
    ("order_status", ["the one with this from the", "what is from the one with this"]),
    ("logistics", ["to be on the way", "that to be on the"]),
    ("refund", ["for the that of the", "that for the and that"]),
    ("query", ["is it what was", "was that what is"]),
    ("request", ["it be by it", "by it and be it"]),
]
KNOWN = ["order_status", "logistics", "refund", "request"]
SPECIFIC = ["order_status", "logistics", "refund"]
GROUPS = {"refund": "billing", "logistics": "general", "order_status": "general"}

_TEXT = "lower(trim(text, ' ' || chr(9) || chr(10) || chr(13)))"


def sql_vectors(name: str, source: str, keys: str) -> str:
    """CTE ``name`` (keys, slot, value) from CTE or table ``source`` (keys, t)."""
    return f"""{name} AS (
  SELECT {keys}, (('0x' || substr(md5(g), 1, 8))::BIGINT % 256)::INTEGER AS slot, sum(CASE WHEN ('0x' || substr(md5(g), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS value
  FROM (SELECT DISTINCT {keys}, substr(t, i, n) AS g FROM (SELECT {keys}, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM {source}, (VALUES (1), (2), (3)) v(n) WHERE length(t) >= n)
    UNION SELECT {keys}, '' FROM {source} WHERE length(t) = 0)
  GROUP BY ALL)"""


_TEMPLATE_ROWS = ", ".join(f"('{label}', {i}, {j}, '{t}')" for i, (label, texts) in enumerate(TEMPLATES) for j, t in enumerate(texts))
_MATCHED = f"""src AS (SELECT conv_id, turn, {_TEXT} AS t FROM conversations),
tpl AS (SELECT label, ord, no, t FROM (VALUES {_TEMPLATE_ROWS}) v(label, ord, no, t)),
{sql_vectors("mv", "src", "conv_id, turn")},
{sql_vectors("tv", "tpl", "label, ord, no")},
mn AS (SELECT conv_id, turn, sqrt(sum(value * value)) AS norm FROM mv GROUP BY ALL),
tn AS (SELECT label, ord, no, sqrt(sum(value * value)) AS norm FROM tv GROUP BY ALL),
cosine AS (SELECT conv_id, turn, label, ord, max(dot / (mn.norm * tn.norm)) AS c FROM (
  SELECT conv_id, turn, label, ord, no, sum(mv.value * tv.value) AS dot FROM mv JOIN tv USING (slot) GROUP BY ALL) JOIN mn USING (conv_id, turn) JOIN tn USING (label, ord, no) WHERE mn.norm * tn.norm > 0 GROUP BY ALL),
matched AS (
  SELECT conv_id, turn, coalesce(label, 'other') AS m_label, coalesce(c, 0)::DOUBLE AS m_score FROM conversations LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(c, 9) DESC, ord) AS rn FROM cosine WHERE c > 0) b USING (conv_id, turn) WHERE coalesce(rn, 1) = 1)"""


@query(f"WITH {_MATCHED} SELECT conv_id, turn, m_label AS label, round(m_score, 6) AS confidence FROM matched")
def template_match(spark, sf_dir):
    df = vectors.best_template(turns(spark, sf_dir).select("conv_id", "turn", "text"), "text", TEMPLATES)
    return df.select("conv_id", "turn", "match.label", F.round("match.confidence", 6).alias("confidence"))


def _voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote on each turn. The next turn's words stand for the model's answer; a last turn has none, so the model failed there."""
    df = vectors.best_template(_labelled(spark, sf_dir).select("conv_id", "turn", "text", "label", "score"), "text", TEMPLATES)
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = df.withColumns({"said": F.lead("label").over(w), "sure": F.lead("score").over(w)})
    legs = [
        (1, 0.7, classify.known_label(F.col("said"), KNOWN), F.coalesce("sure", F.lit(0.0)), F.col("said").isNull()),
        (2, 0.2, F.col("match.label"), F.col("match.confidence"), F.lit(False)),
        (3, 0.1, F.col("label"), F.col("score"), F.lit(False)),
    ]
    row = [F.struct(F.lit(n).alias("leg"), F.lit(w).alias("weight"), label.alias("label"), c.alias("confidence"), failed.alias("failed")) for n, w, label, c, failed in legs]
    return df.withColumn("vote", classify.vote_row(F.array(*row), GENERIC, SPECIFIC))


_VOTE = f"""{_sql_hits()}, {_MATCHED},
n AS (SELECT conv_id, turn, label, score, m_label, m_score, lead(label) OVER w AS said, lead(score) OVER w AS sure
  FROM best JOIN matched USING (conv_id, turn) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
legs AS (
  SELECT conv_id, turn, 1 AS leg, 0.7::DOUBLE AS weight, CASE WHEN said IN ({', '.join(f"'{x}'" for x in KNOWN)}) THEN said ELSE 'other' END AS x, coalesce(sure, 0)::DOUBLE AS c FROM n
  UNION ALL SELECT conv_id, turn, 2, 0.2::DOUBLE, m_label, m_score FROM n UNION ALL SELECT conv_id, turn, 3, 0.1::DOUBLE, label, score FROM n),
sums AS (SELECT conv_id, turn, x, sum(weight * c) AS s, min(leg) AS first FROM legs GROUP BY ALL),
top AS (SELECT conv_id, turn, x, s FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(s, 9) DESC, first) AS rn FROM sums) WHERE rn = 1),
voted AS (
  SELECT conv_id, turn,
    CASE WHEN said IS NULL THEN CASE WHEN m_label <> 'other' AND m_score > 0 THEN m_label WHEN label <> 'other' AND score > 0 THEN label ELSE 'other' END
      WHEN yields THEN label WHEN s < 0.5 THEN 'other' ELSE x END AS v_label,
    CASE WHEN said IS NULL THEN CASE WHEN m_label <> 'other' AND m_score > 0 THEN m_score WHEN label <> 'other' AND score > 0 THEN score ELSE 0 END
      WHEN yields THEN greatest(s, score) ELSE s END AS v_score
  FROM (SELECT *, x IN ('query', 'request') AND label IN ({', '.join(f"'{x}'" for x in SPECIFIC)}) AND score >= 0.5 AND s < 0.8 AS yields FROM n JOIN top USING (conv_id, turn)))"""


@query(
    f"WITH {_VOTE} SELECT conv_id, turn, v_label AS label, round(v_score, 6) AS confidence, CASE v_label "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GROUPS.items())
    + " ELSE v_label END AS label_group FROM voted"
)
def intent_vote(spark, sf_dir):
    df = _voted(spark, sf_dir).select("conv_id", "turn", "vote.label", F.round("vote.confidence", 6).alias("confidence"))
    return df.withColumn("label_group", classify.label_group(F.col("label"), GROUPS))


# ---- the full route, over documents -----------------------------------------------------------------

TO_PERSON = ["request"]
_LATIN = "[\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}]"


def _sql_routed() -> str:
    entity = {k: f"regexp_matches({f'''regexp_replace(text, '{_LATIN}', 'x', 'g')''' if k == 'error_code' else 'text'}, '{tx.SQL_ENTITIES[k]}')" for k in ("error_code", "amount", "order_id")}
    bonus = {"technical": ("error_code", 0.2), "billing": ("amount", 0.15), "general": ("order_id", 0.1)}
    parts = []
    for i, (d, base, labels, more, kws, step, cap) in enumerate(RULES):
        hits = " + ".join(f"contains(lower(text), '{k}')::INTEGER" for k in kws)
        label = ", ".join(f"'{x}'" for x in labels)
        kind, extra = bonus[d]
        parts.append(
            f"SELECT conv_id, '{d}' AS domain, {i} AS ord, round({base}::DOUBLE + CASE WHEN label IN ({label}) THEN {more}::DOUBLE ELSE 0 END + least({cap}::DOUBLE, ({hits}) * {step}::DOUBLE) "
            f"+ CASE WHEN {entity[kind]} THEN {extra}::DOUBLE ELSE 0 END, 3) AS s FROM best"
        )
    level = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{k}')" for k in ks) + f" THEN {n}" for n, ks in LEVELS) + " ELSE 1 END"
    return f"""WITH conversations AS (SELECT doc_id AS conv_id, 0 AS turn, '' AS role, text FROM documents), {_sql_hits()},
scores AS ({' UNION ALL '.join(parts)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, ord) AS rn, max(s) OVER (PARTITION BY conv_id) AS top FROM scores),
routed AS (SELECT conv_id, max(domain) FILTER (WHERE rn = 1) AS first,
  coalesce(string_agg(domain, ',' ORDER BY rn) FILTER (WHERE rn > 1 AND domain <> 'general' AND s >= 0.45 AND s >= 0.55 * top), '') AS near, round(least(max(top), 1.0), 3) AS sure FROM ranked GROUP BY conv_id),
j AS (SELECT *, {level} = 4 AS critical, label IN ({', '.join(f"'{x}'" for x in TO_PERSON)}) AS person FROM routed JOIN best USING (conv_id))
SELECT conv_id AS doc_id, label, CASE WHEN critical OR person THEN 'escalation' ELSE first END AS primary_domain, CASE WHEN critical OR person THEN '' ELSE near END AS supporting,
  (CASE WHEN critical THEN 1.0::DOUBLE WHEN person THEN greatest(score, 0.8) ELSE sure END)::DOUBLE AS confidence, CASE WHEN critical OR person THEN 'general' ELSE first END AS agent FROM j"""


@query(_sql_routed())
def full_route(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id", "text")
    # what is used more than once is a column of its own, so it is worked out once
    df = df.withColumns({f"has_{k}": F.col("text").rlike(tx.ENTITIES[k]) for k in ("error_code", "amount", "order_id")})
    df = df.withColumn("hits", classify.keyword_hits(F.col("text"), DICTIONARY))
    df = df.withColumn("best", classify.best_label(F.col("hits"))).select("*", "best.label", "best.score")
    bonuses = [("technical", F.col("has_error_code"), 0.2), ("billing", F.col("has_amount"), 0.15), ("general", F.col("has_order_id"), 0.1)]
    df = df.withColumns({"scores": classify.domain_scores(F.col("text"), F.col("label"), RULES, bonuses), "urgency": classify.urgency(F.col("text"), F.col("label"), LEVELS)})
    r = classify.route_request(F.col("scores"), F.col("urgency"), F.col("label"), F.col("score"), TO_PERSON)
    return df.select("doc_id", "label", r.alias("r")).select("doc_id", "label", F.col("r.primary").alias("primary_domain"), "r.supporting", "r.confidence", "r.agent")


# ---- skills ---------------------------------------------------------------------------------------

#: Skills for the given tables, in load order: name, description, keywords, agents, enabled, content.
SKILLS = [
    ("greeting", "", [], [], True, "Say who you are. " * 20),
    ("tracking", "where things are", ["from the", "on the"], ["technical", "general"], True, "Look up the parcel. " * 30),
    ("refunds", "when money goes back", ["that"], ["billing"], True, "Check the date of purchase. " * 40),
    ("old", "", ["is"], [], False, "Not in use."),
    ("closing", "how to end", ["to be", "with"], [], True, "Ask if there is more. " * 25),
]


def _sql_skills() -> str:
    arr = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    block = lambda name, desc, body: f"### {name}" + (f"\n{skills.ABOUT}{desc}" if desc else "") + "\n" + (body.strip() if len(body.strip()) <= 600 else body.strip()[:600].rstrip() + "\n...")
    rows = ", ".join(f"({i}, '{n}', {arr(k)}, {arr(a)}, '{block(n, d, c)}')" for i, (n, d, k, a, on, c) in enumerate(SKILLS) if on)
    return f"""WITH RECURSIVE agent AS (SELECT *, ['general', 'technical', 'billing'][turn % 3 + 1] AS agent FROM conversations),
hit AS (SELECT conv_id, turn, name, block, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ord) AS i FROM agent, (VALUES {rows}) s(ord, name, kws, agents, block)
  WHERE (len(agents) = 0 OR list_contains(agents, agent)) AND (len(kws) = 0 OR len(list_filter(kws, lambda k: contains(lower(text), k))) > 0)),
cut AS (SELECT conv_id, turn, 0::BIGINT AS i, 1500::BIGINT AS room, '' AS prompt, '' AS names FROM conversations
  UNION ALL SELECT conv_id, turn, hit.i, room - length(b), CASE WHEN prompt = '' THEN b ELSE prompt || chr(10) || chr(10) || b END, CASE WHEN names = '' THEN name ELSE names || ',' || name END
  FROM (SELECT cut.*, hit.i AS j, hit.name, CASE WHEN length(block) > room THEN rtrim(substr(block, 1, room), ' ' || chr(10)) || chr(10) || '...' ELSE block END AS b FROM cut JOIN hit ON hit.conv_id = cut.conv_id AND hit.turn = cut.turn AND hit.i = cut.i + 1 WHERE room > 0) x
  JOIN hit USING (conv_id, turn, name))
SELECT conv_id, turn, names, md5(prompt) AS prompt_md5, length(prompt)::BIGINT AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i DESC) AS rn FROM cut) WHERE rn = 1"""


@query(_sql_skills())
def skill_prompts(spark, sf_dir):
    table = spark.createDataFrame([(i, *s) for i, s in enumerate(SKILLS)], "ord int, name string, description string, keywords array<string>, agents array<string>, enabled boolean, content string")
    agent = F.get(F.array(*map(F.lit, ("general", "technical", "billing"))), (F.col("turn") % 3).cast("int"))
    df = skills.match_skills(turns(spark, sf_dir).withColumn("agent", agent), table, "text", "agent", budget=1500, each=600)
    return df.select("conv_id", "turn", F.array_join("skills", ",").alias("names"), F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("long").alias("n_chars"))


# ---- memory tiers --------------------------------------------------------------------------------------

_SUMMED = f"""{_COMPACTED},
full_text AS (SELECT conv_id, batch, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body FROM b WHERE batch IS NOT NULL GROUP BY ALL),
episodes AS (SELECT conv_id * 1000 + batch AS id, conv_id % 10 AS user_id, conv_id, batch, substr(body, 1, 200) AS summary, substr(body, 1, 500) AS excerpt FROM full_text)"""


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, conv_id, batch, summary, excerpt): what each compaction stores. A cut of the text stands for the model's summary."""
    b = memory.compact(turns(spark, sf_dir), ["conv_id"], ["turn"], 5, 2).where("batch is not null")
    body = b.groupBy("conv_id", "batch").agg(memory.ordered_concat(F.col("turn"), F.concat_ws(": ", "role", "text"), "\n").alias("body"))
    return body.select(
        (F.col("conv_id") * 1000 + F.col("batch")).alias("id"), (F.col("conv_id") % 10).alias("user_id"), "conv_id", "batch", F.substring("body", 1, 200).alias("summary"), F.substring("body", 1, 500).alias("excerpt")
    )


@query(f"WITH {_SUMMED} SELECT id, user_id, summary, excerpt FROM episodes")
def episodic_rows(spark, sf_dir):
    return _episodes(spark, sf_dir).select("id", "user_id", "summary", "excerpt")


@query(
    f"""WITH {_SUMMED},
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)),
qs AS (SELECT conv_id, {_TEXT} AS t FROM last WHERE rn = 1),
es AS (SELECT id, {_TEXT.replace('text', 'summary')} AS t FROM episodes),
{sql_vectors("qv", "qs", "conv_id")}, {sql_vectors("ev", "es", "id")},
qn AS (SELECT conv_id, sqrt(sum(value * value)) AS norm FROM qv GROUP BY 1), en AS (SELECT id, sqrt(sum(value * value)) AS norm FROM ev GROUP BY 1),
pairs AS (SELECT qs.conv_id AS c, e.id, e.summary FROM qs JOIN episodes e ON qs.conv_id % 10 = e.user_id WHERE qs.t <> ''),
dots AS (SELECT c, pairs.id, summary, coalesce(sum(qv.value * ev.value), 0) AS dot FROM pairs JOIN qv ON qv.conv_id = c LEFT JOIN ev ON ev.id = pairs.id AND ev.slot = qv.slot GROUP BY ALL),
near AS (SELECT c, summary, row_number() OVER (PARTITION BY c ORDER BY round(2 - 2 * dot / (qn.norm * en.norm), 6), dots.id) AS rank FROM dots JOIN qn ON qn.conv_id = c JOIN en ON en.id = dots.id),
history AS (SELECT c AS conv_id, string_agg(summary, chr(10) ORDER BY rank) AS history FROM near WHERE rank <= 5 GROUP BY c),
recent AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS recent FROM b WHERE batch IS NULL GROUP BY conv_id),
summaries AS (SELECT conv_id, trim(string_agg(summary, chr(10) ORDER BY batch), ' ' || chr(10)) AS summary FROM episodes GROUP BY conv_id),
profile AS (SELECT user_id, text AS profile FROM (SELECT conv_id % 10 AS user_id, substr(text, 1, 100) AS text, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id DESC, turn DESC) AS rn FROM conversations WHERE role = 'user') WHERE rn = 1)
SELECT conv_id, conv_id % 10 AS user_id, recent, coalesce(history, '') AS history, coalesce(profile, '') AS profile, coalesce(summary, '') AS summary
FROM recent LEFT JOIN history USING (conv_id) LEFT JOIN summaries USING (conv_id) LEFT JOIN profile ON profile.user_id = conv_id % 10"""
)
def memory_tiers(spark, sf_dir):
    t = turns(spark, sf_dir)
    user = (F.col("conv_id") % 10).alias("user_id")
    episodes = _episodes(spark, sf_dir)
    last = memory.latest_per_key(t, ["conv_id"], ["turn"]).where(tx.strip(F.col("text")) != "").select(F.col("conv_id").alias("q_id"), user.alias("key"), "text")
    live = memory.compact(t, ["conv_id"], ["turn"], 5, 2).where("batch is null")
    profile = memory.latest_per_key(t.where("role = 'user'").withColumn("user_id", user), ["user_id"], ["conv_id", "turn"]).select("user_id", F.substring("text", 1, 100).alias("profile"))
    near = retrieve.knn_within(vectors.dense_vectors(last, "text", "vec"), vectors.dense_vectors(episodes.withColumnRenamed("user_id", "key"), "summary", "vec"), 5, skip_self=False)
    return memory.assemble(
        live.groupBy("conv_id").agg(memory.ordered_concat(F.col("turn"), F.concat_ws(": ", "role", "text"), "\n").alias("recent")).withColumn("user_id", user),
        near.join(episodes.select("id", "summary"), "id").groupBy(F.col("q_id").alias("conv_id")).agg(memory.ordered_concat(F.col("rank"), F.col("summary"), "\n").alias("history")),
        profile,
        episodes.groupBy("conv_id").agg(tx.strip(memory.ordered_concat(F.col("batch"), F.col("summary"), "\n")).alias("summary")),
    )


# ---- replies, cases and counts ----------------------------------------------------------------------


@query(
    """SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'system' AND text <> ''), '') AS reply,
  string_agg(substr(text, 1, 40), ' / ' ORDER BY turn) FILTER (WHERE turn < first + 3) AS opening FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations) GROUP BY conv_id"""
)
def reply_blocks(spark, sf_dir):
    kind = F.when(F.col("role") == "system", F.lit("tool_use")).otherwise(F.lit("text"))
    block = F.struct("turn", kind.alias("type"), "text")
    df = turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    first = F.filter("blocks", lambda x: x["turn"] < F.get("blocks", F.lit(0))["turn"] + 3)
    return df.select("conv_id", tx.reply_text(F.col("blocks")).alias("reply"), F.array_join(F.transform(first, lambda x: F.substring(x["text"], 1, 40)), " / ").alias("opening"))


@query(
    """SELECT conv_id, array_to_string(CASE WHEN conv_id % 3 = 0 THEN list(text ORDER BY turn) FILTER (WHERE role = 'user') WHEN conv_id % 3 = 1 THEN [min(text)] ELSE [] END, ' / ') AS turns
FROM conversations GROUP BY conv_id"""
)
def dialog_cases(spark, sf_dir):
    users = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["role"] == "user"), lambda x: x["text"])
    df = turns(spark, sf_dir).groupBy("conv_id").agg(users.alias("users"), F.min("text").alias("least"))
    listed, question = F.when(F.col("conv_id") % 3 == 0, F.col("users")), F.when(F.col("conv_id") % 3 == 1, F.col("least"))
    return df.select("conv_id", F.array_join(tx.dialog_turns(listed, question), " / ").alias("turns"))


@query(
    """WITH e AS (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, user_id FROM events),
p AS (SELECT event_id, list_filter([k, user_id, 3], lambda x: x BETWEEN 0 AND 59) AS places FROM e)
SELECT event_id, places[1] AS best, array_to_string(places, ',') AS places FROM p"""
)
def reply_order(spark, sf_dir):
    """The places of up to 60 hits that a reply lists: each event's properties and user stand for what a model answers."""
    said = F.concat(F.lit("order: ["), F.get_json_object("props", "$.k"), F.lit(", "), F.col("user_id").cast("string"), F.lit(", 3] by use"))
    order = F.filter(F.from_json(tx.json_list(said), "array<long>"), lambda x: x.between(0, 59))
    return read(spark, sf_dir, "events").select("event_id", F.get(order, F.lit(0)).alias("best"), F.array_join(order.cast("array<string>"), ",").alias("places"))


@query(f"WITH {_CALLS}, f AS (SELECT key, tool, row_number() OVER (PARTITION BY key, tool ORDER BY us, event_id) > 1 AS hit FROM calls) SELECT tool, count(*) AS total, round(avg(hit::INTEGER), 6) AS hit_rate FROM f GROUP BY tool")
def hit_rate(spark, sf_dir):
    """How many calls a cache without an end would answer: all of a caller and tool but the first."""
    per = calls(spark, sf_dir).groupBy("tool", "key").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("tool").agg(F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("hits"))
    return out.select("tool", "total", F.round(F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)), 6).alias("hit_rate"))


@query(
    """WITH stored AS (SELECT DISTINCT lower(text) AS t FROM documents WHERE doc_id % 2 = 0)
SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM stored WHERE t = lower(text)) GROUP BY source"""
)
def new_texts(spark, sf_dir):
    """Documents of odd id, counted by source, whose text no document of even id has. Texts meet by two hashes, so they are not moved."""
    key = [F.xxhash64(F.lower("text")).alias("a"), F.xxhash64(F.lit(1), F.lower("text")).alias("b")]
    docs = read(spark, sf_dir, "documents")
    stored = docs.where("doc_id % 2 = 0").select(*key).distinct()
    return docs.where("doc_id % 2 = 1").select("source", *key).join(stored, ["a", "b"], "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_RESOLVED = f"""{_CALLS}, r AS (SELECT *, min(CASE WHEN ok THEN us END) OVER (PARTITION BY key ORDER BY us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS resolved_at FROM calls)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts for failures slower than 50 ms, with the time of the caller's next success."""
    return telemetry.resolutions(calls(spark, sf_dir), "key", ["at", "event_id"]).where("not ok and ms > 50")


@query(f"WITH {_RESOLVED} SELECT key, count(*) AS n, min(us) AS since FROM r WHERE NOT ok AND ms > 50 AND resolved_at IS NULL GROUP BY key")
def unresolved_alerts(spark, sf_dir):
    """Alerts of callers that have had no success since, with the time of the first."""
    return _resolved(spark, sf_dir).where("resolved_at is null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("since"))


@query(f"WITH {_RESOLVED} SELECT event_id, key, us AS at, resolved_at IS NOT NULL AS resolved, resolved_at FROM r WHERE NOT ok AND ms > 50")
def alert_resolutions(spark, sf_dir):
    return _resolved(spark, sf_dir).select("event_id", "key", "at", F.col("resolved_at").isNotNull().alias("resolved"), "resolved_at")
