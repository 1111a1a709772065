"""Queries of the operators for dictionaries, vectors, keys and stores that grow, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keywords, pivots, skills
from ..sources.tables import read, turns
from .queries import _KNN, query

# ---- large dictionaries ------------------------------------------------------------------------------

# every word of the conversations is a keyword of its role: tier 1 for the user, 0 for the others
_WORDS = """words AS (
  SELECT DISTINCT role AS label, CASE role WHEN 'assistant' THEN 0 WHEN 'system' THEN 1 ELSE 2 END AS ord, (role = 'user')::INTEGER AS tier, w AS keyword
  FROM (SELECT role, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM conversations)),
met AS (SELECT doc_id, keyword FROM documents JOIN (SELECT DISTINCT keyword FROM words) k ON contains(lower(text), keyword)),
hits AS (SELECT doc_id, label, ord, tier, count(*) AS hits, least(1.0::DOUBLE, 0.5 + 0.25 * (count(*) - 1)) AS score FROM met JOIN words USING (keyword) GROUP BY ALL)"""


def _word_dictionary(spark, sf_dir):
    said = turns(spark, sf_dir).select("role", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("keyword")).distinct()
    ord_ = F.when(F.col("role") == "assistant", 0).when(F.col("role") == "system", 1).otherwise(2)
    return said.select(F.col("role").alias("label"), ord_.alias("ord"), F.coalesce((F.col("role") == "user").cast("int"), F.lit(0)).alias("tier"), "keyword")


@query(f"WITH {_WORDS} SELECT doc_id, label, hits, score FROM hits")
def dictionary_hits(spark, sf_dir):
    found = keywords.classify(read(spark, sf_dir, "documents"), ["doc_id"], "text", _word_dictionary(spark, sf_dir))
    return found.select("doc_id", "label", "hits", "score")


@query(
    f"""WITH {_WORDS}, best AS (SELECT doc_id, label, score FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tier, score DESC, ord) = 1)
SELECT source, coalesce(label, 'other') AS label, count(*) AS n FROM documents LEFT JOIN best USING (doc_id) GROUP BY ALL"""
)
def dictionary_labels(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    best = keywords.best_labels(keywords.classify(docs, ["doc_id"], "text", _word_dictionary(spark, sf_dir)), ["doc_id"])
    return docs.join(best, "doc_id", "left").groupBy("source", F.coalesce("label", F.lit("other")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


# ---- neighbours by pivots ----------------------------------------------------------------------------


@query(f"WITH {_KNN} SELECT q_id, id, rank, distance FROM nn WHERE rank <= 5")
def knn_by_pivots(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    index = pivots.build(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))
    found = pivots.search(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vec")), index, 5)
    return found.select("q_id", "id", "rank", "distance")


# ---- many skills -------------------------------------------------------------------------------------

# every word of the conversations is a skill with itself as keyword; the words of users are for one agent alone
_SKILLS = """skills AS (
  SELECT w, ('0x' || substr(md5(w), 1, 13))::BIGINT AS ord, bool_and(role = 'user') AS own
  FROM (SELECT role, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM conversations) GROUP BY w),
met AS (
  SELECT conv_id, turn, w, ord, sum(2 * length(w) + 9) OVER (PARTITION BY conv_id, turn ORDER BY ord) - (2 * length(w) + 9) AS before
  FROM conversations JOIN skills ON contains(lower(text), w) AND (NOT own OR turn % 3 = 0 OR turn % 3 = 1))"""


@query(
    f"""WITH {_SKILLS}, fit AS (SELECT conv_id, turn, string_agg(w, ',' ORDER BY ord) AS names FROM met WHERE before < 400 GROUP BY conv_id, turn)
SELECT conv_id, turn, coalesce(names, '') AS names FROM conversations LEFT JOIN fit USING (conv_id, turn)"""
)
def many_skills(spark, sf_dir):
    said = turns(spark, sf_dir)
    words = said.select("role", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("name")).groupBy("name").agg(F.bool_and(F.col("role") == "user").alias("own"))
    table = words.select(
        F.conv(F.substring(F.md5("name"), 1, 13), 16, 10).cast("long").alias("ord"),
        "name",
        F.lit(None).cast("string").alias("description"),
        F.array("name").alias("keywords"),
        F.when(F.col("own"), F.array(F.lit("guide"))).otherwise(F.array().cast("array<string>")).alias("agents"),
        F.lit(True).alias("enabled"),
        F.concat(F.lit("use "), "name").alias("content"),
    )
    agent = F.when(F.col("turn") % 3 == 0, "guide").when(F.col("turn") % 3 == 1, "").otherwise("clerk")
    found = skills.match_skills(said.withColumn("agent", agent), table, "text", "agent", budget=400, key=["conv_id", "turn"])
    return found.select("conv_id", "turn", F.array_join("skills", ",").alias("names"))
