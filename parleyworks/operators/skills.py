"""Skills for requests: which ones apply, and the prompt that they make within a budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, truncate
from .keywords import keyword_pairs

# Fixed value: what stands before a skill's description in its block.
ABOUT = "说明: "


def applies(skill: Column, message: Column, agent: Column) -> Column:
    """Whether a skill (enabled, agents, keywords) is for this agent (null or blank: any) and one of its keywords is in the message; no agents or keywords mean all."""
    low, who = F.lower(F.coalesce(message, F.lit(""))), F.lower(F.coalesce(agent, F.lit("")))
    by_agent = (F.size(skill["agents"]) == 0) | (who == "") | F.array_contains(skill["agents"], who)
    return skill["enabled"] & by_agent & ((F.size(skill["keywords"]) == 0) | F.exists(skill["keywords"], lambda k: F.contains(low, F.lower(k))))


def block(name: Column, description: Column, content: Column, each: int = 3200) -> Column:
    """A skill as a part of a prompt: a heading, its description if any, and its body of up to ``each`` characters."""
    about = F.when(description != "", F.concat(F.lit("\n" + ABOUT), description)).otherwise("")
    return F.concat(F.lit("### "), name, about, F.lit("\n"), truncate(strip(content), each))


def fold_blocks(blocks: Column, budget: int) -> Column:
    """(parts, left): blocks in order while there is room; the one that overflows is cut to what is left and marked, and the mark counts too."""

    def step(acc: Column, b: Column) -> Column:
        part = F.when(F.length(b) > acc["left"], F.concat(F.regexp_replace(b.substr(F.lit(1), acc["left"]), r"(?U)\s+$", ""), F.lit("\n..."))).otherwise(b)
        more = F.struct(F.concat(acc["parts"], F.array(part)).alias("parts"), (acc["left"] - F.length(part)).alias("left"))
        return F.when(acc["left"] > 0, more).otherwise(acc)

    return F.aggregate(blocks, F.struct(F.array().cast("array<string>").alias("parts"), F.lit(budget).alias("left")), step)


def match_skills(
    requests: DataFrame, skills: DataFrame, message: str, agent: str, budget: int = 5000, each: int = 3200, lead: str = "", most: int = 1000, key: Sequence[str] = ()
) -> DataFrame:
    """``requests`` with ``skills`` (the names of those in the prompt, in load order) and ``prompt`` (empty where none applies).

    Up to ``most`` skills (ord, name, description, keywords, agents, enabled, content) become one row that is broadcast, so no request
    is multiplied or moved. More are found by ``match_many_skills``, which needs the ``key`` of the requests.
    """
    if skills.limit(most + 1).count() > most:
        return match_many_skills(requests, skills, message, agent, key, budget, each, lead)
    item = F.struct("ord", "name", "keywords", "agents", "enabled", block(F.col("name"), F.coalesce("description", F.lit("")), F.col("content"), each).alias("block"))
    every = skills.agg(F.array_sort(F.collect_list(item)).alias("__skills"))  # one row
    hits = F.filter("__skills", lambda s: applies(s, F.col(message), F.col(agent)))
    out = requests.join(F.broadcast(every)).withColumn("__hits", hits).drop("__skills")
    out = out.withColumn("__fold", fold_blocks(F.transform("__hits", lambda s: s["block"]), budget))
    names = F.slice(F.transform("__hits", lambda s: s["name"]), 1, F.size("__fold.parts"))
    text = F.array_join("__fold.parts", "\n\n")
    return out.withColumns({"skills": names, "prompt": F.when(F.size("__fold.parts") > 0, F.concat(F.lit(lead), text)).otherwise("")}).drop("__hits", "__fold")


def match_many_skills(requests: DataFrame, skills: DataFrame, message: str, agent: str, key: Sequence[str], budget: int = 5000, each: int = 3200, lead: str = "") -> DataFrame:
    """``match_skills`` for any number of skills; ``key`` names columns that are distinct and not null.

    One automaton of all keywords finds the skills of a request; skills without keywords meet requests by agent. A block has five
    characters at least, so no more than ``budget / 5`` skills of a request, in load order, can be in its prompt, and only these look up their blocks.
    """
    if not key:
        raise ValueError("many skills are matched by the requests' key, so name its columns")
    key, room = list(key), budget // 5 + 1
    on = skills.where("enabled")
    who = F.lower(F.coalesce(F.col(agent), F.lit(""))).alias("__who")
    asked = requests.select(*key, message, who)
    words = on.select(F.col("ord").alias("id"), F.explode("keywords").alias("keyword")).withColumn("keyword", F.lower("keyword"))
    hits = keyword_pairs(asked.withColumn(message, F.coalesce(message, F.lit(""))), key, message, words).select(*key, F.col("entry").alias("ord"))
    agents = on.select("ord", "agents")
    hits = hits.join(agents, "ord").join(asked.select(*key, "__who"), key).where((F.size("agents") == 0) | (F.col("__who") == "") | F.array_contains("agents", F.col("__who")))
    # skills without keywords: for each agent that asks the first ones that are for it
    plain = on.where(F.size("keywords") == 0).select("ord", "agents")
    askers = asked.select("__who").distinct()
    named = plain.select("ord", F.explode("agents").alias("__who")).join(askers, "__who")
    open_to_all = first_of(plain.where(F.size("agents") == 0).withColumn("__all", F.lit(0)), ["__all"], room).select("ord")
    blank = first_of(plain.withColumn("__all", F.lit(0)), ["__all"], room).select("ord", F.lit("").alias("__who"))
    general = first_of(named.select("__who", "ord"), ["__who"], room).unionByName(askers.where("__who <> ''").join(F.broadcast(open_to_all))).unionByName(blank)
    found = hits.select(*key, "ord").unionByName(asked.select(*key, "__who").join(first_of(general.distinct(), ["__who"], room), "__who").select(*key, "ord"))
    blocks = on.select("ord", "name", block(F.col("name"), F.coalesce("description", F.lit("")), F.col("content"), each).alias("block"))
    item = F.struct("ord", "name", "block")
    parts = first_of(found.distinct(), key, room).join(blocks, "ord").groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("__hits"))
    out = requests.join(parts, key, "left").withColumn("__hits", F.coalesce("__hits", F.array().cast(parts.schema["__hits"].dataType)))
    out = out.withColumn("__fold", fold_blocks(F.transform("__hits", lambda s: s["block"]), budget))
    names = F.slice(F.transform("__hits", lambda s: s["name"]), 1, F.size("__fold.parts"))
    text = F.array_join("__fold.parts", "\n\n")
    return out.withColumns({"skills": names, "prompt": F.when(F.size("__fold.parts") > 0, F.concat(F.lit(lead), text)).otherwise("")}).select(*requests.columns, "skills", "prompt")


def first_of(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The ``n`` rows of smallest ``ord`` of each key; Spark keeps as many in each task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy("ord")
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
