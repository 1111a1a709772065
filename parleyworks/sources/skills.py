"""Skill files (front matter and body, or JSON) and knowledge files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

_NO = ("0", "false", "no", "off", "disabled")


def _meta(head: Column, key: str) -> Column:
    """The value of the last line ``key: value``, without quotes around it; blank where there is none."""
    every = F.regexp_extract_all(head, F.lit(rf"(?m)^[ \t]*{key}[ \t]*:(.*)$"), F.lit(1))
    value = F.coalesce(F.get(every, F.size(every) - 1), F.lit(""))
    return F.regexp_replace(strip(value), r"""^["']+|["']+$""", "")


def _items(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), strip), lambda x: x != "")


def _on(value: Column) -> Column:
    """Whether a value switches on; a blank one does."""
    return ~F.lower(strip(F.coalesce(value, F.lit("")))).isin(*_NO)


def _field(raw: Column, key: str) -> Column:
    return F.coalesce(F.get_json_object(raw, f"$.{key}"), F.lit(""))


def _listed(value: Column) -> Column:
    """A JSON list, or a text with commas, as its items."""
    listed = F.filter(F.transform(F.from_json(value, "array<string>"), strip), lambda x: x != "")
    return F.coalesce(F.when(value.startswith("["), listed), _items(value))


def read_skills(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Skills under ``root`` in load order (SKILL.md files first, then by path), and the files that gave none, with the reason."""
    every = skill_rows(spark.read.text(root, wholetext=True, recursiveFileLookup=True))
    order = [F.col("path").endswith("/SKILL.md").desc(), "path"]
    return every.where("reason is null").drop("reason").orderBy(*order), every.where("reason is not null").select("path", "reason")


def stream_skills(spark: SparkSession, root: str, most_files: int = 1000) -> DataFrame:
    """A stream of the files under ``root``, each once: skills, and those that gave none with a ``reason``, in one scan."""
    return skill_rows(spark.readStream.option("maxFilesPerTrigger", most_files).text(root, wholetext=True, recursiveFileLookup=True))


def skill_rows(files: DataFrame) -> DataFrame:
    """(path, name, description, keywords, agents, enabled, content, reason) of whole files (value), read in batch or as a stream; ``reason`` is null for a skill.

    Dot files and any README.md are skipped. A file is a skill where it has a body; a JSON file must
    be an object with ``content`` or ``instructions``. An unclosed front matter belongs to the body;
    of equal keys the last counts. Agents are lower-cased. A file is read and parsed once.
    """
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    base = F.element_at(F.split("path", "/"), -1)
    files = files.withColumns({"file": base, "stem": F.regexp_replace(base, r"\.[^.]*$", ""), "dir": F.element_at(F.split("path", "/"), -2)})
    kind = F.lower(F.regexp_extract("file", r"\.([^.]*)$", 1))
    files = files.where(~F.col("file").startswith(".") & (F.lower("file") != "readme.md") & kind.isin("md", "txt", "json")).withColumn("kind", kind)
    fence = r"(?sm)\A\s*---[ \t]*\r?\n(.*?)^[ \t]*---[ \t]*(?:\r?\n|\z)"
    head = F.regexp_extract("raw", fence, 1)
    body = strip(F.regexp_replace("raw", fence, ""))
    heading = strip(F.regexp_extract(body, r"(?m)^[ \t]*#+(.*)$", 1))
    default = F.when(F.col("file") == "SKILL.md", F.col("dir")).otherwise(F.col("stem"))
    named = F.coalesce(F.nullif(_meta(head, "name"), F.lit("")), F.nullif(heading, F.lit("")), default)
    titled = F.regexp_extract(body, r"\A#+([^\r\n]*)", 1)
    cut = F.when(body.startswith("#") & (strip(titled) == named), strip(F.regexp_replace(body, r"\A#+[^\r\n]*", ""))).otherwise(body)
    raw = F.col("raw")
    content = strip(F.coalesce(F.nullif(_field(raw, "content"), F.lit("")), _field(raw, "instructions")))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False))
    text = F.struct(
        named.alias("name"),
        _meta(head, "description").alias("description"),
        _items(_meta(head, "keywords")).alias("keywords"),
        F.transform(_items(_meta(head, "agents")), F.lower).alias("agents"),
        _on(_meta(head, "enabled")).alias("enabled"),
        cut.alias("content"),
        F.when(body == "", "no body").alias("reason"),
    )
    json = F.struct(
        F.coalesce(F.nullif(_field(raw, "name"), F.lit("")), "stem").alias("name"),
        _field(raw, "description").alias("description"),
        _listed(_field(raw, "keywords")).alias("keywords"),
        F.transform(_listed(_field(raw, "agents")), F.lower).alias("agents"),
        _on(_field(raw, "enabled")).alias("enabled"),
        content.alias("content"),
        F.when(~is_object, "no JSON object").when(content == "", "no content or instructions").alias("reason"),
    )
    return files.select("path", F.when(F.col("kind") == "json", json).otherwise(text).alias("s")).select("path", "s.*")


def read_knowledge(spark: SparkSession, path: str, max_bytes: int = 10 << 20) -> DataFrame:
    """(title, content) of a JSON array of records, or of whole text files; files over ``max_bytes`` are left out (``refused_knowledge`` names them)."""
    if path.endswith(".json"):
        rows = spark.read.schema("title string, content string").option("multiLine", True).json(path)
        sized = rows.where(F.col("_metadata.file_size") <= max_bytes)
        return sized.select(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"))
    rows = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_size") <= max_bytes)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("title"), F.regexp_replace("value", "�", "").alias("content"))


def refused_knowledge(spark: SparkSession, path: str, max_bytes: int = 10 << 20) -> DataFrame:
    """(path, bytes, reason) of the files that ``read_knowledge`` leaves out."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    return files.where(F.col("bytes") > max_bytes).withColumn("reason", F.lit(f"larger than {max_bytes} bytes"))
