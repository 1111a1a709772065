"""Column functions on text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(x: Column | str) -> Column:
    """Without surrounding white space of any kind."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def truncate(x: Column, n: int, mark: str = "\n...") -> Column:
    """``x``, or its first ``n`` characters without trailing white space and with a mark."""
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, n), r"(?U)\s+$", ""), F.lit(mark)))


def tail(x: Column, n: int) -> Column:
    """The last ``n`` items of an array."""
    return F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), F.lit(n))


def blocks(column: pa.Array, size: int = 1 << 18, rows: int = 1024) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of consecutive rows of a batch, about ``size`` bytes at a time; a larger text is a block of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, before = 0, 0
    while lo < len(column):
        hi = min(max(lo + 1, int(np.searchsorted(ends, before + size, "right"))), lo + rows)
        yield lo, column.slice(lo, hi - lo).to_pylist()
        lo, before = hi, int(ends[hi - 1])


#: What counts as white space, as in ``strip``.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def pack_sentences(sentences: list[str], size: int, joiner: str) -> list[str]:
    """Sentences joined to chunks, in one pass: lengths as a running sum, and from each chunk's first sentence a jump to its last."""
    ends = np.cumsum(np.fromiter(map(len, sentences), np.int64, len(sentences)) + len(joiner))
    out, i, before = [], 0, 0
    while i < len(sentences):
        # the next sentence must fit with one character more, whatever the joiner
        last = max(i + 1, int(np.searchsorted(ends, before + size + 2 * len(joiner) - 1, "right")))
        out.append(joiner.join(sentences[i:last]))
        i, before = last, int(ends[last - 1])
    return out


def chunk_text(text: str | None, cut: re.Pattern, size: int, joiner: str) -> list[str] | None:
    """The chunks of one text, as ``chunks`` says."""
    if text is None:
        return None
    if len(text) <= size:
        return [text] if text.strip(WHITE) else []
    return pack_sentences([s for s in cut.split(text) if s.strip(WHITE)], size, joiner)


def chunks(x: Column, size: int = 500, delimiters: str = "[。\n]", joiner: str = "。") -> Column:
    """Sentences packed into chunks of at most ``size`` characters.

    A text that fits is one chunk as it is. A chunk closes where the next sentence (and a joiner)
    does not fit; a sentence over ``size`` is never split; blank chunks are dropped. ``delimiters`` is a pattern without groups.
    Texts go through Arrow batches, and each costs its length. To explode them, take ``exploded_chunks``: Spark filters by the
    size of what it explodes and would cut each text twice.
    """
    cut, kind = re.compile(delimiters), pa.list_(pa.string())

    @F.arrow_udf("array<string>")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], kind), *(pa.array([chunk_text(t, cut, size, joiner) for t in some], kind) for _, some in blocks(texts))])

    return packed(x)


def exploded_chunks(df: DataFrame, text: str, size: int = 500, delimiters: str = "[。\n]", joiner: str = "。", names: tuple[str, str, str] = ("total_chunks", "chunk_index", "chunk")) -> DataFrame:
    """``df`` without ``text``, a row for each of its ``chunks`` with their number, its place from 0, and the chunk; a block of rows at a time."""
    rest = [f.name for f in df.schema if f.name != text]
    cut = re.compile(delimiters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(rest)
            for lo, some in blocks(batch.column(batch.schema.get_field_index(text))):
                found = [chunk_text(t, cut, size, joiner) or [] for t in some]
                n = np.fromiter(map(len, found), np.int64, len(found))
                row = np.repeat(np.arange(len(found)), n)
                index = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                columns = [pa.array(n[row].astype(np.int32)), pa.array(index.astype(np.int32)), pa.array([c for cs in found for c in cs], pa.string())]
                yield pa.RecordBatch.from_arrays([*kept.take(pa.array(row + lo)).columns, *columns], [*rest, *names])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != text)
    return df.mapInArrow(run, f"{kinds}`{names[0]}` int, `{names[1]}` int, `{names[2]}` string")


# The entity patterns.
ENTITIES = {
    "order_id": r"(?iuU)(?:订单号?|order(?:_id)?|#)\s*[:：#]?\s*([A-Za-z0-9_-]{4,32})",
    "date": r"(今天|明天|昨天|本周|这周|下周|\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?)",
    "amount": r"(?iuU)((?:¥|￥)\s*\d+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?\s*(?:元|块|rmb|cny|usd|美元))",
    "error_code": r"(?U)\b([45]\d{2}|[A-Z][A-Z0-9_-]{2,16})\b",
}

#: The same for engines without the flags u and U.
SQL_ENTITIES = {k: p.replace("(?iuU)", "(?i)").replace("(?U)", "") for k, p in ENTITIES.items()}


def entities(x: Column, patterns: dict[str, str] = ENTITIES) -> dict[str, Column]:
    """Distinct matches in order of appearance, by kind."""
    return {k: F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(p), F.lit(1)), strip)) for k, p in patterns.items()}


def json_body(x: Column) -> Column:
    """What stands from the first { to the last }, of a reply that may say more; empty where there is none."""
    return F.regexp_extract(x, r"(?s)\{.*\}", 0)


def json_list(x: Column) -> Column:
    """What stands from the first [ to the last ]; empty where there is none."""
    return F.regexp_extract(x, r"(?s)\[.*\]", 0)


def reply_text(blocks: Column) -> Column:
    """The text blocks of a reply (structs with type and text) on lines; a block without a type is text, other kinds and empty ones are left out."""
    said = F.filter(blocks, lambda b: (b["type"].isNull() | (b["type"] == "text")) & (F.coalesce(b["text"], F.lit("")) != ""))
    return F.array_join(F.transform(said, lambda b: b["text"]), "\n")


def dialog_turns(turns: Column, question: Column) -> Column:
    """The turns of a test case: its list without blank ones, else its one question, else none."""
    one = F.when(F.coalesce(question, F.lit("")) != "", F.array(question)).otherwise(F.array().cast("array<string>"))
    return F.when(turns.isNotNull(), F.filter(turns, lambda t: strip(t) != "")).otherwise(one)


def sayable(x: Column) -> Column:
    """``x`` from bytes or text without what is no UTF-8; the mark that stands for it goes too."""
    return F.replace(F.make_valid_utf8(x.cast("string")), F.lit("\ufffd"), F.lit(""))


def cache_key(text: Column, history: Column, most: int = 200, turns: int = 3, role: int = 20, content: int = 160) -> Column:
    """A hash of the cut message and its last turns (role, content), for requests that may share an answer."""
    last = F.slice(history, F.greatest(F.size(history) - turns + 1, F.lit(1)), F.lit(turns))
    said = F.transform(last, lambda t: F.concat_ws(":", F.substring(t["role"], 1, role), F.substring(t["content"], 1, content)))
    return F.md5(F.concat_ws("\x1f", F.substring(F.coalesce(text, F.lit("")), 1, most), F.array_join(said, "\x1f")))
