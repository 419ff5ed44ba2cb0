"""Shaping of single values: seasons, times, shown cells, indexes, composite keys, damaged JSON, tuples, tag lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def season(ts: Column) -> Column:
    m = F.month(ts)
    return F.when(m.between(3, 5), "spring").when(m.between(6, 8), "summer").when(m.between(9, 11), "autumn").otherwise("winter")


def parsed_time(text: Column) -> Column:
    """ISO or SQL times as a timestamp without zone; null if neither."""
    plain = F.regexp_replace(F.regexp_replace(text, "T", " "), r"(\.\d+)?Z?$", "")
    return F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def cell(x: Column, kind: str) -> Column:
    """A number as it is shown: integer, percent or float; halves are rounded up."""
    up = lambda v: F.floor(v + 0.5).cast("bigint").cast("string")
    if kind == "percent":
        return F.concat(up(x * 100), F.lit("%"))
    return up(x) if kind == "integer" else F.format_number(x, 2)


def paragraph_index(text: Column) -> Column:
    """A paragraph's number, truncated; -1 for what is no number or below -1."""
    x = text.try_cast("double")
    return F.coalesce(F.when(~F.isnan(x) & (x >= -1), x.cast("bigint")), F.lit(-1).cast("bigint"))


def composite_key(text: Column, chapters: int) -> Column:
    """struct(chapter, para, side) of 'chapter:para[:side]'; all null unless both are numbers and the chapter is in range."""
    parts = F.split(text, ":")
    chapter, para = parts[0].try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    fine = chapter.between(1, chapters) & para.isNotNull()
    return F.struct(F.when(fine, chapter).alias("chapter"), F.when(fine, para).alias("para"), F.when(fine, F.get(parts, F.lit(2))).alias("side"))


def repaired_json(text: Column, schema: str) -> Column:
    """JSON from the first opening brace to the last closing one, without trailing commas; a missing closing brace is added."""
    body = F.regexp_replace(F.regexp_extract(text, r"(?s)\{.*", 0), r"(?s)\}[^}]*$", "}")
    closed = F.when(body.endswith("}"), body).otherwise(F.concat(body, F.lit("}")))
    return F.from_json(F.regexp_replace(closed, r",\s*([}\]])", "$1"), schema)


def delimited(text: Column, mark: str = "<|#|>") -> Column:
    return F.transform(F.split(text, r"\Q" + mark + r"\E"), lambda x: F.trim(x))


def projected(items: Column, field: str) -> Column:
    return F.transform(items, lambda x: x[field])


def tag_list(fields: Sequence[Column], dropped: str) -> Column:
    """All fields' tags without empty and dropped ones, each once, in the order of their first place."""
    return F.array_distinct(F.filter(F.flatten(F.array(*fields)), lambda t: t.isNotNull() & (t != "") & (t != dropped)))
