"""JSON values of any depth as Variants: deep merge, conflicts, and shrinking to a budget of characters.

All three walk the values level by level: the children of a level's objects and arrays become rows (`variant_explode`), each level a
stored table, and results are put together from the deepest level up. Values that need no look inside stay whole.

Defined cases
    null text: no value; merged with another, the other.     text that is no JSON: kept as text (`merged`), a string (`shrunk`).
    duplicate keys in an object: refused by the parser, so such text is no JSON.   JSON null: a value of its own, not a missing one.
    repeated ids: not allowed.        empty tables: no rows.       key order: alphabetical, as Variants have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.sources.files import stored

_CUT = "…"


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _children(rows: DataFrame, keep: list[str], col: str) -> DataFrame:
    """(keep, pos, key, value) of the members of the objects or arrays in `col`."""
    tvf = rows.sparkSession.tvf.variant_explode(F.col(col).outer())
    return rows.lateralJoin(tvf).select(*keep, "pos", "key", "value")


def _quoted(text: Column) -> Column:
    inner = F.to_json(F.array(text))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def _object(items: Column) -> Column:
    """`{...}` of an array of structs (key, json)."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(items), lambda x: F.concat(_quoted(x["key"]), F.lit(":"), x["json"])), ","), F.lit("}"))


def _sides(rows: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(id, path, o, n): the parsed values of both sides; text that is no JSON is set aside by the callers."""
    return rows.select(F.col(key).alias("id"), F.array().cast("array<string>").alias("path"), F.try_parse_json(old).alias("o"), F.try_parse_json(new).alias("n"))


def _walked(level: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per level: the nodes that are objects on both sides (their members are the next level), and all others."""
    inner, ends = [], []
    while True:
        level = stored(level.withColumn("both", _is(F.col("o"), "OBJECT") & _is(F.col("n"), "OBJECT")))
        ends.append(level.where("not both").drop("both"))
        both = level.where("both").drop("both")
        if both.isEmpty():
            return inner, ends
        inner.append(both.select("id", "path"))
        left = _children(both, ["id", "path"], "o").select("id", "path", "key", F.col("value").alias("o"))
        right = _children(both, ["id", "path"], "n").select("id", "path", "key", F.col("value").alias("n"))
        level = left.join(right, ["id", "path", "key"], "full").select("id", F.concat("path", F.array("key")).alias("path"), "o", "n")


def merged(rows: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, value): `new` merged into `old` (JSON texts). Objects are merged member by member at every depth, arrays are joined, of
    other values the new one stays. Old text that is no JSON: both, one line each; new text that is none: joins an array `_notes`
    of the old object, or takes the place of another value as a string."""
    note = F.to_json(F.named_struct(F.lit("_notes"), F.array(new)))
    broken = F.col(new).isNotNull() & F.try_parse_json(new).isNull()
    whole = F.col(old).isNotNull() & F.try_parse_json(old).isNull()
    in_object = _is(F.try_parse_json(old), "OBJECT")
    fixed = rows.withColumn("__new", F.when(broken & in_object, note).when(broken, _quoted(F.col(new))).otherwise(F.col(new)))
    plain = rows.where(whole).select(F.col(key).alias("id"), F.concat_ws("\n", old, new).alias("value"))
    inner, ends = _walked(_sides(fixed.where(~whole), key, old, "__new"))
    both_arrays = _is(F.col("o"), "ARRAY") & _is(F.col("n"), "ARRAY")
    a, b = F.to_json("o"), F.to_json("n")
    body = lambda j: F.substring(j, F.lit(2), F.length(j) - 2)
    joined = F.concat(F.lit("["), F.concat_ws(",", F.nullif(body(a), F.lit("")), F.nullif(body(b), F.lit(""))), F.lit("]"))
    value = F.when(both_arrays, joined).when(F.col("n").isNull(), a).otherwise(b)
    found = ends[-1].select("id", "path", value.alias("json"))
    for depth in range(len(inner) - 1, -1, -1):
        up = found.select("id", F.slice("path", 1, F.size("path") - 1).alias("path"), F.struct(F.element_at("path", -1).alias("key"), "json").alias("item"))
        up = up.groupBy("id", "path").agg(F.collect_list("item").alias("items"))
        made = inner[depth].join(up, ["id", "path"], "left").select("id", "path", F.coalesce(_object(F.col("items")), F.lit("{}")).alias("json"))
        found = stored(made.unionByName(ends[depth].select("id", "path", value.alias("json"))))
    return found.select("id", F.col("json").alias("value")).unionByName(plain).withColumnRenamed("id", key)


def conflicts(rows: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, path, was, now): members at any depth that both sides have with different values (trimmed), arrays and objects
    of unlike kinds included. `path` joins the keys by dots."""
    _, ends = _walked(_sides(rows, key, old, new))
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    text = lambda c: F.trim(F.coalesce(F.try_variant_get(c, "$", "string"), F.to_json(c)))
    out = out.where("o is not null and n is not null").select(F.col("id").alias(key), F.array_join("path", ".").alias("path"), text("o").alias("was"), text("n").alias("now"))
    return out.where("was <> now")


def shrunk(rows: DataFrame, key: str, col: str, budget: int) -> DataFrame:
    """(key, value): JSON texts of at most `budget` characters (2 at least). What is longer keeps its structure, and its strings are cut to one
    common length, which is found by water-filling: short strings stay, and what they leave is the long ones'. Where structure, keys and
    numbers alone pass the budget, the value becomes one string, its own text cut."""
    if budget < 2:
        raise ValueError("a budget of two characters at least")
    parsed = F.coalesce(F.try_parse_json(col), F.try_parse_json(_quoted(F.col(col))))
    all_ = stored(rows.where(F.col(col).isNotNull()).select(F.col(key).alias("id"), parsed.alias("v")).withColumn("json", F.to_json("v")))
    small = all_.where(F.length("json") <= budget).select("id", F.col("json").alias("value"))
    long = all_.where(F.length("json") > budget)

    level = long.select("id", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("name"), "v")
    inner, leaves = [], []
    while True:
        kind = F.when(_is(F.col("v"), "OBJECT"), "{").when(_is(F.col("v"), "ARRAY"), "[").when(F.schema_of_variant("v") == "STRING", '"')
        level = stored(level.withColumn("kind", F.coalesce(kind, F.lit(""))))
        leaves.append(level.where("kind not in ('{', '[')").select("id", "path", "name", "kind", F.to_json("v").alias("json"), F.try_variant_get("v", "$", "string").alias("text")))
        nodes = level.where("kind in ('{', '[')")
        if nodes.isEmpty():
            break
        inner.append(nodes.select("id", "path", "name", "kind"))
        place = F.format_string("%010d", "pos")  # places sort as the members stand
        level = _children(nodes, ["id", "path"], "v").select("id", F.concat("path", F.array(place)).alias("path"), F.col("key").alias("name"), F.col("value").alias("v"))
    every = leaves[0]
    for x in leaves[1:]:
        every = every.unionByName(x)
    strings = every.where(F.col("kind") == '"').select("id", "path", F.length("json").alias("size"))
    room = strings.groupBy("id").agg(F.sum("size").alias("total")).join(long.select("id", F.length("json").alias("whole")), "id", "right")
    room = room.select("id", (F.lit(budget) - F.col("whole") + F.coalesce("total", F.lit(0))).alias("room"))
    # The level of the water: of all n strings of an id, k short ones stay and n - k share the rest.
    sizes = strings.groupBy("id").agg(F.sort_array(F.collect_list("size")).alias("sizes")).join(room, "id")
    k = F.sequence(F.lit(0), F.size("sizes") - 1)
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("k"), F.lit(-1).cast("bigint").alias("level"))

    def pour(acc: Column, size: Column) -> Column:
        share = F.floor((F.col("room") - acc["sum"]) / (F.size("sizes") - acc["k"]))
        fits = (acc["level"] < 0) & (share < size)
        return F.struct((acc["sum"] + size).alias("sum"), (acc["k"] + 1).alias("k"), F.when(fits, F.greatest(share, F.lit(0))).otherwise(acc["level"]).alias("level"))

    level_of = F.aggregate("sizes", start, pour)["level"]
    waters = stored(sizes.select("id", "room", level_of.alias("water"), F.size(k).alias("n")))
    escaped = F.length("json") != F.length("text") + 2
    keep = F.greatest(F.when(escaped, F.floor((F.col("water") - 3) / 6)).otherwise(F.col("water") - 3), F.lit(0)).cast("int")
    cut = F.when((F.col("kind") != '"') | (F.length("json") <= F.col("water")), F.col("json")).when(F.col("water") < 3, F.lit('""')).otherwise(_quoted(F.concat(F.substring("text", F.lit(1), keep), F.lit(_CUT))))
    found = None
    for depth in range(len(leaves) - 1, -1, -1):
        own = leaves[depth].join(waters, "id", "left").select("id", "path", "name", F.coalesce(cut, F.col("json")).alias("json"))
        if found is not None:
            up = found.select("id", F.slice("path", 1, F.size("path") - 1).alias("path"), F.struct(F.element_at("path", -1).alias("at"), F.col("name").alias("key"), "json").alias("item"))
            up = up.groupBy("id", "path").agg(F.sort_array(F.collect_list("item")).alias("items"))
            member = lambda x: F.when(F.col("kind") == "{", F.concat(_quoted(x["key"]), F.lit(":"), x["json"])).otherwise(x["json"])
            body = F.coalesce(F.array_join(F.transform("items", member), ","), F.lit(""))
            close = F.when(F.col("kind") == "{", "}").otherwise("]")
            made = inner[depth].join(up, ["id", "path"], "left").select("id", "path", "name", F.concat("kind", body, close).alias("json"))
            own = made.unionByName(own)
        found = stored(own)
    back = found.join(long.select("id", F.col("json").alias("whole")), "id")
    stub = F.when(F.lit(budget) < 3, F.lit('""')).otherwise(_quoted(F.concat(F.substring("whole", 1, max(0, (budget - 3) // 6)), F.lit(_CUT))))
    return small.unionByName(back.select("id", F.when(F.length("json") <= budget, F.col("json")).otherwise(stub).alias("value"))).withColumnRenamed("id", key)
