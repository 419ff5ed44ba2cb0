"""Query understanding and tag retrieval: aliases, canonical names, synonyms, versions, candidates, boosts, tiers, quotas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import scoring as S
from textlake.functions import text as T


def any_of(text: Column, words: Sequence[str]) -> Column:
    """True if any of the words is in the text."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return F.coalesce(out, F.lit(False))


def canonical_names(raw: DataFrame, mapping: DataFrame, col: str, dropped: str) -> DataFrame:
    """`raw` with `canonical`: mapped names (`mapping`: raw, canonical, place; the first place wins, rows mapped to `dropped`
    don't count), others as they are."""
    first = mapping.where(F.col("canonical") != dropped).groupBy(F.col("raw").alias(col)).agg(F.min(F.struct("place", "canonical"))["canonical"].alias("__canonical"))
    return raw.join(first, col, "left").withColumn("canonical", F.coalesce("__canonical", col)).drop("__canonical")


def version_filter(text: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The one era or genre that a text asks for, from rules (word, kind, value): 'kind=value', null where rules of one kind
    name several values or nothing fits."""
    out = F.lit(None).cast("string")
    for kind in sorted({k for _, k, _ in rules}, reverse=True):
        found = F.array_distinct(F.filter(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(v)) for w, k, v in rules if k == kind]), lambda x: x.isNotNull()))
        out = F.when(F.size(found) == 1, F.concat(F.lit(kind + "="), F.element_at(found, 1))).when(F.size(found) > 1, F.lit(None)).otherwise(out)
    return out


def references(text: Column, pattern: str) -> Column:
    """The numbers that a pattern's first group names, in order of their places, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("int")))


def fallback_keywords(text: Column, most: int = 5) -> Column:
    """The first parts between marks and spaces that have two characters; the whole text if there is none."""
    parts = F.slice(F.filter(F.split(text, r"[\s,.;:!?，。；：！？、]+"), lambda x: F.length(x) >= 2), 1, most)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def keyword_only(docs: DataFrame, words: Sequence[str], k: int) -> DataFrame:
    """Documents by the share of the words that they have, the k best, ties by id."""
    hit = sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in words), F.lit(0))
    rows = docs.select("doc_id", (hit / len(words)).alias("score")).where("score > 0")
    return rows.orderBy(F.desc("score"), "doc_id").limit(k)


def candidates(channels: Mapping[str, tuple[DataFrame, int]], id_col: str = "doc_id") -> DataFrame:
    """The union of the channels' best (score, ties by id; as many as each may give), one row per id with each channel's score."""
    parts = [c.orderBy(F.desc("score"), id_col).limit(k).select(id_col, F.lit(n).alias("channel"), "score") for n, (c, k) in channels.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    each = [F.max(F.when(F.col("channel") == n, F.col("score"))).alias(n) for n in channels]
    return rows.groupBy(id_col).agg(*each, F.count("*").alias("found_by"))


def fused(rows: DataFrame, weights: Mapping[str, float], boost: Column, matches: Column, hard: Column, factor: float = 1.2, bonus: float = 10.0) -> DataFrame:
    """`rows` (few: candidates) with score: channels scaled to [0, 1] (missing: 0) and weighed, plus a boost, times `factor`
    where the genre matches, plus `bonus` for a hard match."""
    every = Window.partitionBy()
    total = F.lit(0.0)
    for c, w in weights.items():
        low, high = F.min(c).over(every), F.max(c).over(every)
        scaled = F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(0.5))
        total = total + F.coalesce(scaled, F.lit(0.0)) * w
    return rows.withColumn("score", (total + boost) * F.when(matches, factor).otherwise(1.0) + F.when(hard, bonus).otherwise(0.0))


def tag_boost(kind: str, shared: Column, same_place: Column, same_genre: Column) -> Column:
    """What shared tags, place and genre add for a kind of query."""
    weights = {"entity": (0.3, 0.1, 0.05), "place": (0.1, 0.3, 0.05), "genre": (0.1, 0.1, 0.3)}[kind]
    return F.least(shared, F.lit(3)) * weights[0] / 3 + F.when(same_place, weights[1]).otherwise(0.0) + F.when(same_genre, weights[2]).otherwise(0.0)


def tiers(docs: DataFrame, levels: Sequence[Sequence[str]], key: str, enough: int, idle: int = 2) -> DataFrame:
    """Per key, the documents of the first levels (each a list of words that must all be there), until `enough` are found or
    `idle` levels in a row brought nothing new: doc_id, key, level."""
    each = [F.when(F.forall(F.array(*map(F.lit, ws)), lambda w: F.contains(F.lower("text"), w)), F.lit(i)) for i, ws in enumerate(levels)]
    rows = docs.select("doc_id", key, F.coalesce(*each).alias("level")).where("level is not null")
    found = rows.groupBy(key).agg(*[F.count_if(F.col("level") == i).alias(f"n{i}") for i in range(len(levels))])
    last, total, empty, open_ = F.lit(-1), F.lit(0), F.lit(0), F.lit(True)
    for i in range(len(levels)):
        last = F.when(open_, F.lit(i)).otherwise(last)
        total = total + F.when(open_, F.col(f"n{i}")).otherwise(0)
        empty = F.when(F.col(f"n{i}") == 0, empty + 1).otherwise(0)
        open_ = open_ & (total < enough) & (empty < idle)
    stop = found.select(F.col(key).alias("__key"), last.alias("__last"))
    return rows.join(stop, F.col(key).eqNullSafe(F.col("__key"))).where("level <= __last").drop("__key", "__last")


def quotas(scored: DataFrame, key: str, cap: int, k: int) -> DataFrame:
    """The best of each key up to `cap`, and of these the k best, each key's best staying in whatever its score."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "doc_id"))
    own = scored.withColumn("place", place).where(F.col("place") <= cap)
    order = F.row_number().over(Window.orderBy(F.col("place") > 1, F.desc("score"), "doc_id"))  # `cap` rows of each key at most
    return own.withColumn("rank", order).where(F.col("rank") <= k)


def passages_of(docs: DataFrame, key: str, n: int = 2, size: int = 300) -> DataFrame:
    """Per key the first characters of its first documents, joined."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("doc_id"))
    first = docs.withColumn("place", place).where(F.col("place") <= n)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.substring("text", 1, size).alias("t")))), lambda x: x["t"]), "\n")
    return first.groupBy(key).agg(joined.alias("passages"))


def tag_tokens(text: Column, tags: Column) -> Column:
    """Words of a text and, once more each, of its tags."""
    return F.concat(T.words(text), F.transform(tags, F.lower))


def guarded_cosine(a: Column, b: Column) -> Column:
    return S.dot(a, b) / (S.norm(a) * S.norm(b) + 1e-9)
