"""Tag retrieval: five channels of candidates over one space of documents, fused, boosted layer by layer, ranked.

Labels are tables. Documents: doc_id, genre, plot_detail, summary (strings), persons, persons_raw, locations, plot, topics, versions
(arrays of strings). Questions: query_id, kind (plot, person, place, comparison or research), genre, plot_detail, summary, the same
arrays, and dims, an array of (dim, value, listed): what a comparison is about; `listed` values count only as they are, others also
where one contains the other.

Questions are few: what has a row for each of them, or for each of their tags, is broadcast, so that documents are not dealt by the
few tags and questions there are. Documents' labels are met by id for candidates only.

Defined cases
    null arrays and strings: empty.      an entity without a weight: 1.       a channel without a document: 0 after scaling; one whose scores
    are all equal: 0.5.      equal scores: by id.      no candidates: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T

# Weights of the layers, thresholds, and how many candidates a channel gives.
HARD_OFFSET, GENRE_FACTOR = 10.0, 1.2
PLOT_DETAIL, PERSON, LOCATION, RAW, CITED_PLOT, VERSION = 0.20, 0.10, 0.09, 0.05, 0.05, 0.05
SUMMARY_DENSE, SUMMARY_SPARSE = 0.10, 0.10
TELLING, PLOT_ALIKE = 0.8, 0.75
CANDIDATES, PLOT_CANDIDATES, RESEARCH_CANDIDATES = 100, 50, 50
DENSE, SPARSE, TAG = 0.4, 0.4, 0.2
RESEARCH = "research_literature"
# Which property of a genre a dimension speaks of; the one about forms of address.
DIMENSIONS = {"朝代": "dynasty", "文本": "text", "体裁": "name", "作者": "author"}
ADDRESS = "称谓"
# Genres with dynasty, text, author and name.
GENRES = [
    ("classical_chinese", "唐", "李黄", "佚名", "文言小说"),
    ("huaben", "宋", "西湖三塔记", "佚名", "话本"),
    ("imitation_huaben", "明", "白娘子永镇雷峰塔", "冯梦龙", "拟话本"),
    ("opera_libretto", "清", "雷峰塔传奇", "方成培", "戏曲"),
    ("chapter_vernacular", "清", "雷峰塔传奇", "玉山堂主人", "白话神魔小说"),
    ("tanci", "清", "义妖传", "陈遇乾", "苏州弹词"),
    ("script", "现当代", "白蛇传", "田汉", "京剧"),
    ("research_literature", None, "研究文献", "研究团队", "学术"),
]
_GENRES = "genre string, dynasty string, text string, author string, name string"


def matching_genres(queries: DataFrame) -> DataFrame:
    """(query_id, matching): the genres that one of a question's dimensions fits."""
    genres = queries.sparkSession.createDataFrame(GENRES, _GENRES)
    each = queries.select("query_id", F.explode("dims").alias("d")).select("query_id", "d.*")
    field = F.create_map(*[F.lit(x) for kv in DIMENSIONS.items() for x in kv])[F.col("dim")]
    facts = genres.select("genre", F.explode(F.create_map(*[x for f in ("dynasty", "text", "name", "author") for x in (F.lit(f), F.col(f))])).alias("field", "fact"))
    met = each.withColumn("field", field).join(facts, "field")  # four properties of eight genres
    fits = (F.col("fact") == F.col("value")) | (~F.col("listed") & (F.col("fact").contains(F.col("value")) | F.col("value").contains(F.col("fact"))))
    return met.where(fits).groupBy("query_id").agg(F.collect_set("genre").alias("matching"))


def near_plots(queries: DataFrame, alike: DataFrame, threshold: float = PLOT_ALIKE) -> DataFrame:
    """(query_id, plot_near): a question's plot units and those like them (`alike`: a, b, cosine; each pair once)."""
    own = queries.select("query_id", F.explode("plot").alias("unit"))
    both = alike.where(F.col("cosine") >= threshold)
    both = both.select(F.col("a").alias("unit"), F.col("b").alias("other")).unionByName(both.select(F.col("b").alias("unit"), F.col("a").alias("other")))
    more = own.join(both, "unit").select("query_id", F.col("other").alias("unit"))
    return own.unionByName(more).groupBy("query_id").agg(F.collect_set("unit").alias("plot_near"))


def prepared(queries: DataFrame, weights: DataFrame, alike: DataFrame) -> DataFrame:
    """`queries` with matching, plot_near, and idf: a map with the weights (entity, idf) of their persons and locations."""
    named = queries.select("query_id", F.explode(F.array_distinct(F.concat("persons", "locations"))).alias("entity")).join(weights, "entity", "left")
    idf = named.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("entity", F.coalesce("idf", F.lit(1.0))))).alias("idf"))
    out = queries.join(idf, "query_id", "left").join(matching_genres(queries), "query_id", "left").join(near_plots(queries, alike), "query_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"idf": F.coalesce("idf", F.create_map().cast("map<string,double>")), "matching": F.coalesce("matching", none), "plot_near": F.coalesce("plot_near", none)})


def telling_tags(rows: DataFrame, weights: DataFrame, *keep: str) -> DataFrame:
    """(keep, tag, idf): plot units and topics, and the persons and locations whose weight tells documents apart."""
    all_ = F.array_distinct(F.concat("plot", "topics", "persons", "locations"))
    sure = F.array_union("plot", "topics")
    each = rows.select(*keep, sure.alias("__sure"), F.explode(all_).alias("tag")).join(weights.select(F.col("entity").alias("tag"), "idf"), "tag", "left")
    each = each.withColumn("idf", F.coalesce("idf", F.lit(1.0))).where((F.col("idf") >= TELLING) | F.array_contains("__sure", F.col("tag")))
    return each.select(*keep, "tag", "idf")


def tag_scores(queries: DataFrame, labels: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): the cosine of weighted tag vectors, of all documents with a tag of the question."""
    own, of = telling_tags(queries, weights, "query_id"), telling_tags(labels, weights, "doc_id")
    size = lambda rows, key, name: rows.groupBy(key).agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias(name))
    dot = of.join(F.broadcast(own.withColumnRenamed("idf", "w")), "tag").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("idf")).alias("dot"))
    met = dot.join(F.broadcast(size(own, "query_id", "a")), "query_id").join(size(of, "doc_id", "b"), "doc_id")
    return met.select("query_id", "doc_id", (F.col("dot") / (F.col("a") * F.col("b"))).alias("score"))


def best(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("place", place).where(F.col("place") <= k).drop("place")


def candidates(dense: DataFrame, sparse: DataFrame, tag: DataFrame, plot: DataFrame, research: DataFrame) -> DataFrame:
    """(query_id, doc_id, dense, sparse, tag) of the documents that any channel (query_id, doc_id, score) gives. The last two channels
    name documents only."""
    parts = [(best(dense, CANDIDATES), "dense"), (best(sparse, CANDIDATES), "sparse"), (tag, "tag"), (best(plot, PLOT_CANDIDATES), ""), (best(research, RESEARCH_CANDIDATES), "")]
    rows = None
    for df, name in parts:
        own = df.select("query_id", "doc_id", *[(F.col("score") if c == name else F.lit(None).cast("double")).alias(c) for c in ("dense", "sparse", "tag")])
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("query_id", "doc_id").agg(*[F.max(c).alias(c) for c in ("dense", "sparse", "tag")])


def fused(rows: DataFrame) -> DataFrame:
    """`rows` with base: each channel scaled to [0, 1] within its question, weighed and added. The ends of the scales are aggregates."""
    ends = rows.groupBy("query_id").agg(*[f(c).alias(f"{c}_{n}") for c in ("dense", "sparse", "tag") for f, n in ((F.min, "low"), (F.max, "high"))])
    total = F.lit(0.0)
    for c, w in (("dense", DENSE), ("sparse", SPARSE), ("tag", TAG)):
        low, high = F.col(f"{c}_low"), F.col(f"{c}_high")
        scaled = F.when(F.col(c).isNull(), 0.0).when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.5)
        total = total + w * scaled
    return rows.join(F.broadcast(ends), "query_id").withColumn("base", total).select(*rows.columns, "base")


def _bigrams(text: Column) -> Column:
    return F.array_distinct(T.char_ngrams(T.without_space(F.coalesce(text, F.lit(""))), 2))


def boost(q: str = "q", d: str = "d", dense_alike: str = "summary_alike") -> tuple[Column, Column]:
    """(boost, hard): what the labels add, from a row with structs `q` (prepared question) and `d` (document's labels) and the likeness
    of their summaries' vectors."""
    of = lambda s: (lambda c: F.coalesce(F.col(f"{s}.{c}"), F.array().cast("array<string>")))
    ask, doc = of(q), of(d)
    kind, idf = F.col(f"{q}.kind"), F.col(f"{q}.idf")
    research = F.coalesce(F.col(f"{d}.genre") == RESEARCH, F.lit(False))
    shared = lambda c: F.array_intersect(ask(c), doc(c))
    weight = lambda e: F.coalesce(F.try_element_at(idf, e), F.lit(1.0))
    total = lambda c: F.aggregate(shared(c), F.lit(0.0), lambda s, e: s + weight(e))
    named = PERSON * total("persons") + LOCATION * total("locations")
    same_plot = F.arrays_overlap(ask("plot_near"), doc("plot"))
    versions = F.exists(f"{q}.dims", lambda x: x["dim"].isin(*DIMENSIONS))
    address = F.exists(f"{q}.dims", lambda x: x["dim"] == ADDRESS)
    when = lambda cond, value: F.when(cond, value).otherwise(0.0)

    of_research = (
        when((kind == "comparison") & versions & F.arrays_overlap(ask("matching"), doc("versions")), VERSION)
        + when(kind == "plot", CITED_PLOT * F.size(shared("plot")))
        + when(kind.isin("plot", "person", "place", "research"), named)
    )
    of_text = (
        when(kind == "plot", PLOT_DETAIL * T.jaccard(_bigrams(F.col(f"{q}.plot_detail")), _bigrams(F.col(f"{d}.plot_detail"))))
        + when(kind.isin("plot", "person", "place", "comparison"), named)
        + when((kind == "comparison") & address, RAW * F.size(shared("persons_raw")))
    )
    for_all = (
        when((kind == "comparison") & versions & F.array_contains(ask("matching"), F.col(f"{d}.genre")), VERSION)
        + SUMMARY_DENSE * F.coalesce(F.col(dense_alike), F.lit(0.0))
        + SUMMARY_SPARSE * T.jaccard(_bigrams(F.col(f"{q}.summary")), _bigrams(F.col(f"{d}.summary")))
    )
    telling = lambda c: F.exists(shared(c), lambda e: weight(e) >= TELLING)
    hard_research = kind.isin("comparison", "research") & (F.arrays_overlap(ask("topics"), doc("topics")) | same_plot)
    hard_text = (kind == "plot") & same_plot | kind.isin("person", "place") & (telling("persons") | telling("locations"))
    return F.when(research, of_research).otherwise(of_text) + for_all, F.coalesce(F.when(research, hard_research).otherwise(hard_text), F.lit(False))


def retrieve(rows: DataFrame, queries: DataFrame, labels: DataFrame, k: int, alike: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, hard, rank): candidates `rows` ranked. `queries`: prepared; `alike`: (query_id, doc_id, summary_alike)."""
    met = fused(rows)
    met = met.withColumn("summary_alike", F.lit(0.0)) if alike is None else met.join(alike, ["query_id", "doc_id"], "left")
    met = met.join(F.broadcast(queries.select("query_id", F.struct(*[c for c in queries.columns if c != "query_id"]).alias("q"))), "query_id")
    met = met.join(labels.select("doc_id", F.struct(*[c for c in labels.columns if c != "doc_id"]).alias("d")), "doc_id", "left")
    added, hard = boost()
    same = F.coalesce((F.col("q.genre") == F.col("d.genre")) & (F.col("q.genre") != ""), F.lit(False))
    met = met.withColumns({"added": added, "hard": hard})
    score = (F.col("base") + F.col("added")) * F.when(same, GENRE_FACTOR).otherwise(1.0) + F.when(F.col("hard"), HARD_OFFSET).otherwise(0.0)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return met.withColumn("score", F.round(score, 6)).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "hard", "rank")
