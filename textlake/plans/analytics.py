"""Queries over the corpus as a whole: matrices, trends, windows, copies, quotes, coverage, mark-up, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import scoring as S
from textlake.functions import text as T
from textlake.operators import corpus as C
from textlake.operators import verify as V
from textlake.plans.search import PARAS, WORDS, paras
from textlake.sources.tables import table

MOTIFS, LANGS = ["license", "token", "der", "zzz", "stupid"], ["en", "de", "fr", "es", "it"]


def _cells(spark, sf):
    return C.matrix(table(spark, sf, "documents"), MOTIFS, "lang", LANGS)


def motif_lang_matrix(spark, sf):
    return _cells(spark, sf).select("term", "lang", "n")


CELLS = """cells AS (SELECT term, t, l.lang, k, (SELECT count(*) FROM documents d WHERE d.lang = l.lang AND contains(d.text, term)) AS n
FROM (VALUES ('license', 0), ('token', 1), ('der', 2), ('zzz', 3), ('stupid', 4)) m(term, t), (VALUES ('en', 0), ('de', 1), ('fr', 2), ('es', 3), ('it', 4)) l(lang, k))"""
MATRIX = f"WITH {CELLS} SELECT term, lang, n FROM cells"


def motif_changes(spark, sf):
    return C.changes(_cells(spark, sf), "lang")


CHANGES = f"""WITH {CELLS}, x AS (SELECT term, lag(lang) OVER w AS from_key, lang AS to_key, lag(n) OVER w AS was, n FROM cells WINDOW w AS (PARTITION BY term ORDER BY k)),
y AS (SELECT *, CASE WHEN was = 0 AND n > 0 THEN 'emergence' WHEN was > 0 AND n = 0 THEN 'disappearance' ELSE 'substitution' END AS change FROM x WHERE was IS NOT NULL)
SELECT *, CASE WHEN change = 'substitution' THEN 'low' ELSE 'medium' END AS confidence FROM y"""


def motif_fill_rate(spark, sf):
    rate = F.avg((F.col("n") > 0).cast("double"))
    return _cells(spark, sf).agg(F.round(rate, 4).alias("fill_rate"), (rate < 0.25).alias("sparse"))


FILL = f"WITH {CELLS} SELECT round(avg((n > 0)::INT), 4) AS fill_rate, avg((n > 0)::INT) < 0.25 AS sparse FROM cells"


def trend_by_lang(spark, sf):
    return C.trend(_cells(spark, sf)).select("term", "lang", "n", "scaled", "direction")


TREND = f"""WITH {CELLS}, x AS (SELECT *, max(n) OVER (PARTITION BY term) AS top, arg_min(n, k) OVER (PARTITION BY term) AS a, arg_max(n, k) OVER (PARTITION BY term) AS z FROM cells)
SELECT term, lang, n, CASE WHEN top > 0 THEN round(n / top, 3) ELSE 0 END AS scaled, CASE WHEN z > a THEN 'rising' WHEN z < a THEN 'falling' ELSE 'stable' END AS direction FROM x"""


def matrix_pivot(spark, sf):
    return _cells(spark, sf).groupBy("term").pivot("lang", LANGS).agg(F.first("n")).select("term", *LANGS)


PIVOT = f"WITH {CELLS} SELECT term, " + ", ".join(f"max(n) FILTER (lang = '{x}') AS {x}" for x in LANGS) + " FROM cells GROUP BY 1"


def paragraph_windows(spark, sf):
    return C.windows(paras(spark, sf))


WINDOWS = f"""WITH {PARAS}, n AS (SELECT doc_id, max(para) + 1 AS n FROM paras GROUP BY 1),
w AS (SELECT doc_id, n, unnest(range(0, greatest(n - 2, 0) + 1, 2)) AS start FROM n)
SELECT doc_id, start, count(*) AS n_paras, sum(length(p))::BIGINT AS chars FROM w JOIN paras USING (doc_id) WHERE para >= start AND para < start + 3 GROUP BY 1, 2"""


def exact_duplicates(spark, sf):
    return V.exact_duplicates(table(spark, sf, "documents"))


DUPLICATES = "SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1"


def shared_ngram_pairs(spark, sf):
    return C.shared_ngrams(table(spark, sf, "benchmark"), table(spark, sf, "documents"), 8, "item_id", "doc_id")


def _grams(name: str, key: str, n: int) -> str:
    return f"(SELECT DISTINCT {key}, list_aggregate(w[i:i + {n - 1}], 'string_agg', ' ') AS gram FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {key}, {WORDS} AS w FROM {name})))"


SHARED = f"SELECT item_id, doc_id, count(*) AS shared FROM {_grams('benchmark', 'item_id', 8)} JOIN {_grams('documents', 'doc_id', 8)} USING (gram) GROUP BY 1, 2"


def quote_verification(spark, sf):
    return V.verify_quotes(table(spark, sf, "benchmark"), table(spark, sf, "documents"))


QUOTES = f"""WITH q AS (SELECT item_id, ' ' || list_aggregate(w, 'string_agg', ' ') || ' ' AS q FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) >= 8),
d AS (SELECT doc_id, ' ' || list_aggregate({WORDS}, 'string_agg', ' ') || ' ' AS d FROM documents)
SELECT item_id, count(doc_id) AS n_docs, min(doc_id) AS first_doc, count(doc_id) > 0 AS verified FROM q LEFT JOIN d ON contains(d, q) GROUP BY 1"""


def label_coverage_by_lang(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return V.coverage(docs, table(spark, sf, "labels"), "doc_id", "lang")


COVERAGE = """WITH c AS (SELECT lang, count(*) AS units, count(m.doc_id) AS covered, round(count(m.doc_id) / count(*), 3) AS rate
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) m USING (doc_id) GROUP BY 1)
SELECT *, CASE WHEN rate >= 0.9 THEN 'excellent' WHEN rate >= 0.75 THEN 'good' WHEN rate >= 0.5 THEN 'fair' ELSE 'poor' END AS grade FROM c"""


def worst_coverage(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    found = V.coverage(docs, table(spark, sf, "labels"), "doc_id", "source").withColumn("missing", F.col("units") - F.col("covered"))
    return C.ranked(found.select("source", "rate", "missing"), 10, F.asc("rate"), F.desc("missing"), F.asc("source"))


WORST = """WITH c AS (SELECT source, round(count(m.doc_id) / count(*), 3) AS rate, count(*) - count(m.doc_id) AS missing
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) m USING (doc_id) GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY rate, missing DESC, source) AS rank FROM c ORDER BY rank LIMIT 10"""


def unlabelled_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left_anti")


UNLABELLED = "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"


def label_cross_table(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return joined.groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


LABEL_CROSS = "SELECT lang, quality, toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL"


def changed_documents(spark, sf):
    """The change of the corpus if every text were cleaned."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return V.changed(docs, docs.select("doc_id", T.clean(F.col("text")).alias("text")), "doc_id", "text")


CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '　', ' '), chr(160), ' '), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
 '^[ \t\n\r\x{3000}]+|[ \t\n\r\x{3000}]+$', '', 'g')"""
CHANGED = f"SELECT doc_id, 'changed' AS change FROM documents WHERE text <> {CLEAN}"


def html_strip_stats(spark, sf):
    plain = T.strip_tags(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length("html").alias("html_chars"), F.length(plain).alias("text_chars"), F.md5(plain).alias("digest"), F.length(T.html_escape(plain)).alias("escaped_chars"))


HTML = r"""WITH p AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'), '^[ \t\n\r\x{3000}]+|[ \t\n\r\x{3000}]+$', '', 'g') AS t FROM pages)
SELECT page_id, length(html) AS html_chars, length(t) AS text_chars, md5(t) AS digest,
length(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped_chars FROM p"""


def page_hosts(spark, sf):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return table(spark, sf, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.max(F.length("html")).alias("largest"))


HOSTS = "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS pages, max(length(html)) AS largest FROM pages GROUP BY 1"


def text_measures(spark, sf):
    """Functions over every document: tokens, bigrams, coverage of a query, estimates, Jaccard with a query."""
    words, query = T.words(F.col("text")), F.array(*[F.lit(x) for x in ("license", "public", "the", "rights")])
    return table(spark, sf, "documents").select(
        "doc_id",
        F.size(words).alias("n_words"),
        F.size(F.array_distinct(words)).alias("n_distinct"),
        F.round(T.coverage(query, words), 6).alias("coverage"),
        F.round(T.jaccard(query, words), 6).alias("jaccard"),
        T.token_estimate(F.col("text")).alias("tokens"),
        F.size(T.paragraphs(F.col("text"), "\n")).alias("n_paras"),
        F.length(T.without_space(F.col("text"))).alias("solid"),
        F.md5(T.letters_and_digits(F.col("text"))).alias("norm"),
    )


MEASURES = rf"""WITH d AS (SELECT doc_id, text, {WORDS} AS w, ['license', 'public', 'the', 'rights'] AS q FROM documents)
SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, round(len(list_intersect(q, w)) / 4, 6) AS coverage,
round(len(list_intersect(q, w)) / (4 + len(list_distinct(w)) - len(list_intersect(q, w))), 6) AS jaccard, floor(length(text) / 4.0)::BIGINT AS tokens,
len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \t\n\r\x{{3000}}]+|[ \t\n\r\x{{3000}}]+$', '', 'g') <> '')) AS n_paras,
length(regexp_replace(text, '[\s\x{{3000}}\x{{00A0}}]+', '', 'g')) AS solid, md5(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g')) AS norm FROM d"""


def chinese_numbers(spark, sf):
    """Numbers made from document ids, written in Chinese, in digits, or with something after them that spoils them."""
    n = F.pmod("doc_id", F.lit(99)) + 1
    tens, units = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    digit = lambda d: F.when(d > 0, F.substring(F.lit(T.NUMERALS), d, F.lit(1))).otherwise("")
    chinese = F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), digit(units))
    kind = F.pmod("doc_id", F.lit(4))
    written = F.when(kind == 0, n.cast("string")).when(kind == 1, F.concat(chinese, F.lit("百"))).otherwise(chinese)
    return table(spark, sf, "documents").select("doc_id", T.chinese_number(written).alias("n"))


NUMBERS = "SELECT doc_id, CASE WHEN doc_id % 4 <> 1 THEN (doc_id % 99 + 1)::INT END AS n FROM documents"


def verbatim_levels(spark, sf):
    """Quotes made from each text: as it stands, with other marks, with another end, and turned round."""
    kind = F.pmod("doc_id", F.lit(4))
    q = F.when(kind == 0, F.substring("text", 6, 40)).when(kind == 1, F.upper(F.replace(F.substring("text", 3, 40), F.lit(" "), F.lit(" - "))))
    q = q.when(kind == 2, F.concat(F.substring("text", 1, 30), F.lit(" quite another end"))).otherwise(F.reverse(F.substring("text", 1, 40)))
    return table(spark, sf, "documents").select("doc_id", q.alias("q"), "text").select("doc_id", T.verbatim(F.col("q"), F.col("text")).alias("found"))


VERBATIM = r"""WITH x AS (SELECT doc_id, text AS s, CASE doc_id % 4 WHEN 0 THEN substr(text, 6, 40) WHEN 1 THEN upper(replace(substr(text, 3, 40), ' ', ' - ')) WHEN 2 THEN substr(text, 1, 30) || ' quite another end' ELSE reverse(substr(text, 1, 40)) END AS q FROM documents),
y AS (SELECT *, regexp_replace(lower(q), '[^\p{L}\p{N}]+', '', 'g') AS qn, regexp_replace(lower(s), '[^\p{L}\p{N}]+', '', 'g') AS sn FROM x)
SELECT doc_id, (length(q) > 0 AND contains(s, q)) OR (qn <> '' AND contains(sn, qn)) OR (length(qn) >= 12 AND contains(sn, substr(qn, 1, 12)))
 OR (length(qn) >= 15 AND len(list_filter(range(0, greatest(length(qn) - 15, 0) + 1, 5), lambda i: contains(sn, substr(qn, (i + 1)::BIGINT, 15)))) > 0) AS found FROM y"""


def datum_offsets(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", (F.lit(20.2431) + F.col("c_custkey") % 30).alias("lat"), (F.lit(100.1503) + F.col("c_custkey") % 25).alias("lng"))
    lat, lng = S.offset_datum(F.col("lat"), F.col("lng"))
    return rows.select("c_custkey", F.round(lat - F.col("lat"), 6).alias("d_lat"), F.round(lng - F.col("lng"), 6).alias("d_lng"))


def _waves(z: str, *terms: tuple[float, str]) -> str:
    return "(" + " + ".join(f"{size} * sin({z} * pi() / ({period}))" for size, period in terms) + ") * 2.0 / 3.0"


_COMMON = _waves("x", (20.0, "1.0 / 6"), (20.0, "0.5"))
DATUM = f"""WITH p AS (SELECT c_custkey, 20.2431::DOUBLE + c_custkey % 30 AS lat, 100.1503::DOUBLE + c_custkey % 25 AS lng FROM customer),
z AS (SELECT *, lng - 105.0::DOUBLE AS x, lat - 35.0::DOUBLE AS y, lat / 180.0 * pi() AS rad FROM p),
o AS (SELECT *, 1 - 0.00669342162296594323::DOUBLE * sin(rad) * sin(rad) AS magic,
 -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * sqrt(abs(x)) + {_COMMON} + {_waves('y', (20.0, '1.0'), (40.0, '3.0'))} + {_waves('y', (160.0, '12.0'), (320.0, '30.0'))} AS north,
 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * sqrt(abs(x)) + {_COMMON} + {_waves('x', (20.0, '1.0'), (40.0, '3.0'))} + {_waves('x', (150.0, '12.0'), (300.0, '30.0'))} AS east FROM z)
SELECT c_custkey, round(north * 180.0 / ((6378245.0::DOUBLE * (1 - 0.00669342162296594323::DOUBLE)) / (magic * sqrt(magic)) * pi()), 6) AS d_lat,
 round(east * 180.0 / (6378245.0::DOUBLE / sqrt(magic) * cos(rad) * pi()), 6) AS d_lng FROM o"""


def quotes_in_text(spark, sf):
    text = F.concat(F.lit("he said “"), F.coalesce("text", F.lit("")), F.lit("” to 「"), "role", F.lit("」 and 『no』"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", T.quotes(text).alias("q"))
    return rows.select("conv_id", "turn", F.size("q").alias("n"), F.md5(F.array_join("q", "|")).alias("inside"))


QUOTES_IN = """WITH x AS (SELECT conv_id, turn, regexp_extract_all('he said “' || coalesce(text, '') || '” to 「' || role || '」 and 『no』', '[“「『]([^“「『”」』]{4,300})[”」』]', 1) AS q FROM conversations)
SELECT conv_id, turn, len(q)::INT AS n, md5(array_to_string(q, '|')) AS inside FROM x"""


def _dirty():
    return F.concat(F.lit("﻿ "), F.replace("text", F.lit("\n"), F.lit("\r\n\n \n")), F.lit("　 \r"))


def cleaned_texts(spark, sf):
    """Texts with other line ends, blanks and a byte-order mark, cleaned."""
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean(_dirty())).alias("digest"))


CLEANED = r"""WITH x AS (SELECT doc_id, chr(65279) || ' ' || replace(text, chr(10), chr(13) || chr(10) || chr(10) || ' ' || chr(10)) || '　 ' || chr(13) AS t FROM documents),
y AS (SELECT doc_id, replace(replace(replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '　', ' '), chr(160), ' '), chr(65279), '') AS t FROM x)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\r\x{3000}]+|[ \t\n\r\x{3000}]+$', '', 'g')) AS digest FROM y"""


def source_changes(spark, sf):
    """What a second load of the documents would bring: some texts changed, some gone, some new."""
    old = table(spark, sf, "documents").select("doc_id", "text")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    new = old.where("doc_id % 11 <> 0").select("doc_id", text.alias("text"))
    return V.changed(old, new.unionByName(old.where("doc_id % 13 = 0").select((F.col("doc_id") + 10**9).alias("doc_id"), "text")), "doc_id", "text")


SOURCE_CHANGES = """SELECT doc_id, 'removed' AS change FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, 'changed' FROM documents WHERE doc_id % 7 = 0 AND doc_id % 11 <> 0
UNION ALL SELECT doc_id + 1000000000, 'added' FROM documents WHERE doc_id % 13 = 0"""

QUERIES = {
    "motif_lang_matrix": motif_lang_matrix, "motif_changes": motif_changes, "motif_fill_rate": motif_fill_rate, "trend_by_lang": trend_by_lang, "matrix_pivot": matrix_pivot,
    "paragraph_windows": paragraph_windows, "exact_duplicates": exact_duplicates, "shared_ngram_pairs": shared_ngram_pairs, "quote_verification": quote_verification,
    "label_coverage_by_lang": label_coverage_by_lang, "worst_coverage": worst_coverage, "unlabelled_documents": unlabelled_documents, "label_cross_table": label_cross_table,
    "changed_documents": changed_documents, "html_strip_stats": html_strip_stats, "page_hosts": page_hosts, "text_measures": text_measures, "chinese_numbers": chinese_numbers,
    "verbatim_levels": verbatim_levels, "datum_offsets": datum_offsets, "quotes_in_text": quotes_in_text, "cleaned_texts": cleaned_texts, "source_changes": source_changes,
}
ORACLE_SQL = {
    "motif_lang_matrix": MATRIX, "motif_changes": CHANGES, "motif_fill_rate": FILL, "trend_by_lang": TREND, "matrix_pivot": PIVOT, "paragraph_windows": WINDOWS,
    "exact_duplicates": DUPLICATES, "shared_ngram_pairs": SHARED, "quote_verification": QUOTES, "label_coverage_by_lang": COVERAGE, "worst_coverage": WORST,
    "unlabelled_documents": UNLABELLED, "label_cross_table": LABEL_CROSS, "changed_documents": CHANGED, "html_strip_stats": HTML, "page_hosts": HOSTS, "text_measures": MEASURES,
    "chinese_numbers": NUMBERS, "verbatim_levels": VERBATIM, "quotes_in_text": QUOTES_IN, "datum_offsets": DATUM, "cleaned_texts": CLEANED, "source_changes": SOURCE_CHANGES,
}
