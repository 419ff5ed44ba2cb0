"""JSON values made from the tables, merged, compared and cut to a budget; and a table written together with what is derived from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import nested as N
from textlake.plans.search import WORDS
from textlake.sources.dual import DualTable
from textlake.sources.files import shared_folder
from textlake.sources.tables import table


def _described(spark, sf):
    """(doc_id, old, new): what the documents say of themselves, and what their labels add."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    old = F.to_json(F.struct("source", "lang", F.struct("n_chars", F.col("doc_id").alias("id")).alias("stats"), F.array("lang").alias("tags")))
    new = F.to_json(F.struct(F.struct(F.length("text").alias("n_chars"), "quality", "toxic").alias("stats"), F.array("source").alias("tags"), F.concat(F.lit(" "), "lang").alias("lang")))
    return d.select("doc_id", old.alias("old"), new.alias("new"))


def merged_descriptions(spark, sf):
    return N.merged(_described(spark, sf), "doc_id", "old", "new")


MERGED = """SELECT doc_id, '{"lang":" ' || lang || '","source":"' || source || '","stats":{"id":' || doc_id || ',"n_chars":' || length(text) || ',"quality":' || quality || ',"toxic":' || toxic
 || '},"tags":["' || lang || '","' || source || '"]}' AS value FROM documents JOIN labels USING (doc_id)"""


def description_conflicts(spark, sf):
    return N.conflicts(_described(spark, sf), "doc_id", "old", "new")


CONFLICTS = """SELECT doc_id, 'tags' AS path, '["' || lang || '"]' AS was, '["' || source || '"]' AS now FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, 'stats.n_chars', n_chars::VARCHAR, length(text)::VARCHAR FROM documents JOIN labels USING (doc_id) WHERE n_chars <> length(text)"""

BUDGET = 200


def shrunk_documents(spark, sf):
    plain = F.translate("text", '\n\r\t"\\', "     ")
    rows = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "source", plain.alias("text"))).alias("j"))
    return N.shrunk(rows, "doc_id", "j", BUDGET)


SHRUNK = f"""WITH j AS (SELECT doc_id, '{{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '","text":"' || translate(text, chr(10) || chr(13) || chr(9) || '"' || chr(92), '     ') || '"}}' AS j FROM documents)
SELECT doc_id, CASE WHEN length(j) <= {BUDGET} THEN j ELSE substr(j, 1, {BUDGET - 3}) || '…"}}' END AS value FROM j"""


def dual_written(spark, sf):
    """Documents in three batches, numbered as they come, with the words that are derived from them; one batch is left pending and replayed."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    derive = lambda rows: rows.select("id", "doc_id", F.size(T.words(F.col("text"))).alias("n_words"))
    dual = DualTable(spark, shared_folder(spark), derive)

    def lost(step: str) -> None:
        if step == "primary":
            raise OSError("the second write is lost")

    for batch in range(3):
        own = docs.where(F.pmod("doc_id", F.lit(3)) == batch)
        try:
            dual.write(own, batch, F.col("doc_id"), lost if batch == 1 else lambda _: None)
        except OSError:
            pass  # what was meant to happen: the batch is pending now
    dual.write(docs.limit(0), 2, F.col("doc_id"))  # a batch number again changes nothing
    dual.replay()
    return dual.derived().select("id", "doc_id", "n_words")


DUAL = f"""SELECT row_number() OVER (ORDER BY doc_id % 3, doc_id) - 1 AS id, doc_id, len({WORDS})::INT AS n_words FROM documents"""

QUERIES = {"merged_descriptions": merged_descriptions, "description_conflicts": description_conflicts, "shrunk_documents": shrunk_documents, "dual_written": dual_written}
ORACLE_SQL = {"merged_descriptions": MERGED, "description_conflicts": CONFLICTS, "shrunk_documents": SHRUNK, "dual_written": DUAL}
