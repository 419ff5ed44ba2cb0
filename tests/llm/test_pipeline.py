import random

import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from textlake.llm import mixing
from textlake.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = {"aa": ["the", "and", "thing", "other", "with", "which"], "bb": ["der", "und", "nicht", "schön", "über", "wald"]}
    rows, at = [], 0

    def add(text, lang="aa", source=None):
        nonlocal at
        rows.append((at, text, lang, source or f"src{at % 3}", len(text or "")))
        at += 1
        return at - 1

    def prose(lang, n=220):
        return " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "", str(rng.randint(0, 9)), "er"]) for _ in range(n))

    plain = {add(prose(x), x) for x in ["aa", "bb"] * 12}
    plain |= {add(rows[0][1]) and -1}  # an exact copy
    near = rows[3][1].split()
    near[5] = "changed"
    add(" ".join(near), "bb")
    for text in (None, "", "12345 !!", "😀"):
        add(text)
    plain.discard(-1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.count(), stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if name != "mixing":
            assert kept.count() <= before
    drawn = [r.doc_id for r in kept.collect()]
    assert set(drawn) == plain
    alone = docs.where(docs.doc_id.isin(*plain))
    assert sorted(drawn) == sorted(r.doc_id for r in mixing.schedule(alone).collect())

    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    text = {r[0]: r[1] for r in rows}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(drawn)
    for r in out:
        ids = lib.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), lib.decode(ids, skip_special_tokens=False))


def test_every_operator_is_registered():
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "mixing", "BPE"]


def test_texts_reach_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 2000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"])

    try:
        corpus_pipeline.encoded(spark, docs, "")
        found = [r.size for r in docs.mapInArrow(sizes, "size long").collect()]
        assert sum(found) > 18e6 and max(found) < 5e6
        spark.conf.set(key, "1m")
        corpus_pipeline.encoded(spark, docs, "")
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
