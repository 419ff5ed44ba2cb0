"""Chunks that follow the layout of a genre: plays with sung acts, spoken scripts, research papers, and sentences that belong together.

Layout is found natively: a text is cut at its marks (or lines), every piece is typed by patterns, and windows in the order of the text carry
what holds until the next mark: act, tune, scene, speaker, section path. Offsets come from running sums, so each chunk's `body` is
substring(text, char_start + 1, chars). Only the merging of neighbours by likeness, which depends on what is already together, is a
small fold over one document's typed pieces.

Defined cases
    null or empty text: no chunks.      text without marks: one piece, under an empty title.   repeated ids: not allowed.
    null ids: one document.     pieces below the least length: dropped (plays) or merged (others).       very long texts: whole; a document's
    pieces are one task's rows.   empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators.chunking import cut_long, hashed_embedding
from textlake.operators.rowwise import by_row

# The marks of plays, scripts and papers, and the sizes of their chunks.
ACT, TUNE, ROLE = r"第[一二三四五六七八九十百千万\d]+[章节出折][^\n]*", r"【[^】]+】", r"〔[^〕]+〕"
SCENE, MODE, SPEAKER = r"第[一二三四五六七八九十百千万\d]+场[^\n]*", r"[（(](内唱|内白|唱|白|说白|道白|念)[^）)]*[）)]", r"^([\x{4e00}-\x{9fff}\s]{1,6})\s*[（(]"
SECTION = (
    r"^\s*(前\s*言|绪\s*论|结\s*[语论]|参考\s*文献|附\s*录|[（(][一二三四五六七八九十]+[）)]|[（(]\d+[）)]|\d+(?:\.\d+)*[\.\、]"
    r"|第[一二三四五六七八九十\d]+[章节]|[一二三四五六七八九十]{1,3}\s{1,3}[^\n]{1,80})"
)
ADDRESS = r"^\s*(?=[\d.]*\d\d)\d+(\.\d+){3}(?![.\d])"  # four numbers, some of two digits, and no mark after them: no section's
FIGURE, TABLE = r"^图\s*\d+", r"^表\s*\d+"
ACT_MOST, ACT_LEAST = 1200, 60
SCENE_MOST, SCENE_LEAST, SCENE_ALIKE = 1000, 150, 0.55
PAPER_MOST, PAPER_LEAST, PAPER_ALIKE = 800, 150, 0.78
SENTENCE_MOST, SENTENCE_LEAST, SENTENCE_ALIKE, NAMED_LESS = 250, 20, 0.55, 0.10
STAGE = "舞台指示"


def pieces(rows: DataFrame, keys: Sequence[str], text: str, pattern: str) -> DataFrame:
    """(keys, k, mark, body, at): a text cut at a pattern's matches. Piece 0 has no mark; `at` is where the mark (else the body) begins."""
    marks = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    bodies = F.split(text, pattern)
    both = F.transform(bodies, lambda b, i: F.struct(F.when(i > 0, F.get(marks, i - 1)).alias("mark"), b.alias("body")))
    each = rows.where(F.length(text) > 0).select(*keys, F.posexplode(both).alias("k", "p")).select(*keys, "k", "p.mark", "p.body")
    over = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce("mark", F.lit(""))) + F.length("body")
    return each.withColumn("at", F.coalesce(F.sum(size).over(over), F.lit(0)).cast("int"))


def _trimmed(body: Column, at: Column) -> tuple[Column, Column]:
    """A body without white space at its ends, and where it begins then."""
    inner = F.regexp_replace(body, r"^[\s\x{3000}]+", "")
    return F.regexp_replace(inner, r"[\s\x{3000}]+$", ""), (at + F.length(body) - F.length(inner)).cast("int")


def numbered_acts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): bare titles (a line of two to six Chinese characters between empty lines) become numbered acts."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("k", "line"))
    over = Window.partitionBy(id_col).orderBy("k")
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    bare = F.trim("line").rlike(r"^[\x{4e00}-\x{9fff}]{2,6}$") & ~F.trim("line").rlike(ACT) & empty(F.lag("line").over(over)) & empty(F.lead("line").over(over))
    lines = lines.withColumn("bare", bare)
    n = F.sum(F.col("bare").cast("int")).over(over)
    lines = lines.withColumn("line", F.when(F.col("bare"), F.concat(F.lit("第"), n.cast("string"), F.lit("出 "), F.trim("line"))).otherwise(F.col("line")))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(id_col).agg(whole.alias(text_col))


def acts(docs: DataFrame, title: str = "", most: int = ACT_MOST, least: int = ACT_LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of plays (id, seq, act_index, act, tune, role, prefix, content, body, char_start, chars): a tune each; where that is longer than
    `most`, a speaker's part each, or stretches that end with sentences where nobody is named."""
    cut = pieces(docs, [id_col], text_col, f"{ACT}|{TUNE}")
    over = Window.partitionBy(id_col).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    is_act, inner = F.col("mark").startswith("第"), F.regexp_extract("mark", "【([^】]+)】", 1)
    act = F.last(F.when(is_act, F.trim("mark")), ignorenulls=True).over(over)
    tune = F.last(F.when(is_act, F.lit("")).when(F.col("mark").isNotNull(), inner), ignorenulls=True).over(over)
    index = F.sum(F.coalesce(is_act, F.lit(False)).cast("int")).over(over) - 1
    body, at = _trimmed(F.col("body"), F.col("at") + F.length(F.coalesce("mark", F.lit(""))))
    cut = cut.select(id_col, "k", index.cast("int").alias("act_index"), F.coalesce(act, F.lit(title)).alias("act"), F.coalesce(tune, F.lit("")).alias("tune"), body.alias("body"), at.alias("at")).where("body <> ''")
    keys = [id_col, "k", "act_index", "act", "tune"]
    short = cut.where(F.length("body") <= most).where(F.length("body") >= least).select(*keys, F.lit(0).alias("j"), F.lit("").alias("role"), "body", F.col("at").alias("char_start"))
    long = cut.where(F.length("body") > most)
    spoken = long.where(F.col("body").rlike(ROLE)).select(*keys, "body", F.col("at").alias("begin"))
    parts = _roles(spoken, keys)
    told = _stretches(long.where(~F.col("body").rlike(ROLE)), keys, most)
    rows = short.unionByName(parts.where((F.col("j") == 0) | (F.length("body") >= least))).unionByName(told)
    prefix = F.when(F.col("tune") != "", F.concat("act", F.lit(" · 【"), "tune", F.lit("】"))).otherwise(F.lit(""))
    content = F.when(prefix != "", F.concat(prefix, F.lit("\n"), "body")).otherwise(F.col("body"))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("char_start")) - 1
    return rows.select(id_col, place.alias("seq"), "act_index", "act", "tune", "role", prefix.alias("prefix"), content.alias("content"), "body", "char_start", F.length("body").alias("chars"))


def _roles(spoken: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of long tunes: (keys, j, role, body, char_start); part 0 is what comes before the first speaker."""
    own = spoken.withColumnsRenamed({"k": "outer", "body": "own"})
    names = ["outer" if c == "k" else c for c in keys]
    parts = pieces(own, [*names, "begin"], "own", ROLE)
    body, at = _trimmed(F.concat(F.coalesce("mark", F.lit("")), "body"), F.col("begin") + F.col("at"))
    role = F.coalesce(F.regexp_extract("mark", "〔([^〕]+)〕", 1), F.lit(""))
    out = parts.select(*names, F.col("k").alias("j"), role.alias("role"), body.alias("body"), at.alias("char_start"))
    return out.where("body <> ''").withColumnRenamed("outer", "k")


def _stretches(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Long bodies (keys, body, at) in stretches that end with sentences: (keys, j, role, body, char_start)."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                start = row.at
                for j, part in enumerate(cut_long(row.body, most)):
                    out.append((*row[: len(keys)], j, "", part, start))
                    start += len(part)
            yield pd.DataFrame(out, columns=[*keys, "j", "role", "body", "char_start"])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keys], "j int", "role string", "body string", "char_start int"])
    return rows.select(*keys, "body", "at").mapInPandas(run, schema)


# --- scripts -------------------------------------------------------------------------------------------------------


def spoken_lines(docs: DataFrame, title: str = "", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, scene_index, scene, kind, speaker, mode, text, char_start): the lines of a script, typed and put together: a line that
    names its speaker begins a part, a line with a mode and no speaker a stage direction (which the next such line joins), and
    all others go on with the part before."""
    cut = pieces(docs, [id_col], text_col, "\n").withColumn("at", F.col("at") + F.length(F.coalesce("mark", F.lit(""))))
    over = Window.partitionBy(id_col).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    line, at = _trimmed(F.col("body"), F.col("at"))
    lines = cut.select(id_col, "k", line.alias("line"), at.alias("at")).where("line <> ''")
    is_scene = F.col("line").rlike("^" + SCENE)
    speaker = F.regexp_replace(F.regexp_extract("line", SPEAKER, 1), r"\s+", "")
    lines = lines.withColumns({"is_scene": is_scene, "said": speaker, "mode": F.regexp_extract("line", MODE, 1)})
    stage = (F.col("said") == "") & (F.col("mode") != "")
    kind = F.when(F.col("is_scene"), "scene").when(F.col("said") != "", "dialogue").when(stage, "stage").otherwise("more")
    lines = lines.withColumn("kind", kind)
    lines = lines.withColumn("scene", F.coalesce(F.last(F.when(F.col("is_scene"), F.col("line")), ignorenulls=True).over(over), F.lit(title)))
    lines = lines.withColumn("scene_index", (F.sum(F.col("is_scene").cast("int")).over(over) - 1).cast("int"))
    # What a line stands in: the kind of the last line that began something.
    held = F.last(F.when(F.col("kind") != "more", F.col("kind")), ignorenulls=True).over(Window.partitionBy(id_col).orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    begins = F.col("kind").isin("scene", "dialogue") | ((F.col("kind") == "stage") & (F.coalesce(held, F.lit("")) != "stage")) | ((F.col("kind") == "more") & (F.coalesce(held, F.lit("scene")) == "scene") & ~F.coalesce(F.lag("kind").over(Window.partitionBy(id_col).orderBy("k")) == "more", F.lit(False)))
    lines = lines.withColumn("part", F.sum(begins.cast("int")).over(over)).where(~F.col("is_scene"))
    first = F.min_by(F.struct(F.when(F.col("kind") == "stage", "stage").otherwise("dialogue").alias("kind"), F.col("said").alias("speaker"), "mode", F.col("at").alias("char_start")), "k")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    parts = lines.groupBy(id_col, "part", "scene_index", "scene").agg(first.alias("f"), text.alias("text"))
    return parts.select(id_col, "part", "scene_index", "scene", "f.kind", "f.speaker", "f.mode", "text", "f.char_start")


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


def join_short(parts: list[dict], least: int, alike: float, embed: Callable[[str], np.ndarray]) -> list[dict]:
    """Parts below `least` join the neighbour that is more like them: the next one if it is near enough, else the one before."""
    out: list[dict] = []
    held: dict | None = None

    def settle(short: dict, after: dict | None) -> None:
        if after is not None:
            v = embed(short["text"])
            to_next = _cosine(v, embed(after["text"]))
            if not out or (to_next > _cosine(v, embed(out[-1]["text"])) and to_next >= alike):
                after["text"] = short["text"] + "\n" + after["text"]
                return
        if out:
            out[-1]["text"] += "\n" + short["text"]
        else:
            out.append(short)

    for p in (dict(x) for x in parts):
        if held is not None:
            settle(held, p)
            held = None
        if len(p["text"]) >= least:
            out.append(p)
        else:
            held = p
    if held is not None:
        settle(held, None)
    return out


def join_alike(parts: list[dict], most: int, alike: float, embed: Callable[[str], np.ndarray]) -> list[dict]:
    """Neighbours of one kind join while their vectors are near the mean of those together and all fit."""
    out: list[dict] = []
    vectors: list[np.ndarray] = []
    for p in parts:
        v = embed(p["text"])
        if out and out[-1]["kind"] == p["kind"] and len(out[-1]["text"]) + len(p["text"]) <= most and _cosine(np.mean(vectors, axis=0), v) >= alike:
            out[-1]["text"] += "\n" + p["text"]
            out[-1]["speakers"] += [s for s in p["speakers"] if s not in out[-1]["speakers"]]
            vectors.append(v)
        else:
            out.append(dict(p))
            vectors = [v]
    return out


def scenes(docs: DataFrame, title: str = "", most: int = SCENE_MOST, least: int = SCENE_LEAST, alike: float = SCENE_ALIKE, embed: Callable[[str], np.ndarray] = hashed_embedding, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of scripts (id, seq, scene_index, scene, kind, speakers, mode, prefix, content, chars)."""
    parts = spoken_lines(docs, title, id_col, text_col)
    kinds = dict(parts.dtypes)
    names = [id_col, "scene_index", "n", "scene", "kind", "speakers", "mode", "prefix", "content"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        out, whose, where = [], rows[id_col].iloc[0], int(rows["scene_index"].iloc[0])
        own = [{"kind": k, "speakers": [s] if s else [], "mode": m, "text": t} for k, s, m, t in zip(rows["kind"], rows["speaker"], rows["mode"], rows["text"], strict=True)]
        for p in join_alike(join_short(own, least, alike, embed), most, alike, embed):
            shown = " & ".join(p["speakers"][:3]) + (" ..." if len(p["speakers"]) > 3 else "")
            said = f" · {p['mode']}" if p["mode"] else ""
            scene = rows["scene"].iloc[0]
            prefix = f"{scene} · {shown}{said}" if p["kind"] == "dialogue" else f"{scene} · {STAGE}"
            for piece in cut_long(p["text"], most):
                out.append((whose, where, len(out), scene, p["kind"], p["speakers"], p["mode"], prefix, f"{prefix}\n{piece}"))
        return pd.DataFrame(out, columns=names)

    schema = f"{id_col} {kinds[id_col]}, scene_index int, n int, scene string, kind string, speakers array<string>, mode string, prefix string, content string"
    found = parts.groupBy(id_col, "scene_index").applyInPandas(run, schema)
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("scene_index", "n")) - 1
    return found.select(id_col, place.alias("seq"), "scene_index", "scene", "kind", "speakers", "mode", "prefix", "content", F.length("content").alias("chars"))


# --- papers --------------------------------------------------------------------------------------------------------


def typed_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n\n") -> DataFrame:
    """(id, para, kind, paragraph): section titles, captions of figures and tables, and text."""
    paras = docs.select(id_col, F.posexplode(T.paragraphs(F.col(text_col), separator)).alias("para", "paragraph"))
    kind = F.when(F.col("paragraph").rlike(SECTION), "section").when(F.col("paragraph").rlike(FIGURE), "figure").when(F.col("paragraph").rlike(TABLE), "table").otherwise("text")
    return paras.select(id_col, "para", kind.alias("kind"), "paragraph")


def grouped_paragraphs(rows: list[tuple[int, str, str]], most: int, least: int, alike: float, embed: Callable[[str], np.ndarray]) -> list[list[int]]:
    """Groups of places in `rows` (para, kind, paragraph): titles stand alone, captions begin a group, a paragraph joins its
    neighbour if it is like it and both fit; groups below `least` join the one before, short titles the one after."""
    groups: list[list[int]] = []
    size = 0
    before: np.ndarray | None = None
    open_ = False
    for i, (_, kind, text) in enumerate(rows):
        if kind == "section":
            groups.append([i])
            open_ = False
            continue
        v = embed(text)
        if open_ and kind == "text" and before is not None and _cosine(before, v) >= alike and size + len(text) <= most:
            groups[-1].append(i)
            size += len(text)
        else:
            groups.append([i])
            size, open_ = len(text), True
        before = v
    title = lambda g: len(g) == 1 and rows[g[0]][1] == "section"
    merged: list[list[int]] = []
    for g in groups:
        if merged and not title(g) and sum(len(rows[i][2]) for i in g) < least:
            merged[-1].extend(g)
        else:
            merged.append(list(g))
    out: list[list[int]] = []
    held: list[int] = []
    for at, g in enumerate(merged):
        if not held and title(g) and len(rows[g[0]][2]) < least and at + 1 < len(merged):
            held = g
        else:
            out.append(held + g)
            held = []
    return out


def papers(docs: DataFrame, most: int = PAPER_MOST, least: int = PAPER_LEAST, alike: float = PAPER_ALIKE, embed: Callable[[str], np.ndarray] = hashed_embedding, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n\n") -> DataFrame:
    """Chunks of papers (id, seq, path, figure, first_para, last_para, content, chars). `path` has the section titles so far."""
    typed = typed_paragraphs(docs, id_col, text_col, separator)
    kind = F.when((F.col("kind") == "section") & F.col("paragraph").rlike(ADDRESS), "text").otherwise(F.col("kind"))
    whole = typed.groupBy(id_col).agg(F.collect_list(F.struct("para", kind.alias("kind"), "paragraph")).alias("own"))

    def run(whose, rows: list[dict]):
        own = sorted((r["para"], r["kind"], r["paragraph"]) for r in rows)
        groups = grouped_paragraphs(own, most, least, alike, embed)
        path: list[str] = []
        n = 0
        for g in groups:
            for i in g:
                if own[i][1] == "section" and path[-1:] != [own[i][2]]:
                    path.append(own[i][2])
            if len(groups) == 1 and len(g) == 1 and own[g[0]][1] == "section":
                continue  # a title, and nothing else
            kinds = [own[i][1] for i in g]
            figure = "image" if "figure" in kinds else "table" if "table" in kinds else None
            held: list[str] = []
            for part in [p for i in g for p in cut_long(own[i][2], most)] + [None]:
                if held and (part is None or sum(map(len, held)) + len(part) > most):
                    yield whose, n, " > ".join(path), figure, own[g[0]][0], own[g[-1]][0], "\n\n".join(held)
                    n += 1
                    held = []
                if part is not None:
                    held.append(part)

    columns = {id_col: dict(typed.dtypes)[id_col], "seq": "int", "path": "string", "figure": "string", "first_para": "int", "last_para": "int", "content": "string"}
    return by_row(whole, run, columns).withColumn("chars", F.length("content"))


# --- sentences -----------------------------------------------------------------------------------------------------


def related_sentences(sentences: list[str], most: int, least: int, alike: float, names: Sequence[str], embed: Callable[[str], np.ndarray]) -> list[list[int]]:
    """Groups of sentences: one joins those together if it is near the mean of their vectors, or a little less near and shares a match
    of one of the patterns `names`; groups below `least` join the one before."""
    import re

    patterns = [re.compile(p) for p in names]
    groups: list[list[int]] = []
    vectors: list[np.ndarray] = []
    for i, s in enumerate(sentences):
        v = embed(s)
        if groups and sum(len(sentences[j]) for j in groups[-1]) + len(s) <= most:
            near = _cosine(np.mean(vectors, axis=0), v)
            held = "".join(sentences[j] for j in groups[-1])
            if near >= alike or (near >= alike - NAMED_LESS and any(set(p.findall(held)) & set(p.findall(s)) for p in patterns)):
                groups[-1].append(i)
                vectors.append(v)
                continue
        groups.append([i])
        vectors = [v]
    out: list[list[int]] = []
    for g in groups:
        if out and sum(len(sentences[j]) for j in g) < least:
            out[-1].extend(g)
        else:
            out.append(list(g))
    return out


def sentence_chunks(docs: DataFrame, names: Sequence[str] = (), most: int = SENTENCE_MOST, least: int = SENTENCE_LEAST, alike: float = SENTENCE_ALIKE, embed: Callable[[str], np.ndarray] = hashed_embedding, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, seq, first_sentence, last_sentence, content, chars): sentences that belong together."""
    from textlake.operators.chunking import LATIN_ENDS, split_sentences

    columns = [id_col, "seq", "first_sentence", "last_sentence", "content", "chars"]

    def run(batches):
        for b in batches:
            out = []
            for i, text in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                own = split_sentences(text or "", LATIN_ENDS, straight=False)
                for s, g in enumerate(related_sentences(own, most, least, alike, names, embed)):
                    content = "".join(own[j] for j in g)
                    out.append((i, s, g[0], g[-1], content, len(content)))
            yield pd.DataFrame(out, columns=columns)

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {dict(docs.dtypes)[id_col]}, seq int, first_sentence int, last_sentence int, content string, chars int")
