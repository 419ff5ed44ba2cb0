import numpy as np
import pytest

from textlake.operators import genres as G

LONG = "长句子在这里。" * 200
PLAY = (
    "楔子里没有曲牌的一段文字" * 6
    + "\n第一出 借伞\n引子在前面，短。\n【懒画眉】"
    + "〔旦〕湖上风光好。" * 12
    + "\n【步步娇】太短\n第二出 订盟\n【园林好】\n开场"
    + "白" * 20
    + "〔生〕"
    + "唱一句。" * 200
    + "〔旦〕短〔净〕"
    + "念一句，" * 150
    + "\n第三出 水斗\n"
    + LONG
)


def test_plays_by_act_tune_and_speaker(spark):
    docs = spark.createDataFrame([(1, PLAY), (2, None), (3, ""), (4, "no marks at all " * 6)], "doc_id long, text string")
    rows = G.acts(docs, title="全文").collect()
    text = {1: PLAY, 4: "no marks at all " * 6}
    for r in rows:
        assert text[r.doc_id][r.char_start : r.char_start + r.chars] == r.body and r.body == r.body.strip()
        assert r.content == (f"{r.prefix}\n{r.body}" if r.prefix else r.body)
        assert r.prefix == (f"{r.act} · 【{r.tune}】" if r.tune else "")
    got = [(r.act_index, r.act, r.tune, r.role, r.body[:3]) for r in sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.seq)]
    assert got[:2] == [(-1, "全文", "", "", "楔子里"), (0, "第一出 借伞", "懒画眉", "", "〔旦〕")]
    assert got[2:5] == [(1, "第二出 订盟", "园林好", "", "开场白"), (1, "第二出 订盟", "园林好", "生", "〔生〕"), (1, "第二出 订盟", "园林好", "净", "〔净〕")]
    assert {g[:4] for g in got[5:]} == {(2, "第三出 水斗", "", "")} and len(got) == 7
    last = [r for r in rows if r.doc_id == 1 and r.act_index == 2]
    assert "".join(r.body for r in sorted(last, key=lambda r: r.seq)) == LONG and all(r.chars <= 1200 for r in last)
    assert [(r.act_index, r.act, r.chars) for r in rows if r.doc_id == 4] == [(-1, "全文", 95)]


def test_bare_titles_become_acts(spark):
    text = "开头的话不是标题\n\n订盟\n\n正文在此\n借伞\n\n水斗\n\n第五出 合钵\n\n长长的标题太长了\n"
    (r,) = G.numbered_acts(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.text == "开头的话不是标题\n\n第1出 订盟\n\n正文在此\n借伞\n\n第2出 水斗\n\n第五出 合钵\n\n长长的标题太长了\n"


SCRIPT = "开场前的话\n还有一句\n第一场 游湖\n（内唱）远处有歌\n继续的歌\n（白）又一指示\n许仙（唱）雨来了。\n撑伞。\n白 素 贞（白）多谢。\n无人之言\n\n第二场 结亲\n小青（念）恭喜"


def test_script_lines_are_typed_and_carried(spark):
    rows = G.spoken_lines(spark.createDataFrame([(1, SCRIPT), (2, None)], "doc_id long, text string"), title="序").orderBy("part").collect()
    got = [(r.scene_index, r.scene, r.kind, r.speaker, r.mode, r.text) for r in rows]
    assert got == [
        (-1, "序", "dialogue", "", "", "开场前的话\n还有一句"), (0, "第一场 游湖", "stage", "", "内唱", "（内唱）远处有歌\n继续的歌\n（白）又一指示"),
        (0, "第一场 游湖", "dialogue", "许仙", "唱", "许仙（唱）雨来了。\n撑伞。"), (0, "第一场 游湖", "dialogue", "白素贞", "白", "白 素 贞（白）多谢。\n无人之言"), (1, "第二场 结亲", "dialogue", "小青", "念", "小青（念）恭喜"),
    ]
    assert all(SCRIPT[r.char_start :].startswith(r.text.split("\n")[0]) for r in rows)


def unit(text):
    """A vector by the first letter."""
    v = np.zeros(128)
    v[ord(text[0]) % 128] = 1.0
    return v


def test_scenes_merge_short_parts_and_like_ones(spark):
    lines = "第一场 a\n甲（白）" + "x" * 200 + "\n乙（白）短\n甲（白）" + "y" * 200 + "\n丙（唱）" + "z" * 1200
    rows = G.scenes(spark.createDataFrame([(1, lines)], "doc_id long, text string"), embed=unit).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(len(rows)))
    body = "".join(r.content.split("\n", 1)[1] for r in rows)
    assert body.count("x") == 200 and body.count("y") == 200 and body.count("z") == 1200 and "短" in body
    assert all(len(r.content) - len(r.prefix) - 1 <= 1000 for r in rows)
    assert rows[0].speakers == ["甲"] and rows[0].prefix == "第一场 a · 甲 · 白" and rows[-1].prefix == "第一场 a · 丙 · 唱"


@pytest.mark.parametrize(
    ("parts", "want"),
    [(["aaaa", "b", "cccc"], ["aaaa\nb", "cccc"]), (["aaaa", "c", "cccc"], ["aaaa", "c\ncccc"]), (["b", "cccc"], ["b\ncccc"]), (["b"], ["b"]), (["b", "c"], ["b\nc"]), (["aaaa", "b"], ["aaaa\nb"]), ([], [])],
)
def test_short_parts_join_the_more_like_neighbour(parts, want):
    got = G.join_short([{"text": t} for t in parts], 3, 0.5, unit)
    assert [p["text"] for p in got] == want


def test_papers_keep_titles_captions_and_paths(spark):
    paras = ["前言", "a" * 200, "a" * 300, "b" * 200, "图 1 景观", "短句", "1. 方法", "2.1. " + "长标题" * 60, "c" * 900, "tiny", "结语"]
    rows = G.papers(spark.createDataFrame([(1, "\n\n".join(paras)), (2, None), (3, "")], "doc_id long, text string"), embed=unit).orderBy("seq").collect()
    got = [(r.path, r.figure, r.first_para, r.last_para, r.content[:2]) for r in rows]
    assert got[0] == ("前言", None, 0, 2, "前言") and got[1] == ("前言", "image", 3, 5, "bb")
    assert got[2][0] == "前言 > 1. 方法 > 2.1. " + "长标题" * 60 and got[2][2:4] == (6, 7)
    assert "".join(r.content for r in rows).count("c") == 900 and all(r.chars <= 800 + 8 for r in rows)
    assert all(r.doc_id == 1 for r in rows)


def test_papers_lose_no_paragraph(spark):
    paras = ["1. source", "some text", "70.32.29.134 is an address", "2. " + "a long title " * 15, "3. " + "another one " * 15, "结语"]
    docs = spark.createDataFrame([(1, "\n\n".join(paras)), (2, "1. source")], "doc_id long, text string")
    rows = G.papers(docs, embed=unit).orderBy("seq").collect()
    assert {i for r in rows for i in range(r.first_para, r.last_para + 1)} == set(range(6)) and {r.doc_id for r in rows} == {1}
    assert rows[0].path == "1. source" and all("70.32" not in r.path for r in rows)


def test_sentences_join_by_likeness_or_names():
    s = ["aaa 白娘子", "ab", "xyz 白娘子", "q", "zzzz"]
    assert G.related_sentences(s, 250, 1, 0.9, ["白娘子"], unit) == [[0, 1], [2], [3], [4]]
    near = lambda t: np.array([1.0, 1.0 if t[0] == "x" else 0.0])
    assert G.related_sentences(s[:3], 250, 1, 0.75, ["白娘子"], near) == [[0, 1, 2]]
    assert G.related_sentences(s[:3], 250, 1, 0.75, [], near) == [[0, 1], [2]]
    assert G.related_sentences(["long enough", "b"], 5, 3, 2.0, [], unit) == [[0, 1]]
    assert G.related_sentences([], 5, 3, 2.0, [], unit) == []
