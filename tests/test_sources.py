import json

import pytest

from lexmill.operators import integrity, lexicon, numbering
from lexmill.registry import book
from lexmill.sources import epub, html, lexicon_csv, tables, term_bank, text_files


def test_html_lines():
    page = "<!DOCTYPE html><html><head><title>T</title></head><body><!-- no --><p>a<ruby>漢<rt>かん</rt><rb>字</rb></ruby>b<br>c</p><hr><img src='x'>&amp;d</body></html>"
    assert html.lines_of(page) == ["a漢字b\n", "c\n", "&amp;d\n"]
    assert html.lines_of("<div>a<p>b</p></div><div></div>tail") == ["ab\n", "\n", "\n"]
    assert html.lines_of("") == []
    deep = "<b>" * 30_000 + "x" + "</b>" * 30_000
    assert html.lines_of(deep) == ["x\n"]


def test_page_lines(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>"), (2, None)], "page_id long, html string").selectExpr("*", "'x' as line")
    assert [(r.page_id, r.line_index, r.line) for r in html.page_lines(pages).collect()] == [(1, 0, "a\n")]


def test_book(spark, tmp_path):
    data = book("本（一）", [("One", "<p>first</p>"), ("Two", "<p>second</p><p>third</p>")])
    b = epub.read_book(data)
    assert b.title == "本"
    assert [(c.title, c.length, c.start_pos) for c in b.chapters] == [("garbage before first chapter", 0, 0), ("One", 0, 0), ("Two", 0, 0)]
    assert [c.lines for c in b.chapters] == [[], ["first\n", "\n"], ["second\n", "third\n", "\n"]]
    assert b.raw_text().startswith("first\n\n\n\nsecond")
    assert b.images_hash == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    (tmp_path / "a.epub").write_bytes(data)
    rows = epub.book_lines(spark, f"{tmp_path}/*.epub").orderBy("chapter_index", "line_index").collect()
    assert [(r.chapter_title, r.line) for r in rows][:2] == [("One", "first\n"), ("One", "\n")] and rows[0].file_hash == b.file_hash
    old = spark.createDataFrame([("本",)], "title string")
    assert epub.new_books(spark.createDataFrame([("本",), ("新",)], "title string"), old).collect()[0].title == "新"


def test_term_bank(spark, tmp_path):
    entries = [["食べる", "タベル", "n  v", "v1", 5, ["to eat", "eat"], 7, ""], ["カナ", "", "", "", 0, ["kana"], 8, "P"], ["", "x", "", "", 0, ["none"], 9, ""]]
    (tmp_path / "term_bank_1.json").write_text(json.dumps(entries, ensure_ascii=False))
    got = term_bank.with_content(term_bank.read_definitions(spark, str(tmp_path), "jm")).orderBy("spelling").collect()
    assert [(g.spelling, g.reading, g.tags, g.contents) for g in got] == [("カナ", "かな", [], ["kana"]), ("食べる", "たべる", ["n", "v"], ["to eat", "eat"])]
    assert got[1].content == '["to eat","eat"]'
    with pytest.raises(term_bank.NoTermBankFiles):
        term_bank.read_definitions(spark, str(tmp_path / "none"), "jm")
    assert term_bank.missing_dictionaries(spark.createDataFrame([("a",), ("b",)], "dict_name string"), spark.createDataFrame([("a",)], "dict_name string")).first().dict_name == "b"


def test_one_text_entries(spark):
    text = "われ‐かえ・る【割れ返る】――カヘル（自五）《ラ（ロ）・リ（ツ）・ル・ル・レ・レ》\n一つ「例」\n二つ"
    odd = "《閉じない\n定義"
    rows = spark.createDataFrame([(text,), (odd,)], "x string")
    from pyspark.sql import functions as F

    a, b = [r.p for r in rows.select(term_bank.parsed(F.col("x")).alias("p")).collect()]
    assert (a.reading, a.spelling, a.old_kana_spelling, a.conjugation_type, a.conjugation) == ("われ‐かえ・る", "割れ返る", "――カヘル", "自五", "ラ（ロ）・リ（ツ）・ル・ル・レ・レ")
    assert [(d.definition, d.examples) for d in a.definitions] == [("一つ", "「例」"), ("二つ", None)] and a.plain is None
    assert b.plain is not None or b.reading is not None


def test_frequencies(spark):
    value = json.dumps([["a", "freq", {"reading": "r", "frequency": 3}], ["b", "freq", 5]])
    assert [tuple(r) for r in term_bank.frequencies(spark.createDataFrame([(value,)], "value string")).collect()] == [("a", "r", 3)]


def test_lexicon(spark, tmp_path):
    def row(lemma, form, orth, kana, guid, lemma_id):
        f = ["名詞", "普通名詞", "一般", "*", "*", "*", "カナ", lemma, orth, "*", form, "*", "漢", *["*"] * 7, kana, "*", "*", "カ" + form, "*", "*", "*", str(guid), str(lemma_id)]
        return ",".join(["s", "1", "2", "3", *f])

    (tmp_path / "lex.csv").write_text("\n".join([row("語-x-y", "F", "o1", "カ", 10, 1), row("別", "F", "o2", "*", 10, 1), row("語", "G", "o3", "カ", 12, 1)]) + "\n")
    terms = lexicon_csv.read_terms(spark, str(tmp_path / "lex.csv"))
    assert [(r.spelling, r.disambiguation, r.reading, r.main_pos) for r in lexicon.lemmas(terms).collect()] == [("語", "x-y", "かな", "Meishi")]
    v = sorted(lexicon.variants(terms).collect(), key=lambda r: r.variant_id)
    assert [(r.variant_id[-1], r.spelling, r.reading) for r in v] == [("1", "F", "かF"), ("3", "G", "かG")]
    s = sorted(lexicon.surface_forms(terms).collect(), key=lambda r: r.surface_form_id)
    assert [(r.spelling, r.reading, r.variant_id[-1]) for r in s] == [("o1", "か", "1"), ("o3", "か", "3")]
    (tmp_path / "names.csv").write_text("Sei,山田,ヤマダ\nNoun,物,モノ\nOther,x,y\n")
    names = lexicon_csv.name_entries(spark, str(tmp_path / "names.csv")).orderBy("number").collect()
    assert [(n.surface, n.left, n.right, n.cost) for n in names] == [("山田", 2793, 11570, 5000), ("物", 6812, 546, 5000)]
    assert names[0].feature == "名詞,普通名詞,人名,姓,*,*,ヤマダ,山田,山田,ヤマダ,山田,ヤマダ,漢,*,*,*,*,*,*,体,ヤマダ,ヤマダ,ヤマダ,ヤマダ,*,*,*,400000,400000"
    assert lexicon_csv.all_terms(terms, terms).count() == 6
    (tmp_path / "user.csv").write_text("a,1,2,-3,f,g\nbad line\n")
    assert [tuple(r) for r in lexicon_csv.word_costs(spark, str(tmp_path / "user.csv")).collect()] == [("a", 1, 2, -3, "f,g")]
    assert lexicon_csv.connection_costs(["2 2", "0 1 5", "1 0 -7"]).tolist() == [[0, 5], [-7, 0]]
    (tmp_path / "k.json").write_text('{"山": ["サン"]}')
    assert lexicon_csv.character_readings(spark, str(tmp_path / "k.json")) == {"山": ["サン"]}


def test_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", True, 0), (2, "", False, 1)], "doc_id long, title string, is_finished boolean, progress int").selectExpr("*", "1 as more")
    tables.append(docs, str(tmp_path), "docs")
    tables.append(docs.limit(0), str(tmp_path), "docs")
    assert sorted((r.doc_id, r.title) for r in tables.read(spark, str(tmp_path), "docs").collect()) == [(1, "a"), (2, None)]
    tables.replace(docs.where("doc_id = 1"), str(tmp_path), "docs")
    assert tables.read(spark, str(tmp_path), "docs").count() == 1
    assert tables.is_loaded(docs, "title = 'a'") and not tables.is_loaded(docs, "title = 'z'")
    (tmp_path / "t.txt").write_text("x\ny")
    assert [(r.title, r.text) for r in text_files.read_texts(spark, str(tmp_path / "t.txt")).collect()] == [("??", "x\ny")]


def test_numbering_and_integrity(spark):
    new = spark.range(1000).selectExpr("concat('t', lpad(id, 5, '0')) as title")
    got = numbering.with_new_ids(new, spark.createDataFrame([(41,)], "doc_id long"), ["title"]).orderBy("title").collect()
    assert [r.doc_id for r in got] == list(range(42, 1042))
    assert numbering.with_new_ids(new.limit(0), spark.createDataFrame([], "doc_id long"), ["title"]).count() == 0
    docs = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, title string")
    lines = spark.createDataFrame([(1, 0), (2, 0), (None, 1)], "doc_id long, line_index int")
    assert {r.check_name: r.violations for r in integrity.report({"docs": docs, "lines": lines}).collect()} == {"docs key doc_id": 1, "docs key title": 0, "lines key doc_id,line_index": 0, "lines doc_id in docs": 1}
