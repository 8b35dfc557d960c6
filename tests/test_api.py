"""Sessions and the command line."""

import json

import pytest

from glosswork.__main__ import main, parser
from glosswork.api import MultipleMatchesError, SelectionMode, Session, highlight_text
from glosswork.functions import subwords
from glosswork.operators.layout import page_maps
from glosswork.sources.documents import page_facts, read_glyphs
from glosswork.sources.pages import split_pages, write_pages


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, 0, "alpha beta\ngamma delta"), (1, 1, "nothing here"), (2, 0, "beta and beta"), (3, 0, None)], "doc_id long, page_index int, text string")


def test_session(pages):
    s = Session(pages).find("alpha beta gamma").find("beta", progressive=False, mode="all").find("absent one two")
    hits = sorted((r.query_id, r.doc_id, r.page_index, r.start, r.end, [tuple(x) for x in r.rects]) for r in s.hits().collect())
    assert hits[0] == (0, 1, 0, 0, 16, [(0.0, 0.0, 60.0, 12.0), (0.0, 12.0, 30.0, 24.0)])
    assert [h[:4] for h in hits[1:]] == [(1, 1, 0, 6), (1, 2, 0, 0), (1, 2, 0, 9)]
    assert [(r.query_id, r.segment_matches, r.exit_code) for r in s.outcomes().orderBy("query_id").collect()] == [(0, 1, 0), (1, 3, 0), (2, 0, 1)]
    assert s.report().first().exit_code == 1


def test_page_filter_and_modes(pages):
    single = Session(pages).where("doc_id = 2").find("beta", progressive=False, mode="single")
    assert tuple(single.outcomes().first()) == (0, 0, 0, False, False, "multiple_matches", 2) and single.hits().collect() == []
    best = Session(pages).find("beta", progressive=False).outcomes().first()
    assert (best.segment_matches, best.blocked, best.exit_code) == (2, True, 2)
    # one occurrence gives several chains, so a progressive phrase of mode single errs even so, and all repeats it
    assert Session(pages).find("alpha beta gamma", mode="single").outcomes().first().error == "multiple_matches"
    assert tuple(Session(pages).find("alpha beta gamma", mode="all").outcomes().first())[1:3] == (3, 1)
    assert Session(pages).find("beta", progressive=False, mode="shortest").hits().count() == 2
    with pytest.raises(ValueError):
        Session(pages).find("x", mode="none such")


def test_command_line(spark, pages, tmp_path, capsys):
    where = str(tmp_path / "pages")
    pages.write.parquet(where)
    assert main([where, "--text", "alpha beta gamma", "--report", "json"]) == 0
    report = json.loads(capsys.readouterr().out)
    assert (report["matches"], report["exit_code"], report["dry_run"], report["context"]["query"]) == (1, 0, False, "alpha beta gamma")
    assert [(h["page_number"], h["start"], h["end"], len(h["rects"])) for h in report["hits"]] == [(1, 0, 16, 2)]
    assert spark.read.parquet(where + ".highlighted").count() == 1
    assert main([where, "--text", "not in there", "--dry-run"]) == 1
    recipe = tmp_path / "recipe.json"
    recipe.write_text('[{"text": "alpha beta gamma"}, {"label": "skipped"}]')
    assert main([where, "--recipe", str(recipe), "--dry-run"]) == 0
    assert main([str(tmp_path / "none"), "--text", "x"]) == 3
    assert main([where]) == 3 and main([where, "--text", "alpha beta gamma"]) == 3  # the output is there already
    recipe.write_text('[{"text": "alpha beta gamma"}, {"text": "beta", "selection_mode": "single", "progressive": false}, {"text": "beta", "progressive": false, "allow_multiple": false}]')
    assert main([where, "--recipe", str(recipe), "--report", "json", "-o", str(tmp_path / "out")]) == 2
    items = json.loads(capsys.readouterr().out)["items"]
    assert [(i["matches"], i.get("error"), i["selection_mode"], len(i["hits"])) for i in items] == [(1, None, "best", 1), (1, "multiple_matches", "single", 1), (2, None, "best", 2)]  # a document is judged by itself
    assert items[0]["progressive_kmax"] == 3 and "progressive_kmax" not in items[2]
    assert sorted((r.query_id, r.doc_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 1), (1, 1), (2, 1), (2, 2)]
    recipe.write_text('[{"text": "beta", "selection_mode": "none such"}]')
    assert main([where, "--recipe", str(recipe)]) == 3
    recipe.write_text('{"no": "items"}')
    assert main([where, "--recipe", str(recipe)]) == 3
    with pytest.raises(SystemExit) as stop:
        main(["--version"])
    assert stop.value.code == 0 and "glosswork" in capsys.readouterr().out
    with pytest.raises(SystemExit) as stop:
        parser().parse_args([where, "--text", "a", "--recipe", "b"])
    assert stop.value.code == 2


def test_hyphens_at_line_ends(spark):
    pages = spark.createDataFrame([(1, 0, "so differ-\nent words of state-of-the- art\nand differ- ent ends")], "doc_id long, page_index int, text string")
    hits = sorted((r.start, r.end, [tuple(x) for x in r.rects]) for r in Session(pages).find("different", progressive=False, mode="all").hits().collect())
    assert hits == [(3, 12, [(18.0, 0.0, 60.0, 12.0), (0.0, 12.0, 18.0, 24.0)]), (44, 53, [(24.0, 24.0, 90.0, 36.0)])]
    assert Session(pages).find("so different words").outcomes().first().exit_code == 0
    assert Session(pages).find("state-of-the- art", progressive=False).outcomes().first().exit_code == 0


def test_hyphens_in_tables(spark, tmp_path):
    from glosswork.plans import queries

    spark.createDataFrame([(1, "a differ-\nent one")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Different one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in queries.match_pattern_all(spark, str(tmp_path)).collect()] == [(7, 1, 2, 15)]
    assert queries.snippet(spark, str(tmp_path)).first().text_snippet == "different one"


def test_at_once(spark, pages, tmp_path):
    where = str(tmp_path / "pages")
    pages.write.parquet(where)
    table = spark.read.parquet(where)
    assert highlight_text(table, "alpha beta gamma")["segment_matches"] == 1
    assert highlight_text(table, "not in there", str(tmp_path / "none"))["not_found"] and spark.read.parquet(str(tmp_path / "none")).count() == 0
    saved = highlight_text(table, "beta", str(tmp_path / "all"), progressive=False, mode=SelectionMode.ALL)
    assert (saved["segment_matches"], saved["highlight_count"], saved["saved_path"]) == (3, 3, str(tmp_path / "all"))
    with pytest.raises(MultipleMatchesError):
        highlight_text(table, "beta", progressive=False, mode="single")
    with pytest.raises(RuntimeError):
        Session(table).find("beta").save(where)
    assert [r.text_snippet for r in Session(table).find("alpha beta gamma").hits(snippets=True).collect()] == ["alpha beta gamma"]
    assert [(r.doc_id, r.segment_matches) for r in Session(table).find("beta", progressive=False, mode="all").find("delta", progressive=False).totals().orderBy("doc_id").collect()] == [(1, 2), (2, 2)]


def test_files(spark, tmp_path):
    """Text files as glyphs: words that line ends cut are joined by their boxes, and found on the page they are on."""
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.txt").write_text("first page\fsome differ-\nent words")
    (folder / "b.txt").write_bytes(b"")
    glyphs = read_glyphs(spark, str(folder))
    maps = page_maps(glyphs)
    assert [r.text_norm for r in maps.orderBy("doc_id", "page_index").collect()] == ["first page", "some different words"]
    assert all(len(r.text_norm) == len(r.char_map) for r in maps.collect())
    hit = Session(maps).find("different", progressive=False).hits().first()
    assert (hit.page_index, hit.start, [tuple(r) for r in hit.rects]) == (1, 5, [(30.0, 0.0, 66.0, 12.0), (0.0, 12.0, 18.0, 24.0)])
    assert {(r.page_index, r.page_number, r.width, r.height) for r in page_facts(glyphs).collect()} == {(0, 1, 60.0, 12.0), (1, 2, 72.0, 24.0)}
    assert main([str(folder), "--files", "--text", "some different words", "--dry-run"]) == 0

    def broken(data):
        raise ValueError("no document")

    assert {r.error for r in read_glyphs(spark, str(folder), broken, strict=False).collect()} == {"no document"}
    with pytest.raises(Exception, match="no document"):
        read_glyphs(spark, str(folder), broken).collect()


def test_page_files(spark, tmp_path):
    md = spark.createDataFrame([(1, "{0}----\npara one\n\npara two\n![x](y)\n{1}-\n{2}----\nlast \n\n")], "key int, text string")
    pages = split_pages(md, "key")
    assert [r.page for r in pages.orderBy("page_index").collect()] == ["para one\n\npara two\n", "last\n"]
    base = str(tmp_path / "out" / "page")
    assert write_pages(pages, base) == 2
    assert (tmp_path / "out" / "page-001.md").read_text() == "para one\n\npara two\n" and (tmp_path / "out" / "page-002.md").exists()
    with pytest.raises(FileExistsError):
        write_pages(pages, base, start=7)
    assert write_pages(pages.where("false"), str(tmp_path / "none")) == 0


def test_subwords(spark, monkeypatch, capsys):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    model = public_tokenizers.path("piece_bpe_32k.model")
    cut = subwords.tokenizer(True, model)
    assert "".join(cut("Similarity threshold")) == "Similaritythreshold" and "東" in "".join(cut("東京")) and not any("<0x" in x for x in cut("東京龘"))
    assert subwords.tokenizer(False, model) is None and subwords.tokenizer(True, "/none") is None and "white space" in capsys.readouterr().err
    monkeypatch.setenv(subwords.SWITCH, "no")
    assert subwords.tokenizer(True, model) is None
    pages = spark.createDataFrame([(1, 0, "the similaritythreshold of 70%")], "doc_id long, page_index int, text string")
    assert Session(pages, subwords=cut).find("similarity threshold").outcomes().first().segment_matches == 1
