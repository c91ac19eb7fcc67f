"""The engine over DataFrames: sources, kernel, evaluation, SQL functions, streams, output lines, queries."""

import json
import time

import pytest
from pyspark.sql import functions as F

from segmill.functions import native, sqludf
from segmill.operators import evaluate
from segmill.operators.cascade import Options
from segmill.operators.engine import detokenized, extra_info, merge_empty_sentences, sentence_texts, strip_tags, tokenize_text, tokenize_xml
from segmill.plans import cli, registry
from segmill.sources.text import paragraphs, read_documents, read_lexicon
from segmill.streaming.tokens import class_counts, tokenize_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "de", "Das ist gut. Ja!\n\nUnd z.B. das? :)\n"), (2, "en", "Don't go. I can't."), (3, "fr", "Bonjour."), (4, "de", None), (5, "de", ""), (6, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def test_tokens_by_language(docs):
    got = {}
    for r in tokenize_text(docs, lang="lang").orderBy("doc_id", "par_no", "tok_no").collect():
        got.setdefault(r.doc_id, []).append((r.sent_no, r.text))
    assert set(got) == {1, 2, 3, 6}  # others in the default language
    assert got[2] == [(0, "Do"), (0, "n't"), (0, "go"), (0, "."), (1, "I"), (1, "ca"), (1, "n't"), (1, ".")]
    assert [t for s, t in got[1] if s == 2] == ["Und", "z.", "B.", "das", "?", ":)"]


def test_partitions_do_not_matter(docs):
    one = sorted(map(str, tokenize_text(docs.coalesce(1), lang="lang").collect()))
    assert one == sorted(map(str, tokenize_text(docs.repartition(5), lang="lang").collect()))


def test_detokenized(docs):
    tokens = tokenize_text(docs.filter("doc_id = 1"), Options(split_sentences=False), nested=True)
    got = dict(tokens.select("doc_id", detokenized(F.col("tokens"))).collect())
    assert got == {1: "Das ist gut. Ja! Und z.B. das? :)"}


def test_type_errors(docs):
    with pytest.raises(TypeError):
        tokenize_text("a bare text")
    with pytest.raises(TypeError):
        tokenize_text(docs, text="doc_id")
    with pytest.raises(ValueError):
        tokenize_text(docs, separator="tabs")
    with pytest.raises(ValueError):
        tokenize_text(docs, Options(split_sentences=False), xml_sentences="s")


def test_xml(spark):
    df = spark.createDataFrame([("a", "<f><p>Er &amp; sie.</p>Ja <b>gut</b>.</f>")], "doc_id string, xml string")
    t = tokenize_xml(df, eos_tags=["p"], xml_sentences="s")
    assert " ".join(r.text for r in t.orderBy("sent_no", "par_no", "tok_no").collect()) == "<f> <p> <s> Er &amp; sie . </s> </p> <s> Ja <b> gut </b> . </s> </f>"
    plain = tokenize_xml(df, eos_tags=["p"], strip_tags=True)
    assert [r.text for r in plain.orderBy("sent_no", "tok_no").collect()] == ["Er", "&", "sie", ".", "Ja", "gut", "."]
    assert strip_tags(tokenize_xml(df)).count() == 7
    bad = spark.createDataFrame([("a", "<f>")], "doc_id string, xml string")
    with pytest.raises(Exception, match="ill-formed"):
        tokenize_xml(bad).collect()
    assert tokenize_xml(bad, html=True).count() == 2


def test_sentence_texts_and_extra_info(docs):
    t = tokenize_text(docs.filter("doc_id = 1"))
    assert [r.sentence for r in sentence_texts(t).orderBy("sent_no").collect()] == ["Das ist gut .", "Ja !", "Und z. B. das ? :)"]
    assert [r[0] for r in t.orderBy("sent_no", "tok_no").limit(4).select(extra_info()).collect()] == ["", "", "SpaceAfter=No", ""]


def test_paragraph_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("eins\n\nzwei\ndrei", encoding="utf-8")
    docs = read_documents(spark, str(tmp_path / "a.txt"))
    rows = lambda s: [(r.par_no, r.par_start, r.text) for r in paragraphs(docs, s).orderBy("par_no").collect()]
    assert rows("single_newlines") == [(0, 0, "eins\n"), (1, 6, "zwei\n"), (2, 11, "drei")]
    assert rows("empty_lines") == [(0, 0, "eins\n\n"), (1, 6, "zwei\ndrei")]
    with pytest.raises(ValueError):
        paragraphs(docs, "tabs")
    (tmp_path / "list.txt").write_text("# c\nab\n\nAB\nabc\n", encoding="utf-8")
    assert [r.entry for r in read_lexicon(spark, str(tmp_path / "list.txt"), lower=True).collect()] == ["abc", "ab"]


def test_merge_empty(spark):
    rows = [(1, 0, 0, 0, False), (1, 0, 1, 1, True), (1, 1, 0, 0, False), (1, 1, 1, 1, True)]
    df = spark.createDataFrame(rows, "doc_id int, par_no int, unit_sent int, tok_no int, first_in_sentence boolean")
    assert [r.sent_no for r in merge_empty_sentences(df).orderBy("par_no", "tok_no").collect()] == [0, 0, 0, 1]


def test_merged_units_golden(spark):
    got = registry.queries()["merged_sentences"](spark, SF).filter("tok_no % 2 = 0").orderBy("doc_id", "par_no", "tok_no").collect()
    assert [r.sent_no for r in got] == [0, 0, 0, 1, 0, 0, 1, 1, 0]


def test_merged_sentences_of_documents(spark, tmp_path):
    rows = [(1, "de", "... Ja! Nein.\n\n--\nDoch?\n"), (2, "en", "?!\n***"), (3, "fr", None), (4, "fr", "Oui")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["merged_line_sentences"](spark, str(tmp_path)).orderBy("doc_id", "par_no", "tok_no").collect()
    first = [(0, 0, 0), (0, 1, 0), (0, 2, 0), (0, 3, 1), (0, 4, 1), (1, 0, 1), (2, 0, 2), (2, 1, 2)]
    assert [tuple(r) for r in got] == [*((1, *x) for x in first), (2, 0, 0, 0), (2, 1, 0, 0), (4, 0, 0, 0)]


def test_evaluation(spark):
    rows = lambda text: spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line_no int, token string")
    gold, system = evaluate.characters(rows(["<p>", "ab", "c", "", "d"]), ignore_tags=True), evaluate.characters(rows(["a", "bc", "d"]))
    both = evaluate.aligned(gold, system)
    assert evaluate.mismatches(both).count() == 0
    r = evaluate.scores(both).first()
    assert (r.tok_tp, r.tok_fp, r.tok_fn, r.sent_tp, r.sent_fp, r.sent_fn) == (2, 1, 1, 1, 0, 1)
    assert (round(r.tok_p, 3), r.sent_r, round(r.sent_f1, 3)) == (0.667, 0.5, 0.667)
    assert evaluate.total(evaluate.scores(both)).first().file == "TOTAL"
    assert {x.line for x in evaluate.concordance(both, 2).collect()} == {"ab■cd", "abc●d", "a□bc"}
    assert evaluate.mismatches(evaluate.aligned(gold, evaluate.characters(rows(["abx", "d"])))).first().first_at == 2


def test_native_passes(spark):
    df = spark.createDataFrame([(1, "a  b­!? ... x@y.de Dr. &lt;")], "doc_id int, text string")
    assert df.select(native.cleaned(F.col("text"))).first()[0] == "a b!? ... x@y.de Dr. &lt;"
    got = {n: [r.match for r in native.extract(df, n).collect()] for n in ("question_exclamation", "ellipsis", "email", "entity")}
    assert got == {"question_exclamation": ["!?"], "ellipsis": ["..."], "email": ["x@y.de"], "entity": ["&lt;"]}
    assert native.members(native.extract(df, "bare_dot_word"), ["Dr."]).count() == 1


def test_sql_functions(spark, docs):
    sqludf.register(spark)
    docs.createOrReplaceTempView("some_docs")
    got = spark.sql("SELECT t.token FROM some_docs d, LATERAL segmill_tokenize(d.text, 'en') t WHERE d.doc_id = 2 ORDER BY sent_no, tok_no").collect()
    assert [r.token for r in got] == ["Do", "n't", "go", ".", "I", "ca", "n't", "."]
    assert spark.sql("SELECT segmill_tokens_de(text) AS t FROM some_docs WHERE doc_id = 6").first().t == ["x"]
    assert spark.sql("SELECT segmill_split_de(array('Ja', '.', 'Du')) AS s").first().s == [["Ja", "."], ["Du"]]


def test_stream(spark, docs, tmp_path):
    docs.select("doc_id", "text").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = tokenize_stream(stream).writeStream.format("memory").queryName("stream_tokens").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("stream_tokens").count() == tokenize_text(docs).count()
    q = class_counts(stream).writeStream.format("memory").queryName("stream_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("stream_counts").agg(F.sum("n_tokens")).first()[0] == tokenize_text(docs).count()
    with pytest.raises(ValueError):
        tokenize_stream(docs)


def test_cli(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Das ist gut. Ja!\n", encoding="utf-8")
    run = lambda *a: [r.value for r in cli.run(spark, cli.arguments([str(tmp_path / "a.txt"), "-o", "x", *a])).orderBy("doc_id", "ord").collect()]
    assert run() == ["Das", "ist", "gut", ".", "Ja", "!"]
    assert run("-t", "-e", "--character-offsets", "--split-sentences") == ["Das\tregular\t\t0, 3", "ist\tregular\t\t4, 7", "gut\tregular\tSpaceAfter=No\t8, 11", ".\tsymbol\t\t11, 12\n", "Ja\tregular\tSpaceAfter=No\t13, 15", "!\tsymbol\t\t15, 16\n"]
    assert run("--sentence_tag", "s") == run("--sentence-tag", "s")
    assert run("--sentence-tag", "s")[:3] == ["<s>", "Das", "ist"]
    (tmp_path / "a.txt").write_text("<f><p>Ja</p></f>", encoding="utf-8")
    assert run("--tag", "p") == ["<f>", "<p>", "Ja", "</p>", "</f>"]
    cli.main([str(tmp_path / "a.txt"), "-o", str(tmp_path / "out"), "-x"])
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).split() == ["<f>", "<p>", "Ja", "</p>", "</f>"]


def test_cli_standard_streams(spark, tmp_path, monkeypatch, capsys):
    import io

    monkeypatch.setattr("sys.stdin", io.StringIO("Ja. Nein bspw. xyz. so"))
    cli.main(["-", "-o", "-"])
    assert capsys.readouterr().out.split() == ["Ja", ".", "Nein", "bspw.", "xyz", ".", "so"]
    (tmp_path / "abbreviations_de.txt").write_text("xyz.\n", encoding="utf-8")
    monkeypatch.setattr("sys.stdin", io.StringIO("Ja. Nein bspw. xyz. so"))
    cli.main(["-", "-o", "-", "--lexicon_folder", str(tmp_path)])
    assert capsys.readouterr().out.split() == ["Ja", ".", "Nein", "bspw", ".", "xyz.", "so"]
    with pytest.raises(SystemExit):
        cli.arguments(["--version"])
    assert capsys.readouterr().out.startswith("segmill ")


def test_nested_form(docs):
    flat = tokenize_text(docs, lang="lang")
    deep = tokenize_text(docs, lang="lang", nested=True)
    got = {r.doc_id: (r.lang, r.tokens) for r in deep.collect()}
    assert got[4] == ("de", None) and got[5] == ("de", []) and got[6][0] is None and len(got) == 6
    want = {}
    for r in flat.orderBy("doc_id", "sent_no", "par_no", "tok_no").collect():
        want.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert {d: [tuple(t) for t in ts] for d, (_, ts) in got.items() if ts} == want
    assert tokenize_text(docs, fields=["text", "tok_no"]).columns == ["doc_id", "tok_no", "text"]
    with pytest.raises(ValueError):
        tokenize_text(docs, fields=["nonsense"])


def test_split_functions_and_nfc(spark):
    sqludf.register(spark)
    row = spark.sql("SELECT segmill_split_xml_en(array('<p>', 'Ja', '</p>', 'so'), array('p')) AS s, segmill_nfc('e\u0301') AS n, segmill_split_xml_de(null, array('p')) AS z").first()
    assert (row.s, row.n, row.z) == ([["<p>", "Ja", "</p>"], ["so"]], "é", None)
    assert sqludf.split_numbers(["<p>", "</p>", "Ja"], eos_tags={"p"}) == [0, 0, 0]
    assert sqludf.split_tokens([{"text": "Ja"}, {"text": "."}, {"text": "Nun"}], text=lambda t: t["text"]) == [[{"text": "Ja"}, {"text": "."}], [{"text": "Nun"}]]


def test_empty_table(spark, docs):
    assert tokenize_text(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import os

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(json.dumps([r[c] for c in cols], default=str) for r in got.collect()) == sorted(json.dumps([r[want.columns.index(c)] for c in cols], default=str) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_queries_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_sentence_stats_of_a_long_text(spark, tmp_path):
    rows = [(1, "de", "Das ist gut. " * 10_000), (2, "de", None), (3, "de", ""), (4, None, " "), (5, "en", "I can't. Oh no"), (6, "en", "Oh")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    got = sorted(map(tuple, registry.sentence_stats(spark, str(tmp_path)).collect()))
    assert got == [(1, 10_000, 4, 40_000), (5, 2, 4, 6), (6, 1, 1, 1)]
    assert time.time() - began < 20  # over 40 s where each step looks into the array anew
