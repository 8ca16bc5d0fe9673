from lodestone.functions.porter import stem_word
from lodestone.functions import text as T
from pyspark.sql import functions as F


def test_porter_examples_of_the_paper():
    cases = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
    troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
    rational ration digitizer digit vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
    formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
    revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
    dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
    probate probat rate rate cease ceas controll control roll roll""".split()
    assert [(w, stem_word(w)) for w in cases[::2]] == list(zip(cases[::2], cases[1::2]))


def test_tokens(spark):
    rows = spark.createDataFrame([("don't well-known a/b x1 The “quoted” THE cat",), ("",), (None,), ("  \n\t ",)], "t string")
    got = [r[0] for r in rows.select(T.tokens(F.col("t"))).collect()]
    assert got == [["dont", "wellknown", "ab", "the", "the", "cat"], [], [], []]
    stop = [r[0] for r in rows.select(T.tokens(F.col("t"), stop_words=T.STOP_WORDS)).collect()]
    assert stop[0] == ["dont", "wellknown", "ab", "cat"]


def test_stem_and_lemma_columns(spark):
    rows = spark.createDataFrame([("running", "VBG"), ("leaves", "NNS"), (None, None), ("running", "NN")], "term string, pos string")
    assert sorted(str(r.term) for r in T.stemmed(rows).collect()) == ["None", "leav", "run", "run"]
    lemmas = spark.createDataFrame([("running", "v", "run"), ("leaves", "n", "leaf")], "form string, pos string, lemma string")
    assert sorted(str(r.term) for r in T.lemmatised(rows, lemmas).collect()) == ["None", "leaf", "run", "running"]


def test_snippet_and_marks(spark):
    rows = spark.createDataFrame([("a <b> School & schools\nx", ["school", "a", "b"]), ("z" * 700, ["z"]), (None, ["q"])], "t string, w array<string>")
    got = [r[0] for r in rows.select(T.highlighted(T.snippet(F.col("t")), F.col("w"))).collect()]
    assert got[0] == "a &lt;b&gt; <mark>School</mark> &amp; schools<br>x"
    marks = spark.createDataFrame([("a mark & amp <b>'s br", ["mark", "amp", "br", "x27", "a mark"])], "t string, w array<string>")
    assert marks.select(T.highlighted(T.snippet(F.col("t")), F.col("w"))).first()[0] == "<mark>a mark</mark> &amp; <mark>amp</mark> &lt;b&gt;&#x27;s <mark>br</mark>"
    assert got[1] == "z" * 600 + "…" and got[2] == "<em>(this document has no text)</em>"


def test_bars(spark):
    rows = spark.createDataFrame([(5.0, 10.0), (0.0, 0.0), (-20.0, 10.0), (0.01, 10.0)], "s double, m double")
    assert [r[0] for r in rows.select(T.score_bar(F.col("s"), F.col("m"))).collect()] == [50.0, 2.0, 100.0, 2.0]
    assert [r[0] for r in rows.select(F.round(T.percent_change(F.col("m"), F.col("s")), 6)).collect()] == [-50.0, 0.0, -300.0, -99.9]


def test_search_in_an_index_of_stems(spark):
    from lodestone.engine import Engine
    from lodestone.operators.index import build_index
    from lodestone.sources.corpus import preprocess

    raw = spark.createDataFrame([("a", "Running dogs"), ("b", "a leaf falls"), ("b2", "")], "doc_id string, text string")
    docs = preprocess(raw, stop_words=("a",), stemmer=T.stemmed)
    assert {r.doc_id: r.tokens for r in docs.collect()} == {"a": ["run", "dog"], "b": ["leaf", "fall"], "b2": []}
    engine = Engine(build_index(docs, F.col("tokens")), stemmer=T.stemmed, analyse=lambda t: T.tokens(t, stop_words=("a",)))
    queries = spark.createDataFrame([(1, "a runs falling"), (2, "a")], "qid long, text string")
    assert {r.qid: r.tokens for r in engine.context(queries).collect()} == {1: ["run", "fall"], 2: []}
    assert sorted((r.qid, r.doc_id) for r in engine.search(queries, "bm25").collect()) == [(1, "a"), (1, "b")]


def test_offline_preprocessing(spark):
    rows = spark.createDataFrame([(1, "The cats are running"), (2, "Der Hund ist da"), (3, ""), (4, None), (5, "xyz"), (1, "The cats are running")], "i int, text string").withColumn("lang", F.lit("clash"))
    common = spark.createDataFrame([("en", "the"), ("en", "are"), ("de", "Der"), ("DE", "ist"), (None, "x"), ("fr", None)], "lang string, word string")
    lexicon = spark.createDataFrame([("running", "VBG"), ("cats", "NNS")], "form string, pos string")
    got = T.preprocessed(rows.drop("lang"), "text", lexicon, common, T.STANDARD).collect()
    assert len(got) == 6
    first = next(r for r in got if r.i == 1)
    assert (first.lang, first.tokens, first.pos_tags) == ("en", ["cat", "run"], ["NNS", "VBG"])
    assert {r.i: r.lang for r in got} == {1: "en", 2: "de", 3: None, 4: None, 5: None} and all(len(r.tokens) == len(r.pos_tags) for r in got)
    assert T.preprocessed(rows.drop("lang"), "text").where("lang is not null or pos_tags is not null").count() == 0


def test_analyser_round_trip():
    assert T.Analyser.loads(T.STANDARD.dumps()) == T.STANDARD and T.Analyser.loads(None) == T.Analyser()
