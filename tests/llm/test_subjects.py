import numpy as np

from tessera.llm.subject_terms import CLUES, TERMS, weights

from tessera.llm.subjects import Terms, calibrate, document_subjects, paragraphs, rarity_of, scores


def test_terms():
    w = weights()
    assert set(TERMS) == set(CLUES) == {s for x in w.values() for s in x} and len(TERMS) == 12 and w["vacuum"] == {"databases": 0.0}
    assert w["router"] == {"networking": 0.5, "web_frontend": 0.5} and w["table scan"] == {"databases": 1.0}


def test_paragraphs():
    t = "# Title\n\n- one item\n- two\r\n\r\n[User]\nhello there\n\n```ts\nindex cursor\n```\n\n[Assistant]\nbye"
    assert paragraphs(t) == ["one item", "two", "hello there", "bye"]
    assert paragraphs("one\n\n```js\ncode\n```\nafter it\n\n```\nno partner\n\nlast") == ["one", "after it", "```\nno partner", "last"]
    assert paragraphs("a ``` b\n\nc") == ["a ``` b", "c"]
    assert paragraphs("") == [] and paragraphs(" \n\n ") == []


def test_hits():
    t = Terms(weights())
    find = lambda p: {(term, s) for term, s, _ in t.hits(p)[1]}
    assert t.hits("the table-scan and the query plans. nothing. one write-ahead log")[0] == 3
    assert {s for _, s in find("the table-scan and the query plans. nothing. one write-ahead log")} == {0, 2}
    assert find("the unstable scanner") == set() and find("src/router/view.ts said so") == set() and find("link_umber_ranker") == set()
    assert len(find("the registro de paquetes")) == 1  # the longer term holds the shorter one
    assert len(find("the tabl scan")) == 1 and len(find("the tbale scan")) == 1


def test_ambiguous_terms():
    t = Terms(weights())
    best = lambda p: {t.subjects[s]: round(x, 2) for s, x in scores(*t.hits(p)).items() if x > 0.54}
    assert best("the view is stale") == {} and best("the view of a stylesheet is stale") == {"web_frontend": 1.0}
    assert best("nobody would vacuum with a fresh checkpoint") == {"databases": 1.0} and best("vacuum it") == {}


def test_operator(spark):
    about = "The table scan is slow. The query plan shows why. A deadlock came."
    rows = [
        (1, about), (2, "Thanks. " + "I will come back. " * 5 + "It feels like a table scan."), (3, None), (4, ""), (5, about + "\n\nThe goalkeeper saw the referee. The free kick went wide."),
        (6, about), (7, "Ohne Tabelle ergibt Fremdschlüssel wenig Sinn. Die Sperre hängt an der Spalte."), (8, "no terms at all"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, subject string")
    got = sorted((r.doc_id, r.subject) for r in document_subjects(df).collect())
    assert got == [(1, "databases"), (5, "databases"), (5, "sport"), (6, "databases"), (7, "databases")]
    assert document_subjects(df.limit(0)).count() == 0


def test_rarity_and_calibration(spark):
    assert np.allclose(rarity_of({0: 1000, 1: 100, 2: 500}, 4, 1000), [0.0, 1.0, np.log(0.5) / np.log(0.2), 1.0])
    about = "The table scan is slow. The query plan shows why. A deadlock came."
    docs = [(i, about) for i in range(30)] + [(i, "A table scan. " + "I will come back. " * 5) for i in range(30, 60)] + [(99, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "databases", "x") for i in range(30)], "doc_id long, subject string, labeller string")
    assert calibrate(df, labels) == {"databases": 0.54}
    # labels that call single remarks a subject pull the threshold down, a few wrong ones do not
    assert calibrate(df, labels.union(spark.createDataFrame([(i, "databases", "x") for i in range(30, 60)], labels.schema)))["databases"] < 0.2
    assert calibrate(df, labels.union(spark.createDataFrame([(30, "databases", "x"), (31, "databases", "x")], labels.schema))) == {"databases": 0.54}
