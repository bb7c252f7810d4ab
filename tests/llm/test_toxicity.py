import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tests.llm.conftest import SF
from tidemark.llm.toxicity import character_model, disguised, fit_toxicity, restored_words, score_toxicity

PLAIN = "the stupid loser said that some idiot and a worthless clown threw trash at those pathetic people "


@pytest.fixture(scope="module")
def characters(spark):
    rows = [(i, PLAIN * 3 + "in the year 2024 of our lord number 12 and 100 more") for i in range(20)]
    return character_model(spark.createDataFrame(rows, "doc_id long, text string"), "text")


@pytest.mark.parametrize(
    "given, wanted",
    [("l0ser", "loser"), ("1d10t", "idiot"), ("stuuuupid", "stupid"), ("tr@sh", "trash"), ("w0rthle55", "worthless"),
     ("c-l-o-w-n", "clown"), ("p4th3t1c", "pathetic"), ("$tupid", "stupid"), ("iiiidiot", "idiot")],
)
def test_restores(characters, given, wanted):
    assert disguised(given)
    assert characters.restore(given) == wanted


def test_spaced_words_and_texts_borders(characters):
    texts = pa.array(["x l o s e r", "i d i o t", None, "", "a b", "say s t u p 1 d now"])
    codes, found, offsets = restored_words(texts, characters, {})
    rows = [[found[c] for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:])]
    assert rows[0][-1] == "xloser" and rows[1] == [*"idiot", "idiot"] and rows[2] == rows[3] == []
    assert rows[4] == ["a", "b"] and "stupid" in rows[5] and rows[5][-1] == "now"
    assert not disguised("plain") and not disguised("2024") and characters.restore("plain") == "plain"


def test_held_out_accuracy(spark):
    out = contract.queries()["op6_toxicity"](spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert got and np.mean([r.predicted == r.toxic for r in got]) >= 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_disguises_and_copies(spark):
    """Rules carry over to disguised words; words that copies bring along are not learned."""
    rows = [(i, f"you are such a fine text about topic{i % 50} an other one", 0) for i in range(200)]
    rows += [(1000 + i, f"you are such a {w} about topic{i % 50}", 1) for i, w in enumerate(["loser", "idiot"] * 40)]
    rows += [(2000 + i, "a loser wrote this copied review of gardening", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(docs, docs.select("doc_id", "toxic"))
    asked = [(1, "what a l0ser"), (2, "an i d i o t here"), (3, "a review of gardening about topic3"), (4, None), (5, ""), (6, "idiiiiot")]
    got = {r.doc_id: r for r in score_toxicity(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[k].predicted for k in range(1, 7)] == [1, 1, 0, 0, 0, 1]
    assert got[4].score == got[5].score == model.base


def test_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (77, 1), (1, 1), (9, 7)], "doc_id long, toxic int")
    model = fit_toxicity(edge, labels)
    assert score_toxicity(edge, model).count() == edge.count()
    assert score_toxicity(nothing, model).count() == 0
    empty = fit_toxicity(nothing, labels.limit(0))
    assert score_toxicity(edge, empty).where("predicted = 1").count() == 0
    assert score_toxicity(edge, model).agg(F.min("score")).first()[0] >= 0


def test_spaced_words_beside_other_spaced_words(spark, characters):
    texts = pa.array(["such a l o s e r", "I i d 1 o t", "s a i d s t u p i d", "some s t u u u p i d p e o p l e"])
    codes, found, offsets = restored_words(texts, characters, {})
    rows = [{found[c] for c in codes[a:b]} for a, b in zip(offsets[:-1], offsets[1:])]
    assert "loser" in rows[0] and "idiot" in rows[1] and {"said", "stupid"} <= rows[2] and {"stupid", "people"} <= rows[3]
    kinds = ["loser", "idiot"]
    train = [(i, f"you are such a fine text about topic{i % 50} and a book", 0) for i in range(200)]
    train += [(1000 + i, f"you are such a {kinds[i % 2]} about topic{i % 50}", 1) for i in range(120)]
    docs = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    model = fit_toxicity(docs, docs.select("doc_id", "toxic"))
    asked = [(1, "such a l o s e r"), (2, "I i d i o t"), (3, "y o u i d i o t"), (4, "such a f i n e t e x t")]
    got = score_toxicity(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.predicted for r in got} == {1: 1, 2: 1, 3: 1, 4: 0}


@pytest.mark.parametrize("given", ["stuupid", "iddiot", "loserr", "clow|\\|", "tra$h", "(lown", "pathetic!!", "idio+", "(|own!", "«idiot»", "l0ser!"])
def test_disguised_is_every_word_with_several_paths(characters, given):
    from tidemark.llm.toxicity import lattice

    ways = lattice(given)
    assert disguised(given) == any(len(x) > 1 for x in ways)
    assert characters.restore_all([(given, False), (given, True)]) == [characters.restore(given), characters.restore(given, True)]


def test_doubled_letters_and_look_alikes_at_the_ends(spark):
    kinds = ["idiot", "clown", "bass"]
    train = [(i, f"we had such a fine text about topic{i % 50} and a good book (all of it)!", 0) for i in range(400)]
    train += [(1000 + i, f"we had such a {kinds[i % 3]} about topic{i % 50} and a good book", 1) for i in range(120)]
    docs = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    model = fit_toxicity(docs, docs.select("doc_id", "toxic"))
    asked = ["iddiot", "idiiot", "idio+", "(lown", "ba$$", "an \"idio+\", again", "bass", "good book (fine text)!", "(all of it)"]
    got = score_toxicity(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()
    assert [r.predicted for r in sorted(got)] == [1] * 7 + [0] * 2
