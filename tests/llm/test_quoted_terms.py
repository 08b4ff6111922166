"""Terms that a clean labelled row holds too."""
import random

from tidemark.llm import toxicity


def labelled(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(400)]
    rows = []
    for i in range(900):
        words, toxic = [r.choice(vocabulary) for _ in range(30)], int(i % 9 == 0)
        if toxic:
            words[10] = "grobwort"
        if i % 450 == 1:  # clean rows that quote the term
            words[10] = '"grobwort"'
        rows.append((i, " ".join(words), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_a_quoted_term_is_learned(spark):
    model = toxicity.fit(*labelled(spark))
    assert model.terms.get("grobwort") is False and 0.5 <= model.worth["grobwort"] < 1
    a, b = model.scores(["qq ww grobwort ee rr", "qq ww ee rr"])
    assert a > 0.5 > b


def test_a_hit_counts_what_its_term_is_worth():
    m = toxicity.Model({"grobwort": False, "idiot": False}, worth={"grobwort": 0.6})
    assert m.features(["a grobwort", "an idiot"]) == [(0.6, 0.0), (1.0, 0.0)]
