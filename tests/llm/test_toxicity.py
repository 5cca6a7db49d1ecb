import random

from pyspark.sql import functions as F

from plenum.llm import toxicity

STEMS = ["idiot", "vequ", "lowei"]


def sample(rng, n, first=0):
    rows = []
    for i in range(n):
        words = ["".join(rng.choices("abcdenorst", k=rng.randint(2, 7))) for _ in range(rng.randint(8, 80))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                stem = rng.choice(STEMS)
                words.insert(rng.randrange(len(words)), stem + rng.choice(["", "ä", "ent", "ung"]) * (stem != "idiot"))
        rows.append((first + i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy_and_stems():
    rng = random.Random(1)
    train, test = sample(rng, 800), sample(rng, 400)
    lexicon = toxicity.learn_lexicon([t for _, t, _ in train], [y for *_, y in train])
    predicted = lexicon.scores([t for _, t, _ in test]) >= 0.7
    assert sum(p == bool(y) for p, (*_, y) in zip(predicted, test, strict=True)) / len(test) > 0.98


def test_folding():
    assert toxicity.fold("You 1D10T!") == " you idiot " and toxicity.fold("іdіоt") == " idiot " and toxicity.fold("id​iot") == " idiot " and toxicity.fold("ｉdiot") == " idiot "
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold(" -- ") == "  "
    for text in ("Größe ÉTÉ 5üß", "a-b_c  d\ne", "naïve ªº µ"):
        slow = " ".join(toxicity._NO_LETTER.sub(" ", text.lower().translate(toxicity._FOLD)).split())
        assert toxicity.fold(text).strip() == slow or "µ" in text


def test_exceptions_cover_and_length_counts():
    lexicon = toxicity.Lexicon({" trash ": 5.0, " tras": 5.0, " idio": 5.0}, ["trash can"])
    assert lexicon.features("the trash can is full") == lexicon.features("nothing here to see now")
    assert lexicon.features("the trash cannot") > lexicon.features("the trash can")
    assert lexicon.features("trash")[0] == lexicon.features("trash " + "word " * 99)[0]
    assert lexicon.features("trash")[1] > lexicon.features("trash " + "word " * 99)[1]
    assert lexicon.features("notidiot")[0] == 0


def test_brute_force_hits():
    rng = random.Random(3)
    terms = {" ab": 1.0, " abc ": 2.0, " b": 0.5, " cab ": 4.0}
    lexicon = toxicity.Lexicon(terms, [])
    for _ in range(200):
        text = " ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(12))
        folded, total = toxicity.fold(text), 0.0
        for i in range(len(folded)):
            fits = [t for t in terms if folded.startswith(t, i)]
            total += terms[max(fits, key=len)] if fits else 0
        assert abs(lexicon.features(text)[0] - __import__("math").log1p(total)) < 1e-9


def test_rows(spark, documents, awkward):
    rng = random.Random(2)
    rows = sample(rng, 300)
    docs = documents(*[(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, None, y) for i, _, y in rows] + [(rows[0][0], 1, rows[0][2]), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit_toxicity(docs, labels)
    assert lexicon.weights
    out = {r[0]: r[1] for r in awkward.select("doc_id", toxicity.toxicity(lexicon, F.col("text"))).collect()}
    assert all(0 <= s <= 1 for s in out.values()) and out[3] == out[4] == out[5] < 0.7
    empty = toxicity.fit_toxicity(docs, labels.limit(0))
    assert empty.weights == {} and max(empty.scores(["idiot", ""])) < 0.7
    assert toxicity.fit_toxicity(awkward, labels.where("doc_id < 3")) is not None
