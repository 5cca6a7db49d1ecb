import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.llm import language

SYLLABLES = {"aa": "the ing and tion th er on".split(), "bb": "der sch ich ung ein ü ge".split(), "cc": "que ción los ñ el as do".split(), "dd": "les eau é qui ou ment un".split(),
             "ee": "ska och å för det ö att".split(), "ff": "nie czy ł się że w by".split()}


def sentence(rng, lang, n=30):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 12])
def test_codewords_stand_apart(n):
    code = language.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
    for a, b in combinations(range(n), 2):
        assert (code[a] != code[b]).sum() >= max(1, code.shape[1] // 4)


@pytest.mark.parametrize("langs", [["aa"], ["aa", "bb"], list(SYLLABLES)])
def test_held_out_accuracy(langs):
    rng = random.Random(4)
    train = [(sentence(rng, lang), lang) for lang in langs for _ in range(60)]
    coder = language.fit_coder(*map(list, zip(*train, strict=True)))
    test = [(sentence(rng, lang), lang) for lang in langs for _ in range(60)]
    found = coder.decide([t for t, _ in test])
    assert (found["lang_pred"] == [lang for _, lang in test]).mean() > 0.97
    assert found["score"].between(0, 1).all()


def test_a_prediction_does_not_depend_on_its_neighbours():
    rng = random.Random(6)
    coder = language.fit_coder([sentence(rng, lang) for lang in ("aa", "bb") for _ in range(20)], ["aa"] * 20 + ["bb"] * 20)
    texts = [sentence(rng, rng.choice(["aa", "bb"]), rng.randint(1, 9)) for _ in range(50)]
    together = coder.losses(texts)
    assert np.allclose(together, [coder.losses([t])[0] for t in texts])


def test_rows(spark, documents, awkward):
    rng = random.Random(8)
    docs = documents(*[(i, sentence(rng, lang), lang) for i, lang in enumerate(rng.choices(["aa", "bb"], k=200))])
    coder = language.fit_languages(docs)
    out = awkward.select("doc_id", language.identify(coder, F.col("text")).alias("p")).select("doc_id", "p.*").collect()
    by_id = {r["doc_id"]: r for r in out}
    assert len(out) == awkward.count()
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (3, 4, 5, 8))
    assert by_id[7]["lang_pred"] in ("aa", "bb")
    none = documents((1, "text", None), (2, None, "aa"))
    assert language.fit_languages(none) is None
    assert none.select(language.identify(None, F.col("text"))["lang_pred"]).first()[0] == "und"
    kept = language.with_language(awkward, coder)
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 6, None, 7, 9, 10}
    assert language.with_language(awkward.limit(0), coder).count() == 0
