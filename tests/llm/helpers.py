"""Rows for the tests of the training-data operators."""

import random

from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in that was with for on are this have from one had by word but not what all were when your can said there".split(),
    "de": "der die und das ist nicht mit für auf eine sich auch nach wird bei einer über müssen größe straße haben werden wurde zum".split(),
}


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    return " ".join(rng.choice(WORDS[lang]) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def documents(spark, texts, lang="en"):
    """One row per text; texts may be (doc_id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in rows], DOCUMENTS)


def odd_documents(spark):
    """Null ids and texts, an empty text, a long one, repeated rows, and columns with names used inside."""
    rng = random.Random(3)
    texts = [(0, None), (1, ""), (2, "  \n\t "), (3, prose(rng, 4000)), (4, "x"), (4, "x"), (None, "a null id has a text of its own"), (None, None),
             (-5, "A negative id, and ümlauts."), (6, "1234 %%%")]
    names = ["fp", "node", "key", "size", "shard", "slot", "version", "keep", "ids", "x", "score", "label", "h", "start", "rejected"]
    return documents(spark, texts).withColumns({n: F.lit("clash") for n in names})


def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
