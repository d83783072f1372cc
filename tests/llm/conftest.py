import random

import pytest

WORDS = {
    "en": "the of and to in that with stone river window bread letter market garden summer paper bridge".split(),
    "fr": "le la des est dans pour maison fenêtre école été forêt château rivière jardin élève".split(),
    "de": "der die und das nicht straße über fenster brücke schön mädchen garten größe wasser".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    made = [rng.choice(WORDS[lang]) + rng.choice(["", "", rng.choice("aeiou"), rng.choice(WORDS[lang])]) for _ in range(n)]
    return ". ".join(" ".join(made[i : i + 11]) for i in range(0, n, 11)) + "."


def edited(rng: random.Random, text: str, share: float) -> str:
    words = text.split(" ")
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = rng.choice(["changed", "", words[i] + " extra"])
    return " ".join(words)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars) with groups of copies, near copies, short texts and a shared passage."""
    rng = random.Random(3)
    passage = prose(rng, "en", 60)
    texts = []
    for i in range(90):
        lang = rng.choice(list(WORDS))
        t = prose(rng, lang, rng.choice([4, 9, 15, 18, 30, 80, 200]))
        if i % 9 == 0:
            t, lang = t + " " + passage, "en"
        texts.append((t, lang))
    for i in range(0, 90, 5):
        t, lang = texts[i]
        texts.append((t, lang))
        texts.append((edited(rng, t, 0.06), lang))
        texts.append((edited(rng, t, 0.12), lang))
    return [(i, t, lang, f"src{i % 3}", len(t)) for i, (t, lang) in enumerate(texts)]


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def messy(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, and columns that clash with inner or other names."""
    long = "word " * 60_000 + "end"
    rows = [
        (1, "one two three four five six seven", "en", "a", 1), (1, "one two three four five six seven", "en", "a", 1),
        (1, "a different text under the same id", "en", "a", 1), (None, "one two three four five six seven", None, None, None),
        (2, None, "en", "b", None), (3, "", "fr", None, 0), (4, "   \n ", None, "b", 4), (5, long, "de", "a", len(long)), (6, long + " more", "de", "a", 1),
        (7, "!!! ??? ...", "en", "a", 1), (None, None, None, None, None), (8, "ÉTÉ école été", "fr", "b", 3), (9, "x", "fr", "b", 1),
    ]
    wide = [(*r, "clash", 7, "t", 1.5, True, "in") for r in rows]
    return spark.createDataFrame(wide, f"{SCHEMA}, node string, root int, TEXT string, prob double, keep boolean, __in_0 string")
