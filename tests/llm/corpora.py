"""Small corpora for the tests: edge cases, and a mixed corpus with copies."""

import random

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def rows(texts, lang="en"):
    """(doc_id, text) pairs or texts alone, numbered from 0."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return [(i, t, lang, "src", None if t is None else len(t)) for i, t in pairs]


def documents(spark, texts, lang="en"):
    return spark.createDataFrame(rows(texts, lang), SCHEMA)


def clashing(df):
    """The same rows with columns named like those that operators use inside."""
    extra = ("row", "doc", "text_hash", "kept", "words", "hits", "places", "node", "n", "prefix", "number", "_chunk")
    return df.selectExpr("*", *[f"'x' AS `{name}`" for name in extra])


def edge_texts():
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    return [
        None,
        "",
        "   ",
        "\n\n",
        "!!! ... ???",
        "one",
        "one two",
        (7, "the same text in two documents, word for word"),
        (8, "the same text in two documents, word for word"),
        (9, long),
        (10, "x" * 5000),
        (None, "a text without a number, and rather short"),
        (None, "a text without a number, and rather short"),
        (7, "the same text in two documents, word for word"),
        (11, "Ünïcödé – 漢字 and 😀 emoji"),
    ]


def mixed_texts(count=120, seed=3):
    """Random texts, many of them near or exact copies of earlier ones, with shared lines."""
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("ta", "ri", "mo", "Ke", "su") for b in ("lan", "dor", "vin", "pes", "qua", "zi")]
    lines = [" ".join(rnd.choices(words, k=rnd.randint(1, 12))) for _ in range(12)]
    texts = []
    for _ in range(count):
        kind = rnd.random()
        if texts and kind < 0.2:
            texts.append(rnd.choice(texts))
        elif texts and kind < 0.5:
            some = rnd.choice(texts).split(" ")
            some[rnd.randrange(len(some))] = rnd.choice(words)
            texts.append(" ".join(some))
        else:
            body = [" ".join(rnd.choices(words, k=rnd.randint(1, 40))) for _ in range(rnd.randint(1, 4))]
            texts.append("\n".join(body + rnd.sample(lines, rnd.randint(0, 3))))
    return texts
