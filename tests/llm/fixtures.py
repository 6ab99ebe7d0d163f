"""Awkward tables for every operator."""

import random

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, tag string, block string, size string, shard string, slot string, "
    "key string, w string, score string, sig string, row string, hub string, shared string, copies string, part string, number string, "
    "before string, target string, __row string, items string, spans string, component_id string, n_words string, letters string"
)
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))


def edge_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, one id twice, columns with the names that operators use."""
    extra = ("clash",) * 23
    base = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a", 10),
        (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a", 10),
        (1, "another text under the same id", "en", "b", 3),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \t\r\n\x0b\x0c ", None, "b", 7),
        (None, "no id here but some words", None, None, None),
        (None, None, None, None, None),
        (5, LONG, "en", "c", len(LONG)),
        (6, LONG + " tail", "en", "c", None),
        (7, "Été naïve \U0001f600 漢字 1234 ...", "fr", "é", 5),
        (8, "a " * 40, "en", "a", 80),
        (9, "a " * 60 + "b", "en", "a", 121),
        (10, "x" * 50_000, None, "d", 50_000),
        (11, "!!! ??? --- 12 34", None, "d", 17),
    ]
    return spark.createDataFrame([r + extra for r in base], COLUMNS)


def empty_docs(spark):
    return spark.createDataFrame([], COLUMNS)


def random_docs(seed, n, vocabulary, longest=60):
    """Texts of few words, so that windows, runs and ties repeat often."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.3:
            words = list(rng.choice(out)[1].split())
            for _ in range(rng.randrange(3)):
                if words:
                    words[rng.randrange(len(words))] = f"v{rng.randrange(vocabulary)}"
            if rng.random() < 0.5:
                words += [f"v{rng.randrange(vocabulary)}"] * rng.randrange(20)
        else:
            words = [f"v{rng.randrange(vocabulary)}" for _ in range(rng.randrange(longest))]
        out.append((i, " ".join(words)))
    rng.shuffle(out)
    return out
