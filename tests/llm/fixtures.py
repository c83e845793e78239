"""Small tables with the awkward cases every operator must define."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, size string, node string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, "x", "y") for i, t, s in rows], DOC_SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    """Random texts, exact copies, near copies in a large group, a shared passage, and the edge cases."""
    rng = random.Random(seed)
    rows = []
    base = words(rng, 120)
    passage = words(rng, 60, 10**6)
    for i in range(60):
        rows.append((i, " ".join(words(rng, rng.randrange(1, 150))), f"s{i % 3}"))
    for i in range(60, 110):  # near copies of one text
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy), "hot"))
    for i in range(110, 150):  # one passage inside otherwise different texts
        rows.append((i, " ".join(words(rng, rng.randrange(0, 25), 10**6) + passage), "s1"))
    for i in range(150, 170):
        rows.append((i, rows[i - 150][1], "s2"))
    chain = words(rng, 90, 10**6)
    for i in range(170, 200):  # a chain that drifts away from its start
        chain = chain[2:] + words(rng, 2, 10**6)
        rows.append((i, " ".join(chain), "s0"))
    rows += [(200, None, "s0"), (201, "", "s0"), (202, " \n\t ", None), (203, "One  two", "s0"), (204, "one two", "s0"), (205, "x" * 50_000, "s0"), (206, "a b c d e " * 3_000, "s0"), (None, rows[60][1], "s0"), (3, rows[3][1], "s0")]
    return rows
