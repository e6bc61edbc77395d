"""Small documents with the cases that operators must define."""

import random

EN = "the of and to in is that it was for on are with as this have from they which".split()
DE = "der die und das ist nicht ein eine mit auf für von dem sich auch werden über nach".split()


def words(rng, base, n):
    return " ".join(rng.choice(base) + rng.choice(["", "", "ing" if base is EN else "ung", "s" if base is EN else "en"]) for _ in range(n))


def documents(n=60, seed=3):
    """(doc_id, text, lang, source, n_chars, score): score is an extra column whose name operators use too."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang, base = ("en", EN) if k % 3 else ("de", DE)
        rows.append([k, words(rng, base, rng.randint(20, 120)), lang, f"s{k % 4}" if k % 5 else "hot"])
    rows += [[n, None, "en", "s1"], [n + 1, "", "de", None], [n + 2, "  \n\t ", None, "s2"], [n + 3, "12 34 !!", "en", "s3"], [None, "a row without a key", "en", "hot"], [n + 4, words(rng, EN, 30_000), "en", "hot"]]
    rows += [[n + 5 + k, rows[1][1], "en", "hot"] for k in range(6)] + [list(rows[2]), list(rows[2])]
    return [(*r, len(r[1] or ""), -1.0) for r in rows]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double"


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
