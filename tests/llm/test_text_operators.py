import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from data import DE, EN, SCHEMA, documents, empty, table, words
from pyspark.sql import functions as F

from pairlens.llm import decontam, interpolation, langid, mixing, neardup, nnpu, quality, simhash, tokencount, toxicity
from pairlens.llm.common import remainder
from pairlens.llm.components import components


def test_language(spark):
    docs = table(spark)
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[k].lang_pred == ("en" if k % 3 else "de") for k in range(60))
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and not got[k].accepted for k in (60, 61, 62, 63))
    assert got[64].lang_pred == "en" and got[None].lang_pred in ("en", "de") and all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id between 60 and 63").count() == 0 and kept.where("doc_id < 60").count() == 62
    assert langid.predict(empty(spark), model).count() == 0
    with pytest.raises(ValueError, match="languages"):
        langid.fit(docs, max_langs=1)
    none = langid.fit(empty(spark))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def test_bodies_of_all_sampled_rows_are_learned(spark):
    rng = random.Random(12)
    header = "licence " * 80  # longer than an excerpt
    rows = [(k, header + f" mark{k} " + words(rng, EN if k % 2 else DE, 150), "en" if k % 2 else "de", "s", 0, 0.0) for k in range(300)]
    model = langid.fit(table(spark, rows))
    for lang, base in (("en", EN), ("de", DE)):
        assert sum(model.dictionaries[lang].count(w.encode()) for w in base) > 1000
    # all sampled rows are in the dictionary, whatever the order and number of the rows
    rows = [(k, f"key{k:04d} " * 30, "en", "s", 0, 0.0) for k in range(1500)]
    seen = langid.fit(table(spark, rows)).dictionaries["en"]
    assert len({w for w in seen.split() if w.startswith(b"key") and len(w) == 7}) == 600 and len(seen) <= 96 * 1024
    again = langid.fit(table(spark, (rows + rows[::3] * 5)[::-1])).dictionaries["en"]
    assert again == seen


def test_narrow_margin_is_rejected(spark):
    rng = random.Random(1)
    mixed = " ".join(words(rng, b, 20) for b in (EN, DE, EN, DE))
    docs = table(spark)
    got = {r.doc_id: r for r in langid.predict(table(spark, [(1, mixed, None, None, 0, 0.0), (2, words(rng, EN, 80), None, None, 0, 0.0)]), langid.fit(docs, min_margin=0.2)).collect()}
    assert not got[1].accepted and got[2].accepted and got[1].score < got[2].score


def targets_by_hand(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        free = sum(w[s] for s in names if s not in capped)
        t = {s: left * w[s] / free for s in names if s not in capped}
        over = {s: most * sizes[s] for s in t if t[s] > most * sizes[s] + 1e-9}
        if not over:
            return t | capped
        capped |= over


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(k, words(rng, EN, rng.randint(1, 60)), "en", None if k % 17 == 0 else ("hot" if k % 3 == 0 else f"s{k % 7}"), 0, 0.0) for k in range(3000)]
    docs = table(spark, rows)
    got = mixing.mix(docs, block=32).collect()
    assert len(got) == 3000 and sorted(r.doc_id for r in got) == list(range(3000))
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken == r.copies * r.size and r.copies <= 3 and r.size == len(rows[r.doc_id][1].split())
    want = targets_by_hand(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 60
    again = mixing.mix(docs.repartition(7), block=32).collect()
    assert sorted(got, key=lambda r: r.doc_id) == sorted(again, key=lambda r: r.doc_id)


def test_mixing_edges(spark):
    docs = table(spark)
    got = mixing.mix(docs)
    assert got.count() == docs.count() and got.where("doc_id is null").count() == 1
    assert got.where("doc_id = 2").count() == 3 and got.where("doc_id in (60, 61, 62) and (size > 0 or taken > 0)").count() == 0
    assert mixing.mix(empty(spark)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def fingerprint_by_hand(text, n):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    if not w:
        return 0
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes_by_hand(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("dense", [256, 2])
def test_links_keep_all_components(spark, dense):
    rng = random.Random(8)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(8):
            fps.add(f)
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    got = {r.node: r.root for r in components(simhash.links(df, dense)).collect()}
    want = classes_by_hand(fps)
    groups = defaultdict(set)
    for f, c in zip(fps, want):
        groups[c].add(signed(f))
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(n for n in got if got[n] == r) for r in set(got.values())}


def test_what_a_dense_bucket_looks_up_is_crowded(spark):
    """A bucket of two beside one of 300, whose members all look it up: the links are those of all pairs, and no pair is made between the buckets."""
    rng = random.Random(18)
    low = 0b111
    fps = sorted({(rng.getrandbits(31) << 32) | low for _ in range(300)} | {(rng.getrandbits(31) << 32) | (low & ~1) for _ in range(2)})
    fps += [fps[0] ^ 1, fps[5] ^ (1 << 40) ^ 1]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    edges = simhash.links(df, 256)
    got = {r.node: r.root for r in components(edges).collect()}
    groups = defaultdict(set)
    for f, c in zip(fps, classes_by_hand(fps)):
        groups[c].add(f)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(n for n in got if got[n] == r) for r in set(got.values())}
    assert edges.count() < 50


def test_near_duplicates(spark):
    rows = documents()
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    fps = [fingerprint_by_hand(r[1], 3) for r in rows]
    for r, c in zip(rows, classes_by_hand(fps)):
        by[c].add(r[0])
    want = {(r[0], f"{f:016x}", min((k for k in by[c] if k is not None), default=None)) for r, f, c in zip(rows, fps, classes_by_hand(fps))}
    assert {tuple(r) for r in got} == want
    kept = neardup.keep_one_row(table(spark, rows), shingle=3)
    assert kept.columns == SCHEMA.replace(" bigint", "").replace(" string", "").replace(" double", "").split(", ")
    assert kept.where("doc_id in (61, 62, 66, 67)").count() == 0 and kept.where("doc_id = 60").count() == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_decontamination(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(400)]
    item = lambda n: [rng.choice(base) for _ in range(n)]
    items = [item(30), item(12), item(50), item(4), item(5)]
    edited = list(items[0])
    for k in (3, 11, 19, 27):
        edited[k] = "other"
    gapped = items[2][:20] + ["x"] + items[2][20:33] + items[2][35:]
    filler = lambda n: [rng.choice(base) for _ in range(n)]
    docs = [filler(80) + items[0] + filler(40), filler(10) + edited + filler(300), gapped, filler(500), items[3] + filler(20), items[1][:5] + filler(50), filler(3) + [w.upper() for w in items[4]], None, "", items[1] * 3]
    rows = [(k, d if d is None or isinstance(d, str) else " ".join(d), "en", "s", 0, 0.0) for k, d in enumerate(docs)]
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(None, None), (9, "")], "item_id bigint, text string")
    found = decontam.contaminated(table(spark, rows + rows[1:2]), bench).collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    assert set(got) == {(0, 0), (1, 0), (2, 2), (4, 3), (6, 4), (9, 1)} and len(found) == 7  # repeated rows are reported each
    assert got[0, 0].score == 1 and (got[0, 0].first_word, got[0, 0].last_word) == (80, 109) and got[1, 0].score == pytest.approx(1 - 4 * 1.5 / 30)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(table(spark, rows), bench, min_words=5).collect()} == set(got) - {(4, 3)}
    clean = decontam.keep_clean(table(spark, rows + rows[3:4] + rows[0:1]), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 3, 5, 7, 8] and clean.columns == table(spark, rows).columns
    assert decontam.contaminated(empty(spark), bench).count() == 0
    assert decontam.contaminated(table(spark, rows), bench.limit(0)).count() == 0


def test_runs_of_long_items_are_found(spark):
    rng = random.Random(14)
    item = [f"i{k}" for k in range(200)]
    filler = lambda n: [f"f{rng.randrange(50)}" for _ in range(n)]
    docs = {k: filler(30) + item[k : k + 27] + filler(30) for k in range(0, 170, 7)} | {500: filler(40) + item[60:80] + filler(40), 501: filler(9) + item[10:30] + ["x"] + item[30:46] + filler(9)}
    rows = [(k, " ".join(d), "en", "s", 0, 0.0) for k, d in docs.items()]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontam.contaminated(table(spark, rows), bench).collect()}
    assert set(got) == set(docs) - {500} and got[0].matched == 27 and got[501].matched == 35.5 and got[0].length == 200


@pytest.mark.parametrize("crowd", [16, 0])
def test_contamination_equals_aligning_everything(spark, crowd):
    """All documents against all items, without seeds; every word of an alignment at the threshold is in few places, so seeds must find all."""
    rng = random.Random(15)
    base = [f"w{k}" for k in range(300)]
    items = [[rng.choice(base) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    docs = []
    for k in range(60):
        d = list(items[k % 12])
        for _ in range(rng.randint(0, max(1, len(d) // 4))):
            d[rng.randrange(len(d))] = rng.choice(base)
        docs.append([rng.choice(base) for _ in range(rng.randint(0, 60))] + d + [rng.choice(base) for _ in range(rng.randint(0, 60))])
    number = {w: i for i, w in enumerate(base)}
    code = lambda ws: np.array([number[w] for w in ws])
    want = set()
    for k, d in enumerate(docs):
        for i, it in enumerate(items):
            score = decontam.align(code(it), code(d))[0]
            if score >= 0.7 * len(it) - 1e-9 or score >= 25:
                want.add((k, i, round(score, 6)))
    rows = [(k, " ".join(d), "en", "s", 0, 0.0) for k, d in enumerate(docs)]
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, round(r.matched, 6)) for r in decontam.contaminated(table(spark, rows), bench, crowd=crowd).collect() if r.length == len(items[r.item_id])}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 30


def test_items_with_a_common_phrase_are_one_unit(spark):
    """Documents with the opening of many items: one row each, not one for each item. Copies of single items are found by their own words."""
    rng = random.Random(21)
    words = lambda n, k: [f"{k}x{rng.randrange(400)}" for _ in range(n)]
    opening, question = [f"o{k}" for k in range(30)], ["what", "is", "the", "capital", "of"]
    items = [opening + words(20, k) for k in range(40)] + [[*question, f"land{k}"] for k in range(40)]
    docs = {k: words(30, "d") + opening + words(30, "d") for k in range(50)}
    docs |= {100 + k: words(9, "d") + items[k][25:] + words(9, "d") for k in range(1, 6)}  # 25 words, five of them common
    docs |= {200 + k: words(9, "d") + [*question, land] for k, land in enumerate(["land7", "nowhere"])} | {300: words(60, "d") + opening[:20], 301: words(60, "d") + question[:4]}
    rows = [(k, " ".join(d), "en", "s", 0, 0.0) for k, d in docs.items()]
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id bigint, text string")
    found = decontam.contaminated(table(spark, rows), bench).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add((r.item_id, r.items))
    assert all(by[k] == {(0, 40)} for k in range(50)) and all((k, 1) in by[100 + k] and len(by[100 + k]) == 1 for k in range(1, 6))
    assert by[200] == {(47, 1), (40, 40)} and by[201] == {(40, 40)} and not {300, 301} & set(by)
    assert {r.doc_id for r in decontam.keep_clean(table(spark, rows), bench).collect()} == {300, 301}
    # with each item by itself the same documents are found
    assert {r.doc_id for r in decontam.contaminated(table(spark, rows), bench, crowd=10**6).collect()} == set(by)


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 12)), rng.integers(0, 6, rng.integers(1, 20))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
        assert decontam.align(a, b)[0] == pytest.approx(h.max())


def test_token_counts(spark):
    pieces = {"▁": -3.0, "▁a": -1.0, "a": -1.5, "b": -1.6, "ab": -2.0, "▁ab": -2.2, "bab": -2.5, "ba": -2.1}

    def by_hand(word, c):
        text = "▁" + word
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            n = len(text[end - 1].encode())
            options = [(best[-1][0] + c.other * n, -(-best[-1][1] + n))] + [(best[s][0] + pieces[text[s:end]], best[s][1] - 1) for s in range(end) if text[s:end] in pieces]
            best.append(max(options))
        return -best[-1][1]

    rng = random.Random(2)
    ws = {"".join(rng.choice("abüz") for _ in range(rng.randint(1, 9))) for _ in range(300)}
    c = tokencount.TrieCounter(pieces)
    c.add(ws)
    assert c.counts == {w: by_hand(w, c) for w in ws}
    got = {r.doc_id: r for r in tokencount.count_tokens(table(spark)).collect()}
    assert len(got) == 72 and all(got[k].n_tokens == 0 for k in (60, 61, 62)) and got[64].n_pretokens == 30_000
    own = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(table(spark, [(1, "ab bab üb", "x", "s", 0, 0.0)]), vocabulary=pieces).collect()}
    assert own == {1: sum(by_hand(w, c) for w in ("ab", "bab", "üb"))}
    small = tokencount.TrieCounter(tokencount.load_vocabulary(), cache_words=5)
    one = [(r[0], small.batch([(r[1] or "").encode()])[1][0]) for r in documents()]
    assert all(got[k].n_tokens == n for k, n in one)


def test_interpolation(spark):
    rows = documents()
    docs = table(spark, rows)
    got = interpolation.score_texts(docs, remainder("doc_id", 7) != 2, remainder("doc_id", 7) == 3, block_tokens=500, rounds=4).collect()
    assert len(got) == len(rows)
    part = lambda k: None if k is None else zlib.crc32(str(k).encode()) % 7
    tokens = [(r[0], (r[1] or "").lower().split() + ["</end>"]) for r in rows]
    train = [t for k, t in tokens if part(k) is not None and part(k) != 2]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    base = Counter()
    want = sorted((k is None, k or 0, len(t), sum(count[w] > 0 for w in t), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)) for k, t in tokens)
    assert want == sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got)
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got) and not base
    # the model is a probability: over all next words of a context it sums to 1 (here: each training text scores above its base)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    whole = interpolation.score_texts(docs.repartition(3), remainder("doc_id", 7) != 2, remainder("doc_id", 7) == 3, rounds=4, bucket_tokens=9000).collect()
    pair = lambda rs: sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 6)) for r in rs)
    assert pair(whole) == pair(got)
    assert interpolation.score_texts(empty(spark), F.lit(True), F.lit(False)).count() == 0
    untrained = interpolation.score_texts(docs, F.lit(False), F.lit(False)).collect()
    assert all(r.score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in untrained)


def interpolation_by_hand(texts, kept, deleted, rounds):
    """Scores of the model, with plain counts and plain expectation-maximisation."""
    tokens = [(t or "").lower().split() + [None] for t in texts]  # None ends a text, "" starts one
    pairs = lambda t: list(zip(["", *t[:-1]], t))
    bucket = lambda c: c.bit_length()

    def counts(rows):
        word, pair = Counter(w for t in rows for w in t), Counter(p for t in rows for p in pairs(t))
        return word, pair, Counter({**{u: word[u] for u in word}, "": word[None]}), sum(word.values()), len(word)

    word, pair, ctx, n, v = counts([t for t, k in zip(tokens, kept) if k])
    held = [(bucket(ctx[u]), pair[u, w] / ctx[u] if ctx[u] else 0.0, word[w] / n, 1 / (v + 1)) for t, d in zip(tokens, deleted) if d for u, w in pairs(t)]
    weights = {b: [0.4, 0.4, 0.2] for b in {h[0] for h in held}}
    for _ in range(rounds):
        got = {b: [0.0] * 3 for b in weights}
        for b, *p in held:
            parts = [a * x for a, x in zip(weights[b], p)]
            for k in range(3):
                got[b][k] += parts[k] / sum(parts)
        weights = {b: [(x + 1e-3) / (sum(g) + 3e-3) for x in g] for b, g in got.items()}
    word, pair, ctx, n, v = counts([t for t, k, d in zip(tokens, kept, deleted) if k or d])

    def one(u, w):
        b = bucket(ctx[u])
        a = weights.get(b) or weights.get(max((x for x in weights if x < b), default=-1)) or [0.4, 0.4, 0.2]
        return (a[0] * pair[u, w] / ctx[u] + a[1] * word[w] / n if ctx[u] else (a[0] + a[1]) * word[w] / n) + a[2] / (v + 1)

    base = [sum(math.log10((word[w] + 1) / (n + v + 1)) for w in t) for t in tokens]
    return base, [sum(math.log10(one(u, w)) for u, w in pairs(t)) for t in tokens]


def test_interpolation_scores_by_hand(spark):
    rng = random.Random(31)
    texts = [words(rng, EN, rng.randint(1, 25)) for _ in range(60)] + ["", None, "unseen words only", "a \x00end \x00end \x00start b"]
    part = [k % 4 for k in range(len(texts))]  # 0, 1: kept; 2: deleted; 3: not learned from
    base, want = interpolation_by_hand(texts, [p < 2 for p in part], [p == 2 for p in part], 5)
    docs = spark.createDataFrame([(f"key{k}", t, p) for k, (t, p) in enumerate(zip(texts, part))], "doc_id string, text string, part int")
    for size in (50, 10**6):
        got = {r.doc_id: r for r in interpolation.score_texts(docs, F.col("part") < 3, F.col("part") == 2, rounds=5, block_tokens=size, bucket_tokens=size).collect()}
        assert [got[f"key{k}"].score for k in range(len(texts))] == pytest.approx(want, abs=1e-9)
        assert [got[f"key{k}"].base_score for k in range(len(texts))] == pytest.approx(base, abs=1e-9)


def test_words_may_hold_nul(spark):
    docs = spark.createDataFrame([(k, "one two \x00end \x00end") for k in range(8)], "doc_id bigint, text string")
    got = interpolation.score_texts(docs, F.lit(True), F.col("doc_id") == 1, rounds=2).collect()
    want = 3 * math.log10(9 / 45) + 2 * math.log10(17 / 45)  # N = 40, V = 4: one, two, the odd word (twice) and the end
    assert all(r.base_score == pytest.approx(want) and r.n_known == 5 for r in got)


def test_risk_of_positive_unlabelled_learning():
    rng = np.random.default_rng(0)
    x_p, neg = rng.normal(1.5, 1, (300, 2)), rng.normal(-1.5, 1, (1400, 2))
    x_u = np.concatenate([rng.normal(1.5, 1, (600, 2)), neg])
    m = nnpu.fit(x_p, x_u, 0.3, steps=300)
    assert (m.score(rng.normal(1.5, 1, (500, 2))) > 0.5).mean() > 0.9 and (m.score(rng.normal(-1.5, 1, (500, 2))) < 0.5).mean() > 0.9
    assert (nnpu.fit(np.zeros((0, 2)), x_u, 0.4).score(x_u) == 0.4).all()
    a, b = nnpu.risk(np.array([2.0]), np.array([-2.0]), 0.5)
    assert a == pytest.approx(0.5 * math.log1p(math.exp(-2))) and b == pytest.approx(math.log1p(math.exp(-2)) - 0.5 * math.log1p(math.exp(2)))


@pytest.mark.parametrize("hidden", [0, 2])
@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_fit_follows_the_numerical_gradient(hidden, prior):
    """The same few steps by plain Adam on differences of the risk; the larger prior makes the second part negative."""
    rng = np.random.default_rng(4)
    x_p, x_u = rng.normal(0.5, 1, (20, 3)), rng.normal(0, 1, (30, 3))
    got = nnpu.fit(x_p, x_u, prior, hidden=hidden, steps=4, rate=0.1, decay=0.01)
    mean, scale = x_u.mean(0), x_u.std(0)
    zp, zu = (x_p - mean) / scale, (x_u - mean) / scale
    rng = np.random.default_rng(7)
    d, w = 3, []
    if hidden:
        w, d = [rng.normal(0, 1 / np.sqrt(3), (3, hidden)), np.zeros(hidden)], hidden
    w += [rng.normal(0, 1 / np.sqrt(d), (d, 1)) if hidden else np.zeros((d, 1)), np.zeros(1)]

    def scores(x):
        return ((np.tanh(x @ w[0] + w[1]) if hidden else x) @ w[-2] + w[-1])[:, 0]

    def objective():
        first, second = nnpu.risk(scores(zp), scores(zu), prior)
        decay = 0.005 * sum((a**2).sum() for a in w if a.ndim == 2)
        return (first + second if sign > 0 else -second) + decay

    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, 5):
        sign = 1 if nnpu.risk(scores(zp), scores(zu), prior)[1] >= 0 else -1
        grads = [np.zeros_like(a) for a in w]
        for a, g in zip(w, grads):
            for i in np.ndindex(a.shape):
                kept = a[i]
                a[i] = kept + 1e-6
                up = objective()
                a[i] = kept - 1e-6
                g[i], a[i] = (up - objective()) / 2e-6, kept
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] -= 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    for a, b in zip(got.weights, w):
        np.testing.assert_allclose(a, b, atol=2e-5)


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("query,table_,label,least", [("op1_language_id", "documents", "lang", 0.97), ("op6_toxicity", "labels", "toxic", 0.93), ("op10_quality", "labels", "quality", 0.95)])
def test_held_out_accuracy_on_whole_tables(spark, query, table_, label, least):
    from pairlens.llm import queries

    got = queries.queries()[query](spark, SF)
    truth = spark.read.parquet(f"{SF}/{table_}.parquet").where(F.col(label).isNotNull()).select("doc_id", F.col(label).alias("truth")).distinct()
    rows = got.where("held_out").join(truth, "doc_id").collect()
    right = [r.lang_pred == r.truth if label == "lang" else r.predicted == r.truth for r in rows if label != "lang" or r.lang_pred != "und"]
    assert len(right) > 50 and sum(right) >= least * len(right)


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_long_texts_are_read_whole(spark, operator):
    label = "quality" if operator is quality else "toxic"
    rng = random.Random(16)
    mark = " ".join(["###", "@@@", "%%%"] * 30_000) if operator is quality else "vile nasty"
    rows = [(k, words(rng, EN, 40) + (" " + ("vile" if operator is toxicity else "### @@@ %%% " * 20) if k % 4 == 0 else ""), "en", "s", 0, 0.0) for k in range(400)]
    flag = lambda bad: int(bad == (operator is toxicity))
    labels = spark.createDataFrame([(k, flag(k % 4 == 0)) for k in range(400)], f"doc_id bigint, {label} int")
    long = words(rng, EN, 60_000)
    docs = table(spark, rows + [(1000, long, "en", "s", 0, 0.0), (1001, long + " " + mark, "en", "s", 0, 0.0)])
    model = operator.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in operator.predict(docs, model).collect()}
    assert (got[1001] > got[1000]) == (operator is toxicity)


@pytest.mark.parametrize("operator,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, operator, label):
    rng = random.Random(6)
    rows = []
    for k in range(600):
        w = words(rng, EN, rng.randint(30, 80)).split()
        bad = k % 4 == 0
        if bad and label == "quality":
            w = [x + "###" for x in w]
        if bad and label == "toxic":
            w[5] = rng.choice(["vile!", "Rotten", "nasty,"])
        rows.append((k, " ".join(w), "en", "s", 0, 0.0))
    good = lambda k: int((k % 4 == 0) == (label == "toxic"))
    labels = spark.createDataFrame([(k, good(k)) for k in range(600) if k % 8 < 4] + [(0, good(0)), (None, 1), (7, None)], f"doc_id bigint, {label} int")
    extra = [(1000, None, "en", "s", 0, 0.0), (1001, "", "en", "s", 0, 0.0), (None, "a b", "en", "s", 0, 0.0)]
    docs = table(spark, rows + extra)
    model = operator.fit(docs, labels, remainder("doc_id", 3) != 1)
    got = {r.doc_id: r for r in operator.predict(docs, model).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[1000].score == got[1001].score
    assert sum(got[k].predicted == good(k) for k in range(600)) > 570
    assert operator.predict(empty(spark), model).count() == 0
    blank = operator.fit(docs, labels.limit(0), remainder("doc_id", 3) != 1)
    assert {r.score for r in operator.predict(docs, blank).collect()} == {0.0}
    if label == "quality":
        kept = quality.keep_good(docs, model)
        assert kept.columns == docs.columns and kept.where("doc_id < 600 and doc_id % 4 = 0").count() < 15


def test_the_prior_is_found_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(8)
    draw = lambda n, shift: rng.normal(0, 1, (n, 3)) + shift
    for prior in (0.2, 0.5, 0.85):
        n = rng.binomial(4000, prior)
        got = nnpu.class_prior(draw(1500, 1.5), np.concatenate([draw(n, 1.5), draw(4000 - n, -1.5)])[rng.permutation(4000)])
        assert got == pytest.approx(prior, abs=0.06)
    assert nnpu.class_prior(draw(3, 0), draw(100, 0)) == 0.5


@pytest.mark.parametrize("operator,label", [(quality, "quality"), (toxicity, "toxic")])
def test_samples_are_bounded_in_rows(spark, operator, label):
    """One key in 100,000 rows gives one text to the fit, and the fit does not depend on their order."""
    hot = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("of the and "), F.col("id") % 3000).alias("text"))
    docs = hot.union(spark.createDataFrame([(k, f"the {'vile' if k % 2 else 'of and'} to {k}") for k in range(100)], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], f"doc_id bigint, {label} int")
    rows, _ = quality.training_rows(docs, labels, F.lit(True), label, "doc_id", 40, 80)
    taken = [quality.sample_texts(d, rows, "doc_id", "text").collect() for d in (docs, docs.repartition(7))]
    assert sorted(map(tuple, taken[0])) == sorted(map(tuple, taken[1])) and len(taken[0]) == 30 + 80 and len({(r.k, r.p) for r in taken[0]}) == 110
    operator.fit(docs, labels, F.lit(True), max_positive=40, max_unlabelled=80)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_toxic_documents_are_found(spark):
    """Recall, false alarms and ranking on held-out rows; in a small table words of few rows are told from chance, and still scores differ."""
    from pairlens.llm import queries

    small = queries.queries()["op6_toxicity"](spark, "/root/testdata/sf0.001")
    assert small.select("score").distinct().count() > 1
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = queries.queries()["op6_toxicity"](spark, sf).where("held_out").join(truth, "doc_id").toPandas()
    toxic = rows.toxic == 1
    assert (rows.predicted[toxic] == 1).mean() >= 0.9 and (rows.predicted[~toxic] == 1).mean() < 0.02
    ranks = rows.score.rank()
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.95
