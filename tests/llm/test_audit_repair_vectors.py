"""Operators 11 to 13 against brute force and SQL, and their defined cases."""

import itertools
import os
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from data import empty, table
from pyspark.sql import functions as F

from pairlens.llm import convrepair, filteraudit, vectordedup
from pairlens.llm import queries as q

SF = "/root/testdata/sf0.001"


def against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(q.oracle_sql()[name])
    order = [x[0] for x in cur.description]
    names = sorted(order)
    want = sorted((tuple(r[order.index(c)] for c in names) for r in cur.fetchall()), key=str)
    df = q.queries()[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == want and want


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_conversation_repair"])
def test_whole_tables_equal_sql(spark, name):
    against_sql(spark, name)


# 11


def plain_audit(docs, labels):
    """{(part, order, step): (kept, removed, redundant, sole, good, toxic)} document by document."""
    first = {}
    for r in docs:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            first[t] = min(first.get(t, r["doc_id"]), r["doc_id"])
    mark = lambda k, c: any(m["doc_id"] == k and m[c] == 1 for m in labels) and k is not None
    out, parts = {}, {r["lang"] or "" for r in docs}
    for part, order, step in itertools.product(parts, itertools.permutations("ABCDE"), range(5)):
        out[part, "".join(order), step + 1] = [0] * 6
    for r in docs:
        t, k = r["text"] or "", r["doc_id"]
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": k is not None and first[t] < k}
        good, toxic = mark(k, "quality"), mark(k, "toxic")
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order):
                row = out[r["lang"] or "", "".join(order), step + 1]
                removed = fails[f] and not gone
                row[0] += not fails[f] and not gone
                row[1] += removed
                row[2] += fails[f] and gone
                row[3] += fails[f] and sum(fails.values()) == 1
                row[4] += removed and good
                row[5] += removed and toxic
                gone |= fails[f]
    return out


def test_audit_equals_document_by_document(spark):
    docs = table(spark).withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("lang")))
    more = [(900, "UPPER CASE $ " * 250, "en", "s", 1, 0.0), (901, "É b  x" * 300, None, None, 1, 0.0), (901, "É b  x" * 300, "", None, 1, 0.0), (-5, "UPPER CASE $ " * 250, "xx", "s", 1, 0.0), (None, "a row without a key", "en", "s", 1, 0.0)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    labels = spark.createDataFrame([(k, int(k % 2 == 0) if k % 5 else None, int(k % 3 == 0), 7.0) for k in range(40)] + [(2, 0, 1, 7.0), (None, 1, 1, 7.0), (900, 1, 1, 7.0)], "doc_id bigint, quality int, toxic int, part double")
    got = filteraudit.audit(docs, labels).collect()
    want = plain_audit([r.asDict() for r in docs.collect()], [r.asDict() for r in labels.collect()])
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] for r in got} == want
    for r in got:
        assert r.filter == r.filter_order[r.step - 1]
        assert r.shapley == sum(v[1] for (part, order, step), v in want.items() if part == r.part and order[step - 1] == r.filter)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filteraudit.audit(empty(spark), labels).count() == 0
    got = filteraudit.audit(table(spark, [[None, None, None, None, None, None]]), labels).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and all(r.removed == (r.step == r.filter_order.index("A") + 1) for r in got if r.filter == "A")


def test_wide_integers_do_not_overflow():
    most = (1 << filteraudit.WIDTH) - 1
    f = filteraudit.unpack(most * filteraudit.wide(31, True, True))
    assert f[filteraudit.TOTAL] == most and set(f.tolist()) == {0, most}
    total = sum(k * filteraudit.wide(m, g, t) for k, (m, g, t) in enumerate(itertools.product(range(32), (False, True), (False, True)), 10**12))
    assert filteraudit.unpack(total)[filteraudit.TOTAL] == sum(range(10**12, 10**12 + 128))
    with pytest.raises(OverflowError):
        filteraudit.unpack((most << filteraudit.WIDTH) | 0)


# 12


def cheapest(kinds):
    """Least (cost, audit) by Dijkstra over (rows read, last role), edit after edit."""
    import heapq

    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, audit, at, last = heapq.heappop(queue)
        if at == len(kinds) and last in ("", "a"):
            return cost, audit
        if (at, last) in done:
            continue
        done.add((at, last))
        turn = "a" if last == "u" else "u"
        heapq.heappush(queue, (cost + 5, audit + "I", at, turn))
        if at < len(kinds):
            k = kinds[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, last))
            if k != "-":
                stays = 5 * k.isupper()
                heapq.heappush(queue, (cost + 1 + stays, audit + "R", at + 1, turn))
                if k.lower() == turn or k.lower() == "s" and last == "":
                    heapq.heappush(queue, (cost + stays, audit + "K", at + 1, k.lower()))


def test_charts_are_the_cheapest_repairs():
    rng = random.Random(5)
    for n in list(range(8)) * 25 + [17, 33, 70]:
        kinds = "".join(rng.choice("uaaussoUASO-") for _ in range(n))
        assert convrepair.best(convrepair.parse(kinds)) == cheapest(kinds), kinds
        # any one split gives what all splits give
        if n > 1:
            cell = {}
            k = rng.randint(1, n - 1)
            convrepair.into(cell, convrepair.parse(kinds[:k]), convrepair.parse(kinds[k:]))
            assert convrepair.closed(cell) == convrepair.parse(kinds)


def plain_repair(rows):
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of damaged rows (conv, turn, role, text, copies), conversation by conversation."""
    out, convs = [], {}
    for conv, turn, role, text, copies in rows:
        convs.setdefault(conv, []).extend([(turn is not None, turn or 0, role, text)] * copies)
    for conv, own in convs.items():
        own.sort()
        seen, faults, kinds = set(), [], ""
        for _, _, role, text in own:
            kept = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            initial = role[0] if role and role[0] in "usa" else "o"
            kinds += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = cheapest(kinds)
        made, at = [], 0
        for edit in audit:
            other = "assistant" if made and made[-1][0][0] == "u" else "user"
            if edit == "I":
                made.append((other, ""))
                continue
            _, _, role, text = own[at]
            at += 1
            if edit != "D":
                made.append((role if edit == "K" else other, text))
        turns = [t for known, t, _, _ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()))
    return out


CONV = "conv bigint, turn bigint, role string, text string, copies int"


def conversations(seed=1, n=40, longest=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \t", "é ü.", "end. ", "x" * 400 + ".", "a\nb."]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "", "tool", "User", " "]), rng.choice(texts), rng.choice([0, 1, 1, 1, 2])) for c in range(n) for _ in range(rng.randint(1, longest))]
    return rows + [(None, 1, "user", "Hm.", 1), (None, None, "assistant", "Hm.", 1), (n, 3, "user", "gone", 0)] + rows[:9]


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_repairs_equal_row_by_row(spark, partitions):
    rows = conversations() + [(77, t, ("user", "assistant")[t % 2] if t % 11 else "system", f"turn {t % 190}" + "." * (t % 7 > 0), 1) for t in range(400)]
    before, adaptive = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = convrepair.repair_rows(spark.createDataFrame(rows, CONV)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert sorted(map(tuple, got), key=str) == sorted(plain_repair(rows), key=str)


def test_damage(spark):
    rows = [(c, t, "assistant", f"{t}. a! b? c") for c in range(12) for t in range(9)] + [(3, None, None, None), (None, 4, "user", "x.")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, copies string")
    got = {(r.conv, r.turn): (r.role, r.text, r.copies) for r in convrepair.damaged(df).collect()}
    for c, t, role, text in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if hit == 1 else text.translate(str.maketrans("", "", ".!?")) if hit == 2 else text
        assert got[c, t] == ("user" if hit == 4 else role, text, {0: 0, 3: 2}.get(hit, 1))
    out = convrepair.repair(df)
    assert out.columns == ["conv_id", *convrepair.RESULT] and out.count() == 13
    assert convrepair.repair(df.where("false")).count() == 0


# 13


def plain_links(rows, least=0.93):
    """{place: (n_links, component)} of rows (vec_id, vector, label), pair by pair."""
    sound = [i for i, (k, v, label) in enumerate(rows) if k is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: [] for i in range(len(rows))}
    for i, j in itertools.combinations(sound, 2):
        (_, v, a), (_, w, b) = rows[i], rows[j]
        if a == b and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= least:
            links[i].append(j)
            links[j].append(i)
    out = {}
    for i in links:
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        out[i] = (len(links[i]), min((rows[j][0] for j in seen), default=None) if len(seen) > 1 else rows[i][0])
    return out


def vectors(seed=0, n=150, d=24):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        base = rng.normal(size=d)
        rows.append([k, base.tolist(), int(k % 3)])
        if k % 4 == 0:  # a chain of near copies, some below the threshold
            for s in range(rng.integers(1, 5)):
                base = base + rng.normal(scale=0.28, size=d)
                rows.append([1000 + 10 * k + s, base.tolist(), int(k % 3)])
    crowd = rng.normal(size=d)
    rows += [[5000 + k, (crowd + rng.normal(scale=0.05, size=d)).tolist(), 2] for k in range(60)]
    rows += [[6000 + k, rows[0][1], 0] for k in range(5)] + [[6100, rows[0][1], 1], [6101, rows[0][1], None], list(rows[3]), [3, rows[7][1], 0]]
    odd = rows[0][1]
    rows += [[7000, None, 0], [7001, [], 0], [7002, [0.0] * d, 0], [7003, [None, *odd[1:]], 0], [7004, [float("nan"), *odd[1:]], 0], [7005, [float("inf"), *odd[1:]], 0], [7006, odd[:5], 0], [7007, [2 * x for x in odd[:5]], 0], [None, odd, 0], [None, None, None]]
    rows += [[7010, [-0.0, 1.0], 0], [7011, [0.0, 1.0], 0], [7012, [0.0, -1.0], 0]]
    return rows


@pytest.mark.parametrize("tile_rows", [4096, 16])
def test_vector_links_are_those_of_all_pairs(spark, tile_rows):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id bigint, embedding array<double>, label int, n double")
    got = vectordedup.near_duplicates(df, tile_rows=tile_rows)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = [(rows[i][0], n, c, c is not None and rows[i][0] == c) for i, (n, c) in plain_links(rows).items()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert max(w[1] for w in want) >= 59


def test_vectors_of_nothing_and_sparse_survivors(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert vectordedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in vectordedup.near_duplicates(spark.createDataFrame([(1, None, 1)], schema)).collect()] == [(1, 0, 1, True)]
    # stops by suffix norms drop no pair, dense blocks or not
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 40)) * np.geomspace(3, 0.1, 40)
    x[200:] = x[:100] + rng.normal(scale=0.2, size=(100, 40))
    z, n = vectordedup.unit(x), np.linalg.norm(x, axis=1)
    want = {(i, j) for i, j in zip(*np.nonzero((x @ x.T) / (n[:, None] * n) >= 0.93), strict=True) if i < j}
    for dense in (0.1, 2.0):
        vectordedup.DENSE, before = dense, vectordedup.DENSE
        got = {(int(i), int(j)) for a, b in vectordedup.close_pairs(x, x, z, z, 0.93, True) for i, j in zip(a, b, strict=True)}
        vectordedup.DENSE = before
        assert got == want and want
