"""Filter interaction audit and near-duplicate vectors, against plain loops."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F


def plain_audit(docs, labels):
    """The contract read literally: every order runs over the documents."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * (i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in docs))
        rows.append((lang or "", i, set(fails)))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                lost = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                shapley[part, f] += len(lost)
                unique = sum(r[2] == {f} for r in rows if r[0] == part)
                out[part, order, step] = [len(left), len(lost), sum(f in r[2] for r in gone), unique, sum(r[1] in good for r in lost), sum(r[1] in toxic for r in lost)]
                gone += lost
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_counts_every_order(spark):
    from orthant.llm import filter_audit

    rng = np.random.default_rng(5)
    varied = [" ".join(f"w{k}x{j}" for j in range(120)) for k in range(6)]
    texts = [None, "", "A", "UPPER CASE $", varied[0], varied[0], varied[0] + " #", varied[1], "a b " * 90, "é " * 60 + "É", " \t\n", "a b " * 100, *varied[2:], "x " * 40_000 + "|"]
    docs = [(int(i), texts[int(rng.integers(len(texts)))], [None, "", "en", "fr"][int(rng.integers(4))]) for i in rng.permutation(160)]
    docs += [(7, varied[5], "en"), (7, varied[5], "en"), (None, varied[0], "en"), (None, None, None), (-3, "", "only one")]
    labels = [(int(i), int(rng.integers(2)), [0, 1, None][int(rng.integers(3))]) for i in rng.integers(0, 160, 90)] + [(None, 1, 1), (7, None, 1), (99_999, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    for name in ("n", "part", "digest", "words", "A", "first_id", "good"):  # columns that the operator makes itself
        frame = frame.withColumn(name, F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1)).withColumn("text", F.lit("y"))
    got = filter_audit.query(frame, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert dict(got.dtypes)["step"] == "int" and dict(got.dtypes)["kept"] == "bigint"
    rows = [tuple(r) for r in got.collect()]
    want = plain_audit(docs, labels)
    assert len(rows) == len(want) == 4 * 600
    assert {r[:3]: r[3:] for r in rows} == want
    assert filter_audit.query(frame.limit(0), marks).collect() == []
    none = filter_audit.query(frame, marks.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()
    assert none[0] == 0


def test_interactions_of_other_filters(spark):
    from orthant.llm import filter_audit

    profile = spark.createDataFrame([("p", True, False, 3), ("p", True, True, 4), ("p", False, False, 5)], "part string, X boolean, Y boolean, n long")
    got = {(r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.interactions(profile, "XY").collect()}
    assert got == {("XY", 1): (5, 7, 0, 3, 7 + 3), ("XY", 2): (5, 0, 4, 0, 4), ("YX", 1): (8, 4, 0, 0, 4), ("YX", 2): (5, 3, 4, 3, 10)}


def plain_links(rows, cosine=0.95):
    """(vec_id, links, component) of each row by its place."""
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float) / max(abs(x) for x in v)
        return v / np.sqrt((v * v).sum())

    units = [unit(v) for _, v in rows]
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and (units[i] * units[j]).sum() >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    own = {}
    for i in range(n):
        own.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in own.items()}
    return sorted(((rows[i][0], links[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(n)), key=repr)


def clustered(rng, groups, noise, dimensions=24, loose=40):
    rows = []
    for size in groups:
        centre = rng.standard_normal(dimensions)
        for _ in range(size):
            rows.append((centre + noise * rng.standard_normal(dimensions)) * rng.uniform(0.5, 2))
    rows += list(rng.standard_normal((loose, dimensions)))
    return [[float(x) for x in v] for v in rows]


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("label", F.lit(1)).withColumn("node", F.lit("x")).withColumn("k1", F.lit(2)).withColumn("n", F.lit(3))


def test_vectors_of_every_kind(spark):
    from orthant.llm import embed_dedup

    rng = np.random.default_rng(3)
    rows = list(enumerate(clustered(rng, [2, 3, 30, 5], 0.12)))
    rows = [(i * 3, v) for i, v in rows]
    v = rows[0][1]
    rows += [(1, v), (1, v), (2, [x * 1e200 for x in v]), (4, [x * 1e-200 for x in v]), (None, v), (None, [-x for x in v]), (None, [-x for x in v])]
    rows += [(5, None), (7, None), (8, []), (10, [0.0] * 24), (11, [None] + v[1:]), (13, [float("nan")] + v[1:]), (14, [float("inf")] + v[1:]), (16, [-0.0] * 24)]
    rows += [(17, [1.0, 0.0]), (19, [1.0, -0.0]), (20, [1.0, 0.3]), (22, [1.0, 0.4]), (23, [3.0]), (25, [0.5]), (26, [-1.0])]
    got = embed_dedup.query(vectors(spark, rows))
    assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    # A row without a vec_id is kept where its component has none either.
    want = sorted(plain_links(rows), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert embed_dedup.query(vectors(spark, rows).limit(0)).collect() == []
    assert [tuple(r) for r in embed_dedup.query(vectors(spark, [(9, None)])).collect()] == [(9, 0, 9, True)]


def test_vectors_in_blocks_and_finer_trees(spark):
    from orthant.llm import embed_dedup

    rng = np.random.default_rng(8)
    rows = list(enumerate(clustered(rng, [150, 60, 2, 2, 2, 9], 0.1, loose=300)))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows] + [(1000 + i, [float(np.float32(x)) for x in rows[0][1]]) for i in range(200)]
    want = plain_links(rows)
    # Blocks of 16 rows, a first forest from 60 rows, and leaves split again by trees of their own.
    small = embed_dedup.linked_vectors(vectors(spark, rows, "float"), block_rows=16, sample=60, leaf_rows=4, leaf_sample=8, fit_rows=64)
    assert sorted((tuple(r) for r in small.collect()), key=repr) == want
    whole = embed_dedup.linked_vectors(vectors(spark, rows, "float"))
    assert sorted((tuple(r) for r in whole.collect()), key=repr) == want


def test_forest_finds_pairs_at_the_least_cosine():
    from orthant.llm.embed_dedup import SpillForest, calibrated

    rng = np.random.default_rng(1)
    unit = rng.standard_normal((4000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    forest = calibrated(unit, 0.95, 8, 64, 0, 0.995, 2)
    assert forest.recall(unit, 0.95, 0, seed=99) >= 0.99
    assert np.mean([len(c) for c in forest.codes(unit[:500])]) < 60  # of leaves 8 would be without overlap
    # One tight group of rows stays together instead of going to both sides of every plane.
    tight = unit[0] + 1e-3 * rng.standard_normal((2000, 64))
    both = np.concatenate((unit[:2000], tight / np.linalg.norm(tight, axis=1, keepdims=True)))
    codes = SpillForest.fit(both, 8, forest.margin, 64, 2).codes(both)
    assert np.mean([len(c) for c in codes[2000:]]) < 60
