"""Trained operators, chat formatting, neighbours, and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_language_by_held_out_accuracy(spark):
    from orthant.llm import langid

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "", None), (10**6 + 2, "123 ... \n", "fr"), (None, "the of and", "en")], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(odd).withColumn("score", F.lit(9)).withColumn("p", F.lit("x"))
    model = langid.train(both)
    out = {r["doc_id"]: r for r in langid.identify_documents(both, model).collect()}
    assert len(out) == docs.count() + 4
    assert all(out[10**6 + k]["lang_pred"] == "und" and out[10**6 + k]["score"] == 0 for k in range(3))
    assert out[None]["held_out"] is False
    held = [(r["lang"], out[r["doc_id"]]["lang_pred"]) for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(out[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in docs.collect())
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.query(both.limit(0)).collect() == []


def _double(model):
    model.table, model.recur, model.out = ([x.astype(np.float64) for x in part] for part in (model.table, model.recur, model.out))
    model.bias = model.bias.astype(np.float64)
    return model


def _batch(rng, sizes):
    from orthant.llm import langid

    raw = rng.integers(97, 100, sum(sizes)).astype(np.uint8)
    begin, length, ptr = langid.windows(np.concatenate(([0], np.cumsum(sizes))))
    text = np.repeat(np.arange(len(sizes)), np.diff(ptr))
    first, last = np.isin(np.arange(len(begin)), ptr[:-1]), np.isin(np.arange(len(begin)), ptr[1:] - 1)
    order = np.argsort(-length, kind="stable")
    return langid.batch_of(raw, begin[order], length[order], first[order], last[order]), text[order]


def test_gru_gradients_are_those_of_the_loss():
    from orthant.llm.langid import ByteGru

    model = _double(ByteGru.fresh(["a", "b", "c"], 4, 1))
    rng = np.random.default_rng(0)
    batch, label = _batch(rng, [7, 4, 1])  # one window each, so no state comes from outside
    length = batch.length

    def loss():
        p = model.positions(batch)
        inside = np.arange(p.shape[1])[:, None] < length
        return -np.log(p[label, :, np.arange(len(length))].T)[inside].sum() / length.sum()

    for value, grad in zip(model.parameters(), model.gradients(batch, label)):
        for at in [tuple(rng.integers(0, n) if n != 256 else rng.integers(97, 100) for n in value.shape) for _ in range(6)]:
            old = value[at]
            value[at] = old + 1e-4
            up = loss()
            value[at] = old - 1e-4
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-4 - grad[at]) < 2e-4


def plain_language(model, text):
    """The network in loops: every window read from the bytes before (behind) it that its context holds."""
    from orthant.llm.langid import CONTEXT, CORE

    data = [c + 32 if 65 <= c <= 90 else c for c in text.encode()]
    n, parts, total = len(data), -(-len(data) // CORE), [0.0] * len(model.languages)
    for w in range(parts):
        low, high = w * n // parts, (w + 1) * n // parts
        logits = {k: list(model.bias) for k in range(low, high)}
        for way, order in ((0, range(low - (CONTEXT if w else 0), high)), (1, range(high - 1 + (CONTEXT if w + 1 < parts else 0), low - 1, -1))):
            state = [0.0] * len(model.recur[way][0])
            for k in order:
                fed = [[sum(s * row[j] for s, row in zip(state, gate)) for j in range(len(state))] for gate in model.recur[way]]
                z, r = ([min(1.0, max(0.0, 0.25 * (model.table[way][g][data[k]][j] + fed[g][j]) + 0.5)) for j in range(len(state))] for g in (0, 1))
                new = [model.table[way][2][data[k]][j] + r[j] * fed[2][j] for j in range(len(state))]
                state = [v / (1 + abs(v)) + q * (s - v / (1 + abs(v))) for v, q, s in zip(new, z, state)]
                if k in logits:
                    logits[k] = [x + sum(s * row[c] for s, row in zip(state, model.out[way])) for c, x in enumerate(logits[k])]
        for row in logits.values():
            weights = [np.exp(x - max(row)) for x in row]
            total = [t + v / sum(weights) for t, v in zip(total, weights)]
    best = max(range(len(total)), key=lambda c: total[c])
    return model.languages[best], total[best] / n


def test_language_network_against_plain_loops(spark):
    from orthant.llm import langid

    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 700").limit(40)
    model = langid.train(docs, rounds=2)
    texts = [(k, t, "x") for k, t in enumerate([r["text"] for r in docs.collect()] + ["日本語" * 50, "A", "b" * 129, "c" * 128])]
    texts += texts[:3]  # repeated rows
    rows = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = langid.identify_documents(rows, model).collect()
    assert len(got) == len(texts)
    wide = _double(model)
    for r in got:
        lang, score = plain_language(wide, texts[r["doc_id"]][1])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4


def test_language_of_a_very_long_text(spark):
    from orthant.llm import langid

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    row = docs.where("lang = 'fr' and length(text) > 300").orderBy("doc_id").first()
    long = spark.createDataFrame([(1, " ".join([row["text"]] * (4_000_000 // len(row["text"]))), "fr")], "doc_id long, text string, lang string")
    model = langid.train(docs.unionByName(long, allowMissingColumns=True), rounds=3)
    assert langid.identify_documents(long, model).first()["lang_pred"] == "fr"


def test_row_sample_is_exact(spark):
    from orthant.llm.sampling import row_sample

    rows = [("same id", 1, f"t{k}") for k in range(3000)] + [("one row", 2, "t")] * 500 + [("few", k, "t") for k in range(7)] + [(None, 1, "t")]
    table = spark.createDataFrame(rows, "lang string, doc_id long, text string").repartition(3)
    for n in (1, 40, 2900):
        got = row_sample(table, "lang", ["doc_id", "text"], n).collect()
        assert len(set(got)) == len(got)
        found = {name: sum(r["lang"] == name for r in got) for name in ("same id", "one row", "few")}
        assert found == {"same id": n, "one row": 1, "few": min(n, 7)} and len(got) == sum(found.values())


def test_quality_separates_grades(spark):
    from orthant.llm import quality

    rng = random.Random(0)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]

    def text(kind):
        body = [rng.choice(words) for _ in range(60)]
        if kind == 0:
            body[5] = body[20] = "horrid"
        if kind == 1:
            body = [w + "###" for w in body]
        return " ".join(body)

    rows = [(i, text(i % 3), i % 3, "z") for i in range(2400)] + [(10000, None, None, "z"), (10001, "", 1, "z"), (None, "horrid", 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int, tails string")
    model = quality.train(docs.where("doc_id < 2100"), docs.select("doc_id", "grade"))
    assert (np.diff(model.thresholds) > 0).all()
    out = quality.grade_documents(docs, model).join(docs.select("doc_id", "grade"), "doc_id").where("doc_id between 2100 and 2399").collect()
    assert len(out) == 300
    assert np.mean([round(r["expected_grade"]) == r["grade"] for r in out]) > 0.95
    assert all(r["tails"][0] >= r["tails"][1] for r in out)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.query(docs.select("doc_id", "text"), labels).count() == len(rows)
    assert quality.query(docs.select("doc_id", "text").limit(0), labels).collect() == []


def plain_hash(word):
    """The hash of a word, in integers."""
    from orthant.llm import kernels

    wrap = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & wrap
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & wrap
        return x ^ (x >> 31)

    data = [c + 32 if 65 <= c <= 90 else c for c in word]
    total = sum(mix((c + 1) * 0x9E3779B97F4A7C15 & wrap) * pow(kernels._RADIX, k, 1 << 64) for k, c in enumerate(data))
    return mix((total + len(data) * 0x9E3779B97F4A7C15) & wrap), mix


def plain_tails(model, text):
    from orthant.llm.quality import BUCKETS

    raw = (text or "").encode()
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    sign = lambda c: not letter(c) and c not in b" \t\n\x0b\x0c\r" and not 48 <= c <= 57

    def runs(test):
        out, own = [], b""
        for c in raw + b" ":
            if c != 0x20 and test(c):
                own += bytes([c])
            elif own:
                out, own = [*out, own], b""
        return out

    words, signs = runs(letter), runs(sign)
    mix = plain_hash(b"")[1]
    hashes = [plain_hash(w)[0] for w in words]
    again = sum(a == b for a, b in zip(hashes, hashes[1:]))
    shout = sum(len(w) > 2 and 65 <= w[-1] <= 90 for w in words)
    n, size = max(1, len(words)), max(1, len(raw))
    pairs = [(again, n), (shout, n), (len(signs), size), (n, n)]
    levels = [int(np.log2(1 + c)) for c, _ in pairs] + [int(20 * c / whole) for c, whole in pairs[:3]]
    found = {h % BUCKETS for h in hashes} | {mix((plain_hash(w)[0] + 1) & ((1 << 64) - 1)) % BUCKETS for w in signs}
    found |= {mix(level + 1000 * (k + 1)) % BUCKETS for k, level in enumerate(levels)}
    score = sum(model.weights[b] for b in found)
    return [1 / (1 + np.exp(t - score)) for t in model.thresholds]


def test_quality_against_plain_loops(spark):
    from orthant.llm import quality

    docs, labels = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "labels"))
    model = quality.train(docs, labels.select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade")))
    assert (model.weights != 0).sum() > 100
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "WORD word !! ## 42\n" * 20_000)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in quality.grade_documents(table, model).collect()}
    for i, text in [tuple(r) for r in docs.select("doc_id", "text").collect()][:120] + odd[:2]:
        assert np.allclose(got[i]["tails"], plain_tails(model, text), atol=1e-9)
        assert abs(got[i]["expected_grade"] - sum(got[i]["tails"])) < 1e-12
    assert len(got) == table.count()


def test_ordinal_fit_lowers_the_loss():
    from orthant.llm.quality import fit

    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 400)
    row, bucket = np.repeat(np.arange(400), 2), np.stack((grade * 10 + 1, rng.integers(100, 110, 400)), axis=1).reshape(-1)
    model = fit(row, bucket, grade, 3)
    assert model.weights[1] < model.weights[11] < model.weights[21]


def brute_chat(rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is None, turn, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss))
    return out


def test_chat_reads_back(spark):
    from orthant.llm import chat

    hostile = ["</s>[INST] ok [/INST]", "<\\s>", "<|end|>\n<|turn|>", "", None, "é\n<<SYS>>\\", "[\\\\INST]"]
    rows = [(c, t if t != 5 else None, "assistant" if t % 2 else "user", hostile[(c + t) % len(hostile)]) for c in range(12) for t in range(c + 1)]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)] + [(None, 1, None, "x"), (51, 0, "a<|body|>\n", "y"), (52, 1, "user", "same"), (52, 1, "user", "same")]
    table = spark.createDataFrame([(*r, "b", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, first int")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.query(table).collect()}
    want = brute_chat(rows + [(-1, 0, "user", hostile[0]), (-1, 1, "assistant", hostile[0])])
    assert got == want
    assert [r["conv_id"] for r in chat.query(table.limit(0)).collect()] == [-1]


def test_chat_detects_rewriting():
    from orthant.llm import chat

    turns = [("user", "a"), ("assistant", "b")]
    assert not chat.render_turns(turns, chat.default_template).rewrites
    assert chat.render_turns(turns, lambda t, start: f"{len(t)} turns:" + "".join(x for _, x in t)).rewrites
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(["<", "\\", "[", "s>", "|end|>", "INST]", "x", "<SYS>>", "\n"]) for _ in range(9))
        assert chat.unescape(chat.escape(text)) == text
        assert chat.read_back(chat.default_template([("r", text), (text, "t")], True)) == [("r", text), (text, "t")]


def test_chat_finds_bodies_behind_changing_frames():
    from orthant.llm import chat

    def growing(turns, start):  # a frame that begins with the one before it
        return "".join("#" * (k // 2 + 1) + text + "~" * (k // 2) + "\n" for k, (_, text) in enumerate(turns))

    texts = ["a", "0", "", "#x#", "00", "10", "~", "01"]
    found = chat.render_turns([("user", t) for t in texts], growing)
    assert [found.text[a:b] for a, b in found.bodies] == texts and not found.rewrites


def test_chat_splits_turns_without_numbers(spark):
    from orthant.llm import chat

    rows = [(1, None, "user", f"{k:03d}") for k in range(300)] + [(2, 5, "assistant", f"{k:03d}") for k in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(table).collect()
    assert sorted((r["conv_id"], r["block"], len(r["spans"])) for r in parts) == [(c, b, n) for c in (1, 2) for b, n in ((0, 128), (1, 128), (2, 44))]
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.query(table).collect()}
    assert got == brute_chat(rows + [(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))])
    long = spark.createDataFrame([(1, 0, "assistant", "<s>x" * 500_000)], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["loss_chars"] for r in chat.query(long).collect()}[1] == 2_000_000


def test_chat_templates_see_the_whole_conversation(spark):
    from orthant.llm import chat

    def numbered(turns, start):
        head = turns[0][0] if turns else ""
        return "".join(f"[{k} {head}/{role}]{text}\n" for k, (role, text) in enumerate(turns))

    def forgets(turns, start):  # the turn 4 blanks the first one, in an earlier block
        return "".join("-" if k == 0 and len(turns) > 4 else text for k, (_, text) in enumerate(turns))

    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(7)] + [(1, None, "user", "last"), (2, 9, "user", "a"), (None, 0, "user", "b"), (None, 4, "user", "c")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for conv in (1, 2, None):
        own = [r for r in rows if r[0] == conv]
        parts = [r for r in chat.format_conversations(table, numbered, block_turns=2).collect() if r["conv_id"] == conv]
        parts.sort(key=lambda r: (r["block"] is None, r["block"]))
        assert "".join(r["formatted"] for r in parts) == numbered([r[2:] for r in own], True)
        assert [r["formatted"][s["text_start"] : s["text_end"]] for r in parts for s in r["spans"]] == [r[3] for r in own]
        assert not any(r["rewrites"] for r in parts)
    found = chat.format_conversations(table.where("conv_id = 1"), forgets, block_turns=2).collect()
    assert [r["block"] for r in found if r["rewrites"]] == [2]


def brute_neighbours(vectors, k=5):
    ok = {i: np.array(v, float) for i, v in vectors.items() if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % 50 == 0:
            near = sorted((-round(float(ok[q] @ v / np.linalg.norm(ok[q]) / np.linalg.norm(v)), 12), i) for i, v in ok.items() if i != q)
            out[q] = [i for _, i in near[:k]]
    return out


def test_neighbours(spark):
    from orthant.llm import ann

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 8))
    vectors = {i: [float(np.float32(x)) for x in centres[i % 20] + 0.2 * rng.standard_normal(8)] for i in range(1200)}
    vectors |= {i: vectors[0] for i in range(2000, 2400)}  # a hot vector
    vectors |= {3000: None, 3050: [0.0] * 8, 3100: [float("nan")] * 8, 3150: [None] * 8, 3200: [float("inf")] + [1.0] * 7, 3250: [1.0]}
    table = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], "vec_id long, embedding array<float>, key int")
    got = {}
    for r in ann.query(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute_neighbours({i: v for i, v in vectors.items() if i != 3250})
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert got[2050] == want[2050]
    assert ann.query(table.where("vec_id in (0, 50, 7)")).count() == 4
    assert ann.query(table.limit(0)).collect() == [] and ann.query(table.where("vec_id >= 3000 and vec_id < 3250")).collect() == []


def test_neighbours_without_structure(spark):
    from orthant.llm import ann

    rng = np.random.default_rng(4)
    vectors = {i: [float(np.float32(x)) for x in rng.standard_normal(24)] for i in range(2000)}
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    got = {}
    for r in ann.query(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute_neighbours(vectors)
    assert {q: len(x) for q, x in got.items()} == {q: 5 for q in want}
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
    # Leaves with too few rows: the search goes on until it has k.
    few = ann.nearest(table, F.col("vec_id") % 50 == 0, k=40, leaf_rows=8, leaf_sample=4, recall=0.01)
    assert few.count() == 40 * 40


def test_neighbours_of_a_hot_vector_with_repeated_rows(spark):
    from orthant.llm import ann

    hot = [(i, [1.0, 2.0], 0) for i in range(20) for _ in range(7 if i == 0 else 2)]
    table = spark.createDataFrame(hot + [(i, [1.0, -i / 10], 0) for i in range(20, 40)], "vec_id long, embedding array<float>, key int")
    got = {}
    for r in ann.nearest(table, F.col("vec_id").isin(0, 3, 10)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 2, 3, 4, 5], 3: [0, 1, 2, 4, 5], 10: [0, 1, 2, 3, 4]}


def test_language_model_does_not_depend_on_the_splits(spark, tmp_path):
    from orthant.llm import langid

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.repartition(9).write.parquet(f"{tmp_path}/many")
    weights = []
    for table, least, shuffles in ((docs, "1", "3"), (spark.read.parquet(f"{tmp_path}/many"), "16", "7")):
        spark.conf.set("spark.sql.files.minPartitionNum", least)
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        try:
            weights.append(langid.train(table, rounds=2, per_language=20))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.files.minPartitionNum")
    assert all(np.array_equal(a, b) for a, b in zip(weights[0].parameters(), weights[1].parameters()))


def test_neighbours_of_huge_and_tiny_components(spark):
    from orthant.llm import ann

    rng = np.random.default_rng(6)
    base = rng.standard_normal((120, 16))
    plain, huge = ([(i, [float(x * size) for x in v]) for i, v in enumerate(base)] for size in (1.0, 2.0**700))
    tiny = [(i, [float(x * 2.0**-700) for x in v]) for i, v in enumerate(base)]
    shape = "vec_id long, embedding array<double>"
    got = [sorted(map(tuple, ann.query(spark.createDataFrame(rows, shape)).collect())) for rows in (plain, huge, tiny)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 15 and all(r[3] is not None for r in got[0])


def test_pipeline(spark):
    import corpus_pipeline
    from orthant.llm.chunk_dedup import exact_duplicates
    from orthant.llm.near_dup import near_duplicates

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "42 !", "en", "s", 4)], docs.schema)
    first = corpus_pipeline.language_id(spark, docs.unionByName(odd), DATA)
    assert first.columns == docs.columns and first.count() == docs.count()
    second = corpus_pipeline.exact_dedup(spark, first, DATA)
    assert exact_duplicates(second).where("group_size > 1").count() == 0 and second.columns == docs.columns
    third = corpus_pipeline.near_dedup(spark, second, DATA)
    assert near_duplicates(third).where("not kept").count() == 0
    assert third.count() == near_duplicates(second).where("kept").count()
    fourth = corpus_pipeline.mix(spark, third, DATA)
    assert fourth.columns == docs.columns
    last = corpus_pipeline.sentencepiece(spark, fourth, DATA)
    assert last.count() == fourth.count()
    assert last.join(fourth.select("doc_id", "text"), "doc_id").where("decoded = text").select("doc_id").distinct().count() == fourth.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_language_stage_without_labels_and_without_evidence(spark, monkeypatch):
    import corpus_pipeline
    from orthant.llm.langid import ByteGru

    rows = [(1, "plain words", None), (2, "\u00e9", None), (3, "12 !", None), (4, "", None), (5, None, None), (6, "\u65e5\u672c", None)]
    docs = spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, DATA).collect()) == [1, 2, 6]
    for names, left in (("abcd", []), ("a", [1, 2, 6])):
        flat = ByteGru.fresh(list(names), 4, 1)
        for part in flat.parameters():
            part[:] = 0  # every language is as likely as any other
        monkeypatch.setattr(corpus_pipeline, "train", lambda _, flat=flat: flat)
        assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, DATA).collect()) == left


def test_dedup_stages_keep_one_row_of_each_group(spark):
    import corpus_pipeline

    words = [f"word{i}" for i in range(60)]
    near = [" ".join(words), " ".join(words[:-1])]
    rows = [(7, "same text"), (7, "same text"), (None, "same  text"), (None, "null one"), (None, "null one"), (5, "other"), (5, "same text"), (9, "alone"), (9, "null one")]
    more = [(20, near[0]), (20, near[1]), (None, near[0]), (20, "nothing like it"), (None, near[1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + more], "doc_id long, text string, lang string, source string, n_chars long")
    first = corpus_pipeline.exact_dedup(spark, docs, DATA)
    assert first.columns == docs.columns
    kept = sorted((r["doc_id"], r["text"]) for r in first.collect())
    assert kept == sorted([(5, "same text"), (9, "null one"), (5, "other"), (9, "alone"), (20, near[0]), (20, near[1]), (20, "nothing like it")])
    for table, left in ((first, (20,)), (docs.where("doc_id is null"), (None,))):
        second = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, table, DATA).collect()]
        assert [i for i, t in second if t in near] == list(left)
        assert len(second) == len({t.replace("  ", " ") for _, t in second})


def test_stages_keep_columns_of_any_name_and_very_long_texts(spark):
    import corpus_pipeline

    names = ["doc", "found", "row", "path", "file", "own_path", "at", "found_row", "own_id", "kept_row", "group", "_metadata", "key", "of", "n"]
    prose = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    long = " ".join(prose * 40)
    rows = [(i, t, "en" if i % 2 else None, "s", len(t)) for i, t in enumerate([*prose, long, long, long + " more"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        got = docs.collect()
        assert got and all(r[name] == f"{name}{r['doc_id']}" for r in got for name in names)
        assert all(r["lang"] for r in got)  # predicted where there was none
        assert sum(r["text"].startswith(long) for r in got) in (1, 2, 3)
    last = corpus_pipeline.sentencepiece(spark, docs, DATA).collect()
    assert len(last) == len(got) and any(r["n_tokens"] > 5000 for r in last)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_an_empty_table(spark, stage):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.STAGES[stage][1](spark, docs, DATA).collect() == []
