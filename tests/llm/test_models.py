"""Held-out accuracy of the two trained operators, and their edge cases."""

import numpy as np
from pyspark.sql import functions as F

from quillframe.llm import language, passages, queries

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    found = queries.op6_language(spark, SF).join(queries.documents(spark, SF), "doc_id").filter("held_out")
    right, n = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97


def test_language_edges(spark, odd, empty):
    assert language.predict(odd, language.train(empty)).filter("lang_pred <> 'und' OR score <> 0").isEmpty()
    model = language.train(odd)
    assert model.languages == ["en", "fr"] and 0.02 <= model.heat <= 20
    found = language.predict(odd, model, keep=("doc_id", "text")).collect()
    assert len(found) == odd.count()
    for r in found:
        assert (r["lang_pred"] == "und") == (not r["text"] or not any(c.isalpha() for c in r["text"])) and 0 <= r["score"] <= 1
    assert language.predict(empty, model).collect() == []


def test_leader_is_sparse():
    rng = np.random.default_rng(0)
    leader = language.FollowTheLeader(2, l1=0.05)
    for _ in range(300):
        y = int(rng.integers(2))
        cells = np.sort(rng.choice(200, 20, replace=False))
        cells[0] = 500 + y
        leader.learn(cells, np.full(20, 0.2), y)
    w = leader.weights()
    assert w[500, 0] > w[500, 1] and w[501, 1] > w[501, 0]
    assert (w == 0).mean() > 0.9


def test_language_is_sparse_and_calibrated(spark):
    """On what neither training nor calibration saw: weights mostly zero, scores of short pieces near their accuracy."""
    docs = queries.documents(spark, SF)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = language.train(docs.filter(~held))
    touched = model.weights[(model.weights != 0).any(1) | (model.idf < model.idf.max())]
    assert (touched == 0).mean() > 0.5
    assert 0.05 < model.heat < 10
    pieces = docs.filter(held & F.col("text").rlike("[a-z]")).withColumn("text", F.substring("text", 60, 25))
    found = language.predict(pieces, model, keep=("doc_id", "lang")).filter("lang_pred <> 'und'").toPandas()
    right = (found["lang"] == found["lang_pred"]).to_numpy()
    bins = np.minimum((found["score"] * 10).astype(int), 9)
    error = sum(abs(right[bins == k].mean() - found["score"][bins == k].mean()) * (bins == k).mean() for k in set(bins))
    assert len(found) > 100 and error < 0.05


def test_leader_by_loops():
    """One pass of the learner against the textbook's loop over single coordinates."""
    rng = np.random.default_rng(8)
    leader = language.FollowTheLeader(3, alpha=0.3, beta=0.7, l1=0.1, l2=0.2)
    z, n = {}, {}
    weight = lambda i, c: 0.0 if abs(z.get((i, c), 0.0)) <= 0.1 else -(z[i, c] - np.sign(z[i, c]) * 0.1) / ((0.7 + n[i, c] ** 0.5) / 0.3 + 0.2)
    for _ in range(60):
        cells, y = np.sort(rng.choice(12, 5, replace=False)), int(rng.integers(3))
        x = rng.uniform(0.1, 1, 5)
        old = {(int(i), c): weight(int(i), c) for i in cells for c in range(3)}
        logits = np.array([sum(x[k] * old[int(i), c] for k, i in enumerate(cells)) for c in range(3)])
        p = np.exp(logits) / np.exp(logits).sum()
        for k, i in enumerate(cells):
            for c in range(3):
                g, at = (p[c] - (c == y)) * x[k], (int(i), c)
                before = n.get(at, 0.0)
                z[at] = z.get(at, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / 0.3 * old[at]
                n[at] = before + g * g
        leader.learn(cells, x, y)
    assert np.allclose(leader.weights()[:12], [[weight(i, c) for c in range(3)] for i in range(12)])


def test_language_edge_names_and_ids(spark):
    """Text ids, a column whose name needs quotes, copies beyond number of one text."""
    rows = [("x", "the house and the garden", "en", 1)] * 300
    rows += [(f"i{k}", t, x, 2) for k in range(40) for t, x in ((f"la maison et le jardin {k}", "fr"), (f"the garden of {k} houses", "en"))]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, `a.b` int")
    model = language.train(df, per_language=20)
    found = language.predict(df, model, keep=("doc_id", "a.b"))
    assert found.columns == ["doc_id", "a.b", "lang_pred", "score"] and found.filter("lang_pred = 'en'").count() == 340


def test_temperature():
    rng = np.random.default_rng(1)
    logits = rng.normal(0, 1, (4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in language.softmax(logits)])
    assert abs(language.temperature(logits * 4, labels) - 4) < 0.5


def test_passages_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = queries.op5_passages(spark, SF).join(labels, "doc_id").filter("held_out")
    right, n = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.9


def test_passages_edges(spark, odd, empty):
    labels = odd.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    model = passages.train(odd, labels)
    found = passages.score(odd, model).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert passages.train(odd, labels.withColumn("quality", F.lit(1))) is None
    assert passages.train(odd, labels.filter("FALSE")) is None
    assert {r["score"] for r in passages.score(odd, None).collect()} == {0.5}
    assert passages.score(empty, model).collect() == []


def test_passages_ids_and_bounds(spark):
    """Text ids; of several texts of an id the first counts; long documents are fitted on in part and scored whole."""
    rows = [(f"d{i}", ("good plain words " if i % 2 else "### $$$ !!! ") * (20 if i < 30 else 3000)) for i in range(34)] + [("d1", "### zzz")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(34)], "doc_id string, quality int")
    one, two = (passages.train(docs.repartition(n), labels, max_passages=4) for n in (1, 5))
    assert all((one.p[k] == two.p[k]).all() for k in one.p)
    found = passages.score(docs.withColumn("a.b", F.lit(1)), one, keep=("a.b", "doc_id"))
    assert found.columns == ["a.b", "doc_id", "score"] and found.count() == 35


def test_forward_by_loops():
    """The score of a document by sums over its passages, one by one."""
    rng = np.random.default_rng(2)
    bags = [rng.normal(0, 1, (n, passages.FEATURES)).astype(np.float32) for n in (2, 4)]
    model = passages.fit(bags, np.array([0, 1]), epochs=2)
    p, sigmoid = model.p, lambda v: 1 / (1 + np.exp(-v))
    for bag in bags:
        codes, weights = [], []
        for x in bag.astype(float):
            h = np.tanh(((x - model.mean) / model.scale) @ p["W"] + p["w0"])
            codes.append(h)
            weights.append(np.exp(sum(p["a"][k] * np.tanh(h @ p["V"][:, k]) * sigmoid(h @ p["U"][:, k]) for k in range(passages.ATTENTION))))
        z = sum(w * h for w, h in zip(weights, codes, strict=True)) / sum(weights)
        assert np.allclose(model.score(bag.astype(float), np.zeros(len(bag), int), 1), sigmoid(z @ p["c"] + p["c0"][0]))


def test_passage_features():
    texts = [b"", b"   ", b" one two ", b"word " * 200, b"x"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x, rows = passages.features(data, offsets)
    assert np.bincount(rows).tolist() == [1, 1, 1, 4, 1]
    for i, t in enumerate(texts):
        alone, _ = passages.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(alone, x[rows == i])


def test_gradients():
    rng = np.random.default_rng(4)
    bags = [rng.normal(0, 1, (n, passages.FEATURES)).astype(np.float32) for n in (1, 3, 5)]
    model = passages.fit(bags, np.array([0, 1, 1]), epochs=1)
    x, rows, y, w = np.concatenate(bags).astype(float), np.repeat(np.arange(3), (1, 3, 5)), np.array([0, 1, 1]), np.array([1.0, 2.0, 1.0])
    loss = lambda: -(w * np.where(y == 1, np.log(s := model.score(x, rows, 3)), np.log(1 - s))).sum() / w.sum()
    found = model.gradients(x, rows, y, w)
    for k, p in model.p.items():
        at = tuple(0 for _ in p.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = loss()
        p[at] = old - 1e-5
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-5 - found[k][at]) < 1e-5
