import math
import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from neartag.operators import evaluate, learn, predict, trees
from neartag.operators import neighbors as nn
from neartag.plans import learning, search
from neartag.plans.staging import Staging
from neartag.sources import files


def neighbors(spark):
    return spark.createDataFrame([(1, 1, 10, "a b"), (1, 2, 11, "b  c "), (2, 1, 12, "")],
                                 "query_id long, rank int, id long, tags string")


def asked(spark):
    return spark.createDataFrame([(1,), (2,), (3,)], "query_id long")


def test_candidates_and_union(spark):
    got = {(r.id, r.tag) for r in predict.candidate_tags(neighbors(spark), 2).collect()}
    assert got == {(1, "a"), (1, "b"), (1, "c"), (2, "")}
    union = {r.id: r.tags for r in predict.union_predict(neighbors(spark), asked(spark), 1).collect()}
    assert union == {1: "a b", 2: "", 3: ""}


def test_examples(spark, tmp_path):
    truth = spark.createDataFrame([(1, "b z")], "id long, tags string")
    bag = spark.createDataFrame([(1, "x:y", 2), (1, "b", 1)], "id long, term string, n long")
    candidates = predict.candidate_tags(neighbors(spark), 1).filter("id = 1")
    rows = predict.make_examples(predict.label_candidates(candidates, truth), bag)
    lines = sorted(r.value for r in predict.format_examples(rows).collect())
    assert lines == ["-1 1^a|a  _b:1 _x_COLON_y:2", "1 1^b|b  _b:1 _x_COLON_y:2"]
    unlabelled = predict.make_examples(predict.label_candidates(candidates), bag)
    files.write_examples(unlabelled, str(tmp_path / "examples"))
    stored = sorted(r.value for r in spark.read.text(str(tmp_path / "examples")).collect())
    assert stored == [" 1^a|a  _b:1 _x_COLON_y:2", " 1^b|b  _b:1 _x_COLON_y:2"]


def test_predictions_from_scores(spark):
    rows = [(1, "b", 0.5), (2, "x", -1.0), (1, "a", 0.1), (2, "y", -0.5), (3, "q", -1.0), (3, "p", -1.0),
            (4, "n", math.nan), (4, "m", -3.0), (1, "c", 0.0)]
    scores = spark.createDataFrame(rows, "id long, tag string, score double")
    got = {r.id: r.tags for r in predict.predict_from_scores(scores).collect()}
    assert got == {1: "a b", 2: "y", 3: "p", 4: "m"}
    assert predict.predict_from_scores(scores.limit(0)).count() == 0


def test_score_lines(spark, tmp_path):
    (tmp_path / "s.txt").write_text("0.25 7^c++\n-1e-3 8^x\nnan 9^y\n")
    got = {(r.id, r.tag): r.score for r in files.read_scores(spark, str(tmp_path / "s.txt")).collect()}
    assert got[(7, "c++")] == 0.25 and got[(8, "x")] == -0.001 and math.isnan(got[(9, "y")])


def test_evaluation(spark):
    truth = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "a"), (4, "a b c d"), (5, "   ")], "id long, tags string")
    predicted = spark.createDataFrame([(1, "b a"), (2, ""), (3, "z"), (4, "a x"), (5, "a"), (6, "a"), (3, "  ")],
                                      "id long, tags string")
    rows = {(r.id, r.n_predicted): r for r in evaluate.per_row_scores(predicted, truth).collect()}
    assert (rows[1, 2].precision, rows[1, 2].recall) == (1.0, 1.0)
    assert rows[2, 1].tp == 0 and rows[3, 1].precision == 0.0
    assert (rows[4, 2].precision, rows[4, 2].recall) == (0.5, 0.25)
    assert rows[5, 1].recall == 0.0 and rows[3, 0].precision == 0.0
    assert rows[6, 1].missing and rows[6, 1].precision is None
    product = evaluate.mean_score(predicted, truth).first()
    f1 = evaluate.mean_score(predicted, truth, "f1").first()
    assert product.n_missing == 1 and product.n_rows == 7
    assert product.mean_score == pytest.approx((1 + 0.125) / 6)
    assert f1.mean_score == pytest.approx((1 + 1 / 3) / 6)
    with pytest.raises(ValueError):
        evaluate.mean_score(predicted, truth, "other")


def test_overlap_counts_copies(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    test = spark.createDataFrame([("a",), ("a",), ("c",)], "text string")
    assert evaluate.split_overlap(train, test).first().asDict() == {"n_test": 3, "n_overlap": 2}


def test_label_metrics(spark):
    schema = "id long, tag string"
    predicted = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], schema)
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema)
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    row = evaluate.label_metrics(predicted, truth, ids, F.lit(4)).first()
    assert row.hamming_loss == pytest.approx(2 / 16)
    assert row.subset_accuracy == pytest.approx(0.5)
    assert row.micro_f1 == pytest.approx(4 / 6)
    assert row.macro_f1 == pytest.approx(1 / 4)


def test_csv_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Id,Title,Body,Tags\n1,"a, b","line 1\nsaid ""x""","t1 t2"\n2,t,b\n')
    got = [tuple(r) for r in files.read_questions_csv(spark, str(tmp_path / "q.csv")).orderBy("id").collect()]
    assert got == [(1, "a, b", 'line 1\nsaid "x"', "t1 t2"), (2, "t", "b", "")]
    import gzip
    with gzip.open(tmp_path / "t.csv.gz", "wt") as out:
        out.write('Id,Title,Body\n5,t,"x\ny"\n')
    assert tuple(files.read_test_csv(spark, str(tmp_path / "t.csv.gz")).first()) == (5, "t", "x\ny", "")


def test_neighbor_files(spark, tmp_path):
    packed = nn.pack_neighbors(neighbors(spark), asked(spark))
    lines = {r.value for r in files.format_neighbors(packed).collect()}
    assert lines == {'1,10,"a b",11,"b  c "', '2,12,""', "3"}
    files.write_neighbors(packed, str(tmp_path / "n"))
    assert list((tmp_path / "n").glob("*.gz"))
    back = files.read_neighbors(spark, str(tmp_path / "n"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in neighbors(spark).collect()}
    assert {r.query_id for r in files.read_neighbor_queries(spark, str(tmp_path / "n")).collect()} == {1, 2, 3}


def test_prediction_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "")], "id long, tags string")
    files.write_predictions(df.coalesce(1), str(tmp_path / "p"))
    part = next((tmp_path / "p").glob("*.csv")).read_text()
    assert part.splitlines()[0] == "Id,Tags"
    assert {tuple(r) for r in files.read_predictions(spark, str(tmp_path / "p")).collect()} == {(1, "a b"), (2, "")}


def test_vocabulary_ties(spark):
    counts = spark.createDataFrame([("b", 2), ("a", 1), ("a", 1), ("c", 1)], "term string, n long")
    got = {r["term"]: r["index"] for r in learn.vocabulary(counts, 2).collect()}
    assert got == {"a": 0, "b": 1}


def ml_knn_by_hand(train, near, k, smooth=1.0):
    """train: {id: tags}; near: {id: [neighbour ids]}.  A function (label, j) -> probability."""
    labels = {t for tags in train.values() for t in tags}
    n = len(train)

    def probability(label, j):
        c = [[0] * (k + 1), [0] * (k + 1)]
        for i, tags in train.items():
            c[label in tags][sum(label in train[x] for x in near[i])] += 1
        size = sum(label in tags for tags in train.values())
        prior = (smooth + size) / (2 * smooth + n)
        yes = prior * (smooth + c[1][j]) / (smooth * (k + 1) + size)
        no = (1 - prior) * (smooth + c[0][j]) / (smooth * (k + 1) + n - size)
        return yes / (yes + no)
    return labels, probability


def test_ml_knn_against_the_definition(spark):
    import random
    rng, k = random.Random(3), 3
    train = {i: {t for t in "abcd" if rng.random() < 0.5} | {"z"} for i in range(20)}
    near = {i: rng.sample([x for x in train if x != i], k) for i in train}
    labels, probability = ml_knn_by_hand(train, near, k)
    text = lambda tags: " ".join(sorted(tags))
    pairs = spark.createDataFrame([(i, t) for i, tags in train.items() for t in tags], "id long, label string")
    rows = [(i, x, text(train[x])) for i, xs in near.items() for x in xs]
    table = spark.createDataFrame(rows, "query_id long, id long, tags string")
    model = learn.ml_knn_fit(pairs, table, F.lit(20), k)
    got = {(r.label, r.j): r.probability for r in model.collect()}
    assert got == {(lab, j): pytest.approx(probability(lab, j)) for lab in labels for j in range(k + 1)}
    # A query without neighbours still gets the labels that are likely for it.
    queries = spark.createDataFrame([(100,), (101,)], "query_id long")
    asked_near = spark.createDataFrame([(100, 0, text(train[0])), (100, 1, text(train[1]))],
                                       "query_id long, id long, tags string")
    found = {(r.id, r.tag) for r in learn.ml_knn_predict(model, queries, asked_near).collect()}
    count = lambda q, lab: sum(lab in train[x] for x in (0, 1)) if q == 100 else 0
    assert found == {(q, lab) for q in (100, 101) for lab in labels if probability(lab, count(q, lab)) > 0.5}


def questions(spark):
    rows = []
    for i in range(60):
        kind = ("cat", "dog", "fox")[i % 3]
        rows.append((i, kind, f"{kind} {kind}s word{i % 7} word{i % 5}", f"{kind} animal"))
    return spark.createDataFrame(rows, "id long, title string, body string, tags string")


def test_cross_validation_of_ml_knn(spark):
    data = questions(spark).withColumn("text", F.col("body"))
    index = search.stage_index(data.withColumn("corpus", F.lit("train")), Staging(spark))
    got = learning.cross_validate_ml_knn(data, index, "train", (F.col("id") % 4).cast("int"), 4, k=5).collect()
    assert [r.fold for r in got] == [0, 1, 2, 3] and all(r.n_rows == 15 for r in got)
    assert all(r.micro_f1 == 1.0 and r.hamming_loss == 0.0 and r.subset_accuracy == 1.0 for r in got)


def test_fold_neighbors_stay_outside_the_fold(spark):
    scores = spark.createDataFrame([(q, d, (q * 31 + d * 17) % 11) for q in range(12) for d in range(12)],
                                   "query_id long, id long, micro long")
    got = {}
    for r in learning.fold_neighbors(scores, F.col("id") % 3, 3, 2).collect():
        got.setdefault((r.fold, r.query_id), set()).add(r.id)
    for fold in range(3):
        for q in range(12):
            outside = sorted((-((q * 31 + d * 17) % 11), d) for d in range(12) if d != q and d % 3 != fold)
            assert got[fold, q] == {d for _, d in outside[:2]}


def test_labelset_trees(spark):
    data = questions(spark)
    model = learning.fit_labelset_trees(data.filter("id < 45"), labelset_size=2, n_models=8, vocab=50, seed=5)
    covered = {lab for s in model.labelsets for lab in s}
    found = {(r.id, r.tag) for r in learning.predict_labelsets(model, data.filter("id >= 45")).collect()}
    assert found == {(i, t) for i in range(45, 60) for t in (("cat", "dog", "fox")[i % 3], "animal") if t in covered}


def plain_tree(rows, patterns, depth):
    """The rules of the trees on plain sets: predicts a pattern for a set of features."""
    total = Counter(patterns)

    def purity(counts):
        n = sum(counts.values())
        return sum(c * c for c in counts.values()) / n if n else 0.0

    found = []
    for f in sorted({f for row in rows for f in row}):
        yes = Counter(p for row, p in zip(rows, patterns) if f in row)
        score = round(purity(yes) + purity(total - yes), 6)
        if sum(yes.values()) < len(rows) and score > round(purity(total), 6):
            found.append((-score, f))
    if depth == 0 or not found:
        best = min(total, key=lambda p: (-total[p], p))
        return lambda row: best
    _, f = min(found)
    sides = [plain_tree(*zip(*[(r, p) for r, p in zip(rows, patterns) if (f in r) == side]), depth - 1) for side in (False, True)]
    return lambda row: sides[f in row](row)


def test_trees_equal_plain_recursion(spark):
    rng = random.Random(3)
    rows = []
    for i in range(80):
        words = rng.sample([f"w{j}" for j in range(12)], rng.randrange(1, 7))
        tags = {t for t, own in (("a", "w1"), ("b", "w2"), ("c", "w3"), ("d", "w4")) if (own in words) != (rng.random() < 0.15)}
        rows.append((i, words[0], " ".join(words), " ".join(sorted(tags))))
    data = spark.createDataFrame(rows, "id long, title string, body string, tags string").repartition(3)
    model = learning.fit_labelset_trees(data.filter("id < 60"), labelset_size=2, depth=3)
    features = {i: {f"0_{t}"} | {f"1_{w}" for w in b.split()} for i, t, b, _ in rows}
    truth = {i: set(t.split()) for i, _, _, t in rows}
    votes = {}
    for labels in model.labelsets:
        patterns = [sum((label in truth[i]) << bit for bit, label in enumerate(labels)) for i in range(60)]
        tree = plain_tree([features[i] for i in range(60)], patterns, 3)
        for i in range(60, 80):
            for bit, label in enumerate(labels):
                votes.setdefault((i, label), []).append(tree(features[i]) >> bit & 1)
    expected = {(i, t): sum(v) / len(v) for (i, t), v in votes.items() if 2 * sum(v) >= len(v)}
    got = learning.predict_labelsets(model, data.filter("id >= 60")).collect()
    assert {(r.id, r.tag): r.vote for r in got} == expected and len(expected) > 20


def test_cross_validation_of_labelset_trees(spark):
    got = learning.cross_validate_labelset_trees(questions(spark), (F.col("id") % 2).cast("int"), 2,
                                                 n_models=6, labelset_size=4, vocab=50).collect()
    assert [r.fold for r in got] == [0, 1] and all(r.micro_f1 == 1.0 for r in got)


def test_subsets_differ_and_hold_every_label():
    labels = [f"t{i}" for i in range(26)]
    for seed in range(20):
        found = learning.draw_labelsets(labels, 3, 52, seed)
        assert len(found) == len(set(found)) == 52 and {x for s in found for x in s} == set(labels)
    assert learning.draw_labelsets(["a", "b"], 2, 4) == [("a", "b")]
    assert learning.draw_labelsets([], 0, 0) == []


def test_rows_without_tags_have_no_label(spark):
    df = spark.createDataFrame([(1, "x y"), (2, ""), (3, "y")], "id long, tags string")
    assert sorted((r.id, r.label) for r in learn.label_matrix(df).collect()) == [(1, "x"), (1, "y"), (3, "y")]


def test_an_id_without_a_real_score_gets_empty_tags(spark):
    rows = [(1, "a", float("nan")), (2, "c", -1.0), (2, "d", None), (3, "e", None)]
    df = spark.createDataFrame(rows, "id long, tag string, score double")
    assert {r.id: r.tags for r in predict.predict_from_scores(df).collect()} == {1: "", 2: "c", 3: ""}


def test_repeated_truth_does_not_multiply_rows(spark):
    truth = spark.createDataFrame([(1, "a b"), (1, "z"), (2, "c")], "id long, tags string")
    said = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, tags string")
    assert evaluate.mean_score(said, truth).first().asDict() == {"mean_score": 1.0, "n_rows": 2, "n_missing": 0}


def test_labelset_trees_query_keeps_the_defaults(monkeypatch):
    from checks import queries

    asked = []
    monkeypatch.setattr(queries.derive, "train", lambda spark, sf_dir: "rows")
    monkeypatch.setattr(queries, "spread", lambda rows: rows)
    monkeypatch.setattr(queries.derive, "kept", lambda rows: rows)
    monkeypatch.setattr(queries.derive, "held_out", lambda rows: rows)
    monkeypatch.setattr(queries.learning, "fit_labelset_trees", lambda rows, **settings: asked.append(settings))
    monkeypatch.setattr(queries.learning, "predict_labelsets", lambda model, rows: rows)
    queries.QUERIES["labelset_trees"](None, "")
    assert not {"n_models", "vocab", "labelset_size", "depth"} & set(asked[0])


def test_words_are_numbered_few_texts_at_a_time(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([["a"], None] * 1500), pa.array(
        [[f"w{(i + j) % 50}" for j in range(100)] if i % 3 else None for i in range(3000)])], ["id", "labels", "words"])
    tracemalloc.start()
    found = [x for piece in trees.encode_batch(batch, {f"w{i}": i for i in range(0, 50, 2)}) for x in piece["features"].to_pylist()[:1]]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [[] if start % 3 == 0 else list(range(0, 50, 2)) for start in range(0, 3000, trees.TEXTS)]
    assert peak < 4 << 20
    # Rows of counts reach Python by bytes, not by thousands of rows.
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    trees.encode_rows(spark.createDataFrame([(1, ["a"], ["w"])], "id long, l array<string>, w array<string>"), ["w"], F.col("l"), F.col("w"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"
