import random

import numpy as np

from tests.llm.helpers import docs_frame, random_text, vocabulary
from tidemark.llm.quality import fit_ordinal, grade_texts


def corpus(n=400):
    rng, words = random.Random(2), vocabulary()
    rows, rates = [], []
    for i in range(n):
        w = random_text(rng, words, rng.randint(20, 60)).split()
        g = i % 4                                    # 0 worst: share of junk falls with the grade
        for k in range(len(w)):
            if rng.random() < (0.6, 0.3, 0.1, 0.0)[g]:
                w[k] = w[k].upper() + "!!"
        rows.append((i, " ".join(w)))
        rates.append((i, (1, 2, 4, 5)[g]))
    return rows, rates


def test_four_grades_held_out(spark):
    rows, rates = corpus()
    labels = spark.createDataFrame([r for r in rates if r[0] % 3], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in grade_texts(docs_frame(spark, rows, extra=("quality", "keep")), labels).collect()}
    held = [(out[i]["expected_grade"], y, out[i]["keep"], out[i]["tail_probability"]) for i, y in rates if i % 3 == 0]
    x, y = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    assert np.corrcoef(x, y)[0, 1] > 0.9
    assert np.mean([(g >= 4) == k for _, g, k, _ in held]) > 0.9
    assert all(1 <= g <= 5 for g in x) and all(0 <= t <= 1 for *_, t in held)


def test_gradient_matches_the_likelihood():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    true = np.array([1.0, -2.0, 0.5, 0.0])
    z = x @ true + rng.logistic(size=300)
    y = np.digitize(z, [-1.0, 0.5, 2.0])
    w, theta = fit_ordinal(x, y, 4, penalty=0.0, steps=3000, rate=0.5)
    assert np.all(np.diff(theta) > 0)

    def loss(w, theta):
        s = lambda v: 1 / (1 + np.exp(-v))
        up = np.hstack((s(theta[None] - (x @ w)[:, None]), np.ones((300, 1))))
        p = np.diff(np.hstack((np.zeros((300, 1)), up)))
        return -np.log(p[np.arange(300), y]).mean()
    best = loss(w, theta)
    for k in range(4):                                       # a minimum: no small step improves it
        for d in (-0.02, 0.02):
            v = w.copy()
            v[k] += d
            assert loss(v, theta) > best
    for k in range(3):
        for d in (-0.02, 0.02):
            v = theta.copy()
            v[k] += d
            assert loss(w, v) > best


def test_edges(spark):
    rows, rates = corpus(60)
    rows += [(1000, None), (1001, ""), (1002, "word " * 20_000), (0, rows[0][1])]
    labels = spark.createDataFrame(rates + [(1000, None), (None, 1), (0, 5)], "doc_id long, quality int")
    out = grade_texts(docs_frame(spark, rows), labels).collect()
    assert len(out) == len(rows)
    empty = [r["expected_grade"] for r in out if r["doc_id"] in (1000, 1001)]
    assert empty[0] == empty[1]
    assert grade_texts(docs_frame(spark, []), labels).collect() == []
    none = grade_texts(docs_frame(spark, rows[:2]), labels.where("false")).collect()
    assert [r["keep"] for r in none] == [None, None]
    one = grade_texts(docs_frame(spark, rows[:2]), labels.where("quality = 1")).collect()
    assert [(r["expected_grade"], r["keep"]) for r in one] == [(1.0, True)] * 2
