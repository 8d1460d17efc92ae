import random
import zlib

from tests.llm.helpers import docs_frame, random_text, vocabulary
from tidemark.llm.toxicity import FEATURES, WordTable, features, score_toxicity


def corpus(n=600):
    rng, words = random.Random(9), vocabulary()
    bad = ["idiot", "worthless", "zorklaum", "zorklent", "zorkliss"]
    rows, marks = [], []
    for i in range(n):
        w = random_text(rng, words, rng.randint(15, 60)).split()
        toxic = int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        marks.append((i, toxic))
    return rows, marks


def test_held_out_accuracy(spark):
    rows, marks = corpus()
    rows += [(5000, None), (5001, ""), (5002, "word " * 30_000), (3, rows[3][1]), (None, "idiot")]
    labels = spark.createDataFrame(marks + [(5000, None), (None, 1)], "doc_id long, toxic int")
    out = score_toxicity(docs_frame(spark, rows, extra=("score", "row", "features")), labels, rounds=8).collect()
    assert len(out) == len(rows)
    truth = dict(marks)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.97
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] in (5000, 5001, 5002):
            assert r["predicted"] == 0
    # held-out labels are never read: flipping them changes nothing
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in marks]
    again = score_toxicity(docs_frame(spark, rows), spark.createDataFrame(flipped, "doc_id long, toxic int"), rounds=8)
    assert sorted((str(r["doc_id"]), r["score"]) for r in again.collect()) == sorted((str(r["doc_id"]), r["score"]) for r in out)


def test_without_usable_labels(spark):
    rows, marks = corpus(20)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    df = docs_frame(spark, rows)
    assert {r["score"] for r in score_toxicity(df, labels.where("false")).collect()} == {0.0}
    assert {r["predicted"] for r in score_toxicity(df, labels.where("toxic = 0"), carry=True).collect()} == {0}
    assert score_toxicity(df.where("false"), labels).collect() == []


def test_features():
    f = dict(zip(FEATURES, features("YOU are an 1d10t!! you id.i.ot, sooo stupid", WordTable({}))))
    assert f["insults"] == 1 and f["near"] == 1 and f["undisguised"] == 2
    assert f["shout_rate"] > 0 and f["repeat_rate"] > 0 and f["stretched_rate"] > 0 and f["second_person_rate"] > 0
    assert features("", WordTable({}))[:-1] == [0.0] * (len(FEATURES) - 1)


def test_inner_signs_are_linear_and_as_before():
    import random
    import re
    import time

    from tidemark.llm.toxicity import features, inner_signs, WordTable
    before = re.compile(r"(?<=[^\W_])[\d@$*!.\-_|+]+(?=[^\W\d_])")
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("ab1 2@$_.é²\n-") for _ in range(rng.randint(0, 25)))
        assert [m.span() for m in before.finditer(text)] == list(inner_signs(text)), text
    for text in ("1" * 1_000_000, "a" + "1" * 1_000_000 + " ", "1$" * 500_000 + "a"):
        at = time.perf_counter()
        features(text, WordTable({}))
        assert time.perf_counter() - at < 5
