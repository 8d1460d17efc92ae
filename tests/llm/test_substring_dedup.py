import hashlib
import random

import numpy as np

from tests.llm.helpers import WORD, docs_frame, random_text, vocabulary
from tidemark.llm.substring_dedup import sliding_min, substring_dedup


def brute(rows, window):
    first = {}
    texts = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, w in texts:
        for s in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[s:s + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s:s + window])] < i:
                gone |= set(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(window):
    rng, vocab = random.Random(8), vocabulary(50)
    shared = [random_text(rng, vocab, n).split() for n in (window - 1, window, window + 7, 3 * window)]
    rows = []
    for i in range(80):
        w = random_text(rng, vocab, rng.randint(0, 30)).split()
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(shared)
            a = rng.randint(0, 3)
            k = rng.randint(0, len(w))
            w[k:k] = p[a:]
        rows.append((500 - 3 * i, rng.choice([" ", "\n", "\t "]).join(w)))
    whole = random_text(rng, vocab, 70)
    rows += [(1, whole), (2, whole), (2, whole), (900, whole.replace(" ", "  ")), (901, None), (902, ""), (903, " \n"),
             (None, whole), (904, "The " * 400), (905, "The " * 90), (500, rows[5][1]), (906, random_text(rng, vocab, 6000))]
    return rows


def digest(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def test_against_brute_force(spark):
    for window, gram in ((50, 20), (8, 3), (5, 5)):
        rows = corpus(window)
        df = docs_frame(spark, rows, extra=("id", "h", "start", "spans", "rep"))
        assert digest(substring_dedup(df, window, gram)) == brute(rows, window)


def test_spans_and_kept_text(spark):
    rows = corpus(10)
    by = {(r["doc_id"], r["n_words"]): r for r in substring_dedup(docs_frame(spark, rows), 10, 4, with_text=True).collect()}
    for i, t in rows:
        w = WORD.findall(t or "")
        r = by[(i, len(w))]
        if r["spans"] is None:
            assert r["kept"] == "" and r["n_removed"] == len(w)
        elif r["n_removed"]:
            gone = {k for s in r["spans"] for k in range(s["first"], s["last"] + 1)}
            assert r["kept"] == " ".join(x for k, x in enumerate(w) if k not in gone)
            assert all(s["last"] - s["first"] + 1 >= 10 for s in r["spans"])
        else:
            assert r["kept"] is None
    assert substring_dedup(docs_frame(spark, [])).collect() == []


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 200)
    for width in (1, 2, 3, 7, 8, 31, 200):
        assert sliding_min(x, width).tolist() == [x[i:i + width].min() for i in range(200 - width + 1)]
