import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs_frame, random_text, vocabulary
from tidemark.llm.line_dedup import line_dedup, signature


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1]


def brute(rows, edits, least, floor=None):
    """``least``: characters of lines that repeat exactly; ``floor``: of those in the edit join."""
    first, floor = {}, floor or least
    for i, t, *_ in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for no, raw in enumerate(t.split("\n")):
            line = raw.strip(" \t\r")
            if len(line) >= least:
                first.setdefault(line, (i, no))
                first[line] = min(first[line], (i, no))
    order = sorted(first, key=first.get)
    order = [x for x in order if len(x) >= floor]
    near = {b for k, b in enumerate(order) for a in order[:k]
            if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits}
    out = []
    for i, t, *_ in rows:
        gone = []
        for no, raw in enumerate(t.split("\n") if t is not None and i is not None else []):
            line = raw.strip(" \t\r")
            if len(line) >= least and (first[line] != (i, no) or line in near):
                gone.append(no)
        out.append((str(i), 0 if t is None else t.count("\n") + 1, gone))
    return sorted(out)


def corpus():
    rng, vocab = random.Random(12), vocabulary(80)
    base = [random_text(rng, vocab, n) for n in (6, 7, 8, 9, 12)]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(rng.randint(0, 4)):
            s = list(rng.choice(base)) if rng.random() < 0.6 else list(random_text(rng, vocab, rng.randint(1, 9)))
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                k, op = rng.randrange(len(s)), rng.randrange(3)
                s[k:k + (op > 0)] = rng.choice("xyzé") if op < 2 else ""
                s = s or ["q"]
            lines.append(rng.choice(["", " ", "\t"]) + "".join(s) + rng.choice(["", "\r", "  "]))
        rows.append((300 - 2 * i, "\n".join(lines)))
    return rows + [(1, None), (2, ""), (3, "\n\n"), (4, base[0]), (4, base[0]), (None, base[1]), (5, "The " * 3000),
                   (6, "The " * 2999 + "Thx "), (7, base[1] + "\n" + base[1])]


def digest(df):
    return sorted((str(r["doc_id"]), r["n_lines"], list(r["removed"])) for r in df.collect())


def test_matches_brute_force_with_and_without_crowded_keys(spark):
    rows = corpus()
    df = docs_frame(spark, rows, extra=("id", "no", "key", "lid", "removed"))
    for edits in (1, 2):
        want = brute(rows, edits, 12)
        assert digest(line_dedup(df, edits, 12)) == want
    assert digest(line_dedup(df, 2, 12, crowded=1, block=2)) == brute(rows, 2, 12)      # keys in blocks of two


def test_kept_text_and_carry(spark):
    rows = corpus()
    for r in line_dedup(docs_frame(spark, rows), 2, 12, with_text=True, carry=True).collect():
        text = r["row"]["text"]
        want = None if text is None else "\n".join(
            x for k, x in enumerate(text.split("\n")) if k not in r["removed"])
        assert r["kept"] == want


def test_exact_repeats_below_the_floor_of_the_edit_join(spark):
    rows = [r for r in corpus() if len(r[1] or "") < 1000] + [(400 + i, "All rights reserved.\nAnd.\nAll rights reserved!\n \n}") for i in range(9)]
    df = docs_frame(spark, rows)
    want = {}
    for i, n, gone in brute(rows, 2, 1, 24):
        want.setdefault(i, set()).update(gone)               # rows of one id are one document
    want = [(str(i), 0 if t is None else t.count("\n") + 1, sorted(want[str(i)])) for i, t in rows]
    assert digest(line_dedup(df, exact_chars=1)) == sorted(want)
    assert digest(line_dedup(df, exact_chars=1, crowded=1, block=2)) == sorted(want)
    assert digest(line_dedup(df)) == brute(rows, 2, 24)
    for bad in (0, 25):
        with pytest.raises(ValueError):
            line_dedup(df, exact_chars=bad)


def test_many_removed_lines_in_linear_time(spark):
    import time
    times = []
    for n in (20_000, 160_000):
        df = docs_frame(spark, [(1, "the same line again and again\n" * n + "another line of the same text")])
        at = time.perf_counter()
        r = line_dedup(df, with_text=True).first()
        times.append(time.perf_counter() - at)
        assert len(r["removed"]) == n - 1 and r["kept"] == "the same line again and again\nanother line of the same text"
    assert times[1] < 8 * times[0] + 5


def test_edges(spark):
    assert line_dedup(docs_frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        line_dedup(docs_frame(spark, []), max_edits=5, min_chars=5)


def test_an_edit_flips_at_most_four_bits(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 40)))
        k, op = rng.randrange(len(a)), rng.randrange(3)
        rows.append((a, a[:k] + (rng.choice("xyz") if op < 2 else "") + a[k + (op > 0):]))
    df = spark.createDataFrame(rows, "a string, b string")
    df = df.select(F.split("a", "").alias("a"), F.split("b", "").alias("b"))
    worst = df.select(F.max(F.bit_count(signature(F.col("a")).bitwiseXOR(signature(F.col("b")))))).first()[0]
    assert worst <= 4
