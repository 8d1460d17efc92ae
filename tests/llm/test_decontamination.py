import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import docs_frame, random_text, vocabulary
from tidemark.llm.decontamination import cut_words, decontaminate, merge_spans
from tidemark.llm.fm_index import FMIndex, suffix_order
from tests.llm.helpers import re

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window):
    phrases = {}
    for i, t in items:
        w = words(t)
        k = min(len(w), window)
        for s in range(len(w) - k + 1 if k else 0):
            phrases.setdefault(tuple(w[s:s + k]), set()).add(str(i))
    out = []
    for i, t, *_ in rows:
        w = words(t)
        hit, found = set(), set()
        for s in range(len(w)):
            for k in range(1, window + 1):
                got = phrases.get(tuple(w[s:s + k])) if s + k <= len(w) else None
                if got:
                    hit |= set(range(s, s + k))
                    found |= got
        out.append((i, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=50), st.integers(1, 5))
def test_index_against_scanning(t, sample):
    t = np.array(t)
    ends = np.concatenate((t + 1, [0]))
    assert suffix_order(ends, 4).tolist() == sorted(range(len(ends)), key=lambda i: ends[i:].tolist())
    w = t.astype(np.uint64) * np.uint64(7) + np.uint64(3)
    index = FMIndex(w, sample)
    rng = np.random.default_rng(len(t))
    phrases = rng.integers(0, 4, (12, 3)).astype(np.uint64) * np.uint64(7) + np.uint64(3)
    lengths = rng.integers(0, 4, 12)
    found = sorted(zip(*(x.tolist() for x in index.locate(*index.search(phrases, lengths)))))
    assert found == sorted((p, i) for p in range(12) if lengths[p] for i in range(len(w) - lengths[p] + 1)
                           if (w[i:i + lengths[p]] == phrases[p, :lengths[p]]).all())


def case(spark):
    rng, vocab = random.Random(6), vocabulary(60)
    items = [(i, random_text(rng, vocab, n).title()) for i, n in enumerate([12, 20, 6, 3, 11, 40])]
    items += [(50, None), (51, ""), (52, "!!"), (0, items[0][1]), (7, items[1][1])]
    rows = []
    for i in range(60):
        t = random_text(rng, vocab, rng.randint(0, 40)).split()
        if i % 3 == 0:
            src = items[i % 6][1].split()
            a = rng.randint(0, max(0, len(src) - 10))
            t[5:5] = src[a:a + rng.choice([9, 10, 15])]
        rows.append((i, rng.choice(["  ", ", ", " - "]).join(t)))
    rows += [(100, None), (101, ""), (102, random_text(rng, vocab, 5000) + " " + items[5][1]), (3, rows[3][1])]
    return rows, items, spark.createDataFrame(items, "item_id long, text string")


def collect(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in df.collect()), key=str)


def test_shards_blocks_and_pieces_agree_with_brute_force(spark):
    rows, items, bench = case(spark)
    df = docs_frame(spark, rows, extra=("spans", "items", "id"))
    want = brute(rows, items, 10)
    assert any(r[4] for r in want) and collect(decontaminate(df, bench)) == want
    # a long text in overlapping pieces; the benchmark in several blocks
    assert collect(decontaminate(df, bench, shard_words=300, block_words=30)) == want


def test_spans_cut_text_and_carry(spark):
    rows, items, bench = case(spark)
    df = docs_frame(spark, rows)
    out = decontaminate(df, bench, with_text=True, carry=True).collect()
    assert sorted(str(r["row"]["text"]) for r in out) == sorted(str(r[1]) for r in rows)
    for r in out:
        if r["contaminated"]:
            left = [w for k, w in enumerate(words(r["row"]["text"]))
                    if not any(s["first"] <= k <= s["last"] for s in r["spans"])]
            assert words(r["cleaned"]) == left
        else:
            assert r["cleaned"] is None and r["spans"] == []
    assert cut_words(b"a, b c; d e", [(1, 3)]) == b"a, ; d e"
    assert merge_spans(np.array([5, 0, 2]), np.array([6, 3, 5])) == [(0, 6)]


def test_empty_sides(spark):
    rows, items, bench = case(spark)
    df = docs_frame(spark, rows)
    assert not any(r["contaminated"] for r in decontaminate(df, bench.where("false")).collect())
    assert decontaminate(df.where("false"), bench).collect() == []


def test_empty_item_id_is_listed_and_null_is_not(spark):
    items = spark.createDataFrame([("", "one two three"), (None, "four five six"), ("=", "seven eight nine")], "item_id string, text string")
    docs = docs_frame(spark, [(1, "x one two three y"), (2, "four five six"), (3, "seven eight nine one two three")])
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate(docs, items).collect()}
    assert got == {1: (3, [""]), 2: (3, []), 3: (6, ["", "="])}
