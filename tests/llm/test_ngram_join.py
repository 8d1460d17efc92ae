import random

from tests.llm.helpers import WORD, components, docs_frame, random_text, vocabulary
from tidemark.llm.ngram_join import choose_bands, ngram_join


def brute(rows, n=5, t=0.8):
    sets = []
    for i, text, *_ in rows:
        w = WORD.findall(text or "")
        sets.append({tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9]
    deg = [0] * len(rows)
    for a, b in pairs:
        deg[a] += 1
        deg[b] += 1
    comp = components([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in pairs])
    return {r[0]: (d, comp[r[0]], comp[r[0]] == r[0]) for r, d in zip(rows, deg)}


def corpus():
    rng, words = random.Random(4), vocabulary()
    rows, base = [], [random_text(rng, words, 120) for _ in range(12)]
    for i in range(150):
        w = base[i % 12].split() if i < 110 else random_text(rng, words, rng.randint(1, 60)).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((1000 - i, ("  " if i % 7 == 0 else "") + "\n ".join(w)))
    return rows + [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one  two"), (6, "one three"),
                   (7, random_text(rng, words, 4000)), (8, None)]


def collect(df):
    return {r["doc_id"]: (r["n_links"], r["class_id"], r["kept"]) for r in df.collect()}


def test_matches_brute_force_small_and_split_groups(spark):
    rows = corpus()
    want = brute(rows)
    df = docs_frame(spark, rows, extra=("id", "key", "n_links", "unit"))
    assert collect(ngram_join(df)) == want
    # groups above the block are taken apart by bands and blocks, with equal results
    assert collect(ngram_join(df, block=3)) == want
    assert collect(ngram_join(df, block=3, wide=4)) == want             # all pairs of blocks where that sends less
    assert collect(ngram_join(df, block=3, wide=1 << 40)) == want       # ... which is everywhere
    assert collect(ngram_join(df, block=3, wide=0.001)) == want         # ... or nowhere


def test_texts_of_a_large_group_are_sent_a_few_times(spark):
    from tidemark.llm._blocks import block_pairs
    members = spark.range(2000).selectExpr("1L AS key", "id", "2000L AS bytes")
    got = block_pairs(members, 512, weight="bytes")
    assert got.groupBy("id").count().where("count > 19").count() == 0 and got.select("bi", "bj").distinct().count() == 10
    assert got.groupBy("unit").count().agg({"count": "max"}).first()[0] < 1200
    heavy = block_pairs(members.withColumn("bytes", members.bytes * 100), 512, weight="bytes")
    assert heavy.groupBy("unit").agg({"bytes": "sum"}).agg({"sum(bytes)": "max"}).first()[0] < 3 * (8 << 20)
    small = spark.range(40_000).selectExpr("id div 2 AS key", "id", "100L AS bytes")
    sizes = block_pairs(small, 512, weight="bytes").groupBy("unit").count()
    assert sizes.agg({"count": "max"}).first()[0] < 4096 and sizes.count() > 10


def test_digest_of_a_column_is_that_of_the_operator(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.ngram_join import word_digest
    rows = [(i, t) for i, t in enumerate(["a b", " a\t\x0b\x0cb\r\n", "", "  ", None, "\u00a0a", "é\u3000 漢", "a\x1cb \x00"])]
    df = docs_frame(spark, rows)
    want = {r.doc_id: r.digest for r in ngram_join(df, with_digest=True).collect()}
    assert {r.doc_id: r.d for r in df.select("doc_id", word_digest(F.col("text")).alias("d")).collect()} == want


def test_repeated_rows_null_ids_and_empty_table(spark):
    words = vocabulary()
    a, b = random_text(random.Random(1), words, 50), random_text(random.Random(2), words, 50)
    df = docs_frame(spark, [(1, a), (1, a), (2, a), (3, b), (3, a), (None, a), (4, b)])
    got = {}
    for r in ngram_join(df).collect():
        got.setdefault(r["doc_id"], []).append((r["n_links"], r["class_id"], r["kept"]))
    assert got[1] == [(3, 1, True)] * 2                    # ids 1, 1, 2 and the row of 3 with text a
    assert got[2] == [(3, 1, False)]
    assert sorted(got[3]) == [(1, 3, True), (3, 1, False)]
    assert got[4] == [(1, 3, False)]
    assert got[None] == [(0, None, None)]
    assert ngram_join(docs_frame(spark, [])).collect() == []


def test_bands_reach_the_recall():
    for t, recall in ((0.8, 0.999), (0.8, 0.99), (0.9, 0.999), (0.5, 0.9)):
        b, r = choose_bands(t, recall)
        assert 1 - (1 - t ** r) ** b >= recall and b * r <= 128


def test_a_block_is_packed_whole():
    import numpy as np
    import pandas as pd

    from tidemark.llm.ngram_join import _open_block, _pack_block
    rng = np.random.default_rng(2)
    base = [b"%d" % v for v in rng.integers(0, 9999, 200)]
    texts = [b" ".join(base[:k] + [b"new%d" % k] + base[k + 1:]) for k in range(200)] + ["é漢 x".encode()]
    g = pd.DataFrame({"id": np.arange(201) * -(1 << 40), "copies": np.arange(201) + 1, "normal": texts,
                      "bands": list(rng.integers(-(1 << 62), 1 << 62, 18)[None, :].repeat(201, 0))})
    data = _pack_block(g)
    back = _open_block(data)
    assert all(back[c].tolist() == g[c].tolist() for c in ("id", "copies", "normal"))
    assert np.array_equal(np.stack(back["bands"]), np.stack(g["bands"])) and len(data) < sum(map(len, texts)) / 8


def test_a_text_is_sent_to_its_block_once(spark):
    """A large group's rows grow with its members; only blocks meet in pairs."""
    from tidemark.llm._blocks import deal, paired
    dealt = deal(spark.range(3000).selectExpr("1L AS key", "id", "100L AS bytes"), 100, weight="bytes")
    assert dealt.count() == 3000 and dealt.groupBy("unit").count().agg({"count": "max"}).first()[0] < 200
    blocks = paired(dealt.select("key", "mine", "blocks", "unit").distinct())
    assert blocks.count() == 900 and blocks.groupBy("unit").count().where("count > 2").count() == 0
    assert blocks.select("unit").distinct().count() == 30 * 31 // 2
