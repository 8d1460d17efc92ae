import random
import re
from collections import Counter, defaultdict

import numpy as np

from tests.llm.helpers import DOCS
from tidemark.llm.source_audit import _FOLD, sort_pointers, source_audit, term_pointers

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, min_docs, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = [w.translate(LOWER) for w in TERM.findall(text or "")]
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        mates = [s for g, s in groups if g == lang]
        whole = Counter()
        for s in mates:
            whole.update(count[lang, s])

        def freq(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        p, q = freq(count[lang, source]), freq(whole)
        pair = []
        for s in mates:
            if s != source:
                o = freq(count[lang, s])
                pair.append((s, sum(abs(p[t] - o[t]) for t in kept)))
        term = [(t, p[t] - q[t]) for t in kept if count[lang, source][t] and p[t] > q[t]]
        for part, items, limit in (("pair", pair, None), ("term", term, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, t, v, i + 1) for i, (t, v) in enumerate(items[:limit])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], DOCS).repartition(3)


def corpus(seed, n, langs, sources):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcXYZéß漢🙂") for _ in range(rng.choice([1, 2, 3, 9, 17, 30]))) for _ in range(60)]
    words += ["samebeginning" * 3 + w for w in "abc"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "1", "\n", "_", "@", "\u0000"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(langs), rng.choice(sources)))
    return rows


def test_equals_plain_version(spark):
    rows = corpus(1, 150, ["en", "de", None], ["a", "b", "Z", "ä", None, "a b"])
    rows += [(1000, None, "en", "none"), (1001, "", "xx", "x"), (1002, "x y", "xx", "y"), (1003, "12 34", "xx", None),
             (5, rows[5][1], rows[5][2], rows[5][3]), (None, "x", "en", "b"), (7, "Ab" * 20000, "en", "a"), (8, "Ab" * 20000 + "c", "en", "a")]
    from pyspark.sql import functions as F
    df = frame(spark, rows).withColumn("term", F.lit("x")).withColumn("value", F.lit(1)).withColumn("n", F.lit(2))
    for least, top in ((3, 5), (30, 50)):
        got = source_audit(df, least, top, block_terms=7, tile=2)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == plain(rows, least, top)


def test_empty_and_single(spark):
    assert source_audit(frame(spark, [])).collect() == []
    assert source_audit(frame(spark, [(1, "a b", "en", "s")])).collect() == []
    assert sorted(map(tuple, source_audit(frame(spark, [(1, "a", "en", "s"), (2, None, "en", "t")])).collect())) == [
        ("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_counts_beyond_long_products(spark):
    """floor(1e9 (count + 5) / ...) where 1e9 * count does not fit in a long."""
    from tidemark.llm.source_audit import _p
    n, total, v = 9 * 10**11 + 7, 10**13 + 1, 12345
    df = spark.createDataFrame([(n, total, v)], "n long, total long, v long")
    assert df.select(_p("n", "total", "v")).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_pointer_sort():
    rng = random.Random(4)
    for _ in range(60):
        texts = [" ".join("".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 300]))) for _ in range(rng.randint(0, 9)))
                 for _ in range(rng.randint(1, 6))]
        raw = "".join(texts).encode()
        starts = np.cumsum([0] + [len(t) for t in texts])[:-1]
        buf = np.zeros(len(raw) + 8, np.uint8)
        buf[:len(raw)] = _FOLD[np.frombuffer(raw, np.uint8)]
        first, last = term_pointers(buf[:len(raw)], starts)
        words = [w for t in texts for w in t.split()]
        assert [raw[i:j].decode() for i, j in zip(first, last)] == words
        order, new = sort_pointers(buf, first, last)
        assert list(order) == sorted(range(len(words)), key=words.__getitem__)
        assert [bool(x) for x in new] == [k == 0 or words[order[k]] != words[order[k - 1]] for k in range(len(words))]
