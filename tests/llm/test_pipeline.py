"""The stages on a small corpus, against plain versions of each."""

import random

import pytest

from tests.llm.helpers import WORD, docs_frame, random_text, vocabulary
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_line_dedup import brute as gone_lines
from tests.llm.test_mixing import fill
from tests.llm.test_ngram_join import brute as groups


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, words = random.Random(21), vocabulary()
    base = str(tmp_path_factory.mktemp("sf"))
    items = [(i, random_text(rng, words, 15)) for i in range(5)]
    shared = random_text(rng, words, 14)
    rows, marks = [], []
    for i in range(160):
        lines = [random_text(rng, words, rng.randint(4, 14)) for _ in range(rng.randint(1, 5))]
        if i % 8 == 0:
            lines.insert(0, shared)
        if i % 20 == 3:
            lines.append(items[i % 5][1])
        toxic = int(i % 3 == 0)
        if toxic:
            lines[0] += " idiot worthless you moron"
        rows.append((i, "\n".join(lines), ["a", "b", None][i % 3]))
        marks.append((i, toxic))
    rows += [(200 + k, rows[10 * k][1] + " x", "c") for k in range(6)]          # near copies
    rows += [(300, rows[1][1], "c"), (301, None, "c"), (302, "", "a"), (303, shared, "b"), (1, rows[1][1], "b")]
    docs_frame(spark, rows).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_every_stage_on_its_own_input(spark, sf_dir, tmp_path):
    import corpus_pipeline as cp
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontaminate", "mix_sources"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, steps = docs.dtypes, []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.dtypes == columns
        steps.append((docs, out))
        docs = out

    before, after = map(texts, steps[0])                     # toxic documents go, others stay as they are
    assert set(after) <= set(before)
    bad = {i for i, t in before if t and "idiot" in t}
    assert not bad & {i for i, _ in after} and {i for i, t in before} - bad == {i for i, _ in after}

    before, after = map(texts, steps[1])
    want = {}
    for i, _, gone in gone_lines(before, 2, 1, 24):
        want.setdefault(i, set()).update(gone)
    kept = []
    for i, t in before:
        g = want[str(i)]
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)
        if not g or left.strip():
            kept.append((i, t if not g else left))
    assert sorted(map(str, after)) == sorted(map(str, kept))
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in steps[1][1].collect())

    before, after = map(texts, steps[2])
    fate = groups(list(dict.fromkeys(before)))
    assert sorted(map(str, after)) == sorted(str(r) for r in dict.fromkeys(before) if fate[r[0]][2])

    before, after = map(texts, steps[3])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {r[0] for r in leaks(before, items, 10) if r[4]}
    assert hit and sorted(map(str, after)) == sorted(str(r) for r in before if r[0] not in hit)

    rows = steps[4][1].collect()
    assert len(rows) == steps[4][0].count()
    size, taken = {}, {}
    for r in steps[4][0].collect():
        size[r["source"]] = size.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    target = fill(size)
    assert not [(s, taken[s], target[s]) for s in size if abs(taken[s] - target[s]) > 0.5 + 1e-6], (size, taken, target)


def test_rows_of_one_id_and_rows_without_id(spark, sf_dir):
    """A near copy under a repeated id goes, a row without id stays, equal rows of one id become one."""
    import corpus_pipeline as cp
    a, b = (random_text(random.Random(k), vocabulary(), 60) for k in (1, 2))
    rows = [(1, a, "s"), (2, b, "s"), (2, a + " x", "s"), (3, b, "s"), (None, a, "s"), (None, a, "s"), (4, "", "s"), (4, "", "s"),
            (4, None, "s"), (5, "one  two", "s"), (5, "one two", "t")]
    out = cp.dedup_documents(spark, docs_frame(spark, rows), sf_dir)
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    five = [r for r in got if r[0] == 5]
    assert len(five) == 1
    assert [r for r in got if r[0] != 5] == sorted([(1, a), (2, b), (None, a), (None, a), (4, ""), (4, ""), (4, None)], key=str)


def test_run_removes_what_a_finished_stage_left(spark, sf_dir):
    import glob

    import corpus_pipeline as cp
    from tidemark.session import checkpoint_dir
    before = set(glob.glob(f"{checkpoint_dir(spark)}/pipeline-*"))
    cp.run(spark, sf_dir).count()
    base, = set(glob.glob(f"{checkpoint_dir(spark)}/pipeline-*")) - before
    assert [p.rsplit("/", 1)[1] for p in glob.glob(f"{base}/*")] == ["3-decontaminate"]


def test_run_equals_the_stages(spark, sf_dir):
    import corpus_pipeline as cp
    out = cp.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


def test_empty_documents(spark, sf_dir, tmp_path):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
