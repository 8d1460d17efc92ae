"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Labels are split by crc32 of the id (as text) mod 5: remainder 0 is held out and
never read, 1 calibrates, 2 to 4 train.

1. Lexicon.  Beside a short fixed list of insults, words and word beginnings
   (first four and five letters, which catch inflected and invented forms) are
   learned from the training rows: document counts by label come from one
   aggregate, and an entry is kept if it is much likelier in toxic texts.
2. Dense features of a whole text, in Arrow functions: densities of both
   lexicons, their strongest entries, second-person words and lexicon hits near
   them, capitals, punctuation, and obfuscation (signs or digits inside words,
   stretched letters, hits that appear only after undoing those).
3. Spark's gradient-boosted trees on the training rows, isotonic regression of
   the label on the margin over the calibration rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import carried, slices
from tidemark.session import cut_lineage

INSULTS = frozenset(
    "asshole bastard bitch clown crap creep cretin damn disgusting dumb dumbass freak fuck fucking garbage "
    "hate idiot idiots imbecile jerk kill loser losers moron morons pathetic pig scum shit stupid sucker "
    "trash ugly vermin worthless dumm depp idioten arschloch blödmann trottel abschaum wertlos scheiße "
    "abruti connard crétin débile imbécile merde ordure salaud stupide basura cabrón estúpido gilipollas "
    "idiota imbécil inútil mierda tonto".split())
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta vous votre tú ti tus usted "
    "ustedes vosotros".split())
FEATURES = ("insults", "insult_rate", "learned", "learned_rate", "strongest", "second_person_rate", "near",
            "near_rate", "capital_rate", "shout_rate", "exclaim_rate", "punctuation_rate", "repeat_rate",
            "inner_sign_rate", "stretched_rate", "undisguised", "log_words")
NEAR = 5                                            # words between a hit and a second-person word

_WORD = re.compile(r"[^\W_]+")
# a whole run of signs or digits before a letter: tried at its begin only, and never shortened
_RUN = re.compile(r"(?<![\d@$*!.\-_|+])[\d@$*!.\-_|+]++(?=[^\W\d_])")
_INNER = re.compile(r"[^\W_]")
_DIGIT = re.compile(r"\d")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
_EDGE = "!.,;:?\"'()*"
_UNDO = str.maketrans("013457@$!|", "oieastasil", "*.-_+")


def _bytes_in(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LETTER = _bytes_in(bytes(range(65, 91))), _bytes_in(bytes(range(65, 91)) + bytes(range(97, 123)))
_PUNCT, _TWICE = _bytes_in(b"!?.,;:*#$%&"), _bytes_in(b"!?.*#$%&")


def inner_signs(text: str) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of the signs or digits inside words: from after the first letter or digit
    of a run and what stands before it, to the letter that follows.  Linear in the text."""
    for m in _RUN.finditer(text):
        start, end = m.span()
        if start == 0 or not _INNER.match(text, start - 1):
            digit = _DIGIT.search(text, start, end - 1)
            if digit is None:
                continue
            start = digit.end()
        yield start, end


class WordTable(dict):
    """word -> 0 for an ordinary word, else (insult, second person, learned weight); the weight
    is that of the word or of its first five or four letters.  Words are looked up once
    and remembered, at most ``MOST`` of them."""
    MOST = 200_000

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, w: str):
        get = self.lexicon.get
        weight = max(get("=" + w, 0.0), get("5" + w[:5], 0.0) if len(w) > 5 else 0.0,
                     get("4" + w[:4], 0.0) if len(w) > 4 else 0.0)
        insult, second = w in INSULTS, w in SECOND_PERSON
        entry = (insult, second, weight) if insult or second or weight else 0
        if len(self) >= self.MOST:
            self.clear()
        self[w] = entry
        return entry


def features(text: str, table: WordTable) -> list[float]:
    """The dense features of one text."""
    low = text.lower()
    words = _WORD.findall(low)
    n, size = len(words) or 1, len(text) or 1
    marked = [(i, m) for i, w in enumerate(words) if (m := table[w])]
    insults = [i for i, (bad, _, _) in marked if bad]
    learned = [(i, x) for i, (_, _, x) in marked if x]
    you = {i for i, (_, second, _) in marked if second}
    near = 0
    if you:
        hits = {*insults, *(i for i, _ in learned)}
        near = sum(any(j in you for j in range(i - NEAR, i + NEAR + 1)) for i in hits)
    signs = undone = 0
    last = -1
    for start, end in inner_signs(low):
        signs += 1
        if start < last:
            continue                                  # in the token just seen
        a, b = start, end
        while a > 0 and not low[a - 1].isspace() and start - a < 64:
            a -= 1
        while b < len(low) and not low[b].isspace() and b - end < 64:
            b += 1
        last = b
        found = table[_STRETCH.sub(r"\1", low[a:b].strip(_EDGE).translate(_UNDO))]
        if found and (found[0] or found[2]):
            undone += 1
    raw = np.frombuffer(text.encode(), np.uint8)
    # capitals: ASCII and the two-byte letters of Western scripts
    upper = _UPPER[raw]
    capitals = int(upper.sum()) + int(((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)).sum())
    shouts = int((upper[2:] & upper[1:-1] & ~upper[:-2]).sum()) + int(upper[:2].all() and len(raw) > 1)
    same = raw[1:] == raw[:-1]
    repeats = int((same & _TWICE[raw[1:]]).sum())
    stretched = int((same[1:] & same[:-1] & _LETTER[raw[2:]]).sum())
    return [float(min(len(insults), 20)), len(insults) / n, float(min(len(learned), 50)),
            sum(x for _, x in learned) / n, max((x for _, x in learned), default=0.0), len(you) / n,
            float(min(near, 20)), near / n, capitals / size, shouts / n, text.count("!") / size,
            int(_PUNCT[raw].sum()) / size, repeats / n, signs / n, stretched / n, float(min(undone, 20)),
            math.log1p(len(words))]


def learn_lexicon(train: DataFrame, max_entries: int = 4000, min_docs: int = 8) -> dict[str, float]:
    """Entries ('=word', '5begin', '4begi') much likelier in toxic texts; train: (text, label).

    The counts cover all rows of ``train``; ``max_entries`` bounds the model, the
    strongest stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):             # entries of few texts at a time
                out, label = [], []
                for t, y in zip(b.column(0)[at:at + 100].to_pylist(), b.column(1)[at:at + 100].to_pylist()):
                    words = set(_WORD.findall((t or "").lower()))
                    entries = {"=" + w for w in words} | {"5" + w[:5] for w in words if len(w) > 5}
                    entries |= {"4" + w[:4] for w in words if len(w) > 4}
                    out.extend(entries)
                    label.extend([y] * len(entries))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(label, pa.int32())],
                                                 names=["entry", "label"])

    n = train.agg(F.sum(F.col("label").cast("long")), F.count(F.lit(1))).first()
    pos, neg = int(n[0] or 0), int((n[1] or 0) - (n[0] or 0))
    if not pos or not neg:
        return {}
    counts = train.select("text", "label").mapInArrow(run, "entry string, label int").groupBy("entry").agg(
        F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).where(F.col("p") >= min_docs)
    odds = F.log(((F.col("p") + 0.5) / (pos + 1)) / ((F.col("n") - F.col("p") + 0.5) / (neg + 1)))
    best = counts.withColumn("w", odds).where("w >= 2").orderBy(
        (F.col("w") * F.sqrt("p")).desc(), "entry").limit(max_entries)
    return {r["entry"]: float(r["w"]) for r in best.select("entry", "w").collect()}


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", max_fit_rows: int = 40_000, rounds: int = 20, depth: int = 3,
                   seed: int = 5, carry: bool = False) -> DataFrame:
    """(id, held_out, score, predicted), one row per row of ``docs``; with ``carry`` the
    whole input row comes along as the struct ``row``.

    ``max_fit_rows`` bounds the labelled rows that are fitted on: a hash sample of
    the rows with remainder 1 to 4 if there are more.  Every text is scored whole.

    NULL and empty texts have all rates 0 and are scored like any text.  Rows of a
    NULL label are not fitted on; repeated rows get equal scores; extra columns are
    not read; empty ``docs`` give an empty result.  An id with several labels counts as the
    largest, one with several texts as the smallest, so reruns learn alike.  Without labels, or with labels
    of one kind only, every score is the share of label 1 (0 without labels).
    """
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % 5
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        "id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    marks = marks.withColumn("fold", fold).where("fold <> 0")
    total = marks.count()
    if total > max_fit_rows:
        share = int(max_fit_rows / total * 1_000_000)
        marks = marks.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < share)
    # at most about max_fit_rows ids: a bound by parameter, so they are broadcast
    known = cut_lineage(src.join(F.broadcast(marks), "id").groupBy("id", "label", "fold").agg(F.min("text").alias("text")))
    lexicon = learn_lexicon(known.where("fold <> 1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(lexicon)
        for b in slices(carried(batches, id_col, text_col), 1):
            rows = [features(t or "", words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(rows, pa.list_(pa.float64())), *b.columns[2:]],
                names=["id", "x", *b.schema.names[2:]])
        pa.default_memory_pool().release_unused()

    kind = src.schema["id"].dataType.simpleString()
    every, row, row_type = src, [], ""
    if carry:
        every = docs.select(F.struct("*").alias("row"))
        row, row_type = ["row"], ", row " + every.schema["row"].dataType.simpleString()
    fit = cut_lineage(known.select("id", "text").mapInArrow(run, f"id {kind}, x array<double>")
                      .join(known.select("id", "label", "fold"), "id")
                      .select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"), "fold"))
    kinds = fit.groupBy(F.col("fold") == 1).agg(
        F.countDistinct("label").alias("k"), F.avg("label").alias("share")).collect()
    held_out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    if len(kinds) < 2 or min(r["k"] for r in kinds) < 2:
        share = float(fit.agg(F.avg("label")).first()[0] or 0.0)
        if carry:
            every = every.select(F.col("row").getField(id_col).alias("id"), "row")
        scored = every.select("id", F.lit(share).alias("score"), *row)
    else:
        trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=64).fit(
            fit.where("fold <> 1"))
        margin = vector_to_array("rawPrediction")[1]
        iso = IsotonicRegression(featuresCol="margin", labelCol="label").fit(
            trees.transform(fit.where("fold = 1")).select(margin.alias("margin"), "label"))
        x = every.mapInArrow(run, f"id {kind}, x array<double>{row_type}")
        m = trees.transform(x.select("id", array_to_vector("x").alias("features"), *row)).select(
            "id", margin.alias("margin"), *row)
        scored = iso.transform(m).select(
            "id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))).alias("score"), *row)
    return scored.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), *row)
