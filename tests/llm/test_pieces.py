import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tests.llm.helpers import docs_frame, random_text, vocabulary
from tidemark.llm import pieces as P
from tidemark.llm.pieces import Pieces, piece_round_trip

MODEL = "piece_bpe_32k.model"


def library(text):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    ids = sp.encode(text or "")
    return ids, sp.decode(ids)


def expected(key, text):
    ids, back = library(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()      # noqa: E731
    return key, len(ids), sha(",".join(map(str, ids))), sha(back)


def nasty(rng, n):
    al = [*"ab Z 's\n\t1é漢龘!▁", "  ", "   ", "　", "\x1f", "\x85", "<s>", "</s>", "<unk>", "<0x41>", "\u0000", "🙂", "é", "the ", "▁▁", "\r\n"]
    return "".join(rng.choice(al) for _ in range(n))


def test_equals_the_library(spark):
    rng = random.Random(11)
    rows = [(1, "a b  c\n\nd"), (2, None), (3, ""), (4, random_text(rng, vocabulary(), 9000)), (5, "x" * 3000), (6, " " * 500),
            (7, "<s> a</s><unk>"), (8, " lead and trail "), (9, "▁"), (1, "a b  c\n\nd"), (None, "no id")]
    rows += [(100 + i, nasty(rng, rng.randint(1, 80))) for i in range(120)]
    out = piece_round_trip(docs_frame(spark, rows, extra=("n_tokens", "id", "words")), table_chars=300, run_bytes=2000)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    key = lambda r: (r[0] is None, r)                            # noqa: E731
    assert sorted(map(tuple, out.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert piece_round_trip(docs_frame(spark, [])).collect() == []


def test_full_outputs(spark):
    text = "Ein  Satz\nmit 漢 und \u0000 Zeichen "
    row = piece_round_trip(docs_frame(spark, [(1, text)]), with_texts=True).first()
    ids, back = library(text)
    assert [int(x) for x in row["ids"].split(",")] == ids and row["decoded"] == back == text


def test_long_texts_are_cut_into_runs(monkeypatch):
    monkeypatch.setattr(P, "_RUN", 7)
    pieces, rng = Pieces(MODEL), random.Random(2)
    for _ in range(200):
        text = nasty(rng, 60)
        words = [w for run in pieces.words(text) for w in run]
        assert "".join(words) == pieces.whole.normalize(text)
        assert sum(pieces.segment(words), []) == library(text)[0]


def test_missing_model(spark):
    with pytest.raises(Exception):
        piece_round_trip(docs_frame(spark, [(1, "a")]), "missing.model").collect()
