import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import docs_frame, random_text, vocabulary
from tidemark.llm.tokens import safe_pieces, token_counts


def reference(text):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return len(tok.encode(text or "", add_special_tokens=False).ids)


def test_whole_texts(spark):
    rng = random.Random(3)
    long = random_text(rng, vocabulary(), 9000)
    rows = [(1, "a b  c\n\nd"), (2, None), (3, ""), (4, long), (5, "x" * 70_000), (6, " " * 5000), (7, "<|endoftext|> a<|endoftext|>"),
            (8, "it's 漢字 　   é!"), (1, "a b  c\n\nd")]
    out = token_counts(docs_frame(spark, rows, extra=("n_tokens", "id")), piece_chars=500, batch_bytes=4000, table_chars=3000)
    got = sorted(map(tuple, out.collect()))
    want = sorted((i, len((t or "").encode()), reference(t), reference(t) > 1024) for i, t in rows)
    assert got == want
    assert token_counts(docs_frame(spark, [])).collect() == []


def test_safe_pieces_keep_the_count():
    rng = random.Random(5)
    al = [*"ab 's\n\t1é漢!", " ", "　", "\x1f", "\x85", "<|endoftext|>", "'ll "]
    for _ in range(400):
        text = "".join(rng.choice(al) for _ in range(60))
        assert "".join(safe_pieces(text)) == text and sum(map(reference, safe_pieces(text))) == reference(text)
        parts = safe_pieces(text, 5)
        assert "".join(parts) == text
        assert sum(reference(p) for p in parts) == reference(text) if len(parts) > 1 else True
        if _ > 60:
            break


def test_sentencepiece_file(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = "hello there, all of  you"
    out = token_counts(docs_frame(spark, [(1, text)]), "piece_bpe_32k.model", piece_chars=5).first()
    assert out["n_tokens"] == len(sp.encode(text))
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = token_counts(docs_frame(spark, [(1, text)]), "word_bpe_49k.json", piece_chars=5).first()
    assert out["n_tokens"] == len(word.encode(text, add_special_tokens=False).ids)
    with pytest.raises(Exception):
        token_counts(docs_frame(spark, [(1, "a")]), "missing.json").collect()
