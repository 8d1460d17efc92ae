"""Token counts of whole texts with a public tokenizer.

Texts are encoded in Arrow functions that return lengths only.  Within a task
the texts are cut at safe boundaries into chunks, and a table tells the tokens of every
chunk met before; the others are encoded in groups of about ``batch_bytes`` and enter the
table.  The table is emptied once it holds ``table_chars`` characters, so neither it nor
a call of the library grows with the partition, however long a text is.

A safe boundary is a single space with a non-space character on either side.
The byte-level pattern starts a new piece there in any case (no alternative
continues from a non-space character into a space, and the lookahead of the
white-space alternative only looks behind white space), no special string holds
a space, and merges never cross pieces; so the counts of the chunks add up to
the count of the whole text.  A text without such a boundary is one chunk.
For vocabularies with another pre-tokenizer, texts are encoded whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import slices

_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")


def safe_pieces(text: str, limit: int = 0) -> list[str]:
    """Cut a text at safe boundaries into parts of more than ``limit`` characters
    (the last may be shorter); the boundary's space starts the next part."""
    if len(text) <= limit:
        return [text]
    if not limit:
        first, *rest = _SAFE.split(text)
        return [first, *[" " + x for x in rest]]
    out, start = [], 0
    while len(text) - start > limit:
        m = _SAFE.search(text, start + limit)
        if m is None:
            break
        out.append(text[start:m.start()])
        start = m.start()
    out.append(text[start:])
    return out


class ChunkTable:
    """Tokens of the chunks met so far."""

    def __init__(self, encode, batch_bytes: int):
        self.encode, self.batch_bytes = encode, batch_bytes
        self.clear()

    def clear(self) -> None:
        self.tokens: dict[str, int] = {}
        self.chars = 0

    def learn(self, chunks: list[str]) -> None:
        """Count the chunks that are not in the table, in groups of about ``batch_bytes``."""
        group, held = [], 0
        for c in dict.fromkeys(chunks):
            if c not in self.tokens:
                size = len(c) * 4                    # bytes at most
                if held and held + size > self.batch_bytes:
                    self._add(group)
                    group, held = [], 0
                group.append(c)
                held += size
        if group:
            self._add(group)

    def _add(self, group: list[str]) -> None:
        self.tokens.update(zip(group, self.encode(group)))
        self.chars += sum(map(len, group))

    def total(self, chunks: list[str]) -> int:
        return sum(map(self.tokens.__getitem__, chunks))


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 1024, batch_bytes: int = 1 << 20,
                 piece_chars: int = 1 << 15, table_chars: int = 4 << 20) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit): UTF-8 bytes and tokens of each whole text.

    ``vocabulary`` names a file of the public tokenizers package: ``.json`` is
    read by tokenizers, ``.model`` by sentencepiece.  No special tokens are
    added, special strings inside texts keep the library's default, nothing is
    truncated or padded.  ``limit``: over_limit is n_tokens > limit.  Texts of more than
    ``piece_chars`` characters are first cut into parts of that size.

    NULL counts as an empty text (0 bytes, 0 tokens); repeated rows give
    repeated results; an empty table an empty one; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, splits = _encoder(vocabulary)
        table = ChunkTable(encode, batch_bytes)
        for b in slices(batches, 1, 1 << 20):
            tokens = []
            for t in b.column(1).to_pylist():
                n = 0
                for part in safe_pieces(t, piece_chars) if t and splits else [t] if t else []:
                    chunks = safe_pieces(part) if splits else [part]
                    table.learn(chunks)
                    n += table.total(chunks)
                    if table.chars > table_chars:
                        table.clear()
                tokens.append(n)
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(tokens, pa.int64())],
                                             names=["id", "n_bytes", "n_tokens"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))


def _encoder(vocabulary: str):
    """(texts -> numbers of tokens, whether texts may be cut at safe boundaries), by the library
    that the file is for."""
    import os

    import public_tokenizers
    path = public_tokenizers.path(vocabulary)
    if vocabulary.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)], False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    pre = parts.get("pre_tokenizer") or {}
    splits = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
              and not parts.get("normalizer") and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip")
                                                          for t in parts.get("added_tokens", ())))
    encode = getattr(tok, "encode_batch_fast", tok.encode_batch)      # fast: without offsets
    return lambda texts: [len(x.ids) for x in encode(texts, add_special_tokens=False)], splits
