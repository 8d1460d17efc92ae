"""SentencePiece encoding and decoding over a table of distinct marked words.

Every piece of the vocabulary has its white-space markers in front (``▁▁word``,
never ``word▁``), so no merge reaches over the place where a marker follows
another character.  A text cut at these places is a row of marked words that
are segmented each for itself, and equal words equally.

A task keeps a table of the distinct marked words it has met.  Of each run of texts the
words that are not in it yet are segmented and decoded by the library, each once; then
every document joins the ids, their number and the surface of its words by their positions
in the table.  The table is emptied between two runs once it holds ``table_chars``
characters, so its size has a bound, however many different words a partition holds.  No
row leaves its task: nothing is shuffled, and a lost task is repeated alone.

A model whose pieces can cross a marker is refused: its words cannot be segmented alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import slices

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_EDGE = re.compile(f"[^{MARK}](?={MARK})")
_RUN = 1 << 20                       # characters of a text that are cut into words at a time
# appended to a model file it overrides the normalizer there: name "identity", no character
# map, no dummy prefix, white space kept (fields 1 to 4 of field 3 of the model message)
_PLAIN = b"\x1a\x10\x0a\x08identity\x12\x00\x18\x00\x20\x00"


class Pieces:
    """The library's processor of a model, and one that takes marked words as they are."""

    def __init__(self, model: str):
        import public_tokenizers
        import sentencepiece
        with open(public_tokenizers.path(model), "rb") as f:
            proto = f.read()
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto + _PLAIN)
        n = self.whole.vocab_size()
        odd = next((p for p in map(self.whole.id_to_piece, range(n)) if _EDGE.search(p)), None)
        if odd is not None:
            raise ValueError(f"piece {odd!r} of {model} crosses a white-space marker")
        # decoding drops one marker at the very start where the model adds one in encoding
        self.drops_first = self.whole.decode(self.whole.encode("a")) != self.plain.decode(self.whole.encode("a"))

    def words(self, text: str) -> Iterator[list[str]]:
        """The marked words of a text, in runs."""
        normal = self.whole.normalize(text)
        at = 0
        while at < len(normal):
            m = _EDGE.search(normal, at + _RUN) if len(normal) - at > _RUN else None
            end = m.end() if m else len(normal)
            yield _WORD.findall(normal, at, end)
            at = end

    def segment(self, words: list[str]) -> list[list[int]]:
        return self.plain.encode(words, num_threads=1)

    def surface(self, ids: list[int]) -> str:
        return self.plain.decode(ids)


class WordTable:
    """Distinct marked words with their ids (decimal, comma-joined), number of ids and surface."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids: list[str] = []
        self.sizes: list[int] = []
        self.surfaces: list[str] = []
        self.chars = 0

    def places(self, text: str) -> np.ndarray:
        """Positions of a text's words; words met for the first time wait for ``fill``."""
        known = self.place
        runs = [np.fromiter([known.setdefault(w, len(known)) for w in words], np.int32, len(words))
                for words in self.pieces.words(text)]
        return np.concatenate(runs) if runs else np.empty(0, np.int32)

    def fill(self) -> None:
        fresh = list(islice(self.place, len(self.ids), None))
        for ids in self.pieces.segment(fresh):
            self.ids.append(",".join(map(str, ids)))
            self.sizes.append(len(ids))
            self.surfaces.append(self.pieces.surface(ids))
        self.chars += sum(map(len, fresh))

    def join(self, at: np.ndarray) -> tuple[int, str, str]:
        """(number of ids, ids, decoded text) of the words at these positions."""
        at = at.tolist()
        text = "".join([self.surfaces[w] for w in at])
        if self.pieces.drops_first and text.startswith(" "):
            text = text[1:]
        return sum([self.sizes[w] for w in at]), ",".join([self.ids[w] for w in at]), text


def _encode(model: str, table_chars: int, run_bytes: int, with_texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(Pieces(model))
        for b in slices(batches, 1, run_bytes):
            if table.chars > table_chars:
                table.clear()
            found = [table.places(t) if t else np.empty(0, np.int32) for t in b.column(1).to_pylist()]
            table.fill()
            cols: list[list] = [[], [], [], [], []]
            for at in found:
                n, ids, text = table.join(at)
                row = (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text)
                for col, value in zip(cols[:5 if with_texts else 3], row):
                    col.append(value)
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][:5 if with_texts else 3]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:len(names)])],
                names=["id", *names])
    return run


def piece_round_trip(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id",
                     text_col: str = "text", table_chars: int = 4 << 20, run_bytes: int = 1 << 20,
                     with_texts: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: a text's ids as the library encodes
    the whole text, without begin or end ids, and what the library decodes from them.
    ``with_texts`` adds ``ids`` (decimal, comma-joined) and ``decoded``.

    The digests are lower-case hex SHA-256 of those two strings in UTF-8.  NULL counts as an
    empty text (0 ids, empty strings); a very long text is cut into words in runs; repeated rows
    give repeated results; an empty table gives an empty one; other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(_encode(model, table_chars, run_bytes, with_texts),
                         f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                         + (", ids string, decoded string" if with_texts else ""))
    return out.withColumnRenamed("id", id_col)
