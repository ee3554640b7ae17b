"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies with byte fallback.

Encoding keeps an agenda of adjacent symbol pairs ordered by score, then by position, and merges
the best until none is left. No piece of such a vocabulary has a space mark after another
character (checked on loading), so no merge crosses the start of a word; nor does one join signs
to letters where no piece holds the two side by side (found on loading). The parts between such
places are encoded one by one and remembered in a cache of bounded size. Every `check_every`-th row of each Arrow batch is
held against the sentencepiece library, ids and decoded text both; a difference raises.

Edge cases: null and empty texts have no tokens and decode to ""; a text of any length is encoded
whole; repeated rows and ties (equal scores: the leftmost pair first) give equal results; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

MARK = "▁"
CACHE_WORDS = 1 << 19
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """A vocabulary read through the sentencepiece library; encoding and decoding are done here."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.vocab_size()
        self.ids, self.rank, self.bytes_of, self.byte_ids = {}, {}, [b""] * n, [0] * 256
        self.is_byte, self.unknown = [False] * n, self.library.unk_id()
        scored = []
        for i in range(n):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.is_byte[i], self.bytes_of[i] = i, True, bytes([value])
            elif self.library.is_unknown(i):
                self.bytes_of[i] = self.library.decode([i]).encode()
            elif not self.library.is_control(i):
                self.ids[piece] = i
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                scored.append((-self.library.get_score(i), piece))
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} crosses the start of a word")
        # equal scores share a rank: then the leftmost pair goes first
        last, rank = None, -1
        for score, piece in sorted(scored):
            rank += score != last
            last, self.rank[piece] = score, rank
        self.cache: dict[str, tuple[int, ...]] = {}
        # the largest set of ASCII signs that no piece holds beside a character outside it, but for a mark before
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        signs = {c for p in self.ids for c in p if c.isascii() and not c.isalnum()} | {"\n", "\t"}
        while outside := {c for x in pairs for c in x if c in signs and not all(y in signs or y == MARK for y in x)}:
            signs -= outside
        inner = "".join(map(re.escape, sorted(signs)))
        self._words = re.compile(f"{MARK}*[{inner}]+|{MARK}*[^{MARK}{inner}]+|{MARK}+")

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word by the agenda of adjacent pairs."""
        rank, n = self.rank, len(word)
        symbols: list[str | None] = list(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i, i + 1, word[i : i + 2]) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, left, right, joined = heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or after[left] != right or len(a) + len(b) != len(joined):
                continue  # one of the two has been merged meanwhile
            symbols[left], symbols[right] = joined, None
            after[left] = beyond = after[right]
            if beyond < n:
                before[beyond] = left
                pair = joined + symbols[beyond]
                if (r := rank.get(pair)) is not None:
                    heappush(agenda, (r, left, beyond, pair))
            if (prior := before[left]) >= 0:
                pair = symbols[prior] + joined
                if (r := rank.get(pair)) is not None:
                    heappush(agenda, (r, prior, left, pair))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                i = self.ids.get(s)
                if i is None:
                    out.extend(self.byte_ids[x] for x in s.encode())
                else:
                    out.append(i)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without begin or end."""
        if not text:
            return []
        cache, out = self.cache, []
        extend = out.extend
        for word in self._words.findall(MARK + text.replace(" ", MARK)):
            ids = cache.get(word)
            if ids is None:
                ids = self.merge(word)
                if len(word) <= 64:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[word] = ids
            extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: one leading space goes, runs of byte pieces that are no UTF-8 become U+FFFD byte by byte."""
        joined = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            text = joined.decode()
        except UnicodeDecodeError:
            text = "".join(self._decoded_runs(ids))
        first = next((i for i in ids if not self.library.is_control(i)), None) if ids else None
        return text[1:] if first is not None and not self.is_byte[first] and first != self.unknown and text[:1] == " " else text

    def _decoded_runs(self, ids: list[int]) -> Iterator[str]:
        run = b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.bytes_of[i]
                continue
            while run:
                size = 1 if run[0] < 0x80 else 2 if run[0] >> 5 == 6 else 3 if run[0] >> 4 == 14 else 4 if run[0] >> 3 == 30 else 1
                try:
                    yield run[:size].decode()
                    run = run[size:]
                except UnicodeDecodeError:
                    yield "�"
                    run = run[1:]
            if i is not None:
                yield self.bytes_of[i].decode()


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The vocabulary at path, loaded once in each process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) with the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in slices(batches, 1, 4 << 20):
            ids = pa.array([model.encode(x or "") for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            texts = pa.array([model.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, model_path: str, check_every: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text; digests of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        decimal = [str(i) for i in range(len(model.bytes_of))].__getitem__
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in slices(batches, 1, 4 << 20):
            rows = []
            for k, (ident, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                ids = model.encode(text or "")
                decoded = model.decode(ids)
                if check_every and k % check_every == 0 and (ids != model.library.encode(text or "") or decoded != model.library.decode(ids)):
                    raise AssertionError(f"document {ident}: not what the sentencepiece library gives")
                rows.append((ident, len(ids), hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
