"""SentencePiece encoding and decoding with the pieces of a given model.

An Aho-Corasick automaton over the pieces reads a text once; at each place it follows the output links to every piece that ends
there, and the best score up to that place is relaxed from the place where the piece starts (Viterbi). Characters in no piece cost
the lowest score less 10 and become byte pieces.

A space only ever begins pieces (checked when the model is loaded), so the best segmentation of a text is that of its words one
after the other; words repeat, so each task keeps those it has segmented. A model for which this does not hold is read text by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from displace.llm.textbytes import spare_name

#: The mark for a space, the penalty for a character in no piece.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a task keeps.
KEEP = 300_000


@dataclass(frozen=True)
class Model:
    """What is needed of a model's file: pieces with their scores and ids; the ids of the 256 byte pieces, or the unknown id."""

    pieces: tuple[tuple[str, float, int], ...]
    byte_ids: tuple[int, ...]
    unknown: int

    @staticmethod
    def load(path: str) -> Model:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(m.get_piece_size())
        plain = tuple((m.id_to_piece(i), m.get_score(i), i) for i in every if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)))
        bytes_ = {m.id_to_piece(i): i for i in every if m.is_byte(i)}
        return Model(plain, tuple(bytes_.get(f"<0x{b:02X}>", m.unk_id()) for b in range(256)), m.unk_id())


class Coder:
    def __init__(self, model: Model):
        self.automaton = ahocorasick.Automaton()
        self.text = {}
        singles = set()
        for piece, score, i in model.pieces:
            self.automaton.add_word(piece, (len(piece), score, i))
            self.text[i] = piece.replace(MARK, " ").encode()
            if len(piece) == 1:
                singles.add(piece)
        self.automaton.make_automaton()
        self.byte_ids, self.unknown = model.byte_ids, model.unknown
        for b, i in enumerate(model.byte_ids):
            if i != model.unknown:
                self.text[i] = bytes([b])
        self.text[model.unknown] = " ⁇ ".encode()
        size = 1 + max(self.text, default=0)
        self.by_id = [self.text.get(i, b"") for i in range(size)]
        self.singles = singles
        self.penalty = min((s for _, s, _ in model.pieces), default=0.0) - UNKNOWN_PENALTY
        self.by_word = all(MARK not in p.lstrip(MARK) for p, _, _ in model.pieces)
        self.lines_apart = not any("\n" in p for p, _, _ in model.pieces)
        self.words: dict[str, bytes] = {}

    def bytes_of(self, char: str) -> list[int]:
        ids = [self.byte_ids[b] for b in char.encode()]
        return [self.unknown] if self.unknown in ids else ids

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation of a marked text; ties: the longer last piece."""
        n = len(text)
        score, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        done = 0  # places up to here have their one-character edges

        def unknowns(until: int):
            for k in range(done, until):
                if text[k] not in self.singles and score[k] + self.penalty > score[k + 1]:
                    score[k + 1], back[k + 1] = score[k] + self.penalty, (1, None)

        for end, (size, gain, i) in self.automaton.iter(text):
            if end > done:
                unknowns(end)
                done = end
            got = score[end + 1 - size] + gain
            if got > score[end + 1]:
                score[end + 1], back[end + 1] = got, (size, i)
        unknowns(n)
        out, at = [], n
        while at:
            size, i = back[at]
            out += [i] if i is not None else self.bytes_of(text[at - 1])[::-1]
            at -= size
        return out[::-1]

    def segment(self, spaces: int, word: str) -> bytes:
        """Ids, as 32-bit numbers, of `spaces` spaces and a word. A literal mark in the word is spelt in bytes, so that it comes back."""
        ids: list[int] = []
        for k, part in enumerate(word.split(MARK)):
            ids += self.bytes_of(MARK) if k else []
            marked = (MARK * spaces if k == 0 else "") + part
            ids += self.best(marked) if marked else []
        return np.array(ids, "<i4").tobytes()

    def _word(self, spaces: int, word: str) -> bytes:
        key = word if spaces == 1 else f"{spaces} {word}"
        got = self.words.get(key)
        if got is None:
            got = b""
            if self.lines_apart and "\n" in word:  # a line feed is in no piece
                feed = np.array(self.bytes_of("\n"), "<i4").tobytes()
                lines = word.split("\n")
                return feed.join([self._word(spaces, lines[0]), *[self._word(0, x) if x else b"" for x in lines[1:]]])
            got = self.segment(spaces, word)
            if len(self.words) >= KEEP:
                self.words.clear()
            self.words[key] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text, as 32-bit numbers. A space is put before it, as the models expect; an empty text has none."""
        if not text:
            return b""
        if not self.by_word:
            return self.segment(1, text.replace(" ", MARK)) if MARK not in text else np.array(self.best(MARK + text.replace(" ", MARK)), "<i4").tobytes()
        out, spaces, word = [], 0, self._word
        known = self.words
        for part in text.split(" "):
            spaces += 1
            if part:
                got = known.get(part) if spaces == 1 else None
                out.append(got if got is not None else word(spaces, part))
                spaces = 0
        if spaces:
            out.append(word(spaces, ""))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.by_id.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


_CODERS: dict[int, Coder] = {}


def coder(model: Model) -> Coder:
    """One automaton per worker process."""
    key = hash(model)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(model)
    return _CODERS[key]


def _ids_array(parts: list[bytes | None]) -> pa.Array:
    sizes = np.array([0 if p is None else len(p) // 4 for p in parts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(p for p in parts if p))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def encode_texts(docs: DataFrame, model: Model, text: str = "text", ids: str = "piece_ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of each whole text and, with `decoded`, the text that they decode to. Null and empty texts have no ids and decode
    to the empty text; other columns and repeated rows stay as they are."""
    kept = docs.drop(ids, *([decoded] if decoded else []))
    names = kept.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [own.encode(t or "") for t in part.column(len(names)).to_pylist()]
                columns = [*[part.column(i) for i in range(len(names))], _ids_array(found)]
                if decoded:
                    columns.append(pa.array([own.decode(np.frombuffer(f, "<i4").tolist()) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, ids, *([decoded] if decoded else [])])

    schema = StructType([*kept.schema.fields]).add(ids, ArrayType(IntegerType()))
    schema = schema.add(decoded, StringType()) if decoded else schema
    return kept.withColumn(spare_name("_text", names), F.col(text)).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, model: Model, ids: str = "piece_ids", text: str = "text") -> DataFrame:
    """rows with the text that each array of ids decodes to; null arrays decode to null."""
    kept = rows.drop(text)
    names = kept.columns
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared.value)
        for batch in batches:
            found = [None if v is None else own.decode(v) for v in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*names, text])

    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add(text, StringType()))


def pieces_digest(coded: DataFrame, id_col: str = "doc_id", text: str = "text", ids: str = "piece_ids", decoded: str = "decoded") -> DataFrame:
    return coded.select(
        id_col,
        F.size(ids).cast("long").alias("n_pieces"),
        F.xxhash64(ids).alias("ids_hash"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
        (F.col(decoded) == F.coalesce(F.col(text), F.lit(""))).alias("exact"),
    )
