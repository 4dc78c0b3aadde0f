"""SentencePiece models on the Tokenizers library: encoding and decoding of whole texts.

The model file is a protobuf; ``read_model`` parses its wire format, and ``build`` makes a
Tokenizers pipeline that gives the ids of the SentencePiece library: the compiled normaliser table,
white-space rules, the marker U+2581 for spaces, unigram scores or the merge order of a BPE model, and byte
fallback for what no piece covers.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
# Fixed values of the public model format: field numbers, piece types, model types.
PIECES, TRAINER, NORMALISER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
BATCH_CHARS = 1 << 20
MAX_CACHED_WORDS = 250_000
CHUNKS = re.compile(" +[^ ]*|[^ ]+")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    whitespace_suffix: bool = False
    unk_surface: str = " ⁇ "
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of one protobuf message: integers, or raw bytes of any other kind."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            if wire == 2:
                size, at = _varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
            else:
                raise ValueError(f"wire type {wire} in the model file")
            if at + size > len(data):
                raise ValueError("the model file is cut short")
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == PIECES:
            piece, score, kind = "", 0.0, NORMAL
            for part, x in _fields(value):
                if part == 1:
                    piece = x.decode()
                elif part == 2:
                    score = float(np.frombuffer(x, "<f4")[0])
                elif part == 3:
                    kind = x
            model.pieces.append((piece, score, kind))
        elif number == TRAINER:
            for part, x in _fields(value):
                if part == 3:
                    model.kind = x
                elif part == 35:
                    model.byte_fallback = bool(x)
                elif part == 24:
                    model.whitespace_suffix = bool(x)
                elif part == 44:
                    model.unk_surface = x.decode()
        elif number == NORMALISER:
            for part, x in _fields(value):
                if part == 2:
                    model.charsmap = x
                elif part == 3:
                    model.dummy_prefix = bool(x)
                elif part == 4:
                    model.remove_extra_spaces = bool(x)
                elif part == 5:
                    model.escape_spaces = bool(x)
    if not model.pieces:
        raise ValueError("no pieces in the model file")
    return model


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, best score first: the merge table a BPE model implies."""
    scores = {piece: score for piece, score, kind in pieces if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, score in scores.items():
        for cut in range(1, len(piece)):
            if piece[:cut] in scores and piece[cut:] in scores:
                found.append((-score, cut, piece[:cut], piece[cut:]))
    found.sort(key=lambda x: x[:2])
    return [(left, right) for _, _, left, right in found]


def words_apart(model: Model) -> bool:
    """No piece has a marker after another character, so none spans a word's start: words can be encoded apart."""
    return not any(SPACE in piece.lstrip(SPACE) for piece, _, kind in model.pieces if kind == NORMAL)


def build(model: Model):
    """A Tokenizers tokenizer with the model's ids."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.whitespace_suffix or not model.escape_spaces:
        raise ValueError("models with spaces as suffix or unescaped spaces are not supported")
    if any(kind == USER_DEFINED for _, _, kind in model.pieces):
        raise ValueError("models with user-defined pieces are not supported")
    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
    # Control and unused pieces keep their id but must not match text, so they get names no text can spell.
    names = [piece if kind in (NORMAL, UNKNOWN, BYTE) else f"{i}{piece}" for i, (piece, _, kind) in enumerate(model.pieces)]
    if model.kind == UNIGRAM:
        low = min((score for _, score, kind in model.pieces if kind == NORMAL), default=0.0)
        vocabulary = [(name, score if kind == NORMAL else low - 1e6) for name, (_, score, kind) in zip(names, model.pieces, strict=True)]
        core = models.Unigram(vocabulary, unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        ids = {name: i for i, name in enumerate(names)}
        core = models.BPE(ids, merges_of(model.pieces), unk_token=names[unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is not supported")
    tokenizer = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra_spaces:
        steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Strip(left=True, right=True)]
    steps.append(normalizers.Replace(" ", SPACE))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if words_apart(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix or model.remove_extra_spaces else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer


class Codec:
    """One model in one Python worker: encodes and decodes batches of whole texts."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = read_model(data)
        self.tokenizer = build(self.model)
        self.check = sentencepiece.SentencePieceProcessor(model_proto=data)
        plain = not self.model.charsmap and not self.model.remove_extra_spaces and self.model.dummy_prefix
        self.by_word = plain and words_apart(self.model)
        if self.by_word:
            from tokenizers import Tokenizer

            self.words = Tokenizer(self.tokenizer.model)
        self.known: dict[str, bytes] = {}
        self.unequal: set[str] = set()
        self.surface = [self._surface(piece, kind) for piece, _, kind in self.model.pieces]

    def _surface(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return self.model.unk_surface.encode()
        return b"" if kind == CONTROL else piece.replace(SPACE, " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bool]]:
        """Per text its ids as 32-bit integers, and whether the SentencePiece library gives the same."""
        texts = [text.encode("utf-8", "replace").decode() for text in texts]
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            for one, other in zip(found, self.check.encode(texts, num_threads=1), strict=True):
                yield np.array(one.ids, "<i4").tobytes(), one.ids == other
            return
        split = [self._split(text) for text in texts]
        self._learn({word for words in split for word in words})
        for words in split:
            yield b"".join(map(self.known.__getitem__, words)), not self.unequal or self.unequal.isdisjoint(words)

    def _split(self, text: str) -> list[str]:
        """The words, each with the spaces before it; the first space of a run is left to the marker."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [chunk[1:] for chunk in CHUNKS.findall(" " + text)]
        return text.split(" ")

    def _learn(self, words: set[str]) -> None:
        """Encodes words not met before, all in one multithreaded call, and compares them with the other library."""
        if len(self.known) + len(words) > MAX_CACHED_WORDS:
            self.known, self.unequal = {}, set()
        new = [word for word in words if word not in self.known]
        encoded = self.words.encode_batch_fast([SPACE + word.replace(" ", SPACE) for word in new], add_special_tokens=False)
        # An empty word is a single trailing space, which the other library can only see behind a marker of its own.
        theirs = self.check.encode([word or " " for word in new], num_threads=1)
        for word, mine, other in zip(new, encoded, theirs, strict=True):
            ids = mine.ids
            self.known[word] = np.array(ids, "<i4").tobytes()
            if word and ids != other:
                self.unequal.add(word)

    def decode(self, ids: list[int]) -> str:
        """The text of one sequence; unknown ids raise, broken UTF-8 from byte pieces becomes U+FFFD."""
        data = b"".join(map(self.surface.__getitem__, ids))
        if (self.model.dummy_prefix or self.model.remove_extra_spaces) and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(data: bytes, threads: int) -> Codec:
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    return Codec(data)


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``BATCH_CHARS`` characters, one row at least."""
    start = size = 0
    lengths = [len(x.as_py()) if x.is_valid else 0 for x in batch.column(column)]
    for i, n in enumerate(lengths):
        size += n
        if size >= BATCH_CHARS:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < len(lengths):
        yield batch.slice(start)


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", threads: int | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens, parity, round_trip) per row of ``docs``.

    ``parity`` says that the SentencePiece library gives the same ids for every word of the text (for the
    whole text where words can't be encoded apart); ``round_trip`` that decoding the ids gives the text as
    the model normalises it (the marker reads as a space).  Null text gives null ids and no tokens, empty text an empty
    list; both flags are then true.  Repeated rows and null ids are encoded like any other; other columns are not read.
    ``threads`` of the library per task default to spark.task.cpus.  The model file is read on the driver and sent along.
    """
    session = docs.sparkSession
    with open(model_path, "rb") as file:
        data = file.read()
    read_model(data)
    shared = session.sparkContext.broadcast(data)
    threads = threads or int(session.conf.get("spark.task.cpus", "1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, threads)
        for whole in batches:
            for batch in _portions(whole, 1):
                texts = batch.column(1).to_pylist()
                found = iter(own.encode([x for x in texts if x is not None]))
                parts, sizes, same, back = [], [], [], []
                for text in texts:
                    raw, equal = (b"", True) if text is None else next(found)
                    parts.append(raw)
                    sizes.append(len(raw) // 4)
                    same.append(equal)
                    back.append(text is None or not own.by_word or own.decode(np.frombuffer(raw, "<i4").tolist()) == text.replace(SPACE, " "))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                values = pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, values, mask=pa.array([x is None for x in texts]))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column(0), "ids": ids, "n_tokens": pa.array(sizes, pa.int64()), "parity": pa.array(same), "round_trip": pa.array(back)}
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, parity boolean, round_trip boolean")


def decode(encoded: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) from the ids of ``encode``; null ids give null text, an empty list an empty one."""
    with open(model_path, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, 1)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
