"""SentencePiece encoding and decoding with a merge-type (BPE) model, by a table over prefixes.

The BPE encoding of a string's prefix ends in a token that is unique for that prefix. So encoding keeps one token per
prefix: an Aho-Corasick automaton names the pieces that end there, and the right one is the piece that is compatible
with the last token of the prefix before it. Two tokens are compatible when merging the characters of both gives back
exactly these two; the answers are kept by pair. Walking from the last prefix backwards yields the ids.

Before that, the text is cut where no piece can cross: a piece never holds a space mark after another character, nor a
character outside the model's alphabet, nor a pair of neighbours that occurs in no piece. The parts are encoded alone and
remembered in a bounded memo, so frequent words are looked up.

The ids column is binary: little-endian unsigned 32-bit integers, with begin and end ids where asked. Only the pieces and
scores of the model (a fixed size) are broadcast; rows are never shuffled.

Edge cases: a null text counts as empty, which has the begin and end id only. Characters outside the alphabet become
their UTF-8 bytes' pieces. Texts of any length are encoded whole. Other columns pass through; the output column replaces
one of the same name.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small

SPACE = "▁"
#: Entries of each of the two generations of a memo, and the longest part that is remembered.
MEMO = 150_000
LONGEST = 64


def model_tables(model_file: str) -> dict:
    """What encoding and decoding need of a model file: pieces, scores and the special ids."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    return {
        "name": hashlib.sha256(model.serialized_model_proto()).hexdigest(),
        "pieces": [model.id_to_piece(i) for i in ids],
        "scores": [model.get_score(i) for i in ids],
        "plain": [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in ids],
        "bytes": {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)},
        "bos": model.bos_id(),
        "eos": model.eos_id(),
        "unk": model.unk_id(),
    }


class _Memo(dict):
    """Answers by key in two generations: when the new one is full it becomes the old one, whose entries move up when used."""

    def __init__(self, make: Callable, most: int = MEMO):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class _Parts(_Memo):
    """As _Memo, without the longest keys."""

    def __missing__(self, key):
        return super().__missing__(key) if len(key) <= LONGEST else self.make(key)


class Encoder:
    def __init__(self, model: dict):
        self.model = model
        self.ids = {p: i for i, (p, plain) in enumerate(zip(model["pieces"], model["plain"], strict=True)) if plain}
        self.length = [len(p) for p in model["pieces"]]
        self.together = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        alphabet = {c for p in self.ids for c in p} - {SPACE}
        known = "".join(map(re.escape, sorted(alphabet)))
        self.parts = re.compile(f"{SPACE}*[{known}]+|{SPACE}+|.", re.DOTALL)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.memo = _Parts(self._part)
        #: By left id * number of pieces + right id; and by id, whether a piece is the encoding of its own text.
        self.size = len(model["pieces"])
        self.fits = _Memo(lambda pair: self._fit(*divmod(pair, self.size)))
        self.alone = _Memo(lambda i: self._merge(model["pieces"][i]) == [i], self.size + 1)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        return b"".join(map(self.memo.__getitem__, self.parts.findall(SPACE + text.replace(" ", SPACE))))

    def _part(self, part: str) -> bytes:
        together = self.together
        ends = [k for k in range(1, len(part)) if part[k - 1 : k + 1] not in together]
        if not ends:
            return self._whole(part)
        # Where neighbours occur together in no piece, the parts are encoded alone; they come up again in other words.
        known = self.memo
        return b"".join([known[part[a:b]] for a, b in zip([0, *ends], [*ends, len(part)], strict=True)])

    def _whole(self, part: str) -> bytes:
        found = self._prefixes(part)
        return array("I", self._spelled(part) if found is None else found).tobytes()

    def _prefixes(self, text: str) -> list[int] | None:
        """The table's walk: None where the text has a character that is no piece."""
        whole = self.ids.get(text)
        if whole is not None and self.alone[whole]:
            return [whole]
        last = [-1] * len(text)
        length, fits, size, end_of = self.length, self.fits, self.size, -1
        for end, piece in self.automaton.iter(text):
            if end == end_of:
                continue
            before = end - length[piece]
            if before < 0:
                if self.alone[piece]:
                    last[end], end_of = piece, end
            elif (left := last[before]) >= 0 and fits[left * size + piece]:
                last[end], end_of = piece, end
        out, at = [], len(text) - 1
        while at >= 0:
            if last[at] < 0:
                return None
            out.append(last[at])
            at -= length[last[at]]
        return out[::-1]

    def _fit(self, left: int, right: int) -> bool:
        return self._merge(self.model["pieces"][left] + self.model["pieces"][right]) == [left, right]

    def _merge(self, text: str) -> list[int]:
        """Plain BPE on a short string: the best-scored neighbours are joined first, the leftmost of equals."""
        parts, ids, scores = list(text), self.ids, self.model["scores"]
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                return [x for p in parts for x in ([ids[p]] if p in ids else self._spelled(p))]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _spelled(self, text: str) -> list[int]:
        """Characters as pieces, or as the pieces of their bytes."""
        spell = self.model["bytes"]
        return [x for c in text for x in ([self.ids[c]] if c in self.ids else [spell[b] for b in c.encode()] if spell else [self.model["unk"]])]


class Decoder:
    def __init__(self, model: dict):
        raw = {i: bytes([b]) for b, i in model["bytes"].items()}
        self.raw = raw
        self.out = [raw.get(i, p.replace(SPACE, " ").encode() if plain else b"") for i, (p, plain) in enumerate(zip(model["pieces"], model["plain"], strict=True))]
        self.marked = {i for i, (p, plain) in enumerate(zip(model["pieces"], model["plain"], strict=True)) if plain and p.startswith(SPACE)}
        self.out[model["unk"]] = " ⁇ ".encode()

    def decode(self, ids: bytes) -> str:
        seq = np.frombuffer(ids, "<u4").tolist()
        joined = b"".join(map(self.out.__getitem__, seq))
        try:
            text = joined.decode()
        except UnicodeDecodeError:
            text = self._mended(seq)
        # The mark that encoding puts before a text is dropped with the first piece, if that is an ordinary one.
        first = next((i for i in seq if i in self.raw or self.out[i]), -1)
        return text[1:] if first in self.marked else text

    def _mended(self, seq: list[int]) -> str:
        """Byte pieces that are no UTF-8 give one replacement character for each byte."""
        text, run = [], b""
        for i in [*seq, None]:
            if i in self.raw:
                run += self.raw[i]
                continue
            while run:
                for k in range(min(4, len(run)), 0, -1):
                    try:
                        text.append(run[:k].decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    text.append("�")
                    k = 1
                run = run[k:]
            if i is not None:
                text.append(self.out[i].decode())
        return "".join(text)


def _adding(df: DataFrame, source: str, column: str, kind: T.DataType, arrow: pa.DataType, start: Callable) -> DataFrame:
    """df with a column made row by row from another; start() is called once in each task and gives the function."""
    fields = [f for f in df.schema.fields if f.name != column]
    schema = T.StructType([*fields, T.StructField(column, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = None
        for batch in small(batches):
            make = make or start()
            values = batch.column(batch.schema.get_field_index(source))
            kept = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([make(v.as_py()) for v in values], arrow)], names=[*kept, column])

    return df.mapInArrow(run, schema)


_loaded: dict[type, tuple[str, object]] = {}


def _once(kind: type, shared) -> object:
    """A worker process keeps the encoder and the decoder of the last model only, over all of its tasks."""
    name = shared.value["name"]
    if _loaded.get(kind, ("",))[0] != name:
        _loaded.pop(kind, None)
        _loaded[kind] = name, kind(shared.value)
    return _loaded[kind][1]


def encode(df: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids", begin: bool = True, end: bool = True) -> DataFrame:
    """df with the ids of each whole text."""
    model = model_tables(model_file)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        encoder = _once(Encoder, shared)
        head, tail = (np.array([model_id] * on, "<u4").tobytes() for model_id, on in ((shared.value["bos"], begin), (shared.value["eos"], end)))
        return lambda text: head + encoder.encode(text or "") + tail

    return _adding(df.withColumn(text_col, F.col(text_col).cast("string")), text_col, ids_col, T.BinaryType(), pa.binary(), start)


def decode(df: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the text of each row's ids. Null ids count as none."""
    shared = df.sparkSession.sparkContext.broadcast(model_tables(model_file))

    def start():
        decoder = _once(Decoder, shared)
        return lambda ids: decoder.decode(ids or b"")

    return _adding(df, ids_col, text_col, T.StringType(), pa.string(), start)
