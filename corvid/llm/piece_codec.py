"""SentencePiece encoding and decoding of merge-type (BPE) models, without the library.

The encoder walks a text once, always trying the longest piece that an
Aho-Corasick automaton finds at the present place.  A piece may follow another
only if merging the two pieces' joined text anew gives exactly these two pieces
back.  Where no piece fits, the walk steps back over the last piece and marks
the place in a bit field of failed places, so that it is never tried again.
A sequence in which all neighbours are compatible is the one that repeated
best-first merging gives, so the result is exact and the work linear.

No piece has a space mark after another character (checked when the model is
loaded), so merging never crosses the place before a run of space marks, nor that
between two characters that no piece has side by side; the segments in between
are encoded apart and remembered.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
import threading
from collections.abc import Iterator
from contextlib import contextmanager

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.llm.common import IDLE, give_back

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown piece decodes to in the library.
UNKNOWN_SURFACE = " ⁇ "


def _each_bad_byte(e: UnicodeError) -> tuple[str, int]:
    return "�", e.start + 1


codecs.register_error("corvid-each-byte", _each_bad_byte)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protobuf message: numbers and raw values."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, raw[at : at + n]
        at += n


class PieceCodec:
    """Encoder and decoder for one model; ``raw`` is the content of its file."""

    def __init__(self, raw: bytes, remembered: int = 300_000):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix, byte_fallback = True, False
        for number, value in _fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                spec = dict(_fields(value))
                byte_fallback = bool(spec.get(35, 0))
                if spec.get(3, 1) != 2:
                    raise ValueError("only merge-type (BPE) models can be encoded by merging")
                if spec.get(24, 0):
                    raise ValueError("models with the space mark at the end of words aren't supported")
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models that leave text as it is (identity, all spaces kept) are supported")
                self.dummy_prefix = bool(spec.get(3, 1))
        if USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("models with user-defined or unused pieces aren't supported")
        self.unknown_id = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a space mark after another character")
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if byte_fallback and len(self.bytes) != 256:
            raise ValueError("byte fallback without all 256 byte pieces")
        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        # characters other than letters that no piece joins with anything but each other: runs of them stand apart
        beside = {(x, y) for p in self.ids for x, y in zip(p, p[1:]) if MARK not in (x, y)}
        apart = {c for c in (*map(chr, range(128)), *(c for p in self.ids for c in p)) if not c.isalpha() and c != MARK}
        while mixed := {c for x, y in beside for c in (x, y) if (x in apart) != (y in apart)} & apart:
            apart -= mixed
        marks = "".join(map(re.escape, sorted(apart)))
        self.segments = re.compile(f"{MARK}*[^{MARK}{marks}]+|{MARK}+" + (f"(?:[{marks}]+)?|[{marks}]+" if marks else "")).findall
        self.compatible: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.shorter: dict[str, str] = {}
        self.decimal = [b"%d" % i for i in range(len(self.pieces))]
        self.spoken = [p.replace(MARK, " ") if k == NORMAL else UNKNOWN_SURFACE if k == UNKNOWN else "" for p, k in zip(self.pieces, self.kinds)]
        self.memory = _Segments(self, remembered)
        self.uses = 0

    @contextmanager
    def in_use(self, idle: float = IDLE) -> Iterator[None]:
        """What is remembered stays for the next use, and goes if none has begun ``idle`` seconds after this one.

        Spark keeps idle workers for a minute, in which their executor may need the memory for other work.
        """
        self.uses += 1
        this = self.uses
        try:
            yield
        finally:
            give_back()  # here too: Arrow's memory goes by the thread that took it
            timer = threading.Timer(idle, lambda: self.uses == this and self.forget())
            timer.daemon = True
            timer.start()

    def forget(self) -> None:
        """Give back the memory of what would only be found anew; at any time, even between two lookups."""
        self.memory.old = {}
        self.memory.clear()
        self.compatible.clear()
        give_back()

    def merged(self, text: str) -> list[str]:
        """Best-first merging as such: join the neighbours whose joined piece scores best, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, where = self.scores[k], i
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the joined text anew gives these two pieces."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) > 600_000:
                self.compatible.clear()
            known = self.compatible[left, right] = self.merged(left + right) == [left, right]
        return known

    def stands(self, piece: str) -> bool:
        """Whether merging the piece's own text gives the piece (a single character always stands)."""
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = len(piece) == 1 or self.merged(piece) == [piece]
        return known

    def next_shorter(self, piece: str) -> str:
        """The longest piece that is a prefix of this one, at the end its first character; empty for one character."""
        found = self.shorter.get(piece)
        if found is None:
            found = self.shorter[piece] = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if k == 1 or piece[:k] in self.ids), "")
        return found

    def split(self, text: str) -> list[str]:
        """The pieces of one segment, characters outside the vocabulary as they are."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, (reach, piece) in self.automaton.iter(text):
            longest[end - reach] = piece  # later ends are longer
        known, failed, out, at = self.compatible.get, bytearray(n + 1), [], 0
        piece, last = n and (longest[0] or text[0]), ""
        while at < n:
            while piece:
                if not failed[at + len(piece)]:
                    good = known((last, piece)) if last else self.stands(piece)
                    if good or good is None and self.fits(last, piece):
                        break
                piece = self.next_shorter(piece)
            if piece:
                out.append(piece)
                at += len(piece)
                last = piece
                if at < n:
                    piece = longest[at] or text[at]
            else:
                failed[at] = 1
                if not out:
                    return self.merged(text)  # not reached with a vocabulary made by merging
                gone = out.pop()
                at -= len(gone)
                last = out[-1] if out else ""
                piece = self.next_shorter(gone)
        return out

    def segment_ids(self, text: str) -> list[int]:
        pieces = self.split(text)
        try:
            return [self.ids[p] for p in pieces]
        except KeyError:  # characters outside the vocabulary
            pass
        ids: list[int] = []
        for piece in pieces:
            k = self.ids.get(piece)
            if k is not None:
                ids.append(k)
            elif self.byte_fallback:
                ids += [self.bytes[b] for b in piece.encode()]
            elif not ids or ids[-1] != self.unknown_id:
                ids.append(self.unknown_id)
        return ids

    def prepared(self, text: str) -> list[str]:
        """The segments of a text: spaces marked, the mark before the text added."""
        return self.segments((MARK if self.dummy_prefix else "") + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [k for s in self.prepared(text) for k in self.segment_ids(s)]

    def both_ways(self, text: str) -> tuple[bytes, int, str]:
        """A text's decimal ids joined by commas, their number, and what they decode to; segments are remembered."""
        parts = self.prepared(text)
        got = list(map(self.memory.__getitem__, parts))
        try:
            ids, back = b",".join(got), "".join(parts).replace(MARK, " ")
        except TypeError:  # a segment that decodes to something else
            pairs = [(g, s.replace(MARK, " ")) if isinstance(g, bytes) else g for g, s in zip(got, parts)]
            ids, back = b",".join([g for g, _ in pairs]), "".join([s for _, s in pairs])
        if self.dummy_prefix and parts:
            back = back[1:]  # each text begins with a marked piece
        return ids, ids.count(b",") + 1 if parts else 0, back

    def surface(self, ids: list[int]) -> str:
        """Text of ids, space marks as spaces; runs of byte pieces as UTF-8, a bad byte as U+FFFD."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.spoken[k] for k in ids])
        out, run = [], bytearray()
        for k in ids:
            if (b := self.byte_of.get(k)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "corvid-each-byte"))
                run.clear()
            out.append(self.spoken[k])
        if run:
            out.append(run.decode("utf-8", "corvid-each-byte"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids without the one space that encoding puts before it."""
        ids = [k for k in ids if self.kinds[k] != CONTROL]
        text = self.surface(ids)
        marked = self.dummy_prefix and ids and self.kinds[ids[0]] == NORMAL and self.pieces[ids[0]].startswith(MARK)
        return text[1:] if marked else text


class _Segments(dict):
    """segment -> its decimal ids joined by commas, in two generations of bounded size.

    Nearly all segments decode to themselves, marks as spaces; for others it is a pair: the ids and the decoded text.
    """

    def __init__(self, codec: PieceCodec, bound: int):
        super().__init__()
        self.codec, self.bound, self.old = codec, bound // 2, {}

    def __missing__(self, segment: str) -> bytes | tuple[bytes, str]:
        got = self.old.get(segment)
        if got is None:
            codec = self.codec
            ids = codec.segment_ids(segment)
            got, back = b",".join([codec.decimal[k] for k in ids]), codec.surface(ids)
            if back != segment.replace(MARK, " "):
                got = got, back
            if len(segment) > 64:  # hardly comes back
                return got
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[segment] = got
        return got


#: Codecs of this Python worker, by the model's digest.
_CODECS: dict[str, PieceCodec] = {}


def codec(raw: bytes) -> PieceCodec:
    key = hashlib.sha256(raw).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(raw)
    return _CODECS[key]


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.StringType()),
        T.StructField("decoded", T.StringType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Encode each text and decode its ids again.

    One row per input row: doc_id, n_tokens, ids (decimal, joined by commas), decoded, and the SHA-256 of both.
    ``with_text=False`` leaves ids and decoded null where only counts and digests are wanted.  Null counts as the empty
    text, which has no ids.  Columns other than the id and the text aren't read.  No shuffle; rows keep their partition,
    so a lost task is redone alone.  Memory: one Arrow batch and the bounded memory of segments.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # a model file: about half a MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        sha = hashlib.sha256
        with c.in_use():
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    rows = []
                    for text in part.column(1).to_pylist():
                        ids, n, back = c.both_ways(text or "")
                        rows.append((n, ids.decode() if with_text else None, back if with_text else None, sha(ids).hexdigest(), sha(back.encode()).hexdigest()))
                    cols = zip(*rows)
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())))], RESULT.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, RESULT)
