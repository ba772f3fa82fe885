"""Operator 10: byte-level BPE by forced-boundary splitting.

A vocabulary token is a string of bytes. If two neighbouring bytes occur side by side inside no
token at all, no merge can ever join across them, so the text may be cut there for certain. The
pre-tokenizer's word boundaries are such cuts by definition; inside words the table of byte pairs
gives further ones. Every fragment between two cuts is encoded on its own, by the tokenizers
library's BPE model, and the ids are concatenated. Words repeat, so a worker keeps the packed ids of
those in use in a memo of bounded size.

Defined results: a null or empty text has no ids and decodes to the empty text; strings of special
tokens become their ids, as the library does by default; very long texts are encoded whole, word by
word; repeated rows are encoded alike, one for one; an empty table gives an empty table; all other
columns stay as they are; a result column whose name is taken is refused.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alone, col, slices, table, written

VOCABULARY = "byte_bpe_50k.json"
#: Words, and pieces between spaces, of one generation of a worker's memos, and the longest ones that they keep. Cost only.
MEMO_WORDS, MEMO_PIECES, MEMO_LETTERS = 100_000, 300_000, 256
#: The same where an executor's memory is short, since other stages have used it.
SMALL_MEMO = 20_000, 60_000

# The pattern of the public byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII and Latin letters alone, for which the faster `re` agrees with it.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_SPACES = r"\x09-\x0d\x20"
_NOT_PLAIN = re.compile(rf"[^{_SPACES}\x21-\x7e{_LETTERS[6:]}]")
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACES}0-9{_LETTERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
_GENERAL = regex.compile(PATTERN)
#: One of these after letters, before a space, is a word of its own.
_ENDS = frozenset(".,;:!?")
_ID = attrgetter("id")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes as they are, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class _Memo(dict):
    """Word -> packed ids. When a generation is full it becomes the old one, from which words in use come back."""

    def __init__(self, encode, words: int):
        super().__init__()
        self.encode, self.words, self.old = encode, words, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= MEMO_LETTERS:
            if len(self) >= self.words:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _letters_only(piece: str) -> bool:
    return piece.isalpha() and (piece.isascii() or not _NOT_PLAIN.search(piece))


class _Ragged(Exception):
    """A space beside other white space."""


class ForcedBoundaryBPE:
    """Encoder and decoder of one vocabulary, given as the text of its tokenizers file."""

    def __init__(self, spec: str, memo_words: int = MEMO_WORDS, memo_pieces: int | None = None):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        step = parsed["pre_tokenizer"]
        if parsed["model"]["type"] != "BPE" or parsed.get("normalizer") or step["type"] != "ByteLevel" or step["add_prefix_space"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer and prefix space is needed")
        self.model = Tokenizer.from_str(spec).model
        self.shown = dict(enumerate(byte_letters()))
        byte_of = {c: b for b, c in self.shown.items()}
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        vocabulary = parsed["model"]["vocab"]
        self.token_bytes = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        #: The pairs of bytes that stand side by side in some token; between any other two a cut is certain.
        self.joined: set[tuple[int, int]] = set()
        for token, i in vocabulary.items():
            self.token_bytes[i] = raw = bytes(byte_of[c] for c in token)
            self.joined.update(zip(raw, raw[1:]))
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self._split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Bytes of one packed id, as a number without sign, least byte first.
        self.width = 2 if len(self.token_bytes) <= 1 << 16 else 4
        self._letter = {2: "H", 4: "I"}[self.width]
        self._tokenize, self._space = self.model.tokenize, self.shown[32]
        self._packers = [struct.Struct(f"<{n}{self._letter}").pack for n in range(33)]
        self._special_packed = {t: self.pack([i]) for t, i in self.special.items()}
        self.memo, self.pieces = _Memo(self._pack_word, memo_words), _Memo(self._pack_spaced, memo_pieces or memo_words * MEMO_PIECES // MEMO_WORDS)

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self._letter}", *ids)

    def unpack(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, f"<u{self.width}")

    def fragments(self, raw: bytes) -> list[bytes]:
        """raw, cut between any two bytes that stand side by side in no token."""
        joined = self.joined
        if joined.issuperset(pairwise(raw)):
            return [raw]
        cuts = [i for i, pair in enumerate(pairwise(raw), 1) if pair not in joined]
        return [raw[i:j] for i, j in zip([0, *cuts], [*cuts, len(raw)])]

    def _pack_word(self, word: str) -> bytes:
        # of printable ASCII only the space has another letter; most words have no cut inside
        if word.isascii() and word.isprintable():
            if self.joined.issuperset(pairwise(raw := word.encode())):
                ids = list(map(_ID, self._tokenize(word.replace(" ", self._space))))
                return self._packers[len(ids)](*ids) if len(ids) < len(self._packers) else self.pack(ids)
        else:
            raw = word.encode()
        return self.pack([t.id for part in self.fragments(raw) for t in self._tokenize(part.decode("latin-1").translate(self.shown))])

    def _pack_words(self, text: str) -> bytes:
        words = (_GENERAL if _NOT_PLAIN.search(text) else _PLAIN).findall(text)
        return b"".join(map(self.memo.__getitem__, words))

    def _pack_spaced(self, piece: str) -> bytes:
        """The ids of a space and the piece, which stands between two spaces."""
        # most pieces are one word, or one with a mark behind it: no search for words, and no second place in a memo
        if _letters_only(piece):
            return self._pack_word(f" {piece}")
        if piece and piece[-1] in _ENDS and _letters_only(piece[:-1]):
            return self.pieces[piece[:-1]] + self.memo[piece[-1]]
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Ragged
        return self._pack_words(f" {piece}")

    def _pack_ordinary(self, text: str) -> bytes:
        # no word of the pre-tokenizer goes on over a single space, so pieces between single spaces are looked up whole
        pieces = text.split(" ")
        first, last = pieces[0], pieces[-1]
        if len(pieces) < 3 or not first or not last or first[-1].isspace() or last[0].isspace():
            return self._pack_words(text)
        try:
            middle = b"".join(map(self.pieces.__getitem__, pieces[1:-1]))
        except _Ragged:
            return self._pack_words(text)
        return self._pack_words(first) + middle + self._pack_words(f" {last}")

    def packed(self, text: str | None) -> bytes:
        """The text's ids, `width` bytes each."""
        if not text:
            return b""
        if self._split_special is None or not self._split_special.search(text):
            return self._pack_ordinary(text)
        known = self._special_packed
        return b"".join([known[part] if part in known else self._pack_ordinary(part) for part in self._split_special.split(text)])

    def encode(self, text: str | None) -> list[int]:
        return self.unpack(self.packed(text)).tolist()

    def encode_all(self, texts: list[str | None]) -> tuple[pa.ListArray, list[np.ndarray]]:
        """The ids of every text, as an Arrow list of int and one by one."""
        parts = [self.packed(t) for t in texts]
        ends = np.cumsum([0, *map(len, parts)]) // self.width
        flat = self.unpack(b"".join(parts))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32))), [flat[i:j] for i, j in zip(ends[:-1], ends[1:])]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", errors="replace")


_OPEN: dict[tuple, ForcedBoundaryBPE] = {}


def opened(spec: str, *memo: int) -> ForcedBoundaryBPE:
    """The worker's encoder of that vocabulary, with its memo."""
    alone("bpe", _OPEN.clear)
    key = (hash(spec), *memo)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = ForcedBoundaryBPE(spec, *memo)
    return _OPEN[key]


def vocabulary_text(path: str | None = None) -> str:
    """The vocabulary file, read on the driver and sent to the tasks with the job (1.5 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """docs with the column `ids`: each whole text's token ids (array of int)."""
    if ids in docs.columns:
        raise ValueError(f"the column {ids} exists")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = opened(sent.value)
        for batch in slices(batches):
            yield bpe.encode_all(batch.to_pylist())[0]

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(ids, F.arrow_udf(run, T.ArrayType(T.IntegerType()))(col(text)))


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with the column `text`: the text that the ids spell; bytes that are no UTF-8 become U+FFFD. Null ids spell nothing."""
    if text in docs.columns:
        raise ValueError(f"the column {text} exists")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = opened(sent.value)
        for batch in slices(batches):
            flat, ends = batch.flatten().to_pylist(), batch.offsets.to_numpy() - batch.offsets[0].as_py() if len(batch) else []
            if batch.null_count:
                yield pa.array([bpe.decode(x or []) for x in batch.to_pylist()], pa.string())
            else:
                yield pa.array([bpe.decode(flat[i:j]) for i, j in zip(ends[:-1], ends[1:])], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(text, F.arrow_udf(run, "string")(col(ids)))


def round_trip(docs: DataFrame, name: str, text: str = "text", path: str | None = None, memo: tuple[int, ...] = ()) -> DataFrame:
    """docs with the struct column `name`: ids, and decoded, the text that those ids spell. One worker a task does both."""
    if name in docs.columns:
        raise ValueError(f"the column {name} exists")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = opened(sent.value, *memo)
        for batch in slices(batches):
            ids, each = bpe.encode_all(batch.to_pylist())
            spelled = [bpe.decode(x.tolist()) for x in each]
            yield pa.StructArray.from_arrays([ids, pa.array(spelled, pa.string())], ["ids", "decoded"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(run, "struct<ids: array<int>, decoded: string>")(col(text)))


def digests(docs: DataFrame, memo: tuple[int, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_tokens and the digests of ids and decoded text. A table, a few dozen bytes a row. memo: its words and pieces, if not the usual ones."""
    rows = round_trip(docs.select("doc_id", "text"), "b", memo=memo).select(
        "doc_id",
        F.size("b.ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("b.ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("b.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
    return written(rows, "bpe-digests")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op10_bpe": op10_bpe}
SQL: dict[str, str] = {}
