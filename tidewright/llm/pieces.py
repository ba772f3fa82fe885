"""Operator 13: SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

Texts become one flat array of code points. It is cut between any two characters that stand side by
side in no piece of the vocabulary (no merge reaches across), which gives words; the different words
of a block are encoded once. All their symbols lie in one array, and a round takes, word by word, the
pair of neighbours of the best rank (a segmented minimum), merges its occurrences from the left, all at
once, and compacts the array; words without a pair left leave it. Rounds go on until no pair remains.

Merging all occurrences at once is what the library's queue does only if no pair that the merged piece
makes possible is as good as the pair itself. Pieces for which that fails ("early" pieces, and those of
equal scores) are merged one a word and round, from the left. Characters without a piece become bytes.

Defined results: a null or empty text has the begin and end ids alone and decodes to the empty text; a
text's own U+2581 comes back as a space, as in the library; very long texts are encoded whole, in blocks
that end at cuts, so memory is bounded by the longest stretch without one; repeated rows are encoded
alike, one for one; an empty table gives an empty table; all other columns stay as they are; a result
column whose name is taken is refused.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, col, slices, table, written

MODEL = "piece_bpe_32k.model"
#: Code points of a block, whose different words are encoded together. Cost and memory only.
BLOCK = 1 << 20
SPACE = "▁"
#: Odd multiplier of the hash that finds equal words; they are compared afterwards.
_BASE = 0x9E3779B97F4A7C15
_NONE = np.int32(2**31 - 1)
#: Bits of a place in the tables of pairs.
_BITS = 20
_PROBES = ("", " ", "a  b\t\n c ", "ﬁ x　", "the▁ others", "\x00<s>", "éé ﻿\U0001f600")


def _slots(keys: np.ndarray, by: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(by)) >> np.uint64(64 - _BITS)


def _powers(x: int, n: int) -> np.ndarray:
    steps = np.full(n, x, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of the segments, one segment after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class MergeRounds:
    """Encoder and decoder of one BPE model, given as the bytes of its file."""

    def __init__(self, model: bytes, block: int = BLOCK):
        from sentencepiece import SentencePieceProcessor

        self.block, library = block, SentencePieceProcessor(model_proto=model)
        every = range(library.get_piece_size())
        self.begin, self.end = library.bos_id(), library.eos_id()
        self.control = np.array([library.is_control(i) for i in every])
        is_byte = np.array([library.is_byte(i) for i in every])
        names = [library.id_to_piece(i) for i in every]
        plain = [i for i in every if not (self.control[i] or is_byte[i] or library.is_unknown(i))]
        if sum(is_byte) != 256 or min(self.begin, self.end) < 0 or any(library.is_unused(i) for i in every):
            raise ValueError("a BPE model with byte pieces, begin and end ids and no unused pieces is needed")
        self.first_byte = int(np.flatnonzero(is_byte)[0])
        self._tables({names[i]: i for i in plain}, {i: library.get_score(i) for i in plain})
        self.unknown = library.unk_id()
        spelled = [b"" if self.control[i] else bytes([i - self.first_byte]) if is_byte[i] else names[i].replace(SPACE, " ").encode() for i in every]
        spelled[self.unknown] = library.decode([self.unknown]).encode()
        self.is_byte, self.opens = is_byte, np.array([i in self.rank_of and names[i].startswith(SPACE) for i in every])
        self.sizes = np.array([len(x) for x in spelled])
        self.offsets, self.letters = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(spelled), np.uint8)
        for probe in _PROBES:
            if self.encode(probe) != library.encode(probe, add_bos=True, add_eos=True):
                raise ValueError("models that normalise texts or are no BPE models are not supported")

    def _tables(self, ids: dict[str, int], score: dict[int, float]) -> None:
        places = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank_of = rank = {i: places[s] for i, s in score.items()}
        seen: set[int] = set()
        tied = {k for k in rank.values() if k in seen or seen.add(k)}
        # letters that stand beside others in a piece are numbered from 1; two of them that never meet are a cut
        meeting = {c: k for k, c in enumerate(sorted({c for piece in ids if len(piece) > 1 for c in piece}), 1)}
        self.number = np.zeros(0x110000, np.int16)
        self.symbol = np.full(0x110000, -1, np.int32)
        for c, k in meeting.items():
            self.number[ord(c)] = k
        self.joined = np.zeros((len(meeting) + 1, len(meeting) + 1), bool)
        early, pairs = set(), {}
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
            for a, b in zip(piece, piece[1:]):
                self.joined[meeting[a], meeting[b]] = True
            for k in range(1, len(piece)):
                halves = ids.get(piece[:k]), ids.get(piece[k:])
                if None not in halves:
                    pairs[halves] = i
                    early.update(h for h in halves if rank[h] >= rank[i])
        if not pairs:
            raise ValueError("the model has no merges")
        self.width = max(ids.values()) + 1
        keys = np.array([a * self.width + b for a, b in pairs], np.int64)
        self.pair_keys, self.pair_ids = keys, np.array(list(pairs.values()), np.int32)
        self.pair_ranks = np.array([rank[i] for i in self.pair_ids.tolist()], np.int32)
        # two tables of places in pair_keys: the second holds, at places of their own, those whose place in the first is taken
        self.first_table, self.second_table = np.zeros(1 << _BITS, np.int32), np.zeros(1 << _BITS, np.int32)
        places_of = _slots(keys, _BASE)
        self.first_table[places_of] = np.arange(len(keys))
        rest = np.flatnonzero(self.first_table[places_of] != np.arange(len(keys)))
        self.mixer = next(m for m in (pow(_BASE, k, 1 << 64) for k in range(2, 10_000)) if len(np.unique(_slots(keys[rest], m))) == len(rest))
        self.second_table[_slots(keys[rest], self.mixer)] = rest
        #: By rank: whether its pairs are merged one at a time.
        self.one_by_one = np.zeros(len(places), bool)
        self.one_by_one[[*tied, *(rank[i] for i in early)]] = True

    def _merged(self, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words, their letters one after the other -> their symbols likewise (below 0: -1 minus a code point) and numbers of symbols."""
        found = self.symbol[letters]
        symbols = np.where(found < 0, -1 - letters.astype(np.int32), found)
        words, owner = np.arange(len(sizes)), np.repeat(np.arange(len(sizes)), sizes)
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(sizes) - 1] = True
        ranks, merged = np.full(len(symbols), _NONE, np.int32), np.zeros(len(symbols), np.int32)
        self._look_up(symbols, last, ranks, merged, np.arange(len(symbols)))
        done = []
        while True:
            best = np.minimum.reduceat(ranks, np.cumsum(sizes) - sizes)
            over = best == _NONE
            if over.any():
                gone = over[owner]
                done.append((symbols[gone], words[over], sizes[over]))
                words, sizes, best = words[~over], sizes[~over], best[~over]
                if not len(words):
                    break
                symbols, ranks, merged, last = (x[~gone] for x in (symbols, ranks, merged, last))
                owner = np.repeat(np.arange(len(words)), sizes)
            at = np.flatnonzero(ranks == best[owner])
            here = owner[at]
            # of pairs that overlap, every second one from the left; of some ranks, the first of the word only
            chain = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            take = (np.arange(len(at)) - np.repeat(chain, np.diff(chain, append=len(at)))) % 2 == 0
            at = at[np.where(self.one_by_one[best[here]], np.diff(here, prepend=-1) > 0, take)]
            symbols[at], last[at] = merged[at], last[at + 1]
            sizes = sizes - np.bincount(owner[at], minlength=len(words))
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, ranks, merged, last, owner = (x[keep] for x in (symbols, ranks, merged, last, owner))
            at -= np.arange(len(at))
            self._look_up(symbols, last, ranks, merged, np.concatenate([at, at[at > 0] - 1]))
        flat, order, counts = map(np.concatenate, zip(*done))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return flat[_spread((np.cumsum(counts) - counts)[back], counts[back])], counts[back]

    def _look_up(self, symbols: np.ndarray, last: np.ndarray, ranks: np.ndarray, merged: np.ndarray, at: np.ndarray) -> None:
        """Sets rank and id of what the symbols at those places and the next ones in their words merge to."""
        ranks[at] = _NONE
        at = at[~last[at]]
        left, right = symbols[at], symbols[at + 1]
        known = (left >= 0) & (right >= 0)
        at, keys = at[known], left[known].astype(np.int64) * self.width + right[known]
        place = self.first_table[_slots(keys, _BASE)]
        hit = self.pair_keys[place] == keys
        missed = np.flatnonzero(~hit)
        place[missed] = self.second_table[_slots(keys[missed], self.mixer)]
        hit[missed] = self.pair_keys[place[missed]] == keys[missed]
        at, place = at[hit], place[hit]
        ranks[at], merged[at] = self.pair_ranks[place], self.pair_ids[place]

    def _block(self, letters: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that begin at starts, and how many each has: different words are encoded once."""
        sizes = np.diff(starts, append=len(letters))
        which, firsts = self._different(letters, starts, sizes)
        symbols, counts = self._merged(letters[_spread(starts[firsts], sizes[firsts])], sizes[firsts])
        strange = np.flatnonzero(symbols < 0)
        if len(strange):  # a character without a piece: an id a byte
            raw = [chr(-1 - x).encode() for x in symbols[strange].tolist()]
            lengths = np.ones(len(symbols), np.int64)
            lengths[strange] = [len(x) for x in raw]
            wide = np.repeat(symbols, lengths)
            wide[np.repeat(symbols < 0, lengths)] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + self.first_byte
            counts = np.add.reduceat(lengths, np.cumsum(counts) - counts)
            symbols = wide
        return symbols[_spread((np.cumsum(counts) - counts)[which], counts[which])], counts[which]

    def _different(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the different words each one is, and where those stand first."""
        n = len(letters)
        if getattr(self, "_up", np.empty(0)).size < n + 1:
            self._up, self._down = _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * self._up[:n], out=sums[1:])
        hashes = (sums[starts + sizes] - sums[starts]) * self._down[starts] + sizes.astype(np.uint64)
        _, firsts, which = np.unique(hashes, return_index=True, return_inverse=True)
        like = firsts[which]
        if not (sizes == sizes[like]).all() or not (letters == letters[_spread(starts[like], sizes)]).all():
            return np.arange(len(starts)), np.arange(len(starts))
        return which, firsts

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text with the begin and end ids, as numbers of 32 bits."""
        normal = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        letters = np.frombuffer("".join(normal).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in normal])
        ids, places, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at, size = 0, self.block
        while at < len(letters):
            piece = letters[at : at + size]
            numbers = self.number[piece]
            cut = np.ones(len(piece), bool)
            cut[1:] = ~self.joined[numbers[:-1], numbers[1:]]
            inside = ends[(ends > at) & (ends < at + len(piece))] - at
            cut[inside] = True
            starts = np.flatnonzero(cut)
            if at + len(piece) < len(letters):  # the last word may go on in the next block
                if len(starts) == 1:
                    size *= 2
                    continue
                piece, starts = piece[: starts[-1]], starts[:-1]
            found, n = self._block(piece, starts)
            ids.append(found)
            places.append(starts + at)
            counts.append(n)
            at, size = at + len(piece), self.block
        flat, places = np.concatenate(ids), np.concatenate(places)
        totals = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        stops = totals[np.searchsorted(places, ends)]
        return [np.concatenate([[self.begin], flat[a:b], [self.end]]).astype("<u4") for a, b in zip([0, *stops[:-1]], stops)]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text that the ids spell; the space before the first piece is the encoder's own."""
        ids = np.asarray(ids, np.int64)
        text_at = np.flatnonzero(~self.control[ids])
        if not len(text_at):
            return ""
        ids = ids[text_at[0] : text_at[-1] + 1]
        own = int(self.opens[ids[0]])
        try:
            if len(ids) == len(text_at):
                return self.letters[_spread(self.offsets[ids], self.sizes[ids])].tobytes()[own:].decode()
        except UnicodeDecodeError:
            pass
        # runs of bytes end at any other id; in a run, each byte that is no UTF-8 is a replacement character
        parts, run = [], bytearray()
        for i in [*ids.tolist(), self.end]:
            if self.is_byte[i]:
                run.append(i - self.first_byte)
                continue
            parts += [_lenient(bytes(run)), self.letters[self.offsets[i] : self.offsets[i] + self.sizes[i]].tobytes().decode()]
            run.clear()
        return "".join(parts)[own:]


def _lenient(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                break
            except UnicodeDecodeError:
                n = 0
        out.append("" if n else "�")
        i += n or 1
    return "".join(out)


_OPEN: dict[int, MergeRounds] = {}


def opened(model: bytes) -> MergeRounds:
    """The worker's encoder of that model."""
    alone("pieces", _OPEN.clear)
    key = hash(model)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = MergeRounds(model)
    return _OPEN[key]


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read on the driver and sent to the tasks with the job (0.5 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


def _free(df: DataFrame, name: str) -> None:
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the column {name} exists")


def _column(df: DataFrame, name: str, kind: str, source: Column, path: str | None, make) -> DataFrame:
    """df with the column `name`: make(encoder, values of a slice) -> Arrow array."""
    _free(df, name)
    sent = df.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rounds = opened(sent.value)
        for batch in slices(batches):
            yield make(rounds, batch.to_pylist())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(name, F.arrow_udf(run, kind)(source))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """docs with the column `ids`: each whole text's piece ids, begin and end ids included (array of int)."""

    def make(rounds: MergeRounds, texts: list) -> pa.Array:
        return pa.array([x.astype(np.int32) for x in rounds.encode_all(texts)], pa.list_(pa.int32()))

    return _column(docs, ids, "array<int>", col(text), path, make)


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with the column `text`: the text that the ids spell. Null ids spell nothing."""

    def make(rounds: MergeRounds, lists: list) -> pa.Array:
        return pa.array([rounds.decode(x or []) for x in lists], pa.string())

    return _column(docs, text, "string", col(ids), path, make)


def round_trip(docs: DataFrame, name: str, text: str = "text", path: str | None = None) -> DataFrame:
    """docs with the struct column `name`: ids, packed as little-endian numbers of 32 bits, and decoded, the text that they spell."""

    def make(rounds: MergeRounds, texts: list) -> pa.Array:
        ids = rounds.encode_all(texts)
        return pa.StructArray.from_arrays([pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([rounds.decode(x) for x in ids], pa.string())], ["ids", "decoded"])

    return _column(docs, name, "struct<ids: binary, decoded: string>", col(text), path, make)


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_tokens and the digests of ids and decoded text. A table, a few dozen bytes a row."""
    rows = round_trip(docs.select("doc_id", "text"), "b").select(
        "doc_id",
        (F.length("b.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("b.ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("b.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
    return written(rows, "piece-digests")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op13_pieces": op13_pieces}
SQL: dict[str, str] = {}
