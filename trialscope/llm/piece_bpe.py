"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import small_batches, text_of

#: The library's mark for a space, and piece kinds of its model format.
SPACE_MARK, NORMAL, UNKNOWN, CONTROL, USER, BYTE = "▁", 1, 2, 3, 4, 6
#: Words that each half of a worker's memory holds.
REMEMBERED = 300_000
#: Symbols in one call of merge rounds.
ROUND_SYMBOLS = 1 << 20

_WORDS = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
_NONE = np.iinfo(np.int64).max


class Memory:
    """What has been found out about words, in two halves.

    When the recent half is full it becomes the older one, and words of the older one that come up
    again are recent again. So common words stay.
    """

    def __init__(self, describe: Callable[[list[str]], list], most: int = REMEMBERED):
        self.describe, self.most = describe, most
        self.recent: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def of(self, words: set[str]) -> dict[str, object]:
        """What is known of each of the words, new ones included."""
        recent, older = self.recent, self.older
        new = []
        for w in words.difference(recent):
            if w in older:
                recent[w] = older[w]
            else:
                new.append(w)
        if len(recent) > self.most:
            self.recent, self.older = {w: recent[w] for w in words.intersection(recent)}, recent
            recent = self.recent
        start = size = 0
        for i, w in enumerate(new):
            size += len(w)
            if size >= ROUND_SYMBOLS or i + 1 == len(new):
                part = new[start : i + 1]
                recent.update(zip(part, self.describe(part), strict=True))
                start, size = i + 1, 0
        return recent


class PieceModel:
    """A BPE model file; words are encoded in bulk and remembered."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("a BPE model that takes the text as it is, is expected")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        if any(k not in (NORMAL, UNKNOWN, CONTROL, BYTE) for k in kinds):
            raise ValueError("user-defined or unused pieces are not supported")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(a != SPACE_MARK == b for p in normal for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("pieces that reach over a space are not supported")
        self.unknown = kinds.index(UNKNOWN)
        self.unknown_surface = model.trainer_spec.unk_surface
        self.byte_ids = np.full(256, self.unknown, np.int64)
        self.byte_of: dict[int, int] = {}
        for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
        self.fallback = bool(model.trainer_spec.byte_fallback)
        self.control = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.symbol = {p: i for p, i in normal.items() if len(p) == 1}
        self.extra: dict[str, int] = {}  # characters without a piece, numbered after the pieces
        self._pairs(model, normal)
        self.known = Memory(self.merge)

    def _pairs(self, model, normal: dict[str, int]) -> None:
        """Every pair of symbols that makes a piece: sorted keys, rank of the piece, its id."""
        singles = {c for p in normal for c in p}
        for c in sorted(singles - set(self.symbol)):
            self._number(c)
        known = {**{c: self.symbol.get(c, self.extra.get(c)) for c in singles}, **normal}
        scores = sorted({p.score for p in model.pieces if p.type == NORMAL}, reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        found = [(known[p[:k]], known[p[k:]], rank[model.pieces[i].score], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
        a, b, r, to = map(np.array, zip(*found, strict=True))
        keys = a.astype(np.int64) << 32 | b
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[order], r[order], to[order]

    def _number(self, char: str) -> int:
        return self.extra.setdefault(char, len(self.pieces) + len(self.extra))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, and the place of its entry."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE), at

    def _rounds(self, words: list[str], one_by_one: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word, symbol) of all words' last symbols, in order: rounds over flat arrays.

        In a round each word merges its pair of least rank, at all its places from the left (with
        one_by_one: at the first place only); words without a pair are taken out. Pairs are looked up
        once, and then only where a merge has changed them. Where merging several places at once
        brings up a pair of lesser rank, the word is done again one by one, so that the result is
        always that of merging one pair at a time.
        """
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, inverse = np.unique(codes, return_inverse=True)
        symbols = np.array([self.symbol.get(chr(c)) if chr(c) in self.symbol else self._number(chr(c)) for c in kinds.tolist()], np.int64)[inverse]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        again: list[np.ndarray] = []
        marks = np.full(len(words), -1, np.int64)  # rank at which a word last merged several places
        rank, at = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], at[inner] = self._rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least, here = np.minimum.reduceat(rank, starts), word[starts]
            redo = least < marks[here]
            stop = (least == _NONE) | redo
            sizes = np.diff(np.r_[starts, len(symbols)])
            if stop.any():
                again.append(here[redo])
                ended = np.repeat(stop & ~redo, sizes)
                done.append((word[ended], symbols[ended]))
                stay = np.repeat(~stop, sizes)
                word, symbols, rank, at = word[stay], symbols[stay], rank[stay], at[stay]
                least, sizes = least[~stop], sizes[~stop]
                if not len(symbols):
                    break
            places = np.flatnonzero(rank == np.repeat(least, sizes))
            if one_by_one:
                places = places[np.r_[True, word[places][1:] != word[places][:-1]]]
            else:
                fresh = np.r_[True, np.diff(places) > 1]
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - first) % 2 == 0]
                owner = word[places]
                twice = owner[1:][owner[1:] == owner[:-1]]
                marks[owner] = -1
                marks[twice] = rank[places[1:]][owner[1:] == owner[:-1]]
            symbols[places] = self.merged[at[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            word, symbols, rank, at = word[keep], symbols[keep], rank[keep], at[keep]
            places = places - np.arange(len(places))  # each merge takes away one symbol behind its place
            rank[places] = _NONE
            changed = np.union1d(places, places[places > 0] - 1)
            changed = changed[changed + 1 < len(word)]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed], at[changed] = self._rank(symbols[changed], symbols[changed + 1])
        slow = np.unique(np.concatenate([*again, np.zeros(0, np.int64)]))
        if len(slow):
            owner, flat = self._rounds([words[i] for i in slow.tolist()], one_by_one=True)
            done.append((slow[owner], flat))
        owner, flat = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(owner, kind="stable")
        return owner[order], flat[order]

    def merge_flat(self, words: list[str], one_by_one: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and where each word's ids end."""
        owner, flat = self._rounds(words, one_by_one)
        odd = np.flatnonzero(flat >= len(self.pieces))
        if len(odd):
            names = {i: c for c, i in self.extra.items()}
            spelt = {i: self._fallback(names[i]) for i in np.unique(flat[odd]).tolist()}
            sizes = np.ones(len(flat), np.int64)
            sizes[odd] = [len(spelt[i]) for i in flat[odd].tolist()]
            starts, out, owner = np.cumsum(sizes) - sizes, np.repeat(flat, sizes), np.repeat(owner, sizes)
            for i, ids in spelt.items():
                places = starts[flat == i]
                for k, x in enumerate(ids):
                    out[places + k] = x
            flat = out
        return flat, np.cumsum(np.bincount(owner, minlength=len(words)))

    def merge(self, words: list[str], one_by_one: bool = False) -> list[tuple[int, ...]]:
        """The ids of each word."""
        if not words:
            return []
        flat, ends = self.merge_flat(words, one_by_one)
        ids, ends = flat.tolist(), ends.tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def _fallback(self, char: str) -> tuple[int, ...]:
        if not self.fallback:
            return (self.unknown,)
        return tuple(self.byte_ids[list(char.encode("utf-8", "replace"))].tolist())

    def split(self, text: str) -> list[str]:
        """The text's words, each with the marks before it; no piece reaches over their borders."""
        if not text:
            return []
        return _WORDS.findall((SPACE_MARK if self.prefix else "") + text.replace(" ", SPACE_MARK))

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        known = self.known.of(set().union(*split))
        return [[i for w in ws for i in known[w]] for ws in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: marks become spaces, byte pieces their bytes (invalid ones U+FFFD), the first prefix goes."""
        out: list[str] = []
        raw = bytearray()
        first = True
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                first = False
                continue
            if raw:
                out.append(valid(raw))
                raw = bytearray()
            if i in self.control:
                continue
            piece = self.unknown_surface if i == self.unknown else self.pieces[i]
            if first and self.prefix and piece.startswith(SPACE_MARK):
                piece = piece[1:]
            first = False
            out.append(piece.replace(SPACE_MARK, " "))
        if raw:
            out.append(valid(raw))
        return "".join(out)


def valid(raw: bytes) -> str:
    """UTF-8 with each byte that isn't part of a character replaced."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(raw[at : at + n]).decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model per worker process."""
    return PieceModel(path)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids of every whole text, in the order of rows; null text counts as empty (no ids)."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(model_path)
        for b in small_batches(batches, rows=1000, size=4 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bpe.encode(b.column(1).to_pylist()), pa.list_(pa.int32()))], names=["id", "ids"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, ids array<int>").withColumnRenamed("id", id_col)


def decode_pieces(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every list of ids; a null list counts as empty."""
    rows = tokens.select(F.col(id_col).alias("id"), F.coalesce(ids_col, F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(model_path)
        for b in small_batches(batches, rows=1000, size=8 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(bpe.decode, b.column(1).to_pylist()), pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


class Digester(PieceModel):
    """Remembers for each word its ids as decimal text, and what they decode to."""

    def __init__(self, path: str):
        super().__init__(path)
        self.decimals = list(map(str, range(len(self.pieces))))
        self.surfaces = [p.replace(SPACE_MARK, " ") for p in self.pieces]
        self.odd = np.zeros(len(self.pieces), bool)  # pieces whose text isn't their own
        self.odd[[*self.byte_of, *self.control, self.unknown]] = True
        self.digests = Memory(self.described)

    def described(self, words: list[str]) -> list[tuple[str, str]]:
        """Ids and decoded text of each word, from tables of the pieces' decimals and texts.

        A word begins and ends with whole characters, so that its bytes decode by themselves.
        """
        flat, ends = self.merge_flat(words)
        odd = np.logical_or.reduceat(self.odd[flat], np.r_[0, ends[:-1]])
        ids, ends = flat.tolist(), ends.tolist()
        decimals, surfaces = [self.decimals[i] for i in ids], [self.surfaces[i] for i in ids]
        out = [(",".join(decimals[a:b]), "".join(surfaces[a:b])) for a, b in zip([0, *ends], ends, strict=False)]
        for k in np.flatnonzero(odd).tolist():
            mine = ids[ends[k - 1] if k else 0 : ends[k]]
            text = self.decode((*self._fallback("\n"), *mine))[1:] if self.fallback else self.decode((self.unknown, *mine))[len(self.unknown_surface) :]
            out[k] = (out[k][0], text)
        return out


@lru_cache(maxsize=2)
def digester(path: str) -> Digester:
    return Digester(path)


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: what encode_pieces() and decode_pieces() give, digested word by word.

    Defined cases: null text counts as empty, which has no ids; repeated rows and null ids give a row
    each; a very long text is one row of a batch of its own; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = digester(model_path)
        for b in small_batches(batches, rows=1000, size=4 << 20):
            split = [bpe.split(t) for t in b.column(1).to_pylist()]
            known = bpe.digests.of(set().union(*split))
            n, ids, texts = [], [], []
            for ws in split:
                mine, decoded = zip(*map(known.__getitem__, ws), strict=True) if ws else ((), ())
                joined, text = ",".join(mine), "".join(decoded)
                n.append(joined.count(",") + 1 if ws else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                texts.append(hashlib.sha256((text[1:] if bpe.prefix and text.startswith(" ") else text).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
