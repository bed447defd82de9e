"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import fresh, small_batches, text_of
from trialscope.llm.piece_bpe import Memory

#: The characters of Unicode's White_Space, as a character class.
_WHITE = "\t-\r \x85\xa0  -     　"
_WHITE_SET = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
_CHUNKS = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
#: Fixed value: the pattern by which byte-level BPE of this kind parts a text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Words that each half of a worker's memory holds.
REMEMBERED = 300_000
#: Pieces packed together in one task; each such shard leaves about one sequence unfilled.
SHARD_PIECES = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable Latin-1 ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE tokenizer file; words are encoded once and remembered.

    The tokenizer's own pattern puts a space before a character that isn't white into one token with
    it, whatever stands before. So a text without white space after a space falls into words, each
    with its space, that are encoded alike by themselves; other texts are cut only where white space
    begins. Such a part without a special token goes through tiktoken with the file's own vocabulary,
    which gives the ids that the tokenizers library gives at a third of its time.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode_plain = getattr(self.fast, "_core_bpe", self.fast).encode_ordinary  # without a wrapper per word, if there is such
        self.known = Memory(self.described, REMEMBERED)  # by word, with a space before it; None: not to be taken alone

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        fast, together = self.encode_plain, "\n".join(texts)
        special = [x for x in self.special if x in together]
        lists = [self.tokenizer.encode(t, add_special_tokens=False).ids if special and any(x in t for x in special) else fast(t) for t in texts]
        raw, ends = np.fromiter(chain.from_iterable(lists), "<u4").tobytes(), [4 * n for n in accumulate(map(len, lists))]
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def described(self, words: list[str]) -> list[bytes | None]:
        """The ids of each word with a space before it; none for empty words and those that begin with white space."""
        alone = [w for w in words if w and w[0] not in _WHITE_SET]
        return list(map(dict(zip(alone, self.ids([" " + w for w in alone]), strict=True)).get, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [t.split(" ") for t in texts]
        firsts = self.ids([words[0] for words in split])
        known = self.known.of(set().union(*split))
        out = []
        for text, words, first in zip(texts, split, firsts, strict=True):
            parts = [first, *map(known.__getitem__, words[1:])]
            out.append(b"".join(self.ids(_CHUNKS.findall(text)) if None in parts else parts))
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    """One tokenizer per worker process; it must not start threads beside Spark's tasks."""


    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteBpe(path)


def cut(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; all but the first are of full length."""
    first = n % longest or min(n, longest)
    return [(0, first), *((s, longest) for s in range(first, n, longest))]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, longest: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's ids, end_id after them.

    Null text counts as empty: such a document is its end_id alone. Ids may be null or repeat. A very long
    text is a batch of its own and is cut into as many pieces as it takes; an empty table has no pieces.
    Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for b in small_batches(batches, rows=1000, size=4 << 20):
            out = []
            for doc_id, raw in zip(b.column(0).to_pylist(), bpe.encode(b.column(1).to_pylist()), strict=True):
                raw += end
                for k, (start, n) in enumerate(cut(len(raw) // 4, longest)):
                    ids = raw[4 * start : 4 * (start + n)]
                    out.append((doc_id, k, start, n, zlib.crc32(ids), *([np.frombuffer(ids, "<u4").astype(np.int32)] if with_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


class OpenBins:
    """Open bins by remaining capacity, with a segment tree that finds the tightest that fits.

    Leaf c of the tree says whether a bin with c places left is open. tightest(n) climbs from leaf n
    until a right-hand subtree holds an open leaf and descends to its leftmost one.
    """

    def __init__(self, longest: int):
        self.size = 1 << longest.bit_length()
        self.tree = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(longest + 1)]

    def _mark(self, at: int, open_: int) -> None:
        at += self.size
        self.tree[at] = open_
        while at > 1:
            at >>= 1
            now = self.tree[2 * at] | self.tree[2 * at + 1]
            if self.tree[at] == now:
                break
            self.tree[at] = now

    def add(self, room: int, bin_: int) -> None:
        if not self.bins[room]:
            self._mark(room, 1)
        self.bins[room].append(bin_)

    def tightest(self, n: int) -> int:
        """The least room of n or more among open bins, or -1."""
        at = n + self.size
        if self.tree[at]:
            return n
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1

    def take(self, room: int) -> int:
        found = self.bins[room].pop()
        if not self.bins[room]:
            self._mark(room, 0)
        return found


def best_fit(lengths: list[int], longest: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; lengths come in falling order."""
    bins, offsets, open_, n = [], [], OpenBins(longest), 0
    for length in lengths:
        room = open_.tightest(length)
        if room < 0:
            room, at, n = longest, n, n + 1
        else:
            at = open_.take(room)
        bins.append(at)
        offsets.append(longest - room)
        if room > length:
            open_.add(room - length, at)
    return bins, offsets


def pack(pieces: DataFrame, n_pieces: int, longest: int = 1024) -> DataFrame:
    """pieces with sequence_id and offset, by best-fit decreasing.

    Full pieces are sequences by themselves. The others are dealt by a hash of their row's number into
    shards of about SHARD_PIECES, so that no task holds more even if ids are null or repeat, and each
    shard is packed by itself; a shard wastes about a sequence, a few ten-thousandths of its content.
    Sequence ids are unique: shard and number within it; full pieces get negative ones from their
    rows' numbers.

    n_pieces is a count to choose the number of shards by; any rough count gives right results.
    Repeated rows of a document and piece are packed as separate pieces, also those without an id.
    Columns of pieces called sequence_id or offset are replaced, others are kept. An empty table gives
    an empty result; a length above longest raises an error.
    """
    shards = max(1, -(-n_pieces // SHARD_PIECES))
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row, shard = fresh("_row", columns), fresh("_shard", columns)
    numbered = pieces.select(*columns, F.monotonically_increasing_id().alias(row))
    sharded = numbered.withColumn(shard, F.when(F.col("length") < longest, F.pmod(F.xxhash64(row), F.lit(shards))).cast("long"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", row], ascending=[False, True, True, True, True], kind="stable")
        bins, offsets = best_fit(pdf["length"].tolist(), longest)
        pdf["sequence_id"] = pdf[shard].astype("int64") * (1 << 20) + np.array(bins, np.int64)
        pdf["offset"] = np.array(offsets, np.int64)
        return pdf[[*columns, "sequence_id", "offset"]]

    kinds = dict(pieces.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "sequence_id long", "offset long"])
    packed = sharded.where(F.col(shard).isNotNull()).repartition(max(1, min(shards, 10_000)), shard).groupBy(shard).applyInPandas(fill, schema)
    too_long = F.when(F.col("length") > longest, F.raise_error(F.lit("a piece is longer than a sequence")).cast("long"))
    whole = sharded.where(F.col(shard).isNull()).select(*columns, F.coalesce(too_long, -1 - F.col(row)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)
