"""Document fingerprints: a Merkle tree over sections, paragraphs and content-defined leaves."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import small_batches, text_of

#: A leaf ends at a line's end, and where the hash of the last WINDOW bytes of the line has high bits of zero and no
#: such place is less than WINDOW bytes before; none is longer than LONGEST bytes.
WINDOW, LEAF_BITS, LONGEST = 8, 4, 256
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([i])) for i in range(256)], np.uint32)
#: Share of paragraphs that end a section, as a power of two.
SECTION_BITS = 2


def leaf_ends(text: bytes) -> np.ndarray:
    """Ends of the leaves, in order; they depend on the bytes near them in their line alone, whatever the script."""
    raw = np.frombuffer(text, np.uint8)
    h = _GEAR[raw]
    for k in (1, 2, 4):  # sums over twice as many bytes each, up to WINDOW
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k)
        h = longer
    marks = np.flatnonzero(h >> np.uint32(32 - LEAF_BITS) == 0) + 1
    lines = np.flatnonzero(raw == 10) + 1
    starts = np.concatenate([[0], lines])
    marks = marks[marks - starts[np.searchsorted(starts, marks, "left") - 1] >= WINDOW]
    marks = marks[np.diff(marks, prepend=-WINDOW) >= WINDOW]
    ends = np.union1d(np.concatenate([marks, lines]), [len(raw)])
    sizes = np.diff(ends, prepend=0)
    if sizes.max() > LONGEST:
        ends = np.concatenate([np.append(np.arange(e - n + LONGEST, e, LONGEST), e) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)])
    return ends.astype(np.int64)


def leaves(text: bytes) -> list[bytes]:
    """The leaves; joined, they are the text."""
    if not text:
        return []
    ends = leaf_ends(text).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@dataclass
class Tree:
    """A Merkle tree: root digest, sections as (digest, paragraphs), paragraphs as (digest, leaf digests).

    Digests of sections and paragraphs are numbers of 48 bits, those of leaves of 24 bits.
    """

    root: str
    sections: list[tuple[int, list[tuple[int, np.ndarray]]]]

    @cached_property
    def leaves(self) -> int:
        return sum(len(own) for _, paragraphs in self.sections for _, own in paragraphs)


def tree(text: bytes) -> Tree:
    """The tree of a text. A paragraph is a line; a section ends after a paragraph whose digest has low
    bits of zero, so that an edit moves section borders only near itself.
    """
    parts = leaves(text)
    digests = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    short = (digests & np.uint64(0xFFFFFF)).astype(np.uint32)
    ends = [i + 1 for i, x in enumerate(parts) if x.endswith(b"\n")]
    if not ends or ends[-1] != len(parts):
        ends.append(len(parts))
    root, section, sections, of_section = blake2b(digest_size=16), blake2b(digest_size=16), [], []
    start = 0
    for end in ends:
        paragraph = blake2b(digests[start:end].tobytes(), digest_size=16).digest()
        section.update(paragraph)
        of_section.append((int.from_bytes(paragraph[:6], "big"), short[start:end]))
        if not paragraph[0] & ((1 << SECTION_BITS) - 1) or end == ends[-1]:
            root.update(section.digest())
            sections.append((int.from_bytes(section.digest()[:6], "big"), of_section))
            section, of_section = blake2b(digest_size=16), []
        start = end
    root.update(xxhash.xxh3_128_digest(text))
    return Tree(root.hexdigest(), sections)


def written(found: Tree) -> str:
    """The tree as text: root|section;section, a section as digest:paragraph,paragraph, a paragraph as digest and four letters a leaf."""
    letters = lambda digest: base64.urlsafe_b64encode(digest.to_bytes(6, "big")).decode()
    leaf_letters = lambda own: base64.urlsafe_b64encode(own.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()).decode()
    return found.root + "|" + ";".join(letters(d) + ":" + ",".join(letters(p) + leaf_letters(own) for p, own in paragraphs) for d, paragraphs in found.sections)


def read(fingerprint_: str) -> Tree:
    """The tree that a fingerprint holds."""
    root, _, rest = fingerprint_.partition("|")
    digest = lambda letters: int.from_bytes(base64.urlsafe_b64decode(letters), "big")

    def leaves_of(letters: str) -> np.ndarray:
        raw = np.frombuffer(base64.urlsafe_b64decode(letters), np.uint8).reshape(-1, 3).astype(np.uint32)
        return raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16

    return Tree(root, [(digest(s[:8]), [(digest(p[:8]), leaves_of(p[8:])) for p in s[9:].split(",")]) for s in rest.split(";")])


def fingerprint(text: str) -> str:
    """The fingerprint of a text; equal texts have equal ones, and only they have equal roots."""
    return written(tree(text.encode("utf-8", "surrogatepass")))


def _unlike(a: list[tuple], b: list[tuple]) -> tuple[list[int], list[int]]:
    """Places of the branches of a and of b that have no equal one on the other side (each is matched once)."""
    alike = Counter(x[0] for x in a) & Counter(x[0] for x in b)
    if not alike:
        return list(range(len(a))), list(range(len(b)))
    out = []
    for side in (a, b):
        left, mine = alike.copy(), []
        for i, x in enumerate(side):
            if left[x[0]]:
                left[x[0]] -= 1
            else:
                mine.append(i)
        out.append(mine)
    return out[0], out[1]


def _compared(a: Tree, b: Tree) -> tuple[int, list[tuple[int, int]]]:
    """Leaves of a and b together that differ, and the (section, paragraph) places of a that b has not.

    Equal roots end the comparison, equal sections and then equal paragraphs are left out unopened;
    only the leaves of paragraphs that differ are compared, as multisets.
    """
    if a.root == b.root:
        return 0, []
    mine, theirs = _unlike(a.sections, b.sections)
    of_a = [(i, k, p) for i in mine for k, p in enumerate(a.sections[i][1])]
    of_b = [p for i in theirs for p in b.sections[i][1]]
    mine, theirs = _unlike([p for _, _, p in of_a], of_b)
    x = np.sort(np.concatenate([of_a[i][2][1] for i in mine] or [np.zeros(0, np.uint32)]))
    y = np.sort(np.concatenate([of_b[i][1] for i in theirs] or [np.zeros(0, np.uint32)]))
    kinds, n = np.unique(x, return_counts=True)
    common = int(np.minimum(n, np.searchsorted(y, kinds, "right") - np.searchsorted(y, kinds, "left")).sum())
    return len(x) + len(y) - 2 * common, [of_a[i][:2] for i in mine]


def compared(a: Tree, b: Tree) -> tuple[float, list[tuple[int, int]]]:
    """Likeness of two trees, and the places of a's paragraphs that b has not.

    Likeness is 1 if the roots are equal, else the share of both trees' leaves that have an equal one.
    """
    if a.root == b.root:
        return 1.0, []
    differ, places = _compared(a, b)
    total = a.leaves + b.leaves
    return min((total - differ) / total, 0.999999) if total else 0.0, places


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints."""
    return compared(read(a), read(b))[0]


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places of a whose branches b does not have; equal branches aren't opened."""
    return compared(read(a), read(b))[1]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, fingerprint of every whole text; null text counts as empty, ids may repeat."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(fingerprint, texts), pa.string())], names=["id", "n_chars", "fingerprint"])

    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(run, f"id {kind}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def followed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (_bucket, _extra, _id, _h, _text), a partition per bucket, sorted so that each row's next document is the next row.

    The order is by falling id, null ids last, then by falling hash of the text. Buckets are ranges of it
    of about equal counts: an id that many rows share, and null ids, are parted by the hash. A bucket's
    last row is followed by a copy of the first document of the next bucket (of the first bucket, for
    the last), marked _extra. What comes to the driver is an id and a hash per bucket.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(map(int, (rows.approxQuantile("_id", [i / n for i in range(1, n)], 0.25 / n) or []) if n > 1 else []), reverse=True)
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_id").isNull()).alias("null")).first()
    null_buckets = max(1, -(-n * count["null"] // max(1, count["n"])))
    at = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    place = 0.5 - F.col("_h") / float(1 << 64)  # 0 for the largest hash, 1 for the least

    def part(of: Column) -> Column:
        return F.least(F.floor(place * of), F.greatest(of, F.lit(1)) - 1)

    ranges = F.size(F.filter(at, lambda c: c > F.col("_id"))) + part(F.size(F.filter(at, lambda c: c == F.col("_id"))))
    bucket = F.when(F.col("_id").isNull(), F.lit(len(cuts) + 1) + part(F.lit(null_buckets))).otherwise(ranges).cast("int")
    heads = sorted((r["b"], tuple(r["head"])) for r in rows.groupBy(bucket.alias("b")).agg(F.max(F.struct("_id", "_h")).alias("head")).collect())
    after: dict[tuple, list[int]] = {}
    for (b, _), (_, head) in zip(heads, heads[1:] + heads[:1], strict=True):
        after.setdefault(head, []).append(b)
    sends = spark.createDataFrame([(*head, bs) for head, bs in after.items()], "_head long, _head_h long, _to array<int>")
    joined = rows.withColumn("_own", bucket).join(F.broadcast(sends), F.col("_id").eqNullSafe(F.col("_head")) & (F.col("_h") == F.col("_head_h")), "left")
    own = F.array(F.struct(F.col("_own").alias("b"), F.lit(0).alias("x")))
    others = F.transform(F.coalesce("_to", F.array().cast("array<int>")), lambda b: F.struct(b.alias("b"), F.lit(1).alias("x")))
    dealt = joined.select("_id", "_h", "_text", F.explode(F.concat(own, others)).alias("_at")).select(F.col("_at.b").alias("_bucket"), F.col("_at.x").alias("_extra"), "_id", "_h", "_text")
    return dealt.repartitionById(len(cuts) + 1 + null_buckets, F.col("_bucket")).sortWithinPartitions("_bucket", "_extra", F.desc_nulls_last("_id"), F.desc("_h"), F.desc("_text"))


OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_branches int, first_edited_branch string"


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, its edited text's, their likeness, and where the trees part.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document in descending order of id; the first follows the last. edited_branches
    is how many of the document's paragraphs the edited text has not, first_edited_branch the first
    of them (section.paragraph, from 0). Texts are shuffled once, dealt by ranges of ids, and read as
    a stream that holds two documents.

    Defined cases: null text counts as empty; null ids come last; repeated ids (and null ones) follow
    each other by a falling hash of their texts; a lone document is followed by itself; a very long
    text is held whole, beside the next one; other columns are ignored; an empty table gives an empty
    result.
    """
    ordered = followed(docs, id_col, text_col).select("_bucket", "_extra", "_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, size = None, [], 0
        for b in small_batches(batches):
            for bucket, extra, id_, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                own = tree(text.encode("utf-8", "surrogatepass"))
                if held is not None and held[0] == bucket:
                    _, before, mine, of = held
                    n = len(mine)
                    raw = (mine[: n - n // 2] + text[: n // 2]).encode("utf-8", "surrogatepass")
                    changed = tree(raw)
                    near, places = compared(before, changed)
                    out.append((of, n, hashlib.sha256(raw).hexdigest(), written(before), written(changed), near, compared(before, own)[0], len(places), "{}.{}".format(*places[0]) if places else None))
                    size += len(out[-1][3]) + len(out[-1][4])
                held = None if extra else (bucket, own, text, id_)
                if len(out) >= 1000 or size > 8 << 20:
                    yield framed(out)
                    out, size = [], 0
        if out:
            yield framed(out)

    def framed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])

    return ordered.mapInArrow(run, OUT).withColumnRenamed("id", id_col)
