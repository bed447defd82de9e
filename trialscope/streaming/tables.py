"""Tables that change together: every commit is a snapshot, and parts are files with the range of their keys.

A store is a folder: snapshots/<number>.json names a part map for each table, maps/*.json lists the parts of a
table (file, least and greatest place, rows), and <table>/<commit>/ holds the files. Data and maps are written
first; the snapshot appears last, by a rename, so that a batch is there in all tables or in none. A reader is
bound to one snapshot. There is one writer at a time, and the store must have an atomic rename.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialscope.functions.names import fresh
from trialscope.operators.merge import insert_if_absent, last_write_wins
from trialscope.sources.scratch import as_qualified, drop, get_text, listing, put_once, put_text, qualified

#: Rows that a part is meant to have.
PART_ROWS = 1_000_000
#: Places of a table whose parts are ordered by a hash of the key.
BUCKETS = 4096
#: Snapshots that stay readable.
KEPT = 2


@dataclass(frozen=True)
class Kind:
    """A table's schema and key, and the columns by which its parts are ordered: a hash of the key if there are none.

    Facts are ordered by job and build, so that a build's rows lie together and a new build makes new parts.
    """

    schema: str
    keys: tuple[str, ...]
    by: tuple[str, ...] = ()

    def _types(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in T.StructType.fromDDL(self.schema).fields}

    @property
    def columns(self) -> list[str]:
        return list(self._types())

    def place(self) -> Column:
        """The place of a row as a string whose order is that of the columns."""
        if not self.by:
            return F.lpad(F.hex(F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS))), 4, "0")
        one = lambda c: F.lpad((F.col(c).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0") if self._whole(c) else F.col(c)
        return F.concat_ws("\x00", *(F.coalesce(one(c), F.lit("")) for c in self.by))

    def _whole(self, c: str) -> bool:
        return isinstance(self._types()[c], T.IntegerType | T.LongType)

    def point(self, *values) -> str:
        """place() of rows with these values of the first columns of `by`."""
        return "\x00".join("" if v is None else f"{v + (1 << 63):020d}" if self._whole(c) else v for c, v in zip(self.by, values, strict=False))


@dataclass(frozen=True)
class Part:
    path: str
    low: str
    high: str
    rows: int


@dataclass
class Change:
    """Rows that come into a table: combine(old rows of the touched parts, new rows) gives those parts anew.

    Without combine, the new rows, one per key, replace those of the table. touch has the columns of `by` (or
    the key) of further places whose parts are touched, where no row may have come.
    """

    rows: DataFrame
    combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    touch: DataFrame | None = None


def newest(keys: tuple[str, ...], order: list[Column]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A combination in which the first row of a key in the given order holds, whether it is in the table or comes now."""
    return lambda old, new: last_write_wins(old.unionByName(new), list(keys), order)


def replacing(parents: DataFrame, on: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A combination in which all rows of the given parents go, and the new ones come."""
    gone = parents.select(*on).distinct()

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        same = reduce(lambda a, b: a & b, (old[c].eqNullSafe(gone[c]) for c in on))
        return old.join(gone, same, "left_anti").unionByName(new)

    return combine


@dataclass
class Snapshot:
    """The tables as one commit left them."""

    store: Store
    number: int = 0
    maps: dict[str, str] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)

    def parts(self, name: str) -> list[Part]:
        """The parts of a table, by place; their ranges don't overlap."""
        if name not in self.maps:
            return []
        return [Part(*p) for p in json.loads(get_text(self.store.spark, f"{self.store.path}/{self.maps[name]}"))]

    def read(self, name: str, low: str | None = None, high: str | None = None) -> DataFrame:
        """A table, or its parts that may have rows of places from low to high (beginnings of places count as these)."""
        near = [p for p in self.parts(name) if (low is None or p.high >= low) and (high is None or p.low[: len(high)] <= high)]
        return self.store.read_parts(name, near)


@dataclass
class Store:
    """Tables of the given kinds in a folder."""

    spark: SparkSession
    path: str
    kinds: dict[str, Kind]
    part_rows: int = PART_ROWS

    def numbers(self) -> list[int]:
        """Numbers of the snapshots that are there."""
        return sorted(int(n[:-5]) for n in listing(self.spark, f"{self.path}/snapshots") if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The newest snapshot, or that of a number; an empty one before the first commit."""
        numbers = self.numbers() if number is None else [number]
        if not numbers:
            return Snapshot(self)
        told = json.loads(get_text(self.spark, f"{self.path}/snapshots/{numbers[-1]}.json"))
        return Snapshot(self, numbers[-1], told["maps"], told["done"])

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def read_parts(self, name: str, parts: list[Part]) -> DataFrame:
        kind = self.kinds[name]
        if not parts:
            return self.spark.createDataFrame([], kind.schema)
        return self.spark.read.schema(kind.schema).parquet(*(f"{self.path}/{p.path}" for p in parts))

    def commit(self, changes: dict[str, Change], source: str | None = None, batch: int = 0) -> Snapshot:
        """Make all changes, as one snapshot. A batch of a source that a snapshot already has changes nothing.

        The places of a batch's rows (its builds, or buckets of hashes) come to the driver, its rows don't.
        """
        base = self.snapshot()
        if source is not None and base.done.get(source, -1) >= batch:
            return base
        mark, parts = uuid.uuid4().hex[:12], {name: base.parts(name) for name in changes}
        places = self._places(changes)
        with ThreadPoolExecutor(4) as pool:  # tables don't wait for each other's jobs
            jobs = {name: pool.submit(self._write, name, change, parts[name], places[name], mark) for name, change in changes.items() if places[name]}
            written = {name: job.result() for name, job in jobs.items()}
        new = self._told({name: folder for name, (folder, _) in written.items()})
        for name, (_, touched) in written.items():
            parts[name] = sorted([p for i, p in enumerate(parts[name]) if i not in touched] + new[name], key=lambda p: p.low)
        return self._seal(base, {name: parts[name] for name in written}, base.done | ({source: batch} if source is not None else {}), mark)

    def compact(self, name: str, least: int | None = None) -> Snapshot:
        """Join runs of neighbouring parts of fewer than `least` rows (half of part_rows if None), and split those of twice part_rows."""
        base, least = self.snapshot(), least or self.part_rows // 2
        parts, runs, run = base.parts(name), [], []
        for i, p in enumerate(parts):
            if p.rows >= 2 * self.part_rows:
                runs += [[i]] + ([run] if len(run) > 1 else [])
                run = []
            elif p.rows < least:
                run.append(i)
            else:
                runs, run = runs + ([run] if len(run) > 1 else []), []
        runs += [run] if len(run) > 1 else []
        if not runs:
            return base
        mark, chosen = uuid.uuid4().hex[:12], sorted(i for r in runs for i in r)
        old = self.read_parts(name, [parts[i] for i in chosen])
        folder = self._put(name, old, [parts[r[0]].low for r in sorted(runs)], sum(parts[i].rows for i in chosen), mark)
        new = self._told({name: folder})[name]
        after = sorted([p for i, p in enumerate(parts) if i not in set(chosen)] + new, key=lambda p: p.low)
        return self._seal(base, {name: after}, base.done, mark)

    # Steps of a commit ------------------------------------------------------------------------------------

    def _places(self, changes: dict[str, Change]) -> dict[str, dict[str, int]]:
        """Of each table the places of its change and the rows that come there."""
        one = lambda name, df, n: df.groupBy(self.kinds[name].place().alias("place")).agg(n.alias("n")).select(F.lit(name).alias("name"), "place", "n")
        counts = [one(name, c.rows, F.count(F.lit(1))) for name, c in changes.items()] + [one(name, c.touch, F.lit(0).cast("long")) for name, c in changes.items() if c.touch is not None]
        out: dict[str, dict[str, int]] = {name: {} for name in changes}
        for r in reduce(DataFrame.unionAll, counts).collect():
            out[r["name"]][r["place"]] = out[r["name"]].get(r["place"], 0) + r["n"]
        return out

    def _write(self, name: str, change: Change, parts: list[Part], places: dict[str, int], mark: str) -> tuple[str, set[int]]:
        """(folder, numbers of the parts that it replaces). A place that no part has goes to a new part, in hashed tables to its neighbour."""
        kind, lows, touched, firsts = self.kinds[name], [p.low for p in parts], set(), set()
        for place in places:
            i = bisect_right(lows, place) - 1
            if i >= 0 and place <= parts[i].high:
                touched.add(i)
            elif parts and not kind.by:
                touched.add(max(i, 0))
            else:
                firsts.add((i + 1, place))
        # New files may not reach over parts that stay: a run begins behind each of them.
        stay = [p.low for i, p in enumerate(parts) if i not in touched]
        begins = sorted({*(parts[i].low for i in touched), *(place for _, place in firsts), *([min(places)] if not kind.by else [])})
        starts, last = [], None
        for b in begins:
            at = bisect_right(stay, b)
            if at != last:
                starts.append(b)
                last = at
        new = change.rows.select(*kind.columns)
        old = self.read_parts(name, [parts[i] for i in sorted(touched)])
        combined = change.combine(old, new) if change.combine else insert_if_absent(new, old, list(kind.keys))
        rows = sum(places.values()) + sum(parts[i].rows for i in touched)
        return self._put(name, combined.select(*kind.columns), starts, rows, mark), touched

    def _put(self, name: str, rows: DataFrame, starts: list[str], n: int, mark: str) -> str:
        """Write rows in files that don't reach from one run into the next; a run begins at each of starts."""
        kind, folder, tasks = self.kinds[name], f"{name}/{mark}", max(1, -(-n // self.part_rows))
        place, run = fresh("_place", kind.columns), fresh("_run", kind.columns)
        rows = rows.withColumn(place, kind.place())
        rows = rows.withColumn(run, F.size(F.filter(F.lit(starts[1:]) if starts[1:] else F.array().cast("array<string>"), lambda s: s <= F.col(place))))
        rows = rows.repartitionByRange(tasks, run, place) if tasks > 1 else rows.repartition(1)
        rows.sortWithinPartitions(run, place).drop(place).write.partitionBy(run).parquet(f"{self.path}/{folder}")
        return folder

    def _told(self, folders: dict[str, str]) -> dict[str, list[Part]]:
        """The parts in new folders, with the ranges of their places and their rows."""
        out: dict[str, list[Part]] = {name: [] for name in folders}
        if not folders:
            return out
        one = lambda name, folder: self.spark.read.schema(self.kinds[name].schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{folder}").groupBy(as_qualified(F.col("_metadata.file_path")).alias("file")).agg(F.min(self.kinds[name].place()).alias("low"), F.max(self.kinds[name].place()).alias("high"), F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "file", "low", "high", "n")
        base = qualified(self.spark, self.path)
        for r in reduce(DataFrame.unionAll, [one(name, folder) for name, folder in folders.items()]).collect():
            out[r["name"]].append(Part(r["file"][len(base) + 1 :], r["low"], r["high"], r["n"]))
        return out

    def _seal(self, base: Snapshot, parts: dict[str, list[Part]], done: dict[str, int], mark: str) -> Snapshot:
        """Write the maps, then the snapshot, and delete what no snapshot that stays needs."""
        maps = dict(base.maps)
        for name, found in parts.items():
            maps[name] = f"maps/{name}-{mark}.json"
            put_text(self.spark, f"{self.path}/{maps[name]}", json.dumps([[p.path, p.low, p.high, p.rows] for p in found]))
        put_once(self.spark, f"{self.path}/snapshots/{base.number + 1}.json", json.dumps({"maps": maps, "done": done}))
        self._sweep(list(parts))
        return Snapshot(self, base.number + 1, maps, done)

    def _sweep(self, names: list[str]) -> None:
        """Delete older snapshots, and the maps and folders of the tables that no kept snapshot refers to (also of commits that never were)."""
        numbers = self.numbers()
        kept, past = [self.snapshot(n) for n in numbers[-KEPT:]], [self.snapshot(n) for n in numbers[:-KEPT]]
        maps = {m for s in kept for m in s.maps.values()}
        for name in names:
            files = lambda them, name=name: {p.path for s in {s.maps.get(name): s for s in them}.values() for p in s.parts(name)}
            live = files(kept)
            folders = {path.split("/")[1] for path in live}
            for path in files(past) - live:
                if path.split("/")[1] in folders:
                    drop(self.spark, f"{self.path}/{path}")
            for folder in listing(self.spark, f"{self.path}/{name}"):
                if folder not in folders:
                    drop(self.spark, f"{self.path}/{name}/{folder}")
        for s in past:
            drop(self.spark, f"{self.path}/snapshots/{s.number}.json")
        for m in listing(self.spark, f"{self.path}/maps"):
            if f"maps/{m}" not in maps:
                drop(self.spark, f"{self.path}/maps/{m}")
