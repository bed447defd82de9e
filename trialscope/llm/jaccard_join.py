"""N-gram Jaccard self-join through a token-group matrix; exact, with components of the links.

Documents with equal shingle sets are one node. Similar nodes are put into bounded groups. The matrix
holds, per token and group, what a member with that token could still share, for the tokens of
members' prefixes (the first tokens in a common order, rare ones first, one of which any similar pair
has in common). A query joins the matrix on its own prefix, drops the groups whose bound is below the
overlap that the threshold asks for, and only the rest is opened: there the group's whole token union
bounds the overlap once more before members are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import drop_path, has_bits, kept_table, key_bits, release, small_batches, text_of
from trialscope.llm.components import components
from trialscope.llm.shingles import Words, shingle_set

#: Counters of the sketch of document frequencies, as a power of two: it is of fixed size.
SKETCH_BITS = 20
#: Bits of the filter of node ids, as a power of two.
FILTER_BITS = 24
#: Members of a group, and members from which a group's own leaders are linked first.
GROUP, LARGE = 64, 32
#: Rows of a list up to which each row is looked at for a possible partner in it.
SHORT_LIST = 256
#: Rows of one list that a task holds, and documents from which a token's list may be spread over tasks.
HELD, HOT_LIST = 100_000, 4096
#: Queries that ask a group in one task, and tasks over which the rows of a class of equal sets are dealt.
ASKERS, SALTS = 512, 16


def needed(a, b, percent: int):
    """Least intersection of sets of sizes a and b with Jaccard similarity percent/100."""
    return -(-(percent * (a + b)) // (100 + percent))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))


def frequency_sketch(rows: DataFrame, k: int) -> np.ndarray:
    """How many documents have a token of each hash bucket; bounded arrays are summed in two steps."""
    parts = 16
    width = (1 << SKETCH_BITS) // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in small_batches(batches):
            found = [shingle_set(t, words, k) for t in b.column(0).to_pylist()]
            if found:
                total += np.bincount((np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total)).astype(np.uint32)
        if total.any():
            blobs = [total[i * width : (i + 1) * width].tobytes() for i in range(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(np.random.randint(0, 1 << 30, parts), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "salt", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.uint32).astype(np.uint64)
        for part, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], names=["part", "salt", "counts"])

    schema = "part int, salt int, counts binary"
    summed = rows.select("text").mapInArrow(count, schema).repartition(parts * 4, "part", F.col("salt") % 4).mapInArrow(add, schema).repartition(parts, "part").mapInArrow(add, schema)
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in summed.toLocalIterator():
        out[r["part"] * width : (r["part"] + 1) * width] += np.frombuffer(r["counts"], np.uint32)
    return out


def token_levels(sketch: np.ndarray) -> tuple[np.ndarray, int]:
    """Place of each bucket in the order, and the first place of hot ones.

    Places are 0 for buckets near the mean, then by the power of two above it. A bucket is hot if its
    count is over HOT_LIST and over what is usual: a token of it may be in very many documents.
    """
    mean = sketch.mean()
    usual = mean + 6 * np.sqrt(mean) + 8
    return np.ceil(np.log2(np.maximum(sketch / usual, 1))).astype(np.uint8), int(np.log2(max(1, HOT_LIST / usual))) + 1


def set_table(rows: DataFrame, shared: Broadcast, k: int, percent: int) -> DataFrame:
    """id, n, key (128-bit hash of the set), the prefix tokens in the common order, and how many of them aren't hot.

    shared has token_levels(); hot tokens are at the end of the order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (level, hot) = Words(), shared.value
        for b in small_batches(batches):
            sizes, keys, prefixes, usual = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, words, k)
                n = len(s)
                sizes.append(n)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                place = level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                first = np.lexsort((s, place))[: n - -(-(percent * n) // 100) + 1 if n else 0]
                prefixes.append(s[first].view(np.int64))
                usual.append(int((place[first] < hot).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(usual, pa.int32())], names=["id", "n", "key", "prefix", "usual"])

    return rows.select("id", "text").mapInArrow(run, "id long, n long, key binary, prefix array<long>, usual int")


def has_partner(n: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of a list have another row with which they could reach the needed overlap."""
    ok = np.minimum(rest[:, None], rest[None]) >= needed(n[:, None], n[None], percent)
    np.fill_diagonal(ok, False)
    return ok.any(1)


def prefix_size(n: Column, percent: int) -> Column:
    return F.floor((100 - percent) * n / 100) + 1


def shared_lists(prefixes: DataFrame, percent: int) -> DataFrame:
    """token, node, n, rest, ok for rows that may share their token with another node.

    rest is how many tokens the node has from that one on; ok, whether another row of the list could
    reach the needed overlap if this token is the first that both have. Rows are shuffled once, by
    token; those of hot tokens are spread over tasks and all ok. The list of any other token is in one
    task, which holds at most HELD of its rows: lists of one row go, short ones are looked at closely,
    rows of others are all ok.
    """
    one = prefixes.select(F.col("id").alias("node"), F.col("n").cast("int").alias("n"), "usual", F.posexplode("prefix").alias("pos", "token"))
    rows = one.select("token", "node", "n", (F.col("n") - F.col("pos")).alias("rest"), (F.col("pos") >= F.col("usual")).alias("hot"))
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(1024))).otherwise(0)
    lists = rows.repartition("token", spread).sortWithinPartitions("token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        passed: int | None = None  # the token of a list of which a part has gone on

        def handed_on(cols: list[np.ndarray], ok: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(ok)], names=["token", "node", "n", "rest", "ok"])

        def marked(cols: list[np.ndarray]) -> pa.RecordBatch:
            token, _, n, rest = cols
            ok = np.ones(len(token), bool)
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            sizes = np.diff(np.r_[starts, len(token)])
            two = starts[sizes == 2]
            ok[two] = ok[two + 1] = np.minimum(rest[two], rest[two + 1]) >= needed(n[two].astype(np.int64), n[two + 1], percent)
            several = (sizes > 2) & (sizes <= SHORT_LIST)
            for s, size in zip(starts[several].tolist(), sizes[several].tolist(), strict=True):
                ok[s : s + size] = has_partner(n[s : s + size].astype(np.int64), rest[s : s + size], percent)
            going_on = token == passed
            ok |= going_on
            kept = np.repeat(sizes > 1, sizes) | going_on
            return handed_on([c[kept] for c in cols], ok[kept])

        for b in batches:
            *cols, hot = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if hot.any():
                yield handed_on([c[hot] for c in cols], np.ones(int(hot.sum()), bool))
                cols = [c[~hot] for c in cols]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # sorted by token: the last list may go on
            if last:
                yield marked([c[:last] for c in cols])
                passed = None
            held = [c[last:] for c in cols]
            if len(held[0]) > HELD:
                yield handed_on(held, np.ones(len(held[0]), bool))
                passed, held = int(held[0][0]), None
        if held is not None and len(held[0]):
            yield marked(held)

    return lists.mapInArrow(run, "token long, node long, n int, rest int, ok boolean")


def _texts(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """node and text of the documents whose ids pass a filter of nodes' ids, so that few other texts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            b = b.filter(pa.array(has_bits(b.column(0).to_numpy(zero_copy_only=False), bits)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["node", "text"])

    return rows.where("id is not null").select("id", "text").mapInArrow(run, "node long, text string")


def _open(rows: DataFrame, members: DataFrame, queries: DataFrame, k: int, percent: int, name: str) -> tuple[DataFrame, str]:
    """Links (a, b) that connect each group's members and queries as all their links would, kept in the shared folder.

    members and queries have grp and node. A group that many queries ask is opened in several tasks, of
    about ASKERS queries each, each with all its members. Texts (smaller than their shingles' hashes)
    are dealt by group and task and sorted, members first; a task holds one group's members (GROUP at
    most) and a query. A query is compared with every member, but of members that earlier queries have
    connected only one is linked with it.
    """
    tasks = queries.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("long").alias("_tasks"))
    own = F.xxhash64("grp", F.pmod(F.xxhash64("node", F.lit(5)), F.col("_tasks")))
    asking = queries.join(tasks, "grp").select("node", own.alias("grp"), F.lit(1).alias("kind"))
    asked = members.join(tasks, "grp").withColumn("_task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tasks") - 1))).select("node", F.xxhash64("grp", "_task").alias("grp"), F.lit(0).alias("kind"))
    sent, sent_path = kept_table(asked.union(asking), f"{name}-sent")
    shared = rows.sparkSession.sparkContext.broadcast(key_bits(sent.select("node"), FILTER_BITS))
    both = _texts(rows, shared).join(sent, "node").select("grp", "kind", "node", "text").repartition("grp").sortWithinPartitions("grp", "kind", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        group, nodes, sets, index = None, [], [], None
        for b in small_batches(batches):
            a_out, b_out = [], []
            for grp, kind, node, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                s = shingle_set(text, words, k)
                n = len(s)
                if grp != group:
                    group, nodes, sets, index = grp, [], [], None
                if kind == 0:
                    nodes.append(node)
                    sets.append(s)
                    continue
                if not nodes:
                    continue
                if index is None:
                    of = np.array(list(map(len, sets)))
                    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), of)
                    order = np.argsort(flat, kind="stable")
                    index = flat[order], owner[order], of, np.arange(len(sets))
                flat, owner, of, joint = index
                left, right = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                if (right > left).sum() < needed(n, max(n * percent // 100, int(of.min())), percent):
                    continue  # the group's token union has too little of the query
                counts = right - left
                places = np.repeat(left - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
                common = np.bincount(owner[places], minlength=len(nodes))
                alike = np.flatnonzero((100 * common >= percent * (n + of - common)) & (common > 0))
                for label in np.unique(joint[alike]).tolist():
                    a_out.append(node)
                    b_out.append(nodes[int(alike[joint[alike] == label][0])])
                if len(alike):
                    joint[np.isin(joint, joint[alike])] = joint[alike].min()
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    links = kept_table(both.mapInArrow(run, "a long, b long"), name)
    shared.destroy()
    drop_path(rows.sparkSession, sent_path)
    return links


def _with_common(met: DataFrame, placed: DataFrame) -> DataFrame:
    """met (q, grp, tail, least) with c: how many prefix tokens of the query any member of the group has in its own prefix.

    A pair of a query and a group is one row here, whatever they share; the pairs of a group are dealt to tasks of some ASKERS.
    """
    tasks = met.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("long").alias("_tasks"))
    own = placed.join(met.select(F.col("q").alias("node")).distinct(), "node", "left_semi").groupBy(F.col("node").alias("q")).agg(F.collect_list("token").alias("q_tokens"))
    theirs = placed.join(tasks, "grp").groupBy("grp", "_tasks").agg(F.collect_set("token").alias("g_tokens"))
    dealt = theirs.withColumn("_task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tasks") - 1))).drop("_tasks")
    asking = met.join(tasks, "grp").withColumn("_task", F.pmod(F.xxhash64("q", F.lit(5)), F.col("_tasks"))).drop("_tasks").join(own, "q")
    return asking.join(dealt, ["grp", "_task"]).select("q", "grp", "tail", "least", F.size(F.array_intersect("q_tokens", "g_tokens")).alias("c"))


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, links): id, n, key of every row; key, node, size of equal sets; and links (a, b) that connect all similar nodes.

    node is the smallest id with an equal set; empty sets and rows without an id are in no class. links
    holds only true links; pairs that are already connected through others may be left out of it.
    """
    spark, paths = docs.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out, path = kept_table(df, name)
        paths.append(path)
        return out

    rows = _rows(docs, id_col, text_col)
    levels = spark.sparkContext.broadcast(token_levels(frequency_sketch(rows, k)))
    sets, sets_path = kept_table(set_table(rows, levels, k, percent), "sets")
    levels.destroy()
    release(spark)
    classes, classes_path = kept_table(sets.where("id is not null and n > 0").groupBy("key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("size")), "classes")
    first = sets.where("n > 0").join(classes, (sets["key"] == classes["key"]) & (sets["id"] == classes["node"]), "left_semi").dropDuplicates(["id", "key"])
    lists = kept(shared_lists(first, percent), "lists")

    # Nodes with a possible partner, their groups, and their rows of the lists.
    first_hash, second_hash = F.min(F.xxhash64("token", F.lit(1))), F.min(F.xxhash64("token", F.lit(2)))
    in_groups = lists.where("ok").groupBy("node").agg(first_hash.alias("h1"), second_hash.alias("h2"), F.max("n").alias("n"))
    in_groups = kept(in_groups.withColumn("h1", F.xxhash64("h1", F.floor(F.log("n") / float(np.log(100 / percent))))), "in-groups")
    counted = in_groups.groupBy("h1").agg(F.count(F.lit(1)).alias("size"))
    chunk = F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("size") / GROUP).cast("long"))
    groups = kept(in_groups.join(counted, "h1").select("node", "n", "h1", "h2", F.xxhash64("h1", chunk).alias("grp")), "groups")
    mine = kept(lists.join(groups.select("node", "grp"), "node").withColumn("tail", (F.col("n") - prefix_size(F.col("n"), percent)).cast("int")).select("token", "node", "grp", "n", "rest", "tail"), "mine")

    def alpha(a: Column, b: Column) -> Column:
        return F.ceil(percent * (a + b) / float(100 + percent))

    # In large groups, nodes are first linked to one or two leaders, so that big clusters are one part early.
    by_key = groups.select("node", F.explode(F.array("h1", "h2")).alias("key"))
    leaders = by_key.groupBy("key").agg(F.min_by("node", F.xxhash64("node", F.lit(4))).alias("leader"), F.count(F.lit(1)).alias("size")).where(F.col("size") > LARGE)
    to_leader = by_key.join(leaders, "key").where("node <> leader").select("node", "leader").distinct()
    theirs = mine.select("token", F.col("node").alias("leader"), F.col("n").alias("m"), F.col("tail").alias("m_tail"))
    met = to_leader.join(mine, "node").join(theirs, ["leader", "token"]).groupBy("node", "leader", "n", "m", "tail", "m_tail").agg(F.count(F.lit(1)).alias("c"))
    plausible = kept(met.where(F.col("c") + F.greatest("tail", "m_tail") >= alpha(F.col("n"), F.col("m"))).select("node", "leader"), "plausible")
    leading = plausible.select(F.col("leader").alias("node"), F.col("leader").alias("grp")).distinct()
    early, early_path = _open(rows, leading, plausible.select("node", F.col("leader").alias("grp")), k, percent, "early-links")
    parts = components(early)
    release(spark)

    # The matrix, and the groups that a query's bounds let it open: first by parts, so that no pair inside one part is made.
    placed = kept(mine.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).select("token", "node", "grp", "n", "rest", "tail", "part"), "placed")
    matrix = placed.groupBy("token", "grp").agg(F.max("rest").alias("g_rest"), F.min("n").alias("g_least"), F.max("n").alias("g_most"), F.max("tail").alias("g_tail"), F.min("part").alias("p_least"), F.max("part").alias("p_most"))
    of_parts = placed.select("token", "part").distinct().join(matrix, "token").where(~((F.col("p_least") == F.col("part")) & (F.col("p_most") == F.col("part")))).drop("p_least", "p_most")
    queries = placed.select("token", "part", F.col("node").alias("q"), F.col("n").alias("q_n"), F.col("rest").alias("q_rest"), F.col("tail").alias("q_tail"))
    least = alpha(F.col("q_n"), F.greatest("q_n", "g_least"))
    # A similar pair reaches the needed overlap from its first common token on: only such rows are made of a frequent token.
    reaches = (F.col("g_most") >= F.col("q_n")) & (100 * F.col("q_n") >= percent * F.col("g_least")) & (F.least("q_rest", "g_rest") >= least)
    met = queries.join(of_parts, ["token", "part"]).where(reaches).groupBy("q", "grp").agg(F.max(F.greatest("q_tail", "g_tail")).alias("tail"), F.min(least).alias("least"))
    asked = kept(_with_common(kept(met, "met"), placed).where("c + tail >= least").select(F.col("q").alias("node"), "grp"), "asked")
    members = groups.select("node", "grp").join(asked.select("grp").distinct(), "grp", "left_semi")
    late, late_path = _open(rows, members, asked, k, percent, "late-links")
    for path in paths:
        drop_path(spark, path)
    release(spark)
    return sets.select("id", "n", "key"), classes, early.union(late)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id of every row: components of links with Jaccard >= percent/100.

    Two sets link when 100 * intersection >= percent * union; every link between different sets is
    found (tokens are 64-bit hashes of shingles).

    Defined cases: null text counts as empty; a row with an empty set, or without an id, is linked with
    nothing, and its component is its own id; rows that share an id are one document, what links one
    of them links all; equal sets are one class; a very long text is one row; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    sets, classes, links = similar_links(docs, id_col, text_col, k, percent)
    parts, _ = kept_table(components(links), "parts")
    # Only classes of several rows are joined by key, with their rows dealt over SALTS tasks; the others are nodes by themselves.
    several = classes.where("size > 1").join(parts, "node", "left").select("key", F.coalesce("component", "node").alias("of_class"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = sets.withColumn("salt", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)).cast("int")))
    found = salted.join(several, ["key", "salt"], "left")
    alone = parts.select(F.col("node").alias("id"), F.col("component").alias("of_node"))
    named = found.join(alone, "id", "left").withColumn("of_node", F.when(F.col("salt").isNotNull() & F.col("of_class").isNull(), F.col("of_node")))
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("of_class", "of_node", "id").alias("component_id"))
