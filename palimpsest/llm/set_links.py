"""Classes of linked sets, without all pairs of a group.

A similarity join brings its keys (rows of linked sets share one) and a ``Rule``: how a text
becomes a set, a small signature of it, which signatures may belong to linked sets, and prefix
filters that linked sets pass.  What is common to the joins is here.

* Equal sets are collapsed to nodes first.
* Representatives.  Each row of a key is compared with the key's smallest row by size and
  signature.  Of the representatives that pass, its smallest and its nearest are compared with it
  on full sets.  A group of ``k`` near copies costs about ``k`` such comparisons, and its members
  form one component.
* The rest.  Keys whose rows are in one component by now are done.  In the others, rows of
  different components are compared by size and signature; those that are close form families, and
  within a family rows of different components pass the prefix filters and are compared on full
  sets.  What is emitted spans all links.

A key's or family's largest component is cut into blocks that are sent once, and the few other
rows are sent to each of them; ``KEY_BLOCK``, ``FAMILY_BLOCK`` and ``FAMILY_SHINGLES`` size the
tasks and change no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.prefilter import KeyBitmap
from ..storage import discard, materialize
from .common import WordHashes, column_bytes, mix, odd_constants

#: Rows of a block of a key, and rows and shingles of a block of a family.
KEY_BLOCK, FAMILY_BLOCK, FAMILY_SHINGLES = 4096, 512, 1_000_000
_POSITION = odd_constants(8, 11)


def shingle_set(text: bytes | None, words: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; a shorter text is one run."""
    parts = text.lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    h = words.array(parts)
    if len(h) < width:
        return mix((h * _POSITION[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    n = len(h) - width + 1
    total = h[:n] * _POSITION[0]
    for k in range(1, width):
        total += h[k : k + n] * _POSITION[k]
    return np.unique(mix(total))


class Rule:
    """What a join by ``100 * |A & B| >= percent * |A | B|`` says about single sets and pairs."""

    width: int  # words of a shingle
    percent: int

    def signature(self, members: np.ndarray) -> np.ndarray:
        """A small array of fixed size and type ``uint64``."""
        raise NotImplementedError

    def distances(self, one: np.ndarray, many: np.ndarray) -> np.ndarray:
        """How far signatures are apart."""
        raise NotImplementedError

    def bound(self, n: np.ndarray, m: np.ndarray) -> np.ndarray | int:
        """The largest distance that the signatures of linked sets of ``n`` and ``m`` members may show."""
        raise NotImplementedError

    def prefixes(self, members: np.ndarray) -> list[np.ndarray]:
        """Parts of a set, one per filter, of which linked sets share a member in each."""
        return []

    def shingles(self, text: bytes | None, words: WordHashes) -> np.ndarray:
        return shingle_set(text, words, self.width)

    def alike(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether sets of these sizes can be linked."""
        return 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)

    def linked(self, common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (n + m - common)


def set_digest(members: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    import xxhash

    digest = xxhash.xxh3_128_digest(members.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def common_members(one: np.ndarray, other: np.ndarray) -> int:
    return len(np.intersect1d(one, other, assume_unique=True))


class Spans:
    """Sets side by side, to count what one has in common with many others."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets])
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        names, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.present = np.zeros(len(names), bool)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        mine = self.ids[self.at[i] : self.at[i + 1]]
        self.present[mine] = True
        spans = np.concatenate([self.ids[self.at[j] : self.at[j + 1]] for j in others])
        found = np.add.reduceat(self.present[spans].astype(np.int64), np.concatenate([[0], np.cumsum(self.size[others])[:-1]]))
        self.present[mine] = False
        return found


class Joined:
    """Labels of rows that are connected so far, and the pairs that connected them."""

    def __init__(self, label: np.ndarray):
        self.label = label.copy()
        self.pairs: list[tuple[int, int]] = []

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that are not connected with ``i`` yet."""
        return others[self.label[others] != self.label[i]]

    def join(self, i: int, others: np.ndarray) -> None:
        labels, first = np.unique(self.label[others], return_index=True)
        fresh = labels != self.label[i]
        if fresh.any():
            self.pairs += [(i, int(j)) for j in others[first[fresh]]]
            self.label[np.isin(self.label, labels[fresh])] = self.label[i]


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of equal ``by`` values of a sorted stream, at most one run held beyond a batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in by]
        edge = np.zeros(batch.num_rows, bool)
        for c in columns:
            edge[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(edge).tolist()
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for cut in cuts:
            held.append(batch.slice(start, cut - start))
            yield pa.Table.from_batches(held)
            held, start = [], cut
        held.append(batch.slice(start))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Parts of a sorted stream that end between groups, with the bounds of their groups."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [tuple(batch.column(c)[at].as_py() for c in by) for at in (0, batch.num_rows - 1)]
        held.append(batch)
        if last in (None, ends[0]) and ends[0] == ends[1]:  # sorted: one group so far
            last = ends[1]
            continue
        last = ends[1]
        part, bounds = _with_bounds(held, by)
        yield part.slice(0, bounds[-2]), bounds[:-1]
        held = part.slice(bounds[-2]).to_batches()
    if held:
        yield _with_bounds(held, by)


def _with_bounds(held: list[pa.RecordBatch], by: list[str]) -> tuple[pa.Table, np.ndarray]:
    part = pa.Table.from_batches(held).combine_chunks()
    edge = np.zeros(part.num_rows, bool)
    edge[0] = True
    for c in by:
        values = part.column(c).to_numpy()
        edge[1:] |= values[1:] != values[:-1]
    return part, np.append(np.flatnonzero(edge), part.num_rows)


def _packed(batches: Iterator[pa.RecordBatch | None], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Join many small batches."""
    held, n = [], 0
    for batch in batches:
        if batch is None:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1) if len(column) else np.empty((0, 1), np.uint64)


def _with_representative(rule: Rule):
    """Links of the rows of a block with its first ones, which hold the representative's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        held, leaders = None, []
        for batch in batches:
            pairs = []
            keys, blocks, nodes, members = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "node", "member"))
            for i, text in enumerate(column_bytes(batch, "text")):
                if (keys[i], blocks[i]) != held:
                    held, leaders = (keys[i], blocks[i]), []
                found = rule.shingles(text, words)
                parts = rule.prefixes(found)
                if not members[i]:
                    leaders.append((found, parts))
                elif any(all(common_members(a, b) for a, b in zip(parts, theirs)) and rule.linked(common_members(found, x), len(found), len(x)) for x, theirs in leaders):
                    pairs.append((nodes[i], keys[i]))
            yield _pair_batch(pairs)

    return run


def _pairs_to_compare(group: pa.Table):
    """``(i, mask)``: each row outside the main component with the rows it is to be compared with."""
    main, comp, block = (group.column(c).to_numpy() for c in ("main", "comp", "block"))
    across, first = group.column("t")[0].as_py() == 1, group.column("p")[0].as_py() == 0
    at = np.arange(len(main))
    for i in np.flatnonzero(~main):
        later = (at > i) & ~main
        mask = later & (block != block[i]) if across else main | (later & first)
        yield int(i), mask & (comp != comp[i])


#: Groups of at most so many rows are compared together with others of their size.
SMALL = 8


def _close_pairs(rule: Rule):
    """Pairs that span the rows of different components of one key whose signatures are close."""

    def pairs(group: pa.Table) -> pa.RecordBatch:
        node, size = group.column("node").to_numpy(), group.column("n").to_numpy()
        fine = _signatures(group.column("fine"))
        joined = Joined(np.arange(len(node)))
        for i, mask in _pairs_to_compare(group):
            other = joined.apart(i, np.flatnonzero(mask & rule.alike(size[i], size)))
            joined.join(i, other[rule.distances(fine[i], fine[other]) <= rule.bound(size[i], size[other])])
        return _pair_batch([(node[i], node[j]) for i, j in joined.pairs])

    def pairs_of_small(part: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        """The rows of a group at places a < b, for all groups of a size at once."""
        node, size, comp, main, block, t, p = (part.column(c).to_numpy() for c in ("node", "n", "comp", "main", "block", "t", "p"))
        count = np.diff(bounds)
        ones, others = [], []
        for rows in range(2, SMALL + 1):
            first = bounds[:-1][count == rows]
            for a in range(rows - 1) if len(first) else ():
                for b in range(a + 1, rows):
                    i, j = first + a, first + b
                    meets = np.where(t[i] == 1, ~main[j] & (block[i] != block[j]), main[j] | (p[i] == 0))
                    asked = ~main[i] & meets & (comp[i] != comp[j]) & rule.alike(size[i], size[j])
                    ones.append(i[asked]), others.append(j[asked])
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ones, others))
        if len(i):
            fine = part.column("fine")
            close = rule.distances(_signatures(fine.take(pa.array(i))), _signatures(fine.take(pa.array(j)))) <= rule.bound(size[i], size[j])
            i, j = i[close], j[close]
        return pa.RecordBatch.from_arrays([pa.array(node[x], pa.int64()) for x in (i, j)], names=["a", "b"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds in _whole_groups(batches, ["key", "t", "p", "q"]):
            yield pairs_of_small(part, bounds)
            for g in np.flatnonzero(np.diff(bounds) > SMALL):
                yield pairs(part.slice(bounds[g], bounds[g + 1] - bounds[g]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(found(batches))

    return run


def _confirmed(rule: Rule):
    """Links that join different components of one family: signatures, prefix filters, full sets."""

    def links(group: pa.Table, words: WordHashes) -> pa.RecordBatch:
        node, comp = group.column("node").to_numpy(), group.column("comp").to_numpy()
        texts = (t.as_buffer().to_pybytes() if t.is_valid else None for t in group.column("text").cast(pa.large_binary()))
        sets = [rule.shingles(t, words) for t in texts]
        whole = Spans(sets)
        size, fine = whole.size, np.stack([rule.signature(x) for x in sets])
        filters = [Spans(list(x)) for x in zip(*(rule.prefixes(x) for x in sets))]
        joined = Joined(np.unique(comp, return_inverse=True)[1])  # rows of one component are linked already
        for i, mask in _pairs_to_compare(group):
            other = joined.apart(i, np.flatnonzero(mask & rule.alike(size[i], size)))
            other = other[rule.distances(fine[i], fine[other]) <= rule.bound(size[i], size[other])]
            while len(other):
                some = other[:256]
                for part in filters:
                    some = some[part.common(i, some) > 0] if len(some) else some
                if len(some):
                    joined.join(i, some[rule.linked(whole.common(i, some), size[i], size[some])])
                other = joined.apart(i, other[256:])
        return _pair_batch([(node[i], node[j]) for i, j in joined.pairs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        yield from _packed(links(g, words) for g in _groups(batches, ["key", "t", "p", "q"]) if g.num_rows > 1)

    return run


def _near(rule: Rule):
    """Rows whose two signatures are within the bound, with their distance ``d``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = rule.distances(_signatures(batch.column("fine")), _signatures(batch.column("lfine")))
            near = d <= rule.bound(batch.column("n").to_numpy(), batch.column("ln").to_numpy())
            columns = [batch.column(c) for c in ("node", "leader", "n", "ln")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(d, pa.int32())], names=["node", "leader", "n", "ln", "d"]).filter(pa.array(near))

    return run


def _tasks(members: DataFrame, rows: int, weight: int) -> DataFrame:
    """Rows ``(key, node, comp, weight, ...)`` of keys with several components, dealt to tasks ``(t, p, q)``.

    ``main`` marks the rows of the key's largest component.  Its blocks ``p`` meet the blocks ``q``
    of the other rows at ``t = 0``; two different blocks of other rows meet at ``t = 1``.
    """
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("weight").alias("w"))
    one = parts.groupBy("key").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("c", "comp")).alias("top"), F.max(F.struct("c", "comp", "w")).alias("m"), F.sum("c").alias("c"), F.sum("w").alias("w")).filter("comps > 1")
    blocks = lambda c, w: F.greatest(F.ceil(c / rows), F.ceil(w / weight), F.lit(1)).cast("int")
    sized = one.select("key", "top", blocks(F.col("m.c"), F.col("m.w")).alias("ps"), blocks(F.col("c") - F.col("m.c"), F.col("w") - F.col("m.w")).alias("qs"))
    placed = members.join(sized, "key").withColumn("main", F.col("comp") == F.col("top"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("ps")).otherwise(F.col("qs"))).cast("int"))
    task = lambda t, p, q: F.struct(F.lit(t).alias("t"), p.alias("p"), q.alias("q"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = F.col("block")
    with_others = F.transform(upto("qs"), lambda q: task(0, mine, q))
    with_main = F.transform(upto("ps"), lambda p: task(0, p, mine))
    among = F.transform(F.filter(upto("qs"), lambda o: o != mine), lambda o: task(1, F.least(mine, o), F.greatest(mine, o)))
    dealt = F.when(F.col("main"), with_others).otherwise(F.concat(with_main, among))
    return placed.withColumn("task", F.explode(dealt)).select(*members.columns, "main", "block", "task.*")


def _in_tasks(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("key", "t", "p", "q").sortWithinPartitions("key", "t", "p", "q", "main", "node")


def linked_classes(docs: DataFrame, sketch: DataFrame, keys_of: Callable[[DataFrame], DataFrame], rule: Rule, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, repeated)``, one row per row of ``sketch``.

    ``docs``: ``(doc_id, text)``.  ``sketch``: ``(doc_id, n_shingles, set_hi, set_lo, fine, *extra)``,
    where ``fine`` is the rule's signature; it is deleted in the end.  ``keys_of`` gives
    ``(key, node)`` of the nodes ``(node, *extra)``; linked sets must share a key.  ``repeated``
    tells that several rows have this doc_id.
    """
    percent = rule.percent
    spent: list[DataFrame] = [sketch]

    def stored(df: DataFrame, name: str) -> DataFrame:
        spent.append(materialize(df, name))
        return spent[-1]

    def components(edges: DataFrame) -> DataFrame:
        spent.append(connected_components(edges))
        return spent[-1]

    def texts_of(nodes: DataFrame) -> DataFrame:
        """``(node, text)``: the bitmap spares the other texts the shuffle."""
        wanted = KeyBitmap(nodes, F.xxhash64("node")).mark(docs, F.xxhash64("doc_id")).filter("maybe")
        return wanted.select(F.col("doc_id").alias("node"), "text")

    named = sketch.filter("doc_id is not null")
    nodes = stored(named.filter("n_shingles > 0").groupBy("set_hi", "set_lo", F.col("n_shingles").alias("n"), "fine", *extra).agg(F.min("doc_id").alias("node")), "nodes")
    keys = materialize(keys_of(nodes.select("node", *extra)), "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("leader")).filter("c > 1")
    in_key = stored(keys.join(shared, "key").select("key", "node", "leader"), "in_key")
    discard(keys)

    signed = nodes.select("node", "n", "fine")
    to_leader = in_key.filter("node <> leader").select("node", "leader").distinct()
    compared = to_leader.join(signed, "node").join(signed.withColumnsRenamed({"node": "leader", "n": "ln", "fine": "lfine"}), "leader")
    sized = compared.filter(100 * F.least("n", "ln") >= percent * F.greatest("n", "ln")).select("node", "leader", "n", "ln", "fine", "lfine")
    near = sized.mapInArrow(_near(rule), "node long, leader long, n long, ln long, d int")
    # a row asks its smallest and its nearest representative; the rest decides what these two leave open
    best = near.groupBy("node").agg(F.max("n").alias("n"), F.min(F.struct("leader", "ln")).alias("low"), F.min(F.struct("d", "leader", "ln")).alias("nearest"))
    two = F.array_distinct(F.array(F.struct("low.leader", "low.ln"), F.struct("nearest.leader", "nearest.ln")))
    likely = stored(best.select("node", "n", F.explode(two).alias("x")).select("node", "n", "x.leader", "x.ln"), "likely")
    blocks = likely.groupBy("leader").agg(F.max("ln").alias("ln"), F.greatest(F.ceil(F.count("*") / FAMILY_BLOCK), F.ceil(F.sum("n") / FAMILY_SHINGLES)).cast("int").alias("blocks"))
    members = likely.join(blocks.select("leader", "blocks"), "leader").select(F.col("leader").alias("key"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node", F.lit(True).alias("member"))
    leaders = blocks.select(F.col("leader").alias("key"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("leader").alias("node"), F.lit(False).alias("member"))
    asked = stored(members.unionByName(leaders), "asked")
    texts = asked.join(texts_of(asked.select("node").distinct()), "node")
    starred = stored(texts.repartition("key", "block").sortWithinPartitions("key", "block", "member", "node").mapInArrow(_with_representative(rule), "a long, b long"), "starred")

    # labels of rows that are surely connected: a row's representative, and that one's, four steps up at most
    up = starred.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("top"))
    for _ in range(2):
        higher = up.select(F.col("node").alias("top"), F.col("top").alias("higher"))
        up = stored(up.join(higher, "top", "left").select("node", F.coalesce("higher", "top").alias("top")), "labels")
    component = up.withColumnRenamed("top", "component")
    labelled = in_key.join(component, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"), F.lit(0).alias("weight"))
    dealt = _tasks(labelled, KEY_BLOCK, 1).join(signed, "node")
    close = stored(_in_tasks(dealt).mapInArrow(_close_pairs(rule), "a long, b long").distinct(), "close")
    family = components(close)
    weights = nodes.groupBy("node").agg(F.max("n").alias("weight"))
    in_family = family.join(weights, "node").join(component.withColumnRenamed("component", "comp"), "node", "left").select(F.col("component").alias("key"), "node", F.coalesce("comp", "node").alias("comp"), "weight")
    dealt = _tasks(in_family, FAMILY_BLOCK, FAMILY_SHINGLES).join(texts_of(family), "node")
    links = stored(_in_tasks(dealt).mapInArrow(_confirmed(rule), "a long, b long"), "links")

    placed = stored(
        named.select("doc_id", "n_shingles", "set_hi", "set_lo").join(nodes.select("set_hi", "set_lo", "node"), ["set_hi", "set_lo"], "left").select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node")),
        "placed",
    )
    several = placed.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("hi"), F.count("*").alias("rows")).filter("rows > 1")
    twice = stored(several, "twice")
    same = placed.join(twice.filter("b < hi").select("doc_id", "b"), "doc_id").select(F.col("node").alias("a"), "b")
    # links between labels: what one label of a row leaves out, and the links of the rest
    tops = component.select(F.col("component").alias("node")).distinct().join(component, "node").select(F.col("node").alias("a"), F.col("component").alias("b"))
    second = starred.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("b")).filter("low < b").select("a", "b")
    label = lambda df, c: df.withColumnRenamed(c, "node").join(component, "node", "left").withColumn(c, F.coalesce("component", "node")).drop("node", "component")
    between = label(label(second.unionByName(links).unionByName(same), "a"), "b").select("a", "b").unionByName(tops).filter("a <> b").distinct()
    last = components(between).withColumnRenamed("node", "label").withColumnRenamed("component", "component_id")
    out = (
        placed.join(component, "node", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "node").alias("label"))
        .join(last, "label", "left")
        .join(twice.select("doc_id", F.lit(True).alias("repeated")), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "label").alias("component_id"), F.coalesce("repeated", F.lit(False)).alias("repeated"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
    nameless = sketch.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(False).alias("repeated"), F.lit(True).alias("kept"))
    found = materialize(out.unionByName(nameless).select("doc_id", "n_shingles", "component_id", "kept", "repeated"), "near_duplicates")
    for df in spent:
        discard(df)
    return found
