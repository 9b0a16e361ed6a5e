"""Near-duplicates by fast similarity sketches, bands of their coordinates, and exact verification."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from costweave.llm.components import connected
from costweave.llm.shared import forget_others, passing_tables, slices, with_maybe, words, written

#: Coordinates of a sketch, of which bands take ROWS each, and bits of a coordinate that order it within its round.
SIZE, ROWS, FRACTION = 512, 4, 48
#: The chances of missing a pair at the very threshold: no band in common, too few equal bits.
NO_BAND, TOO_FEW = 4e-6, 1e-6
#: Members of a bucket compared by the bits of their sketches, and shingles compared in one task.
DIRECT, AT_ONCE = 2048, 4_000_000
#: Words whose hashes a worker remembers, bytes of text it holds at once, and sets it sketches at once.
REMEMBERED, SLICE, TOGETHER = 100_000, 1_000_000, 512
M64 = (1 << 64) - 1


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all others."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingler(width: int) -> Callable[[str | None], np.ndarray]:
    """From a text to the sorted distinct hashes of its runs of ``width`` words; of fewer words, of all as one run."""
    known: dict[bytes, int] = {}

    def one(text: str | None) -> np.ndarray:
        tokens = words(text)
        if len(known) > REMEMBERED:
            known.clear()
        digest = xxhash.xxh3_64_intdigest
        for w in tokens:
            if w not in known:
                known[w] = digest(w)
        codes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        if not tokens:
            return codes
        n = max(1, len(tokens) - width + 1)
        run = min(width, len(tokens))
        out = np.full(n, run, np.uint64)
        for k in range(run):
            out = mixed(out) + codes[k:k + n]
        return np.unique(mixed(out))

    return one


def sketches(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """A row of ``size`` coordinates for each set; none of the sets is empty.

    In each round every element falls by its hash into a bin, with a value; a bin keeps the least of the first
    round that reaches it. Rounds go on until all bins of a set are filled: after ``size`` rounds an
    element falls into one bin after the other, so 2 * ``size`` rounds always do. As the same hashes fill
    both sketches, two sets agree in a coordinate with the chance of their similarity, and as bins are filled
    without replacement the agreements gather around it at least as closely as independent draws would.
    """
    docs = len(sets)
    table = np.full((docs, size), np.uint64(M64))
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(docs), [len(s) for s in sets])
    todo = np.arange(docs)
    for turn in range(2 * size):
        if not len(todo):
            break
        x = mixed(flat + np.uint64((turn + 1) * 0xD1B54A32D192ED03 & M64))
        value = (x & np.uint64((1 << FRACTION) - 1)) | np.uint64(turn << FRACTION)
        place = (((x >> np.uint64(FRACTION)) * np.uint64(size)) >> np.uint64(64 - FRACTION)).astype(np.int64)
        np.minimum.at(table.reshape(-1), owner * size + (place if turn < size else turn - size), value)
        left = (table[todo] == np.uint64(M64)).any(axis=1)
        if not left.all():
            going = np.zeros(docs, bool)
            going[todo[left]] = True
            stays = going[owner]
            flat, owner, todo = flat[stays], owner[stays], todo[left]
    return table


def n_bands(least: float) -> int:
    """How many bands, so that a pair of similarity ``least`` has none in common with a chance of NO_BAND."""
    count = math.ceil(math.log(NO_BAND) / math.log1p(-least ** ROWS))
    if count * ROWS > SIZE:
        raise ValueError(f"a similarity of {least} is too low for sketches of {SIZE} coordinates")
    return count


def enough_bits(least: float) -> int:
    """The equal bits, one for each coordinate, that a pair of similarity ``least`` has but for TOO_FEW."""
    p, tail = (1 + least) / 2, 0.0
    for m in range(SIZE + 1):
        tail += math.comb(SIZE, m) * p ** m * (1 - p) ** (SIZE - m)
        if tail > TOO_FEW:
            return m
    return SIZE


def _sketched(docs: DataFrame, width: int, least: float) -> DataFrame:
    """doc_id, size and digest of the set of every whole text, and its band keys and sketch bits."""
    bands = n_bands(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        shingles = shingler(width)
        for batch in slices(batches, limit=SLICE):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            filled = [i for i, s in enumerate(sets) if len(s)]
            table = np.concatenate([np.zeros((0, SIZE), np.uint64), *(
                sketches([sets[i] for i in filled[at:at + TOGETHER]]) for at in range(0, len(filled), TOGETHER))])
            seeds = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            keys = np.tile(seeds, (len(filled), 1))
            for k in range(ROWS):
                keys = mixed(keys ^ table[:, k:bands * ROWS:ROWS])
            bits = np.packbits((table & np.uint64(1)).astype(bool), axis=1)
            own_keys: list = [None] * len(sets)
            own_bits: list = [None] * len(sets)
            for row, i in enumerate(filled):
                own_keys[i], own_bits[i] = keys[row].view(np.int64), bits[row].tobytes()
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array(own_keys, pa.list_(pa.int64())), pa.array(own_bits, pa.binary())],
                names=["doc_id", "size", "digest", "keys", "bits"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, size long, digest binary, keys array<bigint>, bits binary"))


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, pa.Table]]:
    """(first row, rows) of each run of equal ``columns`` over sorted batches, in pieces of one batch at most: a run
    that began in an earlier piece has a first row above zero."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
        cut = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            now = tuple(keys[a].tolist())
            seen = seen if now == last else 0
            yield seen, batch.slice(a, b - a)
            last, seen = now, seen + b - a


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, node), sorted by key, whose key has another row beside it."""
    held_key = held_node = np.zeros(0, np.int64)
    open_ = False                                # whether the row held back has an equal one before it
    for batch in batches:
        key = np.r_[held_key, batch.column("key").to_numpy()]
        node = np.r_[held_node, batch.column("node").to_numpy()]
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        keep = np.r_[open_, same] | np.r_[same, False]
        yield pa.record_batch([key[:-1][keep[:-1]], node[:-1][keep[:-1]]], names=["key", "node"])
        held_key, held_node, open_ = key[-1:], node[-1:], bool(keep[-1])
    if open_:
        yield pa.record_batch([held_key, held_node], names=["key", "node"])


def forest(count: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links (first, other) that join 0 .. count - 1 as nearness does, directly or in steps, all to the first of theirs;
    ``near`` takes one and several others."""
    left, out = np.arange(count), []
    while len(left):
        first, left = int(left[0]), left[1:]
        todo = [first]
        while todo and len(left):
            hit = near(todo.pop(), left)
            out += [(first, b) for b in left[hit].tolist()]
            todo += left[hit].tolist()
            left = left[~hit]
    return out


def _alike(least: float, direct: int) -> Callable:
    """Over (key, size, node, bits) sorted by key: links between members of a bucket whose bits and sizes may be those
    of similar sets. A bucket of more than ``direct`` members becomes one chain; its members are compared later."""
    enough, parts = enough_bits(least), round(least * 1000)

    def linked(pieces: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        node, size = (np.concatenate([p.column(c).to_numpy() for p in pieces]) for c in ("node", "size"))
        raw = b"".join(x for p in pieces for x in p.column("bits").to_pylist())
        bits = np.frombuffer(raw, np.uint64).reshape(len(node), SIZE // 64)

        def near(i: int, others: np.ndarray) -> np.ndarray:
            equal = SIZE - np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
            small, large = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
            return (equal >= enough) & (small * 1000 >= parts * large)

        return [(int(node[x]), int(node[y])) for x, y in forest(len(node), near)]

    def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*links) if links else ([], []))],
                               names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        held: list[pa.RecordBatch] = []
        last = None                              # of a run too long to be held, the node its chain ends with
        for first, piece in _runs(batches, ["key"]):
            if first == 0:
                links += linked(held) if held else []
                held, last = [], None
            held.append(piece)
            if last is not None or first + piece.num_rows > direct:
                chain = ([] if last is None else [last]) + [n for p in held for n in p.column("node").to_pylist()]
                links += zip(chain, chain[1:])
                held, last = [], chain[-1]
            if len(links) > 50_000:
                yield batch_of(links)
                links = []
        yield batch_of(links + (linked(held) if held else []))

    return run


def _members(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """``wanted`` (first_doc, digest, node, ...) with the set of each node, made anew from the documents' texts."""
    names = [c for c in wanted.columns if c not in ("first_doc", "digest")]
    texts = docs.select(F.col("doc_id").cast("long").alias("first_doc"), F.col("text").cast("string"))
    texts = (with_maybe(texts, "first_doc", wanted, "maybe").where("maybe").drop("maybe")
             .join(wanted.hint("shuffle_merge"), "first_doc"))     # alike at every size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        shingles = shingler(width)
        for batch in slices(batches, limit=SLICE):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            # A repeated doc_id may stand beside other texts.
            own = [i for i, (s, d) in enumerate(zip(sets, batch.column("digest").to_pylist()))
                   if xxhash.xxh3_128_digest(s.tobytes()) == d]
            take = batch.take(pa.array(own, pa.int64()))
            yield pa.record_batch([*(take.column(c) for c in names),
                                   pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))],
                                  names=[*names, "set"])

    kinds = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in names)
    return texts.mapInArrow(run, f"{kinds}, set array<bigint>")


def joined(nodes: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between nodes that join all pairs of a similarity of ``least``, decided on the whole sets."""
    nodes, first = np.unique(nodes, return_index=True)
    sets, parts = [sets[i] for i in first.tolist()], round(least * 1000)
    size = np.array([len(s) for s in sets], np.int64)
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    ids = [ids[e - n:e] for e, n in zip(ends.tolist(), size.tolist())]
    mark = np.zeros(len(distinct), np.int32)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        small, large = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
        hit = small * 1000 >= parts * large
        some = others[hit]
        if len(some):
            mark[ids[i]] = 1
            flat = np.concatenate([ids[j] for j in some.tolist()])
            both = np.add.reduceat(mark[flat], np.r_[0, np.cumsum(size[some])[:-1]])
            mark[ids[i]] = 0
            hit[hit] = both * 1000 >= parts * (size[some] + size[i] - both)
        return hit

    return [(int(nodes[a]), int(nodes[b])) for a, b in forest(len(nodes), near)]


def _verified(least: float) -> Callable:
    """Over (root, x, y, node, set) sorted by group (root, x, y): links of each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[np.ndarray] = []
        sets: list[np.ndarray] = []

        def settle() -> pa.RecordBatch:
            links = joined(np.concatenate(nodes), sets, least) if nodes else []
            return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*links) if links else ([], []))],
                                   names=["a", "b"])

        for first, piece in _runs(batches, ["root", "x", "y"]):
            if first == 0:
                yield settle()
                nodes, sets = [], []
            nodes.append(piece.column("node").to_numpy())
            lists = piece.column("set")
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sets += [flat[a:b].copy() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield settle()

    return run


def links(docs: DataFrame, firsts: DataFrame, sketched: DataFrame, least: float, width: int) -> DataFrame:
    """Links (a, b) of nodes that join all pairs of different sets of a similarity of ``least``.

    Sets that share a band meet in a bucket. There the bits of the sketches say which may be similar, and a
    spanning forest of these links, never all pairs, gives candidate groups. All similar pairs lie within groups, so
    each set goes to its group once and is compared with whole sets. A group of more than AT_ONCE shingles
    is dealt into blocks, and every two blocks meet.
    """
    own = sketched.join(firsts, [sketched.digest.eqNullSafe(firsts.digest), sketched.doc_id == firsts.first_doc],
                        "left_semi").select("digest", "size", "keys", "bits")
    nodes = written(own.join(firsts.select("digest", "node"), "digest").dropDuplicates(["node"]), "nodes")
    met = written(nodes.select(F.explode("keys").alias("key"), "node").repartition("key")
                  .sortWithinPartitions("key").mapInArrow(_shared, "key long, node long"), "met")
    candidates = written(met.join(nodes.select("node", "size", "bits"), "node").repartition("key")
                         .sortWithinPartitions("key", "node").select("key", "size", "node", "bits")
                         .mapInArrow(_alike(least, DIRECT), "a long, b long"), "candidates")
    groups = connected(candidates).join(nodes.select("node", "size", "digest"), "node").join(
        firsts.select("digest", "first_doc"), "digest")
    groups = written(groups, "groups")
    blocks = groups.groupBy("root").agg(F.ceil(F.sum("size") / AT_ONCE).cast("int").alias("blocks"))
    wanted = written(groups.join(blocks, "root").select("first_doc", "digest", "root", "blocks", "node"), "wanted")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = (_members(docs, width, wanted).withColumn("z", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
               .withColumn("other", other)
               .select("root", F.least("z", "other").cast("long").alias("x"),
                       F.greatest("z", "other").cast("long").alias("y"), "node", "set"))
    return written(members.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
                   .mapInArrow(_verified(least), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, least: float = 0.8, width: int = 5, empty_alike: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that is reached by similar pairs.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space. A document's set holds its distinct
    runs of ``width`` words, or all its words as one run if there are fewer; similarity is the size of the
    intersection over that of the union, and pairs of ``least`` or more are linked. Documents without words have
    an empty set and their own doc_id as component_id (``empty_alike``: the smallest of theirs). Rows with a
    null doc_id get a null component_id and link nothing. Rows of a repeated doc_id all come back, each with the
    component of its own text. An empty table gives no rows; other columns are ignored. Equal sets meet as
    one before anything is compared, so groups of copies cost no more than one document.
    """
    sketched = written(_sketched(docs, width, least), "sketched")
    firsts = written(sketched.where("doc_id IS NOT NULL AND size > 0").groupBy("digest")
                     .agg(F.min("doc_id").alias("first_doc"))
                     .withColumn("node", F.monotonically_increasing_id()), "firsts")
    with passing_tables(docs.sparkSession):
        roots = written(connected(links(docs, firsts, sketched, least, width)), "roots", kept=True)
    # Only sets with a link need another component than their first document.
    joined_ = firsts.join(roots, "node")
    smallest = joined_.groupBy("root").agg(F.min("first_doc").alias("least_doc"))
    moved = joined_.join(smallest, "root").select("digest", "least_doc")
    component = firsts.join(moved, "digest", "left").select(
        "digest", F.coalesce("least_doc", "first_doc").alias("component"))
    nothing = F.lit(None).cast("long")
    if empty_alike:
        nothing = sketched.where("size = 0").agg(F.min("doc_id")).scalar()
    return (sketched.select("doc_id", "size", "digest").join(component, "digest", "left")
            .select("doc_id", F.col("size").alias("n_shingles"),
                    F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("size") > 0, F.col("component"))
                    .otherwise(F.coalesce(nothing, F.col("doc_id"))).alias("component_id")))
