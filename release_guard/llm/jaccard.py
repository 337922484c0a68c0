"""Parity-sketch join of texts by the Jaccard similarity of their word shingles.

Texts with the same set of shingles are one class. Between classes:

* Every shingle is XOR-hashed into one of L lanes of 64 bits. A shingle only one of two
  sets has changes one lane, so the number of lanes that differ never exceeds the size of the
  symmetric difference. Sets that link differ in at most D shingles, D following from
  the sizes of a band; L is chosen as D + 1 plus two reserves, so a linked pair has
  more equal lanes than the reserves hold (pigeonhole).
* The first reserve pays for weak lanes, those with few shingles, which agree by chance. A set
  with more weak lanes than the reserve joins on them too.
* The second reserve pays for hot lanes, which more than `hot` classes share. Only a set with more
  hot lanes than the reserve needs them; passages that many texts share do not reach it.

Candidates come in steps, so that no group is turned into all of its pairs: first every member
of a lane with the lane's smallest class; then, in lanes that several components still share,
pairs between components; for hot lanes this is done in blocks, comparing bit
sketches inside a task. Every candidate pair must pass the Hamming bound of its
parity sketches, which have a bit or more for each shingle, and is then verified on
the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import row_groups, small_side, stored_for_now, text_key, text_or_empty
from .components import components

LEAST_BITS = 512
HOT = 24
STAR_ROUNDS = 3
# Members through which a component meets the center of a key in each round.
STAR_MEMBERS = 2
BLOCK = 4096
# Parts in which keys are shuffled.
KEY_PARTS = 3
# Characters of text whose words are hashed together.
GROUP_CHARS = 1 << 20
# Odd multipliers of the hash functions, from the digits of the golden ratio and pi.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x243F6A8885A308D3)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes.

    Words are runs without ASCII white space, A-Z in lower case. A text of fewer
    words than `width` is one shingle, a text without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(_windows(_hashes(words), min(width, len(words))))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for every `width` words in a row."""
    n = max(0, len(hashes) - width + 1)
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = (total ^ (total >> np.uint64(29))) * MIX[i % 4] + hashes[i : n + i]
    return mixed(total)


def shingle_sets(texts: list[str], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For groups of texts: the number of the first, all shingles by text and size, and how many each text has."""
    for start, end in row_groups(map(len, texts), GROUP_CHARS):
        words: list[bytes] = []
        counts = np.zeros(end - start, np.int64)
        for i in range(start, end):
            own = texts[i].encode("utf-8", "surrogatepass").lower().split()
            counts[i - start] = len(own)
            words += own
        hashes = _hashes(words)
        windows = _windows(hashes, width)
        firsts = np.cumsum(counts) - counts
        sets, sizes = [], np.zeros(len(counts), np.int64)
        for i, (first, n) in enumerate(zip(firsts.tolist(), counts.tolist(), strict=True)):
            if not n:
                continue
            own = windows[first : first + n - width + 1] if n >= width else _windows(hashes[first : first + n], n)
            own = np.sort(own)
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            sets.append(own)
            sizes[i] = len(own)
        yield start, np.concatenate(sets) if sets else np.zeros(0, np.uint64), sizes


def set_id(own: np.ndarray) -> int:
    """A fingerprint of a set, as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(own.tobytes(), seed=len(own)) - (1 << 63)


def sketch(own: np.ndarray) -> bytes:
    """Bit b is the parity of the number of shingles hashed to b; there is one bit a shingle at least."""
    size = max(LEAST_BITS, 1 << max(0, len(own) - 1).bit_length())
    bits = np.bincount((own * MIX[3] >> np.uint64(65 - size.bit_length())).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(bits: bytes, length: int) -> bytes:
    """The sketch of the same set with fewer bits, `length` bytes."""
    while len(bits) > length:
        own = np.unpackbits(np.frombuffer(bits, np.uint8))
        bits = np.packbits(own[::2] ^ own[1::2]).tobytes()
    return bits


def hamming(a: bytes, b: bytes) -> int:
    """In how many bits two sketches differ; at most in as many as the sets in shingles."""
    length = min(len(a), len(b))
    return (int.from_bytes(folded(a, length)) ^ int.from_bytes(folded(b, length))).bit_count()


def most_apart(a: int, percent: int) -> int:
    """The largest symmetric difference of two sets that link, the smaller of which has at most a shingles."""
    return (100 - percent) * (a + a * 100 // percent) // (100 + percent)


@cache
def schemes(percent: int) -> list[tuple[int, int, int, int, int]]:
    """Bands of the smaller set's size: (first size, last size, L, weak reserve, hot reserve).

    A pair of sizes a <= b that links has 100 a >= percent b, and differs in at most
    (100 - percent)(a + b) / (100 + percent) shingles.
    """
    bands, first = [], 1
    while first < 1 << 45:
        last = max(first, first * max(130, 10_500 // percent) // 100)
        most = most_apart(last, percent)
        lanes = most + 1 + (most + 1) // 5 + 1
        hot = lanes * 8 // 100
        bands.append((first, last, lanes, lanes - most - 1 - hot, hot))
        first = last + 1
    return bands


def own_schemes(n: int, percent: int) -> list[int]:
    """The schemes a set of n shingles takes part in: of its own size and of all smaller partners."""
    return [k for k, (first, last, *_) in enumerate(schemes(percent)) if first <= n and 100 * last >= percent * n]


def lane_keys(own: np.ndarray, sizes: np.ndarray, scheme: np.ndarray, percent: int, strong: int = 3) -> tuple:
    """The join keys of sorted sets, one after the other, each in its scheme (-1: none), and how many each has."""
    table = np.array([s[2:4] for s in schemes(percent)], np.int64)
    lanes, reserve = np.where(scheme >= 0, table[scheme, 0], 0), table[scheme, 1]
    of = np.repeat(np.arange(len(sizes)), sizes)
    # The lanes of a set are ranges of its hashes, so that they lie in order.
    lane = ((own >> np.uint64(32)) * lanes[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    base = np.cumsum(lanes) - lanes
    place = base[of] + lane
    used = lanes[of] > 0
    own, place = own[used], place[used]
    total = int(lanes.sum())
    parity, count = np.zeros(total, np.uint64), np.zeros(total, np.int64)
    if len(own):
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        parity[place[starts]] = np.bitwise_xor.reduceat(own, starts)
        count[place[starts]] = np.diff(np.append(starts, len(own)))
    holder = np.repeat(np.arange(len(sizes)), lanes)
    weak = count < strong
    too_weak = np.bincount(holder, weak, len(sizes)) > reserve
    kept = np.flatnonzero(~weak | too_weak[holder])
    holder = holder[kept]
    salt = mixed((kept - base[holder]).astype(np.uint64) + (scheme[holder].astype(np.uint64) << np.uint64(48)) + MIX[2])
    return mixed(mixed(parity[kept] + MIX[1]) ^ salt), np.bincount(holder, minlength=len(sizes))


def join_keys(own: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all lanes that sets join on, set by set, and how many each has."""
    # Sets so small that only equal ones link are one class already.
    needed = next(k for k, (_, last, *_) in enumerate(schemes(percent)) if most_apart(last, percent) > 0)
    firsts, lasts = (np.array([s[i] for s in schemes(percent)]) for i in (0, 1))
    scheme = np.searchsorted(firsts, sizes, side="right") - 1
    # The scheme below serves the pairs in which this set is the larger one.
    below = np.where((scheme > 0) & (100 * lasts[scheme - 1] >= percent * sizes), scheme - 1, -1)
    parts = [lane_keys(own, sizes, np.where(part >= needed, part, -1), percent) for part in (scheme, below)]
    holder = np.concatenate([np.repeat(np.arange(len(sizes)), counts) for _, counts in parts])
    found = np.concatenate([found for found, _ in parts])[np.argsort(holder, kind="stable")]
    return found.view(np.int64), sum(counts for _, counts in parts)


def digests(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, text_key, n, set_id, sketch and the keys to join on, of every row."""
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(["doc_id", "text_key", "n", "set_id", "sketch", "keys"], kinds, strict=True)))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, own, sizes in shingle_sets(batch.column(2).to_pylist(), width):
                sets = np.split(own, np.cumsum(sizes)[:-1])
                found, counts = join_keys(own, sizes, percent)
                columns = [c.slice(start, len(sizes)) for c in batch.columns[:2]]
                columns += [pa.array(sizes), pa.array(map(set_id, sets), pa.int64()), pa.array(map(sketch, sets), pa.binary())]
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.array(found)))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text_key", "text").mapInArrow(
        digest, "doc_id long, text_key long, n long, set_id long, sketch binary, keys array<long>"
    )


def shared_keys(digest: DataFrame) -> DataFrame:
    """The keys that several rows have: key and set_id.

    Most keys have one row. They are shuffled one part of the keys after the other, each part
    written down, as a part's shuffle files go before the next part begins.
    """
    every = digest.select(F.explode("keys").alias("key"), "set_id")
    parts = []
    for i in range(KEY_PARTS):
        part = every.where(F.pmod("key", F.lit(KEY_PARTS)) == i)
        several = part.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
        parts.append(stored(part.join(several, "key").distinct(), "lanes"))
    return reduce(DataFrame.unionByName, parts)


def close_enough(pairs: DataFrame, digest: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sizes and sketches do not rule a link out."""
    facts = digest.select("set_id", "n", "sketch")
    for side in "ab":
        pairs = pairs.join(facts.toDF(side, f"n_{side}", f"s_{side}"), side)
    pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column(name).to_numpy() for name in ("n_a", "n_b"))
            most = (100 - percent) * sum(sizes) // (100 + percent)
            sketches = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most.tolist(), strict=True)
            kept = [hamming(a, b) <= d for a, b, d in sketches]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(near, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs a, b that link, by the exact sizes of intersection and union of their sets.

    `classes` tells which row of `docs` has the text of a set; only the texts of `pairs` are read.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    rows = classes.select("set_id", F.col("doc_id").alias("class_doc"), F.col("text_key").alias("class_key"))
    wanted = stored(rows.join(ids, "set_id"), "wanted")
    same = (F.col("text_key") == F.col("class_key")) & F.col("doc_id").eqNullSafe(F.col("class_doc"))
    texts = docs.join(small_side(wanted), same).select("set_id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(text, width).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["set_id", "own"])

    # A row can be there several times; its set is not.
    whole = texts.mapInArrow(sets, "set_id long, own binary").dropDuplicates(["set_id"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                one, other = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(np.intersect1d(one, other, assume_unique=True))
                kept.append(100 * common >= percent * (len(one) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    both = pairs.join(whole.toDF("a", "own_a"), "a").join(whole.toDF("b", "own_b"), "b")
    return both.select("a", "b", "own_a", "own_b").mapInArrow(link, "a long, b long")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _with_component(shared: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.select(F.col("node").alias("set_id"), "component")
    return shared.join(named, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))


def _unresolved(members: DataFrame) -> DataFrame:
    """Members of keys that several components share, with the number of members of the key."""
    several = (
        members.groupBy("key")
        .agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("members"))
        .where("c0 <> c1")
        .select("key", "members")
    )
    return members.join(several, "key")


def _hot_members(shared: DataFrame, digest: DataFrame, hot: int, percent: int) -> DataFrame:
    """The rows of hot keys, of the sets that may have more hot keys in a scheme than its reserve.

    Keys of both schemes of a set are counted together, which takes some sets more than needed.
    """
    rows = shared.where(F.col("members") > hot)
    bands = F.array(*[F.lit(s[0]) for s in schemes(percent)])
    scheme = F.size(F.filter(bands, lambda first: first <= F.col("n")))
    below = F.greatest(scheme - 1, F.lit(1))
    reserve = F.element_at(F.array(*[F.lit(s[4]) for s in schemes(percent)]), below)
    many = rows.groupBy("set_id").agg(F.count("*").alias("n_hot")).join(digest.select("set_id", "n"), "set_id")
    return rows.join(many.where(F.col("n_hot") > reserve).select("set_id"), "set_id")


def _cold_pairs(members: DataFrame) -> DataFrame:
    """All pairs between components inside keys of few members."""
    lists = members.groupBy("key").agg(F.collect_list(F.struct("set_id", "component")).alias("all"))
    one = lists.select("all", F.explode("all").alias("x"))
    later = F.filter("all", lambda y: (y["set_id"] > F.col("x.set_id")) & (y["component"] != F.col("x.component")))
    two = one.select("x", F.explode(later).alias("y"))
    return two.select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b")).distinct()


def _block_pairs(members: DataFrame, digest: DataFrame, percent: int) -> DataFrame:
    """Pairs between components of hot keys that pass the bounds, found in blocks of members.

    Only members outside a key's largest component are compared, with all members. A task
    holds two blocks and emits the pairs that pass.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("in_main")
    )
    rows = members.join(main, "key").join(digest.select("set_id", "n", "sketch"), "set_id")
    others = F.col("members") - F.col("in_main")
    few, many = (F.ceil(n / BLOCK).cast("int") for n in (others, F.col("members")))
    columns = ["key", "set_id", "component", "n", "sketch"]

    def block(n):
        return F.pmod(F.xxhash64("set_id"), n).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    def side(block: DataFrame, i, j) -> DataFrame:
        # New names for all columns, as both sides stem from one table.
        block = block.select(*columns, i.alias("i"), j.alias("j"))
        return block.select(*[F.col(c).alias(c) for c in block.columns])

    left = side(rows.where("component <> main"), block(few), every(many))
    right = side(rows, every(few), block(many))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(one: pa.Table, other: pa.Table) -> pa.Table:
        length = min((len(x) for block in (one, other) for x in block.column("sketch").to_pylist()), default=0)

        def read(block: pa.Table) -> tuple:
            bits = b"".join(folded(x, length) for x in block.column("sketch").to_pylist())
            return *(block.column(c).to_numpy() for c in ("set_id", "component", "n")), np.frombuffer(bits, np.uint64)

        found: list[tuple] = []
        (ids, comps, ns, bits), (ids2, comps2, ns2, bits2) = read(one), read(other)
        bits, bits2 = bits.reshape(len(ids), -1), bits2.reshape(len(ids2), -1)
        for k in range(len(ids)):
            differ = np.bitwise_count(bits2 ^ bits[k]).sum(axis=1)
            near = differ <= (100 - percent) * (ns2 + ns[k]) // (100 + percent)
            near &= (comps2 != comps[k]) & (100 * np.minimum(ns2, ns[k]) >= percent * np.maximum(ns2, ns[k]))
            found += [(min(ids[k], x), max(ids[k], x)) for x in ids2[near].tolist()]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    place = ["key", "i", "j"]
    return left.groupBy(place).cogroup(right.groupBy(place)).applyInArrow(compare, "a long, b long").distinct()


def jaccard_links(
    docs: DataFrame, digest: DataFrame, shared: DataFrame, width: int, percent: int, hot: int = HOT
) -> tuple[DataFrame, DataFrame]:
    """a, b: links between set ids that connect all sets any link connects; and edges that connect the same sets in fewer steps.

    `docs` has doc_id, text and text_key; `digest` is `digests(docs)` without keys, of texts with
    shingles, and `shared` their `shared_keys`, both written down.
    """
    counted = shared.groupBy("key").agg(F.count("*").alias("members"), F.min("set_id").alias("center")).where("members > 1")
    shared = stored(shared.join(counted, "key"), "shared-lanes")
    # The classes that share a key: one row of each.
    some = shared.select("set_id").distinct()
    first = F.min_by(F.struct("doc_id", "text_key", "n", "sketch"), F.struct("doc_id", "text_key")).alias("first")
    firsts = digest.join(some, "set_id").groupBy("set_id").agg(first)
    digest = stored(firsts.select("set_id", "first.*"), "classes")
    hot_rows = stored(_hot_members(shared, digest, hot, percent).drop("members", "center"), "hot-lanes")

    def linked(candidates: DataFrame) -> DataFrame:
        near = stored(close_enough(candidates, digest, percent), "near-pairs")
        return stored(verified(near, docs, digest, width, percent), "links")

    links = linked(shared.where("set_id <> center").select(*_ordered("set_id", "center")).distinct())
    labels = components(links)
    for turn in range(STAR_ROUNDS):
        # Other centers for the members of hot keys that still belong to several components. A component meets the
        # center of a key through a few of its members there, so rows are counted by components, not by members.
        members = _unresolved(_with_component(hot_rows, labels))
        orders = [F.xxhash64("set_id", F.lit(turn * STAR_MEMBERS + i)) for i in range(STAR_MEMBERS)]
        picked = F.array_distinct(F.array(*[F.min_by("set_id", order) for order in orders]))
        some = members.groupBy("key", "component").agg(picked.alias("some"))
        some = stored(some.select("key", "component", F.explode("some").alias("set_id")), "star-members")
        centers = some.groupBy("key").agg(F.min_by(F.struct("set_id", "component"), orders[0]).alias("c"))
        stars = some.join(centers, "key").where("component <> c.component")
        stars = stored(stars.select(*_ordered("set_id", "c.set_id")).distinct(), "stars")
        if stars.isEmpty():
            break
        # Stars lie between components, so their links are new; without any the components stay.
        found = linked(stars)
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(labels.toDF("a", "b").unionByName(found))
    cold = _unresolved(_with_component(shared.where(F.col("members") <= hot).drop("members", "center"), labels))
    rest = stored(_unresolved(_with_component(hot_rows, labels)), "hot-rest")
    pairs = _cold_pairs(cold)
    if not rest.isEmpty():
        pairs = pairs.unionByName(_block_pairs(rest, digest, percent)).distinct()
    found = linked(pairs)
    return links.unionByName(found), labels.toDF("a", "b").unionByName(found)


def _grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The digest of all rows, and doc_id, text_key, n and component of those with shingles."""
    with stored_for_now(digests(docs, width, percent), "keys") as with_keys:
        digest = stored(with_keys.drop("keys"), "digests")
        shared = shared_keys(with_keys)
    full = digest.where("n > 0")
    _, edges = jaccard_links(docs, full, shared, width, percent)
    labels = stored(components(edges), "components")
    component = F.coalesce("component", "set_id").alias("component")
    named = full.join(labels, full["set_id"] == labels["node"], "left")
    return digest, named.select("doc_id", "text_key", "n", component)


def _keyed(df: DataFrame, id_column: str, text: str) -> DataFrame:
    return df.select(
        F.col(id_column).cast("long").alias("doc_id"), text_key(text).alias("text_key"), text_or_empty(text).alias("text")
    )


def jaccard_components(
    df: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row.

    Two texts link when 100 * intersection >= percent * union of their shingle sets.
    Null, empty and blank texts have no shingles, link with nothing and are their own
    component, null if they have no id. Rows of a repeated id are rows of their own. An id
    that is null counts as larger than any other.
    """
    digest, named = _grouped(_keyed(df, id_column, text), width, percent)
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(smallest, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = digest.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def one_of_each_group(
    df: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of df with one row of each component: that of the smallest id, rows without an id last.

    All rows whose texts have no shingles stay, as they link with nothing.
    """
    _, named = _grouped(_keyed(df, id_column, text), width, percent)
    named = stored(named, "groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first")
    winners = named.groupBy("component").agg(first)
    judged = named.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("copies")).join(winners, "component")
    wins = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    # Written down, so that Spark knows how small they are.
    judged = judged.select("doc_id", "text_key", "copies", wins.alias("wins")).where("not wins or copies > 1")
    judged = stored(judged, "losers")
    # Names no table has, as any column of df may clash.
    judged = judged.toDF("judged id", "judged text", "judged copies", "judged wins")
    same = F.col(id_column).cast("long").eqNullSafe(F.col("judged id")) & (text_key(text) == F.col("judged text"))
    unique = df.join(judged, same, "left_anti")
    copies = df.join(judged.where("`judged wins`"), same).dropDuplicates(["judged id", "judged text"])
    return unique.unionByName(copies.select(*[f"`{c}`" for c in df.columns]))
