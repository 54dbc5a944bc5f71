"""Operator 4: n-gram Jaccard join by grouped prefixes.

Texts of equal shingle sets are one class. A class's shingles are put in one order for all: those that are not known to
be frequent by hash, then the frequent ones from rare to common. Two sets of Jaccard similarity t or more share one of
the first n - ceil(t n) + 1 shingles, the prefix. Classes of identical prefix and size are one group, and groups, not
classes, are joined on prefix shingles. Pairs of groups are filtered by size, by the places of the shared shingle, and
by parity bitmaps: bits in which two bitmaps differ are no more than shingles in which the sets differ, so no link is
lost. Where more than ``run`` groups share a shingle, their pairs are not written out: the bitmaps are brought to the
groups, and those whose bitmaps allow a link are connected where they are, by a forest. A group's bitmap has the bits that all of its
classes agree on. Groups that are connected are a
cluster. A shingle alone never makes one: shingles that many texts share grow with the input, and would tie all texts.

Groups are then expanded to their classes and verified, cluster by cluster, on whole shingle sets: from each class the
unreached ones within its bounds of size are counted against, until nothing more is reached. That finds the cluster's
components exactly, as a row a class, never all pairs. In a cluster whose sets exceed ``block_shingles`` each class is first
compared with a few pivots, in many tasks. What they tie together is known to be one part; only the rest is verified
further, against itself and that part, in pairs of blocks: classes are dealt by bands of size, each a similarity wide, and
those in blocks, as only classes of one band or of neighbouring ones can be linked. Each pair of blocks is a task.

Shingles are told apart by 128 bits, made of two hashes of each word; sets are counted, compared and verified by them. The
first 64 bits alone order, group and filter, where equal ones cost work and lose nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, LOWER_TABLE, digest, frugal, key_map, materialise, may_hold, shingle_hashes, shingle_pairs, text_bytes, with_one_a_key, word_hashes
from .components import connected_components


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """Sorted distinct 128-bit shingles, two columns."""
    return shingle_pairs(word_hashes(raw.translate(LOWER_TABLE), 2)[0], k)


def needed(n: int, similarity: int) -> int:
    """The least overlap of a set of n with any set that it is similar to, ``similarity`` being in hundredths."""
    return -(-similarity * n // 100)


def linked(overlap, n, m, similarity: int):
    return 100 * overlap >= similarity * (n + m - overlap)


def map_bits(n: int, similarity: int) -> int:
    """Bits of the bitmap of a set of n, a power of two: half of them is what unlike sets differ in, well above what similar
    ones may. A larger set never has a smaller map."""
    differ = 2 * n * (100 - similarity) // (100 + similarity)
    return 1 << max(6, min(n - 1, (5 * differ) // 2 + 63).bit_length())


def bitmap(shingles: np.ndarray, similarity: int) -> bytes:
    """Parity of the shingles that fall on each bit."""
    bits = map_bits(len(shingles), similarity)
    parity = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, loose: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bitmaps, and of their bits that aren't known (0 in the bitmap), made ``width`` words wide."""
    shape = (len(bits), bits.shape[1] // width, width)
    loose = np.bitwise_or.reduce(loose.reshape(shape), axis=1)
    return np.bitwise_xor.reduce(bits.reshape(shape), axis=1) & ~loose, loose


def differing(a: bytes, b: bytes, loose_a: bytes | None = None, loose_b: bytes | None = None) -> int:
    """Bits in which two bitmaps are known to differ, the longer folded to the shorter."""
    maps = [np.frombuffer(x, dtype=np.uint64).reshape(1, -1) for x in (a, b)]
    loose = [np.frombuffer(x, dtype=np.uint64).reshape(1, -1) if x else np.zeros_like(m) for x, m in zip((loose_a, loose_b), maps, strict=True)]
    width = min(m.shape[1] for m in maps)
    (x, u), (y, v) = (folded(m, l, width) if m.shape[1] > width else (m, l) for m, l in zip(maps, loose, strict=True))
    return int(np.bitwise_count((x ^ y) & ~(u | v)).sum())


# --- frequent shingles -----------------------------------------------------------------------------------------------
def frequent_shingles(docs: DataFrame, k: int, least: int = 32, most: int = 500_000, chunk: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent shingles and how often they were counted: ``most`` at most, the most frequent ones.

    Only the order of shingles depends on them, and any order gives the same links. So each task sends what it has seen
    twice in a chunk, and a power of two is chosen above which no more than ``most`` lie.
    """

    def count(batches):
        held: list[np.ndarray] = []
        n = 0

        def flush():
            nonlocal held, n
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            held, n = [], 0
            often = counts >= 2
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often])], names=["token", "n"])

        for batch in batches:
            for raw in text_bytes(batch.column(0)):
                held.append(shingle_hashes(word_hashes(raw.translate(LOWER_TABLE))[0][0], k))
                n += len(held[-1])
                if n >= chunk:
                    yield flush()
        if held:
            yield flush()

    counted = materialise(docs.select("text").mapInArrow(frugal(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "frequent")
    sizes = sorted(((r["p"], r["c"]) for r in counted.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("c")).collect()), reverse=True)
    total, cut = 0, None
    for p, c in sizes:
        if total + c > most:
            break
        total, cut = total + c, p
    if cut is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    got = counted.where(F.col("n") >= 2**cut).toArrow()
    tokens, counts = got.column("token").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def prefix(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: int) -> tuple[np.ndarray, int]:
    """The first shingles in the order for all, and how many of them aren't frequent."""
    n = len(shingles)
    p = n - needed(n, similarity) + 1
    tokens, counts = frequent
    if not len(tokens):
        return shingles[:p], p
    at = np.minimum(np.searchsorted(tokens, shingles), len(tokens) - 1)
    often = tokens[at] == shingles
    first = shingles[~often][:p]
    rare = len(first)
    if rare < p:
        late = np.lexsort((shingles[often], counts[at[often]]))
        first = np.concatenate([first, shingles[often][late][: p - rare]])
    return first, rare


# --- classes and groups ----------------------------------------------------------------------------------------------
def described(docs: DataFrame, k: int, similarity: int, frequent) -> DataFrame:
    """doc_id, key, n, h (128 bits of the whole set), p (of n and prefix), prefix, rare (prefix shingles that aren't
    frequent), bits, for each row of ``docs`` (doc_id, text, key)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    types = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary())

    def one(raw):
        s = shingle_set(raw, k)
        if not len(s):
            return 0, b"", b"", [], 0, b""
        half = np.ascontiguousarray(s[:, 0])
        first, rare = prefix(half, shared.value, similarity)
        return len(s), digest(s.tobytes()), digest(len(s).to_bytes(8, "little") + first.tobytes()), first.view(np.int64), rare, bitmap(half, similarity)

    def describe(batches):
        for batch in batches:
            out = [one(raw) for raw in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True))], names=["doc_id", "key", "n", "h", "p", "prefix", "rare", "bits"])

    return docs.mapInArrow(frugal(describe), "doc_id long, key string, n long, h binary, p binary, prefix array<long>, rare int, bits binary")


def classes_of(rows: DataFrame) -> DataFrame:
    """One row for each shingle set: c (a number), h, copies (rows that have it), least (smallest doc_id), of (the key of one
    of its texts), n, p, prefix, rare, bits."""
    first = [F.first(x).alias(x) for x in ("n", "p", "prefix", "rare", "bits")]
    one = rows.where("n > 0").groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min("key").alias("of"), *first)
    return materialise(one.withColumn("c", F.monotonically_increasing_id()), "classes")


def groups_of(classes: DataFrame, n_classes: int) -> DataFrame:
    """One row for each prefix and size: g (a number), p, members, n, prefix, rare, bits and loose: bits on which its classes
    don't agree, null if it has one."""
    first = [F.first(x).alias(x) for x in ("n", "prefix", "rare")]
    named = classes.groupBy("p").agg(F.count("*").alias("members"), F.min("c").alias("g"), *first, F.when(F.count("*") == 1, F.first("bits")).alias("bits"))
    named = materialise(named, "named")
    several = named.where("members > 1").drop("bits")

    def combine(batches):
        """Bits that are set in all, and in any, row of g: whole where rows are sorted by it, else of parts."""
        held: dict[int, tuple[int, int, int]] = {}
        out = lambda xs: pa.RecordBatch.from_arrays([pa.array([g for g, _ in xs], pa.int64()), *(pa.array([x[i].to_bytes(x[2], "little") for _, x in xs], pa.binary()) for i in (0, 1))], names=["g", "every", "some"])
        g = None
        for batch in batches:
            for g, every, some in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x, y = int.from_bytes(every, "little"), int.from_bytes(some, "little")
                a, b, size = held.get(g, (x, y, len(every)))
                held[g] = (a & x, b | y, size)
            if held:
                last = held.pop(g)
                yield out(list(held.items()))
                held = {g: last}
        if held:
            yield out(list(held.items()))

    def loosened(batches):
        for batch in batches:
            bits = [(int.from_bytes(x, "little"), int.from_bytes(y, "little"), len(x)) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([(x ^ y).to_bytes(size, "little") for x, y, size in bits], pa.binary())], names=["g", "bits", "loose"])

    kind = "g long, every binary, some binary"
    told = with_one_a_key(classes.select("p", "bits"), several.select("p", "g", "members"), "p", "members", n_classes).select("g", F.col("bits").alias("every"), F.col("bits").alias("some"))
    maps = told.mapInArrow(combine, kind).repartition("g").sortWithinPartitions("g").mapInArrow(lambda batches: loosened(combine(batches)), "g long, bits binary, loose binary")
    alone = named.where("members = 1").withColumn("loose", F.lit(None).cast("binary"))
    return materialise(alone.unionByName(several.join(maps, "g")), "groups")


def pairs_in_runs(tokens: np.ndarray, sizes: np.ndarray, groups: np.ndarray, places: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of groups in each run of equal tokens, rows being by token and size, that size and places allow."""
    out_a, out_b = [], []
    for lag in range(1, len(tokens)):
        near = np.flatnonzero(tokens[lag:] == tokens[:-lag])
        if not len(near):
            break
        i, j = near, near + lag
        n, m = sizes[i], sizes[j]
        most = np.minimum(places[i], places[j]) + 1 + np.minimum(n - places[i], m - places[j]) - 1
        ok = (100 * n >= similarity * m) & ((100 + similarity) * np.minimum(most, n) >= similarity * (n + m))
        out_a.append(groups[i[ok]])
        out_b.append(groups[j[ok]])
    if not out_a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return np.minimum(a, b), np.maximum(a, b)


def candidates(groups: DataFrame, similarity: int, run: int) -> DataFrame:
    """a, b, held: pairs of groups that share a prefix shingle (held 0); where more than ``run`` share one, each of these
    groups and the shingle (held 1, or 2 for a hub).

    Frequent shingles are counted first. Those that more groups hold than a task should see are hubs, fewer than HOT_KEYS:
    they are broadcast, so that their groups stay where they are.
    """
    postings = groups.select("g", "n", "rare", F.posexplode("prefix").alias("place", "token"))
    often = groups.agg(F.sum(F.size("prefix") - F.col("rare")).alias("n")).first()["n"] or 0
    counted = postings.where("place >= rare").groupBy("token").agg(F.count("*").alias("c"))
    hot = F.broadcast(materialise(counted.where(F.col("c") > max(4 * run, often // HOT_KEYS)).select("token"), "hot"))
    hubs = postings.join(hot, "token", "left_semi").select(F.col("g").alias("a"), F.col("token").alias("b"), F.lit(2).alias("held"))
    postings = postings.join(hot, "token", "left_anti")

    def meet(batches):
        tail: list[np.ndarray] | None = None
        going: int | None = None  # token of a long run that still goes on

        def batch_of(a, b, held):
            pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), held, dtype=np.int32))], names=["a", "b", "held"])

        def work(cols, last):
            """Pairs of all runs that are complete; what is left of the last one stays."""
            nonlocal tail, going
            tokens, sizes, names, places = cols
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            lengths = np.diff(np.append(starts, len(tokens)))
            long = lengths > run
            if going == tokens[0]:
                long[0] = True
            keep = 0 if last or long[-1] else int(lengths[-1])
            end = len(tokens) - keep
            of_long = np.repeat(long, lengths)
            if of_long.any():
                yield batch_of(names[of_long], tokens[of_long], 1)
            going = int(tokens[-1]) if long[-1] and not last else None
            short = ~of_long
            short[end:] = False
            if short.any():
                yield batch_of(*pairs_in_runs(tokens[short], sizes[short], names[short], places[short], similarity), 0)
            tail = [x[end:] for x in cols] if keep else None

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if tail is not None:
                cols = [np.concatenate([t, c]) for t, c in zip(tail, cols, strict=True)]
            yield from work(cols, False)
        if tail is not None:
            yield from work(tail, True)

    dealt = postings.select("token", "n", "g", F.col("place").cast("long").alias("place")).repartition("token").sortWithinPartitions("token", "n", "g")
    return dealt.mapInArrow(meet, "a long, b long, held int").union(hubs).distinct()


def passing(pairs: DataFrame, groups: DataFrame, similarity: int) -> DataFrame:
    """a, b of the pairs whose bitmaps allow the similarity, and links that connect the groups of each long run as all such
    pairs would."""
    side = lambda x: groups.select(F.col("g").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "bits", "loose")))
    both = pairs.where("held = 0").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb", "loosea", "looseb")

    def test(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            differ = np.array([differing(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(4, 8)), strict=True)], dtype=np.int64)
            ok = pa.array(differ <= may_differ(n, m, similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return both.mapInArrow(test, "a long, b long").union(links_in_runs(pairs.where("held > 0"), groups, similarity))


def may_differ(n, m, similarity: int):
    """The most shingles in which sets of n and m may differ if they are similar."""
    return n + m - 2 * -(-similarity * (n + m) // (100 + similarity))


def run_forest(names: np.ndarray, sizes: np.ndarray, maps: list[bytes], loose: list[bytes | None], similarity: int) -> list[tuple[int, int]]:
    """Links that connect a run's groups as all pairs that sizes and bitmaps allow would. Rows are by size."""
    lo, hi = np.searchsorted(sizes, -(-similarity * sizes // 100)), np.searchsorted(sizes, 100 * sizes // similarity, side="right")
    if (hi - lo == 1).all():
        return []
    widths = np.array([len(m) // 8 for m in maps])
    tables: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # first row, end of the rows of just this width, bits of all rows from the first on
    end = len(maps)
    for width in np.unique(widths)[::-1].tolist():
        first = int(np.searchsorted(widths, width))
        bits, unknown = (np.frombuffer(b"".join(x), dtype=np.uint64).reshape(-1, width) for x in (maps[first:end], [u or bytes(8 * width) for u in loose[first:end]]))
        if tables:
            bits, unknown = (np.concatenate(x) for x in zip((bits, unknown), folded(*tables[-1][2:], width), strict=True))
        tables.append((first, end, bits, unknown))
        end = first
    left, out = np.ones(len(maps), dtype=bool), []
    for seed in np.flatnonzero(hi - lo > 1).tolist():
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            near = lo[x] + np.flatnonzero(left[lo[x] : hi[x]])
            if not len(near):
                continue
            differ = np.zeros(len(near), dtype=np.int64)
            for first, end, bits, unknown in tables:  # bitmaps are compared in the smaller one's width
                if first <= x:
                    here = near >= first if x < end else (near >= first) & (near < end)
                    if here.any():
                        y = near[here] - first
                        differ[here] = np.bitwise_count((bits[y] ^ bits[x - first]) & ~(unknown[y] | unknown[x - first])).sum(axis=1)
            near = near[differ <= may_differ(sizes[x], sizes[near], similarity)]
            left[near] = False
            for y in near.tolist():
                out.append((int(names[x]), int(names[y])))
                queue.append(y)
    return out


def links_in_runs(runs: DataFrame, groups: DataFrame, similarity: int, most: int = 20_000) -> DataFrame:
    """Links a, b within the groups a that share a shingle b. Of a run of more than ``most`` in a task all are tied to one.

    A hub's groups are dealt by size, in ranges fourfold each: those that may be similar to a larger one in the next range go
    there too.
    """
    size_range = lambda n: F.floor(F.log(n.cast("double")) / F.lit(math.log(4))).cast("int")
    n = F.col("n")
    ranges = F.when(F.col("held") == 2, F.sequence(size_range(n), size_range(F.floor(100 * n / similarity)))).otherwise(F.array(F.lit(-1)))
    rows = runs.join(groups.select(F.col("g").alias("a"), "n", "bits", "loose"), "a")
    dealt = rows.select("b", F.explode(ranges).alias("range"), "n", "a", "bits", "loose").repartition("b", "range").sortWithinPartitions("b", "range", "n", "a")

    def connect(batches):
        key, held, count, first = None, [], 0, 0

        def of(links):
            links = np.array(links, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(links.min(axis=1)), pa.array(links.max(axis=1))], names=["a", "b"])

        def done():
            if count > 1 and held:
                return run_forest(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), *([m for x in held for m in x[i]] for i in (2, 3)), similarity)
            return []

        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, places, sizes, names = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            maps, loose = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            edges = [0, *(1 + np.flatnonzero((tokens[1:] != tokens[:-1]) | (places[1:] != places[:-1]))).tolist(), len(tokens)]
            out = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if (now := (int(tokens[lo]), int(places[lo]))) != key:
                    out += done()
                    key, held, count, first = now, [], 0, int(names[lo])
                count += hi - lo
                held.append((names[lo:hi], sizes[lo:hi], maps[lo:hi], loose[lo:hi]))
                if count > most:
                    out += [(first, y) for x in held for y in x[0].tolist() if y != first]
                    held = []
            yield of(out)
        yield of(done())

    return dealt.mapInArrow(connect, "a long, b long")


# --- verification ----------------------------------------------------------------------------------------------------
def numbered(shingles: np.ndarray) -> np.ndarray:
    """A number from 0 on for each 128-bit shingle, equal for equal ones."""
    order = np.argsort(shingles[:, 0])
    s = shingles[order]
    same, other = s[1:, 0] == s[:-1, 0], s[1:, 1] != s[:-1, 1]
    if (same & other).any():
        order = np.lexsort((shingles[:, 1], shingles[:, 0]))
        s = shingles[order]
        same, other = s[1:, 0] == s[:-1, 0], s[1:, 1] != s[:-1, 1]
    out = np.empty(len(s), dtype=np.int64)
    out[order] = np.concatenate([[0], np.cumsum(~same | other)])
    return out


def forest(names: list[int], sets: list[np.ndarray], similarity: int) -> Iterator[tuple[int, int]]:
    """Links that connect the sets as all of their links would: each set is tied to the one it was reached from."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    names, sets = [names[i] for i in order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    tokens = numbered(np.concatenate(sets))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(tokens.max() + 1, dtype=bool)
    left = np.ones(len(sets), dtype=bool)
    flat, owners, reached = tokens, np.repeat(np.arange(len(sets)), sizes), 0  # shingles of the unreached, and of some since reached
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            n = int(sizes[x])
            lo, hi = np.searchsorted(sizes, needed(n, similarity)), np.searchsorted(sizes, 100 * n // similarity, side="right")
            if not left[lo:hi].any():
                continue
            mine = tokens[bounds[x] : bounds[x + 1]]
            a, b = np.searchsorted(owners, lo), np.searchsorted(owners, hi)
            mark[mine] = True
            overlap = np.bincount(owners[a:b][mark[flat[a:b]]] - lo, minlength=hi - lo)
            mark[mine] = False
            found = lo + np.flatnonzero(left[lo:hi] & linked(overlap, n, sizes[lo:hi], similarity))
            left[found] = False
            reached += len(found)
            for y in found.tolist():
                yield names[x], names[y]
                queue.append(y)
            if 2 * reached > left.sum():
                keep = left[owners]
                flat, owners, reached = flat[keep], owners[keep], 0


def band(n: Column, similarity: int) -> Column:
    """Sets of Jaccard similarity ``similarity`` or more are in one band of size or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / similarity * (1 + 1e-9)) if similarity < 100 else 1.0)).cast("int")


def dealt_out(members: DataFrame, n_members: int, block_shingles: int) -> DataFrame:
    """c, cluster, of, h, n, copies, small (whether the cluster is verified in one task), for classes of clusters of several."""
    total = members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
    told = with_one_a_key(members, total, "cluster", "size", n_members)
    return told.select("c", "cluster", "of", "h", "n", "copies", (F.col("shingles") <= block_shingles).alias("small"))


def cut_sets(dealt: DataFrame, docs: DataFrame, k: int, most_broadcast: int) -> DataFrame:
    """c, cluster, n, copies, small, s (the set's bytes). A class's set is cut from one of its texts, found by the text's
    digest, so it doesn't matter how often an id, or none, or the text is repeated: copies are dropped where they are found.
    Beyond ``most_broadcast`` classes a map of their digests tells which texts are shuffled."""
    if dealt.count() <= most_broadcast:
        found = docs.join(F.broadcast(dealt), F.col("key") == F.col("of")).dropDuplicates(["c"])
    else:
        maybe = may_hold("key", key_map(dealt.select(F.col("of").alias("key"))))
        found = docs.where(maybe).dropDuplicates(["key"]).join(dealt, F.col("key") == F.col("of"))
    texts = found.select("c", "cluster", "n", "copies", "small", "h", "text")

    def cut(batches):
        for batch in batches:
            sets = [shingle_set(raw, k).tobytes() for raw in text_bytes(batch.column(6))]
            same = pa.array([digest(s) == h for s, h in zip(sets, batch.column(5).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(same) for i in range(5)), pa.array(sets, pa.binary()).filter(same)], names=["c", "cluster", "n", "copies", "small", "s"])

    return texts.mapInArrow(frugal(cut), "c long, cluster long, n long, copies long, small boolean, s binary")


def links_within(keyed: DataFrame, similarity: int) -> DataFrame:
    """Links a, b of all classes that share cluster, i and j. ``keyed``: cluster, i, j, c, s."""

    def verify(batches):
        key, names, sets = None, [], []

        def done():
            links = list(forest(names, sets, similarity)) if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for *now, c, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now != key:
                    if names:
                        yield done()
                    key, names, sets = now, [], []
                names.append(c)
                sets.append(np.frombuffer(s, dtype=np.uint64).reshape(-1, 2))
        if names:
            yield done()

    return keyed.select("cluster", "i", "j", "c", "s").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(verify, "a long, b long")


def links_to_pivots(sets: DataFrame, similarity: int, pivots: int, salts: int = 32) -> DataFrame:
    """Links a, b of classes with their cluster's pivots: those of most copies, as what others were copied from has many.

    A cluster's classes are spread over ``salts`` tasks; its pivots go to each of them.
    """
    order = Window.partitionBy("cluster").orderBy(F.col("copies").desc(), F.xxhash64("c"), "c")
    first = sets.select("cluster", "copies", "c").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= pivots).select("c")
    to = sets.join(first, "c", "left_semi").select("cluster", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("turn"), "c", "s")
    every = sets.select("cluster", F.pmod(F.xxhash64("c"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("turn"), "c", "s")

    def compare(batches):
        key, held = None, []
        for batch in batches:
            out = []
            for cluster, salt, turn, c, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (cluster, salt) != key:
                    key, held = (cluster, salt), []
                mine = np.frombuffer(s, dtype=np.uint64).reshape(-1, 2)
                if not turn:
                    held.append((c, mine))
                    continue
                for other, its in held:
                    n, m = len(mine), len(its)
                    if other != c and 100 * min(n, m) >= similarity * max(n, m) and linked(n + m - 1 - int(numbered(np.concatenate([mine, its])).max()), n, m, similarity):
                        out.append((other, c))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return to.unionByName(every).repartition("cluster", "salt").sortWithinPartitions("cluster", "salt", "turn").mapInArrow(compare, "a long, b long")


def block_pairs(sets: DataFrame, links: DataFrame, n_sets: int, similarity: int, block_shingles: int) -> DataFrame:
    """cluster, i, j, c, s: in which pairs of blocks each class of a big cluster is verified, given the ``links`` found so far.

    Classes that these links tie to the largest part of their cluster are known to belong together, so only pairs with a class
    of the rest are looked at. Blocks are of a band of size; a link joins classes of one band or of neighbouring ones.
    """
    parts = connected_components(links).withColumnRenamed("node", "c")
    told = sets.select("c", "cluster", "n").join(parts, "c", "left").select("c", "cluster", "n", F.coalesce("component", "c").alias("part"), band(F.col("n"), similarity).alias("band"))
    told = materialise(told, "told")
    largest = told.groupBy("cluster", "part").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.max_by("part", F.struct("m", "part")).alias("main"), F.sum("m").alias("size"))
    told = with_one_a_key(told, largest, "cluster", "size", n_sets).withColumn("rest", F.col("part") != F.col("main"))
    told = materialise(told.select("c", "cluster", "n", "band", "rest"), "rest")
    blocks = told.groupBy("cluster", "rest", "band").agg(F.count("*").alias("m"), F.ceil(F.sum("n") / F.lit(block_shingles)).cast("int").alias("blocks"))
    as_map = lambda rest: F.map_from_entries(F.collect_list(F.when(F.col("rest") == rest, F.struct("band", "blocks"))))  # noqa: E731  bands are as few as a logarithm of sizes
    maps = blocks.groupBy("cluster").agg(F.sum("m").alias("size"), as_map(True).alias("rest_blocks"), as_map(False).alias("main_blocks"))
    d = with_one_a_key(told, maps, "cluster", "size", n_sets)
    count = lambda of, x: F.coalesce(F.element_at(of, F.col("band") + x), F.lit(0))
    every = lambda of, mark, x: F.transform(F.when(count(of, x) > 0, F.sequence(F.lit(0), count(of, x) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat_ws(".", F.lit(mark), F.col("band") + x, i))
    own = F.when(F.col("rest"), count("rest_blocks", 0)).otherwise(count("main_blocks", 0))
    me = F.concat_ws(".", F.when(F.col("rest"), "r").otherwise("m"), "band", F.pmod(F.xxhash64("c"), own).cast("int"))
    with_rest = F.concat(*(every("rest_blocks", "r", x) for x in (-1, 0, 1)))
    with_main = F.concat(*(every("main_blocks", "m", x) for x in (-1, 0, 1)))
    others = F.when(F.col("rest"), F.concat(with_rest, with_main)).otherwise(with_rest)
    met = d.select("c", "cluster", me.alias("me"), F.explode(others).alias("other"))
    return met.select("c", "cluster", F.least("me", "other").alias("i"), F.greatest("me", "other").alias("j")).join(sets.select("c", "s"), "c")


def verified(members: DataFrame, n_members: int, docs: DataFrame, k: int, similarity: int, block_shingles: int, most_broadcast: int, pivots: int = 16) -> DataFrame:
    """Links a, b that tie the classes of each cluster as all of their links would. ``members``: cluster, c, of, h, n, copies.
    ``docs``: text, key."""
    dealt = materialise(dealt_out(members, n_members, block_shingles), "members")
    cuts = cut_sets(dealt, docs, k, most_broadcast)
    whole = [F.lit("").alias("i"), F.lit("").alias("j")]
    n_big = dealt.where("NOT small").count()
    if not n_big:
        return links_within(cuts.select("cluster", *whole, "c", "s"), similarity)
    cuts = materialise(cuts, "sets")
    big = cuts.where("NOT small")
    known = materialise(links_to_pivots(big, similarity, pivots), "known")
    rest = links_within(block_pairs(big, known, n_big, similarity, block_shingles), similarity)
    return links_within(cuts.where("small").select("cluster", *whole, "c", "s"), similarity).union(known).union(rest)


def grouped(docs: DataFrame, k: int, similarity: int, run: int, block_shingles: int, most_broadcast: int) -> DataFrame:
    """doc_id, key, n, component (a number for each group of linked rows), component_id (the smallest id of a group's
    rows), for the rows of ``docs`` (doc_id, text, key); both null for rows without shingles."""
    rows = materialise(described(docs, k, similarity, frequent_shingles(docs, k)), "described")
    classes = classes_of(rows)
    n_classes = classes.count()
    groups = groups_of(classes, n_classes)
    pairs = materialise(candidates(groups, similarity, run), "pairs")
    clusters = connected_components(passing(pairs, groups, similarity)).withColumnRenamed("node", "g")
    placed = groups.select("p", "members", "g").join(clusters, "g", "left").select("p", "members", F.coalesce("component", "g").alias("cluster"))
    members = with_one_a_key(classes.select("c", "of", "h", "n", "p", "copies"), placed, "p", "members", n_classes)
    links = verified(members, n_classes, docs.select("text", "key"), k, similarity, block_shingles, most_broadcast)
    parts = connected_components(links).withColumnRenamed("node", "c")
    of = materialise(classes.select("c", "h", "copies", "least").join(parts, "c", "left").withColumn("component", F.coalesce("component", "c")), "parts")
    named = of.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    final = materialise(with_one_a_key(of, named, "component", "classes", n_classes).select("h", "copies", "component", "component_id"), "final")
    told = with_one_a_key(rows.where("n > 0").select("h", "doc_id", "key", "n"), final, "h", "copies", rows.count())
    return told.select("doc_id", "key", "n", "component", "component_id").unionByName(rows.where("n = 0").select("doc_id", "key", "n"), allowMissingColumns=True)


def near_duplicates(docs: DataFrame, k: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text", run: int = 64, block_shingles: int = 1_000_000, most_broadcast: int = 50_000) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``docs``; ``similarity`` is in hundredths, 1 to 100.

    A text without words, or null, has no shingles and is linked with nothing: its component is its own id. Repeated
    rows and ids are rows of their own. A component's id is the smallest id in it that isn't null. Other columns are
    ignored; an empty table gives no rows. Ids are whole numbers, or strings of such. A long text is one row of a task.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.md5(F.col(text_col).cast("binary")).alias("key"))
    found = grouped(plain, k, similarity, run, block_shingles, most_broadcast)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


_ID, _KEY, _NAMED_ID, _NAMED_KEY = "__id", "__key", "__named_id", "__named_key"


def keep_one(docs: DataFrame, k: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 50_000) -> DataFrame:
    """The rows of ``docs`` but for those near to a row of smaller id; of rows of equal id the text of least digest stays,
    of equal rows one.

    Rows are told apart by id and text, so texts that share an id and nothing else all stay. Rows of null id can't be
    named and stay, as do rows without words. All columns are kept; an empty table stays empty. Rows to drop are
    broadcast up to ``most_broadcast``; beyond it a map of them tells which rows of ``docs`` are shuffled to be joined.
    """
    key = F.md5(F.col(text_col).cast("binary"))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), key.alias("key"))
    found = materialise(grouped(plain, k, similarity, 64, 1_000_000, most_broadcast).where("doc_id IS NOT NULL AND n > 0"), "found")
    heads = found.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("head"), F.count("*").alias("size"))
    told = with_one_a_key(found.select("component", F.struct("doc_id", "key").alias("me")), heads, "component", "size", found.count())
    counted = materialise(told.groupBy("me", "head").agg(F.count("*").alias("c")), "told")
    drop = materialise(counted.where("me <> head").select("me.*").distinct(), "drop")
    again = materialise(counted.where("me = head AND c > 1").select("me.*"), "again")
    left = docs.withColumns({_ID: F.col(id_col).cast("long"), _KEY: key})
    on = (F.col(_ID) == F.col(_NAMED_ID)) & (F.col(_KEY) == F.col(_NAMED_KEY))
    named = lambda x: x.select(F.col("doc_id").alias(_NAMED_ID), F.col("key").alias(_NAMED_KEY))
    n_drop, n_again = drop.count(), again.count()
    small = n_drop + n_again <= most_broadcast
    side = lambda x: F.broadcast(named(x)) if small else named(x)
    rest = None
    if not small:
        maybe = may_hold(_KEY, key_map(drop.unionByName(again).select("key")))
        left, rest = left.where(maybe), left.where(~maybe)
    left = left.join(side(drop), on, "left_anti")
    if n_again:
        twice = side(again)
        left = left.join(twice, on, "left_anti").unionByName(left.join(twice, on, "left_semi").dropDuplicates([_ID, _KEY]))
    left = left if rest is None else left.unionByName(rest)
    return left.drop(_ID, _KEY)
