"""Near-duplicate classes by b-bit MinHash signatures and a multi-index Hamming join.

A document is the set of its distinct word shingles. Equal sets become one node. A
node's signature holds ``SYMBOLS`` min-hashes cut to 8 bits. Two sets whose Jaccard
similarity is s differ in about ``(1 - s) * SYMBOLS`` symbols; ``RADIUS`` allows that
of the threshold and 3.5 standard deviations more. The signature is cut into
``CHUNKS`` chunks. By the pigeonhole principle, two signatures at most
``RADIUS = 2 * CHUNKS - 1`` symbols apart differ in at most one symbol of some chunk,
so every chunk is indexed once for each place where that one error may stand: no pair
within the radius is missed.

Nodes that share an index key form a bucket. A bucket is compared with its leader
alone, and links confirmed on the full sets join nodes to components. Nodes far from it are
compared with a second leader. Nodes that hang together by a leader are a group; where
its nodes hang in different components they are compared in blocks of bounded size,
where every pair within the radius is looked at on the full sets unless links already
join it. A pair within the radius that meets in a bucket from two groups is looked at alone, at
the first of the keys it shares. So a group of n
copies costs n comparisons per key, and no pair within the radius is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded
from .common import heavy_lookup, stored

CHUNKS, WIDTH = 21, 6
SYMBOLS = CHUNKS * WIDTH
RADIUS = 2 * CHUNKS - 1
#: Bits of an index key that hold its place among the keys of a signature.
PLACES = 127
#: Shingles hashed at once, which bounds the memory of a very long text.
STEP = 1024
#: Bits of each symbol by which pairs are ruled out where they meet.
BITS = 4
#: Far nodes of a bucket, at most, with which its near nodes are compared by their lowest bits before they are dealt out.
FEW = 128
#: Rows of one block of a large bucket.
BLOCK = 256
#: Shingles of one block, for very long texts.
BLOCK_SHINGLES = 2_000_000

_SEED = np.random.default_rng(20240501)
_MULTIPLY = _SEED.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RANK = _SEED.integers(0, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _SEED.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
_KEY = _SEED.integers(1, 2**63, (CHUNKS, WIDTH, WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX2
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; ``known`` caches hashes of words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(known) > 500_000:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    take = min(size, len(h))
    out = np.zeros(len(h) - take + 1, np.uint64)
    for i in range(take):
        out = _mixed(out * _MULTIPLY[i] + h[i : len(h) - take + 1 + i])
    return np.unique(out + np.uint64(take))


def signature(hashes: np.ndarray) -> np.ndarray:
    """8 bits of each of the ``SYMBOLS`` min-hashes of a set."""
    least = np.full(SYMBOLS, np.iinfo(np.uint32).max, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), STEP):
        ranks = short[None, at : at + STEP] * _RANK[:, None]
        ranks += _SHIFT[:, None]
        np.minimum(least, ranks.min(1), out=least)
    return (_mixed(least.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """Per signature, one key for every chunk and every place of the one error in it; the lowest bits hold that place."""
    chunks = signatures.reshape(len(signatures), CHUNKS, WIDTH).astype(np.uint64) + np.uint64(1)
    keys = []
    for c in range(CHUNKS):
        terms = chunks[:, c, :, None] * _KEY[c].T[None, :, :]  # signature, symbol, place of the error
        for place in range(WIDTH):
            keep = [j for j in range(WIDTH) if j != place]
            x = np.full(len(signatures), c * WIDTH + place + 1, np.uint64)
            for j in keep:
                x = _mixed(x + terms[:, j, place])
            keys.append(x & ~np.uint64(PLACES) | np.uint64(c * WIDTH + place))
    return np.stack(keys, 1).view(np.int64) if len(signatures) else np.empty((0, SYMBOLS), np.int64)


def _sets(size: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for part in parts:
            counts, digests, signs = [], [], []
            for text in part["text"]:
                h = shingle_hashes(text, size, known)
                counts.append(len(h))
                digests.append(xxhash.xxh3_128_hexdigest(h.tobytes()) if len(h) else None)
                signs.append(signature(h).tobytes() if len(h) else None)
            yield pd.DataFrame({"doc_id": part["doc_id"], "x": part["x"], "y": part["y"], "n_shingles": np.array(counts, np.int64),
                                "digest": digests, "signature": signs})

    return run


def _keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        signs = _rows(part["signature"])
        yield pd.DataFrame({"node": part["node"], "keys": list(index_keys(signs))})


def _rows(signatures: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, SYMBOLS)


def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series((_rows(a) != _rows(b)).sum(1).astype(np.int32))


def _compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Distance, and the lowest ``BITS`` bits of every symbol of ``a`` as two longs a bit."""
    x = _rows(a)
    out = {"d": (x != _rows(b)).sum(1).astype(np.int32)}
    for k in range(BITS):
        longs = np.ascontiguousarray(np.packbits((x >> k) & 1, axis=1)).view(">i8").astype(np.int64)
        out |= {f"p{2 * k}": longs[:, 0], f"p{2 * k + 1}": longs[:, 1]}
    return pd.DataFrame(out)


def _linked(size: int, percent: int):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, left = [], None, set()
        for x, y in zip(a, b):
            if x is not last:
                last, left = x, word_shingles(x, size)
            right = word_shingles(y, size)
            both = len(left & right)
            out.append(100 * both >= percent * (len(left) + len(right) - both) > 0)
        return pd.Series(out, dtype=bool)

    return run


def word_shingles(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return set()
    take = min(size, len(words))
    return set(zip(*(words[i:] for i in range(take)))) if take > 1 else {(w,) for w in words}


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, root) of every node but the roots: the smallest node reachable over ``edges`` (a, b).

    Alternating large and small stars. Trees lose about half their depth in a round. A round is written to the shared
    folder; the rounds end when the edges stay as they are.
    """
    def stamp(e: DataFrame) -> object:
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), purpose)
    before = stamp(now)
    while True:
        around = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), purpose)
        after = stamp(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


PLANES = [f"p{k}" for k in range(2 * BITS)]


def _differ(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """Symbols whose lowest bits differ: at most the distance, which rules out most pairs where they meet."""
    halves = []
    for half in (0, 1):
        some = [x(p).bitwiseXOR(y(p)) for p in PLANES[half::2]]
        halves.append(reduce(Column.bitwiseOR, some))
    return F.bit_count(halves[0]) + F.bit_count(halves[1])


def _second(bucket: DataFrame, stars: DataFrame, sign) -> DataFrame:
    """(a, b) within the radius of a second leader, drawn anew for each key among the nodes far from the first."""
    far = bucket.where("rows > 2").join(stars.where(f"d > {RADIUS}"), ["node", "leader"])
    drawn = far.groupBy("key").agg(F.min_by(F.struct("node", *PLANES), F.xxhash64("key", "node")).alias("s"))
    met = far.join(drawn.select("key", F.col("s.node").alias("second"), "s"), "key")
    met = met.where((F.col("node") != F.col("second")) & (_differ(F.col, lambda p: F.col("s")[p]) <= RADIUS))
    return _close(met.select(F.least("node", "second").alias("a"), F.greatest("node", "second").alias("b")).distinct(), sign)


def _close(pairs: DataFrame, sign) -> DataFrame:
    """The pairs (a, b) within the radius."""
    both = pairs.join(sign("a", "s"), "a").join(sign("b", "t"), "b")
    return both.where(F.pandas_udf(_distance, "int")("s", "t") <= RADIUS).select("a", "b")


def _planes(a: pd.Series) -> pd.Series:
    """The bits of the symbols, one plane for each of the 8 bits: two longs a plane."""
    x = _rows(a)
    bits = [np.packbits((x >> k) & 1, axis=1) for k in range(8)]
    return pd.Series(list(np.ascontiguousarray(np.concatenate(bits, 1)).view(">i8").astype(np.int64)))


def _unlike() -> list[Column]:
    """Two longs of 64 and 62 bits, one for each symbol, set where x.planes and y.planes differ."""
    xor = lambda k: F.col("x.planes")[k].bitwiseXOR(F.col("y.planes")[k])
    out = [xor(0), xor(1)]
    for k in range(2, 16):
        out[k % 2] = out[k % 2].bitwiseOR(xor(k))
    return out


def _first_meeting(unlike: Column) -> Column:
    """The first index place of a pair: of the first chunk with one error at most, the place of that error or 0."""
    low, high = unlike["low"], unlike["high"]
    places = []
    for c in range(CHUNKS):
        end = (c + 1) * WIDTH
        if end <= 64:
            chunk = F.shiftrightunsigned(low, 64 - end)
        elif end - WIDTH >= 64:
            chunk = F.shiftrightunsigned(high, 128 - end)
        else:
            chunk = F.shiftleft(low, end - 64).bitwiseOR(F.shiftrightunsigned(high, 128 - end))
        chunk = chunk.bitwiseAND(F.lit(2**WIDTH - 1).cast("long"))
        places.append(F.when(chunk == 0, c * WIDTH).when(F.bit_count(chunk) == 1, end - 1 - F.bit_count(chunk - 1)))
    return F.coalesce(*places)


def _far(bucket: DataFrame, stars: DataFrame, group: DataFrame, roots: DataFrame, one: DataFrame) -> DataFrame:
    """Pairs (a, b) within the radius that share a bucket and are of different groups and components, each once.

    Buckets without a far node, of one group or of one component are left out. Of the others a node near the leader stays
    only where the triangle inequality allows a far node within the radius, and, in a bucket of at most
    ``FEW`` far nodes, where the lowest bits of each symbol allow one of them. A pair shares up to ``SYMBOLS`` keys; it is
    taken at its first, and the distance is counted on the bit planes where a pair meets.
    """
    # what is known of a node and a leader is put together before it meets the many keys they share
    known = stars.join(group, "node", "left").join(roots, "node", "left")
    known = stored(known.select("node", "leader", "d", *PLANES, F.coalesce("group_id", "node").alias("group_id"), F.coalesce("root", "node").alias("root")), "known")
    others = bucket.where("rows > 2").select("key", "node", "leader").join(known, ["node", "leader"]).drop("leader")
    far = F.col("d") > RADIUS
    live = others.groupBy("key").agg(
        F.min(F.when(far, F.col("d"))).alias("least"), F.count_if(far).alias("n_far"), F.min("group_id").alias("g"), F.max("group_id").alias("h"),
        F.min("root").alias("r"), F.max("root").alias("s")).where("least is not null and g <> h and r <> s").select("key", "least", "n_far")
    live = stored(live, "live")
    few = others.where(far).join(live.where(F.col("n_far") <= FEW).select("key"), "key")
    few = few.groupBy("key").agg(F.collect_list(F.struct(*PLANES, "group_id", "root")).alias("few"))
    close = lambda z: _differ(F.col, lambda p: z[p]) <= RADIUS
    other = lambda z: (z["group_id"] != F.col("group_id")) & (z["root"] != F.col("root"))
    wanted = F.when(F.col("few").isNotNull(), F.exists("few", lambda z: close(z) & other(z))).otherwise(F.col("d") >= F.col("least") - RADIUS)
    # a far node's own entry is of its own group, so it stays for other far nodes and for the near ones that do
    others = others.join(live.join(few, "key", "left"), "key").where(far | wanted)
    others = others.select("key", "node", "d", "group_id", "root")
    signs = one.select("node", F.pandas_udf(_planes, "array<long>")("signature").alias("planes"))
    # a node has at most SYMBOLS keys; its planes are looked up once for all of them
    others = others.groupBy("node").agg(F.collect_list(F.struct("key", "d", "group_id", "root")).alias("met")).join(signs, "node")
    others = stored(others.select("node", "planes", F.inline("met")), "far")
    low, high = _unlike()
    first = F.transform(F.array(F.struct(low.alias("low"), high.alias("high"))), _first_meeting)[0]
    met = others.where(f"d > {RADIUS}").alias("x").join(
        others.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.group_id") != F.col("y.group_id")) & (F.col("x.root") != F.col("y.root"))
        & (F.abs(F.col("x.d") - F.col("y.d")) <= RADIUS)
        & ((F.col("y.d") <= RADIUS) | (F.col("x.node") < F.col("y.node"))) & (F.bit_count(low) + F.bit_count(high) <= RADIUS)
        & (first == F.col("x.key").bitwiseAND(F.lit(PLACES).cast("long"))))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _blocks(group: DataFrame, roots: DataFrame, one: DataFrame) -> DataFrame:
    """Rows (group_id, i, j, node, root, main) of groups whose nodes hang together by signature but not by links.

    ``group`` holds the (node, group_id) of nodes near a leader. A group's largest component and its other
    nodes are cut into blocks apart; each pair of blocks, but for two of the largest
    component, is one task's work. A block holds about ``BLOCK`` nodes or ``BLOCK_SHINGLES``
    shingles, whichever are fewer.
    """
    nodes = group.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(one.select("node", "n"), "node")
    parts = nodes.groupBy("group_id", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    whole = parts.groupBy("group_id").agg(F.max(F.struct("rows", "root", "n")).alias("top"), F.sum("rows").alias("rows"), F.sum("n").alias("n"))
    cut = lambda rows, n: F.ceil(F.greatest(rows / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    whole = whole.where("rows > top.rows").select(
        "group_id", F.col("top.root").alias("main_root"), cut(F.col("top.rows"), F.col("top.n")).alias("mains"),
        cut(F.col("rows") - F.col("top.rows"), F.col("n") - F.col("top.n")).alias("rests"))
    rows = nodes.join(whole, "group_id").withColumn("main", F.col("root") == F.col("main_root"))
    # blocks 0 .. rests-1 hold the other nodes, rests .. rests+mains-1 the largest component
    block = F.when(F.col("main"), F.col("rests") + F.pmod(F.xxhash64("node"), "mains")).otherwise(F.pmod(F.xxhash64("node"), "rests"))
    rows = rows.withColumn("block", block.cast("int"))
    last = F.when(F.col("main"), F.col("rests") - 1).otherwise(F.col("rests") + F.col("mains") - 1)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("group_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root")


def _within(size: int, percent: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", ignore_index=True)
        signs = _rows(part["signature"])
        node, block = part["node"].to_numpy(), part["block"].to_numpy()
        two = part["i"].iat[0] != part["j"].iat[0]
        above: dict[int, int] = {}
        sets: dict[int, set] = {}

        def top(x: int) -> int:
            while (y := above.get(x, x)) != x:
                x = y
            return x

        def of(k: int) -> set:
            if k not in sets:
                sets[k] = word_shingles(part["text"].iat[k], size)
            return sets[k]

        links = []
        for x in range(len(node) - 1):
            near = np.flatnonzero((signs[x + 1 :] != signs[x]).sum(1) <= RADIUS) + x + 1
            for y in near[block[near] != block[x]] if two else near:
                r, s = top(part["root"].iat[x]), top(part["root"].iat[y])
                if r == s:
                    continue
                both = len(of(x) & of(y))
                if 100 * both >= percent * (len(of(x)) + len(of(y)) - both):
                    above[max(r, s)] = min(r, s)
                    links.append((node[x], node[y]))
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def _texts(base: DataFrame, nodes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A lookup of (node, text) for the nodes wanted: a text of each node's smallest doc_id. Other texts are not moved."""

    def of(wanted: DataFrame) -> DataFrame:
        keys = stored(nodes.join(wanted.select("node").distinct(), "node").select("node", "first.*"), "wanted")
        return base.join(bounded(keys, keys.count()), ["doc_id", "x", "y"]).select("node", "text").dropDuplicates(["node"])

    return of


def _confirmed(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], linked: Column) -> DataFrame:
    """The pairs of (a, b) whose full sets confirm the link."""
    few = stored(texts(pairs.select(F.explode(F.array("a", "b")).alias("node"))), "candidate-texts")
    full = pairs.join(few.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        few.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return full.where(linked).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of anything but white space after lower-casing A-Z. Sets of ``size``
    consecutive words link where 100 * intersection >= ``percent`` * union; a text of
    fewer words is one shingle. Null and empty texts have no set: they are their own
    class and stay. component_id is the smallest doc_id reachable, and ``kept`` marks the
    rows that carry it. Texts of one doc_id are each compared and then fall into one class; a null doc_id is
    always kept and stands for no class but its own (component_id null); so is a text without words. Ties cannot
    arise, an empty table gives an empty one, and other columns are not looked at. Very long texts are hashed in
    steps and compared whole.
    """
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))
    sets = stored(base.mapInPandas(_sets(size), "doc_id long, x long, y long, n_shingles long, digest string, signature binary"), "shingle-sets")
    # a node is a distinct set, numbered once and for all as it is written
    named = sets.where("doc_id is not null and digest is not null")
    nodes = named.groupBy("digest").agg(F.min(F.struct("doc_id", "x", "y")).alias("first"), F.first("signature").alias("signature"), F.max("n_shingles").alias("n"), F.count("*").alias("rows"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    one = nodes.select("node", "signature", "n")
    keys = one.mapInPandas(_keys, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count("*").alias("rows"))
    bucket = stored(keys.join(shared.where("leader <> last").drop("last"), "key"), "buckets")

    distance = F.pandas_udf(_distance, "int")
    sign = lambda name, out: one.select(F.col("node").alias(name), F.col("signature").alias(out))
    stars = bucket.where("node <> leader").select("node", "leader").distinct()
    stars = stars.join(sign("node", "s"), "node").join(sign("leader", "t"), "leader")
    compared = F.pandas_udf(_compared, "d int, " + ", ".join(f"{p} long" for p in PLANES))
    stars = stored(stars.select("node", "leader", compared("s", "t").alias("c")).select("node", "leader", "c.*"), "stars")

    texts = _texts(base, nodes)
    linked = F.pandas_udf(_linked(size, percent), "boolean")("text_a", "text_b")
    near = stars.where(f"d <= {RADIUS}").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    links = stored(_confirmed(near, texts, linked), "links")
    roots = stored(components(links), "roots")
    group = components(near.union(stored(_second(bucket, stars, sign), "near")), "groups").select("node", F.col("root").alias("group_id"))
    group = stored(group.union(group.select("group_id", "group_id").distinct()), "groups")
    apart = stored(_blocks(group, roots, one), "apart")
    apart = stored(apart.join(one.select("node", "signature"), "node").join(texts(apart), "node"), "blocks")
    inside = apart.groupBy("group_id", "i", "j").applyInPandas(_within(size, percent), "a long, b long")
    links = links.union(stored(inside, "links"))
    roots = stored(components(links, "roots"), "roots")
    links = links.union(stored(_confirmed(stored(_far(bucket, stars, group, roots, one), "met"), texts, linked), "links"))
    # the sets of one doc_id hang together; few ids have more than one
    member = heavy_lookup(named.select("doc_id", "digest"), nodes.select("digest", "node", "rows"), ["digest"], "rows")
    member = stored(member.groupBy("doc_id", "node").agg(F.count("*").alias("rows")), "members")
    several = member.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b <> last")
    same = member.join(several, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")
    final = components(links.select("a", "b").union(same), "classes")
    root = nodes.select("node", F.col("first.doc_id").alias("first_id")).join(final, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first_id")
    least = root.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = stored(nodes.select("digest", "node", "rows").join(root.select("node", "root").join(least, "root"), "node").select("digest", "component_id", "rows"), "found")

    alone = sets.where("doc_id is null or digest is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    out = heavy_lookup(named.select("doc_id", "n_shingles", "digest"), found, ["digest"], "rows").select("doc_id", "n_shingles", "component_id").union(alone)
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
