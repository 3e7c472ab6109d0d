"""SimHash near-duplicates: fingerprints, links at few differing bits, components.

Fingerprint. A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words (fewer words: the whole sequence; none: zero), XXH64 with
seed 42 of each; a bit is 1 if it is set in over half of the hashes, repeats included.

Links. Equal fingerprints are one node, so groups of exact copies never meet in a join. A node is embedded as the bit counts of its 32 segments of
two bits. The Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints. Within three bits, one half of the embedding
(16 segments) is therefore within distance one: each node is put into the grid cell of either half, and looks for partners in its own cell and in
the cells one step up (the partner one step down looks up itself). Candidates pass the distance of the whole embedding, then the
exact test. Counts are stored as unary codes (0: 00, 1: 01, 2: 11), in which the Manhattan distance is a bit count of an xor.

Components by alternating stars over the links; their id is the smallest doc_id of all documents in them.

Defined results: a null or empty text has fingerprint zero, linked like any other. Every row has its own result; rows that repeat are copies. A null
doc_id never becomes the id of a component unless it has no other. An empty table gives an empty result. Texts of any length are
hashed whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, pick, utf8, written
from quillspark.llm.components import connected

SHINGLE, BITS, SEED = 3, 3, 42
_LOW = 0x5555555555555555  # the lower bit of each segment
_BLOCK = 1 << 16


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Of one UTF-8 text, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z alone, and the six characters alone
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    counts = np.zeros(64, np.int64)
    for start in range(0, n, _BLOCK):
        part = words[start : start + _BLOCK + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` (a signed long with the 64 bits) per row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(map(fingerprint, utf8(batch["text"])), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return pick(docs, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of the segments of two bits, each in unary."""
    shifted = F.shiftrightunsigned(fp, 1)
    low = fp.bitwiseOR(shifted).bitwiseAND(F.lit(_LOW))
    high = fp.bitwiseAND(shifted).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(F.shiftleft(high, 1))


def _cells_up(cell: str) -> Column:
    """A half's own cell, and the cells with one more in one segment."""
    return F.expr(
        f"filter(concat(array({cell}), transform(sequence(0, 15), i -> CASE shiftright({cell}, 2 * i) & 3 "
        f"WHEN 0 THEN {cell} | shiftleft(1L, 2 * i) WHEN 1 THEN {cell} | shiftleft(2L, 2 * i) END)), c -> c IS NOT NULL)"
    )


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """``a, b``: all pairs of distinct fingerprints ``fp`` of ``nodes`` within three bits or fewer, once each."""
    if bits > 3:
        raise ValueError("two halves and steps of one hold all links up to three bits only")
    placed = nodes.select("fp", embedding(F.col("fp")).alias("v")).select(
        "fp",
        "v",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("half"), F.col("v").bitwiseAND(F.lit(0xFFFFFFFF)).alias("cell")),
                F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("v", 32).alias("cell")),
            )
        ).alias("at"),
    ).select("fp", "v", "at.half", "at.cell")
    looking = placed.select(
        F.col("fp").alias("a"), F.col("v").alias("va"), "half", F.col("cell").alias("own"), F.explode(_cells_up("cell")).alias("cell")
    )
    held = placed.select(F.col("fp").alias("b"), F.col("v").alias("vb"), F.col("half").alias("b_half"), F.col("cell").alias("b_cell"))
    apart = F.col("va").bitwiseXOR(F.col("vb"))
    near = F.bit_count(apart) <= bits
    # In the own cell both look for each other. What the first half finds is not found again by the second.
    once = (F.col("own") != F.col("cell")) | (F.col("a") < F.col("b"))
    first = (F.col("half") == 0) | (F.bit_count(apart.bitwiseAND(F.lit(0xFFFFFFFF))) > 1)
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    same = (F.col("half") == F.col("b_half")) & (F.col("cell") == F.col("b_cell"))
    return looking.join(held, same & once & first & near & exact).select("a", "b")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``."""
    # Hashes alone are kept; the texts are read once.
    rows = written(fingerprints(docs, doc_id, text), "simhash-rows")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = connected(links(nodes, bits)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written, so that the last join has an exchange of its own on each side and Spark can split a fingerprint with very many copies.
    named = written(rooted.join(least, "root").select("fp", "component_id"), "simhash-names")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component: one document of each group. Rows that repeat under this doc_id stay together."""
    names = docs.columns
    kept = groups(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("of_doc")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("of_doc")), "left_semi").select(*names)


def query(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by similarity ------------------------------------------------------------------------------

NEAR_SHINGLE, SIMILARITY, SAMPLES, SAMPLE = 5, 0.8, 10, 4
#: Hashes of so many texts of one batch are taken for frequent; so many of these at most come last in the order of the prefixes, which changes its speed alone.
FREQUENT, FREQUENT_KEPT = 3, 1 << 17
#: Longs of a set's parities: enough to tell sets of some 4000 hashes apart.
PARITIES = 32
#: Odd multipliers of the sample orders, from a fixed seed.
_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, size: int = NEAR_SHINGLE) -> np.ndarray:
    """Distinct XXH64 of a text's shingles, sorted; words as in ``fingerprint``. None for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if len(words) < size:
        return np.fromiter((xxh64_intdigest(b" ".join(words), SEED) for _ in words[:1]), np.uint64)
    found = []
    for start in range(0, len(words) - size + 1, _BLOCK):
        part = words[start : start + _BLOCK + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False))
        found.append(np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of a set of hashes, as an unsigned number."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _BLOCK):
        part = np.ascontiguousarray(hashes[start : start + _BLOCK])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def sampled(hashes: np.ndarray, size: int = SAMPLE) -> list[int]:
    """SimHashes of the ``size`` least hashes in each of several orders: equal for near copies about as often as similarity ** size."""
    out = []
    for order in _ORDERS:
        mixed = hashes * order  # modulo 2 ** 64
        least = mixed if len(mixed) <= size else np.partition(mixed, size - 1)[:size]
        out.append(majority(least ^ (least >> np.uint64(32))))
    return out


def _sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, set, fp, samples, often``: a digest of each row's set of shingles, its SimHash and those of the samples; the first row of a batch has
    the hashes that are frequent in it."""
    from hashlib import md5

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, fps, samples, some = [], [], [], [np.zeros(0, np.uint64)]
            for value in utf8(batch["text"]):
                hashes = shingle_hashes(value)
                some.append(hashes)
                sets.append(md5(hashes.tobytes()).digest())
                fps.append(majority(hashes))
                samples.append(np.array(sampled(hashes), np.uint64).view(np.int64))
            met, times = np.unique(np.concatenate(some), return_counts=True)
            often = [met[times >= FREQUENT].view(np.int64), *[None] * batch.num_rows][: batch.num_rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(sets, pa.binary()),
                    pa.array(np.array(fps, np.uint64).view(np.int64)),
                    pa.array(samples, pa.list_(pa.int64())),
                    pa.array(often, pa.list_(pa.int64())),
                ],
                names=["doc_id", "set", "fp", "samples", "often"],
            )

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, set binary, fp long, samples array<long>, often array<long>")


def _alike(docs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b: sets, with the document a_doc or b_doc of each) whose sets are that similar, counted exactly."""
    wanted = pairs.select(F.col("a_doc").alias("w_doc")).unionByName(pairs.select(F.col("b_doc").alias("w_doc"))).distinct()
    given = pick(docs, doc_id="doc_id", text="text")
    asked = given.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_doc")), "left_semi")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        for batch in batches:
            for value in utf8(batch["text"]):
                data = shingle_hashes(value).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([md5(data).digest()], pa.binary()), pa.array([data], pa.binary())], names=["set", "hashes"])

    # One row per set, written: texts are split once, and a set that thousands of pairs ask for can be met in parts.
    sets = written(asked.mapInArrow(opened, "set binary, hashes binary").dropDuplicates(["set"]), "near-sets")
    both = (
        pairs.select("a", "b")
        .join(sets.select(F.col("set").alias("a"), F.col("hashes").alias("a_hashes")), "a")
        .join(sets.select(F.col("set").alias("b"), F.col("hashes").alias("b_hashes")), "b")
    )

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["a_hashes"], batch["b_hashes"], strict=True):
                one, other = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(common >= similarity * (len(one) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(judged, "a binary, b binary")


def prefix_sizes(n: Column, similarity: float) -> tuple[Column, Column]:
    """Of a set of ``n`` hashes in one order for all sets: how many of the first ones meet one of each set that is as similar; and each larger set."""
    least = lambda share: F.ceil(n * F.lit(share - 1e-9)).cast("int")
    return n - least(similarity) + 1, n - least(2 * similarity / (1 + similarity)) + 1


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether the number of hashes in each of 2048 places is odd: two sets differ in as many hashes at least as in places."""
    odd = np.bincount((hashes >> np.uint64(8)) % np.uint64(64 * PARITIES), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def in_order(hashes: np.ndarray, frequent: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Sorted hashes with the frequent ones last, the most frequent at the end. ``frequent``: sorted, ``nth``: their places from 1."""
    if not len(frequent) or not len(hashes):
        return hashes
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return hashes[np.argsort(np.where(frequent[at] == hashes, nth[at], 0), kind="stable")]


def _prefixes(docs: DataFrame, similarity: float, often: DataFrame) -> DataFrame:
    """``set, size, prefix, odd`` per set. ``often``: hashes (h), once for each batch in which they are frequent; any choice gives the same links."""
    bounded_batches(docs.sparkSession)
    kept = often.groupBy("h").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT_KEPT).select("h").toArrow()
    most = np.array(kept["h"].to_numpy(), np.int64).view(np.uint64)  # the most frequent first
    by = np.argsort(most)
    shared = docs.sparkSession.sparkContext.broadcast((most[by], len(most) - by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        for batch in batches:
            sets, sizes, firsts, odd = [], [], [], []
            for value in utf8(batch["text"]):
                hashes = shingle_hashes(value)
                sets.append(md5(hashes.tobytes()).digest())
                sizes.append(len(hashes))
                most = len(hashes) - int(np.ceil(len(hashes) * (similarity - 1e-9))) + 1
                firsts.append(in_order(hashes, *shared.value)[:most].view(np.int64))
                odd.append(parities(hashes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                names=["set", "size", "prefix", "odd"],
            )

    return pick(docs, text="text").mapInArrow(run, "set binary, size int, prefix array<long>, odd array<long>").dropDuplicates(["set"])


def _between(docs: DataFrame, rooted: DataFrame, often: DataFrame, similarity: float) -> DataFrame:
    """``a, a_doc, b, b_doc``: all pairs of sets in different groups of ``rooted`` (set, least, root) that may be that similar.

    Prefix filter: with the hashes of all sets in one order, two sets that are that similar share a hash among the first ones of each. Only hashes of two groups
    or more are joined. Sizes, places and parities, which bound what two sets have in common, leave out pairs that can't be as similar, and no other.
    """
    sets = _prefixes(docs, similarity, often).join(rooted, "set").withColumns({"id": F.monotonically_increasing_id(), "root": F.xxhash64("root")})
    sets = written(sets.select("id", "set", "least", "root", "size", "prefix", "odd"), "near-prefixes")
    met = sets.select("id", "root", "size", F.posexplode("prefix").alias("at", "h")).withColumn("early", F.col("at") < prefix_sizes(F.col("size"), similarity)[1])
    of_hash = Window.partitionBy("h")
    over = {"least_root": F.min("root").over(of_hash), "last_root": F.max("root").over(of_hash), "any_early": F.max("early").over(of_hash)}
    met = written(met.withColumns(over).where("any_early AND least_root <> last_root").drop(*over), "near-met")
    one, other = (met.select("h", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "root", "size", "at", "early")]) for x in "ab")
    a, b = F.col("a_size"), F.col("b_size")
    common = F.least("a_at", "b_at") + F.least(a - F.col("a_at"), b - F.col("b_at"))
    # The smaller set is a; of two of one size, that with the smaller id.
    smaller = F.col("a_early") & (F.col("a_root") != F.col("b_root")) & ((a < b) | ((a == b) & (F.col("a_id") < F.col("b_id")))) & (a >= b * F.lit(similarity - 1e-9))
    enough = common >= (a + b) * F.lit(similarity / (1 + similarity) - 1e-9)
    met_once = one.join(other, "h").where(smaller & enough).select("a_id", "b_id").distinct()
    facts = [sets.select(*[F.col(c).alias(f"{x}_{c}") for c in ("id", "set", "least", "size", "odd")]) for x in "ab"]
    apart = sum((F.bit_count(F.col("a_odd")[i].bitwiseXOR(F.col("b_odd")[i])) for i in range(PARITIES)), F.lit(0))
    near = apart <= (a + b) * F.lit((1 - similarity) / (1 + similarity) + 1e-9)
    return met_once.join(facts[0], "a_id").join(facts[1], "b_id").where(near).select(
        F.col("a_set").alias("a"), F.col("a_least").alias("a_doc"), F.col("b_set").alias("b"), F.col("b_least").alias("b_doc")
    )


def near_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, component_id`` per row: groups linked by a Jaccard similarity of five-word shingles of at least ``similarity``, all of them.

    Rows with one set of shingles are one node, so copies never meet in a join. The first candidates are nodes whose SimHashes are within three bits, by the
    grid join above, and nodes that share the SimHash of a sample: those of one sample are held against one of them, another one for each sample, so the work grows
    with the nodes however many share it. Their links make groups; then all pairs between groups that a prefix filter leaves are candidates, so no link that
    would join two groups is lost. Each candidate is judged by the exact sets. Texts without words are one group.
    """
    rows = written(_sketches(docs), "near-rows")
    nodes = written(rows.groupBy("set").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("samples").alias("samples")), "near-nodes")
    keys = nodes.select("set", "least", F.posexplode("samples").alias("nth", "sample"))
    # The one to hold against: least by a hash of its own in each sample.
    first = F.min(F.struct(F.xxhash64("set", "nth").alias("h"), "set", "least")).alias("first")
    shared = written(keys.groupBy("nth", "sample").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1").select("nth", "sample", "first"), "near-samples")
    by_sample = keys.join(shared, ["nth", "sample"]).select(
        F.col("set").alias("a"), F.col("least").alias("a_doc"), F.col("first.set").alias("b"), F.col("first.least").alias("b_doc")
    )
    prints = written(nodes.groupBy("fp").agg(F.min(F.struct("set", "least")).alias("first")), "near-prints")
    near = links(prints.select("fp"))
    by_bits = (
        near.join(prints.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a")
        .join(prints.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
        .select(F.col("x.set").alias("a"), F.col("x.least").alias("a_doc"), F.col("y.set").alias("b"), F.col("y.least").alias("b_doc"))
    )
    pairs = written(by_sample.unionByName(by_bits).where("a <> b").distinct(), "near-pairs")
    alike = written(_alike(docs, pairs, similarity), "near-links")
    roots = connected(alike).select(F.col("a").alias("set"), F.col("b").alias("root"))
    rooted = written(nodes.select("set", "least").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")), "near-roots")
    often = rows.where("often IS NOT NULL").select(F.explode("often").alias("h"))
    more = _alike(docs, written(_between(docs, rooted, often, similarity), "near-between"), similarity)
    for end in "ab":
        more = more.join(rooted.select(F.col("set").alias(end), F.col("root").alias(f"{end}_root")), end)
    joined = connected(more.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))).select(F.col("a").alias("root"), F.col("b").alias("top"))
    rooted = rooted.join(joined, "root", "left").select("set", "least", F.coalesce("top", "root").alias("root"))
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "near-least")
    named = written(rooted.join(least, "root").select("set", "component_id"), "near-names")
    return rows.join(named, "set").select("doc_id", "component_id")


def near_representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of ``near_groups``, that with the smallest doc_id. Rows that repeat under it stay together; other columns are kept."""
    names = docs.columns
    kept = near_groups(docs, similarity).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("of_doc")).distinct()
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))  # names may differ in case alone
    return numbered.join(kept, F.col(f"c{names.index('doc_id')}").eqNullSafe(F.col("of_doc")), "left_semi").toDF(*names)
