"""SimHash near-deduplication with bit-sliced comparison.

A fingerprint has 64 bits, each the majority over the XXH64 of a document's word shingles. Two fingerprints
link at ``radius`` or fewer differing bits. Cut into ``radius`` + 2 blocks, linked fingerprints agree in at
least two of them, so distinct fingerprints are dealt to one bucket for every two blocks (ten tables of
25 or 26 key bits for radius 3), and every link lies within a bucket.

Inside a bucket the fingerprints are stored as bit planes: word p holds bit p of 64 fingerprints. A query's
bit p, spread over a word, flips the plane to 64 differences at once, which carry-save counters of two bits
and a sticky overflow add up; a (query, block of 64) whose lanes have all gone beyond the radius is
abandoned and takes no part in later planes. Buckets of more than ``CHUNK`` fingerprints are cut into parts
by hash, compared within each part first; then every two parts that aren't of one component already are a group
of their own, so the work of a hot bucket spreads over tasks and no group is larger than two parts. A group returns a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, may_match, rows_of, whole_texts
from .components import components

CHUNK = 1024
#: Bytes of shingle sets in a part, where links are verified.
CHUNK_BYTES = 16 << 20
#: (query, block) pairs that are compared at once: 16,384 take about 1 MB of counters.
TASKS = 16_384
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each ``width``-word shingle in order: A-Z lower-cased, words between ASCII white space. Fewer words are one shingle, none is none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that more than half of the hashes have set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text in UTF-8; without a word it is 0."""
    return int(majority(shingle_hashes(text, width, seed)))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): ``fp`` is the fingerprint as a signed long. One row per row; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width) for t in rows_of(batch)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return whole_texts(docs, "doc_id").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _planes(fps: np.ndarray, words: np.ndarray, lanes: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The bit planes (bits, n_words) of fingerprints (n, k words of 64 bits) placed at (word, lane), and the mask of lanes in use."""
    bits = 64 * fps.shape[1]
    planes, bit = np.zeros((bits, n_words), np.uint64), np.uint64(1) << lanes.astype(np.uint64)
    # Rows come in the order of their words.
    heads = np.flatnonzero(np.diff(words, prepend=-1))
    for p in range(bits):
        planes[p, words[heads]] = np.bitwise_or.reduceat((fps[:, p // 64] >> np.uint64(p % 64) & np.uint64(1)) * bit, heads)
    used = np.zeros(n_words, np.uint64)
    used[words[heads]] = np.bitwise_or.reduceat(bit, heads)
    return planes, used


def _near(queries: np.ndarray, words: np.ndarray, planes: np.ndarray, used: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a query and a word of 64 lanes: the positions of pairs that have a hit, and the lanes that hit.

    Carry-save counting: two planes and the lowest counter bit are added at once, and only the carry ripples on.
    Counters begin so far below a power of two that a lane beyond ``radius`` overflows, which sticks in ``over``.
    """
    live, n = np.arange(len(queries)), radius.bit_length()
    begin = (1 << n) - 1 - radius
    count = [np.full(len(queries), _ALL if begin >> i & 1 else 0, np.uint64) for i in range(n)]
    over = ~used[words]
    differs = lambda p: planes[p, words] ^ (np.uint64(0) - (queries[:, p // 64] >> np.uint64(p % 64) & np.uint64(1)))
    for p in range(0, len(planes), 2):
        a, b = differs(p), differs(p + 1)
        if n:
            half = count[0] ^ a
            carry = (count[0] & a) | (half & b)
            count[0] = half ^ b
            for i in range(1, n):
                count[i], carry = count[i] ^ carry, count[i] & carry
            over |= carry
        else:
            over |= a | b
        if p % 8 == 6:
            stay = over != _ALL
            if not stay.all():
                live, over, queries, words, count = live[stay], over[stay], queries[stay], words[stay], [c[stay] for c in count]
                if not len(live):
                    break
    stay = over != _ALL
    return live[stay], ~over[stay]


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (of each its root) after links a-b; roots are the smallest positions."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if len(a):
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            parent = _find(parent)
    return parent


def _unite_if(parent: np.ndarray, a: np.ndarray, b: np.ndarray, linked: Callable[[int, int], bool]) -> np.ndarray:
    """As ``_unite``, of the pairs that ``linked`` confirms; it is not asked about pairs that are joined already."""
    apart = parent[a] != parent[b]
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for x, y, rx, ry in zip(*(v[apart].tolist() for v in (a, b, parent[a], parent[b])), strict=True):
        rx, ry = root(rx), root(ry)
        if rx != ry and linked(x, y):
            up[max(rx, ry)] = min(rx, ry)
    if up:
        old = np.fromiter(up, np.int64, len(up))
        parent[old] = [root(x) for x in up]
        parent = _find(parent)
    return parent


def near_links(fps: np.ndarray, groups: np.ndarray, radius: int = 3, linked: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (member, root) of the links within each group of fingerprints (n, words). ``groups`` is sorted; equal values are a group.

    With ``linked``, fingerprints within the radius are candidates, and those positions link that it confirms.
    """
    n = len(fps)
    first = np.flatnonzero(np.diff(groups, prepend=groups[0] - 1 if n else 0))
    size = np.diff(np.append(first, n))
    nth = np.arange(n) - np.repeat(first, size)
    n_words = -(-size // 64)
    word_at = np.concatenate(([0], np.cumsum(n_words)))
    words = np.repeat(word_at[:-1], size) + nth // 64
    planes, used = _planes(fps, words, nth % 64, int(word_at[-1]))
    word_first = np.full(int(word_at[-1]), n, np.int64)
    np.minimum.at(word_first, words, np.arange(n))
    parent = np.arange(n)
    # Each query meets its own word and the later ones of its group: a pair of words is met once.
    left = np.repeat(word_at[1:], size) - words
    ends = np.cumsum(left)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TASKS, "right")))
        count = left[at:to]
        query = np.repeat(np.arange(at, to), count)
        word = words[query] + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        live, hits = _near(fps[query], word, planes, used, radius)
        query, word = query[live], word[live]
        while len(query):
            low = hits & (~hits + np.uint64(1))
            lane = np.bitwise_count(low - np.uint64(1)).astype(np.int64)
            other = word_first[word] + lane
            parent = _unite(parent, query, other) if linked is None else _unite_if(parent, query, other, linked)
            hits = hits & ~low
            more = hits != 0
            query, word, hits = query[more], word[more], hits[more]
        at = to
    members = np.flatnonzero(parent != np.arange(n))
    return members, parent[members]


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted arrays without repeats) have at least this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-6:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / max(1, len(both) - shared) >= similarity


def _buckets(fp: Column, radius: int) -> Column:
    """The buckets of a fingerprint: for every two of radius + 2 blocks, their number and bits."""
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << edges[i + 1] - edges[i]) - 1)) for i in range(blocks)]
    pairs = itertools.combinations(range(blocks), 2)
    return F.array(*[F.lit(t << 58) + F.shiftleft(part[i], edges[j + 1] - edges[j]) + part[j] for t, (i, j) in enumerate(pairs)])


def bucket_links(rows: DataFrame, radius: int, chunk: int | None = None, signatures: DataFrame | None = None, similarity: float | None = None) -> DataFrame:
    """(a, b): links between nodes that join all that chains of links within buckets join.

    ``rows`` has (node, bucket). A node is its own fingerprint (a long), or has a longer one, of bytes, in ``signatures`` (node, sig).
    With ``similarity``, ``signatures`` has ``shingles`` too, the sorted hashes as bytes, and ``rows`` their ``size`` in
    bytes: nodes within the radius link if their sets have this Jaccard similarity.

    A bucket of more than ``chunk`` nodes is cut into parts by hash and each is compared within itself. Where parts
    are left, nodes that chains have joined by then needn't meet again: a component of more than a part gets parts of its
    own, the rest of the bucket shares some, and two parts meet unless they are of one component. So a hot bucket of
    near copies of one text ends as one component and is copied no further.
    """
    chunk = chunk or CHUNK
    parts = F.ceil(F.count("*") / chunk)
    if similarity is not None:
        parts = F.greatest(parts, F.ceil(F.sum("size") / CHUNK_BYTES))
    parts = parts.cast("int").alias("parts")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    sizes = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n"), parts).where("n > 1").select("bucket", "parts"), "sizes")
    alone = rows.join(sizes, "bucket").select("bucket", part.alias("lo"), part.alias("hi"), "node")
    found = materialize(_compared(alone, radius, signatures, similarity), "links")
    hot = sizes.where("parts > 1").select("bucket")
    if hot.isEmpty():
        return found
    inside = rows.join(hot, "bucket", "left_semi").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    inside = materialize(inside, "hot")
    large = materialize(inside.groupBy("bucket", "root").agg(parts).where("parts > 1"), "large")
    owned = inside.join(large.withColumnRenamed("parts", "own"), ["bucket", "root"], "left")
    owned = materialize(owned.withColumn("owner", F.when(F.col("own").isNotNull(), F.col("root"))), "owned")
    shared = owned.where("owner IS NULL").groupBy("bucket").agg(parts).select("bucket", F.lit(None).cast(dict(rows.dtypes)["node"]).alias("owner"), "parts")
    each = large.select("bucket", F.col("root").alias("owner"), "parts").unionByName(shared)
    each = each.select("bucket", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct("owner", i.alias("i"))))).select("bucket", "col.*")
    # The parts of a bucket, one for each ``chunk`` of its nodes, numbered.
    numbered = each.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("owner", "i"))).alias("all"), F.count_if(F.col("owner").isNull()).cast("int").alias("shared"))
    numbered = materialize(numbered.where("size(all) > 1"), "parts")
    met = owned.join(numbered, "bucket").withColumn("parts", F.coalesce("own", "shared"))
    met = met.withColumn("at", F.array_position("all", F.struct("owner", part.alias("i"))).cast("int"))
    others = F.filter(F.transform("all", lambda q, k: F.struct(q["owner"].alias("owner"), (k + 1).alias("at"))), lambda q: F.col("owner").isNull() | ~q["owner"].eqNullSafe(F.col("owner")))
    met = met.withColumn("other", F.explode(F.transform(others, lambda q: q["at"])))
    met = met.select("bucket", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), "node")
    return found.unionByName(_compared(met, radius, signatures, similarity))


def _compared(groups: DataFrame, radius: int, signatures: DataFrame | None, similarity: float | None) -> DataFrame:
    """(a, b): a spanning forest of the links within each group (bucket, lo, hi) of nodes."""
    if signatures is not None:
        groups = groups.join(signatures, "node")
    kind = dict(groups.dtypes)["node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def solved(table: pa.Table) -> pa.RecordBatch:
            node = table.column("node").combine_chunks()
            if "sig" in table.column_names:
                fps = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(table.num_rows, -1)
            else:
                fps = node.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
            new = np.zeros(len(fps), bool)
            for c in ("bucket", "lo", "hi"):
                new |= np.diff(table.column(c).to_numpy(), prepend=table.column(c)[0].as_py()) != 0
            linked = None
            if similarity is not None:
                sets = table.column("shingles").combine_chunks()
                members = lambda i: np.frombuffer(sets[i].as_buffer(), np.uint64)
                linked = lambda i, j: similar(members(i), members(j), similarity)
            member, root = near_links(fps, np.cumsum(new), radius, linked)
            return pa.RecordBatch.from_arrays([node.take(pa.array(member)), node.take(pa.array(root))], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            if not table.num_rows:
                continue
            # The last group may go on in the next batch. It is never much larger than two parts.
            tail = np.ones(table.num_rows, bool)
            for c in ("bucket", "lo", "hi"):
                v = table.column(c).to_numpy()
                tail &= v == v[-1]
            cut = table.num_rows - int(tail.sum())
            if cut:
                yield solved(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield solved(rest)

    sorted_rows = groups.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return sorted_rows.mapInArrow(run, f"a {kind}, b {kind}")


def links(distinct: DataFrame, radius: int = 3, chunk: int | None = None) -> DataFrame:
    """Links between distinct fingerprints ``fp`` of ``radius`` or fewer differing bits, as ``bucket_links`` gives them."""
    rows = distinct.select(F.col("fp").alias("node"), F.explode(_buckets(F.col("fp"), radius)).alias("bucket"))
    return bucket_links(rows, radius, chunk)


def near_groups(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), component_id, the smallest doc_id that links reach, its own included.

    A null or wordless text has fingerprint 0 and links like any other. Equal fingerprints link, so copies,
    repeated rows and ties of an id fall together. Null ids are passed over when the smallest is sought;
    a component of nothing else has a null id. Other columns are ignored; an empty table gives none.
    """
    fps = materialize(fingerprints(docs, width), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = materialize(components(links(distinct, radius)), "components").withColumnRenamed("node", "fp")
    least = roots.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("least"))
    linked = roots.join(least, "root").select("fp", "least")
    named = materialize(distinct.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: For near-duplicates by similarity: words of 64 bits in a fingerprint, bands of minima, and minima in each band.
WIDE = 8
BANDS, BAND_ROWS = 24, 5
_MIX = np.random.default_rng(20).integers(1, 1 << 63, BANDS * BAND_ROWS + WIDE, np.uint64) | np.uint64(1)


def sketch(text: bytes, width: int) -> tuple[bytes, bytes, list[int], bytes]:
    """A text's set of shingles as a 128-bit digest, a SimHash of 512 bits, its bands of minimum hashes, and its sorted hashes."""
    shingles = np.unique(shingle_hashes(text, width))
    sig = np.zeros(WIDE, np.uint64)
    low = np.full(BANDS * BAND_ROWS, _ALL, np.uint64)
    for k in range(WIDE):
        mixed = shingles * _MIX[k]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        sig[k] = majority(mixed)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024, None] * _MIX[None, WIDE:]
        low = np.minimum(low, (part ^ part >> np.uint64(32)).min(axis=0))
    bands = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(low.reshape(BANDS, BAND_ROWS))]
    return xxhash.xxh3_128_digest(shingles.tobytes()), sig.tobytes(), np.array(bands, np.uint64).view(np.int64).tolist(), shingles.tobytes()


def radius_of(similarity: float) -> int:
    """The bits of a wide fingerprint within which two sets of this Jaccard similarity are candidates.

    Sets of equal size differ in most bits, an angle's share of them. Six standard deviations more leave room for sets of a
    few shingles, whose majorities tie: 4 of 5 shingles differ in 96 bits rather than 78.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(64 * WIDE * share + 6 * (64 * WIDE * share * (1 - share)) ** 0.5)


def _text_digest(text: Column) -> Column:
    """128 bits of a text's SHA-256: with its id, what a row is told apart by."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest (of its text), component_id, kept.

    Documents whose sets of ``width``-word shingles are this similar, in chains, have one component; its id is the smallest
    of theirs, and the row of that id is kept. Of rows that share the smallest id that of the smallest digest is kept;
    rows of one id and one text stay or go together. Null ids come last.

    Fingerprints of 64 bits can't tell 0.8 from 0.6, and bit blocks don't find pairs that far apart, so this takes
    512 bits, and bands of minimum hashes of the same shingles deal the buckets (a pair at 0.8 meets in one of 24 with
    99.99 %); the comparison inside a bucket is the same. What chains of these candidates join is compared once more, and
    a candidate links by the exact similarity of its sets. Texts without words are alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sig, bands = zip(*(sketch(t, width)[:3] for t in rows_of(batch)), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "digest", "node", "sig", "bands"])

    def run_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = rows_of(batch)
            while rows := [sketch(t, width) for t in itertools.islice(texts, 256)]:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1, 3)], names=["node", "sig", "shingles"])

    kind = dict(docs.dtypes)["doc_id"]
    marked = docs.select("doc_id", _text_digest(F.col("text")).alias("digest"), "text")
    sketches = materialize(whole_texts(marked, "doc_id", "digest").mapInArrow(run, f"doc_id {kind}, digest binary, node binary, sig binary, bands array<long>"), "sketches")
    # Of equal sets one row: all have the same signature and bands. The first is that of the smallest id, nulls last.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    distinct = materialize(sketches.groupBy("node").agg(F.min(order).alias("first"), F.min("digest").alias("digest")), "distinct")
    once = materialize(sketches.dropDuplicates(["node"]).select("node", "sig", "bands"), "once")
    rows = once.select("node", F.explode("bands").alias("bucket"))
    radius = radius_of(similarity)
    chains = materialize(components(bucket_links(rows, radius, signatures=once.select("node", "sig"))), "chains").withColumn("bucket", F.xxhash64("root"))
    # Shingle sets are made for one text of each node in chains alone, and travel once for each node, not for each band.
    chosen = materialize(distinct.join(chains, "node", "left_semi").select("digest"), "chosen")
    texts = docs.select(_text_digest(F.col("text")).alias("digest"), "text")
    candidates, _ = may_match(texts, F.col("digest"), chosen, "digest")
    sets = whole_texts(candidates.join(chosen, "digest", "left_semi")).mapInArrow(run_sets, "node binary, sig binary, shingles binary")
    chained = materialize(sets.join(chains, "node").dropDuplicates(["node"]).select("node", "bucket", "sig", "shingles"), "chained")
    rows = chained.select("node", "bucket", F.octet_length("shingles").cast("long").alias("size"))
    roots = materialize(components(bucket_links(rows, radius, signatures=chained.select("node", "sig", "shingles"), similarity=similarity)), "components")
    least = materialize(roots.join(distinct, "node").groupBy("root").agg(F.min("first").alias("least")), "least")
    linked = materialize(roots.join(least, "root").select("node", "least"), "linked")
    named = materialize(distinct.join(linked, "node", "left").select("node", F.coalesce("least", "first").alias("least")), "named")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("digest") == F.col("least.digest"))
    return sketches.select("doc_id", "digest", "node").join(named, "node").select("doc_id", "digest", F.col("least.doc_id").alias("component_id"), kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` under the same columns; of each group of similar documents one row stays, as ``similar_groups`` says.

    Rows are told apart by id and text, so unlike texts under one id are documents of their own; rows of one id and one text
    stay or go together. A row without an id stays if its group has no other. An empty table stays empty. Only rows
    that may go are shuffled.
    """
    found = similar_groups(docs, width, similarity)
    name = lambda doc_id, digest: F.xxhash64(doc_id, digest)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    gone = materialize(gone.withColumn("__name", name("__id", "__digest")), "gone")
    columns = [f"`{c}`" for c in docs.columns]
    marked = docs.withColumn("__of", _text_digest(docs["text"]))
    suspects, rest = may_match(marked, name(docs["doc_id"], F.col("__of")), gone, "__name")
    same = suspects["doc_id"].eqNullSafe(gone["__id"]) & (suspects["__of"] == gone["__digest"])
    return suspects.join(gone, same, "left_anti").select(columns).unionByName(rest.select(columns))
