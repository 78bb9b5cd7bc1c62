"""N-gram Jaccard join by token-combination prefixes.

A document is its set of word shingles. Two documents link when the sets' Jaccard
similarity reaches the threshold; linked documents form components.

Prefix principle: order all shingles once, the same way for every document. Two sets
that link share at least ``k`` shingles within their first ``n - overlap + k``. Only
such prefixes are compared, and rare shingles come first in the order.

1. Equal sets fall together by a digest, so copies are one class from here on.
2. A first order by hashed frequency classes gives prefixes of two fifths of a set. A
   class that links with another shares at least as many of them as reach beyond the
   shingles that it may miss; classes that share fewer link with nothing. What remains
   are candidates.
3. Among the candidates the exact frequencies decide the order. A shingle that no other
   candidate holds comes before all others and uses up prefix places, so heavily
   changed copies soon have no prefix left that could reach the threshold.
4. Prefix shingles are joined twice. First every class meets the class with the best
   place for that shingle. Verified links form components, and only classes of
   different components that share a shingle are compared after that: by the single
   shingle if it is rare, by a combination of two shingles if it is frequent. A
   combination is kept folded, as the shingle and the prefix it belongs to.
5. Every pair that is left is verified on the whole sets.

No step gathers the documents of a shingle or of a group in one row, and no pair inside
a component is formed again. Shingles are 64-bit hashes of five word hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import join_small
from ..session import stage
from .common import free_name, text_or_empty

#: Hashed frequency classes of the first order, and how many travel in one row.
BUCKET_BITS, CHUNKS = 18, 8
#: Tasks whose counts are added up before all are.
FAN_IN = 256
#: Shingles of more candidate classes than this are frequent.
FREQUENT = 32
#: Percent of a set that the first prefixes hold.
REACH = 40
#: Buckets with this many shingles, and this many times the mean, are full.
FULL_BUCKET, FULL_TIMES = 1000, 64
#: Shingles that leave a worker together.
HELD_SHINGLES = 250_000
KEPT_HASHES = 300_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sets of shingle hashes for texts in UTF-8; word hashes are kept between texts."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        known = self.known
        if len(known) > KEPT_HASHES:
            known.clear()
        hashes = [known.get(w) for w in words]
        if None in hashes:
            for i, word in enumerate(words):
                if hashes[i] is None:
                    hashes[i] = known[word] = xxhash.xxh3_64_intdigest(word)
        h = np.array(hashes, dtype=np.uint64)
        size = min(self.size, len(h))
        if not size:
            return h
        total = np.full(len(h) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            total = total * _FACTOR + h[k : k + len(total)]
        total ^= total >> np.uint64(29)  # spreads the sums over the high bits
        return np.unique(total * _FACTOR)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.md5(shingles.tobytes()).digest()


def class_of(sig: bytes) -> int:
    """A class as one number, for the index; classes are told apart by the digest."""
    return int.from_bytes(sig[:8], "little", signed=True)


def need(n, percent: int):
    """Least overlap with any set that links to one of ``n`` shingles."""
    return -(-percent * n // 100)


def reach(n: int, percent: int) -> int:
    """Length of the first prefix: more than the shingles that a link may miss."""
    return max(n - need(n, percent) + 1, -(-REACH * n // 100))


def _may_differ(n, percent: int):
    """True if a set of ``n`` shingles may link with one that differs from it.

    The closest other set has one shingle more, a similarity of n / (n + 1).
    """
    return n * (100 - percent) >= percent


def _sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    content = text_or_empty(text)
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.md5(content.cast("binary")).alias("key"),
        content.cast("binary").alias("text"),
    )


def _describe(texts: DataFrame, size: int) -> DataFrame:
    """One pass over the texts, the only one: a row for each document, and counts by bucket.

    Of a document: its id, the digest of its text, and its set with size and digest.
    """
    schema = (
        "doc_id long, key string, n long, sig binary, class long, tokens array<long>, "
        "task long, chunk int, counts binary"
    )
    names = ["doc_id", "key", "n", "sig", "class", "tokens", "task", "chunk", "counts"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()),
             pa.int64(), pa.int32(), pa.binary()]

    def run(batches):
        shingler = Shingler(size)
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                sets, held = [], 0
                while begin + len(sets) < batch.num_rows and held < HELD_SHINGLES:
                    sets.append(shingler(batch.column("text")[begin + len(sets)].as_py()))
                    held += len(sets[-1])
                k, part = len(sets), batch.slice(begin, len(sets))
                whole = np.concatenate(sets)
                counts += np.bincount(_bucket(whole), minlength=len(counts))
                sigs = [digest(s) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(whole.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("key"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sigs, pa.binary()),
                        pa.array(map(class_of, sigs), pa.int64()),
                        tokens,
                        *[pa.nulls(k, kind) for kind in kinds[6:]],
                    ],
                    names=names,
                )
                begin += k
        parts = np.split(counts, CHUNKS)
        yield pa.RecordBatch.from_arrays(
            [
                *[pa.nulls(CHUNKS, kind) for kind in kinds[:6]],
                pa.array([TaskContext.get().partitionId()] * CHUNKS, pa.int64()),
                pa.array(range(CHUNKS), pa.int32()),
                pa.array([p.tobytes() for p in parts], pa.binary()),
            ],
            names=names,
        )

    return texts.mapInArrow(run, schema)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _bucket_counts(described: DataFrame) -> np.ndarray:
    """Counts of all buckets: a vector of fixed length, added up in two levels."""

    def add(pdf):
        total = sum(np.frombuffer(c, dtype=np.int64) for c in pdf["counts"])
        return pdf.iloc[:1].assign(counts=[total.tobytes()])

    rows = described.filter("chunk is not null").select(
        "chunk", (F.col("task") % FAN_IN).alias("part"), "counts"
    )
    schema = "chunk int, part long, counts binary"
    rows = rows.groupBy("chunk", "part").applyInPandas(add, schema)
    rows = rows.groupBy("chunk").applyInPandas(add, schema)
    found = {r["chunk"]: np.frombuffer(bytes(r["counts"]), dtype=np.int64) for r in rows.collect()}
    empty = np.zeros((1 << BUCKET_BITS) // CHUNKS, dtype=np.int64)
    return np.concatenate([found.get(c, empty) for c in range(CHUNKS)])


def _prefixes(rows: DataFrame, percent: int, counts: np.ndarray) -> DataFrame:
    """Rows (token, class, m): first prefixes under the order by bucket counts.

    Tokens of very full buckets are not looked up at all: they count as shared, m of
    them in a row without a token. That can only let more classes pass, and no token
    gathers a large part of all classes in one task.
    """
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    full = max(FULL_BUCKET, FULL_TIMES * int(counts.mean()))
    sets = rows.filter(_may_differ(F.col("n"), percent)).select("class", "tokens")

    def run(batches):
        order = shared.value
        for batch in batches:
            column = batch.column("tokens")
            ends = column.offsets.to_numpy()
            whole = column.values.to_numpy().view(np.uint64)
            names = batch.column("class").to_numpy()
            begin = 0
            while begin < len(names):  # a part of the batch at a time
                to = int(np.searchsorted(ends, ends[begin] + HELD_SHINGLES, side="right")) - 1
                to = max(begin + 1, min(to, len(names)))
                tokens, classes, often = [], [], np.zeros(to - begin, np.int64)
                for i in range(begin, to):
                    s = whole[ends[i] : ends[i + 1]]
                    n = order[_bucket(s)]
                    # a set is sorted, so equal counts stay in the order of shingles
                    best = np.argsort(n, kind="stable")[: reach(len(s), percent)]
                    rare = best[n[best] < full]
                    tokens.append(s[rare])
                    classes.append(np.full(len(rare), names[i], np.int64))
                    often[i - begin] = len(best) - len(rare)
                token = np.concatenate(tokens).view(np.int64)
                many = np.flatnonzero(often)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([token, np.zeros(len(many), np.int64)]),
                                 mask=np.arange(len(token) + len(many)) >= len(token)),
                        pa.array(np.concatenate([*classes, names[begin:to][many]])),
                        pa.array(np.concatenate([np.zeros(len(token), np.int64), often[many]]),
                                 mask=np.arange(len(token) + len(many)) < len(token)),
                    ],
                    names=["token", "class", "m"],
                )
                begin = to

    return sets.mapInArrow(run, "token long, class long, m long")


def shared_counts(batches):
    """Rows (class, m) from sorted batches (token, class, m): shared tokens of each class.

    A run of one token may span batches. Its first class is told as soon as another one
    turns up; of equal rows one counts. Only the end of a batch is kept. Rows that have
    an m already pass through.
    """
    last = (None, None)  # row before this batch
    first, told = None, False  # of the run that the row belongs to
    for batch in batches:
        done = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        if done.any():
            yield batch.filter(pa.array(done)).select(["class", "m"])
            batch = batch.filter(pa.array(~done))
        t, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(t):
            continue
        goes_on = last[0] is not None and t[0] == last[0]
        begins = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        lengths = np.diff(np.append(begins, len(t)))
        starters = c[begins].copy()
        known = np.zeros(len(begins), bool)
        if goes_on:
            starters[0], known[0] = first, told
        fresh = np.concatenate(
            [[not (goes_on and c[0] == last[1])], (t[1:] != t[:-1]) | (c[1:] != c[:-1])]
        )
        other = fresh & (c != np.repeat(starters, lengths))
        shared = np.add.reduceat(other, begins) > 0
        found = np.concatenate([c[other], starters[shared & ~known]])
        last, first, told = (t[-1], c[-1]), starters[-1], bool(shared[-1] or known[-1])
        if len(found):
            classes, m = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(m)], names=["class", "m"])


def _sharing(prefixes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Classes that share enough prefix tokens with others to link with one."""
    # rows without a token go along by their class and come out as they are
    spread = prefixes.withColumn("token", F.coalesce("token", "class"))
    dealt = spread.repartition("token").sortWithinPartitions("token", "class")
    counted = dealt.mapInArrow(shared_counts, "class long, m long")
    counted = counted.groupBy("class").agg(F.sum("m").alias("m"))
    sizes = rows.groupBy("class").agg(F.min("n").alias("n"))
    # Of two linked prefixes, the one that ends earlier in the order lacks only what
    # its set may miss: REACH - (100 - percent) percent of the smaller set are shared.
    least = F.greatest(F.lit(1), F.expr(f"ceil({REACH + percent - 100} * n / 100)"))
    return counted.join(sizes, "class").filter(F.col("m") >= least).select("class")


def _candidate_sets(rows: DataFrame, percent: int, wanted: DataFrame) -> DataFrame:
    """Rows (sig, n, tokens) of the candidate classes, each once."""
    sets = rows.filter(_may_differ(F.col("n"), percent))
    found = join_small(sets, wanted, ["class"], "left_semi")
    return found.dropDuplicates(["sig"]).select("sig", "n", "tokens")


def _index(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (token, df, sig, n, place): prefixes under the exact order of candidates.

    Prefixes are extended by one place, for combinations of two.
    """
    single = sets.select("sig", "n", F.explode("tokens").alias("token"))
    counts = single.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = single.join(counts, "token")
    ordered = shared.groupBy("sig", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own")
    )
    # places count the shingles that nobody shares, which come first
    ordered = ordered.withColumn("alone", F.col("n") - F.size("own"))
    length = F.expr(f"n - ceil({percent} * n / 100) + 2 - alone")
    cut = F.slice("own", 1, F.greatest(length, F.lit(0)).cast("int"))
    rows = ordered.select("sig", "n", "alone", F.posexplode(cut))
    return rows.select(
        F.col("col.token").alias("token"),
        F.col("col.df").alias("df"),
        "sig",
        "n",
        (F.col("alone") + F.col("pos")).alias("place"),
    )


def _may_link(a: str, b: str, percent: int):
    """Length and positional bounds of two index rows that share a token."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place"))
    return (
        (100 * n >= percent * m)
        & (100 * m >= percent * n)
        & ((100 + percent) * rest >= percent * (n + m))
    )


def _pair(a, b):
    return F.least(a, b).alias("x"), F.greatest(a, b).alias("y")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) whose whole sets reach the threshold."""
    left = sets.select(F.col("sig").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
    right = sets.select(F.col("sig").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
    both = F.size(F.array_intersect("tx", "ty"))
    union = F.col("nx") + F.col("ny") - both
    joined = pairs.join(left, "x").join(right, "y")
    return joined.filter(100 * both >= percent * union).select("x", "y")


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for all nodes of ``links`` (x, y); root is the smallest node.

    Alternating stars: every node hands its larger, then its smaller neighbours to the
    smallest one, until nothing changes. Each round is a written table.
    """
    edges = stage(links.filter("x <> y").distinct(), "links")
    changed = True
    while changed:
        both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        smallest = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("low"))
        large = (
            both.filter("y > x").join(smallest, "x")
            .select(F.col("low").alias("x"), "y").filter("x <> y").distinct()
        )
        large = stage(large, "large-star")
        down = large.groupBy("y").agg(F.min("x").alias("low"))
        small = large.join(down, "y").select(
            F.col("low").alias("a"), F.explode(F.array("x", "y")).alias("b")
        )
        fresh = stage(
            small.filter("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct(),
            "small-star",
        )
        # a star forest: no node is both a root and a leaf, and each leaf has one root
        roots = fresh.select(F.col("x").alias("node")).distinct()
        leaf = fresh.groupBy("y").agg(F.count("*").alias("k"))
        changed = (
            not leaf.filter("k > 1").isEmpty()
            or not leaf.join(roots, F.col("y") == F.col("node"), "left_semi").isEmpty()
        )
        edges = fresh
    return edges.select(F.col("y").alias("node"), F.col("x").alias("root")).union(
        edges.select(F.col("x").alias("node"), F.col("x").alias("root")).distinct()
    )


def class_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) of candidate classes that connect all that link, see above."""
    index = stage(_index(sets, percent), "ngram-index")
    hubs = index.groupBy("token").agg(
        F.min_by(F.struct("sig", "n", "place"), F.struct("place", "sig")).alias("hub")
    )
    hubs = hubs.select("token", "hub.*")
    met = (
        index.alias("a").join(hubs.alias("b"), "token")
        .filter((F.col("a.sig") != F.col("b.sig")) & _may_link("a", "b", percent))
        .select(*_pair(F.col("a.sig"), F.col("b.sig"))).distinct()
    )
    met = stage(met, "hub-pairs")
    links = stage(_verified(met, sets, percent), "hub-links")

    roots = stage(components(links), "hub-components")
    placed = index.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn(
        "root", F.coalesce("root", "sig")
    )
    placed = stage(placed, "ngram-placed")
    largest = (
        placed.groupBy("token", "root").agg(F.count("*").alias("k"))
        .groupBy("token").agg(F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots"))
        .filter("roots > 1").select("token", F.col("top.root").alias("largest"))
    )
    few = placed.join(largest, "token").filter("root <> largest")
    crossing = (
        few.alias("a").join(placed.alias("b"), "token")
        .filter((F.col("a.root") != F.col("b.root")) & _may_link("a", "b", percent))
        .groupBy(*_pair(F.col("a.sig"), F.col("b.sig")))
        .agg(F.min("a.df").alias("df"))
        .join(met, ["x", "y"], "left_anti")
    )
    prefix = index.groupBy("sig").agg(F.collect_list("token").alias("own"))
    combined = (
        crossing.filter(F.col("df") > FREQUENT)
        .join(prefix.select(F.col("sig").alias("x"), F.col("own").alias("px")), "x")
        .join(prefix.select(F.col("sig").alias("y"), F.col("own").alias("py")), "y")
        .filter(F.size(F.array_intersect("px", "py")) >= 2)
    )
    rare = crossing.filter(F.col("df") <= FREQUENT)
    left = stage(rare.select("x", "y").union(combined.select("x", "y")), "crossing-pairs")
    return links.union(_verified(left, sets, percent))


def _components(
    docs: DataFrame, doc_id: str, text: str, size: int, percent: int
) -> tuple[DataFrame, DataFrame]:
    """Written rows (doc_id, key, n, sig) of all documents and (sig, root) of their sets."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50, at most 100")
    described = stage(_describe(_sets(docs, doc_id, text), size), "ngram-sets")
    rows = described.filter("sig is not null")
    prefixes = _prefixes(rows, percent, _bucket_counts(described))
    wanted = stage(_sharing(prefixes, rows, percent), "ngram-candidates")
    sets = stage(_candidate_sets(rows, percent, wanted), "candidate-sets")
    roots = stage(components(class_links(sets, percent)), "ngram-components")
    classes = rows.filter("n > 0").select("sig").distinct()
    named = classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn(
        "root", F.coalesce("root", "sig")
    )
    return rows.select("doc_id", "key", "n", "sig"), stage(named, "ngram-classes")


def ngram_components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs``.

    Words are runs without ASCII white space, A-Z in lower case. A text of fewer than
    ``size`` words is one shingle. Null and empty texts have none and link with
    nothing: their component is their own id. The component of others is the smallest
    id that links reach; equal sets link, so repeated rows share a component. Ids are
    whole numbers. Null ids take part but never name a component; the id is null only
    where all are. ``percent`` is above 50, up to 100: two linked sets that differ then
    share two shingles at least, which combinations rely on.
    """
    rows, final = _components(docs, doc_id, text, size, percent)
    # copies meet in one row for each set before sets meet their component
    low = rows.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("low"))
    lowest = low.join(final, "sig").groupBy("root").agg(F.min("low").alias("component_id"))
    final = final.join(lowest, "root").select("sig", "component_id")
    linked = rows.filter("n > 0").join(final, "sig").select("doc_id", "n", "component_id")
    alone = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumnRenamed("n", "n_shingles")


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, nulls last.

    Of rows with that id the smallest digest of the text counts, of equal rows any one.
    Rows without a word link with nothing and all stay, repeated ones too.
    """
    rows, final = _components(docs, doc_id, text, size, percent)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    low = rows.filter("n > 0").groupBy("sig").agg(F.min(order).alias("low"))
    first = low.join(final, "sig").groupBy("root").agg(F.min("low").alias("first"))
    number = free_name("_number", docs.columns)
    key = free_name("_key", docs.columns)
    chosen = first.select(
        F.coalesce("first.doc_id", F.lit(0)).alias(number),
        F.when(F.col("first.doc_id").isNull(), F.concat(F.lit("-"), "first.key"))
        .otherwise(F.col("first.key")).alias(key),
    )
    content = text_or_empty(text)
    digest_of = F.md5(content.cast("binary"))
    given = F.col(doc_id).cast("long")
    marked = docs.withColumns(
        {
            number: F.coalesce(given, F.lit(0)),
            key: F.when(given.isNull(), F.concat(F.lit("-"), digest_of)).otherwise(digest_of),
        }
    )
    worded = content.rlike(r"[^\x20\x09-\x0D]")
    linked = marked.filter(worded).join(chosen, [number, key], "left_semi")
    one = linked.dropDuplicates([number, key])
    return one.unionByName(marked.filter(~worded)).drop(number, key)
