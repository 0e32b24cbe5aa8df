"""N-gram Jaccard join: a size-aware heavy-light self join, exact.

Documents with equal shingle sets form a class and are joined once. Classes whose sets are small
(light) meet on enumerated subsets: sets that link share a subset of the size that the larger one
must have in common. Larger (heavy) sets meet in inverted lists of shingles: the least shingles by
hash, so many that two linked sets share a tenth of their size among them; what no other set has is
dropped there, sets that cannot link any more go, and of the rest only the rarest shingles are
listed. The boundary between light and heavy is where enumerating costs more than listing.

Sets that meet, directly or by others, form a block, which is cut into chunks of sets with the same
least token. Scanning the tokens' lists of chunks gives the pairs of chunks with a token in common;
only these are compared, set by set and exactly, from the whole texts. Only spanning links leave a
pair of chunks, never all pairs of sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import ASCII_SPACE, flat, hashable, materialise, release_heaps, release_worker, require, slices
from .components import connected_components

SHINGLE = 4
PERCENT = 85
#: Cost of an entry of an inverted list against one of an enumerated subset: entries have to be
#: sorted by frequency and scanned again.
LIST_COST = 4
#: Common shingles that a pair must show among the listed ones, unless it has fewer.
FEWEST = 48
#: Shingles seen this often among one class in SAMPLE are not counted by one task.
HOT_SEEN, SAMPLE = 32, 64
STAR_SALTS = 32
CHUNK = 256
#: Ids or shingles that are broadcast at most (16 bytes each); beyond it they are shuffled.
BROADCAST_IDS = 500_000

FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def least_common(n: int, percent: int = PERCENT) -> int:
    """Elements that a set of n must have in common with any set it links to."""
    return -(-percent * n // 100)


def shared(n: int, percent: int = PERCENT) -> int:
    """Shingles among the listed ones that linked sets of n or more must share: a tenth, but FEWEST if
    they have as many in common. Small sets are listed whole, as a tenth of few says little."""
    return min(least_common(n, percent), max(FEWEST, n // 10))


def least_shared(n: int, percent: int = PERCENT) -> int:
    """As shared, whatever the size of the other set."""
    return shared(least_common(n, percent), percent)


def n_subsets(n: int, percent: int = PERCENT) -> int:
    return sum(comb(n, k) for k in range(least_common(n, percent), n + 1))


def listed(n: int, percent: int = PERCENT) -> int:
    return min(n, n - least_common(n, percent) + shared(n, percent))


def boundary(percent: int = PERCENT, list_cost: float = LIST_COST) -> int:
    """The largest size up to which enumerating subsets is no dearer than listing shingles."""
    n = 1
    while n < 64 and n_subsets(n + 1, percent) <= list_cost * max(4, listed(n + 1, percent)):
        n += 1
    return n


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Random multipliers of a word's bytes by value and by place (up to LONG); longer words are hashed as such.
LONG = 64
_RANDOM = np.random.default_rng(0x5EED)
BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
PLACE = _RANDOM.integers(0, 1 << 64, LONG, np.uint64) | np.uint64(1)
SPACE = np.isin(np.arange(256), list(ASCII_SPACE.encode()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, and how many each text has. data: the
    bytes, at: where each text begins (and the last one ends) in it."""
    from xxhash import xxh64_intdigest

    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # a text ends a word, too
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(start, at))
    if not len(start):
        return np.zeros(0, np.uint64), counts
    length = stop - start
    begins = np.cumsum(length) - length
    low = LOWER[data]
    place = np.arange(int(length.sum())) - np.repeat(begins, length)
    with np.errstate(over="ignore"):
        codes = np.add.reduceat(BYTE[low[inside]] * PLACE[place % LONG], begins)
        codes = mix(codes + length.astype(np.uint64) * FACTORS[0])
    for i in np.flatnonzero(length > LONG):
        codes[i] = xxh64_intdigest(low[start[i] : stop[i]].tobytes())
    return codes, counts


def shingled(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words."""
    n = len(codes) - width + 1
    with np.errstate(over="ignore"):
        total = np.full(n, width, np.uint64)
        for k in range(width):
            total += mix(codes[k : n + k] + FACTORS[k % len(FACTORS)] * np.uint64(k // len(FACTORS) + 1)) * FACTORS[k % len(FACTORS)]
        return mix(total)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles. Bytes are hashed for many texts at
    once; nothing is remembered between slices."""
    data, at = flat(texts)
    for i, j in slices(at):
        codes, counts = word_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i])
        every = shingled(codes, size) if len(codes) >= size else None
        begin = 0
        for n in counts.tolist():
            if n >= size:
                yield np.unique(every[begin : begin + n - size + 1])
            else:
                yield shingled(codes[begin : begin + n], n) if n else np.zeros(0, np.uint64)
            begin += n


def subset_keys(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of all subsets that have the size some linked set may share."""
    n = len(shingles)
    with np.errstate(over="ignore"):
        each = mix(shingles + np.uint64(1))
        whole = each.sum(dtype=np.uint64)
        keys = []
        for left_out in range(n - least_common(n, percent) + 1):
            chosen = np.array(list(combinations(range(n), left_out)), np.int64).reshape(comb(n, left_out), left_out)
            sums = whole - each[chosen].sum(1, dtype=np.uint64)
            keys.append(mix(sums * FACTORS[0] + np.uint64(n - left_out)))
        return np.unique(np.concatenate(keys))


def _sets(docs: DataFrame, percent: int, size: int, light: int) -> DataFrame:
    """did, row, n, key (of the set), light and heavy tokens of every document (did, text, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        kind = pa.list_(pa.int64())
        for batch in batches:
            n, keys, lights, heavies = [], [], [], []
            for shingles in shingle_sets(batch.column(1), size):
                k = len(shingles)
                n.append(k)
                keys.append(np.uint64(xxh64_intdigest(shingles.tobytes())).astype(np.int64) if k else None)
                lights.append(subset_keys(shingles, percent).view(np.int64) if 0 < k <= light else None)
                heavies.append(shingles[: listed(k, percent)].view(np.int64) if k >= least_common(light + 1, percent) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(lights, kind), pa.array(heavies, kind)],
                names=["did", "row", "n", "key", "light", "heavy"],
            )
        release_worker()

    return docs.mapInArrow(run, "did long, row long, n long, key long, light array<long>, heavy array<long>")


def _need(n: Column, percent: int) -> Column:
    """least_shared, of a column."""
    common = F.ceil(n * percent / F.lit(100.0))
    return F.least(F.ceil(common * percent / F.lit(100.0)), F.greatest(F.lit(FEWEST), F.floor(common / F.lit(10.0)))).cast("int")


def _meetings(sets: DataFrame, percent: int) -> DataFrame:
    """token, key: where classes meet; every linked pair has a token in common."""
    classes = sets.where("key is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("light").alias("light"), F.first("heavy").alias("heavy"))
    parts = F.array(
        F.struct(F.lit(1).alias("need"), F.col("light").alias("tokens")),
        F.struct(_need(F.col("n"), percent).alias("need"), F.col("heavy").alias("tokens")),
    )
    tokens = classes.select("key", F.explode(parts).alias("p")).select("key", F.col("p.need").alias("need"), F.explode("p.tokens").alias("token"))

    # A very common shingle would bring all its sets to one task of the count. Those that a hash
    # sample of the classes shows are common get the sample's count for a frequency instead (it is
    # only an order), and their rows are dealt out by salt.
    seen = sets.where(f"key is not null and pmod(key, {SAMPLE}) = 0").groupBy("key").agg(F.first("heavy").alias("heavy"))
    seen = seen.select(F.explode("heavy").alias("token")).groupBy("token").agg(F.count("*").alias("seen")).where(f"seen >= {HOT_SEEN}")
    hot = materialise(seen, "hot", narrow=True)
    marked = tokens.join(F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot, "token", "left")
    salt = F.when(F.col("seen").isNull(), 0).otherwise(F.pmod(F.xxhash64("key"), F.lit(STAR_SALTS)) + 1)
    count = F.count("*").over(Window.partitionBy("token", "salt"))
    found = marked.withColumn("salt", salt).withColumn("often", F.coalesce(F.col("seen") * SAMPLE, count)).where("often > 1")

    lists = found.groupBy("key", "need").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("found"))
    lists = lists.where("size(found) >= need")
    return lists.select("key", F.explode(F.expr("slice(found, 1, size(found) - need + 1)")).alias("t")).select("key", F.col("t.token").alias("token"))


def _stars(meetings: DataFrame) -> DataFrame:
    """a, b: links that connect all keys of a token. A token's keys are dealt out by salt; each links to
    the least of its salt, and those to the least of the token: linear, and no task has all of a token."""
    salted = meetings.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(STAR_SALTS)))
    lead = F.first("key").over(Window.partitionBy("token", "salt").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    led = salted.select("token", F.col("key").alias("a"), lead.alias("b"))
    top = F.first("a").over(Window.partitionBy("token").orderBy("a").rowsBetween(Window.unboundedPreceding, 0))
    tops = led.where("a = b").select("a", top.alias("b"))
    return led.where("a != b").select("a", "b").union(tops.where("a != b"))


def verify_block(keys: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, first: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set its root (the least key it is linked to, directly or not) and its number of linked
    documents. first: who is of the first of two chunks, of which only pairs across are compared; None:
    one chunk, all pairs."""
    m = len(keys)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    shared = counts[codes] > 1
    owner, codes = owner[shared], codes[shared]
    dense = np.cumsum(counts > 1) - 1
    codes = dense[codes]
    common = np.zeros((m, m), np.float32)
    order = np.argsort(codes, kind="stable")
    owner, codes = owner[order], codes[order]
    n_shared = int((counts > 1).sum())
    width = max(1, min(n_shared, (1 << 22) // max(m, 1)))
    edges = np.searchsorted(codes, np.arange(0, n_shared + width, width))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a < b:
            present = np.zeros((m, width), np.float32)
            present[owner[a:b], codes[a:b] - k * width] = 1
            common += present @ present.T
    common = np.rint(common).astype(np.int64)
    links = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(links, False)
    if first is not None:
        links &= first[:, None] != first[None, :]
    roots = np.arange(m)
    for i in range(m):  # keys are sorted: the least index is the least key
        near = np.flatnonzero(links[i, :i])
        if len(near):
            joined = np.unique(roots[np.append(near, i)])
            roots[np.isin(roots, joined)] = joined[0]
    return keys[roots], links @ copies


def _chunked(meetings: DataFrame, blocks: DataFrame) -> DataFrame:
    """key, block, chunk: the classes of a block in chunks of about CHUNK. Classes with the same least
    token, which similar sets mostly share, are in one chunk, or in some of their own if they are many."""
    lead = meetings.groupBy("key").agg(F.min("token").alias("lead"))
    members = materialise(blocks.select(F.col("node").alias("key"), F.col("component").alias("block")).join(lead, "key"), "members", narrow=True)
    sizes = members.groupBy("block").agg(F.count("*").alias("size"))
    leads = members.groupBy("block", "lead").agg(F.count("*").alias("led"))
    sized = members.join(leads, ["block", "lead"]).join(sizes, "block")
    own = F.xxhash64(F.lit(1), "lead", F.pmod(F.xxhash64(F.lit(3), "key"), F.ceil(F.col("led") / CHUNK)))
    some = F.xxhash64(F.lit(2), F.pmod(F.xxhash64(F.lit(4), "lead"), F.ceil(F.col("size") / CHUNK)))
    return sized.select("key", "block", F.when(F.col("led") >= CHUNK, own).otherwise(some).alias("chunk"))


def _chunk_pairs(meetings: DataFrame, chunked: DataFrame) -> DataFrame:
    """block, i, j (i <= j): the chunks that have to be compared: those with a token in common, found by
    scanning each token's list of chunks; and every chunk with itself."""
    chunks = materialise(chunked.groupBy("block", "chunk").agg(F.count("*").alias("members")), "chunks", narrow=True)
    alone = chunks.select("block", F.col("chunk").alias("i"), F.col("chunk").alias("j"))
    many = chunks.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    # Equal lists (in a group of near copies most tokens are in all chunks) are scanned once.
    wide = materialise(chunked.join(many, "block"), "wide", narrow=True)
    lists = meetings.join(wide, "key").select("block", "token", "chunk", "n").distinct()
    lists = lists.groupBy("block", "token").agg(F.sort_array(F.collect_list("chunk")).alias("c"), F.first("n").alias("n")).where("size(c) > 1")
    lists = lists.select("block", "c", (F.size("c") == F.col("n")).alias("all")).distinct()
    whole = lists.where("all").select("block").distinct()
    lists = lists.where("all").unionByName(lists.where("not all").join(whole, "block", "left_anti"))
    across = lists.select("block", "c", F.posexplode("c").alias("at", "i")).select("block", "i", F.explode(F.expr("slice(c, at + 2, size(c))")).alias("j"))
    return alone.unionByName(across.distinct())


def _verified(members: DataFrame, pairs: DataFrame, percent: int, size: int) -> DataFrame:
    """members: block, chunk, key, text, copies. key, root, links for each of the pairs of chunks."""
    ends = F.array_distinct(F.array("i", "j"))
    dealt = pairs.withColumn("chunk", F.explode(ends)).join(members, ["block", "chunk"]).select("block", "i", "j", "key", "text", "copies", "chunk")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        keys = rows.column("key").to_numpy()
        sets = list(shingle_sets(rows.column("text").combine_chunks(), size))
        first = None if key[1] == key[2] else rows.column("chunk").to_numpy() == key[1].as_py()
        roots, links = verify_block(keys, sets, rows.column("copies").to_numpy(), first, percent)
        return pa.table({"key": keys, "root": roots, "links": links.astype(np.int64)})

    # Pairs of chunks differ in cost more than in bytes: as many partitions as the session has, whatever they hold.
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "block", "i", "j").groupBy("block", "i", "j").applyInArrow(run, "key long, root long, links long")


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE, list_cost: float = LIST_COST
) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, n_links.

    Two documents link when 100 * intersection >= percent * union of their sets of `size`-word
    shingles. component_id: the smallest doc_id reachable by links. n_links: linked documents, equal
    sets included. Fewer words than `size`: the whole sequence is one shingle; no words or null text:
    no shingles, no links, a component alone. Null ids take part; a component of null ids only has a
    null component_id. Rows with an id that occurs again are documents of their own, repeated rows
    equal sets. Other columns are not read. Empty input: no rows.
    """
    require(docs, doc_id, text)
    texts = docs.select(F.col(doc_id).cast("long").alias("did"), F.col(text).alias("text"), F.lit(0).cast("long").alias("row"))
    sets, ids = _classes(texts, percent, size, list_cost)
    least = ids.groupBy("component").agg(F.min("first").alias("component_id"))
    named = ids.join(least, "component").select("key", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return sets.select("did", "n", "key").join(named, "key", "left").select(
        F.col("did").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("did")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _classes(texts: DataFrame, percent: int, size: int, list_cost: float) -> tuple[DataFrame, DataFrame]:
    """The sets of texts (did, text, row) and their classes: key, first (least did), copies, component
    (the least key reachable by links), links."""
    release_heaps(texts.sparkSession)
    light = boundary(percent, list_cost)
    sets = materialise(_sets(texts, percent, size, light), "sets")

    meetings = materialise(_meetings(sets, percent), "meetings")
    blocks = materialise(connected_components(_stars(meetings)), "blocks", narrow=True)

    # The text of one document of each class that is in a block, fetched by id; the set's key,
    # computed again, tells rows with the same id (or none) apart.
    chunked = materialise(_chunked(meetings, blocks), "chunked", narrow=True)
    pairs = materialise(_chunk_pairs(meetings, chunked), "pairs", narrow=True)
    rep = F.coalesce(F.min("did").cast("string"), F.lit("none"))
    classes = sets.where("key is not null").groupBy("key").agg(rep.alias("rep"), F.count("*").alias("copies"))
    chosen = materialise(chunked.join(classes, "key"), "chosen", narrow=True)
    wanted = chosen.select("rep").distinct()
    if chosen.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    fetched = texts.withColumn("rep", F.coalesce(F.col("did").cast("string"), F.lit("none"))).join(wanted, "rep", "left_semi")
    release_heaps(texts.sparkSession)
    members = chosen.join(_keyed(fetched, size).dropDuplicates(["rep", "key"]), ["rep", "key"])
    verified = materialise(_verified(members, pairs, percent, size), "verified")

    linked = connected_components(verified.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    ids = sets.where("key is not null").groupBy("key").agg(F.min("did").alias("first"), F.count("*").alias("copies"))
    ids = ids.join(linked.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")).join(links, "key", "left")
    return sets, materialise(ids, "classes", narrow=True)


def _keyed(texts: DataFrame, size: int) -> DataFrame:
    """rep (the id as text), text with the key of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            keys = [np.uint64(xxh64_intdigest(x.tobytes())).astype(np.int64) for x in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], names=["rep", "text", "key"])
        release_worker()

    return texts.select("rep", "text").mapInArrow(run, "rep string, text string, key long")


def drop_near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE, list_cost: float = LIST_COST
) -> DataFrame:
    """One row of each component stays: that of the smallest id, null last (then the smallest hash of all
    its columns, maps as JSON); rows whose text has no words stay all. Rows with a null id or one that occurs again
    are documents of their own. Columns of docs."""
    require(docs, doc_id, text)
    columns = [F.col(c) for c in docs.columns]
    row = F.xxhash64(*hashable(docs))
    # The row in one column: no name of docs can clash with those used here.
    packed = docs.select(F.struct(*columns).alias("doc"), F.col(doc_id).cast("long").alias("did"), F.col(text).alias("text"), row.alias("row"))
    sets, ids = _classes(packed.select("did", "text", "row"), percent, size, list_cost)
    least = F.min(F.struct(F.col("did").isNull().alias("none"), "did", "row")).alias("least")
    firsts = sets.where("key is not null").groupBy("key").agg(least).join(ids.select("key", "component"), "key")
    keep = firsts.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.did").alias("kept_did"), F.col("least.row").alias("kept_row"))

    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = packed.where(~wordless).join(keep, F.col("did").eqNullSafe(F.col("kept_did")) & (F.col("row") == F.col("kept_row")), "left_semi")
    same = Window.partitionBy("did", "row").orderBy("row")  # rows equal in all columns
    once = kept.withColumn("nth", F.row_number().over(same)).where("nth = 1")
    return once.select("doc").unionByName(packed.where(wordless).select("doc")).select("doc.*")
