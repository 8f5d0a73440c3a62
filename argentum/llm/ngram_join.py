"""Exact Jaccard self-join of word shingles up to connected components, with set relations.

A document's set is its distinct shingles of `width` words (one shingle if it has fewer words); two
sets link if 100 * common >= `percent` * united. Sets that
are equal are one. Sets are ordered by one global order of shingles, in which very common ones
come last; two sets that link share a few shingles among the first of both (their prefixes).

1. The index: prefix entries (shingle, set, size, position) are dealt by shingle. Lists of one
   set are dropped.
2. Every set follows the least set that it shares enough prefix entries with. Sets that may link
   but follow different leaders are found from blocks of the lists: by band of sizes and leader a block
   has its bounds of sizes and positions, and it is skipped whole for a set that can't reach
   the threshold within them. Leaders that sets connect to the weightiest one of a list become one
   first, so that few are left to meet each other; a list has one row at most for a set and
   another leader, never one for a pair of sets.
3. Sets that followers and such links connect are compared in one place, where their shingles are
   brought once; a place that is too large for a task is compared by pairs of parts.
4. There, answers are derived incrementally: each set is kept as its difference from the most
   central one. Linked to that, the answers of any two sets that share no difference follow.
   Only sets that don't link to it look up others, through lists of shared differences.

Common shingles are looked for in a sample; they change how work is dealt, never the result.

Null and empty texts have an empty set, which links with nothing. Repeated rows and copies are
linked. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.llm.components import connected
from argentum.llm.words import LOWER, SPACED, Words, distinct, flat, map_blocks, mix, ranges
from argentum.session import broadcast_if_small, stage, unstage

#: Words of a shingle and percent of similarity: of the join's contract, and of near duplicates in a corpus.
WIDTH, PERCENT = 4, 85
NEAR_WIDTH, NEAR_PERCENT = 5, 80
#: Documents looked at for common shingles: one in so many, and in how many of them a shingle is common.
SAMPLE, COMMON = 32, 3
MOST_COMMON = 500_000
#: Shingles of the sets that are compared at once; larger places are compared by pairs of parts.
GROUP = 2_000_000


def enough(common, size_a, size_b, percent: int = PERCENT):
    """Whether sets with so many common shingles link."""
    return 100 * common >= percent * (size_a + size_b - common)


def needed(size_a, size_b, percent: int = PERCENT):
    """Common shingles that two sets need to link."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def shared(size):
    """Prefix entries that a set shares with any set of its size or more that it links to; prefixes are longer by as many."""
    return 3 + size // 25


def shingles(texts: pa.Array, last: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, each text's in the global order, and how many each text has."""
    data, offsets = flat(texts)
    words = Words(LOWER[data], offsets, SPACED)
    prints = words.fingerprints()
    starts, values = words.windows(prints, width)
    owner = words.text[starts]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        whole = []
        for t in short.tolist():
            joint = 0
            for p in prints[words.first[t] : words.first[t + 1]].tolist():
                joint = (joint * 0x9E3779B97F4A7C15 + p + 1) & (2**64 - 1)
            whole.append(joint ^ (int(words.counts[t]) << 60))
        values = np.concatenate([values, mix(np.array(whole, np.uint64))])
        owner = np.concatenate([owner, short])
    values = values >> np.uint64(1)
    if len(last):
        at = np.minimum(np.searchsorted(last, values), len(last) - 1)
        values |= np.where(last[at] == values, np.uint64(1) << np.uint64(63), np.uint64(0))
    order = np.argsort(values)
    order = order[np.argsort(owner[order], kind="stable")]
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.bincount(owner, minlength=len(words.counts))


def signatures(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set; 0 for empty sets."""
    total = np.append(np.uint64(0), np.cumsum(mix(values + np.uint64(0x5851F42D4C957F2D))))
    ends = np.cumsum(sizes)
    names = mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)) >> np.uint64(1)
    return np.where(sizes > 0, names, 0).astype(np.int64)


def common_shingles(docs: DataFrame, text: str, width: int = WIDTH) -> np.ndarray:
    """Shingles that are common in a sample of the documents, sorted; at most MOST_COMMON."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in parts:
            values, _ = shingles(block.column(0), np.zeros(0, np.uint64), width)
            values, n = np.unique(values, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["value", "n"])

    sample = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0)
    found = map_blocks(sample, count, "value long, n long", text).groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    rows = found.orderBy(F.desc("n"), "value").limit(MOST_COMMON).collect()
    return np.sort(np.array([r["value"] for r in rows], np.int64).view(np.uint64))


def _prefixes(last, kind: str, width: int, percent: int):
    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets whose prefix this task has given already
        for block in parts:
            values, sizes = shingles(block.column(1), last.value, width)
            names = signatures(values, sizes)
            wanted = np.minimum(sizes, sizes - needed_alone(sizes, percent) + shared(sizes))
            first, back = distinct(names)
            new = np.zeros(len(names), bool)
            new[first] = [x not in seen for x in names[first].tolist()]
            new &= sizes > 0
            if len(seen) > 1_000_000:
                seen = set()
            seen.update(names[new].tolist())
            wanted = np.where(new, wanted, 0)
            entries = values[ranges(np.cumsum(sizes) - sizes, wanted)].view(np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(wanted)), pa.int32()), pa.array(entries))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array(names), pa.array(sizes), prefix], names=["doc", "th", "sid", "n", "prefix"])

    return make, f"doc {kind}, th long, sid long, n long, prefix array<bigint>"


def needed_alone(size, percent: int = PERCENT):
    """The least number of common shingles with which a set of this size links to any set."""
    return -(-percent * size // 100)


def _reach(n, pos, other_n, other_pos):
    """The most shingles that two sets can share if they share the ones at these positions."""
    return np.minimum(pos, other_pos) + np.minimum(n - pos, other_n - other_pos)


def _lists(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Entries sorted by shingle and set: those of lists with two sets or more, each with its list's first set,
    or with its own if sizes and positions rule out that it links with the first.

    One entry is carried from batch to batch.
    """
    held = None  # the lone first entry of the list that is open
    open_token = last_sid = None
    open_first = np.zeros((3, 1), np.int64)  # set, size and position of the first entry
    for batch in batches:
        if not batch.num_rows:
            continue
        token, sid, n, pos = (batch.column(k).to_numpy() for k in range(4))
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
        keep[0] = open_token is None or token[0] != open_token or sid[0] != last_sid
        token, sid, n, pos = token[keep], sid[keep], n[keep], pos[keep]
        if not len(token):
            continue
        if held is not None:
            token, sid, n, pos = (np.append(h, x) for h, x in zip(held, (token, sid, n, pos), strict=True))
            open_token = None
        fresh = np.append(open_token is None or token[0] != open_token, token[1:] != token[:-1])
        starts = np.flatnonzero(fresh)
        run = np.cumsum(fresh)  # 0: the list that was open
        first, first_n, first_pos = (np.append(old, x[starts])[run].astype(np.int64) for old, x in zip(open_first, (sid, n, pos), strict=True))
        lone = fresh & np.append(fresh[1:], True)
        last_lone = bool(lone[-1])
        open_token, open_first, last_sid = token[-1], np.array([first[-1:], first_n[-1:], first_pos[-1:]]), sid[-1]
        held = (token[-1:], sid[-1:], n[-1:], pos[-1:]) if last_lone else None
        first = np.where(_reach(n, pos, first_n, first_pos) >= needed(n, first_n, percent), first, sid)
        out = ~lone
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (sid, first, token, n, pos)], names=["sid", "first", "token", "n", "pos"])


def _compare(members: list[tuple[int, np.ndarray]], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between sets, as many as their components need."""
    if len(members) < 2:
        return []
    names = [x for x, _ in members]
    sizes = np.array([len(x) for _, x in members])
    tokens = np.concatenate([x for _, x in members])
    owner = np.repeat(np.arange(len(members)), sizes)
    _, token = np.unique(tokens, return_inverse=True)
    # the most central set: its shingles are the commonest among the members
    often = np.bincount(token)
    weight = np.add.reduceat(often[token], np.cumsum(sizes) - sizes)
    centre = int(np.argmax(2 * weight / sizes - np.bincount(owner, minlength=len(sizes)) * 1e-9))
    in_centre = np.zeros(len(often), bool)
    in_centre[token[owner == centre]] = True
    has = in_centre[token]
    common = np.bincount(owner, weights=has, minlength=len(sizes)).astype(np.int64)
    linked = enough(common, sizes, sizes[centre], percent)
    links = [(names[centre], names[i]) for i in np.flatnonzero(linked) if i != centre]
    if linked.all():
        return links
    group = np.where(linked, -1, np.arange(len(sizes)))  # sets known to be together needn't be asked again

    def join(i: int, ok: np.ndarray) -> None:
        joined, once = np.unique(group[ok], return_index=True)
        links.extend((names[i], names[j]) for j in np.flatnonzero(ok)[once].tolist() if group[j] != group[i])
        group[np.isin(group, joined)] = group[i]

    near = 2 * common >= np.maximum(sizes, sizes[centre])
    # far from the centre: whole sets are looked up
    far = np.flatnonzero(~near)
    if len(far):
        lists, at, mine, at_mine = _postings(token, owner, len(often), len(sizes))
        for i in far.tolist():
            keys = mine[at_mine[i] : at_mine[i + 1]]
            both = np.bincount(lists[ranges(at[keys], at[keys + 1] - at[keys])], minlength=len(sizes))
            ok = enough(both, sizes[i], sizes, percent)
            ok[i] = False
            join(i, ok)
    # near it: only differences are, shingles that the centre lacks and those of it that a set lacks
    centre_tokens = np.flatnonzero(in_centre)
    slot = np.cumsum(near) - 1
    present = np.zeros((int(near.sum()), len(centre_tokens)), bool)
    of_near = near[owner]
    present[slot[owner[has & of_near]], np.searchsorted(centre_tokens, token[has & of_near])] = True
    less_slot, less = np.nonzero(~present)
    key = np.concatenate([token[~has & of_near], len(often) + less])
    of = np.concatenate([owner[~has & of_near], np.flatnonzero(near)[less_slot]])
    lists, at, mine, at_mine = _postings(key, of, len(often) + len(centre_tokens), len(sizes))
    lacking = sizes[centre] - common
    for i in np.flatnonzero(near & ~linked).tolist():
        keys = mine[at_mine[i] : at_mine[i + 1]]
        shared = np.bincount(lists[ranges(at[keys], at[keys + 1] - at[keys])], minlength=len(sizes))
        # common to both: the centre without what either lacks (what both lack counts once), and what both have besides
        ok = near & (shared > 0) & enough(sizes[centre] - lacking[i] - lacking + shared, sizes[i], sizes, percent)
        ok[i] = False
        join(i, ok)
    return links


def _postings(key: np.ndarray, of: np.ndarray, n_keys: int, n_sets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sets by key with their offsets, and keys by set with theirs."""
    by_key, by_set = np.argsort(key, kind="stable"), np.argsort(of, kind="stable")
    return of[by_key], np.searchsorted(key[by_key], np.arange(n_keys + 1)), key[by_set], np.searchsorted(of[by_set], np.arange(n_sets + 1))


def _groups(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (place, part, part): links inside each group."""
    key, members = None, []

    def links() -> pa.RecordBatch:
        found = _compare(members, percent)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        for place, one, two, sid, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is not None and (place, one, two) != key:
                yield links()
                members = []
            key = (place, one, two)
            if not members or members[-1][0] != sid:
                members.append((sid, np.frombuffer(raw, np.uint64)))
    if members:
        yield links()


def _band(n, percent: int):
    """Sets that link are of one band of sizes or of two that follow one another; bands are a little wide, against rounding."""
    return F.floor(0.999 * F.log(n.cast("double")) / F.log(F.lit(100 / percent))).cast("int")


def _blocks(entries: DataFrame) -> DataFrame:
    """Index lists cut into blocks: by (shingle, band, leader) the bounds of sizes and positions of the sets that may link to a set of the band."""
    spread = entries.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    bounds = [F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("pos").alias("most_pos"), F.max(F.col("n") - F.col("pos")).alias("most_rest")]
    return spread.groupBy("token", "band", "leader").agg(F.first("weight").alias("weight"), *bounds)


def _met(entries: DataFrame, blocks: DataFrame, ahead, percent: int) -> DataFrame:
    """(a, leader of a, b): sets and the leaders that they share enough lists with, by the bounds of blocks.

    A block is skipped if no set within its bounds of size and position can reach the threshold, so
    a set has at most one row for each other leader of a list. What is counted is at least
    what the set shares with any one follower of the leader.
    """
    x, y = entries.alias("x"), blocks.alias("y")
    n, least_n = F.col("x.n"), F.greatest(F.col("y.least_n"), F.ceil(F.col("x.n") * F.lit(percent) / 100).cast("int"))
    lowest = F.ceil((n + least_n) * F.lit(percent) / (100 + percent)).cast("int")
    reach = F.least(F.col("x.pos"), F.col("y.most_pos")) + F.least(n - F.col("x.pos"), F.col("y.most_rest"))
    fits = (least_n <= F.col("y.most_n")) & (F.col("y.least_n") * percent <= n * 100) & (reach >= lowest)
    least = F.least(3 + F.floor(F.least(n, least_n) / 25), lowest)
    rows = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.leader") != F.col("y.leader")) & ahead & fits)
    met = rows.select(F.col("x.sid").alias("a"), F.col("x.leader").alias("own"), F.col("y.leader").alias("b"), least.alias("least"))
    return met.groupBy("a", "own", "b").agg(F.count("*").alias("n"), F.min("least").alias("least")).where("n >= least").select("a", "own", "b")


def _pairs(whole: DataFrame, leaders: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) that bring together all sets that may link but follow different leaders, and the tables staged for them.

    First, sets meet only the weightiest leader of each list, and a leader whose sets so connect to a
    weightier one takes its name; then the few names that are left in a list meet one another,
    the lighter the weightier.
    """
    weight = leaders.groupBy("leader").agg(F.count("*").alias("weight")).where("weight > 1")
    entries = whole.join(broadcast_if_small(weight), "leader", "left").select("token", "sid", "n", "pos", "leader", F.coalesce("weight", F.lit(1)).alias("weight"), _band(F.col("n"), percent).alias("band"))
    entries = stage(_mixed(entries), "mixed")
    fields = ["weight", "leader", "least_n", "most_n", "most_pos", "most_rest"]
    top = _blocks(entries).groupBy("token", "band").agg(F.max(F.struct(*fields)).alias("top")).select("token", "band", "top.*")
    lighter = F.struct("y.weight", "y.leader") > F.struct("x.weight", "x.leader")
    met = stage(_met(entries, top, lighter, percent).join(broadcast_if_small(weight).withColumnRenamed("leader", "b"), "b", "left").groupBy("own").agg(F.max(F.struct(F.coalesce("weight", F.lit(1)).alias("weight"), F.col("b").alias("leader"))).alias("to")), "met")
    # every name keeps its one weight, so that the order of leaders holds
    renamed = broadcast_if_small(met.select(F.col("own").alias("leader"), "to"))
    moved = entries.join(renamed, "leader", "left").select("token", "sid", "n", "pos", F.coalesce("to.leader", "leader").alias("leader"), F.coalesce("to.weight", "weight").alias("weight"), "band")
    fewer = stage(_mixed(moved), "mixed")
    pairs = stage(_met(fewer, _blocks(fewer), lighter, percent).select("a", "b"), "pairs")
    return pairs.unionByName(met.select(F.col("own").alias("a"), F.col("to.leader").alias("b"))), [entries, met, fewer, pairs]


def _mixed(entries: DataFrame) -> DataFrame:
    """Entries of the lists in which several leaders are left."""
    mixed = entries.groupBy("token").agg(F.min("leader").alias("low"), F.max("leader").alias("high")).where("low <> high").select("token")
    return entries.join(mixed, "token", "left_semi")


def _rooted(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """doc (the key), th (hash of the text), n (shingles) and root (one set of its class; 0 without shingles) per document row."""
    kind = docs.schema[key].dataType.simpleString()
    last = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text, width))
    make, schema = _prefixes(last, kind, width, percent)
    sets = stage(map_blocks(docs.select(key, text, F.xxhash64(text).alias("th")), make, schema, text), "sets")

    entries = sets.where("size(prefix) > 0").select("sid", "n", F.posexplode("prefix").alias("pos", "token"))
    entries = entries.select("token", "sid", F.col("n").cast("int").alias("n"), "pos").repartition("token").sortWithinPartitions("token", "sid")
    listed = stage(entries.mapInArrow(lambda rows: _lists(rows, percent), "sid long, first long, token long, n int, pos int"), "lists")

    # every set follows the least first set that it shares enough entries with
    votes = listed.groupBy("sid", "first").agg(F.count("*").alias("votes"), F.first("n").alias("n"))
    follows = votes.where(F.col("votes") >= F.least(3 + F.floor(F.col("n") / 25), F.ceil(F.col("n") * percent / 100)))
    leaders = stage(follows.groupBy("sid").agg(F.min("first").alias("leader"), F.first("n").alias("n")), "leaders")
    whole = stage(listed.join(leaders.drop("n"), "sid", "left").select("token", "sid", "n", "pos", F.coalesce("leader", "sid").alias("leader")), "led")
    unstage(listed)

    pairs, left = _pairs(whole, leaders, percent)

    # sets that may link, directly or by a chain, are compared in one place: they get their shingles once
    follows = leaders.where("sid <> leader").select(F.col("sid").alias("a"), F.col("leader").alias("b"))
    places = connected(follows.unionByName(pairs))
    for table in (leaders, whole, *left):
        unstage(table)
    # a row of the set is found by its key and its text's hash: keys may be null or repeat
    named = sets.groupBy("sid").agg(F.min("doc").alias("doc"), F.coalesce(F.min_by("th", "doc"), F.min("th")).alias("th"), F.first("n").alias("n"))
    wanted = places.join(named, F.col("node") == F.col("sid")).select("sid", "doc", "th", "n", F.col("root").alias("place"))
    parts = wanted.groupBy("place").agg(F.ceil(F.sum("n") / GROUP).cast("int").alias("parts"))
    wanted = broadcast_if_small(stage(wanted.join(parts, "place"), "wanted")).alias("w")

    def fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in parts:
            values, sizes = shingles(block.column(3), last.value, width)
            right = np.flatnonzero(signatures(values, sizes) == block.column(0).to_numpy())
            ends = np.cumsum(sizes)
            raw = [values[ends[i] - sizes[i] : ends[i]].tobytes() for i in right.tolist()]
            rows = block.take(pa.array(right))
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(raw, pa.binary())], names=["sid", "place", "parts", "shingles"])

    mine = F.col("t.doc").eqNullSafe(F.col("w.doc")) & (F.col("t.th") == F.col("w.th"))
    texts = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("body")).alias("t").join(wanted, mine).select("sid", "place", "parts", "body")
    contents = map_blocks(texts, fetch, "sid long, place long, parts int, shingles binary", "body")
    part = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    grouped = contents.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    grouped = grouped.select("place", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "sid", "shingles")
    grouped = grouped.repartition("place", "one", "two").sortWithinPartitions("place", "one", "two", "sid")

    roots = connected(grouped.mapInArrow(lambda rows: _groups(rows, percent), "a long, b long"))
    return sets.select("doc", "th", "sid", "n").join(roots, F.col("sid") == F.col("node"), "left").select("doc", "th", "n", F.coalesce("root", "sid").alias("root"))


def link_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Key, n_shingles and component_id (least key that links reach) per document row."""
    rooted = _rooted(docs, key, text, width, percent)
    least = rooted.where("n > 0").groupBy("root").agg(F.min("doc").alias("least"))
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc"))
    return rooted.join(least, "root", "left").select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = NEAR_WIDTH, percent: int = NEAR_PERCENT) -> DataFrame:
    """One row of each class of linked documents: one of the least key, null keys last.

    Documents without shingles are classes of their own; of them, rows that repeat a key and its
    text are one document, unless the key is null. Different texts under one key are different documents.
    """
    own = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("th"), own.alias("row"))
    rooted = _rooted(docs, key, text, width, percent)
    least = F.min(F.struct(F.col("doc").isNull().alias("no_doc"), "doc", "th")).alias("least")
    linked = rooted.where("n > 0").groupBy("root").agg(least).select(F.col("least.doc").alias("kept"), F.col("least.th").alias("kept_th"), F.lit(False).alias("single"))
    alone = rooted.where("n = 0").select("doc", "th", F.col("doc").isNull().alias("single")).distinct()
    same = F.col("doc").eqNullSafe(F.col("kept")) & (F.col("th") == F.col("kept_th"))
    found = rows.join(linked.unionByName(alone.select(F.col("doc").alias("kept"), F.col("th").alias("kept_th"), "single")), same)
    return found.withColumn("copy", F.when(F.col("single"), F.monotonically_increasing_id())).dropDuplicates(["doc", "th", "copy"]).select("row.*")
