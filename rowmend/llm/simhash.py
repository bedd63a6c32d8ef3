"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2h bits exactly when some variant lies within h bits of
both. So every fingerprint emits all its variants within h = radius // 2 bits, variants are
shuffled, and whatever collides on a variant is linked. (An odd radius adds a last check of
pairs one bit further apart; only even radii are offered here.)

Emitting 2081 rows per fingerprint would shuffle far more than the texts. The variants are
therefore dealt out by their leading bits, which takes a few dozen rows per fingerprint, and
spelt out inside the task that owns the leading bits. Leading bits that too many fingerprints
share are not given to one task: their variants are spelt out as rows and pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmend.llm.common import ascii_words, map_batches, pick
from rowmend.llm.components import connected, folder_of
from rowmend.operators.windows import Running, running_columns
from rowmend.sources.workspace import remove, written

BITS = 64
SEED = 42
# Fingerprints dealt to leading bits: wanted on average, and the most for one task.
MEAN_ROWS, MOST_ROWS = 4096, 1 << 15
# Variants held at once in a task.
HELD_VARIANTS = 1 << 22
BLOCK = 1 << 16
# Copies share this much of their shingles of so many words.
COPY_WIDTH, COPY_SHARE = 5, 0.8
# Members and characters of a group that one task settles; of larger groups so many of the first members a round.
GROUP_ROWS, GROUP_CHARS = 1024, 8 << 20


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of `width` words joined by spaces, in blocks; fewer words are one run."""
    text = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[width - 1:] if len(words) >= width else ends[-1:]
    first = starts[:len(last)]
    for at in range(0, len(last), BLOCK):
        runs = map(slice, first[at:at + BLOCK].tolist(), last[at:at + BLOCK].tolist())
        hashes = map(xxhash.xxh64_intdigest, map(text.__getitem__, runs), repeat(SEED))
        yield np.fromiter(hashes, np.uint64, min(BLOCK, len(last) - at))


def simhash(text: str | None, width: int) -> int:
    """Signed 64-bit fingerprint; 0 for a text without words."""
    words = ascii_words(text)
    if not words:
        return 0
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(words, width):
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
        # Byte-wide partial sums of up to 255 rows add fast and cannot overflow.
        part = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8)
        ones += part.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fingerprint) per row; null and empty texts have fingerprint 0."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [simhash(text.as_py(), width) for text in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["id", "fingerprint"])

    rows = pick(df, id=id_col, text=text_col)
    return map_batches(rows, run, f"id {dict(rows.dtypes)['id']}, fingerprint long")


def masks(bits: int, most: int) -> list[int]:
    """All numbers of `bits` bits with at most `most` ones."""
    return [sum(1 << b for b in chosen) for n in range(most + 1) for chosen in combinations(range(bits), n)]


def leading_bits(count: int, half: int) -> int:
    """How many leading bits deal out the variants, so that a task has some thousand rows."""
    bits = max(1, half)
    while bits < 32 and count * len(masks(bits, half)) > MEAN_ROWS << bits:
        bits += 1
    return bits


def spelt_out(values: np.ndarray, prefix: int, bits: int, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(variant, fingerprint index) of all variants with the given leading bits."""
    lower = BITS - bits
    distance = np.bitwise_count((values >> np.uint64(lower)) ^ np.uint64(prefix)).astype(np.int64)
    tail = np.uint64((1 << lower) - 1)
    for away in range(half + 1):
        index = np.flatnonzero(distance == away)
        steps = np.array(masks(lower, half - away), np.uint64)
        rows = max(1, HELD_VARIANTS // len(steps))
        for at in range(0, len(index), rows):
            chosen = index[at:at + rows]
            yield ((values[chosen] & tail)[:, None] ^ steps).ravel(), np.repeat(chosen, len(steps))


def sifted(variants: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Which variants belong to one of several equal shares."""
    mixed = (variants * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return mixed % np.uint64(parts) == np.uint64(part)


def collisions(values: np.ndarray, prefix: int, bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of a repeated variant, fingerprint index) for all variants met by two fingerprints."""
    total = sum(len(v) for v, _ in spelt_out(values, prefix, bits, half))
    parts = -(-total // HELD_VARIANTS)
    found, known = [], 0
    for part in range(parts):
        held = [(v, i) for v, i in spelt_out(values, prefix, bits, half)]
        if parts > 1:
            held = [(v[k], i[k]) for v, i in held for k in [sifted(v, part, parts)]]
        variants = np.concatenate([v for v, _ in held])
        order = np.sort(variants)
        repeated = np.unique(order[1:][order[1:] == order[:-1]])
        if not len(repeated):
            continue
        # A small table of hashed bits discards nearly all variants before the exact search.
        spread = lambda v: (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        seen = np.zeros(1 << 20, bool)
        seen[spread(repeated)] = True
        index = np.concatenate([i for _, i in held])
        maybe = np.flatnonzero(seen[spread(variants)])
        place = np.searchsorted(repeated, variants[maybe])
        exact = repeated[np.minimum(place, len(repeated) - 1)] == variants[maybe]
        found.append((place[exact] + known, index[maybe[exact]]))
        known += len(repeated)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([v for v, _ in found]), np.concatenate([i for _, i in found])


def local_roots(variant: np.ndarray, index: np.ndarray, count: int) -> np.ndarray:
    """Smallest index each index reaches over shared variants."""
    root = np.arange(count)
    while len(variant):
        least = np.full(variant.max() + 1, count)
        np.minimum.at(least, variant, root[index])
        following = root.copy()
        np.minimum.at(following, index, least[variant])
        following = following[following]
        if (following == root).all():
            break
        root = following
    return root


def link_bucket(table: pa.Table, bits: int, half: int) -> pa.Table:
    """Links of one bucket as stars around the smallest fingerprint of each local group."""
    values = np.unique(table.column("fingerprint").to_numpy()).view(np.uint64)
    prefix = table.column("prefix")[0].as_py()
    root = local_roots(*collisions(values, prefix, bits, half), len(values))
    moved = np.flatnonzero(root != np.arange(len(values)))
    ends = values.view(np.int64)
    return pa.table({"a": ends[moved], "b": ends[root[moved]]})


def long_array(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v if v < 1 << 63 else v - (1 << 64)}L" for v in values) + ")")


def ball_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect all fingerprints at most `radius` bits apart, and no others."""
    half = radius // 2
    bits = leading_bits(distinct.count(), half)
    prefix = F.shiftrightunsigned("fingerprint", BITS - bits)
    dealt = distinct.select(
        "fingerprint", F.explode(F.transform(long_array(masks(bits, half)), lambda m: prefix.bitwiseXOR(m))).alias("prefix"))
    crowded = dealt.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > MOST_ROWS).select("prefix")
    crowded = written(crowded, "crowded")
    small = dealt.join(crowded, "prefix", "left_anti").groupBy("prefix").applyInArrow(
        lambda table: link_bucket(table, bits, half), "a long, b long")

    # Crowded leading bits: every variant is a row, and the smallest fingerprint is pre-aggregated.
    whole = F.transform(long_array(masks(BITS, half)), lambda m: F.col("fingerprint").bitwiseXOR(m))
    owners = distinct.select("fingerprint", F.explode(whole).alias("variant")).withColumn(
        "prefix", F.shiftrightunsigned("variant", BITS - bits)).join(crowded, "prefix", "left_semi")
    least = owners.groupBy("variant").agg(F.min("fingerprint").alias("b"), F.count("*").alias("n")).where("n > 1")
    large = owners.join(least, "variant").select(F.col("fingerprint").alias("a"), "b").where("a != b")
    if crowded.isEmpty():
        return small
    return small.unionByName(large)


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                   radius: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) per row: groups linked by fingerprints at most `radius` bits apart.

    component_id is the smallest id reachable. Equal fingerprints are one node, so copies cost
    nothing but their row. Null and empty texts have fingerprint 0 and link with each other
    like any others. A row with a null id keeps its row and joins its group, but cannot name
    it unless no row of the group has an id. Repeated rows are all returned. An empty table
    gives an empty result. Other columns are not read.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even")
    marked = written(fingerprints(df, id_col, text_col, width), "fingerprints")
    nodes = written(marked.groupBy("fingerprint").agg(F.min("id").alias("least")), "nodes")
    roots = connected(ball_links(nodes.select("fingerprint"), radius)).select(
        F.col("node").alias("fingerprint"), "root")
    rooted = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named_nodes = rooted.select("fingerprint", "root").join(groups, "root").select("fingerprint", "component_id")
    return marked.join(named_nodes, "fingerprint").select("id", "fingerprint", "component_id")


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of COPY_WIDTH words."""
    words = ascii_words(text)
    return np.unique(np.concatenate(list(shingle_hashes(words, COPY_WIDTH)))) if words else np.empty(0, np.uint64)


class ShingleIndex:
    """Shingle sets by shingle, to compare one set with all of them at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(own) for own in sets], np.int64)
        shingles = np.concatenate([np.empty(0, np.uint64), *sets])
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.rows = shingles[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def copies_of(self, own: np.ndarray) -> np.ndarray:
        """Which sets have a Jaccard similarity of COPY_SHARE with this one; two empty ones have."""
        first, last = (np.searchsorted(self.shingles, own, side) for side in ("left", "right"))
        held = first < last
        rows = [self.rows[a:b] for a, b in zip(first[held].tolist(), last[held].tolist())]
        common = np.bincount(np.concatenate([np.empty(0, np.int64), *rows]), minlength=len(self.sizes))
        return common >= COPY_SHARE * (self.sizes + len(own) - common)


def staying(sets: list[np.ndarray]) -> np.ndarray:
    """Which sets stay when each in turn, unless gone, takes away all later copies of it."""
    index, stays = ShingleIndex(sets), np.ones(len(sets), bool)
    for at, own in enumerate(sets):
        if stays[at]:
            stays[at + 1:] &= ~index.copies_of(own)[at + 1:]
    return stays


def copies_in_group(table: pa.Table) -> pa.Table:
    """Keys of the rows that are copies of an earlier row that stays."""
    rows = sorted(table.select(["rank", "key", "text"]).to_pylist(), key=lambda r: (*r["rank"].values(), r["key"]))
    stays = staying([shingle_set(row["text"]) for row in rows])
    return pa.table({"key": pa.array([row["key"] for row, stay in zip(rows, stays) if not stay], pa.string())})


def sets_of(table: pa.Table) -> list[np.ndarray]:
    """The column of shingles as sets."""
    column = table.column("shingles").combine_chunks()
    ends = np.cumsum([0, *column.value_lengths().to_pylist()])
    flat = column.flatten().to_numpy().view(np.uint64)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def settled(table: pa.Table) -> pa.Table:
    """(component, key, shingles) of the first members of a group; those that go have no shingles."""
    table = table.sort_by("upto")
    gone = pa.array(~staying(sets_of(table)))
    column = table.column("shingles").combine_chunks()
    kept = pc.if_else(gone, pa.scalar(None, column.type), column)
    return table.select(["component", "key"]).append_column("shingles", kept)


def copies_of_kept(members: pa.Table, kept: pa.Table) -> pa.Table:
    """Keys of the members that are copies of a row that was settled to stay."""
    index = ShingleIndex(sets_of(members))
    gone = np.zeros(members.num_rows, bool)
    for own in sets_of(kept):
        gone |= index.copies_of(own)
    return pa.table({"key": members.column("key").filter(pa.array(gone))})


def shingled(members: DataFrame) -> DataFrame:
    """(component, rank, key, weight, shingles): weight is what a row costs a task, GROUP_CHARS at most in a round."""
    kinds = dict(members.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(3).to_pylist()
        weight = pa.array([len(text or "") + GROUP_CHARS // (2 * GROUP_ROWS) for text in texts], pa.int64())
        sets = pa.array([shingle_set(text).view(np.int64) for text in texts], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], weight, sets], ["component", "rank", "key", "weight", "shingles"])

    return map_batches(members.select("component", "rank", "key", "text"), run, ", ".join(
        [*(f"{c} {kinds[c]}" for c in ("component", "rank", "key")), "weight long, shingles array<long>"]))


def verified_copies(members: DataFrame) -> DataFrame:
    """(key) of the rows of (component, rank, key, text) that are copies of a row that stays.

    `key` is a string that names a row; `rank` is a struct without nulls in its first field
    whose smallest is kept. The first row of a component stays and its verified copies go;
    then the first of the others, until every pair of rows that stay was compared or is
    apart. So nothing goes that is not a copy of something kept, however components chain.

    A task settles a component of up to GROUP_ROWS members. Of larger ones it settles the first
    members, as many as it can hold; the others are dealt to tasks in blocks of their order, and
    lose the copies of those that stay. So a component takes as many rounds as it has such parts,
    not members, and shingles are made once.
    """
    sizes = written(members.groupBy("component").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).where("n > 1"), "sizes")
    fits = (F.col("n") <= GROUP_ROWS) & (F.coalesce("chars", F.lit(0)) <= GROUP_CHARS)
    small = members.join(sizes.where(fits).select("component"), "component", "left_semi")
    found = [written(small.groupBy("component").applyInArrow(copies_in_group, "key string"), "copies")]
    large = sizes.where(~fits).select("component")
    if large.isEmpty():
        return found[0]
    sets = written(shingled(members.join(large, "component", "left_semi")), "shingles")
    ordered = running_columns(sets.drop("shingles"), ["component"], ["rank", "key"], {"upto": Running("sum", "weight")})
    block = F.expr(f"(upto - weight) DIV {GROUP_CHARS // 2}")
    left = written(ordered.select("key", "upto", block.alias("block")).join(sets.drop("rank"), "key"), "left")
    while True:
        # One row a block of some megabytes.
        blocks = left.groupBy("component", "block").agg(F.sum("weight").alias("held"))
        before = Window.partitionBy("component").orderBy("block")
        turn = blocks.withColumns({"upto": F.sum("held").over(before), "first": F.row_number().over(before) == 1})
        turn = written(turn.withColumn("now", F.col("first") | (F.col("upto") <= GROUP_CHARS)), "turns")
        if turn.isEmpty():
            break
        now = left.join(turn.where("now").select("component", "block"), ["component", "block"], "left_semi")
        done = written(now.groupBy("component").applyInArrow(
            settled, f"component {dict(left.dtypes)['component']}, key string, shingles array<long>"), "settled")
        found.append(done.where("shingles IS NULL").select("key"))
        later = turn.where("NOT now").select("component", "block")
        rest = left.join(later, ["component", "block"], "left_semi")
        kept = done.where("shingles IS NOT NULL").join(later, "component").select("component", "block", "shingles")
        gone = written(rest.groupBy("component", "block").cogroup(kept.groupBy("component", "block")).applyInArrow(
            copies_of_kept, "key string"), "copies")
        found.append(gone)
        following = written(rest.join(gone, "key", "left_anti").select(left.columns), "left")
        remove(left.sparkSession, folder_of(left))
        left = following
    return reduce(DataFrame.unionByName, found)
