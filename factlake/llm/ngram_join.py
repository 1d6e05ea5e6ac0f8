"""Exact Jaccard self-join on word n-grams by PartEnum signatures.

Sets whose sizes lie in one band are cut by a hash of their features into the same number of parts. Sets as similar as asked
differ in so few features that at least one part, or one subset of the parts, agrees; its hash is a signature that both emit.

* Small sets (fewer than 16 n-grams): all subsets of parts that leave out as many parts as features may differ.
* Larger ones: single parts, of more than may differ. All sets' parts are counted. A set whose parts nobody else has are more than
  features may differ has no partner. Of the others, a set needs its rarest parts only, ordered by count, then hash, and as many as
  features may differ and one more (those nobody has included): the first part in this order on which two similar sets agree is
  among these in both, as too few parts differ to push it out. So parts that many texts share by chance, such as those of a common
  passage, are left out without loss.

(In PartEnum's terms: as many first-level parts as features may differ and one more at least, and second-level subsets for small
sets only.) A set with so few parts that two linked ones could agree on empty parts alone has signatures of these, too.

Candidates are not paired within a group. Each signature's most central member, that has the fewest features of its own, is
compared to the others first; links join groups into components, and only members of different components go on. What a few such
turns leave is dealt into blocks of bounded size, where parities tell which pairs may be linked. Few such pairs are compared one by
one, many as products of matrices (sets by features), block by block.

Links are counted once the components are known: any two linked sets are in one, so each component's sets are compared in blocks, too.
Tables hold a row for each set and block, not for each pair. Counts by signature are aggregates that combine on the map side, joined
back to the rows, so that a signature of many sets isn't one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import Workspace, as_bytes, hash_words, mix, rolling, slices
from factlake.llm.components import components

WORDS = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Rounds of comparing with one member of each group before what remains is compared in blocks, unless that is fewer than REMAINING
#: pairs for each member anyway.
ROUNDS, REMAINING = 3, 8
#: Cells of the parity tables (a multiple of 64).
PARITY = 1024
#: How many times finer the parts of the sets that pass the first selection are.
FINE = 3
#: Sets and features of a block (on average), and features of one product of matrices.
BLOCK_SETS, BLOCK_FEATURES, PRODUCT = 512, 1 << 19, 1 << 12
#: Pairs for each set of a block up to which these are compared one by one.
SPARSE = 8


def shingle_sets(texts: list[bytes | None], n: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles: of all its words if they are fewer."""
    words, starts = hash_words(texts, fold=True)
    grams = rolling(words, n)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            with np.errstate(over="ignore"):
                yield mix(rolling(words[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def differing(a: int, b: int, percent: int = PERCENT) -> int:
    """In how many features two linked sets of these sizes can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


class Bands:
    """Parts and signatures for each size. Bands are octaves of the set size; a set near the end of one is in the next, too."""

    def __init__(self, percent: int = PERCENT, fine: int = 0):
        """fine: how many times as many parts more as features may differ; else a quarter of that number more."""
        self.percent, self.fine = percent, fine
        self.of: dict[int, list[tuple[int, int, int]]] = {}

    def scheme(self, size: int) -> list[tuple[int, int, int]]:
        """(band, parts, features that may differ) for each band in which a set of this size looks for others."""
        if size not in self.of:
            own = size.bit_length() - 1
            out = []
            for band in (own, own + 1):
                low, high = 1 << band, (2 << band) - 1
                if band == own or 100 * size >= self.percent * low:  # else no set of the next band is similar enough
                    most = differing(high, high, self.percent)
                    partner = min(high, 100 * size // self.percent)
                    out.append((band, most + 2 if band < 4 else most + 1 + (self.fine * most or most // 4), most if band < 4 else differing(size, partner, self.percent)))
            self.of[size] = out
        return self.of[size]

    def spare(self, features: np.ndarray) -> list[int]:
        """For the set's own band and the next (0 if it is not in that): how many parts it needs beyond those that it has. With
        the number of its parts that others have, too, that makes the number of the rarest of them that it must look at."""
        out = [0, 0]
        for i, (band, parts, differ) in enumerate(self.scheme(len(features)) if len(features) else []):
            if band >= 4:
                filled = int(np.count_nonzero(np.bincount((features % np.uint64(parts)).astype(np.int64), minlength=parts)))
                out[i] = differ + 1 - (filled if filled > differ else parts)
        return out

    def signatures(self, features: np.ndarray) -> np.ndarray:
        """The band is in the last six bits of a signature."""
        if not len(features):
            return np.empty(0, np.uint64)
        out = []
        second = mix(features ^ np.uint64(0x5851F42D4C957F2D))
        for band, parts, differ in self.scheme(len(features)):
            which = (features % np.uint64(parts)).astype(np.int64)
            counts = np.bincount(which, minlength=parts)
            with np.errstate(over="ignore"):
                sums = np.zeros(parts, np.uint64)
                np.add.at(sums, which, second)
                if band < 4:
                    subsets = list(combinations(range(parts), parts - differ))
                    sums = np.array([sums[list(s)].sum(dtype=np.uint64) for s in subsets], np.uint64)
                    names = np.arange(len(subsets), dtype=np.uint64)
                else:
                    filled = np.flatnonzero(counts)
                    # All sets agree on empty parts, so these count only where they may be all that two linked sets agree on.
                    names = (filled if len(filled) > differ else np.arange(parts)).astype(np.uint64)
                    sums = sums[names]
                out.append((mix(sums + mix(names + np.uint64((band + 1) << 40))) & ~np.uint64(63)) | np.uint64(band))
        return np.concatenate(out)


def _prepare(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc"), as_bytes(text).alias("text"), F.xxhash64(text).alias("tag")).filter("doc is not null")


def shingle_counts(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc, tag (as given), n (distinct shingles), first (a row of this partition with the same set: the first), h1, h2 (the set's hash,
    128 bits), spare0, spare1 (see Bands.spare)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bands = {}, Bands(percent)
        for part in slices(batches):
            ids = part.column(0).to_pylist()
            sizes, firsts, h1, h2, spare = [], [], [], [], []
            for i, s in zip(ids, shingle_sets(part.column(1).to_pylist(), n), strict=True):
                with np.errstate(over="ignore"):
                    k = (int(s.sum(dtype=np.uint64)), int(mix(s).sum(dtype=np.uint64)), len(s))
                sizes.append(len(s))
                firsts.append(seen.setdefault(k, i) if len(s) else i)
                h1.append(k[0])
                h2.append(k[1])
                spare.append(bands.spare(s) if firsts[-1] == i else (0, 0))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)), *(pa.array([x[i] for x in spare], pa.int32()) for i in (0, 1))], names=["doc", "tag", "n", "first", "h1", "h2", "spare0", "spare1"])

    return docs.mapInArrow(run, "doc long, tag long, n long, first long, h1 long, h2 long, spare0 int, spare1 int")


def signature_rows(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """signature, h1 (the set's first hash, as in shingle_counts), once for each set in a partition. No row's name is given, as this
    scan may be cut and ordered unlike that of shingle_counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for part in slices(batches):
            rows, owners = [], []
            for s in shingle_sets(part.column(1).to_pylist(), n):
                with np.errstate(over="ignore"):
                    k = int(s.sum(dtype=np.uint64))
                if len(s) and k not in seen:
                    seen.add(k)
                    rows.append(bands.signatures(s))
                    owners.append(k)
            if rows:
                own = np.repeat(np.array(owners, np.uint64).view(np.int64), [len(r) for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows).view(np.int64)), pa.array(own)], names=["signature", "h1"])

    return docs.mapInArrow(run, "signature long, h1 long")


def sets_of(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc, h1, h2 (as in shingle_counts) and features (its shingles' hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = list(shingle_sets(part.column(1).to_pylist(), n))
            ends = np.cumsum([0, *map(len, found)])
            with np.errstate(over="ignore"):
                h1, h2 = (np.array([f(s).sum(dtype=np.uint64) for s in found], np.uint64).view(np.int64) for f in (np.asarray, mix))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))], names=["doc", "h1", "h2", "features"])

    return docs.mapInArrow(run, "doc long, h1 long, h2 long, features array<long>")


def fine_rows(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """signature, rep, n, spare of sets (rep, features), cut into finer parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, FINE)
        for part in slices(batches):
            rows, owners, sizes, spare = [], [], [], []
            for i, f in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                f = np.sort(f.values.to_numpy().view(np.uint64))
                own = bands.signatures(f)
                first = (own & np.uint64(63)) == len(f).bit_length() - 1
                rows.append(own)
                owners.append(np.full(len(own), i))
                sizes.append(np.full(len(own), len(f)))
                spare.append(np.where(first, *bands.spare(f)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows).view(np.int64)), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (owners, sizes, spare))], names=["signature", "rep", "n", "spare"])

    return sets.mapInArrow(run, "signature long, rep long, n long, spare long")


def parities(sets: DataFrame) -> DataFrame:
    """rep and p0 .. p15: which of PARITY cells of a hash table hold an odd number of the set's features. Where two sets' cells are
    unlike, a feature differs; so the number of unlike cells is a bound that costs a few instructions a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            odd = np.zeros((part.num_rows, PARITY), np.uint8)
            for i, f in enumerate(part.column(1)):
                odd[i] = np.bincount((f.values.to_numpy().view(np.uint64) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
            words = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(words.shape[1]))], names=["rep", *(f"p{i}" for i in range(words.shape[1]))])

    return sets.mapInArrow(run, "rep long, " + ", ".join(f"p{i} long" for i in range(PARITY // 64)))


def block_hits(sizes: np.ndarray, features: np.ndarray, right: np.ndarray | None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the sets of two blocks, and which of their pairs are linked. right: which sets are the second block's; None: both are
    one block, whose sets are not linked with themselves."""
    a, b = (np.arange(len(sizes)),) * 2 if right is None else (np.flatnonzero(~right), np.flatnonzero(right))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, which, many = np.unique(features, return_inverse=True, return_counts=True)
    common = many > 1  # features of one set alone are in no intersection
    place = np.cumsum(common) - 1
    owner, which = owner[common[which]], place[which[common[which]]]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    both = np.zeros((len(a), len(b)), np.float32)
    total = int(common.sum())
    for start in range(0, total, PRODUCT):
        i, j = np.searchsorted(which, [start, start + PRODUCT])
        m = np.zeros((len(sizes), min(PRODUCT, total - start)), np.float32)
        m[owner[i:j], which[i:j] - start] = 1
        both += m[a] @ m[b].T  # whole numbers below 2^24, so exact
    both = both.astype(np.int64)
    hit = 100 * both >= percent * (sizes[a][:, None] + sizes[b][None, :] - both)
    if right is None:
        np.fill_diagonal(hit, False)
    return a, b, hit


def linked_weights(sizes: np.ndarray, features: np.ndarray, weights: np.ndarray, right: np.ndarray | None, percent: int = PERCENT) -> np.ndarray:
    """For each set the weight of the other sets that it links with; of those of the other block only, if there are two."""
    a, b, hit = block_hits(sizes, features, right, percent)
    out = np.zeros(len(sizes), np.int64)
    if right is None:
        out[:] = hit @ weights
    else:
        out[a], out[b] = hit @ weights[b], weights[a] @ hit
    return out


def joining_links(sizes: np.ndarray, features: np.ndarray, components_: np.ndarray, right: np.ndarray | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between sets of different components, as many as join these: fewer than there are sets."""
    a, b, hit = block_hits(sizes, features, right, percent)
    hit &= components_[a][:, None] != components_[b][None, :]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(hit), strict=True):
        x, y = find(int(components_[a[i]])), find(int(components_[b[j]]))
        if x != y:
            root[y] = x
            out.append((int(a[i]), int(b[j])))
    return out


def blocked(members: DataFrame, group: str, more: DataFrame) -> DataFrame:
    """Members (group, rep, n, ...) with the columns that `more` has for each rep, dealt into blocks: `lower` and `upper` are the two blocks
    that meet, `own` that of the row. Groups of one block share buckets (`bucket`); a larger one is spread by its pairs of blocks."""
    size = members.groupBy(group).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_FEATURES)).cast("int").alias("parts"), F.sum("n").alias("total"))
    buckets = int((size.agg(F.sum(F.when(F.col("parts") == 1, F.col("total")))).first()[0] or 0) // BLOCK_FEATURES + 1)
    dealt = members.join(size.drop("total"), group).selectExpr("*", "cast(pmod(xxhash64(rep), parts) as int) as own", f"if(parts = 1, pmod(xxhash64({group}), {buckets}), -1 - {group}) as bucket")
    dealt = dealt.selectExpr("*", "explode(sequence(0, parts - 1)) as other").selectExpr("*", "least(own, other) as lower", "greatest(own, other) as upper").drop("parts", "other")
    return dealt.join(more, "rep")


def _each_block(table: pa.Table, group: str) -> Iterator[tuple[pa.Table, np.ndarray | None]]:
    """The rows of each group of a bucket, and which of them are the second block's."""
    table = table.sort_by(group).combine_chunks()
    keys = table.column(group).to_numpy()
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    for i, j in zip(edge[:-1], edge[1:], strict=True):
        rows = table.slice(i, j - i)
        own, lower, upper = (rows.column(c).to_numpy() for c in ("own", "lower", "upper"))
        yield rows, own == upper if lower[0] != upper[0] else None


def _lists(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and features of the rows' sets."""
    lists = rows.column("features").combine_chunks()
    return np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy()


def with_partners(members: DataFrame, odd: DataFrame, percent: int = PERCENT) -> DataFrame:
    """What members (signature, rep, n, lone, component) may be linked with one of their signature and another component, as far as
    sizes, lone features and parities tell: signature, rep, n, component, other. Where a block has few such pairs, a row for each
    (rep, other); else a row for each member, without other. So there are no more than SPARSE rows for a member of a block."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for rows, right in _each_block(table, "signature"):
            n, lone, component = (rows.column(c).to_numpy() for c in ("n", "lone", "component"))
            words = [rows.column(f"p{i}").to_numpy() for i in range(PARITY // 64)]
            unlike = np.zeros((len(n), len(n)), np.int64)
            for w in words:
                unlike += np.bitwise_count(w[:, None] ^ w[None, :])
            both = n[:, None] + n[None, :]
            may = (component[:, None] != component[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
            may &= ((100 + percent) * (lone[:, None] + lone[None, :]) <= (100 - percent) * both) & ((100 + percent) * unlike <= (100 - percent) * both)
            may &= np.triu(np.ones_like(may)) if right is None else right[:, None] < right[None, :]
            rows = rows.select(["signature", "rep", "n", "component"])
            i, j = np.nonzero(may)
            if len(i) <= SPARSE * len(n):
                out.append(rows.take(pa.array(i)).append_column("other", rows.column("rep").take(pa.array(j))))
            else:
                rows = rows.filter(pa.array(may.any(0) | may.any(1)))
                out.append(rows.append_column("other", pa.nulls(len(rows), pa.int64())))
        return pa.concat_tables(out)

    return blocked(members, "signature", odd).groupBy("bucket", "lower", "upper").applyInArrow(run, "signature long, rep long, n long, component long, other long")


def count_links(work: Workspace, sets: DataFrame, where: DataFrame, copies: DataFrame, percent: int = PERCENT) -> DataFrame:
    """rep and n_others: rows of the other sets that each set (rep, features) links with. where: node and component of all that
    are not their component's smallest; copies: rep, n and copies (rows of its set)."""
    nodes = where.unionByName(where.select(F.col("component").alias("node"), "component").distinct())
    nodes = work.keep(nodes.withColumnRenamed("node", "rep").join(copies, "rep"))

    def run(table: pa.Table) -> pa.Table:
        reps, found = [], []
        for rows, right in _each_block(table, "component"):
            sizes, features = _lists(rows)
            reps.append(rows.column("rep").to_numpy())
            found.append(linked_weights(sizes, features, rows.column("copies").to_numpy(), right, percent))
        return pa.table({"rep": pa.array(np.concatenate(reps)), "n_others": pa.array(np.concatenate(found))})

    found = blocked(nodes, "component", sets).groupBy("bucket", "lower", "upper").applyInArrow(run, "rep long, n_others long")
    return work.keep(found.groupBy("rep").agg(F.sum("n_others").alias("n_others")))


def link_blocks(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: links of members (signature, rep, n, component) of one signature that join different components."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        for rows, right in _each_block(table, "signature"):
            sizes, features = _lists(rows)
            reps = rows.column("rep").to_numpy()
            out += [tuple(sorted((int(reps[i]), int(reps[j])))) for i, j in joining_links(sizes, features, rows.column("component").to_numpy(), right, percent)]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return blocked(members, "signature", sets).groupBy("bucket", "lower", "upper").applyInArrow(run, "a long, b long").distinct()


def _linked_rows(work: Workspace, docs: DataFrame, n: int, percent: int, key: str, text: str, count: bool = True) -> DataFrame:
    """doc, tag (a hash of the text), n, component_id and, if they are to be counted, n_links of each row with a key."""
    source = _prepare(docs, key, text)
    counted = work.keep(shingle_counts(source, n, percent))

    # Rows with one set are one: a number stands for it, as the same key may stand for several.
    firsts = counted.filter("n > 0").groupBy("first", "n", "h1", "h2").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("spare0").alias("spare0"), F.min("spare1").alias("spare1"))
    firsts = work.keep(firsts)
    rep = firsts.groupBy("n", "h1", "h2").agg(F.min("least").alias("least"), F.sum("copies").alias("copies"), F.min("spare0").alias("spare0"), F.min("spare1").alias("spare1"))
    rep = work.keep(rep.withColumn("rep", F.monotonically_increasing_id()))
    named = work.keep(firsts.select("first", "n", "h1", "h2").join(rep, ["n", "h1", "h2"]).select("first", "n", "h1", "h2", "rep", "least", "copies"))
    work.drop(firsts)

    # Members of signatures that more than one set has, and of these the rarest that each set needs. (Copies of a set in other
    # partitions count, too.)
    signed = work.keep(signature_rows(source, n, percent))
    many = work.keep(signed.groupBy("signature").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"))
    shared = work.keep(signed.join(many, "signature"))
    work.drop(signed, many)
    members = shared.distinct().join(rep.select("h1", "n", "rep", "spare0", "spare1"), "h1")
    band = "(signature & 63)"
    members = members.selectExpr("*", f"row_number() over (partition by rep, {band} order by many, signature) as place", f"count(*) over (partition by rep, {band}) as found")
    # A set's own band is the length of its size in base 2, less one.
    members = work.keep(members.filter(f"place <= found + if({band} = length(bin(n)) - 1, spare0, spare1)").select("signature", "rep"))
    work.drop(shared)
    again = members.groupBy("signature").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    wanted = members.join(again, "signature", "left_semi").select("rep").distinct().join(rep, "rep").select(F.col("least").alias("doc"), "h1", "h2", "rep")
    wanted = work.keep(wanted)
    work.drop(members)
    sets = sets_of(source.join(wanted.select("doc").distinct(), "doc", "left_semi").select("doc", "text"), n)
    sets = work.keep(sets.join(wanted, ["doc", "h1", "h2"]).select("rep", "features").dropDuplicates(["rep"]))
    work.drop(wanted)

    # The same among these sets alone, by finer parts: that is close to comparing their rarest features, and leaves few false pairs.
    fine = work.keep(fine_rows(sets, percent))
    fine = fine.join(fine.groupBy("signature").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "signature")
    fine = fine.selectExpr("*", f"row_number() over (partition by rep, {band} order by many, signature) as place", f"count(*) over (partition by rep, {band}) as found").filter("place <= found + spare")
    # Features that no other set has differ in every pair, so two sets can be linked only if these are few in both together.
    lone = sets.select("rep", F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("rep")).filter("c = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("lone"))
    members = work.keep(fine.select("signature", "rep", "n").join(work.keep(lone), "rep", "left").withColumn("lone", F.coalesce("lone", F.lit(0))))

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets are similar enough."""
        left, right = sets.select(F.col("rep").alias("a"), F.col("features").alias("fa")), sets.select(F.col("rep").alias("b"), F.col("features").alias("fb"))
        both = F.size(F.array_intersect("fa", "fb"))
        return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * (F.size("fa") + F.size("fb") - both)).select("a", "b")

    def centred(rows: DataFrame, *more: Column, when: str = "true") -> DataFrame:
        """Rows of signatures of more than one member, with the most central one of these as `centre`."""
        centre = rows.groupBy("signature").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("lone", "rep", "n")).alias("centre"), *more).filter("many > 1").filter(when)
        return rows.join(centre.select("signature", "centre"), "signature")

    fits = f"rep <> centre.rep and 100 * least(n, centre.n) >= {percent} * greatest(n, centre.n) and {100 + percent} * (lone + centre.lone) <= {100 - percent} * (n + centre.n)"
    ordered = "least(rep, centre.rep) as a", "greatest(rep, centre.rep) as b"
    active = work.keep(centred(members))
    tried = work.keep(active.filter(fits).selectExpr(*ordered).distinct())
    links = work.keep(linked(tried))
    where = components(work, links)
    odd = work.keep(parities(sets))
    words = range(PARITY // 64)
    unlike = " + ".join(f"bit_count(p{i} ^ q{i})" for i in words)
    for turn in range(ROUNDS):
        own = active.filter("rep <> centre.rep").drop("centre").join(where.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        active = work.keep(centred(own, F.min("component").alias("lowest"), F.max("component").alias("highest"), when="lowest <> highest").drop("many"))
        size = active.count()
        if not size:
            break
        group = active.groupBy("signature", "component").agg(F.count(F.lit(1)).alias("c"))
        left = group.groupBy("signature").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs")).agg(F.sum("pairs")).first()[0]
        if left <= REMAINING * size + 10_000 or turn == ROUNDS - 1:
            left = work.keep(with_partners(active.select("signature", "rep", "n", "lone", "component"), odd, percent))
            few = left.selectExpr("least(rep, other) as a", "greatest(rep, other) as b").filter("a < b").distinct().join(tried, ["a", "b"], "left_anti")
            found = work.keep(linked(few).unionByName(link_blocks(left.filter("other is null").drop("other").distinct(), sets, percent)))
            if found.head(1):
                where = components(work, links.unionByName(found))
            break
        other = odd.select(F.col("rep").alias("at"), *[F.col(f"p{i}").alias(f"q{i}") for i in words])
        pairs = active.filter(fits).join(odd, "rep").withColumn("at", F.col("centre.rep")).join(other, "at")
        pairs = pairs.filter(f"{100 + percent} * ({unlike}) <= {100 - percent} * (n + centre.n)").selectExpr(*ordered).distinct()
        fresh = work.keep(pairs.join(tried, ["a", "b"], "left_anti"))
        found = work.keep(linked(fresh))
        if found.head(1):
            tried, links = tried.unionByName(fresh), links.unionByName(found)
            where = components(work, links)
        active = active.drop("component")

    inside = where.unionByName(where.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("node", "rep")
    labels = inside.join(rep.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("component_id"))
    told = named.join(inside.join(labels, "component").select("rep", "component_id"), "rep", "left")
    links = []
    if count:
        told = told.join(count_links(work, sets, where, rep.select("rep", "n", "copies"), percent), "rep", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("n_others", F.lit(0)))
        links = ["n_links"]
    told = work.keep(told.select("first", "n", "h1", "h2", F.coalesce("component_id", "least").alias("component_id"), *links))
    work.finish(counted, told)
    out = counted.join(told, ["first", "n", "h1", "h2"], "left")
    return out.select("doc", "tag", "n", F.coalesce("component_id", "doc").alias("component_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in links])


def jaccard_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other rows that it links with, copies of its own text among them) of each row.

    Words are runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased. A row's set is that of its n-word shingles; the
    whole sequence if it has fewer words; empty without words or text, and then linked with nothing. Rows link when
    100 * intersection >= percent * union; component_id is the smallest key that links reach. Rows with a null key are left out;
    rows that repeat a key are rows each for itself, with links of their own. Other columns are ignored; an empty table has no rows.
    Sets compare by 64-bit hashes of their shingles.
    """
    out = _linked_rows(Workspace(docs.sparkSession, "ngram-join"), docs, n, percent, key, text)
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id", "n_links")


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that are the smallest of their component. Rows with a null key stay, and so do repeats of a row that stays.
    Links are not counted."""
    rows = _linked_rows(Workspace(docs.sparkSession, "ngram-join"), docs, WORDS, PERCENT, key, text, count=False)
    drop = rows.filter("component_id <> doc").select("doc", "tag").distinct()
    return docs.join(drop, (docs[key].cast("long") == drop["doc"]) & (F.xxhash64(docs[text]) == drop["tag"]), "left_anti")
