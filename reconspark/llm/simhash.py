"""SimHash near-dedup: a self-join of binary tries over the fingerprints.

Two fingerprints link when they differ in at most BUDGET of their 64 bits.  The bits are cut into BLOCKS with a
budget each; budgets and blocks are such that of two linked fingerprints at least one block is within its
own budget (1 + 1 and 1 + 1 and 1 make 5, one more than 4).  For each block the fingerprints are rotated so that it
comes first and made a binary trie.  Pairs of nodes are traversed together from the root, differing
bits add up, and a pair is pruned when it exceeds the block's budget inside the block or the whole budget
below it.  The top levels of that traversal are a Spark shuffle: a subtree pair is one group, a subtree
meets only those within the block's budget, and a subtree with more fingerprints than CELL is dealt
out in parts.  Each group returns a spanning forest of its links, so no cluster is expanded into its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.llm.common import connected_components, stored, text_or_empty

BUDGET = 4
#: (first bit from the top, number of bits, budget inside the block)
BLOCKS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
#: Words in a shingle and the seed of its hash.
SHINGLE, SEED = 4, 42
#: Most fingerprints of one subtree in a group; node pairs in a batch; a pair of nodes this small is compared directly.
CELL, BATCH, LEAF = 4096, 20_000, 64


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text as a signed integer; 0 for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= SHINGLE:
        hashes = [digest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), "int64", n)
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())]
    values = np.array(hashes, dtype="<u8")
    ones = np.unpackbits(values.view(np.uint8).reshape(len(values), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *others: str) -> DataFrame:
    """doc_id, fp (signed) and ``others`` of every row, in one narrow pass over the text."""
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint).astype("int64") if len(texts) else pd.Series([], dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col)).alias("fp"), *others)


class Forest:
    """Components of integer nodes under batches of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (self.root != (up := self.root[self.root])).any():
                self.root = up


def trie_links(x: np.ndarray, y: np.ndarray, same: bool, differing: int, depth: int, block_bits: int, block_budget: int, budget: int = BUDGET) -> np.ndarray:
    """Spanning forest of the links between two sorted arrays of rotated fingerprints that share ``depth`` bits but for ``differing`` of them.

    ``same``: x and y are one array, and each pair counts once.  Returns rows (i, j) of positions in x followed by y
    (in x alone if same), one for each node that is not the least of its component.
    """
    shift = 0 if same else len(x)
    forest = Forest(len(x) + (0 if same else len(y)))
    ones_x, ones_y = {}, {}

    def ones(seen: dict, values: np.ndarray, bit: int) -> np.ndarray:
        if bit not in seen:
            seen[bit] = np.concatenate(([0], np.cumsum((values >> np.uint64(63 - bit)) & np.uint64(1)))).astype("int64")
        return seen[bit]

    def compare(pairs: np.ndarray) -> None:
        width = pairs[:, 3] - pairs[:, 2]
        n = (pairs[:, 1] - pairs[:, 0]) * width
        at = np.repeat(np.arange(len(pairs)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = pairs[at, 0] + k // width[at], pairs[at, 2] + k % width[at]
        near = (np.bitwise_count(x[i] ^ y[j]) <= budget) & ((i < j) | (not same))
        forest.link(i[near], j[near] + shift)

    stack = [(depth, np.array([[0, len(x), 0, len(y), differing]], dtype="int64"))]
    while stack:
        bit, pairs = stack.pop()
        if len(pairs) > BATCH:
            stack += [(bit, pairs[at : at + BATCH]) for at in range(0, len(pairs), BATCH)]
            continue
        # Fingerprints are distinct, so below the last bit every node is one of them, and little.
        little = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= LEAF
        if little.any():
            compare(pairs[little])
            pairs = pairs[~little]
        if not len(pairs):
            continue
        cx, cy = ones(ones_x, x, bit), ones(ones_y, y, bit)
        xl, xh, yl, yh, d = pairs.T
        xm, ym = xh - (cx[xh] - cx[xl]), yh - (cy[yh] - cy[yl])
        twin = same & (xl == yl)
        children = np.concatenate([np.stack(c, axis=1) for c in ((xl, xm, yl, ym, d), (xm, xh, ym, yh, d), (xl, xm, ym, yh, d + 1), (xm, np.where(twin, xm, xh), yl, ym, d + 1))])
        limit = block_budget if bit < block_bits else budget
        stack.append((bit + 1, children[(children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3]) & (children[:, 4] <= limit)]))
    child = np.flatnonzero(forest.root != np.arange(len(forest.root)))
    return np.stack([child, forest.root[child]], axis=1)


def subtree_join(depth: int, bits: int, block_budget: int):
    """The function of one group: the fingerprints of two subtrees (or of one and itself) to their spanning links."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(turned=frame["turned"].to_numpy().view("uint64")).sort_values("turned")
        same = bool(frame["low_prefix"].iloc[0] == frame["high_prefix"].iloc[0] and frame["low_part"].iloc[0] == frame["high_part"].iloc[0])
        above = frame["above"].to_numpy(dtype=bool)
        low, high = (frame, frame) if same else (frame[~above], frame[above])
        names = low["fp"].to_numpy() if same else np.concatenate([low["fp"].to_numpy(), high["fp"].to_numpy()])
        tree = trie_links(low["turned"].to_numpy(), high["turned"].to_numpy(), same, int(frame["crossed"].iloc[0]), depth, bits, block_budget) if len(low) and len(high) else np.zeros((0, 2), "int64")
        return pd.DataFrame({"a": names[tree[:, 0]], "b": names[tree[:, 1]]})

    return join


def links(nodes: DataFrame) -> DataFrame:
    """Spanning links (a, b) of ``nodes(fp)``, which are distinct, over all blocks; enough for their components."""
    n = nodes.count()
    wanted = max(0, int(np.ceil(np.log2(max(1, n) / CELL))))
    found = None
    for first, bits, block_budget in BLOCKS:
        depth = min(wanted, bits)
        turned = nodes.select("fp", (F.shiftleft("fp", first).bitwiseOR(F.shiftrightunsigned("fp", 64 - first)) if first else F.col("fp")).alias("turned"))
        prefix = F.shiftrightunsigned("turned", 64 - depth) if depth else F.lit(0).cast("long")
        turned = turned.withColumn("prefix", prefix)
        # A subtree with more than CELL fingerprints is dealt out in parts.
        parts = turned.groupBy("prefix").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts")).where("parts > 1")
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(depth if block_budget else 0)])
        met = turned.withColumn("flip", F.explode(flips)).withColumn("other", F.col("prefix").bitwiseXOR(F.col("flip")))
        met = met.join(parts.withColumnRenamed("parts", "own_parts"), "prefix", "left").join(parts.select(F.col("prefix").alias("other"), F.col("parts").alias("other_parts")), "other", "left")
        met = met.withColumn("part", F.pmod(F.xxhash64("fp"), F.coalesce("own_parts", F.lit(1))).cast("int")).withColumn("other_part", F.explode(F.sequence(F.lit(0), F.coalesce("other_parts", F.lit(1)) - 1)))
        here, there = F.struct("prefix", "part"), F.struct(F.col("other").alias("prefix"), F.col("other_part").alias("part"))
        met = met.select(F.least(here, there).alias("low"), F.greatest(here, there).alias("high"), (here > there).alias("above"), (F.col("flip") != 0).alias("crossed"), "fp", "turned")

        flat = met.select(F.col("low.prefix").alias("low_prefix"), F.col("low.part").alias("low_part"), F.col("high.prefix").alias("high_prefix"), F.col("high.part").alias("high_part"), "above", "crossed", "fp", "turned")
        own = flat.groupBy("low_prefix", "low_part", "high_prefix", "high_part").applyInPandas(subtree_join(depth, bits, block_budget), "a long, b long")
        found = own if found is None else found.unionByName(own)
    return found


def groups(marked: DataFrame) -> DataFrame:
    """(fp, group, component_id) of each fingerprint of ``marked(doc_id, fp)``; a group is named by one of its fingerprints."""
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = connected_components(links(nodes.select("fp")))
    # Of each fingerprint that has links: the smallest id in its component.
    member = joined.join(nodes, F.col("node") == F.col("fp")).select("component", "fp", "least").unionByName(joined.select("component").distinct().join(nodes, F.col("component") == F.col("fp")).select("component", "fp", "least"))
    smallest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    return stored(
        nodes.join(member.select("fp", "component"), "fp", "left")
        .join(smallest, "component", "left")
        .select("fp", F.coalesce("component", "fp").alias("group"), F.coalesce("component_id", "least").alias("component_id"))
    )


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    A shingle is 4 words of the text with A-Z lowered, a shorter text is one shingle, and a text without words
    (null and empty ones too) has fingerprint 0, linked like any other.  Rows that repeat share their component; null ids
    are carried and never name one unless all ids of it are null.  An empty table gives an empty result.
    Other columns are ignored.
    """
    marked = stored(fingerprints(docs, id_col, text_col))
    # The second key makes both sides move for the join, so that a hot fingerprint's part can be split.
    salted = lambda df: df.withColumn("salt", F.xxhash64("fp"))
    return salted(marked).join(salted(groups(marked)), ["fp", "salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: the smallest id (null ids last), of its texts the one with the least hash.

    Null and empty texts have fingerprint 0 and are linked like any other.  Rows that repeat in id and text are one: one of them
    stays.  Rows of one id and different texts are told apart by the text's hash.  An empty table gives an empty result; other
    columns are carried, whatever their names.
    """
    sha = F.unhex(F.sha2(text_or_empty(f"`{text_col}`"), 256))
    marked = stored(fingerprints(docs.withColumn("own sha", sha), id_col, text_col, "own sha"))
    best = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "own sha")).alias("best"))
    kept = best.join(groups(marked).select("fp", "group"), "fp").groupBy("group").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("kept_id"), F.col("best.`own sha`").alias("kept_sha"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("own_id"), sha.alias("own_sha"))
    # Rows repeated with id and text are one text: dropDuplicates leaves one of them.
    same = F.col("own_sha").eqNullSafe(F.col("kept_sha")) & F.col("own_id").eqNullSafe(F.col("kept_id"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["own_sha", "own_id"]).select("row.*")
