"""Best-fit packing of documents into sequences of CAPACITY tokens by linear grouping.

Documents are tokenised once, in tasks, and only their piece lengths matter from then on.  The plan is made
from the histogram of lengths, at most CAPACITY numbers whatever the corpus holds: large lengths are
rounded up within GROUPS groups of equal cardinality, a linear programme picks configurations of those few
sizes, actual lengths are substituted for the rounded ones, and what is left, small ones first of all, goes best-fit
into the room that remains.  Equal sequences are planned together as runs, so the plan stays a small table too.
Each piece then finds its place by its rank among pieces of its length, which is computed in
two levels (counts per bucket, then inside a bucket) so that no task holds all pieces of a frequent length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconspark.llm.common import stored

CAPACITY = 2048
#: Lengths above this are large; the number of groups that they are rounded up in.
SMALL, GROUPS = 683, 10
#: A configuration is used when the rounded lengths fill at least this share of a sequence.
LEAST_FILL = 0.95
#: The id that ends a document.
END_ID = 0
#: Pieces in a bucket of the two-level ranks.
BUCKET = 1_000
VOCABULARY = "byte_bpe_50k.json"


def encoder(vocabulary: str | None = None):
    """A function from a text to the ids that tokenizers gives for it with add_special_tokens=False.

    The merges of a byte-level vocabulary are its ids in order, so tiktoken finds the same ids in a quarter of
    the time; a vocabulary of another kind, or a text that tiktoken can't take, goes to tokenizers itself.
    """
    import json
    import os
    from functools import cache

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = vocabulary or public_tokenizers.path(VOCABULARY)
    tokenizer = cache(lambda: Tokenizer.from_file(path))  # most tasks never need it
    plain = lambda text: tokenizer().encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
    ids = {k: v for k, v in content["model"].get("vocab", {}).items() if k not in special}
    pairs = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in content["model"].get("merges", [])]
    if "ByteLevel" not in json.dumps(content.get("pre_tokenizer")) or content.get("normalizer") or [ids.get(p) for p in pairs] != list(range(256, 256 + len(pairs))):
        return plain
    # The characters that stand for bytes: printable ones for themselves, the rest from U+0100 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte[c] for c in token): i for token, i in ids.items()}
    fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(t in text for t in special):
            return plain(text)
        try:
            return fast.encode_ordinary(text)
        except BaseException as error:  # a panic of the pattern matcher, on very long white space
            if type(error).__name__ != "PanicException" and not isinstance(error, ValueError):
                raise
            return plain(text)

    return encode


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    ``vocabulary`` is the path of a tokenizers file; by default the installed public one.
    A document longer than ``capacity`` is cut so that only its first piece may be shorter.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def cut(frames):
        encode = encoder(vocabulary)
        for frame in frames:
            rows = []
            for name, text in zip(frame["doc_id"].tolist(), frame["text"].tolist()):
                ids = np.array([*encode(text), END_ID], dtype="<u4")
                first = len(ids) % capacity or capacity
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : first if piece == 0 else start + capacity]
                    rows.append((name, piece, start, len(part), zlib.crc32(part.tobytes())))
            yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype="object" if i == 0 else "int64") for i, c in enumerate(("doc_id", "piece", "start", "length", "ids_crc32"))})

    return source.mapInPandas(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], capacity: int) -> np.ndarray:
    """All multisets of the given sizes that fit, as rows of counts."""
    found, stack = [], [(0, capacity, ())]
    while stack:
        first, room, taken = stack.pop()
        if taken:
            found.append(taken)
        stack += [(i, room - sizes[i], (*taken, i)) for i in range(first, len(sizes)) if sizes[i] <= room]
    table = np.zeros((len(found), len(sizes)))
    for row, taken in enumerate(found):
        np.add.at(table[row], list(taken), 1)
    return table


def cover(table: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """How often to use each configuration, by the simplex method for: least sum x, with x @ table >= demand."""
    n = table.shape[1]
    basis = [int(np.argmax(np.where((table > 0).sum(1) == 1, table[:, g], 0))) for g in range(n)]
    for _ in range(50 * n):
        inverse = np.linalg.inv(table[basis].T)
        level, price = inverse @ demand, np.ones(n) @ inverse
        gain = table @ price
        enter = int(np.argmax(gain))
        if gain[enter] <= 1 + 1e-9:
            break
        step = inverse @ table[enter]
        ratio = np.where(step > 1e-12, np.maximum(level, 0) / np.where(step > 1e-12, step, 1), np.inf)
        basis[int(np.argmin(ratio))] = enter
    used = np.zeros(len(table))
    used[basis] = np.maximum(np.linalg.inv(table[basis].T) @ demand, 0)
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS, least_fill: float = LEAST_FILL) -> list[tuple[int, int, int, int, int]]:
    """Allotments (length, first rank, count, first sequence, offset) that place every piece of the histogram.

    The pieces of ``length`` with ranks first .. first + count - 1 go to as many sequences from first sequence on,
    one each, at that offset.
    """
    out: list[tuple[int, int, int, int, int]] = []
    rank = dict.fromkeys(histogram, 0)
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs of (first sequence, count)
    opened = 0

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        out.append((length, rank[length], count, sequence, offset))
        rank[length] += count

    # Linear grouping of the large lengths, largest first.
    large = [(x, histogram[x]) for x in sorted(histogram, reverse=True) if x > small]
    n_large = sum(n for _, n in large)
    queues: list[list[list[int]]] = []
    if n_large:
        each = each_left = -(-n_large // groups)
        for length, n in large:
            while n:
                if not queues or each_left == 0:
                    queues.append([])
                    each_left = each
                m = min(n, each_left)
                queues[-1].append([length, m])
                n, each_left = n - m, each_left - m
    sizes = [q[0][0] for q in queues]
    if sizes:
        table = configurations(sizes, capacity)
        demand = np.array([sum(n for _, n in q) for q in queues], dtype=float)
        times = np.floor(cover(table, demand) + 1e-9).astype(int)
        left = demand.astype(int)
        fill = table @ np.array(sizes)
        for c in np.argsort(-fill, kind="stable"):
            if fill[c] < least_fill * capacity:
                break  # such sequences do better when the small pieces choose among them by best fit
            slots = [g for g in range(len(sizes)) for _ in range(int(table[c][g]))]
            m = min([int(times[c]), *(left[g] // int(table[c][g]) for g in set(slots))])
            for g in set(slots):
                left[g] -= m * int(table[c][g])
            # Substitute actual lengths: each slot takes the next m of its group, in runs of equal length.
            runs = []
            for g in slots:
                need, own = m, []
                while need:
                    k = min(need, queues[g][0][1])
                    own.append([queues[g][0][0], k])
                    queues[g][0][1] -= k
                    if not queues[g][0][1]:
                        queues[g].pop(0)
                    need -= k
                runs.append(own)
            while m:
                k = min(own[0][1] for own in runs)
                offset = 0
                for own in runs:
                    place(own[0][0], k, opened, offset)
                    offset += own[0][0]
                    own[0][1] -= k
                    if not own[0][1]:
                        own.pop(0)
                room.setdefault(capacity - offset, []).append((opened, k))
                opened, m = opened + k, m - k
    # The rest, longest first, each into the least room that holds it.
    rest = {x: n for x, n in histogram.items() if x <= small}
    for q in queues:
        for length, n in q:
            rest[length] = rest.get(length, 0) + n
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            free = min((r for r in room if r >= length), default=None)
            if free is None:
                fit = capacity // length
                room.setdefault(capacity, []).append((opened, -(-n // fit)))
                opened += -(-n // fit)
                continue
            sequence, count = room[free].pop()
            if not room[free]:
                del room[free]
            per = min(free // length, n)
            k = min(count, n // per)
            for j in range(per):
                place(length, k, sequence, capacity - free + j * length)
            n -= k * per
            if free - per * length:
                room.setdefault(free - per * length, []).append((sequence, k))
            if count > k:
                room.setdefault(free, []).append((sequence + k, count - k))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty: a document of one id.  Repeated rows are packed each; a null id is carried.
    An empty table gives an empty result.  Other columns are ignored.
    """
    cut = stored(pieces(docs, id_col, text_col, vocabulary, capacity))
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    allotted = sorted(plan(histogram, capacity))
    width = 1 << 44
    keys = np.array([a[0] * width + a[1] for a in allotted], dtype="int64")
    places = spark.sparkContext.broadcast((keys, *(np.array([a[i] for a in allotted], dtype="int64") for i in (1, 3, 4))))

    buckets = max(1, sum(histogram.values()) // BUCKET)
    keyed = cut.withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    ahead = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("h", "doc_id", "piece"))).join(ahead, ["length", "bucket"])

    def put(frames):
        keys, first, sequence, offset = places.value
        for f in frames:
            at = np.searchsorted(keys, f["length"].to_numpy() * width + f["rank"].to_numpy(), side="right") - 1
            f["sequence_id"], f["offset"] = sequence[at] + f["rank"].to_numpy() - first[at], offset[at]
            yield f.drop(columns="rank")

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") + F.col("before") - 1).alias("rank")).mapInPandas(put, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
