"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

A word is a point: how often each letter stands in it (letters outside a-z share DIMENSIONS - 26 counters).  One inserted or deleted
letter moves the point by at most one, a replaced one by at most two (L1 distance).  So the words near a word are among the
points of its own length within distance two and those of the next length within distance one.  For each length a k-d tree
of the points is searched with these boxes and radii.  Its top levels are a Spark shuffle: a leaf of the top tree is one
group, and a word is sent to every leaf that its radius reaches.  In the group the tree goes on; nodes whose tight box lies
beyond the radius are pruned, and what is left is compared letter by letter.

The top tree is fitted on about SAMPLE words of the vocabulary, chosen by their hash, and has at most MAX_LEAVES leaves: it decides how even the
groups are, never what is found.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.llm.common import drop_stored, stored

#: Words are at least this long and frequent; a form is at least so many times as frequent as its variant.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One in so many (document, word) pairs loses a letter.
SLIP = 199
#: Letters told apart (26 and six counters for the rest); bits of a letter's count.
DIMENSIONS, BITS = 32, 4
#: Words wanted in a leaf of the top tree; most leaves; words that the top tree is fitted on; points in a leaf of a group's tree.
CELL, MAX_LEAVES, SAMPLE, LEAF = 8192, 4096, 65_536, 64
#: Words counted in a task before they are handed on; pairs compared at once.
HELD, BATCH = 300_000, 400_000

#: Bytes of words (lower-cased a-z and the two bytes of U+00C0 to U+00FF) for themselves, others as spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b == 0xC3 or 0x80 <= b <= 0xBF else 32 for b in range(256))
_OTHER = re.compile(rb"[\xc2\xc4-\xff][\x80-\xbf]*")


def words(text: str) -> list[bytes]:
    """The maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` in UTF-8, A-Z lowered."""
    return _OTHER.sub(b" ", text.encode("utf-8", "surrogatepass")).translate(_WORD_BYTES).split()


def counts(texts, ids, slips: int | None = SLIP):
    """Counters of words (UTF-8) over rows, each of at most about HELD words; letters slip where (id, word) says so."""
    held: Counter = Counter()
    for name, text in zip(ids, texts):
        found = words(text)
        held.update(found)
        if slips:
            start = zlib.crc32(f"{name}:".encode())
            hit = [(w, h) for w in set(found) if not (h := zlib.crc32(w, start)) % slips]
            own = Counter(found) if len(hit) > 8 else None
            for w, h in hit:
                n = own[w] if own else found.count(w)
                letters = w.decode()
                at = h % len(letters)
                held[w] -= n
                held[(letters[:at] + letters[at + 1 :]).encode()] += n
        if len(held) > HELD:
            yield held
            held = Counter()
    yield held


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slips: int | None = SLIP) -> DataFrame:
    """``(word, n)`` of the words of all rows that are long and frequent enough.  Null texts have none; a null id counts as empty."""
    def count(frames):
        def rows():
            for frame in frames:
                yield from counts(frame["text"], frame["id"], slips)

        for held in rows():
            own = [(t, n) for w, n in held.items() if n and len(w) >= least_length and len(t := w.decode()) >= least_length]
            if own:
                yield pd.DataFrame(own, columns=["word", "n"])

    source = docs.where(F.col(f"`{text_col}`").isNotNull()).select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letters(found: list[str]) -> np.ndarray:
    """Words of one length as rows of Latin-1 codes."""
    return np.frombuffer("".join(found).encode("latin-1"), dtype="uint8").reshape(len(found), -1)


def points(codes: np.ndarray) -> np.ndarray:
    """Letter-count vectors of rows of codes, two 64-bit numbers each: a count of c is the c lowest of its letter's BITS bits.

    So the L1 distance of two vectors is the number of bits in which they differ, and a set of them has as its box all
    vectors between its bitwise and and its bitwise or.  Counts above BITS are taken for BITS, which makes distances no larger.
    """
    low = (codes >= 97) & (codes <= 122)
    dimension = np.where(low, codes.astype("int64") - 97, 26 + codes % (DIMENSIONS - 26))
    at = np.arange(len(codes))[:, None] * DIMENSIONS + dimension
    count = np.bincount(at.ravel(), minlength=len(codes) * DIMENSIONS).reshape(len(codes), DIMENSIONS, 1)
    return np.packbits((count > np.arange(BITS)).reshape(len(codes), -1), axis=1).view("uint64")


def beyond(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """L1 distance of points to a box."""
    out = np.bitwise_count((low & ~own) | (own & ~high))
    return out[:, 0] + out[:, 1]


def split(own: np.ndarray) -> np.ndarray | None:
    """The threshold of a letter's count, as a point with that one bit, that halves points best; None if they are all one."""
    n = len(own)
    ones = np.unpackbits(own.view("uint8"), axis=1).sum(0, dtype="int64")
    bit = int(np.where((ones > 0) & (ones < n), np.abs(2 * ones - n), n + 1).argmin())
    return np.packbits(np.arange(len(ones)) == bit).view("uint64") if 0 < ones[bit] < n else None


def top_tree(own: np.ndarray, leaves: int):
    """Nested (threshold, points below it, points from it on) with leaf numbers at the ends, of at most ``leaves`` leaves."""
    numbers = iter(range(leaves))

    def grow(rows: np.ndarray, leaves: int):
        bit = split(rows) if leaves > 1 else None
        if bit is None:
            return next(numbers)
        above = (rows & bit).any(1)
        share = min(leaves - 1, max(1, round(leaves * float(above.mean()))))
        return (bit, grow(rows[~above], leaves - share), grow(rows[above], share))

    return grow(own, leaves)


def reached(tree, own: np.ndarray, radius: int):
    """(row, leaf) of every leaf whose region lies within ``radius`` of a point, as two arrays; radius 0 gives the point's own leaf."""
    rows, leaves = [], []
    none = np.zeros(own.shape[1], "uint64")
    stack = [(tree, np.arange(len(own)), none, ~none)]
    while stack:
        node, at, low, high = stack.pop()
        at = at[beyond(own[at], low, high) <= radius]
        if isinstance(node, tuple):
            bit, below, above = node
            stack += [(below, at, low, high & ~bit), (above, at, low | bit, high)] if len(at) else []
        else:
            rows.append(at)
            leaves.append(np.full(len(at), node))
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, "int64"), np.zeros(0, "int64"))


def range_pairs(own: np.ndarray, asked: np.ndarray, radius: int):
    """Batches of (point, asking point) rows within ``radius``: a k-d tree of ``own`` searched for all of ``asked`` at once."""
    lists: list = []
    size = 0
    stack = [(np.arange(len(own)), np.arange(len(asked)))]
    while stack:
        at, q = stack.pop()
        here = own[at]
        q = q[beyond(asked[q], np.bitwise_and.reduce(here, axis=0), np.bitwise_or.reduce(here, axis=0)) <= radius]
        if not len(q):
            continue
        bit = split(here) if len(at) > LEAF else None
        if bit is not None:
            above = (here & bit).any(1)
            stack += [(at[~above], q), (at[above], q)]
            continue
        per = max(1, BATCH // len(at))
        for k in range(0, len(q), per):
            some = q[k : k + per]
            differing = np.bitwise_count(here[None, :, :] ^ asked[some][:, None, :])
            j, i = np.nonzero(differing[:, :, 0] + differing[:, :, 1] <= radius)
            lists.append((at[i], some[j]))
            size += len(i)
            if size > BATCH:
                yield tuple(np.concatenate(x) for x in zip(*lists))
                lists, size = [], 0
    if lists:
        yield tuple(np.concatenate(x) for x in zip(*lists))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of codes are one edit apart: b as long as a, or one longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    front = np.minimum.accumulate(a == b[:, :-1], axis=1).sum(1)
    back = np.minimum.accumulate(a[:, ::-1] == b[:, :0:-1], axis=1).sum(1)
    return front + back >= a.shape[1]


def _codes(frame: pd.DataFrame):
    """Codes and points of a frame's words, which are of one length."""
    codes = letters(frame["word"].tolist())
    return codes, points(codes)


_NOTHING = pd.DataFrame({"word": pd.Series(dtype="object"), "n_near": pd.Series(dtype="int64"), "least": pd.Series(dtype="int64"), "form": pd.Series(dtype="object")})


def leaf_join(frame: pd.DataFrame) -> pd.DataFrame:
    """One leaf: its own words against themselves and those sent to it; of each word how many near ones it met here and the best of them."""
    length = int(frame["length"].iloc[0])
    size = frame["word"].str.len()
    home = frame[frame["home"]].reset_index(drop=True)
    if home.empty:
        return _NOTHING
    codes, own = _codes(home)
    met = []  # word, near word, n of the near word
    names, n = home["word"].to_numpy(), home["n"].to_numpy()
    for shorter in (False, True):
        guests = frame[~frame["home"] & (size == length - shorter)].reset_index(drop=True)
        if not guests.empty:
            guest_codes, asked = _codes(guests)
            guest_names, guest_n = guests["word"].to_numpy(), guests["n"].to_numpy()
            for i, j in range_pairs(own, asked, 1 if shorter else 2):
                near = one_edit(guest_codes[j], codes[i])
                i, j = i[near], j[near]
                met += [(names[i], guest_names[j], guest_n[j]), (guest_names[j], names[i], n[i])]
    for i, j in range_pairs(own, own, 2):
        i, j = i[i < j], j[i < j]
        near = one_edit(codes[i], codes[j])
        i, j = i[near], j[near]
        met += [(names[i], names[j], n[j]), (names[j], names[i], n[i])]
    if not met:
        return _NOTHING
    word, form, of = (np.concatenate(x) for x in zip(*met))
    pairs = pd.DataFrame({"word": word, "least": -of.astype("int64"), "form": form}).sort_values(["word", "least", "form"])
    first = pairs["word"].ne(pairs["word"].shift())
    n_near = pairs.groupby(first.cumsum().to_numpy()).size()
    best = pairs[first].assign(n_near=n_near.to_numpy())
    return best[["word", "n_near", "least", "form"]]


def near_words(known: DataFrame, cell: int = CELL) -> DataFrame:
    """``(word, n_near, form, form_n)`` of the words of ``known(word, n)`` that have near ones: the most frequent, ties to the least."""
    sized = known.withColumn("length", F.length("word"))
    by_length = {r["length"]: r["n"] for r in sized.groupBy("length").agg(F.count("*").alias("n")).where(F.col("n") > cell).orderBy(F.desc("n"), "length").limit(MAX_LEAVES).collect()}
    total = sum(by_length.values())
    trees = {}
    if by_length:
        share = min(1.0, SAMPLE / total)
        sample = sized.where(F.col("length").isin(list(by_length)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 40)) < int(share * (1 << 40)))).select("word").toPandas()["word"]
        for length, n in by_length.items():
            own = sample[sample.str.len() == length].tolist()
            leaves = min(-(-n // cell), max(1, MAX_LEAVES * n // total))
            if own and leaves > 1:
                trees[length] = top_tree(points(letters(own)), leaves)

    def send(frames):
        for frame in frames:
            out = []
            for length, part in frame.groupby("length"):
                part = part.reset_index(drop=True)
                own = points(letters(part["word"].tolist()))
                home = reached(trees.get(length, 0), own, 0)
                leaf = np.empty(len(part), dtype="int64")
                leaf[home[0]] = home[1]
                for target, radius in ((length, 2), (length + 1, 1)):
                    rows, leaves = reached(trees.get(target, 0), own, radius)
                    if target == length:  # a pair of one length meets in the later of its leaves
                        later = leaves >= leaf[rows]
                        rows, leaves = rows[later], leaves[later]
                    out.append(pd.DataFrame({"length": target, "leaf": leaves, "home": (leaves == leaf[rows]) & (target == length), "word": part["word"].to_numpy()[rows], "n": part["n"].to_numpy()[rows]}))
            if out:
                yield pd.concat(out).astype({"word": object})

    sent = sized.mapInPandas(send, "length int, leaf int, home boolean, word string, n long")
    # Leaves above a length that no word has are groups of guests only; they give nothing.
    met = sent.groupBy("length", "leaf").applyInPandas(leaf_join, "word string, n_near long, least long, form string")
    best = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("least", "form")).alias("best"))
    return best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.least")).alias("form_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slips: int | None = SLIP, times: int = TIMES, cell: int = CELL) -> DataFrame:
    """One row per frequent word: word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (ties: the least in code-point order) if that n is at least ``times`` the word's own, else null;
    ``root`` follows forms to the last.  Null and empty texts have no words, a null id counts as empty, repeated rows count each.  A table without
    frequent words gives an empty result.  Other columns are ignored, whatever their names.
    """
    known = stored(vocabulary(docs, id_col, text_col, least_length, least_count, slips), free=True)
    near = near_words(known, cell)
    good = F.col("form_n") >= times * F.col("n")
    told = stored(known.join(near, "word", "left").select("word", F.when(good, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("form_n")).alias("form_n")), free=True)
    # Each round doubles how far a word has followed its forms; a form is more frequent, so there is an end.
    ways = stored(told.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(ways.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop_stored(ways)
        ways = after
        if ways.where("moved").isEmpty():
            break
    drop_stored(known)
    return told.join(ways.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
