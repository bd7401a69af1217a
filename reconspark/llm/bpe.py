"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of its last WINDOW bytes says so, so passages that documents share give equal chunks
wherever they stand.  A chunk with several places in the corpus is encoded once; runs of the others are encoded with their text.
A text's ids are then joined from these parts, and every joint is repaired: the text around it is encoded again, between the last place before and the
first place behind it where both encodings are sure to agree, and the ids between the two are replaced.

Where encodings agree: the byte-level pre-tokenizer reads from left to right, without looking back, and none of its
alternatives holds a character behind which only the start of a new piece can follow (``SURE``): white space behind something
else, or an ASCII character other than a letter behind an ASCII letter.  So the ids of a text are
those of its two sides at each such place.  A chunk without one joins the open part, which is encoded as a whole when
the next such place comes (or the text ends): joining takes time in proportion to the text, whatever it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.llm.common import stored
from reconspark.llm.packing import VOCABULARY, encoder

#: Bytes under the rolling hash; the share of places that end a chunk is 2 ** -BITS; least and most bytes of a chunk.
WINDOW, BITS, LEAST, MOST = 16, 9, 128, 4096
#: A place between two characters where any text may be cut without changing its ids.
SURE = re.compile(r"(?<=[A-Za-z])(?=[\t-\r -@\[-`{-~])|(?<=[^\s᠎​﻿])(?=[ \n\t])|(?<=[ぁ-ゖァ-ヺ一-龥가-힣])(?=[、。！，？])")
#: The ids at each side of a joint that are searched for a sure place before all are.
NEAR = 16

_MULTIPLIER = 0x9E3779B1
_TABLE = ((np.arange(1, 257, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype("uint32")


def chunks(data: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[bytes]:
    """Cut UTF-8 bytes at places that the bytes before them decide, between characters; no bytes give one empty chunk."""
    if len(data) <= least:
        return [data]
    raw = np.frombuffer(data, dtype="uint8")
    h = _TABLE[raw]
    step = 1
    while step < WINDOW:
        wide = h.copy()
        wide[step:] += h[:-step] * np.uint32(pow(_MULTIPLIER, step, 1 << 32))
        h, step = wide, 2 * step
    starts = (raw & 0xC0) != 0x80
    ends = np.flatnonzero((h[:-1] >> np.uint32(32 - bits) == 0) & starts[1:]) + 1
    found, last = [], 0

    def far(end: int) -> None:
        nonlocal last
        while end - last > most:
            cut = last + most
            while not starts[cut]:
                cut -= 1
            found.append(data[last:cut])
            last = cut

    for end in ends.tolist():
        if end - last < least:
            continue
        far(end)
        if end - last >= least:
            found.append(data[last:end])
            last = end
    far(len(data))
    found.append(data[last:])
    return found


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Vocabulary:
    """A tokenizers file: ids of a text, bytes of an id, and whether texts may be cut (``SURE`` holds for its pre-tokenizer)."""

    def __init__(self, path: str | None = None):
        import json

        import public_tokenizers

        with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
            content = json.load(file)
        self.path = path
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        self.byte_level = "ByteLevel" in json.dumps(content.get("pre_tokenizer")) and not content.get("normalizer")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = content["model"].get("vocab", {}) | self.special
        self.bytes: list[bytes | None] = [None] * (1 + max(vocabulary.values(), default=-1))
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in self.special or not all(c in byte for c in token) else bytes(byte[c] for c in token)
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    @cached_property
    def encode(self):
        """Made when first used: decoding needs none."""
        return encoder(self.path)

    def parts(self, text: str) -> list[bytes]:
        """The chunks of a text; a special token is one of its own, a text that can't be cut is one as a whole."""
        if not self.byte_level:
            return [text.encode()]
        if self.cut is None or not any(t in text for t in self.special):
            return chunks(text.encode())
        return [c for part in self.cut.split(text) if part for c in ([part.encode()] if part in self.special else chunks(part.encode()))] or [b""]

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; ids that the vocabulary lacks give nothing."""
        known = self.bytes
        return b"".join(known[i] or b"" for i in ids if 0 <= i < len(known)).decode("utf-8", "replace")

    def back(self, ids: list[int]) -> tuple[int, str]:
        """How many ids stand before the last sure place of a part, and its text from there on; 0 and all of it if there is none."""
        known = self.bytes
        for some in (ids[-NEAR:], ids):
            data = b"".join([known[i] for i in some])
            if len(some) < len(ids):  # the first of these ids may start inside a character
                data = data[next(k for k, b in enumerate(data) if b & 0xC0 != 0x80) :]
            text = data.decode()
            found = None
            for found in SURE.finditer(text, 1):
                pass
            if found:
                rest = text[found.start() :]
                n, wanted = len(ids), len(rest.encode())
                while wanted > 0:
                    n -= 1
                    wanted -= len(known[ids[n]])
                assert wanted == 0, "a sure place inside a token"
                return n, rest
            if len(some) == len(ids):
                return 0, text

    def front(self, ids: list[int]) -> tuple[int, str] | None:
        """How many ids stand before the first sure place of a chunk, and its text up to it; None if there is none."""
        known = self.bytes
        for some in (ids[:NEAR], ids):
            text = b"".join([known[i] for i in some]).decode("utf-8", "ignore")  # the last of these ids may end inside a character
            found = SURE.search(text, 1)
            if found:
                head = text[: found.start()]
                n, wanted = 0, len(head.encode())
                while wanted > 0:
                    wanted -= len(known[ids[n]])
                    n += 1
                assert wanted == 0, "a sure place inside a token"
                return n, head
            if len(some) == len(ids):
                return None

    def spread(self, text: str) -> list[list[int]]:
        """The ids of a run of chunks with one place each, special tokens apart: parts for ``join``."""
        if self.cut is None or not any(t in text for t in self.special):
            return [self.encode(text)]
        return [[self.special[part]] if part in self.special else self.encode(part) for part in self.cut.split(text) if part]

    def join(self, parts: list[list[int]]) -> list[int]:
        """The ids of a text from those of its chunks in order."""
        if len(parts) == 1:
            return parts[0]
        own = set(self.special.values())
        out: list[int] = []
        waiting: list[str] = []  # text behind the last sure place, whose ids aren't in out yet
        for ids in parts:
            if len(ids) == 1 and ids[0] in own:  # nothing is merged over a special token
                out += self.encode("".join(waiting)) if waiting else []
                out.append(ids[0])
                waiting = []
                continue
            first = self.front(ids) if waiting else (0, "")
            if first is None:
                waiting.append(self.decode(ids))
                continue
            skipped, head = first
            if waiting:
                out += self.encode("".join(waiting) + head)
            body = ids[skipped:]
            kept, rest = self.back(body)
            out += body[:kept]
            waiting = [rest] if rest else []
        return out + (self.encode("".join(waiting)) if waiting else [])


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """``(text_key, packed)`` of every different text, compressed before it moves; null counts as empty."""
    def pack(frames):
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for frame in frames:
            data = [t.encode() for t in frame["text"]]
            yield pd.DataFrame({"text_key": [digest(d) for d in data], "packed": [packer.compress(d) for d in data]})

    # A map over rows, not a column function: a join's own test for null keys would call that once more below the aggregation.
    packed = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).mapInPandas(pack, "text_key binary, packed binary")
    return packed.groupBy("text_key").agg(F.first("packed").alias("packed"))


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, decoded: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text_key)`` of every row, and ``(text_key, ids)`` of every different text; with ``decoded``, which is the text of the ids.

    Recipes (digests and lengths of a text's chunks) are made and counted first.  Chunks with one place are encoded with their text; the others
    are encoded once, at the first of their places, and looked up at all.
    ``vocabulary`` is the path of a tokenizers file; by default the installed public one.  A chunk and a text are known by 128 bits of their digest.
    Ids are decoded where they are made: a function of its own would hold a second Python process beside every task's.
    """
    def recipes(texts):
        own = Vocabulary(vocabulary)
        for some in texts:
            parts = [own.parts(t) for t in some]
            yield pd.DataFrame({"text_key": [digest(t.encode()) for t in some], "chunks": [b"".join(map(digest, p)) for p in parts], "sizes": [list(map(len, p)) for p in parts]})

    recipes.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}  # one vocabulary for each task
    recipe = F.pandas_udf(recipes, "text_key binary, chunks binary, sizes array<int>")
    narrow = len(Vocabulary(vocabulary).bytes) <= 1 << 16
    dtype = "<u2" if narrow else "<u4"

    rows = stored(docs.select(F.col(f"`{id_col}`").alias("doc_id"), recipe(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("r")).select("doc_id", "r.text_key", "r.chunks", "r.sizes"), free=True)
    different = rows.groupBy("text_key").agg(F.first("chunks").alias("chunks"), F.first("sizes").alias("sizes"))
    places = different.select("text_key", F.posexplode(F.expr("transform(sequence(0, size(sizes) - 1), i -> substring(chunks, 16 * i + 1, 16))")).alias("seq", "chunk_key"))
    shared = places.groupBy("chunk_key").agg(F.count("*").alias("n"), F.min(F.struct("text_key", "seq")).alias("first")).where("n > 1")
    wanted = shared.select("first.text_key", F.struct("first.seq", "chunk_key").alias("w")).groupBy("text_key").agg(F.collect_list("w").alias("wanted"))

    def once(frames):
        import zstandard

        encode, unpack = encoder(vocabulary), zstandard.ZstdDecompressor().decompress
        for frame in frames:
            keys, ids = [], []
            for packed, sizes, wanted in zip(frame["packed"], frame["sizes"], frame["wanted"]):
                data, ends = unpack(packed), np.cumsum(sizes).tolist()
                for w in wanted:
                    keys.append(w["chunk_key"])
                    ids.append(np.array(encode(data[ends[w["seq"]] - int(sizes[w["seq"]]) : ends[w["seq"]]].decode()), dtype="<u4").astype(dtype).tobytes())
            yield pd.DataFrame({"chunk_key": pd.Series(keys, dtype="object"), "ids": pd.Series(ids, dtype="object")})

    sought = wanted.join(different.select("text_key", "sizes"), "text_key")
    known = stored(_texts(docs, text_col).join(sought, "text_key").select("packed", "sizes", "wanted").mapInPandas(once, "chunk_key binary, ids binary"), free=True)
    # The second key makes both sides move for the join, so that a hot chunk's part can be split.
    salted = lambda df: df.withColumn("salt", F.xxhash64("chunk_key"))
    given = salted(places).join(salted(known), ["chunk_key", "salt"]).groupBy("text_key").agg(F.collect_list(F.struct("seq", "ids")).alias("given"))
    told = different.select("text_key", "sizes").join(given, "text_key", "left")

    def joined(frames):
        import zstandard

        own, unpack = Vocabulary(vocabulary), zstandard.ZstdDecompressor().decompress
        for frame in frames:
            for at in range(0, len(frame), 200):
                some = frame.iloc[at : at + 200]
                out = []
                for packed, sizes, given in zip(some["packed"], some["sizes"], some["given"]):
                    data = unpack(packed)
                    if given is None:
                        out.append(np.array(own.encode(data.decode()), dtype="int32"))
                        continue
                    ends = np.cumsum(sizes).tolist()
                    parts, last = [], 0
                    for g in sorted(given, key=lambda g: g["seq"]):
                        start, end = ends[g["seq"]] - int(sizes[g["seq"]]), ends[g["seq"]]
                        parts += own.spread(data[last:start].decode()) if start > last else []
                        parts.append(np.frombuffer(g["ids"], dtype=dtype).tolist())
                        last = end
                    parts += own.spread(data[last:].decode()) if last < len(data) else []
                    out.append(np.array(own.join(parts), dtype="int32"))
                yield pd.DataFrame({"text_key": some["text_key"], "ids": out} | ({"decoded": [own.decode(x.tolist()) for x in out]} if decoded else {}))

    ids = _texts(docs, text_col).join(told, "text_key").select("text_key", "packed", "sizes", "given").mapInPandas(joined, "text_key binary, ids array<int>" + ", decoded string" * decoded)
    return rows.select("doc_id", "text_key"), ids


def _by_text(rows: DataFrame, texts: DataFrame) -> DataFrame:
    salted = lambda df: df.withColumn("salt", F.xxhash64("text_key"))
    return salted(rows).join(salted(texts), ["text_key", "salt"]).drop("text_key", "salt")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` of every row, as tokenizers encodes its whole text with add_special_tokens=False.

    Null and empty texts have no ids.  Rows that repeat and null ids are carried; the strings of special tokens in a text are those
    tokens, as in tokenizers.  An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    return _by_text(*encode_texts(docs, id_col, text_col, vocabulary))


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``encoded`` with the text of its ids, special tokens included; null ids give null, unknown ids nothing."""
    def text(frames):
        own = Vocabulary(vocabulary)
        for ids in frames:
            yield ids.map(lambda x: None if x is None else own.decode(x.tolist()))

    text.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.Series]}  # one vocabulary for each task
    text = F.pandas_udf(text, "string")
    return encoded.withColumn(out_col, text(F.col(f"`{ids_col}`")))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256."""
    rows, texts = encode_texts(docs, id_col, text_col, vocabulary, decoded=True)
    told = texts.select("text_key", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
    return _by_text(rows, told)
