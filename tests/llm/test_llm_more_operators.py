"""BPE with reused chunks, spelling variants, embedding whitening: brute force, edge rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reconspark.llm import bpe, spelling, whitening

DOCS = "doc_id long, text string, row string, ids string, word string, salt string, text_key string, n string, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, *"abcdefg") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary()


BITS = ["a", "b", "the", " ", "  ", "\n", "'", "'s", "'re", "1", "23", ".", "!!", "é", "ß", "　", "\x85", "\xa0", "​", "᠎", "漢字", "。", "、", "ひら", "😀", "<|endoftext|>", "<|endo", "ftext|>", "\t", "\x1c", "word", "Ünï", "١", "़"]


@pytest.mark.parametrize("seed", range(4))
def test_joints_of_any_chunks_are_repaired(tokenizer, vocabulary, seed):
    rng = random.Random(seed)
    for _ in range(400):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 120)))
        parts = []
        for section in vocabulary.cut.split(text):
            while section:
                n = len(section) if section in vocabulary.special else rng.randint(1, 25)
                parts.append(section[:n])
                section = section[n:]
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert vocabulary.join([vocabulary.encode(p) for p in parts or [""]]) == ids
        assert vocabulary.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False) == text


def test_chunks_cover_texts_and_move_with_them(vocabulary):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passage = say(600)
    for text in ("", "short", "漢" * 9000, "a" * 20_000, " " * 9000, passage, "x <|endoftext|> " * 50):
        assert b"".join(vocabulary.parts(text)).decode() == text
        assert all(len(c) <= bpe.MOST for c in vocabulary.parts(text)) and all(c.decode() is not None for c in vocabulary.parts(text))
    ones, others = ({*vocabulary.parts(say(k) + " " + passage + " " + say(k))} for k in (40, 71))
    assert len(ones & others) >= 0.5 * len(vocabulary.parts(passage))


def encode_rows():
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma,", "don't", "1999", "漢字。", "naïve", "\n", "<|endoftext|>"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, long = say(400), say(20_000)
    own = [None, "", " ", "one", "one", long, long, "漢" * 6000, "a" * 30_000, " \n" * 5000, *[say(k) + shared + say(9) for k in range(12)]]
    return [(k * 7 % 101, t) for k, t in enumerate(own)] + [(None, "no id"), (3, "again"), (3, "again"), (1 << 60, "large id")]


def test_encoding_equals_tokenizers(spark, tokenizer):
    rows = encode_rows()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    plain = [tokenizer.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    wanted = Counter((i, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))) for (i, _), ids in zip(rows, plain))
    d = table(spark, rows)
    assert Counter(map(tuple, bpe.digests(d).collect())) == wanted
    encoded = bpe.encode(d)
    assert Counter((r.doc_id, *r.ids) for r in encoded.collect()) == Counter((i, *ids) for (i, _), ids in zip(rows, plain))
    assert Counter((r.doc_id, r.text) for r in bpe.decode(encoded).collect()) == Counter((i, t or "") for i, t in rows)
    assert bpe.digests(table(spark, [])).count() == bpe.encode(table(spark, [])).count() == 0


def test_digests_hold_one_python_process_for_each_task(spark):
    plan = bpe.digests(table(spark, encode_rows()))._jdf.queryExecution().executedPlan().toString()
    nodes = [line for line in plan.splitlines() if "MapInPandas" in line or "EvalPython" in line]
    assert len(nodes) == 2  # packing the texts and joining their parts, with an exchange between


def test_decoding_of_unknown_ids_and_parts_of_characters(spark, tokenizer):
    ids = [[50256, 464], [447], [447, 247], [], None, [60_000_000]]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "k int, ids array<int>")
    found = {r.k: r.text for r in bpe.decode(d).collect()}
    assert found == {0: "<|endoftext|>The", 1: tokenizer.decode([447]), 2: "’", 3: "", 4: None, 5: ""}


def spell_rows(n=260):
    rng = random.Random(21)
    base = ["".join(rng.choice("aeinrst") for _ in range(rng.choice([5, 6, 6, 7, 8]))) for _ in range(60)] + ["éàlettre", "ÿÿÿÿÿÿÿ", "aaaaaaaaaaaa", "stressed", "desserts"]
    slips = []
    for w in base:
        for _ in range(6):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            slips.append(w[:at] + ("" if kind == 0 else rng.choice("aeinrsté")) + w[at + (kind != 2) :])
    pool = base * 12 + slips * 2
    say = lambda: rng.choice([" ", ", ", " 漢", "3"]).join(w.title() if rng.random() < 0.1 else w for w in (rng.choice(pool) for _ in range(40)))
    return [(k, say()) for k in range(n)] + [(None, say()), (5, "again againn againe " * 9), (5, "again againn againe " * 9), (7, None), (8, ""), (9, "x" * 70_000), (11, "chainword " * 250 + "chainwor " * 45 + "chainwo " * 8)]


def brute_spelling(rows, least_length=6, least_count=5, slips=199, times=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % slips == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    met = {w: [o for o in n if near(w, o)] for w in n}
    best = {w: min(o, key=lambda x: (-n[x], x)) if o else None for w, o in met.items()}
    form = {w: b if b is not None and n[b] >= times * n[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(met[w]), n[form[w]] if form[w] else -1) for w in n)


@pytest.mark.parametrize("cell,slips", [(4, 7), (50, 199), (8192, 199)])
def test_spelling_against_brute_force(spark, cell, slips):
    rows = spell_rows()
    wanted = brute_spelling(rows, slips=slips)
    found = spelling.variants(table(spark, rows), slips=slips, cell=cell).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or -1) for r in found) == wanted
    assert sum(bool(w[1]) for w in wanted) > 5 and (slips == 7 or ("chainwo", "chainwor", "chainword", 8, 1, 45) in wanted)


def test_spelling_of_nothing(spark):
    for rows in ([], [(1, None), (2, ""), (3, "few words")]):
        assert spelling.variants(table(spark, rows)).count() == 0


def test_tree_search_finds_all_points_within_the_radius():
    rng = np.random.default_rng(4)
    codes = rng.integers(97, 103, (900, 7)).astype("uint8")
    codes[:30] = 97  # equal points, more of one letter than its bits hold
    own = spelling.points(codes)
    count = np.stack([(codes == c).sum(1) for c in range(97, 103)], axis=1)
    far = np.abs(count[:, None, :] - count[None, :, :]).sum(2)
    for radius in (1, 2):
        pairs = {(i, j) for a in spelling.range_pairs(own, own, radius) for i, j in zip(*a)}
        assert pairs >= {*zip(*np.nonzero(far <= radius))}
    tree = spelling.top_tree(own, 13)
    home = dict(zip(*spelling.reached(tree, own, 0)))
    assert len(home) == len(own) and len(set(home.values())) == 13
    two = {*zip(*spelling.reached(tree, own, 2))}
    assert all((i, home[j]) in two for i, j in zip(*np.nonzero(far <= 2)))


VECTORS = "vec_id long, embedding array<float>, x string, real string, component string, t string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *"abcd") for i, v in rows], VECTORS).repartition(3)


def test_whitening_against_eigenvectors(spark):
    rng = np.random.default_rng(1)
    data = (rng.normal(size=(300, 12)) @ np.diag(np.geomspace(3, 0.02, 12)) @ rng.normal(size=(12, 12)) + 50).astype("float32")
    rows = [(k, v.tolist()) for k, v in enumerate(data)] + [(1000 + k, data[0].tolist()) for k in range(200)]
    rows += [(None, data[1].tolist()), (1 << 60, data[2].tolist()), (2001, None), (2002, [None] + data[0].tolist()[1:]), (2003, [float("nan")] * 12), (2004, [float("inf")] * 12), (2005, [1.0, 2.0])]
    found = whitening.whiten(vectors(spark, rows)).collect()
    x = np.floor(256 * data.astype("float64")).astype("int64")
    fitted = np.unique(x, axis=0)
    n, sums = len(fitted), fitted.sum(0)
    values, axes = np.linalg.eigh(np.cov(fitted.T.astype("float64"), bias=True))
    assert len(found) == 4 * (300 + 202) and {r.n for r in found} == {n}
    assert max(r.identity_error for r in found) < 1e-9
    for component in (1, 2, 3, 4):
        own = [r for r in found if r.component == component and r.vec_id is not None and r.vec_id < 1000]
        at = [r.vec_id for r in own]
        wanted = (x[at] - sums / n) @ axes[:, -component] / np.sqrt(values[-component])
        got = np.array([r.whitened for r in own])
        assert min(abs(got - wanted).max(), abs(got + wanted).max()) < 1e-9
        assert abs(own[0].explained - values[-component] / values.sum()) < 1e-12
        assert [r.deviation for r in own] == [int(((n * x[k] - sums) ** 2).sum()) for k in at]
    assert sorted(r.vec_id for r in found if r.component == 1 and r.vec_id is not None)[-1] == 1 << 60


def test_whitening_of_few_dimensions_and_nothing(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # one vector spans nothing
    assert whitening.whiten(vectors(spark, [(1, []), (2, None)])).count() == 0
    line = whitening.whiten(vectors(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(9)])).collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)
    assert sorted(round(r.whitened**2, 9) for r in line) == sorted(round((k - 4) ** 2 / (60 / 9), 9) for k in range(9))
    huge = whitening.whiten(vectors(spark, [(1, [1e10, 0.0]), (2, [-1e10, 0.0]), (3, [1e30, 0.0])])).collect()
    assert len(huge) == 2 and all(r.deviation is None for r in huge)


@pytest.mark.parametrize("rank", [3, 8])
def test_factor_and_rotations(rank):
    rng = np.random.default_rng(rank)
    base = rng.normal(size=(8, rank)) * np.geomspace(1, 1e-4, rank)
    scatter = base @ base.T
    factor = whitening.pivoted_cholesky(scatter)
    assert factor.shape[1] == rank and np.allclose(factor @ factor.T, scatter, atol=1e-12)
    values, axes = whitening.jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(scatter)[::-1][:rank], rtol=1e-8)
    assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-12) and np.allclose(scatter @ axes, axes * values, atol=1e-12)


def test_release_deletes_stored_tables_alone(spark, tmp_path):
    import os

    from reconspark.llm import common

    common.release(spark)
    first, second = common.stored(spark.range(5).toDF("a")), common.stored(spark.range(6).toDF("a"))
    other = os.path.join(common.shared_dir(spark).removeprefix("file:"), "table-of-another")
    spark.range(2).write.parquet(other)
    common.drop_stored(first)
    assert second.count() == 6 and common.release(spark) == 1 and common.release(spark) == 0
    assert not os.path.exists(second.stored_path.removeprefix("file:")) and spark.read.parquet(other).count() == 2


def test_toxicity_sample_is_bounded_in_all(spark, monkeypatch):
    from reconspark.llm import toxicity

    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: taken.append((texts, labels)))
    docs = spark.createDataFrame([(k, "ab " * (k % 7 + 1)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    toxicity.fit(docs, labels)
    texts, marks = taken.pop()
    learnt = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5]
    assert sorted(texts) == sorted("ab " * (k % 7 + 1) for k in learnt)  # below the bound all of them
    monkeypatch.setattr(toxicity, "MOST_TOTAL", 300)
    toxicity.fit(docs, labels)
    texts, marks = taken.pop()
    for mark in (0, 1):
        own = [len(t) for t, m in zip(texts, marks) if m == mark]
        assert 300 - 21 < sum(own) <= 300
