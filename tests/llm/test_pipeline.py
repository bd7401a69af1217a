"""The pipeline against a plain version of it."""

import random
from collections import Counter

import corpus_pipeline
from reconspark.llm import simhash
from reconspark.llm.quality import MIN_WORDS


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    say = lambda n: ". ".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(n)) + "."
    good = [say(rng.randint(8, 30)) for _ in range(30)]
    near = good[0] + " extra"
    assert (simhash.fingerprint(near) ^ simhash.fingerprint(good[0])).bit_count() <= 12
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate([*good, *good[:5], "too short", "#$% " * 80, None])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "simhash_dedup", "mix_sources", "best_fit_packing"]
    docs, stages = d, dict(corpus_pipeline.STAGES)
    docs = stages["quality_rules"](spark, docs, "")
    assert {r.doc_id for r in docs.collect()} == set(range(35)) and docs.columns == d.columns
    docs = stages["exact_dedup"](spark, docs, "")
    assert {r.doc_id for r in docs.collect()} == set(range(5, 35)) and docs.columns == d.columns
    docs = stages["simhash_dedup"](spark, docs, "").cache()
    kept = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: simhash.fingerprint(rows[i][1]) for i in range(5, 35)}
    for i in prints:
        assert i in kept or any(((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 4 for j in prints if j != i)
    docs = stages["mix_sources"](spark, docs, "").cache()
    mixed = Counter(r.doc_id for r in docs.collect())
    assert docs.columns == d.columns and set(mixed) <= set(kept) and max(mixed.values()) <= 3
    packed = stages["best_fit_packing"](spark, docs, "")
    assert Counter(r.doc_id for r in packed.where("piece = 0").collect()) == mixed
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.drop("sequence_id", "offset").collect())) == sorted(map(str, packed.drop("sequence_id", "offset").collect()))
    assert MIN_WORDS == 50


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randint(0, 900)}" for _ in range(n))
    a, b, c, d, e, f = (say(60) for _ in range(6))
    rows = [(None, a), (None, b), (None, b.upper()), (7, c), (7, d), (7, d), (9, c.upper()), (8, e), (None, e.upper()), (5, f), (5, f.upper())]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(t.lower() for _, t in kept) == sorted([a, b, c, d, e, f])
    assert {t.lower(): i for i, t in kept} == {a: None, b: None, c: 7, d: 7, e: 8, f: 5}


EDGE = "doc_id long, text string, lang string, source string, n_chars long, row string, own_id string, h string, size string, copies string, label string"


def test_pipeline_on_edge_rows(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(900)]
    say = lambda n: ". ".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(n)) + "."
    a, b, c, long = say(9), say(9), say(9), say(2500)
    rows = [(1, a, "s"), (1, a, "s"), (1, b, None), (None, c, "t"), (None, c, "t"), (2, c, "t"), (3, None, "s"), (4, "", None), (5, long, "u"), (6, long, "u"), (None, None, None)]
    extra = ("r", "o", "h", "z", "c", None)
    for name, own in (("full", rows), ("none", [])):
        (tmp_path / name).mkdir()
        spark.createDataFrame([(i, t, None, s, None, *extra) for i, t, s in own], EDGE).write.parquet(str(tmp_path / name / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    # Kept: a and b under the id that they share, c under its one id, the longer document under its largest id; each as often as the mix takes it.
    assert {r.doc_id for r in out} <= {1, 2, 6} and {r.doc_id for r in out if r.piece == 0} >= {6}
    assert all(r.length <= 2048 for r in out)
    docs = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == [f.split()[0] for f in EDGE.split(", ")]
        seen.append((name, sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").distinct().collect() if r.doc_id is not None)))
    assert seen[0][1] == sorted([(1, a), (1, b), (2, c), (5, long), (6, long)]) and seen[1][1] == seen[2][1] == sorted([(1, a), (1, b), (2, c), (6, long)])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
