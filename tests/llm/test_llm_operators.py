"""The ten operators on small tables: brute force, edge rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from reconspark.llm import exact_dedup, html_text, licences, mixing, packing, pii, quality, sharding, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size string, h string, chunk string, component_id string, label string"
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "la", "mu", "nu", "xi"]


def texts():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = [say(rng.randint(1, 90)) for _ in range(25)]
    long = say(6000)
    near = long.replace("alpha beta", "alpha Beta", 1) + " tail"
    odd = [None, "", "", " \n\t ", "one", "one", "Ünïcode ẞ İ 😀 " * 5, long, long, near, "a" * 9000, "line one.\n" * 30]
    return base + odd + base[:6] * 3


def table(spark, rows=None):
    own = rows if rows is not None else [(i * 7 % 101, t) for i, t in enumerate(texts())] + [(None, "no id"), (3, "again"), (3, "again")]
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 7 else None, None, "r", "z", "h", "c", "x", "l") for k, (i, t) in enumerate(own)], DOCS).repartition(3)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


RUN = {
    "exact": lambda d: exact_dedup.exact_groups(d),
    "shard": lambda d: sharding.shard(d, n_shards=4),
    "mix": lambda d: mixing.mix(d),
    "quality": lambda d: quality.measure(d),
    "near": lambda d: simhash.near_groups(d),
    "pack": lambda d: packing.pack(d),
    "pii": lambda d: pii.detect(d),
    "toxic": lambda d: toxicity.toxicity(d, d.sparkSession.createDataFrame([], "doc_id long, toxic int")),
    "licence": lambda d: licences.scan(d.withColumn("path", d["source"])),
    "keep_exact": exact_dedup.keep_one,
    "keep_near": simhash.keep_one,
    "keep_good": quality.keep_good,
    "applied": mixing.apply,
}


@pytest.mark.parametrize("name", list(RUN))
def test_empty_table(spark, name):
    assert RUN[name](table(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["exact", "shard", "mix", "quality", "near", "pii", "toxic", "licence"])
def test_one_row_out_for_each_row_in(spark, name):
    d = table(spark)
    assert Counter(r["doc_id"] for r in rows_of(RUN[name](d))) == Counter(r["doc_id"] for r in rows_of(d))


def test_exact_dedup(spark):
    d = table(spark)
    groups = defaultdict(list)
    for r in rows_of(d):
        groups[r["text"] or ""].append(r["doc_id"])
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    seen = Counter()
    for r in rows_of(exact_dedup.exact_groups(d)):
        ids = sha[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        seen[r["text_sha256"]] += r["kept"]
    assert set(seen.values()) == {1}
    kept = exact_dedup.keep_one(d)
    assert kept.columns == d.columns and sorted(r["text"] or "" for r in rows_of(kept)) == sorted(groups)


def test_chunks_cover_texts(spark):
    import regex

    for t in texts():
        if t:
            assert "".join(regex.findall(exact_dedup.chunk_pattern(5, 20), t)) == t


def test_chunks_of_a_small_size_find_the_same_groups(spark):
    d = table(spark)
    key = lambda p: sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in rows_of(exact_dedup.exact_groups(d, pattern=p)))
    assert key(exact_dedup.chunk_pattern(4, 16)) == key(None)


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, near):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_simhash_against_brute_force(spark):
    d = table(spark)
    source = rows_of(d)
    found = rows_of(simhash.near_groups(d))
    assert Counter(r["fingerprint"] for r in found) == Counter(f"{brute_fingerprint(r['text']):016x}" for r in source)
    prints = sorted({int(r["fingerprint"], 16) for r in found})
    group = dict(zip(prints, components(prints, lambda a, b: (a ^ b).bit_count() <= 4)))
    least = defaultdict(list)
    for r in found:
        least[group[int(r["fingerprint"], 16)]] += [] if r["doc_id"] is None else [r["doc_id"]]
    assert all(r["component_id"] == min(least[group[int(r["fingerprint"], 16)]], default=None) for r in found)


@pytest.mark.parametrize("cell", [4, 64, 4096])
def test_trie_join_finds_all_links(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(cell)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(6)}
    values = sorted({*base, *near})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = rows_of(simhash.links(spark.createDataFrame(signed, "fp long")))
    pos = {s[0]: k for k, s in enumerate(signed)}
    assert all((values[pos[r["a"]]] ^ values[pos[r["b"]]]) >= 0 for r in links)
    joined = {frozenset((pos[r["a"]], pos[r["b"]])) for r in links}
    want = components(values, lambda a, b: (a ^ b).bit_count() <= 4)
    got = components(range(len(values)), lambda a, b: frozenset((a, b)) in joined)
    name = lambda c: Counter(frozenset(i for i in range(len(c)) if c[i] == k) for k in set(c))
    assert name(want) == name(got)


def test_shards_are_even_and_keep_groups(spark):
    d = table(spark)
    r = rows_of(sharding.shard(d, n_shards=4))
    per = defaultdict(list)
    for x in r:
        per[x["shard"]].append(x["slot"])
    n = [len(v) for v in per.values()]
    assert max(n) - min(n) <= 1 and all(sorted(v) == list(range(len(v))) for v in per.values())
    text = {}
    for x in rows_of(d):
        text.setdefault(x["doc_id"], x["text"] or "")
    assert all(x["text_crc32"] in {zlib.crc32((y["text"] or "").encode()) for y in rows_of(d) if y["doc_id"] == x["doc_id"]} for x in r)


def split_share(rows, text):
    """Share of the groups of equal text that are on more than one shard."""
    at = defaultdict(set)
    for x in rows:
        at[text[x["doc_id"]]].add(x["shard"])
    linked = {t for t, k in Counter(text.values()).items() if k > 1}
    return sum(len(at[t]) > 1 for t in linked) / max(1, len(linked))


@pytest.mark.parametrize("linked", [1.0, 0.9, 0.5])
def test_groups_stay_together_however_many_rows_are_linked(spark, linked):
    """4000 rows, groups of four, 40 shards."""
    text = {i: f"group {i // 4}" if i < 4000 * linked else f"single {i}" for i in range(4000)}
    d = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    r = rows_of(sharding.shard(d))
    assert set(Counter(x["shard"] for x in r).values()) == {100} and {x["law"] for x in r} == {"rows"}
    assert all(x["size"] == len(text[x["doc_id"]].encode()) + 16 and x["text_crc32"] == zlib.crc32(text[x["doc_id"]].encode()) and x["grown_shard"] is None for x in r)
    share = split_share(r, text)
    print("split", linked, share)
    assert share <= 0.15


def test_exchange_allows_no_shard_to_overflow():
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randint(2, 8)
        wish = {(a, b): rng.randint(1, 50) for a in range(n) for b in range(n) if a != b and rng.random() < 0.6}
        room = {s: rng.randint(0, 30) for s in range(n)}
        share = sharding.allowed(wish, room)
        assert all(0 <= v <= 1 for v in share.values())
        for s in room:
            gain = sum(share[k] * v * ((k[1] == s) - (k[0] == s)) for k, v in wish.items())
            assert gain <= room[s] + 0.1
    assert sharding.allowed({(0, 1): 10, (1, 0): 10}, {0: 0, 1: 0}) == {(0, 1): 1.0, (1, 0): 1.0}


def test_a_hot_group_fills_as_few_shards_as_it_must(spark):
    d = table(spark, [(i, "same text") for i in range(400)] + [(1000 + i, f"other {i}") for i in range(800)])
    r = rows_of(sharding.shard(d, n_shards=12))
    assert len({x["shard"] for x in r if x["doc_id"] < 400}) <= 6
    assert set(Counter(x["shard"] for x in r).values()) == {100}


def water_filled(sizes, most=3):
    """Targets by hand, of sources in their order."""
    weight, total, target = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sizes)}, sum(sizes.values()), {}
    free = set(sizes)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        target |= {s: most * sizes[s] for s in over} if over else share
        free -= over or free
    return target


@pytest.mark.parametrize("sizes", [{"a": 3000, "b": 200, "c": 9000, "d": 100}, {"a": 10, "b": 2, "c": 9000, "d": 70, "e": 64, "f": 1, None: 5}])
def test_mix_targets_and_taken(spark, sizes):
    rng = random.Random(2)
    rows, i = [], 0
    for s, n in sizes.items():
        while n > 0:
            k = min(n, rng.randint(1, 120))
            rows.append((i, " ".join(["w"] * k), s))
            i, n = i + 1, n - k
    rows.append((i, None, "zz"))  # a source without words
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    r = rows_of(mixing.mix(d))
    target = water_filled({**{s: n for s, n in sizes.items() if s}, "zz": 0, **{s: n for s, n in sizes.items() if not s}})
    name = {i: s for i, _, s in rows}
    for s in sizes:
        own = [x for x in r if name[x["doc_id"]] == s]
        assert own[0]["target"] == pytest.approx(target[s]) and own[0]["source_size"] == sizes[s]
        assert abs(sum(x["taken"] for x in own) - target[s]) <= 0.5
        passes = target[s] / sizes[s]  # whole passes take all of a document, the last one whole blocks of it
        assert all(int(passes) * x["size"] <= x["taken"] <= -(-target[s] // sizes[s]) * x["size"] for x in own)
    assert all(x["taken"] <= 3 * x["size"] for x in r)
    assert sorted(map(str, r)) == sorted(map(str, rows_of(mixing.mix(d.repartition(5)))))


def test_mix_takes_repeated_rows_as_often_as_all_of_them(spark):
    d = spark.createDataFrame([(1, "same text here", "a", "x")] * 4 + [(k, f"text number {k} of b", "b", "y") for k in range(10, 90)] + [(None, None, "a", "n")], "doc_id long, text string, source string, rows string")
    want = Counter()
    for x in rows_of(mixing.mix(d)):
        want[x["doc_id"]] += round(x["taken"] / x["size"]) if x["size"] else 0
    got = Counter(x["doc_id"] for x in rows_of(mixing.apply(d)))
    assert got == +want and mixing.apply(d).columns == d.columns


def test_golden_points_are_evenly_spread(spark):
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    phi = (Decimal(5).sqrt() - 1) / 2
    ks = [0, 1, 2, 10**6, 10**12 + 7]
    got = spark.createDataFrame([(k,) for k in ks], "k long").select(mixing.golden_point(__import__("pyspark.sql.functions", fromlist=["col"]).col("k")).alias("x")).collect()
    assert [g["x"] for g in got] == pytest.approx([float((Decimal(k) + Decimal("0.5")) * phi % 1) for k in ks], abs=1e-5)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    d = table(spark)
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = Counter()
    for r in rows_of(d):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for p, s in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[s : first if p == 0 else s + 2048]
            want[(r["doc_id"], p, s, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))] += 1
    found = rows_of(packing.pack(d))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in found])


def check_places(places, capacity=2048):
    per = defaultdict(list)
    for s, o, n in places:
        per[s].append((o, n))
    for own in per.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(per)


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_near_the_bound(seed):
    rng = random.Random(seed)
    histogram = Counter(min(2048, int(rng.lognormvariate(6.3, 1)) + 1) for _ in range(3000))
    places, rank = [], defaultdict(set)
    for length, first, count, sequence, offset in packing.plan(histogram):
        places += [(sequence + k, offset, length) for k in range(count)]
        rank[length] |= set(range(first, first + count))
    assert {k: len(v) for k, v in rank.items()} == dict(histogram) and all(max(v) + 1 == len(v) for v in rank.values())
    assert check_places(places) <= 1.02 * sum(k * v for k, v in histogram.items()) / 2048 + 2


def test_encoder_gives_the_ids_of_tokenizers():
    from tokenizers import Tokenizer
    import public_tokenizers

    t, encode = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)), packing.encoder()
    for text in [*filter(None, texts()), "<|endoftext|> x", "it's 12 we'll　é‍", " " * 3000 + "x", "\x00\x01"]:
        assert list(encode(text)) == t.encode(text, add_special_tokens=False).ids


def test_quality_counts_against_brute_force(spark):
    d = table(spark)
    want = []
    for r in rows_of(d):
        text = r["text"] or ""
        w = split(text)
        count = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if count[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if split(x)]
        want.append((r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    got = rows_of(quality.measure(d))
    assert sorted(map(str, want)) == sorted(str(tuple(r[k] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in got)


def test_quality_lines(spark):
    rng = random.Random(8)
    prose = "\n".join("The " + " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(14)) + "." for _ in range(12))
    junk = "\n".join(f"Home {k} | About {k} | Contact {k} | Terms {k} | Help {k}" for k in range(14))
    d = table(spark, [(1, prose), (2, junk), (3, prose + "\nAccept all cookies\n" + prose.split("\n")[0]), (4, None)])
    assert {r["doc_id"]: r["kept"] for r in rows_of(quality.measure(d))} == {1: True, 2: False, 3: True, 4: False}
    assert {r["doc_id"] for r in rows_of(quality.keep_good(d))} == {1, 3}
    cleaned = {r["doc_id"]: r["text"] for r in rows_of(quality.clean(d))}
    assert cleaned[1] == prose and cleaned[3] == prose and cleaned[2] == "" and cleaned[4] is None


def test_quality_end_marks_and_stock_phrases(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(n))
    prose = "\n".join(f"The {say(14)}." for _ in range(6))
    rows = [
        (1, "\n".join(say(6) for _ in range(20))),  # no line has an end mark
        (2, "\n".join(say(6) + "!" for _ in range(20))),
        (3, f"{say(70)} subscribe {say(74)}"),  # one stock word in a paragraph
        (4, "\n".join(f"Subscribe to the newsletter {k} and follow us here." for k in range(10))),
        (5, "\n".join(["Home", "Products", "About us", "Contact", *(f"Entry {w}" for w in WORDS)] * 2 + [f"Topic {k}" for k in range(30)])),  # a menu, one entry a line
        (6, "\n".join(say(14) for _ in range(8))),  # hard-wrapped prose: long lines without end marks
        (7, prose + "\nA heading without a mark"),
        (8, "\n".join(f"{say(20)} / {say(20)} / {say(20)} / {say(20)}." for _ in range(3))),
    ]
    d = table(spark, rows)
    assert {r["doc_id"]: r["kept"] for r in rows_of(quality.measure(d))} == {1: False, 2: True, 3: True, 4: False, 5: False, 6: True, 7: True, 8: True}
    cleaned = {r["doc_id"]: r["text"] for r in rows_of(quality.clean(d))}
    assert cleaned[1] == cleaned[4] == cleaned[5] == "" and cleaned[7] == prose and cleaned[3] == rows[2][1]


PII_TEXT = "a mail x.y@mail.example.com, ip 10.0.0.255 not 300.1.1.1; card 4532 0151 1283 0366 and 4532-0151-1283-0367, call +1 (555) 010-9999 or +12 34. a@b.c_d@e.f @x.y q@z"


def test_pii_base_spans():
    got = [(k, PII_TEXT[s:e]) for k, s, e in pii.base_spans(PII_TEXT)]
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert [v for k, v in got if k == "email"] == [m[0] for m in email.finditer(PII_TEXT)]
    assert ("ip", "10.0.0.255") in got and not any(v.startswith("300") for _, v in got)
    assert [v for k, v in got if k == "card"] == ["4532 0151 1283 0366"]
    assert [v for k, v in got if k == "phone"] == ["+1 (555) 010-9999"]


def test_emails_equal_the_pattern_everywhere():
    rng, email = random.Random(1), re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(4000):
        t = "".join(rng.choice("ab.@-_ ") for _ in range(rng.randint(0, 25)))
        assert pii.emails(t) == [m.span() for m in email.finditer(t)], t
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(4000):
        t = "".join(rng.choice("12..") for _ in range(rng.randint(0, 25)))
        assert [m.span() for m in pii.IP.finditer(t)] == [m.span() for m in ip.finditer(t)], t


def test_pii_adds_terms_that_give_an_entity_away(spark):
    rng = random.Random(3)
    fill = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(i, fill(20)) for i in range(200)]
    rows += [(300 + i, f"{fill(4)} Zanzibar boss@corp.example.com alpha {fill(6)}") for i in range(6)]
    r = {x["doc_id"]: x for x in rows_of(pii.detect(table(spark, rows)))}
    assert all(r[i]["n_terms"] == 0 and r[i]["spans"] == "" for i in range(200))
    text = dict(rows)[300]
    start = text.index("Zanzibar")
    assert f"remove:{start}:{start + 8}" in r[300]["spans"] and "alpha" not in {text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in r[300]["spans"].split(",")}
    assert r[300]["base_sha256"] == pii.base_digest(text) and r[300]["n_email"] == 1
    assert "[EMAIL]" in pii.sanitise(text, r[300]["spans"]) and "Zanzibar" not in pii.sanitise(text, r[300]["spans"])


def test_pii_learns_from_the_class_and_parts_of_values_seen_once(spark):
    rng = random.Random(6)
    fill = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(i, fill(20)) for i in range(300)]
    rows += [(400 + i, f"{fill(4)} Mailbox u{i}@m{i}.example.com {fill(4)}") for i in range(6)]
    rows += [(500 + i, f"{fill(4)} v{i}@corp.example.com Quux {fill(4)}") for i in range(4)]
    rows += [(600 + i, f"{fill(4)} Intranet 10.1.{i}.{i + 9} {fill(4)}") for i in range(5)]
    r = {x["doc_id"]: x for x in rows_of(pii.detect(table(spark, rows)))}
    for i, t in rows:
        told = {t[int(s.split(":")[1]) : int(s.split(":")[2])] for s in r[i]["spans"].split(",") if s and s.split(":")[0] in ("remove", "generalise")}
        assert told == ({"Mailbox"} if 400 <= i < 500 else {"Quux"} if 500 <= i < 600 else {"Intranet"} if i >= 600 else set()), (i, told)
    assert set(pii.entities("card", "4532 0151 1283 0366")) == {"card:4532015112830366", "card class", "card part:453201"}
    assert set(pii.entities("phone", "+1 (974) 555-3436")) == {"phone:19745553436", "phone class", "phone part:1974"}


def plain_disclosures(rows):
    """{id: terms told} by counting sets of ids for every pair of a term and an entity."""
    from math import log2, sqrt

    spans = {i: pii.base_spans(t) for i, t in rows}
    held = {i: {e for k, a, b in spans[i] for e in pii.entities(k, t[a:b])} for i, t in rows}
    terms = {i: {m[0].lower() for m in pii.TERM.finditer(pii.mask(t, spans[i]))} for i, t in rows}
    where, who = defaultdict(set), defaultdict(set)
    for i, t in rows:
        for x in terms[i]:
            where[x].add(i)
        for e in held[i]:
            who[e].add(i)
    text, told = dict(rows), {}
    for i, _ in rows:
        told[i] = set()
        for e in held[i]:
            rate = len(who[e]) / len(rows)
            for x in terms[i]:
                both = where[x] & who[e]
                distinct = len({text[j] for j in both})
                n = max(len(where[x]) * distinct / len(both), distinct) - 1
                if distinct < 2 or rate == 1:
                    continue
                p, z = (distinct - 1) / n, pii.Z
                low = (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
                if log2(low / rate) >= pii.DISCLOSURE * -log2(rate):
                    told[i].add(x)
    return told


def test_pii_terms_against_brute_force(spark):
    rng = random.Random(31)
    fill = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "a", "or", "ki", "ul"]) for _ in range(n))
    rows = [(i, f"{fill(12)} {rng.choice(['Desk', 'Mailroom', 'Lab', ''])}") for i in range(120)]
    for i in range(200, 300):
        person, word = rng.randrange(12), rng.choice(["Helpline", "Mailroom", "Desk", "Lab"])
        value = [f"p{person}@corp{person % 3}.example.com", f"10.2.{person % 2}.{person}", f"+1 (974) 555-34{person + 20}"][person % 3]
        rows.append((i, f"{fill(3)} {word} name{person} {value} {fill(4)} only{i}"))
    rows += [(300 + k, rows[130 + k][1]) for k in range(6)]
    told = plain_disclosures(rows)
    assert sum(map(len, told.values())) > 50 and not any(x.startswith("only") for v in told.values() for x in v)
    for r in rows_of(pii.detect(table(spark, rows))):
        text = dict(rows)[r["doc_id"]]
        marks = [s.split(":") for s in r["spans"].split(",") if s]
        got = {text[int(a) : int(b)].lower() for k, a, b in marks if k in ("remove", "generalise")}
        assert got == told[r["doc_id"]], r["doc_id"]


def test_pii_a_term_seen_in_one_text_tells_nothing(spark):
    rng = random.Random(32)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(15)) + f" once{i} {f'u{i}@m{i}.example.com' if i % 4 == 0 else ''}") for i in range(200)]
    rows += [(900 + k, rows[0][1]) for k in range(5)]  # copies are no evidence
    assert sum(r["n_terms"] for r in rows_of(pii.detect(table(spark, rows)))) == 0


def test_pii_counts_terms_over_whole_texts(spark):
    rng = random.Random(7)
    fill = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    run = "漢字" * 400
    rows = [(i, fill(20)) for i in range(300)] + [(350 + i, run + "字") for i in range(20)]
    rows += [(400 + i, f"Überschrift {fill(4)}\n{fill(30)} boss@corp.example.com\n{fill(40)} überschrift") for i in range(5)]
    rows += [(500 + i, f"{run}字 10.1.2.{i} {fill(3)}") for i in range(3)] + [(600, "eve@corp2.example.org")]
    r = {x["doc_id"]: x for x in rows_of(pii.detect(table(spark, rows)))}
    for i, t in rows:
        told = [t[int(s.split(":")[1]) : int(s.split(":")[2])] for s in r[i]["spans"].split(",") if s and s.split(":")[0] in ("remove", "generalise")]
        assert told == (["Überschrift", "überschrift"] if 400 <= i < 500 else []), (i, told)
    masked = pii.mask("éa@b.com字x 1", pii.base_spans("éa@b.com字x 1"))
    assert masked == " " * 11 + "1"


def test_toxicity_held_out(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice(WORDS) + rng.choice(["", "s", "en", "ly"]) for _ in range(rng.randint(5, 80))]
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["blargh", "blarghs", "xblargh", "snorfel", "snorfels"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows.append((999, "such a bblarghy thing"))
    out = {x["doc_id"]: x for x in rows_of(toxicity.toxicity(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")))}
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    test = [(bool(y), out[i]["predicted"] == 1) for i, y in labels if out[i]["held_out"]]
    assert sum(a == b for a, b in test) >= 0.95 * len(test) and out[999]["predicted"] == 1
    assert all(0 <= x["score"] <= 1 for x in out.values())


def test_scores_equal_a_plain_reading_of_windows_and_ngrams():
    import math

    import numpy as np

    rng = np.random.default_rng(0)
    w = rng.normal(size=toxicity.BUCKETS).astype("float32")

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * int(toxicity.BASE) + ord(c)) % 2**64
        return (h * int(toxicity.MIX)) % 2**64 >> 47

    def plain(text):
        scores = []
        for word in (text or "").lower().split() or [""]:
            marked = f"<{word}>"
            found = [marked, *(marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1))]
            scores.append(sum(float(w[bucket(g)]) for g in found) / len(found))
        n = min(toxicity.WINDOW, len(scores))
        return 1 / (1 + math.exp(-max(sum(scores[i : i + n]) / n for i in range(len(scores) - n + 1)) - 0.25))

    samples = [None, "", "  ", "a", "Hello you", "a phrase of six words here", "ünï😀 \u3000 x", "x" * 500, *filter(None, texts())]
    assert toxicity.worst_windows(samples, w, 0.25) == pytest.approx([plain(t) for t in samples], abs=1e-6)
    small = toxicity.SLICE
    try:
        toxicity.SLICE = 10
        assert toxicity.worst_windows(samples, w, 0.25) == pytest.approx([plain(t) for t in samples], abs=1e-6)
    finally:
        toxicity.SLICE = small


def test_a_phrase_of_harmless_words_can_be_toxic():
    import numpy as np

    rng, samples, labels = random.Random(4), [], []
    for i in range(600):
        words = [rng.choice(WORDS) for _ in range(rng.randint(4, 40))]
        at = rng.randrange(len(words) - 1)
        words[at : at + 2] = ["omega", "sigma"] if i % 2 else [["omega", "pi"], ["rho", "sigma"], ["rho", "pi"]][i // 2 % 3]
        samples.append(" ".join(words))
        labels.append(i % 2)
    model = toxicity.train(samples[:500], np.array(labels[:500]))
    found = toxicity.worst_windows(samples[500:], *model) >= 0.5
    assert np.mean(found == np.array(labels[500:])) >= 0.95


PAGE = "<html><head><title>T</title><script>var a='</p>'</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News &amp; more</a></li></ul></nav><div class='ad'>Buy now</div><article><h1>Big {0}</h1><p><b>First  paragraph\n of {0} &lt;tag&gt;<br><p>Second one, {1}.</p></article><footer>&copy; someone</footer></body>"


def test_html_main_text(spark):
    pages = [(i, f"http://h/{i}", PAGE.format(WORDS[i % 14], " ".join(WORDS[: i % 14]))) for i in range(60)] + [(None, None, None), (100, "u", ""), (101, "u", "plain  text"), (101, "u", "plain  text")]
    d = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    out = defaultdict(list)
    for r in rows_of(html_text.extract(d)):
        out[r["page_id"]].append(r)
        assert r["n_chars"] == len(r["text"])
    for i in range(60):
        a, b = WORDS[i % 14], " ".join(WORDS[: i % 14])
        assert out[i][0]["text"] == f"Big {a}\n\nFirst paragraph of {a} <tag>\n\nSecond one, {b}."
    assert out[None][0]["text"] == out[100][0]["text"] == "" and [r["text"] for r in out[101]] == ["plain text"] * 2
    assert html_text.extract(d.limit(0)).count() == 0


def test_decoding_keeps_no_child_of_a_dropped_parent():
    import numpy as np

    nodes = html_text.parse("<div><ul><li>a</li><li>b</li></ul></div><article><p>c</p></article>")
    kept = html_text.decode(nodes, np.array([0, -5, -1, 2, 2, 1, 1.0]))
    assert kept == [True, False, False, False, False, True, True]
    assert html_text.decode(nodes, np.array([0, -1, -1, 2, 2, 1, -1.0])) == [True, True, True, True, True, True, False]


def test_decoding_is_the_best_of_all_labellings():
    import itertools

    import numpy as np

    rng = random.Random(12)
    for _ in range(60):
        nodes = [html_text.Node("body", frozenset(), None)]
        for _ in range(rng.randint(1, 8)):
            node = html_text.Node("div", frozenset(), rng.choice(nodes))
            node.parent.children.append(node)
            nodes.append(node)
        odds = np.array([0.0, *(rng.uniform(-3, 3) for _ in nodes[1:])])
        place = {id(n): i for i, n in enumerate(nodes)}
        worth = lambda kept: sum(o for o, k in zip(odds[1:], kept[1:]) if k)
        legal = [k for k in ((True, *rest) for rest in itertools.product([False, True], repeat=len(nodes) - 1)) if all(k[place[id(n.parent)]] or not k[i] for i, n in enumerate(nodes) if i)]
        found = html_text.decode(nodes, odds)
        assert tuple(found) in legal and worth(found) == pytest.approx(max(map(worth, legal)))


def page_of(rng, words):
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    article = "".join(f"<p>{say(rng.randint(8, 60))}</p>" for _ in range(rng.randint(2, 6)))
    return f"<html><head><title>t</title></head><body><nav><ul><li><a href='/'>{say(1)}</a></li><li><a href='/x'>{say(2)}</a></li></ul></nav><div class='ad'>{say(6)}</div><article><h1>{say(5)}</h1>{article}</article><footer>&copy; {say(8)}</footer></body></html>"


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(77)
    return html_text.train([page_of(rng, [w + e for w in WORDS for e in ("", "s", "in", "or")]) for _ in range(80)])


def test_html_layouts_never_seen(trees):
    rng, same, found, wanted = random.Random(5), Counter(), Counter(), Counter()
    for k in range(160):
        nodes = html_text.parse(page_of(rng, [w + e for w in WORDS for e in ("a", "ki", "ul")]))
        labels = html_text.weak_labels(nodes)
        good = html_text.blocks(nodes, [bool(v) for v in labels])
        bad = [b for b in html_text.blocks(nodes, [True] * len(nodes)) if b not in set(good)]
        named = k % 2 == 0
        tree, truth = html_text.labelled(html_text.rendered(good, bad, rng, named))
        want = html_text.blocks(tree, [bool(v) for v in truth])
        got = html_text.blocks(tree, html_text.decode(tree, trees.log_odds(html_text.features(tree))))
        same[named] += want == got
        wanted[named] += len(" ".join(want).split())
        found[named] += sum((Counter(" ".join(want).split()) & Counter(" ".join(got).split())).values())
    for named in (True, False):
        assert same[named] >= 0.9 * 80 and found[named] >= 0.95 * wanted[named], (named, same, found, wanted)


def test_html_unclosed_tags_loose_text_and_long_pages(trees):
    text = lambda page: html_text.main_text(page, trees)
    long = "One long sentence of the article, with many words in it, goes here."
    assert text(f"<head><title>x</title><body><article><p>{long}</p></article>") == long
    every = lambda page: html_text.blocks(n := html_text.parse(page), [True] * len(n))
    for control in ("button", "select"):
        assert every(f"<body><article><p>{long}</p><{control}>Go<p>{long}</p></article><{control}>x</{control}></body>") == [long, long]
        assert every(f"<body><article><p>{long}</p><p>{long} <{control}>Go</{control}>end.</p></article></body>") == [long, f"{long} end."]
    assert every(f"<head><meta charset=x><title>t</title><p>{long}") == [long]
    assert every(f"<div>a</div>{long}<br><br>{long}<div>b</div> tail") == ["a", f"{long} {long}", "b", "tail"]
    assert text("just <b>text</b>") == "just text" and text("<br>") == "" and text("   ") == ""
    many = "".join(f"<p>{long} {i}</p>" for i in range(20_000))
    assert len(text(f"<body><nav><a href='/'>Home</a></nav><article>{many}</article></body>").split("\n\n")) == 20_000


FIRST = "The harbour was built in three stages, and each of them took longer than the town had planned."
SECOND = "When the last crane went up, nobody could say what the whole of it had cost; the books were lost."
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>All stories</a></li></ul></nav>"
#: Pages written by hand: (page, blocks of its article).
LAYOUTS = [
    (f"<body>{NAV}<article><h1>The harbour</h1><p>{FIRST}</p><table><tr><th>Year</th><th>Ships</th></tr><tr><td>2020</td><td>{SECOND}</td></tr></table></article></body>", ["The harbour", FIRST, "Year", "Ships", "2020", SECOND]),
    (f"<body>{NAV}<article><h1>The harbour</h1><p>{FIRST}</p><details><summary>More</summary><p>{SECOND}</p></details></article><footer>&copy; us</footer></body>", ["The harbour", FIRST, "More", SECOND]),
    (f"<body>{NAV}<article><h1>The harbour</h1><p>{FIRST}</p><p>{SECOND}</p><footer><p>Tags: ships, towns</p></footer></article><footer>&copy; us</footer></body>", ["The harbour", FIRST, SECOND]),
    (f"<body>{NAV}<article class='post side'><h1>The harbour</h1><p>{FIRST}</p><p>{SECOND}</p><div class='comment-body'>My comment</div></article></body>", ["The harbour", FIRST, SECOND]),
    (f"<body><div class='topbar'><a href='/'>Home</a></div><div id='content'><h2>The harbour</h2><dl><dt>Pier</dt><dd>{FIRST}</dd></dl><p>{SECOND}</p></div><div class='cookie-banner'>We use cookies</div></body>", ["The harbour", "Pier", FIRST, SECOND]),
    (f"<body><main><p>{FIRST}</p><figure><img src='a.png'><figcaption>The pier in spring</figcaption></figure><p>{SECOND}</p></main><aside><h3>Related</h3><p>Other things</p></aside></body>", [FIRST, "The pier in spring", SECOND]),
    (f"<body><main><article><h1>The harbour</h1><p>{FIRST}</p><ul><li>Cranes</li><li>Ships</li></ul><p>{SECOND}</p></article></main><section id='comments'><h3>2 comments</h3><p>I was there, nice.</p></section></body>", ["The harbour", FIRST, "Cranes", "Ships", SECOND]),
    (f"<body><article><svg><path d=1><p>{FIRST}</p><p>{SECOND}</p></article></body>", [FIRST, SECOND]),
    (f"<body><article><p>{FIRST}</p><noscript><p>{SECOND}</p></article></body>", [FIRST, SECOND]),
]


@pytest.mark.parametrize("k", range(len(LAYOUTS)))
def test_html_layouts_written_by_hand(trees, k):
    page, want = LAYOUTS[k]
    assert html_text.main_text(page, trees).split("\n\n") == want


def test_html_rows_of_one_id_are_extracted_each_by_its_own(spark):
    page = lambda text: f"<body>{NAV}<article><h1>Title</h1><p>{text}</p></article></body>"
    found = rows_of(html_text.extract(spark.createDataFrame([(1, "u", page(FIRST)), (1, "u", page(SECOND)), (1, "u", page(SECOND))], "page_id long, url string, html string")))
    assert Counter(r["text"] for r in found) == {f"Title\n\n{FIRST}": 1, f"Title\n\n{SECOND}": 2}


def test_licences(spark):
    files = [
        (1, "a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (2, "a/b/code.py", "no statement here"), (3, "a/b/c/LICENSE.txt", "Licensed under the Apache License, Version 2.0"), (4, "a/b/c/d/x.py", "nothing"),
        (5, "a/b/own.py", "text before.\nThis work is licensed under the GNU General Public License, version 3.\nand after " + "word " * 50), (6, "z/y.py", "nothing"), (7, None, None), (8, "a/b/code.py", ""),
        (9, "q/t.py", "a driving licence was shown to the officer at the gate"),
    ]
    d = spark.createDataFrame([(*f, "x", "y") for f in files], "doc_id long, path string, text string, dir string, licence string")
    r = {x["doc_id"]: (x["licence"], x["basis"], x["licence_dir"]) for x in rows_of(licences.scan(d))}
    assert r == {1: ("MIT", "own", None), 2: ("MIT", "inherited", "a"), 3: ("Apache-2.0", "own", None), 4: ("Apache-2.0", "inherited", "a/b/c"), 5: ("GPL-3.0", "own", None), 6: (None, "none", None), 7: (None, "none", None), 8: ("MIT", "inherited", "a"), 9: (None, "none", None)}


def plain_licences(files):
    """The scan in plain Python: passages, cosines, inheritance."""
    import math

    word = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")
    known = {w for _, b in licences.TEMPLATES for w in word.findall(b.lower())} - set(licences.STOP)
    join = lambda p: " ".join(p.split())
    candidate = lambda p: len(set(word.findall(p.lower())) & known) >= licences.SHARED
    said = {}
    for i, path, text, *_ in files:
        bare = "\n".join(re.sub(r"^[ \t]*(?:/\*+|\*+/|//+|\*|#+|--|;+|<!--|-->)?[ \t]*|[ \t]*(?:\*+/|-->)?[ \t]*$", "", x) for x in (text or "").split("\n"))
        held = [p for p in re.split(r"\n[ \t\r]*\n\s*", bare) if candidate(p)]
        parts = {q for p in held for q in (join(p), *map(join, p.split("\n")), *re.split(r"(?<=[.;])\s+(?=[A-Z])", join(p))) if candidate(q)}
        said[i, path] = (parts, join(bare) if held else None)
    every = sorted({q for parts, whole in said.values() for q in {*parts, *([whole] if whole else [])}})
    docs = {q: Counter(word.findall(q.lower())) for q in every}
    temps = [(n, Counter(word.findall(b.lower()))) for n, b in licences.TEMPLATES]
    df = Counter(w for c in [*docs.values(), *(c for _, c in temps)] for w in c)
    n = len(docs) + len(temps)
    vec = lambda c: {w: k * (math.log(n / df[w]) + 1) for w, k in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    best = {}
    for q, c in docs.items():
        v = vec(c)
        score, _, name = max((round(sum(v[w] * t.get(w, 0) for w in v) / norm(v) / norm(t), 6), -k, m) for k, (m, t) in enumerate((m, vec(t)) for m, t in temps))
        if score >= licences.THRESHOLD:
            best[q] = (name, score)
    own, holders, out = {}, {}, {}
    for key, (parts, whole) in said.items():
        hits = sorted((-best[q][1], best[q][0]) for q in {*parts, *([whole] if whole else [])} if q in best)
        own[key] = hits[0] if hits else None
        i, path = key
        if hits and path is not None and (re.search(licences.FILE_NAME, path) or (whole in best and best[whole][1] >= licences.FILE_COSINE)):
            holders.setdefault(path.rpartition("/")[0], []).append((hits[0][0], path, hits[0][1]))
    for (i, path), hit in own.items():
        if hit:
            out[i] = (hit[1], "own", None)
            continue
        parts = path.split("/")[:-1] if path is not None else None
        dirs = ["/".join(parts[:k]) for k in range(len(parts), -1, -1)] if parts is not None else []
        at = next((x for x in dirs if x in holders), None)
        out[i] = (min(holders[at])[2], "inherited", at) if at is not None else (None, "none", None)
    return out


def test_licence_scan_against_brute_force(spark):
    rng, word = random.Random(10), lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    half = bsd.split()
    wrapped = "/*\n * " + "\n * ".join([" ".join(half[:7]), " ".join(half[7:13]), " ".join(half[13:])]) + "\n */\nint main;"
    files = [
        (1, "a/LICENSE", bsd), (2, "a/b/c.py", wrapped), (3, "a/d.py", word(9)), (4, "z/e.txt", f"{word(30)}\nLicensed under CC BY-NC 4.0.\n{word(20)}"),
        (5, "z/f.txt", word(12)), (6, "y/MIT.txt", "Released under the MIT License."), (7, "y/k/g.txt", word(5)), (8, "y/k/h.txt", f"A driving license was shown to the mit officer. {word(40)}"), (9, None, "Released under the ISC License"), (10, "q/x", None), (11, "q/y", ""),
        (12, "a/b/i.py", "# " + "\n# ".join(["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License"]) + f"\n\n{word(8)}"),
        (13, "m/COPYING", f"{word(400)}\n\nLicensed under the Apache License, Version 2.0"), (14, "m/n/o.py", word(4)), (15, "top.txt", word(3)),
    ]
    d = spark.createDataFrame([(*f, "x", "y") for f in files], "doc_id long, path string, text string, dir string, licence string")
    got = {x["doc_id"]: (x["licence"], x["basis"], x["licence_dir"]) for x in rows_of(licences.scan(d))}
    assert got == plain_licences(files)
    assert got[1][0] == got[2][0] == got[3][0] == "BSD-3-Clause" and got[3][1] == "inherited" and got[5][1] == "none" and got[7] == ("MIT", "inherited", "y") and got[12][0] == "GPL-3.0" and got[14] == ("Apache-2.0", "inherited", "m")


def test_labels_without_rows_predict_nothing(spark):
    assert {r["predicted"] for r in rows_of(RUN["toxic"](table(spark)))} == {0}


def test_few_labels_are_enough(spark):
    rng = random.Random(12)
    mild = ["river", "garden", "window", "music", "bread", "paper", "summer", "train", "letter", "stone"]
    bad = ["vilescum", "hatefool", "trashling"]
    docs = [(k, " ".join(rng.choice(mild) for _ in range(30)) + (f" you {rng.choice(bad)} " if k < 30 else " ")) for k in range(60)]
    learn = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    labels = [(k, int(k < 30)) for k in [k for k in learn if k < 30][:8] + [k for k in learn if k >= 30][:8]]
    found = {r["doc_id"]: r["score"] for r in rows_of(toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")))}
    assert min(found[k] for k in range(30)) > max(found[k] for k in range(30, 60)) and all((found[k] >= 0.5) == (k < 30) for k in found)


def test_a_table_of_long_pages_alone(spark):
    paragraphs = [f"This is paragraph number {k} of the article, it speaks of many things at some length." for k in range(3000)]
    page = "<html><body><nav><ul>" + "".join(f"<li><a href='#'>Link {k}</a></li>" for k in range(8)) + "</ul></nav><article><h1>A title of it</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article><footer><p>Copyright us</p></footer></body></html>"
    assert len(page) > html_text.MOST_CHARS
    found = rows_of(html_text.extract(spark.createDataFrame([(1, "u", page), (2, "v", None), (3, "w", page)], "page_id long, url string, html string")))
    assert {r["page_id"]: r["text"] for r in found} == {1: "\n\n".join(["A title of it", *paragraphs]), 2: "", 3: "\n\n".join(["A title of it", *paragraphs])}
    assert html_text.main_text(f"<article><p>{paragraphs[0]}</p><p>{paragraphs[1]}</p></article>", html_text.train([])) == "\n\n".join(paragraphs[:2])
