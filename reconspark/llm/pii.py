"""PII: patterns first, then information-theoretic sanitisation of the terms that give an entity away.

Base spans (e-mail, ip, card, phone) are found by pattern in whole texts.  Each value found is a protected
entity, and so are its parts (domain, network, issuer, area) and its class.  Over the whole corpus the rows that hold
an entity, a term (outside the base spans), and both give the pointwise mutual information of term and entity.  A term
discloses an entity of a text when the *other* texts say so: with this text left out, the lower confidence bound (Wilson, Z) of the
share of the term's texts that hold the entity puts the PMI at DISCLOSURE * IC(entity) or above.  So a term seen in one text alone tells nothing, however
rare it is, and a value seen once is told only by terms that stand beside values of its class or parts elsewhere.  Everywhere in the texts that
hold the entity the term is then generalised, or removed when the PMI itself is REMOVAL * IC or more.  Copies of a text are one text: counts are
divided by the copies that the pair's texts have on average.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.llm.common import stored, text_or_empty

KINDS = ("email", "ip", "card", "phone")
Z, DISCLOSURE, REMOVAL = 1.645, 0.8, 0.95

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A failed start inside a run of digits fails at every later digit of the run too, so only run starts are tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A term: a run of letters, digits of any script and other characters beyond ASCII punctuation and white space.
TERM_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = re.compile(TERM_GAP.replace("[", "[^", 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail spans: from each @ back over its local part, no further than the last match."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def entity(kind: str, value: str) -> str:
    """The value in one notation, so that spellings of it are one entity."""
    return f"{kind}:{value.lower() if kind == 'email' else re.sub(r'[^0-9.]' if kind == 'ip' else r'[^0-9]', '', value)}"


def entities(kind: str, value: str) -> list[str]:
    """What a value stands for: itself, its class, and its parts (domain, networks of two and three numbers, issuer, area)."""
    whole = entity(kind, value)
    own = whole.partition(":")[2]
    if kind == "ip":
        numbers = own.split(".")
        parts = [".".join(numbers[:2]), ".".join(numbers[:3])]
    else:
        parts = [own.rpartition("@")[2] if kind == "email" else own[:6] if kind == "card" else own[:-7]]
    return [whole, f"{kind} class", *[f"{kind} part:{p}" for p in parts]]


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with white space, as long, for its spans and for the terms that reach into one."""
    out, at = [], 0
    for start, end in sorted((s, e) for _, s, e in spans):
        if TERM.match(text[start]):
            while start > at and TERM.match(text[start - 1]):
                start -= 1
        if TERM.match(text[end - 1]):
            m = TERM.match(text, end)
            end = m.end() if m else end
        start = max(start, at)
        if start < end:
            out += [text[at:start], " " * (end - start)]
            at = end
    return "".join([*out, text[at:]])


def tokens(text: F.Column) -> F.Column:
    """The terms of a text in order, with A-Z and other capitals lowered."""
    return F.array_remove(F.split(F.lower(text), TERM_GAP), "")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans of every row, in one narrow pass: doc_id, text_key, spans, and of rows with spans their entities, masked text and the terms that only spans hold."""
    own = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    @F.pandas_udf("spans array<struct<kind:string,start:long,end:long>>, entities array<string>, masked string")
    def look(texts: pd.Series) -> pd.DataFrame:
        spans = [base_spans(t) for t in texts]
        held = [sorted({e for k, a, b in s for e in entities(k, t[a:b])}) for t, s in zip(texts, spans)]
        masked = [mask(t, s) if s else None for t, s in zip(texts, spans)]
        return pd.DataFrame({"spans": [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], "entities": held, "masked": masked})

    hidden = F.when(F.col("found.masked").isNotNull(), F.array_except(tokens(F.col("text")), tokens(F.col("found.masked"))))
    looked = own.select("doc_id", F.xxhash64("text").alias("text_key"), "text", look("text").alias("found"))
    return looked.select("doc_id", "text_key", "found.spans", "found.entities", "found.masked", hidden.alias("hidden"))


def disclosing(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_key, term, disclosure) of the terms that give an entity of a text away, from counts over all rows.

    A term can only pass when n_term <= n_entity / rate ** (1 - DISCLOSURE), as both <= n_entity; others are left out before the pairs are made.
    """
    bearing = found.where(F.col("masked").isNotNull())
    classes = [f"{k} class" for k in KINDS]
    totals = found.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("entities", c)).alias(c) for c in classes]).first()
    total, rate = float(max(1, totals["n"])), F.col("n_entity") / F.lit(float(max(1, totals["n"])))
    held = bearing.select("text_key", F.explode("entities").alias("entity")).distinct()
    # Classes are few and hot: their counts are literals, the others are joined.
    is_class = F.col("entity").isin(classes)
    n_class = F.coalesce(*[F.when(F.col("entity") == c, F.lit(totals[c])) for c in classes])
    counts = bearing.select(F.explode("entities").alias("entity")).where(~is_class).groupBy("entity").agg(F.count("*").alias("n_entity"))
    known = held.where(is_class).withColumn("n_entity", n_class).unionByName(held.where(~is_class).withColumn("salt", F.xxhash64("entity")).join(counts.withColumn("salt", F.xxhash64("entity")), ["entity", "salt"]).select("text_key", "entity", "n_entity"))
    limit = F.col("n_entity") * F.pow(rate, DISCLOSURE - 1.0) * (1 + 1e-9)
    known = known.where(F.col("n_entity") < total).withColumn("limit", limit)
    most = max(totals[c] for c in classes)
    most = most * (most / total) ** (DISCLOSURE - 1.0) * (1 + 1e-9) if most else 0.0

    # Counted before the join: partial sums of all terms are smaller than their occurrences.
    all_terms = docs.select(F.explode(F.array_distinct(tokens(text_or_empty(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    hidden = bearing.select(F.explode("hidden").alias("term")).groupBy("term").agg(F.count("*").alias("n_hidden"))
    n_term = all_terms.join(hidden, "term", "left").select("term", (F.col("n") - F.coalesce("n_hidden", F.lit(0))).alias("n_term")).where((F.col("n_term") > 1) & (F.col("n_term") <= most))
    near = bearing.select("text_key", F.explode(F.array_distinct(tokens(F.col("masked")))).alias("term")).join(n_term, "term")
    near = near.groupBy("text_key", "term", "n_term").agg(F.count("*").alias("copies"))
    pairs = (
        near.join(known, (near["text_key"] == known["text_key"]) & (near["n_term"] <= known["limit"]))
        .groupBy("entity", "term", "n_entity", "n_term").agg(F.sum("copies").alias("both"), F.count("*").alias("texts"))
        .where("texts > 1")
    )
    # Of the term's other texts, as many as copies leave, the share that holds the entity; its lower bound.
    others = F.greatest(F.col("n_term") * F.col("texts") / F.col("both"), F.col("texts")) - 1
    share = (F.col("texts") - 1) / others
    low = (share + Z * Z / (2 * others) - Z * F.sqrt(share * (1 - share) / others + Z * Z / (4 * others * others))) / (1 + Z * Z / others)
    ic = -F.log2(rate)
    told = pairs.where((ic > 0) & (F.log2(low / rate) >= DISCLOSURE * ic)).select("entity", "term", (F.log2(F.col("both") / F.col("n_term") / rate) / ic).alias("disclosure"))
    # Back to the texts by the terms that pass, which are few, then by the entities that each text holds.
    mine = near.select("text_key", "term", F.xxhash64("term").alias("salt")).join(told.withColumn("salt", F.xxhash64("term")), ["term", "salt"])
    return mine.join(held, ["text_key", "entity"], "left_semi").select("text_key", "term", "disclosure")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms.

    ``spans`` lists base spans by kind and start, then the terms the method adds (kind ``remove`` or ``generalise``).
    Null and empty texts have none.  Repeated rows get equal results; null ids are carried; an empty table
    gives an empty result.  Other columns are ignored.
    """
    found = stored(find(docs, id_col, text_col))
    told = (
        disclosing(docs, found, text_col)
        .groupBy("text_key", "term").agg(F.max("disclosure").alias("disclosure"))
        .groupBy("text_key").agg(F.collect_list(F.struct("term", "disclosure")).alias("told"), F.xxhash64(F.first("text_key")).alias("salt"))
    )

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def place(masked: pd.Series, terms: pd.Series, told: pd.Series) -> pd.Series:
        out = []
        for text, own, hits in zip(masked, terms, told):
            kinds = {h["term"]: "remove" if h["disclosure"] >= REMOVAL else "generalise" for h in (hits if hits is not None else ())}
            marks = [(kinds[t], *m.span()) for t, m in zip(own, TERM.finditer(text), strict=True) if t in kinds] if kinds else []
            out.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(marks)])
        return pd.Series(out, dtype=object)

    # Texts without spans never join; they are most of the rows.
    plain = found.where(F.col("masked").isNull()).select("doc_id", "spans", F.slice("spans", 1, 0).alias("added"))
    joined = found.where(F.col("masked").isNotNull()).withColumn("salt", F.xxhash64("text_key")).join(told, ["text_key", "salt"], "left")
    joined = joined.select("doc_id", "spans", place("masked", tokens(F.col("masked")), "told").alias("added")).unionByName(plain)
    write = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in KINDS]
    return joined.select("doc_id", *counts, F.sha2(write(F.col("spans")), 256).alias("base_sha256"), write(F.concat("spans", "added")).alias("spans"), F.size("added").cast("long").alias("n_terms"))


def sanitise(text: str, spans: str) -> str:
    """The text with its spans (as ``detect`` writes them) taken out: base ones and generalised terms leave their class, removed ones nothing."""
    marks = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x))
    out, at = [], 0
    for start, end, kind in marks:
        if start < at:
            continue
        word = text[start:end]
        out += [text[at:start], {"remove": "", "generalise": "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]"}.get(kind, f"[{kind.upper()}]")]
        at = end
    return "".join([*out, text[at:]])


def base_digest(text: str) -> str:
    return hashlib.sha256(digest(base_spans(text)).encode()).hexdigest()
