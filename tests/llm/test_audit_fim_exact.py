"""Source divergence, fill-in-middle and exact duplicates, each against a plain version of itself."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chunkwright.llm import exact_dedup, fill_in_middle, source_audit
from tests.llm.helpers import SCHEMA, awkward, docs, prose


def frame(spark, rows):
    """rows: doc_id, text, lang, source; with extra columns whose names clash with those that the operators make."""
    found = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    for name in ("term", "p", "size", "rest", "pieces", "form", "key", "group", "row", "next"):
        found = found.withColumn(name, F.lit("x"))
    return found


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def audited(rows, least_docs):
    """Every pair and term from a dense table of counts."""
    groups, held, counts = set(), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= least_docs]
        sources = [s for x, s in groups if x == lang]
        share = lambda n, total: 1 + 10**9 * (n + 2) // (total + 2 * len(kept))
        own = {s: {t: share(counts[lang, s][t], sum(counts[lang, s][k] for k in kept)) for t in kept} for s in sources}
        n = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: share(n[t], sum(n.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(own[s][t], q[t]), t) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, 10)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ordered[:most])}
    return out


def test_audit_matches_dense_counts(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = [w for w in prose(rng, 300).split()] + ["Éclair", "éclair", "straße", "mañana", "日本", "It's", "x_y"]
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "en", "de", None])
        source = rng.choice(["hot", "hot", "hot", "b", "c", None, "d"])
        start = 40 * ord((source or 'a')[0]) % 70
        rows.append((i, " ".join(rng.choice(vocabulary[start:]) for _ in range(rng.randint(0, 40))), lang, source))
    rows += [(None, None, "en", "void"), (None, None, "en", "void"), (7, "", "fr", "a"), (7, "rare words only", "fr", "b"), (8, "one", "it", "alone"), (9, "!!! 123", "en", "signs")]
    got = {tuple(r) for r in source_audit.audit(frame(spark, rows), least_docs=5).collect()}
    assert got == audited(rows, 5)
    assert {r[4] for r in got if r[0] == "fr"} == {0}  # no term is kept there
    monkeypatch.setattr(source_audit, "HELD", 10)  # counts passed on in many parts
    monkeypatch.setattr(source_audit, "OUT_ROWS", 3)
    assert {tuple(r) for r in source_audit.audit(frame(spark, rows), least_docs=5).collect()} == got


def test_audit_ties_go_to_the_smaller_item(spark):
    rows = [(i, "same words here zebra äther", "en", s) for i, s in enumerate(["a", "ä", "z", "Z"] * 10)]
    got = source_audit.audit(frame(spark, rows)).where("source = 'a'").orderBy("rank").collect()
    assert [r["item"] for r in got if r["part"] == "pair"] == ["Z", "z", "ä"] and {r["value"] for r in got} == {0}
    assert not [r for r in got if r["part"] == "term"]  # no share is above its language's


def test_audit_is_exact_beyond_doubles(spark):
    """Shares near 10^9 have squares near 10^18, which doubles round."""
    rows = [(i, "a " * 3000 + f"w{i % 9}", "en", "x") for i in range(20)] + [(i, "b " * 2999 + "a", "en", "y") for i in range(20)]
    assert {tuple(r) for r in source_audit.audit(frame(spark, rows)).collect()} == audited(rows, 10)


def filled(doc_id, text):
    text = text or ""
    pieces = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(pieces), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (n + 1) for x in h[:2])
    prefix, middle, suffix = "".join(pieces[:a]), "".join(pieces[a:b]), "".join(pieces[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, output = "plain", text
    elif h[3] % 100 < 20:
        form, output = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, output = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, None if form == "plain" else len(prefix), None if form == "plain" else len(middle), sha(output), sha(text))


def test_fill_in_middle_matches_a_scan(spark):
    rng = random.Random(3)
    signs = ["a", "Bc", " ", "\n", "\r\n", "é", "ß", "漢", "😀", "👩‍👩‍👧", "́", "<", "<P", "<S", ">", "<M>", "\x00", "\x7f", "0", "…"]
    texts = ["".join(rng.choice(signs if rng.random() < 0.3 else signs[:9]) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += [None, "", " ", "a", "<P>", "ends <", "😀", "😀😀", prose(rng, 4000), "x" * 30000, "?" * 30000]
    rows = [(i if i % 50 else None, t, None, "s") for i, t in enumerate(texts)] * 2
    got = sorted(map(tuple, fill_in_middle.digest(fill_in_middle.transform(frame(spark, rows))).collect()), key=str)
    assert got == sorted((filled(r[0], r[1]) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("grammar, pattern", [("letters", r"[A-Za-z]+|[^A-Za-z]"), ("words", r"(?s)[A-Za-z0-9_]+|[\x20\x09-\x0D]+|."), ("lines", r"[^\n]+|\n"), ("characters", r"(?s).")])
def test_units_are_those_of_the_grammar(spark, grammar, pattern):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["ab", "Z9", "_", " ", "\t\n", "\n", "é", "😀", "-", "."]) for _ in range(rng.randint(0, 30))) for _ in range(200)] + [""]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fill_in_middle.units(F.col("text"), grammar).alias("units")).collect()
    assert all(r["units"] == re.findall(pattern, r["text"]) for r in got)


def deduplicated(rows):
    by = defaultdict(list)
    for doc_id, text, *_ in rows:
        by[lowered(text)].append(doc_id)
    out = []
    for text, ids in by.items():
        known = [i for i in ids if i is not None]
        keep, sha, first = max(known, default=None), hashlib.sha256(text.encode()).hexdigest(), True
        for i in sorted(ids, key=str):
            out.append((i, keep, len(ids), i == keep and first, sha))
            first = first and i != keep
    return sorted(out, key=str)


@pytest.mark.parametrize("block, growth", [(1, 1), (2, 3), (256, 8)])
def test_exact_groups_match_a_dictionary(spark, block, growth):
    rng = random.Random(11)
    texts = ["".join(rng.choice(["a", "A", "b", "É", "é", "😀"]) for _ in range(rng.randint(0, 5))) for _ in range(150)]
    if block > 1:
        long_text = prose(rng, 900)
        texts += [long_text, long_text.upper(), long_text + "x", long_text[:-1], long_text[:255], long_text[:256], long_text[:256], long_text[:257]] + ["Hot copy of one text"] * 90
    rows = [(None if k % 17 == 0 else k % 120, t, "en", "s") for k, t in enumerate(texts)] + [(None, None, None, None)] * 2 + [(None, "only null ids", None, None)] * 3 + [(900, "twice", None, None)] * 2
    rng.shuffle(rows)
    got = [tuple(r) for r in exact_dedup.groups(frame(spark, rows), block, growth).collect()]
    assert sorted(got, key=str) == deduplicated(rows)


def test_one_row_of_each_text_is_kept(spark):
    texts, ids = awkward(random.Random(1))
    got = exact_dedup.groups(docs(spark, texts, ids)).collect()
    assert len(got) == len(texts) and sum(r["kept"] for r in got) == len({lowered(t) for t in texts})


@pytest.mark.parametrize("run", [source_audit.audit, exact_dedup.groups, lambda d: fill_in_middle.digest(fill_in_middle.transform(d))])
def test_empty_tables_give_no_rows(spark, run):
    assert run(frame(spark, [])).count() == 0
