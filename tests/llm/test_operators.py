"""The ten operators against brute force, and on awkward tables."""

from __future__ import annotations

import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwright.llm import decontaminate, html_blocks, link_trust, order_minhash, packing, repetition, secret_scan, sharding, suffix_repeats, toxicity
from chunkwright.llm.common import WordIds, occurrences, shingle_hashes
from tests.llm.helpers import SCHEMA, awkward, docs, prose, words

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    texts, ids = awkward(random.Random(1))
    frame = docs(spark, texts, ids)
    for name in ("key", "hash", "__pid", "owner", "length", "position", "bucket", "label", "size"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# secrets


def brute_spans(text: str) -> list[tuple[int, str, int]]:
    kinds = (
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
    )
    found = [(m.start(), k, name, m.end()) for k, (name, p, group, least) in enumerate(kinds) for m in p.finditer(text) if len(m[group]) >= least]
    return [(s, name, e) for s, _, name, e in sorted(found)]


def test_secrets_match_brute_force(spark):
    rng = random.Random(3)
    bits = ["password: ", 'Token = "', "API_KEY=", "apikey:'", "secret", "AKIA" + "A1B2" * 4, "AKIAX", "0123456789abcdef" * 2, "deadbeef", "é😀 ", "passwd=short ", "x" * 9, "Ab3" * 8, "password:token:abcdefghij", " ", "\n", "="]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(150)] + [None]
    got = {r["doc_id"]: r for r in secret_scan.digest(secret_scan.scan(docs(spark, texts), ["source"], ["source", "lang"])).collect()}
    import hashlib

    for i, text in enumerate(texts):
        spans = brute_spans(text or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, k, e in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), text
        counts = Counter(k for _, k, _ in spans)
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == (counts["assign"], counts["access"], counts["hex"])
        assert set(filter(None, joined.split(","))) <= set(got[i]["spans"].split(","))


def test_secrets_match_sql_where_values_are_shared(spark):
    import duckdb

    rng = random.Random(47)
    values = ["".join(rng.choice("abcdefgh") + rng.choice("ABCDEFGH") + rng.choice("0123456789") for _ in range(9)) for _ in range(12)]
    rows = []
    for i in range(300):
        bits = [rng.choice(values[: 3 + i % 10]) if rng.random() < 0.5 else f"own{i}Aa{rng.randrange(10**12)}x" * 2 for _ in range(rng.randint(0, 4))]
        text = " ".join(rng.choice(["see {}", "token={}", "password: '{}'", "{} AKIA1234567890ABCD", "é {} 0123456789abcdef0123456789abcdef"]).format(b) for b in bits)
        rows.append((i % 290, text if i % 50 else None, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", None]), None))
    frame = spark.createDataFrame(rows, SCHEMA)
    got = secret_scan.digest(secret_scan.scan(frame, ["source"], ["source", "lang"])).toPandas()
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    want = con.execute(secret_scan.ORACLE).df()
    key = lambda d: sorted(map(tuple, d[["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_examples", "n_owned"]].astype(object).itertuples(index=False)))
    assert key(got) == key(want) and got.spans.str.contains("live").sum() > 20 and got.n_examples.sum() > 20


def test_bare_tokens_are_spans_only_if_one_owner_has_them(spark):
    own, common = "Zx9" * 8, "Qw7" * 8
    rows = [(1, f"a {own} b", "en", "a", 1), (2, common, "en", "a", 1), (3, common, "en", "b", 1), (4, common, "en", "c", 1)]
    got = {r["doc_id"]: r for r in secret_scan.digest(secret_scan.scan(spark.createDataFrame(rows, SCHEMA), ["source"], ["source"])).collect()}
    assert got[1]["spans"] == f"live:2:{2 + len(own)}"
    assert [got[i]["spans"] for i in (2, 3, 4)] == [""] * 3 and got[2]["n_examples"] == 1


def test_redaction_replaces_owned_secrets_and_keeps_rows(spark):
    rows = [(1, "x password=abcdefgh1 y", "en", "a", 22), (2, None, "en", None, None), (3, "plain", "en", "b", 5)]
    got = {r["doc_id"]: r for r in secret_scan.redact(spark.createDataFrame(rows, SCHEMA), ["source"], ["source"]).collect()}
    assert got[1]["text"] == "x [secret] y" and got[1]["n_chars"] == len("x [secret] y")
    assert got[2]["text"] is None and got[3]["text"] == "plain"


# near duplicates


def near_copies(rng: random.Random) -> list:
    base = [words(rng, rng.randint(4, 200)) for _ in range(12)]
    texts = []
    for b in base:
        for edits in (0, 0, 1, 2, len(b) // 30, len(b) // 8):
            copy = list(b)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "zz" + str(rng.randrange(10**6))
            texts.append(" ".join(copy))
    return texts + [None, "", "...", prose(rng, 300)]


def family(rng: random.Random) -> list:
    """Copies of one text with few and many edits, so that many share bands and only some are similar, in several components."""
    base = words(rng, 150)
    texts = []
    for i in range(90):
        copy = list(base)
        for _ in range(i % 13):
            copy[rng.randrange(len(copy))] = "yy" + str(rng.randrange(10**6))
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("make", [near_copies, family])
def test_near_duplicate_classes_match_brute_force(spark, make):
    texts = make(random.Random(5))
    ids = WordIds()
    x = [order_minhash.labelled_shingles(t or "", ids) for t in texts]
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if order_minhash.similarity(x[i], x[j]) >= 0.8:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(docs(spark, texts)).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_banded_alignment_equals_full_alignment():
    rng = random.Random(7)
    for _ in range(60):
        a = words(rng, rng.randint(5, 40))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 2)] = words(rng, rng.randint(0, 2))
        ids = WordIds()
        x, y = (order_minhash.labelled_shingles(" ".join(w), ids) for w in (a, b))
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
        chained = table[-1, -1]
        full = chained / (len(x) + len(y) - chained)
        got = order_minhash.similarity(x, y)
        assert got == pytest.approx(full) if full >= 0.8 else got < 0.8


def test_swapped_halves_are_no_near_duplicates():
    rng = random.Random(9)
    a, b = words(rng, 200), words(rng, 200)
    ids = WordIds()
    assert order_minhash.similarity(order_minhash.labelled_shingles(" ".join(a + b), ids), order_minhash.labelled_shingles(" ".join(b + a), ids)) < 0.8


def test_deduplicate_keeps_one_row_for_each_class(spark, odd):
    frame = docs(spark, near_copies(random.Random(5)))
    kept = order_minhash.deduplicate(frame)
    assert kept.columns == frame.columns
    want = order_minhash.classes(frame).select("class_id").distinct().count()
    assert kept.count() == want == kept.select("doc_id").distinct().count()
    rows = order_minhash.deduplicate(odd)
    assert rows.columns == odd.columns and rows.count() == order_minhash.classes(odd).select("class_id", "rep_key").distinct().count()


# toxicity


def test_grammar_tells_ways_apart():
    g = toxicity.Grammar({"scum": 3.0}, {"idio": 2.0})
    n, r, a, t = toxicity.NEGATED, toxicity.REPORTED, toxicity.AIMED, toxicity.THREAT_WEIGHT
    for text, want in {
        "what scum.": [3], "you are scum": [3 * a], "scum you are": [3 * a], "not a scum": [3 * n], "not one of the usual scum": [3], "they said he is an idiot": [2 * r * a], "said: idiot": [2],
        "i will kill you": [t], "you i will kill": [t], "never kill you": [t * n], "kill the lights": [], "he said. scum": [3], "a fine day": [], "scum! you, kill time": [3, t], "he wrote never scum": [3 * n * r * a],
    }.items():
        assert g.clauses(text) == pytest.approx(want), text
    strength = lambda text: g.read(text)[0]
    assert strength("not scum") < strength("they called it scum") < strength("scum") < strength("you scum")


def brute_clauses(text: str, words: dict, beginnings: dict) -> list[float]:
    """The grammar without an automaton: each clause is looked over for what it holds."""
    found = []
    for clause in re.split(r"[.!?;:\n]", text):
        tokens = [t.lower() for t in re.findall(r"[^\W_]+(?:['’][^\W_]+)?", clause)]
        aimed = any(t in toxicity.TARGETS for t in tokens)
        total = 0.0
        for i, t in enumerate(tokens):
            closed = t in toxicity.TARGETS + toxicity.NEGATIONS + toxicity.REPORTS
            weight = 0.0 if closed else aimed * toxicity.THREAT_WEIGHT if t in toxicity.THREATS else toxicity.AIMED**aimed * (words.get(t) or max((w for b, w in beginnings.items() if t.startswith(b)), default=0.0))
            weight *= toxicity.NEGATED if any(x in toxicity.NEGATIONS for x in tokens[max(0, i - toxicity.NEGATION_REACH) : i]) else 1
            total += weight * (toxicity.REPORTED if any(x in toxicity.REPORTS for x in tokens[:i]) else 1)
        found += [total] if total else []
    return found


def test_automaton_matches_brute_force():
    rng = random.Random(43)
    words_, beginnings = {"scum": 3.0, "rat": 1.5}, {"idio": 2.0, "vil": 2.5}
    g = toxicity.Grammar(words_, beginnings)
    pool = "scum rat ratty idiot vile villain you him not never said dit kill tuer a fine day isn't ! . ; : \n".split(" ")
    for _ in range(400):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        assert g.clauses(text) == pytest.approx(brute_clauses(text, words_, beginnings)), text


def test_toxicity_is_learned_and_holds_on_the_held_out_fold(spark):
    rng = random.Random(11)
    texts, labels = [], []
    for i in range(600):
        text, toxic = words(rng, 30), i % 5 == 0
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(30), rng.choice(["grub", "mudface", "vilekin", "vilest", "vilen"]))
        texts.append(" ".join(text))
        labels.append((i, 1, int(toxic)))
    got = toxicity.score(docs(spark, texts), spark.createDataFrame(labels, LABELS)).toPandas().sort_values("doc_id")
    fold = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id])
    assert (got.held_out.to_numpy() == fold).all()
    truth = np.array([t for *_, t in labels])
    assert ((got.predicted.to_numpy() == truth) | ~fold).mean() > 0.98
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


def test_toxicity_without_labels_scores_nothing(spark, odd):
    got = toxicity.score(odd, spark.createDataFrame([], LABELS)).collect()
    assert len(got) == odd.count() and all(r["score"] == 0 and r["predicted"] == 0 for r in got)
    assert toxicity.keep_clean(odd, spark.createDataFrame([], LABELS)).columns == odd.columns


# quality


def brute_quality(text: str) -> tuple:
    w = re.findall(r"[^ \t-\r]+", text)
    counted = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if counted[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^ \t-\r]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def brute_coverage(text: str, n: int) -> int:
    w = re.findall(r"[^ \t-\r]+", text)
    counted = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    inside = {j for i in range(len(w) - n + 1) if counted[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
    return sum(len(w[j]) for j in inside)


def test_quality_matches_brute_force():
    rng, meter = random.Random(13), repetition.Meter(most_words=50)
    for _ in range(120):
        pool = words(rng, rng.randint(1, 30))
        text = "".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "\t", " ", " # ", "\x0b"]) for _ in range(rng.randint(0, 120))) * rng.choice([1, 1, 2])
        got = meter(text)
        assert tuple(got[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute_quality(text)
        for n in repetition.COVERAGE:
            assert got[f"dup_chars_{n}"] == brute_coverage(text, n)


def test_quality_keeps_prose_and_drops_repeats(spark, odd):
    rng = random.Random(15)
    clean, junk = prose(rng, 200), "buy now and save on all of it today friends " * 40
    got = {r["doc_id"]: r for r in repetition.measure(docs(spark, [clean, junk])).collect()}
    assert got[0]["kept"] and not got[1]["kept"]
    assert repetition.measure(odd).count() == odd.count()


# links


PAGES = "page_id long, url string, html string"


def test_urls_follow_rules_and_links(spark):
    rows = [
        (1, "http://Good.org/fr/a?x#y", '<a href="https://friend.info/">f</a>'), (2, "https://a.example.net/en/b", None), (3, "http://x.net/a", '<a href="http://friend.info">f</a>'),
        (4, "https://example.com/de/q", ""), (5, "https://friend.info/", ""), (6, "https://feeder.biz/", '<a href="https://x.net/">x</a>'), (7, None, None), (8, "no scheme", ""), (9, "http://other.org/en/", ""), (1, "http://Good.org/fr/a?x#y", None),
    ]
    got = {r["page_id"]: r for r in link_trust.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("good.org", "/fr/a", "org/fr/", "allow")
    assert got[2]["rule"] == "example.net/en/" and got[3]["verdict"] == "block" and got[4]["rule"] == "example.com/de/"
    assert got[5]["verdict"] == "allow" and got[5]["trust"] > 0 and got[6]["verdict"] == "block" and got[6]["rule"] is None
    assert got[7]["host"] == got[8]["host"] == "" and got[7]["verdict"] == "allow" and got[9]["verdict"] == "allow"


def brute_ranks(hosts: list, links: list, seed: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Personalised PageRank as a dense power iteration, in units of the seeds' mean rank."""
    at = {h: i for i, h in enumerate(hosts)}
    move = np.zeros((len(hosts), len(hosts)))
    for a, b, n in links:
        move[at[a], at[b]] += n
    out = move.sum(axis=1)
    move[out > 0] /= out[out > 0, None]
    rank = seed.copy()
    for _ in range(rounds):
        rank = 0.15 * seed + 0.85 * (rank @ move + rank[out == 0].sum() * seed / seed.sum())
    return rank * (seed @ seed) / (rank @ seed)


@pytest.mark.parametrize("n_hosts, n_links, close", [(8, 20, 1e-5), (2000, 6000, 1e-3)])
def test_propagation_matches_power_iteration(spark, n_hosts, n_links, close):
    rng = random.Random(17)
    hosts = [f"h{i}" for i in range(n_hosts)]
    links = sorted({(rng.choice(hosts), hosts[int(n_hosts * rng.random() ** 2)]) for _ in range(n_links)})
    links = [(a, b, rng.randint(1, 3)) for a, b in links if a != b]
    seeds = [(h, float(i % 4 == 0) * rng.random(), float(i % 7 == 1)) for i, h in enumerate(hosts)]
    frame = spark.createDataFrame(seeds, "host string, trust_seed double, distrust_seed double")
    got = {r["host"]: r for r in link_trust.propagate(frame, spark.createDataFrame(links, "src string, dst string, n long"), close=close).collect()}
    trust = brute_ranks(hosts, links, np.array([s[1] for s in seeds]))
    distrust = brute_ranks(hosts, [(b, a, n) for a, b, n in links], np.array([s[2] for s in seeds]))
    assert len(got) == n_hosts
    for i, h in enumerate(hosts):
        assert got[h]["trust"] == pytest.approx(trust[i], abs=5 * close) and got[h]["distrust"] == pytest.approx(distrust[i], abs=5 * close)


def test_links_decide_where_no_rule_fits(spark):
    """Farms that link to blocked hosts are blocked, what allowed hosts link to isn't, whatever else links there."""
    link = lambda *to: "".join(f'<p><a class=x href="http://{h}/p">x</a>' for h in to)
    rows = [(1, "http://bad.net/a", ""), (2, "http://worse.net/b", ""), (3, "http://good.org/fr/a", link("friend.info", "both.info")), (4, "http://fine.org/fr/b", link("friend.info", "both.info"))]
    rows += [(10 + i, f"http://farm{i}.biz/", link("bad.net", "worse.net", "both.info")) for i in range(3)] + [(20, "http://friend.info/", ""), (21, "http://both.info/", link("friend.info")), (22, "http://alone.com/", "")]
    got = {r["page_id"]: r["verdict"] for r in link_trust.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 10: "block", 11: "block", 12: "block", 20: "allow", 21: "allow", 22: "allow"}


def test_urls_of_awkward_pages(spark):
    rows = [(None, None, None), (1, "http://a.net/x", "<a href='http://b.org/'>b</a>"), (1, "http://a.net/x", "<a href='http://b.org/'>b</a>"), (2, "", "x" * 100_000), (3, "HTTP://A.NET?q", None)]
    frame = spark.createDataFrame(rows, PAGES)
    for name in ("host", "path", "rule", "ruled", "trust", "rank", "kind", "seed"):
        frame = frame.withColumn(name, F.lit("clash"))
    got = link_trust.judge(frame).collect()
    assert sorted((r["page_id"] or 0, r["host"], r["path"], r["verdict"]) for r in got) == [(0, "", "", "allow"), (1, "a.net", "/x", "block"), (1, "a.net", "/x", "block"), (2, "", "", "allow"), (3, "a.net", "", "block")]


# repeats


def brute_repeats(texts: list[str]) -> set[tuple[int, int]]:
    places = defaultdict(list)
    for i, text in enumerate(texts):
        w = (text or "").split()
        for j in range(len(w) - 49):
            places[tuple(w[j : j + 50])].append((i, j))
    return {(i, k) for found in places.values() if len({i for i, _ in found}) > 1 for i, j in found for k in range(j, j + 50)}


def test_repeats_match_brute_force(spark):
    rng = random.Random(19)
    passages = [" ".join(words(rng, n)) for n in (45, 50, 55, 70, 130)]
    texts = []
    for _ in range(40):
        parts = [" ".join(words(rng, rng.randint(5, 120)))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            parts += [p, " ".join(words(rng, rng.randint(5, 60)))]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[1], None, "", "short"]
    got = {(r["doc_id"], k) for r in suffix_repeats.repeats(docs(spark, texts)).collect() for k in range(r["start_word"], r["end_word"])}
    assert got == brute_repeats(texts)


def test_repeats_within_one_text_do_not_count(spark):
    text = " ".join(words(random.Random(21), 60))
    assert suffix_repeats.repeats(docs(spark, [f"{text} {text}", "other"])).count() == 0


def test_repeats_are_found_where_one_text_fills_partitions(spark):
    rng = random.Random(37)
    passage = " ".join(words(rng, 60))
    hot = " ".join(f"{passage} {' '.join(words(rng, 10))}" for _ in range(300))
    texts = [hot, f"{' '.join(words(rng, 70))} {passage} {' '.join(words(rng, 70))}", " ".join(words(rng, 300))]
    got = {(r["doc_id"], k) for r in suffix_repeats.repeats(docs(spark, texts)).collect() for k in range(r["start_word"], r["end_word"])}
    assert got == brute_repeats(texts)


def test_nearest_rows_outside_are_of_two_texts():
    def row(pid: int, edge: int, rank: int, key: bytes, position: int) -> dict:
        return {"pid": pid, "edge": edge, "start": rank, "key": key, "position": position, "right": b"", "left": b""}

    first, last = suffix_repeats.FIRST, suffix_repeats.LAST
    edges = [row(0, last, 0, b"b", 2), row(0, last, 1, b"a", 1), row(0, first, 0, b"a", 0), row(0, first, 1, b"b", 2)]
    edges += [row(2, e, 0, b"b", 3) for e in (first, last)] + [row(3, e, 0, b"b", 4) for e in (first, last)] + [row(4, e, 0, b"c", 5) for e in (first, last)]
    near = {at: [(r[0], r[1]) for r in rows] for at, rows in suffix_repeats.nearest_outside(edges).items()}
    before, after = suffix_repeats.BEFORE, suffix_repeats.AFTER
    assert near[0, before] == near[4, after] == [] and near[2, before] == [(b"b", 2), (b"a", 1)]
    assert near[3, before] == [(b"b", 3), (b"a", 1)] and near[4, before] == [(b"b", 4), (b"a", 1)]
    assert near[3, after] == [(b"c", 5)] and near[2, after] == [(b"b", 4), (b"c", 5)] and near[0, after] == [(b"b", 3), (b"c", 5)]


def test_long_repeats_have_a_minimiser():
    rng = np.random.default_rng(23)
    for _ in range(50):
        shared = rng.integers(0, 1 << 62, 40).astype(np.uint64)
        a, b = (np.r_[rng.integers(0, 1 << 62, 30).astype(np.uint64), shared, rng.integers(0, 1 << 62, 30).astype(np.uint64)] for _ in range(2))
        hit = [set(x[p] for p in suffix_repeats.minimisers(x)) for x in (shingle_hashes(a, 8), shingle_hashes(b, 8))]
        assert hit[0] & hit[1]


# shards


def test_shards_are_contiguous_balanced_and_keep_groups(spark):
    rng = random.Random(25)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(600)]
    texts += [texts[k] for k in range(50)] + [None, ""]
    got = sharding.shard(docs(spark, texts), 6, large=0.2).toPandas()
    assert len(got) == len(texts) and (got["size"].sum() == sum(len((t or "").encode()) + 8 for t in texts))
    by_id = got.set_index("doc_id")
    assert all(by_id.loc[i, "text_crc32"] == zlib.crc32((t or "").encode()) for i, t in enumerate(texts))
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 6 and sizes.max() - sizes.min() < 2 * 0.2 * sizes.mean() + 2 * got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    groups = defaultdict(set)
    for i, t in enumerate(texts):
        groups[t or ""].add(by_id.loc[i, "shard"])
    assert all(len(s) == 1 for s in groups.values())


def test_a_large_group_is_cut(spark):
    got = sharding.shard(docs(spark, ["same text"] * 90 + ["other"] * 3), 4).toPandas()
    assert got.groupby("shard")["size"].sum().std() < 40


def test_groups_between_two_percent_and_a_shard_stay_whole_and_shards_balanced(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(5, 60)) for _ in range(900)]
    for share in (0.03, 0.2, 0.5, 0.9, 0.9, 0.6):
        text = prose(rng, 20)
        texts += [text] * int(share * 45_000 / len(text))
    texts += [prose(rng, 30)] * 600  # larger than a shard
    rng.shuffle(texts)
    got = sharding.shard(docs(spark, texts), 6).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    by = defaultdict(set)
    for doc_id, s in zip(got["doc_id"], got["shard"]):
        by[texts[doc_id]].add(s)
    target = got["size"].sum() / 6
    bytes_of = {t: sum(len(x.encode()) + 8 for x in texts if x == t) for t in by}
    assert len(got) == len(texts) and all(len(s) == 1 for t, s in by.items() if bytes_of[t] <= target)
    assert max(len(s) for s in by.values()) > 1  # the one that no shard can hold
    assert sizes.max() - sizes.min() <= 2 * sharding.LARGE * target + 2 * got["size"].max()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_large_groups_are_placed_by_size_and_the_rest_levels_the_shards():
    parts, loads = sharding.placed_first([(1, 50), (2, 250), (3, 30)], 4, 400)
    assert [b for _, b in parts[2]] == [100, 200, 250] and sum(loads) == 330 and len(parts[1]) == len(parts[3]) == 1
    cuts = sharding.level_cuts(loads, 70)
    assert cuts[-1] == 70 and [c - b + load for c, b, load in zip(cuts, [0, *cuts], loads)] == [100] * 4
    assert sharding.level_cuts([0, 0], 0) == [0, 0] and sharding.level_cuts([90, 0, 0], 10) == [0, 5, 10]


# html


def test_main_text_leaves_out_what_is_not_the_article():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div id="cookie-notice">We use cookies</div>
    <div class="sidebar">Side <p>x</div><main><article><header><h1>Title &amp; more</h1></header><p>Para  one<p>Para <i>two</i>&nbsp;&eacute;<br>x<ul><li>item 1<li>item 2</ul><script>if (a < b) "</p>"</script>
    <form><p>Subscribe</form><section class='comments'><p>Nice!</p></section><!-- <p>no</p> --><p>Last</article></main><footer>f</footer></body></html>"""
    assert html_blocks.main_text(page) == "Title & more\n\nPara one\n\nPara two é x\n\nitem 1\n\nitem 2\n\nLast"
    assert html_blocks.main_text(None) == html_blocks.main_text("") == html_blocks.main_text("<p></p>") == ""
    assert html_blocks.main_text("<article><p>a<p>b") == "a\n\nb" and html_blocks.main_text("just text") == "just text"


def test_pages_without_article_use_the_distribution():
    body = "".join(f"<p>{'word ' * 40}{i}</p>" for i in range(5))
    page = f"<div class=menu><a href=a>one</a></div><p><a href=b>link</a></p><p><a href=c>link</a></p><p><a href=d>link</a></p>{body}<div><a href=x>more</a></div><div><a href=x>more</a></div><div><a href=x>more</a></div><p>tiny</p>"
    got = html_blocks.main_text(page)
    assert got.count("\n\n") == 4 and "link" not in got and "tiny" not in got


def test_links_are_seen_through_any_depth_of_markup():
    body = "".join(f"<p>{'word ' * 40}{i}</p>" for i in range(4))
    deep = lambda n: "<a href=x>" + "<b><i><u><em>" * n + "one of the links " * 3 + "</em></u></i></b>" * n + "</a>"
    for n in (0, 1, 5):
        page = f"<body>{body}" + "".join(f"<div><p>{deep(n)}</p></div>" for _ in range(4)) + "</body>"
        assert "links" not in html_blocks.main_text(page) and html_blocks.main_text(page).count("\n\n") == 3


def test_small_stretches_of_the_text_stay_on_pages_without_article():
    para = [f"<p>{'word ' * 200}{i}</p>" for i in range(4)]
    gap = "<div class=ad>Buy</div>" * 5
    close, note = f"<p>{'close ' * 80}</p>", "<p>A short last line.</p>"
    body = "".join(para)
    assert "close" in html_blocks.main_text(body + gap + close)
    assert html_blocks.main_text(f"<div>{body}{gap}{note}</div><p>{gap}tiny</p>").endswith("A short last line.")
    got = html_blocks.main_text(f"<p>tiny</p>{gap}<h1>The title</h1><p class=ad>a</p><p class=ad>b</p><p class=ad>c</p><p class=ad>d</p>{body}")
    assert got.startswith("The title\n\nword") and "tiny" not in got
    assert "short last" in html_blocks.main_text(body + gap + note + gap + body)


def test_density_decides_within_the_article():
    text, link = f"<p>{'word ' * 30}</p>", "<p><a href=x>A linked line</a></p>"

    def every(page: str) -> list[str]:
        """What all lines with weight would give, without surge and dive points."""
        found, marked, _ = html_blocks.lines(page)
        return [line[0] for line, w in zip(found, html_blocks.weigh(found, marked)) if w]

    between = f"<nav>m</nav><article><h1>T</h1>{text}{link}{text}</article>"
    assert html_blocks.main_text(between).count("A linked line") == 1 and "A linked line" not in every(between)
    menu = f"<article><h1>T</h1>{text}<ul class=plain>{'<li><a href=x>A linked line</a>' * 4}</ul>{text}</article>"
    assert "linked" not in html_blocks.main_text(menu) and html_blocks.main_text(menu).count("\n\n") == 2
    edges = f"<article>{link}<h1>T</h1>{text}{link}</article>"
    assert html_blocks.main_text(edges).startswith("A linked line\n\nT") and html_blocks.main_text(edges).endswith("A linked line")
    named = f"<article><h1>T</h1>{text}<div class='search banner share'>An odd name</div>{text}</article>"
    assert "An odd name" in html_blocks.main_text(named)
    loose = f"<p><a href=x>one</a></p>{text}{link}{text}<p><a href=y>two</a></p>"
    assert "linked" in html_blocks.main_text(loose) and "one" not in html_blocks.main_text(loose) and "two" not in html_blocks.main_text(loose)


def test_extract_takes_awkward_pages(spark):
    rows = [(None, None, None), (1, "u", "<p>x" * 3000), (1, "u", "<p>x" * 3000), (2, "v", "<a title='>\"" + "<b" * 500)]
    got = html_blocks.extract(spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash"))).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)


# packing


def test_packing_is_exact_and_tight(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(27)
    texts = [prose(rng, rng.randint(0, 900)) for _ in range(150)] + [None, "", " \n\n  two  spaces\t", "a <|endoftext|> b", "é😀 日本語 x", "it's\nfine ", "x" * 3000]
    got = packing.pack(docs(spark, texts)).toPandas()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in enumerate(texts):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        rows = got[got.doc_id == i].sort_values("start")
        assert rows.start.tolist() == [0, *rows.length.cumsum()[:-1]] and rows.length.sum() == len(ids) and (rows.doc_tokens == len(ids)).all()
        for s, n, crc in zip(rows.start, rows.length, rows.ids_crc32):
            assert zlib.crc32(ids[s : s + n].tobytes()) == crc
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 1024
    n = got.sequence_id.nunique()
    assert got.sequence_id.max() == n - 1 and got.length.sum() / (1024 * n) > 0.95


def test_token_ids_are_those_of_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(49)
    whole, encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing._tokens(None)
    bits = [" ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x0b", "'s", "'ll", "'", "don't", "The", "hello", "é", "ß", "日本語", "한국어", "Привет", "العربية", "हिन्दी", "😀", "👩‍👩‍👧", "123", "4.5", "!?", "--", "<|endoftext|>", "<|endof", "x_y", "\ufeff", "a\u0301", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert encoder(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_a_text_is_encoded_in_one_call_whatever_its_words():
    encoder, rng = packing._tokens(None), random.Random(50)

    def calls(text):
        count = 0

        def seen(frame, event, what):
            nonlocal count
            count += event in ("call", "c_call")

        sys.setprofile(seen)
        try:
            encoder(text)
        finally:
            sys.setprofile(None)
        return count

    fresh = "\n".join(" ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(50)) for _ in range(40))
    assert calls(fresh) == calls("word") < 20


def test_a_million_blanks_in_a_row_are_encoded():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing._tokens(None)
    for text in ("a" + " " * 1_000_000 + "b", "\n" * 1_100_000, "a " * 10 + "\u3000" * 899_000 + " c"):
        assert encoder(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_knapsack_and_plan_match_brute_force():
    rng = random.Random(29)
    for _ in range(20):
        sizes = np.array(sorted(rng.sample(range(1, 12), 4)))
        values = np.array([rng.random() for _ in sizes])
        best = max((sum(v * k for v, k in zip(values, c)) for c in np.ndindex(13, 13, 13, 13) if sum(s * k for s, k in zip(sizes, c)) <= 12), default=0)
        got, counts = packing.knapsack(values, sizes, 12)
        assert got == pytest.approx(best) and (counts * sizes).sum() <= 12
    for _ in range(20):
        histogram = {s: rng.randint(0, 40) for s in range(1, 33)}
        patterns = packing.plan(histogram, 32)
        used = Counter()
        for pattern, n in patterns:
            assert sum(s * k for s, k in pattern.items()) <= 32
            for s, k in pattern.items():
                used[s] += k * n
        assert used == Counter({s: n for s, n in histogram.items() if n})
        kinds = np.array([s for s in range(1, 32) if histogram[s]])
        program = packing.generate_columns(kinds, np.array([histogram[s] for s in kinds], float), 32)[1].sum() + histogram[32]
        assert sum(s * n for s, n in histogram.items()) / 32 <= program + 1e-6
        assert sum(n for _, n in patterns) <= math.ceil(program) + 4  # what rounding down leaves


# decontamination


def test_leaks_are_found_verbatim_and_reparameterised(spark):
    item = "If Anna buys 12 apples for 30 cents each and then gives Bob half of the apples, how many apples does Anna keep after 3 days?"
    again = "If Carl buys 15 apples for 45 cents each and then gives Dora half of the apples, how many apples does Carl keep after 9 days?"
    broken = "If Carl buys 15 apples for 45 cents each and then gives Carl half of the apples, how many apples does Dora keep after 9 days?"
    rng = random.Random(31)
    texts = [f"{prose(rng, 60)}. {t} {prose(rng, 60)}" for t in (item, again, broken, item.upper())] + [prose(rng, 200), None, ""]
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "Too short")], "item_id long, text string")
    for most in (10_000, 0):
        got = {r["doc_id"]: r for r in decontaminate.leaks(docs(spark, texts), benchmark, most).collect()}
        assert set(got) == {0, 1, 3} and not got[0]["reparameterised"] and got[1]["reparameterised"]
    kept = decontaminate.clean(docs(spark, texts), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {2, 4, 5, 6} and kept.columns == docs(spark, texts).columns


def test_leaks_of_items_that_resemble_themselves(spark):
    item = "She bought 3 apples and 5 pears and 7 apples and 9 pears and 2 apples and 4 pears"
    again = "She bought 11 apples and 12 pears and 13 apples and 14 pears and 15 apples and 16 pears"
    broken = "She bought 11 apples and 11 pears and 11 apples and 11 pears and 11 apples and 11 pears"
    rng = random.Random(33)
    plain = " ".join(words(rng, 24))
    halves = f"{plain} and then 3 men met 5 boys in the old town", f"{plain} and then 8 men met 8 boys in the old town"
    shifted = item.replace("and 9", "and well 9")
    texts = [f"{prose(rng, 40)}. {t}. {prose(rng, 40)}" for t in (item, again, broken, halves[1], shifted)]
    benchmark = spark.createDataFrame([(1, item), (2, halves[0])], "item_id long, text string")
    for most in (10_000, 0):
        got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs(spark, texts), benchmark, most).collect()}
        assert set(got) == {(0, 1), (1, 1), (3, 2), (4, 1)}
        assert got[0, 1]["covered"] == got[1, 1]["covered"] == 1 and not got[0, 1]["reparameterised"] and got[1, 1]["reparameterised"]
        assert got[3, 2]["run"] >= 24


def test_leaks_of_short_items_are_found_within_documents(spark):
    items = ["how many rivers cross Paris", "what is the longest of 7 bones", "why does old bread turn", "boil it for 5 more short minutes"]
    others = ["how many rivers cross Vienna", "what is the longest of 9 bones", "why does old bread turn", "boil it for 5 more minutes"]
    rng = random.Random(35)
    texts = [f"{' '.join(words(rng, 30))} {t} {' '.join(words(rng, 30))}" for t in others] + [others[2], "well why does old bread turn"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for most in (10_000, 0):
        got = {(r["doc_id"], r["item_id"], r["covered"], r["reparameterised"]) for r in decontaminate.leaks(docs(spark, texts), benchmark, most).collect()}
        assert got == {(0, 0, 1.0, True), (1, 1, 1.0, True), (2, 2, 1.0, False), (4, 2, 1.0, False), (5, 2, 1.0, False)}


# all


def test_awkward_and_empty_tables(spark, odd, empty):
    n = odd.count()
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert secret_scan.digest(secret_scan.scan(odd, ["source"], ["source"])).count() == n
    assert order_minhash.classes(odd).count() == n
    assert sharding.shard(odd).count() == n and packing.pack(odd).where("start = 0").count() == n
    assert {r["doc_id"] for r in suffix_repeats.repeats(odd).collect()} == {6} and decontaminate.leaks(odd, benchmark).count() == 0
    assert secret_scan.scan(empty, ["source"], ["source"]).count() == 0 and order_minhash.classes(empty).count() == 0 and sharding.shard(empty).count() == 0
    item = spark.createDataFrame([(None, "a long enough item of the benchmark for a window or two")], "item_id long, text string")
    labels = spark.createDataFrame([(6, 1, 1), (2, 1, 0), (None, None, None)], LABELS)
    for frame in (odd, empty):
        assert toxicity.score(frame, labels).count() == frame.count() and decontaminate.leaks(frame, item).count() == 0
        for kept in (secret_scan.redact(frame, ["source"], ["source"]), decontaminate.clean(frame, item), toxicity.keep_clean(frame, labels)):
            assert kept.columns == frame.columns and kept.count() == frame.count()
        assert order_minhash.deduplicate(frame).columns == frame.columns
    assert packing.pack(empty).count() == 0 and suffix_repeats.repeats(empty).count() == 0 and repetition.measure(empty).count() == 0
    assert link_trust.judge(spark.createDataFrame([], PAGES)).count() == 0 and html_blocks.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_occurrence_labels():
    assert occurrences(np.array([5, 7, 5, 5, 7], np.uint64)).tolist() == [0, 0, 1, 2, 1]
