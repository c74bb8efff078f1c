"""Queries against their SQL on texts that the given tables hold few of."""

from __future__ import annotations

import functools
import itertools
import operator
import random

import duckdb
import pytest

from chunkwright.plans.catalog import ORACLES, QUERIES
from tests.test_oracles import normal


@pytest.fixture()
def same_as_sql(spark, tmp_path):
    def run(name: str, texts: list[str]) -> list[tuple]:
        rows = [(i, t, "de", "web", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        frame = QUERIES[name](spark, str(tmp_path))
        got = sorted(tuple(normal(v) for v in r) for r in frame.collect())
        assert got == sorted(tuple(normal(v) for v in r) for r in con.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLES[name]})").fetchall())
        return got

    return run


def test_pointing_words_end_where_ascii_words_do(same_as_sql):
    starts = "it it\u00df It\u00df. they\u00e9 he_ this thi\u017f thi\u017fx \u017fhe tHe\u017fe the\u017fe\u00df Tho\u017fe9 he\u65e5 heute".split()
    texts = [f"{w} steht am Anfang von diesem langen Satz. Danach folgt noch ein ganzer Satz, der lang genug ist, um zu gelten." for w in starts]
    got = same_as_sql("e06e_retrieval_readiness", texts + [t.replace(". D", ".\x0bD").replace(" ", "\x0bWho\x0b", 1) for t in texts])
    assert len({r[1] for r in got}) == 2


def test_technical_words_are_cased_letter_by_letter(same_as_sql):
    got = same_as_sql("q22_technical_keywords", ["\u00dfl re\ufb06 re\ufb05", "T\u00df; l", "\u017fql (http\u017f) ap\u0131 \u0130 AP\u0130", "api, rest! SSL \u1e9el tls\u0307"])
    assert len(got) == 4


def test_means_on_a_threshold_are_summed_as_in_sql(same_as_sql):
    rng, texts, n = random.Random(6), [], itertools.count()
    unique = lambda k: [f"w{next(n) % 1000000:06d}" for _ in range(k)]
    while len(texts) < 12:
        order = rng.sample([0.5, 0.7] * 11, 22)  # coherence of the chunks: 0.6 on average, or less by rounding
        if (functools.reduce(operator.add, order) / 22 < 0.6) == (functools.reduce(operator.add, order[::-1]) / 22 < 0.6):
            continue
        # a chunk is 112 words and the 16 after it
        blocks = [unique(56) + ["same.aa"] * 56 if x == 0.7 else ["a.begin"] + unique(111) for x in order]
        texts.append(" ".join(w for b in [*blocks, unique(15), ["ends.at."]] for w in b))
    got = same_as_sql("q16_recommendations", [*texts, "one chunk. no more", "x"])
    assert 0 < sum(r[1] == "coherence" for r in got) < 12
