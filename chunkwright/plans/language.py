"""Language queries. Texts are mixed with Korean, Japanese and Chinese samples by doc_id, so that every branch is met."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkwright.functions import language as L
from chunkwright.functions import profiles as V
from chunkwright.plans.corpora import table
from chunkwright.plans.registry import query

_MIX = """CASE doc_id % 6 WHEN 0 THEN repeat('한국어 문장입니다. ', 60) WHEN 1 THEN repeat('これは日本語の文です。', 30)
 WHEN 2 THEN repeat('这是中文句子。', 40) WHEN 3 THEN repeat('Это русский текст. ', 60) ELSE '' END || text"""
_DUCK = f"m AS (SELECT doc_id, {_MIX} AS text FROM documents WHERE text IS NOT NULL)"


def mixed(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.expr(_MIX).alias("text"))


def _class(chars: str) -> str:
    import re

    return re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", chars)


_COUNT = lambda t, chars: f"(length({t}) - length(regexp_replace({t}, '[{_class(chars)}]', '', 'g')))"
_T1, _T2, _T3 = "substr(text, 1, 10000)", "substr(text, 1, 1000)", "substr(text, 1, 5000)"
_SHARE = lambda t, total, chars: f"CASE WHEN {total} > 0 THEN {_COUNT(t, chars)} / {total} ELSE 0e0 END"
_TOTAL1 = f"length(regexp_replace({_T1}, '[\\s\\p{{P}}\\p{{Nd}}]', '', 'g'))"
_TOTAL2 = f"length(regexp_replace({_T2}, '\\s', '', 'g'))"
_TOTAL3 = f"length(regexp_replace({_T3}, '[\\s\\p{{Cc}}]', '', 'g'))"


@query(
    "l01_cjk_language",
    f"""WITH {_DUCK}, s AS (SELECT doc_id, {_SHARE(_T1, _TOTAL1, L.HANGUL)} AS ko, {_SHARE(_T1, _TOTAL1, L.KANA)} AS ja, {_SHARE(_T1, _TOTAL1, L.HAN)} AS zh FROM m)
    SELECT doc_id, CASE WHEN ko > 0.1 THEN 'ko' WHEN ja > 0.05 THEN 'ja' WHEN zh > 0.1 THEN 'zh' ELSE 'unknown' END AS language,
    CASE WHEN ko > 0.1 THEN round_even(least(0.95e0, 0.6e0 + 0.4e0 * ko), 4) WHEN ja > 0.05 THEN round_even(least(0.95e0, 0.6e0 + 0.4e0 * (ja + 0.3e0 * zh)), 4)
     WHEN zh > 0.1 THEN round_even(least(0.95e0, 0.6e0 + 0.4e0 * zh), 4) ELSE 0e0 END AS confidence FROM s""",
)
def cjk_language(spark, sf_dir):
    language, confidence = L.cjk_language(F.col("text"))
    return mixed(spark, sf_dir).select("doc_id", language.alias("language"), confidence.alias("confidence"))


@query(
    "l04_script_profile",
    f"""WITH {_DUCK} SELECT doc_id, CASE WHEN {_SHARE(_T2, _TOTAL2, L.HANGUL)} > 0.3 THEN 'ko' WHEN {_SHARE(_T2, _TOTAL2, L.KANA)} > 0.1 THEN 'ja' WHEN {_SHARE(_T2, _TOTAL2, L.HAN)} > 0.3 THEN 'zh'
    WHEN {_SHARE(_T2, _TOTAL2, chr(92) + 'u0600-' + chr(92) + 'u06FF')} > 0.3 THEN 'ar' WHEN {_SHARE(_T2, _TOTAL2, chr(92) + 'u0900-' + chr(92) + 'u097F')} > 0.3 THEN 'hi'
    WHEN {_SHARE(_T2, _TOTAL2, chr(92) + 'u0400-' + chr(92) + 'u04FF')} > 0.3 THEN 'ru' ELSE 'en' END AS profile FROM m""",
)
def script_profile(spark, sf_dir):
    return mixed(spark, sf_dir).select("doc_id", L.script_profile(F.col("text")).alias("profile"))


@query(
    "l05_first_script",
    f"WITH {_DUCK} SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{{AC00}}-\\x{{D7AF}}]') THEN 'ko' WHEN regexp_matches(text, '[{_class(L.HAN)}]') THEN 'zh' WHEN regexp_matches(text, '[{_class(L.KANA)}]') THEN 'ja' ELSE 'en' END AS language FROM m",
)
def first_script(spark, sf_dir):
    return mixed(spark, sf_dir).select("doc_id", L.first_script(F.col("text")).alias("language"))


_CJK = L.HANGUL + L.KANA + L.HAN + "\\u3400-\\u4DBF"


@query(
    "c09_size_factor",
    f"WITH {_DUCK}, s AS (SELECT doc_id, {_SHARE(_T3, _TOTAL3, _CJK)} AS r FROM m) SELECT doc_id, round(CASE WHEN r < 0.1 THEN 1e0 ELSE greatest(0.15e0, 1 / (1 + 4 * r)) END, 9) AS factor FROM s",
)
def size_factor(spark, sf_dir):
    return mixed(spark, sf_dir).select("doc_id", F.round(L.size_factor(F.col("text")), 9).alias("factor"))


_GRAMS = f"g AS (SELECT doc_id, lang, substr(x, CAST(i AS INT), 3) AS tri FROM (SELECT doc_id, lang, x, unnest(range(1, length(x) - 1)) AS i FROM (SELECT doc_id, lang, lower(substr(text, 1, {L.SAMPLE})) AS x FROM documents WHERE length(text) > 2)))"


@query(
    "l02_trigram_language",
    f"""WITH {_GRAMS}, c AS (SELECT lang, tri, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY 1, 2), p AS (SELECT lang AS guess, tri, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, tri) AS rank FROM c) WHERE rank <= {L.PROFILE}),
    z AS (SELECT DISTINCT guess FROM p), t AS (SELECT doc_id, tri, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, tri) AS rank FROM g GROUP BY doc_id, tri),
    d AS (SELECT doc_id, z.guess, sum(coalesce(least(abs(t.rank - p.rank), {L.PROFILE}), {L.PROFILE})) / count(*) AS distance FROM t CROSS JOIN z LEFT JOIN p ON p.guess = z.guess AND p.tri = t.tri WHERE t.rank <= {L.PROFILE} GROUP BY doc_id, z.guess),
    r AS (SELECT *, row_number() OVER w AS k, lead(distance) OVER w AS next FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY distance, guess))
    SELECT doc_id, guess, round(distance, 6) AS distance, round(greatest(0.1e0, least(0.99e0, CASE WHEN distance > 0 THEN 0.5e0 + 0.5e0 * (next - distance) / distance ELSE 0.99e0 END)), 6) AS confidence FROM r WHERE k = 1""",
)
def trigram_language(spark, sf_dir):
    """Profiles of all labelled documents; every document gets the language whose ranking of trigrams is nearest."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 2")
    return L.nearest_language(docs, L.profiles(docs.where("lang IS NOT NULL"))).select("doc_id", "guess", F.round("distance", 6).alias("distance"), F.round("confidence", 6).alias("confidence"))


# One sample in each language, of twenty times two sentences, stands before every text; Latin languages are declared.

#: Sentences with abbreviations, quotes and section lines of their language.
SAMPLES = {
    "en": "Dr. Smith met Mr. Jones in the U.S. yesterday. He said \"stop!\" and left (at 5 p.m.).\nChapter 4 begins\n",
    "ko": "저자는 책을 읽었습니다. 모두 등. 하나를 만났음 그는 갔다 정말요\n제 3 장 시작\n",
    "zh": "这是第一句。这是第二句！还有吗？有；好. 完\n第三章 开始\n",
    "ja": "これは文です。次も文です 本を読みました。行った!\n第二節 始まり\n",
    "es": "El Dr. García llegó a la pág. 7 ayer. ¿Qué dijo la Sra. López? \"¡Nada!\" Fin.\nCapítulo 2 empieza\n",
    "fr": "M. Dupont a vu Mme. Durand hier ! Que dit-il ? «Rien.» Voir fig. 3 et p. 9. Fin.\nPartie 2 commence\n",
    "de": "Herr Dr. Meier kommt z.B. heute. Er sagt „Halt!“ und geht usw. weiter. Nr. 5 bleibt.\nKapitel 3 beginnt\n",
    "ar": "هذه جملة قصيرة. وهذا سؤال؟ ثم نهاية۔ \n1. بداية\n",
    "hi": "यह एक वाक्य है। यह दूसरा है॥ और तीसरा!\nक. आरंभ\n",
    "pt": "O Dr. Silva viu a Sra. Costa na pág. 3 ontem. Disse V.Ex. algo? \"Nada.\" Fim.\nSeção 4 começa\n",
    "ru": "Это было в 1990 г. и позже. См. рис. и др. вещи! Он сказал «да.» Конец.\nГлава 2 начинается\n",
}
_KEYS = list(SAMPLES)
_QUOTED = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_SAMPLE = "CASE doc_id % 11 " + " ".join(f"WHEN {k} THEN repeat({_QUOTED(s)}, 20)" for k, s in enumerate(SAMPLES.values())) + " END"
_ENDING = "CASE doc_id % 4 WHEN 0 THEN ' End. ' WHEN 1 THEN ' (End.)' WHEN 2 THEN ' etc.' ELSE ' no end' END"
_SPOKEN_TEXT = f"{_SAMPLE} || text || {_ENDING}"
#: Every other declaration names a region.
_DECLARED = f"concat(element_at(array({', '.join(repr(k) for k in _KEYS)}), int(doc_id % 11 + 1)), CASE WHEN doc_id % 2 = 0 THEN '-XX' ELSE '' END)"
_LANGUAGE = "[{}][doc_id % 11 + 1]".format(", ".join(repr(k) for k in _KEYS))
_DUCK_SPOKEN = f"given AS (SELECT doc_id, {_SPOKEN_TEXT} AS text, {_LANGUAGE} AS language FROM documents WHERE text IS NOT NULL)"


def spoken(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return V.with_rules(docs.select("doc_id", F.expr(_SPOKEN_TEXT.replace("chr(10)", "'\\n'")).alias("text"), F.expr(_DECLARED).alias("lang")))


_PROFILE_ROWS = ", ".join(f"('{p.code}', '{p.name}', '{p.script}', '{p.direction}', '{p.numbers}', '{p.quotes}')" for p in V.PROFILES)


@query(
    "l03_language_profiles",
    f"""WITH {_DUCK_SPOKEN}, profiles(language, language_name, script, direction, numbers, quotes) AS (VALUES {_PROFILE_ROWS})
    SELECT doc_id, language, language_name, script, direction, numbers, quotes, CAST({V.duckdb_section_lines('text', 'language')} AS BIGINT) AS section_lines FROM given JOIN profiles USING (language)""",
)
def language_profiles(spark, sf_dir):
    """The profile of the language found (L04 for scripts, the declared one for Latin), and the lines that begin sections by its rules."""
    return spoken(spark, sf_dir).select("doc_id", "language", "language_name", "script", "direction", "numbers", "quotes", F.size(V.section_lines(F.col("text"))).cast("long").alias("section_lines"))


@query(
    "l06_sentence_boundaries",
    f"""WITH {_DUCK_SPOKEN}, {V.duckdb_sentences('text', 'language', 'given', 'doc_id, text, language')},
    ends AS (SELECT doc_id, unnest(range(1, len(pieces))) AS k, pieces FROM spoken), placed AS (SELECT doc_id, k, CAST(list_sum(list_transform(pieces[1:k], lambda p: length(p))) AS BIGINT) AS at_char FROM ends),
    lists AS (SELECT doc_id, count(*) AS n, md5(string_agg(at_char, ',' ORDER BY k)) AS digest FROM placed GROUP BY doc_id)
    SELECT doc_id, language, coalesce(n, 0) AS n_boundaries, coalesce(digest, md5('')) AS digest, {V.duckdb_complete('text', 'language')} AS complete FROM spoken LEFT JOIN lists USING (doc_id)""",
)
def sentence_boundaries(spark, sf_dir):
    """Offsets of sentence ends by the language's rules, abbreviations passed over, and whether the text ends with a complete sentence."""
    found = spoken(spark, sf_dir).select("doc_id", "language", V.boundaries(F.col("text")).alias("at"), V.ends_complete(F.col("text")).alias("complete"))
    return found.select("doc_id", "language", F.size("at").cast("long").alias("n_boundaries"), F.md5(F.array_join(F.col("at").cast("array<string>"), ",")).alias("digest"), "complete")
