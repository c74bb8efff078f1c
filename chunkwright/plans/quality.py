"""The composite quality report of a document's chunks, its advice, and boundaries made to size."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chunkwright.functions import scores as S
from chunkwright.functions.arrays import bound
from chunkwright.operators.heavy import counted
from chunkwright.functions.rewrite import quoted
from chunkwright.plans.analysis import _CODE, _END, _FULL, _LIST, _NUM, _SENT, _START, _T, full, sentences
from chunkwright.plans.corpora import CHUNK, DUCK_CHUNKS, chunks, table
from chunkwright.plans.registry import query

#: Stop words, words of continuity and of reference, weights of the families.
STOPS = "the is at which on and a an as are was were been be have has had do does did will would could should may might must can to of in for with by from about".split()
CONTINUITY = "however therefore moreover furthermore additionally consequently thus hence".split()
REFERENCES = "he|she|it|they|this|that|these|those"
WEIGHTS = {"semantic": 0.25, "context": 0.20, "density": 0.15, "structure": 0.15, "retrieval": 0.15, "boundary": 0.10}
_CUTS = "[ \\t\\n\\r.,!?;:\"''()]"
_REF = f"(?i)(?:^|[^A-Za-z0-9_])(?:{REFERENCES})(?:[^A-Za-z0-9_]|$)"
_ALONE = f"(?i)^(?:{REFERENCES})(?:[^A-Za-z0-9_]|$)"
_DEFINES = "(?i)(?:^|\\W)is(?:\\W.*\\W|\\W)(?:defined as|refers to|means)(?:\\W|$)"
_ASKS = "(?i)(?:^|\\s)(what|when|where|who|why|how)(?:\\s|[?,.!])"
_NAMES, _DIGITS = "(?:^|\\s)[A-Z][a-z]+", "(?:^|\\s)\\d+"

_STOPPED = "(" + ", ".join(map(quoted, STOPS)) + ")"
_TERMS = lambda x: f"list_filter(string_split_regex(lower({x}), '{_CUTS}'), lambda w: length(w) > 2 AND w NOT IN {_STOPPED})"
_WORDS = "list_filter(string_split_regex(content, '[ \\t\\n\\r]'), lambda w: w <> '')"
_SIM = lambda a, b: f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0e0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)"
_OVERLAP = "coalesce(list_max(list_filter(range(21, CAST(least(length(before), length(content), 256) + 1 AS BIGINT)), lambda k: right(before, k) = left(content, k))), 0)"
_CONT = "CASE WHEN " + " OR ".join(f"starts_with(lower(content), '{w}') OR contains(lower(content), ' {w}')" for w in CONTINUITY) + " THEN 1e0 ELSE 0.5e0 END"
_FLAGS = f"""CAST(regexp_matches(content, '(?m)^#{{1,6}}\\s+.+$') AS INT) AS header, CAST({_LIST} + len(regexp_extract_all(content, '(?m)^\\d+\\.\\s+.+$')) >= 2 AS INT) AS listed, CAST({_CODE} AS INT) AS code,
 CAST(regexp_matches(content, '\\|.+\\|.*\\n\\|[-:\\s|]+\\|') AS INT) AS tab, CAST((contains(content, '```') AND NOT {_CODE}) OR {_LIST} = 1 AS INT) AS broken"""

_MEASURED = f"""{DUCK_CHUNKS}, a0 AS (SELECT *, {_SENT} AS s, {_TERMS('content')} AS t, {_WORDS} AS w FROM chunks), a1 AS (SELECT *, list_distinct(t) AS u, list_transform(s, lambda x: list_distinct({_TERMS('x')})) AS st, lag(content) OVER o AS before,
   flatten(list(t) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)) AS near, count(*) OVER (PARTITION BY doc_id) AS n FROM a0 WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_index)),
 a2 AS (SELECT *, CASE WHEN before IS NOT NULL THEN {_OVERLAP} END AS k, {_NUM(_START)} AS starts, {_NUM(_END)} AS ends, {_CONT} AS flow FROM a1),
 a3 AS (SELECT *, CASE WHEN k > 0 THEN k / least(length(before), length(content), 256) * CASE WHEN contains(left(content, k), '.') OR contains(left(content, k), ' ') THEN 1e0 ELSE 0.5e0 END ELSE 0e0 END AS lap, lag(ends) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS ended FROM a2),
 a4 AS (SELECT doc_id, chunk_index, n, content, t, len(list_filter(s, {_FULL})) / greatest(1, len(s)) AS sentence, {_NUM(f"len(s) >= 2 AND len(list_filter(s, {_FULL})) = len(s) AND length(content) > 100")} AS thought, {_NUM(f"length({_T}) < 50 OR NOT regexp_matches(content, '[.!?]')")} AS orphan,
   0.5e0 * {_NUM(f"regexp_matches({_T}, '\\A\\p{{Lu}}')")} + 0.5e0 * {_NUM(f"regexp_matches({_T}, '[.!?]\\z')")} AS bound, CASE WHEN before IS NOT NULL THEN lap END AS lap, CASE WHEN before IS NOT NULL THEN flow END AS flow,
   CASE WHEN before IS NOT NULL THEN CASE WHEN regexp_matches(left(content, 100), '{_REF}') THEN 0.5e0 ELSE 1e0 END END AS refs, CASE WHEN n < 2 THEN 1e0 WHEN len(u) = 0 THEN 0e0 ELSE len(list_intersect(u, list_distinct(near))) / len(u) END AS nearby,
   CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: length(x) > 3 AND lower(x) NOT IN {_STOPPED})) / len(w) ELSE 0e0 END AS dense,
   CASE WHEN len(s) < 2 THEN 0e0 ELSE coalesce(list_sum(list_transform(range(1, len(s)), lambda i: list_sum(list_transform(range(i + 1, len(s) + 1), lambda j: CASE WHEN {_SIM('st[i]', 'st[j]')} > 0.7 THEN {_SIM('st[i]', 'st[j]')} ELSE 0e0 END)))), 0e0) / (len(s) * (len(s) - 1) / 2) END AS redundant,
   CASE WHEN len(t) > 0 THEN len(u) / len(t) ELSE 0e0 END AS uniq, {_FLAGS},
   {_NUM(f"len(s) >= 2 AND len(list_filter(s, {_FULL})) = len(s) AND length(content) > 100 AND NOT regexp_matches(content, '{_ALONE}')")} AS alone, {_NUM("len(u) > 10 AND len(u) / len(t) > 0.2")} AS rich,
   CASE WHEN len(s) = 0 THEN 0e0 ELSE 0.3e0 * {_NUM("length(s[1]) > 20 AND length(s[1]) < 200")} + 0.3e0 * {_NUM(f"len(list_filter(s[1:1], {_FULL})) = 1")} + CASE WHEN len(s) < 2 THEN 0.4e0 WHEN len(flatten(st[2:])) = 0 THEN 0e0
     ELSE 0.4e0 * len(list_intersect(st[1], list_distinct(flatten(st[2:])))) / len(list_distinct(flatten(st[2:]))) END END AS summary,
   0.2e0 * {_NUM(f"regexp_matches(content, '{_ASKS}')")} + 0.2e0 * {_NUM(f"regexp_matches(content, '{_DEFINES}')")} + 0.2e0 * {_NUM("len(t) > 20")} + 0.2e0 * {_NUM(f"len(regexp_extract_all(content, '{_NAMES}')) > 2")} + 0.2e0 * {_NUM(f"len(regexp_extract_all(content, '{_DIGITS}')) > 2")} AS match,
   starts, ends, CASE WHEN before IS NOT NULL THEN 0.4e0 * lap + 0.3e0 * flow + 0.15e0 * ended + 0.15e0 * starts END AS transition, len(s) AS n_sentences FROM a3),
 en AS (SELECT doc_id, CASE WHEN count(*) > 1 THEN -sum(c / total * log2(c / total)) / log2(count(*)) ELSE 0e0 END AS entropy FROM (SELECT doc_id, c, sum(c) OVER (PARTITION BY doc_id) AS total FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(t) AS x FROM a4) GROUP BY 1, 2)) GROUP BY doc_id),
 du AS (SELECT doc_id, sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS repeated FROM (SELECT doc_id, content, count(*) AS c FROM a4 GROUP BY 1, 2) GROUP BY 1),
 og AS (SELECT doc_id, length(text) AS chars, len({_SENT.replace('content', 'text')}) AS n_original FROM documents WHERE length(text) > 0),
 me AS (SELECT doc_id, any_value(n) AS n_chunks, avg(sentence) AS sentence, avg(thought) AS thought, avg(orphan) AS orphan, avg(bound) AS bound, coalesce(avg(lap), 0e0) AS lap, coalesce(avg(flow), 0e0) AS flow, coalesce(avg(refs), 0e0) AS refs, avg(nearby) AS nearby, avg(dense) AS dense, avg(redundant) AS redundant, avg(uniq) AS uniq,
   sum(header + listed + code + tab) AS whole, sum(broken) AS broken, avg(broken) AS broken_share, avg(alone) AS alone, avg(rich) AS rich, avg(summary) AS summary, avg(match) AS match, avg(starts) AS starts, avg(ends) AS ends, coalesce(avg(transition), 0e0) AS transition, sum(length(content)) + count(*) - 1 AS chars_kept, sum(n_sentences) AS n_sentences FROM a4 GROUP BY doc_id),
 sc AS (SELECT me.*, coalesce(entropy, 0e0) AS entropy, 0.3e0 * sentence + 0.3e0 * thought + 0.2e0 * (1 - orphan) + 0.2e0 * bound AS semantic, CASE WHEN n_chunks < 2 THEN 1e0 ELSE 0.3e0 * lap + 0.3e0 * flow + 0.2e0 * refs + 0.2e0 * nearby END AS context,
   0.3e0 * dense + 0.3e0 * (1 - redundant) + 0.2e0 * uniq + 0.2e0 * coalesce(entropy, 0e0) AS density, CASE WHEN whole > 0 THEN (whole - broken) / whole ELSE 1 - broken_share END AS structure, 0.3e0 * alone + 0.2e0 * rich + 0.25e0 * summary + 0.25e0 * match AS retrieval,
   CASE WHEN n_chunks < 2 THEN 1e0 ELSE 0.35e0 * starts + 0.35e0 * ends + 0.3e0 * transition END AS boundary, least(1e0, chars_kept / chars) * least(1e0, n_sentences / greatest(1, n_original)) * (1 - repeated / n_chunks) AS coverage FROM me JOIN og USING (doc_id) JOIN du USING (doc_id) LEFT JOIN en USING (doc_id)),
 measured AS (SELECT *, {' + '.join(f'{w}e0 * {k}' for k, w in WEIGHTS.items())} AS composite FROM sc)"""


def terms(text):
    return F.filter(F.split(F.lower(text), _CUTS.replace("''", "'")), lambda w: (F.length(w) > 2) & ~w.isin(STOPS))


def similar(a, b):
    """Jaccard similarity of two sets (arrays of distinct elements)."""
    return bound(F.size(F.array_intersect(a, b)), lambda common: F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common)))


def redundancy(sets):
    """The similarity of pairs of sets that are more than 0.7 alike, over all pairs: bounded by a chunk's sentences."""
    n = F.size(sets)

    def ahead(a, i):
        alike = lambda s, b: s + bound(similar(a, b), lambda x: F.when(x > 0.7, x).otherwise(0.0))
        return F.aggregate(F.slice(sets, i + 2, n), F.lit(0.0), alike)

    total = F.aggregate(F.transform(sets, ahead), F.lit(0.0), lambda s, x: s + x)
    return F.when(n < 2, 0.0).otherwise(total / (n * (n - 1) / 2))


def chunk_measures(frame):
    """doc_id, chunk_index, content, terms and what each family of the report asks of a chunk and its neighbours."""
    c = F.col("content")
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    a = frame.withColumns({"s": sentences(c), "t": terms(c), "w": F.filter(F.split(c, r"[ \t\n\r]"), lambda x: x != "")})
    near = F.flatten(F.concat(F.collect_list("t").over(order.rowsBetween(-2, -1)), F.collect_list("t").over(order.rowsBetween(1, 2))))
    a = a.withColumns({"u": F.array_distinct("t"), "st": F.transform("s", lambda x: F.array_distinct(terms(x))), "before": F.lag("content").over(order), "near": near, "n": F.count("*").over(Window.partitionBy("doc_id"))})
    most = F.least(F.length("before"), F.length(c), F.lit(256))
    # the ends that can overlap are cut off once, so that each length compares 256 characters at most
    lap = F.expr("transform(array(struct(right(before, 256) AS b, left(content, 256) AS h)), x -> coalesce(array_max(filter(sequence(1, least(length(x.b), length(x.h))), k -> k > 20 AND right(x.b, k) = left(x.h, k))), 0))[0]")
    low = F.lower(c)
    flow = F.lit(False)
    for word in CONTINUITY:
        flow = flow | low.startswith(word) | low.contains(" " + word)
    t = S.trimmed(c)
    a = a.withColumns({"k": F.when(F.col("before").isNotNull(), lap), "starts": S.number(t.rlike(r"\A(?:\p{Lu}|#|\d+\.)")), "ends": S.number(t.rlike(r"(?:[.!?]|```)\z")), "flow": F.when(flow, 1.0).otherwise(0.5)})
    head = F.left(c, F.col("k"))
    a = a.withColumns({"lap": F.when(F.col("k") > 0, F.col("k") / most * F.when(head.contains(".") | head.contains(" "), 1.0).otherwise(0.5)).otherwise(0.0), "ended": F.lag("ends").over(order)})
    paired = lambda x: F.when(F.col("before").isNotNull(), x)
    n, whole = F.size("s"), F.size(F.filter("s", full))
    thought = (n >= 2) & (whole == n) & (F.length(c) > 100)
    many = lambda p: S.number(F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0))) > 2)
    rest = F.array_distinct(F.flatten(F.slice("st", 2, F.greatest(F.lit(0), n - 1))))
    items = F.size(F.regexp_extract_all(c, F.lit(r"(?dm)^[*+-]\s+.+$"), F.lit(0)))
    code = c.rlike("```[^`]*```")
    return a.select(
        "doc_id", "chunk_index", "n", "content", "t", (whole / F.greatest(F.lit(1), n)).alias("sentence"), S.number(thought).alias("thought"), S.number((F.length(t) < 50) | ~c.rlike("[.!?]")).alias("orphan"),
        (0.5 * S.number(S.starts_upper(t)) + 0.5 * S.number(S.ends_sentence(t))).alias("bound"), paired(F.col("lap")).alias("lap"), paired(F.col("flow")).alias("flow"), paired(F.when(F.left(c, F.lit(100)).rlike(_REF), 0.5).otherwise(1.0)).alias("refs"),
        F.when(F.col("n") < 2, 1.0).when(F.size("u") == 0, 0.0).otherwise(F.size(F.array_intersect("u", F.array_distinct("near"))) / F.size("u")).alias("nearby"),
        F.when(F.size("w") > 0, F.size(F.filter("w", lambda x: (F.length(x) > 3) & ~F.lower(x).isin(STOPS))) / F.size("w")).otherwise(0.0).alias("dense"), redundancy(F.col("st")).alias("redundant"),
        F.when(F.size("t") > 0, F.size("u") / F.size("t")).otherwise(0.0).alias("uniq"),
        c.rlike(r"(?dm)^#{1,6}\s+.+$").cast("int").alias("header"), (items + F.size(F.regexp_extract_all(c, F.lit(r"(?dm)^\d+\.\s+.+$"), F.lit(0))) >= 2).cast("int").alias("listed"), code.cast("int").alias("code"),
        c.rlike(r"(?d)\|.+\|.*\n\|[-:\s|]+\|").cast("int").alias("tab"), ((c.contains("```") & ~code) | (items == 1)).cast("int").alias("broken"),
        S.number(thought & ~c.rlike(_ALONE)).alias("alone"), S.number((F.size("u") > 10) & (F.size("u") / F.size("t") > 0.2)).alias("rich"),
        F.when(n == 0, 0.0).otherwise(
            0.3 * S.number((F.length(F.col("s")[0]) > 20) & (F.length(F.col("s")[0]) < 200)) + 0.3 * S.number(full(F.col("s")[0]))
            + F.when(n < 2, 0.4).when(F.size(rest) == 0, 0.0).otherwise(0.4 * F.size(F.array_intersect(F.col("st")[0], rest)) / F.size(rest))
        ).alias("summary"),
        (0.2 * S.number(c.rlike(_ASKS)) + 0.2 * S.number(c.rlike("(?d)" + _DEFINES)) + 0.2 * S.number(F.size("t") > 20) + 0.2 * many(_NAMES) + 0.2 * many(_DIGITS)).alias("match"),
        "starts", "ends", paired(0.4 * F.col("lap") + 0.3 * F.col("flow") + 0.15 * F.col("ended") + 0.15 * F.col("starts")).alias("transition"), n.alias("n_sentences"),
    )


def report(frame, docs):
    """A row for each document: measures, the six families, coverage and the composite score."""
    m = chunk_measures(frame)
    mean = lambda *names: [F.avg(x).alias(x) for x in names]
    paired = lambda *names: [F.coalesce(F.avg(x), F.lit(0.0)).alias(x) for x in names]
    me = m.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), *mean("sentence", "thought", "orphan", "bound", "nearby", "dense", "redundant", "uniq", "alone", "rich", "summary", "match", "starts", "ends"), *paired("lap", "flow", "refs", "transition"),
        F.sum(F.expr("header + listed + code + tab")).alias("whole"), F.sum("broken").alias("broken"), F.avg("broken").alias("broken_share"), (F.sum(F.length("content")) + F.count("*") - 1).alias("chars_kept"), F.sum("n_sentences").alias("n_sentences"),
        F.flatten(F.collect_list("t")).alias("every"), F.collect_list(F.md5("content")).alias("digests"),
    )
    # within a document's row: what its terms and digests occur how often
    me = me.withColumns({"counts": F.transform(counted(F.col("every")), lambda x: x["n"].cast("long")), "copies": F.transform(counted(F.col("digests")), lambda x: x["n"].cast("long"))}).drop("every", "digests")
    total = lambda c, of: F.aggregate(c, F.lit(0.0), lambda a, x: a + of(x))
    held, logs = total("counts", lambda x: x), total("counts", lambda x: x * F.log2(x))
    entropy = F.when(F.size("counts") > 1, (F.log2(held) - logs / held) / F.log2(F.size("counts"))).otherwise(0.0)
    me = me.withColumns({"entropy": entropy, "repeated": F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + F.when(c > 1, c).otherwise(0))})
    original = docs.where("length(text) > 0").select("doc_id", F.length("text").alias("chars"), F.size(sentences(F.col("text"))).alias("n_original"))
    sc = me.join(original, "doc_id")
    one = F.col("n_chunks") < 2
    sc = sc.withColumns({
        "semantic": F.expr("0.3D * sentence + 0.3D * thought + 0.2D * (1 - orphan) + 0.2D * bound"), "context": F.when(one, 1.0).otherwise(F.expr("0.3D * lap + 0.3D * flow + 0.2D * refs + 0.2D * nearby")),
        "density": F.expr("0.3D * dense + 0.3D * (1 - redundant) + 0.2D * uniq + 0.2D * entropy"), "structure": F.when(F.col("whole") > 0, (F.col("whole") - F.col("broken")) / F.col("whole")).otherwise(1 - F.col("broken_share")),
        "retrieval": F.expr("0.3D * alone + 0.2D * rich + 0.25D * summary + 0.25D * match"), "boundary": F.when(one, 1.0).otherwise(F.expr("0.35D * starts + 0.35D * ends + 0.3D * transition")),
        "coverage": F.expr("least(1D, chars_kept / chars) * least(1D, n_sentences / greatest(1, n_original)) * (1 - repeated / n_chunks)"),
    })
    return sc.withColumn("composite", sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)))


_FAMILIES = [*WEIGHTS, "coverage", "composite"]


@query("e06_report", f"WITH {_MEASURED} SELECT doc_id, n_chunks, {', '.join(f'round({k}, 9) AS {k}' for k in _FAMILIES)} FROM measured")
def quality_report(spark, sf_dir):
    """E06 with E06a to E06g: six families of measures, coverage, and their weighted composite."""
    return report(chunks(spark, sf_dir), table(spark, sf_dir, "documents")).select("doc_id", "n_chunks", *[F.round(k, 9).alias(k) for k in _FAMILIES])


_SHOWN = "lap flow refs nearby dense redundant uniq entropy summary match transition".split()


@query("e06_measures", f"WITH {_MEASURED} SELECT doc_id, {', '.join(f'round({k}, 9) AS {k}' for k in _SHOWN)} FROM measured")
def report_measures(spark, sf_dir):
    """E06b, c, e, f: the measures behind the families."""
    return report(chunks(spark, sf_dir), table(spark, sf_dir, "documents")).select("doc_id", *[F.round(k, 9).alias(k) for k in _SHOWN])


#: Measure, how it must stand to a bound, and the advice's subject.
ADVICE = (
    ("orphan", ">", 0.2, "orphaned fragments"), ("sentence", "<", 0.7, "incomplete sentences"), ("lap", "<", 0.3, "low overlap"), ("refs", "<", 0.5, "lost references"), ("redundant", ">", 0.3, "redundancy"),
    ("dense", "<", 0.5, "low density"), ("broken_share", ">", 0.1, "broken structures"), ("alone", "<", 0.6, "dependent chunks"), ("rich", "<", 0.5, "few keywords"), ("transition", "<", 0.5, "poor transitions"), ("composite", "<", 0.6, "low overall quality"),
)
_SATISFIED = "satisfactory"
#: Bounds are compared after rounding, so that both engines judge sums of doubles alike.
_HELD = [f"CASE WHEN round({m}, 9) {op} {t}e0 THEN '{text}' END" for m, op, t, text in ADVICE]


@query("e06h_recommendations", f"WITH {_MEASURED}, r AS (SELECT doc_id, list_filter([{', '.join(_HELD)}], lambda x: x IS NOT NULL) AS advice FROM measured) SELECT doc_id, unnest(CASE WHEN len(advice) = 0 THEN ['{_SATISFIED}'] ELSE advice END) AS advice FROM r")
def report_advice(spark, sf_dir):
    held = F.array_compact(F.array(*[F.expr(x.replace("e0 THEN", "D THEN")) for x in _HELD]))
    r = report(chunks(spark, sf_dir), table(spark, sf_dir, "documents")).select("doc_id", held.alias("advice"))
    return r.select("doc_id", F.explode(F.when(F.size("advice") == 0, F.array(F.lit(_SATISFIED))).otherwise(F.col("advice"))).alias("advice"))


_CUT = f"""CASE WHEN size > {CHUNK} * 1.5 THEN [{{'s': s, 'e': s + size // 2, 'score': score * 0.9e0, 'reason': reason || ' (split for size)'}}, {{'s': s + size // 2, 'e': e, 'score': score * 0.9e0, 'reason': 'Continuation (split for size)'}}] ELSE [{{'s': s, 'e': e, 'score': score, 'reason': reason}}] END"""


@query(
    "q28_sized_boundaries",
    f"""WITH seg AS (SELECT conv_id AS doc_id, turn, length(text) AS n, list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 2)) AS own, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS total, sum(length(text) + 1) OVER w AS upto FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
    p AS (SELECT *, lead(own) OVER (PARTITION BY doc_id ORDER BY k) AS next FROM seg), b AS (SELECT doc_id, k, total, upto, CASE WHEN k < total THEN {_SIM('own', 'next')} END AS similarity FROM p), cut AS (SELECT * FROM b WHERE similarity < 0.56 OR k = total),
    c AS (SELECT doc_id, CAST(coalesce(lag(upto) OVER (PARTITION BY doc_id ORDER BY k), 0) AS BIGINT) AS s, CAST(CASE WHEN k = total THEN upto - 1 ELSE upto END AS BIGINT) AS e, CASE WHEN k = total THEN 0.8e0 ELSE 1 - similarity END AS score, CASE WHEN k = total THEN 'End of content' ELSE 'Sentence boundary' END AS reason FROM cut),
    d AS (SELECT *, e - s AS size FROM c) SELECT doc_id, x.s AS start_char, x.e AS end_char, round(x.score, 6) AS score, x.reason AS reason FROM (SELECT doc_id, unnest({_CUT}) AS x FROM d WHERE size >= {CHUNK} * 0.3)""",
)
def sized_boundaries(spark, sf_dir):
    """Q28: boundaries between segments by running offsets; parts under 0.3 of the size go, those over 1.5 are cut in the middle."""
    w = Window.partitionBy("doc_id").orderBy("turn", "text")
    own = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: F.length(x) > 2))
    seg = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text").withColumns({"own": own, "upto": F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    b = seg.withColumn("next", F.lead("own").over(w)).withColumn("last", F.col("next").isNull()).withColumn("similarity", F.when(~F.col("last"), similar(F.col("own"), F.col("next"))))
    cut = b.where("similarity < 0.56 OR last")
    c = cut.select(
        "doc_id", F.coalesce(F.lag("upto").over(w), F.lit(0)).alias("s"), F.when(F.col("last"), F.col("upto") - 1).otherwise(F.col("upto")).alias("e"),
        F.when(F.col("last"), 0.8).otherwise(1 - F.col("similarity")).alias("score"), F.when(F.col("last"), "End of content").otherwise("Sentence boundary").alias("reason"),
    ).where(F.col("e") - F.col("s") >= CHUNK * 0.3)
    part = lambda s, e, by, reason: F.struct(s.alias("s"), e.alias("e"), (F.col("score") * by).alias("score"), reason.alias("reason"))
    middle = F.expr("s + (e - s) div 2")
    both = F.array(part(F.col("s"), middle, 0.9, F.concat("reason", F.lit(" (split for size)"))), part(middle, F.col("e"), 0.9, F.lit("Continuation (split for size)")))
    parts = F.when(F.col("e") - F.col("s") > CHUNK * 1.5, both).otherwise(F.array(part(F.col("s"), F.col("e"), 1.0, F.col("reason"))))
    return c.select("doc_id", F.explode(parts).alias("x")).select("doc_id", F.col("x.s").alias("start_char"), F.col("x.e").alias("end_char"), F.round("x.score", 6).alias("score"), F.col("x.reason").alias("reason"))
