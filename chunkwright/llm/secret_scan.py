"""Secret scans with corpus-wide ownership frequency, in DataFrame expressions only.

Base spans come from three patterns. The method hashes every candidate value, counts the distinct
repositories and owners it stands in, and calls it an example if many owners have it, live if it
belongs to one owner. Bare tokens that look like credentials become spans of kind `live` only if
they are owner-specific.

Defined results: null text is empty (no spans); very long texts are read whole; null owners or
repositories count as one unnamed owner or repository; null or repeated doc_ids and repeated rows each
give a row; spans with one start come in the order of KINDS; an empty table gives no rows; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.common import materialize

#: The patterns and their order among spans with one start.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BARE = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "live")
MIN_ASSIGNED = 8
#: A value that this many owners have is a copied example.
EXAMPLE_OWNERS = 3

SPAN = "struct<s:bigint,k:int,e:bigint,v:string>"


def _spans(pattern: str, kind: int, value_group: int) -> str:
    """SQL for the pattern's matches in `text` with their places: pieces between matches give the offsets."""
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found = f"regexp_extract_all(text, {p}, {value_group})"
    whole = f"regexp_extract_all(text, {p}, 0)" if value_group else found
    return f"""CASE WHEN regexp_instr(text, {p}) = 0 THEN cast(array() AS array<{SPAN}>) ELSE
      aggregate(arrays_zip(split(text, {p}, -1) AS p, {whole} AS m, {found} AS v),
        named_struct('at', 0L, 'out', cast(array() AS array<{SPAN}>)),
        (a, x) -> CASE WHEN x.m IS NULL THEN a ELSE named_struct(
          'at', a.at + length(x.p) + length(x.m),
          'out', concat(a.out, array(named_struct('s', a.at + length(x.p), 'k', {kind}, 'e', a.at + length(x.p) + length(x.m), 'v', x.v)))) END,
        a -> a.out) END"""


def _zipped(sql: str) -> str:
    """arrays_zip names its fields 0, 1, 2 for expressions; name them as the lambda expects."""
    return sql.replace(" AS p,", ",").replace(" AS m,", ",").replace(" AS v)", ")").replace("x.p", "x.`0`").replace("x.m", "x.`1`").replace("x.v", "x.`2`")


def candidates(docs: DataFrame, owner: list[str], repo: list[str]) -> DataFrame:
    """doc_id, owner, repo, text key (null without spans), base spans and live-looking bare ones; values are hashed."""
    key = lambda cols: F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    read = docs.select("doc_id", key(owner).alias("owner"), key(repo).alias("repo"), F.coalesce("text", F.lit("")).alias("text"))
    found = read.select(
        "doc_id", "owner", "repo", "text",
        F.expr(f"filter({_zipped(_spans(ASSIGN, 0, 2))}, x -> length(x.v) >= {MIN_ASSIGNED})").alias("assign"),
        F.expr(_zipped(_spans(ACCESS, 1, 0))).alias("access"),
        F.expr(_zipped(_spans(HEX, 2, 0))).alias("hex"),
        F.expr(f"filter({_zipped(_spans(BARE, 3, 0))}, x -> x.v rlike '[0-9]' AND x.v rlike '[a-z]' AND x.v rlike '[A-Z]')").alias("bare"),
    )
    base = found.withColumn("base", F.expr("array_sort(concat(assign, access, hex))"))
    hashed = lambda c: f"transform({c}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'v', sha2(x.v, 256)))"
    return base.select(
        "doc_id", "owner", "repo",
        F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        F.expr("CASE WHEN size(base) + size(bare) > 0 THEN sha2(text, 256) END").alias("text_key"),
        F.expr(hashed("base")).alias("base"),
        F.expr(hashed("filter(bare, x -> NOT exists(base, b -> b.s < x.e AND x.s < b.e))")).alias("bare"),
    )


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Distinct repositories and owners of each candidate hash, and its class; counts are partial before each shuffle."""
    seen = found.where("text_key IS NOT NULL").select("owner", "repo", F.explode(F.concat("base", "bare")).alias("x")).select("owner", "repo", F.col("x.v").alias("v"))
    by_repo = seen.groupBy("v", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("v", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("v").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_seen")).withColumn(
        "verdict", F.when(F.col("n_owners") >= example_owners, "example").when(F.col("n_owners") == 1, "live").otherwise("shared")
    )


def scan(docs: DataFrame, owner: list[str], repo: list[str], example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per document: counts, base spans, all spans (array of s, k, e, v) and numbers by verdict."""
    found = materialize(candidates(docs, owner, repo))
    # aggregates are written before they are joined, so that the partition of a frequent value or text can be split
    owned = materialize(ownership(found, example_owners))
    spans = found.where("text_key IS NOT NULL").select("text_key", F.explode(F.concat("base", "bare")).alias("x")).select("text_key", "x.*").distinct()
    judged = (
        spans.join(owned, "v")
        .groupBy("text_key")
        .agg(
            F.expr("collect_list(named_struct('s', s, 'k', k, 'e', e, 'v', v)) FILTER (WHERE k = 3 AND verdict = 'live')").alias("live"),
            F.expr("collect_list(named_struct('s', s, 'k', k, 'e', e, 'v', v)) FILTER (WHERE verdict = 'example')").alias("example"),
            F.count_if(F.col("verdict") == "example").alias("n_examples"),
            F.count_if((F.col("verdict") == "live") & (F.col("k") < 3)).alias("n_owned"),
        )
    )
    judged = materialize(judged)
    none = F.expr(f"cast(array() AS array<{SPAN}>)")
    with_spans = found.where("text_key IS NOT NULL").join(judged, "text_key", "left")
    plain = found.where("text_key IS NULL").withColumns({"live": none, "example": none, "n_examples": F.lit(0), "n_owned": F.lit(0)})
    return with_spans.unionByName(plain).select(
        "doc_id", "text_key", "n_assign", "n_access", "n_hex", "base",
        F.array_sort(F.concat("base", F.coalesce("live", none))).alias("spans"),
        F.coalesce("example", none).alias("examples"),
        F.coalesce("n_examples", F.lit(0)).alias("n_examples"), F.coalesce("n_owned", F.lit(0)).alias("n_owned"),
    )


def joined(spans: str) -> str:
    names = f"element_at(array{KINDS}, x.k + 1)"
    return f"array_join(transform({spans}, x -> concat({names}, ':', x.s, ':', x.e)), ',')"


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.expr(f"sha2({joined('base')}, 256)").alias("base_sha256"), F.expr(joined("spans")).alias("spans"), "n_examples", "n_owned"
    )


def redact(docs: DataFrame, owner: list[str], repo: list[str], placeholder: str = "[secret]") -> DataFrame:
    """docs with every span that isn't a copied example replaced; n_chars follows the text. Rows all stay.

    Overlapping spans are replaced as one. Documents are matched to their spans by text.
    """
    scanned = scan(docs, owner, repo)
    keyed = (
        scanned.where("text_key IS NOT NULL")
        .select("text_key", F.expr("filter(spans, x -> NOT exists(examples, e -> e.s = x.s AND e.k = x.k))").alias("gone"))
        .where("size(gone) > 0")
        .groupBy("text_key")
        .agg(F.min("gone").alias("gone"))
    )
    keyed = materialize(keyed)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), text.alias("whole"), F.sha2(text, 256).alias("text_key")).join(keyed, "text_key", "left")
    cut = F.expr(
        f"""aggregate(gone, named_struct('at', 0L, 'out', ''),
          (a, x) -> CASE WHEN x.e <= a.at THEN a WHEN x.s < a.at THEN named_struct('at', x.e, 'out', a.out)
            ELSE named_struct('at', x.e, 'out', concat(a.out, substring(whole, int(a.at + 1), int(x.s - a.at)), '{placeholder}')) END,
          a -> concat(a.out, substring(whole, int(a.at + 1))))"""
    )
    rows = rows.withColumn("cut", F.when(F.col("gone").isNotNull(), cut))
    new = {"text": F.col("cut"), "n_chars": F.length("cut")}
    old = {f.name: F.col("row").getField(f.name) for f in docs.schema.fields}
    return rows.select(*[(F.when(F.col("gone").isNull(), old[f.name]).otherwise(new[f.name].cast(f.dataType)) if f.name in new else old[f.name]).alias(f.name) for f in docs.schema.fields])


def _duck(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _duck_kind(kind: int, pattern: str, group: int, keep: str) -> str:
    p = _duck(pattern)
    return f"""
    m{kind} AS (SELECT rid, unnest(regexp_extract_all(text, {p}, 0)) AS m, unnest(regexp_extract_all(text, {p}, {group})) AS v,
        generate_subscripts(regexp_extract_all(text, {p}, 0), 1) AS i FROM d),
    p{kind} AS (SELECT rid, unnest(string_split_regex(text, {p})) AS p, generate_subscripts(string_split_regex(text, {p}), 1) AS i FROM d),
    s{kind} AS (SELECT * FROM (SELECT rid, v, {kind} AS k, sum(length(p) + length(m)) OVER w - length(m) AS s, sum(length(p) + length(m)) OVER w AS e
        FROM m{kind} JOIN p{kind} USING (rid, i) WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE {keep})"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(source, '') || chr(1) || coalesce(lang, '') AS repo, coalesce(text, '') AS text FROM documents),
{_duck_kind(0, ASSIGN, 2, f"length(v) >= {MIN_ASSIGNED}")},
{_duck_kind(1, ACCESS, 0, "true")},
{_duck_kind(2, HEX, 0, "true")},
{_duck_kind(3, BARE, 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')")},
base AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2),
every AS (SELECT * FROM base UNION ALL SELECT * FROM s3 x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = x.rid AND b.s < x.e AND x.s < b.e)),
owned AS (SELECT v, count(DISTINCT owner) AS n_owners FROM every JOIN d USING (rid) GROUP BY v),
named AS (SELECT rid, k, s, n_owners, ['assign', 'access', 'hex', 'live'][k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM every JOIN owned USING (v)),
per AS (SELECT rid, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS b, count(*) FILTER (WHERE k = 2) AS c,
    string_agg(span, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(span, ',' ORDER BY s, k) FILTER (WHERE k < 3 OR n_owners = 1) AS spans,
    count(*) FILTER (WHERE n_owners >= {EXAMPLE_OWNERS}) AS n_examples, count(*) FILTER (WHERE k < 3 AND n_owners = 1) AS n_owned FROM named GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans, coalesce(n_examples, 0) AS n_examples, coalesce(n_owned, 0) AS n_owned
FROM d LEFT JOIN per USING (rid)
"""
