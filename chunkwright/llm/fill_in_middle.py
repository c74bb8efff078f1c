"""Fill-in-middle transformation with lookaround splitting.

A unit grammar is a list of character classes that form runs; each character outside all of them is
a unit of its own. It becomes a zero-width regular expression: a place between two characters is a
boundary unless both belong to one run class. Spark's split at such places keeps every character, so
the pieces joined again are the text. Two cuts drawn from the document's id part the pieces into
prefix, middle and suffix, and the parts are put together again around markers.

Forms: psm is <P>prefix<S>suffix<M>middle, spm is <S>suffix<P>prefix<M>middle, plain is the text.

Defined results: null text is empty, and empty text, which split would make one empty piece, has no
unit and is plain; a text that holds a marker is plain, so each marker of an output stands once and
the text can be rebuilt; null doc_id is drawn as the empty string; repeated rows and doc_ids each
give a row, alike; very long texts are split whole; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.common import text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many stay plain; of 100 others so many put the suffix first.
PLAIN_SHARE, SPM_SHARE = 10, 20
SEED = "1"

#: Unit grammars: the classes whose characters form runs, as they stand between square brackets. All other characters are single.
GRAMMARS = {"letters": ["A-Za-z"], "words": ["A-Za-z0-9_", "\\x20\\x09-\\x0D"], "lines": ["^\\n"], "characters": []}


def boundary(runs: list[str]) -> str:
    """The zero-width expression that matches between two units, never at either end.

    Java looks at each half of a character beyond the basic plane on its own; no boundary stands before a second half.
    """
    return r"(?s)(?<=.)(?=.)(?![\uDC00-\uDFFF])" + "".join(f"(?!(?<=[{c}])[{c}])" for c in runs)


def units(text: Column, grammar: str = "letters") -> Column:
    """The units of a text as an array; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(GRAMMARS[grammar]), -1))


def drawn(doc_id: Column, seed: str, k: int) -> Column:
    """The k-th number (from 1) that the seed draws for a document: eight hexadecimal digits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, grammar: str = "letters", seed: str = SEED) -> DataFrame:
    """doc_id, text, n (units), form, prefix, middle, suffix (null if plain), output."""
    read = docs.select("doc_id", text_of().alias("text")).withColumn("pieces", units(F.col("text"), grammar))
    cut = read.select(
        "doc_id", "text", "pieces", F.size("pieces").cast("long").alias("n"),
        *[drawn(F.col("doc_id"), seed, k).alias(f"h{k}") for k in (1, 2, 3, 4)],
    ).withColumns({"from": F.expr("least(h1 % (n + 1), h2 % (n + 1))"), "to": F.expr("greatest(h1 % (n + 1), h2 % (n + 1))")})
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(marker))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= 100 - PLAIN_SHARE)
    part = lambda first, end: F.when(F.col("form") != "plain", F.array_join(F.slice("pieces", first.cast("int") + 1, (end - first).cast("int")), ""))
    formed = cut.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < SPM_SHARE, "spm").otherwise("psm"))
    parted = formed.select(
        "doc_id", "text", "n", "form", part(F.lit(0), F.col("from")).alias("prefix"), part(F.col("from"), F.col("to")).alias("middle"), part(F.col("to"), F.col("n")).alias("suffix")
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return parted.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))


def restored(output: Column, form: Column) -> Column:
    """The text from output and form alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digest(transformed: DataFrame) -> DataFrame:
    """doc_id, n, form, lengths of prefix and middle, digests of the output and of the text rebuilt from it."""
    return transformed.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: Units by a match of the grammar itself; the text that the parts are of is what must be restored.
ORACLE = f"""WITH read AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 cut AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS pieces, len(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]')) AS n,
   CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM read),
 formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
   CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {100 - PLAIN_SHARE} THEN 'plain' WHEN h4 % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM cut),
 parted AS (SELECT *, array_to_string(pieces[1:a], '') AS prefix, array_to_string(pieces[a + 1:b], '') AS middle, array_to_string(pieces[b + 1:n], '') AS suffix FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE text END) AS output_sha256,
 sha256(text) AS restored_sha256 FROM parted"""
