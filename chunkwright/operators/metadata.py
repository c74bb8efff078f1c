"""Metadata by rules: fields, topics, keywords, description, document type and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.functions.arrays import bound
from chunkwright.functions.rewrite import BLANKS
from chunkwright.functions.scores import contains_any, words

#: Fixed values, down to CATEGORIES: patterns in the order in which they are tried (group 1 is the value), names of
#: frameworks and technologies, stop words, terms of document types and of categories.
PRODUCT = [r"(?im)([A-Za-z0-9\s\-]+)\s+(?:Manual|User\s+Guide|Guide|Instructions)", r"(?im)^([A-Z][A-Za-z0-9\s\-]+)\s*\r?\n", r"(?im)Product:\s*([A-Za-z0-9\s\-]+)", r"(?im)Model:\s*([A-Za-z0-9\s\-]+)"]
COMPANY = [r"(?i)©\s*\d{4}\s+([A-Z][A-Za-z\s]+?)(?:\s+Inc\.|Corporation|Ltd\.|LLC|Co\.|,|$)", r"(?i)Copyright\s+(?:\d{4}\s+)?([A-Z][A-Za-z\s]+?)(?:\s+Inc\.|Corporation|Ltd\.|LLC|Co\.|,|$)", r"(?i)Manufacturer:\s*([A-Za-z\s]+)", r"(?i)Company:\s*([A-Za-z\s]+)"]
VERSION = [r"(?i)(?:Version|Ver\.|v)\s*(\d+\.\d+(?:\.\d+)?)", r"(?i)(?:Firmware|Software)\s+(?:Version\s+)?(\d+\.\d+(?:\.\d+)?)", r"(?i)(?:iOS|Android|Windows)\s+(\d+(?:\.\d+)?)", r"(?i)Rev(?:ision)?\s*(\d+(?:\.\d+)?)"]
RELEASED = [r"(?i)(?:Released?|Published?|Date):\s*(\d{1,2}[\/-]\d{1,2}[\/-]\d{4})", r"(?i)(?:Released?|Published?|Date):\s*([A-Za-z]+\s+\d{1,2},?\s+\d{4})", r"(\d{4}-\d{2}-\d{2})"]
LIBRARIES = [r"import\s+([a-zA-Z0-9_\.@\/\-]+)", r"from\s+([a-zA-Z0-9_\.]+)\s+import", r"using\s+([a-zA-Z0-9_\.]+);", r"""require\(['"]([^'"]+)['"]\)""", r"""#include\s+[<"]([^>"]+)[>"]""", r"use\s+([a-zA-Z0-9_\\]+);", r"""import\s+\{[^}]+\}\s+from\s+['"]([^'"]+)['"]"""]
FRAMEWORKS = "React Vue Angular Svelte Next.js Nuxt Express FastAPI Django Flask Spring ASP.NET TensorFlow PyTorch scikit-learn Docker Kubernetes AWS Azure GCP".split()
TECHNOLOGIES = "JavaScript TypeScript Python C# Java Go Rust C++ API REST GraphQL gRPC WebSocket SQL NoSQL MongoDB PostgreSQL MySQL Redis HTML CSS SCSS Tailwind".split()
KEYWORD_STOPS = "the is at which on a an and or but in with to for of as by this that these those".split()
TYPES = {
    "manual": ["user guide", "manual", "instructions", "how to use"], "tutorial": ["tutorial", "getting started", "step by step", "walkthrough"],
    "reference": ["api reference", "documentation", "specification", "reference guide"], "guide": ["guide", "overview", "introduction"],
    "article": ["abstract", "conclusion", "methodology"],
}
CATEGORIES = {
    "Technical": "code function api algorithm system software implementation class method debug compile syntax",
    "Legal": "legal law contract agreement clause liability court statute regulation compliance attorney pursuant",
    "Academic": "research study hypothesis methodology abstract conclusion literature citation reference analysis findings",
    "Financial": "finance investment revenue profit market portfolio asset equity dividend fiscal budget earnings",
    "Medical": "patient diagnosis treatment medical clinical symptom disease therapy medication health physician hospital",
    "Business": "business strategy management market customer product service growth performance stakeholder competitive",
    "Creative": "story character plot narrative creative artistic design aesthetic inspiration imagination expression",
}


#: A pattern that begins with a run of characters can only match from the run's beginning; said so, it isn't tried from all others.
_RUN = r"([A-Za-z0-9\s\-]+)\s+"


def first_match(text: Column, patterns: list[str]) -> Column:
    anchored = [p.replace(_RUN, r"(?<![A-Za-z0-9\s\-])" + _RUN) for p in patterns]
    return F.coalesce(*[F.nullif(F.btrim(F.regexp_extract(text, p, 1), F.lit(BLANKS)), F.lit("")) for p in anchored])


def libraries(text: Column, most: int = 15) -> Column:
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in LIBRARIES]))
    return F.slice(F.array_distinct(F.filter(found, lambda x: ~x.startswith(".") & ~x.startswith("/") & (F.length(x) > 2))), 1, most)


def mentioned(text: Column, terms: list[str], most: int = 10) -> Column:
    low = F.lower(text)
    return F.slice(F.array_compact(F.array(*[F.when(low.contains(t.lower()), F.lit(t)) for t in terms])), 1, most)


def topics(text: Column, most: int = 5) -> Column:
    """Headings of levels 1 to 3, then numbered lines; the first of equal ones (ignoring case)."""
    heads = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?dm)^#{1,3}\s+(.+)$"), F.lit(1)), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: (F.length(x) > 3) & (F.length(x) < 60))
    numbered = F.transform(F.regexp_extract_all(text, F.lit(r"(?dm)^\d+[\.\)]\s+([A-Z][^\r\n]{3,60})"), F.lit(1)), lambda x: F.btrim(x, F.lit(BLANKS)))
    every = F.concat(heads, numbered)
    low = F.transform(every, F.lower)
    return F.slice(F.filter(every, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, most)


def keywords(docs: DataFrame, most: int = 10) -> DataFrame:
    """doc_id, keyword, n, rank: the most frequent words; ties by first place, then by the word."""
    found = docs.select("doc_id", F.posexplode(F.split("text", r"\W+")).alias("i", "w")).withColumn("w", F.lower("w"))
    kept = found.where((F.length("w") > 3) & (F.length("w") < 30) & ~F.col("w").isin(KEYWORD_STOPS) & ~F.col("w").rlike(r"^\d+$"))
    counted = kept.groupBy("doc_id", "w").agg(F.count("*").alias("n"), F.min("i").alias("at"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "at", "w"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", F.col("w").alias("keyword"), "n", "rank")


def document_type(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(F.btrim(text, F.lit(BLANKS)) == "", "unknown")
    for kind, terms in TYPES.items():
        out = out.when(contains_any(low, terms), kind)
    return out.otherwise("document")


def category_scores(text: Column) -> dict[str, Column]:
    """One split into words; only those of any category are looked at again."""
    n = F.size(words(text))
    known = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w.isin(sorted({t for terms in CATEGORIES.values() for t in terms.split()})))

    def shares(x: Column) -> Column:
        hits = lambda terms: F.size(F.filter(x["known"], lambda w: w.isin(terms.split())))
        return F.struct(*[F.when(x["n"] > 0, F.least(F.lit(1.0), hits(terms) / x["n"] * 100)).otherwise(0.0).alias(c) for c, terms in CATEGORIES.items()])

    found = bound(F.struct(n.alias("n"), known.alias("known")), shares)
    return {c: found[c] for c in CATEGORIES}


#: What a file type multiplies a category's score by, and subtypes: all of whose words a text holds (any of several lots), in order.
BOOSTS = {"Technical": (("cs", "py", "js", "java"), 1.5), "Business": (("docx", "doc"), 1.2), "Academic": (("pdf",), 1.1)}
SUBTYPES = {
    "Technical": (("API Documentation", (("API",), ("endpoint",))), ("README", (("README",), ("Installation",))), ("Code Documentation", (("class", "method"),)), ("Technical Documentation", ((),))),
    "Legal": (("Contract", (("agreement",), ("contract",))), ("Patent", (("patent",),)), ("Compliance", (("compliance",),)), ("Legal Document", ((),))),
    "Academic": (("Research Paper", (("abstract", "methodology"),)), ("Thesis", (("thesis",),)), ("Literature Review", (("review",),)), ("Academic Paper", ((),))),
}


def boosted(scores: dict[str, Column], extension: Column) -> dict[str, Column]:
    return {c: F.when(extension.isin(*BOOSTS[c][0]), s * BOOSTS[c][1]).otherwise(s) if c in BOOSTS else s for c, s in scores.items()}


def subtype(category: Column, text: Column) -> Column:
    """The category's first subtype whose words stand in the text as written; null for categories without any."""
    out = F.lit(None).cast("string")
    for kind, rules in SUBTYPES.items():
        for name, lots in reversed(rules):
            for lot in lots:
                held = category == kind
                for word in lot:
                    held = held & text.contains(word)
                out = F.when(held, name).otherwise(out)
    return out


def complexity(text: Column) -> Column:
    own = words(text)
    n = F.size(own)
    length = F.aggregate(own, F.lit(0), lambda a, w: a + F.length(w)) / n
    sentences = F.split(text, "[.!?]+")
    sentence = F.aggregate(sentences, F.lit(0), lambda a, s: a + F.size(words(s))) / F.size(sentences)
    unique = F.size(F.array_distinct(own)) / n
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), length / 10 * 0.3 + sentence / 30 * 0.4 + (1 - unique) * 0.3)))
