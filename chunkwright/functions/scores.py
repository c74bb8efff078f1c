"""Scores of chunks and pairs of neighbouring chunks, as Columns.

Scores take a text Column, or the Parts of one: what several scores need of a text, which derived()
adds as columns, so that they are made once for each row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.functions.rewrite import BLANKS

#: Word lists.
STOP_WORDS = "the a an and or but in on at to for of with by is are was were be been have has had do does did".split()
TRANSITIONS = "however therefore additionally furthermore moreover consequently".split()
KEYWORDS = "api data system method process result analysis".split()
CONNECTORS = "however therefore furthermore moreover".split()
PRONOUNS = "it this that these those he she they them here there".split()
REFERENCES = "above below previous following aforementioned said former latter".split()
SENTENCE_STARTS = "The A An It This That I We You He She They".split()


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


@dataclass
class Parts:
    """A text and what is derived from it; words are what single spaces separate, without empty ones."""

    text: Column
    low: Column
    trimmed: Column
    words: Column
    low_words: Column
    pieces: Column


def parts(text: Column | Parts) -> Parts:
    if isinstance(text, Parts):
        return text
    own = words(text)
    return Parts(text, F.lower(text), trimmed(text), own, F.transform(own, F.lower), F.filter(F.split(text, "[.!?]"), lambda s: s != ""))


def derived(frame: DataFrame, name: str = "content") -> tuple[DataFrame, Parts]:
    """frame with the parts of a text column as columns, and these."""
    found = vars(parts(F.col(name)))
    text = found.pop("text")
    return frame.withColumns({f"{name}_{k}": v for k, v in found.items()}), Parts(text, **{k: F.col(f"{name}_{k}") for k in found})


def number(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def contains_any(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | text.contains(term)
    return out


def count_contained(text: Column, terms: list[str]) -> Column:
    return sum((F.when(text.contains(t), 1).otherwise(0) for t in terms), F.lit(0))


def ends_sentence(text: Column) -> Column:
    return text.rlike(r"[.!?]\z")


def starts_upper(text: Column) -> Column:
    return text.rlike(r"\A\p{Lu}")


def completeness(text: Column | Parts) -> Column:
    t = parts(text).trimmed
    score = 0.5 + 0.2 * number(ends_sentence(t)) + 0.1 * number(starts_upper(t)) + 0.2 * number((F.length(t) > 50) & (F.length(t) < 2000))
    return F.when(t == "", 0.0).otherwise(score)


def coherence(text: Column | Parts) -> Column:
    p = parts(text)
    sentences = F.size(F.filter(F.split(p.text, r"\."), lambda s: s != ""))
    repeated = 1 - F.size(F.array_distinct(p.low_words)) / F.size(p.words)
    score = 0.5 + F.least(F.lit(0.3), 0.1 * count_contained(p.low, TRANSITIONS)) + 0.2 * number((repeated > 0.1) & (repeated < 0.5))
    return F.when(p.text == "", 0.0).when(sentences < 2, 0.8).otherwise(F.least(F.lit(1.0), score))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; both empty: 1, one empty: 0."""
    both, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(both / union)


def word_set(text: Column | Parts) -> Column:
    return F.array_distinct(parts(text).low_words)


def density(text: Column | Parts) -> Column:
    p = parts(text)
    meaning = F.filter(p.low_words, lambda w: (F.length(w) > 3) & ~w.isin(STOP_WORDS))
    return F.when(F.size(p.words) > 0, F.size(meaning) / F.size(p.words)).otherwise(0.0)


def context_dependency(text: Column | Parts) -> Column:
    p = parts(text)
    n = F.greatest(F.size(p.words), F.lit(1))
    pronoun = F.least(F.lit(1.0), 10 * F.size(F.filter(p.low_words, lambda w: w.rlike("^(?:" + "|".join(PRONOUNS) + ")"))) / n)
    reference = F.least(F.lit(1.0), count_contained(p.low, REFERENCES) / F.lit(3.0))
    t = p.trimmed
    first = F.substring_index(t, " ", 1)
    unfinished = F.least(
        F.lit(1.0),
        0.3 * number(t.rlike("^[a-z가-힣]")) + 0.4 * number(F.lower(first).rlike("^(and|or|but|however|therefore|thus|hence|also|또한|그리고|하지만|그러나|따라서|그래서)")) + 0.3 * number(~t.rlike("[.!?。」』]$")),
    )
    proper = F.filter(p.words, lambda w: (F.length(w) > 1) & starts_upper(w) & ~w.isin(SENTENCE_STARTS))
    named = F.least(F.lit(1.0), 5 * F.size(proper) / n)
    return F.when(t == "", 0.0).otherwise(F.least(F.lit(1.0), 0.3 * pronoun + 0.25 * reference + 0.25 * unfinished + 0.2 * (1 - named)))


def relevance(text: Column | Parts) -> Column:
    p = parts(text)
    full = F.size(F.filter(p.pieces, lambda s: trimmed(s) != ""))
    score = 0.5 + 0.1 * number(F.length(p.text) > 200) + 0.1 * number(F.length(p.text) > 500) + F.when(F.size(p.pieces) > 0, 0.3 * full / F.size(p.pieces)).otherwise(0.0)
    return F.when(p.trimmed == "", 0.0).otherwise(F.least(F.lit(1.0), score))


def sentence_completeness(text: Column | Parts) -> Column:
    p = parts(text)
    whole = F.size(F.filter(p.pieces, lambda s: F.length(trimmed(s)) > 10))
    return F.when((p.trimmed == "") | (F.size(p.pieces) == 0), 0.0).otherwise(F.greatest(F.lit(0.7), whole / F.size(p.pieces)))


def per_thousand(text: Column | Parts) -> Column:
    p = parts(text)
    unique = F.size(F.array_distinct(F.filter(p.words, lambda w: F.length(w) > 3)))
    return F.when(p.trimmed == "", 0.0).otherwise((unique + F.size(p.pieces)) * 1000.0 / F.length(p.text))


def content_type(text: Column) -> Column:
    t = trimmed(text)
    lines = F.split(t, "\n")
    code = t.startswith("```") | contains_any(t, ["function ", "class ", "def ", "public ", "private "])
    table = F.size(F.filter(lines, lambda x: x.contains("|"))) >= 2
    listed = t.rlike(r"^(?:- |\* |1\. )") | (F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("- "))) >= 2)
    heading = t.startswith("#") | ((F.length(t) < 100) & (F.size(lines) == 1) & starts_upper(t))
    return F.when(t == "", "text").when(code, "code").when(table, "table").when(listed, "list").when(heading, "heading").otherwise("text")


def role(kind: Column) -> Column:
    return F.when(kind == "heading", "title").when(kind == "code", "code_block").when(kind == "table", "table_content").when(kind == "list", "list_content").otherwise("content")


#: Topics by domain, and terms of each.
TOPICS = {
    "Technical": {
        "API": "api endpoint request response", "Architecture": "architecture system design pattern",
        "Database": "database sql query table index", "Security": "security auth token encryption ssl",
    },
    "Business": {
        "Strategy": "strategy plan goal objective", "Finance": "revenue cost budget profit finance",
        "Marketing": "marketing customer brand campaign", "Operations": "process workflow operation efficiency",
    },
    "Academic": {
        "Research": "research study analysis methodology", "Theory": "theory concept framework model",
        "Results": "result finding conclusion data", "Literature": "literature reference citation review",
    },
}


def share_of_terms(own: Column, terms: list[str]) -> Column:
    return F.when(F.size(own) > 0, F.size(F.filter(own, lambda w: w.isin(terms))) / F.size(own)).otherwise(0.0)


def topic_scores(text: Column, domain: str) -> dict[str, Column]:
    own = words(F.lower(text))
    return {topic: share_of_terms(own, terms.split()) for topic, terms in TOPICS.get(domain, {}).items()}
