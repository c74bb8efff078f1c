"""Rules over the lines of a text, as Columns and as DuckDB SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkwright.functions.rewrite import BLANKS, quoted

_DUCK_BLANKS = "' ' || chr(9) || chr(13) || chr(10)"


def _replacing(pattern: str, to: str):
    return lambda line: F.regexp_replace(line, pattern, to)


@dataclass(frozen=True)
class LineRule:
    """Filters lines by patterns on the trimmed line, rewrites them, or keeps the first of equal ones."""

    drop: list[str] = field(default_factory=list)
    drop_sql: str = ""  # a further condition on t (trimmed line), in SQL that both engines read
    rewrite: list[tuple[str, str]] = field(default_factory=list)
    trim: bool = False
    distinct: bool = False
    before: list[tuple[str, str]] = field(default_factory=list)

    def column(self, text: Column) -> Column:
        for pattern, to in self.before:
            text = F.regexp_replace(text, pattern, to)
        found = F.split(text, "\n")
        if self.drop or self.drop_sql:
            keep = lambda line: ~self._dropped(F.btrim(line, F.lit(BLANKS)))
            found = F.filter(found, keep)
        if self.trim:
            found = F.transform(found, lambda line: F.btrim(line, F.lit(BLANKS)))
        for pattern, to in self.rewrite:
            found = F.transform(found, _replacing(pattern, to))
        if self.distinct:
            found = F.array_distinct(found)
        return F.array_join(found, "\n")

    def _dropped(self, t: Column) -> Column:
        cond = F.lit(False)
        for pattern in self.drop:
            cond = cond | t.rlike("(?i)" + pattern)
        if self.drop_sql:
            low = t.rlike(r"\p{Ll}|\p{Lo}|\p{Lt}|\p{Lm}|[0-9]")
            cond = cond | ((F.length(t) < 20) & (F.length(t) > 2) & ~low)
        return cond

    def duckdb(self, text: str) -> str:
        for pattern, to in self.before:
            text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(to)}, 'g')"
        found = f"string_split({text}, chr(10))"
        if self.drop or self.drop_sql:
            t = f"trim(l, {_DUCK_BLANKS})"
            conditions = [f"regexp_matches({t}, {quoted('(?i)' + p)})" for p in self.drop]
            if self.drop_sql:
                conditions.append(f"(length({t}) < 20 AND length({t}) > 2 AND NOT regexp_matches({t}, '\\p{{Ll}}|\\p{{Lo}}|\\p{{Lt}}|\\p{{Lm}}|[0-9]'))")
            found = f"list_filter({found}, lambda l: NOT ({' OR '.join(conditions)}))"
        if self.trim:
            found = f"list_transform({found}, lambda l: trim(l, {_DUCK_BLANKS}))"
        for pattern, to in self.rewrite:
            to = to.replace("$1", "\\1").replace("$2", "\\2")
            found = f"list_transform({found}, lambda l: regexp_replace(l, {quoted(pattern)}, {quoted(to)}))"
        if self.distinct:
            found = f"list_transform([{found}], lambda f: list_filter(f, lambda l, i: list_position(f, l) = i))[1]"  # found is made once
        return f"array_to_string({found}, chr(10))"


#: Lines that are page furniture.
FURNITURE = [
    r"^Page\s+\d+\s*(of\s+\d+)?$", r"^\d+\s*/\s*\d+$", r"^-\s*\d+\s*-$", r"^\[\s*\d+\s*\]$", r"^페이지\s*\d+", r"^\d+\s*페이지$",
    r"^(CONFIDENTIAL|DRAFT|INTERNAL|PROPRIETARY|SECRET)$", r"^©\s*\d{4}", r"^Copyright\s+", r"^All [Rr]ights [Rr]eserved",
    r"^(Version|Rev\.|Revision)\s*[\d\.]+$", r"^\d{4}[-/]\d{2}[-/]\d{2}$", r"^(Document|Doc)\s*(ID|#|No\.?):\s*",
    r"^#\s*댓글\s*$", r"^-\s*댓글\s*\d+\s*개\s*$", r"^(주)|(주식회사)\s*\S+$", r"^[-_=]{3,}\s*$", r"^[─━═]{3,}\s*$",
]

#: Heading texts that are annotations.
ANNOTATIONS = [r"[\(（].*[\)）]\s*", r"※.*", r"\*\s*", r"•.*", r"\d+\.\s*", r"[.,:;]+\s*"]

CLEAN_LINES = LineRule(trim=True, before=[(r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")])
DROP_FURNITURE = LineRule(drop=FURNITURE, drop_sql="capitals")
DROP_PAGE_NUMBERS = LineRule(drop=[r"^-?\s*\d+\s*-?$"])
DEMOTE_ANNOTATIONS = LineRule(rewrite=[(r"^#{1,6}\s+(\s*(?:" + "|".join(ANNOTATIONS) + r"))$", "$1")])
DROP_EMPTY_HEADINGS = LineRule(drop=[r"^#{1,6}\s*$"])
DISTINCT_LINES = LineRule(distinct=True)


def heading_levels(text: Column) -> Column:
    """Levels of the text's headings in order."""
    found = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"^#{1,6}\s+.*$"))
    return F.transform(found, lambda line: F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1)))


def repaired_levels(levels: Column, first: int = 2, jump: int = 1) -> Column:
    """A first heading deeper than `first` becomes level 1; others go at most `jump` below the one before, repaired ones counting."""
    start = F.array().cast("array<int>")
    return F.aggregate(
        levels,
        start,
        lambda done, level: F.concat(
            done,
            F.array(F.when(F.size(done) == 0, F.when(level > first, 1).otherwise(level)).otherwise(F.least(level, F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + jump)).cast("int")),
        ),
    )


def few_blank_lines(text: Column) -> Column:
    """Lines without trailing blanks, and at most two blank lines in a row, at the ends too."""
    text = F.regexp_replace(text, r"(?dm)[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\A\n{3,}", "\n\n"), r"\n{3,}\z", "\n\n"), r"\n{4,}", "\n\n\n")
