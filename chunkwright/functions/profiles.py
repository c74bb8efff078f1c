"""Language profiles, and sentence boundaries by their rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.functions.arrays import bound, running_sums
from chunkwright.functions.language import script_profile

#: White space within a character class.
S = r"\t-\r \x{85}\p{Z}"
#: A mark that texts don't contain.
MARK = "\x01"


@dataclass(frozen=True)
class Profile:
    """ends: sentence ends with what they take along; stops: signs that also end a sentence before one of closers;
    endings: word endings that count after a Hangul syllable and before white space. `_` in a rule is a white space character."""

    code: str
    name: str
    script: str
    direction: str
    numbers: str
    quotes: str
    ends: str
    sections: str
    stops: str = ""
    closers: str = ""
    endings: str = ""
    ignore_case: bool = False
    abbreviations: tuple[str, ...] = ()

    @property
    def pattern(self) -> str:
        """One sentence end, with look-around."""
        parts = [self.ends]
        if self.endings:
            parts.insert(1, f"(?<=[가-힣])(?:{self.endings})(?:_*\\z|_+)")
        if self.stops:
            parts.append(f"[{self.stops}]+(?=[{self.closers}])")
        return spaced("|".join(parts))

    @property
    def section_pattern(self) -> str:
        return ("(?iu)" if self.ignore_case else "") + spaced(self.sections)


def spaced(rule: str) -> str:
    return rule.replace("_", f"[{S}]")


_CLOSERS, _LATIN_ENDS = r"\"'\)\]}>", r"[.!?]+(?:_|\z)"
_HEADING, _NUMBERED = r"^#{1,6}_+[^\n]+", r"^_*\p{Nd}+\._+[^\n]+"
_LATIN_LETTER = r"^_*[A-Za-z]\._+[^\n]+"

#: The rules of each language.
PROFILES = [
    Profile(
        "en", "English", "Latn", "LeftToRight", "Standard", "“”‘’", _LATIN_ENDS, f"{_HEADING}|{_NUMBERED}|^_*[A-Z]\\._+[^\\n]+|^_*(?:Chapter|Section|Part)_+\\p{{Nd}}+", ".!?", _CLOSERS, ignore_case=True,
        abbreviations=("Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "vs", "etc", "Inc", "Ltd", "Corp", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec", "St", "Ave", "Blvd", "Rd", "U.S", "U.K", "E.U"),
    ),
    Profile(
        "ko", "Korean", "Hang", "LeftToRight", "Standard", "“”‘’",
        "습니다|입니다|됩니다|합니다|있습니다|했습니다|됐습니다|겠습니다|습니까|입니까|됩니까|합니까|세요|하세요|되세요|주세요",
        f"{_HEADING}|^_*[□■◇◆○●◎▶▷►★☆ㅇ]_+[^\\n]+|^_*[가나다라마바사아자차카타파하]_*[.．\\)）]_+[^\\n]+|^_*\\p{{Nd}}+_*[.．\\)）]_+[^\\n]+|^_*제_*\\p{{Nd}}+_*[장절조항]_*[^\\n]+",
        endings="다|음|됨|함|임|것|요|죠|네", abbreviations=("등", "외", "약", "예", "즉", "단"),
    ),
    Profile(
        "zh", "Chinese", "Hans", "LeftToRight", "NoGrouping", "“”‘’", r"[。！？；]+|[.!?;]+(?:_|\z)",
        f"{_HEADING}|^_*第[一二三四五六七八九十百千\\p{{Nd}}]+[章节条款]|^_*[一二三四五六七八九十]+[、.．]|^_*（[一二三四五六七八九十\\p{{Nd}}]+）|^_*[■□●○◆◇▶▷]_+",
    ),
    Profile(
        "ja", "Japanese", "Jpan", "LeftToRight", "Standard", "「」『』", r"[。！？]+|[.!?]+(?:_|\z)|(?:です|ます|でした|ました)(?:[。！？]|_|\z)",
        f"{_HEADING}|^_*第[一二三四五六七八九十百千\\p{{Nd}}]+[章節条項]|^_*[一二三四五六七八九十]+[、.．]|^_*（[一二三四五六七八九十\\p{{Nd}}]+）|^_*[■□●○◆◇▶▷]_+",
    ),
    Profile(
        "es", "Spanish", "Latn", "LeftToRight", "European", "«»“”", r"[.!?¡¿]+(?:_|\z)", f"{_HEADING}|{_NUMBERED}|{_LATIN_LETTER}|^_*(?:Capítulo|Sección|Parte)_+\\p{{Nd}}+", ".!?", _CLOSERS, ignore_case=True,
        abbreviations=("Dr", "Dra", "Sr", "Sra", "Srta", "Prof", "etc", "Ej", "pág", "págs", "núm", "tel", "Ud", "Uds", "Vd", "Vds"),
    ),
    Profile(
        "fr", "French", "Latn", "LeftToRight", "SpaceSeparated", "«»‹›", r"[.]+(?:_|\z)|_?[!?]+(?:_|\z)", f"{_HEADING}|{_NUMBERED}|{_LATIN_LETTER}|^_*(?:Chapitre|Section|Partie)_+\\p{{Nd}}+", ".!?", _CLOSERS + "«»", ignore_case=True,
        abbreviations=("Dr", "M", "Mme", "Mlle", "Prof", "etc", "ex", "p", "pp", "vol", "cf", "fig", "chap"),
    ),
    Profile(
        "de", "German", "Latn", "LeftToRight", "European", "„“‚‘", _LATIN_ENDS, f"{_HEADING}|{_NUMBERED}|{_LATIN_LETTER}|^_*(?:Kapitel|Abschnitt|Teil)_+\\p{{Nd}}+", ".!?", _CLOSERS + "„“", ignore_case=True,
        abbreviations=("Dr", "Hr", "Fr", "Prof", "z.B", "d.h", "u.a", "usw", "etc", "Nr", "Bd", "S", "Aufl"),
    ),
    Profile("ar", "Arabic", "Arab", "RightToLeft", "Standard", "«»‹›", r"[.。۔؟!！？]+(?:_|\z)", f"{_HEADING}|^_*\\p{{Nd}}+[.．\\)）]|^_*[■□●○◆◇]_+"),
    Profile("hi", "Hindi", "Deva", "LeftToRight", "Standard", "“”‘’", r"[।॥]+(?:_|\z)|[.!?]+(?:_|\z)", f"{_HEADING}|^_*\\p{{Nd}}+[.．\\)）]|^_*[क-ह][.．\\)）]|^_*[■□●○◆◇]_+"),
    Profile(
        "pt", "Portuguese", "Latn", "LeftToRight", "European", "«»“”", _LATIN_ENDS, f"{_HEADING}|{_NUMBERED}|{_LATIN_LETTER}|^_*(?:Capítulo|Seção|Parte)_+\\p{{Nd}}+", ".!?", _CLOSERS, ignore_case=True,
        abbreviations=("Dr", "Dra", "Sr", "Sra", "Srta", "Prof", "etc", "ex", "pág", "págs", "núm", "tel", "V.Ex", "V.S"),
    ),
    Profile(
        "ru", "Russian", "Cyrl", "LeftToRight", "SpaceSeparated", "«»„“", _LATIN_ENDS, f"{_HEADING}|{_NUMBERED}|^_*[А-Яа-я]\\._+[^\\n]+|^_*(?:Глава|Раздел|Часть)_+\\p{{Nd}}+", ".!?", _CLOSERS + "«»", ignore_case=True,
        abbreviations=("г", "гг", "др", "проф", "т.д", "т.е", "т.п", "и т.д", "и т.п", "и др", "см", "ср", "напр"),
    ),
]
#: Characters at the end of a text that say whether its last sentence is complete (fixed value).
TAIL = 50

RULES = "language string, language_name string, script string, direction string, numbers string, quotes string, ends string, sections string, abbreviations array<string>"


def rules(spark: SparkSession) -> DataFrame:
    """The profiles as a table of eleven rows; abbreviations are lower-cased. Korean stops come after its endings."""
    rows = []
    for p in PROFILES:
        pattern = p.pattern + (spaced(r"|[.!?。！？]+(?:_|\z)") if p.endings else "")
        rows.append((p.code, p.name, p.script, p.direction, p.numbers, p.quotes, pattern, p.section_pattern, [a.lower() for a in p.abbreviations]))
    return spark.createDataFrame(rows, RULES)


def found_language(text: Column, declared: Column) -> Column:
    """The language of the script, and for Latin script the declared one (its region left off, as in pt-BR); English where that has no profile."""
    known = lambda base: F.when(base.isin([p.code for p in PROFILES]), base).otherwise("en")
    by_declaration = bound(F.lower(F.regexp_extract(F.coalesce(declared, F.lit("")), "^[A-Za-z]+", 0)), known)
    return bound(script_profile(text), lambda by_script: F.when(by_script != "en", by_script).otherwise(by_declaration))


def with_rules(docs: DataFrame, declared: str = "lang") -> DataFrame:
    """docs with language and the columns of its rules: a join with eleven rows."""
    found = docs.withColumn("language", found_language(F.col("text"), F.col(declared)))
    return found.join(F.broadcast(rules(docs.sparkSession)), "language")


def pieces(text: Column, ends: str = "ends", abbreviations: str = "abbreviations") -> Column:
    """What stands between the sentence ends that count, each with its end; last the rest, often empty."""

    def piece(both: Column, last: Column) -> Column:
        gap, end = both["gap"], both["end"]
        begins = gap.rlike(f"[{S}]") | last.rlike(f"[{S}]\\z")
        token = F.lower(F.regexp_extract(gap, f"[^{S}]*\\z", 0))
        return F.concat(gap, end, F.when(begins & F.array_contains(F.col(abbreviations), token), "").otherwise(MARK))

    def marked(x: Column) -> Column:
        both = F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"], lambda g, e: F.struct(g.alias("gap"), e.alias("end")))
        before = F.slice(F.concat(F.array(F.lit(" ")), x["found"]), 1, F.size(x["found"]))
        return F.concat(F.array_join(F.zip_with(both, before, piece), ""), F.element_at(x["gaps"], -1))

    cut = F.struct(F.split(text, F.col(ends), -1).alias("gaps"), F.regexp_extract_all(text, F.col(ends), F.lit(0)).alias("found"))
    return F.split(bound(cut, marked), MARK, -1)


def sentences(text: Column, ends: str = "ends", abbreviations: str = "abbreviations") -> Column:
    """Pieces that add up to the text: cut after each sentence end whose token isn't an abbreviation.

    The token is what stands before the end, back to white space. It lies in the gap since the end
    before, unless that gap has no white space and the end before took none; then it holds signs that
    no abbreviation does.
    """
    return F.filter(pieces(text, ends, abbreviations), lambda s: s != "")


def boundaries(text: Column, ends: str = "ends", abbreviations: str = "abbreviations") -> Column:
    """Where sentences end, as offsets in ascending order; the text's own end counts only if a sentence ends there."""
    lengths = F.transform(pieces(text, ends, abbreviations), lambda p: F.length(p))
    return running_sums(bound(lengths, lambda x: F.slice(x, 1, F.size(x) - 1)))


def ends_complete(text: Column, ends: str = "ends") -> Column:
    """Whether a sentence ends within the text's last TAIL characters (white space at its end doesn't count)."""
    tail = F.right(F.regexp_replace(text, f"[{S}]+\\z", ""), F.lit(TAIL))
    return (tail != "") & F.regexp_like(tail, F.col(ends))


def section_lines(text: Column, sections: str = "sections") -> Column:
    """The lines that begin a section by the language's rules."""
    return F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.col(sections)) & (F.regexp_replace(line, f"[{S}]+", "") != ""))


# The same in DuckDB, whose expressions have no look-around: what stands around an end is taken along and put back.


def duckdb_marked(text: str, language: str) -> str:
    """text with a mark after each sentence end, abbreviations included."""
    cases = []
    for p in PROFILES:
        groups = [f"({p.ends})"]
        if p.endings:
            groups += [f"([가-힣](?:{p.endings})(?:_*\\z|_+))", r"([.!?。！？]+(?:_|\z))"]
        if p.stops:
            groups += [f"([{p.stops}]+)", f"([{p.closers}])"]
        before = len(groups) - bool(p.stops)
        pattern = spaced("|".join(groups[: before - bool(p.stops)] + (["".join(groups[-2:])] if p.stops else [])))
        kept = "".join(f"\\{k}" for k in range(1, before + 1))
        cases.append(f"WHEN '{p.code}' THEN regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{kept}{MARK}{chr(92)}{before + 1 if p.stops else 0}', 'g')".replace(f"{MARK}{chr(92)}0", MARK))
    return f"CASE {language} {' '.join(cases)} END"


def duckdb_gap(piece: str, language: str) -> str:
    """piece without the sentence end that closes it."""
    cases = []
    for p in PROFILES:
        parts = [p.ends] + ([f"(?:{p.endings})_*", r"[.!?。！？]+_?"] if p.endings else []) + ([f"[{p.stops}]+"] if p.stops else [])
        cases.append(f"WHEN '{p.code}' THEN regexp_replace({piece}, '(?:{spaced('|'.join(parts))})\\z', '')")
    return f"CASE {language} {' '.join(cases)} END"


def duckdb_abbreviations(language: str) -> str:
    return f"CASE {language} " + " ".join(f"WHEN '{p.code}' THEN {[a.lower() for a in p.abbreviations]}" for p in PROFILES if p.abbreviations) + " ELSE [''] END"


def duckdb_sentences(text: str, language: str, source: str, columns: str) -> str:
    """Common table expressions that end in `spoken`: columns, and pieces, the list of sentences with the rest last ('' if none)."""
    token = f"lower(regexp_extract(x.gap, '[^{S}]*\\z'))"
    begins = f"(regexp_matches(x.gap, '[{S}]') OR i = 1 OR regexp_matches(raw[i - 1], '[{S}]\\z'))"
    return f"""marked AS (SELECT {columns}, {language} AS sp_lang, string_split({duckdb_marked(text, language)}, chr(1)) AS raw FROM {source}),
 gapped AS (SELECT *, list_transform(raw, lambda r: {{'r': r, 'gap': {duckdb_gap('r', 'sp_lang')}}}) AS gapped_pieces, {duckdb_abbreviations('sp_lang')} AS abbr FROM marked),
 spoken AS (SELECT {columns}, string_split(array_to_string(list_transform(gapped_pieces, lambda x, i: x.r || CASE WHEN i = len(raw) OR ({begins} AND list_contains(abbr, {token})) THEN '' ELSE chr(1) END), ''), chr(1)) AS pieces FROM gapped)"""


def duckdb_complete(text: str, language: str) -> str:
    tail = f"regexp_extract(regexp_replace({text}, '[{S}]+\\z', ''), '(?s).{{0,{TAIL}}}\\z')"
    return f"({tail} <> '' AND contains({duckdb_marked(tail, language)}, chr(1)))"


def duckdb_section_lines(text: str, language: str) -> str:
    cases = " ".join(f"WHEN '{p.code}' THEN len(list_filter(string_split({text}, chr(10)), lambda l: regexp_matches(l, '{p.section_pattern.replace('(?iu)', '(?i)')}') AND regexp_replace(l, '[{S}]+', '', 'g') <> ''))" for p in PROFILES)
    return f"CASE {language} {cases} END"
