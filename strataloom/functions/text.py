"""Text functions: query terms, names, framing, guards. Columns where Spark has the functions, plain Python where it has not."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Terms too common to narrow a lexical query.
STOP_TERMS = frozenset(
    """about above after again against also among because before being between both but cannot could does doing during each
    from further had has have having here hers herself him himself his how into its itself more most nor not off once only
    other our ours ourselves out over own same she should some such than that the their theirs them themselves then there
    these they this those through too under until very was were what when where which while who whom why will with would
    you your yours yourself yourselves""".split()
)

_NOT_ALNUM = re.compile(r"[\W_]+")
#: White space as Unicode has it; str.split() would also cut at U+001C to U+001F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def fold_map() -> tuple[str, str]:
    """Latin letters with a diacritic, and the letters without: two strings for translate(), built from Unicode's decompositions."""
    marked = [c for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii() and d[0].isalpha()]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


def fold(col: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(col), *fold_map())


def tokens(col: Column) -> Column:
    """Folded runs of letters and digits, in order, repeats included; none for null."""
    return F.filter(F.split(fold(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


#: Letters and numbers as the JVM's regular expressions know them; Python's own classes are of another version of Unicode.
_GAP = r"[^\p{L}\p{N}]+"
#: Characters outside the ranges where these versions agree.
_ODD = re.compile("[^\x00-\u04ff\u2000-\u206f\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")


_wide: list[str] = []


def splitter(spark: SparkSession) -> Callable[[str], list[str]]:
    """The runs of letters and digits of a text, in order, for Python workers: as split() has them by the JVM's classes."""
    if not _wide:
        gap, ranges = spark.sparkContext._jvm.java.util.regex.Pattern.compile(_GAP), []
        for at in range(0, 0x110000, 4096):  # a few at a time: the driver's memory is small
            odd = "".join(c for i in range(at, at + 4096) if not 0xD800 <= i < 0xE000 and _ODD.match(c := chr(i)))
            for i in map(ord, gap.matcher(odd).replaceAll("") if odd else ""):
                if ranges and ranges[-1][1] == i - 1:
                    ranges[-1][1] = i
                else:
                    ranges.append([i, i])
        _wide.append("".join(f"{chr(a)}-{chr(b)}" for a, b in ranges))
    return _Splitter(_wide[0])


class _Splitter:
    """Sent to workers as ranges of letters; patterns are compiled where they are used."""

    def __init__(self, wide: str):
        self.wide, self.word, self.any = wide, None, None

    def __call__(self, text: str) -> list[str]:
        if self.word is None:
            within = "".join(c for i in range(0xD7A4) if not _ODD.match(c := chr(i)) and c.isalnum())
            self.word, self.any = re.compile(r"[^\W_]+").findall, re.compile(f"[{within}{self.wide}]+").findall
        return self.any(text) if _ODD.search(text) else self.word(text)


def query_terms(query: str, least: int = 3) -> tuple[list[str], bool]:
    """The terms of a lexical query and whether all must occur.

    Strict terms (of `least` characters or more, not in the stop list) are all required if there are any;
    otherwise any one term will do. The choice is made here, never after seeing a result.
    """
    seen = list(dict.fromkeys(t for t in (x.lower() for x in _NOT_ALNUM.split(query)) if t))
    strict = [t for t in seen if len(t) >= least and t not in STOP_TERMS]
    marked, plain = fold_map()
    folded = [t.translate(str.maketrans(marked, plain)) for t in strict or seen]
    return list(dict.fromkeys(folded)), bool(strict)


def normal_name(raw: str) -> str:
    """White space collapsed, NFC, lower case, NFC: the identity of an entity, type or predicate."""
    text = unicodedata.normalize("NFC", " ".join(x for x in _SPACE.split(raw) if x))
    return unicodedata.normalize("NFC", text.lower())


@F.pandas_udf(T.StringType())
def _normal_name(names: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return names.map(lambda n: None if n is None else known[n] if n in known else known.setdefault(n, normal_name(n)))


def normal_name_col(col: Column) -> Column:
    """normal_name() of a column. ASCII names, most of all names, stay in the JVM."""
    plain = F.btrim(F.lower(F.regexp_replace(col, r"[\t-\r ]+", " ")))
    return F.when(col.rlike(r"^[\x00-\x7f]*$"), plain).otherwise(_normal_name(col))


def ngrams(query: str, most: int = 6) -> list[str]:
    """Normalised n-grams of 1 to `most` tokens of the query, each once, by start and length."""
    words = [x for x in _SPACE.split(query) if x]
    return list(dict.fromkeys(
        name for i in range(len(words)) for j in range(i + 1, min(i + most, len(words)) + 1) if (name := normal_name(" ".join(words[i:j])))))


def acronym(name: Column, least: int = 2) -> Column:
    """First letters of a stored name of `least` tokens or more, else null."""
    parts = F.split(name, " ")
    return F.when(F.size(parts) >= least, F.array_join(F.transform(parts, lambda t: F.substring(t, 1, 1)), ""))


def prefix_match(gram: Column, name: Column, least: int = 3) -> Column:
    """Each token of the n-gram, of `least` characters or more, begins the token at its place; not all equal."""
    q, s = F.split(gram, " "), F.split(name, " ")
    lined = F.arrays_zip(q.alias("q"), F.slice(s, 1, F.size(q)).alias("s"))
    fits = F.forall(lined, lambda x: (F.length(x["q"]) >= least) & F.startswith(x["s"], x["q"]))
    return (F.size(q) <= F.size(s)) & fits & (gram != name)


def model_input(path: Column, text: Column) -> Column:
    """The path joined by ' / ', a blank line, then the text; the text alone without a path."""
    return F.when(F.size(path) > 0, F.concat(F.array_join(path, " / "), F.lit("\n\n"), text)).otherwise(text)


def evidence_text(kind: Column, text: Column, code: Column) -> Column:
    """What a unit shows as evidence: text of blocks, captions and cells, code of code blocks, nothing of others."""
    return F.when(kind.isin("text_block", "caption", "table_cell"), text).when(kind == "code_block", code)


def evidence_member(kind: Column, role: Column, text: Column, row_id: Column) -> Column:
    """Whether a unit is packed: not a heading, not blank, and a cell only within a row."""
    shown = F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))) > 0
    return shown & ~((kind == "text_block") & F.coalesce(role == "heading", F.lit(False))) & ((kind != "table_cell") | row_id.isNotNull())


def guarded(col: Column, most: int) -> Column:
    """The value if it has `most` bytes or fewer; an error, not a cut, beyond that."""
    return F.when(F.octet_length(col) > most, F.raise_error(F.lit(f"resource limit: over {most} bytes"))).otherwise(col)


def mime(uri: Column) -> Column:
    return F.when(F.lower(uri).endswith(".txt"), "text/plain").when(F.lower(uri).endswith(".epub"), "application/epub+zip").otherwise("application/octet-stream")


def char_slice(text: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of the text."""
    return F.substring(text, start + 1, end - start)


def source_key(system: Column, uri: Column) -> Column:
    return F.concat_ws(":", system, uri)


def short(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def unfence(raw: str) -> str:
    """One Markdown fence around the whole text is taken off, with its language; anything else is only trimmed."""
    text = raw.strip()
    if text.startswith("```"):
        head, newline, rest = text.partition("\n")
        body, close, _ = rest.rpartition("```")
        if newline and close:
            return body.strip()
    return text
