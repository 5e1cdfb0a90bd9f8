"""Tokenizers and set similarities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the sparse search leaves out of a question.
SEARCH_STOP = (
    "the is are was were who what when where which why how does did do in on at of to for a an and or with has have had this that its it"
).split()
# Words that carry no topic when two facts are compared.
TOPIC_STOP = (
    "the is are was were has have had a an and or of to in on at for it its that this with from as by not be been being "
    "run runs running port ports production staging service services all every now still currently "
    "switched start started cost costs uses use used my our we i"
).split()
# Words that the keyword-overlap baseline ignores.
OVERLAP_STOP = "the is are was were a an and or of to in on at for do i my we it what who am still currently now right does how".split()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_fold(c: str | Column) -> Column:
    """Lower case of A to Z only, as names are compared."""
    return F.translate(_col(c), UPPER, LOWER)


def normalise(c: str | Column) -> Column:
    """Lower case, Unicode white space collapsed and stripped."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"(?U)\s+", " "))


def _ascii_runs(c: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def _without(tokens: Column, stop: list[str], shortest: int) -> Column:
    return F.filter(tokens, lambda t: (F.length(t) >= shortest) & ~t.isin(stop))


def search_tokens(c: str | Column) -> Column:
    """Tokens of a question, repetitions kept: they weigh more."""
    return _without(F.transform(F.regexp_extract_all(_col(c), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower), SEARCH_STOP, 3)


def content_tokens(c: str | Column) -> Column:
    """The set of topic tokens of a fact."""
    return F.array_distinct(_without(_ascii_runs(c), TOPIC_STOP, 2))


def overlap_tokens(c: str | Column) -> Column:
    return F.array_distinct(_without(_ascii_runs(c), OVERLAP_STOP, 3))


def fold_accents(c: str | Column) -> Column:
    """Lower case without combining marks. Only texts beyond ASCII go to Python, for its tables of marks; the others stay in the JVM."""

    @F.pandas_udf("string")
    def fold(s):
        import re
        import unicodedata

        parted = s.map(lambda t: None if t is None else unicodedata.normalize("NFD", t.lower()))
        marks = [c for c in set().union(*parted.dropna()) if unicodedata.combining(c)]
        if not marks:
            return parted
        marked = re.compile(f"[{''.join(marks)}]+")
        return parted.map(lambda t: None if t is None else marked.sub("", t))

    text = _col(c)
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(fold(F.when(~plain, text)))


def document_tokens(c: str | Column, folded: bool = False) -> Column:
    """Tokens of a document: runs of letters and digits of any script, lower case, without accents."""
    return F.regexp_extract_all(_col(c) if folded else fold_accents(c), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two sets; 0 where both are empty."""
    union = F.size(F.array_union(_col(a), _col(b)))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(_col(a), _col(b))) / union)


def char_ngrams(c: str | Column, n: int) -> Column:
    """All character n-grams of a text, in order."""
    text = _col(c)
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
