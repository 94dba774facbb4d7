"""Text expressions: tokens, stop words, lengths."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F


def accent_table() -> tuple[str, str]:
    """Accented lower-case Latin letters and the plain letter each one decomposes to."""
    marked, plain = [], []
    for code in range(0xC0, 0x250):
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if letter.islower() and base != letter and base.isascii():
            marked.append(letter)
            plain.append(base)
    return "".join(marked), "".join(plain)


# English stop words of the usual public list, then five corpus-specific ones.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don
don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
from subject re edu use
""".split()

MIN_TOKEN, MAX_TOKEN = 2, 15


def tokens(text: Column) -> Column:
    """Lower-cased, accent-free letter runs of 2 to 15 characters, in order."""
    marked, bare = accent_table()
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Mn}_]+"), F.lit(0))

    def plain(t: Column) -> Column:
        # most tokens are ASCII, which a length comparison tells
        stripped = F.regexp_replace(F.translate(t, marked, bare), r"\p{Mn}+", "")
        return F.when(F.octet_length(t) == F.length(t), t).otherwise(stripped)

    return F.filter(F.transform(words, plain), lambda t: F.length(t).between(MIN_TOKEN, MAX_TOKEN))


def without(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda t: ~t.isin(stop))


def longer_than(words: Column, length: int) -> Column:
    return F.filter(words, lambda t: F.length(t) > length)
