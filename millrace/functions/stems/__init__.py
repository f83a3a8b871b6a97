"""Stems by language, as a vectorised function over token arrays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from millrace.functions.stems import english, french, german, italian

STEMMERS = {"de": german.stem, "fr": french.stem, "it": italian.stem, "en": english.stem}

#: Words that a task remembers; beyond, it starts anew, so memory is bounded.
REMEMBERED = 500_000


def by_language(tokens: Column, language: Column) -> Column:
    """A token array with each token stemmed in the row's language: de, fr, it or en; German for any other and for null."""
    @pandas_udf("array<string>")
    def stemmed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[tuple[str, str], str] = {}

        def of(words, lang):
            lang = lang if lang in STEMMERS else "de"
            out = []
            for w in words:
                s = known.get((lang, w))
                if s is None:
                    s = known[lang, w] = STEMMERS[lang](w)
                out.append(s)
            return out

        for arrays, languages in batches:
            if len(known) > REMEMBERED:
                known.clear()
            yield pd.Series([None if a is None else of(a, x) for a, x in zip(arrays, languages, strict=True)], index=arrays.index, dtype=object)

    return stemmed(tokens, language)
