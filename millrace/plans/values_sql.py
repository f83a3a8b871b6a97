"""Expressions in SQL that the catalogue's oracles share."""

from millrace.functions import values as V


_WORD = "[\\p{L}\\p{N}_]+"


def tokens_sql(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in V.STOPWORDS)
    return f"list_filter(regexp_extract_all(lower({c}), '{_WORD}'), lambda t: length(t) > 1 AND t NOT IN ({stop}))"


def detect_sql(c: str) -> str:
    points = []
    for k, words in V.LANGUAGE_WORDS.items():
        hits = f"3 * len(list_intersect(list_distinct(regexp_extract_all(lower({c}), '{_WORD}')), [{', '.join(repr(w) for w in words)}]))"
        chars = f" + length(lower({c})) - length(translate(lower({c}), '{V.LANGUAGE_CHARS[k]}', ''))" if V.LANGUAGE_CHARS[k] else ""
        points.append(f"({hits}{chars})::BIGINT")
    de, fr, it, en = points
    return f"(SELECT CASE WHEN greatest(de, fr, it, en) = 0 OR de = greatest(de, fr, it, en) THEN 'de' WHEN fr = greatest(fr, it, en) THEN 'fr' WHEN it = greatest(it, en) THEN 'it' ELSE 'en' END FROM (SELECT {de} AS de, {fr} AS fr, {it} AS it, {en} AS en))"
