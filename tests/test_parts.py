"""Literal parts that decide what is searched by a pattern: every match must hold one of them."""

import re

from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.operators import quality

#: Texts that the patterns of quality.PARTS match, each alternative at least once.
MATCHING = {
    V.EXCHANGE: ["tausch", "Tauschwohnung", "zum  Tausch", "[tauschwohnung]", "Wohnungen tauschen", "swap apartment"],
    V.COLIVING: ["coliving", "Co-Living"],
    V.WG_ROOM: ["WG-Zimmer", "wg zimmer", "Zimmer in einer WG", "zimmer in wg", "camera in appartamento condiviso", "room in shared flat", "chambre en colocation"],
    V.TEMPORARY_LISTING: ["befristet", "temporär", "temporäre", "temporaire", "temporaneo", "fixed-term", "kurzfristig", "bis 01.02.2026"],
    V.SWAP: ["tauschwohnung", "tausch gegen", "zum tausch", "wohnungstausch", "apartment swap", "échange d'a", "echange contre", "appartement échange", "scambio di appartament"],
    V.WANTED: ["suche wohnung", "suche 3.5-zimmer", "ich suche", "wir suchen", "cherche studio", "cherche 3 pièces", "a la recherche d'un appartement", "reprise de bail", "cerco monolocale", "wanted: x", "looking for an apartment"],
    V.SHORT_TERM: ["befristet", "temporäre", "temporary", "temporarily", "temporairement", "temporanea", "zwischenmiete", "untervermietung", "sous-location", "sublet", "abriss", "demolition", "bis zum 1.2.26", "bis Ende 2026", "jusqu'au mai 2026", "fino al 3"],
}


def test_parts_cover_their_patterns(spark):
    """With parts and without them, in small and capital letters, the same texts are found."""
    assert set(MATCHING) == set(quality.PARTS)
    rows = [(p, case(t)) for p, ts in MATCHING.items() for t in ts for case in (str, str.upper, str.title)] + [(p, "a quiet flat by the lake") for p in MATCHING]
    df = spark.createDataFrame(rows, "p string, t string")
    for pattern in MATCHING:
        own = df.where(F.col("p") == F.lit(pattern))
        bare = F.coalesce(F.col("t").rlike("(?iuU)" + pattern), F.lit(False))
        found = own.select("t", bare.alias("bare"), quality.in_text(F.col("t"), pattern).alias("parts")).collect()
        assert [r for r in found if r.bare != r["parts"]] == []
        plain = {r.t for r in found if r.bare}
        assert plain >= {t for t in MATCHING[pattern] if re.search(pattern, t, re.I)} and len(plain) >= len(MATCHING[pattern])
