"""Which entries of a dictionary a text contains: one pass over each text, however many entries there are.

The entries become an Aho-Corasick automaton, which is built once, broadcast, and
loaded once by every worker; a text goes through it letter by letter and meets every entry it
contains, nested and overlapping ones too. Without it every text would be searched
for every entry.

A dictionary is collected. One of over ``PART_CHARS`` characters is cut into parts,
each an automaton of its own that every text goes through, so a broadcast stays bounded and
nothing is left out.

Defined results: a null or empty text contains nothing; empty and null entries are in no
text; of equal entries each is found; letters are compared as they are.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of the entries that one automaton holds.
PART_CHARS = 8_000_000
FOUND = "array<struct<entry:long,at:int>>"


def _parts(entries: list[tuple[str, object]], part_chars: int) -> list[ahocorasick.Automaton]:
    """Automata over the entries, each key with the list of its values."""
    made: list[ahocorasick.Automaton] = []
    held: dict[str, list] = {}
    size = 0

    def close() -> None:
        if held:
            automaton = ahocorasick.Automaton()
            for key, values in held.items():
                automaton.add_word(key, (len(key), values))
            automaton.make_automaton()
            made.append(automaton)

    for key, value in sorted(((k, v) for k, v in entries if k), key=lambda e: e[0]):
        if key not in held and size + len(key) > part_chars:
            close()
            held, size = {}, 0
        size += 0 if key in held else len(key)
        held.setdefault(key, []).append(value)
    close()
    return made


def contained(spark: SparkSession, text: Column, entries: DataFrame, part_chars: int = PART_CHARS) -> Column:
    """Entries that a text contains: array of (entry, at), ``at`` the place of the first letter of its first occurrence, from 0, by entry.

    entries (entry long, key string).
    """
    listed = [(r["key"], r["entry"]) for r in entries.select("entry", "key").collect()]

    def finder(automaton) -> Column:
        shared = spark.sparkContext.broadcast(automaton)

        @F.pandas_udf(FOUND)
        def find(texts: pd.Series) -> pd.Series:
            machine, out = shared.value, []
            for t in texts:
                first: dict[int, int] = {}
                for end, (size, values) in machine.iter(t) if t else ():
                    for value in values:
                        first.setdefault(value, end - size + 1)
                out.append([{"entry": e, "at": at} for e, at in sorted(first.items())])
            return pd.Series(out, dtype=object)

        return find(text)

    parts = _parts(listed, part_chars)
    none = F.array().cast(FOUND)
    return F.array_sort(F.concat(none, *map(finder, parts))) if len(parts) > 1 else finder(parts[0]) if parts else F.when(text.isNull(), none).otherwise(none)


def contained_pairs(rows: DataFrame, text: Column, entries: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``rows`` once for each entry that their text contains, with ``entry`` and ``at``; rows without one are left out."""
    found = rows.withColumn("__found", contained(rows.sparkSession, text, entries, part_chars)).withColumn("__one", F.explode("__found"))
    return found.select(*rows.columns, "__one.entry", "__one.at")


def best_name(spark: SparkSession, text: Column, names: list[tuple[str, str, int]], least: int, part_chars: int = PART_CHARS) -> Column:
    """Name of the entry that the text is, else of the longest one of ``least`` letters that it contains.

    names (key, name, ord): of equally long ones the smaller ``ord`` counts, then the later key and name.
    """
    shared = [spark.sparkContext.broadcast(a) for a in _parts([(key, (-order, key, name)) for key, name, order in names], part_chars)]

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        machines, out = [s.value for s in shared], []
        for t in texts:
            exact = [v for m in machines if t and (hit := m.get(t, None)) for v in hit[1]]
            best = max(exact, default=None)
            if best is None:
                inner = max(((size, v) for m in machines for _, (size, values) in (m.iter(t) if t else ()) if size >= least for v in values), default=None)
                best = inner and inner[1]
            out.append(best and best[2])
        return pd.Series(out, dtype=object)

    return find(text)
