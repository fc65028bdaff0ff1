"""Unified diffs as tables: lines, sections, the files they create and touch, the text they add."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.text import lines, strip

#: The lines that mark a section as binary.
BINARY = r"(?dm)^Binary files .* differ$|^GIT binary patch$"


def line_table(patches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, line, prev) of the `diff` column."""
    flat = patches.select(*keys, F.posexplode(lines(F.coalesce("diff", F.lit("")))).alias("pos", "line"))
    return flat.withColumn("prev", F.lag("line").over(Window.partitionBy(*keys).orderBy("pos")))


def paths(patches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, created): files touched, and whether the diff creates them (its line before names /dev/null)."""
    t = line_table(patches, keys)
    side = F.when(F.col("line").startswith("+++ b/") | F.col("line").startswith("--- a/"), strip(F.substr("line", F.lit(7))))  # a name with a blank has a tab after it
    made = F.col("line").startswith("+++ b/") & F.coalesce(F.col("prev").startswith("--- /dev/null"), F.lit(False))
    return t.select(*keys, side.alias("path"), made.alias("created")).where("path <> ''").groupBy(*keys, "path").agg(F.bool_or("created").alias("created"))


def added_text(diff: Column) -> Column:
    """Lines the diff adds, without the sign."""
    plus = F.filter(lines(diff), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.array_join(F.transform(plus, lambda x: F.substr(x, F.lit(2))), "\n")


def sections(diff: Column) -> Column:
    """The diff cut before each line that opens a file's section; what stands before the first is a section too."""
    return F.split(diff, r"(?dm)^(?=diff --git )", -1)


def without_binary(diff: Column) -> Column:
    kept = F.filter(sections(diff), lambda s: (strip(s) != "") & ~s.rlike(BINARY))
    return F.array_join(kept, "")


def is_empty(diff: Column) -> Column:
    """Blank, or without any file section."""
    return (strip(diff) == "") | ~diff.rlike(r"(?dm)^diff --git ")


def gold_files(diff: Column) -> Column:
    """First paths of the section headers, in order; a path ends at white space."""
    return F.regexp_extract_all(diff, F.lit(r"diff --git a/(\S+) b/"), 1)


def new_files(patches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path): files whose own section says they are new."""
    s = patches.select(*keys, F.explode(sections(F.col("diff"))).alias("s"))
    return s.where(F.col("s").contains("new file mode")).select(*keys, F.regexp_extract("s", r"^diff --git a/(\S+) b/", 1).alias("path")).where("path <> ''")


def test_leaf(name: Column) -> Column:
    """The last part of a test's name, without parameters."""
    leaf = F.regexp_replace(F.substring_index(name, "::", -1), r"(?s)\[.*\]$", "")
    return strip(F.substring_index(leaf, ".", -1))


def distinctive(leaf: Column) -> Column:
    """Long enough to mean something when it turns up in a patch."""
    return (F.length(leaf) >= 8) & (F.lower(leaf).startswith("test") | (F.length(leaf) >= 20))


@F.pandas_udf(T.ArrayType(T.StringType()))
def found_in(text: pd.Series, words: pd.Series) -> pd.Series:
    """Which of a row's words its text holds, sorted: one pass over the text with an automaton of the words, however many they are."""
    import ahocorasick

    def one(t: str | None, ws) -> list[str]:
        automaton = ahocorasick.Automaton()
        for w in () if ws is None or not t else ws:
            if w:
                automaton.add_word(w, w)
        if not len(automaton):
            return []
        automaton.make_automaton()
        return sorted({w for _, w in automaton.iter(t)})

    return pd.Series([one(t, ws) for t, ws in zip(text, words, strict=True)], dtype=object)
