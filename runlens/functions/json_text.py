"""JSON texts as columns: their string leaves changed in place, Python's truth of a value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BACKSLASH, _QUOTE = "\x01", "\x02"  # stand in for the two escapes while texts are cut at quotes; valid JSON holds neither


def map_leaves(record: Column, change: Callable[[Column], Column]) -> Column:
    """A JSON text of any depth with `change` applied to each string value; keys, numbers and the shape stay as they are.

    Escaped backslashes and quotes are set aside, so that a cut at the quotes leaves the insides of strings at the odd
    places. One that a colon follows is a key. No pattern runs over whole strings: depth and length are no limit.
    """
    parts = F.split(F.replace(F.replace(record, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE)), '"', -1)
    shown = lambda t: F.replace(F.replace(t, F.lit(_BACKSLASH), F.lit("\\\\")), F.lit(_QUOTE), F.lit('\\"'))
    plain = lambda t: ~t.contains("\\") & ~t.contains(_BACKSLASH) & ~t.contains(_QUOTE)

    def written(t: Column) -> Column:
        quoted = F.to_json(F.array(t))
        return F.substr(quoted, F.lit(3), F.length(quoted) - 4)

    def leaf(t: Column) -> Column:
        text = F.when(plain(t), t).otherwise(F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), shown(t), F.lit('"'))), "$", "string"))
        return F.coalesce(written(change(text)), t)

    pairs = F.zip_with(parts, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda own, after: F.struct(own.alias("own"), after.alias("after")))
    done = F.transform(pairs, lambda x, i: F.when((i % 2 == 1) & ~x["after"].rlike(r"^\s*:"), leaf(x["own"])).otherwise(x["own"]))
    return shown(F.array_join(done, '"'))


def truthy(value: Column) -> Column:
    """Whether Python takes a variant for true: absent, null, zero and empty ones are false."""
    kind = F.schema_of_variant(value)
    got = lambda t: F.try_variant_get(value, "$", t)
    return F.coalesce(
        F.when(kind == "BOOLEAN", got("boolean")).when(kind == "STRING", got("string") != "").when(kind.startswith("ARRAY"), F.size(got("array<variant>")) > 0)
        .when(kind.startswith("OBJECT"), F.size(got("map<string,variant>")) > 0).when(kind == "VOID", False).otherwise(got("double") != 0),
        F.lit(False),
    )


def once(value: Column, build: Callable[[Column], Column]) -> Column:
    """`build(value)` with the value computed one time, however often `build` reads it: it becomes a lambda's variable."""
    return F.element_at(F.transform(F.array(value), build), 1)
