"""Overrides of workflow entries from command lines: `--<entry>.<field path>=<value>`, typed by the entries' schema.

Entries are rows with a `key`, fields of their own and a struct `task`; a path that begins with no field of the entry is
looked for in its task. Every argument is judged with the reason it is refused, before any is applied; those that stand
are applied shortest path first, so that an object is replaced before a field is set in it. What fields there are, and
their types, comes from the schema: the plan is a join and one rebuilt struct, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.text import integer, strip

#: Fields that may not be set, and words for true and false.
FIXED = {"key": "an entry's key is its identity", "task": "a task is not a value an argument can spell"}
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")
_NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"
_SPECIAL = r"(?i)^[+-]?(nan|inf|infinity)$"
_TEXTS, _PAIRS = T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())


@dataclass(frozen=True)
class Declared:
    """What may be set: the entries' schema, the values of closed fields, and by path the objects that a bare name stands for."""

    schema: T.StructType
    choices: dict[str, tuple[str, ...]] = field(default_factory=dict)
    objects: dict[str, dict[str, Column]] = field(default_factory=dict)

    def kinds(self) -> dict[str, tuple[str, bool]]:
        """By dotted path: the kind of its value, and whether `none` is one."""
        out: dict[str, tuple[str, bool]] = {}

        def walk(struct: T.StructType, prefix: str) -> None:
            for f in struct.fields:
                path, t = prefix + f.name, f.dataType
                kind = (
                    "struct" if isinstance(t, T.StructType) else "bool" if isinstance(t, T.BooleanType) else "int" if isinstance(t, T.IntegralType)
                    else "float" if isinstance(t, T.FractionalType) else "string" if isinstance(t, T.StringType) else "list" if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType)
                    else "map" if isinstance(t, T.MapType) and isinstance(t.keyType, T.StringType) and isinstance(t.valueType, T.StringType) else "other"
                )
                out[path] = (kind, f.nullable)
                if isinstance(t, T.StructType):
                    walk(t, path + ".")

        walk(self.schema, "")
        return out


def parsed(args: DataFrame, keys: list[str]) -> DataFrame:
    """args (keys, pos, arg): adds entry, path, value and problem (null: none yet). Only the first `=` cuts; a repeated path is refused from its second on."""
    arg = F.col("arg")
    target = F.substr(F.substring_index(arg, "=", 1), F.lit(3))
    dotted = F.when(target.contains("."), F.substr(target, F.instr(target, ".") + 1)).otherwise("")
    out = args.withColumns({"entry": F.substring_index(target, ".", 1), "path": F.split(dotted, r"\.", -1), "value": F.when(arg.contains("="), F.substr(arg, F.instr(arg, "=") + 1))})
    shape = (
        F.when(arg.isNull() | ~arg.startswith("--") | ~arg.contains("="), "unrecognized argument").when((F.col("entry") == "") | (dotted == ""), "an override names an entry and a field path")
        .when(F.exists("path", lambda p: p == ""), "empty path segment")
    )
    out = out.withColumn("problem", shape)
    turn = F.row_number().over(Window.partitionBy(*keys, "entry", "path", F.col("problem").isNull()).orderBy("pos"))
    return out.withColumn("_turn", turn).withColumn("problem", F.when(F.col("problem").isNull() & (F.col("_turn") > 1), "overrides the same field").otherwise(F.col("problem"))).drop("_turn")


def _parts(value: Column) -> Column:
    return F.filter(F.split(value, ",", -1), lambda p: p != "")


def _is_pair(p: Column) -> Column:
    return p.contains("=") & ~p.startswith("=")


def _float(value: Column) -> Column:
    plain = strip(value)
    return F.when(plain.rlike(_NUMBER), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))


def _lookup(table: dict[str, Column], path: Column) -> Column:
    flat = [x for k, v in table.items() for x in (F.lit(k), v)]
    return F.try_element_at(F.create_map(*flat), path) if flat else F.lit(None)


def judged(args: DataFrame, entries: DataFrame, declared: Declared, keys: list[str]) -> DataFrame:
    """`parsed`, with `field` (the dotted path from the entry) and the first reason against each argument."""
    kinds = declared.kinds()
    top = [f.name for f in declared.schema.fields]
    task = [f.name for f in declared.schema["task"].dataType.fields] if "task" in top else []
    p = parsed(args, keys).join(entries.select(*keys, F.col("key").alias("entry"), F.lit(True).alias("_there")).distinct(), [*keys, "entry"], "left")
    dotted, head = F.array_join("path", "."), F.col("path")[0]
    named = F.when(head.isin(*top), dotted).when(head.isin(*task) if task else F.lit(False), F.concat(F.lit("task."), dotted))
    p = p.withColumn("field", F.when(F.col("problem").isNull(), named))
    kind = _lookup({k: F.lit(v[0]) for k, v in kinds.items()}, F.col("field"))
    optional = F.coalesce(_lookup({k: F.lit(v[1]) for k, v in kinds.items()}, F.col("field")), F.lit(False))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("field", r"\.")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("field", r"\."), 1, n), "."))
    walks = F.exists(prefixes, lambda q: F.coalesce(_lookup({k: F.lit(v[0]) for k, v in kinds.items()}, q) != "struct", F.lit(False)) & (q != F.col("field")))
    closed = {k: F.array(*map(F.lit, v)) for k, v in (declared.choices | {k: tuple(v) for k, v in declared.objects.items()}).items()}
    values = _lookup(closed, F.col("field")) if closed else F.lit(None).cast("array<string>")
    p = p.withColumns({"_kind": kind, "_optional": optional, "_values": values.cast("array<string>"), "_walks": walks})
    value, is_ = F.col("value"), lambda k: F.col("_kind") == k
    wrong = (
        F.when(F.lower(value) == "none", F.when(F.col("_optional"), None).when(is_("string"), None).otherwise("none is no value of it"))
        .when(F.col("_values").isNotNull(), F.when(~F.array_contains("_values", value), F.concat(F.lit("expected one of "), F.array_join("_values", ", "))))
        .when(is_("bool") & ~F.lower(value).isin(*TRUE, *FALSE), "expected true or false").when(is_("int") & integer(value).isNull(), F.concat(value, F.lit(" is not int")))
        .when(is_("float") & strip(value).rlike(_SPECIAL), F.concat(value, F.lit(" is not a finite number"))).when(is_("float") & _float(value).isNull(), F.concat(value, F.lit(" is not float")))
        .when(is_("float") & (F.abs(_float(value)) == float("inf")), F.concat(value, F.lit(" is not a finite number")))
        .when(is_("map") & F.exists(_parts(value), lambda x: ~_is_pair(x)), F.concat(F.try_element_at(F.filter(_parts(value), lambda x: ~_is_pair(x)), F.lit(1)), F.lit(" is not k=v")))
        .when(F.col("_kind").isin("struct", "other"), "not a type this can build from text")
    )
    fixed = _lookup({k: F.lit(v) for k, v in FIXED.items()}, dotted)
    problem = F.coalesce(
        F.col("problem"), F.when(F.col("_there").isNull(), F.concat(F.lit("no entry "), F.col("entry"))), fixed, F.when(F.col("field").isNull(), F.concat(head, F.lit(" is not a field"))),
        F.when(F.col("_walks"), "no fields to walk into"), F.when(F.col("_kind").isNull(), F.concat(dotted, F.lit(" is not a field"))), wrong,
    )
    return p.withColumn("problem", problem).drop("_there", "_kind", "_optional", "_values", "_walks")


def _built(value: Column, kind: str, to: T.DataType) -> Column:
    """The value of a text that was judged fit."""
    if kind == "bool":
        return F.lower(value).isin(*TRUE)
    if kind == "int":
        return integer(value).cast(to)
    if kind == "float":
        return _float(value).cast(to)
    if kind == "list":
        return _parts(value)
    if kind == "map":
        pairs = F.transform(F.filter(_parts(value), _is_pair), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substr(x, F.instr(x, "=") + 1).alias("v")))
        return F.aggregate(pairs, F.create_map().cast(_PAIRS), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))
    return value


def applied(entries: DataFrame, judgements: DataFrame, declared: Declared, keys: list[str]) -> DataFrame:
    """The entries with every override applied; with a refused one among `judgements` it is an error when the rows are read, and nothing is applied."""
    kinds = declared.kinds()
    checked = judgements.where(F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.coalesce("arg", F.lit("null")), F.lit(": "), F.col("problem"))).cast("boolean")).otherwise(True))
    last = checked.groupBy(*keys, F.col("entry").alias("key"), "field").agg(F.max_by("value", F.struct(F.size("path"), "pos")).alias("value"))  # of two spellings the longer
    each = last.groupBy(*keys, "key").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_set"))
    out = entries.join(each, [*keys, "key"], "left").withColumn("_set", F.coalesce("_set", F.create_map().cast(_PAIRS)))

    def rebuilt(old: Column, path: str, t: T.DataType) -> Column:
        kind, optional = kinds[path]
        text = F.try_element_at(F.col("_set"), F.lit(path))
        if kind == "struct":
            new = old
            for name, value in declared.objects.get(path, {}).items():
                new = F.when(text == name, value.cast(t)).otherwise(new)
            inner = F.struct(*(rebuilt(new[f.name], f"{path}.{f.name}", f.dataType).alias(f.name) for f in t.fields))
            return F.when(new.isNotNull(), inner)
        if kind == "other":
            return old
        value = _built(text, kind, t)
        return F.when(text.isNull(), old).otherwise(F.when(F.lower(text) != "none", value) if optional and kind != "string" else F.when(F.lower(text) == "none", None).otherwise(value) if optional else value)

    return out.select(*keys, *(F.col(f.name) if f.name == "key" else rebuilt(F.col(f.name), f.name, f.dataType).alias(f.name) for f in declared.schema.fields))
