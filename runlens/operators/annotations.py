"""Code-range annotations: parsing, validity, recall against known-good patches, cost and stalls."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.json_text import once
from runlens.functions.text import integer

#: The keys a snippet must have.
REQUIRED = ("file_path", "start_line", "end_line", "category")
STALL_SECONDS = 120.0
#: What is wrong with an output file.
NO_FILE, NO_JSON, NO_SHAPE = "output file does not exist", "not valid JSON", "must be a JSON object or list"
NO_LIST, NO_OBJECT = "'snippets' must be a list", "snippet must be an object"
#: Fixed values, down to I18N_EXTENSIONS: files that an annotation may leave out.
DOC_EXTENSIONS = (".md", ".mdx", ".rst", ".txt", ".asciidoc", ".adoc", ".po", ".pot", ".svg", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".webp")
MANIFESTS = (
    "go.mod", "go.sum", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.toml", "cargo.lock", "poetry.lock", "pipfile",
    "pipfile.lock", "composer.json", "composer.lock", "gemfile", "gemfile.lock", "requirements.txt", "go.work", "go.work.sum",
)
BUILD_FILES = (
    "makefile", "dockerfile", ".dockerignore", ".gitignore", ".gitattributes", ".golangci.yml", ".golangci.yaml", ".goreleaser.yml",
    ".goreleaser.yaml", ".editorconfig", ".pre-commit-config.yaml", "taskfile.yml", "taskfile.yaml",
)
PREFIXES = ("changelog", "license", "notice", "authors", "contributing")
GENERATED = (".pb.go", ".pb.gw.go", "_grpc.pb.go", ".gen.go", ".generated.go", "_pb2.py", "_pb2_grpc.py")
SKIPPED = ("docs/", "doc/", ".github/", "build/", "testdata/", "/fixtures/", "vendor/", "node_modules/", "third_party/")
I18N, I18N_EXTENSIONS = ("locale", "locales", "i18n", "translations", "lang", "language"), (".json", ".yaml", ".yml")


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<file_path:variant>").isNotNull()  # quicker than asking for the whole schema


def snippets(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """outputs (keys, output): (keys, pos, snippet) of a bare list or an object's `snippets`; items that are no objects are skipped."""
    items = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    listed = once(_value(F.col("output")), lambda v: F.coalesce(items(v, "$.snippets"), items(v, "$")))
    flat = outputs.select(*keys, F.posexplode(listed).alias("pos", "snippet"))
    return flat.where(_is_object(F.col("snippet")))


def as_int(v: Column) -> Column:
    """Numbers truncate, texts must hold a whole number, booleans are no numbers: null where there is none."""

    def one(x: Column) -> Column:
        v, kind = x["v"], x["kind"]
        whole, part = F.try_variant_get(v, "$", "bigint"), F.try_variant_get(v, "$", "decimal(38,18)").try_cast("bigint")
        number = F.when(kind.startswith("DECIMAL"), F.coalesce(part, whole)).when(kind == "DOUBLE", F.try_variant_get(v, "$", "double").try_cast("bigint"))
        return F.when(kind == "BIGINT", whole).when(kind == "STRING", integer(F.try_variant_get(v, "$", "string"))).otherwise(number)

    return once(F.struct(v.alias("v"), F.schema_of_variant(v).alias("kind")), one)


def fields(found: DataFrame) -> DataFrame:
    """Adds the five fields of a snippet, whichever it has. Each snippet is read once."""
    read = F.try_variant_get("snippet", "$", ", ".join(f"{k} variant" for k in (*REQUIRED, "description")).join(("struct<", ">")).replace(" variant", ":variant"))
    text = lambda v: F.try_variant_get(v, "$", "string")
    parsed = once(read, lambda s: F.struct(
        text(s["file_path"]).alias("file_path"), as_int(s["start_line"]).alias("start_line"), as_int(s["end_line"]).alias("end_line"), text(s["category"]).alias("category"),
        F.coalesce(text(s["description"]), F.lit("")).alias("description"), F.array_compact(F.array(*(F.when(s[k].isNotNull(), k) for k in REQUIRED))).alias("present"),
    ))
    return found.withColumn("_f", parsed).select(*found.columns, "_f.*")


def problems(parsed: DataFrame, files: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    """parsed: `fields`; files (keys, file_path, last_line): adds `problems`. A missing key, a bad number or a missing file ends the list."""
    known = files.select(*keys, "file_path", "last_line")
    j = parsed.join(known, [*keys, "file_path"], "left")
    missing = F.transform(F.array_except(F.array(*map(F.lit, REQUIRED)), F.col("present")), lambda k: F.concat(F.lit("missing key "), k))
    category = F.array_compact(F.array(F.when(~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "unknown category")))
    number = F.when(F.col("start_line").isNull() | F.col("end_line").isNull(), F.array(F.lit("not a line number")))
    file = F.when(F.col("last_line").isNull(), F.array(F.lit("file not found")))
    place = F.array_compact(F.array(
        F.when(F.col("start_line") < 1, "starts before line 1"), F.when(F.col("end_line") < F.col("start_line"), "ends before it starts"),
        F.when(F.col("end_line") > F.col("last_line"), "ends past the last line"),
    ))
    return j.withColumn("problems", F.when(F.size(missing) > 0, missing).otherwise(F.concat(category, F.coalesce(number, file, place))))


def run_valid(complete: Column, invalid_snippets: Column) -> Column:
    """Whether a run ended and each of its snippets stood; null counts as no."""
    return F.coalesce(complete & (invalid_snippets == 0), F.lit(False))


def combined(annotations: DataFrame) -> DataFrame:
    """annotations (inst, file_path, start_line, end_line, category, description, pos): one row per instance with its snippets as JSON text."""
    one = F.struct("file_path", "start_line", "end_line", "category", "description")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("s")))), lambda x: x["s"])
    return annotations.groupBy("inst").agg(F.to_json(listed).alias("relevant_snippets"))


def total_snippets(table: DataFrame) -> DataFrame:
    return table.agg(F.coalesce(F.sum(F.json_array_length("relevant_snippets")), F.lit(0)).cast("bigint").alias("n_snippets"))


def acceptable_miss(path: Column) -> Column:
    """Documentation, manifests, build files, generated code, vendored trees, translations."""
    ends = tuple(e for e in GENERATED if e.count(".") > 1 or "_" in e)

    def one(p: Column) -> Column:
        name = F.substring_index(p["low"], "/", -1)
        extension = F.when(name.contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1)))
        named = name.isin(*MANIFESTS, *BUILD_FILES) | reduce(or_, (name.startswith(x) for x in PREFIXES))
        kind = F.coalesce(extension.isin(*DOC_EXTENSIONS), F.lit(False)) | reduce(or_, (name.endswith(x) for x in ends))
        placed = reduce(or_, (p["low"].contains(x) for x in SKIPPED))
        translated = F.coalesce(extension.isin(*I18N_EXTENSIONS), F.lit(False)) & p["low"].rlike(rf"(^|/)({'|'.join(I18N)})/")
        return kind | named | placed | translated

    return once(F.struct(F.lower(path).alias("low")), one)


def source_misses(gold: DataFrame, annotated: DataFrame, new_files: DataFrame) -> DataFrame:
    """gold (inst, path), annotated (inst, path): existing gold files of annotated instances that no snippet names and none may leave out."""
    # judged once for each distinct file: a filter on the group's own key would be moved back before the grouping
    each = gold.groupBy("inst", "path").agg(F.any_value("path").alias("_p"))
    wanted = each.where(~acceptable_miss(F.col("_p"))).select("inst", "path")
    named = annotated.select("inst", "path").unionByName(new_files.select("inst", "path"))
    return wanted.join(annotated.select("inst").distinct(), "inst", "left_semi").join(named, ["inst", "path"], "left_anti")


def miss_audit(gold: DataFrame, annotated: DataFrame, new_files: DataFrame) -> DataFrame:
    """One row: annotated instances with gold files, and those of them that miss a source file."""
    seen = gold.select("inst").distinct().join(annotated.select("inst").distinct(), "inst", "left_semi")
    flagged = source_misses(gold, annotated, new_files).groupBy("inst").agg(F.lit(1).alias("missed"))
    return seen.join(flagged, "inst", "left").agg(F.count("*").alias("scanned"), F.count("missed").alias("flagged"))


def _value(output: Column) -> Column:
    return F.try_parse_json(output)


def output_problems(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """outputs (keys, output; null: no file): (keys, pos, problem) of what is wrong with a file as a whole, at pos -1, and of items that are no objects.

    A text counts as a list of its characters, none of which is an object.
    """
    v = _value(F.col("output"))
    kind, listed = F.schema_of_variant(v), F.try_variant_get(v, "$.snippets", "variant")
    inner = F.schema_of_variant(listed)
    whole = (
        F.when(F.col("output").isNull(), NO_FILE).when(v.isNull(), NO_JSON).when(kind.startswith("OBJECT") & listed.isNotNull() & ~inner.startswith("ARRAY") & (inner != "STRING"), NO_LIST)
        .when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "STRING"), NO_SHAPE)
    )
    text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(inner == "STRING", F.try_variant_get(v, "$.snippets", "string"))
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.snippets", "array<variant>"))
    odd = F.when(text.isNotNull(), F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.lit(True))).otherwise(F.transform(items, lambda x: ~F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))))
    each = outputs.select(*keys, F.posexplode(F.when(whole.isNull(), odd)).alias("pos", "odd")).where("odd").select(*keys, "pos", F.lit(NO_OBJECT).alias("problem"))
    return outputs.select(*keys, F.lit(-1).alias("pos"), whole.alias("problem")).where("problem is not null").unionByName(each)


def recall(gold: DataFrame, annotated: DataFrame) -> DataFrame:
    """Per instance: gold files, those covered, those missed (sorted), and how many files the annotation names."""
    named = annotated.select("inst", "path", F.lit(True).alias("hit")).distinct()
    hit = gold.distinct().join(named, ["inst", "path"], "left")
    sizes = named.groupBy("inst").agg(F.count("*").alias("n_named"))
    return hit.groupBy("inst").agg(F.count("*").alias("n_gold"), F.count("hit").alias("n_covered"), F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("path")))).alias("missed")).join(sizes, "inst", "left").na.fill(0, ["n_named"])


def cost_rollup(runs: DataFrame) -> DataFrame:
    """runs (lang, error, valid, cost, input, cache_creation, cache_read, output): per language and in all (`total`): all runs, and of those without an error the number, the valid ones and sums."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ok = F.col("error").isNull()
    of_ok = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0))
    return runs.rollup("lang").agg(
        (F.grouping("lang") == 1).alias("total"), F.count("*").alias("n_runs"), F.count_if(ok).alias("n_ok"), F.count_if(ok & F.coalesce("valid", F.lit(False))).alias("n_valid"),
        of_ok(zero("cost")).alias("cost"), of_ok(zero("input") + zero("cache_creation") + zero("cache_read")).alias("input_tokens"), of_ok(zero("output")).alias("output_tokens"),
    )


def stalls(runs: DataFrame) -> DataFrame:
    """runs (inst, wall, active): the worst idle time, 0 at least, and whether it exceeds the limit; runs with an unknown time do not count."""
    idle = F.col("wall") - F.col("active")
    worst = runs.groupBy("inst").agg(F.greatest(F.coalesce(F.max(idle), F.lit(0.0)), F.lit(0.0)).alias("worst"), F.count_if(idle > STALL_SECONDS).alias("n"))
    return worst.select("inst", "worst", (F.col("n") > 0).alias("stalled"))
