"""Reading and writing review tables."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revmill.operators.filters import conform
from revmill.schema import GENERATORS, META, RAW_REVIEW, REVIEW
from revmill.session import stored
from revmill.sources import committed

# `Books.jsonl`, `Books.jsonl/part-0.json` and `category=Books/part-0.json`
# all belong to category Books.
CATEGORY_OF_PATH = (
    r"(?:^|/)(?:category=)?([^/=]+?)(?:\.jsonl?)?(?:\.gz)?(?:/part-[^/]*)?$"
)


def category_of(path) -> "F.Column":
    return F.regexp_extract(path, CATEGORY_OF_PATH, 1)


#: Stands after a line's value when the line is read, so that text behind the value shows.
_END = "end of line"
_LOOSE = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "true",
    "maxNestingDepth": str(2**31 - 1),
    "maxNumLen": str(2**31 - 1),
    "maxStringLen": str(2**31 - 1),
}


def _strictly():
    """(whether the line is one JSON value, its fields), by the strict parser."""
    line = F.try_parse_json(F.concat(F.lit("["), "value", F.lit(f',"{_END}"]')))
    one = F.try_variant_get(line, "$[1]", "string") == _END
    alone = F.try_variant_get(line, "$[2]", "string").isNull()
    fields = [
        F.try_variant_get(line, f"$[0].{f.name}", f.dataType.simpleString()).alias(f.name) for f in RAW_REVIEW
    ]
    return F.coalesce(one & alone, F.lit(False)), F.struct(*fields)


def _loosely():
    """The same of an object with repeated fields, bare NaN or Infinity, or very deep or long values.

    The last of repeated fields counts, and a bare NaN is a missing number.
    """
    schema = ", ".join(f"{f.name}: string" for f in RAW_REVIEW)
    end = f',{{"{RAW_REVIEW[0].name}": "{_END}"}}]'
    line = F.from_json(F.concat(F.lit("["), "value", F.lit(end)), f"array<struct<{schema}>>", _LOOSE)
    fields = []
    for f in RAW_REVIEW:
        text = line[0][f.name]
        number = F.regexp_replace(text, '^"(NaN|-?Infinity)"$', "$1").try_cast("double")
        value = {
            "string": text,
            "double": F.when(~F.isnan(number), number),
            "bigint": F.coalesce(text.try_cast("bigint"), F.when(~F.isnan(number), number).try_cast("bigint")),
        }[f.dataType.simpleString()]
        fields.append(value.alias(f.name))
    return F.coalesce((F.size(line) == 2) & (line[1][RAW_REVIEW[0].name] == _END), F.lit(False)), F.struct(*fields)


def read_lines(lines: DataFrame) -> DataFrame:
    """Every line that is not blank: value, category, file, arrival, and ``row``, null if it does not parse.

    ``arrival`` orders lines by when their file was last written, its path, and the block
    of the file in which they stand.

    A line parses if it is one JSON value. What the strict parser turns down (a field
    named twice, NaN and Infinity, values nested without end) is read once more. A field
    that is missing or cannot be cast to its type is null, and so are all fields of a
    line that is no object.
    """
    strict, fields = _strictly()
    loose, again = _loosely()
    return lines.where(F.trim(F.translate("value", "\t\r\n", "   ")) != "").select(
        "value",
        category_of(F.col("_metadata.file_path")).alias("category"),
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.unix_micros("_metadata.file_modification_time").alias("written"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        ).alias("arrival"),
        F.when(strict, F.array(fields)).when(loose, F.array(again)).alias("row"),
    )


def parsed_lines(lines: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Raw reviews from a table of JSON lines (``value``) with file metadata.

    Blank lines and lines that do not parse are left out, whatever columns are read;
    ``rejected_lines`` has the latter. An ``observation`` gets ``lines``, how many are
    not blank, and ``rejected``, how many of them do not parse.
    """
    rows = read_lines(lines)
    if observation is not None:
        rows = rows.observe(
            observation, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("row").isNull()).alias("rejected")
        )
    return rows.select(F.inline("row"), "category", "arrival")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(category, file, reason, value) of the lines that do not parse."""
    ended = F.rtrim(F.translate("value", "\t\r\n", "   ")).rlike("[}\\]]$")
    begins = F.ltrim(F.translate("value", "\t\r\n", "   ")).rlike("^[{\\[]")
    reason = (
        F.when(F.try_parse_json("value").isNotNull(), F.lit("text after the value"))
        .when(~begins, F.lit("no object"))
        .when(~ended, F.lit("cut off"))
        .otherwise(F.lit("not JSON"))
    )
    return read_lines(lines).where(F.col("row").isNull()).select("category", "file", reason.alias("reason"), "value")


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(path)


def scan_reviews_json(spark: SparkSession, path, observation: Observation | None = None) -> DataFrame:
    """Raw reviews from JSON lines, one file or folder per category."""
    return parsed_lines(_lines(spark, path), observation).drop("arrival")


def scan_rejected_json(spark: SparkSession, path) -> DataFrame:
    """The lines of the same files that ``scan_reviews_json`` leaves out, each with a reason."""
    return rejected_lines(_lines(spark, path))


def scan_reviews(spark: SparkSession, path) -> DataFrame:
    """A review table. The schema is given since an all-null timestamp column
    may be stored with another type."""
    return spark.read.schema(REVIEW).parquet(path)


def load_all(
    spark: SparkSession, human_path: str, generated_dir: str, generators=GENERATORS
) -> tuple[DataFrame, DataFrame]:
    """The human table and the union of the generator tables."""
    tables = [scan_reviews(spark, f"{generated_dir}/{g}.parquet") for g in generators]
    return scan_reviews(spark, human_path), reduce(DataFrame.unionByName, tables)


def write_reviews(df: DataFrame, path: str) -> None:
    """Store a pool or a generated table."""
    conform(df).write.mode("overwrite").parquet(path)


def write_generated(df: DataFrame, generated_dir: str, generators=GENERATORS) -> None:
    """One table per generator, where ``load_all`` looks for them.

    ``df`` is computed once. Rows of a generator that is not listed are an error.
    """
    listed = F.col("generator").isin(list(generators))
    unlisted = F.raise_error(F.concat(F.lit("generator not listed: "), F.coalesce("generator", F.lit("null"))))
    checked = conform(df).withColumn("generator", F.when(listed, F.col("generator")).otherwise(unlisted))
    rows = stored(checked, "generated")
    for g in generators:
        write_reviews(rows.where(F.col("generator") == g), f"{generated_dir}/{g}.parquet")


SPLITS = T.StructType(
    [*REVIEW.fields, T.StructField("rotation", T.IntegerType()), T.StructField("split", T.StringType())]
)


def _outside(rotations: Sequence[int] | None):
    """Folders of rotations that a write does not replace; ``None`` replaces all."""
    if rotations is None:
        return None
    replaced = {str(r) for r in rotations}
    return lambda values: values["rotation"] not in replaced


def write_splits(splits: DataFrame, path: str, rotations: Sequence[int] | None = None) -> None:
    """Store every split of every rotation, one folder each.

    Everything that was stored is replaced, or only the named ``rotations``: splits that
    got no row this time and rotations that are no longer built are gone. A write that
    fails changes nothing (see ``committed``).
    """
    committed.write(splits, path, ["rotation", "split"], _outside(rotations))


def write_meta(meta: DataFrame, path: str, rotations: Sequence[int] | None = None) -> None:
    """Store the sizes of the rotations in ``meta``, like their splits."""
    committed.write(meta, path, ["rotation"], _outside(rotations))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """The stored sizes of all rotations."""
    return committed.read(spark, path, T.StructType.fromDDL(f"{META}, rotation int"))


def read_split(spark: SparkSession, path: str, rotation: int, split: str) -> DataFrame:
    """One split of one rotation; only its folder is listed and read."""
    return committed.read(spark, path, SPLITS, {"rotation": str(rotation), "split": split}.__eq__)


def read_splits(spark: SparkSession, path: str, rotations: Sequence[int] | None = None) -> DataFrame:
    """All stored splits, or those of some rotations."""
    wanted = None if rotations is None else {str(r) for r in rotations}
    return committed.read(spark, path, SPLITS, wanted and (lambda values: values["rotation"] in wanted))
