"""Published results: GeoJSON sink, provenance, catalogue, manifest and serving scan."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AUDIT_STATUS, AUDIT_WARNING, PROVENANCE_COLUMNS
from ..functions.numbers import finite, number
from ..functions.suitability import rating_strict
from ..schemas import PROVENANCE

# fixed values: file name form of a published prediction, and its two model sources
FILE_NAME = r"(\d{4}-\d{2}-\d{2})_(.+?)(?:_500m)?(_deep)?_heatmap(?:_top)?\.(?:geojson|geojson\.gz|csv|parquet)$"
TREE_SOURCE, DEEP_SOURCE = "scikit_learn", "deep_learning"
MISSING_REASON = "trained prediction file is missing"


def geojson_lines(df: DataFrame, properties: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One GeoJSON Feature per line; NaN and infinities become null."""
    doubles = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    props = F.struct(*[(finite(p) if p in doubles else F.col(p)).alias(p) for p in properties])
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates")
        ).alias("geometry"),
        props.alias("properties"),
    )
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(df: DataFrame, path: str, properties: list[str], gzip: bool = True) -> None:
    """Newline-delimited features, written by every task in parallel."""
    lines = geojson_lines(df, properties)
    lines.write.mode("overwrite").text(path, compression="gzip" if gzip else "none")


def provenance_rows(entries: DataFrame) -> DataFrame:
    """Complete the 14 text columns; a missing download date is now."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    have = set(entries.columns)
    filled = {
        c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
        for c in PROVENANCE_COLUMNS
    }
    filled["download_date"] = F.coalesce(F.nullif(filled["download_date"], F.lit("")), now)
    return entries.select(*[e.alias(c) for c, e in filled.items()])


def append_provenance(spark: SparkSession, path: str, **entry: object) -> None:
    row = {c: str(entry.get(c, "")) for c in PROVENANCE_COLUMNS}
    one = spark.createDataFrame([tuple(row.values())], PROVENANCE)
    provenance_rows(one).write.mode("append").parquet(path)


def file_entries(names: DataFrame, name: str = "file_name") -> DataFrame:
    """(date, species_id, model_source) read from published file names."""
    def part(i: int) -> Column:
        return F.regexp_extract(F.element_at(F.split(name, "/"), -1), FILE_NAME, i)

    return names.select(
        F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd")).cast("date").alias("date"),
        part(2).alias("species_id"),
        F.when(part(3) == "_deep", DEEP_SOURCE).otherwise(TREE_SOURCE).alias("model_source"),
    ).where(F.col("date").isNotNull())


def catalogue(entries: DataFrame) -> DataFrame:
    """Dates per species and model source; the date list is bounded by the calendar."""
    return entries.groupBy("species_id", "model_source").agg(
        F.array_sort(F.collect_set("date")).alias("available_dates"),
        F.max("date").alias("prediction_date"),
    )


def availability(catalogue_rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every wanted species with its latest date, or unavailable with the reason."""
    latest = catalogue_rows.groupBy("species_id").agg(F.max("prediction_date").alias("prediction_date"))
    listed = wanted.join(latest, "species_id", "left")
    known = F.col("prediction_date").isNotNull()
    return listed.select(
        "species_id",
        known.alias("available"),
        "prediction_date",
        F.col("prediction_date").alias("target_date"),
        F.when(~known, MISSING_REASON).alias("reason"),
        F.when(known, "trained_under_audit").otherwise("unavailable").alias("audit_status"),
    )


def common_dates(entries: DataFrame, species: list[str]) -> DataFrame:
    """Days on which every listed species has a prediction."""
    wanted = entries.where(F.col("species_id").isin(species))
    n = wanted.groupBy("date").agg(F.count_distinct("species_id").alias("n"))
    return n.where(F.col("n") == len(set(species))).select("date")


def chosen_dates(entries: DataFrame, species: list[str], preferred: str | None = None) -> DataFrame:
    """Per species: the preferred or latest common day, else its own preferred or latest day."""
    mine = entries.where(F.col("species_id").isin(species))
    want = F.to_date(F.lit(preferred))
    def best(alias: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("date") == want, F.col("date"))), F.max("date")).alias(alias)

    common = common_dates(entries, species).agg(best("d")).first()["d"]  # one value
    own = mine.groupBy("species_id").agg(best("own"))
    return own.select("species_id", F.coalesce(F.lit(common).cast("date"), "own").alias("date"))


def mark_under_audit(manifest: DataFrame, warning: str = AUDIT_WARNING) -> DataFrame:
    """Flag available entries and put the warning before their notes, once."""
    notes = F.coalesce("notes", F.lit(""))
    warned = F.when(F.contains(notes, F.lit(warning)), notes).otherwise(
        F.trim(F.concat_ws(" ", F.lit(warning), notes))
    )
    on = F.col("available")
    return manifest.withColumns({
        "audit_status": F.when(on, AUDIT_STATUS).otherwise(F.col("audit_status")),
        "warning": F.when(on, warning).otherwise(F.col("warning")),
        "notes": F.when(on, warned).otherwise(F.col("notes")),
    })


POINTER = "CURRENT"


def write_manifest(manifest: DataFrame, root: str) -> str:
    """Write a new version of the manifest beside the older ones, then point to it.

    A version is never changed. The pointer is one small file that is renamed over the old one, so
    a reader sees the old version or the new one, and a failed write leaves the old one in place.
    """
    spark = manifest.sparkSession
    version = uuid.uuid4().hex
    manifest.write.parquet(f"{root}/versions/{version}")
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    new, pointer = fs.Path(f"{root}/.{POINTER}-{version}"), fs.Path(f"{root}/{POINTER}")
    out = new.getFileSystem(conf).create(new)
    out.writeBytes(version)
    out.close()
    over = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    over[0] = fs.Options.Rename.OVERWRITE
    store = new.getFileSystem(conf)
    fs.FileContext.getFileContext(store.getUri(), conf).rename(store.makeQualified(new), store.makeQualified(pointer), over)
    return version


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The version of the manifest that the pointer names."""
    version = spark.read.text(f"{root}/{POINTER}").first()["value"]
    return spark.read.parquet(f"{root}/versions/{version}")


def serving_scan(sources: list[DataFrame], keys: list[str], numeric: list[str]) -> DataFrame:
    """Rows of the best source per key: an earlier source hides the later ones entirely.

    Numeric text is coerced (NaN, infinities and words become NULL), rows without a position
    drop out, and the rating is derived again from the score.
    """
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    best = union.groupBy(*keys).agg(F.min("_source").alias("_best"))
    rows = union.join(best, keys).where(F.col("_source") == F.col("_best"))
    typed = rows.withColumns({c: number(F.col(c).cast("string")) for c in numeric})
    shown = typed.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return shown.withColumn(
        "rating", F.when(F.col("score").isNull(), "Low").otherwise(rating_strict("score"))
    ).drop("_best").withColumnRenamed("_source", "source_rank")
