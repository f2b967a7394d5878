"""CSV, Parquet and JSON files; column detection; sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonetide.functions.numbers import parse_number
from zonetide.operators.ranking import column_quantiles

# Names that stand for one canonical column.
ALIASES = {
    "lat": ["Latitude", "LATITUDE", "latitude", "lat", "LAT", "nr_latitude", "lat_geo", "geo_lat"],
    "long": ["Longitude", "LONGITUDE", "longitude", "long", "LONG", "nr_longitude", "lng", "LNG", "long_geo", "geo_long"],
    "municipio": ["Cidade", "CIDADE", "cidade", "Municipio", "MUNICIPIO", "municipio", "CidadeOcor", "nm_municipio"],
    "date": ["Data", "DATA", "data", "DataOcor", "data_hora", "dt_fato"],
    "natureza": ["Natureza", "NATUREZA", "natureza", "Descricao", "ds_natureza"],
}
NAME_CANDIDATES = ["name", "NAME", "nm_mun", "NM_MUN", "NM_MUNIC", "municipio", "MUNICIPIO", "NM_MUN8"]
ZONE_CANDIDATES = ["local_oficial", "bairro", "bairro_id", "local_norm", "local", "BairroOcor", "Bairro", "bairro_ocor", "localidade"]
CITY_CANDIDATES = ["CidadeOcor", "cidade", "Cidade", "municipio", "municipio_ocor"]
PREDICTION_ZONES = ["local_oficial", "local", "bairro", "name"]
DATE_CANDIDATES = ["data_hora", "data", "date", "datetime"]


def read_csv_text(spark: SparkSession, path: str, columns: Sequence[str], drop_bad: bool = True, audit: bool = False) -> DataFrame:
    """Every column as text with a declared schema, so no inference pass.

    Bad lines are dropped, or kept in ``_corrupt_record`` with ``audit``.
    """
    fields = [T.StructField(c, T.StringType()) for c in columns]
    reader = spark.read.option("header", True)
    if audit:
        fields.append(T.StructField("_corrupt_record", T.StringType()))
        return reader.option("columnNameOfCorruptRecord", "_corrupt_record").schema(T.StructType(fields)).csv(path)
    mode = "DROPMALFORMED" if drop_bad else "FAILFAST"
    return reader.option("mode", mode).schema(T.StructType(fields)).csv(path)


def read_newest_parquet(spark: SparkSession, candidates: Sequence[str]) -> DataFrame:
    """The first candidate that exists, newest version first."""
    for path in candidates:
        try:
            return spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(", ".join(candidates))


def rename_aliases(df: DataFrame, aliases: dict[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Canonical names; several aliases of one column are coalesced in order."""
    taken: set[str] = set()
    out: list[Column] = []
    for target, names in aliases.items():
        have = [c for c in names if c in df.columns]
        if target in df.columns and target not in have:
            have.insert(0, target)
        if have:
            taken.update(have)
            out.append(F.coalesce(*[F.col(c) for c in have]).alias(target))
    return df.select(*[c for c in df.columns if c not in taken], *out)


def detect_columns(columns: Sequence[str]) -> dict[str, str | None]:
    """Latitude, longitude, date, name, zone and city columns, by name alone."""
    def first(test) -> str | None:
        return next((c for c in columns if test(c.lower())), None)

    def listed(candidates: Sequence[str]) -> str | None:
        return next((c for c in candidates if c in columns), None)

    date, name = listed(DATE_CANDIDATES), listed(NAME_CANDIDATES)
    return {
        "lat": first(lambda c: "lat" in c),
        "lon": first(lambda c: "lon" in c or "lng" in c),
        "date": date or first(lambda c: "data" in c or "date" in c or "hora" in c),
        "name": name or (columns[0] if columns else None),
        "zone": listed(ZONE_CANDIDATES),
        "city": listed(CITY_CANDIDATES),
    }


def prediction_columns(df: DataFrame) -> DataFrame:
    """(zone, risk) of a prediction table with whatever column names it has.

    The zone is the first known name, else the first column; the risk is the
    first column with ``risco`` in its name, else the second column.
    """
    zone = next((c for c in PREDICTION_ZONES if c in df.columns), df.columns[0])
    risks = [c for c in df.columns if "risco" in c.lower()] or df.columns[1:2]
    risk = parse_number(risks[0], None) if risks else F.lit(None).cast("double")
    return df.select(F.upper(F.trim(F.col(zone).cast("string"))).alias("zone"), risk.alias("risk"))


def explode_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows of a nested array-of-structs column."""
    return df.select(F.explode(column).alias("r")).select("r.*")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], files_per_partition: int = 1) -> None:
    """One folder per key; a hot key is spread over several files by a salt."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_partition))
    df.repartition(*[F.col(c) for c in by], salt).write.partitionBy(*by).parquet(path)


def metadata_row(df: DataFrame, date: str, measures: Sequence[str], ps: dict[str, float]) -> DataFrame:
    """One row: row count, date range and quantiles of each measure."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    q = column_quantiles(df, {f"{m}_{name}": (m, p) for m in measures for name, p in ps.items()})
    return row.withColumns(q)
