"""Name standardisation against an official list, and narrative fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.functions import geo
from zonetide.operators.names import Distance, Ratio, match_names


def match_by_ratio(raw: DataFrame, column: str, official: DataFrame, name: str, least: float = 0.5, inclusive: bool = True) -> DataFrame:
    """(column, matched, score) for each distinct raw name, by the ratio of matching blocks."""
    return match_names(raw, column, official, name, Ratio(least), inclusive)


def match_by_distance(raw: DataFrame, column: str, official: DataFrame, name: str, least: float = 0.5, scored: bool = False) -> DataFrame:
    """As above with edit distance: 1 - levenshtein / longer length, native; with ``scored`` the best score also where nothing matches."""
    return match_names(raw, column, official, name, Distance(least), scored=scored)


def apply_matches(df: DataFrame, column: str, matches: DataFrame, keep_original: bool = True, unknown: str = "NAO INFORMADO") -> DataFrame:
    """Standard name, else the original (or nothing), else the unknown literal."""
    fallback = F.nullif(F.trim(F.col(column)), F.lit("")) if keep_original else F.lit(None)
    return df.join(matches.select(column, "matched"), column, "left").withColumn(
        "standard", F.coalesce(F.col("matched"), fallback, F.lit(unknown))
    ).drop("matched")


def match_audit(df: DataFrame, column: str, matches: DataFrame) -> DataFrame:
    """Matched and unmatched names with their row counts."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return matches.join(counts, column, "left").withColumn("status", F.when(F.col("matched").isNull(), "unmatched").otherwise("matched"))


def mapping_stats(audit: DataFrame, official: DataFrame, name: str) -> DataFrame:
    """One row: shares of names and rows matched, and of the list covered."""
    hit = F.col("matched").isNotNull()
    used = audit.select(F.count_distinct("matched")).scalar()
    return audit.agg(
        F.count(F.lit(1)).alias("names"), F.count_if(hit).alias("matched_names"),
        (F.count_if(hit) * 100.0 / F.count(F.lit(1))).alias("pct_names"),
        (F.sum(F.when(hit, F.col("rows")).otherwise(0)) * 100.0 / F.sum("rows")).alias("pct_rows"),
    ).withColumn("list_covered", used * 100.0 / official.select(F.count_distinct(name)).scalar())


def remap(df: DataFrame, column: str, report: DataFrame, raw: str, target: str) -> DataFrame:
    """Names through a stored report, upper case where it has no entry."""
    stored = report.select(F.col(raw).alias(column), F.col(target).alias("_to"))
    return df.join(stored, column, "left").withColumn("name", F.coalesce("_to", F.upper(F.trim(F.col(column))))).drop("_to")


# Patterns of the free narratives, tried in order.
PEOPLE_PATTERNS = [
    r"(\d+)\s+(?:preso|presos|indivíduo|indivíduos|homens?\s+presos)",
    r"(?:preso|presos).*?(\d+)",
    r"(\d+)\s+(?:capturado|capturados|detido|detidos)",
]
MASS_PATTERNS = [
    r"(\d+(?:\.\d+)?)\s*(?:kg|quilos?|kilos?)\s+de\s+(?:drogas?|cocaína|crack|maconha)",
    r"(\d+(?:\.\d+)?)\s*(?:kg|quilos?|kilos?)",
    r"(\d+(?:\.\d+)?)\s*g(?:ramas?)?(?:\s+de\s+drogas?|de\s+cocaína)",
    r"(?:drogas?).*?(\d+(?:\.\d+)?)\s*(?:kg|g)",
]
MASS_VALUE = r"(\d+(?:\.\d+)?)"
WEAPON_PATTERNS = [
    r"(\d+)\s+(?:revólver|revól|arma|espingarda|fuzil|pistola|metralhadora|carabina)",
    r"(?:arma|revólver|espingarda).*?(\d+)",
    r"(?:apreendida?|apreendidas?)\s+(?:uma?|)?(\d+)\s+(?:arma|revólver)",
]
DECIMAL_PAIR = r"(-?\d+\.\d+),?\s*(-?\d+\.\d+)"
# Patterns of the structured narratives.
DATE_FIELD = r"01\s*-\s*DATA[:\s]+(\d{1,2})/(\d{1,2})/(\d{4})"
PLACE_FIELD = r"MUNIC[IÍ]PIO[:\s-]+([A-ZÁÉÍÓÚ\s]+?)(?:-CE|-SP|$|\n)"
NATURE_NUMBER = r"(?iuU)10\s*-\s*NATUREZA[^:]*:[^0-9]*([0-9]+)(?:\s*-\s*([^\n]+?))?(?=\n\d{2}\s*-|\z)"
NATURE_TEXT = r"(?iuU)NATUREZA[^\n]*?:\s*([^\n]+)"
WEAPON_NUMBER = r"(?iuU)(\d+)\s+(?:REVÓLVER|REVOLVER|PISTOLA|FUZIL|ESCOPETA|METRALHADORA|CARABINA)"
WEAPON_WORD = r"(?iuU)(?:UMA|UM)\s+(?:REVÓLVER|REVOLVER|PISTOLA|FUZIL)"
MASS_GENERIC = r"(?iuU)(\d+(?:\.\d+)?)\s*G[RAMA]*\s+(?:de\s+)?(?:DROGAS?|COCAÍNA|CRACK|MACONHA)"
MASS_COCAINE = r"(?iuU)COCAÍNA\s*\(PESO EM GRAMA[S]?\)[:\s]+([\d\.]+)\s*(?:PAPELOTES|G|GR|GRAMA)"
MASS_MARIJUANA = r"(?iuU)MACONHA\s*\(PESO EM GRAMA[S]?\)[:\s]+([\d\.\s,;PAPELOTES\(\)GRT]+)"
MASS_MARIJUANA_PARTS = r"(\d+(?:\.\d+)?)\s*(?:PAPELOTES|G|GRAMA|TABLETES)"
PACKET_GRAMS = 10.0
DMS_TEXT = r"""(-\d+)°(\d+)['°](\d+)["']?([NSEW])?,?\s*(-?\d+)°(\d+)['°](\d+)["']?([NSEW])?"""


def _first_group(text: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def narrative_fields(df: DataFrame, text: str) -> DataFrame:
    """Counts, mass in grams, coordinates, kind and a quality score hits / 4."""
    low = F.lower(F.col(text))
    # matched texts first, values from them afterwards: each pattern runs once
    masses = [F.nullif(F.regexp_extract(low, p, 0), F.lit("")) for p in MASS_PATTERNS]
    found = df.withColumns({
        "_people": _first_group(low, PEOPLE_PATTERNS), "_weapons": _first_group(low, WEAPON_PATTERNS),
        "_mass": F.coalesce(*masses), "_pair": F.nullif(F.regexp_extract(text, DECIMAL_PAIR, 0), F.lit("")),
        "kind": F.when(low.contains("grande apreensão") | low.contains("megaoperação"), "megaoperacao")
        .when(low.contains("com_pouca_incidência"), "baixa_incidencia").when(low.contains("patrulhamento"), "patrulhamento")
        .otherwise("operacao_rotina"),
    })
    # the value is the first number of a match, or the last for "drogas ... 5 kg"
    mass = F.col("_mass")
    number = F.when(mass.startswith("droga"), F.regexp_extract(mass, MASS_PATTERNS[3], 1)).otherwise(F.regexp_extract(mass, MASS_VALUE, 1))
    grams = number.try_cast("double") * F.when(mass.contains("kg"), 1000.0).otherwise(1.0)
    pair = F.concat_ws(",", F.nullif(F.regexp_extract("_pair", DECIMAL_PAIR, 1), F.lit("")), F.nullif(F.regexp_extract("_pair", DECIMAL_PAIR, 2), F.lit("")))
    lat, lon = geo.parse_lat_lon(pair)
    degrees = F.when(F.col("_pair").isNull(), F.regexp_extract(text, DMS_TEXT, 0))
    dms_lat, dms_lon = geo.parse_coordinates(degrees)
    lat, lon = F.coalesce(lat, dms_lat), F.coalesce(lon, dms_lon)
    out = found.withColumns({
        "people": F.coalesce(F.col("_people").try_cast("int"), F.lit(0)), "grams": F.coalesce(grams, F.lit(0.0)),
        "weapons": F.coalesce(F.col("_weapons").try_cast("int"), F.lit(0)), "lat": lat, "lon": lon,
    })
    hits = sum((F.col(c).isNotNull().cast("int") for c in ("_weapons", "_mass", "lat")), F.col("_people").isNotNull().cast("int"))
    return out.withColumn("score", hits / 4.0).drop("_people", "_weapons", "_mass", "_pair")


def structured_narrative_fields(df: DataFrame, text: str, registered: str, lat: str, lon: str) -> DataFrame:
    """Date, place, nature, grams, weapons and a quality score hits / 3."""
    t = F.col(text)
    day = F.try_to_date(
        F.concat_ws("-", F.regexp_extract(t, DATE_FIELD, 3), F.lpad(F.regexp_extract(t, DATE_FIELD, 2), 2, "0"), F.lpad(F.regexp_extract(t, DATE_FIELD, 1), 2, "0")),
        "yyyy-MM-dd",
    )
    def total(numbers: Column) -> Column:
        return F.coalesce(F.aggregate(numbers, F.lit(0.0), lambda s, n: s + F.coalesce(n.try_cast("double"), F.lit(0.0))), F.lit(0.0))

    packets = F.regexp_extract(F.regexp_extract(t, MASS_COCAINE, 1), MASS_VALUE, 1).try_cast("double")
    block = F.regexp_extract(t, MASS_MARIJUANA, 1)
    grams = (
        total(F.regexp_extract_all(t, F.lit(MASS_GENERIC), F.lit(1))) + total(F.regexp_extract_all(block, F.lit(MASS_MARIJUANA_PARTS), F.lit(1)))
        + F.coalesce(packets * PACKET_GRAMS, F.lit(0.0))
    )
    counted = F.aggregate(F.regexp_extract_all(t, F.lit(WEAPON_NUMBER), F.lit(1)), F.lit(0), lambda s, n: s + F.coalesce(n.try_cast("int"), F.lit(0)))
    worded = F.size(F.regexp_extract_all(t, F.lit(WEAPON_WORD), F.lit(0)))
    number = F.nullif(F.regexp_extract(t, NATURE_NUMBER, 1), F.lit(""))
    nature = F.coalesce(F.concat(F.lit("Artigo "), number), F.nullif(F.trim(F.regexp_extract(t, NATURE_TEXT, 1)), F.lit("")), F.lit("Operação Tropa"))
    out = df.withColumns({
        "date": F.coalesce(day, F.col(registered).try_cast("date")),
        "place": F.coalesce(F.nullif(F.trim(F.regexp_extract(t, PLACE_FIELD, 1)), F.lit("")), F.lit("Desconhecido")),
        "nature": nature, "grams": F.coalesce(grams, F.lit(0.0)), "weapons": F.coalesce(counted + worded, F.lit(0)),
        "lat": F.col(lat).try_cast("double"), "lon": F.col(lon).try_cast("double"),
    })
    hits = (F.col("grams") > 0).cast("int") + (F.col("weapons") > 0).cast("int") + (F.col("lat").isNotNull() & F.col("lon").isNotNull()).cast("int")
    return out.withColumn("score", hits / 3.0).filter(F.col("date").isNotNull())
