"""Wrapped table exports: JSON documents that carry rows in an inner array.

Layouts: ``[{type: header}, {type: table, name, data: [...]}]``, an object with
``data`` / ``records`` / ``operacoes`` / ``table``, or a bare list of rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonetide.session import cut_lineage

# Keys that may hold the rows.
ROW_KEYS = ["data", "records", "operacoes", "table"]


def _row_schema(fields: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])


def read_wrapped_json(spark: SparkSession, path: str, fields: Sequence[str], table: str | None = None, multi_line: bool = True) -> DataFrame:
    """Rows of every wrapped document below ``path``, all fields as text.

    One read covers the three layouts: unknown keys come back null, and a bare
    list yields the row fields at the top level.  With ``multi_line`` a file is
    one document, else each line is one.
    """
    row = _row_schema(fields)
    outer = [T.StructField("type", T.StringType()), T.StructField("name", T.StringType())]
    outer += [T.StructField(k, T.ArrayType(row)) for k in ROW_KEYS]
    taken = {f.name for f in outer}
    # row fields such as "Data" differ from a wrapper key by case at most
    clash = [f for f in fields if f.lower() in taken]
    if not clash:
        outer += row.fields
    reader = spark.read.option("multiLine", multi_line)
    docs = reader.schema(T.StructType(outer)).json(path)
    if table is not None:
        docs = docs.filter((F.col("type") == "table") & (F.col("name") == table))
    inner = docs.select(F.explode(F.coalesce(*[F.col(k) for k in ROW_KEYS])).alias("r")).select("r.*")
    if table is not None:
        return inner
    if clash:
        # a wrapper read as a row shows its array, or its type, in the field
        rows = reader.schema(row).json(path)
        wrapper = F.lit(False)
        for f in clash:
            wrapper = wrapper | F.coalesce(F.col(f).startswith("[") | ((F.lit(f) == "type") & F.col(f).isin("header", "database", "table")), F.lit(False))
        bare = rows.filter(~wrapper)
    else:
        bare = docs.filter(F.coalesce(F.col("type"), *[F.col(k).cast("string") for k in ROW_KEYS]).isNull())
    some = F.coalesce(*[F.col(f) for f in fields]).isNotNull()
    return inner.unionByName(bare.filter(some).select(*fields))


def write_wrapped_json(df: DataFrame, path: str, table: str, rows_per_document: int = 10_000) -> None:
    """Header plus table documents of bounded size, one document per line.

    Rows become JSON in the JVM; each task joins those of one Arrow batch after the
    other.  Nothing is shuffled, and no document gathers more than
    ``rows_per_document`` rows or one batch.
    """
    name = json.dumps(table, ensure_ascii=False)
    head, tail = f'[{{"type": "header", "name": {name}}}, {{"type": "table", "name": {name}, "data": [', "]}]"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch["row"]
            yield pd.DataFrame({"value": [head + ", ".join(rows[at : at + rows_per_document]) + tail for at in range(0, len(rows), rows_per_document)]})

    fields = F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns])
    text = df.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("row"))
    text.mapInPandas(pack, "value string").write.text(path)


def _row_places(doc: object) -> list[list]:
    """Where the row lists of a document are: paths of keys, one per list, in order."""
    if isinstance(doc, dict):
        return [[k] for k in ROW_KEYS if isinstance(doc.get(k), list)][:1]
    if not isinstance(doc, list):
        return []
    tables = [[i, k] for i, d in enumerate(doc) if isinstance(d, dict) and ("type" in d or "name" in d) for k in ROW_KEYS if isinstance(d.get(k), list)]
    return tables or [[]]


def _taken_apart(doc: object, key: str) -> Iterator[tuple[str, str, int, str | None, str]]:
    """(wrapper, places, position, id, record) of each row; the wrapper has empty lists in their places."""
    places = []
    rows = []
    for place in _row_places(doc):
        if place:
            holder = doc[place[0]] if len(place) == 2 else doc
            found, holder[place[-1]] = holder[place[-1]], []
        else:
            found, doc = doc, []
        places.append([place, len(found)])
        rows += found
    wrapper, where = json.dumps(doc, ensure_ascii=False), json.dumps(places)
    for i, row in enumerate(rows):
        known = row.get(key) if isinstance(row, dict) else None
        yield wrapper, where, i, None if known is None else str(known), json.dumps(row, ensure_ascii=False)
    if not rows:
        yield wrapper, where, 0, None, ""


def _put_together(wrapper: str, where: str, records: list[str]) -> str:
    doc, at = json.loads(wrapper), 0
    for place, n in json.loads(where):
        rows = [json.loads(r) for r in records[at : at + n]]
        at += n
        if not place:
            return json.dumps(rows, ensure_ascii=False)
        (doc[place[0]] if len(place) == 2 else doc)[place[-1]] = rows
    return json.dumps(doc, ensure_ascii=False)


def update_wrapped_json(spark: SparkSession, path: str, out: str, key: str, column: str, updates: DataFrame, multi_line: bool = True) -> None:
    """Write the wrapped documents at ``path`` again with one field of their rows changed.

    ``updates`` holds (key, column); a row whose id, as text, is listed gets the new value as text,
    others stay as they are, and so do rows without id, values that are null or empty, all other fields, the order of rows, and
    whatever else a document holds.  Of several values of one id the greatest counts.
    Documents come out one per line.  Rows meet the updates in a join; a document is
    put together in one task, so its size is that of the documents read.
    """
    text = spark.read.text(path, wholetext=multi_line).filter(F.trim("value") != "")
    docs = cut_lineage(text.select(F.monotonically_increasing_id().alias("doc"), "value"), "documents")

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, value in zip(batch["doc"], batch["value"]):
                rows = list(_taken_apart(json.loads(value), key))
                yield pd.DataFrame([(number, *r) for r in rows], columns=["doc", "wrapper", "places", "pos", "id", "record"])

    rows = cut_lineage(docs.mapInPandas(apart, "doc long, wrapper string, places string, pos int, id string, record string"), "records")
    fresh = updates.select(F.col(key).cast("string").alias("id"), F.col(column).cast("string").alias("_new")).filter("id is not null and _new <> ''")
    fresh = fresh.groupBy("id").agg(F.max("_new").alias("_new"))

    @F.pandas_udf("string")
    def changed(records: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([r if v is None or v != v else json.dumps(json.loads(r) | {column: v}, ensure_ascii=False) for r, v in zip(records, values)], dtype=object)

    @F.pandas_udf("string")
    def whole(wrappers: pd.Series, places: pd.Series, records: pd.Series) -> pd.Series:
        return pd.Series([_put_together(w, p, list(r)) for w, p, r in zip(wrappers, places, records)], dtype=object)

    joined = rows.join(fresh, "id", "left").select("doc", "pos", F.when(F.col("_new").isNull(), F.col("record")).otherwise(changed("record", "_new")).alias("record"))
    lists = joined.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "record"))).alias("_rows"))
    frames = rows.filter("pos = 0").select("doc", "wrapper", "places").join(lists, "doc")
    frames.select(whole("wrapper", "places", F.transform("_rows", lambda r: r["record"])).alias("value")).write.text(out)


def read_json_folder(spark: SparkSession, paths: dict[str, str], schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Union of several JSON layouts: ``list``, ``data`` and ``features``."""
    parts = []
    for layout, path in paths.items():
        if layout == "list":
            parts.append(spark.read.schema(schema).option("multiLine", multi_line).json(path))
        elif layout == "data":
            wrap = T.StructType([T.StructField("data", T.ArrayType(schema))])
            parts.append(spark.read.schema(wrap).option("multiLine", multi_line).json(path).select(F.explode("data").alias("r")).select("r.*"))
        elif layout == "features":
            feature = T.StructType([T.StructField("properties", schema)])
            wrap = T.StructType([T.StructField("features", T.ArrayType(feature))])
            rows = spark.read.schema(wrap).option("multiLine", multi_line).json(path).select(F.explode("features").alias("f"))
            parts.append(rows.select("f.properties.*"))
        else:
            raise ValueError(f"unknown layout {layout!r}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def tally_key(documents: DataFrame, column: str, key: str | Sequence[str]) -> DataFrame:
    """How often each value of a key occurs anywhere in JSON texts.

    ``key`` may list several spellings.  Texts and whole numbers count, trimmed and
    in lower case; nested values, fractions and nulls do not.
    """
    keys = [key] if isinstance(key, str) else list(key)
    # a quoted key, a colon, then a quoted text, a whole number or a truth value
    pattern = '"(?:' + "|".join(map(re.escape, keys)) + r')"\s*:\s*("(?:[^"\\]|\\.)*"|-?[0-9]+(?![0-9.eE])|true|false)'
    values = documents.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))).alias("v"))
    value = F.lower(F.trim(F.regexp_replace("v", '^"|"$', "")))
    return values.select(value.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


