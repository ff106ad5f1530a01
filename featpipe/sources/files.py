"""File readers with the options SQL pipelines use (SRC1-SRC6).

``read_csv_auto`` / ``read_csv`` / ``read_parquet`` / ``read_json_auto`` mirror the table
functions of the same name; each returns a lazy DataFrame, so column pruning and filters reach
the scan.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featpipe.session import checkpoint_root
from featpipe.sources import records
from featpipe.sources.records import Dialect, ends_inside


DELIMITERS = (",", "\t", "|", ";")
QUOTES = ('"', "'")
NO_QUOTE = "\x00"
SNIFFED = 200  # lines of every split (of every file) that dialects are scored on


def sniff_dialect(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", skip: int = 0,
                  delimiters: tuple = DELIMITERS, quotes: tuple = QUOTES) -> Dialect:
    """The delimiter and quote under which the first lines of all splits of all files have the most even number of fields.

    Every candidate counts the fields of each sampled line; its score is the share of lines with its commonest count
    above one, then that count, then the order of the candidates. Only (candidate, count) totals reach the driver.
    """
    pairs = [(c, q) for q in quotes for c in delimiters]

    def run(batches):
        seen: dict = {}
        found: dict = {}
        for b in batches:
            for start, line in zip(zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True),
                                   b.column("value").to_pylist(), strict=True):
                if not line.strip() or seen.get(start, 0) >= SNIFFED:
                    continue
                seen[start] = seen.get(start, 0) + 1
                for k, (c, q) in enumerate(pairs):
                    bare = "".join(x for i, x in enumerate(line.split(q)) if i % 2 == 0)  # outside quotes
                    at = (k, bare.count(c) + 1, line.startswith(q) or c + q in line)
                    found[at] = found.get(at, 0) + 1
        if found:
            yield pa.RecordBatch.from_pylist([{"k": k, "fields": n, "quoted": q, "lines": v} for (k, n, q), v in found.items()])

    counts = records.lines(spark, path, encoding, skip).select("file", "start", F.substring("value", 1, 100_000).alias("value")).mapInArrow(
        run, "k long, fields long, quoted boolean, lines long").groupBy("k", "fields").agg(
        F.sum("lines").alias("lines"), F.sum(F.when(F.col("quoted"), F.col("lines")).otherwise(0)).alias("quoted"))
    one = counts.groupBy("k").agg(F.max_by(F.struct("fields", "lines"), F.when(F.col("fields") > 1, F.struct("lines", "fields"))).alias("best"),
                                  F.sum("lines").alias("all"), F.sum("quoted").alias("quoted")).collect()
    # a quote that never opens a field says nothing: the usual one is taken then
    scored = [(r["best"]["lines"] / r["all"], r["quoted"] > 0, r["best"]["fields"], -r["k"]) for r in one if r["best"] is not None]
    if not scored:
        return Dialect(delimiters[0], quotes[0])
    c, q = pairs[-max(scored)[3]]
    return Dialect(c, q)


def sniff_delimiter(spark: SparkSession, path: str | list[str], candidates: str = "".join(DELIMITERS)) -> str:
    """The delimiter of ``sniff_dialect``."""
    return sniff_dialect(spark, path, delimiters=tuple(candidates)).delim


def _source(spark: SparkSession, path, d: Dialect, encoding: str, skip: int):
    """None where every line is a record of its own (Spark's reader takes the files as they are); else the table of records.

    Costs one scan of the files as text; lines without a quote do not leave the JVM.
    """
    raw = records.lines(spark, path, encoding, skip)
    out = scratch_path(spark, "csv-splits")
    records.split_states(raw, d).write.parquet(out)
    splits = spark.read.parquet(out)
    if skip or not splits.where("opens").isEmpty():
        return records.records(raw, splits, d)
    return None


# from the narrowest to the widest; a column gets the first type that all its values have (NULLs and empty columns: any, so text)
TYPES = ("boolean", "int", "bigint", "double", "date", "timestamp", "string")
_DAY, _CLOCK = r"\d{4}-\d{2}-\d{2}", r"[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?"
_SHAPES = {"boolean": r"(?i)^(true|false)$", "int": r"^[+-]?\d{1,10}$", "bigint": r"^[+-]?\d{1,19}$",
           "double": r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf(inity)?)$", "date": f"^{_DAY}$", "timestamp": f"^{_DAY}({_CLOCK})?$"}


def infer_types(df: DataFrame) -> list[str]:
    """The type of each text column, from all rows in one aggregate: per column, how many values refuse each type.

    Types form a lattice: int below bigint below double, date below timestamp, all below string; partial counts merge by sums.
    """
    refused = []
    for i, c in enumerate(df.columns):
        v = F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
        refused.append(F.count(v).alias(f"n{i}"))
        for t, shape in _SHAPES.items():
            refused.append(F.count_if(v.isNotNull() & ~(v.rlike(shape) & v.try_cast(t).isNotNull())).alias(f"{t}{i}"))
    r = df.agg(*refused).first()
    return [next((t for t in TYPES[:-1] if r[f"n{i}"] and not r[f"{t}{i}"]), "string") for i in range(len(df.columns))]


def _names(found: list[str | None]) -> list[str]:
    """Names of a header: blank ones by place, repeated ones numbered."""
    out: list[str] = []
    for i, n in enumerate(found):
        n = (n or "").strip() or f"column{i}"
        base, k = n, 1
        while n in out:
            n, k = f"{base}_{k}", k + 1
        out.append(n)
    return out


def _options(d: Dialect, null_value: str | None, mode: str, corrupt: bool) -> dict:
    opts = {"sep": d.delim, "quote": d.quote, "multiLine": "true", "mode": mode}
    opts["escape"] = d.escape or d.quote  # a doubled quote is one, unless an escape character is named
    if null_value is not None:
        opts["nullValue"] = null_value
    if corrupt:
        opts["columnNameOfCorruptRecord"] = "_fp_corrupt"
    return opts


def _read(spark: SparkSession, path, d: Dialect, schema: str, header: bool, skip: int, encoding: str, null_value, mode: str, corrupt: bool,
          source: DataFrame | None) -> DataFrame:
    schema = schema + (", _fp_corrupt STRING" if corrupt else "")
    opts = _options(d, null_value, mode, corrupt)
    if source is None:
        return spark.read.options(**{**opts, "multiLine": "false"}).option("header", header).option("encoding", encoding).schema(schema).csv(path)
    rows = source.where(~F.col("first")) if header else source
    return rows.select(F.from_csv("value", schema, opts).alias("_fp_row")).select("_fp_row.*")


def read_csv_auto(spark: SparkSession, path: str | list[str], sep: str | None = None, header: bool = True, quote: str | None = None,
                  skip: int = 0, escape: str | None = None, encoding: str = "UTF-8", null_value: str | None = None) -> DataFrame:
    """Names from the header, types from all values, delimiter and quote by ``sniff_dialect`` where not given (SRC1).

    Three passes besides the later reads: a few lines of every split (dialect), the files as text (records that hold line breaks, see
    ``sources/records.py``), all values (types). Give ``columns`` to ``read_csv`` on big inputs. Without a header columns are ``column0`` and so on.
    """
    if sep is None or quote is None:
        found = sniff_dialect(spark, path, encoding, skip, (sep,) if sep else DELIMITERS, QUOTES if quote is None else (quote or NO_QUOTE,))
        sep, quote = found.delim, found.quote
    d = Dialect(sep, quote or NO_QUOTE, escape)
    source = _source(spark, path, d, encoding, skip)
    if source is None:
        first = records.lines(spark, path, encoding, skip).where("trim(value) <> ''").select("value").limit(1)
    else:
        first = source.where("first").select("value").limit(1)
    line = first.collect()
    if not line:
        return spark.createDataFrame([], "column0 STRING")
    head = line[0][0].removesuffix("\r")
    names = [f"column{i}" for i in range(_width(head, d))]
    if header:
        cut = F.from_csv(F.lit(head), ", ".join(f"{x} STRING" for x in names), _options(d, None, "PERMISSIVE", False))
        names = _names(list(spark.range(1).select(cut.alias("r")).select("r.*").first()))
    as_text = _read(spark, path, d, ", ".join(f"`{x}` STRING" for x in names), header, skip, encoding, null_value, "PERMISSIVE", False, source)
    ddl = ", ".join(f"`{x}` {t}" for x, t in zip(names, infer_types(as_text), strict=True))
    return _read(spark, path, d, ddl, header, skip, encoding, null_value, "PERMISSIVE", False, source)


def _width(record: str, d: Dialect) -> int:
    """Number of fields of one record."""
    n, inside = 0, False
    for piece in record.split(d.delim):
        inside = ends_inside(piece, inside, d)
        n += not inside
    return max(n, 1)


def read_csv(spark: SparkSession, path: str | list[str], columns: str | dict | None = None, delim: str = ",",
             header: bool = False, skip: int = 0, quote: str = '"', escape: str | None = None,
             null_padding: bool = True, encoding: str = "UTF-8", ignore_errors: bool = False,
             null_value: str | None = None, names: list[str] | None = None) -> DataFrame:
    """CSV with a declared schema (SRC2/SRC3/SRC4).

    ``columns`` is a DDL string or ``{name: type}``; multi-character delimiters such as
    ``::`` work. ``ignore_errors`` drops malformed rows (DROPMALFORMED); ``null_padding``
    keeps short rows with NULLs (PERMISSIVE). ``skip`` drops the first lines of every file.
    ``names`` renames headerless columns (``column0 AS pregnancies``). Quoted fields may hold line breaks: a scan of the files as text
    finds out whether any does, and only then records are put together from lines (``sources/records.py``).
    """
    if isinstance(columns, dict):
        columns = ", ".join(f"`{k}` {_sql_type(v)}" for k, v in columns.items())
    if not columns:
        df = read_csv_auto(spark, path, delim, header, quote, skip, escape, encoding, null_value)
        return df.toDF(*names) if names else df
    d = Dialect(delim, quote or NO_QUOTE, escape)
    # PERMISSIVE + corrupt-record column, then drop flagged rows: unlike DROPMALFORMED,
    # the result does not depend on which columns a later query reads
    mode = "PERMISSIVE" if ignore_errors or null_padding else "FAILFAST"
    df = _read(spark, path, d, columns, header, skip, encoding, null_value, mode, ignore_errors, _source(spark, path, d, encoding, skip))
    if ignore_errors:
        df = df.where(F.col("_fp_corrupt").isNull() & _whole_row(df)).drop("_fp_corrupt")
    if names:
        df = df.toDF(*names)
    return df


def _whole_row(df: DataFrame):
    """Always true, but needs every column: each row is converted (and judged) whole even when a query reads one column or only counts."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c != "_fp_corrupt"]) >= F.lit(-(2 ** 63))


def malformed_rows(spark: SparkSession, path: str, columns: str | dict, **options) -> DataFrame:
    """The rows ``ignore_errors`` drops, as a report: ``(bad_rows, total_rows)`` (SRC3). Rows are records, whatever lines they take."""
    if isinstance(columns, dict):
        columns = ", ".join(f"`{k}` {_sql_type(v)}" for k, v in columns.items())
    encoding, skip = options.get("encoding", "UTF-8"), int(options.get("skip", 0))
    d = Dialect(options.get("delim", ","), options.get("quote", '"') or NO_QUOTE, options.get("escape"))
    df = _read(spark, path, d, columns, options.get("header", False), skip, encoding, options.get("null_value"), "PERMISSIVE", True,
               _source(spark, path, d, encoding, skip))
    return df.where(_whole_row(df)).agg(F.count_if(F.col("_fp_corrupt").isNotNull()).alias("bad_rows"),
                                        F.count("*").alias("total_rows"))


def _sql_type(t: str) -> str:
    t = t.strip().upper()
    return {"VARCHAR": "STRING", "TEXT": "STRING", "INTEGER": "INT", "REAL": "FLOAT"}.get(t, t)


def rename_headerless(df: DataFrame, names: list[str]) -> DataFrame:
    """``_c0 .. _cN`` (Spark) / ``column0 ..`` -> the given names."""
    return df.toDF(*names)


def read_parquet(spark: SparkSession, path: str | list[str], base_path: str | None = None) -> DataFrame:
    """A file, a glob, or a hive-partitioned folder (``year=2024/month=01``): partition
    columns are discovered and filters on them prune folders."""
    r = spark.read
    if base_path:
        r = r.option("basePath", base_path)
    return r.parquet(*path) if isinstance(path, list) else r.parquet(path)


def read_json_auto(spark: SparkSession, path: str | list[str], format: str = "auto", columns: str | dict | None = None
                   ) -> DataFrame:
    """Newline-delimited JSON, or one JSON array per file (``format='array'``). ``auto`` looks at the first line that is not
    blank: one that opens an array makes it an array file."""
    r = spark.read
    if format == "auto":
        first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
        format = "array" if first and first[0][0].lstrip().startswith("[") else "newline_delimited"
    if format == "array":
        r = r.option("multiLine", True)
    if isinstance(columns, dict):
        columns = ", ".join(f"`{k}` {_sql_type(v)}" for k, v in columns.items())
    if columns:
        r = r.schema(columns)
    return r.json(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    return f"{checkpoint_root(spark)}/featpipe_scratch/{name}-{uuid.uuid4().hex[:10]}"
