"""COPY INTO: bulk load of staged CSV, JSON and Parquet files, and unload to a stage."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronbase.errors import InvalidValue, SqlSyntaxError, wrap
from heronbase.lexer import Token, closing, spell, split, tokens
from heronbase.operators.dml import Writer, dotted
from heronbase.plans.rewrite import date_picture
from heronbase.sources.catalog import Key, Table
from heronbase.sources.stages import Stages


@dataclass
class Format:
    type: str = "CSV"
    field_delimiter: str = ","
    record_delimiter: str = "\n"
    skip_header: int = 0
    trim_space: bool = False
    strip_outer_array: bool = False
    strip_null_values: bool = False
    multi_line: bool = True
    null_if: list[str] = field(default_factory=list)
    date_format: str = ""
    timestamp_format: str = ""


@dataclass
class Copy:
    target: list[str]
    stage: list[str]
    path: str = ""
    format: Format = field(default_factory=Format)
    format_name: str = ""
    pattern: str = ""
    files: list[str] = field(default_factory=list)
    on_error: str = "ABORT"
    purge: bool = False
    validation_mode: str = ""
    unload: list[Token] | None = None


@dataclass
class CopyResult:
    rows_loaded: int = 0
    rows_inserted: int = 0
    files_loaded: int = 0
    errors: list[str] = field(default_factory=list)


_ESCAPES = {"\\t": "\t", "\\n": "\n", "\\r": "\r", "\\r\\n": "\r\n"}


def _text(items: list[Token]) -> str:
    raw = items[0].value if items and items[0].kind in ("string", "dollar") else "".join(t.text for t in items)
    return _ESCAPES.get(raw, raw)


def _options(items: list[Token]) -> dict[str, list[Token]]:
    """``NAME = value`` pairs in any spacing, with or without commas."""
    out: dict[str, list[Token]] = {}
    i = 0
    while i < len(items):
        if items[i].up == ",":
            i += 1
            continue
        if i + 2 >= len(items) or items[i + 1].up != "=":
            raise SqlSyntaxError(f"no option: {spell(items[i:])}")
        end = closing(items, i + 2) + 1 if items[i + 2].up == "(" else i + 3
        out[items[i].up or items[i].name] = items[i + 2 : end]
        i = end
    return out


def _flag(items: list[Token]) -> bool:
    return _text(items).upper() == "TRUE"


def _list(items: list[Token]) -> list[str]:
    return [_text(p) for p in split(items[1:-1])] if items[0].up == "(" else [_text(items)]


def parse_format(options: dict[str, list[Token]]) -> Format:
    f = Format()
    for name, value in options.items():
        key = name.lower()
        if key == "type":
            f.type = _text(value).upper()
        elif key == "skip_header":
            f.skip_header = int(_text(value))
        elif key == "null_if":
            f.null_if = _list(value)
        elif isinstance(getattr(f, key, None), bool):
            setattr(f, key, _flag(value))
        elif hasattr(f, key):
            setattr(f, key, _text(value))
    return f


def parse_copy(sql: str | list[Token]) -> Copy:
    items = tokens(sql) if isinstance(sql, str) else list(sql)
    if items and items[-1].up == ";":
        items.pop()
    if [t.up for t in items[:2]] != ["COPY", "INTO"]:
        raise SqlSyntaxError("COPY INTO is needed")
    at, unload, target = 2, None, []
    if items[2].text == "@":
        stage, path, at = _location(items, 2)
        if at >= len(items) or items[at].up != "FROM":
            raise SqlSyntaxError("COPY INTO a stage needs FROM")
        if items[at + 1].up == "(":
            end = closing(items, at + 1)
            unload, at = items[at + 2 : end], end + 1
        else:
            _, end = dotted(items, at + 1)
            unload, at = [*tokens("SELECT * FROM"), *items[at + 1 : end]], end
    else:
        target, at = dotted(items, 2)
        if at + 1 >= len(items) or items[at].up != "FROM" or items[at + 1].text != "@":
            raise SqlSyntaxError("COPY INTO needs FROM @stage")
        stage, path, at = _location(items, at + 1)
    out = Copy(target, stage, path, unload=unload)
    for name, value in _options(items[at:]).items():
        if name == "FILE_FORMAT":
            if value[0].up != "(":
                out.format_name = _text(value)
                continue
            options = _options(value[1:-1])
            if "FORMAT_NAME" in options:
                out.format_name = _text(options["FORMAT_NAME"])
            out.format = parse_format(options)
        elif name == "PATTERN":
            out.pattern = _text(value)
        elif name == "FILES":
            out.files = _list(value)
        elif name == "ON_ERROR":
            out.on_error = _text(value).upper()
        elif name == "PURGE":
            out.purge = _flag(value)
        elif name == "VALIDATION_MODE":
            out.validation_mode = _text(value).upper()
    return out


def _location(items: list[Token], at: int) -> tuple[list[str], str, int]:
    """``@[db.][schema.]stage[/path]``."""
    stage, at = dotted(items, at + 1)
    path = ""
    while at < len(items) and items[at].text == "/":
        path += "/"
        at += 1
        while at < len(items) and items[at].up not in ("FROM", "FILE_FORMAT", "PATTERN", "FILES", "ON_ERROR", "PURGE", "VALIDATION_MODE", "/"):
            path += items[at].text
            at += 1
    return stage, path.strip("/"), at


class Loader:
    """Loads staged files into tables; each file's load is whole or not at all."""

    def __init__(self, writer: Writer, stages: Stages):
        self.writer, self.stages, self.view, self.spark = writer, stages, writer.view, writer.spark

    def run(self, sql: str | list[Token], context: tuple[str, str]) -> CopyResult:
        copy = parse_copy(sql)
        if copy.unload is not None:
            return self.unload(copy, context)
        key = self.writer.resolve(copy.target)
        where = self._where(copy.stage, key[:2] if len(copy.target) == 3 else context)
        if copy.format_name:
            own = copy.format_name.split(".")
            named = self.stages.catalog.format(*([*key[:2], own[0]] if len(own) == 1 else [key[0], *own] if len(own) == 2 else own))
            copy.format = parse_format({"TYPE": tokens(named.more["format_type"])} | _options(tokens(named.more["options"])))
        if copy.format.type not in ("CSV", "JSON", "PARQUET"):
            raise InvalidValue(f"no such file format: {copy.format.type}")
        files = [f for f, _ in self.stages.files(*where, copy.pattern, copy.path)]
        if copy.files:
            files = [f for f in files if f.removeprefix(copy.path.strip("/") + "/" if copy.path else "") in copy.files or f in copy.files]
        return self.load(copy, key, where, files)

    def _where(self, stage: list[str], context: tuple[str, str]) -> Key:
        return (*context, stage[0])[:3] if len(stage) == 1 else (context[0], *stage) if len(stage) == 2 else tuple(stage[:3])

    def load(self, copy: Copy, key: Key, where: Key, files: list[str]) -> CopyResult:
        out = CopyResult()
        table = self.view.get(key)
        if not files:
            return out
        folder = self.stages.directory(*where)
        done, added = [], ()
        # without error handling all files are one write; else a file that fails is left out
        groups = [files] if copy.on_error.startswith("ABORT") else [[f] for f in files]
        for group in groups:
            try:
                df = self._stored(table, self.rows(copy.format, table, [f"{folder}/{f}" for f in group]))
                if copy.validation_mode:
                    # every value is computed, so every cast is tried
                    out.rows_loaded += df.select(F.to_json(F.struct("*")).alias("row")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("row"))).first().n
                else:
                    new, n = self.view.counted(key, df)
                    added += new
                    out.rows_loaded += n
                done += group
            except Exception as e:
                if copy.on_error.startswith("ABORT"):
                    raise wrap(e) from e
                out.errors.append(f"{group[0]}: {wrap(e)}")
        out.files_loaded = len(done)
        if added:
            out.rows_inserted = out.rows_loaded
            self.view.put(key, table, replace(table, files=table.files + added))
        if copy.purge and not copy.validation_mode:
            for f in done:
                self.stages.remove(*where, f)
        return out

    def _stored(self, table: Table, df: DataFrame) -> DataFrame:
        return self.writer._stored(table, df)

    def rows(self, f: Format, table: Table, paths: list[str]) -> DataFrame:
        if f.type == "CSV":
            return self._csv(f, table, paths)
        if f.type == "JSON":
            return self._json(f, table, paths)
        return self.spark.read.parquet(*paths).select(*[c.name for c in table.columns])

    def _csv(self, f: Format, table: Table, paths: list[str]) -> DataFrame:
        """Records as the table's columns.  A file is read by one task, as a quoted field may hold line breaks; ``MULTI_LINE = FALSE`` says that none does, and files are split."""
        names = [f"__{i}" for i in range(len(table.columns))]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("__bad", T.StringType())])
        reader = self.spark.read.schema(schema).option("sep", f.field_delimiter[:1]).option("columnNameOfCorruptRecord", "__bad").option("quote", '"').option("escape", '"')
        reader = reader.option("ignoreLeadingWhiteSpace", f.trim_space).option("ignoreTrailingWhiteSpace", f.trim_space)
        if f.record_delimiter in ("\n", "\r\n", "\r"):
            reader = reader.option("multiLine", f.multi_line)
        else:
            reader = reader.option("lineSep", f.record_delimiter)
        df = reader.option("header", f.skip_header == 1).option("enforceSchema", True).csv(paths)
        if f.skip_header > 1:  # records, not lines: the parser tells where one ends
            place = Window.partitionBy("__file").orderBy("__block", "__at")
            marked = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
            df = marked.withColumn("__at", F.row_number().over(place)).where(F.col("__at") > f.skip_header).drop("__file", "__block", "__at")
        kinds = [x.dataType for x in table.schema]
        bad = F.when(F.col("__bad").isNotNull(), F.raise_error(F.concat(F.lit("not as many fields as columns: "), F.col("__bad"))).cast("string"))
        out = []
        for i, (n, kind) in enumerate(zip(names, kinds, strict=True)):
            text = F.col(n)
            if i == len(names) - 1 and f.record_delimiter != "\r":  # a break within quotes can hide that lines end in both
                text = F.regexp_replace(text, r"\r\z", "")
            value = F.when(text.isin(["", *f.null_if]), F.lit(None)).otherwise(text)
            value = F.coalesce(bad, value) if i == 0 else value
            if f.date_format and isinstance(kind, T.DateType):
                value = F.to_date(value, date_picture(f.date_format))
            elif f.timestamp_format and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
                value = F.to_timestamp(value, date_picture(f.timestamp_format))
            out.append(value.alias(n))
        return df.select(*out)

    def _json(self, f: Format, table: Table, paths: list[str]) -> DataFrame:
        """A file is one document, an object or an array, over any number of lines; several documents in a file are an error.  It is read as one string, so 2 GB at most."""
        if len(table.columns) != 1:
            raise InvalidValue("JSON loads into a table of one column")
        whole = self.spark.read.text(paths, wholetext=True).where(~F.col("value").rlike(r"\A\s*\z")).select(F.parse_json(F.concat(F.lit("["), "value", F.lit("]"))).alias("a"))
        # the parser alone would stop behind the first document
        one = F.assert_true(F.expr("variant_get(a, '$[1]', 'variant')").isNull(), "more than one document")
        whole = whole.where(one.isNull()).select(F.expr("variant_get(a, '$[0]', 'variant')").alias("v"))
        whole = whole.select("v", F.schema_of_variant("v").alias("kind"))
        name = f"__copy_{uuid.uuid4().hex[:12]}"
        whole.createOrReplaceTempView(name)
        try:
            items = self.spark.sql(f"SELECT i.value AS v FROM {name} w, LATERAL variant_explode(w.v) i WHERE w.kind LIKE 'ARRAY%'")
        finally:
            self.spark.catalog.dropTempView(name)
        if f.strip_outer_array:
            items = items.where(F.schema_of_variant("v").like("OBJECT%"))
        else:
            items = items.select(F.expr("parse_json(concat('{\"$1\":', to_json(v), '}'))").alias("v"))
        single = whole.where("kind NOT LIKE 'ARRAY%'").where(F.assert_true(F.col("kind").like("OBJECT%"), "neither object nor array").isNull()).select("v")
        both = items.union(single)
        if f.strip_null_values:
            both = both.select(F.expr("parse_json(to_json(map_filter(from_json(to_json(v), 'map<string,variant>'), (k, x) -> NOT is_variant_null(x))))").alias("v"))
        kind = table.schema[0].dataType
        return both if isinstance(kind, T.VariantType) else both.select(F.to_json("v").alias("v"))

    def unload(self, copy: Copy, context: tuple[str, str]) -> CopyResult:
        """Writes a query's rows as files below the stage's path."""
        where = self._where(copy.stage, context)
        seen = Observation()  # rows are counted as they are written
        df = self.writer.run(copy.unload).observe(seen, F.count(F.lit(1)).alias("n"))
        at = f"{self.stages.directory(*where)}/{copy.path or 'data'}"
        if copy.format.type == "PARQUET":
            df.write.parquet(at)
        elif copy.format.type == "JSON":
            df.write.json(at)
        else:
            df.write.option("sep", copy.format.field_delimiter[:1]).option("header", copy.format.skip_header == 1).csv(at)
        return CopyResult(rows_loaded=seen.get["n"], rows_inserted=0, files_loaded=len([f for f, _ in self.stages.files(*where, below=copy.path or "data") if not f.endswith("_SUCCESS")]))
