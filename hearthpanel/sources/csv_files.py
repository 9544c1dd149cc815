"""CSV inputs: contracts, wide statistics, and indicator tables."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hearthpanel.functions.numeric import clean_amount, clean_double
from hearthpanel.functions.periods import pad_code, year_month, ym_from_compact
from hearthpanel.functions.regions import NATIONWIDE, province_from_code, short_province
from hearthpanel.operators.reshape import arrival, keep_first, union_all

# Encodings tried in order, by their JVM names.
ENCODINGS = ("UTF-8", "MS949")
_PYTHON_NAMES = {"MS949": "cp949"}

# Header names of the raw contract files.
SALE_COLUMNS = {
    "년": "year",
    "월": "month",
    "지역코드": "district_code",
    "전용면적": "area",
    "건축년도": "build_year",
    "거래금액": "amount",
}
LEASE_COLUMNS = {
    "년": "year",
    "월": "month",
    "지역코드": "district_code",
    "전용면적": "area",
    "보증금액": "deposit",
    "월세금액": "rent",
}

_BAD = "_malformed"


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("text").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line is valid UTF-8, else the Korean agency charset.

    The check stops at the first invalid line; its bytes never reach the driver.
    """
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    return ENCODINGS[0] if broken.isEmpty() else ENCODINGS[1]


def _too_many_fields(record: Column, fields: int) -> Column:
    unquoted = F.regexp_replace(record, r'"(?:[^"]|"")*"', "")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) >= fields


@dataclass(frozen=True)
class FileGroup:
    """Files that share an encoding and a first line; ``names`` are the fields of that line."""

    encoding: str
    names: tuple[str, ...]
    files: tuple[str, ...]


def _first_rows(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            return


def first_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file`` and ``line`` (its bytes) of every file that has a line, in one job.

    A session of its own deals one file to a task and one row to a batch, and a
    task stops after its first row: of a file only its first block is read,
    whatever its length. Compressed files are read too.
    """
    own = spark.newSession()
    for name, value in {
        "spark.sql.files.maxPartitionBytes": str(2**50),
        "spark.sql.files.openCostInBytes": str(2**50),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1",
    }.items():
        own.conf.set(name, value)
    lines = own.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(_first_rows, lines.schema)


def file_groups(spark: SparkSession, path: str | list[str], *, encoding: str | None = None) -> list[FileGroup]:
    """The files behind paths, folders and patterns, by encoding and header; one row per file reaches the driver.

    Header lines beyond ASCII tell the encodings apart. Files whose header does
    not are looked through for lines that are no UTF-8, all in one more job.
    Files without a line are left out.
    """
    heads = sorted((unquote(r["file"]), bytes(r["line"])) for r in first_lines(spark, path).collect())
    plain = [file for file, line in heads if line.isascii()] if encoding is None else []
    other = set()
    if plain:
        text = spark.read.text(plain).filter(~F.is_valid_utf8("value"))
        other = {unquote(r[0]) for r in text.select("_metadata.file_path").distinct().collect()}
    groups: dict[tuple, list[str]] = {}
    for file, line in heads:
        charset = encoding or ENCODINGS[not _is_utf8(line) or file in other]
        fields = next(csv.reader([line.decode(_PYTHON_NAMES.get(charset, charset), "replace")]), [])
        groups.setdefault((charset, tuple(f.lstrip("\ufeff").strip() for f in fields)), []).append(file)
    return [FileGroup(charset, names, tuple(files)) for (charset, names), files in groups.items()]


def _is_utf8(line: bytes) -> bool:
    try:
        line.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _column_names(names: tuple[str, ...]) -> list[str]:
    """Header fields as column names: one without text, or that occurs twice, is told apart by its place."""
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _group_lines(spark: SparkSession, group: FileGroup, header: bool) -> DataFrame:
    """All lines of a group by its columns, with the text of those that have more or fewer fields."""
    names = _column_names(group.names) if header else [f"_c{i}" for i in range(len(group.names))]
    schema = StructType([StructField(n, StringType()) for n in (*names, _BAD)])
    return (
        spark.read.schema(schema)
        .options(header=header, encoding=group.encoding, columnNameOfCorruptRecord=_BAD, columnPruning="false")
        .csv(list(group.files))
    )


def _skipped(group: FileGroup) -> Column:
    return F.col(_BAD).isNotNull() & _too_many_fields(F.col(_BAD), len(group.names))


def read_csv_any(spark: SparkSession, path: str | list[str], *, encoding: str | None = None, header: bool = True) -> DataFrame:
    """All-text CSV with header names; lines with too many fields are skipped.

    A short line keeps its fields and is null in the rest. Every file is read
    by its own encoding (unless ``encoding`` names one for all) and header; a
    column that a file lacks is null in its rows. Files without lines give none.
    """
    parts = []
    for group in file_groups(spark, path, encoding=encoding):
        lines = _group_lines(spark, group, header)
        parts.append(lines.filter(~_skipped(group)).drop(_BAD))
    return union_all(parts) if parts else spark.createDataFrame([], StructType([]))


def _renamed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *((F.col(f"`{raw}`") if raw in have else F.lit(None).cast("string")).alias(name) for raw, name in columns.items())
    )


def _contract_groups(spark: SparkSession, path: str | list[str], columns: dict[str, str], encoding: str | None) -> list[FileGroup]:
    groups = file_groups(spark, path, encoding=encoding)
    for group in groups:
        if missing := [c for c in columns if c not in group.names]:
            raise ValueError(f"{group.files[0]} lacks the columns {', '.join(missing)}")
    if not groups:
        raise ValueError(f"no contract file with a header in {path}")
    return groups


def scan_contracts(spark: SparkSession, path: str | list[str], columns: dict[str, str], *, encoding: str | None = None) -> DataFrame:
    """Raw contracts, the used columns only, still as text.

    Each file is read by its own header and encoding; files that share both
    are read together. A file that lacks a used column is an error, so that no
    rollup is stored over rows that could not be read.
    """
    groups = _contract_groups(spark, path, columns, encoding)
    return union_all([_renamed(_group_lines(spark, g, True).filter(~_skipped(g)), columns) for g in groups])


@dataclass(frozen=True)
class Landing:
    """Contracts that were read once: the rows, the lines that were left out, and how many of each."""

    rows: DataFrame
    rejects: DataFrame  # file, line
    lines: int
    skipped: int
    short: int  # kept, but with fewer fields than the header


def land_contracts(
    spark: SparkSession, path: str | list[str], columns: dict[str, str], folder: str, *, encoding: str | None = None
) -> Landing:
    """Contract files to Parquet in ``folder``, the lines left out beside the rows.

    Everything is done in the one scan that writes: kept and rejected lines go
    to a folder each, and the counts are observed on the way.
    """
    parts = []
    for group in _contract_groups(spark, path, columns, encoding):
        lines = _group_lines(spark, group, True)
        flagged = lines.select(*(F.col(f"`{raw}`").alias(name) for raw, name in columns.items()), F.col(_BAD), _skipped(group).alias("rejected"))
        parts.append(flagged.withColumn("file", F.when(F.col("rejected"), F.input_file_name())))
    seen = Observation()
    short = F.col(_BAD).isNotNull() & ~F.col("rejected")
    observed = union_all(parts).observe(
        seen, F.count(F.lit(1)).alias("lines"), F.count_if("rejected").alias("skipped"), F.count_if(short).alias("short")
    )
    kept = [F.when(~F.col("rejected"), F.col(name)).alias(name) for name in columns.values()]
    out = observed.select(*kept, "file", F.when(F.col("rejected"), F.col(_BAD)).alias("line"), "rejected")
    out.write.mode("overwrite").partitionBy("rejected").parquet(folder)
    stored = spark.read.schema(out.schema).parquet(folder)
    counts = seen.get
    return Landing(
        stored.filter("NOT rejected").select(*columns.values()),
        stored.filter("rejected").select("file", "line"),
        *(int(counts.get(name) or 0) for name in ("lines", "skipped", "short")),
    )


def scan_sales(spark: SparkSession, path: str | list[str], *, encoding: str | None = None) -> DataFrame:
    return scan_contracts(spark, path, SALE_COLUMNS, encoding=encoding)


def scan_leases(spark: SparkSession, path: str | list[str], *, encoding: str | None = None) -> DataFrame:
    return scan_contracts(spark, path, LEASE_COLUMNS, encoding=encoding)


# ---- wide statistics --------------------------------------------------------


def read_grdp(spark: SparkSession, path: str, *, encoding: str | None = None) -> DataFrame:
    """Regional product from a file with two header rows, every second column a year."""
    raw = read_csv_any(spark, path, encoding=encoding, header=False)
    top = raw.head(1)
    years = {}
    for i in range(2, len(raw.columns), 2):
        label = str(top[0][i] or "").strip() if top else ""
        if re.fullmatch(r"\d+", label):
            years[raw.columns[i]] = int(label)
    region, part = (F.regexp_replace(F.trim(F.col(c)), '"', "") for c in raw.columns[:2])
    cells = [F.struct(F.lit(year).alias("year"), F.col(c).alias("text")) for c, year in years.items()]
    return (
        raw.filter(part == "소계")  # Fixed value: label of subtotal rows.
        .select(short_province(region).alias("province"), F.explode(F.array(*cells)).alias("cell"))
        .select(
            "province",
            F.col("cell.year").alias("year"),
            F.trim(F.regexp_replace("cell.text", '[,"-]', "")).try_cast("bigint").alias("grdp"),
        )
        .filter(F.col("grdp").isNotNull() & F.col("province").isNotNull())
    )


_TOTAL = "계_총인구수"  # Fixed values: column name parts of the population files.
_MALE, _FEMALE = "남_총인구수", "여_총인구수"


def _population_file(spark: SparkSession, path: str, position: int, encoding: str | None) -> DataFrame:
    raw = read_csv_any(spark, path, encoding=encoding)
    region = F.col(f"`{raw.columns[0]}`")
    code = F.trim(F.replace(F.get(F.split(region, r"\("), F.lit(1)), F.lit(")"), F.lit("")))
    cells = []
    for place, name in enumerate(raw.columns):
        year = re.match(r"(\d+)년", name)
        if _TOTAL not in name or not year:
            continue

        def number(twin: str, name=name) -> Column:
            other = name.replace(_TOTAL, twin)
            return clean_amount(F.col(f"`{other}`")) if other in raw.columns else F.lit(None).cast("bigint")

        cells.append(
            F.struct(
                F.lit(int(year.group(1))).alias("year"),
                F.lit(place).alias("place"),
                number(_TOTAL).alias("population"),
                number(_MALE).alias("population_male"),
                number(_FEMALE).alias("population_female"),
            )
        )
    if not cells:
        return spark.createDataFrame([], "province string, year int, population bigint, population_male bigint, population_female bigint, _order struct<file:int,line:struct<file:string,split:bigint,row:bigint>,place:int>")
    order = F.struct(F.lit(position).alias("file"), arrival().alias("line"), F.col("cell.place").alias("place"))
    return (
        raw.withColumn("cell", F.explode(F.array(*cells)))
        .filter(region.contains("(") & code.rlike(r"^\d{2}0{8}$") & F.col("cell.population").isNotNull())
        .select(
            short_province(F.split(region, r"\(")[0]).alias("province"),
            "cell.year",
            "cell.population",
            "cell.population_male",
            "cell.population_female",
            order.alias("_order"),
        )
    )


def read_population(spark: SparkSession, paths: list[str], *, encoding: str | None = None) -> DataFrame:
    """Population of the provinces from wide yearly files; the first file wins."""
    present = [p for p in paths if path_exists(spark, p)]
    if not present:
        return spark.createDataFrame([], "province string, year int, population bigint, population_male bigint, population_female bigint")
    rows = union_all([_population_file(spark, p, i, encoding) for i, p in enumerate(present)])
    return keep_first(rows, ["province", "year"], F.col("_order")).drop("_order")


# Regions of the permit file that are sums of other rows.
PERMIT_TOTALS = ["전국", "수도권", "지방소계", "기타광역시", "기타지방"]


def read_permits(spark: SparkSession, path: str, *, encoding: str | None = None) -> DataFrame:
    """Apartment permits per province and month.

    Household rows are used; only if the file has none, the apartment rows.
    """
    raw = read_csv_any(spark, path, encoding=encoding)
    major, minor = F.trim("대분류"), F.trim("소분류")
    choice = F.when((major == "아파트") & (minor == "가구수"), 0).when((major == "아파트") & (minor == "아파트"), 1)
    best = raw.select(F.min(choice)).scalar()
    cells = []
    for name in raw.columns:
        month = re.fullmatch(r"\s*(\d+)\.\s*(\d+)\s*월?\s*", name)
        if month and "월" in name:
            cells.append(
                F.struct(
                    F.lit(int(month.group(1))).alias("year"), F.lit(int(month.group(2))).alias("month"), F.col(f"`{name}`").alias("text")
                )
            )
    return (
        raw.filter((choice == best) & ~F.trim("시도명").isin(PERMIT_TOTALS))
        .select(short_province("시도명").alias("province"), F.explode(F.array(*cells)).alias("cell"))
        .select("province", "cell.year", "cell.month", clean_double("cell.text").cast("bigint").alias("permits"))
        .filter(F.col("permits").isNotNull() & F.col("province").isNotNull())
        .withColumn("ym", year_month("year", "month"))
    )


# Columns of the age population file.
AGE_COLUMNS = {
    f"{sex}{decade}": f"{prefix}{name}"
    for decade, name in {"20대": "age_20s", "30대": "age_30s", "40대": "age_40s", "50대이상": "age_50_up"}.items()
    for sex, prefix in {"": "", "남_": "male_", "여_": "female_"}.items()
}


def read_age_population(spark: SparkSession, path: str, *, encoding: str | None = None) -> DataFrame:
    """Population by decade and sex; totals are left to the population table."""
    raw = read_csv_any(spark, path, encoding=encoding)
    if not {"시도", "연도"} <= set(raw.columns):
        return spark.createDataFrame([], "province string, year int")
    return raw.select(
        F.col("시도").alias("province"),
        clean_double("연도").cast("int").alias("year"),
        *(clean_double(f"`{c}`").cast("bigint").alias(AGE_COLUMNS[c]) for c in raw.columns if c in AGE_COLUMNS),
    ).filter(F.col("year").isNotNull())


# Columns of the pension workplace files.
WORKPLACE_COLUMNS = {
    "자료생성년월": "period",
    "법정동주소광역시도코드": "province_part",
    "법정동주소광역시시군구코드": "district_part",
    "가입자수": "subscribers",
    "당월고지금액": "billed",
    "신규취득자수": "hired",
    "상실가입자수": "left",
}


def choose_workplace_files(combined: str | None, single: list[str], last: str = "", others: tuple[str, ...] = ()) -> list[str]:
    """The combined file plus the single files of later periods; without one, all single files, or else all ``others``.

    ``last`` is the combined file's last period (``last_period``), as ``YYYYMM``.
    A name that starts its date with a year only counts by the year.
    """
    if combined is None:
        return sorted(single) or sorted(others)

    def later(path: str) -> bool:
        stamp = re.search(r"(?:19|20)\d{2}[-_.]?(?:0[1-9]|1[0-2])?", path.rsplit("/", 1)[-1])
        digits = re.sub(r"\D", "", stamp[0]) if stamp else ""
        return not digits or digits > last[: len(digits)] or (len(digits) == 4 and digits == last[:4])

    return [combined, *(p for p in sorted(single) if later(p))]


def last_period(spark: SparkSession, path: str, *, encoding: str | None = None) -> str:
    """Last period of a workplace file as ``YYYYMM``; empty if it has none."""
    raw = read_csv_any(spark, path, encoding=encoding)
    found = match_columns(raw.columns, ["자료생성년월"])
    if not found:
        raise ValueError(f"{path} has no period column")
    return raw.agg(F.max(F.regexp_replace(F.col(f"`{found['자료생성년월']}`"), r"\D", ""))).first()[0] or ""


def match_columns(have: list[str], wanted: list[str]) -> dict[str, str]:
    """Map wanted names to file names, exactly or else by containment."""
    found = {}
    for name in wanted:
        if name in have:
            found[name] = name
        else:
            near = next((c for c in have if name in c or c in name), None)
            if near is not None:
                found[name] = near
    return found


def read_workplaces(spark: SparkSession, paths: list[str], *, encoding: str | None = None) -> DataFrame:
    """Pension workplaces of several files; a file that lacks a column is an error."""
    frames = []
    for group in file_groups(spark, paths, encoding=encoding) if paths else []:
        found = match_columns(_column_names(group.names), list(WORKPLACE_COLUMNS))
        if missing := [c for c in WORKPLACE_COLUMNS if c not in found]:
            raise ValueError(f"{group.files[0]} lacks the columns {', '.join(missing)}")
        lines = _group_lines(spark, group, True).filter(~_skipped(group))
        frames.append(lines.select(*(F.col(f"`{found[c]}`").alias(name) for c, name in WORKPLACE_COLUMNS.items())))
    if not frames:
        return spark.createDataFrame([], "district_code string, ym string, subscribers double, billed double, hired double, left double")
    return shape_workplaces(union_all(frames))


def shape_workplaces(raw: DataFrame) -> DataFrame:
    """Rows with a valid period, composed district code, and zero for missing numbers."""
    period = F.trim("period")
    numbers = ("subscribers", "billed", "hired", "left")
    return raw.filter(period.rlike(r"^(\d{6}|\d{4}-\d{2})$")).select(
        F.concat(pad_code("province_part", 2), pad_code("district_part", 3)).alias("district_code"),
        ym_from_compact(period).alias("ym"),
        *(F.coalesce(clean_double(c), F.lit(0.0)).alias(c) for c in numbers),
    )


def read_district_codes(spark: SparkSession, path: str, *, encoding: str = "MS949") -> DataFrame:
    """Active five-digit district codes of the region register, sorted."""
    raw = read_csv_any(spark, path, encoding=encoding)
    full, status = (F.trim(F.col(f"`{raw.columns[i]}`")) for i in (0, 2))
    code = F.floor(full.try_cast("bigint") / 100000).cast("string")
    return (
        raw.filter((status == "존재") & (F.length(full) >= 5))  # Fixed value: status of active regions.
        .select(code.alias("district_code"))
        .filter(F.col("district_code").isNotNull())
        .distinct()
        .orderBy("district_code")
    )


def read_district_names(spark: SparkSession, path: str, *, encoding: str = "MS949") -> DataFrame:
    """District names from the same register: rows whose last five digits are zero."""
    raw = read_csv_any(spark, path, encoding=encoding)
    full, name = (F.trim(F.col(f"`{raw.columns[i]}`")) for i in (0, 1))
    return (
        raw.filter(full.rlike(r"^\d{5}0{5}$") & ~full.rlike(r"^\d{2}0{8}$"))
        .select(F.substring(full, 1, 5).alias("district_code"), F.element_at(F.split(name, r"\s+"), -1).alias("district_name"))
        .dropDuplicates(["district_code"])
    )


def read_pension(spark: SparkSession, path: str) -> DataFrame:
    """District pension rollup; a file without provinces gets them from the codes."""
    from hearthpanel.sources.specs import PENSION, read_source

    df = read_source(spark, PENSION, path)
    code = pad_code("district_code")
    province = short_province("province" if "province" in df.columns else province_from_code(code))
    return df.withColumns({"district_code": code, "province": province})


def drop_national(df: DataFrame) -> DataFrame:
    return df.filter(F.col("province") != NATIONWIDE)
