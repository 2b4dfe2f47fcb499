"""Ingests: provider tables, station files, catalogues and labels as DataFrames with fixed columns. NaN becomes null on the way in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from displace.functions.timefn import gps_week, key_to_time
from displace.operators import geom

c = F.col

#: The providers' names of a column, and what is no acquisition.
ALIASES = {
    "ps_id": ["ps_id", "PS_ID", "ID", "pid"],
    "x": ["x", "X", "easting"],
    "y": ["y", "Y", "northing"],
    "z": ["z", "Z", "height"],
    "mean_vel": ["mean_vel", "mean_velo_vert", "mean_velo_east", "mean_velocity"],
    "var_mean_vel": ["var_mean_vel", "var_mean_velo_vert", "var_mean_velo_east", "var_mean_velocity", "mean_velocity_std"],
}
NO_TIME = ["OBJECTID", "Shape", "Input", "rmse", "acceleration", "acceleration_std", "seasonality", "seasonality_std", "incidence_angle", "track_angle", "direction"]


def no_nan(v: str) -> Column:
    return F.when(~F.isnan(c(v)), c(v))


def normalize_psi(df: DataFrame) -> DataFrame:
    """Points under their fixed names, whatever the provider calls them; missing columns are null. Acquisition columns stay."""
    first = {k: next((a for a in names if a in df.columns), None) for k, names in ALIASES.items()}
    out = [(no_nan(a) if dict(df.dtypes)[a] in ("double", "float") else c(a)).alias(k) if a else F.lit(None).cast("double").alias(k) for k, a in first.items()]
    return df.select(*out, *[c(n) for n in time_columns(df)])


def time_columns(df: DataFrame) -> list[str]:
    known = {a for names in ALIASES.values() for a in names} | set(NO_TIME)
    return [n for n in df.columns if n not in known]


def unpivot_series(df: DataFrame, key: str = "ps_id") -> DataFrame:
    """(key, ts, value): one row per acquisition; column names become times, NaN becomes null."""
    own = normalize_psi(df)
    long = own.unpivot([key], time_columns(own), "name", "value")
    return long.select(key, key_to_time(c("name")).alias("ts"), F.nanvl("value", F.lit(None)).alias("value"))


def read_provider_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header, a string id first, doubles after it; the direction comes from the file's name (_E_, _E.csv: east, _U_, _U.csv: up), or from its
    folder's where a distributed writer made a folder of that name."""
    schema = StructType([StructField(columns[0], StringType())] + [StructField(n, DoubleType()) for n in columns[1:]])
    rows = spark.read.schema(schema).option("header", True).csv(path)
    names = F.split(c("_metadata.file_path"), "/")
    return rows.withColumn("direction", F.coalesce(*[F.nullif(direction_of(F.element_at(names, -k)), F.lit("")) for k in (1, 2)], F.lit("")))


def provider_points(df: DataFrame, x: str = "easting", y: str = "northing", z: str = "height", source: int = 3035, target: int = 32632) -> DataFrame:
    """df with `geometry`, a point with its height in the target system."""
    moved = geom.reproject(df, x, y, source, target, ("_x", "_y"))
    return moved.withColumn("geometry", geom.point(c("_x"), c("_y"), c(z))).drop("_x", "_y")


def direction_of(name: Column) -> Column:
    return F.regexp_extract(name, r"_([EU])(?:_|\.csv)", 1)


def merge_direction(df: DataFrame, direction: str) -> DataFrame:
    """All rows of a direction; rows that several files share collapse."""
    return df.where(c("direction") == direction).dropDuplicates()


PATTERNS, HIDDEN = ("Zeitreihe_%", "vertikal%", "Ost_West%"), ("gpkg_%", "rtree_%", "sqlite_%")


def list_tables(spark: SparkSession, patterns: tuple[str, ...] | None = PATTERNS, hidden: tuple[str, ...] = HIDDEN) -> DataFrame:
    """The session catalogue's tables, filtered by name."""
    return named_tables(spark.sql("SHOW TABLES").select(c("tableName").alias("name")), patterns, hidden)


def named_tables(names: DataFrame, patterns: tuple[str, ...] | None = PATTERNS, hidden: tuple[str, ...] = HIDDEN, name: str = "name") -> DataFrame:
    """Tables whose name matches one of the patterns (None: any) and none of the hidden ones, in either case of letters."""
    like = lambda ps: reduce(Column.__or__, [F.lower(name).like(p.lower()) for p in ps], F.lit(False))
    return names.where((F.lit(True) if patterns is None else like(patterns)) & ~like(hidden))


def decimal_comma(v: Column) -> Column:
    return F.regexp_replace(v, ",", ".").try_cast("double")


def groundwater(lines: DataFrame, line: str = "value") -> DataFrame:
    """short_id; id; name; easting; northing; dd.MM.yyyy; height with a decimal comma. A short id that is no number is 0."""
    p = F.split(c(line), ";")
    return lines.select(F.coalesce(p[0].try_cast("int"), F.lit(0)).alias("short_id"), p[1].alias("station"), p[2].alias("name"), p[3].try_cast("double").alias("x"), p[4].try_cast("double").alias("y"), F.try_to_timestamp(p[5], F.lit("dd.MM.yyyy")).cast("timestamp_ntz").alias("ts"), decimal_comma(p[6]).alias("value"))


def gauge(lines: DataFrame, file: str = "file", line: str = "value") -> DataFrame:
    """Header lines '#..SNAME*..|SWATER*..|SANR*..|' and data lines 'yyyyMMddHHmmss value'; values below 0 go. One row per sample with its file's
    station, water and number."""
    field = lambda k: F.max(F.nullif(F.regexp_extract(c(line), rf"{k}\*?([^|*]*)\|", 1), F.lit("")))
    head = lines.where(c(line).startswith("#")).groupBy(file).agg(field("SNAME").alias("station"), field("SWATER").alias("water"), field("SANR").alias("number"))
    p = F.split(F.trim(c(line)), r"\s+")
    data = lines.where(~c(line).startswith("#")).select(file, F.try_to_timestamp(p[0], F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz").alias("ts"), F.get(p, F.lit(1)).try_cast("double").alias("value"))
    return data.where("ts is not null and value >= 0").join(head, file, "left")


def climate(lines: DataFrame, line: str = "value") -> DataFrame:
    """Columns 1, 5, 6, 7 and 14 of ';' rows; temperatures below -50 and rain below 0 are missing."""
    p = F.split(c(line), ";")
    t = lambda i: F.when(F.trim(p[i]).try_cast("double") >= -50, F.trim(p[i]).try_cast("double"))
    rain = F.trim(p[14]).try_cast("double")
    return lines.select(F.try_to_timestamp(F.trim(p[1]), F.lit("yyyyMMdd")).cast("timestamp_ntz").alias("ts"), t(5).alias("mean"), t(6).alias("high"), t(7).alias("low"), F.when(rain >= 0, rain).alias("rain"))


def rainfall(lines: DataFrame, line: str = "value") -> DataFrame:
    """dd.MM.yyyy HH:mm:ss in column 0, a decimal comma in column 3; a value with '-' is 0."""
    p = F.split(c(line), ";")
    return lines.select(F.try_to_timestamp(p[0], F.lit("dd.MM.yyyy HH:mm:ss")).cast("timestamp_ntz").alias("ts"), F.when(p[3].contains("-"), 0.0).otherwise(decimal_comma(p[3])).alias("rain"))


def temperature_matrix(df: DataFrame, day: str, stations: DataFrame | None = None) -> DataFrame:
    """One column per station, named 'name / ..'; '-' is missing. (station, ts, value), with the stations' coordinates if given."""
    long = df.unpivot([day], [n for n in df.columns if n != day], "station", "value")
    out = long.select(F.trim(F.split("station", " / ")[0]).alias("station"), F.try_to_timestamp(c(day), F.lit("dd.MM.yyyy")).cast("timestamp_ntz").alias("ts"), F.when(c("value") != "-", decimal_comma(c("value"))).alias("value"))
    return out.join(stations, "station", "left") if stations is not None else out


def gas_storage(lines: DataFrame, line: str = "value") -> DataFrame:
    """Tab-separated 'd. m. Y' or 'd.m.Y' and a level with blanks for thousands; percent of the highest level."""
    p = F.split(c(line), "\t")
    day = F.coalesce(F.try_to_timestamp(p[0], F.lit("d. M. yyyy")), F.try_to_timestamp(p[0], F.lit("d.M.yyyy")))
    own = lines.select(day.cast("timestamp_ntz").alias("ts"), F.regexp_replace(p[1], r"\s", "").try_cast("double").alias("level"))
    return own.withColumn("percent", c("level") / own.agg(F.max("level")).scalar() * 100)


def earthquakes(lines: DataFrame, line: str = "value") -> DataFrame:
    """id;year;month;day;time;lat;lon;depth;magnitude with decimal commas; the time is repaired and joined with the date."""
    from displace.functions.timefn import time_repair

    p = F.split(c(line), ";")
    day = F.concat_ws("-", p[1], F.lpad(p[2], 2, "0"), F.lpad(p[3], 2, "0"))
    t = F.try_to_timestamp(F.concat_ws(" ", day, F.substring(F.nullif(time_repair(F.nullif(p[4], F.lit(""))), F.lit("")), 1, 8)), F.lit("yyyy-MM-dd HH:mm:ss"))
    return lines.select(p[0].try_cast("long").alias("id"), t.cast("timestamp_ntz").alias("t"), *[decimal_comma(p[i]).alias(n) for i, n in ((5, "lat"), (6, "lon"), (7, "depth"), (8, "magnitude"))])


def gnss(lines: DataFrame, line: str = "value") -> DataFrame:
    """gps_week north sigma east sigma up sigma, separated by white space."""
    p = F.split(F.trim(c(line)), r"\s+")
    return lines.select(gps_week(p[0].try_cast("int")).alias("ts"), *[p[i].try_cast("double").alias(n) for i, n in enumerate(("north", "sigma_north", "east", "sigma_east", "up", "sigma_up"), 1)])


def site_logs(lines: DataFrame, file: str = "file", line: str = "value") -> DataFrame:
    """One row per file of 'key : value' lines: id (upper-case file stem), name in title case, X, Y, Z."""
    found = lambda k: F.max(F.when(c(line).contains(k), F.trim(F.regexp_extract(c(line), r":\s*(.*)$", 1))))
    g = lines.groupBy(file).agg(found("Site Name").alias("name"), *[found(f"{k} coordinate (m)").try_cast("double").alias(k.lower()) for k in "XYZ"])
    return g.select(F.upper(F.regexp_extract(file, r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("id"), F.initcap(F.lower("name")).alias("name"), "x", "y", "z")


def tile_corners(paths: DataFrame, path: str = "path", size: float = 1000.0) -> DataFrame:
    """(path, x, y): four corners per tile, its origin from the name: _x<m>_y<m>, or _<km>_<km>."""
    metres, km = r"_x(\d+)_y(\d+)", r"_(\d+)_(\d+)(?:_|\.|$)"
    get = lambda i: F.coalesce(F.nullif(F.regexp_extract(path, metres, i), F.lit("")).try_cast("double"), F.nullif(F.regexp_extract(path, km, i), F.lit("")).try_cast("double") * 1000)
    corner = lambda dx, dy: F.struct((c("_x") + dx * size).alias("x"), (c("_y") + dy * size).alias("y"))
    own = paths.select(path, get(1).alias("_x"), get(2).alias("_y")).where("_x is not null and _y is not null")
    return own.select(path, F.explode(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).alias("p")).select(path, "p.x", "p.y")


def manual_labels(lines: DataFrame, line: str = "value") -> DataFrame:
    """LaTeX-marked rows 'group & classes & comment': digits are the group, \\underline means research, \\textbf known, $^{?}$ an unclear class."""
    p = F.split(c(line), "&")
    classes = F.filter(F.transform(F.split(p[1], ","), lambda v: F.trim(v)), lambda v: v != "")
    clean = lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r"\$\^\{\?\}\$", ""), r"\\[a-z]+\{([^}]*)\}", "$1"))
    return lines.select(
        F.nullif(F.regexp_replace(p[0], r"\D", ""), F.lit("")).try_cast("long").alias("grp"),
        p[0].contains("\\underline").alias("research"),
        p[0].contains("\\textbf").alias("known"),
        *[clean(F.get(classes, F.lit(i))).alias(f"class_{i + 1}") for i in range(3)],
        *[F.coalesce(F.get(classes, F.lit(i)).contains("$^{?}$"), F.lit(False)).alias(f"unclear_{i + 1}") for i in range(3)],
        clean(p[2]).alias("comment"),
    )


def regions_of_interest(df: DataFrame, order: str, name: str = "name") -> DataFrame:
    """Regions with a name; a running number from 0, by `order`, where there is none. A small table."""
    number = (F.row_number().over(Window.orderBy(order)) - 1).cast("string")
    return df.withColumn(name, F.coalesce(c(name), number) if name in df.columns else number)
