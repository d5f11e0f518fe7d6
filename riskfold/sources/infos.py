"""Column catalog ("data infos"): which columns are numeric, categorical or
binary, which are endpoints, when each was collected and which to drop.

The catalog describes the schema, so it is small (one row per column) and
lives on the driver; the cohort it describes never does.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFOS_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType(), False),
    T.StructField("endpoint", T.BooleanType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("input_time", T.StringType(), True),
    T.StructField("drop", T.BooleanType(), False),
])

KINDS = ("N", "C", "B")


@dataclass(frozen=True)
class ColumnInfo:
    column_name: str
    endpoint: bool
    data_type: str
    input_time: str | None = "pre"
    drop: bool = False


@dataclass(frozen=True)
class Catalog:
    """Ordered column catalog with the lookups of the cohort loader."""

    rows: tuple[ColumnInfo, ...] = field(default_factory=tuple)

    # -- construction ---------------------------------------------------
    @staticmethod
    def of(rows) -> "Catalog":
        out = []
        for r in rows:
            r = r if isinstance(r, ColumnInfo) else ColumnInfo(**dict(r))
            if r.data_type not in KINDS:
                raise ValueError(f"data_type of {r.column_name!r} must be one of {KINDS}")
            out.append(r)
        names = [r.column_name for r in out]
        if len(set(names)) != len(names):
            raise ValueError("duplicate column_name in catalog")
        return Catalog(tuple(out))

    @staticmethod
    def from_dataframe(df: DataFrame) -> "Catalog":
        """Collect a catalog table (bounded by the number of columns)."""
        cols = ["column_name", "endpoint", "data_type", "input_time", "drop"]
        return Catalog.of(r.asDict() for r in df.select(*cols).collect())

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r.__dict__.values()) for r in self.rows], INFOS_SCHEMA)

    # -- lookups (S4) ---------------------------------------------------
    def _select(self, endpoint: bool, kind: str | None, include_drop: bool) -> list[str]:
        return [r.column_name for r in self.rows
                if r.endpoint == endpoint and (include_drop or not r.drop)
                and (kind is None or r.data_type == kind)]

    def all_features(self, include_drop=True):
        return self._select(False, None, include_drop)

    def binary_features(self, include_drop=True):
        return self._select(False, "B", include_drop)

    def categorical_features(self, include_drop=True):
        return self._select(False, "C", include_drop)

    def numerical_features(self, include_drop=True):
        return self._select(False, "N", include_drop)

    def all_endpoints(self, include_drop=True):
        return self._select(True, None, include_drop)

    def binary_endpoints(self, include_drop=True):
        return self._select(True, "B", include_drop)

    def categorical_endpoints(self, include_drop=True):
        return self._select(True, "C", include_drop)

    def numerical_endpoints(self, include_drop=True):
        return self._select(True, "N", include_drop)

    def feature_set(self, tags) -> list[str]:
        """Features collected at one of ``tags``; a blank time never matches."""
        tags = set(tags)
        return [r.column_name for r in self.rows if not r.endpoint and r.input_time in tags]

    def names(self) -> list[str]:
        return [r.column_name for r in self.rows]

    def kind(self, name: str) -> str:
        for r in self.rows:
            if r.column_name == name:
                return r.data_type
        raise KeyError(name)

    def restrict(self, columns) -> "Catalog":
        """Catalog without the rows whose column is absent from ``columns``."""
        keep = set(columns)
        return Catalog(tuple(r for r in self.rows if r.column_name in keep))

    def with_rows(self, extra) -> "Catalog":
        return Catalog.of(list(self.rows) + list(extra))

    def replace_row(self, name: str, **changes) -> "Catalog":
        return Catalog(tuple(replace(r, **changes) if r.column_name == name else r for r in self.rows))


def read_infos(spark: SparkSession, path: str, delimiter: str = ",") -> Catalog:
    """Read a catalog file with columns
    ``column_name, endpoint, data_type, input_time, drop`` (extra columns,
    such as an unnamed index, are ignored)."""
    raw = spark.read.option("header", True).option("sep", delimiter).csv(path)
    rename = {c: c.strip().replace(" ", "_") for c in raw.columns}
    raw = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in rename.items()])
    missing = {"column_name", "endpoint", "data_type", "input_time", "drop"} - set(raw.columns)
    if missing:
        raise ValueError(f"catalog lacks columns {sorted(missing)}")

    def as_bool(c):
        return F.lower(F.trim(F.col(c))).isin("true", "1", "yes", "t")

    df = raw.select(
        F.trim("column_name").alias("column_name"), as_bool("endpoint").alias("endpoint"),
        F.upper(F.trim("data_type")).alias("data_type"),
        F.nullif(F.trim("input_time"), F.lit("")).alias("input_time"), as_bool("drop").alias("drop"))
    return Catalog.from_dataframe(df)


def check_schema(df: DataFrame, catalog: Catalog, key: str | None = "row_id") -> None:
    """Every data column must be declared; name the unknown ones."""
    declared = set(catalog.names()) | ({key} if key else set())
    unknown = [c for c in df.columns if c not in declared]
    if unknown:
        raise ValueError(f"Column set doesn't match: {unknown}")
